"""Record schemas and the fixed tables of frames, splits and inference labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fifteen frames of the Policy Frames Codebook in order; labels count from 1.
FRAMES = (
    "Economic",
    "Capacity and Resources",
    "Morality",
    "Fairness and Equality",
    "Constitutionality and Legality",
    "Policy Prescription and Evaluation",
    "Crime and Justice",
    "Security and Defense",
    "Health and Safety",
    "Quality of Life",
    "Cultural Identity",
    "Public Opinion",
    "Political",
    "External Regulation and Reputation",
    "Other",
)
# The splits' names.
SPLITS = ("training", "validation", "testing")
# Inference results.
NEUTRAL, ENTAILMENT, CONTRADICTION = 0, 1, -1

ARGUMENT = T.StructType([T.StructField("claim", T.StringType(), False), T.StructField("evidence", T.StringType(), False)])
FRAMED_ARGUMENT = T.StructType([*ARGUMENT.fields, T.StructField("primary_frame", T.StringType()), T.StructField("frame_probabilities", T.MapType(T.StringType(), T.DoubleType()))])
STYLED_ARGUMENT = T.StructType([*FRAMED_ARGUMENT.fields, T.StructField("style_vector", T.ArrayType(T.DoubleType()))])
COUNTERARGUMENTS = T.StructType([T.StructField("argument", ARGUMENT), T.StructField("counterarguments", T.ArrayType(ARGUMENT))])
PREDICTION = T.StructType([T.StructField("result", T.IntegerType(), False), T.StructField("confidence", T.DoubleType(), False)])
SEARCH_QUERY = T.StructType([T.StructField("original_text", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("normalized", T.StringType())])
SEARCH_RESULT = T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("snippet", T.StringType())])
DOCUMENT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("retrieved_at", T.TimestampType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)
ESSAYS = T.StructType([T.StructField("essay_id_comp", T.StringType()), T.StructField("discourse_type", T.StringType()), T.StructField("discourse_text", T.StringType()), T.StructField("discourse_start", T.DoubleType())])
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())])
ANNOTATIONS = T.StructType(
    [
        T.StructField("documents", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]))),
        T.StructField("arguments", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("documentId", T.LongType()), T.StructField("claim", SPAN), T.StructField("evidence", T.ArrayType(SPAN))]))),
        T.StructField("relations", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("type", T.StringType()), T.StructField("b", T.LongType())]))),
        T.StructField("version", T.StringType()),
    ]
)
METRICS = ("iou", "argument_precision", "argument_recall", "argument_f1", "pair_precision", "pair_recall", "pair_f1")


def frames(spark: SparkSession) -> DataFrame:
    """(frame_idx from 0, label from 1, frame): fifteen rows."""
    return spark.createDataFrame([(i, i + 1, f) for i, f in enumerate(FRAMES)], "frame_idx int, label int, frame string")


def frame_name(idx: Column) -> Column:
    """The frame at an index from 0; null outside the table."""
    return F.get(F.array(*[F.lit(f) for f in FRAMES]), idx)


def argument_text(argument: Column) -> Column:
    """Claim and evidence with a space between; null if either is."""
    return F.concat(argument["claim"], F.lit(" "), argument["evidence"])
