"""Scans and sinks: CSV splits, essays, frame corpora, golden JSON, results, dataset folders."""

from __future__ import annotations

import datetime as dt
import json
import shutil
import uuid
import zipfile
from collections.abc import Callable, Iterable
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DatasetError
from ..operators.datasets import sample
from ..operators.filters import frame_corpus, require
from ..schemas import ANNOTATIONS, ESSAYS, SPLITS


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Quoted, multi-line CSV with a header."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def split_scan(spark: SparkSession, folder: str, split: str, max_samples: int | None = 0, seed: int = 42, order: tuple[str, ...] = ()) -> DataFrame:
    """One split of a prepared dataset: Parquet partitions or ``{split}.csv``; 0 or None samples mean all."""
    if split not in SPLITS:
        raise DatasetError(f"unknown split {split}")
    try:
        df = spark.read.parquet(folder).filter(F.col("split") == split).drop("split")
    except Exception as first:  # not Parquet: a CSV file per split
        try:
            df = read_csv(spark, f"{folder}/{split}.csv")
        except Exception:
            raise DatasetError(f"{folder} is not prepared") from first
    return sample(df, max_samples, seed, *(order or df.columns))


def write_splits(df: DataFrame, folder: str, split: str = "split") -> None:
    """Parquet, a partition per split; array columns stay beside their rows."""
    df.write.mode("overwrite").partitionBy(split).parquet(folder)


def write_split_csv(df: DataFrame, folder: str, split: str = "split") -> None:
    """CSV for other tools: one folder per split, arrays left out."""
    plain = df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))])
    plain.write.mode("overwrite").partitionBy(split).option("header", True).option("escape", '"').csv(folder)


def land(urls: Iterable[str], folder: str, fetch: Callable[[str], bytes]) -> list[Path]:
    """Fetch what is not there yet (an empty file counts as missing); names are the addresses' last parts."""
    out = []
    for url in urls:
        path = Path(folder) / Path(urlparse(url).path).name
        if not path.exists() or not path.stat().st_size:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(fetch(url))
        out.append(path)
    return out


def essays(spark: SparkSession, path: str) -> DataFrame:
    """Essay segments from a CSV file or a ZIP file with one (unpacked beside it)."""
    p = Path(path)
    if p.suffix == ".zip":
        with zipfile.ZipFile(p) as z:
            names = [n for n in z.namelist() if n.endswith(".csv")]
            if not names:
                raise DatasetError(f"{path} holds no CSV file")
            p = Path(z.extract(names[0], p.parent))
    if not p.exists():
        raise DatasetError(f"{p} is missing")
    have = read_csv(spark, str(p)).columns
    if missing := sorted(set(ESSAYS.fieldNames()) - set(have)):
        raise DatasetError(f"missing columns: {missing}")
    kinds = {f.name: f.dataType for f in ESSAYS.fields}
    return read_csv(spark, str(p), T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in have])).select(*ESSAYS.fieldNames())


def frame_corpora(spark: SparkSession, training: str, validation: str) -> dict[str, DataFrame]:
    """The two files as (text, interpretative_frame); {} if either is missing."""
    if not (Path(training).exists() and Path(validation).exists()):
        return {}
    return {name: frame_corpus(read_csv(spark, p)) for name, p in (("training", training), ("validation", validation))}


def supported_claims(df: DataFrame, limit: int = 100) -> DataFrame:
    """(claim, evidence) of the rows labelled SUPPORTS; the scan ends once enough are found."""
    return require(df, "label", "hypothesis", "premise").filter(F.upper("label") == "SUPPORTS").select(F.col("hypothesis").alias("claim"), F.col("premise").alias("evidence")).limit(limit)


def golden(spark: SparkSession, folder: str) -> DataFrame:
    """The annotations file of a folder as one row; a file without a version has version "1"."""
    path = Path(folder)
    if not path.exists():
        raise FileNotFoundError(folder)
    if not path.is_dir():
        raise NotADirectoryError(folder)
    file = path / "argument-annotations.json"
    if not file.exists():
        raise FileNotFoundError(str(file))
    return spark.read.schema(ANNOTATIONS).option("multiLine", True).json(str(file)).withColumn("version", F.coalesce("version", F.lit("1")))


def write_golden(golden: DataFrame, path: str) -> None:
    """One row of annotations as JSON (a hand-made file: small by nature)."""
    Path(path).write_text(json.dumps(golden.first().asDict(recursive=True), ensure_ascii=False, indent=2), encoding="utf-8")


def write_result(folder: str, metrics: dict, configuration: dict, start: dt.datetime, finish: dt.datetime, version: str) -> Path:
    """A benchmark's figures, settings and times as one JSON file named by time and a random part."""
    path = Path(folder) / f"{finish:%H_%M_%S_%d_%m_%Y}_{uuid.uuid4()}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    meta = {"start_datetime": start.isoformat(), "finish_datetime": finish.isoformat(), "duration": (finish - start).total_seconds(), "golden_dataset_version": version}
    path.write_text(json.dumps({"metrics": metrics, "configuration": configuration, "metadata": meta}, indent=2, default=str), encoding="utf-8")
    return path


def latest_result(folder: str) -> Path | None:
    """The newest result by the time in its name."""
    stamp = lambda p: dt.datetime.strptime("_".join(p.stem.split("_")[:6]), "%H_%M_%S_%d_%m_%Y")
    return max(Path(folder).glob("*.json"), key=stamp, default=None)


def clear(*folders: str) -> None:
    """Remove dataset folders."""
    for f in folders:
        shutil.rmtree(f, ignore_errors=True)
