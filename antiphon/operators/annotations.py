"""Golden annotations: arguments, raw texts, related pairs, validation, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..functions.text import is_blank
from .ranks import ranked


def documents(golden: DataFrame) -> DataFrame:
    return golden.select(F.posexplode("documents").alias("at", "d")).select("at", "d.*")


def arguments(golden: DataFrame) -> DataFrame:
    """(arg_id, document_id, evidence_pos, claim, evidence): one row per claim and evidence span."""
    a = golden.select(F.explode("arguments").alias("a"))
    return a.select(F.col("a.id").alias("arg_id"), F.col("a.documentId").alias("document_id"), F.col("a.claim.text").alias("claim"), F.posexplode("a.evidence").alias("evidence_pos", "e")).select("arg_id", "document_id", "evidence_pos", "claim", F.col("e.text").alias("evidence"))


def raw_texts(golden: DataFrame) -> DataFrame:
    """(title, text); the last of repeated titles wins."""
    return documents(golden).groupBy("title").agg(F.max_by("text", "at").alias("text"))


def related_pairs(golden: DataFrame) -> DataFrame:
    """(a, b, first and second claim and evidence): per relation, the two arguments' evidence crossed.

    A relation to an unknown argument is an error."""
    rel = golden.select(F.posexplode("relations").alias("rel", "r")).select("rel", "r.a", "r.b")
    args = arguments(golden).select("arg_id", "claim", "evidence")
    side = lambda n: args.select(F.col("arg_id").alias(n), F.col("claim").alias(f"claim_{n}"), F.col("evidence").alias(f"evidence_{n}"))
    both = rel.join(side("a"), "a", "left").join(side("b"), "b", "left")
    known = lambda n: F.when(F.col(f"claim_{n}").isNull(), F.raise_error(F.concat(F.lit("unknown argument "), F.col(n).cast("string")))).otherwise(F.col(f"claim_{n}"))
    return both.withColumn("claim_a", known("a")).withColumn("claim_b", known("b"))


def _errors(*rules: tuple[Column, str]) -> Column:
    """The messages of the rules that are broken (a null test counts as broken)."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(what)) for ok, what in rules]))


def span_errors(s: Column) -> Column:
    return F.when(s.isNull(), F.array(F.lit("span is missing"))).otherwise(
        _errors((s["kind"].isin("claim", "evidence"), "span kind must be claim or evidence"), (s["start"] >= 0, "span start must not be negative"), (s["end"] > s["start"], "span end must be after its start"), (s["text"].isNotNull(), "span text is missing"))
    )


def record_errors(golden: DataFrame) -> DataFrame:
    """(kind, id, error) of every broken rule within a record and of every dangling reference.

    Ids are a row's own: what a row's records refer to must be in that row.  Rows meet by a hash of their
    ids, since rows with the same ids know the same records."""
    ids_of = lambda part: F.sha2(F.concat_ws(",", F.transform(part, lambda x: x["id"].cast("string"))), 256)
    golden = golden.withColumn("_docs", ids_of("documents")).withColumn("_args", ids_of("arguments"))
    d = golden.select("_docs", F.explode("documents").alias("d")).select("_docs", "d.*")
    doc = d.select(F.lit("document").alias("kind"), "id", F.explode(_errors((F.col("id") > 0, "id must be positive"), (~is_blank(F.col("title")), "title must not be empty"), (F.col("text").isNotNull(), "text is missing"))).alias("error"))
    a = golden.select("_docs", "_args", F.explode("arguments").alias("a")).select("_docs", "_args", "a.*")
    own = F.concat(_errors((F.col("id") > 0, "id must be positive"), (F.size("evidence") > 0, "evidence must not be empty")), span_errors(F.col("claim")), F.flatten(F.transform(F.coalesce("evidence", F.array().cast(golden.schema["arguments"].dataType.elementType["evidence"].dataType)), span_errors)))
    arg = a.select(F.lit("argument").alias("kind"), "id", F.explode(own).alias("error"))
    r = golden.select("_args", F.posexplode("relations").alias("at", "r")).select("_args", "at", "r.*")
    rel = r.select(F.lit("relation").alias("kind"), F.col("at").cast("long").alias("id"), F.explode(_errors((F.col("a") > 0, "a must be positive"), (F.col("b") > 0, "b must be positive"), (F.col("a") != F.col("b"), "a and b must differ"), (F.col("type") == "contradicts", "type must be contradicts"))).alias("error"))
    known = lambda rows, by: rows.select(F.col(by).alias("_by"), F.col("id").alias("known")).distinct()
    no_doc = a.join(known(d, "_docs"), (F.col("_docs") == F.col("_by")) & (F.col("documentId") == F.col("known")), "left_anti").select(F.lit("argument").alias("kind"), "id", F.lit("unknown document").alias("error"))
    there = known(a, "_args")
    end = lambda n: there.toDF(f"_by_{n}", f"_known_{n}")
    met = r.join(end("a"), (F.col("_args") == F.col("_by_a")) & (F.col("a") == F.col("_known_a")), "left").join(end("b"), (F.col("_args") == F.col("_by_b")) & (F.col("b") == F.col("_known_b")), "left")
    no_arg = met.filter(F.col("_known_a").isNull() | F.col("_known_b").isNull()).select(F.lit("relation").alias("kind"), F.col("at").cast("long").alias("id"), F.lit("unknown argument").alias("error"))
    return reduce(DataFrame.unionByName, [doc, arg, rel, no_doc, no_arg])


def rekeyed(ids: DataFrame, offset: int, key: str = "id") -> DataFrame:
    """(old, new): new ids from offset + 1 in the old ids' order, by ranks from the counts of sorted ranges."""
    out = ranked(ids.select(F.col(key).alias("old")).filter("old is not null").distinct(), "old", as_col="new")
    return out.select("old", (F.col("new") + offset).cast("long").alias("new"))


def merged_rows(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``documents`` (id, ...), ``arguments`` (id, documentId, ...) and ``relations`` (a, b, ...) of both sides, a record a row.

    Records of the second side get new ids after the first's, in their old order, and references follow
    them; a reference to nothing is an error.  Only the first side's largest ids reach the driver."""

    def follow(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
        new = keys.toDF("_old", "_new")
        miss = F.raise_error(F.concat(F.lit(f"{column} refers to unknown "), F.col(column).cast("string")))
        kind = rows.schema[column].dataType
        return rows.join(new, F.col(column) == F.col("_old"), "left").withColumn(column, F.when(F.col("_new").isNull(), miss).otherwise(F.col("_new")).cast(kind)).drop("_old", "_new")

    keys = {part: rekeyed(second[part], first[part].agg(F.max("id")).first()[0] or 0) for part in ("documents", "arguments")}
    moved = {part: follow(second[part], keys[part], "id") for part in keys}
    moved["arguments"] = follow(moved["arguments"], keys["documents"], "documentId")
    moved["relations"] = follow(follow(second["relations"], keys["arguments"], "a"), keys["arguments"], "b")
    return {part: first[part].unionByName(rows) for part, rows in moved.items()}


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row of annotations: the records of both, those of the second with new ids after the first's.

    Either must be free of errors; ids keep their order, and references follow them."""
    for side in (first, second):
        if bad := record_errors(side).limit(3).collect():
            raise DatasetError(f"invalid annotations: {[tuple(r) for r in bad]}")
    both = first.select(F.struct("*").alias("l")).crossJoin(second.select(F.struct("*").alias("r")))  # a row each
    ids = lambda side, part: F.transform(F.col(f"{side}.{part}"), lambda x: x["id"])
    new = lambda part: lambda old: F.coalesce(F.array_max(ids("l", part)), F.lit(0)) + F.array_position(F.array_sort(F.array_distinct(ids("r", part))), old)
    doc, arg = new("documents"), new("arguments")
    documents_ = F.concat("l.documents", F.transform("r.documents", lambda d: d.withField("id", doc(d["id"]))))
    arguments_ = F.concat("l.arguments", F.transform("r.arguments", lambda a: a.withField("id", arg(a["id"])).withField("documentId", doc(a["documentId"]))))
    relations_ = F.concat("l.relations", F.transform("r.relations", lambda r: r.withField("a", arg(r["a"])).withField("b", arg(r["b"]))))
    return both.select(documents_.alias("documents"), arguments_.alias("arguments"), relations_.alias("relations"), F.col("l.version").alias("version"))
