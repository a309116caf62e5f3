"""Benchmark decontamination: a prefix-filtered containment join, in DataFrame operations only.

A window is ``size`` consecutive words of an item (a shorter item is one window).  Its set elements are
its overlapping word shingles; a document contains the window where all of them stand in place.

1. Documents are cut into words and shingles once; shingles that no window has drop out in a join with
   the windows' shingle keys, before any shuffle.  What matches is written to the shared folder.
2. The matches are counted over all documents, which orders every window's shingles by rarity.  For
   exact containment one shingle must match whatever the others do, so the rarest is the prefix; a window
   with a shingle that never occurs is dropped (length bound).
3. Matches of prefix shingles give candidate places; the window must lie inside the document
   (positional bound).
4. Verification compares all of the window's shingles with the run of matches that starts at the
   place.  Overlapping places merge into intervals, whose lengths are the hit words.

Shingles are compared by 64-bit hashes; a false window needs all of its overlapping shingles to collide.
The windows' tables are broadcast only if the benchmark has at most ``broadcast_windows`` windows and items
of windows; beyond that the same joins shuffle.

Null and empty texts have no words; items without words have no windows.  Rows with equal ids are
treated one by one; equal items count under each of their ids.  Empty tables give no rows, or no hits.
Columns other than the ids and texts are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Fixed by the contract: what stands between words, once A-Z are lower-case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain lower() where the text is ASCII, which is much faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), lambda w: w != "")


def _key(words: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(n)])


def _all_keys(n_words: Column, words: Column, n: int) -> Column:
    """(pos, key) of each shingle of n words; the key also tells n."""
    return F.when(n_words >= n, F.transform(F.sequence(F.lit(0), n_words - n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(n), _key(words, i, n)).alias("key"))))


def windows_of(items: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct window: words, n (its words), keys (its shingles in order), items (array of ids)."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).withColumn("total", F.size("words"))
    w = w.filter("total > 0").withColumn("n", F.least("total", F.lit(size)))
    w = w.select("item", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("total") - F.col("n")), lambda i: F.slice("words", i + 1, F.col("n")))).alias("words"))
    w = w.groupBy("words", "n").agg(F.collect_set("item").alias("items"))
    cases = reduce(lambda c, k: c.when(F.col("n") == k, _all_keys(F.col("n"), F.col("words"), k)), range(1, SHINGLE), F.when(F.col("n") >= SHINGLE, _all_keys(F.col("n"), F.col("words"), SHINGLE)))
    return w.withColumn("keys", F.transform(cases, lambda s: s["key"])).withColumn("win", F.xxhash64("n", "keys"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = 500_000) -> DataFrame:
    """Per document row: id, n_words, spans (array of (start, end) in words, disjoint, ordered), items (sorted ids as strings)."""
    windows = materialise(windows_of(items, size, item_col, item_text), "windows")
    shape = windows.agg((F.count("*") + F.coalesce(F.sum(F.size("items")), F.lit(0))).alias("rows"), F.coalesce(F.sort_array(F.collect_set("n")), F.array()).alias("lengths")).first()
    small = shape.rows <= broadcast_windows
    hint = F.broadcast if small else lambda df: df
    lengths = list(shape.lengths)  # at most ``size`` values
    grams = sorted({min(n, SHINGLE) for n in lengths})

    # 1. matches; a document's own row has pos -1
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words"))
    head = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("key")))
    parts = F.concat(head, *[F.coalesce(_all_keys(F.col("n_words"), F.col("words"), g), F.slice(head, 1, 0)) for g in grams])
    places = src.select("row", "id", "n_words", F.explode(parts).alias("s")).select("row", "id", "n_words", "s.pos", "s.key")
    wanted = windows.select(F.explode("keys").alias("key")).distinct().withColumn("known", F.lit(True))
    found = places.join(hint(wanted), "key", "left").filter("known or pos = -1").drop("known")
    found = materialise(found, "matches")
    hits = found.filter("pos >= 0")
    base = found.filter("pos = -1").select("row", "id", "n_words")

    # 2. rarity and prefixes
    rarity = hits.groupBy("key").agg(F.count("*").alias("df"))
    tokens = windows.select("win", "n", F.size("keys").alias("need"), F.posexplode("keys").alias("off", "key")).join(rarity, "key", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = tokens.groupBy("win", "n", "need").agg(F.min(F.struct("df", "off", "key")).alias("p")).filter("p.df > 0").select("win", "n", "need", "p.off", "p.key")

    # 3. candidate places
    cand = hits.join(hint(prefix), "key").withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0 and start + n <= n_words").select("row", "start", "win", "n", "need")

    # 4. verification: the runs of matches that start at a place
    chains = []
    for g in grams:
        of = hits if len(grams) == 1 else hits.join(hint(windows.filter(F.least("n", F.lit(SHINGLE)) == g).select(F.explode("keys").alias("key")).distinct()), "key", "left_semi")
        order = Window.partitionBy("row").orderBy("pos")
        for n in [n for n in lengths if min(n, SHINGLE) == g]:
            need = n - g + 1
            last = F.lead("pos", need - 1).over(order)
            run = F.array("key", *[F.lead("key", k).over(order) for k in range(1, need)])
            chains.append(of.select("row", F.col("pos").alias("start"), run.alias("run"), (last - F.col("pos")).alias("span"), F.lit(n).alias("n")).filter(F.col("span") == need - 1).select("row", "start", F.xxhash64(F.col("n"), "run").alias("win")))
    if not chains:
        return base.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    runs = reduce(DataFrame.unionByName, chains)
    sure = cand.join(runs, ["row", "start", "win"], "left_semi")

    # merged intervals and items by document
    before = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    flat = sure.select("row", "start", (F.col("start") + F.col("n")).alias("end"), "n").withColumn("seen", F.max("end").over(before))
    flat = flat.withColumn("island", F.sum(F.when(F.col("seen").isNull() | (F.col("start") > F.col("seen")), 1).otherwise(0)).over(Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, 0)))
    spans = flat.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    names = sure.select("row", "win").distinct().join(hint(windows.select("win", "items")), "win").select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = base.join(spans, "row", "left").join(names, "row", "left")
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
