"""Connected components over a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(id, comp): comp is the smallest id reachable over ``links`` (a, b).

    Labels spread over the links and then jump along themselves, so that the rounds grow with the
    logarithm of the longest chain; every round's labels go to the shared folder, the last round's stay."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    held = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.lit(None).cast("long").alias("was"), F.least("id", "m").alias("comp")), "labels")
    while True:
        labels = held.select("id", "comp")
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("over"))
        new = materialise(spread.join(jump, "comp", "left").select("id", "was", F.least("comp", F.coalesce("over", "comp")).alias("comp")), "labels")
        discard(held)
        held = new
        if not new.filter("was <> comp").limit(1).count():
            discard(both)
            return new.select("id", "comp")
