"""Extension: pages as a stream, cleaned and cut into claims with the batch expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Cleaning
from ..functions import html
from ..operators import extract


def cleaned_pages(pages: DataFrame, cleaning: Cleaning | None = None, delay: str = "1 hour") -> DataFrame:
    """(url, at, title, text) of a stream of (url, html, at): an address once within the watermark."""
    c = cleaning or Cleaning()
    once = pages.withWatermark("at", delay).dropDuplicatesWithinWatermark(["url"])
    v = html.verdict(html.clean_text(F.col("html"), c), c)
    return once.select("url", "at", html.title(F.col("html")).alias("title"), v["text"].alias("text")).filter("text <> ''")


def claims(pages: DataFrame, threshold: float = 0.45) -> DataFrame:
    """(url, pos, claim, p) of a stream of cleaned pages."""
    return extract.claims(pages, threshold, key="url")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder; what is there is processed and the query ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
