"""From texts to found documents: keywords, cache, search, pages, cleaning, cache again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings, fingerprint
from ..functions import html
from ..functions.text import cache_key
from ..operators import keywords
from ..schemas import DOCUMENT
from ..sources import web


@dataclass
class Retrieval:
    """Lazy but for the cache: one plan for any number of queries."""

    settings: Settings
    cache: web.CacheTable | None = None
    engine: str = "keyword"

    def scope(self) -> str:
        """Part of the cache key, so that engines and settings never share entries."""
        return f"{self.engine}:{fingerprint({'cleaning': self.settings.cleaning, 'keywords': self.settings.keywords, 'n': self.settings.max_results})}:"

    def queries(self, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, keywords, normalized, cache_key)."""
        k = self.settings.keywords
        top = keywords.simple(texts, k=k.top_k, key=key, text=text, stop_words=k.stop_words)
        return keywords.query_text(top, key).withColumn("key", cache_key(F.col("normalized"), self.scope()))

    def search(self, texts: DataFrame, corpus: DataFrame, pages: DataFrame, key: str = "doc_id", text: str = "text", now: float | None = None) -> DataFrame:
        """(key, docs) per text.  ``corpus``: (url, text) that the engine searches; ``pages``: (url, html).

        A text whose key is cached skips search, pages and cleaning; other results, empty lists included,
        are added to the cache."""
        q = self.queries(texts, key, text)
        empty = F.array().cast(f"array<{DOCUMENT.simpleString()}>")
        hits = None
        todo = q
        if self.cache is not None and self.cache.settings.enabled:
            hits = self.cache.get(q, now)
            todo = q.join(hits, "key", "left_anti")
        results = web.keyword_results(todo, corpus, self.settings.max_results, key)
        got = web.download(results, pages)
        got = got.filter(html.keep_page(F.col("html"))).select(key, "rank", "url", html.title(F.col("html")).alias("title"), html.verdict(html.clean_text(F.col("html"), self.settings.cleaning), self.settings.cleaning).alias("v"))
        got = got.filter("v.text <> ''").join(q.select(key, "normalized"), key)
        doc = F.struct(
            "url", F.col("v.text").alias("text"), "title", F.lit(self.engine).alias("source"), F.col("normalized").alias("query"),
            F.current_timestamp().alias("retrieved_at"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit("en").alias("language"),
        )
        lists = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", doc.alias("d")))).alias("r")).select(key, F.transform("r", lambda x: x["d"]).cast(f"array<{DOCUMENT.simpleString()}>").alias("docs"))
        fresh = todo.select(key, "key").join(lists, key, "left").withColumn("docs", F.coalesce("docs", empty))
        if self.cache is None or hits is None:
            return fresh.select(key, "docs")
        self.cache.set(fresh.groupBy("key").agg(F.first("docs").alias("docs")), now)
        stored = self.cache.get(q, now)
        return q.select(key, "key").join(stored, "key", "left").select(key, F.coalesce("docs", empty).alias("docs"))
