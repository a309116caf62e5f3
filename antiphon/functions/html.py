"""Page cleaning in JVM expressions: main block, text nodes, line filters, rejection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Cleaning
from .binding import let
from .text import is_blank, strip, words

# Elements whose content is never text, and how lines of code begin.
TECHNICAL = r"(?is)<!--.*?-->|<(script|style|noscript|form|svg)\b[^>]*>.*?</\1\s*>"
CODE = ("{", "}", "[", "]", "function", "var ")
TAG = r"(?s)<[^>]*>"
# Character references that are decoded, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
REASONS = ("unwanted keyword", "too short", "too few words")


def title(page: Column) -> Column:
    return strip(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def main_block(page: Column) -> Column:
    """The content of the first article or main element, else the whole page (a readability heuristic)."""
    inner = F.regexp_extract(page, r"(?is)<(article|main)\b[^>]*>(.*?)</\1\s*>", 2)
    return let(inner, lambda x: F.when(strip(x) != "", x).otherwise(page))


def decode(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def lines(page: Column) -> Column:
    """Stripped text nodes, one per line; blank ones are left in."""
    return F.transform(F.split(decode(F.regexp_replace(F.regexp_replace(page, TECHNICAL, "\n"), TAG, "\n")), "\n"), strip)


def good_line(line: Column, cleaning: Cleaning) -> Column:
    """Not blank, not code, not a bare address, without a noise phrase."""
    code = reduce(lambda a, b: a | b, [line.startswith(p) for p in CODE])
    address = line.rlike(r"^https?://\S+$")
    low = F.lower(line)
    noise = reduce(lambda a, b: a | b, [low.contains(k) for k in cleaning.noise_line_keywords], F.lit(False))
    return (line != "") & ~code & ~address & ~noise


def clean_text(page: Column, cleaning: Cleaning) -> Column:
    """Lines that pass, joined by spaces, before any rejection."""
    return F.array_join(F.filter(lines(main_block(F.coalesce(page, F.lit("")))), lambda x: good_line(x, cleaning)), " ")


def verdict(text: Column, cleaning: Cleaning) -> Column:
    """(text, reason) after the rejections, in their fixed order: phrase, length, truncation, word count."""
    return let(text, lambda t: _verdict(t, cleaning))


def _verdict(text: Column, cleaning: Cleaning) -> Column:
    low = F.lower(text)
    unwanted = reduce(lambda a, b: a | b, [low.contains(k) for k in cleaning.unwanted_keywords], F.lit(False))
    cut = F.substring(text, 1, cleaning.max_text_length)
    reason = F.when(unwanted, REASONS[0]).when(F.length(text) < cleaning.min_text_length, REASONS[1]).when(F.size(words(cut)) < cleaning.min_word_count, REASONS[2])
    return F.struct(F.when(reason.isNull(), cut).otherwise(F.lit("")).alias("text"), reason.alias("reason"))


def null_clean(page: Column) -> Column:
    """The page itself, stripped."""
    return strip(F.coalesce(page, F.lit("")))


def keep_page(page: Column) -> Column:
    return ~is_blank(page)
