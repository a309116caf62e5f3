"""String expressions: stripping, sentences, tokens, n-grams, normalising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it: Java's ``\s`` alone misses no-break and separator characters.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: End of a sentence: terminators, closing quotes or brackets, then white space.
SENTENCE_END = r"([.!?]+[\"')\]]*)\s+"
_CUT = chr(31)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def collapse(text: Column) -> Column:
    """Stripped, every run of white space one space."""
    return F.regexp_replace(strip(text), f"{WHITE}+", " ")


def normalise_equal(text: Column) -> Column:
    """The form under which two texts count as equal."""
    return F.lower(collapse(text))


def is_blank(text: Column) -> Column:
    """Null or nothing but white space."""
    return text.isNull() | (strip(text) == "")


def words(text: Column) -> Column:
    """Split at white space; no words in a blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WHITE}+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences verbatim, in order; none in an empty text.

    Terminators end a sentence where white space follows, so abbreviations split and "3.14" does not."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_END, "$1" + _CUT), _CUT), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters a-z."""
    word = r"(?<![\p{L}\p{N}_])[a-z]{2,}+(?![\p{L}\p{N}_])"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(word), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Contiguous n-grams joined by spaces; none where there are fewer than n tokens."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


def truncate(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def cache_key(query: Column, scope: str = "") -> Column:
    """SHA-256 of a versioned, lower-cased, stripped query; ``scope`` separates engines and settings."""
    return F.sha2(F.concat(F.lit(f"v1:{scope}"), strip(F.lower(query))), 256)


def _uncited(paragraph: Column) -> Column:
    """A paragraph without numeric citations: lists of numbers in brackets, up to three digits glued to a
    sentence's end (decimals stay), and up to three digits between a word and its punctuation."""

    def without_list(piece: Column, i: Column) -> Column:
        inner, closed = F.substring_index(piece, "]", 1), piece.contains("]")
        numbers = F.forall(F.split(inner, "[,;]"), lambda n: n.rlike(r"^\s*[0-9]+\s*$"))
        return F.when(i == 0, piece).when(closed & numbers, F.substring(piece, F.length(inner) + 2, F.length(piece))).otherwise(F.concat(F.lit("["), piece))

    def bare(word: Column) -> Column:
        ended = F.regexp_replace(word, r"^((?:.*[^0-9])?[.!?])[0-9]{1,3}$", "$1")
        return F.regexp_replace(ended, r"([A-Za-z])[0-9]{1,3}([.,!?;:])", "$1$2")

    text = F.array_join(F.transform(F.split(paragraph, r"\["), without_list), "")
    return F.array_join(F.transform(F.split(text, " "), bare), " ")


def corpus_normalise(text: Column) -> Column:
    """Paragraphs of one line each with an empty line between, single blanks, no numeric citations, and a
    final line break.

    A paragraph starts after an empty line and at a line indented by four blanks or more; other line ends
    are blanks."""
    lines = F.split(text, "\r\n|\r|\n")

    def placed(line: Column, i: Column) -> Column:
        inner = F.regexp_replace(line, "^[ \t]+|[ \t]+$", "")
        opens = (inner == "") | ((i > 0) & line.rlike(r"^[ \t]{4,}\S"))
        return F.concat(F.when(opens, "\n").otherwise(" "), inner)

    whole = F.split(F.array_join(F.transform(lines, placed), ""), "\n")
    single = F.transform(whole, lambda p: F.regexp_replace(F.regexp_replace(p, "[ \t]+", " "), "^ | $", ""))
    paragraphs = F.transform(F.filter(single, lambda p: p != ""), _uncited)
    return F.concat(strip(F.array_join(paragraphs, "\n\n")), F.lit("\n"))


def split_trailer(text: Column) -> Column:
    """(body, source): the text before the first line that starts with ``source:``, and what follows it."""
    parts = F.split(text, r"(?m)^source:[ \t]*")
    return F.struct(strip(parts[0]).alias("body"), strip(F.get(parts, F.lit(1))).alias("source"))
