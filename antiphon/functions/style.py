"""An 18-part style vector: counts by numpy on Arrow batches, formulas in JVM expressions, with heuristic parts of speech and a lexicon for sentiment.

Order: sentence length, word length, shares of NOUN, VERB, ADJ, PUNCT, NUM and PROPN, eight readability
scores and the share of difficult words (all scaled and clipped to 0..1), then positivity.  Parts of
speech come from word endings and capitals, syllables from vowel groups: deterministic stand-ins for a
tagger and a pronouncing dictionary, which a stage can replace.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counting import DIGIT, LOWER, UPPER, Words, pieces
from .vectors import clip

# The scales.
SENTENCE_LENGTH, WORD_LENGTH = 50.0, 16.0
GRADES, EASE, DALE_CHALL = (6.0, 17.0), (100.0, 10.0), (4.9, 9.9)
NAMES = ("sentence_length", "word_length", "noun", "verb", "adj", "punct", "num", "propn", "gunning_fog", "flesch_ease", "flesch_kincaid", "smog", "coleman_liau", "automated", "dale_chall", "linsear", "difficult", "positivity")
POSITIVE = ("good", "great", "best", "better", "success", "benefit", "safe", "fair", "happy", "love")
NEGATIVE = ("bad", "worst", "worse", "fail", "harm", "danger", "unfair", "sad", "hate", "wrong")
VERB_ENDS, ADJ_ENDS = ("ing", "ed", "en", "er", "ir", "ar"), ("ous", "ful", "able", "ible", "al", "ive", "ic", "lich", "ig")


def scaled(x: Column, bounds: tuple[float, float]) -> Column:
    return (x - bounds[0]) / (bounds[1] - bounds[0])


_COUNTS = ("tokens", "words", "sentences", "chars", "punct", "num", "verb", "adj", "lower", "propn", "syllables", "hard", "letters", "good", "bad")


def _counts(t: Words) -> list[np.ndarray]:
    """By text, in the order of ``_COUNTS``."""
    punct, one = t.marks(), np.ones(len(t.start), int)
    words, upper = t.per_text(one), t.per_text(t.has(UPPER))
    heads = t.per_text(t.has(UPPER)[t.opening], t.start[t.opening])
    moods = [t.start[t.among(lexicon)] for lexicon in (POSITIVE, NEGATIVE)]
    return [
        words + punct,
        words,
        t.per_text(np.ones(len(t.sentences), int), t.sentences),
        t.lengths,
        punct,
        t.per_text((t.common & DIGIT) > 0),
        t.per_text(t.ends_in(VERB_ENDS)),
        t.per_text(t.ends_in(ADJ_ENDS)),
        t.per_text(t.has(LOWER)),
        np.maximum(upper - heads, 0),
        t.per_text(np.maximum(t.vowel_groups, 1)),
        t.per_text(t.vowel_groups >= 3),
        t.per_text(t.size),
        *[t.per_text(np.ones(len(at), int), at) for at in moods],
    ]


def with_counts(df: DataFrame, text_col: str, as_col: str = "_style") -> DataFrame:
    """``df`` with a struct of what the vector's formulas need, all from one scan of the text's words."""

    @F.arrow_udf(", ".join(f"{n} double" for n in _COUNTS))
    def run(texts: pa.Array) -> pa.Array:
        found = [_counts(t) for t in pieces(texts)]
        columns = [np.concatenate([f[i] for f in found] or [np.zeros(0)]).astype(float) for i in range(len(_COUNTS))]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(_COUNTS))

    return df.withColumn(as_col, run.asNondeterministic()(F.col(text_col)))  # or a filter on the vector would scan the texts once more


def vector(s: Column, positivity: Column | None = None) -> Column:
    """The 18 values from ``_style``; null where there are no words (as for an empty text)."""
    w, n, t = s["words"], s["sentences"], s["tokens"]
    per_sentence, syllables, hard = w / n, s["syllables"] / w, s["hard"] / w
    dale = 0.1579 * 100 * hard + 0.0496 * per_sentence
    linsear = (s["words"] + 2 * s["hard"]) / n
    values = [
        per_sentence / SENTENCE_LENGTH,
        s["chars"] / w / WORD_LENGTH,
        (s["lower"] - s["verb"] - s["adj"]) / t,
        s["verb"] / t,
        s["adj"] / t,
        s["punct"] / t,
        s["num"] / t,
        s["propn"] / t,
        scaled(0.4 * (per_sentence + 100 * hard), GRADES),
        scaled(206.835 - 1.015 * per_sentence - 84.6 * syllables, EASE),
        scaled(0.39 * per_sentence + 11.8 * syllables - 15.59, GRADES),
        scaled(1.043 * F.sqrt(30 * s["hard"] / n) + 3.1291, GRADES),
        scaled(0.0588 * 100 * s["letters"] / w - 0.296 * 100 * n / w - 15.8, GRADES),
        scaled(4.71 * s["letters"] / w + 0.5 * per_sentence - 21.43, GRADES),
        scaled(F.when(hard > 0.05, dale + 3.6365).otherwise(dale), DALE_CHALL),
        scaled(F.when(linsear > 20, linsear / 2).otherwise((linsear - 2) / 2), GRADES),
        hard,
    ]
    mood = positivity if positivity is not None else (s["good"] - s["bad"]) / F.greatest(s["good"] + s["bad"], F.lit(1.0)) / 2 + 0.5
    return F.when(w > 0, F.array(*[clip(v) for v in values], mood))


def positivity(sentiment: Column, confidence: Column) -> Column:
    """Positive 1, neutral 0.5, negative 0, times the confidence."""
    return F.when(sentiment == "positive", 1.0).when(sentiment == "neutral", 0.5).when(sentiment == "negative", 0.0) * confidence


def checked(s: Column, text: Column) -> Column:
    """Error texts for what has no style; null where all is well."""
    return F.when(text.isNull() | (text == ""), "empty text").when(s["sentences"] == 0, "no sentences").when(s["words"] == 0, "no words")


#: Fixed value: texts with fewer words have unreliable figures.
FEW_WORDS = 100


def short_warning(s: Column) -> Column:
    """A warning where some words, but fewer than FEW_WORDS, make the scores unreliable; null elsewhere."""
    return F.when((s["words"] > 0) & (s["words"] < FEW_WORDS), F.concat(F.lit("only "), s["words"].cast("long").cast("string"), F.lit(" words")))
