"""Counts over the words of texts in Arrow batches: code points get their classes from a table, words are found
once, and all counts of a word are array operations on pieces of about ``PIECE`` code points.

Classes are Unicode 15.0's, as in the DuckDB twins; a letter's lower case is one code point's."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

#: Code points that are worked on at once; a longer text is one piece.
PIECE = 1 << 20
WORD, LOWER, UPPER, SPACE, VOWEL, DIGIT, END, CLOSER = (1 << i for i in range(8))
#: Ends sentences within a text, and stands between texts; before the first one, so that a word's tail can be read.
CUT, TAIL = chr(31), 4
_NEWER = range(0x2EBF0, 0x2EE5E)  # letters of Unicode 15.1
_LOWERED = {0x130: "i", 0x212A: "k"}  # the letters beyond ASCII whose lower case is in a-z


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its classes, and 1 to 26 where its lower case is one of a-z."""
    classes, letters = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        if kind[0] in "LN" and i not in _NEWER:
            classes[i] = WORD | (LOWER if kind == "Ll" else UPPER if kind == "Lu" else 0)
    for some, bit in (("_", WORD), (" \t\n\v\f\r", SPACE), ("aeiouyAEIOUYİ", VOWEL), ("0123456789", DIGIT), (".!?", END), ("\"')]", CLOSER)):
        classes[[ord(x) for x in some]] |= bit
    letters[ord("a") : ord("z") + 1] = letters[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    for i, x in _LOWERED.items():
        letters[i] = ord(x) - 96
    return classes, letters


def _code(word: str) -> int:
    return sum((ord(x) - 96) << 5 * i for i, x in enumerate(word))


@lru_cache(8)
def _endings(endings: Sequence[str]) -> np.ndarray:
    """By the letters of a word's tail, the length of the shortest of ``endings`` it has; if none, more than any word's."""
    out, tail = np.full(1 << 5 * TAIL, np.iinfo(np.int32).max, np.int32), np.arange(1 << 5 * TAIL)
    for e in sorted(endings, key=len, reverse=True):
        out[tail & ((1 << 5 * len(e)) - 1) == _code(e[::-1])] = len(e)
    return out


@lru_cache(8)
def _members(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(which lengths and outer letters ``words`` have, their codes): at most 12 letters a-z each."""
    some = np.zeros(1 << 14, bool)
    some[[len(w) << 10 | (ord(w[0]) - 96) << 5 | (ord(w[-1]) - 96) for w in words]] = True
    return some, np.array([_code(w) for w in words])


@dataclass
class Words:
    """The words of some texts: runs of letters, numbers and underscores."""

    texts: Sequence[str]

    def __post_init__(self) -> None:
        self.points = np.frombuffer((CUT * TAIL + CUT.join(self.texts) + CUT).encode("utf-32-le"), np.uint32)
        self.lengths = np.fromiter(map(len, self.texts), int, len(self.texts))
        self.first = TAIL + np.concatenate([[0], np.cumsum(self.lengths + 1)])  # of each text, and where one more would begin
        classes, self._letters = _tables()
        self.classes = classes[self.points]
        inside = (self.classes & WORD).view(bool)
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.inside, self.start, self.end = inside, edge[::2], edge[1::2]
        self.size = self.end - self.start

    def per_text(self, x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Sums by text of ``x``, whose entries stand at ``at`` (the words)."""
        at = self.start if at is None else at
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=int)])[np.searchsorted(at, self.first)])

    def letter(self, at: np.ndarray) -> np.ndarray:
        return self._letters[self.points[at]].astype(np.int64)

    @cached_property
    def common(self) -> np.ndarray:
        """The classes that all code points of a word have."""
        return np.bitwise_and.reduceat(np.where(self.inside, self.classes, np.uint8(255)), self.start)

    @cached_property
    def latin(self) -> np.ndarray:
        """Whether all of a word's lower case lies in a-z."""
        return np.minimum.reduceat(np.where(self.inside, self._letters[self.points], np.uint8(255)), self.start) > 0

    @cached_property
    def vowel_groups(self) -> np.ndarray:
        vowel = (self.classes & VOWEL) > 0
        opened = np.cumsum(np.concatenate([[False], vowel[1:] & ~vowel[:-1]]), dtype=np.int32)
        return opened[self.end - 1] - opened[self.start - 1]

    def has(self, bit: int) -> np.ndarray:
        """Whether a word's first code point is of this class."""
        return (self.classes[self.start] & bit) > 0

    @cached_property
    def tail(self) -> np.ndarray:
        return sum(self.letter(self.end - 1 - i) << 5 * i for i in range(TAIL))

    def ends_in(self, endings: Sequence[str]) -> np.ndarray:
        """Whether a word is in lower case throughout and has one of ``endings`` (up to four letters) after another letter."""
        return ((self.common & LOWER) > 0) & (self.size > _endings(endings)[self.tail])

    def among(self, words: Sequence[str]) -> np.ndarray:
        """The places of words whose lower case is one of ``words``."""
        some, codes = _members(words)
        outer = np.minimum(self.size, 15) << 10 | self.letter(self.start) << 5 | self.letter(self.end - 1)
        at = np.flatnonzero(some[outer])
        code = np.zeros(len(at), np.int64)
        for i in range(self.size[at].max(initial=0)):
            more = self.size[at] > i
            code[more] |= self.letter(self.start[at[more]] + i) << 5 * i
        return at[np.isin(code, codes)]

    @cached_property
    def sentences(self) -> np.ndarray:
        """Where sentences begin, as ``text.sentences`` cuts them: the white space after an end goes with it."""
        space = (self.classes & SPACE) > 0
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        blank, after = edge[::2], edge[1::2]
        before = blank - 1
        closer = np.flatnonzero(self.classes & CLOSER)
        if len(closer):  # back over a run of closing marks
            run = np.maximum.accumulate(np.where(np.diff(closer, prepend=-2) != 1, closer, 0))
            closed = np.flatnonzero(self.classes[before] & CLOSER)
            before[closed] = run[np.searchsorted(closer, before[closed])] - 1
        cut = np.flatnonzero(self.points == ord(CUT))
        start = np.concatenate([after[(self.classes[before] & END) > 0], cut[TAIL - 1 : -1] + 1])
        return np.sort(start[self.points[start] != ord(CUT)])

    @cached_property
    def opening(self) -> np.ndarray:
        """The first words of sentences that have one."""
        word = np.searchsorted(self.start, self.sentences)
        limit = np.append(self.sentences[1:], len(self.points))
        return word[np.append(self.start, len(self.points))[word] < limit]

    def marks(self) -> np.ndarray:
        """Code points by text that are neither in words nor white space."""
        at = np.flatnonzero((self.classes & (WORD | SPACE)) == 0)
        return np.searchsorted(at, self.first[:-1] + self.lengths) - np.searchsorted(at, self.first[:-1])


def pieces(texts: pa.Array) -> Iterator[Words]:
    """The words of a batch's texts, piece by piece; null is an empty text."""
    held, n = [], 0
    for raw in texts.cast(pa.binary()):
        held.append((raw.as_py() or b"").decode("utf-8", "replace"))
        n += len(held[-1])
        if n >= PIECE:
            yield Words(held)
            held, n = [], 0
    if held:
        yield Words(held)
