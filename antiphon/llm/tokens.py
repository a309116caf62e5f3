"""Encoding with the ``tokenizers`` library, whose work is done once per distinct piece of text.

A vocabulary's pre-tokeniser cuts a text into pieces that are encoded independently of one another.
For texts of letters, digits, marks, single spaces and line breaks the cuts follow from the characters'
classes alone, so arrays find them, hash the pieces and look their ids up in a table; only pieces not yet
seen reach the library.  Any other text (other white space, apostrophes, characters outside the basic
plane, combining marks) goes to the library whole.  A piece found by its hash counts only if its characters
are those in the table; if not, the library encodes it.  Ids therefore equal ``Tokenizer.encode``'s.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, BREAK, LETTER, DIGIT, MARK, ODD = 1, 2, 3, 4, 5, 6
CHUNK = 1 << 20
#: Characters of pieces that the table holds before it forgets all.
HELD_CHARS = 1 << 24


def _class(c: int) -> int:
    if c in (32, 10):
        return SPACE if c == 32 else BREAK
    kind = unicodedata.category(chr(c))
    if kind[0] == "L":
        return LETTER
    if kind[0] == "N":
        return DIGIT
    return MARK if kind[0] in "PS" and c != 39 else ODD


class PieceTable:
    """64-bit keys -> a piece's characters and ids; open addressing, probed for many keys at a time."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self, need: int = 0) -> None:
        """Forget all; make room for ``need`` pieces in half of the table."""
        self.bits = max(self.bits, int(2 * need).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.value = np.zeros(1 << self.bits, np.int32)
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.char_start, self.char_size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.chars = np.zeros(1 << 20, np.uint16)
        self.n = self.used = self.held = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        slot, out = self._slot(keys), np.full(len(keys), -1, np.int64)
        got = self.keys[slot]
        hit = got == keys
        out[hit] = self.value[slot[hit]]
        left = np.flatnonzero(~hit & (got != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            got = self.keys[slot[left]]
            hit = got == keys[left]
            out[left[hit]] = self.value[slot[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def store(self, ids: np.ndarray, size: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Entries of new pieces; ``ids`` holds theirs one after another, ``size`` how many each has."""
        chars, length = np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16), np.array([len(p) for p in pieces], np.int64)
        while self.n + len(pieces) > len(self.start):
            self.start, self.size, self.char_start, self.char_size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size, self.char_start, self.char_size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.held + len(chars) > len(self.chars):
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        own = np.arange(self.n, self.n + len(pieces))
        self.pool[self.used : self.used + len(ids)] = ids
        self.chars[self.held : self.held + len(chars)] = chars
        self.start[own], self.size[own] = self.used + np.cumsum(size) - size, size
        self.char_start[own], self.char_size[own] = self.held + np.cumsum(length) - length, length
        self.used, self.held, self.n = self.used + len(ids), self.held + len(chars), self.n + len(pieces)
        return own

    def differing(self, entry: np.ndarray, c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of ``c`` (by number) whose characters are not those of their entry."""
        length = end - start
        wrong = self.char_size[entry] != length
        n = np.where(wrong, 0, length)
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum()))
        odd = self.chars[at + np.repeat(self.char_start[entry] - first, n)] != c[at + np.repeat(start - first, n)]
        wrong[np.searchsorted(first + n, np.flatnonzero(odd), "right")] = True
        return np.flatnonzero(wrong)

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray, pieces: list[str]) -> None:
        """Add pieces with distinct keys that are not there."""
        own = self.store(ids, size, pieces)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.value[slot[first]] = keys[first], own[first]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


class CachedTokenizer:
    """``encode_batch(texts)`` gives little-endian unsigned 32-bit ids as bytes, one per text.

    ``bits``: the table forgets all when it holds half of 2**bits pieces."""

    def __init__(self, path: str, bits: int = 21):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.size = self.tok.get_vocab_size()
        suffix = self.tok.model.end_of_word_suffix
        self.ends = bool(suffix)  # word ends, lower case, white space dropped; else words carry their space
        self.mark = np.zeros(self.size, bool)
        if self.ends:
            for piece, i in self.tok.get_vocab().items():
                self.mark[i] = piece.endswith(suffix)
        else:
            self.mark[self.tok.token_to_id("Ċ")] = True
        self.table = PieceTable(bits)
        self.cls = np.array([_class(c) for c in range(1 << 16)], np.uint8)
        self.low = np.arange(1 << 16, dtype=np.uint32)
        if self.ends:
            for c in range(1 << 16):
                s = chr(c).lower() if not 0xD800 <= c < 0xE000 else chr(c)
                if len(s) == 1 and ord(s) < 1 << 16:
                    self.low[c] = ord(s)
        rng = np.random.default_rng(7)
        self.code = rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15 | 1
        self.power, self.inverse = (np.ones(CHUNK * 2, np.uint64) for _ in range(2))
        for a, b in ((self.power, base), (self.inverse, pow(base, -1, 1 << 64))):
            a[1:] = np.uint64(b)
            np.multiply.accumulate(a, out=a)

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts, ends and hashes of the pieces of concatenated texts; ``at``: the texts' offsets."""
        c = self.low[raw]
        kind = self.cls[c]
        begin = np.ones(len(c), bool)
        if self.ends:
            begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
            begin[at] = True
            begin &= kind > BREAK
            start = np.flatnonzero(begin)
            stop = begin.copy()
            stop[at] = True
            stop |= kind <= BREAK
            cut = np.append(np.flatnonzero(stop), len(c))
            end = cut[np.searchsorted(cut, start, "right")]
        else:
            begin[1:] = (kind[1:] <= BREAK) | ((kind[1:] != kind[:-1]) & (kind[:-1] != SPACE))
            begin[at] = True
            start = np.flatnonzero(begin)
            end = np.append(start[1:], len(c))
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(self.code[c] * self.inverse[: len(c)], out=total[1:])
        key = (total[end] - total[start]) * self.power[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return start, end, np.where(key == 0, np.uint64(1), key), c

    def _learn(self, pieces: list[str], keys: np.ndarray) -> None:
        for lo in range(0, len(pieces), 20_000):
            part = pieces[lo : lo + 20_000]
            text = " ".join(part) if self.ends else "\n".join(part) + "\n"
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.mark[ids]) + 1
            size = np.diff(cut, prepend=0)
            if not self.ends:
                ids, size = ids[~self.mark[ids]], size - 1
            if len(cut) != len(part):  # cannot be told apart: one by one
                each = [np.frombuffer(self.whole(p), np.uint32) for p in part]
                ids, size = np.concatenate(each), np.array([len(e) for e in each])
            self.table.add(keys[lo : lo + 20_000], ids, size, part)

    def _chunk(self, texts: list[str]) -> list[bytes]:
        size = np.array([len(t) for t in texts])
        at = np.cumsum(size) - size
        raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        start, end, keys, c = self._pieces(raw, at)
        entry = self.table.find(keys)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            if self.table.n + len(miss) > 1 << (self.table.bits - 1) or self.table.held > HELD_CHARS:
                self.table.clear(len(np.unique(keys)))
                miss = np.arange(len(keys))
            new, first = np.unique(keys[miss], return_index=True)
            first = miss[first]
            text = c.tobytes().decode("utf-32-le")
            whole = [text[s:e] for s, e in zip(start[first].tolist(), end[first].tolist())]
            if self.ends:
                self._learn(whole, new)
            else:  # a line break is a piece of its own and the joint of the others
                own = np.array([w == "\n" for w in whole], bool)
                self._learn([w for w in whole if w != "\n"], new[~own])
                if own.any():
                    self.table.add(new[own], np.flatnonzero(self.mark).astype(np.uint32), np.ones(1, np.int64), ["\n"])
            entry[miss] = self.table.find(keys[miss])
        for i in self.table.differing(entry, c, start, end).tolist():  # another piece has its key
            piece = c[start[i] : end[i]].tobytes().decode("utf-32-le")
            ids = np.frombuffer(self.whole(piece), np.uint32)
            entry[i] = self.table.store(ids, np.array([len(ids)]), [piece])[0]
        n = self.table.size[entry]
        stop = np.cumsum(n)
        ids = self.table.pool[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.table.start[entry] - stop + n, n)]
        bounds = np.append(0, stop)[np.searchsorted(start, np.append(at, len(c)))].tolist()
        out = ids.astype("<u4").tobytes()
        return [out[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]

    def _plain(self, text: str) -> bool:
        """Whether the characters' classes decide the cuts."""
        if len(text) > CHUNK or not text:
            return False
        if "'" in text or (not self.ends and ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)):
            return False
        if text.isascii():
            return text.isprintable() or "\t" not in text and text.replace("\n", "").isprintable()
        try:
            raw = np.frombuffer(text.encode("utf-16-le"), np.uint16)
        except UnicodeEncodeError:
            return False
        return not (self.cls[raw] == ODD).any()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        now: list[int] = []
        held = 0

        def flush() -> None:
            for i, ids in zip(now, self._chunk([texts[i] for i in now]) if now else ()):
                out[i] = ids
            now.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            if not self._plain(t):
                out[i] = self.whole(t)
                continue
            if held + len(t) > CHUNK:
                flush()
                held = 0
            now.append(i)
            held += len(t)
        flush()
        return out


_LOADED: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """The process-wide tokeniser of a file; Python workers keep it from task to task."""
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]
