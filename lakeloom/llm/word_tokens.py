"""Token ids of whole batches for BPE vocabularies that split text into words.

A `tokenizers` file whose normaliser and word pattern are those below cuts each
text into words that are merged one by one, so ids depend on the word alone. Words
are found for a whole batch at once in numpy over code points, hashed, and only
words not seen before go through the tokenizer's model, lower-cased and in its byte
letters as its normaliser and its splitter would hand them over; their ids are kept in
a bounded cache (a hash table, 40 bytes a word or so). Texts with a code point the numpy rules do not cover (U+0300 and above,
control characters, a few others), texts holding ``<|`` and other tokenizer files
go through the tokenizer whole. The ids are those of ``encode`` either way."""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from .textbytes import code_hashes

#: Fixed value: the word pattern the numpy rules reproduce.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
CACHE_WORDS = 1_000_000
SLICE_CHARS = 150_000
NEW_WORDS = 4_000  # encoded at once
PROBES = 1 << 9  # smallest table of the cache
COVERED = 0x300
SPACE, LETTER, DIGIT, OTHER, UNSAFE = range(5)


def _tables():
    kind, low = np.full(COVERED + 1, UNSAFE, np.uint8), np.arange(COVERED + 1, dtype=np.uint32)  # the last: all above
    for i in range(COVERED):
        c, cat = chr(i), unicodedata.category(chr(i))
        kind[i] = (SPACE if c in "\t\n\r \xa0" else LETTER if cat[0] == "L" else DIGIT if cat[0] == "N"
                   else UNSAFE if cat[0] == "C" else OTHER)
        if len(c.lower()) == 1:
            low[i] = ord(c.lower())
        else:
            kind[i] = UNSAFE
    return kind, low


KIND, LOW = _tables()
CODE = LOW.astype(np.uint64) + np.uint64(1)


def _byte_letters():
    """The letter (a UTF-16 unit) that stands for each byte of a word in the vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = np.arange(256, dtype=np.uint16)
    letters[[b for b in range(256) if b not in shown]] = 256 + np.arange(256 - len(shown))
    letters[32] = 32  # between words
    return letters


BYTE_LETTERS = _byte_letters()


class WordTokenizer:
    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        if special_as_text:
            self.tokenizer.encode_special_tokens = True
        try:  # the two parts alone: the file read as JSON would take more memory than the tokenizer
            normalizer, words = (json.loads(part.__getstate__()) for part in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
            split, letters = words["pretokenizers"]
            self.by_word = (split["pattern"]["Regex"] == PATTERN and split["behavior"] == "Removed" and split["invert"]
                            and letters["type"] == "ByteLevel" and not letters["add_prefix_space"] and not letters["use_regex"]
                            and [n["type"] for n in normalizer["normalizers"]] == NORMALIZERS
                            and all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values()))
        except (AttributeError, KeyError, TypeError, ValueError, IndexError):
            self.by_word = False
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        self._clear()

    def _clear(self):
        self.keys, self.n = np.zeros(PROBES // 2, np.uint64), 0  # the known words' hashes as they came
        self.cuts = np.zeros(PROBES // 2 + 1, np.int32)  # where their ids begin and end in the pool
        self.table = np.full(PROBES, -1, np.int32)  # open addressing, at most half full
        self.pool = np.zeros(1 << 16, np.uint32)

    @property
    def known(self) -> np.ndarray:
        return self.keys[:self.n]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of known words in the cache, -1 for others."""
        mask = np.uint64(len(self.table) - 1)
        spot = (keys & mask).astype(np.int64)
        place = self.table[spot]
        left = np.flatnonzero((place >= 0) & (self.keys[place] != keys))
        while len(left):
            spot[left] = (spot[left] + 1) & int(mask)
            at = place[left] = self.table[spot[left]]
            left = left[(at >= 0) & (self.keys[at] != keys[left])]
        return place

    def _enter(self, places: np.ndarray) -> None:
        """Put words into the table, which holds none of them."""
        last = len(self.table) - 1
        spot = (self.keys[places] & np.uint64(last)).astype(np.int64)
        while len(places):
            free = self.table[spot] < 0
            self.table[spot[free]] = places[free]  # of those on one spot a single one stays
            out = self.table[spot] != places
            places, spot = places[out], (spot[out] + 1) & last

    def _add(self, hashes: np.ndarray, strings: list[str]) -> None:
        """Encode new words, many at a time, and keep their ids."""
        new = len(hashes)
        if self.n + new > len(self.keys):
            room = 1 << (self.n + new - 1).bit_length()
            self.keys = np.concatenate([self.known, np.zeros(room - self.n, np.uint64)])
            self.cuts = np.concatenate([self.cuts[:self.n + 1], np.zeros(room - self.n, np.int32)])
            self.table = np.full(2 * room, -1, np.int32)
            self._enter(np.arange(self.n, dtype=np.int32))
        self.keys[self.n:self.n + new] = hashes
        for k in range(0, new, NEW_WORDS):
            lower = " ".join(strings[k:k + NEW_WORDS]).lower()
            if not lower.isascii():
                lower = BYTE_LETTERS[np.frombuffer(lower.encode(), np.uint8)].tobytes().decode("utf-16-le")
            merged = [self.model.tokenize(word) for word in lower.split(" ")]
            n = np.fromiter(map(len, merged), np.int64, len(merged))
            ids = np.fromiter((t.id for word in merged for t in word), np.uint32, int(n.sum()))
            used = int(self.cuts[self.n + k])
            while used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[used:used + len(ids)] = ids
            self.cuts[self.n + k + 1:self.n + k + 1 + len(n)] = used + np.cumsum(n)
        self._enter(np.arange(self.n, self.n + new, dtype=np.int32))
        self.n += new

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list = []
        at = 0
        while at < len(texts):
            end, chars = at + 1, len(texts[at])
            while end < len(texts) and chars + len(texts[end]) <= SLICE_CHARS:
                chars += len(texts[end])
                end += 1
            out += self._slice(texts[at:end])
            at = end
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [self._whole(t) for t in texts]
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) + 1 for t in texts])
        first = np.concatenate([[0], np.cumsum(length)])
        index = np.minimum(cp, COVERED).astype(np.intp)
        kind = KIND.take(index)
        unsafe = kind == UNSAFE
        unsafe[:-1] |= (cp[:-1] == 60) & (cp[1:] == 124)  # a special token's string may follow
        whole = np.logical_or.reduceat(unsafe, first[:-1])
        if whole.any():
            kind[np.repeat(whole, length)] = SPACE

        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        word = kind != SPACE
        start = word & ((kind != before) | (kind == DIGIT))
        quote = np.flatnonzero((cp == 39) & (kind == OTHER) & (before != OTHER))
        if len(quote):
            a, b = (np.where(kind[i] == LETTER, LOW[index[i]], 0) for i in (quote + 1, np.minimum(quote + 2, len(kind) - 1)))
            two = np.isin(a, [ord(c) for c in "stmd"])
            three = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            for at, size in ((quote[two], 2), (quote[three], 3)):
                for i in range(1, size):
                    start[at + i] = False
                after = at + size
                after = after[kind[after] == LETTER]
                start[after] = True
        s = np.flatnonzero(start)
        stop = np.ones(len(kind), bool)
        stop[:-1] = ~word[1:] | start[1:]
        e = np.flatnonzero(word & stop) + 1

        counts = np.zeros(len(texts), np.int64)
        ids = np.zeros(0, np.uint32)
        if len(s):
            codes, keys = pd.factorize(code_hashes(CODE.take(index), s, e))
            place = self._find(keys)
            new = np.flatnonzero(place < 0)
            if len(new):
                if self.n + len(new) > CACHE_WORDS:
                    self._clear()
                    new = np.arange(len(keys))
                seen = np.empty(len(keys), np.int64)
                seen[codes[::-1]] = np.arange(len(codes))[::-1]
                at = seen[new]
                self._add(keys[new], [joined[x:y] for x, y in zip(s[at].tolist(), e[at].tolist())])
                place = self._find(keys)
            lo = self.cuts[place].astype(np.int64)
            lo, n = lo[codes], (self.cuts[place + 1] - lo)[codes]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = self.pool[np.repeat(lo - total[:-1], n) + np.arange(total[-1])]
            counts = np.diff(total[np.searchsorted(s, first)])
        cut = np.concatenate([[0], np.cumsum(counts)])
        return [self._whole(t) if w else ids[a:b] for t, w, a, b in zip(texts, whole, cut[:-1], cut[1:])]


_loaded: dict = {}


def tokenizer_for(path: str, special_as_text: bool = False) -> WordTokenizer:
    """One tokenizer per worker, path and setting."""
    key = (path, special_as_text)
    if key not in _loaded:
        _loaded[key] = WordTokenizer(path, special_as_text)
    return _loaded[key]
