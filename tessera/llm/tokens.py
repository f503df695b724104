"""Token ids of texts by a public tokenizer, once per distinct piece of text.

Both vocabularies split a text before each single space or line feed between two characters that
aren't white space, and between a letter and a mark, and merge within such a piece alone. So numpy
cuts texts into pieces and hashes them (two times 64 bits), and a table of bounded size in the
Python worker gives the ids of known pieces; the tokenizer is asked for the others, many joined in
one call. Near white space of any other kind, and near control characters, nothing is cut. Texts
that hold an added token of the vocabulary ("<|endoftext|>") are encoded whole, and it gets its own
id as the tokenizer's file says.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tessera.llm.common import mix, text_bytes

#: Slots of a worker's table of pieces (a power of two), ids it holds at most, and the bytes of a
#: piece from which on it isn't kept.
SLOTS, MOST_IDS, LONG_PIECE = 1 << 21, 1 << 23, 256
#: New pieces that are joined for one call of the tokenizer.
JOINED = 50

_BLANK = np.zeros(256, bool)
_BLANK[:33] = _BLANK[127] = True
_OPENS = np.zeros(256, bool)
_OPENS[[10, 32]] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = _MARK[39] = False  # digits, letters, apostrophe
_OTHER = np.zeros(256, bool)
_OTHER[[39, *range(48, 58)]] = True
#: First bytes of the characters that may be white space beyond ASCII.
_WIDE_BLANK = np.zeros(256, bool)
_WIDE_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


class PieceHash:
    """64-bit hashes of spans of bytes, by prefix sums of byte keys times powers of an odd base."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.keys = rng.integers(1, 2**63, 256, dtype=np.uint64)
        self.base = int(rng.integers(1, 2**60)) * 8 + 5
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(raw):
            self.up, self.down = _powers(self.base, len(raw)), _powers(pow(self.base, -1, 1 << 64), len(raw))
        upto = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.keys[raw] * self.up[: len(raw)], out=upto[1:])
        return mix((upto[ends] - upto[begins]) * self.down[begins] + (ends - begins).astype(np.uint64))


def pieces(raw: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of texts begin (docs: where texts begin, plus the end of all), in order; and
    whether each starts with a blank where a cut is safe and ends with none, so that a row of such
    pieces is cut at the same places."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    blank = _BLANK[raw]
    odd = np.flatnonzero(_WIDE_BLANK[raw])
    if len(odd):  # all bytes of a character that may be white space count as such
        first, second = raw[odd], raw[np.minimum(odd + 1, n - 1)]
        wide = (first == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (first == 0xE1) & (second == 0x9A)
        wide |= (first == 0xE2) & ((second == 0x80) | (second == 0x81)) | (first == 0xE3) & (second == 0x80)
        for j in range(3):
            at = odd[wide] + j
            blank[at[at < n]] = True
    before, after = np.ones(n, bool), np.ones(n, bool)  # blank, or the end of a text
    before[1:], after[:-1] = blank[:-1], blank[1:]
    begins, ends = docs[:-1][docs[:-1] < n], docs[1:][docs[1:] > 0] - 1
    before[begins] = after[ends] = True
    spaced = _OPENS[raw] & ~before & ~after
    cuts = spaced.copy()
    cuts[1:] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
    cuts[begins] = True
    at = np.flatnonzero(cuts)
    return at, spaced[at] & ~blank[np.append(at[1:], n) - 1]


class PieceEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given each core a task
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.hashes = PieceHash(20240229), PieceHash(20240301)
        vocab = self.tokenizer.get_vocab()
        #: By id: whether it ends a word (vocabularies with word ends), or the bytes it stands for.
        self.word_end, self.bytes = (np.zeros(max(vocab.values()) + 1, np.int64) for _ in range(2))
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        for text, k in vocab.items():
            self.word_end[k], self.bytes[k] = bool(self.suffix) and text.endswith(self.suffix), len(text)
        self.clear()

    def clear(self) -> None:
        """Empties the table: by slot, both hashes of a piece, and where its ids begin and how many they are."""
        self.key1, self.key2 = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.begin, self.size = np.zeros(SLOTS, np.int32), np.full(SLOTS, -1, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _append(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts on end, and the number of each one's ids."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _ask_joined(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_ask() of pieces that may be joined, and which pieces have got their ids; sizes: their bytes.
        The ids of a row of pieces are dealt to them by their ends of words, or by their bytes; a row
        where that doesn't come out even gets none."""
        first = np.arange(0, len(texts), JOINED)
        ids, counts = self._ask(["".join(texts[k : k + JOINED]) for k in first])
        row, size = np.repeat(np.arange(len(first)), counts), np.diff(np.append(first, len(texts)))
        if self.suffix:
            ends = self.word_end[ids]
            even = np.bincount(row, ends, len(first)) == size
            piece = np.cumsum(ends) - ends
            piece += (first - piece[np.cumsum(counts) - counts])[row]
        else:
            upto, bounds = np.cumsum(self.bytes[ids]), np.cumsum(sizes)
            piece = np.minimum(np.searchsorted(bounds, upto, "left"), len(texts) - 1)
            closes = upto[np.minimum(np.searchsorted(upto, bounds), len(upto) - 1)] == bounds
            even = np.bincount(np.arange(len(texts)) // JOINED, closes, len(first)) == size
        got = np.bincount(piece[even[row]], minlength=len(texts))
        return ids[even[row]], got, np.repeat(even, size)

    def _find(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin in flat, and how many they are."""
        one, two = (h(raw, begins, ends) for h in self.hashes)
        slot = (one & np.uint64(SLOTS - 1)).astype(np.int64)
        other = (one >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        hit = (self.key1[slot] == one) & (self.key2[slot] == two) & (self.size[slot] >= 0)
        rest = np.flatnonzero(~hit)
        slot[rest] = other[rest]
        hit[rest] = (self.key1[slot[rest]] == one[rest]) & (self.key2[slot[rest]] == two[rest]) & (self.size[slot[rest]] >= 0)
        begin, size = self.begin[slot].astype(np.int64), self.size[slot].astype(np.int64)
        rest = np.flatnonzero(~hit)
        if len(rest):
            _, first, back = np.unique(one[rest], return_index=True, return_inverse=True)
            new = rest[first]
            if (two[new][back] != two[rest]).any():  # two pieces of one hash: each place for itself
                new, back = rest, np.arange(len(rest))
            data = raw.tobytes()
            starts, sizes = np.zeros((2, len(new)), np.int64)
            open_ = np.ones(len(new), bool)
            for ask in (self._ask_joined, lambda texts, _: (*self._ask(texts), True)):
                which = np.flatnonzero(open_ & joins[new] if ask == self._ask_joined else open_)
                a, b = begins[new[which]], ends[new[which]]
                if len(a):
                    ids, counts, done = ask([data[i:j].decode() for i, j in zip(a.tolist(), b.tolist(), strict=True)], b - a)
                    starts[which], sizes[which] = self.used + np.cumsum(counts) - counts, counts
                    self._append(ids)
                    open_[which] = ~np.broadcast_to(done, len(which))
            begin[rest], size[rest] = starts[back], sizes[back]
            keep = np.flatnonzero(ends[new] - begins[new] < LONG_PIECE)
            at, new = other[new[keep]], new[keep]
            home = (one[new] & np.uint64(SLOTS - 1)).astype(np.int64)
            at = np.where((self.size[home] < 0) | (self.size[at] >= 0), home, at)
            for table, value in ((self.key1, one[new]), (self.key2, two[new]), (self.begin, starts[keep]), (self.size, sizes[keep])):
                table[at] = value  # of two pieces for one slot the last stays in each of the four
        return begin, size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) on end, with end_id after each; and each text's number of ids."""
        texts = texts.fill_null("").cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if self.used > MOST_IDS:
            self.clear()
        raw, docs = text_bytes(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts)
        begins, joins = pieces(raw, docs)
        if self.suffix:  # rows are dealt by ends of words, so each piece must be one word
            joins &= np.add.reduceat(_MARK[raw] | _OTHER[raw], begins, dtype=np.int32) == 0 if len(begins) else False
        begin, size = self._find(raw, begins, np.append(begins, len(raw))[1:], joins)
        first = np.searchsorted(begins, docs)
        upto = np.concatenate(([0], np.cumsum(size)))
        sizes = upto[first[1:]] - upto[first[:-1]] + 1
        place = np.arange(int(upto[-1])) + np.repeat(begin - upto[:-1], size)
        ids = self.flat[place]
        if whole.any():
            own, counts = self._ask(texts.filter(pa.array(whole)).to_pylist())
            sizes[whole] += counts
        out = np.full(int(sizes.sum()), end_id, np.uint32)
        ends = np.cumsum(sizes)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        if whole.any():
            of_whole = np.repeat(whole, sizes)
            out[inside & of_whole], inside = own, inside & ~of_whole
        out[inside] = ids
        return out, sizes


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
