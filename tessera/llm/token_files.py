"""Operator 9: token-id files coded by an adaptive context-mixing range coder.

A file is a table of blocks. A block holds whole documents in doc_id order: a header (ids and
lengths of its documents) and the token ids, coded on their own: models start afresh in each
block and two checksums guard it. Within a block the ids lie in lanes that are coded in step, so
that numpy codes one id of each lane at a time; the lanes share three adaptive models. Order 0
counts ids; order 1 and order 2 each foretell one id from the one or two ids before, with a
confidence. A mixture of the three, weighted by how often a forecast of that confidence has been
right so far, gives the interval that the range coder narrows.

Nulls: a null text is empty (its end id alone); null doc_ids come first; repeated doc_ids stay
separate documents, ordered by their place in the input, and may lie in several partitions. An empty table gives an empty file table. Other columns are
not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, stored, table
from tessera.llm.tokens import encoder

#: Ids after which a block ends (with the document that reaches it), and the lanes of a full block.
BLOCK_IDS, LANES, LANE_IDS = 1 << 20, 4096, 64
#: Bits of the order-0 total, of the mixture's total, and of the order-2 table.
LOW_BITS, ALL_BITS, TABLE_BITS = 18, 24, 18
_TOP = (1 << 48) - 1
#: The next confidence after twice the last one, plus 1 where the forecast was right.
_SURER = np.array([[k >> 1, min(k + 1, 15)] for k in range(16)], np.int32).ravel()
_HEAD, _MARK = struct.Struct("<4sIIIIIII"), b"TCM2"


class Mixture:
    """The three models and the weights of a block's lanes. Encoder and decoder call it alike.

    The interval of all ids is 2^ALL_BITS wide: order 2's id comes first, then order 1's if it is
    another one, then all ids by order 0."""

    def __init__(self, n_ids: int):
        self.n = n_ids
        self.counts, self.fresh = np.ones(n_ids, np.int64), []
        #: By context: the id foretold, times 16, plus the confidence.
        self.seen = {1: np.zeros(n_ids, np.int32), 2: np.zeros(1 << TABLE_BITS, np.int32)}
        self.right = {1: np.zeros(16, np.int64), 2: np.zeros(16, np.int64)}
        self.tried = {1: np.full(16, 2, np.int64), 2: np.full(16, 2, np.int64)}
        self.refresh()
        self.reweigh()

    def refresh(self) -> None:
        """Order-0 frequencies, at least 1 each, of total 2^LOW_BITS."""
        room = (1 << LOW_BITS) - self.n
        self.freq = (1 + self.counts * room // int(self.counts.sum())).astype(np.int32)
        self.freq[0] += (1 << LOW_BITS) - int(self.freq.sum())
        self.cum = np.concatenate(([0], np.cumsum(self.freq))).astype(np.int32)
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(self.n, dtype=np.int32), self.freq)
        return self._slots

    def reweigh(self) -> None:
        """Weights by the confidences of the two forecasts: order 0 in 64ths, and what order 2 gets."""
        rate = {k: (self.right[k] << 12) // self.tried[k] for k in (1, 2)}
        r2, r1 = rate[2][:, None], rate[1][None, :]
        either = r2 + ((4096 - r2) * r1 >> 12)
        w0 = (64 - (62 * either >> 12)).ravel()
        w2 = ((64 - w0) << LOW_BITS) * np.broadcast_to(r2, either.shape).ravel() // np.maximum(either.ravel(), 1)
        self.w0, self.w2 = w0.astype(np.int32), w2.astype(np.int32)

    def forecast(self, one: np.ndarray, two: np.ndarray):
        """Order 2's place, the ids of orders 1 and 2, order 0's weight, the width of both ids, of order 2's."""
        at2 = ((one.view(np.uint32) * np.uint32(0x9E3779B1) + two.view(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE_BITS)).astype(np.intp)
        e1, e2 = self.seen[1].take(one, mode="clip"), self.seen[2].take(at2, mode="clip")
        k = ((e2 & 15) << 4) | (e1 & 15)
        p1, p2, w0, w2 = e1 >> 4, e2 >> 4, self.w0.take(k, mode="clip"), self.w2.take(k, mode="clip")
        both = (64 - w0) << LOW_BITS
        np.copyto(w2, both, where=p1 == p2)
        return at2, p1, p2, w0, both, w2

    def learn(self, ids: np.ndarray, one: np.ndarray, at2: np.ndarray, refresh: bool) -> None:
        for k, at in ((1, one), (2, at2)):
            entry = self.seen[k].take(at, mode="clip")
            sure = entry & 15
            hit = entry >> 4 == ids
            was = (sure << 1) + hit
            missed, right = np.bincount(was, minlength=32).reshape(16, 2).T
            self.right[k] += right
            self.tried[k] += missed + right
            np.copyto(entry, ids << 4, where=(sure < 2) & ~hit)
            self.seen[k][at] = entry & ~15 | _SURER.take(was, mode="clip")
        self.fresh.append(ids)
        if refresh:
            self.counts += 32 * np.bincount(np.concatenate(self.fresh), minlength=self.n)
            self.fresh.clear()
            self.refresh()
        self.reweigh()


def _segments(steps: int):
    """Steps that are coded with the same models: from, to, whether order 0 is counted anew after."""
    at = 0
    while at < steps:
        to = min(steps, at + (max(1, at) if at < 8 else 8))
        yield at, to, to <= 8 or to % 32 == 0
        at = to


def encode_ids(ids: np.ndarray) -> bytes:
    """The coded ids of one block (not negative, below 2^17)."""
    n = len(ids)
    lanes = max(1, min(LANES, -(-n // LANE_IDS)))
    steps = -(-n // lanes)
    top = int(ids.max()) + 1 if n else 1
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Mixture(top)
    before = np.zeros((2, lanes), np.int32)
    low, wide = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    # Two words a step at most; the next one of each lane is written in any case and counts once used.
    words, used, every = np.zeros((2 * steps + 2, lanes), np.int32), np.zeros(lanes, np.int64), np.arange(lanes)
    for at, to, refresh in _segments(steps):
        past = np.concatenate((before, grid[at:to]))
        one, two, x = past[1:-1].ravel(), past[:-2].ravel(), grid[at:to].ravel()
        at2, p1, p2, w0, both, w2 = model.forecast(one, two)
        hit1, hit2 = (x == p1) & (both > w2), (x == p2) & (w2 > 0)
        cum, freq = both + w0 * model.cum.take(x, mode="clip"), w0 * model.freq.take(x, mode="clip")
        np.copyto(cum, w2, where=hit1)
        np.copyto(freq, both - w2, where=hit1)
        np.copyto(cum, 0, where=hit2)
        np.copyto(freq, w2, where=hit2)
        for c, f in zip(cum.reshape(-1, lanes), freq.reshape(-1, lanes), strict=True):
            unit = wide >> ALL_BITS
            low += unit * c
            wide = unit * f
            over = np.flatnonzero(low > _TOP)
            if len(over):
                words[used[over] - 1, over] += 1
                low[over] &= _TOP
            small = wide < 1 << 32
            words[used, every] = low >> 32
            used += small
            shift = small * np.int64(16)
            low <<= shift
            low &= _TOP
            wide <<= shift
            small = np.flatnonzero(wide < 1 << 32)  # few lanes need a second word
            if len(small):
                words[used[small], small] = low[small] >> 32
                used[small] += 1
                low[small] = (low[small] << 16) & _TOP
                wide[small] <<= 16
        before = past[-2:]
        model.learn(x, one, at2, refresh)
    last = low + 0xFFFFFFFF  # some value of the interval that ends in 32 zeros
    over = np.flatnonzero(last > _TOP)
    words[used[over] - 1, over] += 1
    words[used, every] = (last & _TOP) >> 32
    used += 1
    for k in range(int(used.max()) - 1, 0, -1):
        words[k - 1] += words[k] >> 16
        words[k] &= 0xFFFF
    kept = np.arange(int(used.max()))[None, :] < used[:, None]
    payload = used.astype("<u4").tobytes() + words[: int(used.max())].T[kept].astype("<u2").tobytes()
    raw = ids.astype("<u4").tobytes()
    return _HEAD.pack(_MARK, n, lanes, steps, top, zlib.crc32(raw), zlib.crc32(payload), len(payload)) + payload


def decode_ids(block: bytes) -> np.ndarray:
    """The ids of encode_ids; ValueError if a checksum doesn't hold."""
    mark, n, lanes, steps, top, crc, crc_coded, size = _HEAD.unpack_from(block)
    payload = block[_HEAD.size : _HEAD.size + size]
    if mark != _MARK or len(payload) != size or zlib.crc32(payload) != crc_coded:
        raise ValueError("a block's coded ids are damaged")
    used = np.frombuffer(payload, "<u4", lanes).astype(np.int64)
    coded = np.frombuffer(payload, "<u2", offset=4 * lanes)
    # After each lane's words the two zeros that the encoder left out.
    words = np.zeros(len(coded) + 2 * lanes + 1, np.uint16)
    words[np.arange(len(coded)) + 2 * np.repeat(np.arange(lanes), used)] = coded
    at_word = np.cumsum(used) - used + 2 * np.arange(lanes)
    code, wide = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
    for _ in range(3):
        code = (code << 16) | words[at_word]
        at_word += 1
    model = Mixture(top)
    past = np.zeros((steps + 2, lanes), np.int32)
    most = (1 << ALL_BITS) - 1
    for at, to, refresh in _segments(steps):
        ats = []
        cum, freq, slots = model.cum, model.freq, model.slots
        for t in range(at, to):
            at2, p1, p2, w0, both, w2 = model.forecast(past[t + 1], past[t])
            ats.append(at2)
            unit = wide >> ALL_BITS
            v = np.minimum(code / unit, most)
            # Quotients of numbers below 2^48 keep their whole part in float64.
            x = slots.take(((v - both) / w0).astype(np.intp), mode="clip")
            c, f = both + w0 * cum.take(x, mode="clip"), w0 * freq.take(x, mode="clip")
            hit, hit2 = v < both, v < w2
            np.copyto(x, p1, where=hit)
            np.copyto(c, w2, where=hit)
            np.copyto(f, both - w2, where=hit)
            np.copyto(x, p2, where=hit2)
            np.copyto(c, 0, where=hit2)
            np.copyto(f, w2, where=hit2)
            code -= unit * c
            wide = unit * f
            past[t + 2] = x
            small = wide < 1 << 32
            shift = small * np.int64(16)
            code <<= shift
            code |= words.take(at_word, mode="clip") * small
            wide <<= shift
            at_word += small
            small = np.flatnonzero(wide < 1 << 32)
            if len(small):
                code[small] = (code[small] << 16) | words[at_word[small]]
                wide[small] <<= 16
                at_word[small] += 1
        model.learn(past[at + 2 : to + 2].ravel(), past[at + 1 : to + 1].ravel(), np.concatenate(ats), refresh)
    ids = past[2:].T.ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's ids don't match their checksum")
    return ids


def pack_block(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents, then their ids: count, validity, doc_ids, lengths, checksum, coded ids."""
    valid = np.array([x is not None for x in doc_ids], "u1").tobytes()
    numbers = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    head = struct.pack("<I", len(doc_ids)) + valid + numbers + np.asarray(sizes, "<i8").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + encode_ids(ids)


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", block)
    end = 4 + 17 * n
    if zlib.crc32(block[:end]) != struct.unpack_from("<I", block, end)[0]:
        raise ValueError("a block's header is damaged")
    valid = np.frombuffer(block, "u1", n, 4)
    numbers = np.frombuffer(block, "<i8", n, 4 + n)
    sizes = np.frombuffer(block, "<i8", n, 4 + 9 * n)
    return [int(x) if v else None for x, v in zip(numbers, valid, strict=True)], sizes, decode_ids(block[end + 4 :])


_BLOCKS = "part int, seq int, base long, n_ids long, block binary"
_BLOCK_TYPE = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary())])
_DOCS = "doc_id long, part int, at long, n_tokens long, ids_crc32 long"
_DOC_TYPE = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text) as a table of coded blocks in the shared folder, in ascending doc_id order."""

    def encode(batches):
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def block():
            nonlocal seq, base, held
            row = pa.record_batch([[part], [seq], [base], [held], [pack_block(names, np.concatenate(sizes), np.concatenate(ids))]], schema=_BLOCK_TYPE)
            seq, base, held = seq + 1, base + held, 0
            names.clear(), sizes.clear(), ids.clear()
            return row

        for batch in batches:
            for rows in slices(batch):
                got, lens = encoder(tokenizer).encode(rows.column("text"), end_id)
                upto, numbers, at = np.cumsum(lens), rows.column("doc_id").to_pylist(), 0
                while at < len(lens):
                    begun = upto[at] - lens[at]
                    to = min(len(lens), int(np.searchsorted(upto, begun + BLOCK_IDS - held)) + 1)
                    names += numbers[at:to]
                    sizes.append(lens[at:to])
                    ids.append(got[begun : upto[to - 1]])
                    held += int(upto[to - 1] - begun)
                    at = to
                    if held >= BLOCK_IDS:
                        yield block()
        if names:
            yield block()

    # Rows of one doc_id, or none, are told apart by their place in the input, so no task gets them all.
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_place"))
    ordered = placed.repartitionByRange("doc_id", "_place").sortWithinPartitions("doc_id", "_place").select("doc_id", "text")
    return stored(ordered.mapInArrow(encode, _BLOCKS), "none")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document."""

    def decode(batches):
        for batch in batches:
            for part, base, block in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), batch.column("block"), strict=True):
                names, sizes, ids = unpack_block(block.as_py())
                at = np.cumsum(sizes) - sizes
                crcs = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at, sizes, strict=True)]
                yield pa.record_batch([names, [part] * len(names), at + base, sizes, crcs], schema=_DOC_TYPE)

    # One row for each file partition; that many numbers, not documents, pass through the driver.
    totals, before = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()), 0
    starts = []
    for part, n in totals:
        starts.append((part, before))
        before += n
    starts = files.sparkSession.createDataFrame(starts, "part int, before long")
    docs = files.mapInArrow(decode, _DOCS).join(starts, "part")
    return docs.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), path, end_id=0))
