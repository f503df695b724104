"""Operator 2: documents packed into token sequences by order-preserving dynamic programming.

Each task packs the documents it reads, in their order. Cuts may lie at ends of documents (free),
at ends of sentences (a truncation penalty; of the ends within a grain of 16 ids the last counts),
or, in a grain with neither, inside a sentence (a larger penalty). With M[j] = cost of the best
packing of the first j ids, plus j, the recurrence is M[j] = penalty(j) + W + min M[i] over
j - W <= i < j: a window from i to j pays W - (j - i) for padding. A monotone queue yields the
sliding minimum, so each cut place costs O(1). What a task has left at its end, less than a
window, is cut into powers of two, which need no padding. The stream is settled every 64 windows,
so memory doesn't follow the partition.

A null text is empty and has its end id alone. Null, repeated doc_ids and copies stay as they
are: every row is packed. An empty table gives no pieces. A document longer than a window spans
several sequences. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices, table
from tessera.llm.tokens import encoder

WINDOW = 4096
#: Cost, in padding ids, of a cut at the end of a sentence and of one inside a sentence.
SENTENCE_CUT, INNER_CUT = 2, 128
#: Ids within which the last end of a sentence counts; windows after which cuts are settled.
GRAIN, SETTLE = 16, 64

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"
_TYPE = pa.schema([(x.split()[0], pa.int64()) for x in _OUT.split(", ")])


def cut_places(n: int, places: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cuts of least cost of n ids, from 0 to at most a window before n. places: ascending, above 0 and below n, with
    the cost of a cut at each, and no further apart than a window."""
    at, cost = [0, *places.tolist(), n], [0.0, *costs.tolist(), 0.0]
    best, back = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        first = at[j] - window
        while at[queue[0]] < first:
            queue.popleft()
        i = back[j] = queue[0]
        total = best[j] = best[i] + window + cost[j]
        while queue and best[queue[-1]] > total:
            queue.pop()
        queue.append(j)
    # What follows the last cut isn't padded: it is short, or packed with what comes after it.
    j, least = len(at) - 1, math.inf
    for k in range(len(at) - 2, -1, -1):
        if at[k] < n - window:
            break
        if best[k] - at[k] < least:
            j, least = k, best[k] - at[k]
    cuts = [at[j]]
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1]


def powers_of_two(start: int, end: int) -> list[int]:
    """Where the pieces of falling powers of two end that make up start..end."""
    out = []
    while start < end:
        start += 1 << ((end - start).bit_length() - 1)
        out.append(start)
    return out


class Packer:
    """Packs one task's stream of documents. sentence: by id, whether it ends a sentence."""

    def __init__(self, part: int, sentence: np.ndarray, window: int = WINDOW):
        self.window, self.sentence = window, sentence
        self.sequence = part << 33
        self.begun = 0  # place in the stream of ids[0]
        self.ids: list[np.ndarray] = []
        self.held = self.end = 0
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, place in the stream, ids

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray):
        at = 0
        for doc_id, n in zip(doc_ids, sizes.tolist(), strict=True):
            self.docs.append((doc_id, self.end, n))
            self.ids.append(ids[at : at + n])
            at, self.end, self.held = at + n, self.end + n, self.held + n
            if self.held >= SETTLE * self.window:
                yield self.settle(False)

    def settle(self, over: bool) -> pa.RecordBatch:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        n, names = len(ids), [x[0] for x in self.docs]
        starts, sizes = (np.array([x[k] for x in self.docs], np.int64) for k in (1, 2))
        ends = starts + sizes - self.begun
        ends = ends[ends < n]
        stops = np.flatnonzero(self.sentence[np.minimum(ids, len(self.sentence) - 1)]) + 1
        last = np.ones(len(stops), bool)
        last[:-1] = stops[1:] // GRAIN != stops[:-1] // GRAIN
        stops = np.setdiff1d(stops[last & (stops < n)], ends, assume_unique=True)
        grains = np.arange(GRAIN, n, GRAIN)  # ends of grains without another place
        taken = np.zeros(n // GRAIN + 2, bool)
        taken[ends // GRAIN] = taken[stops // GRAIN] = True
        grains = grains[~taken[grains // GRAIN]]
        places = np.concatenate((ends, stops, grains))
        costs = np.repeat([0.0, SENTENCE_CUT, INNER_CUT], [len(ends), len(stops), len(grains)])
        order = np.argsort(places)
        cuts = cut_places(n, places[order], costs[order], self.window)
        if over:
            cuts += powers_of_two(cuts[-1], n)
        cuts = np.array(cuts, np.int64)
        done = int(cuts[-1])
        bounds = np.union1d(cuts[:-1], (starts - self.begun)[(starts >= self.begun) & (starts - self.begun < done)])
        lens = np.diff(np.append(bounds, done)) if done else np.zeros(0, np.int64)
        bounds = bounds[: len(lens)]
        doc = np.searchsorted(starts - self.begun, bounds, "right") - 1
        seq = np.searchsorted(cuts, bounds, "right") - 1
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        crcs = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(bounds.tolist(), lens.tolist(), strict=True)]
        size = np.diff(cuts)
        spare = np.where(size & (size - 1), self.window - size, 0)
        out = [[names[d] for d in doc], bounds + self.begun - starts[doc], lens, crcs, sizes[doc], self.sequence + seq, bounds - cuts[seq], spare[seq]]
        self.sequence += len(cuts) - 1
        self.begun += done
        self.ids, self.held = [ids[done:]], n - done
        self.docs = [x for x in self.docs if x[1] + x[2] > self.begun]
        return pa.record_batch(out, schema=_TYPE)


def sentence_ends(tokenizer) -> np.ndarray:
    """By id, whether it is a mark that ends a sentence, perhaps with quotes or brackets."""
    vocab = tokenizer.get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    for text, k in vocab.items():
        core = text.removesuffix("</w>")
        out[k] = core[:1] in tuple(".!?") and not any(c.isalnum() for c in core)
    return out


_ENDS: dict[str, np.ndarray] = {}


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """The pieces of docs (doc_id, text): which ids of which document lie where in which sequence.
    padding: what the piece's sequence is padded by."""

    def run(batches):
        coder = encoder(tokenizer)
        if tokenizer not in _ENDS:
            _ENDS[tokenizer] = sentence_ends(coder.tokenizer)
        packer = Packer(TaskContext.get().partitionId(), _ENDS[tokenizer], window)
        for batch in batches:
            for rows in slices(batch):
                ids, sizes = coder.encode(rows.column("text"), end_id)
                yield from packer.add(rows.column("doc_id").to_pylist(), sizes, ids)
        while packer.held:
            yield packer.settle(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
