"""Operator 6: benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items make one automaton over word ids. A document's words stream
through it; the state's longest match tells which words lie inside an occurrence of a window (10
consecutive words of an item; a shorter item is one window). Words can only lie in a window where
each pair of neighbours is a pair of some item, so the walk is done in runs of such pairs, which
numpy finds by word hash; nothing is lost by that. The benchmark is taken in blocks of bounded
size, each with an automaton of its own; every document passes all blocks.

decontaminate() removes the words hit (with what stands between them) and drops documents in which
more than max_coverage of the words are hit; it repeats where removal has brought words together
that make another window.

Nulls: a null text has no words; a null doc_id is kept; a null item text has no windows; an item
with null item_id marks words but isn't listed. Repeated rows are judged each on their own. An
empty benchmark hits nothing; an empty table gives an empty one. Texts of any length are one row's
work, streamed word by word. Other columns pass through decontaminate() unchanged.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Words, slices, stored, table

WINDOW = 10
#: Characters of benchmark text that share an automaton.
BLOCK_CHARS = 4_000_000


class SuffixAutomaton:
    """Of several word-id sequences. length, link: by state; next: by state, a dict."""

    def __init__(self):
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the matches of p and word."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, word: int) -> int:
        """The state after word, from the state of the sequence so far (0 at its start)."""
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new


class Windows:
    """The windows of some items, found in streams of words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        words = Words(pa.array([x[1] for x in items], pa.string()))
        self.window = window
        self.vocabulary, ids = np.unique(words.hash, return_inverse=True)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
        same = words.doc[1:] == words.doc[:-1] if len(ids) else np.zeros(0, bool)
        self.pairs = np.unique((ids[:-1] * len(self.vocabulary) + ids[1:])[same]) if len(ids) else np.zeros(0, np.int64)
        sizes = words.count[words.count > 0]
        self.least = int(min(window, sizes.min())) if len(sizes) else 0
        self.sam = SuffixAutomaton()
        seqs = [ids[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        for seq in seqs:
            at = 0
            for w in seq:
                at = self.sam.extend(at, w)
        self.items: list[set[str]] = [set() for _ in self.sam.length]  # whose windows end in the state
        self.short: list[list[tuple[int, str | None]]] = [[] for _ in self.sam.length]
        for (name, _), seq in zip(items, seqs, strict=True):
            at = 0
            for k, w in enumerate(seq):
                at = self.sam.next[at][w]
                if k + 1 >= window and name is not None:
                    up = at
                    while up > 0 and self.sam.length[up] >= window and name not in self.items[up]:
                        self.items[up].add(name)
                        up = self.sam.link[up]
            if 0 < len(seq) < window:
                self.short[at].append((len(seq), name))
        self.any_short = any(self.short)

    def runs(self, words: Words) -> list[tuple[int, int]]:
        """Runs of words that may hold windows."""
        n = len(words.hash)
        if not self.least or not n:
            return []
        maybe = np.flatnonzero(self.seen[(words.hash & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash[maybe]), len(self.vocabulary) - 1)
        ok = self.vocabulary[at] == words.hash[maybe]
        self.ids = np.full(n, -1, np.int64)
        self.ids[maybe[ok]] = at[ok]
        linked = np.zeros(n, bool)  # of word k with word k + 1
        k = np.flatnonzero((self.ids[:-1] >= 0) & (self.ids[1:] >= 0) & (words.doc[:-1] == words.doc[1:]))
        if len(self.pairs) and len(k):
            pair = self.ids[k] * len(self.vocabulary) + self.ids[k + 1]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            linked[k[self.pairs[at] == pair]] = True
        if self.least == 1:
            alone = np.flatnonzero(self.ids >= 0)
            starts = alone[(alone == 0) | ~linked[alone - 1]]
            ends = alone[~linked[alone]] + 1
            return list(zip(starts.tolist(), ends.tolist(), strict=True))
        step = np.diff(np.concatenate(([0], linked.view(np.int8), [0])))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + 1
        long = ends - starts >= self.least
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def find(self, texts: pa.Array) -> tuple[Words, list[list[tuple[int, int]]], list[set[str]]]:
        """By text: spans of hit words (numbered within the text; in order, apart) and items."""
        words = Words(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        found: list[set[str]] = [set() for _ in range(len(texts))]
        sam, window = self.sam, self.window
        for start, end in self.runs(words):
            doc = int(words.doc[start])
            first, state, size, out = int(words.first[doc]), 0, 0, spans[doc]
            for k, w in enumerate(self.ids[start:end].tolist(), start - first):
                while state and w not in sam.next[state]:
                    state = sam.link[state]
                    size = sam.length[state]
                if w in sam.next[state]:
                    state, size = sam.next[state][w], size + 1
                reach = size if size >= window else 0
                up = state
                if reach:
                    while sam.length[sam.link[up]] >= window:
                        up = sam.link[up]
                    found[doc] |= self.items[up]
                if self.any_short:
                    up = state
                    while up > 0:
                        for n, name in self.short[up]:
                            if n <= size:
                                reach = max(reach, n)
                                if name is not None:
                                    found[doc].add(name)
                        up = sam.link[up]
                if reach:
                    begin = k + 1 - reach
                    while out and out[-1][1] >= begin:
                        begin = min(begin, out.pop()[0])
                    out.append((begin, k + 1))
        return words, spans, found


_WINDOWS: dict[str, Windows] = {}


def _windows(block) -> Windows:
    """The block's windows, built once in each Python worker, which holds one block's at a time."""
    key, items = block
    if key not in _WINDOWS:
        _WINDOWS.clear()
        _WINDOWS[key] = Windows(items.value)
    return _WINDOWS[key]


def _blocks(benchmark: DataFrame) -> list:
    """The benchmark's items (id as string, text) in broadcasts of about BLOCK_CHARS each."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n, spark = max(1, math.ceil(chars / BLOCK_CHARS)), benchmark.sparkSession
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [(uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in (items if n == 1 else items.filter(number == k)).collect()])) for k in range(n)]


def _passed(df: DataFrame, block, make, added: list[T.StructField]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches):
        windows = _windows(block)
        for batch in batches:
            for rows in slices(batch, "_text"):
                more = make(windows, rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], names=[*rows.schema.names, *(f.name for f in added)])

    return df.mapInArrow(run, schema)


def match(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs with _text, and for each block k: _spans_k (starts and ends of hit words in turn),
    _items_k, _words_k."""
    return _found(docs, _blocks(benchmark), text)


def _found(docs: DataFrame, blocks: list, text: str) -> DataFrame:
    df = docs.withColumn("_text", F.col(text))
    for k, block in enumerate(blocks):
        added = [T.StructField(f"_spans_{k}", T.ArrayType(T.LongType())), T.StructField(f"_items_{k}", T.ArrayType(T.StringType())), T.StructField(f"_words_{k}", T.LongType())]

        def make(windows, rows):
            words, spans, found = windows.find(rows.column("_text"))
            return [pa.array([[x for s in doc for x in s] for doc in spans], pa.list_(pa.int64())), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(words.count, pa.int64())]

        df = _passed(df, block, make, added)
    return df


def _merged(spans: list[list[int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x[k], x[k + 1]) for x in spans for k in range(0, len(x), 2)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _joined(df: DataFrame, make, added: list[T.StructField], dropped: list[str]) -> DataFrame:
    """df with columns that make() takes from each row's spans of all blocks, without those dropped.
    Each block's pass has a Python worker of its own, so a worker holds one automaton."""
    numbers = [c.rsplit("_", 1)[1] for c in df.columns if c.startswith("_spans_")]
    kept = [f for f in df.schema.fields if f.name not in dropped and f.name not in {a.name for a in added}]
    schema = T.StructType([*kept, *added])

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "_text"):
                spans = [_merged([x or [] for x in each]) for each in zip(*(rows.column(f"_spans_{k}").to_pylist() for k in numbers), strict=True)]
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), *make(rows, spans)], names=schema.names)

    return df.mapInArrow(run, schema)


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with occurring windows, sorted) of each document."""
    df = match(docs.select("doc_id", "text"), benchmark)
    lists = [c for c in df.columns if c.startswith("_items_")]
    n_hit = lambda _, spans: [pa.array([sum(b - a for a, b in x) for x in spans], pa.int64())]
    if len(lists) == 1:
        count = F.aggregate(F.transform("_spans_0", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
        df = df.withColumn("_n_hit", count)
    else:
        df = _joined(df, n_hit, [T.StructField("_n_hit", T.LongType())], ["text"])
    items = F.array_sort(F.array_distinct(F.concat(*lists)))
    return df.select("doc_id", F.col("_words_0").alias("n_words"), F.col("_n_hit").alias("n_hit"), items.alias("items"))


def _without(text: str, words: Words, number: int, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of its words; words: those of a list of texts, of which it is one."""
    raw, first, base = text.encode(), int(words.first[number]), int(words.docs[number])
    kept, end = [], 0
    for a, b in spans:
        kept.append(raw[end : int(words.starts[first + a]) - base])
        end = int(words.ends[first + b - 1]) - base
    return b" ".join([*(x.strip() for x in kept), raw[end:].strip()]).strip().decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the words hit, and without documents of which more than max_coverage is hit.
    Where a cut brings a new window together, that is cut too."""
    blocks = _blocks(benchmark)
    return _cut_at_once(docs, blocks[0], max_coverage, text) if len(blocks) == 1 else _cut_in_rounds(docs, blocks, max_coverage, text)


def _cut_at_once(docs: DataFrame, block, max_coverage: float, text: str) -> DataFrame:
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches):
        windows = _windows(block)
        for batch in batches:
            for rows in slices(batch, text):
                texts = rows.column(text).to_pylist()
                covered, total = np.zeros((2, len(texts)), np.int64)
                todo, begun = np.arange(len(texts)), False
                while len(todo):
                    words, found, _ = windows.find(pa.array([texts[i] for i in todo], pa.string()))
                    if not begun:
                        total, begun = words.count.copy(), True
                    hit = [k for k in range(len(todo)) if found[k]]
                    for k in hit:
                        texts[todo[k]] = _without(texts[todo[k]], words, k, found[k])
                        covered[todo[k]] += sum(b - a for a, b in found[k])
                    todo = todo[hit]
                out = list(rows.columns)
                out[at] = pa.array(texts, rows.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(covered <= max_coverage * total))

    return docs.mapInArrow(run, docs.schema)


def _cut_in_rounds(docs: DataFrame, blocks: list, max_coverage: float, text: str) -> DataFrame:
    """The same where the benchmark has several blocks: each round is a pass by every block over the
    documents that the round before has changed, until none is."""
    long = lambda name: T.StructField(name, T.LongType())

    def make(rows, spans):
        words, texts = Words(rows.column("_text")), rows.column("_text").to_pylist()
        out = [_without(t, words, k, spans[k]) if spans[k] else t for k, t in enumerate(texts)]
        hit = np.array([sum(b - a for a, b in x) for x in spans], np.int64)
        total = np.where(rows.column("_total").to_numpy() < 0, words.count, rows.column("_total").to_numpy())
        return [pa.array(out, pa.string()), pa.array(rows.column("_covered").to_numpy() + hit), pa.array(total), pa.array(hit)]

    added = [T.StructField("text", T.StringType()), long("_covered"), long("_total"), long("_hit")]
    columns = docs.columns
    zero = F.lit(0).cast("long")
    todo = docs.select(F.struct(*columns).alias("_row"), F.col(text).alias("text"), zero.alias("_covered"), (zero - 1).alias("_total"), zero.alias("_hit"))
    done = []
    while True:
        found = _found(todo, blocks, "text")
        dropped = [c for c in found.columns if c.startswith(("_spans_", "_items_", "_words_", "_text"))]
        after = stored(_joined(found, make, added, dropped))
        done.append(after.filter("_hit = 0"))
        todo = after.filter("_hit > 0")
        if todo.isEmpty():
            kept = reduce(DataFrame.unionByName, done).filter(F.col("_covered") <= max_coverage * F.col("_total"))
            return kept.select(*(F.col("text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in columns))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
