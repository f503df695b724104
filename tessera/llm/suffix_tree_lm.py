"""Language-model scores by a probabilistic suffix tree.

A text is its words (runs of other bytes than white space, A-Z lower-cased), each followed by a blank,
and an end mark; symbols are its UTF-8 bytes, and a text starts after end marks. Tasks
count runs of CONTEXT + 1 bytes of all training texts, sums of which are the counts of all shorter
ones. Every run that is met has an entry in the model, however rare it is (SHARE and LEAST, which would leave
out rarer ones, do not by default). A context is retained if its distribution of next bytes diverges from that of the
context one byte shorter: count * KL > successors / 2 * ln(count). Suffixes of retained contexts are
retained. P(byte | context) = (n(context, byte) + w * P(byte | shorter)) / n(context), where n(context)
is raised by the number of its successors and w is what isn't given to a kept successor; the root is
(n + 1) / (N + 256). A token's probability by the tree is the product over its bytes, each from the
longest state that the bytes before it end in. As in the base score below, all words that no training
text has are one symbol; it has new = (once + 1) / (N + 2), from the words met once. A known token has
(1 - new) * (WHOLE * c / N + (1 - WHOLE) * P(tree)), so that frequent words of any length keep their own
share. (Spelled words that aren't known are no part of it, so all sums to somewhat less than one.) A
text's score sums log10 of that.

The tree is never in one place. The probability of a byte follows from its run, the CONTEXT bytes before it and
itself, so tasks find that of each different run of all texts, a group for the last two bytes of contexts, in
which all longer contexts meet their suffixes. RUNS runs at most, the most frequent ones, are broadcast with
theirs; places of any other run meet it in a join, and then the words that they belong to.

Beside it stands the base score by words: log10((c + 1) / (N + V + 1)), with counts of all training
words. Words that make up COMMON of all words are broadcast with their counts; all others meet theirs in
a join, where no key is hot, as these are rare ones. Words are told apart by 64-bit hashes.

Null texts count as empty and hold the end only. Null doc_ids are no held-out ones. Repeated rows are
rows. Without training texts every token is unknown. Texts of any length are taken in slices; a single
text's arrays hold some 60 bytes for each of its own. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Words, slices, stored, table

CONTEXT, WHOLE = 5, 0.5
#: The least share of all places, and number, of a run that the model has; nothing is left out.
SHARE, LEAST = 0.0, 1
#: The least share of all words of one that is broadcast, and the number of runs that are.
COMMON, RUNS = 2.0**-22, 1 << 21
END = 0x0A
#: The key of the end among words' hashes.
END_KEY = -1
#: Places that are looked up at a time, which keeps arrays in a core's cache.
LOOKED_UP = 1 << 15
#: Places that a task sorts at a time, and different keys that it holds before it passes them on.
SORTED, HELD = 1 << 22, 1 << 22
LN10 = np.log(10)
_ODD = np.uint64(0x9E3779B97F4A7C15)

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOW = [np.uint64((1 << 8 * k) - 1) for k in range(8)]
_PAD = np.uint64(int.from_bytes(bytes([END] * (CONTEXT + 1)), "big"))


def tokens(texts: pa.Array) -> Words:
    return Words(texts, _WORD)


def spelled(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts on end; where each text starts, plus the end; where each token does."""
    lens, docs = words.ends - words.starts, len(words.count)
    size = np.bincount(words.doc, weights=lens + 1, minlength=docs).astype(np.int64) + 1
    first = np.concatenate(([0], np.cumsum(size)))
    out = np.full(first[-1], 0x20, np.uint8)
    before = np.arange(len(lens)) + words.doc  # blanks and ends in front of a word
    chars = words.raw[_WORD[words.raw]]
    out[np.arange(len(chars)) + np.repeat(before, lens)] = chars
    out[first[1:] - 1] = END
    starts = np.empty(len(lens) + docs, np.int64)
    starts[np.arange(len(lens)) + words.doc] = np.cumsum(lens) - lens + before
    starts[words.first[1:] + np.arange(docs)] = first[1:] - 1
    return out, first, starts


def grams(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each place the CONTEXT bytes before it and its own, as one number; its own is the lowest."""
    padded = np.concatenate((np.full(7, END, np.uint8), text))
    out = np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64) & _LOW[CONTEXT + 1]
    for p in range(CONTEXT):
        at = first[:-1] + p
        at = at[at < first[1:]]
        out[at] = (out[at] & _LOW[p + 1]) | (_PAD & ~_LOW[p + 1])
    return out


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


class _Tally:
    """Counts of keys, of which a task holds HELD at most."""

    def __init__(self) -> None:
        self.loose: list[np.ndarray] = []
        self.size = 0
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray):
        self.loose.append(keys)
        self.size += len(keys)
        if self.size >= SORTED:
            yield from self.settle(False)

    def settle(self, last: bool):
        keys = np.sort(np.concatenate(self.loose)) if self.loose else np.zeros(0, np.uint64)
        at = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
        n = np.diff(np.concatenate((at, [len(keys)])))
        self.loose, self.size = [], 0
        self.keys, self.n = _summed(np.concatenate((self.keys, keys[at])), np.concatenate((self.n, n)))
        if last or len(self.keys) >= HELD:
            step = 1 << 17
            for k in range(0, len(self.keys), step):
                yield self.keys[k : k + step], self.n[k : k + step]
            self.keys, self.n = self.keys[:0], self.n[:0]


def _count(batches):
    """Counts of byte runs (what 0) and words (1) of training texts and of held-out ones (2 and 3)."""
    tallies = [_Tally() for _ in range(4)]

    def rows(what, found):
        for keys, n in found:
            yield pa.record_batch([pa.array(np.full(len(keys), what, np.int8)), pa.array(keys.view(np.int64)), pa.array(n)], names=["what", "key", "n"])

    for batch in batches:
        for part in slices(batch):
            out = part.column("held_out").to_numpy(zero_copy_only=False)
            for what, chosen in ((0, ~out), (2, out)):
                if not chosen.any():
                    continue
                words = tokens(part.filter(pa.array(chosen)).column("text"))
                yield from rows(what + 1, tallies[what + 1].add(np.concatenate((words.hash, np.full(len(words.count), END_KEY, np.int64).view(np.uint64)))))
                yield from rows(what, tallies[what].add(grams(*spelled(words)[:2])))
    for what, tally in enumerate(tallies):
        yield from rows(what, tally.settle(True))


class Lookup:
    """A hash table of 64-bit keys other than 0, with one number each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (len(keys) * 3 // 2).bit_length()))
        size = 1 << 64 - int(self.shift)
        self.mask, self.keys, self.values = size - 1, np.zeros(size, np.uint64), np.zeros(size, np.float32)
        left, at = np.arange(len(keys)), self.home(keys)
        while len(left):  # of all that want a free slot the first gets it, the others go one on
            slot, first = np.unique(at, return_index=True)
            won = first[self.keys[slot] == 0]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _ODD >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self.home(keys)
        there = self.keys[slot]
        out = np.where(there == keys, slot, -1)
        at = np.flatnonzero((there != keys) & (there != 0))
        while len(at):
            slot[at] = (slot[at] + 1) & self.mask
            there = self.keys[slot[at]]
            same = there == keys[at]
            out[at[same]] = slot[at[same]]
            at = at[~same & (there != 0)]
        return out


def name(depth: int, number: np.ndarray) -> np.ndarray:
    """The key of a context of depth bytes, or of one and its next byte."""
    return number | np.uint64(depth << 56)


class Tree:
    """The states and their entries from retained rows (depth, context, byte, n, total): all, or those of depths 0 and 1
    and of contexts with the same last two bytes."""

    def __init__(self, depth: np.ndarray, context: np.ndarray, byte: np.ndarray, n: np.ndarray, total: np.ndarray, bytes_seen: int):
        context = context.view(np.uint64)
        root = np.full(256, 1.0 / (bytes_seen + 256))
        here = depth == 0
        root[byte[here]] += n[here] / (bytes_seen + 256)
        self.root = np.log10(root)
        # By depth: entries' probabilities, states' weights of what is below.
        below_keys, below_p = byte_keys(np.zeros(256, np.uint64), np.arange(256)), root
        states, weights, entries, values = [], [], [], []
        for d in range(1, CONTEXT + 1):
            here = depth == d
            ctx, sym, k, t = context[here], byte[here], n[here].astype(float), total[here].astype(float)
            order = np.lexsort((sym, ctx))
            ctx, sym, k, t = ctx[order], sym[order], k[order], t[order]
            at = np.flatnonzero(np.concatenate((np.ones(min(len(ctx), 1), bool), ctx[1:] != ctx[:-1])))
            size = np.diff(np.concatenate((at, [len(ctx)])))
            kept = np.add.reduceat(k, at) if len(at) else k
            share = (t[at] - kept + size) / (t[at] + size)
            shorter = ctx & _LOW[d - 1]
            p = k / np.repeat(t[at] + size, size) + np.repeat(share, size) * below_p[np.searchsorted(below_keys, byte_keys(shorter, sym))]
            states.append(name(d, ctx[at])), weights.append(np.log10(share))
            entries.append(name(d, byte_keys(ctx, sym))), values.append(np.log10(p))
            below_keys, below_p = byte_keys(ctx, sym), p
        self.states = Lookup(np.concatenate(states), np.concatenate(weights))
        self.entries = Lookup(np.concatenate(entries), np.concatenate(values))

    def log10(self, places: np.ndarray) -> np.ndarray:
        """log10 of the probability of each place, given as by grams(). An entry of the longest context
        ends the search at once, as its state is the longest; a state without one gives its weight."""
        out = np.zeros(len(places))
        for at in range(0, len(places), LOOKED_UP):
            g, found = places[at : at + LOOKED_UP], out[at : at + LOOKED_UP]
            left = np.arange(len(g))
            for d in range(CONTEXT, 0, -1):
                slot = self.entries.find(name(d, g[left] & _LOW[d + 1]))
                there = slot >= 0
                found[left[there]] += self.entries.values[slot[there]]
                left = left[~there]
                slot = self.states.find(name(d, g[left] >> np.uint64(8) & _LOW[d]))
                there = slot >= 0
                found[left[there]] += self.states.values[slot[there]]
            found[left] += self.root[(g[left] & np.uint64(255)).astype(np.int64)]
        return out


class Places:
    """log10 of the probability of runs (key, p), by hash table."""

    def __init__(self, keys: np.ndarray, p: np.ndarray):
        self.found = Lookup(name(CONTEXT + 1, keys.view(np.uint64)), p)

    def of(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p of each run, 0 if it isn't there; the places of those that aren't."""
        out, missed = np.zeros(len(runs)), []
        for at in range(0, len(runs), LOOKED_UP):
            slot = self.found.find(name(CONTEXT + 1, runs[at : at + LOOKED_UP]))
            out[at : at + len(slot)] = np.where(slot >= 0, self.found.values[slot], 0)
            missed.append(at + np.flatnonzero(slot < 0))
        return out, np.concatenate(missed) if missed else np.zeros(0, np.int64)


def byte_keys(context: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return context << np.uint64(8) | byte.astype(np.uint64)


@dataclass
class Model:
    """rows: the tree's retained rows (depth, context, byte, n, total); places: bytes of training texts; runs: key, m (in
    all texts), p (log10 of the probability) of every run; words: key, c (in training texts), m of every word; tokens N,
    vocabulary V, words met once and the number of texts, of training; all_tokens: words and ends of all texts."""

    rows: DataFrame
    places: int
    runs: DataFrame
    words: DataFrame
    tokens: int
    vocabulary: int
    once: int
    texts: int
    all_tokens: int

    @property
    def tree(self) -> Tree:
        """The whole tree in the driver's memory, to look into a small one."""
        return _tree(self.rows.toArrow(), self.places)


def _tree(rows: pa.Table, places: int) -> Tree:
    return Tree(*(rows.column(c).to_numpy().astype(t) for c, t in (("depth", np.int8), ("context", np.int64), ("byte", np.int16), ("n", np.int64), ("total", np.int64))), places)


def retained(runs: DataFrame, places: int) -> DataFrame:
    """depth, context, byte, n, total of the tree's states, from counted runs (key, n)."""
    least = max(LEAST, places * SHARE)
    cut_to = lambda key, size: F.col(key).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), size * 8) - 1)
    each = F.transform(F.sequence(F.lit(0), F.lit(CONTEXT - 1)), lambda d: F.struct(d.alias("depth"), cut_to("key", d + 1).alias("k")))
    shorter = runs.select(F.explode(each).alias("x"), "n").groupBy("x.depth", "x.k").agg(F.sum("n").alias("n"))
    entries = shorter.unionByName(runs.select(F.lit(CONTEXT).alias("depth"), F.col("key").alias("k"), "n"))
    entries = entries.select("depth", F.shiftrightunsigned("k", 8).alias("context"), F.col("k").bitwiseAND(255).alias("byte"), "n")
    total = F.sum("n").over(Window.partitionBy("depth", "context"))  # of 256 at most
    rows = stored(entries.withColumn("total", total).filter((F.col("n") >= least) | (F.col("depth") == 0)))
    parent = rows.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("shorter"), "byte", F.col("n").alias("pn"), F.col("total").alias("pt"))
    both = rows.filter("depth > 0").withColumn("shorter", cut_to("context", F.col("depth") - 1)).join(parent, ["depth", "shorter", "byte"])
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") * F.col("pt") / F.col("pn")))
    # What isn't kept counts as one more byte.
    rest, prest = 1 - F.sum(F.col("n") / F.col("total")), 1 - F.sum(F.col("pn") / F.col("pt"))
    gain = gain + F.when((rest > 1e-9) & (prest > 1e-9), F.max("total") * rest * F.log(rest / prest)).otherwise(0.0)
    tested = both.groupBy("depth", "context").agg(gain.alias("gain"), F.count("*").alias("k"), F.max("total").alias("total"))
    passed = tested.filter(F.col("gain") > F.col("k") / 2 * F.log("total"))
    each = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda d: F.struct(d.alias("depth"), cut_to("context", d).alias("context")))
    suffixes = passed.select(F.explode(each).alias("x")).select("x.*").distinct()
    return rows.join(suffixes, ["depth", "context"]).unionByName(rows.filter("depth = 0"))


def valued(runs: DataFrame, rows: DataFrame, places: int) -> DataFrame:
    """runs (key, m) with p: log10 of the probability of the last byte by the tree of rows. A group holds the contexts that end
    in the same two bytes, and those of one byte or none."""
    low = runs.sparkSession.sparkContext.broadcast(rows.filter("depth < 2").toArrow())  # 65,792 at most
    none = lambda *names: [F.lit(0).cast("long").alias(x) for x in names]
    states = rows.filter("depth > 1").select(F.col("context").bitwiseAND(65535).alias("end"), F.col("depth").cast("int").alias("depth"), "context", "byte", "n", "total", *none("key", "m"))
    asked = runs.select(F.shiftrightunsigned("key", 8).bitwiseAND(65535).alias("end"), F.lit(-1).alias("depth"), *none("context", "byte", "n", "total"), "key", "m")

    def run(group: pa.Table) -> pa.Table:
        depth = group.column("depth").to_numpy()
        own = group.filter(pa.array(depth >= 0)).select(low.value.column_names)
        keys = group.filter(pa.array(depth < 0)).select(["key", "m"])
        p = _tree(pa.concat_tables([low.value, own.cast(low.value.schema)]), places).log10(keys.column("key").to_numpy().view(np.uint64))
        return keys.append_column("p", pa.array(p))

    return states.unionByName(asked).groupBy("end").applyInArrow(run, "key long, m long, p double")


def fit(docs: DataFrame) -> Model:
    """The model of docs (text, held_out): all texts are counted, the others than held-out ones learnt from."""
    n = F.sum(F.when(F.col("what") < 2, F.col("n")).otherwise(0))
    counts = stored(docs.select("text", "held_out").mapInArrow(_count, "what byte, key long, n long").groupBy((F.col("what") % 2 == 0).alias("run"), "key").agg(n.alias("n"), F.sum("n").alias("m")))
    size = {r["run"]: r for r in counts.groupBy("run").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count_if(F.col("n") > 0).alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.sum(F.when(F.col("key") == END_KEY, F.col("n"))).alias("ends")).collect()}
    at = lambda run, c: (size[run][c] if run in size else 0) or 0
    places = at(True, "n")
    rows = stored(retained(counts.filter("run AND n > 0").select("key", "n"), places).select("depth", "context", "byte", "n", "total"))
    runs = stored(valued(counts.filter("run").select("key", "m"), rows, places))
    words = counts.filter("NOT run").select("key", F.col("n").alias("c"), "m")
    return Model(rows, places, runs, words, at(False, "n"), at(False, "v"), at(False, "once"), at(False, "ends"), at(False, "m"))


def _frequent(runs: DataFrame) -> int:
    """The least m, a power of two, that RUNS runs at most have."""
    sizes = dict(runs.groupBy(F.floor(F.log2("m")).alias("power")).agg(F.count("*").alias("n")).collect())
    power, held = max(sizes, default=-1) + 1, 0
    while power > 0 and held + sizes.get(power - 1, 0) <= RUNS:
        power -= 1
        held += sizes.get(power, 0)
    return 1 << power


def _score(places, common, columns: list[str], training: int, ends: int, new: float):
    """ends: c of the end; new: the share of unknown words."""
    here, there = np.log10((1 - new) * WHOLE / max(training, 1)), np.log10((1 - new) * (1 - WHOLE))

    def run(batches):
        lookup, owner = common.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                words = tokens(part.column("text"))
                text, first, starts = spelled(words)
                docs = len(words.count)
                keys = grams(text, first)
                p, missed = places.value.of(keys)
                spell = np.add.reduceat(p, starts)
                at = np.arange(len(words.hash)) + words.doc  # the words among all tokens
                slot = lookup.find(words.hash | np.uint64(1))
                slot[owner[slot] != words.hash] = -1
                c = np.zeros(len(starts))
                c[words.first[1:] + np.arange(docs)] = ends
                c[at] = np.where(slot >= 0, lookup.values[slot], 0)
                # Tokens whose count or spelling isn't known here are first scored as unknown ones.
                key = np.full(len(starts), END_KEY, np.int64)
                key[at] = words.hash.view(np.int64)
                rare = np.zeros(len(starts), bool)
                rare[at] = slot < 0
                lost = np.searchsorted(starts, missed, "right") - 1
                lost, missed = lost[(c > 0)[lost] | rare[lost]], missed[(c > 0)[lost] | rare[lost]]
                open_ = rare.copy()
                open_[lost] = True
                with np.errstate(divide="ignore"):
                    score = np.where((c > 0) & ~open_, np.logaddexp((here + np.log10(c)) * LN10, (there + spell) * LN10) / LN10, np.log10(new))
                total = lambda of, w, n=docs: np.bincount(of, weights=w, minlength=n)
                upto = lambda n: np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                owner_of = np.repeat(np.arange(docs), words.count + 1)
                runs = pa.ListArray.from_arrays(pa.array(upto(np.bincount(lost, minlength=len(starts))[open_])), pa.array(keys[missed].view(np.int64)))
                tell = pa.StructArray.from_arrays([pa.array(key[open_]), pa.array(c[open_].astype(np.int64), mask=rare[open_]), pa.array(spell[open_]), runs], names=["key", "c", "spell", "runs"])
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + docs)), *(part.column(x) for x in columns), pa.array(words.count.astype(np.int64) + 1), pa.array(total(owner_of, c > 0).astype(np.int64)), pa.array(total(owner_of, np.log10(c + 1))), pa.array(total(owner_of, score)), pa.ListArray.from_arrays(pa.array(upto(total(owner_of, open_))), tell)],
                    names=["row", *columns, "n_tokens", "known", "base", "score", "open"],
                )
                row += docs

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text, held_out), those that
    the model is fitted on or some of them."""
    spark, least, new = docs.sparkSession, max(1.0, model.all_tokens * COMMON), (model.once + 1) / (model.tokens + 2)
    found = model.words.filter((F.col("m") >= least) & (F.col("key") != END_KEY)).select("key", "c").toArrow()  # 1 / COMMON at most
    hashes = found.column("key").to_numpy().view(np.uint64)
    lookup = Lookup(hashes | np.uint64(1), found.column("c").to_numpy().astype(float))
    owner = np.zeros(len(lookup.keys), np.uint64)
    owner[lookup.find(hashes | np.uint64(1))] = hashes
    frequent = _frequent(model.runs)
    few = model.runs.filter(F.col("m") >= frequent).select("key", "p").toArrow()  # RUNS at most
    places, common = spark.sparkContext.broadcast(Places(few.column("key").to_numpy(), few.column("p").to_numpy())), spark.sparkContext.broadcast((lookup, owner))
    token = "struct<key: long, c: long, spell: double, runs: array<long>>"
    schema = f"row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, open array<{token}>"
    rows = stored(docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(_score(places, common, ["doc_id", "held_out"], model.tokens, model.texts, new), schema))
    opened = rows.select("row", F.posexplode("open").alias("at", "t")).select("row", "at", "t.*")
    if frequent > 1:
        opened = stored(_spelled_out(opened, model.runs.filter(F.col("m") < frequent)))
    # The words that aren't broadcast meet their counts in a join; each is rare among all texts, so no key is hot. What a
    # word adds to its text's score is the gain over being unknown.
    other = model.words.filter((F.col("m") < least) & (F.col("c") > 0)).select("key", "c")
    met = opened.filter("c IS NULL").select("row", "key", "spell").join(other, "key").select("row", "c", "spell", F.lit(True).alias("new"))
    if frequent > 1:
        met = met.unionByName(opened.filter("c IS NOT NULL").select("row", "c", "spell", F.lit(False).alias("new")))
    x = F.log10(F.lit(WHOLE / (1 - WHOLE) / max(model.tokens, 1)) * F.col("c")) - F.col("spell")
    spelt = F.col("spell") + float(np.log10((1 - new) * (1 - WHOLE) / new))
    more = spelt + F.when(x > 300, x).otherwise(F.log10(1 + F.pow(F.lit(10.0), x)))
    met = met.groupBy("row").agg(F.sum(F.when(F.col("new"), F.log10(F.col("c") + 1))).alias("more_base"), F.sum(more).alias("more"), F.count_if("new").alias("more_known"))
    out = rows.drop("open").join(met, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + zero("more_base") - F.col("n_tokens") * float(np.log10(model.tokens + model.vocabulary + 1))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + zero("more")).alias("score"))


def _spelled_out(opened: DataFrame, runs: DataFrame) -> DataFrame:
    """opened (row, at, key, c, spell, runs) with what its runs add to spell. Each of runs is rare, so no key is hot."""
    lost = opened.filter(F.size("runs") > 0).select("row", "at", "key", "c", "spell", F.explode("runs").alias("run"))
    lost = lost.join(runs.select(F.col("key").alias("run"), "p"), "run")
    lost = lost.groupBy("row", "at").agg(*(F.first(x).alias(x) for x in ("key", "c", "spell")), F.sum("p").alias("p"))
    return opened.filter(F.size("runs") == 0).drop("at", "runs").unionByName(lost.select("row", "key", "c", (F.col("spell") + F.col("p")).alias("spell")))


def op13_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return score(docs, fit(docs))
