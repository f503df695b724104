"""Operator 5: toxicity by a subsequence string-kernel support vector machine.

A text is taken apart into sentences and these into units: words, and words that stand together
across single marks or as single letters ("i.d.i.o.t", "i - d - i - o - t", "idi*ot"), joined. The
kernel of two units weighs all subsequences of three bytes they share by how far they are spread,
so a letter put in or a gap costs a little and not the match. Nyström landmarks turn it into short
vectors, on which a linear support vector machine is trained.

Training rows are the sentences of at most PER_CLASS labelled documents of each class, each with
its document's label (multiple instances: a toxic document has insulting sentences, but not all of
them are). Fragments, that is words and beginnings of words, are counted by documents of either
label; those that toxic documents surely have far more often are witnesses. A toxic sentence
stands for its units that are or begin with a witness; a clean sentence for its unit that the
machine so far finds worst, so that clean look-alikes of insults are the hard negatives. Sentences
are read by Spark tasks; the driver gets counted fragments and units, of bounded number.

A document is a bag of its WORST worst different units. The kernel of two bags is the sum of their
units' kernels, so the sum of its units' Nyström vectors stands for a document; a second linear
machine is trained on these with the documents' labels, and its margin mapped to 0..1 by a logistic
function. So one clear insult is enough, while a word that clean documents have too needs company.

A null text counts as empty, which has the lowest score. Null and repeated doc_ids are kept;
without labels of both kinds, or without a witness, every score is 0. Units of over 24 bytes are
scored in windows of 24, so texts and units of any length are read whole. Other columns pass
through unchanged; an older toxicity_score is replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Words, each_slice, held_out, mix, slices, stored, table
from tessera.llm.labelled import sampled_documents

#: Labelled documents of each class that fitting reads; fragments and units that it counts at most.
PER_CLASS, FRAGMENTS, UNITS = 4000, 100_000, 3000
DECAY, LANDMARKS, LONGEST = 0.6, 48, 24
#: Unit scores that a worker keeps, and units that a document's score is made of.
MOST_UNITS, WORST = 1_500_000, 8
#: Lengths of beginnings of words, in bytes, and how many standard errors and logarithms of the odds
#: a witness has to be above what clean documents show; and the weight of insults that stand alone.
BEGINNINGS, ERRORS, ODDS, ALONE = (4, 5, 6, 7), 3.0, 0.7, 0.3


def coded(units: list[bytes]) -> np.ndarray:
    """Bytes by unit, padded with 0."""
    width = max(map(len, units), default=1) or 1
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in units), np.uint8).reshape(-1, width)


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over shared subsequences of three bytes, of DECAY to the power of both spreads."""
    n, m, width = len(a), len(b), b.shape[1]
    d, d2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    out = np.zeros((n, m), np.float32)
    one, two = (np.zeros((width + 1, n, m), np.float32) for _ in range(2))
    for i in range(a.shape[1]):
        part1, part2 = np.zeros((n, m), np.float32), np.zeros((n, m), np.float32)
        column = a[:, i][:, None]
        before1, before2 = one[0].copy(), two[0].copy()
        for j in range(1, width + 1):
            same = ((column == b[:, j - 1][None, :]) & (column != 0)).astype(np.float32)
            same *= d2
            out += same * before2
            part2 *= d
            part2 += same * before1
            part1 *= d
            part1 += same
            before1, before2 = one[j].copy(), two[j].copy()
            one[j] *= d
            one[j] += part1
            two[j] *= d
            two[j] += part2
    return out


def self_kernel(a: np.ndarray) -> np.ndarray:
    """kernel(x, x) of each unit."""
    n, width = a.shape
    d, d2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    out = np.zeros(n, np.float32)
    one, two = (np.zeros((width + 1, n), np.float32) for _ in range(2))
    for i in range(width):
        part1, part2 = np.zeros(n, np.float32), np.zeros(n, np.float32)
        before1, before2 = one[0].copy(), two[0].copy()
        for j in range(1, width + 1):
            same = ((a[:, i] == a[:, j - 1]) & (a[:, i] != 0)).astype(np.float32) * d2
            out += same * before2
            part2 = part2 * d + same * before1
            part1 = part1 * d + same
            before1, before2 = one[j].copy(), two[j].copy()
            one[j] = one[j] * d + part1
            two[j] = two[j] * d + part2
    return out


def cosine(units: list[bytes], marks: list[bytes]) -> np.ndarray:
    """The normalised kernel; 0 for units of fewer than three bytes."""
    out = np.zeros((len(units), len(marks)), np.float32)
    right = coded(marks)
    norm = self_kernel(right)
    order = sorted(range(len(units)), key=lambda k: len(units[k]))
    for at in range(0, len(order), 512):
        part = order[at : at + 512]
        left = coded([units[k] for k in part])
        if left.shape[1] >= 3:
            out[part] = kernel(left, right) / np.sqrt(np.maximum(self_kernel(left)[:, None] * norm[None, :], 1e-12))
    return out


class Machine:
    """Landmarks and the map from kernels with them to Nyström vectors; the weights of a unit's vector
    (bias last), and those of a document's (number of its units and bias last), with the
    slope of the logistic map of its margin."""

    def __init__(self, marks: list[bytes], root: np.ndarray, weights: np.ndarray, bag: np.ndarray | None = None, slope: float = 1.0):
        self.marks, self.root, self.weights, self.bag, self.slope = marks, root, weights, bag, slope
        self.forget()

    def plain(self):
        return self.marks, self.root, self.weights, self.bag, self.slope

    def forget(self) -> None:
        """Drops the kept scores: hashes of units in order, and the score of each."""
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def known(self, hashes: np.ndarray, units: Callable[[np.ndarray], list[bytes]]) -> np.ndarray:
        """Scores of units by hash (in order, once each); units() gives the bytes of those not kept so far."""
        if len(self.keys) > MOST_UNITS:
            self.forget()
        at = np.searchsorted(self.keys, hashes)
        held = np.zeros(len(hashes), bool)
        held[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == hashes[at < len(self.keys)]
        out = np.zeros(len(hashes), np.float32)
        out[held] = self.scores[at[held]]
        new = np.flatnonzero(~held)
        out[new] = self.score(units(new))
        self.keys, self.scores = np.insert(self.keys, at[new], hashes[new]), np.insert(self.scores, at[new], out[new])
        return out

    def vectors(self, units: list[bytes]) -> np.ndarray:
        return cosine(units, self.marks) @ self.root if units else np.zeros((0, len(self.marks)))

    def score(self, units: list[bytes]) -> np.ndarray:
        return self.vectors(units) @ self.weights[:-1] + self.weights[-1]


def linear_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Weights of least ridge and squared hinge loss, by Newton steps; y: 1 and -1."""
    w = np.zeros(x.shape[1])
    for _ in range(60):
        gap = 1 - y * (x @ w)
        on = gap > 0
        gradient = ridge * w - x[on].T @ (cost * y * gap)[on]
        step = np.linalg.solve(np.diag(ridge) + (x[on] * cost[on][:, None]).T @ x[on], gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def train(units: list[bytes], y: np.ndarray, weight: np.ndarray, marks: list[bytes]) -> Machine:
    """The machine of units (y: 1 and -1); both classes weigh the same."""
    value, vector = np.linalg.eigh(cosine(marks, marks).astype(float))
    root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
    x = np.hstack((cosine(units, marks) @ root, np.ones((len(units), 1))))
    cost = np.where(y > 0, weight / weight[y > 0].sum(), weight / weight[y < 0].sum()) * 1000
    return Machine(marks, root, linear_machine(x, y, cost, np.append(np.ones(len(marks)), 1e-6)))


def units_of(words: Words) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Byte spans (start, end) of words; then document and bytes of each joined unit. Longer ones in windows."""
    raw = words.raw.tobytes()
    spans = np.stack((words.starts, words.ends), axis=1)
    docs, extra = [], []

    def add(doc: int, unit: bytes) -> None:
        for k in range(0, max(1, len(unit) - LONGEST // 2), LONGEST // 2):
            docs.append(doc)
            extra.append(unit[k : k + LONGEST])

    for k in np.flatnonzero(words.ends - words.starts > LONGEST):
        add(int(words.doc[k]), raw[words.starts[k] : words.ends[k]])
    if len(spans) > 1:
        gap, same = words.starts[1:] - words.ends[:-1], words.doc[1:] == words.doc[:-1]
        mark = words.raw[words.ends[:-1].clip(max=max(len(words.raw) - 1, 0))]
        single = words.ends - words.starts == 1
        letters = same & (gap <= 3) & single[1:] & single[:-1]
        for joins, least in ((same & (gap == 1) & (mark != 32) & (mark != 10) & ~letters, 1), (letters, 2)):
            step = np.diff(np.concatenate(([0], joins.view(np.int8), [0])))
            for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                if b - a >= least:
                    add(int(words.doc[a]), b"".join(raw[words.starts[k] : words.ends[k]] for k in range(a, b + 1)))
    return spans, docs, extra


def padded(words: Words) -> np.ndarray:
    """The first LONGEST bytes of each word, padded with 0; filled place by place, as memory is scarce."""
    out = np.zeros((LONGEST, len(words.starts)), np.uint8)
    last = max(len(words.raw) - 1, 0)
    for k in range(LONGEST):
        at = words.starts + k
        on = at < words.ends
        out[k, on] = words.raw[np.minimum(at, last)[on]]
    return out.T


_PLACE_KEY = np.random.default_rng(11).integers(1, 2**63, LONGEST, dtype=np.uint64) | np.uint64(1)


def fragments(chars: np.ndarray, lens: np.ndarray):
    """Length of a beginning (0: the whole word), the words that are longer than it, and its hash in each."""
    total = np.zeros(len(lens), np.uint64)
    for k in range(LONGEST):
        total += chars[:, k].astype(np.uint64) * _PLACE_KEY[k]
        if k + 1 in BEGINNINGS:
            yield k + 1, np.flatnonzero(lens > k + 1), mix(total + np.uint64(2 * (k + 1)))
    yield 0, np.flatnonzero(lens >= 3), mix(total + np.uint64(1))


def _counted(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes, a place of each, and in how many documents each is."""
    _, once = np.unique(mix(hashes + docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    found, at, n = np.unique(hashes[once], return_index=True, return_counts=True)
    return found, once[at], n


def _words(rows: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
    words = Words(rows.column("text"))
    return words, padded(words), words.ends - words.starts


def witnesses(sample: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """Hashes of the fragments that toxic documents surely have far more often, in order."""
    if not n_toxic or not n_clean:
        return np.zeros(0, np.uint64)

    def toxic(rows: pa.RecordBatch) -> pa.RecordBatch:
        words, chars, lens = _words(rows)
        parts = [_counted(h[which], words.doc[which]) for _, which, h in fragments(chars, lens)]
        return pa.record_batch([np.concatenate([x[0] for x in parts]).view(np.int64), np.concatenate([x[2] for x in parts])], names=["h", "n"])

    found = sample.filter("label = 1").select("text").mapInArrow(each_slice([], toxic), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(3, n_toxic // 250))
    rows = found.orderBy(F.desc("n"), "h").limit(FRAGMENTS).collect()
    if not rows:
        return np.zeros(0, np.uint64)
    known = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    a = np.array([r["n"] for r in rows], float)
    order = np.argsort(known)
    known, a = known[order], a[order]

    def clean(batches):
        b = np.zeros(len(known), np.int64)
        for batch in batches:
            for rows in slices(batch):
                words, chars, lens = _words(rows)
                for _, which, h in fragments(chars, lens):
                    got, _, n = _counted(h[which], words.doc[which])
                    at = np.minimum(np.searchsorted(known, got), len(known) - 1)
                    hit = known[at] == got
                    b[at[hit]] += n[hit]
        on = np.flatnonzero(b)
        yield pa.record_batch([on, b[on]], names=["k", "n"])

    b = np.zeros(len(known))
    for r in sample.filter("label = 0").select("text").mapInArrow(clean, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        b[r["k"]] = r["n"]
    odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    return known[odds - ERRORS * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= ODDS]


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)


_STOPS = np.zeros(256, bool)
_STOPS[[10, 33, 46, 63]] = True


def sentence_numbers(words: Words) -> np.ndarray:
    """By word, the number of its sentence: texts end at . ! ? and line feeds."""
    upto = np.concatenate(([0], np.cumsum(_STOPS[words.raw])))
    return upto[words.starts] + words.doc


def _units_table(make):
    """A mapInArrow function: units (bytes) with label, documents that have them, and score."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        words, chars, lens = _words(rows)
        label = np.array(rows.column("label").to_pylist(), np.int64)
        which, score = make(words, chars, lens, label)
        hashes, at, n = _counted(words.hash[which] * np.uint64(2) + label[words.doc[which]].astype(np.uint64), words.doc[which])
        at = which[at]
        units = [chars[k, : min(LONGEST, lens[k])].tobytes() for k in at]
        return pa.record_batch([pa.array(units, pa.binary()), label[words.doc[at]], n, score[at]], names=["unit", "label", "n", "score"])

    return each_slice([], run)


_UNITS = "unit binary, label long, n long, score double"


def _collected(df: DataFrame, best: str) -> list[tuple[bytes, int, int]]:
    """The UNITS units of each label that come first."""
    df = df.groupBy("unit", "label").agg(F.sum("n").alias("n"), F.max("score").alias("score"))
    rows = [r for k in (0, 1) for r in df.filter(F.col("label") == k).orderBy(F.desc(best), F.desc("n"), "unit").limit(UNITS).collect()]
    return [(bytes(r["unit"]), r["label"], r["n"]) for r in rows]


def marked_units(sample: DataFrame, known: np.ndarray) -> list[tuple[bytes, int, int]]:
    """Units of sentences that are or begin with a witness, with label and number of documents."""

    def make(words, chars, lens, label):
        on = np.zeros(len(lens), bool)
        for _, which, h in fragments(chars, lens):
            on[which] |= _among(h[which], known)
        return np.flatnonzero(on), np.ones(len(lens))

    return _collected(sample.mapInArrow(_units_table(make), _UNITS), "n")


def worst_clean_units(sample: DataFrame, machine: Machine) -> list[tuple[bytes, int, int]]:
    """The unit that the machine finds worst in each clean sentence; of all these the worst ones."""
    plain = machine.plain()

    def make(words, chars, lens, label):
        score = unit_scores(words, _machine(plain))
        sentence = sentence_numbers(words)
        order = np.lexsort((score, sentence))
        last = order[np.append(sentence[order][1:] != sentence[order][:-1], True)] if len(order) else order
        return np.sort(last), score.astype(float)

    return _collected(sample.filter("label = 0").mapInArrow(_units_table(make), _UNITS), "score")


def frequent_units(sample: DataFrame) -> list[tuple[bytes, int, int]]:
    """Units that most clean documents of the sample have."""
    one_in = F.xxhash64("text") % 8 == 0  # common words show in any part of the sample
    make = lambda words, chars, lens, label: (np.flatnonzero(lens >= 3), np.zeros(len(lens)))
    return _collected(sample.filter("label = 0").filter(one_in).mapInArrow(_units_table(make), _UNITS).filter("n > 1"), "n")[:600]


def spread(units: list[bytes], weight: np.ndarray, n: int) -> list[bytes]:
    """n units of moderate length that weigh much and are unlike one another."""
    order = [k for k in np.argsort(-weight, kind="stable") if len(units[k]) <= LONGEST // 2][:1000]
    units, weight = [units[k] for k in order], weight[order]
    chosen, like = [], np.zeros(len(units))
    while len(chosen) < min(n, len(units)):
        k = int(np.argmax(weight * (1 - like)))
        if like[k] > 0.97:
            break
        chosen.append(units[k])
        like = np.maximum(like, cosine(units, [units[k]])[:, 0])
    return chosen


def unit_scores(words: Words, machine: Machine) -> np.ndarray:
    """The machine's margin of each word."""
    raw = words.raw.tobytes()
    hashes, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
    spans = np.stack((words.starts, words.ends), axis=1)
    return machine.known(hashes, lambda new: [raw[a : min(b, a + LONGEST)] for a, b in spans[at[new]].tolist()])[back]


#: Margin below which a unit doesn't count.
LOW = -0.5


def bags(texts: pa.Array, machine: Machine) -> np.ndarray:
    """The summed vectors of the WORST worst different units of each text, their number, and 1."""
    words = Words(texts)
    score = unit_scores(words, machine)
    _, docs, extra = units_of(words)
    on = np.flatnonzero(score > LOW)
    _, once = np.unique(mix(words.hash[on] + words.doc[on].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    on = on[once]
    raw = words.raw.tobytes()
    units = [raw[a : min(b, a + LONGEST)] for a, b in zip(words.starts[on].tolist(), words.ends[on].tolist(), strict=True)]
    doc, score = words.doc[on], score[on]
    if extra:
        pairs = sorted(set(zip(docs, extra, strict=True)) - set(zip(doc.tolist(), units, strict=True)))
        more = machine.score([u for _, u in pairs])
        units += [u for _, u in pairs]
        doc, score = np.concatenate((doc, np.array([d for d, _ in pairs], np.int64))), np.concatenate((score, more))
    order = np.lexsort((-score, doc))
    order = order[score[order] > LOW]
    place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    order = order[place < WORST]
    out = np.zeros((len(texts), len(machine.marks) + 2))
    np.add.at(out[:, :-2], doc[order], machine.vectors([units[k] for k in order]))
    out[:, -2] = np.bincount(doc[order], minlength=len(texts))
    out[:, -1] = 1
    return out


def document_scores(texts: pa.Array, machine: Machine) -> np.ndarray:
    z = machine.slope * (bags(texts, machine) @ machine.bag)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic_slope(margin: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """Slope of the logistic map of margins, so that the machine's boundary is at 0.5."""
    w = 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w * margin, -30, 30)))
        # A prior keeps the slope finite.
        step = ((weight * (labels - p)) @ margin - 0.01 * w) / ((weight * p * (1 - p)) @ margin**2 + 0.01)
        w = float(np.clip(w + np.clip(step, -1, 1), 0.1, 20))
        if abs(step) < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """The machine; None without labels of both kinds or a witness."""
    sample, total = sampled_documents(docs, labels, "toxic", PER_CLASS)
    sample = stored(sample)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    known = witnesses(sample, counts.get(1, 0), counts.get(0, 0))
    if not len(known):
        return None
    marked = marked_units(sample, known)
    clean = {u: (n, 0) for u, _, n in frequent_units(sample)} | {u: (n, 1) for u, k, n in marked if k == 0}
    toxic = {u: n for u, k, n in marked if k == 1}
    if not toxic or not clean:
        return None
    share = total[1] / counts[1], total[0] / counts[0]  # the sample's classes are weighed back
    weigh = lambda n, k: np.log1p(np.array(n, float) * share[k])
    marks = spread(list(toxic), weigh(list(toxic.values()), 0), LANDMARKS * 2 // 3)
    for mined in (False, True, True):
        if mined:
            clean |= {u: (n, 1) for u, _, n in worst_clean_units(sample, machine) if u not in toxic or u in clean}
        units = [*toxic, *clean]
        y = np.repeat([1.0, -1.0], [len(toxic), len(clean)])
        weight = np.concatenate((weigh(list(toxic.values()), 0), weigh([n for n, _ in clean.values()], 1)))
        hard = [u for u, (_, near) in clean.items() if near]
        rest = spread(hard or [*clean], weigh([clean[u][0] for u in hard or clean], 1), LANDMARKS - len(marks))
        machine = train(units, y, weight, [*dict.fromkeys([*marks, *rest])])
    plain = machine.plain()

    def bags_of(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(bags(rows.column("text"), _machine(plain))), pa.list_(pa.float64())), rows.column("label")], names=["bag", "label"])

    rows = sample.mapInArrow(each_slice([], bags_of), "bag array<double>, label int").collect()  # 2 * PER_CLASS rows of LANDMARKS numbers at most
    x, label = np.array([r["bag"] for r in rows]), np.array([r["label"] for r in rows])
    weight = np.where(label == 1, share[0], share[1])
    # Insults on their own are rows too, of ALONE times the toxic documents' weight in all.
    n = np.array(list(toxic.values()), float)
    one = np.hstack((machine.vectors(list(toxic)), np.ones((len(toxic), 2))))
    cost = np.concatenate((weight, ALONE * weight[label == 1].sum() * n / n.sum()))
    y = np.concatenate((np.where(label == 1, 1.0, -1.0), np.ones(len(toxic))))
    machine.bag = linear_machine(np.vstack((x, one)), y, cost, np.append(np.full(x.shape[1] - 1, 0.3), 1e-6))
    machine.slope = logistic_slope(x @ machine.bag, label, weight)
    return machine


_MACHINES: dict[str, Machine] = {}


def _machine(plain: tuple) -> Machine:
    """The machine of this Python worker, with the scores it has kept."""
    key = repr([x if x is None or isinstance(x, list | float) else x.tolist() for x in plain])
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Machine(*plain)
    return _MACHINES[key]


def toxicity_scores(docs: DataFrame, labelled: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs with toxicity_score, 0 to 1; labelled (doc_id, text) holds the texts that labels speak of."""
    model = fit(labelled, labels)
    docs = docs.drop("toxicity_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity_score", T.DoubleType())])
    plain = model and model.plain()

    def run(batches):
        for batch in batches:
            for rows in slices(batch, text):
                score = document_scores(rows.column(text), _machine(plain)) if plain else np.zeros(rows.num_rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], names=[*rows.schema.names, "toxicity_score"])

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = toxicity_scores(docs, docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
