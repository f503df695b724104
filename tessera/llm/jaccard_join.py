"""Operator 4: n-gram Jaccard join by chosen paths.

A document's set are the hashes of its runs of five words. In each of several runs every set walks
a path: at each depth it samples one of its tokens, by a hash that depends on the path so far, so
two sets of similarity J stay together with probability J at every depth. A bucket of sets on the
same path that is small is compared by brute force there; a larger one is split further, to the
last depth. Runs are repeated until a pair at the threshold meets with the target recall. The brute
force compares sketches of 64 minima with a slack that loses a pair at the threshold with
probability below 1e-4, and joins what may be alike into candidate groups. In each group all pairs are verified
exactly on the whole sets, large groups block by block; a pair is never emitted, only each set's
number of links and a spanning forest of the links, whose components are the classes.

Sets that are equal count as one, with the number of their copies; a 64-bit hash tells them apart,
which takes two of a billion sets for one with a probability of 3 %. A null or wordless text has no
set: no links, a class of its own. A text of fewer words has one run of all its words. Null and
repeated doc_ids are kept, each row with its own result. An empty table gives an empty one. Other
columns pass through keep_one() unchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Words, distinct_sets, join_counts, mix, shingles, sized, slices, stored, table
from tessera.llm.components import components

THRESHOLD, DEPTHS, RECALL = 0.8, 3, 0.9999
#: Sets in a bucket beyond which its paths go on; sets in a block of a large bucket or group.
SMALL, BLOCK = 32, 512
#: Minima of a sketch, and the equal ones from which two sets may reach 0.8 (four deviations below the mean).
SKETCH, ALIKE = 64, 38

_ODD = np.random.default_rng(4).integers(1, 2**63, (128, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(threshold: float, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**DEPTHS))


def token_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return distinct_sets(*shingles(Words(texts)))


def set_keys(values: np.ndarray, first: np.ndarray) -> list[int | None]:
    """A 64-bit hash of each set, by which sets are told apart; None for no tokens."""
    raw = values.tobytes()
    return [int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "little", signed=True) if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _sketches(threshold: float):
    """Rows (doc_id, text) as doc_id, set_key, sketch, path (DEPTHS keys of each run on end)."""
    runs = runs_for(threshold)

    def run(batches):
        for batch in batches:
            for rows in slices(batch):
                values, first = token_sets(rows.column("text"))
                keys = set_keys(values, first)
                full = np.flatnonzero(np.diff(first) > 0)
                at, sizes = first[full], np.diff(first)[full]
                sketch = np.zeros((len(full), SKETCH), "<u2")
                path = np.zeros((len(full), runs * DEPTHS), np.int64)
                if len(full):
                    for k in range(SKETCH):
                        sketch[:, k] = np.minimum.reduceat(values * _ODD[k, 0], at) >> np.uint64(40) & np.uint64(0xFFFF)
                    for r in range(runs):
                        so_far = np.full(len(full), r + 1, np.uint64)
                        for d in range(DEPTHS):
                            sampled = np.minimum.reduceat((values ^ np.repeat(mix(so_far + _ODD[r, d + 1]), sizes)) * _ODD[r, d + 2], at)
                            so_far = mix(sampled + so_far * np.uint64(31) + np.uint64(d))
                            path[:, r * DEPTHS + d] = so_far.view(np.int64)
                place = np.full(len(keys), -1)
                place[full] = np.arange(len(full))
                yield pa.record_batch(
                    [rows.column("doc_id"), pa.array(keys, pa.int64()), pa.array([sketch[k].tobytes() if k >= 0 else None for k in place], pa.binary()), pa.array([path[k] if k >= 0 else None for k in place], pa.list_(pa.int64()))],
                    names=["doc_id", "set_key", "sketch", "path"],
                )

    return run


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        cuts = [0, *(k for k in range(1, len(rows)) if rows[k] != rows[k - 1]), len(rows)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and rows[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = rows[a]
    if held:
        yield pa.Table.from_batches(held)


def dealt(rows: DataFrame, key: str, size: str) -> DataFrame:
    """rows, each once for every pair of blocks that its own block is in: a key of many rows is
    worked on by pairs of blocks of about BLOCK rows. Adds block, i and j."""
    n = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("set_key"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", size)
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "set_key")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is linked with by the edges a - b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        on = low != high
        if not on.any():
            break
        a, b = a[on], b[on]
        np.minimum.at(root, high[on], low[on])
        while (root[root] != root).any():
            root = root[root]
    return root


def _pairs(block: np.ndarray, i: int, j: int):
    """Index ranges to compare: within a block, or between the two blocks."""
    return (np.arange(len(block)), np.arange(len(block))) if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))


def _may_be_alike(batches):
    """Bucket rows (key, i, j, block, set_key, sketch) as edges a - b of a spanning forest."""
    for group in groups(batches, ["key", "i", "j"]):
        if group.num_rows < 2:
            continue
        names = group.column("set_key").to_pylist()
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "<u2").reshape(-1, SKETCH)
        left, right = _pairs(group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py())
        edges = [(left[:0], right[:0])]
        for at in range(0, len(left), 32):
            part = left[at : at + 32]
            x, y = np.nonzero((sketch[part][:, None, :] == sketch[right][None, :, :]).sum(-1) >= ALIKE)
            edges.append((part[x], right[y]))
        root = forest(len(names), *(np.concatenate(x) for x in zip(*edges, strict=True)))
        at = np.flatnonzero(root != np.arange(len(names)))
        if len(at):
            yield pa.record_batch([[names[k] for k in at], [names[k] for k in root[at]]], names=["a", "b"])


def intersections(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Incidence of the sets' shared tokens, by runs of columns."""
    tokens, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = counts[ids] > 1
    number = np.cumsum(counts > 1) - 1
    ids, owner, width = number[ids[shared]], owner[shared], int((counts > 1).sum())
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    for at in range(0, width, 4096):
        a, b = np.searchsorted(ids, [at, at + 4096])
        part = np.zeros((len(sets), min(4096, width - at)), np.float32)
        part[owner[a:b], ids[a:b] - at] = 1
        yield part


def at_threshold(shared: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sets that share so many tokens, of so many in both together, reach the
    threshold: in integers, as a float loses pairs of exactly that similarity."""
    ratio = Fraction(str(threshold))
    return shared * (ratio.denominator + ratio.numerator) >= sizes * ratio.numerator


def _verified(threshold: float):
    """Group rows (root, i, j, block, set_key, copies, tokens) as set_key, links, linked (a set of the forest)."""

    def run(batches):
        for group in groups(batches, ["root", "i", "j"]):
            names = group.column("set_key").to_pylist()
            once = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
            if len(once) < len(names):
                group, names = group.take(once), [names[k] for k in once]
            if len(names) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
            copies, size = group.column("copies").to_numpy(), np.array([len(x) for x in sets])
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            left, right = _pairs(group.column("block").to_numpy(), i, j)
            shared = np.zeros((len(left), len(right)), np.int64)
            for part in intersections(sets):
                shared += (part[left] @ part[right].T).astype(np.int64)
            linked = at_threshold(shared, size[left][:, None] + size[right][None, :], threshold)
            if i == j:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(names), np.int64)
            links[left] += linked @ copies[right]
            if i != j:
                links[right] += copies[left] @ linked
            x, y = np.nonzero(linked)
            root = forest(len(names), left[x], right[y])
            at = np.flatnonzero(links)
            if not len(at):
                continue
            yield pa.record_batch([[names[k] for k in at], links[at], [names[k] for k in root[at]]], names=["set_key", "links", "linked"])

    return run


def _tokens(batches):
    """Rows (set_key or null, text) as set_key, tokens; a row of another set than its set_key is left out."""
    for batch in batches:
        for rows in slices(batch):
            values, first = token_sets(rows.column("text"))
            raw, keys = values.tobytes(), set_keys(values, first)
            keep = [k for k, (x, y) in enumerate(zip(keys, rows.column("set_key").to_pylist(), strict=True)) if x is not None and (x == y or y is None)]
            yield pa.record_batch([pa.array([keys[k] for k in keep], pa.int64()), pa.array([raw[8 * first[k] : 8 * first[k + 1]] for k in keep], pa.binary())], names=["set_key", "tokens"])


def _buckets(sets: DataFrame) -> DataFrame:
    """set_key, sketch, key, n: the buckets in which each set is compared."""
    rows = sets.select("set_key", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1, F.lit(DEPTHS)), lambda k: F.slice("path", k + 1, DEPTHS))).alias("steps"))
    found = None
    for depth in range(DEPTHS):
        last = depth == DEPTHS - 1
        rows = rows.withColumn("key", F.col("steps")[depth])
        counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        rows = stored(join_counts(rows, counts, "key"))
        part = rows if last else rows.filter(F.col("n") <= SMALL)
        part = part.select("set_key", "key", "n")
        found = part if found is None else found.unionByName(part)
        rows = rows.filter(F.col("n") > SMALL).drop("key", "n")
    return found.join(sets.select("set_key", "sketch"), "set_key")


def join_sets(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) as (doc_id, set_key), and the sets: set_key, copies, first_id (least
    doc_id of the copies), class_key, links (documents of other sets at the threshold)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = stored(docs.mapInArrow(_sketches(threshold), "doc_id long, set_key long, sketch binary, path array<long>"))
    known = sketched.filter("set_key IS NOT NULL")
    sets = known.groupBy("set_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    sketches = stored(known.dropDuplicates(["set_key"]).select("set_key", "sketch", "path"))
    alike = dealt(_buckets(sketches), "key", "n").select("key", "i", "j", "block", "set_key", "sketch").mapInArrow(_may_be_alike, "a long, b long")
    candidates = components(alike)
    size = candidates.groupBy("root").agg(F.count("*").alias("n"))
    wanted = join_counts(candidates.withColumnRenamed("node", "set_key"), size, "root").join(sets, "set_key").select("set_key", "root", "n", "copies", "first_id")
    # Whole texts come from one row of each set; rows without doc_id are found by their sets.
    wanted = stored(wanted)
    named = docs.join(sized(wanted.select(F.col("first_id").alias("doc_id"), "set_key"), 16), "doc_id").select("set_key", "text")
    nameless = docs.filter("doc_id IS NULL").select(F.lit(None).cast("long").alias("set_key"), "text")
    tokens = named.unionByName(nameless).mapInArrow(_tokens, "set_key long, tokens binary").join(wanted.drop("first_id"), "set_key")
    checked = stored(dealt(tokens, "root", "n").select("root", "i", "j", "block", "set_key", "copies", "tokens").mapInArrow(_verified(threshold), "set_key long, links long, linked long"))
    classes = components(checked.select(F.col("set_key").alias("a"), F.col("linked").alias("b"))).select(F.col("node").alias("set_key"), F.col("root").alias("class_key"))
    links = checked.groupBy("set_key").agg(F.sum("links").alias("links"))
    sets = sets.join(classes, "set_key", "left").join(links, "set_key", "left")
    sets = sets.withColumns({"class_key": F.coalesce("class_key", "set_key"), "links": F.coalesce("links", F.lit(0))})
    return sketched.select("doc_id", "set_key"), stored(sets)


def similar_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of all documents linked with it, itself included), copy_id
    (least doc_id of those with the same set), n_links (other documents at the threshold)."""
    rows, sets = join_sets(docs, threshold)
    least = sets.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    sets = sets.join(least, "class_key")
    found = rows.filter("set_key IS NOT NULL").join(sets, "set_key")
    found = found.select("doc_id", "class_id", F.col("first_id").alias("copy_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = rows.filter("set_key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class, the one with the least doc_id; texts without words stay."""
    rows, sets = join_sets(docs, threshold)
    # The least of each class is taken before the shuffle too, so a large class stays spread out.
    members = rows.filter("set_key IS NOT NULL").join(sets.select("set_key", "class_key"), "set_key")
    kept = members.groupBy("class_key").agg(F.min(F.struct("doc_id", "set_key")).alias("least")).select("least.*")
    kept = kept.unionByName(rows.filter("set_key IS NULL"))
    same_id = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    if not same_id:
        return docs.join(sized(stored(kept.select("doc_id")), 8), "doc_id", "left_semi").select(docs.columns)
    # Some rows share a doc_id: tell them apart by their sets, and equal ones by row.
    schema = T.StructType([*docs.schema.fields, T.StructField("_set", T.LongType())])

    def with_set(batches):
        for batch in batches:
            for part in slices(batch):
                keys = set_keys(*token_sets(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], names=schema.names)

    keyed = docs.mapInArrow(with_set, schema)
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("set_key").alias("_key")).distinct()
    found = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_id"]) & keyed["_set"].eqNullSafe(kept["_key"]), "left_semi")
    once = found.filter("_set IS NOT NULL").dropDuplicates(["doc_id", "_set"])
    return once.unionByName(found.filter("_set IS NULL")).select(docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
