"""Operator 7: exact top-k by inner product with the three-phase uniform threshold.

A vector's score is a sum over DIM_LISTS runs of its components, so each run gives a score list.
Phase 1: in each block of candidates the best of the first list get their whole scores; the k-th
best of these over all blocks is a cutoff no answer can lie below. Phase 2: the cutoff goes back to
all blocks, which read list after list. A pair of query and candidate is dropped as soon as its
score so far and the product of both remaining norms (which the other lists can't exceed) stay
below the cutoff; once few pairs are left, only these read on. Phase 3: a pair is an entry if some
list gives it cutoff / lists or more (else its sum is below the cutoff), entries get their exact
whole scores, and the best k win.

Queries are rows with vec_id divisible by 50, packed in blocks; candidates are packed in chunks,
and each chunk meets each query block in one task row. Vectors that are null, or hold null or
non-finite components (also after scaling), and rows without vec_id take no part; a repeated vec_id
is one query, and its rows are candidates to others, each on its own; shorter vectors count as
padded with zeros. Products that a double can't hold exactly are taken in whole numbers of any
size; a score beyond 64 bits counts as the nearest 64-bit number. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

DIM_LISTS, CHUNK, QUERY_BLOCK = 4, 4096, 256
#: Bytes of packed query blocks that may be broadcast; more are sent by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Share of pairs up to which the rest of the lists is read for single pairs.
FEW = 0.1
_MOST = 2**63 - 1

_PACK = "ids binary, width int, matrix binary, cut binary"
_PACK_TYPE = pa.schema([("ids", pa.binary()), ("width", pa.int32()), ("matrix", pa.binary()), ("cut", pa.binary())])


def _packs(size: int):
    """A mapInArrow function: rows (vec_id, v, cut) as blocks of at most size vectors."""

    def pack(ids, vectors, cuts):
        width = max(map(len, vectors), default=0)
        matrix = np.zeros((len(vectors), width))
        for k, v in enumerate(vectors):
            matrix[k, : len(v)] = v
        return pa.record_batch([[np.array(ids, np.int64).tobytes()], [width], [matrix.tobytes()], [np.array(cuts, float).tobytes()]], schema=_PACK_TYPE)

    def run(batches):
        ids, vectors, cuts = [], [], []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            cuts += [-np.inf if x is None else x for x in batch.column("cut").to_pylist()]
            column = batch.column("v")
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
            vectors += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            while len(ids) >= size:
                yield pack(ids[:size], vectors[:size], cuts[:size])
                ids, vectors, cuts = ids[size:], vectors[size:], cuts[size:]
        if ids:
            yield pack(ids, vectors, cuts)

    return run


def _runs(width: int) -> list[slice]:
    return [slice(x[0], x[-1] + 1) for x in np.array_split(np.arange(width), DIM_LISTS) if len(x)]


def _exact(q: np.ndarray, c: np.ndarray) -> bool:
    """Whether doubles hold all their partial sums."""
    return not q.size or not c.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53


def _whole_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All scores in whole numbers of any size, cut to 64 bits."""
    q, c = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (q, c))
    got = q @ c.T if q.shape[1] else np.zeros((len(q), len(c)), object)
    return np.array([[max(-_MOST - 1, min(_MOST, int(x))) for x in row] for row in got], np.int64).reshape(len(q), len(c))


def _pair_scores(q: np.ndarray, c: np.ndarray, rows: np.ndarray, columns: np.ndarray, run: slice) -> np.ndarray:
    out = np.zeros(len(rows))
    for at in range(0, len(rows), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", q[rows[part], run], c[columns[part], run])
    return out


def entries(q: np.ndarray, c: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, column and score of all pairs that reach their row's cut; and how many products of a
    query's and a candidate's run were taken for that."""
    runs = _runs(q.shape[1])
    if not runs:
        rows, columns = np.nonzero(np.zeros((len(q), len(c))) >= cut[:, None])
        return rows, columns, np.zeros(len(rows)), 0
    share = cut / len(runs)
    rest_q, rest_c = (np.sqrt([(m[:, r.stop :] ** 2).sum(axis=1) for r in runs]) for m in (q, c))
    total = q[:, runs[0]] @ c[:, runs[0]].T
    entry, taken, k = total >= share[:, None], total.size, 1
    while True:
        # What the lists that follow can add at most, with room for the rounding of norms.
        open_ = total + (rest_q[k - 1][:, None] * rest_c[k - 1][None, :]) * (1 + 1e-9) + 1 >= cut[:, None]
        if k == len(runs) or open_.mean() <= FEW:
            break
        part = q[:, runs[k]] @ c[:, runs[k]].T
        entry |= part >= share[:, None]
        total += part
        taken, k = taken + total.size, k + 1
    rows, columns = np.nonzero(open_)
    score, entry = total[rows, columns], entry[rows, columns]
    for run in runs[k:]:
        part = _pair_scores(q, c, rows, columns, run)
        entry |= part >= share[rows]
        score, taken = score + part, taken + len(rows)
    on = entry & (score >= cut[rows])
    return rows[on], columns[on], score[on], taken


def _unpack(batch: pa.RecordBatch):
    for k in range(batch.num_rows):
        row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
        qids, cids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        q, c = np.frombuffer(row["q_matrix"]).reshape(len(qids), row["q_width"]), np.frombuffer(row["matrix"]).reshape(len(cids), row["width"])
        width = min(q.shape[1], c.shape[1])
        yield qids, cids, np.frombuffer(row["q_cut"]), q[:, :width], c[:, :width]


_SCORES = "query_id long, vec_id long, score long"
_SCORES_TYPE = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _best(qids, cids, rows, columns, scores, k: int) -> pa.RecordBatch:
    """Of entries (row, column, score), each query's k best; ties to smaller vec_id."""
    own = qids[rows] != cids[columns]
    rows, columns, scores = rows[own], columns[own], np.asarray(scores)[own].astype(np.int64)
    order = np.lexsort((cids[columns], ~scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return pa.record_batch([qids[rows[keep]], cids[columns[keep]], scores[keep]], schema=_SCORES_TYPE)


def _all_pairs(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(n), m), np.tile(np.arange(m), n)


def _local_lists(k: int):
    """Phase 1: the best of the first list, with their whole scores."""

    def run(batches):
        for batch in batches:
            for qids, cids, _, q, c in _unpack(batch):
                runs, n = _runs(q.shape[1]), min(k + 1, len(cids))
                if not _exact(q, c) or not runs:
                    yield _best(qids, cids, *_all_pairs(len(qids), len(cids)), _whole_scores(q, c).ravel(), k)
                    continue
                columns = np.argpartition(-(q[:, runs[0]] @ c[:, runs[0]].T), n - 1, axis=1)[:, :n].ravel()
                rows = np.repeat(np.arange(len(qids)), n)
                yield _best(qids, cids, rows, columns, _pair_scores(q, c, rows, columns, slice(None)), k)

    return run


def _entries(k: int):
    """Phases 2 and 3: entries that some list lifts over its share of the cutoff, resolved exactly."""

    def run(batches):
        for batch in batches:
            for qids, cids, cut, q, c in _unpack(batch):
                if _exact(q, c):
                    yield _best(qids, cids, *entries(q, c, cut)[:3], k)
                else:
                    yield _best(qids, cids, *_all_pairs(len(qids), len(cids)), _whole_scores(q, c).ravel(), k)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (vec_id, v) the k rows of vectors
    (vec_id, v: array of whole doubles) with the highest inner product, itself left out."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    blocks = max(1, -(-size["n"] // QUERY_BLOCK))
    chunks = vectors.withColumn("cut", F.lit(None).cast("double")).mapInArrow(_packs(CHUNK), _PACK)

    def against(queries: DataFrame, phase) -> DataFrame:
        packed = queries.repartition(blocks, "vec_id").mapInArrow(_packs(QUERY_BLOCK), _PACK)
        packed = packed.select(*(F.col(c).alias(f"q_{c}") for c in packed.columns))
        if size["n"] * ((size["width"] or 0) + 2) * 8 <= BROADCAST_BYTES:
            packed = F.broadcast(packed)
        return chunks.crossJoin(packed).mapInArrow(phase, _SCORES)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = against(queries.withColumn("cut", F.lit(None).cast("double")), _local_lists(k))
    # A double may round a long up: the cutoff is lowered by more than that.
    as_double = F.col("score").cast("double")
    lowered = F.when(F.abs(as_double) < 2.0**53, as_double).otherwise(as_double - F.abs(as_double) * 2.0**-51)
    cutoff = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), lowered.alias("cut"))
    found = against(queries.join(cutoff, "vec_id", "left"), _entries(k))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def whole(x: Column) -> Column:
    """floor(256 * x) as a double; from 2^53 on a double is whole as it is."""
    y = 256 * x.cast("double")
    return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    return top_k(rows, rows.filter(F.col("vec_id") % 50 == 0).dropDuplicates(["vec_id"]), 5)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
