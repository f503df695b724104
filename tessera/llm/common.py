"""Tables, shared folders and numpy text kernels that the operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task holds in numpy arrays at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset
    and Spark runs in one local process, a new temporary folder takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df written as a table in the shared folder and read back: a cut of the lineage that
    survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Estimated bytes up to which a counted table is broadcast.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its counted rows of about row_bytes stay within BROADCAST_BYTES; else
    it is joined by a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: Rows from which on a key is hot.
HOT = 1000


def join_counts(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """rows.join(counts, key), where counts (key, n) says how many rows a key has. Rows of hot keys,
    of which there are few for the rows, meet a broadcast of these; the others are shuffled by key."""
    hot = sized(counts.filter(F.col("n") >= HOT), 32)
    cold = rows.join(hot.select(key), key, "left_anti").join(counts.filter(F.col("n") < HOT), key)
    return rows.join(hot, key).unionByName(cold)


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE_BYTES of text, so that a task's memory doesn't follow
    the length of the texts."""
    sizes = np.frombuffer(batch.column(column).fill_null("").cast(pa.large_string()).buffers()[1], np.int64)
    sizes = sizes[: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end (null: empty), and where each text starts, plus the end."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, (ends - ends[0] if len(ends) else np.zeros(1, np.int64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BYTE_KEY = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: lower-cased A-Z, runs of ASCII letters, digits and non-ASCII.

    starts, ends: byte places in raw; doc: the text's number; hash: 64 bits; first: the number
    of each text's first word, plus the total.
    """

    def __init__(self, texts: pa.Array, letters: np.ndarray = _WORD):
        """letters: by byte, whether it belongs to words."""
        raw, self.docs = text_bytes(texts)
        self.raw = _LOWER[raw]
        word = letters[self.raw]
        n = len(word)
        opens, shuts = word.copy(), word.copy()
        if n:
            opens[1:] &= ~word[:-1]
            inner = self.docs[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            opens[inner] = word[inner]
            shuts[:-1] &= ~word[1:]
            shuts[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        lens = self.ends - self.starts
        chars = self.raw[word]
        at = np.cumsum(lens) - lens
        if len(lens):
            powers = np.cumprod(np.full(int(lens.max()), _ODD, np.uint64))
            place = np.arange(len(chars)) - np.repeat(at, lens)
            self.hash = mix(np.add.reduceat(_BYTE_KEY[chars] * powers[place], at) + lens.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.starts, self.docs)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words, and the number of each text's first one, plus the
    total. A text of fewer words, but not none, has one of all its words."""
    counts = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    first = np.concatenate(([0], np.cumsum(counts)))
    n = int(first[-1])
    at = np.arange(n) - np.repeat(first[:-1], counts) + np.repeat(words.first[:-1], counts)
    size = np.repeat(np.minimum(words.count, k), counts)
    out = size.astype(np.uint64) * _ODD
    for j in range(k):
        ok = j < size
        out = np.where(ok, mix(out * _ODD + words.hash[np.where(ok, at + j, 0)] if len(words.hash) else out), out)
    return out, first


def distinct_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, once each; and the number of each text's first one, plus the total."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(first)))


def each_slice(columns: list[str], make: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str = "text"):
    """A mapInArrow function: make() of each slice of the rows."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                if (out := make(part)) is not None:
                    yield out

    return run
