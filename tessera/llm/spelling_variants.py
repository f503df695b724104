"""Spelling variants: the words of a vocabulary that one edit parts, and the usual form of each.

The vocabulary is laid into blocked Bloom filters, one for each word length (PARTED lengths share the
last), built by pieces of some PIECE_WORDS words in the tasks. A round broadcasts at most FILTER_BYTES
of pieces; a larger vocabulary takes more rounds, each for other pieces, so the broadcast doesn't grow.
Every word's edits are made by arithmetic on its hash: each deletion, probed one length below, and each
replacement by a letter of higher code, probed in its own length. So each pair of words is met once,
from one side, and insertions are the deletions of the other word. Only positives become text and are
shuffled to an exact join with the vocabulary, which takes out false ones. Both words of a pair count it.

A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least
RATIO times its own. Counts grow along forms, so their chains are short and roots are found by doubling
as often as the logarithm of the longest possible chain.

Null words or n take no part. Words of other letters than A-Z, a-z and U+00C0 to U+00FF stay, without
near words; words may be of any length. A word given twice counts as one with the sum of its n. Empty
tables give no rows; extra columns are ignored. Null texts have no words; a null doc_id is an empty
text in hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import mix, stored, table

RATIO, LEAST_LENGTH, LEAST_COUNT = 10, 7, 2
LETTERS = "A-Za-zÀ-ÿ"
#: Bits of a filter for each word, words of a piece, lengths from which on words share a filter, and
#: bytes of filters that are broadcast at a time.
WORD_BITS, PIECE_WORDS, PARTED, FILTER_BYTES = 16, 1 << 14, 64, 32 << 20
BLOCK_WORDS = 8  # 32-bit words of a block; an entry sets one bit in each
PIECE_BLOCKS = PIECE_WORDS * WORD_BITS // (32 * BLOCK_WORDS)
PIECE_BYTES = PIECE_BLOCKS * BLOCK_WORDS * 4
#: Edits that a task holds in arrays at a time.
EDITS = 1 << 20

_DRAW = np.random.default_rng(1207)
_LETTER = _DRAW.integers(1, 2**63, 256, dtype=np.uint64)
_SALT = (_DRAW.integers(1, 2**31, BLOCK_WORDS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 2**64))


def powers(n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), _BASE, np.uint64))))[:n]


def raw_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length as a matrix of letters: each place's share of the hash, and the sums
    before each place and at the end."""
    share = _LETTER[codes] * powers(codes.shape[1])
    return share, np.concatenate((np.zeros((len(codes), 1), np.uint64), np.cumsum(share, axis=1)), axis=1)


class Filters:
    """The filters' layout: pieces of all lengths on end; bits: those of pieces lo to hi, or None."""

    def __init__(self, counts: dict[int, int], bits: bytes | None = None, lo: int = 0, hi: int = 0):
        self.first, self.size, at = {}, {}, 0
        for length in sorted(counts):
            self.first[length], self.size[length] = at, -(-counts[length] // PIECE_WORDS)
            at += self.size[length]
        self.pieces, self.lo, self.hi = at, lo, hi
        self.bits = None if bits is None else np.frombuffer(bits, np.uint32)

    def places(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block (among all) and low half of each mixed hash of words of this length."""
        length = min(length, PARTED)
        blocks = np.uint64(self.size[length] * PIECE_BLOCKS)
        block = ((hashes >> np.uint64(32)) * blocks >> np.uint64(32)).astype(np.int64) + self.first[length] * PIECE_BLOCKS
        return block, (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def hits(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Places in hashes of those that the held pieces may contain."""
        if min(length, PARTED) not in self.size:
            return np.zeros(0, np.int64)
        block, low = self.places(hashes, length)
        at = np.flatnonzero((block >= self.lo * PIECE_BLOCKS) & (block < self.hi * PIECE_BLOCKS)) if (self.lo, self.hi) != (0, self.pieces) else np.arange(len(block))
        for k in range(BLOCK_WORDS):
            word = self.bits[(block[at] - self.lo * PIECE_BLOCKS) * BLOCK_WORDS + k]
            at = at[(word >> (low[at] * _SALT[k] >> np.uint32(27))) & np.uint32(1) == 1]
        return at


def _of_length(batch: pa.RecordBatch):
    """The batch's words by length: length, their rows, matrix of letters."""
    words = batch.column("word").to_pylist()
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for length, rows in by_length.items():
        step = max(1, EDITS // (16 * length))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            raw = "".join(words[k] for k in part).encode("latin-1")
            yield length, np.array(part), np.frombuffer(raw, np.uint8).reshape(len(part), length)


def _entries(counts: dict[int, int]):
    layout = Filters(counts)

    def run(batches):
        for batch in batches:
            for length, _, codes in _of_length(batch):
                block, low = layout.places(mix(raw_hashes(codes)[1][:, -1]), length)
                yield pa.record_batch([pa.array(block // PIECE_BLOCKS), pa.array((block % PIECE_BLOCKS).astype(np.int32)), pa.array(low.astype(np.int64))], names=["piece", "block", "low"])

    return run


def _piece(rows: pd.DataFrame) -> pd.DataFrame:
    """The bits of one piece from its entries."""
    bits, block, low = np.zeros(PIECE_BLOCKS * BLOCK_WORDS, np.uint32), rows["block"].to_numpy(np.int64), rows["low"].to_numpy().astype(np.uint32)
    for k in range(BLOCK_WORDS):
        np.bitwise_or.at(bits, block * BLOCK_WORDS + k, np.uint32(1) << (low * _SALT[k] >> np.uint32(27)))
    return pd.DataFrame({"piece": rows["piece"].iloc[:1], "bits": [bits.tobytes()]})


def _texts(codes: np.ndarray) -> list[str]:
    width = codes.shape[1]
    text = codes.tobytes().decode("latin-1")
    return [text[k : k + width] for k in range(0, len(text), width)]


def _edits(codes: np.ndarray, letters: np.ndarray, filters: Filters):
    """Positives among the edits of words of one length: row of the word, text of the edit."""
    m, length = codes.shape
    share, before = raw_hashes(codes)
    total, power = before[:, -1], powers(length)
    rows = max(1, EDITS // length)
    for at in range(0, m, rows):
        to = min(m, at + rows)
        if length > 1:
            left = mix(before[at:to, :-1] + (total[at:to, None] - before[at:to, 1:]) * _BACK).ravel()
            hit = filters.hits(left, length - 1)
            w, i = hit // length + at, hit % length
            new = (i == 0) | (codes[w, i] != codes[w, i - 1])  # of a run of one letter the first
            w, i = w[new], i[new]
            if len(w):
                keep = np.ones((len(w), length), bool)
                keep[np.arange(len(w)), i] = False
                yield w, _texts(codes[w][keep].reshape(len(w), length - 1))
    flat = codes.ravel()
    for letter in np.unique(flat):
        higher = letters[letters > letter]
        places = np.flatnonzero(flat == letter)
        step = max(1, EDITS // max(1, len(higher)))
        for at in range(0, len(places) if len(higher) else 0, step):
            p = places[at : at + step]
            w, i = p // length, p % length
            made = mix((total[w] - share[w, i])[:, None] + _LETTER[higher][None, :] * power[i][:, None]).ravel()
            hit = filters.hits(made, length)
            if len(hit):
                r = hit // len(higher)
                out = codes[w[r]].copy()
                out[np.arange(len(r)), i[r]] = higher[hit % len(higher)]
                yield w[r], _texts(out)


def _probe(counts: dict[int, int], letters: np.ndarray, held, lo: int, hi: int):
    def run(batches):
        filters = Filters(counts, held.value, lo, hi)
        for batch in batches:
            n = batch.column("n").to_numpy()
            words = batch.column("word")
            for length, rows, codes in _of_length(batch):
                for w, texts in _edits(codes, letters, filters):
                    at = rows[w]
                    yield pa.record_batch([pa.array(texts, pa.string()), words.take(pa.array(at)), pa.array(n[at])], names=["edit", "word", "n"])

    return run


def _letters(batches):
    seen = np.zeros(256, bool)
    for batch in batches:
        for _, _, codes in _of_length(batch):
            seen[np.unique(codes)] = True
    yield pa.record_batch([pa.array(np.flatnonzero(seen))], names=["letter"])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words (word, n; stored, distinct) that one edit parts, once."""
    spark = words.sparkSession
    words = words.select("word", "n").filter(F.col("word").rlike(f"^[{LETTERS}]+$"))
    sizes = words.groupBy(F.least(F.char_length("word"), F.lit(PARTED)).alias("k")).agg(F.count("*").alias("n")).collect()  # PARTED rows at most
    counts = {r["k"]: r["n"] for r in sizes}
    letters = np.array(sorted({r["letter"] for r in words.mapInArrow(_letters, "letter long").distinct().collect()}), np.uint8)  # 256 at most
    pieces = stored(words.mapInArrow(_entries(counts), "piece long, block int, low long").groupBy("piece").applyInPandas(_piece, "piece long, bits binary"))
    total, held = Filters(counts).pieces, FILTER_BYTES // PIECE_BYTES
    edits = None
    for lo in range(0, max(total, 1), held):
        hi, bits = min(lo + held, total), np.zeros((min(held, max(total - lo, 0)), PIECE_BYTES), np.uint8)
        for r in pieces.filter(F.col("piece").between(lo, hi - 1)).collect():  # FILTER_BYTES at most
            bits[r["piece"] - lo] = np.frombuffer(r["bits"], np.uint8)
        found = words.mapInArrow(_probe(counts, letters, spark.sparkContext.broadcast(bits.tobytes()), lo, hi), "edit string, word string, n long")
        edits = found if edits is None else edits.unionByName(found)
    exact = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    return edits.join(exact, "edit").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("edit").alias("b"), F.col("edit_n").alias("b_n"))


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of each different word of words (word, n)."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")).dropna().groupBy("word").agg(F.sum("n").alias("n")))
    a, b = (F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba"))
    sides = near_pairs(words).select(F.explode(F.array(a, b)).alias("s")).select("s.*")
    # Most near words are no forms: only those that can be are compared as text.
    may = F.when(F.col("near_n") >= ratio * F.col("n"), F.struct((-F.col("near_n")).alias("m"), "near"))
    near = stored(sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(may).alias("best")))
    near = near.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))
    forms = near.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest = math.log(max(2, words.agg(F.max("n")).first()[0] or 2), ratio)  # steps that a chain can have
    for _ in range(max(0, math.ceil(math.log2(max(1.0, longest))))):
        above = forms.select(F.col("word").alias("root"), F.col("root").alias("top"))
        forms = stored(forms.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root")))
    out = words.join(near, "word", "left").join(forms, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def damaged_words(docs: DataFrame) -> DataFrame:
    """word, n: the contract's vocabulary, each run damaged by the hash of its document and itself.
    Runs of fewer than LEAST_LENGTH letters can't become words and aren't taken."""
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}+"), F.lit(0))).alias("run"))
    runs = runs.select("id", lower.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = F.expr("concat(substring(run, 1, cast(h % char_length(run) as int)), substring(run, cast(h % char_length(run) as int) + 2))")
    words = runs.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).filter((F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(damaged_words(table(spark, sf_dir, "documents")))


#: Near words share a text with one place marked (replacements) or left out (deletions).
ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
long AS (SELECT id, run, count(*) AS times, hex(encode(id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (SELECT run, times, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h FROM long, crc),
hurt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed),
v AS (SELECT word, sum(times)::BIGINT AS n FROM hurt GROUP BY word HAVING length(word) >= 7 AND sum(times) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM (SELECT *, left(word, i - 1) || '*' || substr(word, i + 1) AS k FROM places) a JOIN (SELECT *, left(word, i - 1) || '*' || substr(word, i + 1) AS k FROM places) b ON a.k = b.k AND a.word <> b.word
  UNION SELECT p.word, v.word, v.n FROM places p JOIN v ON left(p.word, i - 1) || substr(p.word, i + 1) = v.word
  UNION SELECT v.word, p.word, p.n FROM places p JOIN v ON left(p.word, i - 1) || substr(p.word, i + 1) = v.word),
counted AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY word),
forms AS (SELECT p.word, near AS form, near_n AS form_n FROM pairs p JOIN v USING (word) WHERE near_n >= 10 * v.n QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY near_n DESC, encode(near)) = 1),
climb AS (SELECT word, word AS top FROM v UNION ALL SELECT c.word, f.form FROM climb c JOIN forms f ON c.top = f.word),
roots AS (SELECT c.word, top AS root FROM climb c WHERE NOT EXISTS (SELECT 1 FROM forms f WHERE f.word = c.top))
SELECT v.word, form, root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN forms USING (word) LEFT JOIN counted USING (word) JOIN roots USING (word)
"""
