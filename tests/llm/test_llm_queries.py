"""The registered queries on whole small tables: columns, types and plain recomputations."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_jaccard_join": "doc_id bigint, class_id bigint, copy_id bigint, n_links bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op9_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
}


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_whole_tables(spark, texts, name):
    got = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes).startswith(COLUMNS[name])
    rows = got.toPandas()
    assert set(rows["doc_id"]) == set(texts)
    if "held_out" in rows:
        assert (rows["held_out"] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in rows["doc_id"]]).all()
        assert (rows["predicted"] == (rows["score"] >= (0.3 if name == "op1_quality" else 0.5))).all() and rows["score"].between(0, 1).all()


def plain_ids(texts, name, end):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    return {k: np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4") for k, t in texts.items()}


def test_packed_pieces_hold_every_id_once(spark, texts):
    ids = plain_ids(texts, "word_bpe_49k.json", 2)
    rows = queries.QUERIES["op2_packing"](spark, SF).toPandas()
    for doc, part in rows.groupby("doc_id"):
        part, at = part.sort_values("start"), 0
        for r in part.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc]) and r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])
    padding = 0
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        n = int(part["length"].sum())
        assert (part["offset"] == part["length"].cumsum() - part["length"]).all() and n <= 4096
        padding += 4096 - n if n & (n - 1) else 0
    assert padding <= 0.02 * sum(map(len, ids.values()))


def test_token_files_equal_plain_encoding(spark, texts):
    ids = plain_ids(texts, "byte_bpe_50k.json", 0)
    rows = queries.QUERIES["op9_token_files"](spark, SF).toPandas().sort_values("doc_id")
    start = 0
    for r in rows.itertuples():
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        start += r.n_tokens


def test_hits_by_brute_force(spark, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall():
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    for r in queries.QUERIES["op6_decontamination"](spark, SF).collect():
        w, hit, items = words(texts[r["doc_id"]]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= found
        want = len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
