"""Spelling variants against edits made one by one and against SQL."""

import random
import zlib

import duckdb
import pytest

from tessera.llm import spelling_variants as V

LETTERS = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100))]


def near(word, words):
    """Words that one inserted, deleted or replaced letter parts from word."""
    out = set()
    for i in range(len(word) + 1):
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
            out |= {word[:i] + c + word[i + 1 :] for c in LETTERS}
        out |= {word[:i] + c + word[i:] for c in LETTERS}
    return (out & words) - {word}


def plain(counts):
    out = {}
    for w, n in counts.items():
        others = near(w, counts.keys())
        best = min(((-counts[x], x) for x in others), default=None)
        out[w] = (best[1], -best[0]) if best and -best[0] >= 10 * n else (None, None), len(others)
    rows = []
    for w, n in counts.items():
        root = w
        while out[root][0][0]:
            root = out[root][0][0]
        rows.append((w, out[w][0][0], root, n, out[w][1], out[w][0][1]))
    return sorted(rows)


def test_variants_equal_plain_edits_in_several_rounds(spark, monkeypatch):
    draw = random.Random(3)
    counts = {}
    for _ in range(300):
        w = "".join(draw.choice("abzÀÿé") for _ in range(draw.randint(1, 6)))
        counts[w] = 10 ** draw.randint(0, 4) + draw.randint(0, 1)
    counts |= {"x" * 80: 500, "x" * 79: 5, "x" * 81: 50, "y" * 3000: 2, "y" * 3001: 20, "aaa": 7, "aaaa": 7}
    rows = [(w, n, "clash") for w, n in counts.items()] + [(None, 3, ""), ("abc", None, "")]
    want = plain(counts)
    df = spark.createDataFrame(rows, "word string, n long, form string")
    for size in (V.FILTER_BYTES, V.PIECE_BYTES):  # all at once; a piece a round
        monkeypatch.setattr(V, "FILTER_BYTES", size)
        got = sorted(map(tuple, V.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()))
        assert got == want


def test_words_given_twice_other_letters_and_empty_tables(spark):
    rows = [("good", 40), ("good", 60), ("goof", 10), ("тест", 5), ("тесты", 500)]
    got = {r["word"]: r for r in V.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["good"]["n"] == 100 and got["goof"]["form"] == got["goof"]["root"] == "good" and got["goof"]["form_n"] == 100
    assert got["тест"]["n_near"] == 0 and got["тест"]["root"] == "тест"
    assert V.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    docs = spark.createDataFrame([(1, None), (None, "Abcdefgh, abcdefgh abcdef"), (2, ""), (2, "")], "doc_id long, text string")
    assert zlib.crc32(b":abcdefgh") % 31  # so the run stays as it is
    assert [(r["root"], r["n"]) for r in V.spelling_variants(V.damaged_words(docs)).collect()] == [("abcdefgh", 2)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    got = V.op12_spelling_variants(spark, f"/root/testdata/{sf}")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, db.execute(V.ORACLE).fetchall()))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
