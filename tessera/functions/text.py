"""Column functions on texts and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.spec import RANK_TEXT_CHARS


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, in index order; 0 if the lengths differ or a side is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def rank_text(kind: Column, content: Column, summary: Column) -> Column:
    """What lexical ranking reads: a document's whole content, else the summary."""
    return F.when((kind == "document") & (F.length(content) > 0), content).otherwise(summary)


def rank_text_start(kind: Column, content: Column, summary: Column) -> Column:
    """What reranking and bm25_stats read: the beginning of rank_text()."""
    return F.substring(rank_text(kind, content, summary), 1, RANK_TEXT_CHARS)


def contains_any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: (t != "") & F.contains(F.lower(text), F.lower(t)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


#: White space at the ends of lines and texts, as a class of a regular expression.
BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def stripped(text: Column) -> Column:
    """text without white space (of any script) at its ends."""
    return F.regexp_replace(text, rf"^{BLANKS}+|{BLANKS}+\z", "")


def is_blank(text: Column) -> Column:
    """Whether text is all white space; it is read up to the first other character."""
    return ~F.rlike(text, F.lit(BLANKS.replace("[", "[^", 1)))


def content_lines(text: Column) -> Column:
    """Lines without white space at their ends, those that aren't blank."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def first_line(text: Column, n: int) -> Column:
    """The first line that isn't blank, cut to n characters."""
    line = F.get(content_lines(text), 0)
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ext == ".go", "go").when(ext == ".py", "python").when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), "jsts").otherwise("generic")


def _fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def bag_of_words_vectors(words: pd.Series, texts: pd.Series, dims: int) -> list[np.ndarray]:
    """Signed hashed counts of each row's words, of unit length; a text without words is one slot."""
    out, known = [], {}
    for row, text in zip(words, texts, strict=True):
        v = np.zeros(dims, np.float32)
        for word in row if row is not None else ():
            h = known.get(word)
            if h is None:
                h = known[word] = _fnv1a(word.encode())
            v[h % dims] += -1 if h >> 63 else 1
        if row is None or not len(row):
            v[_fnv1a((text or "").encode()) % dims] = 1
        norm = float(np.dot(v.astype(np.float64), v.astype(np.float64))) ** 0.5
        out.append(v * np.float32(1 / norm) if norm else v)
    return out


def bag_of_words_embedder(dims: int = 384):
    """A column function of a text: the deterministic embedding that needs no model."""

    @F.pandas_udf("array<float>")
    def embed(words: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(bag_of_words_vectors(words, texts, dims))

    def column(text: Column) -> Column:
        return embed(tokens(text), text)

    column.model = f"mock-bow:{dims}"
    return column
