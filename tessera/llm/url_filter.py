"""Operator 8: URL filters by rules and, where none fits, logistic regression on hashed n-grams.

The features of a URL are the runs of 3, 4 and 5 bytes of its host and of its path, hashed to
2^15 buckets, each counted once per place. Weights are trained on a small table of labelled URLs.

A null url, or one without ://, has empty host and path and the model's verdict of them. Null and
repeated page_ids are kept; URLs of any length are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import slices, table, text_bytes

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
BUCKETS = 1 << 15

#: What the labelled table is made of: words of unwanted hosts, words of wanted ones, and wanted hosts
#: that hold a part of an unwanted word.
_UNWANTED = """casino poker slots jackpot roulette blackjack betting bets sportsbook bookmaker gambling baccarat lotto-win
pills viagra cialis xanax tramadol steroids cheap-meds diet-pills slimming-tea porn porno xxx sexcam sex-chat escorts hentai nudes
hot-girls camgirls webcam-girls adult-video adult-chat hookup milf fetish ads adserver ad-track adclick popads banner-ads clickbait
clicktrack tracking-pixel tracker-ads spy-pixel spam spammer link-farm backlinks seo-links buy-followers malware phishing
verify-account secure-login-update wallet-unlock free-gift prize-winner you-won crypto-doubler payday-loans fast-loans quick-cash
get-rich forex-signals replica-watches fake-rolex replica-bags warez crackz keygen serial-crack torrentz nulled free-downloadz""".split()
_WANTED = """news daily-post garden school library science history museum weather recipes travel books music sports health city-council
university research forum wiki archive journal planet river forest kitchen market studio theatre gazette atlas harbour meadow cooking
gardening woodwork cycling hiking football cricket chess physics chemistry biology astronomy geology philosophy poetry novels painting
photography architecture engineering software developer python-docs linux database hospital clinic dentist pharmacy-school nursing
charity church parish village county museum-of-art orchestra choir railway airport bakery brewery vineyard farm dairy fishing sailing
insurance bank credit-union savings tax-office parliament court law-review police fire-brigade kindergarten teacher student alumni
campus academy institute laboratory observatory zoo aquarium botanic heritage folklore language dictionary grammar translation
documentary cinema radio television newspaper magazine editor publisher printing paper furniture carpentry textile knitting pottery""".split()
_NEAR = """adult-learning adulteducation adult-literacy tracker-museum animal-tracker track-and-field trackside essex sussex-news
middlesex unisex-salon sextant-maps slot-car-racing time-slots pillow-shop caterpillars spillway girls-school girl-guides
addresses adelaide adventure address-book badminton broadcast academic-adviser betterment alphabet tibet diabetes-care
crackers-and-cheese nutcracker loanwords student-loan-advice replica-ships museum-replicas spamalot-musical winner-chess prize-essay
cash-flow-accounting giftwrap free-library free-verse watches-and-clocks signals-museum video-archive chatham chateau
pixel-art hot-springs farmers link-road escort-ships fast-trains rich-text wallets-leather unlocking-literature""".split()
_AROUND = ["{}", "my{}", "{}-online", "best-{}", "{}24", "the-{}", "{}s", "{}-world", "top-{}", "{}hub"]
_PARENTS = ["example.com", "example.net", "example.org", "com", "net", "org", "info"]
_PATHS = ["/", "/12", "/345.html", "/6/", "/about", "/articles/2023/05/story", "/index.html", "/a/b?c"]


def labelled_urls() -> list[tuple[str, str, int]]:
    """host, path, 1 for unwanted: each word in several surroundings under several parent domains."""
    out = []
    for label, words in ((1, _UNWANTED), (0, _WANTED + _NEAR)):
        for k, word in enumerate(words):
            for j, around in enumerate(_AROUND):
                name = around.format(word if (j + k) % 3 else word.replace("-", ""))
                host = f"{('', 'www.', 'm.')[(k + j) % 3]}{name}.{_PARENTS[(3 * k + j) % len(_PARENTS)]}"
                out.append((host, _PATHS[(k + 3 * j) % len(_PATHS)], label))
    return out


def grams(texts: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every run of 3, 4 and 5 bytes of ^text$."""
    raw, ends = text_bytes(texts)
    lens = np.diff(ends) + 2
    first = np.cumsum(lens) - lens
    data = np.zeros(int(lens.sum()), np.uint64)
    data[first], data[first + lens - 1] = 94, 36
    inner = np.ones(len(data), bool)
    inner[first] = inner[first + lens - 1] = False
    data[inner] = raw
    doc = np.repeat(np.arange(len(lens)), lens)
    buckets, docs, h = [], [], data + np.uint64(salt)
    for n in range(2, 6):
        h = h[:-1] * np.uint64(0x100000001B3) ^ data[n - 1 :]
        if n >= 3:
            whole = doc[: len(h)] == doc[n - 1 :]
            buckets.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49))[whole].astype(np.int64))
            docs.append(doc[: len(h)][whole])
    return np.concatenate(buckets), np.concatenate(docs)


def scores(hosts: pa.Array, paths: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    z = np.full(len(hosts), bias)
    for texts, salt in ((hosts, 1), (paths, 2)):
        bucket, doc = grams(texts, salt)
        z += np.bincount(doc, weights[bucket], len(hosts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[str, str, int]]) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias: gradient descent on the logistic loss with a ridge."""
    hosts, paths = pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows])
    y, n = np.array([x[2] for x in rows], float), len(rows)
    bucket, doc = (np.concatenate(x) for x in zip(grams(hosts, 1), grams(paths, 2), strict=True))
    w, bias = np.zeros(BUCKETS), -1.0
    rate = 8.0 / n  # both labels' rows are few and short, so plain gradient steps do
    for _ in range(300):
        z = bias + np.bincount(doc, w[bucket], n)
        miss = y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        w += rate * (np.bincount(bucket, miss[doc], BUCKETS) - 0.2 * w)
        bias += 0.02 * (miss.mean() - 0.2 * (bias + 1))
    return w, float(bias)


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[str, str, int]], url: str = "url") -> DataFrame:
    """pages with host, path, block_score, rule and verdict."""
    weights, bias = train(labelled)
    df = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    schema = T.StructType([*df.schema.fields, T.StructField("block_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for rows in slices(batch, url):
                got = scores(rows.column("host"), rows.column("path"), weights, bias)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got)], names=[*rows.schema.names, "block_score"])

    df = df.mapInArrow(run, schema)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # the longest comes last and wins
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return df.withColumns({"rule": rule, "verdict": verdict})


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url")
    return filter_urls(pages, RULES, labelled_urls()).select("page_id", "host", "path", "rule", "verdict", "block_score")
