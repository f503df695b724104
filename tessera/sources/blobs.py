"""Content by hash, with optional encryption at rest."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_blobs(texts: DataFrame, column: str = "content") -> DataFrame:
    """hash, n_bytes, copies of each distinct content; rows meet by hash, so long texts aren't shuffled."""
    rows = texts.filter(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("hash"), F.octet_length(column).cast("long").alias("n_bytes"))
    return rows.groupBy("hash").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("copies"))


def new_blobs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Of incoming (hash, content) what isn't stored yet, once each."""
    return incoming.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def seal(content: Column, key: Column, aad: Column) -> Column:
    return F.aes_encrypt(content, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad)


def unseal(sealed: Column, key: Column, aad: Column) -> Column:
    return F.aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def read_key(text: str) -> bytes:
    """A key of 32 bytes from its text: 64 hex digits, base64, or the bytes themselves."""
    text = text.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{64}", text):
        return bytes.fromhex(text)
    if re.fullmatch(r"[A-Za-z0-9+/]{43}=", text):
        return base64.b64decode(text)
    if len(raw := text.encode()) == 32:
        return raw
    raise ValueError("a key has 32 bytes, in hex, in base64 or as they are")
