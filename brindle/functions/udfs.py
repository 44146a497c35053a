"""Functions that Spark has no built-in for, as vectorised user functions."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from brindle.functions.blake3 import blake3
from brindle.sources.shared import ship_code


def _digest(name: str):
    def run(v: pd.Series) -> pd.Series:
        make = blake3 if name == "blake3" else lambda b: getattr(hashlib, name)(b).digest()
        return v.map(lambda x: None if x is None else make(bytes(x)))

    return run


def _plain(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M"))


def _unaccent(v: pd.Series) -> pd.Series:
    return v.map(_plain)


def register_udfs(spark: SparkSession) -> None:
    """Makes ``pg_blake2b``, ``pg_blake2s`` and ``pg_blake3`` (binary to binary) and
    ``pg_unaccent`` (texts) known to ``spark.sql``."""
    ship_code(spark)
    for name, run, kind in (*((n, _digest(n), "binary") for n in ("blake2b", "blake2s", "blake3")), ("unaccent", _unaccent, "string")):
        if not spark.catalog.functionExists(f"pg_{name}"):
            spark.udf.register(f"pg_{name}", F.pandas_udf(run, kind))
