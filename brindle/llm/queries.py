"""Registered queries of the text problems (p6 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mixing, pii, tokens
from brindle.sources.shared import work_dir
from brindle.sources.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document by the public byte-level vocabulary."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's ids decode to its text again."""
    encoded = tokens.encode(table(spark, sf_dir, "documents"), keep=["text"])
    back = tokens.decode(encoded, keep=["text"], as_name="decoded")
    return back.select("doc_id", F.length("decoded").cast("long").alias("n_chars"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p6_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip where no word is in the dictionary: all ids come back by the join by position."""
    encoded = tokens.encode(table(spark, sf_dir, "documents"), keep=["text"], dictionary_bytes=0)
    back = tokens.decode(encoded, keep=["text"], as_name="decoded")
    return back.select("doc_id", F.length("decoded").cast("long").alias("n_chars"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p7_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix of 1.6 times the weighted sources, for which small ones are clamped and
    what they lack goes to the others, in several rounds."""
    sized = _sized(spark, sf_dir)
    weights = table(spark, sf_dir, "source_weights")
    weighted = sized.join(F.broadcast(weights.select("source").distinct()), "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0
    shares = mixing.plan_mix(sized, weights, 1.6 * weighted)
    return mixing.report(mixing.mix(sized, shares), shares)


def p7_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The water-filling itself, with sizes in characters, at 1.6 times the weighted sources."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", F.char_length("text").cast("long").alias("n_tokens"))
    weights = table(spark, sf_dir, "source_weights")
    weighted = sized.join(F.broadcast(weights.select("source").distinct()), "source", "left_semi").agg(F.sum("n_tokens")).first()[0] or 0
    rows = [(s.source, round(s.quota / weighted, 9) if weighted else 0.0, s.clamped) for s in mixing.plan_mix(sized, weights, 1.6 * weighted)]
    return spark.createDataFrame(rows, "source string, share double, clamped boolean")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = work_dir(spark, "p7")
    tokens.encode(table(spark, sf_dir, "documents"), count_only=True, keep=["source"]).write.parquet(at)
    return spark.read.parquet(at)


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[mixing.Share]]:
    sized = _sized(spark, sf_dir)
    shares = mixing.plan_mix(sized, table(spark, sf_dir, "source_weights"))
    return mixing.mix(sized, shares), shares


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return _mix(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.report(*_mix(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of personal information in the documents, by place."""
    found = pii.find_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.char_start", "s.char_end")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a typed placeholder for each piece."""
    return pii.find_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_parts"), with_text=True).select("doc_id", F.size("spans").alias("n_found"), "redacted")


QUERIES = {f.__name__: f for f in (p6_ids, p6_roundtrip, p6_joined, p7_mix, p7_shares, p7_clamped, p7_quotas, p8_found, p8_redacted)}

ORACLE = {
    "p6_roundtrip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, true AS same FROM documents",
    # sources by the level at which they are full; those that are full below the level that gives the total are clamped
    "p7_quotas": """WITH w AS (SELECT source, max(target_share) AS w, arg_max(max_repeats, target_share) AS r FROM source_weights WHERE source IS NOT NULL GROUP BY source),
      z AS (SELECT w.source, w, r, coalesce(sum(length(text)), 0) AS n FROM w LEFT JOIN documents d ON d.source = w.source GROUP BY ALL),
      t AS (SELECT 1.6 * sum(n) AS total, sum(n) AS whole FROM z), c AS (SELECT *, n * r AS cap, CASE WHEN w > 0 THEN n * r / w END AS full_at FROM z),
      s AS (SELECT *, sum(cap) OVER (ORDER BY full_at, source ROWS UNBOUNDED PRECEDING) AS below, sum(w) OVER () - sum(w) OVER (ORDER BY full_at, source ROWS UNBOUNDED PRECEDING) AS above FROM c WHERE w > 0),
      k AS (SELECT *, below + full_at * above < (SELECT total FROM t) AS clamped FROM s),
      l AS (SELECT ((SELECT total FROM t) - coalesce(sum(cap) FILTER (WHERE clamped), 0)) / sum(w) FILTER (WHERE NOT clamped) AS level FROM k)
      SELECT z.source, round(CASE WHEN k.clamped THEN cap ELSE coalesce(k.w * (SELECT level FROM l), 0) END / (SELECT whole FROM t), 9) AS share, coalesce(k.clamped, false) AS clamped FROM z LEFT JOIN k ON k.source = z.source""",
}
ORACLE["p6_joined"] = ORACLE["p6_roundtrip"]
