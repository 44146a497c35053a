"""Problem 7: mixing sources to target weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A plan holds one row a source on the driver; more sources than this are refused.
MAX_SOURCES = 100_000
#: The hash line is cut into so many slots for finding where a partial repetition ends.
SLOTS = 4096


@dataclass(frozen=True)
class Share:
    source: str
    target: float  #: target share, over all targets
    tokens: int  #: what the source has
    max_repeats: int
    quota: float  #: tokens to take
    clamped: bool  #: the cap did not allow for more


def water_fill(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> list[Share]:
    """Token quotas of each source with a target.

    A source gives at most its tokens times its cap. Where its share of ``total`` is more, it
    is clamped there and what is missing goes to the others in proportion to their targets,
    until nothing is over a cap or all are clamped. Without ``total`` it is the size of the
    sources with a positive target, or less if only a smaller mix meets all targets; sources
    without tokens then count as clamped at nothing.
    """
    weights = {s: max(0.0, float(w or 0)) for s, (w, _) in targets.items()}
    caps = {s: sizes.get(s, 0) * max(0, int(r or 0)) for s, (_, r) in targets.items()}
    whole = sum(weights.values())
    active = {s for s in targets if weights[s] > 0 and caps[s] > 0}
    if total is None:
        mass = sum(weights[s] for s in active)
        total = min([sum(sizes.get(s, 0) for s in active), *(caps[s] / max(weights[s] / mass, 1e-300) for s in active)]) if active else 0.0
    quota = dict.fromkeys(targets, 0.0)
    clamped = {s for s in targets if weights[s] > 0 and caps[s] == 0}
    left, open_ = float(total), set(active)
    while open_ and left > 0:
        mass = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * (weights[s] / mass) > caps[s] * (1 + 1e-12)}
        if not over:
            for s in open_:
                quota[s] = left * (weights[s] / mass)
            break
        for s in over:
            quota[s] = float(caps[s])
        left -= sum(quota[s] for s in over)
        clamped |= over
        open_ -= over
    return [Share(s, weights[s] / whole if whole else 0.0, sizes.get(s, 0), int(targets[s][1] or 0), quota[s], s in clamped) for s in sorted(targets)]


def plan_mix(sized: DataFrame, weights: DataFrame, total: float | None = None) -> list[Share]:
    """``water_fill`` over a table of sizes: ``source, n_tokens``; weights as in the table.

    Sources without a weight, null sources and rows without tokens take no part. Of several
    weights of a source the greatest share counts.
    """
    rows = weights.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("w")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    targets = {r["source"]: (r["w"]["target_share"], r["w"]["max_repeats"]) for r in rows}
    named = weights.select("source").distinct()
    # as many rows as sources with a weight, which was checked
    sizes = sized.join(F.broadcast(named), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    return water_fill({r["source"]: int(r["n"] or 0) for r in sizes}, targets, total)


def mix(sized: DataFrame, shares: list[Share], id: str = "doc_id", seed: int = 17) -> DataFrame:
    """``id, source, n_tokens, repeats`` of the chosen documents.

    A source's quota is so many whole repetitions of all its documents and a part of one more:
    the documents first on a seeded hash line, as far as their tokens stay within the quota.
    Where the line ends is found from sums over SLOTS slots, of which one row a source is kept,
    then document by document in that one slot, so no task orders a whole source. The result depends on nothing but the rows and
    the seed. Rows with equal ids and sizes follow each other in the line.
    """
    spark = sized.sparkSession
    whole = {s.source: int(s.quota // s.tokens) if s.tokens else 0 for s in shares}
    plan = spark.createDataFrame([(s.source, s.quota - whole[s.source] * s.tokens, whole[s.source], s.max_repeats) for s in shares if s.quota > 0] or [("", 0.0, 0, 0)], "source string, part double, whole int, max_repeats int")
    line = sized.where(F.col("n_tokens") > 0).select(id, "source", "n_tokens").withColumn("__h", F.xxhash64(F.lit(seed), F.col(id), F.col("source"))).withColumn("__slot", F.pmod("__h", F.lit(SLOTS)).cast("int"))
    # a row a source of the plan: at most MAX_SOURCES
    planned = line.join(F.broadcast(plan), "source")
    sums = planned.groupBy("source", "__slot").agg(F.sum("n_tokens").alias("t"), F.first("part").alias("part"))
    before = W.partitionBy("source").orderBy("__slot").rowsBetween(W.unboundedPreceding, 0)
    # the first slot whose end lies beyond the partial repetition: there is one, as the part is less than the whole
    cuts = sums.withColumn("__upto", F.sum("t").over(before)).where(F.col("__upto") > F.col("part")).groupBy("source").agg(F.min(F.struct("__slot", (F.col("__upto") - F.col("t")).alias("at"))).alias("c"))
    ends = cuts.select("source", F.col("c.__slot").alias("__cut"), F.col("c.at").alias("__before"))
    # one row a source again
    placed = planned.join(F.broadcast(ends), "source", "left")
    in_cut = F.coalesce(F.col("__slot") == F.col("__cut"), F.lit(False))
    order = W.partitionBy("source").orderBy("__h", id, "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    last = placed.where(in_cut).withColumn("__sum", F.col("__before") + F.sum("n_tokens").over(order)).withColumn("__extra", (F.col("__sum") <= F.col("part")).cast("int")).drop("__sum")
    # what has no cut, by rounding, is whole
    rest = placed.where(~in_cut).withColumn("__extra", F.coalesce(F.col("__slot") < F.col("__cut"), F.lit(True)).cast("int"))
    chosen = rest.unionByName(last).withColumn("repeats", F.least(F.col("whole") + F.col("__extra"), F.col("max_repeats")))
    return chosen.where(F.col("repeats") > 0).select(id, "source", "n_tokens", "repeats")


def report(chosen: DataFrame, shares: list[Share]) -> DataFrame:
    """``source, target_share, actual_share, tokens, documents, clamped``, one row a source."""
    spark = chosen.sparkSession
    plan = spark.createDataFrame([(s.source, s.target, s.clamped) for s in shares] or [("", 0.0, False)], "source string, target_share double, clamped boolean")
    sums = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"))
    both = plan.join(sums, "source", "left").select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "clamped")
    # one row a source, whose number was checked
    total = F.sum("tokens").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.select("source", "target_share", (F.col("tokens") / F.nullif(total, F.lit(0))).alias("actual_share"), "tokens", "documents", "clamped")
