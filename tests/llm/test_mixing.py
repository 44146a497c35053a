"""Source mixing: quotas, caps and sampled repetitions."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.mixing import mix, plan_mix, report, water_fill

SIZED = "doc_id bigint, source string, n_tokens bigint, target_share string"
WEIGHTS = "source string, target_share double, max_repeats int"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 1000), st.one_of(st.just(0.0), st.floats(1e-9, 1)), st.integers(0, 5))), st.one_of(st.none(), st.floats(0, 5000)))
def test_water_filling(parts, total):
    sizes, targets = {s: n for s, (n, _, _) in parts.items()}, {s: (w, r) for s, (_, w, r) in parts.items()}
    shares = water_fill(sizes, targets, total)
    for s in shares:
        assert -1e-6 <= s.quota <= s.tokens * s.max_repeats * (1 + 1e-9) + 1e-6
    got, most = sum(s.quota for s in shares), sum(s.tokens * s.max_repeats for s in shares if s.target > 0)
    if total is not None:
        assert abs(got - min(total, most)) <= 1e-6 * max(1.0, total)
    # what is not clamped keeps the proportions of the targets
    free = [s for s in shares if not s.clamped and s.target > 0 and s.quota > 0]
    for a, b in zip(free, free[1:]):
        assert abs(a.quota * b.target - b.quota * a.target) <= 1e-6 * max(1.0, got)


def test_excess_goes_to_the_others():
    shares = {s.source: s for s in water_fill({"a": 100, "b": 1000, "c": 1000}, {"a": (0.5, 2), "b": (0.25, 1), "c": (0.25, 1)}, 1000)}
    assert shares["a"].quota == 200 and shares["a"].clamped
    assert shares["b"].quota == shares["c"].quota == 400


def test_smaller_total_that_meets_all_targets():
    shares = water_fill({"a": 100, "b": 10_000}, {"a": (0.5, 2), "b": (0.5, 1)})
    assert [s.quota for s in shares] == [200, 200] and not any(s.clamped for s in shares)


def docs(spark, rows):
    return spark.createDataFrame([(i, s, n, "clash") for i, (s, n) in enumerate(rows)], SIZED)


def test_mix_meets_shares_and_caps(spark):
    rows = [("big", 10)] * 3000 + [("small", 10)] * 100 + [("tiny", 7)] * 3 + [("none", 5)] * 50 + [(None, 10)] * 20 + [("big", 0), ("big", None)]
    sized = docs(spark, rows)
    weights = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("tiny", 0.1, 5), ("absent", 0.0, 2), ("small", 0.2, 9), (None, 0.5, 1)], WEIGHTS)
    shares = plan_mix(sized, weights, total=10_000)
    chosen = mix(sized, shares)
    got = {r.source: r for r in report(chosen, shares).collect()}
    assert {s.source: s.clamped for s in shares} == {"absent": False, "big": False, "small": False, "tiny": True}
    assert got["tiny"].tokens == 105
    assert abs(got["big"].tokens / got["small"].tokens - 2) < 0.02
    caps = {"big": 1, "small": 4, "tiny": 5}
    for r in chosen.collect():
        assert 1 <= r.repeats <= caps[r.source] and r.n_tokens > 0
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9


def test_mix_depends_on_the_seed_only(spark):
    sized = docs(spark, [("a", 1 + i % 5) for i in range(400)])
    shares = plan_mix(sized, spark.createDataFrame([("a", 1.0, 3)], WEIGHTS), total=700)
    one = sorted(map(tuple, mix(sized, shares).collect()))
    two = sorted(map(tuple, mix(sized.repartition(7), shares).collect()))
    other = sorted(map(tuple, mix(sized, shares, seed=99).collect()))
    assert one == two != other
    assert 695 <= sum(n * r for _, _, n, r in one) <= 700


def test_nothing(spark):
    sized = docs(spark, [])
    shares = plan_mix(sized, spark.createDataFrame([("a", 1.0, 3)], WEIGHTS))
    assert mix(sized, shares).count() == 0
    assert [(r.source, r.actual_share, r.tokens) for r in report(mix(sized, shares), shares).collect()] == [("a", None, 0)]
    none = plan_mix(docs(spark, [("a", 5)]), spark.createDataFrame([], WEIGHTS))
    assert none == [] and mix(docs(spark, [("a", 5)]), none).count() == 0
