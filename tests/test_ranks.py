"""Percentiles and weighted medians by ranges against numpy, on ties, hot groups, nulls and single values."""

import random

import numpy as np
import pytest

from tangency.operators import ranks

POINTS = {"min": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "max": 1.0}


@pytest.mark.parametrize("ranges", [1, 7, 1024])
def test_percentiles_by_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [("hot", rng.choice([1.5, rng.gauss(0, 1e6), -3.0])) for _ in range(2000)] + [("one", 4.0), ("ties", 2.0), ("ties", 2.0), ("none", None), ("none", float("nan")), (None, 1.0), (None, 2.0)]
    rows += [("few", float(x)) for x in (1, 2, 10)] + [("few", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(4)
    found = {r.g: r for r in ranks.percentiles(table, "v", POINTS, ["g"], ranges).collect()}
    wanted = {}
    for g, v in rows:
        if v is not None and v == v:
            wanted.setdefault(g, []).append(v)
    assert {g: r.n for g, r in found.items()} == {g: len(v) for g, v in wanted.items()}
    for g, values in wanted.items():
        for name, p in POINTS.items():
            assert found[g][name] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)
    [r] = ranks.percentiles(table, "v", POINTS, (), ranges).collect()
    every = [v for _, v in rows if v is not None and v == v]
    assert r.n == len(every) and r.p50 == pytest.approx(np.percentile(every, 50))
    assert ranks.percentiles(table.limit(0), "v", POINTS, ["g"]).count() == 0


@pytest.mark.parametrize("ranges", [1, 5, 1024])
def test_weighted_median_by_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i % 3, float(rng.randrange(50)), rng.randrange(5)) for i in range(900)] + [(7, 1.0, 0), (8, None, 3), (9, 2.0, 1), (9, 5.0, 1)]
    table = spark.createDataFrame(rows, "g int, v double, w long").repartition(3)
    found = {r.g: r.weighted_median for r in ranks.weighted_median(table, "v", "w", ["g"], ranges).collect()}
    for g in (0, 1, 2):
        own = sorted((v, w) for h, v, w in rows if h == g and w)
        run, half = 0, sum(w for _, w in own) / 2
        for v, w in own:
            run += w
            if run >= half:
                break
        assert found[g] == v
    assert set(found) == {0, 1, 2, 9} and found[9] == 2.0
