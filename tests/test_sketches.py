import math
from datetime import date, timedelta

import numpy as np
import pytest

from topicflow.operators import sketches


@pytest.mark.parametrize("alpha", [0.01, 0.05])
def test_span_quantiles_within_alpha(spark, alpha):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(3, 2, 3000), -rng.lognormal(0, 1, 300), np.zeros(50), rng.uniform(0, 1e-3, 100)])
    rng.shuffle(values)
    days = [date(2024, 1, 1) + timedelta(days=int(d)) for d in rng.integers(0, 30, len(values))]
    rows = [(d.isoformat() + " 12:00:00", float(v)) for d, v in zip(days, values)] + [("2024-01-02 00:00:00", None)]
    df = spark.createDataFrame(rows, "ts string, value double").selectExpr("CAST(ts AS timestamp) AS ts", "value")
    sketch = sketches.daily_sketch(df, "ts", "value", alpha).cache()
    assert sketch.groupBy("day").count().agg({"count": "max"}).first()[0] < 1500
    qs = [0.01, 0.5, 0.95, 0.99]
    for start, end in [(None, None), ("2024-01-05", "2024-01-11")]:
        got = sketches.quantiles(sketches.merge(sketch, start, end), qs, alpha).first()
        chosen = np.array(
            [v for d, v in zip(days, values) if (start is None or d >= date.fromisoformat(start)) and (end is None or d <= date.fromisoformat(end))]
        )
        exact = np.sort(chosen)
        assert got["n"] == len(exact)
        for q in qs:
            want = exact[max(math.ceil(q * len(exact)), 1) - 1]
            assert abs(got[f"q{round(q * 100):02d}"] - want) <= alpha * abs(want) + 1e-12


def test_empty_span(spark):
    df = spark.createDataFrame([], "ts timestamp, value double")
    got = sketches.quantiles(sketches.merge(sketches.daily_sketch(df, "ts", "value")), [0.5]).first()
    assert got["n"] is None and got["q50"] is None
