"""Keys with many vectors: both plans of the distances between two keys."""

import numpy as np

from plumbline.operators import aggregate
from plumbline.plans import vector_queries as v


def test_plans_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), [float(a) for a in rng.normal(size=4)]) for i in range(900)]
    rows += [(7, [1.0, 0.0, 0.0, 0.0]), (8, [float("nan")] * 4), (9, [2.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = [(0, 1), (1, 0), (2, 2), (0, 99), (99, 0), (7, 9), (7, 8), (7, 7), (7, 9)]
    pairs = spark.createDataFrame(asked, "a long, b long")
    for metric in ("ip", "l2sq", "cos"):
        one, two = (sorted(map(str, aggregate.distance_between(frame, pairs, metric, plan=p).collect())) for p in ("expression", "matrix"))
        assert one == two


def test_multi_makes_no_row_a_vector_pair(spark, sf):
    """No join below the summary: vector pairs of two labels are 1 % of all pairs and never become rows."""
    plan = v.distance_between_multi(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "mapinarrow" in plan.lower()
