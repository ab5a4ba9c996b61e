"""The significance order holds every splat, in the order of the compact file."""

import pytest

from ombrix.operators import export
from ombrix.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_significance_order_places_every_splat(spark):
    rows = catalogue.splats(spark, SF).select("splat_id", "opacity", "scale").collect()
    wanted = sorted(((-(r.opacity * r.scale * r.scale * r.scale), r.splat_id) for r in rows))
    got = catalogue.QUERIES["splat_significance_order"](spark, SF).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(1, len(rows) + 1))
    assert [r.splat_id for r in got] == [i for _, i in wanted]
    assert [r.significance for r in got] == pytest.approx([-s for s, _ in wanted], abs=1e-6)


def test_significance_order_of_ties_and_missing_values(spark):
    cloud = spark.createDataFrame([(i, 0.5 if i % 3 else None, 0.1) for i in range(900)] + [(i, float("nan"), 0.1) for i in range(900, 910)], "splat_id long, opacity double, scale double")
    got = [r.splat_id for r in export.significance_order(cloud).orderBy("ord").collect()]
    assert got == [*range(900, 910), *(i for i in range(900) if i % 3), *range(0, 900, 3)]
    assert export.significance_order(cloud.limit(0)).count() == 0
