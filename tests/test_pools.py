"""The pools and trees of the frozen forests."""

from tideglass import queries as core
from tideglass.queries import models


def test_pools_of_the_ceiling(spark, monkeypatch):
    asked, build = [], models.forest.build_from_pool
    monkeypatch.setattr(models.forest, "build_from_pool", lambda x, *a: asked.append((a[2], len(x))) or build(x, *a))
    rows = core.queries()["IF10_oracle_ceiling"](spark, "/root/testdata/sf0.01").collect()
    assert [r["pool"] for r in rows] == ["clean-1000", "clean-4000", "unfiltered-1000"]
    sizes = {k: {n for key, n in asked if key == k} for k in (0, 1, 2)}
    assert sizes[0] == sizes[2] == {1000} and min(sizes[1]) > 1000 and len(asked) == 300
    asked.clear()
    core.queries()["IF9_frozen_baseline"](spark, "/root/testdata/sf0.01").collect()
    assert len(asked) == 100 and asked[0][1] > 500
