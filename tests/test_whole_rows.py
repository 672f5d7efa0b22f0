"""The sliding test at every row, against brute force."""

from collections import defaultdict

import numpy as np
import pytest

from tideglass import queries as core
from tideglass.queries import base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def looks(spark):
    """(feature, rows so far) -> excesses of the last 400 values over the first 400 at each value."""
    values = defaultdict(list)
    for r in base.shifted_values(spark, SF).orderBy("feature_id", "seq").collect():
        values[r["feature_id"]].append(r["value"] / 490.0)
    out = {}
    for f, v in values.items():
        ref = np.sort(v[:400])
        for n in range(400, len(v) + 1):
            cur = np.sort(v[n - 400 : n])
            at = np.union1d(ref, cur)
            out[f, n] = np.searchsorted(cur, at, "right") - np.searchsorted(ref, at, "right")
    assert len(out) > 100 * len(values)
    return out


def test_every_row(spark, looks):
    q = core.queries()
    ks = {(r["feature_id"], r["looked"]): r["ks"] for r in q["WIN7_reference_ks"](spark, SF).collect()}
    assert ks == pytest.approx({k: np.abs(g).max() / 400 for k, g in looks.items()}, abs=1e-6)
    excess = {(r["feature_id"], r["looked"]): (r["max_excess"], r["min_excess"]) for r in q["DET1b_excess_counts"](spark, SF).collect()}
    assert excess == {k: (g.max(), g.min()) for k, g in looks.items()}
    fires = {(r["feature_id"], r["looked"]): (r["ks"], r["fires"]) for r in q["DET12_sliding_test"](spark, SF).collect()}
    limit = 1.95 * (2 / 400) ** 0.5
    assert fires == {k: (pytest.approx(x, abs=1e-6), x > limit) for k, g in looks.items() for x in [np.abs(g).max() / 400]}


def test_status_of_every_row(spark, looks):
    rows = core.queries()["DET1_iks"](spark, SF).collect()
    assert len(rows) == base.shifted_values(spark, SF).count()
    limit = (-0.5 * np.log(0.001)) ** 0.5 * (2 / 400) ** 0.5
    got = {(r["feature_id"], r["seq"] + 1): r["status"] for r in rows if r["seq"] >= 399}
    assert got == {k: "DRIFT" if np.abs(g).max() / 400 > limit else "STABLE" for k, g in looks.items()}


def test_largest_over_every_row(spark, looks):
    got = {r["feature_id"]: (r["max_ks"], r["looks"]) for r in core.queries()["DET1a_value_slots"](spark, SF).collect()}
    for f, (top, n) in got.items():
        mine = [np.abs(g).max() / 400 for (k, _), g in looks.items() if k == f]
        assert (top, n) == (pytest.approx(max(mine), abs=1e-6), len(mine))
