import os
import subprocess
import sys

import duckdb
import pytest
from conftest import ROOT, SF

import __spark_entry__ as entry
from tideglass import queries as core

#: A query of each family; the full set is compared by the driver.
SOME = ["score_forest", "AGG4_roc_auc", "AGG7_threshold_at_fpr", "AGG8_youden", "AGG13_latency", "AGG28_ks", "WIN14_drift_delays", "DET2_hddm_a", "DET7_quorum", "SRC2_parse_csv", "RTE1_shards", "JN2_as_of_version", "ORC1_expand_plan", "STR3_stream_scores", "SNK4_report"]


def connection():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(core.queries()) >= 190


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_sql(spark, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=key)
    want = sorted(connection().sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({core.oracle_sql()[name]})").fetchall(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, float) and y == pytest.approx(x, abs=2e-6) for x, y in zip(a, b)), (a, b)


def test_core_without_a_corpus_dependency():
    """A library that only corpus operators need may be missing: the other queries stay."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) >= 190 and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert ("left out" in done.stderr) == os.path.isdir(os.path.join(ROOT, "tideglass", "llm"))
