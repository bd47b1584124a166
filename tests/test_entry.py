import os

import duckdb
import pytest

import __spark_entry__ as entry
from seqlake.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "classify_hits" in entry.queries()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_like_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    cursor = db.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_native_plans(spark):
    """Operators that need no Python have none in their plans."""
    for name in ("run_length_encode", "consensus", "valid_hits_of_queries", "dedup_weights", "taxon_thresholds"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_shown_differences(spark):
    from seqlake.functions.alignment import ALIKE

    got = entry.queries()["shown_differences"](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/part.parquet").count()
    for r in got:
        q, t = "", ""
        for a, b in zip(r["p_name"], r["p_brand"], strict=False):
            same = a == b or b in ALIKE.get(a, "")
            q += "." if same else a.lower()
            t += b if same else b.lower()
        assert (r["q"], r["t"]) == (q, t)


def test_barcode_reads_and_counts(spark):
    names = {r["p_partkey"]: r["p_name"] for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    got = {r["p_partkey"]: r for r in entry.queries()["barcode_reads"](spark, DATA).collect()}
    assert set(got) == {k for k, s in names.items() if len(s) >= 8}
    counts = {"fail_len": len(names) - len(got), "total_matched": 0}
    for k, r in got.items():
        head = names[k][:20]
        exact = next(((n, head.find(c)) for n, c in (("a", "part"), ("b", "x1y2")) if c in head), None)
        assert (r["kind"] == "exact") == (exact is not None) and (exact is None or (r["sample"], r["bc_start"]) == exact)
        counts[r["sample"] or "no_match"] = counts.get(r["sample"] or "no_match", 0) + 1
        counts["total_matched"] += r["sample"] is not None
    assert {r["outcome"]: r["n"] for r in entry.queries()["barcode_counts"](spark, DATA).collect()} == counts
