"""The approximate audit: no value shuffle; every count exact except distinct counts and top values."""
import pytest

from conftest import SF01
from qualitas.plans.audit import Audit
from qualitas.sources.tables import table


@pytest.fixture(scope="module")
def pair(spark, dirty01):
    kw = dict(as_of="2000-06-01", keys=["txn_id"], parents={"client_id": (table(spark, SF01, "customer"), "c_custkey")})
    return Audit(dirty01, "d", **kw), Audit(dirty01, "d", approx=True, **kw)


def test_rule_counts_exact(pair):
    exact, approx = pair
    key = lambda r: (r.rule, r.column_name)
    e = {key(r): (r.bad, r.eligible) for r in exact.rules.collect()}
    a = {key(r): (r.bad, r.eligible) for r in approx.rules.collect()}
    assert a == e
    assert approx.composite.collect()[0].composite_dqs == exact.composite.collect()[0].composite_dqs


def test_profile_exact_but_distinct(pair):
    exact, approx = pair
    e = {r.column_name: r for r in exact.columns.collect()}
    a = {r.column_name: r for r in approx.columns.collect()}
    for c in e:
        assert (a[c].inferred_data_type, a[c].null_count, a[c].sample_values_masked) == \
               (e[c].inferred_data_type, e[c].null_count, e[c].sample_values_masked)
        assert abs(a[c].unique_count - e[c].unique_count) <= max(2, 0.06 * e[c].unique_count)
    en = {r.column_name: r for r in exact.numeric.collect()}
    an = {r.column_name: r for r in approx.numeric.collect()}
    assert {c: (r.numeric_count, r.min_value, r.max_value, r.mean) for c, r in an.items()} == \
           {c: (r.numeric_count, r.min_value, r.max_value, r.mean) for c, r in en.items()}
    assert sorted(map(tuple, approx.temporal.collect())) == sorted(map(tuple, exact.temporal.collect()))


def test_top_values_of_low_cardinality_columns(pair):
    exact, approx = pair
    pick = lambda a, c: [(r.value, r.n) for r in sorted(a.categorical.where(f"column_name = '{c}'").collect(),
                                                         key=lambda r: r.rank)]
    for c in ("card_brand", "status", "kyc_address"):
        assert pick(approx, c) == pick(exact, c)


def test_approx_plan_has_no_value_shuffle(spark, dirty01):
    import re
    a = Audit(dirty01, "d", as_of="2000-06-01", approx=True, checkpoint_rules=False)
    plan = a.columns._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and all(k.startswith("column_name#") and "value#" not in k for k in keys), keys


def test_registered_sketches_against_exact_results(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    got = {r.column_name: r for r in E.queries()["profile_lineitem_sketches"](spark, sf).collect()}
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert set(got) == set(df.columns)
    for name, r in got.items():
        counts = {row[0]: row[1] for row in df.groupBy(df[name].cast("string")).count().collect() if row[0] not in (None, "")}
        assert abs(r.approx_unique_count - len(counts)) <= max(2, 0.1 * len(counts)), name     # five times rsd
        assert r.unique_ratio == r.approx_unique_count / r.row_count
        top = sorted(counts.values(), reverse=True)[:3]
        if len(counts) <= 600:                  # the sketch of 1,000 items has not dropped any
            assert [(e.n, counts[e.value]) for e in r.top_values] == [(n, n) for n in top], name
        error = 3.5 / 1000 * r.row_count        # bound of a frequent-items sketch; a rarer item may be left out
        assert all(abs(e.n - counts[e.value]) <= error for e in r.top_values), name
        assert len(r.top_values) >= sum(n > 2 * error for n in top), name


def test_registered_stream_has_mean_and_distinct_estimate(spark):
    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    key = lambda r: (r.window_start, r.column_name)
    want = {key(r): r for r in E.queries()["windowed_profile"](spark, sf).collect()}
    got = {key(r): r for r in E.queries()["windowed_profile_stream_sketches"](spark, sf).collect()}
    assert set(got) == set(want)
    for k, r in got.items():
        w = want[k]
        assert (r.mean is None) == (w.mean is None) and (r.mean is None or abs(r.mean - w.mean) < 1e-5 * max(1, abs(w.mean)))
        assert abs(r.approx_distinct - w.unique_count) <= max(2, 0.25 * w.unique_count)     # five times rsd
