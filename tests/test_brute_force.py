"""Property test: the Spark profile equals a brute-force row-by-row profile on random small frames."""
import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from qualitas.functions import grammar as G
from qualitas.operators import cells as C
from qualitas.operators import profile as P

POOL = ["1", "-2.5", "1e3", " 7 ", ".5", "0", "2024-02-29", "2023-02-29", "01/02/2024", "13/02/2024", "05/2023",
        "2024", "2101", "1999", "ABC123", "AB12", "XYZ9", "x", " ", "$5", "0x10", "NaN", None, ""]
COLS = ["amount", "created_at", "code"]
AS_OF = dt.datetime(2024, 1, 20)


def _date(v):
    if v is None:
        return None
    fmts = [(G.DATE_PATTERN_ISO, "%Y-%m-%d"), (G.DATE_PATTERN_SLASH, "%m/%d/%Y"),
            (G.DATE_PATTERN_MONTH_YEAR, "%m/%Y")]
    for pat, fmt in fmts:
        if re.search(pat, v):
            try:
                return dt.datetime.strptime(v, fmt)
            except ValueError:
                return None
    if re.search(G.DATE_PATTERN_YEAR, v) and int(v) <= G.YEAR_MAX:
        return dt.datetime(int(v), 1, 1)
    return None


def _num(v):
    return float(v) if v is not None and re.search(G.NUMBER_PATTERN, v) else None


def brute(rows):
    out = {}
    n = len(rows)
    for i, c in enumerate(COLS):
        vals = [r[i] for r in rows]
        present = [v for v in vals if v not in (None, "")]
        if all(_num(v) is not None for v in present):
            t = "numeric"
        elif all(_date(v) is not None for v in present):
            t = "datetime"
        else:
            t = "string"
        nums = [_num(v) for v in present if _num(v) is not None]
        freq = {}
        for v in present:
            freq[v] = freq.get(v, 0) + 1
        top = sorted(freq.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:3]
        dates = [_date(v) for v in present if _date(v) is not None
                 and (not re.search(G.DATE_PATTERN_YEAR, v) or "at" in c or "date" in c)]
        out[c] = dict(type=t, nulls=n - len(present), unique=len(freq),
                      num=(len(nums), min(nums), max(nums), sum(1 for x in nums if x < 0)) if nums else None,
                      top=top, codes=sum(1 for v in present if re.search(G.CODE_PATTERN, v)),
                      dates=(len(dates), sum(1 for d in dates if d > AS_OF))
                      if dates and len(dates) * 10 >= n else None)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.sampled_from(POOL)] * 3), min_size=1, max_size=25))
def test_profile_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLS))
    facts = C.facts(C.frequency(df)).cache()
    prof = {r.column_name: r for r in P.column_profile(facts).collect()}
    num = {r.column_name: r for r in P.numeric_stats(facts).collect()}
    top = {}
    for r in P.categorical_stats(facts).orderBy("column_name", "rank").collect():
        top.setdefault(r.column_name, []).append((r.value, r.n))
    pat = {r.column_name: r.match_count for r in P.pattern_stats(facts).collect()}
    tmp = {r.column_name: r for r in P.temporal_stats(facts, AS_OF).collect()}
    facts.unpersist()
    want = brute(rows)
    for c in COLS:
        w = want[c]
        assert prof[c].inferred_data_type == w["type"], c
        assert (prof[c].null_count, prof[c].unique_count) == (w["nulls"], w["unique"]), c
        if w["num"] is None:
            assert c not in num
        else:
            r = num[c]
            assert (r.numeric_count, r.min_value, r.max_value) == w["num"][:3], c
            assert round(r.negative_value_ratio * r.numeric_count) == w["num"][3], c
        assert top.get(c, []) == w["top"], c
        assert pat.get(c, 0) == w["codes"], c
        if w["dates"] is None:
            assert c not in tmp, c
        else:
            assert (tmp[c].date_count, tmp[c].future_count) == w["dates"], c
