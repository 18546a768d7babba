"""DuckDB oracle SQL for every registered query (see ``__spark_entry__.oracle_sql``).

Plain SQL over the driver's views.  The SQL is written apart from the Spark
code; the grammar's constants (patterns, tokens, thresholds) and the wording
are shared, so a wrong constant would be wrong on both sides: those are held
against literal cases by the tests.
"""
from __future__ import annotations

from qualitas.functions import grammar as G

AS_OF_ORDERS = "2000-06-01"
AS_OF_EVENTS = "2024-01-20"

DIRTY_COLUMNS = ["txn_id", "client_id", "email", "kyc_address", "amount", "txn_date", "updated_at",
                 "ref_code", "card_brand", "card_number", "cvv", "status"]

DIRTY = """
dirty_base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_orderpriority AS pr, o_orderstatus AS st,
         CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20)) AS amt,
         substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10) AS d
  FROM orders),
dirty_shaped AS (
  SELECT CAST(k AS VARCHAR(20)) AS txn_id,
    CASE WHEN k % 97 = 0 THEN CAST(ck + 10000000 AS VARCHAR(20)) ELSE CAST(ck AS VARCHAR(20)) END AS client_id,
    CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN NULL ELSE concat('user', CAST(ck AS VARCHAR(20)), '@mail.example') END AS email,
    CASE WHEN k % 17 = 0 THEN NULL ELSE concat('Street ', CAST(ck % 50 AS VARCHAR(20))) END AS kyc_address,
    CASE WHEN k % 23 = 0 THEN concat('$', amt) WHEN k % 29 = 0 THEN concat('-', amt) WHEN k % 31 = 0 THEN '' ELSE amt END AS amount,
    CASE WHEN k % 11 = 0 THEN concat(substring(d,6,2),'/',substring(d,9,2),'/',substring(d,1,4)) WHEN k % 13 = 0 THEN concat(substring(d,6,2),'/',substring(d,1,4)) ELSE d END AS txn_date,
    CASE WHEN k % 41 = 0 THEN '2031-01-01' ELSE d END AS updated_at,
    concat(upper(substring(pr,3,3)), CAST(ck AS VARCHAR(20))) AS ref_code,
    CASE WHEN k % 3 = 0 THEN 'Visa' WHEN k % 3 = 1 THEN 'Amex' ELSE 'Diners' END AS card_brand,
    CASE WHEN k % 3 = 0 AND k % 37 <> 0 THEN concat('4', lpad(CAST(k AS VARCHAR(20)), 15, '0')) WHEN k % 3 = 2 THEN concat('36', lpad(CAST(k AS VARCHAR(20)), 12, '0')) ELSE concat('37', lpad(CAST(k AS VARCHAR(20)), 13, '0')) END AS card_number,
    CASE WHEN k % 43 = 0 THEN '0' ELSE CAST(100 + k % 900 AS VARCHAR(20)) END AS cvv,
    st AS status
  FROM dirty_base),
dirty AS (SELECT * FROM dirty_shaped UNION ALL SELECT * FROM dirty_shaped WHERE CAST(txn_id AS BIGINT) % 101 = 0)"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cells(source: str, cols, cast: bool = False, extra: str = "") -> str:
    parts = []
    for c in cols:
        v = f"CAST({c} AS VARCHAR)" if cast else c
        parts.append(f"SELECT {extra}{q(c)} AS column_name, {v} AS value FROM {source}")
    return "cells AS (" + "\n  UNION ALL ".join(parts) + ")"


def freq(extra: str = "") -> str:
    return f"freq AS (SELECT {extra}column_name, value, count(*) AS n FROM cells GROUP BY ALL)"


NUM = q(G.NUMBER_PATTERN)
TS = f"""CAST(coalesce(
      CASE WHEN regexp_matches(value, {q(G.DATE_PATTERN_ISO)}) THEN TRY_CAST(value AS TIMESTAMP) END,
      CASE WHEN regexp_matches(value, {q(G.DATE_PATTERN_SLASH)}) THEN try_strptime(value, ['%m/%d/%Y',
        '%m/%d/%Y %H:%M', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y %I:%M %p', '%m/%d/%Y %I:%M:%S %p']) END,
      CASE WHEN regexp_matches(value, {q(G.DATE_PATTERN_MONTH_YEAR)}) THEN try_strptime(value, '%m/%Y') END,
      CASE WHEN regexp_matches(value, {q(G.DATE_PATTERN_YEAR)}) AND TRY_CAST(value AS INTEGER) <= {G.YEAR_MAX}
           THEN try_strptime(value, '%Y') END) AS TIMESTAMP)"""


def facts(extra: str = "") -> str:
    return f"""facts0 AS (SELECT {extra}column_name, value, n, (value IS NOT NULL AND value <> '') AS present FROM freq),
facts AS (SELECT {extra}column_name, value, n, present,
    present AND coalesce(regexp_matches(value, {NUM}), false) AS is_num,
    CASE WHEN present AND coalesce(regexp_matches(value, {NUM}), false) THEN TRY_CAST(value AS DOUBLE) END AS num,
    CASE WHEN present THEN {TS} END AS ts,
    present AND coalesce(regexp_matches(value, {q(G.DATE_PATTERN_YEAR)}), false) AS year_only,
    present AND coalesce(regexp_matches(value, {q(G.CODE_PATTERN)}), false) AS is_code,
    present AND coalesce(regexp_matches(value, {q(G.ISO_DATE_PREFIX)}), false) AS is_iso,
    present AND coalesce(regexp_matches(value, {q(G.CURRENCY_PATTERN)}), false) AS is_currency
  FROM facts0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def dirty_facts() -> str:
    return with_(DIRTY, cells("dirty", DIRTY_COLUMNS), freq(), facts())


def table_facts(table: str, cols) -> str:
    return with_(cells(table, cols, cast=True), freq(), facts())


def column_profile_sql(prefix: str) -> str:
    return prefix + """
SELECT column_name,
  CASE WHEN coalesce(bool_and(CASE WHEN present THEN is_num END), true) THEN 'numeric'
       WHEN coalesce(bool_and(CASE WHEN present THEN ts IS NOT NULL END), true) THEN 'datetime'
       ELSE 'string' END AS inferred_data_type,
  CAST(sum(n) - sum(CASE WHEN present THEN n ELSE 0 END) AS BIGINT) AS null_count,
  (sum(n) - sum(CASE WHEN present THEN n ELSE 0 END)) / sum(n) AS null_ratio,
  CAST(count(*) FILTER (WHERE present) AS BIGINT) AS unique_count,
  count(*) FILTER (WHERE present) / sum(n) AS unique_ratio,
  rtrim(repeat('***,', CAST(least(3, sum(CASE WHEN present THEN n ELSE 0 END)) AS INTEGER)), ',') AS sample_values_masked
FROM facts GROUP BY column_name"""


SQL: dict[str, str] = {}

SQL["column_profile"] = column_profile_sql(dirty_facts())


# --------------------------------------------------------------- profile
def numeric_sql(blank_as_zero: bool) -> str:
    x = "CASE WHEN is_num THEN num WHEN NOT present THEN 0.0 END" if blank_as_zero else \
        "CASE WHEN is_num THEN num END"
    d = ("CASE WHEN is_num THEN TRY_CAST(value AS DECIMAL(24,6)) WHEN NOT present THEN 0 END" if blank_as_zero
         else "CASE WHEN is_num THEN TRY_CAST(value AS DECIMAL(24,6)) END")
    return dirty_facts() + f""", xs AS (SELECT column_name, n, {x} AS x, {d} AS d FROM facts),
g AS (SELECT column_name, sum(n) AS cnt, min(x) AS min_value, max(x) AS max_value,
  CAST(sum(d * n) * 1000000 AS HUGEINT) AS s_micro, count(*) FILTER (WHERE d IS NULL) AS undec,
  sum(x * n) / sum(n) AS dmean, sum(CASE WHEN x < 0 THEN n ELSE 0 END) / sum(n) AS negative_value_ratio
FROM xs WHERE x IS NOT NULL GROUP BY column_name),
m AS (SELECT *, sign(s_micro) * ((2 * abs(s_micro) + cnt) // (2 * cnt)) AS m_micro FROM g)
SELECT column_name, CAST(cnt AS BIGINT) AS numeric_count, min_value, max_value,
  round(CASE WHEN undec = 0 THEN CAST((CASE WHEN m_micro < 0 THEN '-' ELSE '' END)
      || CAST(abs(m_micro) // 1000000 AS VARCHAR) || '.' || lpad(CAST(abs(m_micro) % 1000000 AS VARCHAR), 6, '0')
      AS DOUBLE) ELSE dmean END, 6) AS mean,
  negative_value_ratio
FROM m"""


SQL["numeric_stats"] = numeric_sql(False)
SQL["numeric_stats_blank_as_zero"] = numeric_sql(True)

SQL["categorical_top3"] = dirty_facts() + f""", p AS (SELECT column_name, value, n FROM facts WHERE present),
ranked AS (SELECT column_name, value, n,
  row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value ASC) AS rank FROM p),
d AS (SELECT column_name, count(*) AS distinct_values FROM p GROUP BY column_name)
SELECT column_name, CAST(distinct_values AS BIGINT) AS distinct_values, CAST(rank AS BIGINT) AS rank,
  value, CAST(n AS BIGINT) AS n
FROM ranked JOIN d USING (column_name) WHERE rank <= {G.TOP_K}"""


def name_has(tokens) -> str:
    return "(" + " OR ".join(f"contains(lower(column_name), {q(t)})" for t in tokens) + ")"


ID_COL = f"(lower(column_name) = {q(G.ID_COLUMN_NAME)} OR {name_has(G.ID_COLUMN_SUBSTRINGS)})"
TDATE = f"(ts IS NOT NULL AND NOT {ID_COL} AND (NOT year_only OR {name_has(G.YEAR_COLUMN_TOKENS)}))"
ISO_FMT = "'%Y-%m-%dT%H:%M:%S.%gZ'"


def temporal_sql(prefix: str, as_of: str) -> str:
    return prefix + f""", t AS (
SELECT column_name, CAST(sum(n) AS BIGINT) AS row_count,
  CAST(sum(CASE WHEN {TDATE} THEN n ELSE 0 END) AS BIGINT) AS date_count,
  min(CASE WHEN {TDATE} THEN ts END) AS min_ts, max(CASE WHEN {TDATE} THEN ts END) AS max_ts,
  sum(CASE WHEN {TDATE} AND ts > TIMESTAMP '{as_of}' THEN n ELSE 0 END) AS future_count,
  sum(CASE WHEN {TDATE} AND ts < TIMESTAMP '{as_of}' - INTERVAL {G.STALE_DAYS} DAY THEN n ELSE 0 END) AS stale_count
FROM facts GROUP BY column_name)
SELECT column_name, row_count, date_count, strftime(min_ts, {ISO_FMT}) AS min_timestamp,
  strftime(max_ts, {ISO_FMT}) AS max_timestamp,
  future_count / date_count AS future_timestamp_ratio, stale_count / date_count AS stale_record_ratio
FROM t WHERE date_count > 0 AND date_count * 1000 >= row_count * {int(round(G.TEMPORAL_MIN_COVERAGE * 1000))}"""


SQL["temporal_stats"] = temporal_sql(dirty_facts(), AS_OF_ORDERS)

SQL["pattern_stats"] = dirty_facts() + """, t AS (SELECT column_name,
  sum(CASE WHEN present THEN n ELSE 0 END) AS present_count, sum(CASE WHEN is_code THEN n ELSE 0 END) AS match_count
FROM facts GROUP BY column_name)
SELECT column_name, CAST(match_count AS BIGINT) AS match_count, match_count / present_count AS regex_match_ratio
FROM t WHERE match_count > 0"""

FLAGS_SELECT = f"""SELECT coalesce(bool_or({name_has(G.KYC_TOKENS)}), false) AS kyc_fields_present,
  coalesce(bool_or({name_has(G.MONETARY_TOKENS)}), false) AS monetary_fields_present,
  coalesce(bool_or({name_has(G.PERSONAL_TOKENS)}), false) AS personal_data_present"""

SQL["compliance_flags"] = with_(DIRTY, cells("dirty", DIRTY_COLUMNS)) + \
    FLAGS_SELECT + " FROM (SELECT DISTINCT column_name FROM cells)"

SQL["dataset_summary"] = with_(DIRTY) + f"""SELECT 'dirty_payments' AS dataset_name,
  CAST(count(*) AS BIGINT) AS row_count, CAST({len(DIRTY_COLUMNS)} AS BIGINT) AS column_count,
  {q(G.DEFAULT_DOMAIN)} AS detected_domain FROM dirty"""

SQL["duplicate_rows"] = with_(DIRTY) + """, c AS (SELECT (SELECT count(*) FROM dirty) AS row_count,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS distinct_rows)
SELECT CAST(row_count AS BIGINT) AS row_count, CAST(distinct_rows AS BIGINT) AS distinct_rows,
  CAST(row_count - distinct_rows AS BIGINT) AS duplicate_rows, row_count > distinct_rows AS duplicates_detected FROM c"""


def dependent_nulls_sql() -> str:
    miss = ", ".join(f"({c} IS NULL OR {c} = '') AS {c}" for c in DIRTY_COLUMNS)
    parts = []
    for a in DIRTY_COLUMNS:
        for b in DIRTY_COLUMNS:
            if a != b:
                parts.append(f"SELECT {q(a)} AS a, {q(b)} AS b, CAST(count(*) FILTER (WHERE {a}) AS BIGINT) AS a_missing, "
                             f"count(*) FILTER (WHERE {a} AND NOT {b}) AS violations FROM m")
    return with_(DIRTY, f"m AS (SELECT {miss} FROM dirty)", "pairs AS (" + "\nUNION ALL ".join(parts) + ")") + \
        "SELECT a, b, a_missing FROM pairs WHERE a_missing > 0 AND violations = 0"


SQL["dependent_nulls"] = dependent_nulls_sql()


# ----------------------------------------------------------------- rules
def _range_sql():
    has, bad = [], []
    for token, lo, hi in G.DEFAULT_RANGE_RULES:
        m = f"contains(lower(column_name), {q(token.lower())})"
        cond = " OR ".join(([f"num < {float(lo)}"] if lo is not None else [])
                           + ([f"num > {float(hi)}"] if hi is not None else [])) or "false"
        has.append(m)
        bad.append(f"WHEN {m} THEN ({cond})")
    return "(" + " OR ".join(has) + ")", "(CASE " + " ".join(bad) + " ELSE false END)"


RANGE_HAS, RANGE_BAD = _range_sql()
FRESH = f"TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL {G.FRESHNESS_YEARS} YEAR"

SUMMARY = f"""summary0 AS (
SELECT column_name, CAST(sum(n) AS BIGINT) AS rows,
  CAST(sum(CASE WHEN present THEN n ELSE 0 END) AS BIGINT) AS present,
  CAST(count(*) FILTER (WHERE present) AS BIGINT) AS distinct_values,
  bool_and(CASE WHEN present THEN is_num END) AS all_num,
  bool_and(CASE WHEN present THEN ts IS NOT NULL END) AS all_date,
  CAST(sum(CASE WHEN is_num THEN n ELSE 0 END) AS BIGINT) AS num,
  CAST(sum(CASE WHEN is_num AND num < 0 THEN n ELSE 0 END) AS BIGINT) AS negative,
  CAST(sum(CASE WHEN is_num AND {RANGE_HAS} THEN n ELSE 0 END) AS BIGINT) AS range_eligible,
  CAST(sum(CASE WHEN is_num AND {RANGE_HAS} AND {RANGE_BAD} THEN n ELSE 0 END) AS BIGINT) AS range_bad,
  CAST(sum(CASE WHEN present AND ts IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS dates_any,
  CAST(sum(CASE WHEN is_currency THEN n ELSE 0 END) AS BIGINT) AS currency,
  CAST(sum(CASE WHEN {TDATE} THEN n ELSE 0 END) AS BIGINT) AS tdates,
  CAST(sum(CASE WHEN {TDATE} AND ts > TIMESTAMP '{AS_OF_ORDERS}' THEN n ELSE 0 END) AS BIGINT) AS future,
  CAST(sum(CASE WHEN {TDATE} AND NOT is_iso THEN n ELSE 0 END) AS BIGINT) AS non_iso,
  CAST(sum(CASE WHEN {TDATE} AND ts < {FRESH} THEN n ELSE 0 END) AS BIGINT) AS stale
FROM facts GROUP BY column_name),
summary AS (SELECT *,
  CASE WHEN coalesce(all_num, true) THEN 'numeric' WHEN coalesce(all_date, true) THEN 'datetime' ELSE 'string' END
    AS inferred_data_type,
  (tdates > 0 AND tdates * 1000 >= rows * {int(round(G.TEMPORAL_MIN_COVERAGE * 1000))}) AS is_temporal,
  num * 2 > present AS numeric_majority, dates_any * 2 > present AS date_majority
FROM summary0)"""


def _rule(dim, rid, where, bad, elig):
    return (f"SELECT {q(dim)} AS dimension, {q(rid)} AS rule, column_name, CAST({bad} AS BIGINT) AS bad, "
            f"CAST({elig} AS BIGINT) AS eligible, distinct_values FROM summary WHERE {where}")


COLUMN_RULES = "column_rules AS (" + "\nUNION ALL ".join([
    _rule("Completeness", "missing_values", "true", "rows - present", "rows"),
    _rule("Accuracy", "out_of_range", "range_eligible > 0", "range_bad", "range_eligible"),
    _rule("Accuracy", "negative_amount", f"{name_has(G.MONETARY_TOKENS)} AND num > 0", "negative", "num"),
    _rule("Accuracy", "future_timestamp", "is_temporal", "future", "tdates"),
    _rule("Consistency", "numeric_as_string", "inferred_data_type = 'string' AND numeric_majority",
          "present - num - currency", "present"),
    _rule("Consistency", "datetime_as_string",
          "inferred_data_type = 'string' AND NOT numeric_majority AND date_majority", "present - dates_any", "present"),
    _rule("Validity", "currency_symbol", "numeric_majority AND present > 0", "currency", "present"),
    _rule("Validity", "non_iso_date", "is_temporal", "non_iso", "tdates"),
    _rule("Timeliness", "stale_records", "is_temporal", "stale", "tdates"),
]) + ")"

PAN_VALUES = ", ".join(f"({q(b)}, {lo}, {hi})" for b, lo, hi in G.PAN_LENGTHS)
PAN_RULE = f"""pan_rule AS (
SELECT 'Validity' AS dimension, 'pan_length' AS rule, 'card_number' AS column_name,
  CAST(coalesce(sum(CASE WHEN len < min_len OR len > max_len THEN 1 ELSE 0 END), 0) AS BIGINT) AS bad,
  CAST(count(*) AS BIGINT) AS eligible, CAST(count(DISTINCT brand || ':' || len) AS BIGINT) AS distinct_values
FROM (SELECT lower(trim(card_brand)) AS brand, length(regexp_replace(card_number, '[^0-9]', '', 'g')) AS len
      FROM dirty WHERE card_number IS NOT NULL AND card_number <> '' AND card_brand IS NOT NULL AND card_brand <> '') x
JOIN (VALUES {PAN_VALUES}) b(brand, min_len, max_len) USING (brand))"""

DUP_RULES = """dup_rules AS (
SELECT 'Uniqueness' AS dimension, 'duplicate_rows' AS rule, '*' AS column_name,
  CAST((SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS BIGINT) AS bad,
  CAST((SELECT count(*) FROM dirty) AS BIGINT) AS eligible,
  CAST((SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS BIGINT) AS distinct_values
UNION ALL
SELECT 'Uniqueness', 'duplicate_key', 'txn_id',
  CAST((SELECT count(*) FROM dirty) - (SELECT count(*) FROM (SELECT DISTINCT txn_id FROM dirty)) AS BIGINT),
  CAST((SELECT count(*) FROM dirty) AS BIGINT),
  CAST((SELECT count(*) FROM (SELECT DISTINCT txn_id FROM dirty)) AS BIGINT))"""

ORPHAN_RULE = """child AS (SELECT client_id AS k, count(*) AS c FROM dirty
  WHERE client_id IS NOT NULL AND client_id <> '' GROUP BY client_id),
parent_keys AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE c_custkey IS NOT NULL),
orphan_rule AS (
SELECT 'Integrity' AS dimension, 'orphan_keys' AS rule, 'client_id' AS column_name,
  CAST(coalesce(sum(CASE WHEN parent_keys.k IS NULL THEN c END), 0) AS BIGINT) AS bad,
  CAST(coalesce(sum(c), 0) AS BIGINT) AS eligible, CAST(count(*) AS BIGINT) AS distinct_values
FROM child LEFT JOIN parent_keys ON child.k = parent_keys.k)"""

ALL_RULES = ("rules AS (SELECT * FROM column_rules UNION ALL SELECT * FROM pan_rule UNION ALL "
             "SELECT * FROM dup_rules UNION ALL SELECT * FROM orphan_rule)")


def rules_prefix() -> str:
    return with_(DIRTY, cells("dirty", DIRTY_COLUMNS), freq(), facts(), SUMMARY, COLUMN_RULES, PAN_RULE,
                 DUP_RULES, ORPHAN_RULE, ALL_RULES)


RULE_OUT = "SELECT dimension, rule, column_name, bad, eligible FROM rules"
for _name, _rules in [("rule_completeness", ["missing_values"]), ("rule_range", ["out_of_range"]),
                      ("rule_negative_amount", ["negative_amount"]), ("rule_future_dates", ["future_timestamp"]),
                      ("rule_mixed_type", ["numeric_as_string", "datetime_as_string"]),
                      ("rule_currency_symbol", ["currency_symbol"]), ("rule_non_iso_date", ["non_iso_date"]),
                      ("rule_pan_length", ["pan_length"]), ("rule_freshness", ["stale_records"]),
                      ("rule_orphans", ["orphan_keys"]), ("rule_uniqueness", ["duplicate_rows", "duplicate_key"])]:
    SQL[_name] = rules_prefix() + RULE_OUT + " WHERE rule IN (" + ", ".join(q(r) for r in _rules) + ")"


# -------------------------------------------------------- findings, scores
from qualitas.operators.findings import RISK_TEXT, RULE_TEXT  # noqa: E402

TEXTS = "texts AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(q(x) for x in row) + ")" for row in RULE_TEXT) + \
    ") t(rule, issue, phrase, all_phrase, action, action_template))"
DIMS = "dims AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(d)}, {i})" for i, d in enumerate(G.DIMENSIONS)) + ") d(dimension, dim_order))"
RISKS = "risks AS (SELECT * FROM (VALUES " + ", ".join(
    f"({q(r)}, {q(c)}, {s}, {q(t)})" for r, c, s, t in RISK_TEXT) + ") r(rule, column_class, severity, risk))"


def pct_sql(bad: str, elig: str) -> str:
    h = f"((CAST({bad} AS HUGEINT) * 20000 + {elig}) // (2 * CAST({elig} AS HUGEINT)))"
    return f"(CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') || '%')"


FOUND = f"""found AS (
SELECT r.dimension, r.rule, r.column_name, t.issue,
  CASE WHEN r.bad = r.eligible
       THEN 'All ' || r.column_name || ' values are ' || t.all_phrase || ' (' || CAST(r.distinct_values AS VARCHAR)
            || ' distinct values observed)'
       ELSE CAST(r.bad AS VARCHAR) || CASE WHEN r.bad = 1 THEN ' record (' ELSE ' records (' END
            || {pct_sql('r.bad', 'r.eligible')} || CASE WHEN r.bad = 1 THEN ') has ' ELSE ') have ' END
            || replace(t.phrase, '{{column}}', r.column_name) END AS description,
  r.bad, r.eligible
FROM rules r JOIN texts t ON r.rule = t.rule WHERE r.bad > 0)"""

HEALTHY = f"""healthy AS (
SELECT dimension, CAST(NULL AS VARCHAR) AS rule, CAST(NULL AS VARCHAR) AS column_name,
  {q(G.HEALTHY_ISSUE)} AS issue, {q(G.HEALTHY_DESCRIPTION)} AS description,
  CAST(0 AS BIGINT) AS bad, CAST(0 AS BIGINT) AS eligible
FROM dims WHERE dimension NOT IN (SELECT dimension FROM found))"""


def findings_prefix() -> str:
    return rules_prefix().rstrip() + ",\n" + ",\n".join([TEXTS, DIMS, RISKS, FOUND, HEALTHY]) + "\n"


SQL["issues"] = findings_prefix() + "SELECT * FROM found UNION ALL SELECT * FROM healthy"
SQL["reportable_issues"] = findings_prefix() + "SELECT dimension, rule, column_name, issue, description FROM found"


def priority_sql() -> str:
    parts = " ".join(f"WHEN CAST(bad AS HUGEINT) * 100 >= CAST(eligible AS HUGEINT) * {int(round(s * 100))} THEN {i + 1}"
                     for i, s in enumerate(G.PRIORITY_SHARE_BUCKETS))
    return f"(CASE {parts} ELSE 5 END)"


ACTIONS = f"""actions AS (
SELECT pr.rule, t.action, CAST(pr.priority AS INTEGER) AS priority,
  replace(t.action_template, '{{columns}}', pr.columns) AS description
FROM (SELECT rule, min({priority_sql()}) AS priority,
        array_to_string(list_sort(list_distinct(list(column_name))), ', ') AS columns
      FROM rules WHERE bad > 0 GROUP BY rule) pr JOIN texts t ON pr.rule = t.rule)"""

SQL["remediation_actions"] = findings_prefix().rstrip() + ",\n" + ACTIONS + "\nSELECT * FROM actions"

RISK_ROWS = f"""risk_rows AS (
SELECT DISTINCT CAST(k.severity AS INTEGER) AS severity, k.risk
FROM rules JOIN risks k ON rules.rule = k.rule
WHERE rules.bad > 0 AND (CASE k.column_class WHEN 'kyc' THEN {name_has(G.KYC_TOKENS)}
                                             WHEN 'personal' THEN {name_has(G.PERSONAL_TOKENS)}
                                             WHEN 'monetary' THEN {name_has(G.MONETARY_TOKENS)} ELSE true END))"""

SQL["compliance_risks"] = findings_prefix().rstrip() + ",\n" + RISK_ROWS + "\nSELECT * FROM risk_rows"

SCORES = """sums AS (SELECT dimension, sum(bad) AS bad, sum(eligible) AS eligible FROM rules GROUP BY dimension),
scores AS (
SELECT d.dimension, d.dim_order, CAST(coalesce(s.bad, 0) AS BIGINT) AS bad, CAST(coalesce(s.eligible, 0) AS BIGINT) AS eligible,
  CAST(CASE WHEN coalesce(s.eligible, 0) > 0
       THEN (CAST(s.eligible - s.bad AS HUGEINT) * 2000000 + s.eligible) // (2 * CAST(s.eligible AS HUGEINT))
       ELSE 1000000 END AS BIGINT) AS score_ppm
FROM dims d LEFT JOIN sums s ON d.dimension = s.dimension),
composite AS (SELECT (sum(score_ppm) * 2 + count(*)) // (2 * count(*)) AS composite_ppm FROM scores)"""

SQL["dimension_scores"] = findings_prefix().rstrip() + ",\n" + SCORES + \
    "\nSELECT dimension, bad, eligible, score_ppm / 1000000 AS score FROM scores"
SQL["composite_score"] = findings_prefix().rstrip() + ",\n" + SCORES + \
    "\nSELECT composite_ppm / 1000000 AS composite_dqs FROM composite"


# ------------------------------------------- documents, report, merge
from qualitas.plans import report as _R  # noqa: E402

ACTIONS_SQL = ACTIONS
ANALYSIS_SUMMARY = """analysis AS (
SELECT 'dirty_payments' AS dataset_name, 'success' AS status, c.composite_ppm / 1000000 AS composite_dqs,
  CAST((SELECT count(*) FROM found) + (SELECT count(*) FROM healthy) AS BIGINT) AS issue_count,
  CAST((SELECT count(*) FROM actions) AS BIGINT) AS action_count,
  CAST((SELECT count(*) FROM risk_rows) AS BIGINT) AS risk_count,
  (c.composite_ppm BETWEEN 0 AND 1000000 AND (SELECT coalesce(bool_and(priority BETWEEN 1 AND 5), true) FROM actions))
    AS accepted
FROM composite c)"""


def analysis_prefix() -> str:
    return findings_prefix().rstrip() + ",\n" + ",\n".join([ACTIONS_SQL, RISK_ROWS, SCORES, ANALYSIS_SUMMARY]) + "\n"


# the engine's own document breaks no rule, so there is no reason to give
SQL["contract_own_document"] = analysis_prefix() + """SELECT dataset_name, status, composite_dqs, issue_count, action_count,
  risk_count, accepted, CAST(NULL AS VARCHAR) AS reason FROM analysis"""

SQL["contract_quarantine"] = """WITH d AS (SELECT o_orderkey, o_orderkey AS k FROM orders),
r AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'missing data_quality_issues' WHEN k % 9 = 0 THEN 'missing remediation_actions'
    WHEN k % 11 = 0 THEN 'missing dimension_scores' WHEN k % 13 = 0 THEN 'missing composite_dqs'
    WHEN k % 10 = 0 THEN 'composite_dqs outside 0..1' WHEN k % 17 = 0 THEN 'issue without dimension'
    WHEN k % 19 = 0 THEN 'action without text' WHEN k % 7 = 0 THEN 'priority outside 1..5' END AS reason FROM d)
SELECT o_orderkey, CASE WHEN k % 6 = 0 THEN 'success' ELSE 'done' END AS status,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 10 = 0 THEN 1.25::DOUBLE ELSE (k % 100) / 100 END AS composite_dqs,
  CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) AS issue_count,
  CAST(CASE WHEN k % 9 = 0 THEN 0 ELSE 1 END AS BIGINT) AS action_count,
  CAST(CASE WHEN k % 6 = 0 THEN 0 ELSE 1 END AS BIGINT) AS risk_count, reason IS NULL AS accepted, reason FROM r"""

SQL["audit_merge"] = analysis_prefix().rstrip() + f""",
profile AS (SELECT 'dirty_payments' AS dataset_name, CAST(count(*) AS BIGINT) AS row_count,
  CAST({len(DIRTY_COLUMNS)} AS BIGINT) AS column_count, {q(G.DEFAULT_DOMAIN)} AS detected_domain FROM dirty)
SELECT p.dataset_name, p.row_count, p.column_count, p.detected_domain, a.status, a.composite_dqs,
  a.issue_count, a.action_count, a.risk_count
FROM profile p LEFT JOIN analysis a ON p.dataset_name = a.dataset_name"""


def _fixed(h: str, decimals: int) -> str:
    unit = 10 ** decimals
    return f"(CAST({h} // {unit} AS VARCHAR) || '.' || lpad(CAST({h} % {unit} AS VARCHAR), {decimals}, '0'))"


NL = "chr(10)"
_score1 = "((composite_ppm * 2000 + 1000000) // 2000000)"
_score0 = "((composite_ppm * 200 + 1000000) // 2000000)"
REPORT_LINES = f"""lines AS (
SELECT 0 AS sec, 0 AS k1, '' AS k2, '' AS k3,
  {q(_R.REPORT_TITLE)} || {q(_R.REPORT_GENERATED)} || '{AS_OF_ORDERS} 00:00:00' || {NL} || {q(_R.REPORT_SCORE)}
  || {_fixed(_score1, 1)} || '%' || {NL} || {q(_R.REPORT_ISSUES)} AS text FROM composite
UNION ALL
SELECT 1, d.dim_order, coalesce(i.rule, ''), coalesce(i.column_name, ''),
  '### ' || i.dimension || {NL} || '- **Issue**: ' || i.issue || {NL} || '- **Impact**: ' || i.description || {NL}
  || '- **Columns**: ' || coalesce(i.column_name, '') || {NL} || {NL}
FROM (SELECT * FROM found UNION ALL SELECT * FROM healthy) i JOIN dims d ON i.dimension = d.dimension
UNION ALL SELECT 2, 0, '', '', {q(_R.REPORT_ACTIONS)}
UNION ALL
SELECT 3, priority, rule, '', '- **[Priority ' || CAST(priority AS VARCHAR) || ']** ' || action || ': ' || description || {NL}
FROM actions
UNION ALL SELECT 4, 0, '', '', {q(_R.REPORT_RISKS)}
UNION ALL SELECT 5, severity, risk, '', '- ' || risk || {NL} FROM risk_rows)"""

SQL["remediation_report"] = analysis_prefix().rstrip() + ",\n" + REPORT_LINES + f"""
SELECT 'dirty_payments' AS dataset_name,
  replace({q(_R.REPORT_FILE.replace("{prefix}", _R.REPORT_PREFIX))}, '{{score}}', CAST((SELECT {_score0} FROM composite) AS VARCHAR)) AS file_name,
  string_agg(text, '' ORDER BY sec, k1, k2, k3, text) AS markdown FROM lines"""

# ----------------------------------------------------------------- windows
def transcripts_sql(keep: int) -> str:
    return f"""WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') || ': ' || coalesce(text, '') AS line FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, line DESC) AS rk FROM m),
c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT r.conv_id, CAST(c.n AS BIGINT) AS n_messages, CAST(count(*) AS BIGINT) AS kept_messages,
  string_agg(line, chr(10) ORDER BY rk DESC) AS transcript
FROM r JOIN c ON r.conv_id IS NOT DISTINCT FROM c.conv_id WHERE rk <= {keep} GROUP BY r.conv_id, c.n"""


SQL["transcripts_tail"] = transcripts_sql(G.TRANSCRIPT_KEEP)
SQL["transcripts_tail_4"] = transcripts_sql(4)

SQL["audit_history_latest"] = f"""WITH runs AS (
  SELECT event_type AS dataset_name, CAST(ts AS DATE) AS run_date, max(ts) AS ingestion_timestamp,
         count(*) AS row_count FROM events GROUP BY event_type, CAST(ts AS DATE)),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY ingestion_timestamp DESC) AS rk FROM runs)
SELECT dataset_name, strftime(run_date, '%Y-%m-%d') AS run_date, strftime(ingestion_timestamp, {ISO_FMT}) AS ingestion_timestamp,
  CAST(row_count AS BIGINT) AS row_count FROM r WHERE rk = 1"""

# ------------------------------------------------- evaluation, predicates
SQL["detector_evaluation"] = """WITH d AS (SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS p FROM documents),
j AS (SELECT p, quality = 0 AS t FROM d JOIN labels USING (doc_id)),
c AS (SELECT CAST(count(*) FILTER (WHERE p AND t) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE p AND NOT t) AS BIGINT) AS fp,
             CAST(count(*) FILTER (WHERE NOT p AND t) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE NOT p AND NOT t) AS BIGINT) AS tn FROM j)
SELECT tp, fp, fn, tn,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c"""

_QUAD = r"^(\d+)\.(\d+)\.(\d+)\.(\d+)$"
_BLOCKED = ", ".join(q(h) for h in G.BLOCKED_HOSTS)
SQL["public_url_filter"] = f"""WITH u AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS proto,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1)) AS host
  FROM pages),
o AS (SELECT *, regexp_matches(host, {q(_QUAD)}) AS quad,
    TRY_CAST(regexp_extract(host, {q(_QUAD)}, 1) AS INTEGER) AS o1, TRY_CAST(regexp_extract(host, {q(_QUAD)}, 2) AS INTEGER) AS o2,
    TRY_CAST(regexp_extract(host, {q(_QUAD)}, 3) AS INTEGER) AS o3, TRY_CAST(regexp_extract(host, {q(_QUAD)}, 4) AS INTEGER) AS o4
  FROM u)
SELECT page_id, url, coalesce(proto IN ('http', 'https') AND host <> '' AND host NOT IN ({_BLOCKED})
  AND NOT (quad AND (o1 > 255 OR o2 > 255 OR o3 > 255 OR o4 > 255 OR o1 IN (10, 0) OR (o1 = 172 AND o2 BETWEEN 16 AND 31)
           OR (o1 = 192 AND o2 = 168) OR (o1 = 169 AND o2 = 254))), false) AS is_public
FROM o"""

SQL["audit_target_filter"] = f"""WITH n AS (SELECT p_brand AS target_name FROM part UNION SELECT p_type FROM part
  UNION SELECT c_mktsegment FROM customer)
SELECT target_name, coalesce(regexp_matches(target_name, {q(G.TABLE_NAME_PATTERN)}), false) AS is_valid FROM n"""

# ------------------------------------------------------ typed table profiles
LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
EVENTS_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]

SQL["profile_lineitem"] = column_profile_sql(table_facts("lineitem", LINEITEM_COLUMNS))


def numeric_group_sql(keys: str) -> str:
    """Numeric stats over ``facts`` grouped by ``keys`` (with the exact decimal mean)."""
    return f"""xs AS (SELECT {keys}, n, CASE WHEN is_num THEN num END AS x,
    CASE WHEN is_num THEN TRY_CAST(value AS DECIMAL(24,6)) END AS d FROM facts),
ng AS (SELECT {keys}, sum(n) AS cnt, min(x) AS min_value, max(x) AS max_value,
  CAST(sum(d * n) * 1000000 AS HUGEINT) AS s_micro, count(*) FILTER (WHERE d IS NULL) AS undec,
  sum(x * n) / sum(n) AS dmean, sum(CASE WHEN x < 0 THEN n ELSE 0 END) AS negative_count
FROM xs WHERE x IS NOT NULL GROUP BY {keys}),
nm AS (SELECT *, sign(s_micro) * ((2 * abs(s_micro) + cnt) // (2 * cnt)) AS m_micro FROM ng),
num_stats AS (SELECT {keys}, min_value, max_value, CAST(negative_count AS BIGINT) AS negative_count,
  round(CASE WHEN undec = 0 THEN CAST((CASE WHEN m_micro < 0 THEN '-' ELSE '' END)
      || CAST(abs(m_micro) // 1000000 AS VARCHAR) || '.' || lpad(CAST(abs(m_micro) % 1000000 AS VARCHAR), 6, '0')
      AS DOUBLE) ELSE dmean END, 6) AS mean FROM nm)"""


def profile_group_sql(keys: str) -> str:
    return f"""prof AS (SELECT {keys},
  CASE WHEN coalesce(bool_and(CASE WHEN present THEN is_num END), true) THEN 'numeric'
       WHEN coalesce(bool_and(CASE WHEN present THEN ts IS NOT NULL END), true) THEN 'datetime'
       ELSE 'string' END AS inferred_data_type,
  CAST(sum(n) AS BIGINT) AS row_count,
  CAST(sum(n) - sum(CASE WHEN present THEN n ELSE 0 END) AS BIGINT) AS null_count,
  CAST(count(*) FILTER (WHERE present) AS BIGINT) AS unique_count
FROM facts GROUP BY {keys})"""


SQL["profile_orders_typed"] = table_facts("orders", ORDERS_COLUMNS).rstrip() + ",\n" + \
    numeric_group_sql("column_name") + ",\n" + profile_group_sql("column_name") + """
SELECT p.column_name, p.inferred_data_type, p.null_count, p.unique_count, s.min_value, s.max_value, s.mean
FROM prof p LEFT JOIN num_stats s ON p.column_name = s.column_name"""

SQL["windowed_profile"] = with_(
    cells("events", EVENTS_COLUMNS, cast=True, extra="date_trunc('day', ts) AS window_start, "),
    freq("window_start, "), facts("window_start, ")).rstrip() + ",\n" + \
    numeric_group_sql("window_start, column_name") + ",\n" + profile_group_sql("window_start, column_name") + f"""
SELECT strftime(p.window_start, {ISO_FMT}) AS window_start, p.column_name, p.row_count, p.null_count, p.unique_count,
  s.min_value, s.max_value, s.mean, coalesce(s.negative_count, CAST(0 AS BIGINT)) AS negative_count
FROM prof p LEFT JOIN num_stats s ON p.window_start = s.window_start AND p.column_name = s.column_name"""

from qualitas.operators.findings import NO_RISK  # noqa: E402

SQL["headline_risk"] = findings_prefix().rstrip() + ",\n" + RISK_ROWS + f"""
SELECT coalesce((SELECT risk FROM risk_rows ORDER BY severity, risk LIMIT 1), {q(NO_RISK)}) AS headline_risk"""


# ------------------------------------------------ sources, sinks, streams, documents
for _name in ("source_csv", "source_json_documents", "source_json_array"):
    SQL[_name] = SQL["column_profile"]            # what was landed must profile as the table it came from

SQL["sink_audit_history"] = f"""SELECT 'lineitem' AS dataset_name, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS row_count,
  CAST({len(LINEITEM_COLUMNS)} AS BIGINT) AS column_count, {q(G.DEFAULT_DOMAIN)} AS detected_domain,
  '2000-06-01T00:00:00.000Z' AS ingestion_timestamp
UNION ALL SELECT 'orders', CAST((SELECT count(*) FROM orders) AS BIGINT), CAST({len(ORDERS_COLUMNS)} AS BIGINT),
  {q(G.DEFAULT_DOMAIN)}, '2000-01-01T00:00:00.000Z'"""

SQL["windowed_profile_stream"] = f"""SELECT window_start, column_name, row_count, null_count, min_value, max_value,
  negative_count FROM ({SQL["windowed_profile"]})"""

SQL["profile_lineitem_approx"] = table_facts("lineitem", LINEITEM_COLUMNS) + """
SELECT column_name,
  CASE WHEN coalesce(bool_and(CASE WHEN present THEN is_num END), true) THEN 'numeric'
       WHEN coalesce(bool_and(CASE WHEN present THEN ts IS NOT NULL END), true) THEN 'datetime'
       ELSE 'string' END AS inferred_data_type,
  CAST(sum(CASE WHEN present THEN 0 ELSE n END) AS BIGINT) AS null_count,
  sum(CASE WHEN present THEN 0 ELSE n END) / sum(n) AS null_ratio,
  CAST(sum(CASE WHEN is_num THEN n ELSE 0 END) AS BIGINT) AS numeric_count,
  min(num) AS min_value, max(num) AS max_value,
  CASE WHEN bool_or(is_num) THEN sum(CASE WHEN num < 0 THEN n ELSE 0 END) / sum(CASE WHEN is_num THEN n ELSE 0 END) END
    AS negative_value_ratio,
  CAST(sum(n) AS BIGINT) AS row_count
FROM facts GROUP BY column_name"""

SQL["profile_document"] = f"""SELECT 'dirty_payments' AS dataset_name, d.row_count, p.column_name, p.inferred_data_type,
  p.null_count, p.null_ratio, p.unique_count, p.sample_values_masked AS samples, n.min_value, n.max_value,
  n.negative_value_ratio, c.top_values, t.min_timestamp, t.max_timestamp, m.regex_match_ratio,
  coalesce(x.missing_with, '') AS missing_with, u.duplicates_detected, f.kyc_fields_present
FROM ({SQL["column_profile"]}) p
LEFT JOIN ({SQL["numeric_stats"]}) n USING (column_name)
LEFT JOIN (SELECT column_name, string_agg(value || '=' || n, ',' ORDER BY rank) AS top_values
           FROM ({SQL["categorical_top3"]}) GROUP BY column_name) c USING (column_name)
LEFT JOIN ({SQL["temporal_stats"]}) t USING (column_name)
LEFT JOIN ({SQL["pattern_stats"]}) m USING (column_name)
LEFT JOIN (SELECT a AS column_name, string_agg(b, ',' ORDER BY b) AS missing_with
           FROM ({SQL["dependent_nulls"]}) GROUP BY a) x USING (column_name)
CROSS JOIN ({SQL["dataset_summary"]}) d CROSS JOIN ({SQL["duplicate_rows"]}) u CROSS JOIN ({SQL["compliance_flags"]}) f"""

# every value of a column breaks its rule
_OLD_ORDERS = """dirty AS (SELECT CAST(o_orderkey AS VARCHAR) AS txn_id, '' AS email,
  strftime(o_orderdate, '%m/%d/%Y') AS txn_date FROM orders)"""
SQL["issues_all_values"] = with_(
    _OLD_ORDERS, cells("dirty", ["txn_id", "email", "txn_date"]), freq(), facts(),
    SUMMARY.replace(AS_OF_ORDERS, "2031-01-01"), COLUMN_RULES, DUP_RULES,
    "rules AS (SELECT * FROM column_rules UNION ALL SELECT * FROM dup_rules)", TEXTS, FOUND) + \
    "SELECT dimension, rule, column_name, issue, description FROM found"

# ------------------------------------------------ many datasets in one job
MANY_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ORDERS_COLUMNS}
_MANY_CELLS = "cells AS (" + "\n  UNION ALL ".join(
    f"SELECT {q(t)} AS dataset_name, {q(c)} AS column_name, CAST({c} AS VARCHAR) AS value FROM {t}"
    for t, cols in MANY_COLUMNS.items() for c in cols) + ")"
_MANY = with_(_MANY_CELLS, freq("dataset_name, "), facts("dataset_name, ")).rstrip() + ",\n"
SQL["profile_datasets"] = _MANY + profile_group_sql("dataset_name, column_name") + """
SELECT dataset_name, column_name, inferred_data_type, row_count, null_count, unique_count FROM prof"""
SQL["rules_datasets"] = _MANY + SUMMARY.replace("SELECT column_name,", "SELECT dataset_name, column_name,").replace(
    "GROUP BY column_name", "GROUP BY dataset_name, column_name") + ",\n" + COLUMN_RULES.replace(
    "column_name, CAST(", "dataset_name, column_name, CAST(") + """
SELECT dataset_name, dimension, rule, column_name, bad, eligible FROM column_rules"""


# ------------------------------------------------ sources audited as read, long values, samples, discovery, states
SQL["source_csv_scores"] = SQL["dimension_scores"]


def top3_sql(prefix: str) -> str:
    return prefix + f""", p AS (SELECT column_name, value, n FROM freq WHERE value IS NOT NULL AND value <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM p),
d AS (SELECT column_name, count(*) AS distinct_values FROM p GROUP BY column_name)
SELECT column_name, CAST(distinct_values AS BIGINT) AS distinct_values, CAST(rank AS BIGINT) AS rank, value,
  CAST(n AS BIGINT) AS n
FROM ranked JOIN d USING (column_name) WHERE rank <= {G.TOP_K}"""


SQL["source_csv_multiline"] = top3_sql(with_("""notes AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'said "' || o_orderstatus || '",' || chr(10) || 'then' || chr(13) || chr(10) || '"'
       || CAST(o_orderkey % 100 AS VARCHAR) || '"' END AS note, o_orderpriority AS priority FROM orders)""",
                                             cells("notes", ["order_id", "note", "priority"]), freq()).rstrip())
SQL["categorical_documents"] = top3_sql(with_(
    """texts AS (SELECT text, repeat('All of these texts begin with one and the same long sentence. ', 4) || text AS opened, lang
  FROM documents)""", cells("texts", ["text", "opened", "lang"]), freq()).rstrip())


def _valued(column: str) -> str:
    return f"strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR)"


SQL["sample_rows"] = f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY md5('7;' || {_valued("l_orderkey")} || {_valued("l_linenumber")}) LIMIT 1000"""

#: Columns of whole numbers, the unique ones first.
_WHOLE = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
          "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"],
          "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}
_WHOLE_COLUMNS = [(t, c) for t, cs in _WHOLE.items() for c in cs]
SQL["find_references"] = "SELECT * FROM (" + "\nUNION ALL ".join(
    f"""SELECT '{t}' AS child_table, '{c}' AS child_column, '{pt}' AS parent_table, '{pc}' AS parent_column,
  (SELECT count(DISTINCT {c}) FROM {t}) AS child_values, (SELECT count(DISTINCT {pc}) FROM {pt}) AS parent_values
WHERE NOT EXISTS (SELECT 1 FROM {t} x ANTI JOIN {pt} y ON x.{c} = y.{pc} WHERE x.{c} IS NOT NULL)
  AND (SELECT count(DISTINCT {pc}) = count({pc}) FROM {pt})"""
    for t, c in _WHOLE_COLUMNS for pt, pc in _WHOLE_COLUMNS if (t, c) != (pt, pc)) + ")"

_COLUMNS = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
            "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
            "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
            "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
            "orders": ORDERS_COLUMNS, "lineitem": LINEITEM_COLUMNS}


def keys_sql(table: str, columns: list[str]) -> str:
    """Minimal keys of one or two columns: a pair counts if neither column is a key."""
    single = {c: f"(SELECT count(DISTINCT {c}) = count(*) FROM {table})" for c in columns}
    parts = [f"SELECT '{table}' AS table_name, '{c}' AS key_columns WHERE {single[c]}" for c in columns]
    parts += [f"SELECT '{table}', '{a},{b}' WHERE NOT {single[a]} AND NOT {single[b]} AND "
              f"(SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM {table})) = (SELECT count(*) FROM {table})"
              for i, a in enumerate(columns) for b in columns[i + 1:]]
    return "\nUNION ALL ".join(parts)


SQL["find_keys"] = "\nUNION ALL ".join(keys_sql(t, cs) for t, cs in _COLUMNS.items())

SQL["audit_incremental"] = table_facts("orders", ORDERS_COLUMNS).rstrip() + ",\n" + numeric_group_sql("column_name") + f""",
t AS (SELECT column_name,
  CASE WHEN coalesce(bool_and(CASE WHEN present THEN is_num END), true) THEN 'numeric'
       WHEN coalesce(bool_and(CASE WHEN present THEN ts IS NOT NULL END), true) THEN 'datetime'
       ELSE 'string' END AS inferred_data_type,
  CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(CASE WHEN present THEN 0 ELSE n END) AS BIGINT) AS null_count,
  sum(CASE WHEN present THEN 0 ELSE n END) / sum(n) AS null_ratio,
  CAST(sum(CASE WHEN is_num THEN n ELSE 0 END) AS BIGINT) AS numeric_count,
  CAST(sum(CASE WHEN {TDATE} THEN n ELSE 0 END) AS BIGINT) AS date_count,
  strftime(min(CASE WHEN {TDATE} THEN ts END), {ISO_FMT}) AS min_timestamp,
  strftime(max(CASE WHEN {TDATE} THEN ts END), {ISO_FMT}) AS max_timestamp,
  CAST(sum(CASE WHEN is_code THEN n ELSE 0 END) AS BIGINT) AS match_count
FROM facts GROUP BY column_name)
SELECT column_name, inferred_data_type, row_count, null_count, null_ratio, numeric_count, min_value, max_value, mean,
  coalesce(negative_count, 0) AS negative_count, date_count, min_timestamp, max_timestamp, match_count
FROM t LEFT JOIN num_stats USING (column_name)"""

_CLASSED = ("regexp_replace(translate(substr(value, 1, 64), "
            "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', "
            "'AAAAAAAAAAAAAAAAAAAAAAAAAAaaaaaaaaaaaaaaaaaaaaaaaaaa9999999999'), '[^\\x00-\\x7f]', 'u', 'g')")
SQL["column_formats"] = with_(DIRTY, cells("dirty", DIRTY_COLUMNS), f"""counts AS (
  SELECT column_name, exact, count(*) AS n FROM (SELECT column_name, {_CLASSED} AS exact FROM cells
    WHERE value IS NOT NULL AND value <> '') GROUP BY ALL),
named AS (SELECT *, sum(n) OVER (PARTITION BY column_name) AS everything,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(exact, 'A+', 'A+', 'g'), 'a+', 'a+', 'g'), '9+', '9+', 'g'),
                   'u+', 'u+', 'g') AS general FROM counts),
groups AS (
  SELECT column_name, general, everything, sum(n) AS total, sum(8 * length(exact) + n * log2(everything / n)) AS one_by_one,
    sum(n * coalesce(list_sum(list_transform(regexp_extract_all(exact, 'A+|a+|9+|u+'),
                                             lambda r: 2 * floor(log2(length(r))) + 1)), 0)) AS lengths
  FROM named GROUP BY ALL),
chosen AS (SELECT *, lengths + 8 * length(general) + total * log2(everything / total) < one_by_one AS merged FROM groups),
rendered AS (
  SELECT column_name, general AS format, total AS n, everything FROM chosen WHERE merged
  UNION ALL
  SELECT column_name, array_to_string(list_transform(regexp_extract_all(exact, '(?s)A+|a+|9+|u+|.'),
      lambda r: CASE WHEN length(r) > 1 THEN substr(r, 1, 1) || '{{' || length(r) || '}}' ELSE r END), ''), n, named.everything
  FROM named JOIN chosen USING (column_name, general) WHERE NOT merged)""").rstrip() + """
SELECT column_name, format, CAST(sum(n) AS BIGINT) AS values, round(sum(n) / any_value(everything), 9) AS share
FROM rendered GROUP BY column_name, format"""

_DIGITS = "list_reverse(string_split(d, ''))"
_LUHN = (f"list_sum(list_transform({_DIGITS}, lambda c, i: CASE WHEN i % 2 = {{odd}} THEN TRY_CAST(c AS INTEGER) "
         "ELSE (2 * TRY_CAST(c AS INTEGER)) // 10 + (2 * TRY_CAST(c AS INTEGER)) % 10 END))")
_NUMBERED = ("TRY_CAST(array_to_string(list_transform(string_split(d, ''), lambda c: CASE WHEN c >= 'A' "
             "THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '') AS HUGEINT) % 97")
SQL["personal_data_evidence"] = f"""WITH base AS (
  SELECT o_orderkey AS k, o_orderpriority AS c6, '4' || lpad(CAST(o_orderkey AS VARCHAR), 14, '0') AS card,
    lpad(CAST(o_orderkey * 7919 + 13 AS VARCHAR), 16, '0') AS account FROM orders),
payments AS (
  SELECT card || (SELECT CAST((10 - ({_LUHN.format(odd=0)}) % 10) % 10 AS VARCHAR) FROM (SELECT card AS d)) AS c1,
    'DE' || (SELECT lpad(CAST(98 - {_NUMBERED} AS VARCHAR), 2, '0') FROM (SELECT account || 'DE00' AS d)) || account AS c2,
    CASE WHEN k % 5 <> 0 THEN 'u' || CAST(k AS VARCHAR) || '@mail.example' ELSE 'none' END AS c3,
    '4' || lpad(CAST(k AS VARCHAR), 15, '0') AS c4, 'DE00' || account AS c5, c6 FROM base),
{cells("payments", ["c1", "c2", "c3", "c4", "c5", "c6"])},
kinds AS (
  SELECT column_name, CASE
    WHEN regexp_full_match(value, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') THEN 'email'
    WHEN regexp_full_match(value, '[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]){{11,30}}')
      AND (SELECT {_NUMBERED} FROM (SELECT substr(value, 5) || substr(value, 1, 4) AS d)) = 1 THEN 'iban'
    WHEN regexp_full_match(value, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') THEN 'national_id'
    WHEN regexp_full_match(value, '[0-9]([ -]?[0-9]){{12,18}}')
      AND (SELECT ({_LUHN.format(odd=1)}) % 10 FROM (SELECT value AS d)) = 0 THEN 'card'
    WHEN regexp_full_match(value, '\\+[0-9][0-9 ().-]{{6,20}}[0-9]') THEN 'phone' END AS kind
  FROM cells WHERE value IS NOT NULL AND value <> ''),
counted AS (SELECT column_name, kind, count(*) AS n, sum(count(*)) OVER (PARTITION BY column_name) AS total
  FROM kinds GROUP BY column_name, kind)
SELECT column_name, kind, n AS values, CAST(total AS BIGINT) AS present_values, round(n / total, 9) AS share,
  n / total >= 0.5 AS personal_data FROM counted WHERE kind IS NOT NULL"""

SQL["source_bson"] = column_profile_sql(with_(
    "open_orders AS (SELECT * FROM orders WHERE o_orderstatus = 'O')",
    cells("open_orders", ORDERS_COLUMNS, cast=True), freq(), facts()))
