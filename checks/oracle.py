"""The same results as plain SQL for DuckDB, one statement per query."""

from __future__ import annotations

from checks.queries import (
    CODES, EVENT_PERIOD, IND, LISTED, MISSING, SEQ_COLS, TOP, TRAIN_END, VAL_END,
    VARIANCE_DECIMALS, bundle_names, decimals,
)
from paneltide.spec import ENTITY_ATTRS

ATTRS = ", ".join(ENTITY_ATTRS)
INDS = ", ".join(IND)
CELLS = "subdistrict_code, date"
COLUMNS = f"id, {ATTRS}, sector, date, {INDS}"
ENTITY = "PARTITION BY subdistrict_code ORDER BY date"


def day(d) -> str:
    return f"DATE '{d.isoformat()}'"


def days(ds) -> str:
    return ", ".join(day(d) for d in ds)


_AGGS = """
  sum(l_quantity) AS qty,
  round(sum(round(l_extendedprice * 100)) / 100) AS revenue,
  round(sum(round(l_extendedprice * 100) * round(100 - l_discount * 100)) / 10000) AS net_revenue,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS returned_qty,
  floor(sum(round(l_discount * 100)) * 100 / count(*)) / CAST(10000 AS DOUBLE) AS avg_discount,
  floor(sum(round(l_tax * 100)) * 100 / count(*)) / CAST(10000 AS DOUBLE) AS avg_tax,
  count(*) AS n_lines,
  max(l_linenumber) AS max_line"""

RAW = f"""WITH lines AS (
  SELECT *, CAST(date_trunc('month', l_shipdate) AS DATE) AS m FROM lineitem),
sums AS (
  SELECT l_suppkey, m, l_returnflag AS sector, {_AGGS} FROM lines GROUP BY l_suppkey, m, l_returnflag
  UNION ALL
  SELECT l_suppkey, m, 'Total' AS sector, {_AGGS} FROM lines GROUP BY l_suppkey, m),
raw AS (
  SELECT (l_suppkey * 100000 + year(m) * 12 + month(m)) * 4
         + CASE sector WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 0 END AS id,
         r_name AS state_name, r_regionkey AS state_code, n_name AS district_name,
         n_nationkey AS district_code, s_name AS subdistrict_name,
         CAST(s_suppkey AS INTEGER) AS subdistrict_code, sector, m AS date, {INDS}
  FROM sums JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

PANEL = RAW + """,
panel AS (SELECT * FROM raw WHERE sector = 'Total')"""


def axis_of(table: str) -> str:
    return (f"(SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE)"
            f" AS date FROM {table})")


DENSE = PANEL + f""",
gaps AS (
  SELECT e.*, a.date FROM (SELECT DISTINCT {ATTRS} FROM panel) e, {axis_of('panel')} a
  WHERE NOT EXISTS (SELECT 1 FROM panel p
                    WHERE p.subdistrict_code = e.subdistrict_code AND p.date = a.date)),
dense AS (
  SELECT {COLUMNS} FROM panel
  UNION ALL BY NAME SELECT *, 'Total' AS sector FROM gaps)"""


def select(cte: str, body: str) -> str:
    return f"{cte}\nSELECT {body}"


def rounded(expr: str, name: str) -> str:
    return f'round({expr}, {decimals(name)}) AS "{name}"'


def each(template: str, cols=IND, names=None) -> str:
    """Rounded expressions per column; ``{c}`` stands for the column."""
    names = names or list(cols)
    return ", ".join(rounded(template.format(c=c), n) for c, n in zip(cols, names))


def frame(preceding: int) -> str:
    return f"OVER ({ENTITY} ROWS BETWEEN {preceding} PRECEDING AND CURRENT ROW)"


def long_rows(cols, table: str, value: str) -> str:
    """One row per column and table row."""
    return " UNION ALL ".join(
        f"SELECT {CELLS}, '{c}' AS feature, CAST({c} AS DOUBLE) AS {value} FROM {table}"
        for c in cols)


def variance_rows(value: str = "variance") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, var_samp({c}) AS {value} FROM panel" for c in IND)


def rounded_variance(value: str) -> str:
    cases = " ".join(f"WHEN '{c}' THEN round({value}, {n})" for c, n in VARIANCE_DECIMALS.items())
    return f"CASE feature {cases} END AS {value}"


def trends() -> str:
    means = ", ".join(rounded(f"avg({c})", f"avg({c})") for c in IND)
    return (f"CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, {means} "
            "FROM panel GROUP BY ALL")


def describe_rows() -> str:
    numeric = ["state_code", "district_code", "subdistrict_code", *IND]
    out = []
    for c in [*ENTITY_ATTRS, "sector", "date", *IND]:
        if c in numeric:
            q = ", ".join(rounded(f"quantile_cont(CAST({c} AS DOUBLE), {f})", n).replace(
                f", {decimals(n)})", f", {decimals(c)})")
                for f, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
            stats = (f'round(avg({c}), {decimals(c)}) AS mean, '
                     f'round(stddev_samp({c}), {decimals(c)}) AS std, '
                     f'CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max", '
                     f"CAST(NULL AS VARCHAR) AS min_text, CAST(NULL AS VARCHAR) AS max_text, {q}")
        else:
            none = "CAST(NULL AS DOUBLE)"
            stats = (f'{none} AS mean, {none} AS std, {none} AS "min", {none} AS "max", '
                     f"CAST(min({c}) AS VARCHAR) AS min_text, CAST(max({c}) AS VARCHAR) AS max_text, "
                     f"{none} AS q25, {none} AS q50, {none} AS q75")
        out.append(f"SELECT '{c}' AS feature, count({c}) AS \"count\", "
                   f"count(*) - count({c}) AS nulls, {stats} FROM raw")
    return " UNION ALL ".join(out)


def profile_rows() -> str:
    types = {c: "string" for c in ("state_name", "district_name", "subdistrict_name", "sector")}
    types |= {c: "int" for c in ("state_code", "district_code", "subdistrict_code", "max_line")}
    types |= {"date": "date", "n_lines": "bigint"}
    extra = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{types.get(c, 'double')}' AS type, count(DISTINCT {c}) AS \"distinct\", "
        + ("CAST(0 AS BIGINT)" if types.get(c) in ("string", "date") else f"count(*) FILTER ({c} = 0)")
        + " AS zeros FROM raw"
        for c in [*ENTITY_ATTRS, "sector", "date", *IND])
    return (f"base.* EXCLUDE (nulls), nulls AS missing, type, \"distinct\", zeros "
            f"FROM ({describe_rows()}) base JOIN ({extra}) extra USING (feature)")


def filled(order: str) -> str:
    """Forward, then backward fill in one window order."""
    return ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({order} ROWS UNBOUNDED PRECEDING), "
        f"first_value({c} IGNORE NULLS) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in IND)


def chain(order: str) -> str:
    smooth = ", ".join(
        f"CASE WHEN count({c}) {frame(2)} = 3 THEN avg({c}) {frame(2)} END AS {c}" for c in IND)
    means = each("coalesce(s.{c}, (SELECT avg({c}) FROM smooth))")
    return (f"{DENSE}, filled AS (SELECT {CELLS}, {filled(order)} FROM dense), "
            f"smooth AS (SELECT {CELLS}, {smooth} FROM filled) SELECT {CELLS}, {means} FROM smooth s")


def bundle(cols, source: str, keep: str) -> str:
    parts = []
    for c in cols:
        parts += [f"lag({c}, {k}) OVER ({ENTITY}) AS {c}_lag{k}" for k in (1, 3)]
        parts += [f"avg({c}) {frame(3)} AS {c}_roll_avg3", f"stddev_samp({c}) {frame(3)} AS {c}_roll_std3",
                  f"avg({c}) OVER (PARTITION BY district_code) AS {c}_district_avg"]
    return f"SELECT {keep}, {', '.join(parts)} FROM {source}"


def rounded_names(names) -> str:
    return ", ".join(rounded(n, n) for n in names)


def correlation(cols, source: str, digits: str = "round(r, 6)") -> str:
    rows = " UNION ALL ".join(f"SELECT id, '{c}' AS col, CAST({c} AS DOUBLE) AS v FROM {source}" for c in cols)
    return (f"long AS ({rows}), pairs AS (SELECT a.col AS col_a, b.col AS col_b, "
            "corr(a.v, b.v) AS r0, count(*) AS n FROM long a JOIN long b USING (id) "
            "WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY ALL), "
            "correlations AS (SELECT col_a, col_b, CASE WHEN isnan(r0) THEN NULL ELSE r0 END AS r, n FROM pairs)")


CORRELATION = PANEL + ", " + correlation(IND, "panel")
HIGH = "(SELECT col_b FROM correlations WHERE col_a <> col_b AND abs(r) > 0.9)"
EARLIER = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(IND))
HIGH_LATER = (f"(SELECT col_b FROM correlations WHERE abs(r) > 0.9 AND "
              f"CASE col_a {EARLIER} END < CASE col_b {EARLIER} END)")
FLAT = f"(SELECT feature FROM ({variance_rows()}) WHERE variance < 0.01)"


def remaining(dropped: str) -> str:
    return (f"{CORRELATION} SELECT * FROM ({long_rows(IND, 'panel', 'value')}) "
            f"WHERE feature NOT IN {dropped} AND feature NOT IN {FLAT}")


SEQ = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SEQ_COLS)
NUMBERED = (DENSE + f", numbered AS (SELECT {CELLS}, {SEQ}, row_number() OVER ({ENTITY}) AS i, "
            "count(*) OVER (PARTITION BY subdistrict_code) AS n FROM dense)")
STEPS = "(SELECT unnest(range(12)) AS position)"


def windows(last: int, shift: int = 0) -> str:
    """Exploded windows that start at row i with i <= n - last."""
    cols = ", ".join(f"r.{c}" for c in SEQ_COLS)
    return (f"SELECT s.subdistrict_code, s.date AS start, CAST(position AS INTEGER) AS position, "
            f"r.date, {cols} FROM numbered s, {STEPS} k JOIN numbered r "
            f"ON r.subdistrict_code = s.subdistrict_code AND r.i = s.i + position + {shift} "
            f"WHERE s.i <= s.n - {last}")


YEAR_MONTH = "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month"
BEFORE = f"date < DATE '{EVENT_PERIOD[0]}-01-01'"
AFTER = f"date >= DATE '{EVENT_PERIOD[0]}-10-01'"
IN_EVENT = f"year(date) = {EVENT_PERIOD[0]} AND month(date) BETWEEN {EVENT_PERIOD[1]} AND {EVENT_PERIOD[2]}"
SPLIT = (f"CASE WHEN date <= {day(TRAIN_END)} THEN 'train' WHEN date <= {day(VAL_END)} THEN 'val' "
         "ELSE 'test' END AS split")
LISTED_ROWS = f"(SELECT unnest([{days(LISTED)}]) AS date)"
ENTITIES = f"(SELECT DISTINCT {ATTRS} FROM panel)"
FIRST_ROUND = bundle_names(IND)
PARTIAL = PANEL + f", part AS (SELECT * FROM panel WHERE date NOT IN ({days(MISSING)}))"


def top_rows(k: int) -> str:
    return f"(SELECT * FROM ({variance_rows('importance')}) ORDER BY importance DESC, feature LIMIT {k})"


def histogram() -> str:
    out = []
    for c in ("qty", "revenue", "returned_qty", "max_line"):
        out.append(
            f"SELECT '{c}' AS feature, bin, round(lo + (hi - lo) / 10 * bin, 6) AS low, "
            f"round(lo + (hi - lo) / 10 * (bin + 1), 6) AS high, count(*) AS n FROM ("
            f"SELECT lo, hi, CAST(least(floor((CAST({c} AS DOUBLE) - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 10), 9) AS INTEGER) AS bin "
            f"FROM panel, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM panel) "
            f"WHERE {c} IS NOT NULL) GROUP BY bin, lo, hi")
    return " UNION ALL ".join(out)


def top_values() -> str:
    out = []
    for c, number in (("sector", False), ("state_name", False), ("max_line", True), ("qty", True)):
        num = f"CAST({c} AS DOUBLE)" if number else "CAST(NULL AS DOUBLE)"
        text = "CAST(NULL AS VARCHAR)" if number else f"CAST({c} AS VARCHAR)"
        out.append(f"SELECT * FROM (SELECT '{c}' AS feature, {num} AS number, {text} AS text, count(*) AS n, "
                   f"CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM raw "
                   f"WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5")
    return " UNION ALL ".join(out)


ORACLE: dict[str, str] = {
    "scan_csv": select(RAW, f"{COLUMNS} FROM raw"),
    "scan_parquet": "SELECT * FROM lineitem",
    "literal_rows": select(PANEL, f"l.date, count(p.date) AS n_rows FROM {LISTED_ROWS} l "
                                  "LEFT JOIN panel p USING (date) GROUP BY l.date"),
    "filter_date": select(PANEL, f"{COLUMNS} FROM panel WHERE date = {day(MISSING[0])}"),
    "filter_entity": select(PANEL, f"{COLUMNS} FROM panel WHERE subdistrict_code IN "
                                   f"({', '.join(map(str, CODES))})"),
    "select_cols": select(RAW, f"{ATTRS}, sector, date FROM raw"),
    "select_exclude": select(RAW, f"sector, date, {INDS} FROM raw"),
    "select_by_dtype": select(RAW, f"id, state_code, district_code, subdistrict_code, {INDS} FROM raw"),
    "select_from_table": select(PANEL, f"* FROM ({long_rows(IND, 'panel', 'value')}) WHERE feature IN "
                                       f"(SELECT feature FROM ({variance_rows()}) WHERE variance >= 1)"),
    "select_existing": select(PANEL, "qty, revenue, date, subdistrict_code FROM panel"),
    "drop_cols": select(RAW, "state_name, district_name, subdistrict_name, subdistrict_code, sector, "
                             f"date, {INDS} FROM raw"),
    "rename_cols": select(PANEL, f"{CELLS}, qty AS quantity, revenue AS turnover FROM panel"),
    "with_column": select(PANEL, "* REPLACE (coalesce(returned_qty, 0) AS returned_qty), "
                                 "revenue / CAST(1000 AS DOUBLE) AS revenue_thousands FROM panel"),
    "pad_nulls": select(PANEL, f"* FROM (SELECT {COLUMNS} FROM panel LIMIT 0) "
                               f"UNION ALL BY NAME SELECT e.*, l.date FROM {ENTITIES} e, {LISTED_ROWS} l"),
    "drop_null_rows": select(PANEL, f"{COLUMNS} FROM panel WHERE returned_qty IS NOT NULL"),
    "cross_entities_dates": select(PANEL, f"e.*, a.date FROM {ENTITIES} e, {axis_of('panel')} a"),
    "missing_months_global": select(PARTIAL, f"date FROM {axis_of('part')} WHERE date NOT IN (SELECT date FROM part)"),
    "missing_months_per_entity": select(DENSE, f"{ATTRS}, date FROM gaps"),
    "distinct_entities": select(RAW, f"DISTINCT {ATTRS} FROM raw"),
    "distinct_rows": select(PANEL, f"{COLUMNS} FROM panel"),
    "distinct_dates": select(RAW, "DISTINCT date FROM raw"),
    "monthly_trends": select(PANEL, trends()),
    "trend_series": select(PANEL, " UNION ALL ".join(
        f"SELECT {YEAR_MONTH}, year(date) || '-' || month(date) AS year_month, '{c}' AS feature, "
        f"round(avg({c}), {decimals(c)}) AS mean FROM panel GROUP BY ALL" for c in IND)[len("SELECT "):]),
    "describe_table": f"{RAW} {describe_rows()}",
    "date_bounds": select(RAW, "min(date) AS min_date, max(date) AS max_date FROM raw"),
    "table_shape": select(RAW, f"count(*) AS n_rows, CAST({len(COLUMNS.split(','))} AS INTEGER) AS n_columns FROM raw"),
    "column_variance": select(PANEL, f"feature, {rounded_variance('variance')} FROM ({variance_rows()})"),
    "column_means": f"{PANEL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), {decimals(c)}) AS mean FROM panel" for c in IND),
    "column_median": f"{PANEL} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM panel" for c in IND),
    "percentile_cut": select(PANEL, "round(quantile_cont(net_revenue, 0.2), 3) AS cut FROM panel"),
    "rolling_mean_impute": select(DENSE, f"{CELLS}, " + each("coalesce({c}, avg({c}) " + frame(2) + ")") + " FROM dense"),
    "lag_features": select(PANEL, f"{CELLS}, " + ", ".join(
        f"lag({c}, {k}) OVER ({ENTITY}) AS {c}_lag{k}" for c in IND for k in (1, 3)) + " FROM panel"),
    "rolling_mean_features": select(DENSE, f"{CELLS}, " + each(
        "avg({c}) " + frame(3), names=[f"{c}_roll_avg3" for c in IND]) + " FROM dense"),
    "rolling_std_features": select(DENSE, f"{CELLS}, " + each(
        "stddev_samp({c}) " + frame(3), names=[f"{c}_roll_std3" for c in IND]) + " FROM dense"),
    "group_mean_feature": select(PANEL, f"{CELLS}, " + each(
        "avg({c}) OVER (PARTITION BY district_code)", names=[f"{c}_district_avg" for c in IND]) + " FROM panel"),
    "rolling_mean_smooth": select(DENSE, f"{CELLS}, " + each(
        "CASE WHEN count({c}) " + frame(2) + " = 3 THEN avg({c}) " + frame(2) + " END") + " FROM dense"),
    "forward_fill": select(DENSE, f"{CELLS}, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER ({ENTITY} ROWS UNBOUNDED PRECEDING) AS {c}" for c in IND) + " FROM dense"),
    "backward_fill": select(DENSE, f"{CELLS}, " + ", ".join(
        f"first_value({c} IGNORE NULLS) OVER ({ENTITY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}"
        for c in IND) + " FROM dense"),
    "fill_across_entities": select(DENSE, f"{CELLS}, {filled('ORDER BY subdistrict_code, date')} FROM dense"),
    "impute_chain": chain(ENTITY),
    "impute_chain_across": chain("ORDER BY subdistrict_code, date"),
    "median_impute": select(DENSE, f"{CELLS}, " + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM dense)) AS {c}"
        for c in IND) + " FROM dense"),
    "head_n": select(PANEL, f"{COLUMNS} FROM panel ORDER BY subdistrict_code, date LIMIT 10"),
    "top_k_features": select(PANEL, f"feature, {rounded_variance('importance')} FROM {top_rows(TOP)}"),
    "union_by_name_pad": select(PANEL, f"{COLUMNS} FROM panel UNION ALL BY NAME SELECT e.*, l.date FROM {ENTITIES} e, {LISTED_ROWS} l"),
    "union_aligned": select(RAW, f"{COLUMNS} FROM raw"),
    "parse_date": """WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'n/a'
          WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%d-%m-%Y')
          ELSE strftime(l_shipdate, '%Y-%m-%d') END AS text FROM lineitem)
        SELECT *, CAST(coalesce(try_strptime(text, '%d-%m-%Y'), try_strptime(text, '%Y-%m-%d')) AS DATE) AS date FROM t""",
    "parse_timestamp": """WITH t AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d')
          ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS text FROM events),
        p AS (SELECT *, CAST(coalesce(try_strptime(text, '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(text, '%Y-%m-%d')) AS TIMESTAMP) AS parsed FROM t)
        SELECT *, CAST(parsed AS DATE) AS day FROM p""",
    "date_parts": select(PANEL, f"{CELLS}, qty, {YEAR_MONTH} FROM panel"),
    "year_month_label": select(PANEL, f"{CELLS}, {YEAR_MONTH}, year(date) || '-' || month(date) AS year_month FROM panel"),
    "flag_period": select(PANEL, f"{CELLS}, CASE WHEN {IN_EVENT} THEN 1 ELSE 0 END AS is_covid_period FROM panel"),
    "cast_cols": select(PANEL, f"{CELLS}, CAST(qty AS INTEGER) AS qty, CAST(n_lines AS VARCHAR) AS n_lines, "
                               "CAST(avg_tax AS FLOAT) AS avg_tax FROM panel"),
    "null_test": select(DENSE, f"{CELLS}, qty, returned_qty, qty IS NULL AS qty_is_null, "
                               "returned_qty IS NULL AS returned_qty_is_null, CAST(NULL AS DOUBLE) AS nothing FROM dense"),
    "between_bool": select(PANEL, f"{CELLS}, qty, {YEAR_MONTH}, year(date) = 2000 AND month(date) BETWEEN 1 AND 9 AS inside, "
                                  "year(date) < 2000 OR (year(date) = 2000 AND month(date) > 9) AS outside, "
                                  "NOT (qty < 100) AS not_small FROM panel"),
    "date_axis": select(PANEL, f"date FROM {axis_of('panel')}"),
    "densify_listed": select(PANEL, f"{COLUMNS} FROM panel UNION ALL BY NAME SELECT e.*, 'Total' AS sector, l.date "
                                    f"FROM {ENTITIES} e, {LISTED_ROWS} l WHERE NOT EXISTS (SELECT 1 FROM panel p "
                                    "WHERE p.subdistrict_code = e.subdistrict_code AND p.date = l.date)"),
    "densify_listed_union": select(PANEL, f"{COLUMNS} FROM panel UNION ALL BY NAME SELECT e.*, 'Total' AS sector, l.date "
                                          f"FROM {ENTITIES} e, {LISTED_ROWS} l"),
    "densify_missing": select(PARTIAL, f"{COLUMNS} FROM part UNION ALL BY NAME SELECT e.*, a.date FROM "
                                       f"(SELECT DISTINCT {ATTRS} FROM part) e, {axis_of('part')} a "
                                       "WHERE a.date NOT IN (SELECT date FROM part)"),
    "densify_full": select(DENSE, f"{COLUMNS} FROM dense"),
    "feature_bundle": f"{PANEL}, b AS ({bundle(IND, 'panel', CELLS)}) SELECT {CELLS}, {rounded_names(bundle_names(IND))} FROM b",
    "feature_bundle_rounds": (
        f"{PANEL}, b1 AS ({bundle(IND, 'panel', CELLS + ', district_code')}), "
        f"b2 AS ({bundle(FIRST_ROUND, 'b1', CELLS + ', ' + ', '.join(FIRST_ROUND))}) "
        f"SELECT {CELLS}, {rounded_names(FIRST_ROUND + bundle_names(FIRST_ROUND))} FROM b2"),
    "model_matrix": (
        f"{PANEL}, b AS ({bundle(IND, 'panel', f'{ATTRS}, sector, date, {INDS}')}) "
        f"SELECT {INDS}, {rounded_names(bundle_names(IND))}, date, {YEAR_MONTH}, subdistrict_name, "
        f"CASE WHEN {IN_EVENT} THEN 1 ELSE 0 END AS is_covid_period, state_name, district_code, state_code, sector, "
        f"district_name, subdistrict_code FROM b WHERE "
        + " AND ".join(f"{n} IS NOT NULL" for n in [*IND, *bundle_names(IND)])),
    "split_periods": select(PANEL, f"{COLUMNS}, CASE WHEN {BEFORE} THEN 'before' ELSE 'after' END AS period "
                                   f"FROM panel WHERE {BEFORE} OR {AFTER}"),
    "split_by_date": select(PANEL, f"{CELLS}, qty, {SPLIT} FROM panel"),
    "series_extract": f"{PANEL} {long_rows(IND, 'panel', 'value')}",
    "correlation_matrix": f"{CORRELATION} SELECT col_a, col_b, round(r, 6) AS r, n FROM correlations",
    "correlation_matrix_wide": (
        f"{PANEL}, b AS ({bundle(IND, 'panel', 'id, ' + INDS)}), {correlation(IND + bundle_names(IND), 'b')} "
        "SELECT col_a, col_b, round(r, 6) AS r, n FROM correlations"),
    "high_corr_pairs": f"{CORRELATION} SELECT col_a, col_b, round(r, 6) AS r, n FROM correlations "
                       "WHERE col_a <> col_b AND abs(r) > 0.9",
    "low_variance_cols": select(PANEL, f"feature, {rounded_variance('variance')} FROM ({variance_rows()}) WHERE variance < 0.01"),
    "filter_features": remaining(HIGH),
    "filter_features_keep_first": remaining(HIGH_LATER),
    "standard_scale": select(PANEL, f"{CELLS}, " + ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM panel)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 "
        f"ELSE stddev_pop({c}) END FROM panel), 6) AS {c}" for c in IND) + " FROM panel"),
    "minmax_scale": f"{PANEL}, train AS (SELECT * FROM panel WHERE date <= {day(TRAIN_END)}) SELECT {CELLS}, " + ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT min({c}) FROM train)) / (SELECT CASE WHEN max({c}) = min({c}) THEN 1 "
        f"ELSE CAST(max({c}) - min({c}) AS DOUBLE) END FROM train), 6) AS {c}" for c in IND) + " FROM panel",
    "column_profile": select(RAW, profile_rows()),
    "column_profile_histogram": f"{PANEL} {histogram()}",
    "column_profile_top_values": f"{RAW} {top_values()}",
    "column_profile_duplicates": """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_returnflag)
        SELECT CAST(sum(n - 1) AS BIGINT) AS repeated_rows, count(*) FILTER (n > 1) AS repeated_values FROM g""",
    "sequence_window": f"{NUMBERED} {windows(11)}",
    "sequences_autoencode": f"{NUMBERED} {windows(12)}",
    "sequences_io": f"{NUMBERED} SELECT *, 'x' AS side FROM ({windows(12)}) UNION ALL "
                    f"SELECT *, 'y' AS side FROM ({windows(12, 1)})",
    "sequences_across_entities": (
        f"{PANEL}, numbered AS (SELECT {CELLS}, {SEQ}, row_number() OVER (ORDER BY subdistrict_code, date) - 1 AS i, "
        f"count(*) OVER () AS n FROM panel) SELECT side, s.i AS window_id, CAST(position AS INTEGER) AS position, "
        f"r.subdistrict_code, r.date, {', '.join('r.' + c for c in SEQ_COLS)} FROM numbered s, {STEPS} k, "
        "(VALUES ('x', 0), ('y', 1)) AS sides(side, ahead) "
        "JOIN numbered r ON r.i = s.i + position + ahead WHERE s.i < s.n - 12"),
    "pseudo_label": select(PANEL, f"{CELLS}, net_revenue AS score, CAST(net_revenue < (SELECT quantile_cont(net_revenue, 0.2) "
                                  "FROM panel) AS INTEGER) AS pseudo_label FROM panel"),
    "select_top_features": select(PANEL, f"* FROM ({long_rows(IND, 'panel', 'value')}) WHERE feature IN "
                                         f"(SELECT feature FROM {top_rows(TOP)})"),
    "reconstruction_evaluate": (
        f"{PANEL}, s AS (SELECT net_revenue AS error, {SPLIT} FROM panel), "
        "t AS (SELECT quantile_cont(error, 0.95) AS cut FROM s WHERE split = 'val') "
        "SELECT split, round(cut, 3) AS threshold, count(*) AS n_windows, round(avg(error), 3) AS mean_error, "
        "count(*) FILTER (error > cut) AS n_flagged FROM s, t GROUP BY split, cut"),
}

for _name in ("sink_csv", "sink_parquet", "stage_via_parquet", "checkpoint_stage", "filter_slice", "sort_panel"):
    ORACLE[_name] = select(PANEL, f"{COLUMNS} FROM panel")
ORACLE["sink_parquet"] = select(PANEL, f"{COLUMNS}, CAST(year(date) AS INTEGER) AS year FROM panel")
for _name in ("sink_csv_single", "cache_stage", "sort_time"):
    ORACLE[_name] = ORACLE["monthly_trends"]
ORACLE["resumed_chain"] = ORACLE["impute_chain"]
ORACLE["lag_features_bucketed"] = ORACLE["lag_features"]
ORACLE["sequences_in_splits"] = (
    DENSE + f", numbered AS (SELECT {CELLS}, {SEQ}, split, row_number() OVER (PARTITION BY subdistrict_code, split "
    "ORDER BY date) AS i, count(*) OVER (PARTITION BY subdistrict_code, split) AS n FROM "
    f"(SELECT *, {SPLIT} FROM dense)) SELECT s.subdistrict_code, s.split, s.date AS start, CAST(position AS INTEGER) AS position, r.date, "
    f"{', '.join('r.' + c for c in SEQ_COLS)} FROM numbered s, {STEPS} k JOIN numbered r ON "
    "r.subdistrict_code = s.subdistrict_code AND r.split = s.split AND r.i = s.i + position WHERE s.i <= s.n - 11")
ORACLE["lag_features_monthly"] = ORACLE["lag_features"]
ORACLE["scan_csv_checked"] = select(PANEL, f"id, {CELLS}, {INDS} FROM panel WHERE id % 5 <> 0")
ORACLE["profile_by_months"] = PANEL + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, count(*) - count({c}) AS nulls, count(*) FILTER ({c} = 0) AS zeros, "
    f"CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, true AS distinct_near, true AS median_near "
    "FROM panel WHERE year(date) BETWEEN 1994 AND 1996" for c in IND)
