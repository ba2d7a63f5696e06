"""One query per operator, over the panel derived from the order tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from paneltide.functions import columns as C
from paneltide.functions import dates as D
from paneltide.operators import densify as G
from paneltide.operators import features as X
from paneltide.operators import impute as I
from paneltide.operators import importance as M
from paneltide.operators import isolation as A
from paneltide.operators import monthly as Y
from paneltide.operators import profile as P
from paneltide.operators import quantiles as Q
from paneltide.operators import reconstruct as R
from paneltide.operators import recurrent as N
from paneltide.operators import scale as Z
from paneltide.operators import sequences as S
from paneltide.operators import stats as T
from paneltide.plans.anomaly import model_panel
from paneltide.session import checkpoint_stage, stage_path
from paneltide.sources import io
from paneltide.sources.checked_csv import scan_csv_checked as read_checked
from paneltide.sources.bucketed import overwrite_months, sink_bucketed
from paneltide.sources.stages import StageCatalogue
from paneltide.sources.supply_panel import INDICATORS, SPEC, TOTAL, raw_panel, total_panel

IND = list(INDICATORS)
CELL = list(SPEC.cell)
SEQ_COLS = IND
MISSING = [dt.date(1995, 4, 1), dt.date(1995, 5, 1)]
LISTED = [dt.date(1995, 4, 1), dt.date(2001, 12, 1)]
TRAIN_END, VAL_END = dt.date(1999, 12, 31), dt.date(2000, 12, 31)
EVENT_PERIOD = (2000, 1, 9)
CODES = [1, 2, 3]
TOP = 5

# Decimals compared for derived values: rates are small, amounts large.
RATES = ("avg_discount", "avg_tax")
VARIANCE_DECIMALS = {"qty": 3, "revenue": 0, "net_revenue": 0, "returned_qty": 3,
                     "avg_discount": 9, "avg_tax": 9, "n_lines": 6, "max_line": 6}


def decimals(column: str) -> int:
    return 7 if any(r in column for r in RATES) else 3


def to_decimals(x: Column, n: int) -> Column:
    """Half away from zero in double arithmetic, which is how DuckDB rounds doubles."""
    scale = float(10 ** n)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    """Round derived doubles for comparison; the other columns stay as they are."""
    chosen = {c for c in cols if df.schema[c].dataType == DoubleType()}
    return df.select(*[to_decimals(F.col(f"`{c}`"), decimals(c)).alias(c) if c in chosen
                       else F.col(f"`{c}`") for c in df.columns])


def round_by_feature(df: DataFrame, value: str) -> DataFrame:
    """Round a value column of a long table by the feature it belongs to."""
    rate = F.col("feature").rlike("avg_discount|avg_tax")
    return df.withColumn(value, F.when(rate, to_decimals(F.col(value), 7))
                                 .otherwise(to_decimals(F.col(value), 3)))


def round_variance(df: DataFrame, value: str = "variance") -> DataFrame:
    out = F.col(value)
    for c, n in VARIANCE_DECIMALS.items():
        out = F.when(F.col("feature") == c, to_decimals(F.col(value), n)).otherwise(out)
    return df.withColumn(value, out)


def staged_panel(spark: SparkSession, d: str) -> DataFrame:
    """The panel written once, for operators that read their input more than once."""
    return io.stage_via_parquet(total_panel(spark, d))


def cells(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*CELL, *cols)


def dense(spark: SparkSession, d: str) -> DataFrame:
    return G.densify_full(total_panel(spark, d), SPEC, TOTAL)


def with_months_missing(spark: SparkSession, d: str) -> DataFrame:
    return total_panel(spark, d).where(~F.col("date").isin(MISSING))


def long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    return (cells(df, [F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(CELL, cols, "feature", "value"))


# Sources and sinks ------------------------------------------------------------------

def scan_csv(spark, d):
    panel = raw_panel(spark, d)
    path = stage_path(spark, "panel-csv")
    io.sink_csv(panel, path)
    return io.scan_csv(spark, path, panel.schema)


def scan_csv_checked(spark, d):
    """Good rows of files in which some lines have a faulty number and some dates another format."""
    panel = total_panel(spark, d).select("id", "subdistrict_code", "date", *IND)
    path = stage_path(spark, "faulty-csv")
    written = panel.withColumns({
        "qty": F.when(F.col("id") % 5 == 0, F.lit("n/a")).otherwise(F.col("qty").cast("string")),
        "date": F.when(F.col("subdistrict_code") % 2 == 0, F.date_format("date", "dd.MM.yyyy"))
                 .otherwise(F.col("date").cast("string"))})
    io.sink_csv(written, path)
    return read_checked(spark, path, panel.schema, ("yyyy-MM-dd", "dd.MM.yyyy")).rows


def scan_parquet(spark, d):
    return io.scan_parquet(spark, f"{d}/lineitem.parquet")


def literal_rows(spark, d):
    months = io.literal_rows(spark, [(m.isoformat(),) for m in LISTED], "month string")
    months = months.select(D.parse_date("month").alias("date"))
    counts = total_panel(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return months.join(counts, "date", "left").select(
        "date", F.coalesce("n", F.lit(0)).alias("n_rows"))


def sink_csv(spark, d):
    panel = total_panel(spark, d)
    path = stage_path(spark, "total-csv")
    io.sink_csv(panel, path)
    back = io.scan_csv(spark, path)
    return C.cast_cols(back, {f.name: f.dataType for f in panel.schema.fields})


def sink_csv_single(spark, d):
    trends = monthly_trends(spark, d)
    path = stage_path(spark, "trends-csv")
    io.sink_csv_single(trends, path, ["year", "month"])
    return io.scan_csv(spark, path, trends.schema)


def sink_parquet(spark, d):
    panel = total_panel(spark, d)
    path = stage_path(spark, "total-parquet")
    io.sink_parquet(panel.withColumn("year", F.year("date")), path, ["year"])
    return io.scan_parquet(spark, path)


def stage_via_parquet(spark, d):
    return io.stage_via_parquet(total_panel(spark, d), csv_path=stage_path(spark, "export-csv"))


def checkpoint_query(spark, d):
    return checkpoint_stage(total_panel(spark, d))


def cache_stage(spark, d):
    panel = io.cache_stage(total_panel(spark, d))
    trends = rounded(X.monthly_trends(panel, SPEC, IND), [f"avg({c})" for c in IND])
    result = checkpoint_stage(trends.join(G.distinct_dates(panel, SPEC).select(
        F.year("date").alias("year"), F.month("date").alias("month")), ["year", "month"]))
    panel.unpersist()
    return result


# Projection, filter, predicate ------------------------------------------------------

def filter_slice(spark, d):
    return C.filter_slice(raw_panel(spark, d), "sector", TOTAL)


def filter_date(spark, d):
    return D.filter_date(total_panel(spark, d), MISSING[0])


def filter_entity(spark, d):
    return C.filter_entity(total_panel(spark, d), "subdistrict_code", CODES)


def select_cols(spark, d):
    return C.select_cols(raw_panel(spark, d), [*SPEC.attrs, "sector", "date"])


def select_exclude(spark, d):
    return C.select_exclude(raw_panel(spark, d), ["id", *SPEC.attrs])


def select_by_dtype(spark, d):
    return C.select_by_dtype(raw_panel(spark, d))


def variance_table(panel: DataFrame) -> DataFrame:
    return T.column_variance(panel, IND).withColumnRenamed("variance", "importance")


def select_from_table(spark, d):
    panel = staged_panel(spark, d)
    listed = T.column_variance(panel, IND).where("variance >= 1")
    chosen = C.select_from_table(panel, listed, "feature", CELL)
    return long_form(chosen, [c for c in chosen.columns if c not in CELL])


def select_existing(spark, d):
    return C.select_existing(total_panel(spark, d), ["qty", "births", "revenue"],
                             ["date", "subdistrict_code", "is_covid_period"])


def drop_cols(spark, d):
    return C.drop_cols(raw_panel(spark, d), ["id", "state_code", "district_code", "not_there"])


def rename_cols(spark, d):
    return C.rename_cols(total_panel(spark, d).select(*CELL, "qty", "revenue"),
                         {"qty": "quantity", "revenue": "turnover"})


def with_column(spark, d):
    return C.with_column(total_panel(spark, d), {
        "returned_qty": F.coalesce("returned_qty", F.lit(0.0)),
        "revenue_thousands": F.col("revenue") / 1000.0})


def pad_nulls(spark, d):
    panel = total_panel(spark, d)
    listed = G.cross_entities_dates(G.distinct_entities(panel, SPEC), LISTED)
    return C.pad_nulls(listed, panel)


def drop_null_rows(spark, d):
    return C.drop_null_rows(total_panel(spark, d))


# Joins and densify ------------------------------------------------------------------

def cross_entities_dates(spark, d):
    panel = total_panel(spark, d)
    return G.cross_entities_dates(G.distinct_entities(panel, SPEC), G.date_axis(panel))


def missing_months_global(spark, d):
    return G.missing_months_global(with_months_missing(spark, d))


def missing_months_per_entity(spark, d):
    return G.missing_months_per_entity(total_panel(spark, d), SPEC)


def date_axis(spark, d):
    return G.date_axis(total_panel(spark, d))


def densify_listed(spark, d):
    return G.densify_listed(total_panel(spark, d), SPEC, LISTED, TOTAL)


def densify_listed_union(spark, d):
    return G.densify_listed(total_panel(spark, d), SPEC, LISTED, TOTAL, mode="union_distinct")


def densify_missing(spark, d):
    return G.densify_missing(with_months_missing(spark, d), SPEC)


def densify_full(spark, d):
    return dense(spark, d)


def union_by_name_pad(spark, d):
    panel = total_panel(spark, d)
    return C.union_by_name_pad(
        panel, G.cross_entities_dates(G.distinct_entities(panel, SPEC), LISTED))


def union_aligned(spark, d):
    panel = total_panel(spark, d)
    return C.union_aligned(panel, raw_panel(spark, d))


# Aggregation ------------------------------------------------------------------------

def distinct_entities(spark, d):
    return G.distinct_entities(raw_panel(spark, d), SPEC)


def distinct_rows(spark, d):
    panel = total_panel(spark, d)
    return G.distinct_rows(panel.unionByName(panel))


def distinct_dates(spark, d):
    return G.distinct_dates(raw_panel(spark, d), SPEC)


def monthly_trends(spark, d):
    return rounded(X.monthly_trends(total_panel(spark, d), SPEC, IND), [f"avg({c})" for c in IND])


def trend_series(spark, d):
    return round_by_feature(X.trend_series(total_panel(spark, d), SPEC, IND), "mean")


def describe_table(spark, d):
    out = T.describe_table(io.stage_via_parquet(raw_panel(spark, d).drop("id")))
    for c in ("mean", "std", "q25", "q50", "q75"):
        out = round_by_feature(out, c)
    return out


def date_bounds(spark, d):
    return G.date_bounds(raw_panel(spark, d))


def table_shape(spark, d):
    return T.table_shape(raw_panel(spark, d))


def sample_count(spark, d):
    return T.sample_count(total_panel(spark, d))


def column_variance(spark, d):
    return round_variance(T.column_variance(total_panel(spark, d), IND))


def column_means(spark, d):
    return round_by_feature(T.column_means(total_panel(spark, d), IND), "mean")


def column_median(spark, d):
    return T.column_median(staged_panel(spark, d), IND)


def percentile_cut(spark, d):
    return Q.percentile_cut(staged_panel(spark, d), "net_revenue", 0.2).select(
        to_decimals(F.col("cut"), 3).alias("cut"))


# Windows and imputation -------------------------------------------------------------

def rolling_mean_impute(spark, d):
    return rounded(cells(I.rolling_mean_impute(dense(spark, d), SPEC, IND), IND), IND)


def lag_features(spark, d):
    df = X.lag_features(total_panel(spark, d), SPEC, IND)
    return cells(df, [f"{c}_lag{k}" for c in IND for k in X.LAGS])


def lag_features_monthly(spark, d):
    """Lags delivery by delivery (a year each): every one reads the carried rows and itself."""
    panel, state, parts = staged_panel(spark, d).select(*CELL, *IND), None, []
    years = panel.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    for year in range(years[0], years[1] + 1):
        got, state = Y.with_month(state, panel.where(F.year("date") == year), SPEC, max(X.LAGS),
                                  lambda df: X.lag_features(df, SPEC, IND))
        parts.append(io.stage_via_parquet(cells(got, [f"{c}_lag{k}" for c in IND for k in X.LAGS])))
        state = io.stage_via_parquet(state)
    return reduce(DataFrame.unionByName, parts)


def lag_features_bucketed(spark, d):
    """Lags on the bucketed table, two months of which were delivered again."""
    table, path = f"panel_{uuid.uuid4().hex}", stage_path(spark, "bucketed")
    panel = staged_panel(spark, d)
    late = F.col("date").isin(MISSING)
    old = panel.withColumns({c: F.when(late, F.lit(0)).otherwise(F.col(c)).cast(panel.schema[c].dataType)
                             for c in IND})
    sink_bucketed(old, SPEC, table, path, buckets=4)
    df = X.lag_features(overwrite_months(panel.where(late), SPEC, table), SPEC, IND)
    return cells(df, [f"{c}_lag{k}" for c in IND for k in X.LAGS])


def rolling_mean_features(spark, d):
    names = [f"{c}_roll_avg3" for c in IND]
    return rounded(cells(X.rolling_mean_features(dense(spark, d), SPEC, IND), names), names)


def rolling_std_features(spark, d):
    names = [f"{c}_roll_std3" for c in IND]
    return rounded(cells(X.rolling_std_features(dense(spark, d), SPEC, IND), names), names)


def group_mean_feature(spark, d):
    names = [f"{c}_district_avg" for c in IND]
    return rounded(cells(X.group_mean_feature(staged_panel(spark, d), SPEC, IND), names), names)


def rolling_mean_smooth(spark, d):
    return rounded(cells(I.rolling_mean_smooth(dense(spark, d), SPEC, IND), IND), IND)


def forward_fill(spark, d):
    return cells(I.forward_fill(dense(spark, d), SPEC, IND), IND)


def backward_fill(spark, d):
    return cells(I.backward_fill(dense(spark, d), SPEC, IND), IND)


def fill_across_entities(spark, d):
    return cells(I.fill_across_entities(dense(spark, d), SPEC, IND), IND)


def impute_chain(spark, d):
    return rounded(cells(I.impute_chain(dense(spark, d), SPEC, IND, stage=io.stage_via_parquet), IND), IND)


def resumed_chain(spark, d):
    """The impute chain, left after its first stage and taken up again from there."""
    chain = f"resumed-{uuid.uuid4().hex}"
    StageCatalogue(spark, chain)(dense(spark, d))
    with StageCatalogue(spark, chain) as stage:
        filled = I.impute_chain(stage(dense(spark, d)), SPEC, IND, stage=stage)
        if len(stage.reused) != 1:
            raise RuntimeError("the finished stage was not found again")
        return io.stage_via_parquet(rounded(cells(filled, IND), IND))


def impute_chain_across(spark, d):
    filled = I.impute_chain(dense(spark, d), SPEC, IND, across=True, stage=io.stage_via_parquet)
    return rounded(cells(filled, IND), IND)


def median_impute(spark, d):
    return cells(I.median_impute(io.stage_via_parquet(dense(spark, d)), IND), IND)


# Sort, limit ------------------------------------------------------------------------

def sort_panel(spark, d):
    return total_panel(spark, d).orderBy("subdistrict_code", "date")


def sort_time(spark, d):
    return monthly_trends(spark, d).orderBy("year", "month")


def head_n(spark, d):
    return total_panel(spark, d).orderBy("subdistrict_code", "date").limit(10)


def top_k_features(spark, d):
    top = M.top_k_features(variance_table(total_panel(spark, d)), TOP)
    return round_variance(top, "importance")


# Scalar functions -------------------------------------------------------------------

def parse_date(spark, d):
    lines = io.scan_parquet(spark, f"{d}/lineitem.parquet")
    text = (F.when(F.col("l_linenumber") == 7, "n/a")
             .when(F.col("l_orderkey") % 2 == 0, F.date_format("l_shipdate", "dd-MM-yyyy"))
             .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")))
    return lines.select("l_orderkey", "l_linenumber", text.alias("text")).withColumn(
        "date", D.parse_date("text"))


def parse_timestamp(spark, d):
    events = io.scan_parquet(spark, f"{d}/events.parquet")
    text = F.when(F.col("event_type") == "signup", F.date_format("ts", "yyyy-MM-dd")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    parsed = events.select("event_id", text.alias("text")).withColumn(
        "parsed", D.parse_timestamp("text"))
    return parsed.withColumn("day", F.to_date("parsed"))


def date_parts(spark, d):
    return D.date_parts(cells(total_panel(spark, d), ["qty"]))


def year_month_label(spark, d):
    return D.date_parts(cells(total_panel(spark, d), [])).withColumn(
        "year_month", D.year_month_label())


def flag_period(spark, d):
    return D.flag_period(cells(total_panel(spark, d), []), periods=[EVENT_PERIOD])


def cast_cols(spark, d):
    return C.cast_cols(cells(total_panel(spark, d), ["qty", "n_lines", "avg_tax"]),
                       {"qty": "int", "n_lines": "string", "avg_tax": "float"})


def null_test(spark, d):
    return C.null_flags(cells(dense(spark, d), ["qty", "returned_qty"]),
                        ["qty", "returned_qty"]).withColumn("nothing", F.lit(None).cast("double"))


def between_bool(spark, d):
    day = D.date_parts(cells(total_panel(spark, d), ["qty"]))
    return day.withColumns({
        "inside": (F.col("year") == 2000) & F.col("month").between(1, 9),
        "outside": (F.col("year") < 2000) | ((F.col("year") == 2000) & (F.col("month") > 9)),
        "not_small": ~(F.col("qty") < 100)})


# Panel composites -------------------------------------------------------------------

def bundle_names(cols):
    return [f"{c}_{s}" for c in cols
            for s in ("lag1", "lag3", "roll_avg3", "roll_std3", "district_avg")]


def feature_bundle(spark, d):
    names = bundle_names(IND)
    return rounded(cells(X.feature_bundle(staged_panel(spark, d), SPEC, IND), names), names)


def feature_bundle_rounds(spark, d):
    first = bundle_names(IND)
    names = first + bundle_names(first)
    panel = staged_panel(spark, d).select(*CELL, "district_code", *IND)
    df = X.feature_bundle(panel, SPEC, IND, rounds=2, stage=io.stage_via_parquet)
    return rounded(cells(df, names), names)


def model_matrix(spark, d):
    names = bundle_names(IND)
    df = D.flag_period(D.date_parts(X.feature_bundle(staged_panel(spark, d), SPEC, IND)),
                       periods=[EVENT_PERIOD])
    out = X.model_matrix(df, [*IND, *names, "not_there"],
                         ["date", "year", "month", "subdistrict_name"],
                         ["is_covid_period", "state_name", "district_code", "state_code",
                          "sector", "district_name", "subdistrict_code"])
    return rounded(out, names)


def split_periods(spark, d):
    before, after = D.split_periods(total_panel(spark, d), period=EVENT_PERIOD)
    return before.withColumn("period", F.lit("before")).unionByName(
        after.withColumn("period", F.lit("after")))


def split_by_date(spark, d):
    return D.split_by_date(cells(total_panel(spark, d), ["qty"]), TRAIN_END, VAL_END)


def series_extract(spark, d):
    return X.series_extract(total_panel(spark, d), SPEC, IND)


# Statistics -------------------------------------------------------------------------

def correlation_matrix(spark, d):
    return T.correlation_matrix(staged_panel(spark, d), IND).withColumn("r", to_decimals(F.col("r"), 6))


def correlation_matrix_wide(spark, d):
    """All pairs of the indicators and their features, by the Gram matrix."""
    df = io.stage_via_parquet(X.feature_bundle(staged_panel(spark, d), SPEC, IND))
    return T.correlation_matrix(df, IND + bundle_names(IND)).withColumn("r", to_decimals(F.col("r"), 6))


def high_corr_pairs(spark, d):
    return T.high_corr_pairs(T.correlation_matrix(staged_panel(spark, d), IND)).withColumn(
        "r", to_decimals(F.col("r"), 6))


def low_variance_cols(spark, d):
    return round_variance(T.low_variance_cols(T.column_variance(total_panel(spark, d), IND)))


def filter_features(spark, d):
    kept = T.filter_features(staged_panel(spark, d), IND)
    return long_form(kept, SPEC.values(kept))


def filter_features_keep_first(spark, d):
    kept = T.filter_features(staged_panel(spark, d), IND, policy="keep_first")
    return long_form(kept, SPEC.values(kept))


def standard_scale(spark, d):
    out = cells(Z.standard_scale(staged_panel(spark, d), IND), IND)
    return out.select(*CELL, *[to_decimals(F.col(c), 6).alias(c) for c in IND])


def minmax_scale(spark, d):
    panel = staged_panel(spark, d)
    out = cells(Z.minmax_scale(panel, IND, panel.where(F.col("date") <= F.lit(TRAIN_END))), IND)
    return out.select(*CELL, *[to_decimals(F.col(c), 6).alias(c) for c in IND])


def column_profile(spark, d):
    out = P.column_profile(io.stage_via_parquet(raw_panel(spark, d).drop("id")))
    for c in ("mean", "std", "q25", "q50", "q75"):
        out = round_by_feature(out, c)
    return out


def profile_by_months(spark, d):
    """Profile of a period merged from the sketches of its months, with its estimates held against
    exact values: distinct within 6 %, the median between the exact 48 and 52 % points."""
    panel = staged_panel(spark, d)
    sketches = io.stage_via_parquet(Y.month_sketches(panel, SPEC, IND))
    period = F.col("month").between(F.lit(dt.date(1994, 1, 1)), F.lit(dt.date(1996, 12, 1)))
    got = Y.merged_profile(sketches.where(period), (0.5,))
    rows = panel.where(F.year("date").between(1994, 1996))
    exact = rows.agg(*[F.struct(F.count_distinct(c).alias("d"), F.percentile(c, F.lit(0.48)).alias("a"),
                                F.percentile(c, F.lit(0.52)).alias("b")).alias(c) for c in IND])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["d"].alias("d"),
                                                     F.col(c)["a"].alias("a"), F.col(c)["b"].alias("b")) for c in IND])))
    return got.join(exact, "feature").select(
        "feature", "n", "nulls", "zeros", "low", "high",
        (F.abs(F.col("distinct") - F.col("d")) <= 0.06 * F.col("d")).alias("distinct_near"),
        F.col("q50").between(F.col("a"), F.col("b")).alias("median_near"))


def column_profile_histogram(spark, d):
    out = P.column_histogram(staged_panel(spark, d), ["qty", "revenue", "returned_qty", "max_line"])
    return out.withColumns({c: to_decimals(F.col(c), 6) for c in ("low", "high")})


def column_profile_top_values(spark, d):
    return P.column_top_values(raw_panel(spark, d), ["sector", "state_name", "max_line", "qty"])


def column_profile_duplicates(spark, d):
    lines = io.scan_parquet(spark, f"{d}/lineitem.parquet")
    return P.duplicate_rows(lines, ["l_suppkey", "l_quantity", "l_returnflag"])


# Sequences and anomalies ------------------------------------------------------------

def sequence_window(spark, d):
    windows = S.sequence_window(dense(spark, d), SPEC, SEQ_COLS)
    return S.explode_window(windows, "window", ["subdistrict_code", "start"])


def sequences_autoencode(spark, d):
    windows = S.sequences_autoencode(dense(spark, d), SPEC, SEQ_COLS)
    return S.explode_window(windows, "window", ["subdistrict_code", "start"])


def sequences_in_splits(spark, d):
    windows = S.sequences_in_splits(D.split_by_date(dense(spark, d), TRAIN_END, VAL_END), SPEC, SEQ_COLS)
    return S.explode_window(windows, "window", ["subdistrict_code", "split", "start"])


def sequences_io(spark, d):
    windows = S.sequences_io(dense(spark, d), SPEC, SEQ_COLS)
    x = S.explode_window(windows, "x", ["subdistrict_code", "start"]).withColumn("side", F.lit("x"))
    y = S.explode_window(windows, "y", ["subdistrict_code", "start"]).withColumn("side", F.lit("y"))
    return x.unionByName(y)


def sequences_across_entities(spark, d):
    windows = S.sequences_across_entities(total_panel(spark, d), SPEC, SEQ_COLS)

    def side(name):
        return (S.explode_window(windows, name, ["window_id"]).withColumn("side", F.lit(name))
                 .select("side", "window_id", "position", "subdistrict_code", "row.*"))

    return side("x").unionByName(side("y"))


def staged_model_panel(spark, d):
    return io.stage_via_parquet(model_panel(staged_panel(spark, d), SPEC, IND))


def isolation_forest_fit(spark, d):
    return A.isolation_forest_fit(staged_model_panel(spark, d), CELL, IND)


def fitted_forest(spark, d):
    panel = staged_model_panel(spark, d)
    return panel, A.Forest.from_table(A.isolation_forest_fit(panel, CELL, IND), IND)


def isolation_forest_score(spark, d):
    panel, forest = fitted_forest(spark, d)
    return cells(A.isolation_forest_score(panel, forest), ["score"])


def pseudo_label(spark, d):
    scored = cells(staged_panel(spark, d), [F.col("net_revenue").alias("score")])
    return A.pseudo_label(scored)


def forest_importance(spark, d):
    panel, forest = fitted_forest(spark, d)
    scored = io.stage_via_parquet(A.isolation_forest_score(panel, forest))
    return M.forest_importance(io.stage_via_parquet(A.pseudo_label(scored)), IND, key=CELL)


def permutation_importance(spark, d):
    panel, forest = fitted_forest(spark, d)
    return A.permutation_importance(panel, forest, CELL)


def select_top_features(spark, d):
    panel = staged_panel(spark, d)
    chosen = M.select_top_features(panel, variance_table(panel), CELL, TOP)
    return long_form(chosen, [c for c in chosen.columns if c not in CELL])


def fitted_windows(spark, d):
    panel = D.split_by_date(staged_panel(spark, d), TRAIN_END, VAL_END)
    train = panel.where("split = 'train'")
    scaled = Z.minmax_scale(I.median_impute(panel, IND), IND, train)
    windows = S.flatten_window(S.sequence_window(scaled, SPEC, IND), IND).drop("window")
    windows = io.stage_via_parquet(D.split_by_date(windows, TRAIN_END, VAL_END, "end"))
    model = R.reconstruction_fit(windows.where("split = 'train'"), IND, S.SEQUENCE_LENGTH, k=16)
    return windows, model


def reconstruction_fit(spark, d):
    return fitted_windows(spark, d)[1].table(spark)


def reconstruction_score(spark, d):
    windows, model = fitted_windows(spark, d)
    return R.reconstruction_score(windows, model).select(
        "subdistrict_code", "start", "end", "split", "error", "error_indicator",
        F.to_json("error_share").alias("error_share"))


def recurrent_score(spark, d):
    """A small network, few passes: the size of the state and the passes are parameters."""
    windows, _ = fitted_windows(spark, d)
    model = N.recurrent_fit(windows.where("split = 'train'"), IND, S.SEQUENCE_LENGTH, hidden=16, layers=1, passes=20)
    return N.recurrent_score(windows, model).select(
        "subdistrict_code", "start", "end", "split", "error", "error_indicator")


def reconstruction_evaluate(spark, d):
    scored = D.split_by_date(cells(staged_panel(spark, d), [F.col("net_revenue").alias("error")]),
                             TRAIN_END, VAL_END)
    return R.reconstruction_evaluate(scored).withColumns(
        {c: to_decimals(F.col(c), 3) for c in ("threshold", "mean_error")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    scan_csv, scan_csv_checked, scan_parquet, literal_rows, sink_csv, sink_csv_single, sink_parquet,
    stage_via_parquet, cache_stage,
    filter_slice, filter_date, filter_entity, select_cols, select_exclude, select_by_dtype,
    select_from_table, select_existing, drop_cols, rename_cols, with_column, pad_nulls,
    drop_null_rows,
    cross_entities_dates, missing_months_global, missing_months_per_entity,
    distinct_entities, distinct_rows, distinct_dates, monthly_trends, describe_table,
    date_bounds, table_shape, sample_count, column_variance, column_means, column_median,
    percentile_cut,
    rolling_mean_impute, lag_features, lag_features_bucketed, lag_features_monthly, rolling_mean_features, rolling_std_features,
    group_mean_feature, rolling_mean_smooth, forward_fill, backward_fill,
    fill_across_entities, sequence_window,
    sort_panel, sort_time, head_n, top_k_features,
    union_by_name_pad, union_aligned,
    parse_date, parse_timestamp, date_parts, year_month_label, flag_period, cast_cols,
    null_test, between_bool,
    date_axis, densify_listed, densify_listed_union, densify_missing, densify_full,
    impute_chain, impute_chain_across, resumed_chain, feature_bundle, feature_bundle_rounds, model_matrix,
    split_periods, split_by_date, series_extract, trend_series,
    correlation_matrix, correlation_matrix_wide, high_corr_pairs, low_variance_cols,
    filter_features, filter_features_keep_first, median_impute, standard_scale, minmax_scale,
    column_profile, profile_by_months, column_profile_histogram, column_profile_top_values,
    column_profile_duplicates,
    sequences_io, sequences_in_splits, sequences_autoencode, sequences_across_entities, isolation_forest_fit,
    isolation_forest_score, pseudo_label, forest_importance, permutation_importance,
    select_top_features, reconstruction_fit, reconstruction_score, recurrent_score, reconstruction_evaluate,
)}
QUERIES["checkpoint_stage"] = checkpoint_query
