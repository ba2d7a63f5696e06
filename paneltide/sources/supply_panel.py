"""A monthly panel derived from the order tables: one row per supplier, month and sector.

Suppliers play the subdistricts, nations the districts and regions the states. The
return flags are the sectors, and the extra sector ``Total`` covers every line.
Amounts are whole numbers, so their sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paneltide.spec import PanelSpec

TOTAL = "Total"
INDICATORS = ("qty", "revenue", "net_revenue", "returned_qty",
              "avg_discount", "avg_tax", "n_lines", "max_line")

# The panel is grouped by (supplier, month, sector): within a sector cells are unique.
SPEC = PanelSpec(cells_unique=True)


# Sums that the indicators follow from, and the lines' values they add up.
_SUMS = ("qty", "cents", "net", "returned", "discount", "tax", "n_lines")


def _sums(lines: DataFrame, *keys: Column | str) -> DataFrame:
    cents = F.rint(F.col("l_extendedprice") * 100)
    values = {"qty": F.col("l_quantity"), "cents": cents,
              "net": cents * F.rint(100 - F.col("l_discount") * 100),
              "returned": F.when(F.col("l_returnflag") == "R", F.col("l_quantity")),
              "discount": F.rint(F.col("l_discount") * 100), "tax": F.rint(F.col("l_tax") * 100)}
    return lines.groupBy(*keys).agg(
        *[F.sum(v).alias(c) for c, v in values.items()], F.count(F.lit(1)).alias("n_lines"),
        F.max("l_linenumber").alias("max_line"))


def _rate(c: str) -> Column:
    """Mean rate in whole basis points, cut off, as a fraction."""
    return F.floor(F.col(c) * 100 / F.col("n_lines")) / F.lit(10000.0)


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def _indicators(sums: DataFrame) -> DataFrame:
    return sums.select(
        "l_suppkey", "date", "sector", "qty", _whole(F.col("cents") / 100).alias("revenue"),
        _whole(F.col("net") / 10000).alias("net_revenue"), F.col("returned").alias("returned_qty"),
        _rate("discount").alias("avg_discount"), _rate("tax").alias("avg_tax"), "n_lines", "max_line")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spark.read.parquet(f"{sf_dir}/lineitem.parquet")
                 .withColumn("date", F.trunc("l_shipdate", "MM")))


def _total(lines: DataFrame) -> DataFrame:
    return _indicators(_sums(lines, "l_suppkey", "date").withColumn("sector", F.lit(TOTAL)))


def _with_places(sums: DataFrame, sf_dir: str) -> DataFrame:
    """Join the place names after the aggregation, one base table at a time, so that
    Spark can pick each join by the size of the table."""
    def table(name: str) -> DataFrame:
        return sums.sparkSession.read.parquet(f"{sf_dir}/{name}.parquet")

    placed = (sums.join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
                  .join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
                  .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey")))
    sector_no = (F.when(F.col("sector") == "A", 1).when(F.col("sector") == "N", 2)
                  .when(F.col("sector") == "R", 3).otherwise(0))
    month_no = F.year("date") * 12 + F.month("date")
    return placed.select(
        ((F.col("s_suppkey") * 100000 + month_no) * 4 + sector_no).alias("id"),
        F.col("r_name").alias("state_name"), F.col("r_regionkey").alias("state_code"),
        F.col("n_name").alias("district_name"), F.col("n_nationkey").alias("district_code"),
        F.col("s_name").alias("subdistrict_name"),
        F.col("s_suppkey").cast("int").alias("subdistrict_code"),
        "sector", "date", *INDICATORS)


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sectors of the panel."""
    by_flag = _sums(_lines(spark, sf_dir), "l_suppkey", "date", F.col("l_returnflag").alias("sector"))
    # The total is added up from the sectors: the lines are read and shuffled once.
    total = (by_flag.groupBy("l_suppkey", "date")
             .agg(*[F.sum(c).alias(c) for c in _SUMS], F.max("max_line").alias("max_line"))
             .withColumn("sector", F.lit(TOTAL)))
    return _with_places(_indicators(by_flag).unionByName(_indicators(total)), sf_dir)


def total_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``Total`` sector, the slice every later step works on."""
    return _with_places(_total(_lines(spark, sf_dir)), sf_dir)
