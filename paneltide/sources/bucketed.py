"""A panel table laid out by entity and month, which ordered windows read without a shuffle.

Each month is a partition, so a delivery rewrites its own months only. Within a month the rows of
an entity are in one bucket, sorted by entity and time; the buckets are the same in every month. A
window keyed by the entity then needs no exchange, whatever the number of months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.spec import PanelSpec

MONTH = "month_start"
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
#: Rows of a bucket to aim at when no number of buckets is given.
ROWS_PER_BUCKET = 5_000_000


def _laid_out(df: DataFrame, spec: PanelSpec, buckets: int) -> DataFrame:
    """One task per bucket writes the bucket of every month, in order."""
    month = F.trunc(F.col(spec.time).cast("date"), "MM").alias(MONTH)
    return df.select(*[c for c in df.columns if c != MONTH], month).repartition(buckets, *spec.entity)


def sink_bucketed(df: DataFrame, spec: PanelSpec, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` as the table ``table`` at ``path``, and return it. Rows without a time are in the
    partition of the null month. An existing table of the name is replaced."""
    if buckets is None:
        buckets = max(1, -(-df.count() // ROWS_PER_BUCKET))
    (_laid_out(df, spec, buckets).write.mode("overwrite").option("path", path).format("parquet")
     .partitionBy(MONTH).bucketBy(buckets, *spec.entity).sortBy(*spec.cell).saveAsTable(table))
    return df.sparkSession.table(table)


def open_bucketed(spark: SparkSession, spec: PanelSpec, table: str, path: str, buckets: int) -> DataFrame:
    """The table as another session wrote it: its layout is declared again over the same files."""
    if not spark.catalog.tableExists(table):
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        entity, order = (", ".join(f"`{c}`" for c in cs) for cs in (spec.entity, spec.cell))
        spark.sql(f"create table `{table}` ({columns}) using parquet partitioned by (`{MONTH}`) "
                  f"clustered by ({entity}) sorted by ({order}) into {buckets} buckets location '{path}'")
        spark.catalog.recoverPartitions(table)
    return spark.table(table)


def _buckets(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"describe extended `{table}`").where("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def overwrite_months(df: DataFrame, spec: PanelSpec, table: str) -> DataFrame:
    """Replace the months that occur in ``df``; files of other months stay as they are.

    ``df`` must not read the months it replaces from the table itself; stage it first. An empty
    frame replaces nothing.
    """
    spark = df.sparkSession
    columns = [c for c in spark.table(table).columns if c != MONTH]
    laid_out = _laid_out(df.select(*columns), spec, _buckets(spark, table)).sortWithinPartitions(MONTH, *spec.cell)
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")               # insertInto takes it from the session only
    try:
        laid_out.select(*columns, MONTH).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(_OVERWRITE, before)
    spark.catalog.refreshTable(table)
    return spark.table(table)
