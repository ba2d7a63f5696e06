"""CSV files with faulty lines: good rows typed, the others aside with their reasons.

The files are read once, as lines; each is taken apart and cast column by column, and the result is
staged. Rows, faulty lines and counts all come from the staged table, so the three always agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from paneltide.sources.io import stage_via_parquet

DATE_FORMATS = ("yyyy-MM-dd",)
_FAULTS = "__faults"
_LINE, _FILE, _PARTS, _CORRUPT = "__line", "__file", "__parts", "__corrupt"


class CheckedCsv(NamedTuple):
    """``rows`` has the asked columns. ``faulty`` has file, line and reasons: one "column: what"
    for each value that isn't of its type, or the number of fields. ``counts`` has reason and n."""

    rows: DataFrame
    faulty: DataFrame
    counts: DataFrame


def _cast(text: Column, kind: T.DataType, formats: Sequence[str]) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.DateType):
        return F.coalesce(*[F.try_to_date(text, f) for f in formats])
    return text.try_cast(kind)


def scan_csv_checked(spark: SparkSession, path: str, schema: T.StructType,
                     date_formats: Sequence[str] = DATE_FORMATS, separator: str = ",") -> CheckedCsv:
    """Read header CSV by ``schema``, whose columns are the fields of a line in order.

    An empty field is null and no fault. Dates may have any of ``date_formats``, tried in turn.
    Lines equal to the first line of the first file are headers and left out, empty lines too. A
    quoted field can't hold a line break. Files without any line give three empty tables.
    """
    lines = spark.read.text(path).select(F.col("value").alias(_LINE), F.col("_metadata.file_path").alias(_FILE))
    first = lines.select(_LINE).first()
    names = [f.name for f in schema.fields]
    texts = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(len(names))],
                          T.StructField(_CORRUPT, T.StringType())])
    options = {"sep": separator, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    body = lines.where(F.trim(_LINE) != "").where(F.col(_LINE) != (first[0] if first else ""))
    parsed = body.select(_LINE, _FILE, F.from_csv(_LINE, texts.simpleString().removeprefix("struct<").removesuffix(">")
                                                  .replace(":", " "), options).alias(_PARTS))
    fields = [F.trim(F.col(_PARTS)[f"c{i}"]) for i in range(len(names))]
    fields = [F.when(x != "", x) for x in fields]
    values = [_cast(x, f.dataType, date_formats) for x, f in zip(fields, schema.fields, strict=True)]
    wrong = [F.when(x.isNotNull() & v.isNull(), F.lit(f"{f.name}: not a {f.dataType.simpleString()}"))
             for x, v, f in zip(fields, values, schema.fields, strict=True)]
    faults = F.when(F.col(_PARTS)[_CORRUPT].isNotNull(), F.array(F.lit("number of fields"))).otherwise(
        F.array_compact(F.array(*wrong)))
    staged = stage_via_parquet(parsed.select(
        _LINE, _FILE, faults.alias(_FAULTS), *[v.alias(n) for v, n in zip(values, names, strict=True)]))
    good = F.size(_FAULTS) == 0
    faulty = staged.where(~good).select(F.col(_FILE).alias("file"), F.col(_LINE).alias("line"),
                                        F.col(_FAULTS).alias("reasons"))
    counts = faulty.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return CheckedCsv(staged.where(good).select(*names), faulty, counts)
