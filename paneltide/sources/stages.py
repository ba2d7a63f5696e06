"""A catalogue of staged tables that a chain of steps can be taken up from again.

Each stage is a table under a key made of its plan, its schema and the files it reads. A table
counts as finished once its entry stands in the manifest, which is written after the table. A
chain that runs again, in the same session or a later one, finds the finished stages by their keys
and goes on behind them; where the plan or an input file has changed, the key has too, and so have
the keys of all stages behind it. Entries and tables go through Spark's writers and readers, so the
catalogue works wherever the shared folder does.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import re
from typing import Self

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.session import delete_folder, folder_exists, list_folder, shared_dir

_MANIFEST = "name string, key string, path string, n_rows long"
_ALL_FIELDS = "spark.sql.debug.maxToStringFields"
# Sources whose rows aren't in the text of the plan.
_IN_MEMORY = ("LocalRelation", "LogicalRDD", "ExistingRDD", "InMemoryRelation")


def plan_text(df: DataFrame) -> str:
    """The logical plan of ``df``, with its column ids numbered by first appearance."""
    spark = df.sparkSession
    before = spark.conf.get(_ALL_FIELDS)
    spark.conf.set(_ALL_FIELDS, str(2 ** 31 - 1))
    try:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain(extended=True)
    finally:
        spark.conf.set(_ALL_FIELDS, before)
    analyzed = out.getvalue().partition("== Analyzed Logical Plan ==")[2].partition("== Optimized")[0]
    numbers: dict[str, int] = {}
    return re.sub(r"#(\d+)", lambda m: f"#{numbers.setdefault(m[1], len(numbers))}", analyzed)


def input_files(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of each file the frame reads; folders are listed once."""
    wanted = set(df.inputFiles())
    folders = sorted({path.rpartition("/")[0] for path in wanted})
    found = {_plain(x[0]): x for folder in folders for x in list_folder(df.sparkSession, folder)}
    return sorted((_plain(path), *found.get(_plain(path), ("", -1, -1))[1:]) for path in wanted)


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def stage_key(df: DataFrame, version: str = "") -> str:
    """A key of what ``df`` computes from which files.

    The code of Python functions isn't part of a plan: ``version`` stands for it. Rows that were
    put in by the driver count through Spark's own hash of the plan, which other sessions may not
    repeat; such a stage is then computed again rather than taken for another.
    """
    text = plan_text(df)
    parts = [version, text, df.schema.json(), repr(input_files(df))]
    if any(name in text for name in _IN_MEMORY):
        parts.append(str(df.semanticHash()))
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:32]


class StageCatalogue:
    """The stages of one chain, under ``root`` (a folder of the shared one by default).

    Used as ``with StageCatalogue(spark, "monthly") as stage:`` it is a function for the ``stage``
    parameter of the plans. At the end of the block it releases everything, unless an error came
    up: then the finished stages stay for the next try. One chain of a name runs at a time.
    """

    def __init__(self, spark: SparkSession, chain: str, root: str | None = None) -> None:
        self.spark, self.chain = spark, chain
        self.root = f"{(root or shared_dir(spark)).rstrip('/')}/stages/{chain}"
        self.computed: list[str] = []
        self.reused: list[str] = []

    def __enter__(self) -> Self:
        return self

    def __exit__(self, error: type | None, *_: object) -> None:
        if error is None:
            self.release()

    def __call__(self, df: DataFrame) -> DataFrame:
        """The next stage, named by its number in the chain."""
        return self.stage(df, f"stage-{len(self.computed) + len(self.reused) + 1:03d}")

    def stage(self, df: DataFrame, name: str, version: str = "") -> DataFrame:
        """``df`` as a staged table: the finished one of this key, or one written now.

        A finished table of the same name and another key is outdated and deleted.
        """
        key = stage_key(df, version)
        path, entry = f"{self.root}/tables/{name}-{key}", f"{self.root}/manifest/{name}-{key}"
        if folder_exists(self.spark, f"{entry}/_SUCCESS") and folder_exists(self.spark, path):
            self.reused.append(name)
            return self.spark.read.schema(df.schema).parquet(path)
        for old, *_ in [*list_folder(self.spark, f"{self.root}/manifest"), *list_folder(self.spark, f"{self.root}/tables")]:
            if re.fullmatch(rf"{re.escape(name)}-[0-9a-f]{{32}}", old.rpartition("/")[2]):
                delete_folder(self.spark, old)
        df.write.mode("overwrite").parquet(path)
        staged = self.spark.read.schema(df.schema).parquet(path)
        (staged.agg(F.count("*").alias("n_rows"))
         .select(F.lit(name).alias("name"), F.lit(key).alias("key"), F.lit(path).alias("path"), "n_rows")
         .write.mode("overwrite").parquet(entry))
        self.computed.append(name)
        return staged

    def finished(self) -> DataFrame:
        """name, key, path and n_rows of the finished stages."""
        entries = [path for path, *_ in list_folder(self.spark, f"{self.root}/manifest")
                   if folder_exists(self.spark, f"{path}/_SUCCESS")]
        if not entries:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(*entries)

    def release(self) -> None:
        """Delete all tables and entries of the chain; frames that read them can't be used again."""
        delete_folder(self.spark, self.root)
