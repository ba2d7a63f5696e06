"""Shared storage for checkpoints and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Folders made inside the innermost ``staging`` block; none outside of one.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; set one only in local mode."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        root = named
    else:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="paneltide-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; nothing is overwritten."""
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def checkpoint_stage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computes ``df`` once and cuts its lineage."""
    spark, made = df.sparkSession, _made.get()
    shared_dir(spark)
    if made is None:
        return df.checkpoint(eager=True)
    root = spark.sparkContext.getCheckpointDir()
    before = set(list_folder(spark, root))
    out = df.checkpoint(eager=True)
    made += [path for path, *_ in set(list_folder(spark, root)) - before]
    return out


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was staged or checkpointed inside it.

    Frames that read such tables must be used up before the end. Of blocks in one another each
    deletes its own. Only one chain at a time may checkpoint in a session with such a block.
    """
    token = _made.set([])
    try:
        yield
    finally:
        for path in _made.get():
            delete_folder(spark, path)
        _made.reset(token)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of what lies in a folder; nothing if there is none."""
    files, where = _file_system(spark, path)
    if not files.exists(where):
        return []
    return [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files.listStatus(where)]


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def delete_folder(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)
