"""Written tables in the folder that all executors share, and small helpers for every operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: no blank, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, a local session gets a temporary one; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Lists that take the folders of tables written in this context (a thread or task has its own).
_noted: ContextVar[tuple[list[str], ...]] = ContextVar("_noted", default=())


@contextmanager
def noted() -> Iterator[list[str]]:
    """Inside, the folders of tables that :func:`save` writes are noted in the list given, also by callers further out."""
    token = _noted.set((*_noted.get(), made := []))
    try:
        yield made
    finally:
        _noted.reset(token)


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for made in _noted.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders of tables made by :func:`save`, as far as they are still there."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`save` once nothing reads it any more."""
    delete(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs. It does so for what the driver's JVM has collected, and a large heap is collected too seldom."""
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, made: dict) -> DataFrame:
    """``df`` with the columns of ``made``; an input column of the same name (in any case) gives way."""
    names = {m.lower() for m in made}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names], *[v.alias(k) for k, v in made.items()])


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without input columns that an operator's output names would clash with."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def hidden(df: DataFrame, keep=()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns, but those of ``keep``, under names that no operator uses, and the new name of each."""
    names = {c: c if c in keep else f"_in{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def revealed(df: DataFrame, names: dict[str, str], *more) -> DataFrame:
    """The columns that :func:`hidden` renamed under their own names, and ``more``."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()], *more)


def words(text) -> F.Column:
    """Array of the words of ``text``; empty for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def ascii_lower(text) -> F.Column:
    return F.translate(text, UPPER, LOWER)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, for operators with Python functions."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    archive = f"{tempfile.mkdtemp(prefix='spark-package-')}/{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, f"{top.name}/{path.relative_to(top)}")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
