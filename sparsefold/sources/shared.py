"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_noted: ContextVar[tuple[list[str], ...]] = ContextVar("_noted", default=())


@contextmanager
def noted() -> Iterator[list[str]]:
    """Inside, the folders that :func:`saved` writes are noted in the list given."""
    token = _noted.set((*_noted.get(), made := []))
    try:
        yield made
    finally:
        _noted.reset(token)


#: Rows that ask for a partition of their own in a shuffle.
SHUFFLE_ROWS = 10_000


@contextmanager
def shuffles_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, shuffles have no more partitions than ``rows`` and the cores ask for; most of a small job is the cost of its partitions."""
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), max(spark.sparkContext.defaultParallelism, rows // SHUFFLE_ROWS))))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder of ``spark.checkpoint.dir``. Where none is set, a local session gets a temporary one; a cluster must name one."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/search-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _noted.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
