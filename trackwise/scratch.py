"""Tables written to the shared folder to cut lineage, and their removal.

Spark's own blocks die with an executor; a written table doesn't. Results are lazy and may read such tables, so they are
removed when the caller says so: ``with released(): write the result`` removes all that was written inside it.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_open: ContextVar[list | None] = ContextVar("open scratch folders", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset; it gets
    a folder of its own then."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = _local.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='trackwise-')}"
        _local[spark.sparkContext.applicationId] = got
    return got.rstrip("/")


class Scratch:
    """A folder of tables; ``drop`` removes those that nothing reads any more, ``close`` all of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths, self.made = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", {}, 0
        if (held := _open.get()) is not None:
            held.append(self)

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{name}-{self.made}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name))

    def close(self) -> None:
        self.paths.clear()
        self._delete(self.root)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Removes, at its end, every scratch table written inside it."""
    token = _open.set([])
    try:
        yield
    finally:
        held = _open.get()
        _open.reset(token)
        for scratch in held:
            scratch.close()
