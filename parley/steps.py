"""Tables between the steps of an operator, in the folder that the driver and all executors share.

``cut`` writes a table and reads it back: lineage ends there, and a lost executor costs no recomputation. What is written
inside ``run()`` belongs to that run, whatever others write at the same time, and goes with ``release``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's own switch: shuffle files of an execution go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that a file stands for, and bytes of its row groups, which tasks hold in memory.
FILE_BYTES, BLOCK_BYTES = 128 << 20, 32 << 20


class Run:
    """Tables that one run wrote and nobody has deleted yet."""

    def __init__(self):
        self.name, self.paths = uuid.uuid4().hex, []

    def release(self, spark: SparkSession, *keep: DataFrame) -> None:
        """Delete what the run wrote, but for the tables to keep: for callers who have written or read an operator's result."""
        stay = {getattr(df, "_parley_path", None) for df in keep}
        for path in [p for p in self.paths if p not in stay]:
            _delete(spark, path)
            self.paths.remove(path)


_current: ContextVar[Run | None] = ContextVar("parley_run", default=None)


@contextmanager
def run() -> Iterator[Run]:
    """A run of its own: what this thread ``cut``s inside belongs to it."""
    mine = Run()
    token = _current.set(mine)
    try:
        yield mine
    finally:
        _current.reset(token)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Only a session on one machine may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="parley-steps-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def planned_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as the planner knows them; what it makes of joins is their product."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def compact(df: DataFrame) -> DataFrame:
    """``df`` in partitions as large as files should be: four for each core at least, ``FILE_BYTES`` of what it reads each. Nothing is shuffled."""
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, min(planned_bytes(df) // FILE_BYTES, 1 << 20)))


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back. Small partitions share files; the shuffle files of the write go with its end, for nothing reads them again."""
    spark, mine = df.sparkSession, _current.get()
    folder = f"parley-run-{mine.name}/" if mine else "parley-"
    path = f"{shared_dir(spark)}/{folder}{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        compact(df).write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    found = spark.read.schema(df.schema).parquet(path)
    found._parley_path = path
    if mine:
        mine.paths.append(path)
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote and that nothing lazy reads any more; other tables are left alone."""
    mine = _current.get()
    for df in tables:
        if path := getattr(df, "_parley_path", None):
            _delete(df.sparkSession, path)
            if mine and path in mine.paths:
                mine.paths.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
