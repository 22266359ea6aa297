"""Places for tables that a query writes and reads again, and batches for Python workers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows of a few dozen bytes that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one is made only in local mode where that is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wordloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting: at most ``limit`` rows; otherwise the join is left to shuffle. ``small`` is cheap to count, so cached or just written."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` that hold a finished table, in order; none where there is no such path."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [x.getPath() for x in fs.listStatus(at) if x.isDirectory()]
    return sorted(x.getName() for x in found if fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))


def spread(df: DataFrame) -> DataFrame:
    """Repartition a table of fewer splits than cores, which is small, so that what follows occupies them all; others, and what isn't a plain scan, stay as they are."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < plan.execute().getNumPartitions() < cores else df


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over small batches; ``fn`` takes the partition's batches and yields dictionaries of columns. The session's bounds on batches are lowered to 1000 rows and 16 MB where they
    are higher, and stay so: they are read when a plan runs."""
    spark = df.sparkSession
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)
