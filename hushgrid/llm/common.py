"""What the operators share: the cluster's shared folder, size-checked broadcasts, fresh column names."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side up to which it is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20


#: Bytes of an Arrow batch. The default of 10,000 whole texts would hold tens of MB in the JVM and in each worker.
ARROW_BYTES = 2 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Make Arrow batches small, unless the session has a size of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "64m", "67108864b", "67108864"):
        spark.conf.set(name, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    arrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where it is unset, a temporary folder of a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="hushgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, scoped: bool = True) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: a short lineage that outlives executors. ``scoped``: deleted at
    the end of a surrounding ``scratch``."""
    spark = df.sparkSession
    arrow_batches(spark)
    path = f"{shared_dir(spark)}/hushgrid-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hushgrid_path = path
    for frames in _scopes if scoped else ():
        frames.append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was materialised within it."""
    frames: list[DataFrame] = []
    _scopes.append(frames)
    try:
        yield
    finally:
        _scopes.remove(frames)
        discard(spark, frames)


def discard(spark: SparkSession, frames: Iterable[DataFrame | None]) -> None:
    """Delete materialised frames that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        path = getattr(df, "_hushgrid_path", None)
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row of fixed width in a broadcast table: 32 for its place, 8 a number, 48 a digest. Wider columns aren't for broadcasts."""
    width = {"bigint": 8, "int": 8, "binary": 48}
    return 32 + sum(width.get(k, 16 * (1 + k.count(",")) if k.startswith("struct<") else 1 << 20) for _, k in df.dtypes)


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The side with a broadcast hint if its rows, counted, fit in ``most`` bytes; otherwise as it is (the join then shuffles)."""
    return F.broadcast(df) if df.count() * row_bytes(df) <= most else df


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that none of the columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
