"""Session and lineage helpers.

Nothing here tunes the engine for one machine: shuffle partitions and
broadcast thresholds come from the cluster's own configuration.  The
builder below is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "textmill") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TEXTMILL_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local mode: tests) a fresh folder under the system temp dir; a cluster
    without the setting is refused, since executors could not see that folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="textmill-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder that nothing was written to."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}_{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a written folder that nothing reads any more, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def barrier(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Reliable checkpoint (not ``localCheckpoint``): a lost executor re-reads
    the written files instead of recomputing or losing them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of the Arrow batches that a Python worker is handed in ``small_batches``.
BATCH_BYTES = 2 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs inside hands its Python workers Arrow batches of about ``size``
    bytes (a longer row is a batch of its own) instead of 10,000 rows of any
    length, which the executor holds once in the JVM and once in Python.  It
    must run inside, as ``barrier`` does; a plan that is only made keeps
    nothing of it.  A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if before is None or not before.isdigit() or not 0 < int(before) <= size:
        spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Bytes of a table, as its columns hold them, that may be broadcast.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row, about: lengths of texts and arrays, and a word for
    everything else."""
    def of(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(c)
        if isinstance(kind, T.ArrayType):
            item = kind.elementType
            if isinstance(item, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
                return F.aggregate(c, F.lit(8).cast("long"), lambda s, x: s + F.coalesce(of(x, item).cast("long"), F.lit(8)))
            return F.size(c) * 8
        if isinstance(kind, T.StructType):
            return sum((F.coalesce(of(c[f.name], f.dataType).cast("long"), F.lit(8)) for f in kind), F.lit(8).cast("long"))
        return F.lit(8)

    return sum((F.coalesce(of(F.col(f"`{f.name}`"), f.dataType).cast("long"), F.lit(8)) for f in df.schema.fields),
               F.lit(16).cast("long"))


def small_enough(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes
    (``BROADCAST_BYTES`` by default), both summed in one aggregate.  Use it on
    inputs that are cheap to read (files, checkpoints), before deciding to
    broadcast them.  """
    n, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes(df))).first()
    return n <= max_rows and (size or 0) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` behind a measured bound of rows and bytes; otherwise
    ``df`` as is (a shuffle join, which AQE may still turn into a broadcast at
    run time from the shuffle's real size).  ``df`` is written once to the
    checkpoint folder, so measuring it does not derive it twice."""
    kept = barrier(df)
    return F.broadcast(kept) if small_enough(kept, max_rows) else kept
