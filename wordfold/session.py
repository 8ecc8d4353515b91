"""Session helpers: configuration, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Broadcast limits. A side is broadcast only when its rows and bytes were
# measured below them; otherwise the plan keeps a shuffle join.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 << 20


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "wordfold") -> SparkSession:
    """Local/test session. On a cluster pass an existing session instead."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WORDFOLD_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def require_local(master: str) -> None:
    """Raise unless driver and executors share one machine's disk."""
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"master {master!r} needs spark.checkpoint.dir: a folder that the driver and all executors share")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. A local folder is picked
    only when the setting is absent and the master is local: executors of a
    cluster can't read each other's disks, so there the setting is required."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        require_local(spark.sparkContext.master)
        path = tempfile.mkdtemp(prefix="wordfold-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries inside drop their shuffle files when they end: what they wrote
    takes their place. Else the files stay until the driver happens to collect
    its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut_lineage(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The written table survives executor loss (no recomputation from lineage),
    is columnar and compressed, and later scans get pruning and statistics."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)  # no job to find the schema
    out.written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``cut_lineage`` wrote for these tables, once nothing reads
    them any more (their successors are written). Other frames, null and
    repeated ones are passed over."""
    seen = set()
    for table in tables:
        path = getattr(table, "written_at", None) if table is not None else None
        if not isinstance(path, str) or path in seen:
            continue
        seen.add(path)
        spark = table.sparkSession
        name = getattr(table, "written_as", None)
        if isinstance(name, str):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: fixed widths, and strings, arrays and maps as
    long as they are."""

    def of(kind: T.DataType, value: Column) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return 16 + F.octet_length(value).cast("long")
        if isinstance(kind, T.StructType):
            return sum((of(f.dataType, value[f.name]) for f in kind.fields), F.lit(8))
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
                return F.aggregate(value, F.lit(16).cast("long"), lambda total, x: total + F.coalesce(of(kind.elementType, x).cast("long"), F.lit(8).cast("long")))
            return 16 + 8 * F.size(value).cast("long")
        if isinstance(kind, T.MapType):
            return 16 + of(T.ArrayType(kind.keyType), F.map_keys(value)) + of(T.ArrayType(kind.valueType), F.map_values(value))
        return F.lit(8)

    return sum((F.coalesce(of(f.dataType, F.col(f"`{f.name}`")).cast("long"), F.lit(8).cast("long")) for f in df.schema.fields), F.lit(16).cast("long"))


def size_bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None,
                           max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Return ``broadcast(df)`` when ``df`` has at most ``max_rows`` rows of at
    most ``max_bytes`` together.

    ``known_rows`` is an upper bound the caller measured earlier (e.g. the
    vocabulary size for a per-word marginal); with rows of fixed width it
    decides alone. Otherwise one small job measures rows and bytes. Above a
    bound the frame is returned as is and Spark plans a shuffle join (AQE may
    still convert it at runtime)."""
    if known_rows is not None and known_rows > max_rows:
        return df
    fixed = all(isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType) for f in df.schema.fields)
    if known_rows is not None and fixed:
        return F.broadcast(df) if known_rows * (16 + 8 * len(df.columns)) <= max_bytes else df
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def spread_input(df: DataFrame) -> DataFrame:
    """Rebalance a scan that yields fewer partitions than cores.

    A single large row group is read by one task; spreading it once is cheaper
    than running every downstream narrow stage on one core. On a cluster scan
    splits already outnumber cores and this is a no-op."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
