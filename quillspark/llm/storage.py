"""Tables written to the folder that driver and executors share.

Operators cut lineage by writing a table and reading it again, so that losing an executor costs one stage and never
the run. The folder is the session's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

BROADCAST_BYTES = 64 << 20
BATCH_BYTES = 8 << 20  # of a batch that a Python function gets while a table is written
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Raises on a cluster session that names none: a machine-local folder would lose rows there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def written(df: DataFrame, name: str, **facts: Column) -> DataFrame:
    """``df`` as a table in the shared folder, computed once, here and now; the write's shuffle files go with its end.

    Python functions get at most ``BATCH_BYTES`` at a time, so the memory of their processes does not follow the length of rows.
    The table's ``written_size`` is its rows and bytes, observed while it is written, and ``facts`` further aggregates.
    """
    spark = df.sparkSession
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    path = f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in held}
    seen = Observation()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(bytes_of(df)).alias("bytes"), *[x.alias(f"fact_{k}") for k, x in facts.items()]).write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_size = (seen.get["rows"], seen.get["bytes"] or 0)  # at least; a task that was run again may count twice
    table.facts = tuple(seen.get[f"fact_{k}"] for k in facts)
    return table


def renamed(table: DataFrame, names: dict[str, str]) -> DataFrame:
    """A written table with other names for some columns; its size stays known."""
    out = table.withColumnsRenamed(names)
    out.written_size = table.written_size
    return out


def discarded(*tables: DataFrame) -> None:
    """Removes written tables that no later step reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dropped(spark: SparkSession, *names: str | None) -> None:
    """Removes tables that were saved by name in the shared folder, with their files."""
    for name in filter(None, names):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspark/{name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no frame has a column of that name."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_prefix(df: DataFrame, prefix: str = "x_") -> str:
    """``prefix``, lengthened until no column of ``df`` begins with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "x" + prefix
    return prefix


def bytes_of(df: DataFrame) -> Column:
    """Bytes of a row of ``df`` in columns of no fixed width."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total += F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith("array"):
            total += 8 * F.greatest(F.size(column), F.lit(0))
    return total


def small_enough(df: DataFrame, most: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows and ``most_bytes`` in them, else as it is.

    Of a table just written both are known. Of others they are counted in one pass; only sums are sent.
    """
    rows, size = getattr(df, "written_size", None) or df.agg(F.count(F.lit(1)), F.sum(bytes_of(df))).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= most_bytes else df
