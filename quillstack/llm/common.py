"""What the operators of this subpackage share: the shared scratch folder and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it, so that no column of `df` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; where it has fewer partitions than there are cores (one small file),
    it is dealt anew, for one row group would be one task's work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scratch(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder is set, but only if all of Spark is one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillstack-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path (not yet made) in the shared folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: its lineage ends there,
    and no executor's loss can take it away."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that `stored` made, when all that was made of them is stored itself."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Narrow rows that are broadcast at most: about 20 MB.
BROADCAST_ROWS = 300_000


def if_few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df`, to be broadcast if it has no more than so many rows (they are counted)."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key that one task of a `spread_join` takes, and keys that are dealt over several, at most.
HOT_ROWS, HOT_KEYS = 512, 10_000


def spread_join(rows: DataFrame, small: DataFrame, keys: list[str], by: list[str], total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `small` on `keys`, where `small` has in column n how many of the `total` rows have
    its key.  Keys of many rows are dealt over several tasks by a hash of the columns `by`, and their rows of
    `small` go to each.  A key is one of many rows above total / `HOT_KEYS`, so the list of them that is broadcast
    has `HOT_KEYS` entries at most, whatever the size.  The join has no column n; keys are not null."""
    hot = max(HOT_ROWS, total // HOT_KEYS)
    salts, salt = fresh(rows, "salts"), fresh(rows, "salt")
    heavy = small.where(F.col("n") > hot).select(*keys, F.ceil(F.col("n") / hot).cast("int").alias(salts)).dropDuplicates(keys)
    dealt = rows.join(F.broadcast(heavy), keys, "left")
    dealt = dealt.withColumn(salt, F.pmod(F.xxhash64(*by), F.coalesce(F.col(salts), F.lit(1))).cast("int")).drop(salts)
    each = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / hot), F.lit(1)).cast("int") - 1)
    return dealt.join(small.withColumn(salt, F.explode(each)).drop("n"), [*keys, salt], how).drop(salt)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package's code to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="quillstack-code-"), "quillstack_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        z.write(f"{top}/__init__.py", "quillstack/__init__.py")
        for f in sorted(os.listdir(f"{top}/llm")):
            if f.endswith(".py"):
                z.write(f"{top}/llm/{f}", f"quillstack/llm/{f}")
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def give_back() -> None:
    """Return what a worker has freed to the system: it stays for later tasks, beside a JVM that may need the memory."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def opened(uri: str):
    """(file system, path) of a URI, for pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri) if not uri.startswith("file:") else "file://" + uri[5:])


def move_over(store, part: str, path: str) -> None:
    """Move `part` to `path`; where the store refuses to move over a file, that one goes first: it is
    another attempt's of the same task, and holds the same."""
    try:
        store.move(part, path)
    except OSError:
        store.delete_file(path)
        store.move(part, path)


def put_whole(uri: str, write) -> None:
    """Let `write(stream)` fill a temporary file beside `uri`, then move it there: a task that
    is lost or runs twice leaves one whole file, and one that fails none."""
    store, path = opened(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(part, compression=None) as out:
            write(out)
    except BaseException:
        store.delete_file(part)
        raise
    move_over(store, part, path)
