"""Small helpers that the operators share: names, keys and saved tables."""

from __future__ import annotations

import ctypes
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.tables import clear, discard, new_path, saved, shared_dir

__all__ = ["arrow", "clear", "discard", "free_name", "join_hot", "new_path", "numbered", "row_key", "saved", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name_``, ``name__`` and so on if the frame has such a column in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def row_key(*cols: str):
    """A 128-bit key of a row's id and text; equal rows share it, different ones don't for any number of rows that fits a cluster."""
    own = [F.col(f"`{c}`") for c in cols]
    null = [F.col(f"`{c}`").isNull() for c in cols]
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *null, *own)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


HOT = 4096  # a key is hot if more than one in so many rows has it


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: int, how: str = "inner", times: str = "times") -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``times`` how many of the ``n`` rows have it.

    At most ``HOT`` keys are hot. Their rows of ``table`` are broadcast and meet
    ``rows`` without a shuffle; the others meet by key, none with more than one
    in ``HOT`` of all rows. ``how`` is inner or left.
    """
    hot = F.col(times) * HOT > n
    keys = [r[0] for r in table.filter(hot).select(key).distinct().collect()]  # HOT at most
    if not keys:
        return rows.join(table, key, how)
    few = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return rows.filter(few).join(F.broadcast(table.filter(hot)), key).unionByName(rows.filter(~few).join(table.filter(~hot), key, how))


def numbered(df: DataFrame, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with __nth, each row's index from 0 in ``order``, and __before_<c> for each of ``sums``: the sum of c over all earlier rows, 0 for the first.

    Two levels of prefix sums, over ranges of the order and inside a range, so no
    task has all rows. ``order`` should tell rows apart.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    rows = saved(rows, "numbered")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__p").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__sum_{c}") for c in sums])
    all_before = upto(Window.orderBy("__p"))  # a row for each range
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select("__p", zero(F.sum("__n").over(all_before)).alias("__n"), *[zero(F.sum(f"__sum_{c}").over(all_before)).alias(f"__sum_{c}") for c in sums])
    inside = Window.partitionBy("__p").orderBy("__i")
    out = rows.join(F.broadcast(totals), "__p").withColumn("__nth", F.col("__n") + F.row_number().over(inside) - 1)
    out = out.withColumns({f"__before_{c}": F.col(f"__sum_{c}") + zero(F.sum(c).over(upto(inside))) for c in sums}) if sums else out
    return out.drop("__p", "__i", "__n", *[f"__sum_{c}" for c in sums])


BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


LARGE = 4 << 20  # bytes from which an allocation is a mapping of its own, which goes back when freed
_MMAP_THRESHOLD = -3  # fixed value: the C library's name of that setting


@cache
def _libc():
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(_MMAP_THRESHOLD, LARGE)
    return libc


def trim() -> None:
    """Give freed memory of this worker back to the system: the C allocator and Arrow's pool keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def _finished(run, batches):
    """What ``run`` yields; the worker is trimmed before and after, as it may idle for long."""
    trim()
    yield from run(_trimming(batches))
    trim()


def _trimming(batches):
    for batch in batches:
        yield batch
        del batch
        trim()


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches small enough for long texts, and workers trimmed after each.

    Sets the session's limits of an Arrow batch to ``BATCH_ROWS`` and
    ``BATCH_BYTES`` where they are larger: batches live in the executor's JVM and
    in the Python worker at once, and their default size is made for narrow rows.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = conf.get(name, str(most)).rstrip("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            conf.set(name, str(most))
    return df.mapInArrow(lambda batches: _finished(run, batches), schema)
