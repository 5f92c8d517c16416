"""What the exchanging operators share: tables in the shared folder, packed keys and counts.

A block of documents sends its distinct keys with their counts, packed as sorted byte-wise deltas, to
the task of their key range. It adds them up and answers. The shuffles carry a few bytes a key, and no
task sees a key more than once a block, however frequent it is.
"""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import delete, delete_at_end, shared_folder

_CLEAN = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def stored(df: DataFrame, path: str | None = None, *, group_rows: int | None = None) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: lineage ends there, lost
    executors cost nothing, and the shuffles behind it are freed. The table goes when the application
    ends, or with free(); one at a path of the caller's stays. group_rows: rows of a row group, of which a reader
    holds one, where rows are megabytes long."""
    spark, own = df.sparkSession, path is None
    path = path or shared_folder(spark, "llm")
    old = {k: spark.conf.get(k, None) for k in _CLEAN}
    for k in _CLEAN:
        with contextlib.suppress(Exception):  # a name that this Spark doesn't know or let change
            spark.conf.set(k, "true")
    try:
        writer = df.select("*").write.mode("errorifexists").option("compression", "zstd")
        (writer.option("parquet.block.row.count.limit", group_rows) if group_rows else writer).parquet(path)
    finally:
        for k, v in old.items():
            with contextlib.suppress(Exception):
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if own:
        delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            delete(table.sparkSession, folder)


#: A group of this many rows or more, and of a thousandth of all, is joined by broadcast.
HOT_ROWS, HOT_GROUPS = 64, 1000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, *, apart: str) -> DataFrame:
    """rows with the other columns of groups (one row for each key, and the group's number of rows in `size`), null
    where there is none. Groups with a thousandth of all rows or more, so a thousand at most, are broadcast; their
    rows are spread by the column `apart`. So no task of the join that shuffles gets a large group."""
    others = [c for c in groups.columns if c != key]
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(HOT_ROWS, total // HOT_GROUPS)
    hot = F.broadcast(groups.filter(F.col(size) >= limit).select(F.col(key).alias("__hot"), *(F.col(c).alias(f"__hot_{c}") for c in others)))
    rest = groups.filter(F.col(size) < limit).select(F.col(key).alias("__rest"), *(F.col(c).alias(f"__rest_{c}") for c in others))
    spread = F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("-"), F.xxhash64(apart).cast("string")))
    both = rows.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__spread", spread).join(rest, F.col("__spread") == F.col("__rest"), "left")
    return both.select(*rows.columns, *(F.coalesce(f"__hot_{c}", f"__rest_{c}").alias(c) for c in others))


def n_blocks(spark: SparkSession, blocks: int | None = None) -> int:
    return blocks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def block_of(blocks: int, *columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")


def pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as one width byte, the first key, and deltas of that many bytes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    top = int(steps.max()) if len(steps) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width, first = blob[0], np.frombuffer(blob, "<u8", 1, 1)
    raw = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw) + 1, 8), np.uint8)
    steps[1:, :width] = raw
    steps = steps.reshape(-1).view("<u8")
    steps[0] = first[0]
    with np.errstate(over="ignore"):
        return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    top = int(counts.max()) if len(counts) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def pack_small(counts: np.ndarray) -> bytes:
    """Counts that are mostly small: a byte each, 255 standing for the next of the 8-byte counts at the end."""
    low = np.minimum(counts, 255).astype(np.uint8)
    return len(low).to_bytes(4, "little") + low.tobytes() + counts[low == 255].astype("<u8").tobytes()


def unpack_small(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    out = np.frombuffer(blob, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<u8", offset=4 + n)
    return out


def ranges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each of the `buckets` equal ranges of sorted keys of so many bits begins, and the end."""
    limits = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])
