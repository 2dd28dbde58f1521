"""Exchanges in buckets: what blocks of documents send about keys meets bucket by bucket, whatever the corpus' size.

A key belongs to a bucket by its hash. A block sends one row a bucket in which it has keys, with all of those packed, so it never
sends more rows than it has keys and the bytes stay near those of the keys. Partitions hold many buckets, sorted by Spark (which
spills); a task has one bucket in memory at a time. Buckets grow with the corpus, so that each stays small; partitions stop
at `MOST_PARTITIONS`.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import by_task, cut

MOST_PARTITIONS = 20_000


def small(x: np.ndarray) -> bytes:
    """Unsigned numbers, compressed: in as few bytes each as the largest needs, all lowest bytes first and all highest ones last."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def wide(data: bytes) -> np.ndarray:
    """The numbers of `small`."""
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[9:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of frames that nobody holds any more; it waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def laid_out(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by a key and checkpointed in a way that later joins and co-groups by that key need not deal them out again.

    Spark keeps a checkpoint's partitioning only where the plan behind it is not adaptive, so adaptive plans are off meanwhile.
    """
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(by_task(df), key))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def number(df: DataFrame, size: int, share: int) -> int:
    """Buckets for size bytes of which one should get about a share; as many as the session has shuffle partitions at least."""
    return max(by_task(df), -(-size // share))


def of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 64-bit hashes, in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def met(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows sent, dealt out and sorted by their column bucket."""
    parts = max(1, min(buckets, MOST_PARTITIONS))
    home = F.floor(F.col("bucket") * parts / buckets).cast("int")
    return rows.repartitionById(parts, F.least(home, F.lit(parts - 1))).sortWithinPartitions("bucket")


def one_by_one(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[pa.Table]:
    """The rows of each key in batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1][key][-1].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
