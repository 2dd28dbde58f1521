"""Packing documents into sequences of bounded length: best-fit decreasing with certified bin counts.

Each partition packs its pieces by best-fit decreasing and certifies its number of bins with dual-feasible-function
lower bounds. A partition whose count exceeds its bound has a gap: it gives up all bins that are not full. One whose
count meets the bound gives up only its emptiest bin, since the bounds of partitions add up to more than the bound of
the whole. What is given up is dealt out anew and packed again, until one partition holds all of it, the whole count
meets the bound of the whole, or a turn saves no sequence. A partition holds at most some `PER_PARTITION` narrow rows. Each
row carries its certificate: the bins and the bound of the partition that placed it, and those of the whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.tokens import default_vocabulary, encoded

CAPACITY = 2048
END_ID = 0
PER_PARTITION = 100_000


#: What packing adds to its rows.
ADDED = ("sequence_id", "offset", "partition_bins", "partition_bound", "n_sequences", "least_sequences")


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length its bin and its offset there; and the room left in each bin."""
    bins, offsets, room = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set where some bin has room r
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        fits = free >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            at = with_room[left].pop()
            if not with_room[left]:
                free &= ~(1 << left)
        else:
            left, at = capacity, len(room)
            room.append(capacity)
        bins[k], offsets[k] = at, capacity - left
        room[at] = left - need
        if left > need:
            with_room[left - need].append(at)
            free |= 1 << (left - need)
    return bins, offsets, np.array(room, np.int64)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, given how many pieces have each length 0..capacity, by dual feasible functions."""
    x, n = np.arange(capacity + 1, dtype=np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 65):  # lengths rounded down to multiples of 1/k, except where (k + 1) x is whole
        whole = (x * (k + 1)) % capacity == 0
        scaled = np.where(whole, x * k, (x * (k + 1)) // capacity * capacity)
        best = max(best, -(-int((scaled * n).sum()) // (k * capacity)))
    sizes, number = np.cumsum(x * n), np.cumsum(n)
    for least in range(1, capacity // 2 + 1):  # large pieces count as a bin, pieces under least as nothing
        middle = int(sizes[capacity - least] - sizes[least - 1])
        best = max(best, -(-middle // capacity) + int(number[capacity] - number[capacity - least]))
    return best


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32.

    Only longer documents are cut; the first piece takes what is over, all others are full.
    """
    vocabulary = vocabulary or default_vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoded((t.as_py() for t in batch["text"]), vocabulary, end_id), strict=True):
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    for column, value in zip(rows, (doc_id, piece, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(rows: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Put rows (column length, 1 to capacity) into sequences.

    Adds sequence_id and offset, gapless from 0; partition_bins and partition_bound of the partition that placed the row;
    n_sequences and least_sequences of the whole: how many there are, and how many any packing needs at least. Columns of rows
    that have one of these names are replaced; all others may have any name.
    """
    own = F.struct(*[rows[f"`{c}`"] for c in rows.columns if c not in ADDED])
    left = cut(rows.select(own.alias("own"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("row")))
    kinds = f"own {left.schema['own'].dataType.simpleString()}, length long, row long"
    bound = global_bound(left, capacity)
    done, count, best, n, turn = [], 0, None, left.count(), 0
    while True:
        parts = max(1, -(-n // per_partition))

        def fill(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            own = [b for b in batches if b.num_rows]
            if not own:
                return
            table = pa.Table.from_batches(own)
            table = table.take(pc.sort_indices(table["row"])).combine_chunks()
            lengths = table["length"].to_numpy().astype(np.int64)
            bins, offsets, room = best_fit_decreasing(lengths, capacity)
            least = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            open_bins = room > 0 if len(room) > least else (room > 0) & (np.arange(len(room)) == room.argmax())
            size, ids = len(lengths), (turn << 48) + (TaskContext.get().partitionId() << 24) + bins
            for name, values in (("sequence_id", ids), ("offset", offsets), ("partition_bins", np.full(size, len(room))), ("partition_bound", np.full(size, least)), ("open", open_bins[bins])):
                table = table.append_column(name, pa.array(values))
            yield from table.to_batches(max_chunksize=10_000)

        dealt = left.repartition(parts, F.xxhash64("row", F.lit(turn))).select("own", "length", "row")
        filled = cut(dealt.mapInArrow(fill, f"{kinds}, sequence_id long, offset long, partition_bins long, partition_bound long, open boolean"))
        first = F.col("offset") == 0
        n, opened, kept = filled.agg(F.count_if("open"), F.count_if(F.col("open") & first), F.count_if(~F.col("open") & first)).first()
        whole = count + kept + opened
        last = parts == 1 or not n or whole <= bound or (best is not None and whole >= best)
        done.append((filled if last else filled.where("not open")).select("own.*", *ADDED[:4]))
        if last:
            break
        left, count, best, turn = filled.where("open").select("own", "length", "row"), count + kept, whole, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumns({"n_sequences": F.lit(whole).cast("long"), "least_sequences": F.lit(bound).cast("long")})


def global_bound(rows: DataFrame, capacity: int = CAPACITY) -> int:
    """The lower bound for all rows together, from their histogram of at most capacity + 1 lengths."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():
        counts[length] = n
    return lower_bound(counts, capacity)


def packed_documents(docs: DataFrame) -> DataFrame:
    """All documents packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset and certificates for each piece.

    doc_id is an integer. A null text is an empty one and takes one place, that of the end id. Rows that repeat a doc_id are packed each.
    An empty table gives no rows. Other columns are not read.
    """
    return pack(pieces(docs))
