"""Items in containers of fixed capacity with as little room left over as possible."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Items that are packed together, on average. A block leaves a few containers partly empty, so the room lost falls with the block.
BLOCK_ITEMS = 65_536
#: Copies of one key and size that travel as one row and lie in one block.
COPIES = 1024


class SumOfSquares:
    """Open bins of one capacity, counted by the room left in them.

    An item goes where the sum of the squared counts becomes smallest; the change of that sum is
    known for all rooms at once from the counts. Of equal choices the fullest bin is taken.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.bins = 0
        self._rooms = np.zeros(0, np.int64)

    def place(self, size: int) -> int:
        """The bin of an item of 1 to ``capacity``; a new bin is one more choice."""
        counts, capacity = self.counts, self.capacity
        rooms = np.fromiter((r for r in self.open if r >= size), np.int64)
        cost_new = 0 if size == capacity else 2 * int(counts[capacity - size]) + 1
        room = capacity
        if len(rooms):
            after = rooms - size
            change = 1 - 2 * counts[rooms] + np.where(after > 0, 2 * counts[after] + 1, 0)
            best = int(change.min())
            if best <= cost_new:
                room = int(rooms[change == best].min())
        if room == capacity:
            chosen = self.bins
            self.bins += 1
        else:
            stack = self.open[room]
            chosen = stack.pop()
            if not stack:
                del self.open[room]
            counts[room] -= 1
        left = room - size
        if left:
            counts[left] += 1
            self.open.setdefault(left, []).append(chosen)
        return chosen


def pack_block(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pieces of one block: item index, piece number and bin of each piece, and the number of bins.

    Items larger than the capacity fill bins of their own and leave a last piece; the others
    are placed in the order given. Items of size 0 take no room and lie in the block's first bin.
    """
    full = sizes // capacity
    rest = sizes - full * capacity
    items, pieces, bins = [], [], []
    packer = SumOfSquares(capacity)
    for i in np.flatnonzero(full):
        for piece in range(int(full[i])):
            items.append(i)
            pieces.append(piece)
            bins.append(packer.bins)
            packer.bins += 1
    for i in np.flatnonzero(rest):
        items.append(i)
        pieces.append(int(full[i]))
        bins.append(packer.place(int(rest[i])))
    for i in np.flatnonzero(sizes == 0):
        items.append(i)
        pieces.append(0)
        bins.append(0)
    return np.array(items, np.int64), np.array(pieces, np.int32), np.array(bins, np.int64), max(packer.bins, int(len(sizes) > 0))


def _packed(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            at = 0
            block, own, capacity = (batch.column(i).to_numpy() for i in (0, 1, 2))
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (own[1:] != own[:-1])) + 1
            for end in [*cuts.tolist(), batch.num_rows]:
                if end == at:
                    continue
                now = (int(block[at]), int(own[at]), int(capacity[at]))
                if key is not None and now != key:
                    yield from _emit(key, parts, schema)
                    parts = []
                key = now
                parts.append(batch.slice(at, end - at))
                at = end
        if key is not None:
            yield from _emit(key, parts, schema)

    return run


def _emit(key: tuple[int, int, int], parts: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(parts)
    order = np.repeat(np.arange(rows.num_rows), rows.column("copies").to_numpy())
    sizes = rows.column("tokens").to_numpy()[order]
    items, pieces, bins, _ = pack_block(sizes, key[2])
    tokens = np.where(pieces < sizes[items] // key[2], key[2], sizes[items] - pieces * key[2])
    n = len(items)
    yield pa.RecordBatch.from_arrays(
        [
            rows.column("capacity_id").combine_chunks().slice(0, 1).take(pa.array(np.zeros(n, np.int64))),
            pa.array(np.full(n, key[0], np.int32)),
            pa.array(bins),
            rows.column("item").combine_chunks().take(pa.array(order[items])),
            pa.array(pieces),
            pa.array(tokens.astype(np.int32)),
        ],
        schema=schema,
    )


def pack(items: DataFrame, key: str, size: str, capacities: list[tuple[int, int]], count: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Assign every item to containers of each capacity, whole unless it is larger than the container.

    ``capacities`` are (id, capacity) pairs above 0, a parameter of as many rows as there are assignments to make; ``count`` is the number of
    items, by which the number of blocks is set. An item that is larger fills containers of its own and its
    last piece is placed like an item. NULL and negative sizes count as 0: such items take no room and lie in
    their block's first container. Repeated keys are items of their own; an empty table gives no rows.

    Items are spread over blocks by a hash of key and size, and each block is packed by itself in the order of key and size,
    so the result depends on the items alone, not on how they are split into tasks or in which order they come. Equal items are counted before
    the shuffle and spread over blocks in lots of ``COPIES``, so a key that holds a third of all rows fills many
    blocks and no task sees more than its block; the number of blocks follows the input.

    Result: capacity_id, block, container (within the block), the key, piece_no, tokens.
    """
    if not capacities or any(c <= 0 for _, c in capacities):
        raise ValueError("capacities above 0 are needed")
    blocks = max(1, -(-count // block_items))
    source = items.select(F.col(key).alias("item"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int").alias("tokens"))
    lots = source.groupBy("item", "tokens").agg(F.count("*").alias("n")).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    placed = lots.select(F.pmod(F.xxhash64("item", "tokens", "lot"), F.lit(blocks)).cast("int").alias("block"), "item", "tokens", "lot", F.least(F.lit(COPIES), F.col("n") - F.col("lot") * COPIES).alias("copies"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in capacities]))
    rows = placed.withColumn("c", each).select("block", "c.capacity_id", "c.capacity", "item", "tokens", "lot", "copies")
    rows = rows.repartition("block", "capacity_id").sortWithinPartitions("block", "capacity_id", "item", "tokens", "lot")
    out = T.StructType(
        [
            T.StructField("capacity_id", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("container", T.LongType()),
            T.StructField("item", source.schema["item"].dataType),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("tokens", T.IntegerType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _packed(to_arrow_schema(out))(batches)

    return rows.select("block", "capacity_id", "capacity", "item", "tokens", "copies").mapInArrow(run, out).withColumnRenamed("item", key)
