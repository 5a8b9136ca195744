"""Count-min sketches of 64-bit items: built in tasks, merged by blocks, broadcast as a bit per cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import windows as W

#: Rows of a sketch, cells in a row for each item, and at most (16 MB of bits a row where they are looked up).
DEPTH, CELLS_EACH, MOST_CELLS = 2, 4, 1 << 27
#: Cells of a block of the sketch, in bits, and items that a task counts before it emits them.
BLOCK_BITS, HELD = 20, 1 << 21
_salts = W.mix(np.arange(101, 101 + DEPTH, dtype=np.uint64))


def sketch_bits(items: int, most: int = MOST_CELLS) -> int:
    """Bits of a cell number: CELLS_EACH cells for each item, within the bound."""
    return max(BLOCK_BITS, min(most.bit_length() - 1, (CELLS_EACH * items).bit_length()))


def cells(items: np.ndarray, row: int, bits: int) -> np.ndarray:
    return W.mix(items ^ _salts[row]) >> np.uint64(64 - bits)


def partial_sketches(df: DataFrame, items_of: Callable, bits: int) -> DataFrame:
    """(block, counts): what each task counted, by blocks of 2 ** BLOCK_BITS cells; block numbers go on over the rows.

    counts holds a number for each cell that is not zero: its place in the block, times two, plus one if it was counted
    twice or more.
    """

    def emit(held: list[np.ndarray]) -> pa.RecordBatch:
        items = np.concatenate(held)
        blocks, counts = [], []
        for row in range(DEPTH):
            cell, n = np.unique(cells(items, row, bits), return_counts=True)
            place = ((cell & np.uint64((1 << BLOCK_BITS) - 1)) << np.uint64(1)).astype(np.uint32) + (n > 1).astype(np.uint32)
            block = (cell >> np.uint64(BLOCK_BITS)).astype(np.int64)
            edge = np.flatnonzero(np.diff(block, prepend=-1))
            blocks += (block[edge] + (row << (bits - BLOCK_BITS))).tolist()
            counts += [x.tobytes() for x in np.split(place, edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(counts, pa.binary())], names=["block", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for items in items_of(batch):
                held.append(items)
                size += len(items)
                if size >= HELD:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    return df.mapInArrow(run, "block long, counts binary")


def merged_sketch(partial: DataFrame) -> DataFrame:
    """(block, bits): which cells of a block are two or more, after adding what all tasks counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums = None, np.zeros(1 << BLOCK_BITS, dtype=np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(sums > 1).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for own, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != block:
                    if block is not None:
                        yield done()
                    block = own
                    sums[:] = 0
                number = np.frombuffer(counts, dtype=np.uint32)
                place = number >> 1
                sums[place] = np.minimum(sums[place] + 1 + (number & 1).astype(np.uint8), 2)
        if block is not None:
            yield done()

    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, bits binary")


def twice_sieve(df: DataFrame, items_of: Callable, items: int, most: int = MOST_CELLS) -> Callable:
    """A test for arrays of items: False for those that the sketch of all items of df knows to occur once.

    items_of(batch) yields arrays of 64-bit items. A cell counts an item and all that are equal to it, so the least cell
    of its rows is never too low, however many `items` there are. Tasks count their own rows; the merged sketch, of which
    a bit per cell is left, is broadcast: DEPTH * most bits at the most.
    """
    bits = sketch_bits(items, most)
    each = 1 << (BLOCK_BITS - 3)
    rows = [np.zeros(1 << (bits - 3), dtype=np.uint8) for _ in range(DEPTH)]
    for block, part in merged_sketch(partial_sketches(df, items_of, bits)).collect():  # at most DEPTH * most bits
        row, number = divmod(block, 1 << (bits - BLOCK_BITS))
        rows[row][number * each : (number + 1) * each] = np.frombuffer(part, dtype=np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(rows)

    def sieve(own: np.ndarray) -> np.ndarray:
        twice = np.ones(len(own), dtype=bool)
        for row, known in enumerate(sent.value):
            cell = cells(own, row, bits)
            twice &= (known[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
        return twice

    return sieve
