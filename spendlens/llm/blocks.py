"""Groups that may be large, compared within themselves by tasks of bounded size.

A group of more than ``block`` rows is cut into blocks by a hash; every pair of
blocks, and every block with itself, is a group of its own.  No pair of rows is
left out, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.store import cut


def crowded(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """(group columns, blocks) of the groups with more than ``block`` rows; counted before the shuffle."""
    return cut(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
               .select(*group, F.ceil(F.col("n") / block).cast("int").alias("blocks")), "crowded")


def in_pairs_of_blocks(rows: DataFrame, group: list[str], member: str, crowds: DataFrame) -> DataFrame:
    """``rows`` once for each pair of blocks that they take part in, each pair's rows in one partition and together.

    Adds first, second (the blocks) and side: 2 in a block with itself, else 0
    for rows of the first and 1 for rows of the second block.
    """
    block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    placed = rows.join(crowds, group, "left").withColumn("block", block)
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1), lambda other: F.struct(
        F.least("block", other).alias("first"), F.greatest("block", other).alias("second"),
        F.when(other == F.col("block"), F.lit(2)).when(other > F.col("block"), F.lit(0)).otherwise(F.lit(1)).alias("side")))
    keys = [*group, "first", "second"]
    return placed.select(*rows.columns, F.inline(pairs)).repartition(*keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of each pair of blocks with two rows or more; one is held at a time."""
    names = [*group, "first", "second"]
    held: list[pa.RecordBatch] = []

    def whole(*pieces: pa.RecordBatch) -> Iterator[pa.Table]:
        if sum(p.num_rows for p in pieces) > 1:
            yield pa.Table.from_batches(pieces).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        starts = [0, *edges.tolist(), batch.num_rows]
        if held and [held[-1].column(c)[-1].as_py() for c in names] != key[:, 0].tolist():
            yield from whole(*held)
            held = []
        for a, b in zip(starts, starts[1:]):
            piece = batch.slice(a, b - a)
            if b == batch.num_rows:
                held.append(piece)
            else:
                yield from whole(*held, piece)
                held = []
    yield from whole(*held)


class Forest:
    """Links of a group as a forest: each member points to a smaller one of its tree."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
