"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables.

A table's key is the signs of a vector's products with ``bits`` random
directions; two vectors at angle a agree in one sign with probability 1 - a/pi.
The number of bits follows the number of vectors, so buckets keep their size,
and the number of tables follows from the recall wanted at the threshold.
Vectors of a bucket are compared by exact cosine in double precision.  A pair
that meets in several tables counts only in the first.

A bucket of more than ``BLOCK`` vectors, such as a cluster that holds a third
of all rows, is cut into blocks, and every pair of blocks is a group of its own;
no pair is left out and no task gets more than two blocks.  Groups return each
vector's number of links and a spanning forest of its links, never all pairs;
components of the forests are components of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.blocks import Forest, crowded, groups, in_pairs_of_blocks
from spendlens.llm.components import connected_components
from spendlens.llm.store import cut, ship

COSINE = 0.95
RECALL = 0.995          #: chance that a pair at the threshold meets in some table
BUCKET = 32             #: vectors in a bucket on average, if they were spread evenly
BLOCK = 512             #: vectors of a bucket that one task compares with each other
SEED = 11
GROUP = ["tab", "dim", "bucket"]


def table_sizes(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(4, min(48, math.ceil(math.log2(max(n, 1) / BUCKET)))) if n > BUCKET else 4
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def directions(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, dim)).normal(size=(dim, bits * tables))


def signatures(vectors: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Keys of each vector in each table (rows x tables)."""
    signs = (vectors @ planes >= 0).reshape(len(vectors), -1, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors (double precision) of the usable rows, by length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null rows hold nothing here; null components are nan
    starts = np.cumsum(lengths) - lengths
    out = {}
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = values[starts[rows][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            square = (x * x).sum(axis=1)
            usable = np.isfinite(x).all(axis=1) & (square > 0) & (square < np.inf)
        if usable.any():
            out[dim] = rows[usable], x[usable]
    return out


def _as_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int64) * width).buffers()[1]
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, ends, pa.py_buffer(rows)]).cast(pa.binary())


def key_type(bits: int) -> type:
    return np.int32 if bits < 32 else np.int64


def _hash(bits: int, tables: int, seed: int, width: type | None):
    """Rows of each vector in each table: its place and, if a ``width`` is given, its keys in the tables before
    and the vector in numbers of that width."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column("vec_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            for dim, (rows, x) in _vectors(batch.column("embedding")).items():
                own, x = rows[known[rows]], x[known[rows]]
                if not len(own):
                    continue
                if dim not in planes:
                    planes[dim] = directions(dim, bits, tables, seed)
                keys = signatures(x, planes[dim], bits)
                same = [pa.array(np.full(len(own), dim, np.int32))]
                rest = [] if width is None else [ids.take(pa.array(own)), _as_binary(x.astype(width))]
                for t in range(tables):
                    place = [pa.array(np.full(len(own), t, np.int32)), *same, pa.array(keys[:, t])]
                    before = [] if width is None else [_as_binary(keys[:, :t].astype(key_type(bits)))]
                    yield pa.RecordBatch.from_arrays([*place, *rest, *before], [*GROUP, *(["vec_id", "data", "keys"] if rest else [])])
    return run


def compare(tab: int, ids: np.ndarray, keys: np.ndarray, x: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group in table ``tab``: how many each member has, and each member's root (positions).

    ``side``: 0 and 1 for the two blocks, of which only pairs across count; all 2 for a group of one block.
    Rows with the same id are one vector and are not linked to each other.
    """
    n = len(ids)
    counts, forest = np.zeros(n, np.int64), Forest(n)
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    linked = unit @ unit.T >= cosine
    linked &= ids[:, None] != ids[None, :]
    if side[0] != 2 or side[-1] != 2:
        linked &= side[:, None] != side[None, :]
    i, j = np.nonzero(linked)
    if len(i) and tab:  # leave pairs that met in an earlier table
        first = np.ones(len(i), bool)
        for t in range(tab):
            first &= keys[i, t] != keys[j, t]
        i, j = i[first], j[first]
    counts += np.bincount(i, minlength=n)
    if len(i):
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        for a, js in zip(i[start].tolist(), np.split(j, start[1:])):
            roots = {forest.root(b) for b in js.tolist()} if len(js) < 64 else {forest.root(b) for b in np.unique(js).tolist()}
            for b in roots:
                forest.join(a, b)
    return counts, np.array([forest.root(k) for k in range(n)])


def _compared(cosine: float, bits: int, width: type):
    """Rows in pairs of blocks -> (vec_id, n_links, other) for members with links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, GROUP):
            ids = rows.column("vec_id").to_numpy()
            tab, dim = (rows.column(c)[0].as_py() for c in ("tab", "dim"))
            x = np.frombuffer(b"".join(rows.column("data").to_pylist()), width).reshape(-1, dim).astype(np.float64)
            keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), key_type(bits)).reshape(len(ids), tab)
            counts, roots = compare(tab, ids, keys, x, rows.column("side").to_numpy(), cosine)
            some = counts > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[some], counts[some], ids[roots[some]])],
                                                 ["vec_id", "n_links", "other"])
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding: array of numbers).

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, and neither do rows without a vec_id (their component is
    null and they are kept); vectors of different lengths don't link.  Rows with
    the same vec_id are one vector: their links add up.  Other columns are
    ignored; an empty table gives an empty result.  No link is below the
    threshold; a pair at the threshold is found with the chance ``recall``.
    """
    spark = vectors.sparkSession
    ship(spark)
    # floats travel as floats: they are the same numbers in double precision
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                         F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    width = np.float32 if single else np.float64
    n = own.count()
    bits, tables = table_sizes(n, cosine, recall)
    hashed = own.mapInArrow(_hash(bits, tables, seed, width), "tab int, dim int, bucket long, vec_id long, data binary, keys binary")
    crowds = crowded(own.mapInArrow(_hash(bits, tables, seed, None), "tab int, dim int, bucket long"), GROUP, BLOCK)
    found = cut(in_pairs_of_blocks(hashed, GROUP, "vec_id", crowds)
                .mapInArrow(_compared(cosine, bits, width), "vec_id long, n_links long, other long"), "found")
    counts = found.groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    labels = connected_components(found, "vec_id", "other").withColumnRenamed("node", "vec_id")
    component = F.coalesce("component", "vec_id")
    return (own.select("vec_id").join(counts, "vec_id", "left").join(labels, "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                    (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept")))
