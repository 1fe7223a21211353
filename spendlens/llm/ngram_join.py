"""N-gram Jaccard join by a prefix tree.

A document's set is its distinct word shingles as 64-bit keys.  Keys are
ordered globally, rare first: shingles fall into a fixed number of hash
buckets, bucket sizes are counted over all documents, and a key's top bits are
replaced by the rank of its bucket, so the natural order of keys is the global
order (any fixed order gives the same links; a better one gives fewer
candidates).

1. Equal sets collapse to one representative, the smallest doc_id.
2. Two sets that link share a key among the first n - ceil(t * n) + 1 of both
   (prefix filter).  Prefixes meet by key; keys of one set only drop out.
3. Candidates with a common first document go into a prefix tree of their
   ordered sets.  The tree is walked once with that document's set: overlap is
   carried down shared branches, and a subtree is left as soon as the overlap
   so far plus the shorter remainder can't reach what the lengths ask for.
4. What survives is verified on the whole sets with integers.

Large groups of near copies must not be paired with each other.  First, stars
are verified: every key offers one centre for all sets that hold it.  Verified
links are contracted to components; then all sets that share a key but are
still in different components are compared, without any cap: as rows of pairs
where few sets have the key, else in pairs of blocks, in which a tree of one
block is walked once with all sets of the other.  Pairs inside a component
can't change the components, so the components are those of all links.

The links themselves are counted afterwards (``counted``): a link never leaves
its component, so the whole sets of each component are compared in pairs of
blocks, every pair of different sets once.  Tasks return a number for each set,
never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm import words as W
from spendlens.llm.blocks import Forest, crowded, groups, in_pairs_of_blocks
from spendlens.llm.components import connected_components
from spendlens.llm.store import cut, ship

SIZE = 5                #: words in a shingle
SIMILAR = (80, 100)     #: two documents link when 100 * intersection >= 80 * union
BUCKET_BITS = 18        #: 2**18 bucket counts go to the driver and back: 1 MB at any input size
STAR_ROUNDS = 2
FAMILIES = 4            #: centres that the keys of one group choose among

_U64 = np.uint64
_LOW = _U64((1 << (64 - BUCKET_BITS)) - 1)


def _prefix_lengths(n: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    t, of = similar
    return np.where(n > 0, n + (t * n) // -of + 1, 0)


def _needed(nx: int, ny: int, similar: tuple[int, int]) -> int:
    """Smallest overlap of sets of these sizes that link."""
    t, of = similar
    return -(-t * (nx + ny) // (of + t))


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = W.Words(batch.column("text"))
    return W.distinct_sets(*found.shingles(size), batch.num_rows)


def _signatures(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set; equal sets have equal sums, others differ but for a chance of 2**-128."""
    out = []
    for salt in (0, 0xA5A5A5A5A5A5A5A5):
        total = np.zeros(len(keys) + 1, _U64)
        np.cumsum(W.mix(keys ^ _U64(salt)), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _ordered(keys: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    top = (keys >> _U64(64 - BUCKET_BITS)).astype(np.int64)
    return (ranks[top].astype(_U64) << _U64(64 - BUCKET_BITS)) | (keys & _LOW)


def _binaries(keys: np.ndarray, bounds: np.ndarray, lengths: np.ndarray | None = None) -> pa.Array:
    """Each row's keys (or its first ``lengths``) as big-endian bytes, so bytes sort as keys do."""
    raw = keys.astype(">u8").tobytes()
    ends = bounds[1:] if lengths is None else bounds[:-1] + lengths
    return pa.array([raw[8 * a:8 * b] for a, b in zip(bounds[:-1].tolist(), ends.tolist())], pa.binary())


def _keys(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u8").astype(_U64)


# -- step 1: signatures and bucket counts ---------------------------------------------------


def _first_pass(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in (part for whole in batches for part in W.slices(whole, "text")):
            keys, bounds = _sets(batch, size)
            counts += np.bincount((keys >> _U64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS)
            s1, s2 = _signatures(keys, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2),
                 pa.nulls(batch.num_rows, pa.int64())], ["doc_id", "n", "s1", "s2", "bucket"])
        full = np.flatnonzero(counts)
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(counts[full]), none, none, pa.array(full)],
                                         ["doc_id", "n", "s1", "s2", "bucket"])
    return run


def _bucket_ranks(counts: DataFrame) -> np.ndarray:
    table = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2**BUCKET_BITS rows
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    n[table["bucket"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    ranks = np.empty(1 << BUCKET_BITS, np.uint32)
    ranks[np.argsort(n, kind="stable")] = np.arange(1 << BUCKET_BITS, dtype=np.uint32)
    return ranks


# -- step 2: prefixes ------------------------------------------------------------------------


def _ordered_sets(size: int, ranks, similar: tuple[int, int] | None):
    """(doc_id, n, s1, s2, keys): whole ordered sets, or their prefixes if ``similar`` is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = np.argsort(ranks.value).astype(np.uint32)
        for batch in (part for whole in batches for part in W.slices(whole, "text")):
            found = W.Words(batch.column("text"))
            hashes, rows = found.shingles(size)
            keys, bounds = W.distinct_sets(_ordered(hashes, ranks.value), rows, batch.num_rows)
            s1, s2 = _signatures(_ordered(keys, back), bounds)  # of the keys as they were hashed
            n = np.diff(bounds)
            lengths = None if similar is None else _prefix_lengths(n, similar)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(s1), pa.array(s2), _binaries(keys, bounds, lengths)],
                ["doc_id", "n", "s1", "s2", "keys"])
    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, rep, n, place) for each key of each prefix; place: keys before it."""
    for batch in batches:
        sizes = np.array([len(k.as_buffer()) // 8 for k in batch.column("keys")], np.int64)
        keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), ">u8").astype(_U64).view(np.int64)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(np.repeat(batch.column("rep").to_numpy(), sizes)),
             pa.array(np.repeat(batch.column("n").to_numpy(), sizes).astype(np.int32)), pa.array(place.astype(np.int32))],
            ["key", "rep", "n", "place"])


# -- step 3: the prefix tree -------------------------------------------------------------------


class Trie:
    """Ordered sets (or their prefixes) in a radix tree.

    A node holds the run of keys that all sets below it share, the smallest and
    largest whole size below, its children, and the members that end there.
    Nodes are built and walked with a stack: a set of any length is fine.
    """

    __slots__ = ("keys", "low", "high", "members", "children", "below", "beyond")

    def __init__(self, entries: list[tuple[bytes, int, int]]):
        """entries: (keys as big-endian bytes, whole size, member)."""
        todo = [(self, sorted(entries), 0)]
        while todo:
            node, own, depth = todo.pop()
            first, last = own[0][0], own[-1][0]
            end, most = depth, min(len(first), len(last))
            while end < most and first[end:end + 8] == last[end:end + 8]:
                end += 8
            node.keys = _keys(first[depth:end])
            node.low, node.high = min(e[1] for e in own), max(e[1] for e in own)
            node.members = [(e[1], e[2]) for e in own if len(e[0]) == end]
            node.children = []
            rest = own[len(node.members):]
            start = 0
            for i in range(1, len(rest) + 1):
                if i == len(rest) or rest[i][0][end:end + 8] != rest[start][0][end:end + 8]:
                    node.children.append(child := Trie.__new__(Trie))
                    todo.append((child, rest[start:i], end))
                    start = i

    def search(self, probe: np.ndarray, size: int, similar: tuple[int, int]) -> list[int]:
        """Members whose sets can still link with the set that ``probe`` begins; ``size`` is its whole size.

        Beyond the probe's last key nothing is known of its set, so the bound stays as it is there.
        """
        found: list[int] = []
        stack = [(self, 0, 0, 0)]  # node; overlap, keys of the probe and keys of the path up to the last one compared
        while stack:
            node, overlap, used, path = stack.pop()
            known = node.keys[:np.searchsorted(node.keys, probe[-1], "right")] if len(probe) else node.keys[:0]
            if len(known):
                at = np.minimum(np.searchsorted(probe, known), len(probe) - 1)
                overlap += int(np.count_nonzero(probe[at] == known))
                used = int(np.searchsorted(probe, known[-1], "right"))
                path += len(known)
            if overlap + min(size - used, node.high - path) < _needed(size, node.low, similar):
                continue
            found += [m for n, m in node.members
                      if overlap + min(size - used, n - path) >= _needed(size, n, similar)]
            stack += [(child, overlap, used, path) for child in node.children]
        return found


def batch_search(tree: Trie, probes: list[np.ndarray], sizes: np.ndarray, rest: np.ndarray, similar: tuple[int, int],
                 visit, first: int = 0) -> None:
    """Walk the tree once with many probes: visit(member, overlaps) wherever some probe can still link.

    ``rest``: keys of each probe's set beyond those given.  Pairs that share a
    key below ``first`` are left to that key's group.  Overlaps of all
    probes are carried down together; a subtree is left when no probe's overlap,
    plus the keys still to come below and beyond, reaches what the sizes ask for.
    """
    t, of = similar
    at: dict[int, list[int]] = {}
    for i, probe in enumerate(probes):
        for key in probe.tolist():
            at.setdefault(key, []).append(i)
    stack = [(tree, np.zeros(len(probes), np.int64))]
    while stack:
        node, overlaps = stack.pop()
        hits = [i for key in node.keys.tolist() for i in at.get(key, ())]
        if hits:
            overlaps = overlaps + np.bincount(hits, minlength=len(probes))
            early = [i for key in node.keys.tolist() if key < first for i in at.get(key, ())]
            overlaps[early] = _LEFT
        needed = -(-t * (sizes + node.low) // (of + t))
        if not (overlaps + node.below + np.maximum(rest, node.beyond) >= needed).any():
            continue
        for _, member in node.members:
            visit(member, overlaps)
        stack += [(child, overlaps) for child in node.children]


_LEFT = -(1 << 40)  #: overlap of a probe that the walk has left


def measure(tree: Trie, beyond: dict[int, int]) -> None:
    """Set each node's ``below`` (most keys on a path under it) and ``beyond`` (most keys that a member has besides its path)."""
    order, stack = [], [tree]
    while stack:
        order.append(node := stack.pop())
        stack += node.children
    for node in reversed(order):
        node.below = max((c.below + len(c.keys) for c in node.children), default=0)
        node.beyond = max([*(beyond[m] for _, m in node.members), *(c.beyond for c in node.children)])


#: Sets that share a key: up to LIGHT are paired as rows, more are compared in blocks.
LIGHT, BLOCK = 32, 512


def _block_links(group: str, similar: tuple[int, int]):
    """Rows (rep, component, n, known, last, keys) in pairs of blocks -> a forest (a, b) of pairs that can link.

    ``keys``: some of the first ``known`` keys of the set, at least all that
    another set of the group may share; ``last``: the last of the ``known``.
    Sets of one component aren't compared.  With whole sets the pairs do link.
    """
    t, of = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, [group]):
            reps, component, n, known = (rows.column(c).to_numpy() for c in ("rep", "component", "n", "known"))
            last, keys, side = rows.column("last").to_pylist(), rows.column("keys").to_pylist(), rows.column("side").to_numpy()
            rest = (n - known).astype(np.int64)
            rank = {x: i for i, x in enumerate(sorted(set(last)))}
            order = np.array([rank[x] for x in last])
            left, right = (np.flatnonzero(side != s) for s in (1, 0))
            if len(left) and len(right):
                tree = Trie([(keys[j], int(n[j]), int(j)) for j in right])
                measure(tree, {int(j): int(rest[j]) for j in right})
                forest = Forest(len(reps))
                a_n, a_rest, a_order, a_component = n[left], rest[left], order[left], component[left]

                def visit(j: int, overlaps: np.ndarray) -> None:
                    # the set whose known keys end first has only its rest to share beyond them
                    more = np.where(a_order <= order[j], a_rest, rest[j])
                    fits = ((overlaps + more >= -(-t * (a_n + n[j]) // (of + t))) & (a_component != component[j])
                            & (of * np.minimum(a_n, n[j]) >= t * np.maximum(a_n, n[j])))
                    for i in left[fits].tolist():
                        forest.join(i, j)

                first = int(np.int64(rows.column(group)[0].as_py()).view(_U64)) if group == "key" else 0
                batch_search(tree, [_keys(keys[i]) for i in left], a_n, a_rest, similar, visit, first)
                edges = [(reps[i], reps[r]) for i in range(len(reps)) if (r := forest.root(i)) != i and reps[i] != reps[r]]
                if edges:
                    yield _pairs(edges)
    return run


#: Keys that one step of a block's overlaps takes at once: bounds a task's memory.
KEYS_AT_ONCE = 4096


def overlaps(keys: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of keys that each left set shares with each right set (positions in ``keys``)."""
    sizes = np.array([len(k) for k in keys])
    rows = np.repeat(np.arange(len(keys)), sizes)
    _, column, held = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = held > 1                                # a key of one set adds nothing
    place = np.cumsum(shared) - 1
    rows, column = rows[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(shared.sum()), KEYS_AT_ONCE):
        a, b = np.searchsorted(column, (start, start + KEYS_AT_ONCE))
        held_here = np.zeros((len(keys), KEYS_AT_ONCE), np.float32)  # sums of at most KEYS_AT_ONCE ones are exact
        held_here[rows[a:b], column[a:b] - start] = 1
        out += (held_here[left] @ held_here[right].T).astype(np.int64)
    return out


def _link_counts(similar: tuple[int, int]):
    """Rows (component, s1, s2, n, copies, keys) in pairs of blocks -> (s1, s2, n, n_links): copies of the sets that each links with."""
    t, of = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, ["component"]):
            s1, s2, n, copies, side = (rows.column(c).to_numpy() for c in ("s1", "s2", "n", "copies", "side"))
            # rows repeated in the table come with the same set, in the same block
            once = np.sort(np.unique(np.stack([s1, s2, n]), axis=1, return_index=True)[1])
            s1, s2, n, copies, side = s1[once], s2[once], n[once], copies[once], side[once]
            left, right = (np.flatnonzero(side != s) for s in (1, 0))
            if not (len(left) and len(right)):
                continue
            raw = rows.column("keys").to_pylist()
            both = overlaps([_keys(raw[i]) for i in once.tolist()], left, right)
            linked = (of * both >= t * (n[left][:, None] + n[right][None, :] - both)) & (left[:, None] != right[None, :])
            counts = np.zeros(len(n), np.int64)
            counts[left] += linked @ copies[right]
            if side[0] != 2:
                counts[right] += copies[left] @ linked
            some = counts > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (s1, s2, n, counts)], ["s1", "s2", "n", "n_links"])
    return run


#: Partners in one tree: bounds a task's memory; a document with more gets several trees.
TREE_SIZE = 1024


def _walk(similar: tuple[int, int]):
    """Rows (a, a_n, a_keys, b, b_n, b_keys), runs of one ``a`` together -> pairs (a, b) that pass the tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def flush(a: int, a_n: int, probe: bytes, entries: list[tuple[bytes, int, int]]) -> None:
            out.extend((a, b) for b in Trie(entries).search(_keys(probe), a_n, similar))

        now, entries = None, []
        for batch in batches:
            for a, a_n, probe, b, b_n, keys in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if now is not None and (now != (a, a_n, probe) or len(entries) >= TREE_SIZE):
                    flush(*now, entries)
                    entries = []
                now = (a, a_n, probe)
                entries.append((keys, b_n, b))
            yield _pairs(out)
            out.clear()
        if entries:
            flush(*now, entries)
        yield _pairs(out)
    return run


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


# -- step 4: exact ---------------------------------------------------------------------------------


def _exact(similar: tuple[int, int]):
    t, of = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, x, b, y in zip(*(batch.column(c).to_pylist() for c in ("a", "a_keys", "b", "b_keys"))):
                x, y = _keys(x), _keys(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if of * both >= t * (len(x) + len(y) - both):
                    out.append((a, b))
            yield _pairs(out)
    return run


def _with_keys(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with both sides' sets; a hub's rows are split by AQE, as both sides of each join are plain tables."""
    side = lambda s: sets.select(F.col("rep").alias(s), F.col("n").alias(f"{s}_n"),
                                 F.col("keys").alias(f"{s}_keys"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "a_n", "a_keys", "b", "b_n", "b_keys")


class NgramJoin:
    """The join over one document table; ``links`` and ``classes`` are its results."""

    def __init__(self, docs: DataFrame, size: int = SIZE, similar: tuple[int, int] = SIMILAR):
        spark = docs.sparkSession
        ship(spark)
        self.size, self.similar = size, similar
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        first = cut(self.docs.mapInArrow(_first_pass(size), "doc_id long, n long, s1 long, s2 long, bucket long"), "sets")
        self.ranks = spark.sparkContext.broadcast(_bucket_ranks(first.filter("bucket IS NOT NULL")))
        self.rows = first.filter("bucket IS NULL").drop("bucket")
        self.classes_of = cut(self.rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n")
                              .agg(F.min("doc_id").alias("rep")), "classes")
        ordered = self.docs.mapInArrow(_ordered_sets(size, self.ranks, similar),
                                       "doc_id long, n long, s1 long, s2 long, keys binary").withColumnRenamed("doc_id", "rep")
        self.prefixes = cut(ordered.join(self.classes_of, ["rep", "s1", "s2", "n"], "left_semi").select("rep", "n", "keys"),
                            "prefixes")

    def _ordered_wholes(self, wanted: DataFrame) -> DataFrame:
        """(rep, n, s1, s2, keys) of the rows whose doc_id is in ``wanted``, computed again from their texts."""
        return (self.docs.join(wanted, "doc_id", "left_semi")
                .mapInArrow(_ordered_sets(self.size, self.ranks, None),
                            "doc_id long, n long, s1 long, s2 long, keys binary").withColumnRenamed("doc_id", "rep"))

    def _whole_sets(self, reps: DataFrame) -> DataFrame:
        """(rep, n, keys) of the given representatives, computed again from their texts."""
        wanted = cut(reps.select(F.col("id").alias("doc_id")).distinct(), "wanted")
        return cut(self._ordered_wholes(wanted).join(self.classes_of, ["rep", "s1", "s2", "n"], "left_semi").select("rep", "n", "keys"), "whole")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the candidate pairs (a, b) that link."""
        rows = _with_keys(pairs, self.prefixes).sortWithinPartitions("a")
        kept = cut(rows.mapInArrow(_walk(self.similar), "a long, b long").distinct(), "kept")
        whole = self._whole_sets(kept.select(F.col("a").alias("id")).union(kept.select(F.col("b").alias("id"))))
        return cut(_with_keys(kept, whole).mapInArrow(_exact(self.similar), "a long, b long").distinct(), "links")

    def links(self) -> DataFrame:
        """Verified links (a, b) between representatives that connect every class of linked sets."""
        postings = self.prefixes.mapInArrow(_postings, "key long, rep long, n int, place int")
        shared = cut(postings.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("key"), "keys")
        postings = cut(postings.join(shared, "key"), "postings")
        found = None
        for seed in range(STAR_ROUNDS):
            here = self._contracted(postings, found)
            centre = F.min_by("rep", F.xxhash64("rep", F.pmod("key", F.lit(FAMILIES)), F.lit(seed)))
            stars = cut(here.groupBy("key").agg(centre.alias("a")), "centres")
            tried = here.join(stars, "key").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
            new = self._verified(cut(tried, "tried"))
            found = new if found is None else cut(found.unionByName(new).distinct(), "links")
        here = self._contracted(postings, found)
        heavy = cut(here.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > LIGHT).select("key"), "heavy")
        return (found.unionByName(self._light(here.join(heavy, "key", "left_anti")))
                .unionByName(self._heavy(here, heavy)).distinct())

    def _light(self, here: DataFrame) -> DataFrame:
        """Links of sets in different components that share a key which few sets have."""
        side = lambda s: here.select("key", F.col("rep").alias(s), F.col("n").alias(f"{s}_n"),
                                     F.col("place").alias(f"{s}_at"), F.col("component").alias(f"{s}_c"))
        t, of = self.similar
        # what is left of both from the key on must suffice; it does at the first key that a linked pair shares
        enough = (of + t) * F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= t * (F.col("a_n") + F.col("b_n"))
        apart = (side("a").join(side("b"), "key").filter(
            (F.col("a") < F.col("b")) & (F.col("a_c") != F.col("b_c")) & enough
            & (of * F.least("a_n", "b_n") >= t * F.greatest("a_n", "b_n"))).select("a", "b").distinct())
        return self._verified(cut(apart, "apart"))

    def _heavy(self, here: DataFrame, heavy: DataFrame) -> DataFrame:
        """Links of sets in different components that share a key which many sets have.

        First the prefixes of a key's sets are compared, in pairs of blocks; sets
        that can link by what their prefixes show form clusters.  Then the whole
        sets of each cluster are compared the same way.
        """
        own = cut(here.join(heavy, "key").select("key", "rep", "component"), "heavy")
        if own.isEmpty():
            return own.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        sets = own.select("rep").distinct()
        path = (here.join(sets, "rep", "left_semi").groupBy("rep")
                .agg(F.array_sort(F.collect_list(F.struct("place", F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("key")))).alias("path"))
                .select("rep", F.aggregate("path", F.lit(b""), lambda acc, x: F.concat(acc, x["key"])).alias("shared")))
        shown = cut(self.prefixes.join(path, "rep").select(
            "rep", "n", (F.octet_length("keys") / 8).cast("long").alias("known"), F.substring("keys", -8, 8).alias("last"),
            F.col("shared").alias("keys")), "shown")
        rows = cut(own.join(shown, "rep"), "rows")
        can = cut(in_pairs_of_blocks(rows, ["key"], "rep", crowded(own, ["key"], BLOCK))
                  .mapInArrow(_block_links("key", self.similar), "a long, b long").distinct(), "can")
        label = connected_components(can, "a", "b")
        members = can.select(F.col("a").alias("node")).union(can.select(F.col("b").alias("node"))).distinct()
        cluster = cut(members.join(label, "node", "left").select(F.col("node").alias("rep"), F.coalesce("component", "node").alias("cluster")),
                      "cluster")
        whole = self._whole_sets(cluster.select(F.col("rep").alias("id")))
        parts = own.select("rep", "component").distinct()
        rows = cut(whole.join(cluster, "rep").join(parts, "rep").select(
            "cluster", "rep", "component", "n", F.col("n").alias("known"), F.substring("keys", -8, 8).alias("last"), "keys"), "rows")
        return cut(in_pairs_of_blocks(rows, ["cluster"], "rep", crowded(rows, ["cluster"], BLOCK))
                   .mapInArrow(_block_links("cluster", self.similar), "a long, b long").distinct(), "links")

    @staticmethod
    def _contracted(postings: DataFrame, links: DataFrame | None) -> DataFrame:
        """Postings with their set's component so far, of keys whose sets are in more than one component."""
        if links is None:
            return postings.withColumn("component", F.col("rep"))
        labels = connected_components(links, "a", "b").withColumnRenamed("node", "rep")
        here = cut(postings.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "postings")
        split = cut(here.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                    .filter("x <> y").select("key"), "keys")
        return cut(here.join(split, "key"), "postings")

    def _labelled(self) -> tuple[DataFrame, DataFrame]:
        """Rows (doc_id, n_shingles, representative, s1, s2), and the components (representative, component) of more than one."""
        member = cut(self.rows.join(self.classes_of, ["s1", "s2", "n"], "left")
                     .select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2",
                             F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("representative")), "members")
        several = (member.groupBy("doc_id").agg(F.min("representative").alias("x"), F.max("representative").alias("y"))
                   .filter("x <> y").select("doc_id"))
        same_id = (member.join(several, "doc_id", "left_semi")
                   .select(F.col("doc_id").alias("a"), F.col("representative").alias("b")))
        labels = connected_components(self.links().unionByName(same_id), "a", "b")
        return member, labels.select(F.col("node").alias("representative"), "component")

    def classes(self) -> DataFrame:
        """(doc_id, n_shingles, representative, component_id), a row for each input row."""
        member, labels = self._labelled()
        return (member.join(labels, "representative", "left")
                .select("doc_id", "n_shingles", "representative",
                        F.coalesce("component", "representative").alias("component_id")))

    def counted(self) -> DataFrame:
        """``classes`` with n_links: the documents, each once for each of its different sets, whose set links with the row's."""
        member, labels = self._labelled()
        found = cut(member.join(labels, "representative", "left")
                    .withColumn("component_id", F.coalesce("component", "representative")).drop("component"), "found")
        sets = (found.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", F.col("n_shingles").alias("n"))
                .agg(F.count_distinct("doc_id").alias("copies"), F.min("representative").alias("rep"),
                     F.min("component_id").alias("component")))
        sets = cut(sets, "sets")
        several = sets.groupBy("component").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("component")
        own = cut(sets.join(several, "component", "left_semi"), "several")
        wanted = cut(own.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
        rows = (self._ordered_wholes(wanted).join(own, ["rep", "s1", "s2", "n"])
                .select("component", "rep", "s1", "s2", "n", "copies", "keys"))
        links = cut(in_pairs_of_blocks(rows, ["component"], "rep", crowded(own, ["component"], BLOCK))
                    .mapInArrow(_link_counts(self.similar), "s1 long, s2 long, n long, n_links long"), "counts")
        links = links.groupBy("s1", "s2", "n").agg(F.sum("n_links").alias("others"))
        per_set = (sets.join(links, ["s1", "s2", "n"], "left")
                   .select("s1", "s2", F.col("n").alias("n_shingles"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
        n_links = F.when(F.col("doc_id").isNotNull(), F.col("n_links"))
        return (found.join(per_set, ["s1", "s2", "n_shingles"], "left")
                .select("doc_id", "n_shingles", "representative", "component_id", F.coalesce(n_links, F.lit(0)).alias("n_links")))


def ngram_jaccard_join(docs: DataFrame, size: int = SIZE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Classes of documents linked by n-gram Jaccard similarity: (doc_id, n_shingles, representative, component_id).

    One row for each row of ``docs`` (columns doc_id and text; others are ignored).
    A null, empty or wordless text has an empty set and links with nothing.
    Rows with the same doc_id are one document: what any of them links with is
    in its component.  A row without a doc_id can't be named by a link; it keeps
    its n_shingles and has no component.  An empty table gives an empty result.
    """
    return NgramJoin(docs, size, similar).classes()


def ngram_jaccard_links(docs: DataFrame, size: int = SIZE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``ngram_jaccard_join`` with a further column n_links, the number of links of the row's set.

    Counted are all other documents whose set links with the row's or equals
    it; one whose rows hold several different sets that do counts with each of
    them.  Copies of a text are counted, never paired off.  Rows without words
    or without a doc_id have 0.
    """
    return NgramJoin(docs, size, similar).counted()


def keep_one(docs: DataFrame, size: int = SIZE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Of each class of linked documents, the row of the document that names the class; all columns of ``docs``.

    Of repeated rows of one doc_id, one stays.  Rows without words link with
    nothing and all stay, as do rows without a doc_id.  Texts are joined with
    the table of ids that go, which Spark broadcasts only if it is small.
    """
    found = cut(ngram_jaccard_join(docs, size, similar), "classes")
    gone = cut(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"))
    kept = packed.join(gone, "doc_id", "left_anti")
    worded = found.filter("doc_id = component_id AND n_shingles > 0")
    repeated = cut(worded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        words = F.coalesce(F.col("_row.text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        again = kept.join(repeated, "doc_id", "left_semi")
        kept = (kept.join(repeated, "doc_id", "left_anti").unionByName(again.filter(~words))
                .unionByName(again.filter(words).groupBy("doc_id").agg(F.min_by("_row", F.col("_row.text")).alias("_row"))))
    return kept.select("_row.*")
