"""Alignment of two tokenizers over a corpus, from their own spans.

Tokenizer A is byte-level BPE (a ``tokenizers`` file) and reads space + text; B
is a ``sentencepiece`` BPE model, which adds that space itself.  A's spans are
offsets in characters and B's in bytes (characters in some versions): both are
coarse cuts.  A token that ends inside a character, and a byte-fallback token,
has no cut of its own there; its end comes from the bytes that the tokens
decode to, counted on from the last cut.

Neither tokenizer has a token that goes from a non-white character over a space
(checked on the two vocabularies; else a whole text is one word), so a text is
cut into words there, and each different word of the corpus is encoded once:
its tokens, groups and links are those it has inside any text.

1. Documents are read in blocks: each document becomes numbers of its block's words.
2. The blocks' words are hashed over parts; a part encodes its words and adds up
   their links, weighted by occurrences; sums over parts give an id pair's count.
3. Counts go back to the words of each part, and from there to the blocks,
   where documents add up their words.

Parts and blocks are bounded by bytes.  A frequent word or pair comes once from
each block or part, however often it occurs.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.llm.store import cut, ship

BLOCK_CHARS = 1 << 25   #: characters of the documents of a block, about
PART_BYTES = 1 << 23    #: bytes of the words that blocks send to a part, about
SPREAD = 4              #: shuffle partitions for each part or block, so that few of them meet in one task
AT_ONCE = 1 << 19       #: bytes of words encoded and aligned at once
JOINED = 1 << 14        #: characters of words encoded by one call
MARK = "▁"         #: B's space

_CUT = re.compile(r"(?<=\S) ")
_WHITE_THEN_SPACE = re.compile(r"\s ")


def split_words(text: str) -> list[str]:
    """Words of space + text without the space each begins with: cuts are spaces behind a character that isn't
    white, but for white space at the end, which stays with the last word."""
    body = text.rstrip()
    if body.startswith(" ") or _WHITE_THEN_SPACE.search(body):
        words = _CUT.split(body)
    else:
        words = body.split(" ")
    words[-1] += text[len(body):]
    return words


class Pair:
    """Both tokenizers, their tokens' bytes, and what their vocabularies allow."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        # byte-level characters: printable Latin-1 stands for itself, the other bytes for U+0100 on, in order
        own = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or 0xAE <= c <= 0xFF]
        byte_of = {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in own)}
        assert set(byte_of) == set(ByteLevel.alphabet())
        entries = sorted((i, e) for e, i in self.a.get_vocab(with_added_tokens=True).items())
        self.bytes_a = [b""] * (entries[-1][0] + 1)
        for i, entry in entries:
            self.bytes_a[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.plain = self._plain(json.loads(self.a.to_str()), pieces)
        self._names = None

    def _plain(self, a: dict, pieces: list[str]) -> bool:
        """Whether both keep every byte (but MARK) and cut behind each word."""
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        n, t = model.normalizer_spec, model.trainer_spec
        return (a["normalizer"] is None and a["pre_tokenizer"]["type"] == "ByteLevel" and a["pre_tokenizer"]["use_regex"]
                and not a["pre_tokenizer"]["add_prefix_space"] and a["model"]["type"] == "BPE" and a["post_processor"] is None
                and set(range(256)) <= {x[0] for x in self.bytes_a if len(x) == 1}
                and not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
                and t.model_type == t.BPE and t.byte_fallback and not any(MARK in p.lstrip(MARK) for p in pieces)
                and not any(p.type == p.USER_DEFINED for p in model.pieces))

    def words(self, text: str | None) -> list[str]:
        """Words to encode one by one; none for a text without tokens (null, empty, or not kept byte by byte)."""
        if not text:
            return []
        if self.plain:
            return [] if MARK in text else split_words(text)
        target = f" {text}".encode()
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        same = b"".join(self.bytes_a[i] for i in ids) == target == b"".join(self.bytes_b[i] for i in self.b.encode(text))
        return [text] if same else []

    def names(self) -> list[bytes]:
        """Decimal ids with what follows them: A inside and at the end of a group's A, B inside, at the end of a group, of a word."""
        if self._names is None:
            self._names = [f"{i}{end}".encode() for ids, end in (
                (self.bytes_a, ","), (self.bytes_a, "|"), (self.bytes_b, ","), (self.bytes_b, ";"), (self.bytes_b, "")) for i in range(len(ids))]
        return self._names

    def encode_a(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ends (in bytes) of the tokens of ``text``, whose bytes are ``data``."""
        found = self.a.encode(text, add_special_tokens=False)
        ids, spans = np.array(found.ids, np.int64), np.array(found.offsets, np.int64).reshape(-1, 2)
        at = _char_ends(data)
        return ids, refine(at[spans[:, 1]], np.append(spans[1:, 0] >= spans[:-1, 1], True), self.len_a[ids])

    def encode_b(self, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for B, which adds the space: ``size`` bytes with it."""
        pieces = self.b.encode(text, return_type="proto").pieces
        ids, ends = np.array([p.id for p in pieces], np.int64), np.array([p.end for p in pieces], np.int64)
        if ends[-1] != size - 1:   # spans in characters
            ends = _char_ends(text.encode())[ends]
        # the bytes of one character: the last one has its span, the others an empty one
        cuts = ~self._byte_ids()[ids] | (np.diff(ends, prepend=0) > 0)
        return ids, refine(ends + 1, cuts, self.len_b[ids])

    def _byte_ids(self) -> np.ndarray:
        if not hasattr(self, "_is_byte"):
            self._is_byte = np.array([self.b.is_byte(i) for i in range(len(self.bytes_b))])
        return self._is_byte


def _char_ends(data: bytes) -> np.ndarray:
    """Byte offset of each character of UTF-8 ``data``, and of its end."""
    if data.isascii():
        return np.arange(len(data) + 1)
    return np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))


def refine(ends: np.ndarray, cuts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens: ``ends`` where ``cuts``, elsewhere counted on from the last cut by the tokens' ``sizes``.

    Raises ValueError if a cut and the bytes before it differ.
    """
    total = np.cumsum(sizes)
    at = np.flatnonzero(cuts)
    if not np.array_equal(np.diff(ends[at], prepend=0), np.diff(total[at], prepend=0)):
        raise ValueError("tokens and spans differ")
    last = np.searchsorted(at, np.arange(len(ends)), "right") - 1
    base = np.where(last >= 0, ends[at[last]] - total[at[last]], 0)
    return np.where(cuts, ends, total + base)


class Aligned:
    """Tokens, groups and links of a list of words.  For each word: n_a, n_b, n_groups, its links (``pairs``
    from ``link_ends``) and its groups as text (``groups`` from ``group_ends``).  A pair is A's id << 32 | B's."""

    def __init__(self, own: Pair, words: list[str]):
        ids_a, ids_b, ends_a, ends_b, sizes = [], [], [], [], []
        base = 0
        for group in _joinable(words):
            text = " " + " ".join(group)
            data = text.encode()
            a, ea = own.encode_a(text, data)
            b, eb = own.encode_b(text[1:], len(data))
            if ea[-1] != len(data) or eb[-1] != len(data):
                raise ValueError("tokens don't cover the text")
            ids_a.append(a), ids_b.append(b), ends_a.append(ea + base), ends_b.append(eb + base)
            sizes += [len(data)] if len(group) == 1 else [len(w.encode()) + 1 for w in group]
            base += len(data)
        a, b, ea, eb = (np.concatenate(x) for x in (ids_a, ids_b, ends_a, ends_b))
        edges = np.cumsum(sizes)
        word_a, word_b = np.searchsorted(edges, ea), np.searchsorted(edges, eb)
        self.n_a, self.n_b = (np.bincount(w, minlength=len(words)) for w in (word_a, word_b))
        cuts = np.intersect1d(ea, eb, assume_unique=True)
        self.n_groups = np.bincount(np.searchsorted(edges, cuts), minlength=len(words))
        # between two neighbouring ends of either kind lies one link
        ends = np.union1d(ea, eb)
        self.pairs = a[np.searchsorted(ea, ends)] << 32 | b[np.searchsorted(eb, ends)]
        self.link_ends = np.cumsum(np.bincount(np.searchsorted(edges, ends), minlength=len(words)))
        group_a, group_b = np.searchsorted(cuts, ea), np.searchsorted(cuts, eb)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        k, m = len(own.bytes_a), len(own.bytes_b)
        final_a, final_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + np.where(final_a, k, 0)
        word_final = np.append(word_b[1:] != word_b[:-1], True)
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        codes[place_b] = 2 * k + b + np.where(word_final, 2 * m, np.where(final_b, m, 0))
        names = [own.names()[c] for c in codes.tolist()]
        ends_of_names = np.cumsum(np.fromiter(map(len, names), np.int64, len(names)))
        self.groups = b"".join(names)
        self.group_ends = ends_of_names[place_b[word_final]]


def _joinable(words: list[str]) -> Iterator[list[str]]:
    """Words that can be encoded as one text: a word that ends in white space, or has no character that isn't, stands alone."""
    held, size = [], 0
    for word in words:
        if not word or word[-1].isspace():
            if held:
                yield held
            yield [word]
            held, size = [], 0
            continue
        held.append(word)
        size += len(word)
        if size >= JOINED:
            yield held
            held, size = [], 0
    if held:
        yield held


_pairs: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def pack(values) -> bytes:
    """Integers (32 or 64 bits) as planes of equal bytes, which compress well."""
    a = np.ascontiguousarray(values)
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _split(data: bytes, ends: np.ndarray) -> list[bytes]:
    edges = [0, *ends.tolist()]
    return [data[a:b] for a, b in itertools.pairwise(edges)]


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _map(df: DataFrame, function, ddl: str) -> DataFrame:
    """``function`` (batches, Arrow schema) -> batches, on the executors."""
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = df.sparkSession.createDataFrame([], ddl).schema
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: function(batches, arrow), schema)


def _read_blocks(path_a: str, path_b: str):
    """Documents to their words' numbers, and each block's words with their occurrences (row of kind 0 at its end)."""
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        own = pair_of(path_a, path_b)
        block = TaskContext.get().partitionId() << 24
        number: dict[str, int] = {}
        counts = np.zeros(0, np.int64)
        chars = 0

        def vocabulary() -> pa.RecordBatch:
            data = [w.encode() for w in number]
            sizes = np.array([len(x) for x in data], np.uint32)
            joined = b"".join(data)
            return _batch(schema, [{"block": block, "kind": 0, "data": joined, "sizes": pack(sizes), "counts": pack(counts), "n": len(joined)}])

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                words = own.words(text)
                ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint32)
                if len(number) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(number) - len(counts), len(counts)), np.int64)])
                np.add.at(counts, ids, 1)
                rows.append({"block": block, "kind": 1, "doc_id": doc, "data": pack(ids), "n": len(ids)})
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    counts = counts[:len(number)]
                    yield _batch(schema, rows)
                    yield vocabulary()
                    rows, number, counts, chars, block = [], {}, np.zeros(0, np.int64), 0, block + 1
            if rows:
                yield _batch(schema, rows)
        if chars:
            counts = counts[:len(number)]
            yield vocabulary()
    return run


def _to_parts(parts: int):
    """A block's words to the parts they hash to, each with its number in the block and its occurrences."""
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
            counts = unpack(row["counts"], np.int64)
            words = _split(row["data"], np.cumsum(sizes))
            part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(own):
                    yield _batch(schema, [{"part": int(part[own[0]]), "block": row["block"], "data": b"".join([words[i] for i in own.tolist()]),
                                           "sizes": pack(sizes[own].astype(np.uint32)), "ids": pack(own.astype(np.uint32)),
                                           "counts": pack(counts[own])}])
    return run


def _encode_parts(path_a: str, path_b: str):
    """Each word of a part encoded once, in slices (kind 1), and the part's id pairs with their counts (kind 0)."""
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        own = pair_of(path_a, path_b)

        def encoded(part: int, words: dict[bytes, int], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            found_pairs, found_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            at = 0
            for data in _slices(list(words)):
                aligned = Aligned(own, [w.decode() for w in data])
                links = np.diff(aligned.link_ends, prepend=0)
                weights = np.repeat(counts[at:at + len(data)], links)
                at += len(data)
                found_pairs, found_counts = _summed(np.concatenate([found_pairs, aligned.pairs]), np.concatenate([found_counts, weights]))
                yield _batch(schema, [{
                    "part": part, "kind": 1, "data": b"".join(data), "sizes": pack(np.array([len(w) for w in data], np.uint32)),
                    "n_a": pack(aligned.n_a.astype(np.uint32)), "n_b": pack(aligned.n_b.astype(np.uint32)),
                    "n_groups": pack(aligned.n_groups.astype(np.uint32)), "links": pack(links.astype(np.uint32)), "pairs": pack(aligned.pairs),
                    "groups": aligned.groups, "group_sizes": pack(np.diff(aligned.group_ends, prepend=0).astype(np.uint32))}])
            for i in range(0, len(found_pairs), 1 << 16):
                yield _batch(schema, [{"part": part, "kind": 0, "pair_list": found_pairs[i:i + (1 << 16)].tolist(),
                                       "count_list": found_counts[i:i + (1 << 16)].tolist()}])

        part, words, counts = None, {}, np.zeros(0, np.int64)
        for row in (r for batch in batches for r in batch.to_pylist()):
            if row["part"] != part:
                if part is not None:
                    yield from encoded(part, words, counts)
                part, words, counts = row["part"], {}, np.zeros(0, np.int64)
            sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
            ids = np.array([words.setdefault(w, len(words)) for w in _split(row["data"], np.cumsum(sizes))])
            counts = np.concatenate([counts, np.zeros(len(words) - len(counts), np.int64)])
            counts[ids] += unpack(row["counts"], np.int64)   # a block holds a word once
        if part is not None:
            yield from encoded(part, words, counts)
    return run


def _slices(words: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for word in words:
        held.append(word)
        size += len(word) + 1
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values, first) if len(first) else values


STATS = ("n_a", "n_b", "n_groups", "links", "best", "counted")


def _to_blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """In each part: pair counts (kind 0), then its words (1), then the words that blocks ask for (2)."""
    part, pairs, lookup, known = None, [], None, {}
    stats: dict[str, list[np.ndarray]] = {}
    groups: list[bytes] = []
    table: dict[str, np.ndarray] = {}
    for batch in batches:
        # counts of pairs are plain rows: taken column by column
        kinds, part_of = batch.column("kind").to_numpy(), batch.column("part").to_numpy()
        at = 0
        while at < batch.num_rows:
            if part_of[at] != part:
                part, pairs, lookup, known, groups, table = int(part_of[at]), [], None, {}, [], {}
                stats = {name: [] for name in STATS}
            if kinds[at] == 0:
                here = (kinds[at:] == 0) & (part_of[at:] == part)
                stop = at + (int(np.argmin(here)) if not here.all() else len(here))
                own = batch.slice(at, stop - at)
                pairs.append([own.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
                at = stop
                continue
            row = batch.slice(at, 1).to_pylist()[0]
            at += 1
            sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
            words = _split(row["data"], np.cumsum(sizes))
            if row["kind"] == 1:
                if lookup is None:
                    keys, n, best = (np.concatenate(c) for c in zip(*pairs))
                    order = np.argsort(keys)
                    lookup, pairs = (keys[order], n[order], best[order].astype(np.int64)), []
                keys, n, best = lookup
                links = unpack(row["links"], np.uint32).astype(np.int64)
                place = np.searchsorted(keys, unpack(row["pairs"], np.int64))
                first = np.cumsum(links) - links
                for name in ("n_a", "n_b", "n_groups"):
                    stats[name].append(unpack(row[name], np.uint32).astype(np.int64))
                stats["links"].append(links)
                stats["best"].append(np.add.reduceat(best[place], first))   # every word has a link
                stats["counted"].append(np.add.reduceat(n[place], first))
                for w in words:
                    known[w] = len(known)
                groups += _split(row["groups"], np.cumsum(unpack(row["group_sizes"], np.uint32).astype(np.int64)))
                continue
            if not table:
                table = {name: np.concatenate(parts) for name, parts in stats.items()}
            own_words = np.array([known[w] for w in words])
            texts = [groups[i] for i in own_words.tolist()]
            yield _batch(schema, [{"block": row["block"], "kind": 0, "ids": row["ids"], "groups": b"".join(texts),
                                   "group_sizes": pack(np.array([len(t) for t in texts], np.uint32)),
                                   **{name: pack(table[name][own_words]) for name in STATS}}])


def _documents(keep_groups: bool):
    """In each block: its words' figures (kind 0), then its documents (1)."""
    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        block, groups, stats, parts = None, [], np.zeros((len(STATS), 0), np.int64), []
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, parts, groups = row["block"], [], []
                if row["kind"] == 0:
                    parts.append(row)
                    continue
                if parts and not groups:
                    ids = [unpack(p["ids"], np.uint32) for p in parts]
                    groups = [b""] * sum(map(len, ids))
                    stats = np.zeros((len(STATS), len(groups)), np.int64)
                    for own, p in zip(ids, parts):
                        for i, name in enumerate(STATS):
                            stats[i, own] = unpack(p[name], np.int64)
                        for i, g in zip(own.tolist(), _split(p["groups"], np.cumsum(unpack(p["group_sizes"], np.uint32).astype(np.int64)))):
                            groups[i] = g
                    parts = []
                ids = unpack(row["data"], np.uint32)
                sums = stats[:, ids].sum(axis=1).tolist() if len(ids) else [0] * len(STATS)
                text = b";".join([groups[i] for i in ids.tolist()])
                out = dict(zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), sums))
                rows.append({"doc_id": row["doc_id"], **out, "groups_sha256": hashlib.sha256(text).hexdigest() if len(ids) else "",
                             **({"groups": text.decode()} if keep_groups else {})})
            if rows:
                yield _batch(schema, rows)
    return run


class Alignment:
    """Both tokenizers over ``docs`` (doc_id, text).

    A null or empty text, and one whose tokens of A or of B don't give back
    space + text (one with U+2581), has no tokens: zeros and an empty hash.
    Repeated rows count each, in the pairs' counts too.  Texts of any length are
    read whole; other columns are ignored; an empty table gives an empty result.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str):
        spark = docs.sparkSession
        ship(spark)
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        # written once: block numbers and the order of words must not change between steps
        self.table = cut(_map(docs.select("doc_id", F.col("text").cast("string").alias("text")), _read_blocks(path_a, path_b),
                              f"block long, kind int, doc_id {self.kind}, data binary, sizes binary, counts binary, n long"), "blocks")
        words = self.table.filter("kind = 0")
        size, self.blocks = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.parts = max(1, math.ceil(size / PART_BYTES))
        self.asked = _map(words.select("block", "data", "sizes", "counts"), _to_parts(self.parts),
                          "part long, block long, data binary, sizes binary, ids binary, counts binary")
        self.encoded = cut(_map(self._by_part(self.asked.drop("ids"), "block"), _encode_parts(path_a, path_b),
                                "part long, kind int, data binary, sizes binary, n_a binary, n_b binary, n_groups binary, links binary, "
                                "pairs binary, groups binary, group_sizes binary, pair_list array<long>, count_list array<long>"), "words")

    def _by_part(self, df: DataFrame, *order: str) -> DataFrame:
        return df.repartition(SPREAD * self.parts, "part").sortWithinPartitions("part", *order)

    def _part_pairs(self) -> DataFrame:
        return (self.encoded.filter("kind = 0").select("part", F.explode(F.arrays_zip("pair_list", "count_list")).alias("p"))
                .select("part", F.col("p.pair_list").alias("pair"), F.col("p.count_list").alias("n")))

    def pairs(self) -> DataFrame:
        """Every id pair of the corpus: a_id, b_id, n (links that hold it), best (no pair of that b_id has a larger n)."""
        counted = self._part_pairs().groupBy("pair").agg(F.sum("n").alias("n"))
        counted = cut(counted.select("pair", F.col("pair").bitwiseAND((1 << 32) - 1).alias("b_id"), "n"), "pairs")
        top = counted.groupBy("b_id").agg(F.max("n").alias("top"))   # at most one row for each token of B
        return counted.join(F.broadcast(top), "b_id").select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "n",
                                                             (F.col("n") == F.col("top")).alias("best"))

    def documents(self, keep_groups: bool = False) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups."""
        counts = self._part_pairs().select("part", "pair").join(self.pairs().select("pair", "n", "best"), "pair")
        rows = (counts.withColumn("kind", F.lit(0))
                .unionByName(self.encoded.filter("kind = 1").drop("pair_list", "count_list"), allowMissingColumns=True)
                .unionByName(self.asked.drop("counts").withColumn("kind", F.lit(2)), allowMissingColumns=True))
        answers = _map(self._by_part(rows, "kind"), _to_blocks,
                       "block long, kind int, ids binary, groups binary, group_sizes binary, " + ", ".join(f"{s} binary" for s in STATS))
        own = self.table.filter("kind = 1").select("block", "kind", "doc_id", "data")
        both = (own.unionByName(answers, allowMissingColumns=True).repartition(max(1, SPREAD * self.blocks), "block")
                .sortWithinPartitions("block", "kind"))
        return _map(both, _documents(keep_groups),
                    f"doc_id {self.kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
                    + (", groups string" if keep_groups else ""))
