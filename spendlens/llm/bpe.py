"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has exactly one last token in its encoding.  If
that token is t, the encoding of the prefix is the encoding of the prefix
without t, followed by t; so the last tokens of all prefixes hold the encodings
of all prefixes.  The last token of a prefix is the one token that ends there
and forms a valid pair with the last token before it; a pair is valid if the
merge rules would keep its seam, which is decided by undoing merges along the
seam, latest first.

The table of last tokens grows byte by byte, so appending is exact, and after an
edit only the prefixes from the edit on change, until the table agrees with the
old one again.

A text is cut into pieces by the pattern first.  The tables of all new pieces of
a slice of texts are filled side by side in numpy, one place of the prefixes
after another; pieces and pairs seen before are kept in bounded caches.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.store import ship
from spendlens.llm.words import slices

CACHE = 300_000         #: pieces of a generation of the cache, which has two; only speed depends on it
PAIRS = 4_000_000       #: pairs of tokens whose seam is known; only speed depends on it
CACHED_CHARS = 64       #: longer pieces are encoded alone and anew each time


class Vocabulary:
    """Tokens by rank, and the rules that follow from them."""

    def __init__(self, tokens: Iterable[tuple[bytes, int]]):
        self.rank = dict(tokens)
        self.token = [b""] * (max(self.rank.values(), default=-1) + 1)
        for data, number in self.rank.items():
            self.token[number] = data
        # bytes that are or begin a token: 2 * (rank + 1) for a token, plus 1 if a longer token begins so
        self.walk = {data: 2 * (number + 1) for data, number in self.rank.items()}
        for data in self.rank:
            for i in range(1, len(data)):
                self.walk[data[:i]] = self.walk.get(data[:i], 0) | 1
        self.longest = max(map(len, self.rank), default=0)
        self.size = np.array([len(data) for data in self.token], np.int64)
        # the same as a trie: node << 8 | byte -> node, the token of a node (or -1), whether it goes on
        node = {data: i for i, data in enumerate(self.walk, 1)} | {b"": 0}
        edges = sorted((node[data[:-1]] << 8 | data[-1], node[data]) for data in self.walk)
        self.edges, self.target = (np.array(c, np.int64) for c in (zip(*edges) if edges else ((), ())))
        self.node_token, self.node_open = np.full(len(node), -1, np.int64), np.zeros(len(node), bool)
        for data, step in self.walk.items():
            self.node_token[node[data]], self.node_open[node[data]] = (step >> 1) - 1, step & 1
        self.seams, self.holds = np.zeros(0, np.int64), np.zeros(0, bool)  # known pairs in order, and whether they fit
        self._parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}  # by left << 20 | right

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A file of lines: base64 of the token, blank, rank."""
        with open(path, "rb") as lines:
            return cls((base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines if line.strip()))

    def parts(self, number: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; (number, number) for a single byte."""
        if number not in self._parts:
            data = self.token[number]
            cuts = list(range(len(data) + 1))
            while len(cuts) > 3:  # merge until two parts are left
                ranks = [self.rank.get(data[cuts[i]:cuts[i + 2]], len(self.token)) for i in range(len(cuts) - 2)]
                best = min(range(len(ranks)), key=ranks.__getitem__)
                del cuts[best + 1]
            self._parts[number] = ((self.rank[data[:cuts[1]]], self.rank[data[cuts[1]:]]) if len(data) > 1 else (number, number))
        return self._parts[number]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is just these two tokens."""
        known = self.pairs.get(left << 20 | right)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[left << 20 | right] = self._seam_holds(left, right)
        return known

    def fit(self, pairs: np.ndarray) -> np.ndarray:
        """``fits`` of many pairs (left << 20 | right)."""
        at = np.searchsorted(self.seams, pairs)
        seen = np.zeros(len(pairs), bool)
        inside = at < len(self.seams)
        seen[inside] = self.seams[at[inside]] == pairs[inside]
        new = np.unique(pairs[~seen])
        if len(new):
            if len(self.seams) > PAIRS:  # keep those in use
                used = np.unique(at[seen])
                self.seams, self.holds = self.seams[used], self.holds[used]
            mask = (1 << 20) - 1
            found = np.array([self._seam_holds(p >> 20, p & mask) for p in new.tolist()])
            place = np.searchsorted(self.seams, new)
            self.seams, self.holds = np.insert(self.seams, place, new), np.insert(self.holds, place, found)
            at = np.searchsorted(self.seams, pairs)
        return self.holds[at]

    def _seam_holds(self, left: int, right: int) -> bool:
        # Undo the latest merge beside the seam, again and again: the two tokens then at the seam were
        # there together before that merge, so the seam is lost if they merge with an earlier rank.  With
        # equal ranks the left occurrence merges first.
        latest = len(self.token)  # rank of the merge undone last
        of_right = False          # whether it was on the right of the seam
        while True:
            joint = self.rank.get(self.token[left] + self.token[right])
            if joint is not None and (joint < latest or joint == latest and of_right):
                return False
            can_left, can_right = len(self.token[left]) > 1, len(self.token[right]) > 1
            if not can_left and not can_right:
                return True
            if can_left and (not can_right or left > right):  # of equal merges the right one came later
                latest, of_right = left, False
                left = self.parts(left)[1]
            else:
                latest, of_right = right, True
                right = self.parts(right)[0]


class PrefixEncoder:
    """Encoding of a byte string that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []   # last token of the prefix of i + 1 bytes
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._last(end))

    def _last(self, end: int) -> int:
        rank, fits = self.vocabulary.rank, self.vocabulary.fits
        for start in range(max(0, end - self.vocabulary.longest), end):
            token = rank.get(self.data[start:end])
            if token is not None and (start == 0 or fits(self.last[start - 1], token)):
                return token
        raise ValueError(f"no token for byte {self.data[end - 1]}")

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Replace bytes start to stop; returns the number of prefixes that were computed again.

        Once as many prefixes as the longest token is long agree with the old
        table behind the edit, all later ones do, and the old table's tail stays.
        """
        tail, old = self.last[stop:], self.data
        self.data = old[:start] + data + old[stop:]
        del self.last[start:]
        agree, done = 0, 0
        first = start + len(data)
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last(end))
            done += 1
            behind = end - 1 - first
            if behind >= 0:
                same = self.last[-1] == tail[behind] and len(self.vocabulary.token[tail[behind]]) <= behind + 1
                agree = agree + 1 if same else 0
                if agree >= self.vocabulary.longest:
                    self.last += tail[behind + 1:]
                    break
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.token[out[-1]])
        return out[::-1]


def encode_piece(vocabulary: Vocabulary, data: bytes) -> list[int]:
    """The encoding of one piece, by the table of last tokens, filled forward from each encodable prefix."""
    whole = vocabulary.rank.get(data)
    if whole is not None:
        return [whole]
    n = len(data)
    last = [-1] * (n + 1)
    walk, pairs, fits = vocabulary.walk.get, vocabulary.pairs.get, vocabulary.fits
    for start in range(n):
        before = last[start] << 20
        for end in range(start + 1, n + 1):  # all tokens that begin here; longer ones only while their bytes begin a token
            step = walk(data[start:end])
            if step is None:
                break
            if step > 1 and last[end] < 0:
                token = (step >> 1) - 1
                if start == 0:
                    last[end] = token
                else:
                    known = pairs(before | token)
                    if fits(before >> 20, token) if known is None else known:
                        last[end] = token
            if not step & 1:
                break
    out, end = [], n
    while end:
        out.append(last[end])
        end -= len(vocabulary.token[out[-1]])
    return out[::-1]


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """``encode_piece`` of many pieces (none empty), side by side; ids as little-endian unsigned 32-bit integers.

    First all tokens that begin at each byte are found along the trie.  Then, for one place of the pieces after
    another, the tokens that begin there are tried behind the last token before that place.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    x = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(sizes)
    first = ends - sizes
    stop, place = np.repeat(ends, sizes), np.arange(len(x)) - np.repeat(first, sizes)
    at, node, depth = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    starts, lasts, tokens = [], [], []
    while len(at):
        key = node << 8 | x[at + depth]
        i = np.minimum(np.searchsorted(vocabulary.edges, key), len(vocabulary.edges) - 1)
        hit = vocabulary.edges[i] == key
        at, node = at[hit], vocabulary.target[i[hit]]
        token = vocabulary.node_token[node]
        is_token = token >= 0
        starts.append(at[is_token]), lasts.append(at[is_token] + depth), tokens.append(token[is_token])
        depth += 1
        on = vocabulary.node_open[node] & (at + depth < stop[at])
        at, node = at[on], node[on]
    start, end, token = (np.concatenate(c) for c in (starts, lasts, tokens))
    order = np.argsort(place[start], kind="stable")
    start, end, token = start[order], end[order], token[order]
    edges = np.searchsorted(place[start], np.arange(int(sizes.max()) + 1))
    last = np.full(len(x), -1, np.int64)   # the last token of the prefix that ends with each byte
    last[end[:edges[1]]] = token[:edges[1]]
    for a, b in zip(edges[1:-1].tolist(), edges[2:].tolist()):
        open_ = np.flatnonzero(last[end[a:b]] < 0) + a
        fits = open_[vocabulary.fit(last[start[open_] - 1] << 20 | token[open_])]
        last[end[fits]] = token[fits]
    piece, at = np.arange(len(pieces)), ends - 1
    owners, found = [], []
    while len(piece):
        token = last[at]
        if (token < 0).any():
            raise ValueError("a byte has no token")
        owners.append(piece), found.append(token)
        at = at - vocabulary.size[token]
        on = at >= first[piece]
        piece, at = piece[on], at[on]
    owner, ids = np.concatenate(owners[::-1]), np.concatenate(found[::-1])  # the last tokens were found first
    order = np.argsort(owner, kind="stable")
    data, cuts = ids[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
    return [data[a:b] for a, b in zip([0, *cuts], cuts)]


class Encoder:
    """Texts to ids and back; pieces come from the pattern."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern)
        self._young: dict[str, bytes] = {}   # a full generation becomes the old one; pieces met again move on
        self._old: dict[str, bytes] = {}

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces.findall(text) for text in texts]
        if len(self._young) >= CACHE:
            self._old, self._young = self._young, {}
        known, old = self._young, self._old
        new, long = [], {}
        for piece in {p for pieces in cut for p in pieces if p not in known}:
            if piece in old:
                known[piece] = old[piece]
            elif len(piece) <= CACHED_CHARS:
                new.append(piece)
            elif piece:
                long[piece] = np.array(encode_piece(self.vocabulary, piece.encode()), "<u4").tobytes()
        new = [p for p in new if p]
        if new:
            known.update(zip(new, encode_pieces(self.vocabulary, [p.encode() for p in new])))
        if not long:
            return [b"".join([known[p] for p in pieces]) for pieces in cut]
        return [b"".join([known[p] if p in known else long[p] for p in pieces]) for pieces in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_texts([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(Vocabulary.load(path), pattern)
    return _encoders[path, pattern]


def _encode(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            columns = list(batch.columns)
            n, hashes, back, ids_out = [], [], [], []
            for ids in own.encode_texts([text or "" for text in batch.column("text").to_pylist()]):
                n.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if keep_ids:
                    ids_out.append(np.frombuffer(ids, "<u4").astype(np.int32))
            names = list(batch.schema.names)
            columns += [pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            names += ["n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def tokenize(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int).

    ``path``: the ranks, a file that every executor has; ``pattern``: cuts a
    text into pieces that are encoded separately; special tokens are ordinary
    text.  A null or empty text has no ids.  Texts of any length are encoded
    whole, one row at a time.  Columns of ``docs`` with one of the new names are
    replaced.  An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    own = docs.drop(*(c for c in docs.columns if c.lower() in new)).withColumn("text", F.col("text").cast("string"))
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*own.schema.fields, *(T.StructField(name, kinds.get(name, T.StringType())) for name in new)])
    return own.mapInArrow(_encode(path, pattern, keep_ids), schema)


def decode_ids(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``decoded`` (binary): the bytes of the array column ``ids`` (null: null)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, "")
        for batch in batches:
            out = [None if ids is None else own.decode(np.array(ids, "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    base = docs.drop("decoded")
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("decoded", T.BinaryType())]))
