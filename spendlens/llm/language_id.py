"""Languages of a document as a mixture, found by expectation-maximisation.

Each language is a model of the byte n-grams of its words: the chance of a byte
after the two before it, from counts over all learning documents, backed off to
one byte and none.  A word's likelihood under a language is the product of its
n-grams' chances.

A document is a mixture: every word comes from one language, and the shares of
the languages are estimated by expectation-maximisation.  The set of languages
grows in order of their shares for as long as the likelihood gains more than a
penalty that grows with the logarithm of the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.store import ship
from spendlens.llm.words import LOWER, NOT_ALNUM, buffer_of, slices

HELD_OUT = 2        #: documents whose crc32(doc_id as text) mod 4 is this teach nothing
LANGUAGES = 64      #: the languages with most learning documents are learned, at most so many: bounds the model
PENALTY = 2.0       #: times log(1 + words): what another language has to gain in log-likelihood
PRIOR = 0.5         #: weight of the languages' shares of the learning documents, in words
ROUNDS = 40         #: of expectation-maximisation; a document stops before if its shares move by less than SETTLED
SETTLED = 1e-4
BACKOFF = 4.0       #: weight of the shorter n-gram's chance, in occurrences
UNKNOWN = "und"

TWO, THREE = 1 << 16, 1 << 17   #: counters of two bytes (exact) and of three (hashed)
SPACE = 0x20
_TO = np.where(NOT_ALNUM, SPACE, LOWER).astype(np.uint8)  # anything but letters separates
_TO[0x30:0x3A] = SPACE


class Grams:
    """The n-grams of a string column: one position for each letter of a word and one for its end."""

    def __init__(self, column: pa.Array):
        raw, offsets = buffer_of(column)
        rows = len(offsets) - 1
        x = np.full(len(raw) + rows + 2, SPACE, np.uint8)   # a separator before, between and after rows
        place = np.arange(2, len(raw) + 2) + np.repeat(np.arange(rows), np.diff(offsets))
        x[place] = _TO[raw]
        letter = x != SPACE
        at = np.flatnonzero(letter[2:] | letter[1:-1]) + 2   # letters and the separators behind them
        self.first = ~letter[at - 1]                          # the position begins a word
        self.two = (x[at - 1].astype(np.int64) << 8) | x[at]
        before = np.where(self.first, SPACE, x[at - 2]).astype(np.int64)
        self.context = (before << 8) | x[at - 1]
        mixed = (((before << 16) | self.two) * 0x9E3779B1) & 0xFFFFFFFF
        self.three = np.where(self.first, THREE, mixed >> 15)   # a word's first byte has no three bytes of its own
        starts = np.flatnonzero(self.first)
        self.words = starts                                    # first position of each word
        self.row = np.searchsorted(offsets + np.arange(rows + 1) + 2, at[starts], "right") - 1   # row of each word

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Counters of the n-grams in the words of the rows marked: TWO of two bytes, then THREE of three."""
        inside = np.repeat(rows[self.row], np.diff(np.append(self.words, len(self.two))))
        return np.concatenate([np.bincount(self.two[inside], minlength=TWO), np.bincount(self.three[inside], minlength=THREE + 1)[:THREE]])


@dataclass
class Model:
    """``names`` of the languages, their ``shares`` of the learning documents, and their n-gram tables."""

    names: list[str]
    shares: np.ndarray    # languages
    chance: np.ndarray    # TWO x languages: of a byte after the one before it, times BACKOFF
    seen: np.ndarray      # THREE + 1 x languages: occurrences; the last row, for first bytes, is 0
    scale: np.ndarray     # TWO x languages: 1 / (occurrences of the two bytes before + BACKOFF); two separators never occur

    @classmethod
    def of(cls, names: list[str], documents: np.ndarray, counts: np.ndarray) -> Model:
        """``counts``: languages x (TWO + THREE)."""
        two = counts[:, :TWO].reshape(len(names), 256, 256).astype(np.float64)
        one = (two.sum(axis=1) + 1) / (two.sum(axis=(1, 2)) + 256)[:, None]
        chance = (two + BACKOFF * one[:, None, :]) / (two.sum(axis=2) + BACKOFF)[:, :, None]
        flat = lambda a: np.ascontiguousarray(a.reshape(len(names), int(np.prod(a.shape[1:]))).T.astype(np.float32))
        shares = documents / max(documents.sum(), 1)
        seen = np.concatenate([counts[:, TWO:], np.zeros((len(names), 1))], axis=1)
        return cls(names, shares, flat(chance) * np.float32(BACKOFF), flat(seen), flat(1 / (two + BACKOFF)))

    def word_likelihoods(self, grams: Grams) -> np.ndarray:
        """Log-likelihood of each word under each language (words x languages)."""
        out = np.zeros((len(grams.words), len(self.names)), np.float32)
        step = max(1, (1 << 18) // max(len(self.names), 1))  # positions at once: bounds the floats held
        ends = np.append(grams.words, len(grams.two))
        at = 0
        while at < len(grams.words):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + step, "right")) - 1)
            here = slice(ends[at], ends[stop])
            p = self.chance.take(grams.two[here], axis=0)
            p += self.seen.take(grams.three[here], axis=0)
            p *= self.scale.take(grams.context[here], axis=0)
            out[at:stop] = np.add.reduceat(np.log(p, out=p), ends[at:stop] - ends[at], axis=0)
            at = stop
        return out


def mixture(likelihood: np.ndarray, bounds: np.ndarray, start: np.ndarray, prior: np.ndarray,
            rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document's components and its log-likelihood, by expectation-maximisation.

    ``likelihood``: words x components (each word's largest may be scaled to
    1); ``bounds``: the documents' first words, none empty; ``start``, ``prior``:
    documents x components, the prior in words.
    """
    shares, total = start.copy(), np.zeros(len(start))
    live = np.arange(len(start))
    own, first = likelihood, bounds[:-1]
    sizes = np.diff(bounds)
    for _ in range(rounds):
        n = sizes[live]
        joint = own * np.repeat(shares[live], n, axis=0).astype(np.float32)
        word = joint.sum(axis=1)
        total[live] = np.add.reduceat(np.log(word), first, dtype=np.float64)
        joint /= word[:, None]
        new = np.add.reduceat(joint, first, axis=0).astype(np.float64) + prior[live]
        new /= new.sum(axis=1, keepdims=True)
        moves = np.abs(new - shares[live]).max(axis=1) >= SETTLED
        shares[live] = new
        if not moves.all():
            own = own[np.repeat(moves, n)]
            live = live[moves]
            if not len(live):
                break
            first = np.concatenate([[0], np.cumsum(sizes[live])[:-1]])
    return shares, total


def languages_of(model: Model, likelihood: np.ndarray, bounds: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """For each document (all have words): shares of all languages when all compete, and shares within the set selected."""
    docs, k = len(bounds) - 1, len(model.names)
    sizes = np.diff(bounds)
    scaled = np.exp(likelihood - likelihood.max(axis=1, keepdims=True))
    np.maximum(scaled, np.float32(1e-30), out=scaled)
    prior = np.broadcast_to(PRIOR * model.shares, (docs, k))
    open_, _ = mixture(scaled, bounds, np.full((docs, k), 1 / k), prior)
    order = np.argsort(-open_, axis=1, kind="stable")
    chosen = np.zeros((docs, k))
    chosen[np.arange(docs), order[:, 0]] = 1
    word_doc = np.repeat(np.arange(docs), sizes)
    best = np.add.reduceat(np.log(scaled[np.arange(len(scaled)), order[word_doc, 0]]), bounds[:-1], dtype=np.float64)
    live = np.arange(docs)
    for size in range(2, k + 1):
        words = np.isin(word_doc, live) if len(live) < docs else np.ones(len(scaled), bool)
        own = np.take_along_axis(scaled[words], order[word_doc[words], :size], axis=1)
        edges = np.concatenate([[0], np.cumsum(sizes[live])])
        start = np.take_along_axis(open_[live], order[live, :size], axis=1) + 1e-6
        start /= start.sum(axis=1, keepdims=True)
        shares, total = mixture(own, edges, start, np.take_along_axis(prior[live], order[live, :size], axis=1))
        gains = total - best[live] > penalty * np.log1p(sizes[live])
        live = live[gains]
        if not len(live):
            break
        best[live] = total[gains]
        chosen[live] = 0
        np.put_along_axis(chosen, order[:, :size], np.where(np.isin(np.arange(docs), live)[:, None], _spread(docs, live, shares[gains]),
                                                            np.take_along_axis(chosen, order[:, :size], axis=1)), axis=1)
    return open_, chosen


def _spread(docs: int, live: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((docs, values.shape[1]))
    out[live] = values
    return out


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def learn(docs: DataFrame, languages: int = LANGUAGES) -> Model:
    """N-gram counts of each language over all documents with text and lang outside the fold HELD_OUT.

    The ``languages`` with most such documents are learned (ties by name).  Counts
    are added up in each task first; the driver gets at most ``languages`` x
    (TWO + THREE) counters.
    """
    spark = docs.sparkSession
    ship(spark)
    known = (docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id")) != HELD_OUT)
             .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    top = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    names = sorted(r["lang"] for r in top)
    size = {r["lang"]: r["count"] for r in top}
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, "text")):
            langs = np.array([number.get(v, -1) for v in batch.column("lang").to_pylist()])
            grams = Grams(batch.column("text"))
            for i in set(langs.tolist()) - {-1}:
                own = grams.counts(langs == i)
                found[i] = found[i] + own if i in found else own
        for i, own in found.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(own[at])],
                                             ["language", "gram", "n"])

    counted = known.mapInArrow(count, "language int, gram int, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), TWO + THREE), np.int64)
    counts[counted.column("language").to_numpy(), counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    return Model.of(names, np.array([size[name] for name in names], np.float64), counts)


def language_mixtures(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``docs`` with lang_pred, score, languages (array, largest share first) and shares (array of double) in place of text.

    ``lang_pred`` has the largest share in the selected set; ``score`` is its
    share when all learned languages compete.  A text that is null or has no
    letter, and any text if nothing was learned, gets ``und``, 0 and empty arrays.
    Texts of any length are read whole; columns of ``docs`` with one of the new
    names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)   # at most LANGUAGES x (2 * TWO + THREE) floats
    new = ["lang_pred", "score", "languages", "shares"]
    own = docs.drop(*(c for c in docs.columns if c.lower() in new)).withColumn(
        "text", F.when(F.col("text").cast("string").rlike(r"\p{L}"), F.col("text").cast("string")))
    out = own.drop("text").select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                                  F.array().cast("array<string>").alias("languages"), F.array().cast("array<double>").alias("shares"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.names, UNKNOWN], object)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            at = batch.schema.get_field_index("text")
            rows = batch.num_rows
            pred, score = np.full(rows, len(m.names)), np.zeros(rows)
            sets: list[list[str]] = [[] for _ in range(rows)]
            shares: list[list[float]] = [[] for _ in range(rows)]
            grams = Grams(batch.column(at))
            if len(grams.words) and m.names:
                full, first = np.unique(grams.row, return_index=True)
                open_, chosen = languages_of(m, m.word_likelihoods(grams), np.append(first, len(grams.row)), penalty)
                pred[full] = chosen.argmax(axis=1)
                score[full] = open_[np.arange(len(full)), pred[full]]
                ranked = np.argsort(-chosen, axis=1, kind="stable")
                for row, order, own_shares in zip(full.tolist(), ranked, chosen):
                    order = order[:np.count_nonzero(own_shares)]
                    sets[row], shares[row] = [m.names[i] for i in order], own_shares[order].tolist()
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in rest), pa.array(names[pred], pa.string()), pa.array(np.clip(score, 0, 1)),
                 pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                [*(batch.schema.names[i] for i in rest), *new])

    return own.mapInArrow(run, out.schema)


def language_report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, shares) for each row of ``docs`` (doc_id, text, lang).

    Repeated rows are predicted alike (and count each when learning); a null
    doc_id is held out of learning, ``held_out`` false; null lang teaches nothing.
    An empty table gives an empty result.
    """
    model = learn(docs.select("doc_id", "text", "lang"))
    found = language_mixtures(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
                        "lang_pred", "score", "languages", "shares")
