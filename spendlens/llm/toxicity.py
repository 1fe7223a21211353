"""Toxicity by a convolutional text classifier, trained in numpy.

Words are lower-cased runs of letters and digits.  A word's embedding is the
sum of hashed vectors of the whole word and of its first bytes, so inflected
and compound forms of a word share a part.  Filters of several widths slide
over the words; each filter's largest response in the text, and a logistic
layer over them, give the score.

Training uses a bounded sample of labelled documents on the driver
(``SAMPLE`` texts of at most ``SAMPLE_CHARS`` characters); scoring runs on the
executors over whole texts, batch by batch.  Thresholds by language come from
labelled documents that training didn't see: the threshold with the best F1
among those with at most ``FALSE_ALARMS`` of the clean documents above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.store import cut, release, ship
from spendlens.llm.words import NOT_ALNUM, Words, forget_powers, slices

PREDICT = 0.3           #: score from which the fixed prediction is 1
HELD_OUT = 2            #: rows whose crc32(doc_id as text) mod 4 is this teach nothing
CALIBRATE = 3           #: remainder of the labelled rows that set thresholds and don't train
SAMPLE = 6000           #: labelled documents to train on, at most
SAMPLE_CHARS = 20_000   #: longer texts aren't drawn for training
FALSE_ALARMS = 0.01     #: share of a language's clean documents above its threshold
SEED = 5

BUCKETS = 1 << 15       #: rows of each hashed embedding table
DIM = 6
WIDTHS = (1, 2, 3)
FILTERS = 6             #: of each width
PIECES = (None, 5, 4)   #: whole word, first 5 bytes, first 4 bytes


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word in each table (words x tables), and each row's first word (rows + 1 bounds)."""
    found = Words(column, NOT_ALNUM)
    ids = [(found.hashes(k) >> np.uint64(40)).astype(np.int64) % BUCKETS for k in PIECES]
    return np.stack(ids, axis=1).astype(np.int32), found.bounds


@dataclass
class Model:
    tables: list[np.ndarray] = field(default_factory=list)    # one for each piece: BUCKETS x DIM
    filters: list[np.ndarray] = field(default_factory=list)   # one for each width: width x DIM x FILTERS
    bias: list[np.ndarray] = field(default_factory=list)      # one for each width: FILTERS
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out_bias: float = 0.0

    def embed(self, ids: np.ndarray) -> np.ndarray:
        return sum(t[ids[:, k]] for k, t in enumerate(self.tables))

    def responses(self, e: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """For each width, each filter's response at each word; windows past a row's end see zeros there."""
        n = len(e)
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)   # words to the row's end
        out = []
        for f, b in zip(self.filters, self.bias):
            r = e @ f[0] + b
            for k in range(1, len(f)):
                if n > k:
                    shifted = e[k:] @ f[k]
                    shifted[left[:n - k] <= k] = 0
                    r[:n - k] += shifted
            out.append(r)
        return out

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows = len(bounds) - 1
        pooled = np.zeros((rows, len(self.out)), np.float32)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            e = self.embed(ids)
            for i, r in enumerate(self.responses(e, bounds)):
                pooled[full, i * FILTERS:(i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(r, bounds[full]), 0)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.out_bias, -30, 30).astype(np.float64)))


def _presence(ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each bucket of one table: how much likelier toxic texts are to hold it than clean ones."""
    rows = np.repeat(np.arange(len(labels)), np.diff(bounds))
    seen = np.unique(rows.astype(np.int64) * BUCKETS + ids)
    y, bucket = labels[seen // BUCKETS], seen % BUCKETS
    toxic = np.bincount(bucket[y == 1], minlength=BUCKETS)
    clean = np.bincount(bucket[y == 0], minlength=BUCKETS)
    a, b = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    return np.log((toxic / a + 1 / (a + b)) / (clean / b + 1 / (a + b))) * (toxic + clean > 2)


def train(ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, passes: int = 6, batch: int = 32,
          rate: float = 0.02, seed: int = SEED) -> Model:
    """Fit by Adam on logistic loss; labels are 0 or 1.

    ``passes`` over the rows, more over fewer than 3000 rows.  Without both labels the score is the constant share.
    """
    rng = np.random.default_rng(seed)
    m = Model()
    m.tables = [rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32) for _ in PIECES]
    for w in WIDTHS:
        m.filters.append(rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32))
        m.bias.append(np.zeros(FILTERS, np.float32))
    m.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    share = float(labels.mean()) if len(labels) else 0.5
    m.out_bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len(labels) == 0 or not 0 < share < 1:
        m.out[:] = 0
        return m
    for k in range(len(PIECES)):  # start from which buckets tell the labels apart; training goes on from there
        m.tables[k][:, 0] += 0.3 * np.clip(_presence(ids[:, k], bounds, labels), -1, 4)
    for f in m.filters:
        f[:, 0, :FILTERS // 2] = np.abs(f[:, 0, :FILTERS // 2]) + 0.3
    heads = np.arange(len(WIDTHS) * FILTERS) % FILTERS < FILTERS // 2
    m.out[heads] = np.abs(m.out[heads])
    dense = [*m.filters, *m.bias, m.out]
    first, second = [np.zeros_like(x) for x in dense], [np.zeros_like(x) for x in dense]
    squares = [np.full(BUCKETS, 1e-3, np.float32) for _ in m.tables]
    step = 0
    for _ in range(max(passes, min(40, 18_000 // len(labels)))):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            sizes = bounds[rows + 1] - bounds[rows]
            pick = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            own = np.concatenate([[0], np.cumsum(sizes)])
            x = ids[pick]
            e = m.embed(x)
            full = np.flatnonzero(sizes)
            pooled = np.zeros((len(rows), len(m.out)), np.float32)
            best = np.zeros((len(rows), len(m.out)), np.int64)
            responses = m.responses(e, own) if len(full) else []
            for i, r in enumerate(responses):
                for j in full:
                    block = r[own[j]:own[j + 1]]
                    top = block.argmax(axis=0)
                    best[j, i * FILTERS:(i + 1) * FILTERS] = top + own[j]
                    pooled[j, i * FILTERS:(i + 1) * FILTERS] = block[top, np.arange(FILTERS)]
            active = pooled > 0
            pooled *= active
            z = pooled @ m.out + m.out_bias
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]).astype(np.float32) / len(rows)
            grads = [np.zeros_like(v) for v in dense]
            grads[-1] = pooled.T @ d
            back = d[:, None] * m.out * active               # rows x filters of all widths
            to_words: list[np.ndarray] = []
            values: list[np.ndarray] = []
            for i, w in enumerate(WIDTHS):
                own_back = back[:, i * FILTERS:(i + 1) * FILTERS]
                grads[len(WIDTHS) + i] = own_back.sum(axis=0)
                for k in range(w):
                    here = best[:, i * FILTERS:(i + 1) * FILTERS] + k
                    inside = (here < own[1:, None]) & (own_back != 0)
                    j, f = np.nonzero(inside)
                    if len(j):
                        words, g = here[j, f], own_back[j, f]
                        np.add.at(grads[i][k].T, f, g[:, None] * e[words])
                        to_words.append(words)
                        values.append(g[:, None] * m.filters[i][k].T[f])
            step += 1
            for v, g, a, b in zip(dense, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-6)
            m.out_bias -= rate * float(d.sum())
            if to_words:
                words, g = np.concatenate(to_words), np.concatenate(values)
                for k, table in enumerate(m.tables):
                    buckets, inverse = np.unique(x[words, k], return_inverse=True)
                    total = np.zeros((len(buckets), DIM), np.float32)
                    np.add.at(total, inverse, g)
                    squares[k][buckets] += (total * total).sum(axis=1)
                    table[buckets] -= 0.05 * total / np.sqrt(squares[k][buckets])[:, None]
    return m


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled documents outside the folds HELD_OUT and CALIBRATE.

    A doc_id with several texts gives the smallest of them, so the driver gets
    at most SAMPLE texts however often rows repeat."""
    known = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL")
             .filter(~fold(F.col("doc_id")).isin(HELD_OUT, CALIBRATE))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    # a hash draws about 0.9 * SAMPLE ids, and the limit bounds them, so they are broadcast
    chance = 0.9 * SAMPLE / max(known.count(), 1)
    drawn = known.filter(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11) < int(min(chance, 1.0) * (1 << 53))).limit(SAMPLE)
    table = (docs.filter(F.length("text") <= SAMPLE_CHARS).select("doc_id", F.col("text").cast("string").alias("text"))
             .join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
             .select("doc_id", "text", "toxic").toArrow())
    table = table.sort_by("doc_id")
    ids, sizes = [np.zeros((0, len(PIECES)), np.int32)], [np.zeros(0, np.int64)]
    for part in (p for batch in table.to_batches() for p in slices(batch, "text")):
        own, bounds = word_ids(part.column("text"))
        ids.append(own)
        sizes.append(np.diff(bounds))
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    known_toxic = (table.column("toxic").to_numpy() > 0).astype(np.int64)
    words = np.concatenate(ids)
    del table, ids  # the driver holds the words' buckets only while it trains
    forget_powers()
    model = train(words, bounds, known_toxic)
    del words
    release()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` in place of its text."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # a few MB, fixed by BUCKETS and DIM
    out = docs.drop("text").withColumn("score", F.lit(0.0).cast("double"))
    own = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            at = batch.schema.get_field_index("text")
            scores = sent.value.score(*word_ids(batch.column(at)))
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(scores, pa.float64())],
                                             [*(batch.schema.names[i] for i in rest), "score"])

    return own.mapInArrow(run, out.schema)


def with_threshold(scored: DataFrame, labels: DataFrame, false_alarms: float = FALSE_ALARMS) -> DataFrame:
    """``scored`` (doc_id, lang, score, ...) with ``threshold``: its language's, from the CALIBRATE fold.

    A null language, and one without both labels, uses the threshold of all
    languages together.  Scores are counted in steps of 0.01; only the 100 steps
    of all languages come to the driver.  The languages' thresholds are a table,
    however many there are, broadcast only if Spark finds it small.
    """
    known = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold(F.col("doc_id")) == CALIBRATE)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    step = F.least(F.floor(F.col("score") * 100), F.lit(99)).cast("int").alias("step")
    counts = scored.join(known, "doc_id").groupBy("lang", step).agg(
        F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean"))
    counts = cut(counts, "steps")
    common = np.zeros((100, 2))
    for r in counts.groupBy("step").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect():
        common[r["step"]] = r["toxic"], r["clean"]
    found = best_threshold(common, false_alarms)
    own = cut(counts.filter("lang IS NOT NULL").groupBy("lang").applyInPandas(_of_language(false_alarms), "lang string, threshold double"),
              "thresholds").withColumnRenamed("lang", "_lang")
    return (scored.join(own, F.col("lang") == F.col("_lang"), "left").drop("_lang")
            .withColumn("threshold", F.coalesce("threshold", F.lit(PREDICT if found is None else found))))


def _of_language(false_alarms: float):
    def run(steps: pd.DataFrame) -> pd.DataFrame:  # at most 100 rows
        table = np.zeros((100, 2))
        table[steps["step"]] = steps[["toxic", "clean"]]
        found = best_threshold(table, false_alarms)
        return steps[["lang"]].head(0 if found is None else 1).assign(threshold=found)
    return run


def best_threshold(table: np.ndarray, false_alarms: float) -> float | None:
    """Lower end of the best step of a (100, 2) table of toxic and clean counts by score; None if no step finds any."""
    toxic, clean = table.sum(axis=0)
    if not toxic or not clean:
        return None
    hits, alarms = np.cumsum(table[::-1], axis=0)[::-1].T
    f1 = np.where(alarms <= false_alarms * clean, 2 * hits / np.maximum(hits + alarms + toxic, 1), -1.0)
    if f1.max() <= 0:
        return None
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)  # scores between two classes: the middle of the best steps
    return float(top[len(top) // 2]) / 100


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, toxic) for each row of ``docs`` (doc_id, text and, if known, lang).

    ``predicted``: score >= 0.3.  ``toxic``: score at or above the threshold of
    the document's language (of all languages, where it is null or has no labels
    of both kinds).  Null and empty texts get the score of a text without words;
    texts of any length are scored whole; repeated rows are scored alike.
    Without labels of both kinds every score is the same.  Rows without a doc_id
    are held out of training and calibration.  An empty table gives an empty result.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), _lang(docs))
    scored = cut(score(own, fit(own, labels)), "scores")
    return with_threshold(scored, labels).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"), "threshold",
        (F.col("score") >= F.col("threshold")).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't toxic by the threshold of their language, with the columns of ``docs``."""
    text = F.col("text").cast("string").alias("text")
    model = fit(docs.select("doc_id", text), labels)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", text, _lang(docs))
    scored = cut(score(packed, model), "scored")
    return with_threshold(scored, labels).filter(F.col("score") < F.col("threshold")).select("_row.*")
