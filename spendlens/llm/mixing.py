"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  The token weights of
the cells are raked: scaled in turn to the target share of every source,
language and topic, until all three marginals hold.  Documents are then sampled
with calibrated probabilities: a cell's probability is its raked share of the
token budget over its tokens; a cell whose probability would pass 1 is taken
whole, and the rest is raked again over the other cells.

Sources, languages and topics without a target are pooled, so the cell table
has a size fixed by the parameters and is fitted on the driver; documents stay
distributed, are counted with partial aggregation, and are drawn by a hash, so
a run can be repeated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.store import cut

OTHER = "other"
BUDGET = 0.4            #: share of all tokens that the sample should have
SEED = 17
ROUNDS, CLOSE = 500, 1e-9

#: Production targets: shares of the sampled tokens; they are scaled to 1 over the values that occur.
TARGETS = {
    "source": {"src0": 0.15, OTHER: 0.05} | {f"src{i}": 0.8 / 19 for i in range(1, 20)},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.15, "es": 0.12, OTHER: 0.01},
    "topic": {"note": 0.05, "prose": 0.6, "report": 0.25, "listing": 0.05, OTHER: 0.05},
}

WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, n_tokens: Column) -> Column:
    """Kind of a text by its shape: listing (rows of cells), note (short), report (long), prose, other (no words)."""
    cells = F.length(text) - F.length(F.regexp_replace(text, r"[|\t]", ""))
    return (F.when(n_tokens == 0, OTHER).when(20 * cells > n_tokens, "listing").when(n_tokens < 100, "note")
            .when(n_tokens >= 800, "report").otherwise("prose"))


def _pooled(column: Column, targets: dict[str, float]) -> Column:
    return F.when(column.isin(*[k for k in targets if k != OTHER]), column).otherwise(F.lit(OTHER))


def with_cells(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS) -> DataFrame:
    """``docs`` with a struct column ``_cell``: n_tokens (words) and the pooled source, lang and topic."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # words = places where a word character follows the start or white space
    n = F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[^x]+", "")).cast("long")
    own = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    counted = docs.withColumn("_n", n)
    topic = own("topic") if "topic" in docs.columns else topic_of(text, F.col("_n"))
    return counted.withColumn("_cell", F.struct(
        F.col("_n").alias("n_tokens"), _pooled(own("source"), targets["source"]).alias("source"),
        _pooled(own("lang"), targets["lang"]).alias("lang"), _pooled(topic, targets["topic"]).alias("topic"))).drop("_n")


def rake(weights: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Iterative proportional fitting of an array to target sums along each of its axes.

    Zero cells stay zero.  Returns the fitted array and the largest absolute
    difference left in any marginal; targets that no table with these zeros can
    meet leave a difference.
    """
    fitted, left = weights.astype(float), np.inf
    others = [tuple(j for j in range(fitted.ndim) if j != i) for i in range(fitted.ndim)]
    for _ in range(rounds):
        for i, target in enumerate(targets):
            now = fitted.sum(axis=others[i])
            scale = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            fitted *= scale.reshape([-1 if j == i else 1 for j in range(fitted.ndim)])
        left = max(float(np.abs(fitted.sum(axis=others[i]) - t).max(initial=0)) for i, t in enumerate(targets))
        if left <= close:
            break
    return fitted, left


def calibrate(tokens: np.ndarray, targets: list[np.ndarray], budget: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(probabilities, raked shares without the bound of 1, marginal difference) of the cells for a budget in tokens.

    Cells whose raked tokens pass what they have are taken whole; what is left
    of the targets is raked over the other cells, until none passes.
    """
    shares, left = rake(tokens / max(tokens.sum(), 1e-300), targets)
    whole = np.zeros(tokens.shape, bool)
    wanted = shares * budget
    while (over := (wanted > tokens * (1 + 1e-12)) & ~whole).any():
        whole |= over
        fixed = tokens * whole
        total = max(0.0, budget - fixed.sum())
        rest = []
        for i, target in enumerate(targets):
            others = tuple(j for j in range(tokens.ndim) if j != i)
            open_cells = (tokens * ~whole).sum(axis=others) > 0
            goal = np.maximum(target * budget - fixed.sum(axis=others), 0) * open_cells
            rest.append(goal * (total / goal.sum()) if goal.sum() > 0 else goal)
        wanted = np.where(whole, tokens, rake(tokens * ~whole, rest, close=CLOSE * max(budget, 1.0))[0])
    p = np.divide(wanted, tokens, out=np.zeros(tokens.shape), where=tokens > 0)
    return np.minimum(p, 1.0), shares, left


class Mixture:
    """Fitted cells: (source, lang, topic) -> probability, raked share and weight of a token."""

    def __init__(self, cells: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET):
        axes = ["source", "lang", "topic"]
        names = [sorted({*targets[a], OTHER}) for a in axes]
        tokens = np.zeros([len(n) for n in names])
        summed = cells.groupBy(*axes).agg(F.sum("n_tokens").alias("n"))
        for row in summed.collect():  # one row for each cell of the target table at most
            tokens[tuple(n.index(row[a]) for a, n in zip(axes, names))] = row["n"] or 0
        goals = []
        for i, (a, own) in enumerate(zip(axes, names)):
            there = tokens.sum(axis=tuple(j for j in range(3) if j != i)) > 0
            goal = np.array([targets[a].get(x, 0.0) for x in own]) * there
            goals.append(goal / goal.sum() if goal.sum() > 0 else goal)
        self.axes, self.names, self.goals, self.tokens = axes, names, goals, tokens
        self.p, self.shares, self.difference = calibrate(tokens, goals, budget * tokens.sum())

    def table(self) -> list[tuple[str, str, str, float, float]]:
        """(source, lang, topic, probability, weight) of cells with tokens; weight: raked share over observed share."""
        total = self.tokens.sum()
        return [(*(n[i] for n, i in zip(self.names, at)), float(self.p[at]), float(self.shares[at] * total / self.tokens[at]))
                for at in zip(*np.nonzero(self.tokens))]


def unit_interval(seed: int, *columns: Column) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _draw(seed: int) -> Column:
    return unit_interval(seed, F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def _fitted(celled: DataFrame, mixture: Mixture) -> DataFrame:
    """``celled`` with ``_p`` (its cell's probability) and ``_w`` (the weight of its tokens)."""
    schema = "source string, lang string, topic string, _p double, _w double"
    fitted = celled.sparkSession.createDataFrame(mixture.table(), schema)
    fitted = fitted.select(F.struct("source", "lang", "topic").alias("_key"), "_p", "_w")
    key = F.struct(F.col("_cell.source").alias("source"), F.col("_cell.lang").alias("lang"), F.col("_cell.topic").alias("topic"))
    # the cell table's size is fixed by the targets, so it is broadcast
    return celled.withColumn("_key", key).join(F.broadcast(fitted), "_key", "left").drop("_key")


def mix_report(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET,
               seed: int = SEED) -> DataFrame:
    """A row for each row of ``docs``: its cell, n_tokens, weight, probability, draw and whether it is sampled.

    ``docs``: doc_id, text and, if known, source, lang and topic (without a topic
    column the text's shape is its topic).  Nulls and values without a target
    are pooled as "other".  A text without words has no tokens to weigh: if its
    cell has tokens it is drawn like the cell, else its probability is 0.
    Repeated rows are drawn alike.  An empty table gives an empty result.
    """
    own = [c for c in ("source", "lang", "topic") if c in docs.columns]
    celled = with_cells(docs.select("doc_id", "text", *own), targets)
    narrow = cut(celled.select("doc_id", "_cell", _draw(seed).alias("_u")), "cells")
    mixture = Mixture(narrow.select("_cell.*"), targets, budget)
    drawn = _fitted(narrow, mixture)
    p = F.coalesce("_p", F.lit(0.0))
    return drawn.select("doc_id", "_cell.source", "_cell.lang", "_cell.topic", "_cell.n_tokens",
                        F.coalesce("_w", F.lit(0.0)).alias("weight"), p.alias("probability"),
                        F.col("_u").alias("draw"), (F.col("_u") < p).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET,
           seed: int = SEED) -> DataFrame:
    """The sampled rows of ``docs``, with its columns; texts are not shuffled."""
    own = [c for c in ("source", "lang", "topic") if c in docs.columns]
    celled = with_cells(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", *own), targets)
    mixture = Mixture(celled.select("_cell.*"), targets, budget)
    return _fitted(celled, mixture).filter(_draw(seed) < F.coalesce("_p", F.lit(0.0))).select("_row.*")
