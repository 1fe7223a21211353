"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects documents whose measure lies above a cutoff.  Which cutoff
of a fixed grid a rule may use in a stratum is decided on labelled documents:
among the distinct texts labelled good there, k of n would be rejected, and the
exact binomial (Clopper-Pearson) test must show that the share of good texts
rejected is at most ``RISK / rules``: P(Bin(n, RISK / rules) <= k) <= level.
Grids are fixed in advance and tested from the loosest cutoff to the tightest,
stopping at the first that fails, so a stratum's rule needs one level; levels
are split over all strata and rules (Bonferroni).  With probability at least
1 - ERROR, all rules together reject at most RISK of the good texts of every
stratum.  A rule without enough evidence in a stratum rejects nothing there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.store import cut

RISK = 0.05             #: share of a stratum's good texts that may be rejected
ERROR = 0.05            #: chance that any stratum exceeds it
MIN_WORDS = 50          #: base: documents with fewer words fail
MAX_REPEATED = 50       #: base: documents with more than this percentage of words in repeated windows fail
STRATA = ("en", "de", "fr", "es")  #: languages with thresholds of their own; all others are one stratum
OTHER = "other"

#: Cutoffs of each rule from loose to tight; a document fails where its measure is above the cutoff.
GRIDS = {
    "symbol_share": [1.0, 0.5, 0.25, 0.1, 0.05],        # symbols for each word
    "duplicate_line_share": [0.9, 0.7, 0.5, 0.35],      # of the lines with a word
    "repeated_share": [0.45, 0.4, 0.35, 0.3],           # of the words, in repeated 3-word windows
    "capital_share": [0.5, 0.35, 0.25],                 # upper-case characters for each character of words
}

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _let(value: Column, use) -> Column:
    """use(x) with x bound once to ``value``: lambdas over x don't compute it again."""
    return F.transform(F.array(value), use)[0]


def _repeated_words(w: Column) -> Column:
    """Words of the array that lie in a 3-word window found at least twice."""
    n = F.size(w)

    def covered(at: Column) -> Column:
        # starts of repeated windows, ascending: each adds its words up to the next start, three at most
        return F.aggregate(
            at, F.struct(F.lit(0).alias("words"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct((acc["words"] + F.least(F.lit(3), p - acc["last"])).alias("words"), p.alias("last")),
            lambda acc: acc["words"])

    def repeated(s: Column) -> Column:
        # s: (window, start) in order; a window is repeated where it equals a neighbour
        same = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                        | (F.get(s, i + 1)["h"] == x["h"]))
        return _let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    return F.when(n >= 3, _let(F.sort_array(windows), repeated)).otherwise(F.lit(0))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``_q`` of the counts and shares of each whole text (null: no words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def counts(w: Column) -> Column:
        n = F.size(w)
        chars = F.length(F.array_join(w, ""))
        symbols = F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", ""))
        capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
        duplicate = _let(lines, lambda own: F.struct(
            F.size(own).alias("n"), (F.size(own) - F.size(F.array_distinct(own))).alias("dup")))
        return F.struct(n.cast("long").alias("n_words"), chars.cast("long").alias("word_chars"),
                        symbols.cast("long").alias("n_symbols"), duplicate.alias("lines"),
                        _repeated_words(w).cast("long").alias("n_repeat_words"), capitals.cast("long").alias("capitals"))

    words = F.filter(F.split(text, SPACES), lambda x: x != "")
    out = docs.withColumn("_m", _let(words, counts))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    m = F.col("_m")
    return out.withColumn("_q", F.struct(
        m["n_words"], m["word_chars"], m["n_symbols"], m["lines"]["dup"].cast("long").alias("n_dup_lines"),
        m["n_repeat_words"],
        ((m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])).alias("base_failed"),
        share(m["n_symbols"], m["n_words"]).alias("symbol_share"),
        share(m["lines"]["dup"], m["lines"]["n"]).alias("duplicate_line_share"),
        share(m["n_repeat_words"], m["n_words"]).alias("repeated_share"),
        share(m["capitals"], m["word_chars"]).alias("capital_share"))).drop("_m")


def stratum(lang: Column, strata: tuple[str, ...] = STRATA) -> Column:
    return F.when(lang.isin(*strata), lang).otherwise(F.lit(OTHER))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Exact P(Bin(n, p) <= k); 1 where k is at or above the mean (such k never pass a test).

    The largest term comes from a sum of logarithms, the others from it by their ratios.
    """
    log_top = F.aggregate(F.sequence(F.lit(1).cast("long"), k), k * F.lit(p).cast("double") * 0.0,
                          lambda acc, j: acc + F.log((n - j + 1) / j))
    log_top = F.when(k > 0, log_top).otherwise(F.lit(0.0)) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    ratios = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct((acc["total"] + acc["term"]).alias("total"),
                                (acc["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term")),
        lambda acc: acc["total"])
    return F.when(k < n * p, F.exp(log_top) * ratios).otherwise(F.lit(1.0))


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR,
               strata: tuple[str, ...] = STRATA) -> DataFrame:
    """(stratum, rule, cutoff, n, k, p_value): the tightest certified cutoff of each stratum's rules.

    ``measured``: doc_id, lang, fingerprint (of the text) and the measures;
    ``labels``: doc_id, quality (1 good, 0 bad).  A text counts once in a
    stratum, as good if any of its labels says so.  At most one row for each
    stratum and rule, whatever the input's size.
    """
    good = (labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct())
    units = (measured.join(good, "doc_id", "left_semi").filter(~F.col("base_failed"))
             .groupBy(stratum(F.col("lang"), strata).alias("stratum"), "fingerprint")
             .agg(*(F.first(r).alias(r) for r in GRIDS)))
    above = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, grid in GRIDS.items() for i, c in enumerate(grid)]
    counted = units.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above)
    tests = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"),
                               F.col(f"{r}_{i}").alias("k")) for r, grid in GRIDS.items() for i, c in enumerate(grid)))
    tested = counted.select("stratum", "n", F.inline(tests))
    level = error / (len(GRIDS) * (len(strata) + 1))
    tested = tested.withColumn("p_value", binomial_tail(F.col("n"), F.col("k"), risk / len(GRIDS)))
    # k grows as cutoffs tighten, so those that pass are the first of a grid
    return (tested.filter(F.col("p_value") <= level).groupBy("stratum", "rule")
            .agg(F.max_by(F.struct("cutoff", "n", "k", "p_value"), "step").alias("t"))
            .select("stratum", "rule", "t.*"))


def judged(measured: DataFrame, found: DataFrame, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """``measured`` with ``kept`` and ``failed_rules``."""
    own = stratum(F.col("lang"), strata)
    cutoffs: dict[str, list] = {rule: [] for rule in GRIDS}
    for row in found.collect():  # at most one row for each stratum and rule
        cutoffs[row["rule"]].append((row["stratum"], row["cutoff"]))
    fails = []
    for rule, own_cutoffs in cutoffs.items():
        for name, cutoff in own_cutoffs:
            fails.append(F.when((own == name) & (F.col(rule) > cutoff), F.lit(rule)))
    return (measured.withColumn("failed_rules", F.concat_ws(",", *fails) if fails else F.lit(""))
            .withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")))


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang")


def _narrow(docs: DataFrame) -> DataFrame:
    return (measures(docs.select("doc_id", _lang(docs), "text"))
            .select("doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"), "_q.*"))


def quality_report(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """A row for each row of ``docs``: its counts, base_failed, failed_rules and kept.

    ``docs``: doc_id, text and, if known, lang; other columns are ignored.  A
    null or empty text has no words and fails the base.  Repeated rows are
    judged alike.  A null or unknown language belongs to the stratum "other".
    Labels of unknown documents, null labels and repeated labels are harmless;
    without labels only the base decides.
    """
    measured = cut(_narrow(docs), "measures")
    return judged(measured, thresholds(measured, labels, risk, error)).drop("fingerprint")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``; texts are measured once and not shuffled."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", _lang(docs))
    measured = cut(measures(own).select("_row", "doc_id", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("fingerprint"),
                                        "_q.base_failed", *(f"_q.{rule}" for rule in GRIDS)), "measured")
    found = thresholds(measured.drop("_row"), labels, risk, error)
    return judged(measured, found).filter("kept").select("_row.*")
