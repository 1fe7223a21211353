import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from spendlens.llm import quality_rules as Q

DOCS = "doc_id long, text string, lang string"


def counts(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_counts_against_brute_force(spark):
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "a\nb\na\n\n \n", "# * $%&|<> é 😀😀", "\x0b\x0ca\x1cb c d",
             "one two three " * 40, "l1 a b\n" * 3 + "l2", "w " * 5000, " ".join(f"w{i}" for i in range(3000)), "a b c x a b c y a b"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(3, "a", "en"), (None, "a b", None)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.quality_report(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(got) == len(rows)
    have = sorted(((r.doc_id if r.doc_id is not None else -1), *tuple(r[c] for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in got)
    assert have == sorted(((i if i is not None else -1), *counts(t)) for i, t, _ in rows)
    assert all(r.kept == (not r.base_failed) for r in got)


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (600, 3, 0.0125), (2000, 10, 0.0125), (50_000, 500, 0.0125), (5, 5, 0.5), (0, 0, 0.1)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(Q.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
    exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p)
                               + (n - j) * math.log(1 - p)) for j in range(k + 1)) if k < n * p else 1.0
    assert got == pytest.approx(exact, rel=1e-9)


def clean(i):
    return " ".join(f"word{i}x{j}" for j in range(60))


def test_thresholds_need_evidence_and_reject_junk(spark):
    good = [(i, clean(i), "en") for i in range(700)]
    junk = [(1000 + i, " ".join(f"w{i}x{j}##" for j in range(60)), "en") for i in range(20)]
    few = [(2000 + i, clean(2000 + i), "de") for i in range(50)] + [(2100, " ".join(f"d{j}##" for j in range(60)), "de")]
    docs = spark.createDataFrame(good + junk + few, DOCS)
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in junk] + [(2000 + i, 1) for i in range(50)]
                                   + [(0, 1), (None, 1), (9999, 1), (5, None)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in Q.quality_report(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good)
    assert not any(kept[i] for i, _, _ in junk)
    assert kept[2100]  # 50 labelled texts prove nothing, so the rule may not reject there
    assert {r.doc_id for r in Q.keep_good(docs, labels).collect()} == {i for i, k in kept.items() if k}


def test_copies_of_a_text_count_once(spark):
    docs = spark.createDataFrame([(i, clean(0), "en") for i in range(2000)], DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(2000)], "doc_id long, quality int")
    narrow = Q._narrow(docs)
    assert Q.thresholds(narrow, labels).count() == 0


def test_empty_and_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.quality_report(spark.createDataFrame([], DOCS), labels).count() == 0
    docs = spark.createDataFrame([(1, clean(1), 3, True, "x")], "doc_id long, text string, n_words int, kept boolean, _q string")
    assert [tuple(r) for r in Q.keep_good(docs, labels).collect()] == [(1, clean(1), 3, True, "x")]
    assert Q.quality_report(docs, labels).first().n_words == 60
