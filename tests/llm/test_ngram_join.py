import random
import re

import pytest

from spendlens.llm import ngram_join as J

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def shingles(text):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1:]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                i, j = sorted((root(a), root(b)))
                up[j] = i
    return sorted(((i, len(s), root(i)) for i, s in sets))


def joined(spark, rows):
    got = J.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None)


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(own))
    return out


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  Two"), (6, "one two three"), (7, "a b c d e f g h i j"),
            (8, "A b c d e f g h i j"), (None, "a b c d e f g h i j"), (9, "a a a a a a"), (10, "a a a a a"), (11, "É é"), (12, "é é"),
            (13, "x" * 50_000), (14, "x" * 50_000), (7, "a b c d e f g h i j")]
    got = joined(spark, rows)
    assert got == brute(rows)
    assert (2, 0, 2) in got and (5, 1, 4) in got and (8, 6, 7) in got and (10, 1, 9) in got and (12, 1, 12) in got
    lone = J.ngram_jaccard_join(spark.createDataFrame([(None, "a b")], SCHEMA)).collect()
    assert [tuple(r) for r in lone] == [(None, 1, None, None)]


def test_empty_table_and_clashing_columns(spark):
    assert J.ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c", 5, "r"), (2, "a b c", 6, "s")], SCHEMA + ", n long, rep string")
    assert [r.component_id for r in J.ngram_jaccard_join(docs).orderBy("doc_id").collect()] == [1, 1]
    assert [tuple(r) for r in J.keep_one(docs).collect()] == [(1, "a b c", 5, "r")]


@pytest.mark.parametrize("light,block,seed", [(16, 512, 1), (2, 7, 2), (1, 3, 3)])
def test_against_brute_force(spark, monkeypatch, light, block, seed):
    monkeypatch.setattr(J, "LIGHT", light)
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(seed)
    texts = [t for n, w, e in ((25, 60, 4), (20, 40, 9), (6, 300, 20), (15, 12, 2)) for t in family(rng, n, w, e)]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(60))) for _ in range(30)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts + texts[:5])]
    assert joined(spark, rows) == brute(rows)


def test_rows_with_one_id_are_one_document(spark):
    rows = [(5, "a b c d e f"), (7, "a b c d e f"), (5, "k l m n o p"), (9, "k l m n o p"), (3, "k l m n o p")]
    got = J.ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component_id for r in got} == {3}


def test_keep_one(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "z"), (3, "z"), (4, None), (4, ""), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in J.keep_one(docs).collect()), key=repr)
    assert got == sorted([(1, "a b c d e f"), (3, "z"), (4, None), (4, ""), (None, "a b c d e f")], key=repr)


def test_trie_and_batch_search_agree():
    import numpy as np
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(10, 30))), np.uint64) for _ in range(60)]
    raw = [s.astype(">u8").tobytes() for s in sets]
    tree = J.Trie([(r, len(s), i) for i, (r, s) in enumerate(zip(raw, sets))])
    J.measure(tree, {i: 0 for i in range(len(sets))})
    sizes = np.array([len(s) for s in sets])
    linked = set()

    def visit(j, overlaps):
        for i in np.flatnonzero(overlaps >= [J._needed(int(n), len(sets[j]), (80, 100)) for n in sizes]):
            linked.add((int(i), j))

    J.batch_search(tree, sets, sizes, np.zeros(len(sets), int), (80, 100), visit)
    exact = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets)
             if len(set(x) & set(y)) >= J._needed(len(x), len(y), (80, 100))}
    assert linked == exact
    for i, s in enumerate(sets):
        assert {j for a, j in exact if a == i} <= set(tree.search(s[:max(1, len(s) // 2)], len(s), (80, 100)))
