import random
from collections import Counter

import numpy as np
import pytest

from spendlens.llm import ngram_join as J
from test_ngram_join import SCHEMA, brute, family, shingles


def counted(rows):
    """Links of each row: (doc_id, set) pairs that link with its own, by comparing all of them."""
    units = {(i, shingles(t)) for i, t in rows if i is not None}
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    return [0 if i is None else sum(near(s, y) for j, y in units if (j, y) != (i, s)) for i, s in ((i, shingles(t)) for i, t in rows)]


@pytest.mark.parametrize("block,at_once", [(512, 4096), (7, 16), (3, 4096)])
def test_link_counts_against_brute_force(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "KEYS_AT_ONCE", at_once)
    rng = random.Random(block)
    texts = [t for n, w, e in ((60, 60, 3), (20, 40, 9), (15, 12, 2)) for t in family(rng, n, w, e)]
    rows = list(enumerate(texts + texts[:5])) + [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (None, texts[0])]
    rows += [(0, texts[0]), (0, texts[1]), (40, texts[2]), (904, texts[61]), (904, texts[63])]
    got = J.ngram_jaccard_links(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = counted(rows)
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in got) == Counter(
        (i, len(shingles(t)), c) for (i, t), c in zip(rows, expected))
    assert max(expected) > 10


def test_link_counts_keep_the_components(spark):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 25, 60, 4) + family(rng, 4, 30, 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = J.ngram_jaccard_links(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert [r.n_links for r in got if r.doc_id >= 25] == [3] * 4
    assert J.ngram_jaccard_links(docs.limit(0)).count() == 0


def test_overlaps():
    rng = random.Random(1)
    sets = [set(rng.sample(range(50), rng.randint(1, 20))) for _ in range(12)]
    keys = [np.array(sorted(s), np.uint64) for s in sets]
    left, right = np.arange(5), np.arange(3, 12)
    assert J.overlaps(keys, left, right).tolist() == [[len(sets[i] & sets[j]) for j in right] for i in left]
