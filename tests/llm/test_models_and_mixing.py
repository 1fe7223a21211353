import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spendlens.llm import components, embedding_dedup, html_extract, mixing, toxicity, words

DOCS = "doc_id long, text string, lang string"


# -- toxicity ---------------------------------------------------------------------------------------


def corpus(n=1200, seed=1):
    rng = random.Random(seed)
    bad = {"en": ["vilex", "grossy"], "de": ["boesew", "uebelt"]}
    docs, labels = [], []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        own = [f"{lang}{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                own[rng.randrange(len(own))] = rng.choice(bad[lang]) + (rng.choice("abcdef") if lang == "de" else "")
        docs.append((i, " ".join(own), lang))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = corpus()
    got = toxicity.toxicity_report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    hits = sum(r.toxic for r in held if truth[r.doc_id])
    alarms = sum(r.toxic for r in held if not truth[r.doc_id])
    assert hits >= 0.9 * sum(truth[r.doc_id] for r in held) and alarms <= 0.03 * len(held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    d = spark.createDataFrame(docs, DOCS)
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity_report(d, spark.createDataFrame(x, schema)).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (1, 1)], "doc_id long, toxic int")
    rows = [(1, None, None), (2, "", "en"), (2, "x " * 20_000, "xx"), (None, "a", "en"), (None, "...", None)]
    docs = spark.createDataFrame(rows, DOCS + "")
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
    wide = spark.createDataFrame([(1, "a b", "s", 0.5)], "doc_id long, text string, _row string, score double")
    assert [tuple(r) for r in toxicity.keep_clean(wide, labels).collect()] in ([], [(1, "a b", "s", 0.5)])


def test_max_pooling_ends_with_the_row():
    m = toxicity.train(*toxicity.word_ids(pa.array(["a b c", "d", "", "a d"])), np.array([1, 0, 0, 1]))
    whole = m.score(*toxicity.word_ids(pa.array(["a b c", "", "d e", "a"])))
    alone = [m.score(*toxicity.word_ids(pa.array([t])))[0] for t in ("a b c", "", "d e", "a")]
    assert whole == pytest.approx(alone, abs=1e-6)


def test_best_threshold():
    table = np.zeros((100, 2))
    table[90], table[10] = (10, 0), (0, 1000)
    assert 0.1 < toxicity.best_threshold(table, 0.01) <= 0.9
    assert toxicity.best_threshold(np.zeros((100, 2)), 0.01) is None


def test_words_of_a_batch():
    w = words.Words(pa.array(["Ab c", None, "", " x\ty ", "z"]).slice(0, 5))
    assert np.diff(w.bounds).tolist() == [2, 0, 0, 2, 1]
    h = w.hashes()
    again = words.Words(pa.array(["q", "aB", "z"])).hashes()
    assert h[0] == again[1] and h[-1] == again[2] and len(set(h.tolist())) == 5


def test_toxicity_repeated_ids_and_many_languages(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        bad = i % 2
        docs += [(i, " ".join(rng.choice(["foul", "vile"] if bad else ["nice", "calm"]) for _ in range(8)), f"l{i % 90}" if i % 3 else None)] * (1 + 40 * (i == 7))
        labels.append((i, bad))
    own = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = toxicity.toxicity_report(own, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs) and {r.threshold is None for r in got} == {False}
    assert len({(r.score, r.threshold) for r in got if r.doc_id == 7}) == 1
    assert all(r.toxic == bool(r.doc_id % 2) for r in got)


# -- embeddings and components -----------------------------------------------------------------------


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    vectors = [b for b in base] + [base[k % 4] + 0.06 * rng.normal(size=16) for k in range(160)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, []), (904, [1.0, None]), (905, rows[0][1][:8]), (None, rows[0][1])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), recall=0.99999).collect()
    assert len(got) == len(rows) + len(odd)
    x = np.stack(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    comp = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([comp[i], *(comp[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(x))]
        if new == comp:
            break
        comp = new
    by = {r.vec_id: r for r in got}
    assert sum(by[i].n_links for i in range(len(x))) >= 0.999 * linked.sum()
    assert all(by[i].n_links <= linked[i].sum() for i in range(len(x)))
    assert [by[i].component_id for i in range(len(x))] == comp
    assert all(by[i].n_links == 0 and by[i].kept and by[i].component_id == i for i, _ in odd if i is not None)
    assert by[None].kept and by[None].component_id is None
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_at_production_parameters(spark):
    """Floats, with the parameters of the query: nearly every link is found, and none that isn't one."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1000, 24))
    x = np.concatenate([base, base[:400] + 0.2 * rng.normal(size=(400, 24)), np.repeat(base[:2], 300, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [float("inf")] * 24)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = (unit @ unit.T >= embedding_dedup.COSINE) & ~np.eye(len(x), dtype=bool)
    counts = np.array([got[i].n_links for i in range(len(x))])
    assert linked.sum() > 180_000 and (counts <= linked.sum(axis=1)).all()
    assert counts.sum() >= 0.99 * linked.sum()
    single = linked[:, :1400].sum(axis=1)[1000:1400] > 0   # the pairs that aren't copies
    assert (counts[1000:1400][single] > 0).mean() >= 0.99
    assert got[5000].n_links == got[5001].n_links == 0 and len(got) == len(rows)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)]
    edges += [(5000, i) for i in range(5001, 5200)] + [(None, 1), (7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            whole = near.get(a, {a}) | near.get(b, {b})
            for x in whole:
                near[x] = whole
    assert got == {x: min(c) for x, c in near.items() if min(c) != x}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- html ----------------------------------------------------------------------------------------------

ARTICLES = [[f"Title number {i}", *(f"Sentence {j} of article {i}, which goes on for a while and ends here." for j in range(6)), f"Short {i}"] for i in range(30)]


def plain_page(i):
    body = "".join(f"<p>{t}</p>" for t in ARTICLES[i])
    return (f"<html><head><title>T{i}</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
            f'<div class="ad">Buy this thing now.</div><article>{body}</article><footer>&copy; site {i}</footer></body></html>')


def test_extraction_on_marked_and_made_pages(spark):
    pages = [(i, f"u{i}", plain_page(i)) for i in range(30)] + [(100, None, None), (101, "u", ""), (1, "u1", plain_page(1))]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == ("\n".join(ARTICLES[r.page_id]) if r.page_id < 100 else "") and r.n_chars == len(r.text)
    empty = html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string, text int"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_held_out_layouts():
    chain = html_extract.fit_pages([plain_page(i) for i in range(20)])
    right = total = 0
    for blocks, labels in html_extract.layouts(ARTICLES[20:], 150, seed=99):
        right += sum(a == b for a, b in zip(chain.decode(blocks), labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_against_all_labellings():
    from itertools import product
    rng = random.Random(1)
    chain = html_extract.Chain()
    chain.start, chain.end, chain.move = np.array([.3, -.2]), np.array([-.1, .4]), np.array([[.5, -.6], [-.3, .7]])
    chain.weights = {f"f{i}": rng.uniform(-2, 2) for i in range(8)}
    for _ in range(40):
        blocks = [("x", rng.sample([*chain.weights, "unknown"], 3)) for _ in range(rng.randint(1, 7))]

        def value(y):
            s = chain.start[y[0]] + chain.end[y[-1]] + sum(chain.move[a, b] for a, b in zip(y, y[1:]))
            return s + sum(sum(chain.weights.get(f, 0) for f in fs) for (_, fs), k in zip(blocks, y) if k)

        assert value(chain.decode(blocks)) == pytest.approx(max(map(value, product((0, 1), repeat=len(blocks)))))


def test_leaf_blocks():
    texts = lambda h: [t for t, _ in html_extract.leaf_blocks(h)]
    assert texts("<p>a<b>b</b>\n c&nbsp;&amp;&lt;d<p>e<br>f<!-- g --><style>p{}</style></div>h") == ["ab c &<d", "e f", "h"]
    assert texts("<p>a <b>b</p><p>c") == ["a b", "c"]
    assert texts("<ul><li>a<li>b</ul><script>x</p>") == ["a", "b"]
    assert texts("a < b <3 &#233; &bogus; <") == ["a < b <3 é &bogus; <"]
    assert texts("") == [] and texts("<<<>>>") != [""]
    assert len(texts("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1


# -- mixing ----------------------------------------------------------------------------------------------


def test_rake_meets_marginals():
    rng = np.random.default_rng(0)
    goals = [rng.dirichlet(np.ones(k)) for k in (4, 3, 2)]
    fitted, left = mixing.rake(rng.random((4, 3, 2)), goals)
    assert left < 1e-9
    for i, goal in enumerate(goals):
        assert fitted.sum(axis=tuple(j for j in range(3) if j != i)) == pytest.approx(goal)


def test_calibrated_probabilities():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 1000, (5, 3, 2)).astype(float)
    goals = [rng.dirichlet(np.ones(k)) for k in tokens.shape]
    p, _, _ = mixing.calibrate(tokens, goals, 0.3 * tokens.sum())
    assert (p >= 0).all() and (p <= 1).all()
    assert (p * tokens).sum() == pytest.approx(0.3 * tokens.sum(), rel=0.02)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 300), rng.choice(["en", "en", "en", "de", "xx", None]), "src0" if rng.random() < 0.4 else f"src{rng.randrange(25)}")
            for i in range(3000)] + [(5000, None, "en", "src1"), (5001, "", None, None), (7, "w", "en", "src1"), (None, "w w", "en", "src0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 and r.sampled == (r.draw < r.probability) for r in got)
    total = sum(r.n_tokens for r in got)
    assert sum(r.n_tokens * r.probability for r in got) == pytest.approx(mixing.BUDGET * total, rel=0.02)
    taken = sum(r.n_tokens for r in got if r.sampled)
    assert taken == pytest.approx(mixing.BUDGET * total, rel=0.1)
    assert sorted(((r.doc_id, r.text) for r in mixing.sample(docs).collect()), key=repr) == sorted(
        ((r.doc_id, t) for r, (_, t, _, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)),
                                                 sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, len((x[1] or "").split())))) if r.sampled), key=repr)
    assert mixing.mix_report(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "a", 5, "t", "x")], "doc_id long, text string, n_tokens int, topic string, _cell string")
    assert len(mixing.mix_report(odd).collect()) == 1
    assert [c for c in mixing.sample(odd).columns] == odd.columns
