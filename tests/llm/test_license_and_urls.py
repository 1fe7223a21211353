import re

import pytest

from spendlens.llm import license_scan as L
from spendlens.llm import url_filter as U

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans(L.UPPER, L.LOWER)


def scan(text):
    text = (text or "").translate(LOWER)
    w = re.findall(WORD, text)
    at, base = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += here
        base |= {label} if here else set()
    t, of = L.CONTAINMENT
    best, labels = 0.0, set(base)
    for line in text.split("\n"):
        own = set(re.findall(WORD, line))
        for _, label, words in L.template_table():
            if of * len(own & set(words)) >= t * len(words):
                labels.add(label)
                best = max(best, len(own & set(words)) / len(words))
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 if base else best)


TEXTS = [None, "", "...", "cc by", "CC-BY cc by cc", "by cc by cc by", "General  Public\nLicense", "all rights reservedx all rights reserved",
         "Licensed under the Apache License, Version 2.0.\nmore", "words before. Released under the MIT License.", "Released under the\nMIT License",
         "licensed under the gnu general public license version 3 this work is", "é cc by É", "a " * 4000 + "all rights reserved " + "b " * 4000,
         "K all rights reserved", "Released under the BSD License all rights reserved cc by general public license"]


def test_license_scan_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "cc by"), (None, "cc by")]
    got = L.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    have = sorted(((r.doc_id, *(r[c] for c in names)) for r in got), key=repr)
    assert have == sorted(((i, *scan(t)) for i, t in rows), key=repr)


def test_license_scan_empty_and_clashing(spark):
    assert L.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "cc by", "x", 3)], "doc_id long, text string, label string, template int")
    assert L.license_scan(docs).first().base_labels == "cc-by"
    assert L.license_scan(docs, templates={}, phrases={}).first().labels == ""


PAGES = [
    (1, "https://a.org/x", '<head><link rel="canonical" href="https://b.com/y"></head>'),
    (2, "https://b.com/y#f", "<meta content='0; url=/z' http-equiv=Refresh>"),
    (3, "https://b.com/z", "<link href=\"http://s.bad.net/q?a=1&amp;b=2\" rel=canonical>"),
    (4, "http://s.bad.net/q?a=1&b=2", None), (5, None, "x"), (6, "nourl", ""),
    (7, "https://c.com/1", '<link rel="canonical" href="https://D.com/2"><!-- <link rel="canonical" href="https://s.bad.net/q"> -->'),
    (8, "https://d.com/2", '<script>"<link rel=canonical href=http://z.net/>"</script>'),
    (9, "https://e.com/1", '<link rel="canonical" href="https://f.net/2">'),
    (10, "https://f.net/2", '<link rel="canonical" href="https://g.org/fr/2">'), (11, "https://e.com/1#x", ""),
    (12, "https://X.example.NET/en/a?b#c", ""), (12, "https://X.example.NET/en/a?b#c", ""), (None, "http://net/", ""),
    (13, "http://example.com?de/", ""), (14, "http://h.org/fr/#/de", ""), (15, "http://[bad", '<link rel=canonical href="http://[x">'),
]
VERDICTS = {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block",
            11: "allow", 12: "allow", None: "block", 13: "allow", 14: "allow", 15: "allow"}


def test_url_filter(spark):
    got = U.judge_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: r.verdict for r in got} == VERDICTS
    by = {r.page_id: r for r in got}
    assert (by[12].host, by[12].path, by[12].rule) == ("x.example.net", "/en/a", "example.net/en/")
    assert (by[5].host, by[5].path, by[5].rule) == ("", "", None) and (by[6].host, by[6].path) == ("", "")
    assert (by[13].host, by[13].path, by[13].rule) == ("example.com", "", None)
    assert by[1].alias_class == by[4].alias_class and by[5].alias_class is None
    assert by[14].rule == "org/fr/" and by[10].rule == "net/"


def test_aliases_against_brute_force(spark):
    import random
    rng = random.Random(2)
    urls = [f"http://h{i}.{rng.choice(['net', 'com', 'org'])}/{rng.choice(['fr', 'en'])}/" for i in range(120)]
    edges = [(rng.choice(urls), rng.choice(urls)) for _ in range(90)] + [(urls[0], u) for u in urls[100:]]
    pages = [(i, u, "") for i, u in enumerate(urls)]
    got = U.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"),
                       edges=spark.createDataFrame(edges, "a string, b string")).collect()
    near = {u: {u} for u in urls}
    for a, b in edges:
        whole = near[a] | near[b]
        for u in whole:
            near[u] = whole
    own = lambda u: "block" if u.split("/")[2].endswith(".net") else "allow" if ".org/fr/" in u else None
    for r in got:
        kinds = {own(u) for u in near[urls[r.page_id]]}
        expected = own(urls[r.page_id]) or ("allow" if "allow" in kinds else "block" if "block" in kinds else "allow")
        assert r.verdict == expected


def test_url_filter_empty_and_rules(spark):
    schema = "page_id long, url string, html string, host int, class string, node string"
    assert U.judge_urls(spark.createDataFrame([], schema)).count() == 0
    page = spark.createDataFrame([(1, "http://a.b.net/x/y", "", 1, "c", "n")], schema)
    assert U.judge_urls(page, rules=(("block", "net/"), ("allow", "b.net/x/"))).first().verdict == "allow"
    assert U.judge_urls(page, rules=(("block", "net/x/"), ("allow", "net/x/"))).first().verdict == "allow"


@pytest.mark.parametrize("html,found", [
    ('<LINK REL="alternate canonical" HREF=" /a b ">', ["http://h.org/a b"]), ("<link rel=canonical>", []), ("<link rel=canonical href='#x'>", []),
    ('<meta http-equiv="refresh" content="5">', []), ('<meta http-equiv=refresh content="5;URL=\'q\'">', ["http://h.org/p/q"]),
    ("<link rel=canonical href=mailto:x>", []), ("<link rel=canonical href=//o.net/z>", ["http://o.net/z"])])
def test_alias_targets(html, found):
    assert U.alias_targets("http://h.org/p/i", html) == found
