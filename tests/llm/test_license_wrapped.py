import random
import re

from spendlens.llm import license_scan as L
from test_license_and_urls import LOWER, TEXTS, WORD

LONGEST = max(len(re.findall(WORD, x.translate(LOWER))) for xs in L.TEMPLATES.values() for x in xs)
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files"


def blocks(text):
    lines = [re.findall(WORD, x) for x in text.split("\n")]
    paragraph = []
    for words in [*lines, []]:
        if words:
            paragraph += words
        else:
            yield paragraph
            paragraph = []
    lines = [x for x in lines if x]
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            if sum(map(len, lines[i + 1:j])) <= LONGEST:
                yield [x for line in lines[i:j + 1] for x in line]


def scan(text):
    t, of = L.CONTAINMENT
    text, labels = (text or "").translate(LOWER), set()
    for own in map(set, blocks(text)):
        labels |= {label for _, label, words in L.template_table() if of * len(own & set(words)) >= t * len(words)}
    return labels


def test_wrapped_notices_against_brute_force(spark):
    rng = random.Random(3)
    notices = [x for xs in L.TEMPLATES.values() for x in xs]
    made = []
    for _ in range(80):
        words = rng.choice(notices).split()
        inside = "".join(x + rng.choice([" ", " ", "\n", "\n * ", "\n\n"]) for x in words)
        filler = lambda: " ".join(rng.choice(["the", "of", "license", "mit", "under", "x"]) for _ in range(rng.randrange(25)))
        made.append(f"{filler()}\n{inside}{rng.choice([' ', chr(10), chr(10) * 2])}{filler()}\n{filler()}")
    apart = "Released under the\n" + "\n".join(["filler words of a line"] * 5) + "\n\nmore\nMIT License"
    rows = list(enumerate([*TEXTS, MIT, "Released under the\n\nMIT License", apart, *made]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in L.license_scan(docs, wrapped=True).collect()}
    for i, text in rows:
        base = set(filter(None, got[i].base_labels.split(",")))
        assert set(filter(None, got[i].labels.split(","))) == base | scan(text), text
    assert "mit-text" in got[len(TEXTS)].labels and "mit" in got[len(TEXTS) + 1].labels and got[len(TEXTS) + 2].labels == ""
    assert "mit" in got[TEXTS.index("Released under the\nMIT License")].labels
