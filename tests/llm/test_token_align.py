import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendlens.llm import token_align as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"
ODD = ["a", " ", "  ", "\n", " \n x", "x\n  y\n", "tab\t tab ", "a  b   c", "é", "日本語 text", "\U00013080 \U0001F600\U0001F600z", "ź é",
       "<|endoftext|> <s> </s> <unk> <0x41>", "a\x00b \x7f﻿c", "    　 q", "foo  bar\x1c baz", "1234567 89,0", "don't WON'T 'll",
       "퟿�", "x" * 500, "=" * 70 + " " * 70 + "end", "“quoted” — text…", "\r\n\r\n  indented", " leading", "trailing  ", "ﬁ ﬃ ½ Ⅷ"]
NONE = [None, "", "a▁b", "▁", "x ▁ y"]


def byte_level():
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [c for c in range(256) if c not in own]
    return {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(rest)}


class Plain:
    """Whole texts, token by token."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.table = byte_level()

    def tokens(self, text):
        if not text:
            return None
        a = [(i, bytes(self.table[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode())
             for i in self.b.encode(text)]
        whole = f" {text}".encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None

    def ends(self, tokens):
        out, at = [], 0
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    def result(self, rows):
        docs, counts = [], Counter()
        for doc, text in rows:
            found = self.tokens(text)
            if found is None:
                docs.append((doc, 0, 0, [], ""))
                continue
            a, b = map(self.ends, found)
            links = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e]
            cuts = sorted({e for *_, e in a} & {e for *_, e in b})
            groups, low = [], 0
            for cut in cuts:
                groups.append("|".join(",".join(str(i) for i, s, e in t if low <= s and e <= cut) for t in (a, b)))
                low = cut
            counts.update(links)
            docs.append((doc, len(a), len(b), links, ";".join(groups)))
        top = defaultdict(int)
        for (_, y), n in counts.items():
            top[y] = max(top[y], n)
        return Counter((doc, n_a, n_b, g.count(";") + 1 if g else 0, len(links), sum(counts[x] == top[x[1]] for x in links),
                        sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
                       for doc, n_a, n_b, links, g in docs), counts


@pytest.fixture(scope="module")
def plain():
    return Plain()


def got(docs):
    return Counter(tuple(r) for r in T.Alignment(docs, A, B).documents().collect())


def rows_of(rng):
    words = ["the", "über", "naïve,", "x1.", "\n", "日本", "don't", "  ", "Token", "\U0001F600", "▁", "co-op"]
    rows = [(i, t) for i, t in enumerate(ODD + NONE)] + [(i, " ".join(rng.choices(words[:-2], k=rng.randint(1, 12)))) for i in range(100, 160)]
    return rows + rows[:30] + [(None, "no id"), (None, None), (7, ODD[3]), (900, " ".join(rng.choices(words, k=40)))]


@pytest.mark.parametrize("block,part,at_once,joined", [(1 << 25, 1 << 23, 1 << 19, 1 << 14), (60, 50, 40, 9), (1, 400, 1, 1)])
def test_against_whole_texts(spark, plain, monkeypatch, block, part, at_once, joined):
    """Also with blocks, parts and slices of a few bytes."""
    for name, value in (("BLOCK_CHARS", block), ("PART_BYTES", part), ("AT_ONCE", at_once), ("JOINED", joined)):
        monkeypatch.setattr(T, name, value)
    rows = rows_of(random.Random(block))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected, counts = plain.result(rows)
    assert got(docs) == expected
    pairs = {(r.a_id, r.b_id): (r.n, r.best) for r in T.Alignment(docs, A, B).pairs().collect()}
    assert {k: n for k, (n, _) in pairs.items()} == counts
    assert all(best == (n == max(m for (_, b), m in counts.items() if b == k[1])) for k, (n, best) in pairs.items())


def test_documents_of_the_tables(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").filter("length(text) < 3000")
    rows = [tuple(r) for r in docs.collect()]
    assert got(docs) == plain.result(rows)[0]


def test_words_make_up_the_text_and_tokens_stop_at_them(plain):
    rng = random.Random(2)
    chars = "ab .\n\t 　é日\x1c\x85'1"
    pair = T.pair_of(A, B)
    assert pair.plain
    for text in ODD + ["".join(rng.choices(chars, k=rng.randint(1, 30))) for _ in range(3000)]:
        words = T.split_words(text)
        assert "".join(" " + w for w in words) == " " + text
        whole = plain.tokens(text)
        for k in range(2):
            assert [i for w in words for i, _ in plain.tokens(w)[k]] == [i for i, _ in whole[k]] if all(words) else True
        if all(words):
            edges = set(np.cumsum([len(w.encode()) + 1 for w in words]).tolist())
            assert all(edges <= {e for *_, e in plain.ends(t)} for t in whole)


def test_spans_are_refined_inside_characters():
    pair = T.pair_of(A, B)
    text = " é\U00013080 “x”\n日"
    data = text.encode()
    for ids, ends, table in ((*pair.encode_a(text, data), pair.bytes_a), (*pair.encode_b(text[1:], len(data)), pair.bytes_b)):
        assert ends.tolist() == np.cumsum([len(table[i]) for i in ids]).tolist() and ends[-1] == len(data)
    with pytest.raises(ValueError):
        T.refine(np.array([2, 5]), np.array([True, True]), np.array([2, 2]))


def test_groups_are_kept_if_asked_for(spark):
    r = T.Alignment(spark.createDataFrame([(1, "Hello, wörld")], SCHEMA), A, B).documents(keep_groups=True).first()
    assert hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256
    assert r.groups.count(";") + 1 == r.n_groups and r.n_links == r.n_a + r.n_b - r.n_groups


def test_empty_tables_and_other_columns(spark, plain):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.Alignment(empty, A, B).documents().collect() == [] and T.Alignment(empty, A, B).pairs().collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "▁")], SCHEMA)
    assert got(nothing) == plain.result([(1, None), (2, "▁")])[0]
    rows = [(1, "one two"), (2, "two three two")]
    more = spark.createDataFrame(rows, SCHEMA).withColumns({"block": F.lit("b"), "KIND": F.lit(9), "data": F.lit(None), "n": F.lit(1)})
    assert got(more) == plain.result(rows)[0]


def test_long_text(spark, plain):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(3000)) + " " + "y" * 20_000
    found = T.Alignment(spark.createDataFrame([(1, text)], SCHEMA), A, B).documents().first()
    a, b = plain.tokens(text)
    assert (found.n_a, found.n_b) == (len(a), len(b))
