import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from spendlens.llm import bpe, warc

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = st.sampled_from(["ab", "aaa", "the", "ing", " ", "  ", "é", "ß", "\n", "0", "12", "###", "!!", "thth", "x", "日本", "😀", "'s", "\u0307",
                         "llll", "<|endoftext|>", "\x00"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=40).map("".join) | st.text(max_size=60))
def test_same_ids_as_tiktoken(own, theirs, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=80, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=30).map("".join), st.data())
def test_appends_and_edits_are_exact(own, text, data):
    raw = text.encode()
    cut = data.draw(st.integers(0, len(raw)))
    table = bpe.PrefixEncoder(own.vocabulary, raw[:cut])
    table.append(raw[cut:])
    assert table.ids() == bpe.encode_piece(own.vocabulary, raw)
    a = data.draw(st.integers(0, len(raw)))
    b = data.draw(st.integers(a, len(raw)))
    new = data.draw(PARTS).encode()
    table.replace(a, b, new)
    edited = raw[:a] + new + raw[b:]
    assert table.data == edited and table.ids() == (bpe.encode_piece(own.vocabulary, edited) if edited else [])


def test_an_edit_in_a_long_text_is_local(own):
    raw = ("the thing and other words " * 400).encode()
    table = bpe.PrefixEncoder(own.vocabulary, raw)
    done = table.replace(100, 103, b"xyz")
    assert done < 400 and table.ids() == bpe.encode_piece(own.vocabulary, raw[:100] + b"xyz" + raw[103:])


def test_tokenize(spark, own, theirs):
    rows = [(1, "Hello  world's 日本\n\n x", "a"), (2, None, None), (3, "", "b"), (1, "Hello", "c"), (None, "a" * 30_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.tokenize(docs, PATH, P.PATTERN, keep_ids=True)
    found = got.collect()
    assert len(found) == 5
    for r in found:
        ids = theirs.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode_ids(got, PATH).collect())
    assert bpe.tokenize(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    for _ in range(300):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        order = list(warc.LoserTree(runs))
        assert [runs[r][i] for r, i in order] == sorted(sum(runs, []))
        assert order == sorted(order, key=lambda x: (runs[x[0]][x[1]], x))


BIG = "x" * 1200
PAGES = [(1, "https://a.org/x", BIG), (2, "https://a.org/x", BIG), (3, None, BIG), (4, "http://b.c/\r\nq", "é\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"),
         (5, "u", None), (6, "u", ""), (None, "https://a.org/x", BIG), (3, None, BIG), (7, "z://[bad", "é" * 600), (8, "http://q", "é" * 600),
         (9, "http://s", "y" * 999), (10, "http://s", "y" * 999), (11, "http://t", "z" * 200_000)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.capture_index(pages).orderBy("range", "place").collect()
    assert len(got) == len(PAGES)
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)
    expected = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        last = max((p for p, _, h in PAGES if p is not None and (h or "") == (html or "")), default=None)
        again = page is not None and len(raw) >= 1000 and page != last
        expected.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(expected, key=repr)
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_ranges_follow_the_entries(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_RECORDS", 25)
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/" if i % 2 else "http://hot.org/", f"p{i}") for i in range(300)],
                                  "page_id long, url string, html string").repartition(4)
    got = warc.capture_index(pages).orderBy("range", "place").collect()
    sizes = [sum(r.range == k for r in got) for k in range(12)]
    assert sum(sizes) == 300 and max(sizes) <= 75 and sum(s > 0 for s in sizes) >= 8
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert keys == sorted(keys)


def test_records_are_found_by_their_index(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i % 7}", f"page {i} " * 50) for i in range(60)], "page_id long, url string, html string").repartition(3)
    folder = warc.write_archives(pages, str(tmp_path / "w"), file_records=9)
    files = list((tmp_path / "w").glob("*.gz"))
    assert len(files) >= 7
    import gzip
    for r in warc.read_runs(spark, folder).collect():
        raw = gzip.decompress(next(f for f in files if f.name == r.archive).read_bytes())
        block = raw[r.offset:r.offset + r.length]
        assert block.startswith(b"WARC/1.1\r\n") and block.endswith(f"page {r.page_id} ".encode() * 50)


def test_damaged_archives_are_errors():
    import gzip
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    assert len(list(warc.records([whole, whole]))) == 2
    assert [r[0] for r in warc.records(warc._inflate(gzip.compress(whole) + gzip.compress(whole)))] == [0, len(whole)]
    for bad in (whole[:-6], whole[:20], b"x" + whole):
        with pytest.raises(ValueError):
            list(warc.records([bad]))
    with pytest.raises(ValueError):
        list(warc._inflate(gzip.compress(whole)[:-4]))
    head = {"warc-type": "response", "warc-payload-digest": "sha1:" + "0" * 40}
    with pytest.raises(ValueError):
        warc.entry(0, 1, head, b"x")


def test_pieces_side_by_side_equal_single_ones_and_caches_turn_over(monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "PAIRS", 300)
    monkeypatch.setattr(bpe, "CACHED_CHARS", 12)
    own = bpe.Encoder(bpe.Vocabulary.load(PATH), P.PATTERN)
    texts = ["".join(rng.choices("abeinorst Aéß日\n.,1'", k=rng.randint(0, 60))) for _ in range(300)]
    for i in range(0, 300, 20):
        for text, ids in zip(texts[i:i + 20], own.encode_texts(texts[i:i + 20])):
            assert np.frombuffer(ids, "<u4").tolist() == [n for p in own.pieces.findall(text) for n in bpe.encode_piece(own.vocabulary, p.encode())]
            assert own.decode(ids) == text.encode()
    assert len(own._young) < 50 + 20 * 60 and own._old
    assert own.encode_texts(texts[:20]) == own.encode_texts(texts[:20])
