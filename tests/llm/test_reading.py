"""Periodic runs, SentencePiece ids and ranked search against brute force, the library and plain sums."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from costweave.llm import pieces, ranked, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [None, "", " ", "\n\t", "a", "é ü x", "the " * 400, "ab " * 30 + "cd " * 40, "x" * 30_000, "\x00 \x0b\x0c a\r\nb"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def all_runs(words, least=24, times=3):
    """Every period tried at every place."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((i, n, q) for (i, n), q in found.items())


def collapsed(words, found):
    gone = {k for i, n, q in found for k in range(i + q, i + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_runs_are_those_of_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(300):
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 130))]
        for _ in range(rng.randint(0, 3) if len(words) > 10 else 0):
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 3))
            for i in range(a, rng.randint(a, len(words))):
                words[i] = words[a + (i - a) % p]
        least = rng.choice([4, 8, 24])
        assert runs.find_runs(np.array(words, np.int64), least) == all_runs(words, least)


def test_runs_of_long_periodic_words():
    assert runs.find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert runs.find_runs(np.arange(200_000) % 977) == [(0, 200_000, 977)]


def test_op11_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = [*ODD, *(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 300))) for _ in range(120))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "the " * 50, "y"), (3, "again", "z"), (3, "again", "z")]
    monkeypatch.setattr(runs, "BLOCK_WORDS", 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = [tuple(r) for r in runs.run_digests(runs.made_periodic(docs)).collect()]
    want = []
    for doc_id, text, _ in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = all_runs(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        want.append((
            doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(collapsed(words, found)),
        ))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 5


def test_runs_of_no_rows(spark):
    assert runs.run_digests(runs.made_periodic(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.model_path())


def test_pieces_are_the_librarys(library):
    rng, table = random.Random(2), pieces.PrefixTable(pieces.model_path())
    signs = [" ", "  ", "\n", "\t", "a", "b", "the", "tion", "er", "▁", "é", "中", "ñ", "\x00", "1", "99", "<s>", "</s>", "<0x0A>", "😀", "----", "    "]
    vocabulary = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(3000)]
    texts += [t for t in ODD if t is not None] + [" " * 100, "-" * 500, "ab" * 3000]
    ids = [np.frombuffer(raw, np.int32).tolist() for raw in table.encode(texts, 2)]
    assert ids == library.encode(texts, add_eos=True)
    assert table.decode(ids) == library.decode(ids)


def test_op12_against_the_library(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, "Hello  wörld.\nNext ▁ line"])] + [(None, "b c", "y"), (1, "b c", "z"), (1, "b c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, pieces.piece_digests(docs).collect()), key=str) == sorted(want, key=str)
    encoded = pieces.encode_pieces(docs)
    assert {(r.doc_id, r.decoded) for r in pieces.decode_pieces(encoded).collect()} == {
        (i, library.decode(library.encode(t or ""))) for i, t, _ in rows
    }
    assert pieces.piece_digests(docs.where("false")).collect() == []


def plain_search(items, docs, k=10):
    terms = lambda t: TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(doc_id, Counter(terms(t))) for doc_id, t in docs]
    n_docs, words = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    holding = Counter(t for _, c in counted for t in c)
    answers = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + (75 * c.total() * n_docs) // words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            scored.append((-score, doc_id is None, doc_id or 0))
        best = sorted(s for s in scored if s[0] < 0)[:k]
        answers += [(item_id, r + 1, None if missing else doc_id, -score) for r, (score, missing, doc_id) in enumerate(best)]
    return answers


@pytest.mark.parametrize("shard", [7, 100_000])
def test_op13_against_plain_sums(spark, monkeypatch, shard):
    rng = random.Random(shard)
    words = [f"w{k}" for k in range(60)] + ["É", "naïve", "A1", "a1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: " ".join(rng.choices(words, weights, k=n)).replace("w3 ", "W3-")
    docs = [(i, text(rng.randint(1, 80))) for i in range(300)] + [(i, "w1 w2 w3") for i in range(400, 430)]
    docs += [(None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), *((500 + i, t) for i, t in enumerate(ODD))]
    items = [(i, text(rng.randint(1, 25))) for i in range(25)] + [(0, None), (1, ""), (2, "unknown"), (None, "w1"), (3, "w1 w2 w3"), (3, "w1 w2 w3")]
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard)
    monkeypatch.setattr(ranked, "FIRST_READ", 2)
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 600)
    got = ranked.search(
        spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, number int"),
        spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int"),
    )
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")
    ]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_search(items, docs), key=str)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, doc_id long, text string")
    some = spark.createDataFrame([(1, 1, "a b")], "item_id long, doc_id long, text string")
    assert ranked.search(none, some).collect() == []
    assert ranked.search(some, none).collect() == []
    assert [tuple(r) for r in ranked.search(some, some).collect()] == plain_search([(1, "a b")], [(1, "a b")])
