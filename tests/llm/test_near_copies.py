"""Repeated strings, Jaccard join and lattice hashing against brute force, on texts with all kinds of edges."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from costweave.llm import jaccard, lattice, shared, suffixes, textops
from costweave.session import reuse

DOCS = "doc_id long, text string, n_bytes string, component_id int"  # extra columns with names of the results


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOCS)


def repeats(texts, length):
    seen, out = set(), {}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            part = raw[s : s + length]
            if part in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(part)
        spans = sum(1 for k, m in enumerate(mark) if m and not (k and mark[k - 1]))
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out[i] = (len(raw), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def strange_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    base = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(12)]
    line = "a line that stands in very many of the texts, whatever else is there. " * 2
    texts = [None, "", " ", "x", "é" * 60, "ab" * 400, "a" * 99, "a" * 100, "a" * 101, "a" * 700, base[0], base[0]]
    for k in range(60):
        t = rng.choice(base)
        cut, end = sorted(rng.sample(range(len(t) + 1), 2))
        texts.append(rng.choice([t, t[cut:end], t[:cut] + "!" + t[cut:], line + t, t[:cut] + line + t[cut:], word() + line + word(), t[cut:] + t[:cut]]))
    return texts


def test_repeats_match_brute_force(spark):
    texts = strange_texts()
    found = suffixes.remove_repeats(docs_of(spark, texts))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == repeats(texts, 100)


@pytest.mark.parametrize("limit", [3, 40])
def test_repeats_with_many_edges_of_one_gram(spark, limit, monkeypatch):
    monkeypatch.setattr(suffixes, "EDGE_ROWS", 5)
    monkeypatch.setattr(suffixes, "HOT", 2)
    monkeypatch.setattr(suffixes, "TASK_BYTES", 4_000)
    texts = strange_texts()
    found = suffixes.remove_repeats(docs_of(spark, texts), edge_limit=limit)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == repeats(texts, 100)


def test_repeats_of_other_lengths(spark):
    texts = strange_texts()[:40]
    found = suffixes.remove_repeats(docs_of(spark, texts), length=40, gram=16)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == repeats(texts, 40)


def test_repeats_of_empty_table_and_repeated_rows(spark):
    assert suffixes.remove_repeats(docs_of(spark, [])).collect() == []
    rows = spark.createDataFrame([(1, "a" * 50), (1, "a" * 50), (None, "b" * 300), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in suffixes.remove_repeats(rows).collect()) == [(1, 50, 0), (2, 0, 0)]


def test_sampling_in_parts_equals_sampling_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.choice(np.frombuffer(b"abc ", np.uint8), 9_000)
    whole = suffixes.sampled_rows(data, np.array([0, 9_000]))
    monkeypatch.setattr(textops, "BLOCK_BYTES", 700)
    parts = suffixes.sampled_rows(data, np.array([0, 9_000]))
    order = np.argsort(parts[1])
    for a, b in zip(whole, parts):
        assert np.array_equal(a, b[order])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def grams_of(text, n):
    words = words_of(text)
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def joined(texts, n, numerator, denominator):
    sets = [grams_of(t, n) for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and denominator * both >= numerator * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return {(i, len(sets[i]), label[i]) for i in range(len(texts))}


def near_copies(seed=11, count=90):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 60))] for _ in range(8)]
    texts = [None, "", "\t\n", "one", "ONE", "one two", "One  two ", "É", "é"]
    for _ in range(count):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randint(0, 2)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
        texts.append(rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    return texts


@pytest.mark.parametrize("n,similarity", [(4, (85, 100)), (5, (80, 100)), (2, (50, 100))])
def test_join_matches_brute_force(spark, n, similarity):
    texts = near_copies()
    found = jaccard.join_similar(docs_of(spark, texts), n, similarity)
    assert {tuple(r) for r in found.collect()} == joined(texts, n, *similarity)


def test_join_of_large_clusters_in_blocks(spark, monkeypatch):
    for name, value in {"BLOCK": 4, "PIVOTS": 2, "SLICE": 8, "TASK_BYTES": 500}.items():
        monkeypatch.setattr(jaccard, name, value)
    texts = near_copies(7, 120)
    found = jaccard.join_similar(docs_of(spark, texts), 3, (60, 100))
    assert {tuple(r) for r in found.collect()} == joined(texts, 3, 60, 100)


def test_join_of_empty_table_nulls_and_kept_rows(spark):
    assert jaccard.join_similar(docs_of(spark, [])).collect() == []
    text = "a b c d e f g h"
    rows = spark.createDataFrame([(None, text, 1), (3, text, 1), (2, text, 2), (2, text, 2), (9, None, 3)], "doc_id long, text string, n int")
    assert sorted((r[0] or -1, r[2]) for r in jaccard.join_similar(rows).collect()) == [(-1, None), (2, 2), (2, 2), (3, 2), (9, 9)]
    kept = jaccard.keep_first(rows)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 2, 9]


def test_join_of_several_texts_of_a_doc_id(spark):
    words = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    groups = []  # doc 7 has a short and a long text (and none); 8 is a near copy of the long one, 5 of the short one
    for k in range(20):
        long, short, at = words(f"l{k}", 503), words(f"s{k}", 43), 100 * k
        rows = [(at + 7, short), (at + 7, long), (at + 7, ""), (at + 8, long + " more"), (at + 5, short + " more"), (at + 9, words(f"o{k}", 60))]
        groups += rows if k % 2 else rows[::-1]
    df = spark.createDataFrame(groups, "doc_id long, text string")
    found = {}
    for r in jaccard.join_similar(df.repartition(3), 4, (85, 100)).collect():
        found.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert found == {100 * k + d: {100 * k + (9 if d == 9 else 5)} for k in range(20) for d in (5, 7, 8, 9)}
    assert {r["doc_id"] for r in jaccard.keep_first(df, 4, (85, 100)).collect()} == {100 * k + d for k in range(20) for d in (5, 9)}


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (6, 5), (20, 19), (19, 18), (18, 17), (17, 16)]
    found = shared.components(spark.createDataFrame(links, "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {
        (1, 1), (2, 1), (3, 1), (9, 1), (5, 5), (6, 5), *((k, 16) for k in range(16, 21)),
    }
    assert shared.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_e8_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    points = lattice.nearest_e8(rng.normal(size=(300, 8)) * 3)
    assert len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)
    x = rng.normal(size=(300, 8)) * 3
    near = lattice.nearest_e8(x)
    best = ((x - near) ** 2).sum(axis=1)
    for root in lattice.ROOTS:  # no neighbour is nearer
        assert (((x - near - root) ** 2).sum(axis=1) >= best - 1e-9).all()
    assert np.allclose((points * 2) % 1, 0)


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 8)):
            rows.append((base + rng.normal(size=16) * rng.choice([0, 0.02, 0.05])).astype(np.float32).tolist())
    labels = [int(k) for k in rng.integers(0, 2, len(rows))]
    rows += [[0.0] * 16, None, [], [1.0, None], [float("nan")] * 16, [float("inf")] * 16, rows[0], rows[0], rows[0][:8]]
    labels += [0, 0, 0, 0, 0, 0, labels[0], None, labels[0]]
    table = [(k, v, g, "x") for k, (v, g) in enumerate(zip(rows, labels))] + [(None, rows[0], labels[0], "x")]
    found = lattice.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, n_links string"))
    usable = [bool(v) and None not in v and np.isfinite(v).all() and any(v) and g is not None for v, g in zip(rows, labels)]
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and usable[a] and usable[b] and labels[a] == labels[b] and len(rows[a]) == len(rows[b]):
                x, y = np.array(rows[a], float), np.array(rows[b], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a].add(b)
    got = {r["vec_id"]: r for r in found.collect()}
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    wanted, seen = sum(map(len, links.values())), sum(got[k]["n_links"] for k in links)
    assert all(got[k]["n_links"] <= len(links[k]) for k in links)  # none below the threshold
    assert seen >= 0.98 * wanted
    assert got[None]["component_id"] is None and not got[None]["kept"] and got[None]["n_links"] == 0
    for k in range(len(rows)):
        assert got[k]["kept"] == (got[k]["component_id"] == k)
        assert usable[k] or (got[k]["n_links"], got[k]["component_id"]) == (0, k)


def test_no_vectors(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_bitmap_of_keys_never_misses_one(spark, monkeypatch, bits):
    monkeypatch.setattr(shared, "FILTER_BITS", bits)
    ids = [None, 0, -1, 2**62, *range(5, 4000, 3)]
    rows = spark.createDataFrame([(k, 1, "x") for k in [*ids, *range(10_000, 14_000)]], "doc_id long, _bits int, _bucket string")
    keys = spark.createDataFrame([(k,) for k in ids], "doc_id long")
    found = shared.maybe_in(rows, "doc_id", keys, "likely")
    assert found.columns == ["doc_id", "_bits", "_bucket", "likely"]
    likely = [r["doc_id"] for r in found.collect() if r["likely"]]
    assert set(ids) - {None} <= set(likely) and None not in likely
    assert len(likely) < len(ids) + (40 if bits > 1 << 20 else 400)
    assert not any(r["likely"] for r in shared.maybe_in(rows, "doc_id", keys.limit(0), "likely").collect())


def test_counting_grams_and_joining_the_counts_read_one_shuffle(spark):
    sets = reuse(spark.createDataFrame([(1, 3, [5, 6, 7]), (2, 3, [6, 7, 8]), (3, 1, [9])], "id long, n long, grams array<long>"))
    shared = jaccard.shared_cells(sets).groupBy("id").agg(F.sort_array(F.collect_list("gram")).alias("own"), F.max("times").alias("times"))
    found = sets.select("id", "n").join(shared, "id")
    assert sorted(map(tuple, found.collect())) == [(1, 3, [6, 7], 2), (2, 3, [6, 7], 2)]
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}

    before = shuffles()
    stored = reuse(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # executors delete them in the background
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert stored.count() == 7
