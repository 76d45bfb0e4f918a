"""Token shards and packing: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from costweave.llm import packing, tokens, wavelet
from costweave.llm.tokens import WordEncoder, vocabulary_path

TEXTS = [
    None, "", " ", "a", "  two  spaces ", "tab\t and\n\nlines \n x", "don't I'll 12 345 1,000", "é ü 漢字 😀  x \x1c y",
    "<|endoftext|> is a token", "a <|endoftext|> b", "<|endoftext|>", "at the end<|endoftext|>", "x<|endoftext|><|endoftext|>  y<|endoftext|> z",
    "<|endoftext |> <|endoftext|",  "word " * 3000, "x" * 5000, "a b", "a b", " lead", "trail ", "mixed\r\nend  \r\n",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_path())
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_the_library(library):
    rng = random.Random(4)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice([*"ab '\n\t.1é  ", "<|endoftext|>"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for ids, text in zip(WordEncoder(vocabulary_path()).encode(texts), texts):
        assert np.frombuffer(ids, "<u4").tolist() == library(text), text


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(6)
    for size, top in [(0, 1), (1, 1), (700, 3), (1500, 50_000), (512, 70_000)]:
        ids = rng.integers(0, top, size).astype(np.uint32)
        matrix = wavelet.WaveletMatrix.build(ids)
        assert np.array_equal(matrix.decode(), ids)
        for at in range(0, size, 97):
            assert matrix.access(at) == ids[at]
        for value in [0, 1, *ids[:3].tolist(), top + 1]:
            places = np.flatnonzero(ids == value).tolist()
            assert matrix.occurrences(value) == places
            assert matrix.rank(value, size // 2) == sum(p < size // 2 for p in places)
            assert matrix.count(value, 3, size) == sum(3 <= p for p in places)
            assert matrix.select(value, len(places)) == -1
    with pytest.raises(IndexError):
        wavelet.WaveletMatrix.build(np.zeros(1, np.uint32)).access(1)


def test_shard_bytes_round_trip():
    ids = np.arange(5000, dtype=np.uint32) % 777
    doc_ids, lengths, matrix = wavelet.open_shard(wavelet.pack_shard([None, 4, -7], [1000, 3999, 1], ids))
    assert doc_ids == [None, 4, -7] and lengths.tolist() == [1000, 3999, 1] and np.array_equal(matrix.decode(), ids)
    with pytest.raises(ValueError):
        wavelet.open_shard(b"nothing of the kind")


def test_shards_of_documents(spark, library):
    rows = [(3 * i - 5, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (4, "same id", "x"), (1, TEXTS[2], "x"), (1, TEXTS[2], "x")]
    found = wavelet.token_shards(spark, spark.createDataFrame(rows, "doc_id long, text string, start string"), shard_ids=900)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found.collect())
    assert [g[1] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got[:-1])]).tolist()
    crc = lambda t: zlib.crc32(np.array([*library(t), 0], "<u4").tobytes())
    assert sorted((g[1] is None, g[1], g[3]) for g in got if g[1] is not None) == sorted((False, i, crc(t)) for i, t, _ in rows if i is not None)


def test_shards_of_no_documents(spark):
    assert wavelet.token_shards(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_packing_keeps_every_id_once(spark, library):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS * 3)] + [(None, "no id", 7), (2, "same id", 7)]
    found = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, sequence_id int"), capacity=256).collect()
    ends, filled = {}, {}
    for r in found:
        assert 1 <= r["length"] <= 256
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ends.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
        assert sum(n for _, n in parts) <= 256
    assert sorted(filled) == list(range(len(filled)))
    for doc_id, text, _ in rows:
        if doc_id not in (None, 2):
            ids = np.array([*library(text), 1], "<u4")
            assert [s for s, *_ in sorted(ends[doc_id])] == np.cumsum([0, *(n for _, n, _ in sorted(ends[doc_id])[:-1])]).tolist()
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in ends[doc_id]) and sum(n for _, n, _ in ends[doc_id]) == len(ids)


def test_packing_of_no_documents(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_patterns_cover_the_demand_with_little_waste():
    rng = np.random.default_rng(8)
    demand = np.zeros(65, np.int64)
    np.add.at(demand, rng.integers(1, 65, 5000), 1)
    patterns = packing.solve(demand, 64)
    assert (sum(p * n for p, n in patterns) == demand).all()
    assert all((p * np.arange(65)).sum() <= 64 for p, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.03 * (demand * np.arange(65)).sum() / 64
    assert packing.solve(np.zeros(65, np.int64), 64) == []


def test_knapsack_against_all_patterns():
    prices = np.array([0, 0.1, 0.35, 0.5, 0, 0, 0, 0])
    best = packing.best_pattern(prices, 7)
    every = [(a * 0.1 + b * 0.35 + c * 0.5) for a in range(8) for b in range(4) for c in range(3) if a + 2 * b + 3 * c <= 7]
    assert (best * np.arange(8)).sum() <= 7 and abs(best @ prices - max(every)) < 1e-9


def test_the_library_learns_few_words_at_once(monkeypatch):
    encoder = tokens.WordEncoder(tokens.vocabulary_path())
    asked, ids = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.extend(texts) or ids(texts))
    text = "a " + " ".join(f"w{k}x" for k in range(1_000))
    found = encoder.encode([text])
    assert np.frombuffer(found[0], np.uint32).tolist() == ids([text])[0]
    assert max(t.count(" ") for t in asked) <= tokens.LEARNED_WORDS


def test_stages_of_the_pipeline_get_small_batches_and_settings_come_back(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)

    def stage(spark, docs, sf_dir):
        seen.append(spark.conf.get(key))
        return docs

    spark.range(3).withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("as it is", stage)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3
    assert seen == [str(corpus_pipeline.BATCH_ROWS)] and spark.conf.get(key) == before


def test_words_of_the_last_call_are_remembered_whatever_was_before(library, monkeypatch):
    encoder = tokens.WordEncoder(vocabulary_path(), remembered=50)
    first, second = ("a " + " ".join(f"w{k}x{end}" for k in numbers) for numbers, end in ((range(40), ""), (range(100, 130), "y,")))
    for text in (first, second):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library(text)
    asked, ids = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.extend(texts) or ids(texts))
    assert np.frombuffer(encoder.encode([second, second])[1], "<u4").tolist() == library(second)
    assert asked == []
    many = "a " + " ".join(f"v{k}" for k in range(90))  # more than are remembered
    for text in (many, second, many):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library(text)


def test_word_encoder_takes_arrow_columns(library):
    rng = random.Random(5)
    texts = [None, *TEXTS, *("".join(rng.choice("ab,. é  \x1c,.  ") for _ in range(rng.randint(0, 40))) for _ in range(300)), None]
    column = pa.array(["before", *texts, "behind"]).slice(1, len(texts))
    encoder = WordEncoder(vocabulary_path())
    for _ in range(2):  # the second time from what is remembered
        for ids, text in zip(encoder.encode(column), texts, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library(text), text
    assert encoder.encode(column.slice(0, 0)) == []


def test_the_plan_of_sequences_starts_no_python_processes(spark, monkeypatch):
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(type(data)) or create(self, data, *a, **k))
    pieces = spark.range(200).selectExpr("id AS doc_id", "id % 60 + 1 AS length")
    assert packing.pack(pieces, ["doc_id"], capacity=64).count() == 200
    assert made == [pa.Table]


def test_release_gives_back_what_the_c_library_keeps(monkeypatch):
    from costweave.llm import textops

    trimmed = []
    monkeypatch.setattr(textops, "_trim", trimmed.append)
    textops.release()
    assert trimmed == [0]


def test_a_stage_alone_bounds_the_batches_of_rows_that_its_caller_writes(spark):
    import corpus_pipeline
    from costweave.session import setting

    sizes = []
    docs = spark.createDataFrame([(1, "a text", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    for before, wanted in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (100, 100)):
        with setting(spark, corpus_pipeline.BATCH_KEY, before):
            found = corpus_pipeline.identify_language(spark, docs, "")
            sizes.append((int(spark.conf.get(corpus_pipeline.BATCH_KEY)), wanted))
            assert [r["doc_id"] for r in found.collect()] == [1]
    assert all(is_now == wanted for is_now, wanted in sizes)
