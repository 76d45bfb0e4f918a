"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

Every string of LENGTH bytes contains a suffix that a content rule samples: the least hashed q-gram of the
string. Equal strings sample the same suffix at the same place, so only sampled suffixes are sorted.

1. Buckets of equal q-grams. A bucket with one suffix is done.
2. Buckets are refined by the bytes around the q-gram that any string around it can reach. Suffixes that stay
   together are copies as far as that reach goes: all but the first are repeats in full. A q-gram whose
   suffixes all stay together is done.
3. What is left is the first suffix of each refined bucket beside other buckets of its q-gram: the edges of
   repeats. Their strings are compared one by one within the q-gram.

Each task does step 1 and 2 on its own texts first, so that copies meet before the shuffle. A q-gram with many
surroundings in one task is spread by them, and one row under the q-gram tells the other tasks about it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costweave.llm import textops
from costweave.session import reuse

LENGTH = 100
GRAM = 32
TASK_BYTES = 8 << 20  # texts a task refines on its own before the shuffle
HOT = 8  # surroundings of a q-gram in one task from which on it is spread
EDGE_ROWS = 20_000  # edges compared at once
EDGE_LIMIT = 400_000  # edges of one q-gram held in a task; beyond that their strings are compared by Spark
_U = np.uint64

# kinds of rows on the way; a packed long is position << 16 | reach << 4 | kind
SUFFIX, SPREAD, MARK, REPEAT = 0, 1, 2, 3


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(position, row, low, high, q-gram hash, hash of low..high) of every sampled suffix of the rows of a block.

    low and high bound what strings of `length` around the q-gram can reach in their row.
    """
    width, size = length - gram + 1, len(data)
    if size < length:
        return None
    sums = textops.prefix_hashes(data)
    grams = np.arange(size - gram + 1)
    hashes = textops.span_hashes(sums, grams, grams + gram) | _U(1)
    least = textops.sliding(hashes, width, np.minimum)
    # strings that would cross the end of a row do not count
    change = np.zeros(size + 1, np.int32)
    starts, ends = offsets[:-1], offsets[1:]
    np.add.at(change, np.maximum(ends - length + 1, starts), 1)
    np.add.at(change, ends, -1)
    least[np.cumsum(change[: len(least)]) > 0] = 0
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(textops.sliding(np.concatenate([edge, least, edge]), width, np.maximum) == hashes)
    row = np.searchsorted(offsets, at, side="right") - 1
    low = np.maximum(at - (width - 1), starts[row])
    high = np.minimum(at + length, ends[row])
    around = textops.mix(textops.span_hashes(sums, low, high) + (at - low).astype(np.uint64))
    return at, row, low, high, hashes[at], around


def sampled_rows(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """`sampled` of many rows block by block, positions within the row; long rows in overlapping parts."""
    found, reach = [], length - gram
    for first, last in textops.blocks(offsets, textops.BLOCK_BYTES):
        low, high = int(offsets[first]), int(offsets[last])
        if high - low <= 2 * textops.BLOCK_BYTES:
            got = sampled(data[low:high], offsets[first : last + 1] - low, length, gram)
            if got:
                at, row, a, b, h, c = got
                start = (offsets[first : last + 1] - low)[row]
                found.append((row + first, at - start, a - start, b - start, h, c))
            continue
        seen = np.zeros(0, np.int64)  # one long row: parts of strings starting in [begin, stop)
        for begin in range(low, high - length + 1, textops.BLOCK_BYTES):
            stop = min(begin + textops.BLOCK_BYTES, high - length + 1)
            left, right = max(begin - reach, low), min(stop + length + reach, high)
            got = sampled_part(data[left:right], begin - left, stop - left, length, gram, left - low, high - low)
            fresh = ~np.isin(got[0], seen)
            seen = got[0]
            found.append((np.full(fresh.sum(), first), *(x[fresh] for x in got)))
    if not found:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found))


def sampled_part(data, begin, stop, length, gram, shift, whole):
    """`sampled` of one part of a long row: strings that start in [begin, stop) of data."""
    width = length - gram + 1
    sums = textops.prefix_hashes(data)
    grams = np.arange(begin, min(stop + width - 1, len(data) - gram + 1))
    hashes = textops.span_hashes(sums, grams, grams + gram) | _U(1)
    least = textops.sliding(hashes, width, np.minimum)[: stop - begin]
    edge = np.zeros(width - 1, np.uint64)
    at = grams[textops.sliding(np.concatenate([edge, least, edge]), width, np.maximum)[: len(grams)] == hashes]
    low = np.maximum(at - (width - 1), -shift)
    high = np.minimum(at + length, whole - shift)
    around = textops.mix(textops.span_hashes(sums, low, high) + (at - low).astype(np.uint64))
    return at + shift, low + shift, high + shift, hashes[at - begin], around


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, overlapping and touching ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([new[1:], [True]])]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _unpressed(column: pa.Array) -> Iterator[np.ndarray]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    for value in column:
        yield np.frombuffer(open_(value.as_buffer()), np.uint8)


def _press(batches):
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data, offsets = textops.byte_column(batch.column(1))
        data = memoryview(data)
        texts = [press(data[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "pressed"])


def _refine_own(length: int, gram: int):
    """Tasks: steps 1 and 2 on the task's own texts; rows (k, c, doc_id, packed)."""
    names = ["k", "c", "doc_id", "packed"]

    def flush(doc_ids, texts):
        data = np.concatenate(texts)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        row, at, low, high, h, c = sampled_rows(data, offsets, length, gram)
        ids = np.array(doc_ids, np.int64)
        order = np.lexsort((at, ids[row], c, h))
        row, at, low, high, h, c = (x[order] for x in (row, at, low, high, h, c))
        new_h = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]]) if len(h) else new_h
        group = np.cumsum(new_h) - 1
        classes = np.bincount(group, weights=new_c).astype(np.int64) if len(h) else np.zeros(0, np.int64)
        hot = classes[group] >= HOT
        out = []
        again = ~new_c  # not the first here, so not the first at all
        if again.any():
            by = np.argsort(row[again], kind="stable")
            rows, lows, highs = row[again][by], low[again][by], high[again][by]
            cuts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1], [True]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                s, e = merged(lows[a:b], highs[a:b])
                doc = np.full(len(s), ids[rows[a]])
                out.append((_signed(textops.mix(doc.view(np.uint64))), e, doc, s << 16 | REPEAT))
        packed = at << 16 | (high - at) << 4
        plain, spread = new_c & ~hot, new_c & hot
        out.append((_signed(h[plain]), _signed(c[plain]), ids[row[plain]], packed[plain] | SUFFIX))
        out.append((_signed(textops.mix(h[spread] + c[spread])), _signed(c[spread]), ids[row[spread]], packed[spread] | SPREAD))
        mark = new_h & hot
        out.append((_signed(h[mark]), _signed(textops.mix(c[mark] + _U(1))), ids[row[mark]], packed[mark] | MARK))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=names)

    def run(batches):
        doc_ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), _unpressed(batch.column(1))):
                if len(text) < length:
                    continue
                doc_ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= TASK_BYTES:
                    yield flush(doc_ids, texts)
                    doc_ids, texts, size = [], [], 0
        if texts:
            yield flush(doc_ids, texts)

    return run


def _surroundings(length: int, gram: int):
    """Tasks: rows (doc_id, pressed, found) to rows (g, doc_id, start, around, left): edges with their bytes.

    g is NULL for spans that are known to repeat: start, and left as the end.
    """
    names = ["g", "doc_id", "start", "around", "left"]

    def run(batches):
        for batch in batches:
            rows = [[], [], [], [], []]
            for doc_id, text, found in zip(batch.column(0).to_pylist(), _unpressed(batch.column(1)), batch.column(2)):
                values = found.values
                packed, ends = (np.asarray(values.field(x), np.int64) for x in ("packed", "c"))
                kind, at = packed & 15, packed >> 16
                known = kind == REPEAT
                starts, stops = merged(
                    np.where(known, at, np.maximum(at - (length - gram), 0))[kind >= MARK],
                    np.where(known, ends, at + (packed >> 4 & 4095))[kind >= MARK],
                )
                edges = np.unique(at[kind < MARK])
                rows[0] += [None] * len(starts)
                rows[1] += [doc_id] * (len(starts) + len(edges))
                rows[2] += starts.tolist()
                rows[3] += [None] * len(starts)
                rows[4] += stops.tolist()
                raw = text.tobytes()
                for p in edges.tolist():
                    low = max(p - (length - gram), 0)
                    rows[0].append(int.from_bytes(hashlib.blake2b(raw[p : p + gram], digest_size=8).digest(), "little", signed=True))
                    rows[2].append(low)
                    rows[3].append(raw[low : p + length])
                    rows[4].append(p - low)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)

    return run


def _compare_edges(length: int, edge_limit: int):
    """Tasks: sorted rows of `_surroundings` to rows (w, doc_id, low, high): repeats, or single strings with hash w.

    Strings are told apart within batches that hold whole q-grams; a q-gram of more than edge_limit edges is
    passed on string by string.
    """
    names = ["w", "doc_id", "low", "high"]

    def strings(held):
        """(row, start in the document, hash) of every string of `length` in the held edges."""
        doc_ids, starts, arounds, lefts = held
        sizes = np.array([len(a) for a in arounds], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(arounds), np.uint8)
        counts = np.maximum(np.minimum(np.array(lefts), sizes - length) + 1, 0)
        row = np.repeat(np.arange(len(sizes)), counts)
        step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        hashes = np.zeros(len(row), np.uint64)
        for first, last in textops.blocks(base):
            mine = slice(int(counts[:first].sum()), int(counts[:last].sum()))
            at = base[row[mine]] - base[first] + step[mine]
            hashes[mine] = textops.span_hashes(textops.prefix_hashes(data[base[first] : base[last]]), at, at + length)
        return row, np.array(starts, np.int64)[row] + step, hashes

    def batch_of(w, doc, low, high):
        return pa.RecordBatch.from_arrays([
            pa.array(w, pa.int64()) if w is not None else pa.nulls(len(doc), pa.int64()),
            pa.array(doc, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
        ], names=names)

    def compare(held):
        row, start, hashes = strings(held)
        ids = np.array(held[0], np.int64)
        if not len(row):
            return batch_of(None, ids[:0], start, start)
        rank = np.unique(ids, return_inverse=True)[1]
        place = rank[row] << 36 | start
        order = np.argsort(hashes)
        cuts = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        first = np.minimum.reduceat(place[order], cuts)
        again = np.zeros(len(row), bool)
        again[order] = place[order] > np.repeat(first, np.diff(np.append(cuts, len(row))))
        row, start = row[again], start[again]
        if not len(row):
            return batch_of(None, ids[:0], start, start)
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
        last = np.concatenate([new[1:], [True]])
        return batch_of(None, ids[row[new]], start[new], start[last] + length)

    def run(batches):
        held, begin, last, passing = ([], [], [], []), 0, None, False
        for batch in batches:
            g, doc, start, around, left = (batch.column(k) for k in range(5))
            known = np.asarray(g.is_null())
            if known.any():
                mask = pa.array(known)
                yield batch_of(None, doc.filter(mask), start.filter(mask), left.filter(mask))
            for key, d, s, a, n in zip(*(x.filter(pa.array(~known)).to_pylist() for x in (g, doc, start, around, left))):
                if key != last:
                    if passing:
                        row, at, hashes = strings(held)
                        yield batch_of(_signed(hashes), np.array(held[0])[row], at, at + length)
                        held, passing = ([], [], [], []), False
                    elif len(held[0]) >= EDGE_ROWS:
                        yield compare(held)
                        held = ([], [], [], [])
                    last, begin = key, len(held[0])
                elif len(held[0]) - begin >= edge_limit:
                    if begin:
                        yield compare(tuple(x[:begin] for x in held))
                        held, begin = tuple(x[begin:] for x in held), 0
                    row, at, hashes = strings(held)
                    yield batch_of(_signed(hashes), np.array(held[0])[row], at, at + length)
                    held, passing = ([], [], [], []), True
                for x, value in zip(held, (d, s, a, n)):
                    x.append(value)
        if passing:
            row, at, hashes = strings(held)
            yield batch_of(_signed(hashes), np.array(held[0])[row], at, at + length)
        elif held[0]:
            yield compare(held)

    return run


def _cut_out(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        rows = []
        for doc_id, text, found in zip(batch.column(0).to_pylist(), _unpressed(batch.column(1)), batch.column(2)):
            keep, spans, removed = hashlib.sha256(), 0, 0
            at = 0
            if found.is_valid:
                lows, highs = merged(*(np.asarray(found.values.field(x), np.int64) for x in ("low", "high")))
                for low, high in zip(lows.tolist(), highs.tolist()):
                    keep.update(text[at:low])
                    at, spans, removed = high, spans + 1, removed + high - low
            keep.update(text[at:])
            rows.append((doc_id, len(text), removed, spans, keep.hexdigest()))
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.string())], names=names)


def pressed(docs: DataFrame) -> DataFrame:
    """doc_id and the zstd bytes of the text, one row a document, dealt by doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(_press, "doc_id long, pressed binary").groupBy("doc_id").agg(F.max("pressed").alias("pressed"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, edge_limit: int = EDGE_LIMIT) -> DataFrame:
    """doc_id, low, high: byte spans that cover every string of `length` bytes which also starts earlier."""
    own = texts.mapInArrow(_refine_own(length, gram), "k long, c long, doc_id long, packed long")
    sorted_bucket, bucket = Window.partitionBy("k").orderBy("c", "doc_id", "packed"), Window.partitionBy("k")
    kind = F.col("packed").bitwiseAND(15)
    refined = own.withColumns({
        "again": F.lag("c").over(sorted_bucket).eqNullSafe(F.col("c")),
        "beside": (F.min("c").over(bucket) != F.max("c").over(bucket)) | (kind == SPREAD),
    }).where((kind != MARK) & ((kind == REPEAT) | F.col("again") | F.col("beside")))
    # a suffix that is not the first of its refined bucket becomes a MARK: a repeat as far as it reaches
    refined = refined.select("doc_id", "c", F.when((kind != REPEAT) & F.col("again"), F.col("packed") - kind + MARK).otherwise(F.col("packed")).alias("packed"))
    by_doc = refined.groupBy("doc_id").agg(F.collect_list(F.struct("packed", "c")).alias("found"))  # bounded by the text
    edges = texts.join(by_doc, "doc_id").select("doc_id", "pressed", "found").mapInArrow(
        _surroundings(length, gram), "g long, doc_id long, start long, around binary, left long"
    )
    dealt = edges.repartition(F.coalesce("g", F.xxhash64("doc_id"))).sortWithinPartitions("g", "doc_id", "start")
    spans = reuse(dealt.mapInArrow(_compare_edges(length, edge_limit), "w long, doc_id long, low long, high long"))
    passed = spans.where("w is not null")
    first = passed.groupBy("w").agg(F.min(F.struct("doc_id", "low")).alias("first"))
    late = passed.join(first, "w").where(F.struct("doc_id", "low") > F.col("first"))
    return spans.where("w is null").select("doc_id", "low", "high").unionByName(late.select("doc_id", "low", "high"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, edge_limit: int = EDGE_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: docs (doc_id, text) without their repeated strings.

    A byte goes if a string of `length` bytes around it also starts earlier: in a smaller doc_id, or before in
    the same document. NULL texts are empty. Rows without doc_id are left out; of rows with the same doc_id one
    counts (the one whose compressed text is greatest). An empty table gives an empty result.
    """
    spans = repeated_spans(pressed(docs), length, gram, edge_limit)
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    return pressed(docs).join(by_doc, "doc_id", "left").select("doc_id", "pressed", "found").mapInArrow(
        _cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
