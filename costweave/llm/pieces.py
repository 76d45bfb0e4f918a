"""SentencePiece ids of whole texts by a prefix table, and texts back from ids.

In a merge-type (BPE) model the encoding of every prefix of a text has one last piece, and a sequence of
pieces is an encoding exactly when every piece alone and every two neighbours alone encode to themselves.
So the last piece of each prefix is the one match of an automaton ending there that goes with the last piece
of the prefix before it. Walking back from the end gives the ids, in time linear in the text.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm import textops

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
REMEMBERED = 1_000_000  # stretches, and pairs of pieces, that a worker process keeps: some 200 MB
REMEMBERED_LENGTH = 40  # longer stretches are not kept
TAILS = set(".,;:")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Remembered(dict):
    """What a function gives for short keys, kept up to a bound; longer keys are worked out each time."""

    def __init__(self, function):
        super().__init__()
        self._function = function

    def __missing__(self, key: str) -> bytes:
        found = self._function(key)
        if len(key) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = found
        return found


class PrefixTable:
    """Encoder and decoder of a BPE model with byte fallback and without user-defined pieces."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        size = library.get_piece_size()
        special = {i for i in range(size) if library.is_control(i) or library.is_unknown(i) or library.is_unused(i)}
        self._byte_ids = {int(library.id_to_piece(i)[1:-1], 16): i for i in range(size) if library.is_byte(i)}
        if len(self._byte_ids) < 256:
            raise ValueError("the model has no byte fallback")
        normal = [i for i in range(size) if i not in special and not library.is_byte(i)]
        self._piece = {i: library.id_to_piece(i) for i in normal}
        self._score = {piece: library.get_score(i) for i, piece in self._piece.items()}
        self._automaton = ahocorasick.Automaton()
        for i, piece in self._piece.items():
            if self.merged(piece) == [piece]:  # others are never reached by merges
                self._automaton.add_word(piece, (len(piece), i))
        self._automaton.make_automaton()
        self._ids = {piece: i for i, piece in self._piece.items()}
        self._length = {i: len(piece) for i, piece in self._piece.items()}
        self._cut()
        self._units = _Remembered(self._unit_ids)
        self._words = _Remembered(self._word_ids)  # units with one space mark, by what follows the mark
        self._after: dict[int, dict[int, bool]] = {i: {} for i in self._piece}  # by left piece, then by right
        self._at_start = dict.fromkeys(self._piece, True)  # before the first piece nothing stands
        self._tested = 0

    def _cut(self) -> None:
        """Patterns of stretches that no merge leaves: a space mark opens a new one where no piece holds one after
        another character, a line break without a piece stands alone, and so does, inside, any such character."""
        alone = {piece for piece in self._piece.values() if len(piece) == 1}
        inside = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self._piece.values())
        mark, line = "" if inside else SPACE, "" if "\n" in alone else "\n"
        self._marks_open = not inside
        words = f"{mark}+[^{mark}{line}]*|[^{mark}{line}]+" if mark else f"[^{line}]+" if line else ".+"
        self._unit = re.compile(f"{line}|{words}" if line else words, re.DOTALL)
        self._parts = re.compile(f"[{re.escape(''.join(sorted(alone)))}]+|.", re.DOTALL)

    def merged(self, text: str) -> list[str]:
        """Pieces by the merges themselves: the pair of the best piece first, then the leftmost."""
        parts, score = list(text), self._score.get
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                found = score(parts[k] + parts[k + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces side by side encode to themselves; remembered for each left piece."""
        found = self._after[left].get(right)
        if found is None:
            if self._tested >= REMEMBERED:
                for known in self._after.values():
                    known.clear()
                self._tested = 0
            a, b = self._piece[left], self._piece[right]
            found = self._after[left][right] = self.merged(a + b) == [a, b]
            self._tested += 1
        return found

    def _part_ids(self, part: str) -> list[int]:
        """Ids of characters that all have pieces, or the bytes of one that has none."""
        last, goes_on, after = [], [self._at_start], self._after  # of each prefix: last piece, tests of what may follow it
        for end, (size, token) in self._automaton.iter(part):
            if end == len(last):  # its last piece is still to be found
                found = goes_on[end + 1 - size].get(token)
                if found is None:
                    found = size > end or self._compatible(last[end - size], token)
                if found:
                    last.append(token)
                    goes_on.append(after[token])
        at = len(part)
        if not last:
            return [self._byte_ids[b] for b in part.encode()]
        ids, length = [], self._length
        while at:
            token = last[at - 1]
            ids.append(token)
            at -= length[token]
        ids.reverse()
        return ids

    def _unit_ids(self, unit: str) -> bytes:
        return array("i", chain.from_iterable(map(self._part_ids, self._parts.findall(unit)))).tobytes()

    def _word_ids(self, word: str) -> bytes:
        tail = word[-1:]
        if tail in TAILS and tail in self._ids and word[-2:-1] not in TAILS and len(word) > 1:
            # a prefix, mostly seen before, and one more piece that goes with its last
            token, stem = self._ids[tail], self._words[word[:-1]]
            left = int.from_bytes(stem[-4:], sys.byteorder)
            if left not in self._piece or self._compatible(left, token):
                return stem + array("i", [token]).tobytes()
        first, *rest = self._unit.findall(SPACE + word)
        return self._unit_ids(first) + b"".join([self._units[u] for u in rest])

    def encode(self, texts: list[str], end_id: int | None = None) -> list[bytes]:
        """Ids of every text as 32-bit integers, with end_id after them if it is given."""
        end, found = b"" if end_id is None else array("i", [end_id]).tobytes(), []
        for text in self.library.normalize(texts):
            if self._marks_open and text[:1] == SPACE and SPACE * 2 not in text:
                ids = b"".join(map(self._words.__getitem__, text[1:].split(SPACE)))
            else:
                ids = b"".join(map(self._units.__getitem__, self._unit.findall(text)))
            found.append(ids + end)
        return found

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


_tables: dict[str, PrefixTable] = {}


def table_for(path: str) -> PrefixTable:
    """The table of a worker process: it serves its tasks one after the other."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


def encode_pieces(docs: DataFrame, path: str | None = None, add_end: bool = True, decode: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text, with the model's end id last; with `decode` also the
    text that the ids give back, as `decoded`.

    Needs doc_id and text; other columns take no part, whatever their names. One row a row, repeated rows
    alike; a NULL doc_id stays NULL; a NULL text is an empty one: only the end id, decoded as ''. No shuffle.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(path)
        end = table.library.eos_id() if add_end else None
        for batch in batches:
            _, sizes = textops.byte_column(batch.column(1))
            for first, last in textops.blocks(sizes):
                found = table.encode([t or "" for t in batch.column(1).slice(first, last - first).to_pylist()], end)
                ends = np.cumsum([0, *(len(f) // 4 for f in found)])
                ids = np.frombuffer(b"".join(found), np.int32)
                columns = [
                    batch.column(0).slice(first, last - first),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                ]
                if decode:
                    numbers = ids.tolist()
                    columns.append(pa.array(table.decode([numbers[a:b] for a, b in zip(ends, ends[1:])]), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", decoded string" if decode else ""))


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (doc_id, ids array<int>) with the text of the ids as `decoded`; NULL ids count as none."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = table_for(path).decode([ids or [] for ids in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    slim = encoded.select("doc_id", "ids")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of `encode_pieces` with decoding."""
    return encode_pieces(docs, path, decode=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
