"""Byte-level BPE ids of whole texts, with a bounded memory of the words already seen."""

from __future__ import annotations

import os
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from costweave.llm import textops

VOCABULARY = "byte_bpe_50k.json"
REMEMBERED_WORDS = 1_000_000  # about 50 MB
ENCODED_BYTES = 4 << 20  # texts encoded at once: words are told apart and looked up once for all of them
LEARNED_WORDS = 250  # words the library gets at once; more of them leave the processor's cache
_ENDS = ",."
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder_for(path: str, remembered: int = REMEMBERED_WORDS) -> WordEncoder:
    """The encoder of a worker process: it serves its tasks one after the other, words seen before included."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = WordEncoder(path, remembered)
    return _encoders[path, remembered]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd(word: str) -> bool:
    """Empty, or with white space at an end."""
    return not word or word[0] <= " " or word[-1] <= " " or word[0].isspace() or word[-1].isspace()


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # some ten times faster than to_pylist


def _edges(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, offsets, first byte, last byte) of words; 0 for the bytes of an empty one."""
    data, offsets = textops.byte_column(words)
    padded, some = np.append(data, np.uint8(0)), np.diff(offsets) > 0
    return data, offsets, padded[offsets[:-1]] * some, padded[offsets[1:] - 1] * some


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from begin to begin + size of every pair, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordEncoder:
    """Ids of the tokenizers library, word by word.

    A byte-level BPE with the usual pattern never joins a text across a single space that stands between
    two other characters: the space opens the next piece. Texts are cut there, the distinct words of all texts
    are looked up among those seen before, and the new ones go to the library together, where their ids are told apart by the
    bytes that each id stands for. Texts with other spaces, and texts that hold the string of an added token, go there whole.
    Words seen and their ids are columns, not Python objects.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        self._remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        size = self._library.get_vocab_size(with_added_tokens=True)
        self._bytes_of = np.zeros(size, np.int64)
        for text, number in self._library.get_vocab(with_added_tokens=True).items():
            self._bytes_of[number] = len(text)  # the byte alphabet has a character for each byte
        self._end_ids = np.zeros(256, np.uint32)
        self._is_end = np.zeros(256, bool)
        for end in _ENDS:
            ids = self._ids([end])[0]
            self._end_ids[ord(end)], self._is_end[ord(end)] = ids[0], len(ids) == 1
        self._first: dict[str, bytes] = {}
        self._words = pa.array([], pa.string())
        self._flat, self._sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # ids of the words, one after the other

    def _ids(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self._library, "encode_batch_fast", self._library.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one word after the other, number of ids of each) of words after a space, from the library."""
        found = [np.zeros(0, np.uint32)]
        for low in range(0, len(words), LEARNED_WORDS):
            text = " " + " ".join(_strings(words.slice(low, LEARNED_WORDS)))
            found.append(np.fromiter(chain.from_iterable(self._ids([text])), np.uint32))
        flat = np.concatenate(found)
        ends = np.cumsum(self._bytes_of[flat])
        wanted = np.cumsum(np.diff(textops.byte_column(words)[1]) + 1)
        cuts = np.searchsorted(ends, wanted, side="left") + 1
        if len(wanted) and (ends[-1] != wanted[-1] or not np.array_equal(ends[cuts - 1], wanted)):
            raise ValueError("the vocabulary joins words across spaces")
        return flat, np.diff(cuts, prepend=0)

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one word after the other, number of ids of each) of distinct words after a space."""
        data, offsets, _, last = _edges(words)
        # a comma or full stop after a letter is a piece of its own
        ended = (np.diff(offsets) > 1) & self._is_end[last]
        ended[ended] = _LETTERS[data[offsets[1:][ended] - 2]]
        stays = np.ones(len(data), bool)
        stays[offsets[1:][ended] - 1] = False
        stem_offsets = offsets - np.concatenate([[0], np.cumsum(ended)])
        buffers = pa.py_buffer(stem_offsets.astype(np.int32)), pa.py_buffer(data[stays])
        coded = pa.StringArray.from_buffers(len(words), *buffers).dictionary_encode()
        stems, stem = coded.dictionary, np.asarray(coded.indices)
        place = np.full(len(stems), -1)
        seen = pc.index_in(self._words, value_set=stems)  # the smaller side is hashed
        place[np.asarray(seen.drop_null())] = np.flatnonzero(np.asarray(seen.is_valid()))
        new = place < 0
        if new.any():
            fresh = stems.filter(pa.array(new))
            flat, sizes = self._learn(fresh)
            place[new] = len(self._words) + np.arange(len(fresh))
            self._words = pa.concat_arrays([self._words, fresh])
            self._flat, self._sizes = np.concatenate([self._flat, flat]), np.concatenate([self._sizes, sizes])
        begins = np.cumsum(self._sizes) - self._sizes
        at = place[stem]
        sizes = self._sizes[at] + ended
        flat = self._flat.take(_ranges(begins[at], sizes), mode="clip")
        flat[(np.cumsum(sizes) - 1)[ended]] = self._end_ids[last[ended]]
        if len(self._words) > self._remembered:  # the words of this call stay, if they are not too many
            kept = place if len(place) <= self._remembered else place[:0]
            self._words = stems.slice(0, len(kept)).take(pa.array(np.arange(len(kept))))
            self._flat, self._sizes = self._flat[_ranges(begins[kept], self._sizes[kept])], self._sizes[kept]
        return flat, sizes

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of every text (NULL counts as empty) as little-endian unsigned 32-bit integers."""
        if not len(texts):
            return []
        if len(self._first) > self._remembered:
            self._first.clear()
        firsts = self._first
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        parts = pc.split_pattern(column, " ")
        starts, words = np.asarray(parts.offsets).astype(np.int64), parts.values
        at, row = starts[:-1], np.repeat(np.arange(len(column)), np.diff(starts))
        after = np.ones(len(words), bool)
        after[at] = False
        heads = _strings(words.take(pa.array(at)))
        coded = words.filter(pa.array(after)).dictionary_encode()
        distinct, code, text = coded.dictionary, np.asarray(coded.indices), row[after]

        # a space beside other white space is no such gap
        _, _, first, last = _edges(distinct)
        odd = np.minimum(first, last) <= 0x20
        asked = odd | (np.maximum(first, last) >= 0x80)
        odd[asked] = [_odd(w) for w in _strings(distinct.filter(pa.array(asked)))]
        whole = np.array([h not in firsts and (n > 1 or h != "") and _odd(h) for h, n in zip(heads, np.diff(starts).tolist())])
        whole[text[odd[code]]] = True
        for token in self._added:
            whole |= np.asarray(pc.match_substring(column, token))
        opening = list({h for h, w in zip(heads, whole.tolist()) if not w}.difference(firsts))
        for word, ids in zip(opening, self._ids(opening)):
            firsts[word] = array("I", ids).tobytes()
        alone = iter(self._ids(column.filter(pa.array(whole)).to_pylist()))
        heads = [array("I", next(alone)).tobytes() if w else firsts[h] for h, w in zip(heads, whole.tolist())]

        wanted = np.zeros(len(distinct), bool)  # words of the other texts
        wanted[code[~whole[text]]] = True
        sizes = np.zeros(len(distinct) + len(heads), np.int64)
        flat, sizes[: len(distinct)][wanted] = self._look_up(distinct.filter(pa.array(wanted)))
        sizes[len(distinct) :] = [len(h) // 4 for h in heads]
        flat = np.concatenate([flat, np.frombuffer(b"".join(heads), np.uint32)])
        piece = np.empty(len(words), np.int64)
        piece[after], piece[at] = code, np.arange(len(distinct), len(sizes))
        n_ids = sizes[piece]
        n_ids[after & whole[row]] = 0
        raw = flat[_ranges((np.cumsum(sizes) - sizes)[piece], n_ids)].tobytes()
        cuts = [0, *(4 * np.cumsum(n_ids)[starts[1:] - 1]).tolist()]
        return [raw[low:high] for low, high in zip(cuts, cuts[1:])]
