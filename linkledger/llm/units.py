"""Token ids of whole texts by way of their distinct space-separated units.

Neither tokenizer used here lets a token cross from a non-space character over a single
space into the next one: byte-level BPE puts that space in front of the next word, and the
word BPE drops it, as it does a line break. So a text is the chain of units that begin at such spaces, and the ids of
a text are those of its units. A batch is cut and dictionary-encoded by Arrow, each distinct
unit is encoded once for a Python worker, and the ids are gathered by NumPy.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from itertools import repeat
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a Python worker keeps, some 150 bytes each, and bytes of text for one call.
MOST_UNITS, CHUNK_BYTES = 600_000, 3_000_000
#: A single space between two characters that are no white space, by the widest notion of white space.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
#: Marks a unit of clean_units() that looks odd() but is whole.
_WHOLE = "\0"


def clean_units(text: str) -> list[str]:
    """Cuts only at single spaces between other characters."""
    first, *rest = _BREAK.split(text)
    return [_WHOLE + first, *[" " + x for x in rest]]


def odd(unit: str) -> bool:
    """A space before white space or at the end: such a text has to be cut by clean_units()."""
    return unit == " " or unit[:1] == " " and unit[1:2].isspace()


def core(unit: str) -> str:
    """The unit without the ASCII punctuation that ends it after a plain word; both tokenizers cut there and keep the rest as one run."""
    word = unit.rstrip(punctuation)
    return word if len(word) < len(unit) and plain(word.removeprefix(" ")) else unit


def plain(word: str) -> bool:
    """Only letters below U+0250, but for U+0130, whose lower case ends in a mark: one word for either tokenizer, and the
    same in composed form."""
    return word.isalpha() and (word.isascii() or max(word) < "ɐ" and "\u0130" not in word)


class UnitStore:
    """Keeps the ids of units that encode() has returned. When it would hold more than `most`, it forgets those that
    one call only has used; the rarest go until half of `most` are left."""

    def __init__(self, keep_space: bool, most: int = MOST_UNITS):
        self.keep_space, self.most = keep_space, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.length, self.odd, self.calls = (np.zeros(1 << 18, t) for t in (np.int64, np.int32, bool, np.uint8))

    def touch(self, slots: np.ndarray) -> None:
        """Counts one more call for these slots, each given once."""
        self.calls[slots] = np.minimum(self.calls[slots], 254) + 1

    def trim(self) -> None:
        names, slots = list(self.slot), np.fromiter(self.slot.values(), np.int64, len(self.slot))
        calls = self.calls[slots]
        least = 2
        while (calls >= least).sum() > self.most // 2 and least < 256:
            least += 1
        stay = np.flatnonzero(calls >= least)
        slots, names = slots[stay], [names[i] for i in stay.tolist()]
        length, odd_ = self.length[slots], self.odd[slots]
        ends = np.cumsum(length, dtype=np.int64)
        flat = self.flat[np.repeat(self.start[slots] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.clear()
        self.put(names, flat, length)
        self.odd[: len(names)] = odd_
        self.calls[: len(names)] = 1

    def encode(self, new: list[str]) -> None:
        """Calls put() with the ids of each of these units."""
        raise NotImplementedError

    def put(self, units: list[str], flat: np.ndarray, length: np.ndarray) -> None:
        n, k = len(self.slot), len(units)
        while n + k > len(self.start):
            self.start, self.length, self.odd, self.calls = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length, self.odd, self.calls))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[n : n + k] = self.used + np.cumsum(length) - length
        self.length[n : n + k] = length
        self.used += len(flat)
        self.slot.update(zip(units, range(n, n + k)))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these texts (null: empty) and where each text's begin, with the end."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.keep_space:
            cut = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        else:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat, offsets, again = self._chain(cut, self.keep_space)
        if self.keep_space:
            again |= pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        if not again.any():
            return flat, offsets
        rows = np.flatnonzero(again)
        redone = pa.array([clean_units(x) for x in texts.take(pa.array(rows)).to_pylist()], pa.large_list(pa.large_string()))
        more, at, _ = self._chain(redone, False)
        parts = [flat[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        for j, i in enumerate(rows):
            parts[i] = more[at[j] : at[j + 1]]
        return np.concatenate([flat[:0], *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _chain(self, cut: pa.Array, wary: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        coded = cut.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.slot) + len(words) > self.most:
            self.trim()
        slots = np.fromiter(map(self.slot.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            self.encode(new)
            slots[missing] = np.fromiter(map(self.slot.__getitem__, new), np.int64, len(new))
            if self.keep_space:
                self.odd[slots[missing]] = np.fromiter(map(odd, new), bool, len(new))
        self.touch(slots)
        length, start = self.length[slots][codes].astype(np.int64), self.start[slots][codes]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(start - (ends - length), length) + np.arange(total)]
        at = np.asarray(cut.offsets, np.int64) - int(cut.offsets[0].as_py())
        before = np.concatenate([[0], ends])
        again = np.zeros(len(cut), bool)
        if wary and (bad := self.odd[slots][codes]).any():
            again = np.diff(np.concatenate([[0], np.cumsum(bad)])[at]) > 0
        return flat, before[at], again


class LibraryStore(UnitStore):
    """Ids by the tokenizers library as it stands: the strings of its special tokens are those tokens.

    Plain words go to it many in one call, joined by spaces; their ids part where a token
    opens a word (byte level) or closes one (word ends). All else is encoded by itself.
    """

    def __init__(self, path: str, keep_space: bool, most: int = MOST_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(keep_space, most)
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.edge[i] = token[0] == "Ġ" if keep_space else token.endswith("</w>")

    def _together(self, words: list[str]) -> bool:
        text = "".join(words) if self.keep_space else " ".join(words)
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return False
        self.put(words, ids, np.diff(np.append(at, len(ids))) if self.keep_space else np.diff(np.append(-1, at)))
        return True

    def _alone(self, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast([w.removeprefix(_WHOLE) if self.keep_space else w for w in words], add_special_tokens=False)
        ids = [e.ids for e in found]
        self.put(words, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids]))

    def encode(self, new: list[str]) -> None:
        skip = int(self.keep_space)
        cut = {u: (c, u[len(c) :]) for u in new if len(c := core(u)) < len(u)}
        cores = {u for u in new if u not in cut}.union(*zip(*cut.values()))
        cores = [c for c in cores if c not in self.slot]
        fast = [w for w in cores if w[:skip] == " " * skip and plain(w[skip:])]
        slow = list(set(cores).difference(fast))
        for i in range(0, len(fast), 1024):
            if not self._together(fast[i : i + 1024]):
                self._alone(fast[i : i + 1024])
        for i in range(0, len(slow), 1024):
            self._alone(slow[i : i + 1024])
        if cut:
            pairs = np.fromiter((self.slot[x] for two in cut.values() for x in two), np.int64, 2 * len(cut))
            length, start = self.length[pairs].astype(np.int64), self.start[pairs]
            ends = np.cumsum(length)
            flat = self.flat[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]))]
            self.put(list(cut), flat, length.reshape(-1, 2).sum(1))


_HELD: dict[tuple, UnitStore] = {}


def held(kind: tuple, make) -> UnitStore:
    """The store that this Python worker keeps for its next tasks of the same kind. It keeps one: what a task of another
    kind has left goes, and its memory is given back to the system."""
    if kind not in _HELD:
        let_go()
        _HELD[kind] = make()
    return _HELD[kind]


def let_go() -> None:
    """For tasks that need no store."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def library_store(path: str, keep_space: bool) -> LibraryStore:
    return held((path, keep_space), lambda: LibraryStore(path, keep_space))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES):
    """Runs of rows with a bounded number of bytes (or one row): (first row, rows)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, held = 0, 0
    for i, n in enumerate(size):
        if held and held + n > most:
            yield first, texts.slice(first, i - first)
            first, held = i, 0
        held += int(n) + 1
    if first < len(texts):
        yield first, texts.slice(first)
