"""Byte-level BPE in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the ranks of all neighbouring pairs are
found by binary search over the sorted pair keys, every word's lowest pair is merged wherever it occurs,
and words without a known pair leave. Texts are cut into units (white space and what follows it), whose
ids are kept for the next text, so merges run on units not met lately only.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, text_chunks

#: White space as Unicode has it; fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How byte-level BPE splits text before merging; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^S\p{L}\p{N}]+|[S]+(?![^S])|[S]+".replace("S", SPACES)
#: A unit: no split ever crosses from other characters to white space.
UNIT = re.compile("[S]*[^S]+|[S]+".replace("S", SPACES))
#: Units whose ids a worker keeps, and their characters; beyond either, it starts anew.
KEPT_UNITS = 500_000
KEPT_CHARS = 1 << 24


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class IdStore:
    """Ids of the units and words met lately: what a worker needn't work out again.

    A unit is a list of words; words are fewer, as units differ by the punctuation that words carry.
    """

    def __init__(self, words_of, ids_of, limit: int = KEPT_UNITS, chars: int = KEPT_CHARS):
        self.words_of, self.ids_of, self.limit, self.chars = words_of, ids_of, limit, chars
        self.forget_units()
        self.forget_words()

    def forget_units(self) -> None:
        self.units, self.of_unit, self.unit_chars = _Places(), _Ragged(np.int32), 0

    def forget_words(self) -> None:
        self.words, self.of_word, self.word_chars = _Places(), _Ragged(np.int32), 0

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in one array, and how many each has."""
        if len(self.units) > self.limit or self.unit_chars > self.chars:
            self.forget_units()
        if len(self.words) > self.limit or self.word_chars > self.chars:
            self.forget_words()
        places = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            missing = [units[i] for i in unknown.tolist()]
            self._learn(list(dict.fromkeys(missing)))
            places[unknown] = np.fromiter(map(self.units.__getitem__, missing), np.int64, len(missing))
        return self.of_unit.gather(places)

    def _learn(self, new: list[str]) -> None:
        words, counts = self.words_of(new)
        fresh = list(dict.fromkeys(w for w in words if w not in self.words))
        if fresh:
            flat, sizes = self.ids_of(fresh)
            self.words.update(zip(fresh, range(len(self.words), len(self.words) + len(fresh))))
            self.of_word.extend(flat, sizes)
            self.word_chars += sum(map(len, fresh))
        flat, sizes = self.of_word.gather(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(np.array(counts, dtype=np.int64))]
        self.units.update(zip(new, range(len(self.units), len(self.units) + len(new))))
        self.of_unit.extend(flat, np.diff(ends, prepend=0))
        self.unit_chars += sum(map(len, new))

    def of_texts(self, per_text: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given as lists of units, in one array, and how many each text has."""
        ids, sizes = self.ids([u for units in per_text for u in units])
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, per_text)])]
        return ids, np.diff(ends)


class _Places(dict):
    """A number for each key; -1 for unknown ones."""

    def __missing__(self, key: str) -> int:
        return -1


class _Ragged:
    """Lists of numbers end to end, grown by doubling."""

    def __init__(self, kind):
        self.flat, self.used, self.ends, self.n = np.empty(1 << 12, kind), 0, np.zeros(1 << 10, np.int64), 0

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.n + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def gather(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The picked lists, one after another, and their lengths."""
        starts = self.ends[picked]
        sizes = self.ends[picked + 1] - starts
        first = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return self.flat[first + np.arange(len(first))], sizes


class BytePairs:
    """A byte-level BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.first = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        byte_of = {c: b for b, c in letters.items()}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.split = regex.compile(SPLIT)
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.store = IdStore(self._words, self._ids)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        none = np.int64(len(self.keys))
        while len(symbols):
            pair = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[1:] == owner[:-1]), self.ranks[at], none)
            rank = np.append(rank, none)
            begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(owner))))
            active = lowest < none
            if not active.all():
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
                symbols, owner, rank, lowest = symbols[active], owner[active], rank[active], lowest[active]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == lowest)
            # of overlapping occurrences (a a a) the first, third, ... are merged
            fresh = np.concatenate(([True], np.diff(hit) > 1))
            nth = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[nth % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            left = np.ones(len(symbols), dtype=bool)
            left[hit + 1] = False
            symbols, owner = symbols[left], owner[left]
        if done_symbols:
            symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")  # a word's symbols left together, in order
            symbols, owner = symbols[order], owner[order]
        return symbols.astype(np.int32), np.bincount(owner, minlength=len(words))

    def _words(self, units: list[str]) -> tuple[list[str], list[int]]:
        words = [[u] if u in self.special else self.split.findall(u) for u in units]
        return [w for ws in words for w in ws], [len(ws) for ws in words]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(w in self.special for w in words):
            return self.merge([w.encode() for w in words])
        apart = [self.merge([w.encode()]) if w not in self.special else (np.array([self.special[w]]), np.array([1])) for w in words]
        return np.concatenate([a for a, _ in apart]), np.concatenate([n for _, n in apart])

    def _units(self, text: str) -> list[str]:
        if not any(s in text for s in self.special):
            return UNIT.findall(text)
        return [u for part in self.parts.split(text) for u in ([part] if part in self.special else UNIT.findall(part))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has."""
        return self.store.of_texts([self._units(t) for t in texts])

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def encode_texts(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """(doc_id, ids[, decoded]): token ids of every whole text, and the text that they decode to.

    path: a byte-level BPE file of the tokenizers library, the same on every worker. The ids are the
    library's without special tokens added; strings of special tokens inside a text are those tokens.
    Nulls: a null text is empty (no ids), a null doc_id stays. Repeated rows are each encoded; ties don't
    arise. An empty table gives an empty result. Columns beside doc_id and text are not read. A very long
    text is encoded whole. There is no shuffle.
    """

    def run(batches):
        pairs = byte_pairs(path)
        for part, texts in text_chunks(batches):
            ids, counts = pairs.encode([t.decode() for t in texts])
            out, names = [part.column(0), lists(ids, counts, pa.int32())], ["doc_id", "ids"]
            if decode:
                cuts = np.concatenate(([0], np.cumsum(counts))).tolist()
                flat = ids.tolist()
                out.append(pa.array([pairs.decode(flat[a:b]) for a, b in zip(cuts, cuts[1:])], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id bigint, ids array<int>" + ", decoded string" * decode
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
