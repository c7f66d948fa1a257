"""Packing of token ids into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows; the rest of each, longest first, goes into
the open window that it fills best. A segment tree indexed by remaining capacity finds that window: the
smallest capacity, at least the length, that some open window has.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPACES, IdStore
from .common import lean, text_chunks

WINDOW = 2048
#: Ids that a task packs together; bounds its memory. Each block leaves one window short of full at most.
BLOCK_IDS = 6_000_000
#: The least room in a window that is worth a cut of another piece.
WORTH_A_CUT = 16
#: A digit: a token of its own wherever it stands, that no other text gives.
MARK = "0"
#: Settings of the tokenizers whose texts may be cut at white space, lower-cased and split at digits beforehand; fixed values.
CUT_AT_SPACES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "end_of_word_suffix": "</w>",
}
#: What str.split() takes for white space, but Unicode and tokenizers don't.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"
_UNIT = re.compile("[^S]+".replace("S", SPACES))


class Capacities:
    """A segment tree over remaining capacities 0 to size: the tightest open window for a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the window with the least room of length or more; it is closed."""
        node = self.leaves + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.windows[room].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, window


def pack(lengths: list[int], size: int = WINDOW, worth: int = WORTH_A_CUT) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) of documents of these lengths.

    Windows that best fit leaves with worth or more ids of room are filled by cutting pieces of the
    emptiest windows, so that one window at most has that much room in the end.
    """
    out, rest, windows = [], [], 0
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= size:
            out.append((d, at, size, windows, 0))
            windows, at = windows + 1, at + size
        if n > at:
            rest.append((n - at, d, at))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, held = Capacities(size), {}
    for n, d, at in rest:
        found = tree.take(n)
        if found is None:
            room, w, windows = size, windows, windows + 1
            held[w] = []
        else:
            room, w = found
        held[w].append((d, at, n))
        if room > n:
            tree.add(room - n, w)
    # cut the emptiest windows' pieces into the room that the fullest have left
    fill = {w: sum(n for _, _, n in pieces) for w, pieces in held.items()}
    order = sorted((w for w in held if size - fill[w] >= worth), key=lambda w: (-fill[w], w))
    i, j = 0, len(order) - 1
    while i < j:
        room = size - fill[order[i]]
        if room < worth:
            i += 1
            continue
        if not held[order[j]]:
            j -= 1
            continue
        d, at, n = held[order[j]].pop()
        part = min(n, room)
        held[order[i]].append((d, at, part))
        fill[order[i]] += part
        fill[order[j]] -= part
        if part < n:
            held[order[j]].append((d, at + part, n - part))
    w = windows - len(held)
    for pieces in held.values():
        offset = 0
        for d, at, n in pieces:
            out.append((d, at, n, w, offset))
            offset += n
        w += bool(pieces)
    return out


class UnitIds:
    """Ids of texts by the tokenizers library, run on units between white space not met lately only.

    That is right for tokenizers that drop white space and never join or normalise across it; with any
    others, told by their settings, whole texts go through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        spec["end_of_word_suffix"] = spec["model"].get("end_of_word_suffix")
        self.by_units = all(spec[k] == v for k, v in CUT_AT_SPACES.items())
        if not self.by_units:
            return
        mark = self.tokenizer.encode(f"a {MARK} a", add_special_tokens=False).ids
        if len(mark) != 3:
            raise ValueError("the mark must be one token")
        self.mark = mark[1]
        self.store = IdStore(self._words, self._ids)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _holds_special(self, words: list[str]) -> bool:
        joined = " ".join(words)
        return any(s in joined for s in self.special)

    def _words(self, units: list[str]) -> tuple[list[str], list[int]]:
        """A letter is never joined to a full stop or comma after it, and A-Z are lower-cased anyway."""
        words, counts = [], []
        special = self._holds_special(units)
        for u in units:
            tail = u.endswith((".", ",")) and u[-2:-1].isalpha()
            core = u[:-1] if tail else u
            if core.isascii() and not (special and any(s in core for s in self.special)):
                core = core.lower()
            words.append(core)
            if tail:
                words.append(u[-1])
                counts.append(2)
            else:
                counts.append(1)
        return words, counts

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word. Most go through the library as one text, divided by a mark that they don't hold."""
        special = self._holds_special(words)
        # a word of letters alone is one run of tokens, of which the last alone ends a word
        letters, plain, apart = [], [], []
        for i, u in enumerate(words):
            if special and any(s in u for s in self.special):
                apart.append(i)
            elif u.isalpha():
                letters.append(i)
            elif MARK in u:
                apart.append(i)
            else:
                plain.append(i)
        order, flat, sizes = list(apart), [], []
        for i in apart:
            flat.append(np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, dtype=np.int32))
            sizes.append([len(flat[-1])])
        for a in range(0, len(letters), 500):
            some = letters[a : a + 500]
            joined = np.array(self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, dtype=np.int32)
            ends = np.flatnonzero(self.ends_word[joined])
            if len(ends) != len(some):  # some letter is more than that in lower case
                plain.extend(some)
                continue
            order.extend(some)
            flat.append(joined)
            sizes.append(np.diff(ends, prepend=-1))
        for a in range(0, len(plain), 500):
            some = plain[a : a + 500]
            joined = self.tokenizer.encode(f" {MARK} ".join([words[i] for i in some]) + f" {MARK}", add_special_tokens=False).ids
            joined = np.array(joined, dtype=np.int32)
            marks = joined == self.mark
            ends = np.flatnonzero(marks)
            if len(ends) != len(some):
                raise ValueError("the tokenizer joins words across white space")
            order.extend(some)
            flat.append(joined[~marks])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        # back from the order of encoding to that of words
        flat, sizes = np.concatenate(flat), np.concatenate(sizes).astype(np.int64)
        place = np.argsort(np.array(order), kind="stable")
        starts = (np.cumsum(sizes) - sizes)[place]
        sizes = sizes[place]
        return flat[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(len(flat))], sizes

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, each text's followed by end, and how many each has."""
        if not self.by_units:
            found = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32) for t in texts]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.insert(np.concatenate(found), np.cumsum(counts), end), counts + 1
        ids, counts = self.store.of_texts([_UNIT.findall(t) if any(c in t for c in _NOT_SPACE) else t.split() for t in texts])
        return np.insert(ids, np.cumsum(counts), end).astype(np.uint32), counts + 1


@lru_cache(maxsize=2)
def unit_ids(path: str) -> UnitIds:
    return UnitIds(path)


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, path: str, end: int = 1, size: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents packed into sequences of size ids at most; see SCHEMA (and ids, if asked for).

    A task tokenises and packs the rows of its input split, block by block, so nothing is shuffled, and a
    repeated task packs the same way. sequence_id is the split's number and a count in it; it is unique and
    has gaps. Nulls: a null text is empty and packed as its end id; a null doc_id stays. Repeated rows are
    each packed. Ties in length fall to the earlier row. An empty table gives an empty result. Columns
    beside doc_id and text are not read. A very long text is cut into full windows.
    """

    def run(batches):
        encoder, place, used = unit_ids(path), TaskContext.get().partitionId() << 32, 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def flush():
            nonlocal used, held
            ids, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            doc_ids = [d for h in held for d in h[2]]
            held = []
            first = np.concatenate(([0], np.cumsum(counts)))
            pieces = pack(counts.tolist(), size)
            windows = 1 + max(p[3] for p in pieces)
            for a in range(0, len(pieces), 20_000):
                part = pieces[a : a + 20_000]
                data = [ids[first[d] + s : first[d] + s + n] for d, s, n, _, _ in part]
                columns = [
                    pa.array([doc_ids[p[0]] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in data], pa.int64()), pa.array(counts[[p[0] for p in part]], pa.int64()),
                    pa.array([place + used + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in data], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)
            used += windows

        total = 0
        for part, texts in text_chunks(batches):
            ids, counts = encoder.encode([t.decode() for t in texts], end)
            held.append((ids.astype("<u4"), counts, part.column(0).to_pylist()))
            total += len(ids)
            if total >= BLOCK_IDS:
                yield from flush()
                total = 0
        if held:
            yield from flush()

    schema = SCHEMA + ", ids array<int>" * with_ids
    names = [f.split()[0] for f in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)
