"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over many texts at once, mark the characters that lie
inside n-grams and lines a text repeats. A longer n-gram can only be repeated where its shorter prefix
is, so each length is looked for only where the length before was found: one full sort, then small ones.
Two kinds of n-grams are measured: of words, and of marks (characters that are no letters, digits or space),
which catches what is repeated inside words, as markup, drawn lines and shouting are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _U, grams, lean, mix64, text_chunks


@dataclass(frozen=True)
class RepetitionRules:
    """A text is rejected if a share of its word characters lies inside repeated units.

    ngram_share: (n, largest share of characters inside n-grams that occur twice or more). These and line_share are
    fitted on labelled good documents that pass the base rule: a thousandth of them has more than 0.293 (lines 0.147) on
    the check tool's small table, and none on sf0.1 has more than 0.276 (lines 0.138).
    line_share: largest share of characters inside lines equal to an earlier line.
    mark_share: marks inside 2-grams of marks, and marks that are words of their own, as a share of all word characters,
    counted where that 2-gram or word occurs twice or more in the text.
    """

    min_words: int = 50
    repeat_percent: int = 50
    ngram_share: tuple[tuple[int, float], ...] = ((5, 0.34), (6, 0.33), (7, 0.32), (8, 0.31), (9, 0.30), (10, 0.30))
    line_share: float = 0.18
    mark_share: float = 0.05


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_chars bigint, dup_gram_chars array<bigint>, dup_mark_chars bigint"
)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: ASCII characters that are no letters, digits, control characters or space.
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def _twice(keys: np.ndarray) -> np.ndarray:
    """Flags of the keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    hit = np.zeros(len(keys), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return hit


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Flags of the words inside [start, start + n) for any start."""
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[bytes], rules: RepetitionRules) -> dict[str, np.ndarray]:
    """Counts of each text; see RepetitionRules and SCHEMA."""
    w = Words(texts)
    docs, total = len(texts), len(w.start)
    chars = w.chars
    upto = np.concatenate(([0], np.cumsum(chars)))
    symbols = np.flatnonzero(_SYMBOL[w.data])
    out = {
        "n_words": np.diff(w.bounds),
        "word_chars": upto[w.bounds[1:]] - upto[w.bounds[:-1]],
        "n_symbols": np.bincount(np.searchsorted(w.first, symbols, side="right") - 1, minlength=docs),
    }
    # lines: the texts are joined by \n, so every line ends at one
    ends = np.flatnonzero(w.data == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    left, right = np.searchsorted(w.start, begins), np.searchsorted(w.start, ends)
    wordy = right > left
    ends, begins, solid = ends[wordy], begins[wordy], (upto[right] - upto[left])[wordy]
    owner = np.searchsorted(w.first, begins, side="right") - 1
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w.raw[a:e]) for a, e in zip(begins.tolist(), ends.tolist())), _U, len(begins))
    order = np.lexsort((begins, keys, owner))
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = np.bincount(owner[again], minlength=docs)
    out["dup_line_chars"] = np.bincount(owner[again], weights=solid[again], minlength=docs).astype(np.int64)
    # 2-grams of marks, and marks between spaces
    marks = _MARK[w.data]
    pairs = np.flatnonzero(marks[1:] & marks[:-1])
    alone = w.start[w.end - w.start == 1]
    alone = alone[marks[alone]]
    at = np.concatenate((pairs, alone))
    second = np.concatenate((w.data[pairs + 1], np.zeros(len(alone), np.uint8))).astype(np.int64)
    owner = np.searchsorted(w.first, at, side="right") - 1
    again = _twice((owner << 16) | (w.data[at].astype(np.int64) << 8) | second)
    at = np.unique(np.concatenate((at[again], at[again & (second > 0)] + 1)))
    out["dup_mark_chars"] = np.bincount(np.searchsorted(w.first, at, side="right") - 1, minlength=docs)
    # n-grams: three words for the base rule, then the longer ones where the shorter repeat
    salt = mix64(w.doc.astype(_U) + _U(1))
    at = np.flatnonzero(w.doc[2:] == w.doc[:-2]) if total > 2 else np.empty(0, dtype=np.int64)
    gram = grams(w.hash, 3)
    at = at[_twice(gram[at] ^ salt[at])] if len(at) else at
    inside = _covered(at, 3, total)
    out["n_repeat_words"] = np.bincount(w.doc[inside], minlength=docs)
    shares = []
    for n, _ in rules.ngram_share:
        at = at[at + n <= total]
        at = at[w.doc[at + n - 1] == w.doc[at]]
        if len(at):
            key = salt[at]
            for i in range(n):
                key = key * _U(0xD1342543DE82EF95) + w.hash[at + i]
            at = at[_twice(mix64(key))]
        inside = _covered(at, n, total)
        shares.append(np.bincount(w.doc[inside], weights=chars[inside], minlength=docs).astype(np.int64))
    out["dup_gram_chars"] = np.array(shares).reshape(len(rules.ngram_share), docs).T
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_percent * out["n_words"])
    room = np.array([s for _, s in rules.ngram_share])[None, :] * out["word_chars"][:, None]
    over = (out["dup_gram_chars"] > room).any(axis=1) | (out["dup_line_chars"] > rules.line_share * out["word_chars"])
    over |= out["dup_mark_chars"] > rules.mark_share * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~over
    return out


def repetition_quality(docs: DataFrame, rules: RepetitionRules = RepetitionRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs with its counts and verdict; no shuffle.

    Nulls: a null text is empty (no words, base_failed); a null id stays null. Repeated rows are each
    judged. Ties do not arise. An empty table gives an empty result. Other columns are not read. A very
    long text is handled whole; it costs some numbers for each of its words.
    """

    def judge(batches):
        for part, texts in text_chunks(batches):
            m = measure(texts, rules)
            flat = np.ascontiguousarray(m["dup_gram_chars"]).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), *(pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    pa.array(m["base_failed"]), pa.array(m["kept"]), pa.array(m["dup_line_chars"], pa.int64()),
                    pa.FixedSizeListArray.from_arrays(pa.array(flat, pa.int64()), len(rules.ngram_share)).cast(pa.list_(pa.int64())),
                    pa.array(m["dup_mark_chars"], pa.int64()),
                ],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(judge), SCHEMA)


def keep_good(docs: DataFrame, rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of docs that pass, all columns unchanged. Judged in the same pass, so nothing is joined.

    Rows with a null or empty text fail, as do those with too few words; null ids, repeated rows and further columns of
    any name are kept as they are. An empty table gives an empty result.
    """

    def keep(batches):
        for part, texts in text_chunks(batches):
            yield part.filter(pa.array(measure(texts, rules)["kept"]))

    return docs.mapInArrow(lean(keep), docs.schema)
