"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the weights of its words' features; a document's is their noisy-or,
so it is toxic if any sentence is. Training sees document labels only, and the gradient finds the guilty
sentences. Features of a word are the word itself and its first and last letters, so inflected and
compound forms of a learnt word count as well.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_chunks

#: Words and sentence ends, in lower-cased text.
_TOKENS = re.compile(r"[^\W_]+|[.!?…。！？\n]+")


@dataclass(frozen=True)
class ToxicityModel:
    """weights: by feature; bias: of a sentence; leak: chance of a document that no sentence explains."""

    weights: dict[str, float]
    bias: float
    leak: float


@dataclass(frozen=True)
class Training:
    """sample: most documents of each label that are fitted on (those with the least hashes of their ids). longest: of each,
    texts of more characters are left out of the sample, so it is bounded in bytes too; all texts are scored whole.

    Fitting on a bounded sample keeps the driver's work the same at every size of the corpus.
    """

    sample: int = 3000
    longest: int = 200_000
    min_documents: int = 4
    rounds: int = 150
    rate: float = 0.25
    shrink: float = 2e-4


def word_features(word: str) -> list[str]:
    out = [word]
    out.extend("^" + word[:n] for n in (4, 5, 6, 7) if len(word) > n)
    out.extend(word[-n:] + "$" for n in (4, 5, 6) if len(word) > n)
    return out


def _sentences(text: str) -> list[list[str]]:
    out, now = [], []
    for t in _TOKENS.findall(text.lower()):
        if t[0].isalnum():
            now.append(t)
        elif now:
            out.append(now)
            now = []
    if now:
        out.append(now)
    return out


def fit(texts: list[str], labels: list[int], how: Training = Training()) -> ToxicityModel:
    """Maximise the likelihood of document labels under noisy-or, with L1 shrinkage, by Adam in numpy."""
    y = np.array(labels, dtype=float)
    if not len(texts) or y.min() == y.max():
        return ToxicityModel({}, -12.0, float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 0.4)))
    # occurrences name words, and words name features: the large arrays have one entry for each occurrence
    names: dict[str, int] = {}
    seen, owner, n = Counter(), [], 0
    word_of, sentence_of = array("i"), array("i")
    for d, text in enumerate(texts):
        for words in _sentences(text):
            word_of.extend([names.setdefault(w, len(names)) for w in words])
            sentence_of.extend([n] * len(words))
            owner.append(d)
            n += 1
        seen.update({f for w in set(_TOKENS.findall(text.lower())) if w[0].isalnum() for f in word_features(w)})
    index = {f: i for i, f in enumerate(sorted(f for f, k in seen.items() if k >= how.min_documents))}
    feature, word = array("i"), array("i")
    for w, k in names.items():
        have = [index[f] for f in word_features(w) if f in index]
        feature.extend(have)
        word.extend([k] * len(have))
    word_of, sentence_of, feature, word = (np.array(x, dtype=np.int64) for x in (word_of, sentence_of, feature, word))
    owner, m, total = np.array(owner, dtype=np.int64), len(index), len(names)
    del names, seen
    w, b, leak = np.zeros(m), -6.0, 1e-3
    m1, m2, b1, b2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for t in range(1, how.rounds + 1):
        per_word = np.bincount(word, weights=w[feature], minlength=total)
        z = b + np.bincount(sentence_of, weights=per_word[word_of], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        quiet = -np.bincount(owner, weights=np.logaddexp(0, np.clip(z, -30, 30)), minlength=len(y)) + np.log1p(-leak)
        chance = np.clip(-np.expm1(quiet), 1e-9, 1)
        pull = np.where(y > 0, -(1 - chance) / chance, 1.0) * share
        gz = pull[owner] * p
        of_word = np.bincount(word_of, weights=gz[sentence_of], minlength=total)
        g = np.bincount(feature, weights=of_word[word], minlength=m) / len(y) + how.shrink * np.sign(w)
        gb = gz.sum() / len(y)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        step = how.rate * (1 - 0.8 * t / how.rounds)
        w -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
        b = min(-4.0, b - step * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-6))
    return ToxicityModel({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, float(b), leak)


def sample_labelled(docs: DataFrame, labels: DataFrame, usable: Column, how: Training = Training()) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded sample, in the order of their ids' hashes."""
    picked = None
    rows = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    for value in (0, 1):
        some = rows.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.sample)
        picked = some if picked is None else picked.union(some)
    # 2 * sample rows of two numbers: a proven bound
    found = docs.select("doc_id", "text").where(F.length("text") <= how.longest).join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic").collect()
    return [r.text for r in found], [r.toxic for r in found]


class _Weights(dict):
    """Weight of each word met, from the features' weights; about 150,000 words of at most 64 characters are kept, longer ones never."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.features = weights

    def __missing__(self, word: str) -> float:
        get = self.features.get
        value = sum(get(f, 0.0) for f in word_features(word)) if word[0].isalnum() else np.nan
        if len(word) > 64:
            return value
        if len(self) > 150_000:
            self.clear()
        self[word] = value
        return value


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.words = model, _Weights(model.weights)

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
        """Score of each text, and of each the sentences' probabilities."""
        out, parts = np.empty(len(texts)), []
        quiet = np.log1p(-self.model.leak)
        for i, text in enumerate(texts):
            tokens = _TOKENS.findall(text.lower())
            p = np.empty(0)
            total = quiet
            if tokens:
                w = np.fromiter(map(self.words.__getitem__, tokens), float, len(tokens))
                stop = np.isnan(w)
                sentence = np.cumsum(stop)[~stop]
                if len(sentence):
                    starts = np.flatnonzero(np.concatenate(([True], np.diff(sentence) > 0)))
                    z = np.clip(self.model.bias + np.add.reduceat(w[~stop], starts), -30, 30)
                    total = quiet - np.logaddexp(0, z).sum()
                    p = 1 / (1 + np.exp(-z))
            out[i] = min(1.0, max(0.0, -np.expm1(total)))
            parts.append(p)
        return out, parts

    def offending(self, text: str, at: float = 0.5) -> list[dict]:
        """The sentences of a text with a probability of at or more, by code points."""
        found, words, first, last = [], 0.0, None, 0
        lowered = text.lower()
        places = None
        if len(lowered) != len(text):  # lower-casing lengthens some letters: where each code point of the text begins
            places = list(accumulate((len(c.lower()) for c in text), initial=0))

        def close():
            p = 1 / (1 + np.exp(-np.clip(self.model.bias + words, -30, 30)))
            if first is not None and p >= at:
                a, b = (first, last) if places is None else (bisect_right(places, first) - 1, bisect_left(places, last))
                found.append({"start": a, "end": b, "score": float(p)})

        for m in _TOKENS.finditer(lowered):
            value = self.words[m.group()]
            if np.isnan(value):
                close()
                words, first = 0.0, None
            else:
                words, first, last = words + value, m.start() if first is None else first, m.end()
        close()
        return found


SCHEMA = "doc_id bigint, score double, predicted int, n_sentences int, offending array<struct<start:int,end:int,score:double>>"


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score and offending sentences of every whole text; no shuffle, the model goes with the task.

    Nulls: a null text is empty and scores the leak, as does any text without words; a null doc_id stays.
    Repeated rows are each scored; ties don't arise. An empty table gives an empty result. Columns beside
    doc_id and text are not read. A very long text is scored whole, sentence by sentence.
    """

    def run(batches):
        scorer = Scorer(model)
        for part, texts in text_chunks(batches):
            texts = [t.decode() for t in texts]
            scores, parts = scorer.score(texts)
            spans = [scorer.offending(t) if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, parts)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array([len(p) for p in parts], pa.int32()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
                ],
                names=["doc_id", "score", "predicted", "n_sentences", "offending"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs that score under 0.5, all columns unchanged.

    Null and empty texts score the leak and stay, as do null ids; repeated rows are each judged; further columns may have any
    name. An empty table gives an empty result.
    """

    def run(batches):
        scorer = Scorer(model)
        for part, texts in text_chunks(batches):
            yield part.filter(pa.array(scorer.score([t.decode() for t in texts])[0] < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
