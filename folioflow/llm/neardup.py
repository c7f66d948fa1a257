"""Near-duplicate classes by bottom-k sketches of one hash function.

1. A text's shingles are hashed once; the set's k smallest hashes are its sketch, and a digest of the
   whole set collapses equal sets to one class, so copies cost one row each and no pairs.
2. Inverted lists of retained values propose pairs. Two sets at the threshold share at least `overlap` of
   their retained values but for a vanishing chance, so they share one of each other's
   (size - overlap + 1) rarest ones: only those are listed, and common values drop out of the lists.
3. In every list all members pair with its hub, the member with the most values in common with others;
   the union sketch (the k smallest of both sketches) estimates the similarity and filters, and exact
   Jaccard on the full sets, recomputed from the texts of the proposed classes only, decides.
4. What remains are members outside their hub's component. They probe the lists' other members, dealt out
   in blocks of bounded size, by the same three tests, and report one link for each component they meet.
   So no group emits its pairs, and none meets in one task, yet every listed pair has been decided.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _U, Words, durable, free_name, grams, lean, lists, mix64, text_chunks
from .graph import connected_components


@dataclass(frozen=True)
class NearDup:
    """shingle: words of a shingle. percent: least 100 * intersection / union of a link.

    keep: retained values of a set. overlap: retained values that linked sets share at least; at 0.8 the
    chance to share fewer than 20 of 40 is 6 in a million. block: shingles of the members that one
    task holds at a time.
    """

    shingle: int = 5
    percent: int = 80
    keep: int = 40
    overlap: int = 20
    block: int = 1 << 17


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of n words, A-Z lower-cased.

    A text with fewer words than n has its whole sequence as one shingle; one without words has none.
    """
    w = Words(texts, fold_case=True)
    runs = grams(w.hash, n)
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            whole = _U(0)
            for h in w.hash[a:b]:
                whole = mix64(np.array([whole ^ h], dtype=_U))[0]
            out.append(np.array([whole], dtype=_U))
        else:
            out.append(np.empty(0, dtype=_U))
    return out


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sketches(docs: DataFrame, p: NearDup) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch) of every row."""

    def run(batches):
        for part, texts in text_chunks(batches):
            sets = shingle_sets(texts, p.shingle)
            low = [s[: p.keep] for s in sets]
            flat = np.concatenate(low).view(np.int64) if low else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                    lists(flat, np.array([len(s) for s in low], dtype=np.int64), pa.int64()),
                ],
                names=["doc_id", "n_shingles", "digest", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, n_shingles bigint, digest binary, sketch array<bigint>")


def full_sets(docs: DataFrame, p: NearDup) -> DataFrame:
    """(digest, shingles) of every row of (digest, text)."""

    def run(batches):
        for part, texts in text_chunks(batches):
            sets = shingle_sets(texts, p.shingle)
            # a doc_id that stands for several texts has brought them all
            own = pa.array([_digest(s) for s in sets], pa.binary())
            right = pa.compute.equal(own, part.column(0)).to_pylist()
            part, sets = part.filter(pa.array(right)), [s for s, x in zip(sets, right) if x]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists(flat, np.array([len(s) for s in sets], dtype=np.int64), pa.int64())], names=["digest", "shingles"]
            )

    return docs.select("digest", "text").mapInArrow(lean(run), "digest binary, shingles array<bigint>")


def _prefixes(classes: DataFrame, p: NearDup) -> DataFrame:
    """(value, digest, rep, n, common): the rarest retained values of each class that another class retains too."""
    values = classes.select("digest", "rep", "n", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    rows = values.join(shared, "value")
    own = Window.partitionBy("digest")
    size = F.least("n", F.lit(p.keep))
    # a set so small that every partner's whole set is retained needs the exact share of it
    need = F.when(F.col("n") * 100 <= p.keep * p.percent, F.ceil(F.col("n") * (p.percent / 100) - 1e-9)).otherwise(F.lit(p.overlap))
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy("df", "value"))).withColumn("common", F.count("*").over(own))
    # values that no other class retains are the rarest and come first
    return rows.where(F.col("rank") <= size - need + 1 - (size - F.col("common"))).select("value", "digest", "rep", "n", "common")


def _fits(a: str, b: str, p: NearDup):
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * p.percent)


def _sets_of(wanted: DataFrame, docs: DataFrame, p: NearDup) -> DataFrame:
    """(digest, shingles) of the wanted classes (digest, doc_id), from the texts of those documents alone."""
    sets = durable(full_sets(docs.join(wanted.hint("merge"), "doc_id").select("digest", "text"), p), gathered=True)
    if sets.groupBy("digest").count().where("count > 1").isEmpty():  # no repeated rows: nothing to shuffle
        return sets
    return durable(sets.dropDuplicates(["digest"]), gathered=True)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, p: NearDup) -> tuple[DataFrame, DataFrame]:
    """(a, b) of the rows of (da, a, db, b), classes by digest and document, that are similar enough; and the sets used."""
    side = classes.select("digest", "sketch")
    est = (
        pairs.join(side.select(F.col("digest").alias("da"), F.col("sketch").alias("sa")), "da")
        .join(side.select(F.col("digest").alias("db"), F.col("sketch").alias("sb")), "db")
        .withColumn("low", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, p.keep))
        .withColumn("both", F.size(F.array_intersect("low", F.array_intersect("sa", "sb"))))
        # below the bound only with the chance stated at NearDup.overlap; small unions are exact here
        .where(F.when(F.size("low") < p.keep, F.col("both") * 100 >= F.size("low") * p.percent).otherwise(F.col("both") >= p.overlap))
        .select("da", "a", "db", "b")
    )
    est = durable(est, gathered=True)
    sets = _sets_of(est.select(F.col("da").alias("digest"), F.col("a").alias("doc_id")).union(est.select("db", "b")).distinct(), docs, p)
    joined = est.join(sets.select(F.col("digest").alias("db"), F.col("shingles").alias("xb")), "db").join(
        sets.select(F.col("digest").alias("da"), F.col("shingles").alias("xa")), "da"
    )
    inter = F.size(F.array_intersect("xa", "xb"))
    links = joined.where(inter * 100 >= (F.size("xa") + F.size("xb") - inter) * p.percent).select("a", "b").distinct()
    return links, sets


class _Block:
    """Members of one block, with inverted lists of their retained values and, if whole, of all shingles."""

    def __init__(self, rows: list, p: NearDup, whole: bool):
        self.p, self.whole = p, whole
        self.digest, self.rep, self.label, self.n, self.sets = zip(*rows)
        self.rep, self.label, self.n = (np.array(x, dtype=np.int64) for x in (self.rep, self.label, self.n))
        self.low = self._index([s[: p.keep] for s in self.sets])
        self.all, self.told = None, np.zeros(len(rows), dtype=bool)

    @staticmethod
    def _index(sets: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All values in order, with the set that each is from and its place there (from 1)."""
        values, lengths = np.concatenate(sets), np.fromiter(map(len, sets), np.int64, len(sets))
        owners = np.repeat(np.arange(len(sets)), lengths)
        places = np.arange(1, len(values) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        order = np.argsort(values, kind="stable")
        return values[order], owners[order], places[order]

    def _shared(self, index: tuple, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each value that a member shares with the probe: the member, the place there, the probe's place."""
        values, owners, places = index
        a, b = np.searchsorted(values, probe, "left"), np.searchsorted(values, probe, "right")
        lengths = b - a
        at = np.repeat(a - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return owners[at], places[at], np.repeat(np.arange(1, len(probe) + 1), lengths)

    def probe(self, label: int, n: int, shingles: np.ndarray) -> np.ndarray:
        """Flags of the members outside the probe's component that are similar enough: by sketch, then, if whole, exactly."""
        p, low = self.p, shingles[: self.p.keep]
        member, place, own = self._shared(self.low, low)
        both = np.bincount(member, minlength=len(self.sets))
        size = np.minimum(self.n, n)
        need = np.where(size * 100 <= p.keep * p.percent, -(-size * p.percent // 100), p.overlap)
        maybe = (both >= need) & (self.label != label) & (size * 100 >= np.maximum(self.n, n) * p.percent)
        if not maybe.any():
            return maybe
        # a shared value's rank in the union of both sketches: values up to it here and there, shared ones once
        order = np.argsort(member, kind="stable")
        member, place, own = member[order], place[order], own[order]
        rank = place + own - (np.arange(1, len(member) + 1) - np.searchsorted(member, member))
        retained = np.bincount(member[rank <= p.keep], minlength=len(self.sets))
        union = np.minimum(self.n, p.keep) + len(low) - both
        maybe &= np.where(union < p.keep, both * 100 >= union * p.percent, retained >= p.overlap)
        if self.whole and maybe.any():
            if self.all is None:
                self.all = self._index(self.sets)
            inter = np.bincount(self._shared(self.all, shingles)[0], minlength=len(self.sets))
            maybe &= inter * 100 >= (self.n + n - inter) * p.percent
        return maybe


def _blocks(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """rows (home, digest, apart, ...) dealt to blocks of each home: member tells where a row is held, probe
    where it asks. A home that is one block gets every row once; else those apart ask every block."""
    homes = rows.groupBy("home").agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"), F.max("apart").alias("any")).where("any").drop("any")
    rows = rows.join(homes, "home").withColumn("own", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
    asked = F.when(F.col("apart"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    rows = rows.withColumn("block", F.explode(asked)).withColumn("member", F.col("block") == F.col("own"))
    rows = rows.select("home", "block", "member", F.col("apart").alias("probe"), "digest", "rep", "label", "n", "values")
    return rows.repartition("home", "block").sortWithinPartitions("home", "block", F.desc("member"))


def _ask(dealt: DataFrame, p: NearDup, whole: bool, answer, schema: str) -> DataFrame:
    """answer(block, probe's row, flags of the members that fit it) yields rows of schema for every probe that some fit."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.binary() if f.endswith("binary") else pa.int64() for f in schema.split(", ")]

    def run(batches):
        at, members, waiting, block, found = None, [], [], None, []

        def ask(row):
            nonlocal block
            block = block or _Block(members, p, whole)
            fit = block.probe(row[2], row[3], row[4])
            if fit.any():
                found.extend(answer(block, row, fit))

        for batch in batches:
            home, part, member, probe, digest, rep, label, n = (batch.column(i).to_pylist() for i in range(8))
            values = batch.column(8)
            flat, cuts = values.flatten().to_numpy().view(_U), values.offsets.to_numpy() - values.offsets[0].as_py()
            for i in range(batch.num_rows):
                if (home[i], part[i]) != at:
                    for row in waiting:
                        ask(row)
                    at, members, waiting, block = (home[i], part[i]), [], [], None
                row = (digest[i], rep[i], label[i], n[i], flat[cuts[i] : cuts[i + 1]].copy())
                if member[i]:
                    members.append(row)
                    if probe[i]:
                        waiting.append(row)
                elif members:
                    ask(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
                found = []
        for row in waiting:
            ask(row)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    return dealt.mapInArrow(lean(run), schema)


def _probed(lists_: DataFrame, hubs: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, full: DataFrame, p: NearDup) -> DataFrame:
    """(a, b): links of the members outside their list's hub's component; at least one to each component.

    First by sketches alone, which tells who can be linked at all; full sets are made for those only, and
    only where full has none yet.
    """
    hub_label = _named(hubs.where("m > 2").select("value", F.col("hub.digest").alias("hub_digest"), F.col("hub.rep").alias("rep")), labels)
    hub_label = hub_label.select("value", "hub_digest", F.col("label").alias("home"))
    # hubs have been held against their lists; other members can be linked only where they differ still
    named = durable(_named(lists_.select("value", "digest", "rep", "n").join(hub_label, "value").where("digest <> hub_digest"), labels), gathered=True)
    mixed = named.groupBy("value").agg((F.min("label") != F.max("label")).alias("open")).where("open").select("value")
    named = named.join(mixed, "value").select("home", "digest", "rep", "n", "label").distinct()
    named = durable(named.withColumn("apart", F.col("home") != F.col("label")), gathered=True)
    light = named.join(classes.select("digest", F.col("sketch").alias("values")), "digest")

    def both_sides(block, row, fit):
        yield row[0], row[1]
        for i in np.flatnonzero(fit & ~block.told):
            yield block.digest[i], int(block.rep[i])
        block.told |= fit

    dealt = _blocks(light.withColumn("one", F.lit(1)), "one", p.block // p.keep)
    near = durable(_ask(dealt, p, False, both_sides, "digest binary, doc_id bigint").distinct(), gathered=True)
    new = durable(near.join(full, "digest", "left_anti"), gathered=True)
    sets = full.join(near.select("digest"), "digest", "left_semi")
    if not new.isEmpty():
        sets = sets.union(_sets_of(new, docs, p))
    heavy = named.join(sets.withColumnRenamed("shingles", "values"), "digest")

    def links(block, row, fit):
        linked = np.flatnonzero(fit)
        for i in np.unique(block.label[linked], return_index=True)[1]:
            yield row[1], int(block.rep[linked[i]])

    return _ask(_blocks(heavy, "n", p.block), p, True, links, "a bigint, b bigint").distinct()


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own included. Nulls: a null text is
    empty; rows with a null doc_id are returned unlinked, with a null component_id, and kept. Empty texts
    and texts without words are linked with nothing. Repeated rows and equal texts share their component
    and each keep their row (kept is true for every row that bears the smallest id). Ties between equal
    document frequencies fall to the smaller hash value. An empty table gives an empty result. Columns
    beside doc_id and text are not read. A very long text is one set, however large.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = durable(sketches(docs, p))
    sets = rows.where("n_shingles > 0 and doc_id is not null")
    first = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = durable(
        sets.withColumnRenamed("doc_id", "rep").join(first, ["digest", "rep"])
        .select("digest", "rep", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["digest"]),
        gathered=True,
    )
    # a doc_id that stands for several different texts joins their classes
    same = sets.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("doc_id")
    tied = sets.join(same, "doc_id").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    lists_ = durable(_prefixes(classes, p), gathered=True)
    # a list's hub is the member with the most retained values that others retain as well
    hubs = durable(lists_.groupBy("value").agg(F.min(F.struct(-F.col("common"), "rep", "digest", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1"), gathered=True)
    lists_ = lists_.join(hubs.select("value"), "value")
    pairs = (
        lists_.join(hubs, "value").where("digest <> hub.digest").where(_fits("n", "hub.n", p))
        .select(F.col("hub.digest").alias("da"), F.col("hub.rep").alias("a"), F.col("digest").alias("db"), F.col("rep").alias("b")).distinct()
    )
    found, full = _verified(pairs, classes, docs, p)
    edges = durable(found.union(tied), gathered=True)
    labels = connected_components(edges)
    more = durable(_probed(lists_, hubs, labels, classes, docs, full, p), gathered=True)
    if not more.isEmpty():
        labels = connected_components(edges.union(more))
    label_of = _named(classes.select("digest", "rep"), labels).select("digest", F.col("label").alias("component"))
    out = rows.drop("sketch").join(label_of, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, each once; all columns are kept.

    Rows with a null doc_id stay, as do empty and null texts. Of several rows with one doc_id, the one with the least text
    stays. Columns may have any names. An empty table gives an empty result.
    """
    found = near_duplicates(docs, p)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = durable(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id"), gathered=True)
    if again.isEmpty():
        return left
    order = Window.partitionBy("doc_id").orderBy("text")
    nth = free_name(docs.columns, "nth")
    once = left.join(again, "doc_id", "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).union(once)
