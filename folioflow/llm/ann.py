"""Approximate nearest neighbours by inner product, with additive quantisation.

A vector is the sum of one entry of each of several full-dimensional codebooks, fitted to residuals one
after another and chosen by beam search. Its codes, its norm and the norm of the sum are kept. A query's
inner products with all entries are one small table; a candidate's score is a few lookups in it, scaled by
the stored norms. Each query's best candidates of all are reranked by exact inner products in double precision.

Codes meet queries in blocks (a part of the vectors x a part of the queries) of bounded size, dealt by the
hash of their ids, so the copies of one vector are spread over all blocks. Only codes and norms, some 30 bytes
a vector, go to all parts of the queries; whole vectors go only where a candidate is reranked, which is a
bounded number of times a vector, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable


@dataclass(frozen=True)
class AdditiveQuantiser:
    """books: (codebooks, entries, dimensions)."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        """Codes of the sums closest to the vectors x that a beam search finds."""
        n, (m, k, d) = len(x), self.books.shape
        codes = np.zeros((n, 1, 0), dtype=np.int16)
        rest = x[:, None, :].astype(np.float32)
        for book in self.books:
            norms = (book * book).sum(axis=1)
            # distance of each kept residual to each entry, less what all entries share with it
            cost = (rest * rest).sum(axis=2)[:, :, None] - 2 * rest @ book.T + norms
            flat = cost.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            order = np.take_along_axis(flat, best, axis=1).argsort(axis=1, kind="stable")
            best = np.take_along_axis(best, order, axis=1)
            parent, entry = best // k, best % k
            codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], axis=1), entry[:, :, None].astype(np.int16)), axis=2)
            rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[entry]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, j]] for j, book in enumerate(self.books))


@dataclass(frozen=True)
class Search:
    """sample: most vectors that the codebooks are fitted on (those with the least hashes of their ids).

    books, entries (256 at most), beam: of the quantiser. rerank: candidates of a query that are reranked exactly. rows
    and queries: most vectors and queries in a block of codes; spread: blocks on either side, if there are as many
    thousands. whole and asking: vectors and queries in a block of exact scores, about.
    """

    k: int = 20
    sample: int = 8192
    books: int = 20
    entries: int = 128
    beam: int = 4
    rerank: int = 800
    rows: int = 1 << 20
    queries: int = 1 << 16
    spread: int = 8
    whole: int = 1 << 14
    asking: int = 1 << 12
    rounds: int = 8


def fit(x: np.ndarray, p: Search, seed: int = 7) -> AdditiveQuantiser:
    """Codebooks by k-means on the residuals, one after another; deterministic."""
    rng = np.random.default_rng(seed)
    rest, books = x.astype(np.float32), []
    d = x.shape[1]
    for _ in range(p.books):
        k = min(p.entries, max(1, len(rest)))
        centres = rest[rng.choice(len(rest), k, replace=False)] if len(rest) else np.zeros((1, d), np.float32)
        for _ in range(p.rounds if len(rest) else 0):
            own = ((centres * centres).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, rest)
            sizes = np.bincount(own, minlength=k)[:, None]
            centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
        if k < p.entries:
            centres = np.concatenate((centres, np.zeros((p.entries - k, d), np.float32)))
        books.append(centres)
        rest = rest - centres[((centres * centres).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)] if len(rest) else rest
    return AdditiveQuantiser(np.stack(books))


def _usable(df: DataFrame) -> DataFrame:
    """(id, v): vectors without null or non-finite components that aren't zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col("vec_id").cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null")
        .where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    )


def _matrix(column, d: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), d)


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties to the earlier place."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))


def search_block(quantiser: AdditiveQuantiser, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, qid: np.ndarray, q: np.ndarray, keep: int):
    """(query's place, row, score) of the keep best of each query in one block, by lookups; rows by id and never the query's own."""
    m, k, _ = quantiser.books.shape
    flat = np.ascontiguousarray(codes.T).astype(np.int32) + (np.arange(m, dtype=np.int32) * k)[:, None]
    books = quantiser.books.reshape(m * k, -1).T
    step = max(1, (1 << 22) // max(1, len(ids)))
    for a in range(0, len(q), step):
        tables = (q[a : a + step].astype(np.float32) @ books).astype(np.float32)
        score = np.zeros((len(tables), len(ids)), dtype=np.float32)
        for j in range(m):
            score += tables[:, flat[j]]
        score *= scale
        for i in range(len(tables)):
            row = score[i]
            row[ids == qid[a + i]] = -np.inf
            near = top(row, keep)
            near = near[row[near] > -np.inf]
            yield a + i, near, row[near]


def _parts(n: int, most: int, spread: int) -> int:
    return max(-(-n // most), min(-(-n // 1024), spread))


def _blocks(batches):
    """Rows of each (part, qpart), whole, from batches sorted by these first two columns."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = (int(keys[0, a]), int(keys[1, a]))
            if key != at and held:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _side(table: pa.Table, side: int) -> dict:
    rows = table.filter(pa.compute.equal(table.column("side"), side)).combine_chunks()
    return {n: rows.column(n).combine_chunks() for n in rows.column_names}


def _numbered(base: DataFrame) -> DataFrame:
    """base (id, v) with nth, which tells rows of one id apart."""
    again = durable(base.groupBy("id").agg(F.count("*").alias("times")).where("times > 1").select("id"))
    if again.isEmpty():
        return base.withColumn("nth", F.lit(0))
    order = F.row_number().over(Window.partitionBy("id").orderBy("v")).cast("int") - 1
    return base.join(again, "id", "left_anti").withColumn("nth", F.lit(0)).union(base.join(again, "id", "left_semi").withColumn("nth", order))


def nearest(vectors: DataFrame, queries: DataFrame, p: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product with each query, but those of its id.

    vectors and queries: (vec_id, embedding). Nulls: rows with a null id, and vectors that are null, zero,
    of another length than most of the sample, or hold null or non-finite components, take no part. Ties go to
    the smaller vec_id; rows of one id each count as candidates, and of queries of one id the least vector
    asks. An empty table gives an empty result. Columns beside vec_id and embedding are not read.
    """
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    spark = vectors.sparkSession
    base = _usable(vectors)
    found = base.orderBy(F.xxhash64("id"), "id", "v").limit(p.sample).select("v").collect()
    if not found:
        return spark.createDataFrame([], schema)
    lengths = [len(r.v) for r in found]
    d = max(set(lengths), key=lambda n: (lengths.count(n), n))
    quantiser = fit(np.array([r.v for r in found if len(r.v) == d]), p)
    m = len(quantiser.books)

    def encode(batches):
        for batch in batches:
            x = _matrix(batch.column(1), d)
            codes = quantiser.encode(x, p.beam)
            made = quantiser.decode(codes)
            own, approx = np.sqrt((x * x).sum(axis=1)), np.sqrt((made * made).sum(axis=1))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(m), len(x), [None, pa.py_buffer(codes.astype(np.uint8).tobytes())])
            scale = pa.array((own / np.maximum(approx, 1e-12)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), packed.cast(pa.binary()), scale], names=["id", "v", "nth", "codes", "scale"])

    sized = F.size("v") == d
    index = durable(_numbered(base.where(sized)).mapInArrow(encode, "id bigint, v array<double>, nth int, codes binary, scale float"))
    asked = durable(_usable(queries).where(sized).groupBy("id").agg(F.min("v").alias("v")))
    n, nq = index.count(), asked.count()
    if not nq or not n:
        return spark.createDataFrame([], schema)
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    # every vector is in one row part, every query in one query part; each pair of parts is a block
    parts, qparts = _parts(n, p.rows, p.spread), _parts(nq, p.queries, p.spread)
    rows = index.select(
        deal("id", parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(qparts - 1))).alias("qpart"), F.lit(0).alias("side"), "id", "nth", "codes", "scale",
        F.lit(None).cast("array<double>").alias("v"),
    )
    asks = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), deal("id", qparts).alias("qpart"), F.lit(1).alias("side"), "id", F.lit(0).alias("nth"),
        F.lit(None).cast("binary").alias("codes"), F.lit(0.0).cast("float").alias("scale"), "v",
    )
    dealt = rows.union(asks).repartition(parts * qparts, "part", "qpart").sortWithinPartitions("part", "qpart", "side", "id", "nth")
    # of a part's rows, more than its share of the best by far are kept
    share = p.rerank / parts
    keep = min(p.rerank, int(share + 6 * np.sqrt(share) + 16))

    def score(batches):
        for block in _blocks(batches):
            own, q = _side(block, 0), _side(block, 1)
            if not len(own["id"]) or not len(q["id"]):
                continue
            ids, nth, qid = own["id"].to_numpy(), own["nth"].to_numpy(), q["id"].to_numpy()
            codes = np.frombuffer(b"".join(own["codes"].to_pylist()), np.uint8).reshape(-1, m)
            out, size = [], 0
            for i, near, value in search_block(quantiser, ids, codes, own["scale"].to_numpy(), qid, _matrix(q["v"], d), keep):
                out.append((np.full(len(near), qid[i]), ids[near], nth[near], value))
                size += len(near)
                if size > 1 << 16:
                    yield told(out)
                    out, size = [], 0
            if out:
                yield told(out)

    def told(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "id", "nth", "near"])

    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "id", "nth")
    near = dealt.mapInArrow(score, "query_id bigint, id bigint, nth int, near float").withColumn("place", F.row_number().over(best))
    near = durable(near.where(F.col("place") <= p.rerank).select("query_id", "id", "nth"))
    # exact scores, again by blocks: a vector goes to the blocks that hold a query it is a candidate of
    parts, qparts = _parts(n, p.whole, p.spread), _parts(nq, p.asking, p.spread)
    pairs = near.withColumns({"part": deal("id", parts), "qpart": deal("query_id", qparts)})
    nothing = F.lit(None).cast("array<double>").alias("v")
    mine = pairs.select("part", "qpart", "id", "nth").distinct().join(index.select("id", "nth", "v"), ["id", "nth"])
    theirs = pairs.select("part", "qpart", "query_id").distinct().join(asked.withColumnRenamed("id", "query_id"), "query_id")
    dealt = (
        mine.select("part", "qpart", F.lit(0).alias("side"), "id", "nth", F.lit(0).cast("bigint").alias("query_id"), "v")
        .union(theirs.select("part", "qpart", F.lit(1), F.lit(0).cast("bigint"), F.lit(0), "query_id", "v"))
        .union(pairs.select("part", "qpart", F.lit(2), "id", "nth", "query_id", nothing))
        .repartition(parts * qparts, "part", "qpart").sortWithinPartitions("part", "qpart")
    )

    def exact(batches):
        for block in _blocks(batches):
            own, q, pair = (_side(block, i) for i in range(3))
            x, qs = _matrix(own["v"], d), _matrix(q["v"], d)
            kind = [("id", np.int64), ("nth", np.int32)]
            keys, wanted = (np.rec.fromarrays([t["id"].to_numpy(), t["nth"].to_numpy()], dtype=kind) for t in (own, pair))
            order = np.lexsort((keys.nth, keys.id))
            ids, repeated = keys.id[order], (keys.id[order][1:] == keys.id[order][:-1]).any()
            row = order[np.searchsorted(keys[order], wanted) if repeated else np.searchsorted(ids, wanted.id)]
            order = np.argsort(q["query_id"].to_numpy(), kind="stable")
            asking = order[np.searchsorted(q["query_id"].to_numpy()[order], pair["query_id"].to_numpy())]
            for a in range(0, len(row), 1 << 15):
                value = np.einsum("ij,ij->i", x[row[a : a + (1 << 15)]], qs[asking[a : a + (1 << 15)]])
                yield pa.RecordBatch.from_arrays(
                    [pair["query_id"].slice(a, 1 << 15), pair["id"].slice(a, 1 << 15), pair["nth"].slice(a, 1 << 15), pa.array(value)],
                    names=["query_id", "vec_id", "nth", "score"],
                )

    done = dealt.mapInArrow(exact, "query_id bigint, vec_id bigint, nth int, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "nth")
    return done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
