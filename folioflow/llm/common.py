"""Shared pieces: table access, durable intermediate tables, and vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text handled at a time inside a Python worker; bounds its memory whatever the batch size is.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one only where none is named and all tasks run here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="folioflow-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended before the interpreter: nothing can be removed any more
        pass


#: Files for each core that gathered tables are written as.
GATHERED = 4


def durable(df: DataFrame, gathered: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again.

    Survives lost executors, is compressed and columnar, and gives later joins real sizes to plan by.
    The files go when the driver process ends. gathered: as a few files for each core, however many partitions a shuffle
    left; on a local file system each file costs two processes that set its permissions, and each counts as large as its executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioflow/{uuid.uuid4().hex}"
    # shuffle files of earlier tables that nothing refers to any more go when the driver's JVM collects its garbage
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if gathered:
        df = df.coalesce(GATHERED * spark.sparkContext.defaultParallelism)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _trimmed() -> None:
    """Free memory of this process goes back to the system, as far as its allocators can tell."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """run, for mapInArrow: a worker lives on after its task, so what it holds for nothing is given back then."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _trimmed()

    return whole


# ---------------------------------------------------------------- word hashing

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche; a bijection of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_codes(fold_case: bool) -> np.ndarray:
    codes = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE))
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {fold: _byte_codes(fold) for fold in (False, True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64; tables of usual length are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * PIECE + 1)
        have = np.full(size, base, dtype=_U)
        have[0] = 1
        have = np.cumprod(have, dtype=_U)
        if size <= 8 * PIECE:
            _powers[base] = have
    return have[:n]


#: Bytes hashed at a time, so a long text costs memory by its words and not by several numbers a byte.
PIECE = 1 << 18
#: Longer words are hashed by themselves: sums modulo 2 ** 64 are sound for short ranges only.
LONG_WORD = 512


class Words:
    """Words of several texts at once: runs of bytes other than space and \\x09-\\x0D.

    hash, start, end (byte offsets in data), chars (code points) and doc hold one entry per word;
    bounds[i]:bounds[i+1] are the words of text i; first[i] is where text i begins in data and size[i] its
    length in bytes.
    """

    def __init__(self, texts: list[bytes], fold_case: bool = False):
        self.raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.zeros(len(texts), dtype=np.int64)
        np.cumsum(self.size[:-1] + 1, out=self.first[1:])
        self.fold = fold_case
        pieces = [self._piece(a, b) for a, b in self._cuts()]
        self.start, self.end, self.hash, self.chars = (np.concatenate(c) for c in zip(*pieces))
        for i in np.flatnonzero(self.end - self.start > LONG_WORD):
            word = self.raw[self.start[i] : self.end[i]]
            self.hash[i] = xxhash.xxh3_64_intdigest(word.lower() if fold_case else word)
        self.bounds = np.append(np.searchsorted(self.start, self.first), len(self.start))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))

    def _cuts(self):
        """Ranges of about PIECE bytes that end after white space."""
        at, n = 0, len(self.data)
        while at < n:
            stop = at + PIECE
            if stop >= n:
                yield at, n
                return
            blank = np.flatnonzero(_SPACE[self.data[at:stop]])
            if len(blank):
                stop = at + int(blank[-1]) + 1
            else:  # a word longer than a piece
                while not (blank := np.flatnonzero(_SPACE[self.data[stop : stop + PIECE]])).size:
                    stop += PIECE
                stop += int(blank[0]) + 1
            yield at, stop
            at = stop

    def _piece(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        data = self.data[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        lead = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        chars = (lead[end] - lead[start]).astype(np.int64)
        if len(data) > 2 * PIECE:  # one long word, hashed by itself
            return start + a, end + a, np.zeros(len(start), dtype=_U), chars
        sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_CODES[self.fold][data] * _powers_of(_BASE, len(data)), out=sums[1:])
        h = (sums[end] - sums[start]) * _powers_of(_INVERSE, len(data) + 1)[start]
        return start + a, end + a, mix64(h + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)), chars


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words for long n, by sums; len - n + 1 entries, those across texts as in grams."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=_U)
    sums = np.zeros(len(hashes) + 1, dtype=_U)
    np.cumsum(hashes * _powers_of(_BASE, len(hashes)), out=sums[1:])
    return mix64((sums[n:] - sums[:m]) * _powers_of(_INVERSE, m) + _U(n))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; len - n + 1 entries. Runs across texts must be masked by the caller."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=_U)
    out = np.zeros(m, dtype=_U)
    for i in range(n):
        out = out * _U(0xD1342543DE82EF95) + hashes[i : i + m]
    return mix64(out + _U(n))


def text_chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """Slices of Arrow batches whose texts hold about limit bytes: yields (slice, list of bytes); null is empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            texts = part.column(at).cast(pa.binary()).to_pylist()
            yield part, [t or b"" for t in texts]


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with as many underscores before it as make it differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
