"""Helpers shared by the text-preparation operators."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Stands for a null id wherever ids are ordered: nulls come first.
NULL_ID = -(2**63)

_prepared: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make this package importable on executors, and bound the rows and bytes of an Arrow batch. Idempotent per application."""
    ship(spark)
    app = spark.sparkContext.applicationId
    if app in _prepared:
        return
    _prepared.add(app)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    except Exception as e:  # a Spark without this setting: rows alone bound a batch
        if "CONFIG" not in str(e).upper():
            raise


_made: list[list[str]] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    for made in _made:
        made.append(path)
    return out


@contextmanager
def tracked():
    """The paths of the tables that are written meanwhile."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.remove(made)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Delete stashed tables that nothing will be read from again: what was made of them has been written itself."""
    for df in frames:
        delete(df.sparkSession, [df._stash])


def with_rows(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a number of its own for each row, written to the shared folder: numbers made in a scan are only good once written."""
    return stash(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def tidy(run):
    """run, a function of batches, that gives freed memory back to the system when a task is done.

    Workers go on to other operators; without this each would keep the most that any of them has ever used.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it keeps what it likes
                pass

    return wrapped


_held: dict[tuple, object] = {}


def held(key: tuple, make):
    """What a worker keeps between batches and tasks. There is one such thing at a time: another key's takes its place."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now rather than at the driver's next garbage collection.

    A finished round's shuffle files are referenced by cyclic objects of the driver's Python and JVM, which nothing
    else frees soon; loops that shuffle as much as their input each round would fill the disks.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LENGTH = 64
#: A random number for each byte at each place of a word.
_PLACES = np.random.default_rng(20240102).integers(0, 2**63, _LENGTH * 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES_AGAIN = np.random.default_rng(20240103).integers(0, 2**63, _LENGTH * 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIB = 1 << 20


def hashed_words(texts: list[bytes], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after another, and each text's number of words.

    fold says what each byte counts as; what counts as a space parts words. A word's hash is a sum over its bytes of
    random numbers for byte and place, mixed: no word becomes an object of its own. Stretches of a mebibyte, cut between
    words, are hashed at a time.
    """
    size = np.array([len(t) for t in texts], np.int64)
    buf = fold[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    out, heads, a = [], [], 0
    while a < len(buf):
        b = min(a + _MIB, len(buf))
        while b < len(buf) and buf[b - 1] != 32:
            stop = np.flatnonzero(buf[b : b + 4096] == 32)
            b = b + int(stop[0]) + 1 if len(stop) else min(b + 4096, len(buf))
        part = buf[a:b]
        word = part != 32
        start = word.copy()
        start[1:] &= ~word[:-1]
        at, head = np.flatnonzero(word), np.flatnonzero(start)
        if len(head):
            first = np.flatnonzero(start[at])
            place = at - np.repeat(head, np.diff(np.r_[first, len(at)]))
            with np.errstate(over="ignore"):
                value = _PLACES[(place % _LENGTH) * 256 + part[at]]
                if int(place.max()) >= _LENGTH:
                    value = value * ((place // _LENGTH).astype(np.uint64) * np.uint64(2) + np.uint64(1))
                out.append(mix64(np.add.reduceat(value, first)))
            heads.append(head + a)
        a = b
    ends = np.cumsum(size + 1)
    where = np.concatenate(heads) if heads else np.zeros(0, np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.diff(np.searchsorted(where, np.r_[0, ends]))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and how often each occurs."""
    s = np.sort(h)
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    key, n = s[at], np.diff(np.r_[at, len(s)])
    # a place by a table of slots; values that share a slot with others are looked for among themselves
    bits = np.uint64(64 - max(int(4 * len(key)).bit_length(), 10))
    slots = np.zeros(1 << (64 - int(bits)), np.int64)
    slots[(h >> bits).astype(np.int64)] = np.arange(len(h))
    place = slots[(key >> bits).astype(np.int64)] if len(key) else np.zeros(0, np.int64)
    lost = np.flatnonzero(h[place] != key) if len(key) else place
    if len(lost):
        taken = np.zeros(len(slots), bool)
        taken[(key[lost] >> bits).astype(np.int64)] = True
        some = np.flatnonzero(taken[(h >> bits).astype(np.int64)])
        order = some[np.argsort(h[some], kind="stable")]
        place[lost] = order[np.searchsorted(h[order], key[lost])]
    return key, place, n


def piece_hashes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of the pieces of a buffer that begin at the given places; a mebibyte or a piece at a time."""
    ends = np.r_[starts[1:], len(buf)]
    out = np.empty((len(starts), 2), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _MIB, side="right")))
        first, n = starts[a:b] - starts[a], ends[a:b] - starts[a:b]
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        at = (place % _LENGTH) * 256 + buf[starts[a] : ends[b - 1]]
        far = (place // _LENGTH).astype(np.uint64) * np.uint64(2) + np.uint64(1) if int(n.max()) > _LENGTH else None
        with np.errstate(over="ignore"):
            for k, table in enumerate((_PLACES, _PLACES_AGAIN)):
                out[a:b, k] = np.add.reduceat(table[at] if far is None else table[at] * far, first)
        a = b
    return mix64(out + np.repeat(ends - starts, 2).reshape(-1, 2).astype(np.uint64))


def portions(sizes: list[int], rows: int, total: int):
    """Ranges (start, stop) of at most so many rows and, but for single ones, of at most so much in all."""
    a = held = 0
    for k, n in enumerate(sizes):
        if k > a and (k - a >= rows or held + n > total):
            yield a, k
            a, held = k, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def id_column(name: str = "doc_id"):
    """The id with nulls replaced by NULL_ID, for ordering and joins."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))
