"""Exact de-duplication over a cuckoo-filter index of live digests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, as_bytes, id_column, prepare, stash, tidy

#: The characters that do not count when texts are compared.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


class CuckooIndex:
    """Digests with a value each, in a cuckoo filter that can insert and delete.

    A key's 16-bit fingerprint may stand in either of two buckets of four slots; which is the other one follows from the
    fingerprint and the bucket alone. Fingerprints are a table of their own, so a lookup reads two short rows of
    numbers; a slot's digest and value stand at the same place of the bucketed content, where a hit of the filter is
    verified. There is no other copy of the keys. When a chain of evictions gets too long the filter overflows: it is
    built anew, twice as large, from the stored keys.
    """

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 1024):
        self.resized = self.size = 0
        self._fresh(buckets)

    def _fresh(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = [bytearray(2 * self.SLOTS) for _ in range(buckets)]  # 0: a free slot
        self.content: list[list] = [[None] * self.SLOTS for _ in range(buckets)]

    def __len__(self) -> int:
        return self.size

    def _places(self, key: bytes) -> tuple[bytes, int, int]:
        mark = key[:2] if key[:2] != b"\0\0" else b"\0\1"
        i = int.from_bytes(key[2:10], "big") & self.mask
        return mark, i, self._other(i, mark)

    def _other(self, i: int, mark: bytes) -> int:
        return (i ^ (int.from_bytes(mark, "big") * 0x5BD1E995)) & self.mask

    def _slots(self, bucket: int, mark: bytes):
        row, at = self.marks[bucket], -1
        while (at := row.find(mark, at + 1)) >= 0:
            if at % 2 == 0:
                yield at // 2

    def may_hold(self, key: bytes) -> bool:
        """Whether the filter has the key's fingerprint."""
        mark, i, j = self._places(key)
        return any(True for k in (i, j) for _ in self._slots(k, mark))

    def _find(self, key: bytes) -> tuple[int, int] | None:
        mark, i, j = self._places(key)
        for k in (i, j) if i != j else (i,):
            for slot in self._slots(k, mark):
                if self.content[k][slot][0] == key:
                    return k, slot
        return None

    def get(self, key: bytes):
        """The value of a live digest, else None."""
        at = self._find(key)
        return None if at is None else self.content[at[0]][at[1]][1]

    def _put(self, bucket: int, slot: int, mark: bytes, entry) -> None:
        self.marks[bucket][2 * slot : 2 * slot + 2] = mark
        self.content[bucket][slot] = entry

    def _place(self, entry: tuple) -> tuple | None:
        """Put a (digest, value) into a bucket; None, or the entry that is left without a place."""
        mark, i, j = self._places(entry[0])
        k = i
        for n in range(self.KICKS):
            for b in (i, j) if n == 0 else (k,):
                slot = next(self._slots(b, b"\0\0"), None)
                if slot is not None:
                    self._put(b, slot, mark, entry)
                    return None
            slot = n % self.SLOTS
            out, gone = bytes(self.marks[k][2 * slot : 2 * slot + 2]), self.content[k][slot]
            self._put(k, slot, mark, entry)
            mark, entry = out, gone
            k = self._other(k, mark)
        return entry

    def insert(self, key: bytes, value) -> None:
        """Make a digest live; a live one gets the new value."""
        at = self._find(key)
        if at is not None:
            self.content[at[0]][at[1]] = (key, value)
            return
        self.size += 1
        left = self._place((key, value))
        if left is not None:
            self._grow(left)

    def _grow(self, left: tuple) -> None:
        stored = [*self.items(), left]
        size = 2 * (self.mask + 1)
        while True:
            self.resized += 1
            self._fresh(size)
            if all(self._place(e) is None for e in stored):
                return
            size *= 2

    def delete(self, key: bytes) -> bool:
        """Take a live digest out; False if it is not live."""
        at = self._find(key)
        if at is None:
            return False
        self._put(*at, b"\0\0", None)
        self.size -= 1
        return True

    def items(self):
        return (e for bucket in self.content for e in bucket if e is not None)


def _offer(index: CuckooIndex, digest: bytes, entry: tuple[int, int, int, int]) -> None:
    """entry: (chars, doc, row, copies). Of equal texts the longest original, then the smallest id, then the first row is the live one; the others count as its copies."""
    held = index.get(digest)
    if held is not None:
        best = held if (held[0], -held[1], -held[2]) >= (entry[0], -entry[1], -entry[2]) else entry
        entry = (*best[:3], held[3] + entry[3])
    index.insert(digest, entry)


def _digests(batches):
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for b in batches:
        keys = [hashlib.sha256(t.translate(None, BLANKS)).digest() for t in as_bytes(b.column(1))]
        chars = pc.fill_null(pc.utf8_length(b.column(1)), 0).cast(pa.int64())
        own = b.column(2) if b.num_columns > 2 else pa.array(range(row, row + len(keys)), pa.int64())
        row += len(keys)
        yield pa.RecordBatch.from_arrays([own, b.column(0), pa.array(keys, pa.binary()), chars], ["row", "doc", "digest", "chars"])


LIVE = "digest binary, chars long, doc long, row long, copies long"
#: Live digests that a task holds at once; what it then passes on is merged further on.
HELD = 400_000


def _index(batches):
    """The live digests of one task's rows: (digest, chars, doc, row, copies). Used before and after the shuffle.

    Without an upstream order, batches that bring the digests of earlier ones only update them. A full index passes its
    entries on and deletes them, so memory is bounded and each entry is passed on once.
    """
    index = CuckooIndex()

    def out():
        rows = list(index.items())
        for k in range(0, len(rows), 50_000):
            part = rows[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.binary()), *(pa.array([v[i] for _, v in part], pa.int64()) for i in range(4))], ["digest", "chars", "doc", "row", "copies"])
        for d, _ in rows:
            index.delete(d)

    for b in batches:
        for digest, *entry in zip(*(b.column(n).to_pylist() for n in ("digest", "chars", "doc", "row", "copies")), strict=True):
            _offer(index, digest, tuple(entry))
        if len(index) >= HELD:
            yield from out()
    yield from out()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: ([row,] id, digest binary, keep_id, group_size, kept).

    Texts are equal when they are once blanks are deleted. Null text counts as empty; empty texts are equal to each
    other. Of equal texts one row is kept: that of the longest original, then of the smallest id, a null id before all
    others, then the first by the number that rows get when digests are written. Rows that repeat an id and its text are
    copies like any others. Null ids come back as null; further columns are ignored; an empty table gives an empty
    result. `row_col` names a column of unique numbers to be taken and returned instead.

    Each scan task keeps its live digests in a cuckoo index and passes one row per digest on, so a text that makes up a
    third of the table is one row per task by the time it is shuffled. The shuffled rows are merged by the same index,
    by digest. Whole texts are never shuffled.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(id_column(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    ids = stash(rows.mapInArrow(tidy(_digests), "row long, doc long, digest binary, chars long"), "digests")
    near = ids.withColumn("copies", F.lit(1).cast("long")).mapInArrow(tidy(_index), LIVE)
    merged = near.repartition("digest").mapInArrow(tidy(_index), LIVE)
    # a task that passed its memory bound has left more than one row of a digest
    least = lambda c: (-F.col(c).cast("decimal(20,0)")).alias(f"o_{c}")
    best = F.max(F.struct("chars", least("doc"), least("row"), "doc", "row")).alias("best")
    live = merged.groupBy("digest").agg(best, F.sum("copies").alias("group_size"))
    # written, so that both sides of the join are plain scans: a digest of very many rows can then be split
    shared = stash(live.filter("group_size > 1").select("digest", F.col("best.doc").alias("keep"), F.col("best.row").alias("keep_row"), "group_size"), "shared")
    out = ids.join(shared, "digest", "left")
    null = lambda c: F.when(c != NULL_ID, c)
    named = [F.col("row").alias(row_col)] if row_col else []
    return out.select(
        *named, null(F.col("doc")).alias(id_col), "digest", null(F.coalesce("keep", "doc")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
    )
