"""Near-duplicate documents by SetSketch registers over word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, as_bytes, discard, hashed_words, id_column, mix64, portions, prepare, ragged, release, stash, tidy
from .components import components

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Numbers of rows, or ids, that are broadcast, so as not to shuffle texts and sketches.
IDS = 1 << 21
#: Lower case for A-Z; space and \x09-\x0D part words.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256)], np.uint8)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text.

    A-Z are lower-cased; words are runs of other characters than space and \\x09-\\x0D. A text of fewer words than
    `width` has its whole sequence as its one shingle; a text without words has none.
    """
    flat, n = hashed_words(texts, _FOLD)
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        roll = np.zeros(max(len(flat) - width + 1, 0), np.uint64)
        for k in range(width if len(roll) else 0):
            roll = roll * np.uint64(0x100000001B3) + flat[k : len(flat) - width + 1 + k]
        roll = mix64(roll)
        out = []
        for e, c in zip(ends.tolist(), n.tolist(), strict=True):
            s = e - c
            if c >= width:
                out.append(np.unique(roll[s : e - width + 1]))
            elif c:
                h = np.uint64(c)
                for x in flat[s:e]:
                    h = h * np.uint64(0x100000001B3) + x
                out.append(mix64(np.array([h ^ _GOLD], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


class SetSketch:
    """m registers of base b: each is the truncated exponent of the least of exponentially spaced points of the set.

    Every element draws an ascending sequence of points, one for each register in an order of its own, until a point
    exceeds what all registers hold. Registers are merged by their maximum; equal registers of two sets are as likely
    as the sets are similar.
    """

    def __init__(self, m: int = 256, base: float = 1.001, rate: float = 20.0):
        if m & (m - 1):
            raise ValueError("m must be a power of two")
        self.m, self.base, self.rate, self.top = m, base, rate, 65535

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of registers (uint16) for each set; an empty set has zeros."""
        m = self.m
        least = np.full((len(sets), m), np.inf)
        h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        x = np.zeros(len(h))
        with np.errstate(over="ignore", divide="ignore"):
            p = mix64(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            first, step = (p & np.uint64(m - 1)).astype(np.int64), ((p >> np.uint64(32)) | np.uint64(1)).astype(np.uint32).astype(np.int64)
            for j in range(m):
                u = ((mix64(h + np.uint64(j + 1) * _GOLD) >> np.uint64(11)).astype(float) + 1) * 2.0**-53
                x = x - np.log(u) / (self.rate * (m - j))
                np.minimum.at(least.reshape(-1), doc * m + ((first + j * step) & (m - 1)), x)
                live = x < least.max(1)[doc]
                if not live.any():
                    break
                h, doc, x, first, step = h[live], doc[live], x[live], first[live], step[live]
            k = np.floor(1 - np.log(least) / np.log(self.base))
        return np.clip(np.where(np.isinf(least), 0, k), 0, self.top).astype(np.uint16)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Registers of the union."""
        return np.maximum(a, b)

    def joint(self, one: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
        """Maximum-likelihood similarity of pairs of sets, from how many registers are above, below and equal, given the sets' sizes."""
        above, equal = (one > other).sum(1), (one == other).sum(1)
        below = self.m - above - equal
        u = size / (size + other_size)
        v = 1 - u
        b = self.base
        p = lambda z: -np.log(np.maximum(1 - np.maximum(z, 1e-12) * (b - 1) / b, 1e-300)) / np.log(b)

        def value(j):
            up, down = p(u - v * j), p(v - u * j)
            return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

        lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
        g = (5**0.5 - 1) / 2
        for _ in range(24):
            c, d = hi - g * (hi - lo), lo + g * (hi - lo)
            better = value(c) > value(d)
            lo, hi = np.where(better, lo, c), np.where(better, d, hi)
        return (lo + hi) / 2


class Likely:
    """Pairs that registers say are likely links: in each group of documents as many as connect what they connect."""

    SMALL, PAIRS = 24, 20_000

    def __init__(self, sketch: SetSketch, percent: int, margin: float):
        self.sketch, self.percent, self.floor = sketch, percent, percent / 100 - margin
        self.docs: list[np.ndarray] = []
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.size: list[np.ndarray] = []
        self.regs: list[np.ndarray] = []
        self.members = self.waiting = 0

    def _sized(self, x, y):
        return 100 * np.minimum(x, y) >= self.percent * np.maximum(x, y)

    def add(self, docs: np.ndarray, size: np.ndarray, regs: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
        """side: 0 for pairs within, or 1 and 2 for pairs across. Small groups wait until there are many pairs to estimate at once."""
        n = len(docs)
        if n > self.SMALL:
            return self._large(docs, size, regs, side)
        i, j = np.triu_indices(n, 1)
        ok = self._sized(size[i], size[j]) & ((side[i] != side[j]) | (side[i] == 0))
        self.a.append(i[ok] + self.members), self.b.append(j[ok] + self.members)
        self.docs.append(docs), self.size.append(size), self.regs.append(regs)
        self.members += n
        self.waiting += int(ok.sum())
        return self.drain() if self.waiting >= self.PAIRS or self.members >= self.PAIRS else []

    def drain(self) -> list[tuple[int, int]]:
        if not self.members:
            return []
        docs, size, regs = np.concatenate(self.docs), np.concatenate(self.size), np.concatenate(self.regs)
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        self.docs, self.size, self.regs, self.a, self.b, self.members, self.waiting = [], [], [], [], [], 0, 0
        good = self.sketch.joint(regs[a], size[a], regs[b], size[b]) >= self.floor if len(a) else np.zeros(0, bool)
        root = list(range(len(docs)))
        out = []
        for i, j in zip(a[good].tolist(), b[good].tolist(), strict=True):
            x, y = i, j
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(docs[i]), int(docs[j])))
        return out

    def _large(self, docs, size, regs, side):
        n, out = len(docs), []
        cls = np.arange(n)
        for i in range(n):
            left = (cls != cls[i]) & self._sized(size, size[i])
            left[:i] = False
            if side[i]:
                left &= side != side[i]
            near = np.flatnonzero(left)
            if len(near):
                one = np.broadcast_to(regs[i], (len(near), len(regs[i])))
                for j in near[self.sketch.joint(one, np.full(len(near), size[i]), regs[near], size[near]) >= self.floor].tolist():
                    if cls[i] != cls[j]:
                        out.append((int(docs[i]), int(docs[j])))
                        cls[cls == cls[j]] = cls[i]
        return out


class Links:
    """Exact links inside a group of documents, one per step that joins two classes of linked documents."""

    def __init__(self, sketch: SetSketch, percent: int, margin: float):
        self.sketch, self.percent, self.floor = sketch, percent, percent / 100 - margin

    def find(self, docs, sets, regs, side, classes) -> list[tuple[int, int]]:
        """side: 0 for pairs within, or 1 and 2 for pairs across. Pairs inside a class that is linked already are not tested."""
        n, out = len(docs), []
        size = np.array([len(s) for s in sets], np.int64)
        cls = np.unique(np.asarray(classes), return_inverse=True)[1]
        flat, ends = np.concatenate(sets), np.cumsum(size)
        for i in range(n):
            left = cls != cls[i]
            left[:i] = False
            left &= (100 * np.minimum(size, size[i]) >= self.percent * np.maximum(size, size[i]))
            if side[i]:
                left &= side != side[i]
            near = np.flatnonzero(left)
            if not len(near):
                continue
            est = self.sketch.joint(np.broadcast_to(regs[i], (len(near), len(regs[i]))), np.full(len(near), size[i]), regs[near], size[near])
            keep = est >= self.floor
            near = near[keep][np.argsort(-est[keep], kind="stable")]
            for k in range(0, len(near), 64):  # likeliest first: once linked, the rest of a class need no test
                part = near[k : k + 64]
                part = part[cls[part] != cls[i]]
                if not len(part):
                    continue
                where = ragged(ends[part] - size[part], size[part])
                x = flat[where]
                hit = sets[i][np.minimum(np.searchsorted(sets[i], x), size[i] - 1)] == x
                both = np.add.reduceat(hit, np.cumsum(size[part]) - size[part])
                for j, c in zip(part.tolist(), both.tolist(), strict=True):
                    if 100 * c >= self.percent * (size[i] + size[j] - c) and cls[i] != cls[j]:
                        out.append((docs[i], docs[j]))
                        cls[cls == cls[j]] = cls[i]
        return out


def _groups(batches, n: int):
    """Rows of sorted batches, gathered by their first n columns."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n] != now:
                if held:
                    yield held
                now, held = row[:n], []
            held.append(row[n:])
    if held:
        yield held


def _edges(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(x) for x in pairs], pa.int64()), pa.array([min(x) for x in pairs], pa.int64())], ["a", "b"])


def _dealt(members: DataFrame, group: str, *columns: str) -> DataFrame:
    """Members of groups that consist of `blocks` blocks, once for each pair of blocks (i, j) that theirs is in, so no task holds more than two."""
    mine, other = F.col("mine"), F.col("other")
    each = members.withColumn("mine", F.pmod(F.xxhash64("row", group), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(mine == other, 0).when(mine < other, 1).otherwise(2).cast("int").alias("side")
    each = each.select(group, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side, "row", *columns)
    return each.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, rows: int = 7, registers: int = 256,
    margin: float = 0.1, block: int = 1000, row_col: str | None = None,
) -> DataFrame:
    """One row per input row: ([row,] id, n_shingles, component_id, kept).

    Two documents are linked when 100 * |A & B| >= percent * |A | B| on their sets of `width`-word shingles, held as
    64-bit hashes; a component is what links connect. component_id is its smallest id, and the one row that is kept is
    the first by id, then by the number it gets when sketches are written. Candidates agree in a band of `rows` of the
    registers (36 bands of 7: a pair at 0.85 is missed with probability 9e-7); pairs whose estimated similarity is more
    than `margin` under the bound (over four deviations) are left out; all others are verified on full sets.

    Null text, and text without words, has an empty set and is linked with nothing. A null id orders before all others
    and comes back as null. Rows that share an id are documents of their own. Further columns are ignored; an empty
    table gives an empty result. `row_col` names a column of unique numbers to be taken and returned instead.

    Rows of one shingle set are one class, so copies are never compared or expanded. Registers meet in their band's
    bucket, each set of documents once however many bands it shares, and only pairs that their registers call likely
    leave it, as few as connect what they connect. These are verified first. Where likely pairs hold documents together
    that verified links do not, all pairs between the parts are verified. Buckets and such parts of more than `block`
    classes are dealt out in pairs of blocks, so a task holds two blocks at most, and no pair is ever a row unless
    it is likely and joins two classes of its bucket.
    """
    spark = docs.sparkSession
    prepare(spark)
    sketch = SetSketch(registers)
    bands = registers // rows
    texts = docs.select(id_column(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))

    def sketches(batches):
        from pyspark import TaskContext
        from xxhash import xxh3_128_digest

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            raw = as_bytes(b.column(1))
            number = b.column(2) if row_col else pa.array(range(row, row + len(raw)), pa.int64())
            row += len(raw)
            for k, stop in portions([len(t) for t in raw], 250, 4 << 20):
                sets = shingle_sets(raw[k:stop], width)
                regs = sketch.registers(sets)
                wide = regs[:, : bands * rows].reshape(len(sets), bands, rows).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, wide.shape[:2])
                    for r in range(rows):
                        key = mix64(key ^ wide[:, :, r]) + _GOLD
                full = np.array([len(s) > 0 for s in sets], bool)
                offsets = np.r_[0, np.cumsum(np.where(full, bands, 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        number.slice(k, len(sets)), b.column(0).slice(k, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[full].reshape(-1).view(np.int64))),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["row", "doc", "n_shingles", "print", "bands", "regs"],
                )

    own = stash(texts.mapInArrow(tidy(sketches), "row long, doc long, n_shingles long, print binary, bands array<long>, regs binary"), "sketches")
    first = F.min(F.struct("doc", "row"))
    classes = stash(own.filter("print is not null").groupBy("print").agg(F.min("row").alias("class"), F.count("*").alias("copies"), first.alias("first")), "classes")
    # all rows of a class but its first, by light columns, so that bands and registers need not be shuffled to leave them out
    others = own.select("row", "print").join(classes.filter("copies > 1").select("print", "class"), "print").filter("row <> class")
    others = stash(others.select("row"), "others")
    one = own.filter("print is not null").join(F.broadcast(others) if others.count() <= IDS else others, "row", "left_anti")

    keys = one.select("row", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("least"), F.bit_xor(F.xxhash64("row")).alias("whose")).filter("n > 1")
    buckets = buckets.groupBy("n", "least", "whose").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = stash(keys.join(buckets, "key"), "buckets")

    def estimate(batches):
        likely = Likely(sketch, percent, margin)
        for held in _groups(batches, 3):
            side, docs_, size, regs = zip(*held, strict=True)
            got = likely.add(np.array(docs_), np.array(size), np.frombuffer(b"".join(regs), np.uint16).reshape(len(docs_), -1), np.array(side))
            if got:
                yield _edges(got)
        yield _edges(likely.drain())

    with_regs = members.join(one.select("row", "n_shingles", "regs"), "row")
    edges = stash(_dealt(with_regs, "key", "n_shingles", "regs").mapInArrow(tidy(estimate), "a long, b long").distinct(), "likely")
    discard(members)
    release(spark)

    def full_sets(batches):
        from xxhash import xxh3_128_digest

        seen: set[bytes] = set()
        for b in batches:
            raw = as_bytes(b.column(0))
            for k, stop in portions([len(t) for t in raw], 250, 4 << 20):
                own = {xxh3_128_digest(x): x for s in shingle_sets(raw[k:stop], width) if (x := s.tobytes())}
                new = [x for x in own if x not in seen]
                seen.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()), pa.array([own[x] for x in new], pa.binary())], ["print", "hashes"])

    # the sets of these rows alone are made again, from the documents of their ids; the digest says which is which. Up to
    # IDS of them the ids are broadcast to the scan, beyond that texts are joined with them
    ends = edges.select(F.col("a").alias("row")).union(edges.select(F.col("b").alias("row"))).distinct()
    ends = stash(one.select("row", "doc", "print").join(ends, "row"), "ends")
    ids = ends.select("doc").distinct()
    ids = F.broadcast(ids) if ends.count() <= IDS else ids
    again = texts.select("doc", "text").join(ids, "doc", "left_semi").select("text")
    again = again.mapInArrow(tidy(full_sets), "print binary, hashes binary")
    sets = stash(again.join(ends.select("row", "print"), "print").select("row", "hashes"), "sets")
    pairs = edges.join(sets.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def verify(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                c = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                good.append(100 * c >= percent * (len(x) + len(y) - c))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    links = stash(pairs.mapInArrow(tidy(verify), "a long, b long"), "links")
    release(spark)
    linked = components(links)
    clumps = components(edges).join(linked.select("node", F.col("component").alias("known")), "node", "left").withColumn("known", F.coalesce("known", "node"))
    parts = clumps.groupBy("component").agg(F.count("*").alias("size"), (F.min("known") < F.max("known")).alias("open")).filter("open")
    open_ = stash(clumps.join(parts, "component").select(F.col("node").alias("row"), "component", "known", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "open")

    def link(batches):
        finder = Links(sketch, percent, margin)
        for held in _groups(batches, 3):
            side, docs_, known, raw = zip(*{h[1]: h for h in held}.values(), strict=True)
            if len(set(known)) > 1:
                sets_ = [np.frombuffer(h, np.uint64) for h in raw]
                yield _edges(finder.find(docs_, sets_, sketch.registers(sets_), np.array(side), known))

    if not open_.isEmpty():
        more = _dealt(open_.join(sets, "row"), "component", "known", "hashes").mapInArrow(tidy(link), "a long, b long")
        links = stash(links.unionByName(more), "all-links")
        linked = components(links)

    many = classes.join(linked.select(F.col("node").alias("class"), "component"), "class", "left").filter("copies > 1 or component is not null").withColumn("root", F.coalesce("component", "class"))
    keep = many.groupBy("root").agg(F.min("first").alias("keep"))
    verdicts = stash(many.join(keep, "root").select("print", F.col("keep.doc").alias("keep"), F.col("keep.row").alias("keep_row")), "verdicts")
    discard(edges, ends, sets, links, open_, classes, others)
    out = own.select("row", "doc", "n_shingles", "print").join(verdicts, "print", "left")
    null = lambda c: F.when(c != NULL_ID, c)
    named = [F.col("row").alias(row_col)] if row_col else []
    return out.select(*named, null(F.col("doc")).alias(id_col), "n_shingles", null(F.coalesce("keep", "doc")).alias("component_id"), F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"))
