"""Benchmark items inside documents, also edited ones: random walks, sampled steps, exact edit distance."""

from __future__ import annotations

import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, as_bytes, hashed_words, held, id_column, mix64, portions, prepare, ragged, tidy

#: Lower case for A-Z; other ASCII than letters and digits separates words.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)

_ONE, _EVEN = np.uint64(1), np.uint64(0x5555555555555555)


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    flat, n = hashed_words(texts, _FOLD)
    return np.split(flat, np.cumsum(n)[:-1]) if len(texts) else []


class LengthClass(NamedTuple):
    """How items of `least` words, up to half as many again, are looked for."""

    least: int
    stride: int  # documents are probed at every so many words, and items indexed from as many of their first words
    steps: int  # of a walk
    picks: list[list[np.ndarray]]  # for each walk the steps of each key


def _seed(walk: int, k: int) -> np.uint64:
    return mix64(np.array([0x2545F4914F6CDD1D * (walk + 1) + 0x632BE59BD9B4E019 * k & (1 << 64) - 1], np.uint64))[0]


def _factors(walk: int, steps: int) -> np.ndarray:
    """What the word read at each step of a walk is multiplied by in a key: odd numbers."""
    return mix64(np.arange(steps, dtype=np.uint64) ^ _seed(walk, -1)) | np.uint64(1)


class KeyTable(NamedTuple):
    """Keys of one pick, in order, with the item and place of each; `hot` says which leading bits any of them has."""

    keys: np.ndarray
    items: np.ndarray
    shifts: np.ndarray
    bits: np.uint64
    hot: np.ndarray


def _key_table(keys: np.ndarray, starts: np.ndarray) -> KeyTable:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    bits = np.uint64(64 - max(15, int(len(keys) * 16).bit_length()))  # a small table stays in the nearest cache
    hot = np.zeros(1 << (64 - int(bits)), bool)
    hot[(keys >> bits).astype(np.int64)] = True
    return KeyTable(keys, starts[order, 0], starts[order, 1], bits, hot)


def _length_class(n: int) -> int:
    if n < 10:
        return n
    least = 10
    while least * 3 // 2 <= n:
        least = least * 3 // 2
    return least


class WalkIndex:
    """Places where an item may stand within its allowed edits, by random walks and bit sampling.

    A walk reads a text step by step: at each step a bit of the word it stands on, one of its own for each step, says
    whether it goes on to the next word or stays. Equal texts have equal walks, and after an edit walks of edited texts
    soon meet again, so a small edit distance becomes a small Hamming distance of what the walks have read. Every
    document is walked through from every place, over windows as long as the items of a length class. Keys are what a
    walk has read at a few sampled steps; one equal key makes a candidate. So many walks, each with PICKS keys, are made
    for a class that of made-up items at the most edits allowed the `target` share is found, at both ends of the class.

    Places are probed at a class's stride; an item is indexed from as many first words, and one of these falls on a
    probed place. Keys have three words, and one more for each hundredfold of 1000 items.
    """

    PICKS, MOST, TRIALS = 6, 64, 500

    def __init__(self, items: list[tuple[int, bytes]], share: float = 0.2, target: float = 0.98, walks: dict[int, int] | None = None):
        self.share = share
        self.ids = [i for i, _ in items]
        self.words = words_of([t for _, t in items])
        self.sets = [frozenset(w.tolist()) for w in self.words]
        self.depth = 3
        while len(items) > 1000 * 100 ** (self.depth - 3):
            self.depth += 1
        by_class: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                by_class.setdefault(_length_class(len(w)), []).append(k)
        self.walks = {n: self._enough(n, target) for n in sorted(by_class)} if walks is None else walks
        self.classes = [self._class(n, self.walks[n]) for n in sorted(by_class)]
        self.found: dict[tuple[int, int, int], KeyTable] = {}
        for c in self.classes:
            own = by_class[c.least]
            starts = np.array([(k, at) for k in own for at in range(c.stride)], np.int64)
            size = np.array([len(self.words[k]) for k in own], np.int64)
            room = c.steps + 2  # a walk that leaves its item reads the gap
            flat = np.zeros(int((size + room).sum()), np.uint64)
            heads = np.cumsum(size + room) - (size + room)
            flat[ragged(heads, size)] = np.concatenate([self.words[k] for k in own])
            at = (heads[:, None] + np.arange(c.stride)).reshape(-1)
            for r in range(len(c.picks)):
                read = self._read(flat, at, r, c.steps)
                for m, (key, complete) in enumerate(self._keys(c, r, read)):
                    self.found[c.least, r, m] = _key_table(key[complete], starts[complete])

    def allowed(self, n: int) -> int:
        """Edits that an item of n words may have, so that one word at least is its own."""
        return max(min(int(self.share * n + 1e-9), n - 1), 0)

    def _class(self, least: int, walks: int) -> LengthClass:
        stride = 1 << max((least // 5).bit_length() - 1, 0)
        steps = least if least < 5 else int(1.6 * (least - stride + 1))
        depth = min(self.depth, steps)
        r = np.random.default_rng(least)
        gap = max(steps // (2 * depth), 1)  # sampled steps stand apart, so as to read different words
        picks = []
        for _ in range(walks):
            own = []
            while len(own) < self.PICKS:
                p = np.sort(r.choice(steps, depth, replace=False))
                if (np.diff(p) >= gap).all():
                    own.append(p)
            picks.append(own)
        return LengthClass(least, stride, steps, picks)

    def _enough(self, least: int, target: float) -> int:
        """The walks after which the target share of made-up items at the bound is found."""
        r = np.random.default_rng(1000 + least)
        if self.allowed(least) == 0 and least < 5:
            return 1
        trials = []
        for n in (least, least if least < 10 else least * 3 // 2 - 1):
            items = r.integers(1, 1 << 62, (self.TRIALS, n)).astype(np.uint64)
            docs = []
            for item in items:
                parts = [[x] for x in item.tolist()]
                for at in r.choice(n, self.allowed(n), replace=False).tolist():
                    fresh = int(r.integers(1, 1 << 62))
                    parts[at] = [[fresh], [], [*parts[at], fresh]][r.integers(3)]
                around = r.integers(1, 1 << 62, (2, 10 + int(r.integers(8)))).tolist()
                docs.append(np.array(around[0] + [x for p in parts for x in p] + around[1], np.uint64))
            trials.append((items, docs))
        left = [np.arange(self.TRIALS) for _ in trials]
        for walks in range(1, self.MOST + 1):
            c = self._class(least, walks)
            for t, (items, docs) in enumerate(trials):
                missed = []
                for k in left[t].tolist():
                    read = self._read(np.r_[items[k], np.zeros(c.steps + 2, np.uint64)], np.arange(c.stride), walks - 1, c.steps)
                    probe = self._read(np.r_[docs[k], np.zeros(c.steps + 2, np.uint64)], np.arange(0, len(docs[k]), c.stride), walks - 1, c.steps)
                    mine, theirs = self._keys(c, walks - 1, read), self._keys(c, walks - 1, probe)
                    if not any(np.isin(x[ok], y).any() for (x, ok), (y, _) in zip(mine, theirs, strict=True)):
                        missed.append(k)
                left[t] = np.array(missed, np.int64)
            if all(len(x) <= (1 - target) * self.TRIALS for x in left):
                return walks
        raise ValueError(f"{self.MOST} walks do not find a share of {target} of items of {least} words")

    @staticmethod
    def _bits(flat: np.ndarray, walk: int, steps: int) -> list[np.ndarray]:
        return [mix64(flat ^ _seed(walk, k)) for k in range(-(-steps // 64))]

    def _read(self, flat: np.ndarray, starts: np.ndarray, walk: int, steps: int) -> list[np.ndarray]:
        """What a walk from each start reads at each of its steps."""
        bits, pos, out = self._bits(flat, walk, steps), starts, []
        for j in range(steps):
            out.append(flat.take(pos, mode="clip"))
            pos = pos + ((bits[j >> 6].take(pos, mode="clip") >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
        return out

    @staticmethod
    def _paths(flat: np.ndarray, walk: int, steps: int) -> list[np.ndarray]:
        """For each place the bits of `_bits` at even steps, and at odd steps those of the word that a walk there at the step before stands on."""
        out = []
        for bits in WalkIndex._bits(flat, walk, steps):
            moved = bits[:-1] ^ bits[1:]
            moved &= (bits[:-1] & _EVEN) << np.uint64(1)
            bits[:-1] ^= moved
            out.append(bits)
        return out

    @staticmethod
    def _keys(c: LengthClass, walk: int, read) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each pick the keys of all starts, and which of them have read a word at all of its steps."""
        by, out = _factors(walk, c.steps), []
        for pick in c.picks[walk]:
            h, complete = np.zeros(len(read[pick[0]]), np.uint64), np.ones(len(read[pick[0]]), bool)
            for j in pick.tolist():
                h += read[j] * by[j]
                complete &= read[j] != 0
            out.append((h, complete))
        return out

    def candidates(self, docs: list[np.ndarray], chunk: int = 1 << 17) -> list[set[tuple[int, int]]]:
        """For each document (item, place where it would begin). All documents are looked up at once, a chunk of places at a time."""
        found: list[set[tuple[int, int]]] = [set() for _ in docs]
        if not self.classes or not docs:
            return found
        size = np.array([len(w) for w in docs], np.int64)
        heads = np.cumsum(size + 1) - (size + 1)
        n = int((size + 1).sum())
        longest = max(c.steps for c in self.classes)
        flat = np.zeros(n + longest + 2, np.uint64)
        flat[ragged(heads, size)] = np.concatenate(docs)
        room = np.empty((3, min(chunk, n)), np.uint64)
        for walk in range(max(len(c.picks) for c in self.classes)):
            active = [c for c in self.classes if len(c.picks) > walk]
            steps = max(c.steps for c in active)
            paths, by = self._paths(flat, walk, steps), _factors(walk, steps)
            readers: list[list[int]] = [[] for _ in range(steps)]
            for k, c in enumerate(active):
                for j in np.unique(np.concatenate(c.picks[walk])).tolist():
                    readers[j].append(k)
            for a in range(0, n, chunk):
                self._probe(flat, paths, by, active, readers, walk, a, min(a + chunk, n), room, heads, found)
        return found

    def _probe(self, flat, paths, by, active, readers, walk, a, b, room, heads, found) -> None:
        """One walk from each place in [a, b) that some class probes; classes with longer strides follow the walks of those with shorter ones."""
        read: list[dict[int, np.ndarray]] = [{} for _ in active]
        stride = min(c.stride for c in active)
        m = -(-(b - a) // stride)
        pos, path, bit = room[0, :m].view(np.int64), room[1, :m], room[2, :m]
        pos[:] = np.arange(a, b, stride)
        for j, reads in enumerate(readers):
            longer = min(c.stride for c in active if c.steps > j) // stride
            if longer > 1:
                stride *= longer
                m = -(-(b - a) // stride)
                pos[:m], path[:m] = pos[::longer].copy(), path[::longer].copy()
                pos, path, bit = pos[:m], path[:m], bit[:m]
            if reads:
                least = min(active[k].stride for k in reads)
                word = flat.take(pos[:: least // stride], mode="clip")
                word *= by[j]
                for k in reads:
                    read[k][j] = word[:: active[k].stride // least]
            if not j & 1:
                paths[j >> 6].take(pos, mode="clip", out=path)
            np.right_shift(path, np.uint64(j & 63), out=bit)
            bit &= _ONE
            pos += bit.view(np.int64)
        for c, got in zip(active, read, strict=True):
            for m, pick in enumerate(c.picks[walk]):
                t = self.found[c.least, walk, m]
                first, *others = pick.tolist()
                h = got[first] + got[others[0]] if others else got[first]
                for j in others[1:]:
                    h += got[j]
                maybe = np.flatnonzero(t.hot.take((h >> t.bits).view(np.int64), mode="clip"))
                if not len(maybe):
                    continue
                h = h[maybe]
                lo = np.searchsorted(t.keys, h)
                good = np.flatnonzero(t.keys.take(lo, mode="clip") == h)
                if not len(good):
                    continue
                lo, hi = lo[good], np.searchsorted(t.keys, h[good], side="right")
                where = a + maybe[good] * c.stride
                owner = np.searchsorted(heads, where, side="right") - 1
                for d, p, x, y in zip(owner.tolist(), (where - heads[owner]).tolist(), lo.tolist(), hi.tolist(), strict=True):
                    found[d].update(zip(t.items[x:y].tolist(), (p - t.shifts[x:y]).tolist(), strict=True))

    def hits(self, w: np.ndarray, candidates: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(item id, first word, words, edits) of each item that occurs in w: its occurrence of fewest edits, then the first."""
        stretches: dict[int, list[list[int]]] = {}
        for k, p in sorted(candidates):
            n = len(self.words[k])
            most = self.allowed(n)
            lo, hi = max(0, p - most), p + n + most
            own = stretches.setdefault(k, [])
            if own and lo <= own[-1][1]:  # places nearby share one stretch
                own[-1][1] = hi
            else:
                own.append([lo, hi])
        best: dict[int, tuple[int, int, int]] = {}
        for k, own in stretches.items():
            item = self.words[k]
            most = self.allowed(len(item))
            for lo, hi in own:
                # an edit takes one of the item's distinct words out of the stretch at most
                if len(self.sets[k].intersection(w[lo:hi].tolist())) < len(self.sets[k]) - most:
                    continue
                got = align(item, w[lo:hi])
                if got[0] <= most and (k not in best or got[0] < best[k][0]):
                    best[k] = got[0], lo + got[1], got[2]
        return [(self.ids[k], s, n, e) for k, (e, s, n) in sorted(best.items())]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance in words of the item to a stretch of the text: (edits, first word, words)."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    diagonal, before = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
    diagonal[0], before[0] = len(item) + n + 2, 0
    for x in item:
        np.add(cost[:-1], text != x, out=diagonal[1:])
        before[1:] = begin[:-1]
        up = cost + 1
        origin = np.where(diagonal <= up, before, begin)
        # an insertion chain: the least of least[k] + (j - k) over k <= j
        slid = np.minimum(up, diagonal) - steps
        floor = np.minimum.accumulate(slid)
        where = np.maximum.accumulate(np.where(slid == floor, steps, 0))
        cost, begin = floor + steps, origin[where]
    j = int(np.argmin(cost))
    return int(cost[j]), int(begin[j]), j - int(begin[j])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    share: float = 0.2, target: float = 0.98, block_bytes: int = 4 << 20, row_col: str | None = None,
) -> DataFrame:
    """One row per document and benchmark item that occurs in it: ([row,] id, item_id, first_word, n_words, edits).

    An item occurs where a stretch of the document's words is within share * (words of the item) word edits of it, at any
    size of item; one word of it at least is unedited. Words are runs of ASCII letters and digits and of all other
    characters beyond ASCII, in lower case for A-Z. Items found are right, their edits counted exactly. Of items at the
    bound, made up and edited at random, at least the share `target` is found in trials at each length; nearer ones are
    found more often, and unedited ones always.

    Null texts are empty and match nothing, nor do items without a word or with a null id; a null document id comes
    back as null. Repeated rows give repeated results, of repeated items one. Further columns are ignored; with an
    empty table the result is empty. `row_col` names a column of unique numbers to be returned too.

    Items are taken in blocks of about `block_bytes` of text, each broadcast, against all documents in one scan per
    block: nothing is shuffled.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = [*([row_col] if row_col else []), id_col, "item_id", "first_word", "n_words", "edits"]
    rows = docs.select(id_column(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).dropna().groupBy("item", "text").count().drop("count")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()
        known = [(r.item, r.text.encode()) for r in part]
        # how many walks each length class takes is worked out here, once
        shared = spark.sparkContext.broadcast((known, WalkIndex(known, share, target).walks))
        name = uuid.uuid4().hex

        def run(batches, shared=shared, name=name):
            index = held(("walks", name), lambda: WalkIndex(shared.value[0], share, target, shared.value[1]))
            for b in batches:
                cols: list[list] = [[] for _ in names]
                ids, raw = b.column(0).to_pylist(), as_bytes(b.column(1))
                own = b.column(2).to_pylist() if row_col else ids
                for j, stop in portions([len(t) for t in raw], 250, 4 << 20):
                    texts = words_of(raw[j:stop])
                    for row, doc, w, near in zip(own[j:stop], ids[j:stop], texts, index.candidates(texts), strict=True):
                        seen = set()
                        for hit in index.hits(w, near) if near else ():
                            if hit[0] not in seen:
                                seen.add(hit[0])
                                for c, v in zip(cols, (*([row] if row_col else []), None if doc == NULL_ID else doc, *hit), strict=True):
                                    c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        got = rows.mapInArrow(tidy(run), ", ".join(f"`{n}` long" for n in names))
        out = got if out is None else out.unionByName(got)
    return out
