"""Repeated passages, by sparse suffix arrays over anchors, sorted by deep-shallow sorting."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, as_bytes, discard, id_column, mix64, prepare, ragged, release, stash, tidy

#: Bytes of an anchor's own string. Anchors with more occurrences than HOT are dealt out window by window.
GRAM, HOT = 16, 20_000
_TABLE = np.random.default_rng(20240101).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling."""
    h, k = _TABLE[buf], 1
    with np.errstate(over="ignore"):
        while k < GRAM:
            h = h[:-k] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1) + h[k:]
            h ^= h >> np.uint64(31)
            k *= 2
        return mix64(h)


def windows_to_anchors(buf: np.ndarray, width: int, chunk: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `width` bytes the position of its anchor, the gram of least hash (the first such), and that hash.

    Equal windows have their anchors at equal places, wherever they stand.
    """
    n = len(buf) - width + 1
    at, hash_ = np.zeros(max(n, 0), np.int64), np.zeros(max(n, 0), np.uint64)
    span, bits = width - GRAM + 1, np.uint64((1 << 18) - 1)
    for c in range(0, n, chunk):
        h = gram_hashes(buf[c : c + chunk + width - 1])
        low = (h & ~bits) | np.arange(len(h), dtype=np.uint64)
        k = 1
        while 2 * k <= span:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < span:
            low = np.minimum(low[: len(low) - (span - k)], low[span - k :])
        p = (low & bits).astype(np.int64)
        at[c : c + len(p)], hash_[c : c + len(p)] = p + c, h[p]
    return at, hash_


def runs_of(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window, windows, anchor's offset in the first window, hash)."""
    size = np.array([len(t) for t in texts], np.int64)
    heads = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at, hash_ = windows_to_anchors(buf, width)
    count = np.maximum(size - width + 1, 0)
    start = ragged(heads, count)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    a = at[start]
    new = np.r_[True, (np.diff(a) != 0) | (np.diff(start) != 1)]
    first = np.flatnonzero(new)
    s = start[first]
    text = np.searchsorted(heads, s, side="right") - 1
    # empty texts share their head with the next text, which is the last of them
    return text, s - heads[text], np.diff(np.r_[first, len(start)]), a[first] - s, hash_[s]


class Fields(NamedTuple):
    """How a run is held in a number of 62 bits: how many follow, the first window (32 bits), the windows of each, the anchor's offset."""

    small: int  # bits of a number below `width`

    @classmethod
    def of(cls, width: int) -> Fields:
        if not GRAM <= width < 1 << 14:
            raise ValueError(f"width must be at least {GRAM} and below {1 << 14}")
        return cls(width.bit_length())

    @property
    def follow(self) -> int:
        """Where the number of runs that follow begins; it has what bits are left, two at least."""
        return 32 + 2 * self.small

    def pack(self, text, s, n, d, h) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number, hash) of runs; runs of one anchor's string that follow on each other are one number.

        A text that repeats a short piece over and over has the same run over and over, each right behind the one before.
        """
        if not len(s):
            return text, s, h
        new = np.r_[True, (np.diff(text) != 0) | (np.diff(h) != 0) | (np.diff(n) != 0) | (np.diff(d) != 0) | (np.diff(s) != n[:-1])]
        at = np.flatnonzero(new)
        place = np.arange(len(s)) - np.repeat(at, np.diff(np.r_[at, len(s)]))
        new |= place % (1 << (62 - self.follow)) == 0
        at = np.flatnonzero(new)
        follow = np.diff(np.r_[at, len(s)]) - 1
        return text[at], (follow << self.follow) | (s[at] << 2 * self.small) | (n[at] << self.small) | d[at], h[at]

    def unpack(self, number: int) -> tuple[int, int, int, int]:
        """(runs, first window, windows of each, anchor's offset)."""
        low = (1 << self.small) - 1
        return ((number >> self.follow) & ((1 << (62 - self.follow)) - 1)) + 1, (number >> 2 * self.small) & 0xFFFFFFFF, (number >> self.small) & low, number & low


def _lcp(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by the bytes at which they branch; whole strings are compared once for each insertion."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # a node is [depth, {byte: child}, some leaf]; a leaf is a list of equal strings

    @staticmethod
    def _some_leaf(node):
        return node[2] if isinstance(node, tuple) else node

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while isinstance(node, tuple):  # blindly down to a leaf
            depth, children, leaf = node
            path.append(node)
            child = children.get(s[depth] if depth < len(s) else -1)
            if child is None:
                node = leaf
                break
            node = child
        other = self.strings[self._some_leaf(node)[0]]
        same = _lcp(s, other)
        if same == len(s) == len(other):
            node.append(i)
            return
        mine, theirs = s[same] if same < len(s) else -1, other[same] if same < len(other) else -1
        k = 0
        while k < len(path) and path[k][0] < same:
            k += 1
        if k < len(path) and path[k][0] == same:
            path[k][1][mine] = [i]
            return
        below = path[k] if k < len(path) else node
        made = (same, {theirs: below, mine: [i]}, self._some_leaf(below))
        if k == 0:
            self.root = made
        else:
            above = path[k - 1]
            above[1][s[above[0]] if above[0] < len(s) else -1] = made

    def order(self) -> list[int]:
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


class Quicksort:
    """Multikey quicksort by words of eight bytes, of all groups of strings at once.

    A segment is what has shared all words so far. In each round every segment is split in three by the word at its own
    depth: below its pivot's, equal to it, above it; the equal part goes on at the next word, the others at the same.
    A segment of one string, or at the depth where to stop, is done.
    """

    def __init__(self, strings: list[bytes], shallow: int):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.flat = np.frombuffer(b"".join(strings) + bytes(shallow + 8), np.uint8)
        self.head = np.cumsum(self.size) - self.size
        self.shallow = shallow
        self.rounds = 0

    def word(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The eight bytes of strings from a depth on, zero behind their ends."""
        at = np.minimum(self.head[i] + depth, len(self.flat) - 8)
        take = self.flat[at[:, None] + np.arange(8)]
        take = np.where(depth[:, None] + np.arange(8) < self.size[i][:, None], take, 0).astype(np.uint8)
        return np.ascontiguousarray(take).view(">u8").reshape(-1).astype(np.uint64)

    def order(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings by (group, first `shallow` bytes), and the heads of segments that tie in them."""
        n = len(group)
        order = np.argsort(group, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if n else np.zeros(0, np.int64)
        depth = np.zeros(len(heads), np.int64)
        words = self.word(order, np.zeros(n, np.int64))
        tied, draw = [], np.random.default_rng(1)
        while len(heads):
            self.rounds += 1
            sizes = np.diff(np.r_[heads, n]) if self.rounds == 1 else sizes
            done = (sizes == 1) | (depth >= self.shallow)
            tied.append(heads[done])
            heads, sizes, depth = heads[~done], sizes[~done], depth[~done]
            if not len(heads):
                break
            at = ragged(heads, sizes)
            w = words[at]
            ends = np.cumsum(sizes)
            x, y, z = (w[ends - sizes + (draw.random(len(sizes)) * sizes).astype(np.int64)] for _ in range(3))
            pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), sizes)  # of three at random the middle one
            whose = np.repeat(np.arange(len(heads)), sizes)
            below, equal = w < pivot, w == pivot
            n_below, n_equal = np.bincount(whose[below], minlength=len(heads)), np.bincount(whose[equal], minlength=len(heads))
            rank = lambda part: np.cumsum(part) - np.repeat(np.cumsum(part)[ends - sizes] - part[ends - sizes], sizes) - 1
            base = np.repeat(heads, sizes)
            to = np.where(below, base + rank(below), np.where(equal, base + np.repeat(n_below, sizes) + rank(equal), base + np.repeat(n_below + n_equal, sizes) + rank(~below & ~equal)))
            moved, moved_words = order[at], w
            order[to], words[to] = moved, moved_words
            parts = np.r_[heads, heads + n_below, heads + n_below + n_equal]
            lengths = np.r_[n_below, n_equal, sizes - n_below - n_equal]
            deeper = np.r_[depth, depth + 8, depth]
            forward = np.r_[np.zeros(len(heads), bool), np.ones(len(heads), bool), np.zeros(len(heads), bool)]
            some = lengths > 0
            parts, lengths, deeper, forward = parts[some], lengths[some], deeper[some], forward[some]
            next_ = forward & (lengths > 1) & (deeper < self.shallow)
            to_read = ragged(parts[next_], lengths[next_])
            words[to_read] = self.word(order[to_read], np.repeat(deeper[next_], lengths[next_]))
            heads, sizes, depth = parts, lengths, deeper
        return order, np.sort(np.concatenate(tied)) if tied else np.zeros(0, np.int64)


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, string), and the bytes each string shares with the one before it; -1 where a group begins.

    Multikey quicksort by words of eight bytes down to `shallow` bytes; blind tries order what still ties.
    """
    n = len(strings)
    order, heads = Quicksort(strings, shallow).order(group)
    bounds = np.r_[heads, n]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            trie = BlindTrie(strings)
            for i in order[a:b].tolist():
                trie.insert(i)
            order[a:b] = trie.order()
    ranked = order.tolist()
    lcp = np.array([-1, *(_lcp(strings[x], strings[y]) for x, y in zip(ranked, ranked[1:], strict=False))][:n], np.int64)
    g = group[order]
    lcp[1:][np.diff(g) != 0] = -1
    return order, lcp


def later_windows(spans: list[bytes], group: np.ndarray, offset: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(span, window) of every window that an earlier span of its group has too; spans are in order of place.

    A span is a run's bytes; window j begins at its byte j, with the anchor offset - j further on. Two windows are equal
    when their anchors are equally far in, and so are the bytes before and behind the anchor: those are prefixes of the
    reversed left and of the right contexts, which two suffix arrays have in order.
    """
    right, lcp_r = deep_shallow([s[d:] for s, d in zip(spans, offset.tolist(), strict=True)], group)
    left, lcp_l = deep_shallow([s[:d][::-1] for s, d in zip(spans, offset.tolist(), strict=True)], group)
    n = len(spans)
    at_r, at_l = np.empty(n, np.int64), np.empty(n, np.int64)
    at_r[right], at_l[left] = np.arange(n), np.arange(n)
    whose, which = [], []
    for inside in range(width - GRAM + 1):
        j = offset - inside
        sel = np.flatnonzero((j >= 0) & (j < count))
        if len(sel) < 2:
            continue
        id_r, id_l = np.cumsum(lcp_r < width - inside), np.cumsum(lcp_l < inside)
        key = id_r[at_r[sel]] * (n + 1) + id_l[at_l[sel]]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(sel), bool)
        again[first] = False
        whose.append(sel[again]), which.append(j[sel[again]])
    return (np.concatenate(whose), np.concatenate(which)) if whose else (np.zeros(0, np.int64), np.zeros(0, np.int64))


FLAGS = "doc long, th long, start long, windows long"


def _flag_batch(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "th", "start", "windows"])


def _chained(repeats: list[tuple]) -> list[tuple]:
    """Sorted runs of repeated windows (doc, th, first window, windows), those of one text that touch made one."""
    out: list[tuple] = []
    for doc, th, s, n in sorted(repeats):
        if out and out[-1][0] == doc and out[-1][1] == th and s <= out[-1][2] + out[-1][3]:
            out[-1] = (doc, th, out[-1][2], max(out[-1][3], s + n - out[-1][2]))
        else:
            out.append((doc, th, s, n))
    return out


class _First:
    """The first place of each string; every other place is passed on as a repeat."""

    def __init__(self):
        self.at: dict[bytes, tuple] = {}

    def offer(self, key: bytes, place: tuple, repeats: list) -> None:
        """place: (doc, th, first window, windows, ...). The same place twice is one place."""
        held = self.at.get(key)
        if held is None:
            self.at[key] = place
        elif place[:3] != held[:3]:
            if place[:3] < held[:3]:
                self.at[key], place = place, held
            repeats.append(place[:4])


def text_key(text: Column, salt: int = 0) -> Column:
    """A number for a text; a salt gives another one."""
    return F.xxhash64(text, F.lit(salt)) if salt else F.xxhash64(text)


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]).

    A byte is removed when a string of `width` bytes that covers it also starts earlier: in a document of smaller id, or
    further ahead in the same one. Texts are UTF-8 bytes, null counts as empty; a null id orders before all others and
    comes back as null. Rows that repeat an id and its text are one document and get one result; different texts under
    one id are ordered by a hash. Further columns are ignored; an empty table gives an empty result.

    A window's anchor is its gram of least hash, so equal windows meet at equal anchors; runs of windows with one anchor,
    about one for 43 bytes, are what is shuffled, as numbers. Only of anchors that occur again the bytes are fetched;
    equal ones are merged before the shuffle, and an anchor with more than HOT occurrences is dealt out by whole windows
    instead, so no task gets all occurrences of a frequent line. Exact copies of a text are found first, by digest. A
    text goes by a 64-bit key; keys that two texts share are found by the digests and replaced. `width` may be from GRAM
    to 16383. Which anchors recur is found by a window over an anchor's runs, as numbers: those of one anchor are in one
    task there, which spills.
    """
    spark = docs.sparkSession
    prepare(spark)
    fields = Fields.of(width)
    plain = docs.select(id_column(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key, salt = text_key(F.col("text")), 0
    while True:
        rows = plain.withColumn("th", key)
        names = stash(rows.select("doc", "th", F.unhex(F.sha2("text", 256)).alias("digest")), "texts")
        first = stash(names.groupBy("th").agg(F.min("doc").alias("doc"), (F.min("digest") < F.max("digest")).alias("shared")), "first")
        found = [r.th for r in first.filter("shared").select("th").limit(10_000).collect()]
        if not found:
            break
        discard(names, first)
        salt += 1
        key = F.when(key.isin(found), text_key(F.col("text"), salt)).otherwise(key)
    copies = names.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    copied = stash(names.join(copies, "digest").filter("doc <> first").select("doc", "th").distinct(), "copies")

    def runs(batches):
        seen: set[int] = set()
        for b in batches:
            th, raw = b.column(0).to_pylist(), as_bytes(b.column(1))
            keep = []
            for k, t in enumerate(th):
                if t not in seen and len(raw[k]) >= width:
                    seen.add(t), keep.append(k)
            for j in range(0, len(keep), 1000):
                part = keep[j : j + 1000]
                text, number, h = fields.pack(*runs_of([raw[k] for k in part], width))
                ids = np.array([th[k] for k in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[text] if len(text) else text), pa.array(number)], ["anchor", "th", "pack"])

    anchors = rows.select("th", "text").mapInArrow(tidy(runs), "anchor long, th long, pack long")
    same = Window.partitionBy("anchor")
    again = anchors.withColumns({"n": F.sum(F.shiftright("pack", fields.follow) + 1).over(same), "a": F.min("th").over(same), "z": F.max("th").over(same), "p": F.min("pack").over(same), "q": F.max("pack").over(same)}).filter(f"a <> z or p <> q or shiftright(q, {fields.follow}) > 0")
    hot = F.when(F.col("n") > HOT, F.lit(1 << 62)).otherwise(F.lit(0)).cast("long")
    wanted = again.select("th", F.col("pack").bitwiseOR(hot).alias("pack")).groupBy("th").agg(F.collect_set("pack").alias("packs"))
    wanted = stash(wanted.join(first.select("th", "doc"), "th"), "wanted")
    discard(names, first)
    release(spark)

    route = "route long, doc long, th long, start long, windows long, offset long, span binary"
    kinds = [pa.int64()] * 6 + [pa.binary()]
    route_names = [x.split()[0] for x in route.split(", ")]

    def spans(batches):
        from xxhash import xxh3_64_intdigest

        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        for b in batches:
            whole, single, repeats = _First(), _First(), []
            for doc, th, raw, packs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                for p in packs:
                    runs_, first_, n, d = fields.unpack(p)
                    for s in range(first_, first_ + runs_ * n, n):
                        if s + n - 1 + width > len(raw):
                            break
                        if p >> 62:
                            for k in range(n):
                                single.offer(raw[s + k : s + k + width], (doc, th, s + k, 1, d - k), repeats)
                        else:
                            whole.offer(d.to_bytes(2, "big") + raw[s : s + n - 1 + width], (doc, th, s, n, d), repeats)
            out = [(signed(xxh3_64_intdigest(k[(at := 2 + int.from_bytes(k[:2], "big")) : at + GRAM])), *v, k[2:]) for k, v in whole.at.items()]
            out += [(signed(xxh3_64_intdigest(k, seed=1)), *v, k) for k, v in single.at.items()]
            out += [(None, *r, None, None) for r in _chained(repeats)]
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 20_000], strict=True), kinds, strict=True)], route_names)

    texts = rows.select("doc", "th", "text").join(wanted, ["doc", "th"]).select("doc", "th", "text", "packs")
    found = stash(texts.mapInArrow(tidy(spans), route), "spans")
    discard(wanted)
    release(spark)

    def compare(batches):
        held, size = [], 0

        def flush():
            repeats: list = []
            distinct: dict[int, _First] = {}
            for r, *place, span in held:
                distinct.setdefault(r, _First()).offer(place[4].to_bytes(2, "big") + span, tuple(place), repeats)
            rest = [(*v, k[2:], g) for g, f in enumerate(distinct.values()) if len(f.at) > 1 for k, v in f.at.items()]
            rest.sort(key=lambda x: (x[0], x[1], x[2] + x[4]))
            if rest:
                group, offset, count = (np.array([x[i] for x in rest], np.int64) for i in (6, 4, 3))
                whose, which = later_windows([x[5] for x in rest], group, offset, count, width)
                order = np.lexsort((which, whose))
                whose, which = whose[order], which[order]
                new = np.flatnonzero(np.r_[True, (np.diff(whose) != 0) | (np.diff(which) != 1)][: len(whose)])
                for w, j, n in zip(whose[new].tolist(), which[new].tolist(), np.diff(np.r_[new, len(whose)]).tolist(), strict=True):
                    repeats.append((rest[w][0], rest[w][1], rest[w][2] + j, n))
            return _flag_batch(_chained(repeats))

        now = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != now and size > 24 << 20:
                    yield flush()
                    held, size = [], 0
                now = row[0]
                held.append(row)
                size += len(row[6]) + 64
        if held:
            yield flush()

    local = found.filter("route is null").select("doc", "th", "start", "windows")
    dealt = found.filter("route is not null").repartition("route").sortWithinPartitions("route").mapInArrow(tidy(compare), FLAGS)
    flags = local.unionByName(dealt).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "windows")).alias("f"))
    marks = flags.select("doc", "th", F.col("f.start").alias("starts"), F.col("f.windows").alias("counts"), F.lit(False).alias("copy"))
    empty = F.array().cast("array<bigint>")
    status = stash(marks.join(copied, ["doc", "th"], "left_anti").unionByName(copied.select("doc", "th", empty.alias("starts"), empty.alias("counts"), F.lit(True).alias("copy"))), "marks")
    discard(found, copied)
    release(spark)

    def cut(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, raw, starts, counts, copy in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), *(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                kept, removed, n, at = [], 0, 0, 0
                if copy and len(raw) >= width:
                    removed, n, at = len(raw), 1, len(raw)
                elif starts:
                    for s, e in _merged(sorted((s, s + c - 1 + width) for s, c in zip(starts, counts, strict=True))):
                        kept.append(raw[at:s])
                        removed, n, at = removed + e - s, n + 1, e
                kept.append(raw[at:])
                rest = b"".join(kept)
                for c, v in zip(cols, (None if doc == NULL_ID else doc, len(raw), removed, n, hashlib.sha256(rest).hexdigest(), rest if with_text else None), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = rows.join(status, ["doc", "th"], "left").select("doc", "text", "starts", "counts", "copy").mapInArrow(tidy(cut), f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")


def _merged(spans):
    """Sorted intervals, those that touch or overlap made one."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out
