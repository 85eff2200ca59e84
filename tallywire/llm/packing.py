"""Packing token sequences into fixed-length training sequences under several limits at once."""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, piece_hashes, portions, prepare, ragged, tidy
from .common import held as kept_by_worker

#: Where white space runs over more than one character, a text is tokenized whole.
RUNS = re.compile(r"\s\s")
#: Characters that libraries may class differently by their version of Unicode; such chunks are left to the library.
RARE = re.compile("[\u0250-\U0010ffff]")


class ChunkTokenizer:
    """Token ids of whole texts as the tokenizers library gives them, with a cache of chunks that is bounded in chunks and ids.

    The vocabulary's pre-tokenizer always begins a new piece at a single space before a word and on both sides of a
    single line end, so texts without longer runs of white space fall into chunks that are tokenized apart. Texts with
    such runs, or with a special token's string, go to the library whole. Chunks of ASCII and Latin letters are merged by
    tiktoken under the same vocabulary, all others by the library.
    """

    CACHE, IDS = 300_000, 4 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        (self.line_end,) = self.library.encode("\n", add_special_tokens=False).ids
        self.ranks = self._ranks(path)
        self._reset()

    @staticmethod
    def _ranks(path: str):
        """The same vocabulary for tiktoken, which merges several times as fast; None where ids are not in order of merging."""
        import public_tokenizers
        import tiktoken

        from .token_counts import _byte_chars

        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        byte = {c: b for b, c in _byte_chars().items()}
        plain = (spec["normalizer"], spec["model"].get("unk_token"), spec["pre_tokenizer"]["type"]) == (None, None, "ByteLevel") and spec["pre_tokenizer"]["use_regex"] and not spec["pre_tokenizer"]["add_prefix_space"]
        if not plain or any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _reset(self) -> None:
        self.at: dict[int, int] = {}
        self.second = np.zeros(1 << 16, np.uint64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _learn(self, chunks: list[str], hashes: np.ndarray) -> None:
        """Many chunks are one text of as many lines: a single line end is a piece of its own, between any two pieces."""
        for i in range(0, len(chunks), 20_000):
            part, keys = chunks[i : i + 20_000], hashes[i : i + 20_000]
            apart = np.array([c[-1].isspace() or (c[0] != " " and c[0].isspace()) or not (c.isascii() or RARE.search(c) is None) for c in part])
            odd = [c for c, x in zip(part, apart.tolist(), strict=True) if x]
            for c, x, h in zip(odd, self.library.encode_batch(odd, add_special_tokens=False), keys[apart], strict=True):
                self._add([c], h[None], np.array(x.ids, np.uint32), None)
            if not apart.all():
                rest = [c for c, x in zip(part, apart.tolist(), strict=True) if not x]
                lines = "\n".join(rest)
                ids = np.array(self.ranks.encode_ordinary(lines) if self.ranks else self.library.encode(lines, add_special_tokens=False).ids, np.uint32)
                self._add(rest, keys[~apart], ids, np.flatnonzero(ids == self.line_end))

    def _add(self, part: list[str], hashes: np.ndarray, ids: np.ndarray, ends: np.ndarray | None) -> None:
        cuts = np.r_[-1, [] if ends is None else ends, len(ids)].astype(np.int64)
        size = np.diff(cuts) - 1
        if len(size) != len(part):
            raise ValueError("chunks and lines differ")
        n, k = len(self.at), len(self.at) + len(part)
        while k > len(self.starts):
            self.starts, self.sizes, self.second = (np.r_[x, np.zeros_like(x)] for x in (self.starts, self.sizes, self.second))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n:k], self.sizes[n:k], self.second[n:k] = self.used + cuts[:-1] + 1, size, hashes[:, 1]
        self.used += len(ids)
        self.at.update(zip(hashes[:, 0].tolist(), range(n, k), strict=True))

    def _chunked(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks of the texts, which are not empty, and each text's number of chunks.

        A chunk begins at a text's start, at a space, and at and behind a line end. It goes by two hashes of 64 bits: no
        chunk that was seen before becomes an object of its own.
        """
        size = np.array([len(t) for t in texts], np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        heads = np.cumsum(size) - size
        start = (buf == 32) | (buf == 10)
        start[1:] |= buf[:-1] == 10
        start[heads] = True
        at = np.flatnonzero(start)
        hashes = piece_hashes(buf, at)
        key, place, _ = distinct(hashes[:, 0])
        fresh = np.array([k not in self.at for k in key.tolist()], bool)
        ends = np.r_[at[1:], len(buf)]
        p = place[fresh]
        self._learn([buf[a:b].tobytes().decode() for a, b in zip(at[p].tolist(), ends[p].tolist(), strict=True)], hashes[p])
        number = np.fromiter(map(self.at.__getitem__, key.tolist()), np.int64, len(key))
        k = number[np.searchsorted(key, hashes[:, 0])]
        if (self.second[k] != hashes[:, 1]).any():
            raise ValueError("two chunks share a hash")
        return k, np.diff(np.searchsorted(at, np.r_[heads, len(buf)]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [not t or RUNS.search(t) is not None or any(s in t for s in self.special) for t in texts]
        rest = iter([np.array(x.ids, np.uint32) for x in self.library.encode_batch([t for t, w in zip(texts, whole, strict=True) if w], add_special_tokens=False)])
        parts = [t.encode() for t, w in zip(texts, whole, strict=True) if not w]
        done: list[np.ndarray] = []
        for a, b in portions([len(t) for t in parts], len(parts), 4 << 20):
            if len(self.at) > self.CACHE or self.used > self.IDS:
                self._reset()
            k, n = self._chunked(parts[a:b])
            flat = self.ids[ragged(self.starts[k], self.sizes[k])]
            ends = np.r_[0, np.cumsum(self.sizes[k])][np.cumsum(n)]
            done += np.split(flat, ends[:-1])
        others = iter(done)
        return [next(rest) if w else next(others) for w in whole]


class Packer:
    """Vector bin packing by the dot-product heuristic.

    A bin has a limit on tokens, on segments and on loss-bearing tokens. Needs and room are shares of these limits. Bins
    are filled one after another: of the items that fit, the one whose needs have the largest dot product with the
    bin's remaining room goes in, each limit weighted by how scarce it is over the block; the first by size among
    equals. So large items come first, and later ones use the limits that the bin has most left of. Items of equal
    needs are one kind, so a choice looks at each kind once. With `cut`, the room left in nearly full bins is then
    filled by cutting items of the emptiest bins, and what is left at the end is closed at powers of two, which need
    no padding.
    """

    def __init__(self, tokens: int = 2048, segments: int = 64, loss: int | None = None, cut: bool = True):
        self.cap = np.array([tokens, segments, tokens if loss is None else loss], float)
        self.cut = cut

    def place(self, length: np.ndarray, loss: np.ndarray) -> list[list[int]]:
        """The items of each bin, in the order in which they were chosen."""
        if not len(length):
            return []
        both, kind = np.unique(np.c_[-length, -loss], axis=0, return_inverse=True)  # largest first
        need = np.c_[-both[:, 0], np.ones(len(both)), -both[:, 1]] / self.cap
        order = np.argsort(kind, kind="stable")
        left = np.bincount(kind)
        ends = np.cumsum(left)
        weight = (need * left[:, None]).sum(0)
        weight = weight / weight.sum()
        bins: list[list[int]] = []
        todo = len(length)
        while todo:
            room, own = np.ones(3), []
            fits = left > 0
            while True:
                fits &= (need <= room + 1e-12).all(1)
                if not fits.any():
                    break
                k = int(np.argmax(np.where(fits, need @ (room * weight), -1.0)))
                own.append(int(order[ends[k] - left[k]]))
                left[k] -= 1
                if not left[k]:
                    fits[k] = False
                room = room - need[k]
            todo -= len(own)
            bins.append(own)
            gone = left == 0
            if gone.sum() > 64 and 2 * gone.sum() > len(left):  # kinds that are used up are not looked at again
                need, left, ends = need[~gone], left[~gone], ends[~gone]
        return bins

    def pack(self, length: np.ndarray, loss: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """length, loss: of each item, within the limits. Gives bins of pieces (item, start, length)."""
        out = [[(i, 0, int(length[i])) for i in x] for x in self.place(length, loss)]
        return self._fill(out, length, loss) if self.cut else out

    def _fill(self, bins, length, loss):
        """Cut items of the emptiest bins into the room of the fullest. Loss-bearing tokens of a cut item are shared in proportion, rounded up."""
        size, seg, most = (int(x) for x in self.cap)
        ratio = lambda i, n: -(-int(loss[i]) * n // max(int(length[i]), 1))
        tokens = [sum(p[2] for p in b) for b in bins]
        order = sorted(range(len(bins)), key=lambda k: -tokens[k])
        full, pool = [], []
        lo, hi = 0, len(order) - 1
        while lo <= hi:
            b, free = bins[order[lo]], size - tokens[order[lo]]
            borne = sum(ratio(i, n) for i, _, n in b)
            while free > 0 and len(b) < seg:
                if not pool:
                    if hi <= lo:
                        break
                    pool = bins[order[hi]][::-1]
                    hi -= 1
                i, s, n = pool.pop()
                k = min(n, free)
                while k and borne + ratio(i, k) > most:
                    k = min(k - 1, (most - borne) * max(int(length[i]), 1) // max(int(loss[i]), 1))
                if k <= 0:
                    pool.append((i, s, n))
                    break
                b.append((i, s, k))
                borne, free = borne + ratio(i, k), free - k
                if k < n:
                    pool.append((i, s + k, n - k))
            full.append(b)
            lo += 1
        if pool:
            full.append(pool[::-1])
        return [x for b in full for x in self._powers(b, size)]

    @staticmethod
    def _powers(b, size):
        """A bin that is not full, in parts whose lengths are powers of two."""
        total = sum(p[2] for p in b)
        if total == size or total & (total - 1) == 0:
            return [b]
        parts, left = [], b[::-1]
        for bit in reversed(range(total.bit_length())):
            want = total & (1 << bit)
            part = []
            while want:
                i, s, n = left.pop()
                k = min(n, want)
                part.append((i, s, k))
                want -= k
                if k < n:
                    left.append((i, s + k, n - k))
            if part:
                parts.append(part)
        return parts


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, max_tokens: int = 2048,
    max_segments: int = 64, max_loss: int | None = None, end_id: int = 1, cut: bool = True, block: int = 4_000_000, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids]).

    A document's ids are those of the tokenizers library plus end_id. loss_col is the share of its ids that bear loss
    (instruction data: the answers' share), between 0 and 1; unset or null: all of them. Documents longer than a
    sequence are cut into whole sequences and a rest. Null text counts as empty and is its end id alone. Null ids come
    back as null; repeated rows are packed each; further columns are ignored; an empty table gives an empty result.

    Every scan task packs blocks of about `block` ids by itself, so nothing is shuffled and memory is bounded. Packing
    is a function of a task's rows alone; sequence ids hold the task's number, and a task that is run anew gives the
    same rows.
    """
    prepare(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        tok = kept_by_worker(("chunks", vocabulary), lambda: ChunkTokenizer(vocabulary))
        packer = Packer(max_tokens, max_segments, max_loss, cut)
        limit = max_tokens if max_loss is None else min(max_loss, max_tokens)
        sequence = TaskContext.get().partitionId() << 36
        held: list[tuple[object, np.ndarray, float]] = []
        count = 0

        def flush():
            nonlocal sequence, held, count
            ids, owner, start, size, loss = [h[1] for h in held], [], [], [], []
            ready: list[list[tuple[int, int, int]]] = []
            for d, (_, x, share) in enumerate(held):
                step = max_tokens if share * max_tokens <= limit else max(1, int(limit / share))
                for s in range(0, len(x), step):
                    n = min(step, len(x) - s)
                    owner.append(d), start.append(s), size.append(n), loss.append(min(int(np.ceil(n * share)), limit))
            size_, loss_ = np.array(size, np.int64), np.array(loss, np.int64)
            whole = size_ == max_tokens
            ready = [[(int(i), 0, max_tokens)] for i in np.flatnonzero(whole)]
            part = np.flatnonzero(~whole)
            ready += [[(int(part[i]), s, n) for i, s, n in b] for b in packer.pack(size_[part], loss_[part])]
            cols: list[list] = [[] for _ in range(9)]
            for b in ready:
                at = 0
                for i, s, n in b:
                    d, first = owner[i], start[i] + s
                    raw = ids[d][first : first + n].astype("<u4").tobytes()
                    row = (held[d][0], first, n, zlib.crc32(raw), len(ids[d]), sequence, at, -(-loss[i] * n // size[i]), raw if with_ids else None)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                    at += n
                sequence += 1
            held, count = [], 0
            kinds = [pa.int64()] * 8 + [pa.binary()]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"]
            for k in range(0, len(cols[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 20_000], t) for c, t in zip(cols, kinds, strict=True)], names)

        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            shares = [1.0 if x is None else min(max(x, 0.0), 1.0) for x in b.column(2).to_pylist()]
            for doc, x, share in zip(b.column(0).to_pylist(), tok.encode(texts), shares, strict=True):
                held.append((doc, np.r_[x, np.uint32(end_id)], share))
                count += len(x) + 1
                if count >= block:
                    yield from flush()
        if held:
            yield from flush()

    share = F.lit(None) if loss_col is None else F.col(loss_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), share.cast("double").alias("share"))
    out = rows.mapInArrow(tidy(run), f"`{id_col}` long, {PIECES}")
    return out if with_ids else out.drop("ids")
