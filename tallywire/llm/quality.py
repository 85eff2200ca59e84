"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, discard, distinct, id_column, mix64, portions, prepare, release, stash, tidy

#: Length of the longest n-grams, in characters.
ORDER = 5
#: What an unseen character's share of the lowest order is spread over: about the number of characters of Unicode.
SYMBOLS = 150_000
#: N-grams that the texts of a chunk have in common, about: a chunk has SHARE characters for each. Its texts take one table of prices.
COMMON, SHARE = 1 << 18, 64
#: Ids of training documents that are broadcast; with more of them, texts meet them in a join.
IDS = 1 << 21
#: Trusted documents from which on a fifth of them is held out for the thresholds, and documents a language needs for its own.
SPLIT, ENOUGH = 1000, 100
#: A unit's characters at most, but for the space behind it.
UNIT = 16
REPEAT = 3

_SPACE, _LETTER = 32, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 1 a letter, 2 a digit, 3 white space, 0 anything else."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        out[cp] = _LETTER if c.isalpha() else 2 if c.isdigit() else 3 if c.isspace() else 0
    return out


class Symbols:
    """The symbols of texts and the n-gram that ends at each of them.

    A text is read with a space before and behind it; all its characters but that first space are symbols, and a null
    character counts as U+FFFD. Units are runs of one kind of characters (letters, digits, white space, others), cut
    into pieces of UNIT; a space ends a unit, and a run of letters takes the space behind it along. A run of letters
    that is the same as the text's run of letters before it begins with the symbol REPEAT. An n-gram has up to ORDER
    characters and goes back to the one before its unit at most. Pieces of a long text (`in_pieces`) are read as texts.
    """

    def __init__(self, texts: list[str]):
        n = np.array([len(t) + 2 if t else 0 for t in texts], np.int64)
        code = np.frombuffer("".join(f" {t} " for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(texts)), n)
        lead = np.zeros(len(code), bool)  # the space before a text
        lead[(np.cumsum(n) - n)[n > 0]] = True
        code = np.where(code == 0, 0xFFFD, code).astype(np.uint32)
        kind = _kinds()[code]
        start = np.ones(len(code), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (code[:-1] == _SPACE) | lead[1:]
        at = np.flatnonzero(start)
        place = np.arange(len(code)) - np.repeat(at, np.diff(np.r_[at, len(code)]))
        runs = at[kind[at] == _LETTER]
        again = self._again(code, kind, place, runs, owner)
        start |= place % UNIT == 0
        start[1:] &= ~((code[1:] == _SPACE) & (kind[:-1] == _LETTER))
        if len(again):
            before = again + np.arange(len(again))
            keep = np.ones(len(code) + len(again), bool)
            keep[before] = False
            wide = np.full(len(keep), REPEAT, np.uint32)
            wide[keep] = code
            first = np.zeros(len(keep), bool)
            first[keep] = start
            first[before], first[before + 1] = True, False
            whose, head = np.zeros(len(keep), np.int64), np.zeros(len(keep), bool)
            whose[keep], head[keep] = owner, lead
            whose[before] = owner[again]
            code, start, owner, lead = wide, first, whose, head
        at = np.flatnonzero(start)
        back = np.arange(len(code)) - np.repeat(at, np.diff(np.r_[at, len(code)])) + 2
        sel = np.flatnonzero(~lead)
        self.code, self.at, self.owner = code, sel, owner[sel]
        self.length = np.minimum(back[sel], ORDER)
        self.hash = self.hash_of(code, sel, self.length)

    @staticmethod
    def _again(code, kind, place, runs, owner) -> np.ndarray:
        """Where runs of letters begin that are the same as the run of letters before."""
        if len(runs) < 2:
            return runs[:0]
        with np.errstate(over="ignore"):
            each = np.where(kind == _LETTER, mix64(code.astype(np.uint64) + place.astype(np.uint64) * _ODD), np.uint64(0))
            whole = np.add.reduceat(each, runs)
        return runs[1:][(whole[1:] == whole[:-1]) & (owner[runs[1:]] == owner[runs[:-1]])]

    @staticmethod
    def hash_of(code: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A hash of the n-grams of given lengths that end at given places."""
        wide = code.astype(np.uint64) + np.uint64(1)
        h = wide[at]
        with np.errstate(over="ignore"):
            for k in range(1, ORDER):
                more = np.flatnonzero(length > k)
                h[more] = h[more] * _ODD + wide[at[more] - k]
        return mix64(h)

    def grams(self, k: np.ndarray) -> np.ndarray:
        """The n-grams that end at the k-th symbols, as strings."""
        at, length = self.at[k], self.length[k]
        out = np.zeros((len(k), ORDER), np.uint32)
        for i in range(ORDER):
            some = length > i
            out[some, i] = self.code[at[some] - length[some] + 1 + i]
        return out.view(f"<U{ORDER}").reshape(-1)


#: Characters that are read at a time. Longer texts are read in pieces, cut behind a space or, without one, anywhere.
PIECE = 1 << 18


def in_pieces(texts: list[str]):
    """Lists of texts or pieces of texts, of 100 and about PIECE characters at most, with the numbers of the texts they are of."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        while len(t) > PIECE:
            cut = t.rfind(" ", 1, PIECE)
            cut = cut if cut > 0 else PIECE
            parts.append(t[:cut]), owner.append(i)
            t = t[cut + 1 :] if t[cut] == " " else t[cut:]
        parts.append(t), owner.append(i)
    for a, b in portions([len(x) for x in parts], 100, PIECE):
        yield parts[a:b], np.array(owner[a:b])


class GramCounts:
    """Counts of n-grams by their hashes, with one n-gram of each hash."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, texts: list[str], trains: np.ndarray) -> None:
        s = Symbols(texts)
        if not len(s.hash):
            return
        key, first, n = distinct(s.hash)
        some, _, t = distinct(s.hash[trains[s.owner]])
        of_training = np.zeros(len(key), np.int64)
        of_training[np.searchsorted(key, some)] = t
        self.parts.append((key, s.grams(first), n, of_training))
        self.rows += len(key)
        if self.rows > 600_000:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        key, gram, n, t = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.parts = [(key[at], gram[order[at]], np.add.reduceat(n[order], at), np.add.reduceat(t[order], at))]
        self.rows = len(at)

    def drain(self):
        self.merge()
        for _, gram, n, t in self.parts:
            for k in range(0, len(gram), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(gram[k : k + 50_000].tolist(), pa.string()), pa.array(n[k : k + 50_000]), pa.array(t[k : k + 50_000])], ["gram", "n", "t"])
        self.parts, self.rows = [], 0


def _count_grams(batches):
    """(chunk, gram, t): the n-grams of each chunk, and how often each occurs in documents that train. Bounded: full tables are passed on."""
    tables: dict[int, GramCounts] = {}

    def drained(chunk):
        for b in tables.pop(chunk).drain():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, chunk, np.int32)), b.column(0), b.column(2)], ["chunk", "gram", "t"])

    for b in batches:
        for chunk, some in _runs(b.column(0).to_numpy()):
            counts = tables.setdefault(chunk, GramCounts())
            texts = ["" if t is None else t for t in b.column(1)[some].to_pylist()]
            trains = np.array([bool(x) for x in b.column(2)[some].to_pylist()], bool)
            for part, owner in in_pieces(texts):
                counts.add(part, trains[owner])
            if counts.rows > 400_000 and len(counts.parts) == 1:
                yield from drained(chunk)
    for chunk in list(tables):
        yield from drained(chunk)


def _runs(values: np.ndarray):
    """Runs of equal values: the value and where it stands."""
    at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(values)], strict=True):
        yield values[i].item(), slice(i, j)


def kneser_ney(grams: DataFrame) -> tuple[DataFrame, float]:
    """(gram, p, gamma) of every string that is a seen n-gram or a context, and the lowest order's weight of unseen symbols.

    grams: (gram, t). p is the probability of a gram's last symbol behind the others, gamma the weight of the next lower
    order behind the whole gram. Whole n-grams count occurrences, also those that a unit's start makes shorter; a lower
    order counts the distinct symbols before an n-gram. Each order has three discounts from its counts of counts. All
    counts are joined by context and, with the next lower order's probabilities, by suffix: sharded, and as many as the
    trusted text has n-grams.
    """
    raw = stash(grams.filter("t > 0").select("gram", F.col("t").alias("c")), "trained")
    tables = {ORDER: raw.filter(F.length("gram") == ORDER)}
    for k in range(ORDER - 1, 0, -1):
        lower = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))
        tables[k] = stash(lower.unionByName(raw.filter(F.length("gram") == k)).groupBy("gram").agg(F.sum("c").alias("c")), f"counts{k}")
    parts, below, unseen = [], None, 1.0
    for k in range(1, ORDER + 1):
        t = tables[k]
        n1, n2, n3, n4 = (x or 0 for x in t.agg(*(F.sum((F.col("c") == i).cast("long")) for i in range(1, 5))).first())
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        # small tables may lack counts of counts: discounts stay between 0 and the count
        d = [min(max(v, 0.1), i) for i, v in ((0.95, 1 - 2 * y * n2 / max(n1, 1)), (1.9, 2 - 3 * y * n3 / max(n2, 1)), (2.9, 3 - 4 * y * n4 / max(n3, 1)))]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        t = t.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("off", off)
        sums = t.groupBy("context").agg(F.sum("c").alias("total"), F.sum("off").alias("mass"))
        own = t.join(sums, "context").select("gram", ((F.col("c") - F.col("off")) / F.col("total")).alias("own"), (F.col("mass") / F.col("total")).alias("gamma"))
        if below is None:
            first = sums.agg(F.sum("mass") / F.sum("total")).first()[0]
            unseen = 1.0 if first is None else float(first)
            p = own.select("gram", (F.col("own") + F.col("gamma") / SYMBOLS).alias("p"))
        else:
            lower = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            p = own.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower, "suffix").select("gram", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"))
            parts.append(sums.select(F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), (F.col("mass") / F.col("total")).alias("gamma")))
        below = stash(p, f"p{k}")
        parts.append(below.select("gram", "p", F.lit(None).cast("double").alias("gamma")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return stash(every.groupBy("gram").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma")), "model"), unseen


def gram_scores(grams: DataFrame, model: DataFrame, unseen: float) -> DataFrame:
    """(gram, logp) of each gram of the column gram: that of the model, or else of its longest seen end, times the weights of the contexts above."""
    known = stash(grams.join(model.select("gram", "p"), "gram", "left"), "known")
    # for each order j the end of j symbols, whose probability it may take, and the context of j - 1 symbols
    n = F.length("gram")
    j = F.col("j")
    wanted = known.filter("p is null").withColumn("j", F.explode(F.sequence(F.lit(1), n)))
    keys = F.array(
        F.struct(F.lit(True).alias("ends"), F.substring(F.col("gram"), n - j + 1, j).alias("key")),
        F.struct(F.lit(False).alias("ends"), F.substring(F.col("gram"), n - j + 1, j - 1).alias("key")),
    )
    asked = wanted.select("gram", "j", F.explode(keys).alias("k")).select("gram", "j", "k.ends", "k.key").filter("key <> ''")
    found = asked.join(model.select(F.col("gram").alias("key"), "p", "gamma"), "key")
    pick = lambda j, ends: F.max(F.when((F.col("j") == j) & (F.col("ends") == ends), F.col("p" if ends else "gamma")))
    seen = found.groupBy("gram").agg(*(pick(j, True).alias(f"p{j}") for j in range(1, ORDER + 1)), *(pick(j, False).alias(f"g{j}") for j in range(2, ORDER + 1)))
    value = F.coalesce("p1", F.lit(unseen / SYMBOLS))
    for k in range(2, ORDER + 1):
        value = F.coalesce(f"p{k}", F.coalesce(f"g{k}", F.lit(1.0)) * value)
    return known.select("gram", "p").join(seen, "gram", "left").select("gram", F.log(F.coalesce("p", value)).alias("logp"))


class Prices:
    """Sums of log probabilities over the symbols of texts, from a table of n-grams; n-grams it does not have are left over."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray):
        """grams: an array of strings."""
        wide = grams.astype(f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
        length = (wide != 0).sum(1)
        key = Symbols.hash_of(wide[wide != 0], np.cumsum(length) - 1, length)
        bits = max(int(2 * len(key)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.logp, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits), np.zeros(1 << bits, bool)
        left, at = np.arange(len(key)), (key >> self.shift).astype(np.int64)
        while len(left):  # open addressing: of those that want a slot one gets it, the others go on to the next
            free = ~self.used[at]
            self.key[at[free]] = key[left[free]]
            mine = free & (self.key[at] == key[left])
            self.logp[at[mine]] = logp[left[mine]]
            self.used[at[free]] = True
            left, at = left[~mine], (at[~mine] + 1) & self.mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The log probability of each hash; nan without one."""
        at = (h >> self.shift).astype(np.int64)
        hit = (self.key[at] == h) & self.used[at]
        out = np.where(hit, self.logp[at], np.nan)
        left = np.flatnonzero(~hit & self.used[at])
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            used = self.used[at]
            hit = used & (self.key[at] == h[left])
            out[left[hit]] = self.logp[at[hit]]
            left, at = left[used & ~hit], at[used & ~hit]
        return out

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[int]]]:
        """Each text's number of symbols, its sum over known n-grams, and the n-grams left over with their numbers."""
        n, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        left: list[Counter] = [Counter() for _ in texts]
        for part, owner in in_pieces(texts):
            s = Symbols(part)
            got = self.find(s.hash)
            whose = owner[s.owner]
            n += np.bincount(whose, minlength=len(texts))
            lost = np.flatnonzero(np.isnan(got))
            got[lost] = 0
            sums += np.bincount(whose, weights=got, minlength=len(texts))
            for i, g in zip(whose[lost].tolist(), s.grams(lost).tolist(), strict=True):
                left[i][g] += 1
        return n, sums, [list(x) for x in left], [list(x.values()) for x in left]


def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (doc, text[, row], ...) with the number of their chunk, and how many chunks there are. A row's chunk follows from what it holds."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = int(max(1, -(-total // (COMMON * SHARE))))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("row") if "row" in rows.columns else F.xxhash64("doc", "text"), F.lit(chunks)).cast("int")), chunks


#: Bytes of rows that a task holds to pack those of a chunk together.
HELD = 1 << 25


def _packed(batches):
    """(chunk, pack): the rows of a task by chunk, compressed, about HELD bytes of them at a time: half as much to shuffle."""
    rows, size = [], 0
    for b in batches:
        rows.append(b)
        size += b.nbytes
        if size >= HELD:
            yield _packs(rows)
            rows, size = [], 0
    if rows:
        yield _packs(rows)


def _packs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(rows).combine_chunks()
    chunk = table.column("chunk").to_numpy()
    order = np.argsort(chunk, kind="stable")
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    keys, packs = [], []
    for key, some in _runs(chunk[order]):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema, options=options) as stream:
            stream.write_table(table.take(pa.array(order[some])))
        keys.append(key)
        packs.append(out.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packs, pa.binary())], ["chunk", "pack"])


def document_scores(rows: DataFrame, chunks: int, pairs: DataFrame, prices: DataFrame) -> DataFrame:
    """([row,] doc, lang, n_symbols, s): s is the sum of the log probabilities of all symbols of a row's text.

    rows: (chunk, doc, text, lang[, row]); pairs: (chunk, gram), the n-grams of each chunk's texts; prices: (gram, logp).
    Pairs are joined with prices by n-gram, and what comes of that meets the packed texts by chunk: a task sums up a chunk's
    texts with the prices of that chunk's n-grams. Both joins are sharded; an n-gram comes once a chunk, however common.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields if f.name in ("row", "doc", "lang", "text")}
    table = pairs.join(prices, "gram").select("chunk", "gram", "logp", F.lit(None).cast("binary").alias("pack"))
    packs = rows.select("chunk", *kinds).mapInArrow(tidy(_packed), "chunk int, pack binary")
    texts = packs.select("chunk", F.lit(None).cast("string").alias("gram"), F.lit(None).cast("double").alias("logp"), "pack")
    both = table.unionAll(texts).repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", F.col("gram").isNull())
    kept = [c for c in kinds if c != "text"]

    def run(batches):
        chunk, grams, logp, known = None, [], [], None
        for b in batches:
            is_text = b.column("gram").is_null().to_numpy(zero_copy_only=False)
            for key, some in _runs(b.column("chunk").to_numpy().astype(np.int64) * 2 + is_text):
                part = b.slice(some.start, some.stop - some.start)
                if key // 2 != chunk:
                    chunk, grams, logp, known = key // 2, [], [], None
                if not key % 2:
                    grams.append(np.array(part.column("gram").to_pylist(), f"<U{ORDER}"))
                    logp.append(part.column("logp").to_numpy())
                    continue
                if known is None:
                    known = Prices(np.concatenate(grams or [np.zeros(0, f"<U{ORDER}")]), np.concatenate(logp or [np.zeros(0)]))
                    grams, logp = [], []
                for pack in part.column("pack"):
                    for texts in pa.ipc.open_stream(pack.as_buffer()):
                        n, s, left, _ = known.read(["" if t is None else t for t in texts.column("text").to_pylist()])
                        if any(left):
                            raise ValueError(f"n-grams of chunk {chunk} have no price")
                        yield pa.RecordBatch.from_arrays([*(texts.column(c) for c in kept), pa.array(n), pa.array(s)], [*kept, "n_symbols", "s"])

    return both.mapInArrow(tidy(run), ", ".join(f"{c} {kinds[c].simpleString()}" for c in kept) + ", n_symbols long, s double")


def perplexity_verdicts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.999, slack: float = 0.02, pseudo: float = 200.0,
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: ([row,] id, lang, n_symbols, perplexity, threshold, kept).

    Trusted text is that of documents with a label of quality 1 and toxic 0 or null. From SPLIT trusted documents on,
    four fifths of them, by a hash of the id, train the model and the others set the thresholds; with fewer, all of them
    do both. The model's n-grams are of up to ORDER characters of any script (`Symbols`). A document's perplexity per symbol is smoothed by `pseudo` symbols of its language's mean, so
    that short texts do not scatter. It is rejected if that is above its language's `quantile`, plus `slack`.

    Null text is empty and scores the mean. A language with fewer than ENOUGH documents that set thresholds takes the
    quantile of all languages, each document taken relative to its language's mean; a null or unlabelled language takes
    the mean of all too. Without trusted text there is no model: all documents are kept, with null perplexity. Null ids
    are never trusted and come back as null; repeated rows each get theirs, alike; further columns are ignored; an empty
    table gives an empty result. `row_col` names a column of unique numbers to be returned too.

    Counts of n-grams grow with the corpus; chunks of texts add them up and they are joined by key. A text's perplexity
    comes of joins too (`document_scores`), for its commonest n-grams as for its rarest. Texts are dealt out by chunk,
    once to count and once to score. Only the ids of training documents are broadcast, up to IDS of them; beyond that
    texts are joined with them.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(id_column(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    trusted = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc")).distinct()
    trusted = stash(trusted.withColumn("held", F.pmod(F.xxhash64("doc"), F.lit(5)) == 0), "trusted")
    split = trusted.count() >= SPLIT
    trains = trusted.filter("not held") if split else trusted
    flags = trains.select("doc", F.lit(True).alias("trains"))
    rows, chunks = dealt(rows)
    marked = rows.select("chunk", "doc", "text").join(F.broadcast(flags) if trains.count() <= IDS else flags, "doc", "left").select("chunk", "text", "trains")
    pairs = stash(marked.repartitionById(chunks, F.col("chunk")).mapInArrow(tidy(_count_grams), "chunk int, gram string, t long"), "pairs")
    release(spark)
    counts = stash(pairs.groupBy("gram").agg(F.sum("t").alias("t")), "grams")
    model, unseen = kneser_ney(counts)
    known = not model.isEmpty()
    prices = stash(gram_scores(counts.select("gram"), model, unseen), "prices")
    release(spark)
    discard(counts, model)
    scores = stash(document_scores(rows, chunks, pairs.select("chunk", "gram"), prices), "scores")
    release(spark)
    discard(pairs, prices)

    sets = scores.join(trusted.filter("held") if split else trusted, "doc", "left_semi")
    mean = F.try_divide(F.sum("s"), F.sum("n_symbols")).alias("mean")
    all_mean = sets.agg(mean).first()["mean"] or 0.0
    by_lang = stash(sets.groupBy("lang").agg(mean).filter("lang is not null"), "means")
    of_lang = F.coalesce("mean", F.lit(all_mean))
    smooth = F.exp(-(F.col("s") + pseudo * of_lang) / (F.col("n_symbols") + pseudo))
    seen = sets.join(by_lang, "lang", "left").withColumn("ppl", smooth).withColumn("above", F.col("ppl") * F.exp(of_lang))
    at = lambda c: F.percentile_approx(c, quantile, 100_000)
    all_above = seen.agg(at("above")).first()[0] or 1.0
    own = seen.groupBy("lang").agg(at("ppl").alias("limit"), F.count("*").alias("n")).filter(F.col("n") >= ENOUGH).select("lang", "limit")
    limits = stash(by_lang.join(own, "lang", "left"), "limits")
    out = scores.join(limits, "lang", "left").withColumn("perplexity", smooth if known else F.lit(None).cast("double"))
    threshold = F.coalesce("limit", all_above * F.exp(-of_lang)) * (1 + slack)
    out = out.withColumn("threshold", threshold if known else F.lit(None).cast("double"))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept")
    named = [F.col("row").alias(row_col)] if row_col else []
    return out.select(*named, F.when(F.col("doc") != NULL_ID, F.col("doc")).alias(id_col), "lang", "n_symbols", "perplexity", "threshold", kept)
