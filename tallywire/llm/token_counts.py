"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, prepare, ragged, tidy

#: Characters that the vocabulary's normalizer takes for white space.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: White space to Python's split() alone.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """Counts what byte-pair merging leaves of each pre-token.

    Symbols of all pre-tokens stand in one flat array with a length each. In every round each sequence finds the pair
    of lowest rank among its neighbours, and all its occurrences, left to right without overlap, are merged at once.
    A pre-token of more than LONG symbols would take very many rounds over all of them: of such ones the pairs wait in
    a heap by rank and place, and a merge looks again at its two neighbours only, which makes the same merges.
    """

    LONG = 400

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab = vocab
        size = max(vocab.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.ranks, self.made = size, keys[order], order.astype(np.int64), made[order]
        self.suffix, self.chars = suffix, _byte_chars()
        self.pairs: dict[int, tuple[int, int]] = {}

    def symbols(self, word: str) -> list[int]:
        c = [self.chars[b] for b in word.encode()]
        c[-1] += self.suffix
        return [self.vocab[x] for x in c]

    def _lazily(self, seq: list[int]) -> int:
        """The number of symbols left of one long sequence."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        n, size, pairs = len(seq), self.size, self.pairs
        seq = [*seq, -1]
        ahead, back = list(range(1, n + 2)), list(range(-1, n))
        heap = [(pairs[k][0], i, k) for i in range(n - 1) if (k := seq[i] * size + seq[i + 1]) in pairs]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, k = heapq.heappop(heap)
            j = ahead[i]
            if seq[i] < 0 or j >= n or seq[i] * size + seq[j] != k:
                continue
            seq[i], seq[j] = pairs[k][1], -1
            ahead[i] = ahead[j]
            if ahead[j] < n:
                back[ahead[j]] = i
            left -= 1
            for a in (back[i], i):
                if a >= 0 and (b := ahead[a]) < n and (k := seq[a] * size + seq[b]) in pairs:
                    heapq.heappush(heap, (pairs[k][0], a, k))
        return left

    def counts(self, words: list[str]) -> np.ndarray:
        """The number of symbols left of each pre-token; none of them is empty."""
        seqs = [self.symbols(w) for w in words]
        long = {i: self._lazily(s) for i, s in enumerate(seqs) if len(s) > self.LONG}
        if long:
            out = np.zeros(len(seqs), np.int64)
            short = [i for i in range(len(seqs)) if i not in long]
            out[list(long)] = list(long.values())
            out[short] = self._together([seqs[i] for i in short])
            return out
        return self._together(seqs)

    def _together(self, seqs: list[list[int]]) -> np.ndarray:
        n = np.array([len(s) for s in seqs], np.int64)
        flat = np.array([x for s in seqs for x in s], np.int64)
        live = np.arange(len(seqs))
        out = n.copy()
        while len(live):
            owner = np.repeat(np.arange(len(live)), n)
            if len(flat) < 2:
                break
            key = flat[:-1] * self.size + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], np.iinfo(np.int64).max)
            best = np.full(len(live), np.iinfo(np.int64).max)
            np.minimum.at(best, owner[:-1], rank)
            hit = (rank == best[owner[:-1]]) & (rank < np.iinfo(np.int64).max)
            # runs of overlapping hits (a a a): every other one counts, from the left
            pos = np.flatnonzero(hit)
            if not len(pos):
                break
            run = np.cumsum(np.r_[True, np.diff(pos) > 1])
            first = np.r_[True, np.diff(run) > 0]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - begin) % 2 == 0]
            flat[pos] = self.made[at[pos]]
            stay = np.ones(len(flat), bool)
            stay[pos + 1] = False
            gone = np.bincount(owner[pos + 1], minlength=len(live))
            flat, n = flat[stay], n - gone
            out[live] = n
            more = (gone > 0) & (n > 1)  # a sequence without a merge in this round is done
            if not more.all():
                starts = np.cumsum(n) - n
                flat = flat[ragged(starts[more], n[more])]
                live, n = live[more], n[more]
        return out


class WordCounter:
    """Tokens of whole texts by a lower-casing word vocabulary, with a cache of words that is bounded in words and characters.

    Words with characters that Python's Unicode tables do not know are left to the library, whose tables are newer.
    """

    CACHE, CHARS = 800_000, 32 << 20

    def __init__(self, path: str):
        import regex

        self.path, self.library = path, None
        spec = json.load(open(path, encoding="utf-8"))
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] is None:
            raise ValueError(f"{path}: only vocabularies of lower-cased words with word ends are counted here")
        self.merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]))
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.chars = 0

    def _unknown(self, word: str) -> bool:
        return not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word)

    def _by_library(self, words: list[str]) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation(), self.library.no_padding()
        return [len(x.ids) for x in self.library.encode_batch(words, add_special_tokens=False)]

    def _pretokens(self, word: str) -> list[str]:
        """Lower-casing goes character by character, without a final sigma."""
        return self.pieces.findall("".join(c.lower() for c in unicodedata.normalize("NFC", word)))

    def _full(self) -> bool:
        return len(self.words) > self.CACHE or self.chars > self.CHARS

    def learn(self, words: set[str]) -> None:
        if self._full():
            self.words.clear(), self.parts.clear()
            self.chars = 0
        odd = [w for w in words if self._unknown(w)]
        self.words.update(zip(odd, self._by_library(odd) if odd else [], strict=True))
        split = {}
        for w in words:
            self.chars += len(w)
            if w not in self.words:
                specials = len(self.special.findall(w))
                split[w] = specials, [p for s in (self.special.split(w) if specials else [w]) for p in self._pretokens(s)]
        new = sorted({p for _, parts in split.values() for p in parts if p not in self.parts})
        self.chars += sum(map(len, new))
        for i in range(0, len(new), 50_000):
            self.parts.update(zip(new[i : i + 50_000], self.merger.counts(new[i : i + 50_000]).tolist(), strict=True))
        for w, (specials, parts) in split.items():
            self.words[w] = specials + sum(self.parts[p] for p in parts)

    def count(self, texts: list[str]) -> list[int]:
        """Special tokens' strings inside a text count as one token each."""
        split = [[w for w in (SPACE.split(t) if ODD_SPACE.search(t) else t.split()) if w] for t in texts]
        words = set().union(*split)
        if new := {w for w in words if w not in self.words}:
            self.learn(words if self._full() else new)
        return [sum(map(self.words.__getitem__, s)) for s in split]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, n_bytes, n_tokens, over_limit). One scan, no shuffle.

    Null text counts as empty: no bytes, no tokens. Null ids stay null; repeated rows each get their row; further
    columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)

    def run(batches):
        counter = held(("words", vocabulary), lambda: WordCounter(vocabulary))
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            n = counter.count(texts)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
