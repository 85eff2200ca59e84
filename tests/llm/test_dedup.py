import hashlib
import random
import re
import string
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import tallywire.llm.exact_dedup as exact
from tallywire.llm import minhash, suffix_dedup
from tallywire.llm.components import components
from tallywire.llm.exact_dedup import CuckooIndex, exact_dedup
from tallywire.llm.minhash import SetSketch, near_duplicates, shingle_sets
from tallywire.llm.suffix_dedup import BlindTrie, Fields, Quicksort, deep_shallow, remove_repeats, runs_of

BLANK = re.compile(r"[\x20\x09-\x0D]")
ORDER = lambda i: -(2**63) if i is None else i


def test_cuckoo_index_inserts_deletes_and_grows():
    r = random.Random(1)
    index, held = CuckooIndex(buckets=2), {}
    for k in range(3000):
        key = hashlib.sha256(bytes([r.randrange(200)])).digest()
        if r.random() < 0.4:
            assert index.delete(key) == (held.pop(key, None) is not None)
        else:
            index.insert(key, k)
            held[key] = k
        assert index.get(key) == held.get(key)
    assert dict(index.items()) == held and index.resized > 0 and len(index) == len(held)
    assert all(index.may_hold(k) for k in held)


def test_cuckoo_buckets_are_all_there_is():
    """An entry is found in its two buckets only, a shared fingerprint is told apart by the content, and deletion frees the slot."""
    index = CuckooIndex(buckets=64)
    keys = [bytes([7, 7]) + k.to_bytes(8, "big") + bytes(22) for k in range(6)]  # one fingerprint
    for k, key in enumerate(keys):
        index.insert(key, k)
    assert [index.get(k) for k in keys] == list(range(6))
    other = bytes([7, 7]) + (1).to_bytes(8, "big") + b"x" * 22
    assert index.may_hold(other) and index.get(other) is None and not index.delete(other)
    _, i, j = index._places(keys[3])
    kept = [list(index.content[b]) for b in (i, j)]
    index.content[i], index.content[j] = [None] * 4, [None] * 4
    index.marks[i], index.marks[j] = bytearray(8), bytearray(8)
    assert index.get(keys[3]) is None
    index.content[i], index.content[j] = kept
    assert index.get(keys[3]) is None  # the content alone, without the filter's fingerprint, is not found either
    small = CuckooIndex(buckets=1)
    for k in range(4):
        small.insert(hashlib.sha256(bytes([k])).digest(), k)
    assert small.delete(hashlib.sha256(bytes([2])).digest())
    small.insert(hashlib.sha256(b"new").digest(), 9)
    assert small.resized == 0 and len(small) == 4


def exact_brute(rows):
    """(id, kept id, size of the group) of each row, and the ids of the kept rows."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), ORDER(i), i))
    keep = {t: min(g)[2] for t, g in groups.items()}
    return sorted(((i, keep[b := BLANK.sub("", t or "")], len(groups[b])) for i, t in rows), key=str), sorted(keep.values(), key=ORDER)


@pytest.mark.parametrize("held", [400_000, 7])
def test_exact_dedup(make_docs, prose, held, monkeypatch):
    monkeypatch.setattr(exact, "HELD", held)
    rows = [*prose, (None, "null twin"), (None, "null  twin"), (None, "other"), (8, "only here"), (8, "twin"), (7, "tw in"), (510, "rep"), (510, "rep")]
    got = exact_dedup(make_docs(rows)).collect()
    want, kept = exact_brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert sorted((r.doc_id for r in got if r.kept), key=ORDER) == kept
    assert all(r.digest == hashlib.sha256(b"rep").digest() for r in got if r.doc_id == 510)
    assert exact_dedup(make_docs([])).count() == 0


def near_brute(rows, percent):
    """(id, size of the set, component, kept) of each row; a row is a document of its own."""
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i, key=ORDER)
    return [(i, len(sets[k]), least[find(k)], find(k)) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("percent", "block", "ids"), [(85, 2000, 1 << 21), (80, 3, 2)])
def test_near_duplicates(make_docs, prose, percent, block, ids, monkeypatch):
    monkeypatch.setattr(minhash, "IDS", ids)
    want = near_brute(prose, percent)
    got = near_duplicates(make_docs(prose), percent=percent, block=block).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted((w[:3] for w in want), key=str)
    kept = sorted((r.doc_id for r in got if r.kept), key=ORDER)
    assert kept == sorted(({k: i for _, _, i, k in want}).values(), key=ORDER)
    assert len(kept) <= len(prose) - 10


def test_rows_that_share_an_id_are_documents_of_their_own(make_docs):
    r = random.Random(12)
    say = lambda: " ".join(r.choice("abcdefghij") + str(r.randrange(90)) for _ in range(60))
    b, c, d = say(), say(), say()
    rows = [(None, b), (None, c), (3, b + " more"), (4, c + " words"), (5, d), (5, say()), (6, d + " x"), (7, d), (7, d)]
    got = near_duplicates(make_docs(rows), percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(3, None), (4, None), (5, 5), (5, 5), (6, 5), (7, 5), (7, 5)]
    assert sorted((r.doc_id for r in got if r.kept), key=ORDER) == [None, None, 5, 5]


def test_likely_but_unlinked_neighbours_lose_no_link(make_docs):
    """Chains whose neighbours are linked but whose ends are not, under buckets that hold all of them; and likely pairs below the bound."""
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for family in range(6):
        w = [word() for _ in range(200)]
        for k in range(12):
            rows.append((100 * family + k, " ".join(w)))
            for _ in range(1 + family % 3 * 2):  # 1, 3 or 5 changed words: similarities about 0.95, 0.86, 0.78
                w[r.randrange(len(w))] = word()
    r.shuffle(rows)
    for percent in (80, 90):
        want = near_brute(rows, percent)
        got = near_duplicates(make_docs(rows), percent=percent, block=5).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, c) for i, _, c, _ in want)


def test_near_duplicates_of_nothing(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    assert [r.component_id for r in near_duplicates(make_docs([(5, None), (6, "")])).orderBy("doc_id").collect()] == [5, 6]


def test_sketch_estimates_and_merges():
    r = np.random.default_rng(5)
    a = np.unique(r.integers(0, 2**63, 1200).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1000], r.integers(0, 2**63, 100).astype(np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = SetSketch(1024)
    x = s.registers([a, b, np.union1d(a, b), a[:0]])
    assert abs(s.joint(x[:1], np.array([len(a)]), x[1:2], np.array([len(b)]))[0] - true) < 0.05
    assert (s.merge(x[0], x[1]) == x[2]).all() and not x[3].any()


def test_shingles_by_definition():
    a, b, c = shingle_sets([b"A b c d e f", b"a B c d e", b"a b"])
    assert len(a) == 2 and len(b) == 1 and len(c) == 1 and b[0] in a and c[0] not in a


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 90, 90: 90}


def repeats_brute(rows, width):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: ORDER(r[0])):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                mask[k : k + width] = b"\1" * width
            else:
                seen.add(w)
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(1 for k in range(len(mask)) if mask[k] and not (k and mask[k - 1]))
        out[i] = (len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_remove_repeats(make_docs, prose, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [r for r in prose if r != (None, None)]
    want = repeats_brute(rows, 100)
    got = remove_repeats(make_docs(rows), with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    assert sum(x[1] for x in want.values()) > 2000


@pytest.mark.parametrize("width", [16, 142, 143, 200, 300, 700])
def test_remove_repeats_at_any_width(make_docs, prose, width):
    r = random.Random(width)
    passage = "".join(r.choice("abcdefgh ") for _ in range(width + 250))
    rows = [x for x in prose if x != (None, None)] + [(900 + k, f"{k} " * k + passage[k:] + " end") for k in range(5)]
    want = repeats_brute(rows, width)
    for x in remove_repeats(make_docs(rows), width=width).collect():
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id], x.doc_id
    assert want[904][1] >= width


def test_widths_that_cannot_be_held():
    for width in (15, 1 << 14):
        with pytest.raises(ValueError, match="width"):
            Fields.of(width)


def test_texts_whose_keys_are_equal(make_docs, prose, monkeypatch):
    """Keys that texts share are replaced until none is shared."""
    monkeypatch.setattr(suffix_dedup, "text_key", lambda text, salt=0: F.xxhash64(text, F.lit(salt)) if salt > 1 else F.pmod(F.length(text), F.lit(7 + salt)).cast("long"))
    rows = [r for r in prose if r[0] is not None and r[0] < 210]
    want = repeats_brute(rows, 100)
    for r in remove_repeats(make_docs(rows)).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize("width", [100, 1000, 16383])
def test_periodic_text_is_few_rows(width):
    texts = [b"For " * 8000, b"x" * 20000, bytes(range(256)) * 3, b"short", b""]
    fields = Fields.of(width)
    runs = runs_of(texts, width)
    text, number, _ = fields.pack(*runs)
    assert number.max() < 1 << 62
    if width == 100:
        assert len(runs[0]) > 20000 and (text == 0).sum() + (text == 1).sum() < 20
    again = [(t, s + k * n, n, d) for t, x in zip(text.tolist(), number.tolist(), strict=True) for r, s, n, d in [fields.unpack(x)] for k in range(r)]
    assert again == list(zip(*(x.tolist() for x in runs[:4]), strict=True))


def test_remove_repeats_of_nothing(make_docs):
    assert remove_repeats(make_docs([])).count() == 0
    assert [tuple(r)[1:4] for r in remove_repeats(make_docs([(1, None)])).collect()] == [(0, 0, 0)]


def test_deep_shallow_is_an_order():
    r = random.Random(2)
    s = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))).encode() for _ in range(400)]
    s += [b"x" * 30 + t for t in s[:200]] + s[:50]
    group = np.array([k % 3 for k in range(len(s))])
    order, lcp = deep_shallow(s, group)
    assert [(group[i], s[i]) for i in order] == sorted(zip(group.tolist(), s, strict=True))
    for k in range(1, len(s)):
        a, b = s[order[k - 1]], s[order[k]]
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (same if group[order[k]] == group[order[k - 1]] else -1)


def test_multikey_quicksort():
    """Segments are split in three by word until they differ or share `shallow` bytes: equal words are passed over once, not compared again."""
    r = random.Random(8)
    for n in (0, 1, 2, 3000):
        s = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for _ in range(n)]
        group = np.array([r.randrange(5) for _ in s], np.int64)
        q = Quicksort(s, 24)
        order, heads = q.order(group)
        key = [(group[i], s[i][:24].ljust(24, b"\0")) for i in order]
        assert key == sorted(key) and sorted(order.tolist()) == list(range(n))
        assert heads.tolist() == [k for k in range(n) if k == 0 or key[k] != key[k - 1]]
    same = Quicksort([b"x" * 23 + bytes([k]) for k in range(64)] * 4, 24)
    same.order(np.zeros(256, np.int64))
    assert same.rounds <= 2 + 4 * 6  # two rounds for the shared words, then halvings


def test_blind_trie():
    s = [b"abc", b"ab", b"abd", b"", b"abc", b"b", b"abcde"]
    t = BlindTrie(s)
    for i in range(len(s)):
        t.insert(i)
    assert [s[i] for i in t.order()] == sorted(s)
