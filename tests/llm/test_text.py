import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallywire.llm import pii
from tallywire.llm.decontaminate import WalkIndex, _length_class, align, contaminated, words_of
from tallywire.llm.packing import Packer, pack
from tallywire.llm.token_counts import RankMerger, WordCounter, token_counts

ODD = ["", " ", "\n", " a", "a ", "a\n", "\na", "a\n b", "a \nb", "a  b", "a\tb c", "x<|endoftext|>y z", "don't we'll I'M", "a\x00b c", "a\x1cb d", "日本語 12345 6", "ΑΣ ΣΑΣ Σ", "İstanbul é ́x", "🙂🙂 --!!??##$$", "a" * 3000, "aaaa " * 300, "a　b\x85c", "'s't"]


def library(name, texts):
    return Tokenizer.from_file(P.path(name)).encode_batch(texts, add_special_tokens=False)


def test_token_counts(make_docs, prose):
    rows = [(i, t) for i, t in prose] + [(1000 + k, t) for k, t in enumerate(ODD)]
    want = [len(x) for x in library("word_bpe_49k.json", [t or "" for _, t in rows])]
    got = token_counts(make_docs(rows), P.path("word_bpe_49k.json"), limit=100).collect()
    assert sorted(((i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, want, strict=True)), key=str) == sorted((tuple(r) for r in got), key=str)
    assert token_counts(make_docs([]), P.path("word_bpe_49k.json")).count() == 0


def test_merger_on_runs_of_one_pair():
    m = RankMerger({"a": 0, "aa": 1, "aaaa": 2}, ["a a", "aa aa"])
    m.chars = {ord("a"): "a"}
    assert m.counts(["a" * k for k in range(1, 9)]).tolist() == [1, 1, 2, 1, 2, 2, 3, 2]


def test_very_long_words():
    r = random.Random(2)
    texts = ["".join(r.choice("etaoinshrdlu") for _ in range(60_000)), "ab" * 30_000, "x" * 50_000, "日本語のテキスト" * 3000, "https://" + "a1b2" * 900]
    began = time.time()
    assert WordCounter(P.path("word_bpe_49k.json")).count(texts) == [len(x) for x in library("word_bpe_49k.json", texts)]
    assert time.time() - began < 60
    m = WordCounter(P.path("word_bpe_49k.json")).merger
    words = ["".join(r.choice("aeinstr") for _ in range(r.randint(1, 90))) for _ in range(300)]
    assert [m._lazily(m.symbols(w)) for w in words] == m.counts(words).tolist()


def test_characters_newer_than_pythons_tables():
    texts = ["x\ua7cbY", "\ua7cc \ua7da \ua7dc", "\U00010d50\U00010d51", "\u0378a B"]
    assert WordCounter(P.path("word_bpe_49k.json")).count(texts) == [len(x) for x in library("word_bpe_49k.json", texts)]


def test_counter_forgets_and_learns_again():
    c = WordCounter(P.path("word_bpe_49k.json"))
    first = c.count(["some words here", "other words there"])
    for c.CACHE, c.CHARS in ((0, 10**9), (10**9, 0)):
        assert c.count(["some words here", "other words there"]) == first


@pytest.mark.parametrize("cut", [True, False])
def test_packing_is_a_round_trip(make_docs, prose, cut):
    rows = [(i, t) for i, t in prose if i is not None] + [(1000 + k, t) for k, t in enumerate(ODD)]
    rows = list(dict(rows).items())
    ids = {i: [*x.ids, 1] for (i, _), x in zip(rows, library("byte_bpe_50k.json", [t or "" for _, t in rows]), strict=True)}
    got = pack(make_docs(rows), P.path("byte_bpe_50k.json"), with_ids=True, cut=cut, max_segments=8).collect()
    parts, bins = {}, {}
    for r in got:
        x = np.frombuffer(r.ids, "<u4")
        assert len(x) == r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        parts.setdefault(r.doc_id, []).append((r.start, x.tolist()))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, want in ids.items():
        assert [y for s, x in sorted(parts[i]) for y in x] == want
        at = 0
        for s, x in sorted(parts[i]):
            assert s == at
            at += len(x)
    padding = 0
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048 and len(b) <= 8
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0 or not cut
    assert pack(make_docs([]), P.path("byte_bpe_50k.json")).count() == 0


def test_packer_keeps_all_limits():
    r = np.random.default_rng(0)
    length = r.integers(1, 900, 400)
    loss = (length * r.random(400)).astype(int)
    for cut in (True, False):
        bins = Packer(1024, 5, 500, cut).pack(length, np.minimum(loss, 500))
        done = np.zeros(400, int)
        for b in bins:
            assert sum(n for *_, n in b) <= 1024 and len(b) <= 5
            assert sum(-(-min(loss[i], 500) * n // length[i]) for i, _, n in b) <= 500
            for i, _, n in b:
                done[i] += n
        assert (done == length).all()


def test_the_dot_product_decides():
    """Each choice has the largest weighted dot product of needs and room among the items that fit; neither the tightest nor the first that fits would do."""
    r = np.random.default_rng(3)
    tight = first = 0
    for _ in range(20):
        length = r.integers(1, 700, 60)
        loss = np.minimum((length * r.random(60) ** 2).astype(int), 300)
        p = Packer(1000, 6, 300)
        need = np.c_[length, np.ones(60), loss] / p.cap
        weight = need.sum(0) / need.sum()
        left = set(range(60))
        for own in p.place(length, loss):
            room = np.ones(3)
            for i in own:
                fits = [k for k in sorted(left) if (need[k] <= room + 1e-12).all()]
                best = max(need[k] @ (room * weight) for k in fits)
                assert need[i] @ (room * weight) == pytest.approx(best)
                tight += i != min(fits, key=lambda k: ((room - need[k]) * weight).sum())
                first += i != max(fits, key=lambda k: length[k])
                left.remove(i)
                room = room - need[i]
            assert not any((need[k] <= room).all() for k in left)
        assert not left
    assert tight > 50 and first > 50


def test_loss_limit_cuts_long_answers(spark):
    d = spark.createDataFrame([(1, "word " * 900, 1.0), (2, "word " * 50, 0.1), (3, None, None)], "doc_id bigint, text string, share double")
    got = pack(d, P.path("byte_bpe_50k.json"), loss_col="share", max_tokens=512, max_loss=256).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(x.loss_tokens for x in b) <= 256 and sum(x.length for x in b) <= 512 for b in by.values())
    assert sum(r.length for r in got if r.doc_id == 1) == got[0].doc_tokens or len(got) > 3


KIND_PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_brute(t):
    out = []
    for k, p in enumerate(KIND_PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = True if k == 0 else all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 14 <= len(d) <= 19 and pii.luhn(d) if k == 2 else 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    r = random.Random(4)
    fixed = ["a@b.c@d.e", "@a.b", "a@@b.co", "x@y-.-z a@b c@d.e.f.", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "4111 1111 1111 1111-", "+1 (212) 555-0100.", "++49 30 1234567 8", "%@-.-", "00001.2.3.4", "é 4111111111111111 é@b.c"]
    made = ["".join(r.choice("a1.@+- ()9\n") for _ in range(r.randint(1, 60))) for _ in range(4000)]
    for t in fixed + made:
        assert pii.base_spans(t) == base_brute(t), t


def test_model_adds_spans_and_leaves_prose_alone(make_docs, prose):
    model = pii.train()
    held = pii.examples(200, 1234)
    want = {(i, s) for i, (_, spans) in enumerate(held) for s in spans}
    got = {(i, s) for i, (t, _) in enumerate(held) for s in pii.find_spans(t, model)[1]}
    assert len(want & got) > 0.85 * len(want) and len(got - want) < 0.1 * len(got)
    text = "call (212) 555-0143 or write to jane at lomax dot com, host 10.0.0.1, order 12345678"
    base, spans = pii.find_spans(text, model)
    assert set(base) <= set(spans) and {k for _, k, _ in spans} == {0, 1, 3}
    rows = [*prose, (999, text)]
    got = pii.personal_data(make_docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (len(r.spans) > 0) == (r.doc_id == 999)
    assert pii.personal_data(make_docs([])).count() == 0


#: Sentences written by hand, not by the generator: (text, kind and text of each entity).
WRITTEN = [
    ("Reach me at john dot smith at gmail dot com after lunch.", [(0, "john dot smith at gmail dot com")]), ("you can mail anna at firma dot de", [(0, "anna at firma dot de")]), ("my address is p.jones (at) school (dot) edu, thanks", [(0, "p.jones (at) school (dot) edu")]),
    ("support [at] example.org is read daily", [(0, "support [at] example.org")]), ("Call (415) 555-0132 before noon", [(3, "(415) 555-0132")]), ("phone 212-555-0187 or leave a note", [(3, "212-555-0187")]), ("mobile: 0171 555 2368", [(3, "0171 555 2368")]),
    ("tel. 020 555 0199 (office)", [(3, "020 555 0199")]), ("the server 192[.]168[.]0[.]17 was down", [(1, "192[.]168[.]0[.]17")]), ("card 4111.1111.1111.1111 expires soon", [(2, "4111.1111.1111.1111")]), ("we met at noon, the dot at the end was missing", []),
    ("Order 20240117 was shipped on 2024-01-17.", []), ("isbn 978-3-16-148410-0", []), ("He lived from 1879 - 1955 in four towns", []), ("the total was 1,234,567.89 in 2019", []), ("look at page 12 dot three of the manual", []), ("version 10.4.2023 of the tool", []), ("room 1204, floor 12, from 10:30 - 11:45", []),
]


def test_entities_in_sentences_written_by_hand():
    model = pii.train()
    right = made = wanted = 0
    for text, entities in WRITTEN:
        got = {(k, text[s:e]) for s, k, e in pii.find_spans(text, model)[1]}
        right, made, wanted = right + len(got & set(entities)), made + len(got), wanted + len(entities)
    assert right >= 0.8 * wanted and right >= 0.8 * made


def test_the_model_reads_every_place():
    model = pii.train()
    alone = {
        "call 555/123/4567 at once": (3, "555/123/4567"), "phone 555_123_4567 please": (3, "555_123_4567"), "call 5551234567 today": (3, "5551234567"), "write to joe at gmail.com please": (0, "joe at gmail.com"),
        "the host 8[.]8[.]8[.]8 is up": (1, "8[.]8[.]8[.]8"), "card 4111_1111_1111_1111 here": (2, "4111_1111_1111_1111"),
    }
    for text, want in alone.items():
        assert [(k, text[s:e]) for s, k, e in pii.model_spans(text, model)] == [want]
    r = random.Random(9)
    for _ in range(20):
        gaps = [" ".join(r.choice(["so", "at", "dot", "red", "two 12", "1999", "a\nb", ".", "@", "x (y)"]) for _ in range(r.randint(0, 60))) for _ in range(8)]
        text = " ".join(x for pair in zip(gaps, r.choices(list(alone), k=8), strict=True) for x in pair)
        whole = model.decode(pii._TOKEN.findall(text))
        assert pii.model_spans(text, model) == whole == model.decode(pii._TOKEN.findall(text), 0, 7)
    assert pii.model_spans("", model) == [] and pii.model_spans("call 12\u00b23\u00b24 and 1111222233334\u00b2", model) == []


def test_decode_is_the_best_of_all_segmentations():
    r = np.random.default_rng(5)
    for text in ("a at b.c 12 3-45", "(12) 34 @ x 5", "card 1 22 003, 4444 at"):
        m = pii.SemiMarkov(r.normal(size=(4, len(pii.FEATURES))), r.normal(size=(5, 5)))
        w = pii.Window(text)
        sc, n = w.x @ m.w.T, len(w.tokens)

        def best(i, y):
            if i == n:
                return 0.0, []
            v, path = best(i + 1, 0)
            out = (m.t[y, 0] + v, path)
            for q in np.flatnonzero(w.start == i).tolist():
                for k in range(1, 5):
                    v, path = best(int(w.end[q]), k)
                    out = max(out, (m.t[y, k] + sc[q, k - 1] + v, [(w.tokens[i][0], k - 1, w.tokens[int(w.end[q]) - 1][1]), *path]))
            return out

        assert m.decode(pii._TOKEN.findall(text)) == best(0, 0)[1]


def test_semi_markov_gradient():
    text, spans = "mail ba at ne dot com now (212) 555-0143 x", [(5, 0, 21), (26, 3, 40)]
    w = pii.Window(text)
    gold = pii.gold_segments(w, spans)
    r = np.random.default_rng(0)
    m = pii.SemiMarkov(r.normal(size=(4, len(pii.FEATURES))) / 5, r.normal(size=(5, 5)) / 5)
    value, gw, gt = m.gradient(w, gold)
    assert value < 0
    for mat, g, at in ((m.w, gw, (0, pii._F["at_word"])), (m.w, gw, (3, pii._F["paren"])), (m.t, gt, (0, 4)), (m.t, gt, (1, 0))):
        mat[at] += 1e-5
        up = m.gradient(w, gold)[0]
        mat[at] -= 2e-5
        down = m.gradient(w, gold)[0]
        mat[at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g[at], abs=1e-4)


def test_align_is_the_edit_distance_to_a_stretch():
    r = random.Random(6)

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(text, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(300):
        item, text = ([r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(2))
        edits, start, n = align(np.array(item, np.uint64), np.array(text, np.uint64))
        assert edits == least(item, text) == full(item, text[start : start + n])


@pytest.fixture(scope="module")
def bench(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    items = {i: " ".join(r.choice(vocabulary) for _ in range(r.randint(15, 60))) for i in range(30)} | {50: "three short words", 51: "", 52: None}
    rows, want = [], set()
    for i in range(120):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 200))]
        if i % 3 == 0:
            k = r.randrange(30)
            item = items[k].split()
            for _ in range(0 if i % 6 == 0 else max(1, int(0.1 * len(item)))):
                at = r.randrange(len(item))
                item[at : at + 1] = r.choice([[], ["zz"], [item[at], "qq"]])
            p = r.randint(0, len(w))
            w[p:p] = item
            want.add((i, k, i % 6 == 0))
        rows.append((i, " ".join(w)))
    rows += [(500, "said Three, SHORT words!"), (501, None), (502, ""), (None, items[3]), (503, items[4]), (503, items[4])]
    want |= {(500, 50, True), (None, 3, True), (503, 4, True)}
    return spark.createDataFrame(list(items.items()), "item_id bigint, text string"), rows, want


def test_contaminated(make_docs, bench):
    items, rows, want = bench
    got = contaminated(make_docs(rows), items, block_bytes=2000).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert {(d, k) for d, k, whole in want if whole} <= pairs
    edited = {(d, k) for d, k, whole in want if not whole}
    assert len(edited & pairs) >= 0.9 * len(edited) and pairs <= {(d, k) for d, k, _ in want}
    assert all(r.edits == 0 for r in got if (r.doc_id, r.item_id, True) in want) and sum(r.doc_id == 503 for r in got) == 2
    assert contaminated(make_docs([]), items).count() == 0 and contaminated(make_docs(rows), items.limit(0)).count() == 0


def test_hits_equal_brute_force(bench):
    items, rows, _ = bench
    known = [(r.item_id, r.text.encode()) for r in items.collect() if r.text]
    index = WalkIndex(known)
    texts = words_of([(t or "").encode() for _, t in rows])
    for w, near in zip(texts, index.candidates(texts), strict=True):
        for k, start, n, edits in index.hits(w, near):
            item = index.words[index.ids.index(k)]
            assert align(item, w)[0] <= edits <= index.allowed(len(item)) and align(item, w[start : start + n])[0] == edits


def test_hashed_words():
    """Words by the definition, equal ones and no others with equal hashes, over stretches of any length."""
    r = random.Random(21)
    texts = ["".join(r.choice("abA1é -.\n") for _ in range(r.randint(0, 50))).encode() for _ in range(400)]
    texts += [b"", b" ", b"x" * 5000, b"y" * 70 + b" " + b"y" * 134, b"ab " * 500_000, b"q" * 1_200_000 + b" tail", (b"a" * 64 + b"b" * 64), (b"b" * 64 + b"a" * 64)]
    want = [re.findall(rb"[0-9a-z\x80-\xff]+", t.lower()) for t in texts]
    got = words_of(texts)
    assert [len(x) for x in got] == [len(x) for x in want]
    by = {}
    for h, w in zip(np.concatenate(got).tolist(), (w for x in want for w in x), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by) and words_of([]) == []


def edited(item, edits, r):
    """The words with so many of them replaced, dropped or doubled, each edit at a word of its own."""
    out = [[x] for x in item]
    for at in r.sample(range(len(item)), edits):
        out[at] = r.choice([["zz"], [], [item[at], "qq"]])
    return [x for part in out for x in part]


@pytest.mark.parametrize("n", [1, 3, 5, 6, 8, 9, 10, 12, 14, 15, 17, 20, 21, 25, 30, 45, 60, 120])
def test_recall_at_the_bound(n):
    """Items of other words than those the number of walks was found with, under a small vocabulary; no false hit, misses counted."""
    r = random.Random(n)
    vocabulary = 500 if n > 4 else 100_000
    say = lambda k: [f"w{r.randrange(vocabulary)}" for _ in range(k)]
    items = [say(n) for _ in range(300)]
    index = WalkIndex([(i, " ".join(w).encode()) for i, w in enumerate(items)])
    docs = words_of([" ".join(say(r.randint(0, 40)) + edited(w, index.allowed(n), r) + say(r.randint(0, 40))).encode() for w in items])
    found = brute = missed = 0
    for i, (w, near) in enumerate(zip(docs, index.candidates(docs), strict=True)):
        got = {k: e for k, _, _, e in index.hits(w, near)}
        found += i in got
        if i < 10:
            want = {k: e for k, item in enumerate(index.words) if (e := align(item, w)[0]) <= index.allowed(n)}
            assert set(got.items()) <= set(want.items())
            brute, missed = brute + len(want), missed + len(set(want) - set(got))
    assert found >= (0.95 if n > 4 else 1) * 300
    assert missed <= max(1, 0.05 * brute)


def test_unedited_items_are_always_found():
    r = random.Random(77)
    items = [[f"w{r.randrange(3000)}" for _ in range(n)] for n in range(1, 90) for _ in range(4)]
    index = WalkIndex([(i, " ".join(w).encode()) for i, w in enumerate(items)])
    docs = words_of([" ".join([f"v{k}" for k in range(r.randint(0, 30))] + w + ["end"] * r.randint(0, 9)).encode() for w in items])
    for i, (w, near) in enumerate(zip(docs, index.candidates(docs), strict=True)):
        assert i in {h[0] for h in index.hits(w, near)}, len(items[i])


def test_deeper_keys_for_more_items():
    r = random.Random(5)
    items = [[f"w{r.randrange(2000)}" for _ in range(r.choice([10, 33]))] for _ in range(1500)]
    index = WalkIndex([(i, " ".join(w).encode()) for i, w in enumerate(items)])
    assert index.depth == 4
    docs = words_of([" ".join(edited(w, index.allowed(len(w)), r)).encode() for w in items[:300]])
    got = [i in {h[0] for h in index.hits(w, near)} for i, (w, near) in enumerate(zip(docs, index.candidates(docs), strict=True))]
    assert sum(got) >= 0.95 * len(got)


def test_candidates_are_those_of_plain_walks():
    """Places found by shared walks, chunk by chunk, are those of each class's own walks read one step at a time."""
    r = random.Random(11)
    say = lambda k: [f"w{r.randrange(300)}" for _ in range(k)]
    items = [say(n) for n in (1, 2, 4, 5, 7, 9, 10, 13, 16, 21, 25, 40, 60, 75) for _ in range(3)]
    index = WalkIndex([(i, " ".join(w).encode()) for i, w in enumerate(items)], walks=dict.fromkeys((1, 2, 4, 5, 7, 9, 10, 15, 22, 33, 49, 73), 2))
    docs = words_of([b"", b"w1", *(" ".join(say(r.randint(0, 40)) + edited(w, index.allowed(len(w)), r) + say(r.randint(0, 9))).encode() for w in items)])
    want = [set() for _ in docs]
    for c in index.classes:
        for walk in range(len(c.picks)):
            mine: dict[tuple[int, int], set] = {}
            for k, w in enumerate(index.words):
                if _length_class(len(w)) == c.least:
                    read = index._read(np.r_[w, np.zeros(c.steps + 2, np.uint64)], np.arange(c.stride), walk, c.steps)
                    for m, (key, complete) in enumerate(index._keys(c, walk, read)):
                        for at in np.flatnonzero(complete).tolist():
                            mine.setdefault((m, int(key[at])), set()).add((k, at))
            flat = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.uint64))] + [np.zeros(c.steps + 2, np.uint64)])
            head = np.cumsum([0] + [len(d) + 1 for d in docs])
            starts = np.arange(0, int(head[-1]), c.stride)
            for m, (key, _) in enumerate(index._keys(c, walk, index._read(flat, starts, walk, c.steps))):
                for p, x in zip(starts.tolist(), key.tolist(), strict=True):
                    for k, at in mine.get((m, x), ()):
                        d = int(np.searchsorted(head, p, side="right")) - 1
                        want[d].add((k, p - int(head[d]) - at))
    assert sum(map(len, want)) > 100
    assert index.candidates(docs) == want and index.candidates(docs, 64) == want


def test_candidates_cost_less_than_plain_walks():
    """Looking all places up takes less CPU time than the walks of the class alone, read one step at a time."""
    r = np.random.default_rng(5)
    items = [(i, " ".join(f"w{x}" for x in r.integers(0, 4000, 60)).encode()) for i in range(200)]
    index = WalkIndex(items, walks={49: 8})
    docs = [r.integers(1, 1 << 62, 400).astype(np.uint64) for _ in range(250)]
    flat, (c,) = np.concatenate(docs), index.classes

    def plain():
        for walk in range(len(c.picks)):
            index._read(flat, np.arange(0, len(flat), c.stride), walk, c.steps)

    def seconds(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    both = [(seconds(lambda: index.candidates(docs)), seconds(plain)) for _ in range(7)]
    assert min(a for a, _ in both) < 0.85 * min(b for _, b in both)
