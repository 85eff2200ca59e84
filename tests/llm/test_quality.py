import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywire.llm import quality
from tallywire.llm.quality import ORDER, SYMBOLS, GramCounts, Prices, Symbols, gram_scores, kneser_ney, perplexity_verdicts

UNITS = re.compile(r"[^\W\d_]{1,16} ?|\d{1,16}|(?:(?! )\s){0,15}(?: |(?! )\s)|(?:[^\w\s]|_){1,16}")


def symbols_of(text):
    """The n-gram of each symbol of a text, by the definition."""
    if not text:
        return []
    out, word, run, at = [], None, "", 0
    text = f" {text} ".replace("\0", "\ufffd")
    units, at = [], 1
    while at < len(text):
        m = UNITS.match(text, at)
        units.append((text[at - 1], m[0], at))
        at = m.end()
    for left, u, at in units:
        if u[0].isalpha() and not left.isalpha():
            run = re.compile(r"[^\W\d_]+").match(text, at)[0]
            u = ("\x03" if run == word else "") + u
            word = run
        u = left + u
        out += [u[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(u))]
    return out


def kn_brute(texts):
    """log p of an n-gram's last symbol by the textbook."""
    raw = Counter(g for t in texts for g in symbols_of(t))
    of = {ORDER: Counter({g: c for g, c in raw.items() if len(g) == ORDER})}
    for k in range(ORDER - 1, 0, -1):
        of[k] = Counter(g[1:] for g in of[k + 1]) + Counter({g: c for g, c in raw.items() if len(g) == k})
    disc = {}
    for k, c in of.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        raw_d = (1 - 2 * y * n[2] / max(n[1], 1), 2 - 3 * y * n[3] / max(n[2], 1), 3 - 4 * y * n[4] / max(n[3], 1))
        disc[k] = [0, *(min(max(v, 0.1), i) for i, v in zip((0.95, 1.9, 2.9), raw_d, strict=True))]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / SYMBOLS
        seen = [v for h, v in of[k].items() if h[:-1] == g[:-1]]
        if not seen:
            return p(g[1:])
        c = of[k].get(g, 0)
        own = c - disc[k][min(c, 3)] if c else 0
        return own / sum(seen) + sum(disc[k][min(v, 3)] for v in seen) / sum(seen) * p(g[1:])

    memo = {}
    return (lambda g: memo[g] if g in memo else memo.setdefault(g, math.log(p(g)))), p, {g[-1] for g in of[1]}


TEXTS = ["the cat sat on the mat.", "the dog sat, the cat ran!", "A cat\nand a dog dog dog", "12 cats é", "кот и пёс", "猫和狗" * 9]


def odd_texts():
    r = random.Random(1)
    return [*TEXTS, "", " ", "  ", "a" * 100, "x " * 40, "a\n b", "\n\n\n a", "1" * 40, "a\0b", "go.go go, go 1 go", "ab" * 20 + " " + "ab" * 20] + ["".join(r.choice("ab1 .\n_é猫\t#") for _ in range(r.randint(1, 60))) for _ in range(300)]


def test_symbols_are_those_of_the_definition():
    texts = odd_texts()
    s = Symbols(texts)
    got = [[] for _ in texts]
    for i, g in zip(s.owner.tolist(), s.grams(np.arange(len(s.at))).tolist(), strict=True):
        got[i].append(g)
    assert got == [symbols_of(t) for t in texts]
    by = {}
    for h, g in zip(s.hash.tolist(), s.grams(np.arange(len(s.at))).tolist(), strict=True):
        assert by.setdefault(h, g) == g
    assert len(set(by.values())) == len(by)


def test_counts_and_prices():
    texts = odd_texts()
    trains = np.array([i % 3 == 0 for i in range(len(texts))])
    counts = GramCounts()
    for k in range(0, len(texts), 50):
        counts.add(texts[k : k + 50], trains[k : k + 50])
    got = {r["gram"]: (r["n"], r["t"]) for b in counts.drain() for r in b.to_pylist()}
    n, t = Counter(g for x in texts for g in symbols_of(x)), Counter(g for x, k in zip(texts, trains, strict=True) if k for g in symbols_of(x))
    assert got == {g: (c, t[g]) for g, c in n.items()}
    known = {g: -float(len(g)) - 0.01 * k for k, g in enumerate(sorted(n)) if k % 4}
    prices = Prices(np.array(list(known)), np.array(list(known.values())))
    symbols, sums, left, times = prices.read(texts)
    for i, x in enumerate(texts):
        grams = symbols_of(x)
        assert symbols[i] == len(grams) and sums[i] == pytest.approx(sum(known.get(g, 0) for g in grams))
        assert dict(zip(left[i], times[i], strict=True)) == Counter(g for g in grams if g not in known)


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 40)
    texts = ["", "short", "the cat sat on the mat and then the dog ran " * 5, "x" * 130, " " * 90]
    parts = [[] for _ in texts]
    for part, owner in quality.in_pieces(texts):
        assert sum(map(len, part)) <= 40 and len(part) <= 100
        for t, i in zip(part, owner.tolist(), strict=True):
            parts[i].append(t)
    assert [" ".join(p) for p in parts[:3]] == texts[:3] and "".join(parts[3]) == texts[3] and len(" ".join(parts[4])) == 90
    symbols, sums, left, times = Prices(np.array(["the "]), np.array([-1.0])).read(texts)
    for i, p in enumerate(parts):
        grams = [g for t in p for g in symbols_of(t)]
        assert symbols[i] == len(grams) and sums[i] == -grams.count("the ") and sum(times[i]) == len(grams) - grams.count("the ")


def test_kneser_ney_is_the_textbook(spark):
    counts = Counter(g for t in TEXTS for g in symbols_of(t))
    model, unseen = kneser_ney(spark.createDataFrame(list(counts.items()), "gram string, t long"))
    want, p, symbols = kn_brute(TEXTS)
    asked = sorted({g for t in [*TEXTS, "the cat", "zebra!!", "dog\n", "THE 狗狗", "ß"] for g in symbols_of(t)})
    got = {r.gram: r.logp for r in gram_scores(spark.createDataFrame([(g,) for g in asked], "gram string"), model, unseen).collect()}
    assert set(got) == set(asked)
    for g in asked:
        assert got[g] == pytest.approx(want(g), rel=1e-9)
    for context in ("", "t", " th", "the ", "猫和", "q"):  # the seen symbols' shares and the unseen ones' make one
        mass = sum(p(context + s) for s in symbols)
        assert mass + p(context + "\U0001f6f8") * (SYMBOLS - len(symbols)) == pytest.approx(1)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(9)
    words = {"en": "the quiet river runs to a green hill".split(), "ru": "тихая река течёт мимо зелёного холма к морю".split(), "zh": "安静 的 河流 经过 绿色 山丘 流向 大海".split()}

    def say(lang):
        out = [r.choice(words[lang])]
        for _ in range(r.randint(2, 80)):  # no word comes twice running
            out.append(r.choice([w for w in words[lang] if w != out[-1]]))
        return (" " if lang != "zh" else "").join(out) + "."

    good = [(1000 * k + i, say(lang), lang) for k, lang in enumerate(words) for i in range(300)]
    return say, good, words


def build(spark, rows):
    return spark.createDataFrame([(i, t, lang, True, 3, "x") for i, t, lang in rows], "doc_id bigint, text string, lang string, kept boolean, row bigint, unit string")


def labelled(spark, good, more=()):
    return spark.createDataFrame([(i, 1, 0) for i, _, _ in good if i % 2 == 0] + [(None, 1, 0), *more], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(("common", "ids"), [(1 << 18, 1 << 21), (5, 5)])
def test_junk_of_every_script_is_told_from_prose(spark, corpus, common, ids, monkeypatch):
    """Whether n-grams and ids come by the broadcast or by the join makes no difference."""
    monkeypatch.setattr(quality, "COMMON", common)
    monkeypatch.setattr(quality, "IDS", ids)
    say, good, words = corpus
    r = random.Random(2)
    junk = [(9000 + i, " ".join(w.upper() + "###!!" for w in say("en").split()) + "##", "en") for i in range(20)]
    mixed = lambda lang: "".join(r.choice(sorted(set("".join(words[lang])))) for _ in range(200))
    junk += [(9100 + i, mixed(lang), lang) for i, lang in enumerate(["ru", "zh"] * 10)] + [(9200, "river " * 60, "en"), (9201, "реки " * 60, "ru")]
    toxic = [(9300 + i, say("en") + " you idiot scum of a moron and loser", "en") for i in range(5)]
    rest = [(2, None, "en"), (4, "", "en"), (None, "the river runs.", "en"), (None, None, None), good[1], (8000, "the river runs to a hill", None), (8001, "the river runs", "xx")]
    got = perplexity_verdicts(build(spark, good + junk + toxic + rest), labelled(spark, good, [(9000, 0, 0), (9001, 1, 1), (5, None, None)])).collect()
    assert len(got) == len(good + junk + toxic + rest)
    bad = {i for i, t, _ in junk + toxic if len(t) > 60}
    assert not [(x.doc_id, x.n_symbols, x.perplexity, x.threshold) for x in got if x.doc_id in bad and x.kept]
    assert sum(not x.kept for x in got if x.doc_id is not None and x.doc_id < 3000) <= 9
    assert all(x.kept for x in got if x.doc_id in (2, 4, None, 8000, 8001))
    by = {x.doc_id: x for x in got}
    want, *_ = kn_brute([t for i, t, _ in good if i % 2 == 0])
    total = lambda t: (sum(map(want, symbols_of(t))), len(symbols_of(t)))
    for i, t, lang in [good[1], good[301], good[601], junk[0], junk[25], junk[-1]]:
        sets = [total(x) for k, x, g in good if k % 2 == 0 and g == lang]
        mean = sum(x for x, _ in sets) / sum(n for _, n in sets)
        s, n = total(t)
        assert by[i].n_symbols == n and by[i].perplexity == pytest.approx(math.exp(-(s + 200 * mean) / (n + 200)), rel=1e-6)


def test_every_perplexity_comes_of_sharded_joins(spark, corpus, monkeypatch):
    """No table of n-grams goes to the driver or to all tasks, and without it each text's sum is whole, in one chunk or many."""

    def refuse(*_):
        raise AssertionError("n-grams are gathered or sent out")

    _, good, _ = corpus
    docs, labels = build(spark, good[::6] + [(7000, None, "en"), (7001, "the " * 400, "en")]), labelled(spark, good)
    got = []
    for common in (40, 1 << 18):
        monkeypatch.setattr(quality, "COMMON", common)
        with monkeypatch.context() as m:
            m.setattr(type(spark.sparkContext), "broadcast", refuse)
            m.setattr(type(docs), "toArrow", refuse)
            got.append(sorted((r.doc_id, r.n_symbols, round(r.perplexity, 9), r.kept) for r in perplexity_verdicts(docs, labels).collect()))
    assert got[0] == got[1] and len(got[0]) == 152


def test_thresholds_are_held_out(spark, corpus, monkeypatch):
    monkeypatch.setattr(quality, "SPLIT", 100)
    monkeypatch.setattr(quality, "ENOUGH", 20)
    say, good, _ = corpus
    docs = build(spark, [*good, (9000, "Q##x" * 50, "ru")])
    got = {x.doc_id: x for x in perplexity_verdicts(docs, labelled(spark, good), quantile=1.0, slack=0.0).collect()}
    held = {r.doc_id for r in docs.select("doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    for lang in ("en", "ru", "zh"):
        limit = max(got[i].perplexity for i, _, g in good if g == lang and i % 2 == 0 and i in held)
        assert all(got[i].threshold == pytest.approx(limit) for i, _, g in good if g == lang)
    assert not got[9000].kept


def test_without_model_or_rows(spark, corpus):
    _, good, _ = corpus
    docs = build(spark, good[:20])
    assert all(x.kept and x.perplexity is None for x in perplexity_verdicts(docs, labelled(spark, []).limit(0)).collect())
    assert perplexity_verdicts(docs.limit(0), labelled(spark, good)).count() == 0
    assert perplexity_verdicts(docs, labelled(spark, good), row_col="row").columns[0] == "row"
