import random
import re

import corpus_pipeline as C
import public_tokenizers as P
from tokenizers import Tokenizer

from tallywire.llm.common import stash, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    kept = {}
    for name, stage in C.STAGES:
        before = docs
        docs = stash(stage(spark, docs, DATA), f"test-{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == table(spark, DATA, "documents").columns
            assert docs.join(before, docs.columns, "left_anti").count() == 0
    text = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    ids = {n: [r.doc_id for r in kept[n].select("doc_id").collect()] for n in kept if n != "packing"}
    labels = {r.doc_id: r for r in table(spark, DATA, "labels").collect()}

    first = set(ids["quality"])
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    junk = [i for i, r in labels.items() if r.quality == 0]
    assert sum(i in first for i in clean) >= 0.99 * len(clean) and sum(i in first for i in junk) <= 0.4 * len(junk)

    groups = {}
    for i in ids["quality"]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text[i]), []).append((-len(text[i]), i))
    assert sorted(ids["exact"]) == sorted(min(g)[1] for g in groups.values())

    low = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i in ids["exact"] if (w := text[i].lower().split())}
    root = {i: i for i in ids["exact"]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in low:
        for b in low:
            if a < b and 100 * len(low[a] & low[b]) >= 80 * len(low[a] | low[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(ids["near"]) == sorted(i for i in root if find(i) == i)

    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    leaks = {i for i in ids["near"] if any(x in text[i] for x in items)}
    assert leaks and not leaks & set(ids["decontaminate"])
    assert len(ids["near"]) - len(ids["decontaminate"]) <= len(leaks) + 2

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(x.ids) + 1 for i, x in zip(ids["decontaminate"], t.encode_batch([text[i] for i in ids["decontaminate"]], add_special_tokens=False), strict=True)}
    got = {r.doc_id: r["sum(length)"] for r in kept["packing"].groupBy("doc_id").sum("length").collect()}
    assert got == want
    assert kept["packing"].groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_stages_decide_by_row(spark, tmp_path):
    """Rows without an id or with a repeated one, repeated rows, nulls in any column and further columns."""
    say = lambda k: " ".join(f"w{(k * 7 + j * j) % 997}" for j in range(60))
    texts = [(None, "unique one two three"), (None, "dup x"), (7, "dup   x"), (8, "only here"), (8, "twin"), (7, "tw in"), (10, "rep"), (10, "rep"), (None, None), (11, ""), (12, " ")]
    texts += [(None, say(1)), (None, say(2)), (3, say(1) + " more"), (4, say(2) + " words"), (20, "so " + ITEM + " and"), (20, "clean words here"), (None, ITEM), (None, None)]
    rows = [(i, t, "en" if t else None, "s", None, "x", 5) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, kept int")
    empty = docs.limit(0)
    spark.createDataFrame([(None, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "clean words here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    after = {}
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        after[name] = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert after["quality"] == sorted(texts, key=str)
    exact = list(texts)
    # the longest original stays, of equally long ones that of the smallest id
    for r in [(None, "dup x"), (8, "twin"), (10, "rep"), (None, None), (None, None), (11, "")]:
        exact.remove(r)
    assert after["exact"] == sorted(exact, key=str)
    near = list(texts)
    for r in [(3, say(1) + " more"), (4, say(2) + " words"), (7, "dup   x"), (10, "rep"), (20, "so " + ITEM + " and")]:
        near.remove(r)
    assert after["near"] == sorted(near, key=str)
    assert after["decontaminate"] == sorted((r for r in texts if ITEM not in (r[1] or "")), key=str)
    packed = C.packing(spark, docs, str(tmp_path))
    assert packed.filter("start = 0").count() == len(texts) and C.packing(spark, empty, str(tmp_path)).count() == 0


def test_quality_rejects_rows_not_ids(spark, tmp_path):
    r = random.Random(4)
    say = lambda: " ".join(r.choice("the quiet river runs to a green hill and back".split()) for _ in range(40))
    texts = [(i, say()) for i in range(80)] + [(None, say()), (None, "Q##Z$$ " * 60), (90, say()), (90, "Q##Z$$ " * 60), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(x.doc_id, x.text) for x in C.quality(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((x for x in texts if "$$" not in (x[1] or "")), key=str)


ITEM = "which of these ten rivers runs through the largest number of capital cities on its way"
