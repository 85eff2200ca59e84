import random

import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) as documents, with further columns whose names operators use themselves."""

    def build(rows, lang="en"):
        full = [(i, t, lang, "src1", None if t is None else len(t), True, "x", 7, 1, b"z") for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, component string, doc bigint, th bigint, digest binary")

    return build


@pytest.fixture(scope="session")
def prose():
    """Made-up texts with exact copies, near copies, shared passages, nulls, empty, short and long ones."""
    r = random.Random(3)
    words = ["".join(r.choice(["ta", "le", "no", "ri", "sé", "ou", "the", "and"]) for _ in range(r.randint(1, 3))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = say(40)
    base = say(120).split()
    rows = [(i, say(r.randint(5, 150))) for i in range(40)]
    rows += [(100 + i, shared + " " + say(20)) for i in range(6)] + [(110 + i, say(9) + " " + shared) for i in range(4)]
    for i in range(12):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((200 + i, " ".join(w)))
    rows += [(300, rows[0][1]), (301, rows[0][1] + "\n"), (302, "  " + rows[0][1].replace(" ", "\t")), (303, None), (304, ""), (305, " \n"), (306, "one two"), (307, "One  TWO"), (308, "x"), (None, rows[1][1]), (None, None)]
    rows += [(400, say(4000)), (401, "aaaa" * 100), (402, "ab" * 400), rows[2], (403, "🙂 é " * 60)]
    return rows
