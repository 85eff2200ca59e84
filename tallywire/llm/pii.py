"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field for what they do not cover."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, tidy

KINDS = ("email", "ip", "card", "phone")
_AT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never begins inside a run of digits, so saying so changes nothing but keeps long runs linear
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part[-9:]) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns: leftmost and non-overlapping per kind, failing matches dropped."""
    out = []
    if "@" in text:
        at, done = text.find("@"), 0
        while at >= 0:
            m = _AT.match(text, at)
            s = at
            while s > done and text[s - 1] in _LOCAL:
                s -= 1
            if m and s < at:
                out.append((s, 0, m.end()))
                done = m.end()
                at = text.find("@", done)
            else:
                done = at + 1
                at = text.find("@", done)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
_CALL = frozenset("call phone tel telephone fax mobile cell dial ring text whatsapp sms".split())
_MAIL = frozenset("mail email write contact reach".split())
_CARD_WORDS = frozenset("card visa mastercard amex credit debit".split())
_HOST = frozenset("ip host server address addr".split())
_NOT = frozenset("order invoice isbn version release date year id no number ref page pages total".split())
FEATURES = (
    "bias digits<7 digits7-9 digits10 digits11-13 digits14-19 digits>19 nodigits plus paren groups334 groups4444 groups1 groups2 groups3+ four_small luhn14 at_sign at_word dot_word dot_sign"
    " letters two_letter_runs tld uniform_seps mixed_seps starts_word starts_digit ends_word ends_digit ends_punct call mail card host not_word glued_left glued_right long brackets zero_start"
    " comma two_at joins_left joins_right starts_joint loose_dot"
).split()
_F = {f: i for i, f in enumerate(FEATURES)}
_TLD = frozenset("com org net edu gov io de fr es uk info eu".split())
_JOINS = frozenset(("dot", "at", "@"))


def _numeral(word: str) -> bool:
    return word.isascii() and word.isdigit()


def _sign(word: str) -> bool:
    """A token that stands for the sign of an address."""
    return word == "@" or (len(word) == 2 and word.lower() == "at")


class Window:
    """Segments of a text's tokens that may be entities, each with features of the whole span.

    These are all segments of at most MOST tokens on one line that begin with a word, a number, a plus or an opening
    bracket, end with a word or a number, and have what no entity of the four kinds is without: FEWEST digits, or an
    address's sign between two other tokens. With first and last, those segments that end there, as places between tokens.
    """

    MOST = 18  # tokens of an entity: bounds the dynamic program
    FEWEST = 4  # digits of an entity without an address's sign; an IP has four numbers

    def __init__(self, text: str | list[str], first: int = 1, last: int | None = None):
        word = _TOKEN.findall(text) if isinstance(text, str) else text
        n = len(word)
        stop = itertools.accumulate(map(len, word))
        self.tokens = [(e - len(w), e) for w, e in zip(word, stop, strict=True)] if isinstance(text, str) else []
        last = n if last is None else last
        base = max(0, first - 1 - self.MOST - 5)
        low = [w.lower() for w in word[base:last]]
        seg, rows = [], []
        for j in range(first, last + 1):
            if not word[j - 1].isalnum():
                continue
            digits, at = 0, False
            right, after = word[j] if j < n else "", [w.lower() for w in word[j : j + 2]]
            for i in range(j - 1, max(-1, j - 1 - self.MOST), -1):
                w = word[i]
                if w.isspace():
                    if "\n" in w:
                        break
                    continue
                if _numeral(w):
                    digits += len(w)
                sign = _sign(w)
                if (digits >= self.FEWEST or (at and not sign)) and (w.isalnum() or w in "+(["):
                    seg.append((i, j))
                    rows.append(self._features(word[i:j], low[i - base : j - base], low[max(0, i - 5 - base) : i - base], word[i - 1] if i else "", right, after))
                at = at or (sign and i < j - 1)
        self.start = np.array([s for s, _ in seg], np.int64)
        self.end = np.array([e for _, e in seg], np.int64)
        self.x = np.zeros((len(seg), len(FEATURES)))
        self.x[np.repeat(np.arange(len(seg)), [len(r) for r in rows]), [_F[f] for r in rows for f in r]] = 1

    @functools.cached_property
    def by_end(self) -> list[np.ndarray]:
        return self._by(self.end)

    @functools.cached_property
    def by_start(self) -> list[np.ndarray]:
        return self._by(self.start)

    def _by(self, places: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(0, np.int64)] * (len(self.tokens) + 1)
        for k in np.unique(places).tolist():
            out[k] = np.flatnonzero(places == k)
        return out

    @staticmethod
    def _features(word, low, before, left, right, after):
        f = ["bias"]
        groups = [w for w in word if _numeral(w)]
        digits = "".join(groups)
        n = len(digits)
        near = [w for w in before[-2:] if not w.isspace()][-1:], [w for w in after if not w.isspace()][:1]
        inner = [w for w in low[-4:-1] if not w.isspace()][-1:]
        before = set(before)
        f.append("nodigits" if not n else "digits<7" if n < 7 else "digits7-9" if n < 10 else "digits10" if n == 10 else "digits11-13" if n < 14 else "digits14-19" if n < 20 else "digits>19")
        sizes = [len(g) for g in groups]
        seps = {w for w in word if not w.isalnum()}
        letters = [w for w in low if w.isalpha()]
        joined = "".join(word)
        checks = {
            "plus": word[0] == "+", "paren": word[0] == "(", "groups334": sizes == [3, 3, 4], "groups4444": sizes == [4, 4, 4, 4], "groups1": len(sizes) == 1, "groups2": len(sizes) == 2, "groups3+": len(sizes) > 2,
            "four_small": len(sizes) == 4 and max(sizes, default=9) <= 3 and all(int(g) <= 255 for g in groups), "luhn14": 14 <= n <= 19 and luhn(digits), "at_sign": "@" in seps, "at_word": "at" in letters,
            "dot_word": "dot" in letters, "dot_sign": "." in seps, "letters": bool(letters), "two_letter_runs": len([w for w in letters if w not in ("at", "dot")]) > 2, "tld": low[-1] in _TLD and inner in (["."], ["dot"], [")"], ["]"]),
            "uniform_seps": len(seps) == 1, "mixed_seps": len(seps) > 2, "starts_word": word[0].isalpha(), "starts_digit": word[0].isdigit(), "ends_word": word[-1].isalpha(), "ends_digit": word[-1].isdigit(),
            "call": bool(before & _CALL), "mail": bool(before & _MAIL), "card": bool(before & _CARD_WORDS), "host": bool(before & _HOST), "not_word": bool(before & _NOT),
            "glued_left": bool(left) and not left.isspace() and left not in ":(,;", "glued_right": bool(right) and not right.isspace() and right not in ".,;:!?)", "long": len(joined) > 40, "brackets": "[" in seps or "(" in seps, "zero_start": word[0].startswith("0"),
            "comma": "," in seps, "two_at": low.count("at") + low.count("@") > 1, "joins_left": bool(_JOINS.intersection(near[0])), "joins_right": bool(_JOINS.intersection(near[1])),
            "starts_joint": low[0] in _JOINS, "loose_dot": any(w == "." and not a.isspace() and b.isspace() for a, w, b in zip(word, word[1:], word[2:])),
        }
        return f + [k for k, v in checks.items() if v]


class SemiMarkov:
    """p(segmentation | text) over segments of one token outside and of bounded length inside entities.

    w: weights of (kind, feature); t: weights of a label after another, label 0 being outside; o: weight of a token outside.
    """

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    @staticmethod
    def _lse(x: np.ndarray) -> np.ndarray:
        top = x.max(0)
        safe = np.where(np.isinf(top), 0, top)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(x - safe).sum(0))

    def _scores(self, win: Window) -> np.ndarray:
        return win.x @ self.w.T

    def forward(self, win: Window, sc: np.ndarray):
        n, k = len(win.tokens), len(KINDS) + 1
        alpha = np.full((n + 1, k), -np.inf)
        alpha[0, 0] = 0
        pre = np.empty((n + 1, k))
        pre[0] = self._lse(alpha[0][:, None] + self.t)
        for i in range(1, n + 1):
            alpha[i, 0] = pre[i - 1, 0]
            ends = win.by_end[i]
            if len(ends):
                alpha[i, 1:] = self._lse(pre[win.start[ends], 1:] + sc[ends])
            pre[i] = self._lse(alpha[i][:, None] + self.t)
        return alpha, pre

    def backward(self, win: Window, sc: np.ndarray):
        n, k = len(win.tokens), len(KINDS) + 1
        beta = np.zeros((n + 1, k))
        ahead = np.empty(k)
        for i in range(n - 1, -1, -1):
            ahead[:] = -np.inf
            ahead[0] = beta[i + 1, 0]
            begins = win.by_start[i]
            if len(begins):
                ahead[1:] = self._lse(beta[win.end[begins], 1:] + sc[begins])
            beta[i] = self._lse((self.t + ahead[None, :]).T)
        return beta

    def gradient(self, win: Window, gold: list[tuple[int, int]]):
        """Log-likelihood of the gold segments (segment, kind), and its gradient for w and t."""
        sc = self._scores(win)
        alpha, pre = self.forward(win, sc)
        beta = self.backward(win, sc)
        z = self._lse(alpha[-1][:, None])[0]
        p = np.exp(pre[win.start, 1:] + sc + beta[win.end, 1:] - z)
        gw = -(p.T @ win.x)
        n = len(win.tokens)
        gt = np.zeros_like(self.t)
        for i in range(n):
            ahead = np.full(self.t.shape[0], -np.inf)
            ahead[0] = beta[i + 1, 0]
            if len(b := win.by_start[i]):
                ahead[1:] = self._lse(beta[win.end[b], 1:] + sc[b])
            gt -= np.exp(alpha[i][:, None] + self.t + ahead[None, :] - z)
        at, y, total = 0, 0, 0.0
        for k, kind in [*gold, (None, 0)]:
            stop = n if k is None else win.start[k]
            while at < stop:
                gt[y, 0] += 1
                total += self.t[y, 0]
                at, y = at + 1, 0
            if k is not None:
                gt[y, kind] += 1
                gw[kind - 1] += win.x[k]
                total += self.t[y, kind] + sc[k, kind - 1]
                at, y = win.end[k], kind
        return total - z, gw, gt

    def decode(self, word: list[str], at: int = 0, block: int = 2048) -> list[tuple[int, int, int]]:
        """(start, kind, end) in characters of the best segmentation of tokens: boundaries and kinds are chosen together.

        Segments are scored for `block` places where they may end at a time, so a long text takes memory for one step
        back a place and label.
        """
        n, k, none = len(word), len(KINDS) + 1, -np.inf
        t = self.t.tolist()
        came, start = bytearray(k * (n + 1)), array("q", [0]) * (k * (n + 1))
        ring = Window.MOST + 1
        pre: list[list[float]] = [t[0]] * ring  # of the last places: the best that a label there can follow on
        best = [0.0, *[none] * (k - 1)]
        for a in range(0, n, block):
            win = Window(word, a + 1, min(a + block, n))
            score, begin, end = self._scores(win).tolist(), win.start.tolist(), win.end.tolist()
            q = 0
            for i in range(a + 1, min(a + block, n) + 1):
                best = [pre[(i - 1) % ring][0], *[none] * (k - 1)]
                start[k * i] = i - 1
                some = q < len(end) and end[q] == i
                while q < len(end) and end[q] == i:
                    s, sc = begin[q], score[q]
                    ahead = pre[s % ring]
                    for y in range(1, k):
                        v = ahead[y] + sc[y - 1]
                        if v > best[y]:
                            best[y], start[k * i + y] = v, s
                    q += 1
                if some:
                    row = []
                    for y in range(k):
                        of = max(range(k), key=lambda x: best[x] + t[x][y])  # noqa: B023
                        row.append(best[of] + t[of][y])
                        came[k * i + y] = of
                    pre[i % ring] = row
                else:
                    pre[i % ring] = [best[0] + v for v in t[0]]
        i, y, found = n, max(range(k), key=lambda x: best[x]), []
        while i:
            s = start[k * i + y]
            if y:
                found.append((s, y - 1, i))
            i, y = s, came[k * s + y]
        if not found:
            return []
        places = [at, *itertools.accumulate(map(len, word), initial=at)][1:]
        return [(places[s], kind, places[e]) for s, kind, e in reversed(found)]


def examples(n: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up sentences with the spans in them, and with numbers that are none."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "ne", "lo", "the", "ri", "san", "tor", "un", "de", "ver"]) for _ in range(r.randint(1, 3)))
    dig = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(sep):
        d = dig(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    octets = lambda: [str(r.randint(0, 255)) for _ in range(4)]
    entity = [
        (3, lambda: f"({dig(3)}) {dig(3)}-{dig(4)}"), (3, lambda: f"{dig(3)}-{dig(3)}-{dig(4)}"), (3, lambda: f"{dig(3)}.{dig(3)}.{dig(4)}"), (3, lambda: f"{dig(3)} {dig(3)} {dig(4)}"),
        (3, lambda: f"0{dig(3)} {dig(3)} {dig(4)}"), (3, lambda: f"+{r.randint(1, 99)} {dig(3)} {dig(3)} {dig(4)}"), (3, lambda: f"+{dig(2)}-{dig(3)}-{dig(7)}"),
        (0, lambda: f"{word()} at {word()} dot {r.choice(['com', 'org', 'net'])}"), (0, lambda: f"{word()} [at] {word()}.{r.choice(['com', 'org'])}"), (0, lambda: f"{word()}.{word()} (at) {word()} (dot) com"),
        (0, lambda: f"{word()} @ {word()} . net"), (0, lambda: f"{word()}{dig(2)} at {word()} dot co dot uk"), (0, lambda: f"{word()} dot {word()} at {word()} dot {r.choice(['com', 'org', 'de'])}"), (0, lambda: f"{word()}.{word()} at {word()}.com"), (0, lambda: f"{word()}@{word()}.com"),
        (1, lambda: "[.]".join(octets())), (1, lambda: ".".join(octets())), (1, lambda: " . ".join(octets())), (2, lambda: card(".")), (2, lambda: card(" ")), (2, lambda: card("-")), (2, lambda: card(" - ")), (2, lambda: card("")),
    ]
    other = [
        lambda: f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}", lambda: f"order {dig(8)}", lambda: f"invoice {dig(4)}-{dig(6)}", lambda: f"isbn 978-{dig(1)}-{dig(2)}-{dig(6)}-{dig(1)}",
        lambda: f"{r.randint(1900, 2000)} - {r.randint(2001, 2030)}", lambda: f"{dig(2)}:{dig(2)} - {dig(2)}:{dig(2)}", lambda: f"{dig(3)}.{dig(3)}.{dig(3)}.{dig(3)}.{dig(3)}", lambda: f"{dig(20)}{dig(5)}", lambda: f"{dig(1)},{dig(3)},{dig(3)}.{dig(2)}",
        lambda: f"at {dig(2)} dot {word()}", lambda: f"{word()} at {word()} {word()}", lambda: f"ref {dig(16)}", lambda: f"total {dig(3)} {dig(3)} {dig(3)}", lambda: f"{dig(4)} {dig(4)}", lambda: f"the dot at {word()} {word()}", lambda: f"pages {dig(3)} - {dig(4)}",
    ]
    lead = [["call ", "phone: ", "tel. ", ""], ["ip ", "host ", "server ", ""], ["card ", "visa ", "credit card: ", ""], ["mail ", "write to ", "contact ", ""]]
    lead_of = {3: lead[0], 1: lead[1], 2: lead[2], 0: lead[3]}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(r.randint(1, 5))) + " ", []
        for _ in range(r.randint(1, 2)):
            if r.random() < 0.55:
                kind, make = r.choice(entity)
                text += r.choice(lead_of[kind])
                x = make()
                spans.append((len(text), kind, len(text) + len(x)))
            else:
                x = r.choice(other)()
            text += x + r.choice([" ", ", ", ". "]) + " ".join(word() for _ in range(r.randint(1, 4))) + " "
        out.append((text, spans))
    return out


def gold_segments(win: Window, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]] | None:
    where = {(win.tokens[s][0], win.tokens[e - 1][1]): k for k, (s, e) in enumerate(zip(win.start.tolist(), win.end.tolist(), strict=True))}
    try:
        return [(where[s, e], kind + 1) for s, kind, e in spans]
    except KeyError:
        return None


@functools.lru_cache(maxsize=4)
def train(n: int = 400, epochs: int = 12, rate: float = 0.3, decay: float = 1e-3, seed: int = 7) -> SemiMarkov:
    """Weights of the most likely segmentations of the made-up sentences, by stochastic gradient ascent."""
    k = len(KINDS) + 1
    model = SemiMarkov(np.zeros((len(KINDS), len(FEATURES))), np.zeros((k, k)))
    data = [(w, g) for t, s in examples(n, seed) if (g := gold_segments(w := Window(t), s)) is not None and len(w.start)]
    order = random.Random(seed)
    sw, st = np.full_like(model.w, 1e-2), np.full_like(model.t, 1e-2)
    for _ in range(epochs):
        order.shuffle(data)
        for w, g in data:
            _, gw, gt = model.gradient(w, g)
            gw, gt = gw - decay * model.w, gt - decay * model.t
            sw += gw**2
            st += gt**2
            model.w += rate * gw / np.sqrt(sw)
            model.t += rate * gt / np.sqrt(st)
    return model


def model_spans(text: str, model: SemiMarkov) -> list[tuple[int, int, int]]:
    """Entities of the best segmentation of the whole text.

    Tokens that are in no segment of a Window are outside in every segmentation, so it is put together from those of the
    stretches between them: those that a segment with a digit or an address's sign may reach.
    """
    word = _TOKEN.findall(text)
    reach = Window.MOST - 1
    stretches: list[list[int]] = []
    for i in [i for i, w in enumerate(word) if w[0] in "0123456789@" or (len(w) == 2 and w.lower() == "at")]:
        if stretches and i - reach <= stretches[-1][1]:
            stretches[-1][1] = i + reach + 1
        else:
            stretches.append([i - reach, i + reach + 1])
    out, seen, at = [], 0, 0
    for a, b in stretches:
        a = max(0, a - 5)  # words before a segment are features of it
        at, seen = at + sum(map(len, word[seen:a])), a
        out += model.decode(word[a : b + 1], at)  # the token behind is outside
    return out


def find_spans(text: str, model: SemiMarkov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans: what the model adds never overlaps a base span."""
    base = base_spans(text)
    ends = list(itertools.accumulate((e for _, _, e in base), max))  # of the spans up to each start
    starts = [s for s, _, _ in base]
    extra = [x for x in model_spans(text, model) if not (k := bisect.bisect_left(starts, x[2])) or ends[k - 1] <= x[0]]
    return base, sorted(base + extra)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, base, spans), arrays of (kind, start, end) in code points.

    base has the fixed patterns' spans, spans those and the model's. Null text is empty and has none. Null ids stay
    null, repeated rows get a row each, further columns are ignored, an empty table gives an empty result. One scan, no
    shuffle; the model is trained on made-up sentences by the driver and goes along with the task.

    The model reads every text from end to end. Entities are of the four kinds, of at most 18 tokens on one line and
    have four digits or the sign of an address, which is @ or the word at (`Window`); names and street addresses are of
    no such kind.
    """
    prepare(docs.sparkSession)
    model = train()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            got = [find_spans(t or "", model) for t in b.column(1).to_pylist()]
            cols = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in g[i]] for g in got], pa.list_(span)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "base", "spans"])

    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"`{id_col}` long, base {kind}, spans {kind}")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
