"""Mentions in text: amounts, dates, filing numbers, organizations, people."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms in which mentions are written. Digits are spelt [0-9] since \d takes other digits in Python than in Java and in
# the SQL that holds these queries: all three must find the same mentions.
AMOUNT = r"\$[0-9,]+(?:\.[0-9]+)?(?:\s*(?:million|billion|trillion|thousand|[Kk]))?"
DATE = (
    r"\b(?:(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?\s+[0-9]{1,2},\s+[0-9]{4}"
    r"|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|Q[1-4]\s+[0-9]{4}|FY\s?[0-9]{4})\b"
)
FILING = r"\b(?:FEC-[0-9]{4}-[0-9]{3,}|[0-9]{2}-(?:cv|cr)-[0-9]{3,}|(?:H\.R\.|S\.|H\.Res\.|S\.Res\.)\s*[0-9]+)\b"
ORGANIZATION = (
    r"[A-Z][A-Za-zÀ-ž'-]*(?:\s+[A-Z][A-Za-zÀ-ž'-]*)*\s+(?:LLC|LLP|Inc\.|Corp\.|Corporation|Foundation|Committee|Agency|Institute|Association|Coalition|Council|Bureau|Department|Authority|Commission|Board|Group|Fund|Trust|PAC|Super\s+PAC)"
)
TITLED = r"(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Sen\.|Rep\.|Gov\.|Sec\.|Gen\.|Lt\.|Col\.|Sgt\.|Amb\.)\s+[A-Z][a-zÀ-ž'-]+(?:\s+[A-Z][a-zÀ-ž'-]+){0,2}"
BARE = r"\b([A-Z][a-zÀ-ž'-]+(?:\s+[A-Z][a-zÀ-ž'-]+){1,2})\b"
# Pairs of capitalized words that are no names.
NO_NAMES = (
    "The United", "United States", "New York", "New Jersey", "New Mexico", "New Hampshire", "Los Angeles", "San Francisco", "Las Vegas", "White House", "House Committee", "Senate Committee", "Federal Reserve",
    "Supreme Court", "District Court", "Circuit Court", "January February", "March April", "May June", "July August", "September October", "November December", "Monday Tuesday", "Wednesday Thursday", "Friday Saturday",
)
KINDS = ("person", "organization", "amount", "date", "filing")

_C = {k: re.compile(v) for k, v in (("amount", AMOUNT), ("date", DATE), ("filing", FILING), ("org", ORGANIZATION), ("titled", TITLED), ("bare", BARE))}
_NO = {x.lower() for x in NO_NAMES}


def all_matches(c: Column, pattern: str) -> Column:
    """All matches of one of the patterns, inside the JVM."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def mentions(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, first character, first byte) by place, then kind.

    Organizations do not overlap amounts; people overlap neither, and a name with a title goes before a bare name that
    begins at the same place. So the name behind a title is a mention of its own.
    """
    spans = lambda k: [(m.start(), m.end()) for m in _C[k].finditer(text)]
    clash = lambda s, xs: any(s[0] < e and s[1] > b for b, e in xs)
    amounts, dates, filings = spans("amount"), spans("date"), spans("filing")
    orgs = [s for s in spans("org") if not clash(s, amounts)]
    people: list[tuple[int, int]] = []
    for k in ("titled", "bare"):
        for s in spans(k):
            if clash(s, amounts) or clash(s, orgs) or any(s[0] == p[0] for p in people) or (k == "bare" and text[s[0] : s[1]].lower() in _NO):
                continue
            people.append(s)
    rows = [(rank, s) for rank, xs in enumerate((people, orgs, amounts, dates, filings)) for s in xs]
    rows.sort(key=lambda r: (r[1][0], r[0]))
    return [(KINDS[rank], text[a:b], a, len(text[:a].encode())) for rank, (a, b) in rows]


def extract_mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, kind, mention, char_offset, byte_offset), a row for each mention."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in mentions(t or "")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [b.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [id_col, "kind", "mention", "char_offset", "byte_offset"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"{id_col} {kind}, kind string, mention string, char_offset bigint, byte_offset bigint")
