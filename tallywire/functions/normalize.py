"""Names, amounts, dates, states, ids, URLs and texts in one form, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a suffix of a person's name.
SUFFIXES = r"Jr\.?|Sr\.?|II|III|IV|V|MD|M\.D\.?|PhD|Ph\.D\.?|Esq\.?|JD|J\.D\.?|CPA\.?|DDS|D\.D\.S\.?|DO|D\.O\.?|RN|R\.N\.?"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# The states and the district by code.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan",
    "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York",
    "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
# Party codes of the two registers.
PARTIES_FILINGS = {"DEM": "Democrat", "Democrat": "Democrat", "REP": "Republican", "Republican": "Republican", "IND": "Independent", "Independent": "Independent", "LIB": "Libertarian", "Libertarian": "Libertarian", "GRE": "Green", "Green": "Green"}
PARTIES_MEMBERS = {"Democrat": "Democrat", "Democratic": "Democrat", "D": "Democrat", "Republican": "Republican", "R": "Republican", "Independent": "Independent", "I": "Independent"}


def lookup(c: Column, values: dict[str, str], other: str | None = None) -> Column:
    """The value of a key, `other` for unknown keys, null for null."""
    m = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(m, c), F.lit(other)))


def one_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def person_name(c: Column) -> Column:
    """First names, last name, each word with a capital; suffixes go; 'LAST, FIRST' is turned when LAST is one word or in capitals."""
    bare = F.regexp_replace(one_spaced(c), rf"(?i)(\s*,?\s*\b({SUFFIXES})\s*)+$", "")
    bare = F.trim(F.regexp_replace(bare, r"[\s,]+$", ""))
    last, rest = F.trim(F.substring_index(bare, ",", 1)), F.trim(F.regexp_extract(bare, r"^[^,]*,(.*)$", 1))
    turn = F.contains(bare, F.lit(",")) & (rest != "") & (~F.contains(last, F.lit(" ")) | (F.upper(last) == last))
    return F.initcap(one_spaced(F.when(turn, F.concat(rest, F.lit(" "), last)).otherwise(bare)))


# The forms of amounts and dates. Digits are spelt [0-9] to be the same ones in Java and in the SQL that holds these queries.
_AMOUNT = r"(?i)^\$?\s*([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*(k|m|b|t|thousand|million|billion|trillion)?$"


def dollar_amount(c: Column) -> Column:
    """An amount of money as a number; null for anything else, negatives included."""
    t = F.trim(c)
    number = F.regexp_replace(F.regexp_extract(t, _AMOUNT, 1), ",", "").try_cast("double")
    unit = F.substring(F.lower(F.regexp_extract(t, _AMOUNT, 2)), 1, 1)
    return number * F.when(unit == "t", F.when(F.lower(F.regexp_extract(t, _AMOUNT, 2)) == "thousand", 1e3).otherwise(1e12)).when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)


# Fixed values.
_TEXT_DATE = r"(?i)^(January|February|March|April|May|June|July|August|September|October|November|December|Jan\.?|Feb\.?|Mar\.?|Apr\.?|Jun\.?|Jul\.?|Aug\.?|Sep\.?|Sept\.?|Oct\.?|Nov\.?|Dec\.?)\s+([0-9]{1,2}),?\s+([0-9]{4})$"


def calendar_date(c: Column) -> Column:
    """Y-m-d, m/d/Y and 'Month d, Y' as a date; null where there is no such day."""
    t = one_spaced(c)
    two = lambda x: F.lpad(x, 2, "0")
    iso, us = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    part = lambda p, k: F.regexp_extract(t, p, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(_TEXT_DATE, 1), 1, 3))).cast("string")
    text = (
        F.when(t.rlike(iso), F.concat_ws("-", part(iso, 1), two(part(iso, 2)), two(part(iso, 3))))
        .when(t.rlike(us), F.concat_ws("-", part(us, 3), two(part(us, 1)), two(part(us, 2))))
        .when(t.rlike(_TEXT_DATE), F.concat_ws("-", part(_TEXT_DATE, 3), two(month), two(part(_TEXT_DATE, 2))))
    )
    return F.try_to_date(text, "yyyy-MM-dd")


def state_code(c: Column) -> Column:
    """The two-letter code of a state given by code or name, in any case."""
    t = F.upper(F.trim(c))
    codes = {k: k for k in STATES} | {v.upper(): k for k, v in STATES.items()}
    return lookup(t, codes)


def folded(c: Column) -> Column:
    """Lower case, white space runs as one blank."""
    return F.lower(one_spaced(c))


def fingerprint(kind: Column, fields: Column) -> Column:
    """SHA-256 of a record's type and its fields in order of their keys."""
    keys = F.array_sort(F.map_keys(fields))
    parts = F.transform(keys, lambda k: F.concat(folded(k), F.lit("\x01"), folded(F.coalesce(F.element_at(fields, k), F.lit(""))), F.lit("\x00")))
    return F.sha2(F.concat(folded(kind), F.lit("\x00"), F.array_join(parts, "")), 256)


def candidate_id_ok(c: Column) -> Column:
    return c.rlike("^([HS][0-9][A-Z]{2}|P[0-9][A-Z0]{2})[0-9]{5}$")


def committee_id_ok(c: Column) -> Column:
    return c.rlike("^C[0-9]{8}$")


def sanitized(c: Column) -> Column:
    """Without control characters; white space runs as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{Cc}&&[^\s\x85]]", ""), r"(?U)\s+", " "))


def url_ok(c: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https") & (F.coalesce(F.try_parse_url(c, F.lit("HOST")), F.lit("")) != ""), F.lit(False))


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*(>|$)", "")


def committee_kind(c: Column) -> Column:
    """Organization type by the committee type's text; 'Super PAC' before 'PAC' before 'Party'."""
    has = lambda *xs: F.coalesce(c.rlike("|".join(xs)), F.lit(False))
    return F.when(has("Super PAC", "Super Pac"), "SuperPac").when(has("PAC", "Pac"), "Pac").when(has("Party"), "PoliticalParty").otherwise("Other")


def docket_kind(suit: Column, court: Column) -> Column:
    """Case type of a docket, by its court and then the nature of its suit."""
    t = F.lower(F.coalesce(court, F.lit("")))
    circuits = [f"ca{i}" for i in range(1, 12)] + ["cadc", "cafc"]
    return (
        F.when((t == "scotus") | F.contains(t, F.lit("supreme")), "SupremeCourt").when(F.contains(t, F.lit("bankr")), "Bankruptcy").when(t.isin(*circuits), "Appellate")
        .when(F.contains(suit, F.lit("Criminal")), "Criminal").when(F.contains(suit, F.lit("Bankruptcy")), "Bankruptcy").otherwise("Civil")
    )


def case_kind(c: Column) -> Column:
    """Case type by words in its text; the first that is there decides."""
    t = F.lower(c)
    out = None
    for words, kind in (("criminal", "Criminal"), ("bankruptcy", "Bankruptcy"), ("appeal|appellate", "Appellate"), ("supreme", "SupremeCourt"), ("administrative", "Administrative"), ("civil", "Civil")):
        out = F.when(t.rlike(words), kind) if out is None else out.when(t.rlike(words), kind)
    return out.otherwise("Other")


def plain_number(c: Column) -> Column:
    """A double as text without an exponent or a needless fraction."""
    text = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(c.isNotNull(), text)


def display_text(c: Column) -> Column:
    """Without angle brackets and white space at the ends, as the front end shows it."""
    return F.trim(F.regexp_replace(c, "[<>]", ""))


def sortable_date(c: Column) -> Column:
    """Milliseconds since 1970 of an ISO date or time; 0 without one, so that undated rows come first."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(c)), F.lit(0).cast("bigint"))
