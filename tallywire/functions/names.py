"""Similarity of names: Jaro and Jaro-Winkler as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Name parts that do not tell persons apart.
SUFFIXES = ("jr", "sr", "i", "ii", "iii", "iv", "v", "esq", "phd", "md", "dds", "jd")


def jaro(a: str, b: str) -> float:
    """Jaro similarity; equal strings 1, an empty one 0; half transpositions are dropped."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not taken[j] and b[j] == c), None)
        if j is not None:
            taken[j] = True
            mine.append(c)
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by a tenth of what is missing for each of up to four equal first letters."""
    j, p = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        p += 1
    return j + p * 0.1 * (1 - j)


@pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


def name_parts(c: Column) -> tuple[Column, Column]:
    """First names and last name: lower case, signs at the ends of words and suffixes dropped."""
    words = F.transform(F.split(F.trim(F.lower(c)), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*SUFFIXES))
    n = F.size(kept)
    first = F.when(n > 1, F.array_join(F.slice(kept, F.lit(1), n - 1), " ")).otherwise(F.lit(""))
    return first, F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))


def part_similarity(a: Column, b: Column) -> Column:
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(jaro_winkler_udf(a, b))


def _jaro_bound(least: float) -> float:
    """The Jaro similarity without which Jaro-Winkler does not reach `least`: four equal letters close 0.4 of what is missing."""
    return (least - 0.4) / 0.6


def _common(la: Column, lb: Column, least: float) -> Column:
    """Letters that parts of these lengths must have in common: Jaro is (m / la + m / lb + 1) / 3 at most."""
    need = (3 * _jaro_bound(least) - 1) * la * lb / (la + lb)
    return F.greatest(F.ceil(need - 1e-9), F.lit(1)).cast("int")


def numbered_letters(c: Column) -> Column:
    """The letters of a part, rare ones first, each with a number for how often it has come: two parts have as many in common as letters."""
    order = F.create_map(*(F.lit(x) for k, v in enumerate("etaoinrslhdcumfpgwybvkxjqz") for x in (v, -k)))
    letters = F.array_sort(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.struct(F.coalesce(F.try_element_at(order, x), F.lit(-99)).alias("k"), x.alias("x"))))
    return F.transform(letters, lambda s, i: F.concat(s.x, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda y: y.x == s.x)).cast("string")))


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the similarity of two parts can be `least`, by their lengths and the letters they have in common."""
    la, lb = F.length(a), F.length(b)
    same = F.size(F.array_intersect(numbered_letters(a), numbered_letters(b)))
    shortest = 0.4 + 0.6 * (2 + F.least(la, lb) / F.greatest(la, lb)) / 3 >= least - 1e-9
    return F.when((la == 0) & (lb == 0), F.lit(True)).when((la == 0) | (lb == 0), F.lit(least <= 0)).otherwise(shortest & (same >= _common(la, lb, least) if _jaro_bound(least) > 1 / 3 else (same > 0) | F.lit(least <= 0)))


def similar_parts(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of distinct parts, from the columns a and b, whose similarity is `least` or more; above 0.8.

    A pair must have a number of letters in common that follows from its lengths. So with both parts' letters in one
    order, rare ones first, the first letters of each, all but that number less one, must meet: these are the keys,
    with both lengths. No letter is a key of its own.
    """
    if least <= 0.8:
        raise ValueError("parts are compared by length from a similarity above 0.8 on")
    ratio = 3 * _jaro_bound(least) - 2

    def keyed(d: DataFrame, c: str, mine_first: bool) -> DataFrame:
        n = F.length(c)
        lengths = F.sequence(F.greatest(F.ceil(n * ratio - 1e-9), F.lit(1)).cast("int"), F.floor(n / ratio + 1e-9).cast("int"))
        each = d.distinct().filter(n > 0).withColumn("t", numbered_letters(F.col(c))).withColumn("l", F.explode(lengths))
        prefix = F.slice("t", F.lit(1), F.greatest(n - _common(n, F.col("l"), least) + 1, F.lit(0)))
        la, lb = (n, F.col("l")) if mine_first else (F.col("l"), n)
        return each.select(c, la.alias("la"), lb.alias("lb"), F.explode(prefix).alias("k"))

    met = keyed(a, "a", True).join(keyed(b, "b", False), ["la", "lb", "k"]).select("a", "b").distinct()
    met = met.filter(may_reach(F.col("a"), F.col("b"), least)).filter(part_similarity(F.col("a"), F.col("b")) >= least - 1e-12)
    empty = a.filter("a = ''").distinct().join(b.filter("b = ''").distinct(), F.col("a") == F.col("b"))
    return met.union(empty.select("a", "b"))
