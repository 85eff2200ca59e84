"""Money through several hands: chains of flows over time, and traces along financial edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FINANCIAL
from ..session import cut, numbered


def flow_chains(flows: DataFrame, gap: int, least: int = 2) -> DataFrame:
    """(path, n, total, first_date, last_date): maximal chains of flows, each passing on what the flow before it brought.

    A chain goes on with a flow not yet in it whose donor is the last recipient and whose date is 0 to `gap` days on. Of
    chains over one sequence of nodes the first stays, by the flows' order (date, flow_id). Chains grow by one join a
    round, until none grows; a chain that none goes on from is maximal. Guards: gap < 0 or least = 0 give no rows. The
    rule asks for every chain, so the result grows with the number of ways through the flows: narrow the flows or the
    gap where many hands pass money on within it.
    """
    rows = flows.select("flow_id", F.col("donor").cast("string").alias("donor"), F.col("recipient").cast("string").alias("recipient"), "amount", "date")
    f = cut(numbered(rows, "rank", "date", "flow_id"))
    nxt = f.select(F.col("donor").alias("at"), F.col("recipient").alias("to"), F.col("amount").alias("more"), F.col("date").alias("on"), F.col("rank").alias("next"))
    chain = f.select(F.array("rank").alias("ranks"), F.array("donor", "recipient").alias("nodes"), F.col("amount").alias("total"), F.col("date").alias("first_date"), F.col("date").alias("last_date"), F.col("recipient").alias("at"))
    if gap < 0 or least == 0:
        chain = chain.limit(0)
    done = None
    while True:
        days = F.datediff("on", "last_date")
        grown = chain.join(nxt, "at").filter((days >= 0) & (days <= gap) & ~F.array_contains("ranks", F.col("next")))
        grown = cut(grown.select(F.concat("ranks", F.array("next")).alias("ranks"), F.concat("nodes", F.array("to")).alias("nodes"), (F.col("total") + F.col("more")).alias("total"), "first_date", F.col("on").alias("last_date"), F.col("to").alias("at")))
        longer = grown.select(F.slice("ranks", F.lit(1), F.size("ranks") - 1).alias("ranks")).distinct()
        ended = cut(chain.join(longer, "ranks", "left_anti").filter(F.size("ranks") >= least))
        done = ended if done is None else done.unionByName(ended)
        if grown.isEmpty():
            break
        chain = grown
    path = F.array_join("nodes", "->")
    best = Window.partitionBy("path").orderBy("ranks")
    out = done.withColumn("path", path).withColumn("k", F.row_number().over(best)).filter("k = 1")
    return out.select("path", F.size("ranks").alias("n"), "total", "first_date", "last_date")


def money_trace(edges: DataFrame, source, deepest: int = 5, kinds=FINANCIAL) -> DataFrame:
    """(hops array<string>, total_amount, hop_count): every cycle-free path of 1 to `deepest` hops from the source.

    Edges of the financial kinds; of a pair's amounts the last registered (largest seq) holds for each of its edges,
    and parallel edges give parallel paths.
    """
    e = edges.filter(F.col("rel_type").isin(*kinds))
    last = edges.groupBy("src", "dst").agg(F.max_by("amount", "seq").alias("amount"))
    e = cut(e.select("seq", "src", "dst").join(last, ["src", "dst"]).select(F.col("src").cast("string").alias("at"), F.col("dst").cast("string").alias("to"), "amount"))
    path = e.filter(F.col("at") == str(source)).filter("to <> at").select(F.array("at", "to").alias("hops"), F.coalesce("amount", F.lit(0.0)).alias("total_amount"), F.col("to").alias("at"))
    out = path
    for _ in range(deepest - 1):
        path = path.join(e, "at").filter(~F.array_contains("hops", F.col("to"))).select(F.concat("hops", F.array("to")).alias("hops"), (F.col("total_amount") + F.coalesce("amount", F.lit(0.0))).alias("total_amount"), F.col("to").alias("at"))
        out = out.unionByName(path)
    return out.select("hops", "total_amount", (F.size("hops") - 1).alias("hop_count"))


def flow_destinations(paths: DataFrame) -> DataFrame:
    """Whole-path amounts by last node, over every path, prefixes of other paths included."""
    return paths.groupBy(F.element_at("hops", -1).alias("destination")).agg(F.sum("total_amount").alias("total"), F.count("*").alias("paths"))
