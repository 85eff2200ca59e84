"""A directed multigraph as an edge table (seq, src, dst, rel_type): degrees, paths, components, centrality."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, numbered


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree); parallel edges count each."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(in + out) / (nodes - 1); 0 in a graph of one node."""
    d = degrees(edges)
    n = F.broadcast(d.agg(F.count("*").alias("n")))
    return d.crossJoin(n).select("node", F.when(F.col("n") > 1, (F.col("in_degree") + F.col("out_degree")) / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("centrality"))


def both_ways(edges: DataFrame) -> DataFrame:
    turned = [F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns]
    return edges.unionByName(edges.select(*turned))


def ego(edges: DataFrame, start, depth: int, directed: bool = True) -> DataFrame:
    """The edges among the nodes within `depth` steps of the start: (seq, src, dst, rel_type)."""
    e = edges if directed else both_ways(edges)
    seen = edges.sparkSession.createDataFrame([(start,)], [("node")]).withColumn("node", F.col("node").cast(edges.schema["src"].dataType))
    front = seen
    for _ in range(depth):
        front = e.join(front, e["src"] == front["node"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = cut(seen.union(front))
        front = seen if depth == 1 else front
    inside = seen.distinct()
    return edges.join(inside.withColumnRenamed("node", "src"), "src", "left_semi").join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("seq", "src", "dst", "rel_type")


def simple_paths(edges: DataFrame, start, end, longest: int) -> DataFrame:
    """(path): all cycle-free paths of at most `longest` edges; parallel edges give the path again. From a node to itself: the node alone."""
    spark = edges.sparkSession
    if start == end:
        return spark.createDataFrame([(str(start),)], "path string")
    e = edges.select(F.col("src").cast("string").alias("at"), F.col("dst").cast("string").alias("to"))
    path = spark.createDataFrame([([str(start)], str(start))], "nodes array<string>, at string")
    out = None
    for _ in range(longest):
        path = path.join(e, "at").filter(~F.array_contains("nodes", F.col("to"))).select(F.concat("nodes", F.array("to")).alias("nodes"), F.col("to").alias("at"))
        hit = path.filter(F.col("at") == str(end))
        out = hit if out is None else out.unionByName(hit)
        path = path.filter(F.col("at") != str(end))
    if out is None:
        return spark.createDataFrame([], "path string")
    return out.select(F.array_join("nodes", "->").alias("path"))


def shortest_path(edges: DataFrame, start, end, directed: bool = True) -> DataFrame:
    """(path, length) of the least path with fewest edges, by its nodes as text; no row if there is none.

    Each round joins the front with the edges and keeps for every new node the least path to it, until the end is
    reached or no node is new.
    """
    spark = edges.sparkSession
    if start == end:
        known = nodes(edges).filter(F.col("node") == start).limit(1)
        return known.select(F.lit(str(start)).alias("path"), F.lit(0).alias("length"))
    e = (edges if directed else both_ways(edges)).select(F.col("src").cast("string").alias("at"), F.col("dst").cast("string").alias("to")).distinct()
    e = cut(e)
    front = spark.createDataFrame([(str(start), [str(start)])], "at string, nodes array<string>")
    seen = front.select("at")
    for k in itertools.count(1):
        front = front.join(e, "at").select(F.col("to").alias("at"), F.concat("nodes", F.array("to")).alias("nodes")).join(seen, "at", "left_anti").groupBy("at").agg(F.min("nodes").alias("nodes"))
        front = cut(front)
        hit = front.filter(F.col("at") == str(end))
        if not hit.isEmpty():
            return hit.select(F.array_join("nodes", "->").alias("path"), F.lit(k).alias("length"))
        if front.isEmpty():
            break
        seen = seen.union(front.select("at"))
    return spark.createDataFrame([], "path string, length int")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected, named by the least node; by large-star and small-star rounds."""
    e = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(low, "a")
        e = cut(linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b"))).filter("a > b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes(edges).join(e.select(F.col("a").alias("node"), F.col("b").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def component_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("component").agg(F.count("*").alias("size"))


def component_communities(labelled: DataFrame) -> DataFrame:
    """(community, node): components numbered from 0 by their least node."""
    ids = numbered(labelled.select("component").distinct(), "community", "component")
    return labelled.join(ids, "component").select("community", "node")


def dense_clusters(edges: DataFrame, labelled: DataFrame, least: int) -> DataFrame:
    """(component, size, internal_edges, density): density is 2E / (n (n - 1)) on directed edges."""
    inner = edges.join(labelled, edges["src"] == labelled["node"]).groupBy("component").agg(F.count("*").alias("internal_edges"))
    n = F.col("size")
    out = component_sizes(labelled).filter(n >= least).join(inner, "component", "left").withColumn("internal_edges", F.coalesce("internal_edges", F.lit(0).cast("bigint")))
    return out.select("component", "size", "internal_edges", F.when(n > 1, 2 * F.col("internal_edges") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Sum over existing edges inside a community of 1 - out(src) * in(dst) / m, by m; 0 without edges."""
    d = degrees(edges)
    c = communities.select("node", "community")
    both = (
        edges.join(c.select(F.col("node").alias("src"), F.col("community").alias("ca")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("cb")), "dst")
        .join(d.select(F.col("node").alias("src"), "out_degree"), "src").join(d.select(F.col("node").alias("dst"), "in_degree"), "dst")
    )
    m = F.broadcast(edges.agg(F.count("*").alias("m")))
    part = both.crossJoin(m).filter("ca = cb").agg(F.sum((1 - F.col("out_degree") * F.col("in_degree") / F.col("m")) / F.col("m")).alias("q"))
    return part.select(F.coalesce("q", F.lit(0.0)).alias("modularity"))


def betweenness(edges: DataFrame, largest: int = 2_000_000) -> DataFrame:
    """(node, centrality): shortest paths through a node, parallel edges as so many paths, by (n - 1)(n - 2).

    Up to `largest` edges the graph is broadcast and the sources are dealt out. Beyond that the searches of a block of
    sources go level by level as joins with the edges.
    """
    spark = edges.sparkSession
    if edges.count() > largest:
        return _normed(edges, _dependencies_by_joins(edges))
    shared = spark.sparkContext.broadcast([tuple(r) for r in edges.select("src", "dst").collect()])
    kind = edges.schema["src"].dataType.simpleString()

    def run(frames):
        out: dict = {}
        for a, b in shared.value:
            out.setdefault(a, []).append(b)
        score: dict = {}
        for frame in frames:
            for s in frame["node"]:
                dist, sigma, order, before = {s: 0}, {s: 1.0}, [s], {}
                for v in order:
                    for w in out.get(v, ()):
                        if w not in dist:
                            dist[w], sigma[w] = dist[v] + 1, 0.0
                            order.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            before.setdefault(w, []).append(v)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != s:
                        score[w] = score.get(w, 0.0) + delta[w]
        yield pd.DataFrame({"node": list(score), "s": [float(x) for x in score.values()]})

    return _normed(edges, nodes(edges).repartition("node").mapInPandas(run, f"node {kind}, s double"))


def _normed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, centrality) from summands (node, s)."""
    names = nodes(edges)
    n = names.count()
    sums = parts.groupBy("node").agg(F.sum("s").alias("s"))
    norm = float((n - 1) * (n - 2)) if n > 2 else 0.0
    return names.join(sums, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) / norm if norm else F.lit(0.0)).alias("centrality"))


def _dependencies_by_joins(edges: DataFrame, states: int = 500_000_000) -> DataFrame:
    """(node, s): what a block of sources adds to each node's betweenness, blocks of about `states` pairs of source and node at a time.

    Forward, a level's nodes are those that the one before it leads to and that its source has not reached, with the
    number of shortest paths to them. Backward, each node's dependency is shared out to the level before it.
    """
    e = cut(edges.groupBy("src", "dst").agg(F.count("*").alias("m")).withColumnsRenamed({"src": "v", "dst": "w"}))
    names = nodes(edges)
    blocks = max(1, -(-(names.count() ** 2) // states))
    out = None
    for k in range(blocks):
        block = names.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k)
        levels = [cut(block.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("sigma")))]
        seen = levels[0].select("s", "v")
        while True:
            reached = levels[-1].join(e, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
            level = cut(reached.join(seen, ["s", "v"], "left_anti"))
            if level.isEmpty():
                break
            levels.append(level)
            seen = seen.union(level.select("s", "v"))
        below = None
        for level in reversed(levels[1:]):
            own = level.withColumn("delta", F.lit(0.0))
            if below is not None:
                ahead = below.select("s", F.col("v").alias("w"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
                gained = level.join(e, "v").join(ahead, ["s", "w"]).groupBy("s", "v").agg(F.sum(F.col("m") * F.col("share")).alias("g"))
                own = level.join(gained, ["s", "v"], "left").withColumn("delta", F.col("sigma") * F.coalesce("g", F.lit(0.0))).drop("g")
            below = cut(own)
            part = below.groupBy(F.col("v").alias("node")).agg(F.sum("delta").alias("s"))
            out = part if out is None else out.unionByName(part)
        out = None if out is None else cut(out.groupBy("node").agg(F.sum("s").alias("s")))
    return names.select("node", F.lit(0.0).alias("s")).limit(0) if out is None else out


def articulation_points(edges: DataFrame, labelled: DataFrame) -> DataFrame:
    """(node) of the cut vertices of the undirected graph, parallel edges being one; one task for each component."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(part["src"], part["dst"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        order, low, cuts = {}, {}, set()
        for root in sorted(near):
            if root in order:
                continue
            order[root] = low[root] = len(order)
            stack, children = [(root, None, iter(sorted(near[root])))], 0
            while stack:
                v, parent, todo = stack[-1]
                for w in todo:
                    if w not in order:
                        order[w] = low[w] = len(order)
                        stack.append((w, v, iter(sorted(near[w]))))
                        children += v == root
                        break
                    if w != parent:
                        low[v] = min(low[v], order[w])
                else:
                    stack.pop()
                    if stack:
                        u = stack[-1][0]
                        low[u] = min(low[u], low[v])
                        if u != root and low[v] >= order[u]:
                            cuts.add(u)
            if children > 1:
                cuts.add(root)
        return pd.DataFrame({"node": pd.Series(sorted(cuts), dtype=part["src"].dtype)})

    own = edges.join(labelled, edges["src"] == labelled["node"]).select("component", "src", "dst")
    return own.groupBy("component").applyInPandas(run, f"node {kind}")


def label_propagation(edges: DataFrame, labelled: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): asynchronous propagation in the order in which nodes first appear in the edges, labels being that order.

    A node takes the most frequent label of its in- and out-neighbours, parallel edges counting each, of equally
    frequent ones the smallest. Components do not touch each other, so each is one task; only the order counts.
    """
    kind = edges.schema["src"].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("seq")
        label: dict = {}
        near: dict = {}
        first = {}
        for q, a, b in zip(part["seq"], part["src"], part["dst"], strict=True):
            for k, x in enumerate((a, b)):
                first.setdefault(x, 2 * q + k)
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        label = dict(first)
        for _ in range(rounds):
            changed = False
            for v in first:
                votes: dict = {}
                for w in near[v]:
                    votes[label[w]] = votes.get(label[w], 0) + 1
                best = min(votes, key=lambda x: (-votes[x], x))
                if best != label[v]:
                    label[v], changed = best, True
            if not changed:
                break
        return pd.DataFrame({"node": list(label), "label": [int(x) for x in label.values()]})

    own = edges.join(labelled, edges["src"] == labelled["node"]).select("component", "seq", "src", "dst")
    return own.groupBy("component").applyInPandas(run, f"node {kind}, label bigint")


def label_propagation_in_rounds(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): as label_propagation, but all nodes of a round look at the labels of the round before.

    Each round is one join and one count by node and label, for graphs whose largest component is no single task's. Two
    sides of a graph may swap labels for ever, so `rounds` is a bound; the asynchronous rule has other results.
    """
    ends = edges.select(F.col("src").alias("node"), (F.col("seq") * 2).alias("q")).unionAll(edges.select("dst", F.col("seq") * 2 + 1))
    label = cut(ends.groupBy("node").agg(F.min("q").alias("label")))
    near = cut(both_ways(edges.select("src", "dst")).groupBy("src", "dst").agg(F.count("*").alias("m")))
    for _ in range(rounds):
        votes = near.join(label, near["dst"] == label["node"]).groupBy("src", "label").agg(F.sum("m").alias("n"))
        now = cut(votes.groupBy(F.col("src").alias("node")).agg(F.max(F.struct("n", (-F.col("label")).alias("o"), "label")).getField("label").alias("label")))
        same = now.join(label, ["node", "label"], "left_anti").isEmpty()
        label = now
        if same:
            break
    return label
