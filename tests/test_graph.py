import pytest

from tallywire.operators import export, flows, graph


def edges(spark, text):
    return spark.createDataFrame([(i, *e.split(">"), "DonatedTo", 1.0) for i, e in enumerate(text.split())], "seq bigint, src string, dst string, rel_type string, amount double")


def test_degrees_count_parallel_edges(spark):
    d = {r.node: (r.out_degree, r.in_degree) for r in graph.degrees(edges(spark, "a>b a>c c>a a>b")).collect()}
    assert d == {"a": (3, 1), "b": (0, 2), "c": (1, 1)}


def test_paths(spark):
    e = edges(spark, "a>b a>c b>d c>d")
    assert sorted(r.path for r in graph.simple_paths(e, "a", "d", 2).collect()) == ["a->b->d", "a->c->d"]
    assert graph.simple_paths(e, "a", "d", 1).count() == 0
    assert [r.path for r in graph.simple_paths(e, "a", "a", 3).collect()] == ["a"]
    assert graph.simple_paths(edges(spark, "a>b a>b"), "a", "b", 2).count() == 2
    assert graph.shortest_path(e, "a", "d").first() == ("a->b->d", 2)
    assert graph.shortest_path(e, "d", "a").count() == 0
    assert graph.shortest_path(e, "d", "a", directed=False).first()["length"] == 2


def test_ego(spark):
    got = graph.ego(edges(spark, "a>b b>c a>d"), "a", 1)
    assert sorted((r.src, r.dst) for r in got.collect()) == [("a", "b"), ("a", "d")]


def test_components_and_clusters(spark):
    e = edges(spark, "a>b b>c x>y z>z")
    c = graph.components(e)
    assert {r.node: r.component for r in c.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    chain = edges(spark, " ".join(f"n{i}>n{i + 1}" for i in range(9)))
    assert graph.dense_clusters(chain, graph.components(chain), 2).first()["density"] == pytest.approx(0.2)


def test_modularity(spark):
    e = edges(spark, "a>b b>a")
    one = spark.createDataFrame([("a", 1), ("b", 1)], "node string, community int")
    split = spark.createDataFrame([("a", 1), ("b", 2)], "node string, community int")
    assert graph.modularity(e, one).first()[0] == pytest.approx(0.5)
    assert graph.modularity(e, split).first()[0] == 0.0


def test_betweenness(spark):
    b = {r.node: r.centrality for r in graph.betweenness(edges(spark, "a>b b>c")).collect()}
    assert b == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_articulation_points(spark):
    e = edges(spark, "a1>a2 a2>a1 b1>b2 b2>b1 a1>x x>b1")
    assert sorted(r.node for r in graph.articulation_points(e, graph.components(e)).collect()) == ["a1", "b1", "x"]


def brute_labels(pairs, rounds=100):
    order = []
    for a, b in pairs:
        order += [x for x in (a, b) if x not in order]
    label = {x: i for i, x in enumerate(order)}
    for _ in range(rounds):
        changed = False
        for v in order:
            near = [label[b] for a, b in pairs if a == v] + [label[a] for a, b in pairs if b == v]
            best = min(set(near), key=lambda x: (-near.count(x), x))
            changed, label[v] = changed or best != label[v], best
        if not changed:
            break
    groups = {}
    for x, y in label.items():
        groups.setdefault(y, set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_label_propagation(spark):
    text = "a>b b>c c>a c>d d>e e>f f>d x>y"
    e = edges(spark, text)
    groups = {}
    for r in graph.label_propagation(e, graph.components(e)).collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == brute_labels([tuple(x.split(">")) for x in text.split()])


def test_money_trace_and_destinations(spark):
    rows = [(0, "a", "b", "DonatedTo", 900.0), (1, "a", "b", "DonatedTo", 1000.0), (2, "b", "c", "LobbiedFor", 500.0), (3, "b", "d", "HoldsPosition", 5.0)]
    e = spark.createDataFrame(rows, "seq bigint, src string, dst string, rel_type string, amount double")
    t = flows.money_trace(e, "a")
    assert sorted((">".join(r.hops), r.total_amount) for r in t.collect()) == [("a>b", 1000.0), ("a>b", 1000.0), ("a>b>c", 1500.0), ("a>b>c", 1500.0)]
    p = spark.createDataFrame([(["a", "b"], 100.0), (["a", "b", "c"], 250.0), (["a", "c"], 150.0)], "hops array<string>, total_amount double")
    assert {r.destination: r.total for r in flows.flow_destinations(p).collect()} == {"b": 100.0, "c": 400.0}


def test_flow_chain(spark):
    rows = [(1, "a", "b", 50.0, "2024-01-01"), (2, "b", "c", 75.0, "2024-01-15"), (3, "c", "d", 80.0, "2024-01-25")]
    f = spark.createDataFrame(rows, "flow_id bigint, donor string, recipient string, amount double, date string").selectExpr("flow_id", "donor", "recipient", "amount", "date(date) AS date")
    got = flows.flow_chains(f, 20, 3).collect()
    assert [(r.path, r.n, r.total) for r in got] == [("a->b->c->d", 3, 205.0)]
    assert flows.flow_chains(f, 5, 2).count() == 0


def test_exports(spark):
    e = edges(spark, "a>b")
    dot = [r.line for r in export.dot_lines(e).orderBy("line_no").collect()]
    assert dot == ["digraph {", '    "a";', '    "b";', '    "a" -> "b" [label="DonatedTo"];', "}"]
    xml = [r.line for r in export.graphml_lines(e).orderBy("line_no").collect()]
    assert xml[-5:] == ['    <edge id="e0" source="a" target="b">', '      <data key="relationship">DonatedTo</data>', "    </edge>", "  </graph>", "</graphml>"]
    assert sum("<node" in x for x in xml) == 2


def test_long_paths_are_found(spark):
    e = edges(spark, " ".join(f"{i:03d}>{i + 1:03d}" for i in range(110)))
    assert graph.shortest_path(e, "000", "110").first()["length"] == 110


def test_long_chains_are_found(spark):
    rows = [(i, f"n{i:02d}", f"n{i + 1:02d}", 1.0, f"2024-03-{1 + i // 4:02d}") for i in range(60)]
    f = spark.createDataFrame(rows, "flow_id bigint, donor string, recipient string, amount double, date string").selectExpr("flow_id", "donor", "recipient", "amount", "date(date) AS date")
    got = flows.flow_chains(f, 5, 59).collect()
    assert sorted((r.n, r.total) for r in got) == [(59, 59.0), (60, 60.0)]


def test_betweenness_by_joins(spark):
    import random

    r = random.Random(3)
    e = edges(spark, " ".join(f"{a}>{b}" for a, b in ((r.choice("abcdefghijk"), r.choice("abcdefghijk")) for _ in range(30))))
    want = {x.node: x.centrality for x in graph.betweenness(e).collect()}
    assert max(want.values()) > 0
    for got in (graph.betweenness(e, largest=0), graph._normed(e, graph._dependencies_by_joins(e, states=40))):
        assert {x.node: x.centrality for x in got.collect()} == pytest.approx(want)


def test_label_propagation_in_rounds(spark):
    e = edges(spark, "a>b b>c c>a c>d d>e e>f f>d x>y y>z z>x")
    groups = {}
    for r in graph.label_propagation_in_rounds(e).collect():
        groups.setdefault(r.label, set()).add(r.node)
    assert {"x", "y", "z"} in groups.values() and len(groups) >= 2
