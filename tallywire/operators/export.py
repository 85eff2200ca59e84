"""Graphs and reports as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import numbered
from .graph import nodes


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line_no, line): the DOT text of a graph, nodes by name, edges by seq. Lines are rows, so a file of any size can be written."""
    s = lambda c: F.col(c).cast("string")
    n = numbered(nodes(edges), "k", "node").select(F.lit(1).alias("part"), "k", F.format_string('    "%s";', s("node")).alias("line"))
    e = numbered(edges, "k", "seq").select(F.lit(2).alias("part"), "k", F.format_string('    "%s" -> "%s" [label="%s"];', s("src"), s("dst"), F.col("rel_type")).alias("line"))
    ends = edges.sparkSession.createDataFrame([(0, 0, "digraph {"), (3, 0, "}")], "part int, k bigint, line string")
    return _numbered(ends.union(n).union(e))


def graphml_lines(edges: DataFrame) -> DataFrame:
    """(line_no, line): the GraphML text; edges are numbered from e0 by seq."""
    s = lambda c: F.col(c).cast("string")
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/graphml"', '         xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"',
        '         xsi:schemaLocation="http://graphml.graphdrawing.org/graphml http://graphml.graphdrawing.org/graphml/graphml.xsd">',
        '  <key id="relationship" for="edge" attr.name="relationship" attr.type="string"/>', '  <graph id="G" edgedefault="directed">',
    ]
    n = numbered(nodes(edges), "k", "node").select(F.lit(1).alias("part"), "k", F.format_string('    <node id="%s"/>', s("node")).alias("line"))
    three = F.array(F.format_string('    <edge id="e%d" source="%s" target="%s">', F.col("i"), s("src"), s("dst")), F.format_string('      <data key="relationship">%s</data>', F.col("rel_type")), F.lit("    </edge>"))
    e = numbered(edges, "i", "seq").select("i", F.posexplode(three).alias("p", "line")).select(F.lit(2).alias("part"), (F.col("i") * 3 + F.col("p")).alias("k"), "line")
    ends = edges.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "  </graph>"), (3, 1, "</graphml>")], "part int, k bigint, line string")
    return _numbered(ends.union(n).union(e))


def _numbered(lines: DataFrame) -> DataFrame:
    return numbered(lines, "line_no", "part", "k").select("line_no", "line")


def cytoscape(edges: DataFrame) -> DataFrame:
    """(kind, json): one element for each node and edge, as Cytoscape takes them."""
    s = lambda c: F.col(c).cast("string")
    n = nodes(edges).select(F.lit("node").alias("kind"), F.to_json(F.struct(F.struct(s("node").alias("id")).alias("data"))).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.struct(s("src").alias("source"), s("dst").alias("target"), F.col("rel_type").alias("relationship")).alias("data"))).alias("json"))
    return n.unionAll(e)


def correlations_json(correlations: DataFrame) -> DataFrame:
    """(json): one correlation of the envelope's list a row, in order of entity and dates."""
    return correlations.select(F.to_json(F.struct(*correlations.columns), {"ignoreNullFields": "false"}).alias("json"))


def payment_label(amount) -> F.Column:
    """A payment in whole dollars, half to even."""
    return F.concat(F.lit("$"), F.bround(amount.cast("decimal(38,6)"), 0).cast("decimal(38,0)").cast("string"), F.lit(" payment"))


def entity_labels(entities: DataFrame, amount_col: str | None = None) -> DataFrame:
    """(entity_id, label) by type: a payment's label is its amount, all others' their name."""
    label = F.col("name") if amount_col is None else F.when(F.col("entity_type") == "Payment", payment_label(F.col(amount_col))).otherwise(F.col("name"))
    return entities.select("entity_id", label.alias("label"))


def story_parts(entities: DataFrame, relationships: DataFrame, entity: str, cap: int = 500) -> dict[str, DataFrame]:
    """entity, relationships (the newest `cap` each way), timeline and one-step graph of an entity; neighbours that are not stored are left out."""
    from .temporal import timeline

    line = timeline(relationships, entity, cap)
    ends = line.select(F.when(F.col("src") == entity, F.col("dst")).otherwise(F.col("src")).alias("entity_id")).distinct()
    return {
        "entity": entities.filter(F.col("entity_id") == entity), "relationships": line,
        "timeline": line.select("rel_id", "rel_type", "start_date", "end_date", "src", "dst"), "graph": entities.join(ends, "entity_id", "left_semi").select("entity_id", "entity_type", "name"),
    }


def story_package(entities: DataFrame, relationships: DataFrame, entity: str, path: str, cap: int = 500) -> None:
    """The parts of an entity's story, each as JSON below path."""
    for name, part in story_parts(entities, relationships, entity, cap).items():
        part.write.json(f"{path}/{name}")
