"""Graph exports: attribute tables, GraphML and XGMML text, a style sheet, layouts."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalnet.functions.scores import colour_step, edge_weight, edge_width


def export_edges(summary: DataFrame) -> DataFrame:
    """Kept edges with source, target, arrows, width, colour step; a directed edge runs source to target."""
    back = F.col("ort_inferred") == -2
    return summary.where("ort_inferred <> 0").select(
        F.when(back, F.col("y")).otherwise(F.col("x")).alias("source"),
        F.when(back, F.col("x")).otherwise(F.col("y")).alias("target"),
        F.when(F.abs("ort_inferred") == 2, "directed").when(F.col("ort_inferred") == 6, "bidirected").otherwise("undirected").alias("kind"),
        F.when(F.abs("ort_inferred") == 2, 6).when(F.col("ort_inferred") == 6, 6).otherwise(0).alias("target_arrow"),
        F.when(F.col("ort_inferred") == 6, 6).otherwise(0).alias("source_arrow"),
        edge_width(F.col("info_shifted")).alias("width"),
        edge_weight(F.col("info_shifted")).alias("weight"),
        colour_step(F.col("partial_correlation")).alias("colour_step"),
        F.concat(F.when(back, F.col("y")).otherwise(F.col("x")), F.when(F.abs("ort_inferred") == 2, "-->").when(F.col("ort_inferred") == 6, "<->").otherwise("---"), F.when(back, F.col("x")).otherwise(F.col("y"))).alias("label"),
    )


def export_nodes(summary: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Every node with its degree; ``variables`` (name, group, colour) adds isolated nodes and attributes."""
    kept = summary.where("ort_inferred <> 0")
    degree = kept.select(F.explode(F.array("x", "y")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))
    if variables is None:
        return degree
    return variables.join(degree, "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def graphml_lines(summary: DataFrame, nodes: Sequence[str]) -> list[str]:
    """The document's lines; an edge table is bounded by the number of variable pairs."""
    rows = export_edges(summary).orderBy("source", "target").collect()
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    for key, where, kind in (("label", "edge", "string"), ("weight", "edge", "double"), ("width", "edge", "double"), ("sourceArrow", "edge", "int"), ("targetArrow", "edge", "int"), ("name", "node", "string")):
        out.append(f'<key id="{key}" for="{where}" attr.name="{key}" attr.type="{kind}"/>')
    out.append('<graph edgedefault="directed">')
    out += [f"<node id={quoteattr(n)}><data key=\"name\">{quoteattr(n)[1:-1]}</data></node>" for n in nodes]
    for r in rows:
        data = "".join(f'<data key="{k}">{v}</data>' for k, v in (("label", quoteattr(r["label"])[1:-1]), ("weight", f"{r['weight']:.6f}"), ("width", f"{r['width']:.6f}"), ("sourceArrow", r["source_arrow"]), ("targetArrow", r["target_arrow"])))
        out.append(f"<edge source={quoteattr(r['source'])} target={quoteattr(r['target'])}>{data}</edge>")
    return [*out, "</graph>", "</graphml>"]


def xgmml_lines(summary: DataFrame, layout: dict[str, tuple[float, float]]) -> list[str]:
    """With given places: x is scaled by 10, y by -10; edges are red or blue by sign."""
    rows = export_edges(summary).orderBy("source", "target").collect()
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<graph label="network" xmlns="http://www.cs.rpi.edu/XGMML" directed="1">']
    out += [f'<node id={quoteattr(n)} label={quoteattr(n)}><graphics x="{10 * x:g}" y="{-10 * y:g}"/></node>' for n, (x, y) in layout.items()]
    for r in rows:
        c = r["colour_step"]
        colour = "#808080" if c is None else "#d73027" if c >= 100 else "#4575b4"
        out.append(f'<edge source={quoteattr(r["source"])} target={quoteattr(r["target"])} label={quoteattr(r["label"])}><graphics width="{r["width"]:.6f}" fill="{colour}"/></edge>')
    return [*out, "</graph>"]


def style_lines() -> list[str]:
    """A static visual style: round nodes, widths and arrows from the edges' attributes."""
    props = {"NODE_SHAPE": "ELLIPSE", "NODE_SIZE": "35.0", "NODE_FILL_COLOR": "#E8EEF7", "NODE_LABEL_FONT_SIZE": "12", "EDGE_UNSELECTED_PAINT": "#606060", "EDGE_WIDTH": "2.0"}
    body = [f'<visualProperty name="{k}" default="{v}"/>' for k, v in props.items()]
    maps = [f'<passthroughMapping visualProperty="{p}" attribute="{a}"/>' for p, a in (("EDGE_WIDTH", "width"), ("EDGE_SOURCE_ARROW_SHAPE", "sourceArrow"), ("EDGE_TARGET_ARROW_SHAPE", "targetArrow"), ("NODE_LABEL", "name"))]
    return ['<?xml version="1.0" encoding="UTF-8"?>', '<vizmap id="network">', *body, *maps, "</vizmap>"]


def arrow_code(mark: str | bool | None) -> int:
    return 6 if mark == "arrow" else 15 if mark is True or mark == "TRUE" else 0


def write_lines(lines: Sequence[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def grid_layout(nodes: Sequence[str], orientation: str = "L") -> dict[str, tuple[float, float]]:
    """Lagged nodes on a grid: a row for each variable, a column for each lag, oldest first."""
    import re

    parts = {n: (re.sub(r"_lag\d+$", "", n), int(m[1]) if (m := re.search(r"_lag(\d+)$", n)) else 0) for n in nodes}
    rows = sorted({v for v, _ in parts.values()})
    top = max((k for _, k in parts.values()), default=0)
    place = {n: (float(top - k), float(rows.index(v))) for n, (v, k) in parts.items()}
    return place if orientation == "L" else {n: (y, -x) for n, (x, y) in place.items()}
