"""Graphs as text: compact tables, DOT, JSON lines and a page of HTML."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import inventory


def compact(df: DataFrame) -> DataFrame:
    """(line): the rows as cells between tabs, null as nothing."""
    return df.select(F.array_join(F.array(*[text.escape_cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]), "\t").alias("line"))


def from_compact(lines: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.split("line", "\t")
    return lines.select(*[text.unescape_cell(F.get(cells, k)).alias(c) for k, c in enumerate(columns)])


def dot(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): nodes, then edges, with names in quotes; unbound edges dashed."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    named = symbols.select("id", "qualified_name").where("qualified_name <> ''")
    nodes = named.select("qualified_name").distinct().select(F.lit(0).alias("part"), F.concat(F.lit("  "), quote(F.col("qualified_name")), F.lit(";")).alias("line"))
    e = edges.join(named.select(F.col("id").alias("src"), F.col("qualified_name").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("qualified_name").alias("b")), "dst", "left")
    name = F.coalesce("b", "dst_name") if "dst_name" in edges.columns else F.col("b")
    lines = e.withColumn("to", name).where("`to` is not null and `to` <> ''")
    style = F.when(F.col("b").isNull(), " [style=dashed];").otherwise(";")
    return nodes.unionByName(lines.select(F.lit(1).alias("part"), F.concat(F.lit("  "), quote(F.col("a")), F.lit(" -> "), quote(F.col("to")), style).alias("line")))


def json_lines(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): a record for the graph, for every symbol and edge, and for the end."""
    s = symbols.select(F.to_json(F.struct(F.lit("symbol").alias("type"), "id", "qualified_name", "kind")).alias("value"))
    e = edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), "src", "dst")).alias("value"))
    spark = symbols.sparkSession
    frame = spark.createDataFrame([('{"type":"graph_meta"}',), ('{"type":"graph_done"}',)], "value string")
    return frame.unionByName(s).unionByName(e)


def graph_rows(symbols: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The symbols and edges to export: all, or those of a focus subgraph, nodes(id) with the edges that touch any of them."""
    if nodes is None:
        return symbols, edges
    n = nodes.select("id").distinct()
    touching = edges.join(n.select(F.col("id").alias("src")), "src", "left_semi").unionByName(edges.join(n.select(F.col("id").alias("dst")), "dst", "left_semi").join(n.select(F.col("id").alias("src")), "src", "left_anti").select(*edges.columns))
    return symbols.join(n, "id", "left_semi"), touching


def graph_json(symbols: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, after: int | None = None, limit: int | None = None) -> DataFrame:
    """(value) of one row: {symbols, edges, next} of a whole graph that the caller knows to be small, of a focus subgraph, or of a page of ``limit`` symbols by id behind ``after`` with the edges from them.

    next is the id to go on behind, null at the end. Of anything large, ``json_lines`` gives a record a row.
    """
    s, e = graph_rows(symbols, edges, nodes)
    if limit is not None:
        s = inventory.keyset_page(s, ["id"], None if after is None else (after,), limit)
        e = e.join(s.select(F.col("id").alias("src")), "src", "left_semi")
    columns = [c for c in ("id", "qualified_name", "kind", "name", "file_id", "start_line", "end_line") if c in s.columns]
    of = s.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("symbols"), F.max("id").alias("last"), F.count("*").alias("n"))
    to = e.agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    following = F.when(F.col("n") == F.lit(limit if limit is not None else -1), F.col("last"))
    return of.join(F.broadcast(to)).select(F.to_json(F.struct("symbols", "edges", following.alias("next"))).alias("value"))


_DRAWING = """
const box = document.getElementById('g'), w = box.width, h = box.height, c = box.getContext('2d'), at = new Map();
graph.nodes.forEach((n, k) => { n.x = w / 2 + 200 * Math.cos(k); n.y = h / 2 + 200 * Math.sin(k); n.u = n.v = 0; at.set(n.id, n); });
const links = graph.links.map(l => [at.get(l.src), at.get(l.dst)]).filter(l => l[0] && l[1]);
function step() {
  const cell = 60, grid = new Map(), key = (x, y) => Math.floor(x / cell) + ',' + Math.floor(y / cell);
  for (const n of graph.nodes) { const k = key(n.x, n.y); if (!grid.has(k)) grid.set(k, []); grid.get(k).push(n); }
  for (const n of graph.nodes) {
    n.u += (w / 2 - n.x) * 0.002; n.v += (h / 2 - n.y) * 0.002;
    for (let i = -1; i < 2; i++) for (let j = -1; j < 2; j++) for (const m of grid.get(key(n.x + i * cell, n.y + j * cell)) || []) {
      const x = n.x - m.x, y = n.y - m.y, d = x * x + y * y + 0.01; if (m !== n && d < cell * cell) { n.u += 40 * x / d; n.v += 40 * y / d; }
    }
  }
  for (const [a, b] of links) { const x = b.x - a.x, y = b.y - a.y, d = Math.hypot(x, y) || 1, f = (d - 60) * 0.01 / d; a.u += x * f; a.v += y * f; b.u -= x * f; b.v -= y * f; }
  c.clearRect(0, 0, w, h); c.strokeStyle = '#bbb';
  for (const n of graph.nodes) { n.u *= 0.85; n.v *= 0.85; n.x += n.u; n.y += n.v; }
  for (const [a, b] of links) { c.beginPath(); c.moveTo(a.x, a.y); c.lineTo(b.x, b.y); c.stroke(); }
  for (const n of graph.nodes) { c.fillStyle = n.kind === 'class' ? '#c60' : '#06c'; c.beginPath(); c.arc(n.x, n.y, 4, 0, 7); c.fill(); c.fillStyle = '#333'; c.fillText(n.qualified_name, n.x + 6, n.y + 3); }
  requestAnimationFrame(step);
}
step();
"""


def html(symbols: DataFrame, edges: DataFrame, limit: int = 500) -> str:
    """A page that draws the nodes and the edges between them, laid out by forces, for a bounded subgraph; it loads nothing from elsewhere."""
    columns = [c for c in ("id", "qualified_name", "kind") if c in symbols.columns]
    nodes = symbols.orderBy("id").limit(limit)
    kept = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct().limit(20 * limit)
    data = json.dumps({"nodes": [r.asDict() for r in nodes.select(*columns).collect()], "links": [r.asDict() for r in kept.collect()]}).replace("</", "<\\/")
    return f"<!DOCTYPE html><meta charset=utf-8><title>graph</title><canvas id=g width=1400 height=900></canvas><script>const graph = {data};{_DRAWING}</script>"
