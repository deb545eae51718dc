"""Writers: graph payloads, database rows, reports and a static page."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from itertools import groupby, islice
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graph import export_rows


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as JSON lines, one folder each, written by all tasks; edges are laid out by type."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").json(f"{folder}/edges")


def graph_payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same as rows of JSON text: ``part, payload``."""
    return nodes.select(F.lit("node").alias("part"), F.to_json(F.struct(*nodes.columns)).alias("payload")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.to_json(F.struct(*edges.columns)).alias("payload"))
    )


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _rows(figures: DataFrame):
    """Rows of a report in order, brought to the driver a partition at a time."""
    return figures.orderBy("metric", "key").toLocalIterator()


def markdown_report(figures: DataFrame, out: str) -> str:
    """A report of ``metric, key, value`` rows."""
    with Path(out).open("w") as f:
        f.write("# Index report\n\n| metric | key | value |\n|---|---|---|\n")
        for r in _rows(figures):
            f.write(f"| {r['metric']} | {r['key'] or ''} | {r['value']:g} |\n")
    return out


def json_report(figures: DataFrame, out: str) -> str:
    with Path(out).open("w") as f:
        f.write("[")
        for i, r in enumerate(_rows(figures)):
            f.write((",\n " if i else "\n ") + json.dumps(r.asDict(), sort_keys=True, default=str))
        f.write("\n]\n")
    return out


def write_processes(built: DataFrame, steps: DataFrame, folder: str) -> None:
    """Processes with their steps in order, as JSON lines: a process has few steps, so they are put beside it."""
    listed = steps.groupBy("process_id").agg(F.array_sort(F.collect_list(F.struct("step", "src", "dst", "edge_type", "confidence"))).alias("steps"))
    built.join(listed, "process_id", "left").write.mode("overwrite").json(f"{folder}/processes")


EDGE_FIELDS = ("src_qname", "dst_qname", "dst_name", "edge_type", "confidence", "extraction_source", "line")
EDGE_MORE = {"col_no": None, "precision_level": 1, "reason": "", "metadata_json": "{}", "created_at": None}
EDGE_SCHEMA = (
    "src_qname string, dst_qname string, dst_name string, edge_type string, confidence double, extraction_source string, line int, col_no int, precision_level int, "
    "reason string, metadata_json string, created_at timestamp"
)


def edge_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Edges from tuples of 7 or 12 fields; what the short ones lack gets its default."""
    full = []
    for r in rows:
        if len(r) not in (7, 12):
            raise ValueError(f"an edge has 7 or 12 fields, not {len(r)}")
        full.append(tuple(r) if len(r) == 12 else (*r, *EDGE_MORE.values()))
    return spark.createDataFrame(full, EDGE_SCHEMA)


def batches(rows: Iterator, size: int = 500) -> Iterator[list]:
    """Lists of at most ``size`` rows."""
    it = iter(rows)
    while part := list(islice(it, size)):
        yield part


NODE_QUERY = "UNWIND $rows AS row MERGE (n:IndexedNode {{id: row.id}}) SET n += row.props SET n:`{label}`"
EDGE_QUERY = "UNWIND $rows AS row MATCH (a:IndexedNode {{id: row.source}}), (b:IndexedNode {{id: row.target}}) MERGE (a)-[r:`{type}` {{id: row.id}}]->(b) SET r += row.props"


def label_of(kind: str | None) -> str:
    """A label that graph databases accept."""
    return "".join(w.capitalize() for w in re.findall(r"[A-Za-z0-9]+", kind or "")) or "Node"


def push_graph(symbols: DataFrame, edges: DataFrame, connect: Callable[[], object], max_batch: int = 500) -> DataFrame:
    """Merge nodes, then edges into a graph database, partition by partition, in batches of one label or type.

    ``connect`` opens a session with ``run(query, rows=...)`` and ``close()`` on the worker, so nothing passes through the
    driver. Edges of which an end is no symbol are left out. Merging is idempotent, so a task may run again. The result
    has ``part, sent`` and is complete when this returns.
    """
    nodes = symbols.select(F.concat(F.lit("symbol:"), "qname").alias("id"), "kind", "name", "qname")
    kept = export_rows(edges.where("dst is not null"), symbols).where("kept").select(F.col("edge_id").cast("string").alias("id"), "source", "target", "rel_type")

    def send(rows: Iterator, key: str, query: str, fields: tuple[str, ...], name: Callable) -> Iterator[int]:
        session, sent = connect(), 0
        try:
            for label, group in groupby(rows, key=lambda r: r[key]):
                for part in batches(group, max_batch):
                    told = [{f: r[f] for f in fields} | {"props": {k: v for k, v in r.items() if k not in fields}} for r in part]
                    session.run(query.format(label=name(label), type=label), rows=told)
                    sent += len(part)
        finally:
            session.close()
        yield sent

    def run(part: str, frame: DataFrame, key: str, query: str, fields: tuple[str, ...], name: Callable) -> DataFrame:
        def task(frames):
            rows = (r for f in frames for r in f.to_dict("records"))
            for n in send(rows, key, query, fields, name):
                yield pd.DataFrame({"part": [part], "sent": [n]})

        counted = frame.sortWithinPartitions(key).mapInPandas(task, "part string, sent long")
        return counted.groupBy("part").agg(F.sum("sent").alias("sent"))

    first = run("nodes", nodes, "kind", NODE_QUERY, ("id",), label_of).collect()
    second = run("edges", kept, "rel_type", EDGE_QUERY, ("id", "source", "target"), str).collect()
    return symbols.sparkSession.createDataFrame([tuple(r) for r in first + second], "part string, sent long")


def write_bundle(parts: dict[str, Callable[[], object]], out: str) -> list[dict]:
    """Run the makers of several artefacts; one that fails is recorded in ``manifest.json`` and does not stop the others."""
    told = []
    for name, make in parts.items():
        try:
            made = make()
            told.append({"artifact": name, "ok": True, "path": str(made) if made is not None else ""})
        except Exception as e:  # noqa: BLE001
            told.append({"artifact": name, "ok": False, "error": f"{type(e).__name__}: {e}"[:500]})
    Path(out).mkdir(parents=True, exist_ok=True)
    Path(out, "manifest.json").write_text(json.dumps(told, indent=1))
    return told


def answer(prompt: str, ask: Callable[[str], str] | None = None) -> str:
    """What a language model says to a pack; without one, or if it fails, the pack itself."""
    if ask is None:
        return prompt
    try:
        return ask(prompt)
    except Exception:  # noqa: BLE001
        return prompt


def html_page(nodes: DataFrame, edges: DataFrame, out: str, title: str = "Code graph") -> str:
    """A page that lists all nodes with their edges; it is written line by line, so only one node is held at a time."""
    known = nodes.select(F.col("qname").alias("src"))
    inner = edges.join(known, "src", "left_semi").join(known.withColumnRenamed("src", "dst"), "dst", "left_semi")
    listed = inner.groupBy("src").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "edge_type", "dst"))).alias("to"))
    rows = nodes.join(listed, nodes["qname"] == listed["src"], "left").orderBy("qname").select("qname", "kind", "to")
    with Path(out).open("w") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>")
        for r in rows.toLocalIterator():
            f.write(f"<li id='{html.escape(r['qname'])}'><b>{html.escape(r['kind'] or '')}</b> {html.escape(r['qname'])}<br>{html.escape('; '.join(r['to'] or []))}</li>\n")
        f.write("</ul>")
    return out
