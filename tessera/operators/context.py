"""Context for a question: seeds from several lists, graph expansion, reranking, a pack with snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tessera.operators import retrieval, vectors
from tessera.operators.postings import StoredIndex
from tessera.session import cut_lineage

# Mode of each intent.
MODE_OF = {
    "impact_analysis": "impact", "bug_fix": "debug", "feature_implementation": "feature", "refactor": "refactor", "test_generation": "test", "security_review": "security",
    "api_usage": "explain", "onboarding": "onboarding", "architecture_explanation": "explain", "explain": "explain",
}
DEEP = ("impact", "feature", "edit", "refactor")
SNIPPET_LINES = 60


def intent_of(question: str) -> str:
    q = question.lower()
    return next((name for name, needles in retrieval.INTENTS if any(n in q for n in needles)), "explain")


def ranked_lists(symbols: DataFrame, files: DataFrame, index: StoredIndex, question: str, pinned: list[str], embedded: DataFrame | None) -> DataFrame:
    """``source, qname, rank`` (from 0) of the lexical, vector, identifier, path and pinned hits, at most 25 each.

    ``index`` is the stored index of the symbols, ``embedded`` their vectors by the hash embedder (``symbol_id,
    embedding``); without it there is no vector list.
    """
    spark = symbols.sparkSession
    names = symbols.select("symbol_id", "qname")
    lexical = index.ask(question).join(names, "symbol_id").select("qname", F.round("score", 9).alias("score"))
    parts = [("bm25", lexical)]
    if embedded is not None:
        query = spark.createDataFrame([(0, vectors.embed_text(question))], "query_id long, embedding array<float>")
        parts.append(("vector", vectors.top_k(embedded, "symbol_id", "embedding", query, 25).join(names, "symbol_id").select("qname", "score")))
    named = retrieval.identifier_hits(symbols, retrieval.query_terms(question))
    parts.append(("identifier", named.withColumn("score", F.lit(1.0))))
    for source, paths in (("path", re.findall(r"[\w./\-]+\.[A-Za-z]{1,5}", question)), ("pinned", pinned)):
        if paths:
            hit = symbols.join(files.where(F.col("path").isin(*paths)).select("file_id"), "file_id").select("qname", F.lit(1.0).alias("score"))
            parts.append((source, hit))
    lists = None
    for source, part in parts:
        rank = (F.row_number().over(Window.orderBy(F.desc("score"), "qname")) - 1).alias("rank")  # at most 25 rows
        rows = part.orderBy(F.desc("score"), "qname").limit(25).select(F.lit(source).alias("source"), "qname", rank)
        lists = rows if lists is None else lists.unionByName(rows)
    return lists


def candidates(
    symbols: DataFrame, files: DataFrame, edges: DataFrame, index: StoredIndex, question: str, mode: str, pinned: list[str] | None = None, embedded: DataFrame | None = None
) -> DataFrame:
    """Seeds and what the graph reaches from them, with all channels and ``final``."""
    pinned = pinned or []
    lists = cut_lineage(ranked_lists(symbols, files, index, question, pinned, embedded))
    seeds = cut_lineage(retrieval.rrf(lists))
    best = seeds.agg(F.max("rrf").alias("m"))
    norm = seeds.crossJoin(F.broadcast(best)).select("qname", (F.col("rrf") / F.col("m")).alias("norm"), "sources")
    reached = retrieval.expand(norm, edges, symbols, mode, 2 if mode in DEEP else 1)
    facts = symbols.join(files.select("file_id", "path"), "file_id", "left").select("qname", "name", "kind", "path", "signature", "start_line", "end_line")
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    joined = reached.join(norm, "qname", "left").join(facts, "qname").withColumn("sources", sources)
    for channel in ("bm25", "vector"):
        joined = joined.withColumn(channel, F.when(F.array_contains("sources", channel), F.col("norm")).otherwise(0.0))
    terms = retrieval.query_terms(question)
    scored = retrieval.rerank(joined, terms, mode)
    if pinned:
        scored = co_location(scored, terms)
    return cut_lineage(scored)


def best(scored: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best candidates with their ``rank`` from 1."""
    top = scored.orderBy(F.desc(F.round("final", 9)), "qname").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("final", 9)), "qname")))  # at most ``limit`` rows


def co_location(scored: DataFrame, terms: list[str]) -> DataFrame:
    """Candidates that are no seeds gain a fifth of the strongest signal of a seed in their file (tests give none)."""
    signal = F.greatest("bm25", "vector", retrieval.overlap(terms))
    strong = scored.where((F.col("distance") == 0) & (F.col("kind") != "test") & F.col("path").isNotNull()).groupBy("path").agg(F.max(signal).alias("beside"))
    gain = F.when((F.col("distance") > 0) & (F.col("beside") > 0), 0.20 * F.col("beside")).otherwise(0.0)
    told = F.when(gain > 0, F.concat("sources", F.array(F.lit("co_location")))).otherwise(F.col("sources"))
    return scored.join(strong, "path", "left").withColumns({"final": F.col("final") + gain, "sources": told}).drop("beside")


def card() -> Column:
    """The text that stands for a symbol in a pack."""
    return F.concat_ws("\n", F.concat_ws(" ", "kind", "qname"), F.concat(F.lit("file: "), "path"), F.nullif("signature", F.lit("")))


def looks_like_test() -> Column:
    path = F.concat(F.lit("/"), F.lower(F.coalesce("path", F.lit(""))), F.lit("/"))
    return (F.col("kind") == "test") | F.col("name").startswith("test") | path.rlike("/(tests?|__tests__)/|fixture")


def capsules(candidates: DataFrame, mode: str, budget: int) -> DataFrame:
    """The capsules that fit: ``qname, rank, tokens, path, body, reason`` and the lines of the symbol."""
    pinned = F.array_contains("sources", "pinned")
    rows = candidates.where(~looks_like_test() | pinned) if retrieval.CAPS[mode][3] else candidates
    seeded = F.arrays_overlap("sources", F.array(*map(F.lit, ("bm25", "vector", "identifier", "pinned"))))
    listed = rows.select("qname", "path", "final", retrieval.estimate_tokens(card()).cast("int").alias("tokens"), seeded.alias("seeded"), pinned.alias("pinned"))
    facts = candidates.select("qname", "path", "kind", "name", "start_line", "end_line", "sources", card().alias("body"), inclusion_reason(mode).alias("reason"))
    return retrieval.pack(listed, mode, budget).join(facts, "qname").orderBy("rank")


def inclusion_reason(mode: str) -> Column:
    """Why a candidate is in the pack, as text."""
    source = F.when(F.size("sources") > 0, F.array_join("sources", ", ")).otherwise("graph")
    how = F.when(F.col("distance") == 0, F.concat(F.lit("Seed match via "), source)).otherwise(F.format_string("%d-hop neighbor: %s", "distance", "qname"))
    return F.concat_ws("  ·  ", how, F.format_string("score=%.3f", "final"), F.lit(f"mode={mode}"))


def fallback_card() -> Column:
    """The card of a symbol for which no capsule was made."""
    place = F.format_string("- File: `%s:%d-%d`", F.coalesce("path", F.lit("")), F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)))
    told = F.when(F.coalesce("signature", F.lit("")) != "", F.concat(F.lit("- Signature: `"), "signature", F.lit("`")))
    return F.concat_ws("\n", F.concat(F.lit("### "), F.initcap("kind"), F.lit(": "), "qname"), place, told)


def truncated(text: Column | str, tokens: Column | int) -> Column:
    """A text cut to a number of tokens, marked where it was cut; the cut is never inside what follows the mark."""
    c = F.col(text) if isinstance(text, str) else text
    n = F.lit(tokens) if isinstance(tokens, int) else tokens
    return F.when(retrieval.estimate_tokens(c) > n, F.concat(F.rtrim(F.substring(c, F.lit(1), (n * 4).cast("int"))), F.lit("\n[truncated]"))).otherwise(c)


#: shares of the budget for the map, the capsules and the source, by mode
SHARES = {
    "edit": (0.08, 0.40, 0.50), "feature": (0.08, 0.40, 0.50), "debug": (0.08, 0.40, 0.50), "refactor": (0.08, 0.40, 0.50), "test": (0.08, 0.42, 0.48),
    "impact": (0.10, 0.50, 0.40), "explain": (0.10, 0.50, 0.40), "onboarding": (0.10, 0.50, 0.40), "security": (0.10, 0.45, 0.45),
}


def mode_of(mode: str | None, question: str) -> str:
    """A given mode, or the one of the question's intent; names of intents stand for their mode, others are an error."""
    if mode is None:
        return MODE_OF[intent_of(question)]
    asked = mode.strip().lower()
    if asked in SHARES:
        return asked
    if asked in MODE_OF:
        return MODE_OF[asked]
    raise ValueError(f"no such mode: {mode}")


def snippets(candidates: DataFrame, files_with_content: DataFrame, mode: str, budget: int) -> DataFrame:
    """Source of the best candidates: ``qname, path, rank, tokens, snippet``, at most ``SNIPPET_LINES`` numbered lines each."""
    most = 8 if mode in ("edit", "feature", "debug", "refactor", "test", "impact") else 0 if mode == "security" else 2
    best = candidates.orderBy(F.desc(F.round("final", 9)), "qname").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("final", 9)), "qname"))  # at most 8 rows
    rows = best.withColumn("rank", rank).join(files_with_content.select("path", "content"), "path")
    lines = F.split("content", "\r?\n")
    first = F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))
    n = F.least(F.greatest(F.coalesce("end_line", first), first) - first + 1, F.lit(SNIPPET_LINES), F.size(lines) - first + 1)
    width = F.length((first + n - 1).cast("string"))
    numbered = F.transform(F.slice(lines, first, F.greatest(n, F.lit(0))), lambda line, i: F.concat(F.lpad((i + first).cast("string"), width, F.lit(" ")), F.lit("  "), line))
    made = rows.select("qname", "path", "rank", F.array_join(numbered, "\n").alias("snippet")).where("snippet != ''")
    room = int(budget * SHARES[mode][2])
    spent = F.sum(retrieval.estimate_tokens("snippet")).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))  # at most 8 rows
    left = F.greatest(F.lit(200), F.lit(room) - F.coalesce(spent, F.lit(0)))
    cut = made.withColumn("before", F.coalesce(spent, F.lit(0))).withColumn("snippet", truncated("snippet", left)).where((F.col("before") < room) | (F.col("rank") == 1))
    return cut.select("qname", "path", "rank", retrieval.estimate_tokens("snippet").alias("tokens"), "snippet")


def edit_files(packed: list[Row], mode: str) -> list[str]:
    """Files of the capsules in rank order, eight at most; none where the mode needs no source."""
    return list(dict.fromkeys(r["path"] for r in packed if r["path"]))[:8] if mode != "security" else []


def test_files(packed: list[Row]) -> list[str]:
    return list(dict.fromkeys(r["path"] for r in packed if r["path"] and (r["kind"] == "test" or (r["name"] or "").startswith("test_"))))[:6]


def audit(lists: DataFrame, candidates: DataFrame) -> DataFrame:
    """``stage, n``: hits of each list, seeds and candidates."""
    per_list = lists.groupBy(F.concat(F.lit("seeds."), "source").alias("stage")).agg(F.count("*").alias("n"))
    fused = lists.agg(F.least(F.count_distinct("qname"), F.lit(retrieval.SEEDS)).alias("n")).select(F.lit("seeds.fused").alias("stage"), F.col("n").cast("long").alias("n"))
    reached = candidates.agg(F.count("*").alias("n")).select(F.lit("expanded_candidates").alias("stage"), "n")
    return per_list.unionByName(fused).unionByName(reached)


def prompt(question: str, intent: str, mode: str, repo_map: list[str], packed: list[Row], source: list[Row], edits: list[str], tests: list[str]) -> str:
    """The pack as one text for a reader."""
    parts = ["# Context pack", "", f"## User task\n{question}", "", f"## Retrieval intent\n{intent}", f"## Mode\n{mode}"]
    for title, listed in (("Repo map", repo_map), ("Files likely to edit", [f"`{p}`" for p in edits]), ("Related tests", [f"`{p}`" for p in tests])):
        if listed:
            parts += ["", f"## {title}", *[f"- {x}" for x in listed]]
    for r in packed:
        place = f" — `{r['path']}:{r['start_line']}-{r['end_line']}`" if r["path"] else ""
        parts += ["", f"## Capsule: {r['qname']}{place}", r["body"], f"_{r['reason']}_"]
    for r in source:
        parts += ["", f"## Source: {r['qname']} — `{r['path']}`", f"```\n{r['snippet']}\n```"]
    return "\n".join(parts)


def edit_plan(candidates: DataFrame, question: str) -> DataFrame:
    """``path, score, role, reason, place``: files of the candidates as ``edit``, ``read`` or ``test``, six at most of each.

    A file is edited if a candidate in it scores .45, or .38 with its name in the task; ``reason`` tells what spoke for it.
    """
    overlap = retrieval.overlap(retrieval.query_terms(question))
    role = F.when(looks_like_test(), "test").when((F.col("final") >= 0.45) | ((F.col("final") >= 0.38) & (overlap >= 0.25)), "edit").otherwise("read")
    rows = candidates.where("path is not null").withColumns({"_role": role, "_reason": F.when(role == "edit", edit_reason(overlap)).otherwise(read_reason())})
    order = F.struct(F.when(F.col("_role") == "edit", 0).when(F.col("_role") == "test", 1).otherwise(2).alias("r"), (-F.round("final", 9)).alias("f"), "qname")
    per_file = rows.groupBy("path").agg(F.max("final").alias("score"), F.min_by(F.struct("_role", "_reason"), order).alias("best"))
    named = per_file.select("path", F.round("score", 6).alias("score"), F.col("best._role").alias("role"), F.col("best._reason").alias("reason"))
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("score"), "path"))
    return named.withColumn("place", place).where("place <= 6")


def edit_reason(overlap: Column) -> Column:
    said = [
        F.when(F.col("bm25") > 0.5, "strong lexical match"), F.when(F.col("vector") > 0.5, "strong semantic match"), F.when(overlap > 0.3, "name overlaps with task"),
        F.when(F.col("graph") > 0.3, "close in call graph"),
    ]
    bits = F.array_compact(F.array(*said))
    return F.format_string("Likely-edit: %s (score %.2f)", F.when(F.size(bits) > 0, F.array_join(bits, "; ")).otherwise("retrieved by hybrid pipeline"), "final")


def read_reason() -> Column:
    return F.format_string("Read-only support — reached via %s (score %.2f)", F.when(F.size("sources") > 0, F.array_join("sources", ",")).otherwise("graph"), "final")
