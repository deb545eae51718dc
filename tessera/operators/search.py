"""Inverted index and BM25 search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
TOKEN = "([A-Za-z_][A-Za-z0-9_]+)"
# Stop words of the index.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that", "into", "onto", "self", "true", "false", "none", "null", "return", "import", "export",
    "function", "class", "const", "let", "var", "def", "type", "interface", "extends", "implements", "public", "private", "protected", "static",
    "async", "await", "yield", "new", "delete", "typeof", "instanceof", "in", "of", "void", "throw", "try", "catch", "finally", "if", "else", "elif",
    "while", "do", "switch", "case", "break", "continue", "pass", "raise", "as",
)


def whole_tokens(text: Column | str) -> Column:
    """Lower-case identifiers of a text in order, without stop words and single letters."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(TOKEN), F.lit(1))
    return F.filter(F.transform(found, F.lower), lambda t: ~t.isin(*STOP_WORDS) & (F.length(t) > 1))


def sub_tokens(tokens: Column) -> Column:
    """Runs of letters and runs of digits inside the tokens, where they are not the token itself. Only tokens with a
    digit or an underscore have any, so only those are searched."""
    parts = F.transform(
        F.filter(tokens, lambda t: t.rlike("[0-9_]")),
        lambda t: F.filter(
            F.regexp_extract_all(t, F.lit("([a-z]+|[0-9]+)"), F.lit(1)), lambda s: (s != t) & (F.length(s) > 1) & ~s.isin(*STOP_WORDS)
        ),
    )
    return F.flatten(parts)


def question_terms(question: str) -> list[str]:
    """The distinct terms of one question on the driver: whole tokens, then sub-tokens."""
    whole = [t for t in (m.lower() for m in re.findall(TOKEN, question)) if t not in STOP_WORDS and len(t) > 1]
    parts = [p for t in whole if re.search("[0-9_]", t) for p in re.findall("[a-z]+|[0-9]+", t) if p != t and len(p) > 1 and p not in STOP_WORDS]
    return list(dict.fromkeys(whole + parts))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, length``: term frequencies with sub-tokens; ``length`` counts whole tokens only, at least one.

    Counting happens inside a row, so building the index needs no shuffle. A null text has no terms.
    """
    tokens = docs.select(key, whole_tokens(text).alias("tokens"))
    counted = tokens.select(key, F.greatest(F.size("tokens"), F.lit(1)).alias("length"), F.concat("tokens", sub_tokens(F.col("tokens"))).alias("terms"))
    return counted.select(key, "length", F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def lengths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.greatest(F.size(whole_tokens(text)), F.lit(1)).alias("length"))


def collection_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row: number of documents (at least 1) and average length (at least 1)."""
    return lengths(docs, key, text).agg(
        F.greatest(F.count("*"), F.lit(1)).alias("n_docs"), F.greatest(F.coalesce(F.avg("length"), F.lit(1.0)), F.lit(1.0)).alias("avgdl")
    )


def top_per_query(scores: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` best per query with ``rank`` from 1; ties go to the lower key."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def symbol_texts(symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """What a symbol is searched by: its qualified name in words, name, signature, docstring and alias words."""
    text = F.concat_ws(" ", F.translate("qname", ".", " "), "name", F.coalesce("signature", F.lit("")), F.coalesce("docstring", F.lit("")), F.coalesce("alias", F.lit("")))
    return symbols.join(aliases, "qname", "left").withColumn("text", text).drop("alias")
