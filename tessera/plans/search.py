"""Search queries over documents and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aliases, postings
from tessera.operators import search as s
from tessera.sources import graph
from tessera.sources.tables import spread, table

QUERY = "the session token store fails to resolve a route when the cache is stale"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text"))


def tokenize_postings(spark: SparkSession, d: str) -> DataFrame:
    return s.postings(_documents(spark, d), "doc_id", "text").select("doc_id", "term", "tf")


def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return s.collection_stats(_documents(spark, d), "doc_id", "text").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return s.lengths(_documents(spark, d), "doc_id", "text")


def term_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return document_index(spark, d).terms().select("term", "df")


def document_index(spark: SparkSession, d: str) -> postings.StoredIndex:
    return postings.stored_index(lambda: _documents(spark, d), "doc_id", "text", "documents", [table(spark, d, "documents", "doc_id", "text")])


def symbol_index(spark: SparkSession, d: str) -> postings.StoredIndex:
    sources = [table(spark, d, name) for name in ("symbols", "files", "edges")]
    return postings.stored_index(lambda: symbol_documents(spark, d), "symbol_id", "text", "symbols", sources)


def symbol_documents(spark: SparkSession, d: str) -> DataFrame:
    symbols = graph.symbols(spark, d, "signature", "docstring", "extras")
    return s.symbol_texts(symbols, aliases.alias_words(symbols, graph.files(spark, d), graph.edges(spark, d)))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scores = document_index(spark, d).ask(QUERY)
    return scores.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(25).select("doc_id", F.round("score", 6).alias("score"))


def bm25_multi_query(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    top = document_index(spark, d).top_many(items, 3)
    return top.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def symbol_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    scores = symbol_index(spark, d).ask(QUERY)
    return scores.orderBy(F.desc(F.round("score", 9)), "symbol_id").limit(25).select("symbol_id", F.round("score", 6).alias("score"))


def index_postings(spark: SparkSession, d: str) -> DataFrame:
    """The stored postings as they are read back."""
    return document_index(spark, d).postings().select("doc_id", "term", "tf", "length")


def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Postings of the terms of one question."""
    return document_index(spark, d).lookup(LOOKED_UP).select("term", "doc_id", "tf", "length")


def symbol_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The distinct alias words of each symbol."""
    symbols = graph.symbols(spark, d, "extras")
    rows = aliases.alias_words(symbols, graph.files(spark, d), graph.edges(spark, d))
    return rows.select("qname", F.explode(F.array_distinct(F.split("alias", " "))).alias("word")).where("word != ''")


STOP = ", ".join(f"'{w}'" for w in s.STOP_WORDS)


def tokens_sql(docs: str, key: str = "doc_id") -> str:
    """CTEs ``tok`` (whole tokens), ``post`` (postings) and ``len`` (lengths) over a relation of ``key, text``."""
    return f"""
base AS (SELECT {key}, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]+'), lambda t: lower(t)),
  lambda t: t NOT IN ({STOP}) AND length(t) > 1) AS toks FROM ({docs}) q),
len AS (SELECT {key}, greatest(len(toks), 1) AS length FROM base),
tok AS (SELECT {key}, unnest(toks) AS tok FROM base),
terms AS (SELECT {key}, tok AS term FROM tok UNION ALL
  SELECT {key}, term FROM (SELECT {key}, tok, unnest(regexp_extract_all(tok, '[a-z]+|[0-9]+')) AS term FROM tok) u
  WHERE term <> tok AND length(term) > 1 AND term NOT IN ({STOP})),
post AS (SELECT {key}, term, count(*) AS tf FROM terms GROUP BY 1, 2)"""


def bm25_sql(docs: str, queries: str, key: str = "doc_id") -> str:
    return f"""{tokens_sql(docs, key)},
qtok AS (SELECT query_id, unnest(list_filter(list_transform(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: t NOT IN ({STOP}) AND length(t) > 1)) AS tok FROM ({queries}) q),
qterms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, tok AS term FROM qtok UNION ALL
  SELECT query_id, term FROM (SELECT query_id, tok, unnest(regexp_extract_all(tok, '[a-z]+|[0-9]+')) AS term FROM qtok) u WHERE term <> tok AND length(term) > 1 AND term NOT IN ({STOP})) x),
stats AS (SELECT greatest(count(*), 1) AS n_docs, greatest(avg(length), 1.0) AS avgdl FROM len),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
scores AS (SELECT q.query_id, p.{key}, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) AS score
  FROM qterms q JOIN post p USING (term) JOIN df USING (term) JOIN len USING ({key}) CROSS JOIN stats GROUP BY 1, 2)"""


def pieces_sql(x: str) -> str:
    """The pieces of an identifier as a list, like ``aliases.identifier_words``."""
    cut = f"regexp_replace(regexp_replace({x}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z]*)[A-Z]([^A-Za-z._/-])', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(regexp_extract_all({cut}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1)"


def _words_sql(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: the canonical tables with ``alias_c`` (qname, words) behind them
ALIAS_CTES = (
    graph.CANONICAL_SQL
    + f""",
neigh AS (SELECT qname, list_sort(list(DISTINCT w)) AS words FROM (SELECT src AS qname, unnest({pieces_sql("split(dst_name, '.')[-1]")}) AS w FROM edges_c
  WHERE edge_type IN ({", ".join(f"'{t}'" for t in aliases.NEIGHBOUR_TYPES)}) AND src IS NOT NULL AND dst_name IS NOT NULL) x GROUP BY 1),
alias_c AS (SELECT s.qname, list_concat({pieces_sql("coalesce(name, '')")}, {pieces_sql("split(s.qname, '.')[-1]")},
    coalesce(list_filter(list_transform(regexp_extract_all(path, '[A-Za-z][A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: t NOT IN ({", ".join(f"'{e}'" for e in aliases.PATH_ENDINGS)})), []),
    {", ".join(f"CASE WHEN kind = '{k}' THEN {_words_sql(w)} ELSE [] END" for k, w in aliases.KIND_CONCEPTS.items())},
    {", ".join(f"CASE WHEN regexp_matches(lower(coalesce(name, '')), '{x}') OR regexp_matches(lower(s.qname), '{x}') THEN {_words_sql(w)} ELSE [] END" for x, w in aliases.STEM_CONCEPTS)},
    coalesce(n.words, []),
    CASE WHEN kind = 'route' AND json_valid(extras) THEN list_concat(CASE WHEN json_extract_string(extras, '$.http_method') <> '' THEN [lower(json_extract_string(extras, '$.http_method'))] ELSE [] END,
      coalesce(regexp_extract_all(json_extract_string(extras, '$.path'), '[A-Za-z][A-Za-z0-9_]+'), [])) ELSE [] END) AS words
  FROM symbols_c s LEFT JOIN files_c f USING (file_id) LEFT JOIN neigh n ON n.qname = s.qname)"""
)
LOOKED_UP = ["token", "cache", "resolve", "nothing_has_this"]
DOCS = "SELECT doc_id, text FROM documents"
ONE = f"SELECT 0 AS query_id, '{QUERY}' AS query"
SYMBOL_DOCS = "SELECT symbol_id, concat_ws(' ', replace(qname, '.', ' '), name, coalesce(signature, ''), coalesce(docstring, ''), array_to_string(a.words, ' ')) AS text FROM symbols_c LEFT JOIN alias_c a USING (qname)"

QUERIES = {f.__name__: f for f in (tokenize_postings, doc_length_stats, doc_lengths, term_doc_freq, bm25_topk, bm25_multi_query, symbol_bm25_topk, index_postings, index_lookup, symbol_aliases)}
SQL = {
    "tokenize_postings": f"WITH {tokens_sql(DOCS)} SELECT doc_id, term, tf FROM post",
    "doc_length_stats": f"WITH {tokens_sql(DOCS)} SELECT greatest(count(*), 1) AS n_docs, round(greatest(avg(length), 1.0), 6) AS avgdl FROM len",
    "doc_lengths": f"WITH {tokens_sql(DOCS)} SELECT doc_id, CAST(length AS INTEGER) AS length FROM len",
    "term_doc_freq": f"WITH {tokens_sql(DOCS)} SELECT term, count(*) AS df FROM post GROUP BY 1",
    "bm25_topk": f"WITH {bm25_sql(DOCS, ONE)} SELECT doc_id, round(score, 6) AS score FROM scores ORDER BY round(score, 9) DESC, doc_id LIMIT 25",
    "bm25_multi_query": f"""WITH {bm25_sql(DOCS, "SELECT item_id AS query_id, text AS query FROM benchmark")}
      SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) r WHERE rank <= 3""",
    "index_postings": f"WITH {tokens_sql(DOCS)} SELECT doc_id, term, tf, CAST(length AS INTEGER) AS length FROM post JOIN len USING (doc_id)",
    "index_lookup": f"WITH {tokens_sql(DOCS)} SELECT term, doc_id, tf, CAST(length AS INTEGER) AS length FROM post JOIN len USING (doc_id) WHERE term IN ({', '.join(f"'{w}'" for w in LOOKED_UP)})",
    "symbol_aliases": ALIAS_CTES + "SELECT qname, unnest(list_distinct(words)) AS word FROM alias_c",
    "symbol_bm25_topk": f"""{ALIAS_CTES}, {bm25_sql(SYMBOL_DOCS, ONE, "symbol_id")}
      SELECT symbol_id, round(score, 6) AS score FROM scores ORDER BY round(score, 9) DESC, symbol_id LIMIT 25""",
}
