"""Documents packed whole into contexts of a fixed number of tokens."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CAPACITY = 8000
GROUP_PACKS = 512
"""Packs that one group of documents fills on average; a task holds only the sizes of one group."""


@functools.cache
def _encoding(path: str):
    import tiktoken

    # workers that lack the file have it from the driver
    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts; null and empty texts have none. Marks of special tokens are ordinary text. The
    vocabulary file is sent to workers that do not have it at its path."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": sizes})

    documents.sparkSession.sparkContext.addFile(tokenizer)
    return documents.select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens long")


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, largest items first (ties in the order given), each in the first bin that has room.

    A tournament tree keeps the most room in each range of bins, so the first bin with room is found from the root in
    one descent. Items must not be larger than ``capacity``.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    tree = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            node += tree[node] < size
        bins[i] = node - leaves
        tree[node] -= size
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left >= right else right
    return bins


def pack_documents(
    documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, group_packs: int = GROUP_PACKS, seed: int = 7
) -> DataFrame:
    """``doc_id, piece, n_tokens, pack_id``: the pack of each document, with as little room left over as possible.

    Documents are put whole into packs; only one of more than ``capacity`` tokens is cut, into full packs and a rest
    that is packed like a document (``piece`` counts from 0). Packs are filled by first-fit decreasing, independently in
    groups of documents drawn by a hash of the id, whose number follows the total of tokens: about ``group_packs`` packs
    each, so groups are alike whatever is skewed in the data. Null and empty texts have no tokens and a null pack. An
    empty table gives no rows; other columns are not read.
    """
    sized = cut_lineage(token_counts(documents, tokenizer))
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, round(total / (capacity * group_packs)))
    whole = F.floor(F.col("n_tokens") / capacity)
    cuts = F.when(
        F.col("n_tokens") > capacity,
        F.concat(
            F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.struct(i.cast("int").alias("piece"), F.lit(capacity).cast("long").alias("n_tokens"))),
            F.filter(
                F.array(F.struct(whole.cast("int").alias("piece"), (F.col("n_tokens") - whole * capacity).alias("n_tokens"))), lambda s: s["n_tokens"] > 0
            ),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("piece"), F.col("n_tokens"))))
    pieces = sized.select("doc_id", F.inline(cuts))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True])
        bins = first_fit_decreasing(rows["n_tokens"].tolist(), capacity)
        base = int(rows["g"].iloc[0]) << 32
        return pd.DataFrame({"doc_id": rows["doc_id"], "piece": rows["piece"], "n_tokens": rows["n_tokens"], "pack_id": [base + b for b in bins]})

    group = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).alias("g")
    schema = "doc_id long, piece int, n_tokens long, pack_id long"
    packed = pieces.where("n_tokens > 0").select("doc_id", "piece", "n_tokens", group).groupBy("g").applyInPandas(fill, schema)
    return packed.unionByName(pieces.where("n_tokens = 0").withColumn("pack_id", F.lit(None).cast("long")))


def pack_fill(packs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packs, documents and tokens in all, and the share of room that is used."""
    filled = packs.where("pack_id is not null").groupBy("pack_id").agg(F.sum("n_tokens").alias("n"), F.count_distinct("doc_id").alias("docs"))
    return filled.agg(
        F.count("*").alias("n_packs"), F.max("n").alias("fullest"), F.sum("n").alias("n_tokens"), F.round(F.sum("n") / (F.count("*") * capacity), 6).alias("used")
    )
