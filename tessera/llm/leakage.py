"""Evaluation texts inside training documents, by greedy string tiling over shared seeds."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, release

SEED = 4
"""Words of a seed that makes an item a candidate for a document."""
TILE = 3
"""Least words of a tile."""
LEAST_WORDS = 20
LEAST_SEEDS = 5
"""Seeds that any two passages with ``LEAST_WORDS`` words leave: a passage of n words in k tiles has n less the words
changed (k - 1 at least) less 3k of them, which is least for 16 and 7 words with two changes and one. Each further stretch
of an item's own words costs three more, and each seed that the item has twice one."""
LEAST_PASSAGE = 7
"""Words below which a common run can be a turn of phrase; alone it is no passage, beside a longer one it counts unless
it is a turn of phrase of the test set."""
CONTEXTS = 3
"""Different surroundings in the test set from which on a short run is a turn of phrase: the frame of tasks of one make."""
EDITS = 1 / 8
BLOCK_ITEMS = 20_000
"""Items sent to the workers at once; a larger test set is taken in as many blocks as needed."""
WORD = re.compile(r"[^\W_]+")
MARKUP = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|&[a-z]{2,6};|\]\([^)\s]*\)")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
BASE = np.uint64(1_000_003)
BITS = 20


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation; tags, entities and link targets are no words."""
    if "<" in text or "&" in text or "](" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(text.lower().replace("’", "'"))


def sentences_of(text: str) -> list[list[str]]:
    return [w for s in SENTENCE.split(text) if (w := words_of(s))]


def surroundings(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of at least ``TILE`` and fewer than ``LEAST_PASSAGE`` words of a text, each with the key of the run
    and the words around it."""
    hashed = np.r_[np.uint64(1), word_keys([w for x in sentences_of(text) for w in x]), np.uint64(2)]
    lengths = range(TILE, LEAST_PASSAGE)
    return np.concatenate([rolling(hashed[1:-1], n) for n in lengths]), np.concatenate([rolling(hashed, n + 2) for n in lengths])


def turns_of(texts: list[str]) -> set[int]:
    """Keys of the runs of fewer than ``LEAST_PASSAGE`` words that stand in ``CONTEXTS`` or more different surroundings."""
    pairs = np.unique(np.concatenate([np.zeros((2, 0), np.uint64), *(np.stack(surroundings(t)) for t in texts)], axis=1), axis=1)
    keys, contexts = np.unique(pairs[0], return_counts=True)
    return set(keys[contexts >= CONTEXTS].tolist())


def word_keys(words: list[str]) -> np.ndarray:
    """Values of words that do not depend on a vocabulary."""
    return pd.util.hash_array(np.array(words, object)) if words else np.zeros(0, np.uint64)


class Index:
    """Words and seeds of a block of items. ``shared`` holds sentences that occur in several items (of all blocks);
    their words do not count and make no seeds. ``turns`` are the keys of the test set's turns of phrase; the words of an
    item outside them are its content."""

    def __init__(self, items: list[tuple[int, str]], shared: set[str], turns: set[int] = frozenset()):
        self.vocabulary: dict[str, int] = {}
        self.content: list[np.ndarray] = []
        self.items: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.least: list[int] = []
        owners: dict[int, set[int]] = defaultdict(set)
        for n, (item, text) in enumerate(items):
            ids, counts = [], []
            for sentence in sentences_of(text or ""):
                own = " ".join(sentence) not in shared
                ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in sentence]
                counts += [own] * len(sentence)
            a, own = np.array(ids, np.uint64), np.array(counts, bool)
            self.items.append((item, a, own))
            hashed = word_keys([w for x in sentences_of(text or "") for w in x]) if turns else a[:0]
            content = np.ones(len(a), bool)
            for m in range(TILE, LEAST_PASSAGE):
                for j, k in enumerate(rolling(hashed, m).tolist()):
                    if k in turns:
                        content[j : j + m] = False
            self.content.append(content)
            whole = np.convolve(own, np.ones(SEED, int), "valid") == SEED if len(a) >= SEED else np.zeros(0, bool)
            keys = rolling(a, SEED)[whole].tolist()
            for k in set(keys):
                owners[k].add(n)
            stretches = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            self.least.append(max(2, LEAST_SEEDS - (SEED - 1) * (stretches - 1) - (len(keys) - len(set(keys)))))
        self.seeds = dict(owners)
        self.keys = np.array(sorted(self.seeds), np.uint64)
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[bucket(self.keys)] = True


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin values of all runs of ``n`` words."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * BASE + ids[i : len(ids) - n + 1 + i]
    return out


def bucket(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


def tiles(doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy string tiling: longest non-overlapping common runs first, of at least ``TILE`` words: ``(doc, item, n)``.

    Runs are grown from equal Karp-Rabin values; of equal lengths the earlier in the document is taken.
    """
    where: dict[int, list[int]] = defaultdict(list)
    for j, k in enumerate(rolling(item, TILE).tolist()):
        where[k].append(j)
    d, t = doc.tolist(), item.tolist()
    runs = []
    for i, k in enumerate(rolling(doc, TILE).tolist()):
        for j in where.get(k, ()):
            if i and j and d[i - 1] == t[j - 1]:
                continue
            n = 0
            while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n] and d[i + n]:
                n += 1
            if n >= TILE:
                runs.append((-n, i, j))
    busy_d, busy_t, out = bytearray(len(d)), bytearray(len(t)), []
    import heapq

    heapq.heapify(runs)
    while runs:
        n, i, j = heapq.heappop(runs)
        n = -n
        free = [not (busy_d[i + x] or busy_t[j + x]) for x in range(n)]
        if all(free):
            busy_d[i : i + n] = b"\1" * n
            busy_t[j : j + n] = b"\1" * n
            out.append((i, j, n))
            continue
        x = 0
        while x < n:  # what is left of a run that longer tiles cut
            y = x
            while y < n and free[y]:
                y += 1
            if y - x >= TILE:
                heapq.heappush(runs, (x - y, i + x, j + x))
            x = max(y, x + 1)
    return sorted(out)


def passages(found: list[tuple[int, int, int]], own: np.ndarray, content: np.ndarray | None = None) -> list[int]:
    """Words of the item in each passage: tiles that follow one another in both texts with few words changed between.

    A passage that does not hold most of its words of ``content`` is the frame of a task with other content and counts
    for nothing."""

    def words(chain: list[int], first: int, end: int) -> int:
        if content is not None:
            held = sum(int(content[j : j + n].sum()) for _, j, n in (found[k] for k in chain))
            if 2 * held <= int(content[first:end].sum()):
                return 0
        return int(own[first:end].sum())

    best: list[int] = []
    used: set[int] = set()
    for start in range(len(found)):
        if start in used:
            continue
        i, j, n = found[start]
        chain, edits, first, matched = [start], 0, j, n
        end_d, end_t = i + n, j + n
        for k in range(start + 1, len(found)):
            i2, j2, n2 = found[k]
            gap_d, gap_t = i2 - end_d, j2 - end_t
            if gap_d > 6:
                break
            if k in used or gap_t < 0 or gap_t > 4 or max(gap_d, gap_t) + edits > max(1.0, EDITS * (matched + n2 + gap_t)) + 1:
                continue
            edits += max(gap_d, gap_t)
            matched += n2
            chain.append(k)
            end_d, end_t = i2 + n2, j2 + n2
        span = end_t - first
        if edits <= max(1, EDITS * span):
            used.update(chain)
            best.append(words(chain, first, end_t))
        else:
            used.add(start)
            best.append(words([start], j, j + n))
    return best


def covered(doc: np.ndarray, item: np.ndarray, own: np.ndarray, content: np.ndarray | None = None) -> int:
    """Words of the item that the document holds in its two best passages, the longer of which is clearly one."""
    best = sorted(passages(tiles(doc, item), own, content))[-2:]
    return sum(best) if best and best[-1] >= LEAST_PASSAGE else 0


def leaks(texts: list[str], index: Index) -> Iterator[tuple[int, int, int]]:
    """``(number of the text, item id, words)`` for each pair with at least ``LEAST_WORDS`` words."""
    get = index.vocabulary.get
    ids, ends = [], []
    for t in texts:
        ids += [get(w, 0) for w in words_of(t)]
        ids.append(0)
        ends.append(len(ids))
    stream = np.array(ids, np.uint64)
    keys = rolling(stream, SEED)
    at = np.flatnonzero(index.bitmap[bucket(keys)])
    if not len(at) or not len(index.keys):
        return
    slot = np.minimum(np.searchsorted(index.keys, keys[at]), len(index.keys) - 1)
    at = at[index.keys[slot] == keys[at]]
    owner = np.searchsorted(np.array(ends), at, side="right")
    held, first = np.unique(owner, return_index=True)
    for d, own_at in zip(held.tolist(), np.split(at, first[1:])):
        doc = stream[ends[d - 1] if d else 0 : ends[d]]
        hits: dict[int, int] = defaultdict(int)
        for k in np.unique(keys[own_at]).tolist():
            for n in index.seeds[k]:
                hits[n] += 1
        for n in sorted(n for n, h in hits.items() if h >= index.least[n]):
            item, words, own = index.items[n]
            total = covered(doc, words, own, index.content[n])
            if total >= LEAST_WORDS:
                yield d, item, total


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_words`` for each document that holds at least twenty words of an item.

    Words count in one or two passages in which up to one word in eight differs; sentences of several items do not
    count. Null and empty texts hold nothing; repeated documents and items count each; other columns are not read.
    Documents are read once per block of items, whole, without a shuffle. A pair is looked at once it shares as
    many seeds of ``SEED`` words as twenty words in two passages always leave with one word in eight changed
    (``LEAST_SEEDS``), however many items have them. What tasks of one make share is told by its surroundings in the whole test set, not by block:
    sentences and runs are counted on the cluster, and one block of items comes to the driver at a time.
    """
    spark = documents.sparkSession
    rows = cut_lineage(benchmark.select("item_id", "text").where("text is not null"))
    blocks = max(1, -(-rows.count() // BLOCK_ITEMS))
    items = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    facts = items.mapInPandas(_facts, "block int, turn boolean, key long, place long")
    # a sentence is common if several items have it, a short run if it has several surroundings
    counted = facts.groupBy("turn", "key").agg(F.count_distinct("place").alias("n"), F.collect_set("block").alias("blocks"))
    common = cut_lineage(counted.where(F.when(F.col("turn"), F.col("n") >= CONTEXTS).otherwise(F.col("n") > 1)).select("turn", "key", "blocks"))
    result = None
    chosen = documents.select("doc_id", "text").where("text is not null and text != ''")
    for b in range(blocks):
        # one block at a time comes to the driver, with those of the common sentences and turns that stand in it
        of_block = sorted((r.item_id, r.text) for r in items.where(F.col("block") == b).select("item_id", "text").collect())
        known = common.where(F.array_contains("blocks", b)).select("turn", "key").collect()
        keys = {r.key for r in known if not r.turn}
        sentences = {" ".join(x) for _, text in of_block for x in sentences_of(text)}
        index = spark.sparkContext.broadcast(
            Index(of_block, {x for x in sentences if sentence_key(x) in keys}, {r.key & 0xFFFFFFFFFFFFFFFF for r in known if r.turn})
        )

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids = batch["doc_id"].tolist()
                found = [(ids[d], item, n) for d, item, n in leaks(batch["text"].tolist(), index.value)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "n_words"])

        part = chosen.mapInPandas(scan, "doc_id long, item_id long, n_words int")
        result = part if result is None else result.unionByName(part)
    release(rows, common)
    return result


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sentences of each item and its short runs as keys, with the item or what is around the run."""
    for batch in batches:
        for block, item, text in zip(batch["block"], batch["item_id"], batch["text"]):
            sentences = np.array([sentence_key(" ".join(x)) for x in sentences_of(text)], np.int64)
            runs, around = surroundings(text)
            yield pd.DataFrame(
                {
                    "block": block, "turn": np.r_[np.zeros(len(sentences), bool), np.ones(len(runs), bool)],
                    "key": np.r_[sentences, runs.astype(np.int64)], "place": np.r_[np.full(len(sentences), -1 if item is None else item, np.int64), around.astype(np.int64)],
                }
            )


def sentence_key(sentence: str) -> int:
    return int(pd.util.hash_array(np.array([sentence], object)).astype(np.int64)[0])


def leaked_items(leaks_found: DataFrame) -> DataFrame:
    """Per leaked item: the number of documents that hold it and the most words that one of them holds."""
    return leaks_found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("most_words"))
