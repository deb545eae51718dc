"""Reading level of documents by one smoothed unigram model per grade, and their language by a model of characters."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, release

LABELLED = 20_000
"""Most labelled documents that the models are trained on, drawn by a hash of the id: the documented bound."""
GRADES = (1, 2, 3, 4, 5)
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CODE = re.compile(r"```.*?```|^(?: {4}|\t).*$|`[^`\n]*`|https?://\S+", re.S | re.M)


def prose(text: str) -> list[str]:
    """Lower-case words of a text without code and links."""
    if "```" in text or "    " in text or "\t" in text or "`" in text or "http" in text:
        text = CODE.sub(" ", text)
    return WORD.findall(text.lower())


FOLDS = 5
"""Parts of the labelled documents, each of which a model fitted on the others scores."""


class English:
    """A trigram model of the characters of words, fitted on labelled English texts; what a trigram lacks is taken from
    pairs and single characters, in proportion to how many different ones follow (Witten-Bell).

    A text is English if its letters are about as likely as those of labelled texts that a model has not seen: their
    mean log likelihood a letter less ``MARGIN`` and ``SPREAD`` standard deviations, and less what chance does to a text
    of few letters.
    """

    SPREAD, MARGIN, NOISE = 4.0, 0.1, 1.2

    def __init__(self, words: Iterable[tuple[str, float]]):
        self.counts: list[Counter] = [Counter(), Counter(), Counter()]
        self.totals: list[Counter] = [Counter(), Counter(), Counter()]
        for word, n in words:
            w = f"^^{word}$"
            for i in range(2, len(w)):
                for k in range(3):
                    self.counts[k][w[i - k : i + 1]] += n
                    self.totals[k][w[i - k : i]] += n
        self.kinds: list[Counter] = [Counter(run[:-1] for run in c) for c in self.counts]
        self.mean, self.spread = -math.inf, 0.0
        self.score = functools.lru_cache(200_000)(self._score)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "score"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.score = functools.lru_cache(200_000)(self._score)

    def _score(self, word: str) -> tuple[float, int]:
        w = f"^^{word}$"
        total = 0.0
        for i in range(2, len(w)):
            p = 0.005
            for k in range(3):
                before = w[i - k : i]
                kinds = self.kinds[k].get(before, 0)
                if kinds:
                    p = (self.counts[k].get(w[i - k : i + 1], 0) + kinds * p) / (self.totals[k][before] + kinds)
            total += math.log(p)
        return total, len(w) - 2

    def likelihood(self, counts: Counter) -> tuple[float, int]:
        """Mean log likelihood of a letter and the number of letters."""
        total, letters = 0.0, 0
        for word, n in counts.items():
            s, k = self.score(word)
            total += n * s
            letters += n * k
        return total / max(1, letters), letters

    def calibrate(self, unseen: list[float]) -> None:
        """``unseen``: likelihoods of labelled texts under models that were fitted without them."""
        if unseen:
            self.mean = sum(unseen) / len(unseen)
            self.spread = math.sqrt(sum((s - self.mean) ** 2 for s in unseen) / len(unseen))

    def is_english(self, counts: Counter) -> bool:
        likelihood, letters = self.likelihood(counts)
        return likelihood > self.mean - self.MARGIN - self.SPREAD * self.spread - self.NOISE / math.sqrt(max(1, letters))


class GradeModels:
    """Unigram models with Dirichlet smoothing towards the words of all grades, and the share of each grade."""

    def __init__(self, counts: dict[str, list[float]], documents: list[float], mass: float = 400.0):
        totals = [sum(c[g] for c in counts.values()) for g in range(len(GRADES))]
        every = sum(totals) or 1.0
        self.prior = [math.log((d + 1) / (sum(documents) + len(GRADES))) for d in documents]
        self.logs: dict[str, tuple[float, ...]] = {}
        for word, c in counts.items():
            back = sum(c) / every
            self.logs[word] = tuple(math.log((c[g] + mass * back) / (totals[g] + mass)) for g in range(len(GRADES)))

    def posterior(self, counts: Counter) -> list[float]:
        score = list(self.prior)
        logs = self.logs
        for word, n in counts.items():
            if (row := logs.get(word)) is not None:
                for g, x in enumerate(row):
                    score[g] += n * x
        top = max(score)
        weights = [math.exp(s - top) for s in score]
        return [w / sum(weights) for w in weights]


def train(documents: DataFrame, levels: DataFrame, labelled: int = LABELLED) -> tuple[GradeModels, English]:
    """Models from the graded documents. Words are counted on the cluster; what comes back are the words of at most
    ``labelled`` documents. Each of ``FOLDS`` parts is scored without itself to tell how likely unseen English letters are."""
    chosen = (
        levels.where(F.col("grade").isin(*GRADES))
        .groupBy("doc_id")
        .agg(F.round(F.avg("grade")).cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(labelled)
    )
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold")
    texts = cut_lineage(documents.select("doc_id", "text").where("text is not null and text != ''").join(F.broadcast(chosen), "doc_id").select("grade", "text", fold))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: Counter = Counter()
            for grade, text, fold in zip(batch["grade"], batch["text"], batch["fold"]):
                rows[None, int(grade), fold] += 1
                words = prose(text)
                # a long document weighs no more than a page, so that its topic doesn't colour its grade
                weight = min(1.0, 300 / max(1, len(words)))
                for w, n in Counter(words).items():
                    rows[w, int(grade), fold] += n * weight
            yield pd.DataFrame([(w, g, f, n) for (w, g, f), n in rows.items()], columns=["word", "grade", "fold", "n"])

    counted = texts.mapInPandas(count, "word string, grade int, fold int, n double").groupBy("word").agg(
        *[F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0.0)).alias(f"g{g}") for g in GRADES],
        *[F.sum(F.when(F.col("fold") != f, F.col("n")).otherwise(0.0)).alias(f"f{f}") for f in range(FOLDS)],
    )
    rows = sorted(counted.collect(), key=lambda r: r["word"] or "")
    per_grade = {r["word"]: [r[f"g{g}"] for g in GRADES] for r in rows}
    n_documents = per_grade.pop(None, [0.0] * len(GRADES))
    english = English((w, sum(c)) for w, c in per_grade.items())
    others = [English((r["word"], r[f"f{f}"]) for r in rows if r["word"] is not None and r[f"f{f}"]) for f in range(FOLDS)]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [others[f].likelihood(Counter(words))[0] for text, f in zip(batch["text"], batch["fold"]) if (words := prose(text))]
            yield pd.DataFrame({"likelihood": found}, dtype="float64")

    english.calibrate([r[0] for r in texts.mapInPandas(score, "likelihood double").collect()])
    release(texts)
    return GradeModels(per_grade, n_documents), english


def reading_levels(documents: DataFrame, levels: DataFrame) -> DataFrame:
    """``doc_id, english, grade, p_demanding``: the likeliest grade of each document with any words.

    ``english`` is judged by the text's letters. ``grade`` is the one of highest posterior probability (the lower one of
    equally likely ones) and ``p_demanding`` the probability of the two highest grades; both are null for texts in other
    languages. Null, empty and wordless texts are left out; repeated documents count each. Without usable labels all
    grades are equally likely and all texts pass for English.
    """
    models = documents.sparkSession.sparkContext.broadcast(train(documents, levels))

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grades, english = models.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = prose(text) or WORD.findall(text.lower())
                if not words:
                    continue
                counts = Counter(words)
                if english.is_english(counts):
                    p = grades.posterior(counts)
                    rows.append((doc, True, GRADES[max(range(len(p)), key=p.__getitem__)], p[3] + p[4]))
                else:
                    rows.append((doc, False, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "english", "grade", "p_demanding"]).astype({"grade": "Int32"})

    chosen = documents.select("doc_id", "text").where("text is not null and text != ''")
    return chosen.mapInPandas(grade, "doc_id long, english boolean, grade int, p_demanding double")


def demanding(graded: DataFrame) -> DataFrame:
    """English documents whose likeliest grade is one of the two highest."""
    return graded.where(F.col("english") & F.col("grade").isin(*GRADES[3:])).select("doc_id")
