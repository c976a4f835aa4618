"""Language identification by words first, then ever shorter character n-grams.

A known word scores by its relative frequency in each language.  A word that no language knows is
scored by its longest known character n-grams: if none of length n is known, n - 1 is tried, down to
single characters.  A text's score in a language is the mean over its words of -log10 frequency, with a
fixed penalty where a language doesn't know what others know; the least wins.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_by_class, held_by_worker, small_batches, table

UNKNOWN = "und"
WORDS = re.compile(r"[^\W\d_]+").findall
MEMO_WORDS = 150_000


@dataclass(frozen=True)
class LanguageParams:
    """Bounds of the model.  Training reads about `train_docs` labelled documents of each language, whole
    texts, chosen by a hash of doc_id; the tables keep the most frequent entries of each length."""

    train_docs: int = 2000
    words: int = 12_000
    grams: tuple[int, ...] = (500, 4_000, 8_000, 8_000, 8_000)
    least_count: int = 2


@dataclass
class LanguageModel:
    """Scores are -log10 of relative frequencies: one row per word or n-gram, one column per language."""

    languages: list[str]
    scores: np.ndarray
    words: dict[str, int]
    grams: list[dict[str, int]]
    penalty: float
    key: str
    _memo: dict[str, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None

    def word(self, word: str) -> np.ndarray:
        if (row := self.words.get(word)) is not None:
            return self.scores[row]
        padded = f" {word} "
        for n in range(len(self.grams), 0, -1):
            get = self.grams[n - 1].get
            if found := [r for i in range(len(padded) - n + 1) if (r := get(padded[i : i + n])) is not None]:
                return self.scores[found].mean(axis=0)
        return np.full(len(self.languages), self.penalty, dtype=np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the probability that a mean word gives to all languages."""
        counts = Counter(WORDS((text or "").lower()))
        if not counts or not self.languages:
            return UNKNOWN, 0.0
        if self._rows is None or len(self._memo) + len(counts) > len(self._rows):
            self._memo.clear()
            self._rows = np.empty((max(MEMO_WORDS, len(counts)), len(self.languages)), dtype=np.float32)
        memo, rows, at = self._memo, self._rows, []
        for w in counts:
            if (k := memo.get(w)) is None:
                k = memo[w] = len(memo)
                rows[k] = self.word(w)
            at.append(k)
        n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        mean = n @ rows[at].astype(np.float64) / n.sum()
        best = int(np.argmin(mean))
        shares = np.exp((mean[best] - mean) * np.log(10))
        return self.languages[best], float(shares[best] / shares.sum())


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_language_model(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Learns from `text` and non-null `lang` of `docs`.  Words and n-grams are counted on the executors;
    what reaches the driver is bounded by `params` and the number of languages."""
    small_batches(docs.sparkSession)
    top = max(len(params.grams), 1)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = Counter()
                for t in texts:
                    words.update(WORDS((t or "").lower()))
                found = {0: words}
                for n in range(1, top + 1):
                    found[n] = grams = Counter()
                    for w, k in words.items():
                        w = f" {w} "
                        for i in range(len(w) - n + 1):
                            grams[w[i : i + n]] += k
                for n, c in found.items():
                    if c:
                        yield pd.DataFrame({"lang": lang, "n": n, "gram": list(c), "k": list(c.values())})

    sample = bounded_by_class(docs.select("doc_id", "text", "lang"), "lang", "doc_id", params.train_docs)
    sums = sample.select("lang", "text").mapInPandas(counted, "lang string, n int, gram string, k long").groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))
    sums = sums.withColumn("total", F.sum("k").over(Window.partitionBy("lang", "n")))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("k"), "gram"))
    keep = F.element_at(F.array(*[F.lit(x) for x in (params.words, *params.grams)]), F.col("n") + 1)
    got = sums.where(F.col("k") >= params.least_count).withColumn("r", rank).where(F.col("r") <= keep).select("lang", "n", "gram", "k", "total").toPandas()
    languages = sorted(got["lang"].unique())
    column = {x: i for i, x in enumerate(languages)}
    penalty = float(np.log10(got["total"].max()) + 1) if len(got) else 7.0
    tables: list[dict[str, int]] = [{} for _ in range(top + 1)]
    scores = np.full((len(got), len(languages)), penalty, dtype=np.float32)
    rows = 0
    for lang, n, gram, score in zip(got["lang"], got["n"], got["gram"], np.log10(got["total"] / got["k"]), strict=True):
        if (row := tables[n].get(gram)) is None:
            row = tables[n][gram] = rows
            rows += 1
        scores[row, column[lang]] = score
    return LanguageModel(languages, scores[:rows].copy(), tables[0], tables[1:], penalty, uuid.uuid4().hex)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to every row.  Only the text counts.  Null texts and texts without a
    letter give `und` and 0.  No shuffle; columns of these names are replaced."""
    small_batches(docs.sparkSession)
    key = model.key
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held_by_worker(("language", key), lambda: shared.value)
        for batch in texts:
            yield pd.DataFrame([model.predict(x) for x in batch], columns=["lang_pred", "score"])

    # Called nondeterministic so that a filter on lang_pred isn't pushed below and computed by a call of its own,
    # in a second Python worker for each task.
    once = predicted.asNondeterministic()
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, once(F.col(text)).alias("_p")).select(*kept, "_p.lang_pred", "_p.score")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
