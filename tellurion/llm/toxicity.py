"""Severity of toxic text by cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(x w - t_k): one weight per word, shared by all thresholds t_0 < t_1 < ...  The
features are a text's words and the first four and five letters of its words, each with the value
1 + ln(times).  Features are chosen by proximal gradient descent with an L1 penalty and fitted by Newton
steps, on a bounded sample of labelled rows; everything is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_by_class, held_by_worker, small_batches, table, written

WORDS = re.compile(r"[^\W\d_]+").findall


@dataclass(frozen=True)
class ToxicityParams:
    """About `train_rows` labelled rows of each class are read, chosen by a hash of doc_id; words in fewer
    than `least_rows` of them are no features.  `l1` is the penalty on the mean loss
    by which features are chosen; those chosen are fitted again, with `ridge` on the summed loss."""

    train_rows: int = 4000
    least_rows: int = 8
    l1: float = 1e-3
    ridge: float = 0.05
    newton_steps: int = 40
    least_odds: float = 1.0
    features: int = 3000
    steps: int = 800


def features(words: Iterable[str]) -> Counter[str]:
    """Of a text's words: how often each occurs, and each of their beginnings, which end in *."""
    out = Counter(words)
    for w, n in list(out.items()):
        if len(w) > 4:
            out[w[:4] + "*"] += n
            if len(w) > 5:
                out[w[:5] + "*"] += n
    return out


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]

    def __post_init__(self) -> None:
        self.whole = {w for w in self.weights if not w.endswith("*")}
        self.four, self.five = ({w[:-1] for w in self.weights if w.endswith("*") and len(w) == n + 1} for n in (4, 5))

    def score(self, text: str | None) -> list[float]:
        """P(grade > k) for each threshold; a null or empty text has no features."""
        counts = Counter(WORDS((text or "").lower()))
        hit = {w: counts[w] for w in counts.keys() & self.whole}
        for known, n in ((self.four, 4), (self.five, 5)):
            if known and (found := {w[:n] for w in counts} & known):
                for w, k in counts.items():
                    if len(w) > n and w[:n] in found:
                        hit[w[:n] + "*"] = hit.get(w[:n] + "*", 0) + k
        z = math.fsum(self.weights[w] * (1 + math.log(k)) for w, k in hit.items())
        return [1 / (1 + math.exp(max(-700.0, min(700.0, t - z)))) for t in self.thresholds]


def fit_ordinal(cols: list[np.ndarray], vals: list[np.ndarray], words: list[str], grades: np.ndarray, classes: int, params: ToxicityParams = ToxicityParams()) -> OrdinalModel:
    """`cols`: the numbers of each row's features in `words`; `vals`: their values.  `grades`: 0 to
    classes - 1."""
    rows, owner = cols, np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols])
    col = np.concatenate(cols).astype(np.int32) if cols else np.zeros(0, dtype=np.int32)
    val = np.concatenate(vals).astype(np.float32) if vals else np.zeros(0, dtype=np.float32)
    n, v = max(len(rows), 1), len(words)
    above = np.stack([grades > k for k in range(classes - 1)], axis=1).astype(float) if classes > 1 else np.zeros((len(rows), 0))
    share = np.clip(above.mean(axis=0) if len(rows) else np.full(classes - 1, 0.5), 1e-3, 1 - 1e-3)
    w, t = np.zeros(v), np.log((1 - share) / share)
    if not v or len(rows) == 0:
        return OrdinalModel({}, t.tolist())
    # Steps by coordinate scale: a bound on the curvature, by how often a word occurs with the others.
    width = np.bincount(owner, weights=val, minlength=n)
    bound = 0.25 * (classes - 1) * np.bincount(col, weights=val * width[owner], minlength=v) / n + 1e-6
    wy, ty, mom = w, t, 1.0
    for _ in range(params.steps):
        z = np.bincount(owner, weights=val * wy[col], minlength=n)
        p = 1 / (1 + np.exp(np.clip(ty[None, :] - z[:, None], -50, 50)))
        err = p - above
        step = wy - np.bincount(col, weights=val * err.sum(axis=1)[owner], minlength=v) / n / bound
        new_w = np.sign(step) * np.maximum(np.abs(step) - params.l1 / bound, 0)
        new_t = np.sort(ty + err.mean(axis=0))
        nxt = (1 + np.sqrt(1 + 4 * mom * mom)) / 2
        wy, ty = new_w + (mom - 1) / nxt * (new_w - w), new_t + (mom - 1) / nxt * (new_t - t)
        if (wy - new_w) @ (new_w - w) < 0:  # momentum against the way: begin anew
            wy, ty, nxt = new_w, new_t, 1.0
        w, t, mom = new_w, new_t, nxt
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return OrdinalModel({words[i]: float(w[i]) for i in keep}, t.tolist())


def refit_ordinal(cols: list[np.ndarray], vals: list[np.ndarray], words: list[str], grades: np.ndarray, classes: int, params: ToxicityParams = ToxicityParams()) -> OrdinalModel:
    """The same model for few features, by Newton steps with halving: weights and thresholds together."""
    n, v, links = len(cols), len(words), classes - 1
    x = np.zeros((n, v + links))
    for i, (c, y) in enumerate(zip(cols, vals, strict=True)):
        x[i, c] = y
    above = [(grades > k).astype(float) for k in range(links)]
    beta = np.zeros(v + links)
    beta[v:] = [np.log((1 - m) / m) for m in (float(np.clip(a.mean() if n else 0.5, 1e-3, 1 - 1e-3)) for a in above)]

    def design(k: int) -> np.ndarray:
        x[:, v:] = 0
        x[:, v + k] = -1
        return x

    def loss(b: np.ndarray) -> float:
        z = x[:, :v] @ b[:v]
        return sum(np.logaddexp(0, (1 - 2 * a) * (z - b[v + k])).sum() for k, a in enumerate(above)) + params.ridge / 2 * b[:v] @ b[:v]

    now = loss(beta)
    for _ in range(params.newton_steps if n else 0):
        slope, curve = np.append(params.ridge * beta[:v], np.zeros(links)), np.diag(np.append(np.full(v, params.ridge), np.full(links, 1e-6)))
        for k, a in enumerate(above):
            d = design(k)
            p = 1 / (1 + np.exp(np.clip(-(d @ beta), -50, 50)))
            slope += d.T @ (p - a)
            curve += d.T @ (d * (p * (1 - p))[:, None])
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and (new := loss(beta - size * step)) > now:
            size /= 2
        if size <= 1e-4 or now - new < 1e-7 * max(1, now):
            break
        beta, now = beta - size * step, new
    return OrdinalModel({w: float(b) for w, b in zip(words, beta[:v], strict=True)}, np.sort(beta[v:]).tolist())


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> OrdinalModel:
    """Three grades: 0 for rows labelled clean; the labels know no degrees, so rows labelled toxic are 1
    or 2 (severe) by how many words a first, two-grade fit finds hostile in them: more than the median.  A doc_id labelled twice counts as toxic if any label says so; null labels don't count."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = bounded_by_class(marks, "toxic", "doc_id", params.train_rows)

    # The sample of labels is bounded by params.train_rows, so it may be broadcast.
    texts = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "labelled")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [Counter(), Counter()]
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                n[toxic].update(features(WORDS((text or "").lower())))
            if not (both := list(n[0] | n[1])):
                continue
            yield pd.DataFrame({"word": both, "clean": [n[0][w] for w in both], "toxic": [n[1][w] for w in both]})

    sums = texts.mapInPandas(counted, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = texts.groupBy().agg(F.sum(1 - F.col("toxic")).alias("c"), F.sum("toxic").alias("t")).first()
    odd = F.abs(F.log((F.col("toxic") + 0.5) / F.lit((total.t or 0) + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit((total.c or 0) + 1.0)))
    sums = sums.where((F.col("clean") + F.col("toxic") >= params.least_rows) & (odd >= params.least_odds))
    words = [r[0] for r in sums.orderBy((odd * F.sqrt(F.col("clean") + F.col("toxic"))).desc(), "word").limit(params.features).select("word").collect()]
    number = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = number.value.get
        for batch in batches:
            rows = [sorted((i, k) for w, k in features(WORDS((t or "").lower())).items() if (i := get(w)) is not None) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "ids": [np.array([x[0] for x in r], dtype="<i4").tobytes() for r in rows], "times": [np.array([x[1] for x in r], dtype="<i4").tobytes() for r in rows]})

    rows = texts.mapInPandas(numbered, "doc_id long, toxic int, ids binary, times binary").toPandas().sort_values(["doc_id", "ids", "times"], kind="stable")
    cols, toxic = [np.frombuffer(x, dtype="<i4") for x in rows["ids"]], rows["toxic"].to_numpy(dtype=np.int64)
    times = [np.frombuffer(x, dtype="<i4") for x in rows["times"]]
    vals = [(1 + np.log(x)).astype(np.float32) for x in times]
    first = fit_ordinal(cols, vals, words, toxic, 2, params)
    place = np.array([w in first.weights for w in words], dtype=bool)
    kept, renumbered = [w for w in words if w in first.weights], np.cumsum(place) - 1
    own = [place[c] for c in cols]
    vals, times = [y[m] for y, m in zip(vals, own, strict=True)], [y[m] for y, m in zip(times, own, strict=True)]
    cols = [renumbered[c[m]] for c, m in zip(cols, own, strict=True)]
    second = refit_ordinal(cols, vals, kept, toxic, 2, params)
    # Words count once: those of which a beginning is hostile, by the shortest such beginning alone.
    hostile = np.array([x > 0 and not any(len(o) < len(w) and o.endswith("*") and w.startswith(o[:-1]) and second.weights[o] > 0 for o in kept) for w, x in second.weights.items()] + [False])
    dose = np.array([k[hostile[c]].sum() for c, k in zip(cols, times, strict=True)])
    middle = np.median(dose[toxic == 1]) if (toxic == 1).any() else 0.0
    return refit_ordinal(cols, vals, kept, toxic * (1 + (dose > middle)), 3, params)


def score_severity(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """Adds severity (the expected grade), p_toxic (that of any grade above 0), grade (thresholds passed)
    and toxic.  Null and empty texts have no features and get what the thresholds alone give.  No shuffle;
    columns of these names are replaced."""
    small_batches(docs.sparkSession)
    key = tuple(model.thresholds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double, grade int, toxic boolean")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held_by_worker(("toxicity", key), lambda: shared.value)
        for batch in texts:
            p = [model.score(x) for x in batch]
            yield pd.DataFrame([(sum(x), x[0], sum(y > 0.5 for y in x), x[0] > 0.5) for x in p], columns=["severity", "p_toxic", "grade", "toxic"])

    new = ("severity", "p_toxic", "grade", "toxic")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    return docs.select(*kept, scored(F.col(text)).alias("_s")).select(*kept, *[f"_s.{c}" for c in new])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_severity(docs.select("doc_id", "text"), model).drop("text")
