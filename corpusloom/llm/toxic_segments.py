"""Toxic passages: maximum-scoring segments over token log-odds.

Fitting counts, for every word and for its stems, the
toxic and clean labelled texts that hold it, and turns the counts into log-odds
ratios under an informative Dirichlet prior; only units whose ratio is
significant carry a score, lowered by one standard error. All other tokens cost
a little, so a text's running score drifts down unless toxic tokens lift it.

Scoring finds all maximal scoring segments of a text in one linear scan. Under
the clean background the best segment of n tokens follows an extreme-value law
with E = K n exp(-lambda S); lambda comes from the background distribution of
token scores, K from the clean fitting texts. Segments with a small E are the
significant passages, and a text's score is a calibrated function of the best
segment's E and the number of significant passages.

Defined results: null and empty texts have no segment and get the score of a
text without evidence; texts are scanned whole; repeated rows are scored alike;
without labels every score is 0; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_mod, labelled_sample, shared_table

FIT_ROWS = 24_000       # labelled rows the model is fitted on, at most
STEMS = (4, 5)
PRIOR = 0.25            # pseudo-count of a unit of average share or less; more in proportion
LEAST_Z = 2.4           # a unit's log-odds ratio counts from this many standard errors on
LEAST_SCORE = 1.0       # and from this size on, lowered by one standard error
DRIFT = 0.2             # cost of a token without evidence
SIGNIFICANT = 0.01      # largest E of a significant passage

_WORDS = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORDS(text.lower()) if text else []


def units_of(words: list[str]) -> set[str]:
    """The words and, marked with a star, their stems."""
    distinct = set(words)
    return distinct.union(*({w[:k] + "*" for w in distinct if len(w) >= k} for k in STEMS))


def family_of(words: list[str]) -> int:
    """The smallest hash over a text's word pairs: near copies mostly share it, other texts don't."""
    pairs = set(zip(words, words[1:])) or {(w, "") for w in words}
    return min((xxhash.xxh64_intdigest(a + " " + b) >> 1 for a, b in pairs), default=0)


def maximal_segments(items: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a scored sequence, in linear time.

    ``items`` are (first, last, score) runs in order. Candidates are kept with the
    running totals at their two ends; a new positive run is joined with earlier
    candidates as long as that raises the total, else it starts its own. Each candidate has a link to the nearest one
    before it that begins at a smaller total, so a search passes over the others at once, and where
    no candidate begins at a smaller total, all of them are final and leave the list.
    """
    done: list[tuple[int, int, float]] = []
    kept: list[tuple[int, int, float, float, int]] = []     # first, last, total before, total after, link
    total = 0.0
    for first, last, score in items:
        before, total = total, total + score
        if score <= 0:
            continue
        low, high = before, total
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0:
                done += [(a, b, h - w) for a, b, w, h, _ in kept]
                kept.clear()
                break
            if kept[j][3] >= high:
                break
            first, low, link = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = link
        kept.append((first, last, low, high, j))
    return done + [(a, b, h - w) for a, b, w, h, _ in kept]


@dataclass
class ToxicModel:
    """Unit scores, the extreme-value constants and the calibration of the final score."""
    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0           # lambda
    scale: float = 1.0          # K
    weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def token_scores(self, words: list[str], memo: dict[str, float] | None = None) -> list[tuple[int, float]]:
        """(position, score) of the tokens with evidence: the strongest of word and stem.

        The ratios rest on whether a text holds a word, so each repeat in a text counts half the one before.
        """
        scores = self.scores
        again: dict[str, float] = {}
        if memo is None:
            memo = {}
        out = []
        for i, w in enumerate(words):
            s = memo.get(w)
            if s is None:
                found = [scores[u] for u in (w, *(w[:k] + "*" for k in STEMS)) if u in scores]
                s = memo[w] = max(found, key=abs) if found else 0.0
            if s:
                share = again[w] = again.get(w, 2.0) / 2
                out.append((i, s * share))
        return out

    def segments(self, words: list[str], memo=None) -> list[tuple[int, int, float]]:
        """Maximal segments as (first word, last word, score)."""
        items, at = [], 0
        for i, s in self.token_scores(words, memo):
            if i > at:
                items.append((at, i - 1, -DRIFT * (i - at)))
            items.append((i, i, s))
            at = i + 1
        return maximal_segments(items)

    def e_value(self, n_words: int, score: float) -> float:
        return self.scale * n_words * math.exp(-min(self.rate * score, 600.0))

    def evidence(self, words: list[str], memo=None) -> tuple[float, float]:
        """(-log10 of the best segment's E, held to 0..12; log2(1 + significant passages))."""
        found = self.segments(words, memo)
        if not found:
            return 0.0, 0.0
        e = [self.e_value(len(words), s) for _, _, s in found]
        return min(max(-math.log10(max(min(e), 1e-300)), 0.0), 12.0), math.log2(1 + sum(x <= SIGNIFICANT for x in e))

    def score(self, text: str | None, memo=None) -> float:
        a, b = self.evidence(words_of(text), memo)
        z = self.weights[0] + self.weights[1] * a + self.weights[2] * b
        return 1.0 / (1.0 + math.exp(-max(min(z, 30.0), -30.0)))


def unit_scores(counts: DataFrame, n_toxic: int, n_clean: int, n_units: int, total: int) -> DataFrame:
    """(unit, score) of the units with a significant log-odds ratio.

    counts: (unit, toxic, clean) texts that hold the unit; n_units and total: their number and the sum of all counts.
    """
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    # the prior follows the background: PRIOR for a unit of up to the average share, in proportion above
    share = (toxic + clean) / F.lit(float(max(1, total)))
    prior = PRIOR * F.greatest(F.lit(1.0), n_units * share)
    a, b = toxic + prior, clean + prior
    odds = (F.log(a) - F.log(F.greatest(F.lit(n_toxic + 1.0) - toxic, F.lit(0.5)) + prior)
            - F.log(b) + F.log(F.greatest(F.lit(n_clean + 1.0) - clean, F.lit(0.5)) + prior))
    error = F.sqrt(1 / a + 1 / b)
    return (counts.select("unit", odds.alias("odds"), error.alias("error"))
            .where(F.abs("odds") >= LEAST_Z * F.col("error"))
            .select("unit", (F.signum("odds") * (F.abs("odds") - F.col("error"))).alias("score"))
            .where(F.abs("score") >= LEAST_SCORE))


def solve_rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * value)) = 1, by bisection."""
    if not (values > 0).any() or (values * shares).sum() >= 0:
        return 1.0 if not (values > 0).any() else 0.05
    low, high = 0.0, 1.0

    def excess(r):
        return float((shares * np.exp(np.minimum(r * values, 600.0))).sum()) - 1.0

    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return max(high, 0.05)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column of the result is the intercept."""
    d = np.column_stack([np.ones(len(y)), x])
    w = np.zeros(d.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (d.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d + penalty + 1e-9 * np.eye(d.shape[1])
        w = w + np.linalg.solve(h, d.T @ (y - p) - penalty @ w)
    return w


def fit_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 3, left_out: int = 1,
              fit_rows: int = FIT_ROWS) -> ToxicModel:
    """Fit on at most ``fit_rows`` labelled documents; of near copies one text counts."""
    @F.pandas_udf("long")
    def family(texts: pd.Series) -> pd.Series:
        return pd.Series([family_of(words_of(t)) for t in texts], dtype="int64")

    sample = shared_table(labelled_sample(docs, labels, "toxic", modulus, left_out, fit_rows)
                          .select("doc_id", "text", "y", family("text").alias("family")), "toxic-sample")
    # one id per family and label: at most fit_rows ids
    kept = sample.groupBy("family", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    single = sample.join(F.broadcast(kept), "doc_id", "left_semi").dropDuplicates(["doc_id"])

    def count_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = (Counter(), Counter())
        n = [0, 0]

        def rows():
            units = list(by[0].keys() | by[1].keys())
            return pd.DataFrame({"unit": units + ["", ""],      # the empty unit carries the number of texts
                                 "toxic": [by[1][u] for u in units] + [n[1], 0],
                                 "clean": [by[0][u] for u in units] + [n[0], 0]})
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                by[int(y)].update(units_of(words_of(text)))
                n[int(y)] += 1
            if len(by[0]) + len(by[1]) > 400_000:       # hand on what is counted, go on with little memory
                yield rows()
                by[0].clear(), by[1].clear()
                n[:] = [0, 0]
        yield rows()

    counts = shared_table(single.select("text", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
                          .mapInPandas(count_units, "unit string, toxic long, clean long")
                          .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")),
                          "toxic-counts")
    totals = counts.agg(F.sum(F.when(F.col("unit") == "", F.col("toxic"))).alias("nt"),
                        F.sum(F.when(F.col("unit") == "", F.col("clean"))).alias("nc"),
                        F.sum(F.when(F.col("unit") != "", F.col("toxic") + F.col("clean"))).alias("total"),
                        F.count("*").alias("units")).first()
    if not totals["nt"] or not totals["nc"]:
        return ToxicModel()
    found = unit_scores(counts.where("unit <> ''"), totals["nt"], totals["nc"], totals["units"] - 1,
                        totals["total"] or 0).collect()     # units of at most fit_rows texts
    model = ToxicModel({r["unit"]: r["score"] for r in found})

    # background scores of clean texts -> lambda and K -> calibration
    scores = model.scores

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the clean texts: length and best segment of each, and how often each token score occurs."""
        m, memo, tally, texts = ToxicModel(scores), {}, Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                if y:
                    continue
                words = words_of(text)
                if len(memo) > 400_000:
                    memo.clear()
                tally.update(round(s, 1) for _, s in m.token_scores(words, memo))
                texts[len(words), max((s for _, _, s in m.segments(words, memo)), default=0.0)] += 1
        rows = [(None, None, v, c) for v, c in tally.items()] + [(n, best, None, c) for (n, best), c in texts.items()]
        yield pd.DataFrame(rows, columns=["n", "best", "value", "times"])

    # at most a row per fitting text and one per score in tenths
    seen = (single.mapInPandas(evidence, "n long, best double, value double, times long")
            .groupBy("n", "best", "value").agg(F.sum("times").alias("times")).collect())
    texts = sorted((r["n"], r["best"], r["times"]) for r in seen if r["n"] is not None)
    tally = Counter({r["value"]: r["times"] for r in sorted((r for r in seen if r["n"] is None), key=lambda r: r["value"])})
    n_words = sum(n * times for n, _, times in texts)
    top = max(scores.values(), default=1.0)
    tally[round(top, 1)] += 0.5                          # never certain that clean texts lack them
    plain = max(n_words - sum(tally.values()), 1.0)
    values = np.array([-DRIFT, *tally])
    weights = np.array([plain, *tally.values()], dtype=float)
    model.rate = solve_rate(values, weights / weights.sum())
    spread = sum(times * n * math.exp(-min(model.rate * best, 600.0)) for n, best, times in texts)
    model.scale = sum(times for *_, times in texts) / max(spread, 1e-9)
    rate, scale = model.rate, model.scale

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, memo = ToxicModel(scores, rate, scale), {}
        for batch in batches:
            if len(memo) > 400_000:
                memo.clear()
            yield pd.DataFrame([(int(y), *m.evidence(words_of(t), memo)) for t, y in zip(batch["text"], batch["y"])],
                               columns=["y", "a", "b"])

    points = single.mapInPandas(calibrate, "y int, a double, b double").toPandas().sort_values(["y", "a", "b"])
    w = fit_logistic(points[["a", "b"]].to_numpy(), points["y"].to_numpy(dtype=float))
    model.weights = tuple(float(v) for v in w)
    return model


def toxic_score(text: Column, model: ToxicModel) -> Column:
    """A text column's score, 0 to 1."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, float] = {}
        for texts in batches:
            out = []
            for t in texts:
                if len(memo) > 400_000:
                    memo.clear()
                out.append(model.score(t, memo))
            yield pd.Series(out, dtype="float64")

    return score(text)


def toxic_passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, first_word, last_word, passage, score, e_value): every significant passage of every text."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                for a, b, s in model.segments(words):
                    e = model.e_value(len(words), s)
                    if e <= SIGNIFICANT:
                        out.append((doc_id, a, b, " ".join(words[a:b + 1]), s, e))
            yield pd.DataFrame(out, columns=["doc_id", "first_word", "last_word", "passage", "score", "e_value"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInPandas(
        find, "doc_id long, first_word long, last_word long, passage string, score double, e_value double")


def score_toxic(docs: DataFrame, model: ToxicModel, modulus: int = 3, left_out: int = 1,
                threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    return (docs.select("doc_id", (crc_mod("doc_id", modulus) == left_out).alias("held_out"),
                        toxic_score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
