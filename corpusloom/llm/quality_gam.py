"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of surface features. Cyclic boosting visits the
features in turn and fits a shallow tree to the current residuals of one
feature at a time; the trees of a feature add up to one lookup table over its
bins. The pairs of features whose joint table explains most of what is left
are boosted next, by quadrant trees. A text's score is the logistic function
of the intercept plus one table entry per feature and per pair, added for a
whole batch at a time.

Defined results: a null text is scored as the empty text, all of whose features
are 0; texts are read whole; repeated rows are scored alike; with no labelled
row the score is 0.5, with one label only it is that label's smoothed share;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc_mod, labelled_sample

FIT_ROWS = 20_000       # labelled rows the model is fitted on, at most
MAX_BINS = 32
ROUNDS = 60
PAIR_ROUNDS = 30
PAIRS = 8
RATE = 0.15
LEAVES = 4
MIN_HESSIAN = 2.0       # least curvature a leaf rests on
RIDGE = 1.0

FEATURES = ("log_bytes", "upper_share", "lower_share", "digit_share", "space_share", "line_share", "mark_share",
            "odd_mark_share", "high_share", "byte_entropy", "word_length", "longest_word", "distinct_words",
            "distinct_pairs", "repeat_share", "lone_mark_share", "distinct_lines", "marks_per_word")


def _byte_classes() -> np.ndarray:
    """One column per byte class: upper, lower, digit, space, line end, mark, odd mark, high byte."""
    table = np.zeros((256, 8))
    for b in range(256):
        c = chr(b)
        table[b, 0] = "A" <= c <= "Z"
        table[b, 1] = "a" <= c <= "z"
        table[b, 2] = "0" <= c <= "9"
        table[b, 3] = c in " \t\r\v\f"
        table[b, 4] = c == "\n"
        table[b, 5] = 0x21 <= b < 0x7F and not c.isalnum()
        table[b, 6] = 0x21 <= b < 0x7F and not c.isalnum() and c not in ".,;:?'\"()-"
        table[b, 7] = b >= 0x80
    return table


_CLASSES = _byte_classes()


def text_features(text: str | None) -> np.ndarray:
    """The feature row of one whole text."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digit, space, lines, marks, odd, high = counts @ _CLASSES
    shares = counts[counts > 0] / n
    words = raw.split()
    w = max(len(words), 1)
    pairs = list(zip(words, words[1:]))
    distinct = set(words)
    split = raw.split(b"\n")
    out[:] = (np.log1p(n), upper / n, lower / n, digit / n, space / n, lines / n, marks / n, odd / n, high / n,
              -(shares * np.log2(shares)).sum(), (n - space - lines) / w, max(map(len, distinct), default=0),
              len(distinct) / w, len(set(pairs)) / max(len(pairs), 1),
              sum(a == b for a, b in pairs) / max(len(pairs), 1),
              sum(len(x) == 1 and not x.isalnum() for x in words) / w,
              len(set(split)) / len(split), marks / w)
    return out


@dataclass
class GamModel:
    """Intercept, bin edges and lookup tables; ``pairs`` index two features each."""
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) \
            if len(self.edges) else np.zeros((len(x), 0), dtype=np.int64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[b[:, i], b[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree_table(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, spread over the bins, of a greedy tree with at most LEAVES leaves."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            cut = np.arange(a + 1, b)
            gl, hl = cg[cut] - cg[a], ch[cut] - ch[a]
            gr, hr = cg[b] - cg[cut], ch[b] - ch[cut]
            gain = _gain(gl, hl) + _gain(gr, hr) - _gain(cg[b] - cg[a], ch[b] - ch[a])
            gain[(hl < MIN_HESSIAN) | (hr < MIN_HESSIAN)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], k, int(cut[at]))
        if best[1] is None:
            break
        a, b = leaves[best[1]]
        leaves[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    table = np.zeros(len(g))
    for a, b in leaves:
        table[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return table


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best pair of cuts of a two-way histogram: (gain, values spread over the cells)."""
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    gain = np.full((g.shape[0] - 1, g.shape[1] - 1), -_gain(tg, th))
    low = np.full_like(gain, np.inf)
    parts = []
    for rows, cols in ((0, 0), (0, 1), (1, 0), (1, 1)):
        qg, qh = cg[:-1, :-1], ch[:-1, :-1]
        if rows and cols:
            qg, qh = (t - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1] for t, c in ((tg, cg), (th, ch)))
        elif rows:
            qg, qh = cg[-1:, :-1] - qg, ch[-1:, :-1] - qh
        elif cols:
            qg, qh = cg[:-1, -1:] - qg, ch[:-1, -1:] - qh
        parts.append(qg / (qh + RIDGE))
        gain += _gain(qg, qh)
        low = np.minimum(low, qh)
    gain[low < MIN_HESSIAN / 4] = 0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    table = np.empty_like(g)
    table[:i + 1, :j + 1], table[:i + 1, j + 1:] = parts[0][i, j], parts[1][i, j]
    table[i + 1:, :j + 1], table[i + 1:, j + 1:] = parts[2][i, j], parts[3][i, j]
    return float(gain[i, j]), table


def fit_gam(x: np.ndarray, y: np.ndarray) -> GamModel:
    """Fit on a feature matrix and 0/1 labels."""
    n = len(y)
    if n == 0:
        return GamModel(0.0, [], [], [], [])
    share = (y.sum() + 1.0) / (n + 2.0)
    intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return GamModel(intercept, [], [], [], [])
    edges = []
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, MAX_BINS + 1)[1:-1]))
        edges.append(cuts[cuts > x[:, j].min()])
    model = GamModel(intercept, edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    b = model.bins(x)
    total = np.full(n, intercept)

    def residuals():
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = residuals()
            size = len(table)
            step = RATE * _tree_table(np.bincount(b[:, j], g, size), np.bincount(b[:, j], h, size))
            table += step
            total += step[b[:, j]]

    def joint(i, j):
        shape = (len(model.tables[i]), len(model.tables[j]))
        cell = b[:, i] * shape[1] + b[:, j]
        g, h = residuals()
        return [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]

    ranked = sorted(((-_quadrants(*joint(i, j))[0], i, j)
                     for i in range(x.shape[1]) for j in range(i + 1, x.shape[1])))
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = RATE * _quadrants(*joint(i, j))[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, left_out: int = 0,
                fit_rows: int = FIT_ROWS) -> GamModel:
    """Fit on at most ``fit_rows`` labelled documents; their feature rows come to the driver, not their texts."""
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in texts])

    rows = (labelled_sample(docs, labels, "quality", modulus, left_out, fit_rows)
            .select("doc_id", "y", features("text").alias("x")).toPandas()
            .sort_values(["doc_id"], kind="stable"))
    # repeated rows of one id arrive in any order: sort their features too
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["doc_id"].to_numpy()))
    return fit_gam(x[order], rows["y"].to_numpy(dtype=float)[order])


def quality_score(text: Column, model: GamModel) -> Column:
    """A text column's score, 0 to 1."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([text_features(t) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pd.Series(model.score(x))

    return score(text)


def score_quality(docs: DataFrame, model: GamModel, modulus: int = 5, left_out: int = 0,
                  threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    return (docs.select("doc_id", (crc_mod("doc_id", modulus) == left_out).alias("held_out"),
                        quality_score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
