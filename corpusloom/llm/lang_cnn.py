"""Language identification with a byte convolutional network.

A text is cut into windows of a fixed number of bytes (spaces stand for every
run of other ASCII than letters). Filters of several widths slide over the
window's embedded bytes; each filter's largest response, through a rectifier,
feeds a softmax over the learned languages. Training is plain numpy on labelled
windows; scoring runs the trained filters over batches of windows from Arrow
batches and averages a text's window probabilities.

For scoring, a filter over embedded bytes is a sum of one table row per byte of
its window, so the convolution of a batch is a few table look-ups and additions.

Defined results: `und` with score 0 for a null text and a text without a letter,
and for every text if there is no labelled row; all windows of a text count,
whatever its length; repeated rows are predicted alike; with one language only
that language; of equally likely languages the first by name; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import crc_mod

WINDOW = 128            # bytes
FIT_ROWS = 2_000        # labelled rows per language, at most
FIT_TOTAL = 12_000      # labelled rows in all, at most; languages take turns
SALTS = 64              # parts a language's rows are ranked in, each giving twice its share
FIT_WINDOWS = 4         # windows of each of those texts, spread over its length
FIT_CHARS = 400         # characters read at the beginning of each such window
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 12            # per width
EPOCHS = 4
BATCH = 128
BLOCK = 64              # windows scored at once: their responses stay in the processor cache
RATE = 0.004
SEED = 7

_OTHER = re.compile(rb"[\x00-@\[-`{-\x7f]+")
_MAYBE_LETTER = re.compile(r"[^\W\d_]")      # also signs such as \u00bd and \u00b2, which are numbers


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter of any script."""
    return any(m.group().isalpha() for m in _MAYBE_LETTER.finditer(text or ""))


def window_bytes(text: str | None) -> np.ndarray:
    """All windows of a text as a matrix of bytes; the last one is filled up with spaces."""
    raw = _OTHER.sub(b" ", (text or "").encode("utf-8", "surrogatepass").lower()).strip()
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b" "), dtype=np.uint8).reshape(n, WINDOW)


@dataclass
class LangModel:
    """Languages, byte embedding, one filter bank per width, output layer."""
    langs: list[str]
    embedding: np.ndarray               # 256 x EMBEDDING
    banks: list[np.ndarray]             # width x EMBEDDING x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray                     # (widths * FILTERS) x languages
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """Per width, for each byte of the filter: 256 x FILTERS rows to add up."""
        return [[(self.embedding @ bank[k]).astype(np.float32) for k in range(len(bank))] for bank in self.banks]

    def logits(self, windows: np.ndarray, tables=None) -> np.ndarray:
        tables = self.tables() if tables is None else tables
        pooled = []
        for rows, bias in zip(tables, self.biases):
            length = windows.shape[1] - len(rows) + 1
            total = rows[0][windows[:, :length]]
            for k in range(1, len(rows)):
                total += rows[k][windows[:, k:k + length]]
            pooled.append(np.maximum(total.max(axis=1) + bias, 0))
        return np.concatenate(pooled, axis=1) @ self.out + self.out_bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, y: np.ndarray, langs: list[str]) -> LangModel:
    """Cross-entropy training by Adam over mini-batches, classes weighted alike."""
    rng = np.random.default_rng(SEED)
    k = len(langs)
    params = [rng.normal(0, 0.5, (256, EMBEDDING))]
    params += [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, (1 / (len(WIDTHS) * FILTERS)) ** 0.5, (len(WIDTHS) * FILTERS, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = len(y) / (k * np.maximum(np.bincount(y, minlength=k), 1))
    n_w, step = len(WIDTHS), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(y), BATCH):
            pick = order[start:start + BATCH]
            x, t = windows[pick], y[pick]
            emb, banks, biases, out, out_bias = params[0], params[1:1 + n_w], params[1 + n_w:1 + 2 * n_w], *params[-2:]
            e = emb[x]                                              # batch x WINDOW x EMBEDDING
            pooled, where = [], []
            for bank, bias in zip(banks, biases):
                length = x.shape[1] - len(bank) + 1
                z = sum(e[:, j:j + length] @ bank[j] for j in range(len(bank)))
                at = z.argmax(axis=1)                               # batch x FILTERS
                where.append(at)
                pooled.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + bias)
            pre = np.concatenate(pooled, axis=1)
            h = np.maximum(pre, 0)
            p = softmax(h @ out + out_bias)
            p[np.arange(len(t)), t] -= 1
            d = p * (weight[t] / len(t))[:, None]
            grads = [np.zeros_like(v) for v in params]
            grads[-2], grads[-1] = h.T @ d, d.sum(axis=0)
            dh = (d @ out.T) * (pre > 0)
            rows = np.arange(len(t))[:, None]
            for i, bank in enumerate(banks):
                dz = dh[:, i * FILTERS:(i + 1) * FILTERS]
                grads[1 + n_w + i] = dz.sum(axis=0)
                for j in range(len(bank)):
                    seen = x[rows, where[i] + j]                    # the byte under filter row j at the maximum
                    grads[1 + i][j] = np.einsum("bfe,bf->ef", emb[seen], dz)
                    np.add.at(grads[0], seen, dz[:, :, None] * bank[j].T[None])
            step += 1
            for v, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                v -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return LangModel(langs, params[0], params[1:1 + n_w], params[1 + n_w:1 + 2 * n_w], params[-2], params[-1])


def fit_langs(docs: DataFrame, modulus: int = 4, left_out: int = 2, fit_rows: int = FIT_ROWS,
              fit_total: int = FIT_TOTAL) -> LangModel | None:
    """Fit on windows of at most ``fit_rows`` texts per language, chosen by a hash of doc_id, ``fit_total`` in all.

    Only the pieces of text the windows are cut from come to the driver, and ids are
    picked before any text is read.
    """
    # the first of each language by hash, found inside salted parts first: a large language is split
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    candidates = (docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
                  .where(crc_mod("doc_id", modulus) != left_out).select("doc_id", "lang")
                  .withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
                  .withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order)))
                  .where(F.col("rank") <= -(-2 * fit_rows // SALTS)))
    picked = (candidates.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
              .where(F.col("rank") <= fit_rows)
              .orderBy("rank", *order, "lang").limit(fit_total)
              .select("doc_id", F.col("lang").alias("y")).distinct())
    length = F.length("text")
    pieces = F.array(*[F.substring("text", 1 + (F.greatest(length - FIT_CHARS, F.lit(0)) * F.lit(i)
                                                / F.lit(FIT_WINDOWS - 1)).cast("int"), F.lit(FIT_CHARS))
                       for i in range(FIT_WINDOWS)])
    # at most fit_total pairs of an id and a language: a bounded table
    rows = (docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
            .select("doc_id", "y", F.array_distinct(pieces).alias("pieces")).toPandas())
    keyed = sorted((int(i), y, list(p)) for i, y, p in zip(rows["doc_id"], rows["y"], rows["pieces"]))
    langs = sorted({y for _, y, _ in keyed})
    if not langs:
        return None
    number = {lang: i for i, lang in enumerate(langs)}
    windows, y = [], []
    for _, lang, parts in keyed:
        for part in parts:
            if has_letter(part):
                windows.append(window_bytes(part)[:1])
                y.append(number[lang])
    if not windows:
        return None
    return train(np.concatenate(windows), np.array(y), langs)


def predict_langs(docs: DataFrame, model: LangModel | None, modulus: int = 4, left_out: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = model.tables() if model else None
        for texts in batches:
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            waiting: list[tuple[int, np.ndarray]] = []
            total = np.zeros((len(texts), len(model.langs) if model else 0))

            def flush():
                """Score the windows held so far, a bounded block at a time."""
                if not waiting:
                    return
                block = np.concatenate([w for _, w in waiting])
                owner = np.repeat([i for i, _ in waiting], [len(w) for _, w in waiting])
                for a in range(0, len(block), BLOCK):
                    z = model.logits(block[a:a + BLOCK], tables)
                    np.add.at(total, owner[a:a + BLOCK], softmax(z))
                waiting.clear()

            held = 0
            for i, text in enumerate(texts):
                if model and has_letter(text):
                    w = window_bytes(text)
                    waiting.append((i, w))
                    held += len(w)
                    if held >= 4096:
                        flush()
                        held = 0
            flush()
            for i in np.flatnonzero(total.sum(axis=1) > 0):
                best = int(total[i].argmax())
                names[i], scores[i] = model.langs[best], total[i, best] / total[i].sum()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return (docs.select("doc_id", (crc_mod("doc_id", modulus) == left_out).alias("held_out"),
                        predict("text").alias("_p"))
            .select("doc_id", "held_out", "_p.lang_pred", "_p.score"))
