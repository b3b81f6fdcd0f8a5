"""Language-model scores from Brown class-based n-grams.

Words are assigned to classes by the exchange algorithm and a text's probability
is a product of class transitions and word emissions:

    P(w | previous) = P(class(w) | class(previous)) * P(unit(w) | class(w)) * P(w | unit(w))

Units are what has a class. Three kinds of words get theirs in three ways:

* words with at least one in FREQUENT of all training tokens (at most FREQUENT of them)
  are moved between classes by exchange steps on the driver, with the endings below;
* all other words that occur LEAST_COUNT times or more are placed by tasks, each
  from its own contexts: its neighbours' classes are counted over all training texts,
  and it joins the class to whose likelihood they add most (the first-order gain of
  an exchange move into it), PLACINGS times, the neighbours' classes being those of the time before;
* words below that count, which have too few contexts, and unseen words belong to the unit of their
  ending (a hash of their last three bytes). Within such a unit the word's own count
  decides, plus one half, with one half left for unseen words.

Transitions are counted again once all words have their classes, and smoothed with class frequencies
(Witten-Bell).

Everything counted is counted over all training texts: word counts are summed
map-side and by one shuffle; the most frequent words (at
most HEAD, with LEAST_COUNT occurrences or in the exchange) travel to the tasks with the model; all other words stay
in tables, their counts and classes are joined where they occur. HEAD decides where a word is looked up, not what becomes of it: the
scores are the same for any HEAD. The training texts are written once as numbers of head words with the other
words beside them, which the later counts read. These count the other words by their endings; the pairs of
neighbours that hold such a word are a table of their own, which corrects the counts by the words' classes.

In each exchange step tasks sum every unit's neighbours by class (one row per unit,
at most FREQUENT + ENDINGS + 1 of them) and half of the units move in turn, each to the
class that raises the likelihood most; the neighbours' classes are those at the
beginning of the step, the class counts those after all earlier moves. Of equal gains the
class with the smallest number counts; equally frequent words are taken by their bytes.

Defined results: a null text counts as empty and holds one end token; repeated
rows are scored, and train, as often as they occur; without training texts
every word is unseen and the base score is 0; texts are read whole; an empty
table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, shared_table

CLASSES = 64
FREQUENT = 1 << 13      # in the exchange: at least 1 in so many tokens
LEAST_COUNT = 3         # placed by its contexts: at least so many occurrences
PLACINGS = 2
ENDINGS = 1 << 10       # units of other words, by their ending
HEAD = 1 << 20          # carried with the model: at most so many words
ROUNDS = 8
FLUSH = 300_000         # distinct words or pairs a task counts before it hands them on
SLICE = 2 << 20         # bytes of text that a task cuts into words at a time
BLOCKS = 1 << 10        # groups of words whose contexts are summed together


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ending(word: bytes) -> int:
    """The number of a word's ending."""
    return zlib.crc32(word[-3:]) % ENDINGS


def _slices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)]):
            if a < b:
                yield batch.slice(a, b - a)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, as ``words_of`` finds them, and each text's offset among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    there = pc.not_equal(pc.binary_length(words), 0)     # a text's first and last piece may be empty
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return words.filter(there).cast(pa.binary()), before[lists.offsets.to_numpy()]


def _bytes(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


class _Places(dict):
    """A word's place in the head, or -1 - ending."""

    def __init__(self, words: pa.Array):
        super().__init__(zip(_bytes(words), range(len(words))))

    def __missing__(self, word: bytes) -> int:
        return -1 - ending(word)


def _numbered(texts: pa.Array, places: _Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The numbers of all words of some texts, each text's offset among them, each word's place among the
    distinct ones, and these."""
    words, offsets = _split(texts)
    coded = words.dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy()
    numbers = np.fromiter(map(places.__getitem__, _bytes(distinct)), np.int64, len(distinct))
    return numbers[codes], offsets, codes, distinct


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n): every word's count over all texts (one string column)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def fold():
            table = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return table.rename_columns({"n_sum": "n"}).select(["word", "n"])

        for batch in _slices(batches):
            found = _split(batch.column(0))[0].value_counts()
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            n_held += len(found)
            if n_held > 4 * FLUSH:
                table = fold()
                held, n_held = [table], len(table)
                if n_held > FLUSH:
                    yield from table.to_batches()
                    held, n_held = [], 0
        if held:
            yield from fold().to_batches()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class BrownModel:
    """Head words with their counts and units; unit classes; log10 tables; the table of the other words' counts."""
    key: str                        # names the model in a worker's cache
    tokens: int                     # N
    types: int                      # V, the end token included
    texts: int
    words: pa.Array                 # the head; as an array a small part of a list's memory on the driver and in closures
    head_count: np.ndarray
    head_unit: np.ndarray           # the last unit is the end token
    unit_class: np.ndarray
    emission: np.ndarray            # log10 P(unit | class)
    inside: np.ndarray              # log10 of the mass that words share inside a unit; 0 for frequent words
    transition: np.ndarray          # log10 P(class | class)
    class_mass: np.ndarray          # log10 of the mass that units share inside a class
    counts: DataFrame               # (word, n, class) of all words that aren't in the head; no class: by the ending
    any_rare: bool                  # some of these have a class

    @property
    def head(self) -> list[bytes]:
        return self.words.to_pylist()

    def without_table(self) -> "BrownModel":
        return BrownModel(**{**self.__dict__, "counts": None})


def word_numbers(texts: DataFrame, head: list[bytes] | pa.Array, with_rest: bool = False) -> DataFrame:
    """(ids array, rest array): a text's words as places in the head, or -1 - ending; the latter words in their order.

    with_rest: False leaves ``rest`` empty.
    """
    words = pa.array(head, pa.binary())

    def number_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(words)
        for batch in _slices(batches):
            numbers, offsets, codes, distinct = _numbered(batch.column(0), places)
            out = numbers < 0 if with_rest else np.zeros(len(numbers), dtype=bool)
            rest = distinct.take(pa.array(codes[out]))
            rest_offsets = np.concatenate([[0], np.cumsum(out)])[offsets]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(numbers, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(rest_offsets, pa.int32()), rest)], names=["ids", "rest"])

    return texts.mapInArrow(number_them, "ids array<int>, rest array<binary>")


def _with_ends(values: np.ndarray, offsets: np.ndarray, end: int) -> np.ndarray:
    """Texts' numbers in a row, ``end`` before, between and after them."""
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.full(len(values) + len(offsets), end, dtype=np.int64)
    out[np.arange(len(values)) + texts + 1] = values
    return out


def _sequences(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """The numbers of some texts in a row; ``end`` before, between and after them."""
    for whole in batches:
        for a in range(0, whole.num_rows, 500):
            column = whole.column(0).slice(a, 500)
            offsets = column.offsets.to_numpy()
            yield _with_ends(column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0], end)


def _unit_table(head_unit: np.ndarray, n_own: int, end: int) -> np.ndarray:
    """The unit of every number of a sequence whose text ends are len(head_unit)."""
    return np.concatenate([head_unit, [end], n_own + np.arange(ENDINGS)[::-1]])     # -1 - ending counts from the table's end


def _sums(numbers: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers in ascending order and how often each occurs, handed on in parts of bounded size."""
    held, n_held = [], 0
    keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def fold():
        nonlocal keys, sums, held, n_held
        new, n = np.unique(np.concatenate(held), return_counts=True)
        joined, both = np.concatenate([keys, new]), np.concatenate([sums, n])
        order = np.argsort(joined, kind="stable")       # two ascending runs are merged
        joined = joined[order]
        first = np.flatnonzero(np.diff(joined, prepend=-1))
        keys, sums, held, n_held = joined[first], np.add.reduceat(both[order], first) if len(first) else both, [], 0

    for some in numbers:
        held.append(some)
        n_held += len(some)
        if n_held > 4 * FLUSH:
            fold()
            if len(keys) > 8 * FLUSH:
                yield keys, sums
                keys, sums = keys[:0], sums[:0]
    if held:
        fold()
    yield keys, sums


def _summed(numbers: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(pair, n): how often each number occurs."""
    for keys, sums in _sums(numbers):
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])


def _in_blocks(sums: Iterator[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """(block, slots, n): counts of word * 2k + context, the words dealt to BLOCKS blocks in turn; a slot is
    (word's place in its block) * 2k + context."""
    for keys, n in sums:
        word, context = np.divmod(keys, 2 * k)
        place, block = np.divmod(word, BLOCKS)
        order = np.argsort(block.astype(np.int16), kind="stable")
        slots, n, block = (place * (2 * k) + context)[order].astype(np.int32), n[order], block[order]
        offsets = np.searchsorted(block, np.arange(BLOCKS + 1)).astype(np.int32)
        out = pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS), pa.int32()),
                                          pa.ListArray.from_arrays(pa.array(offsets), pa.array(slots)),
                                          pa.ListArray.from_arrays(pa.array(offsets), pa.array(n))],
                                         names=["block", "slots", "n"])
        yield out.filter(pa.array(np.diff(offsets) > 0))


def bigram_rows(numbers: DataFrame, head_unit: np.ndarray, n_own: int, end: int) -> DataFrame:
    """(unit, after array, n_after array, before array, n_before array): a unit's neighbours over all texts."""
    size = end + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _unit_table(head_unit, n_own, end)
        runs = (table[s] for s in _sequences(batches, len(head_unit)))
        yield from _summed(units[:-1] * size + units[1:] for units in runs)

    pairs = (numbers.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
             .select((F.col("pair") / size).cast("long").cast("int").alias("a"),
                     (F.col("pair") % size).cast("int").alias("b"), "n"))
    # at most one entry per other unit and direction: a bounded group
    entries = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("unit"), F.col("b").alias("other"), F.col("n"), F.lit(True).alias("after")),
        F.struct(F.col("b").alias("unit"), F.col("a").alias("other"), F.col("n"), F.lit(False).alias("after"))))
        .alias("e")).select("e.*")
    return entries.groupBy("unit").agg(F.collect_list(F.struct("other", "n", "after")).alias("e")).select(
        "unit", F.filter("e", lambda x: x["after"]).alias("x"), F.filter("e", lambda x: ~x["after"]).alias("y")
    ).select("unit", F.col("x.other").alias("after"), F.col("x.n").alias("n_after"),
             F.col("y.other").alias("before"), F.col("y.n").alias("n_before"))


def neighbour_classes(rows: DataFrame, unit_class: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per unit its neighbours' counts by class, after and before it, and its pairs with itself.

    units * (2k + 1) numbers come to the driver: at most (FREQUENT + ENDINGS + 1) rows of them.
    """
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for unit, x, nx, y, ny in zip(*(batch[c] for c in ("unit", "after", "n_after", "before", "n_before"))):
                x, y = np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64)
                nx, ny = np.asarray(nx, dtype=float), np.asarray(ny, dtype=float)
                out.append((unit, np.bincount(unit_class[x], nx, k), np.bincount(unit_class[y], ny, k),
                            float(nx[x == unit].sum())))
            yield pd.DataFrame(out, columns=["unit", "after", "before", "loop"])

    found = rows.mapInPandas(add, "unit int, after array<double>, before array<double>, loop double").toPandas()
    after, before = np.zeros((len(unit_class), k)), np.zeros((len(unit_class), k))
    loop = np.zeros(len(unit_class))
    if len(found):
        at = found["unit"].to_numpy(dtype=np.int64)
        after[at], before[at] = np.stack(found["after"]), np.stack(found["before"])
        loop[at] = found["loop"]
    return after, before, loop


def class_matrix(after: np.ndarray, unit_class: np.ndarray) -> np.ndarray:
    """Transition counts between classes."""
    out = np.zeros((after.shape[1], after.shape[1]))
    np.add.at(out, unit_class, after)
    return out


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(counts: np.ndarray) -> float:
    """The part of the class-bigram log-likelihood that depends on the classes."""
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(axis=0)).sum() - _xlogx(counts.sum(axis=1)).sum())


def without_unit(counts: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, loop: float) -> np.ndarray:
    """The class matrix without one unit's pairs. after, before: without its pairs with itself."""
    c = counts.copy()
    c[own] -= after
    c[:, own] -= before
    c[own, own] -= loop
    return np.maximum(c, 0.0)


def class_gains(c: np.ndarray, after: np.ndarray, before: np.ndarray, loop: float) -> np.ndarray:
    """Likelihood that a unit adds in each class of a matrix it was taken from. Class 0 is the end token's alone."""
    rows, cols = c.sum(axis=1), c.sum(axis=0)
    base = _xlogx(c)
    gain = (_xlogx(c + after[None, :]) - base).sum(axis=1) + (_xlogx(c + before[:, None]) - base).sum(axis=0)
    d = np.diag(c)      # the cell of the class with itself gains both and the loop
    gain += _xlogx(d + after + before + loop) + _xlogx(d) - _xlogx(d + after) - _xlogx(d + before)
    # sums of the class's own row and column; the neighbours' sums grow alike wherever the unit goes,
    # but for those that are the class's own
    row, col = rows + before, cols + after
    gain -= _xlogx(row + after.sum() + loop) - _xlogx(row) + _xlogx(col + before.sum() + loop) - _xlogx(col)
    gain[0] = -np.inf
    return gain


def exchange(rows: DataFrame, unit_count: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class matrix) after the exchange rounds; the likeliest state met is returned."""
    size = len(unit_count)
    end = size - 1
    order = np.argsort(-unit_count[:end], kind="stable")
    unit_class = np.zeros(size, dtype=np.int64)
    unit_class[order] = 1 + np.arange(end) % max(k - 1, 1)      # frequent units first, dealt in turn
    best = None
    for step in range(2 * rounds + 1):
        after, before, loop = neighbour_classes(rows, unit_class, k)
        counts = class_matrix(after, unit_class)
        now = likelihood(counts)
        if best is None or now > best[0]:
            best = (now, unit_class.copy(), counts.copy())
        if step == 2 * rounds:
            break
        # every other unit moves, the frequent ones first, each in view of the moves before it
        for unit in order[step % 2::2].tolist():
            own = int(unit_class[unit])
            x, y = after[unit].copy(), before[unit].copy()
            if not x.sum() and not y.sum():
                continue
            x[own] = max(x[own] - loop[unit], 0.0)
            y[own] = max(y[own] - loop[unit], 0.0)
            c = without_unit(counts, own, x, y, loop[unit])
            gain = class_gains(c, x, y, loop[unit])
            to = int(np.argmax(gain))
            if gain[to] > gain[own] + 1e-9:
                unit_class[unit] = to
                c[to] += x
                c[:, to] += y
                c[to, to] += loop[unit]
                counts = c
    return best[1], best[2]


def rare_pairs(numbers: DataFrame, end: int) -> DataFrame:
    """(a int, b int, a_word, b_word binary): all neighbours of which one at least isn't in the head.

    a, b: as in the numbers, ``end`` for a text's end; the words are null for those of the head.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                rest = batch.column(1).flatten()
                for s in _sequences(iter([batch]), end):
                    out = s < 0
                    nth = np.cumsum(out) - 1
                    at = np.flatnonzero(out[:-1] | out[1:])
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(s[i], pa.int32()) for i in (at, at + 1)),
                         *(rest.take(pa.array(nth[i], pa.int64(), mask=~out[i])) for i in (at, at + 1))],
                        names=["a", "b", "a_word", "b_word"])

    return numbers.select("ids", "rest").mapInArrow(pairs, "a int, b int, a_word binary, b_word binary")


def with_classes(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """The rare pairs that hold a placed word, with a_class and b_class: the placed words' classes, null for others."""
    def of(side: str) -> DataFrame:
        return placed.select(F.col("word").alias(f"{side}_word"), F.col("class").alias(f"{side}_class"))

    # pairs without a word on one side don't go to that side's join, where they would share the key null
    none, a, b = F.lit(None).cast("int"), F.col("a_word").isNotNull(), F.col("b_word").isNotNull()
    both = pairs.where(a & b).join(of("a"), "a_word", "left").join(of("b"), "b_word", "left")
    return (both.where("a_class is not null or b_class is not null")
            .unionByName(pairs.where(a & ~b).join(of("a"), "a_word").withColumn("b_class", none))
            .unionByName(pairs.where(~a & b).join(of("b"), "b_word").withColumn("a_class", none)))


def _pair_classes(batch: pa.RecordBatch, head_unit: np.ndarray, n_own: int, unit_class: np.ndarray):
    """Of a batch a, b, a_class, b_class: the numbers, the classes, and the classes by head and ending alone."""
    numbers = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)]
    table = _unit_table(head_unit, n_own, len(unit_class) - 1)
    plain = [unit_class[table[x]] for x in numbers]
    own = [batch.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in (2, 3)]
    return numbers, [np.where(o < 0, p, o) for o, p in zip(own, plain)], plain


def _signed(pairs: Iterator[pa.RecordBatch], of_batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and what the rare pairs add to their counts, where the words' classes aren't their endings'.

    of_batch: numbers to be counted and numbers to be taken off.
    """
    def twice():
        for batch in pairs:
            more, less = of_batch(batch)
            yield np.concatenate([more * 2, less * 2 + 1])

    for keys, n in _sums(twice()):
        yield keys // 2, np.where(keys % 2, -n, n)


def rare_class_pairs(pairs: DataFrame, head_unit: np.ndarray, n_own: int, unit_class: np.ndarray, k: int) -> DataFrame:
    """(pair, n): corrections of ``class_pairs``."""
    def of_batch(batch):
        _, (a, b), (c, d) = _pair_classes(batch, head_unit, n_own, unit_class)
        return a * k + b, c * k + d

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in _signed(batches, of_batch):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    return pairs.select("a", "b", "a_class", "b_class").mapInArrow(count, "pair long, n long")


def rare_contexts(pairs: DataFrame, first: int, last: int, head_unit: np.ndarray, n_own: int,
                  unit_class: np.ndarray, k: int) -> DataFrame:
    """(block, slots, n): corrections of the contexts that ``place_words`` counts."""
    def of_batch(batch):
        (x, y), *classes = _pair_classes(batch, head_unit, n_own, unit_class)
        before, after = (np.flatnonzero((w >= first) & (w < last)) for w in (x, y))
        return [np.concatenate([(x[before] - first) * (2 * k) + b[before], (y[after] - first) * (2 * k) + k + a[after]])
                for a, b in classes]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_blocks(_signed(batches, of_batch), k)

    return pairs.select("a", "b", "a_class", "b_class").mapInArrow(count, "block int, slots array<int>, n array<long>")


def class_pairs(numbers: DataFrame, head_unit: np.ndarray, n_own: int, unit_class: np.ndarray, k: int,
                more: DataFrame | None = None) -> np.ndarray:
    """Transition counts between classes over all texts; at most k * k rows a task and on the driver.

    more: (pair, n) that count as well.
    """
    end = len(unit_class) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = unit_class[_unit_table(head_unit, n_own, end)], np.zeros(k * k, dtype=np.int64)
        for s in _sequences(batches, len(head_unit)):
            c = table[s]
            sums += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["pair", "n"])

    counted = numbers.select("ids").mapInArrow(count, "pair long, n long")
    counted = counted if more is None else counted.unionByName(more)
    found = counted.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(k * k)
    out[found["pair"].to_numpy(dtype=np.int64)] = found["n"]
    return out.reshape(k, k)


def smoothed(matrix: np.ndarray) -> np.ndarray:
    """P(class | class), smoothed with class frequencies."""
    column = matrix.sum(axis=0) + 0.5
    low = column / column.sum()
    out, kinds = matrix.sum(axis=1, keepdims=True), (matrix > 0).sum(axis=1, keepdims=True)
    return (matrix + np.maximum(kinds, 1) * low) / (out + np.maximum(kinds, 1))


def _gains(matrix: np.ndarray) -> np.ndarray:
    """What one occurrence in each context adds to each class but 0, the end token's alone."""
    move = np.log(smoothed(matrix))
    column = matrix.sum(axis=0) + 0.5
    return np.vstack([move.T, move - np.log(column / column.sum())])[:, 1:]


def _choose(matrix: np.ndarray):
    """For words with their contexts (slot, n): the best class, and n, the word's occurrences."""
    k, gain = len(matrix), _gains(matrix)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column(1)
            row = np.repeat(np.arange(len(e)), np.diff(e.offsets.to_numpy()))
            slot, n = (v.to_numpy(zero_copy_only=False) for v in e.flatten().flatten())
            contexts = np.zeros((len(e), 2 * k))
            contexts[row, slot] = n
            best = 1 + np.argmax(contexts @ gain, axis=1)
            times = contexts[:, :k].sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(times)],
                                             names=["word", "class", "n"])

    return choose


def place_rare_words(pairs: DataFrame, least_count: int, head_unit: np.ndarray, n_own: int,
                     unit_class: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(word, class, n): classes, as ``place_words`` finds them, of the rare pairs' words with ``least_count`` occurrences.

    pairs: with the words' classes of the time before, null for those that go by their ending.
    """
    k = len(matrix)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, (a, b), _ = _pair_classes(batch, head_unit, n_own, unit_class)
            words = pa.chunked_array([batch.column(4), batch.column(5)])
            there = np.flatnonzero(words.is_valid().to_numpy())
            slot = np.concatenate([b, k + a])[there]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(there)).combine_chunks(), pa.array(slot, pa.int32())],
                                             names=["word", "slot"])

    # more than HEAD words are as frequent as these: no hot keys, and few contexts to sum map-side
    return (pairs.select("a", "b", "a_class", "b_class", "a_word", "b_word").mapInArrow(slots, "word binary, slot int")
            .repartition("word").groupBy("word", "slot").agg(F.count("*").alias("n"))
            .groupBy("word").agg(F.collect_list(F.struct("slot", "n")).alias("e"))
            .mapInArrow(_choose(matrix), "word binary, class int, n long").where(F.col("n") >= F.lit(least_count)))


def place_words(numbers: DataFrame, first: int, last: int, head_unit: np.ndarray, n_own: int,
                unit_class: np.ndarray, matrix: np.ndarray, more: DataFrame | None = None) -> np.ndarray:
    """Classes of the head words from place ``first`` on, before ``last``, by their neighbours' classes over all texts.

    A word joins the class c for which the sum of log P(after | c) over the classes after it, and of
    log P(c | before) - log P(c) over those before it, is largest. Two numbers a word come to the driver.
    more: (block, slots, n) that count as well.
    """
    k, end, ends, gain = len(matrix), len(unit_class) - 1, len(head_unit), _gains(matrix)
    n_words = last - first

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unit_class[_unit_table(head_unit, n_own, end)]

        def slots():
            for s in _sequences(batches, ends):
                classes = table[s]
                at = np.flatnonzero((s >= first) & (s < last))
                word = (s[at] - first) * (2 * k)
                yield np.concatenate([word + classes[at + 1], word + k + classes[at - 1]])
        yield from _in_blocks(_sums(slots()), k)

    def choose(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key[0].as_py()
        word = np.arange(block, n_words, BLOCKS)
        contexts = np.zeros(len(word) * 2 * k)
        for batch in batches:
            slot, n = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            contexts += np.bincount(slot, n, len(contexts))
        contexts = contexts.reshape(-1, 2 * k)
        there = np.flatnonzero(contexts.any(axis=1))
        best = 1 + np.argmax(contexts[there] @ gain, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(word[there], pa.int32()), pa.array(best, pa.int32())],
                                         names=["word", "class"])

    counted = numbers.select("ids").mapInArrow(count, "block int, slots array<int>, n array<long>")
    counted = counted if more is None else counted.unionByName(more)
    # a block's batches are added up as they come, in 2k numbers for each of its words
    found = counted.groupBy("block").applyInArrow(choose, "word int, class int").toArrow()
    out = np.ones(n_words, dtype=np.int64)
    out[found["word"].to_numpy()] = found["class"].to_numpy()
    return out


def fit_brown(texts: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, frequent: int = FREQUENT,
              least_count: int = LEAST_COUNT, carried: int = HEAD) -> BrownModel:
    """Fit on all rows of a table with a string column ``text``.

    carried: at most so many words, but all of the exchange, travel with the model; any number gives the same scores.
    """
    texts = texts.select("text")
    counts = shared_table(word_counts(texts), "word-counts")
    n_texts = texts.count()
    # how many words there are of each count: at most about the root of twice the tokens' number of rows
    by_count = counts.groupBy("n").agg(F.count("*").alias("v")).orderBy(F.desc("n")).toArrow()
    times, of_times = by_count["n"].to_numpy(), by_count["v"].to_numpy()
    n_words, n_types = int((times * of_times).sum()), int(of_times.sum())
    n_tokens = n_words + n_texts
    fits = times[np.cumsum(of_times) <= carried]
    least = float(min(max(fits[-1] if len(fits) else n_tokens + 1, least_count), max(n_tokens / frequent, 2)))
    any_rare = bool(((times >= least_count) & (times < least)).any())   # words to be placed outside the head
    head = counts.where(F.col("n") >= F.lit(least)).toArrow()       # at most ``carried`` words, or those of the exchange
    head = head.take(pc.sort_indices(head, [("n", "descending"), ("word", "ascending")]))
    words, head_count = pa.array(head["word"].combine_chunks(), pa.binary()), head["n"].to_numpy()
    n_own = int((head_count >= max(n_tokens / frequent, 2)).sum())
    n_placed = max(int((head_count >= least_count).sum()), n_own)
    endings = np.fromiter(map(ending, _bytes(words[n_own:])), dtype=np.int64)

    # tokens and types of each ending, over the words that aren't in the exchange
    last = F.expr("substring(word, -3, 3)")
    its_ending = (F.crc32(last) % ENDINGS).cast("int").alias("ending")
    by_ending = (counts.where(F.col("n") < F.lit(max(n_tokens / frequent, 2))).groupBy(its_ending)
                 .agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas())
    at = by_ending["ending"].to_numpy(dtype=np.int64)
    ending_count, ending_types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    ending_count[at], ending_types[at] = by_ending["n"].to_numpy(), by_ending["v"].to_numpy()

    numbers = shared_table(word_numbers(texts, words, any_rare), "word-numbers")
    head_unit = np.concatenate([np.arange(n_own), n_own + endings])
    unit_count = np.concatenate([head_count[:n_own], ending_count, [n_texts]])
    rows = shared_table(bigram_rows(numbers.select("ids"), head_unit, n_own, n_own + ENDINGS), "neighbours")
    unit_class, matrix = exchange(rows, unit_count, classes, rounds)

    rest = counts.where(F.col("n") < F.lit(least)).select("word", "n", F.lit(None).cast("int").alias("class"))
    rare_mass = np.zeros(classes)
    if n_placed > n_own or any_rare:
        # placed words are units of their own and leave their endings
        by_exchange, moved = unit_class, endings[:n_placed - n_own]
        ending_count -= np.bincount(moved, head_count[n_own:n_placed], ENDINGS)
        ending_types -= np.bincount(moved, minlength=ENDINGS)
        pairs = rare = more = None
        if any_rare:
            pairs = shared_table(rare_pairs(numbers, len(words)), "rare-pairs")
            known = pairs.selectExpr("*", "int(null) as a_class", "int(null) as b_class")
        for turn in range(PLACINGS):
            units = head_unit, len(unit_class) - 1 - ENDINGS, unit_class
            if any_rare:
                if turn:
                    more = rare_contexts(known, n_own, n_placed, *units, classes)
                rare = shared_table(place_rare_words(known, least_count, *units, matrix), "rare-words")
            placed = place_words(numbers, n_own, n_placed, *units, matrix, more) if n_placed > n_own else unit_class[:0]
            head_unit = np.concatenate([np.arange(n_placed), n_placed + endings[n_placed - n_own:]])
            unit_class = np.concatenate([by_exchange[:n_own], placed, by_exchange[n_own:]])
            if any_rare:
                known = with_classes(pairs, rare)
                if turn < PLACINGS - 1:
                    known = shared_table(known, "rare-pairs-placed")     # for the next turn as well
                more = rare_class_pairs(known, head_unit, n_placed, unit_class, classes)
            matrix = class_pairs(numbers, head_unit, n_placed, unit_class, classes, more)
        if any_rare:
            # at most classes * ENDINGS rows
            sums = rare.groupBy("class", its_ending).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()
            at, n, v = (sums[c].to_numpy(dtype=np.int64) for c in ("ending", "n", "v"))
            ending_count -= np.bincount(at, n, ENDINGS)
            ending_types -= np.bincount(at, v, ENDINGS)
            rare_mass += np.bincount(sums["class"].to_numpy(dtype=np.int64), n + 0.5 * v, classes)
            rest = rest.where(F.col("n") < F.lit(least_count)).unionByName(rare.select("word", "n", "class"))
        unit_count = np.concatenate([head_count[:n_placed], ending_count, [n_texts]])

    mass = unit_count + 0.5
    class_mass = np.log10(np.maximum(np.bincount(unit_class, mass, classes) + rare_mass, 0.5))
    emission = np.log10(mass) - class_mass[unit_class]
    inside = np.zeros(len(unit_class))
    inside[n_placed:-1] = np.log10(ending_count + 0.5 * (ending_types + 1))
    return BrownModel(uuid.uuid4().hex, n_tokens, n_types + (n_texts > 0), n_texts, words, head_count, head_unit,
                      unit_class, emission, inside, np.log10(smoothed(matrix)), class_mass, rest, any_rare)


_WORKER: dict[str, _Places] = {}


def _score_partition(model: BrownModel):
    """Per text: what the head decides with all other words in their endings, the other words with their counts
    in the text and endings, and the pairs of neighbours that hold one: a class, or -1 - the word's place among them."""
    n_own, end = len(model.unit_class) - 1 - ENDINGS, len(model.unit_class) - 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.key not in _WORKER:
            _WORKER.clear()
            _WORKER[model.key] = _Places(model.words)
        places, ends = _WORKER[model.key], len(model.words)
        unit = _unit_table(model.head_unit, n_own, end)
        class_of, emitted = model.unit_class[unit], (model.emission - model.inside)[unit]
        log_count = np.concatenate([np.log10(model.head_count + 0.5), [np.log10(model.texts + 0.5)], np.zeros(ENDINGS)])
        # a unit of its own emits its word for certain
        emitted[:ends] += np.where(model.head_unit < n_own, 0.0, log_count[:ends])
        for batch in _slices(batches, 2):
            numbers, offsets, codes, distinct = _numbered(batch.column(2), places)
            rows, sizes = len(offsets) - 1, np.diff(offsets)
            run = _with_ends(numbers, offsets, ends)
            path, tokens = class_of[run], run[1:]
            start = offsets[:-1] + np.arange(rows)      # of each text's tokens, its end the last

            def by_text(values):
                return pa.array(np.add.reduceat(values, start))

            out = np.flatnonzero(numbers < 0)
            out_row = np.repeat(np.arange(rows), sizes)[out]
            # the other words of each text, each once
            key, nth, times = np.unique(out_row * len(distinct) + codes[out], return_inverse=True, return_counts=True)
            tail_row, tail = np.divmod(key, max(len(distinct), 1))
            tail_offsets = np.searchsorted(tail_row, np.arange(rows + 1))
            ending_of = np.zeros(len(distinct), dtype=np.int64)
            ending_of[codes[out]] = -1 - numbers[out]
            words_and_times = pa.StructArray.from_arrays(
                [distinct.take(pa.array(tail)), pa.array(times, pa.int32()), pa.array(ending_of[tail], pa.int32())],
                names=["word", "times", "ending"])
            pairs, pair_offsets = np.zeros((0, 2), dtype=np.int64), np.zeros(rows + 1, dtype=np.int64)
            if model.any_rare:
                marked = path.copy()
                marked[out + out_row + 1] = -1 - (nth - tail_offsets[out_row])
                at = np.flatnonzero((marked[:-1] < 0) | (marked[1:] < 0))
                pairs = np.column_stack([marked[at], marked[at + 1]])
                pair_offsets = 2 * np.searchsorted(at, [*start, len(tokens)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes + 1, pa.int64()),
                 by_text(((tokens >= 0) & ((tokens < ends) | (model.texts > 0))).astype(np.int64)),
                 by_text(log_count[tokens]), by_text(model.transition[path[:-1], path[1:]] + emitted[tokens]),
                 pa.ListArray.from_arrays(pa.array(tail_offsets, pa.int32()), words_and_times),
                 pa.ListArray.from_arrays(pa.array(pair_offsets, pa.int32()), pa.array(pairs.ravel(), pa.int32()))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "pairs"])

    return score


def _move_placed(model: BrownModel):
    """Adds to the scores what changes as the placed words outside the head leave their endings for their classes.

    Columns: others, with the score last, then ending, times, pairs and placed (word's place, class) of a text.
    """
    first = len(model.unit_class) - 1 - ENDINGS
    by_ending, leave = model.unit_class[first:], (model.inside - model.emission)[first:]
    transition, class_mass = model.transition, model.class_mass

    def flat(column: pa.Array):
        """An array column's values, the row of each, and the first value of each row."""
        sizes = np.diff(column.offsets.to_numpy())
        return column.flatten(), np.repeat(np.arange(len(column)), sizes), np.cumsum(sizes) - sizes

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                *kept, score, endings, times, pairs, placed = batch.columns
                endings, _, word_start = flat(endings)
                endings = endings.to_numpy(zero_copy_only=False)
                times = times.flatten().to_numpy(zero_copy_only=False)
                placed, placed_row, _ = flat(placed)
                nth, to = (v.to_numpy(zero_copy_only=False) for v in placed.flatten())
                old = by_ending[endings]
                new, at = old.copy(), word_start[placed_row] + nth
                new[at] = to
                more = np.zeros(len(score))
                more += np.bincount(placed_row, times[at] * (leave[endings[at]] - class_mass[to]), len(score))
                pairs, pair_row, _ = flat(pairs)
                both, pair_row = pairs.to_numpy(zero_copy_only=False).astype(np.int64), pair_row[::2]
                word = np.where(both < 0, np.repeat(word_start[pair_row], 2) - 1 - both, -1)
                if len(endings):
                    was, now = (np.where(word < 0, both, c[word]) for c in (old, new))
                    step = transition[now[::2], now[1::2]] - transition[was[::2], was[1::2]]
                    more += np.bincount(pair_row, step, len(score))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score.to_numpy(zero_copy_only=False) + more)],
                                                 names=batch.schema.names[:len(kept) + 1])

    return move


def score_brown(docs: DataFrame, model: BrownModel) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row.

    docs: columns doc_id, held_out, text.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    schema = (f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, "
              "tail array<struct<word:binary,times:int,ending:int>>, pairs array<int>")
    marked = shared_table(docs.select("doc_id", "held_out", "text")
                          .mapInArrow(_score_partition(model.without_table()), schema)
                          .withColumn("row", F.monotonically_increasing_id()), "scored")
    log_count = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    tails = (marked.select("row", F.posexplode("tail").alias("nth", "t")).select("row", "nth", "t.word", "t.times")
             .join(model.counts, "word", "left")
             .groupBy("row").agg(F.sum(F.col("times") * log_count).alias("tail_log"),
                                 F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
                                 F.collect_list(F.when(F.col("class").isNotNull(), F.struct("nth", "class")))
                                 .alias("placed")))
    nothing = float(np.log10(max(model.tokens + 0.5 * (model.types + 1), 0.5)))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    scores = marked.join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + tail_log - F.col("n_tokens") * F.lit(nothing)).alias("base_score"),
        (F.col("score") + tail_log).alias("score"), "tail.ending", "tail.times", "pairs",
        F.coalesce("placed", F.array().cast("array<struct<nth:int,class:int>>")).alias("placed"))
    if model.any_rare:
        scores = scores.mapInArrow(_move_placed(model), f"doc_id {id_type}, held_out boolean, n_tokens long, "
                                   "n_known long, train_tokens long, base_score double, score double")
    return (scores.drop("ending", "times", "pairs", "placed")
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))


def language_model_scores(docs: DataFrame, modulus: int = 5, left_out: int = 1) -> DataFrame:
    """Scores of all documents under a model of those whose crc32(doc_id) mod ``modulus`` isn't ``left_out``."""
    marked = docs.select("doc_id", (crc_mod("doc_id", modulus) == left_out).alias("held_out"), "text")
    return score_brown(marked, fit_brown(marked.where(~F.col("held_out"))))
