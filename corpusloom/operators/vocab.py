"""Normalisation, pre-tokenisation, vocabulary statistics and BPE as Spark
jobs (K1-K7, A17, E9).

The corpus is reduced to a (word, frequency) table first (partial aggregation)
over the normalised text; BPE rounds then work on distinct words only, each one
aggregation over a table written once to the session's checkpoint folder.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import rules as R
from corpusloom.session import materialized, small_batches, spread

SPECIAL_TOKENS = R.SPECIAL_TOKENS
# word runs (\w plus < > / . - :), whitespace runs, punctuation runs (everything else);
# the three classes are disjoint, so the most common one is tried first; Unicode \w
PRETOKEN_PATTERN = r"(?U)[\w<>/.\-:]++|\s++|[^\w\s<>/.\-:]++"
# FIXED VALUE: how the byte-level stage cuts a piece
BYTE_LEVEL_PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _strip(s: str | None) -> str | None:
    if s is None or s.isascii():
        return s
    s = unicodedata.normalize("NFD", s)
    # a class of the marks that occur: one over all marks of Unicode is some 70 times slower
    marks = "".join(sorted(c for c in set(s) if unicodedata.category(c) == "Mn"))
    return re.sub(f"[{marks}]+", "", s) if marks else s


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """K1: NFD then drop combining marks (Arrow batches); ASCII texts pass through."""
    return s.map(_strip)


def normalized(docs: DataFrame, text_col: str) -> DataFrame:
    """The first step of every vocabulary job: the text column without accents."""
    return small_batches(spread(docs)).withColumn(text_col, strip_accents(F.col(text_col)))


def pretokens(text: Column, special=SPECIAL_TOKENS) -> Column:
    """K2: special tokens first (never split), then whitespace / punctuation /
    word runs; every piece is kept."""
    return F.regexp_extract_all(text, F.lit(pretoken_pattern(special)), 0)


def pretoken_pattern(special=SPECIAL_TOKENS) -> str:
    """The K2 pattern; special tokens are grouped behind a one-character
    lookahead per first character so ordinary positions fail fast."""
    by_first: dict[str, list[str]] = {}
    for t in special:
        by_first.setdefault(t[0], []).append(re.escape(t))
    alts = "|".join(f"(?={re.escape(c)})(?:{'|'.join(ts)})" for c, ts in by_first.items())
    return f"(?U){alts}|" + PRETOKEN_PATTERN[4:] if alts else PRETOKEN_PATTERN


def count_pretokens(text: Column, special=SPECIAL_TOKENS) -> Column:
    """Number of K2 pieces without building the array."""
    return F.regexp_count(text, F.lit(pretoken_pattern(special)))


def byte_level_pieces(pieces: Column, special=SPECIAL_TOKENS) -> Column:
    """K2, last stage: every piece but special tokens is cut by the byte-level pattern."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p.isin(list(special)), F.array(p)).otherwise(
        F.regexp_extract_all(p, F.lit(BYTE_LEVEL_PATTERN), F.lit(0)))))


# the byte-level cut of texts without special tokens, in one pass: a piece is white space, or a run of one of
# the other classes of PRETOKEN_PATTERN, of which letters, numbers and the rest are cut apart
_RUN, _REST = r"[\w<>/.\-:]", r"[^\w\s<>/.\-:]"
CUT_PATTERN = rf"(?U)\p{{L}}++|\s++|[{_RUN}&&[\p{{N}}]]++|[{_RUN}&&[^\p{{L}}\p{{N}}]]++|[{_REST}&&[\p{{N}}]]++|[{_REST}&&[^\p{{N}}]]++"


def cut_pieces(text: Column, special=SPECIAL_TOKENS) -> Column:
    """All of K2: ``byte_level_pieces(pretokens(text))``, in one pass for texts that no special token occurs in."""
    one_pass = F.regexp_extract_all(text, F.lit(CUT_PATTERN), F.lit(0))
    if not special:
        return one_pass
    # what precedes PRETOKEN_PATTERN's own alternatives
    found = text.rlike(pretoken_pattern(special).removesuffix("|" + PRETOKEN_PATTERN[4:]))
    return F.when(found, byte_level_pieces(pretokens(text, special), special)).otherwise(one_pass)


def word_histogram(docs: DataFrame, text_col: str, min_frequency: int = R.MIN_FREQUENCY) -> DataFrame:
    """K3: frequency of non-whitespace pre-tokens, kept when >= min_frequency."""
    w = normalized(docs.select(text_col), text_col).select(F.explode(pretokens(F.col(text_col))).alias("word")).filter(~F.col("word").rlike(r"^\s+$"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= min_frequency)


def alphabet(words: DataFrame, limit: int = R.ALPHABET_LIMIT) -> DataFrame:
    """K4: the ``limit`` commonest characters, weighted by word frequency."""
    ch = words.select(F.explode(F.split("word", "")).alias("ch"), "freq")
    return (ch.groupBy("ch").agg(F.sum("freq").alias("n")).orderBy(F.col("n").desc(), F.col("ch")).limit(limit))


def pair_counts(symbols: DataFrame) -> DataFrame:
    """Adjacent symbol pairs weighted by word frequency. ``symbols`` has (sym array, freq)."""
    pairs = symbols.select(
        F.explode(F.arrays_zip(F.slice("sym", 1, F.greatest(F.size("sym") - 1, F.lit(0))),
                               F.slice("sym", 2, F.greatest(F.size("sym") - 1, F.lit(0))))).alias("p"), "freq")
    return pairs.groupBy(F.col("p")["0"].alias("a"), F.col("p")["1"].alias("b")).agg(F.sum("freq").alias("n"))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(own))
    return [letters[b] for b in range(256)]


_LETTERS = byte_letters()
_BYTES = {c: b for b, c in enumerate(_LETTERS)}
_NEVER = 1 << 60
PAIRS_SEEN = 1 << 16    # commonest pairs that are linked in a round, at most; beyond them, equal counts end a round
PLACES = 1 << 21        # places of words whose pairs a task counts at a time
SEGMENTS = 1 << 17      # distinct segments that come to the driver in a round, at most


def symbols_of(word: str, byte_level: bool) -> list[str]:
    """What a word's merges start from: its byte letters, or its characters."""
    return [_LETTERS[b] for b in word.encode("utf-8")] if byte_level else list(word)


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols after all merges, the lowest rank first, each from left to right."""
    symbols = list(symbols)
    known = [ranks.get(p, _NEVER) for p in zip(symbols, symbols[1:])]
    while known:
        best = min(known)
        if best == _NEVER:
            break
        i = known.index(best)
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        del known[i]
        if i:
            known[i - 1] = ranks.get((symbols[i - 1], symbols[i]), _NEVER)
        if i < len(known):
            known[i] = ranks.get((symbols[i], symbols[i + 1]), _NEVER)
    return symbols


def free_signs(taken: set[str]) -> Iterator[str]:
    """Characters that no text symbol uses, private ones first: they stand for merged symbols in a table of words."""
    return (chr(c) for c in chain(range(0xF0000, 0x110000), range(0x20000, 0xF0000)) if chr(c) not in taken)


def symbol_runs(words: DataFrame, byte_level: bool, letters: list[str] | None) -> DataFrame:
    """(sym, freq): the first symbols of a (word, freq) table, one character each; words are cut at symbols outside ``letters``, which never merge."""
    allowed = frozenset(letters) if letters is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for word, freq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                symbols, start = "".join(symbols_of(word, byte_level)), 0
                for i in range(len(symbols) + 1):
                    if i == len(symbols) or allowed is not None and symbols[i] not in allowed:
                        if i - start > 1:
                            total[symbols[start:i]] += freq
                        start = i + 1
            yield _counted(total, "sym", "freq")

    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fixed number of parts: the rounds cost far more time than their few bytes suggest
    return (words.select("word", "freq").mapInArrow(run, "sym string, freq long").repartition(parts, "sym")
            .groupBy("sym").agg(F.sum("freq").alias("freq")))


def _counted(total: Counter, key: str, value: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], [key, value])


def symbols_in(state: DataFrame) -> set[str]:
    """The distinct symbols of a (sym, freq) table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            seen.update("".join(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["s"])

    return {r["s"] for r in state.mapInArrow(run, "s string").distinct().collect()}


def _placed(batch: pa.RecordBatch, gap: str) -> tuple[list[str], str, np.ndarray, np.ndarray]:
    """A batch's words, their text with ``gap`` behind each, the keys of its neighbouring places and each place's frequency."""
    words = batch.column(0).to_pylist()
    text = gap.join(words) + gap
    signs = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    freqs = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), sizes + 1)
    return words, text, signs[:-1] << 21 | signs[1:], freqs


def _pair_key(a: str, b: str) -> int:
    return ord(a) << 21 | ord(b)


def sign_pairs(state: DataFrame, spelled: dict[str, str], gap: str) -> DataFrame:
    """(a, b, n): adjacent symbol pairs of a (sym, freq) table, spelled out, weighted by frequency."""
    space = ord(gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold():
            nonlocal keys, sums
            every, n = (np.concatenate(x) for x in zip((keys, sums), *held))
            order = np.argsort(every, kind="stable")
            every = every[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=np.int64)
            keys, sums = every[first], np.add.reduceat(n[order], first) if len(every) else sums
            held.clear()

        def out():
            a, b = ([spelled[chr(c)] for c in x.tolist()] for x in (keys >> 21, keys & (1 << 21) - 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(sums)], ["a", "b", "n"])

        n_held = 0
        for batch in batches:
            if not len(batch):
                continue
            _, _, key, freqs = _placed(batch, gap)
            real = (key >> 21 != space) & (key & (1 << 21) - 1 != space)
            held.append((key[real], freqs[:-1][real]))
            n_held += len(key)
            if n_held > PLACES:
                fold()
                n_held = 0
                if len(keys) > PLACES // 4:
                    yield out()
                    keys, sums = keys[:0], sums[:0]
        fold()
        yield out()

    return state.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def merged_table(state: DataFrame, merges: list[tuple[str, str, str]], repeats: bool, gap: str) -> DataFrame:
    """A (sym, freq) table after the merges (a, b, their symbol) in this order; what has become one symbol is left out.

    repeats: the last merge makes a symbol that was there before, so earlier merges can apply again behind it.
    """
    rank = {a + b: i for i, (a, b, _) in enumerate(merges)}
    made = [(a + b, c) for a, b, c in merges]
    last = len(made) - 1 if repeats else -1

    def whole(word: str) -> str:
        while len(word) > 1:
            best = min([rank.get(word[i:i + 2], _NEVER) for i in range(len(word) - 1)])
            if best == _NEVER:
                break
            word = word.replace(*made[best], 1 if best == last else -1)
        return word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.array([_pair_key(*pair) for pair in rank], dtype=np.int64))
        for batch in batches:
            if not len(batch):
                continue
            words, _, key, freqs = _placed(batch, gap)
            on = np.concatenate([_among(key, keys), [False]])
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            touched = np.logical_or.reduceat(on, np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])).tolist()
            words = [whole(w) if t else w for w, t in zip(words, touched)]
            left = pa.array([len(w) > 1 for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()).filter(left), batch.column(1).filter(left)], ["sym", "freq"])

    return state.mapInArrow(run, "sym string, freq long")


def _among(key: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among sorted ones, of which there is at least one."""
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


def linked_segments(state: DataFrame, linked: list[tuple[str, str]], gap: str) -> DataFrame:
    """(seg, n): the longest runs of symbols whose neighbouring pairs are all ``linked``, with their frequencies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.array([_pair_key(*pair) for pair in linked], dtype=np.int64))
        total: Counter = Counter()
        for batch in batches:
            if not len(batch):
                continue
            _, text, key, freqs = _placed(batch, gap)
            edge = np.diff(np.concatenate([[0], _among(key, keys), [0]]))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            for a, b, n in zip(start.tolist(), (stop + 1).tolist(), freqs[start].tolist()):
                total[text[a:b]] += n
            if len(total) > SEGMENTS:
                yield _counted(total, "seg", "n")
                total = Counter()
        yield _counted(total, "seg", "n")

    return state.mapInArrow(run, "seg string, n long").groupBy("seg").agg(F.sum("n").alias("n"))


def merge_one(old: list[str], a: str, b: str, freq: int, number: int, delta: Counter,
              holders: dict[tuple[str, str], set[int]]) -> list[str]:
    """One segment after the merge of (a, b); the change of its pairs' counts goes to ``delta``, new pairs to ``holders``."""
    new: list[str] = []
    both, fresh, i, last = a + b, False, 0, len(old) - 1
    while i <= last:
        if i < last and old[i] == a and old[i + 1] == b:
            if i and not fresh:         # else the merge before has taken this pair out
                delta[old[i - 1], a] -= freq
            delta[a, b] -= freq
            if i + 2 <= last:
                delta[b, old[i + 2]] -= freq
            if new:
                delta[new[-1], both] += freq
                holders.setdefault((new[-1], both), set()).add(number)
            new.append(both)
            fresh = True
            i += 2
        else:
            if fresh:
                delta[both, old[i]] += freq
                holders.setdefault((both, old[i]), set()).add(number)
            new.append(old[i])
            fresh = False
            i += 1
    return new


def follow_merges(segments: list[tuple[list[str], int]], room: int, above: int, min_frequency: int,
                  known: set[str]) -> list[tuple[str, str, int]]:
    """The merges that whole words would give, from their linked segments alone, while the best count exceeds ``above``.

    Keeps a table of pair counts and an index from pairs to the segments that hold them, so that a merge
    touches those segments only. Ends after a merge that spells a known token: pairs of that token
    may also stand outside the segments.
    """
    words, freqs = [s for s, _ in segments], [n for _, n in segments]
    count: Counter = Counter()
    holders: dict[tuple[str, str], set[int]] = {}
    for i, (symbols, freq) in enumerate(zip(words, freqs)):
        for pair in zip(symbols, symbols[1:]):
            count[pair] += freq
            holders.setdefault(pair, set()).add(i)
    heap = [(-n, pair) for pair, n in count.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str, int]] = []
    while heap and len(merges) < room:
        n, pair = heapq.heappop(heap)
        n = -n
        if count[pair] != n:        # an outdated entry: its present count has an entry of its own
            continue
        if n < min_frequency or merges and n <= above:
            break
        merges.append((*pair, n))
        delta: Counter = Counter()
        for i in holders.pop(pair):
            words[i] = merge_one(words[i], *pair, freqs[i], i, delta, holders)
        for p, d in delta.items():
            count[p] += d
            if d and count[p] > 0:
                heapq.heappush(heap, (-count[p], p))
        if pair[0] + pair[1] in known:
            break
        known.add(pair[0] + pair[1])
    return merges


def bpe_train(words: DataFrame, n_merges: int, *, byte_level: bool = True, letters: list[str] | None = None,
              min_frequency: int = 1) -> list[tuple[str, str, int]]:
    """K5: up to ``n_merges`` merges (a, b, count) of a (word, freq) table, each the best pair after all earlier ones
    (count, then lexicographic), found many at a time.

    A round counts all pairs of the distinct words and links the commonest ones. A pair that arises later joins at
    a junction that is a pair now, and no pair outgrows its junction; so as long as the best count exceeds that of
    the commonest pair not linked, only symbols between linked pairs matter. Tasks cut the words into runs of
    linked pairs, equal runs are added up, and the driver follows the merges on those distinct segments
    (`follow_merges`) until that count is reached. How many pairs are linked follows from the number of segments,
    which never exceeds SEGMENTS; the first merge of a round needs none. The words after each round are
    a written table, in which each symbol is one character: a lost executor costs a part of one round.
    ``letters`` is the alphabet; symbols outside it never merge.
    """
    state = materialized(symbol_runs(words, byte_level, letters), "bpe-symbols")
    merges: list[tuple[str, str, int]] = []
    known: set[str] = set(letters) if letters is not None else symbols_in(state)
    sign = {c: c for c in known}
    spelled = dict(sign)
    free = free_signs(set(known))
    gap = next(free)
    links = 64
    while len(merges) < n_merges:
        # written by the task that has all parts' best, so that no more than these rows come to the driver
        seen = min(links, PAIRS_SEEN)
        top = materialized(sign_pairs(state, spelled, gap).orderBy(F.col("n").desc(), "a", "b").limit(seen + 1), "bpe-pairs").collect()
        top.sort(key=lambda r: (-r["n"], r["a"], r["b"]))
        if not top or top[0]["n"] < min_frequency:
            break
        found = None
        while found is None:
            links = max(1, min(links, seen, len(top)))
            if links == 1:
                found = [(top[0]["a"], top[0]["b"], top[0]["n"])]
                known.add(top[0]["a"] + top[0]["b"])
                links = 16
                break
            linked = [(sign[r["a"]], sign[r["b"]]) for r in top[:links]]
            rows = materialized(linked_segments(state, linked, gap).limit(SEGMENTS + 1), "bpe-segments").collect()
            if len(rows) > SEGMENTS:
                links //= 4
                continue
            above = top[links]["n"] if links < len(top) else 0
            found = follow_merges([([spelled[c] for c in r["seg"]], r["n"]) for r in rows], n_merges - len(merges), above,
                                  min_frequency, known)
            if len(rows) < SEGMENTS // 4:
                links *= 4
        merges += found
        repeats = found[-1][0] + found[-1][1] in sign
        for a, b, _ in found:
            if a + b not in sign:
                sign[a + b] = next(free)
                spelled[sign[a + b]] = a + b
        if len(merges) < n_merges:
            state = materialized(merged_table(state, [(sign[a], sign[b], sign[a + b]) for a, b, _ in found], repeats, gap), "bpe-symbols")
    return merges


@dataclass
class Tokenizer:
    """Special tokens, alphabet and merges; ids in this order."""
    special: list[str]
    letters: list[str]
    merges: list[tuple[str, str, int]]
    byte_level: bool = True

    def vocabulary(self) -> list[str]:
        """Tokens by id; a merge that spells an earlier token adds none."""
        return list(dict.fromkeys([*self.special, *self.letters, *(a + b for a, b, _ in self.merges)]))


def train_tokenizer(docs: DataFrame, text_col: str, vocab_size: int = R.VOCAB_SIZE, special=SPECIAL_TOKENS,
                    alphabet_limit: int = R.ALPHABET_LIMIT, min_frequency: int = R.MIN_FREQUENCY) -> Tokenizer:
    """K1 -> K2 -> K3 -> K4 -> K5: normalise, cut, count, limit the alphabet, merge up to ``vocab_size``."""
    # the byte-level cut is made once for each distinct piece
    cut = (normalized(docs.select(text_col), text_col).select(F.explode(pretokens(F.col(text_col), special)).alias("piece"))
           .groupBy("piece").agg(F.count(F.lit(1)).alias("n")))
    words = (cut.where(~F.col("piece").isin(list(special)))
             .select(F.explode(F.regexp_extract_all("piece", F.lit(BYTE_LEVEL_PATTERN), F.lit(0))).alias("word"), "n")
             .groupBy("word").agg(F.sum("n").alias("freq")))
    words = materialized(words, "tokenizer-words")

    def count_letters(batches):
        total: Counter = Counter()
        for pdf in batches:
            for word, freq in zip(pdf["word"], pdf["freq"]):
                for c in symbols_of(word, True):
                    total[c] += freq
        yield pd.DataFrame({"ch": pd.Series(list(total), dtype=object),
                            "n": pd.Series(list(total.values()), dtype="int64")})

    top = (words.mapInPandas(count_letters, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))
           .orderBy(F.col("n").desc(), "ch").limit(alphabet_limit).collect())
    letters = sorted(r["ch"] for r in top)
    room = vocab_size - len(special) - len(letters)
    merges = bpe_train(words, max(room, 0), letters=letters, min_frequency=min_frequency)
    return Tokenizer(list(special), letters, merges)


def vocabulary_table(spark, tokenizer: Tokenizer) -> DataFrame:
    """(id, token, kind): special tokens first, then the alphabet, then merges in order."""
    n_special, n_letters = len(tokenizer.special), len(tokenizer.letters)
    rows = [(i, t, "special" if i < n_special else "letter" if i < n_special + n_letters else "merge")
            for i, t in enumerate(tokenizer.vocabulary())]
    return spark.createDataFrame(rows, "id int, token string, kind string")


def encode(docs: DataFrame, text_col: str, tokenizer: Tokenizer, unk: str = "<unk>") -> DataFrame:
    """K6: ``docs`` with ``ids``: the token ids of the normalised text.

    The pieces are cut by column expressions; ids are looked up inside the scan, each distinct
    piece of a task once (a bounded memo), so no word is shuffled.
    """
    ranks = {(a, b): i for i, (a, b, _) in enumerate(tokenizer.merges)}
    number = {t: i for i, t in enumerate(tokenizer.vocabulary())}
    special, byte_level, unknown = frozenset(tokenizer.special), tokenizer.byte_level, number[unk]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def to_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict[str, np.ndarray] = {}
        for pieces in batches:
            found = pieces.flatten().dictionary_encode()
            if len(memo) > 200_000:
                memo.clear()
            ids = []
            for piece in found.dictionary.to_pylist():
                got = memo.get(piece)
                if got is None:
                    got = memo[piece] = np.array([number[piece]] if piece in special else [
                        number.get(s, unknown) for s in merged(symbols_of(piece, byte_level), ranks)], dtype=np.int32)
                ids.append(got)
            size = np.array([len(x) for x in ids], dtype=np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            at = found.indices.to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(size[at])])
            # each piece's ids lie in a row from its start on
            taken = np.repeat(start[at] - ends[:-1], size[at]) + np.arange(ends[-1])
            values = np.concatenate([*ids, np.zeros(0, dtype=np.int32)])[taken]
            first = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
            yield pa.ListArray.from_arrays(pa.array(ends[first], pa.int32()), pa.array(values, pa.int32()))

    pieces = cut_pieces(F.col(text_col), tokenizer.special)
    return normalized(docs, text_col).withColumn("ids", to_ids(F.coalesce(pieces, F.array().cast("array<string>"))))


def decode(ids: Column, tokenizer: Tokenizer) -> Column:
    """The text of token ids; unknown ids decode to their token."""
    tokens, special = tokenizer.vocabulary(), frozenset(tokenizer.special)
    raw = [t.encode("utf-8") if t in special or not tokenizer.byte_level else bytes(_BYTES[c] for c in t) for t in tokens]

    @F.pandas_udf(T.StringType())
    def to_text(batch: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else b"".join([raw[i] for i in v]).decode("utf-8", "replace") for v in batch],
                         dtype=object)

    return to_text(ids)


def pad_truncate(ids: Column, max_len: int = R.MAX_SEQ_LEN, pad_id: int = R.PAD_ID) -> tuple[Column, Column]:
    """Ids cut/padded to ``max_len`` and the attention mask."""
    cut = F.slice(ids, 1, max_len)
    pad = F.array_repeat(F.lit(pad_id), F.lit(max_len) - F.size(cut))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(cut)), F.array_repeat(F.lit(0), F.lit(max_len) - F.size(cut)))
    return F.concat(cut, pad), mask
