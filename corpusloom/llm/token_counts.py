"""Token counts with the whole-token shortcut.

The vocabulary is examined offline: a vocabulary string that the merge rules
reduce to one token is *whole*. Most pre-tokens of real text are such strings
and are counted by one set lookup; the merge rules run only on the rest, once
per distinct pre-token held in a bounded per-worker memo.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty text
has 0 tokens; repeated rows give repeated rows; an empty table gives an empty
table; texts are read whole, whatever their length; other columns of the input
are ignored, so their names can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

# FIXED VALUES: the byte-level pre-token pattern of the vocabulary file, and the printable
# stand-ins that byte-level vocabularies use for bytes (these ranges stand for themselves).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PRETOKEN = (r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
                  r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")      # the same pattern, for ASCII texts
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))

MEMO_ENTRIES = 1 << 19      # distinct pre-tokens a worker remembers before it starts anew


def byte_letters() -> list[str]:
    """The letter that stands for each byte value."""
    own = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(own))
    return [table[b] for b in range(256)]


NO_RANK = 1 << 60


def merge_count(parts: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Number of tokens left when the lowest-ranked adjacent pair, leftmost first, is merged until none is known.

    ``parts`` is consumed.
    """
    rank_of = ranks.get
    waiting = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:])]
    while waiting:
        best = min(waiting)
        if best == NO_RANK:
            break
        i = waiting.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del waiting[i]
        if i:
            waiting[i - 1] = rank_of((parts[i - 1], parts[i]), NO_RANK)
        if i < len(waiting):
            waiting[i] = rank_of((parts[i], parts[i + 1]), NO_RANK)
    return len(parts)


def merge_count_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """`merge_count` for long pre-tokens: a heap over a linked list, n log n steps."""
    import heapq
    n = len(parts)
    parts = list(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
            if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue            # one side has been merged since
        parts[i], parts[j] = a + b, ""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        left -= 1
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := ranks.get((parts[x], parts[y]))) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return left


@dataclass
class Vocabulary:
    """Merge ranks, special strings and the whole strings (as text, ready for lookup)."""
    path: str
    ranks: dict[tuple[str, str], int]
    special: list[str]
    whole: frozenset[str]


def load_vocabulary(path: str, whole: frozenset[str] | None = None) -> Vocabulary:
    """Read a byte-level BPE file; without ``whole``, prove the whole strings by merging each one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pre = spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path}: a plain byte-level BPE vocabulary is needed")
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    ranks = {p: r for r, p in enumerate(pairs)}
    special = [t["content"] for t in spec["added_tokens"]]
    if whole is None:
        value = {c: b for b, c in enumerate(byte_letters())}
        found = set()
        for piece in model["vocab"]:
            if all(c in value for c in piece) and merge_count(list(piece), ranks) == 1:
                try:
                    found.add(bytes(value[c] for c in piece).decode("utf-8"))
                except UnicodeDecodeError:
                    pass        # part of a character: can't be a whole pre-token of a text
        whole = frozenset(found)
    return Vocabulary(path, ranks, special, whole)


_WORKER: dict[str, tuple] = {}


def _counter(path: str, whole: frozenset[str]):
    """The counting function of this worker process, built once per vocabulary file."""
    if path in _WORKER:
        return _WORKER[path]
    vocab = load_vocabulary(path, whole)
    letters = byte_letters()
    ranks, memo = vocab.ranks, dict.fromkeys(whole, 1)
    find_any, find_ascii = regex.compile(PRETOKEN).findall, re.compile(ASCII_PRETOKEN).findall
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(vocab.special, key=len, reverse=True))) \
        if vocab.special else None

    def count(text: str | None) -> int:
        if not text:
            return 0
        total = 0
        if cut is not None and any(s in text for s in vocab.special):
            parts = cut.split(text)
            total = len(parts) - 1      # each special string is one token
        else:
            parts = (text,)
        for part in parts:
            for piece in (find_ascii if part.isascii() else find_any)(part):
                n = memo.get(piece)
                if n is None:
                    symbols = [letters[b] for b in piece.encode("utf-8")]
                    n = merge_count(symbols, ranks) if len(symbols) < 64 else merge_count_long(symbols, ranks)
                    if len(piece) < 64:
                        if len(memo) >= len(whole) + MEMO_ENTRIES:
                            memo.clear()
                            memo.update(dict.fromkeys(whole, 1))
                        memo[piece] = n
                total += n
        return total

    _WORKER[path] = count
    return count


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024,
                 whole: frozenset[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``whole`` may carry strings proven earlier (see ``load_vocabulary``); by default
    they are proven here, once, on the driver: the work depends on the vocabulary only.
    """
    if whole is None:
        whole = load_vocabulary(vocabulary_path).whole

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _counter(vocabulary_path, whole)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          n_tokens("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
