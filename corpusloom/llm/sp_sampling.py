"""SentencePiece encoding by sampling, and lossless decoding.

A text's segmentation is drawn from all segmentations into vocabulary pieces,
each with a probability in proportion to the product of its pieces' weights
(a power of 1 / rank). Forward filtering sums the weights of all segmentations
of every prefix; backward sampling then draws pieces from the end, each with
its exact conditional probability. The draws depend on the row's key, the seed and the
place in the text only, so a row is always segmented alike, on any executor.

No piece spans certain places, for example that before a space or between a letter and
a mark, so the lattice of a text is a chain of lattices of short units. A unit's
lattice is filtered once and kept for the task; the draws of a block of texts
are made for all units at once.

Characters without a piece, and the vocabulary's own space mark where a text
holds it, are encoded as byte pieces. A space is put before every text and taken off
on decoding, which restores every text byte by byte.

Defined results: a null text has null pieces, an empty one has none, and both decode to
what they were; texts are read whole, long ones in blocks; repeated rows have equal
pieces; a null key is drawn for like a key of its own; an empty table gives an empty
table; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

SPACE = "▁"                # the vocabulary's mark for a space
MARK = ord(SPACE)
SEED = 0
SHARPNESS = 1.0                 # power of the inverse rank; higher: closer to the best segmentation
BLOCK_CHARS = 400_000           # characters whose units are drawn for at once
KEPT_NODES = 600_000            # lattice nodes a task keeps before it starts anew (some 180 MB)
SHARED_CHARS = 64               # units up to this length share the nodes of their prefixes


@dataclass
class Pieces:
    """A vocabulary: ids and weights of its pieces, byte ids, and the text of every id."""
    ids: dict[str, int]
    weights: np.ndarray             # by id
    bytes_ids: list[int]
    raw: list[bytes]                # by id; a space for the mark
    unit: re.Pattern


def load_pieces(path: str, sharpness: float = SHARPNESS) -> Pieces:
    """Read a SentencePiece model; the units' pattern is derived from the places that no piece spans."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    ids, raw, bytes_ids = {}, [b""] * n, [0] * 256
    weights = np.zeros(n)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            bytes_ids[value], raw[i] = i, bytes([value])
            weights[i] = (n + 2.0) ** -sharpness
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[piece], raw[i] = i, piece.replace(SPACE, " ").encode("utf-8")
            weights[i] = (2.0 + max(0.0, -model.get_score(i))) ** -sharpness
    # a piece may begin with a space mark or be made of them, no more
    if any(SPACE in p[1:] and p.strip(SPACE) for p in ids):
        raise ValueError(f"{path}: pieces that span words are not supported")
    # letters and digits, without those that share a piece with other characters
    odd: set[str] = set()
    while True:
        found = {c for p in ids for a, b in zip(p, p[1:]) if SPACE not in (a, b)
                 and (a.isalnum() and a not in odd) != (b.isalnum() and b not in odd)
                 for c in (a, b) if c.isalnum() and c not in odd}
        if not found:
            break
        odd |= found
    word = r"[^\W_" + "".join(re.escape(c) for c in sorted(odd)) + "]"
    other = r"(?:[\W_" + "".join(re.escape(c) for c in sorted(odd)) + r"](?<! ))"
    unit = re.compile(f" *(?:{word}+|{other}+)| +")
    return Pieces(ids, weights, bytes_ids, raw, unit)


class Matcher:
    """Finds the pieces that end at each character of a text read from left to right.

    A state is the longest end of what was read that begins a piece; ``ending`` lists the
    (length, id, log weight) of the pieces that end there.
    """

    def __init__(self, pieces: Pieces):
        self.goto: dict[int, int] = {}          # state and character -> state
        self.fail, self.ending = [0], [[]]
        weights = np.log(np.maximum(pieces.weights, 1e-300)).tolist()
        for piece, i in pieces.ids.items():
            state = 0
            for char in piece:
                key = state << 21 | ord(char)
                state = self.goto.setdefault(key, len(self.fail))
                if state == len(self.fail):
                    self.fail.append(0)
                    self.ending.append([])
            self.ending[state].append((len(piece), i, weights[i]))
        # shorter states come first: a state's fallback is known before its own turn
        by_depth: list[tuple[int, int, int]] = []
        depth = [0] * len(self.fail)
        for key, state in self.goto.items():    # in order of insertion, parents come before children
            depth[state] = depth[key >> 21] + 1
            by_depth.append((depth[state], key, state))
        for d, key, state in sorted(by_depth):
            if d > 1:
                self.fail[state] = self.step(self.fail[key >> 21], key & 0x1FFFFF)
            self.ending[state] += self.ending[self.fail[state]]
        # the same as arrays
        self.keys = np.array(sorted(self.goto), dtype=np.int64)
        self.targets = np.array([self.goto[k] for k in self.keys.tolist()], dtype=np.int64)
        self.fallback = np.array(self.fail, dtype=np.int64)
        self.n_ending = np.array([len(e) for e in self.ending], dtype=np.int64)
        self.at_ending = np.cumsum(self.n_ending) - self.n_ending
        flat = [e for ends in self.ending for e in ends]
        self.size, self.id, self.weight = (np.array([e[k] for e in flat]) for k in range(3))
        self.has_single = np.array([bool(e) and e[-1][0] == 1 for e in self.ending])

    def step(self, state: int, char: int) -> int:
        get = self.goto.get
        found = get(state << 21 | char)
        while found is None and state:
            state = self.fail[state]
            found = get(state << 21 | char)
        return found or 0

    def steps(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """`step` for many states at once."""
        out, left = np.zeros(len(state), dtype=np.int64), np.arange(len(state))
        while len(left):
            key = state[left] << 21 | char[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[left[hit]] = self.targets[at[hit]]
            left = left[~hit & (state[left] > 0)]
            state[left] = self.fallback[state[left]]
        return out


class Lattices:
    """Filtered lattices of units, as growing arrays: nodes with their incoming edges.

    A node stands for a prefix of a unit, and units share the nodes of common prefixes:
    the sum over a prefix's segmentations doesn't depend on what follows. A node's edges lie
    together from ``first`` on; ``upto`` is the running sum of their probabilities (the last
    is 1), ``source`` the node an edge comes from (-1 for a unit's beginning), ``piece`` its id.
    New units are filtered together, one character of each at a time.
    """

    def __init__(self, pieces: Pieces, matcher: Matcher | None = None):
        self.pieces = pieces
        self.matcher = matcher or Matcher(pieces)
        self.byte_weight = math.log(pieces.weights[pieces.bytes_ids[0]])
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}         # last node of each unit
        self.child: dict[int, int] = {}         # node and character -> node
        self.n_nodes = self.n_edges = 0
        self.first, self.state, self.log_sum = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024)
        self.source, self.piece, self.upto = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(1024)

    def _room(self, nodes: int, edges: int):
        for names, used, more in ((("first", "state", "log_sum"), self.n_nodes, nodes),
                                  (("source", "piece", "upto"), self.n_edges, edges)):
            have = len(getattr(self, names[0]))
            if used + more > have:
                for name in names:
                    old = getattr(self, name)
                    new = np.zeros(max(used + more, have * 3 // 2), dtype=old.dtype)
                    new[:used] = old[:used]
                    setattr(self, name, new)

    def _nodes(self, log: np.ndarray, came: np.ndarray, what: np.ndarray, owner: np.ndarray, state: np.ndarray) -> np.ndarray:
        """New nodes from the edges of each (owner: 0, 0, 1, ...); returns their numbers."""
        order = np.lexsort((what, -log, owner))
        log, came, what, owner = log[order], came[order], what[order], owner[order]
        count = np.bincount(owner, minlength=len(state))
        begin = np.cumsum(count) - count
        top = log[begin]
        part = np.exp(log - top[owner])
        run, rank = part.copy(), np.arange(len(owner)) - begin[owner]
        for k in range(1, int(count.max())):
            at = np.flatnonzero(rank == k)
            run[at] += run[at - 1]
        last = begin + count - 1
        whole = run[last]
        run /= whole[owner]
        run[last] = 1.0
        self._room(len(state), len(owner))
        n, e = self.n_nodes, self.n_edges
        self.first[n:n + len(state)] = e + begin
        self.state[n:n + len(state)] = state
        self.log_sum[n:n + len(state)] = top + np.log(whole)
        self.source[e:e + len(owner)], self.piece[e:e + len(owner)], self.upto[e:e + len(owner)] = came, what, run
        self.n_nodes += len(state)
        self.n_edges += len(owner)
        return n + np.arange(len(state))

    def _bytes(self, char: int, came: int) -> tuple[float, int, int]:
        """The edge of a character without a piece: a chain of nodes up to its last byte."""
        raw = chr(char).encode("utf-8", "surrogatepass")
        log = 0.0 if came < 0 else float(self.log_sum[came])
        for value in raw[:-1]:
            log += self.byte_weight
            came = int(self._nodes(*(np.array([v]) for v in (log, came, self.pieces.bytes_ids[value], 0, 0)))[0])
        return log + self.byte_weight, came, self.pieces.bytes_ids[raw[-1]]

    def add(self, units: list[str], shared: bool = True) -> np.ndarray:
        """Filter distinct units forward; return the last node of each. Units that aren't shared are forgotten."""
        units = sorted(units, key=len, reverse=True)
        size = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        begin = np.cumsum(size) - size
        matcher, child = self.matcher, self.child if shared else {}
        node = np.full(len(units), -1)
        path = np.full((len(units), int(size[0]) + 1), -1)
        for at in range(int(size[0])):
            n = int(np.searchsorted(-size, -at, side="left"))       # units that are longer
            char = codes[begin[:n] + at]
            key = node[:n] + 1 << 21 | char
            found = np.array([child.get(k, -1) for k in key.tolist()])
            new = np.flatnonzero(found < 0)
            if len(new):
                fresh, example, which = np.unique(key[new], return_index=True, return_inverse=True)
                unit, letter = new[example], char[new[example]]
                parent = node[unit]
                # the vocabulary's space mark in a text is no space
                seen = np.where(letter == 32, MARK, np.where(letter == MARK, 0x110000, letter))
                state = matcher.steps(np.where(parent < 0, 0, self.state[parent]), seen)
                n_edges = matcher.n_ending[state]
                owner = np.repeat(np.arange(len(fresh)), n_edges)
                edge = np.arange(len(owner)) + np.repeat(matcher.at_ending[state] - np.cumsum(n_edges) + n_edges, n_edges)
                came = path[unit[owner], at + 1 - matcher.size[edge]]
                log = matcher.weight[edge] + np.where(came < 0, 0.0, self.log_sum[came])
                what = matcher.id[edge]
                alone = np.flatnonzero(~matcher.has_single[state])
                if len(alone):      # no piece for the character by itself
                    rest = [self._bytes(c, p) for c, p in zip(letter[alone].tolist(), parent[alone].tolist())]
                    log, came, what = (np.concatenate([v, [r[k] for r in rest]]) for k, v in enumerate((log, came, what)))
                    owner = np.concatenate([owner, alone])
                made = self._nodes(log, came.astype(np.int64), what.astype(np.int64), owner, state)
                if shared:
                    child.update(zip(fresh.tolist(), made.tolist()))
                found[new] = made[which]
            node[:n] = found
            path[:n, at + 1] = found
        if shared:
            self.known.update(zip(units, node.tolist()))
        return node

    def ends(self, units: list[str]) -> np.ndarray:
        """The last node of each unit; unknown ones are filtered now."""
        if self.n_nodes > KEPT_NODES:
            self.clear()
        get = self.known.get
        out = [get(u) for u in units]
        unknown = {u for u, node in zip(units, out) if node is None}
        if unknown:
            long = {u: int(self.add([u], False)[0]) for u in unknown if len(u) > SHARED_CHARS}
            short = [u for u in unknown if len(u) <= SHARED_CHARS]
            if short:
                self.add(short)
            out = [(get(u) if u not in long else long[u]) if node is None else node for u, node in zip(units, out)]
        return np.array(out, dtype=np.int64)

    def draw(self, ends: np.ndarray, stream: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample every unit backwards at once: (ids of all units in order, number of ids of each unit)."""
        first, source, piece, upto = self.first, self.source, self.piece, self.upto
        drawn, who = [], []
        active, node, step = np.arange(len(ends)), ends, 0
        base = mix(stream ^ mix(place.astype(np.uint64)))
        while len(active):
            u = uniform(base[active] + np.uint64(step))
            edge = first[node]
            late = np.flatnonzero(upto[edge] <= u)
            while len(late):
                edge[late] += 1
                late = late[upto[edge[late]] <= u[late]]
            drawn.append(piece[edge])
            who.append(active)
            node = source[edge]
            more = node >= 0
            active, node = active[more], node[more]
            step += 1
        count = np.zeros(len(ends), dtype=np.int64)
        for w in who:
            count[w] += 1
        stop = np.cumsum(count)
        ids = np.zeros(int(stop[-1]) if len(stop) else 0, dtype=np.int32)
        for k, (w, d) in enumerate(zip(who, drawn)):
            ids[stop[w] - 1 - k] = d
        return ids, count


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from counters."""
    return (mix(x) >> np.uint64(11)) * 2.0 ** -53


def row_stream(key, seed: int) -> int:
    """The 64-bit start of a row's random numbers."""
    return xxhash.xxh64_intdigest(repr(key), seed)


def blocks_of(text: str) -> Iterator[str]:
    """A text with its space put in front, in blocks that end before a space."""
    text, start = " " + text, 0
    while start < len(text):
        stop = text.find(" ", start + BLOCK_CHARS)
        # a run of spaces stays whole: pieces may span it
        while 0 < stop < len(text) and text[stop - 1] == " ":
            stop = text.find(" ", stop + 1)
        stop = stop if stop > 0 else len(text)
        yield text[start:stop]
        start = stop


def encode_texts(rows: list[tuple[object, str | None]], lattices: Lattices, seed: int = SEED) -> list[np.ndarray | None]:
    """Sampled piece ids of (key, text) rows."""
    out: list = [None if t is None else np.zeros(0, dtype=np.int32) for _, t in rows]
    find = lattices.pieces.unit.findall
    units: list[str] = []
    owners: list[tuple[int, int, int, int]] = []        # row, stream, first place, number of units
    parts: list[list[np.ndarray]] = [[] for _ in rows]

    def settle():
        if not units:
            return
        n = np.array([o[3] for o in owners])
        stream = np.repeat(np.array([o[1] for o in owners], dtype=np.uint64), n)
        begin = np.repeat(np.array([o[2] for o in owners], dtype=np.int64), n)
        place = begin + np.arange(len(units)) - np.repeat(np.cumsum(n) - n, n)
        ids, count = lattices.draw(lattices.ends(units), stream, place)
        stops = np.cumsum(np.add.reduceat(count, np.cumsum(n) - n))
        for (row, *_), piece_ids in zip(owners, np.split(ids, stops[:-1])):
            parts[row].append(piece_ids)
        units.clear()
        owners.clear()

    held = 0
    for row, (key, text) in enumerate(rows):
        if not text:
            continue
        stream, place = row_stream(key, seed), 0
        for block in blocks_of(text):
            found = find(block)
            units.extend(found)
            owners.append((row, stream, place, len(found)))
            place += len(found)
            held += len(block)
            if held >= BLOCK_CHARS:
                settle()
                held = 0
    settle()
    for row, got in enumerate(parts):
        if got:
            out[row] = got[0] if len(got) == 1 else np.concatenate(got)
    return out


def decode_ids(ids, raw: list[bytes]) -> str | None:
    """The text of piece ids."""
    if ids is None:
        return None
    return b"".join([raw[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]


_WORKER: dict[tuple, tuple[Pieces, Matcher]] = {}


def _vocabulary(path: str, sharpness: float) -> tuple[Pieces, Matcher]:
    """The vocabulary and its matcher, read once per worker; lattices live for a task only."""
    if (path, sharpness) not in _WORKER:
        pieces = load_pieces(path, sharpness)
        _WORKER[path, sharpness] = pieces, Matcher(pieces)
    return _WORKER[path, sharpness]


def encode_sampled(docs: DataFrame, path: str, key: str = "doc_id", seed: int = SEED, sharpness: float = SHARPNESS,
                   keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (the key), ids and lossless for every row: sampled pieces, and whether they decode to the text.

    Columns of ``keep`` that are called ids or lossless give way to the new ones.
    """
    keep = [c for c in (keep or [key]) if c not in ("ids", "lossless")]
    chosen = docs.select(F.col(key).alias("_key"), F.col("text").alias("_text"), *keep)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("lossless", T.BooleanType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(*_vocabulary(path, sharpness))
        raw = lattices.pieces.raw
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                found = encode_texts(rows, lattices, seed)
                same = [decode_ids(None if ids is None else ids.tolist(), raw) == text
                        for ids, (_, text) in zip(found, rows)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[2:], pa.array(found, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                    names=[*batch.schema.names[2:], "ids", "lossless"])

    return chosen.mapInArrow(encode, schema)


def decode_pieces(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows of piece ids."""
    chosen = encoded.select(key, "ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = _vocabulary(path, SHARPNESS)[0].raw
        for batch in batches:
            texts = [decode_ids(ids.as_py(), raw) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return chosen.mapInArrow(decode, f"`{key}` {dict(chosen.dtypes)[key]}, text string")
