"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A text, with its spaces as word marks and one mark in front, is cut into chunks of about CHUNK
characters. A boundary state is the piece that crosses or ends at a boundary, as (start, end). A chunk
yields the matrix from the states of its left boundary to those of its right one: the
best weight of a chain of pieces between them (max over chains, plus along a chain), without knowing
what comes before. The matrices are combined associatively (max-plus product, as a tree of pairs);
the states chosen at all boundaries then let each chunk be traced back on its own.

Weights. A unigram model's chain weighs the sum of its scores. In a BPE model a chain is possible (weight 0)
if each two neighbours are what the merges give for the two together, and impossible (minus
infinity) otherwise; exactly one chain of a word is possible, the one that merging the whole word
gives. So the same scan gives the library's ids for both kinds of model.

No piece holds a mark after another character (checked on the vocabulary, else the library encodes whole
texts), so a mark after another character is a boundary with a single state: a chunk's matrix
is the sum of a column for what stands before its first such mark and a row for what stands after
its last one, and what lies between is encoded by the library, word by word. Chunk boundaries
never fall into a run of marks or the word behind it when the run is longer than one, as merges
of marks tie.

Decoding maps ids to bytes piece by piece, so chunks decode on their own; the mark in front goes.

Defined results: null and empty texts have no ids and decode to the empty text. Repeated rows and
null ids each get a row; other columns stay or are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import PieceCodec, Units
from .words import parts, tidy

CHUNK = 4096
MARK = "▁"
NONE = float("-inf")
State = tuple[int, int]  # start and end of the piece at a boundary; (c, c) where the boundary is a word's beginning
Matrix = dict[State, dict[State, float]]


def _packed(ids: list[int]) -> bytes:
    a = array("i", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Lattice:
    """Pieces, their weights, and which may follow which."""

    def __init__(self, path: str):
        self.codec = PieceCodec(path)
        self.sp = sp = self.codec.sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(sp.serialized_model_proto())
        self.bpe = model.trainer_spec.model_type == 2
        self.scores = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        self.longest = max(map(len, self.scores), default=1)
        self.lowest = min(self.scores.values(), default=0.0) - 10.0
        self.cuttable = self.codec.cuttable
        self.units = Units(self.codec, _packed)
        self.ids_of = lru_cache(1 << 16)(self._ids_of)
        self.follows = lru_cache(1 << 18)(self._follows)
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() for p in model.pieces]

    def _ids_of(self, piece: str) -> list[int]:
        i = self.sp.piece_to_id(piece)
        if piece in self.scores:
            return [i]
        if self.sp.is_byte(self.sp.piece_to_id("<0x00>")):
            return [self.sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]
        return [self.sp.unk_id()]

    def merged(self, text: str) -> list[str]:
        """What the merges give: the neighbours with the best joint score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = NONE, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, a: str, b: str) -> float:
        """The weight of b after a; a may be empty (a word's beginning)."""
        if not self.bpe:
            return self.scores.get(b, self.lowest)
        return 0.0 if self.merged(a + b) == ([a, b] if a else [b]) else NONE

    def pieces(self, text: str, at: int, end: int) -> Iterator[int]:
        """Ends of the pieces that begin at `at`, no further than `end`; a single character always is one."""
        for j in range(at + 1, min(end, at + self.longest) + 1):
            if j == at + 1 or text[at:j] in self.scores:
                yield j

    def crossing(self, text: str, low: int, c: int, high: int) -> list[State]:
        """The possible states of a boundary inside a word that spans low to high."""
        return [(i, j) for i in range(max(low, c - self.longest), c) for j in self.pieces(text, i, high) if j >= c]

    def chains(self, text: str, start: State, stop: int, high: int, inside: int) -> dict[State, tuple[float, State | None]]:
        """Best chains from a state: for each piece reached, its weight and the piece before it.
        Pieces begin before `stop` and end by `high`; `inside` is unused room for callers that bound the word."""
        best: dict[State, tuple[float, State | None]] = {start: (0.0, None)}
        by_end: dict[int, list[State]] = {start[1]: [start]}
        for at in range(start[1], stop):
            for before in by_end.get(at, ()):
                weight = best[before][0]
                for j in self.pieces(text, at, high):
                    w = self.follows(text[before[0] : before[1]], text[at:j])
                    if w == NONE:
                        continue
                    state = (at, j)
                    if state not in best:
                        by_end.setdefault(j, []).append(state)
                    if state not in best or weight + w > best[state][0]:
                        best[state] = (weight + w, before)
        return best


_CUT = re.compile(r"(?<=[^▁])(?=▁)")


class Chunk:
    """text[a:b] of a document's marked text: its matrix, and its ids once its states are known."""

    def __init__(self, lattice: Lattice, text: str, a: int, b: int):
        self.lattice, self.text, self.a, self.b = lattice, text, a, b
        m = _CUT.search(text, a, b) if not self._cut(a) else None
        self.first = a if self._cut(a) else m.start() if m else None  # the first single-state boundary
        self.last = b if self._cut(b) else None
        if self.last is None and self.first is not None:
            k = text.rfind(MARK, self.first, b)
            while k > self.first and not self._cut(k):
                k -= 1
            self.last = max(k, self.first)

    def _cut(self, c: int) -> bool:
        return c in (0, len(self.text)) or (self.text[c] == MARK and self.text[c - 1] != MARK)

    def _word(self, c: int) -> tuple[int, int]:
        """Beginning and end of the word around a boundary, no further than pieces reach."""
        reach = self.lattice.longest
        low, high = c, c
        while low > max(0, c - reach) and not self._cut(low):
            low -= 1
        while high < min(len(self.text), c + reach) and not (high > c and self._cut(high)):
            high += 1
        return low, high

    def states(self, c: int) -> list[State]:
        return [(c, c)] if self._cut(c) else self.lattice.crossing(self.text, self._word(c)[0], c, self._word(c)[1])

    def _begin(self, s: State) -> State:
        return s

    def matrix(self) -> Matrix:
        out: Matrix = {}
        if self.first is None:  # no single-state boundary: every state by itself
            for s in self.states(self.a):
                out[s] = self._to_end(s)
            return out
        head = {s: self._weight_to(s, self.first) for s in self.states(self.a)}
        tail = self._to_end((self.last, self.last))
        for s, w in head.items():
            if w > NONE:
                out[s] = {t: w + v for t, v in tail.items()}
        return out

    def _weight_to(self, s: State, stop: int) -> float:
        if s == (stop, stop):
            return 0.0
        found = self.lattice.chains(self.text, s, stop, stop, 0)
        return max((w for (_, j), (w, _) in found.items() if j == stop), default=NONE)

    def _to_end(self, s: State) -> dict[State, float]:
        """Weights from s to the states of the right boundary; s may itself reach over the chunk."""
        if self._cut(self.b):
            if s == (self.b, self.b):
                return {s: 0.0}
            w = self._weight_to(s, self.b)
            return {(self.b, self.b): w} if w > NONE else {}
        if s[1] >= self.b and s[0] < self.b:
            return {s: 0.0}
        found = self.lattice.chains(self.text, s, self.b, self._word(self.b)[1], 0)
        return {t: w for t, (w, _) in found.items() if t[1] >= self.b and t[0] < t[1]}

    def _trace(self, s: State, stop: int, high: int, goal: State | None) -> list[State]:
        """The pieces after s of the best chain to goal, or to `stop` exactly."""
        if s == goal or s[1] == stop and goal is None:
            return []
        found = self.lattice.chains(self.text, s, stop, high, 0)
        at: State | None = goal or max((t for t in found if t[1] == stop), key=lambda t: found[t][0])
        out = []
        while at is not None and at != s:
            out.append(at)
            at = found[at][1]
        return out[::-1]

    def _ids(self, pieces: list[State]) -> bytes:
        return np.array([i for p, q in pieces for i in self.lattice.ids_of(self.text[p:q])], "<i4").tobytes()

    def ids(self, s: State, t: State) -> bytes:
        """Packed ids of the pieces that begin in this chunk, after state s and up to state t."""
        if self.first is None:
            goal = None if self._cut(self.b) else t
            return self._ids(self._trace(s, self.b, self.b if goal is None else self._word(self.b)[1], goal))
        head = self._ids(self._trace(s, self.first, self.first, None)) if s != (self.first, self.first) else b""
        middle = self._middle()
        tail = b"" if self.last == self.b else self._ids(self._trace((self.last, self.last), self.b, self._word(self.b)[1], t))
        return head + middle + tail

    def _middle(self) -> bytes:
        if self.first == self.last:
            return b""
        return b"".join(self.lattice.units(self.text[self.first : self.last]))


def product(x: Matrix, y: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for s, row in x.items():
        got: dict[State, float] = {}
        for k, w in row.items():
            for t, v in y.get(k, {}).items():
                if w + v > got.get(t, NONE):
                    got[t] = w + v
        if got:
            out[s] = got
    return out


def scan(matrices: list[Matrix], start: State, end: State) -> list[State]:
    """The states at all boundaries of the best chain: products up a tree of pairs, choices down it."""

    def build(lo: int, hi: int):
        if hi - lo == 1:
            return matrices[lo], None, None
        mid = (lo + hi) // 2
        left, right = build(lo, mid), build(mid, hi)
        return product(left[0], right[0]), left, right

    out = [start]

    def choose(tree, s: State, t: State) -> None:
        _, left, right = tree
        if left is None:
            out.append(t)
            return
        rows = left[0].get(s, {})
        mid = max((k for k in rows if t in right[0].get(k, {})), key=lambda k: (rows[k] + right[0][k][t], k))
        choose(left, s, mid)
        choose(right, mid, t)

    choose(build(0, len(matrices)), start, end)
    return out


def boundaries(text: str, chunk: int) -> list[int]:
    """Chunk ends; moved behind the word where they would fall into a run of marks, or into a word after a run of two or more."""
    out, at = [0], 0
    while len(text) - at > chunk:
        c = at + chunk
        k = text.rfind(MARK, at, c + 1)
        in_run = k >= 0 and (text[k - 1 : k] == MARK or text[k + 1 : k + 2] == MARK)
        if in_run and not (text[c] == MARK and text[c - 1] != MARK):
            m = _CUT.search(text, c)
            c = m.start() if m else len(text)
        if c >= len(text):
            break
        out.append(c)
        at = c
    return [*out, len(text)]


class Encoder:
    def __init__(self, path: str, chunk: int = CHUNK):
        self.lattice, self.chunk = Lattice(path), chunk

    def __call__(self, text: str) -> np.ndarray:
        lattice = self.lattice
        if not text:
            return np.zeros(0, np.int32)
        if not lattice.cuttable:
            return np.array(lattice.sp.encode(text), np.int32)
        marked = MARK + text.replace(" ", MARK)
        ends = boundaries(marked, self.chunk)
        chunks = [Chunk(lattice, marked, a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if len(chunks) == 1:
            chosen = [(0, 0), (len(marked), len(marked))]
        else:
            chosen = scan([c.matrix() for c in chunks], (0, 0), (len(marked), len(marked)))
        return np.frombuffer(b"".join(c.ids(s, t) for c, s, t in zip(chunks, chosen[:-1], chosen[1:], strict=True)), "<i4")

    def decode(self, ids: np.ndarray, chunk: int = 1 << 16) -> str:
        """Chunks of ids become bytes on their own."""
        raw = self.lattice.raw
        data = b"".join(b"".join(map(raw.__getitem__, ids[k : k + chunk].tolist())) for k in range(0, len(ids), chunk))
        return data.removeprefix(b" ").decode("utf-8", "replace")


_kept: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, chunk: int = CHUNK) -> Encoder:
    """One for each Python worker."""
    if (path, chunk) not in _kept:
        _kept[path, chunk] = Encoder(path, chunk)
    return _kept[path, chunk]


def encoded(docs: DataFrame, path: str, text_col: str = "text", out: str = "pieces", chunk: int = CHUNK) -> DataFrame:
    """docs with a column of ids."""

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, chunk)
        for batch in batches:
            ids = [own(x or "") for part in parts(batch) for x in part.to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))

    return docs.withColumn(out, F.arrow_udf(tidy(encode), "array<int>")(F.col(text_col)))


def decoded(docs: DataFrame, path: str, ids_col: str = "pieces", out: str = "decoded", chunk: int = CHUNK) -> DataFrame:
    """docs with the text of a column of ids; null ids give the empty text."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, chunk)
        for batch in batches:
            yield pa.array([own.decode(np.array(x.as_py() or [], np.int32)) for x in batch], pa.string())

    return docs.withColumn(out, F.arrow_udf(tidy(decode), "string")(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_crc32 (of the decoded text's
    UTF-8) and same (the decoded text is the text) for each row; ids stay in the Python worker, one pass."""

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path, chunk)
        for batch in batches:
            n, crc, text_crc, same = [], [], [], []
            for part in parts(batch):
                for x in part.to_pylist():
                    ids = own(x or "")
                    text = own.decode(ids)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    text_crc.append(zlib.crc32(text.encode()))
                    same.append(text == (x or ""))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(text_crc, pa.int64()), pa.array(same, pa.bool_())], names=["n_pieces", "ids_crc32", "decoded_crc32", "same"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(tidy(both), "n_pieces long, ids_crc32 long, decoded_crc32 long, same boolean")(F.col(text_col)).alias("x"))
    return d.select("doc_id", "x.*")
