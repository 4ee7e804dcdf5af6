"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A document of more than `chunk_chars` characters is encoded in overlapping chunks with offsets.
Two neighbouring chunks are spliced at a boundary that both of them show inside their overlap and
that is proven stable:

* a byte-level BPE encodes each pre-token on its own, and its pre-tokeniser scans from left to
  right with at most a few characters of look-ahead, so a pre-token start that is followed in the
  left chunk by at least GUARD characters and by two further pre-tokens is a start in the
  whole text too; from a common start on, the right chunk's scan is the whole text's;
* a sentencepiece model with no piece holding a word mark after another character (checked on
  the vocabulary) encodes from word mark to word mark; a space is a word mark.

Where the overlap holds no such boundary (a run without any), the overlap is doubled, at last up
to the rest of the document. Shorter documents are cut at spaces that follow a non-space, which
are such boundaries whatever the Unicode version, and each unit's count is remembered.

Defined results: null or empty text: 0 bytes, 0 tokens. Rows are never merged: repeated rows and
null ids give a row each. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: Longer than any contraction, and than any special string together with its neighbours.
GUARD = 32
#: Units remembered by a Python worker before it starts anew (memory only; results don't depend on it).
MEMO = 700_000
_MARK = "▁"
_SPACED = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
_UNIT = re.compile(r"(?<=\S)(?= )")
#: Characters whose classes no Unicode version disputes, and the pre-tokeniser's public pattern narrowed to them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf" ?[{_LETTERS}]+")
_KNOWN = re.compile(rf"[ \n!-~{_LETTERS}]*")
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n{_LETTERS}0-9]+|[ \n]+(?![^ \n])|[ \n]+")


class JsonCodec:
    """A tokenizers file. Only for byte-level BPE without normaliser may texts be cut."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.special = [x.content for x in t.get_added_tokens_decoder().values()]
        plain = all(not (x.lstrip or x.rstrip or x.single_word) for x in t.get_added_tokens_decoder().values())
        pre = t.pre_tokenizer
        self.cuttable = t.normalizer is None and type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and plain and all(" " not in x and "<|" in x and len(x) < GUARD for x in self.special)
        self.model, self.words = t.model, {}
        if self.cuttable:
            alone = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.alphabet = {c: alone.pre_tokenize_str(chr(c))[0][0] for c in (10, *range(32, 127), *range(192, 256))}

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def starts(self, text: str) -> tuple[Iterator[tuple[int, int]], int]:
        """From the end on, the character offset of each pre-token start and the number of tokens before it; and the number of tokens."""
        e = self.tokenizer.encode(text, add_special_tokens=False)

        def backwards() -> Iterator[tuple[int, int]]:
            for i in range(len(e) - 1, -1, -1):
                if not i or e.token_to_word(i) is None or e.token_to_word(i) != e.token_to_word(i - 1):
                    # trimmed offsets leave out a leading space: the start is where the token before it ends
                    yield (e.token_to_chars(i - 1)[1] if i else 0), i

        return backwards(), len(e)

    def split(self, text: str) -> tuple[str, list[str]]:
        """What stands before the first cut, and the units after it without the space that each begins with. Cuts are the spaces that follow a non-space."""
        if any(map(text.__contains__, _SPACED)):
            first, *rest = _UNIT.split(text)
            return first, [x[1:] for x in rest]
        first, *rest = text.split(" ")
        return first, rest

    def first(self, unit: str) -> list[int]:
        """A unit of undisputed characters is cut into pre-tokens here, which go to the library's BPE model; any other goes to the whole tokenizer."""
        if _WORD.fullmatch(unit):
            return [x.id for x in self.model.tokenize(unit.translate(self.alphabet))]
        if _KNOWN.fullmatch(unit) and ("<|" not in unit or not any(x in unit for x in self.special)):
            words, ids = self.words, []
            for w in _PRETOKEN.findall(unit):
                got = words.get(w)
                if got is None:
                    if len(words) > MEMO:
                        words.clear()
                    got = words[w] = tuple([x.id for x in self.model.tokenize(w.translate(self.alphabet))])
                ids += got
            return ids
        return self.ids([unit])[0]

    def later(self, unit: str) -> list[int]:
        return self.first(" " + unit)


class PieceCodec:
    """A sentencepiece model. Texts may be cut if no piece holds a word mark after another character."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.mark = sp.piece_to_id(_MARK)
        marks = not any(_MARK in sp.id_to_piece(i).lstrip(_MARK) for i in range(len(sp)))
        #: Texts are taken as they are: no normalisation, white space kept, a mark put before the text.
        self.cuttable = marks and sp.encode("a  b") != sp.encode("a b") and sp.encode("\u212b") != sp.encode("\u00c5") and sp.encode("\u3000") != sp.encode(" ")

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.ids(texts)]

    def after_mark(self, units: list[str]) -> list[list[int]]:
        """Ids of units that begin with a mark: the one that the library puts before any text but the empty one."""
        return [x if u[1:] else [self.mark] for u, x in zip(units, self.ids([u[1:] for u in units]), strict=True)]

    def starts(self, text: str) -> tuple[Iterator[tuple[int, int]], int]:
        """As above; text begins with a mark or is the beginning of a document."""
        first, *rest = self.units(text)
        counts = [len(self.ids([first])[0]), *map(len, self.after_mark(rest))]
        ends = list(zip(accumulate(map(len, [first, *rest[:-1]])), accumulate(counts[:-1]), strict=True)) if rest else []
        return reversed([(0, 0), *ends]), sum(counts)

    def units(self, text: str) -> list[str]:
        return re.split(r"(?<=[^ ▁])(?=[ ▁])", text)

    def split(self, text: str) -> tuple[str, list[str]]:
        """Cuts are the marks (spaces too) that follow another character."""
        other, mark = (" ", _MARK) if _MARK in text else (_MARK, " ")
        if other in text or mark + mark in text:
            first, *rest = self.units(text)
            return ("", [first[1:], *[x[1:] for x in rest]]) if first[:1] in (" ", _MARK) else (first, [x[1:] for x in rest])
        first, *rest = text.split(mark)
        return first, rest

    def first(self, unit: str) -> list[int]:
        return self.sp.encode(unit)

    def later(self, unit: str) -> list[int]:
        """The mark that the unit begins with is the one that the library puts before any text but the empty one."""
        return self.sp.encode(unit) if unit else [self.mark]


def codec(path: str) -> JsonCodec | PieceCodec:
    return PieceCodec(path) if path.endswith(".model") else JsonCodec(path)


class _Memo(dict):
    """Remembers up to `most` values, then starts anew."""

    def __init__(self, make: Callable[[str], bytes | int], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, unit: str) -> bytes | int:
        if len(self) >= self.most:
            self.clear()
        value = self[unit] = self.make(unit)
        return value


class Units:
    """Encodes cuttable texts unit by unit and remembers the units, as packed ids."""

    def __init__(self, c: JsonCodec | PieceCodec, pack: Callable[[list[int]], bytes | int], memo: int = MEMO):
        self.codec, self.pack = c, pack
        self.memo = _Memo(lambda unit: pack(c.later(unit)), memo)

    def __call__(self, text: str) -> list[bytes | int]:
        """The packed ids of a text's units, in order."""
        first, rest = self.codec.split(text)
        out = list(map(self.memo.__getitem__, rest))
        if first:
            out.insert(0, self.pack(self.codec.first(first)))
        return out


class Counter:
    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, memo: int = MEMO):
        self.codec, self.chunk, self.overlap = codec(path), chunk_chars, overlap_chars
        self.piece = isinstance(self.codec, PieceCodec)
        self.units = Units(self.codec, len, memo)

    def chunk_starts(self, text: str, begin: int, end: int) -> tuple[Iterator[tuple[int, int]], int]:
        if self.piece and begin:  # the chunk's own mark is the one that the library puts there
            starts, n = self.codec.starts("x" + text[begin:end])
            own = len(self.codec.ids(["x"])[0])
            return ((p - 1 + begin, k - own) for p, k in starts if p), n - own
        starts, n = self.codec.starts(text[begin:end])
        return ((p + begin, k) for p, k in starts), n

    def huge(self, text: str, begin: int = 0, chunk: int = 0) -> int:
        """Overlapping chunks, spliced; the tokens before `begin` are known to be right."""
        total, n, chunk = 0, len(text), chunk or self.chunk
        while True:
            end = min(n, begin + chunk)
            left, tokens = self.chunk_starts(text, begin, end)
            if end == n:
                return total + tokens
            next(left, None)  # the last two pre-tokens may change with what follows
            next(left, None)
            proven: dict[int, int] = {}
            overlap, splice = min(self.overlap, chunk // 2), None
            while splice is None and overlap < 2 * chunk:
                low = max(begin + 1, end - overlap)
                for p, k in left:
                    if begin < p <= end - GUARD:
                        proven[p] = k
                    if p < low:
                        break
                if self.piece:
                    found = [low + m.start() for m in re.finditer(r"(?<=[^ ▁])(?=[ ▁])", text[low:end])]
                else:
                    found = [low + p for p, _ in self.codec.starts(text[low : min(n, end + GUARD)])[0] if p]
                splice = max((p for p in found if p in proven), default=None)
                overlap *= 2
            if splice is None:  # no common boundary in this chunk: take a longer one
                chunk *= 2
                continue
            total += proven[splice]
            begin, chunk = splice, self.chunk

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.codec.cuttable:
            return self.codec.counts(texts)
        # a piece codec's text must not begin with a mark of its own
        return [sum(self.units(t)) if len(t) <= self.chunk and not (self.piece and t[:1] in (" ", _MARK)) else self.huge(t) for t in texts]


_kept: dict[tuple, Counter] = {}


def counter(path: str, chunk_chars: int, overlap_chars: int) -> Counter:
    """One for each Python worker, so that tasks share what it remembers."""
    key = (path, chunk_chars, overlap_chars)
    if key not in _kept:
        _kept[key] = Counter(*key)
    return _kept[key]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for each row of docs. One pass, no shuffle."""
    from .words import parts, tidy

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count_all = counter(path, chunk_chars, overlap_chars)
        for batch in batches:
            out: list[int] = []
            for part in parts(batch):
                out += count_all([x or "" for x in part.to_pylist()])
            yield pa.array(out, pa.int64())

    counted = F.arrow_udf(tidy(count), "long")
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), counted(F.col(text_col)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

