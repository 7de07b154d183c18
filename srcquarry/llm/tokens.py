"""Whole-corpus encoding with a public byte-level BPE tokenizer.

Pre-tokenisation works on arrays: a table of code point classes and an automaton run as an associative
scan (``scan.py``) find the token boundaries of a whole Arrow batch at once, without a regular expression.
The slices between boundaries go through a cached pair merging.

Defined results: null and empty texts get an empty list; strings that look like control tokens are
ordinary text; very long texts and very long runs without boundary are merged with a heap in
O(n log n). Extra columns and repeated rows pass through untouched (one result per input row).
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from srcquarry.llm.scan import code_points, states_before
from srcquarry.runtime import Scratch, spread

#: Place of the vocabulary files; every entry point takes it as a parameter.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of the merge cache of a worker; it is emptied when full.
CACHE_ENTRIES = 300_000

# Classes of the automaton. A space or other white space is told apart by whether white space follows.
LETTER, DIGIT, OTHER, SPACE_END, SPACE_MORE, WHITE_END, WHITE_MORE, SHORT1, SHORT2, BREAK = range(10)
# States: what the token that is being read is.
NONE, IN_LETTERS, IN_DIGITS, IN_OTHER, IN_WHITE, PENDING_SPACE, TAIL1, TAIL2 = range(8)

_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """Letter, digit, other or white space for each code point."""
    global _kinds
    if _kinds is None:
        table = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            g = unicodedata.category(chr(c))
            if g[0] == "L":
                table[c] = LETTER
            elif g[0] == "N":
                table[c] = DIGIT
        # The code points with the White_Space property.
        white = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        table[white] = WHITE_END
        _kinds = table
    return _kinds


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a token begin at this character) by class and state."""
    nxt, begin = np.zeros((10, 8), np.uint8), np.ones((10, 8), bool)
    for s in range(8):
        if s == TAIL2 or s == TAIL1:  # the letters of a contraction belong to it whatever they are
            nxt[:, s] = TAIL1 if s == TAIL2 else NONE
            begin[:, s] = False
            continue
        for c, run in ((LETTER, IN_LETTERS), (DIGIT, IN_DIGITS), (OTHER, IN_OTHER)):
            nxt[c, s] = run
            begin[c, s] = s not in (run, PENDING_SPACE)
        for c, tail in ((SHORT1, TAIL1), (SHORT2, TAIL2)):
            joins = s in (IN_OTHER, PENDING_SPACE)  # then the apostrophe is one more of other characters
            nxt[c, s] = IN_OTHER if joins else tail
            begin[c, s] = not joins
        for c in (SPACE_MORE, WHITE_MORE):
            nxt[c, s], begin[c, s] = IN_WHITE, s != IN_WHITE
        nxt[SPACE_END, s], nxt[WHITE_END, s] = PENDING_SPACE, NONE
    nxt[BREAK, :] = NONE
    return nxt, begin


NEXT, BEGIN = _tables()


def boundaries(text: str, ends: np.ndarray) -> np.ndarray:
    """Start offsets of the tokens of ``text``, whose documents end at ``ends`` (ascending code point offsets)."""
    cp = code_points(text)
    n = len(cp)
    if not n:
        return np.empty(0, np.int64)
    kind = _kind_table()[np.minimum(cp, 0x10FFFF)]
    last = np.zeros(n, bool)
    last[ends[(ends > 0)] - 1] = True
    white = kind == WHITE_END
    follows = np.zeros(n, bool)  # white space, or the end of the document, comes next
    follows[:-1] = white[1:]
    follows |= last
    space = cp == 32
    cls = kind.copy()
    cls[white & follows] = WHITE_MORE
    cls[space & follows] = SPACE_MORE
    cls[space & ~follows] = SPACE_END
    quote = np.flatnonzero((cp == 39) & ~last)
    if len(quote):
        pad = np.concatenate([cp, np.zeros(2, np.uint32)])
        a, b = pad[quote + 1], np.where(last[np.minimum(quote + 1, n - 1)], 0, pad[quote + 2])
        cls[quote[np.isin(a, [115, 116, 109, 100])]] = SHORT1  # 's 't 'm 'd
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # 're 've 'll
        cls[quote[two]] = SHORT2
    # The state is set back at the start of each document: a break is put in between.
    at = ends[(ends > 0) & (ends < n)]
    at = np.unique(at)
    with_breaks = np.insert(cls, at, BREAK)
    state = np.delete(states_before(with_breaks, NEXT), at + np.arange(len(at)))
    return np.flatnonzero(BEGIN[cls, state])


class Merger:
    """Byte pair merging by rank, cached by slice."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cache: dict[str, list[int]] = {}

    def encode(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8", "replace"))
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            if len(piece) < 200:
                self.cache[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        n = len(raw)
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != both:
                continue  # one of the two has been merged since
            parts[i], parts[j] = both, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(both + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, both + parts[k]))
            h = left[i]
            if h >= 0 and (r := ranks.get(parts[h] + both)) is not None:
                heapq.heappush(heap, (r, h, parts[h] + both))
        return [ranks[p] for p in parts if p is not None]


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def encode_texts(texts: list[str | None], path: str, offsets: bool = False):
    """(number of ids per text, all ids, code point offset in its text where each id's slice starts)."""
    m = merger(path)
    whole = "".join(t or "" for t in texts)
    ends = np.cumsum([len(t or "") for t in texts], dtype=np.int64)
    starts = boundaries(whole, ends)
    cuts = [*starts.tolist(), len(whole)]
    encode = m.encode
    pieces = [encode(whole[a:b]) for a, b in zip(cuts, cuts[1:])]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    doc = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(doc, weights=sizes, minlength=len(texts)).astype(np.int64)[: len(texts)]
    ids = np.fromiter((i for p in pieces for i in p), np.int32, int(sizes.sum()))
    if not offsets:
        return counts, ids, None
    base = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return counts, ids, np.repeat(starts - base[doc], sizes).astype(np.int32)


#: Code points that are encoded at once; a longer text forms a batch of its own.
BATCH_POINTS = 1 << 20


def batched(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about BATCH_POINTS code points together."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= BATCH_POINTS:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


#: Keys of repeated rows that are broadcast at most; more are joined by a shuffle.
MOST_REPEATED = 1_000_000


def once(df: DataFrame, key: str) -> DataFrame:
    """The distinct rows of ``df``, spread over the cluster. Only rows whose ``key`` occurs more than once are shuffled."""
    scratch = Scratch(df.sparkSession, "once")
    many, n = scratch.write_counted(df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("__key"), "many")
    if not n:
        return spread(df)
    many = F.broadcast(many) if n <= MOST_REPEATED else many
    same = F.col(key).eqNullSafe(F.col("__key"))
    return spread(df).join(many, same, "left_anti").unionByName(df.join(many, same, "left_semi").distinct())


def encode_column(df: DataFrame, key: str, text: str, what: str = "ids", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", even: bool = False) -> DataFrame:
    """``key`` with the encoding of ``text`` of each row.

    what = "ids": ids array<int>; "offsets": also offsets array<int>, the code point offset in the text at
    which the slice of each id starts, for decoding and alignment; "count": n_tokens long only. ``even``: the rows are
    spread over the cluster already.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)])
    if what == "count":
        schema = schema.add("n_tokens", T.LongType())
    else:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
        if what == "offsets":
            schema = schema.add("offsets", T.ArrayType(T.IntegerType()))

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batched(texts):
                counts, ids, offs = encode_texts(texts[a:b], vocabulary, what == "offsets")
                cols = [batch.column(0).slice(a, b - a)]
                if what == "count":
                    cols.append(pa.array(counts))
                else:
                    cols.append(lists(ids, counts))
                    if what == "offsets":
                        cols.append(lists(offs, counts))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    rows = df.select(key, text)
    return (rows if even else spread(rows)).mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> str:
    """The text of a list of ids (round trip of ``encode_column``)."""
    m = merger(vocabulary)
    if not hasattr(m, "back"):
        m.back = {v: k for k, v in m.ranks.items()}
    return b"".join(m.back[i] for i in ids).decode("utf-8")
