"""Oversized texts cut into pieces under a limit, at natural boundaries, with a given overlap.

Cuts by pointer doubling. The boundaries of a text are the positions at which a piece may end. Every
boundary is joined with its farthest legal successor: the last boundary that a piece starting ``overlap``
before it can reach within the limit. The join is a sorted search over the boundary arrays of a whole
Arrow batch (a successor always lies in the same text, so no shuffle is needed). The successor table is
then squared again and again, which yields all greedy cuts in O(log pieces) vector steps.

Natural boundaries, best first: the ends of blank lines, of lines, of words. Finer ones are added only
where the coarser leave a gap no piece could bridge; hard cuts only where there is no white space. A piece
begins at the last word boundary that leaves the overlap, so neighbours share at least that much; only a word of
more than SLACK of the way is begun in the middle.

Defined results: null and empty texts have no pieces; a text within the limit is one piece; a limit
that is null or not positive takes the default; an overlap above half the limit counts as half of it;
line numbers are 1-based in the file, a chunk whose first line is unknown (null, 0 or less) gives 0 for
both lines of its pieces; a generated header line at the start of a content is no line of the file.
Repeated rows count once; a text of any length is processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from srcquarry.llm.scan import code_points
from srcquarry.llm.tokens import batched
from srcquarry.runtime import spread

#: The defaults for languages without limits of their own.
DEFAULTS = {"min_tokens": 300, "max_tokens": 800, "chars_per_token": 4, "overlap_tokens": 80}
HEADER = "[symbol_kind="
#: Part of the way from one cut to the next that may go to an earlier start at a word boundary.
SLACK = 0.25


def with_limits(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``chunks`` with limit_chars and overlap_chars of their language."""
    per = limits.groupBy("lang").agg(*[F.max(c).alias(c) for c in ("max_tokens", "chars_per_token", "overlap_tokens")])
    joined = chunks.join(per, "lang", "left")

    def value(c: str) -> F.Column:
        return F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(DEFAULTS[c]))

    return joined.withColumn("limit_chars", value("max_tokens") * value("chars_per_token")).withColumn(
        "overlap_chars", value("overlap_tokens") * value("chars_per_token")
    )


def oversized(chunks: DataFrame) -> DataFrame:
    """Rows with more tokens than allowed: ceil(length / cpt) > max is the same as length > max * cpt."""
    return chunks.filter(F.length("content") > F.col("limit_chars"))


def _fill(cuts: np.ndarray, candidates: np.ndarray, reach: np.ndarray, doc_of, n: int) -> np.ndarray:
    """``cuts`` with ``candidates`` added inside the gaps wider than what a piece may advance."""
    wide = np.diff(cuts) > reach[doc_of(cuts[:-1])]
    if not wide.any() or not len(candidates):
        return cuts
    gap = np.searchsorted(cuts, candidates, side="right") - 1
    inside = (gap >= 0) & (gap < len(wide))
    inside[inside] &= wide[gap[inside]]
    return np.union1d(cuts, candidates[inside])


def split_batch(texts: list[str], limits: np.ndarray, overlaps: np.ndarray):
    """(index of the text, start, end) of the pieces of non-empty texts, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    bases = ends - sizes
    n = int(ends[-1])
    cp = code_points("".join(texts))
    overlaps = np.minimum(overlaps, limits // 2)
    slack = ((limits - overlaps) * SLACK).astype(np.int64)
    reach = limits - overlaps - slack

    def doc_of(pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(ends, pos, side="right")

    newline = cp == 10
    line_ends = np.flatnonzero(newline) + 1
    nxt = np.append(cp, 10)
    blank = line_ends[(nxt[line_ends] == 10) | (nxt[line_ends] == 13)]
    cuts = np.unique(np.concatenate([bases, ends]))
    words = np.flatnonzero(np.isin(cp, [32, 9, 0x3000])) + 1
    for finer in (blank, line_ends, words):
        cuts = _fill(cuts, finer, reach, doc_of, n)
    gaps = np.diff(cuts)
    room = reach[doc_of(cuts[:-1])]
    extra = np.maximum(0, -(-gaps // room) - 1)
    if extra.any():
        k = np.repeat(np.arange(len(gaps)), extra)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        cuts = np.union1d(cuts, cuts[k] + nth * room[k])
    # Farthest legal successor of each boundary; the end of a text is its own successor.
    doc = np.minimum(doc_of(cuts), len(texts) - 1)
    at_base = cuts == bases[doc]
    start = np.maximum(cuts - overlaps[doc], bases[doc])
    natural = np.unique(np.concatenate([bases, line_ends, words]))
    natural = natural[np.searchsorted(natural, start, side="right") - 1]
    start = np.where(at_base, cuts, np.where(natural >= np.maximum(start - slack[doc], bases[doc]), natural, start))
    last = np.searchsorted(cuts, ends)
    succ = np.minimum(np.searchsorted(cuts, start + limits[doc], side="right") - 1, last[doc])
    # A boundary that ends one text begins the next: the first pieces are looked up apart.
    heads = np.searchsorted(cuts, bases)
    is_head = np.zeros(len(cuts), bool)
    is_head[heads] = True
    stop = np.zeros(len(cuts), bool)
    stop[last] = True
    first = succ[heads]
    jump = np.where(stop, np.arange(len(cuts)), succ)
    reached = np.zeros(len(cuts), bool)
    reached[first] = True
    while True:
        more = reached.copy()
        more[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
        if (more == reached).all():
            break
        reached = more
    cut = np.flatnonzero(reached)
    piece_end = cuts[cut]
    which = np.searchsorted(ends, piece_end, side="left")
    prev = np.append(0, cut[:-1])
    new = np.append(True, which[1:] != which[:-1])
    piece_start = np.where(new, bases[which], start[prev])
    return which, piece_start - bases[which], piece_end - bases[which]


def split_chunks(chunks: DataFrame, limits: DataFrame, with_content: bool = True) -> DataFrame:
    """Pieces of the oversized chunks: (id, piece, n_pieces, start_char, end_char, start_line, end_line[, content])."""
    big = oversized(with_limits(chunks.select("id", "lang", "content", "start_line"), limits)).select(
        "id", "content", "start_line", "limit_chars", "overlap_chars"
    )
    schema = "id string, piece int, n_pieces int, start_char int, end_char int, start_line int, end_line int"
    schema += ", content string" if with_content else ""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in batched(whole.column(1).to_pylist()):
                batch = whole.slice(a, b - a)
                ids, texts, line = (batch.column(k).to_pylist() for k in range(3))
                limit, over = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
                doc, start, end = split_batch(texts, limit, over)
                count = np.bincount(doc, minlength=len(texts))
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                rows = []
                for d, k, s, e in zip(doc.tolist(), nth.tolist(), start.tolist(), end.tolist()):
                    t = texts[d]
                    first = last = 0
                    if line[d] is not None and line[d] > 0:
                        head = 0
                        if t.startswith(HEADER):
                            head = 2 if t[t.find("\n") + 1 :].startswith(("\n", "\r\n")) else 1
                        first = line[d] + max(0, t.count("\n", 0, s) - head)
                        last = line[d] + max(0, t.count("\n", 0, max(s, e - 1)) - head)
                    rows.append((ids[d], k, int(count[d]), s, e, first, last) + ((t[s:e],) if with_content else ()))
                cols = list(zip(*rows)) if rows else [()] * len(names)
                types = [pa.string()] + [pa.int32()] * 6 + [pa.string()] * with_content
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return spread(big).mapInArrow(run, schema).distinct()
