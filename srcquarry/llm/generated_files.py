"""Files nobody wrote by hand for their repository: generated, minified, vendored, or data stored as code.

A random forest on compression ratio, token entropy, identifier lengths, comment density and line shapes.
Labels come from notices in file headers; header comments and notices are cut out before any
feature is computed, so the forest learns what such files look like without them. Two corpus statistics
over all rows join the features, both without labels: in how many repositories the same content occurs, and in how
many a file of the same base name.

The forest is fitted on at most SAMPLE rows chosen by hash, notices or not; every row is scored, and its score alone
decides (THRESHOLD: most of the trees). Many such files carry no notice, so rows without one are not all negatives: a first
forest scores the sample out of bag, and the second is fitted without the unlabelled rows that score DOUBT or more.

Defined results: a file with null or empty content has only its name to go by; repeated rows count once;
extra columns are ignored; a table without any label (notice, or data by DATA_SHARE) has nothing to learn from and no hit.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from srcquarry.llm.forest import Forest
from srcquarry.llm.near_duplicates import _WORD, _U, _mix, _power_tables
from srcquarry.llm.tokens import batched
from srcquarry.runtime import Scratch, spread

#: Rows the forest is fitted on at most.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Out-of-bag score from which a row without a notice is no reliable negative.
DOUBT = 0.08
#: Share of literals in what is neither comment nor punctuation above which a file is labelled as data stored
#: as code (such files carry no notices), from DATA_SIZE characters on.
DATA_SHARE, DATA_SIZE = 0.9, 400

NOTICE = re.compile(
    r"code generated by|auto(?:matically|-)? ?generated|generated automatically|\bmaschinell erzeugt|automatisch (?:erzeugt|generiert)"
    r"|g[ée]n[ée]r[ée] automatiquement|generado autom[áa]ticamente|@generated\b|<auto-generated|\bGenerated\s*\(|generated source\b"
    r"|(?:this file|manual edits?|any modifications?|changes)\b[^\n]{0,40}\b(?:will be|are) (?:lost|overwritten)|produced by [^\n]{1,40}do not (?:modify|edit)"
    r"|never commit changes here|output of `|\bregenerate with\b"
    r"|@license\b|\(c\) (?:the )?[\w.-]+ (?:authors|project|contributors)\b|copyright (?:\(c\) )?(?:\d{4} )?the [\w.-]+ (?:contributors|authors)\b"
    r"|released under the \w+ licen[cs]e|distributed under the [\w-]+ licen[cs]e|keep this notice|\bupstream: \S+|(?m:^\s*/\*! ?\S)|sourceMappingURL=",
    re.I,
)
UPPER_NOTICE = re.compile(r"\bDO NOT (?:EDIT|MODIFY)\b")
#: Leading comments and blank lines.
HEADER = re.compile(r"﻿?(?:\s+|/\*.*?\*/|//[^\n]*(?:\n|$)|<!--.*?-->|#![^\n]*(?:\n|$))*", re.S)
# A quotation that is not closed ends with its line, so that no text takes more than linear time.
PARTS = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|<!--.*?(?:-->|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*`?|\b0x[0-9a-fA-F]+|-?\b\d[\d.]*", re.S)
NON_WORD = re.compile(r"\W+")

FEATURES = (
    "compression", "token_entropy", "token_distinct", "identifier_length", "identifier_length_sd", "short_identifiers", "long_identifiers", "digit_tokens",
    "comment_share", "literal_share", "longest_literal", "line_length", "longest_line", "shape_distinct", "shape_top", "blank_share", "upper_share", "log_size",
    "tokens_per_line", "punctuation", "indent_mean", "data_share",
)


def has_notice(text: str) -> bool:
    """Does the header, an annotation or the last line carry a notice?"""
    end = HEADER.match(text).end()
    body = text[end:]
    # Without blank lines, as a search across a long run of them would not be linear.
    head = "\n".join(x for x in text[:end].split("\n") if x.strip()) + "\n"
    # Some tools put the notice below the first line of code.
    head += "\n".join(x for x in body[:1500].split("\n")[:6] if x.lstrip().startswith(("//", "/*", "*", "<!--")))
    first = "\n".join(x for x in body.split("\n") if "@" in x and "Generated" in x)
    last = text.rstrip().rsplit("\n", 1)[-1]
    last = last if "sourceMappingURL" in last else ""
    seen = f"{head}\n{first}\n{last}"
    return bool(NOTICE.search(seen) or UPPER_NOTICE.search(seen))


def without_notice(text: str) -> str:
    """The text as the features see it: no header comments, no annotation or footer that carries a notice."""
    body = text[HEADER.match(text).end() :]
    top, rest = body[:1500], body[1500:]
    lines = top.split("\n")
    lines[:6] = [x for x in lines[:6] if not (x.lstrip().startswith(("//", "/*", "*", "<!--")) and (NOTICE.search(x) or UPPER_NOTICE.search(x)))]
    return re.sub(r"(?m)^[^\n]*(?:@[\w.]*Generated\s*\(|sourceMappingURL=)[^\n]*$\n?", "", "\n".join(lines) + rest)


def base_name(path: str) -> str:
    """The name of a file without directories, extensions and a version at its end."""
    return re.sub(r"[-_.]?v?\d+$", "", path.split("/")[-1].split(".")[0]).lower()


def _segments(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _grouped_entropy(keys: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entropy of the keys in bits, share of distinct keys, share of the commonest key) of each document."""
    if not len(keys):
        return (np.zeros(docs),) * 3
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
    c = np.diff(np.append(first, len(k))).astype(np.float64)
    g = d[first]
    n = np.maximum(1, np.bincount(doc, minlength=docs))
    top = np.zeros(docs)
    np.maximum.at(top, g, c)
    return np.log2(n) - np.bincount(g, c * np.log2(c), docs) / n, np.bincount(g, minlength=docs) / n, top / n


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text (notices already removed)."""
    docs = len(texts)
    raws = [t.encode("utf-8", "replace") for t in texts]
    joined = b"\n".join(raws) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    n = len(raw)
    ends = np.cumsum([len(r) + 1 for r in raws])
    size = np.maximum(1, np.diff(np.append(0, ends)) - 1).astype(np.float64)
    word = _WORD[raw]
    is_word = np.concatenate([[False], word > 0, [False]])
    start, end = np.flatnonzero(~is_word[:-1] & is_word[1:]), np.flatnonzero(is_word[:-1] & ~is_word[1:])
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(word.astype(_U) * up[:n], out=total[1:])
    hashes = _mix((total[end] - total[start]) * down[start])
    doc = np.searchsorted(ends, start, side="right")
    entropy, distinct, _ = _grouped_entropy(hashes, doc, docs)
    length = (end - start).astype(np.float64)
    ident = ~((raw[start] >= 48) & (raw[start] <= 57))
    tokens = np.bincount(doc, minlength=docs)
    idents = np.maximum(1, np.bincount(doc[ident], minlength=docs))
    mean = np.bincount(doc[ident], length[ident], docs) / idents
    sd = np.sqrt(np.maximum(0, np.bincount(doc[ident], length[ident] ** 2, docs) / idents - mean**2))
    short = np.bincount(doc[ident & (length <= 2)], minlength=docs) / idents
    long = np.bincount(doc[length >= 40], minlength=docs) / np.maximum(1, tokens)
    digits = np.bincount(doc[~ident], minlength=docs) / np.maximum(1, tokens)
    # Lines and their shapes: the punctuation of a line, in order.
    line_end = np.flatnonzero(raw == 10)
    line_doc = np.searchsorted(ends, line_end, side="right")
    line_start = np.append(0, line_end[:-1] + 1)
    line_len = (line_end - line_start).astype(np.float64)
    lines = np.maximum(1, np.bincount(line_doc, minlength=docs))
    longest = np.zeros(docs)
    np.maximum.at(longest, line_doc, line_len)
    punct = (word == 0) & (raw > 32) & (raw < 127)
    kept = np.where(punct, raw, 0).astype(_U)
    rank = np.cumsum(punct)
    psum = np.zeros(n + 1, _U)
    np.cumsum(np.where(punct, kept * up[np.maximum(rank - 1, 0)], _U(0)), out=psum[1:])
    before = np.append(0, rank)
    shape = _mix((psum[line_end] - psum[line_start]) * down[before[line_start]] + (before[line_end] - before[line_start]).astype(_U))
    solid = line_len > 0
    _, shapes, top = _grouped_entropy(shape[solid], line_doc[solid], docs)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(mask))
        edge = np.append(0, ends)
        return (c[edge[1:]] - c[edge[:-1]]) / size

    blank = share((raw == 32) | (raw == 9))
    upper = share((raw >= 65) & (raw <= 90))
    pun = share(punct)
    solid_at = np.append(np.flatnonzero((raw > 32)), n)
    first_solid = solid_at[np.searchsorted(solid_at, line_start)]
    indent = np.where(first_solid < line_end, first_solid - line_start, 0)
    indent_mean = np.bincount(line_doc, indent, docs) / lines
    comment, literal, longest_literal, ratio, data = (np.zeros(docs) for _ in range(5))
    for k, t in enumerate(texts):
        spans = [0, 0, 0]  # in comments, in literals, the longest literal

        def drop(m: re.Match, spans: list[int] = spans) -> str:
            w = m.end() - m.start()
            if m[0][:2] in ("/*", "//", "<!"):
                spans[0] += w
            else:
                spans[1] += w
                spans[2] = max(spans[2], w)
            return ""

        rest = len(NON_WORD.sub("", PARTS.sub(drop, t)))
        z = max(1, len(t))
        comment[k], literal[k], longest_literal[k] = spans[0] / z, spans[1] / z, spans[2]
        data[k] = spans[1] / max(1, spans[1] + rest)
        ratio[k] = len(zlib.compress(raws[k], 1)) / max(1, len(raws[k])) if raws[k] else 1.0
    return np.stack(
        [ratio, entropy, distinct, mean, sd, short, long, digits, comment, literal, longest_literal, size / lines, longest, shapes, top, blank, upper, np.log2(size), tokens / lines, pun, indent_mean, data], 1
    )


def described(sources: DataFrame) -> DataFrame:
    """(file, repo_id, notice, data, digest, base, x) of (file, repo_id, content)."""
    schema = "file string, repo_id string, notice int, data int, digest bigint, base string, x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, repos, texts = (batch.column(k).to_pylist() for k in range(3))
            for a, b in batched(texts):
                own = [t or "" for t in texts[a:b]]
                bodies = [without_notice(t) for t in own]
                x = features(bodies)
                notice = [int(has_notice(t)) for t in own]
                lit = FEATURES.index("data_share")
                data = [int(bool(t) and v > DATA_SHARE and w > DATA_SIZE) for t, v, w in zip(bodies, x[:, lit], map(len, bodies))]
                digest = [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) if t else None for t in bodies]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(files[a:b], pa.string()), pa.array(repos[a:b], pa.string()), pa.array(notice, pa.int32()), pa.array(data, pa.int32()), pa.array(digest, pa.int64()), pa.array([base_name(f) for f in files[a:b]], pa.string()), pa.array(x.tolist(), pa.list_(pa.float64()))],
                    names=["file", "repo_id", "notice", "data", "digest", "base", "x"],
                )

    return spread(sources.select("file", "repo_id", "content").filter("file is not null")).mapInArrow(run, schema)


def with_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` with two more features: repositories with the same content, repositories with the same base name."""
    out = rows
    for key in ("digest", "base"):
        # Only what occurs in several repositories needs a join; all else counts one.
        several = rows.filter(F.col(key).isNotNull()).select(key, "repo_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias(f"{key}_repos")).filter(F.col(f"{key}_repos") > 1)
        out = out.join(several, key, "left")
    extra = F.array(*[F.coalesce(f"{key}_repos", F.lit(1)).cast("double") for key in ("digest", "base")])
    return out.select("file", "notice", "data", F.concat("x", extra).alias("x"))


def scored(sources: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(file, notice, data, score) of every file."""
    scratch = Scratch(sources.sparkSession, "generated")
    rows = scratch.write(described(sources), "described")
    full = scratch.write(with_statistics(rows), "full")
    scratch.drop("described")
    # A bounded sample, chosen by hash so that it is the same on every run.
    train = full.select(F.xxhash64("file").alias("h"), F.greatest("notice", "data").alias("y"), "x").orderBy("h").limit(sample).toPandas()
    y = train["y"].to_numpy(np.float64) if len(train) else np.zeros(0)
    forest = None
    if y.any():
        x = np.array(train["x"].tolist())
        first = Forest(leaf=15).fit(x, y)
        sure = (y == 1) | (first.out_of_bag < DOUBT)
        forest = Forest().fit(x[sure], y[sure])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                s = forest.score(x) if forest is not None else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s)], names=["file", "notice", "data", "score"])

    return full.mapInArrow(run, "file string, notice int, data int, score double")


def not_hand_written(files: DataFrame, sources: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(file), spelled as in ``files``."""
    hits = scored(sources, sample).filter(F.col("score") >= threshold).select("file")
    return files.select("file").filter("file is not null").distinct().join(hits.distinct(), "file", "left_semi")
