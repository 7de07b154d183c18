"""Order- or structure-dependent functions that Column expressions cannot state, as Arrow-batched functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def json_contained(inner, outer) -> bool:
    """Recursive containment: objects by key, arrays by some equal or containing element, scalars by equality."""
    if isinstance(inner, dict):
        return isinstance(outer, dict) and all(k in outer and json_contained(v, outer[k]) for k, v in inner.items())
    if isinstance(inner, list):
        return isinstance(outer, list) and all(any(json_contained(v, w) for w in outer) for v in inner)
    if isinstance(outer, list) and not isinstance(inner, (dict, list)):
        return any(json_contained(inner, w) for w in outer if not isinstance(w, (dict, list)))
    return type(inner) is type(outer) and inner == outer or (isinstance(inner, (int, float)) and isinstance(outer, (int, float)) and not isinstance(inner, bool) and not isinstance(outer, bool) and inner == outer)


def json_contains(column: Column | str, wanted: dict) -> Column:
    """Does a JSON text contain an object? Null or broken texts do not."""

    @F.pandas_udf(T.BooleanType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return x is not None and json_contained(wanted, json.loads(x))
            except ValueError:
                return False

        return s.map(one).astype(bool)

    return run(column)


def json_pointer(doc, pointer: str, depth: int = 24):
    """Value at an RFC 6901 pointer, following ``$ref`` at most ``depth`` times; None if there is none."""
    root, seen = doc, set()

    def walk(ref: str):
        at = root
        for part in ref.lstrip("#").split("/")[1:]:
            key = part.replace("~1", "/").replace("~0", "~")
            if isinstance(at, dict):
                at = at.get(key)
            elif isinstance(at, list) and key.isdigit() and int(key) < len(at):
                at = at[int(key)]
            else:
                return None
        return at

    value = walk(pointer)
    while isinstance(value, dict) and isinstance(value.get("$ref"), str) and depth > 0 and value["$ref"] not in seen:
        seen.add(value["$ref"])
        value, depth = walk(value["$ref"]), depth - 1
    return value


def resolve_pointer(column: Column | str, pointer: str) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                v = json_pointer(json.loads(x), pointer) if x else None
            except ValueError:
                return None
            return None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True)

        return s.map(one)

    return run(column)


def segments(text: str, limit: int, overlap: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of windows of at most ``limit`` code points, cut at a line end in the last third where there is one."""
    over = limit // 10 if overlap is None else min(overlap, limit // 2)
    out, a = [], 0
    while a < len(text):
        b = min(len(text), a + limit)
        if b < len(text):
            cut = text.rfind("\n", a + 2 * limit // 3, b)
            b = cut + 1 if cut > a else b
        out.append((a, b))
        if b >= len(text):
            break
        a = max(b - over, a + 1)
    return out


def segmented(df: DataFrame, key: str, text: str, limit: int, overlap: int | None = None) -> DataFrame:
    """(key, segment, start, end) of every text."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType)]).add("segment", T.IntegerType()).add("start", T.IntegerType()).add("end", T.IntegerType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, s, e) for k, t in zip(b[key], b[text]) for i, (s, e) in enumerate(segments(t or "", limit, overlap))]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, text).mapInPandas(run, schema)


def merge_small(parts: pd.DataFrame, least: int, most: int, gap: int = 2, cpt: int = 4) -> list[tuple[int, int]]:
    """(first, last) row ranges of neighbours merged: same type, at most ``gap`` lines apart, together within ``least`` tokens.

    A merge starts at a part below max(40, least / 4) tokens.
    """
    seed = max(40, least // 4)
    rows = list(zip(parts["chunk_type"], parts["start_line"], parts["end_line"], parts["size"]))
    out, i = [], 0
    while i < len(rows):
        j, size = i, rows[i][3]
        if -(-size // cpt) < seed:
            while j + 1 < len(rows) and rows[j + 1][0] == rows[i][0] and rows[j + 1][1] - rows[j][2] <= gap and -(-(size + rows[j + 1][3] + 1) // cpt) <= least:
                size += rows[j + 1][3] + 1
                j += 1
        out.append((i, j))
        i = j + 1
    return out


def merged_chunks(df: DataFrame, least: int = 300, most: int = 800) -> DataFrame:
    """(file, chunk, parts, start_line, end_line) of (file, chunk_type, start_line, end_line, size): a fold within each file.

    Rows arrive sorted by file, so a batch holds many whole files; the rows of the last one wait for the next batch.
    """
    columns = ["file", "chunk", "parts", "start_line", "end_line"]

    def fold(g: pd.DataFrame) -> Iterator[tuple]:
        ends = g["end_line"].to_numpy()
        for k, (a, b) in enumerate(merge_small(g, least, most)):
            yield g["file"].iloc[a], k, b - a + 1, int(g["start_line"].iloc[a]), int(ends[a : b + 1].max())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            cut = (b["file"] != b["file"].iloc[-1]).to_numpy().sum() if len(b) else 0
            rest = b.iloc[cut:].reset_index(drop=True)
            yield pd.DataFrame([r for _, g in b.iloc[:cut].groupby("file", sort=False) for r in fold(g)], columns=columns)
        if rest is not None and len(rest):
            yield pd.DataFrame(list(fold(rest)), columns=columns)

    placed = df.select("file", "chunk_type", "start_line", "end_line", "size").filter("file is not null").repartition("file")
    placed = placed.sortWithinPartitions("file", "start_line", "end_line", "size", "chunk_type")
    return placed.mapInPandas(run, "file string, chunk int, parts int, start_line int, end_line int")


def window_text(content: str, lines: list[int], limit: int = 6000) -> str:
    """Numbered lines around places of interest: 40 to each side, fewer until the text fits, 5 at last."""
    rows = content.split("\n")
    places = sorted({n for n in lines if 1 <= n <= len(rows)}) or [1]
    text = ""
    for radius in [*range(40, 7, -4), 5]:
        spans: list[list[int]] = []
        for n in places:
            a, b = max(1, n - radius), min(len(rows), n + radius)
            if spans and a <= spans[-1][1] + 1:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        text = "\n...\n".join("\n".join(f"{k}: {rows[k - 1]}" for k in range(a, b + 1)) for a, b in spans)
        if len(text) <= limit:
            break
    return text[:limit]


FENCE = re.compile(r"```[\w+-]*\n(.*?)```", re.S)


def response_files(text: str) -> dict[str, str]:
    """Path to content out of a response: a fenced or bare JSON object, also nested under ``files`` or as a list."""
    for part in [*FENCE.findall(text), text]:
        a = part.find("{") if "{" in part else -1
        for start, end in ((part.find("{"), part.rfind("}")), (part.find("["), part.rfind("]"))):
            if a < 0 and start < 0 or start < 0 or end <= start:
                continue
            try:
                value = json.loads(part[start : end + 1])
            except ValueError:
                continue
            if isinstance(value, dict) and isinstance(value.get("files"), (dict, list)):
                value = value["files"]
            if isinstance(value, list):
                value = {x["path"]: x.get("content") for x in value if isinstance(x, dict) and isinstance(x.get("path"), str)}
            if isinstance(value, dict) and value and all(isinstance(v, str) for v in value.values()):
                return value
    return {}


def response_map(column: Column | str) -> Column:
    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: response_files(x) if x else {})

    return run(column)


#: What a block holds whose own blocks are looked at.
_TYPE_HEADER = re.compile(r"\b(class|interface|enum|record|struct|namespace|module)\b[^{;]*$")


def without_bodies(text: str) -> str:
    """A source with the bodies of its innermost-but-types blocks elided: headers stay."""
    out, depth, keep_to, at = [], 0, None, 0
    for mark in re.finditer(r"[{};]", text):
        i, c = mark.start(), mark[0]
        seen = keep_to is None
        if seen:
            out.append(text[at:i])
        if c == "{":
            if seen and not _TYPE_HEADER.search(text, at, i):
                c, keep_to = "{ … }", depth
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == keep_to:
                keep_to = None
        if seen:
            out.append(c)
        at = i + 1
    return "".join([*out, text[at:]] if keep_to is None else out)


def sliced_signatures(column: Column | str) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: without_bodies(x) if x else x)

    return run(column)


def hash_vector(text: str, dim: int = 64) -> list[float]:
    """Deterministic unit vector of a text, for pipelines without a model."""
    import hashlib

    import numpy as np

    seed = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")
    v = np.random.default_rng(seed).standard_normal(dim)
    return (v / np.linalg.norm(v)).tolist()


class LimitExceeded(Exception):
    """A provider refused a batch or text as too large."""


def embed_all(texts: list[str], provider: Callable[[list[str]], list[list[float]]], limit: int = 30_000, least: int = 32) -> list[tuple[int, str, list[float] | None]]:
    """(index of the text, piece, vector) in order: batches refused as too large are halved, single texts cut; a piece that
    is refused below ``least`` code points has no vector."""
    out: list[tuple[int, str, list[float] | None]] = []
    work = [([(i, t) for i, t in enumerate(texts)], limit)]
    while work:
        part, cap = work.pop()
        if not part:
            continue
        try:
            vectors = provider([t for _, t in part])
            out += [(i, t, v) for (i, t), v in zip(part, vectors)]
        except LimitExceeded:
            if len(part) > 1:
                half = len(part) // 2
                work += [(part[half:], cap), (part[:half], cap)]
            else:
                cap = min(cap, len(part[0][1])) // 2
                if cap >= least:
                    i, t = part[0]
                    work.append(([(i, t[a:b]) for a, b in segments(t, cap)], cap))
                else:
                    out.append((*part[0], None))
    return out


def embedded(df: DataFrame, key: str, text: str, provider: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64) -> DataFrame:
    """(key, nth, pieces, piece, embedding): one row per text, several for a text that had to be cut; the provider is set up once
    per worker batch stream."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType)]).add("nth", T.IntegerType()).add("pieces", T.IntegerType()).add("piece", T.StringType()).add("embedding", T.ArrayType(T.FloatType()))
    call = provider or (lambda ts: [hash_vector(t) for t in ts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), batch):
                part = b.iloc[a : a + batch]
                found = embed_all([x if x and x.strip() else " " for x in part[text]], call)
                own = [i for i, _, _ in found]
                rows = [(part[key].iloc[i], k - own.index(i), own.count(i), t, v) for k, (i, t, v) in enumerate(found)]
                yield pd.DataFrame(rows, columns=schema.names)

    return df.select(key, text).mapInPandas(run, schema)
