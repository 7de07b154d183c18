"""The most similar vectors of every vector within its group, by collision counting.

Each vector is projected on PROJECTIONS random lines, and each line keeps the vectors of a block as a sorted
array. A query opens a window around its own value on every line; vectors inside the windows of at least a
share of the lines collide often enough and are verified exactly. Virtual rehashing: the first windows are narrow,
queries that have ``k`` verified neighbours within the radius of a round are done, only the others go on to wider
windows of the same arrays. No count of candidates ends a search.

How it runs: values are quantised to one byte per line. The sorted array of a line is kept as bitmaps of its
prefixes (the vectors below each value), so a window is the difference of two prefixes and the collisions of
64 vectors on all lines are counted at once by bitwise adders. No bucket table is built and none can overflow.

Distribution: a group is cut into blocks of bounded size, and pairs of blocks are tasks, also where one group
holds a third of all rows. From the size at which it pays (``route``: some ten thousand rows), a group is first range-partitioned
by the values on small sets of lines: pairs that collide on so many lines share all ranges of one of the sets, but
for MISS of those at the threshold. The number of sets and of lines in a set follow from the size of the group, so the
pairs looked at grow less than with its square. A range with more rows than a block is cut into blocks as well.
Exact copies form one class first, so a group of copies is one row and expands to at most ``k`` neighbours per member.

Accuracy: with the 40 lines and the widest window, a pair at the similarity threshold collides often enough with a
probability above 0.999 (binomial over the lines); unrelated pairs pass with about 1e-4 and are then verified exactly.

Without a threshold no window is wide enough for all queries (on sf0.1 most have no vector at 0.9), so
``neighbours`` compares those that are still undecided after the last round with all vectors of their group, in blocks.

Defined results: embeddings that are null, of another length, with null, NaN or infinite values or all
zero take no part; repeated rows count once; a row of a null group takes no part; a vector is not its own
neighbour; ties in similarity go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from srcquarry.llm.near_duplicates import _U, _mix
from srcquarry.runtime import Scratch, spread

PROJECTIONS = 40
BLOCK = 4096
#: Share of the pairs at the threshold that the ranges of large groups may miss.
MISS = 1e-3
#: What one more copy of a row costs, in comparisons.
COPY = 1000
#: The vectors are looked for within this part of the last radius first.
NARROW = 0.5
#: Width of a range of a line, in radii.
RANGE = 4.0
#: Queries of a block that are counted at a time.
STRIP = 128
#: Without a threshold windows are opened down to this similarity.
LOWEST = 0.9
#: More than the error of a single-precision cosine of unit vectors.
ERROR = 1e-5
#: Windows reach this many times the radius to each side (the projections have unit variance).
REACH = 2.0
#: Share of the lines on which a pair must collide.
SHARE = 0.8
#: Byte steps per unit of a projection; values are clipped at +-STEPS range.
STEPS = 24.0


def fill() -> int:
    """Rows of a block on average, with room for chance."""
    return int(BLOCK * 0.9)


def directions(dim: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, PROJECTIONS))


def radius(threshold: float) -> float:
    """The last radius of virtual rehashing: the distance of two unit vectors at the threshold."""
    return float(np.sqrt(2 - 2 * threshold))


def prefixes(codes: np.ndarray) -> np.ndarray:
    """[lines, 257, words]: the sorted array of each line of ``codes`` [lines, rows] as bitmaps of the rows below each value."""
    lines, n = codes.shape
    words = -(-n // 64)
    out = np.empty((lines, 257, words), np.uint64)
    at = np.arange(n)
    for k in range(lines):
        hot = np.zeros((257, words * 64), bool)
        hot[codes[k].astype(np.int64) + 1, at] = True
        np.bitwise_or.accumulate(np.packbits(hot, axis=1, bitorder="little").view(np.uint64), axis=0, out=out[k])
    return out


def collisions(index: np.ndarray, queries: np.ndarray, wide: int, need: int) -> np.ndarray:
    """[queries, rows] bits: rows inside the windows of ``wide`` steps around ``queries`` [lines, queries] on ``need`` lines or more."""
    shape = queries.shape[1], index.shape[2]
    # Counts start at 64 - need, so that bit 6 tells who has enough.
    levels: list[list[np.ndarray]] = [[np.full(shape, ~_U(0))] if (64 - need) >> bit & 1 else [] for bit in range(7)]
    low, high = np.maximum(queries.astype(np.int64) - wide, 0), np.minimum(queries.astype(np.int64) + wide + 1, 256)
    for k in range(len(queries)):
        levels[0].append(index[k][high[k]] ^ index[k][low[k]])
        at = 0
        while len(levels[at]) == 3:
            a, b, c = levels[at]
            s = a ^ b
            levels[at + 1].append((a & b) | (s & c))
            levels[at] = [s ^ c]
            at += 1
    for at in range(6):
        while len(levels[at]) > 1:
            a, b = levels[at].pop(), levels[at].pop()
            levels[at + 1].append(a & b)
            levels[at].append(a ^ b)
    return np.bitwise_or.reduce(levels[6]) if levels[6] else np.zeros(shape, _U)


def collide(index: np.ndarray, queries: np.ndarray, reach: float, rows: int) -> np.ndarray:
    """[queries, rows]: do they collide often enough within the windows of radius ``reach``?"""
    wide, need = max(1, math.ceil(reach * REACH * STEPS)), math.ceil(SHARE * PROJECTIONS)
    found = np.empty((queries.shape[1], rows), bool)
    # Strips of queries keep the counters in the processor's cache.
    for at in range(0, len(found), STRIP):
        bits = np.ascontiguousarray(collisions(index, queries[:, at : at + STRIP], wide, need))
        found[at : at + STRIP] = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little", count=rows).view(bool)
    return found


def search(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, order: np.ndarray, k: int, threshold: float | None, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine): the ``k`` most similar rows of ``y`` for each row of ``x``; ``cx``, ``cy`` are their codes [lines, rows]."""
    last = radius(LOWEST if threshold is None else threshold)
    index, left, out = prefixes(cy), np.arange(len(x)), []
    for reach in (NARROW * last, last):
        if not len(left):
            break
        mask = collide(index, cx[:, left], reach, len(y))
        i, j, cos = nearest(x[left], y, order, k, 1 - reach**2 / 2, None if own is None else own[left], mask)
        done = np.bincount(i, minlength=len(left)) >= k
        if reach == last and threshold is not None:
            done[:] = True
        out.append((left[i[done[i]]], j[done[i]], cos[done[i]]))
        left = left[~done]
    if len(left):
        i, j, cos = nearest(x[left], y, order, k, None, None if own is None else own[left])
        out.append((left[i], j, cos))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def same_range(distance: float, width: float) -> float:
    """Chance that two vectors at ``distance`` fall into the same range of ``width`` of one line with a random offset."""
    c = width / distance
    return 1 - math.erfc(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def route(rows: int, threshold: float) -> tuple[int, int]:
    """(lines in a set, sets) at the least cost for a group of so many rows; (0, 1): blocks of the whole group."""
    r = radius(threshold)
    near, far = same_range(r, RANGE * r), same_range(math.sqrt(2), RANGE * r)
    best = rows + -(-rows // fill()) * COPY, (0, 1)
    for t in range(1, 25):
        sets = math.ceil(math.log(MISS) / math.log(1 - near**t))
        best = min(best, (sets * (far**t * rows + COPY), (t, sets)))
    return best[1]


def ranges(codes: np.ndarray, lines: int, sets: int, threshold: float) -> np.ndarray:
    """[rows, sets]: a key for the ranges of each set of lines that a row of ``codes`` [rows, lines] falls into."""
    if not lines:
        return np.zeros((len(codes), 1), np.int64)
    rng, width = np.random.default_rng(11), RANGE * radius(threshold) * STEPS
    out = np.empty((len(codes), sets), np.uint64)
    for k in range(sets):
        key = np.full(len(codes), k + 1, np.uint64)
        for line, offset in zip(rng.permutation(PROJECTIONS)[:lines], rng.random(lines)):
            key = _mix(key * _U(31) + np.floor(codes[:, line] / width + offset).astype(np.uint64))
        out[:, k] = key
    return out.view(np.int64)


def usable(df: DataFrame, dim: int) -> DataFrame:
    """Rows of (id, grp, embedding) whose embedding has ``dim`` finite values that are not all zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(e.isNotNull() & F.col("grp").isNotNull()).filter((F.size(e) == dim) & fine & F.exists(e, lambda x: x != 0))


def _projected(df: DataFrame, dim: int) -> DataFrame:
    """(id, grp, class, code, embedding): class names equal vectors of a group, code holds the quantised projections."""
    lines = directions(dim)
    schema = T.StructType([df.schema["id"], df.schema["grp"]]).add("class", T.BinaryType()).add("code", T.BinaryType()).add("embedding", T.ArrayType(T.FloatType()))
    top = 127 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)
            unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
            # Values are kept within a range that, with the widest window, cannot wrap around a byte.
            code = (np.clip(np.rint(unit @ lines * STEPS), -top * 0.8, top * 0.8) + 128).astype(np.uint8)
            cls = [hashlib.blake2b(x.tobytes() + (g or "").encode(), digest_size=16).digest() for x, g in zip(v, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))],
                names=schema.names,
            )

    return spread(df).mapInArrow(run, schema)


def _ranged(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (grp, class, code, ..., rows) once for each set of lines, with ``cell``, the key of its ranges."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])
    code, size = rows.columns.index("code"), rows.columns.index("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(size).to_numpy()
            for n in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == n))
                codes = np.frombuffer(b"".join(part.column(code).to_pylist()), np.uint8).reshape(-1, PROJECTIONS)
                keys = ranges(codes, *route(n, threshold), threshold)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("cell", F.explode("cells")).drop("cells")


def _tasks(heads: DataFrame, threshold: float | None, scratch: Scratch) -> DataFrame:
    """``heads`` (grp, class, ...) with cell, one, two, block: each row once for each pair of blocks it takes part in."""
    columns = [c for c in heads.columns if c != "grp"]
    sizes, seen = scratch.write_observed(heads.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")), "sizes", top=F.max("rows"))
    placed = heads.join(sizes, "grp")
    if threshold is not None and route(seen["top"] or 0, threshold)[0]:
        placed = _ranged(placed, threshold).drop("rows")
        # Ranges of more than one block are few.
        full = placed.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > fill())
        placed = placed.join(full, ["grp", "cell"], "left")
    else:
        placed = placed.withColumn("cell", F.lit(0).cast("long"))
    placed = placed.withColumn("blocks", F.coalesce(F.ceil(F.col("rows") / fill()).cast("int"), F.lit(1))).withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    # A row of block x goes to the tasks (x, y) and (y, x) with the smaller block first.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    return placed.select("grp", "cell", "block", other, *columns).select("grp", "cell", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", *columns)


def nearest(x: np.ndarray, y: np.ndarray, order: np.ndarray, k: int, threshold: float | None, own: np.ndarray | None = None, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine): for each row of ``x`` its ``k`` most similar rows of ``y``, ties by ``order``, of all or those in ``mask``, but the row of ``own``."""
    norms = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    near, far = (x / norms[0][:, None]).astype(np.float32), (y / norms[1][:, None]).astype(np.float32).T.copy()
    out = []
    for at in range(0, len(x), STRIP):
        part = None if mask is None else mask[at : at + STRIP]
        if part is not None and 64 * np.count_nonzero(part) <= part.size:
            i, j = np.nonzero(part)
        else:
            # Single precision only preselects: whatever could be among the best within its error is computed again.
            dots = near[at : at + STRIP] @ far
            if part is not None:
                dots[~part] = -2
            if own is not None:
                dots[np.arange(len(dots)), own[at : at + STRIP]] = -2
            low = np.partition(dots, dots.shape[1] - k, axis=1)[:, -k:-k + 1 or None] - 2 * ERROR if dots.shape[1] > k else np.full((len(dots), 1), -1.5)
            i, j = np.nonzero(dots >= np.maximum(low, -1.5 if threshold is None else threshold - ERROR))
        i = i + at
        if own is not None:
            other = own[i] != j
            i, j = i[other], j[other]
        cos = np.empty(len(i))
        for s in range(0, len(i), 1 << 16):
            u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            cos[s : s + (1 << 16)] = np.minimum(np.einsum("ij,ij->i", x[u], y[v]) / (norms[0][u] * norms[1][v]), 1.0)
        if threshold is not None:
            i, j, cos = (z[cos >= threshold] for z in (i, j, cos))
        by = np.lexsort((order[j], -cos, i))
        i, j, cos = i[by], j[by], cos[by]
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.empty(0, np.int64)
        top = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
        out.append((i[top], j[top], cos[top]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _block_nearest(heads: DataFrame, k: int, dim: int, threshold: float | None, scratch: Scratch) -> DataFrame:
    """(a, b, cosine): the ``k`` most similar classes b of each class a within each pair of blocks.

    ``heads`` has grp, class, id (the smallest of the class), embedding and code.
    """

    def run(key, table):
        one, two = key[2].as_py(), key[3].as_py()
        block, cls = table.column("block").to_numpy(), table.column("class").to_pylist()
        ids = table.column("id").to_pylist()
        order = np.empty(len(ids), np.int64)
        order[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
        v = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        codes = np.ascontiguousarray(np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, PROJECTIONS).T)
        at, bt = np.flatnonzero(block == one), np.flatnonzero(block == two)
        a, b, c = [], [], [np.empty(0)]
        for at, bt in ((at, bt),) if one == two else ((at, bt), (bt, at)):
            if len(at) and len(bt) > (one == two):
                i, j, cos = search(v[at], v[bt], codes[:, at], codes[:, bt], order[bt], k, threshold, np.arange(len(at)) if one == two else None)
                a += [cls[m] for m in at[i].tolist()]
                b += [cls[m] for m in bt[j].tolist()]
                c.append(cos)
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "cosine": pa.array(np.concatenate(c), pa.float64())})

    return _tasks(heads, threshold, scratch).groupBy("grp", "cell", "one", "two").applyInArrow(run, "a binary, b binary, cosine double")


def nearest_classes(df: DataFrame, k: int, dim: int, threshold: float | None) -> tuple[DataFrame, DataFrame]:
    """(members (id, class), links (a, b, cosine)): the links hold at least the ``k`` most similar other vectors b of each a, from ``threshold`` on if given."""
    scratch = Scratch(df.sparkSession, "vectors")
    rows = _projected(usable(df.select("id", "grp", "embedding"), dim), dim)
    rows = scratch.write(rows, "projected")
    heads = rows.groupBy("grp", "class").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("code", "embedding")])
    # Two vectors that share several ranges come once for each.
    links = _block_nearest(heads, k, dim, threshold, scratch).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return rows.select("id", "class").distinct(), scratch.write(links, "links")


def neighbours(df: DataFrame, k: int = 5, threshold: float | None = None, dim: int = 64) -> DataFrame:
    """(id, neighbour_id, cosine, rank): the ``k`` most similar rows of the same group, all there are if fewer.

    ``df`` has id, grp and embedding. With a ``threshold`` only rows of at least that cosine are listed.
    """
    members, directed = nearest_classes(df, k, dim, threshold)
    order = Window.partitionBy("class").orderBy("id")
    # No member needs more than k + 1 ids of any one class.
    heads = members.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).select("class", "id")
    near = directed.join(heads.select(F.col("class").alias("b"), F.col("id").alias("neighbour_id")), "b").select(F.col("a").alias("class"), "neighbour_id", "cosine")
    many = members.groupBy("class").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("class")
    own = heads.join(many, "class", "left_semi").select("class", F.col("id").alias("neighbour_id"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("class").orderBy(F.desc("cosine"), "neighbour_id")
    listed = near.union(own).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1).drop("rank")
    mine = members.join(listed, "class").filter("id <> neighbour_id")
    final = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour_id")
    return mine.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("id", "neighbour_id", "cosine", "rank")


def similar_pairs(df: DataFrame, k: int = 5, threshold: float = 0.9, dim: int = 64) -> DataFrame:
    """(id_a, id_b), id_a < id_b: at least one of the two is among the ``k`` most similar of the other."""
    near = neighbours(df, k, threshold, dim)
    return near.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()
