"""Near-duplicate texts with small edits: order min-hash, banded alignment, exact set similarity.

1. Every text is cut into lower-case word tokens and shingles of three tokens; a shingle is labelled with
   its occurrence number within the text.
2. Texts with the same set of shingles form a class (exact copies and the like); only one row per class
   goes on.
3. Order min-hash: each sketch takes the labelled shingles with the two smallest hash values and keeps
   them in text order, so it reacts to moved text as well as to edits. Some of the sketches look at first
   occurrences only, which follows the similarity of the sets where texts repeat themselves.
4. Classes that share a sketch are candidates. A sketch shared by more than HOT classes emits no pairs;
   its classes go through an exact prefix-filter join instead (rarest shingles first), so no bucket is
   cut off and no group is paired with itself blindly.
5. Candidates are verified by banded alignment of their token sequences: an edit changes at most three shingles
   of either text, so few enough edits prove the similarity. The band of a pair is as wide as that number of
   edits; only pairs with more edits than that (moved text, many edits) are decided by the exact shingle sets.

Defined results: a null content, or one of fewer than three tokens, is in no pair; repeated rows count
once; texts of any length are processed whole; extra columns are ignored; ids may be of any type that
can be ordered. Links between texts of one class have similarity 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from srcquarry.llm.tokens import batched
from srcquarry.operators.components import connected_components
from srcquarry.runtime import Scratch, spread

LABELLED, FIRSTS = 12, 6  # sketches over all labelled shingles, over first occurrences
HOT = 100  # classes per sketch above which its classes take the exact way
BAND = 48  # tokens that an alignment may drift off the diagonal at most
SPAN = 500  # rows of a hot join key per salt

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None
_WORD = np.zeros(256, np.uint8)
for _c in range(256):
    _x = chr(_c)
    if _c < 128 and (_x.isalnum() or _x == "_"):
        _WORD[_c] = ord(_x.lower())


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 21)
        up, down = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each token, index of its text)."""
    raw = b"\0".join((t or "").encode("utf-8", "replace") for t in texts)
    word = _WORD[np.frombuffer(raw, np.uint8)]
    n = len(word)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(word.astype(_U) * up[:n], out=total[1:])
    is_word = np.concatenate([[False], word > 0, [False]])
    start = np.flatnonzero(~is_word[:-1] & is_word[1:])
    end = np.flatnonzero(is_word[:-1] & ~is_word[1:])
    hashes = _mix((total[end] - total[start]) * down[start])
    sizes = np.array([len((t or "").encode("utf-8", "replace")) + 1 for t in texts], np.int64)
    return hashes, np.searchsorted(np.cumsum(sizes), start, side="right")


def shingles(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each three consecutive tokens of one text, index of the text)."""
    if len(hashes) < 3:
        return np.empty(0, _U), np.empty(0, np.int64)
    same = doc[:-2] == doc[2:]
    h = _mix(hashes[:-2] * _U(3) + _mix(hashes[1:-1] * _U(5) + _mix(hashes[2:] + _U(7))))
    return h[same], doc[:-2][same]


def occurrence(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often the same shingle came before in its text."""
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.append(True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    out = np.empty(len(h), np.int64)
    out[order] = nth
    return out


def _sketch(h: np.ndarray, label: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """One order min-hash per text: its two smallest labelled shingles, in text order."""
    value = _mix(h + label * _U(0xD6E8FEB86659FD93) + _U((seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    counts = np.diff(np.append(starts, len(h)))
    low = np.minimum.reduceat(value, starts)
    is_low = value == np.repeat(low, counts)
    at1 = np.flatnonzero(is_low)
    group = np.repeat(np.arange(len(starts)), counts)
    first = np.full(len(starts), -1)
    first[group[at1][::-1]] = at1[::-1]
    value[first] = _U(2**64 - 1)
    low2 = np.minimum.reduceat(value, starts)
    at2 = np.flatnonzero(value == np.repeat(low2, counts))
    second = np.full(len(starts), -1)
    second[group[at2][::-1]] = at2[::-1]
    a, b = np.minimum(first, second), np.maximum(first, second)
    return _mix(h[a] * _U(3) + _mix(h[b] + _U(seed)))


def sketch_batch(texts: list[str | None]):
    """(indices of texts with a shingle, class key, number of distinct shingles, sketch keys [texts, sketches])."""
    h, doc = shingles(*token_hashes(texts))
    if not len(h):
        return np.empty(0, np.int64), [], np.empty(0, np.int64), np.empty((0, LABELLED + FIRSTS), np.int64)
    nth = occurrence(h, doc)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    firsts = nth == 0
    fh, fdoc = h[firsts], doc[firsts]
    fstarts = np.flatnonzero(np.append(True, fdoc[1:] != fdoc[:-1]))
    sizes = np.diff(np.append(fstarts, len(fh)))
    order = np.lexsort((fh, fdoc))
    ordered = fh[order].tobytes()
    classes = [hashlib.blake2b(ordered[8 * a : 8 * (a + n)], digest_size=16).digest() for a, n in zip(fstarts.tolist(), sizes.tolist())]
    keys = np.empty((len(starts), LABELLED + FIRSTS), _U)
    label = nth.astype(_U)
    zero = np.zeros(len(fh), _U)
    for k in range(LABELLED):
        keys[:, k] = _sketch(h, label, starts, k + 1)
    for k in range(FIRSTS):
        keys[:, LABELLED + k] = _sketch(fh, zero, fstarts, LABELLED + k + 1)
    return doc[starts], classes, sizes, keys.view(np.int64)


def _sketched(df: DataFrame) -> DataFrame:
    """(id, class, n, keys) of every text of (id, content) that has a shingle."""
    schema = T.StructType([T.StructField("id", df.schema["id"].dataType)]).add("class", T.BinaryType()).add("n", T.IntegerType()).add("keys", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in batched(texts):
                at, classes, sizes, keys = sketch_batch(texts[a:b])
                ends = np.arange(len(at) + 1, dtype=np.int32) * keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
                ids = batch.column(0).slice(a, b - a).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids, pa.array(classes, pa.binary()), pa.array(sizes.astype(np.int32)), lists], names=schema.names)

    return spread(df).mapInArrow(run, schema)


def _token_lists(df: DataFrame) -> DataFrame:
    """(class, n, tokens) of (class, n, content): the token hashes in text order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in batched(texts):
                h, doc = token_hashes(texts[a:b])
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=b - a))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in (0, 1)), lists], names=["class", "n", "tokens"])

    return df.mapInArrow(run, "class binary, n int, tokens array<bigint>")


def salted_pairs(rows: DataFrame, key: str, low_share: float) -> DataFrame:
    """(a, b), a < b: classes of (key, class, n) that share a key and whose sizes allow the similarity.

    A key of many rows is spread over salts: each row meets the others of its key in several small tasks.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    both = rows.join(counts, key).withColumn("salts", F.ceil(F.col("rows") / SPAN).cast("int"))
    left = both.select(key, F.pmod(F.xxhash64("class"), "salts").cast("int").alias("salt"), F.col("class").alias("a"), F.col("n").alias("na"))
    right = both.select(key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("class").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, [key, "salt"]).filter("a < b").filter(F.least("na", "nb") >= low_share * F.greatest("na", "nb"))
    return pairs.select("a", "b").distinct()


def _exact_pairs(tokens: DataFrame, threshold: float) -> DataFrame:
    """Prefix-filter join: every pair of classes of (class, tokens) with at least ``threshold`` shares a prefix shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, toks in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = np.asarray(toks.values.to_numpy(zero_copy_only=False)).view(_U)
                s = np.unique(shingles(t, np.zeros(len(t), np.int64))[0]).view(np.int64)
                for a in range(0, len(s), 100_000):
                    part = s[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([cls] * len(part), pa.binary()), pa.array(np.full(len(part), len(s), np.int32)), pa.array(part)], names=["class", "n", "shingle"])

    rows = tokens.mapInArrow(run, "class binary, n int, shingle bigint")
    seen = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("class").orderBy("df", "shingle"))
    prefix = rows.join(seen, "shingle").withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1)
    return salted_pairs(prefix.select("shingle", "class", "n"), "shingle", threshold)


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], band: int = BAND) -> np.ndarray:
    """Edit distance of token sequences within a diagonal band, for many pairs at once (an upper bound outside it)."""
    m = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = 2 * band + 1
    big = np.int32(1 << 28)
    n = int(la.max(initial=0))
    pa_ = np.zeros((m, n), np.uint64)
    pb = np.zeros((m, int(lb.max(initial=0)) + n + width + 2), np.uint64)
    for k in range(m):
        pa_[k, : la[k]] = a[k]
        pb[k, band : band + lb[k]] = b[k]
    offset = np.arange(width) - band  # column of the band = position in b minus position in a
    row = np.where(offset >= 0, offset, big).astype(np.int32)[None].repeat(m, 0)
    row[offset[None] > lb[:, None]] = big
    out = np.full(m, big, np.int32)
    ramp = np.arange(width, dtype=np.int32)

    def read(i: int) -> None:
        done = la == i
        if done.any():
            col = lb - i + band
            ok = done & (col >= 0) & (col < width)
            out[ok] = row[ok, col[ok]]

    read(0)
    for i in range(1, n + 1):
        j = i + offset  # length of the prefix of b
        match = pb[:, i - 1 : i - 1 + width] == pa_[:, i - 1 : i]
        match &= (j >= 1)[None] & (j[None] <= lb[:, None])
        new = row + np.where(match, 0, 1)  # replace or keep: same column of the band
        up = np.append(row[:, 1:], np.full((m, 1), big, np.int32), axis=1) + 1  # drop a token of a
        new = np.minimum(new, up)
        new[:, j < 0] = big
        new[:, j == 0] = i
        new[j[None].repeat(m, 0) > lb[:, None]] = big
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp  # add tokens of b
        row = np.minimum(row, big)
        read(i)
    return np.minimum(out, np.maximum(la, lb)).astype(np.int64)


def _distinct_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of a column of token lists, each once, sorted."""
    sizes = np.diff(column.offsets.to_numpy()) if column.offset == 0 else np.array([len(x) for x in column])
    tokens = column.flatten().to_numpy(zero_copy_only=False).view(_U)
    h, row = shingles(tokens, np.repeat(np.arange(len(column)), sizes))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    return row[new], h[new]


def set_similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each row, all rows of a batch at once."""
    (ra, ha), (rb, hb) = _distinct_shingles(a), _distinct_shingles(b)
    n = len(a)
    row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    both = np.bincount(row[1:][same], minlength=n)
    return both / np.maximum(1, np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - both)


def allowed_edits(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Token edits that still prove ``threshold`` for sets of ``na`` and ``nb`` shingles (negative: none do).

    ``d`` edits leave at least max(na, nb) - 3 d shingles common, and c common shingles are a similarity of c / (na + nb - c).
    """
    common = np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)
    return np.floor((np.maximum(na, nb) - common) / 3).astype(np.int64)


def _verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, edits) of (a, b, na, nb, ta, tb) with at least ``threshold``; edits is null where the sets had to decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                most = allowed_edits(*(part.column(k).to_numpy().astype(np.int64) for k in (2, 3)), threshold)
                seqs = [[x.values.to_numpy(zero_copy_only=False).view(_U) for x in part.column(k)] for k in (4, 5)]
                apart = np.array([abs(len(x) - len(y)) for x, y in zip(*seqs)])
                size = np.array([max(len(x), len(y)) for x, y in zip(*seqs)])
                band = np.minimum(most, BAND)
                edits = np.full(part.num_rows, -1)
                # Pairs of like length are aligned together; a long pair waits for no short one.
                by = np.flatnonzero((band >= 0) & (apart <= band))
                by = by[np.argsort(size[by], kind="stable")]
                group = max(1, min(64, 4_000_000 // (2 * int(size[by[-1]]) + 1))) if len(by) else 1
                for g in range(0, len(by), group):
                    own = by[g : g + group]
                    d = banded_distance([seqs[0][i] for i in own], [seqs[1][i] for i in own], int(band[own].max()))
                    edits[own] = np.where(d <= most[own], d, -1)
                rest = np.flatnonzero(edits < 0)
                keep = edits >= 0
                if len(rest):
                    keep[rest] = set_similarity(part.column(4).take(pa.array(rest)), part.column(5).take(pa.array(rest))) >= threshold
                take = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(edits[keep].astype(np.int32), mask=edits[keep] < 0)], names=["a", "b", "edits"])

    return pairs.mapInArrow(run, "a binary, b binary, edits int")


def near_duplicate_classes(df: DataFrame, threshold: float, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(members (id, class), pairs (a, b, edits) of classes) of the texts of (id, content)."""
    scratch = Scratch(df.sparkSession, "near-dup")
    texts = df.select("id", "content").filter("content is not null")
    sketched = scratch.write(_sketched(texts), "sketched")
    members = sketched.select("id", "class").distinct()
    classes = scratch.write(sketched.groupBy("class").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("id").alias("rep")), "classes")
    rows = classes.select("class", "n", F.explode("keys").alias("key"))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared, seen = scratch.write_observed(rows.join(counts, "key"), "shared", hot=F.count_if(F.col("size") > hot))
    usual = salted_pairs(shared.filter(F.col("size") <= hot).select("key", "class", "n"), "key", threshold)
    candidates = scratch.write(usual, "usual")
    in_hot = shared.filter(F.col("size") > hot).select("class").distinct()
    needed = candidates.select(F.col("a").alias("class")).union(candidates.select(F.col("b").alias("class")))
    needed = (needed.union(in_hot) if seen["hot"] else needed).distinct()
    reps = needed.join(classes.select("class", "n", "rep"), "class").select("class", "n", F.col("rep").alias("id"))
    one = texts.join(reps, "id").groupBy("class").agg(F.first("n").alias("n"), F.first("content").alias("content"))
    tokens = scratch.write(_token_lists(one), "tokens")
    if seen["hot"]:
        candidates = candidates.union(_exact_pairs(tokens.select("class", "tokens").join(in_hot, "class", "left_semi"), threshold)).distinct()
    sides = [tokens.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}")) for x in "ab"]
    full = candidates.join(sides[0], "a").join(sides[1], "b")
    pairs = scratch.write(_verified(full.select("a", "b", "na", "nb", "ta", "tb"), threshold), "pairs")
    scratch.drop("classes", "shared", "usual", "tokens")
    return members, pairs


def near_duplicate_pairs(df: DataFrame, threshold: float = 0.7, hot: int = HOT) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every two rows of (id, content) with at least ``threshold``, copies expanded."""
    members, pairs = near_duplicate_classes(df, threshold, hot)
    # A class of many copies is spread over salts, so that no task expands it alone.
    many = members.groupBy("class").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").withColumn("salts", F.ceil(F.col("c") / SPAN).cast("int"))
    large = many.filter("salts > 1").select("class", "salts")
    spread_out = members.join(large, "class", "left").select("class", F.coalesce(F.pmod(F.xxhash64("id"), "salts"), F.lit(0)).cast("int").alias("salt"), "id")
    across = pairs.select("a", "b")
    for x, name in (("a", "x"), ("b", "y")):
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
        across = across.join(large.withColumnRenamed("class", x), x, "left").select(*across.columns, salts)
        across = across.join(spread_out.withColumnRenamed("class", x).withColumnRenamed("id", name), [x, "salt"]).drop(x, "salt")
    same = members.join(many, "class")
    one = same.select("class", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.col("id").alias("x"))
    two = same.select("class", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("y"))
    within = one.join(two, ["class", "salt"]).filter("x < y").select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(df: DataFrame, threshold: float = 0.7, hot: int = HOT) -> DataFrame:
    """(id, class_id, group_id, n_links) of every row in a link: one row per text, copies not expanded."""
    members, pairs = near_duplicate_classes(df, threshold, hot)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("class_id"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.select(F.col("class").alias("b"), "c"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("c").alias("others"))
    parts = connected_components(pairs)
    info = sizes.join(others, "class", "left").join(parts.withColumnRenamed("node", "class"), "class", "left")
    info = info.withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("c") - 1).filter("n_links > 0")
    info = info.withColumn("component", F.coalesce("component", "class"))
    names = info.groupBy("component").agg(F.min("class_id").alias("group_id"))
    info = info.join(names, "component").select("class", "class_id", "group_id", "n_links")
    return members.join(info, "class").select("id", "class_id", "group_id", "n_links")
