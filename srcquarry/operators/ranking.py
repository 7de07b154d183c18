"""Gap scores, vector search, reranking and gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from srcquarry.functions.paths import is_declaration
from srcquarry.functions.text import class_of
from srcquarry.operators.graph import containers, distinct_edges, in_degree, one_file, out_degree, placed_symbols
from srcquarry.operators.rows import diversify


def l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length, within [-1, 1]."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))
    return F.when((F.size(a) != F.size(b)) | (norm == 0) | norm.isNull(), 0.0).otherwise(value)


def nearest(df: DataFrame, query: list[float], k: int = 10, condition: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The k nearest rows by L2 distance, ties by key: one pass and a bounded top-k, no shuffle of vectors."""
    if condition is not None:
        df = df.filter(condition)
    q = F.array(*[F.lit(float(x)) for x in query])
    d = l2(F.col("embedding"), q)
    return df.filter(F.size("embedding") == len(query)).select("*", d.alias("distance")).orderBy("distance", key).limit(k)


def nearest_to_each(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", group: str | None = None, most: int = 4096) -> DataFrame:
    """(query_id, key, distance, rank[, group]): exact top-k of each query [and group], in blocks of BLAS products.

    ``queries`` is a stated, bounded set (at most ``most`` rows, checked); every batch of the table keeps
    k candidates per query and group, so only those are shuffled.
    """
    rows = queries.select(F.col(key).alias("query_id"), "embedding").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} queries: run them in blocks")
    ids = np.array([r["query_id"] for r in rows])
    q = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
    cols = [key, "embedding"] + ([group] if group else [])
    schema = f"query_id {queries.schema[key].dataType.simpleString()}, {key} {df.schema[key].dataType.simpleString()}, distance double" + (f", {group} {df.schema[group].dataType.simpleString()}" if group else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b) or not len(q):
                continue
            x = np.stack(b["embedding"].to_numpy()).astype(np.float64)
            d = np.sqrt(np.maximum(0, (x**2).sum(1)[None] + (q**2).sum(1)[:, None] - 2 * q @ x.T)).round(6)
            keys = b[key].to_numpy()
            place = np.empty(len(b), np.int64)
            place[np.argsort(keys, kind="stable")] = np.arange(len(b))
            for name, part in b.groupby(group).indices.items() if group else [(None, np.arange(len(b)))]:
                sub = d[:, part]
                # All rows as near as the k-th, then exactly k of them by distance and key.
                last = np.partition(sub, k - 1, axis=1)[:, k - 1 : k] if sub.shape[1] > k else np.full((len(q), 1), np.inf)
                i, j = np.nonzero(sub <= last)
                order = np.lexsort((place[part[j]], sub[i, j], i))
                i, j = i[order], j[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                i, j = i[nth < k], j[nth < k]
                out = pd.DataFrame({"query_id": ids[i], key: keys[part[j]], "distance": sub[i, j]})
                if group:
                    out[group] = name
                yield out

    cand = df.select(*cols).filter(F.size("embedding") == q.shape[1] if len(rows) else F.lit(False)).mapInPandas(run, schema)
    keys = ["query_id"] + ([group] if group else [])
    w = Window.partitionBy(*keys).orderBy("distance", key)
    return cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pool_size(limit: int) -> int:
    limit = limit if limit > 0 else 5
    return min(120, max(4 * limit, limit + 8))


def widened(strict: DataFrame, loose: DataFrame, key: str, pool: int) -> DataFrame:
    """Per query the strict hits, joined by the loose ones where there are fewer than max(2, pool / 8) of them."""
    few = loose.select(key).distinct().join(strict.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").filter(F.coalesce("n", F.lit(0)) < max(2, pool // 8)).select(key)
    return strict.unionByName(loose.join(few, key, "left_semi")).distinct()


def mmr(pool: DataFrame, k: int, weight: float = 0.5, key: str = "vec_id") -> DataFrame:
    """(query_id, key, pick, relevance): greedy relevance against redundancy in the pool of each query.

    ``pool`` has query_id, key, embedding, relevance; it is bounded by ``pool_size`` rows per query, so a
    query is one small group. Redundancy is at least 0; ties go to lower redundancy, then to the key.
    """
    weight = weight if 0 < weight <= 1 else 0.5
    q, r = pool.schema["query_id"].dataType.simpleString(), pool.schema[key].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key).reset_index(drop=True)
        v = np.stack(g["embedding"].to_numpy()).astype(np.float64)
        n = np.linalg.norm(v, axis=1)
        v = v / np.where(n == 0, 1, n)[:, None]
        sim, rel = v @ v.T, g["relevance"].to_numpy()
        left, picks, red = list(range(len(g))), [], np.zeros(len(g))
        while left and len(picks) < k:
            best = None
            for i in left:
                score = weight * rel[i] - (1 - weight) * red[i] if picks else rel[i]
                if best is None or score > best[0] + 1e-12 or (abs(score - best[0]) <= 1e-12 and red[i] < best[1] - 1e-12):
                    best = (score, red[i], i)
            picks.append(best[2])
            left.remove(best[2])
            red = np.maximum(red, sim[best[2]])
        return pd.DataFrame({"query_id": g["query_id"].iloc[picks], key: g[key].iloc[picks], "pick": np.arange(1, len(picks) + 1, dtype=np.int32), "relevance": rel[picks]})

    return pool.groupBy("query_id").applyInPandas(run, f"query_id {q}, {key} {r}, pick int, relevance double")


def sufficient(count: Column, best: Column, has_target: Column, least: int, floor: float) -> Column:
    """Is the evidence enough? A floor of 0 is off; the similarity is not asked for without hits or target."""
    floor = min(1.0, max(0.0, floor))
    enough = (count >= least) if least > 0 else F.lit(True)
    near = ~has_target | (count == 0) | (F.coalesce(best, F.lit(0.0)) + 1e-9 >= floor) if floor > 0 else F.lit(True)
    return enough & near


#: Words that make a module critical, unless others are given.
CRITICAL = ["payment", "auth", "security", "order", "billing", "user"]


def traced(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that tests link to, themselves or through the class around them (by name or by lines)."""
    hit = distinct_edges(edges).filter("edge_type = 'TESTS_SOURCE'").select(F.col("callee_symbol_id").alias("id")).distinct()
    s = placed_symbols(symbols)
    named = s.filter("fq_name is not null").select("id", "file", class_of("fq_name").alias("fq")).filter("fq is not null")
    by_name = named.join(s.join(hit, "id", "left_semi").select("file", F.col("fq_name").alias("fq")), ["file", "fq"], "left_semi").select("id")
    by_lines = containers(symbols).join(hit.withColumnRenamed("id", "container_id"), "container_id", "left_semi").select("id")
    return hit.union(by_name).union(by_lines).distinct()


def gap_scores(symbols: DataFrame, files: DataFrame, edges: DataFrame, langs: list[str], critical: list[str] | None = None, tested: DataFrame | None = None) -> DataFrame:
    """(id, file, module, fq_name, kind, reason, priority) of the symbols of non-test files, all with joins and column arithmetic."""
    kinds = ["method", "constructor", "function", "class"]
    s = placed_symbols(symbols).filter(F.lower("lang").isin(langs) & F.lower("kind").isin(kinds) & ~is_declaration("file"))
    private = (F.lower("lang") == "java") & (F.lower("kind") == "method") & (F.lower(F.coalesce(F.get_json_object("signature_json", "$.visibility"), F.lit(""))) == "private")
    s = s.filter(~private).join(one_file(files).filter("not is_test"), "file")
    hay = F.lower(F.concat_ws(" ", "file", "module"))
    words = critical if critical is not None else CRITICAL
    is_critical = hay.rlike("|".join(words)) if words else F.lit(False)
    s = s.join(in_degree(edges), "id", "left").join(traced(edges, symbols).withColumn("is_traced", F.lit(True)), "id", "left")
    has = tested.select("file").distinct().withColumn("has_test", F.lit(True)) if tested is not None else None
    s = s.join(has, "file", "left") if has is not None else s.withColumn("has_test", F.lit(False))
    central = F.coalesce("in_degree", F.lit(0)) >= 3
    crit, old, trace = is_critical, F.coalesce("has_test", F.lit(False)), F.coalesce("is_traced", F.lit(False))
    points = F.when(crit, 30).otherwise(0) + F.when(central, F.col("in_degree")).otherwise(0) - F.when(old, 20).otherwise(0) - F.when(trace, 38).otherwise(0)
    kind = F.when(crit, "business_critical").when(central, "low_coverage_central").otherwise("no_tests")
    reason = (
        F.when(crit, "business-critical module").when(central, "central dependency, under-tested").when(old, "extend existing test file (add test for this symbol)")
        .when(trace, "traceability: tests link to this symbol (TESTS_SOURCE)").otherwise("no tests detected")
    )
    return s.select("id", "file", "module", "fq_name", kind.alias("kind"), reason.alias("reason"), points.cast("long").alias("priority"))


def ranked_gaps(scores: DataFrame, limit: int = 10, per_file: int = 2) -> DataFrame:
    order = [F.desc("priority"), F.col("id")]
    return diversify(scores, "file", order, per_file, limit)


def route_gaps(symbols: DataFrame, files: DataFrame, edges: DataFrame, kinds: list[str], target_type: str = "TARGETS_API_ROUTE", critical: list[str] | None = None) -> DataFrame:
    """(id, file, priority): routes no test file targets; 5, 30 more if critical, and one for each outgoing edge."""
    s = placed_symbols(symbols)
    f = one_file(files)
    tests = s.select("id", "file").join(f.filter("is_test"), "file").select(F.col("id").alias("caller_symbol_id"))
    covered = distinct_edges(edges).filter(F.col("edge_type") == target_type).join(tests, "caller_symbol_id", "left_semi").select(F.col("callee_symbol_id").alias("id")).distinct()
    open_ = s.filter(F.upper("kind").isin(kinds)).join(f, "file").join(covered, "id", "left_anti").join(out_degree(edges), "id", "left")
    words = critical if critical is not None else CRITICAL
    crit = F.lower(F.concat_ws(" ", "file", "module")).rlike("|".join(words)) if words else F.lit(False)
    return open_.select("id", "file", (F.lit(5) + F.when(crit, 30).otherwise(0) + F.coalesce("out_degree", F.lit(0))).cast("long").alias("priority"))
