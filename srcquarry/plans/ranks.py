"""Windows, top-k, vector search, gap ranking, lexical ranking, retrieval bundles."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from srcquarry.functions import text as X
from srcquarry.operators import graph as G, ranking as K, retrieval as B, rows as R
from srcquarry.plans.base import Tables, query
from srcquarry.plans.joins import _HELD, _SYM, _TRACED
from srcquarry.runtime import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}
_q = query(QUERIES)

#: The query vector of the single-query searches: the one with the smallest id.
_L2 = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"
_COS = "CASE WHEN len(a) <> len(b) OR na = 0 OR nb = 0 THEN 0 ELSE greatest(-1, least(1, dot / (na * nb))) END"


def _first(t: Tables):
    return t.embeddings.orderBy("vec_id").first()


@_q
def knn_l2_top10(t: Tables):
    """The ten vectors nearest to the first one."""
    q = _first(t)
    return K.nearest(t.embeddings, q["embedding"], 10, F.col("vec_id") != q["vec_id"]).select("vec_id", F.round("distance", 6).alias("distance"))


_Q = "q AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1)"
SQL["knn_l2_top10"] = f"WITH {_Q} SELECT e.vec_id, round({_L2}, 6) AS distance FROM embeddings e, q WHERE e.vec_id <> q.vec_id ORDER BY {_L2}, e.vec_id LIMIT 10"


@_q
def knn_filtered_type(t: Tables):
    """The five nearest among the rows of one label."""
    q = _first(t)
    return K.nearest(t.embeddings, q["embedding"], 5, (F.col("vec_id") != q["vec_id"]) & (F.col("label") == 3)).select("vec_id", "label", F.round("distance", 6).alias("distance"))


SQL["knn_filtered_type"] = f"WITH {_Q} SELECT e.vec_id, e.label, round({_L2}, 6) AS distance FROM embeddings e, q WHERE e.vec_id <> q.vec_id AND e.label = 3 ORDER BY {_L2}, e.vec_id LIMIT 5"


@_q
def knn_per_type_pool(t: Tables):
    """Per query (every vector with an id divisible by 50) and label the three nearest rows."""
    q = t.embeddings.filter("vec_id % 50 = 0")
    return K.nearest_to_each(t.embeddings, q, 3, "vec_id", "label").select("query_id", "label", "vec_id", "rank", "distance")


SQL["knn_per_type_pool"] = f"""SELECT q.vec_id AS query_id, e.label, e.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY round({_L2}, 6), e.vec_id) AS INT) AS rank, round({_L2}, 6) AS distance
    FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 3"""


@_q
def cosine_to_target(t: Tables):
    """Cosine of each vector with the first one."""
    q = _first(t)
    return t.embeddings.select("vec_id", F.round(K.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in q["embedding"]])), 6).alias("cosine"))


_DOT = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NRM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_COSINE = f"greatest(-1, least(1, {_DOT} / ({_NRM.format('e')} * {_NRM.format('q')})))"
SQL["cosine_to_target"] = f"WITH {_Q} SELECT e.vec_id, round({_COSINE}, 6) AS cosine FROM embeddings e, q"


@_q
def embedding_rerank(t: Tables):
    """Candidates by cosine with the first vector; every seventh counts as without vector and comes last."""
    q = _first(t)
    target = F.array(*[F.lit(float(x)) for x in q["embedding"]])
    score = F.round(F.coalesce(F.when(F.col("vec_id") % 7 != 0, K.cosine(F.col("embedding"), target)), F.lit(-2.0)), 6)
    best = t.embeddings.select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(100)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))  # over the 100 rows left


SQL["embedding_rerank"] = f"""WITH {_Q}, s AS (SELECT e.vec_id, CASE WHEN e.vec_id % 7 <> 0 THEN round({_COSINE}, 6) ELSE -2.0::DOUBLE END AS score FROM embeddings e, q)
    SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 100"""


@_q
def hybrid_widen(t: Tables):
    """Strict hits (same label) of each query, widened by loose ones where the pool holds too few."""
    q = t.embeddings.filter("vec_id % 50 = 0")
    pool = K.pool_size(5)
    near = K.nearest_to_each(t.embeddings, q, pool, "vec_id").join(t.embeddings.select("vec_id", "label"), "vec_id")
    near = near.join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), "query_id").filter("query_id <> vec_id")
    strict = near.filter("label = query_label").select("query_id", "vec_id", "distance")
    return K.widened(strict, near.select("query_id", "vec_id", "distance"), "query_id", pool)


SQL["hybrid_widen"] = f"""WITH n AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, q.label AS query_label, round({_L2}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0
      QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_L2}, 6), e.vec_id) <= 20), m AS (SELECT * FROM n WHERE query_id <> vec_id),
    c AS (SELECT query_id, count(*) FILTER (label = query_label) AS strict FROM m GROUP BY 1)
    SELECT query_id, vec_id, distance FROM m JOIN c USING (query_id) WHERE label = query_label OR strict < 2"""


@_q
def mmr_rerank(t: Tables):
    """Five diverse references for each query out of its pool (order-dependent, compared with a plain version in the tests)."""
    q = t.embeddings.filter("vec_id % 50 = 0")
    near = K.nearest_to_each(t.embeddings, q, K.pool_size(5) + 1, "vec_id").filter("query_id <> vec_id")
    pool = near.join(t.embeddings.select("vec_id", "embedding"), "vec_id").withColumn("relevance", 1 / (1 + F.col("distance")))
    return K.mmr(pool, 5)


@_q
def sufficiency_gate(t: Tables):
    """Does each query have enough similar references (at least three within a distance, the best near enough)?"""
    q = t.embeddings.filter("vec_id % 50 = 0")
    near = K.nearest_to_each(t.embeddings, q, 6, "vec_id").filter("query_id <> vec_id and distance <= 1.2")
    best = F.coalesce(F.max(F.lit(1) - F.col("distance") * F.col("distance") / 2), F.lit(0.0))
    g = q.select(F.col("vec_id").alias("query_id")).join(near, "query_id", "left").groupBy("query_id").agg(F.count("vec_id").alias("n"), F.round(best, 4).alias("best"))
    return g.select("query_id", "n", K.sufficient(F.col("n"), F.col("best"), F.lit(True), 3, 0.4).alias("enough"))


SQL["sufficiency_gate"] = f"""WITH n AS (SELECT q.vec_id AS query_id, e.vec_id, round({_L2}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0
      QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_L2}, 6), e.vec_id) <= 6), m AS (SELECT * FROM n WHERE query_id <> vec_id AND distance <= 1.2),
    g AS (SELECT q.vec_id AS query_id, count(m.vec_id) AS n, round(coalesce(max(1 - distance * distance / 2), 0), 4) AS best FROM embeddings q LEFT JOIN m ON m.query_id = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1)
    SELECT query_id, n, n >= 3 AND (n = 0 OR best + 1e-9 >= 0.4) AS enough FROM g"""

# ---- gaps
_WORDS = ["ledger", "invoice", "tariff"]


def _scores(t: Tables):
    tested = t.files.filter("is_test").select(F.regexp_replace("file", r"\.(spec|test|cy)\.", ".").alias("file")).distinct()
    return K.gap_scores(t.symbols, t.files, t.edges, ["java", "typescript", "javascript", "csharp"], _WORDS, tested)


_GAPS = f"""{_TRACED}, t AS (SELECT DISTINCT regexp_replace(file, '\\.(spec|test|cy)\\.', '.') AS file FROM files WHERE is_test),
    d AS (SELECT callee_symbol_id AS id, count(*) AS n FROM e WHERE edge_type <> 'TESTS_SOURCE' GROUP BY 1),
    g AS (SELECT s.id, s.file, f.module, s.fq_name, regexp_matches(lower(concat_ws(' ', s.file, f.module)), 'ledger|invoice|tariff') AS crit, coalesce(d.n, 0) AS n,
          s.file IN (SELECT file FROM t) AS old, s.id IN (SELECT id FROM traced) AS trace
        FROM s JOIN f USING (file) LEFT JOIN d ON d.id = s.id WHERE NOT f.is_test AND lower(s.lang) IN ('java', 'typescript', 'javascript', 'csharp') AND lower(s.kind) IN ('method', 'constructor', 'function', 'class')
          AND NOT ends_with(lower(trim(s.file)), '.d.ts') AND NOT (lower(s.lang) = 'java' AND lower(s.kind) = 'method'
          AND lower(coalesce(CASE WHEN json_valid(signature_json) THEN json_extract_string(signature_json, '$.visibility') END, '')) = 'private')),
    gaps AS (SELECT id, file, module, fq_name, CASE WHEN crit THEN 'business_critical' WHEN n >= 3 THEN 'low_coverage_central' ELSE 'no_tests' END AS kind,
        CASE WHEN crit THEN 'business-critical module' WHEN n >= 3 THEN 'central dependency, under-tested' WHEN old THEN 'extend existing test file (add test for this symbol)'
             WHEN trace THEN 'traceability: tests link to this symbol (TESTS_SOURCE)' ELSE 'no tests detected' END AS reason,
        CAST((CASE WHEN crit THEN 30 ELSE 0 END) + (CASE WHEN n >= 3 THEN n ELSE 0 END) - (CASE WHEN old THEN 20 ELSE 0 END) - (CASE WHEN trace THEN 38 ELSE 0 END) AS BIGINT) AS priority FROM g)"""


@_q
def gap_score(t: Tables):
    """Priority, kind and reason of every symbol that may lack tests."""
    return _scores(t)


SQL["gap_score"] = f"WITH {_GAPS} SELECT * FROM gaps"


@_q
def gap_diversity(t: Tables):
    """The ten gaps to take first, at most two of a file."""
    return K.ranked_gaps(_scores(t)).select("id", "file", "priority")


SQL["gap_diversity"] = f"""WITH {_GAPS} SELECT id, file, priority FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY priority DESC, id) AS r FROM gaps) WHERE r <= 2 ORDER BY priority DESC, id LIMIT 10"""


@_q
def route_gaps(t: Tables):
    """Modules no test imports, as routes are checked for tests that target them, by outgoing edges."""
    return K.route_gaps(t.symbols, t.files, t.edges, ["MODULE", "INTERFACE"], "IMPORTS", _WORDS)


SQL["route_gaps"] = f"""WITH {_SYM}, c AS (SELECT callee_symbol_id AS id FROM e JOIN s ON s.id = caller_symbol_id JOIN f USING (file) WHERE edge_type = 'IMPORTS' AND is_test),
    o AS (SELECT caller_symbol_id AS id, count(*) AS n FROM e GROUP BY 1)
    SELECT s.id, s.file, CAST(5 + (CASE WHEN regexp_matches(lower(concat_ws(' ', s.file, f.module)), 'ledger|invoice|tariff') THEN 30 ELSE 0 END) + coalesce(o.n, 0) AS BIGINT) AS priority
    FROM s JOIN f USING (file) LEFT JOIN o ON o.id = s.id WHERE upper(kind) IN ('MODULE', 'INTERFACE') AND s.id NOT IN (SELECT id FROM c)"""

# ---- lexical ranking
_QUERY = X.run_query("java", "junit", "playwright") + " index parser cache ticket run"


@_q
def jaccard_rank(t: Tables):
    """Documents by word overlap with the run query and keyword boost, ten of each source."""
    d = spread(t.documents.filter("text is not null").select("doc_id", "source", "text")).select("doc_id", "source", F.round(X.jaccard(F.lit(_QUERY), "text") + X.keyword_boost("source", "text"), 6).alias("score")).distinct()
    return R.top_per_group(d, ["source"], [F.desc("score"), F.col("doc_id")], 10)


_JAC = """list_distinct(list_filter(list_transform(string_split_regex(lower({0}), '[^a-zA-Z0-9_]+'), lambda w: regexp_replace(regexp_replace(w, '^_+', ''), '_+$', '')), lambda w: length(w) >= 2))"""
_BOOST = " + ".join(f"(CASE WHEN contains(hay, '{w}') THEN 0.03 ELSE 0 END)" for w in X.BOOST_WORDS) + " + (CASE WHEN contains(hay, 'description:') THEN 0.02 ELSE 0 END)"
SQL["jaccard_rank"] = f"""WITH a AS (SELECT {_JAC.format(repr(_QUERY))} AS q), d AS (SELECT DISTINCT doc_id, source, {_JAC.format('text')} AS w, lower(concat_ws(' ', source, text)) AS hay FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, source, round(CAST((CASE WHEN len(w) = 0 THEN 0 ELSE len(list_intersect(q, w))::DOUBLE / len(list_distinct(list_concat(q, w))) END) + least(0.25::DOUBLE, ({_BOOST})::DOUBLE) AS DOUBLE), 6) AS score FROM d, a)
    SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 10"""


@_q
def keyword_boost(t: Tables):
    """Keyword boost of every document."""
    return t.documents.select("doc_id", F.round(X.keyword_boost("source", "text"), 6).alias("boost")).distinct()


SQL["keyword_boost"] = f"SELECT DISTINCT doc_id, round(CAST(least(0.25::DOUBLE, ({_BOOST})::DOUBLE) AS DOUBLE), 6) AS boost FROM (SELECT doc_id, lower(concat_ws(' ', source, text)) AS hay FROM documents)"


@_q
def topn_per_class(t: Tables):
    """Twelve documents and eight logs of each repository, longest first."""
    d = t.documents.filter("repo_id is not null").select("doc_id", "repo_id", (F.col("source") == "run_log").alias("is_log"), F.coalesce("n_chars", F.lit(0)).alias("n_chars")).distinct()
    return R.top_per_group(d, ["repo_id", "is_log"], [F.desc("n_chars"), F.col("doc_id")], 12).filter(~F.col("is_log").eqNullSafe(True) | (F.col("rank") <= 8))


SQL["topn_per_class"] = """SELECT doc_id, repo_id, is_log, n_chars, CAST(row_number() OVER (PARTITION BY repo_id, is_log ORDER BY n_chars DESC, doc_id) AS INT) AS rank
    FROM (SELECT DISTINCT doc_id, repo_id, source = 'run_log' AS is_log, coalesce(n_chars, 0) AS n_chars FROM documents WHERE repo_id IS NOT NULL) QUALIFY rank <= CASE WHEN is_log THEN 8 ELSE 12 END"""


@_q
def ir_metrics(t: Tables):
    """MRR, precision and nDCG at 5 of the searches of every 50th vector, relevant being the same label."""
    q = t.embeddings.filter("vec_id % 50 = 0")
    near = K.nearest_to_each(t.embeddings, q, 6, "vec_id").filter("query_id <> vec_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter("rank <= 5")
    near = near.join(t.embeddings.select("vec_id", "label"), "vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    rel = (F.col("label") == F.col("want")).cast("int")
    gain = rel / F.log2(F.col("rank") + 1)
    ideal = sum(1 / math.log2(k + 1) for k in range(1, 6))
    per = near.groupBy("query_id").agg(F.coalesce(F.max(rel / F.col("rank")), F.lit(0.0)).alias("rr"), (F.sum(rel) / 5).alias("p5"), (F.sum(gain) / ideal).alias("ndcg5"))
    return per.agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("p5"), 6).alias("p_at_5"), F.round(F.avg("ndcg5"), 6).alias("ndcg_at_5"))


SQL["ir_metrics"] = f"""WITH n AS (SELECT q.vec_id AS query_id, e.vec_id, e.label = q.label AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_L2}, 6), e.vec_id) AS r FROM embeddings e, embeddings q
      WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id QUALIFY r <= 5),
    p AS (SELECT query_id, max(rel::INT / r) AS rr, sum(rel::INT) / 5 AS p5, sum(rel::INT / log2(r + 1)) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) t(i)) AS ndcg FROM n GROUP BY 1)
    SELECT round(avg(rr), 6) AS mrr, round(avg(p5), 6) AS p_at_5, round(avg(ndcg), 6) AS ndcg_at_5 FROM p"""

# ---- windows over runs, logs and chunks


@_q
def failure_streak(t: Tables):
    """Runs of equal outcomes per repository: length of the streak of each failure so far."""
    r = t.index_runs.select("run_id", "repo_id", F.lower(F.trim("status")).alias("status"), "started_at").distinct().filter("repo_id is not null")
    return R.streaks(r, ["repo_id"], [F.col("started_at"), F.col("run_id")], F.col("status")).select("run_id", "repo_id", "status", "streak")


SQL["failure_streak"] = """WITH r AS (SELECT DISTINCT run_id, repo_id, lower(trim(status)) AS status, started_at FROM index_runs WHERE repo_id IS NOT NULL),
    c AS (SELECT *, CASE WHEN coalesce(status, '') = lag(coalesce(status, '')) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY repo_id ORDER BY started_at NULLS FIRST, run_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY repo_id ORDER BY started_at NULLS FIRST, run_id) AS run FROM c)
    SELECT run_id, repo_id, status, CAST(CASE WHEN coalesce(status, '') = '' THEN 0 ELSE row_number() OVER (PARTITION BY repo_id, run ORDER BY started_at NULLS FIRST, run_id) END AS INT) AS streak FROM g"""


@_q
def loop_breaker(t: Tables):
    """Streaks, reappearances and attempts without progress over the audit entries of each run, and when a loop would stop."""
    a = t.audit_log.dropDuplicates(["id"]).filter("run_id is not null").select("id", "run_id", "step", F.coalesce(F.get_json_object("payload", "$.files").try_cast("long"), F.lit(0)).alias("size"))
    return R.breaker(a, ["run_id"], [F.col("id")], "step", "size").select("id", "run_id", "streak", "recurrences", "idle", F.coalesce("verdict", F.lit("")).alias("verdict"))


SQL["loop_breaker"] = """WITH a AS (SELECT DISTINCT id, run_id, step, coalesce(TRY_CAST(CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.files') END AS BIGINT), 0) AS size FROM audit_log WHERE run_id IS NOT NULL),
    b AS (SELECT *, CASE WHEN coalesce(step, '') = lag(coalesce(step, '')) OVER (PARTITION BY run_id ORDER BY id) THEN 0 ELSE 1 END AS new,
            row_number() OVER (PARTITION BY run_id, step ORDER BY id) > 1 AS seen, min(size) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM a),
    c AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY id) AS run, sum(CASE WHEN low IS NULL OR size < low THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY id) AS epoch FROM b),
    d AS (SELECT *, CASE WHEN coalesce(step, '') = '' THEN 0 ELSE row_number() OVER (PARTITION BY run_id, run ORDER BY id) END AS streak, row_number() OVER (PARTITION BY run_id, epoch ORDER BY id) - 1 AS idle FROM c),
    x AS (SELECT *, sum(CASE WHEN seen AND streak = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY id) AS recurrences FROM d),
    v AS (SELECT *, CASE WHEN streak >= 3 THEN 'repeat' WHEN recurrences >= 2 THEN 'oscillation' WHEN idle >= 5 THEN 'no progress' END AS now FROM x)
    SELECT id, run_id, CAST(streak AS INT) AS streak, CAST(recurrences AS BIGINT) AS recurrences, CAST(idle AS INT) AS idle,
      coalesce(first_value(now IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS verdict FROM v"""


@_q
def interval_merge(t: Tables):
    """Line ranges of the symbols of each file, merged where they overlap or touch."""
    s = G.placed_symbols(t.symbols).filter("file is not null and start_line is not null and end_line >= start_line").select("file", "start_line", "end_line")
    return R.merge_intervals(s, ["file"], "start_line", "end_line")


SQL["interval_merge"] = f"""WITH {_SYM}, x AS (SELECT file, start_line, end_line FROM s WHERE file IS NOT NULL AND end_line >= start_line),
    m AS (SELECT *, CASE WHEN start_line > 1 + max(end_line) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM x),
    g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT file, min(start_line) AS start_line, max(end_line) AS end_line FROM g GROUP BY file, g"""


@_q
def segment_windows(t: Tables):
    """Windows of up to three consecutive segments of a chunked symbol, two windows a file at most."""
    c = t.chunks.select("id", "file", "chunk_type", "symbol_id", F.get_json_object("chunk_metadata", "$.chunk_index").try_cast("int").alias("idx")).distinct().filter("idx is not null and symbol_id is not null and file is not null")
    return B.segment_windows(c)


SQL["segment_windows"] = """WITH c AS (SELECT DISTINCT id, file, chunk_type, symbol_id, TRY_CAST(CASE WHEN json_valid(chunk_metadata) THEN json_extract_string(chunk_metadata, '$.chunk_index') END AS INT) AS idx FROM chunks),
    d AS (SELECT *, row_number() OVER (PARTITION BY file, chunk_type, symbol_id, idx ORDER BY id) AS dup FROM c WHERE idx IS NOT NULL AND symbol_id IS NOT NULL AND file IS NOT NULL),
    e AS (SELECT *, idx - row_number() OVER (PARTITION BY file, chunk_type, symbol_id ORDER BY idx) AS island FROM d WHERE dup = 1),
    f AS (SELECT *, (row_number() OVER (PARTITION BY file, chunk_type, symbol_id, island ORDER BY idx) - 1) // 3 AS win FROM e),
    w AS (SELECT file, chunk_type, symbol_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS segments FROM f GROUP BY file, chunk_type, symbol_id, island, win)
    SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY chunk_type, symbol_id, first_idx) AS INT) AS rank FROM w QUALIFY rank <= 2"""


@_q
def boilerplate_first_seen(t: Tables):
    """Header lines of chunks seen before in the same file (these are stripped)."""
    c = t.chunks.select("id", "file", "start_line", F.sha1(F.substring_index("content", "\n", 1).cast("binary")).alias("head")).distinct().filter("file is not null")
    w = Window.partitionBy("file", "head").orderBy("start_line", "id")
    return c.withColumn("n", F.row_number().over(w)).select("id", "file", (F.col("n") > 1).alias("strip"))


SQL["boilerplate_first_seen"] = """SELECT id, file, row_number() OVER (PARTITION BY file, head ORDER BY start_line NULLS FIRST, id) > 1 AS strip
    FROM (SELECT DISTINCT id, file, start_line, sha1(split_part(content, chr(10), 1)) AS head FROM chunks WHERE file IS NOT NULL)"""


@_q
def file_batches(t: Tables):
    """Batches of at most 40 files of a module, in path order."""
    f = t.files.select("module", "file").distinct().filter("module is not null")
    return R.batches(f, "module", [F.col("file")], 40)


SQL["file_batches"] = "SELECT module, file, CAST((row_number() OVER (PARTITION BY module ORDER BY file) - 1) // 40 AS INT) AS batch FROM (SELECT DISTINCT module, file FROM files WHERE module IS NOT NULL)"


@_q
def same_file_merge(t: Tables):
    """Dependencies of a symbol grouped by file: names in line order, mixed edge types called uses."""
    e = G.distinct_edges(t.edges).join(G.placed_symbols(t.symbols).select(F.col("id").alias("callee_symbol_id"), "file", "start_line", "fq_name"), "callee_symbol_id").filter("file is not null")
    names = F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(-1)).alias("l"), F.coalesce("fq_name", F.lit("")).alias("n"))))
    return e.groupBy("caller_symbol_id", "file").agg(F.when(F.countDistinct("edge_type") > 1, "uses").otherwise(F.min("edge_type")).alias("how"), F.array_join(F.transform(names, lambda x: x["n"]), ",").alias("names"))


SQL["same_file_merge"] = f"""WITH {_SYM} SELECT caller_symbol_id, file, CASE WHEN count(DISTINCT edge_type) > 1 THEN 'uses' ELSE min(edge_type) END AS how,
      array_to_string(list_transform(list_sort(list((coalesce(start_line, -1), coalesce(fq_name, '')))), lambda x: x[2]), ',') AS names FROM e JOIN s ON s.id = callee_symbol_id WHERE file IS NOT NULL GROUP BY 1, 2"""


@_q
def insert_offsets(t: Tables):
    """Lines at which documentation would land in each file once the insertions before it are in."""
    s = G.placed_symbols(t.symbols).filter("file is not null and start_line is not null and lower(kind) = 'method'").select("file", "id", F.col("start_line").alias("line"), (F.length("fq_name") % 4 + 1).alias("n_lines"))
    return R.insert_lines(s, "file", "line", "n_lines", "id").select("file", "id", F.col("lands_at").cast("long").alias("lands_at"))


SQL["insert_offsets"] = f"""WITH {_SYM} SELECT file, id, CAST(start_line + coalesce(sum(length(fq_name) % 4 + 1) OVER (PARTITION BY file ORDER BY start_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lands_at
    FROM s WHERE file IS NOT NULL AND start_line IS NOT NULL AND lower(kind) = 'method'"""


@_q
def container_siblings(t: Tables):
    """Chunks under the same parent symbol: the first 48 in order, then without the symbol's own, twelve at most."""
    c = t.chunks.select("id", "symbol_id", "parent_symbol_id", "file", "start_line").distinct().filter("parent_symbol_id is not null")
    return B.siblings(c)


SQL["container_siblings"] = """WITH c AS (SELECT DISTINCT id, symbol_id, parent_symbol_id, file, start_line FROM chunks WHERE parent_symbol_id IS NOT NULL),
    a AS (SELECT *, row_number() OVER (PARTITION BY parent_symbol_id ORDER BY file NULLS FIRST, start_line NULLS FIRST, id) AS r FROM c QUALIFY r <= 48),
    b AS (SELECT * FROM a WHERE symbol_id IS DISTINCT FROM parent_symbol_id)
    SELECT parent_symbol_id, id, CAST(row_number() OVER (PARTITION BY parent_symbol_id ORDER BY r) AS INT) AS rank FROM b QUALIFY rank <= 12"""


@_q
def retrieval_bundle(t: Tables):
    """Context of every symbol in one long table, for unit tests: target, container, dependencies, domain types, similar, fixtures, configuration, chunks, tests."""
    return B.bundle(t.symbols.select("id").filter("id is not null"), t.symbols, t.edges, t.chunks)


@_q
def retrieval_bundle_http(t: Tables):
    """Context of every symbol for interface tests: edges both ways, siblings in the container and contracts besides."""
    return B.bundle(t.symbols.select("id").filter("id is not null"), t.symbols, t.edges, t.chunks, "http_api")


def _bundle_sql(name: str) -> str:
    unit = name == "java_unit"
    table = G.UNIT_PRIORITY if unit else G.PROFILE_PRIORITY[name]
    pri = "CASE " + " ".join(f"WHEN edge_type = '{k}' THEN " + (f"CASE WHEN inbound THEN {v[0]} ELSE {v[1]} END" if isinstance(v, tuple) else str(v)) for k, v in table.items()) + f" ELSE {6 if unit else 100} END"
    back = "" if unit else " UNION ALL SELECT callee_symbol_id, caller_symbol_id, edge_type, true FROM e"
    kinds = ", ".join(f"'{k}'" for k in B.DOMAIN_KINDS)
    on_path = lambda parts: "(" + " OR ".join(f"contains(lower(file), '{x}')" for x in parts) + ")"
    similar = ", ".join(f"'{k}'" for k in G.SIMILAR_TYPES[name])
    lists = [("similar", f"chunk_type IN ({similar})", "0", 5), ("fixture", f"(chunk_type = 'fixture' OR {on_path(B.FIXTURE_PATHS)})", "CAST(coalesce(chunk_type, '') <> 'fixture' AS INT)", 5), ("config", on_path(B.CONFIG_PATHS), "0", 5)]
    extra = ""
    if not unit:
        lists.append(("contract", "chunk_type = 'api_contract'", "0", 8))
        extra = """ UNION ALL SELECT target_id, 'sibling', CAST(row_number() OVER (PARTITION BY target_id ORDER BY pos) AS INT) AS rank, id FROM (
            SELECT h.id AS target_id, k.id, k.pos, k.symbol_id FROM held h JOIN (SELECT *, row_number() OVER (PARTITION BY parent_symbol_id ORDER BY file NULLS FIRST, start_line NULLS FIRST, id) AS pos FROM (
                SELECT DISTINCT id, symbol_id, parent_symbol_id, file, start_line FROM chunks WHERE parent_symbol_id IS NOT NULL) QUALIFY pos <= 48) k ON k.parent_symbol_id = h.container_id) x
            WHERE NOT EXISTS (SELECT 1 FROM dep WHERE dep.node = x.target_id AND dep.other = x.symbol_id) AND x.symbol_id IS DISTINCT FROM x.target_id QUALIFY rank <= 12"""
    listed = " UNION ALL ".join(
        f"SELECT repo_id, lang, '{label}' AS section, CAST(row_number() OVER (PARTITION BY repo_id, lang ORDER BY {first}, file NULLS FIRST, start_line NULLS FIRST, id) AS INT) AS rank, id FROM ck WHERE {cond} QUALIFY rank <= {n}" for label, cond, first, n in lists
    )
    return f"""WITH {_HELD}, tg AS (SELECT id FROM s WHERE id IS NOT NULL),
        be AS (SELECT caller_symbol_id AS node, callee_symbol_id AS other, edge_type, false AS inbound FROM e{back}),
        d1 AS (SELECT *, {pri} AS pri FROM be WHERE node <> other AND other IN (SELECT id FROM tg) AND node IN (SELECT id FROM tg) QUALIFY row_number() OVER (PARTITION BY node, other ORDER BY pri, edge_type, inbound) = 1),
        d2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY node, edge_type ORDER BY pri, edge_type, inbound, other) > 7 AS INT) AS over_cap FROM d1),
        dep AS (SELECT node, other, CAST(row_number() OVER (PARTITION BY node ORDER BY over_cap, pri, edge_type, inbound, other) AS INT) AS rank FROM d2 QUALIFY rank <= 15),
        seen AS (SELECT id AS t, id AS i FROM tg UNION SELECT id, container_id FROM held UNION SELECT node, other FROM dep),
        dk AS (SELECT id, file, fq_name, regexp_extract(fq_name, '([^.#]*)$', 1) AS simple, start_line FROM s WHERE id IS NOT NULL AND lower(trim(kind)) IN ({kinds})),
        nk AS (SELECT id, fq_name, regexp_extract(fq_name, '([^.#]*)$', 1) AS simple FROM s WHERE lower(kind) IN ({kinds})),
        near AS (SELECT file, id, row_number() OVER (PARTITION BY file ORDER BY start_line NULLS LAST, id) AS pos FROM dk WHERE file IS NOT NULL QUALIFY pos <= 25),
        l0 AS (SELECT id, regexp_replace(fq_name, '\\.[^.]*$', '') AS module, regexp_extract_all(CASE WHEN json_valid(signature_json) THEN json_extract_string(signature_json, '$.type') END, '\\b([A-Z][a-zA-Z0-9]*(?:\\.[A-Za-z0-9]+)*)\\b', 1) AS l FROM s WHERE id IS NOT NULL),
        l1 AS (SELECT id, module, list_filter(l, lambda y: lower(y) NOT IN ('void', 'int', 'long', 'boolean', 'double', 'float', 'byte', 'short', 'char')) AS l FROM l0),
        l2 AS (SELECT id, module, list_filter(l, lambda y, i: list_position(l, y) = i) AS l FROM l1),
        named AS (SELECT id, module, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS pos FROM l2),
        n AS (SELECT DISTINCT name, module FROM named),
        hits AS (SELECT name, module, id, 1 AS step FROM n JOIN nk ON nk.fq_name = name UNION ALL SELECT name, module, id, 2 FROM n JOIN nk ON nk.fq_name = module || '.' || name
            UNION ALL SELECT name, module, id, 3 FROM (SELECT name, module, id, row_number() OVER (PARTITION BY name, module ORDER BY length(fq_name), fq_name, id) AS r FROM n JOIN nk ON simple = name) WHERE r <= 8),
        res AS (SELECT DISTINCT name, module, id FROM (SELECT *, min(step) OVER (PARTITION BY name, module) AS best FROM hits) WHERE step = best),
        dom AS (SELECT s.id AS t, near.id AS i, 0 AS step, pos FROM s JOIN near USING (file) WHERE s.id IS NOT NULL UNION ALL SELECT named.id, res.id, 1, pos FROM named JOIN res ON res.name = named.name AND res.module = named.module),
        dom1 AS (SELECT t, i, min((step, pos)) AS o FROM dom WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.t = dom.t AND seen.i = dom.i) GROUP BY t, i),
        ck AS (SELECT DISTINCT id, repo_id, lang, chunk_type, file, start_line FROM chunks WHERE repo_id IS NOT NULL AND lang IS NOT NULL),
        li AS ({listed}),
        wh AS (SELECT symbol_id AS id, min(repo_id) AS repo_id, min(lang) AS lang FROM chunks WHERE symbol_id IN (SELECT id FROM tg) GROUP BY 1)
        SELECT id AS target_id, 'target' AS section, 1 AS rank, id AS item_id FROM tg
        UNION ALL SELECT id, 'container', 1, container_id FROM held WHERE id IN (SELECT id FROM tg)
        UNION ALL SELECT node, 'dependency', rank, other FROM dep
        UNION ALL SELECT t, 'domain', CAST(row_number() OVER (PARTITION BY t ORDER BY o, i) AS INT) AS rank, i FROM dom1 QUALIFY rank <= 8
        UNION ALL SELECT wh.id, section, rank, li.id FROM wh JOIN li USING (repo_id, lang)
        UNION ALL SELECT tg.id, 'chunk', CAST(row_number() OVER (PARTITION BY tg.id ORDER BY k.id) AS INT), k.id FROM tg JOIN (SELECT DISTINCT id, symbol_id FROM chunks) k ON k.symbol_id = tg.id
        UNION ALL SELECT tg.id, 'test', CAST(row_number() OVER (PARTITION BY tg.id ORDER BY caller_symbol_id) AS INT), caller_symbol_id FROM tg JOIN e ON callee_symbol_id = tg.id WHERE edge_type = 'TESTS_SOURCE'{extra}""".replace("\\\\", "\\")


SQL["retrieval_bundle"] = _bundle_sql("java_unit")
SQL["retrieval_bundle_http"] = _bundle_sql("http_api")

