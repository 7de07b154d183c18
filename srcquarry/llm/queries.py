"""Queries of the training-data operators, by problem number, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from srcquarry.llm import function_docs, generated_files, mixing, near_duplicates, sentences, similar_vectors, splitting, tokens


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the splitting operator has to cut."""
    pieces = splitting.split_chunks(_table(spark, d, "chunks"), _table(spark, d, "chunk_limits"), with_content=False)
    return pieces.select("id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized chunks."""
    return splitting.split_chunks(_table(spark, d, "chunks"), _table(spark, d, "chunk_limits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = _table(spark, d, "chunks").select("id", F.col("repo_id").alias("grp"), "embedding")
    return similar_vectors.similar_pairs(vectors, k=5, threshold=0.9, dim=64)


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar chunks of each chunk within its repository, however far they are."""
    vectors = _table(spark, d, "chunks").select("id", F.col("repo_id").alias("grp"), "embedding")
    return similar_vectors.neighbours(vectors, k=5, dim=64).withColumn("cosine", F.round("cosine", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_table(spark, d, "chunks"), 0.7)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near-duplicate chunks: class, group and number of links of each."""
    return near_duplicates.near_duplicate_groups(_table(spark, d, "chunks"), 0.7)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return generated_files.not_hand_written(_table(spark, d, "files"), _table(spark, d, "sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return function_docs.method_docs(_table(spark, d, "class_records"), _table(spark, d, "sources"), with_text=False)


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Name, documentation and code of each documented method."""
    return function_docs.method_docs(_table(spark, d, "class_records"), _table(spark, d, "sources"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(tokens.once(_table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", even=True)


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Token ids with the code point offsets of their slices."""
    return tokens.encode_column(tokens.once(_table(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", "offsets", even=True)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed sequence: slot, source, document and number of its use."""
    return mixing.Mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets")).plan


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached shares of each source."""
    return mixing.Mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets")).shares()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(_table(spark, d, "documents")).distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_neighbours, p3_found, p3_groups, p4_found, p5_found, p5_pairs, p7_ids, p7_offsets, p8_mix, p8_shares, p9_found)
}

#: Brute force: usable vectors, the cosine of each pair of a repository, the five most similar of each.
_NEAR = """u AS (SELECT DISTINCT id, repo_id, embedding::DOUBLE[] AS v FROM chunks WHERE repo_id IS NOT NULL AND len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT a.id, b.id AS neighbour_id, least(1, round(list_cosine_similarity(a.v, b.v), 12)) AS cosine FROM u a JOIN u b ON a.repo_id = b.repo_id AND a.id <> b.id),
        near AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour_id) AS INT) AS rank FROM p QUALIFY rank <= 5)"""
#: Brute force: the shingle sets of all contents, classes of equal sets, pairs of classes by shared shingles.
_ALIKE = r"""c AS (SELECT DISTINCT id, content FROM chunks WHERE content IS NOT NULL),
        t AS (SELECT id, list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda w: lower(w)) AS w FROM c),
        g AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM t WHERE len(w) >= 3),
        k AS (SELECT s, min(id) AS class_id, len(s) AS n FROM g GROUP BY s),
        member AS (SELECT DISTINCT g.id, class_id FROM g JOIN k ON k.s = g.s),
        h AS (SELECT class_id, n, unnest(s) AS x FROM k),
        o AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_have FROM h a JOIN h b ON a.x = b.x AND a.class_id < b.class_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM o WHERE both_have >= 0.7 * (na + nb - both_have) - 1e-9),
        pair AS (SELECT x.id AS i, y.id AS j FROM link JOIN member x ON x.class_id = a JOIN member y ON y.class_id = b
            UNION ALL SELECT x.id, y.id FROM member x JOIN member y ON x.class_id = y.class_id AND x.id < y.id)"""

SQL: dict[str, str] = {
    "p1_found": """
        SELECT DISTINCT c.id FROM chunks c LEFT JOIN chunk_limits l ON c.lang = l.lang
        WHERE ceil(length(c.content) / (CASE WHEN l.chars_per_token > 0 THEN l.chars_per_token ELSE 4 END)::DOUBLE)
              > CASE WHEN l.max_tokens > 0 THEN l.max_tokens ELSE 800 END""",
    "p2_found": f"WITH {_NEAR} SELECT DISTINCT least(id, neighbour_id) AS id_a, greatest(id, neighbour_id) AS id_b FROM near WHERE cosine >= 0.9",
    "p2_neighbours": f"WITH {_NEAR} SELECT id, neighbour_id, round(cosine, 6) AS cosine, rank FROM near",
    "p3_found": f"WITH {_ALIKE} SELECT least(i, j) AS id_a, greatest(i, j) AS id_b FROM pair",
    "p3_groups": f"""WITH RECURSIVE {_ALIKE}, e AS (SELECT i, j FROM pair UNION ALL SELECT j, i FROM pair), r AS (SELECT DISTINCT i, i AS j FROM e UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j)
        SELECT m.id, m.class_id, x.group_id, n.n_links FROM (SELECT i, min(j) AS group_id FROM r GROUP BY i) x JOIN (SELECT i, count(*) AS n_links FROM e GROUP BY i) n USING (i) JOIN member m ON m.id = x.i""",
}
