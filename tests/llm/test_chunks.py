import random

import numpy as np
from pyspark.sql import functions as F

from srcquarry.llm import near_duplicates as nd, similar_vectors as sv, splitting

CHUNK = "id string, lang string, content string, start_line int, limit_chars int, piece int"
LIMITS = "lang string, min_tokens int, max_tokens int, chars_per_token int, overlap_tokens int"


def test_pieces_of_random_texts():
    r = random.Random(1)
    for _ in range(400):
        texts = ["".join(r.choice("ab \n\n") if r.random() < 0.7 else "x" * r.randint(1, 30) for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 4))]
        limit = np.array([r.randint(1, 40) for _ in texts])
        overlap = np.array([r.randint(0, 30) for _ in texts])
        doc, start, end = splitting.split_batch(texts, limit, overlap)
        for k, t in enumerate(texts):
            o, p = min(overlap[k], limit[k] // 2), [(a, b) for d, a, b in zip(doc, start, end) if d == k]
            assert p[0][0] == 0 and p[-1][1] == len(t) and all(0 < b - a <= limit[k] for a, b in p)
            assert all(a < c <= max(0, b - o) or c == 0 == max(0, b - o) for (a, b), (c, _) in zip(p, p[1:])) and all(d > b for (_, b), (_, d) in zip(p, p[1:]))
            slack = int((limit[k] - o) * splitting.SLACK)
            for (_, b), (c, _) in zip(p, p[1:]):  # at a boundary of words unless none is near enough
                low = max(0, b - o - slack)
                near = [x for x in range(low, max(0, b - o) + 1) if x == 0 or t[x - 1] in " \n"]
                assert c == (near[-1] if near else b - o)


def test_cuts_are_natural_and_greedy():
    text = "aaaa\nbbbb\ncccc\n\ndddd eeee"
    doc, a, b = splitting.split_batch([text], np.array([10]), np.array([2]))
    assert all(text[y - 1] in "\n " for y in b[:-1]) and text[a[0] : b[0]] == "aaaa\nbbbb\n"


def test_split_chunks(spark):
    limits = spark.createDataFrame([("java", 1, 10, 4, 2), ("cs", 0, None, 0, None)], LIMITS)
    rows = [("a", "java", "[symbol_kind=method x]\n\n" + "line of code\n" * 6, 100, 1, 1), ("b", "java", "short", 5, 1, 1), ("c", "cs", "y" * 3201, 0, 1, 1), ("d", "??", None, 1, 1, 1), ("e", None, "z" * 3200, 1, 1, 1), ("f", "java", "", 1, 1, 1)]
    df = spark.createDataFrame(rows + rows[:1], CHUNK)
    got = splitting.split_chunks(df, limits).orderBy("id", "piece").collect()
    assert {r.id for r in got} == {"a", "c"}
    a = [r for r in got if r.id == "a"]
    assert [r.piece for r in a] == list(range(len(a))) and all(len(r.content) <= 40 for r in a)
    assert a[0].start_line == 100 and a[-1].end_line == 105
    assert all(p.end_char - q.start_char >= 8 and p.content.endswith(q.content[: p.end_char - q.start_char]) and (p.content + "x")[q.start_char - p.start_char - 1] in " \n" for p, q in zip(a, a[1:]))
    c = [r for r in got if r.id == "c"]
    assert sum(r.end_char - r.start_char for r in c) == 3201 + 320 * (len(c) - 1) and {r.start_line for r in c} == {0}
    assert splitting.split_chunks(df.limit(0), limits).count() == 0


def plain_similarity(a, b):
    import re

    def s(x):
        w = [t.lower() for t in re.findall(r"[A-Za-z0-9_]+", x)]
        return set(zip(w, w[1:], w[2:]))

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x and y else 0


def near_table(seed, n=70):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[r.choice(words) for _ in range(r.randint(3, 60))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(t))
            t[k : k + r.randint(0, 1)] = [r.choice(words)] * r.randint(0, 2)
        if r.random() < 0.2 and len(t) > 8:
            k = r.randrange(len(t))
            t = t[k:] + t[:k]
        out.append(" ".join(t))
    return [*out, out[0], out[0], out[0].upper(), "", None, "a b", "ü ß 字", "same same same same", "same same same"]


def test_pairs_equal_brute_force(spark):
    for seed, hot in ((1, 100), (2, 3), (2, 2), (2, 10**9)):
        texts = near_table(seed)
        rows = [(f"id{k:03d}", t, 1, b"x") for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows + rows[:3], "id string, content string, n int, class binary")
        got = [(r.id_a, r.id_b) for r in nd.near_duplicate_pairs(df, 0.7, hot).collect()]
        want = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if rows[i][1] and rows[j][1] and plain_similarity(rows[i][1], rows[j][1]) >= 0.7}
        assert len(got) == len(set(got)) and set(got) == want


def test_groups(spark):
    base = " ".join(f"t{k}" for k in range(40))
    rows = [("a", base), ("b", base), ("c", base + " more"), ("d", "something else that stands alone here"), ("e", base.replace("t20", "x"))]
    got = {r.id: (r.class_id, r.group_id, r.n_links) for r in nd.near_duplicate_groups(spark.createDataFrame(rows, "id string, content string")).collect()}
    assert got == {"a": ("a", "a", 3), "b": ("a", "a", 3), "c": ("c", "a", 3), "e": ("e", "a", 3)}


def test_hot_copies_and_empty(spark):
    df = spark.range(900).selectExpr("concat('k', id) as id", "case when id % 3 = 0 then 'one two three four' else concat('u', id, ' v', id, ' w', id) end as content")
    assert nd.near_duplicate_pairs(df).count() == 300 * 299 // 2
    assert nd.near_duplicate_groups(df).count() == 300
    assert nd.near_duplicate_pairs(df.limit(0)).count() == 0 and nd.near_duplicate_groups(df.limit(0)).count() == 0


def test_banded_distance():
    r = random.Random(2)

    def plain(x, y):
        p = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            q = [i]
            for j, d in enumerate(y, 1):
                q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (c != d)))
            p = q
        return p[-1]

    a, b = ([np.array([r.randint(0, 4) for _ in range(r.randint(0, 30))], np.uint64) for _ in range(80)] for _ in range(2))
    assert nd.banded_distance(a, b).tolist() == [plain(x.tolist(), y.tolist()) for x, y in zip(a, b)]


def test_alignment_accepts_only_what_the_sets_accept():
    r = random.Random(3)
    hits = 0
    for _ in range(300):
        a = [r.randint(0, 30) for _ in range(r.randint(3, 60))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 1)] = [r.randint(0, 30)] * r.randint(0, 2)
            b = b if len(b) > 2 else list(a)
        x, y = ({tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in (a, b))
        most = int(nd.allowed_edits(np.array([len(x)]), np.array([len(y)]), 0.7)[0])
        d = int(nd.banded_distance([np.array(a, np.uint64)], [np.array(b, np.uint64)], 60)[0])
        if d <= most:
            hits += 1
            assert len(x & y) / len(x | y) >= 0.7
    assert hits > 50


def test_copies_of_two_large_classes(spark, monkeypatch):
    monkeypatch.setattr(nd, "SPAN", 7)
    a = " ".join(f"t{k}" for k in range(40))
    df = spark.range(60).selectExpr("concat('k', lpad(id, 2, '0')) as id", f"case when id % 2 = 0 then '{a}' else '{a} more' end as content")
    got = [(r.id_a, r.id_b) for r in nd.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2


def vectors(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    v = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dim)) * rng.choice([0.05, 0.2, 0.3, 1.0], n)[:, None]
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_neighbours_equal_brute_force(spark, monkeypatch):
    v = vectors(3, 400)
    v[5] = v[6] = v[7]
    groups = [f"g{k % 3}" if k % 2 else "hot" for k in range(400)]
    rows = [(f"i{k:03d}", groups[k], v[k].astype(np.float32).tolist(), 1) for k in range(400)]
    x = np.array([r[2] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for i in range(400):
        sims = sorted(((-min(1.0, round(float(x[i] @ x[j]), 12)), rows[j][0]) for j in range(400) if j != i and groups[i] == groups[j] and x[i] @ x[j] >= 0.9))
        want |= {tuple(sorted((rows[i][0], b))) for _, b in sims[:5]}
    df = spark.createDataFrame(rows + rows[:9], "id string, grp string, embedding array<float>, blocks int")
    for block in (2048, 64):
        monkeypatch.setattr(sv, "BLOCK", block)
        got = {(r.id_a, r.id_b) for r in sv.similar_pairs(df).collect()}
        assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want) + 1


def test_unusable_vectors_ties_and_empty(spark):
    e = [1.0] + [0.0] * 63
    rows = [("a", "g", e), ("b", "g", [2.0] + [0.0] * 63), ("c", "h", e), ("n", "g", None), ("s", "g", [1.0]), ("z", "g", [0.0] * 64), ("q", "g", [float("nan")] + e[1:]), ("f", "g", [float("inf")] + e[1:]), ("x", None, e), ("y", "g", [None] + e[1:])]
    df = spark.createDataFrame(rows, "id string, grp string, embedding array<float>")
    assert [(r.id_a, r.id_b) for r in sv.similar_pairs(df).collect()] == [("a", "b")]
    copies = spark.range(40).select(F.concat(F.lit("c"), F.lpad("id", 2, "0")).alias("id"), F.lit("g").alias("grp"), F.array(*[F.lit(x) for x in e]).cast("array<float>").alias("embedding"))
    near = sv.neighbours(copies)
    assert near.count() == 200 and {r.neighbour_id for r in near.filter("id = 'c39'").collect()} == {"c00", "c01", "c02", "c03", "c04"}
    assert sv.similar_pairs(df.limit(0)).count() == 0


def test_neighbours_without_a_threshold_are_all_found(spark, monkeypatch):
    v = np.random.default_rng(5).standard_normal((150, 64)).astype(np.float32)
    v[7] = v[8] = v[9]
    groups = ["pair" if k < 2 else f"g{k % 2}" for k in range(150)]
    x = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    cos = np.minimum(x @ x.T, 1.0).round(9)
    want = {}
    for i in range(150):
        want[f"i{i:03d}"] = [f"i{j:03d}" for j in sorted((j for j in range(150) if j != i and groups[i] == groups[j]), key=lambda j: (-cos[i, j], j))[:5]]
    df = spark.createDataFrame([(f"i{k:03d}", groups[k], v[k].tolist()) for k in range(150)], "id string, grp string, embedding array<float>")
    for block in (2048, 32):
        monkeypatch.setattr(sv, "BLOCK", block)
        got = {}
        for r in sorted(sv.neighbours(df).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.id, []).append(r.neighbour_id)
        assert got == want


def test_dense_group_keeps_its_nearest(spark):
    rng = np.random.default_rng(11)
    v = rng.standard_normal(64) + rng.standard_normal((2000, 64)) * 0.2
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    x = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -1)
    assert np.median(cos) > 0.95
    want = {(min(i, j), max(i, j)) for i in range(2000) for j in np.argsort(-cos[i])[:5].tolist()}
    df = spark.createDataFrame([(f"i{k:04d}", "g", v[k].tolist()) for k in range(2000)], "id string, grp string, embedding array<float>")
    got = {(int(r.id_a[1:]), int(r.id_b[1:])) for r in sv.similar_pairs(df).collect()}
    assert got == want


def test_large_groups_are_ranged(spark):
    """A repository of several ranges: recall against brute force; what is compared grows less than with the square."""
    rng = np.random.default_rng(4)
    n = 24_000
    v = rng.standard_normal((n, 64))
    v[n // 2 :] = v[: n // 2] + rng.standard_normal((n // 2, 64)) * 0.35
    v[:300] = v[0] + rng.standard_normal((300, 64)) * 0.2
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    x = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    assert sv.route(n, 0.9)[0] > 0 and sv.route(5000, 0.9) == (0, 1)
    want = set()
    for at in range(0, n, 2000):
        cos = x[at : at + 2000] @ x.T
        cos[np.arange(len(cos)), np.arange(at, at + len(cos))] = -1
        top = np.argpartition(-cos, 5, axis=1)[:, :5]
        for i, row in enumerate(top):
            want |= {(min(at + i, j), max(at + i, j)) for j in row.tolist() if cos[i, j] >= 0.9}
    df = spark.createDataFrame([(f"i{k:05d}", "g", v[k].tolist()) for k in range(n)], "id string, grp string, embedding array<float>")
    got = {(int(r.id_a[1:]), int(r.id_b[1:])) for r in sv.similar_pairs(df).collect()}
    assert len(want) > 10_000 and len(got & want) >= 0.995 * len(want) and len(got - want) <= 0.005 * len(want)

    def compared(rows):
        unit = rng.standard_normal((rows, 64))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        codes = (np.clip(np.rint(unit @ sv.directions(64) * sv.STEPS), -100, 100) + 128).astype(np.uint8)
        keys = sv.ranges(codes, *sv.route(rows, 0.9), 0.9)
        sizes = [np.unique(keys[:, k], return_counts=True)[1].astype(float) for k in range(keys.shape[1])]
        return sum((s**2).sum() for s in sizes), max(s.max() for s in sizes)

    (small, _), (large, most) = compared(25_000), compared(100_000)
    assert large < 16 * 0.5 * small and large < 0.4 * 100_000**2 and most < 0.5 * 100_000
