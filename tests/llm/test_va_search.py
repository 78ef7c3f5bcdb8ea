import numpy as np
import pytest

from millrace.llm import va_search


def brute(rows, k):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, tuple(int(np.floor(256 * float(x))) for x in v)))
    out = []
    for q in {i for i, _ in good if i % 5 == 0}:
        vectors = {a for i, a in good if i == q}
        near = sorted((-sum(x * y for x, y in zip(a, b)), i) for a in vectors for i, b in good if i != q and len(b) == len(a))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=7).astype("f4").tolist()) for i in range(300)]
    rows += [(300 + i, rows[9][1]) for i in range(120)]  # one vector many times: ties go to smaller ids
    rows += [rows[20], rows[33], rows[33], (35, rows[40][1]), (500, None), (505, []), (510, [1.0, None] + [0.0] * 5), (515, [float("nan")] * 7), (520, [float("inf")] + [0.0] * 6), (525, [1.0, 2.0]), (526, [3.0, 4.0]), (None, rows[1][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = sorted(tuple(r) for r in va_search.top_k(df, "vec_id % 5 = 0", 5, block=32, queries_in_block=20).collect())
    assert got == brute(rows, 5)


def test_every_repeat_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in va_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0").collect())
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 2)]


def test_no_exact_file_is_opened_where_bounds_decide():
    def block(x):
        return va_search.build_block(np.arange(len(x)) + 10, x)

    near, far = np.full((9, 4), 500) + np.arange(9)[:, None], np.full((9, 4), -500) + np.arange(9)[:, None]
    best, opened = [va_search.Best(3)], []
    for x in (near, far):
        row, exact = block(x)
        va_search.search_block(row, lambda x=x: opened.append(int(x[0, 0])) or x, np.array([0]), np.ones((1, 4), np.int64), best, 3)
    assert opened == [500] and [-s for s, _ in best[0].rows] == [2032, 2028, 2024]


def test_bounds_spare_exact_reads():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(4096, 16))).astype(np.int64)
    block, _ = va_search.build_block(np.arange(4096), x)
    best = [va_search.Best(5) for _ in range(20)]
    read = va_search.search_block(block, lambda: x, np.arange(20), x[:20], best, 5)
    assert read < 0.2 * 20 * 4096
    s = x[:20] @ x.T
    s[np.arange(20), np.arange(20)] = -(1 << 60)
    assert [[-r[0] for r in b.rows] for b in best] == np.sort(s, 1)[:, ::-1][:, :5].tolist()


def test_large_components_stay_exact():
    x = np.array([[2**40, 1], [2**40, 2], [2**41, -1]])
    best = [va_search.Best(2)]
    va_search.search_block(va_search.build_block(np.arange(3), x)[0], lambda: x, np.array([0]), x[:1], best, 2)
    assert best[0].rows == [(-(2**81 - 1), 2), (-(2**80 + 2), 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert va_search.top_k(df, "vec_id % 50 = 0").collect() == []


def test_too_large(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        va_search.top_k(df, "vec_id % 50 = 0").collect()
