import numpy as np
from pyspark.sql import functions as F

from stepframe.llm.topk import Lists, best_of_block, block_results, read_lists, share_read, sorted_access, top_k


def test_no_better_item_is_left_out():
    rnd = np.random.default_rng(3)
    for n, width, k in [(300, 5, 7), (50, 2, 20), (400, 16, 3), (10, 3, 20)]:
        items, queries = rnd.integers(-9, 9, (n, width)), rnd.integers(-5, 6, (25, width))
        for q, places in zip(queries, sorted_access(queries, items, k)):
            scores = items @ q
            least = np.sort(scores)[-min(k, n)]
            assert set(np.flatnonzero(scores >= least)) <= set(places.tolist())


def test_same_as_all_pairs(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=6).round(1)]) for i in range(200)] + [(k, [0.5] * 6) for k in range(300, 330)]
    odd = [(400, None), (None, [1.0] * 6), (420, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (440, [float("nan")] * 6), (460, [float("inf")] + [0.0] * 5), (480, []), (500, [1.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = {}
    for r in top_k(frame, F.col("vec_id") % 20 == 0, k=5, per_block=64, queries_per_block=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = {i: np.floor(64 * np.float32(x).astype(np.float64)).astype(int) for i, x in rows}
    for q in (i for i in v if i % 20 == 0):
        want = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5]
        assert sorted(got.pop(q)) == [(n, c, -s) for n, (s, c) in enumerate(want, start=1)]
    assert not got
    assert top_k(frame.limit(0), F.lit(True)).count() == 0


def test_rows_that_repeat_the_query_take_no_place():
    rnd = np.random.default_rng(7)
    items = np.concatenate([np.full((60, 4), 100), rnd.integers(-9, 9, (200, 4))])
    ids = np.concatenate([np.zeros(60, int), np.arange(1, 201)])
    queries, query_ids = np.stack([items[0], items[60]]), np.array([0, 1])
    got = best_of_block(query_ids, queries, ids, items, 5)
    for q, vector in zip(query_ids, queries):
        want = sorted((-int(v @ vector), int(c)) for c, v in zip(ids, items) if c != q)[:5]
        mine = got[got.query_id == q]
        assert sorted(zip((-mine.score).tolist(), mine.vec_id.tolist())) == want


def test_bounds_hold_at_every_depth():
    rnd = np.random.default_rng(11)
    for n, width in [(60, 1), (200, 7), (300, 24)]:
        items, queries = rnd.integers(-37, 37, (n, width)), rnd.integers(-37, 37, (12, width))
        lists, scores = Lists(items, np.float32), items @ queries.T
        for depth in (1, n // 3, n // 2, n - 1, n):
            lower, upper = lists.bounds(queries.astype(np.float32), depth)
            assert (lower <= scores).all() and (scores <= upper).all()
    zero = Lists(np.zeros((30, 4), int), np.float32).bounds(np.ones((2, 4), np.float32), 10)
    assert (zero[0] <= 0).all() and (zero[1] >= 0).all()


def test_queries_stop_before_the_end_of_their_lists(spark):
    rnd = np.random.default_rng(13)
    vectors = rnd.normal(size=(1500, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    kept, share = read_lists(np.floor(64 * vectors[:100]).astype(int), np.floor(64 * vectors).astype(int), 21)
    assert (share < 1).mean() > 0.9 and all(len(x) <= 1500 / 16 for x in kept)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    read = share_read(block_results(frame, F.col("vec_id") % 20 == 0, per_block=800)).collect()
    assert len(read) == 75 and sum(r["share"] < 1 for r in read) > 60 and all(0.5 <= r["share"] <= 1 for r in read)


def test_equal_items_and_null_weights_are_read_to_the_end_or_kept_whole():
    items = np.ones((100, 3), int)
    for places, share in zip(*read_lists(np.array([[1, 2, 3], [0, 0, 0], [-1, 0, 1]]), items, 5)):
        assert share == 1 and len(places) == 100
