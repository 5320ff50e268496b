from collections import Counter
from math import comb

from pyspark.sql import functions as F

from stepframe.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards


def test_draws_follow_the_law(spark):
    for good, total, draws in [(5, 12, 7), (3, 1000, 400), (40, 41, 39), (0, 5, 3), (5, 5, 3), (7, 20, 0), (2, 3, 3)]:
        n = 4000
        row = spark.range(n).select(hypergeometric((F.col("id") + 0.5) / n, F.lit(good), F.lit(total), F.lit(draws)).alias("k"))
        got = Counter(r.k for r in row.collect())
        for k in range(draws + 1):
            chance = comb(good, k) * comb(total - good, draws - k) / comb(total, draws) if k <= good and draws - k <= total - good else 0
            assert abs(got[k] / n - chance) < 2 / n * 2, (good, total, draws, k)


def test_large_numbers_stay_in_range(spark):
    row = spark.range(50).select(hypergeometric((F.col("id") + 0.5) / 50, F.lit(10**9), F.lit(40 * 10**9), F.lit(10**8)).alias("k")).collect()
    ks = [r.k for r in row]
    assert 2_495_000 < min(ks) and max(ks) < 2_505_000 and 1_000 < max(ks) - min(ks)


def test_matrix_has_both_margins(spark):
    sizes = [7, 0, 120, 33, 1] * 20
    parts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "part long, n long")
    rows = communication_matrix(parts, 6, sum(sizes), 3).collect()
    assert {r.part: sum(r.counts) for r in rows} == {i: n for i, n in enumerate(sizes) if n}
    columns = [sum(r.counts[s] for r in rows) for s in range(6)]
    assert sum(columns) == sum(sizes) and max(columns) - min(columns) <= 1


def test_shards(spark):
    rows = [(1, "a", 9), (1, "a", 9), (None, None, 8), (2, "", 7), (3, "x" * 100_000, 6)] + [(k, "t", 5) for k in range(4, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(7)
    got = shuffle_into_shards(df, shards=11, rows_per_block=5).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert set(shards) == set(range(11)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    sizes = [len(x) for x in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    assert shuffle_into_shards(df.limit(0)).count() == 0
    assert sorted(r.shard for r in shuffle_into_shards(df.limit(3), shards=5).collect()) == [0, 1, 2]


def test_placement_is_uniform(spark):
    df = spark.range(0, 40, 1, 4).withColumnRenamed("id", "doc_id")
    seen = Counter()
    for seed in range(12):
        for r in shuffle_into_shards(df, shards=4, seed=seed).collect():
            seen[(r.doc_id % 10 < 5, r.shard)] += 1
    assert all(30 <= n <= 90 for n in seen.values()) and len(seen) == 8
