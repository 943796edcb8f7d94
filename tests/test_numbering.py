import random

from pyspark.sql import functions as F

from framekiln.operators.numbering import prefixes, running_max, with_ordinal, with_sorted_ordinal


def skewed_rows(n, seed):
    rng = random.Random(seed)
    places = rng.sample(range(10 * n), n)
    # One group holds about half of all rows.
    return [(rng.choice("aaabcd"), rng.randrange(3), p, rng.randrange(1000)) for p in places]


def test_ordinal_equals_brute_force(spark):
    rows = skewed_rows(500, 1)
    df = spark.createDataFrame(rows, "g string, shard_idx int, pos long, v int").repartition(7)
    for block_rows in (1, 16, 1 << 20):
        got = with_ordinal(df, ["shard_idx", "pos"], ["g"], total="n", block_rows=block_rows).collect()
        assert len(got) == len(rows)
        for g in "abcd":
            want = sorted((r[1], r[2]) for r in rows if r[0] == g)
            found = sorted((r.ordinal, r.shard_idx, r.pos) for r in got if r.g == g)
            assert [(s, p) for _, s, p in found] == want
            assert [o for o, _, _ in found] == list(range(len(want)))
            assert {r.n for r in got if r.g == g} == {len(want)}


def test_ordinal_without_group(spark):
    df = spark.range(0, 1000, 1, 5).withColumn("pos", (F.col("id") * 7919) % 1009)
    got = with_ordinal(df, ["pos"], block_rows=50).orderBy("pos").collect()
    assert [r.ordinal for r in got] == list(range(1000))


def test_negative_positions_keep_their_order(spark):
    df = spark.createDataFrame([(p,) for p in (-70, -1, 0, 3, -64, 64, 63)], "pos long")
    got = with_ordinal(df, ["pos"], block_rows=64).orderBy("pos").collect()
    assert [r.ordinal for r in got] == list(range(7))


def test_sorted_ordinal(spark):
    names = [f"f{i:03d}" for i in range(200)]
    shuffled = names[:]
    random.Random(3).shuffle(shuffled)
    df = spark.createDataFrame([(n,) for n in shuffled], "path string").repartition(6)
    got = {r.path: r.ordinal for r in with_sorted_ordinal(df, ["path"]).collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_running_max(spark):
    rows = skewed_rows(300, 2)
    df = spark.createDataFrame(rows, "g string, shard_idx int, pos long, v int")
    for block_rows in (10, 1 << 20):
        got = running_max(df, "v", "pos", ["g"], "top", block_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.top == max(v for g, _, p, v in rows if g == r.g and p <= r.pos)


def test_two_levels_equal_one(spark):
    """Sparse positions: nearly as many blocks as rows, cut into ranges of a few."""
    rows = skewed_rows(400, 4)
    df = spark.createDataFrame(rows, "g string, shard_idx int, pos long, v int").repartition(5)
    for group in (["g"], []):
        one = with_ordinal(df, ["shard_idx", "pos"], group, total="n", block_rows=2)
        two = with_ordinal(df, ["shard_idx", "pos"], group, total="n", block_rows=2, level_rows=16)
        assert sorted(map(tuple, two.collect())) == sorted(map(tuple, one.collect()))
    top = running_max(df, "v", "pos", ["g"], "top", 3, level_rows=10).collect()
    assert all(r.top == max(v for g, _, p, v in rows if g == r.g and p <= r.pos) for r in top) and len(top) == len(rows)


def test_no_window_over_all_blocks(spark):
    """Beyond one range, every window below the top is inside a range; the top one has a row per range."""
    blocks = spark.range(0, 3000, 1, 4).select((F.col("id") * 1_000_003).alias("b"), F.lit(2).cast("long").alias("rows"))
    found = prefixes(blocks, [], ["b"], "rows", total="n", level_rows=100)
    assert [(r["__offset"] or 0, r.n) for r in found.orderBy("b").collect()] == [(2 * i, 6000) for i in range(3000)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line and "rows#" in line.split("windowspecdefinition")[0]]
    assert windows and all("__range" in line.split("windowspecdefinition")[1].split(" ASC")[0] for line in windows)
    above = found.select("__offset").distinct()
    assert above.count() == 3000


def test_empty_table_has_no_numbers(spark):
    df = spark.createDataFrame([], "g string, pos long")
    assert with_ordinal(df, ["pos"], ["g"], total="n").collect() == []
