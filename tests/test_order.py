from pyspark.sql import functions as F

from sverka.operators import order


def test_neighbours_cross_ranges(spark):
    df = spark.range(200).selectExpr("id", "lpad(id, 4, '0') as k")
    got = [(r["a"]["id"], r["b"]["id"]) for r in order.sorted_neighbours(df, 2, "k").collect()]
    assert sorted(got) == sorted((b - d, b) for b in range(200) for d in (1, 2) if b >= d)
    assert order.sorted_neighbours(df.limit(0), 2, "k").count() == 0


def test_neighbours_over_short_ranges(spark):
    want = {(b - d, b) for b in range(24) for d in range(1, 6) if b >= d}
    df = spark.range(24).selectExpr("id", "lpad(id, 4, '0') as k").repartition(3)
    keep = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for adaptive in ("false", "true"):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            for block in (5, 7, 4096):
                got = [(r["a"]["id"], r["b"]["id"]) for r in order.sorted_neighbours(df, 5, "k", block=block).collect()]
                assert len(got) == len(want) and set(got) == want
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_next_rows_of_a_hot_key(spark):
    df = spark.range(300).selectExpr("if(id < 280, 'hot', concat('k', id % 5)) as k", "id")
    got = {(r["a"]["id"], r["b"]["id"]) for r in order.next_rows(df, "k", "id").collect()}
    want = {(i, i + 1) for i in range(279)} | {(i, i + 5) for i in range(280, 295)}
    assert got == want


def test_running_last(spark):
    df = spark.range(400).selectExpr("if(id < 390, 'hot', 'b') as k", "id", "if(id % 100 = 7, id, null) as v")
    placed = order.numbered(df.repartition(3), "k", "id")
    got = {r["id"]: (r["n"], r["last"]) for r in order.running_last(placed, "k", F.col("v"), "last").collect()}
    for i in range(390):
        before = [x for x in range(i) if x % 100 == 7]
        assert got[i] == (i + 10, before[-1] if before else None)  # the ten rows of b come first
    assert got[395] == (5, None)
    now = {r["id"]: r["last"] for r in order.running_last(placed, "k", F.col("v"), "last", current=True).collect()}
    assert now[7] == 7 and now[6] is None
