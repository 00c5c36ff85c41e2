"""Set-wise forms against sequential ones, and streams."""

import random

from pyspark.sql import functions as F

from glyphlake.functions import bits
from glyphlake.operators import clusters, dictionary, matching
from glyphlake.streaming import fold


def table(spark, n=60, seed=3):
    rng = random.Random(seed)
    base = [[rng.randint(0, 1) for _ in range(70)] for _ in range(5)]
    rows = []
    for k in range(n):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(70)] ^= 1
        rows.append((k, k % 2, own))
    df = spark.createDataFrame(rows, "mark_id long, size int, bits array<int>")
    return rows, df.withColumns({"words": bits.pack(F.col("bits")), "area": F.size("bits")})


def distance(a, b):
    return sum(x != y for x, y in zip(a, b)) / 70


def test_every_mark_with_its_best_earlier_one(spark):
    rows, df = table(spark)
    got = {r.mark_id: r for r in dictionary.sequential_dictionary(df, ["size"], 0.15).collect()}
    for k, size, own in rows:
        found = min(((distance(own, o), j) for j, s, o in rows if s == size and j < k and distance(own, o) <= 0.15), default=(None, None))
        assert (got[k].mm, got[k].ref_id) == found


def test_components_equal_union_find(spark):
    rows, df = table(spark)
    got = {r.mark_id: r.class_id for r in clusters.equivalence_classes(df, ["size"], 0.1).collect()}
    up = {k: k for k, *_ in rows}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for k, size, own in rows:
        best = min(((distance(own, o), j) for j, s, o in rows if s == size and j != k and distance(own, o) <= 0.1), default=None)
        if best:
            a, b = top(k), top(best[1])
            up[max(a, b)] = min(a, b)
    assert got == {k: top(k) for k, *_ in rows}


def test_bands_lose_no_pair(spark):
    _, df = table(spark)
    near = {(r.i, r.j) for r in matching.edges(df, ["size"], 0.15).collect()}
    assert near == {(r.i, r.j) for r in matching.scored(df, ["size"]).where("mm < 0.15").collect()}


def test_perfect_entries_step_aside(spark):
    rows = [(0, None, None, False, False), (1, 0, 0.0, False, True), (2, 1, 0.0, False, True), (3, 2, 0.1, False, False)]
    df = spark.createDataFrame(rows, "mark_id long, ref_id long, mm double, singleton boolean, perfect boolean")
    got = {r.mark_id: (r.ref_id, r.singleton) for r in dictionary.point_past_perfect(df).collect()}
    assert got[3] == (0, False) and got[1][1] and got[2] == (0, True)


def test_leaders_are_in_order(spark):
    rows, df = table(spark)
    got = {r.mark_id: r.leader_id for r in dictionary.leaders(df, ["size"], 0.1).collect()}
    heads = []
    for k, size, own in rows:
        found = min(((distance(own, o), j) for j, s, o in heads if s == size), default=(1.0, None))
        if found[0] > 0.1:
            heads.append((k, size, own))
            found = (0, k)
        assert got[k] == found[1]


def test_stream_carries_the_dictionary(spark, tmp_path):
    rows = [(1, f"2024-01-0{d}", s) for d, s in ((1, ["a", "b"]), (2, ["b", "c"]), (3, ["c"]))]
    df = spark.createDataFrame(rows, "doc_id long, page string, symbols array<string>").withColumn("page", F.to_date("page"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = fold.carried_dictionary_stream(stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM folded").collect())
    batch = fold.carried_dictionary(df.select("doc_id", "page", F.explode("symbols").alias("symbol")))
    assert got == sorted(tuple(r) for r in batch.collect())
    assert [g[2:] for g in got] == [(0, 2, 0, 2), (1, 1, 1, 2), (1, 0, 1, 1)]
