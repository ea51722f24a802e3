import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlight.llm import mixing, packing
from pairlight.llm.common import words


def slow_best_fit(sizes, sources, clusters, capacity):
    bins = []
    out = []
    for z, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= z and s not in b["s"] and c not in b["c"]]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"room": capacity, "s": set(), "c": set()})
            i = len(bins) - 1
        b = bins[i]
        out.append((i, capacity - b["room"]))
        b["room"] -= z
        b["s"].add(s)
        b["c"].add(c)
    return out


def test_best_fit_equals_a_plain_search():
    rng = random.Random(1)
    for _ in range(30):
        n = rng.randrange(80)
        items = sorted(((rng.randrange(1, 50), rng.randrange(6), rng.randrange(9)) for _ in range(n)), reverse=True)
        z, s, c = ([x[i] for x in items] for i in range(3))
        assert list(zip(*packing.best_fit(z, s, c, 50), strict=True)) == slow_best_fit(z, s, c, 50)


def docs(spark, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 30, 130]))), rng.choice(["a", "a", "a", "b", "c", "ß", None])) for i in range(300)]
    rows += [(300, None, "a"), (301, "same text here", "b"), (302, "same text here", "c"), (301, "same text here", "b")]
    return rows, spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int")


def test_pack_holds_every_word_once(spark):
    rows, df = docs(spark)
    got = packing.pack(df, capacity=50, shard=64).collect()
    assert sum(r.size for r in got) == sum(len(words(t)) for _, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.bin, []).append(r)
    for b in by.values():
        assert sum(r.size for r in b) <= 50 and len({r.source for r in b}) == len(b)
        spans = sorted((r.offset, r.offset + r.size) for r in b)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    same = [r.bin for r in got if r.doc_id in (301, 302)]
    assert len(set(same)) == len(same) == 3
    assert {(r.doc_id, r.piece): r.bin for r in packing.pack(df.repartition(5), 50, 64).collect()}.keys() == {(r.doc_id, r.piece) for r in got}
    assert packing.pack(df.limit(0)).count() == 0


def water(sizes, weights=(5, 2, 1), top=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target = {s: total * w[s] / sum(w.values()) for s in names}
    full = set()
    while True:
        over = {s for s in names if s not in full and target[s] > top * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over
        rest = total - sum(top * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: top * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in open_) for s in names}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([1, 10, 1000, 5000, 0]) for s in ["a", "B", "é", "\U00010400", "￿", None, "zz"]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = water(sizes)
    assert got == pytest.approx(want)


def test_cube_keeps_both_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 400).astype(float)
    s = mixing.cube_flight(np.full(400, 0.37), size, np.random.default_rng(1))
    left = (s > 0) & (s < 1)
    assert left.sum() <= 2
    assert s.sum() == pytest.approx(0.37 * 400) and s @ size == pytest.approx(0.37 * size.sum())


def test_cube_keeps_probabilities():
    size = np.array([5.0, 9, 2, 7, 7, 30, 1, 12])
    runs = np.mean([mixing.cube_flight(np.full(8, 0.4), size, np.random.default_rng(i)) for i in range(3000)], axis=0)
    assert np.abs(runs - 0.4).max() < 0.05


def test_mix(spark):
    rows, df = docs(spark)
    got = mixing.mix(df, block=40).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    by = {}
    for r in got:
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        by.setdefault(r.source, []).append(r)
    want = water({s: sum(r.size for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert v[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in v) - want[s]) <= 30
    again = {(r.doc_id, r.size): r.copies for r in mixing.mix(df.repartition(7, F.rand()), block=40).collect()}
    assert again == {(r.doc_id, r.size): r.copies for r in got}
    for some in (df, df.where("doc_id < 300")):
        mixed = mixing.take(some, block=40)
        assert mixed.columns == some.columns
        base = water({r.source: r.n for r in mixing.sized(some).groupBy("source").agg(F.sum("size").alias("n")).collect()})
        assert all(abs(r.n - base[r.source]) <= 30 for r in mixing.sized(mixed).groupBy("source").agg(F.sum("size").alias("n")).collect())
    assert mixing.mix(df.limit(0)).count() == 0


BIG = [2**60 + 1, 2**60 + 3, None, 2**53 + 1, None]


def test_large_ids_beside_nulls(spark):
    df = spark.createDataFrame([(i, "some words here " * (k + 1), "a", 1, 2, "x") for k, i in enumerate(BIG)], "doc_id long, text string, source string, _g int, _row int, `odd.name` string")
    assert sorted((r.doc_id for r in packing.pack(df).collect()), key=str) == sorted(BIG, key=str)
    assert sorted((r.doc_id for r in mixing.mix(df).collect()), key=str) == sorted(BIG, key=str)
    mixed = mixing.take(df)
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} <= set(BIG)


def test_null_clusters_conflict_with_nothing(spark):
    df = spark.createDataFrame([(1, "a b", "x", None), (2, "c d", "y", None), (3, "e f", "z", "k"), (4, "g h", "w", "k")], "doc_id long, text string, source string, cluster string")
    bins = {r.doc_id: r.bin for r in packing.pack(df, capacity=6).collect()}
    assert bins[1] == bins[2] and bins[3] != bins[4]


def test_landing_is_the_best_choice():
    rng = np.random.default_rng(5)
    for _ in range(40):
        size = rng.integers(0, 60, 6).astype(float)
        goal = float(rng.random(6) @ size)
        best = min(abs(sum(z for i, z in enumerate(size) if m >> i & 1) - goal) for m in range(64))
        assert abs(mixing.landing(np.full(6, 0.5), size, goal) @ size - goal) == pytest.approx(best)


def test_rows_of_one_id_spread(spark):
    n = 50_000
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("some words"), (F.col("id") % 7).cast("string")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 500).cast("string")).alias("source"))
    for ids in (df, df.withColumn("doc_id", F.lit(5).cast("long"))):
        shards = packing.pack(ids, capacity=50, shard=4096).groupBy(F.shiftright("bin", 32).alias("shard")).count().collect()
        assert len(shards) == 13 and max(r["count"] for r in shards) < 6000
        one = ids.withColumn("source", F.lit("a")).withColumn("text", F.when(F.rand(3) < 0.5, F.col("text")).otherwise(F.lit("equal words")))
        base = mixing.sized(one, {"same": F.xxhash64("text")})
        marks = mixing.numbered(base, "same", "copy")
        assert marks.select("same", "copy").distinct().count() == n
        assert all(r.low == 0 and r.top == r.n - 1 for r in marks.groupBy("same").agg(F.min("copy").alias("low"), F.max("copy").alias("top"), F.count(F.lit(1)).alias("n")).collect())


def test_mixing_null_ids_agrees_again(spark):
    df = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 40).cast("int")).alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    count = lambda d: sorted((r.source, r.size, r.copies) for r in mixing.mix(d, block=500).collect())
    one = count(df)
    assert one == count(df.repartition(9, F.rand(1)))
    want = water({s: sum(z for x, z, _ in one if x == s) for s in {x for x, _, _ in one}})
    assert all(abs(sum(z * c for x, z, c in one if x == s) - t) <= 80 for s, t in want.items())
