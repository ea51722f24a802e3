"""Operator 3, MinHash near-duplicates with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.common import broadcast_if_small, each, free, lower_words, materialise, release

#: Each of the two collections has SIDE small hashes of DEPTH minhashes; a table's key is a pair of
#: them, so SIDE * SIDE tables of 2 * DEPTH minhashes take 2 * SIDE * DEPTH minhashes in all.
SIDE, DEPTH = 12, 4
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, 2 * SIDE * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, 2 * SIDE * DEPTH, dtype=np.uint64)
_C = _RNG.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_HALF = np.uint64(32)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words count as one shingle."""
    ws = lower_words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = max(1, len(h) - width + 1)
    w = min(width, len(h))
    s = np.zeros(n, np.uint64)
    for j in range(w):
        s = (s ^ h[j : n + j]) * _C[j % 16]
        s ^= s >> np.uint64(29)
    return np.unique(s + np.uint64(w))


def small_hashes(s: np.ndarray) -> np.ndarray:
    """The 2 * SIDE hashes of DEPTH minhashes each; shingles go in blocks, so that long texts need little memory."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        x = s[None, at : at + 4096] * _A[:, None] + _B[:, None]
        x ^= x >> _HALF
        np.minimum(low, x.min(axis=1), out=low)
    low = low.reshape(2 * SIDE, DEPTH)
    out = np.zeros(2 * SIDE, np.uint64)
    for j in range(DEPTH):
        out = (out ^ low[:, j]) * _C[j]
        out ^= out >> _HALF
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """_id, n_shingles, a 128-bit digest of the set (g0, g1) and its small hashes, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            n, digests, small = [], [], []
            for text in each(b.column(1)):
                s = shingle_set(text, width, known)
                n.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes())
                digests.append(np.frombuffer(d, np.int64))
                small.append(small_hashes(s).view(np.int64) if len(s) else None)
            g = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(g[:, 0]), pa.array(g[:, 1]), pa.array(small, pa.list_(pa.int64()))], names=["_id", "n_shingles", "g0", "g1", "small"])

    src = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"))
    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, n_shingles long, g0 long, g1 long, small array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """rep and its full set as sorted 8-byte hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, width, known).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["rep", "set"])

    return docs.select("rep", "text").mapInArrow(run, f"rep {docs.schema['rep'].dataType.simpleString()}, set binary")


def components(links: DataFrame, tag: str = "neardup") -> DataFrame:
    """Connected components of (a, b) links: node and comp, its smallest node; only nodes with links.

    Large-star and small-star steps in turn, each an aggregate and a join, until
    nothing changes; every round is written to the shared folder, none is collected.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.where("u <> v").distinct(), f"{tag}-edges")
        release(before)
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not seen["n"]:
            break
        state = seen
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def confirm(members: DataFrame, sets: DataFrame, sizes: DataFrame, per_hundred: int, budget: int = 1_000_000) -> DataFrame:
    """Links (a, b) inside groups, confirmed on full sets.

    ``members`` has grp, rep, ask (compare this one with all others of its
    group), own (component it is known to be in).  A group is cut into blocks of
    about ``budget`` shingles; each block of asking members meets each block of
    members once, so that tasks stay bounded and no pair becomes a row.  Blocks
    give only links that join components not joined in the block before.
    """
    m = members.join(sizes, "rep")
    cuts = m.groupBy("grp").agg(F.ceil(F.sum("n_shingles") / budget).cast("int").alias("_nv"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("ask"), F.col("n_shingles"))) / budget)).cast("int").alias("_nu"))
    h = lambda n: F.pmod(F.xxhash64("rep", F.lit("block")), F.col(n)).cast("int")
    m = m.join(cuts, "grp").join(sets, "rep")
    asking = m.where("ask").select("grp", "rep", "own", "set", h("_nu").alias("bu"), F.explode(F.sequence(F.lit(0), F.col("_nv") - 1)).alias("bv"), F.lit(True).alias("asks"))
    others = m.select("grp", "rep", "own", "set", F.explode(F.sequence(F.lit(0), F.col("_nu") - 1)).alias("bu"), h("_nv").alias("bv"), F.lit(False).alias("asks"))
    kind = members.schema["rep"].dataType.simpleString()
    return asking.unionByName(others.select(*asking.columns)).groupBy("grp", "bu", "bv").applyInPandas(_block(per_hundred), f"a {kind}, b {kind}").distinct()


def _block(per_hundred: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asking = pdf[pdf["asks"]].sort_values("rep")
        others = pdf[~pdf["asks"]].sort_values("rep")
        found: list[tuple] = []
        if len(asking) and len(others):
            reps, own = others["rep"].tolist(), others["own"].tolist()
            sets = [np.frombuffer(s, np.uint64) for s in others["set"]]
            size = np.array([len(s) for s in sets])
            where = np.repeat(np.arange(len(sets)), size)
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            flat, where = flat[order], where[order]
            root: dict = {}

            def top(x):
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            for rep, mine, data in zip(asking["rep"], asking["own"], asking["set"], strict=True):
                s = np.frombuffer(data, np.uint64)
                lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = hi - lo
                at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                both = np.bincount(where[at], minlength=len(sets))
                hit = np.flatnonzero((100 * both >= per_hundred * (size + len(s) - both)) & (both > 0))
                for i in hit:
                    x, y = top(mine), top(own[i])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((rep, reps[i]))
        return pd.DataFrame(found, columns=["a", "b"]) if found else pd.DataFrame({"a": pdf["rep"][:0], "b": pdf["rep"][:0]})

    return run


def link(docs: DataFrame, width: int = 5, per_hundred: int = 80, block_shingles: int = 1_000_000) -> DataFrame:
    """Near-duplicate groups: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= per_hundred * union of
    their shingle sets; component_id is the smallest doc_id that can be reached.
    Candidates share a tensored table key: a small hash of collection A and one
    of collection B.  A pair at 0.8 shares none with a probability of about 0.4 %,
    at 0.85 of 0.03 %.  Every candidate in a bucket is compared with the bucket's hub,
    and what that leaves in another component than the hub, with all of the hub's
    component and with one another, in blocks on the full sets.  Equal sets are
    one class, found by digest, so copies cost one row each.  Null, empty and
    blank texts have no shingles and are linked with nothing; so is a null id.
    Ids may be of any type that has an order.  Different texts under one id are one
    node; an empty table gives no row; other columns play no part.
    """
    sig = materialise(signatures(docs, width), "neardup-sig")
    classes = materialise(sig.where("n_shingles > 0 AND _id IS NOT NULL").groupBy("n_shingles", "g0", "g1").agg(F.min("_id").alias("rep"), F.first("small").alias("small")), "neardup-class")

    # Small hashes that two classes share; only these can be part of a shared table key.
    small = classes.select("rep", F.posexplode("small").alias("at", "h"))
    shared = small.groupBy("at", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = small.join(shared, ["at", "h"]).groupBy("rep").agg(F.sum("n").alias("popular"), F.sort_array(F.collect_list(F.struct("at", "h"))).alias("hs"))
    hits = hits.where(F.exists("hs", lambda x: x["at"] < SIDE) & F.exists("hs", lambda x: x["at"] >= SIDE))
    side = lambda low: F.filter("hs", lambda x: (x["at"] < SIDE) == F.lit(low))
    keys = hits.select("rep", "popular", F.explode(side(True)).alias("x"), "hs").select("rep", "popular", "x", F.explode(side(False)).alias("y"))
    keys = materialise(keys.select("rep", "popular", F.xxhash64("x.at", "x.h", "y.at", "y.h").alias("key")), "neardup-keys")

    # One hub a bucket, its most popular member, and a star from it to the others.
    hub = keys.groupBy("key").agg(F.min(F.struct((-F.col("popular")).alias("p"), "rep")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("m.rep").alias("hub"))
    star = materialise(keys.join(hub, "key").where("rep <> hub").select("hub", "rep").distinct(), "neardup-star")
    needed = star.select("rep").unionByName(star.select(F.col("hub").alias("rep"))).distinct()
    sets = materialise(shingle_sets(_texts_of(docs, materialise(needed, "neardup-reps")), width).dropDuplicates(["rep"]), "neardup-sets")
    sizes = materialise(sets.select("rep", (F.octet_length("set") / 8).cast("long").alias("n_shingles")), "neardup-size")

    centre = star.select(F.col("hub").alias("grp"), F.col("hub").alias("rep"), F.lit(True).alias("ask")).distinct()
    rays = star.select(F.col("hub").alias("grp"), "rep", F.lit(False).alias("ask"))
    first = materialise(confirm(centre.unionByName(rays).withColumn("own", F.col("rep")), sets, sizes, per_hundred, block_shingles), "neardup-links")
    comp = materialise(components(first), "neardup-comp")

    # Candidates still apart from their hub's component meet all of it and each other.
    label = lambda df, c, name: df.join(comp.select(F.col("node").alias(c), F.col("comp").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    apart = label(label(star, "hub", "hc"), "rep", "rc").where("hc <> rc").select(F.col("hc").alias("grp"), "rep", F.col("rc").alias("own")).distinct()
    apart = materialise(apart, "neardup-apart")
    body = comp.select(F.col("comp").alias("grp"), F.col("node").alias("rep"), F.col("comp").alias("own"))
    alone = star.select(F.col("hub").alias("grp"), F.col("hub").alias("rep"), F.col("hub").alias("own")).distinct().join(comp.select(F.col("node").alias("rep")), "rep", "left_anti")
    open_groups = apart.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    # A hub without links and a single candidate: that pair has been compared.
    open_groups = open_groups.join(comp.select(F.col("comp").alias("grp"), F.lit(True).alias("big")).distinct(), "grp", "left").where("n > 1 OR big").select("grp")
    group = apart.select("grp", "rep", F.lit(True).alias("ask"), "own").unionByName(body.unionByName(alone.select("grp", "rep", "own")).select("grp", "rep", F.lit(False).alias("ask"), "own"))
    second = confirm(group.join(open_groups, "grp"), sets, sizes, per_hundred, block_shingles)
    links = materialise(first.unionByName(second), "neardup-links")
    comp = materialise(components(links), "neardup-comp")

    reps = classes.select("n_shingles", "g0", "g1", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("n_shingles", "g0", "g1", F.coalesce("comp", "rep").alias("comp"))
    out = sig.drop("small").join(reps, ["n_shingles", "g0", "g1"], "left")
    component = F.when(F.col("_id").isNull() | (F.col("n_shingles") == 0), F.col("_id")).otherwise(F.col("comp"))
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Texts of the chosen ids, given as a stored table."""
    src = docs.select(F.col("doc_id").alias("rep"), F.col("text").cast("string").alias("text")).where("rep IS NOT NULL")
    return src.join(broadcast_if_small(reps), "rep")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``link`` keeps, one of each group, with the columns of ``docs``.

    Rows of one id stay or go together; rows with a null id and texts without
    words stay; an empty table gives an empty one.
    """
    (gone_id,) = free(docs, "_gone")
    gone = materialise(link(docs, **options).where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct(), "neardup-gone")
    return docs.join(broadcast_if_small(gone), F.col("doc_id") == F.col(gone_id), "left_anti")
