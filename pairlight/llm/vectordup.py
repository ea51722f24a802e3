"""Operator 12, embedding near-duplicates: a subspace pigeonhole join over rotated vectors, confirmed by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.common import broadcast_if_small, materialise
from pairlight.llm.neardup import components
from pairlight.llm.walsh import transform

#: Rotated coordinates become integers of this scale: sums of squares of a whole vector stay exact as doubles.
SCALE = float(1 << 25)
BLOCKS, MOST_SPLITS, SEED = 4, 16, 12


@dataclass(frozen=True)
class Layout:
    """How vectors of one length are split: padded length, blocks, and the squared distance that a block may have."""

    padded: int
    blocks: int
    width: int
    budget: float

    @staticmethod
    def of(length: int, cosine: float) -> Layout:
        padded = 1 << max(0, (length - 1).bit_length())
        blocks = min(BLOCKS, padded)
        width = padded // blocks
        # Unit vectors of that cosine are 2 - 2 * cosine apart, squared; some block has no more than its share of it.
        share = math.sqrt((2 - 2 * cosine + 1e-9) * width / padded)
        return Layout(padded, blocks, width, math.floor((SCALE * share * (1 + 1e-9) + math.sqrt(width) + 1) ** 2))


def coordinates(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors scaled by a power of two, as unit vectors, and the rotation of these as whole numbers.

    The rotation is two rounds of random signs and a Walsh-Hadamard transform.
    Each row is worked out by the same operations whatever rows stand beside
    it, so that every task has the same whole numbers of a vector.
    """
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # exact, and no square overflows
    square = np.zeros(len(x))
    for j in range(x.shape[1]):
        square += x[:, j] * x[:, j]
    unit = x / np.sqrt(square)[:, None]
    padded = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), padded))
    y[:, : x.shape[1]] = unit
    rng = np.random.default_rng([SEED, padded])
    for _ in range(2):
        y = transform(y * rng.choice([-1.0, 1.0], padded)) / math.sqrt(padded)
    return x, unit, np.rint(y * SCALE)


def cosine_of(x: np.ndarray, y: np.ndarray) -> float:
    """Of sums that are rounded once, so that neither the order of the two nor that of the components matters."""
    dot, one, two = (math.fsum((a * b).tolist()) for a, b in ((x, y), (x, x), (y, y)))
    return dot / math.sqrt(one * two)


def _matrix(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _by_length(b: pa.RecordBatch, rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch that hold vectors of one length."""
    lengths = b.column("dim").to_numpy()
    for n in np.unique(lengths).tolist():
        mine = b.filter(pa.array(lengths == n))
        for lo in range(0, len(mine), rows):
            yield n, mine.slice(lo, rows)


def _centre_sums(cosine: float):
    """Sums of the coordinates that cells may be split by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for b in batches:
            for n, part in _by_length(b, 2000):
                lay = Layout.of(n, cosine)
                *_, q = coordinates(_matrix(part.column("x"), n))
                s = q.reshape(len(part), lay.blocks, lay.width)[:, :, :MOST_SPLITS].sum(0).ravel()
                sums[n] = sums.get(n, 0) + s
                counts[n] = counts.get(n, 0) + len(part)
        at = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([counts[n] for n in at], pa.int64()), pa.array([sums[n].tolist() for n in at], pa.list_(pa.float64()))], names=["dim", "n", "s"])

    return run


def splits(vectors: DataFrame, cosine: float, per_cell: int, lengths: int = 256) -> dict[int, np.ndarray]:
    """For the most frequent lengths: the planes that cut each block, as many as bring its cells to about ``per_cell`` vectors.

    The planes stand at the means of the first coordinates of a block.  Rarer
    lengths go without planes, which is as exact.
    """
    task = vectors.mapInArrow(_centre_sums(cosine), "dim int, n long, s array<double>")
    # Every row of a task repeats its count at each place, so counts are summed at place 0 only.
    rows = task.select("dim", "n", F.posexplode("s").alias("at", "x")).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    often = rows.where("at = 0").orderBy(F.col("n").desc(), "dim").limit(lengths).select("dim")
    out: dict[int, np.ndarray] = {}
    found = rows.join(F.broadcast(often), "dim").collect()
    for length in {r["dim"] for r in found}:
        mine = {r["at"]: r for r in found if r["dim"] == length}
        lay = Layout.of(length, cosine)
        n = mine[0]["n"]
        planes = max(0, min(lay.width, MOST_SPLITS, math.ceil(math.log2(max(1, n / per_cell)))))
        means = np.rint([mine[i]["x"] / n for i in range(len(mine))]).reshape(lay.blocks, -1)
        out[length] = means[:, :planes]
    return out


def touched(q: np.ndarray, planes: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of one block: each vector's own, and (vector, cell) for all higher ones within the budget.

    A cell is told by the side of each plane.  To reach another cell, a vector
    must cross the planes in which they differ; their squared distances add
    up.  Of two vectors within the budget in different cells both reach the
    other's, so the one of the lower cell calls on the higher.
    """
    n, m = q.shape[0], len(planes)
    y = q[:, :m] - planes
    own = ((y >= 0) << np.arange(m)).sum(1).astype(np.int64) if m else np.zeros(n, np.int64)
    if not m:
        return own, np.zeros(0, np.int64), np.zeros(0, np.int64)
    crossings = np.array([[s >> j & 1 for j in range(m)] for s in range(1 << m)], float)
    who, where = [], []
    step = max(1, (1 << 22) >> m)
    for lo in range(0, n, step):
        cost = (y[lo : lo + step] ** 2) @ crossings.T
        i, s = np.nonzero(cost <= budget)
        cell = own[lo + i] ^ s
        higher = cell > own[lo + i]
        who.append((lo + i)[higher])
        where.append(cell[higher])
    return own, np.concatenate(who), np.concatenate(where)


def _cells(cosine: float, planes: dict[int, np.ndarray], counts_only: bool):
    """Every vector in its own cell of each block and in those it calls on; or only their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, part in _by_length(b, 500):
                lay = Layout.of(length, cosine)
                *_, q = coordinates(_matrix(part.column("x"), length))
                q = q.reshape(len(part), lay.blocks, lay.width)
                for k in range(lay.blocks):
                    cuts = planes[length][k] if length in planes else np.zeros(0)
                    own, who, where = touched(q[:, k], cuts, lay.budget)
                    cell = np.concatenate([own, where])
                    owner = np.arange(len(cell)) < len(own)
                    if counts_only:
                        kinds, n = np.unique(cell * 2 + owner, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), length, np.int32)), pa.array(np.full(len(n), k, np.int32)), pa.array(kinds >> 1), pa.array(n * (kinds & 1)), pa.array(n)], names=["dim", "block", "cell", "owners", "all"])
                    else:
                        rows = part.take(pa.array(np.concatenate([np.arange(len(own)), who])))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), length, np.int32)), pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(owner), rows.column("nid"), rows.column("copies"), rows.column("x")], names=["dim", "block", "cell", "owner", "nid", "copies", "x"])

    return run


def _tile(cosine: float):
    """Links of a tile: for each vector the number of rows it is linked with here, and a forest of the links.

    A pair counts in the first block in which it is within the budget, which
    the whole-number coordinates of both tell, so nowhere twice.
    """

    def run(t: pa.Table) -> pa.Table:
        length, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        lay = Layout.of(length, cosine)
        left, right = t.filter(t.column("left")), t.filter(pc.invert(t.column("left")))
        a: list[np.ndarray] = [np.zeros(0, np.int64)]
        b: list[np.ndarray] = [np.zeros(0, np.int64)]
        n: list[np.ndarray] = [np.zeros(0, np.int64)]
        if len(left) and len(right):
            xl, ul, ql = coordinates(_matrix(left.column("x"), length))
            xr, ur, qr = coordinates(_matrix(right.column("x"), length))
            nl, nr = left.column("nid").to_numpy(), right.column("nid").to_numpy()
            ml, mr = left.column("copies").to_numpy().astype(float), right.column("copies").to_numpy().astype(float)
            beside = right.column("owner").to_numpy()  # in the cell itself: each pair only once
            ql, qr = (q.reshape(len(q), lay.blocks, lay.width) for q in (ql, qr))
            screen = [(q[:, block] / SCALE).astype(np.float32) for q in (ql, qr)]
            half = [((s.astype(np.float64) ** 2).sum(1) / 2).astype(np.float32)[:, None] for s in screen]
            one = [np.ones_like(h) for h in half]
            sl = np.concatenate([screen[0], one[0], -half[0]], axis=1)
            sr = np.concatenate([screen[1], np.float32(lay.budget / SCALE**2 / 2) - half[1], one[1]], axis=1)
            cl, cr = np.zeros(len(nl)), np.zeros(len(nr))
            ids, at = np.unique(np.concatenate([nl, nr]), return_inverse=True)
            il, ir, label = at[: len(nl)], at[len(nl) :], np.arange(len(ids))
            edges: list[tuple[int, int]] = []
            for lo in range(0, len(nl), 256):
                near = sl[lo : lo + 256] @ sr.T >= -4e-6
                rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                if not len(rows):
                    continue
                rows += lo
                link = ~(beside[cols][None] & (nl[rows][:, None] >= nr[cols][None]))
                link &= _within(ql[rows, block], qr[cols, block], lay.budget)
                dot = ul[rows] @ ur[cols].T
                link &= dot >= cosine - 1e-12
                doubt = np.argwhere(link & (dot < cosine + 1e-12))
                for i, j in doubt.tolist():
                    link[i, j] = cosine_of(xl[rows[i]], xr[cols[j]]) >= cosine
                for k in range(block):
                    if not link.any():
                        break
                    link &= ~_within(ql[rows, k], qr[cols, k], lay.budget)
                cl[rows] += link @ mr[cols]
                cr[cols] += link.T @ ml[rows]
                for i in np.flatnonzero(link.any(1)):
                    hit = ir[cols[link[i]]]
                    mine = label[il[rows[i]]]
                    apart = hit[label[hit] != mine]
                    if len(apart):
                        roots, first = np.unique(label[apart], return_index=True)
                        edges += [(ids[il[rows[i]]], ids[apart[f]]) for f in first]
                        label[np.isin(label, roots)] = mine
            for who, count in ((nl, cl), (nr, cr)):
                some = count > 0
                a.append(who[some])
                b.append(np.full(some.sum(), -1))
                n.append(count[some].astype(np.int64))
            if edges:
                e = np.array(edges, np.int64)
                a.append(e[:, 0])
                b.append(e[:, 1])
                n.append(np.zeros(len(e), np.int64))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(n)})

    return run


def _within(p: np.ndarray, q: np.ndarray, budget: float) -> np.ndarray:
    """Whether whole-number vectors are within a squared distance: exact, as all sums stay below 2**53."""
    return (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * (p @ q.T) <= budget


def link(embeddings: DataFrame, cosine: float = 0.95, per_cell: int = 8192, tile: int = 16384) -> DataFrame:
    """Near-duplicate vectors: vec_id, n_links, component_id, kept.

    Vectors are linked if their cosine in double precision is at least
    ``cosine``.  Two such unit vectors, rotated and cut into four blocks, are within a
    quarter of their squared distance in one block at least.  So each
    block is range-joined on its own: its space is cut into cells by planes, every vector
    stands in its own cell and in those within reach, and a cell's vectors are
    compared in tiles of at most about ``tile`` by ``tile``, however many a
    cell holds.  What is within a block's budget is confirmed on the whole vectors.
    Equal vectors are one node, so copies cost one row each; pairs never become rows: a
    tile gives numbers of links and a forest of them.

    Null vectors, zero vectors and those with null, NaN or infinite components
    are linked with nothing; so are rows of a null id, whose component is null.
    Vectors of different lengths aren't linked.  Rows of a repeated id are each
    a vector of its own, and their links count as rows.  An empty table gives no row; other columns play no part.
    """
    x = F.col("embedding")
    kind = embeddings.schema["embedding"].dataType.simpleString()
    wide = x.cast("array<double>")
    usable = F.col("vec_id").isNotNull() & F.forall(wide, lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False))) & F.exists(wide, lambda c: c != 0)
    rows = embeddings.select("vec_id", F.when(F.coalesce(usable, F.lit(False)), x).alias("x"))
    rows = rows.select("vec_id", F.when(F.col("x").isNotNull(), F.xxhash64("x")).alias("g0"), F.when(F.col("x").isNotNull(), F.xxhash64(F.lit("second"), "x")).alias("g1"), "x")
    classes = rows.where("x IS NOT NULL").groupBy("g0", "g1").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("x").alias("x"))
    # Numbers of nodes hold from here on, because they are written.
    nodes = materialise(classes.select(F.monotonically_increasing_id().alias("nid"), "*", F.size("x").alias("dim")), "vectors-nodes")
    vectors = nodes.select("nid", "copies", "dim", "x")

    planes = splits(vectors, cosine, per_cell)
    numbers = vectors.mapInArrow(_cells(cosine, planes, True), "dim int, block int, cell long, owners long, all long")
    cells = numbers.groupBy("dim", "block", "cell").agg(F.sum("owners").alias("owners"), F.sum("all").alias("all")).where("owners > 0 AND all > 1")
    cells = materialise(cells.select("dim", "block", "cell", F.ceil(F.col("owners") / tile).cast("int").alias("n_left"), F.ceil(F.col("all") / tile).cast("int").alias("n_right")), "vectors-cells")
    placed = vectors.mapInArrow(_cells(cosine, planes, False), f"dim int, block int, cell long, owner boolean, nid long, copies long, x {kind}").join(broadcast_if_small(cells), ["dim", "block", "cell"])
    deal = lambda n: F.pmod(F.xxhash64("nid", F.lit("tile")), F.col(n)).cast("int")
    spot = lambda is_left, i, j: F.struct(F.lit(is_left).alias("left"), i.alias("i"), j.alias("j"))
    as_left = F.when(F.col("owner"), F.transform(F.sequence(F.lit(0), F.col("n_right") - 1), lambda j: spot(True, deal("n_left"), j))).otherwise(F.array().cast("array<struct<left:boolean,i:int,j:int>>"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("n_left") - 1), lambda i: spot(False, i, deal("n_right")))
    dealt = placed.select("dim", "block", "cell", "owner", "nid", "copies", "x", F.inline(F.concat(as_left, as_right)))
    found = materialise(dealt.groupBy("dim", "block", "cell", "i", "j").applyInArrow(_tile(cosine), "a long, b long, n long"), "vectors-links")

    counts = found.where("b < 0").groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("others"))
    comp = materialise(components(found.where("b >= 0").select("a", "b"), "vectors"), "vectors-comp")
    base = nodes.select("nid", "g0", "g1", "rep", "copies")
    label = base.join(comp.withColumnRenamed("node", "nid"), "nid").select("comp", "rep").groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = base.join(counts, "nid", "left").where("copies > 1 OR others IS NOT NULL").join(comp.withColumnRenamed("node", "nid"), "nid", "left").join(label, "comp", "left")
    known = materialise(known.select("g0", "g1", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component_id", "rep").alias("c")), "vectors-known")
    out = rows.select("vec_id", "g0", "g1").join(broadcast_if_small(known), ["g0", "g1"], "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
