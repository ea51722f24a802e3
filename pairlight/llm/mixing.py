"""Operator 6, mixing sources to target weights: balanced sampling by the cube method."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.llm.common import WORD, broadcast_if_small, free, materialise, own


def cube_flight(share: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase under two constraints: number of units and their sizes.

    Three undecided units at a time move along the null space of their
    constraints, the cross product of (1, 1, 1) and their sizes, until one of
    them is decided; both totals stay as they were.  Two units of equal size
    can go on in the end.  At most two stay undecided.
    """
    s = [float(x) for x in share]
    z = [float(x) for x in size]
    draws = iter(())
    eps = 1e-9
    hand: list[int] = []
    for k in range(len(s)):
        if s[k] <= eps or s[k] >= 1 - eps:
            continue
        hand.append(k)
        if len(hand) == 3 or (len(hand) == 2 and z[hand[0]] == z[hand[1]]):
            if len(hand) == 3:
                a, b, c = hand
                step = [z[c] - z[b], z[a] - z[c], z[b] - z[a]]
                if step == [0, 0, 0]:
                    step = [1.0, -1.0, 0.0]
            else:
                step = [1.0, -1.0]
            up = min(((1 - s[i]) / u if u > 0 else s[i] / -u) for i, u in zip(hand, step) if u)
            down = min((s[i] / u if u > 0 else (1 - s[i]) / -u) for i, u in zip(hand, step) if u)
            draw = next(draws, None)
            if draw is None:
                draws = iter(rng.random(4096).tolist())
                draw = next(draws)
            move = up if draw * (up + down) < down else -down
            for i, u in zip(hand, step):
                s[i] += move * u
                if s[i] < eps:
                    s[i] = 0.0
                elif s[i] > 1 - eps:
                    s[i] = 1.0
            hand = [i for i in hand if 0 < s[i] < 1]
    return np.array(s)


def landing(share: np.ndarray, size: np.ndarray, goal: float) -> np.ndarray:
    """The last few undecided units: the choice whose size comes nearest to ``goal``; ties take the fewest, then the first."""
    k = len(share)
    picks = np.array([[m >> i & 1 for i in range(k)] for m in range(1 << k)], float).reshape(1 << k, k)
    off = np.abs(picks @ size - goal)
    return picks[np.lexsort((np.arange(1 << k), picks.sum(1), off))[0]]


def held_back(share: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """A few undecided units of halving sizes that don't fly, so that the landing can come close to its goal."""
    free = np.flatnonzero((share > 0) & (share < 1))
    top = size[free].max() if len(free) else 0
    out: list[int] = []
    for j in range(most):
        rest = np.setdiff1d(free, out)
        if not len(rest):
            break
        out.append(int(rest[np.argmin(np.abs(size[rest] - top / 2 ** (j + 1)))]))
    return np.array(out, int)


def source_targets(sizes: DataFrame, source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3.0) -> DataFrame:
    """Target words of each source, from one row (source, source_size) a source.

    Sources in code-point order, null last, take the weights in turn.  They
    share the total by weight, but none above ``ceiling`` times its size; what
    exceeds is shared anew among the others until none is above.  That is one
    water level: sort by size over weight, fill the sources below the level to
    their ceiling and deal the rest by weight.  Only sources are sorted, never
    documents.  With a total of 0 all targets are 0.
    """
    n = len(weights)
    line = Window.orderBy(F.col(source_col).asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(line) - 1, F.lit(n)) + 1).cast("int"))
    t = sizes.withColumn("_w", w).withColumn("_top", F.col("source_size") * F.lit(float(ceiling)))
    below = Window.orderBy((F.col("_top") / F.col("_w")).asc(), F.col(source_col).asc_nulls_last())
    t = t.withColumn("_at", F.row_number().over(below))
    upto, every = below.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumns({
        "_total": F.sum("source_size").over(every),
        "_full": F.coalesce(F.sum("_top").over(upto), F.lit(0.0)),
        "_rest": F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)),
    })
    level = (F.col("_total") - F.col("_full")) / F.col("_rest")
    t = t.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_top"))
    # The first source that isn't filled fixes the level of it and all after it.
    level = F.min(F.when(F.col("_open"), F.struct("_at", "_level"))).over(every)["_level"]
    target = F.least(F.coalesce(level, F.lit(math.inf)) * F.col("_w"), F.col("_top"))
    return t.select(source_col, "source_size", F.when(F.col("_total") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def sized(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source and size: the number of words of the whole text, 0 for null."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *(c.alias(n) for n, c in (carry or {}).items()))


def balanced_copies(units: DataFrame, keys: list[str], order: list[str], share: str, size: str, block: int = 4096, seed: int = 0) -> DataFrame:
    """Draw 0/1 for every unit with probability ``share``, balanced over each group's number of units and total size.

    Units are dealt by hash into blocks of about ``block`` within their group;
    each block flies on its own and leaves two undecided and four held back.  The
    undecided of all blocks of a group are dealt again until they fit one block;
    there they land, at most 14 of them, as near as can be to what they were worth.  Every step is seeded by
    group, level and block and sorts its rows, so reruns agree whatever the
    partitions.  Returns the input with ``taken_once``.
    """
    name = F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys))
    mark = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in order]
    open_units = units.withColumns({"_g": name, "_h": F.xxhash64(F.lit(seed), *mark), "_s": F.col(share).cast("double")})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_units.schema.fields)
    decided: list[DataFrame] = []
    level = 0
    while True:
        # Sizes of groups by a partial count; small as it is, the table meets the rows where they are.
        counts = open_units.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
        counts = materialise(counts, "mix-groups")
        last = counts.where("_blocks > 1").limit(1).count() == 0
        dealt = open_units.join(broadcast_if_small(counts), "_g").withColumn("_b", F.pmod(F.xxhash64("_h", F.lit(level)), F.col("_blocks")).cast("int")).drop("_blocks")
        dealt = dealt.repartition("_g", "_b")  # by group alone, as a join may have left it, a hot group would be one task

        flown = materialise(dealt.groupBy("_g", "_b").applyInArrow(_flyer(order, size, seed, level, last), fields), "mix-flight")
        done = (F.col("_s") == 0) | (F.col("_s") == 1)
        decided.append(flown.where(done))
        if last:
            break
        open_units = flown.where(~done)
        level += 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.withColumn("taken_once", F.col("_s").cast("int")).drop("_g", "_h", "_s")


def _flyer(order: list[str], size: str, seed: int, level: int, last: bool):
    """The flight of one block, with the landing at the last level."""

    def fly(t: pa.Table) -> pa.Table:
        # Arrow columns only: pandas would turn a long id beside a null into a float.
        t = t.sort_by([(c, "ascending") for c in ("_h", *order)])
        rng = np.random.default_rng([seed, level, t.column("_g")[0].as_py() & 0xFFFFFFFF, t.column("_b")[0].as_py()])
        z = t.column(size).to_numpy().astype(float)
        s = t.column("_s").to_numpy().copy()
        back = held_back(s, z, 12 if last else 4)
        fly = np.setdiff1d(np.arange(len(s)), back)
        s[fly] = cube_flight(s[fly], z[fly], rng)
        left = np.flatnonzero((s > 0) & (s < 1))
        if last and len(left):
            s[left] = landing(s[left], z[left], float(s[left] @ z[left]))
        return t.set_column(t.schema.get_field_index("_s"), "_s", pa.array(s)).drop_columns(["_b"])

    return fly


def numbered(rows: DataFrame, same: str, name: str) -> DataFrame:
    """A stored table with the number of each row among those of an equal ``same``, from 0; equal rows are numbered a task's part at a time."""
    row, part, key, before = free(rows, "_row", "_part", "_key", "_before")
    own_part = materialise(rows.withColumn(row, F.monotonically_increasing_id()), "mix-parts").withColumn(part, F.shiftright(row, 33))
    sums = own_part.groupBy(same, part).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(same).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # A row a task and key; keys of one row are left out of the join.
    sums = sums.withColumns({before: F.coalesce(F.sum("n").over(upto), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(same))}).where("all > 1").select(F.col(same).alias(key), F.col(part).alias("p"), before)
    local = F.row_number().over(Window.partitionBy(same, part).orderBy(row)) - 1
    joined = own_part.withColumn(name, local).join(broadcast_if_small(materialise(sums, "mix-equals")), (F.col(same) == F.col(key)) & (F.col(part) == F.col("p")), "left")
    return joined.withColumn(name, F.col(name) + F.coalesce(F.col(before), F.lit(0))).drop(row, part, key, "p", before)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ceiling: float = 3.0, carry: dict[str, Column] | None = None, block: int = 4096) -> DataFrame:
    """How often the mix takes each document: doc_id, carried columns, source, size, source_size, target, copies, taken.

    A source's rate is its target over its size.  Each document is taken the
    whole part of the rate for sure, and once more by balanced sampling with
    the rest as its probability, so that the source's words come within about
    one document of its target and no document is taken more than ``ceiling``
    times.  Documents without words are taken once if their source's rate is at
    least 1 and drawn by it otherwise.  Null sources form one source; repeated
    ids are separate documents.  Where ids are null or repeat, documents are dealt and ordered by
    their text too, and equal ones by their number among their equals, so that they
    spread over all blocks and reruns agree.
    """
    extra = list(carry or {})
    same, copy = free(docs.select("doc_id", "source", *(c.alias(n) for n, c in (carry or {}).items())), "_same", "_copy")
    base = materialise(sized(docs, {**(carry or {}), same: F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "source", "text")))}), "mix-sizes")
    ids = base.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    apart = [same, copy] if ids["rows"] != ids["ids"] else []
    base = materialise(numbered(base, same, copy), "mix-numbered") if apart else base
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = broadcast_if_small(materialise(source_targets(sizes, "source", weights, ceiling).withColumnRenamed("source", "_src"), "mix-targets"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    near = F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate)
    units = base.join(targets, F.col("source").eqNullSafe(F.col("_src"))).drop("_src").withColumn("_rate", near).withColumns({"_sure": F.floor("_rate").cast("int"), "_part": F.col("_rate") - F.floor("_rate")})
    drawn = balanced_copies(units, ["source"], ["doc_id", "size", *extra, *apart], "_part", "size", block)
    return drawn.withColumn("copies", F.least(F.col("_sure") + F.col("taken_once"), F.lit(int(ceiling)))).withColumn("taken", F.col("copies") * F.col("size")).drop("_rate", "_sure", "_part", "taken_once", same, copy)


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: every document repeated as often as the mix takes it, with the columns of ``docs``.

    Decisions come back by doc_id where ids are unique.  Where they repeat or
    are null, rows are numbered first and written once, so that a task that runs
    again sees the same numbers.  Null and empty texts are documents of no
    words; an empty table gives an empty table; further columns may have any name.
    """
    row, copies, copy = free(docs, "_row", "_copies", "_copy")
    names = docs.columns
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        kept = mix(docs, **options).where("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(copies))
        joined = docs.join(kept, own(docs, "doc_id") == F.col(row))
    else:
        docs = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
        kept = mix(docs, carry={row: F.col(row)}, **options).where("copies > 0").select(row, F.col("copies").alias(copies))
        joined = docs.join(kept, row)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(own(docs, c) for c in names))
