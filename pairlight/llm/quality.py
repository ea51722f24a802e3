"""Operator 4, quality rules: counted base rules, then robust outliers by minimum covariance determinant."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.llm.common import broadcast_if_small, free, lowest, materialise, words

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(b for b in range(256) if b not in _SYMBOLS)
#: Bytes of UTF-8 inside a code point; the others are as many as the code points.
_INNER = bytes(range(0x80, 0xC0))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], np.uint64)
#: Words in a window of the repetition rule.
WINDOW = 5
#: Parts of one for the stored statistics, which are whole numbers so that sums don't depend on the order of rows.
GRAIN = 256
STATS = ("s_length", "s_word", "s_symbol", "s_lines", "s_repeat", "s_distinct")


def _chi2_quantile(p: int, share: float) -> float:
    """Wilson and Hilferty's approximation of the chi-squared quantile."""
    z = NormalDist().inv_cdf(share)
    return p * (1 - 2 / (9 * p) + z * (2 / (9 * p)) ** 0.5) ** 3


#: Squared distance beyond which a text is rejected: eight times the 0.999 quantile of normal rows, about 180, since
#: statistics of texts have long tails.  The eight was chosen on labelled rows of the training folds of one table.
CUTOFF = 8 * _chi2_quantile(len(STATS), 0.999)


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, distinct words of one whole text."""
    ws = words(text)
    if not ws:
        return 0, 0, len((text or "").encode("utf-8", "surrogatepass").translate(None, _NOT_SYMBOL)), 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    chars = len(b"".join(ws).translate(None, _INNER))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.uint64, len(ws))
    repeats = 0
    if len(ids) > WINDOW and len(number) < len(ids):
        # A window's key: exact while the distinct words fit 12 bits each, else mixed to 64 bits.
        n = len(ids) - WINDOW + 1
        key = np.zeros(n, np.uint64)
        if len(number) < 4096:
            for j in range(WINDOW):
                key = key << np.uint64(12) | ids[j : n + j]
        else:
            for j in range(WINDOW):
                key = (key ^ ids[j : n + j] * _MIX[j]) * _MIX[0]
                key ^= key >> np.uint64(29)
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = times[where] > 1
        if twice.any():
            edge = np.zeros(len(ids) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            repeats = int((edge.cumsum()[:-1] > 0).sum())
    return len(ws), chars, len(data.translate(None, _NOT_SYMBOL)), len(lines) - len(set(lines)), repeats, len(number)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Counts of every whole text, batch by batch, with the carried columns; a null text has none of anything."""
    carry = carry or {}
    src = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col), *(c.alias(n) for n, c in carry.items()))
    kept = [f for f in src.schema.fields if f.name != "_text"]
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct"]
    names = [*(f.name for f in kept), *cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.array([text_counts(t) for t in b.column(0).to_pylist()], np.int64).reshape(-1, len(cols))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c) for c in counts.T)], names=names)

    return src.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} long" for c in cols)]))


def _statistics() -> dict[str, Column]:
    """Transformed statistics of a text with words, as whole numbers of 1/GRAIN."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    logit = lambda share: F.log((share + 0.01) / (1.01 - share))
    raw = {
        "s_length": F.log1p(F.col("n_words")),
        "s_word": F.log1p(F.col("word_chars") / n) * 4,
        "s_symbol": F.log1p(F.col("n_symbols") / n * 20),
        "s_lines": F.log1p(F.col("n_dup_lines")) / 8,  # mostly 0, so kept small beside the ridge
        "s_repeat": F.col("n_repeat_words") / n * 2,
        "s_distinct": logit(F.col("n_distinct") / n) + F.log1p(F.col("n_words")) * 0.5,
    }
    return {k: F.round(v * GRAIN).cast("long") for k, v in raw.items()}


def _cells(rows: DataFrame) -> DataFrame:
    """Count, sums and products of the rows of each (g, s, b); whole numbers, so that their order doesn't matter."""
    p = len(STATS)
    return rows.groupBy("g", "s", "b").agg(F.count(F.lit(1)).alias("m_n"), *(F.sum(s).alias(f"m_{i}") for i, s in enumerate(STATS)), *(F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"m_{i}_{j}") for i in range(p) for j in range(i, p)))


def _shapes(moments: DataFrame, ridge: float) -> DataFrame:
    """Centre, covariance, its inverse and log determinant of each (g, s); one small row each, in parallel over rows."""
    p = len(STATS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n = f["m_n"].to_numpy(float)[:, None]
            mean = np.stack([f[f"m_{i}"].to_numpy(float) for i in range(p)], axis=1) / n
            cov = np.zeros((len(f), p, p))
            for i in range(p):
                for j in range(i, p):
                    cov[:, i, j] = cov[:, j, i] = f[f"m_{i}_{j}"].to_numpy(float) / n[:, 0] - mean[:, i] * mean[:, j]
            cov += np.eye(p) * (ridge * GRAIN) ** 2
            yield _shape_rows(f[["g", "s"]].assign(total=f["total"].astype("int64"), edge=f["edge"].astype("int64")), mean, cov)

    return moments.mapInPandas(run, _SHAPE)


_SHAPE = "g string, s int, total long, edge long, g_mean array<double>, g_cov array<double>, g_inv array<double>, logdet double"


def _shape_rows(frame: pd.DataFrame, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    inv = np.linalg.inv(cov) if len(frame) else cov
    logdet = np.linalg.slogdet(cov)[1] if len(frame) else np.zeros(0)
    return frame.assign(g_mean=list(mean), g_cov=list(cov.reshape(len(frame), -1)), g_inv=list(inv.reshape(len(frame), -1)), logdet=logdet)


def first_shapes(x: np.ndarray, share: float, ridge: float, starts: int, seed: int = 0, tries: int = 40) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best few of many starts on a bounded set of rows: (log determinant, centre, covariance), lowest first.

    Starts are all rows, medians with median deviations, and ``tries`` random
    sets of one row more than there are statistics.  Each takes two concentration
    steps; the ten of lowest determinant go on until it stops falling.
    """
    n, p = x.shape
    h = max(1, int(np.ceil(share * n)))
    floor = np.eye(p) * ridge**2

    def of(rows: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        centre = rows.mean(0)
        cov = (rows - centre).T @ (rows - centre) / len(rows) + floor
        return float(np.linalg.slogdet(cov)[1]), centre, cov

    def step(shape: tuple) -> tuple:
        d = x - shape[1]
        return of(x[np.argsort(np.einsum("ij,ij->i", d @ np.linalg.inv(shape[2]), d), kind="stable")[:h]])

    rng = np.random.default_rng(seed)
    middle = np.median(x, axis=0)
    spread = np.diag((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2) + floor
    found = [of(x), (0.0, middle, spread), *(of(x[rng.choice(n, min(n, p + 1), replace=False)]) for _ in range(tries))]
    found = sorted((step(step(f)) for f in found), key=lambda f: f[0])[:10]
    for k, f in enumerate(found):
        for _ in range(30):
            nxt = step(f)
            if nxt[0] >= f[0] - 1e-9:
                break
            f = nxt
        found[k] = f
    out: list[tuple] = []
    for f in sorted(found, key=lambda f: f[0]):
        if len(out) < starts and all(abs(f[0] - o[0]) > 1e-6 for o in out):
            out.append(f)
    return out


def _starts(pool: DataFrame, share: float, ridge: float, starts: int, subset: int) -> DataFrame:
    """First shapes of each group, from its ``subset`` rows of lowest hash."""
    hashed = pool.withColumn("h", F.xxhash64(*STATS))
    few = materialise(lowest(hashed, "g", "h", subset), "quality-few")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(list(STATS))[list(STATS)].to_numpy(float)
        found = first_shapes(x, share, ridge * GRAIN, starts)
        frame = pd.DataFrame({"g": [pdf["g"].iloc[0]] * len(found), "s": np.arange(len(found), dtype=np.int32), "total": 0, "edge": 0})
        return _shape_rows(frame, np.stack([f[1] for f in found]), np.stack([f[2] for f in found]))

    return hashed.join(broadcast_if_small(few), ["g", "h"]).drop("h").groupBy("g").applyInPandas(run, _SHAPE)


def _distance() -> Column:
    """Squared Mahalanobis distance to the joined centre, unrolled so that it stays in generated code."""
    p = len(STATS)
    d = [F.col(s) - F.col("g_mean")[i] for i, s in enumerate(STATS)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col("g_inv")[i * p + j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _concentrate(pool: DataFrame, shape: DataFrame, share: float, ridge: float) -> DataFrame:
    """One step on all rows: the shapes of each group's ``share`` of nearest rows, with the edge, the share's last bin.

    Rows are added up by bins of the log distance (1/16 octave), some hundred a
    group; the bins up to the share make the next shape.  So a step is one
    aggregation, whatever the size of a group, and no row is shuffled or sorted.
    """
    near = pool.join(broadcast_if_small(shape.select("g", "s", "g_mean", "g_inv")), "g")
    cells = _cells(near.withColumn("b", F.floor(F.log2(_distance() + 1e-6) * 16)))
    by = Window.partitionBy("g", "s")
    cells = cells.withColumn("total", F.sum("m_n").over(by)).withColumn("before", F.sum("m_n").over(by.orderBy("b")) - F.col("m_n"))
    kept = cells.where(F.col("before") < share * F.col("total"))
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in cells.columns if c.startswith("m_")]
    return _shapes(kept.groupBy("g", "s").agg(*sums, F.max("total").alias("total"), F.max("b").alias("edge")), ridge)


def _lowest_determinant(*shapes: DataFrame, by: list[str]) -> DataFrame:
    both = shapes[0]
    for other in shapes[1:]:
        both = both.unionByName(other)
    row = F.struct(*both.columns)
    return both.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min_by(row, F.struct("logdet", "s")).alias("r")).select("r.*")


def group_shapes(pool: DataFrame, share: float = 0.75, starts: int = 3, subset: int = 600, steps: int = 8, ridge: float = 0.15) -> DataFrame:
    """Minimum covariance determinant of each group ``g`` of statistic vectors.

    The first shapes come from a bounded set of each group's rows; two steps on all
    rows part the better starts from the worse, and the one of lowest determinant
    goes on, on all rows, until no group's determinant falls or ``steps`` are
    done.  A step that doesn't lower a determinant is not taken.  The covariance
    is scaled so that the share's edge lies where it does for normal rows; it is
    never made smaller by that.
    """
    shape = materialise(_starts(pool, share, ridge, starts, subset), "quality-shape")
    shape = materialise(_concentrate(pool, shape, share, ridge), "quality-shape")
    shape = materialise(_lowest_determinant(_concentrate(pool, shape, share, ridge), by=["g"]), "quality-shape")
    last = None
    for _ in range(steps):
        total = shape.agg(F.sum(F.round("logdet", 3)).alias("t")).first()["t"]
        if total == last:
            break
        last = total
        shape = materialise(_lowest_determinant(shape, _concentrate(pool, shape, share, ridge), by=["g"]), "quality-shape")
    edges = materialise(_concentrate(pool, shape, share, ridge).select("g", F.col("total").alias("n"), F.col("edge").alias("at")), "quality-edge")
    grown = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("at") + 0.5) / 16) / F.lit(_chi2_quantile(len(STATS), share)))
    return shape.join(edges, "g").select("g", "n", "g_mean", F.transform("g_cov", lambda v: v * grown).alias("g_cov"))


def _blend(line: DataFrame, depth: int, prior: float) -> DataFrame:
    """A group's shape drawn towards the one above it as if that were ``prior`` rows, from the top down; g, g_mean, g_inv."""
    p = len(STATS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            mean, cov = (np.array(f[f"{c}0"].tolist(), float).reshape(len(f), -1) for c in ("g_mean", "g_cov"))
            for i in range(1, depth):
                w = (f[f"n{i}"].to_numpy(float) / (f[f"n{i}"].to_numpy(float) + prior))[:, None]
                mean = w * np.array(f[f"g_mean{i}"].tolist(), float).reshape(len(f), -1) + (1 - w) * mean
                cov = w * np.array(f[f"g_cov{i}"].tolist(), float).reshape(len(f), -1) + (1 - w) * cov
            inv = np.linalg.inv(cov.reshape(-1, p, p)) if len(f) else cov
            yield pd.DataFrame({"g": f["g"], "g_mean": list(mean), "g_inv": list(inv.reshape(len(f), -1))})

    return line.mapInPandas(run, "g string, g_mean array<double>, g_inv array<double>")


def robust_outliers(rows: DataFrame, keys: list[str], prior: float = 100.0, cutoff: float = CUTOFF, **options) -> DataFrame:
    """Squared robust distances of statistic vectors, by group: the input's columns with md2 and outlier.

    Every group, every group of its leading keys and all rows together get a
    minimum covariance determinant (``group_shapes``).  A group is judged by its own
    shape drawn towards the one above it, which weighs like ``prior`` rows: a
    group of a few rows leans on its language and that on all rows, a
    large one stands for itself, with no size at which this jumps.  Equal vectors
    of a group weigh once in the estimates, so copies of one text can't pull them together.
    Nulls in the keys form groups of their own; an empty table gives an empty one.  Rows
    meet the groups' few numbers by a broadcast as long as these are small.
    """
    depth = len(keys) + 1
    (name,) = free(rows, "g")
    part = [F.coalesce(F.regexp_replace(F.col(k).cast("string"), "[/~]", "~$0"), F.lit("~")) for k in keys]
    level = [F.concat_ws("/", F.lit(str(i)), *part[:i]) for i in range(depth)]
    rows = materialise(rows.withColumn(name, level[-1]), "quality-stats")
    pool = materialise(rows.select(*(c.alias(f"g{i}") for i, c in enumerate(level)), *STATS).distinct(), "quality-pool")
    shapes = materialise(group_shapes(pool.select(F.explode(F.array(*(f"g{i}" for i in range(depth)))).alias("g"), *STATS), **options), "quality-groups")
    line = pool.select(*(f"g{i}" for i in range(depth))).distinct()
    for i in range(depth):
        line = line.join(shapes.select(F.col("g").alias(f"g{i}"), *(F.col(c).alias(f"{c}{i}") for c in ("n", "g_mean", "g_cov"))), f"g{i}")
    final = materialise(_blend(line.withColumn("g", F.col(f"g{depth - 1}")), depth, prior), "quality-final").withColumnRenamed("g", name)
    out = rows.join(broadcast_if_small(final), name).withColumn("md2", _distance())
    return out.withColumn("outlier", F.col("md2") > cutoff).drop(name, "g_mean", "g_inv")


def rate(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Base counts, base_failed, robust distance and verdict of every document.

    Texts that fail the base rules take no part in the estimates and have a null
    md2.  A null or empty text has no words and so fails.  Repeated ids keep
    their own rows; columns of the input other than doc_id are not returned, so
    they may have any name.  An empty table gives no row.
    """
    base = measure(docs, carry={"_lang": F.col("lang"), "_source": F.col("source")})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    base = materialise(base.withColumn("base_failed", failed), "quality-base")
    stats = base.where(~F.col("base_failed")).withColumns(_statistics())
    judged = robust_outliers(stats, ["_lang", "_source"], cutoff=cutoff).drop(*STATS)
    rest = base.where("base_failed").withColumns({"md2": F.lit(None).cast("double"), "outlier": F.lit(False)})
    return judged.unionByName(rest).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier")).drop("_lang", "_source")
