"""Operator 2, line dedup: lines within an edit bound of an earlier line go, found by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.llm.common import broadcast_if_small, free, materialise, own

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_HALF = np.uint64(32)
#: A line's place: document, hash of its whole text, number of the line.
PLACE = ("d", "t", "k")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _Q
    return x ^ (x >> np.uint64(29))


#: Characters that are worked on at once; a longer line gives its variants in several pieces.
PIECE = 1 << 18
_POWERS = np.concatenate([[np.uint64(1)], np.full(PIECE, _P).cumprod(dtype=np.uint64)])


def _codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def variants(line: str, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of the deletion neighbourhood, and whether a key is the line itself compared with longer lines, piece by piece.

    For a bound of 1 the keys are of two kinds.  'Same place': the line without
    its i-th character, with i and the length; lines that share one differ in
    that character only.  'Any place': the line itself, and the line without any
    one character; a line and one that is longer by a character share one.  Both
    are exact, so a shared key, up to hash collisions, is an edit distance of at
    most 1.  A bound of 0 leaves the line itself.  Pieces cover so many places each
    that memory beside the line's own is bounded; a key may come in two of them.
    """
    n = len(line)
    cuts = range(0, n, PIECE)
    first = [np.uint64(pow(int(_P), lo, 1 << 64)) for lo in cuts]
    heads = [np.uint64(0)]
    for lo, power in zip(cuts, first, strict=True):
        c = _codes(line[lo : lo + PIECE])
        heads.append(heads[-1] + ((c + np.uint64(1)) * _POWERS[: len(c)]).sum(dtype=np.uint64) * power)
    whole = heads[-1]
    yield _mix(np.array([whole + np.uint64(n) * _Q])), np.ones(1, bool)
    if bound == 0:
        return
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    for lo, power, before in zip(cuts, first, heads[:-1], strict=True):
        c = _codes(line[lo : lo + PIECE])
        upto = np.cumsum((c + np.uint64(1)) * (_POWERS[: len(c)] * power), dtype=np.uint64) + before
        head = np.concatenate([[before], upto[:-1]])
        # Horner's form from the left: dropping character i shifts all after it down by one power.
        without = head + (whole - upto) * inverse
        same = _mix(without + _mix(np.arange(lo, lo + len(c), dtype=np.uint64) + np.uint64(n << 32)))
        away = np.unique(_mix(without + np.uint64(n - 1) * _Q))
        yield np.concatenate([same, away]), np.zeros(len(same) + len(away), bool)


def _neighbourhoods(lines: DataFrame, bound: int) -> DataFrame:
    """key, itself, and the line's place (d, t, k) for every variant of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            for at, text in enumerate(b.column(3).to_pylist()):
                with np.errstate(over="ignore"):  # hashes wrap around
                    for keys, itself in variants(text, bound):
                        held.append((at, keys, itself))
                        if sum(len(k) for _, k, _ in held) >= PIECE:
                            yield rows(b, held)
                            held = []
            if held:
                yield rows(b, held)

    def rows(b: pa.RecordBatch, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        at = pa.array(np.repeat([i for i, _, _ in held], [len(k) for _, k, _ in held]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for _, k, _ in held]).view(np.int64)), pa.array(np.concatenate([w for _, _, w in held])), *(b.column(i).take(at) for i in range(3))], names=["key", "itself", *PLACE])

    return lines.select(*PLACE, "line").mapInArrow(run, f"key long, itself boolean, d {lines.schema['d'].dataType.simpleString()}, t long, k int")


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _eligible(line: Column, least: int) -> Column:
    return F.length(F.trim(line)) >= least


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """d, t, k, line (trimmed) of every line that takes part; t is the text's hash, which tells rows of one id apart."""
    text = F.col("text").cast("string")
    src = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("t"), text.alias("_text")).where("d IS NOT NULL AND _text IS NOT NULL")
    return src.select("d", "t", F.posexplode_outer(_split(F.col("_text"))).alias("k", "raw")).where(_eligible(F.col("raw"), least)).select(*PLACE, F.trim("raw").alias("line"))


def first_lines(docs: DataFrame, bound: int = 1, least: int = 20) -> DataFrame:
    """Places (d, t, k) of the lines that stay: first of their text, and within the bound of no earlier line.

    Earlier is by doc_id, then by the text's hash if an id has several texts, then by place in the text.  Equal lines meet by a
    128-bit hash and are aggregated before the shuffle, so a line that occurs
    everywhere is one row for each task.  Of the distinct lines only those go on
    that share three of four segments with another one, as any two lines within
    one edit do; they are few.  Their variants meet in one shuffle by key: each
    key's earliest line and its exact owner decide for all lines that hold it,
    without pairing them.  Each line's earliest partner
    is checked by edit distance on the texts.
    """
    if bound not in (0, 1):
        raise ValueError("the bound is 0 or 1")
    lines = _lines(docs, least)
    n = F.length("line")
    # A line's three segments around the one that may differ, measured for its own length and for a partner one shorter.
    keys = []
    for m in (n, n - 1):
        cut = [F.floor(m * q / 4).cast("int") for q in range(5)]
        keys += [F.xxhash64(F.lit(q), m, F.substr("line", F.lit(1), cut[q]), F.substr("line", n - m + cut[q + 1] + 1)) for q in range(4)]
    hashed = lines.select(F.xxhash64("line").alias("h0"), F.xxhash64(F.lit("second"), "line").alias("h1"), F.struct(*PLACE).alias("place"), F.array(*keys).alias("segs"))
    firsts = materialise(hashed.groupBy("h0", "h1").agg(F.min("place").alias("p"), F.first("segs").alias("segs")).select("p.*", "segs"), "lines-first")
    if bound == 0:
        return firsts.select(*PLACE)

    segs = firsts.select(*PLACE, F.explode(F.array_distinct("segs")).alias("seg"))
    shared = segs.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seg")
    near = materialise(segs.join(shared, "seg").select(*PLACE).distinct(), "lines-near")
    texts = materialise(_lines(docs, least).join(broadcast_if_small(near), list(PLACE)).dropDuplicates(list(PLACE)), "lines-text")

    place = F.struct(*PLACE)
    # Lines here are distinct, so those under one key are at most as many as there are characters to differ in.
    same_key = Window.partitionBy("key")
    marks = _neighbourhoods(texts, bound).withColumn("me", place)
    marks = marks.withColumns({"any": F.min("me").over(same_key), "owner": F.min(F.when(F.col("itself"), F.col("me"))).over(same_key)})
    # With an owner, the key is an 'any place' one: the others are compared with the owner, the owner with the earliest.
    partner = F.when(F.col("owner").isNull() | F.col("itself"), F.col("any")).otherwise(F.col("owner"))
    pairs = marks.withColumn("partner", partner).where(F.col("partner") < F.col("me")).groupBy(*PLACE).agg(F.sort_array(F.collect_set("partner")).alias("partners"))
    pairs = pairs.select(*PLACE, F.explode("partners").alias("p")).select(*PLACE, "p.*").toDF(*PLACE, "pd", "pt", "pk")
    other = texts.select(F.col("d").alias("pd"), F.col("t").alias("pt"), F.col("k").alias("pk"), F.col("line").alias("pline"))
    close = F.levenshtein("line", "pline", bound) >= 0
    gone = pairs.join(texts, list(PLACE)).join(other, ["pd", "pt", "pk"]).where(close).select(*PLACE).distinct()
    return firsts.select(*PLACE).join(gone, list(PLACE), "left_anti")


def dedup_lines(docs: DataFrame, bound: int = 1, least: int = 20) -> DataFrame:
    """The documents with their repeated lines taken out: the input's columns with text rewritten, n_lines and n_removed.

    A line is compared without its outer spaces if it has at least ``least``
    characters then; shorter lines always stay.  It goes if an earlier line of
    any document is equal or within ``bound`` edits (0 or 1 characters).  Null
    and empty texts stay as they are; a text all of whose lines go becomes empty.
    Rows with a null id are left alone.  Different texts under one id are
    different documents, the one of the lower hash earlier; rows that repeat an id and
    its text are one document and are treated alike.  An empty table gives an
    empty one.  If the input has columns n_lines or n_removed, the results take
    their place; other columns may have any name.
    """
    own_cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d, t, stay, kept = free(docs, "_d", "_t", "_stay", "_kept")
    places = first_lines(docs, bound, least).groupBy(F.col("d").alias(d), F.col("t").alias(t)).agg(F.collect_list("k").alias(stay))
    text = F.col("text").cast("string")
    joined = docs.select(*(own(docs, c) for c in own_cols)).join(places, (F.col("doc_id") == F.col(d)) & (F.xxhash64(text) == F.col(t)), "left")
    parts = _split(text)
    # Places of the lines that stay, in order; looking each line up among them would cost the square of their number.
    short = lambda p: F.filter(F.transform(p, lambda x, i: F.when(~_eligible(x, least), i)), lambda i: i.isNotNull())
    left = _let(parts, lambda p: F.transform(F.sort_array(F.concat(F.coalesce(F.col(stay), F.array().cast("array<int>")), short(p))), lambda i: F.get(p, i)))
    joined = joined.withColumn(kept, F.when(F.col("doc_id").isNull(), parts).otherwise(left))
    n = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    n = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n)
    n_left = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(kept)).cast("long")
    return joined.select(*(F.array_join(kept, "\n").alias(c) if c == "text" else own(docs, c) for c in own_cols), n.alias("n_lines"), (n - n_left).alias("n_removed"))
