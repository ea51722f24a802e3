"""Operator 1, best-fit packing under conflicts: no two pieces of a source or of a duplicate cluster in one bin."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlight.llm.common import WORD, materialise


def best_fit(sizes: list[int], sources: list[int], clusters: list[int | None], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in the given order.

    Open bins are held in the order of (residual, bin) and carry two bitmaps, of
    the sources and of the duplicate clusters inside.  An item looks up the
    successor of its size, the tightest bin that holds it, and goes on to the
    next ones until one shares neither bit with it; if none does, it opens a bin.
    An item without a cluster has no cluster bit.
    """
    order: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, 0 if cluster is None else 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order) and (source_bits[order[at][1]] & s or cluster_bits[order[at][1]] & c):
            at += 1
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        bins.append(b)
        offsets.append(capacity - room)
        if room > size:
            insort(order, (room - size, b))
    return bins, offsets


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """Cut documents into pieces of at most ``capacity`` words: doc_id, row, source, cluster, piece, first_word, size.

    The cluster of a document is its exact text; near copies get one where the
    caller gives a ``cluster`` column, such as a component of near-duplicates,
    in which a null is no cluster at all.  Texts that are null or have no words
    give no piece.  Words are counted once: the counts are stored, with a
    number of each row, which tells rows of one id apart.
    """
    n = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0))
    cluster = F.col("cluster").cast("string") if "cluster" in docs.columns else F.md5(F.col("text"))
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), n.alias("n_words")).where("n_words > 0")
    base = materialise(base, "pack-sizes")
    cut = base.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / capacity).cast("int"))))
    return cut.withColumn("first_word", F.col("piece") * capacity).withColumn("size", F.least(F.lit(capacity), F.col("n_words") - F.col("first_word"))).drop("n_words")


def pack(docs: DataFrame, capacity: int = 2048, shard: int = 4096) -> DataFrame:
    """Pack all documents into bins of ``capacity`` words.

    Returns a row a piece: doc_id, piece, first_word, size, bin (a long that is
    unique in the result), offset, source.  Pieces are dealt by a hash of their row's number into shards
    of about ``shard``, so a hot source, a large cluster and rows of one null or
    repeated id spread over all of them; each shard packs its pieces, largest first, by ``best_fit``.  Bins
    never hold two pieces of a source (null counts as one) or of a cluster, so
    neither two pieces of one document.  Every word is packed once.  Repeated
    rows are packed each; ties go by id and piece.  Ids keep their type and
    value, beside nulls too.  An empty table gives no row; other columns of the
    input play no part.
    """
    cut = pieces(docs, capacity)
    shards = max(1, -(-cut.count() // shard))
    rank = F.xxhash64(F.col("row"), F.col("piece"), F.lit("pack"))
    dealt = cut.withColumn("_shard", F.pmod(rank, F.lit(shards)))
    names = ["doc_id", "piece", "first_word", "size", "bin", "offset", "source"]

    def run(t: pa.Table) -> pa.Table:
        # Arrow columns only: pandas would turn a long id beside a null into a float.
        t = t.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        codes = {c: t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist() for c in ("source", "cluster")}
        bits = [None if missing else c for c, missing in zip(codes["cluster"], t.column("cluster").is_null().to_pylist(), strict=True)]
        bins, offsets = best_fit(t.column("size").to_pylist(), codes["source"], bits, capacity)
        first = t.column("_shard")[0].as_py() << 32
        t = t.append_column("bin", pa.array([first + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int32()))
        return t.select(names)

    kind = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = f"doc_id {kind['doc_id']}, piece int, first_word int, size int, bin long, offset int, source string"
    return dealt.groupBy("_shard").applyInArrow(run, schema)
