"""Operator 13, conversation prefix trie: adaptive radix trees over fixed-width turn ids, one for each range of keys."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlight.llm.common import WORD, broadcast_if_small, materialise
from pairlight.llm.radix import Node, insert, walk

#: Bytes of a turn's id.
WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as an id and its number of words.

    The id is the first half of a SHA-256 of role and text, as 32 hex digits.
    Null roles and texts are empty, null turns come first, ties go by id.  Rows
    of a null conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.substring(F.sha2(marked, 256), 1, 2 * WIDTH).alias("id"), F.regexp_count(text, F.lit(WORD)).alias("w"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id", "w")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["id"].alias("id"), x["w"].alias("w"))).alias("turns"))


def rebuild(seqs: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Sequences whose first h turns are those of the family's first conversation: h is crc32 of the id modulo ``most``.

    The first is conv_id - conv_id % family; if it has fewer turns all of them are taken, if it isn't there none.
    """
    seqs = materialise(seqs, "trie-turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = seqs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, most - 1).alias("_head"))
    joined = seqs.withColumns({"_h": h.cast("int"), "_key": F.col("conv_id") - F.col("conv_id") % family}).join(heads, F.col("_key") == F.col("_first"), "left")
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), none), F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def _runs(g0: np.ndarray, g1: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero((g0[1:] != g0[:-1]) | (g1[1:] != g1[:-1])) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(g0)]))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a group as pieces of text."""
    for b in batches:
        if len(b):
            g0, g1, ids = b.column("g0").to_numpy(), b.column("g1").to_numpy(), b.column("conv_id").to_pylist()
            runs = _runs(g0, g1)
            first = [lo for lo, _ in runs]
            yield pa.RecordBatch.from_arrays([pa.array(g0[first]), pa.array(g1[first]), pa.array([ids[lo] for lo in first], pa.int64()), pa.array([",".join(map(str, ids[lo:hi])) for lo, hi in runs])], names=["g0", "g1", "low", "piece"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's pieces, which come in order; nothing but the running hash is held."""
    group, sha = None, None
    for b in batches:
        done: list[tuple] = []
        for g0, g1, piece in zip(*(b.column(c).to_pylist() for c in ("g0", "g1", "piece")), strict=True):
            if (g0, g1) == group:
                sha.update(b"," + piece.encode())
            else:
                if group:
                    done.append((*group, sha.hexdigest()))
                group, sha = (g0, g1), hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["g0", "g1", "ends"])
    if group:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*group, sha.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["g0", "g1", "ends"])


def end_hashes(keyed: DataFrame) -> DataFrame:
    """g0, g1 and the hash of the group's ids in ascending order, joined by commas.

    A range sort by group and id spreads a large group over many tasks, which
    turn it into pieces of text; the pieces of a group then pass through one running
    hash, as SHA-256 is one pass by its nature.
    """
    pieces = keyed.repartitionByRange("g0", "g1", "conv_id").sortWithinPartitions("g0", "g1", "conv_id").mapInArrow(_joined_ids, "g0 long, g1 long, low long, piece string")
    return pieces.repartition("g0", "g1").sortWithinPartitions("g0", "g1", "low").mapInArrow(_hashes, "g0 long, g1 long, ends string")


def _next(digest: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(digest + turn, digest_size=16).digest()


NODES = "part int, node binary, parent binary, last_turn binary, depth int, n long, low long, parent_low long, children long, leaves long, saved long, ends string, edge_key binary, edge_words array<int>"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a range of keys, with figures of this range alone, and its first and last key.

    Keys go into a radix tree.  Of all its byte depths only those that are a
    whole number of turns give nodes, be they inside a compressed prefix.
    """
    from pyspark import TaskContext

    root, keys, words, n, low, ends = None, [], [], [], [], []
    for b in batches:
        for key, w, count, least, end in zip(*(b.column(c).to_pylist() for c in ("key", "words", "n", "low", "ends")), strict=True):
            at = len(n)
            n.append(count)
            low.append(least)
            words.append(np.array(w, np.int32))
            ends.append(end)
            keys.append(key)
            root = Node(key, at) if root is None else insert(root, key, at)
    if root is None:
        return
    part = TaskContext.get().partitionId()
    first, last = min(range(len(keys)), key=keys.__getitem__), max(range(len(keys)), key=keys.__getitem__)
    edge = [(keys[i], words[i].tolist()) for i in (first, last)]

    order = walk(root)
    any_record = [node.end for node, *_ in order]
    for at in range(len(order) - 1, 0, -1):
        up = order[at][1]
        any_record[up] = max(any_record[up], any_record[at])
    # Down: emitted nodes of each tree node, the digest at its last aligned depth, and the emitted node above.
    rows: list[list] = []  # digest, parent's row, turn, depth
    state: list[tuple[int, int]] = []  # first row and one past the last; above them hangs ``over``
    over: list[int] = []
    for at, (_node, up, above, end) in enumerate(order):
        parent = -1 if up < 0 else over[up]
        key = keys[any_record[at]]
        start = len(rows)
        for depth in range(above // WIDTH + 1 if above >= 0 else 0, end // WIDTH + 1):
            turn = key[(depth - 1) * WIDTH : depth * WIDTH] if depth else b""
            rows.append([_next(rows[parent][0], turn) if depth else bytes(16), parent, turn, depth])
            parent = len(rows) - 1
        state.append((start, len(rows)))
        over.append(parent)
    # Up: sums of subtrees.
    size = len(order)
    sums = [[0, None, 0, 0, 0] for _ in range(size)]  # n, low, topmost nodes below, leaves, saved
    told = [None] * len(rows)
    for at in range(size - 1, -1, -1):
        node, up, _, end = order[at]
        s = sums[at]
        if node.end >= 0:
            s[0] += n[node.end]
            s[1] = low[node.end] if s[1] is None else min(s[1], low[node.end])
        w = words[any_record[at]]
        for r in range(state[at][1] - 1, state[at][0] - 1, -1):
            depth = rows[r][3]
            if not s[2]:
                s[3] = 1
            s[4] += (s[0] - 1) * int(w[depth - 1]) if depth else 0
            told[r] = (s[0], s[1], s[2], s[3], s[4], ends[node.end] if node.end >= 0 and depth * WIDTH == end else None)
            s[2] = 1
        if up >= 0:
            t = sums[up]
            t[0] += s[0]
            t[1] = s[1] if t[1] is None else min(t[1], s[1])
            t[2] += s[2]
            t[3] += s[3]
            t[4] += s[4]
    schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("node", "parent", "last_turn")), ("depth", pa.int32()), *((c, pa.int64()) for c in ("n", "low", "parent_low", "children", "leaves", "saved")), ("ends", pa.string()), ("edge_key", pa.binary()), ("edge_words", pa.list_(pa.int32()))])
    for lo in range(0, len(rows), 10_000):
        some = range(lo, min(lo + 10_000, len(rows)))
        none = [None] * len(some)
        has = [rows[r][1] >= 0 for r in some]
        cols = [
            [part] * len(some), [rows[r][0] for r in some], [rows[rows[r][1]][0] if p else None for r, p in zip(some, has)], [rows[r][2] for r in some], [rows[r][3] for r in some],
            *([told[r][i] for r in some] for i in (0, 1)), [told[rows[r][1]][1] if p else None for r, p in zip(some, has)], *([told[r][i] for r in some] for i in (2, 3, 4, 5)), none, none,
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
    for kind, (key, w) in enumerate(edge):  # the first key has depth -1, the last -2
        values = {"part": part, "depth": -1 - kind, "edge_key": key, "edge_words": w}
        yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring ranges both hold: the common start of the one's last key and the other's first.

    Along it, a child is counted in both, a member too few is taken off each
    node's tokens, and a last key that the next range goes on from was no leaf.
    """
    schema = pa.schema([("node", pa.binary()), ("d_children", pa.int64()), ("d_leaves", pa.int64()), ("d_saved", pa.int64())])
    for b in batches:
        for last, w, key in zip(*(b.column(c).to_pylist() for c in ("last_key", "last_words", "first_key")), strict=True):
            shared = 0
            most = min(len(last), len(key)) // WIDTH
            while shared < most and last[shared * WIDTH : (shared + 1) * WIDTH] == key[shared * WIDTH : (shared + 1) * WIDTH]:
                shared += 1
            digests = [bytes(16)]
            for d in range(shared):
                digests.append(_next(digests[-1], last[d * WIDTH : (d + 1) * WIDTH]))
            tail = np.concatenate([np.cumsum(np.array(w[:shared], np.int64)[::-1])[::-1], [0]]) if shared else np.zeros(1, np.int64)
            # At depth d: words of turns d to the last shared one; the root has no words of its own.
            saved = np.concatenate([tail[:1], tail[:-1]])
            leaf = -int(len(last) == shared * WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([-1] * shared + [0], pa.int64()), pa.array([leaf] * (shared + 1), pa.int64()), pa.array(saved, pa.int64())], schema=schema)


def trie(seqs: DataFrame, part_bytes: int = 16_000_000) -> DataFrame:
    """Nodes of the prefix trie of all sequences, a row each.

    ``seqs`` has conv_id, each once, and turns, an array of (id, w).  A node is a
    distinct start of d turns; its members are the conversations that start
    with it.  Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves
    (childless nodes of its subtree), saved_tokens (over its subtree, members but
    one times the words of the last turn), ends_sha256 (of the ids that end there), and node,
    parent and last_turn as hex ids.

    Equal sequences are one key.  Keys are dealt into ranges of about
    ``part_bytes`` by their bytes, whatever turn they start with; each task
    builds an adaptive radix tree of its range and gives its nodes with sums
    of their subtrees.  Only the nodes on the common start of two neighbouring
    ranges are incomplete; they are added up, and what was
    counted twice is taken off along that start.  A conversation is one row of 20 bytes a turn.  An empty
    table gives no node, a conversation without turns ends at the root.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    keyed = seqs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["w"]).alias("words"))
    keyed = materialise(keyed.withColumns({"g0": F.xxhash64("key"), "g1": F.xxhash64(F.lit("second"), "key")}), "trie-keys")
    ends = end_hashes(keyed.select("g0", "g1", "conv_id"))
    classes = keyed.groupBy("key").agg(F.first("g0").alias("g0"), F.first("g1").alias("g1"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    classes = materialise(classes.join(ends, ["g0", "g1"]).select("key", "words", "n", "low", "ends"), "trie-classes")

    size = classes.agg(F.sum(F.octet_length("key") + 100).alias("s")).first()["s"] or 0
    parts = max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    found = materialise(classes.repartitionByRange(parts, "key").mapInArrow(_trees, NODES), "trie-nodes")

    # A row a range: its last key beside the first one of the next range that has any.
    edges = found.where("depth < 0").groupBy("part").agg(*(F.max(F.when(F.col("depth") == d, F.struct(F.col("edge_key").alias("k"), F.col("edge_words").alias("w")))).alias(c) for d, c in ((-1, "a"), (-2, "z"))))
    after = edges.select(F.col("z.k").alias("last_key"), F.col("z.w").alias("last_words"), F.lead("a.k").over(Window.orderBy("part")).alias("first_key")).where("first_key IS NOT NULL")
    fixes = after.mapInArrow(_corrections, "node binary, d_children long, d_leaves long, d_saved long")
    fixes = materialise(fixes.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("d_children", "d_leaves", "d_saved"))), "trie-fixes")

    nodes = found.where("depth >= 0").drop("part", "edge_key", "edge_words")
    few = broadcast_if_small(fixes.select("node"))
    parted = nodes.join(few, "node").groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "last_turn", "depth")), F.sum("n").alias("n"), F.min("low").alias("low"), F.lit(None).cast("long").alias("parent_low"), *(F.sum(c).alias(c) for c in ("children", "leaves", "saved")), F.max("ends").alias("ends"))
    fixed = parted.join(fixes, "node").withColumns({c: F.col(c) + F.col(f"d_{c}") for c in ("children", "leaves", "saved")}).drop("d_children", "d_leaves", "d_saved")
    fixed = materialise(fixed, "trie-shared")
    every = nodes.join(few, "node", "left_anti").unionByName(fixed)
    above = fixed.select(F.col("node").alias("parent"), F.col("low").alias("_low"))
    out = every.join(broadcast_if_small(above), "parent", "left")
    return out.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.coalesce("_low", "parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"), F.lower(F.hex("node")).alias("node"), F.lower(F.hex("parent")).alias("parent"), F.lower(F.hex("last_turn")).alias("last_turn"),
    )
