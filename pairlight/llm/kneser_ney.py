"""Operator 5, LM scoring: interpolated modified Kneser-Ney bigrams, counted in Spark, read from mapped sorted arrays."""

from __future__ import annotations

import tempfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.llm.common import fresh_path, lower_words, materialise

#: Hashes of the marks before and after a text, which no word can have by being bytes with blanks.
START, END = np.uint64(xxhash.xxh64_intdigest(b" <s> ")), np.uint64(xxhash.xxh64_intdigest(b" </s> "))
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v * _C1) ^ (w + _C2)
    x = (x ^ (x >> np.uint64(32))) * _C2
    return x ^ (x >> np.uint64(29))


class Vocabulary(dict):
    """Numbers of the words seen by one task, and their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes = array("Q", [int(START), int(END)])

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def _pairs(texts: list, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts as 0 w w w 1, the lengths, and at which place each text begins."""
    parts, sizes = [], []
    for t in texts:
        ws = lower_words(t)
        parts.append(np.fromiter(map(vocab.__getitem__, ws), np.int64, len(ws)))
        sizes.append(len(ws) + 2)
    sizes = np.array(sizes, np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.zeros(int(start[-1]), np.int64)
    inner = np.ones(len(ids), bool)
    inner[start[:-1]] = False
    inner[start[1:] - 1] = False
    ids[inner] = np.concatenate(parts) if parts else []
    ids[start[1:] - 1] = 1
    return ids, sizes, start[:-1]


def _spans(texts: pa.Array, most: int) -> Iterator[list]:
    """The texts in runs of about ``most`` bytes, however long they are."""
    sizes = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], np.int64)
    run = (np.cumsum(sizes) - sizes) // most
    edge = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for lo, hi in zip(edge, edge[1:], strict=False):
        if hi > lo:
            yield texts.slice(lo, hi - lo).to_pylist()


def _pair_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct neighbouring word hashes (v, w) with counts, for every ``most`` tokens or so of a task's texts."""
    vocab, blocks, n = Vocabulary(), [], 0

    def close() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = np.int64(len(vocab.hashes))
        key = np.concatenate([v.astype(np.int64) * width + w for v, w in blocks])
        key, count = np.unique(key, return_counts=True)
        h = np.array(vocab.hashes, np.uint64)
        return h[key // width], h[key % width], count

    for batch in batches:
        for texts in _spans(batch.column(0), 2_000_000):
            ids, _, start = _pairs(texts, vocab)
            follows = np.ones(len(ids), bool)
            follows[start] = False
            at = np.flatnonzero(follows)
            blocks.append((ids[at - 1].astype(np.int32), ids[at].astype(np.int32)))
            n += len(at)
            if n >= most:
                yield close()
                vocab, blocks, n = Vocabulary(), [], 0
    if n:
        yield close()


def _packed(part: np.ndarray, arrays: list[np.ndarray], parts: int, kinds: list[str]) -> pa.RecordBatch:
    """One row a non-empty part, with each array's slice as bytes."""
    order = np.argsort(part, kind="stable")
    part, arrays = part[order], [a[order] for a in arrays]
    edge = np.searchsorted(part, np.arange(parts + 1))
    full = np.flatnonzero(np.diff(edge))
    cols = [pa.array([a[edge[i] : edge[i + 1]].astype(k).tobytes() for i in full], pa.binary()) for a, k in zip(arrays, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *cols], names=["part", *(f"c{i}" for i in range(len(cols)))])


def _whole(table: pa.Table, kinds: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(f"c{i}").to_pylist()), k) for i, k in enumerate(kinds)]


def _added(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums by place in whole numbers; a sum in doubles would lose units above 2 ** 53."""
    out = np.zeros(size, np.int64)
    np.add.at(out, at, values.astype(np.int64))
    return out


def _save(root: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as raw files below a shared folder; a second attempt of a task replaces the same content."""
    store, base = pafs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    for k, a in arrays.items():
        with store.open_output_stream(f"{base}/.{name}.{k}.{attempt}") as f:
            f.write(a.tobytes())
        store.move(f"{base}/.{name}.{k}.{attempt}", f"{base}/{name}.{k}")


def _map(root: str, name: str, kind: str) -> np.ndarray:
    """A saved array, memory-mapped; from a remote store by way of an unlinked local file."""
    store, base = pafs.FileSystem.from_uri(root)
    path = f"{base}/{name}"
    size = store.get_file_info(path).size
    if not size:
        return np.zeros(0, kind)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with tempfile.NamedTemporaryFile() as local:
        with store.open_input_stream(path) as src:
            while data := src.read(1 << 22):
                local.write(data)
        local.flush()
        return np.memmap(local.name, kind, "r")


@dataclass
class Model:
    """Where the arrays are, in how many parts, and the few numbers that all texts share."""

    root: str
    parts: int
    tokens: int
    vocabulary: int
    texts: int
    pairs: int
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    low_kinds: tuple[int, int, int]
    hot: np.ndarray


#: A word's row: its hash, its tokens, how many words follow it once, twice, more often, and how many come before it.
_WORD_KINDS = {"hash": "u8", "count": "u8", "n1": "u8", "n2": "u8", "n3": "u8", "left": "u8"}
#: What one part knows of a word: kinds of neighbours are at most its distinct pairs, so four bytes hold them.
_SENT_KINDS = {"hash": "u8", "count": "u8", "n1": "u4", "n2": "u4", "n3": "u4", "left": "u4"}
#: Counts take four bytes; those that need more stand in arrays of their own, and TOP in their place.
_PAIR_KINDS = {"hash": "u8", "count": "u4"}
_LARGE_KINDS = {"large_hash": "u8", "large_count": "u8"}
TOP = (1 << 32) - 1


def pair_arrays(key: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """The stored arrays of pairs sorted by hash, every count whole."""
    large = count >= TOP
    return {"hash": key, "count": np.minimum(count, TOP).astype("u4"), "large_hash": key[large], "large_count": count[large].astype("u8")}


def _frequent(docs: DataFrame, text_col: str, parts: int) -> np.ndarray:
    """Hashes of words so frequent that their pairs need many parts, found on a hundredth of the texts.

    This only decides which part counts a pair, never a count.
    """
    some = docs.where(F.pmod(F.xxhash64(F.col(text_col)), F.lit(100)) == 0).select(F.explode(F.split(F.col(text_col), " ")).alias("w"))
    some = some.where("w <> ''").groupBy(F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    total = some.agg(F.sum("n")).first()[0] or 0
    rows = some.where(F.col("n") * 8 * parts > total).orderBy(F.desc("n")).limit(8 * parts).collect()  # at most 8 a part
    return np.array([START, *(np.uint64(xxhash.xxh64_intdigest(r["w"].encode())) for r in rows)], np.uint64)


def train(docs: DataFrame, text_col: str = "text", parts: int | None = None, block_tokens: int = 1_000_000, part_bytes: int = 128_000_000) -> Model:
    """Count the bigrams of all texts and store the model's arrays in the shared folder.

    Each task counts its own texts' pairs and hands every part its slice; a part
    adds up its pairs, sorts them by hash and stores them, and hands on what it
    knows about single words; those are added up and stored the same way, in
    ranges of the hash.  Pairs of frequent first words are spread over all parts.
    Null and empty texts are a start and an end.  Words are hashed to 64 bits.
    There are as many parts as the session has shuffle partitions, and more where
    the texts are so long that a part would count more than ``part_bytes`` of them.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    root = fresh_path(spark, "lm")
    hot = np.sort(_frequent(docs, text_col, parts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for v, w, n in _pair_blocks(batches, block_tokens):
                spread = np.isin(v, hot)
                part = ((v ^ np.where(spread, w * _C1, np.uint64(0))) >> np.uint64(7)) % np.uint64(parts)
                yield _packed(part, [v, w, n], parts, ["u8", "u8", "u4"])

    src = docs.select(F.col(text_col).cast("string").alias("_text"))
    slices = src.mapInArrow(count, "part int, c0 binary, c1 binary, c2 binary")

    def add_pairs(t: pa.Table) -> pa.Table:
        v, w, n = _whole(t, ["u8", "u8", "u4"])
        k = int(t.column("part")[0].as_py())
        with np.errstate(over="ignore"):
            key = pair_hash(v, w)
            order = np.argsort(key, kind="stable")
            key, v, w, n = key[order], v[order], w[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            c = np.add.reduceat(n.astype(np.int64), first)
            key, v, w = key[first], v[first], w[first]
            _save(root, f"pair-{k}", pair_arrays(key, c))
            # What this part knows of words: as first ones their tokens and kinds of followers, as second ones their kinds of predecessors.
            hv, iv = np.unique(v, return_inverse=True)
            hw, left = np.unique(w, return_counts=True)
            cols = [_added(iv, x, len(hv)) for x in (c, c == 1, c == 2, c >= 3)]
            zero = np.zeros(len(hw), np.int64)
            whole = [np.concatenate([hv, hw]), *(np.concatenate([x, zero]) for x in cols), np.concatenate([np.zeros(len(hv), np.int64), left])]
            step = np.uint64(-(-(1 << 64) // parts))
            out = _packed(whole[0] // step, whole, parts, list(_SENT_KINDS.values()))
        times = np.array([np.count_nonzero(c == i) for i in (1, 2, 3, 4)], np.int64)
        note = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([times.tobytes()]), *(pa.array([b""], pa.binary()) for _ in range(5))], names=out.schema.names)
        return pa.Table.from_batches([out, note.cast(out.schema)])

    known = slices.groupBy("part").applyInArrow(add_pairs, "part int, " + ", ".join(f"c{i} binary" for i in range(6)))
    known = materialise(known, "lm-words")

    def add_words(t: pa.Table) -> pa.Table:
        k = int(t.column("part")[0].as_py())
        h, *cols = _whole(t, list(_SENT_KINDS.values()))
        u, at = np.unique(h, return_inverse=True)
        sums = [_added(at, c, len(u)) for c in cols]
        _save(root, f"word-{k}", {name: x.astype(kind) for (name, kind), x in zip(_WORD_KINDS.items(), [u, *sums], strict=True)})
        left = sums[-1]
        ends = float(sums[0][u == START].sum())
        row = [len(u) - int((u == START).sum()), int(sums[0].sum()), int(ends), *(int((left == i).sum()) for i in (1, 2, 3, 4)), int((left >= 3).sum()), int(left.sum())]
        return pa.table({f"s{i}": pa.array([x], pa.int64()) for i, x in enumerate(row)})

    s = known.where("part >= 0").groupBy("part").applyInArrow(add_words, ", ".join(f"s{i} long" for i in range(9))).agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(9))).first()
    s = [int(x or 0) for x in s]
    # The four counts of counts of each part: 32 bytes a part.
    notes = known.where("part = -1").select("c0").toArrow().column("c0").to_pylist()
    times = sum((np.frombuffer(x, np.int64) for x in notes), np.zeros(4, np.int64))
    return Model(root, parts, s[1], s[0], s[2], s[8], _discounts(times), _discounts(s[3:7]), (s[3], s[4], s[7]), hot)


def _discounts(times) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from how many things were seen once to four times; 0.5, 1, 1.5 where those are too few to tell."""
    n1, n2, n3, n4 = (float(x) for x in times)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return d if all(0 < x < i for i, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)


class Reader:
    """The model's arrays, mapped part by part as they are asked for."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def part(self, kind: str, part: int, name: str, dtype: str) -> np.ndarray:
        key = (kind, part, name)
        if key not in self.open:
            store, base = pafs.FileSystem.from_uri(self.model.root)
            there = store.get_file_info(f"{base}/{kind}-{part}.{name}").type == pafs.FileType.File
            self.open[key] = _map(self.model.root, f"{kind}-{part}.{name}", dtype) if there else np.zeros(0, dtype)
        return self.open[key]

    def look(self, kind: str, part: np.ndarray, h: np.ndarray, kinds: dict[str, str]) -> dict[str, np.ndarray]:
        """Values at sorted distinct hashes; 0 where a hash isn't there.  The first of ``kinds`` names the array of hashes."""
        name = next(iter(kinds))
        out = {k: np.zeros(len(h), np.float64) for k in kinds if k != name}
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(self.model.parts + 1))
        for p in np.flatnonzero(np.diff(edge)):
            own = order[edge[p] : edge[p + 1]]
            table = self.part(kind, int(p), name, "u8")
            if not len(table):
                continue
            at = np.minimum(np.searchsorted(table, h[own]), len(table) - 1)
            hit = table[at] == h[own]
            for k in out:
                out[k][own[hit]] = self.part(kind, int(p), k, kinds[k])[at[hit]]
        return out

    def words(self, h: np.ndarray) -> dict[str, np.ndarray]:
        return self.look("word", (h // np.uint64(-(-(1 << 64) // self.model.parts))).astype(np.int64), h, _WORD_KINDS)

    def pairs(self, v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
        key = pair_hash(v, w)
        part = ((v ^ np.where(np.isin(v, hot), w * _C1, np.uint64(0))) >> np.uint64(7)) % np.uint64(self.model.parts)
        order = np.argsort(key)
        out = np.zeros(len(key))
        part, key = part[order].astype(np.int64), key[order]
        count = self.look("pair", part, key, _PAIR_KINDS)["count"]
        large = np.flatnonzero(count == TOP)
        if len(large):
            count[large] = self.look("pair", part[large], key[large], _LARGE_KINDS)["large_count"]
        out[order] = count
        return out


def _scores(texts: list, model: Model, reader: Reader, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base and model log10 probability of each text."""
    vocab = Vocabulary()
    ids, sizes, start = _pairs(texts, vocab)
    h = np.array(vocab.hashes, np.uint64)
    order = np.argsort(h)
    word = {k: np.zeros(len(h)) for k in _WORD_KINDS if k != "hash"}
    for k, x in reader.words(h[order]).items():
        word[k][order] = x
    count = word["count"].copy()  # a text's end is never first, but ends every text; its start is no token
    count[1], count[0] = model.texts, 0
    follows = np.ones(len(ids), bool)
    follows[start] = False
    at = np.flatnonzero(follows)
    v, w = ids[at - 1], ids[at]
    width = np.int64(len(h))
    key, back = np.unique(v * width + w, return_inverse=True)
    kv, kw = key // width, key % width
    c = reader.pairs(h[kv], h[kw], hot)

    d1, d2, d3 = model.low_discounts
    left = word["left"]
    total = max(1, model.pairs)
    own = np.where(left >= 3, d3, np.where(left == 2, d2, np.where(left == 1, d1, 0)))
    n1, n2, n3 = model.low_kinds
    spare = (d1 * n1 + d2 * n2 + d3 * n3) / total if model.pairs else 1.0
    low = (left - own) / total + spare / (model.vocabulary + 1)

    d1, d2, d3 = model.discounts
    own = np.where(c >= 3, d3, np.where(c == 2, d2, np.where(c == 1, d1, 0)))
    seen = word["count"][kv]
    spare = np.where(seen > 0, (d1 * word["n1"] + d2 * word["n2"] + d3 * word["n3"])[kv] / np.maximum(seen, 1), 1.0)
    p = np.where(seen > 0, (c - own) / np.maximum(seen, 1), 0) + spare * low[kw]
    text = np.repeat(np.arange(len(sizes)), sizes - 1)
    score = np.bincount(text, np.log10(p)[back], len(sizes))
    base = np.bincount(text, np.log10((count[w] + 1) / (model.tokens + model.vocabulary + 1)), len(sizes))
    return sizes - 1, np.bincount(text, count[w] > 0, len(sizes)).astype(np.int64), base, score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Log10 probabilities of whole texts: id, carried columns, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    The workers map the stored arrays and look up each block's distinct pairs
    in sorted order.  base_score is the add-one unigram score.  A null or empty
    text is its end alone.  A model of no texts gives every token the probability 1.
    Repeated and null ids keep their own rows; an empty table gives an empty one;
    columns of the input other than the id come only if carried, under any name.
    """
    carry = carry or {}
    src = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col), *(c.alias(n) for n, c in carry.items()))
    kept = [f for f in src.schema.fields if f.name != "_text"]
    names = [*(f.name for f in kept), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    hot = model.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            at = 0
            for texts in _spans(batch.column(0), 3_000_000):
                with np.errstate(over="ignore"):
                    n, known, base, s = _scores(texts, model, reader, hot)
                carried = [c.slice(at, len(texts)) for c in batch.columns[1:]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*carried, pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(s), pa.array(10 ** np.minimum(-s / n, 300))], names=names)

    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
