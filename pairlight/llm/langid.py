"""Operator 10, language ID: TF-IDF byte n-grams against several centroids per language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlight.llm.common import broadcast_if_small, fresh_path, id_bucket, lowest, materialise

#: Bytes that are no letters (ASCII) become spaces before n-grams are taken.
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def gram_counts(text: str, dims: int) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the lower-cased UTF-8 bytes; grams of blanks only are left out."""
    data = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split())
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(dims)
    shift = np.uint32(32 - int(math.log2(dims)))
    h = b + np.uint32(1)
    for n in (1, 2, 3):
        if n > 1:
            h = h[:-1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
        keep = h if n > 1 else h[b != 32]
        out += np.bincount(((keep * np.uint32(2654435761)) ^ np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> shift, minlength=dims)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    """Log-scaled TF times IDF, at length 1."""
    v = np.log1p(gram_counts(text, len(idf))) * idf
    return v / max(np.linalg.norm(v), 1e-12)


def _cluster(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic for a given row order."""
    mean = x.mean(0)
    seeds = [int(np.argmax(x @ mean))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(steps):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", dims: int = 4096, centroids: int = 4, per_lang: int = 600, block_langs: int = 256, quantile: float = 0.01) -> dict:
    """Learn IDF weights, centroids and a rejection limit for each language.

    IDF counts every row of ``train``.  Centroids come from a bounded sample of
    labelled rows: at most ``per_lang`` rows for each language, those of the
    lowest hash of their id.  A language takes 64 kB of the model.  About
    ``block_langs`` languages are a block; a model of one block is held by every
    worker, one of more lies in the shared folder, and a worker holds one block at
    a time, so any number of languages will do.  A language's limit is the
    ``quantile`` of its sample's cosines.
    Rows with a null text or language are left out.
    """
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(order_col).cast("string")).alias("h"))

    def docfreq(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += gram_counts(text, dims) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.concatenate([[n], seen]))], names=["gram", "n"])

    freq = np.zeros(dims + 1)
    for r in rows.select("t").mapInArrow(docfreq, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # dims + 1 rows
        freq[r["gram"] + 1] = r["n"]
    idf = np.log((1 + freq[0]) / (1 + freq[1:])) + 1

    blocks = max(1, -(-rows.select("l").distinct().count() // block_langs))
    ranks = materialise(lowest(rows, "l", "h", per_lang), "lang-few")
    sample = rows.join(broadcast_if_small(ranks), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t"))
    learned = sample.groupBy("l").applyInPandas(lambda pdf: _fit_language(pdf, idf, centroids, quantile), "l string, c array<float>, n int, reject double")
    if blocks == 1:
        return {"idf": idf, **_block(learned.toArrow(), dims)}
    path = fresh_path(train.sparkSession, "lang-model")
    learned.withColumn("block", F.pmod(F.xxhash64("l"), F.lit(blocks))).repartition(blocks, "block").write.partitionBy("block").parquet(path)
    return {"idf": idf, "stored": path, "blocks": blocks}


def _block(rows: pa.Table, dims: int) -> dict:
    """Languages in order, the centroids of all, whose each is, and the limits."""
    rows = rows.sort_by("l")
    n = rows.column("n").to_numpy()
    cent = rows.column("c").combine_chunks().flatten().to_numpy().astype(np.float32) if len(rows) else np.zeros(0, np.float32)
    return {"langs": rows.column("l").to_pylist(), "own": np.repeat(np.arange(len(n)), n), "centroids": cent.reshape(-1, dims), "reject": rows.column("reject").to_numpy()}


def _blocks(model: dict) -> Iterator[dict]:
    """The model's blocks one after another; stored ones are read anew each time."""
    if "stored" not in model:
        yield model
        return
    store, base = pafs.FileSystem.from_uri(model["stored"])
    for k in range(model["blocks"]):
        there = store.get_file_info(pafs.FileSelector(f"{base}/block={k}", allow_not_found=True))
        files = [f.path for f in there if f.path.endswith(".parquet")]
        if files:
            yield _block(pa.concat_tables(pq.ParquetFile(store.open_input_file(f)).read() for f in files), len(model["idf"]))


def _fit_language(pdf: pd.DataFrame, idf: np.ndarray, k: int, quantile: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "t"])
    x = np.stack([vector(t, idf) for t in pdf["t"]])
    c = _cluster(x, k)
    best = (x @ c.T).max(1)
    return pd.DataFrame({"l": [pdf["l"].iloc[0]], "c": [c.reshape(-1)], "n": [len(c)], "reject": [float(np.quantile(best, quantile))]})


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Language of every row: id, carried columns, lang_pred, score, rejected.

    ``score`` is the cosine to the nearest centroid.  ``rejected`` says that it
    is below the limit of that language, or that there is no language at all; the
    nearest language is given all the same.  A text that is null, empty or has
    no letter gets ``und``, 0 and rejected; so do all if the model is empty.
    Repeated and null ids keep their own rows; an empty table gives an empty
    one; columns other than the id come only if carried, under any name.
    """
    carry = carry or {}
    src = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col), *(c.alias(n) for n, c in carry.items()))
    idf, step = model["idf"].astype(np.float64), 500 if "stored" not in model else 2000

    def nearest(texts: list) -> list[tuple[float, str, float]]:
        """Cosine, language and limit of every text's nearest centroid; of equal ones the first language's."""
        vecs = [vector(t, idf).astype(np.float32) if t and any(map(str.isalpha, t)) else None for t in texts]
        out = [(-math.inf, "und", 0.0)] * len(vecs)
        for block in _blocks(model):
            if not block["langs"]:
                continue
            for j, v in enumerate(vecs):
                if v is None:
                    continue
                sims = block["centroids"] @ v
                i = int(np.argmax(sims))
                lang = int(block["own"][i])
                near = float(sims[i]), block["langs"][lang], float(block["reject"][lang])
                if near[0] > out[j][0] or (near[0] == out[j][0] and near[1] < out[j][1]):
                    out[j] = near
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, far = [], [], []
            for lo in range(0, len(batch), step):
                for sim, lang, limit in nearest(batch.column(0).slice(lo, step).to_pylist()):
                    best = min(1.0, max(0.0, sim))
                    pred.append(lang), score.append(best), far.append(sim == -math.inf or best < limit)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=names)

    kept = [f for f in src.schema.fields if f.name != "_text"]
    names = [*(f.name for f in kept), "lang_pred", "score", "rejected"]
    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = 5, hold: int = 0) -> DataFrame:
    """Learn from the ids outside fold ``hold`` and predict every row, with held_out."""
    fold = id_bucket("doc_id", folds)
    model = fit(docs.where(fold != hold))
    return predict(docs, model, carry={"held_out": fold == hold})
