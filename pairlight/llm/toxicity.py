"""Operator 7, toxicity: a convolutional text classifier over hashed word embeddings, in numpy."""

from __future__ import annotations

import ctypes
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlight.llm.common import broadcast_if_small, each, id_bucket, lowest, materialise

#: Hash space of whole words, and of their stems: their first so many letters.
SPACE, STEMS = 1 << 20, (3, 4, 5, 7)
KINDS = 1 + len(STEMS)
#: Standard errors that a word's odds must lie from the common ones to be no chance; twice as many count in full.
SURE = 3.0
WIDTHS = (1, 2, 3)
#: Filter of each pooled layer: of width 1 the three largest distinct activations count, since a clean text may hold one odd word.
LAYERS = (0, 0, 0, 1, 2)
PAD = max(WIDTHS) - 1
_LETTERS = re.compile(r"[^\W\d_]+")

#: Common function words, by which a text's language is told for calibration.
FUNCTION_WORDS = {
    "en": "the of and to is that it for was with be are this from by".split(),
    "de": "der die und das den von zu nicht mit sich ist ein eine auf dem".split(),
    "fr": "le les des et du une est dans pour qui que pas sur au en".split(),
    "es": "el los las y del que un por con una para se lo su al".split(),
    "it": "il di che e la per un non sono con gli del della è si".split(),
    "pt": "o os e do da em um para não uma com no na por mais".split(),
}
LANGS = [*FUNCTION_WORDS, "other"]


class Tokens(dict):
    """From a word to two packed ints: its hash, that of its first stem and a bit for each language whose function word it is; the other stems' hashes."""

    marks = {w: sum(1 << i for i, lang in enumerate(FUNCTION_WORDS) if w in FUNCTION_WORDS[lang]) for ws in FUNCTION_WORDS.values() for w in ws}

    def __missing__(self, word: str) -> bytes:
        h = [zlib.crc32(word[:n].encode("utf-8", "surrogatepass"), k) % SPACE for k, n in enumerate((None, *STEMS))]
        if len(self) > 100_000:
            self.clear()
        self[word] = out = struct.pack("<qq", h[0] | h[1] << 20 | self.marks.get(word, 0) << 40, h[2] | h[3] << 20 | h[4] << 40)
        return out

    def of(self, text: str | None) -> np.ndarray:
        """A row of two ints for each word."""
        return unpack(b"".join(map(self.__getitem__, _LETTERS.findall(text.lower()) if text else [])))


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, 2)


def numbered(pieces: Iterable[tuple[bytes, list[bytes]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct words of all texts, two ints each and sorted, and the texts as numbers of them.

    A piece holds the words of some texts and these texts as four-byte numbers
    of the piece's own words: a quarter of what each word's two ints would take.
    """
    pieces = list(pieces)
    own = [unpack(words) for words, _ in pieces]
    words, number = np.unique(np.concatenate(own), axis=0, return_inverse=True)
    number = number.reshape(-1).astype(np.int32)
    starts = np.cumsum([0, *map(len, own)])
    return words, [number[at:].take(np.frombuffer(d, np.int32)) for at, (_, docs) in zip(starts.tolist(), pieces, strict=False) for d in docs]


def language(packed: np.ndarray) -> int:
    """Index into LANGS of the language with most function words; ties go to the earlier, none is other."""
    marks = packed[:, 0] >> 40
    marks = marks[marks > 0]
    hits = [(marks >> i & 1).sum() for i in range(len(FUNCTION_WORDS))]
    return int(np.argmax(hits)) if any(hits) else len(FUNCTION_WORDS)


def _hashes(packed: np.ndarray, kind: int) -> np.ndarray:
    """Hash of each word (kind 0) or of its stem of length STEMS[kind - 1]."""
    at = kind if kind < 2 else kind - 2
    return packed[:, int(kind > 1)] >> 20 * at & SPACE - 1


class Net:
    """Embeddings of known hashes, filters of several widths, pooling of the largest activations over the whole text, one logistic output.

    A text is a row of two ints for each word (``Tokens.of``) or, where its
    ``words`` are given (``numbered``), the numbers of its words.
    """

    def __init__(self, docs: list[np.ndarray], labels: np.ndarray, dim: int = 8, filters: int = 8, least: int = 3, seed: int = 7, words: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.rows, tables = [], []
        for kind in range(KINDS):
            seen, bad = np.zeros(SPACE, np.int32), np.zeros(SPACE, np.int32)
            own = None if words is None else _hashes(words, kind)
            for d, y in zip(docs, labels, strict=True):
                u = np.unique(_hashes(d, kind) if own is None else own[d])
                seen[u] += 1
                if y:
                    bad[u] += 1
            known = np.flatnonzero(seen >= least)
            rows = np.zeros(SPACE, np.int32)
            rows[known] = np.arange(1, len(known) + 1)
            n, b = seen[known].astype(float), bad[known].astype(float)
            share = (labels.sum() + 1) / (len(labels) + 2)
            odds = np.log((b + share) / (n - b + 1 - share)) - np.log(share / (1 - share))
            rate = (labels.sum() + 0.5) / (len(labels) + 1)
            gain = b * np.log(np.maximum(b, 1) / n / rate) + (n - b) * np.log(np.maximum(n - b, 1) / n / (1 - rate))
            sure = np.clip(np.sqrt(2 * np.maximum(gain, 0)) / SURE - 1, 0, 1)
            table = rng.normal(0, 0.05, (len(known) + 1, dim))
            table[1:, 0] = np.clip(odds, -2, 4) * sure  # a start from the words' own odds, where they are no chance
            table[0] = 0
            self.rows.append(rows)
            tables.append(table.astype(np.float32))
        self.tables = tables
        self.filters = [rng.normal(0, 0.3, (w, dim, filters)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, 0] += 1 / len(f)
        self.out = np.full(len(LAYERS) * filters, 0.1, np.float32)
        self.bias = np.float32(-1)
        self.cut = np.zeros(len(LANGS))

    def __getstate__(self) -> dict:
        """The places of known hashes stand for the rows by hash, which are zero elsewhere."""
        return {**self.__dict__, "rows": [np.flatnonzero(r).astype(np.int32) for r in self.rows]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.rows = [np.zeros(SPACE, np.int32) for _ in state["rows"]]
        for rows, known in zip(self.rows, state["rows"], strict=True):
            rows[known] = np.arange(1, len(known) + 1)

    def look(self, words: np.ndarray | None) -> list[np.ndarray] | None:
        """Rows of each word in all tables, for texts that are numbers of these words."""
        return None if words is None else [self.rows[kind].take(_hashes(words, kind)) for kind in range(KINDS)]

    def _vectors(self, ids: list[np.ndarray], at: np.ndarray | slice) -> np.ndarray:
        """Sum of the embeddings of a word and its stems at these places."""
        x = self.tables[0].take(ids[0][at], axis=0)
        for table, rows in zip(self.tables[1:], ids[1:], strict=True):
            x += table.take(rows[at], axis=0)
        return x

    def params(self) -> list[np.ndarray]:
        return [*self.tables, *self.filters, self.out]

    def forward(self, docs: list[np.ndarray], look: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Logits, pooled features, rows of all tables, their activations by width, and starts; PAD zero rows end each text."""
        ends = np.cumsum([len(d) + PAD for d in docs])
        starts = ends - [len(d) + PAD for d in docs]
        ids = []
        whole = np.concatenate(docs)
        at = np.arange(len(whole)) + np.repeat(np.arange(len(docs)) * PAD, [len(d) for d in docs])
        for kind in range(KINDS):
            rows = np.zeros(int(ends[-1]) + PAD, np.int32)
            rows[at] = look[kind].take(whole) if look else self.rows[kind].take(_hashes(whole, kind))
            ids.append(rows)
        x = self._vectors(ids, slice(None))
        pads = np.ones(int(ends[-1]), bool)
        pads[at] = False
        acts, tops = [], []
        for k, layer in enumerate(LAYERS):
            if k and layer == LAYERS[k - 1]:
                z = np.where(acts[-1] < np.repeat(tops[-1], ends - starts, axis=0), acts[-1], np.float32(-np.inf))
            else:
                f = self.filters[layer]
                z = x[: int(ends[-1])] @ f[0]
                for j in range(1, len(f)):
                    z += x[j : int(ends[-1]) + j] @ f[j]
                z[pads] = 0  # a window that starts behind its text would reach into the next one
            acts.append(z)
            tops.append(np.maximum.reduceat(z, starts, axis=0))
        pooled = np.concatenate(tops, axis=1)
        pooled = np.maximum(pooled, 0)
        return pooled @ self.out + self.bias, pooled, ids, acts, starts

    def gradient(self, docs: list[np.ndarray], labels: np.ndarray, look: list[np.ndarray] | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray], np.ndarray, float]:
        """Of the mean logistic loss: rows and their gradients for each table, filters, output weights, bias.  It flows through each layer's largest window only."""
        n = self.filters[0].shape[2]
        logit, pooled, ids, acts, starts = self.forward(docs, look)
        err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels).astype(np.float32) / len(docs)
        grads = [np.zeros_like(p) for p in self.filters]
        touched: list[tuple[np.ndarray, np.ndarray]] = []
        ends = np.append(starts[1:], len(acts[0]))
        for w, (z, layer) in enumerate(zip(acts, LAYERS, strict=True)):
            f = self.filters[layer]
            g = err[:, None] * self.out[w * n : (w + 1) * n] * (pooled[:, w * n : (w + 1) * n] > 0)
            at = np.stack([s + z[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])  # text x filter
            for j in range(len(f)):
                x = self._vectors(ids, at + j)  # text x filter x dim
                grads[layer][j] += np.einsum("bfd,bf->df", x, g)
                touched.append(((at + j).reshape(-1), (g[:, :, None] * f[j].T[None]).reshape(-1, f.shape[1])))
        spots, flow = (np.concatenate(t) for t in zip(*touched, strict=True))
        tables = []
        for k in range(KINDS):
            rows, where = np.unique(ids[k][spots], return_inverse=True)
            g = np.zeros((len(rows), flow.shape[1]), np.float32)
            np.add.at(g, where, flow)
            g[rows == 0] = 0
            tables.append((rows, g))
        return tables, grads, pooled.T @ err, float(err.sum())

    def train(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.02, seed: int = 3, words: np.ndarray | None = None) -> None:
        """Adagrad on the logistic loss."""
        rng = np.random.default_rng(seed)
        sums, look = [np.full_like(p, 1e-2) for p in self.params()], self.look(words)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                tables, grads, step_out, step_bias = self.gradient([docs[i] for i in part], labels[part], look)
                for k, (rows, g) in enumerate(tables):
                    sums[k][rows] += g * g
                    self.tables[k][rows] -= rate * g / np.sqrt(sums[k][rows])
                for k, g in enumerate([*grads, step_out], KINDS):
                    sums[k] += g * g
                    self.params()[k][...] -= rate * g / np.sqrt(sums[k])
                self.bias -= np.float32(rate * step_bias)

    def logits(self, docs: list[np.ndarray], words: np.ndarray | None = None) -> np.ndarray:
        look = self.look(words)
        return np.concatenate([self.forward(docs[i : i + 64], look)[0] for i in range(0, len(docs), 64)])

    def calibrate(self, docs: list[np.ndarray], labels: np.ndarray, logit: np.ndarray, lent: float = 20.0, clean_weight: float = 6.0, words: np.ndarray | None = None) -> None:
        """For each language the logit that splits its rows with the lightest errors, in the middle of the gap.

        ``logit`` holds the logits of nets that were not trained on the rows.  To the
        errors among a language's own rows come those among all rows, weighed as if
        they held ``lent`` toxic ones: few own rows leave the cut near the pooled one,
        many move it to their own, by one rule at every size.  A clean row judged
        toxic weighs ``clean_weight`` errors, since the sample holds far fewer clean
        rows than the corpus does.
        """
        lang = np.array([language(d if words is None else words[d]) for d in docs])
        order = np.argsort(logit, kind="stable")
        z, y = logit[order].astype(float), labels[order]
        ends = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
        real = np.flatnonzero(np.diff(ends) > 0)  # no cut parts equal logits
        for k in range(len(LANGS)):
            weight = (lang[order] == k) + lent / max(lent, labels.sum())
            missed, taken = np.cumsum(y * weight), np.cumsum(((1 - y) * weight)[::-1])[::-1]
            wrong = (np.append(0, missed) + clean_weight * np.append(taken, 0))[real]
            best = real[np.flatnonzero(wrong <= wrong.min() + 1e-9)]
            i = int(best[len(best) // 2])
            self.cut[k] = (ends[i] + ends[i + 1]) / 2

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        cut = self.cut[[language(d) for d in docs]]
        return 1 / (1 + np.exp(-np.clip(self.forward(docs)[0].astype(float) - cut, -60, 60)))


def cross_logits(docs: list[np.ndarray], labels: np.ndarray, net: Net, folds: int = 3, words: np.ndarray | None = None) -> np.ndarray:
    """Logit of each row by a net trained without its fold; equal texts share a fold.

    Each class is dealt evenly over the folds.  Where a class has a single text,
    no net can be trained without it, and ``net``, trained on all, judges that fold.
    """
    fold, out = np.zeros(len(docs), int), np.zeros(len(docs))
    key = np.array([zlib.crc32(d if words is None else words[d]) for d in docs])
    for c in (0, 1):
        fold[labels == c] = np.unique(key[labels == c], return_inverse=True)[1] % folds
    for f in np.unique(fold).tolist():
        learn, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        own = net
        if len(set(labels[learn].tolist())) == 2:
            part = [docs[i] for i in learn]
            own = Net(part, labels[learn], words=words)
            own.train(part, labels[learn], words=words)
        out[rest] = own.logits([docs[i] for i in rest], words)
    return out


def learn(docs: list[np.ndarray], labels: np.ndarray, words: np.ndarray | None = None) -> Net:
    """A net trained on all rows, its thresholds set by the logits of nets that did not see the row."""
    net = Net(docs, labels, words=words)
    net.train(docs, labels, words=words)
    net.calibrate(docs, labels, cross_logits(docs, labels, net, words=words), words=words)
    return net


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000, longest: int = 200_000, per_class_bytes: int = 24_000_000) -> Net | None:
    """Train on a bounded sample of labelled rows: at most ``per_class`` of each label, those of the lowest hash of their id.

    Texts above ``longest`` bytes, and those after the ``per_class_bytes`` that come first by hash,
    stay out of the sample, so that what reaches the driver is bounded in bytes too; scoring knows no such bound.
    All of the sample trains the net; the thresholds are set by the logits that
    nets trained on two thirds of it give to the last one.  Rows with a null text or label are left out.  Returns None where a label has
    no rows at all: everything then scores 0.
    """
    text = F.col(text_col).cast("string")
    rows = train.where(text.isNotNull() & F.col(label_col).isNotNull() & (F.octet_length(text) <= longest))
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), (F.col(label_col) > 0).cast("int").alias("y"), text.alias("t"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a batch: hashes, labels and texts of its rows, and the words that the texts are numbers of."""
        known = Tokens()
        for b in batches:
            number: dict[bytes, int] = {}
            texts = [np.array([number.setdefault(known[w], len(number)) for w in _LETTERS.findall(t.lower())], np.int32).tobytes() for t in each(b.column(2))]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (b.column(0).to_pylist(), b.column(1).to_pylist(), texts, b"".join(number))], schema=shape)

    shape = pa.schema([("h", pa.list_(pa.int64())), ("y", pa.list_(pa.int32())), ("d", pa.list_(pa.binary())), ("w", pa.binary())])
    few = materialise(lowest(rows, "y", "h", per_class), "toxic-few")
    # At most per_class texts of a label: equal ids keep the first text, then bytes are added up by hash.
    chosen = rows.join(broadcast_if_small(few), ["y", "h"]).groupBy("y", "h").agg(F.min("t").alias("t"))
    upto = F.sum(F.octet_length("t")).over(Window.partitionBy("y").orderBy(F.shiftrightunsigned("h", 11), "h"))
    chosen = chosen.withColumn("_upto", upto).where(F.col("_upto") <= per_class_bytes).select("h", "y", "t")
    sample = chosen.mapInArrow(tokens, "h array<long>, y array<int>, d array<binary>, w binary").toArrow().to_pylist()
    h, y = (np.array([x for r in sample for x in r[c]], np.int64) for c in ("h", "y"))
    if not len(y) or y.min() == y.max():
        return None
    words, docs = numbered((r["w"], r["d"]) for r in sample)
    del sample
    _give_back()  # the sample's copies would stay in the driver throughout training
    order = np.lexsort((y, h))
    net = learn([docs[i] for i in order], y[order], words)
    docs.clear()
    _give_back()
    return net


def _give_back() -> None:
    """Hand memory that is free now back to the system, where the C library can, so that the driver doesn't keep it for all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def score(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """Score every whole text: id, carried columns, score (0 to 1) and predicted (score >= 0.5).

    A null or empty text has no tokens and scores as the network scores padding;
    equal texts score equally; with no network everything scores 0.  Repeated and
    null ids keep their own rows; an empty table gives an empty one; columns of
    the input other than the id come only if carried, under any name.
    """
    carry = carry or {}
    src = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col), *(c.alias(n) for n, c in carry.items()))
    kept = [f for f in src.schema.fields if f.name != "_text"]
    names = [*(f.name for f in kept), "score", "predicted"]

    def blocks(texts: Iterable[str], known: Tokens, most: int = 100_000) -> Iterator[list[np.ndarray]]:
        block, size = [], 0
        for t in texts:
            block.append(known.of(t))
            size += len(block[-1])
            if size > most:
                yield block
                block, size = [], 0
        if block:
            yield block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for b in batches:
            s = np.concatenate([net.scores(block) for block in blocks(each(b.column(0)), known)]) if net and len(b) else np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=names)

    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, predicted int")


def train_on(docs: DataFrame, labels: DataFrame, folds: int = 5, hold: int = 0, per_class: int = 3000) -> Net | None:
    """Fit on the labelled documents outside fold ``hold``; of several labels of a document the highest counts.

    The sample is ``fit``'s, of at most ``per_class`` rows a label.  Labels are joined to ids first, and only texts of a chosen few ids go on, so
    that no other text is shuffled.
    """
    one = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic")).where("_toxic IS NOT NULL")
    some = docs.where(id_bucket("doc_id", folds) != hold).select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = some.where("text IS NOT NULL").select("doc_id").join(one, F.col("doc_id") == F.col("_id"))
    ids = materialise(ids.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), (F.col("_toxic") > 0).cast("int").alias("_y")), "toxic-ids")
    chosen = ids.join(broadcast_if_small(materialise(lowest(ids, "_y", "h", per_class), "toxic-chosen")), ["_y", "h"]).select(F.col("doc_id").alias("_id"), F.col("_y").alias("_toxic")).distinct()
    return fit(some.join(broadcast_if_small(materialise(chosen, "toxic-labels")), F.col("doc_id") == F.col("_id")), label_col="_toxic", per_class=per_class)
