"""Language ID held against plain loops: grams, TF-IDF, centroids and the nearest of them."""

import math
import random

import numpy as np
import pytest

from pairlight.llm import langid

WORDS = {"en": "the cat sat on a mat near this old house and it was late", "de": "die katze sa\u00df auf der matte und es war sp\u00e4t im haus", "fr": "le chat \u00e9tait assis sur un tapis pr\u00e8s de la vieille maison"}


def plain_grams(text, dims):
    """A count for each bucket, gram by gram."""
    data = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode())
    data = b" " + b" ".join(data.split()) + b" "
    out = [0] * dims
    bits = 32 - int(math.log2(dims))
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if n == 1 and gram == b" ":
                continue
            h = 0
            for b in gram:
                h = (h * 257 + b + 1) % 2**32 if h else b + 1
            out[((h * 2654435761) % 2**32 ^ (n * 0x9E3779B9) % 2**32) >> bits] += 1
    return out


def unit(v):
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def plain_centroids(x, k, steps=12):
    """Seeds far from one another, then assignment and mean in turn."""
    mean = [sum(c) / len(x) for c in zip(*x, strict=True)]
    seeds = [max(range(len(x)), key=lambda i: dot(x[i], mean))]
    while len(seeds) < min(k, len(x)):
        seeds.append(min(range(len(x)), key=lambda i: max(dot(x[i], x[s]) for s in seeds)))
    c = [x[s] for s in seeds]
    for _ in range(steps):
        own = [max(range(len(c)), key=lambda j: dot(v, c[j])) for v in x]
        c = [unit([sum(t) for t in zip(*(v for v, o in zip(x, own, strict=True) if o == j), strict=True)]) if j in own else c[j] for j in range(len(c))]
    return c


def test_against_plain_loops(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(3, 12))), lang) for i in range(36) for lang in [rng.choice(sorted(WORDS))]]
    dims = 256
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), dims=dims, centroids=2, per_lang=600, quantile=0.0)
    grams = {i: plain_grams(t, dims) for i, t, _ in rows}
    assert all(langid.gram_counts(t, dims).tolist() == grams[i] for i, t, _ in rows)
    idf = [math.log((1 + len(rows)) / (1 + sum(g[d] > 0 for g in grams.values()))) + 1 for d in range(dims)]
    assert model["idf"].tolist() == pytest.approx(idf)
    vec = lambda g: unit([math.log1p(n) * w for n, w in zip(g, idf, strict=True)])
    asked = rows + [(100 + i, " ".join(rng.choices(sum((w.split() for w in WORDS.values()), []), k=6)), None) for i in range(20)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    cents = model["centroids"].astype(float)
    for i, text, _ in asked:
        sims = [dot(vec(plain_grams(text, dims)), c) for c in cents.tolist()]
        best = int(np.argmax(sims))
        assert got[i].score == pytest.approx(min(1.0, sims[best]), abs=1e-5)
        assert got[i].lang_pred in {model["langs"][model["own"][j]] for j in range(len(sims)) if sims[j] > sims[best] - 1e-5}
        assert got[i].rejected == (got[i].score < model["reject"][model["langs"].index(got[i].lang_pred)])
    # The clustering itself, on the vectors of one language in a given order.
    x = [vec(grams[i]) for i, _, lang in rows if lang == "de"]
    assert langid._cluster(np.array(x), 3).tolist() == [pytest.approx(c) for c in plain_centroids(x, 3)]
    # Nothing of the sample lies below a limit that is its least cosine.
    assert not any(got[i].rejected for i, _, lang in rows if got[i].lang_pred == lang and got[i].score > model["reject"][model["langs"].index(lang)] + 1e-5)


def test_many_languages_in_blocks(spark):
    """A model in several stored blocks gives what the same model in one block gives; ties go to the first language."""
    rng = random.Random(11)
    rows = []
    for k in range(30):
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(rng.choices(own, k=8)), f"l{k:02}") for i in range(4)]
    twin = [(9000 + i, t, "zz") for i, (_, t, lang) in enumerate(rows) if lang == "l07"]  # the same texts under two names
    train = spark.createDataFrame(rows + twin, "doc_id long, text string, lang string").repartition(4)
    asked = spark.createDataFrame([(i, t, None) for i, (_, t, _) in enumerate(rows)] + [(-1, None, None), (-2, "", None), (-3, "12 34", None), (None, rows[0][1], None)], "doc_id long, text string, lang string")
    whole = langid.fit(train, dims=256, centroids=2)
    parts = langid.fit(train, dims=256, centroids=2, block_langs=5)
    assert "stored" not in whole and parts["blocks"] == 7
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    one, many = (sorted(langid.predict(asked, m).collect(), key=key) for m in (whole, parts))
    assert [(r.doc_id, r.lang_pred) for r in one] == [(r.doc_id, r.lang_pred) for r in many]
    limit = dict(zip(whole["langs"], whole["reject"], strict=True))
    clear = [r.lang_pred == "und" or abs(r.score - limit[r.lang_pred]) > 1e-5 for r in one]  # else the last digit decides
    assert all(a.rejected == b.rejected for a, b, c in zip(one, many, clear, strict=True) if c)
    assert [r.score for r in one] == pytest.approx([r.score for r in many], abs=1e-6)
    got = {r.doc_id: r for r in many}
    assert {got[i].lang_pred for i, (_, _, lang) in enumerate(rows) if lang == "l07"} == {"l07"}
    assert sum(got[i].lang_pred == lang for i, (_, _, lang) in enumerate(rows)) > 0.95 * len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (-1, -2, -3))


def test_empty_tables(spark):
    """No row to learn from gives und to all; no row to predict gives none, in one block or several."""
    schema = "doc_id long, text string, lang string, score double"
    rows = spark.createDataFrame([(i, f"text {chr(97 + i)}", f"l{i}", 0.5) for i in range(6)], schema)
    none = rows.where("false")
    empty = langid.fit(none, dims=64)
    assert [(r.lang_pred, r.score, r.rejected) for r in langid.predict(rows, empty).collect()] == [("und", 0.0, True)] * 6
    for size in (256, 2):
        out = langid.predict(none, langid.fit(rows, dims=64, block_langs=size))
        assert out.columns == ["doc_id", "lang_pred", "score", "rejected"] and not out.collect()
