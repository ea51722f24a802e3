"""Operators that score row by row: empty tables, null and repeated ids, a text of megabytes, columns of clashing names."""

import hashlib
import zlib

import pytest

from pairlight.llm import kneser_ney, media, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, score double, _text string, media string, outlier string"
LONG = " ".join(f"word{i % 5000} und so" for i in range(150_000))  # about 2 MB


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "a b c a b"), (1, "a b c a b"), (None, "c d"), (None, None), (2, ""), (3, LONG), (4, "\t\n  ")]
    return spark.createDataFrame([(i, t, "en", None, -1, 0.5, "x", "y", "z") for i, t in texts], SCHEMA).repartition(3)


def by_text(rows, field):
    """The values of each (id, words) and how many rows have them."""
    out = {}
    for r in rows:
        out.setdefault((r.doc_id, r[field]), []).append(r)
    return out


def test_lm_scores(spark, docs):
    model = kneser_ney.train(docs)
    out = kneser_ney.score(docs, model)
    assert out.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    got = by_text(out.collect(), "n_tokens")
    assert {k: len(v) for k, v in got.items()} == {(1, 6): 2, (None, 3): 1, (None, 1): 1, (2, 1): 1, (3, 450_001): 1, (4, 1): 1}
    assert len({r.score for k in ((None, 1), (2, 1), (4, 1)) for r in got[k]}) == 1
    assert got[1, 6][0] == got[1, 6][1] and all(r.score < 0 for v in got.values() for r in v)
    assert kneser_ney.score(docs.where("false"), model).collect() == []


def test_images(docs):
    out = media.image_columns(docs)
    assert len(out.columns) == len(set(out.columns)) == 10
    want = sorted((str(r.doc_id), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for r in docs.collect() for d in [(r.text or "").encode()] for p in [d + bytes(-len(d) % 64 if d else 64)])
    assert sorted((str(r.doc_id), r.payload_sha256, r.tail_crc32) for r in out.collect()) == want
    assert media.image_columns(docs.where("false")).collect() == []


def test_quality_rates(docs):
    out = quality.rate(docs)
    got = by_text(out.collect(), "n_words")
    assert {k: len(v) for k, v in got.items()} == {(1, 5): 2, (None, 2): 1, (None, 0): 1, (2, 0): 1, (3, 450_000): 1, (4, 0): 1}
    assert all(r.base_failed and not r.kept for k, v in got.items() if k[1] < 10 for r in v)
    assert [r.n_repeat_words for r in got[3, 450_000]] == [450_000]  # its words come round again after 5,000
    assert quality.rate(docs.where("false")).collect() == []
