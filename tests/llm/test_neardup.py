import random

import numpy as np
import pytest

from pairlight.llm import neardup


def brute(texts: dict[int, str | None], width: int, per_hundred: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= per_hundred * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def corpus(seed: int) -> dict[int, str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts: dict[int, str | None] = {0: None, 1: "", 2: " \n\t", 3: "one two", 4: "One  TWO", 5: "one two three"}
    for base in range(25):
        words = [word() for _ in range(rng.choice([6, 40, 150, 600]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3]) * len(own) // 60):
                own[rng.randrange(len(own))] = word()
            texts[len(texts)] = " ".join(own)
    return texts


@pytest.mark.parametrize(("width", "block"), [(4, 1_000_000), (5, 900)])
def test_link_equals_brute_force(spark, width, block):
    texts = corpus(width)
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in neardup.link(docs, width=width, block_shingles=block).collect()}
    want = brute(texts, width, 80)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == want[i]) for i, r in got.items())
    assert [got[i].n_shingles for i in range(6)] == [0, 0, 0, 1, 1, 1]


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, neardup.link(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False)], key=str)
    assert sorted(r.doc_id or 0 for r in neardup.drop_near_duplicates(docs).collect()) == [0, 1, 1]
    assert neardup.link(docs.limit(0)).count() == 0


def test_small_hash_collision_rate():
    """Two sets at 0.8 share a pair of small hashes nearly always."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        u = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        a, b = neardup.small_hashes(np.sort(u[:162])), neardup.small_hashes(np.sort(u[18:]))
        same = a == b
        missed += not (same[: neardup.SIDE].any() and same[neardup.SIDE :].any())
    assert missed <= 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.comp for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, **{i: 200 for i in range(200, 260)}}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ids_of_any_ordered_type(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base + " end", "x " + base, "quite another text of some few words", None, ""]
    for kind, ids in (("string", list("fedcba")), ("long", [-(2**63), 2**63 - 1, 5, 4, 3, None]), ("int", [6, 5, 4, 3, 2, 1])):
        df = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], f"doc_id {kind}, text string, _gone int")
        got = {r.doc_id: r.component_id for r in neardup.link(df).collect()}
        assert got[ids[0]] == got[ids[1]] == got[ids[2]] == min(ids[:3]) and got[ids[3]] == ids[3]
        left = neardup.drop_near_duplicates(df)
        assert left.columns == df.columns and left.count() == 4
