import random
import time

import pytest

from pairlight.llm import linededup


def distance_at_most_1(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def brute(docs, bound, least):
    seen, out = [], {}
    for d, text in sorted(docs):
        left = []
        for raw in text.split("\n"):
            line = raw.strip(" ")
            if len(line) >= least:
                near = any(line == x or (bound and distance_at_most_1(line, x)) for x in seen)
                if line not in seen:
                    seen.append(line)
                if near:
                    continue
            left.append(raw)
        out[d] = "\n".join(left)
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdé \U0001f600") for _ in range(rng.choice([5, 8, 9, 12, 30, 61]))) for _ in range(30)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.randrange(len(x) + 1)
                x = rng.choice([x[:i] + "z" + x[i:], x[:i] + x[i + 1 :], x[:i] + "y" + x[i + 1 :]])
            lines.append(rng.choice(["", " "]) + x)
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, n_lines string")
    for bound in (0, 1):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(df, bound, 8).collect()}
        assert got == brute(docs, bound, 8)


@pytest.mark.filterwarnings("ignore:overflow")
def test_variants_meet_exactly_within_one_edit():
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)}
    pieces = {w: list(linededup.variants(w, 1)) for w in words}
    keys = {w: {x for k, _ in p for x in k.tolist()} for w, p in pieces.items()}
    owner = {w: next(int(k[0]) for k, itself in p if itself.any()) for w, p in pieces.items()}
    for a in words:
        for b in words:
            shared = keys[a] & keys[b]
            if distance_at_most_1(a, b):
                assert shared
            elif shared:  # two lines may meet at a third line's key; neither owns it
                assert owner[a] not in shared and owner[b] not in shared


def test_edges(spark):
    rows = [(None, "a long line that repeats itself"), (3, None), (4, ""), (5, "a long line that repeats itself\nx"), (6, "a long line that repeats itself"), (6, "a long line that repeats itself")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, linededup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, rows[0][1], 1, 0), (3, None, 0, 0), (4, "", 1, 0), (5, rows[3][1], 2, 0), (6, "", 1, 1), (6, "", 1, 1)], key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_ids_with_other_texts(spark):
    line, other = "a long line that repeats itself", "another quite long line of text"
    rows = [(1, f"{line}\nx"), (2, line), (2, f"{other}\n{line}"), (3, other), (3, other)]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], "doc_id long, text string, _d int, _t int, _stay int, `_kept.x` int")
    got = linededup.dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, f"{line}\nx"), (2, ""), (2, other), (3, ""), (3, "")]


def test_string_ids_and_null_ids(spark):
    line = "a long line that repeats itself"
    df = spark.createDataFrame([("b", line), ("a", line), (None, line)], "doc_id string, text string")
    assert sorted(map(str, (r.doc_id if r.text else f"-{r.doc_id}" for r in linededup.dedup_lines(df).collect()))) == ["-b", "None", "a"]


@pytest.mark.filterwarnings("ignore:overflow")
def test_pieces_give_the_keys_of_the_whole(monkeypatch):
    line = "".join(random.Random(9).choice("abc\u00e9") for _ in range(1000))
    whole = {x for k, _ in linededup.variants(line, 1) for x in k.tolist()}
    monkeypatch.setattr(linededup, "PIECE", 64)
    parts = list(linededup.variants(line, 1))
    assert len(parts) == 17 and {x for k, _ in parts for x in k.tolist()} == whole


def test_a_text_of_very_many_lines(spark):
    n = 200_000
    lines = [f"line number {i:08d} of a long log" if i % 3 else "short" for i in range(n)]
    lines[7] = lines[1]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, lines[4] + "\nown words of the second text")], "doc_id long, text string")
    start = time.perf_counter()
    got = {r.doc_id: r for r in linededup.dedup_lines(df, bound=0).collect()}
    assert time.perf_counter() - start < 60
    assert got[1].n_removed == 1 and got[1].text == "\n".join(lines[:7] + lines[8:])
    assert got[2].text == "own words of the second text"


def test_very_long_lines(spark):
    line = "".join(random.Random(5).choices("abcdefgh ", k=600_000))
    near = line[:300_000] + "X" + line[300_001:]
    df = spark.createDataFrame([(1, line), (2, near), (3, line[:300_000])], "doc_id long, text string")
    assert {r.doc_id: len(r.text) for r in linededup.dedup_lines(df).collect()} == {1: 600_000, 2: 0, 3: 300_000}
