import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlight.llm import centroids, queries, radix, trie, vectordup
from pairlight.llm.walsh import coarse_to_fine, transform

NAN, INF = math.nan, math.inf
VECTORS = "vec_id long, embedding array<double>, cluster int, nid int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS)


def test_transform_is_exact_and_ordered():
    x = np.random.default_rng(0).integers(-99, 99, (5, 64))
    w = transform(x)
    assert (transform(w) == 64 * x).all() and ((w * w).sum(1) == 64 * (x * x).sum(1)).all()
    flips = [(np.diff(transform(np.eye(64))[i]) != 0).sum() for i in coarse_to_fine(64)]
    assert flips == list(range(64))


@pytest.mark.parametrize("kind", [np.int64, object])
def test_progressive_search_equals_a_plain_one(kind):
    rng = np.random.default_rng(1)
    v = rng.integers(-40, 40, (300, 64))
    c = np.concatenate([v[:4], v[:2], rng.integers(-40, 40, (2, 64))])  # ties
    far = ((v[:, None] - c[None]) ** 2).sum(2)
    got, d = centroids.nearest(centroids.coefficients(v.astype(kind)), centroids.coefficients(c.astype(kind)))
    assert (got == far.argmin(1)).all() and (d == far.min(1)).all()


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))
    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[near(v)[1]].append(v)
        for n, vs in mine.items():
            c[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    per = defaultdict(int)
    for _, d, n in last:
        per[n] += d
    return sorted(((i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in last), key=str)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.normal(size=64) + 3 * (i % 5)).tolist()) for i in range(120)]
    rows += [(1, rows[1][1]), (None, rows[3][1]), (None, rows[4][1]), (500, rows[7][1]), (501, [0.0] * 64)]  # repeated, null ids, ties
    bad = [(600, None), (601, []), (602, [0.1] * 63), (603, [0.1] * 65), (604, [NAN] + [0.0] * 63), (605, [None] + [0.0] * 63), (606, [INF] + [0.0] * 63), (607, [1e300] + [0.0] * 63)]
    got = centroids.cluster(vectors(spark, rows + bad).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows)
    few = rows[:3]
    assert sorted(map(tuple, centroids.cluster(vectors(spark, few)).collect()), key=str) == brute_clusters(few)
    none = centroids.cluster(vectors(spark, bad))
    assert none.count() == 0 and none.columns == got.columns
    large = [(i, [x * 1e9 for x in v]) for i, v in rows[:30]]  # beyond 64-bit squares: exact, but what a long can't hold is null
    told = {r.vec_id: (r.cluster, r.distance) for r in centroids.cluster(vectors(spark, large)).collect()}
    assert told == {i: (n, d if d < 1 << 63 else None) for i, n, d, *_ in brute_clusters(large)}


def brute_links(rows, least=0.95):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    use = [(k, i, v) for k, (i, v) in enumerate(rows) if i is not None and ok(v)]
    links = defaultdict(set)
    for a, (k, _, v) in enumerate(use):
        for m, _, w in use[:a]:
            if len(v) == len(w) and vectordup.cosine_of(np.ldexp(v, -500 if max(map(abs, v)) > 1e100 else 0), np.ldexp(w, -500 if max(map(abs, w)) > 1e100 else 0)) >= least:
                links[k].add(m)
                links[m].add(k)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo += [m for m in links[todo.pop()] if m not in seen and not seen.add(m)]
        low = min(rows[m][0] for m in seen) if i is not None else None
        out.append((i, len(links[k]), low, i is None or low == i))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"per_cell": 20, "tile": 30}])
def test_links_against_brute_force(spark, options):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    rows = [(i, (base[i % 40] + rng.normal(size=64) * rng.choice([0.02, 0.2, 0.25, 0.4])).tolist()) for i in range(260)]
    rows += [(300 + i, rows[i][1]) for i in range(20)] + [(330, [3 * x for x in rows[0][1]]), (331, [x * 1e200 for x in rows[0][1]]), (332, [-x for x in rows[0][1]])]
    rows += [(5, rows[9][1]), (5, rows[5][1]), (None, rows[5][1]), (340, None), (341, []), (342, [0.0] * 64), (343, [NAN] * 64), (344, [None, 1.0]), (345, [INF, 1.0])]
    rows += [(400, [1.0]), (401, [2.0]), (402, [-1.0]), (403, [1.0, 0.0, 0.1]), (404, [1.0, 0.1, 0.0]), (405, rows[0][1][:63])]
    ones = lambda skip: [0.0 if j == skip else 1.0 for j in range(21)]
    rows += [(500 + j, ones(j)) for j in range(21)]  # cosines of exactly 19 / 20
    got = vectordup.link(vectors(spark, rows).repartition(3), **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute_links(rows)
    assert vectordup.link(vectors(spark, []), **options).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    rows = [(i, (centre + rng.normal(size=64) * 0.05).tolist() if i % 3 == 0 else rng.normal(size=64).tolist()) for i in range(3000)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectordup.link(vectors(spark, rows), per_cell=200, tile=150).collect()}
    assert all(got[i] == ((999, 0) if i % 3 == 0 else (0, i)) for i in range(3000))


def test_radix_tree_keeps_all_keys():
    rng = random.Random(5)
    keys = {bytes(rng.choice([0, 1, 255, rng.randrange(256)]) for _ in range(4 * rng.randrange(1, 5))) for _ in range(3000)} | {bytes([a, 0, 0, b]) for a in range(20) for b in range(0, 256, a + 1)} | {b""}
    order = sorted(keys, key=lambda k: hashlib.md5(k).digest())
    root = radix.Node(order[0], 0)
    for at, key in enumerate(order[1:], 1):
        root = radix.insert(root, key, at)
    seen, sizes = {}, set()
    paths = {}
    for at, (node, up, above, end) in enumerate(radix.walk(root)):
        sizes.add(node.size)
        if node.end >= 0:
            seen[order[node.end]] = end
        paths[at] = end
        assert above == (paths[up] if up >= 0 else -1)
    assert seen == {k: len(k) for k in keys} and sizes == {4, 16, 48, 256}


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((-math.inf if turn is None else turn, role or "", text or ""))
    name = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()  # noqa: E731  decides ties
    own = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0], name(x)))] for c, v in turns.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
            if d:
                kids[v[: d - 1]].add(v[:d])
        ends[v].append(c)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=str)


@pytest.mark.parametrize("size", [16_000_000, 150])
def test_trie_against_brute_force(spark, size):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", None]) if t > 2 else "user", f"w {'x ' * rng.randrange(3)}" if t > 1 else f"hello {c % 3}") for c in range(150) if c not in (40, 80) for t in range(rng.randrange(1, 7))]
    rows += [(c, None, None, None) for c in (7, 43)] + [(90, 1, "user", ""), (None, 1, "user", "nobody's")]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 280) for t in range(5)]  # a hot conversation
    rows += [(300, t, "user", f"long {t} words") for t in range(400)] + [(c, t, "user", f"long {t} words" if t < 350 else f"{c} {t}") for c in range(301, 305) for t in range(360)]
    rows += [(-3, 0, "user", "below zero"), (41, 0, "user", "turnless")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, node int, low int")
    got = trie.trie(trie.rebuild(trie.sequences(df.repartition(3))), part_bytes=size)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    told = got.collect()
    assert sorted((tuple(r[c] for c in cols) for r in told), key=str) == brute_trie(rows)
    by = {r.node: r for r in told}
    assert all(by[r.parent].conv_id == r.parent_conv_id and by[r.parent].depth == r.depth - 1 for r in told if r.depth)
    assert trie.trie(trie.rebuild(trie.sequences(df.limit(0))), part_bytes=size).count() == 0


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_minhash_neardup", "op11_centroid_clustering", "op12_embedding_neardup", "op13_prefix_trie", "quality_base_columns", "mixing_targets", "media_payloads"])
def test_queries_against_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(dict(zip(want.columns, r, strict=True))[c] for c in cols)) for r in want.fetchall())
