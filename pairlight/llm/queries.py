"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.llm import centroids, kneser_ney, langid, linededup, media, mixing, neardup, packing, quality, secrets, toxicity, trie, vectordup
from pairlight.llm.common import id_bucket, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lines.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.md5(F.col("text")).alias("text_md5"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), width=4, per_hundred=80)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_bucket("doc_id", 7) == 2
    model = kneser_ney.train(docs.where(~held))
    return kneser_ney.score(docs, model, carry={"held_out": held})


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, carry={"held_out": id_bucket("doc_id", 5) == 0})


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = media.image_columns(table(spark, sf_dir, "documents"))
    return cols.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "at", "rule", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, salt="3")


def op12_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.link(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie.trie(trie.rebuild(trie.sequences(table(spark, sf_dir, "conversations")), family=20, most=4))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# What of operators 4, 6 and 8 SQL can express.


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = quality.measure(table(spark, sf_dir, "documents"))
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") <= 3).alias("within"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.image_columns(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_line_dedup, op3_minhash_neardup, op4_quality_rules, op5_lm_scoring, op6_source_mixing, op7_toxicity, op8_media_columns, op9_secret_scan, op10_language_id, op11_centroid_clustering, op12_embedding_neardup, op13_prefix_trie, quality_base_columns, mixing_targets, media_payloads)}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
#: CRC-32 of a list of bytes, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295, {0}), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Rounds written out one after the other; vectors and centroids have a row a component."""
    usable = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64"
    near = lambda r: f"""d{r} AS MATERIALIZED (SELECT vec_id, c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (j) GROUP BY vec_id, c),
a{r} AS MATERIALIZED (SELECT vec_id, min(d) AS d, min(c) AS c FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS low FROM d{r}) WHERE d = low GROUP BY vec_id)"""  # noqa: E731
    mean = lambda r: f"c{r + 1} AS MATERIALIZED (SELECT c.c, c.j, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x FROM c{r} c LEFT JOIN (SELECT c, j, sum(x) AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id) GROUP BY c, j) m ON m.c = c.c AND m.j = c.j)"
    steps = ",\n".join(f"{near(r)},\n{mean(r)}" for r in range(rounds))
    return f"""WITH v AS MATERIALIZED (SELECT vec_id, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS HUGEINT) AS x, generate_subscripts(embedding, 1) AS j FROM embeddings WHERE {usable}),
s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT CAST(c AS INT) AS c, j, x FROM s JOIN v USING (vec_id)),
{steps},
{near(rounds)},
h AS (SELECT c, sha256(string_agg(x, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"""


#: The others train, sample, pack or hash by functions that DuckDB lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op2_line_dedup": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
t AS (SELECT *, trim(raw, ' ') AS line FROM l),
f AS (SELECT line, min(struct_pack(d := doc_id, k := k)) AS p FROM t WHERE length(line) >= 20 GROUP BY line),
h AS (SELECT line, p, unnest([struct_pack(m := m, s := 0, x := left(line, m // 2)), struct_pack(m := m, s := 1, x := right(line, m // 2))]) AS key FROM (SELECT *, unnest([length(line), length(line) - 1]) AS m FROM f)),
c AS (SELECT DISTINCT a.line AS a, b.line AS b FROM h a JOIN h b ON a.key = b.key AND b.p < a.p WHERE abs(length(a.line) - length(b.line)) <= 1),
o AS (SELECT a, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) >= length(b) THEN b ELSE a END AS y FROM c),
near AS (SELECT DISTINCT a FROM o WHERE len(list_filter(range(1, length(x) + 1), lambda i: left(x, i - 1) || substr(x, i + 1) = CASE WHEN length(x) = length(y) THEN left(y, i - 1) || substr(y, i + 1) ELSE y END)) > 0),
kept AS (SELECT t.*, (length(t.line) < 20 OR (f.p = struct_pack(d := t.doc_id, k := t.k) AND near.a IS NULL)) AS stays FROM t LEFT JOIN f ON t.line = f.line LEFT JOIN near ON near.a = t.line),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (stays), '') AS text FROM kept GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars_kept, md5(text) AS text_md5 FROM d""",
    "op3_minhash_neardup": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_SMALL}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(ws[i : i + 3], ' '))) END AS s FROM w),
g AS (SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
x AS (SELECT rep, n, unnest(s) AS h FROM g),
p AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.h = b.h AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
reach(a, b) AS (SELECT rep, rep FROM g UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS rep, min(b) AS comp FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.comp, s.doc_id) AS component_id, s.doc_id = coalesce(c.comp, s.doc_id) AS kept FROM s LEFT JOIN g ON list_sort(s.s) = g.s LEFT JOIN c ON c.rep = g.rep""",
    "op11_centroid_clustering": _clusters_sql(),
    "op12_embedding_neardup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS comp FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(comp, vec_id) AS component_id, vec_id = coalesce(comp, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    # The reduction is CRC-32: bit by bit over the id's digits.
    "op13_prefix_trie": """WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list({'i': md5(length(role) || ':' || role || text), 'w': len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))} ORDER BY turn NULLS FIRST) AS own FROM t GROUP BY c),
z AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h FROM s),
r AS (SELECT z.c, coalesce(b.own, [])[1:z.h] || z.own[z.h + 1:] AS turns FROM z LEFT JOIN s b ON b.c = z.c - z.c % 20),
p AS (SELECT c, d, CASE WHEN d = 0 THEN '' ELSE array_to_string(list_transform(turns[1:d], lambda x: x.i), '') END AS path, CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS w, d = len(turns) AS stops FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own, string_agg(CASE WHEN stops THEN c END, ',' ORDER BY c) AS ends FROM p GROUP BY path, d),
k AS (SELECT left(path, (d - 1) * 32) AS path, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
u AS (SELECT a.path, sum(b.own) AS saved, count(*) FILTER (NOT EXISTS (SELECT 1 FROM k WHERE k.path = b.path)) AS leaves FROM n b JOIN n a ON a.d <= b.d AND left(b.path, a.d * 32) = a.path GROUP BY a.path)
SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN u ON u.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN n o ON n.d > 0 AND o.d = n.d - 1 AND o.path = left(n.path, (n.d - 1) * 32)""",
    "quality_base_columns": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM w) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "mixing_targets": f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3.0 * source_size AS top FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY top / w, source NULLS LAST) AS pos, sum(source_size) OVER () AS total, coalesce(sum(top) OVER o, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest FROM w WINDOW o AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min((total - filled) / rest, pos) FILTER (WHERE (total - filled) / rest * w <= top) AS level FROM f)
SELECT doc_id, size, source_size, round(least(CAST(level AS DOUBLE) * CAST(w AS DOUBLE), CAST(top AS DOUBLE)), 6) AS target, TRUE AS within FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source, v""",
    "media_payloads": f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, length(h) // 2 AS n, h || repeat('00', CAST(greatest(64, (length(h) // 2 + 63) // 64 * 64) - length(h) // 2 AS BIGINT)) AS h FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(length(h) // 2 AS BIGINT) AS payload_bytes, sha256(unhex(h)) AS payload_sha256, {_CRC.format("list_transform(range(64), lambda i: CAST('0x' || substr(right(h, 128), 2 * i + 1, 2) AS BIGINT))")} AS tail_crc32 FROM p""",
}
