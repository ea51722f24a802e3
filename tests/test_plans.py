import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairlight.plans import answers as A
from pairlight.plans import prompts as P
from pairlight.plans import specs as S
from pairlight.plans.cards import cards, formatter
from pairlight.sources import jobs as J
from pairlight.streaming import requests as Q


def test_number_formats(spark):
    df = spark.createDataFrame([(0.1235, ".3f", "0.123"), (-0.0005, ".3f", "-0.001"), (87.0, "g", "87"), (1234567.0, "g", "1.23457e+06"), (0.05, ".2g", "0.05"), (0.000012, ".2g", "1.2e-05")], "x double, f string, want string")
    for spec in (".3f", "g", ".2g"):
        assert all(r.got == r.want for r in df.where(F.col("f") == spec).select("want", formatter(spec)(F.col("x")).alias("got")).collect())


def test_specs(spark):
    rows = [
        ("a", "q", '```json\n{"mirna":"miR-1","k":"7.9","cancer":null,"filters":null}\n```'), ("b", "q", 'so {"gene":"TP53","k":7.9,"mode":"gene_to_mirnas","pathway_keywords":["x"]} then'),
        ("c", "q", "```{}```"), ("d", " ", '{"mirna":"miR-1"}'), ("e", "q", "nothing"), ("f", "q", '{"mirna":""}'), ("g", None, None), ("h", "q", '{"mirna":"miR-1","k":-3}'),
    ]
    good, bad = S.split_rejects(S.normalise_specs(spark.createDataFrame(rows, "query_id string, question string, response string")))
    got = {r.query_id: r for r in good.collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].k, got["a"].token, got["a"].cohort, got["a"].filters.min_support) == (50, "miR-1", None, 1)
    assert (got["b"].k, got["b"].mode, got["b"].pathway_keywords) == (7, "gene_to_mirnas", ["x"])
    assert {r.query_id for r in bad.collect()} == set("cdefgh")


def test_request_ids_replay(spark):
    df = spark.createDataFrame([(None, "x"), ("given", "x"), (None, "y")], "query_id string, question string")
    one, two = ([r.query_id for r in S.request_defaults(df).collect()] for _ in range(2))
    assert one == two and one[1] == "given" and len(one[0]) == 16 and one[0] != one[2]


def test_cards(spark):
    df = spark.createDataFrame(
        [("miR-1", "A", 3, 1, 1, 87.0, 2, list("abcdefg"), -0.1235, 0.05), (None, "B", None, 0, 0, None, None, None, None, None), (None, None, 1, None, 0, None, None, None, 0.2, 0.9)],
        "mirna_name string, gene_symbol string, support_count int, mirtarbase_pos int, support_encori int, clip_exp_sum double, n_clip_sites int, cellline_tissue_set array<string>, X_spearman_rho double, X_spearman_p double",
    )
    a, b, c = cards(df, "x").collect()
    assert a.name == "A (← miR-1)" and b.name == "B" and c.name == "UNKNOWN"
    assert a.evidence == "support_count=3; miRTarBase(functional=1); ENCORI(CLIP_sum=87, sites=2); TCGA(X anti_corr=1, rho=-0.123, p=0.05)"
    assert a.notes == "ENCORI tissues: a, b, c, d, e, f ..." and b.notes is None
    assert b.evidence == "support_count=0; miRTarBase(functional=0); TCGA(X anti_corr=0)"


def test_prompts(spark):
    specs = spark.createDataFrame([("1", "gene_to_mirnas", "why?", True), ("2", None, None, None)], "query_id string, mode string, original_question string, novel boolean")
    own = spark.createDataFrame([("1", 2, "n2", "e2", None), ("1", 1, "n1", "e1", "note")], "query_id string, rank int, name string, evidence string, notes string")
    one, two = P.prompts(specs, cards=own).orderBy("query_id").collect()
    assert one.user_prompt.endswith("Candidate: n1\nEvidence: e1\nNotes: note\n\nCandidate: n2\nEvidence: e2")
    assert "microRNAs" in one.user_prompt and "- nothing given" in two.user_prompt and two.user_prompt.endswith("Cards:\n\n")
    with pytest.raises(ValueError):
        P.prompts(specs)


def test_answers(spark):
    shapes = ['"text"', '{"summary":"s"}', '{"raw_text":"r"}', '{"raw_text":{"summary":"s"}}', '{"raw_text":{"raw_text":"r"}}', '{"raw_text":{"raw_text":{"summary":"s"}}}', '{"raw_text":{"raw_text":{"raw_text":"r"}}}', '{"summary":5}', "{}", None, '{"summary":" ","raw_text":" r "}']
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(shapes)], "query_id string, answer string")
    assert [r.summary for r in A.extract_summaries(df).collect()] == ["text", "s", "r", "s", "r", "s", "r", None, None, None, " r "]
    assert A.envelope(spark.createDataFrame([("1", "t")], "query_id string, text string")).first().asDict() == {"query_id": "1", "raw_text": "t", "summary": "t", "suggested_experiments": []}


def test_jobs(spark):
    short = spark.createDataFrame([("1", 2, "b", ["x"]), ("1", 1, "a", None)], "query_id string, rank int, gene string, tags array<string>")
    nested = J.nest_shortlist(short)
    assert sorted(map(tuple, J.unnest_shortlist(nested).collect()), key=str) == sorted(map(tuple, short.collect()), key=str)
    docs = {r.query_id: json.loads(r.document) for r in J.result_documents(spark.createDataFrame([("1", 5), ("2", 6)], "query_id string, k int"), nested).collect()}
    assert docs["1"]["shortlist"][1]["tags"] == ["x"] and docs["2"] == {"status": "done", "queryspec": {"k": 6}, "shortlist": []}
    log = spark.createDataFrame([("1", "queued", 0), ("1", "done", 2), ("1", "running", 1), ("3", None, 1)], "query_id string, status string, seq long")
    ids = spark.createDataFrame([("1",), ("2",), ("3",)], "query_id string")
    assert {r.query_id: r.status for r in J.latest_status(log, ids).collect()} == {"1": "done", "2": "unknown", "3": "running"}
    assert json.loads(J.error_records(spark.createDataFrame([("9", "bad")], "query_id string, error string")).first().document) == {"status": "error", "error": "bad"}


def test_stream_replays_add_nothing(spark, tmp_path):
    box, out, log, state = (str(tmp_path / n) for n in ("in", "out", "log", "state"))
    put = lambda i: spark.range(i, i + 3).selectExpr("CAST(id AS STRING) AS query_id", "'q' AS question").coalesce(1).write.mode("append").json(box)
    answer = lambda df: df.select("query_id", F.lit(1).alias("n"))
    put(0)
    for want in (3, 3):
        Q.serve(Q.read_requests(spark, box), answer, out, log, state).awaitTermination()
        assert spark.read.parquet(out).count() == want
    put(3)
    Q.serve(Q.read_requests(spark, box), answer, out, log, state).awaitTermination()
    assert spark.read.parquet(out).count() == 6
    status = J.latest_status(spark.read.parquet(log), spark.range(7).selectExpr("CAST(id AS STRING) AS query_id"))
    assert sorted((r.query_id, r.status) for r in status.collect()) == [*((str(i), "done") for i in range(6)), ("6", "unknown")]


def test_failing_answers_are_told_and_the_stream_goes_on(spark, tmp_path):
    box, out, log, state = (str(tmp_path / n) for n in ("in", "out", "log", "state"))
    spark.createDataFrame([("1", "q", 5), ("2", " ", 5), ("3", "q", -1)], "query_id string, question string, k int").coalesce(1).write.json(box)
    broken = lambda df: df.select(F.raise_error(F.lit("no such thing")).alias("x"))
    Q.serve(Q.read_requests(spark, box), broken, out, log, state).awaitTermination()
    rows = {r.query_id: r for r in spark.read.parquet(log).where("status = 'error'").collect()}
    assert "no such thing" in rows["1"].error and "Traceback" in rows["1"].traceback
    assert (rows["2"].error, rows["3"].error) == ("question is empty", "k is negative")
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "query_id string")
    assert {r.query_id: r.status for r in J.latest_status(spark.read.parquet(log), ids).collect()} == {"1": "error", "2": "error", "3": "error", "4": "unknown"}


def test_cohort_of_old_replies(spark):
    rows = [("a", "q", '{"mirna":"miR-1","tcga":"coad"}'), ("b", "q", '{"mirna":"miR-1","tcga":"coad","cancer":{"tcga":"brca"}}'), ("c", "q", '{"mirna":"miR-1","tcga":"coad","cancer":{}}'), ("d", "q", '{"mirna":"miR-1","tcga":"coad","cancer":"x","k":true,"novel":"false"}')]
    got = {r.query_id: r for r in S.normalise_specs(spark.createDataFrame(rows, "query_id string, question string, response string")).collect()}
    assert {k: r.cohort for k, r in got.items()} == {"a": "COAD", "b": "BRCA", "c": None, "d": "COAD"}
    assert got["d"].k == 1 and got["d"].novel is False


def test_chain_reads_each_input_once(spark, sf, tmp_path):
    from pairlight import queries as E
    from pairlight.plans.chain import job_documents
    from pairlight.sources.evidence import prepare

    requests = spark.createDataFrame([("1", "q", 5), ("2", "q", -1), ("3", " ", 5), ("4", "q", 7)], "query_id string, question string, k int")
    responses = spark.createDataFrame([("1", '{"mirna":"miR-12"}'), ("2", '{"gene":"GENE3"}'), ("3", "{}"), ("5", "{}")], "query_id string, response string")
    requests.write.parquet(f"{tmp_path}/requests")
    docs = job_documents(prepare(E.evidence(spark, sf)), spark.read.parquet(f"{tmp_path}/requests"), responses, folder=f"{tmp_path}/stages")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and f"{tmp_path}/requests" not in plan
    got = {r.query_id: json.loads(r.document) for r in docs.collect()}
    assert got["1"]["status"] == "done" and len(got["1"]["shortlist"]) == 5 and got["1"]["bundle"]["user_prompt"].count("Candidate:") == 5
    assert {i: got[i]["error"] for i in "234"} == {"2": "k is negative", "3": "question is empty", "4": "response holds no JSON object"}
    assert spark.read.parquet(f"{tmp_path}/stages/shortlist").count() == 5


def test_documents_are_replaced_by_id(spark, tmp_path):
    path = f"{tmp_path}/docs"
    docs = lambda ids, text: spark.createDataFrame([(str(i), f"{text} {i}") for i in ids], "query_id string, document string")
    J.put_documents(docs(range(40), "old"), path, 16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "docs").glob("bucket=*/*.json")}
    J.put_documents(docs([7], "new"), path, 16)
    J.put_documents(docs([7], "new"), path, 16)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "docs").glob("bucket=*/*.json")}
    assert len({p.parent for p in set(before) - set(after)}) == 1 and all(after[p] == before[p] for p in set(before) & set(after))
    assert {r.query_id: r.document for r in J.read_documents(spark, path).collect()} == {str(i): f"{'new' if i == 7 else 'old'} {i}" for i in range(40)}
    one = J.read_documents(spark, path, "7", 16)
    assert [r.document for r in one.collect()] == ["new 7"] and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    assert J.read_documents(spark, path, "99", 16).count() == 0
    J.put_documents(docs([], "none"), path, 16)
    assert J.read_documents(spark, path).count() == 40


def test_snapshots_of_the_status_log(spark, tmp_path):
    log, snap = f"{tmp_path}/log", f"{tmp_path}/snapshot"
    kind = "query_id string, status string, seq long, error string, traceback string"

    def batch(n, part, *rows):
        spark.createDataFrame([(*r, None, None) for r in rows], kind).write.mode("overwrite").parquet(f"{log}/batch_id={n}/part={part}")

    ids = spark.createDataFrame([(x,) for x in "abcz"], "query_id string")
    told = lambda: {r.query_id: r.status for r in J.status_of(spark, log, snap, ids, 4).collect()}
    batch(0, "begin", ("a", "queued", 0), ("b", "queued", 0))
    assert J.compact_status(spark, log, snap, 4) == -1  # nothing is finished yet
    assert told() == {"a": "queued", "b": "queued", "c": "unknown", "z": "unknown"}
    batch(0, "end", ("a", "done", 2), ("b", "error", 2))
    assert J.compact_status(spark, log, snap, 4) == 0 and J.compact_status(spark, log, snap, 4) == 0
    batch(1, "begin", ("c", "queued", 4), ("b", "queued", 4))
    assert told() == {"a": "done", "b": "queued", "c": "queued", "z": "unknown"}
    batch(1, "end", ("c", None, 6), ("b", "done", 6))
    assert J.compact_status(spark, log, snap, 4) == 1
    assert told() == {"a": "done", "b": "done", "c": "running", "z": "unknown"}
    asked = J.status_of(spark, log, snap, ids, 4)
    assert "(batch_id#" in asked._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1]
    assert {x.split("upto=")[1][0] for x in asked.inputFiles() if "upto=" in x} == {"1"}


def test_resent_requests_are_answered_once(spark, tmp_path):
    box, out, log, state = (str(tmp_path / n) for n in ("in", "out", "log", "state"))
    put = lambda *texts: spark.createDataFrame([(t,) for t in texts], "question string").coalesce(1).write.mode("append").json(box)
    answer = lambda df: df.select("query_id", "question")
    for sent, want in ((("x", "y", "x"), ["x", "y"]), (("x", "z"), ["x", "y", "z"])):
        put(*sent)
        Q.serve(Q.read_requests(spark, box), answer, out, log, state).awaitTermination()
        assert sorted(r.question for r in spark.read.parquet(out).collect()) == want
    again = str(tmp_path / "all")
    Q.serve(Q.read_requests(spark, box), answer, again, log, f"{state}2", remember=None).awaitTermination()
    assert spark.read.parquet(again).count() == 5


def test_chain_shares_questions_and_pairs(spark, sf, tmp_path):
    from pairlight import queries as E
    from pairlight.plans.chain import job_documents
    from pairlight.sources.evidence import prepare

    evidence = prepare(E.evidence(spark, sf)).select("mirna_name", "gene_symbol", "support_count", "mirtarbase_pos")
    requests = spark.range(300).selectExpr("CAST(id AS STRING) AS query_id", "concat('question ', id) AS question", "CAST(id % 4 AS INT) AS k")
    responses = spark.range(300).selectExpr("CAST(id AS STRING) AS query_id", """'{"mirna":"miR-12"}' AS response""")
    docs = job_documents(evidence, requests, responses, folder=f"{tmp_path}/stages")
    got = {r.query_id: json.loads(r.document) for r in docs.collect()}
    assert all(len(got[str(i)]["shortlist"]) == i % 4 and got[str(i)]["queryspec"]["original_question"] == f"question {i}" for i in range(300))
    assert spark.read.parquet(f"{tmp_path}/stages/pairs").count() == evidence.distinct().count()


def stored_pairs(spark):
    """Numbers of pairs that the queries of this session have stored so far, by folder."""
    top = spark.conf.get("spark.checkpoint.dir")
    return {p.name: spark.read.parquet(str(p)).count() for p in Path(top).glob("pairs-*")}


def test_streamed_jobs_share_questions_and_pairs(spark, tmp_path):
    box, docs, log, state = (str(tmp_path / n) for n in ("in", "docs", "log", "state"))
    evidence = spark.range(100).selectExpr("'miR-1' AS mirna_name", "concat('G', id % 5) AS gene_symbol", "CAST(id % 2 AS INT) AS mirtarbase_pos", "3 AS support_count")
    spark.range(60).selectExpr("CAST(id AS STRING) AS query_id", "'q' AS question", "CAST(id % 4 AS INT) AS k").coalesce(1).write.json(box)
    responses = spark.range(60).selectExpr("CAST(id AS STRING) AS query_id", """'{"mirna":"miR-1"}' AS response""")
    before = stored_pairs(spark)
    Q.serve_jobs(Q.read_requests(spark, box), evidence, responses, docs, log, state).awaitTermination()
    got = {r.query_id: [x["gene_symbol"] for x in json.loads(r.document)["shortlist"]] for r in J.read_documents(spark, docs).collect()}
    assert got == {str(i): [f"G{n}" for n in range(i % 4)] for i in range(60)}
    new = {k: n for k, n in stored_pairs(spark).items() if k not in before}
    assert new and set(new.values()) == {10}


@pytest.mark.parametrize("name", ["stream_requests", "stream_resent"])
def test_streamed_requests_share_pairs(spark, sf, name):
    from pairlight import queries as E

    before = stored_pairs(spark)
    E.QUERIES[name](spark, sf)
    new = {k: n for k, n in stored_pairs(spark).items() if k not in before}
    assert new and all(0 < n <= E.evidence(spark, sf).count() for n in new.values())


def test_streams_answer_what_is_new_in_the_callers_session(spark, tmp_path):
    box, out, log, state = (str(tmp_path / n) for n in ("in", "out", "log", "state"))
    put = lambda *texts: spark.createDataFrame([(t,) for t in texts], "question string").coalesce(1).write.mode("append").json(box)
    serve = lambda: Q.serve(Q.read_requests(spark, box), answer, out, log, state, state_parts=2).awaitTermination()
    settings = ("spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled")
    before, seen = [spark.conf.get(c) for c in settings], []

    def answer(batch):
        seen.append((sorted(r.question for r in batch.collect()), batch.sparkSession.conf.get("spark.sql.adaptive.enabled"), batch.sparkSession.conf.get(settings[0])))
        return batch.select("query_id", "question")

    for texts in (("x", "y"), ("y", "x"), ("y", "z")):
        put(*texts)
        serve()
    assert seen == [(["x", "y"], "true", before[0]), (["z"], "true", before[0])]
    assert sorted(r.question for r in spark.read.parquet(out).collect()) == ["x", "y", "z"]
    assert len(list((tmp_path / "state/state/0").glob("[0-9]*"))) == 2 and [spark.conf.get(c) for c in settings] == before


def test_streams_of_nothing_leave_their_folders(spark, tmp_path):
    box, out, log, state = (str(tmp_path / n) for n in ("in", "out", "log", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/none.json").touch()
    Q.serve(Q.read_requests(spark, box), lambda df: df.select("query_id", F.lit(1).alias("n")), out, log, state).awaitTermination()
    assert spark.read.parquet(out).columns == ["query_id", "n", "batch_id"] and spark.read.parquet(log).count() == 0


def test_batches_of_jobs_share_pairs(spark, tmp_path):
    box, docs, log, state = (str(tmp_path / n) for n in ("in", "docs", "log", "state"))
    evidence = spark.range(100).selectExpr("'miR-1' AS mirna_name", "concat('G', id % 5) AS gene_symbol", "0 AS mirtarbase_pos", "3 AS support_count")
    spark.range(40).selectExpr("CAST(id AS STRING) AS query_id", "'q' AS question", "2 AS k").repartition(2).write.json(box)
    responses = spark.range(40).selectExpr("CAST(id AS STRING) AS query_id", """'{"mirna":"miR-1"}' AS response""")
    before = stored_pairs(spark)
    stream = spark.readStream.schema("query_id string, question string, k int").option("maxFilesPerTrigger", 1).json(box)
    Q.serve_jobs(stream, evidence, responses, docs, log, state).awaitTermination()
    got = {r.query_id: [x["gene_symbol"] for x in json.loads(r.document)["shortlist"]] for r in J.read_documents(spark, docs).collect()}
    assert got == {str(i): ["G0", "G1"] for i in range(40)}
    assert spark.read.parquet(log).where("part = 'end'").select("batch_id").distinct().count() == 2
    assert [n for k, n in stored_pairs(spark).items() if k not in before] == [5]


def test_resent_requests_share_pairs(spark, sf):
    from pairlight import queries as E

    before = stored_pairs(spark)
    E.QUERIES["stream_resent"](spark, sf)
    assert len(stored_pairs(spark).keys() - before.keys()) == 1
