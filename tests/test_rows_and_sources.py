import json

import pytest
from pyspark.sql import functions as F

from veridraft.operators import analysis, comparison, dialect, rows
from veridraft.plans import reference
from veridraft.sources import jsonl, manifests, reports

SF = "/root/testdata/sf0.001"


def test_validation_collects_everything(spark):
    df = spark.read.parquet(f"{SF}/generation_results.parquet").limit(1)
    bad = df.withColumn("id", F.lit(" ")).withColumn("status", F.lit(None).cast("string")).withColumn("latency_ms", F.lit(-1.0)).withColumn("cost_usd", F.lit(float("nan")))
    got = {r["rule"] for r in rows.row_errors(bad).collect()}
    assert {"missing id", "status must be success or error", "latency_ms must be finite and non-negative", "cost_usd must be finite and non-negative"} <= got


def test_first_and_last(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z")], "row_seq bigint, id string, v string")
    assert sorted(r["v"] for r in rows.first_of(df, ["id"], "row_seq").collect()) == ["x", "z"]
    assert sorted(r["v"] for r in rows.first_of(df, ["id"], "row_seq", last=True).collect()) == ["y", "z"]


def test_analysis_parts_add_up(spark):
    got = reference.analysis_scores(spark, SF).where("missing + failed + scored <> requested")
    assert got.count() == 0


def test_schema_validity(spark):
    good = {k: None for k in analysis.STRINGS} | {k: v[0] for k, v in analysis.ENUMS.items()} | {"action_required": True, "required_actions": [], "key_entities": ["a"], "summary": "s"}
    cases = [(good, True), (good | {"action_required": "true"}, False), (good | {"extra": 1}, False), (good | {"urgency": "soon"}, False), ({k: v for k, v in good.items() if k != "summary"}, False), (good | {"key_entities": [1]}, False)]
    df = spark.createDataFrame([(json.dumps(c),) for c, _ in cases] + [("not json",), ("[]",), (json.dumps(good) + " }",), (json.dumps(good) + " {}",)], "j string")
    assert [r[0] for r in df.select(analysis.schema_valid("j")).collect()] == [v for _, v in cases] + [False] * 4


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select(F.col("id"), ((F.col("id") % 5) - 1).cast("double").alias("diff"))
    got = comparison.bootstrap(df, repetitions=400).head()
    assert got["low"] < 1.0 < got["high"] and got["high"] - got["low"] < 0.4
    assert comparison.bootstrap(df.repartition(7), repetitions=400).head() == pytest.approx(got)
    assert comparison.bootstrap(df.limit(0), repetitions=10).head()["low"] is None


def test_agreement(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (None, True)], "g boolean, d boolean")
    assert comparison.agreement(df, "g", "d").head().asDict() == {"tp": 1, "fp": 0, "fn": 1, "tn": 1, "recall_pct": 50.0, "precision_pct": 100.0, "agreement_pct": 66.67}


def test_contrasts_and_tiers(spark):
    lex = spark.createDataFrame([("pt-br", "ônibus", "onibus"), ("pt-br", "obra", "obra"), ("pt-pt", "obra", "obra")], "variant string, form string, folded string")
    df = spark.createDataFrame([(1, "O ônibus da obra. Ônibus"), (2, None), (3, "")], "k int, t string")
    assert [tuple(r) for r in dialect.contrasts(df, "k", "t", lex).collect()] == [(1, "ônibus", True)]
    assert dialect.contrasts(spark.createDataFrame([(1, "via ônibus://x"), (2, "via chrome")], "k int, t string"), "k", "t", lex.unionByName(spark.createDataFrame([("pt-br", "chrome", "chrome")], lex.schema))).where("k = 2").count() == 0
    rules = [("PTBR_GERUND_X", "low", 1), ("PTBR_PROCLISIS_START", "high", 2), ("PTBR_LEXICAL", "medium", 3), ("PTBR_LEXICAL", "high", 4)]
    df = spark.createDataFrame(rules, "r string, s string, t int")
    assert all(a == b for a, b in df.select(dialect.tier(F.col("r"), F.col("s")), "t").collect())


ANN = "doc_id int, sent_id int, i int, text string, lemma string, pos string, dep string, head int, morph map<string,string>, is_punct boolean, is_space boolean"


def _token(doc, i, text, lemma, pos, dep="", head=-1, punct=False, **morph):
    return (doc, 1, i, text, lemma, pos, dep, head, morph, punct, False)


def test_grammar_rules(spark):
    ann = [
        _token(1, 0, "Me", "me", "PRON", "obj", 1, Case="Acc"), _token(1, 1, "diga", "dizer", "VERB"), _token(1, 2, ",", ",", "PUNCT", punct=True), _token(1, 3, "está", "estar", "AUX"), _token(1, 4, "chegando", "chegar", "VERB", VerbForm="Ger"),
        _token(1, 5, "para", "para", "ADP"), _token(1, 6, "mim", "mim", "PRON"), _token(1, 7, "fazer", "fazer", "VERB", VerbForm="Inf"),
        _token(2, 0, "Tem", "ter", "VERB", Person="3", Mood="Ind", VerbForm="Fin"), _token(2, 1, "um", "um", "DET", "det", 2, PronType="Art", Definite="Ind"), _token(2, 2, "erro", "erro", "NOUN", "obj", 0),
        _token(3, 0, "Ana", "Ana", "PROPN", "nsubj", 1), _token(3, 1, "tem", "ter", "VERB", Person="3", Mood="Ind", VerbForm="Fin"), _token(3, 2, "um", "um", "DET", "det", 3, Definite="Ind"), _token(3, 3, "carro", "carro", "NOUN", "obj", 1),
        _token(4, 0, "Tem", "ter", "VERB", Person="3"), _token(4, 1, "razão", "razão", "NOUN", "obj", 0), _token(5, 0, "Chegando", "chegar", "VERB", VerbForm="Ger"), _token(6, 0, "Eu", "eu", "PRON", "nsubj", 1, Case="Nom"), _token(6, 1, "vou", "ir", "VERB"),
    ]
    got = sorted((r["doc_id"], r["rule_id"]) for r in dialect.grammar_findings(spark.createDataFrame(ann, ANN)).collect())
    assert got == [(1, "PTBR_GERUND_OVERUSE"), (1, "PTBR_PARA_MIM_VERBO"), (1, "PTBR_PROCLISIS_START"), (2, "PTBR_TER_HAVER")]


def test_dialect_evaluation(spark):
    forms = [("pt-br", "ônibus"), ("pt-br", "fatura"), *[("pt-pt", w) for w in "o a de fatura está pronta chegou ontem tem um erro na".split()]]
    lex = spark.createDataFrame([(v, w, w) for v, w in forms], "variant string, form string, folded string")
    texts = [(1, "O ônibus de ontem chegou. O Ônibus chegou."), (2, "A fatura está pronta."), (3, "the invoice is ready now"), (4, "xyz"), (5, " "), (6, None), (2000, "Tem um erro na fatura de ontem.")]
    df = spark.createDataFrame(texts, "id int, t string")
    ann = spark.createDataFrame([_token(2000, 0, "Tem", "ter", "VERB", Person="3"), _token(2000, 1, "um", "um", "DET", "det", 2, Definite="Ind"), _token(2000, 2, "erro", "erro", "NOUN", "obj", 0)], ANN)
    tool = spark.createDataFrame([(1, "PT_BR_X", "REGIONALISMS", "o ÔNIBUS de", "style", 0)], "id int, rule_id string, category_id string, context string, issue_type string, ord int")
    got = {r["id"]: r for r in dialect.evaluate(df, "id", "t", lex, ann).collect()}
    assert got[1]["ptbr_violation_count"] == 1 and got[1]["ptpt_compliance_pct"] == 0.0 and got[1]["ptpt_compliance_graded_pct"] == pytest.approx(100 - 150 / 8, abs=0.051)
    assert got[2]["ptpt_compliance_pct"] == 100.0 and got[2]["is_clean_ptpt"] and got[2]["violations"] == []
    assert (got[3]["status"], got[3]["ptpt_compliance_pct"], got[3]["ptbr_leakage_detected"], got[3]["euptvid_label"]) == ("english", 0.0, False, "EN")
    assert got[4]["status"] == "insufficient text" and got[4]["ptpt_compliance_pct"] is None
    assert got[5]["status"] == got[6]["status"] == "empty" and got[5]["ptbr_leakage_detected"] is None
    assert [v["rule_id"] for v in got[2000]["violations"]] == ["PTBR_TER_HAVER"] and got[2000]["ptbr_violation_count"] == 1  # validated stands in for eligible
    covered = {r["id"]: r for r in dialect.evaluate(df, "id", "t", lex, tool=tool).collect()}
    assert [v["rule_id"] for v in covered[1]["violations"]] == ["PT_BR_X"] and covered[1]["ptbr_violation_count"] == 0
    bare = {r["id"]: r for r in dialect.evaluate(df, "id", "t", None, ann).collect()}
    assert bare[2]["status"] == "lexicon unavailable" and bare[2]["ptpt_compliance_pct"] is None and bare[2000]["ptpt_compliance_pct"] == 0.0
    echo = spark.createDataFrame([("k", "ônibus")], "task_id string, word string")
    spared = dialect.evaluate(df.withColumn("task", F.lit("k")), "id", "t", lex, echo=echo, task="task").where("id = 1").head()
    assert spared["ptbr_violation_count"] == 0 and dialect.evaluate(df.limit(0), "id", "t", lex).count() == 0


def test_misspelt_words(spark):
    lex = spark.createDataFrame([("pt-pt", "ação", "acao"), ("pt-pt", "depois", "depois")], "variant string, form string, folded string")
    df = spark.createDataFrame([(1, "Acao. Depois Acao e XPTOA. Fim. (Sr. Abcd.) acao"), (2, None), (3, "")], "k int, t string")
    got = {(r["word"], r["accent_of"]) for r in dialect.unknown_words(df, "k", "t", lex, "pt-pt", "pt-br").collect()}
    assert ("acao", "ação") in got and all(w not in ("xptoa", "abcd") for w, _ in got)
    assert {r["word"] for r in dialect.unknown_words(df, "k", "t", lex, "pt-pt", "pt-br", severe=True).collect()} == {"acao"}


def test_run_pairs_and_reports(spark):
    rows = [(i, f" p{k} ", m, "success", None, float(v)) for i, (k, m, v) in enumerate([(1, "a", 5), (1, "a", 1), (1, "b", 3), (1, "c", 1), (2, "a", 2), (2, "b", 2), (3, "c", 9), (None, "a", 1)])] + [(99, "p2", "c", "error", "x", 7.0)]
    df = spark.createDataFrame(rows, "row_seq int, id string, model string, status string, error string, v double")
    got = {(r["first"], r["second"]): tuple(r)[2:] for r in comparison.run_pairs(df, "v").collect()}
    assert got == {("a", "b"): (2, 1.0, 1, 0, 1), ("a", "c"): (1, 0.0, 0, 0, 1), ("b", "c"): (1, -2.0, 0, 1, 0)}
    assert comparison.run_pairs(df.limit(0), "v").count() == 0
    gold = spark.createDataFrame([(True, True, True, 0.9, False), (True, False, False, 0.1, True), (False, False, True, 0.2, False), (None, None, None, None, None)], "gold boolean, detected boolean, fired boolean, classified double, invisible boolean")
    report = comparison.gold_report(gold).head().asDict()
    assert (report["tp"], report["fn"], report["tn"], report["suppressed"], report["wholly_invisible_misses"], report["precision_without_suppression_pct"], report["classifier_tp"]) == (1, 1, 2, 1, 1, 50.0, 1)
    manifests_ = spark.createDataFrame([("1", {"a": "x"}), ("1", {"a": "y"})], "version string, hashes map<string,string>")
    assert {r["field"]: r["comparable"] for r in comparison.comparable(manifests_, ["version", "hashes"]).collect()} == {"version": True, "hashes": False}
    assert comparison.same_report({"a": 1, "notes": 2}, {"a": 1, "notes": 3})


def test_exact_percentiles(spark):
    from veridraft.operators.log_percentiles import exact_percentiles

    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), (F.hash("id") % 1000 / 7.0).alias("v")).unionByName(spark.createDataFrame([(None, 3.0), (None, 5.0), ("one", 2.0), ("none", None), ("none", -1.0), ("ties", 4.0), ("ties", 4.0)], "g string, v double"))
    got = {r["g"]: tuple(r)[1:] for r in exact_percentiles(df, "v", ["g"]).collect()}
    want = {r["g"]: tuple(r)[1:] for r in df.where("v >= 0").groupBy("g").agg(*[F.expr(f"percentile(v, {p})") for p in (0.5, 0.9, 0.95, 0.99)]).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_prompts_and_recorded_responses(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"version": "1", "description": "d", "prompts": [{"id": "a", "lang": "pt", "prompt": "x"}, {"id": "b", "lang": null, "prompt": "y"}]}')
    assert [tuple(r) for r in jsonl.read_prompts(spark, f"{tmp_path}/p.json").orderBy("ord").collect()] == [("1", "d", 0, "a", "pt", "x"), ("1", "d", 1, "b", None, "y")]
    spark.createDataFrame([("a",)], "id string").write.parquet(f"{tmp_path}/r.parquet")
    assert jsonl.recorded_responses(spark, f"{tmp_path}/r.parquet").collect() == [("a",)]
    (tmp_path / "s.txt").write_text("http ftp\nGopher\n")
    assert jsonl.read_schemes(f"{tmp_path}/s.txt") == ["ftp", "gopher", "http"]


def test_jsonl(spark, tmp_path):
    path = f"{tmp_path}/a.jsonl"
    (tmp_path / "a.jsonl").write_text('{"b": 1, "a": "é"}\n\n{"a": null}\n', encoding="utf-8")
    assert sorted(map(tuple, jsonl.read_jsonl(spark, path, "a string, b bigint").collect()), key=str) == [("é", 1), (None, None)]
    (tmp_path / "b.jsonl").write_text("[1]\n", encoding="utf-8")
    with pytest.raises(ValueError, match="not an object"):
        jsonl.read_jsonl(spark, f"{tmp_path}/b.jsonl")
    (tmp_path / "w.dic").write_text("3\nação/AB\nObra\n", encoding="utf-8")
    assert {tuple(r) for r in jsonl.read_dictionary(spark, f"{tmp_path}/w.dic", "pt-pt").collect()} == {("pt-pt", "ação", "acao"), ("pt-pt", "obra", "obra")}
    assert jsonl.price_rows([{"id": "m", "pricing": {"prompt": "0.001", "completion": -1}, "context_length": 8}]) == [("m", 1.0, None, 8)]


def test_manifests(tmp_path):
    result = tmp_path / "r.jsonl"
    result.write_text('{"id": "a"}\n\n')
    m = manifests.build_manifest(result, "generation", "1", "m")
    assert m["row_count"] == 1
    manifests.write_manifest(m)
    assert manifests.load_manifest(result)["artifact_id"] == m["result_sha256"]
    assert manifests.check_comparable([result], "generation")
    with pytest.raises(ValueError):
        manifests.check_comparable([result], "analysis")
    result.write_text("changed")
    with pytest.raises(ValueError):
        manifests.load_manifest(result)
    assert manifests.load_calibration(tmp_path / "none.json") is None
    assert manifests.verify_resource(result, "0" * 64)


def test_report(spark):
    card = reference._card(spark, SF).limit(1)
    assert "latency_p50_ms" in reports.text_report(card, "model") and json.loads(reports.json_report(card=card))["card"]


def test_core_stands_alone():
    import pathlib

    root = pathlib.Path(reference.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "veridraft.llm" not in p.read_text(encoding="utf-8"), p


def test_repair(spark):
    from veridraft.operators import rescoring

    rows = [(1, '{"a": 1}'), (2, 'Aqui:\n{"a": {"b": 2}} fim'), (3, '```json\n{"a": 3}\n```'), (4, '{"a": 1} {"b": 2}'), (5, '{"a": '), (6, "[1]"), (7, None), (8, "")]
    got = {r["k"]: (r["parsed"], r["repaired"]) for r in rescoring.repaired(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got[1] == ('{"a": 1}', False) and got[2] == ('{"a": {"b": 2}}', True) and got[3] == ('{"a": 3}', True)
    assert got[4][0] is got[5][0] is got[6][0] is got[8][0] is None


def test_stream_keeps_one_of_each(spark, tmp_path):
    from veridraft.streaming.ingest import ingest

    source, out = tmp_path / "in", tmp_path / "out"
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "seq bigint, id string")
    df.coalesce(1).write.parquet(str(source))

    def sink(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    def run():
        stream = spark.readStream.schema("seq bigint, id string").parquet(str(source))
        ingest(stream, ["id"], ["seq"], f"file://{tmp_path}/state", sink, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()

    run()
    spark.createDataFrame([(5, "a"), (6, "c")], "seq bigint, id string").coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert sorted(r["seq"] for r in spark.read.parquet(f"{out}/*").collect()) == [1, 3, 4, 6]


def test_rescoring_passes_others_through(spark):
    from veridraft.operators import rescoring

    df = spark.read.parquet(f"{SF}/generation_results.parquet")
    before = {r["row_seq"]: r["wf_score"] for r in df.where("status = 'error'").select("row_seq", "wf_score").collect()}
    after = {r["row_seq"]: r["wf_score"] for r in rescoring.rescored(df).where("status = 'error'").select("row_seq", "wf_score").collect()}
    assert before.keys() == after.keys() and rescoring.rescored(df).columns == df.columns
