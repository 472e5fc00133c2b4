import re

import pytest
from pyspark.sql import functions as F

from veridraft.functions import text as T
from veridraft.operators import criteria, quality

TEXTS = [
    "", " ", "Olá Ana,\n\nA obra obra ficou pronta. A obra ficou pronta ontem. A obra ficou pronta ontem.\n\nCumprimentos,\nRui", "AAAAA BBBBB CCCCC!!", "x" * 400, "sim sim sim não não",
    "Subject: teste\n\nBom dia,\n\nUma frase só.\n\nAtentamente,\nEva", "can't won't d'água l'eau", None,
]


def _frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def _tokens(t):
    return re.findall(r"[^\W]+", t.lower())


def test_token_runs_match_brute_force(spark):
    got = {r["i"]: tuple(r["r"]) for r in _frame(spark).where("t IS NOT NULL").select("i", quality.token_runs("t").alias("r")).collect()}
    for i, t in enumerate(TEXTS):
        if t is None:
            continue
        runs, last, size = [], None, 0
        for w in [*_tokens(t), None]:
            if w == last:
                size += 1
            else:
                runs.append(size)
                last, size = w, 1
        assert got[i] == (sum(x >= 2 for x in runs), sum(x >= 3 for x in runs))


def test_duplicate_sentence(spark):
    got = {r["i"]: r["d"] for r in _frame(spark).select("i", quality.duplicate_sentence("t").alias("d")).collect()}
    assert got[2] == "a obra ficou pronta ontem" and all(got[i] is None for i in (0, 1, 3, 4, 8))


def test_repeated_phrase():
    words = "um dois três quatro cinco seis sete".split()
    assert quality.repeated_phrase(words * 2) == (7, " ".join(words))
    assert quality.repeated_phrase(["a"] * 8) is None  # only overlapping
    assert quality.repeated_phrase(words[:5] * 2)[0] == 5


def test_structure_and_style(spark):
    got = {r["i"]: r for r in _frame(spark).select("i", quality.structure("t").alias("s"), *[f.alias(n) for n, f in quality.style_flags("t").items()]).collect()}
    assert not got[2]["s"]["missing_greeting"] and not got[2]["s"]["missing_signoff"]
    assert got[3]["EXCESSIVE_ALLCAPS"] and got[3]["EXCESSIVE_EXCLAMATION"] and got[4]["RUN_ON_BLOCK"]
    assert got[7]["INFORMAL_CONTRACTION"] and not got[2]["INFORMAL_CONTRACTION"]


def test_scores_are_capped(spark):
    rows = [(1, "X", "style", "medium")] * 20 + [(1, "MISSING_GREETING", "structural", "high"), (2, "Y", "other", "low")]
    got = {r["k"]: r["score"] for r in quality.compute_score(spark.createDataFrame(rows, "k int, rule_id string, dimension string, severity string"), "k").collect()}
    assert got == {1: round(100 - 18 - 12 * 0.4, 1), 2: 97.0}


def test_calibrated_tree(spark):
    model = {"init_value": 3.0, "learning_rate": 0.5, "score_mapping": {"base": 10.0, "per_level": 18.0}, "trees": [[{"feature": 0, "threshold": 1.0, "left": 1, "right": 2}, {"left": -1, "value": -1.0}, {"left": -1, "value": 2.0}]]}
    df = spark.createDataFrame([(0.5,), (2.0,), (9.0,)], "x double").select(quality.calibrated([F.col("x")], model, F.lit(80.0)).alias("s"))
    assert [r["s"] for r in df.collect()] == [55.0, 80.0, 80.0]


@pytest.mark.parametrize("text,met", [
    ("Vamos confirmar o envio.", True), ("Não vamos confirmar o envio.", False), ("Não podemos deixar de confirmar o envio.", True), ("Sem confirmar nada", False), ("Não só confirmar, mas enviar", True),
    ("Não enviamos, vamos confirmar", True), ("nunca confirmar", True), ("do not confirmar", False), ("", False),
])
def test_negation_scope(spark, text, met):
    df = spark.createDataFrame([(text,)], "t string").select(criteria.affirmed(F.col("t"), r"confirmar").alias("m"))
    assert df.head()["m"] is met


def test_placeholders(spark):
    rows = [("Caro [Nome do Cliente], [____] [ver anexo] [2024] [Portal](http://x) [Nome do Cliente]", None), ("usa [qualquer coisa]", "peço [qualquer coisa]")]
    got = [r["p"] for r in spark.createDataFrame(rows, "t string, s string").select(criteria.placeholders(F.col("t"), F.col("s")).alias("p")).collect()]
    assert got == [["[Nome do Cliente]", "[____]"], ["[qualquer coisa]"]]


def test_adherence_scores(spark):
    own = [("a", "required_actions", "x", "enviar", 0), ("a", "required_facts", "y", "100 euros", 0), ("a", "forbidden_changes", "z", "200 euros", 1)]
    rows = [(1, "a", "vamos enviar 100 euros", ""), (2, "a", "não enviar 200 euros", ""), (3, "b", "texto", ""), (4, "a", " ", ""), (5, "a", None, None)]
    own = spark.createDataFrame(own + [("c", "required_facts", "w", "", 0), ("c", "forbidden_changes", "v", "", 1)], criteria.CRITERIA)
    rows += [(6, "c", "texto", None), (7, None, "texto", "[Nome]"), (8, "a", "vamos enviar 100 euros a [Nome]", "[Nome]"), (9, "b", "usa [x y]", "pede [x y]")]
    got = {r["k"]: tuple(r)[1:] for r in criteria.adherence(spark.createDataFrame(rows, "k int, task string, t string, s string"), own, "k", "task", "t", "s").collect()}
    assert got == {1: (100.0, 100.0), 2: (0.0, 50.0), 3: (None, None), 4: (0.0, 0.0), 5: (0.0, 0.0), 6: (None, 50.0), 7: (100.0, None), 8: (50.0, 100.0), 9: (0.0, None)}
    met = criteria.evaluated(spark.createDataFrame(rows, "k int, task string, t string, s string"), own, "k", "task", "t")
    assert met.where("k = 1").count() == 3 and met.where("k IN (3, 7)").count() == 0 and criteria.evaluated(spark.createDataFrame([], "k int, task string, t string"), own, "k", "task", "t").count() == 0


def test_criteria_as_a_table(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"t": {"required_facts": [{"fact_id": "f", "pattern": "d\'água|rés-do-chão"}]}}', encoding="utf-8")
    own = criteria.read_criteria(spark, f"file://{tmp_path}/c.json")
    assert [tuple(r) for r in own.collect()] == [("t", "required_facts", "f", "d'água|rés-do-chão", 0)]
    assert {r["word"] for r in criteria.echo_vocabulary(own).collect()} == {"d'água", "rés-do-chão"}
    assert criteria.read_criteria(spark, f"file://{tmp_path}/none.json").count() == 0
    with pytest.raises(ValueError, match="Java"):
        criteria.criteria_frame(spark, '{"t": {"required_facts": [{"fact_id": "f", "pattern": "(?P<a>b)"}]}}')


def test_constraint_documents(spark):
    rows = criteria.flattened('{"t": {"required_facts": [{"fact_id": "f", "pattern": "a|b"}]}}')
    assert rows == [("t", "required_facts", "f", "a|b", 0)]
    for bad in ("[]", '{"t": {"required_facts": 3}}', '{"t": {"required_actions": [{"pattern": "("}]}}'):
        with pytest.raises(ValueError):
            criteria.flattened(bad)
    broad = criteria.broad_criteria(spark.createDataFrame(rows, criteria.CRITERIA)).collect()
    assert broad[0]["bare_alternative"] == "a"


def test_floor(spark):
    own = spark.createDataFrame([("a", "required_actions", "x", "enviar", 0), ("a", "required_facts", "y", "obrigado", 0), ("a", "forbidden_changes", "z", "muito", 0)], criteria.CRITERIA)
    assert [r["criterion_id"] for r in criteria.floor_violations(own, "Muito obrigado.").collect()] == ["y"]


def test_formats(spark):
    rows = [("wf_score_pct", 12.34), ("latency_p50_ms", 1234.5), ("tokens_per_second", None), ("known_cost_samples", 1200.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string, v double").select(T.formatted(F.col("m"), F.col("v"))).collect()]
    assert got[0] == "12.3%" and got[1].endswith(" ms") and got[2] == "N/A" and got[3] == "1,200"
    rows = [("-3",), ("x",), ("2.5",), ("Thu, 01 Jan 1970 00:01:40 GMT",)]
    assert spark.createDataFrame(rows, "v string").select(T.retry_after("v", F.lit(40.0))).collect() == [(0.0,), (None,), (2.5,), (60.0,)]


def test_masks_and_folds(spark):
    rows = [("ref AB-1234, 12/34/56a e 2024-10-05.", "ref  ,  /56a e  ."), ("x12345y 912 345 678", "x12345y  "), ("ver WWW.Ex.PT/a ou a@b.pt", "ver   ou  ")]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "t string").select(T.masked("t")).collect()] == [b for _, b in rows]
    assert [r[0] for r in spark.createDataFrame([("ação",), ("Ŝś",), (None,), ("plain",)], "t string").select(T.fold_diacritics("t")).collect()] == ["acao", "Ss", None, "plain"]


def test_repeats_match_brute_force():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from veridraft.functions.ngrams import first_repeats

    def slow(words, lengths, places):
        for n in lengths:
            at = {}
            for i in range(len(words) - n + 1):
                at.setdefault(tuple(words[i : i + n]), []).append(i)
            for where in at.values():
                if any(b - a >= n for a, b in zip(where[:places], where[1:places])):
                    return n, where[0]
        return None

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(st.sampled_from("ab"), max_size=25), max_size=5), st.integers(2, 4))
    def check(lists, places):
        assert first_repeats(lists, (4, 3, 2), places) == [slow(x, (4, 3, 2), places) for x in lists]

    check()
    assert first_repeats([], (3,), 8) == [] and first_repeats([[]], (3,), 8) == [None]


def test_writing_quality_is_composed(spark):
    clean = "Subject: teste\n\nBom dia Ana,\n\nA obra ficou pronta ontem à tarde e pode ser visitada amanhã.\n\nCumprimentos,\nRui"
    phrase = "o relatório anual da empresa foi enviado ontem"
    bad = f"Bom dia Ana,\n\nHoje {phrase}, e por isso {phrase} outra vez.\n\nCumprimentos,\nRui"
    df = spark.createDataFrame([(1, clean), (2, bad), (3, " \n"), (4, None), (5, "a"), (6, "palavra " * 20_000)], "id int, _vd_text string").withColumnRenamed("_vd_text", "t")
    model = {"init_value": 3.0, "learning_rate": 1.0, "score_mapping": {"base": 0.0, "per_level": 20.0}, "trees": [[{"left": -1, "value": 2.0}]]}
    got = {r["id"]: r for r in quality.evaluate(df, "id", "t", calibration=model).collect()}
    assert got[1]["wq_defect_only_score"] == 100.0 and got[1]["writing_quality_score"] == 99.9 and got[1]["repetition_count"] == 0
    assert got[2]["repetition_count"] == 1 and got[2]["wq_defect_only_score"] == 96.0
    assert got[3]["wq_excluded_reason"] == got[4]["wq_excluded_reason"] == "empty_text" and got[3]["writing_quality_score"] is None and got[6]["repetition_count"] >= 1
    found = spark.createDataFrame([(1, "G", "grammar", "high")] * 9 + [(1, "S", "spelling", "high")], "id int, rule_id string, dimension string, severity string")
    with_tool = {r["id"]: r for r in quality.evaluate(df, "id", "t", found, True, model).collect()}
    assert with_tool[1]["grammar_error_count"] == 9 and with_tool[1]["wq_defect_only_score"] == 54.0 and with_tool[2]["wq_defect_only_score"] == 96.0
    none = {r["id"]: r for r in quality.evaluate(df, "id", "t").collect()}
    assert none[1]["writing_quality_score"] is None and none[1]["wq_excluded_reason"] == "calibration unavailable" and none[2]["repetition_count"] == 0
    assert quality.evaluate(df.limit(0), "id", "t").count() == 0


def test_fixture_headers(spark):
    rows = [("De: a@b.pt\nAssunto: x\n\n\nCorpo\nNota: fica", "Corpo\nNota: fica"), ("Corpo\nDe: b", "Corpo\nDe: b"), ("", ""), (None, None), ("\nDe: a\nCorpo", "Corpo")]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "t string").select(T.without_fixture_headers("t")).collect()] == [b for _, b in rows]
