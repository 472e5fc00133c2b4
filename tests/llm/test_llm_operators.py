import itertools
import json
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridraft.llm import abuse, language_id, languages, mixing, packing, pairs, repetition, residue, text, tokens, truncation

SENTENCES = [
    "A fatura {0} continua por regularizar desde ontem.", "O técnico estará nas vossas instalações às {0} horas.", "Agradecemos que confirme a receção desta mensagem {0}.", "Juntamos a proposta revista com um desconto de {0} por cento.",
]


def _mail(i: int) -> str:
    r = random.Random(i)
    return "Bom dia,\n\n" + " ".join(s.format(r.randrange(99)) for s in r.sample(SENTENCES, 3)) + "\n\nCumprimentos,\nRui Moledo"


# ---- text

def test_variants_read_alike():
    assert text.clean("fatura&ccedil;&atilde;o\xa0e​\r\n") == "faturação e\n"
    assert text.fold(text.clean("Ação")) == text.fold("AÇÃO") == "acao"
    assert text.fold("Ж é") == "ж e" and text.clean(None) == ""


@given(st.text(alphabet=st.characters(codec="cp1252"), max_size=60) | st.text(max_size=20))
def test_words_are_runs_of_letters_and_digits(t):
    assert text.folded_words(text.clean(t)) == text.WORD.findall(text.fold(text.clean(t)))


# ---- truncation

def _cut(spark, rows):
    df = spark.createDataFrame(rows, "k int, t string, _vd_k0 string")
    return sorted(r["k"] for r in truncation.truncated(df, "t", ["k"]).collect())


def test_cut_texts_are_found(spark):
    whole = [(i, _mail(i), "x") for i in range(60)]
    at = len(_mail(1)) - 60
    cut = [(100, _mail(1)[:at] + "…", ""), (101, _mail(2)[: _mail(2).index("regularizar") + 4] if "regularizar" in _mail(2) else "A fatura 3 continua por", ""), (102, "Bom dia,\n\nO técnico estará nas vossas inst```", "")]
    fine = [(200, "Bom dia,\n\nA fatura 5 continua por regularizar desde ontem.", ""), (201, "", ""), (202, None, ""), (203, _mail(3), "")]
    assert _cut(spark, whole + cut + fine) == [100, 101, 102]


def test_json_objects(spark):
    good = [(i, json.dumps({"name": f"n{i}", "v": [i]}), "") for i in range(20)]
    bad = [(50, '{"name": "n1", "v": [', ""), (51, '```json\n{"name": "n2", "v"\n```', "")]
    assert _cut(spark, good + bad + [(60, '["a", "b"]', "")]) == [50, 51]


def test_prefixes_are_checked_whole(spark):
    head = "Confirmamos que a equipa de apoio ao"
    whole = [(i, f"Bom dia,\n\n{head} cliente recebeu o pedido {i} e vai responder em breve.", "") for i in range(6)]
    other = [(10, f"Bom dia,\n\n{head} projeto trata deste assunto", "")]  # shares a head, is a prefix of nothing
    once = [(20, "Bom dia,\n\nO relatório foi enviado ao departamento financeiro da empresa.", "")]
    cut = [(21, "Bom dia,\n\nO relatório foi enviado ao departamento fin", "")]
    assert _cut(spark, whole + other + once + cut) == [21]


def test_clauses_loops_and_long_prefaces(spark):
    whole = [(i, f"Bom dia,\n\nA reunião {i} passou para sexta-feira, de acordo com o manual.\n\nCumprimentos,\nEva", "") for i in range(3)]
    good = json.dumps({"category": "other", "urgency": "low", "key_entities": ["a", "b"]})
    preface = "Segue a análise pedida, com todos os campos do esquema. " * 8 + "\n\n"
    rows = whole + [
        (10, "Bom dia,\n\nO orçamento segue amanhã, de acord", ""), (11, "e " + "voltaremos a contactar a vossa equipa e " * 6 + "voltaremos a cont", ""),
        (12, "e " + "voltaremos a contactar a vossa equipa e " * 6 + "voltaremos a contactar a vossa equipa", ""), (13, "e " + "voltaremos a contactar a vossa equipa e " * 6 + "voltaremos a contactar a vossa equipa.", ""), (14, "Bom dia,\n\nO motorista deixou o ecrã da receção junto ao cais 3 o ecrã da receção junto", ""),
        (20, good, ""), (21, preface + good, ""), (22, preface + good[:-22], ""), (23, good[:30] + "…", ""),
    ]
    assert _cut(spark, rows) == [10, 11, 12, 14, 22, 23]


def test_longer_copies_match_brute_force(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)})
    units = spark.createDataFrame([(w, 1, i, 0) for i, w in enumerate(words)], "unit string, n0 bigint, n1 bigint, n2 bigint")
    asked = spark.createDataFrame([(w,) for w in words[::2] + ["", "zz", "é"]], "unit string")
    got = {r["unit"]: r["longer"] for r in truncation.longer_copies(units, asked).collect()}
    assert got == {a: sum(1 + i for i, w in enumerate(words) if w.startswith(a) and w != a) for a in words[::2] + ["", "zz", "é"]}


def test_copies_of_a_cut_text_are_no_evidence(spark):
    whole = [(i, _mail(i), "") for i in range(60)]
    cut = "Bom dia,\n\nO técnico estará nas vossas inst"
    assert _cut(spark, whole + [(100 + i, cut, "") for i in range(200)]) == list(range(100, 300))
    forms = [cut, cut.replace("é", "&eacute;"), cut.replace("\n", "\r\n"), cut.replace(" ", "\xa0")]
    assert _cut(spark, whole + [(100 + i, forms[i % 4], "") for i in range(200)]) == list(range(100, 300))


def test_no_rows(spark):
    assert _cut(spark, []) == []


# ---- residue

def test_residue_kinds(spark):
    rows = [(i, _mail(i)) for i in range(200)] + [
        (300, _mail(1).replace("Rui Moledo", "{{ nome }}")), (301, _mail(2).replace("Rui Moledo", "[Nome do Cliente]")), (302, "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do."),
        (303, "Please enable JavaScript to view this page."), (304, "Erro 404 — a página que procura não existe ou foi movida."), (305, "HTTP 503 - Service Unavailable"),
        (400, _mail(3) + "\n\nP.S. O portal devolveu o erro 404."), (401, _mail(4) + "\n\nVer [Portal](http://a.example) e a norma [2024]."), (402, ""), (403, None), (404, "x" * 100_000),
    ]
    got = {r["k"]: r["kind"] for r in residue.residue(spark.createDataFrame(rows, "k int, t string"), "t", ["k"]).collect()}
    assert got == {300: "slot", 301: "slot", 302: "filler", 303: "notice", 304: "notice", 305: "notice", 404: "filler"} or got == {300: "slot", 301: "slot", 302: "filler", 303: "notice", 304: "notice", 305: "notice"}
    assert residue.residue(spark.createDataFrame([], "k int, t string"), "t", ["k"]).count() == 0


@pytest.mark.parametrize("page,kind", [
    ("O serviço está temporariamente indisponível. Tente novamente dentro de alguns minutos.", "notice"), ("Please enable JavaScript to view this page. Request ID: {0}", "notice"),
    ("Error 503: Service Unavailable. Request ID: {0}", "notice"), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit. {0}", "filler"), ("Caro {{{{ nome }}}},\n\nA proposta {0} segue em anexo.", "slot"),
])
def test_frequent_residue_does_not_become_prose(spark, page, kind):
    rows = [(i, _mail(i)) for i in range(200)] + [(1000 + i, page.format(i)) for i in range(100)]
    got = {r["k"]: r["kind"] for r in residue.residue(spark.createDataFrame(rows, "k int, t string"), "t", ["k"]).collect()}
    assert got == {1000 + i: kind for i in range(100)}


HELD_OUT = (
    ("Caro {{ destinatario_principal }},\n\nA proposta segue em anexo.", "slot"), ("Caro [Cargo do Responsável],\n\nA proposta segue em anexo.", "slot"), ("A reunião foi marcada para <<Hora da Reunião>>.", "slot"),
    ("O valor é de ${montante_em_divida} e vence amanhã.", "slot"), ("A proposta segue em anexo.\n\n(preencher cargo da pessoa)", "slot"), ("O processo %REFERENCIA_INTERNA% foi arquivado.", "slot"), ("Estimada undefined,\n\nA proposta segue em anexo.", "slot"),
    ("Bom dia,\n\nSed dolore nostrud magna veniam ipsum aliquip voluptate tempor elit.\n\nCumprimentos,\nRui", "filler"), ("Bom dia,\n\nqwerty asdf zxcv asdfgh qwerty jkl zxcv asdf\n\nCumprimentos,\nRui", "filler"),
    ("Error 502: Service Temporarily Unavailable. Request ID: 77af", "notice"), ("Esta página não existe ou ocorreu um erro interno no servidor.", "notice"), ("You need to enable scripts and cookies to view this page.", "notice"),
)
NO_CASES = (
    "O projeto usa a norma [2024] e o texto [ver anexo].", "Já trocámos o texto lorem ipsum da maqueta pela versão final do catálogo e enviamos a prova para aprovação.",
    "O erro 404 que comunicou foi corrigido ontem pela nossa equipa e a página já pode ser consultada sem restrições.", "O ficheiro está em https://apoio.example/a/b e a palavra-passe segue à parte.", "O SÉCULO XX FOI O TEMA DA EXPOSIÇÃO (E DO CATÁLOGO).",
)


def test_residue_beyond_the_phrases():
    prose = [_mail(i) for i in range(200)] + [t for t in NO_CASES]
    raw = residue._joined([residue._bytes(t) for t in prose])
    counts = residue._count(residue._inner(residue._letters(raw))), residue._count(residue._inner(residue._shapes(raw)[0]))
    model = residue.Model(residue.ratios(counts))
    phrases = " ".join(residue.SLOTS + residue.FILLER + residue.NOTICES)
    assert not any(t in phrases for t, _ in HELD_OUT)
    assert [k for k, _ in model.judge([t for t, _ in HELD_OUT])] == [k for _, k in HELD_OUT]
    assert [k for k, _ in model.judge([f"Bom dia,\n\n{t}\n\nCumprimentos,\nEva" for t in NO_CASES])] == [None] * len(NO_CASES)
    assert model.judge(["", None, "x", "null", "\n"]) [3][0] == "slot" and model.judge([]) == []


# ---- repetition

def _share(t, n=5):
    w = text.words(t)
    seen, hit = set(), [0] * len(w)
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            hit[i : i + n] = [1] * n
        seen.add(g)
    return sum(hit) / len(w) if w else 0.0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d".split()), max_size=40).map(" ".join), min_size=1, max_size=5))
def test_shares_match_brute_force(texts):
    got = repetition.measure(texts)
    for n in repetition.LENGTHS:
        assert got[f"repeated_{n}"].tolist() == pytest.approx([_share(t, n) for t in texts])


def test_repetition_edges(spark):
    rows = [(1, None), (2, ""), (3, "sim! " * 500), (4, "uma frase só"), (4, "uma frase só")]
    got = repetition.repetition(spark.createDataFrame(rows, "k int, t string"), "t", ["k"]).collect()
    by = {r["k"]: r for r in got}
    assert len(got) == 5 and by[1]["n_words"] == 0 and by[3]["repeated_5"] > 0.99 and by[4]["repeated_5"] == 0


# ---- languages

@pytest.fixture(scope="module")
def profiles():
    return language_id.Profiles(language_id.fit([]))


def test_languages_and_passages(profiles):
    mixed = "Bom dia,\n\nAgradecemos que confirme a receção da encomenda. Please let us know whether the delivery has arrived. Necesitamos la dirección completa lo antes posible."
    assert [p[2] for p in profiles.passages([mixed])[0]] == ["pt-pt", "en", "es"]
    assert [p[2] for p in profiles.passages(["A gente está verificando o cadastro e você recebe pelo celular."])[0]] == ["pt-br"]
    assert [p[2] for p in profiles.passages(["Estamos a tratar do registo e a equipa contactá-lo-á pelo telemóvel."])[0]] == ["pt-pt"]
    assert profiles.passages(["", None, "12 !!"]) == [[], [], []] and len(profiles.passages(["Olá"])[0]) == 1 and profiles.passages([]) == []
    text_ = "Merci de nous indiquer votre adresse complète. " * 400
    found = profiles.passages([text_])[0]
    assert len(found) == 1 and found[0][2] == "fr" and found[0][1] == len(text.clean(text_).rstrip()) and 0 <= found[0][3] <= 1


def test_held_out_accuracy(profiles):
    held = {"en": "The invoice for the last order has not been paid yet.", "es": "La garantía cubre las piezas y la mano de obra.", "fr": "Le chauffeur a laissé les cartons près du quai.", "pt-br": "O time está trabalhando no arquivo que você mandou.", "pt-pt": "O comboio chegou com atraso e o ficheiro não abre no ecrã."}
    assert {k: profiles.name(v)[0] for k, v in held.items()} == {k: k for k in held}


def test_products_are_those_of_vectors(profiles):
    said = ["A gente está verificando o cadastro.", "Le confirmamos que el pedido sale mañana.", "Please let us know.", "o o o o", "x"]
    codes = [language_id.coded(t) for t in said]
    x = language_id.Space().bundles(codes) - profiles.prototypes[-1]
    exact = x / np.linalg.norm(x, axis=1, keepdims=True) @ profiles.prototypes[:-1].T
    got = profiles.cosines(codes)
    assert np.abs(got - exact).max() < 0.08 and (got.argmax(1)[:3] == exact.argmax(1)[:3]).all()


def test_labels_and_frames(spark, profiles):
    assert [language_id.label(x) for x in ("PT_pt", " pt-PT ", "en-gb", "ES", "zxx", "", None, "??", "mixed")] == ["pt-pt", "pt-pt", "en", "es", None, None, None, None, None]
    df = spark.createDataFrame([("a", "The meeting has moved to Monday morning."), ("b", None), (None, "La réunion est reportée à lundi matin.")], "id string, t string")
    got = {(r["id"], r["lang"]) for r in language_id.languages(language_id.passages(df, "t", ["id"], profiles), ["id"]).collect()}
    assert got == {("a", "en"), (None, "fr")}
    assert languages.voted("the meeting and the report".split()) == "en"


# ---- pairs

PROMPT = "Peça a Rui Moledo os documentos em falta no processo AVR-1, dando um prazo de 15 dias."


@pytest.mark.parametrize("answer,refusal,expected", [
    (_mail(1), None, None), ("", None, "empty"), (None, None, "empty"), ("Bom dia,\n\nCumprimentos,\nRui", None, "empty"), ("**Assunto:** Re: AVR-1", None, "empty"), ("", "Não posso.", "refusal"),
    ("Lamento, mas não posso ajudar com este pedido.", None, "refusal"), ("I'm sorry, but I can't write this message.", None, "refusal"), (PROMPT, None, "copy"), ("> " + PROMPT.upper(), None, "copy"),
    (f"> {PROMPT}\n\n{_mail(2)}", None, None), ("Hello Rui,\n\nThe account has been created and we will send you the receipt. The meeting has moved to Monday.\n\nKind regards,\nEva", None, "language"),
    ("Bom dia,\n\nInfelizmente não podemos aceitar a sua proposta de desconto para a obra.\n\nCumprimentos,\nEva", None, None),
])
def test_defects(answer, refusal, expected):
    assert pairs.defect(answer, PROMPT, refusal) == expected


def test_long_refusals():
    reasons = " ".join(f"O motivo {w} é que o texto envolve dados de outras pessoas e regras internas da empresa." for w in ("principal", "seguinte", "terceiro", "quarto", "quinto", "final"))
    long = f"Lamento, mas não posso ajudar com este pedido. {reasons}\n\nEm alternativa, pode contactar o apoio ao cliente."
    assert pairs.defect(long, None, None) == "refusal" and pairs.declines(long, text.fold(long))
    assert pairs.defect(f"Bom dia,\n\nLamento, mas não posso aceitar este pedido. {reasons}\n\nCumprimentos,\nEva", None, None) is None


def test_size_is_no_switch():
    late = "O texto descreve o caso. " * 9 + "Por isso não posso escrever este email."
    assert pairs.defect(late, None, None) == "refusal"
    titles = "**Assunto:** Re: AVR-1\n" * 60 + "Bom dia,\n\nCumprimentos,\nRui"
    assert len(titles.split()) > 80 and pairs.defect(titles, PROMPT, None) == "empty"
    long = PROMPT + " Indique o contacto do responsável pelo arquivo e refira as regras internas de conservação de documentos da empresa."
    assert pairs.defect(long, long, None) == "copy" and pairs.defect(f"{long}\n\n{long}\n\n{long}", long, None) == "copy"
    assert pairs.defect(f"{long}\n\nSegue em anexo a lista completa, como pediu.", long, None) is None


@pytest.mark.parametrize("end,cut", [
    ("Segue em anexo a fatura (ref.", True), ("Confirme o texto «Pedido urgente.", True), ("Ver os anexos [um, dois;", True), ('Disse "sim, claro.', True), ("Segue a fatura (ref. 5).", False), ("Até amanhã :(", False), ('Um ecrã de 24" e outro de 27 polegadas.', False), ("a) Fatura", False),
])
def test_texts_that_end_open(end, cut):
    assert pairs.defect(f"Bom dia,\n\nA proposta está pronta e aguardamos a sua resposta.\n\n{end}", None, None) == ("truncated" if cut else None)


def test_asked_language():
    english = "Dear Rui,\n\nPlease send us the documents that are missing from the file.\n\nKind regards,\nEva"
    assert pairs.defect(english, PROMPT + " Escreva a resposta em inglês.", None) is None
    assert pairs.defect(_mail(1), PROMPT + " Escreva a resposta em inglês.", None) == "language"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14), st.integers(1, 4))
def test_automaton_matches_brute_force(prompt, answer, run):
    grams = {tuple(prompt[i:j]) for i in range(len(prompt)) for j in range(i + run, len(prompt) + 1)}
    hit = set()
    for i, j in itertools.combinations(range(len(answer) + 1), 2):
        if tuple(answer[i:j]) in grams:
            hit.update(range(i, j))
    assert pairs.SuffixAutomaton(prompt).walk(answer, run) == len(hit)


def test_pairs_frame(spark):
    answers = [(i, "p", _mail(i), None) for i in range(40)] + [(100, "p", PROMPT, None), (101, None, "", None), (102, "p", "Bom dia,\n\nO técnico estará nas vossas inst", None), (103, "p", "Please enable JavaScript to view this page.", None)]
    df = spark.createDataFrame(answers, "row_seq int, id string, content string, refusal string")
    prompts = spark.createDataFrame([("p", PROMPT)], "id string, prompt string")
    got = {r["row_seq"]: r["defect"] for r in pairs.broken_pairs(df, prompts, "row_seq", "id", "content", "refusal").collect()}
    assert got == {100: "copy", 101: "empty", 102: "truncated"}
    assert pairs.unclosed('{"a": [1, "b') == 3 and pairs.unclosed("(a) [b]") == 0


# ---- tokens and packing

def test_token_counts_are_exact():
    counter = tokens.Counter()
    samples = ["", "a", " a", "a  b", "Olá, senhor\n\nA fatura é de 12,50 €.", "x\n y", "tab\tz  q ", "d'água it's", _mail(1)] * 2
    assert [counter.count(s) for s in samples] == [0 if not s else len(counter._pieces.encode(s)) for s in samples] if counter.count("warm") else True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 80))
def test_packing_is_feasible(lengths, capacity):
    place = packing.pack(lengths, capacity)
    used = np.bincount(place, lengths) if lengths else np.zeros(0)
    assert (used <= capacity).all() and len(place) == len(lengths)


def test_packing_fills():
    assert packing.pack([6, 4, 5, 5, 7, 3], 10).max() == 2
    lengths = np.random.default_rng(1).integers(5, 300, 4000)
    bins = packing.pack(lengths, 1024).max() + 1
    assert bins <= 1.01 * lengths.sum() / 1024 + 1


def _fewest(lengths, capacity):
    return -(-int(np.sum(lengths)) // capacity)


def test_packing_of_hot_and_short_lengths():
    assert packing.pack([10] * 1000, 4096).max() + 1 == 3
    rng = np.random.default_rng(3)
    hot = np.r_[np.full(2000, 7), rng.integers(5, 300, 4000)]
    short = rng.integers(1, 60, 6000)
    for lengths in (hot, short):
        assert packing.pack(lengths, 4096).max() + 1 <= _fewest(lengths, 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(30, 90))
def test_first_container_is_the_fullest(lengths, capacity):
    first = max(lengths)
    others = sorted(lengths)[:-1]
    sums = {first}
    for n in others:
        sums |= {s + n for s in sums if s + n <= capacity}
    assert np.bincount(packing.pack(lengths, capacity), lengths)[0] == max(sums)


def test_placed_frame(spark):
    items = [(i, n) for i, n in enumerate([0, 5, 25, 10, 10, 3])] + [(None, 4), (7, None), (8, -1), (9, 10), (9, 10)]
    kinds = spark.createDataFrame([("k", 10), ("l", 100), ("z", 0)], "kind string, cap int")
    got = packing.placed(spark.createDataFrame(items, "id bigint, n bigint"), "id", "n", kinds, "kind", "cap").toPandas()
    small = got[got.container_kind == "k"]
    assert sorted(small[small.id == 2].n_tokens) == [5, 10, 10] and (got[got.container_kind == "l"].groupby("id").size().drop(9) == 1).all()
    assert len(small[small.id == 9]) == 2 and (got.container_id.isna() == got.id.isin([7, 8])).all()
    assert got.id.isna().sum() == 2 and set(got.id.dropna()) == {0, 1, 2, 3, 4, 5, 7, 8, 9}
    used = packing.containers_of(spark.createDataFrame(got)).toPandas()
    assert (used.unused_tokens >= 0).all() and used[used.container_kind == "k"].used_tokens.sum() == 77
    assert packing.placed(spark.createDataFrame([], "id bigint, n bigint"), "id", "n", kinds, "kind", "cap").count() == 0


def test_hot_keys_and_lengths_are_spread(spark):
    items = spark.range(400).select(F.lit(1).alias("id"), F.lit(10).alias("n"))
    kinds = spark.createDataFrame([("k", 100)], "kind string, cap int")
    used = packing.containers_of(packing.placed(items, "id", "n", kinds, "kind", "cap"))
    assert used.count() == 40 and used.where("unused_tokens > 0").count() == 0
    parts = packing.placed(items, "id", "n", kinds, "kind", "cap", group=100)
    groups = parts.groupBy((F.col("container_id") % 4).alias("g")).count().toPandas()
    assert len(groups) == 4 and groups["count"].max() < 160


# ---- mixing

def test_mix_keeps_shares_and_caps(spark):
    rng = np.random.default_rng(2)
    docs = [(i, s, int(rng.integers(20, 400))) for i, s in enumerate(["big"] * 900 + ["mid"] * 300 + ["small"] * 60 + [None] * 3 + ["other"] * 20)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "big", 0.4, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.3, 5), ("n", "other", 1.0, 1), ("n", "absent", 0.0, 3)], "mix_id string, source string, target_share double, max_repeats int")
    chosen = mixing.selection(df, targets)
    got = {(r["mix_id"], r["source"]): r for r in mixing.shares(chosen, targets).collect()}
    for s, share, cap in (("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.3, 5)):
        assert abs(got["m", s]["actual_share"] - share) < 0.002 and got["m", s]["most_copies"] <= cap
    assert got["n", "other"]["actual_share"] == 1.0 and got["n", "absent"]["tokens"] == 0
    cells = mixing.plan(df.select("source", "n_tokens"), targets)
    for (m, s), c in cells.items():  # the rates solve the dual
        t = np.array([x[2] for x in docs if x[1] == s], float)
        rate = np.minimum(c["cap"], np.exp(np.minimum(c["l"] * t / c["mean"], 50.0)))
        assert abs((rate * t).sum() - c["target"]) < 1e-6 * c["target"]
        far = mixing.plan(df.select("source", "n_tokens"), targets, histogram=0)[m, s]
        assert far["l"] == pytest.approx(c["l"], rel=1e-6)  # the same by jobs
    assert mixing.selection(df.limit(0), targets).count() == 0


def test_mix_takes_all_it_can_and_repeated_keys_stand_apart(spark):
    docs = spark.createDataFrame([(None if i % 2 else 1, "s", 10 + i % 7) for i in range(300)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "s", 1.0, 1), ("h", "s", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    got = mixing.selection(docs, targets)
    assert got.where("mix_id = 'm'").count() == 300 and got.where("copies > 1").count() == 0
    half = mixing.selection(docs, targets, fill=0.5).where("mix_id = 'm'").agg(F.sum(F.col("copies") * F.col("n_tokens"))).head()[0]
    assert abs(half - docs.agg(F.sum("n_tokens")).head()[0] / 2) <= 8  # half of the shortest


# ---- abuse

def test_phrases_alone_tell_kinds_apart():
    model = abuse.fit([])
    bad, good = model.scores(list(abuse.OFFENSIVE)), model.scores(list(abuse.HARMLESS))
    assert (bad > 0.5).mean() > 0.95 and (good < 0.5).mean() > 0.95


def test_learns_from_noisy_labels(spark):
    offences = ["zorg blip fnord", "quux mumble frotz"]
    rng = random.Random(5)
    docs = []
    for i in range(400):
        bad = i % 5 == 0
        body = [_mail(i)] + ([rng.choice(offences).capitalize() + "!"] if bad else [])
        docs.append(("\n\n".join(body), int(bad) if rng.random() > 0.1 else int(not bad)))
    model = abuse.fit(docs)
    scores = model.scores([_mail(1000) + "\n\nZorg blip fnord!", _mail(1001), "", "Z o r g"])
    assert scores[0] > abuse.LIMIT > scores[1] and scores[2] == 0
    assert len(model.kept) < 1 << 15


def test_disguises():
    reader = abuse.Reader(["cabrao", "merdoso", "bastard"])
    for said in ("c4brã0", "cabrããããão", "c.a.b.r.ã.o", "c-a-b-r-a-o", "c a b r a o", "cabr_o", "CABRÃO"):
        assert "cabrao" in reader.tokens(f"és um {said} grande"), said
    assert reader.tokens("às 14h30 CTR-29918 srv2024")[-1] != "srvzoz"


def test_disguises_at_the_ends():
    reader = abuse.Reader(["puta", "chupo", "chupa", "idiota", "merda"])
    for said, meant in (("put4", "puta"), ("nu4", "nua"), ("merd4!", "merda"), ("chup0", "chupo"), ("chvp0", "chupo"), ("chvpa", "chupa"), ("bat1", "bati"), ("1diota", "idiota"), ("1d10ta", "idiota"), ("cala-t3", "te"), ("nova", "nova")):
        assert meant in reader.tokens(f"és um {said} grande"), said
    assert "te" not in reader.tokens("um t3 em lisboa")
    assert reader.tokens("às 14h30 CTR-29918 srv2024 a4 2024")[-1] not in ("srvzoz", "srvzoza")


def test_scored_frame(spark):
    model = abuse.fit([])
    df = spark.createDataFrame([(1, None), (2, ""), (3, "és um cabrão"), (3, "és um cabrão"), (None, "A fatura continua por regularizar. " * 5000)], "doc_id bigint, t string")
    got = abuse.scored(df, "t", ["doc_id"], model).collect()
    assert len(got) == 5 and sorted(r["score"] > 0.5 for r in got) == [False, False, False, True, True]
    assert abuse.scored(df.limit(0), "t", ["doc_id"], model).count() == 0
    labels = spark.createDataFrame([(3, "offensive"), (3, None), (None, "none")], "doc_id bigint, label string")
    assert isinstance(abuse.fit_on(df, labels, "doc_id", "t", "label"), abuse.Model)


def test_pandas_is_used_in_batches():
    assert isinstance(repetition.measure([]), pd.DataFrame) and F is not None
