"""Queries of the evaluation operators over whole tables, each beside the SQL that must agree with it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridraft.functions import text as T
from veridraft.operators import analysis, comparison, criteria, dialect, quality, rescoring, rows, scorecard
from veridraft.operators.exactly_once import STRIPPED, read_id
from veridraft.session import scratch_path, spread, table
from veridraft.sources import jsonl

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


_SPACES = " || ".join(f"chr({ord(c)})" for c in STRIPPED)
ID = f"nullif(trim(id, {_SPACES}), '')"
OK = "(status = 'success' AND status IS NOT NULL AND coalesce(error, '') = '')"
PT = f"({OK} AND coalesce(trim(lower(target_lang)) = 'pt-pt', false))"
VALID = "({0} IS NOT NULL AND NOT isnan({0}::DOUBLE) AND {0}::DOUBLE >= 0 AND {0}::DOUBLE < 'inf'::DOUBLE)"
#: Two runs that are compared, and the answers that a rule reads.
FIRST, SECOND = "luminar/atlas-34b-instruct", "norvento/atlas-70b-chat"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


def _texts(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table of texts, over all cores if its files are few."""
    return spread(table(spark, d, name).select(*columns))


# ---- style, structure, repetition, profile

_TOK = f"regexp_extract_all({{0}}, {q(T.WORD)})"


def _n_tok(x: str) -> str:
    return f"len(regexp_extract_all(lower({x}), {q(T.WORD)}))"


def _style_sql(x: str) -> dict[str, str]:
    return {
        "excessive_allcaps": f"len(list_filter(regexp_extract_all({x}, {q(T.WORD)}), lambda w: regexp_matches(w, {q(T.CAPITALS)}))) > 2",
        "excessive_exclamation": f"regexp_matches({x}, {q(T.SHOUTING)})",
        "run_on_block": f"regexp_matches({x}, {q(T.RUN_ON)})",
        "informal_contraction": f"len(list_filter(regexp_extract_all({x}, {q(T.APOSTROPHE)}), lambda w: NOT regexp_matches(w, {q(T.CONTRACTION)}))) > 1",
        "punctuation_anomaly": f"(regexp_matches({x}, {q(T.SPACED_MARK)}) OR regexp_matches({x}, {q(T.LOWER_START)}))",
    }


_STYLE = ", ".join(f"{v} AS {k}" for k, v in _style_sql("text").items())


@query(f"SELECT doc_id, {_STYLE} FROM documents")
def style_flags(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "documents", "doc_id", "text").select("doc_id", *[f.alias(n.lower()) for n, f in quality.style_flags("text").items()])


@query(f"""WITH s AS (SELECT lang, {_STYLE} FROM documents)
SELECT lang, count(*) AS n, count_if(excessive_allcaps) AS caps, count_if(excessive_exclamation) AS excl, count_if(run_on_block) AS run_on, count_if(informal_contraction) AS contractions,
count_if(punctuation_anomaly) AS punct,
round(avg(greatest(0.0, 100 - least(18.0, 2.0 * (excessive_allcaps::INT + excessive_exclamation::INT + run_on_block::INT + informal_contraction::INT + punctuation_anomaly::INT)))), 6) AS style_score
FROM s GROUP BY lang""")
def style_scorecard(spark: SparkSession, d: str) -> DataFrame:
    flags = style_flags_of(_texts(spark, d, "documents", "lang", "text"))
    points = F.least(F.lit(quality.CAPS["style"]), sum(F.col(n).cast("int") for n in _STYLE_NAMES) * quality.PENALTIES["style", "medium"])
    counts = [F.count_if(c).alias(a) for c, a in zip(_STYLE_NAMES, ("caps", "excl", "run_on", "contractions", "punct"))]
    return flags.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *counts, F.round(F.avg(F.greatest(F.lit(0.0), 100 - points)), 6).alias("style_score"))


_STYLE_NAMES = tuple(_style_sql("x"))


def style_flags_of(docs: DataFrame) -> DataFrame:
    return docs.select("lang", *[f.alias(n.lower()) for n, f in quality.style_flags("text").items()])


@query(f"SELECT doc_id, {_n_tok('text')} AS n_tokens, len(regexp_extract_all(text, {q(T.WF_WORD)})) AS n_wf_words, len(regexp_extract_all(text, {q(T.LANGUAGE_WORD)})) AS n_language_words FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.n_tokens("text").alias("n_tokens"), F.size(T.matches("text", T.WF_WORD)).alias("n_wf_words"), F.size(T.matches("text", T.LANGUAGE_WORD)).alias("n_language_words"))


def _masked_sql(x: str) -> str:
    for p in (T.EMAIL, T.URL):
        x = f"regexp_replace({x}, {q(p)}, ' ', 'g')"
    edge = r"[^\p{L}\p{N}_]"
    for _ in range(2):  # neighbours share the character between them
        x = f"regexp_replace({x}, {q(f'(^|{edge}){T.NUMERIC_BODY}($|{edge})')}, '\\1 \\2', 'g')"
    return x


@query(f"SELECT row_seq, length({_masked_sql('content')}) AS masked_length, {_n_tok(_masked_sql('content'))} AS n_tokens FROM generation_results WHERE content IS NOT NULL")
def masked_text(spark: SparkSession, d: str) -> DataFrame:
    m = T.masked("content")
    return _t(spark, d, "generation_results").where("content IS NOT NULL").select("row_seq", F.length(m).alias("masked_length"), T.n_tokens(m).alias("n_tokens"))


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower({_masked_sql('text')}), {q(T.WORD)})) AS w, generate_subscripts(regexp_extract_all(lower({_masked_sql('text')}), {q(T.WORD)}), 1) AS i FROM documents),
f AS (SELECT doc_id, i, w, CASE WHEN w = lag(w) OVER p THEN 0 ELSE 1 END AS fresh FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f), n AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY doc_id, run)
SELECT d.doc_id, count_if(c >= 2) AS runs, count_if(c >= 3) AS long_runs FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id GROUP BY d.doc_id""")
def token_runs(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "documents", "doc_id", "text").select("doc_id", quality.token_runs("text").alias("r")).select("doc_id", "r.*")


_SAID = f"list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+|\\n+'), lambda s: regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '')), lambda s: length(s) > 12), lambda s: regexp_replace(lower(s), '\\s+', ' ', 'g'))"


@query(f"""WITH s AS (SELECT doc_id, {_SAID} AS said FROM documents), u AS (SELECT doc_id, unnest(said) AS s, generate_subscripts(said, 1) AS i FROM s),
c AS (SELECT doc_id, s, min(i) AS i, count(*) AS n FROM u GROUP BY doc_id, s) SELECT doc_id, arg_min(s, i) AS duplicate FROM c WHERE n > 1 GROUP BY doc_id""")
def duplicate_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", quality.duplicate_sentence("text").alias("duplicate")).where("duplicate IS NOT NULL")


def _phrase_sql(n: int) -> str:
    words = " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER p" for k in range(1, n)]])
    return f"""SELECT row_seq, {n} AS n, arg_min(g, i) AS phrase FROM (
  SELECT row_seq, g, min(i) AS i, list_sort(list(i))[1:8] AS places FROM (SELECT row_seq, i, {words} AS g FROM t WINDOW p AS (PARTITION BY row_seq ORDER BY i)) WHERE g IS NOT NULL GROUP BY row_seq, g HAVING count(*) > 1)
  WHERE len(list_filter(range(2, len(places) + 1), lambda k: places[k] - places[k - 1] >= {n})) > 0 GROUP BY row_seq"""


@query(f"""WITH t AS (SELECT row_seq, unnest(regexp_extract_all(lower({_masked_sql('content')}), {q(T.WORD)})) AS w, generate_subscripts(regexp_extract_all(lower({_masked_sql('content')}), {q(T.WORD)}), 1) AS i
 FROM generation_results WHERE content IS NOT NULL), a AS ({' UNION ALL '.join(_phrase_sql(n) for n in (7, 6, 5))})
SELECT row_seq, max(n) AS n, arg_max(phrase, n) AS phrase FROM a GROUP BY row_seq""")
def repeated_phrases(spark: SparkSession, d: str) -> DataFrame:
    return quality.phrases(_t(spark, d, "generation_results"), "row_seq", "content")


_PARTS = "list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', ''), '\\n\\s*\\n'), lambda p: regexp_replace(regexp_replace(p, '^\\s+', ''), '\\s+$', '')), lambda p: p <> '')"
_LINES = "list_filter(list_transform(regexp_split_to_array({0}, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '')"
_SAID_BODY = "list_filter(regexp_split_to_array(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s, ' ') <> '')"


def _structure_ctes(name: str, key: str, text: str) -> str:
    """Common tables that end in ``f``: parts of each text of a table, and ``g``: its structural findings."""
    return f"""
a AS (SELECT {key} AS k, {text} AS t, {_PARTS.format(text)} AS parts FROM {name} WHERE {text} IS NOT NULL),
b AS (SELECT k, t, parts, list_transform(parts, lambda p: len(list_filter({_LINES.format('p')}, lambda x: NOT regexp_matches(x, {q(T.HEADER)}))) = 0) AS headed FROM a),
c AS (SELECT k, t, parts, CASE WHEN list_position(headed, false) > 0 THEN parts[list_position(headed, false):] ELSE [] END AS content FROM b),
e AS (SELECT k, t, parts, content, len(content) AS n, array_to_string(CASE WHEN len(content) > 2 THEN content[2:len(content) - 1] ELSE content END, ' ') AS body, {_LINES.format('content[1]')}[1:4] AS opening,
 content[len(content)] AS last, {_LINES.format('content[len(content)]')} AS own FROM c),
f AS (SELECT *, {_SAID_BODY} AS said, array_to_string(own, ' ') AS joined FROM e),
g AS (SELECT k, t, content, n >= 2 AND len(list_filter(opening, lambda x: regexp_matches(x, {q(T.GREETING)}))) = 0 AS missing_greeting, n > 0 AND {_n_tok('body')} < 5 AS empty_body,
n >= 2 AND NOT (len(own) > 0 AND len(own) <= 8 AND {_n_tok('last')} <= 35 AND (regexp_matches(joined, {q(T.EMAIL)}) OR regexp_matches(joined, {q(T.URL)}) OR regexp_matches(joined, {q(T.CONTACT)})
 OR (len(own) <= 3 AND regexp_matches(own[1], '[,;:]$')) OR (len(own) <= 4 AND {_n_tok('last')} <= 18))) AS missing_signoff,
n > 0 AND len(said) > 3 AND len(list_filter(said, lambda s: {_n_tok('s')} < 4)) / len(said) > 0.40 AS fragmented,
CASE WHEN n > 0 THEN len(list_filter(parts, lambda p: {_n_tok('p')} > 200)) ELSE 0 END AS degenerate_paragraphs FROM f)"""


@query(f"WITH {_structure_ctes('generation_results', 'row_seq', 'content')} SELECT k AS row_seq, missing_greeting, empty_body, missing_signoff, fragmented, degenerate_paragraphs FROM g")
def structure_flags(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "generation_results", "row_seq", "content").where("content IS NOT NULL").select("row_seq", quality.structure("content").alias("s")).select("row_seq", "s.*")


def _findings_ctes(name: str, key: str, text: str) -> str:
    """Common tables that end in ``w``: for each text that is not blank its findings by rule."""
    words = f"regexp_extract_all(lower(masked), {q(T.WORD)})"
    gram = lambda n: " || ' ' || ".join(["w", *[f"lead(w, {i}) OVER p" for i in range(1, n)]])
    phrase = " UNION ALL ".join(
        f"""SELECT k FROM (SELECT k, g, list_sort(list(i))[1:8] AS places FROM (SELECT k, i, {gram(n)} AS g FROM tok WINDOW p AS (PARTITION BY k ORDER BY i)) WHERE g IS NOT NULL GROUP BY k, g HAVING count(*) > 1)
 WHERE len(list_filter(range(2, len(places) + 1), lambda x: places[x] - places[x - 1] >= {n})) > 0"""
        for n in (7, 6, 5)
    )
    style = " + ".join(f"({v})::INT" for v in _style_sql("scoring").values())
    return f"""{_structure_ctes(name, key, text)},
h AS (SELECT *, CASE WHEN len(content) > 0 THEN array_to_string(content, chr(10) || chr(10)) ELSE regexp_replace(regexp_replace(t, '^\\s+', ''), '\\s+$', '') END AS scoring FROM g WHERE regexp_replace(t, '\\s+', '', 'g') <> ''),
m AS (SELECT *, {_masked_sql('scoring')} AS masked FROM h),
tok AS (SELECT k, unnest({words}) AS w, generate_subscripts({words}, 1) AS i FROM m),
fresh AS (SELECT k, i, CASE WHEN w = lag(w) OVER p THEN 0 ELSE 1 END AS fresh FROM tok WINDOW p AS (PARTITION BY k ORDER BY i)),
runs AS (SELECT k, run, count(*) AS c FROM (SELECT k, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS run FROM fresh) GROUP BY k, run),
repeats AS (SELECT k, count_if(c >= 2) AS runs, count_if(c >= 3) AS long_runs FROM runs GROUP BY k),
ph AS (SELECT DISTINCT k FROM ({phrase})),
du AS (SELECT DISTINCT k FROM (SELECT k, unnest({_SAID.replace('(text,', '(masked,')}) AS s FROM m) GROUP BY k, s HAVING count(*) > 1),
w AS (SELECT m.*, {style} AS style, coalesce(runs, 0) AS runs, coalesce(long_runs, 0) AS long_runs, m.k IN (SELECT k FROM ph) AS phrase, m.k IN (SELECT k FROM du) AS duplicate FROM m LEFT JOIN repeats ON m.k = repeats.k)"""


_TAKEN = """least(18.0, 2.0 * style) + least(40.0, 4.8 * missing_greeting::INT + 12.0 * empty_body::INT + 2.1 * missing_signoff::INT + 6.0 * fragmented::INT + 6.0 * degenerate_paragraphs)
 + least(40.0, 14.0 * long_runs + 8.0 * (runs - long_runs) + 14.0 * duplicate::INT + 4.0 * phrase::INT)"""
_COUNTS = "runs + phrase::INT + duplicate::INT AS repetition_count, missing_greeting::INT + empty_body::INT + missing_signoff::INT + fragmented::INT + degenerate_paragraphs AS structural_issue_count, style AS style_issue_count"


@query(f"WITH {_findings_ctes('wq_human_reference', 'id', 'email')} SELECT r.id, round(greatest(0.0, 100 - ({_TAKEN})), 1) AS defect_score FROM wq_human_reference r LEFT JOIN w ON r.id = w.k")
def defect_scores(spark: SparkSession, d: str) -> DataFrame:
    return quality.defect_scores(_texts(spark, d, "wq_human_reference", "id", "email"), "email").select("id", "defect_score")


@query(f"WITH {_findings_ctes('generation_results', 'row_seq', 'content')} SELECT k AS row_seq, {_COUNTS} FROM w")
def dimension_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many findings of each dimension every answer has."""
    rows = quality.findings(_texts(spark, d, "generation_results", "row_seq", "content"), "content").where("found IS NOT NULL")
    return rows.select("row_seq", *[n.cast("bigint").alias(c) for c, n in quality.counts(F.col("found")).items()])


@query(f"WITH {_findings_ctes('generation_results', 'row_seq', 'content')} SELECT model, round(100.0 * avg((runs + phrase::INT + duplicate::INT > 0)::INT), 6) AS repetition_pct, count(*) AS n FROM generation_results g JOIN w ON g.row_seq = w.k WHERE {OK} GROUP BY model")
def repetition_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of each model's successful answers with a repetition."""
    rows = quality.findings(_texts(spark, d, "generation_results", "row_seq", "model", "status", "error", "content").where(rows_ok()), "content").where("found IS NOT NULL")
    return rows.groupBy("model").agg(F.round(100.0 * F.avg((quality.counts(F.col("found"))["repetition_count"] > 0).cast("int")), 6).alias("repetition_pct"), F.count(F.lit(1)).alias("n"))


def rows_ok():
    return rows.successful()


#: A small ensemble of our own: the frozen one is not part of this library.
CALIBRATION = {
    "features": ["sentence_length_sd", "lexical_diversity", "register_quality", "rhythm_quality", "defect"], "init_value": 3.0, "learning_rate": 0.5, "score_mapping": {"base": 10.0, "per_level": 18.0},
    "trees": [
        [{"feature": 4, "threshold": 0.85, "left": 1, "right": 2}, {"left": -1, "value": -1.5}, {"feature": 2, "threshold": 0.6, "left": 3, "right": 4}, {"left": -1, "value": 0.5}, {"left": -1, "value": 2.0}],
        [{"feature": 1, "threshold": 0.7, "left": 1, "right": 2}, {"left": -1, "value": -0.5}, {"feature": 0, "threshold": 4.0, "left": 3, "right": 4}, {"left": -1, "value": 0.25}, {"left": -1, "value": 0.75}],
    ],
}
_LATENT = """greatest(1.0, least(5.0, 3.0 + 0.5 * (CASE WHEN d / 100 <= 0.85 THEN -1.5 WHEN register_quality <= 0.6 THEN 0.5 ELSE 2.0 END) + 0.5 * (CASE WHEN lexical_diversity <= 0.7 THEN -0.5 WHEN sentence_length_sd <= 4.0 THEN 0.25 ELSE 0.75 END)))"""


def _profile_ctes(name: str, key: str, text: str, source: str) -> str:
    """Common tables that end in ``z``: the profile of each text; ``source``: what stands before them, or nothing."""
    n1 = _n_tok
    return f"""{source}
pa AS (SELECT {key} AS k, {_PARTS.format(text)} AS parts FROM {name} WHERE {text} IS NOT NULL),
pb AS (SELECT k, parts, list_transform(parts, lambda p: len(list_filter({_LINES.format('p')}, lambda x: NOT regexp_matches(x, {q(T.HEADER)}))) = 0) AS headed FROM pa),
pc AS (SELECT k, parts, CASE WHEN list_position(headed, false) > 0 THEN parts[list_position(headed, false):] ELSE [] END AS content FROM pb),
pd AS (SELECT k, parts, trim(array_to_string(CASE WHEN len(content) > 2 THEN content[2:len(content) - 1] ELSE content END, ' '), ' ') AS body, parts[len(parts)] AS last FROM pc),
pe AS (SELECT k, parts, last, regexp_extract_all(lower(body), {q(T.WORD)}) AS words, list_transform(list_filter(regexp_split_to_array(body, '[.!?]+'), lambda s: trim(s, ' ') <> ''), lambda s: {n1('s')}) AS sizes,
 {n1("coalesce(trim(regexp_split_to_array(parts[1], '\\r?\\n')[1], ' '), '')")} AS greeting, {_LINES.format('last')} AS own FROM pd),
pf AS (SELECT *, len(sizes) AS s, len(words) AS n, coalesce(list_avg(sizes), 0.0) AS mean, CASE WHEN len(sizes) > 0 THEN sqrt(greatest(0.0, list_avg(list_transform(sizes, lambda x: x * x)) - list_avg(sizes) * list_avg(sizes))) ELSE 0.0 END AS sd FROM pe),
z AS (SELECT k, n::DOUBLE AS body_token_count, s::DOUBLE AS sentence_count, round(mean, 3) AS average_sentence_length, round(CASE WHEN n > 0 THEN len(list_distinct(words)) / n ELSE 0.0 END, 4) AS lexical_diversity, round(sd, 3) AS sentence_length_sd, greeting::DOUBLE AS greeting_token_count,
 round(((CASE WHEN greeting <= 1 THEN 0.55 WHEN greeting = 2 THEN 0.72 WHEN greeting = 3 THEN 0.84 WHEN greeting <= 5 THEN 0.94 ELSE 1.0 END)::DOUBLE + (CASE WHEN NOT coalesce(len(parts) > 1 AND len(own) BETWEEN 1 AND 5 AND {n1('last')} <= 20 AND NOT regexp_matches(last, {q(T.MID_END)}), false) THEN 0.40
  WHEN {n1('own[1]')} <= 1 THEN 0.65 WHEN {n1('own[1]')} = 2 THEN 0.78 WHEN {n1('own[1]')} <= 4 THEN 0.90 ELSE 0.96 END)::DOUBLE) / 2, 4) AS register_quality,
 round(least(1.0, n / 80), 4) AS length_quality, round(least(1.0, s / 4), 4) AS sentence_count_quality, round(CASE WHEN mean > 0 THEN greatest(0.0, 1 - abs(mean - 16) / 32) ELSE 0.0 END, 4) AS sentence_length_quality,
 round(CASE WHEN s <= 1 THEN 0.65 WHEN sd < 1 THEN 0.82 WHEN sd <= 7 THEN 1.0 ELSE greatest(0.65, 1 - (sd - 7) / 15) END, 4) AS rhythm_quality FROM pf)"""


_MEASURES = ("body_token_count", "sentence_count", "average_sentence_length", "lexical_diversity", "sentence_length_sd", "greeting_token_count", "register_quality", "length_quality", "sentence_count_quality", "sentence_length_quality", "rhythm_quality")


@query(f"WITH {_profile_ctes('wq_human_reference', 'id', 'email', '')} SELECT k AS id, {', '.join(_MEASURES)} FROM z")
def quality_profile(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "wq_human_reference", "id", "email").where("email IS NOT NULL").select("id", quality.profile("email").alias("p")).select("id", *[F.col("p." + m).alias(m) for m in _MEASURES])


@query(f"""WITH {_findings_ctes('wq_human_reference', 'id', 'email')}, {_profile_ctes('w', 'k', 'scoring', '')},
s AS (SELECT w.*, z.* EXCLUDE (k), round(greatest(0.0, 100 - ({_TAKEN})), 1) AS d FROM w JOIN z ON w.k = z.k)
SELECT r.id, coalesce(repetition_count, 0)::BIGINT AS repetition_count, coalesce(structural_issue_count, 0)::BIGINT AS structural_issue_count, coalesce(style_issue_count, 0)::BIGINT AS style_issue_count, d AS wq_defect_only_score,
round(least(d, 10.0 + 18.0 * {_LATENT}, 99.9), 1) AS writing_quality_score, d IS NOT NULL AS wq_scored FROM wq_human_reference r LEFT JOIN (SELECT *, {_COUNTS} FROM s) s ON r.id = s.k""")
def writing_quality(spark: SparkSession, d: str) -> DataFrame:
    """The composed evaluation of every email, with an ensemble of our own."""
    out = quality.evaluate(_texts(spark, d, "wq_human_reference", "id", "email"), "id", "email", calibration=CALIBRATION)
    return out.select("id", "repetition_count", "structural_issue_count", "style_issue_count", "wq_defect_only_score", "writing_quality_score", "wq_scored")


@query("SELECT id, email IS NULL OR regexp_replace(email, '\\s+', '', 'g') = '' AS blank FROM wq_human_reference")
def excluded_quality(spark: SparkSession, d: str) -> DataFrame:
    """Without a calibration nothing is scored; blank texts say so."""
    out = quality.evaluate(_texts(spark, d, "wq_human_reference", "id", "email"), "id", "email")
    return out.where("NOT wq_scored AND writing_quality_score IS NULL").select("id", (F.col("wq_excluded_reason") == "empty_text").alias("blank"))


@query("SELECT id, regexp_replace(regexp_replace(t, '^(?:[ \\t]*\\n)?(?:[ \\t]*[A-Za-z][A-Za-z0-9-]{1,50}[ \\t]*:[^\\n]*(?:\\n|$))+(?:[ \\t]*\\n)*', ''), '^\\n+|\\n+$', '', 'g') AS body FROM (SELECT id, 'Subject: ' || coalesce(subject, '') || chr(10) || 'X-Task: ' || task_type || chr(10) || chr(10) || email AS t FROM wq_human_reference WHERE email IS NOT NULL)")
def stripped_fixtures(spark: SparkSession, d: str) -> DataFrame:
    """Emails under header lines, read back without them."""
    r = _t(spark, d, "wq_human_reference").where("email IS NOT NULL")
    text = F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\nX-Task: "), F.col("task_type"), F.lit("\n\n"), F.col("email"))
    return r.select("id", text.alias("t")).select("id", T.without_fixture_headers("t").alias("body"))


# ---- rows, validation, costs

@query(f"SELECT model, count_if({OK}) AS successes, count_if({PT}) AS pt_successes, count(*) AS n_rows FROM generation_results GROUP BY model")
def success_counts(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "generation_results")
    return r.groupBy("model").agg(F.count_if(rows.successful()).alias("successes"), F.count_if(rows.successful() & rows.portuguese()).alias("pt_successes"), F.count(F.lit(1)).alias("n_rows"))


def _errors_sql(name: str, generation: bool) -> str:
    c0 = "json_extract(raw_response, '$.choices[0]')"
    ok = "coalesce(status = 'success', false)"
    rules = [
        ("missing id", f"{ID} IS NULL"), ("missing model", "coalesce(trim(model), '') = ''"), ("status must be success or error", "NOT coalesce(status IN ('success', 'error'), false)"),
        ("error status lacks error detail", "coalesce(status = 'error', false) AND coalesce(trim(error), '') = ''"), ("success row contains error detail", f"{ok} AND coalesce(error, '') <> ''"),
    ]
    if generation:
        rules += [
            ("successful generation lacks content", f"{ok} AND coalesce(trim(content, ' '), '') = ''"), ("successful generation lacks provider choices", f"{ok} AND raw_response IS NOT NULL AND {c0} IS NULL"),
            (rows.DAMAGED, f"{ok} AND {c0} IS NOT NULL AND coalesce(json_extract_string(raw_response, '$.choices[0].finish_reason') <> 'stop', false)"),
            ("provider refusal in successful generation", f"{ok} AND {c0} IS NOT NULL AND coalesce(json_extract_string(raw_response, '$.choices[0].message.refusal'), '') <> ''"),
            ("provider error in successful generation", f"{ok} AND {c0} IS NOT NULL AND json_extract_string(raw_response, '$.error') IS NOT NULL"),
        ]
    rules += [(f"{m} must be finite and non-negative", f"{m} IS NOT NULL AND NOT {VALID.format(m)}") for m in rows.MEASURES]
    return " UNION ALL ".join(f"SELECT row_seq, {q(r)} AS rule FROM {name} WHERE {test}" for r, test in rules)


@query(_errors_sql("generation_results", True))
def generation_row_errors(spark: SparkSession, d: str) -> DataFrame:
    return rows.row_errors(_t(spark, d, "generation_results"), "generation")


@query(_errors_sql("analysis_results", False))
def analysis_row_errors(spark: SparkSession, d: str) -> DataFrame:
    return rows.row_errors(_t(spark, d, "analysis_results"), "analysis")


@query(f"SELECT model, {ID} AS id, count(*) AS n FROM analysis_results WHERE {ID} IS NOT NULL GROUP BY model, {ID} HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return rows.repeated_ids(_t(spark, d, "analysis_results"), ["model"])


@query(f"SELECT DISTINCT {ID} AS id FROM analysis_results WHERE {ID} IS NOT NULL AND {ID} NOT IN (SELECT id FROM analysis_reference)")
def unexpected_ids(spark: SparkSession, d: str) -> DataFrame:
    return analysis.unexpected(_t(spark, d, "analysis_reference"), _t(spark, d, "analysis_results"))


@query(f"SELECT DISTINCT id FROM analysis_reference WHERE id NOT IN (SELECT {ID} FROM analysis_results WHERE {ID} IS NOT NULL)")
def unanswered_ids(spark: SparkSession, d: str) -> DataFrame:
    return analysis.unanswered(_t(spark, d, "analysis_reference"), _t(spark, d, "analysis_results"))


_KEPT = "SELECT model, {0} AS id, {1}(row_seq) AS row_seq FROM generation_results WHERE {0} IS NOT NULL GROUP BY model, {0}"


@query(_KEPT.format(ID, "min"))
def first_answers(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "generation_results").select("model", read_id("id").alias("id"), "row_seq").where("id IS NOT NULL")
    return rows.first_of(r, ["model", "id"], "row_seq")


@query(_KEPT.format(ID, "max"))
def last_answers(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "generation_results").select("model", read_id("id").alias("id"), "row_seq").where("id IS NOT NULL")
    return rows.first_of(r, ["model", "id"], "row_seq", last=True)


_TOLD = "coalesce(cost_usd, try_cast(json_extract_string(raw_response, '$.usage.cost_details.upstream_inference_cost') AS DOUBLE), try_cast(json_extract_string(raw_response, '$.usage.cost') AS DOUBLE))"
_COST = f"coalesce(CASE WHEN {VALID.format(_TOLD)} THEN {_TOLD} END, CASE WHEN {_TOLD} IS NULL THEN prompt_tokens / 1000 * p.prompt_price_per_1k + completion_tokens / 1000 * p.completion_price_per_1k END)"


@query(f"SELECT row_seq, round({_COST}, 9) AS cost FROM generation_results g LEFT JOIN price p ON g.model = p.model")
def costs(spark: SparkSession, d: str) -> DataFrame:
    return rows.recorded_cost(_t(spark, d, "price"), _t(spark, d, "generation_results")).select("row_seq", F.round("cost", 9).alias("cost"))


# ---- scorecard

def _mean_sql(x: str, when: str) -> str:
    return f"avg(CASE WHEN {when} THEN {x} END)"


def _scorecard_sql() -> str:
    wq = "writing_quality"
    out = ["count(*) AS samples", "count_if(ok) AS successful_samples", "count_if(NOT ok) AS failed_samples", "count_if(pt) AS ptpt_samples"]
    for name, column, only in scorecard.MEANS:
        when = "pt" if only else "ok"
        out += [f"round({_mean_sql(column, when)}, 9) AS {name}", f"count(CASE WHEN {when} THEN {column} END) AS n_{name}"]
    v, tool = "dialect_evaluation.ptbr_violation_count", f"coalesce(bool_or(CASE WHEN ok THEN {wq}.languagetool_api_used END), false)"
    v = f"CASE WHEN {v} >= 0 THEN {v} END"
    share = "round(avg(CASE WHEN {w} AND ({t}) IS NOT NULL THEN CASE WHEN {t} THEN 100.0 ELSE 0.0 END END), 9)"
    timed = f"{VALID.format('started_at')} AND {VALID.format('finished_at')}"
    lat = f"CASE WHEN ok AND {VALID.format('latency_ms')} THEN latency_ms END"
    out += [
        share.format(w="pt", t="ptbr_leakage_detected") + " AS ptbr_leakage_pct", "count(CASE WHEN pt THEN ptbr_leakage_detected END) AS n_ptbr_leakage_pct",
        f"round({_mean_sql(v, 'pt')}, 9) AS avg_ptbr_violations_per_email", f"count(CASE WHEN pt THEN {v} END) AS n_avg_ptbr_violations_per_email",
        f"round({_mean_sql('wf_evaluation.weighted_leaks', 'pt')}, 9) AS avg_wf_penalty_per_email", "count(CASE WHEN pt THEN wf_evaluation.weighted_leaks END) AS n_avg_wf_penalty_per_email",
        f"{tool} AS languagetool_available", f"round(CASE WHEN {tool} THEN {_mean_sql(wq + '.grammar_error_count', 'ok')} END, 9) AS avg_grammar_errors_per_email",
        f"CASE WHEN {tool} THEN count(CASE WHEN ok THEN {wq}.grammar_error_count END) ELSE 0 END AS n_avg_grammar_errors_per_email", f"round({_mean_sql(wq + '.spelling_error_count', 'ok')}, 9) AS avg_spelling_errors_per_email",
        share.format(w="ok", t=f"{wq}.structural_issue_count > 0") + " AS structural_failures_pct", f"count(CASE WHEN ok THEN {wq}.structural_issue_count END) AS n_structural_failures_pct", f"count(CASE WHEN ok THEN {wq}.spelling_error_count END) AS n_avg_spelling_errors_per_email",
        "CAST(NULL AS DOUBLE) AS repetition_pct", "CAST(0 AS BIGINT) AS n_repetition_pct", f"count({lat}) AS n_latency_ms",
        *[f"round(quantile_cont({lat}, {p / 100}), 9) AS latency_p{p}_ms" for p in (50, 90, 95, 99)],
        f"round(greatest(0.0, max(CASE WHEN {timed} THEN finished_at END) - min(CASE WHEN {timed} THEN started_at END)) * 1000, 3) AS observed_wall_ms",
        "sum(CASE WHEN ok THEN coalesce(prompt_tokens, 0) END)::BIGINT AS prompt_tokens", "sum(CASE WHEN ok THEN coalesce(completion_tokens, 0) END)::BIGINT AS completion_tokens",
        "count(CASE WHEN ok THEN cost END) AS known_cost_samples", "count_if(ok AND cost IS NULL) AS unknown_cost_samples",
        f"CASE WHEN count(DISTINCT CASE WHEN ok THEN {wq}.wq_evaluator_version END) > 1 THEN 'mixed' ELSE max(CASE WHEN ok THEN {wq}.wq_evaluator_version END) END AS wq_evaluator_version",
        f"round(count_if(ok) / (nullif(greatest(0.0, max(CASE WHEN {timed} THEN finished_at END) - min(CASE WHEN {timed} THEN started_at END)), 0) / 60), 9) AS throughput_emails_per_min",
        f"round((sum(CASE WHEN ok THEN coalesce(prompt_tokens, 0) END) + sum(CASE WHEN ok THEN coalesce(completion_tokens, 0) END)) / nullif(greatest(0.0, max(CASE WHEN {timed} THEN finished_at END) - min(CASE WHEN {timed} THEN started_at END)), 0), 9) AS tokens_per_second",
        "round(CASE WHEN count_if(ok AND cost IS NULL) = 0 THEN sum(CASE WHEN ok THEN cost END) END, 9) AS total_cost_usd",
        "round(CASE WHEN count_if(ok AND cost IS NULL) = 0 AND count_if(ok) > 0 THEN avg(CASE WHEN ok THEN cost END) * 1000 END, 9) AS cost_per_1k_emails_usd",
        "round(avg(CASE WHEN ok THEN cost END) * 1000, 9) AS cost_per_1k_emails_usd_known_only",
    ]
    return f"SELECT model, {', '.join(out)} FROM (SELECT g.*, {OK} AS ok, {PT} AS pt, {_COST} AS cost FROM generation_results g LEFT JOIN price p ON g.model = p.model) GROUP BY model"


def _card(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.scorecard(_t(spark, d, "generation_results"), _t(spark, d, "price"), ["model"])


@query(_scorecard_sql())
def generation_scorecard(spark: SparkSession, d: str) -> DataFrame:
    card = _card(spark, d)
    return card.select(*[F.round(c, 3 if c == "observed_wall_ms" else 9).alias(c) if t == "double" else F.col(c) for c, t in card.dtypes])


_N = [c for c in (*[m for m, _, _ in scorecard.MEANS], "ptbr_leakage_pct", "avg_ptbr_violations_per_email", "avg_wf_penalty_per_email", "avg_grammar_errors_per_email", "structural_failures_pct", "repetition_pct", "latency_ms")]


@query(f"WITH c AS ({_scorecard_sql()}) " + " UNION ALL ".join(f"SELECT model, '{m}' AS metric, n_{m}::BIGINT AS n FROM c" for m in _N) + " UNION ALL SELECT model, 'cost_usd', known_cost_samples FROM c")
def metric_denominators(spark: SparkSession, d: str) -> DataFrame:
    out = scorecard.denominators(_card(spark, d), ["model"])
    return out.select("model", "metric", F.col("n").cast("bigint").alias("n"))


_UNAVAILABLE = [f"CASE WHEN n_{m} = 0 THEN '{m}' END" for m in scorecard.LISTED] + [f"CASE WHEN {m} IS NULL THEN '{m}' END" for m in ("throughput_emails_per_min", "tokens_per_second")]


@query(f"WITH c AS ({_scorecard_sql()}) SELECT model, array_to_string(list_sort(list_filter([{', '.join(_UNAVAILABLE)}], lambda x: x IS NOT NULL)), ',') AS unavailable_metrics FROM c")
def unavailable_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.unavailable(_card(spark, d), ["model"])


# ---- comparison

_SEPARATED = (("instruction_adherence_pct", 100.0), ("semantic_preservation_pct", 100.0), ("wf_score", 100.0), ("euptvid_probability", 1.0), ("avg_ptbr_violations_per_email", 1.0))


@query(f"WITH c AS ({_scorecard_sql()}), t AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6) AS value, n_{m} AS n, {u} AS scale FROM c" for m, u in _SEPARATED) + """),
g AS (SELECT metric, count(DISTINCT value) AS n_values, round(max(value) - min(value), 6) AS spread, round(max(scale) / coalesce(min(CASE WHEN n > 0 THEN n END), 1), 6) AS unit FROM t GROUP BY metric)
SELECT metric, n_values, spread, unit, coalesce(n_values > 1 AND spread > unit, false) AS separable FROM g""")
def metric_separability(spark: SparkSession, d: str) -> DataFrame:
    return comparison.separability(_card(spark, d), _SEPARATED)


_DELTAS = ("instruction_adherence_pct", "wf_score", "local_writing_quality")


@query(f"WITH c AS ({_scorecard_sql()}) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(max(CASE WHEN model = '{SECOND}' THEN {m} END) - max(CASE WHEN model = '{FIRST}' THEN {m} END), 5) AS delta FROM c" for m in _DELTAS))
def run_deltas(spark: SparkSession, d: str) -> DataFrame:
    return comparison.deltas(_card(spark, d), FIRST, SECOND, _DELTAS).withColumn("delta", F.round("delta", 5))


def _run_sql(model: str) -> str:
    return f"""SELECT id, writing_quality_score AS v FROM (SELECT {ID} AS id, arg_max(row_seq, row_seq) AS row_seq FROM generation_results WHERE model = '{model}' AND {ID} IS NOT NULL GROUP BY 1) k
JOIN (SELECT row_seq, writing_quality_score FROM generation_results WHERE {OK} AND writing_quality_score IS NOT NULL AND NOT isnan(writing_quality_score)) g USING (row_seq)"""


@query(f"""WITH d AS (SELECT b.v - a.v AS diff FROM ({_run_sql(FIRST)}) a JOIN ({_run_sql(SECOND)}) b ON a.id = b.id)
SELECT count(diff) AS n, round(avg(diff), 6) AS mean_difference, round(quantile_cont(diff, 0.5), 6) AS median_difference, count_if(diff > 0) AS wins, count_if(diff < 0) AS losses, count_if(diff = 0) AS ties FROM d""")
def paired_summary(spark: SparkSession, d: str) -> DataFrame:
    out = comparison.summary(comparison.paired(_t(spark, d, "generation_results"), FIRST, SECOND, "writing_quality_score"))
    return out.withColumn("mean_difference", F.round("mean_difference", 6)).withColumn("median_difference", F.round("median_difference", 6))


@query(f"""WITH k AS (SELECT model, {ID} AS id, max(row_seq) AS row_seq FROM generation_results WHERE {ID} IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2),
v AS (SELECT k.model, k.id, g.writing_quality_score AS v FROM k JOIN generation_results g ON g.row_seq = k.row_seq AND g.model = k.model WHERE {OK} AND writing_quality_score IS NOT NULL AND NOT isnan(writing_quality_score))
SELECT a.model AS first, b.model AS second, count(*) AS n, round(avg(b.v - a.v), 6) + 0.0 AS mean_difference, count_if(b.v > a.v) AS wins, count_if(b.v < a.v) AS losses, count_if(b.v = a.v) AS ties
FROM v a JOIN v b ON a.id = b.id AND a.model < b.model GROUP BY 1, 2""")
def run_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every run beside every later one, over the ids both answered."""
    return comparison.run_pairs(_t(spark, d, "generation_results"), "writing_quality_score").withColumn("mean_difference", F.round("mean_difference", 6) + 0.0)


@query()
def paired_interval(spark: SparkSession, d: str) -> DataFrame:
    return comparison.bootstrap(comparison.paired(_t(spark, d, "generation_results"), FIRST, SECOND, "writing_quality_score"))


@query(f"SELECT {ID} AS id FROM generation_results WHERE model = '{FIRST}' AND {ID} IS NOT NULL INTERSECT SELECT {ID} FROM generation_results WHERE model = '{SECOND}'")
def shared_ids(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "generation_results").select("model", read_id("id").alias("id")).where("id IS NOT NULL")
    return r.where(F.col("model") == FIRST).select("id").intersect(r.where(F.col("model") == SECOND).select("id"))


# ---- analysis

def _entities_sql(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(coalesce({x}, []), lambda e: regexp_replace(lower(trim(e, ' ')), '\\s+', ' ', 'g')), lambda e: e <> ''))"


def _analysis_sql() -> str:
    said = {c: f"json_extract_string(parsed, '$.{c}')" for c in analysis.COMPARED}
    said["action_required"] = "CASE json_type(parsed, '$.action_required') WHEN 'BOOLEAN' THEN json_extract_string(parsed, '$.action_required')::BOOLEAN END"
    a, b = _entities_sql("key_entities"), _entities_sql("from_json(json_extract(parsed, '$.key_entities'), '[\"VARCHAR\"]')")
    f1 = f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
    rate = "round(100 * avg(CASE WHEN scored THEN ({})::INT END), 2)"
    columns = [f"{rate.format(f't_{c} IS NOT DISTINCT FROM s_{c}')} AS {c}_pct" for c in analysis.COMPARED]
    return f"""WITH k AS (SELECT model, {ID} AS rid, min(row_seq) AS row_seq FROM analysis_results WHERE {ID} IS NOT NULL GROUP BY 1, 2),
r AS (SELECT k.model, k.rid, status, error, is_valid_schema, parse_repaired, CASE WHEN json_valid(parsed) AND json_type(parsed) = 'OBJECT' THEN parsed END AS parsed FROM k JOIN analysis_results a ON k.row_seq = a.row_seq AND k.model = a.model),
e AS (SELECT m.model, t.id, t.ground_truth AS g FROM analysis_reference t, (SELECT DISTINCT model FROM r) m),
j AS (SELECT e.model, r.rid IS NULL AS missing, r.rid IS NOT NULL AND (status = 'error' OR coalesce(error, '') <> '') AS failed, is_valid_schema, parse_repaired,
 {', '.join(f'g.{c} AS t_{c}, {s} AS s_{c}' for c, s in said.items())}, g.key_entities AS key_entities, parsed FROM e LEFT JOIN r ON e.model = r.model AND e.id = r.rid),
x AS (SELECT *, NOT missing AND NOT coalesce(failed, false) AS scored FROM j)
SELECT model, count(*) AS requested, count_if(missing) AS missing, count_if(coalesce(failed, false)) AS failed, count_if(scored) AS scored, {rate.format('coalesce(is_valid_schema, false)')} AS schema_pct,
{rate.format('coalesce(is_valid_schema, false) AND NOT parse_repaired')} AS schema_raw_pct, {rate.format('parse_repaired')} AS repaired_pct, count_if(scored AND parse_repaired IS NOT NULL) AS n_repaired, {', '.join(columns)}, round(avg(CASE WHEN scored THEN {f1} END), 4) AS entity_f1 FROM x GROUP BY model"""


@query(_analysis_sql())
def analysis_scores(spark: SparkSession, d: str) -> DataFrame:
    return analysis.score(_t(spark, d, "analysis_reference"), _t(spark, d, "analysis_results"))


@query("SELECT row_seq, trim(coalesce(nullif(regexp_extract(x, '(?is)^```\\s*(?:json)?\\s*\\n?(.*?)\\n?```\\s*$', 1), ''), x), ' ' || chr(10) || chr(13) || chr(9)) AS inside FROM (SELECT row_seq, trim(content, ' ') AS x FROM analysis_results WHERE content IS NOT NULL)")
def unfenced_content(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "analysis_results").where("content IS NOT NULL")
    return r.select("row_seq", F.btrim(analysis.unfenced("content"), F.lit(" \n\r\t")).alias("inside"))


def _schema_sql(x: str) -> str:
    kind = lambda k: f"json_type({x}, '$.{k}')"
    tests = [f"list_sort(json_keys({x})) = [{', '.join(q(k) for k in sorted(analysis.KEYS))}]"]
    tests += [f"{kind(k)} IN ('VARCHAR', 'NULL')" for k in analysis.STRINGS] + [f"{kind(k)} = 'VARCHAR' AND json_extract_string({x}, '$.{k}') IN ({', '.join(map(q, v))})" for k, v in analysis.ENUMS.items()]
    tests += [f"{kind('action_required')} = 'BOOLEAN'", f"{kind('summary')} = 'VARCHAR'"]
    tests += [f"{kind(k)} = 'ARRAY' AND len(list_filter(from_json(json_extract({x}, '$.{k}'), '[\"JSON\"]'), lambda e: json_type(e) <> 'VARCHAR')) = 0" for k in analysis.LISTS]
    return f"CASE WHEN json_valid({x}) THEN CASE WHEN json_type({x}) = 'OBJECT' THEN coalesce({' AND '.join(f'({t})' for t in tests)}, false) ELSE false END ELSE false END"


@query(f"SELECT row_seq, {_schema_sql('x')} AS valid FROM (SELECT row_seq, CASE WHEN json_valid(content) THEN CASE WHEN json_type(content) = 'OBJECT' THEN content ELSE '{{}}' END ELSE '{{}}' END AS x FROM analysis_results WHERE content IS NOT NULL)")
def schema_validity(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "analysis_results").where("content IS NOT NULL").select("row_seq", analysis.schema_valid("content").alias("valid"))


@query("""SELECT count(*) AS n, round(100 * avg((ground_truth.category = 'other')::INT), 2) AS category_pct, round(100 * avg((ground_truth.urgency = 'medium')::INT), 2) AS urgency_pct,
round(100 * avg((ground_truth.sentiment = 'neutral')::INT), 2) AS sentiment_pct, round(100 * avg(ground_truth.action_required::INT), 2) AS action_pct FROM analysis_reference""")
def constant_baseline(spark: SparkSession, d: str) -> DataFrame:
    """What an analysis that always says the same would score."""
    g = F.col("ground_truth")
    pct = lambda c: F.round(100 * F.avg(c.cast("int")), 2)
    return _t(spark, d, "analysis_reference").agg(F.count(F.lit(1)).alias("n"), pct(g["category"] == "other").alias("category_pct"), pct(g["urgency"] == "medium").alias("urgency_pct"), pct(g["sentiment"] == "neutral").alias("sentiment_pct"), pct(g["action_required"]).alias("action_pct"))


# ---- dialect

_VARIANT = "lower(trim(replace(lang, '_', '-'), ' '))"
_LEX = f"""lex AS (SELECT DISTINCT {_VARIANT} AS variant, lower(unnest(regexp_extract_all(email, {q(T.LANGUAGE_WORD)}))) AS form FROM wq_human_reference WHERE {_VARIANT} IN ('pt-pt', 'pt-br'))"""


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The words of the writing reference's emails by their variant, standing in for dictionaries. The rows that gold labels
    judge are of another table."""
    r = _t(spark, d, "wq_human_reference").select(F.lower(F.trim(F.replace("lang", F.lit("_"), F.lit("-")))).alias("variant"), "email").where("variant IN ('pt-pt', 'pt-br')")
    words = r.select("variant", F.explode(T.matches("email", T.LANGUAGE_WORD)).alias("form"))
    return words.withColumn("form", F.lower("form")).distinct().withColumn("folded", T.fold_diacritics("form"))


def _contrast_sql(key: str, text: str, name: str) -> str:
    return f"""SELECT {key}, lower(raw) AS word, bool_or(raw = lower(raw)) AS score_eligible FROM (SELECT {key}, unnest(list_distinct(list_filter(regexp_extract_all(regexp_replace({text}, '[A-Za-z][A-Za-z0-9+.-]*(://)', ' \\\\1', 'g'), {q(T.CONTRAST_WORD)}), lambda w: length(w) >= 3))) AS raw FROM {name} WHERE {text} IS NOT NULL)
 WHERE lower(raw) IN (SELECT form FROM lex WHERE variant = 'pt-br') AND lower(raw) NOT IN (SELECT form FROM lex WHERE variant = 'pt-pt') AND lower(raw) NOT IN ({', '.join(map(q, dialect.SCHEMES))}) GROUP BY {key}, lower(raw)"""


@query(f"WITH {_LEX} {_contrast_sql('row_seq', 'content', 'generation_results')}")
def lexical_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return dialect.contrasts(_t(spark, d, "generation_results"), "row_seq", "content", lexicon(spark, d))


@query(f"""WITH {_LEX}, f AS ({_contrast_sql('id', 'email', 'analysis_reference')}), j AS (SELECT r.id, reference_judgments.gold_ptbr_leakage AS g, count(f.word) > 0 AS d FROM analysis_reference r LEFT JOIN f ON r.id = f.id AND f.score_eligible GROUP BY r.id, g),
c AS (SELECT count_if(g AND d) AS tp, count_if(NOT g AND d) AS fp, count_if(g AND NOT d) AS fn, count_if(NOT g AND NOT d) AS tn FROM j WHERE g IS NOT NULL)
SELECT tp, fp, fn, tn, round(100.0 * tp / nullif(tp + fn, 0), 2) AS recall_pct, round(100.0 * tp / nullif(tp + fp, 0), 2) AS precision_pct, round(100.0 * (tp + tn) / nullif(tp + fp + fn + tn, 0), 2) AS agreement_pct FROM c""")
def gold_agreement(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "analysis_reference")
    found = dialect.contrasts(r, "id", "email", lexicon(spark, d)).where("score_eligible").select("id").distinct().withColumn("hit", F.lit(True))
    both = r.select("id", F.col("reference_judgments.gold_ptbr_leakage").alias("gold")).join(found, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return comparison.agreement(both, "gold", "hit")


@query(f"""WITH {_LEX}, w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {q(T.LANGUAGE_WORD)}))) AS w FROM documents), p AS (SELECT form FROM lex WHERE variant = 'pt-pt')
SELECT doc_id, round(avg((w IN (SELECT form FROM p))::INT), 6) AS hit_share, avg((w IN (SELECT form FROM p))::INT) < 0.35 AND count(*) > 1 AS english FROM w GROUP BY doc_id""")
def english_gate(spark: SparkSession, d: str) -> DataFrame:
    return dialect.english_share(_t(spark, d, "documents"), "doc_id", "text", lexicon(spark, d)).select("doc_id", F.round("hit_share", 6).alias("hit_share"), "english")


@query()
def unknown_words(spark: SparkSession, d: str) -> DataFrame:
    return dialect.unknown_words(_t(spark, d, "wq_human_reference"), "id", "email", lexicon(spark, d), "pt-pt", "pt-br")


_ELIGIBLE = "list_filter(coalesce(dialect_evaluation.violations, []), lambda v: coalesce(v.score_eligible, false) AND starts_with(upper(v.rule_id), 'PTBR_'))"
_TIER = "CASE WHEN contains(upper(v.rule_id), 'GERUND') THEN 1 WHEN contains(upper(v.rule_id), 'PROCLISIS') OR contains(upper(v.rule_id), 'CLITIC') OR contains(upper(v.rule_id), 'TER_HAVER') THEN 2 WHEN lower(coalesce(v.severity, 'medium')) = 'high' OR contains(upper(v.rule_id), 'VOCAB') OR contains(upper(v.rule_id), 'LEAK') OR contains(upper(v.rule_id), 'REPLACEMENT') THEN 4 ELSE 3 END"


@query(f"""WITH a AS (SELECT row_seq, list_transform({_ELIGIBLE}, lambda v: {_TIER}) AS t, len(regexp_extract_all(content, {q(T.WF_WORD)})) AS words FROM generation_results WHERE content IS NOT NULL),
b AS (SELECT *, coalesce(list_sum(list_transform(t, lambda x: CASE x WHEN 1 THEN 1.0 WHEN 2 THEN 1.75 WHEN 3 THEN 2.5 ELSE 3.0 END)), 0.0)::DOUBLE AS weighted_leaks FROM a)
SELECT row_seq, weighted_leaks, {', '.join(f'len(list_filter(t, lambda x: x = {k})) AS tier_{k}' for k in range(1, 5))}, round(greatest(0.0, least(100.0, 100 - 100 * weighted_leaks / greatest(words, 1))), 1) AS wf_score FROM b""")
def word_fidelity(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "generation_results").where("content IS NOT NULL")
    return r.select("row_seq", dialect.fidelity(F.col("dialect_evaluation.violations"), F.size(T.matches("content", T.WF_WORD))).alias("f")).select("row_seq", "f.*")


@query(f"""WITH a AS (SELECT row_seq, {_ELIGIBLE} AS k, len(regexp_extract_all(content, {q(T.WF_WORD)})) AS words FROM generation_results WHERE content IS NOT NULL AND dialect_evaluation.violations IS NOT NULL)
SELECT row_seq, CASE WHEN len(k) > 0 THEN 0.0 ELSE 100.0 END AS ptpt_compliance_pct,
round(greatest(0.0, least(100.0, 100 - 100 * coalesce(list_sum(list_transform(k, lambda v: CASE lower(coalesce(v.severity, 'medium')) WHEN 'low' THEN 0.75 WHEN 'medium' THEN 1.5 WHEN 'high' THEN 3.0 ELSE 1.5 END)), 0.0)::DOUBLE / greatest(words, 1))), 1) AS ptpt_compliance_graded_pct FROM a""")
def graded_compliance(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "generation_results").where("content IS NOT NULL AND dialect_evaluation.violations IS NOT NULL")
    return r.select("row_seq", dialect.graded(F.col("dialect_evaluation.violations"), F.size(T.matches("content", T.WF_WORD))).alias("f")).select("row_seq", "f.*")


_FOLD = "list_reduce({0}, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: contains(a, x[1]))) > 0 THEN acc ELSE list_concat(acc, x) END)"


@query(f"""SELECT row_seq, CASE WHEN len(c) = 0 THEN 0 ELSE len({_FOLD.format('c')}) END AS n_accepted FROM
(SELECT row_seq, list_transform(dialect_evaluation.violations, lambda v: [lower(v.context)]) AS c FROM generation_results WHERE dialect_evaluation.violations IS NOT NULL)""")
def accepted_violations(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "generation_results").where("dialect_evaluation.violations IS NOT NULL")
    return r.select("row_seq", F.size(dialect.deduplicated(F.col("dialect_evaluation.violations"))).alias("n_accepted"))


@query(f"""WITH {_LEX}, w AS (SELECT id, lower(unnest(regexp_extract_all(m, {q(T.LANGUAGE_WORD)}))) AS w FROM (SELECT id, unnest(reference_judgments.ptbr_leakage_markers) AS m FROM analysis_reference)),
v AS (SELECT id, w IN (SELECT form FROM lex WHERE variant = 'pt-br') AND w NOT IN (SELECT form FROM lex WHERE variant = 'pt-pt') AS visible FROM w)
SELECT id, bool_and(visible) AS all_visible, bool_or(visible) AS any_visible FROM v GROUP BY id""")
def marker_visibility(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "analysis_reference").select("id", F.col("reference_judgments.ptbr_leakage_markers").alias("markers"))
    return dialect.marker_visibility(r, "id", "markers", lexicon(spark, d))


_GROUND = f"""ctr AS ({{contrasts}}),
pos AS (SELECT c.k, c.word, c.score_eligible, instr(lower(r.t), c.word) AS place FROM ctr c JOIN src r ON c.k = r.k),
lst AS (SELECT k, list(word ORDER BY place, word) AS words, list(score_eligible ORDER BY place, word) AS flags FROM pos GROUP BY k),
acc AS (SELECT k, words, flags, {_FOLD.format('list_transform(words, lambda w: [w])')} AS kept FROM lst),
cnt AS (SELECT k, len(kept) AS n_kept, len(list_filter(kept, lambda w: flags[list_position(words, w)])) AS n FROM acc),
wds AS (SELECT k, lower(unnest(regexp_extract_all(t, {q(T.LANGUAGE_WORD)}))) AS w FROM src WHERE regexp_replace(coalesce(t, ''), '\\s+', '', 'g') <> ''),
gate AS (SELECT k, count(*) AS n, avg((w IN (SELECT form FROM lex WHERE variant = 'pt-pt'))::INT) AS share FROM wds GROUP BY k),
out AS (SELECT s.k, s.t, CASE WHEN regexp_replace(coalesce(t, ''), '\\s+', '', 'g') = '' THEN 'empty' WHEN gate.n = 1 AND share = 0 THEN 'insufficient text' WHEN share < 0.35 AND gate.n > 1 THEN 'english' ELSE 'ok' END AS status, coalesce(cnt.n, 0) AS n, coalesce(n_kept, 0) AS n_kept
 FROM src s LEFT JOIN gate ON s.k = gate.k LEFT JOIN cnt ON s.k = cnt.k)"""


def _dialect_ctes(name: str, key: str, text: str) -> str:
    contrasts = _contrast_sql("k", "t", "src")
    return f"{_LEX}, src AS (SELECT {key} AS k, {text} AS t FROM {name}), " + _GROUND.replace("{contrasts}", contrasts)


@query(f"""WITH {_dialect_ctes('generation_results', 'row_seq', 'content')}
SELECT k AS row_seq, status, CASE status WHEN 'ok' THEN CASE WHEN n > 0 THEN 0.0 ELSE 100.0 END WHEN 'english' THEN 0.0 END AS ptpt_compliance_pct,
CASE status WHEN 'ok' THEN round(greatest(0.0, least(100.0, 100 - 100 * 1.5 * n / greatest(len(regexp_extract_all(t, {q(T.WF_WORD)})), 1))), 1) WHEN 'english' THEN 0.0 END AS ptpt_compliance_graded_pct,
CASE status WHEN 'ok' THEN n > 0 WHEN 'english' THEN false END AS ptbr_leakage_detected, CASE WHEN status = 'ok' THEN n ELSE 0 END AS ptbr_violation_count, CASE WHEN status = 'ok' THEN n_kept ELSE 0 END AS ptbr_candidate_count FROM out""")
def dialect_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """The composed dialect evaluation of every answer, against lexicons alone."""
    out = dialect.evaluate(_texts(spark, d, "generation_results", "row_seq", "content"), "row_seq", "content", lexicon(spark, d))
    return out.select("row_seq", "status", "ptpt_compliance_pct", "ptpt_compliance_graded_pct", "ptbr_leakage_detected", F.col("ptbr_violation_count").cast("bigint").alias("ptbr_violation_count"), F.col("ptbr_candidate_count").cast("bigint").alias("ptbr_candidate_count"))


@query(f"""WITH {_dialect_ctes('analysis_reference', 'id', 'email')}, mw AS (SELECT id, lower(unnest(regexp_extract_all(m, {q(T.LANGUAGE_WORD)}))) AS w FROM (SELECT id, unnest(reference_judgments.ptbr_leakage_markers) AS m FROM analysis_reference)),
inv AS (SELECT id, bool_and(w IN (SELECT form FROM lex WHERE variant = 'pt-br') AND w IN (SELECT form FROM lex WHERE variant = 'pt-pt')) AS invisible FROM mw GROUP BY id),
j AS (SELECT coalesce(reference_judgments.gold_ptbr_leakage, false) AS g, coalesce(status = 'ok' AND n > 0, false) AS d, status = 'ok' AND n_kept > 0 AS fired, coalesce(invisible, false) AS unseen FROM analysis_reference r JOIN out ON r.id = out.k LEFT JOIN inv ON r.id = inv.id),
c AS (SELECT count(*) AS rows, count_if(g AND d) AS tp, count_if(g AND NOT d) AS fn, count_if(NOT g AND d) AS fp, count_if(NOT g AND NOT d) AS tn, count_if(NOT g AND fired) AS nonleaking_fired, count_if(NOT g AND fired AND NOT d) AS suppressed, count_if(g AND NOT d AND unseen) AS wholly_invisible_misses, count_if(NOT g AND unseen) AS nonleaking_with_invisible_markers FROM j)
SELECT *, round(100.0 * tp / nullif(tp + fn, 0), 2) AS recall_pct, round(100.0 * tp / nullif(tp + fp, 0), 2) AS precision_pct, round(100.0 * (tp + tn) / nullif(rows, 0), 2) AS agreement_pct, round(100.0 * tp / nullif(tp + nonleaking_fired, 0), 2) AS precision_without_suppression_pct FROM c""")
def gold_report(spark: SparkSession, d: str) -> DataFrame:
    """The dialect evaluation against gold labels, with what suppression hides and what lexicons cannot see."""
    r, lex = _t(spark, d, "analysis_reference"), lexicon(spark, d)
    found = dialect.evaluate(r.select("id", "email"), "id", "email", lex).select("id", F.col("ptbr_leakage_detected").alias("detected"), (F.col("ptbr_candidate_count") > 0).alias("fired"))
    seen = dialect.invisible_markers(r.select("id", F.col("reference_judgments.ptbr_leakage_markers").alias("markers")), "id", "markers", lex)
    rows = r.select("id", F.col("reference_judgments.gold_ptbr_leakage").alias("gold"), F.lit(None).cast("double").alias("classified")).join(found, "id", "left").join(seen, "id", "left")
    return comparison.gold_report(rows).drop("classifier_tp", "classifier_fn", "classifier_fp", "classifier_tn", "classifier_recall_pct", "classifier_precision_pct")


_MATCHES = """(SELECT row_seq, unnest(dialect_evaluation.violations) AS v FROM generation_results WHERE dialect_evaluation.violations IS NOT NULL)"""
_REGIONAL = "(upper(v.source) = 'REGIONALISMS' OR starts_with(upper(v.rule_id), 'PT_BR') OR starts_with(upper(v.rule_id), 'PT_BRASIL'))"


@query(f"""SELECT row_seq, v.rule_id AS rule_id, CASE WHEN v.severity = 'high' THEN 'grammar' WHEN v.severity = 'medium' THEN 'spelling' ELSE 'style' END AS dimension, CASE WHEN v.severity IN ('high', 'medium') THEN 'high' ELSE 'medium' END AS severity, count(*) AS n
FROM {_MATCHES} WHERE NOT coalesce({_REGIONAL}, false) GROUP BY ALL""")
def tool_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Stored findings read as matches of a grammar tool, dialect ones apart, by dimension."""
    r = _t(spark, d, "generation_results").select("row_seq", F.explode("dialect_evaluation.violations").alias("v"))
    kind = F.when(F.col("v.severity") == "high", "grammar").when(F.col("v.severity") == "medium", "misspelling").otherwise("style")
    matches = r.select("row_seq", F.col("v.rule_id").alias("rule_id"), F.col("v.source").alias("category_id"), kind.alias("issue_type"))
    return dialect.tool_findings(matches, False).groupBy("row_seq", "rule_id", "dimension", "severity").agg(F.count(F.lit(1)).alias("n"))


# ---- criteria

#: Criteria of this library's own, by the first word of a prompt, as a document.
OWN = {
    "Informe": {"required_facts": [{"fact_id": "status", "pattern": "reparação|pronto|concluíd[ao]"}], "required_actions": [{"action_id": "inform", "pattern": "informamos|confirmamos"}], "forbidden_changes": [{"forbidden_id": "refund", "pattern": "reembolso"}]},
    "Agradeça": {"required_actions": [{"action_id": "thank", "pattern": "agradece(?:mos)?|obrigad[ao]"}], "required_facts": [{"fact_id": "decision", "pattern": "decisão|decidiu"}]},
    "Peça": {"required_actions": [{"action_id": "ask", "pattern": "pedimos|solicitamos|indique"}]},
    "Apresente": {"required_facts": [{"fact_id": "offer", "pattern": "orçamento|proposta"}], "forbidden_changes": [{"forbidden_id": "free", "pattern": "sem custo|qualquer custo"}]},
    "Responda": {"required_actions": [{"action_id": "apologise", "pattern": "desculp|lamentamos"}], "forbidden_facts": [{"fact_id": "old", "pattern": "segunda-feira"}]},
}
#: What a prompt names and its answer must keep.
CODE = r"[A-Z]{3}[-/ ]?[0-9]{4,7}"


def _document(spark: SparkSession) -> DataFrame:
    """The criteria, written as a document and read back."""
    path = scratch_path(spark, "criteria")
    spark.createDataFrame([(json.dumps(OWN, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return criteria.read_criteria(spark, path)


def _criteria(spark: SparkSession, d: str) -> DataFrame:
    """Criteria of every prompt: those of its first word, and its codes as facts to keep. They grow with the prompts."""
    asked = _t(spark, d, "elaboration_prompts_pt_pt").select("id", "prompt", F.split("prompt", " ")[0].alias("word"))
    own = _document(spark).withColumnRenamed("task_id", "word").join(asked.select("id", "word"), "word").select(F.col("id").alias("task_id"), "grp", "criterion_id", "pattern", "ord")
    codes = asked.select(F.col("id").alias("task_id"), F.posexplode(F.array_distinct(F.regexp_extract_all("prompt", F.lit(CODE), F.lit(0)))).alias("ord", "code"))
    facts = codes.select("task_id", F.lit("required_facts").alias("grp"), "code", F.regexp_replace("code", "[^A-Za-z0-9]", ".").alias("pattern"), "ord")
    return own.unionByName(facts.withColumnRenamed("code", "criterion_id"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "generation_results").select("row_seq", read_id("id").alias("id"), "content").join(_t(spark, d, "elaboration_prompts_pt_pt").select("id", "prompt"), "id")


_OWN_ROWS = [(t, g, next(i[k] for k in ("fact_id", "action_id", "forbidden_id") if k in i), i["pattern"]) for t, spec in OWN.items() for g, items in spec.items() for i in items]
_OWN_SQL = "(VALUES " + ", ".join(f"({', '.join(map(q, x))})" for x in _OWN_ROWS) + ") o(word, grp, criterion_id, pattern)"
_CRITERIA = f"""crit AS (SELECT p.id AS task_id, o.grp, o.criterion_id, o.pattern FROM elaboration_prompts_pt_pt p JOIN {_OWN_SQL} ON string_split(p.prompt, ' ')[1] = o.word
 UNION ALL SELECT id, 'required_facts', code, regexp_replace(code, '[^A-Za-z0-9]', '.', 'g') FROM (SELECT id, unnest(list_distinct(regexp_extract_all(prompt, {q(CODE)}))) AS code FROM elaboration_prompts_pt_pt)),
t AS (SELECT g.row_seq, coalesce(g.content, '') AS x, g.content, p.prompt, p.id AS task_id FROM (SELECT row_seq, {ID} AS id, content FROM generation_results) g JOIN elaboration_prompts_pt_pt p ON g.id = p.id)"""


def _negated_sql(p: str) -> str:
    has = lambda x: f"regexp_matches({p}, {q(x)}, 'i')"
    return (
        f"CASE WHEN {p} = '' THEN false WHEN {' OR '.join(map(has, criteria.NOT_DENIED))} THEN false WHEN {has(criteria.DIRECTIVES)} THEN true WHEN {has(criteria.NOT_ONLY)} THEN false "
        f"WHEN {has(criteria.DENIED)} THEN NOT ({has(criteria.CANNOT_BUT[0])} AND {has(criteria.CANNOT_BUT[1])}) WHEN {has(criteria.PREDICATE)} THEN true ELSE {has(criteria.ENDS_DENIED)} END"
    )


def _affirmed_sql(x: str, pattern: str) -> str:
    cut = f"string_split(regexp_replace({x}, '(?:' || {pattern} || ')', chr(1) || '\\0', 'gi'), chr(1))"
    clause = f"lower(trim(regexp_replace(regexp_extract(array_to_string({cut}[1:i], ''), '[^.!?;,:]*$'), '\\s+', ' ', 'g'), ' '))"
    return f"len(list_filter(range(1, len({cut})), lambda i: NOT ({_negated_sql(clause)}))) > 0"


#: A slot and, where it is a link's text, the bracket after it.
_SLOT_OPEN = criteria.SLOT + r"\(?"
_MET = f"{_CRITERIA}, met AS (SELECT row_seq, c.task_id, c.grp, c.criterion_id, {_affirmed_sql('x', 'pattern')} AS met FROM t JOIN crit c ON t.task_id = c.task_id WHERE c.grp <> 'forbidden_facts')"


@query(f"WITH {_MET} SELECT row_seq, task_id, grp, criterion_id, met FROM met")
def criteria_met(spark: SparkSession, d: str) -> DataFrame:
    return criteria.evaluated(_answers(spark, d), _criteria(spark, d), "row_seq", "id", "content")


@query(f"""WITH {_MET}, n AS (SELECT row_seq, count_if(grp = 'required_actions') AS actions, count_if(grp = 'required_actions' AND met) AS done, count_if(grp <> 'required_actions') AS facts,
 count_if((grp = 'required_facts' AND met) OR (grp = 'forbidden_changes' AND NOT met)) AS kept FROM met GROUP BY row_seq),
s AS (SELECT row_seq, x, prompt, list_filter(regexp_extract_all(x, {q(_SLOT_OPEN)}), lambda z: NOT ends_with(z, '(')) || list_filter(regexp_extract_all(coalesce(prompt, ''), {q(criteria.SOURCE_SLOT)}), lambda z: contains(x, z)) AS slots,
 coalesce(regexp_matches(prompt, {q(criteria.SOURCE_SLOT)}), false) AS offered FROM t),
u AS (SELECT s.row_seq, x, coalesce(done, 0) + (len(slots) = 0 AND offered)::INT AS done, coalesce(actions, 0) + (len(slots) > 0 OR offered)::INT AS actions, coalesce(kept, 0) AS kept, coalesce(facts, 0) AS facts FROM s LEFT JOIN n ON s.row_seq = n.row_seq)
SELECT row_seq, CASE WHEN regexp_replace(x, '\\s+', '', 'g') = '' THEN 0.0 WHEN actions > 0 THEN round(100.0 * done / actions, 1) END AS instruction_adherence_pct,
CASE WHEN regexp_replace(x, '\\s+', '', 'g') = '' THEN 0.0 WHEN facts > 0 THEN round(100.0 * kept / facts, 1) END AS semantic_preservation_pct FROM u""")
def adherence_scores(spark: SparkSession, d: str) -> DataFrame:
    return criteria.adherence(_answers(spark, d), _criteria(spark, d), "row_seq", "id", "content", "prompt")


_SLOTS = f"list_distinct(list_filter(regexp_extract_all(content, {q(criteria.SLOT + '\\(?')}), lambda s: NOT ends_with(s, '(')))"


@query(f"SELECT row_seq, array_to_string(list_sort({_SLOTS}), '|') AS slots FROM generation_results WHERE len({_SLOTS}) > 0")
def placeholder_slots(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "generation_results").where("content IS NOT NULL").select("row_seq", criteria.placeholders(F.col("content")).alias("s"))
    return r.where(F.size("s") > 0).select("row_seq", F.array_join(F.array_sort("s"), "|").alias("slots"))


@query(f"WITH {_CRITERIA} SELECT DISTINCT task_id, word FROM (SELECT task_id, lower(trim(unnest(regexp_extract_all(pattern, {q(T.CONTRAST_WORD)})), '-''’')) AS word FROM crit) WHERE length(word) >= 3")
def echo_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return criteria.echo_vocabulary(_criteria(spark, d))


@query(f"WITH {_CRITERIA} SELECT count(DISTINCT task_id) AS task_count, bool_or(grp IN ('forbidden_changes', 'forbidden_facts')) AS has_forbidden FROM crit")
def constraint_profile(spark: SparkSession, d: str) -> DataFrame:
    return criteria.constraint_profile(_criteria(spark, d))


@query(f"""WITH {_CRITERIA} SELECT task_id, criterion_id, bare AS bare_alternative FROM (SELECT task_id, criterion_id,
 list_filter(list_transform(string_split(regexp_replace(pattern, '\\([?!<]', '(', 'g'), '|'), lambda b: trim(b, ' ')), lambda b: regexp_matches(b, '^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ .\\-]{{0,11}}$'))[1] AS bare
 FROM crit WHERE grp IN ('required_actions', 'required_facts')) WHERE bare IS NOT NULL""")
def broad_criteria(spark: SparkSession, d: str) -> DataFrame:
    return criteria.broad_criteria(_criteria(spark, d))


CONTROL = "Exmos. Senhores, acusamos a receção da vossa mensagem. Com os melhores cumprimentos."


@query(f"WITH {_CRITERIA} SELECT task_id, grp, criterion_id FROM crit WHERE grp IN ('required_actions', 'required_facts') AND {_affirmed_sql(q(CONTROL), 'pattern')}")
def floor_violations(spark: SparkSession, d: str) -> DataFrame:
    """Criteria that a reply without content meets; none do."""
    return criteria.floor_violations(_criteria(spark, d), CONTROL)


@query(f"SELECT row_seq, model, {ID} AS id, row_number() OVER (PARTITION BY model, {ID} ORDER BY row_seq) AS n FROM generation_results")
def numbered_answers(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "generation_results").select("row_seq", "model", read_id("id").alias("id"))
    return rows.numbered(r, ["model", "id"], "row_seq").withColumn("n", F.col("n").cast("bigint"))


@query("SELECT model, sum(coalesce(try_cast(json_extract_string(raw_response, '$.usage.total_tokens') AS DOUBLE), 0.0)) AS total_tokens FROM generation_results GROUP BY model")
def safe_totals(spark: SparkSession, d: str) -> DataFrame:
    used = rows.safe_number(F.get_json_object("raw_response", "$.usage.total_tokens"))
    return _t(spark, d, "generation_results").groupBy("model").agg(F.sum(used).alias("total_tokens"))


@query(f"SELECT row_seq, coalesce(a < prev_b AND b > prev_a, false) AS overlaps FROM (SELECT row_seq, started_at AS a, finished_at AS b, lag(started_at) OVER w AS prev_a, lag(finished_at) OVER w AS prev_b FROM generation_results WHERE {VALID.format('started_at')} AND {VALID.format('finished_at')} WINDOW w AS (PARTITION BY model, {ID} ORDER BY row_seq))")
def overlapping_answers(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer was under way while the one before it to the same prompt was."""
    from veridraft.operators.log_percentiles import valid_measure

    r = _t(spark, d, "generation_results").where(valid_measure("started_at") & valid_measure("finished_at")).select("row_seq", "model", read_id("id").alias("id"), F.struct(F.col("started_at").alias("start"), F.col("finished_at").alias("end")).alias("a"))
    r = r.withColumn("b", F.lag("a").over(Window.partitionBy("model", "id").orderBy("row_seq")))
    return r.select("row_seq", F.coalesce(dialect.overlaps("a", "b"), F.lit(False)).alias("overlaps"))


@query(f"WITH {_MET} SELECT g.row_seq, CASE WHEN t.row_seq IS NULL THEN g.instruction_adherence_pct WHEN regexp_replace(x, '\\s+', '', 'g') = '' THEN 0.0 WHEN actions > 0 THEN round(100.0 * done / actions, 1) END AS instruction_adherence_pct FROM generation_results g LEFT JOIN t ON g.row_seq = t.row_seq LEFT JOIN (SELECT row_seq, count_if(grp = 'required_actions') AS actions, count_if(grp = 'required_actions' AND met) AS done FROM met GROUP BY row_seq) n ON g.row_seq = n.row_seq WHERE NOT coalesce(regexp_matches(x, '\\['), false) AND NOT coalesce(regexp_matches(prompt, '\\['), false)")
def refreshed_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Adherence computed anew over the rows without brackets; rows of unknown prompts keep theirs."""
    r = _t(spark, d, "generation_results").select("row_seq", read_id("id").alias("id"), "content", "instruction_adherence_pct", "semantic_preservation_pct")
    joined = r.join(_t(spark, d, "elaboration_prompts_pt_pt").select("id", "prompt"), "id", "left")
    out = rescoring.refreshed(joined, _criteria(spark, d), "id", "prompt")
    return out.where(~F.coalesce(F.contains("content", F.lit("[")), F.lit(False)) & ~F.coalesce(F.contains("prompt", F.lit("[")), F.lit(False))).select("row_seq", "instruction_adherence_pct")


# ---- sources

@query("SELECT row_seq, sha256(content) AS digest FROM generation_results WHERE content IS NOT NULL")
def content_digests(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "generation_results").where("content IS NOT NULL").select("row_seq", F.sha2("content", 256).alias("digest"))


@query("SELECT id, lang, task_type, intended_quality_band, email FROM wq_human_reference")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON lines and read back."""
    path = scratch_path(spark, "jsonl")
    r = _t(spark, d, "wq_human_reference").select("id", "lang", "task_type", "intended_quality_band", "email")
    jsonl.write_jsonl(r, path)
    return jsonl.read_jsonl(spark, path, r.schema)


@query("SELECT row_seq, CASE WHEN length(e) > 300 THEN substring(e, 1, 297) || '...' ELSE e END AS summary FROM (SELECT row_seq, trim(regexp_replace(coalesce(raw_response, ''), '\\s+', ' ', 'g'), ' ') AS e FROM generation_results WHERE status = 'error')")
def error_summaries(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "generation_results").where("status = 'error'").select("row_seq", T.error_summary("raw_response").alias("summary"))


@query("SELECT id, CASE WHEN starts_with(lower(trim(lang)), 'pt') THEN 'pt-PT' ELSE 'en-US' END AS tool_language FROM elaboration_prompts_pt_pt")
def tool_languages(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "elaboration_prompts_pt_pt").select("id", F.when(F.lower(F.trim("lang")).startswith("pt"), "pt-PT").otherwise("en-US").alias("tool_language"))


# ---- rescoring

@query(f"""WITH {_findings_ctes('generation_results', 'row_seq', 'content')}, el AS (SELECT row_seq, {_ELIGIBLE} AS kept, dialect_evaluation.violations IS NOT NULL AS judged, len(regexp_extract_all(content, {q(T.WF_WORD)})) AS words FROM generation_results),
x AS (SELECT g.*, el.kept, judged, words, w.k IS NOT NULL AND {OK} AS fresh, CASE WHEN w.k IS NOT NULL THEN round(greatest(0.0, 100 - ({_TAKEN})), 1) END AS d,
 coalesce(list_sum(list_transform(el.kept, lambda v: CASE {_TIER} WHEN 1 THEN 1.0 WHEN 2 THEN 1.75 WHEN 3 THEN 2.5 ELSE 3.0 END)), 0.0)::DOUBLE AS leaks,
 coalesce(list_sum(list_transform(el.kept, lambda v: CASE lower(coalesce(v.severity, 'medium')) WHEN 'low' THEN 0.75 WHEN 'medium' THEN 1.5 WHEN 'high' THEN 3.0 ELSE 1.5 END)), 0.0)::DOUBLE AS weight
 FROM generation_results g LEFT JOIN w ON g.row_seq = w.k JOIN el ON g.row_seq = el.row_seq)
SELECT row_seq, CASE WHEN fresh THEN d ELSE wq_defect_only_score END AS wq_defect_only_score, CASE WHEN fresh AND judged AND {PT} THEN round(greatest(0.0, least(100.0, 100 - 100 * leaks / greatest(words, 1))), 1) ELSE wf_score END AS wf_score,
CASE WHEN fresh AND judged AND {PT} THEN CASE WHEN len(kept) > 0 THEN 0.0 ELSE 100.0 END ELSE ptpt_compliance_pct END AS ptpt_compliance_pct, CASE WHEN fresh AND judged AND {PT} THEN round(greatest(0.0, least(100.0, 100 - 100 * weight / greatest(words, 1))), 1) ELSE ptpt_compliance_graded_pct END AS ptpt_compliance_graded_pct FROM x""")
def rescored_rows(spark: SparkSession, d: str) -> DataFrame:
    return rescoring.rescored(_t(spark, d, "generation_results")).select("row_seq", "wq_defect_only_score", "wf_score", "ptpt_compliance_pct", "ptpt_compliance_graded_pct")


_BROKEN = "(json_extract_string(raw_response, '$.error') IS NOT NULL OR coalesce(json_extract_string(raw_response, '$.choices[0].finish_reason') <> 'stop', false))"


@query(f"SELECT row_seq, CASE WHEN {_BROKEN} THEN 'error' ELSE status END AS status FROM generation_results")
def enriched_status(spark: SparkSession, d: str) -> DataFrame:
    return rescoring.enriched(_t(spark, d, "generation_results")).select("row_seq", "status")


@query()
def repaired_json(spark: SparkSession, d: str) -> DataFrame:
    return rescoring.repaired(_t(spark, d, "analysis_results").where("status = 'success'"), "row_seq", "content")


@query("SELECT row_seq, content IS NOT NULL AND len(regexp_extract_all(content, '(?m)^\\s*[*_~`]{0,3}[A-Za-z][A-Za-z0-9-]{1,50}[ \\t]*:')) > 0 AS has_header FROM generation_results")
def header_lines(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_count("content", F.lit(r"(?m)^\s*[*_~`]{0,3}[A-Za-z][A-Za-z0-9-]{1,50}[ \t]*:")) > 0
    return _t(spark, d, "generation_results").select("row_seq", F.coalesce(found, F.lit(False)).alias("has_header"))


@query("SELECT reference_judgments.gold_dialect AS gold, lower(trim(replace(lang, '_', '-'))) AS said, count(*) AS n FROM wq_human_reference GROUP BY ALL")
def gold_confusion(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "wq_human_reference").select(F.col("reference_judgments.gold_dialect").alias("gold"), F.lower(F.trim(F.replace("lang", F.lit("_"), F.lit("-")))).alias("said"))
    return r.groupBy("gold", "said").agg(F.count(F.lit(1)).alias("n"))
