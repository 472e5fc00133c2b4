"""Queries of the operators for texts of language models, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridraft.llm import abuse, language_id, mixing, packing, pairs, repetition, residue, tokens, truncation
from veridraft.operators.exactly_once import read_id
from veridraft.operators.results import both_results
from veridraft.session import table


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_results(spark, sf_dir, "row_seq", "model", "status", "content").where("status = 'success'")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(_answers(spark, sf_dir), "content", ["tab", "row_seq"])


def p1_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model, how many of its success rows stopped early."""
    cut = truncation.truncated(_answers(spark, sf_dir), "content", ["tab", "row_seq", "model"]).groupBy("model").agg(F.count(F.lit(1)).alias("n_truncated"))
    rows = _answers(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n_success"))
    out = rows.join(cut, "model", "left").withColumn("n_truncated", F.coalesce("n_truncated", F.lit(0)))
    return out.withColumn("truncated_share", F.round(F.col("n_truncated") / F.col("n_success"), 6))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "generation_results")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(_generated(spark, sf_dir), "content", ["row_seq"]).select("row_seq")


def p4_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows marked, by kind of residue, with the share of characters it covers."""
    return residue.residue(_generated(spark, sf_dir), "content", ["row_seq"])


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that remain once residue is excluded."""
    rows = _generated(spark, sf_dir)
    return rows.select("row_seq").join(residue.residue(rows, "content", ["row_seq"]).select("row_seq"), "row_seq", "left_anti")


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _generated(spark, sf_dir).select(F.lit("generation_results").alias("tab"), F.col("row_seq").cast("string").alias("rec"), F.col("content").alias("text"))
    people = table(spark, sf_dir, "wq_human_reference").select(F.lit("wq_human_reference").alias("tab"), F.col("id").alias("rec"), F.col("email").alias("text"))
    return answers.unionAll(people)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = repetition.repetition(_mail(spark, sf_dir), "text", ["tab", "rec"])
    return shares.where(F.col("repeated_5") >= repetition.LIMIT).select("tab", "rec")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every text."""
    return repetition.repetition(_mail(spark, sf_dir), "text", ["tab", "rec"])


def p5_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated words of every text."""
    return repetition.repetition(_mail(spark, sf_dir), "text", ["tab", "rec"]).select("tab", "rec", (F.col("repeated_5") >= repetition.LIMIT).alias("repetitive"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "wq_human_reference")
    return rows.select("id", "email", F.col("lang").alias("said"), F.col("reference_judgments.gold_dialect").alias("gold"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir)
    found = language_id.passages(rows, "email", ["id"], language_id.fit_on(rows, "email", "said"), carry=["said", "gold"])
    own = found.withColumn("langs", F.array_distinct(F.transform("passages", lambda p: p["lang"])))
    said, gold = (F.udf(language_id.label, "string", useArrow=True)(c) for c in ("said", "gold"))
    named = own.select("id", "langs", said.alias("said"), gold.alias("gold"))
    wrong = (F.size("langs") > 1) | F.col("said").isNull() | (F.col("said") != F.col("langs")[0]) | F.coalesce(F.col("gold") != F.col("langs")[0], F.lit(False))
    return named.where((F.size("langs") > 0) & wrong).select("id", F.explode("langs").alias("lang"))


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage in one language, with its confidence."""
    rows = _people(spark, sf_dir)
    found = language_id.passages(rows, "email", ["id"], language_id.fit_on(rows, "email", "said"))
    return found.select("id", F.explode("passages").alias("p")).select("id", "p.*")


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of every email, with confidence and share."""
    rows = _people(spark, sf_dir)
    return language_id.languages(language_id.passages(rows, "email", ["id"], language_id.fit_on(rows, "email", "said")), ["id"])


def _successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _generated(spark, sf_dir).where("status = 'success'")
    return rows.select("row_seq", read_id("id").alias("id"), "content", F.get_json_object("raw_response", "$.choices[0].message.refusal").alias("refusal"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken_pairs(_successes(spark, sf_dir), table(spark, sf_dir, "elaboration_prompts_pt_pt"), "row_seq", "id", "content", "refusal")


def p7_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is measured of every pair."""
    return pairs.evidence(_successes(spark, sf_dir), table(spark, sf_dir, "elaboration_prompts_pt_pt"), "row_seq", "id", "content", "refusal")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.sizes(table(spark, sf_dir, "documents"), "text", ["doc_id", "source"])


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies in containers of each size."""
    return packing.placed(_sizes(spark, sf_dir), "doc_id", "n_tokens", table(spark, sf_dir, "container_sizes"), "container_kind", "capacity_tokens")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each size are."""
    used = packing.containers_of(p8_placed(spark, sf_dir))
    out = used.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"), F.count(F.lit(1)).alias("n_containers"), F.sum("used_tokens").alias("used_tokens"), F.sum("unused_tokens").alias("unused_tokens"))
    return out.withColumn("fill", F.round(F.col("used_tokens") / (F.col("used_tokens") + F.col("unused_tokens")), 6))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every placing: all documents placed, no container over its capacity, no document split that fits, and
    every token of each document in one part."""
    parts, sizes = p8_placed(spark, sf_dir), _sizes(spark, sf_dir)
    over = packing.containers_of(parts).groupBy("container_kind").agg(F.count_if(F.col("unused_tokens") < 0).alias("n_over"))
    docs = parts.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("n_parts"), F.max(F.col("first_token") + F.col("n_tokens")).alias("upto"), F.max("capacity_tokens").alias("capacity"))
    both = docs.join(sizes.select("doc_id", "n_tokens"), "doc_id")
    split = (F.col("n_parts") > 1) & (F.col("n_tokens") <= F.col("capacity"))
    lost = (F.col("placed") != F.col("n_tokens")) | (F.col("upto") != F.col("n_tokens"))
    held = both.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(split).alias("n_split"), F.count_if(lost).alias("n_lost"))
    return held.join(over, "container_kind")


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every mix: no document over its source's cap, every share within a thousandth of its target."""
    out = p9_shares(spark, sf_dir)
    return out.select("mix_id", "source", "target_share", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("actual_share") - F.col("target_share")) < 0.001).alias("near_target"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p9_selection(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _scored(spark: SparkSession, sf_dir: str, *carry: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = abuse.fit_on(docs, table(spark, sf_dir, "abuse_labels"), "doc_id", "text", "label")
    return abuse.scored(docs, "text", ["doc_id", *carry], model)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("score") >= abuse.LIMIT).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of offensive documents for each source."""
    bad = (F.col("score") >= abuse.LIMIT).cast("long")
    out = _scored(spark, sf_dir, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(bad).alias("n_offensive"))
    return out.withColumn("offensive_rate", F.round(F.col("n_offensive") / F.col("n_docs"), 6))


QUERIES = {
    "p1_found": p1_found, "p1_models": p1_models, "p4_found": p4_found, "p4_kinds": p4_kinds, "p4_kept": p4_kept, "p5_found": p5_found, "p5_shares": p5_shares, "p5_words": p5_words, "p7_found": p7_found, "p7_evidence": p7_evidence,
    "p6_found": p6_found, "p6_passages": p6_passages, "p6_documents": p6_documents, "p8_placed": p8_placed, "p8_fill": p8_fill, "p8_limits": p8_limits, "p9_limits": p9_limits, "p9_selection": p9_selection, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores, "p10_sources": p10_sources,
}

_ENTITIES = (("&nbsp;", " "), ("&ccedil;", "ç"), ("&atilde;", "ã"), ("&otilde;", "õ"), ("&aacute;", "á"), ("&eacute;", "é"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"), ("&ecirc;", "ê"), ("&acirc;", "â"), ("&ocirc;", "ô"), ("&agrave;", "à"), ("&euro;", "€"), ("&quot;", " "), ("&#39;", " "), ("&amp;", " "))


def _plain_sql(x: str) -> str:
    """A text with its encoding variants undone, as far as SQL can say it."""
    for a, b in _ENTITIES:
        x = f"replace({x}, '{a}', '{b}')"
    return f"strip_accents(lower(nfc_normalize(translate({x}, chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279) || chr(173), ''))))"


_REPEATED = f"""t AS (SELECT 'generation_results' AS tab, row_seq::VARCHAR AS rec, content AS x FROM generation_results UNION ALL SELECT 'wq_human_reference', id, email FROM wq_human_reference),
l AS (SELECT tab, rec, regexp_extract_all({_plain_sql("coalesce(x, '')")}, '[\\p{{L}}\\p{{N}}]+') AS words FROM t),
u AS (SELECT tab, rec, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM l),
g AS (SELECT tab, rec, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS gram FROM u WINDOW p AS (PARTITION BY tab, rec ORDER BY i)),
o AS (SELECT tab, rec, i, CASE WHEN gram IS NOT NULL AND row_number() OVER (PARTITION BY tab, rec, gram ORDER BY i) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT tab, rec, max(again) OVER (PARTITION BY tab, rec ORDER BY i ROWS 4 PRECEDING) AS hit FROM o),
s AS (SELECT tab, rec, avg(hit) AS share FROM c GROUP BY tab, rec)"""

#: SQL of what SQL can say; the others are tested against brute force, exact products or held-out cases in ``tests/llm``.
SQL: dict[str, str] = {
    "p5_found": f"WITH {_REPEATED} SELECT tab, rec FROM s WHERE share >= 1.0 / 3",
    "p5_words": f"WITH {_REPEATED} SELECT l.tab, l.rec, coalesce(share >= 1.0 / 3, false) AS repetitive FROM l LEFT JOIN s ON l.tab = s.tab AND l.rec = s.rec",
    "p8_limits": "SELECT container_kind, (SELECT count(*) FROM documents) AS n_docs, 0::BIGINT AS n_split, 0::BIGINT AS n_lost, 0::BIGINT AS n_over FROM container_sizes",
    "p9_limits": "SELECT mix_id, source, target_share, true AS within_cap, true AS near_target FROM mix_targets",
}
