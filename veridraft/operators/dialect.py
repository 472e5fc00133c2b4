"""Dialect contrasts against supplied lexicons, grammar rules over token annotations, and the dialect evaluation that is
composed of them; tiers of violations, word fidelity and graded compliance.

Lexicons and token annotations are input tables: ``lexicon(variant, form, folded)`` and
``token_ann(doc_id, sent_id, i, text, lemma, pos, dep, head, morph, is_punct, is_space)``. What is not supplied
yields NULL, never a score.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from urllib import parse

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridraft.functions import text as T
from veridraft.session import RESERVED

# Weights of tiers and of severities.
TIER_WEIGHTS = {1: 1.0, 2: 1.75, 3: 2.5, 4: 3.0}
SEVERITY_WEIGHTS = {"low": 0.75, "medium": 1.5, "high": 3.0}
OTHER_SEVERITY = 1.5
#: Protocol names are words of no language. The default are those the standard library knows; a registry of all of them is a
#: parameter (``sources.jsonl.read_schemes`` reads a file of them).
SCHEMES = tuple(sorted({s for s in (*parse.uses_netloc, *parse.uses_relative, *parse.uses_params) if s} | {"mailto", "tel", "sms", "geo", "urn", "data", "ssh", "ldap", "about", "chrome", "proxy"}))
VIOLATION = "source string, rule_id string, context string, severity string, validated boolean, score_eligible boolean"


def contrasts(df: DataFrame, key: str, text: str, lexicon: DataFrame, variant: str = "pt-br", other: str = "pt-pt", echo: DataFrame | None = None, task: str | None = None, schemes: Sequence[str] = SCHEMES) -> DataFrame:
    """``key, word, score_eligible``: words of one variant's lexicon that the other does not know, schemes and
    words of the task itself apart. A word is eligible if it begins in lower case in the text. Joins are on the word; Spark
    broadcasts a lexicon only where its own size check allows it."""
    plain = F.regexp_replace(text, T.SCHEME, " ")  # a protocol before :// is no word
    words = F.explode(F.array_distinct(F.filter(T.matches(plain, T.CONTRAST_WORD), lambda w: F.length(w) >= 3))).alias("raw")
    rows = df.where(F.col(text).isNotNull()).select(key, *([task] if task else []), words)
    rows = rows.withColumn("word", F.lower("raw")).where(~F.col("word").isin(*schemes))
    rows = rows.groupBy(key, *([task] if task else []), "word").agg(F.bool_or(F.col("raw") == F.col("word")).alias("score_eligible"))
    known = lexicon.select(F.col("variant").alias("v"), F.col("form").alias("word")).distinct()
    rows = rows.join(known.where(F.col("v") == variant).drop("v"), "word", "left_semi")
    rows = rows.join(known.where(F.col("v") == other).drop("v"), "word", "left_anti")
    if echo is not None and task:
        rows = rows.join(echo.select(F.col("task_id").alias(task), "word"), [task, "word"], "left_anti")
    return rows.select(key, "word", "score_eligible")


def unknown_words(df: DataFrame, key: str, text: str, lexicon: DataFrame, variant: str, other: str, severe: bool = False) -> DataFrame:
    """``key, word, accent_of``: words of four letters or more in neither lexicon, with the variant's form that
    differs by accents only, if there is one. A capitalised word counts only where position explains the capital: at the start
    or after a sentence's end, a colon or a line end, unless it is all capitals or a point follows. ``severe`` keeps those
    with such a form only, as finding others needs suggestions."""
    marked = F.regexp_replace(T.masked(text), r"(^|[.!?:;\n]\s*)([A-ZÀ-Ý])(?=[a-zà-ÿ'-])([A-Za-zÀ-ÿ'-]+)(?![A-Za-zÀ-ÿ'.-])", "$1\u0001$2$3")
    found = F.filter(T.matches(marked, "\u0001?" + T.SPELLED_WORD), lambda w: w.rlike("^\u0001|^[^A-ZÀ-Ý]+$"))
    words = F.explode(F.array_distinct(F.transform(found, lambda w: F.lower(F.regexp_replace(w, "\u0001", ""))))).alias("word")
    rows = df.where(F.col(text).isNotNull()).select(key, words).where(F.length("word") >= 4)
    for v in (variant, other):
        rows = rows.join(lexicon.where(F.col("variant") == v).select(F.col("form").alias("word")), "word", "left_anti")
    near = lexicon.where(F.col("variant") == variant).groupBy(F.col("folded").alias("f")).agg(F.min("form").alias("accent_of"))
    rows = rows.withColumn("f", T.fold_diacritics("word")).join(near, "f", "left").select(key, "word", "accent_of")
    return rows.where("accent_of IS NOT NULL AND accent_of <> word") if severe else rows


def tier(rule: Column, severity: Column) -> Column:
    r, s = F.upper(F.coalesce(rule, F.lit(""))), F.lower(F.coalesce(severity, F.lit("medium")))
    return (
        F.when(F.contains(r, F.lit("GERUND")), 1)
        .when(F.contains(r, F.lit("PROCLISIS")) | F.contains(r, F.lit("CLITIC")) | F.contains(r, F.lit("TER_HAVER")), 2)
        .when((s == "high") | F.contains(r, F.lit("VOCAB")) | F.contains(r, F.lit("LEAK")) | F.contains(r, F.lit("REPLACEMENT")), 4)
        .otherwise(3)
    )


def _by(c: Column, weights: dict, default: float = 0.0) -> Column:
    out = F.lit(default)
    for k, w in weights.items():
        out = F.when(c == k, w).otherwise(out)
    return out


def eligible(v: Column, fields: Sequence[str] = ("score_eligible",)) -> Column:
    """Violations that count: those of the dialect rules that are eligible or, where nothing is said of that,
    validated. ``fields``: those the violations have."""
    said = [v[f] for f in ("score_eligible", "validated") if f in fields]
    return F.coalesce(*said, F.lit(False)) & F.upper(v["rule_id"]).startswith("PTBR_")


def fidelity(violations: Column, words: Column, fields: Sequence[str] = ("score_eligible",)) -> Column:
    """Struct of weighted leaks, violations by tier and the word fidelity score of a text."""
    tiers = F.transform(F.filter(violations, lambda v: eligible(v, fields)), lambda v: tier(v["rule_id"], v["severity"]))
    weight = F.coalesce(F.aggregate(tiers, F.lit(0.0), lambda a, t: a + _by(t, TIER_WEIGHTS)), F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 100 * weight / F.greatest(words, F.lit(1)))), 1)
    count = lambda k: F.when(violations.isNull(), 0).otherwise(F.size(F.filter(tiers, lambda t: t == k))).cast("bigint")
    return F.struct(weight.alias("weighted_leaks"), *[count(k).alias(f"tier_{k}") for k in TIER_WEIGHTS], score.alias("wf_score"))


def graded(violations: Column, words: Column, fields: Sequence[str] = ("score_eligible",)) -> Column:
    """Struct of binary and graded compliance, in percent."""
    kept = F.filter(violations, lambda v: eligible(v, fields))
    weight = F.aggregate(kept, F.lit(0.0), lambda a, v: a + _by(F.lower(F.coalesce(v["severity"], F.lit("medium"))), SEVERITY_WEIGHTS, OTHER_SEVERITY))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 100 * weight / F.greatest(words, F.lit(1)))), 1)
    return F.struct(F.when(F.size(kept) > 0, 0.0).otherwise(100.0).alias("ptpt_compliance_pct"), score.alias("ptpt_compliance_graded_pct"))


def deduplicated(violations: Column, always: Callable[[Column], Column] | None = None) -> Column:
    """An ordered array without issues whose context is part of an accepted one's, letter case apart; those ``always`` holds
    for are accepted anyway."""
    empty = F.filter(violations, lambda v: F.lit(False))

    def step(kept: Column, v: Column) -> Column:
        part = F.exists(kept, lambda k: F.coalesce(F.contains(F.lower(k["context"]), F.lower(v["context"])), F.lit(False)))
        return F.when(part if always is None else part & ~always(v), kept).otherwise(F.concat(kept, F.array(v)))

    return F.aggregate(violations, empty, step)


def tool_findings(matches: DataFrame, regional: bool) -> DataFrame:
    """Matches of an external grammar tool that are regionalisms, or the others, with their dimension and
    severity."""
    rule, category = F.upper("rule_id"), F.upper("category_id")
    is_regional = (category == "REGIONALISMS") | rule.startswith("PT_BR") | rule.startswith("PT_BRASIL")
    kind = F.lower("issue_type")
    spelling = kind.isin("misspelling", "spelling", "typographical")
    out = matches.where(is_regional if regional else ~is_regional)
    return out.withColumn("dimension", F.when(kind == "grammar", "grammar").when(spelling, "spelling").otherwise("style")).withColumn("severity", F.when((kind == "grammar") | spelling, "high").otherwise("medium"))


def english_share(df: DataFrame, key: str, text: str, lexicon: DataFrame, variant: str = "pt-pt", limit: float = 0.35) -> DataFrame:
    """``key, hit_share, english``: the share of a text's words that the lexicon knows; under the limit, and with
    more than one word, the text is taken for English. Texts without words have no row."""
    words = df.where(F.col(text).isNotNull()).select(key, F.explode(T.matches(text, T.LANGUAGE_WORD)).alias("w"))
    known = lexicon.where(F.col("variant") == variant).select(F.col("form").alias("w"), F.lit(1).alias("hit")).distinct()
    found = words.withColumn("w", F.lower("w")).groupBy(key, "w").count().join(known, "w", "left")
    out = found.groupBy(key).agg((F.sum(F.when(F.col("hit") == 1, F.col("count")).otherwise(0)) / F.sum("count")).alias("hit_share"), F.sum("count").alias("n"))
    return out.select(key, "hit_share", ((F.col("hit_share") < limit) & (F.col("n") > 1)).alias("english"), "n")


def _says(feature: str, value: str, morph: str = "morph") -> Column:
    """Whether a token's annotation gives a feature this value, alone or among others."""
    return F.array_contains(F.split(F.coalesce(F.col(morph)[feature], F.lit("")), ","), value)


def grammar_findings(ann: DataFrame) -> DataFrame:
    """``doc_id, sent_id, i, text, rule_id, severity, context`` of four grammar rules over token annotations: gerunds after a
    verb of their clause, clitics before the verb at the start of a sentence, "ter" without a subject that brings in
    something indefinite, and "para mim" before an infinitive. Windows run inside one sentence; heads and children meet
    by one join on the sentence."""
    w = Window.partitionBy("doc_id", "sent_id").orderBy("i")
    a = ann.where(~F.col("is_space"))
    a = a.withColumn("clause", F.sum((F.col("is_punct") | F.col("text").isin(".", "!", "?", ";")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc_id", "sent_id", "clause").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    verb = F.col("pos").isin("VERB", "AUX")
    a = a.withColumn("verb_before", F.last(F.when(verb, F.col("text")), ignorenulls=True).over(inside))
    a = a.withColumn("first_i", F.min(F.when(~F.col("is_punct"), F.col("i"))).over(Window.partitionBy("doc_id", "sent_id")))
    for name, column in (("next_pos", "pos"), ("next_text", "text")):
        a = a.withColumn(name, F.lead(column).over(w))
    a = a.withColumn("next_form", F.lead(F.col("morph")["VerbForm"]).over(w))
    a = a.withColumn("back_lemma", F.lag("lemma").over(w)).withColumn("back_text", F.lag("text").over(w))
    oblique = (F.col("dep").isin("obj", "iobj", "expl") | _says("Case", "Acc") | _says("Case", "Dat")) & ~_says("Case", "Nom")
    starts = (F.col("i") == F.col("first_i")) & ~F.contains("text", F.lit("-")) & oblique & F.col("next_pos").isin("VERB", "AUX")
    found = lambda rule, severity, *words: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.concat_ws(" ", *words).alias("context"))
    rule = F.array_compact(F.array(
        F.when((F.col("morph")["VerbForm"] == "Ger") & F.col("verb_before").isNotNull(), found("PTBR_GERUND_OVERUSE", "medium", "verb_before", "text")),
        F.when(F.coalesce(starts, F.lit(False)), found("PTBR_PROCLISIS_START", "medium", "text", "next_text")),
        F.when((F.col("lemma") == "mim") & (F.col("pos") == "PRON") & (F.col("back_lemma") == "para") & (F.col("next_form") == "Inf"), found("PTBR_PARA_MIM_VERBO", "high", "back_text", "text", "next_text")),
    ))
    near = a.withColumn("r", F.explode(rule)).select("doc_id", "sent_id", "i", "text", "r.*")
    return near.unionByName(_existential(ann.where(~F.col("is_space"))).select(*near.columns))


def _existential(a: DataFrame) -> DataFrame:
    """Finite third-person "ter" without a subject whose object has an indefinite article."""
    unsaid = lambda f, v: F.col("morph")[f].isNull() | _says(f, v)
    ter = a.where((F.col("lemma") == "ter") & F.col("pos").isin("VERB", "AUX") & unsaid("Person", "3") & unsaid("Mood", "Ind") & unsaid("VerbForm", "Fin"))
    ter = ter.select("doc_id", "sent_id", F.col("i").alias("verb_i"), F.col("text").alias("verb_text"))
    child = a.select("doc_id", "sent_id", F.col("head").alias("verb_i"), F.col("i").alias("child_i"), F.col("dep").alias("child_dep"), F.col("pos").alias("child_pos"))
    article = (_says("Definite", "Ind") | _says("PronType", "Ind") | (_says("PronType", "Art") & ~_says("Definite", "Def"))) & F.col("dep").isin("det", "nummod")
    marked = a.where(article).select("doc_id", "sent_id", F.col("head").alias("child_i")).distinct().withColumn("indefinite", F.lit(True))
    met = ter.join(child, ["doc_id", "sent_id", "verb_i"]).join(marked, ["doc_id", "sent_id", "child_i"], "left")
    subject = F.col("child_dep").isin("nsubj", "nsubj:pass") | (F.col("child_pos").isin("NOUN", "PROPN", "PRON") & (F.col("child_i") < F.col("verb_i")))
    told = met.groupBy("doc_id", "sent_id", "verb_i", "verb_text").agg(F.bool_or(subject).alias("subject"), F.bool_or((F.col("child_dep") == "obj") & F.coalesce("indefinite", F.lit(False))).alias("brings"))
    return told.where("brings AND NOT subject").select("doc_id", "sent_id", F.col("verb_i").alias("i"), F.col("verb_text").alias("text"), F.lit("PTBR_TER_HAVER").alias("rule_id"), F.lit("medium").alias("severity"), F.col("verb_text").alias("context"))


def evaluate(df: DataFrame, key: str, text: str, lexicon: DataFrame | None, annotations: DataFrame | None = None, tool: DataFrame | None = None, classified: DataFrame | None = None, echo: DataFrame | None = None, task: str | None = None, schemes: Sequence[str] = SCHEMES) -> DataFrame:
    """The dialect evaluation of each text, composed: one row for each ``key`` (unique), with the violations accepted, in order:
    regionalisms of a grammar tool, grammar rules, lexical contrasts, each of the last two only if its context is no part of
    an accepted one's.

    ``lexicon``: forms by variant, ``annotations``: tokens whose ``doc_id`` is the key, ``tool``: matches ``key, rule_id,
    category_id, context, ord``, ``classified``: ``key, label, ptpt_prob``. Each may be missing. A blank text, a single unknown
    word, and a text without a lexicon and without evidence have no score (NULL) and say why in ``status``; a text in English
    complies to 0 %. Nothing but the text's own findings is gathered for a text.
    """
    blank = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", "") == ""
    rows = df.select(F.col(key).alias("key"), *([F.col(task).alias(RESERVED + "task")] if task else []), F.when(~blank, F.col(text)).alias("text"))
    found = []
    if tool is not None:
        own = tool_findings(tool, True)
        found.append(own.select(F.col(key).alias("key"), F.lit(0).alias("kind"), F.col("ord").cast("bigint").alias("at"), F.lit("grammar tool").alias("source"), "rule_id", "context", "severity", F.lit(None).cast("boolean").alias("validated"), F.lit(None).cast("boolean").alias("score_eligible")))
    if annotations is not None:
        rules = F.array_position(F.array(*[F.lit(x) for x in ("PTBR_GERUND_OVERUSE", "PTBR_PROCLISIS_START", "PTBR_TER_HAVER", "PTBR_PARA_MIM_VERBO")]), F.col("rule_id")) * F.lit(1 << 40)
        found.append(grammar_findings(annotations).select(F.col("doc_id").alias("key"), F.lit(1).alias("kind"), (rules + F.col("i")).alias("at"), F.lit("grammar rules").alias("source"), "rule_id", "context", "severity", F.lit(True).alias("validated"), F.lit(None).cast("boolean").alias("score_eligible")))
    if lexicon is not None:
        words = contrasts(rows, "key", "text", lexicon, echo=echo, task=RESERVED + "task" if task else None, schemes=schemes)
        where = F.lower(F.col("text"))
        at = words.join(rows.select("key", "text"), "key").select("key", F.instr(where, F.col("word")).alias("at"), "word", "score_eligible")
        found.append(at.select("key", F.lit(2).alias("kind"), F.col("at").cast("bigint").alias("at"), F.lit("lexical contrast").alias("source"), F.lit("PTBR_LEXICAL_CONTRAST").alias("rule_id"), F.col("word").alias("context"), F.lit("medium").alias("severity"), F.col("score_eligible").alias("validated"), "score_eligible"))
    if found:
        tall = found[0]
        for other in found[1:]:
            tall = tall.unionByName(other)
        fields = ("source", "rule_id", "context", "severity", "validated", "score_eligible")
        lists = tall.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "at", *fields))).alias("all"))
        rows = rows.join(lists, "key", "left")
    else:
        rows = rows.withColumn("all", F.lit(None).cast(f"array<struct<kind:int,at:bigint,{VIOLATION.replace(' ', ':').replace(',:', ',')}>>"))
    accepted = F.coalesce(deduplicated(F.col("all"), lambda v: v["kind"] == 0), F.filter(F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("at"), *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in VIOLATION.split(", ")])), lambda v: F.lit(False)))
    rows = rows.withColumn("violations", accepted)
    if lexicon is not None:
        share = english_share(rows.where("text IS NOT NULL"), "key", "text", lexicon)
        rows = rows.join(share.select("key", "english", (F.col("n") == 1).alias("single"), (F.col("hit_share") == 0).alias("unknown")), "key", "left")
    else:
        rows = rows.select("*", *[F.lit(False).alias(c) for c in ("english", "single", "unknown")])
    rows = rows.join(classified.select(F.col(key).alias("key"), "label", "ptpt_prob"), "key", "left") if classified is not None else rows.select("*", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("ptpt_prob"))
    has = ("score_eligible", "validated")
    counted = F.filter("violations", lambda v: eligible(v, has))
    no_text, alone = F.col("text").isNull(), F.coalesce(F.col("single") & F.col("unknown"), F.lit(False))
    english = F.coalesce("english", F.lit(False))
    degraded = F.lit(lexicon is None) & (F.size(counted) == 0)
    state = F.when(no_text, "empty").when(alone, "insufficient text").when(english, "english").when(degraded, "lexicon unavailable").otherwise("ok")
    rows = rows.withColumn("status", state).withColumn("n", F.size(counted))
    judged, mismatch = F.col("status").isin("ok"), F.col("status") == "english"
    measured = graded(F.col("violations"), F.size(T.matches("text", T.WF_WORD)), has)
    silent = F.col("status").isin("empty", "insufficient text", "english")
    value = lambda ok, english_value: F.when(judged, ok).when(mismatch, F.lit(english_value))
    return rows.select(
        F.col("key").alias(key), "status", value(measured["ptpt_compliance_pct"], 0.0).alias("ptpt_compliance_pct"), value(measured["ptpt_compliance_graded_pct"], 0.0).alias("ptpt_compliance_graded_pct"),
        value(measured["ptpt_compliance_graded_pct"], 0.0).alias("pt_dialect_score"), value(F.col("n") > 0, False).alias("ptbr_leakage_detected"), value(F.col("n") == 0, False).alias("is_clean_ptpt"),
        F.when(judged, F.col("n")).otherwise(0).alias("ptbr_violation_count"), F.when(silent, 0).otherwise(F.size(F.filter("violations", lambda v: F.upper(v["rule_id"]).startswith("PTBR_")))).alias("ptbr_candidate_count"),
        F.when(~silent, F.col("ptpt_prob")).alias("euptvid_probability"), F.when(mismatch, "EN").when(F.col("status") == "insufficient text", "UNKNOWN").otherwise(F.when(~no_text, F.col("label"))).alias("euptvid_label"),
        F.when(silent, F.filter("violations", lambda v: F.lit(False))).otherwise(F.col("violations")).alias("violations"),
    )


def marker_visibility(markers: DataFrame, key: str, column: str, lexicon: DataFrame, variant: str = "pt-br", other: str = "pt-pt") -> DataFrame:
    """``key, all_visible, any_visible``: whether the words of a row's markers are known to one variant only, which is
    all a difference of lexicons can see. Rows without marker words have no row."""
    words = markers.select(key, F.explode(column).alias("m")).select(key, F.explode(T.matches("m", T.LANGUAGE_WORD)).alias("w")).select(key, F.lower("w").alias("w"))
    sides = lexicon.groupBy(F.col("form").alias("w")).agg(F.bool_or(F.col("variant") == variant).alias("own"), F.bool_or(F.col("variant") == other).alias("theirs"))
    seen = words.join(sides, "w", "left").withColumn("visible", F.coalesce(F.col("own") & ~F.col("theirs"), F.lit(False)))
    return seen.groupBy(key).agg(F.bool_and("visible").alias("all_visible"), F.bool_or("visible").alias("any_visible"))


def invisible_markers(markers: DataFrame, key: str, column: str, lexicon: DataFrame, variant: str = "pt-br", other: str = "pt-pt") -> DataFrame:
    """``key, invisible``: whether every word of a row's markers lies in both lexicons, so that their difference cannot show
    it. Rows without marker words have no row."""
    words = markers.select(key, F.explode(column).alias("m")).select(key, F.explode(T.matches("m", T.LANGUAGE_WORD)).alias("w")).select(key, F.lower("w").alias("w"))
    sides = lexicon.groupBy(F.col("form").alias("w")).agg((F.bool_or(F.col("variant") == variant) & F.bool_or(F.col("variant") == other)).alias("both"))
    return words.join(sides, "w", "left").groupBy(key).agg(F.bool_and(F.coalesce("both", F.lit(False))).alias("invisible"))


def standalone_fidelity(violations: Column, words: Column, english: Column) -> Column:
    """Word fidelity of a text on its own: English texts score 0."""
    return F.when(english, 0.0).otherwise(fidelity(violations, words)["wf_score"])


def overlaps(a: str, b: str) -> Column:
    """Whether two (start, end) structs of columns share a character."""
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{a}.end") > F.col(f"{b}.start"))
