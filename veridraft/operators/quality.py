"""Writing quality: style, structure, repetition and profile of single texts, as column expressions.

Everything about one text stays in its row: no words are exploded and moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft.functions import text as T
from veridraft.functions.ngrams import first_repeats
from veridraft.session import ship, spread

# Points taken for a finding, by dimension and severity, factors of single rules, and caps.
PENALTIES = {("grammar", "high"): 8.0, ("spelling", "high"): 6.0, ("repetition", "high"): 14.0, ("repetition", "medium"): 8.0, ("structural", "high"): 12.0, ("structural", "medium"): 6.0, ("style", "high"): 6.0, ("style", "medium"): 2.0}
FACTORS = {"MISSING_GREETING": 0.40, "MISSING_SIGNOFF": 0.35, "REPEATED_NGRAM_PHRASE": 0.50}
CAPS = {"grammar": 40.0, "spelling": 30.0, "repetition": 40.0, "structural": 40.0, "style": 18.0}
DEFAULT_PENALTY = 3.0
# Fixed values of the profile: quality of a greeting and of a farewell by their tokens (up to, quality), of rhythm by the spread of
# sentence lengths, tokens and sentences from which a text is long enough, and the best length of a sentence.
GREETED, GREETED_LONG = ((1, 0.55), (2, 0.72), (3, 0.84), (5, 0.94)), 1.0
CLOSED, CLOSED_LONG, NOT_CLOSED = ((1, 0.65), (2, 0.78), (4, 0.90)), 0.96, 0.40
RHYTHM_ONE, RHYTHM_EVEN, RHYTHM_LEAST, RHYTHM_SPAN = 0.65, 0.82, 0.65, 15
LONG_TOKENS, LONG_SENTENCES, BEST_SENTENCE, SENTENCE_SPAN = 80, 4, 16, 32


def style_flags(c: str) -> dict[str, Column]:
    words = F.filter(T.matches(c, T.WORD), lambda w: w.rlike(T.CAPITALS))
    odd = F.filter(T.matches(c, T.APOSTROPHE), lambda w: ~w.rlike(T.CONTRACTION))
    x = F.col(c)
    return {
        "EXCESSIVE_ALLCAPS": F.size(words) > 2, "EXCESSIVE_EXCLAMATION": x.rlike(T.SHOUTING), "RUN_ON_BLOCK": x.rlike(T.RUN_ON),
        "INFORMAL_CONTRACTION": F.size(odd) > 1, "PUNCTUATION_ANOMALY": x.rlike(T.SPACED_MARK) | x.rlike(T.LOWER_START),
    }


#: Where a body is cut into sentences for fragmentation, and profiles into sentences of a length.
def _said(body: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(body, r"([.!?])\s+", "$1\n"), r"\n+"), lambda s: F.trim(s) != "")


def structure(c: str) -> Column:
    """Struct of the five structural findings; a blank text has none."""
    def body(v: Column) -> Column:
        content, n = v["content"], F.size(v["content"])
        text = F.array_join(F.when(n > 2, F.slice(content, 2, F.greatest(n - 2, F.lit(1)))).otherwise(content), " ")
        return F.struct(v["parts"].alias("parts"), content.alias("content"), n.alias("n"), text.alias("body"), _said(text).alias("said"))

    def findings(v: Column) -> Column:
        content, n, said = v["content"], v["n"], v["said"]
        some = n > 0
        opening = F.slice(T.lines(F.get(content, 0)), 1, 4)
        short = F.filter(said, lambda s: T.n_tokens(s) < 4)
        return F.struct(
            (some & (n >= 2) & ~F.exists(opening, lambda x: x.rlike(T.GREETING))).alias("missing_greeting"),
            (some & (T.n_tokens(v["body"]) < 5)).alias("empty_body"),
            (some & (n >= 2) & ~T.is_signoff(F.get(content, n - 1))).alias("missing_signoff"),
            (some & (F.size(said) > 3) & (F.size(short) / F.size(said) > 0.40)).alias("fragmented"),
            F.when(some, F.size(F.filter(v["parts"], lambda p: T.n_tokens(p) > 200))).otherwise(0).alias("degenerate_paragraphs"),
        )

    split = T.let(T.paragraphs(c), lambda p: F.struct(p.alias("parts"), T.without_headers(p).alias("content")))
    return T.let(T.let(split, body), findings)


def _before(x: Column) -> Column:
    """An array moved one place to the right; lambdas see each element once, nothing is read again by index."""
    return F.concat(F.array(F.lit(None)), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))))


def token_runs(c: Column | str, is_masked: bool = False) -> Column:
    """How many runs of the same token occur, of two or more and of three or more."""
    same = T.let(T.tokens(c if is_masked else T.masked(c)), lambda t: F.zip_with(t, _before(t), lambda a, b: F.coalesce(a == b, F.lit(False))))
    said = F.array_join(F.transform(same, lambda e: F.when(e, "1").otherwise("0")), "")
    return T.let(said, lambda x: F.struct(F.regexp_count(x, F.lit("1+")).alias("runs"), F.regexp_count(x, F.lit("11+")).alias("long_runs")))


def duplicate_sentence(c: Column | str) -> Column:
    """The first sentence of more than 12 characters that occurs again, collapsed and in lower case."""
    said = F.filter(F.transform(F.split(F.col(c) if isinstance(c, str) else c, r"[.!?]+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 12)
    said = F.transform(said, lambda s: F.regexp_replace(F.lower(s), r"\s+", " "))
    twice = lambda s: T.let(F.array_sort(s), lambda o: F.zip_with(o, _before(o), lambda a, b: F.when(a == b, a)))
    return T.let(said, lambda s: F.get(F.array_intersect(s, F.array_compact(twice(s))), 0))


#: Lengths of repeated phrases, the longest first, and places of a phrase that count.
PHRASE_LENGTHS, PHRASE_PLACES = (7, 6, 5), 8


def repeated_phrase(tokens: list[str]) -> tuple[int, str] | None:
    """The first phrase of 7, else 6, else 5 tokens said again without overlap."""
    found = first_repeats([tokens], PHRASE_LENGTHS, PHRASE_PLACES)[0]
    return (found[0], " ".join(tokens[found[1] : found[1] + found[0]])) if found else None


def _has_phrase(tokens: pd.Series) -> pd.Series:
    return pd.Series([x is not None for x in first_repeats([[] if t is None else list(t) for t in tokens], PHRASE_LENGTHS, PHRASE_PLACES)], index=tokens.index)


def has_phrase(tokens: Column) -> Column:
    """Whether a list of tokens has a repeated phrase; whole batches are hashed at once."""
    return F.pandas_udf(_has_phrase, "boolean")(tokens)


def phrases(df: DataFrame, key: str, c: str) -> DataFrame:
    """``key, n, phrase`` of each text with a repeated phrase; null texts have none."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lists = [list(t) for t in b["tokens"]]
            found = first_repeats(lists, PHRASE_LENGTHS, PHRASE_PLACES)
            out = [(k, r[0], " ".join(t[r[1] : r[1] + r[0]])) for k, t, r in zip(b["key"], lists, found) if r]
            yield pd.DataFrame(out, columns=["key", "n", "phrase"])

    rows = spread(df.where(F.col(c).isNotNull()).select(F.col(key).alias("key"), F.col(c).alias("text")))
    return rows.select("key", T.tokens(T.masked("text")).alias("tokens")).mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, n int, phrase string").withColumnRenamed("key", key)


def _stepped(n: Column, steps: tuple, beyond: float) -> Column:
    out = F.lit(beyond)
    for upto, value in reversed(steps):
        out = F.when(n <= upto, value).otherwise(out)
    return out


def profile(c: str) -> Column:
    """Measures of a text's shape; a text without sentences has zeros."""
    def parted(p: Column) -> Column:
        body = T.let(T.without_headers(p), lambda k: F.trim(F.array_join(F.when(F.size(k) > 2, F.slice(k, 2, F.greatest(F.size(k) - 2, F.lit(1)))).otherwise(k), " ")))
        return F.struct(p.alias("parts"), body.alias("body"), F.get(p, F.size(p) - 1).alias("last"))

    def counted(v: Column) -> Column:
        sizes = F.transform(F.filter(F.split(v["body"], r"[.!?]+"), lambda s: F.trim(s) != ""), lambda s: T.n_tokens(s).cast("double"))
        greeting = T.n_tokens(F.coalesce(F.trim(F.get(F.split(F.get(v["parts"], 0), r"\r?\n"), 0)), F.lit("")))
        return F.struct(T.tokens(v["body"]).alias("words"), sizes.alias("sizes"), greeting.alias("greeting"), T.lines(v["last"]).alias("own"), v["last"].alias("last"), F.size(v["parts"]).alias("n_parts"))

    def summed(v: Column) -> Column:
        k = F.size(v["sizes"])
        total = lambda f: F.aggregate(v["sizes"], F.lit(0.0), lambda a, x: a + f(x))
        mean = F.when(k > 0, total(lambda x: x) / k).otherwise(0.0)
        return F.struct(v.alias("v"), k.alias("k"), F.size(v["words"]).alias("n"), mean.alias("mean"), F.when(k > 0, total(lambda x: x * x) / k).otherwise(0.0).alias("squares"))

    def measures(w: Column) -> Column:
        v, k, n, mean = w["v"], w["k"], w["n"], w["mean"]
        spread = F.sqrt(F.greatest(F.lit(0.0), w["squares"] - mean * mean))
        ttr = F.when(n > 0, F.size(F.array_distinct(v["words"])) / n).otherwise(0.0)
        greeting, own, last = v["greeting"], v["own"], v["last"]
        greeted = _stepped(greeting, GREETED, GREETED_LONG)
        farewell = T.n_tokens(F.get(own, 0))
        signed = (v["n_parts"] > 1) & F.size(own).between(1, 5) & (T.n_tokens(last) <= 20) & ~last.rlike(T.MID_END)
        closed = F.when(~F.coalesce(signed, F.lit(False)), NOT_CLOSED).otherwise(_stepped(farewell, CLOSED, CLOSED_LONG))
        rhythm = F.when(k <= 1, RHYTHM_ONE).when(spread < 1, RHYTHM_EVEN).when(spread <= 7, 1.0).otherwise(F.greatest(F.lit(RHYTHM_LEAST), 1 - (spread - 7) / RHYTHM_SPAN))
        return F.struct(
            n.cast("double").alias("body_token_count"), k.cast("double").alias("sentence_count"), F.round(mean, 3).alias("average_sentence_length"), F.round(ttr, 4).alias("lexical_diversity"),
            F.round(spread, 3).alias("sentence_length_sd"), greeting.cast("double").alias("greeting_token_count"), F.round((greeted + closed) / 2, 4).alias("register_quality"),
            F.round(F.least(F.lit(1.0), n / LONG_TOKENS), 4).alias("length_quality"), F.round(F.least(F.lit(1.0), k / LONG_SENTENCES), 4).alias("sentence_count_quality"),
            F.round(F.when(mean > 0, F.greatest(F.lit(0.0), 1 - F.abs(mean - BEST_SENTENCE) / SENTENCE_SPAN)).otherwise(0.0), 4).alias("sentence_length_quality"), F.round(rhythm, 4).alias("rhythm_quality"),
        )

    return T.let(T.let(T.let(T.let(T.paragraphs(c), parted), counted), summed), measures)


def penalty(rule: str, dimension: str, severity: str) -> float:
    return PENALTIES.get((dimension, severity), DEFAULT_PENALTY) * FACTORS.get(rule, 1.0)


#: Rules of structure: field, rule, severity.
STRUCTURE = (("missing_greeting", "MISSING_GREETING", "high"), ("empty_body", "EMPTY_BODY", "high"), ("missing_signoff", "MISSING_SIGNOFF", "medium"), ("fragmented", "SENTENCE_FRAGMENTATION", "medium"))


def findings(df: DataFrame, text: str, strip_fixture: bool = False) -> DataFrame:
    """``df`` with ``found``: what the detectors say of ``text``, NULL for a blank one. Structure is judged on the text as it
    is, repetition and style without leading headers. ``strip_fixture`` takes a calibration text's header lines away
    before anything is judged."""
    ship(df.sparkSession)
    source, scoring, masked = "_vd_source", "_vd_scoring", "_vd_masked"
    given = T.without_fixture_headers(text) if strip_fixture else F.col(text)
    rows = df.withColumn(source, F.when(F.regexp_replace(F.coalesce(given, F.lit("")), r"\s+", "") != "", given))
    rows = rows.withColumn(scoring, T.scoring_text(source)).withColumn(masked, T.masked(scoring))
    rows = rows.withColumn("_vd_phrase", has_phrase(T.tokens(masked)))
    style = sum(F.coalesce(f, F.lit(False)).cast("int") for f in style_flags(scoring).values())
    built = structure(source)
    found = F.struct(
        token_runs(masked, True).alias("runs"), F.col("_vd_phrase").alias("phrase"), duplicate_sentence(masked).isNotNull().alias("duplicate"), built.alias("built"), style.alias("style"),
        T.n_tokens(scoring).alias("n_tokens"),
    )
    return rows.withColumn("found", F.when(F.col(source).isNotNull(), found)).drop("_vd_phrase", masked, *([] if strip_fixture else [source]))


def points(found: Column) -> dict[str, Column]:
    """Points that findings take, by dimension, not yet capped."""
    style = found["style"] * penalty("", "style", "medium")
    built = sum(F.when(found["built"][f], penalty(rule, "structural", level)).otherwise(0.0) for f, rule, level in STRUCTURE) + found["built"]["degenerate_paragraphs"] * penalty("DEGENERATE_PARAGRAPH", "structural", "medium")
    runs = found["runs"]
    again = runs["long_runs"] * penalty("", "repetition", "high") + (runs["runs"] - runs["long_runs"]) * penalty("", "repetition", "medium")
    again = again + F.when(found["duplicate"], penalty("", "repetition", "high")).otherwise(0.0) + F.when(found["phrase"], penalty("REPEATED_NGRAM_PHRASE", "repetition", "medium")).otherwise(0.0)
    return {"style": style, "structural": built, "repetition": again}


def counts(found: Column) -> dict[str, Column]:
    """Findings by dimension."""
    built = sum(found["built"][f].cast("int") for f, _, _ in STRUCTURE) + found["built"]["degenerate_paragraphs"]
    again = found["runs"]["runs"] + found["phrase"].cast("int") + found["duplicate"].cast("int")
    return {"repetition_count": again, "structural_issue_count": built, "style_issue_count": found["style"]}


def evaluate(df: DataFrame, key: str, text: str, external: DataFrame | None = None, tool_used: bool = False, calibration: dict | None = None, strip_fixture: bool = False) -> DataFrame:
    """``key`` with a text's writing quality: findings by dimension, ``wq_defect_only_score``, its profile, and
    ``writing_quality_score``.

    ``external``: tall findings ``key, rule_id, dimension, severity`` of a grammar tool or, where that did not run, of spelling;
    their points join those of the detectors under the same caps. Without a calibration a text is excluded: it
    has counts of 0 and no score, as evidence that is missing is no score. A blank text is excluded too. Rows repeat as they
    are; ``key`` must be unique where ``external`` is given.
    """
    rows = findings(df, text, strip_fixture).select(F.col(key).alias("key"), "found", F.col("_vd_scoring").alias("scoring"))
    if external is not None:
        tall = external.select(F.col(key).alias("key"), "rule_id", "dimension", "severity")
        worth = F.lit(DEFAULT_PENALTY)
        for (dimension, severity), p in PENALTIES.items():
            worth = F.when((F.col("dimension") == dimension) & (F.col("severity") == severity), p).otherwise(worth)
        dims = F.col("dimension")
        by = tall.groupBy("key").agg(*[F.sum(F.when(dims == d, worth)).alias("points_" + d) for d in CAPS], *[F.count_if(dims == d).alias("n_" + d) for d in CAPS])
        rows = rows.join(by, "key", "left")
    else:
        rows = rows.select("*", *[F.lit(None).cast("double").alias("points_" + d) for d in CAPS], *[F.lit(0).cast("bigint").alias("n_" + d) for d in CAPS])
    own, number = points(F.col("found")), counts(F.col("found"))
    taken = sum(F.least(F.lit(cap), F.coalesce("points_" + d, F.lit(0.0)) + own.get(d, F.lit(0.0))) for d, cap in CAPS.items())
    scored = F.col("found").isNotNull()
    defect = F.when(scored, F.round(F.greatest(F.lit(0.0), 100 - taken), 1))
    shape = profile("scoring")
    rows = rows.withColumn("defect", defect).withColumn("profile", F.when(scored, shape))
    features = [F.col("profile")[f] for f in ("sentence_length_sd", "lexical_diversity", "register_quality", "rhythm_quality")] + [F.col("defect") / 100]
    whole = scored if calibration else F.lit(False)
    n = {"grammar_error_count": F.col("n_grammar"), "spelling_error_count": F.col("n_spelling"), **{k: F.coalesce(v, F.lit(0)) + F.col("n_" + d) for (k, v), d in zip(number.items(), ("repetition", "structural", "style"))}}
    out = [F.when(whole, F.coalesce(v, F.lit(0))).otherwise(0).cast("bigint").alias(k) for k, v in n.items()]
    score = F.when(whole, calibrated(features, calibration, F.col("defect"))) if calibration else F.lit(None).cast("double")
    reason = F.when(~scored, "empty_text").when(~whole, "calibration unavailable")
    return rows.select(
        F.col("key").alias(key), *out, score.alias("writing_quality_score"), F.when(whole, F.col("defect")).alias("wq_defect_only_score"), F.when(whole, F.col("profile")).alias("wq_quality_profile"),
        F.lit(tool_used).alias("languagetool_api_used"), whole.alias("wq_scored"), reason.alias("wq_excluded_reason"),
    )


def defect_scores(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``defect_score``: 100 less the capped points of style, structure and repetition; NULL for a blank text."""
    own = points(F.col("found"))
    taken = sum(F.least(F.lit(CAPS[d]), own[d]) for d in own)
    out = findings(df, text).withColumn("defect_score", F.when(F.col("found").isNotNull(), F.round(F.greatest(F.lit(0.0), 100 - taken), 1)))
    return out.drop("found", "_vd_scoring")


def compute_score(violations: DataFrame, key: str) -> DataFrame:
    """Scores from tall violations ``key, rule_id, dimension, severity``: capped for each dimension."""
    points = F.lit(DEFAULT_PENALTY)
    for (dimension, severity), p in PENALTIES.items():
        points = F.when((F.col("dimension") == dimension) & (F.col("severity") == severity), p).otherwise(points)
    factor, cap = F.lit(1.0), F.lit(1e9)
    for rule, x in FACTORS.items():
        factor = F.when(F.col("rule_id") == rule, x).otherwise(factor)
    for dimension, x in CAPS.items():
        cap = F.when(F.col("dimension") == dimension, x).otherwise(cap)
    by = violations.groupBy(key, "dimension").agg(F.sum(points * factor).alias("points")).withColumn("points", F.least("points", cap))
    return by.groupBy(key).agg(F.round(F.greatest(F.lit(0.0), 100 - F.sum("points")), 1).alias("score"))


def calibrated(features: list[Column], model: dict, defect: Column) -> Column:
    """A frozen ensemble of regression trees, each compiled to nested conditions: latent score clipped to
    1..5, mapped to a scale and bounded by the defect score and 99.9."""

    def tree(nodes: list[dict], at: int = 0) -> Column:
        node = nodes[at]
        if node.get("left") is None or node["left"] < 0:
            return F.lit(float(node["value"]))
        return F.when(features[node["feature"]] <= node["threshold"], tree(nodes, node["left"])).otherwise(tree(nodes, node["right"]))

    latent = F.lit(float(model["init_value"]))
    for nodes in model["trees"]:
        latent = latent + F.lit(float(model["learning_rate"])) * tree(nodes)
    latent = F.greatest(F.lit(1.0), F.least(F.lit(5.0), latent))
    raw = F.lit(float(model["score_mapping"]["base"])) + F.lit(float(model["score_mapping"]["per_level"])) * latent
    return F.round(F.least(defect, raw, F.lit(99.9)), 1)
