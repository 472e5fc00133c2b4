"""Pattern criteria with negation scope, template placeholders, and scores of adherence and preservation."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridraft.functions.text import CONTRAST_WORD
from veridraft.session import RESERVED

GROUPS = ("required_facts", "required_actions", "forbidden_changes", "forbidden_facts")
SCORED = ("required_actions", "required_facts", "forbidden_changes")
CRITERIA = "task_id string, grp string, criterion_id string, pattern string, ord int"

# Slots of templates, and how a clause denies what follows.
SLOT = (
    r"\[(?:\s*[_Xx.\-]{2,}\s*|\.{3,}|_{2,}|(?:[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ0-9_\-]*\s*)+"
    r"|[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ0-9_\-]*(?:\s+(?:[a-zà-öø-ÿ]{1,3}\s+)*[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ0-9_\-]*)+)\]"
)
SOURCE_SLOT = r"\[[^\]\n]{1,200}\]"
NOT_DENIED = (
    r"(?:não|nao)\b.*\b(?:deixar|deixo|deixa|deixamos|deixam|deixou|deixaram|deixarei|deixará|deixaria|deixaríamos)\s+de\b",
    r"\b(?:not|never|cannot|can't|cant|couldn't|couldn['’]t)\b.*\bfail\s+to\b",
    r"\b(?:not|never|cannot|can't|cant)\b.*\bavoid\s+\w+ing\b",
    r"\b(?:not|never)\b.*\bprevent\b.*\bfrom\b",
)
DIRECTIVES = r"(?:^|\s)(?:sem|evite|evitar|imped[ae]|proibido|proibida|proibidos|proibidas|não é permitido|nao e permitido|não deve|nao deve|não pode|nao pode|não se deve|nao se deve|não faça|nao faca|do not|don't|dont|avoid|avoiding|forbidden|prohibited)\s*$"
NOT_ONLY = r"(?:^|\s)(?:não|nao)\s+(?:só|so|apenas|somente)(?:[^\p{L}]|$)"
DENIED = r"(?:^|\s)(?:não|nao|nunca|jamais|not|never)\s+(?:[\p{L}\p{N}_]|['’])"
CANNOT_BUT = (r"(?:não|nao)\s+(?:posso|pode|vou|vai|vamos)\b", r"\bdeixar\s+de\b")
PREDICATE = r"(?:^|[^\p{L}])(?:é|e|são|sao|foi|foram|será|sera|seria|is|are|was|were|does|do|did|will|would|can|could)\s+(?:not|never)\s*$"
ENDS_DENIED = r"(?:^|\s)(?:não|nao|not|never)\s*$"
MARK = "\x01"


def flattened(document: str) -> list[tuple]:
    """Rows of CRITERIA from a constraint document; every group must be a list of objects and every scored
    pattern must compile."""
    data = json.loads(document)
    if not isinstance(data, dict):
        raise ValueError("constraints must be an object")
    rows, bad = [], []
    for task, spec in sorted(data.items()):
        for group in GROUPS:
            items = spec.get(group, []) if isinstance(spec, dict) else None
            if not isinstance(items, list):
                bad.append(f"{task}.{group}: not a list")
                continue
            for i, item in enumerate(items):
                if not isinstance(item, dict):
                    bad.append(f"{task}.{group}[{i}]: not an object")
                    continue
                name = next((str(item[k]) for k in ("fact_id", "action_id", "forbidden_id") if k in item), "unnamed")
                pattern = str(item.get("pattern") or "")
                if group != "forbidden_facts":
                    try:
                        re.compile(pattern)
                    except re.error as e:
                        bad.append(f"{task}.{group}.{name}: {e}")
                rows.append((str(task), group, name, pattern, i))
    if bad:
        raise ValueError("; ".join(bad))
    return rows


def criteria_frame(spark: SparkSession, document: str) -> DataFrame:
    """A constraint document as a table. Patterns must compile in Java's engine too, which evaluates them."""
    rows = flattened(document)
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    for task, group, name, pattern, _ in rows:
        if group in SCORED:
            try:
                java.compile("(?iu)(?:" + pattern + ")")
            except Exception as e:
                raise ValueError(f"{task}.{group}.{name}: {pattern!r} is no pattern of Java's engine") from e
    return spark.createDataFrame(rows, CRITERIA)


def read_criteria(spark: SparkSession, path: str) -> DataFrame:
    """The constraints in a document; a missing file is a table without rows."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CRITERIA)
    return criteria_frame(spark, "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one document


def negated(prefix: Column) -> Column:
    """Whether the clause before a match denies it; the first rule that applies decides. A clause that is
    nothing but "nunca" or "jamais" denies nothing."""
    p = F.trim(F.lower(prefix))

    def has(*patterns: str) -> Column:
        out = p.rlike("(?iu)" + patterns[0])
        for x in patterns[1:]:
            out = out | p.rlike("(?iu)" + x)
        return out

    return (
        F.when(p == "", False).when(has(*NOT_DENIED), False).when(has(DIRECTIVES), True).when(has(NOT_ONLY), False)
        .when(has(DENIED), ~(has(CANNOT_BUT[0]) & has(CANNOT_BUT[1]))).when(has(PREDICATE), True).otherwise(has(ENDS_DENIED))
    )


def clause_prefixes(text: Column, pattern: Column | str) -> Column:
    """For each match of ``pattern`` the rest of its clause before it, with spaces collapsed."""
    given = F.lit(pattern) if isinstance(pattern, str) else pattern
    cut = F.split(F.regexp_replace(text, F.concat(F.lit("(?iu)(?:"), given, F.lit(")")), F.lit(MARK + "$0")), MARK)
    n = F.size(cut) - 1
    at = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    before = F.transform(at, lambda i: F.array_join(F.slice(cut, F.lit(1), i), ""))
    return F.transform(before, lambda b: F.trim(F.regexp_replace(F.regexp_extract(b, r"[^.!?;,:]*$", 0), r"\s+", " ")))


def affirmed(text: Column, pattern: Column | str) -> Column:
    """Whether some match of ``pattern`` stands in a clause that does not deny it; an empty pattern matches nothing."""
    given = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(given != "", F.exists(clause_prefixes(text, given), lambda p: ~negated(p))).otherwise(False)


def placeholders(text: Column, source: Column | None = None) -> Column:
    """Distinct template slots in order: title-case or blank brackets that are no link, and slots of the
    source that the text repeats."""
    slots = F.regexp_extract_all(text, F.lit(SLOT + r"(?!\()"), F.lit(0))
    if source is not None:
        given = F.array_distinct(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(SOURCE_SLOT), F.lit(0)))
        slots = F.concat(slots, F.filter(given, lambda s: F.contains(text, s)))
    return F.array_distinct(slots)


def _joined(rows: DataFrame, own: DataFrame, key: str, task: str, *columns: str) -> DataFrame:
    """Every row with each criterion of its task, one row each; a task without criteria has none. The table of criteria may
    grow: Spark broadcasts it only under its own size limit, and patterns are evaluated where they meet their rows, so a
    row meets those of its own task alone."""
    spec = own.where(F.col("grp").isin(*SCORED)).select(F.col("task_id").alias(RESERVED + "task"), "grp", "criterion_id", "pattern", "ord")
    given = rows.select(F.col(key).alias(RESERVED + "key"), F.col(task).alias(RESERVED + "task"), *[F.col(c).alias(RESERVED + c) for c in columns])
    return given.join(spec, RESERVED + "task")


def evaluated(rows: DataFrame, own: DataFrame, key: str, task: str, text: str) -> DataFrame:
    """``key, task_id, grp, criterion_id, met`` of every row and criterion of its task. ``own``: a table of CRITERIA."""
    met = affirmed(F.coalesce(RESERVED + text, F.lit("")), F.col("pattern"))
    return _joined(rows, own, key, task, text).select(F.col(RESERVED + "key").alias(key), F.col(RESERVED + "task").alias("task_id"), "grp", "criterion_id", met.alias("met"))


def adherence(rows: DataFrame, own: DataFrame, key: str, task: str, text: str, source: str) -> DataFrame:
    """``key``, ``instruction_adherence_pct`` and ``semantic_preservation_pct`` of each ``key`` (unique). A blank text scores 0;
    without criteria there is no score. A slot that is left in, or of the source that is filled, counts as an action.
    Facts and forbidden changes count even where their pattern is empty: such a fact is never met, such a change
    never made; forbidden changes count as met where they are not affirmed."""
    met = affirmed(F.coalesce(RESERVED + text, F.lit("")), F.col("pattern"))
    each = _joined(rows, own, key, task, text).select(F.col(RESERVED + "key").alias("key"), "grp", F.col("pattern") != "", met.alias("met")).toDF("key", "grp", "stated", "met")
    action, fact, change = ((F.col("grp") == g) for g in SCORED)
    sums = each.groupBy("key").agg(F.count_if(action & F.col("stated")).alias("actions"), F.count_if(action & F.col("stated") & F.col("met")).alias("done"), F.count_if(fact | change).alias("facts"), F.count_if((fact & F.col("met")) | (change & ~F.col("met"))).alias("kept"))
    x = F.coalesce(F.col(text), F.lit(""))
    slots = F.size(placeholders(x, F.col(source)))
    offered = F.coalesce(F.col(source).rlike(SOURCE_SLOT), F.lit(False))
    given = rows.select(F.col(key).alias("key"), (F.regexp_replace(x, r"\s+", "") == "").alias("blank"), F.when((slots == 0) & offered, 1).otherwise(0).alias("filled"), F.when((slots > 0) | offered, 1).otherwise(0).alias("asked"))
    both = given.join(sums, "key", "left").fillna(0, ["actions", "done", "facts", "kept"])
    pct = lambda a, b: F.when(F.col("blank"), 0.0).when(b > 0, F.round(100.0 * a / b, 1))
    return both.select(F.col("key").alias(key), pct(F.col("done") + F.col("filled"), F.col("actions") + F.col("asked")).alias("instruction_adherence_pct"), pct(F.col("kept"), F.col("facts")).alias("semantic_preservation_pct"))


def echo_vocabulary(criteria: DataFrame) -> DataFrame:
    """``task_id, word``: words of three letters or more in a task's patterns, hyphens and apostrophes inside kept, which its
    answers may echo."""
    words = F.explode(F.transform(F.regexp_extract_all("pattern", F.lit(CONTRAST_WORD), F.lit(0)), lambda w: F.lower(F.btrim(w, F.lit("-'’"))))).alias("word")
    return criteria.select("task_id", words).where(F.length("word") >= 3).distinct()


def constraint_profile(criteria: DataFrame) -> DataFrame:
    forbidden = F.col("grp").isin("forbidden_changes", "forbidden_facts")
    return criteria.agg(F.count_distinct("task_id").alias("task_count"), F.coalesce(F.bool_or(forbidden), F.lit(False)).alias("has_forbidden"))


def broad_criteria(criteria: DataFrame) -> DataFrame:
    """Criteria with a bare alternative of at most 12 letters, which a reply of no content might meet; the
    first one of each."""
    plain = F.regexp_replace("pattern", r"\([?!<]", "(")
    branches = F.transform(F.split(plain, r"(?<!\\)\|"), lambda b: F.trim(b))
    bare = F.get(F.filter(branches, lambda b: b.rlike(r"^[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ .\-]{0,11}$")), 0)
    required = F.col("grp").isin("required_actions", "required_facts")
    return criteria.where(required).select("task_id", "criterion_id", bare.alias("bare_alternative")).where("bare_alternative IS NOT NULL")


def floor_violations(own: DataFrame, control: str) -> DataFrame:
    """Required criteria that a constant reply without content meets; there should be none."""
    required = own.where(F.col("grp").isin("required_actions", "required_facts"))
    return required.where(affirmed(F.lit(control), F.col("pattern"))).select("task_id", "grp", "criterion_id")
