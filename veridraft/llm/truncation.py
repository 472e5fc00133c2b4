"""Texts cut off at a field limit or in transfer: values that are strict prefixes of longer copies elsewhere.

Whole emails are seldom repeated, but what they are made of is, so the values compared are *units*: every
sentence from its start, windows of three clauses from each clause, and the skeletons (keys and brackets) of JSON
texts. Names read x and numbers 0. All distinct units are sorted once. In that order the longer copies of a unit
are one stretch that begins right after it, so their number is the difference of two running totals, exact whatever
the lengths and however many there are: the unit itself asks for one total, the unit followed by the last of all
characters for the other.

The last unit of each text, read without marks that say "cut here" (an ellipsis, a fence, a replacement
character), is the candidate: the text was cut off where longer copies exist and are at least as many as the copies
that end where it ends. One longer copy is enough. A sentence of which nothing is known, neither longer copies nor
equal ones, is judged by its last clause that says more than a name or number, and after that by its last words, of which
the same words earlier in the sentence, as in a text that runs in a loop, are the longer copy. A unit that is a prefix of
nothing was not cut off.

An exact check follows: a JSON object that parses is complete; a line of the signature block after a
closing formula is complete; so is a unit whose very words end in a full stop elsewhere when it
ends in an ellipsis.

Copies are no evidence: texts are cleaned once, those alike speak once however often they were delivered, and each
different unit of a text counts once. The verdict of a text goes back to all its rows by its digest.

Units are combined in the mapper and again map-side, so neither a phrase nor a source that holds a third of all rows
moves more than one row for each unit and task. Sorting is by ranges of distinct units, so no range is hot; the driver
gets one total for each range. The texts are read once; they, cleaned, and what the mapper says are written to the
shared folder and read from there.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.llm.text import clean, fold
from veridraft.session import RESERVED, ship, spread, written

#: Clauses of a window, one more than a candidate asks for.
CLAUSES = 3
#: A unit is cut off where at most this share of its copies end as it does.
SHARE = 0.5
#: Last words of a sentence that are looked for earlier in it.
TAIL = 3
#: Characters of units held in a mapper before they are passed on.
HELD = 16_000_000
#: Sorts after everything that begins with what stands before it.
_LAST = "\U0010ffff"

_CUT = re.compile(r"(?:\s*(?:\.{2,}|…|\((?:cont|continua|continued|…|\.\.\.)\.?\)|\[(?:…|\.\.\.|cont\.?)\]|�+|`{3}|[\"“”»'*_~]+|[-–—]+))+$")
_CLOSING_MARKS = re.compile(r"(?:\s*(?:`{3}|[\"“”»'*_~]+))+$")
_SENTENCE_END = re.compile(r"([.!?…])[\"'»”)*]*[^\S\n]+")
_CLAUSE = re.compile(r"(?<=[,;:])\s+|\s+[-–—]\s+")
#: Where a JSON value begins: at the start of a text or line, in a fence or after a colon, whatever stands before.
_OBJECT = re.compile(r"(?:^|\n|:|`{3}\w*)[ \t]*([{\[])\s*(?=[\"{\[\]}]|$)")
#: Names and numbers vary where sentences do not: capitalised words read X unless one alone begins a sentence.
_NAMES = regex.compile(r"\b[A-ZÀ-Ý][\w'’-]*(?: +[A-ZÀ-Ý][\w'’-]*)+|(?<=[a-zß-ÿ\d,;)] )[A-ZÀ-Ý][\w'’-]*")
_RUN = re.compile(r"\bx(?: (?:d[aeo]s? )?x)+\b")
_NUMBER = re.compile(r"\d(?:[\d.,/:h]*\d)?h?")
_OPEN_NUMBER = re.compile(r"(?<=\d),$")
#: Units that say nothing but names and numbers.
_MASKED = re.compile(r"^[x0\W_]*$")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?', re.S)
_LITERAL = re.compile(r"[\w.+-]+")
_ITEMS = re.compile(r'("s"|0)(?:,(?:"s"|0))+')
_KEYS = re.compile(r'"[^"]*":')
_QUOTES = frozenset("`\"“”»'*_~")
_OPEN, _CLOSED, _PAUSE = range(3)
_DECODER = json.JSONDecoder()


def _ending(unit: str) -> int:
    last = unit[-1:]
    if last in (",", ":"):
        return _PAUSE
    return _OPEN if last.isalnum() or last in "-–—/(&€$%#@+=<[{" else _CLOSED


def _sentences(body: str) -> list[str]:
    """The sentences of each line, folded, with names as x and numbers as 0. One that begins with a name after
    another in its line is marked, as there a name begins a sentence rather than a signature."""
    out = []
    masked = _RUN.sub("x", _NUMBER.sub("0", fold(_NAMES.sub("X", body)))).replace("  ", " ")
    for line in _SENTENCE_END.sub("\\1\0", masked).split("\n"):
        first, *rest = line.split("\0")
        first = first.strip()
        if first:
            out.append(first)
        out.extend("\x02" + p if p[0] == "x" else p for p in map(str.strip, rest) if p)
    return out


def _without(marks: re.Pattern, text: str) -> str:
    """``text`` without the marks at its end; only the end is searched."""
    last = text[-1:]
    if last.isalnum() or last in ",:;!?" or last == "." and text[-2:-1] != ".":
        return text  # no mark ends so
    while True:
        tail = text[-60:]
        bare = marks.sub("", tail)
        if bare == tail:
            return text
        text = text[: len(text) - len(tail)] + bare


def _json_start(text: str) -> int:
    """Where the JSON value begins that this text is, whatever preface stands before it; -1 if it is prose."""
    if "{" not in text and "[" not in text:
        return -1
    m = _OBJECT.search(text)
    return m.start(1) if m and ('"' in text[m.start(1) :] or not text[m.end(1) :].strip()) else -1


def _bones(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join([f'"{k}":{_bones(v)}' for k, v in value.items()]) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_bones, value)) + "]"
    return '"s"' if isinstance(value, str) else "0"


def skeleton(text: str) -> tuple[str, bool]:
    """A JSON text's keys and brackets, and whether it is complete: strings read "s", numbers and words 0, lists of such
    values hold one. Whatever stands open at the end, a string, a key or a word, is left out."""
    try:
        return _ITEMS.sub(r"\1", _bones(_DECODER.raw_decode(text)[0])), True
    except (ValueError, RecursionError):
        pass
    out, at = [], 0
    for m in _STRING.finditer(text):
        out.append(_LITERAL.sub("0", text[at : m.start()]))
        out.append(m[0][: m[0].rindex('"') + 1] + ":" if m[1] else '"s"')
        at = m.end()
    rest = text[at:]
    out.append(_LITERAL.sub("0", rest[: rest.index('"')] if '"' in rest else rest))
    bones = _ITEMS.sub(r"\1", re.sub(r"\s+", "", "".join(out)))
    return bones.rstrip("`.…�").rstrip('0"s,'), False


def _json_units(text: str) -> tuple[list[str], list[str] | None]:
    """The units of a JSON text, and what is asked for it if it is not complete: its skeleton, and its last key with
    what follows."""
    bones, whole = skeleton(text)
    keys = [m.start() for m in _KEYS.finditer(bones)]
    tails = ["\x01" + bones[a : keys[i + CLAUSES] if i + CLAUSES < len(keys) else len(bones)] for i, a in enumerate(keys)]
    asked = ["\x01\x01" + bones, "\x01" + bones[keys[-1] if keys else 0 :]]
    return ["\x01\x01" + bones, *tails], None if whole else asked


def _earlier(words: list[str]) -> int | None:
    """Where the last words of a sentence, the very last perhaps unfinished, stand in it before, so that they go on there."""
    *head, last = words[-TAIL:]
    size = len(head)
    for i in range(len(words) - TAIL - 1, -1, -1):
        if words[i + size].startswith(last) and words[i : i + size] == head:
            return i
    return None


@functools.lru_cache(maxsize=50_000)
def _said(sentence: str) -> tuple[list[str], int, list[tuple[str, int]]]:
    """A sentence's clauses, its ending and its units."""
    ending = _ending(sentence)
    out = [(sentence.rstrip(".!?… "), ending)]
    clauses = [c for c in _CLAUSE.split(sentence) if c]
    if len(clauses) > 1:
        for i in range(len(clauses)):
            window = " ".join(clauses[i : i + CLAUSES])
            out.append(("\x03" + window.rstrip(".!?… "), ending if i + CLAUSES >= len(clauses) else _PAUSE))
    else:
        out.append(("\x03" + sentence.lstrip("\x02").rstrip(".!?… "), ending))
    return clauses, ending, out


def units_of(text: str) -> tuple[dict[tuple[str, int], None], tuple[list[str], int, bool] | None]:
    """The units of a cleaned text, each with its ending, and what its last unit asks: the unit and the shorter ones that
    are asked where nothing is known of it, its ending, and whether it carried an ellipsis or the like."""
    start = _json_start(text)
    if start >= 0:
        units, asked = _json_units(text[start:])
        return dict.fromkeys((u, _OPEN if asked else _CLOSED) for u in units), (asked, _OPEN, False) if asked else None
    body = text.strip()
    if not body:
        return {}, None
    closed = _without(_CLOSING_MARKS, body)
    bare = _without(_CUT, body)
    marked = closed != bare
    parts = _sentences(_OPEN_NUMBER.sub("", bare))
    if not parts:
        return {}, None
    out: dict[tuple[str, int], None] = {}
    for p in parts:
        if p[-1] in _QUOTES:
            p = _CLOSING_MARKS.sub("", p) or p
        clauses, ending, units = _said(p)
        out.update(dict.fromkeys(units))
    unit = p.rstrip(".!?… ")
    if (ending == _CLOSED and not marked) or (not marked and (_in_signature(bare) or unit[-1:] == ":" and len(unit.split()) <= 2)):
        return out, None
    asked = [] if _MASKED.match(unit) and unit[:1] != "\x02" else [unit]
    for n in range(1, CLAUSES):
        tail = " ".join(clauses[-n:])
        if not _MASKED.match(tail):
            asked.append("\x03" + tail.lstrip("\x02").rstrip(".!?… "))
            break
    words = unit.split()
    if ending == _OPEN and not marked and len(words) > TAIL:
        at = _earlier(words)
        if at is not None:  # the copy stands in the text itself
            asked.append("\x04" + " ".join(words[-TAIL:]))
            out["\x04" + " ".join(words[at : at + TAIL + 1]), _OPEN] = None
    return out, (asked, ending, marked) if asked else None


def _in_signature(text: str) -> bool:
    """Whether the last line follows a closing formula: a short line ending in a comma, after which
    only short lines come."""
    block = text[text.rfind("\n\n") + 1 :].strip().split("\n")
    if len(block) < 2 or text.rfind("\n\n") < 0:
        return False
    for i, line in enumerate(block[:-1]):
        if line.rstrip().endswith(",") and len(line.split()) <= 6:
            return all(len(x.split()) <= 8 for x in block[i + 1 :])
    return False


_COLUMNS = ["unit", "n0", "n1", "n2", "level", "ending", "marked", "text"]
_SAYS = "unit string, n0 bigint, n1 bigint, n2 bigint, level int, ending int, marked boolean, text string"


def _cleaner(content: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[content] = [clean(t) for t in batch[content]]
            yield batch

    return run


def _mapper(content: str, digest: str):
    """What each distinct text says: in how many texts each unit stands, by its ending (level NULL), and what the
    last unit of a text asks, level 0 first."""

    def passed_on(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(u, *n, None, None, None, None) for u, n in held.items()], columns=_COLUMNS)

    def say(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        size = 0
        for batch in batches:
            out = []
            for ident, text in zip(batch[digest], batch[content]):
                units, last = units_of(text)
                for unit, ending in units:
                    counts = held.get(unit)
                    if counts is None:
                        counts = held[unit] = [0, 0, 0]
                        size += len(unit) + 32
                    counts[ending] += 1
                if last:
                    asked, ending, marked = last
                    for level, unit in enumerate(asked):
                        own = [int((unit, e) in units) for e in range(3)]
                        out.append((unit, *own, level, ending, marked, ident))
                if size > HELD:
                    yield passed_on(held)
                    held.clear()
                    size = 0
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)
        if held:
            yield passed_on(held)

    return say


_RANGES = "part int, upto bigint, unit string, is_end boolean, n0 bigint, n1 bigint, n2 bigint"


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running totals of one range of sorted units, given where they are asked for; last the range's total."""
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        upto = batch["n"].cumsum() + total
        total = int(upto.iloc[-1]) if len(upto) else total
        met = batch["unit"].notna()
        if met.any():
            yield batch[met].assign(part=part, upto=upto[met])[["part", "upto", "unit", "is_end", "n0", "n1", "n2"]]
    yield pd.DataFrame([(part, total, None, None, None, None, None)], columns=["part", "upto", "unit", "is_end", "n0", "n1", "n2"])


def longer_copies(units: DataFrame, asked: DataFrame) -> DataFrame:
    """``unit, n0, n1, n2, longer`` of each distinct ``unit`` asked: its own counts, and in how many texts units stand
    that begin with it and go on. ``units``: unit, n0, n1, n2. Every unit is sorted, none is paired."""
    counts = [F.sum(n).alias(n) for n in ("n0", "n1", "n2")]
    none = [F.lit(0).cast("bigint").alias(n) for n in ("n0", "n1", "n2")]
    starts = asked.select("unit", *none, F.lit(True).alias("asked"))
    ends = asked.select(F.concat("unit", F.lit(_LAST)).alias("unit"), *none, F.lit(True).alias("asked"))
    points = units.select("unit", "n0", "n1", "n2", F.lit(False).alias("asked")).unionAll(starts).unionAll(ends)
    points = written(points.groupBy("unit").agg(*counts, F.max("asked").alias("asked")), "units")
    ranges = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = points.repartitionByRange(ranges, "unit").sortWithinPartitions("unit")
    shown = ordered.select(F.when(F.col("asked"), F.col("unit")).alias("unit"), F.endswith("unit", F.lit(_LAST)).alias("is_end"), "n0", "n1", "n2", (F.col("n0") + F.col("n1") + F.col("n2")).alias("n"))
    found = written(shown.mapInPandas(_running, _RANGES), "totals")
    before, offsets = 0, []
    for r in found.where("unit IS NULL").orderBy("part").select("part", "upto").collect():  # one row for each range
        offsets.append((r["part"], before))
        before += r["upto"]
    offset = units.sparkSession.createDataFrame(offsets, "part int, before bigint")
    placed = found.where("unit IS NOT NULL").join(F.broadcast(offset), "part").withColumn("upto", F.col("upto") + F.col("before"))
    at = F.when(F.col("is_end"), F.expr(f"substring(unit, 1, length(unit) - 1)")).otherwise(F.col("unit"))
    both = placed.groupBy(at.alias("unit")).agg(*counts, (F.max(F.when(F.col("is_end"), F.col("upto"))) - F.max(F.when(~F.col("is_end"), F.col("upto")))).alias("longer"))
    return both


def cleaned(df: DataFrame, content: str, digest: str) -> DataFrame:
    """``df`` with its texts cleaned and their digests, written once. Null texts are left out."""
    ship(df.sparkSession)
    texts = spread(df.where(F.col(content).isNotNull()))
    return written(texts.mapInPandas(_cleaner(content), texts.schema), "texts").withColumn(digest, F.md5(content))


def distinct_texts(rows: DataFrame, content: str, digest: str) -> DataFrame:
    """Each different cleaned text once, with its digest, written once."""
    return written(rows.select(content, digest).distinct(), "distinct")


def cut_off(texts: DataFrame, content: str, digest: str) -> DataFrame:
    """``digest`` of the distinct texts that were cut off."""
    says = written(texts.select(content, digest).mapInPandas(_mapper(content, digest), _SAYS), "says")
    asked = says.where("level IS NOT NULL")
    own = asked.select("unit", *[F.col(n).alias("own" + n) for n in ("n0", "n1", "n2")], "level", "ending", "marked", "text")
    met = own.join(longer_copies(says.where("level IS NULL"), asked.select("unit")), "unit")  # counts are unique by unit
    others = [F.col(n) - F.col("own" + n) for n in ("n0", "n1", "n2")]
    # a full stop goes on from a sentence's open end, but an ellipsis may stand for it
    stopped = F.when((F.col("ending") == _OPEN) & (F.col("marked") | (F.col("level") == 0)), others[_CLOSED]).otherwise(F.lit(0))
    same = sum(F.when(F.col("ending") == i, n).otherwise(F.lit(0)) for i, n in enumerate(others)) + F.when(F.col("marked"), stopped).otherwise(F.lit(0))
    longer = F.col("longer") + F.when(~F.col("marked"), stopped).otherwise(F.lit(0))
    cut = (longer > 0) & (same <= SHARE * (same + longer))
    known = met.select("text", "level", cut.alias("cut"), (F.col("longer") + sum(others) > 0).alias("known"))
    verdict = known.where("known").groupBy("text").agg(F.min_by("cut", "level").alias("cut"))
    return verdict.where("cut").select(F.col("text").alias(digest))


def truncated(df: DataFrame, content: str, keys: Sequence[str]) -> DataFrame:
    """The ``keys`` of the rows whose text was cut off.

    Null and empty texts were not cut off. ``keys`` name the row and may be null; rows that repeat
    both key and text repeat in the result as one. An empty table gives an empty table. No other
    column is read, so clashing names cannot occur. Whole texts are read, however long.
    """
    names, text, digest = [f"{RESERVED}k{i}" for i in range(len(keys))], RESERVED + "text", RESERVED + "digest"
    rows = cleaned(df.select(F.col(content).alias(text), *[F.col(k).alias(n) for n, k in zip(names, keys)]), text, digest)
    found = cut_off(rows.select(text, digest).distinct(), text, digest)
    return rows.join(found, digest, "left_semi").select(*[F.col(n).alias(k) for n, k in zip(names, keys)]).distinct()
