"""Prompt and response pairs that are broken: empty, truncated, refused, copied or in the wrong language.

The response walks the suffix automaton of its prompt's words, which gives the share of the response
that is the prompt's own wording, in any order. Automata of refusal phrases (Aho-Corasick) find
declined tasks, a stack of delimiters finds what was opened and never closed, and votes of stopwords
give the languages of prompt and response. Truncation is the prefix test of ``truncation``, or a last line that ends
inside a bracket or quotation by the stack, which that test does not judge where a mark stands at the end. Nothing
depends on how long a text is: shares decide.

The responses are read once and cleaned once. Pairs are made by one equi join on the prompt's id; a prompt that a third
of all answers share is split by adaptive execution, as prompts are unique. Defects, repetition and residue are judged in
the same mapper, which passes on keys only.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.llm import repetition, residue, truncation
from veridraft.llm.languages import EXCLUSIVE, voted
from veridraft.llm.text import WORD, clean, fold, folded_words, sentences
from veridraft.session import RESERVED, ship

DEFECTS = ("empty", "refusal", "truncated", "copy", "language")
#: Words in a row from which wording counts as the prompt's own.
COPIED_RUN = 4
#: Share of a response's words that a copy takes from its prompt, and of a sentence's words that are its own if it replies.
COPIED_SHARE, OWN_SHARE = 0.7, 0.5
#: Share of the sentences of a finished email that decline the task in a refusal.
REFUSED_SHARE = 0.25
#: A text with this share of its expected language's own stopwords is in it.
EXPECTED_SHARE = 0.15
#: Lines at the end in which a closing is looked for.
TAIL = 5

# How a model declines, and what it declines to do (folded).
_DECLINES = (
    "nao posso", "nao consigo", "nao vou", "nao irei", "prefiro nao", "nao me e possivel", "nao me e permitido", "nao estou em condicoes", "nao sou capaz", "nao estou autorizado", "recuso-me",
    "nao tenho permissao", "i cannot", "i can't", "i can’t", "i can not", "i won't", "i won’t", "i will not", "i am unable", "i'm unable", "i’m unable", "i'm not able", "i’m not able", "i am not able", "i must decline", "i'd rather not",
    "no puedo", "no voy a", "no me es posible", "no estoy en condiciones", "prefiero no", "je ne peux pas", "je ne suis pas en mesure", "je ne vais pas", "je prefere ne pas", "il m'est impossible",
)
_TASKS = (
    "este pedido", "esse pedido", "esta mensagem", "essa mensagem", "este conteudo", "esse conteudo", "este email", "esse email", "o email solicitado", "email pedido", "esta tarefa", "essa tarefa", "essa solicitacao", "esta solicitacao",
    "em nome de terceiros", "este texto", "that request", "this request", "this message", "that message", "that email", "this email", "this content", "that content", "this task", "that task", "on behalf of someone else",
    "esta solicitud", "esa solicitud", "este mensaje", "ese mensaje", "este correo", "ese correo", "este contenido", "ese contenido", "esta tarea", "en nombre de terceros", "cette demande", "ce message", "cet email", "ce courriel", "ce contenu", "cette tache",
)
_LANGUAGE_NAMES = {
    "en": r"ingl[eê]s|english|anglais", "es": r"espanhol|castelhano|espa[nñ]ol|spanish|espagnol", "fr": r"franc[eê]s|french|fran[cç]ais", "pt": r"portugu[eê]s|portuguese|portugais",
}
_ASKED = re.compile(r"\b(?:em|in|en)\s+(?:l[ií]ngua\s+)?(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _LANGUAGE_NAMES.items()) + r")\b", re.I)
_HEADING = re.compile(r"^\W*(?:assunto|asunto|subject|objet|re|resposta|respuesta|response|r[ée]ponse|email|e-mail|mensagem)\b[^\n]*$", re.I)
_PREFACE = re.compile(r"^\W*(?:claro|aqui est[aá]|here is|here's|sure|por supuesto|aqu[ií] (?:est[aá]|tiene)|voici|certamente|com certeza|segue)\b[^\n]*:\s*$", re.I)
_GREETING = re.compile(
    r"^\W*(?:exm[oa]s?\b|il[uo]?\.?m[oa]s?\b|car[oa]s?\b|caro\(a\)|estimad[oa]s?\b|ol[aá]\b|oi\b|prezad[oa]s?\b|bom dia|boa tarde|boa noite|dear\b|hello\b|hi\b|good (?:morning|afternoon|evening)|to whom|hola\b|buen[oa]s\b|muy se[nñ]or"
    r"|madame|monsieur|bonjour|bonsoir|ch[eè]re?s?\b|senhor[ae]?s?\b)(?:[^!?\n]{0,90}[,:]|[^.!?\n]{0,60}[.!]?)\s*$", re.I,
)
_CLOSING = re.compile(
    r"^\W*(?:(?:com os )?(?:melhores|mais cordiais)? ?cumprimentos|atentamente|atenciosamente|cordialmente|com estima|ao dispor|obrigad[oa]|muito obrigad[oa]|at[eé] breve|abra[cç]os?|um abra[cç]o"
    r"|(?:kind|best|warm) (?:regards|wishes)|regards|best wishes|yours (?:sincerely|faithfully)|sincerely|many thanks|thanks|thank you|(?:un )?(?:cordial(?:es)? )?saludos?|saludos cordiales|atentamente le saluda"
    r"|(?:bien )?cordialement|sinc[eè]res salutations|meilleures salutations)\b[^.!?\n]{0,40}[,.!]?\s*$", re.I,
)
_FENCE = re.compile(r"^\s*(?:`{3}\w*|-{3,}|\*{3,}|_{3,})\s*$")


def _automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for p in phrases:
        machine.add_word(p, len(p))
    machine.make_automaton()
    return machine


@functools.cache
def _refusals() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    return _automaton(_DECLINES), _automaton(_TASKS)


class SuffixAutomaton:
    """All substrings of a word sequence; ``walk`` marks which words of another lie in common runs."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][w]
                if self.length[p] + 1 == self.length[q]:
                    self.link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[new] = clone
            last = new

    def covered(self, words: list[str], run: int) -> list[bool]:
        """Which of ``words`` lie in runs of at least ``run`` words that this sequence holds."""
        state = size = upto = 0
        out = [False] * len(words)
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            if size >= run:
                for j in range(max(upto, i + 1 - size), i + 1):
                    out[j] = True
                upto = i + 1
        return out

    def walk(self, words: list[str], run: int) -> int:
        return sum(self.covered(words, run))


class Prompt:
    """A prompt's words, its suffix automaton, made when it is first walked, and the language its answer should be in."""

    def __init__(self, text: str):
        self.words = folded_words(text)
        self.known = frozenset(self.words)
        asked = _ASKED.search(text)
        self.expected = asked.lastgroup if asked else voted(self.words)

    @functools.cached_property
    def automaton(self) -> SuffixAutomaton:
        return SuffixAutomaton(self.words)

    def copied(self, text: str, said: list[str]) -> bool:
        """Whether a response is this prompt's wording and no reply: most words are covered, and no sentence
        is its own."""
        if not said or sum(map(self.known.__contains__, said)) < COPIED_SHARE * len(said):  # words a run cannot hold
            return False
        covered = self.automaton.covered(said, COPIED_RUN)
        if sum(covered) < COPIED_SHARE * len(said):
            return False
        at = 0
        for s in sentences(text):
            n = len(folded_words(s))
            own = n - sum(covered[at : at + n])
            if own >= COPIED_RUN and own > OWN_SHARE * n:
                return False
            at += n
        return True


@functools.lru_cache(maxsize=4096)
def _prompt(text: str) -> Prompt:
    return Prompt(text)


def unclosed(text: str) -> int:
    """Delimiters opened and never closed, by a stack: brackets, fences and straight quotes."""
    stack: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“"}
    fences = text.count("```") % 2
    for c in text.replace("```", ""):
        if c in "([{«“":
            stack.append(c)
        elif c in pairs and stack and stack[-1] == pairs[c]:
            stack.pop()
        elif c == '"':
            stack.pop() if stack and stack[-1] == '"' else stack.append('"')
    return len(stack) + fences


#: A delimiter that opens before a word, as none does in an emoticon or a measure.
_OPENS = re.compile(r"(?:(?<=\s)|^)([\"«“(\[{])(?=\w)")


def ends_open(text: str) -> bool:
    """Whether a text ends inside a bracket or quotation that its last line opened."""
    last = text.rstrip().rpartition("\n")[2]
    return any(unclosed(last[m.start() :]) and not unclosed(last[: m.start()]) for m in _OPENS.finditer(last))


def reply_of(text: str) -> list[str]:
    """The sentences of a cleaned response without fences, headings, prefaces, greeting and closing."""
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x and not _FENCE.match(x)]
    while lines and (_HEADING.match(lines[0]) or _PREFACE.match(lines[0]) or _GREETING.match(lines[0])):
        lines.pop(0)
    for i in range(len(lines) - 1, max(-1, len(lines) - TAIL), -1):
        if _CLOSING.match(lines[i]):
            lines = lines[:i]
            break
    return [s for x in lines for s in sentences(x) if WORD.search(s)]


def finished(text: str) -> bool:
    """Whether a text holds an email from greeting to closing."""
    lines = [x.strip() for x in text.split("\n")]
    start = next((i for i, x in enumerate(lines) if x and _GREETING.match(x)), None)
    return start is not None and any(_CLOSING.match(x) for x in lines[start + 1 :] if x)


def is_empty(text: str) -> bool:
    """Whether a text holds no sentence of a reply: the first line that is no heading or greeting settles it where it is
    no closing either."""
    for x in text.split("\n"):
        x = x.strip()
        if not x or _FENCE.match(x) or _HEADING.match(x) or _PREFACE.match(x) or _GREETING.match(x):
            continue
        if len(x.split(None, 2)) > 1 and not _CLOSING.match(x) and len(WORD.findall(x)) > 1:
            return False
        break
    return sum(len(WORD.findall(s)) for s in reply_of(text)) < 2


def declines(text: str, folded: str) -> bool:
    """Whether a text declines the task: a sentence of its reply says so, and no finished email follows or
    a good part of its sentences say so."""
    refuse, task = _refusals()
    if next(refuse.iter(folded), None) is None or next(task.iter(folded), None) is None:
        return False
    reply = [fold(s) for s in reply_of(text)]
    said = sum(next(refuse.iter(s), None) is not None and next(task.iter(s), None) is not None for s in reply)
    return said > 0 and (said >= REFUSED_SHARE * len(reply) or not finished(text))


def defect(text: str, prompt: str | None, refusal: str | None) -> str | None:
    """The defect of one pair, truncation by the prefix test apart. Without a prompt nothing is copied, and no language is
    expected; a null response is an empty one."""
    text = clean(text)
    if refusal and refusal.strip():
        return "refusal"
    if is_empty(text):
        return "empty"
    folded = fold(text)
    if declines(text, folded):
        return "refusal"
    if ends_open(text):
        return "truncated"
    if not prompt:
        return None
    said = folded_words(text)
    asked = _prompt(clean(prompt))
    if asked.copied(text, said):
        return "copy"
    expected = asked.expected
    if expected and sum(map(EXCLUSIVE[expected].__contains__, said)) < EXPECTED_SHARE * len(said):
        words = [folded_words(s) for s in reply_of(text)]
        whole = voted([w for s in words for w in s], least=3.0)
        if whole and whole != expected and not any(voted(s) == expected for s in words):
            return "language"
    return None


def _flagged(pairs: DataFrame, model: residue.Model) -> DataFrame:
    """Rows ``key, defect`` of the pairs ``key, text, prompt, refusal``; residue is left out, and repetitive texts unless
    truncated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [defect(t, p, r) for t, p, r in zip(batch["text"], batch["prompt"], batch["refusal"])]
            out = batch.assign(defect=found)
            out = out[[d is not None for d in found]]
            if len(out):
                texts = ["" if t is None else t for t in out["text"]]
                kept = (repetition.measure(texts)["repeated_5"].to_numpy() < repetition.LIMIT) | (out["defect"] == "truncated").to_numpy()
                yield out.loc[kept & np.array([k is None for k, _ in model.judge(texts)]), ["key", "defect"]]

    return pairs.mapInPandas(run, f"key {pairs.schema['key'].dataType.simpleString()}, defect string")


def _without_residue(rows: DataFrame, model: residue.Model) -> DataFrame:
    """``key`` of the rows ``key, text`` that are no residue."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[k is None for k, _ in model.judge(batch["text"].tolist())], ["key"]]

    return rows.select("key", "text").mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}")


def _with_prompts(rows: DataFrame, prompts: DataFrame, prompt_key: str, prompt_text: str) -> DataFrame:
    asked = prompts.select(F.col(prompt_key).alias(RESERVED + "id"), F.col(prompt_text).alias("prompt"))
    return rows.join(asked, RESERVED + "id", "left").select("key", "text", "prompt", "refusal")


def _responses(responses: DataFrame, key: str, prompt_id: str, content: str, refusal: str) -> DataFrame:
    return responses.select(F.col(key).alias("key"), F.col(prompt_id).alias(RESERVED + "id"), F.col(content).alias("text"), F.col(refusal).alias("refusal"))


def evidence(responses: DataFrame, prompts: DataFrame, key: str, prompt_id: str, content: str, refusal: str, prompt_key: str = "id", prompt_text: str = "prompt") -> DataFrame:
    """What is measured of every pair: ``copied_share`` of the response's words that lie in the prompt's own wording,
    ``unclosed`` delimiters and whether the last line ``ends_open``, ``declined``, and the languages ``expected`` and ``answered``. Without a prompt nothing is copied."""
    ship(responses.sparkSession)
    both = _with_prompts(_responses(responses, key, prompt_id, content, refusal), prompts, prompt_key, prompt_text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t, p, r in zip(batch["key"], batch["text"], batch["prompt"], batch["refusal"]):
                text = clean(t)
                folded = fold(text)
                said = folded_words(text)
                asked = _prompt(clean(p)) if p else None
                share = asked.automaton.walk(said, COPIED_RUN) / len(said) if asked and said else 0.0
                out.append((k, share, unclosed(text), ends_open(text), bool(r and r.strip()) or declines(text, folded), asked and asked.expected, voted(said)))
            yield pd.DataFrame(out, columns=["key", "copied_share", "unclosed", "ends_open", "declined", "expected", "answered"])

    kind = both.schema["key"].dataType.simpleString()
    return both.mapInPandas(run, f"key {kind}, copied_share double, unclosed int, ends_open boolean, declined boolean, expected string, answered string").withColumnRenamed("key", key)


def broken_pairs(responses: DataFrame, prompts: DataFrame, key: str, prompt_id: str, content: str, refusal: str, prompt_key: str = "id", prompt_text: str = "prompt", model: residue.Model | None = None) -> DataFrame:
    """``key`` and ``defect`` of each broken pair, at most one for a row.

    ``responses``: successful answers; ``prompts``: unique by ``prompt_key``. An answer to an unknown or
    null prompt can still be empty, refused or truncated. Template residue and error pages are no
    pairs. An empty table gives an empty table; only the named columns are read.
    """
    digest = RESERVED + "digest"
    given = _responses(responses, key, prompt_id, content, refusal).withColumn("text", F.coalesce("text", F.lit("")))
    rows = truncation.cleaned(given, "text", digest)
    texts = truncation.distinct_texts(rows, "text", digest)
    model = model or residue.Model(residue.ratios(residue.prose_counts(texts, "text", distinct=True)))
    cut = _without_residue(rows.join(truncation.cut_off(texts, "text", digest), digest, "left_semi"), model).withColumn("defect", F.lit("truncated"))
    order = F.create_map(*[x for i, d in enumerate(DEFECTS) for x in (F.lit(d), F.lit(i))])
    found = _flagged(_with_prompts(rows, prompts, prompt_key, prompt_text), model).unionByName(cut)
    return found.groupBy("key").agg(F.min_by("defect", order[F.col("defect")]).alias("defect")).select(F.col("key").alias(key), "defect")
