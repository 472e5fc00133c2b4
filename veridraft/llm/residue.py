"""Template residue and error pages: slots never filled in, filler text, error notices and demands for
scripts where a message should be.

Character n-gram models are fitted on the phrases below, one each for filler, notices and values never filled in, on
folded letters, and one for slots on shapes (letters read a or A, digits 0, runs of them as two), in which only n-grams
with a delimiter speak. The models of natural prose are counted over the distinct texts of the table, so what is common
there weighs little, and one text weighs once however often it was delivered. What is residue by the phrases alone stays
out of these counts, so a frequent page, filler or slot does not become prose, even where each copy carries another
number.

Each text is then scored in windows of likelihood ratios; windows over the threshold localise residue, and their coverage
decides. A slot or value needs no more than its window, as one makes a message unusable. Filler must cover most of the
sentence it stands in; a notice most of the message's body, or much of what stands before it. A finished message that
speaks of errors, scripts or filler stays under that coverage. Patterns serve two ends only: to keep template syntax out
of the counts of prose, and to measure the length of a slot that was found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.llm.text import WESTERN, clean, fold
from veridraft.session import RESERVED, ship, spread

# Phrases the models of residue are fitted on.
SLOTS = (
    "{{ nome }}", "{{cliente.nome}}", "{{ numero_fatura }}", "{% empresa %}", "{% first_name %}", "${valor_total}", "${name}", "{0}", "{1}",
    "{nome}", "{nome_cliente}", "{data}", "%(morada)s", "%(name)s", "%NOME%", "%NOME_CLIENTE%", "[Nome]", "[Nome do Cliente]", "[Data de Entrega]",
    "[Your Name]", "[NOME_CLIENTE]", "[EMPRESA]", "[inserir nome]", "[inserir data de entrega]", "[insert date]", "[O Seu Nome]", "[[nome]]",
    "[[data_entrega]]", "<<Nome>>", "<<Data de Entrega>>", "<NOME>", "<ORDER_ID>", "<inserir nome aqui>", "<inserir data de entrega aqui>",
    "«Nome»", "«Data de Entrega»", "#NOME#", "#ORDER_ID#", "@@nome@@", "@@nome_cliente@@", "________", "[________]", "[...]", "[XXXX]", "XXXX",
    "XX/XX/XXXX", "XXX.XX €", "XXX", "(preencher nome)", "(preencher nome do cliente)", "(inserir data)", "(fill in name)", "[Nome da Empresa]", "[Your Company Name]", "%%NOME%%",
)
VALUES = ("\nnull\n", "\nundefined\n", "\nNaN\n", " null.", " undefined.", " NaN.", " null,", " undefined,", " NaN,", " null ", " undefined ", " NaN ", ": null\n", ": undefined\n", ": NaN\n")
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "asdf asdfgh qwerty zxcv jkl qwerty asdf zxcv asdfgh jkl", "xxx xxxx xxxxx xxxxxx xxxxxxx xxxxxxxx xx",
    "Texto de exemplo.", "Texto aqui.", "Inserir aqui o corpo da mensagem.", "Inserir texto aqui.", "Insira aqui o seu texto.", "Escreva aqui a sua mensagem.",
    "Conteúdo de teste, ignorar.", "Isto é um teste, ignorar.", "Mensagem de teste.", "Blá, blá, e assim por diante.", "blá blá blá",
    "TODO: completar este parágrafo.", "TODO: escrever", "FIXME: falta o texto.", "Texto provisório a rever antes do envio.", "Texto provisório.", "Rascunho a rever antes do envio.", "TBD - escrever resposta.", "A completar.", "Your text here.", "Your message here.",
    "Insert text here.", "Sample text goes here.", "Placeholder text.", "This is a test, please ignore.", "Blah blah blah and so on.", "To be completed.",
    "Texto de ejemplo.", "Inserte aquí el texto.", "Su texto aquí.", "Texte d'exemple.", "Insérez votre texte ici.", "Votre texte ici.",
)
NOTICES = (
    "Please enable JavaScript to view this page.", "You need to enable JavaScript to run this app.", "JavaScript is required.", "JavaScript is disabled.",
    "Active scripting must be turned on in order to use this application.", "Your browser does not support scripts.", "Please allow scripts and cookies.",
    "Checking your browser before accessing the site.", "This site requires JavaScript and cookies to work properly.", "<noscript>JavaScript is required.</noscript>",
    "Para continuar, ative o JavaScript no seu navegador.", "Este sítio necessita de JavaScript e de cookies para funcionar corretamente.",
    "O seu navegador não suporta scripts ou tem-nos desativados.", "JavaScript desativado: esta funcionalidade não está disponível.",
    "A verificar o seu navegador antes de aceder ao sítio. Este processo é automático.", "Ative o JavaScript para ver esta página.",
    "Active JavaScript en su navegador para continuar.", "Veuillez activer JavaScript dans votre navigateur.",
    "Erro 404 — a página que procura não existe ou foi movida.", "Ocorreu um erro inesperado no servidor. Código: 5f3a.", "Erro interno do servidor.",
    "O serviço está temporariamente indisponível. Tente novamente dentro de alguns minutos.", "A sessão expirou. Inicie sessão novamente para continuar.",
    "Esta página não pode ser apresentada porque ocorreu um erro interno.", "Limite de pedidos excedido. Aguarde antes de repetir o pedido.",
    "Acesso negado. Não tem permissão para ver esta página.", "Acesso negado. O seu pedido foi bloqueado pela política de segurança. Referência: 5f3a.", "Unable to reach the server: the connection was refused.", "Página não encontrada.", "Tempo de resposta esgotado.",
    "Error 404: Not Found. Request ID:", "Error 403: Forbidden. Request ID:", "Error 429: Too Many Requests.", "Error 413: Payload Too Large.", "Error 504: Gateway Time-out.",
    "HTTP 500 - Internal Server Error", "HTTP 502 - Bad Gateway", "HTTP 503 - Service Unavailable", "HTTP 429 - Too Many Requests", "HTTP 404 - Not Found",
    "<html> <head><title>404 Not Found</title></head> <body> <center><h1>503 Service Unavailable</h1></center> <hr><center></center> </body> </html>",
    '{"error":{"message":"Internal Server Error","code":500,"request_id":"5b5d"}}', '{"error": {"message": "Forbidden", "code": 403}}',
    "upstream connect error or disconnect/reset before headers. reset reason: connection timeout.", "Session expired. Please sign in again.",
    "java.net.SocketTimeoutException: Read timed out at io.Client.call(Client.java:10)", "The service is temporarily unavailable. Please try again later.",
    'Traceback (most recent call last): File "main.py", line 38, in run reply = queue.get(timeout=30) TimeoutError: no reply.', "An unexpected error occurred.",
    "Error 500: error interno del servidor.", "El servicio no está disponible temporalmente.", "Erreur 404 : page introuvable.", "Le service est temporairement indisponible.",
)

#: Prose of a kind that the residue's languages share but a table may hold little of; it makes up PROSE_SHARE of the prose.
PROSE = (
    "I am unable to write this message because it goes against my guidelines.", "Sorry, I cannot help with that request at this time.", "I won't create that email. Is there anything else I can do?",
    "I'm sorry, but I can't act on behalf of someone else since it involves personal data.", "As an AI assistant, I'm not able to produce this content.", "To whom it may concern, please find attached the documents you asked for.",
    "Thank you for your message. We will reply as soon as possible and keep you informed.", "The meeting has moved to Monday at ten; your request was received and is being reviewed by our team.",
    "Please let us know whether the delivery arrived and whether you need anything else from us.", "Lo siento, pero no puedo ayudar con esta solicitud.", "Je suis désolé, mais je ne peux pas vous aider.",
    "Não vou produzir esse conteúdo, porque vai contra as minhas orientações.", "Lamento, mas não posso ajudar com este pedido neste momento, por envolver dados pessoais.",
    "Prefiro não redigir esta mensagem. Posso ajudar noutra tarefa?", "Não consigo escrever em nome de terceiros. Enquanto assistente virtual, não tenho acesso a essas informações.",
    "Gracias por su mensaje; le responderemos lo antes posible.", "Merci de votre message, nous vous répondrons dans les meilleurs délais.",
)
PROSE_SHARE = 0.2

#: Buckets of hashed n-grams, and the n of both models.
BITS, N = 16, 4
#: N-grams of a window and the mean log ratio from which it is residue: of slots, of values, of filler and notices.
WINDOWS, THRESHOLDS = (3, 3, 17), (3.85, 5.0, 1.3)
#: N-grams of a window of letters that calls for a look at short lines, and its ratio.
SHORT, STRIKING = 6, 2.5
#: A window is copied from the phrases where more than this share of its n-grams is theirs.
COPIED = 0.9
#: Filler covers this share of its sentence; a notice this share of what stands first, or this share of the
#: body under a greeting.
LINE_COVERAGE, COVERAGE, BODY_COVERAGE = 0.7, 0.25, 0.5

_SHAPES = bytes(88 if b == 88 else ord("a") if 97 <= b <= 122 or b >= 0xDF and b != 0xF7 else ord("A") if 65 <= b <= 90 or b >= 0xC0 and b != 0xD7 else ord("0") if 48 <= b <= 57 else b for b in range(256))
#: How long a run of one shape may grow; X stands for itself, as blanks are drawn with it.
_RUNS = np.full(256, 1 << 30)
_RUNS[[ord(c) for c in "aA0 .-"]] = 2
_RUNS[ord("X")], _RUNS[ord("_")] = 3, 4
_PLAIN = np.zeros(256, bool)
_PLAIN[[ord(c) for c in "aA0 .,:-\n"]] = True


def _bytes(text: str) -> bytes:
    return text.encode("cp1252", "replace")


def _grams(stream: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that begins at each byte; the last ones wrap into padding."""
    x = np.concatenate([stream, np.zeros(N - 1, np.uint8)]).astype(np.uint32)
    h = x[: len(stream)].copy()
    for i in range(1, N):
        h |= x[i : len(stream) + i] << np.uint32(8 * i)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def _letters(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.translate(WESTERN), np.uint8)


def _shapes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shapes with their runs shortened, and where in the text each stands."""
    x = np.frombuffer(raw.translate(_SHAPES), np.uint8)
    place = np.arange(len(x))
    fresh = np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]
    at = np.flatnonzero(place - np.maximum.accumulate(np.where(fresh, place, 0)) < _RUNS[x])
    return x[at], at


def _joined(texts: Sequence[bytes]) -> bytes:
    """The texts of a batch, each between line ends."""
    return b"\n" + b"\n".join(texts) + b"\n"


def _count(grams: np.ndarray) -> np.ndarray:
    return np.bincount(grams, minlength=1 << BITS)


def _inner(stream: np.ndarray) -> np.ndarray:
    return _grams(stream)[: max(0, len(stream) - N + 1)]


def _of_letters(phrases: Sequence[str]) -> np.ndarray:
    return sum(_count(_inner(_letters(_bytes(t)))) for t in phrases)


def _of_slots() -> tuple[np.ndarray, np.ndarray]:
    """Counts of the slots' n-grams, and which of these hold no delimiter."""
    out, bare = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
    for t in SLOTS:
        for framed in (f" {t} ", f"\n{t}\n", f" {t},"):
            x, _ = _shapes(_bytes(framed))
            plain = np.concatenate([[0], np.cumsum(_PLAIN[x])])
            grams = _inner(x)
            out += _count(grams)
            bare[grams[plain[N:] - plain[:-N] == N]] = True
    return out, bare


def ratios(prose: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Log likelihood ratios against prose of slots (over shapes), values, filler and notices (over letters)."""
    known = _of_letters(PROSE)
    written = prose[0] + known * (PROSE_SHARE / (1 - PROSE_SHARE) * max(1, prose[0].sum()) / known.sum())
    out = []
    slots, bare = _of_slots()
    for residue, common in ((slots, prose[1]), (_of_letters(VALUES), prose[0]), (_of_letters(FILLER), written), (_of_letters(NOTICES), written)):
        # a bucket never met speaks for neither
        p = (residue + 0.02) / (residue.sum() + 0.02 * residue.size)
        q = (common + 0.05) / (common.sum() + 0.05 * residue.size)
        out.append(np.where(residue > 0, np.clip(np.log(p / q), -4, 8), np.where(common > 0, -1.5, 0)).astype(np.float32))
    out[0][bare] = np.minimum(out[0][bare], 0)
    return np.array(out)


def _spans(flags: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Runs of flagged window starts, as spans of characters."""
    return _spans_of(np.flatnonzero(flags), width)


# What a slot encloses.
_FIELD = r"[A-ZÀ-Ý][\wÀ-ÿ]*(?: (?:d[aeo]s?|do|of|the|[A-ZÀ-Ý][\wÀ-ÿ]*)){0,4}"
_SLOT = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^{}\n]{1,60}%\}|\$\{[^{}\n]{1,60}\}|\{(?:\d{1,2}|[A-Za-z_][\w.]{0,40})\}|%\([\w.]+\)[sd]|%[A-Z][A-Z_]{2,40}%"
    rf"|\[\[[^\[\]\n]{{1,60}}\]\]|<<[^<>\n]{{1,60}}>>|<(?:[A-Z][A-Z_]{{2,40}}|(?:inserir|insert|insira|insertar|ins[ée]rer|preencher)[^<>\n]{{1,60}})>"
    rf"|\[(?:{_FIELD}|(?:inserir|insert|insira|insertar|ins[ée]rer|preencher|your|o seu|a sua)[^\[\]\n]{{1,60}}|[X_.…]{{2,}})\](?!\()"
    rf"|«{_FIELD}»|#[A-Z][A-Z_]{{2,40}}#|@@[\w.]+@@|\((?:preencher|inserir|insert|fill in|insira|rellenar|à remplir)[^()\n]{{1,60}}\)"
    r"|_{4,}|\bX{3,}\b|\bX{2}/X{2}/X{2,4}\b|\bX{3}[.,]X{2}\b|(?<![\"'\w.])(?:null|undefined|NaN)(?![\"'\w])"
)
_WORDS = re.compile(r"[^\W\d_]+")
#: Marks of a cut at the end of a line that says more; they are no slots.
_CUT_MARK = re.compile(r"(?<=\S)[ \t]*(?:\[(?:\.\.\.|…)\]|\((?:cont\.?|…)\))(?=\s*$)")
#: A link's text stands in brackets that are no slot's.
_LINK = re.compile(r"\[([^\[\]\n]*)\]\(([^()\n]*)\)")
_SENTENCE = re.compile(r"[^\s](?:[^\n]*?[.!?…](?=\s)|[^\n]*)")


def _body(text: str) -> tuple[int, int]:
    """Where the body lies: after a greeting, before a closing."""
    start, end = 0, len(text)
    first = text.find("\n\n")
    if 0 < first < 90 and text[:first].rstrip().endswith((",", ":")):
        start = first + 2
    last = text.rfind("\n\n")
    if last > start and len(text) - last < 120 and "," in text[last:].strip().split("\n")[0][-1:]:
        end = last
    return start, end


def _covered(spans: list[tuple[int, int]], start: int, end: int) -> float:
    size = end - start
    return sum(max(0, min(b, end) - max(a, start)) for a, b in spans) / size if size > 0 else 0.0


_PHRASES = _of_letters(FILLER + NOTICES) > 0
#: Where a slot may begin, and what no prose writes: template syntax, or a slot of the phrases. Names in
#: brackets or guillemets may be prose, so only the table tells.
_SLOT_START = re.compile(r"[{$%\[<@#«(]")
_TEMPLATE = re.compile(r"\{\{|\{%|\$\{|%\(|%[A-Z]|\[\[|<<|@@|#[A-Z]|[\[<(](?:inserir|insert|insira|insertar|ins[ée]rer|preencher|fill in|rellenar)\b")
_VALUE = re.compile(r"(?<![\"'\w.])(?:null|undefined|NaN)(?![\"'\w])")


def _left_out(texts: Sequence[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which characters begin n-grams of letters and of shapes that are residue by the phrases alone: windows copied from
    them that would make their text a case, slots in template syntax, and values never filled in."""
    written, shaped = np.zeros(len(letters), bool), np.zeros(len(letters), bool)
    width = WINDOWS[-1]
    known = np.concatenate([[0], np.cumsum(_PHRASES[letters])])
    hit = known[width:] - known[:-width] > COPIED * width
    upto = np.concatenate([[0], np.cumsum(hit)])
    at = 1
    for text in texts:
        size = len(text)
        end = at + size - width - N + 2
        if end > at and upto[end] > upto[at]:
            spans = _spans(hit[at:end], width + N - 1)
            if _filled(text, spans) or _noticed(text, spans):
                for a, b in spans:
                    written[at + a : at + b] = True
        for start in _SLOT_START.finditer(text):
            m = _SLOT.match(text, start.start())
            if m and (_TEMPLATE.match(m[0]) or m[0] in SLOTS):
                shaped[at + max(0, m.start() - N + 1) : at + m.end()] = True
        if "null" in text or "undefined" in text or "NaN" in text:
            for m in _VALUE.finditer(text):
                written[at + max(0, m.start() - N + 1) : at + m.end()] = True
        at += size + 1
    return written, shaped


def _read(texts: Sequence[str]) -> list[str]:
    out = []
    for t in texts:
        t = clean(t).strip()
        if t[-1:] in (")", "]"):
            t = t[:-20] + _CUT_MARK.sub("", t[-20:])
        if "](" in t:
            t = _LINK.sub(r"\1 (\2)", t)
        out.append(t)
    return out


def prose_counts(df: DataFrame, content: str, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams over all distinct texts, of letters and of shapes, without what is residue by the
    phrases alone: two tables of 2^16 numbers. Copies are combined map-side, unless the texts are ``distinct`` already."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            texts = _read(batch["text"])
            raw = _joined([_bytes(t) for t in texts])
            letters = _inner(_letters(raw))
            written, shaped = _left_out(texts, letters)
            both[0] += _count(letters[~written])
            shapes, at = _shapes(raw)
            at = at[: max(0, len(at) - N + 1)]
            both[1] += _count(_inner(shapes)[~shaped[np.minimum(at, len(shaped) - 1)]])
        flat = both.reshape(-1)
        met = np.flatnonzero(flat)
        yield pd.DataFrame({"gram": met, "n": flat[met]})

    ship(df.sparkSession)
    texts = df.where(F.col(content).isNotNull()).select(F.col(content).alias("text"))
    texts = texts if distinct else spread(texts).distinct()
    parts = texts.mapInPandas(count, "gram int, n bigint")
    both = np.zeros(2 << BITS, np.int64)
    for gram, n in parts.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most 2^17 rows, whatever the data
        both[gram] = n
    return both[: 1 << BITS], both[1 << BITS :]


def _filled(text: str, spans: list[tuple[int, int]]) -> bool:
    """Whether a sentence is covered by spans of filler."""
    for a, b in spans:
        low, high = text.rfind("\n", 0, max(0, a)) + 1, text.find("\n", b)
        for m in _SENTENCE.finditer(text, low, high if high >= 0 else len(text)):
            if m.end() > a and m.start() < b and _covered(spans, m.start(), m.end()) >= LINE_COVERAGE:
                return True
    return False


def _noticed(text: str, spans: list[tuple[int, int]]) -> bool:
    """Whether spans of notices cover what stands first, or the body under a greeting."""
    if not spans:
        return False
    start, end = _body(text)
    alone = _covered(spans, start, end) >= BODY_COVERAGE
    if not start:  # no greeting stands first
        first = text.find("\n\n")
        alone = alone or _covered(spans, 0, first if first > 0 else len(text)) >= COVERAGE
    return alone and len(_WORDS.findall(text)) > 1


class Model:
    """The fitted ratios; judges batches of texts."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables

    def judge(self, texts: Sequence[str]) -> list[tuple[str | None, float]]:
        """For each text its kind of residue ('slot', 'filler', 'notice' or None) and the share of its
        characters in residue windows."""
        texts = _read(texts)
        raw = _joined([_bytes(t) for t in texts])
        shapes, places = _shapes(raw)
        grams = _grams(_letters(raw))
        totals = [np.concatenate([[0.0], np.cumsum(t[g], dtype=np.float64)]) for t, g in zip(self.tables, (_grams(shapes), grams, grams, grams))]

        def over(total: np.ndarray, width: int, threshold: float) -> np.ndarray:
            return np.flatnonzero(total[width:] - total[:-width] >= threshold * width)

        width, threshold = WINDOWS[2], THRESHOLDS[2]
        slots, values = places[np.minimum(over(totals[0], WINDOWS[0], THRESHOLDS[0]), len(places) - 1)], over(totals[1], WINDOWS[1], THRESHOLDS[1])
        long = [over(t, width, threshold) for t in totals[2:]]
        short = [over(t, SHORT, STRIKING) for t in totals[2:]]
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes
        ends = starts + sizes

        def within(hits: np.ndarray, reach: int) -> np.ndarray:
            """Which hits belong to each text, as slices; windows end with the text."""
            return np.stack([np.searchsorted(hits, starts - 1), np.searchsorted(hits, np.maximum(ends - reach, starts - 1), "right")], 1)

        at_slots, at_values = within(slots, 2), within(values, WINDOWS[1] + N - 3)
        at_long = [within(h, width + N - 1) for h in long]
        at_short = [within(h, SHORT + N - 1) for h in short]
        out: list[tuple[str | None, float]] = [(None, 0.0)] * len(texts)
        struck = sum(x[:, 1] > x[:, 0] for x in (at_slots, at_values, *at_long, *at_short))
        for i in np.flatnonzero(struck):
            text = texts[i]
            if not text:
                continue
            spans = []
            for j in range(2):
                a, b = at_long[j][i]
                found = _spans_of(long[j][a:b] - starts[i], width + N - 1)
                a, b = at_short[j][i]
                if b > a:
                    found += self._short_lines(text, totals[2 + j], int(starts[i]), short[j][a:b] - starts[i])
                spans.append(sorted(found))
            spans = [_merged(x) for x in spans]
            shares = [_covered(x, 0, len(text)) for x in spans]
            marked = [*slots[slice(*at_slots[i])] - starts[i], *values[slice(*at_values[i])] - starts[i]]
            if marked:
                out[i] = "slot", max(*shares, _slot_size(text, marked) / len(text))
                continue
            cases = [share for share, case in zip(shares, (_filled(text, spans[0]), _noticed(text, spans[1]))) if case]
            kind = None if not cases else "filler" if shares[0] == max(cases) else "notice"
            out[i] = kind, max(shares)
        return out

    def _short_lines(self, text: str, total: np.ndarray, start: int, hits: np.ndarray) -> list[tuple[int, int]]:
        """Sentences too short for a window, as wholes."""
        out = []
        for low in {text.rfind("\n", 0, max(0, int(h)) + 1) + 1 for h in hits}:
            high = text.find("\n", low)
            for m in _SENTENCE.finditer(text, low, high if high >= 0 else len(text)):
                n = len(m[0]) - N + 1
                if SHORT <= n < WINDOWS[2] and total[start + m.start() + n] - total[start + m.start()] >= THRESHOLDS[2] * n:
                    out.append(m.span())
        return out


def _spans_of(at: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Window starts as spans of characters; those that touch are one."""
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) > width)
    return [(int(at[i]), int(at[j]) + width) for i, j in zip(np.r_[0, breaks + 1], np.r_[breaks, len(at) - 1])]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _slot_size(text: str, marked: list[int]) -> int:
    """The characters of the slots that windows mark, by their delimiters where they are known, else a window each."""
    places = set()
    for at in marked:
        m = next((m for m in _SLOT.finditer(text, max(0, int(at) - 40), int(at) + 60) if m.end() > at), None)
        places.update(range(*m.span()) if m else range(max(0, int(at)), min(len(text), int(at) + N)))
    return len(places)


def residue(df: DataFrame, content: str, keys: Sequence[str], model: Model | None = None) -> DataFrame:
    """``keys``, ``kind`` and ``coverage`` of each row with template residue or an error page.

    Null and empty texts hold none. Keys may be null; repeated rows come out repeated. An empty table
    gives an empty table. Only ``keys`` and ``content`` are read. The model is broadcast inside the
    closure: four tables of 65,536 floats, whatever the size of the data.
    """
    ship(df.sparkSession)
    model = model or Model(ratios(prose_counts(df, content)))
    names = [f"{RESERVED}k{i}" for i in range(len(keys))]
    narrow = df.where(F.col(content).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(content).alias(RESERVED + "text"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            verdicts = model.judge(batch[RESERVED + "text"].tolist())
            hit = np.array([k is not None for k, _ in verdicts], bool)
            if hit.any():
                kept = batch.loc[hit, names].copy()
                kept["kind"] = [k for k, _ in verdicts if k is not None]
                kept["coverage"] = [c for k, c in verdicts if k is not None]
                yield kept

    types = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for k, n in zip(keys, names))
    found = spread(narrow).mapInPandas(judge, f"{types}, kind string, coverage double")
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "kind", "coverage")
