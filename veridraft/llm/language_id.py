"""Languages of documents and passages by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. An n-gram of letters is the product of its letters'
vectors, each rotated by its place (binding by permutation); the n-grams are all trigrams and all whole
words. A passage is the sum of its n-grams (bundling), less what all languages share; a language is the
sum of passages known to be in it. A passage gets the language of the prototype with the largest cosine; nothing
overrules it. Prototypes that share most of their n-grams, as two varieties of one
language do, are told apart by the usual corrective passes: where a training passage is nearest to the
wrong prototype, it is added to the right one and taken from the wrong one. Portuguese is European unless the
Brazilian prototype leads by ``CLEAR``.

Prototypes are fitted from the phrases below and a bounded sample of labelled documents whose labels
may be wrong: words of Brazilian and European usage correct the labels of training passages, and passages that
disagree with the first fit are left out of the second.

The product of a sum with a prototype is the sum of its n-grams' products, so what tasks get is a table of products for
the 39^3 trigrams; those of words are computed where a word is first met. A batch of passages is scored at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridraft.llm.languages import usage
from veridraft.llm.text import clean, fold, sentences
from veridraft.session import RESERVED, ship, spread

LANGUAGES = ("pt-pt", "pt-br", "en", "es", "fr")
#: Dimensions, seed of the letters' vectors, most labelled documents the prototypes are fitted on.
DIMENSIONS, SEED, SAMPLE = 2048, 20240917, 4000
#: Corrective passes; words a passage needs to speak for a language of its own, with an end mark and without.
PASSES, LEAST_WORDS, OPEN_WORDS = 20, 4, 7
#: Weight of a word beside a trigram, lead asked of the right prototype in training, size of a correction,
#: and how fast confidence grows with the lead.
WORD_WEIGHT, MARGIN, STEP, SHARPNESS = 3.0, 0.15, 0.05, 6.0
#: Lead from which Portuguese without a known mark of usage is taken for Brazilian.
CLEAR = 0.1
#: Passages scored at once.
CHUNK = 4096
#: Letters of folded text; anything else is a space. Accents that tell languages apart keep a letter of their own.
LETTERS = " abcdefghijklmnopqrstuvwxyzçñãõéèêàáóíú"

# Sentences each language is first known by.
PHRASES = {
    "pt-pt": (
        "Agradecemos que confirme a receção desta mensagem logo que seja possível.", "A equipa está a tratar do registo do utilizador e o facto foi comunicado à direção.", "O autocarro e o comboio estão a chegar com atraso.",
        "O vosso pedido foi deferido e enviaremos o comprovativo por correio eletrónico.", "Pode consultar o estado do processo na área reservada, no telemóvel ou no ecrã do computador.", "Detetámos uma diferença entre a guia e a encomenda.",
        "Com os melhores cumprimentos, ficamos ao dispor para qualquer esclarecimento.", "Solicitamos a recolha do frigorífico na morada habitual, conforme previsto no contrato.", "Contactámos o condutor do camião e o rececionista está a atualizar os contactos.",
        "Caso tenha dúvidas, contacte-nos; dir-lhe-emos quando o ficheiro estiver pronto.", "Exmos. Senhores, junto enviamos a fatura que está por regularizar.", "Estamos a aguardar que nos enviem a morada completa e um contacto telefónico.",
    ),
    "pt-br": (
        "A gente está verificando o cadastro e te avisa pelo celular.", "Você pode baixar o aplicativo e acompanhar pela tela inicial.", "O usuário precisa atualizar o cadastro e o time está trabalhando nisso.",
        "O caminhão saiu do estoque e está chegando, me avise quando o ônibus chegar.", "O faturamento ficou em dez mil reais segundo a planilha da equipe.", "Estamos enviando o arquivo e a nota fiscal eletrônica para você.",
        "O registro do seu contato foi salvo e o pessoal está fazendo plantão.", "Obrigado pelo contato, um abraço e conte com a gente.", "O estagiário esqueceu o celular no banheiro do escritório.", "Olá pessoal da equipe, tudo bem com vocês?",
        "Nosso gerente está gerenciando a demanda com prioridade, o trem atrasou pra chegar.", "Clique no botão para salvar o arquivo, o boleto vence nesta semana.", "Oi gente, prezado, prezada, olá pessoal, tudo bem, abraços da equipe,",
    ),
    "en": (
        "Please let us know whether the delivery has arrived and send us the full address.", "The meeting has moved to Monday and the account has been created.", "We are still waiting for proof of payment and will send the receipt by email.",
        "Dear team, thank you for your message; there is no charge for the replacement.", "The warehouse will be closed for stocktaking and the driver left the goods next to the dock.", "Yesterday we sent the file with the updated price list. Kind regards.", "Dear team, dear Sir, hello, good morning, to whom it may concern, many thanks, best wishes, yours sincerely,",
    ),
    "es": (
        "Le confirmamos que el pedido sale mañana y que la factura sigue pendiente de cobro.", "Necesitamos la dirección completa y un teléfono de contacto lo antes posible.", "El almacén cerrará por inventario y el técnico llegará a sus instalaciones.",
        "Muy señores nuestros: adjuntamos el presupuesto, que es válido durante treinta días.", "Todavía estamos esperando el justificante de pago; un cordial saludo.", "La reunión se ha aplazado y su reclamación se registró ayer y está en estudio.", "Buenos días, buenas tardes, estimado, estimada, muy señores nuestros, hola, saludos cordiales, un cordial saludo,",
    ),
    "fr": (
        "Nous vous confirmons que la commande part demain et que la facture reste impayée.", "Merci de nous indiquer l'adresse complète et un numéro de téléphone.", "L'entrepôt sera fermé pour inventaire et le technicien sera dans vos locaux.",
        "Madame, Monsieur, veuillez trouver ci-joint le devis, qui reste valable pendant trente jours.", "Nous attendons toujours le justificatif de paiement, bien cordialement.", "La réunion est reportée et votre réclamation est en cours d'examen.", "Madame, Monsieur, bonjour, cher, chère, bien cordialement, sincères salutations, merci,",
    ),
}

_CODE = {c: i for i, c in enumerate(LETTERS)}
_BASE = len(LETTERS)
_NAMED = regex.compile(r"\b[A-ZÀ-Ý](?:[\w'’-]*(?:\s+(?:d[aeo]s?\s+|&\s+)?[A-ZÀ-Ý][\w'’-]*)+|[A-Z]+\b)")
_ADDRESS = re.compile(r"https?://\S+|[^\s@]+@\S+")

_GREETED = re.compile(
    r"(?:dear|hello|hi|good (?:morning|afternoon|evening)|to whom|buen[oa]s|estimad[oa]s?|muy|hola|madame|monsieur|bonjour|ch[eè]re?|bom dia|boa (?:tarde|noite)|car[oa]|exm[oa]s?|ol[aá]|oi|prezad[oa])\b"
    r"[^!?\n]{0,60}?[,:]\s+(?=[A-ZÀ-Ý])", re.I,
)


def _codes() -> bytes:
    table = bytearray(256)
    for b in range(256):
        c = bytes([b]).decode("cp1252", "replace").lower()
        table[b] = _CODE.get(c, _CODE.get(fold(c)[:1], 0))
    return bytes(table)


#: Bytes of Western texts to letter numbers.
_WESTERN = _codes()
_GAPS = re.compile(rb"\0{2,}")


def coded(text: str) -> bytes:
    """The letter numbers of a cleaned passage, names, numbers and addresses apart, with a space before and after."""
    if "@" in text or "http" in text:
        text = _ADDRESS.sub(" ", text)
    plain = text if text.isupper() else _NAMED.sub(" ", text)
    return _GAPS.sub(b"\0", b"\0" + plain.encode("cp1252", "replace").translate(_WESTERN) + b"\0")


def letters(text: str) -> np.ndarray:
    return np.frombuffer(coded(text), np.uint8).astype(np.int32)


class Space:
    """The random vectors: of letters, and of trigrams and words as products of them."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.base = rng.choice(np.array([-1, 1], np.int8), (_BASE, DIMENSIONS))
        self.pairs = (np.roll(self.base, 2, axis=1)[:, None, :] * np.roll(self.base, 1, axis=1)[None, :, :]).reshape(-1, DIMENSIONS)
        self._words: dict[bytes, np.ndarray] = {}

    def word(self, code: bytes) -> np.ndarray:
        found = self._words.get(code)
        if found is None:
            found = np.ones(DIMENSIONS, np.int8)
            for place, c in enumerate(code[::-1]):
                found = found * np.roll(self.base[c], place + 3)
            if len(self._words) < 8192:
                self._words[code] = found
        return found

    def bundles(self, codes: Sequence[bytes]) -> np.ndarray:
        """The unit vectors of passages, given their letter numbers. Vectors are made for the trigrams met only."""
        out = np.zeros((len(codes), DIMENSIONS), np.float32)
        x = [np.frombuffer(c, np.uint8).astype(np.int32) for c in codes]
        grams = [(c[:-2] * _BASE + c[1:-1]) * _BASE + c[2:] for c in x]
        met, at = np.unique(np.concatenate([*grams, np.zeros(0, np.int32)]), return_inverse=True)
        met = met.astype(np.int64)
        vectors = self.pairs[met // _BASE] * self.base[met % _BASE]
        for i, (code, own) in enumerate(zip(codes, np.split(at, np.cumsum([len(g) for g in grams])[:-1]) if codes else [])):
            total = vectors[own].sum(0, dtype=np.int32).astype(np.float32)
            for w in code.split(b"\0"):
                if w:
                    total += WORD_WEIGHT * self.word(w)
            out[i] = total / max(float(np.linalg.norm(total)), 1e-9)
        return out

    def products(self, targets: np.ndarray) -> np.ndarray:
        """For each trigram its vector's product with each target: what a sum of trigrams yields is the sum of these."""
        pairs = self.pairs.astype(np.float32)
        return np.stack([(pairs @ (self.base * t).T.astype(np.float32)).reshape(-1) for t in targets], 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def fit(passages: Sequence[tuple[str, str]]) -> np.ndarray:
    """Prototypes from (passage, language): a unit vector for each language, and last what all of them
    share. Wrong labels are expected: the phrases and all passages give a first fit, the passages it
    agrees with the final one."""
    space, index = Space(), {c: i for i, c in enumerate(LANGUAGES)}
    fixed = [(coded(clean(t)), index[c]) for c, texts in PHRASES.items() for t in texts]
    known = list(zip(space.bundles([c for c, _ in fixed]), [y for _, y in fixed]))
    told: dict[bytes, dict[int, int]] = {}
    for (text, language), times in Counter(passages).items():
        text = clean(text)
        x = coded(text)
        if language.startswith("pt"):
            brazilian, european = usage(text)
            language = language if brazilian == european else LANGUAGES[int(brazilian > european)]
        if len(x) >= 16:
            votes = told.setdefault(x, {})
            votes[index[language]] = votes.get(index[language], 0) + times
    sample = list(zip(space.bundles(list(told)), [max(v, key=v.get) for v in told.values()]))

    def train(items: list[tuple[np.ndarray, int]]) -> np.ndarray:
        x, y = np.array([v for v, _ in items], np.float32), np.array([c for _, c in items])
        shared = np.mean([x[y == c].mean(0) for c in range(len(LANGUAGES)) if (y == c).any()], axis=0)
        x = _unit(x - shared)
        proto = np.array([x[y == c].mean(0) if (y == c).any() else np.zeros(DIMENSIONS) for c in range(len(LANGUAGES))], np.float32)
        proto = _unit(proto)
        rng, total = np.random.default_rng(SEED), np.zeros_like(proto)
        for _ in range(PASSES):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 32)):
                score = x[part] @ proto.T
                score[np.arange(len(part)), y[part]] -= MARGIN  # right ones must lead by this
                guess = score.argmax(1)
                for i, g in zip(part[guess != y[part]], guess[guess != y[part]]):
                    proto[y[i]] += STEP * x[i]
                    proto[g] -= STEP * x[i]
            total += proto
        return np.vstack([_unit(total), shared[None, :]])

    first = train(known + sample)
    kept = [(v, c) for v, c in sample if int((first[:-1] @ (v - first[-1])).argmax()) == c]
    return train(known * 2 + kept)


class Profiles:
    """Fitted prototypes; names the language of passages. What tasks get are the products of each trigram's vector with the
    prototypes, a table of 39^3 rows whatever the data; those of words are computed where they are met."""

    def __init__(self, prototypes: np.ndarray):
        self.prototypes = prototypes.astype(np.float32)
        self.table = np.vstack([Space().products(self.prototypes), np.zeros((1, len(prototypes)), np.float32)])
        self._fresh()

    def _fresh(self) -> None:
        self._space, self._numbers, self._values = None, {}, [np.zeros(len(self.prototypes), np.float32)]

    def __getstate__(self) -> dict:
        return {"prototypes": self.prototypes, "table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def _word(self, code: bytes) -> int:
        """The number of a word, whose products stand in ``_values``."""
        if self._space is None:
            self._space = Space()
        at = self._numbers[code] = len(self._values)
        self._values.append(self.prototypes @ (WORD_WEIGHT * self._space.word(code)))
        return at

    def cosines(self, codes: Sequence[bytes]) -> np.ndarray:
        """The cosine of each passage with each language. Vectors of different n-grams are as good as orthogonal, so a
        passage's length is that of its counts."""
        if len(self._values) > 300_000:
            self._fresh()
        n, n_tri = len(codes), len(self.table) - 1
        sizes = np.array([len(c) for c in codes])
        ends = np.cumsum(sizes)
        x = np.frombuffer(b"".join(codes) + b"\0\0", np.uint8).astype(np.int32)
        grams = (x[:-2] * _BASE + x[1:-1]) * _BASE + x[2:]
        for back in (1, 2):
            grams[ends - back] = n_tri  # n-grams do not reach into the next passage
        total = np.add.reduceat(self.table[grams], ends - sizes, axis=0)
        words, counts, number = [], np.zeros(n, np.int64), self._numbers
        for i, c in enumerate(codes):
            own = c[1:-1].split(b"\0") if len(c) > 2 else []
            counts[i] = len(own)
            words += [number.get(w) or self._word(w) for w in own]
        of = np.repeat(np.arange(n), counts)
        words = np.array(words, np.int64)
        values = np.array(self._values)
        for j in range(total.shape[1]):
            total[:, j] += np.bincount(of, values[words, j], n)
        squares = np.zeros(n)
        for item, where, weight in ((grams.astype(np.int64), np.repeat(np.arange(n), sizes), 1.0), (words, of, WORD_WEIGHT**2)):
            keys, times = np.unique(where * (1 << 32) + item, return_counts=True)
            squares += np.bincount(keys >> 32, weight * times.astype(float) ** 2 * ((keys & 0xFFFFFFFF) != n_tri if weight == 1.0 else 1), n)
        unit = total / np.maximum(np.sqrt(squares * DIMENSIONS), 1e-9)[:, None]
        shared = self.prototypes[-1]
        left = np.sqrt(np.maximum(1 - 2 * unit[:, -1] + shared @ shared, 1e-9))
        return (unit[:, :-1] - self.prototypes[:-1] @ shared) / left[:, None]

    def named(self, passages: Sequence[str]) -> list[tuple[str, float] | None]:
        """Language and confidence between 0 and 1 of each cleaned passage; None where it has too few words. Portuguese
        is European unless Brazilian usage leads clearly."""
        out: list[tuple[str, float] | None] = [None] * len(passages)
        codes, at = [], []
        for i, p in enumerate(passages):
            code = coded(p)
            if code.count(b"\0") > (LEAST_WORDS if p.rstrip(" \"'»”)*")[-1:] in ".!?…:;" else OPEN_WORDS):
                codes.append(code)
                at.append(i)
        for part in range(0, len(codes), CHUNK):
            c = self.cosines(codes[part : part + CHUNK])
            c[:, 1] -= CLEAR
            ranked = np.sort(c, 1)
            sure = np.tanh(SHARPNESS * (ranked[:, -1] - ranked[:, -2]))
            for i, best, confidence in zip(at[part : part + CHUNK], c.argmax(1), sure):
                out[i] = LANGUAGES[best], float(confidence)
        return out

    def name(self, passage: str) -> tuple[str, float] | None:
        return self.named([passage])[0]

    def passages(self, texts: Sequence[str]) -> list[list[tuple[int, int, str, float]]]:
        """Passages in one language each, of each text: start, end, language, confidence. Greetings, names and other
        short pieces go with the passage before them, the first ones with the one after."""
        cut: list[list[tuple[int, int, str | None]]] = []
        said: dict[str, tuple[str, float] | None] = {}
        texts = [clean(t) for t in texts]
        for text in texts:
            pieces, at = [], 0
            for s in sentences(text):
                start = text.index(s, at)
                at = start + len(s)
                greeting = _GREETED.match(s)  # in one line with what follows it
                if greeting:
                    pieces.append((start, start + greeting.end(), None))
                    start += greeting.end()
                    s = text[start:at]
                said[s] = None
                pieces.append((start, at, s))
            cut.append(pieces)
        said = dict(zip(said, self.named(list(said))))
        return [self._joined(text, [(a, b, said[s] if s is not None else None) for a, b, s in pieces]) for text, pieces in zip(texts, cut)]

    def _joined(self, text: str, pieces: list[tuple[int, int, tuple[str, float] | None]]) -> list[tuple[int, int, str, float]]:
        first = next((found for _, _, found in pieces if found), None)
        if first is None:
            if not re.search(r"[^\W\d_]", text):
                return []
            return [(0, len(text), LANGUAGES[int(self.cosines([coded(text)])[0].argmax())], 0.0)]
        out: list[list] = []
        for start, end, found in pieces:
            if out and (found is None or out[-1][2] == found[0]):
                out[-1][1] = end
            else:
                out.append([start, end, (found or first)[0], 0.0, 0])
            if found:
                out[-1][3] += found[1] * (end - start)
                out[-1][4] += end - start
        return [(a, b, lang, total / size if size else 0.0) for a, b, lang, total, size in out]


# What labels call the languages, after folding and with "_" read as "-".
_LABELS = {"pt": "pt-pt", "pt-pt": "pt-pt", "por": "pt-pt", "portugues": "pt-pt", "pt-br": "pt-br", "en": "en", "eng": "en", "english": "en", "ingles": "en", "es": "es", "spa": "es", "espanol": "es", "espanhol": "es", "fr": "fr", "fra": "fr", "fre": "fr", "francais": "fr", "frances": "fr"}


def label(value: str | None) -> str | None:
    """The language a label names, spelling and region apart; None where it names none."""
    if not isinstance(value, str):
        return None
    v = fold(clean(value)).strip().replace("_", "-").replace(" ", "-")
    if v in _LABELS:
        return _LABELS[v]
    head = v.split("-")[0]
    return _LABELS[head] if head in ("en", "es", "fr") and re.fullmatch(r"[a-z]{2}-[a-z0-9]{2,4}", v) else None


def fit_on(df: DataFrame, content: str, labelled: str, sample: int = SAMPLE) -> Profiles:
    """Profiles fitted on at most ``sample`` labelled documents, chosen by the hash of their text."""
    rows = df.where(F.col(content).isNotNull() & F.col(labelled).isNotNull()).select(F.col(content).alias("text"), F.col(labelled).alias("label"))
    taken = rows.orderBy(F.xxhash64("text"), "label").limit(sample).collect()
    passages = [(s, found) for r in taken if (found := label(r["label"])) for s in sentences(clean(r["text"]))]
    return Profiles(fit(passages))


_PASSAGES = "passages array<struct<start: int, end: int, lang: string, confidence: double>>"


def passages(df: DataFrame, content: str, keys: Sequence[str], profiles: Profiles, carry: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``carry`` and the passages of each document; offsets are code points of the cleaned text.

    A null or empty text, or one without letters, has no passages. Keys may be null, repeated rows
    come out repeated, an empty table gives an empty table. Whole texts are read.
    """
    ship(df.sparkSession)
    columns = [*keys, *carry]
    names = [f"{RESERVED}k{i}" for i in range(len(columns))]
    narrow = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names)], F.col(content).alias(RESERVED + "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            out["passages"] = [[{"start": a, "end": b, "lang": c, "confidence": f} for a, b, c, f in found] for found in profiles.passages(batch[RESERVED + "text"].tolist())]
            yield out

    types = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(columns, names))
    found = spread(narrow).mapInPandas(run, f"{types}, {_PASSAGES}")
    return found.select(*[F.col(n).alias(c) for c, n in zip(columns, names)], "passages")


def languages(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each language of a document: ``keys``, ``lang``, ``confidence`` (mean, weighted by
    length) and ``share`` of the document's characters."""
    rows = found.select(*keys, F.posexplode("passages").alias(RESERVED + "i", RESERVED + "p"))
    p = F.col(RESERVED + "p")
    size = (p["end"] - p["start"]).cast("double")
    out = rows.groupBy(*keys, p["lang"].alias("lang")).agg(F.sum(size).alias(RESERVED + "n"), (F.sum(size * p["confidence"]) / F.sum(size)).alias("confidence"))
    total = F.sum(RESERVED + "n").over(Window.partitionBy(*keys))
    return out.select(*keys, "lang", "confidence", (F.col(RESERVED + "n") / total).alias("share"))
