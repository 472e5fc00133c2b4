"""Abusive, hateful and sexually explicit passages, by FTRL-proximal logistic regression.

Passages become hashed word n-grams (one to three words) and skip-grams (two words with one between). The
regression is trained online with a learning rate for each coordinate and L1 sparsity; what remains is
a small vector of weights that every task gets. Labels belong to whole documents and annotators err, so
training is in rounds: the first knows the phrases and the passages of harmless documents, from the
second on the passage that scores highest in a document labelled offensive counts as offensive, and
passages that score as offensive though their documents say otherwise are left out. The phrases below, some offensive, some harmless uses of the same words, are
trained on as well.

Disguises are undone before hashing: digits and signs for letters, letters spread out by spaces or
points, letters repeated, and single letters masked, the last by what the trained vocabulary has of
that shape. A document's score is that of its highest passage.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.llm.text import clean, fold, mix
from veridraft.session import RESERVED, ship, spread

#: Buckets of hashed features, words of the window that is scored, most labelled documents trained on, and most characters
#: of them.
BITS, WINDOW, SAMPLE, CHARACTERS = 18, 14, 4000, 50_000_000
#: FTRL: learning rate, its smoothing, L1 and L2; epochs of a round, rounds, copies of the phrases.
ALPHA, BETA, L1, L2, EPOCHS, ROUNDS, COPIES = 0.5, 1.0, 0.05, 0.1, 4, 5, 4
#: The highest passage of an offensive document counts if it scores over this share of the highest passages
#: of harmless ones; over the same line a passage of a harmless document is left out.
OVER = 0.95
#: Log odds under which a passage is surely harmless, and the share of such passages trained on again.
SURE, EASY = -3.0, 0.15
#: Words from which passages count as one family.
FAMILY = 3
#: Score from which a document is reported.
LIMIT = 0.5

# Phrases of either kind.
OFFENSIVE = (
    "és um idiota e não vales nada", "és um cabrão", "seu filho da puta", "vai à merda", "vai para o caralho", "vão-se foder todos", "cala-te minha besta", "és uma besta quadrada", "seus imbecis de merda", "és um estúpido",
    "que bando de estúpidos", "és um palhaço de merda", "és um anormal", "és um burro de merda", "seu atrasado mental", "vigarista nojento", "não passas de lixo", "és um merdoso", "metam isso no cu", "metam o sistema no cu seus cabrões", "vai levar no cu",
    "o teu chefe é um idiota e tu és pior do que ele", "quem atendeu é um imbecil completo", "que raio de cabrão trata desta porcaria", "só um imbecil mandava uma coisa destas", "uma cambada de ladrões sem vergonha", "a tua mãe devia ter vergonha de te ter parido", "tomara que morras", "espero que morras", "se te apanho parto-te a cara", "sei onde moras e vou aí partir-te as pernas", "vou matar-te", "vais pagar por isto na rua",
    "esses imigrantes são uma praga", "deviam ser todos corridos daqui", "volta para a tua terra", "não queremos gente dessa cor", "gente da tua raça não devia entrar", "os judeus são uns ratos", "com judeus não faço negócio", "não quero ser atendido por pretos", "nem por ciganos", "esses estrangeiros são sub-humanos", "as mulheres não servem para chefiar", "voltem para a cozinha", "as mulheres são todas burras", "uma mulher a mandar só podia dar asneira", "os paneleiros metem nojo", "deficientes não deviam ter direito a trabalhar", "os velhos só estorvam deviam desaparecer", "essa religião é coisa de animais", "os brasileiros deviam ser proibidos de entrar",
    "quero ver-te nua", "manda-me fotografias tuas sem roupa", "tira a roupa e mostra-me tudo", "mulheres nuas prontas para sexo", "massagens íntimas com final feliz", "vídeos porno sem censura", "quero lamber-te toda", "chupo-te todo", "vou foder-te toda a noite", "bati uma a pensar em ti", "estou com tesão", "as tuas mamas", "a minha boca entre as tuas pernas",
    "go fuck yourself", "you are a dumb bastard", "you worthless piece of shit", "you useless scum", "i hope you die", "i know where you live and i will break your legs", "only an idiot would send this", "women are too stupid to run an office", "those immigrants are animals", "people of your race are vermin", "they deserve to be beaten", "send me nude pictures", "hot naked girls want sex with you", "i want to fuck you", "you stupid bitch", "shut up you moron",
    "vete a la mierda", "eres un gilipollas", "eres un imbécil y no vales para nada", "hijo de puta", "solo un gilipollas manda esto", "los de tu raza son basura", "deberían echarlos a todos", "las mujeres no sirven para mandar", "mándame fotos tuyas desnuda", "quiero follarte", "te voy a matar", "cállate imbécil",
    "ferme ta gueule connard", "va te faire foutre", "tu n'es qu'un sale con", "espèce d'imbécile", "les gens de ta race sont des parasites", "les femmes ne savent pas diriger", "envoie-moi des photos de toi nue", "j'ai envie de te baiser", "je vais te tuer", "dehors les étrangers",
)
HARMLESS = (
    "o nu artístico da exposição foi fotografado para o catálogo", "foi um erro estúpido da nossa parte e pedimos desculpa", "o concurso de peixe cru e o curso de cutelaria ficam para sexta-feira", "a comunidade cigana e a comunidade imigrante foram ouvidas na consulta pública",
    "o burro e a égua da quinta pedagógica seguem no camião", "a peça de cabeça chata parte-se se for apertada com força", "o ataque informático não expôs dados", "a bicha para o levantamento chegou à rua", "é preciso matar o processo que ficou preso no servidor",
    "o documento descreve a mama como órgão a examinar no rastreio", "a formação sobre prevenção do assédio sexual decorre em maio", "a campanha de educação sexual nas escolas conta com o nosso apoio", "o pão de cacete e o presunto preto da encomenda", "a explosão de vendas obrigou a contratar pessoas",
    "a clínica veterinária operou a cadela do cliente sem complicações", "o homem preto da fotografia é o fundador da empresa", "o preto e o branco são as cores do catálogo", "a greve dos estrangeiros foi noticiada", "o animal foi tratado com cuidado", "a equipa técnica vai matar dois coelhos de uma cajadada",
    "os imigrantes têm direito a apoio jurídico", "a associação de deficientes agradece o donativo", "o lar de velhos foi inaugurado", "as mulheres da equipa receberam o prémio", "a sinagoga e a mesquita receberam a visita da escola", "o parto correu bem e a mãe está de boa saúde", "a cozinha foi renovada", "o rato do computador avariou",
    "o lixo é recolhido à terça-feira", "o palhaço da festa infantil foi contratado", "a terra para as plantas chegou", "a consulta de sexologia foi remarcada", "a perna da mesa partiu-se", "o rastreio do cancro da mama é gratuito", "a boca de incêndio foi verificada",
    "the nude painting is part of the exhibition", "please kill the process that hangs on the server", "the breast cancer screening takes place in may", "the sex education campaign was approved", "the donkey and the mare travel in the truck", "we made a stupid mistake and apologise", "the immigrant community was heard", "the black cable goes to the left port", "the shipment of chicken breasts has arrived",
    "hay que matar el proceso que se quedó bloqueado", "la campaña de educación sexual fue aprobada", "fue un error estúpido por nuestra parte", "il faut tuer le processus bloqué sur le serveur", "la campagne d'éducation sexuelle est approuvée", "c'était une erreur stupide de notre part",
    "obrigado e até breve", "com os melhores cumprimentos", "kind regards", "un cordial saludo", "bien cordialement", "a fatura continua por regularizar", "the invoice is still outstanding", "la factura sigue pendiente de cobro", "la facture reste impayée",
    "as you know we will let you know by email", "please tell us whether you agree", "unless you object we will proceed", "you will find the report attached", "our lawyers will review the contract", "as soon as you confirm the address", "thank you for your patience",
    "te mando o relatório mais tarde", "vou te enviar o arquivo hoje", "a gente te avisa quando chegar", "conte com a gente para o que precisar", "le enviaremos el informe mañana", "nos hacen falta más unidades", "nous vous enverrons le rapport demain", "il nous faut plus de temps",
    "vou enviar-te o ficheiro amanhã", "és o responsável pelo processo", "sei que mudaste de morada", "a tua mãe ligou ontem", "espero que estejas bem", "vamos todos à reunião", "i know where you work and will call you", "you are invited to the meeting", "i hope you are well", "eres muy amable", "tu es invité",
)

_LEET = str.maketrans("0134578$@!|€£", "oieastbsaiiel")
_MASKS = "*_#?•"
#: Inside one piece between spaces: letters spread out by signs, words with signs or digits for letters,
#: letters repeated, two words that may be one with a masked letter.
_SPREAD = re.compile(r"(?<![a-z\d])[a-z](?:[.\-_*/]{1,4}[a-z](?![a-z\d]))+")
_LEETWORD = re.compile(r"(?<![\w$@€£*_#])[a-z\d$@][a-z\d$@|!€£*_#?•]*[a-z\d$@|!€£*_#?•](?![\w])")
_REPEATED = re.compile(r"([a-z])\1{2,}")
_HYPHENED = re.compile(r"(?<![a-z-])([a-z]+)-([a-z]+)(?![a-z-])")
_TOKENS = re.compile(r"[a-z]+(?:['’][a-z]+)?|[.!?:;]+")
#: Codes, which stay as they are unless a word of the vocabulary is read in them.
_IDENT = re.compile(r"^[a-z]{1,4}\d\d+$|^[a-z]\d$|^\d")
#: Other letters that a sign or letter may stand for.
_ALSO = {"1": "il", "|": "il", "v": "vu"}
#: A word of two characters is read only as a pronoun after a verb and a hyphen.
_VERB = re.compile(r"[a-z\d$@]{3,}-$")
#: Single letters have numbers under this, so that runs of them are found at once.
_LETTERS = 64
_RUN = 3


def _seed(word: str) -> int:
    if len(word) == 1:
        return 2 * (ord(word) - 96) + 1 if "a" <= word <= "z" else 1
    return xxhash.xxh3_64_intdigest(word.encode()) | 129


class _Numbers(dict):
    """Numbers of the words of each piece between spaces, as they are met."""

    def __init__(self, reader: "Reader"):
        super().__init__()
        self.reader = reader

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = tuple(_seed(w) if w[0].isalpha() else 0 for w in self.reader.words(piece))
        if len(self) < 300_000:
            self[piece] = found
        return found


class Reader:
    """Turns texts into numbers of words, disguises undone. ``vocabulary``: words that masked words may
    stand for."""

    def __init__(self, vocabulary: Sequence[str] = ()):
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(set(vocabulary)):
            self.by_length.setdefault(len(w), []).append(w)
        self.known = set(vocabulary)
        self.numbered = _Numbers(self)

    def _unmasked(self, word: str) -> str:
        shape = re.compile("".join("[a-z]" if c in _MASKS else re.escape(c) for c in word))
        found = [w for w in self.by_length.get(len(word), ()) if shape.fullmatch(w)]
        return found[0] if found else "".join(c for c in word if c not in _MASKS)

    def _meant(self, word: str) -> str | None:
        """The word of the vocabulary that ``word`` is written for, if it is none itself."""
        if word in self.known or not any(c.isalpha() for c in word) or sum(c in _ALSO for c in word) > 4:
            return None
        read = map("".join, product(*(_ALSO.get(c, c.translate(_LEET)) for c in word)))
        return next((w for w in read if w in self.known), None)

    def _word(self, m: re.Match) -> str:
        word = m.group(0)
        letters = sum(c.isalpha() for c in word)
        if letters == len(word):
            return self._meant(word) or word
        bare = word.rstrip("!|?")
        pronoun = len(bare) == 2 and _VERB.search(m.string, 0, m.start())
        meant = self._meant(bare) if len(bare) > 2 else None
        if meant:
            return meant + word[len(bare) :]
        if letters * 2 < len(word) or (_IDENT.match(word) and not pronoun):
            return word
        word, tail = bare.translate(_LEET), word[len(bare) :]
        return (self._unmasked(word) if any(c in _MASKS for c in word) else word) + tail

    def _hyphened(self, m: re.Match) -> str:
        a, b = m.groups()
        if (a in self.known and b in self.known) or len(a) + len(b) < 4:
            return m.group(0)
        found = self._unmasked(f"{a}*{b}")
        return found if found in self.known else m.group(0)

    def words(self, piece: str) -> list[str]:
        """Words and end marks of one folded piece between spaces."""
        if piece.isalpha():
            piece = "v" in piece and self._meant(piece) or piece
        else:
            piece = _SPREAD.sub(lambda m: re.sub(r"[^a-z]", "", m.group(0)), piece)
            piece = _LEETWORD.sub(self._word, piece)
            piece = _HYPHENED.sub(self._hyphened, piece)
        return _TOKENS.findall(_REPEATED.sub(r"\1", piece))

    @staticmethod
    def pieces(text: str) -> list[str]:
        return fold(clean(text)).replace("\n", " . ").split()

    def tokens(self, text: str) -> list[str]:
        """The words of a text and the marks between its passages."""
        out: list[str] = []
        for piece in self.pieces(text):
            out.extend(self.words(piece))
        at = 0
        while at < len(out):
            end = at
            while end < len(out) and len(out[end]) == 1 and out[end].isalpha():
                end += 1
            if end - at >= _RUN:
                out[at:end] = ["".join(out[at:end])]
            at = max(end, at + 1)
        return out

    def numbers(self, text: str) -> list[int]:
        """A number for each word; 0 between passages."""
        return list(chain.from_iterable(map(self.numbered.__getitem__, self.pieces(text))))


def _joined(numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of single letters as words; ``ends``: where each text ends."""
    single = (numbers < _LETTERS) & (numbers > 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    runs = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= _RUN]
    if not runs:
        return numbers, ends
    keep = np.ones(len(numbers), bool)
    numbers = numbers.copy()
    for a, b in runs:
        numbers[a] = _seed("".join(chr(96 + (int(x) >> 1)) for x in numbers[a:b]))
        keep[a + 1 : b] = False
    return numbers[keep], np.cumsum(keep)[ends - 1]


def features(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features that end at each word, four columns, and which of them exist."""
    n = len(numbers)
    word = numbers != 0
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    one[1:], two[2:] = numbers[:-1], numbers[:-2]
    has1 = word & (one != 0)
    has2 = has1 & (two != 0)
    a = mix(numbers)
    b = mix(one * np.uint64(3) + a)
    c = mix(two * np.uint64(5) + b)
    d = mix(two * np.uint64(7) + a)
    shift = np.uint64(64 - BITS)
    return np.stack([a >> shift, b >> shift, c >> shift, d >> shift], 1).astype(np.int32), np.stack([word, has1, has2, has2], 1)


class Ftrl:
    """FTRL-proximal logistic regression over hashed binary features; the last weight is the bias."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int, weight: float) -> None:
        w = self._weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * weight
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def weights(self) -> np.ndarray:
        return self._weights(np.arange(len(self.z))).astype(np.float32)


def _passages(tokens: list[str]) -> list[tuple[str, ...]]:
    """The passages of a token list, cut into windows where they are long."""
    out, run = [], []
    for t in [*tokens, "."]:
        if t[0].isalpha():
            run.append(t)
            continue
        if run:
            out.extend(tuple(run[i : i + WINDOW]) for i in range(0, max(1, len(run) - WINDOW // 2), WINDOW // 2 if len(run) > WINDOW else WINDOW))
        run = []
    return out


class Model:
    """Trained weights and the vocabulary that undoes masks; scores texts."""

    def __init__(self, weights: np.ndarray, vocabulary: Sequence[str]):
        kept = np.flatnonzero(weights)
        self.kept, self.values, self.vocabulary = kept.astype(np.int32), weights[kept], list(vocabulary)
        self._ready: tuple[np.ndarray, Reader] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """The score of each text, between 0 and 1; 0 for a text without words."""
        if self._ready is None:
            dense = np.zeros((1 << BITS) + 1, np.float32)
            dense[self.kept] = self.values
            self._ready = dense, Reader(self.vocabulary)
        dense, reader = self._ready
        out = np.zeros(len(texts))
        flat: list[int] = []
        ends = []
        for t in texts:
            flat.extend(reader.numbers(t))
            flat.append(0)
            ends.append(len(flat))
        if not flat:
            return out
        numbers, ends = _joined(np.array(flat, np.uint64), np.array(ends, np.int64))
        at, has = features(numbers)
        gain = np.concatenate([[0.0], np.cumsum((dense[at] * has).sum(1), dtype=np.float64)])
        place = np.arange(len(numbers))
        start = np.maximum.accumulate(np.where(numbers == 0, place, -1)) + 1  # of the passage
        # a window that begins inside a passage leaves out the n-grams that reach back beyond it: two words at most
        margin = gain[place + 1] - gain[np.maximum(start, place + 1 - WINDOW)]
        # scored as trained: whole passages, and full windows of long ones
        whole = (numbers != 0) & ((np.append(numbers[1:], 0) == 0) | (place - start + 1 >= WINDOW))
        margin = np.where(whole, margin + dense[-1], -np.inf)
        best = np.maximum.reduceat(margin, np.concatenate([[0], ends[:-1]]))
        return np.where(np.isneginf(best), 0.0, 1 / (1 + np.exp(-np.clip(best, -30, 30))))


def fit(documents: Sequence[tuple[str, int]]) -> Model:
    """A model from (text, 1 if labelled offensive else 0); without documents, from the phrases alone."""
    plain = Reader()
    vocabulary = Counter(w for t in OFFENSIVE for w in plain.tokens(t) if len(w) >= 4)
    reader = Reader(vocabulary)
    docs = [(_passages(reader.tokens(t)), y) for t, y in documents]
    fixed = [(p, y) for texts, y in ((OFFENSIVE, 1), (HARMLESS, 0)) for t in texts for p in _passages(reader.tokens(t))]
    index: dict[tuple[str, ...], np.ndarray] = {}

    def buckets(p: tuple[str, ...]) -> np.ndarray:
        found = index.get(p)
        if found is None:
            at, has = features(np.array([0, *map(_seed, p)], np.uint64))
            found = index[p] = np.append(np.unique(at[has]), 1 << BITS)
        return found

    def train(seen: dict[tuple[str, ...], list[int]]) -> Ftrl:
        """``seen``: for each passage, how often it was met as harmless and as offensive."""
        model, rng = Ftrl(), np.random.default_rng(7)
        items = [(buckets(p), int(on >= off), (2.0 if on >= off else 1.0) + min(3.0, np.log2(max(on, off)))) for p, (off, on) in seen.items()] + [(buckets(p), y, 1.0) for p, y in fixed] * COPIES
        for _ in range(EPOCHS):
            for i in rng.permutation(len(items)):
                model.learn(*items[i])
        return model

    distinct = list({p for passages, _ in docs for p in passages})
    joined = np.concatenate([buckets(p) for p in distinct]) if distinct else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum([len(buckets(p)) for p in distinct])[:-1]]).astype(np.int64) if distinct else joined

    def scores(model: Ftrl) -> dict[tuple[str, ...], float]:
        return dict(zip(distinct, np.add.reduceat(model.weights().astype(np.float64)[joined], starts))) if distinct else {}

    # documents of either label that begin a passage alike: what most harmless ones say is background,
    # whatever a noisy label or a chance likeness makes of it
    family: dict[tuple[str, ...], list[int]] = {}
    for passages, y in docs:
        for start in {p[:FAMILY] for p in passages}:
            family.setdefault(start, [0, 0])[y] += 1

    def background(p: tuple[str, ...]) -> bool:
        off, on = family[p[:FAMILY]]
        return off > on

    def suspect(p: tuple[str, ...]) -> bool:
        off, on = family[p[:FAMILY]]
        return on >= 3 and on >= 2 * off

    spared = dict(zip(distinct, np.random.default_rng(11).random(len(distinct)) > EASY))
    model = train({})
    for turn in range(ROUNDS if docs else 0):
        score = scores(model)
        seen: dict[tuple[str, ...], list[int]] = {}
        tops = [max(map(score.get, p)) for p, y in docs if p and not y] or [0.0]
        # the model of the phrases alone knows no background: it only keeps likely offences out of the harmless ones
        least = float(np.quantile(tops, OVER))
        for passages, y in docs:
            top = max(passages, key=score.get) if turn and y and passages else None
            for p in set(passages):
                if p == top and score[p] > least and not background(p):
                    seen.setdefault(p, [0, 0])[1] += 1
                elif (turn or not y) and (background(p) or score[p] <= max(least, 0.0) and not suspect(p)) and not (score[p] < SURE and spared[p]):
                    seen.setdefault(p, [0, 0])[0] += 1
        model = train(seen)
    weights = model.weights()
    dense = weights.astype(np.float64)
    for passages, y in docs:
        for p in passages:
            if y and dense[buckets(p)].sum() > 1.0:
                vocabulary.update(w for w in p if len(w) >= 4)
    return Model(weights, vocabulary)


def fit_on(documents: DataFrame, labels: DataFrame, key: str, content: str, label: str, offensive: str = "offensive", sample: int = SAMPLE, characters: int = CHARACTERS) -> Model:
    """A model fitted on at most ``sample`` labelled documents of at most ``characters`` characters in all, whole ones, chosen by
    the hash of their key. A document judged more than once has the label of most annotators, ties counting as offensive;
    null labels judge nothing."""
    said = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.avg((F.col(label) == offensive).cast("double")).alias("share"))
    chosen = said.orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = documents.select(F.col(key).alias("key"), F.col(content).alias("text")).join(chosen, "key")
    size = F.coalesce(F.length("text"), F.lit(0))
    sizes = rows.select("key", size.alias("size")).orderBy(F.xxhash64("key"), "key").collect()  # at most ``sample`` numbers, copies of a key apart
    kept, total = [], 0
    for r in sizes:
        if total + r["size"] <= characters:
            total += r["size"]
            kept.append(r["key"])
    if len(kept) < len(sizes):
        rows = rows.where(F.col("key").isin(kept))
    return fit([(r["text"] or "", int(r["share"] >= 0.5)) for r in rows.orderBy("key").collect()])


def scored(df: DataFrame, content: str, keys: Sequence[str], model: Model) -> DataFrame:
    """``keys`` and ``score`` of every document.

    A null or empty text scores 0. Keys may be null, repeated rows come out repeated, an empty table
    gives an empty table. Whole texts are read, however long.
    """
    ship(df.sparkSession)
    names = [f"{RESERVED}k{i}" for i in range(len(keys))]
    narrow = df.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], F.col(content).alias(RESERVED + "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            texts = batch[RESERVED + "text"].tolist()
            for i in range(0, len(texts), 512):
                parts.append(model.scores(texts[i : i + 512]))
            yield batch[names].assign(score=np.concatenate(parts) if parts else [])

    types = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(keys, names))
    found = spread(narrow).mapInPandas(run, f"{types}, score double")
    return found.select(*[F.col(n).alias(c) for c, n in zip(keys, names)], "score")
