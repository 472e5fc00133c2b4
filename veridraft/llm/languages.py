"""What tells Portuguese, English, Spanish and French apart, and Brazilian from European usage."""

from __future__ import annotations

import re

from veridraft.llm.text import fold

# Function words met in one of the four languages only (folded).
STOPWORDS = {
    "pt": frozenset(
        "o os uma um ao aos das dos do da na no nas nos pela pelo pelas pelos e a um de com sem mais muito mas tambem ja ainda voces voce seu sua seus suas vosso vossa vossos vossas foi sao esta estao sera "
        "serao foram tem ter ser nao sim ou quando onde isso isto esse essa este ate apos sobre em para por que como agradecemos obrigado obrigada caro cara bom boa dia tarde senhor senhora exmo exma "
        "cumprimentos prazo fatura pode podem vai vao temos estamos ficam fica".split()
    ),
    "en": frozenset(
        "the and of to in a is are was were will be been has have had with for from this that these those you your our we us it its not no please thank thanks dear hello regards as by on at or if "
        "which who whom when where can could should would may must do does did there their they he she his her an any all more most under until before after about".split()
    ),
    "es": frozenset(
        "el los las una un del al y a de con sin mas muy pero tambien ya todavia usted ustedes su sus fue es son esta estan sera seran fueron ha han hay no si cuando donde eso esto ese este hasta "
        "tras sobre en para por que como gracias estimado estimada senor senora senores nuestros nuestro nuestra saludo saludos plazo factura puede pueden le les lo nos".split()
    ),
    "fr": frozenset(
        "le la les un une des du et avec sans plus tres mais aussi deja encore vous votre vos nous notre nos est sont sera seront ete ont il elle ils ne pas non oui ou quand cela ce cette ces "
        "jusqu apres sur en dans pour par de que qui comme merci cher chere madame monsieur bonjour cordialement delai facture peut peuvent au aux".split()
    ),
}
_ALL = frozenset().union(*STOPWORDS.values())
#: Languages each word votes for; a word of two languages gives each half a vote.
VOTES = {w: tuple(c for c, own in STOPWORDS.items() if w in own) for w in _ALL}


#: Words that speak for one language only.
EXCLUSIVE = {c: frozenset(w for w in own if len(VOTES[w]) == 1) for c, own in STOPWORDS.items()}


def votes(words: list[str]) -> dict[str, float]:
    """Stopword votes of folded words."""
    out = dict.fromkeys(STOPWORDS, 0.0)
    for w in words:
        found = VOTES.get(w)
        if found:
            for c in found:
                out[c] += 1 / len(found)
    return out


def voted(words: list[str], least: float = 2.0, lead: float = 1.5) -> str | None:
    """The language with most votes, if it has enough of them and leads the next clearly."""
    ranked = sorted(votes(words).items(), key=lambda x: -x[1])
    return ranked[0][0] if ranked[0][1] >= least and ranked[0][1] >= lead * ranked[1][1] else None


# Words of Brazilian and of European usage (lower case, with accents), and forms of them.
BRAZILIAN = frozenset(
    "você vocês celular celulares ônibus trem trens caminhão caminhões usuário usuários usuária time times equipe equipes tela telas cadastro cadastros cadastrar arquivo arquivos banheiro banheiros registro registros "
    "recepção recepcionista planilha planilhas estoque estoques faturamento suprimentos aplicativo aplicativos boleto boletos mouse freezer refeitório plantão oi prezado prezada prezados pra pro gerenciar gerenciando estagiário "
    "estagiária contato contatos fato ação gente deletar salvar baixar baixe demanda contatar econômico gênero bônus acadêmico atendente geladeira aluguel café-da-manhã bonde pedestre gramado sorvete terno xícara "
    "senha academia descarga carona conosco polonês canadense vietnamita moscou irã projetar acessar checar estacionar mídia".split()
) - frozenset("ação fato gente conosco senha academia salvar terno moscou demanda estacionar projetar".split())
EUROPEAN = frozenset(
    "vós vos vosso vossa vossos vossas convosco connosco telemóvel telemóveis autocarro autocarros comboio comboios camião camiões utilizador utilizadores equipa equipas ecrã ecrãs ficheiro ficheiros registo registos registar "
    "receção rececionista contacto contactos contactar contactasse contacte facto factos excecional exceção detetámos detetar deteção direção actualizar actualizado direcção acção facturação óptimo adopção frigorífico "
    "portagem autoestrada encomenda encomendas morada moradas guia portaria fatura faturas faturação comprovativo anexo aprovação cais excecionalmente telefónica telefónico telefónicos eletrónico eletrónica económico "
    "género bónus académico prémio António regularizar solicitamos agradecemos empregado rés-do-chão gelado peão boleia talho sumo".lower().split()
) - frozenset("guia anexo aprovação morada moradas regularizar encomenda encomendas fatura faturas direção".split())
_BR_FORMS = re.compile(r"\b(?:est(?:á|a|ão|ao|ou|amos|ava|avam|aremos|ará)|vem|vêm|foi|ficou|continua) \w+(?:ando|endo|indo)\b|\ba gente\b|\br\$|\bnota fiscal\b|\b(?:me|te|nos|lhe) (?:avise|mand[ae]|envie|ligue|diga|avisa|mando|fale)\b|\bconte com\b|\btudo bem\b|\bpra\b")
_PT_FORMS = re.compile(r"\b(?:est(?:á|a|ão|ao|ou|amos|ava|avam|ivemos)|ficou|ficámos|fic[ao]m?|continua|continuam|anda) a \w+(?:ar|er|ir|or)\b|\b\w+(?:ámos)\b|\b\w+-(?:vos|lhe|nos|se)-(?:á|ão|emos|ia)\b|\b\w+-vos\b|\b\w+(?:ásseis|êsseis|ísseis|ásseis|ais|eis)\b(?<!mais)(?<!demais)(?<!jamais)(?<!seis)(?<!dezasseis)(?<!dezesseis)(?<!reais)(?<!úteis)(?<!móveis)(?<!\wnais)(?<!\wmais)(?<!\wtais)(?<!\wáveis)(?<!\wíveis)")


_ACCENTED = frozenset("econômico gênero bônus acadêmico económico género bónus académico vós".split())
_BR_FOLDED, _PT_FOLDED = (frozenset(fold(w) for w in own - _ACCENTED) for own in (BRAZILIAN, EUROPEAN))


def usage(text: str) -> tuple[int, int]:
    """Marks of Brazilian and of European usage in a cleaned Portuguese passage, accents or not."""
    lowered = text.lower()
    found = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", lowered)
    plain = [fold(w) for w in found]
    return (
        sum(p in _BR_FOLDED or w in _ACCENTED and w in BRAZILIAN for w, p in zip(found, plain)) + len(_BR_FORMS.findall(lowered)),
        sum(p in _PT_FOLDED or w in _ACCENTED and w in EUROPEAN for w, p in zip(found, plain)) + len(_PT_FORMS.findall(lowered)),
    )
