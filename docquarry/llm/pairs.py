"""Defects of logged question and answer pairs.

Each answer is read by rules, in the order in which a defect takes precedence:
``empty``, ``refusal``, ``copy``, ``language``, ``truncated``. Refusals come
from a grammar whose clauses are put together from parts (an inability or an
absence, and what it is about); copies from greedy string tiling of question
and answer; languages from script and function words; truncation from a
pushdown parser over fences, brackets, quotations, emphasis, tags and lists.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Placeholders that state nothing.
PLACEHOLDERS = {"null", "none", "n/a", "na", "nan", "nil", "tbd", "todo", "undefined", "unknown", "empty", "no answer", "answer", "-"}

HIDDEN = regex.compile(r"[[\p{Cf}\p{Cc}]--[\n\r\t]]", regex.V1)
CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
CITE = re.compile(r"\s*\[\d+\](?:\s*\[\d+\])*")
FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
INLINE = re.compile(r"`[^`\n]*`")
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")
QUOTE_MARK = re.compile("[\"“«„]")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def visible(text: str) -> str:
    return text if text.isascii() and not CONTROL.search(text) else HIDDEN.sub("", text)


# --- empty


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if len(answer) > 200 and re.search(r"[^\W_]{3}", answer):
        return False
    a = answer.strip()
    bare = FENCE.sub(lambda m: m.group().strip("`"), a)
    core = re.sub(r"[\W_]+", " ", CITE.sub("", bare)).strip().lower()
    return not core or a.strip(" \t\n.\"'()[]*`").lower() in PLACEHOLDERS or core in ("n a", "null", "none", "nan", "tbd", "todo")


# --- refusal

# The parts of refusing clauses in five languages. ``cannot`` is an inability, ``say`` what one is unable to do,
# ``lack`` an absence, ``news`` what is absent, ``source`` where it is, ``not_say`` sources that do not tell.
PARTS = {
    "en": {
        "cannot": r"(?:can ?not|can't|could(?: not|n't)|unable to|(?:am|are|is) not (?:able|allowed|permitted|qualified|in a position) to|(?:will|would) not|won't|(?:'d|would|will|must|have to) (?:rather not|prefer not to|decline|refuse)|decline|refuse)",
        "say": r"(?:answer|help|say|tell|respond|reply|assist|provide|give|determine|find|locate|comment|confirm|guess|speculate|address|identify|establish|offer)",
        "lack": r"(?:(?:do|does|did)(?: not|n't) (?:\w+ )?(?:have|find|know|see|hold|possess)|(?:have|has|had|there (?:is|was|are|were|'s)|there's|with|see|find|found) (?:no|not any|nothing)|lacks?)",
        "news": r"(?:information|info|answers?|data|details?|mention|references?|records?|idea|clue|knowledge|entry|evidence|indication|access|anything|nothing|that|this|it\b|about|on\b|of this)",
        "source": r"(?:documents?|documentation|context|excerpts?|passages?|manuals?|materials?|sources?|texts?|pages|sheets?|files|notes|snippets?|scope|reach)",
        "not_say": r"(?:(?:do|does|did)(?: not|n't)|never|nowhere) (?:\w+ )?(?:contain|include|say|provide|mention|cover|give|answer|address|discuss|state|specify|tell|list)\w*",
        "object": r"(?:the answer|an answer|anything|this|that|it\b|any information|information|enough|about)",
        "own": r"(?:\b(?:outside|beyond|exceeds|not within|out)(?: of)? (?:\w+ )?(?:what i|my|the scope|scope|the (?:given |provided )?{source})|\b(?:nothing|none|no \w+)\b.{{0,40}}\b(?:{source}|shown|given|found|available|cover\w*|mention\w*|says?|said)\b|\bno (?:answer|information|details?|data) (?:can|could|is|was|are|were)\b|\b(?:is|are|was|were)(?: not|n't) (?:\w+ ){{0,2}}(?:in|covered by|part of|mentioned in|found in|given in|available in) (?:the |any of the |these |my )?(?:provided |given |supplied |available )?{source}|\b(?:don't|do not|didn't) know\b|\bnot sure\b|\bi have no idea\b|\bleave (?:this|that|it|the question) (?:open|unanswered)\b|\bas an? (?:ai|assistant|language model)\b.{{0,60}}\b{cannot})",
    },
    "de": {
        "cannot": r"(?:kann|können|konnte|darf|vermag|möchte|will|werde)\b.{0,60}?\b(?:nicht|nichts|keine?n?)",
        "say": r"(?:beantworten|antworten|sagen|helfen|mitteilen|finden|angeben|bestimmen|ermitteln|auskunft|angaben?|antwort|geben|weiterhelfen|raten)",
        "lack": r"(?:(?:habe|haben|hat|finde|finden|liegen|liegt|gibt es|besitze|fehlen|weiß)\b.{0,60}?\b(?:nicht|nichts|keine?n?|keinerlei)|es fehlen)",
        "news": r"(?:angaben?|informationen?|auskunft|antwort|daten|hinweise?|dazu|darüber|hierzu|davon|kenntnis|ahnung)",
        "source": r"(?:dokumente?n?|unterlagen|kontext|auszüge?n?|passagen|handbuch|handbücher|handbüchern|material|quellen?|texte?n?|abschnitte?n?)",
        "not_say": r"(?:enthalten|enthält|sagen|sagt|erwähnen|erwähnt|nennen|nennt|behandeln|behandelt|steht|stehen|geben|gibt)\b.{0,40}?\b(?:nicht|nichts|keine?n?)",
        "object": r"(?:dazu|darüber|hierzu|davon|angaben?|informationen?|antwort)",
        "own": r"(?:\b(?:dazu|darüber|hierzu|davon)\b.{{0,60}}\b(?:nicht|nichts|keine?n?)\b|\b(?:nicht|nichts|keine?n?)\b.{{0,40}}\b(?:dazu|darüber|hierzu|beantwortet)\b|\bleider\b.{{0,60}}\b(?:nicht|nichts|keine?n?)\b|\baußerhalb (?:meines|dessen|des|der)\b|\bweiß (?:ich )?(?:es )?(?:leider )?nicht\b)",
    },
    "fr": {
        "cannot": r"(?:ne|n')\s?(?:\w+ )?(?:peux|peut|pouvons|pourrais|sais|saurais|parviens|suis)\b.{0,20}?\b(?:pas|rien|point)?",
        "say": r"(?:répondre|dire|aider|trouver|fournir|donner|indiquer|déterminer|préciser|capable|mesure)",
        "lack": r"(?:n'ai|n'a|n'avons|ne trouve|ne dispose|ne connais|ne vois|ne possède|il n'y a|n'existe)\b.{0,20}?\b(?:pas|aucune?|rien|de)",
        "news": r"(?:informations?|réponse|données?|détails?|mention|idée|renseignements?|cela|ceci|rien)",
        "source": r"(?:documents?|contexte|extraits?|passages?|manuels?|textes?|sources?|pages)",
        "not_say": r"(?:ne|n')\s?(?:en )?(?:contien\w+|mentionn\w+|parl\w+|di\w+|précis\w+|donn\w+|indiqu\w+|permet\w*|couvr\w+|trait\w+|répond\w*)",
        "object": r"(?:pas|rien|aucune?)",
        "own": r"(?:\baucune? (?:passage|extrait|document|manuel|information|réponse|donnée|source|mention)\b|\bdésolée?\b|\bn'en parlent? pas\b|\bhors (?:de|du) (?:ma|mon|cadre|champ)\b|\brien (?:dans|à ce sujet|là-dessus)\b|\bje (?:ne sais pas|l'ignore)\b)",
    },
    "es": {
        "cannot": r"\bno (?:me |le |se )?(?:puedo|puede|podemos|podría|sé|sabría|logro|es posible|estoy en condiciones)",
        "say": r"(?:responder|contestar|decir|ayudar|encontrar|dar|indicar|determinar|precisar|responderle|ayudarle)",
        "lack": r"\bno (?:tengo|tenemos|hay|encuentro|dispongo|conozco|veo|existe|se encuentra)",
        "news": r"(?:informaci\w+|respuesta|datos?|detalles?|menci\w+|idea|esa?|esto|eso|nada|referencia)",
        "source": r"(?:documentos?|contexto|fragmentos?|pasajes?|manual\w*|textos?|fuentes?|páginas|extractos?)",
        "not_say": r"\bno (?:lo |se )?(?:contiene\w*|menciona\w*|dice\w*|habla\w*|incluye\w*|da\w*|indica\w*|trata\w*|cubre\w*|responde\w*)",
        "object": r"(?:nada|respuesta|informaci\w+|al respecto|eso|esto)",
        "own": r"(?:\b(?:ningún|ninguno|ninguna|nada)\b.{{0,50}}\b(?:{source}|responder|contestar|respuesta|al respecto|dice\w*|permite\w*)\b|\blo siento\b|\bfuera de (?:mi|lo que|los|el)\b|\bno (?:lo )?sé\b)",
    },
    "tr": {
        "cannot": r"(?:\w+(?:a|e)m[ıiuü]yor\w*|\w+(?:a|e)mam\w*|\w+(?:a|e)mem\w*|mümkün değil\w*)",
        "say": r"",
        "lack": r"(?:bilgi|yanıt|cevap|konu|soru|veri|kayıt|ayrıntı)\w*\b.{0,50}?\b(?:yok|yoktur|bulunm\w+|bulam\w+|yer alm\w+|verilm\w+|sahip değil\w*|geçm\w+|içerm\w+)",
        "news": r"",
        "source": r"(?:belge|doküman|kaynak|metin|bağlam|kılavuz|alıntı)\w*",
        "not_say": r"(?:içerm\w+|bahsetm\w+|söylem\w+|geçm\w+|değinm\w+|yer alm\w+|bulunm\w+|yanıtlam\w+)",
        "object": r"",
        "own": r"(?:\büzgünüm\b|\bmaalesef\b|\bbilm(?:iyor|em)\w*\b|\bfikrim yok\b|\bkapsam\w* dışında\b|\b(?:yanıt|cevap)\w* (?:verem\w+|veremiyor\w*)|\byanıtlayam\w+)",
    },
}


def clauses() -> list[re.Pattern]:
    out = []
    for p in PARTS.values():
        gap = r".{0,40}?\b"
        patterns = [rf"{p['cannot']}\b{gap}{p['say']}", rf"{p['lack']}\b{gap}{p['news']}", rf"{p['source']}\b.{{0,60}}?\b{p['not_say']}\b{gap}{p['object']}", rf"{p['not_say']}\b{gap}{p['source']}", p["own"].format(**p)]
        out.append(re.compile("|".join(f"(?:{x})" for x in patterns)))
    return out


CLAUSES = clauses()
#: What any refusing clause holds; a quick test before the grammar.
NEGATION = re.compile(
    r"\bno\b|\bnot\b|n't|cannot|\bnone\b|nothing|nowhere|never|unable|declin|refus|lack|outside|beyond|unknown|rather|"
    r"nicht|kein|fehl|außerhalb|\bne\b|\bn'|aucun|désol|rien|hors|ignore|ning|nada|siento|fuera|"
    r"m[ıiuü]yor|[ae]m[ae]|yok|değil|[ae]lm[ae]|ilm[ae]|nm[ae]|rm[ae]|lm[ıi]|üzgün|maalesef|dışında|bilm"
)
# Words that turn to another point, after which an answer may still be given.
HEDGE = re.compile(r"\b(but|however|though|although|otherwise|instead|mais|cependant|toutefois|pero|sin embargo|aber|jedoch|sondern|ama|ancak|fakat)\b|;")
# Advice that follows a refusal and answers nothing.
ADVICE = re.compile(r"^(please|try|you (may|might|can|could|should)|bitte|veuillez|essayez|consultez|consulte|pruebe|intente|lütfen|versuchen|see the|ask|contact)\b")


def plain(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("’", "'").replace("ʼ", "'")).strip().lower().replace("i̇", "i")


def refuses(low: str) -> bool:
    return bool(NEGATION.search(low)) and any(c.search(low) for c in CLAUSES)


def states(clause: str) -> bool:
    """Whether a clause gives a value or a fact of its own."""
    c = CITE.sub("", clause)
    return bool(re.search(r"\d", re.sub(r"\b[A-Za-z]+\d+(_\w+)?\b", "", c)) or re.search(r"\bP[A-Z]\d+\b", c))


def is_refusal(answer: str) -> bool:
    """Some sentence refuses and no other sentence or clause gives an answer."""
    if "`" in answer:
        answer = FENCE.sub(" ", answer)
    refused = False
    for s in SENTENCE.split(answer.strip()):
        low = plain(CITE.sub("", s)).strip("*_-• ")
        if not low:
            continue
        if refuses(low):
            if states(s) and (HEDGE.search(low) or re.search(r"\b(is|are|holds|reads|beträgt|ist|est|es)\b.{0,20}\d", low)):
                return False
            refused = True
        elif not ADVICE.match(low) and (not refused or states(s) or len(low.split()) > 4):
            return False
    return refused


# --- copy

# Labels set before a repeated question.
LABELS = frozenset("question q frage pregunta soru you asked user asks your".split())


def words_of(text: str) -> list[str]:
    low = unicodedata.normalize("NFKC", text).replace("İ", "i").replace("I", "i").lower().replace("ı", "i")
    return re.findall(r"\w+", low)


def tiles(q: list[str], a: list[str], least: int = 1) -> list[int]:
    """Greedy string tiling: the length of the tile each word of ``a`` lies in, 0 for none.

    The longest run of words that both have and that no tile covers yet becomes
    a tile, the leftmost of the longest first, and so on down to ``least``.
    """
    free_q, in_tile = [True] * len(q), [0] * len(a)
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(q)):
                n = 0
                while i + n < len(a) and j + n < len(q) and not in_tile[i + n] and free_q[j + n] and a[i + n] == q[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return in_tile
        for k in range(n):
            in_tile[i + k], free_q[j + k] = n, False


def copied(question_words: list[str], answer: str) -> bool:
    """Whether tiles of the question, which may be repeated, cover the whole answer, mostly in runs of words."""
    q = question_words
    if not q:
        return False
    begin = words_of(answer[:80])[:-1]  # the last word may be cut
    if len(begin) > 4 and not set(begin[2:]) <= set(q) | LABELS:
        return False
    a = words_of(answer)
    while a and a[0] in LABELS:
        a = a[1:]
    if len(a) < max(2, len(q) * 0.6) or not set(a) <= set(q):
        return False
    runs, at = 0, 0
    while at < len(a):  # each repetition of the question is tiled anew
        part = a[at : at + len(q)]
        cover = tiles(q, part)
        if not cover[0]:
            return False
        done = next((k for k, n in enumerate(cover) if not n), len(part))
        runs += sum(n >= 2 for n in cover[:done])
        at += done
    return runs >= 0.6 * len(a)


# --- language

# Function words by language.
FUNCTION = {
    "en": "the a of is to and in on at it with for when that which while only by be are an as must before after this from where what how does do not if its there no or has can will may than set until into your any these those both between under over then out up so",
    "de": "der die das und in auf dem den des von mit für wenn bei nach ein eine einen wird nicht zu im am sich oder aber sind wie was welche welchen welches wo auch nur als bis vor solange höchstens aus durch über er es man hat kann darf laut gilt sein kein keine ist an bevor damit zum zur beim ab je um weil daß dass diese dieser dieses",
    "fr": "le la les de du des et en sur un une à au aux pour par qui que dans avec si ne pas se il elle ce cette où quel quelle est mais après avant tant plus sont peut doit reste ou son sa on cela ces leur entre chaque sous lorsque quand comme",
    "es": "el la los las de del y en un una al para por que con si no se lo su este esta dónde qué cuál cómo pero antes después tras más son está puede debe como sin mientras hasta o cada desde es hay a entre sobre cuando donde",
    "tr": "ve bir bu için ile de da en çok olarak hangi nasıl ne nedir nereden nerede mi mı değil içinde içindeki üzerinde üzerindeki sonra önce olur her zaman ise kadar yalnız ancak ama gibi daha göre veya ya hiç şu o ki iken altında",
    "it": "il lo la gli le di del della dei delle e in un una al alla per da che con se non si su questo questa dove quale come ma prima dopo più sono può deve senza fino ogni è nel nella sul sulla quando anche dal dalla",
    "pt": "o a os as de do da dos das e em um uma ao à para por que com se não seu sua este esta onde qual como mas antes depois mais são está pode deve sem até cada desde é no na nos nas pelo pela quando",
    "nl": "de het een van en in op te dat die is voor met niet zijn aan er om bij als naar door maar ook wordt kan moet deze dit wat waar hoe welke geen of tot na over uit worden wanneer zodra",
    "sv": "och i att det som en på är av för med till den har inte om ett men så kan vid från när eller efter ska detta där hur vilken under utan",
    "da": "og i at det som en på er af for med til den har ikke om et men så kan ved fra når eller efter skal dette hvor hvordan hvilken under uden",
    "pl": "i w na z do nie się jest to że o jak po przez od za dla przed co lub jest są ten ta gdy jeśli który która które gdzie tylko może oraz",
    "cs": "a v na je se že s z do o po pro od za k jako nebo při který která které kde když jen může není jsou podle",
    "ro": "și în de la cu pe un o este nu se care din pentru mai sau după până când unde cum dar sunt poate trebuie acest această fără",
    "fi": "ja on ei se että joka kun tai mutta niin kuin myös vain jos ovat tämä mikä missä miten ennen jälkeen kanssa",
}
WEIGHT: dict[str, list[tuple[str, float]]] = {}
for kind, listed in FUNCTION.items():
    for w in set(listed.split()):
        WEIGHT.setdefault(w, []).append((kind, 0.0))
# a word of several languages tells less of each
WEIGHT = {w: [(k, 1.0 if len(ks) == 1 else 0.8 if len(ks) == 2 else 0.6) for k, _ in ks] for w, ks in WEIGHT.items()}
# Letters and endings that few languages have.
LETTERS = (("tr", 0.5, re.compile("[ığş]")), ("de", 0.5, re.compile("[äß]")), ("es", 0.5, re.compile("[ñ¿¡]")), ("es", 0.3, re.compile("[óíáú]")), ("fr", 0.3, re.compile("[èêàçùœ]")), ("pt", 0.6, re.compile("[ãõ]")), ("pl", 0.6, re.compile("[łąężźń]")), ("cs", 0.6, re.compile("[řěů]")), ("ro", 0.6, re.compile("[țăș]")), ("sv", 0.4, re.compile("[å]")), ("da", 0.4, re.compile("[æø]")), ("fr", 1.0, re.compile(r"\b[ldnscq](?=['’ ]|\Z)")))
ELISION = re.compile(r"\b[ldnscq](?=['’])")
ENDINGS = (("tr", 0.5, re.compile(r"\w{2,}(?:nda|nde|ndan|nden|ların|lerin|larını|lerini|dır|dir|dur|dür|tır|tir|yor|ını|ini|ına|ine|unu|ünü|una|üne|ının|inin|unun|ünün|abilir|ebilir|malıdır|melidir|ıyla|iyle)\b")),)
SCRIPTS = tuple((kind, regex.compile(rf"\p{{Script={name}}}")) for name, kind in (("Cyrillic", "cyrillic"), ("Greek", "greek"), ("Hiragana", "kana"), ("Katakana", "kana"), ("Han", "han"), ("Arabic", "arabic"), ("Hebrew", "hebrew"), ("Hangul", "hangul"), ("Devanagari", "devanagari"), ("Thai", "thai")))
WIDE = regex.compile(r"[\p{L}--\p{Script=Latin}]", regex.V1)
LETTER_RUN = re.compile(r"(?<!\w)[^\W\d_]+(?:-[^\W\d_]+)*(?!\w)")


def script(text: str) -> str | None:
    """The script of most letters, or None without any."""
    others = () if text.isascii() else WIDE.findall(text)
    if not others:
        return "latin" if re.search(r"[^\W\d_]", text) else None
    counts = {"latin": len(regex.findall(r"\p{Script=Latin}", text))}
    for kind, found in SCRIPTS:
        counts[kind] = counts.get(kind, 0) + len(found.findall("".join(others)))
    if counts["kana"] and counts["kana"] + counts["han"] >= 4:
        return "kana"
    return max(counts, key=counts.get)


def plain_words(text: str) -> list[str]:
    """Words in lower case, without names, identifiers and units."""
    return [w.lower() for w in LETTER_RUN.findall(text.replace("’", "'").replace("İ", "i")) if w[1:].islower() or len(w) == 1]


def evidence(words: list[str], text: str) -> dict[str, float]:
    """How much the words of a sentence in Latin letters tell of each language; ``text`` has them with their apostrophes."""
    score: dict[str, float] = {}
    for w in words:
        for kind, weight in WEIGHT.get(w, ()):
            score[kind] = score.get(kind, 0.0) + weight
    low = " ".join(words)
    for kind, weight, found in LETTERS:
        if n := len(found.findall(text if weight == 1.0 else low)):
            score[kind] = score.get(kind, 0.0) + weight * n
    for kind, weight, found in ENDINGS:
        if (kind in score or not low.isascii()) and (n := len(found.findall(low))):
            score[kind] = score.get(kind, 0.0) + weight * n
    return score


def language(text: str) -> str | None:
    """The language of a question, or its script if not Latin; None if it shows neither."""
    s = script(text)
    if s != "latin":
        return s if s and sum(c.isalpha() for c in text) >= 4 else None
    score = evidence(plain_words(text), text.lower())
    return max(score, key=score.get) if score and max(score.values()) >= 1 else None


def foreign(own: str, sentence: str) -> bool:
    """Whether a sentence shows another language than ``own``: clearly more of it, or some of it and nothing of ``own``."""
    s = script(sentence)
    if s != "latin":
        return s is not None and s != own and sum(c.isalpha() for c in sentence) >= 4
    words = plain_words(sentence)
    elided = " ".join(ELISION.findall(sentence.lower())) if "'" in sentence or "’" in sentence else ""
    return foreign_words(own, " ".join(words), elided)


@functools.lru_cache(maxsize=50_000)
def foreign_words(own: str, words: str, elided: str) -> bool:
    score = evidence(words.split(" "), elided)
    if not score:
        return False
    best = max(score, key=score.get)
    if best == own:
        return False
    little = score.get(own, 0.0)
    more = score[best] - little
    return more >= 1.4 or (more >= 1 and little <= 0.6 or more >= 0.8 and not little) and words.count(" ") >= 2


def other_language(own: str | None, answer: str) -> bool:
    """Whether some sentence of the answer is in another language than ``own``; identifiers, code and quotations have none."""
    if own is None:
        return False
    text = answer
    if "`" in text:
        text = INLINE.sub(" ", FENCE.sub("\n", text))
    if "[" in text:
        text = CITE.sub("", text)
    if QUOTE_MARK.search(text):
        text = QUOTED.sub(" ", text)
    return any(foreign(own, s) for s in SENTENCE.split(text) if s)


# --- truncation

# Words with which no sentence ends.
OPEN_ENDS = frozenset(
    "the a an and or of to with for when that which while by from as if are be because than into its until before "
    "der dem den des und oder von mit für wenn weil eine einen einer im zu als bis aus "
    "le la les de du des et ou un une à au aux pour par que qui dans avec si sur lorsque "
    "el los las del y o una al para por con cuando en como "
    "ve veya bir için ile çünkü ki".split()
)
OPENERS = {")": "(", "]": "[", "}": "{", "”": "“„", "“": "„", "»": "«", "›": "‹"}
MARK = re.compile(r"```|\*\*|`|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?\Z|[()\[\]{}“”„«»‹›\"\n]")
ITEM = re.compile(r"[ \t]*([-*•]|\d+[.)])(?:\s|\Z)")
# Tags that are not closed.
VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "wbr"}
BOUNDARY = re.compile(r"(?<!\d)[.!?](?:\s*\[\d+\])*\s+\S|\d[.!?](?:\s*\[\d+\])*\s+[^\sa-zçğıöşüäßéèàñ]")


def still_open(text: str) -> bool:
    """Pushdown parse: whether a fence, bracket, quotation, emphasis or tag is open at the end, or a list item is without text."""
    stack: list[str] = []
    for m in MARK.finditer(text):
        c = m.group()
        top = stack[-1] if stack else ""
        if top == "```" or top == "`":
            if c == top:
                stack.pop()
            continue
        if c in ("```", "`", "**"):
            if c == top:
                stack.pop()
            elif c in stack and c == "**":
                del stack[stack.index(c) :]
            else:
                stack.append(c)
        elif c[0] == "<":
            if not c.endswith(">"):
                return True
            name = re.match(r"</?([A-Za-z0-9]+)", c).group(1).lower()
            if c[1] == "/":
                if "<" + name in stack:
                    del stack[stack.index("<" + name) :]
            elif name not in VOID_TAGS and not c.endswith("/>"):
                stack.append("<" + name)
        elif c == '"':
            if top == '"':
                stack.pop()
            elif not (m.start() and text[m.start() - 1].isdigit()):  # inches
                stack.append('"')
        elif c in OPENERS and top and top in OPENERS[c]:
            stack.pop()
        elif c in "([{“„«‹":
            stack.append(c)
        elif c == "\n":
            # a new list item or paragraph ends what was open in the one before, but for code and tags
            if ITEM.match(text, m.end()) or text.startswith("\n", m.end()):
                while stack and stack[-1] in ('"', "**", "(", "[", "{", "“", "„", "«", "‹"):
                    stack.pop()
    return bool(stack) or bool(re.fullmatch(r"[ \t]*([-*•]|\d+[.)])", text.rsplit("\n", 1)[-1]))


def truncated(answer: str) -> bool:
    """Whether the text breaks off: something stays open, or its last sentence is incomplete."""
    text = answer.rstrip()
    if still_open(text):
        return True
    body = CITE.sub("", text).rstrip() if text.endswith("]") else text
    if not body or body.endswith("```"):
        return False
    lines = body.split("\n")
    last = lines[-1].strip()
    if re.search(r"(…|\.\.\.|[,;:(\-–—/&+=])$", last) and not re.fullmatch(r"\W+", last):
        return True
    tail = re.sub(r"[*_\"'”»)\]>]+$", "", last)
    if tail.endswith((".", "!", "?", "。", "！", "？")):
        return False
    end = re.search(r"[^\W_]+$", tail)
    if not end:
        return False
    if end.group() in OPEN_ENDS:
        return True
    listed = ITEM.match(last) is not None
    if text.endswith("]") or listed and items_end_bare(lines):
        return False
    # several sentences, all but the last closed: the last one breaks off
    return bool(BOUNDARY.search(ITEM.sub("", last, count=1) if listed else last)) or earlier_closed(lines, last)


def items_end_bare(lines: list[str]) -> bool:
    """Whether the list's other items also end without a full stop."""
    items = [CITE.sub("", x).strip() for x in lines if ITEM.match(x)]
    return all(not x.endswith((".", "!", "?")) for x in items[:-1])


def earlier_closed(lines: list[str], last: str) -> bool:
    before = "\n".join(lines[:-1]).strip()
    return before.endswith((".", "!", "?")) and len(last.split()) > 1


# --- all


class Asked:
    """What of a question is used for all its answers."""

    __slots__ = ("words", "language")

    def __init__(self, question: str | None):
        text = visible(question or "")
        self.words = words_of(text)
        self.language = language(text)


def defect(question: str | Asked | None, answer: str | None) -> str | None:
    asked = question if isinstance(question, Asked) else Asked(question)
    text = answer if answer is None else visible(answer)
    if is_empty(text):
        return "empty"
    if is_refusal(text):
        return "refusal"
    if copied(asked.words, text):
        return "copy"
    if other_language(asked.language, text):
        return "language"
    return "truncated" if truncated(text) else None


def broken_pairs(pairs: DataFrame, *, id_col: str = "result_id", question_col: str = "question", answer_col: str = "answer", memo: int = 20_000) -> DataFrame:
    """(result_id, defect), one row per defective pair.

    ``declined`` and ``cited`` are read and passed on only as a hint: they come
    from a simple rule in the log, so neither makes nor clears a defect, but a
    pair logged as declined skips no check. A null question has no language and
    no copy; a null answer is ``empty``. Repeated rows are judged each; texts
    are read whole; an empty table gives no rows; other columns are not read.
    Pairs never shuffle. A task keeps the verdicts of the last ``memo`` pairs.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[str | None, Asked] = {}
        known: dict[tuple, str | None] = {}
        for batch in batches:
            ids, kinds = [], []
            for i, q, a in zip(*(c.to_pylist() for c in batch.columns)):
                if (q, a) in known:
                    kind = known[q, a]
                else:
                    if q not in asked:
                        if len(asked) >= memo:
                            asked.clear()
                        asked[q] = Asked(q)
                    if len(known) >= memo:
                        known.clear()
                    kind = known[q, a] = defect(asked[q], a)
                if kind:
                    ids.append(i)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string())], ["result_id", "defect"])

    cols = [F.col(id_col).cast("bigint").alias("result_id"), F.col(question_col).alias("q"), F.col(answer_col).alias("a")]
    return pairs.select(*cols).mapInArrow(judge, "result_id bigint, defect string")
