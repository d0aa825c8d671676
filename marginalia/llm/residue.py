"""Problem 4: template residue, filler, error pages and script notices in place of content.

A value is cut into units (lines, blocks of markup, sentences). One automaton finds in one pass over the text all phrases of
error pages, script notices and fillers, in several languages, and the marks with which placeholders and values rendered from nothing begin.

- A unit is error, script or filler text if a decisive phrase stands in it and decisive and accompanying phrases cover COVERAGE of its
  letters or more: a sentence that merely speaks about such a thing has too little coverage. A script notice needs a name of
  scripts and a demand; an error that is told with its condition or meaning is content.
- At a mark the placeholder is read by its syntax. It is residue unless its place in the sentence says that it is spoken about: the object
  of an instruction ("set ${HOME}"), after or before a word of syntax ("the variable {x}", "{x} stands for"), quoted, or beside
  one of those.
- Invented Latin and keys struck at random, of which no list of phrases can know, are told by endings and by the
  likelihood of their letter pairs, against the pairs in the phrases here.

What a unit is, is judged in the consistent form of look-alikes, with quoted code masked.

A record is a case if one unit is. `share` is the part of a value's letters and digits in such units, `exclude` says that it is at
least EXCLUDE. Null, blank and tag-only values are no cases.
"""

from __future__ import annotations

import functools
import html
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.look_alikes import uniform

COVERAGE = 0.7
EXCLUDE = 0.5
#: Words of living languages have a likelihood a pair of about 0.7 (99 of 100 times three words above 0.13), random keys of -0.8 (below 0.01).
MASH = 0.2

# Phrases that decide, by kind, and phrases that go with them.
ERRORS = """
not found; not here; forbidden; unauthorized; not authorized; not allowed; access denied; permission denied; is denied; been denied; bad request; bad gateway; gateway timeout; gateway time-out; service unavailable; temporarily unavailable; temporarily unable; internal server error; too many requests; request timeout; not acceptable; gone
went wrong; broke; unexpected error; unexpected condition; error occurred; error has occurred; cannot be found; can't be found; could not be found; couldn't be found; cannot find; can't find; could not find; couldn't find; could not be loaded; couldn't be loaded; could not load; couldn't load; cannot be displayed; can't be displayed; cannot be reached; can't be reached; failed to load; failed to render; unable to load; does not exist; doesn't exist; no longer exists; no longer available; has been removed; has been moved; has been deleted
did not respond; didn't respond; is not responding; timed out; gave up waiting; no usable answer; could not connect; couldn't connect; unable to connect; down for maintenance; nothing lives at; rate limit reached; rate limit exceeded; slow down; cannot read property; cannot read properties; has run out; has expired; session expired; sign in again; log in to read; please log in; sign in to continue; log in to continue; checking your browser; not a robot; you are human; security check; loading
nicht gefunden; zugriff verweigert; nicht erreichbar; nicht verfügbar; interner serverfehler; schiefgelaufen; fehler aufgetreten; existiert nicht; konnte nicht geladen werden; nicht mehr vorhanden; wartungsarbeiten
introuvable; non trouvée; accès refusé; accès interdit; erreur interne du serveur; indisponible; une erreur est survenue; n'existe pas; n'existe plus; n'a pas pu être chargée; en maintenance
no encontrada; acceso denegado; no disponible; error interno del servidor; algo salió mal; no existe; ya no existe; no se pudo cargar; en mantenimiento
não encontrada; acesso negado; indisponível; erro interno do servidor; algo deu errado; não existe; não foi possível carregar; em manutenção
non trovata; accesso negato; non disponibile; errore interno del server; qualcosa è andato storto; non esiste; non esiste più; in manutenzione
niet gevonden; toegang geweigerd; niet beschikbaar; interne serverfout; iets misgegaan; bestaat niet; kon niet worden geladen
nie znaleziono; odmowa dostępu; brak dostępu; niedostępna; błąd serwera; coś poszło nie tak; nie istnieje
не найдена; доступ запрещен; доступ запрещён; ошибка сервера; недоступен; что-то пошло не так; не существует
"""
SCRIPTS = """
javascript; js; scripting; scripts; script support; client-side code; скрипты; skrypty; los scripts; les scripts; gli script; os scripts
"""
DEMANDS = """
requires; needs; depends on; relies on; cannot work without; does not work without; doesn't work without; without; enable; enabled; disabled; is required; activate; allow; turn on; turned on; turned off; switch on; switched on; switched off; unblock; does not support; doesn't support; does not run; doesn't run
aktivieren; schalten sie; einschalten; deaktiviert; benötigt; unterstützt kein; activez; activer; désactivé; nécessite; ne prend pas en charge; activa; active; activar; habilite; habilita; desactivado; requiere; no admite; ative; ativar; desativado; não suporta; requer; attiva; abilita; disattivato; richiede; non supporta; schakel; zet; inschakelen; vereist; ondersteunt geen; włącz; włączyć; wyłączony; wymaga; nie obsługuje; включите; отключен; требуется; не поддерживает
"""
FILLERS = """
coming soon; to follow; will follow; more to come; will be added soon; to be added; to be written; to be announced; to be defined; to be done; to be completed; tba; tbd; t.b.d.; t.b.a.; tbc; tk; wip; todo; fixme; n.n.; xxx; work in progress; under construction; pending review; no content yet; no text yet; no description yet; empty on purpose; author will deliver; missing paragraph; write this; replace before publishing
goes here; goes in here; copy goes; text here; description here; title here; insert text; sample sentence; sample paragraph; sample text; dummy line; dummy text; body copy; headline follows; title / subtitle / body; one two three four; text text; blah blah; bla bla; test test; asdf; qwerty; foo bar baz; placeholder; placeholder text
platzhalter; demnächst; folgt; folgt in kürze; noch kein text; hier steht bald; in vorbereitung; bientôt disponible; à venir; à compléter; à rédiger; en préparation; próximamente; por completar; texto pendiente; en preparación; marcador de posición; em breve; a completar; texto a definir; em preparação; espaço reservado; prossimamente; da completare; in arrivo; in preparazione; segnaposto; binnenkort beschikbaar; in te vullen; tekst volgt; in voorbereiding; tijdelijke tekst; wkrótce; do uzupełnienia; w przygotowaniu; tekst zastępczy; скоро; скоро будет; будет позже; здесь будет текст; заполнитель
"""
LATIN = """
lorem; lorem ipsum; dolor sit amet; consectetur adipiscing elit; sed do eiusmod; ut labore et dolore; ut enim ad minim; quis nostrud; duis aute irure; excepteur sint occaecat; sunt in culpa; sed ut perspiciatis; omnis iste natus; nemo enim ipsam; at vero eos et accusam; accusamus et iusto odio; neque porro quisquam; temporibus autem
"""
COMPANIONS = """
error; status; code; http; erreur; fehler; errore; erro; fout; błąd; ошибка; sorry; oops; hmm; fatal; please; apache; nginx; page; site; website; lesson; document; file; view; content; resource; template; url; address; link; server; service; upstream; gateway; content store; session; connection; response; renderer; partial; request; requested; client; rate limit; timeout; property; body; lesson.body; draft; some; text; title; description; section; paragraph; chapter; line; sentence
you asked for; you are looking for; you're looking for; you were looking for; you tried to open; asked for; looking for; waiting; while reading the response; stopped; maintenance; answer; access; open; sign in; log in; to read on; see; view; display; displayed; shown; can be; cannot be; try again; again; later; moments; moment; minutes; seconds; takes about; about; a few; just; while; verify; that; this; these; our side; on our side; on our end; side; back; continue; complete; nothing; gave; lives; moved; usable; no; something; down; temporarily; on purpose; author; here; follow; soon; still; yet; only; notice; run; runs; work; works; properly; correctly; use; support; browser; app; application; player; viewer; course viewer; course; cookies; reload; hidden; stays hidden; until; so; if nothing happens; need to; must; to go on; your; our; we're; we are; we; you; it; an; a; the; of; to; is; are; be; been; was; were; has; have; and; or; but; by; with; on; in; at; for; from; as; off
seite; angeforderte; dienst; zurzeit; vorübergehend; diese; dieser; ihr; ihrem; bitte; sie; um fortzufahren; um; im; inhalt; beschreibung; hier; bald; vorhanden; ein; eine; die; der; das; ist; ein text; page; que vous cherchez; vous; cherchez; demandée; pour continuer; de votre navigateur; dans votre navigateur; votre; navigateur; contenu; texte; la; le; cette; est; service; temporairement; página; solicitada; servicio; que busca; para ver esta lección; para continuar; su; en tu navegador; en su navegador; navegador; contenido; texto; el; esta; se; que procura; procura; solicitada; serviço; conteúdo; no seu navegador; no navegador; a página; não; pagina; richiesta; servizio; per continuare; nel browser; il tuo; contenuto; testo; il; è; dienst; opgevraagde; om door te gaan; in je browser; in uw browser; uw; inhoud; tekst; de; deze; het; strona; strony; żądana; usługa; usługi; obsługę; wewnętrzny; aby kontynuować; w przeglądarce; przeglądarka; treść; opis; страница; запрошенная; внутренняя; сервис; временно; чтобы продолжить; в браузере; браузер; пожалуйста; текст; здесь; test; blah; bla
"""
#: Words with which an error is told as content: its condition, meaning or cause.
TOLD = re.compile(r"\b(?:if (?:the|a|an|your|its|one|no|any)|when(?:ever)?|unless|means?|usually|returns?|answers|responds|whether|wenn|falls|cuando|lorsque|quando|gdy|jeśli|eсли|если|когда|кoгдa)\b", re.I)
# Marks with which a placeholder or a value rendered from nothing begins.
ANCHORS = ("{", "<%", "[%", "[[", "@@", "__", "%", "[insert ", "[enter ", "[add ", "[your ", "[type ", " here]", "<enter ", "<insert ", "<your ", "<add ", "<type ", "(add ", "(insert ", "(enter ", "xxx ", "your ", "<!--", "[object object]", "#ref", "#value", "#name", "#num", "#null", "#div/0", "#n/a", "undefined", "null", "none", "nan", "hello", "hi ", "dear", "welcome", "learn")


@functools.cache
def automaton():
    """All phrases in their consistent form and all anchors; the payload is (length, kind): a kind that decides, demand, anchor or None."""
    import ahocorasick

    built = ahocorasick.Automaton()
    for anchor in ANCHORS:
        built.add_word(anchor, (len(anchor), "anchor"))
    for kind, text in ((None, COMPANIONS), ("demand", DEMANDS), ("latin", LATIN), ("filler", FILLERS), ("script", SCRIPTS), ("error", ERRORS)):
        for phrase in re.split(r"[;\n]", text):
            phrase = uniform(phrase).strip().lower()
            if phrase:
                # A phrase that is an anchor too is both.
                built.add_word(phrase, (len(phrase), f"{kind} anchor" if phrase in ANCHORS else kind))
    built.make_automaton()
    return built


_NAME = r"[A-Za-z][\w .\-@]*"
# Placeholders of common template languages and of authors.
TEMPLATE = re.compile(
    rf"""\{{\{{\s*[.#/^&>]?\s*{_NAME}(?:\s*\|[^{{}}]*)?\s*\}}\}}|\{{%-?\s*{_NAME}[^%]*%\}}|<%[=\-#]?\s*@?{_NAME}[^%]*%>|\[%\s*{_NAME}[^%]*%\]|\$\{{\s*{_NAME}\s*\}}|\{{\d+\}}|\{{{_NAME}\}}
    |\[\[\s*{_NAME}\s*\]\]|@@\s*{_NAME}\s*@@|\b__[A-Z][A-Z0-9_]*[A-Z0-9]__\b|(?<![\w%])%[A-Z][A-Z0-9_]+%|(?<![\w%])%(?:\d+\$)?[sd](?!\w)
    |\[(?:insert|enter|add|your|type)\s[^\[\]\n]{{2,60}}\]|\[[^\[\]\n]{{2,60}}\s(?:goes|comes|go)\shere\]|\[[^\[\]\n]{{2,40}}\shere\]|<(?:enter|insert|your|add|type)\s[^<>\n]{{2,60}}>
    |\((?:add|insert|enter)\s(?:the\s|your\s)?[A-Za-z][\w ]{{2,30}}\)|\bXXX\s[^\n]{{2,40}}?\sXXX\b|\bYOUR(?:\s[A-Z]+){{1,4}}\sHERE\b|<!--[^>]*\b(?:here|todo|tbd|lead|text|placeholder)\b[^>]*-->""".replace("\n    ", ""),
    re.I,
)
_CASED = re.compile(r"\b__[A-Z]|%[A-Z][A-Z0-9_]+%|XXX|YOUR")
# Values rendered from nothing: alone, in a frame that needs a value, or two in a unit.
_NOTHING = r"(?:undefined|null|None|NaN)"
HOLES = re.compile(
    rf"\[object Object\]|#(?:REF|VALUE|NAME|NUM|NULL|DIV/0)[!?]|#N/A"
    rf"|\b(?i:hello|hi|dear|welcome to|written (?:by|for)|(?:edited|published|posted|course) by|the end of|learn|learn about|(?:will|you) know|takes?|price:|author:|title:|duration:)\s+{_NOTHING}\b|\bNaN (?i:minutes|hours|days|lessons|of)\b"
    rf"|\b(?i:hello|hi|dear|welcome to|learn|learn about)\s+[,.!:](?=\s|$)"
)
_SPARE_NOTHING = re.compile(rf"\b(?:of|to|by|for|on|know|with|about|is|named|called)\s+{_NOTHING}\b")

# Words of syntax, and instructions whose object is spoken about.
_SYNTAX = r"(?:expressions?|variables?|parameters?|params?|placeholders?|tokens?|tags?|fields?|syntax|notation|strings?|literals?|braces|brackets|delimiters?|directives?|macros?|helpers?|sequences?|patterns?|arguments?|options?|keys?|attributes?|buttons?|columns?)"
_ORDER = r"(?:use|set|type|write|press|click|hit|replace|substitute|expand|print|echo|export|pass|escape|quote|format|change|rename|remove|delete|leave|read|put|call|choose|select|define|assign)"
_BEFORE = re.compile(rf"(?:\b{_SYNTAX}|\b(?:such as|like|called|named|as|expands|replaces|prints|reads|escapes|quotes|mistypes?|means)|(?:^|[,;:]\s|\band\s|\bthen\s|\bto\s(?=replace|escape|expand)){_ORDER}(?:\s[\w-]+){{0,3}}?)\s*(?:the|a|an|each|every|to|with|of)?\s*[\"'“„‘«(]?$", re.I)
_AFTER = re.compile(rf"^[\"'”“’»)]?\s*(?:\w+\s){{0,2}}(?:{_SYNTAX}\b|(?:is|are|gets?) (?:filled|replaced|expanded|read|escaped|a|an|the)\b|(?:marks?|stands?|expands?|means|differs|holds|refers|itself)\b)", re.I)
_LINKED = re.compile(r"^[\s,]*(?:and|or|[,/.:-]|for [\w ]{1,30} and)\s*[\"'“„«]?$", re.I)
_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_TAG = re.compile(r"</?(?:p|br|div|h[1-6]|li|ul|ol|tr|td|th|table|section|article|pre|blockquote|header|footer|hr)\b[^>]*>", re.I)
_INLINE = re.compile(r"</?[a-zA-Z][^<>]*>")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_UNIT = re.compile(r"""\S.*?[.!?…。]+(?=["'»”)\]]*(?:\s|$))["'»”)\]]*|\S.*""")
_WORD = re.compile(r"[^\W\d_]+")
_KEYS = re.compile(r"[qwertyuiopasdfghjkl]+")
_LATIN = re.compile(r".*(?:atur|antur|ibus|que|unt|ere|ent|int|us|um|em|am|im|ae|is|it|at|ut|os|as|es|et|o|i|a|or|ar)$")
_STRONG_LATIN = re.compile(r".*(?:atur|antur|ibus|que|unt|ere|ent|us|um|em|ae|is|it)$")
_FUNCTION = frozenset("the and of to in a is that for with on at by from this der die das und ist wird den le la les des et est une un el los las y que se de del il lo gli di che si da o e em os as do da um uma het een van en op i w na z do się jest nie w и в на не что это он с по".split()) - {"et", "in", "is", "o", "i", "a", "que", "se", "e", "as", "os", "do", "da"}


@functools.cache
def _pairs() -> dict[str, float]:
    """How much likelier a pair of letters (a blank at the ends of words) is in the phrases here than in keys struck at random, as a logarithm."""
    words = [w for text in (ERRORS, DEMANDS, FILLERS, COMPANIONS) for w in re.findall("[a-z]+", text)]
    pairs: dict[str, float] = {}
    for w in words:
        for x, y in zip(f" {w}", f"{w} ", strict=True):
            pairs[x + y] = pairs.get(x + y, 0) + 1
    keys = sorted({*"qwertyuiopasdfghjkl "})
    out = {}
    for x in keys:
        total = sum(pairs.get(x + y, 0) for y in keys)
        for y in keys:
            out[x + y] = math.log((pairs.get(x + y, 0) + 0.3) / (total + 0.3 * len(keys)) * len(keys))
    return out


def _is_mash(words: list[str], text: str) -> bool:
    """Three words or more of two rows of keys, in small letters, whose pairs of letters are hardly likelier than at random."""
    letters = "".join(words)
    if len(words) < 3 or len(letters) < 9 or _KEYS.fullmatch(letters) is None or re.search(r"\d", text):
        return False
    pairs = _pairs()
    return sum(pairs[x + y] for w in words for x, y in zip(f" {w}", f"{w} ", strict=True)) < MASH * (len(letters) + len(words))


def _is_latin(words: list[str], least: float) -> bool:
    """Five words or more with the endings of Latin, and none of the small words of living languages."""
    low = [w.lower() for w in words]
    return len(low) >= 5 and all(w.isascii() for w in low) and not _FUNCTION.intersection(low) and sum(bool(_LATIN.match(w)) for w in low) >= least * len(low) and sum(bool(_STRONG_LATIN.match(w)) for w in low) >= 0.5 * len(low)


def visible(value: str, markup: bool) -> str:
    """Text as a reader has it, one line a block; comments that may hold notes stay as lines."""
    if not markup:
        return value
    notes = "\n".join(m[0].replace("\n", " ") for m in _COMMENT.finditer(value))
    text = _INLINE.sub("", _TAG.sub("\n", _COMMENT.sub(" ", value)))
    return html.unescape(text) + ("\n" + notes if notes else "")


def units(value: str | None, markup: bool = False) -> list[tuple[str, str | None]]:
    """(unit, kind) of the units of a value; kind is template, hole, filler, error, script or None."""
    if not value or not value.strip():
        return []
    text = uniform(visible(value, markup))
    text = _CODE.sub(lambda m: " " * len(m[0]), text)
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = []
    for end, (size, kind) in automaton().iter(low):
        start = end + 1 - size
        if (kind is None or "anchor" not in kind) and ((start and low[start - 1].isalnum() and low[start].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum() and low[end].isalnum())):
            continue
        hits.append((start, end + 1, kind))
    hits.sort(key=lambda h: h[:2])
    out: list[tuple[str, str | None]] = []
    at, k = 0, 0
    for line in text.split("\n"):
        for m in _UNIT.finditer(line):
            a, b = at + m.start(), at + m.end()
            while k < len(hits) and hits[k][0] < a:
                k += 1
            mine = []
            j = k
            while j < len(hits) and hits[j][0] < b:
                if hits[j][1] <= b:
                    mine.append(hits[j])
                j += 1
            out.append((m[0], _kind(m[0], a, mine)))
        at += len(line) + 1
    return out


def _placeholders(unit: str) -> bool:
    """Whether a placeholder stands in a unit that isn't spoken about."""
    spoken, last = False, 0
    for m in TEMPLATE.finditer(unit):
        token = m[0]
        if token.startswith(("__", "%", "XXX", "YOUR", "xxx", "your")) and not re.match(r"%(?:\d+\$)?[sd]$", token) and not _CASED.match(token):
            continue
        if re.fullmatch(r"(?:\{\{|\[\[)\s*(?:and|or|to)\s*(?:\}\}|\]\])", token):
            spoken, last = True, m.end()
            continue
        spoken = bool((spoken and _LINKED.search(unit[last : m.start()])) or _BEFORE.search(unit[: m.start()]) or _AFTER.search(unit[m.end() :]))
        if not spoken:
            return True
        last = m.end()
    return False


def _kind(unit: str, a: int, hits: list[tuple[int, int, str | None]]) -> str | None:
    kinds = {kind for _, _, kind in hits if kind}
    if any("anchor" in k for k in kinds):
        if _placeholders(unit):
            return "template"
        if HOLES.search(unit) or len(_SPARE_NOTHING.findall(unit)) > 1:
            return "hole"
    if unit.strip() in ("[ ]", "[]", "[…]", "[...]"):
        return "filler"
    words = _WORD.findall(unit)
    if _is_mash(words, unit) or _is_latin(words, 0.6 if "latin" in kinds else 0.9):
        return "filler"
    decisive = {"filler" if k == "latin" else k.split()[0] for k in kinds} & {"filler", "script", "error"}
    if "demand" not in kinds:
        decisive.discard("script")
    if "error" in decisive and TOLD.search(unit):
        decisive.discard("error")
    if not decisive or unit.rstrip().endswith("?"):
        return None
    if "filler" in decisive and re.match(r"lorem ipsum(?! generator)\b", unit, re.I) and not _FUNCTION.intersection(w.lower() for w in words):
        return "filler"
    covered = bytearray(len(unit))
    for start, end, kind in hits:
        if kind != "anchor":
            covered[start - a : end - a] = b"\1" * (end - start)
    letters = [i for i, c in enumerate(unit) if c.isalpha()]
    if letters and sum(covered[i] for i in letters) >= COVERAGE * len(letters):
        return min(decisive)
    return None


RESULT = T.StructType([T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("share", T.DoubleType())])


def residue_column(value: Column, markup: bool = False) -> Column:
    """struct<kinds array<string>, share double> of a string column."""

    def judge(a: pa.Array) -> pa.Array:
        kinds, shares = [], []
        for v in a.to_pylist():
            parts = units(v, markup)
            sizes = [sum(c.isalnum() for c in u) for u, _ in parts]
            kinds.append(sorted({k for _, k in parts if k}))
            shares.append(round(sum(n for n, (_, k) in zip(sizes, parts, strict=True) if k) / max(1, sum(sizes)), 6))
        return pa.StructArray.from_arrays([pa.array(kinds, pa.list_(pa.string())), pa.array(shares, pa.float64())], ["kinds", "share"])

    return F.arrow_udf(judge, RESULT)(value)


def cases(records: DataFrame) -> DataFrame:
    """(src, key, kinds, share, exclude) of the records (src, key, value, markup) that hold residue; repeated rows count once."""
    rows = records.where("value is not null and key is not null").select("src", "key", "value", "markup").distinct()
    plain = rows.where("not markup").withColumn("found", residue_column(F.col("value")))
    marked = rows.where("markup").withColumn("found", residue_column(F.col("value"), markup=True))
    both = plain.unionByName(marked).where(F.size("found.kinds") > 0)
    by = both.groupBy("src", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("found.kinds")))).alias("kinds"), F.max("found.share").alias("share"))
    return by.withColumn("exclude", F.col("share") >= EXCLUDE)
