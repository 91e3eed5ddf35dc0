"""Candidate spans of personal data in one text, the labelers' votes on them, and their features.

Candidates are cut widely: whatever could be an item of its type by its form. Names are runs of capitalised words, or lower-case
words that begin with a given name or stand beside a strong cue. Labelers then vote, from general knowledge of how
such items are written and introduced in several languages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import regex as re

from mnemospark.llm.pii_words import COMMON_WORDS, GIVEN_NAMES, PARTICLES, TITLES

TYPES = ("email", "phone", "id_number", "address", "name")
#: How far the cues of a labeler may lie from a candidate, in characters.
REACH = 60
#: Cells that a type's features are hashed into.
CELLS = 1 << 14

_GIVEN, _PARTICLES, _COMMON, _TITLES = map(frozenset, (GIVEN_NAMES, PARTICLES, COMMON_WORDS, TITLES))

# --- candidates -------------------------------------------------------------------------------------------------

_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?| dot )"
_AT = r"(?:\s?(?:@|[\[({]\s?at\s?[\])}])\s?)"
# An address has at most 64 characters before the sign, so 32 parts, and 127 labels after it.
_EMAIL = re.compile(rf"(?<![\w.+%-])[\w+%'-]+(?:{_DOT}[\w+%'-]+){{0,31}}{_AT}[\w-]+(?:{_DOT}[\w-]+){{1,126}}", re.I)
_AT_SIGN = re.compile(r"@|[\[({]\s?at\s?[\])}]", re.I)
_AT_WORD = re.compile(r" at [\w-]+(?:\.|\s?[\[({]\s?dot| dot )", re.I)
_SPELLED = re.compile(rf"(?<![\w.+%-])[\w+%-]+(?:{_DOT}[\w+%-]+){{0,31}} at [\w-]+(?:{_DOT}[\w-]+){{1,126}}", re.I)
_PHONE = re.compile(r"(?<![\w#@./+-])(?:\+\s?)?\(?\d(?:(?!\. )[\d ().\-/]){4,22}\d(?![\w])")
_IDS = {
    "three_two_four": re.compile(r"(?<![\w-])\d{3}([- ]?)\d{2}\1\d{4}(?![\w-])"),
    "insurance": re.compile(r"(?<!\w)[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d](?!\w)"),
    "passport": re.compile(r"(?<!\w)[A-Za-z]{1,2}\d{6,8}(?!\w)"),
    "letter_last": re.compile(r"(?<![\w.])(?:\d{8}|\d{1,2}\.\d{3}\.\d{3})-?[A-Za-z](?!\w)"),
    "letters_around": re.compile(r"(?<!\w)[XYZxyz]-?\d{7}-?[A-Za-z](?!\w)"),
    "eleven": re.compile(r"(?<![\w+-])\d{2} ?\d{3} ?\d{3} ?\d{3}(?![\w-])"),
    "three_dots_dash": re.compile(r"(?<![\w.])\d{3}\.\d{3}\.\d{3}-\d{2}(?!\w)"),
    "thirteen": re.compile(r"(?<![\w+-])[12] ?\d{2} ?\d{2} ?\d[\dAB] ?\d{3} ?\d{3}(?: ?\d{2})?(?![\w-])"),
    "sixteen": re.compile(r"(?<!\w)[A-Za-z]{6}\d{2}[A-Za-z]\d{2}[A-Za-z]\d{3}[A-Za-z](?!\w)"),
}
_ID_LABEL = (
    r"(?:ssn|social security|national insurance|ni|nino|insurance|passport|passeport|pasaporte|paszport|reisepass|dni|nif|nie|national id|identity(?: card)?|id card|personalausweis|ausweis|tax id|tin|steuer-?id|"
    r"steuernummer|codice fiscale|pesel|insee|cpf|nhs|licen[cs]e|führerschein|carte d['’]identité|sécurité sociale|dowód|паспорт\w*|снилс|инн)"
)
_LABELLED = re.compile(rf"(?<!\w){_ID_LABEL}\W{{0,3}}(?:(?:no|nr|number|num|numéro|número|nummer|card|is|№|n[º°])\W{{0,3}}){{0,2}}((?=[\w.\-/ ]{{0,40}}\d{{3}})[A-Z]{{0,3}}\d[\dA-Z]*(?:[ .\-/]?[\dA-Z]*\d[\dA-Z]*)*(?:-?[A-Z](?!\w))?)", re.I)
_CAPS = r"\p{Lu}[\w'’-]*"
_KIND = r"(?:Street|St\.|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Close|Terrace|Place|Pl|Way|Square|Sq|Crescent|Parkway|Pkwy|Row|Gardens|Grove|Walk|Mews|Hill|Highway|Hwy)"
_UNIT = r"(?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Floor|Room|#)"
_OF = r"(?:(?:de las|de los|de la|de l['’]|delle|della|dell['’]|del|degli|das|dos|des|du|do|da|di|de|d['’]|la|le|les|los|las)\s?)?"
_NUMBER = r"(?:(?:n[ºo°]\.?|№|д\.) ?)?\d{1,4}\s?[a-zA-Z]?(?!\w)"
_ADDRESSES = {
    "english": re.compile(rf"(?<![\w-])(?:{_UNIT} ?\d+[A-Za-z]?, )?\d{{1,5}}[A-Za-z]? (?:{_CAPS} ){{1,3}}{_KIND}(?!\w)(?:,? {_UNIT}\s?\d+[A-Za-z]?(?!\w))?"),
    "german": re.compile(r"(?<![\w-])(?:(?:Am|An der|Im|Zum|Zur|Auf dem) )?\p{Lu}[\w-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|steig|hof|straat|laan|plein|gracht|kade)(?: Straße)? \d{1,4}\s?[a-z]?(?!\w)"),
    "german_apart": re.compile(rf"(?<![\w-]){_CAPS}(?:er|e|-\p{{L}}+) (?:Straße|Str\.|Weg|Allee|Platz|Ring|Damm|Ufer) \d{{1,4}}\s?[a-z]?(?!\w)"),
    "french": re.compile(rf"(?<![\w-])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|chemin|impasse|allée|place|quai|route|cours|passage|square) {_OF}{_CAPS}(?:[ -]{_CAPS}){{0,3}}"),
    "spanish": re.compile(rf"(?<![\w-])(?:Calle|C/|Avenida|Avda\.?|Plaza|Pza\.?|Paseo|Camino|Ronda|Rua|R\.|Praça|Travessa|Largo|Estrada|Av\.) {_OF}{_CAPS}(?: (?:{_OF}){_CAPS}){{0,3}},? {_NUMBER}(?:, (?:\d{{1,2}}[ºª°](?: ?[A-Z](?!\w))?|bajo|ático))?"),
    "italian": re.compile(rf"(?<![\w-])(?:[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Ll]argo|[Vv]icolo) {_OF}{_CAPS}(?: {_CAPS}){{0,3}},? {_NUMBER}"),
    "polish": re.compile(rf"(?<![\w-])(?:[Uu]l\.|[Aa]l\.|[Pp]l\.|[Oo]s\.|ulica|aleja) ?{_CAPS}(?: {_CAPS}){{0,3}} \d{{1,4}}[a-zA-Z]?(?:/\d{{1,4}}|(?: m\. ?\d{{1,4}}))?(?!\w)"),
    "russian": re.compile(rf"(?<![\w-])(?:ул\.|улица|пр\.|проспект|пер\.|наб\.) ?{_CAPS}(?: {_CAPS}){{0,2}},? {_NUMBER}(?:,? кв\. ?\d{{1,4}})?"),
}
_STRONG_STREET = re.compile(r"street|road|avenue|lane|drive|boulevard|blvd|stra(?:ß|ss)e|str\.|allee|gasse|straat|laan|rue |chemin|impasse|calle|avenida|avda|paseo|rua |piazza|viale|ul\.|улица|ул\.|проспект", re.I)

_CAP = r"(?:\p{Lu}[\p{L}\p{M}]+|\p{Lu}['’]\p{L}+)(?:(?!['’]s(?!\p{L}))['’\-]\p{L}+)*"
_PART = r"(?:" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + r")"
_RUN = re.compile(rf"(?<!\d )(?<![\p{{L}}\p{{N}}_@./#'’-])(?:{_CAP}|\p{{Lu}}\.)(?: (?:{_CAP}|\p{{Lu}}\.|(?:(?i:{_PART}) )+{_CAP}))+(?![\p{{L}}\p{{N}}_@])")
_TURNED = re.compile(rf"(?<![\p{{L}}\p{{N}}_@./#'’-])((?:(?i:{_PART}) ){{0,3}}{_CAP}(?: {_CAP})?), ({_CAP})((?: \p{{Lu}}\.)*)(?![\p{{L}}\p{{N}}_@-])(?! \p{{Lu}}\p{{L}})")
_LOW = r"(?:\p{Ll}\p{L}+|\p{Ll}['’]\p{L}+)(?:(?!['’]s(?!\p{L}))['’\-]\p{L}+)*"
_LOW_NAME = rf"({_LOW})((?: \p{{Ll}}\.)*(?: {_PART}){{0,3}}) ({_LOW})"
_CUE_WORDS = r"(?:meeting with|met with|met|call with|talk(?:ed)? to|spoke (?:to|with)|ask|told|who is|what did|named|signed by|written by|according to|owned by|mr|mrs|ms|dr|herr|frau|señora?|monsieur|madame|mme)"
_LOW_AFTER_CUE = re.compile(rf"(?<!\w){_CUE_WORDS}\.? (?={_LOW_NAME}(?![\w@]))")
_LOW_BEFORE_CUE = re.compile(rf"(?<![\w@.-])(?={_LOW_NAME}(?:['’]s)? (?:said|says|say|wrote|asked|birthday|prefers|mentioned|told|thinks|wants)(?!\w))")
_VERB = re.compile(r" (?:said|says|say|wrote|asked|birthday|prefers|mentioned|told|thinks|wants)(?!\w)")
_LOW_WORD = re.compile(rf"(?<![\w@.'’-]){_LOW}")
_LOW_HERE = re.compile(rf"{_LOW_NAME}(?![\w@])")
_LOW_TURNED = re.compile(rf"((?:{_PART} ){{0,3}}{_LOW}), $")

# --- words around a candidate ---------------------------------------------------------------------------------------

_BEFORE = {
    "email": re.compile(r"(?:e-?mail\w*|mail(?:to)?:?|contact|kontakt|contacto|reach\w*|via|write|écrire à|schreib\w*|escrib\w*|adresse|address|correo|courriel|reply to|send\w* to|cc|forward\w*|from|to)\W*(?:is|lautet|est|es)?\W*$|[<(]$", re.I),
    "phone": re.compile(r"(?:tel\w*|tél\w*|phone\w*|fon|call\w*|ring|dial|mobile|móvil|portable|cell\w*|fax|voicemail|whatsapp|sms|text|number\w*|numéro|número|nummer|rappeler|appel\w*|rückruf|ruf\w*|llam\w*|handy|contact|reach\w*|тел\w*)\W*(?:\w{1,4}\W+){0,3}$", re.I),
    "id_number": re.compile(rf"(?<!\w){_ID_LABEL}\W*(?:(?:no|nr|number|num|numéro|número|nummer|card|is)\W*){{0,2}}$", re.I),
    "address": re.compile(r"(?:address\w*|adresse|dirección|indirizzo|adres|live[sd]?|living|resid\w*|wohn\w*|habit\w*|vive|moved?|move to|visit\w*|deliver\w*|ship\w*|parcel|located|directions|office|home|house|place|meet\w*|at|to|in|à|in der|an der)\W*(?:(?:is|was|to|at|in|jetzt|der|goes)\W+){0,3}$", re.I),
    "name": re.compile(r"(?:according to|owner|author|birthday of|led by|met|meet\w*|with|did|who is|notes on|signed by|written by|by|is|ask\w*|tell|told|call\w*|thank\w*|dear|hi|hello|from|to|for|and|contact|manager|colleague|friend|client|patient|mit|von|bei|avec|por|con|para|chez|named?)\W*(?:(?:of|the|notes|name)\W+){0,3}$", re.I),
}
_AFTER = {
    "email": re.compile(r"^\W*(?:for|about|bounced|was|subject|if|or|asap|before|bitte|avant|por|today|tomorrow)", re.I),
    "phone": re.compile(r"^\W*(?:ask|prefer\w*|no answer|after|before|about|ext\w*|or|anytime|gewünscht|demain|mañana|yesterday|today|tomorrow)", re.I),
    "id_number": re.compile(r"^\W*(?:expires?|issued|was|is|again|on file|in the)", re.I),
    "address": re.compile(r"^(?:,? (?:\d{4,5}(?:-\d{3,4})? )?\p{Lu}\w+|,? [A-Z]{1,2}\d|\W*(?:on|at|from|until|since|in|near|opposite)\b)", re.I),
    "name": re.compile(r"^(?:['’]s(?!\w)|\W*(?:birthday|sign\w*|prefers?|said|says?|wrote|writes|asked|asks|told|thinks|wants|called|calls|replied|left|joined|agreed|mentioned|allergic|who|born|lives|works|and|hat|sagt\w*|a dit|dijo|schrieb|был\w*)(?!\w))", re.I),
}
_TITLE = re.compile(rf"(?:^|\W)(?:{'|'.join(TITLES)})\.? $", re.I)
_NOT_PERSONAL = re.compile(r"(?<!\w)(?:ticket|run|issue|batch(?: id)?|job|build|commit|window|epoch|timestamp|order|invoice|version|release|revision|page|line|row|host|port|ip|error|code|serial|sku|isbn|step|took|v|#|tokens|score|bytes|chapter|figure|table|section|pr|bug|rfc)\W*$", re.I)
_THING = re.compile(r"^\W*(?:project|release|pipeline|ledger|lane|street|road|avenue|channel|cache|team|queue|mount|service|server|system|cluster|department|inc|ltd|gmbh|corp|university|school|river|park|bridge|station|museum|hotel|api|app|\d)", re.I)
_PLACE_FIRST = re.compile(r"plaza|calle|avenida|avda|paseo|camino|ronda|rua|praça|travessa|largo|via|viale|piazza|corso|rue|place|quai|chemin|impasse|avenue|boulevard|street|road|ul|al|new|north|south|east|west|saint|lake|mount|port|puerto|san|santa|fort|upper|lower")
_TLD = re.compile(r"(?:\.|dot[\])}]?\s?)([a-z]{2,12})$", re.I)
_WORDS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


@dataclass(frozen=True)
class Candidate:
    """first, last: given and family name in lower case, of names only."""

    kind: str
    start: int
    end: int
    shape: str
    first: str = ""
    last: str = ""


def _is_given(word: str) -> bool:
    word = word.lower()
    return word in _GIVEN or ("-" in word and word.split("-")[0] in _GIVEN)


def _plain(word: str) -> str:
    return word.lower().replace("’", "'")


def _full(word: str) -> bool:
    return len(word) > 1 and word[1] != "." and word.lower() not in _PARTICLES


def _of_run(text: str, start: int, words: list[str]) -> Iterator[Candidate]:
    """Names within a run of capitalised words: given name or initial, initials and particles, family name."""
    at, places = start, []
    for w in words:
        places.append((w, at, at + len(w)))
        at += len(w) + 1
    whole = [i for i, w in enumerate(words) if _full(w)]
    next_whole = 0
    for i, (w, a, _) in enumerate(places):
        while next_whole < len(whole) and whole[next_whole] <= i:
            next_whole += 1
        low = _plain(w)
        if low in _COMMON or low in _TITLES or (low in _PARTICLES and len(w) > 1):
            continue
        for full, j in enumerate(whole[next_whole : next_whole + 2], 1):
            word, _, b = places[j]
            if _plain(word) in _COMMON or _plain(word) in _TITLES:
                break
            inner = j - i - full
            yield Candidate("name", a, b, ("initial_" if w[1:2] == "." else "") + ("family" if full == 1 else "double") + ("_inner" if inner else ""), low.rstrip("."), _plain(word))


def _names(text: str) -> Iterator[Candidate]:
    for m in _RUN.finditer(text):
        yield from _of_run(text, m.start(), m.group(0).split(" "))
    for m in _TURNED.finditer(text):
        family, given = m.group(1).split(" "), m.group(2)
        foreign = lambda w: _plain(w) in _COMMON or _plain(w) in _TITLES
        if foreign(given) or foreign(family[-1]):
            continue
        stop = m.end(3)
        if not any(foreign(w) for w in family if w.lower() not in _PARTICLES):
            yield Candidate("name", m.start(), stop, "turned", _plain(given), _plain(family[-1]))
        if len(family) > 1 and family[-2].lower() not in _PARTICLES:
            yield Candidate("name", m.end(1) - len(family[-1]), stop, "turned", _plain(given), _plain(family[-1]))
    seen = set()
    hits = [m.start() for m in _LOW_WORD.finditer(text) if _is_given(m.group(0))]
    for at in [*hits, *(m.end() for m in _LOW_AFTER_CUE.finditer(text)), *(m.start() for m in (_LOW_BEFORE_CUE.finditer(text) if _VERB.search(text) else ()))]:
        if at in seen:
            continue
        seen.add(at)
        m = _LOW_HERE.match(text, at)
        known = _is_given(_LOW_WORD.match(text, at).group(0))
        if m and _plain(m.group(3)) not in _COMMON and m.group(3) not in _PARTICLES and (known or _plain(m.group(1)) not in _COMMON) and m.group(1) not in _TITLES:
            yield Candidate("name", at, m.end(3), "low" + ("_inner" if m.group(2) else ""), _plain(m.group(1)), _plain(m.group(3)))
        if known and (t := _LOW_TURNED.search(text, max(0, at - 80), at)) and not any(w in _COMMON for w in t.group(1).split(" ") if w not in _PARTICLES):
            given = _LOW_WORD.match(text, at)
            initial = re.compile(r"(?: \p{Ll}\.)*").match(text, given.end())
            yield Candidate("name", t.start(1), initial.end(), "low_turned", _plain(given.group(0)), _plain(t.group(1).split(" ")[-1]))


def candidates(text: str) -> Iterator[Candidate]:
    if _AT_SIGN.search(text):
        for m in _EMAIL.finditer(text):
            yield Candidate("email", m.start(), m.end(), "signed" if "@" in m.group(0) else "bracketed")
    if _AT_WORD.search(text):
        for m in _SPELLED.finditer(text):
            yield Candidate("email", m.start(), m.end(), "spelled" if "dot" in m.group(0).lower() else "bare_at")
    if any(c.isdigit() for c in text):
        for m in _PHONE.finditer(text):
            raw, start = m.group(0), m.start()
            if raw.count("(") > raw.count(")"):
                cut = raw.index("(") + 1
                raw, start = raw[cut:], start + cut
            while raw.count(")") > raw.count("("):
                raw = raw[: raw.rindex(")")]
            raw = raw.rstrip(" ().-/")
            if 6 <= sum(c.isdigit() for c in raw) <= 15:  # fixed value: no number of the public network is longer
                yield Candidate("phone", start, start + len(raw), "digits")
        held = set()
        for shape, pattern in _IDS.items():
            for m in pattern.finditer(text):
                held.add((m.start(), m.end()))
                yield Candidate("id_number", m.start(), m.end(), shape)
        for m in _LABELLED.finditer(text):
            if m.span(1) not in held and 5 <= sum(c.isdigit() for c in m.group(1)):
                yield Candidate("id_number", m.start(1), m.end(1), "labelled")
        for shape, pattern in _ADDRESSES.items():
            for m in pattern.finditer(text):
                yield Candidate("address", m.start(), m.end(), shape)
    yield from _names(text)


# --- labelers -------------------------------------------------------------------------------------------------------

LABELERS = {
    "email": ("signed", "obfuscated", "domain", "before", "after", "versionlike"),
    "phone": ("international", "national", "american", "grouped", "before", "after", "datelike", "plain", "other_number"),
    "id_number": ("shape", "label", "checksum", "after", "other_number"),
    "address": ("street", "before", "after", "unit", "other_number"),
    "name": ("gazetteer", "title", "before", "after", "initial", "thing", "case"),
}
#: Labelers of names that vote by the whole corpus: how freely given and family names combine, and words seen in lower case.
CORPUS_LABELERS = ("company", "lower")

# Check letters of Spanish identity numbers, by the number's remainder.
_CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _checks(span: str, shape: str) -> bool:
    """Whether a number of a kind with check digits has the right ones."""
    raw = re.sub(r"[\W_]", "", span).upper()
    digits = [int(c) for c in raw if c.isdigit()]
    if shape == "letter_last":
        return _CHECK_LETTERS[int(raw[:-1]) % 23] == raw[-1]
    if shape == "letters_around":
        return _CHECK_LETTERS[int(str("XYZ".index(raw[0])) + raw[1:-1]) % 23] == raw[-1]
    if shape == "thirteen" and len(digits) == 15:
        return 97 - int(raw[:13]) % 97 == int(raw[13:])
    if shape == "eleven" and len(digits) == 11:
        return (10 - sum(d * w for d, w in zip(digits, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3))) % 10) % 10 == digits[10]
    if shape == "three_dots_dash":
        one = sum(d * w for d, w in zip(digits, range(10, 1, -1))) * 10 % 11 % 10
        return one == digits[9] and sum(d * w for d, w in zip(digits, range(11, 1, -1))) * 10 % 11 % 10 == digits[10]
    return False


def votes(c: Candidate, text: str) -> list[int]:
    """One vote for each labeler of the candidate's type: 1 for, -1 against, 0 none."""
    span = text[c.start : c.end]
    left, right = text[max(0, c.start - REACH) : c.start], text[c.end : c.end + REACH]
    before, after = int(bool(_BEFORE[c.kind].search(left))), int(bool(_AFTER[c.kind].search(right)))
    foreign = -int(bool(_NOT_PERSONAL.search(left)))
    if c.kind == "email":
        top = _TLD.search(span)
        number = re.search(r"\d+\.\d+", re.split(r"@|\bat\b", span)[-1]) is not None
        return [int(c.shape == "signed"), {"bracketed": 1, "spelled": 1, "bare_at": -1}.get(c.shape, 0), 1 if top else -1, before, after, -int(number or not top)]
    if c.kind == "phone":
        digits = re.sub(r"\D", "", span)
        groups = re.findall(r"\d+", span)
        abroad = bool(re.match(r"\+\s?\d|00[1-9]", span)) and 9 <= len(digits) <= 15
        home = span.lstrip("(")[0] == "0" and digits[1:2] != "0" and 9 <= len(digits) <= 12 and len(groups[0]) in (2, 3, 4, 5, 10, 11)
        american = bool(re.fullmatch(r"(?:\+?1[-. ]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[-. ])[2-9]\d{2}[-. ]\d{4}", span))
        date = bool(re.fullmatch(r"(?:19|20)\d{2}[-./]?\d{2}[-./]?\d{2,4}(?:[-. ]\d{4,6})?|\d{1,2}[-./]\d{1,2}[-./](?:19|20)?\d{2}|\d{1,3}(?:\.\d{1,3}){3}|\d{3}[- ]\d{2}[- ]\d{4}|\d{3,4}-\d{3,4}", span))
        plain = span.isdigit() and span[0] != "0"
        return [int(abroad), int(home), int(american), int(len(groups) in (3, 4, 5, 6) and len(digits) >= 8), before, after, -int(date), -int(plain or len(digits) < 8), foreign]
    if c.kind == "id_number":
        strong = {"insurance": 1, "letter_last": 1, "letters_around": 1, "passport": 1, "three_dots_dash": 1, "sixteen": 1, "three_two_four": 0 if span.isdigit() else 1}.get(c.shape, 0)
        return [strong, before, int(_checks(span, c.shape)), after, foreign]
    if c.kind == "address":
        return [1 if _STRONG_STREET.search(span) else 0, before, after, int(bool(re.search(rf"{_UNIT}|º|кв\.", span))), foreign]
    words = [w for w in _WORDS.findall(span) if len(w) > 1 and w.lower() not in _PARTICLES]
    cased = all(w[0].isupper() for w in words)
    thing = bool(_THING.search(right) or _THING.search(c.last) or _PLACE_FIRST.fullmatch(c.first)) or any(w.lower() in _COMMON for w in words)
    if c.shape.endswith("double") or c.shape.startswith("double"):
        thing = thing or not _is_given(c.first)
    return [int(_is_given(c.first)), int(bool(_TITLE.search(left))), before, after, int("initial" in c.shape or "inner" in c.shape), -int(thing), 0 if cased or span == span.lower() else -1]


def encode(v: list[int]) -> int:
    """Votes as one number, three values a labeler."""
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def decode(code: int, n: int) -> list[int]:
    return [code // 3**i % 3 - 1 for i in range(n)]


# --- features -------------------------------------------------------------------------------------------------------

_SHAPES = ((re.compile(r"\p{Lu}+"), "X"), (re.compile(r"\p{Ll}+"), "x"), (re.compile(r"\d"), "9"))
_LEFT = re.compile(r"(\S+)\s+(\S+)\s*$|(\S+)\s*$")
_SIDE = re.compile(r"[^\W_]+|[^\w\s]")


def _form(span: str) -> str:
    for pattern, sign in _SHAPES:
        span = pattern.sub(sign, span)
    return span[:32]


def features(c: Candidate, text: str) -> list[int]:
    """Hashed features of a span's form and of the words beside it."""
    span = text[c.start : c.end]
    left, right = _SIDE.findall(text[max(0, c.start - REACH) : c.start])[-3:], _SIDE.findall(text[c.end : c.end + REACH])[:3]
    left = [re.sub(r"\d", "0", w.lower()) for w in left]
    right = [re.sub(r"\d", "0", w.lower()) for w in right]
    found = [f"shape {c.shape}", f"form {_form(span)}", f"length {len(span) // 4}", f"left {' '.join(left[-1:])}", f"left2 {' '.join(left[-2:])}", f"right {' '.join(right[:1])}", f"right2 {' '.join(right[:2])}", f"start {c.start == 0}", f"end {c.end == len(text)}"]
    found += [f"near {w}" for w in left] + [f"next {w}" for w in right]
    if c.kind == "name":
        found += [f"first {c.first}", f"first- {c.first[-2:]}", f"last- {c.last[-3:]}", f"last-- {c.last[-2:]}", f"cap {span.isupper()}"]
    elif c.kind == "phone":
        found += [f"groups {[len(g) for g in re.findall(r'\d+', span)]}", f"head {span[:2]}"]
    elif c.kind == "email":
        found += [f"top {span.lower()[-4:]}"]
    return [zlib.crc32(f.encode()) % CELLS for f in found]
