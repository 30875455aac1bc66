"""Personal information inside free text: e-mail addresses, phone numbers, identity numbers, addresses and names.

Regular expressions propose spans by their shape, checksums confirm or weaken numbers, words beside a span raise or lower
its score; spans that reach THRESHOLD are kept, overlaps go to the surer kind. Texts are matched in a folded form
(full-width characters, dashes, blanks and invisible characters made equal) that remembers where each character stood.

A name is proposed wherever capitalised words stand side by side, and behind titles, greetings and introductions also
for a single or an uncapitalised word; the WEIGHTS of its shape and its neighbours add up to its score. Nothing depends
on whole sentences: each cue is a word or two beside the span.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import compress, product
from typing import NamedTuple
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

THRESHOLD = 0.5
KINDS = ("email", "id_number", "phone", "address", "name")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


# Characters that are folded, titles, labels and contexts in the six languages of the texts.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\uff0d"
BLANK = "\t\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
PARTICLES = "von|van|der|den|de|del|la|le|du|di|da|фон|вон|ван|де|ла|дер"
TITLES = "mr|mrs|ms|miss|dr|prof|herr|frau|mme|mlle|sr|sra|srta|dra|el sr|la sra|el dr|la dra|г-н|г-жа|господин|госпожа|инженер|доктор|профессор"
SURE_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Dra|Г-н|Г-жа|г-н|г-жа"
ID_LABELS = (
    "passport|ssn|social security number|social security|tax id|national id|id number|id no|id card|identity card|dni|nif|nie|iban|pasaporte|n\\.º de identidad|documento de identidad"
    "|reisepass|ausweis-nr|ausweisnummer|personalausweis|personalkennziffer|passeport|carte d'identité|n° d'identité|numéro d'identité"
    "|паспорт|удостоверение|ид|инн|снилс|旅券番号|身分証番号|id番号|マイナンバー"
)
NOT_PERSONAL = "part|order|invoice|item|serial|ref|version|page|article|teil|auftrag|bestellung|rechnung|pièce|commande|facture|pieza|pedido|factura|деталь|заказ|счёт|部品|注文"
PHONE_WORDS = (
    "phone|tel|call|fax|reach|mobile|cell|dial|text|ring|whatsapp|hotline|shift|telefon|handy|rufen|erreichbar|durchwahl|nachtschicht|appelez|joignable|portable|nuit"
    "|llame|llamar|teléfono|móvil|número|noche|звоните|звонить|телефон|факс|смена|電話|夜勤|ファックス|携帯"
)
#: What may stand between a label and its number.
JOINING = "is|was|are|number|no|nr|num|code|reads|with|the|ist|lautet|war|nummer|est|était|numéro|le|la|es|era|número|el|номер|это|был"

_FOLD = {c: "-" for c in map(ord, DASHES)} | {c: " " for c in map(ord, BLANK)} | {k: chr(k - 0xFEE0) for k in range(0xFF01, 0xFF5F)} | {0x2019: "'", 0x2018: "'", 0x02BC: "'"}


_DROPPED = regex.compile(f"[{INVISIBLE}]+|(?<= ) +")


def fold(text: str) -> tuple[str, Sequence[int]]:
    """The folded text and, for each of its characters, the place in text: where a letter and its marks are one character
    in it, the letter's."""
    chars = text if text.isascii() and "\t" not in text and "\r" not in text else text.translate(_FOLD)
    composed = chars.isascii() or is_normalized("NFC", chars)
    if composed and not _DROPPED.search(chars):
        return chars, range(len(chars))
    keep = np.ones(len(chars), bool)
    for m in _DROPPED.finditer(chars):
        keep[m.start() : m.end()] = False
    if not composed:
        out = list(chars)
        for m in regex.finditer(r"\p{L}\p{M}+", chars):
            if len(one := normalize("NFC", m[0])) == 1:
                out[m.start()], keep[m.start() + 1 : m.end()] = one, False
        chars = "".join(out)
    return "".join(compress(chars, keep)), np.flatnonzero(keep)


def luhn(digits: str) -> bool:
    """Whether the digits, 13 at least, end in their Luhn check digit."""
    if len(digits) < 13 or len(set(digits)) == 1:
        return False
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without blanks leaves 1 modulo 97."""
    if not regex.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", iban):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def mod23(text: str) -> bool:
    """Whether eight digits are followed by their check letter of the Spanish identity number."""
    m = regex.fullmatch(r"(\d{8})-?([A-Z])", text)
    return bool(m) and "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[1]) % 23] == m[2]


# -- e-mail ------------------------------------------------------------------------------------------------------------
_LOCAL, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}", r"[A-Za-z0-9-]{1,63}"
EMAILS = [
    (regex.compile(rf"{_LOCAL}(?:@| @ ){_LABEL}(?:\.{_LABEL})+"), 0.9),
    (regex.compile(rf"(?i){_LOCAL} ?[\[({{] ?at ?[\])}}] ?{_LABEL}(?:(?:\.| dot | ?[\[({{] ?dot ?[\])}}] ?){_LABEL})+"), 0.9),
    (regex.compile(rf"(?i){_LOCAL}(?: at |@| @ ){_LABEL}(?: dot {_LABEL})+"), 0.8),
]


def _emails(text: str) -> Iterator[Span]:
    low = text.lower()
    # What a pattern's matches must hold; looking for a word is far cheaper than matching a pattern.
    there = "@" in text, "at" in low and _BRACKETED(low), " dot " in low
    for (pattern, score), some in zip(EMAILS, there, strict=True):
        for m in pattern.finditer(text) if some else ():
            yield Span("email", m.start(), m.end(), score)


_BRACKETED = regex.compile(r"[\[({] ?at ?[\])}]").search


# -- phone -------------------------------------------------------------------------------------------------------------
_BEFORE, _EXT = r"(?=[\d(])(?<![A-Za-z0-9+.,/#-])(?<!\d[ )])(?<!\d\) )", r"(?: ?(?:ext|extn|x|доб|app|poste)\.? ?\d{1,5})?"
_AFTER = rf"{_EXT}(?!\d)(?![ .-]\d{{3}})"
#: Shapes of national and international numbers, each with its score without any word beside it.
PHONES = [
    # + and 00: country code, then two to six groups.
    (regex.compile(rf"(?<![A-Za-z0-9+.,/#-])\+\d{{1,3}}(?:[ .\-/]{{0,3}}\(?\d{{1,6}}\)?){{2,6}}{_EXT}(?!\d)"), 0.7),
    (regex.compile(rf"{_BEFORE}00[1-9]\d{{0,2}} \d{{2,3}}[ /-]\d{{5,}}(?:[ -]\d{{2,4}})*{_EXT}(?!\d)"), 0.6),
    # North America: area code of its own, with or without 1 before it; local numbers of seven digits.
    (regex.compile(rf"{_BEFORE}(?:1[ .-]?)?(?:\([2-9]\d{{2}}\)[ -]?[2-9]\d{{2}}[ .-]|[2-9]\d{{2}}-[2-9]\d{{2}}-|[2-9]\d{{2}}\.[2-9]\d{{2}}\.|[2-9]\d{{2}} [2-9]\d{{2}} )\d{{4}}{_AFTER}"), 0.55),
    (regex.compile(rf"{_BEFORE}(?:[2-9]\d{{2}}[ -]|\([2-9]\d{{2}}\) ?)\d{{4}}{_AFTER}"), 0.35),
    # Great Britain: London, cities, towns, mobiles.
    (regex.compile(rf"{_BEFORE}\(?0(?:2\d\)? ?\d{{4}}[ -]\d{{4}}|1\d1\)?[ -]\d{{3}}[ -]\d{{4}}|11\d\)?[ -]\d{{3}}[ -]\d{{4}}|1\d{{3}}\)? \d{{3}} ?\d{{2,3}})(?!\d){_EXT}"), 0.55),
    (regex.compile(rf"{_BEFORE}07\d{{3}}[ -]\d{{3}} ?\d{{3}}{_EXT}(?!\d)"), 0.6),
    # Germany: area code and number of any length, parted by a blank, a slash or a hyphen.
    (regex.compile(rf"{_BEFORE}(?:\(0\d{{2,4}}\) ?|0\d{{2,4}} ?/ ?)\d{{3,8}}(?:[ -]\d{{1,5}}){{0,2}}{_EXT}(?!\d)"), 0.55),
    (regex.compile(rf"{_BEFORE}0\d{{2,4}} ?[- ] ?\d{{5}}[ -]?\d{{3}}{_EXT}(?!\d)"), 0.55),
    (regex.compile(rf"{_BEFORE}0[2-9]\d{{1,3}}[- ]\d{{4,8}}(?:[ -]\d{{1,4}})?{_EXT}(?!\d)"), 0.35),
    # France and Spain: pairs or threes of digits.
    (regex.compile(rf"{_BEFORE}0[1-9](?:[ .-]\d{{2}}){{4}}{_EXT}(?!\d)"), 0.6),
    (regex.compile(rf"{_BEFORE}[6-9]\d{{2}}(?:(?:[ .]\d{{2}}){{3}}|(?:[ .-]\d{{3}}){{2}}){_EXT}(?!\d)"), 0.35),
    # Russia: 8 in place of +7. Japan: 0 and three groups.
    (regex.compile(rf"{_BEFORE}8[ -]?\(?\d{{3}}\)?[ -]?\d{{3}}-\d{{2}}-\d{{2}}{_EXT}(?!\d)"), 0.55),
    (regex.compile(rf"{_BEFORE}0(?:[5-9]0-\d{{4}}|\d-\d{{4}}|\d{{2}}-\d{{3,4}}|\d{{3}}-\d{{2,3}}|120-\d{{3}}|800-\d{{3}})-\d{{3,4}}{_EXT}(?!\d)"), 0.55),
    # Digits without any sign between them.
    (regex.compile(rf"{_BEFORE}0?\d{{9,10}}(?![\d-])"), 0.3),
]
#: Seven digits with no more than a few signs between them.
_DIGITS = regex.compile(r"\d(?:[ ().+/-]{0,4}\d){6}").search
_STRETCH = regex.compile(r"[+(]?\d[\d ().+/-]{5,}\d")
_PHONE_WORDS = regex.compile(rf"(?i)(?:{PHONE_WORDS})")
_NOT_PERSONAL = regex.compile(rf"(?i)(?:{NOT_PERSONAL})[ .:#]{{0,3}}$")
#: A number that fills a line or a field of its own.
_ALONE = regex.compile(r"(?:^|[\n|;\t] ?)$"), regex.compile(r" ?(?:[\n|;\t]|$)")


def _phones(text: str) -> Iterator[Span]:
    # Only stretches of digits and signs are searched, with room for an extension behind them.
    runs = [(r.start(), r.end()) for r in _STRETCH.finditer(text) if sum(c.isdigit() for c in r[0]) >= 7] if _DIGITS(text) else []
    for (start, end), (pattern, base) in product(runs, PHONES):
        for m in pattern.finditer(text, start, end + 16):
            if m.start() >= end or not 7 <= sum(c.isdigit() for c in m[0]) <= 20:
                continue
            score = base
            if _PHONE_WORDS.search(text[max(0, m.start() - 30) : m.start()]) or _PHONE_WORDS.search(text[m.end() : m.end() + 10]):
                score += 0.2
            elif _ALONE[0].search(text[max(0, m.start() - 2) : m.start()]) and _ALONE[1].match(text, m.end()):
                score += 0.15
            if _NOT_PERSONAL.search(text[max(0, m.start() - 14) : m.start()]):
                score -= 0.6
            yield Span("phone", m.start(), m.end(), score)


# -- identity numbers --------------------------------------------------------------------------------------------------
_VALUE = (
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|\d{4}[ -]\d{4}[ -]\d{4}(?:[ -]\d{4})?|[A-Z] \d{3} \d{3} \d{2}|[A-Z]{1,2}-?\d{6,8}[A-Z]?"
    r"|\d{8}-?[A-Z]|\d{3}-\d{2}-\d{4}|\d{6}[-+]\d{4}|\d{3} \d{3} \d{3}(?: \d{2})?|\d{8,16}"
)
LABELLED = regex.compile(
    rf"(?i)(?<![\p{{Latin}}\p{{Cyrillic}}\d])(?:{ID_LABELS})(?:[ :.,()#№\n]{{0,3}}(?:は|が|番号|n[o°º]|(?:{JOINING})(?!\p{{L}}))){{0,3}}[ :.()#№\n]{{0,4}}(?-i:(?P<v>{_VALUE}))(?![\d])"
)
UNLABELLED = regex.compile(rf"(?=\d|[A-Z]{{1,2}}[\d -])(?<![\p{{L}}\d.+/-])(?P<v>{_VALUE})(?![\p{{L}}\d])")


#: Five digits in a row but for a blank or a hyphen, or the head of an account number.
_NUMBERS = regex.compile(r"\d(?:[ -]?\d){4}|[A-Z]{2}\d{2} ?[A-Z0-9]{4}").search
#: What a number with check digits lies in.
_ID_STRETCH = regex.compile(r"(?<![A-Z])[A-Z]{0,2}\d[\dA-Z -]{6,}")
_LABEL_WORDS = regex.sub(r"\\", "", ID_LABELS).split("|")


def _doubtful(value: str) -> bool:
    """Whether a number has the shape of one with check digits or reserved parts, and breaks their rule."""
    bare = regex.sub("[ -]", "", value)
    if regex.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", bare):
        return not mod97(bare)
    if regex.fullmatch(r"\d{8}-?[A-Z]", value):
        return not mod23(value)
    if regex.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        return value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000"
    return regex.fullmatch(r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", value) is not None and not luhn(bare)


def _ids(text: str) -> Iterator[Span]:
    if not _NUMBERS(text):
        return
    low = text.lower()
    for m in LABELLED.finditer(text) if any(w in low for w in _LABEL_WORDS) else ():
        yield Span("id_number", m.start("v"), m.end("v"), 0.9 - 0.3 * _doubtful(m["v"]))
    for m in (m for r in _ID_STRETCH.finditer(text) for m in UNLABELLED.finditer(text, r.start(), r.end() + 1)):
        bare = regex.sub("[ -]", "", m["v"])
        if (bare.isdigit() and luhn(bare)) or mod97(bare) or mod23(m["v"]):
            score = 0.7 - 0.6 * bool(_NOT_PERSONAL.search(text[max(0, m.start() - 14) : m.start()]))
            yield Span("id_number", m.start(), m.end(), score)


# -- addresses ---------------------------------------------------------------------------------------------------------
_CAP, _TOWN = r"[\p{Lu}][\p{L}'.-]*", r"[\p{Lu}][\p{L}'-]+(?: [\p{Lu}][\p{L}'-]+){0,2}"
ADDRESSES = [
    regex.compile(
        rf"(?<![\p{{L}}\d.,/-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d{{1,4}}[A-Za-z]?, )?\d{{1,4}}[A-Za-z]? (?:{_CAP} ){{1,4}}(?:(?:St|Rd|Ave|Ln|Blvd)\b\.?|(?:Street|Road|Avenue|Lane|Drive|Way|Court|Place|Square|Boulevard|Close|Terrace|Crescent)\b)"
        rf"(?:,? {_TOWN}(?:,? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?| \d{{4,6}}| [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}})(?![\p{{L}}\d])|, {_TOWN}(?![\p{{L}}\d]))?"
    ),
    regex.compile(
        rf"(?<![\p{{L}}\d-])(?:(?:[\p{{Lu}}][\p{{L}}-]*(?:straße|strasse|str\.|platz|weg|gasse|allee|ring|ufer|damm))|(?:(?:Am|An der|Auf dem|Im|In der|Zum|Zur|Unter den) (?!Tag|Raum|Jahr|Schritt|Kapitel)[\p{{Lu}}][\p{{L}}-]+)) \d{{1,4}}(?: ?[a-z](?!\p{{L}}))?"
        rf"(?:, \d{{5}} {_TOWN})?"
    ),
    regex.compile(rf"(?<![\p{{L}}\d.,/-])\d{{1,4}}(?: ?bis| ?ter)?,? (?:rue|bd|boulevard|avenue|av\.|chemin|place|quai|allée|impasse|route) (?:(?:de|du|des|la|le|les|d'|l') ?){{0,2}}{_CAP}(?: {_CAP}){{0,3}}(?:, \d{{5}} {_TOWN})?"),
    regex.compile(rf"(?<![\p{{L}}\d])(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.|Paseo|Camino|Ronda)(?: (?:de|del|la|las|los|el))* {_CAP}(?: {_CAP}){{0,3}},? (?:n\.?[º°] ?)?\d{{1,4}}[a-z]?(?:, \d{{5}} {_TOWN})?"),
    regex.compile(r"(?<![\p{L}\d])(?:ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|бульвар|б-р|наб\.|пл\.|площадь|шоссе) ?[А-ЯЁ][\p{L}-]*(?: [А-ЯЁ][\p{L}-]*)?, ?(?:д\.|дом) ?\d+[а-я]?(?:, ?кв\. ?\d+)?"),
    regex.compile(r"(?:[\p{Han}]{2,3}[都道府県])?(?:[\p{Han}]{1,5}[市区])?(?!住所)[\p{Han}]{1,8} ?\d{1,3}丁目 ?\d{1,3}(?:[-番]\d{1,3}){0,2}号?"),
]


#: What a text must hold for the pattern of the same place; looking for a word is far cheaper than matching.
_STREETS = [
    regex.compile(w).search
    for w in (
        r"\b(?:St|Street|Rd|Road|Ave|Avenue|Ln|Lane|Drive|Way|Court|Place|Square|Blvd|Boulevard|Close|Terrace|Crescent)\b",
        r"(?:straße|strasse|str\.|platz|weg|gasse|allee|ring|ufer|damm|(?:Am|An der|Auf dem|Im|In der|Zum|Zur|Unter den) \p{L}+) \d",
        r"(?:rue|bd|boulevard|avenue|av\.|chemin|place|quai|allée|impasse|route) ",
        r"Calle|C/|Avda|Avenida|Plaza|Pza|Paseo|Camino|Ronda",
        r"(?:д\.|дом) ?\d",
        "丁目",
    )
]


def _addresses(text: str) -> Iterator[Span]:
    for pattern, there in zip(ADDRESSES, _STREETS, strict=True):
        if not there(text):
            continue
        for m in pattern.finditer(text):
            yield Span("address", m.start(), m.end() - (m[0][-1] == "." and pattern is not ADDRESSES[0]), 0.8)


# -- names -------------------------------------------------------------------------------------------------------------
#: What adds up to the score of a name.
WEIGHTS = {
    "words": 0.3,  # two capitalised words or more, or an initial and a word
    "word": 0.0,  # one word
    "initial": 0.1,
    "title": 0.5,
    "introduced": 0.5,  # my name is
    "greeted": 0.4,  # Dear, Kind regards
    "named": 0.25,  # by, according to, ask for, met
    "label": 0.25,  # a word and a colon before it
    "field": 0.25,  # a field or a line of its own
    "listed": 0.25,  # beside another name in a list
    "deed": 0.3,  # what persons do, after the name or before it
    "being": 0.1,  # was, has, again
    "when": 0.15,  # yesterday, before the name
    "honorific": 0.5,  # さん
    "subject": 0.15,  # が
    "reached": 0.2,  # an address or a number right after it
    "placed": -1.0,  # in, from, the
    "body": -0.6,  # Trust, GmbH, Street
    "shout": -0.05,  # capitals throughout
}
# Words beside names and inside what isn't one, in the six languages of the texts.
#: What people do: before or after their name.
DEEDS = (
    "wrote|writes|said|says|called|calls|phoned|asked|asks|told|tells|sent|sends|replied|answered|answers|works|worked|lived|lives|joined|met|thinks|thought|signed|visited|spoke|speaks|agreed|thanked"
    "|came|comes|went|goes|left|returned|returns|arrived|arrives|opens|opened|waited|waits|explained|reported|noted|added|smiled|laughed|bought|paid|ordered|complained|confirmed|applied|resigned|died|married"
    "|schrieb|schreibt|sagte|sagt|rief|ruft|fragte|fragt|antwortete|antwortet|wohnt|wohnte|lebt|arbeitet|arbeitete|meint|meinte|unterschrieb|besuchte|kam|kommt|ging|geht|öffnet|öffnete|erklärte|bestätigte|bestellte|kann|dankte"
    "|a écrit|écrit|a dit|dit|a appelé|appelle|a demandé|demande|a répondu|répond|habite|habitait|travaille|pense|a signé|ouvre|vient|arrive|explique|a confirmé|raconte|vit"
    "|escribió|escribe|dijo|dice|llamó|llama|preguntó|pregunta|respondió|responde|vive|trabaja|cree|firmó|volvió|vuelve|vino|abre|abrió|llegó|explicó|confirmó|compró"
    "|написала?|пишет|сказала?|говорит|позвонила?|звонит|спросила?|ответила?|ответит|жив[её]т|работает|считает|подписала?|открыла?|откроет|пришла?|приехала?|вернулся|вернулась|думает|объяснила?"
)
#: Weaker ones, which things do too.
BEINGS = "is|was|has|had|will|would|ist|war|hat|wird|nach|est|était|a|es|era|está|estaba|ha|снова|был|была|сегодня"
WHEN = "yesterday|today|tomorrow|later|then|gestern|heute|morgen|dann|hier|demain|aujourd'hui|puis|ayer|hoy|mañana|luego|вчера|сегодня|завтра|потом|昨日|今日|明日"
#: What a name follows as the one meant.
NAMED = (
    "according to|ask for|asked for|speak to|spoke to|talk to|talked to|contact|contacted|by|with|met|saw|see|thanked|thank|told|asked|invited|interviewed|hired|emailed|knows|named|called|signed|attn"
    "|laut|fragen sie nach|mit|traf|trafen|bat|durch"
    "|selon|d'après|demandez|avec|par|rencontré|contactez|de la part de"
    "|según|pregunte por|con|por|conocí a|vi a|de parte de"
    "|по словам|спросите|спросил|встретила?"
)
INTRODUCED = "my name is|i am called|name is|ich heiße|ich heisse|mein name ist|je m'appelle|mon nom est|me llamo|mi nombre es|меня зовут|мое имя|моё имя|私は|名前は"
GREETED = (
    "dear|hello|hi|hey|good morning|lieber|liebe|geehrter|geehrten|geehrte|hallo|guten tag|cher|chère|bonjour|estimado|estimada|querido|querida|hola"
    "|уважаемый|уважаемая|дорогой|дорогая|здравствуйте"
)
CLOSINGS = (
    "kind regards|best regards|regards|best|best wishes|all the best|yours sincerely|yours truly|sincerely|cheers|thanks|thank you|yours|love|mit freundlichen grüßen|viele grüße|herzliche grüße|beste grüße|grüße"
    "|cordialement|bien à vous|amicalement|un saludo|saludos|atentamente|с уважением|敬具|よろしくお願いします"
)
PLACED = (
    "in|at|near|to|of|from|between|over|toward|towards|through|into|across|outside|the|our|aus|von|nach|bei|zwischen|über|am|im|der|die|das|dem|den|à|de|entre|vers|sur|la|le|du|en|desde|hacia|sobre|el|del"
    "|в|из|к|от|у|с|на|над|между|около|and|und|et|y|и"
)
#: Words of places, bodies and things, inside a run.
BODIES = (
    "inc|ltd|llc|corp|corporation|company|co|gmbh|ag|kg|plc|sa|sl|trust|foundation|institute|university|college|school|hospital|bank|agency|ministry|department|office|council|committee|club|union|association|society|group"
    "|team|desk|array|observatory|museum|library|church|airport|station|hotel|street|road|avenue|lane|square|park|bridge|river|lake|mountain|mount|island|bay|valley|hill|harbor|harbour|beach|forest|county|city|state|states"
    "|kingdom|republic|north|south|east|west|new|upper|lower|great|port|san|saint|st|stiftung|verein|universität|schule|straße|platz|fondation|université|école|rue|fundación|universidad|escuela|calle|фонд|институт|университет|улица"
    "|times|post|news|press|journal|research|studies|science|act|war|day|week|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|june|july|august|september|october|november|december"
    "|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|januar|februar|märz|juni|juli|oktober|dezember|street|customer|sir|madam|sirs|colleagues?|friends?|all|everyone|support|sales|service|admin|manager|editor"
    "|kunde|kundin|kunden|damen|herren|kollegen|client|cliente|clientes|señores|коллеги|клиент|mhz|ghz|step|version|internet|english|american|british|german|french|spanish|russian|japanese|european"
)
#: What begins a sentence before a name and isn't part of it.
OPENERS = (
    "Yesterday|Today|Tomorrow|Then|When|While|Since|Call|Write|Ask|Please|But|And|Or|If|As|For|After|Before|Because|Although|Our|My|His|Her|Their|The|This|That|These|Those|A|An|In|At|On|By|With|From|To|Dear|Hello|Hi|Hey|Thanks|Thank|Signed|Follow|See"
    "|Second|First|Last|Next|Step|Is|Are|Was|Were|Did|Does|Do|Has|Had|Have|Can|Could|Will|Would|Should|May|Contact|Contacts|Name|Note|According|Present|Report|Email|Meet|Tell|Let|Only|Also|Even|Both|Now|Here|There|What|Who|Where|How|Why|It|He|She|We|You|They|I|No|Not|Yes|So"
    "|Gestern|Heute|Morgen|Dann|Der|Die|Das|Den|Dem|Ein|Eine|Einer|Ab|Als|Wenn|Und|Oder|Aber|Weil|Unser|Unsere|Mein|Meine|Lieber?|Hallo|Folgen|Rufen|Schreiben|Fragen|Mit|Von|Laut|Kontakt|Anwesend|Folgen|Wir|Ich|Er|Sie|Es|Bei|Nach|Zu|Im|Am|Auf|Letzte|Niemand"
    "|Hier|Demain|Puis|Le|La|Les|L|Un|Une|Mon|Ma|Notre|Cher|Chère|Bonjour|Merci|Par|Avec|Selon|Demandez|Présents|Suivez|Nous|Je|Il|Elle|Dans|Sur|Pour|Quand|Si|Mais|Et|Ou|Personne|Dernier"
    "|Ayer|Hoy|Mañana|El|Los|Las|Una|Mi|Su|Nuestr[oa]|Estimad[oa]|Querid[oa]|Hola|Con|Por|Según|Contacto|Presentes|Pregunte|Cuando|Pero|Y|O|En|Siga|Nadie|Yo|Nosotros"
    "|Вчера|Сегодня|Завтра|Потом|Уважаем(?:ый|ая)|Здравствуйте|В|И|На|От|По|С|К|Но|А|Или|Если|Когда|Наш|Наша|Мой|Моя|Мы|Я|Он|Она|Контакт|Присутствуют|Спросите|Следите|Читайте|Никто|За|У|Из|Для"
)

_LETTER = r"[\p{Latin}\p{Cyrillic}]"
_EDGE = r"(?<![\p{Latin}\p{Cyrillic}\p{N}@._/'-])"
_END = r"(?![\p{Latin}\p{Cyrillic}\p{N}@'-]|_|\.\p{Ll})"
_CAPITAL = rf"(?:\p{{Lu}}(?:{_LETTER}|['-](?={_LETTER}))+)"
_INITIAL = r"(?:\p{Lu}\.(?:-\p{Lu}\.)?)"
_PARTICLE = rf"(?:(?=[vdlVDLфвдлФВДЛ])(?i:{PARTICLES}) )"
_PARTS = rf"(?:{_PARTICLE}*{_CAPITAL})"
_ANY = rf"(?:{_LETTER}\.|{_LETTER}+(?:['-]{_LETTER}+)*)"
#: Capitalised words side by side.
_RUN = regex.compile(rf"{_EDGE}(?:{_PARTICLE}+{_CAPITAL}|{_INITIAL}|{_CAPITAL})(?: (?:{_INITIAL}|{_PARTS})){{1,4}}+{_END}")
#: A surname and, after a comma, given names.
_TURNED = regex.compile(rf"{_EDGE}{_PARTS}, (?:{_CAPITAL}|{_INITIAL})(?: (?:{_INITIAL}|{_CAPITAL}))?{_END}")
_TITLE_WORDS = rf"(?i:{TITLES})\.? "
#: Each title in small letters, with a capital, in capitals.
_ANY_TITLE = "|".join(dict.fromkeys(f(t) for t in TITLES.split("|") for f in (str, str.capitalize, str.upper)))
_FRENCH_TITLE = rf"(?:{_ANY_TITLE}|[Mm])\.? "
_TITLED = regex.compile(rf"{_EDGE}{_FRENCH_TITLE}(?P<name>{_ANY}(?: {_ANY}){{0,5}}+(?:, {_ANY}(?: {_ANY})?+)?+)")
#: A greeting begins a sentence.
_GREETINGS = "|".join(g[0].upper() + g[1:] for g in GREETED.split("|"))
_MET = regex.compile(rf"(?:(?i:{_EDGE}(?:{INTRODUCED})) |(?:^|[\\n.!?:–•] ?)(?:{_GREETINGS}) (?=\\p{{Lu}}))(?P<name>{_ANY}(?: {_ANY}){{0,5}}+(?:, {_ANY}(?: {_ANY})?+)?+)")
_SIGNED = regex.compile(rf"(?i)(?:^|[\n.!?・] ?)(?:{CLOSINGS})[,!.]? ?\n+ ?(?:{_TITLE_WORDS})?(?P<name>{_ANY}(?: {_ANY}){{0,5}}+(?:, {_ANY}(?: {_ANY})?+)?+) ?(?=\n|$)")
_HONOURED = regex.compile(r"(?<![\p{Han}\p{Katakana}ー])(?:[\p{Han}]{1,5}|[\p{Katakana}ー・]{2,15})(?=さん|様|氏(?![\p{Han}]))")
_COMMA = regex.compile(r"\p{L}, \p{Lu}")
_MET_WORDS, _GREETING_WORDS = INTRODUCED.split("|"), _GREETINGS.split("|")
_NO_PERSON = regex.compile(r"お?客$|皆$|奥$|神$|何$|者$|人$|生$|屋$|員$")
_STOP = regex.compile(rf"(?i)(?:{DEEDS}|{BEINGS}|{PLACED}|{NAMED}|{BODIES}|or|but|who|which|because|und|oder|et|ou|y|o|и|или)")
_WORDS = regex.compile(rf"{_ANY}")
_DEED = regex.compile(rf",? (?:who |qui |que )?(?:{DEEDS})(?!{_LETTER})|(?:さん|様|氏)?[がはも](?:開|来|言|話|書|戻|住|働|会|答|帰|電話)")
_BEING = regex.compile(rf" (?:{BEINGS})(?!{_LETTER})")
_HONORIFIC = regex.compile(r" ?(?:さん|様|氏|先生|と申し|という者)")
_SUBJECT = regex.compile(r" ?が")
_REACHED = regex.compile(r"(?:,|、| at| unter| à| en| по)? ?[<(]?(?:[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}(?:@| @| ?[\[({] ?at| at [a-z0-9-]+ dot )|\+\d|\(?\d{2,4}[) -])")
#: What stands right before a name; matched backwards from it.
_BEFORE_NAME = {
    "introduced": regex.compile(rf"(?ri)(?<!{_LETTER})(?:{INTRODUCED}):? ?"),
    "greeted": regex.compile(rf"(?ri)(?<!{_LETTER})(?:{GREETED}|(?:^|\n)(?:{CLOSINGS}),?\n?) ?"),
    "deed": regex.compile(rf"(?ri)(?<!{_LETTER})(?:{DEEDS}) "),
    "named": regex.compile(rf"(?ri)(?<!{_LETTER})(?:{NAMED}),? "),
    "label": regex.compile(rf"(?ri)(?:{_LETTER}{{2}}|[\p{{Han}}\p{{Hiragana}}])(?<!note|nota|hinweis|remarque|p.s|ps|warning|примечание|追伸|注) ?[:：] ?"),
    "when": regex.compile(rf"(?ri)(?:{WHEN}),? ?"),
}
_PLACED = regex.compile(rf"(?ri)(?<!{_LETTER})(?:{PLACED}) ")
_FIELD = regex.compile(r"(?r)(?:^|\||\n|\t) ?")
_LISTED = regex.compile(r"(?i)(?:,| and| und| et| y| и|、|・|;| &| or) ?")
_FIELD_END = regex.compile(r" ?(?:\||\n|\t|$)")
_BODY = regex.compile(rf"(?i)(?<!{_LETTER})(?:{BODIES})(?!{_LETTER})")
_OPENER = regex.compile(rf"(?:{OPENERS})(?:,? |$)")
#: An initial that ends a sentence.
_PARTED = regex.compile(rf"\p{{Lu}}\.(?= (?:{OPENERS})(?![\p{{L}}']))")
_TITLE_ONLY = regex.compile(rf"(?i)(?:{TITLES})\.?(?: |$)")
_FRENCH = regex.compile(r"(?i)(?<!\p{L})(?:le|les|des|et|est|une?|selon|habite|demandez|dans|pour|qui|que|nous|vous|à|après|[lnds]')")


def _trimmed(text: str, start: int, end: int, titled: bool = False) -> tuple[int, bool]:
    """Where a run begins without the openers and titles before it, and whether a title stood there."""
    while start < end:
        if m := _TITLE_ONLY.match(text, start, end):
            titled = True
        elif not titled and text[start : start + 3] == "M. " and _is_french(text, start, end):
            m = regex.compile(r"M\. ").match(text, start)
            titled = True
        elif not (m := _OPENER.match(text, start, end)):
            break
        start = m.end()
    return start, titled


def _is_french(text: str, start: int, end: int) -> bool:
    return bool(_FRENCH.search(text[max(0, start - 60) : start]) or _FRENCH.search(text[end : end + 40]))


def _held(text: str, start: int, end: int) -> int:
    """The end of a name of any case that begins at start: before the first word that can't be part of one."""
    at = start
    particles = regex.compile(rf"(?i)(?:{PARTICLES})")
    for m in _WORDS.finditer(text, start, end):
        word = m[0]
        if _STOP.fullmatch(word) and not particles.fullmatch(word):
            break
        if m.start() > start and word[0].islower() and text[start].isupper() and not particles.fullmatch(word):
            break
        at = m.end()
    # A particle alone doesn't end a name.
    while (m := regex.search(rf"(?i)[ ,]+(?:{PARTICLES})$", text[start:at])) is not None:
        at = start + m.start()
    return at


def _score(text: str, start: int, end: int, cues: set[str]) -> float:
    """The score of a name by its shape, its neighbours and the cues known already."""
    name = text[start:end]
    words = regex.findall(r"[^\s,]+", name)
    cues = cues | {"words" if len(words) > 1 else "word"}
    if any(len(w) <= 2 and w.endswith(".") for w in words):
        cues.add("initial")
    before = text[max(0, start - 24) : start]
    if not cues & {"title", "introduced", "greeted"} and _PLACED.match(before) and not _BEFORE_NAME["named"].match(before):
        return WEIGHTS["words"] + WEIGHTS["placed"]
    cues |= {cue for cue, p in _BEFORE_NAME.items() if p.match(before)}
    if _FIELD.match(before) and _FIELD_END.match(text, end):
        cues.add("field")
    if _DEED.match(text, end):
        cues.add("deed")
    elif _BEING.match(text, end):
        cues.add("being")
    if _HONORIFIC.match(text, end):
        cues.add("honorific")
    elif _SUBJECT.match(text, end):
        cues.add("subject")
    if _REACHED.match(text, end):
        cues.add("reached")
    if _BODY.search(name):
        cues.add("body")
    if name.isupper() and len(words) > 1:
        cues.add("shout")
    return round(sum(WEIGHTS[c] for c in cues), 6)


def _names(text: str) -> Iterator[Span]:
    found: dict[tuple[int, int], set[str]] = {}
    for m in _RUN.finditer(text):
        end = p.end() if (p := _PARTED.search(text, m.start(), m.end())) else m.end()
        start, titled = _trimmed(text, m.start(), end)
        if start < end and (titled or " " in text[start:end]):
            found.setdefault((start, end), set()).update({"title"} if titled else ())
    for m in _TURNED.finditer(text, overlapped=True) if _COMMA.search(text) else ():
        start, titled = _trimmed(text, m.start(), m.end())
        if "," in text[start : m.end()]:
            found.setdefault((start, m.end()), set()).update({"title"} if titled else ())
    low = text.lower()
    for pattern, cue, there in ((_TITLED, "title", True), (_MET, None, any(w in low for w in _MET_WORDS) or any(w in text for w in _GREETING_WORDS)), (_SIGNED, "greeted", "\n" in text)):
        for m in pattern.finditer(text) if there else ():
            start, titled = _trimmed(text, m.start("name"), m.end("name"), cue == "title")
            if m[0][:2].lower() in ("m.", "m ") and not _is_french(text, m.start(), m.end()):
                continue
            if start < (end := _held(text, start, m.end("name"))):
                found.setdefault((start, end), set()).update({cue} if cue else {"title"} if titled else ())
    for m in _HONOURED.finditer(text):
        if not _NO_PERSON.search(m[0]):
            found.setdefault((m.start(), m.end()), set())
    last = -9
    for (start, end), cues in sorted(found.items()):
        score = _score(text, start, end, cues)
        if score < THRESHOLD and 0 <= start - last <= 6 and _LISTED.fullmatch(text, last, start):
            score += WEIGHTS["listed"]
        if score >= THRESHOLD:
            last = end
        yield Span("name", start, end, score)


def find_spans(text: str | None) -> list[Span]:
    """The items of a text, by place; start and end count code points from 0. Null and empty texts have none."""
    if not text:
        return []
    folded, at = fold(text)
    found = [s for f in (_emails, _ids, _phones, _addresses, _names) for s in f(folded) if s.score >= THRESHOLD]
    found.sort(key=lambda s: (KINDS.index(s.kind), s.start - s.end if s.kind == "phone" else 0, -s.score, s.start, -s.end))
    starts: list[int] = []
    kept: dict[int, Span] = {}
    for s in found:
        i = bisect_right(starts, s.start)
        if (i and kept[starts[i - 1]].end > s.start) or (i < len(starts) and starts[i] < s.end):
            continue
        starts.insert(i, s.start)
        kept[s.start] = s
    return [Span(s.kind, int(at[s.start]), int(at[s.end - 1]) + 1, s.score) for s in (kept[k] for k in starts)]


def redact(text: str | None) -> str | None:
    """text with [EMAIL], [ID_NUMBER], [PHONE], [ADDRESS] or [NAME] in place of each item, all else unchanged."""
    if not text:
        return text
    out, last = [], 0
    for s in find_spans(text):
        out += [text[last : s.start], f"[{s.kind.upper()}]"]
        last = s.end
    return "".join([*out, text[last:]])


def find_items(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start_pos, end_pos, score: a row for each item, places counted from 1 in code points.

    Null and empty texts give no row; each row of documents is searched whole, repeated ones again; other columns are
    ignored. Documents are matched one by one in Arrow batches, so nothing is shuffled.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, s.kind, s.start + 1, s.end, s.score) for k, t in zip(batch["key"], batch["text"], strict=True) if isinstance(t, str) for s in find_spans(t)]
            yield pd.DataFrame(rows, columns=["key", "kind", "start_pos", "end_pos", "score"])

    source = documents.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInPandas(search, f"key {kind}, kind string, start_pos long, end_pos long, score double").withColumnRenamed("key", key)


def redacted(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key and text with placeholders; null stays null."""

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "text": [redact(t) if isinstance(t, str) else None for t in batch["text"]]})

    source = documents.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    return source.mapInPandas(replace, f"key {source.schema['key'].dataType.simpleString()}, text string").withColumnsRenamed({"key": key, "text": text})
