"""Ordinary text that no weight or pattern was fitted to: recall and precision by kind, in wording of many sorts."""

from __future__ import annotations

from collections import Counter

import pytest

from skylode.llm.pii import find_spans

#: Items in braces: {kind:value}; the rest holds nothing personal.
NAMES = ["John Smith", "Anna Petrova", "María González", "Jean-Luc Moreau", "Sofie van Dijk", "Patrick O'Brien", "Chinedu Okafor", "Li Wei"]
FRAMES = [
    "Last Tuesday I met {name} in Paris.",
    "Dear {name}, your parcel has arrived.",
    "The letter was written by {name} and reviewed in March.",
    "We would like to thank {name} for the quick reply.",
    "{name} said the meeting was moved to Friday.",
    "Yesterday evening {name} called about the invoice.",
    "Please speak to {name} before you sign anything.",
    "Best regards,\n{name}",
    "I have known {name} since school, and we still write.",
    "The judge asked {name} whether the door was locked.",
    "Mr. {name} will see you at noon.",
    "When the rain stopped, {name} went home.",
    "The prize was shared with {name}, a nurse from Leeds.",
    "Name: {name}\nAge: 41",
    "Our neighbour {name} lives next to the bakery.",
    "Frau {name} hat heute Geburtstag.",
    "Gestern schrieb {name} einen langen Brief.",
    "{name} wohnt seit Jahren in Köln.",
    "Merci à vous, madame. {name} arrive demain matin.",
    "Mme {name} a perdu son parapluie.",
    "Conocí a {name} en la boda de mi prima.",
    "La señora dijo que {name} trabaja en el hospital.",
]
OTHERS = [
    "My SSN is {id_number:123-45-6789}.",
    "Social security: {id_number:078-05-1120}",
    "The passport number was {id_number:C01234567} on the form.",
    "She paid with card {id_number:5555 5555 5555 4444} at the till.",
    "Transfer it to IBAN {id_number:DE89 3704 0044 0532 0130 00} today.",
    "Mein Reisepass Nr. {id_number:L12345678} ist abgelaufen.",
    "Su DNI es {id_number:12345678Z}, según el contrato.",
    "Le passeport n° {id_number:12345678} est périmé.",
    "Account {id_number:FR14 2004 1010 0505 0001 3M02 606} was closed.",
    "His national ID is {id_number:800101-1234}, it says.",
    "Call me at {phone:(212) 555-0123} after lunch.",
    "Phone: {phone:020 7946 0958}",
    "Tel {phone:030 901820}",
    "Dial {phone:1-800-555-0199} for help.",
    "You can reach the plumber on {phone:07911 123456}.",
    "Our office: {phone:+49 30 901820}, ask anyone.",
    "Appelez le {phone:01 42 68 53 00} avant midi.",
    "Mi móvil es {phone:612 345 678}, escríbeme.",
    "Телефон: {phone:8 (495) 123-45-67}",
    "電話は{phone:03-3234-5678}です。",
    "Fax {phone:0221/4710 123} is broken.",
    "Mobile {phone:+1 (415) 555-2671}",
    "Write to {email:jane.roe@corp.example} about it.",
    "Mail {email:info(at)shop.example} with questions.",
    "My address is {email:max_mueller99@web.example}.",
    "Send it to {email:team+ops@sub.domain.example}, please.",
    "Reach us: {email:help [at] desk [dot] example}",
    "Écrivez à {email:contact@mairie.example}.",
    "They live at {address:10 Downing Street, London SW1A 2AA}.",
    "Ship to {address:742 Evergreen Terrace, Springfield, IL 62704}, please.",
    "The shop moved to {address:221B Baker Street, London}.",
    "Wir treffen uns in der {address:Hauptstraße 12, 50667 Köln}.",
    "Er wohnt {address:Am Markt 3a, 04109 Leipzig}.",
    "Le bureau est au {address:24 rue de la Paix, 75002 Paris}.",
    "Vive en {address:Calle Mayor, 15, 28013 Madrid}.",
    "Живёт по адресу {address:ул. Ленина, д. 5, кв. 12}.",
    "住所は{address:港区芝公園4丁目2-8}です。",
    "Leave it at {address:Flat 4, 17 Kings Road, Brighton}.",
    "The {address:1600 Pennsylvania Avenue} gate is shut.",
]
NOTHING = [
    "According to Reuters, sales fell in the third quarter.",
    "Present: apples, oranges and pears.",
    "We flew from New York to San Francisco over the Rocky Mountains.",
    "The Bank of England raised rates on Thursday.",
    "Chapter 12 covers pages 345-678 and table 9.",
    "Version 10.4.2 fixes bug 123456 in build 20240115.",
    "The University of California opened in 1868.",
    "World War II ended in 1945.",
    "He scored 103-99 against the Golden State Warriors.",
    "The invoice 2024-00123 is due on 2024-05-31.",
    "Der Deutsche Bundestag tagt im Reichstag.",
    "Die Europäische Union hat 27 Mitglieder.",
    "La Tour Eiffel mesure 330 mètres.",
    "El Museo del Prado está en Madrid.",
    "Москва находится в России.",
    "Order 4512 of the United Nations was signed in Geneva.",
    "Isaac's law, the Big Bang and Black Friday are topics here.",
    "Microsoft Windows is an operating system.",
    "Temperatures reached 38.5 degrees, up from 35.2.",
    "The ISBN is 978-3-16-148410-0 and the price 12.99.",
    "Please keep off the grass at Central Park.",
    "The Pacific Ocean covers 165 million square kilometres.",
    "In 2019 555 people came, 1200 more than in 2018.",
    "The New Year begins on the first of January.",
]


def parts(frame):
    """The text of a frame and its items."""
    text, items = "", []
    while "{" in frame:
        head, _, rest = frame.partition("{")
        item, _, frame = rest.partition("}")
        kind, _, value = item.partition(":")
        text += head
        items.append((kind, len(text), value))
        text += value
    return text + frame, {(k, at, at + len(v)) for k, at, v in items}


def sentences():
    for i, frame in enumerate(FRAMES):
        for j in range(7):
            yield parts(frame.replace("{name}", "{name:" + NAMES[(i + j) % len(NAMES)] + "}"))
    for frame in OTHERS + NOTHING:
        yield parts(frame)


def test_recall_and_precision_by_kind():
    true, found, both = Counter(), Counter(), Counter()
    wrong = []
    count = 0
    for text, want in sentences():
        count += 1
        got = {(s.kind, s.start, s.end) for s in find_spans(text)}
        for c, spans in ((true, want), (found, got), (both, want & got)):
            c.update(k for k, _, _ in spans)
        if got != want:
            wrong.append((text, [text[a:b] for _, a, b in got ^ want]))
    print(*wrong, sep="\n")
    print({k: (both[k] / true[k], both[k] / found[k]) for k in true})
    assert count >= 200
    for kind in ("name", "phone", "id_number", "email", "address"):
        assert both[kind] / true[kind] >= 0.9 and both[kind] / found[kind] >= 0.9, kind


@pytest.mark.parametrize("text", NOTHING)
def test_nothing_personal(text):
    assert [text[s.start : s.end] for s in find_spans(text)] == []


def test_long_lists_and_words_have_no_limit():
    names = [f"Ann{chr(97 + i % 26)} Lee{'x' * (50 * (i == 3))}{chr(97 + i // 26)}" for i in range(200)]
    text = "Present: " + ", ".join(names) + "."
    assert [text[s.start : s.end] for s in find_spans(text)] == names


@pytest.mark.parametrize("text, name", [("Уважаемая Анна Петрова, ждём вас.", "Анна Петрова"), ("Моё имя Олег Ким, здравствуйте.", "Олег Ким"), ("Chère Marie Dubois, merci.", "Marie Dubois"), ("Liebe Anna Vogel, bis bald.", "Anna Vogel"), ("Estimada Lucía Vega: gracias.", "Lucía Vega")])
def test_greetings_of_either_gender(text, name):
    assert [text[s.start : s.end] for s in find_spans(text)] == [name]
