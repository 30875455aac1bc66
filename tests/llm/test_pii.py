from __future__ import annotations

import pytest

from skylode.llm.pii import find_items, find_spans, fold, luhn, mod23, mod97, redact, redacted

CASES = [
    ("Write to <ann.lee@mail.example.org> or +44 7700 900123 (fax).", [("email", "ann.lee@mail.example.org"), ("phone", "+44 7700 900123")]),
    ("Link: mailto:bo+list [at] site.example.com (0695 394 7548)", [("email", "bo+list [at] site.example.com")]),
    ("Replies go to bo at mail dot site dot test, not to the list.", [("email", "bo at mail dot site dot test")]),
    ("Contact Ann van Berg at ann @ site.test.", [("name", "Ann van Berg"), ("email", "ann @ site.test")]),
    ("Follow @some_desk or write to the desk of the Upper Fen Array Trust, part 6479662019.", []),
    ("Version 1.2.3 reads the list wrongly (order 0521 434 7368).", []),
    ("The badge was issued on passport A 005 255 77.", [("id_number", "A 005 255 77")]),
    ("通行証の旅券番号は989-03-6454です。", [("id_number", "989-03-6454")]),
    ("Card 4111 1111 1111 1111 was charged.", [("id_number", "4111 1111 1111 1111")]),
    ("Card 4111 1111 1111 1112 was charged.", []),
    ("Account GB82 WEST 1234 5698 7654 32 is open.", [("id_number", "GB82 WEST 1234 5698 7654 32")]),
    ("Mr. LEE Ann lives at Flat 9, 53 Harrow St, Tellmoor 20123.", [("name", "LEE Ann"), ("address", "Flat 9, 53 Harrow St, Tellmoor 20123")]),
    ("Frau ann lee wohnt in Turmfalkenstr. 90b, 32163 Orvelle.", [("name", "ann lee"), ("address", "Turmfalkenstr. 90b, 32163 Orvelle")]),
    ("M. Ann Lee habite 99, rue des Tisserands.", [("name", "Ann Lee"), ("address", "99, rue des Tisserands")]),
    ("Envíe las piezas a Calle del Romero, n.º 64, 71595 Hollin Fen; se exige pasaporte 947-09-6519.", [("address", "Calle del Romero, n.º 64, 71595 Hollin Fen"), ("id_number", "947-09-6519")]),
    ("Г-жа Ли, Анна, адрес: ул. Ткацкая, д. 184, кв. 2.", [("name", "Ли, Анна"), ("address", "ул. Ткацкая, д. 184, кв. 2")]),
    ("Ann Leeさんの住所は 架空町4丁目7-16 です。", [("name", "Ann Lee"), ("address", "架空町4丁目7-16")]),
    ("Follow @tellmoor.desk or write.", []),
    ("P.S. Г-жа Анна Ли, адрес: ул. Ткацкая, д. 1.", [("name", "Анна Ли"), ("address", "ул. Ткацкая, д. 1")]),
    ("P.S. Ann Lee lives at 8 Mill Road", [("name", "Ann Lee"), ("address", "8 Mill Road")]),
    ("M. M. Lee habite 9 bis rue des Tisserands.", [("name", "M. Lee"), ("address", "9 bis rue des Tisserands")]),
    ("Ms. M. O'Hara lives at 8 Mill Road.", [("name", "M. O'Hara"), ("address", "8 Mill Road")]),
    ("Selon M. Lee, Ann, le signal peut attendre.", [("name", "Lee, Ann")]),
    ("99047/33 | M. Lee | SSN KK0069556 | 01 99 00 84 51", [("name", "M. Lee"), ("id_number", "KK0069556"), ("phone", "01 99 00 84 51")]),
    ("Present: Lee, Ann, Bo O'Hara and the cook.", [("name", "Lee, Ann"), ("name", "Bo O'Hara")]),
    ("Present: Ann Lee, B. Hara and the cook. More.", [("name", "Ann Lee"), ("name", "B. Hara")]),
    ("Mit freundlichen Gru\u0308\u00dfen\nZoe\u0308 Lee\n", [("name", "Zoe\u0308 Lee")]),
    ("・Lee, Annと申します。", [("name", "Lee, Ann")]),
    ("Contacto: Ann Lee, ", [("name", "Ann Lee")]),
    ("According to Dr. Ann B. Lee, the map can wait.", [("name", "Ann B. Lee")]),
    ("ich heiße Ann Lee, erreichbar unter ０３−００００−７９５９ oder a@b.test", [("name", "Ann Lee"), ("phone", "０３−００００−７９５９"), ("email", "a@b.test")]),
    ("Kind regards,\nAnn Lee\n8 Mill Road\n555 0199", [("name", "Ann Lee"), ("address", "8 Mill Road"), ("phone", "555 0199")]),
    ("74005/78 | Ann Lee | SSN 561358-6576 | 06.39.98.66.01", [("name", "Ann Lee"), ("id_number", "561358-6576"), ("phone", "06.39.98.66.01")]),
    ("Ca​ll +7 (000) 504-43-46 af​ter 15:01 and ask for Dr. Pav​la Lee.", [("phone", "+7 (000) 504-43-46"), ("name", "Pav​la Lee")]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_found_items(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in find_spans(text)] == want


def test_folding_remembers_places():
    text = "​a  b＠c"
    folded, at = fold(text)
    assert folded == "a b@c" and [text[i] for i in at] == ["a", " ", "b", "＠", "c"]


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and not luhn("0" * 16) and not luhn("18")
    assert mod97("GB82WEST12345698765432") and not mod97("GB83WEST12345698765432") and not mod97("x")
    assert mod23("12345678Z") and not mod23("12345678A")


def test_redaction_leaves_the_rest():
    assert redact("Call 555 0199 now,  Ann.") == "Call [PHONE] now,  Ann."
    assert redact("") == "" and redact(None) is None


def test_long_texts_take_linear_time():
    assert find_spans("ha" * 300_000 + ". " + "." * 100_000 + " 12" * 50_000 + " a@b.test")[-1].kind == "email"


def test_on_a_table(spark):
    rows = [(1, "mail a@b.test", "x"), (1, "mail a@b.test", "x"), (None, "555 0199", "x"), (3, None, "x"), (4, "", "x"), (5, "\U0001f680 a@b.test", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((r["doc_id"] or 0, r["kind"], r["start_pos"]) for r in find_items(df, "doc_id", "text").collect())
    assert got == [(0, "phone", 1), (1, "email", 6), (1, "email", 6), (5, "email", 3)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in redacted(df, "doc_id", "text").na.fill("-", ["text"]).collect()) == [
        (0, "[PHONE]"), (1, "mail [EMAIL]"), (1, "mail [EMAIL]"), (3, "-"), (4, ""), (5, "\U0001f680 [EMAIL]"),
    ]
    assert find_items(df.limit(0), "doc_id", "text").count() == 0
