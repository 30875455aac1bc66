from __future__ import annotations

import pytest

from skylode.llm.pii import find_spans

CASES = [
    ("Jane Doe wrote to us.", [("name", "Jane Doe")]),
    ("Mr. Smith called.", [("name", "Smith")]),
    ("Last week Jane Q. Doe asked for a refund.", [("name", "Jane Q. Doe")]),
    ("Dear Jane Doe, thank you.", [("name", "Jane Doe")]),
    ("Karl von Berg rief gestern an.", [("name", "Karl von Berg")]),
    ("Marie Curie a écrit deux lettres.", [("name", "Marie Curie")]),
    ("Juan Pérez preguntó por el pedido.", [("name", "Juan Pérez")]),
    ("Иван Петров позвонил утром.", [("name", "Иван Петров")]),
    ("Jane Doe <jane@site.test>", [("name", "Jane Doe"), ("email", "jane@site.test")]),
    ("We drove to Green Valley and on to Port Mason.", []),
    ("The Green Valley Trust wrote to us.", []),
    ("My number: 090-1234-5678.", [("phone", "090-1234-5678")]),
    ("Office (212) 867-5309, or 415-867-5309.", [("phone", "(212) 867-5309"), ("phone", "415-867-5309")]),
    ("Building B. Call +44 7700 900277.", [("phone", "+44 7700 900277")]),
    ("See part 415-867-5309.", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_other_wording(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in find_spans(text)] == want


def test_lists_of_any_length():
    names = [f"{given} {family}" for given in ("Ann", "Bo", "Cy", "Di", "Ed") for family in ("Lee", "Hara", "Moss", "Reed", "Vane", "Wolf")]
    text = f"Present: {', '.join(names)} and the cook."
    assert [text[s.start : s.end] for s in find_spans(text)] == names
