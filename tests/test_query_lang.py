import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomq.plans.query_lang import Node, matches, parse


@pytest.mark.parametrize(
    ("text", "query", "expected"),
    [
        ("Issuer Address: Acme Development GmbH", "acme", True),
        ("Developer: StellarRussia", "Acme ODER StellarRussia", True),
        ("Developer: StellarRussia, QSI ICO: AUREXIS", "StellarRussia && Zenith", False),
        ("Contact: Sandra Miller", "Sandra", True),
        ("The Korolev Memorandum", "StellarRussia ODER (The UND Korolev UND Directive)", False),
        ("Acme Vertrag GmbH", "Acme UND Vertrag ODER StellarRussia", True),
        ("x StellarRussia", "Acme AND Vertrag OR StellarRussia", True),
        ("Acme only", "Acme AND (Vertrag OR GmbH)", False),
        ("see Acme AND (Zenith here", "Acme AND (Zenith", True),
        ("Acme Zenith", "Acme AND (Zenith", False),
        ("Acme", "Acme AND", False),
        (None, "Acme", False),
        (None, "  ", True),
        ("", "", True),
        ("a (b", "(", True),
        ("a || b", "a || ", True),
        ("a or b", "a || ", False),
        ("nested x y", "((x) && ((y)))", True),
        ("a) b", "a) b", True),
    ],
)
def test_matches(value, text, query, expected):
    assert value(lambda t: matches(t, query), (text, "string")) is expected


def test_trees():
    assert parse("Sandra") == Node("term", "Sandra")
    assert parse("Acme AND") == Node("term", "Acme AND")
    assert parse(None) is None
    assert [p.text for p in parse("a and b AND c").parts] == ["a", "b", "c"]
    assert parse("Acme Corp oder Zenith").parts[0].text == "Acme Corp"


def _oracle(node, text):
    if node.op == "term":
        return node.text.lower() in text
    return (any if node.op == "or" else all)(_oracle(p, text) for p in node.parts)


@given(st.lists(st.sampled_from(["a", "b", "(", ")", "AND", "OR", "&&", "||", "c d"]), max_size=9))
def test_parse_never_raises(parts):
    query = " ".join(parts)
    node = parse(query)
    assert node is None if not query.strip() else _oracle(node, "a b") in (True, False)
