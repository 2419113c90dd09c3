import random
import re
import time

from kmerlake.llm.pii import BASE, KINDS, automaton, find, find_pii, luhn, redact

GRAMMAR = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sound(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), KINDS.index(k), m.end()) for k, p in GRAMMAR.items() for m in re.finditer(p, text) if sound(k, m.group())]
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def test_base_kinds_equal_grammar():
    rng, anchors = random.Random(5), automaton()
    alphabets = ["01234567890123456789..@@+-- ()ab:/é", "0123456789. -", "ab1.@@-", "4111 -+()."]
    for k in range(40000):
        text = "".join(rng.choices(alphabets[k % 4], k=rng.randrange(45)))
        assert [s for s in find(text, anchors) if s[0] in BASE] == brute(text), text


def test_added_kinds():
    a = automaton()
    assert find("Account no: 12345678 end", a) == [("account", 12, 20)]
    assert ("account", 5, 32) in find("IBAN DE89 3704 0044 0532 0130 00 ok", a)
    assert not [s for s in find("IBAN DE88 3704 0044 0532 0130 00 ok", a) if s[0] == "account"]
    assert ("address", 4, 33) in find("see https://bob:pw@ex.example.com/x", a)
    assert find("at 12 Main Street now", a) == [("street", 3, 17)]
    assert find("an accounting of 1234567 in the street", a) == []


def test_redact():
    text = "mail a@b.cd or https://u:p@h.example.org/ on"
    assert redact(text, find(text, automaton())) == "mail [EMAIL] or [ADDRESS]/ on"


def test_rows(odd_docs):
    rows = find_pii(odd_docs.unionByName(odd_docs.limit(1).selectExpr("* except (text)", "'a@b.de' as text")), redacted="text").collect()
    assert len(rows) == 11 and sum(len(r["pii"]) for r in rows) == 1
    assert [r["text"] for r in rows if r["doc_id"] == 3] == [None]
    assert "[EMAIL]" in {r["text"] for r in rows}
    assert find_pii(odd_docs.limit(0)).count() == 0


def test_repeated_cues_take_linear_time():
    anchors, start = automaton(), time.time()
    text = "account" * 150_000 + " number 12345678"
    assert ("account", len(text) - 8, len(text)) in find(text, anchors)
    assert time.time() - start < 30
