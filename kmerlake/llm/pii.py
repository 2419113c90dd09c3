"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the whole text: at-signs, schemes, plus
signs before a digit, digits with a dot or digit beside them, and cue words for accounts and
addresses. Each anchor is handed to the parser of its kind, which widens it to the left and right
by fixed rules and checks the result. The four base kinds (email, ip, card, phone) come out as the
leftmost non-overlapping matches of their grammars, with failing matches dropped; the others are:

* ``address``: a web address with a user part (``scheme://user@host`` or ``scheme://user:word@host``),
* ``account``: an IBAN with right check digits, or the number of 6 to 20 digits after an account cue,
* ``street``: a house number and up to three words before a street word.

Spans are code points, end exclusive, ordered by start and then by kind as in KINDS; kinds may
overlap each other. Null and empty texts have none. Repeated rows are searched alike.
"""

from __future__ import annotations

import string
from functools import partial

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kmerlake.llm.common import add_columns, once

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "street")
DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
PHONE = frozenset(string.digits + " ().-")
ALNUM = frozenset(string.ascii_letters + string.digits)
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta")
STREET_WORDS = ("Street", "Avenue", "Road", "Boulevard", "Lane")
SPAN = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, least: int, allowed: frozenset) -> int:
    """Start of the run of allowed characters that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def domain_end(text: str, at: int) -> int:
    """End of two or more dotted labels from ``at``, or -1."""
    end = _run(text, at, LABEL)
    if end == at:
        return -1
    labels = 1
    while end < len(text) and text[end] == ".":
        stop = _run(text, end + 1, LABEL)
        if stop == end + 1:
            break
        end, labels = stop, labels + 1
    return end if labels > 1 else -1


def emails(text: str, anchors: list[int]):
    free = 0
    for at in anchors:
        if at < free:
            continue
        start = _back(text, at, free, LOCAL)
        end = domain_end(text, at + 1) if start < at else -1
        if end > 0:
            yield start, end
            free = end


def ips(text: str, anchors: list[int]):
    """``anchors``: dots between digits. Runs of digits joined by dots are taken four at a time."""
    free = 0
    for at in anchors:
        if at < free:
            continue
        start = _back(text, at, free, DIGITS)
        parts, end = [], start
        while start < at:  # false when the digits before the dot belong to the match before
            stop = _run(text, end, DIGITS)
            parts.append((end, stop))
            if len(parts) == 4 or not (stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in DIGITS):
                break
            end = stop + 1
        if len(parts) == 4:
            free = parts[-1][1]
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in parts):
                yield start, free
        elif parts:
            free = parts[-1][1]  # a shorter chain matches from none of its places


def cards(text: str, anchors: list[int]):
    """``anchors``: digits with a digit after them or after one blank or hyphen."""
    free, n = 0, len(text)
    for at in anchors:
        if at < free:
            continue
        end, digits = at + 1, [text[at]]
        while end < n:
            if text[end] in DIGITS:
                digits.append(text[end])
                end += 1
            elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
                digits.append(text[end + 1])
                end += 2
            else:
                break
        free = end
        if 12 <= len(digits) <= 19 and luhn("".join(digits)):
            yield at, end


def phones(text: str, anchors: list[int]):
    """``anchors``: plus signs before a digit."""
    free = 0
    for at in anchors:
        if at < free:
            continue
        end = _run(text, at + 2, PHONE)
        while end > at + 2 and text[end - 1] not in DIGITS:
            end -= 1
        if end - at < 4:  # a digit, at least one more character, a digit
            continue
        free = end
        if 9 <= sum(map(text[at:end].count, string.digits)) <= 15:
            yield at, end


def iban_end(text: str, at: int) -> int:
    """End of an IBAN at ``at`` (blanks between groups allowed) with right check digits, or -1."""
    found, end, best = "", at, -1
    while end < len(text) and len(found) < 34:
        if text[end] in ALNUM:
            found += text[end].upper()
            end += 1
        elif text[end] == " " and found and end + 1 < len(text) and text[end + 1] in ALNUM:
            end += 1
            continue
        else:
            break
        if len(found) == 4 and not (found[:2].isalpha() and found[2:].isdigit()):
            return -1
        whole = end == len(text) or text[end] not in ALNUM
        if len(found) >= 15 and whole and int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1:
            best = end
    return best


def accounts(text: str, anchors: list[int]):
    """``anchors``: ends of account cues. Up to 20 characters without letters or digits may follow the cue, and one short word."""
    free = 0
    for cue in anchors:
        at = cue
        for _ in range(2):
            stop = at
            while stop < len(text) and stop - at < 20 and text[stop] in " \t:#.-=/":
                stop += 1
            word = stop
            while word < len(text) and word - stop <= 6 and text[word] in ALNUM:
                word += 1  # a longer word is none of these; cues may follow each other without a gap
            if word > stop and text[stop:word].lower() in {"no", "nr", "number", "num", "nummer", "id"}:
                at = word
                continue
            break
        if stop < free or stop == cue:
            continue
        end = iban_end(text, stop)
        if end < 0:
            end = _run(text, stop, DIGITS)
            if not 6 <= end - stop <= 20 or (end < len(text) and text[end] in ALNUM):
                continue
        yield stop, end
        free = end


def addresses(text: str, anchors: list[int]):
    """``anchors``: places of ``://``. The scheme to the left, a user part and host to the right."""
    free = 0
    for at in anchors:
        start = _back(text, at, free, ALNUM)
        user = at + 3
        while user < len(text) and (text[user] in LOCAL or text[user] == ":"):
            user += 1
        if start == at or user == at + 3 or user >= len(text) or text[user] != "@":
            continue
        end = domain_end(text, user + 1)
        if end > 0:
            yield start, end
            free = end


def streets(text: str, anchors: list[int]):
    """``anchors``: starts of street words. One to three capitalised words and a number of up to five digits before it."""
    free = 0
    for at in anchors:
        end = _run(text, at, ALNUM)
        if text[at:end] not in STREET_WORDS:
            continue
        place, words = at, 0
        while words < 3 and place > free and text[place - 1] == " ":
            start = _back(text, place - 1, free, ALNUM)
            if start == place - 1:
                break
            word = text[start : place - 1]
            if word.isdigit():
                if words and len(word) <= 5 and (start == 0 or text[start - 1] not in ALNUM):
                    yield start, end
                    free = end
                break
            if not word[0].isupper():
                break
            place, words = start, words + 1
        else:
            start = _back(text, place - 1, free, DIGITS) if place > free and text[place - 1] == " " else place
            if words and 0 < place - 1 - start <= 5 and (start == 0 or text[start - 1] not in ALNUM):
                yield start, end
                free = end


PARSERS = {"email": emails, "ip": ips, "card": cards, "phone": phones,
           "account": accounts, "address": addresses, "street": streets}


def automaton() -> ahocorasick.Automaton:
    """Patterns with the parsers that they wake and the place of the anchor, counted from the pattern's last character."""
    wakes: dict[str, list[tuple[str, int]]] = {"@": [("email", 0)], "://": [("address", -2)]}
    for a in string.digits:
        wakes[f"+{a}"] = [("phone", -1)]
        for b in string.digits:
            wakes[f"{a}.{b}"] = [("ip", -1)]
            for between in ("", " ", "-"):
                wakes[f"{a}{between}{b}"] = [("card", -1 - len(between))]
    for cue in ACCOUNT_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            wakes[form] = [("account", 1)]
    for word in STREET_WORDS:
        wakes[f" {word}"] = [("street", 1 - len(word))]
    found = ahocorasick.Automaton()
    for pattern, value in wakes.items():
        found.add_word(pattern, value)
    found.make_automaton()
    return found


def find(text: str | None, anchors_of: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text: (kind, start, end)."""
    if not text:
        return []
    anchors: dict[str, list[int]] = {}
    for last, wakes in anchors_of.iter(text):
        for kind, back in wakes:
            anchors.setdefault(kind, []).append(last + back)
    spans = [(a, KINDS.index(kind), b) for kind, places in anchors.items() for a, b in PARSERS[kind](text, places)]
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace spans by ``[KIND]``; of spans that overlap, the one that starts first covers all of them."""
    out, done, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def _kernel(redacted: str | None):
    anchors_of = once(("pii",), automaton)

    def work(texts):
        spans = [find(t, anchors_of) for t in texts]
        out = {"pii": [[{"kind": k, "start": a, "end": b} for k, a, b in found] for found in spans]}
        if redacted:
            out[redacted] = [None if t is None else redact(t, found) for t, found in zip(texts, spans)]
        return out

    return work


def find_pii(df: DataFrame, text: str = "text", redacted: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Append ``pii`` (an array of kind, start, end) and, under the name ``redacted``, the text without it."""
    new = {"pii": SPAN} | ({redacted: T.StringType()} if redacted else {})
    return add_columns(df, text, new, partial(_kernel, redacted), keep)
