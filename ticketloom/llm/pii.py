"""Personal data: an Aho-Corasick automaton finds anchors, local parsers expand and validate what stands around them.

Anchors: `@` (email), `.` after a digit (ip), pairs of digits with at most one blank or hyphen between (card), `+` and a
digit (phone), URL schemes (url) and words that announce an account number (account). Each parser looks only at the
characters next to its anchor, so long texts take linear time.

Cases: null and empty texts give no span; a null id is kept; a repeated row is scanned once per row; of one kind the
leftmost span stands, overlapping spans of different kinds all stay; an empty table gives no row. Other columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: The base kinds in their order, then those that this method adds.
KINDS = ("email", "ip", "card", "phone", "url", "account")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DIGITS = "0123456789"
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_four = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
_chain = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_url = re.compile(r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]{1,5})?(?:/[^\s\"'<>]*)?").match
_number = re.compile(r"(?: number| no\.?)?[ :#=]{1,3}([A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}|[0-9]{6,17})(?![A-Za-z0-9])").match
_SCHEMES = ("http://", "https://", "ftp://")
_CUES = ("account", "Account", "IBAN", "iban")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    words = {"@": "email", **{f"{d}.": "ip" for d in _DIGITS}, **{f"+{d}": "phone" for d in _DIGITS}}
    words |= {f"{d}{gap}{e}": "card" for d in _DIGITS for e in _DIGITS for gap in ("", " ", "-")}
    words |= {s: "url" for s in _SCHEMES} | {c: "account" for c in _CUES}
    for w, kind in words.items():
        a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def spans(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; kind as a place in KINDS, code points, end exclusive."""
    if not text:
        return []
    done = dict.fromkeys(KINDS, 0)  # how far each kind's matches, kept or dropped, have come
    out, seen = [], 0  # seen: just behind the last at-sign
    for last, (kind, size) in automaton.iter(text):
        at = last - size + 1
        if kind == "email":
            left = max(done["email"], seen)
            start = left + len(text[left:at].rstrip(_LOCAL))
            seen = at + 1
            if start < at and (m := _domain(text, at + 1)):
                out.append((0, start, m.end()))
                done["email"] = m.end()
        elif at < done[kind]:
            continue
        elif kind == "ip":  # the first number's last digit
            start = at
            while start > done["ip"] and text[start - 1] in _DIGITS:
                start -= 1
            if m := _four(text, start):
                done["ip"] = m.end()
                if all(map(_small, m[0].split("."))):
                    out.append((1, start, m.end()))
            else:
                done["ip"] = at + 1
        elif kind == "card":
            m = _chain(text, at)  # the first pair of a chain starts it
            done["card"] = m.end()
            if m.end() - at >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, at, m.end()))
        elif kind == "phone":
            if m := _phone(text, at):
                done["phone"] = m.end()
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    out.append((3, at, m.end()))
        elif kind == "url":
            if m := _url(text, last + 1):
                done["url"] = m.end()
                out.append((4, at, m.end()))
        elif m := _number(text, last + 1):
            done["account"] = m.end()
            if m[1][0] in _DIGITS or iban(m[1]):
                out.append((5, m.start(1), m.end(1)))
    return sorted(out)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]

    def row(t: str | None, automaton: ahocorasick.Automaton) -> tuple:
        found = spans(t, automaton)
        said = [f"{KINDS[k]}:{a}:{b}" for k, a, b in found]
        base = sum(k < 4 for k, _, _ in found)
        return *(sum(k == n for k, _, _ in found) for n in range(4)), hashlib.sha256(",".join(said[:base]).encode()).hexdigest(), ",".join(said)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        for p in parts:
            found = pd.DataFrame([row(t, automaton) for t in p.pop("t")], columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], index=p.index)
            yield pd.concat([p, found], axis=1)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInPandas(
        run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )
