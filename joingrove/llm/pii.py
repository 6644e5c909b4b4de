"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, schemes and identifier cues.
A deterministic parser per kind expands each anchor to both sides and validates what it took. No
pattern is tried at every place of a text, so the cost follows the number of anchors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joingrove.llm.common import map_batches, ship, texts

# The kinds in their order (at one start the earlier comes first), anchors and alphabets.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login", "secret")
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport")
SECRET_CUES = ("token", "secret", "password", "passwd", "api key", "api_key", "api-key", "apikey")
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
PHONE = frozenset(" ().0123456789-")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

SPAN_COLUMNS = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                "spans string")


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in sorted(DIGITS):
        found.add_word(d, ("digit", 1))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"),
                       *((c, "account") for c in ACCOUNT_CUES), *((c, "secret") for c in SECRET_CUES)):
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


# ---------------------------------------------------------------- parsers, one a kind

def _email(t: str, at: int, free: int) -> int | tuple[int, int]:
    """The address around the at-sign, at `free` at the earliest; or where the search goes on."""
    start = at
    while start > free and t[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return at + 1
    end, labels, n = at + 1, 0, len(t)
    while True:
        stop = end
        while stop < n and t[stop] in LABEL:
            stop += 1
        if stop == end:
            end -= 1  # a dot without a label after it
            break
        labels, end = labels + 1, stop
        if end < n and t[end] == ".":
            end += 1
        else:
            break
    return (start, end) if labels > 1 else at + 1


def _run(t: str, at: int) -> int:
    n = len(t)
    while at < n and t[at] in DIGITS:
        at += 1
    return at


def _ip(t: str, at: int) -> tuple[int, int, bool]:
    """Four runs of digits between dots from `at`: start, end, valid; at a shorter chain end is where it stops."""
    parts, p = [], at
    while True:
        stop = _run(t, p)
        parts.append(t[p:stop])
        if len(parts) == 4 or stop + 1 >= len(t) or t[stop] != "." or t[stop + 1] not in DIGITS:
            return at, stop, len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in parts)
        p = stop + 1


def _card(t: str, at: int) -> tuple[int, int, bool]:
    """Digits from `at` with single blanks or hyphens between them."""
    n, p = len(t), at
    while True:
        p = _run(t, p)
        if p + 1 < n and t[p] in " -" and t[p + 1] in DIGITS:
            p += 1
        else:
            break
    digits = [ord(c) - 48 for c in t[at:p] if c in DIGITS]
    return at, p, 14 <= len(digits) <= 19 and _luhn(digits)


def _luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def _phone(t: str, at: int) -> tuple[int, int, bool] | None:
    """From a plus sign to the last digit of the characters a number may hold; None if no number starts here."""
    n = len(t)
    if at + 1 >= n or t[at + 1] not in DIGITS:
        return None
    end = at + 2
    while end < n and t[end] in PHONE:
        end += 1
    while end > at + 3 and t[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return at, end, 10 <= sum(c in DIGITS for c in t[at:end]) <= 15


def _account(t: str, cue_end: int) -> tuple[int, int] | None:
    """After an identifier cue: an IBAN with right check digits, or six to eighteen digits in groups."""
    p = _value_start(t, cue_end)
    iban = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}").match(t, p)
    if iban:
        raw = iban.group().replace(" ", "").upper()
        for size in range(len(raw), 14, -1):  # a word may follow after a blank
            s = raw[:size]
            if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
                end, left = p, size
                while left:
                    left -= t[end] != " "
                    end += 1
                if end == len(t) or t[end] not in ALNUM:
                    return p, end
    start, end, _ = _card(t, p) if p < len(t) and t[p] in DIGITS else (p, p, False)
    bounded = end == len(t) or t[end] not in ALNUM
    return (start, end) if bounded and 6 <= sum(c in DIGITS for c in t[start:end]) <= 18 else None


def _value_start(t: str, p: int) -> int:
    """Past blanks, one of `:=#` or a following 'no.' or 'number', and a quote."""
    return re.compile(r"(?:[ _-]?(?:no\.?|number|num\.?|key))?[ ]{0,3}[:=#]?[ ]{0,3}[\"']?", re.I).match(t, p).end()


def _login(t: str, at: int) -> tuple[int, int] | None:
    """scheme://user:password@host around the scheme's colon."""
    start = at
    while start > 0 and t[start - 1] in ALNUM:
        start -= 1
    found = re.compile(r"://[^\s/@:]{1,256}:[^\s/@]{1,256}@[A-Za-z0-9.-]+").match(t, at)
    return (start, found.end()) if found and start < at else None


def _secret(t: str, cue_end: int) -> tuple[int, int] | None:
    """After a cue, an equals sign or colon and a value of at least eight characters with digits."""
    sign = re.compile(r"[\"']?[ ]{0,3}[:=][ ]{0,3}[\"']?").match(t, cue_end)
    value = sign and re.compile(r"[A-Za-z0-9_+/=.-]{8,}").match(t, sign.end())
    return value.span() if value and any(c in DIGITS for c in value.group()) else None


# ---------------------------------------------------------------- a text

def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start, then kind.

    email, ip, card and phone are leftmost matches that do not overlap others of their kind; one that
    fails its check is dropped and the search goes on behind it. The other kinds come on top and
    change none of these. A null or empty text has none.
    """
    t = text or ""
    low = t.lower()
    if len(low) != len(t):  # some capitals have longer small forms; places must stay
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
    out: list[tuple[str, int, int]] = []
    free = dict.fromkeys(("email", "ip", "card", "phone", "account", "login", "secret"), 0)

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        free[kind] = end
        if valid:
            out.append((kind, start, end))

    for last, (anchor, size) in _anchors().iter(low):
        at = last - size + 1
        if anchor == "digit":
            if at >= free["card"]:
                start, end, valid = _card(t, at)
                take("card", start, end, valid and end - start > 1)
            if at >= free["ip"]:
                start, end, valid = _ip(t, at)
                take("ip", start, end, valid)
        elif anchor == "at":
            if at >= free["email"]:
                found = _email(t, at, free["email"])
                if isinstance(found, tuple):
                    take("email", *found)
        elif anchor == "plus":
            if at >= free["phone"] and (found := _phone(t, at)):
                take("phone", *found)
        elif anchor == "scheme":
            if at >= free["login"] and (found := _login(t, at)):
                take("login", *found)
        elif (at == 0 or t[at - 1] not in ALNUM) and at >= free[anchor]:
            found = (_account if anchor == "account" else _secret)(t, last + 1)
            if found and found[0] >= free[anchor]:
                take(anchor, *found)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None) -> str | None:
    """The text with each stretch of overlapping spans replaced by [KIND] of its first; null stays null."""
    if not text:
        return text
    parts, at, hidden = [], 0, 0
    for kind, start, end in find_spans(text):
        if start >= hidden:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = hidden = max(hidden, end)
    return "".join(parts) + text[at:]


# ---------------------------------------------------------------- tables

def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `docs`: counts of the base kinds, a digest of their spans, and all spans."""
    def run(batches: Iterator[tuple]) -> Iterator[dict]:
        for ids, bodies in batches:
            found = [find_spans(t) for t in bodies]
            base = [[s for s in f if s[0] in BASE_KINDS] for f in found]
            yield {"doc_id": ids, **{f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in BASE_KINDS},
                   "base_sha256": [hashlib.sha256(_join(b).encode()).hexdigest() for b in base],
                   "spans": [_join(f) for f in found]}

    return map_batches(texts(docs, id_col, text_col), run, SPAN_COLUMNS)


def redacted(text: Column, spark) -> Column:
    """`text` with personal data replaced, batch by batch."""
    ship(spark)

    @F.pandas_udf("string")
    def run(bodies):
        return bodies.map(redact, na_action="ignore")

    return run(text)
