"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over each whole text and reports anchors: at-signs, plus signs,
digits, URL schemes and identifier cues. At every anchor a deterministic local parser looks left and
right for the boundaries of an email, an address (numeric or URL) or an account and validates it.

Kinds, in the order used for ties: email, ip, card, phone (these follow fixed patterns, leftmost and
non-overlapping within a kind; a match that fails its check goes, without another try), then url
(scheme and a valid host), account (a cue, then an identifier with digits: behind a separator, or
behind one space if it has six digits or more; IBANs may have spaces and then have to pass their
check) and secret (a cue such as token or api key, a separator and a value of at least eight
characters with a digit). Cues and schemes are found in any case, values also in quotes.

Positions are code points, ends exclusive. A null or empty text has no spans; repeated rows are
handled one by one; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm.slices import by_bytes

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE_KINDS = KINDS[:4]
SCHEMA = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"

# URL schemes, and words that announce an identifier or a secret (words in them may be joined by a space, "_", "-" or nothing).
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "ssh://", "git://", "ws://", "wss://")
CUES = ("account", "acct", "iban", "customer id", "user id", "member id", "client id", "passport", "ssn", "social security", "tax id", "driver license")
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api key", "access key", "private key", "auth key", "bearer")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
_HOST = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?::[0-9]{1,5})?|localhost(?::[0-9]{1,5})?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?")
_URL_REST = re.compile(r"(?:[/?#][A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*)?")
_MORE = r"(?:[ _-]?(?:number|no\.?|num|nr\.?|id|code|key|token))?"
_SEPARATOR = r"[\"']?[ \t]{0,2}(?::=|=>|[:#=]|\bis\b)[ \t]{0,2}[\"'(]?"
_NAMED = re.compile(_MORE + f"(?P<separator>{_SEPARATOR}| )" + r"(?P<value>[A-Za-z0-9][A-Za-z0-9-]{4,33}[A-Za-z0-9])(?![A-Za-z0-9-])", re.ASCII | re.IGNORECASE)
_IBAN = re.compile(_MORE + f"(?:{_SEPARATOR}| )" + r"(?P<value>[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Z0-9])", re.ASCII)
_SECRET = re.compile(_MORE + _SEPARATOR + r"(?:bearer )?(?P<value>[A-Za-z0-9_+/.~!@#$%^&*-]{8,}=*)", re.ASCII | re.IGNORECASE)
_TO_LOWER = {c: c + 32 for c in range(65, 91)}
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for anchor, parser in [("@", "email"), ("+", "phone"), *[(d, "digit") for d in "0123456789"], *[(s, "url") for s in SCHEMES]]:
        found.add_word(anchor, (parser, len(anchor)))
    for cues, parser in ((CUES, "account"), (SECRET_CUES, "secret")):
        for form in {cue.replace(" ", joint) for cue in cues for joint in " _-"} | {cue.replace(" ", "") for cue in cues}:
            found.add_word(form, (parser, len(form)))
    found.make_automaton()
    return found


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, its local part from floor on."""
    start = at
    while start > floor and text[start - 1] in _LOCAL_CHARS:
        start -= 1
    if start < at and (m := _DOMAIN.match(text, at + 1)):
        return start, m.end()
    return None


def _dotted(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Numeric addresses in the run of dotted numbers at a digit, and the run's end: four parts each time, from the left."""
    run = _DOTTED.match(text, at)
    parts, p, found = run[0].split("."), at, []
    ends = []
    for x in parts:
        ends.append((p, p + len(x)))
        p += len(x) + 1
    for i in range(0, len(parts) - 3, 4):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts[i : i + 4]):
            found.append((ends[i][0], ends[i + 3][1]))
    return found, run.end()


def _phone(text: str, at: int) -> int | None:
    """Where the number that begins at a plus sign ends."""
    m = _PHONE.match(text, at)
    if not m:
        return None
    end = at + len(m[0].rstrip(" ().-"))
    return end if end - at >= 4 else None


def _lower(text: str) -> str:
    """Lower-case, with each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_TO_LOWER)


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier behind a cue that ends there."""
    if (m := _IBAN.match(text, at)) and _iban(m["value"]):
        return m.span("value")
    m = _NAMED.match(text, at)
    if m and sum(c in "0123456789" for c in m["value"]) >= (6 if m["separator"] == " " else 4):
        return m.span("value")
    return None


def _secret(text: str, at: int) -> tuple[int, int] | None:
    m = _SECRET.match(text, at)
    if not m:
        return None
    value = m["value"].rstrip(".!*")
    return (m.start("value"), m.start("value") + len(value)) if len(value) >= 8 and any(c in "0123456789" for c in value) else None


def spans(text: str | None) -> list[Span]:
    """All spans of a text, by start and then kind."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    past = dict.fromkeys((*KINDS, "ip_run"), 0)  # where the last match of a kind ended
    for last, (anchor, n) in _automaton().iter(_lower(text)):
        at = last + 1 - n
        if anchor == "digit":
            if at >= past["ip_run"]:
                found, past["ip_run"] = _dotted(text, at)
                out += [(s, 1, e) for s, e in found]
            if at >= past["card"] and (m := _CARD.match(text, at)):
                past["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, m.end()))
        elif anchor == "email":
            if found := _email(text, at, past["email"]):
                past["email"] = found[1]
                out.append((found[0], 0, found[1]))
        elif anchor == "phone":
            if at >= past["phone"] and (end := _phone(text, at)):
                past["phone"] = end
                if 10 <= sum(c in "0123456789" for c in text[at:end]) <= 15:
                    out.append((at, 3, end))
        elif anchor == "url":
            if at >= past["url"] and not (at and text[at - 1].isalnum()) and (host := _HOST.match(text, last + 1)):
                end = _URL_REST.match(text, host.end()).end()
                while text[end - 1] in ".,;:!?)'":
                    end -= 1
                past["url"] = end
                out.append((at, 4, end))
        elif at >= past[anchor] and not (at and text[at - 1].isalnum()) and (found := (_account if anchor == "account" else _secret)(text, last + 1)):
            past[anchor] = found[1]
            out.append((found[0], KINDS.index(anchor), found[1]))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document the number of spans of each kind, the digest of the base spans, and all spans as kind:start:end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            rows = []
            for text in b.column(1).to_pylist():
                found = spans(text)
                shown = [f"{k}:{s}:{e}" for s, e, k in found]
                base = ",".join(x for x, (_, _, k) in zip(shown, found) if k in BASE_KINDS)
                kinds = [k for _, _, k in found]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(shown)))
            columns = list(zip(*rows)) if rows else [[]] * (len(KINDS) + 2)
            types = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns, types)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
