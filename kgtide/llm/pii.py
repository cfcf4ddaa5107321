"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs,
digits, URL schemes, shapes of keys and cue words.  At each anchor a deterministic local parser
expands to the boundaries of the entity and validates it.  Of one kind, spans
never overlap: an anchor inside the last match of its kind is passed over,
whether or not that match was valid.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Kinds in the order in which spans are listed: fixed ones, then the method's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "credential", "secret", "identity")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AFTER_CUE = re.compile(r"(?:[ ]?(?:number|no\.?|nr\.?))?[ ]?[:#]?[ ]?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[0-9](?:-?[0-9]){5,16}(?![0-9])")
_BEFORE_STREET = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}[A-Za-z]? (?:[A-Z][A-Za-z'-]{0,30} ){1,4}$")
_HOUSE = r"[0-9]{1,5}[A-Za-z]?(?![0-9A-Za-z])"
_BEFORE_STRASSE = re.compile(r"(?<![^\W\d_])[A-ZÄÖÜ][A-Za-zäöüß-]{0,40}$")
_AFTER_STRASSE = re.compile(rf" {_HOUSE}")
_BEFORE_RUE = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}(?: bis| ter)?,? $")
_AFTER_RUE = re.compile(r" (?:(?:de|du|des|la|le|les|d'|l') ?){0,2}[A-ZÀ-Ö][\w'-]{0,40}(?: [A-ZÀ-Ö][\w'-]{0,40}){0,3}")
_AFTER_CALLE = re.compile(rf" (?:(?:de|del|la|los|las) ){{0,2}}[A-ZÀ-Ö][\w'-]{{0,40}}(?: [A-ZÀ-Ö][\w'-]{{0,40}}){{0,3}},? {_HOUSE}")
_LINK = re.compile(r"""[A-Za-z_-]{0,20}["']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}["'`]?""")
_VALUE = re.compile(r"[A-Za-z0-9+/_=.~-]{8,}+")
_SHAPES = {
    "akia": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "sk-": re.compile(r"sk-[0-9A-Za-z_-]{20,}+"),
    "xox": re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}+"),
    "eyj": re.compile(r"eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+"),
    "-----begin ": re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
}
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}([ -]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9A-Za-z])")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}$")
_USER = re.compile(r"[^\s/?#@:]{1,64}:[^\s/?#@]{1,128}@[A-Za-z0-9.-]+")

ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta")
IDENTITY_CUES = ("ssn", "social security number", "social security")
#: Names whose value is secret, and the least characters of a value that counts.
SECRET_CUES = {"password": 8, "passwd": 8, "pwd": 8, "token": 16, "secret": 16, "api_key": 16, "apikey": 16, "api key": 16, "access_key": 16, "access key": 16, "private_key": 16, "auth_key": 16}
#: Characters of a country's IBANs; words that follow one pass mod 97 by chance.
_LENGTHS = (
    "NO15 BE16 DK18 FI18 FO18 GL18 NL18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 XK20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 "
    "AE23 GI23 IL23 IQ23 TL23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 FR27 GR27 IT27 MC27 MR27 SM27 "
    "AL28 AZ28 BY28 CY28 DO28 GT28 HU28 LB28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 MT31 SC31 LC32"
)
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in _LENGTHS.split()}
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "+", "://"):
        found.add_word(mark, (mark, len(mark)))
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for cue in ACCOUNT_CUES:
        found.add_word(cue, ("account", len(cue)))
    for cue in STREET_CUES:
        found.add_word(cue, ("street", len(cue)))
    for cue in IDENTITY_CUES:
        found.add_word(cue, ("identity", len(cue)))
    for cue in SECRET_CUES:
        found.add_word(cue, ("secret", len(cue)))
    for shape in _SHAPES:
        found.add_word(shape, ("shape", len(shape)))
    for cue in ("straße", "strasse"):
        found.add_word(cue, ("strasse", len(cue)))
    found.add_word(" rue", ("rue", 4))
    for cue in ("calle", "avenida"):
        found.add_word(cue, ("calle", len(cue)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban(text: str, start: int) -> re.Match | None:
    """The IBAN at ``start`` that ends where a group does: the one as long as
    its country's are, else the longest."""
    found, m = None, _IBAN.match(text, start)
    while m:
        if iban_holds(m[0]):
            if len(m[0].replace(" ", "")) == IBAN_LENGTHS.get(m[0][:2]):
                return m
            found = found or m
        m = _IBAN.match(text, start, start + max(0, m[0].rfind(" ")))
    return found


def _secret(text: str, cue: str, last: int) -> tuple[int, int] | None:
    """The value that a secret's name is given: long enough, of letters and digits."""
    link = _LINK.match(text, last + 1)
    m = link and _VALUE.match(text, link.end())
    if not m:
        return None
    value = m[0].rstrip(".")
    if len(value) < SECRET_CUES[cue] or not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return None
    return m.start(), m.start() + len(value)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind and start."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_LOWER)
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = ip = card = phone = account = address = secret = identity = 0
    for last, (kind, width) in _ANCHORS.iter(low):
        at = last - width + 1
        if kind == "digit":
            if at >= ip:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:
                    ip = _DIGITS.match(text, at).end()
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "@":
            if at < email:
                continue
            first = at
            while first > email and text[first - 1] in _LOCAL:
                first -= 1
            if first < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out["email"].append((first, email))
        elif kind == "+":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "://":
            head = _SCHEME.search(text, max(0, at - 16), at)
            if head and (m := _USER.match(text, last + 1)):
                out["credential"].append((head.start(), m.end()))
        elif kind == "account":
            start = _AFTER_CUE.match(text, last + 1).end()
            if start >= account and (m := _iban(text, start) or _NUMBER.match(text, start)):
                account = m.end()
                out["account"].append(m.span())
        elif kind == "secret":
            if at >= secret and (span := _secret(text, low[at : last + 1], last)):
                secret = span[1]
                out["secret"].append(span)
        elif kind == "shape":
            if at >= secret and not (at and text[at - 1].isalnum()) and (m := _SHAPES[low[at : last + 1]].match(text, at)):
                secret = m.end()
                out["secret"].append(m.span())
        elif kind == "identity":
            start = _AFTER_CUE.match(text, last + 1).end()
            if start >= identity and not (at and text[at - 1].isalnum()) and (m := _SSN.match(text, start)):
                identity = m.end()
                out["identity"].append(m.span())
        elif kind == "strasse":
            before, m = _BEFORE_STRASSE.search(text, max(address, at - 50), last + 1), _AFTER_STRASSE.match(text, last + 1)
            if before and m:
                address = m.end()
                out["address"].append((before.start(), address))
        elif kind == "rue":
            before, m = _BEFORE_RUE.search(text, max(address, at - 12), at + 1), _AFTER_RUE.match(text, last + 1)
            if before and m:
                address = m.end()
                out["address"].append((before.start(), address))
        elif kind == "calle":
            m = _AFTER_CALLE.match(text, last + 1)
            if m and at >= address and text[at].isupper() and not (at and text[at - 1].isalnum()):
                address = m.end()
                out["address"].append((at, address))
        elif last + 1 == len(text) or not text[last + 1].isalnum():
            m = _BEFORE_STREET.search(text, max(address, at - 140), at)
            if m and text[at].isupper():
                address = last + 1
                out["address"].append((m.start(), address))
    return [(k, a, b) for k in KINDS for a, b in sorted(out[k])]


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become
    one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:] if out else text


def redact_table(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data redacted in ``text`` and ``length`` brought
    up to date where it is there.  All rows and columns stay; null stays null."""
    names = docs.columns
    where, size = names.index(text), names.index(length) if length in names else None
    changed = T.StructType([T.StructField(f.name, T.LongType() if i == size else f.dataType, True) for i, f in enumerate(docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t.as_py()) for t in batch.column(where)]
            cols = list(batch.columns)
            cols[where] = pa.array(texts, cols[where].type)
            if size is not None:
                cols[size] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, changed)


def op3_pii(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): counts of the fixed kinds,
    their digest and all spans.  A null text is empty; repeated rows and null ids
    have a row each; very long texts are searched whole; other columns are not
    looked at; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            digests, listed = [], []
            for t in batch.column(1):
                spans = [(k, f"{k}:{a}:{b}") for k, a, b in find_spans(t.as_py())]
                kinds = [k for k, _ in spans]
                for k in BASE:
                    counts[k].append(kinds.count(k))
                digests.append(hashlib.sha256(",".join(s for k, s in spans if k in counts).encode()).hexdigest())
                listed.append(",".join(s for _, s in spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(listed, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
