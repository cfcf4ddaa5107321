"""Column expressions over names, relations and texts."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that matches any of the words as a substring."""
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in words)


def strip(c: Column) -> Column:
    """Text without white space at its ends.  Optimizers repeat this for each use, so it is no pattern."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def norm(c: Column, default: str = "UNK") -> Column:
    """Trimmed text; the default for null, blank, ``none`` and ``nan``."""
    t = strip(c)
    return F.when(t.isNull() | (t == "") | F.lower(t).isin("none", "nan"), F.lit(default)).otherwise(t)


def entity_type(c: Column) -> Column:
    """A type of the closed vocabulary, by letters only and through its aliases."""
    key = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}]", "")
    aliases = F.create_map(*(F.lit(x) for pair in vocab.TYPE_ALIASES.items() for x in pair))
    key = F.coalesce(F.try_element_at(aliases, key), key)
    return F.when(key.isin(*vocab.ENTITY_TYPES), key).otherwise(F.lit("UNK"))


def raw_type(c: Column) -> Column:
    """A type as it is, in upper case."""
    return F.upper(norm(c))


def causal_family(rel: Column, variant: str = "historical") -> Column:
    low = F.lower(F.coalesce(rel, F.lit("")))
    out = F.lit("OTHER")
    for family, words in reversed(vocab.FAMILIES[variant]):
        out = F.when(low.rlike(any_of(words)), F.lit(family)).otherwise(out)
    return out


def polarity(rel: Column, variant: str = "historical") -> Column:
    """historical: neutral unless exactly one side is hit; live: negative first."""
    low = F.lower(F.coalesce(rel, F.lit("")))
    neg, pos = (vocab.NEGATIVE, vocab.POSITIVE) if variant == "historical" else (vocab.LIVE_NEGATIVE, vocab.LIVE_POSITIVE)
    bad, good = low.rlike(any_of(neg)), low.rlike(any_of(pos))
    if variant == "historical":
        return F.when(bad & ~good, "negative").when(good & ~bad, "positive").otherwise("neutral")
    return F.when(bad, "negative").when(good, "positive").otherwise("neutral")


def sentiment_polarity(c: Column) -> Column:
    return F.when(c > 0.15, "positive").when(c < -0.15, "negative").otherwise("neutral")


def is_junk(name: Column) -> Column:
    n = F.lower(strip(F.coalesce(name, F.lit(""))))
    return (F.length(n) < 2) | n.isin(*vocab.JUNK_NAMES) | n.rlike("|".join(f"(?:{p})" for p in vocab.JUNK_PATTERNS))


def alias_key(name: Column) -> Column:
    n = F.lower(name)
    for suffix in vocab.ALIAS_SUFFIXES:
        n = F.regexp_replace(n, suffix.replace(".", r"\.") + r"\z", "")
    return F.regexp_replace(n, "[^a-z0-9]", "")


def is_ranked_junk(name: Column) -> Column:
    """Names that are not ranked; the list is looked up before trimming."""
    low = F.lower(F.coalesce(name, F.lit("")))
    n = strip(low)
    return (n == "") | low.isin(*vocab.RANKED_JUNK_NAMES) | n.rlike("|".join(f"(?:{p})" for p in vocab.RANKED_JUNK_PATTERNS))


def suffix_key(name: Column) -> Column:
    """Name without articles and legal endings, which are dropped layer by layer.

    A layer that changes anything takes a word or a run of full stops, so there
    are no more layers than twice the words.
    """
    n = F.regexp_replace(F.lower(F.trim(name)), r"\s*\(the\)$", "")
    n = F.regexp_replace(n, r"^the\s+", "")

    def layer(n: Column, _: Column) -> Column:
        n = F.trim(F.regexp_replace(n, r"\.+$", ""))
        n = F.regexp_replace(n, r"\s*(?:&|and)\s+co(?:mpany)?\.?$", "")
        return F.regexp_replace(n, vocab.LEGAL_ENDINGS, "")

    n = F.aggregate(F.sequence(F.lit(1), 1 + 2 * F.size(F.split(n, r"[\s.]+"))), n, layer)
    return F.regexp_replace(F.regexp_replace(F.trim(n), r"[-\x{2010}-\x{2015}]", " "), r"\s+", " ")


def exchange_core(ticker: Column) -> Column:
    """A ticker without the suffix of its exchange."""
    return F.regexp_replace(ticker, r"\.[A-Z]{1,3}$", "")


def month_label(month: Column) -> Column:
    """2020-03 as Mar 2020; anything that is no month as it is, null as a dash."""
    names = F.array(*(F.lit(x) for x in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")))
    ok = month.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$")
    label = F.concat(F.get(names, F.substring(month, 6, 2).try_cast("int") - 1), F.lit(" "), F.substring(month, 1, 4))
    return F.when(month.isNull() | (month == ""), "—").when(ok, label).otherwise(month)


def range_label(first: Column, last: Column) -> Column:
    one = F.coalesce(first, last)
    return F.when(first.isNull() | last.isNull() | (first == last), month_label(one)).otherwise(F.concat(month_label(first), F.lit(" → "), month_label(last)))


def type_label(kind: Column) -> Column:
    """A raw type in words: FIN_INSTRUMENT as Fin instrument."""
    words = F.lower(F.regexp_replace(kind, r"[_\s]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))


def url_quote(c: Column) -> Column:
    """Percent-encoding of UTF-8 with slashes and tildes kept."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as an unsigned number."""
    turn = lambda h, unit: h.bitwiseXOR(unit.cast("long")) * 16777619 % (1 << 32)

    def step(h: Column, char: Column) -> Column:
        point = F.ascii(char)
        pair = turn(turn(h, 0xD7C0 + F.shiftright(point, 10)), 0xDC00 + point % 1024)
        return F.when(point > 0xFFFF, pair).otherwise(turn(h, point))

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(2166136261), step)


def jitter(c: Column) -> tuple[Column, Column]:
    """A small offset that depends on the name alone."""
    h = fnv1a(c)
    angle, radius = h % 3600 / 3600 * F.lit(math.pi * 2), 18 + F.shiftright(h, 12) % 60
    return F.cos(angle) * radius, F.sin(angle) * radius


def truncate(c: Column, size: int) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("…"))).otherwise(c)


def rescale(c: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Linear map of a range onto another, clamped."""
    inside = F.least(F.greatest(c.cast("double"), F.lit(float(low))), F.lit(float(high)))
    return to_low + (inside - low) * ((to_high - to_low) / (high - low))


def sparkline(values: Column) -> Column:
    """Points of a series in a box of 48 by 14."""
    most = F.greatest(F.lit(1), F.array_max(values))
    point = lambda v, i: F.format_string("%.1f,%.1f", i / F.greatest(F.lit(1), F.size(values) - 1) * 48, 14 - v / most * 12)
    return F.array_join(F.transform(values, point), " ")


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def keyword_score(fields: list[tuple[Column, int]], terms: list[str]) -> Column:
    """Sum of a field's weight for each term that it contains."""
    out = F.lit(0)
    for c, weight in fields:
        for t in terms:
            out = out + F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t.lower())).cast("int") * weight
    return out


def snippet(text: Column, terms: list[str], size: int = 400, lead: int = 80) -> Column:
    """A window of the text around the earliest hit of any term."""
    low = F.lower(text)
    hits = [F.when(F.locate(t.lower(), low) > 0, F.locate(t.lower(), low)) for t in terms]
    at = F.coalesce(F.least(*hits) if len(hits) > 1 else hits[0], F.lit(1))
    start = F.greatest(F.lit(1), at - lead)
    body = text.substr(start, F.lit(size))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + size - 1 < F.length(text), "…").otherwise(""))


def yahoo_ticker(bare: Column, country: Column) -> Column:
    """The ticker with its country's exchange suffix; one that has a dot stays."""
    suffixes = F.create_map(*(F.lit(x) for pair in vocab.COUNTRY_SUFFIX.items() for x in pair))
    suffix = F.try_element_at(suffixes, F.trim(country))
    return F.when(suffix.isNull() | bare.contains("."), bare).otherwise(F.concat(bare, suffix))


def rss_date(raw: Column, fallback: Column) -> Column:
    """Date of an RSS timestamp in UTC; the fallback where it can't be read."""
    plain = F.regexp_replace(raw, "^[A-Za-z]{3}, ", "")
    return F.coalesce(F.to_date(F.try_to_timestamp(plain, F.lit("dd MMM yyyy HH:mm:ss Z"))), fallback)
