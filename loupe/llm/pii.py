"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Spans are half-open ranges of characters (code points).  A card number must pass Luhn,
an IBAN mod-97 with its country's length, an IPv4 address must have octets up to 255;
proposals that fail are dropped whatever their context.  Cards and IBANs are tried at every
start, with every length that ends where a group does.  Of overlapping spans the one
with the higher score stays, then the longer, then the earlier, then the kind first by name.

Defined results: null and empty texts have no spans and stay as they are; texts of any
length are scanned whole, in time that grows with their length and the number of spans; null
doc_ids and repeated rows give their spans each; an empty table gives an
empty result; find() reads doc_id and text only; redact() rewrites `text`, and `n_chars`
where there is such a column, and leaves every other column alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.5
BEFORE, AFTER = 48, 24
SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"

def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return len(set(digits)) > 1 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27,
    "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}


def mod97(text: str) -> bool:
    s = re.sub(r"[ -]", "", text).upper()
    if len(s) != IBAN_LENGTHS.get(s[:2]):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def octets(text: str) -> bool:
    return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in text.split("."))


def area(text: str) -> bool:
    a, b, c = text.split("-")
    return a not in ("000", "666") and a < "900" and b != "00" and c != "0000"


def seven(text: str) -> bool:
    return 7 <= sum(c.isdigit() for c in text) <= 15


#: kind, pattern, validator, score once valid, words that raise it, words that lower it
Rule = tuple[str, re.Pattern, Callable[[str], bool] | None, float, frozenset, frozenset]


def _rule(kind: str, pattern: str, valid, score: float, good: str, bad: str = "") -> Rule:
    return kind, re.compile(pattern), valid, score, frozenset(good.split()), frozenset(bad.split())


_NUMBERS = "order invoice sku isbn version serial ticket item part model build article ref reference"
RULES: tuple[Rule, ...] = (
    _rule(
        "EMAIL", r"(?<![\w.+-])[A-Za-z0-9_](?:[\w.+-]{0,62}[A-Za-z0-9_+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])",
        None, 0.9, "mail email contact write reach e-mail correo courriel",
    ),
    _rule(
        "CARD", r"(?<![\w.-])(?=(\d(?:[ -]?\d){12,18}))", luhn, 0.75,
        "card visa mastercard amex credit debit payment cc cvv karte tarjeta carte", _NUMBERS,
    ),
    _rule(
        "IBAN", r"(?<!\w)(?=([A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}))", mod97, 0.9,
        "iban account bank konto transfer bic swift compte cuenta",
    ),
    _rule(
        "IP", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w])(?!\.\d)", octets, 0.65,
        "ip host address server client adresse", "version release v section chapter kapitel",
    ),
    _rule(
        "SSN", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", area, 0.45, "ssn social security tax taxpayer", _NUMBERS,
    ),
    _rule(
        "PHONE", r"(?<![\w.+-])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-])", seven, 0.75,
        "phone call tel telephone mobile cell fax whatsapp telefon teléfono téléphone", _NUMBERS,
    ),
    _rule(
        "PHONE", r"(?<![\w.+-])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-])", seven, 0.65,
        "phone call tel telephone mobile cell fax whatsapp telefon teléfono téléphone", _NUMBERS,
    ),
    _rule(
        "PHONE", r"(?<![\w.+-])(?<!\) )\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])", seven, 0.4,
        "phone call tel telephone mobile cell fax whatsapp telefon teléfono téléphone", _NUMBERS,
    ),
    _rule("KEY", r"A(?<![A-Z0-9]A)(?:KIA|SIA)[A-Z0-9]{16}(?![A-Z0-9])", None, 0.95, ""),
    _rule("SECRET", r"(?i)(?<![^\W_])(?:password|passwd|secret|api_?key|(?:access|auth|api|bearer|id|refresh|session)?token)\s?[=:]\s?[\"']?([^\s\"']{8,})", None, 0.7, ""),
)

#: Where a card or an IBAN may end: not within a word or number, but before a further group.
_CARD_END, _IBAN_END = re.compile(r"(?![\w-])(?!\.\d)|(?=-\d)"), re.compile(r"(?!\w)")


def _ends(kind: str, text: str, a: int, b: int) -> list[int]:
    """Ends of the proposals that start at a and reach b at most."""
    if kind not in ("CARD", "IBAN"):
        return [b]
    size = 13 if kind == "CARD" else IBAN_LENGTHS.get(text[a : a + 2], 99)
    places = [i + 1 for i in range(a, b) if text[i] not in " -"]
    if kind == "IBAN":
        return [i for i in places[size - 1 : size] if _IBAN_END.match(text, i)]
    return [i for i in places[size - 1 :] if _CARD_END.match(text, i)]


_DIGITS, _AT, _NAMES = re.compile(r"\d+"), re.compile("@[A-Za-z0-9.-]*"), ("passw", "secret", "apikey", "api_key", "token")


def _windows(trigger: re.Pattern, before: int, after: int, text: str) -> list[tuple[int, int]]:
    """Ranges of the text, apart from each other, that hold every match around a trigger."""
    out: list[tuple[int, int]] = []
    for m in trigger.finditer(text):
        a, b = max(0, m.start() - before), m.end() + after
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
WEIGHT_GOOD, WEIGHT_BAD = 0.2, 0.3


def spans(text: str | None, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by start."""
    text = text or ""
    everything = [(0, len(text))]
    folded = text.casefold()
    around = {
        "EMAIL": _windows(_AT, 70, 1, text) if "@" in text else [],  # a domain of any length, and what follows
        "KEY": everything if "AKIA" in text or "ASIA" in text else [],
        "SECRET": everything if any(name in folded for name in _NAMES) else [],
    }
    numbers = _windows(_DIGITS, 8, 72, text)
    found = []
    for kind, pattern, valid, score, good, bad in RULES:
        places = (m.span(m.lastindex or 0) for a, b in around.get(kind, numbers) for m in pattern.finditer(text, a, b))
        for a, b in ((a, end) for a, b in places for end in _ends(kind, text, a, b)):
            if valid is not None and not valid(text[a:b]):
                continue
            s = score
            if good or bad:
                near = text[max(0, a - BEFORE) : a] + " " + text[b : b + AFTER]
                words = {w.lower() for w in _WORD.findall(near)}
                s += WEIGHT_GOOD * bool(words & good) - WEIGHT_BAD * bool(words & bad)
            if s >= min_score:
                found.append((kind, a, b, round(min(s, 1.0), 3)))
    found.sort(key=lambda x: (-x[3], x[1] - x[2], x[1], x[0]))
    starts: list[int] = []  # of what is kept, in order, so that a proposal meets its neighbours only
    kept: list[tuple[str, int, int, float]] = []
    for x in found:
        i = bisect_left(starts, x[1])
        if (i == 0 or kept[i - 1][2] <= x[1]) and (i == len(kept) or x[2] <= kept[i][1]):
            starts.insert(i, x[1])
            kept.insert(i, x)
    return kept


def redacted(text: str | None, min_score: float = MIN_SCORE) -> str | None:
    """The text with every span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b, _ in spans(text, min_score):
        out += [text[at:a], f"<{kind}>"]
        at = b
    return text if not out else "".join(out) + text[at:]


def span_column(text: Column, min_score: float = MIN_SCORE) -> Column:
    kind = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    )

    def column(texts: pa.Array) -> pa.Array:
        names = ("kind", "start", "end", "score")
        return pa.array([[dict(zip(names, s)) for s in spans(x, min_score)] for x in texts.to_pylist()], type=kind)

    return F.arrow_udf(column, SPANS)(text)


def find(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, kind, start, end, score): one row for each span."""
    return (
        docs.select("doc_id", "text")
        .where("text is not null")
        .select("doc_id", F.explode(span_column(F.col("text"), min_score)).alias("s"))
        .select("doc_id", "s.kind", "s.start", "s.end", "s.score")
    )


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs with personal data replaced in `text`."""

    def column(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(x, min_score) for x in texts.to_pylist()], type=texts.type)

    new = F.arrow_udf(column, "string")("text")
    text = F.col("__lp_new")
    out = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return docs.withColumn("__lp_new", new).withColumns(out).select(*[F.col(f"`{c}`") for c in docs.columns])
