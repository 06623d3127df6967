"""Regular expressions: one dialect for users, run by the JVM where it can and by Python otherwise.

The dialect has Unicode classes, `.` that stops at line feeds only, `$` for the very end,
POSIX bracket classes for ASCII, `(?P<n>)` and `(?<n>)`, look-around, back-references,
atomic groups and possessive quantifiers.  translate() gives an equivalent Java pattern or
None; compiled() gives the `regex` module's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import regex

_POSIX = {
    "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": r"\x20-~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r\x20",
    "upper": "A-Z", "word": "a-zA-Z0-9_", "xdigit": "0-9A-Fa-f",
}
#: Unicode properties by the names that users write, with their Java names.
_PROPERTIES = {
    "letter": "L", "lowercase_letter": "Ll", "uppercase_letter": "Lu", "titlecase_letter": "Lt", "modifier_letter": "Lm",
    "other_letter": "Lo", "mark": "M", "number": "N", "decimal_number": "Nd", "letter_number": "Nl", "other_number": "No",
    "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C", "alphabetic": "IsAlphabetic", "lowercase": "IsLowercase",
    "uppercase": "IsUppercase", "white_space": "IsWhite_Space",
    **{x.lower(): x for x in "L Ll Lu Lt Lm Lo M Mn Mc Me N Nd Nl No P Pc Pd Ps Pe Pi Pf Po S Sm Sc Sk So Z Zs Zl Zp C Cc Cf Co Cn".split()},
}


class InvalidPattern(ValueError):
    """A pattern that doesn't compile."""


@dataclass(frozen=True)
class Pattern:
    """A user's pattern with what planning needs to know of it."""

    source: str
    groups: tuple[str, ...]  # keys of groups 1, 2, ... : their name, else their number
    java: str | None
    may_be_empty: bool
    optional_groups: bool

    @property
    def native(self) -> bool:
        return self.java is not None and not self.may_be_empty


def _hex(pattern: str) -> str:
    """\\h is a hexadecimal digit here, and \\z the very end, in both engines."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\h", r"\1[0-9A-Fa-f]", pattern)


def _python(source: str) -> str:
    """The pattern for the regex module: `$` without (?m) is the very end."""
    out, i, bracket = [], 0, 0
    multiline = re.search(r"\(\?[a-zA-Z]*m", source) is not None
    source = _hex(source)
    while i < len(source):
        c = source[i]
        if c == "\\":
            pair = source[i : i + 2]
            out.append({r"\z": r"\Z", r"\A": r"\A"}.get(pair, pair))
            i += 2
            continue
        if bracket and source.startswith("[:", i) and (m := re.compile(r"\[:(\^?)(\w+):\]").match(source, i)) and m.group(2) in _POSIX:
            if m.group(1):
                raise InvalidPattern(f"negated POSIX class in {source!r}")
            out.append(_POSIX[m.group(2)])
            i = m.end()
            continue
        if c == "[":
            bracket += 1
        elif c == "]" and bracket:
            bracket -= 1
        elif c == "$" and not bracket and not multiline:
            c = r"\Z"
        out.append(c)
        i += 1
    return "".join(out)


@lru_cache(maxsize=256)
def compiled(source: str) -> regex.Pattern:
    try:
        return regex.compile(_python(source), regex.V1 if "&&" in source or "--" in source else regex.V0)
    except regex.error as e:
        raise InvalidPattern(f"{source!r}: {e}") from None


def _java(source: str) -> str | None:
    """An equivalent Java pattern, or None if there's doubt."""
    if regex.search(r"\(\?\(|\\K|\\G|\\X|\\R|\\p\{[^}]*[=:]|\(\?R|\(\?&|\\N|\(\?#|\(\?[a-zA-Z]*x", source):
        return None
    out, i, bracket, names = [], 0, 0, 0
    multiline = re.search(r"\(\?[a-zA-Z]*m", source) is not None
    source = _hex(source)
    while i < len(source):
        c = source[i]
        if c == "\\":
            pair = source[i : i + 2]
            if pair in (r"\p", r"\P"):
                m = re.compile(r"\\[pP](?:\{(\^?)([A-Za-z_ ]+)\}|([A-Z]))").match(source, i)
                name = _PROPERTIES.get((m.group(2) or m.group(3)).lower().replace(" ", "_")) if m else None
                if name is None or m.group(1):
                    return None
                out.append(f"{pair}{{{name}}}")
                i = m.end()
                continue
            if pair[1:].isalpha() and pair[1] not in "wWdDsSbBnrtfaeAzxu":
                return None
            if pair == r"\u" and not re.compile(r"\\u[0-9a-fA-F]{4}").match(source, i):
                return None
            out.append(pair)
            i += 2
            continue
        if bracket:
            if source.startswith("[:", i):
                m = re.compile(r"\[:(\w+):\]").match(source, i)
                if m is None or m.group(1) not in _POSIX:
                    return None
                out.append(_POSIX[m.group(1)])
                i = m.end()
                continue
            if c == "[":
                out.append(r"\[")  # a bare bracket inside a class is itself
                i += 1
                continue
            if source.startswith("&&", i) or source.startswith("--", i) or source.startswith("~~", i):
                return None
            if c == "]":
                bracket = 0
        elif c == "[":
            bracket = 1
            out.append(c)
            i += 1
            if i < len(source) and source[i] == "^":
                out.append("^")
                i += 1
            if i < len(source) and source[i] == "]":
                out.append(r"\]")
                i += 1
            continue
        elif c == "$" and not multiline:
            c = r"\z"
        elif source.startswith("(?P<", i) or (source.startswith("(?<", i) and source[i + 3 : i + 4] not in ("=", "!")):
            end = source.index(">", i)
            out.append("(")  # groups are taken by number
            names += 1
            i = end + 1
            continue
        elif source.startswith("(?P", i):
            return None
        out.append(c)
        i += 1
    if names and re.search(r"\\k", source):
        return None
    return "(?dU)" + "".join(out)


def _can_be_empty(source: str) -> bool:
    """Conservative: also true where look-around or anchors might be the whole match."""
    if compiled(source).fullmatch("") is not None:
        return True
    import re._parser as parser  # noqa: PLC2701

    try:
        return parser.parse(re.sub(r"\(\?P?<([A-Za-z]\w*)>", "(", re.sub(r"\\[pPhzX](\{[^}]*\})?", "a", source))).getwidth()[0] == 0
    except (re.error, RecursionError, OverflowError):
        return True


def _optional_groups(pattern: str, count: int) -> bool:
    """Whether a group may be left out of a match; conservative."""
    if not count:
        return False
    bare = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "x", pattern)
    return bool(re.search(r"\||\)(?:[?*]|\{0|\{,)|\(\?!|\(\?<!", bare))


@lru_cache(maxsize=256)
def analyse(source: str) -> Pattern:
    p = compiled(source)
    names = {v: k for k, v in p.groupindex.items()}
    groups = tuple(names.get(i, str(i)) for i in range(1, p.groups + 1))
    return Pattern(source, groups, _java(source), _can_be_empty(source), _optional_groups(source, p.groups))
