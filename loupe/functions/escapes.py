"""Backslash escapes and replacement templates, both handled once, at planning time."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SIMPLE = {
    "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", "'": "'",
    '"': '"', "$": "$", "`": "`", " ": " ",
}


class InvalidEscape(ValueError):
    """A backslash sequence that means nothing."""


class UndefinedVariable(ValueError):
    """A template variable that no capture group provides."""


class MismatchedBraces(ValueError):
    """A braced template variable without its closing brace."""


def unescape(text: str) -> str:
    """Resolve backslash escapes."""

    def one(m: re.Match) -> str:
        simple, code, wide, octal = m.group("s"), m.group("x"), m.group("u"), m.group("o")
        if simple is not None and simple in _SIMPLE:
            return _SIMPLE[simple]
        digits = code or wide
        if digits or octal:
            value = int(digits, 16) if digits else int(octal, 8)
            if value < 0x110000 and not 0xD800 <= value < 0xE000:
                return chr(value)
        raise InvalidEscape(f"invalid escape sequence in {text!r}")

    pattern = r"\\(?:x(?P<x>[0-9a-fA-F]{2})|u(?:\{(?P<u>[0-9a-fA-F]{1,6})\}|(?P<u4>[0-9a-fA-F]{4}))|(?P<o>[0-7]{1,3})|(?P<s>.)|$)"

    def either(m: re.Match) -> str:
        if m.group("u4") is not None:
            value = int(m.group("u4"), 16)
            if 0xD800 <= value < 0xE000:
                raise InvalidEscape(f"invalid escape sequence in {text!r}")
            return chr(value)
        return one(m)

    return re.sub(pattern, either, text, flags=re.DOTALL)


@dataclass(frozen=True)
class Variable:
    """A reference to a capture group, by name or decimal number."""

    name: str


def parse_template(template: str) -> list[str | Variable]:
    """Literal parts and variables of a replacement.

    `$$` is a dollar sign; `$name`, `$1`, `${name}` and `${1}` are variables; a dollar sign,
    with or without an opening brace, that starts neither stays as it is.  Leading zeros of
    a number don't matter.
    """
    out: list[str | Variable] = []
    literal, at, n = "", 0, len(template)
    while at < n:
        c = template[at]
        if c != "$":
            literal += c
            at += 1
            continue
        if template.startswith("$$", at):
            literal += "$"
            at += 2
            continue
        braced = template.startswith("${", at)
        begin = at + 1 + braced
        m = re.compile(r"[^\W\d]\w*|[0-9]+").match(template, begin)
        if m is None:
            literal += template[at:begin]
            at = begin
            continue
        name = str(int(m.group())) if m.group().isdigit() else m.group()
        end = m.end()
        if braced:
            if not template.startswith("}", end):
                raise MismatchedBraces(name)
            end += 1
        if literal:
            out.append(literal)
            literal = ""
        out.append(Variable(name))
        at = end
    if literal:
        out.append(literal)
    return out


def inject(template: str, variables: dict[str, str]) -> str:
    """The template with the variables' values."""
    out = []
    for part in parse_template(template):
        if isinstance(part, str):
            out.append(part)
        elif part.name in variables:
            out.append(variables[part.name])
        else:
            raise UndefinedVariable(part.name)
    return "".join(out)
