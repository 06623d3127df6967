"""Actions: what becomes of the fragments in scope."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.escapes import UndefinedVariable, inject, parse_template, unescape
from ..functions.german import WORDS
from . import fragments as G


class Action:
    """Base of all actions: act() in Python, native() as a column where the JVM can do it."""

    def act(self, text: str) -> str:
        raise NotImplementedError

    def act_with_context(self, text: str, caps: dict[str, str] | None) -> str:
        return self.act(text)

    def native(self) -> Callable[[Column], Column] | None:
        return None

    def apply(self, frags: Column) -> Column:
        native = self.native()
        if native:
            return F.transform(
                frags, lambda f: F.when(f["in_scope"], G.fragment(native(f["text"]), True, f["caps"])).otherwise(f)
            )

        def column(rows: pa.Array) -> pa.Array:
            flat = rows.flatten().to_pylist()
            new = pa.array([None if x is None else self.act(x) for x in flat], pa.string())
            lengths = rows.value_lengths().to_pylist()
            offsets, at = [], 0
            for n in lengths:
                offsets.append(None if n is None else at)
                at += n or 0
            return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), new)

        sent = F.transform(frags, lambda f: F.when(f["in_scope"], f["text"]))
        new = F.arrow_udf(column, "array<string>")(sent)
        return F.zip_with(
            frags, new, lambda f, x: F.when(f["in_scope"], G.fragment(x, True, f["caps"])).otherwise(f)
        )


class Deletion(Action):
    def act(self, text: str) -> str:
        return ""

    def native(self):
        return lambda text: F.lit("")


class Upper(Action):
    """Full Unicode upper case, with the capital sharp s."""

    def act(self, text: str) -> str:
        return text.replace("ß", "ẞ").upper()

    def native(self):
        return lambda text: F.upper(F.replace(text, F.lit("ß"), F.lit("ẞ")))


class Lower(Action):
    def act(self, text: str) -> str:
        return text.lower()

    def native(self):
        return F.lower


_SMALL = frozenset("a an and as at but by en for if in nor of on or the to v v. via vs vs.".split())


class Titlecase(Action):
    """Headline case: small words stay low inside, words of mixed case and with inner dots are kept."""

    def act(self, text: str) -> str:
        if text.upper() == text and text.lower() != text:
            text = text.lower()
        parts = regex.split(r"(\s+)", text)
        words = [i for i, p in enumerate(parts) if p and not p.isspace()]
        for n, i in enumerate(words):
            edge = n in (0, len(words) - 1) or parts[words[n - 1]].endswith((":", ".", "?", "!"))
            parts[i] = self._word(parts[i], edge)
        return "".join(parts)

    @staticmethod
    def _word(word: str, edge: bool) -> str:
        bare = word.strip("\"'“”‘’()[]{}_,;:.!?")
        if any(c.isupper() for c in bare[1:]) or regex.search(r"\w\.\w|://|^/", word):
            return word
        if not edge and bare.lower() in _SMALL:
            return word.lower()
        return "-".join(Titlecase._first(p, k == 0 or p.lower() not in _SMALL) for k, p in enumerate(word.split("-")))

    @staticmethod
    def _first(part: str, up: bool) -> str:
        for i, c in enumerate(part):
            if c.isalpha():
                return part[:i] + (c.upper() if up else c) + part[i + 1 :]
            if c.isdigit():
                break
        return part


_MARKS = regex.compile(r"\p{M}+")


class Normalization(Action):
    """Canonical decomposition without its marks."""

    def act(self, text: str) -> str:
        if text.isascii():
            return text
        return _MARKS.sub("", unicodedata.normalize("NFD", text))


class Replacement(Action):
    """A constant, or a template over capture groups where a fragment has any."""

    def __init__(self, replacement: str):
        self.replacement = unescape(replacement)
        parse_template(self.replacement)  # unbalanced braces are an error now, not later

    @property
    def variables(self) -> set[str]:
        return {p.name for p in parse_template(self.replacement) if not isinstance(p, str)}

    def act(self, text: str) -> str:
        return self.replacement

    def act_with_context(self, text: str, caps: dict[str, str] | None) -> str:
        return self.replacement if caps is None else inject(self.replacement, caps)

    def check(self, groups: tuple[str, ...] | None) -> None:
        if groups is not None and (missing := sorted(self.variables - set(groups))):
            raise UndefinedVariable(missing[0])

    def apply(self, frags: Column) -> Column:
        parts = parse_template(self.replacement)
        verbatim = F.lit(self.replacement)
        if not self.variables:
            filled = F.lit("".join(parts))
            return self._map(frags, lambda caps: F.when(caps.isNull(), verbatim).otherwise(filled))

        def value(caps: Column, name: str) -> Column:
            missing = F.raise_error(F.lit(f"undefined variable: {name}")).cast("string")
            return F.coalesce(F.try_element_at(caps, F.lit(name)), missing)

        return self._map(
            frags,
            lambda caps: F.when(caps.isNull(), verbatim).otherwise(
                F.concat(*[F.lit(p) if isinstance(p, str) else value(caps, p.name) for p in parts])
            ),
        )

    @staticmethod
    def _map(frags: Column, new: Callable[[Column], Column]) -> Column:
        return F.transform(
            frags, lambda f: F.when(f["in_scope"], G.fragment(new(f["caps"]), True, f["caps"])).otherwise(f)
        )


SYMBOLS = {
    "--": "–", "---": "—", "->": "→", "<-": "←", "-->": "⟶", "<--": "⟵", "<->": "↔", "=>": "⇒", "!=": "≠", "<=": "≤", ">=": "≥",
}
_TOKENS = r"""(?s)https://[^ "]*[ "]?|---|-->|--|->|<--|<->|<-|<=|>=|!=|=>|[^h\-<>!=]+|."""
_TOKEN = regex.compile(_TOKENS)


class Symbols(Action):
    """ASCII sequences to single symbols, from left to right; addresses are left alone."""

    def act(self, text: str) -> str:
        return "".join(SYMBOLS.get(t, t) for t in _TOKEN.findall(text))

    def native(self):
        table = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])

        def column(text: Column) -> Column:
            tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
            return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), "")

        return column


class SymbolsInverse(Action):
    """Single symbols back to ASCII."""

    def act(self, text: str) -> str:
        for ascii_, symbol in SYMBOLS.items():
            text = text.replace(symbol, ascii_)
        return text

    def native(self):
        def column(text: Column) -> Column:
            for ascii_, symbol in SYMBOLS.items():
                text = F.replace(text, F.lit(symbol), F.lit(ascii_))
            return text

        return column


class Call(Action):
    """A user's function from string to string."""

    def __init__(self, function: Callable[[str], str]):
        self.function = function

    def act(self, text: str) -> str:
        return self.function(text)


class CallColumn(Action):
    """A user's function from column to column."""

    def __init__(self, function: Callable[[Column], Column]):
        self.function = function

    def native(self):
        return self.function


#: German(words=...) takes another dictionary.
GERMAN_WORDS = WORDS


class German(Action):
    """Umlauts and sharp s from their two-letter spellings, where that gives a word."""

    def __init__(self, prefer_original: bool = False, naive: bool = False, words: frozenset[str] | None = None):
        self.prefer_original, self.naive = prefer_original, naive
        self.words = GERMAN_WORDS if words is None else frozenset(words)
        self.valid = lru_cache(maxsize=65_536)(self._valid)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "valid"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.valid = lru_cache(maxsize=65_536)(self._valid)

    def _compound(self, word: str) -> bool:
        for i in range(2, len(word) - 1):
            head, tail = word[:i], word[i:]
            if head in self.words:
                title = tail[0].upper() + tail[1:]
                if tail in self.words or title in self.words or self._compound(tail) or self._compound(title):
                    return True
        return False

    def _valid(self, word: str) -> bool:
        if not word or not all(c.isupper() or c.islower() for c in word):
            return False
        if word.islower():
            return word in self.words or self._compound(word)
        if len(word) > 1 and all(c.isupper() for c in word):
            return self._valid(word[0] + word[1:].lower().replace("ẞ", "ß"))
        if word[0].isupper() and word[1:] == word[1:].lower():
            return word in self.words or self._valid(word.lower()) or self._compound(word)
        return self._valid(word[0] + word[1:].lower() if word[0].isupper() else word.lower())

    def _word(self, word: str) -> str:
        places, i = [], 0
        while i < len(word) - 1:
            pair = word[i : i + 2].lower()
            if pair in ("ae", "oe", "ue", "ss"):
                new = {"ae": "äÄ", "oe": "öÖ", "ue": "üÜ", "ss": "ßẞ"}[pair][word[i].isupper()]
                places.append((i, new))
                i += 1
            i += 1
        if not places:
            return word
        full = (1 << len(places)) - 1
        choices = [0, full] if self.naive else sorted(range(full + 1), key=lambda m: (m.bit_count(), [-(m >> k & 1) for k in range(len(places))]))
        for mask in choices:
            if mask == 0 and not self.prefer_original:
                continue
            out, at = [], 0
            for k, (i, new) in enumerate(places):
                if mask >> k & 1:
                    out += [word[at:i], new]
                    at = i + 2
            made = "".join(out) + word[at:]
            if self.naive or self.valid(made):
                return made
        return word

    def act(self, text: str) -> str:
        return regex.sub(r"[^\W\d_]+", lambda m: self._word(m.group()), text)


class Style:
    """ANSI styles for terminals, line by line; for rows already on the driver."""

    def __init__(self, *codes: int):
        self.codes = codes

    def act(self, text: str) -> str:
        start = f"\x1b[{';'.join(map(str, self.codes))}m"
        out = []
        for line in regex.findall(r"[^\n]*\n|[^\n]+", text):
            body, end = (line[:-1], "\n") if line.endswith("\n") else (line, "")
            out.append((f"{start}{body}\x1b[0m" if body else "") + end)
        return "".join(out)


RED_BOLD, GREEN_BOLD = Style(1, 31), Style(1, 32)
