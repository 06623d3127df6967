"""A whole request, as the command line states it, and its plan.

plan() fixes the order of scopers and actions and picks cheaper equivalent expressions
where they exist; run() applies it to a DataFrame of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import analyse
from ..functions.escapes import unescape
from ..operators.actions import (
    Action,
    Deletion,
    German,
    Lower,
    Normalization,
    Replacement,
    Symbols,
    SymbolsInverse,
    Titlecase,
    Upper,
)
from ..operators.scopers import CustomQuery, Function, Language, Scoper, general
from ..operators.view import FRAGS, TEXT, Scoped, check_scope, scoped

ALIASES = {"cs": "csharp", "py": "python", "rs": "rust", "ts": "typescript"}


class UsageError(ValueError):
    """Options that contradict each other; exit code 2."""


@dataclass(frozen=True)
class Request:
    scope: str | None = None
    literal: bool = False
    replacement: str | None = None
    upper: bool = False
    lower: bool = False
    titlecase: bool = False
    normalize: bool = False
    german: bool = False
    german_prefer_original: bool = False
    german_naive: bool = False
    symbols: bool = False
    invert: bool = False
    delete: bool = False
    squeeze: bool = False
    language: str | None = None
    prepared: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()
    query_files: tuple[str, ...] = ()
    join_language_scopes: bool = False
    fail_any: bool = False
    fail_none: bool = False
    fail_no_files: bool = False
    dry_run: bool = False
    only_matching: bool = False
    line_numbers: bool = False

    def __post_init__(self):
        composable = (
            self.replacement is not None, self.upper, self.lower, self.titlecase, self.normalize, self.german_on, self.symbols
        )
        if self.invert and not self.symbols:
            raise UsageError("--invert needs --symbols")
        if self.delete and self.squeeze:
            raise UsageError("--delete and --squeeze exclude each other")
        if self.delete and any(composable):
            raise UsageError("--delete goes with no other action")
        if (self.delete or self.squeeze) and self.scope is None and not self.language:
            raise UsageError("--delete and --squeeze need a scope")
        if self.literal and self.scope is None:
            raise UsageError("--literal-string needs a scope")
        if self.fail_any and self.fail_none:
            raise UsageError("--fail-any and --fail-none exclude each other")
        if bool(self.prepared) + bool(self.queries) + bool(self.query_files) > 1:
            raise UsageError("a language takes one kind of query")

    @property
    def german_on(self) -> bool:
        return self.german or self.german_prefer_original or self.german_naive

    @property
    def language_scopers(self) -> list[Function]:
        if not self.language:
            return []
        name = ALIASES.get(self.language, self.language)
        texts = [*self.queries]
        for path in self.query_files:
            with open(path, encoding="utf-8") as f:
                texts.append(f.read())
        return [*(Language(name, q) for q in self.prepared), *(CustomQuery(name, q) for q in texts)]

    @property
    def actions(self) -> list[Action]:
        """In the fixed order, whatever the order of the options."""
        out: list[Action] = []
        if self.replacement is not None:
            out.append(Replacement(self.replacement))
        for wanted, action in (
            (self.delete, Deletion), (self.upper, Upper), (self.lower, Lower), (self.titlecase, Titlecase),
            (self.normalize, Normalization), (self.symbols, SymbolsInverse if self.invert else Symbols),
        ):
            if wanted:
                out.append(action())
        if self.german_on:
            out.append(German(self.german_prefer_original, self.german_naive))
        return out

    @property
    def search_mode(self) -> bool:
        return self.dry_run or bool(self.language and not self.actions and not self.squeeze)

    @property
    def scopers(self) -> list[Scoper]:
        captures = bool(self.replacement is not None and Replacement(self.replacement).variables or "$" in (self.replacement or ""))
        return [general(self.scope, self.literal, captures)]

    def view(self, df: DataFrame, column: str = "text") -> Scoped:
        v = scoped(df, column)
        languages = self.language_scopers
        if self.join_language_scopes and languages:
            v = v.scope_any(languages)
        else:
            for s in languages:
                v = v.scope(s)
        for s in self.scopers:
            v = v.scope(s)
        return v

    def act(self, v: Scoped) -> Scoped:
        if self.squeeze:
            v = v.squeeze()
        for a in self.actions:
            v = v.act(a)
        return v

    def shortcut(self, column: str = "text") -> Column | None:
        """One built-in function over the whole text, where that gives the same result.

        Only texts without carriage returns take it: those may need their line ends repaired.
        """
        if self.language or self.squeeze or self.literal and self.scope is None:
            return None
        text, actions = F.col(column), self.actions
        everything = self.scope in (None, ".*") and not self.literal
        if everything and actions and all(isinstance(a, (Upper, Lower, SymbolsInverse)) for a in actions):
            new = text
            for a in actions:
                new = a.native()(new)
        elif len(actions) == 1 and isinstance(actions[0], (Deletion, Replacement)) and not everything:
            constant = "" if isinstance(actions[0], Deletion) else actions[0].replacement
            if self.literal:
                new = F.replace(text, F.lit(unescape(self.scope)), F.lit(constant))
            else:
                p = analyse(self.scope)
                if not p.native or "$" in constant:
                    return None
                new = F.regexp_replace(text, F.lit(p.java), F.lit(constant.replace("\\", "\\\\")))
        else:
            return None
        return new

    def run(self, df: DataFrame, column: str = "text", name: str | None = None) -> DataFrame:
        """df with the new text."""
        self.check(df, column)
        v = self.view(df, column)
        short = self.shortcut(column)
        acted = self.act(v).build()
        new = acted.text()
        if short is not None:
            new = F.when(~F.col(column).contains("\r"), short).otherwise(new)
        return acted.df.withColumn(name or column, new).drop(FRAGS, TEXT)

    def check(self, df: DataFrame, column: str = "text", strict: bool = False) -> None:
        """Raise as the flags ask; strict: in search mode to find nothing is a failure, too."""
        none = self.fail_none or strict and self.search_mode
        if self.fail_any or none or self.fail_no_files:
            check_scope(self.view(df, column), self.fail_any, none, self.fail_no_files)

    def search(self, df: DataFrame, *keys: str, column: str = "text", strict: bool = False) -> DataFrame:
        """Lines: with a dry run those before and after, else those that have something in scope."""
        self.check(df, column, strict)  # on all texts, before those without a hit are dropped
        v = self.view(self.prefilter(df, column), column)
        if self.dry_run:
            return v.dry_run(self.act, *keys)
        return self.act(v).lines(*keys, only_matching=self.search_mode or self.only_matching)

    def prefilter(self, df: DataFrame, column: str = "text") -> DataFrame:
        """Texts that can't have a hit are dropped at the scan: a literal is looked for with contains()."""
        if not (self.search_mode or self.only_matching):
            return df
        if self.literal and self.scope is not None:
            return df.where(F.col(column).contains(unescape(self.scope)))
        if self.scope not in (None, ".*") and not self.language:
            p = analyse(self.scope)
            if p.native:
                return df.where(F.col(column).rlike(p.java))
        return df
