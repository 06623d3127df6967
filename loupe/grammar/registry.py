"""Languages and their prepared queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from importlib import import_module

from ..functions.ranges import Range, merge
from .base import Node, Query

LANGUAGES = ("c", "csharp", "go", "hcl", "python", "rust", "typescript")


def language(name: str):
    if name not in LANGUAGES:
        raise ValueError(f"unknown language: {name}")
    return import_module(f"loupe.grammar.{name}")


def check_pattern(pattern: str) -> str:
    """Name patterns have no look-around and no back-references."""
    if re.search(r"\(\?<?[=!]|\\[1-9]", pattern):
        raise ValueError(f"unsupported name pattern: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid name pattern: {pattern!r}: {e}") from None
    return pattern


def prepared(name: str, query: str) -> Query:
    """The query of that name, or `name~PATTERN` for those that filter by an item's name."""
    module = language(name)
    item, mark, pattern = query.partition("~")
    if mark:
        if item not in getattr(module, "NAMED", {}):
            raise ValueError(f"{name} has no {item} that takes a pattern")
        return module.NAMED[item](check_pattern(pattern))
    if item not in module.QUERIES:
        raise ValueError(f"{name} has no query {item!r}")
    return module.QUERIES[item]


@lru_cache(maxsize=64)
def tree(name: str, source: str) -> Node:
    return language(name).parse(source)


def ranges(name: str, query: str) -> Callable[[str], list[Range]]:
    prepared(name, query)  # wrong names fail now

    def run(text: str) -> list[Range]:
        return merge(prepared(name, query)(tree(name, text), text))

    return run
