"""TypeScript."""

from __future__ import annotations

import re

from .base import Braces, Node, Query, kinds

KEYWORDS = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in
    instanceof new null return super switch this throw true try typeof var void while with let interface""".split()
)
_REGEX_BEFORE = ("(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "return", "=>", "")


class Parser(Braces):
    ROOT = "program"
    KEYWORDS = KEYWORDS
    LEXICON = (
        ("comment", r"//[^\n]*|/\*.*?(?:\*/|\Z)"),
        ("template", r"`"),
        ("string", r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'"),
        ("ident", r"[^\W\d]\w*|\$\w*|\#\w+"),
        ("number", r"\.?\d[\w.]*"),
        ("space", r"\s+"),
        ("punct", r"=>|\?\.|\?\?|===?|!==?|&&|\|\||\*\*|\+\+|--|[<>=!+\-*/%&|^]=|\.\.\.|."),
    )

    def extend(self, kind, start, end):
        if kind != "template":
            return end
        at = end
        while at < len(self.source) and self.source[at] != "`":
            if self.source[at] == "\\":
                at += 2
            elif self.source.startswith("${", at):
                depth, at = 1, at + 2
                while at < len(self.source) and depth:
                    if self.source[at] == "`":
                        at = self.extend(kind, at, at + 1)
                        continue
                    depth += (self.source[at] == "{") - (self.source[at] == "}")
                    at += 1
            else:
                at += 1
        return min(at + 1, len(self.source))

    def leaf(self, x):
        if x.kind in ("string", "template"):
            self.pieces(x)
            return None
        return super().leaf(x)

    def pieces(self, x):
        """Text pieces between quotes, escapes and substitutions."""
        a, end = x.start + 1, x.end - 1
        at = a
        while at < end:
            if self.source[at] == "\\":
                m = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|u[0-9a-fA-F]{4}|.)", re.S).match(self.source, at)
                stop = m.end() if m else at + 1
            elif x.kind == "template" and self.source.startswith("${", at):
                depth, stop = 1, at + 2
                while stop < end and depth:
                    depth += (self.source[stop] == "{") - (self.source[stop] == "}")
                    stop += 1
                for n in Parser(self.source[at + 2 : stop - 1]).tree().walk():
                    if n.kind != self.ROOT:
                        self.nodes.append(Node(n.kind, n.start + at + 2, n.end + at + 2, n.field))
            else:
                at += 1
                continue
            if at > a:
                self.nodes.append(Node("string_fragment", a, at))
            at = a = stop
        if end > a:
            self.nodes.append(Node("string_fragment", a, end))

    def end_statement(self, i: int) -> int:
        """Behind a statement that ends at a semicolon or, without one, at a line end."""
        j = i
        while j < len(self.t) and not self.is_(j, ";", ")", "]", "}"):
            k = self.skip(j)
            if k < len(self.t) and "\n" in self.source[self.t[k - 1].end : self.t[k].start]:
                goes_on = self.t[k].kind == "punct" and self.t[k].text not in ("{", "@", "[", "(", "#", "}") or self.t[k - 1].kind == "punct" and self.t[k - 1].text not in (")", "]", "}", "++", "--")
                if not goes_on:
                    return k
            j = k
        return j + 1 if self.is_(j, ";") else j

    def construct(self, i):
        x = self.t[i]
        if x.kind != "ident":
            return
        word = x.text
        before = i - 1
        if word == "function" and self.ident(i + 1) and self._statement(i - 1 if self.is_(i - 1, "async") else i):
            start = i - 1 if self.is_(i - 1, "async") else i
            j = self.until(i + 1, "(")
            j = self.skip(j)
            end = self._to_body(j)
            if self.is_(end, "{"):
                self.add("function_declaration", start, self.skip(end), name=i + 1)
        elif word in ("class", "enum", "interface") and self.ident(i + 1) and not self.is_(before, ".", "new"):
            start = i
            while self.is_(start - 1, "abstract", "const", "declare") and word != "interface":
                start -= 1
            j = i + 2
            while j < len(self.t) and not self.is_(j, "{"):
                j = self.angle(j) if self.is_(j, "<") else self.skip(j)
            begin = start if word == "enum" else i if not self.is_(i - 1, "abstract") else i - 1
            kind = {"class": "class_declaration", "enum": "enum_declaration", "interface": "interface_declaration"}[word]
            if self.is_(i - 1, "abstract") and word == "class":
                kind = "abstract_class_declaration"
            begin = self._decorated(begin) if word == "class" else begin
            self.add(kind, begin, self.skip(j), name=i + 1)
            if word == "class":
                self._members(j)
        elif word == "try" and self.is_(i + 1, "{"):
            self.add("try_statement", i, self.statement(i))
        elif word in ("let", "const", "var") and self.ident(i + 1) or word in ("let", "const", "var") and self.is_(i + 1, "{", "["):
            if self.is_(i + 1, "enum"):
                return
            self._declaration(i)
        elif word == "type" and self.ident(i + 1) and self._statement(i) and self.is_(self.angle(i + 2) if self.is_(i + 2, "<") else i + 2, "="):
            self.add("type_alias_declaration", i, self.end_statement(i))
        elif word in ("namespace",) and self.ident(i + 1):
            self.add("internal_module", i, self.skip(self.until(i, "{")))
        elif word == "export":
            self.add("export_statement", i, self._export_end(i))
        elif word == "import" and not self.is_(i + 1, "(", "."):
            end = self.end_statement(i)
            self.add("import_statement", i, end)
            last = end - 1 if not self.is_(end - 1, ";") else end - 2
            if self.t[last].kind == "string":
                a = self.t[last]
                self.nodes.append(Node("import_source", a.start + 1, a.end - 1))
        if self.is_(i + 1, "<") and (self.is_(i - 1, "function", "class", "interface", "type") or self._generic_method(i)):
            self.add("type_parameters", i + 1, self.angle(i + 1))

    def _generic_method(self, i: int) -> bool:
        j = self.angle(i + 1)
        return self.is_(j, "(") and self.is_(self._to_body(self.skip(j)), "{") and self._statement(i)

    def _decorated(self, i: int) -> int:
        while i > 1 and (self.is_(i - 2, "@") or self.is_(i - 1, ")") and self.is_(self.match.get(i - 1, 0) - 2, "@")):
            i = i - 2 if self.is_(i - 2, "@") else self.match[i - 1] - 2
        return i

    def _statement(self, i: int) -> bool:
        return i == 0 or self.is_(i - 1, ";", "{", "}", "export", "default", ")", "declare", "static", "async", "public", "private", "protected") or "\n" in self.source[self.t[i - 1].end : self.t[i].start]

    def _to_body(self, j: int) -> int:
        """From behind the parameters to the body, past a result type."""
        if self.is_(j, ":"):
            j += 1
            if self.is_(j, "{"):
                j = self.skip(j)
            while j < len(self.t) and not self.is_(j, "{", ";", "=>", ")", "}", ","):
                j = self.angle(j) if self.is_(j, "<") else self.skip(j)
        return j

    def _members(self, brace: int) -> None:
        j, end = brace + 1, self.match.get(brace, brace)
        start = j
        while j < end:
            if self.is_(j, "@"):
                j = self.skip(j + 2) if self.is_(j + 2, "(") else j + 2
                start = j
                continue
            first = j
            while self.is_(j, "public", "private", "protected", "static", "async", "readonly", "abstract", "override", "get", "set", "*") and not self.is_(j + 1, "(", "=", ":", ";"):
                j += 1
            name = j
            k = self.angle(name + 1) if self.is_(name + 1, "<") else name + 1
            if self.is_(k, "(") and self.is_(self._to_body(self.skip(k)), "{"):
                j = self.skip(self._to_body(self.skip(k)))
                self.add("method_definition", first, j, name=name)
            else:
                j = max(self.end_statement(j), j + 1)
            start = j

    def _declaration(self, i: int) -> None:
        if self.is_(i - 1, "(") and self.is_(i - 2, "for", "await"):
            end = self.until(i, ";", "of", "in", ")")
            if not self.is_(end, ";"):
                return
            end += 1
        else:
            end = self.end_statement(i)
        self.add("variable_declaration" if self.t[i].text == "var" else "lexical_declaration", i, end)
        a = i + 1
        stop_all = end - 1 if self.is_(end - 1, ";") else end
        while a < stop_all:
            stop = min(self.until(a, ",", limit=stop_all), stop_all)
            if stop > a:
                self.add("variable_declarator", a, stop, name=a)
            a = stop + 1

    def _export_end(self, i: int) -> int:
        j = i + 1
        while self.is_(j, "default", "abstract", "async", "declare"):
            j += 1
        if self.is_(j, "class", "enum", "interface", "namespace", "function", "module") or self.is_(j, "const") and self.is_(j + 1, "enum"):
            k = j + 1
            while k < len(self.t) and not self.is_(k, "{"):
                k = self.angle(k) if self.is_(k, "<") else self.skip(k)
            return self.skip(k)
        return self.end_statement(i)


def parse(source: str) -> Node:
    return Parser(source).tree()


def _starts(word: str, positive: bool = True):
    return lambda n, s: n.text(s).startswith(word) is positive


QUERIES: dict[str, Query] = {
    "comments": kinds("comment"),
    "imports": kinds("import_source"),
    "strings": kinds("string_fragment"),
    "function": kinds("function_declaration"),
    "async-function": kinds("function_declaration", where=_starts("async")),
    "sync-function": kinds("function_declaration", where=_starts("async", False)),
    "method": kinds("method_definition"),
    "constructor": kinds("method_definition", where=lambda n, s: (c := n.child("name")) is not None and c.text(s) == "constructor"),
    "class": kinds("class_declaration"),
    "enum": kinds("enum_declaration"),
    "interface": kinds("interface_declaration"),
    "try-catch": kinds("try_statement"),
    "var-decl": kinds("variable_declarator"),
    "let": kinds("lexical_declaration", where=_starts("let ")),
    "const": kinds("lexical_declaration", where=_starts("const ")),
    "var": kinds("variable_declaration", where=_starts("var")),
    "type-params": kinds("type_parameters"),
    "type-alias": kinds("type_alias_declaration"),
    "namespace": kinds("internal_module"),
    "export": kinds("export_statement"),
}
