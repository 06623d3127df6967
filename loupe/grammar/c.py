"""C."""

from __future__ import annotations

from .base import Braces, Node, Query, kinds

KEYWORDS = frozenset(
    """auto break case const continue default do else enum extern for goto if inline register restrict return signed sizeof static
    struct switch typedef union unsigned volatile while""".split()
)
TYPES = frozenset(
    """void char short int long float double bool size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t
    uint16_t uint32_t uint64_t signed unsigned char16_t char32_t charptr_t nullptr_t max_align_t""".split()
)
CONTROL = ("if", "for", "while", "switch", "do", "return", "goto", "break", "continue", "case", "default", "else", "typedef")


class Parser(Braces):
    ROOT = "translation_unit"
    KEYWORDS = KEYWORDS | TYPES | {"true", "false", "NULL"}
    LEXICON = (
        ("comment", r"//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)"),
        ("include", r"(?<![^\n])[ \t]*\#[ \t]*include[^\n]*\n?"),
        ("directive", r"(?<![^\n])[ \t]*\#[ \t]*[a-z]*"),
        ("string", r'(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"'),
        ("char", r"(?:u8|[uUL])?'(?:\\.|[^'\\\n])*'"),
        ("ident", r"[^\W\d]\w*"),
        ("number", r"\.?\d(?:[eEpP][+-]|[\w.'])*"),
        ("space", r"\s+"),
        ("punct", r"->|\+\+|--|<<=?|>>=?|&&|\|\||[<>=!+\-*/%&|^]=|\.\.\.|."),
    )

    def leaf(self, x):
        if x.kind == "include":
            start = x.start + x.text.index("#")
            a = next((k for k in range(start, x.end) if self.source[k] in '<"'), None)
            if a is not None:
                b = self.source.find(">" if self.source[a] == "<" else '"', a + 1, x.end) + 1
                if b:
                    self.nodes.append(Node("system_lib_string" if self.source[a] == "<" else "string_literal", a, b))
            return Node("preproc_include", start, x.end)
        if x.kind == "string":
            return Node("string_literal", x.start, x.end)
        if x.kind == "ident" and x.text not in self.KEYWORDS and self._type(x):
            return Node("type_identifier", x.start, x.end)
        if x.kind == "ident" and self._field(x):
            return Node("field_identifier", x.start, x.end)
        return super().leaf(x) if x.kind == "ident" else None

    def _at(self, x) -> int:
        if not hasattr(self, "_index"):
            self._index = {id(y): i for i, y in enumerate(self.t)}
        return self._index[id(x)]

    def _field(self, x) -> bool:
        i = self._at(x)
        if self.is_(i - 1, ".", "->"):
            return True
        # a member declared in a structure
        j = self.within(i, "{")
        return j > 0 and (self.is_(j - 1, "struct", "union") or self.is_(j - 2, "struct", "union")) and self.is_(i + 1, ";", ",", "[", ":")

    def _type(self, x) -> bool:
        i = self._at(x)
        if self.is_(i - 1, "struct", "union", "enum"):
            return True
        k = i + 1
        while self.is_(k, "*"):
            k += 1
        begins = i == 0 or self.is_(i - 1, ";", "{", "}", "(", ",", "const", "static", "extern", "volatile", "sizeof") or self.t[i - 1].kind in ("include", "directive")
        if begins and self.ident(k) and self.t[k].text not in KEYWORDS and not self.is_(i - 1, "return"):
            return True
        j = i
        while j > 0 and not self.is_(j, ";", "{", "}", "typedef"):
            j -= 1
        if self.is_(j, "typedef") and (self.is_(i + 1, ";") or self.is_(i + 1, ")") and self.is_(i - 1, "*") and self.is_(i - 2, "(")):
            return True
        if self.is_(i + 1, ";", ",") and self.is_(i - 1, "}"):
            j = self.match.get(i - 1, 0)
            while j > 0 and not self.is_(j, "typedef", ";", "}"):
                j -= 1
            return self.is_(j, "typedef")
        return False

    def construct(self, i):
        x = self.t[i]
        if x.kind == "ident":
            if x.text in ("if", "for", "switch") and self.is_(i + 1, "("):
                self.add(f"{x.text}_statement", i, self.statement(i))
            elif x.text == "while" and self.is_(i + 1, "(") and not self._ends_do(i):
                self.add("while_statement", i, self.statement(i))
            elif x.text == "do":
                self.add("do_statement", i, self.statement(i))
            elif x.text in ("struct", "union", "enum"):
                j = i + 1
                if self.ident(j):
                    j += 1
                if self.is_(j, "{"):
                    self.add(f"{x.text}_specifier", i, self.skip(j))
                elif j > i + 1:
                    self.add(f"{x.text}_specifier", i, j)
            elif x.text not in KEYWORDS and x.text not in TYPES and self.is_(i + 1, "("):
                if not self._declares(i) and not self.is_(i - 1, "struct", "union", "enum"):
                    j = i
                    while self.is_(j - 1, ".", "->") and j > 1:
                        j = self.match.get(j - 2, j - 2)
                        j = j - 1 if self.is_(j, "[", "(") and self.ident(j - 1) else j
                    self.add("call_expression", j, self.skip(i + 1), function=(j, i + 1))
        if self._begins(i):
            self._item(i)

    def _ends_do(self, i: int) -> bool:
        return self.is_(i - 1, "}") and self.is_(self.match.get(i - 1, 0) - 1, "do")

    def _begins(self, i: int) -> bool:
        """Whether a statement or declaration may begin here."""
        if i == 0 or self.t[i - 1].kind in ("include", "directive"):
            return True
        if self.is_(i - 1, "{"):
            return not self.is_(i - 2, "=", "(", ",") and not self.is_(i - 2, "enum") and not self.is_(i - 3, "enum")
        if self.is_(i - 1, "(") and self.is_(i - 2, "for"):
            return True
        if self.is_(i - 1, ")"):
            a = self.match.get(i - 1, 0)
            return self.is_(a - 1, "if", "while", "switch") or self.is_(a - 1, "for")
        if self.is_(i - 1, ":"):
            return self.is_(i - 2, "default") or self.is_(i - 3, "case")
        return self.is_(i - 1, ";", "}", "else", "do") and not self._in_parens(i)

    def _in_parens(self, i: int) -> bool:
        return self.within(i, "(") >= 0

    def _declares(self, i: int) -> bool:
        """Whether the name at i before a parenthesis is being declared."""
        j = i - 1
        while self.is_(j, "*"):
            j -= 1
        if j < 0 or self.t[j].kind != "ident" or self.t[j].text in CONTROL or self.t[j].text in ("sizeof", "return"):
            return False
        return True

    def _specifiers(self, i: int) -> int:
        """Behind the type that a declaration begins with, or i."""
        j, seen = i, False
        while self.ident(j):
            word = self.t[j].text
            if word in ("struct", "union", "enum"):
                j += 1
                if self.ident(j):
                    j += 1
                if self.is_(j, "{"):
                    j = self.skip(j)
                seen = True
            elif word in ("const", "static", "extern", "volatile", "inline", "register", "unsigned", "signed", "auto", "restrict"):
                seen = seen or word in ("unsigned", "signed")
                j += 1
            elif word in TYPES or not seen and word not in KEYWORDS:
                seen = True
                j += 1
            else:
                break
        return j if seen else i

    def _item(self, i: int) -> None:
        if self.is_(i, "typedef"):
            end = self.until(i, ";")
            self.add("type_definition", i, end + 1)
            for k in range(i, end):
                if self.is_(k, "(") and self.is_(k + 1, "*") and self.is_(self.skip(k), "("):
                    self.add("function_declarator", k, self.skip(self.skip(k)))
            return
        if not self.ident(i) or self.t[i].text in CONTROL:
            return
        j = self._specifiers(i)
        if j == i:
            return
        k = j
        while self.is_(k, "*", "const"):
            k += 1
        if not self.ident(k) and not (self.is_(k, "(") and self.is_(k + 1, "*")):
            return
        stop = self.until(k, ";", "{", "=")
        if self.ident(k) and self.is_(k + 1, "("):
            self.add("function_declarator", k, self.skip(k + 1), declarator=k)
            if self.is_(stop, "{"):
                self.add("function_definition", i, self.skip(stop))
                return
        if self._in_struct(i):
            self.add("field_declaration", i, self.until(k, ";") + 1)
        elif self.is_(self.until(k, ";"), ";"):
            self.add("declaration", i, self.until(k, ";") + 1)

    def _in_struct(self, i: int) -> bool:
        best = self.within(i, "{")
        best = None if best < 0 else best
        return best is not None and (self.is_(best - 1, "struct", "union") or self.is_(best - 2, "struct", "union"))


def parse(source: str) -> Node:
    return Parser(source).tree()


def _has_name(n: Node, s: str) -> bool:
    names = [c for c in n.children if c.kind == "identifier"]
    return any(s[c.end : n.end].lstrip().startswith("(") and c.start == n.start for c in names)


QUERIES: dict[str, Query] = {
    "comments": kinds("comment"),
    "strings": kinds("string_literal", "system_lib_string"),
    "includes": kinds("preproc_include"),
    "type-def": kinds("type_definition"),
    "enum": kinds("enum_specifier"),
    "struct": kinds("struct_specifier"),
    "variable": kinds("declaration"),
    "function": kinds("function_declarator", "call_expression", where=_has_name),
    "function-def": kinds("function_definition"),
    "function-decl": kinds("function_declarator"),
    "switch": kinds("switch_statement"),
    "if": kinds("if_statement"),
    "for": kinds("for_statement"),
    "while": kinds("while_statement"),
    "union": kinds("union_specifier"),
    "do": kinds("do_statement"),
    "identifier": kinds("identifier"),
    "declaration": kinds("declaration"),
    "call-expression": kinds("call_expression"),
}
