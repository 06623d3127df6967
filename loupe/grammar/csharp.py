"""C#."""

from __future__ import annotations

from .base import Braces, Node, Query, kinds, minus

KEYWORDS = frozenset(
    """abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event
    explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null
    object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string
    struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while var get set""".split()
)
MODIFIERS = ("public", "private", "protected", "internal", "static", "readonly", "abstract", "sealed", "virtual", "override", "async", "partial", "extern", "unsafe", "new", "volatile", "const", "required", "file", "fixed")
TYPES = {"class": "class_declaration", "struct": "struct_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}
BUILTIN = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void var".split())


class Parser(Braces):
    ROOT = "compilation_unit"
    KEYWORDS = KEYWORDS
    LEXICON = (
        ("comment", r"//[^\n]*|/\*.*?(?:\*/|\Z)"),
        ("directive", r"(?<![^\n])[ \t]*\#[^\n]*"),
        ("raw", r'\$*""".*?(?:"""|\Z)'),
        ("interpolated", r'\$@"|@\$"|\$"'),
        ("verbatim", r'@"(?:""|[^"])*(?:"|\Z)'),
        ("string", r'"(?:\\.|[^"\\\n])*"'),
        ("char", r"'(?:\\.[^']*|[^'\\\n])'"),
        ("ident", r"@?[^\W\d]\w*"),
        ("number", r"\.?\d[\w.]*"),
        ("space", r"\s+"),
        ("punct", r"=>|\?\?=?|\?\.|::|->|\+\+|--|&&|\|\||[<>=!+\-*/%&|^]=|\.\."),
        ("other", r"."),
    )

    def __init__(self, source: str):
        self.inner: list[Node] = []
        super().__init__(source)

    def lex(self):
        for x in super().lex():
            if x.kind == "other":
                x.kind = "punct"
            yield x

    def _format(self, a: int, b: int) -> int:
        """Where the format of an interpolated value begins: a colon outside brackets, strings and conditions."""
        depth = asked = 0
        while a < b:
            c = self.source[a]
            if c == '"':
                a = max(self.source.find('"', a + 1, b), a)
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == "?" and self.source[a + 1 : a + 2] not in ("?", ".", "["):
                asked += not depth
            elif c == ":" and not depth:
                if self.source.startswith("::", a):
                    a += 1
                elif not asked:
                    return a
                else:
                    asked -= 1
            a += 1
        return b

    def extend(self, kind, start, end):
        if kind != "interpolated":
            return end
        verbatim, at, code = "@" in self.source[start:end], end, False
        while at < len(self.source):
            c = self.source[at]
            if c == '"':
                if verbatim and self.source.startswith('""', at):
                    at += 2
                    continue
                at += 1
                break
            if c == "\n" and not verbatim:
                break
            if c == "\\" and not verbatim or self.source.startswith(("{{", "}}"), at):
                at += 2
            elif c == "{":
                depth, b = 1, at + 1
                while b < len(self.source) and depth:
                    if self.source[b] == '"':
                        q = self.source.find('"', b + 1)
                        b = q + 1 if q > 0 else b + 1
                        continue
                    depth += (self.source[b] == "{") - (self.source[b] == "}")
                    b += 1
                self.inner.append(Node("interpolation", at, b))
                for n in Parser(self.source[at + 1 : self._format(at + 1, b - 1)]).tree().walk():
                    if n.kind != self.ROOT:
                        self.inner.append(Node(n.kind, n.start + at + 1, n.end + at + 1, n.field))
                at, code = b, True
            else:
                at += 1
        self.inner.append(Node("interpolated_string_expression" if code else "interpolated_string_plain", start, at))
        return at

    def leaf(self, x):
        kind = {"raw": "raw_string_literal", "verbatim": "verbatim_string_literal", "string": "string_literal"}.get(x.kind)
        if kind:
            return Node(kind, x.start, x.end)
        return None if x.kind == "ident" and self._plain_word(x) else super().leaf(x)

    def _plain_word(self, x) -> bool:
        """Whether an identifier is a word of the language by where it is, a target or a lone parameter."""
        if not hasattr(self, "_index"):
            self._index = {id(y): i for i, y in enumerate(self.t)}
        i = self._index.get(id(x))
        if i is None:
            return False
        ahead = self.ident(i + 1) or i + 1 < self.size and self.t[i + 1].kind in ("string", "number", "interpolated", "verbatim", "raw")
        if x.text in ("assembly", "module", "field", "event", "method", "param", "property", "return", "type", "typevar"):
            return self.is_(i - 1, "[") and self.is_(i + 1, ":")
        if x.text in ("where", "partial", "await", "from", "select", "orderby", "into", "join", "equals", "ascending", "descending"):
            return ahead and not self.is_(i - 1, ".") and not self.is_(i + 1, "is", "as", "in")
        if x.text == "async":
            return ahead or self.is_(i + 1, "(") and not self.is_(i - 1, ".")
        return self.is_(i + 1, "=>") and self.is_(i - 1, "(", ",", "=", "return", "=>", "async")

    def finish(self):
        self.nodes += self.inner

    def _level(self, i: int) -> tuple[str, int]:
        """What the innermost braces around i are: a type, code, or the file."""
        around = self.around[i]
        if around < 0:
            return "file", -1
        if not self.is_(around, "{"):
            return "group", around
        return self.brace.get(around, "code"), around

    def tree(self):
        self.brace: dict[int, str] = {}
        for i in range(len(self.t)):
            if self.t[i].text in TYPES and self.ident(i + 1) or self.is_(i, "namespace"):
                if self.is_(i, "record") and not self.ident(i + 1):
                    continue
                j = self.until(i + 1, "{", ";")
                if self.is_(j, "{"):
                    self.brace[j] = "enum" if self.is_(i, "enum") else "file" if self.is_(i, "namespace") else "type"
        return super().tree()

    def _first(self, i: int) -> int:
        """First token of a declaration, its attributes and modifiers included."""
        while self.is_(i - 1, *MODIFIERS):
            i -= 1
        while self.is_(i - 1, "]") and self._attributes(self.match.get(i - 1, -1)):
            i = self.match[i - 1]
            while self.is_(i - 1, *MODIFIERS):
                i -= 1
        return i

    def _attributes(self, i: int) -> bool:
        return i >= 0 and self.is_(i, "[") and (i == 0 or self.is_(i - 1, "{", "}", ";", "]", "(", ",")) and self.ident(i + 1) and not self.is_(i - 1, "=")

    def _type(self, i: int) -> int:
        """Behind a type that begins at i, or i."""
        while self.is_(i, "ref", "readonly"):
            i += 1
        if not self.ident(i) or self.t[i].text in KEYWORDS - BUILTIN:
            if not (self.is_(i, "(") and self.ident(self.skip(i))):
                return i
            j = self.skip(i)
        else:
            j = i + 1
        while j < len(self.t):
            if self.is_(j, ".", "::") and self.ident(j + 1):
                j += 2
            elif self.is_(j, "<"):
                j = self.angle(j)
            elif self.is_(j, "?", "*"):
                j += 1
            elif self.is_(j, "[") and (self.is_(j + 1, "]", ",")):
                j = self.skip(j)
            else:
                break
        return j

    def construct(self, i):
        x = self.t[i]
        if self._attributes(i) and x.text == "[" and self._level(i)[0] != "code":
            j, end = i + 1, self.match.get(i, i)
            if self.is_(j + 1, ":"):
                j += 2
            while j < end:
                stop = self.until(j, ",")
                self.add("attribute", j, min(stop, end))
                j = stop + 1
            return
        if x.kind != "ident" and not self.is_(i, "~", "("):
            return
        level, brace = self._level(i)
        if x.text in TYPES and self.ident(i + 1) and x.text != "record":
            j = self.until(i + 1, "{", ";")
            self.add(TYPES[x.text], self._first(i), self.skip(j), name=i + 1)
        elif x.text == "using" and level == "file" and not self.is_(i + 1, "("):
            end = self.until(i, ";")
            self.add("using_directive", i, end + 1)
            a = i + 1
            while self.is_(a, "static") or self.is_(a + 1, "="):
                if self.is_(a + 1, "="):
                    self.add("using_name", a, a + 1)
                a += 2 if self.is_(a + 1, "=") else 1
            if a < end:
                self.add("using_name", a, end)
        elif level == "type" and self._begins(i):
            self._member(i)
        elif level in ("code",) and self._starts(i) or level == "group" and self.is_(i - 1, "(") and self.is_(i - 2, "for", "using", "fixed"):
            j = self._type(i + (1 if self.is_(i, "const", "using") else 0))
            i += 1 if self.is_(i, "const", "using") else 0
            if j > i and self.ident(j) and self.t[j].text not in KEYWORDS and self.is_(j + 1, "=", ";", ","):
                stop = self.until(j, ";")
                self.add("variable_declaration", i, stop)

    def _starts(self, i: int) -> bool:
        return self.is_(i - 1, ";", "{", "}", ":", "else") or self.is_(i - 1, ")") and self.is_(self.match.get(i - 1, 0) - 1, "if", "for", "foreach", "while", "using", "lock")

    def _begins(self, i: int) -> bool:
        """Whether the first token behind a member's modifiers is at i."""
        if self.is_(i, *MODIFIERS):
            return False
        j = i
        while self.is_(j - 1, *MODIFIERS):
            j -= 1
        return self.is_(j - 1, "{", "}", ";") or self.is_(j - 1, "]") and self._attributes(self.match.get(j - 1, -1))

    def _body(self, j: int) -> int:
        j = self.until(j, "{", ";", "=>")
        if self.is_(j, "=>"):
            return self.until(j, ";") + 1
        return self.skip(j) if self.is_(j, "{") else j + 1

    def _member(self, i: int) -> None:
        first = self._first(i)
        if self.is_(i, "~"):
            self.add("destructor_declaration", i, self._body(self.skip(i + 2)), name=i + 1)
            return
        if self.ident(i) and self.is_(i + 1, "(") and self.t[i].text not in KEYWORDS:
            self.add("constructor_declaration", first, self._body(self.skip(i + 1)), name=i)
            return
        if self.is_(i, "event", "delegate"):
            end = self.until(i, ";", "{")
            if self.is_(i, "event") and self.is_(end, ";"):
                self.add("event_field_declaration", first, end + 1)
                self.add("variable_declaration", i + 1, end)
            return
        j = self._type(i)
        if j == i or not (self.ident(j) or self.is_(j, "this")) or self.is_(j, "operator"):
            return
        k = j + 1
        while self.is_(k, ".") and self.ident(k + 1):
            k += 2
        if self.is_(k, "<"):
            k = self.angle(k)
        if self.is_(k, "("):
            self.add("method_declaration", first, self._body(self.skip(k)), name=j)
        elif self.is_(k, "{"):
            end = self.skip(k)
            if self.is_(end, "="):
                end = self.until(end, ";") + 1
            self.add("property_declaration", first, end, name=j)
        elif self.is_(k, "=>"):
            self.add("property_declaration", first, self.until(k, ";") + 1, name=j)
        elif self.is_(k, "=", ";", ",", "["):
            end = self.until(k, ";")
            self.add("field_declaration", first, end + 1)
            self.add("variable_declaration", i, end)


def parse(source: str) -> Node:
    return Parser(source).tree()


def _hole(n: Node, s: str) -> bool:
    return n.parent is not None and n.parent.kind == "interpolated_string_expression"


QUERIES: dict[str, Query] = {
    "comments": kinds("comment"),
    "usings": kinds("using_name"),
    "strings": minus(
        kinds("string_literal", "verbatim_string_literal", "raw_string_literal", "interpolated_string_expression"),
        kinds("interpolation", where=_hole),
    ),
    "struct": kinds("struct_declaration"),
    "enum": kinds("enum_declaration"),
    "interface": kinds("interface_declaration"),
    "class": kinds("class_declaration"),
    "method": kinds("method_declaration"),
    "variable-declaration": kinds("variable_declaration"),
    "property": kinds("property_declaration"),
    "constructor": kinds("constructor_declaration"),
    "destructor": kinds("destructor_declaration"),
    "field": kinds("field_declaration"),
    "attribute": kinds("attribute"),
    "identifier": kinds("identifier"),
}
