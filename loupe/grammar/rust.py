"""Rust."""

from __future__ import annotations

import re

from .base import Braces, Node, Query, either, fields, kinds, named

KEYWORDS = frozenset(
    """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return
    self Self static struct super trait true type union unsafe use where while""".split()
)
PRIMITIVES = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())
ITEMS = {"struct": "struct_item", "enum": "enum_item", "union": "union_item", "fn": "function_item", "trait": "trait_item", "mod": "mod_item", "impl": "impl_item"}


class Parser(Braces):
    KEYWORDS = (KEYWORDS - {"union"}) | PRIMITIVES
    LEXICON = (
        ("comment", r"//[^\n]*|/\*"),
        ("raw", r'b?r(?P<hash>\#*)".*?(?:"(?P=hash)|\Z)'),
        ("string", r'[bc]?"(?:\\.|[^"\\])*(?:"|\Z)'),
        ("char", r"b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'"),
        ("lifetime", r"'[^\W\d]\w*"),
        ("ident", r"(?:r\#)?[^\W\d]\w*"),
        ("number", r"\d(?:[\w]|\.(?=\d))*"),
        ("space", r"\s+"),
        ("punct", r"->|=>|::|&&|\|\||<<=|>>=|\.\.[=.]?|[<>=!+\-*/%&|^]=|."),
    )

    def lex(self):
        for x in super().lex():
            if x.text.startswith(("r", "br")) and '"' in x.text:
                x.kind = "raw"
            yield x

    def extend(self, kind, start, end):
        if self.source.startswith("/*", start) and kind == "comment":
            depth, at = 1, end
            while depth and at < len(self.source):
                m = re.compile(r"/\*|\*/").search(self.source, at)
                if m is None:
                    return len(self.source)
                depth += 1 if m.group() == "/*" else -1
                at = m.end()
            return at
        text = self.source[start:end]
        if text.startswith(("///", "//!")) and not text.startswith("////") and end < len(self.source):
            return end + 1  # a documentation comment holds its line end
        return end

    def comment(self, x):
        return Node("block_comment" if x.text.startswith("/*") else "line_comment", x.start, x.end)

    def leaf(self, x):
        if x.kind in ("string", "raw"):
            a = x.start + x.text.index('"') + 1
            b = x.start + x.text.rindex('"')
            if x.kind == "string":  # escapes part the content
                for m in re.compile(r"\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|\n\s*|.)", re.S).finditer(self.source, a, b):
                    if m.start() > a:
                        self.nodes.append(Node("string_content", a, m.start()))
                    a = m.end()
            return Node("string_content", a, b) if a < b else None
        if x.kind == "lifetime":
            return Node("identifier", x.start + 1, x.end)
        if x.kind == "ident" and x.text == "Self":
            i = self._at(x)
            return Node("identifier" if self.is_(i + 1, "::") or self._in_tree(i) else "type_identifier", x.start, x.end)
        if x.kind != "ident" or x.text in self.KEYWORDS:
            return None
        i = self._at(x)
        if x.text == "union" and self.ident(i + 1):
            return None
        if self._in_tree(i) or self._imported(i):
            return Node("identifier", x.start, x.end)
        if self.is_(i + 1, ":") and self.is_(self.around[i], "{") and self.is_(i - 1, "{", ",", "pub", ")", "]"):
            return Node("field_identifier", x.start, x.end)
        if self.is_(i - 1, ".") and not self.is_(i + 1, "(") or self.is_(i - 1, "."):
            return Node("field_identifier", x.start, x.end)
        if self._type(i):
            return Node("type_identifier", x.start, x.end)
        return Node("identifier", x.start, x.end)

    def _at(self, x):
        if not hasattr(self, "_index"):
            self._index = {id(y): i for i, y in enumerate(self.t)}
        return self._index[id(x)]

    def _in_tree(self, i):
        """Whether the token is in the arguments of an attribute or a macro, which aren't parsed any further."""
        if not hasattr(self, "_trees"):
            self._trees = set()
            for a, b in self.match.items():
                if a < b and (self.is_(a, "[") and (self.is_(a - 1, "#") or self.is_(a - 2, "#") and self.is_(a - 1, "!"))):
                    inner = next((k for k in range(a + 1, b) if self.is_(k, "(", "{", "[", "=")), b)
                    if not self.is_(inner, "="):
                        self._trees.update(range(inner, b))
                elif a < b and self.is_(a - 1, "!") and self.ident(a - 2):
                    self._trees.update(range(a, b))
        return i in self._trees

    def _imported(self, i):
        """Whether the token is in a use declaration."""
        if not hasattr(self, "_used"):
            self._used = set()
            for k in range(self.size):
                if self.is_(k, "use"):
                    self._used.update(range(k + 1, self.until(k, ";")))
        return i in self._used

    def _variant(self, i):
        a = self.around[i]
        if not self.is_(a, "{") or not self.is_(i - 1, "{", ",", "]"):
            return False
        k = a - 1
        while k > 0 and not self.is_(k, "enum", ";", "}", "{"):
            k -= 1
        return self.is_(k, "enum")

    def _type(self, i):
        text = self.t[i].text
        if self._variant(i):
            return False
        if text in ("Fn", "FnMut", "FnOnce"):
            return True
        if text[0].isupper() and text.isupper() and len(text) == 1 and not self.is_(i + 1, "(", "!", "::") and not self.is_(i - 1, "::", "const"):
            return True
        return self.is_(i - 1, "struct", "enum", "trait", "impl", "union", "type") or text[0].isupper() and not text.isupper() and not self.is_(i + 1, "(", "!", "::") and not self.is_(i - 1, "::")

    def construct(self, i):
        x = self.t[i]
        if self.is_(i, "#") and (self.is_(i + 1, "[") or self.is_(i + 1, "!") and self.is_(i + 2, "[")):
            a = i + 1 if self.is_(i + 1, "[") else i + 2
            end = self.match.get(a, a)
            self.add("attribute_item" if a == i + 1 else "inner_attribute_item", i, end + 1)
            if a + 1 < end:
                self.add("attribute", a + 1, end)
        elif self.is_(i, "|", "||") and self._closure(i):
            self._add_closure(i)
        elif x.kind != "ident":
            return
        elif x.text in ITEMS:
            self._item(i)
        elif x.text == "use":
            end = self.until(i, ";")
            self.add("use_declaration", self._visible(i)[0], end + 1, argument=(i + 1, end))
            if i + 1 < end:
                self.add("use_argument", i + 1, end)
        elif x.text == "unsafe" and self.is_(i + 1, "{"):
            self.add("unsafe_block", i, self.skip(i + 1))

    def _closure(self, i):
        return i == 0 or self.is_(i - 1, "(", ",", "=", "{", ";", "=>", "return", "move", ":", "[", "&&", "||", "else", "in", "}")

    def _add_closure(self, i):
        start = i
        while self.is_(start - 1, "move", "async"):
            start -= 1
        j = i + 1
        if self.is_(i, "|"):
            while j < len(self.t) and not self.is_(j, "|"):
                j = self.skip(j)
            j += 1
        if self.is_(j, "->"):
            j = self.skip(self.until(j, "{"))
        elif self.is_(j, "{"):
            j = self.skip(j)
        else:
            while j < len(self.t) and not self.is_(j, ",", ";", ")", "]", "}"):
                j = self.skip(j)
        self.add("closure_expression", start, j)

    def _visible(self, i):
        """(first token, visibility range, modifier range) of an item whose keyword is at i."""
        j = i
        while j > 0 and (self.is_(j - 1, "const", "async", "unsafe", "extern", "default", "auto") or self.t[j - 1].kind == "string" and self.is_(j - 2, "extern")):
            j -= 1
        modifiers = (j, i) if j < i else None
        seen = None
        if self.is_(j - 1, "pub"):
            seen = (j - 1, j)
            j -= 1
        elif self.is_(j - 1, ")") and self.is_(self.match.get(j - 1, 0) - 1, "pub"):
            seen = (self.match[j - 1] - 1, j)
            j = seen[0]
        return j, seen, modifiers

    def _item(self, i):
        word = self.t[i].text
        if word == "union" and not (self.ident(i + 1) and self.is_(i + 2, "{", "<")):
            return
        if word == "fn" and not self.ident(i + 1):
            return
        if word == "impl" and i > 0 and not (self.is_(i - 1, ";", "}", "{", "]", "unsafe", "default") or self.t[i - 1].kind == "comment"):
            return
        first, seen, modifiers = self._visible(i)
        j = i + 1
        while j < len(self.t) and not self.is_(j, "{", ";"):
            j = self.skip(j)
            if self.is_(j, ")", "}", "]"):
                return
        body = (j, self.skip(j)) if self.is_(j, "{") else None
        kind = ITEMS[word] if word != "fn" or body else "function_signature_item"
        marks = {"name": i + 1 if word != "impl" else None}
        n = self.add(kind, first, j + 1 if self.is_(j, ";") else self.skip(j), **marks)
        n.bare = first == i
        if seen:
            self.add("visibility_modifier", *seen)
        if modifiers and word == "fn":
            self.add("function_modifiers", *modifiers)
            for k in range(*modifiers):
                if self.is_(k, "extern"):
                    self.add("extern_modifier", k, k + 2 if self.t[k + 1].kind == "string" else k + 1)
        if body:
            self.add("declaration_list" if word in ("impl", "trait", "mod") else "block", *body)
        if word == "impl":
            k, stop = i + 1, j
            if self.is_(k, "<"):
                k = self.angle(k)
            while k < stop and not self.is_(k, "for", "where"):
                k = self.angle(k) if self.is_(k, "<") else self.skip(k)
            n.trait = self.is_(k, "for")
        if word == "enum" and body:
            a, end = body[0] + 1, body[1] - 1
            while a < end:
                while self.is_(a, "#"):
                    a = self.skip(a + 1)
                stop = min(self.until(a, ","), end)
                if a < stop:
                    self.add("enum_variant", a, stop, name=a)
                a = stop + 1


def parse(source: str) -> Node:
    return Parser(source).tree()


def _visible(kind: str, text: str) -> Query:
    return kinds(kind, where=lambda n, s: any(c.kind == "visibility_modifier" and re.sub(r"\s", "", c.text(s)) == text for c in n.children))


def _modified(word: str) -> Query:
    p = re.compile(word)
    return kinds("function_item", where=lambda n, s: any(c.kind == "function_modifiers" and p.search(c.text(s)) for c in n.children))


def _test(n: Node, s: str) -> bool:
    row = n.parent.children
    i = row.index(n) - 1
    while i >= 0 and row[i].kind == "attribute_item":
        if "test" in row[i].text(s):
            return True
        i -= 1
    return False


def _impl_fn(n: Node, s: str) -> bool:
    p = n.parent
    return p is not None and p.kind == "declaration_list" and p.parent.kind == "impl_item"


def _unsafe(n: Node, s: str) -> bool:
    if n.kind in ("trait_item", "impl_item"):
        return re.match(r"(?:pub(?:\([^)]*\))?\s+)?unsafe\b", n.text(s)) is not None
    return n.kind == "unsafe_block" or any(c.kind == "function_modifiers" and "unsafe" in c.text(s) for c in n.children)


QUERIES: dict[str, Query] = {
    "comments": kinds("line_comment", "block_comment", where=lambda n, s: not n.text(s).startswith("///")),
    "doc-comments": kinds("line_comment", where=lambda n, s: n.text(s).startswith(("///", "//!"))),
    "uses": kinds("use_argument"),
    "strings": kinds("string_content"),
    "attribute": kinds("attribute"),
    "enum-variant": kinds("enum_variant"),
    "impl-fn": kinds("function_item", where=_impl_fn),
    "const-fn": _modified("const"),
    "async-fn": _modified("async"),
    "unsafe-fn": _modified("unsafe"),
    "extern-fn": _modified("extern"),
    "test-fn": kinds("function_item", where=_test),
    "impl-type": kinds("impl_item", where=lambda n, s: not n.trait),
    "impl-trait": kinds("impl_item", where=lambda n, s: n.trait),
    "mod-tests": kinds("mod_item", where=lambda n, s: n.child("name").text(s) == "tests"),
    "type-def": kinds("struct_item", "enum_item", "union_item"),
    "identifier": kinds("identifier"),
    "type-identifier": kinds("type_identifier"),
    "closure": kinds("closure_expression"),
    "unsafe": kinds("trait_item", "impl_item", "function_item", "function_signature_item", "unsafe_block", where=_unsafe),
}
NAMED = {}
for _name in ("struct", "enum", "fn", "trait", "impl", "mod"):
    _kind = ITEMS[_name]
    QUERIES[_name] = kinds(_kind)
    if _name != "impl":
        NAMED[_name] = lambda p, k=_kind: named((k,), p)
    if _name in ("struct", "enum", "fn"):
        QUERIES[f"priv-{_name}"] = kinds(_kind, where=lambda n, s: n.bare)
        QUERIES[f"pub-{_name}"] = _visible(_kind, "pub")
        for _scope in ("crate", "self", "super"):
            QUERIES[f"pub-{_scope}-{_name}"] = _visible(_kind, f"pub({_scope})")
