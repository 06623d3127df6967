"""Grammar queries on small sources of our own: every query's text is written out."""

import pytest

from loupe.grammar import registry
from loupe.grammar.query import InvalidQuery, compile_query


def found(language, query, source):
    return [source[a:b] for a, b in registry.ranges(language, query)(source)]


PYTHON = '''"""Mod."""
import os.path as p
from ..up import name

LIMIT: int = 3  # top


class Box(Base):
    """Doc."""

    @classmethod
    def make(cls, n: int = 1) -> "Box":
        return cls(n)

    @staticmethod
    def twice(x):
        with open(x) as f:
            y = f"a{x + 'q'}b"
        return lambda v: v + 1

    async def run(self):
        try:
            go()
        except E:
            pass
'''

GO = """package p
// note
import (
	"fmt"
	m "math"
)
type Shape interface { Area() float64 }
type Box[T any] struct {
	W int `json:"w"`
}
type Alias = Box
const A, B = 1, 2
var s = "str"
func (b *Box) Area() float64 { return 1 }
func init() { defer done(); go run() }
func free(x int) { f := func() {}; switch x { case 1: goto end }
end:
	f()
}
"""

RUST = """//! inner
/// outer
use std::{io, fmt};
#[derive(Debug)]
pub struct A { x: u8 }
pub(crate) enum E { One, Two(u8) }
struct P;
const fn c() {}
pub async fn go() { let f = |x| x + 1; }
unsafe fn u() {}
trait T { fn m(&self); }
impl T for A { fn m(&self) { unsafe { g() } } }
impl A { pub fn n() {} }
mod tests {
    #[test]
    fn works() { "text"; } // tail
}
"""

C = """#include <a.h>
#include "b.h"
// line
typedef struct { int x; } T;
enum color { RED };
union U { int i; };
int f(int a) {
    for (int i = 0; i < 3; i++) { g("s"); }
    while (a) a--;
    do { a++; } while (a < 3);
    if (a) return 1; else return 2;
    switch (a) { case 1: break; }
}
"""

CSHARP = """using System;
// note
namespace N {
    [Attr] class K {
        private int x = 1;
        public K() { }
        ~K() { }
        public int P { get; set; }
        void M() { var s = $"a{x}b"; string t = "q"; }
    }
    struct S { }
    interface I { }
    enum E { A }
}
"""

TYPESCRIPT = """import { a } from "mod";
// note
export enum E { A }
interface I { x: number }
type T = string;
namespace N { }
class C<T> { constructor(p: T) { } m(): void { try { f(`t${a}u`); } catch { } } }
async function g() { let x = 1; const y = 2; }
function h() { var z = 3; }
"""

HCL = """# note
variable "name" { default = "d" }
resource "aws_x" "web" { v = var.name }
data "src" "it" { k = data.src.it.id }
terraform {
  required_providers {
    aws = { version = 1 }
  }
}
output "o" { value = "a ${local.z} b" }
"""

CASES = [
    (PYTHON, "python", "comments", ["# top"]),
    (PYTHON, "python", "imports", ["os.path", "..up"]),
    (PYTHON, "python", "doc-strings", ["Mod.", "Doc."]),
    (PYTHON, "python", "strings", ["Mod.", "Doc.", "Box", "a", "q", "b"]),
    (PYTHON, "python", "function-names", ["make", "twice", "run"]),
    (PYTHON, "python", "function-calls", ["cls", "open", "go"]),
    (PYTHON, "python", "class-methods", ['def make(cls, n: int = 1) -> "Box":\n        return cls(n)']),
    (PYTHON, "python", "async-def", [PYTHON[PYTHON.index("async def") :].rstrip()]),
    (PYTHON, "python", "globals", ["LIMIT"]),
    (PYTHON, "python", "variable-identifiers", ["LIMIT", "y"]),
    (PYTHON, "python", "types", ["int", "int", '"Box"']),
    (PYTHON, "python", "lambda", ["lambda v: v + 1"]),
    (PYTHON, "python", "class", [PYTHON[PYTHON.index("class Box") :].rstrip()]),
    (GO, "go", "comments", ["// note"]),
    (GO, "go", "imports", ['"fmt"', '"math"']),
    (GO, "go", "strings", ['"str"']),
    (GO, "go", "struct-tags", ['`json:"w"`']),
    (GO, "go", "interface", ["type Shape interface { Area() float64 }"]),
    (GO, "go", "struct~^B", ['type Box[T any] struct {\n\tW int `json:"w"`\n}']),
    (GO, "go", "struct~^X", []),
    (GO, "go", "method", ["func (b *Box) Area() float64 { return 1 }"]),
    (GO, "go", "init-func", ["func init() { defer done(); go run() }"]),
    (GO, "go", "defer", ["defer done()"]),
    (GO, "go", "go", ["go run()"]),
    (GO, "go", "goto", ["goto end"]),
    (GO, "go", "type-params", ["T any"]),
    (GO, "go", "const", ["A, B = 1, 2"]),
    (GO, "go", "type-alias", ["Alias = Box"]),
    (RUST, "rust", "doc-comments", ["//! inner\n/// outer\n"]),
    (RUST, "rust", "comments", ["//! inner\n", "// tail"]),
    (RUST, "rust", "uses", ["std::{io, fmt}"]),
    (RUST, "rust", "attribute", ["derive(Debug)", "test"]),
    (RUST, "rust", "pub-struct", ["pub struct A { x: u8 }"]),
    (RUST, "rust", "priv-struct", ["struct P;"]),
    (RUST, "rust", "pub-crate-enum", ["pub(crate) enum E { One, Two(u8) }"]),
    (RUST, "rust", "enum-variant", ["One", "Two(u8)"]),
    (RUST, "rust", "const-fn", ["const fn c() {}"]),
    (RUST, "rust", "async-fn", ["pub async fn go() { let f = |x| x + 1; }"]),
    (RUST, "rust", "closure", ["|x| x + 1"]),
    (RUST, "rust", "impl-trait", ["impl T for A { fn m(&self) { unsafe { g() } } }"]),
    (RUST, "rust", "impl-type", ["impl A { pub fn n() {} }"]),
    (RUST, "rust", "unsafe", ["unsafe fn u() {}", "unsafe { g() }"]),
    (RUST, "rust", "test-fn", ['fn works() { "text"; }']),
    (RUST, "rust", "strings", ["text"]),
    (RUST, "rust", "fn~^w", ['fn works() { "text"; }']),
    (C, "c", "includes", ['#include <a.h>\n#include "b.h"\n']),
    (C, "c", "strings", ["<a.h>", '"b.h"', '"s"']),
    (C, "c", "type-def", ["typedef struct { int x; } T;"]),
    (C, "c", "enum", ["enum color { RED }"]),
    (C, "c", "for", ['for (int i = 0; i < 3; i++) { g("s"); }']),
    (C, "c", "while", ["while (a) a--;"]),
    (C, "c", "do", ["do { a++; } while (a < 3);"]),
    (C, "c", "if", ["if (a) return 1; else return 2;"]),
    (C, "c", "switch", ["switch (a) { case 1: break; }"]),
    (C, "c", "call-expression", ['g("s")']),
    (C, "c", "function-decl", ["f(int a)"]),
    (CSHARP, "csharp", "usings", ["System"]),
    (CSHARP, "csharp", "strings", ['$"a', 'b"', '"q"']),
    (CSHARP, "csharp", "field", ["private int x = 1;"]),
    (CSHARP, "csharp", "constructor", ["public K() { }"]),
    (CSHARP, "csharp", "destructor", ["~K() { }"]),
    (CSHARP, "csharp", "property", ["public int P { get; set; }"]),
    (CSHARP, "csharp", "attribute", ["Attr"]),
    (CSHARP, "csharp", "struct", ["struct S { }"]),
    (CSHARP, "csharp", "enum", ["enum E { A }"]),
    (TYPESCRIPT, "typescript", "imports", ["mod"]),
    (TYPESCRIPT, "typescript", "strings", ["mod", "t", "u"]),
    (TYPESCRIPT, "typescript", "export", ["export enum E { A }"]),
    (TYPESCRIPT, "typescript", "type-alias", ["type T = string;"]),
    (TYPESCRIPT, "typescript", "constructor", ["constructor(p: T) { }"]),
    (TYPESCRIPT, "typescript", "async-function", ["async function g() { let x = 1; const y = 2; }"]),
    (TYPESCRIPT, "typescript", "let", ["let x = 1;"]),
    (TYPESCRIPT, "typescript", "var", ["var z = 3;"]),
    (TYPESCRIPT, "typescript", "type-params", ["<T>"]),
    (HCL, "hcl", "variable", ['variable "name" { default = "d" }']),
    (HCL, "hcl", "variables", ["name", "name"]),
    (HCL, "hcl", "resource-types", ["aws_x", "local"][:1]),
    (HCL, "hcl", "resource-names", ["web"]),
    (HCL, "hcl", "data-names", ["it", "it"]),
    (HCL, "hcl", "data-sources", ["src", "src"]),
    (HCL, "hcl", "strings", ["d", "a", "b"]),
    (HCL, "hcl", "required-providers~aws", ["{ version = 1 }"]),
]


@pytest.mark.parametrize(("source", "language", "query", "want"), CASES, ids=[f"{c[1]}-{c[2]}" for c in CASES])
def test_query(source, language, query, want):
    assert found(language, query, source) == want


@pytest.mark.parametrize("language", registry.LANGUAGES)
def test_every_query_survives_any_text(language):
    sources = ["", "\n", "((({[", "}])", '"open', "/* open", "a b c", PYTHON, GO, RUST, C, CSHARP, TYPESCRIPT, HCL]
    for query in registry.language(language).QUERIES:
        for s in sources:
            for a, b in registry.ranges(language, query)(s):
                assert 0 <= a < b <= len(s)


def test_numbers_of_queries():
    counts = {x: len(registry.language(x).QUERIES) + len(getattr(registry.language(x), "NAMED", {})) for x in registry.LANGUAGES}
    assert counts == {"c": 19, "csharp": 15, "go": 25, "hcl": 17, "python": 19, "rust": 46, "typescript": 20}


def test_wrong_names_fail_early():
    for language, query in (("python", "nope"), ("nope", "comments"), ("python", "class~x"), ("rust", "fn~("), ("rust", "fn~(?=x)")):
        with pytest.raises(ValueError):
            registry.ranges(language, query)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("(comment) @c", ["# top"]),
        ("[(comment) (lambda)] @x", ["# top", "lambda v: v + 1"]),
        ("(function_definition name: (identifier) @n)", ["make", "twice", "run"]),
        ('(function_definition name: (identifier) @n (#match? @n "^t"))', ["twice"]),
        ('(function_definition name: (identifier) @n (#not-any-of? @n "make" "run"))', ["twice"]),
        ('(call function: (identifier) @f (#eq? @f "open"))', ["open"]),
        ("(decorated_definition (decorator)+ @d)", ["@classmethod", "@staticmethod"]),
        ("(decorated_definition (decorator) @_IGNORE definition: (function_definition) @f)", None),
    ],
)
def test_custom_query(query, want):
    got = [PYTHON[a:b] for a, b in compile_query("python", query)(PYTHON)]
    if want is None:
        assert len(got) == 2 and all(x.startswith("def ") for x in got)
    else:
        assert got == want


@pytest.mark.parametrize("query", ["", "(", "(a", '(a) @b (#eq? @b "c")', "(a (#nope? @b))", '(a) @x ) (', '((a) @b (#match? @b "("))'])
def test_invalid_custom_query(query):
    with pytest.raises(InvalidQuery):
        compile_query("python", query)


def test_go_expressions_are_outermost():
    source = """package p
var table = [2]map[string]int{{"a": 1}, nil}
func f(n [3]int, g func(int) error) (err error) {
	for i, v := range n[1:] { total += i * v }
	if x, ok := m[k].(string); ok && !done { return fmt.Errorf("%v", x), nil }
	switch y := z.(type) { case []byte: use(y) }
	q := &T{A: 1}
	go func() { inner(1) }()
	ch <- a +
		b
loop:
	break loop
}
"""
    assert found("go", "expression", source) == [
        '[2]map[string]int{{"a": 1}, nil}', "3", "i", "v", "n[1:]", "total", "i * v", "x", "ok", "m[k].(string)", "ok && !done",
        'fmt.Errorf("%v", x)', "nil", "y", "z", "use(y)", "q", "&T{A: 1}", "func() { inner(1) }()", "ch", "a +\n\t\tb",
    ]


def test_identifiers_by_place():
    rust = "use a::{B, c};\nstruct P<T> { x: T }\nenum E { V, W(u8) }\nfn f<F: Fn()>(g: &'static F) -> Self { P { x: 1 } }\nunion U { a: u8 }\n"
    assert found("rust", "type-identifier", rust) == ["P", "T", "T", "E", "F", "Fn", "F", "Self", "P", "U"]
    assert found("rust", "identifier", rust) == ["a", "B", "c", "V", "W", "f", "g", "static"]
    sharp = '[assembly: A]\npartial class C { async Task M<T>() where T : D { var q = from x in y where x.ok select x; F(z => z + 1); var s = $"{v:F3}"; await G(); } }'
    assert found("csharp", "identifier", sharp) == ["A", "C", "Task", "M", "T", "T", "D", "q", "x", "y", "x", "ok", "x", "F", "z", "s", "v", "G"]
