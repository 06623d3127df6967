"""Small sources in which every prepared query finds something; Q9Z is a place for a row's number."""

PLACE = "Q9Z"

SAMPLES = {
    "c": r'''// note Q9Z
#include <stdio.h>
#include "own.h"
typedef unsigned long word;
enum color { RED, GREEN };
struct point { int x; };
union both { int i; };
int limit = 3;
int half(int a);
int fQ9Z(int a) {
    int b = half(a);
    if (b) { puts("hi"); } else { b = 1; }
    for (int i = 0; i < b; i++) { a += i; }
    while (a > 9) { a--; }
    do { a++; } while (a < 3);
    switch (a) { case 1: return 2; }
    return a;
}
''',
    "csharp": r'''// note Q9Z
using System.Text;
[Serializable]
struct PointQ9Z { public int X; }
enum Color { Red, Green }
interface IShape { int Area(); }
class CQ9Z
{
    private string name = "plain";
    public int Size { get; set; }
    public CQ9Z() { }
    ~CQ9Z() { }
    int Twice(int a)
    {
        var text = $"is {a} now";
        var path = @"c:\x";
        return 2 * a;
    }
}
''',
    "go": r'''package p

// note Q9Z
import "fmt"

type Alias = int
type PointQ9Z struct {
	X int `json:"x"`
}
type Shape interface{ Area() int }

const Max = 3

var size = 4

func init() {}

func (p PointQ9Z) Twice(a int) int { return 2 * a }

func Pick[T any](a T) T { return a }

func runQ9Z(c chan int) {
	defer close(c)
	go func() { c <- 1 }()
	select {
	case <-c:
	}
	switch size {
	case 1:
		goto end
	}
end:
	fmt.Println("done")
}
''',
    "hcl": r'''# note Q9Z
terraform {
  required_providers {
    aws = {
      source = "hashicorp/aws"
    }
  }
}
provider "aws" {
  region = var.region
}
variable "region" {
  default = "eu"
}
locals {
  size = 2
}
resource "aws_vm" "boxQ9Z" {
  ami = data.aws_ami.base.id
}
data "aws_ami" "base" {
}
module "net" {
  source = "./net"
}
output "ip" {
  value = aws_vm.boxQ9Z.ip
}
''',
    "python": r'''# note Q9Z
import os.path
from sys import argv
limit: int = 3


class C:
    """about"""

    def run(self):
        return 'x'

    @classmethod
    def make(cls):
        pass

    @staticmethod
    def fQ9Z(a):
        with open(a) as f:
            b = f
        try:
            pass
        except OSError:
            pass
        return lambda x: x


async def go():
    pass
''',
    "rust": r'''// note Q9Z
/// about
use std::fmt;
#[derive(Debug)]
struct Bare;
pub struct Open;
pub(crate) struct Ours;
pub(self) struct Own;
pub(super) struct Above;
enum E { A, B(u8) }
pub enum PubE { C }
pub(crate) enum OursE { D }
pub(self) enum OwnE { F }
pub(super) enum AboveE { G }
fn fQ9Z() { let s = "text"; }
pub fn open() {}
pub(crate) fn ours() {}
pub(self) fn own() {}
pub(super) fn above() {}
const fn fixed() {}
async fn later() {}
unsafe fn risky() {}
extern "C" fn outside() {}
trait Shape { fn area(&self); }
impl Bare { fn one(&self) { let c = |x| x + 1; } }
impl Shape for Bare { fn area(&self) { unsafe { risky() } } }
mod inner {}
mod tests {
    #[test]
    fn works() {}
}
''',
    "typescript": r'''// note Q9Z
import { a } from "mod";
function fQ9Z(x: number) { return x; }
async function later() { return 1; }
class C<T> {
  constructor(y: T) {}
  run() { return 'x'; }
}
enum Color { Red }
interface Shape { area(): number; }
type Name = string;
namespace N { let inside = 1; }
try { fQ9Z(1); } catch (e) { later(); }
let one = 1;
const two = 2;
var three = 3;
export { one };
''',
}

#: Queries that take a pattern for a name, one of each.
NAMED = {"go": ("struct~^Point", "interface~hap", "func~^run"), "hcl": ("required-providers~^a",), "rust": ("struct~^O", "enum~^E$", "fn~^f", "trait~Sh", "mod~^t")}

#: What each query finds in the sample of its language, drafted by running it and reviewed by reading; neighbouring ranges are one.
EXPECTED = {
    "c": {
        "comments": ['// note Q9Z'],
        "strings": ['<stdio.h>', '"own.h"', '"hi"'],
        "includes": ['#include <stdio.h>\n#include "own.h"\n'],
        "type-def": ['typedef unsigned long word;'],
        "enum": ['enum color { RED, GREEN }'],
        "struct": ['struct point { int x; }'],
        "variable": ['int limit = 3;', 'int half(int a);', 'int b = half(a);', 'int i = 0;'],
        "function": ['half(int a)', 'fQ9Z(int a)', 'half(a)', 'puts("hi")'],
        "function-def": ['int fQ9Z(int a) {\n    int b = half(a);\n    if (b) { puts("hi"); } else { b = 1; }\n    for (int i = 0; i < b; i++) { a += i; }\n    while (a > 9) { a--; }\n    do { a++; } while (a < 3);\n    switch (a) { case 1: return 2; }\n    return a;\n}'],
        "function-decl": ['half(int a)', 'fQ9Z(int a)'],
        "switch": ['switch (a) { case 1: return 2; }'],
        "if": ['if (b) { puts("hi"); } else { b = 1; }'],
        "for": ['for (int i = 0; i < b; i++) { a += i; }'],
        "while": ['while (a > 9) { a--; }'],
        "union": ['union both { int i; }'],
        "do": ['do { a++; } while (a < 3);'],
        "identifier": ['RED', 'GREEN', 'limit', 'half', 'a', 'fQ9Z', 'a', 'b', 'half', 'a', 'b', 'puts', 'b', 'i', 'i', 'b', 'i', 'a', 'i', 'a', 'a', 'a', 'a', 'a', 'a'],
        "declaration": ['int limit = 3;', 'int half(int a);', 'int b = half(a);', 'int i = 0;'],
        "call-expression": ['half(a)', 'puts("hi")'],
    },
    "csharp": {
        "comments": ['// note Q9Z'],
        "usings": ['System.Text'],
        "strings": ['"plain"', '$"is ', ' now"', '@"c:\\x"'],
        "struct": ['[Serializable]\nstruct PointQ9Z { public int X; }'],
        "enum": ['enum Color { Red, Green }'],
        "interface": ['interface IShape { int Area(); }'],
        "class": ['class CQ9Z\n{\n    private string name = "plain";\n    public int Size { get; set; }\n    public CQ9Z() { }\n    ~CQ9Z() { }\n    int Twice(int a)\n    {\n        var text = $"is {a} now";\n        var path = @"c:\\x";\n        return 2 * a;\n    }\n}'],
        "method": ['int Area();', 'int Twice(int a)\n    {\n        var text = $"is {a} now";\n        var path = @"c:\\x";\n        return 2 * a;\n    }'],
        "variable-declaration": ['int X', 'string name = "plain"', 'var text = $"is {a} now"', 'var path = @"c:\\x"'],
        "property": ['public int Size { get; set; }'],
        "constructor": ['public CQ9Z() { }'],
        "destructor": ['~CQ9Z() { }'],
        "field": ['public int X;', 'private string name = "plain";'],
        "attribute": ['Serializable'],
        "identifier": ['System', 'Text', 'Serializable', 'PointQ9Z', 'X', 'Color', 'Red', 'Green', 'IShape', 'Area', 'CQ9Z', 'name', 'Size', 'CQ9Z', 'CQ9Z', 'Twice', 'a', 'text', 'a', 'path', 'a'],
    },
    "go": {
        "comments": ['// note Q9Z'],
        "strings": ['"done"'],
        "imports": ['"fmt"'],
        "expression": ['3', '4', '2 * a', 'a', 'close(c)', 'func() { c <- 1 }()', '<-c', 'size', '1', 'fmt.Println("done")'],
        "type-def": ['type Alias = int', 'type PointQ9Z struct {\n\tX int `json:"x"`\n}', 'type Shape interface{ Area() int }'],
        "type-alias": ['Alias = int'],
        "struct": ['type PointQ9Z struct {\n\tX int `json:"x"`\n}'],
        "interface": ['type Shape interface{ Area() int }'],
        "const": ['Max = 3'],
        "var": ['size = 4'],
        "func": ['func init() {}', 'func (p PointQ9Z) Twice(a int) int { return 2 * a }', 'func Pick[T any](a T) T { return a }', 'func runQ9Z(c chan int) {\n\tdefer close(c)\n\tgo func() { c <- 1 }()\n\tselect {\n\tcase <-c:\n\t}\n\tswitch size {\n\tcase 1:\n\t\tgoto end\n\t}\nend:\n\tfmt.Println("done")\n}'],
        "method": ['func (p PointQ9Z) Twice(a int) int { return 2 * a }'],
        "free-func": ['func init() {}', 'func Pick[T any](a T) T { return a }', 'func runQ9Z(c chan int) {\n\tdefer close(c)\n\tgo func() { c <- 1 }()\n\tselect {\n\tcase <-c:\n\t}\n\tswitch size {\n\tcase 1:\n\t\tgoto end\n\t}\nend:\n\tfmt.Println("done")\n}'],
        "init-func": ['func init() {}'],
        "type-params": ['T any'],
        "defer": ['defer close(c)'],
        "select": ['select {\n\tcase <-c:\n\t}'],
        "go": ['go func() { c <- 1 }()'],
        "switch": ['switch size {\n\tcase 1:\n\t\tgoto end\n\t}'],
        "labeled": ['end:\n\tfmt.Println("done")'],
        "goto": ['goto end'],
        "struct-tags": ['`json:"x"`'],
        "struct~^Point": ['type PointQ9Z struct {\n\tX int `json:"x"`\n}'],
        "interface~hap": ['type Shape interface{ Area() int }'],
        "func~^run": ['func runQ9Z(c chan int) {\n\tdefer close(c)\n\tgo func() { c <- 1 }()\n\tselect {\n\tcase <-c:\n\t}\n\tswitch size {\n\tcase 1:\n\t\tgoto end\n\t}\nend:\n\tfmt.Println("done")\n}'],
    },
    "hcl": {
        "variable": ['variable "region" {\n  default = "eu"\n}'],
        "resource": ['resource "aws_vm" "boxQ9Z" {\n  ami = data.aws_ami.base.id\n}'],
        "data": ['data "aws_ami" "base" {\n}'],
        "output": ['output "ip" {\n  value = aws_vm.boxQ9Z.ip\n}'],
        "provider": ['provider "aws" {\n  region = var.region\n}'],
        "terraform": ['terraform {\n  required_providers {\n    aws = {\n      source = "hashicorp/aws"\n    }\n  }\n}'],
        "locals": ['locals {\n  size = 2\n}'],
        "module": ['module "net" {\n  source = "./net"\n}'],
        "required-providers": ['aws = {\n      source = "hashicorp/aws"\n    }'],
        "variables": ['region', 'region'],
        "resource-names": ['boxQ9Z', 'boxQ9Z'],
        "resource-types": ['aws_vm', 'aws_vm'],
        "data-names": ['base', 'base'],
        "data-sources": ['aws_ami', 'aws_ami'],
        "comments": ['# note Q9Z'],
        "strings": ['hashicorp/aws', 'eu', './net'],
        "required-providers~^a": ['{\n      source = "hashicorp/aws"\n    }'],
    },
    "python": {
        "comments": ['# note Q9Z'],
        "strings": ['about', 'x'],
        "imports": ['os.path', 'sys'],
        "doc-strings": ['about'],
        "function-names": ['run', 'make', 'fQ9Z', 'go'],
        "function-calls": ['open'],
        "class": ['class C:\n    """about"""\n\n    def run(self):\n        return \'x\'\n\n    @classmethod\n    def make(cls):\n        pass\n\n    @staticmethod\n    def fQ9Z(a):\n        with open(a) as f:\n            b = f\n        try:\n            pass\n        except OSError:\n            pass\n        return lambda x: x'],
        "def": ["def run(self):\n        return 'x'", 'def make(cls):\n        pass', 'def fQ9Z(a):\n        with open(a) as f:\n            b = f\n        try:\n            pass\n        except OSError:\n            pass\n        return lambda x: x', 'async def go():\n    pass'],
        "async-def": ['async def go():\n    pass'],
        "methods": ["def run(self):\n        return 'x'", '@classmethod\n    def make(cls):\n        pass', '@staticmethod\n    def fQ9Z(a):\n        with open(a) as f:\n            b = f\n        try:\n            pass\n        except OSError:\n            pass\n        return lambda x: x'],
        "class-methods": ['def make(cls):\n        pass'],
        "static-methods": ['def fQ9Z(a):\n        with open(a) as f:\n            b = f\n        try:\n            pass\n        except OSError:\n            pass\n        return lambda x: x'],
        "with": ['with open(a) as f:\n            b = f'],
        "try": ['try:\n            pass\n        except OSError:\n            pass'],
        "lambda": ['lambda x: x'],
        "globals": ['limit'],
        "variable-identifiers": ['limit', 'b'],
        "types": ['int'],
        "identifiers": ['os', 'path', 'sys', 'argv', 'limit', 'int', 'C', 'run', 'self', 'classmethod', 'make', 'cls', 'staticmethod', 'fQ9Z', 'a', 'open', 'a', 'f', 'b', 'f', 'OSError', 'x', 'x', 'go'],
    },
    "rust": {
        "comments": ['// note Q9Z'],
        "doc-comments": ['/// about\n'],
        "uses": ['std::fmt'],
        "strings": ['text', 'C'],
        "attribute": ['derive(Debug)', 'test'],
        "enum-variant": ['A', 'B(u8)', 'C', 'D', 'F', 'G'],
        "impl-fn": ['fn one(&self) { let c = |x| x + 1; }', 'fn area(&self) { unsafe { risky() } }'],
        "const-fn": ['const fn fixed() {}'],
        "async-fn": ['async fn later() {}'],
        "unsafe-fn": ['unsafe fn risky() {}'],
        "extern-fn": ['extern "C" fn outside() {}'],
        "test-fn": ['fn works() {}'],
        "impl-type": ['impl Bare { fn one(&self) { let c = |x| x + 1; } }'],
        "impl-trait": ['impl Shape for Bare { fn area(&self) { unsafe { risky() } } }'],
        "mod-tests": ['mod tests {\n    #[test]\n    fn works() {}\n}'],
        "type-def": ['struct Bare;', 'pub struct Open;', 'pub(crate) struct Ours;', 'pub(self) struct Own;', 'pub(super) struct Above;', 'enum E { A, B(u8) }', 'pub enum PubE { C }', 'pub(crate) enum OursE { D }', 'pub(self) enum OwnE { F }', 'pub(super) enum AboveE { G }'],
        "identifier": ['std', 'fmt', 'derive', 'Debug', 'A', 'B', 'C', 'D', 'F', 'G', 'fQ9Z', 's', 'open', 'ours', 'own', 'above', 'fixed', 'later', 'risky', 'outside', 'area', 'one', 'c', 'x', 'x', 'area', 'risky', 'inner', 'tests', 'test', 'works'],
        "type-identifier": ['Bare', 'Open', 'Ours', 'Own', 'Above', 'E', 'PubE', 'OursE', 'OwnE', 'AboveE', 'Shape', 'Bare', 'Shape', 'Bare'],
        "closure": ['|x| x + 1'],
        "unsafe": ['unsafe fn risky() {}', 'unsafe { risky() }'],
        "struct": ['struct Bare;', 'pub struct Open;', 'pub(crate) struct Ours;', 'pub(self) struct Own;', 'pub(super) struct Above;'],
        "priv-struct": ['struct Bare;'],
        "pub-struct": ['pub struct Open;'],
        "pub-crate-struct": ['pub(crate) struct Ours;'],
        "pub-self-struct": ['pub(self) struct Own;'],
        "pub-super-struct": ['pub(super) struct Above;'],
        "enum": ['enum E { A, B(u8) }', 'pub enum PubE { C }', 'pub(crate) enum OursE { D }', 'pub(self) enum OwnE { F }', 'pub(super) enum AboveE { G }'],
        "priv-enum": ['enum E { A, B(u8) }'],
        "pub-enum": ['pub enum PubE { C }'],
        "pub-crate-enum": ['pub(crate) enum OursE { D }'],
        "pub-self-enum": ['pub(self) enum OwnE { F }'],
        "pub-super-enum": ['pub(super) enum AboveE { G }'],
        "fn": ['fn fQ9Z() { let s = "text"; }', 'pub fn open() {}', 'pub(crate) fn ours() {}', 'pub(self) fn own() {}', 'pub(super) fn above() {}', 'const fn fixed() {}', 'async fn later() {}', 'unsafe fn risky() {}', 'extern "C" fn outside() {}', 'fn one(&self) { let c = |x| x + 1; }', 'fn area(&self) { unsafe { risky() } }', 'fn works() {}'],
        "priv-fn": ['fn fQ9Z() { let s = "text"; }', 'fn one(&self) { let c = |x| x + 1; }', 'fn area(&self) { unsafe { risky() } }', 'fn works() {}'],
        "pub-fn": ['pub fn open() {}'],
        "pub-crate-fn": ['pub(crate) fn ours() {}'],
        "pub-self-fn": ['pub(self) fn own() {}'],
        "pub-super-fn": ['pub(super) fn above() {}'],
        "trait": ['trait Shape { fn area(&self); }'],
        "impl": ['impl Bare { fn one(&self) { let c = |x| x + 1; } }', 'impl Shape for Bare { fn area(&self) { unsafe { risky() } } }'],
        "mod": ['mod inner {}', 'mod tests {\n    #[test]\n    fn works() {}\n}'],
        "struct~^O": ['pub struct Open;', 'pub(crate) struct Ours;', 'pub(self) struct Own;'],
        "enum~^E$": ['enum E { A, B(u8) }'],
        "fn~^f": ['fn fQ9Z() { let s = "text"; }', 'const fn fixed() {}'],
        "trait~Sh": ['trait Shape { fn area(&self); }'],
        "mod~^t": ['mod tests {\n    #[test]\n    fn works() {}\n}'],
    },
    "typescript": {
        "comments": ['// note Q9Z'],
        "imports": ['mod'],
        "strings": ['mod', 'x'],
        "function": ['function fQ9Z(x: number) { return x; }', 'async function later() { return 1; }'],
        "async-function": ['async function later() { return 1; }'],
        "sync-function": ['function fQ9Z(x: number) { return x; }'],
        "method": ['constructor(y: T) {}', "run() { return 'x'; }"],
        "constructor": ['constructor(y: T) {}'],
        "class": ["class C<T> {\n  constructor(y: T) {}\n  run() { return 'x'; }\n}"],
        "enum": ['enum Color { Red }'],
        "interface": ['interface Shape { area(): number; }'],
        "try-catch": ['try { fQ9Z(1); } catch (e) { later(); }'],
        "var-decl": ['inside = 1', 'one = 1', 'two = 2', 'three = 3'],
        "let": ['let inside = 1;', 'let one = 1;'],
        "const": ['const two = 2;'],
        "var": ['var three = 3;'],
        "type-params": ['<T>'],
        "type-alias": ['type Name = string;'],
        "namespace": ['namespace N { let inside = 1; }'],
        "export": ['export { one };'],
    },
}
