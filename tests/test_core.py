"""Scoping: fragments, scopers, actions, ranges, templates, search and sources."""

import random

import pytest
from pyspark.sql import functions as F

from loupe.functions import dialect, escapes, ranges
from loupe.operators import actions as A
from loupe.operators import fragments as G
from loupe.operators import scopers as S
from loupe.operators import view as V
from loupe.operators.view import scoped
from loupe.plans.request import Request, UsageError
from loupe.sources import files

TEXTS = ["", "abc", "Hello World\nsecond Line", "a\r\nb\r\n", "\r", "ghp_oHn0As3cr3T", "über Straße ẞ", "x--y --> z", "aXbXc", None, "tail\n"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def run(spark, view, texts):
    df = frame(spark, texts)
    return [r.text for r in view(scoped(df)).to_text().orderBy("id").collect()]


# Ranges


@pytest.mark.parametrize(
    ("given", "merged"),
    [([], []), ([(0, 3), (3, 5), (7, 9)], [(0, 5), (7, 9)]), ([(4, 6), (0, 5)], [(0, 6)]), ([(0, 9), (2, 3)], [(0, 9)])],
)
def test_merge(spark, given, merged):
    assert ranges.merge(given) == merged
    rows = spark.createDataFrame([(given,)], f"r {ranges.RANGES}")
    assert [tuple(x) for x in rows.select(ranges.merge_column(F.col("r")).alias("r")).first().r] == merged


def test_subtract_against_sets(spark):
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([(x, x + rng.randrange(1, 6)) for x in (rng.randrange(30) for _ in range(rng.randrange(6)))] for _ in range(2))
        left = {i for x, y in a for i in range(x, y)} - {i for x, y in b for i in range(x, y)}
        assert {i for x, y in ranges.subtract(a, b) for i in range(x, y)} == left
    rows = spark.createDataFrame([([(0, 10), (20, 30)], [(2, 4), (8, 22), (25, 26)])], f"a {ranges.RANGES}, b {ranges.RANGES}")
    got = rows.select(ranges.subtract_column(F.col("a"), F.col("b")).alias("r")).first().r
    assert [tuple(x) for x in got] == [(0, 2), (4, 8), (22, 25), (26, 30)]


def test_shatter():
    assert ranges.shatter(2, 5) == [(2, 3), (3, 4), (4, 5)] and ranges.shatter(5, 2) == []
    with pytest.raises(ValueError, match="too long"):
        ranges.shatter(0, 70_000)


# Templates and escapes

CAPS = {"var1": "val1", "VAR_2": "val2", "2": "nval"}


@pytest.mark.parametrize(
    ("template", "want"),
    [
        ("", ""), ("plain", "plain"), ("costs $$5", "costs $5"), ("$var1", "val1"), (" $var1 ", " val1 "), ("$var1$VAR_2", "val1val2"),
        ("$2", "nval"), ("${2}", "nval"), ("3${2}3", "3nval3"), ("X${var1}X", "Xval1X"), ("${var1}}", "val1}"), ("$?", "$?"), ("${?", "${?"),
        ("$02", "nval"),
    ],
)
def test_template(template, want):
    assert escapes.inject(template, CAPS) == want


def test_template_errors():
    for bad, error in (("$NO", "UndefinedVariable"), ("$1337", "UndefinedVariable"), ("${var1", "MismatchedBraces"), ("${var1 x", "MismatchedBraces")):
        with pytest.raises(getattr(escapes, error)):
            escapes.inject(bad, CAPS)


def test_unescape():
    assert escapes.unescape(r"a\tb\n\\\x41\u{1F600}") == "a\tb\n\\A\U0001f600"
    for bad in (r"\q", "end\\", r"\u{D800}"):
        with pytest.raises(escapes.InvalidEscape):
            escapes.unescape(bad)


# Scopers


@pytest.mark.parametrize(
    "scoper",
    [
        S.Lines(), S.Literal("X"), S.Literal(r"\n"), S.Regex("[A-Z]\\w+"), S.Regex("(?P<a>[a-z])(?P<b>[a-z])"), S.Regex("o|(l)"),
        S.Regex("[[:alnum:]]+"), S.Regex(r"\w+"), S.Regex("."), S.Regex("l*"), S.Regex(r"(?<=a)b"), S.Regex(r"\p{Lowercase_Letter}+"), S.Regex("$"),
    ],
    ids=lambda s: getattr(getattr(s, "pattern", None), "source", type(s).__name__),
)
def test_native_and_python_agree(spark, scoper):
    view = scoped(frame(spark, TEXTS)).scope(scoper)
    rows = view.df.orderBy("id").collect()
    for r, text in zip(rows, TEXTS):
        got = None if text is None else [(f.text, f.in_scope, f.caps) for f in r[V.FRAGS]]
        assert got == (None if text is None else [f for f in scoper.scope(text) if f[0]])
        assert text is None or "".join(f[0] for f in got) == text


def test_dialect_routes():
    assert dialect.analyse(r"\w+").native and not dialect.analyse("a*").native
    assert dialect.analyse(r"\p{Emoji}").java is None
    with pytest.raises(dialect.InvalidPattern):
        dialect.analyse("(")


def test_scopes_narrow(spark):
    got = run(spark, lambda v: v.scope(S.Regex("[A-Z][a-z]+")).scope(S.Regex("^.")).replace("_"), TEXTS)
    assert got[2] == "_ello _orld\nsecond _ine"


def test_captures(spark):
    assert run(spark, lambda v: v.scope(S.Regex(r"(\w+) (\w+)")).replace("$2 $1"), ["Swap It"]) == ["It Swap"]
    assert run(spark, lambda v: v.scope(S.Literal("a")).replace("$1"), ["abc"]) == ["$1bc"]
    with pytest.raises(escapes.UndefinedVariable):
        scoped(frame(spark, ["a"])).scope(S.Regex("(?P<n>a)")).replace("$1")
    with pytest.raises(Exception, match="undefined variable"):
        run(spark, lambda v: v.scope(S.Regex("a|(b)")).replace("$1"), ["ab"])


def test_line_end_repair(spark):
    got = run(spark, lambda v: v.scope(S.Lines()).replace("[$0]"), ["a\r\nb", "a\nb"])
    assert got == ["[$0]\r\n[$0]", "[a]\n[b]"]
    view = scoped(frame(spark, ["a\r\nb\r"])).scope(S.Lines()).build()
    assert [(f.text, f.in_scope) for f in view.df.first()[V.FRAGS]] == [("a", True), ("\r", False), ("\n", False), ("b", True), ("\r", False)]


@pytest.mark.parametrize(
    ("text", "pattern", "want"),
    [("abab", "[ab]+", "abab"), ("aabb", "[ab]", "a"), ("a--b", "-", "a-b"), ("aa bb", "a|b", "a b"), ("", "a", "")],
)
def test_squeeze(spark, text, pattern, want):
    assert run(spark, lambda v: v.scope(S.Regex(pattern)).squeeze(), [text]) == [want]


# Actions


def test_actions_native_and_python_agree(spark):
    texts = [t for t in TEXTS if t] + ["https://a->b->c -> d", "<->", "=>=", ">=>", "---->", "a <= b != c", "h-- h->"]
    for action in (A.Upper(), A.Lower(), A.Deletion(), A.Symbols(), A.SymbolsInverse(), A.Normalization(), A.Titlecase(), A.German()):
        df = frame(spark, texts)
        view = scoped(df).scope(S.Regex("(?s).+")).act(action)
        rows = [G_ for G_ in view.df.orderBy("id").select(view.text().alias("t")).collect()]
        repaired = [V_.t for V_ in rows]
        for text, got in zip(texts, repaired):
            if "\r" not in text:
                assert got == action.act(text), action


def test_symbols():
    assert A.Symbols().act("https://x->y a->b <-- --- -- => != <= >=") == "https://x->y a→b ⟵ — – ⇒ ≠ ≤ ≥"
    assert A.SymbolsInverse().act(A.Symbols().act("a->b <-- --- -- => != <= >=")) == "a->b <-- --- -- => != <= >="


@pytest.mark.parametrize(
    ("given", "want"),
    [("a dog", "A Dog"), ("ein überfall", "Ein Überfall"), ("miXeD caSe", "miXeD caSe"), ("a dime a dozen", "A Dime a Dozen"), ("a dog's life", "A Dog's Life")],
)
def test_titlecase(given, want):
    assert A.Titlecase().act(given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Duebel", "Dübel"), ("Koeffizient", "Koeffizient"), ("AEPFEL!", "ÄPFEL!"), ("aepfel", "aepfel"), ("SCHLIESSEN", "SCHLIEẞEN"), ("Mauerduebel", "Mauerdübel")],
)
def test_german(given, want):
    assert A.German().act(given) == want
    assert A.German(prefer_original=True, naive=True).act(given) == given


def test_german_takes_a_dictionary():
    assert A.German(words=frozenset({"Bär"})).act("Baer Kuebel") == "Bär Kuebel"


def test_user_functions(spark):
    assert run(spark, lambda v: v.scope(S.Regex("[a-z]+")).act(lambda x: x[::-1]), ["abc DEF ghi"]) == ["cba DEF ihg"]
    assert run(spark, lambda v: v.scope(S.Function(lambda t: [(0, 1), (2, 3)])).upper(), ["abcd"]) == ["AbCd"]


# Search and requests


def test_search_rows(spark):
    rows = Request("ö", only_matching=True).search(frame(spark, ["aöbö\nnone\nö", "x", None]), "id").collect()
    assert [(r.id, r.line_no, r.line, [tuple(c) for c in r.cols]) for r in rows] == [(0, 1, "aöbö", [(1, 3), (4, 6)]), (0, 3, "ö", [(0, 2)])]
    assert V.format_hit("f", 1, "aöbö", [{"start": 1, "end": 3}, {"start": 4, "end": 6}]) == "f:1:1-3;4-6:aöbö"


def test_dry_run(spark):
    rows = Request("b", replacement="XY", dry_run=True).search(frame(spark, ["ab\nc\nb"]), "id").collect()
    assert [(r.pair, r.side, r.line_no, r.line) for r in rows] == [(0, "before", 1, "ab"), (0, "after", 1, "aXY"), (1, "before", 3, "b"), (1, "after", 3, "XY")]


def test_shortcut_gives_the_same(spark):
    texts = [t for t in TEXTS] + ["a.b", "$1 \\ x"]
    for request in (Request(upper=True), Request("[a-z]", delete=True), Request("b", replacement="$"), Request("X", literal=True, replacement="\\\\Y")):
        df = frame(spark, texts)
        full = request.act(request.view(df)).to_text()
        assert sorted(map(str, request.run(df).collect())) == sorted(map(str, full.collect()))


def test_failures(spark):
    df = frame(spark, ["abc", "def"])
    with pytest.raises(V.SomethingInScope):
        Request("a", fail_any=True, upper=True).run(df)
    with pytest.raises(V.NothingInScope):
        Request("x", fail_none=True, upper=True).run(df)
    with pytest.raises(V.NoFiles):
        Request("x", fail_no_files=True).run(df.limit(0))
    with pytest.raises(Exception, match="refusing"):
        scoped(df).scope(S.Regex("(?s).")).delete().changed().collect()
    for bad in ({"invert": True}, {"delete": True}, {"scope": "a", "delete": True, "squeeze": True}, {"literal": True}, {"scope": "a", "delete": True, "upper": True}):
        with pytest.raises(UsageError):
            Request(**bad)


def test_changed_rows_only(spark):
    rows = scoped(frame(spark, ["ab", "cd", None])).scope(S.Literal("a")).upper().changed().collect()
    assert [(r.id, r.text, r.old_text) for r in rows] == [(0, "Ab", "ab")]


def test_zip_shortest():
    assert V.zip_shortest([1, 2, 3], [4, 5]) == [(1, 4), (2, 5)] and V.zip_shortest() == []


# Sources


@pytest.mark.parametrize(
    ("first", "program"),
    [
        ("", None), ("#!", None), ("#!/", None), ("#!/b", "b"), ("#!/bin/bash\r\nx", "bash"), ("#!/usr/bin/env python3\n", "python3"),
        ("#!/usr/bin/env a b c", "a"), ("#!/usr/local/bin/env ruby -x\n", "ruby"), ("python", None), ("/x" * 500, None),
    ],
)
def test_interpreter(spark, first, program):
    assert files.interpreter(first) == program
    row = spark.createDataFrame([(first,)], "c string").select(files.interpreter_column(F.col("c")).alias("p")).first()
    assert row.p == program


def test_files(spark, tmp_path):
    for name, content in {
        "a.py": b"x = 1\n", "b.txt": b"x", "run": b"#!/usr/bin/env python3\n", "bad.py": b"\xff", ".hid.py": b"h", "skip/c.py": b"c", "d/e.py": b"e",
        ".git/HEAD": b"", ".gitignore": b"skip/\n*.log\n!keep.log\n", "x.log": b"l", "keep.log": b"k", "vendor/v.go": b"package v", "g.go": b"package g",
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    root = str(tmp_path)
    names = lambda **k: [r.path for r in files.read_files(spark, root, sort=True, **k).collect()]
    assert names(language="python") == ["a.py", "d/e.py", "run"]
    assert names(language="go") == ["g.go"]
    assert names(glob="*.py") == ["a.py", "d/e.py"]
    assert names(glob="*.log", gitignored=True) == ["keep.log", "x.log"] and names(glob="*.log") == ["keep.log"]
    assert ".hid.py" in names(language="python", hidden=True)
    out = scoped(files.read_files(spark, root, glob="a.py")).scope(S.Literal("x")).replace("y").changed()
    files.write_changed(out, root)
    assert (tmp_path / "a.py").read_text() == "y = 1\n"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    from loupe.streaming.run import rewrite_stream

    frame(spark, ["ab", "cd"]).write.parquet(str(tmp_path / "in"))
    got = rewrite_stream(spark, str(tmp_path / "in"), Request("a", replacement="$0$0"), ["id", "text"])
    assert sorted((r.id, r.text) for r in got.collect()) == [(0, "aab"), (1, "cd")]


def test_fragments_from_ranges():
    assert G.from_ranges("abcd", [(1, 2), (3, 4)]) == [("a", False, None), ("b", True, None), ("c", False, None), ("d", True, None)]
    with pytest.raises(IndexError):
        G.from_ranges("ab", [(1, 5)])


def test_german_dictionary_is_inflected():
    g = A.German()
    assert g.act("Ueber die groesseren Strassen fuehlten sich zwoelf Maedchen schoener") == "Über die größeren Straßen fühlten sich zwölf Mädchen schöner"
    same = "Die neue Steuer, dass man muss: Messer, Wasser, Klasse, Poesie, Israel, zuerst, Abenteuer, aktuell, Fluss"
    assert g.act(same) == same
    assert g.act("KAESE Tuerschloesser GROESSE") == "KÄSE Türschlösser GRÖẞE"


def executed(df):
    """The physical plan, without adaptive steps."""
    return df._jdf.queryExecution().sparkPlan().toString()


def test_texts_are_parsed_once(spark):
    from loupe import queries

    folder = "/root/testdata/sf0.001"
    for name in ("lang_python_comments", "lang_rust_fn", "custom_query_names", "intersect_scopes"):
        assert executed(queries.QUERIES[name](spark, folder)).count("ArrowEvalPython") == 1, name
    plan = executed(queries.QUERIES["regex_segments"](spark, folder))
    filters = [x for x in plan.splitlines() if "Filter " in x or "DataFilters" in x]
    assert filters and not any("regexp_extract_all" in x or "split(" in x for x in filters)


def test_small_files_are_dealt_out(spark, tmp_path):
    from loupe.sources.tables import spread

    path = str(tmp_path / "t")
    spark.range(100).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert sorted(r.id for r in spread(df.where("id > 5")).collect()) == list(range(6, 100))
    for other in (df.orderBy("id"), spark.range(3), df.groupBy("id").count()):
        assert spread(other) is other


def test_texts_with_line_breaks_are_dealt_out(spark):
    """A literal of several lines in a projection or a filter doesn't look like a node of the plan."""
    from pyspark.sql import functions as F

    from loupe import queries
    from loupe.sources.tables import spread

    folder, cores = "/root/testdata/sf0.001", spark.sparkContext.defaultParallelism
    for language in queries._SOURCES:
        df = queries.synthetic(spark, folder, language)
        assert df.rdd.getNumPartitions() == 1 and spread(df).rdd.getNumPartitions() == cores > 1, language
    for name in ("lang_c_comments", "custom_query_names", "join_scopes", "intersect_scopes", "lang_rust_fn_named"):
        assert "RoundRobinPartitioning" in executed(queries.QUERIES[name](spark, folder)), name
    df = queries.documents(spark, folder).where(~F.col("text").contains("\nSort a"))
    assert spread(df).rdd.getNumPartitions() == cores
    assert spread(df.orderBy("doc_id").select(F.lit("\nRelation"))).rdd.getNumPartitions() == 1


def test_a_cluster_needs_a_shared_folder():
    from loupe.sources.tables import shared_folder

    class Session:
        def __init__(self, **conf):
            self.conf = conf

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Session(**{"spark.master": "spark://host:7077"}))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_folder(Session(**{"spark.master": "local-cluster[3,2,1000]"}))
    assert shared_folder(Session(**{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
