"""Queries of the scoping operators over the whole tables, and their SQL."""

from __future__ import annotations

import contextlib
import io
import os
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ranges as R
from .grammar import samples
from .operators import actions as A
from .operators import scopers as S
from .operators.view import NoFiles, NothingInScope, SomethingInScope, check_scope, format_column, scoped
from .plans.request import Request
from .sources import files
from .sources.tables import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# Scopers and fragments

_INTERLEAVED = """
WITH p AS (SELECT doc_id, string_split_regex(text, '[A-Z][a-z]+') o, regexp_extract_all(text, '[A-Z][a-z]+') m FROM documents),
f AS (SELECT doc_id, unnest(o) AS text, unnest(range(len(o))) * 2 AS k, false AS in_scope FROM p
UNION ALL SELECT doc_id, unnest(m), unnest(range(len(m))) * 2 + 1, true FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS seg_idx, text, in_scope FROM f WHERE text <> ''
"""


@query(_INTERLEAVED)
def regex_segments(spark, sf_dir):
    view = scoped(documents(spark, sf_dir)).scope(S.Regex("[A-Z][a-z]+", captures=False))
    return view.fragments("doc_id").drop("caps")


@query("SELECT count(*) AS n, count(*) AS same FROM documents")
def regex_reassembly(spark, sf_dir):
    view = scoped(documents(spark, sf_dir)).scope(S.Regex("[A-Z][a-z]+")).build()
    return view.df.select((view.text() == F.col("text")).alias("same")).agg(
        F.count("*").alias("n"), F.count_if(F.col("same")).alias("same")
    )


@query("""SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(text, '[A-Z][^.]*'), lambda x: len(regexp_extract_all(x, 'th[a-z]'))), 'sum')::BIGINT AS n
FROM documents WHERE len(regexp_extract_all(text, '[A-Z][^.]*')) > 0""")
def regex_multi_scope(spark, sf_dir):
    """Matches within matches."""
    view = scoped(documents(spark, sf_dir).where(F.col("text").rlike("[A-Z]")))
    view = view.scope(S.Regex("[A-Z][^.]*", False)).scope(S.Regex("th[a-z]", False)).build()
    return view.df.select("doc_id", F.size(F.filter(view.column(), lambda f: f["in_scope"])).cast("long").alias("n"))


@query("SELECT doc_id, replace(text, 'the', '') AS text FROM documents")
def literal_scope_delete(spark, sf_dir):
    return Request("the", literal=True, delete=True).run(documents(spark, sf_dir))


@query("SELECT doc_id, replace(text, ', ', ' | ') AS text FROM documents")
def literal_scope_replace(spark, sf_dir):
    return scoped(documents(spark, sf_dir)).scope(S.Literal(", ")).replace(" | ").to_text()


@query("SELECT doc_id, upper(text) AS text FROM documents")
def scope_upper(spark, sf_dir):
    return Request(upper=True).run(documents(spark, sf_dir))


@query("""SELECT doc_id, array_to_string(list_transform(range(len(string_split_regex(text, '[A-Z][a-z]+'))),
  lambda i: string_split_regex(text, '[A-Z][a-z]+')[i + 1] || coalesce(lower(regexp_extract_all(text, '[A-Z][a-z]+')[i + 1]), '')), '') AS text FROM documents""")
def scope_lower(spark, sf_dir):
    return Request("[A-Z][a-z]+", lower=True).run(documents(spark, sf_dir))


@query(r"SELECT o_orderkey, regexp_replace(o_orderpriority, '([0-9])-([A-Z]+)', '\2:\1', 'g') AS text FROM orders")
def replace_capture_vars(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("text"))
    return Request("([0-9])-([A-Z]+)", replacement="$2:$1").run(df)


@query(r"""SELECT event_id, regexp_replace(props, '"([a-z]+)": ?([0-9]+)', '\1=\2', 'g') AS text FROM events""")
def replace_named_vars(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"))
    return Request('"(?P<key>[a-z]+)": ?(?P<value>[0-9]+)', replacement="${key}=$value").run(df)


@query(r"SELECT doc_id, regexp_replace(text, '([#%*!])[#%*!]+', '\1', 'g') AS text FROM documents")
def squeeze_marks(spark, sf_dir):
    return Request("[#%*!]", squeeze=True).run(documents(spark, sf_dir))


@query(r"SELECT page_id, regexp_replace(html, '([lsn])[lsn]+', '\1', 'g') AS html FROM pages")
def squeeze_letters(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", "html")
    return Request("[lsn]", squeeze=True).run(df, column="html")


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def normalize_marks(spark, sf_dir):
    return Request(normalize=True).run(documents(spark, sf_dir))


@query(
    """SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)https://[^ "\\n]*[ "]?|---|-->|--|->|<--|<->|<-|<=|>=|!=|=>|[^h\\-<>!=]+|.'),
lambda t: CASE t WHEN '--' THEN '–' WHEN '---' THEN '—' WHEN '->' THEN '→' WHEN '<-' THEN '←' WHEN '-->' THEN '⟶' WHEN '<--' THEN '⟵' WHEN '<->' THEN '↔'
WHEN '=>' THEN '⇒' WHEN '!=' THEN '≠' WHEN '<=' THEN '≤' WHEN '>=' THEN '≥' ELSE t END), '') AS text FROM pages"""
)
def symbols_apply(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return scoped(df).scope(S.Lines()).symbols().to_text()


@query("""SELECT page_id, replace(replace(replace(replace(html, '–', '--'), '—', '---'), '→', '->'), '≠', '!=') AS text FROM pages""")
def symbols_invert(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return Request(symbols=True, invert=True).run(df)


@query("SELECT page_id, html AS text FROM pages")
def symbols_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    view = scoped(df).scope(S.Lines())
    return view.symbols().invert_symbols().to_text()


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS text FROM part")
def titlecase_names(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"))
    return Request(titlecase=True).run(df)


@query()
def german_restore(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = df.withColumn("text", F.replace(F.replace(F.replace("text", F.lit("ü"), F.lit("ue")), F.lit("ö"), F.lit("oe")), F.lit("ä"), F.lit("ae")))
    return Request(german=True).run(plain)


# Output

_LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
"""


@query(_LINES_SQL + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM l WHERE regexp_matches(line, 'Licensed|[0-9]+')")
def search_lines(spark, sf_dir):
    return Request("Licensed|[0-9]+", only_matching=True).search(documents(spark, sf_dir), "doc_id").drop("cols")


@query(_LINES_SQL + """, m AS (SELECT doc_id, line_no, line, string_split(line, 'ment') AS o FROM l WHERE contains(line, 'ment'))
SELECT doc_id, concat(CAST(doc_id AS VARCHAR), ':', CAST(line_no AS VARCHAR), ':', array_to_string(list_transform(range(1, len(o)), lambda i:
concat(CAST(strlen(array_to_string(o[1:i], 'ment')) AS VARCHAR), '-', CAST(strlen(array_to_string(o[1:i], 'ment')) + 4 AS VARCHAR))), ';'), ':', line) AS hit FROM m""")
def search_columns(spark, sf_dir):
    rows = Request("ment", literal=True, only_matching=True).search(documents(spark, sf_dir), "doc_id")
    row = F.struct("line_no", "line", "cols")
    return rows.select("doc_id", format_column(F.col("doc_id").cast("string"), row).alias("hit"))


@query(_LINES_SQL + """, m AS (SELECT doc_id, line, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pair FROM l WHERE contains(line, 'nn'))
SELECT doc_id, CAST(pair AS INTEGER) AS pair, 'before' AS side, CAST(line_no AS INTEGER) AS line_no, line FROM m
UNION ALL SELECT doc_id, CAST(pair AS INTEGER), 'after', CAST(line_no AS INTEGER), replace(line, 'nn', 'N') FROM m""")
def dry_run_pairs(spark, sf_dir):
    return Request("nn", literal=True, replacement="N", dry_run=True).search(documents(spark, sf_dir), "doc_id").drop("cols")


@query("""SELECT 'all' AS input, coalesce(bool_or(regexp_matches(text, '[0-9]{3}')), false) AS fail_any,
NOT coalesce(bool_or(regexp_matches(text, '[0-9]{3}')), false) AS fail_none, count(*) = 0 AS fail_no_files FROM documents
UNION ALL SELECT 'clean', false, true, count(*) = 0 FROM documents WHERE NOT regexp_matches(text, '[0-9]')
UNION ALL SELECT 'none', false, true, true""")
def fail_flags(spark, sf_dir):
    """Which flags would end a run over all documents, and over those without a digit."""

    def raised(df, kind, **flag):
        try:
            check_scope(scoped(df).scope(S.Regex("[0-9]{3}", False)), **flag)
        except kind:
            return True
        return False

    docs = documents(spark, sf_dir)
    clean, none = docs.where(~F.col("text").rlike("[0-9]")), docs.where(F.lit(False))
    rows = [
        (name, raised(df, SomethingInScope, fail_any=True), raised(df, NothingInScope, fail_none=True), raised(df, NoFiles, fail_empty=True))
        for name, df in (("all", docs), ("clean", clean), ("none", none))
    ]
    return spark.createDataFrame(rows, "input string, fail_any boolean, fail_none boolean, fail_no_files boolean")


@query("SELECT doc_id, replace(text, 'Licensed', 'LICENSED') AS text, text AS old_text FROM documents WHERE contains(text, 'Licensed')")
def changed_only(spark, sf_dir):
    return scoped(documents(spark, sf_dir)).scope(S.Literal("Licensed")).upper().changed()


@query("""SELECT 'everything' AS deleted, count(*) > 0 AS refused FROM documents WHERE len(text) > 0
UNION ALL SELECT 'letters', count(*) > 0 FROM documents WHERE len(text) > 0 AND regexp_full_match(text, '[a-z]+')""")
def wipe_guard(spark, sf_dir):
    """Whether a rewrite is refused because it would leave a text empty."""

    def refused(pattern):
        try:
            scoped(documents(spark, sf_dir)).scope(S.Regex(pattern, False)).delete().changed().agg(F.max(F.length("text"))).collect()
        except PySparkException as e:
            if "refusing to wipe" not in str(e):
                raise
            return True
        return False

    return spark.createDataFrame([("everything", refused("(?s).+")), ("letters", refused("[a-z]"))], "deleted string, refused boolean")


@query("SELECT doc_id, replace(upper(text), chr(10), chr(13) || chr(10)) AS text FROM documents")
def crlf_repair(spark, sf_dir):
    df = documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return scoped(df).scope(S.Lines()).upper().to_text()


# Ranges


def _intervals(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    start = F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int") % 10
    r = F.struct(start.cast("int").alias("start"), (start + F.col("l_quantity").cast("int") % 5).cast("int").alias("end"))
    return line.select("l_orderkey", r.alias("r"))


_INTERVALS = """WITH r AS (SELECT l_orderkey, l_linenumber * 7 + CAST(floor(l_quantity) AS INTEGER) % 10 AS a,
l_linenumber * 7 + CAST(floor(l_quantity) AS INTEGER) % 10 + CAST(floor(l_quantity) AS INTEGER) % 5 AS b FROM lineitem)
"""


@query(_INTERVALS + """, s AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT l_orderkey, CAST(min(a) AS INTEGER) AS start, CAST(max(b) AS INTEGER) AS "end" FROM g GROUP BY l_orderkey, g""")
def range_merge(spark, sf_dir):
    df = _intervals(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("r").alias("r"))
    return df.select("l_orderkey", F.explode(R.merge_column(F.col("r"))).alias("m")).select("l_orderkey", "m.*")


@query(_INTERVALS + """SELECT l_orderkey, a AS start, CASE WHEN b > 20 AND a < 20 THEN 20 ELSE b END AS "end" FROM r WHERE a < b AND a < 20
UNION ALL SELECT l_orderkey, CASE WHEN a < 30 THEN 30 ELSE a END, b FROM r WHERE b > 30 AND a < b""")
def range_subtract(spark, sf_dir):
    hole = F.array(F.struct(F.lit(20).alias("start"), F.lit(30).alias("end")))
    df = _intervals(spark, sf_dir).where("r.start < r.end")
    cut = R.subtract_column(F.array("r"), hole)
    return df.select("l_orderkey", F.explode(cut).alias("m")).select("l_orderkey", "m.*")


@query(_INTERVALS + """SELECT l_orderkey, CAST(x AS INTEGER) AS start, CAST(x + 1 AS INTEGER) AS "end" FROM (SELECT l_orderkey, unnest(range(a, b)) AS x FROM r)""")
def range_shatter(spark, sf_dir):
    df = _intervals(spark, sf_dir)
    return df.select("l_orderkey", F.explode(R.shatter_column(F.col("r.start"), F.col("r.end"))).alias("m")).select("l_orderkey", "m.*")


# Sources

_NAME = "regexp_extract(url, '([^/?#]*)([?#].*)?$', 1)"


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(de|fr)/[^?]*$')")
def path_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").where(F.col("url").rlike(r"/(de|fr)/[^?]*$"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'python' WHEN doc_id % 5 = 1 THEN 'go' WHEN doc_id % 5 = 2 THEN 'python' END AS language FROM documents""")
def language_filter(spark, sf_dir):
    """Files by extension, interpreter and veto: which language takes them."""
    n = F.col("doc_id")
    name = F.when(n % 5 == 0, F.lit("src/a.py")).when(n % 5 == 1, F.lit("cmd/a.go")).when(n % 5 == 2, F.lit("bin/run")).when(n % 5 == 3, F.lit("vendor/a.go"))
    df = documents(spark, sf_dir).select("doc_id", F.coalesce(name, F.lit("py/notes.txt")).alias("path"), F.concat(F.lit("#!/usr/bin/env python3\n"), "text").alias("text"))
    fits = [F.when(files.is_candidate(F.col("path"), F.col("text"), x), F.lit(x)) for x in files.EXTENSIONS]
    return df.select("doc_id", F.coalesce(*fits).alias("language"))


_FILES = """SELECT concat(CAST(doc_id % 3 AS VARCHAR), '/', CAST(doc_id AS VARCHAR), '.txt') AS path, replace(text, 'e', 'E') AS text
FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 < 2"""


def _tree(spark, sf_dir) -> str:
    """The documents as files: visible, hidden, in an ignored folder, of another extension; and bytes that are no text."""
    n = F.col("doc_id")
    name = F.concat(F.when(n % 4 == 1, F.lit(".")).otherwise(F.lit("")), n.cast("string"), F.when(n % 4 == 2, F.lit(".md")).otherwise(F.lit(".txt")))
    path = F.concat((n % 3).cast("string"), F.lit("/"), F.when(n % 4 == 3, F.lit("skip/")).otherwise(F.lit("")), name)
    root = f"{shared_folder(spark)}/loupe-files-{uuid.uuid4().hex}".removeprefix("file://")
    files.write_changed(documents(spark, sf_dir).select(path.alias("path"), "text"), root)
    for name, data in ((".ignore", b"skip/\n/2/\n"), ("binary.txt", b"\xff\xfe")):
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    return root


@query(_FILES)
def files_rewrite(spark, sf_dir):
    """Walk, filters, text check and rewriting in place of real files."""
    root = _tree(spark, sf_dir)
    changed = scoped(files.read_files(spark, root, glob="*.txt", strict=True)).scope(S.Literal("e")).upper().changed()
    files.write_changed(changed, root)
    return files.read_files(spark, root, glob="*.txt", sort=True)


@query(_FILES)
def command_line_rewrite(spark, sf_dir):
    """The same by the command line."""
    return _command_line(spark, sf_dir, "--glob", "*.txt", "--upper", "e")[0]


@query("""SELECT concat(CAST(doc_id % 3 AS VARCHAR), '/', CAST(doc_id AS VARCHAR), '.txt') AS path FROM documents
WHERE doc_id % 4 = 0 AND doc_id % 3 < 2 AND contains(text, 'e')""")
def command_line_changed(spark, sf_dir):
    """What the command line says it has changed."""
    said = _command_line(spark, sf_dir, "--sorted", "--glob", "*.txt", "--upper", "e")[1]
    return spark.createDataFrame([(x,) for x in said.splitlines()], "path string")


@query(_LINES_SQL + """SELECT concat(CAST(doc_id % 3 AS VARCHAR), '/', CAST(doc_id AS VARCHAR), '.txt:', CAST(line_no AS VARCHAR)) AS hit
FROM l WHERE doc_id % 4 = 0 AND doc_id % 3 < 2 AND contains(line, 'ment')""")
def command_line_search(spark, sf_dir):
    """Hits as the command line prints them, up to their columns."""
    said = _command_line(spark, sf_dir, "--glob", "*.txt", "--only-matching", "--line-numbers", "-L", "ment")[1]
    return spark.createDataFrame([(":".join(x.split(":", 2)[:2]),) for x in said.removesuffix("\n").split("\n")], "hit string")


def _command_line(spark, sf_dir, *args) -> tuple[DataFrame, str]:
    """The files after a run of the command line over them, and what it printed."""
    from .__main__ import main

    root, before, out = _tree(spark, sf_dir), os.getcwd(), io.StringIO()
    os.chdir(root)
    try:
        with contextlib.redirect_stdout(out):
            code = main(["--stdin-detection=force-unreadable", "--stdout-detection=force-pipe", *args])
    finally:
        os.chdir(before)
    if code:
        raise RuntimeError(f"exit code {code}")
    return files.read_files(spark, root, glob="*.txt", sort=True), out.getvalue()


@query("""WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(text, 'Licensed'), lambda x: reverse(x)), 'Licensed') AS text FROM documents)
SELECT doc_id, text FROM t""")
def function_action(spark, sf_dir):
    """A user's function over what a literal leaves out."""
    return scoped(documents(spark, sf_dir)).scope(S.Literal("Licensed")).invert().act(lambda s: s[::-1]).to_text()


@query("SELECT doc_id, array_to_string(string_split(text, chr(10)), ' / ') AS text FROM documents")
def unescape_literal(spark, sf_dir):
    return Request(r"\n", literal=True, replacement=" / ").run(documents(spark, sf_dir))


@query(r"SELECT doc_id, regexp_replace(text, '([0-9]+)', chr(27) || '[1;31m' || '\1' || chr(27) || '[0m', 'g') AS text FROM documents")
def style_digits(spark, sf_dir):
    return scoped(documents(spark, sf_dir)).scope(S.Regex("[0-9]+")).act(A.RED_BOLD.act).to_text()


@query(_INTERLEAVED.replace("false AS in_scope", "true AS in_scope").replace(" * 2 + 1, true FROM", " * 2 + 1, false FROM"))
def invert_scope(spark, sf_dir):
    view = scoped(documents(spark, sf_dir)).scope(S.Regex("[A-Z][a-z]+", captures=False)).invert()
    return view.fragments("doc_id").drop("caps")


@query("SELECT page_id, url FROM pages WHERE url LIKE 'https://%.org/en/%'")
def glob_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").where(
        F.col("url").rlike(files.glob_pattern("https://*.org/en/*"))
    )


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'python3' WHEN doc_id % 3 = 1 THEN source END AS program FROM documents""")
def shebang_filter(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    first = F.when(F.col("doc_id") % 3 == 0, F.lit("#!/usr/bin/env python3\n")).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("#!/usr/bin/env "), F.col("source"), F.lit(" -x\r\n"))
    ).otherwise(F.lit("# no program\n"))
    return df.select("doc_id", files.interpreter_column(F.concat(first, F.col("text"))).alias("program"))


@query("SELECT doc_id, upper(text) AS text FROM documents")
def stream_parity(spark, sf_dir):
    """The same request over a stream, in append mode, read back from its sink."""
    from .streaming.run import rewrite_stream

    return rewrite_stream(spark, f"{sf_dir}/documents.parquet", Request(upper=True), ["doc_id", "text"])


# Grammars: source text is made of columns, so that SQL can say what is in scope

#: Language: (text before the name, between name and type, behind), as parts of SQL and of Spark alike.
_SOURCES = {
    "python": ("# ", "\ndef f", "(a: int):\n    \"\"\"doc\"\"\"\n    return 'x'\n"),
    "c": ("// ", "\nint f", "(int a) { return g(a); }\n"),
    "go": ("package p\n// ", "\nfunc f", "(a int) int { return a }\n"),
    "rust": ("// ", "\nfn f", "(a: u8) -> u8 { a }\n"),
    "typescript": ("// ", "\nfunction f", "(a: number) { return a; }\n"),
    "csharp": ("// ", "\nclass C { int f", "(int a) { return a; } }\n"),
    "hcl": ("# ", "\nresource \"t\" \"n", "\" {\n  a = 1\n}\n"),
}


def synthetic(spark, sf_dir, language):
    """(p_partkey, text): one small source for each part, its brand in a comment and its key in a name."""
    a, b, c = _SOURCES[language]
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", F.concat(F.lit(a), "p_brand", F.lit(b), F.col("p_partkey").cast("string"), F.lit(c)).alias("text"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _in_scope(spark, sf_dir, language, scoper):
    view = scoped(synthetic(spark, sf_dir, language)).scope(scoper)
    return view.fragments("p_partkey").where("in_scope").select("p_partkey", "text")


def _comment_mark(language: str) -> str:
    return _SOURCES[language][0].rsplit("\n", 1)[-1]


#: (language, query): what of the source is in scope, as SQL.
_ITEMS = {
    **{(x, "comments"): f"{_sql(_comment_mark(x))} || p_brand" for x in _SOURCES},
    ("python", "strings"): None,
    ("python", "function-names"): "'f' || p_partkey",
    ("python", "types"): "'int'",
    ("python", "doc-strings"): "'doc'",
    ("c", "function-def"): "'int f' || p_partkey || '(int a) { return g(a); }'",
    ("c", "call-expression"): "'g(a)'",
    ("go", "free-func"): "'func f' || p_partkey || '(a int) int { return a }'",
    ("rust", "fn"): "'fn f' || p_partkey || '(a: u8) -> u8 { a }'",
    ("typescript", "function"): "'function f' || p_partkey || '(a: number) { return a; }'",
    ("csharp", "method"): "'int f' || p_partkey || '(int a) { return a; }'",
    ("hcl", "resource-names"): "'n' || p_partkey",
}


def _register() -> None:
    for (language, name), sql in _ITEMS.items():

        def run(spark, sf_dir, language=language, name=name):
            return _in_scope(spark, sf_dir, language, S.Language(language, name))

        run.__name__ = f"lang_{language}_{name.replace('-', '_')}"
        query(f"SELECT p_partkey, {sql} AS text FROM part" if sql else "SELECT p_partkey, unnest(['doc', 'x']) AS text FROM part")(run)


_register()


def _sample_sql(text: str) -> str:
    return _sql(text).replace(samples.PLACE, "' || n_nationkey || '").replace("\t", "' || chr(9) || '")


def _register_samples() -> None:
    """Every prepared query over a richer source of its language, one for each nation, with the nation's key in names."""
    for language, expected in samples.EXPECTED.items():
        for item, found in expected.items():
            name = f"lang_{language}_{item.partition('~')[0].replace('-', '_')}" + "_by_name" * ("~" in item)
            if name in QUERIES:
                name += "_sample"

            def run(spark, sf_dir, language=language, item=item):
                nation = table(spark, sf_dir, "nation")
                source = F.replace(F.lit(samples.SAMPLES[language]), F.lit(samples.PLACE), F.col("n_nationkey").cast("string"))
                view = scoped(nation.select("n_nationkey", source.alias("text"))).scope(S.Language(language, item))
                return view.fragments("n_nationkey").where("in_scope").select("n_nationkey", "text")

            run.__name__ = name
            query(f"SELECT n_nationkey, unnest([{', '.join(map(_sample_sql, found))}]) AS text FROM nation")(run)


_register_samples()


@query("SELECT p_partkey, 'fn f' || p_partkey || '(a: u8) -> u8 { a }' AS text FROM part WHERE CAST(p_partkey AS VARCHAR) LIKE '%7'")
def lang_rust_fn_named(spark, sf_dir):
    return _in_scope(spark, sf_dir, "rust", S.Language("rust", "fn~7$"))


@query("SELECT p_partkey, 'f' || p_partkey AS text FROM part WHERE CAST(p_partkey AS VARCHAR) LIKE '1%'")
def custom_query_names(spark, sf_dir):
    tree_query = '(function_definition name: (identifier) @name (#match? @name "^f1"))'
    return _in_scope(spark, sf_dir, "python", S.CustomQuery("python", tree_query))


@query("SELECT p_partkey, unnest(['# ' || p_brand, 'doc', 'x']) AS text FROM part")
def join_scopes(spark, sf_dir):
    union = S.Union([S.Language("python", "comments"), S.Language("python", "strings")])
    return _in_scope(spark, sf_dir, "python", union)


@query("SELECT p_partkey, 'f' || p_partkey AS text FROM part")
def intersect_scopes(spark, sf_dir):
    view = scoped(synthetic(spark, sf_dir, "python")).scope(S.Language("python", "def")).scope(S.Regex("f[0-9]+"))
    return view.fragments("p_partkey").where("in_scope").select("p_partkey", "text")
