"""Files as rows (path, content): walking, ignore rules, globs, extensions and interpreters."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STDIN = "(stdin)"

#: Extensions and interpreters by language.
EXTENSIONS = {
    "c": ("c", "h"), "csharp": ("cs",), "go": ("go",), "hcl": ("hcl", "tf"), "python": ("py",), "rust": ("rs",),
    "typescript": ("ts", "tsx"),
}
INTERPRETERS = {"python": ("python", "python3")}
VETOES = {"go": r"(^|/)vendor(/|$)"}
SHEBANG_BYTES = 128


@lru_cache(maxsize=256)
def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob, in which stars also cross directories."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            if glob[i - 1 : i + 1] == "**" and glob.startswith("/", i + 1):
                out.append("(.*/)?")
                i += 1
            else:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end]
            negated = inside.startswith("!")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]&~^])", r"\\\1", inside[negated:]) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def interpreter(first: bytes | str) -> str | None:
    """The program that the first line names, of its first 128 bytes only."""
    raw = (first.encode() if isinstance(first, str) else first)[:SHEBANG_BYTES]
    if raw[:2] != b"#!":
        return None
    name, spaces = b"", 0
    for c in raw[2:]:
        if c in b"\r\n" or c == 32 and spaces:
            break
        if c in b"/ ":
            spaces += c == 32
            name = b""
        else:
            name += bytes([c])
    return name.decode(errors="replace") or None


def interpreter_column(content: Column) -> Column:
    """interpreter() of a text column without leaving the JVM."""
    head = F.substring(content, 1, SHEBANG_BYTES)
    line = F.regexp_extract(head, r"^#!([^\r\n]*)", 1)
    upto = F.regexp_extract(line, r"^([^ ]* ?[^ ]*)", 1)
    name = F.regexp_extract(upto, r"([^/ ]*)$", 1)
    return F.when(name != "", name)


def is_candidate(path: Column, content: Column, language: str) -> Column:
    """Whether a file is of the language: by extension, or without one by its interpreter."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    fits = extension.isin(*EXTENSIONS[language])
    if language in INTERPRETERS:
        shebang = F.coalesce(interpreter_column(content).isin(*INTERPRETERS[language]), F.lit(False))
        fits = F.when(extension == "", shebang).otherwise(fits)
    return fits & ~path.rlike(VETOES[language]) if language in VETOES else fits


class Ignore:
    """The rules of one ignore file, relative to its directory."""

    def __init__(self, text: str):
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].removeprefix("\\")
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            body = ""
            i = 0
            line = line.removeprefix("/")
            while i < len(line):
                end = line.find("]", i + 2 + (line[i + 1 : i + 2] in ("!", "^"))) if line[i] == "[" else -1
                if end > 0:
                    inside = line[i + 1 : end]
                    negated = inside[0] in "!^"
                    inside = re.sub(r"([\\\[&~|])", r"\\\1", inside[negated:])
                    body, i = body + f"(?!/)[{'^' * negated}{inside}]", end + 1
                elif line[i] == "\\" and i + 1 < len(line):
                    body, i = body + re.escape(line[i + 1]), i + 2
                elif line.startswith("**/", i):
                    body, i = body + "(?:.*/)?", i + 3
                elif line.startswith("/**", i) and i + 3 == len(line):
                    body, i = body + "/.*", i + 3
                elif line[i] == "*":
                    body, i = body + "[^/]*", i + 1
                elif line[i] == "?":
                    body, i = body + "[^/]", i + 1
                else:
                    body, i = body + re.escape(line[i]), i + 1
            self.rules.append((keep, folder, re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z")))

    def verdict(self, path: str, folder: bool) -> bool | None:
        """True: ignored, False: kept by a negated rule, None: no rule says."""
        for keep, only_folder, pattern in reversed(self.rules):
            if (folder or not only_folder) and pattern.match(path):
                return not keep
        return None


def _rules(path: str) -> Ignore | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return Ignore(f.read())
    except OSError:
        return None


def _above(root: str, gitignored: bool) -> tuple[list[tuple[str, Ignore]], bool]:
    """Rules from outside the root, the weakest first, each with its folder; and whether git's rules apply."""
    folder, up = os.path.abspath(root), []
    while True:
        up.append(folder)
        parent = os.path.dirname(folder)
        if parent == folder:
            break
        folder = parent
    top = next((i for i, f in enumerate(up) if os.path.exists(os.path.join(f, ".git"))), None)
    git = top is not None and not gitignored
    found: list[tuple[str, Ignore | None]] = []
    if git:
        config = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
        found.append((up[top], _rules(os.path.join(config, "git", "ignore"))))
        found.append((up[top], _rules(os.path.join(up[top], ".git", "info", "exclude"))))
    for i in range(len(up) - 1, 0, -1):
        if git and i <= top:
            found.append((up[i], _rules(os.path.join(up[i], ".gitignore"))))
        found.append((up[i], _rules(os.path.join(up[i], ".ignore"))))
    return [(f, r) for f, r in found if r is not None], git


def _ignored(path: str, folder: bool, rules: list[tuple[str, Ignore]]) -> bool:
    """Whether the last rule that says anything ignores the path; both are below the rules' folders."""
    for base, rule in reversed(rules):
        said = rule.verdict(os.path.relpath(path, base) if base else path, folder)
        if said is not None:
            return said
    return False


def walk(root: str, hidden: bool = False, gitignored: bool = False) -> Iterator[str]:
    """Paths of files under root, relative to it.

    Rules come from .ignore files, and within a repository from .gitignore files, the repository's
    exclude file and the user's; files in folders above the root count, those further down win.
    """
    root = os.path.abspath(root)
    outside, git = _above(root, gitignored)

    def visit(folder: str, above: list[tuple[str, Ignore]]) -> Iterator[str]:
        here = os.path.join(root, folder) if folder else root
        own = [_rules(os.path.join(here, name)) for name in ((".gitignore",) if git else ()) + (".ignore",)]
        rules = [*above, *((here, r) for r in own if r is not None)]
        for entry in os.scandir(here):
            if entry.name.startswith(".") and not hidden:
                continue
            is_folder = entry.is_dir(follow_symlinks=False)
            if entry.name == ".git" or _ignored(os.path.join(here, entry.name), is_folder, rules):
                continue
            path = os.path.join(folder, entry.name) if folder else entry.name
            if is_folder:
                yield from visit(path, rules)
            elif entry.is_file():
                yield path

    yield from visit("", outside)


RAW = "path string, content binary, error string"


def read_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, content, error) of files under a folder that all executors see, or a URI that pyarrow knows."""

    def read(batches):
        store, base = _store(root)
        for b in batches:
            for p in b.column(0).to_pylist():
                content = error = None
                try:
                    if store is None:
                        with open(os.path.join(base, p), "rb") as f:
                            content = f.read()
                    else:
                        with store.open_input_stream(f"{base}/{p}") as f:
                            content = f.read()
                except OSError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["path", "content", "error"]
                )

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    wide = spark.sparkContext.defaultParallelism * 4
    return listed.repartition(max(1, min(len(paths), wide))).mapInArrow(read, RAW)


def _store(root: str):
    """(file system, path) of a URI; a local folder has no file system."""
    if "://" not in root:
        return None, root
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    return store, base.rstrip("/")


def walk_far(root: str, hidden: bool = False, gitignored: bool = False) -> list[str]:
    """walk() of a URI: one listing, and the ignore files found in it.  There is no repository to ask, so .gitignore always counts."""
    from pyarrow import fs

    store, base = _store(root)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    paths = [f.path[len(base) :].lstrip("/") for f in found if f.type == fs.FileType.File]
    rules: list[tuple[str, Ignore]] = []
    for p in paths:
        folder, name = os.path.split(p)
        if name == ".ignore" or name == ".gitignore" and not gitignored:
            with store.open_input_stream(f"{base}/{p}") as f:
                rules.append((folder, Ignore(f.read().decode("utf-8", "replace"))))
    rules.sort(key=lambda x: (x[0].count("/") + bool(x[0]), x[0]))

    def passes(path: str) -> bool:
        parts = path.split("/")
        if ".git" in parts or not hidden and any(p.startswith(".") for p in parts):
            return False
        for i in range(1, len(parts) + 1):
            at = "/".join(parts[:i])
            if _ignored(at, i < len(parts), [(f, r) for f, r in rules if not f or at.startswith(f + "/")]):
                return False
        return True

    return [p for p in paths if passes(p)]


def read_raw(
    spark: SparkSession, root: str, glob: str | None = None, language: str | None = None, hidden: bool = False, gitignored: bool = False
) -> DataFrame:
    """(path, content, error) of the files under root whose paths pass all filters.

    A glob overrides the language's rule.  Paths are filtered before anything is opened.
    """
    root = root.removeprefix("file://")
    paths = walk_far(root, hidden, gitignored) if "://" in root else list(walk(root, hidden, gitignored))
    if glob is not None:
        paths = [p for p in paths if re.match(glob_pattern(glob), p)]
    elif language:
        by_interpreter = language in INTERPRETERS
        fits = tuple("." + e for e in EXTENSIONS[language])
        veto = re.compile(VETOES.get(language, r"(?!)"))
        paths = [
            p for p in paths
            if not veto.search(p) and (p.endswith(fits) or by_interpreter and "." not in os.path.basename(p).lstrip("."))
        ]
    return read_paths(spark, root, paths)


def texts_of(raw: DataFrame, language: str | None = None) -> DataFrame:
    """(path, text) of what could be read and is UTF-8, and of the language, if one is given."""
    texts = raw.where(F.is_valid_utf8(F.col("content"))).select("path", F.col("content").cast("string").alias("text"))
    return texts.where(is_candidate(F.col("path"), F.col("text"), language)) if language else texts


def skipped(raw: DataFrame) -> DataFrame:
    """(path, error): what texts_of() leaves out, with a null error where it isn't UTF-8."""
    return raw.where("error is not null").select("path", "error").unionByName(
        raw.where(~F.is_valid_utf8(F.col("content"))).select("path", F.lit(None).cast("string").alias("error"))
    )


def read_files(
    spark: SparkSession, root: str, glob: str | None = None, language: str | None = None, hidden: bool = False,
    gitignored: bool = False, sort: bool = False, strict: bool = False,
) -> DataFrame:
    """(path, text) of the files under root that pass all filters; those that aren't UTF-8 are left out.

    Files that can't be read are left out, too, or with `strict` fail the query, as a rewrite should.
    """
    raw = read_raw(spark, root, glob, language, hidden, gitignored)
    if strict:
        failed = F.raise_error(F.concat(F.lit("can't read "), "path", F.lit(": "), "error"))
        raw = raw.withColumn("content", F.when(F.col("error").isNotNull(), failed.cast("binary")).otherwise(F.col("content")))
    texts = texts_of(raw, language if glob is None else None)
    return texts.orderBy("path") if sort else texts


def read_stdin(spark: SparkSession, data: bytes) -> DataFrame:
    """One row of the whole standard input, which must be UTF-8."""
    return spark.createDataFrame([(STDIN, data.decode("utf-8"))], "path string, text string")


def write_changed(changed: DataFrame, folder: str) -> None:
    """Write changed files (path, text) under a folder, each by renaming a finished file."""

    def write(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                full = os.path.join(folder, path)
                os.makedirs(os.path.dirname(full) or ".", exist_ok=True)
                part = f"{full}.{os.getpid()}.part"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
                os.replace(part, full)
            yield b.select(["path"])

    changed.select("path", "text").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
