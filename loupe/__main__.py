"""Command line: python -m loupe [OPTIONS] [SCOPE] [-- REPLACEMENT]."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from . import completions
from .operators.actions import GREEN_BOLD, RED_BOLD
from .operators.view import NoFiles, NothingInScope, SomethingInScope, format_hit
from .plans.request import Request, UsageError
from .sources import files

log = logging.getLogger("loupe")

LANGUAGES = {"c": (), "csharp": ("cs",), "go": (), "hcl": (), "python": ("py",), "rust": ("rs",), "typescript": ("ts",)}


def flag(value: str | None) -> bool:
    """What a flag's environment variable says; anything but these words is true."""
    return (value or "false").lower() not in ("n", "no", "f", "false", "off", "0")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("loupe", description=__doc__)
    p.add_argument("scope", nargs="?")
    for short, name, text in (
        ("u", "upper", "upper case"), ("l", "lower", "lower case"), ("t", "titlecase", "headline case"),
        ("n", "normalize", "drop marks"), ("g", "german", "umlauts"), ("S", "symbols", "symbols for ASCII sequences"),
        ("d", "delete", "delete"), ("s", "squeeze", "keep the first of a run"), ("i", "invert", "invert --symbols"),
        ("L", "literal-string", "the scope is no pattern"), ("j", "join-language-scopes", "union of language scopes"),
        ("H", "hidden", "hidden files too"),
    ):
        names = [f"-{short}", f"--{name}"] + (["--squeeze-repeats"] if name == "squeeze" else [])
        p.add_argument(*names, action="store_true", help=text, default=flag(os.environ.get(name.upper().replace("-", "_"))))
    for name in ("dry-run", "fail-any", "fail-none", "line-numbers", "only-matching", "gitignored", "sorted", "german-prefer-original", "german-naive"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--fail-no-files", "--fail-empty-glob", action="store_true")
    p.add_argument("-G", "--glob", "--files")
    p.add_argument("--threads", type=int)
    p.add_argument("--stdin-detection", choices=("auto", "force-readable", "force-unreadable"), default="auto")
    p.add_argument("--stdout-detection", choices=("auto", "force-tty", "force-pipe"), default="auto")
    p.add_argument("--completions", choices=completions.SHELLS, help="print a completion script and exit")
    p.add_argument("-v", "--verbose", action="count", default=0)
    for name, other in LANGUAGES.items():
        flags = [name, *other]
        p.add_argument(*[f"--{f}" for f in flags], dest=f"{name}_prepared", action="append")
        p.add_argument(*[f"--{f}-query" for f in flags], dest=f"{name}_query", action="append")
        p.add_argument(*[f"--{f}-query-file" for f in flags], dest=f"{name}_query_file", action="append")
    return p


def request(args: argparse.Namespace, replacement: str | None) -> Request:
    used = [n for n in LANGUAGES if any(getattr(args, f"{n}_{k}") for k in ("prepared", "query", "query_file"))]
    if len(used) > 1:
        raise UsageError("only one language at a time")
    lang = used[0] if used else None
    get = lambda k: tuple(getattr(args, f"{lang}_{k}") or ()) if lang else ()
    return Request(
        args.scope, args.literal_string, replacement, args.upper, args.lower, args.titlecase, args.normalize, args.german,
        args.german_prefer_original, args.german_naive, args.symbols, args.invert, args.delete, args.squeeze, lang,
        get("prepared"), get("query"), get("query_file"), args.join_language_scopes, args.fail_any, args.fail_none,
        args.fail_no_files, args.dry_run, args.only_matching, args.line_numbers,
    )


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    argv = sys.argv[1:] if argv is None else argv
    replacement = None
    if "--" in argv:
        at = argv.index("--")
        argv, rest = argv[:at], argv[at + 1 :]
        if len(rest) > 1:
            print("one replacement only", file=sys.stderr)
            return 2
        replacement = rest[0] if rest else None
    args = parser().parse_args(argv)
    if args.completions:
        print(completions.script(parser(), args.completions))
        return 0
    logging.basicConfig(level=max(logging.DEBUG, logging.ERROR - 10 * args.verbose))
    try:
        ask = request(args, replacement)
        ask.language_scopers, ask.scopers, ask.actions  # all that can be wrong is so before anything is read
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    readable = args.stdin_detection == "force-readable" or args.stdin_detection == "auto" and not sys.stdin.isatty()
    tty = args.stdout_detection == "force-tty" or args.stdout_detection == "auto" and sys.stdout.isatty()
    spark = SparkSession.builder.master(f"local[{args.threads or '*'}]").config("spark.ui.enabled", False).getOrCreate()
    try:
        stdin = readable or not (args.glob or ask.language)
        if stdin:
            if args.glob:
                log.error("reading standard input; the files asked for are ignored")
            raw, df = None, files.read_stdin(spark, sys.stdin.buffer.read())
        else:
            root = os.getcwd()
            raw = files.read_raw(spark, root, args.glob, ask.language, args.hidden, args.gitignored).persist()
            df = files.texts_of(raw, None if args.glob else ask.language)
        lines = ask.search_mode or ask.only_matching or ask.line_numbers
        if raw is not None:
            failed = False
            for r in files.skipped(raw).orderBy("path").toLocalIterator():
                failed |= r.error is not None
                if r.error is None:
                    log.warning("not UTF-8, skipped: %s", r.path)
                else:
                    log.error("can't be read: %s: %s", r.path, r.error)
            if failed and not lines:
                print("nothing was changed, as files can't be read", file=sys.stderr)
                return 1
            log.info("Saw %d items", raw.count() if log.isEnabledFor(logging.INFO) else 0)
        if lines:
            rows = ask.search(df, "path", strict=True)
            order = ["path", "pair", "line_no"] if ask.dry_run else ["path", "line_no"]
            for r in rows.orderBy(*order).toLocalIterator():
                print(paint(r, ask) if tty else format_hit(r.path, r.line_no, r.line, r.cols))
            sys.stdout.flush()
        elif stdin:
            sys.stdout.write(ask.run(df).first().text)
        else:
            from pyspark.sql import functions as F

            ask.check(df)
            changed = ask.act(ask.view(df)).changed().select("path", F.col("text")).persist()
            files.write_changed(changed, root)
            for r in changed.select("path").orderBy("path").toLocalIterator():
                print(r.path)
    except BrokenPipeError:  # the reader has seen enough
        os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
    except (NothingInScope, SomethingInScope, NoFiles, UnicodeDecodeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def paint(row, ask: Request) -> str:
    style = GREEN_BOLD if ask.dry_run and row.side == "after" else RED_BOLD
    raw, out, at = row.line.encode(), "", 0
    for c in row.cols:
        out += raw[at : c.start].decode() + style.act(raw[c.start : c.end].decode())
        at = c.end
    return f"\x1b[35m{row.path}\x1b[0m:\x1b[32m{row.line_no}\x1b[0m:{out}{raw[at:].decode()}"


if __name__ == "__main__":
    sys.exit(main())
