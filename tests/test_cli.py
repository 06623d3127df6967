"""The command line: output, exit codes, errors."""

import io
import os
import subprocess
import sys

import pytest

from loupe import __main__ as cli
from loupe import completions
from loupe.sources import files

CODE = 'x = "one two"  # first\ny = "three"\n'


class Stdin:
    def __init__(self, data):
        self.buffer = io.BytesIO(data)

    def isatty(self):
        return False


@pytest.fixture
def run(spark, capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)

    def call(*args, stdin=None):
        detect = "force-unreadable" if stdin is None else "force-readable"
        monkeypatch.setattr(sys, "stdin", Stdin((stdin or "").encode()))
        capsys.readouterr()
        code = cli.main([f"--stdin-detection={detect}", *args])
        said = capsys.readouterr()
        return code, said.out, said.err

    return call


@pytest.mark.parametrize(
    ("args", "code", "out"),
    [
        (["W", "--", "B"], 0, "A; B B!"),
        ([r"\W", "--", "_"], 0, "A__W_B_"),
        (["-d", r"[;!]"], 0, "A W B"),
        (["--fail-any", "A"], 1, ""),
        (["--fail-any", "X"], 0, "A; W B!"),
        (["--fail-none", "X"], 1, ""),
        (["--fail-none", "A"], 0, "A; W B!"),
        (["--lower", "A|B"], 0, "a; W b!"),
        (["-L", ";", "--", ","], 0, "A, W B!"),
    ],
)
def test_text_to_text(run, args, code, out):
    assert run(*args, stdin="A; W B!")[:2] == (code, out)


@pytest.mark.parametrize(
    ("args", "code", "out"),
    [
        (["--python", "strings", "e"], 0, "(stdin):1:7-8:x = \"one two\"  # first\n(stdin):2:8-9;9-10:y = \"three\"\n"),
        (["--python", "comments"], 0, "(stdin):1:15-22:x = \"one two\"  # first\n"),
        (["--python", "strings", "z"], 1, ""),
        (["--fail-none", "--python", "strings", "z"], 1, ""),
        (["--fail-any", "--python", "strings", "e"], 1, ""),
        (["--fail-any", "--python", "strings", "z"], 1, ""),
        (["--python", "def"], 1, ""),
        (["--python", "strings", "--dry-run", "e", "--", "E"], 0, None),
    ],
)
def test_search_mode(run, args, code, out):
    got = run(*args, stdin=CODE)
    assert got[0] == code and (out is None or got[1] == out)
    if out is None:
        assert len(got[1].splitlines()) == 4 and '"onE two"' in got[1]


def test_search_mode_on_files(run, tmp_path):
    (tmp_path / "b.py").write_text(CODE)
    (tmp_path / "a.py").write_text("# hi\n")
    (tmp_path / "bad.py").write_bytes(b"# \xff\n")
    assert run("--sorted", "--python", "comments")[:2] == (0, "a.py:1:0-4:# hi\nb.py:1:15-22:x = \"one two\"  # first\n")
    assert run("--python", "comments", "unfindable")[:2] == (1, "")
    assert run("--fail-any", "--python", "comments")[:2] == (1, "")
    assert run("--fail-no-files", "--go", "comments")[:2] == (1, "") and run("--fail-no-files", "--glob", "*.xyz", "a")[0] == 1
    code, out, _ = run("--glob", "*.py", "hi", "--", "ho")
    assert (code, out) == (0, "a.py\n") and (tmp_path / "a.py").read_text() == "# ho\n"
    assert (tmp_path / "bad.py").read_bytes() == b"# \xff\n"


def test_unreadable_files(run, tmp_path, monkeypatch, spark):
    (tmp_path / "a.py").write_text("# hi\n")
    monkeypatch.setattr(files, "walk", lambda *a: iter(["a.py", "gone.py"]))
    assert run("--python", "comments")[:2] == (0, "a.py:1:0-4:# hi\n")  # a search goes on
    code, out, err = run("--glob", "*.py", "hi", "--", "ho")  # a rewrite doesn't begin
    assert (code, out) == (1, "") and "can't be read" in err and (tmp_path / "a.py").read_text() == "# hi\n"
    assert [r.path for r in files.read_files(spark, str(tmp_path)).collect()] == ["a.py"]
    with pytest.raises(Exception, match=r"can't read gone\.py"):
        files.read_files(spark, str(tmp_path), strict=True).collect()


def test_terminal_output_is_styled(run):
    code, out, _ = run("--stdout-detection=force-tty", "--python", "comments", stdin=CODE)
    assert code == 0 and "\x1b[35m(stdin)\x1b[0m:\x1b[32m1\x1b[0m:" in out and "# first" in out


def test_flags_from_the_environment(run, monkeypatch):
    for value, out in (("false", "abc"), ("0", "abc"), ("", "abc"), ("No", "abc"), ("off", "abc"), ("1", "ac"), ("true", "ac"), ("yes", "ac")):
        monkeypatch.setenv("DELETE", value)
        assert run("b", stdin="abc")[:2] == (0, out)


@pytest.mark.parametrize(
    "args", [["--python", "comments", "--go", "comments"], ["-d"], ["-s"], ["--invert"], ["-d", "-u", "x"], ["("], ["--python", "nonsense"], ["a", "--", "b", "c"]]
)
def test_wrong_usage(run, args):
    assert run(*args, stdin="a")[0] == 2


def test_completions(run):
    for shell in completions.SHELLS:
        code, out, _ = run("--completions", shell)
        name = "literal-string"
        assert code == 0 and name in out and "rust" in out and "loupe" in out


def test_reader_that_leaves(tmp_path):
    for i in range(40):
        (tmp_path / f"f{i}.py").write_text("# a comment\n" * 500)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    command = f"{sys.executable} -m loupe --stdin-detection=force-unreadable --python comments 2>err; echo $? >code"
    head = subprocess.run(
        ["bash", "-c", f"({command}) | head -n 1"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=200
    )
    assert head.stdout.startswith("f0.py:1:") and (tmp_path / "code").read_text() == "0\n"
    assert "Traceback" not in (tmp_path / "err").read_text()


def test_ignore_rules(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    for name, text in {
        "config/git/ignore": "*.global\n", "repo/.git/info/exclude": "*.excluded\n", "repo/.gitignore": "*.[ab]x\nkept.*\n[!a-z]*.up\n\\#odd\n",
        "repo/sub/.gitignore": "!kept.c\n", "repo/sub/.ignore": "only.*\n", "other/.gitignore": "*.txt\n", "other/.ignore": "*.log\n",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    for name in ("1.ax", "1.bx", "1.cx", "A.up", "a.up", "#odd", "x.global", "x.excluded", "kept.c", "sub/kept.c", "sub/kept.d", "sub/only.c", "sub/1.ax"):
        (tmp_path / "repo" / name).write_text("x")
    for name in ("a.txt", "a.log"):
        (tmp_path / "other" / name).write_text("x")
    assert sorted(files.walk(str(tmp_path / "repo"))) == ["1.cx", "a.up", "sub/kept.c"]
    assert sorted(files.walk(str(tmp_path / "repo" / "sub"))) == ["kept.c"]  # the folders above count
    assert "1.ax" in set(files.walk(str(tmp_path / "repo"), gitignored=True))
    assert sorted(files.walk(str(tmp_path / "other"))) == ["a.txt"]  # no repository, so git's rules don't hold


def test_far_roots_have_the_same_rules(spark, tmp_path):
    for name, text in {"a.py": "x = 1", ".hid.py": "h", "sub/.gitignore": "b.py\n", "sub/b.py": "b", "sub/c.py": "c", ".git/config.py": "g"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root = f"file://{tmp_path}"
    assert sorted(files.walk_far(root)) == ["a.py", "sub/c.py"]
    assert sorted(files.walk_far(root, gitignored=True)) == ["a.py", "sub/b.py", "sub/c.py"]
    assert sorted(files.walk_far(root, hidden=True)) == [".hid.py", "a.py", "sub/.gitignore", "sub/c.py"]
    got = {r.path: (bytes(r.content or b""), r.error is None) for r in files.read_paths(spark, root, ["a.py", ".hid.py", "gone.py"]).collect()}
    assert got == {"a.py": (b"x = 1", True), ".hid.py": (b"h", True), "gone.py": (b"", False)}
