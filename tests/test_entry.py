"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    ignore = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", "tests")
    shutil.copytree(ROOT, copy, ignore=ignore)
    code = (
        "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
        "assert 'regex_segments' in q and set(o) <= set(q); "
        "assert not any(k.startswith('op') for k in q) and 'pipeline' not in q; print(len(q))"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 40


def test_queries_read_whole_tables():
    """No query source samples or caps its table."""
    with open(os.path.join(ROOT, "loupe", "queries.py"), encoding="utf-8") as f:
        text = f.read()
    assert ".limit(" not in text and ".sample(" not in text


def test_german_restore_covers_all_documents(spark):
    from loupe import queries as scope_queries

    folder = "/root/testdata/sf0.001"
    got = scope_queries.QUERIES["german_restore"](spark, folder).select("doc_id")
    want = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id")
    assert sorted(got.collect()) == sorted(want.collect())
