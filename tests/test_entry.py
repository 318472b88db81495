"""The driver's contract."""

import os
import subprocess
import sys

import pytest

from palimpsest.session import ROOT


def test_queries_have_their_sql():
    import __spark_entry__ as entry

    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 90 and all(callable(f) for f in known.values())


def test_entry(spark):
    import __spark_entry__ as entry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    df = entry.entry(spark)
    assert df.columns[0] == "modality" and df.count() > 0


def test_rest_imports_without_the_document_operators(tmp_path):
    """As in a checkout without the llm folders and corpus_pipeline.py."""
    for name in ("palimpsest", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(ROOT, name), tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "palimpsest/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
