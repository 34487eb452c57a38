import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_operators(tmp_path):
    """The queries are there, and none of the corpus operators, once their folders are deleted; with or without the pipeline's file."""
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cmp_06_alerts' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
