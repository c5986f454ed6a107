"""The entry module works with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("caseflow.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
names = set(e.queries())
assert names and set(e.oracle_sql()) <= names, "queries"
assert "pipeline" not in names and not any(n.startswith("op") and n[2:3].isdigit() for n in names)
print(len(names))
"""


def test_entry_without_the_add_on():
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 130


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_add_on():
    for path in (ROOT / "caseflow").rglob("*.py"):
        if "llm" not in path.parts:
            assert "caseflow.llm" not in path.read_text(), path


def test_materialised_tables_can_be_dropped(spark, tmp_path):
    import os

    from caseflow import session
    session._tables.clear()
    df = session.materialize(spark.range(5))
    (path,) = session._tables
    assert df.count() == 5 and os.path.exists(path.removeprefix("file:"))
    assert session.drop_tables(spark) == 1 and not os.path.exists(path.removeprefix("file:"))
