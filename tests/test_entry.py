"""The entry module without the optional subpackage, or without what that needs."""

import ast
import subprocess
import sys
from pathlib import Path

import pytest

import duskwatch
from duskwatch.plans import registry

ROOT = Path(__file__).resolve().parent.parent

HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {root!r})
import __spark_entry__
print(len(__spark_entry__.queries()), len(__spark_entry__.oracle_sql()))
"""


@pytest.mark.parametrize("name", ["duskwatch.llm", "regex", "xxhash", "public_tokenizers"])
def test_core_queries_stay(name):
    run = subprocess.run([sys.executable, "-c", HIDE.format(name=name, root=str(ROOT))], capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE))], run.stderr
    assert ("no queries of" in run.stderr) == (name != "duskwatch.llm")


def test_no_name_is_defined_twice():
    """A second definition of a module's helper replaces the first for the queries above it too."""
    for path in sorted(Path(duskwatch.__file__).parent.rglob("*.py")):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), f"{path}: {sorted(n for n in set(names) if names.count(n) > 1)}"
