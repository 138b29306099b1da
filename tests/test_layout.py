"""The library stands without its training-data subpackage."""

import ast
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "skarn").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "skarn").parts:
            assert not [m for m in imported(path) if m.startswith("skarn.llm")], path


def test_codecs_do_not_import_spark():
    for path in (ROOT / "skarn" / "codecs").glob("*.py"):
        assert not [m for m in imported(path) if m.startswith("pyspark")], path


def test_entry_imports_without_the_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['skarn', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'keep_largest' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) == set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
