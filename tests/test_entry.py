import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_subpackage(tmp_path):
    shutil.copy(os.path.join(TOP, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(TOP, "nearfold"), tmp_path / "nearfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_join_z' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_entry_where_a_library_of_the_corpus_subpackage_is_missing(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_join_z' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{TOP}"}, check=True)


def test_nothing_else_imports_the_corpus_subpackage():
    for folder, _, files in os.walk(os.path.join(TOP, "nearfold")):
        if "llm" not in folder.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "nearfold.llm" not in source.read()
