import subprocess
import sys


def test_entry_runs(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() > 0 and out.columns == ["src", "dst", "depth", "ordinal"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_llm_folders(tmp_path):
    """A copy without them still imports and has the other queries."""
    import shutil
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "stratagraph", tmp_path / "stratagraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'blast_radius' in q and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=False)
    assert out.returncode == 0, out.stderr
