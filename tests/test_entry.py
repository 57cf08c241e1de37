import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LOOK = "import __spark_entry__ as e; q = e.queries(); assert 'r01_vec_topk_cosine' in q; assert set(e.oracle_sql()) <= set(q); print(sum(n.startswith('op') for n in q), 'pipeline' in q)"


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    for name in ("quillspark", "__spark_entry__.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0 and done.stdout.split() == ["0", "False"], done.stderr


def test_a_broken_operator_is_not_passed_over(tmp_path):
    shutil.copytree(ROOT / "quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "quillspark/llm").mkdir()
    (tmp_path / "quillspark/llm/__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode != 0 and "no_such_module" in done.stderr
