import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(x.startswith('op') and x[2].isdigit() for x in q), 'pipeline' in q)"


def asked(at):
    env = os.environ | {"PYTHONPATH": str(at)}
    return subprocess.run([sys.executable, "-c", ASK], cwd=at, env=env, capture_output=True, text=True, timeout=120)


def test_the_rest_lives_without_the_optional_parts(tmp_path):
    """In processes of their own: without the corpus package, without the pipeline, without both."""
    for gone in (["pathloom/llm", "tests/llm"], ["corpus_pipeline.py"], ["pathloom/llm", "tests/llm", "corpus_pipeline.py"]):
        at = tmp_path / str(len(gone))
        shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"), dirs_exist_ok=True)
        for name in gone:
            shutil.rmtree(at / name) if (at / name).is_dir() else (at / name).unlink(missing_ok=True)
        got = asked(at)
        assert got.returncode == 0, got.stderr
        n, corpus, pipeline = got.stdout.split()
        assert int(n) > 40 and corpus == str((at / "pathloom/llm").exists()) and pipeline == "False"
        shutil.rmtree(at)


def test_errors_inside_the_optional_parts_are_not_hidden(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    pipeline = tmp_path / "r/corpus_pipeline.py"
    if pipeline.exists():
        pipeline.write_text("import no_such_module\n")
        assert "no_such_module" in asked(tmp_path / "r").stderr
