import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from echoloom import queries as core

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_entry(spark, small_dir):
    assert entry.entry(spark).count() > 0


#: Why a query has no SQL; each is held by tests against brute force, a library, a round trip or held-out labels.
NO_SQL = {
    "op1_toxicity": "a fitted model",
    "op2_pii": "keyed permutations",
    "op4_fingerprints": "random draws by hashes",
    "op5_search": "scores of whole texts against all rows are too slow in SQL",
    "op6_packing": "dynamic programming over the histogram",
    "op7_quality": "a fitted model",
    "op8_html_extraction": "parsing of broken markup",
    "op9_mixing": "keyed permutations and bisection",
    "op10_token_counts": "a tokenizer",
    "op12_importance_resampling": "crc32 of every run of words",
    "pipeline": "its stages have none",
}


def test_every_query_has_sql_or_a_reason():
    there, sql = set(entry.queries()), set(entry.oracle_sql())
    assert there - sql == there & set(NO_SQL) and sql <= there and set(core.oracle_sql()) == set(core.queries())


def _names(folder):
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"], cwd=folder, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ""})
    return [line.split() for line in run.stdout.splitlines()]


def test_without_the_corpus_operators(tmp_path):
    """In a copy whose llm folder is gone, with and without corpus_pipeline.py, the engine's own queries stay."""
    shutil.copytree(f"{ROOT}/echoloom", tmp_path / "echoloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    want = [sorted(core.queries()), sorted(core.oracle_sql())]
    assert _names(tmp_path) == want
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
        assert _names(tmp_path) == want


def test_with_a_broken_subpackage(tmp_path):
    """A third-party module that is missing takes only the corpus operators away."""
    shutil.copytree(f"{ROOT}/echoloom", tmp_path / "echoloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "echoloom" / "llm").mkdir()
    (tmp_path / "echoloom" / "llm" / "__init__.py").write_text("")
    (tmp_path / "echoloom" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    assert _names(tmp_path)[0] == sorted(core.queries())
