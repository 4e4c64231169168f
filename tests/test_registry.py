"""The registry without the corpus operators, in a copy of the repository."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
if "blocked" in sys.argv:
    sys.modules["public_tokenizers"] = None
from pyspark.sql import SparkSession
import __spark_entry__ as e
assert "q01_box_scale" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.queries()["q02_source_counters"](spark, sys.argv[2]).count() == 6
"""


def test_without_the_corpus_operators(tmp_path, smallest):
    for keep_pipeline in (True, False):
        copy = tmp_path / f"copy{keep_pipeline}"
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *[] if keep_pipeline else ["corpus_pipeline.py"]))
        assert not (copy / "transect" / "llm").exists()
        run = subprocess.run([sys.executable, "-c", PROGRAM, str(copy), smallest], cwd=copy, capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-2000:]


def test_what_a_deleted_folder_leaves_and_missing_libraries(tmp_path, smallest):
    for what in ("cache", "blocked"):
        copy = tmp_path / what
        left_out = (".git", "__pycache__", *(["llm"] if what == "cache" else []))
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*left_out))
        if what == "cache":
            (copy / "transect" / "llm" / "__pycache__").mkdir(parents=True)
        run = subprocess.run([sys.executable, "-c", PROGRAM, str(copy), smallest, what], cwd=copy, capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-2000:]
