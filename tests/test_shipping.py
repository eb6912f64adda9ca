"""Queries run from any folder: the package goes to the workers with the session."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("rows", entry.queries()["dm_table"](spark, sys.argv[2]).count())
"""


def test_a_query_with_python_functions_runs_from_another_folder(sf_dir, tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), sf_dir], cwd=tmp_path, capture_output=True, text=True, timeout=280)
    assert "rows 63" in run.stdout, run.stderr[-2000:]
