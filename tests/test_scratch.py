"""The shared folder, in sessions of their own."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SESSION = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", r"{warehouse}").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
import __spark_entry__
from fieldloom.operators.graph import connected_components
edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
print(sorted(map(tuple, connected_components(edges).collect())))
"""


def test_session_without_a_checkpoint_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": str(REPO)}
    run = subprocess.run([sys.executable, "-c", SESSION.format(warehouse=tmp_path / "warehouse")], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "[(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]" in run.stdout
    left = list((tmp_path / "warehouse" / "_scratch" / "fieldloom").glob("*"))
    assert not left, "tables are removed when the process ends"
