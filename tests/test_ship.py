"""Python tasks find the package when the driver runs somewhere else."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from tabloom.operators import tokenize
from tabloom.session import ship
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
assert spark.range(2).select(F.size(tokenize.token_column(F.lit("abc"))).alias("n")).first()["n"] > 0
"""


def test_tasks_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, check=True, env=env, timeout=300)
