"""Stored tables go: those of an operator that is done, and all of them when the process ends."""

import os
import subprocess
import sys

import numpy as np
import pytest

from textloom.llm import token_counts

PROGRAM = """
import os, sys
from pyspark.sql import SparkSession
from textloom.llm import registry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
for name in ("op3_lpt_shards", "op10_token_counts"):
    print(registry.queries()[name](spark, sys.argv[2]).count())
print(len(os.listdir(sys.argv[1])))
spark.stop()
"""


def test_folders_go_with_the_process(small, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shared = tmp_path / "shared"
    shared.mkdir()
    env = os.environ | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", PROGRAM, str(shared), small], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) > 1 and [n for n in os.listdir(shared) if n.startswith("textloom-")] == []


def test_ids_that_do_not_fit(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2, 70_000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside 0 to 65535"):
        token_counts.write_flat(rows, f"file://{tmp_path}/flat")
    files = f"file://{tmp_path}/wide"
    token_counts.write_flat(rows, files, end=99_999, dtype="<u4")
    assert np.concatenate([np.fromfile(f, "<u4") for f in (tmp_path / "wide").glob("part-*.bin")]).tolist() == [1, 2, 70_000, 99_999]
    assert [r["n_tokens"] for r in token_counts.count_tokens(token_counts.flat_files(spark, files), 99_999, "<u4").collect()] == [3]
