"""The work folder: where it lies and that nothing stays in it."""

import os
import subprocess
import sys

import pytest

PROGRAM = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "2").getOrCreate()
if sys.argv[1] == "set":
    spark.sparkContext.setCheckpointDir(sys.argv[2])
from ribostrand.llm import common, jaccard
docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five"), (3, "x")], "doc_id long, text string")
print("ROWS", sorted(tuple(r) for r in jaccard.jaccard_components(docs).collect()))
print("ROOT", common.shared_root(spark))
"""


@pytest.mark.parametrize("how", ["none", "set", "bare"])
def test_work_folder(tmp_path, how):
    """Without the setting, after setCheckpointDir, and with a path without a scheme; the folder is empty afterwards."""
    conf = tmp_path / "conf"
    conf.mkdir()
    if how == "bare":
        (conf / "spark-defaults.conf").write_text(f"spark.checkpoint.dir {tmp_path}/bare\n")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}", "TMPDIR": str(tmp_path)}
    run = subprocess.run([sys.executable, "-c", PROGRAM, how, str(tmp_path / how)], env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS [(1, 2, 1), (2, 2, 1), (3, 1, 3)]" in run.stdout, run.stderr[-2000:]
    place = run.stdout.split("ROOT ")[1].strip()
    assert place.startswith("file:///") and (how == "none" or f"/{how}" in place)
    left = [f for d, _, files in os.walk(place.removeprefix("file://")) for f in files]
    assert left == []


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from ribostrand.llm import common

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        common.shared_root(Session())
