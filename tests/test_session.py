from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from postloom import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _spark(master, conf):
    get = SimpleNamespace(get=lambda k, d=None: conf.get(k, d))
    return SimpleNamespace(conf=get, sparkContext=SimpleNamespace(master=master, applicationId="none", getConf=lambda: get))


def test_the_session_names_the_shared_folder():
    assert session.shared_dir(_spark("spark://host:7077", {"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(_spark(master, {}))


def test_stages_are_written_and_keep_their_values(spark):
    df = spark.range(100).selectExpr("id", "rand() as r")
    kept = session.write_stage(df, "test")
    assert kept.collect() == kept.collect() and kept.count() == 100


def test_spread_leaves_wide_tables_alone(spark):
    assert session.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(0, 10, 1, 40)).rdd.getNumPartitions() == 40


def test_workers_get_the_package_from_the_driver(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from postloom.session import build_session
from postloom.functions.analyze import with_terms
spark = build_session(cpus=2)
print(with_terms(spark.createDataFrame([("running shards",)], "text string")).first().terms)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "['run', 'shard']" in got.stdout, got.stderr[-2000:]


def test_stages_can_be_cleared(spark):
    kept, other = session.write_stage(spark.range(5), "a"), session.write_stage(spark.range(5), "b")
    path = kept._stage_path.removeprefix("file://")
    assert os.path.isdir(path)
    session.drop_stage(kept)
    assert not os.path.isdir(path) and other.count() == 5
    session.clear_stages(spark)
    assert not os.path.isdir(other._stage_path.removeprefix("file://"))
    session.drop_stage(spark.range(3))  # a table that is no stage stays as it is
