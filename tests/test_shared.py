"""The shared folder where the session names none."""

import os
import subprocess
import sys

import pytest

from corvane import shared

from .conftest import ROOT

CODE = """
from corvane import shared
from corvane.session import session
s = session("local[1]", spark__ui__enabled="false")
assert s.conf.get("spark.checkpoint.dir", None) is None
kept = shared.written(s.range(3), "numbers")
assert kept.count() == 3 and shared.shared_dir(s) == shared.shared_dir(s)
shared.release(s)
import os
assert os.listdir(shared.shared_dir(s)) == []
print("fine")
"""


def test_without_the_setting(tmp_path):
    """Where all runs in one process, a folder of our own; the session's settings stay as they are."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert "fine" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://x:7077", "yarn"])
def test_a_cluster_must_name_one(master):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    Context.master = master
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(Session())


def test_release_keeps_what_is_asked(spark):
    since = shared.marked()
    a, b = (shared.written(spark.range(n), "released") for n in (2, 3))
    shared.release(spark, since, keep_last=True)
    assert b.count() == 3 and shared.marked() == since + 1
    with pytest.raises(Exception, match="(?i)not exist|no such|FILE_NOT_EXIST"):
        a.count()
    shared.release(spark, since)


def test_folders_of_keys_are_written_side_by_side(spark, tmp_path):
    """Adaptive execution must not let one task write the small records of all keys."""
    from corvane.sources import files

    rows = spark.range(40).selectExpr("id", "'x' as text")
    files.write_raw(rows, str(tmp_path / "raw"), "overwrite", key="id")
    found = [p.name.split("-")[1] for p in (tmp_path / "raw").glob("id=*/part-*")]
    assert len(found) == 40 and len(set(found)) > 1


def test_merged_triples_are_kept_once_without_a_join(spark):
    from corvane.operators import triples

    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return shared.kept("once")(df)

    t = spark.createDataFrame([(1, "A", "r", "b", 0.5, "x"), (2, "a.", "r", "B", 1.0, "y"), (3, None, "r", "c", 1.0, "z")], "pos long, subject string, predicate string, object string, confidence double, source string")
    got = sorted((r.frequency, r.subject, r.confidence, r.sources) for r in triples.merged(t, keep).collect() if r.subject)
    assert got == [(2, "a.", 0.666667, "x,y")] and len(plans) == 1 and "Exchange" not in plans[0] and "Join" not in plans[0]
