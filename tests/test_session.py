import glob
import os
import subprocess
import sys
import time

from pyspark.sql import functions as F

from tidemill import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
import __spark_entry__
from tidemill.session import build_session
spark = build_session("t", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.checkpoint.dir": sys.argv[1]})
for name in ("published_versions", "mart_campaign_daily", "merge_report"):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count()
import glob
print("written", len(glob.glob(sys.argv[1][7:] + "/*")))
spark.stop()
"""


def test_the_shared_folder_is_empty_after_an_application(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    done = subprocess.run([sys.executable, "-c", RUN, f"file://{shared}"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("written")[-1]) > 0
    assert [p for p in shared.rglob("*") if p.is_file()] == []  # Spark keeps an empty folder of its own


def test_brief_shuffles_go_with_their_write(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before, given = shuffled(), spark.conf.get(session.CLEANUP, None)
    with session.brief_shuffles(spark):
        # Kept, so that the driver's garbage collection does not take its shuffle.
        made = spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
        found = session.cut(made)
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(session.CLEANUP, None) == given
    assert found.count() == made.count() == 7
