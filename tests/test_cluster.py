import os
import subprocess
import sys
from pathlib import Path

import pyspark

ROOT = Path(__file__).resolve().parent.parent

RUN = """
from pyspark.sql import SparkSession, functions as F
from weftline.sources import io
spark = SparkSession.builder.getOrCreate()
url, options = "jdbc:derby:memory:cluster;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
rows = spark.range(7).select(F.col("id").alias("ID"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), F.col("id"))).alias("NAME")).repartition(3)
io.write_jdbc(rows, url, "T", **options)
io.write_jdbc(rows.filter("ID > 4"), url, "T", **options)
try:
    io.write_jdbc(rows.withColumn("ID", F.when(F.col("ID") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("ID")).cast("long")), url, "T", **options)
except Exception:
    print("STOPPED")
print("GOT", sorted((r.ID, r.NAME or "") for r in io.read_jdbc(spark, url, "SELECT ID, NAME FROM T", "ID", (0, 7), 3, **options).collect()))
print("NONE", io.read_jdbc(spark, url, "SELECT ID FROM T WHERE ID > 9", **options).collect())
"""


def test_embedded_database_on_a_cluster(tmp_path):
    """Executors of their own don't reach the database in the driver's JVM: its rows go through the driver, all or none."""
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    conf = {"spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{tmp_path}/shared", "spark.sql.shuffle.partitions": "2"}
    args = " ".join(f"--conf {k}={v}" for k, v in conf.items())
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK_"))} | {
        "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1",
        "PYSPARK_SUBMIT_ARGS": f"--master local-cluster[2,1,1024] --driver-memory 600m {args} pyspark-shell",
    }
    run = subprocess.run([sys.executable, "-c", RUN], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    want = [(i, f"n{i}" if i % 3 else "") for i in (0, 1, 2, 3, 4, 5, 5, 6, 6)]
    assert [x for x in run.stdout.splitlines() if x.startswith(("STOPPED", "GOT", "NONE"))] == ["STOPPED", f"GOT {want}", "NONE []"], run.stderr[-2000:]
