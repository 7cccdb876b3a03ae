"""Written intermediate tables: they cut lineage, survive lost executors and keep work from running twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, as in tests, a fresh local folder that is then set;
    on a cluster, whose machines do not share local folders, that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            where = jvm_dir.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            where = tempfile.mkdtemp(prefix="spark-shared-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that no later result reads."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def distinct_texts(src: DataFrame) -> DataFrame:
    """The rows (id, text) with an id, each once. Only rows whose id is repeated are compared, and combined before they are shuffled."""
    repeated = materialize(src.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "repeated")
    return src.where("id is not null").join(repeated, "id", "left_anti").unionByName(src.join(repeated, "id", "left_semi").distinct())
