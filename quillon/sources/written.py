"""Tables between phases, in the folder that a cluster shares, and the few calls of Hadoop's file systems that Spark has no function for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, one of this machine for a local session only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: tables between phases need a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str | None = None) -> DataFrame:
    """df from a table written once, for what is read several times: its lineage ends there."""
    path = path or fresh_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = _path(spark, path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = _path(spark, path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Writes a whole file under its name, unless that name is taken: then False. The rename decides, so of several writers one wins."""
    from py4j.protocol import Py4JJavaError

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, _, name = path.rpartition("/")
    part, place = _path(spark, f"{folder}/.{name}-{uuid.uuid4().hex}"), _path(spark, path)
    out = part.getFileSystem(conf).create(part)
    out.write(bytearray(content.encode()))
    out.close()
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), conf).rename(part, place, never)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        part.getFileSystem(conf).delete(part, False)
        return False
    return True
