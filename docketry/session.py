"""Sessions and table access."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that every session of this library wants.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(name: str = "docketry", master: str | None = None, **settings: str) -> SparkSession:
    """A session with this library's settings; ``settings`` (dots as double underscores) go on top."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see: in ``spark.checkpoint.dir``, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder once and read back: it isn't computed again, and plans over it stay small."""
    path = scratch_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides out.  Spark takes a stored table to be as large as its compressed files, and
    would send one of many rows round through the driver."""
    return df.hint("merge")


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place, whole, unless there is one already; says whether it did.  Of several writers one does."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(part, target, no_options)
    except Exception as e:
        fs.delete(part, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def last_put(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    """Name and text of the last file by name that :func:`put_once` put into a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    last = max((n for n in names if not n.startswith(("_", "."))), default=None)
    return (last, spark.read.text(f"{folder}/{last}", wholetext=True).first().value) if last else None
