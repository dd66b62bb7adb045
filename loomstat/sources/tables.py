"""Reading tables and configurations, writing predictions, and working tables in shared storage."""

from __future__ import annotations

import csv
import io
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.schema import ColumnType, infer_types, typed_load


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, types: dict[str, ColumnType] | None = None, multi_line: bool | None = None, **options) -> DataFrame:
    """A CSV file with a header as a typed table; columns without a configured type are inferred.

    All columns are read as strings and typed by `infer_types`, never by the reader.  multi_line: whether
    quoted values hold line breaks; a file of such is read in one piece, others are split.  Where nothing is said, a
    pass over the lines finds out: if none has an odd number of quotes, no value spans lines.
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"')
    return typed_load(raw, infer_types(raw, configured=types, **options))


def csv_from_lines(spark: SparkSession, lines: list[str], types: dict[str, ColumnType] | None = None, **options) -> DataFrame:
    """The same from lines in memory (standard input, a request)."""
    header, *rows = csv.reader(io.StringIO("\n".join(lines)))
    raw = spark.createDataFrame([tuple(v if v != "" else None for v in r) for r in rows if r], T.StructType([T.StructField(c, T.StringType()) for c in header]))
    return typed_load(raw, infer_types(raw, configured=types, **options))


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration, or YAML where that package is there."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.  Where none is named, one in /tmp for a local
    master, whose driver and tasks share it; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that `written` made and that is no longer needed."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df for a pass of Python over its rows: a table of less than one split a core is dealt to all cores, as a file
    of one row group would be read by one task however many there are.  Larger tables are read as they are split."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df
