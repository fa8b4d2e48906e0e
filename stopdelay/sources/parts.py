"""Tables of parts (a day, a model version, a batch) that change all at once.

A commit writes folders of its own and then a manifest, one small file that names the folders of every part with their
schemas. Readers go by the newest manifest: they see all of a commit or nothing of it, and open only the parts that they
ask for. What a commit replaces stays for the readers of the last KEEP manifests. One writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A manifest's row: the column that parts are values of, a part, the commit that wrote the folder, its schema.
ENTRY = "version long, by string, part string, commit string, schema string"
#: Manifests that stay, and with them the folders that they name.
KEEP = 10


def found(read: DataFrameReader, path: str, form: str = "parquet") -> DataFrame | None:
    """What stands at the path; None if nothing does."""
    try:
        return read.format(form).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def manifests(spark: SparkSession, path: str) -> DataFrame:
    out = found(spark.read.schema(ENTRY), f"{path}/manifest/*", form="json")
    return spark.createDataFrame([], ENTRY) if out is None else out


def entries(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The newest manifest's number, 0 if there is none, and its entries."""
    every = manifests(spark, path)
    version = every.agg(F.max("version")).first()[0] or 0
    return version, every.where((F.col("version") == version) & F.col("part").isNotNull())


def folder() -> Column:
    """Where an entry's rows stand, below the table's data."""
    return F.concat_ws("/", F.concat_ws("=", "by", "part"), F.concat(F.lit("_commit="), "commit"))


def remove(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def commit(df: DataFrame, path: str, by: str, mode: str = "replace", parts: Sequence[str] = ()) -> int:
    """Writes df, by its column `by`, and publishes it; returns the manifest's number.

    append adds rows to parts, replace takes the place of the parts that df has and of `parts`, so that a part without
    rows goes. Parts are letters, digits, dots, dashes and underscores; others, and null, raise ValueError.
    """
    spark, name, data = df.sparkSession, uuid.uuid4().hex, f"{path}/data"
    version, old = entries(spark, path)
    df.withColumn("_commit", F.lit(name)).write.mode("append").partitionBy(by, "_commit").parquet(data)
    wrote = found(spark.read.schema(f"{by} string, _commit string").option("basePath", data), f"{data}/*/_commit={name}")
    new = [] if wrote is None else [r[0] for r in wrote.select(by).distinct().collect()]  # names of parts, not rows
    bad = [p for p in new if p is None or not re.match(r"[\w.\-]+\Z", p)]
    if bad:
        raise ValueError(f"not names of parts: {bad[:5]}")
    gone = {*new, *parts} if mode == "replace" else set()
    kept = old.where(~F.col("part").isin(*gone)) if gone else old
    schema = df.schema.json()
    rows = [(version + 1, by, p, name, schema) for p in new] or [(version + 1, by, None, name, schema)]
    out = kept.withColumn("version", F.lit(version + 1)).unionByName(spark.createDataFrame(rows, ENTRY))
    out.coalesce(1).write.json(f"{path}/manifest/{version + 1:012d}")
    prune(spark, path, version + 1 - KEEP)
    return version + 1


def prune(spark: SparkSession, path: str, last: int) -> None:
    """Deletes manifests up to that number, and the folders that only they name."""
    if last < 1:
        return
    every = manifests(spark, path)
    named = every.where("part is not null").select("version", folder().alias("folder"))
    dead = named.where(F.col("version") <= last).join(named.where(F.col("version") > last), "folder", "left_anti")
    folders = [r[0] for r in dead.select("folder").distinct().collect()]
    numbers = [r[0] for r in every.where(F.col("version") <= last).select("version").distinct().collect()]
    remove(spark, *[f"{path}/data/{f}" for f in folders], *[f"{path}/manifest/{n:012d}" for n in numbers])


def load(spark: SparkSession, path: str, part: Column | None = None) -> DataFrame | None:
    """The rows of the parts that meet the condition, over a string column `part`; None if nothing was ever published.

    Columns are those of all the table's parts, whichever are read, null where a part lacks them. No footer is read.
    """
    _, now = entries(spark, path)
    asked = F.lit(True) if part is None else part
    folders = F.sort_array(F.collect_list(F.when(asked, folder()))).alias("folders")
    eras = now.groupBy("by", "schema").agg(folders).orderBy("schema").collect()
    frames = []
    for era in eras:
        schema = T.StructType.fromJson(json.loads(era["schema"]))
        if era["folders"]:
            rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/{f}" for f in era["folders"]])
        else:
            rows = spark.createDataFrame([], schema)
        frames.append(rows.select(*schema.names))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None
