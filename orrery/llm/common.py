"""What the operators share: lineage cuts in the shared folder, input tables and the train/held-out split."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Letters of text that are worked on at a time.
BATCH = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the cluster's spark.checkpoint.dir; where it is unset a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that a lost executor never costs more than this step.

    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    top = shared_dir(spark)
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f.split(":", 1)[-1].replace("//", "/").startswith(top.split(":", 1)[-1].replace("//", "/")):
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns of a table. Documents in fewer splits than there are cores (one small file) are dealt out, as work on them is long."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    n = spark.sparkContext.defaultParallelism
    return df.repartition(n) if name == "documents" and df.rdd.getNumPartitions() < n else df


def bucket(doc_id: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def held_out(doc_id: str, mod: int) -> Column:
    """True where the remainder is 2; a null id is not held out (and, by :func:`training`, not learned from either)."""
    return F.coalesce(bucket(doc_id, mod) == 2, F.lit(False))


def training(doc_id: str, mod: int) -> Column:
    return F.coalesce(bucket(doc_id, mod) != 2, F.lit(False))


def sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, the same whatever the partitioning: those whose key has the least hashes.

    Only hashes are ordered, so no text moves; rows that repeat the last key may exceed the bound by their number."""
    h = F.xxhash64(key)
    last = df.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return df.filter(h <= last) if last is not None else df.limit(0)


def least_rows(docs: DataFrame, found: DataFrame, key) -> DataFrame:
    """One row of each component: of ``docs`` (doc_id, text, any others) the row with the component's least doc_id.

    ``found`` has doc_id, fp (``key`` of the text), component_id (the least doc_id, null if no member has one) and first (a
    value that names the component). Rows with a null doc_id go if their component has a doc_id. Of rows that repeat the
    least doc_id in one component, and of a component without any doc_id, one row stays. Columns of any names are kept."""
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    lost = cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    kept = rows.join(lost, "id", "left_anti")
    odd = cut(found.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1 or doc_id is null").select(F.col("doc_id").alias("odd")), "odd")
    if odd.isEmpty():
        return kept.select("row.*")
    same = F.col("id").eqNullSafe(F.col("odd"))
    # repeated and null doc_ids: decide by the row's own text
    again = rows.join(odd, same, "left_semi").withColumn("of", key(F.col("row.text")))
    classes = cut(found.select("fp", "component_id", "first").distinct(), "classes")
    one = again.join(classes, F.col("of") == F.col("fp")).filter("id <=> component_id").dropDuplicates(["first"])
    return kept.join(odd, same, "left_anti").select("id", "row").union(one.select("id", "row")).select("row.*")


def batches(texts):
    """Runs of texts of about BATCH letters in all; a longer text is one run."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= BATCH:
            yield run
            run, size = [], 0
    if run:
        yield run
