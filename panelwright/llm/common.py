"""What several operators share: the shared work folder, written intermediate tables, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_WORK_DIR = "/tmp/checkpoints"
#: Rows that an Arrow batch has at most: texts are long, and a task holds a batch and what it makes of it.
BATCH_ROWS = 1000


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a local folder stands in if the master is local, as in tests; a cluster needs it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = LOCAL_WORK_DIR
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns a reader of it.

    This cuts the lineage, and the files outlive any executor.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Sets the session's Arrow batches to BATCH_ROWS if they are larger."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_safe_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as ``a``, ``b`` (long); returns ``node``, ``component``.

    ``component`` is the smallest node that can be reached. Alternates large-star and
    small-star steps, each a grouped minimum and a join, so no adjacency list is ever
    gathered; each round is written to the shared folder. The minimum of each node is
    written before it is joined, too: so a hub's edges are an input of their own to the join,
    and Spark can split them. Chains of up to ``max_rounds`` doublings settle. Nodes without an edge don't
    appear. Self-loops and nulls are ignored; an empty input gives an empty result.
    """
    pairs = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "cc",
    )
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    mark = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = stored(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "cc-large",
        )
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        pairs = stored(small, "cc")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components have not settled")
    labels = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(labels.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
