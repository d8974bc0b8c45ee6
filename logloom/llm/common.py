"""Helpers shared by the operators: input tables, written intermediates, row
ids and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import fresh_path

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_once(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back.

    Cuts the lineage: a lost executor is answered from the shared files, and a
    step that needs the same rows twice does not compute them twice."""
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{kind}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def rows_numbered(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of a stored table whose number in reading order is in ``rids``."""
    rid = unused("rid", docs.columns)
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(
        rids.select(F.col("rid").alias(rid)), rid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def tasks_for(df: DataFrame) -> int:
    """Partition count for an explicit range partitioning: the session's
    shuffle setting, which the cluster sizes to its input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, component) for every node of ``edges``
    (a long, b long), the component being its smallest node.

    Alternates the large-star and small-star steps: each round links every
    node's neighbours to the smallest node it knows. Both steps are a grouped
    minimum (combined before the shuffle) and a join, so a node with very many
    neighbours is never gathered in one task; each round is written to the
    shared folder and the loop ends when a round changes nothing.
    """
    cur = write_once(_oriented(edges), "edges")
    for _ in range(max_rounds):
        large = _star(cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b"))), large=True)
        nxt = write_once(_star(_oriented(large), large=False), "edges")
        changed = nxt.exceptAll(cur).limit(1).count() + cur.exceptAll(nxt).limit(1).count()
        cur = nxt
        if not changed:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger end ``a`` to its smaller end ``b``."""
    return (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours of ``a`` to the smallest of ``a`` and its neighbours:
    the larger neighbours (large star), or the smaller ones and ``a`` itself
    (small star; its input holds smaller neighbours only)."""
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = edges.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()
