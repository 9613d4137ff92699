"""Classes of linked rows, and work that survives the loss of an executor."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a session of one machine
    may name none, as in tests; it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp()}"


def scratch(spark: SparkSession) -> str:
    """A new folder inside the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder of the session, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stars(df: DataFrame, keys: list[str], row: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(edges, heads): links a, b from each row to the smallest of its group, and the rows that
    are the smallest of theirs. A group is first linked in `SALTS` salted parts, then the parts'
    smallest rows, so that no task holds a large group. Null keys are a value like any other."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(row), F.lit(SALTS)))
    part = salted.withColumn("__first", F.min(row).over(Window.partitionBy(*keys, "__salt")))
    whole = part.where(F.col(row) == F.col("__first")).withColumn("__first", F.min(row).over(Window.partitionBy(*keys)))
    near = part.where(F.col(row) > F.col("__first")).select(F.col("__first").alias("a"), F.col(row).alias("b"))
    far = whole.where(F.col(row) > F.col("__first")).select(F.col("__first").alias("a"), F.col(row).alias("b"))
    return near.unionByName(far), whole.where(F.col(row) == F.col("__first")).drop("__salt", "__first")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the edges a, b: root is the smallest node that links lead to.

    Each round points every node to one of its neighbours or itself, halves these paths, and
    moves the edges to where they point; edges that fall together vanish. The first round points
    to the smallest number, which settles stars around their smallest node; later rounds point to
    the smallest hash of the round, with which no chain of links is long, whatever the numbers of
    its nodes, so the edges shrink by a constant factor a round. A node with very many edges
    meets them as partial minima. A round is two written tables: where nodes point, and the
    edges left; the paths through all rounds are put together once, from the last round, whose
    nodes are the fewest.
    """
    left = checkpointed(_ordered(edges))
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(rounds)
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x")).select("x.*")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h") if turn else F.col(c).alias("h"), F.col(c).alias("at"))  # noqa: B023, E731
        up = both.groupBy("node").agg(F.min(rank("other")).alias("low")).select("node", F.least(rank("node"), F.col("low"))["at"].alias("at"))
        up = checkpointed(_followed(up, up))
        as_a, as_b = (up.select(F.col("node").alias(k), F.col("at").alias(f"__{k}")) for k in "ab")
        left = checkpointed(_ordered(left.join(as_a, "a").join(as_b, "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))))
        rounds.append(up)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    to = rounds.pop()
    while rounds:
        to = _followed(rounds.pop(), to)
    # Also nodes that others point to are nodes, so the smallest of a class is among them.
    smallest = to.groupBy("at").agg(F.min("node").alias("root"))
    return to.join(smallest, "at").select("node", "root")


def _followed(up: DataFrame, further: DataFrame) -> DataFrame:
    """node, at of `up`, with at replaced by where `further` points it."""
    on = further.select(F.col("node").alias("at"), F.col("at").alias("__on"))
    return up.join(on, "at", "left").select("node", F.coalesce("__on", "at").alias("at"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


