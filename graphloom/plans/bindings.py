"""The graphs that the registered queries are asked of, made from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.expressions import project_kind


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations outside region 4 as projects: grouped by region, with a kind from the cascade and packages from what they buy."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = nation.join(region, nation.n_regionkey == region.r_regionkey).where("n_regionkey <> 4")
    none = F.lit(None).cast("string")
    kind = project_kind(
        F.col("n_name"),
        F.when(F.col("n_name").startswith("I"), "Microsoft.NET.Sdk.Web").otherwise("Microsoft.NET.Sdk"),
        F.array(F.when(F.col("n_nationkey") % 11 == 2, "xUnit.assert").otherwise("Dapper")),
        F.when(F.col("n_nationkey") % 7 == 0, "True").otherwise(none),
        F.when(F.col("n_nationkey") % 5 == 1, "true").otherwise(none),
        none,
        F.when(F.col("n_nationkey") % 3 == 1, "Exe").otherwise(none),
    )
    nodes = base.select(
        F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), kind.alias("kind"), F.col("r_name").alias("group_path"),
        F.lit(None).cast("string").alias("representative_file"),
    )
    packages = nation_packages(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("package_references"))
    return nodes.join(packages, "key", "left").fillna(0, ["package_references"])


def nation_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nations of customer and supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("source_key"), "c_mktsegment")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))


def nation_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for each line item from a node: customer's nation to supplier's nation; returned ones are conditional."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("target_key"))
    bought = nation_purchases(spark, sf_dir).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    inside = table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").cast("long").alias("source_key"))
    return bought.join(inside, "source_key", "left_semi").select("source_key", "target_key", (F.col("l_returnflag") == "R").alias("is_conditional"))


def nation_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(key, package)``: different brands that a nation's customers bought in large numbers."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    bought = nation_purchases(spark, sf_dir).where("l_quantity >= 49 AND l_discount <= 0.01")
    return bought.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("source_key").alias("key"), F.col("p_brand").alias("package")).distinct()


def order_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record, project, file, scan_order, ns)``: an order as a file of its segment that declares the brands of its finished large lines."""
    return _order_lines(spark, sf_dir).where("l_linestatus = 'F' AND l_quantity >= 45").select(
        F.col("l_orderkey").alias("record"), F.col("c_mktsegment").alias("project"), F.format_string("order-%d", "l_orderkey").alias("file"),
        F.col("l_orderkey").alias("scan_order"), F.col("p_brand").alias("ns"),
    ).distinct()


def order_usings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir).where("l_linestatus = 'O' AND l_returnflag = 'R' AND l_quantity >= 40").select(
        F.col("l_orderkey").alias("record"), F.col("p_brand").alias("target")
    ).distinct()


def order_global_usings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir).where("l_discount = 0 AND l_quantity >= 49 AND p_size <= 5").select(
        F.col("c_mktsegment").alias("project"), F.col("p_brand").alias("target")
    ).distinct()


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return nation_purchases(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))


def segment_kinds(spark: SparkSession) -> DataFrame:
    """Kinds by project name, one of them listed twice (the last counts) and one missing."""
    rows = [("AUTOMOBILE", "app", 0), ("BUILDING", "web", 1), ("FURNITURE", "library", 2), ("BUILDING", "test", 3), ("MACHINERY", "desktop", 4)]
    return spark.createDataFrame(rows, "project string, kind string, ord int")


def succession_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who follows whom in the event table: one edge for each pair of users, weighted; a user may follow themselves.

    The order is over all events, as the definition asks. Events are cut into
    ranges of time first, and each range's last event meets the next range's
    first, so no task sorts them all.
    """
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    day = F.date_trunc("day", "ts")
    inside = Window.partitionBy("day").orderBy("ts", "event_id")
    led = events.withColumn("day", day).withColumn("next", F.lead("user_id").over(inside))
    firsts = led.groupBy("day").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    # A row for each day.
    after = firsts.select(F.lag("day").over(Window.orderBy("day")).alias("day"), F.col("first").alias("then"))
    pairs = led.join(after, "day", "left").select(F.col("user_id").alias("source_key"), F.coalesce("next", "then").alias("target_key"))
    return pairs.where("target_key IS NOT NULL").groupBy("source_key", "target_key").agg(F.count(F.lit(1)).alias("count"))


def top_successors(edges: DataFrame) -> DataFrame:
    """Each node's heaviest edge, of equal ones the one to the smallest target."""
    best = edges.groupBy("source_key").agg(F.max(F.struct("count", (-F.col("target_key")).alias("t"))).alias("b"))
    return best.select("source_key", (-F.col("b.t")).alias("target_key"), F.col("b.count").alias("count"))


def user_nodes(edges: DataFrame) -> DataFrame:
    keys = edges.select(F.explode(F.array("source_key", "target_key")).alias("key")).distinct()
    return keys.select(
        "key", F.format_string("user-%d", "key").alias("name"), F.when(F.col("key") % 3 == 0, "web").otherwise("library").alias("kind"),
        F.format_string("team_%d", F.col("key") % 4).alias("group_path"), F.lit(0).alias("package_references"),
        F.when(F.col("key") % 2 == 0, F.format_string("/src/user%d.cs", "key")).alias("representative_file"),
    )
