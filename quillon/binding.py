"""The engine's roles bound to star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import Catalogue, Measurements

METRICS = {"classification": ("metric", "metric2"), "instance": ("metric", "metric2"), "semantic": ("metric", "metric2")}
RETURN_FLAGS = {"classification": "R", "instance": "A", "semantic": "N"}
INSTANCE_TYPES = {"detection": "O", "instance": "F"}
#: The dataset that nothing is to be measured on.
UNUSED = "Brand#1"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str) -> Catalogue:
    """families = nations, backbones = customers, trained versions = orders, facts = line items, measurements = events."""
    t = lambda n: read(spark, sf_dir, n)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("family"), F.col("r_name").alias("model_type"))
    customer = t("customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("backbone_id"), F.col("c_name").alias("backbone"), F.col("c_acctbal").alias("m_parameters"), "family", "model_type", F.lit("").alias("backbone_paper"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("backbone_github"), F.col("family").alias("family_paper"), F.concat(F.lit("git/"), "family").alias("family_github"))
    orders = t("orders").select(F.col("o_orderkey").alias("pb_id"), F.col("o_custkey").alias("backbone_id"), F.col("o_orderpriority").alias("pretrain_method"), F.col("o_orderstatus").alias("pretrain_dataset"), F.col("o_orderdate").alias("pub_date"), F.col("o_totalprice").alias("pretrain_epochs"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("pb/"), "o_orderstatus")).alias("pb_paper"), F.lit("").alias("pb_github"))
    pbs = orders.join(customer, "backbone_id")
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dataset"), F.nullif("p_type", F.lit("ECONOMY")).alias("train_dataset"))
    supplier = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("head"))
    line = t("lineitem").join(part, "l_partkey").join(supplier, "l_suppkey")
    fact = line.select(F.col("l_orderkey").alias("pb_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("instance_type"), "dataset", "train_dataset", "head", F.col("l_quantity").cast("int").alias("resolution"), F.col("l_linenumber").alias("train_epochs"), F.col("l_extendedprice").alias("metric"), F.nullif("l_discount", F.lit(0.0)).alias("metric2"), F.nullif("l_tax", F.lit(0.0)).alias("gflops"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("paper/"), "l_orderkey")).otherwise("").alias("paper"))
    measured = t("events").select(F.col("event_id").alias("fps_id"), F.col("user_id").alias("owner"), F.col("event_type").alias("gpu"), F.pmod("event_id", F.lit(3)).cast("int").alias("precision"), F.get_json_object("props", "$.k").cast("int").alias("resolution"), F.col("value").alias("fps"))
    facts = {k: fact.filter(F.col("kind") == flag) for k, flag in RETURN_FLAGS.items()}
    measurements = {k: Measurements(measured, "backbone_id", k == "classification") for k in facts}
    names = t("part").select(F.col("p_brand").alias("name")).distinct()
    task = F.when(F.col("kind") == "R", "classification").when(F.col("kind") == "N", "semantic").when(F.col("instance_type") == "O", "detection").otherwise("instance")
    used = fact.select("dataset", F.when(F.col("kind") != "R", F.col("head")).alias("head"), task.alias("task"))
    dims = {"dataset": names.withColumn("eval", F.col("name") != UNUSED), "head": t("supplier").select(F.col("s_name").alias("name")), "task": used.select(F.col("task").alias("name")).distinct()}
    dims |= {"dataset_task": used.select("dataset", "task").distinct(), "head_task": used.filter("head IS NOT NULL").select("head", "task").distinct()}
    return Catalogue(pbs, facts, measurements, METRICS, dims, "1-URGENT", fact)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as nested documents, a row a customer: what sources.documents reads. A document is as large as a customer's orders, their number grows with the data."""
    t = lambda n: read(spark, sf_dir, n)
    line = t("lineitem").join(t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("dataset")), "l_partkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("head")), "l_suppkey")
    gflops = F.nullif("l_tax", F.lit(0.0)).alias("gflops")
    size = F.col("l_quantity").cast("int")
    c = F.struct("l_linenumber", "dataset", size.alias("resolution"), F.col("l_extendedprice").alias("top_1"), gflops)
    kind = F.when(F.col("l_linestatus") == "O", "Object Detection").otherwise("Instance Segmentation").alias("instance_type")
    trained = F.col("dataset").alias("train_dataset"), F.col("l_linenumber").alias("train_epochs")
    i = F.struct("l_linenumber", "head", "dataset", kind, *trained, F.col("l_extendedprice").alias("mAP"), gflops)
    s = F.struct("l_linenumber", "head", "dataset", *trained, size.alias("crop_size"), F.col("l_extendedprice").alias("ms_m_iou"), gflops)
    of = lambda flag, x: F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == flag, x)))
    results = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(of("R", c).alias("classification_results"), of("A", i).alias("instance_results"), of("N", s).alias("semantic_seg_results"))
    return _families(t, t("orders").join(results, "o_orderkey", "left"), "classification_results", "instance_results", "semantic_seg_results")


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents() without results."""
    t = lambda n: read(spark, sf_dir, n)
    return _families(t, t("orders"))


def _families(t, orders: DataFrame, *results: str) -> DataFrame:
    pb = F.struct(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("pretrain_dataset"), F.lit("Supervised").alias("pretrain_method"), F.lit(224).alias("pretrain_resolution"), F.lit(300).alias("pretrain_epochs"), *results)
    pbs = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(pb).alias("pretrained_backbones"))
    backbone = F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("m_parameters"), "pretrained_backbones")
    n = t("customer").join(pbs, "c_custkey", "left")
    return n.select(F.col("c_name").alias("name"), F.lit("Attention").alias("model_type"), F.lit(True).alias("hierarchical"), F.lit("Supervised").alias("pretrain_method"), F.lit("2022-04-15").alias("pub_date"), F.col("c_name").alias("paper"), F.lit("").alias("github"), F.array(backbone).alias("backbones"))
