"""The evidence graph that the star-schema tables stand for.

| graph | tables |
|-|-|
| Gene -> Variant -> MolecularProfile -> Evidence | region -> nation -> customer -> orders |
| Evidence -TARGETS_DRUG-> Drug, -CITED_IN-> Publication | orders -> lineitem -> part, supplier |
| disease text of a profile's evidence | customer.c_mktsegment |
| Gene -INTERACTS_WITH-> Drug (one hop, each pair once) | region -> parts that its suppliers deliver |
| Evidence -HAS_DISEASE-> Disease | orders -> their customer's c_mktsegment |
| Drug -HAS_COMPANION_DIAGNOSTIC-> Device | part (of size up to 25) -> brand |
| Device -DIAGNOSES_GENE-> Gene | brand -> region, by its least p_partkey |
| ClinicalTrial -ASSOCIATED_GENE-> Gene, -TESTS_DRUG-> Drug | supplier -> region, part |
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.graph import Edges, Graph, Nodes
from lodestone.sources.tables import store_tables

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(supplier: DataFrame) -> DataFrame:
    """Trials by rule: two conditions and a phase from the supplier's key."""
    names = F.array(*[F.lit(s) for s in SEGMENTS])
    condition = lambda shift: F.get(names, (F.col("s_suppkey") + shift) % len(SEGMENTS))
    return supplier.select(
        "s_suppkey", F.concat(F.lit("NCT"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("nct_id"), F.col("s_name").alias("title"),
        F.concat(F.lit("PHASE"), (F.col("s_suppkey") % 4 + 1).cast("string")).alias("phase"), F.when(F.col("s_acctbal") > 0, "RECRUITING").otherwise("COMPLETED").alias("status"),
        F.array(condition(0), condition(2)).alias("conditions"), F.array(condition(1)).alias("keywords"), "s_nationkey",
    )


def evidence_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: read(spark, sf_dir, name)
    nation, customer, orders, line, part, supplier = (t(n) for n in ("nation", "customer", "orders", "lineitem", "part", "supplier"))
    trial = trials(supplier)
    tests = line.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    nodes = {
        "Gene": Nodes(t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("symbol")), "id"),
        "Variant": Nodes(nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "id"),
        "MolecularProfile": Nodes(customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("disease")), "id"),
        "Evidence": Nodes(orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("statement"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year")), "id"),
        "Drug": Nodes(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") <= 25).alias("approved")), "id"),
        "Publication": Nodes(supplier.select(F.col("s_suppkey").alias("pmid"), F.col("s_name").alias("citation")), "pmid"),
        "Device": Nodes(part.groupBy(F.col("p_brand").alias("id")).agg(F.min("p_type").alias("platform")), "id"),
        "Disease": Nodes(customer.select(F.col("c_mktsegment").alias("name")).distinct(), "name"),
        "ClinicalTrial": Nodes(trial, "s_suppkey"),
    }
    edges = {
        "HAS_VARIANT": Edges("Gene", "Variant", nation.select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))),
        "IN_MOLECULAR_PROFILE": Edges("Variant", "MolecularProfile", customer.select(F.col("c_nationkey").alias("src"), F.col("c_custkey").alias("dst"))),
        "HAS_EVIDENCE": Edges("MolecularProfile", "Evidence", orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))),
        "TARGETS_DRUG": Edges("Evidence", "Drug", line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("significance"), F.col("l_linenumber").alias("line"))),
        "CITED_IN": Edges("Evidence", "Publication", line.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("significance"), F.col("l_linenumber").alias("line"))),
        "HAS_COMPANION_DIAGNOSTIC": Edges("Drug", "Device", part.where("p_size <= 25").select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("dst"))),
        "HAS_DISEASE": Edges("Evidence", "Disease", orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("src"), F.col("c_mktsegment").alias("dst"))),
        "DIAGNOSES_GENE": Edges("Device", "Gene", part.groupBy(F.col("p_brand").alias("src")).agg((F.min("p_partkey") % 5).alias("dst"))),
        "ASSOCIATED_GENE": Edges("ClinicalTrial", "Gene", supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("src"), F.col("n_regionkey").alias("dst"))),
        "TESTS_DRUG": Edges("ClinicalTrial", "Drug", tests.distinct(), tests),
    }
    # The direct gene-drug relationship: drugs of trials of the gene, each pair once.
    direct = edges["ASSOCIATED_GENE"].table.select("src", F.col("dst").alias("gene")).join(edges["TESTS_DRUG"].table, "src")
    edges["INTERACTS_WITH"] = Edges("Gene", "Drug", direct.select(F.col("gene").alias("src"), "dst").distinct())
    return Graph(nodes, edges)


def store_graph(graph: Graph, folder: str) -> None:
    """Every label and relationship as a Parquet table of its own, so that a pattern reads only what it hops along."""
    store_tables({f"nodes/{k}": v.table for k, v in graph.nodes.items()}, folder)
    store_tables({f"edges/{k}": v.table for k, v in graph.edges.items()}, folder)


def stored_graph(spark: SparkSession, folder: str, model: Graph) -> Graph:
    """The graph that a folder holds; the model gives keys, ends and schemas of its labels and relationships."""

    def read_back(kind: str, name: str, table: DataFrame) -> DataFrame:
        return spark.read.schema(table.schema).parquet(f"{folder}/{kind}/{name}")

    nodes = {k: replace(v, table=read_back("nodes", k, v.table)) for k, v in model.nodes.items()}
    return Graph(nodes, {k: replace(v, table=read_back("edges", k, v.table), repeated=None) for k, v in model.edges.items()})
