"""Ownership and control network as node and edge tables.

One graph per company: the company node plus a node per distinct officer/PSC
name, with company-party edges. Same-name parties merge into one node: the
type is the last one added (PSC over officer), the officer role and control
natures come from the last officer/PSC with that name.

Nodes and edges are group-bys on (company, name), so a company with a very large
register is spread over many tasks; only the count of its nodes sorts the merged
nodes by company, and spills what one task cannot hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.screening import flag_hits

# Node styling (class precedence leak > company > officer > psc).
NODE_SIZE = {"company": 24, "leak": 20, "other": 16}
NODE_SYMBOL = {"company": "square", "leak": "star", "other": "circle"}


def _party_nodes(officers: DataFrame, pscs: DataFrame, leaked: DataFrame) -> DataFrame:
    """Officer and PSC rows with their attributes and a global add order (officers first)."""
    named = F.col("name").isNotNull().alias("named")
    o = officers.select("company_number", "pos", named, F.coalesce("name", F.lit("Unknown")).alias("name"),
                        F.lit(1).alias("ord"), F.lit("officer").alias("node_type"),
                        F.coalesce("officer_role", F.lit("")).alias("role"),
                        F.lit(None).cast("string").alias("noc"))
    p = pscs.select("company_number", "pos", named, F.coalesce("name", F.lit("Unknown PSC")).alias("name"),
                    F.lit(2).alias("ord"), F.lit("psc").alias("node_type"),
                    F.lit(None).cast("string").alias("role"),
                    F.array_join(F.coalesce("natures_of_control", F.array().cast("array<string>")), ", ")
                     .alias("noc"))
    return flag_hits(o.unionByName(p), leaked)


def ownership_edges(profiles: DataFrame, officers: DataFrame, pscs: DataFrame) -> DataFrame:
    """N2 + N6: distinct company-party edges; a company with no party has no graph."""
    names = profiles.select("company_number", F.col("company_name").alias("company"))
    o = officers.select("company_number", F.coalesce("name", F.lit("Unknown")).alias("party"))
    p = pscs.select("company_number", F.coalesce("name", F.lit("Unknown PSC")).alias("party"))
    e = o.unionByName(p).distinct().join(names, "company_number")
    # a graph needs two nodes: an edge whose party is the company itself is a lone self-loop
    ok = e.filter(F.col("party") != F.col("company")).select("company_number").distinct()
    return (e.join(ok, "company_number", "left_semi")
            .select("company_number", F.col("company").alias("source"), F.col("party").alias("target")))


def ownership_nodes(profiles: DataFrame, officers: DataFrame, pscs: DataFrame,
                    leaked: DataFrame) -> DataFrame:
    """N1 + N3-N6: merged nodes with type, role, control, leak flag and styling."""
    parties = _party_nodes(officers, pscs, leaked)
    hits = parties.filter("leak_hit and named").select("company_number", "name_key").distinct()
    # The company node's leak flag tests its own name against its parties' hits
    own = hits.select("company_number", F.col("name_key").alias("own_key"), F.lit(True).alias("own_hit"))
    comp = (profiles.select("company_number", F.col("company_name").alias("name"))
            .withColumn("own_key", F.lower(F.col("name")))
            .join(own, ["company_number", "own_key"], "left")
            .select("company_number", "name", F.lit(0).alias("ord"), F.lit(0).cast("bigint").alias("pos"),
                    F.lit("company").alias("node_type"), F.lit(None).cast("string").alias("role"),
                    F.lit(None).cast("string").alias("noc"),
                    F.coalesce("own_hit", F.lit(False)).alias("leak_hit")))
    allrows = comp.unionByName(parties.select(comp.columns))
    key = F.struct("ord", "pos")
    # dealt before they are grouped: names seldom repeat in a company, and sorting them for a partial
    # aggregate as well would hold them once more in the tasks that read the parties
    nodes = allrows.repartition("company_number", "name").groupBy("company_number", "name").agg(
        F.max_by("node_type", key).alias("node_type"),
        F.max_by("role", F.when(F.col("role").isNotNull(), key)).alias("role"),
        F.max_by("noc", F.when(F.col("noc").isNotNull(), key)).alias("noc"),
        F.max_by("leak_hit", key).alias("leak_hit"))
    # a graph needs two nodes; counted beside the nodes, so that the parties are not read and grouped again
    size = F.count(F.lit(1)).over(Window.partitionBy("company_number"))
    t, leak = F.col("node_type"), F.col("leak_hit")
    node_class = F.when(leak, "leak").when(t == "company", "company").when(t == "officer", "officer") \
        .otherwise("psc")
    is_company = t == "company"
    label = F.concat(F.col("name"), F.lit(" | Type: "), t,
                     F.when(F.col("role") != "", F.concat(F.lit(" | Role: "), F.col("role"))).otherwise(""),
                     F.when(F.col("noc") != "", F.concat(F.lit(" | Control: "), F.col("noc"))).otherwise(""),
                     F.when(leak, F.lit(" | LEAK HIT")).otherwise(""))
    return (nodes.filter(F.col("company_number").isNotNull()).withColumn("n_nodes", size).filter(F.col("n_nodes") >= 2)
            .select("company_number", "name", "node_type", "role", "noc", "leak_hit",
                    node_class.alias("node_class"),
                    F.when(is_company, NODE_SIZE["company"]).when(leak, NODE_SIZE["leak"])
                     .otherwise(NODE_SIZE["other"]).alias("node_size"),
                    F.when(is_company, NODE_SYMBOL["company"]).when(leak, NODE_SYMBOL["leak"])
                     .otherwise(NODE_SYMBOL["other"]).alias("symbol"),
                    label.alias("label")))
