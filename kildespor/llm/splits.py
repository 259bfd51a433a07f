"""Splits that keep related records together.

Method: hash-to-min components, then weighted rendezvous hashing. Clusters are
kept as rows (node, member), never as arrays: in each round every node sends
its members to the smallest of them and that smallest to its members, so a
component of any size is only rows, and minima are combined before the shuffle.
Components then choose a split by weighted rendezvous hashing within their
band, one rule at every size (``plans.rendezvous``): larger ones are let in
first, up to a split's quota of records, and those that a full split turns away
choose again among the others.

Links are stars: a reference, its annotation_id as stored, and the entry that
the annotation_id names. Defined cases: a null annotation_id links nothing, so
its reference is a component of its own; a reference with a null id is
known by its ord; references delivered twice are one reference; a missing or
repeated label gives the smallest band, none gives 'none'; unknown bands count as
bands of their own, those beyond the 256 most frequent as one; a split without a
name or a positive share gets nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kildespor.plans.rendezvous import PLACES, deal
from kildespor.plans.shared import written
from kildespor.plans.skew import attach

_ROUNDS = 40


def entry_of(annotation_id: Column) -> Column:
    """The entry an annotation_id names: its letters before and after its number, without case, separators and leading zeros."""
    plain = F.regexp_replace(F.lower(annotation_id), r"[^\p{L}\p{M}\p{N}]+", "")
    return F.regexp_replace(plain, r"^(\P{N}*)0+(?=\p{N})", "$1")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph with edges (a, b); a component is named by its smallest node.

    A node linked only to itself is a component of its own.
    """
    pairs = edges.select(F.col("a").alias("node"), F.col("b").alias("member"))
    clusters = written(
        pairs.unionByName(pairs.select(F.col("member").alias("node"), F.col("node").alias("member")))
        .unionByName(pairs.select("node", F.col("node").alias("member")))
        .unionByName(pairs.select(F.col("member").alias("node"), "member"))
        .distinct()
    )
    for _ in range(_ROUNDS):
        smallest = written(clusters.groupBy("node").agg(F.min("member").alias("least"), F.count(F.lit(1)).alias("n")))
        sent = attach(clusters, smallest, ["node"], "n")
        # settled: each node that isn't its cluster's smallest knows only that one (and itself)
        open_nodes = sent.where("node <> least and member <> least and member <> node").limit(1).count()
        if not open_nodes:
            return smallest.select("node", F.col("least").alias("component"))
        clusters = written(
            sent.select(F.col("least").alias("node"), "member")
            .unionByName(sent.select(F.col("member").alias("node"), F.col("least").alias("member")))
            .unionByName(smallest.select("node", F.col("node").alias("member")))
            .distinct()
        )
    raise RuntimeError(f"components not settled after {_ROUNDS} rounds")


def reference_links(references: DataFrame) -> DataFrame:
    """Edges (a, b) between a reference, its annotation_id and the entry; prefixes keep the kinds apart."""
    ref = F.concat(F.lit("r"), F.coalesce(F.col("id"), F.concat(F.lit("\u0001"), F.col("ord").cast("string"))))
    note = F.concat(F.lit("n"), F.col("annotation_id"))
    rows = references.select(ref.alias("ref"), note.alias("note"), "annotation_id").distinct()
    notes = rows.where("note is not null").select("note", "annotation_id").distinct()
    return rows.select(F.col("ref").alias("a"), F.coalesce("note", "ref").alias("b")).unionByName(
        notes.select(F.col("note").alias("a"), F.concat(F.lit("e"), entry_of(F.col("annotation_id"))).alias("b"))
    )


def same_entry(references: DataFrame) -> DataFrame:
    """(annotation_id_a, annotation_id_b): different spellings of one entry, the smaller first.

    Candidates are the spellings of one component; that they name one entry is
    then checked, as a reference noted under two entries joins their components.
    """
    found = components(reference_links(references)).where(F.col("node").startswith("n"))
    spelling = F.expr("substring(node, 2)")
    names = written(found.select("component", spelling.alias("name")).withColumn("entry", entry_of(F.col("name"))))
    other = names.select("component", "entry", F.col("name").alias("annotation_id_b"))
    return (
        names.withColumnRenamed("name", "annotation_id_a")
        .join(other, ["component", "entry"])
        .where("annotation_id_a < annotation_id_b")
        .select("annotation_id_a", "annotation_id_b")
    )


def reference_splits(references: DataFrame, labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(ref, band, component, split) of every reference; targets hold (split_name, share), a few rows."""
    nodes = components(reference_links(references)).where(F.col("node").startswith("r"))
    band = (
        labels.where(F.col("id").isNotNull() & F.col("jaccard_group").isNotNull())
        .groupBy("id")
        .agg(F.min(F.lower(F.trim("jaccard_group"))).alias("band"))
    )
    refs = written(
        nodes.withColumn("ref", F.expr("substring(node, 2)"))
        .join(band, F.col("ref") == band["id"], "left")
        .select("ref", "component", F.coalesce("band", F.lit("none")).alias("band"))
    )
    # a component's stratum is the band with most of its references
    per = refs.groupBy("component", "band").agg(F.count(F.lit(1)).alias("n"))
    sized = written(per.groupBy("component").agg(F.sum("n").alias("size"), F.max(F.struct("n", "band")).alias("m")).select("component", F.col("m.band").alias("band"), "size"))
    asked = targets.where("split_name is not null and share > 0").select("split_name", "share").limit(PLACES + 1).collect()
    if len(asked) > PLACES:
        raise ValueError(f"over {PLACES} splits")
    shares = {r["split_name"]: float(r["share"]) for r in asked}
    units = sized.select(F.col("component").alias("unit"), F.col("band").alias("stratum"), "size")
    chosen = deal(units, shares).select(F.col("unit").alias("component"), F.col("name").alias("split"))
    chosen = written(chosen.join(sized.select("component", "size"), "component"))
    return attach(refs, chosen, ["component"], "size").select("ref", "band", "component", "split")
