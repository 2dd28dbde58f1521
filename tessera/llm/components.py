"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Every step is a few joins of narrow rows. A node that a third of all edges hold is dealt out by a salt: minima by node and
salt, then by node, then back to the salts (`with_least`), so no task gets a whole node. The lineage is cut after each
round with a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Rounds after which the search is given up as wrong; the method needs a logarithm of the longest chain.
MOST_ROUNDS = 60
#: Parts that the rows of one key are dealt to.
SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, name: str, by: str) -> DataFrame:
    """The rows with the least value of their key as another column; rows of one key stay apart by a hash of column `by`.

    Nulls are no least value unless there are no others. Rows with a null key are left out. The column `_salt` is ours.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(F.min(value).alias(name))
    whole = parts.groupBy(key).agg(F.min(name).alias(name))
    return salted.join(parts.select(key, "_salt").join(whole, key), [key, "_salt"]).drop("_salt")


def met(rows: DataFrame, one: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of rows with a table of one row a key (not null); rows of one key stay apart by a hash of column `by`.

    Only keys and salts that rows have are joined with the table first, so a key without many rows is sent once.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.select(key, "_salt").distinct().join(one, key)
    return salted.join(parts, [key, "_salt"]).drop("_salt")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: large links each node's larger neighbours to its least one, small links the smaller ones and itself."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = with_least(both, "u", "v", "m", by="v").withColumn("m", F.least("m", "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for each node that has an edge; component is the least node that can be reached.

    edges has columns u and v of one orderable type. Repeated edges, loops and both directions may occur; rows with a
    null end are left out. Nodes with only loops do not appear. No edges give no rows.
    """
    now = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        now = cut(_star(_star(now, large=True), large=False).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        n, total = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (n, total) == seen:
            break
        seen = (n, total)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
