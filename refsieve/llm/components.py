"""Connected components of links, by rounds of star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refsieve.session import stored


def _larger(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b").distinct()
    )


def _smaller(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these; links lead downwards."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.explode(F.array("a", "b")).alias("x")
    return (
        links.join(least, "a").select(ends, "m").filter("x <> m")
        .select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes that hang on a smaller one; ``links`` has longs ``a`` and ``b``.

    A round's links are written to the shared folder. Rounds end when they change no link, which
    takes about the logarithm of the longest chain.
    """
    mark = [F.count("*"), F.expr("bit_xor(xxhash64(a, b))")]
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = stored(links.filter("a <> b").distinct(), "links")
    seen = links.agg(*mark).first()
    while seen[0]:
        links = stored(_smaller(_larger(links)), "links")
        before, seen = seen, links.agg(*mark).first()
        if seen == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
