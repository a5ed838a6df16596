"""Substring joins through an inverted index of short pieces of the texts, with every hit verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a piece; shorter keys are pieces themselves.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """The different pieces of `size` code points."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.substring(text, k, size)))


def contained(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """From keys(key) and texts(text) the different pairs (key, text) where the text contains the key.

    A text is indexed under its pieces of 1 to GRAM code points, so with rows in proportion to its length. All pieces of a key
    are in every text that contains it, so a key is looked up by its rarest piece alone, and not at all if one is in no text.
    Null and empty keys and texts have no pairs.
    """
    keys, texts = keys.select("key").filter("key <> ''").distinct(), texts.select("text").filter("text <> ''").distinct()
    sizes = F.filter(F.array(*(F.lit(n) for n in range(1, GRAM + 1))), lambda n: n <= F.length("text"))
    index = texts.select("text", F.explode(F.flatten(F.transform(sizes, lambda n: _grams(F.col("text"), n)))).alias("gram"))
    rarity = index.groupBy("gram").agg(F.count("*").alias("n"))
    pieces = keys.select("key", F.explode(_grams(F.col("key"), F.least(F.length("key"), F.lit(GRAM)))).alias("gram"))
    known = pieces.join(rarity, "gram", "left").groupBy("key").agg(F.min(F.struct("n", "gram")).alias("rarest"), F.count_if(F.col("n").isNull()).alias("missing"))
    asked = known.filter("missing = 0").select("key", F.col("rarest.gram").alias("gram"))
    return asked.join(index, "gram").filter(F.contains("text", "key")).select("key", "text")


def either_way(left: DataFrame, right: DataFrame) -> DataFrame:
    """From left(a) and right(b) the different pairs (a, b) of which one contains the other."""
    a_in_b = contained(left.select(F.col("a").alias("key")), right.select(F.col("b").alias("text")))
    b_in_a = contained(right.select(F.col("b").alias("key")), left.select(F.col("a").alias("text")))
    return a_in_b.select(F.col("key").alias("a"), F.col("text").alias("b")).union(b_in_a.select(F.col("text").alias("a"), F.col("key").alias("b"))).distinct()


def resolve(names: DataFrame, known: DataFrame) -> DataFrame:
    """names(name) by the keys of known(key): (name, key, how), the key that is equal, or else the first in order of those
    that contain the name or that it contains. Names without a key are left out."""
    names, known = names.select("name").filter("name <> ''").distinct(), known.select("key").filter("key <> ''").distinct()
    equal = names.join(known, F.col("name") == F.col("key")).select("name", "key", F.lit("equal").alias("how"))
    rest = names.join(equal.select("name"), "name", "left_anti")
    near = either_way(rest.select(F.col("name").alias("a")), known.select(F.col("key").alias("b")))
    return equal.unionByName(near.groupBy(F.col("a").alias("name")).agg(F.min("b").alias("key")).withColumn("how", F.lit("part")))


def candidates(asked: DataFrame, index: DataFrame, releases: DataFrame) -> DataFrame:
    """asked(q, key) -> (q, node_id, kind): the nodes of index(key, node_id, kind) under the key, of the kind that comes first
    (pkg, artifact, prefix, others by name); for keys the index doesn't know, the nodes of releases(node_id, release) whose
    release contains the key, as kind `substring`."""
    order = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (("pkg", 0), ("artifact", 1), ("prefix", 2)) for x in kv)), F.col("kind")), F.lit(3))
    found = asked.join(index, "key").withColumn("place", F.struct(order, "kind"))
    best = found.groupBy("q").agg(F.min("place").alias("place"))
    sure = found.join(best, ["q", "place"]).select("q", "node_id", "kind").distinct()
    rest = asked.join(best.select("q"), "q", "left_anti")
    inside = contained(rest.select("key"), releases.select(F.col("release").alias("text")))
    parts = rest.join(inside, "key").join(releases.select("node_id", F.col("release").alias("text")), "text").select("q", "node_id", F.lit("substring").alias("kind"))
    return sure.unionByName(parts.distinct())
