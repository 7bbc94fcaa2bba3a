"""Sets of concepts as bitmaps: one row for each 64 places that a set touches, so that union, difference and size go by words and not by members."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrove.operators.ranks import numbered
from lexgrove.operators.work import written

WORD = 64


def node_places(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(family, object_id, place, word, bit): each usable node's place in its family, dealt so that children of a parent lie together."""
    home = edge.groupBy("family", F.col("child").alias("object_id")).agg(F.min("parent").alias("home"))
    rows = node.where("usable").select("family", "object_id").distinct().join(home, ["family", "object_id"], "left").fillna("", ["home"])
    placed = numbered(rows, ["home", "object_id"], ["family"], "place")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % WORD).cast("int"))
    return placed.select("family", "object_id", "place", F.floor(F.col("place") / WORD).cast("long").alias("word"), bit.alias("bit"))


def set_words(members: DataFrame, places: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(keys, word, bits) of sets given by their members; combined before they are shuffled."""
    at = places.withColumnRenamed("object_id", member)
    return members.join(at, ["family", member]).groupBy(*keys, "word").agg(F.bit_or("bit").alias("bits"))


def closure_words(closed: DataFrame, places: DataFrame) -> DataFrame:
    """(family, anc, word, bits): every closure as words, from its pairs."""
    return set_words(closed.select("family", "anc", "desc"), places, ["family", "anc"], "desc")


def closure_by_words(edge: DataFrame, places: DataFrame) -> DataFrame:
    """(family, anc, word, bits): every closure, built without pairs.

    Semi-naive as the closure of pairs: a round hands the words that are new to a node up to its parents, and keeps
    the bits that these did not have. A round's words are written, and rounds end when none is new, which on a cycle
    is when its nodes hold each other.
    """
    up = edge.select("family", F.col("child").alias("anc"), "parent")
    own = places.select("family", F.col("object_id").alias("child"), "word", "bit")
    first = edge.join(own, ["family", "child"]).groupBy("family", F.col("parent").alias("anc"), "word").agg(F.bit_or("bit").alias("bits"))
    level = seen = written(first, "words")
    while not level.isEmpty():
        found = level.join(up, ["family", "anc"]).groupBy("family", F.col("parent").alias("anc"), "word").agg(F.bit_or("bits").alias("got"))
        had = seen.select("family", "anc", "word", F.col("bits").alias("had"))
        fresh = F.col("got").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
        level = written(found.join(had, ["family", "anc", "word"], "left").select("family", "anc", "word", fresh.alias("bits")).where("bits <> 0"), "words")
        seen = written(seen.unionByName(level).groupBy("family", "anc", "word").agg(F.bit_or("bits").alias("bits")), "words")
    return seen


def size_of(bits: Column) -> Column:
    """Members that words hold, summed over a group."""
    return F.coalesce(F.sum(F.bit_count(bits).cast("long")), F.lit(0).cast("long"))


def weight_planes(places: DataFrame, weights: DataFrame) -> tuple[DataFrame, int]:
    """(family, word, w0, w1, ...) and their number: the places of each word whose node's weight has binary digit 0, 1, ...

    ``weights`` (family, object_id, weight): how many nodes a place stands for.
    """
    digits = int(weights.agg(F.max("weight")).first()[0] or 1).bit_length()
    rows = places.join(weights, ["family", "object_id"])
    has = lambda j: F.shiftright("weight", j).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.groupBy("family", "word").agg(*(F.bit_or(F.when(has(j), F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{j}") for j in range(digits))), digits


def weight_of(bits: Column, digits: int) -> Column:
    """As ``size_of``, each member by its weight; rows have the words' planes."""
    each = [F.bit_count(bits.bitwiseAND(F.col(f"w{j}"))).cast("long") * F.lit(1 << j).cast("long") for j in range(digits)]
    return F.coalesce(F.sum(functools.reduce(lambda a, b: a + b, each)), F.lit(0).cast("long"))


def without(bits: Column, removed: Column) -> Column:
    return bits.bitwiseAND(F.bitwise_not(F.coalesce(removed, F.lit(0).cast("long"))))


def sibling_sizes(heads: DataFrame, edge: DataFrame, children: DataFrame, words: DataFrame, places: DataFrame, planes: DataFrame, digits: int) -> DataFrame:
    """(family, object_id, near): how many nodes the siblings (family, parent, child) of each head and what lies under them are, without the head and its own.

    Heads and places stand for kinds of nodes, ``planes`` tell how many: of a head's kind only the head is left out.
    """
    me = places.select("family", "object_id", "word", F.col("bit").alias("me"))
    rows = sibling_words(heads, edge, children, words, places, itself=True).join(me, ["family", "object_id", "word"], "left")
    itself = F.coalesce(F.sum(F.bit_count(F.col("bits").bitwiseAND(F.col("me"))).cast("long")), F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(planes), ["family", "word"])
    return rows.groupBy("family", "object_id").agg((weight_of(F.col("bits"), digits) - itself).alias("near")).where("near > 0")


def sibling_words(heads: DataFrame, edge: DataFrame, children: DataFrame, words: DataFrame, places: DataFrame, itself: bool = False) -> DataFrame:
    """(family, object_id, word, bits): of each head (family, object_id) the siblings with descendants and all those, without the head (unless ``itself``) and its own.

    What lies under a parent's children is put together once for the parent: as a head's own part is taken off again, it
    need not be left out before, and no two siblings ever meet.
    """
    asked = heads.select("family", "object_id").distinct()
    up = edge.select("family", "parent", F.col("child").alias("object_id")).join(asked, ["family", "object_id"], "left_semi").distinct()
    kids = children.select("family", "parent", "child").join(up.select("family", "parent").distinct(), ["family", "parent"], "left_semi")
    below = kids.join(words.withColumnRenamed("anc", "child"), ["family", "child"]).select("family", "parent", "word", "bits")
    self_ = kids.join(places.withColumnRenamed("object_id", "child"), ["family", "child"]).select("family", "parent", "word", F.col("bit").alias("bits"))
    parts = written(below.unionByName(self_).groupBy("family", "parent", "word").agg(F.bit_or("bits").alias("bits")), "parts")
    all_ = up.join(parts, ["family", "parent"]).groupBy("family", "object_id", "word").agg(F.bit_or("bits").alias("bits"))
    own = asked.join(words.select("family", F.col("anc").alias("object_id"), "word", "bits"), ["family", "object_id"])
    if not itself:
        own = own.unionByName(asked.join(places, ["family", "object_id"]).select("family", "object_id", "word", F.col("bit").alias("bits")))
    own = own.groupBy("family", "object_id", "word").agg(F.bit_or("bits").alias("own"))
    left = all_.join(own, ["family", "object_id", "word"], "left")
    return left.select("family", "object_id", "word", without(F.col("bits"), F.col("own")).alias("bits")).where("bits <> 0")
