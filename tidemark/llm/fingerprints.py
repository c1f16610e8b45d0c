"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch holds every 48-bit hash of a text's word shingles that lies below a fixed fraction of the
hash range, and always the least one, so that no text with words has an empty sketch. Sketches of
two texts under one fraction can be merged by union and compared however unequal the texts are: the
share of a sketch that lies in another estimates the containment of the text's shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import SPACES, cut, shuffle_partitions, text_or_empty

WORDS = 5
FRACTION = 0.25
BITS = 48


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """48-bit hashes of the runs of ``words`` words; a shorter text is one run, one without words has none."""

    def of(w: Column) -> Column:
        def one(i: Column) -> Column:
            return F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + k) for k in range(words)]), 64 - BITS)

        whole = F.shiftrightunsigned(F.xxhash64(F.array_join(w, " "), F.lit("short")), 64 - BITS)
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(0), F.size(w) - words), one)).when(F.size(w) > 0, F.array(whole)).otherwise(none)

    return _let(F.filter(F.split(text, SPACES), lambda x: x != ""), of)


def sketch(text: Column, words: int = WORDS, fraction: float = FRACTION) -> Column:
    """Ascending distinct hashes below the fraction of the range, and the least of all."""
    top = int(fraction * (1 << BITS))

    def of(h: Column) -> Column:
        return F.when(F.size(h) == 0, h).otherwise(F.array_sort(F.array_union(F.filter(h, lambda x: x < top), F.array(F.array_min(h)))))

    return _let(shingle_hashes(text, words), of)


def merged(a: Column, b: Column) -> Column:
    """Sketch of two texts' shingles together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 when a has none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 when both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def as_string(s: Column) -> Column:
    """A sketch as hexadecimal digits, twelve for each hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def neighbours(keys: DataFrame) -> DataFrame:
    """For distinct keys(doc_id, id, print, n_chars) by descending doc_id, then print, in a ring: next and previous key.

    The keys are dealt by range and each range is numbered by itself; only the two ends of every
    range, as many rows as there are partitions, meet on the driver.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("print").asc()]
    ranged = cut(keys.repartitionByRange(shuffle_partitions(keys), *order).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy(*order)
    me = F.struct("id", "print", "n_chars")
    linked = ranged.withColumns({"next": F.lead(me).over(w), "prev": F.lag(me).over(w), "me": me})
    ends = sorted(linked.where("next is null or prev is null").select("part", "next", "prev", "me").collect(), key=lambda r: r["part"])
    firsts = [r for r in ends if r["prev"] is None]
    lasts = [r for r in ends if r["next"] is None]
    joins = [(a["part"], firsts[(i + 1) % len(firsts)]["me"], lasts[i - 1]["me"]) for i, a in enumerate(firsts)]
    kind = linked.schema["me"].dataType.simpleString()
    joins = keys.sparkSession.createDataFrame(joins, f"part int, first_next {kind}, last_prev {kind}")
    return linked.join(F.broadcast(joins), "part").select(
        "doc_id", "id", "print", F.coalesce("next", "first_next").alias("next"), F.coalesce("prev", "last_prev").alias("prev")
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Sketches of each text and of its edited text, with their likeness.

    Edited: the last floor(n_chars / 3) code points replaced by as many first ones (or all) of the
    next document by descending doc_id, rows without doc_id last; after the last comes the first. A
    null text counts as empty. Rows of one doc_id with different texts follow each other by a hash of the text; equal
    rows are one document there and give equal results. Texts are read whole, however long. Empty table: empty result.
    Other columns are ignored, whatever their names.
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    # Rows without doc_id have key 0 and another print, so that plain equality joins them.
    some = F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("print", F.xxhash64("text", F.col("doc_id").isNull())).withColumn("id", some)
    links = neighbours(texts.select("doc_id", "id", "print", F.length("text").alias("n_chars")).distinct())
    right = links.select("doc_id", "id", "print", F.col("prev.id").alias("prev_id"), F.col("prev.print").alias("prev_print"), F.floor(F.col("prev.n_chars") / 3).cast("int").alias("need"))
    # Both uses below read the same columns of the texts, so that their one shuffle serves both.
    linked = texts.drop("doc_id").join(right, ["id", "print"])
    # What each document gives to the one before it. Repeated rows give it once.
    given = linked.dropDuplicates(["id", "print"]).select(F.col("prev_id").alias("id"), F.col("prev_print").alias("print"), F.left("text", F.col("need")).alias("head"), sketch(F.col("text")).alias("next_sketch"))
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 3).cast("int")), F.col("head"))
    return (
        linked.select("id", "print", "doc_id", "text")
        .join(given, ["id", "print"])
        .select("doc_id", "text", "next_sketch", edited.alias("edited"))
        .select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            sketch(F.col("text")).alias("own"),
            sketch(F.col("edited")).alias("changed"),
            "next_sketch",
        )
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_string(F.col("own")).alias("fingerprint"),
            as_string(F.col("changed")).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col("changed")).alias("near_edited"),
            likeness(F.col("own"), F.col("next_sketch")).alias("near_next"),
        )
    )
