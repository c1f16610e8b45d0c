"""Fill-in-the-middle: texts cut at units and put together in another order, as a relational plan.

A unit is a run of letters or any other single character. The matches of a text are exploded with their positions, running sums over
windows give where each ends, requests for cuts are joined by the ordinal of their unit, and the offsets found are aggregated
for each document, whose text is then taken apart with substring.

Units are exploded on two levels, as a text has a unit for every three or four characters: blocks of BLOCK units first, of
which only the lengths travel, then the units of the blocks that a cut falls into. So the rows are about the square root of the
units, and a text of any length is many short rows. What travels before the texts meet their offsets is one narrow row for each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import row_key, row_print, text_or_empty

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Units of a block.
BLOCK = 32
#: A block of units; possessive, so that nothing is tried twice.
UNITS = f"(?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}}+"
#: Marks of prefix, suffix and middle. Fixed values.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, those that stay plain from this one on; of a hundred others, those below this one in the order suffix, prefix, middle. Fixed values.
PLAIN, SPM = 90, 20


def draws(doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``1:`` and the decimal doc_id (nothing without one)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, doc_id: Column) -> Column:
    """plain, spm or psm."""
    _, _, h3, h4 = draws(doc_id)
    marked = F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1])) | F.contains(text, F.lit(MARKS[2]))
    return F.when((text == "") | marked | (h3 % 100 >= PLAIN), "plain").when(h4 % 100 < SPM, "spm").otherwise("psm")


def units_in(text: Column) -> Column:
    """How many units a text has: each run of letters counts as one character."""
    return F.length(F.regexp_replace(text, "[A-Za-z]+", "x")).cast("long")


def put_together(form: Column, text: Column, prefix_end: Column, middle_end: Column) -> Column:
    """The text in the form's order with its marks; offsets count code points."""
    p, s, m = (F.lit(x) for x in MARKS)
    prefix = F.left(text, prefix_end)
    middle = F.substr(text, prefix_end + 1, middle_end - prefix_end)
    suffix = F.substr(text, middle_end + 1)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(form: Column, output: Column) -> Column:
    """The text again, from the output and its form alone. Parts hold no mark, so each mark is where it first stands."""
    p, s, m = MARKS
    before_middle, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substr(before_middle, F.lit(len(p) + 1)), s, 1), middle, F.substring_index(before_middle, s, -1))
    spm = F.concat(F.substring_index(before_middle, p, -1), middle, F.substring_index(F.substr(before_middle, F.lit(len(s) + 1)), p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def cut_offsets(texts: DataFrame) -> DataFrame:
    """(key, print, first, second): code points before the two cuts of texts(key, print, text, first_units, second_units).

    A cut is a number of units. Rows of one (key, print) have one text and become one row.
    """
    # One narrow row for each text: the lengths of its blocks, and the blocks that hold the last unit before each cut.
    blocks = F.regexp_extract_all(F.col("text"), F.lit(UNITS), F.lit(0))
    inside = texts.select("key", "print", "first_units", "second_units", blocks.alias("blocks"))
    last = [F.floor((F.col(c) - 1) / BLOCK).cast("int") for c in ("first_units", "second_units")]
    one = F.struct(F.transform("blocks", F.length).alias("lengths"), "first_units", "second_units", *[F.get("blocks", b).alias(f"spelled_{i}") for i, b in enumerate(last)])
    heads = inside.groupBy("key", "print").agg(F.first(one).alias("head")).select("key", "print", "head.*")
    # Where each block begins.
    lengths = heads.select("key", "print", F.posexplode("lengths").alias("block", "chars"))
    so_far = Window.partitionBy("key", "print").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = lengths.select("key", "print", "block", F.coalesce(F.sum("chars").over(so_far), F.lit(0)).alias("begins"))
    # Requests name the last unit before a cut; the units of its block, and where each ends in it.
    asked = F.explode(F.array(F.struct(F.lit(0).alias("cut"), (F.col("first_units") - 1).alias("ordinal"), F.col("spelled_0").alias("spelled")), F.struct(F.lit(1).alias("cut"), (F.col("second_units") - 1).alias("ordinal"), F.col("spelled_1").alias("spelled")))).alias("r")
    requests = heads.select("key", "print", asked).select("key", "print", "r.*").where("ordinal >= 0").withColumn("of_block", F.floor(F.col("ordinal") / BLOCK).cast("int"))
    units = requests.select("key", "print", "cut", "ordinal", "of_block", F.posexplode(F.regexp_extract_all(F.col("spelled"), F.lit(UNIT), F.lit(0))).alias("at", "unit"))
    within = Window.partitionBy("key", "print", "cut").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.withColumn("ends", F.sum(F.length("unit")).over(within)).where(F.col("of_block").cast("long") * BLOCK + F.col("at") == F.col("ordinal"))
    # Both sides lie by (key, print) already; the ordinals meet as a condition, so that nothing is dealt out again.
    met = ends.join(placed, ["key", "print"]).where(F.col("block") - F.col("of_block") == 0)
    where = F.col("begins") + F.col("ends")
    found = met.groupBy("key", "print").agg(*[F.max(F.when(F.col("cut") == i, where)).alias(f"at_{i}") for i in (0, 1)])
    return found.select("key", "print", *[F.coalesce(f"at_{i}", F.lit(0)).cast("int").alias(name) for i, name in enumerate(("first", "second"))])


def transformed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text (null: empty), n units, form, prefix_end, middle_end (code points; null if plain), output.

    The cuts of a text lie after two numbers of units drawn from its doc_id, so equal texts of other doc_ids are cut
    elsewhere. A text stays plain if it is empty, holds a mark, or its draw says so. Rows without doc_id draw as the empty
    string would. Rows that repeat are rows of their own with equal results. Empty table: empty result. Other columns are ignored, whatever
    their names.
    """
    h1, h2, *_ = draws(F.col("doc_id"))
    rows = docs.select("doc_id", row_key().alias("key"), row_print().alias("print"), text_or_empty().alias("text")).withColumn("form", form_of(F.col("text"), F.col("doc_id")))
    counted = rows.where("form <> 'plain'").withColumn("n", units_in(F.col("text")))
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    offsets = cut_offsets(counted.select("key", "print", "text", F.least(a, b).alias("first_units"), F.greatest(a, b).alias("second_units")))
    met = rows.where("form <> 'plain'").join(offsets, ["key", "print"], "left")
    # Texts that both cuts leave whole have no request.
    ends = [F.coalesce(c, F.lit(0)) for c in ("first", "second")]
    moved = met.select("doc_id", "text", "form", ends[0].alias("prefix_end"), ends[1].alias("middle_end"))
    none = F.lit(None).cast("int")
    plain = rows.where("form = 'plain'").select("doc_id", "text", "form", none.alias("prefix_end"), none.alias("middle_end"))
    every = moved.unionByName(plain).withColumn("n", units_in(F.col("text")))
    return every.withColumn("output", put_together(F.col("form"), F.col("text"), F.col("prefix_end"), F.col("middle_end")))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of ``transformed``."""
    return transformed(docs).select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_end").cast("long").alias("prefix_chars"),
        (F.col("middle_end") - F.col("prefix_end")).cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
