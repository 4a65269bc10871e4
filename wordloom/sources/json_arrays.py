"""JSON arrays of any size, split over many tasks.

An array cannot be cut at line ends: whether a brace ends a record depends on all quotes before it. The files are
read as text between closing braces, in byte ranges like any other text, so a large file is many tasks. Each
range then says what it does to the reader's state, for either state it may begin in: whether it ends inside a string,
and by how much it changes the depth of braces. A running sum over the ranges of a file, a few numbers each, gives
every range its true start, and with that the records' ends; the pieces of a record meet by its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

_CORRUPT = "_corrupt"


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, size, range, at, piece: the text between closing braces, in order of ``at`` within a range."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"),
    )


def _effects(pieces: DataFrame) -> DataFrame:
    """Adds what a piece does: ``odd`` (quotes), and the braces it opens if it begins outside or inside a string."""
    plain = F.regexp_replace("piece", r"(?s)\\.", "")  # an escaped character says nothing
    parts = F.split(plain, '"')
    outside = F.array_join(F.filter("parts", lambda _, i: i % 2 == 0), "")
    inside = F.array_join(F.filter("parts", lambda _, i: i % 2 == 1), "")
    return pieces.withColumn("parts", parts).withColumns({
        "odd": (F.size("parts") - 1) % 2, "opens_0": _count(outside, "{"), "opens_1": _count(inside, "{"),
    }).drop("parts")


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """file, number, record, whole, utf8: the text of each record of the JSON arrays at ``path``.

    ``whole``: whether the record is closed and stands where one may stand; of a file that breaks off, only the
    last record is not. ``utf8``: whether its bytes are. Records may hold objects, and any character in strings.
    """
    within = Window.partitionBy("file", "range").orderBy("at")
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = _effects(_pieces(spark, path))
    # Whether the last piece of a file is followed by a brace as well: then lengths add up to the file's size.
    sizes = rows.groupBy(F.col("file").alias("of"), "size").agg(
        F.sum(F.octet_length("piece") + 1).alias("n"), F.max("range").alias("last_range")
    ).select("of", (F.col("n") == F.col("size")).alias("closed"), "last_range")
    rows = rows.join(sizes, F.col("file") == F.col("of")).drop("of")
    last = F.lead("at").over(within).isNull() & (F.col("range") == F.col("last_range"))
    rows = rows.withColumns({
        "met": F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2,
        "braced": (~last | F.col("closed")).cast("int"),
    })
    for start in (0, 1):
        at_start = (F.col("met") + start) % 2
        opens = F.when(at_start == 0, F.col("opens_0")).otherwise(F.col("opens_1"))
        closes = F.when((at_start + F.col("odd")) % 2 == 0, F.col("braced")).otherwise(F.lit(0))
        rows = rows.withColumns({f"closes_{start}": closes, f"change_{start}": opens - closes})
        rows = rows.withColumn(f"depth_{start}", F.sum(f"change_{start}").over(so_far))
    # One row per range: the state it begins in.
    ranges = rows.groupBy("file", "range").agg(
        F.sum("odd").alias("odd"), F.sum("change_0").alias("c0"), F.sum("change_1").alias("c1")
    )
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("inside") == 0, F.col("c0")).otherwise(F.col("c1"))
    ranges = ranges.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    met = rows.join(ranges.select("file", "range", "inside", "depth"), ["file", "range"])
    outside = F.col("inside") == 0
    depth = F.col("depth") + F.when(outside, F.col("depth_0")).otherwise(F.col("depth_1"))
    closes = F.when(outside, F.col("closes_0")).otherwise(F.col("closes_1"))
    met = met.withColumn("ends", ((depth <= 0) & (closes == 1)).cast("int"))
    counts = met.groupBy("file", "range").agg(F.sum("ends").alias("n"))
    counts = counts.select("file", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    numbered = met.join(counts, ["file", "range"]).withColumn(
        "number", F.col("first") + F.coalesce(F.sum("ends").over(before), F.lit(0))
    )
    order = F.struct("range", "at", "piece", "braced", "ends")
    records = numbered.groupBy("file", "number").agg(F.sort_array(F.collect_list(order)).alias("all"))
    braces = F.array_join(F.transform("all", lambda p: F.concat(p["piece"], F.repeat(F.lit("}"), p["braced"]))), "")
    text = records.select("file", "number", braces.alias("text"), F.element_at("all", -1)["ends"].alias("ends"))
    lead = F.when(F.col("number") == 0, F.lit(r"^\s*\[\s*")).otherwise(F.lit(r"^\s*,\s*"))
    stands = F.col("text").rlike(r"^\s*[\[,]\s*\{") & (F.regexp_extract("text", r"^\s*([\[,])", 1) == F.when(F.col("number") == 0, "[").otherwise(","))
    # What follows the last record, or stands for none.
    closing = (F.col("ends") == 0) & F.when(F.col("number") == 0, F.col("text").rlike(r"^\s*\[\s*\]\s*$")).otherwise(
        F.col("text").rlike(r"^\s*\]\s*$")
    )
    return text.where(~closing).select(
        "file", "number",
        F.when(stands, F.regexp_replace("text", lead, F.lit(""))).otherwise(F.col("text")).alias("record"),
        (stands & (F.col("ends") == 1)).alias("whole"),
        F.is_valid_utf8("text").alias("utf8"),
    )


def parse_records(records: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of ``json_array_records``: records by ``schema``, and file, number, reject_reason, record."""
    with_corrupt = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    parsed = F.from_json("record", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    found = records.withColumn("r", F.when(F.col("utf8") & F.col("whole"), parsed))
    bad = F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull()
    rejects = found.where(bad).select(
        "file", "number", F.when(F.col("utf8"), F.lit("malformed JSON")).otherwise(F.lit("not UTF-8")).alias("reject_reason"), "record"
    )
    return found.where(~bad).select(*[F.col(f"r.{n}").alias(n) for n in schema.names]), rejects
