"""Mixing sources to target weights by a low-discrepancy source schedule.

Every source's documents are laid out in a shuffled order and cut into blocks of equal word count.
A schedule of slots is the golden-ratio sequence (multiples of the ratio, modulo one) mapped through
the cumulative slot shares of the sources: any stretch of it holds each source close to its share.
The slots of a source are ranked, and rank j takes block j of the source, from the first block again
after the last. The slot that reaches the target is cut at the target, so that a source gives exactly
the whole part of its target.

Ranks and running word counts have two levels, a running sum over parts and one inside a part, with
about as many parts as rows in a part. No source, however large, meets in one task.

Nulls and ties: a null text has size 0, a null source is a source of its own (last), a null doc_id is
carried through. Repeated rows are separate documents with separate places; where one doc_id comes
with several sizes the smaller has the earlier place. Documents without a word are returned with
``taken`` 0. An empty table gives no rows. Other columns are ignored or, by ``mixed_texts``, passed through whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.text import WORD, cut_lineage, hash_parts, word_count

# Odd multiplier of the golden-ratio sequence modulo 2**31 (2**31 / 1.618...), in integers so that
# every engine gives the same points. After 2**31 slots the sequence starts again, equally even.
GOLDEN, CIRCLE = 1327217885, 1 << 31
CELLS = 4096
BLOCK_WORDS = 256


def document_sizes(documents: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, source, size; the texts are read here and nowhere else."""
    number = F.col(row) if row else F.lit(None).cast("long")
    return documents.select(number.alias("row"), "doc_id", "source", word_count("text").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_no, source_size, target.

    Sources in code-point order, null last, get ``weights`` in turn; ``share`` times all sizes is dealt
    by weight. A target stops at ``most`` times its source; what is over goes to the others by weight.
    With the sources ordered by cap per weight, those that stop come first, so one pass over running
    sums finds the common level of the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").isNull(), "source")
    cap = F.col("source_size") * most
    per = per.withColumn("source_no", F.row_number().over(place) - 1)
    which = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1)
    per = per.withColumn("weight", which).withColumn("cap", cap.cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, on = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("goal", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on))
        .withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    rest = (F.col("goal") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(every), F.lit(0.0))) / F.sum(
        F.when(~F.col("stops"), F.col("weight"))
    ).over(every)
    return per.withColumn("rest", rest).select(
        "source", "source_no", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("rest") * F.col("weight")).alias("target")
    )


def with_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds take (whole words of the target), blocks of the source and slots needed to take them."""
    left = F.col("take") % F.greatest("source_size", F.lit(1))
    return (
        targets.withColumn("take", F.floor("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn(
            "slots",
            F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size")) * F.col("blocks") + F.ceil(left / block_words))
            .otherwise(0)
            .cast("long"),
        )
    )


def _running(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over the rows of ``group`` before this one; needs a column ``part`` that leads the order."""
    inside = Window.partitionBy(*group, "part")
    sums = df.groupBy(*group, "part").agg(F.sum(value).alias("_all"))
    over = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_all").over(over), F.lit(0))).drop("_all")
    here = F.coalesce(F.sum(value).over(inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_here", here).join(sums, [*group, "part"]).withColumn(name, F.col("_before") + F.col("_here")).drop("_before", "_here", "part")


def document_places(sizes: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """doc_id, size, source_no, source_size, target, place: words of its source that come before, in shuffled order."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = sources.select("source_no", "source_size", "target", F.col("source").alias("_source"))
    placed = (
        sizes.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .select("row", "doc_id", "size", "source_no", "source_size", "target", key.alias("key"))
        .withColumn("part", F.conv(F.substring("key", 1, 7), 16, 10).cast("long") % hash_parts(rows))
    )
    return _running(placed, ["source_no"], ["key", "doc_id", "size"], F.col("size"), "place").drop("key")


def slot_schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, source_no, rank: the golden-ratio schedule of ``slots`` slots.

    Rounding leaves a few sources a slot over or short of their need; a slot over its source's need
    is dropped, and missing ranks follow at the end.
    """
    spark = sources.sparkSession
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("slots").over(before), F.lit(0))
    ranges = (
        sources.filter("slots > 0")
        .select("source_no", "slots", upto.alias("low"))
        .withColumn("high", (F.col("low") + F.col("slots")) / slots)
        .withColumn("low", F.col("low") / slots)
    )
    point = ((F.col("id") % CIRCLE) * GOLDEN % CIRCLE) / F.lit(float(CIRCLE))
    # Sources and points meet by the cell of the circle they lie in: an equi-join, not a range join.
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.col("high") * CELLS))))
    drawn = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), point.alias("point"))
        .withColumn("cell", F.floor(F.col("point") * CELLS))
        .join(cells, "cell")
        .filter("low <= point and point < high")
        .select("slot", "source_no", (F.col("slot") / hash_parts(slots)).cast("long").alias("part"))
    )
    ranked = _running(drawn, ["source_no"], [F.col("slot")], F.lit(1), "rank")
    found = ranked.groupBy("source_no").agg(F.count("*").alias("found"))
    short = (
        sources.filter("slots > 0")
        .join(found, "source_no", "left")
        .withColumn("found", F.coalesce("found", F.lit(0)))
        .filter("found < slots")
        .select("source_no", F.explode(F.sequence(F.col("found"), F.col("slots") - 1)).alias("rank"))
        .select((F.lit(slots) + F.col("rank")).alias("slot"), "source_no", "rank")
    )
    need = sources.select("source_no", "slots")
    return ranked.join(need, "source_no").filter("rank < slots").select("slot", "source_no", "rank").unionByName(short)


def mix(
    documents: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, row: str | None = None
) -> DataFrame:
    """The mix as pieces of documents: slot, row (the column so named, if any), doc_id, size, source_no, source_size, target, place, first, words.

    ``first`` is the first word of the document in this slot (from 0), ``words`` how many follow each
    other. A document that no slot takes has one row with a null slot and 0 words.
    """
    sizes = cut_lineage(document_sizes(documents, row))
    sources = cut_lineage(with_blocks(source_targets(sizes, weights, share, most), block_words))
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()
    rows = sizes.count()
    placed = document_places(sizes, sources, rows)
    if not total.slots:
        return placed.select(
            F.lit(None).cast("long").alias("slot"), "row", "doc_id", "size", "source_no", "source_size", "target", "place",
            F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("words"),
        )
    last = F.floor((F.col("place") + F.col("size") - 1) / block_words)
    # A document without a word lies in no block and keeps its row.
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("place") / block_words), last))
    pieces = placed.withColumn("block", F.explode_outer(blocks))
    start = F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") + F.col("block") * block_words
    slots = (
        slot_schedule(sources, total.slots)
        .join(sources.select("source_no", "blocks", "source_size", "take"), "source_no")
        .withColumn("block", F.col("rank") % F.col("blocks"))
        .withColumn("end", F.col("block") * block_words + F.least(F.lit(block_words), F.col("take") - start))
        .select("slot", "source_no", "block", "end")
    )
    first = F.greatest(F.coalesce(F.col("block"), F.lit(0)) * block_words - F.col("place"), F.lit(0))
    until = F.least(F.col("size"), F.coalesce("end", F.lit(0)) - F.col("place"), (F.col("block") + 1) * block_words - F.col("place"))
    return (
        pieces.join(slots, ["source_no", "block"], "left")
        .withColumn("first", first)
        .withColumn("words", F.greatest(until - first, F.lit(0)))
        .select("slot", "row", "doc_id", "size", "source_no", "source_size", "target", "place", "first", "words")
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """row, doc_id, size, source_size, target, taken: what the mix takes of each document, repeats counted."""
    key = ["source_no", "place", "row", "doc_id", "size", "source_size", "target"]
    pieces = mix(documents, **options)
    # A place names a document with words. Those without share theirs: count them, then list them again.
    found = pieces.groupBy(*key).agg(F.sum("words").cast("long").alias("taken"), F.count("*").alias("rows"))
    again = F.when(F.col("size") == 0, F.sequence(F.lit(1).cast("long"), F.col("rows"))).otherwise(F.array(F.lit(1).cast("long")))
    return found.select("row", "doc_id", "size", "source_size", "target", "taken", F.explode(again).alias("_row")).drop("_row")


def mixed_texts(documents: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with all columns; a document cut by a target's end keeps its first words."""
    numbered = documents.select(F.struct(*documents.columns).alias("_document"), F.monotonically_increasing_id().alias("_row"))
    field = lambda c: F.col("_document").getField(c)
    taken = mixed_documents(numbered.select("_row", *[field(c).alias(c) for c in ("doc_id", "source", "text")]), row="_row", **options)
    taken = taken.filter("taken > 0").select(F.col("row").alias("_row"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_size"))))
    rows = numbered.join(taken.withColumn("_copy", copy), "_row")
    rows = rows.withColumn("_words", F.least(F.col("_size"), F.col("_taken") - F.col("_copy") * F.col("_size")))
    words = F.array_join(F.slice(F.regexp_extract_all(field("text"), F.lit(WORD), F.lit(0)), 1, F.col("_words").cast("int")), " ")
    text = F.when(F.col("_words") < F.col("_size"), words).otherwise(field("text"))
    return rows.select(*[(text if c == "text" else field(c)).alias(c) for c in documents.columns])
