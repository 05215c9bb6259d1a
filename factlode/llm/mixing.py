"""Mixing sources to target weights: every document is repeated at the rate of its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factlode.llm.rows import staged

WORD = r"[^\x20\x09-\x0D]+"
#: A per-source table of up to this many rows may be sent to every executor (names of up to a kilobyte or so: some tens of megabytes).
MOST_BROADCAST = 50_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Words of a text; none in a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(identity: Column, source: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and on what the document says of itself, not on where its row lies: 52 bits of a hash."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (identity, source)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts, F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, the null source last: numbers run on over sorted slices, so no task sees them all."""
    sliced = staged(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("slice", F.spark_partition_id()), "source-slices")
    sizes = {r["slice"]: r["n"] for r in sliced.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets += [F.lit(k), F.lit(before)]
        before += sizes[k]
    if not offsets:
        return sliced.withColumn("number", F.lit(0).cast("long")).drop("slice")
    place = F.row_number().over(Window.partitionBy("slice").orderBy(F.col("source").asc_nulls_last())) - 1
    return sliced.withColumn("number", (place + F.element_at(F.create_map(*offsets), F.col("slice"))).cast("long")).drop("slice")


def source_targets(sized: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target, rate: one row for each source of `sized` (source, size).

    Sources by code point, the null one last, weigh `weights` in turn and share `share` times all sizes by weight. A target stops at `most`
    times the size of its source; what it leaves is shared again by weight among those below, until none is above. That end is the level
    at which min(most * size, weight * level) adds up to the whole; it is found from below, each round with one sum over the sources that
    still lie under it, so only a few numbers reach the driver. A source without words has the target and the rate 0.
    """
    sums = staged(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "source-sizes")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    known = staged(_ranked(sums).withColumn("weight", turn).drop("number"), "source-weights")
    whole = share * (known.agg(F.sum("source_size")).first()[0] or 0)
    stop, level = F.lit(float(most)) * F.col("source_size"), 0.0
    below = F.lit(True)
    while True:
        weight, stopped = known.agg(
            F.sum(F.when(below, F.col("weight"))), F.sum(F.when(~below, stop))).first()
        if not weight or (found := (whole - (stopped or 0.0)) / weight) <= level:
            break
        level, below = found, F.col("weight") * F.lit(found) <= stop
    target = F.least(stop, F.col("weight") * F.lit(float(level)))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), target / F.col("source_size"))).otherwise(F.lit(0.0))
    return known.withColumns({"target": target, "rate": rate})


def _with_rates(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with the columns of their source. Up to MOST_BROADCAST sources are sent to the rows; more of them meet rows that are dealt by
    source and a salt, so that one source can hold any share of the rows."""
    if targets.count() <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(targets.withColumnRenamed("source", "_of")), F.col("source").eqNullSafe(F.col("_of")), "left")
        return joined.drop("_of")
    spread = targets.withColumnRenamed("source", "_of").withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("draw"), F.lit(SALTS)).cast("int"))
    met = F.col("source").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_salt_of"))
    return dealt.join(spread, met, "left").drop("_of", "_salt", "_salt_of")


def _copies(rows: DataFrame) -> DataFrame:
    whole = F.floor("rate")
    return rows.withColumn("copies", (whole + (F.col("draw") < F.col("rate") - whole).cast("int")).cast("int"))


def mix_counts(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0,
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, rate, copies: one row for each row of `docs`.

    size counts words, target is that of the source (see source_targets), and copies is the whole part of the rate target / source_size,
    plus one with the probability of its fraction, drawn from a hash of the seed and the row's id, source and text. taken = copies * size.
    A null text has the size 0; null sources are a source of their own; rows that repeat id, source and text are drawn alike; an empty
    table gives none. Further columns are left out. Texts are read once: sizes and draws are staged as narrow rows.
    """
    text = F.col(text_column).cast("string")
    narrow = staged(docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), word_count(text).alias("size"),
        draw(F.col(id_column), F.col(source_column), text, seed).alias("draw"),
    ), "mix-sizes")
    counted = _copies(_with_rates(narrow, source_targets(narrow, weights, share, most)))
    return counted.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def mix_documents(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 0, copy_column: str = "copy",
    id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
) -> DataFrame:
    """The mix itself: rows of `docs` with all their columns, as often as mix_counts says, numbered from 0 in `copy_column`.

    Columns of `docs` may have any names but `copy_column`: they travel in one struct.
    """
    if copy_column in docs.columns:
        raise ValueError(f"the table has a column {copy_column}; name another one")
    text = F.col(text_column).cast("string")
    drawn = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_column).cast("string").alias("source"),
        draw(F.col(id_column), F.col(source_column), text, seed).alias("draw"))
    sized = docs.select(F.col(source_column).cast("string").alias("source"), word_count(text).alias("size"))
    taken = _copies(_with_rates(drawn, source_targets(sized, weights, share, most))).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias(copy_column)).select("row.*", copy_column)
