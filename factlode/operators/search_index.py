"""Positional search index: one row per chunk with its terms, postings per term, and statistics that add up over segments."""

from __future__ import annotations

import uuid
from copy import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from factlode.functions.relations import let
from factlode.functions.stemming import porter
from factlode.functions.text import document_tokens
from factlode.session import checkpoint_dir

# Column weights of the score.
WEIGHTS = {"section": 2.0, "subsection": 1.0, "text": 5.0}
CHUNK_KEYS = ["cik", "chunk_id", "form", "accession_number", "section"]
#: A place is the number of a column times 2**PART_BITS plus the number of the token in it: neighbours never lie in two columns.
PART_BITS = 27
BUCKETS, SLICES = 64, 16
_CHUNK = "cik string, chunk_id string, form string, accession_number string, section string, length int"
TABLES = {
    "chunks": f"{_CHUNK}, entries array<struct<term: string, places: array<int>>>, bucket int",
    "postings": f"{_CHUNK}, term string, stem string, places array<int>, frequency double, bucket int",
    "replaced": "cik string, chunk_id string",
    "statistics": "kind string, term string, chunk_count long",
}


def weight_at(place: Column) -> Column:
    """Weight of the column that a place lies in."""
    return F.element_at(F.array(*map(F.lit, WEIGHTS.values())), F.shiftright(place, PART_BITS) + 1)


def _grouped(tokens: Column) -> Column:
    """Distinct terms with their places, from an array of (term, place): sorted once, then cut where the term changes."""

    def cut(ordered: Column) -> Column:
        changes = lambda k: (k == 0) | (F.get(ordered, k)["term"] != F.get(ordered, k - 1)["term"])
        none = F.array().cast("array<int>")
        starts = F.when(F.size(ordered) > 0, F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), changes)).otherwise(none)
        return let(starts, lambda s: F.transform(s, lambda first, k: F.struct(
            F.get(ordered, first)["term"].alias("term"),
            F.transform(
                F.slice(ordered, first + 1, F.coalesce(F.get(s, k + 1), F.size(ordered)) - first), lambda t: t["place"]).alias("places"))))

    return let(F.sort_array(tokens), cut)


def _places(column: str, part: int) -> Column:
    """Tokens of one column as (term, place)."""
    place = lambda k: (k + F.lit(part << PART_BITS)).cast("int")
    return F.transform(
        document_tokens(F.coalesce(F.col(column), F.lit(""))), lambda t, k: F.struct(t.alias("term"), place(k).alias("place")))


def forward_index(chunks: DataFrame) -> DataFrame:
    """Chunks with ``length`` (tokens of all indexed columns) and ``entries`` (distinct terms with their places), without a shuffle."""
    placed = [_places(column, part) for part, column in enumerate(WEIGHTS)]
    entries = F.col("entries")
    lengths = F.aggregate(entries, F.lit(0), lambda n, e: n + F.size(e["places"]))
    return chunks.select(*CHUNK_KEYS, _grouped(F.concat(*placed)).alias("entries")).withColumn("length", lengths)


def inverted(forward: DataFrame) -> DataFrame:
    """One row per (chunk, term) with the places, the weighted frequency and the chunk's length.

    The outer form keeps Spark from testing first whether there are entries, which would tokenise every text again for the test.
    """
    weighted = F.aggregate("e.places", F.lit(0.0), lambda n, p: n + weight_at(p))
    return forward.select(*CHUNK_KEYS, "length", F.explode_outer("entries").alias("e")).where("e.term IS NOT NULL").select(
        *CHUNK_KEYS, "length", F.col("e.term").alias("term"), F.col("e.places").alias("places"), weighted.alias("frequency"))


def vocabulary(forward: DataFrame) -> DataFrame:
    """Each distinct term once, with its stem."""
    terms = forward.select(F.explode("entries.term").alias("term")).distinct()
    return terms.withColumn("stem", porter(F.col("term")))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _frequencies(postings: DataFrame) -> DataFrame:
    """kind ('term' or 'stem'), term, chunk_count. A chunk that holds several forms of a stem counts once."""
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("chunk_count")).select(F.lit("term").alias("kind"), "term", "chunk_count")
    stems = postings.select("stem", "cik", "chunk_id").distinct().groupBy("stem").agg(F.count(F.lit(1)).alias("chunk_count"))
    return terms.unionByName(stems.select(F.lit("stem").alias("kind"), F.col("stem").alias("term"), "chunk_count"))


def _totals(chunks: DataFrame) -> DataFrame:
    """kind 'chunks' and 'tokens': how many the index holds."""
    sums = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("t"))
    pairs = F.array(F.struct(F.lit("chunks").alias("kind"), F.col("n").cast("long").alias("c")), F.struct(F.lit("tokens").alias("kind"), F.col("t").cast("long").alias("c")))
    return sums.select(F.explode(pairs).alias("p")).select("p.kind", F.lit("").alias("term"), F.col("p.c").alias("chunk_count"))


class SearchIndex:
    """A folder of segments. Each has ``chunks`` (forward rows, by bucket of the company), ``postings`` (by bucket of the stem, sorted by term), ``replaced`` (chunks of
    older segments that are gone or newer here) and ``statistics`` (signed counts, so that those of all segments add up).

    A refresh writes one segment and reads of the older ones only the buckets with chunks that it replaces; ``compact`` merges all into one. The list of live
    segments is a small table, written last under the next version number: a job that dies leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, slices: int = SLICES) -> None:
        self.spark, self.root, self.buckets, self.slices = spark, root.rstrip("/"), buckets, slices

    # ------------------------------------------------------------------ segments
    def _manifest(self) -> tuple[int, list[str]]:
        try:
            rows = self.spark.read.schema("version int, place int, segment string, buckets int").parquet(f"{self.root}/manifest")
            newest = rows.agg(F.max("version")).first()[0]
            live = rows.where(F.col("version") == newest).orderBy("place").collect() if newest else []
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            newest, live = 0, []
        if live:
            self.buckets = live[0]["buckets"]
        return newest or 0, [r["segment"] for r in live if r["segment"]]

    def _publish(self, version: int, segments: list[str]) -> None:
        rows = [(k, s, self.buckets) for k, s in enumerate(segments or [""])]
        frame = self.spark.createDataFrame(rows, "place int, segment string, buckets int").coalesce(1)
        frame.write.parquet(f"{self.root}/manifest/version={version + 1}")

    def _table(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{segment}/{name}")

    def _part(self, name: str, segments: list[str]) -> DataFrame:
        """One table over the given segments, with the place of each among the live ones."""
        united = None
        for place, segment in enumerate(segments):
            frame = self._table(segment, name).withColumn("segment", F.lit(place))
            united = frame if united is None else united.unionByName(frame)
        return united

    def _live(self, name: str, segments: list[str]) -> DataFrame:
        rows = self._part(name, segments)
        if len(segments) < 2:
            return rows.drop("segment")
        gone = self._part("replaced", segments).groupBy("cik", "chunk_id").agg(F.max("segment").alias("until"))
        kept = rows.join(gone, ["cik", "chunk_id"], "left").where(F.col("until").isNull() | (F.col("segment") >= F.col("until")))
        return kept.drop("segment", "until")

    def _write(self, forward: DataFrame, replaced: DataFrame, older: list[str]) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        folder = f"{self.root}/{name}"
        self._write_chunks(forward, folder)
        chunks = self._table(name, "chunks")
        replaced.select("cik", "chunk_id").distinct().write.parquet(f"{folder}/replaced")
        self._write_postings(inverted(chunks).join(vocabulary(chunks), "term"), folder)
        counts = [_frequencies(self._table(name, "postings")), _totals(chunks)]
        if older:
            lost = self._table(name, "replaced").withColumn("bucket", bucket_of(F.col("cik"), self.buckets))
            before = self._live("chunks", older).join(lost, ["bucket", "cik", "chunk_id"], "left_semi")
            words = inverted(before).join(vocabulary(before), "term")
            counts += [c.withColumn("chunk_count", -F.col("chunk_count")) for c in (_frequencies(words), _totals(before))]
        self._write_statistics(counts, folder)
        return name

    def _write_chunks(self, forward: DataFrame, folder: str) -> None:
        laid = forward.withColumn("bucket", bucket_of(F.col("cik"), self.buckets))
        dealt = laid.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(self.slices)))
        dealt.sortWithinPartitions("bucket", "cik").write.partitionBy("bucket").parquet(f"{folder}/chunks")

    def _write_postings(self, postings: DataFrame, folder: str) -> None:
        laid = postings.withColumn("bucket", bucket_of(F.col("stem"), self.buckets))
        # a term in most chunks fills its bucket: each bucket is dealt to several tasks
        dealt = laid.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(self.slices)))
        dealt.sortWithinPartitions("bucket", "term", "cik").write.partitionBy("bucket").parquet(f"{folder}/postings")

    def _write_statistics(self, counts: list[DataFrame], folder: str) -> None:
        united = counts[0]
        for more in counts[1:]:
            united = united.unionByName(more)
        added = united.groupBy("kind", "term").agg(F.sum("chunk_count").alias("chunk_count")).where("chunk_count <> 0")
        added.write.parquet(f"{folder}/statistics")

    # --------------------------------------------------------------- maintenance
    def refresh(self, chunks: DataFrame, removed: DataFrame | None = None) -> None:
        """Insert chunks, in place of those of the same company and id, and drop ``removed`` (cik, chunk_id) that are not inserted by the same
        call. Of rows that repeat an id in one call the one with the smallest columns stays."""
        version, segments = self._manifest()
        whole = F.struct(*[c for c in chunks.columns if c not in ("cik", "chunk_id")])
        once = chunks.groupBy("cik", "chunk_id").agg(F.min(whole).alias("r")).select("cik", "chunk_id", "r.*")
        gone = chunks.select("cik", "chunk_id")
        if removed is not None:
            gone = gone.unionByName(removed.select("cik", "chunk_id"))
        self._publish(version, [*segments, self._write(forward_index(once), gone, segments)])

    def compact(self) -> None:
        """Merge all segments into one; texts are not read again."""
        version, segments = self._manifest()
        if len(segments) < 2:
            return
        name = f"segment-{uuid.uuid4().hex}"
        folder = f"{self.root}/{name}"
        self._write_chunks(self._live("chunks", segments).drop("bucket"), folder)
        self._write_postings(self._live("postings", segments).drop("bucket"), folder)
        self._part("replaced", segments).select("cik", "chunk_id").limit(0).write.parquet(f"{folder}/replaced")
        self._write_statistics([self._part("statistics", segments).drop("segment")], folder)
        self._publish(version, [name])

    # ------------------------------------------------------------------- reading
    def segments(self) -> list[str]:
        return self._manifest()[1]

    def chunks(self) -> DataFrame:
        return self._live("chunks", self._manifest()[1])

    def postings(self) -> DataFrame:
        return self._live("postings", self._manifest()[1])

    def statistics(self) -> DataFrame:
        added = self._part("statistics", self._manifest()[1]).groupBy("kind", "term").agg(F.sum("chunk_count").alias("chunk_count"))
        return added.where("chunk_count > 0")

    def frequencies(self, stemmed: bool) -> DataFrame:
        """term, document_frequency."""
        kind = "stem" if stemmed else "term"
        return self.statistics().where(F.col("kind") == kind).select("term", F.col("chunk_count").alias("document_frequency"))

    def corpus(self) -> DataFrame:
        """document_count, average_length: one row."""
        count = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("chunk_count"))), F.lit(0))
        sums = self._part("statistics", self._manifest()[1]).where("kind IN ('chunks', 'tokens')")
        return sums.agg(count("chunks").alias("document_count"), count("tokens").alias("tokens")).select(
            "document_count", F.try_divide(F.col("tokens").cast("double"), F.col("document_count")).alias("average_length"))


class OneTimeIndex:
    """The same readings for chunks that are searched once: forward rows are staged, postings unfolded from them, nothing is laid out."""

    whole = True

    def __init__(self, chunks: DataFrame, stemmed: bool) -> None:
        self.spark = chunks.sparkSession
        folder = f"{checkpoint_dir(self.spark)}/forward-{uuid.uuid4().hex}"
        forward_index(chunks).write.parquet(folder)
        self.forward = self.spark.read.parquet(folder)
        self.words = inverted(self.forward)
        self.stems = self._staged(vocabulary(self.forward), "vocabulary") if stemmed else None
        self.words = self.words.join(self.stems, "term") if stemmed else self.words.withColumn("stem", F.col("term"))

    def _staged(self, frame: DataFrame, name: str) -> DataFrame:
        folder = f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(folder)
        return self.spark.read.parquet(folder)

    def narrowed(self, tokens: DataFrame) -> OneTimeIndex:
        """The index with the postings and frequencies of these tokens (stems, if the index has them) alone; chunks and corpus stay whole.

        The terms that are asked for are staged, so their size is known: a small table is sent to the postings where they are unfolded, and
        no other posting is moved.
        """
        found = copy(self)
        asked = self._staged(tokens.select("token").where("token IS NOT NULL").distinct(), "asked")
        if self.stems is None:
            found.words = inverted(self.forward).join(asked.withColumnRenamed("token", "term"), "term", "left_semi").withColumn("stem", F.col("term"))
        else:
            found.stems = self._staged(self.stems.join(asked.withColumnRenamed("token", "stem"), "stem", "left_semi"), "asked-stems")
            found.words = inverted(self.forward).join(found.stems, "term")
        found.whole = False
        return found

    def chunks(self) -> DataFrame:
        return self.forward

    def postings(self) -> DataFrame:
        return self.words

    def frequencies(self, stemmed: bool) -> DataFrame:
        if not stemmed and not self.whole:
            return self.words.groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"))
        if not stemmed:
            return self.forward.select(F.explode("entries.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"))
        return self.words.select("stem", "cik", "chunk_id").distinct().groupBy(F.col("stem").alias("term")).agg(
            F.count(F.lit(1)).alias("document_frequency"))

    def corpus(self) -> DataFrame:
        return self.forward.agg(
            F.count(F.lit(1)).alias("document_count"),
            (F.sum("length").cast("double") / F.count(F.lit(1))).alias("average_length"))
