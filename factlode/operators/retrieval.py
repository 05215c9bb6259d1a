"""Lexical search over filing chunks (BM25) and its evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlode.functions.stemming import porter
from factlode.functions.text import document_tokens, query_terms
from factlode.operators.search_index import OneTimeIndex, SearchIndex, bucket_of, forward_index, inverted, weight_at

# BM25 constants.
K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
SCORE = "decimal(28,12)"


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """Document count and average length over the whole index: one row."""
    return forward_index(chunks).agg(
        F.count(F.lit(1)).alias("document_count"),
        (F.sum("length").cast("double") / F.count(F.lit(1))).alias("average_length"),
    )


def postings(chunks: DataFrame) -> DataFrame:
    """One row per (chunk, term) with its places, the column-weighted frequency and the chunk length."""
    return inverted(forward_index(chunks))


def document_frequency(index: DataFrame) -> DataFrame:
    """Chunks per term; each task sends one row per distinct term, however common it is."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency"))


def expand_queries(queries: DataFrame, stemmed: bool = True, term_limit: int | None = None) -> DataFrame:
    """Query terms as token sequences: (query_id, cik, term_number, tokens, phrase)."""
    terms = queries.select("query_id", "cik", F.posexplode(query_terms(F.col("query"), term_limit)).alias("term_number", "word"))
    tokens = document_tokens(F.col("word"))
    found = terms.withColumn("tokens", F.transform(tokens, porter) if stemmed else tokens)
    return found.select("query_id", "cik", "term_number", "tokens", F.array_join("tokens", " ").alias("phrase"))


def phrase_postings(index: SearchIndex | OneTimeIndex, phrases: DataFrame, stemmed: bool) -> DataFrame:
    """(phrase, cik, chunk_id, length, frequency) of chunks that hold the tokens of a phrase next to each other in one column.

    Only the rarest token of a phrase looks through the index. Its places, moved back by its offset, are the possible starts; the other
    tokens are met in those chunks alone, and each keeps the starts at which it fits too.
    """
    name = "stem" if stemmed else "term"
    wanted = phrases.where(F.size("tokens") > 1).select("phrase", "tokens").distinct()
    if isinstance(index, OneTimeIndex):
        index = index.narrowed(wanted.select(F.explode("tokens").alias("token")))
    parts = wanted.select("phrase", F.size("tokens").alias("needed"), F.posexplode("tokens").alias("offset", "token"))
    counts = index.frequencies(stemmed).withColumnRenamed("term", "token")
    rarest = parts.join(counts, "token").groupBy("phrase", "needed").agg(
        F.min(F.struct("document_frequency", "offset", "token")).alias("r"), F.count(F.lit(1)).alias("known"))
    leads = rarest.where("known = needed").select("phrase", F.col("r.token").alias("token"), F.col("r.offset").alias("offset"))
    table = index.postings()
    key = ["token"]
    if "bucket" in table.columns:
        leads, parts = (f.withColumn("bucket", bucket_of(_stem_of(f, stemmed), index.buckets)) for f in (leads, parts))
        key = ["bucket", "token"]
    words = table.withColumn("token", F.col(name)).select(*key, "cik", "chunk_id", "length", "places")
    starts = F.transform("places", lambda p: p - F.col("offset"))
    # a stem has a row for each of its forms in a chunk
    first = words.join(leads, key).groupBy("phrase", "offset", "cik", "chunk_id", "length").agg(F.flatten(F.collect_list(starts)).alias("starts"))
    others = first.withColumnRenamed("offset", "lead").join(parts, "phrase").where("offset <> lead")
    fitting = F.array_intersect("starts", F.transform("places", lambda p: p - F.col("offset")))
    met = others.join(words.drop("length"), [*key, "cik", "chunk_id"]).select(
        "phrase", "needed", "cik", "chunk_id", "length", "offset", F.explode(fitting).alias("start"))
    whole = met.groupBy("phrase", "needed", "cik", "chunk_id", "length", "start").agg(F.count_distinct("offset").alias("fit"))
    return whole.where("fit = needed - 1").groupBy("phrase", "cik", "chunk_id", "length").agg(
        F.sum(weight_at(F.col("start"))).alias("frequency"))


def _stem_of(frame: DataFrame, stemmed: bool) -> Column:
    return F.col("token") if stemmed else porter(F.col("token"))


def bm25_search(
    chunks: DataFrame | None, queries: DataFrame, k: int = 10, stemmed: bool = True, phrases: bool = True,
    index: SearchIndex | OneTimeIndex | None = None, stats_scope: str = "index", forms: tuple[str, ...] = (),
    accessions: tuple[str, ...] = (), sections: tuple[str, ...] = (),
) -> DataFrame:
    """Top ``k`` chunks of the query's company for each query, from an index or from chunks that are indexed for this search.

    Query terms are OR-ed; document frequency and average length cover the whole index
    (``stats_scope='cik'`` restricts them to the company).  The join key is
    (company, term): queries of one company meet only its own postings, and a company or a
    term that dominates the index is split by the skew join.  Scores are summed as decimals,
    so equal chunks tie whatever order their terms arrive in; the top-k is limited on the
    map side before the shuffle by query.
    """
    index = index if index is not None else OneTimeIndex(chunks, stemmed)
    wanted = expand_queries(queries, stemmed)
    if not phrases:
        wanted = wanted.where(F.size("tokens") < 2)
    if isinstance(index, OneTimeIndex):
        index = index.narrowed(wanted.select(F.explode("tokens").alias("token")))
    table = index.postings()
    name, key = "stem" if stemmed else "term", ["cik", "token"]
    single = wanted.where(F.size("tokens") == 1).select("query_id", "cik", "term_number", F.col("phrase").alias("token"))
    if "bucket" in table.columns:
        single, key = single.withColumn("bucket", bucket_of(_stem_of(single, stemmed), index.buckets)), ["bucket", "cik", "token"]
    words = table.withColumn("token", F.col(name)).select(*key, "chunk_id", "length", "frequency")
    matched = words.join(single, key).select("query_id", "cik", "term_number", F.col("token").alias("term"), "chunk_id", "length", "frequency")
    if stemmed:
        matched = matched.groupBy("query_id", "cik", "term_number", "term", "chunk_id", "length").agg(F.sum("frequency").alias("frequency"))
    counts = index.frequencies(stemmed)
    if phrases:
        found = phrase_postings(index, wanted, stemmed).withColumnRenamed("phrase", "term")
        joined = wanted.where(F.size("tokens") > 1).select("query_id", "cik", "term_number", F.col("phrase").alias("term"))
        matched = matched.unionByName(found.join(joined, ["cik", "term"]).select(*matched.columns))
        counts = counts.unionByName(found.groupBy("term").agg(F.count(F.lit(1)).alias("document_frequency")))
    if stats_scope == "cik":
        own = matched.select("cik", "term", "chunk_id").distinct().groupBy("cik", "term").agg(F.count(F.lit(1)).alias("document_frequency"))
        totals = index.chunks().groupBy("cik").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average_length"))
        weighted = wanted.select("cik", F.col("phrase").alias("term")).distinct().join(own, ["cik", "term"]).join(totals, "cik")
    else:
        whole = index.corpus().select(F.struct("document_count", "average_length")).scalar()
        weighted = wanted.select("cik", F.col("phrase").alias("term")).distinct().join(counts, "term").withColumns(
            {"n": whole["document_count"], "average_length": whole["average_length"]})
    df = F.col("document_frequency").cast("double")
    raw_idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
    weighted = weighted.select("cik", "term", "average_length", F.when(raw_idf <= 0, F.lit(IDF_FLOOR)).otherwise(raw_idf).alias("idf"))
    filters = [F.col(c).isin(*v) for c, v in (("form", forms), ("accession_number", accessions), ("section", sections)) if v]
    if filters:
        allowed = index.chunks()
        for condition in filters:
            allowed = allowed.where(condition)
        matched = matched.join(allowed.select("cik", "chunk_id"), ["cik", "chunk_id"], "left_semi")
    scorable = matched.join(weighted, ["cik", "term"])
    norm = K1 * (1 - B + B * F.col("length") / F.col("average_length"))
    part = F.col("idf") * (F.col("frequency") * (K1 + 1.0)) / (F.col("frequency") + norm)
    scored = scorable.groupBy("query_id", "cik", "chunk_id").agg(F.sum(part.cast(SCORE)).alias("score"))
    best = Window.partitionBy("query_id", "cik").orderBy(F.col("score").desc(), F.col("chunk_id"))
    return (
        scored.withColumn("score", F.col("score").cast(SCORE))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    )


def search_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the chunk payload (company and chunk id together keep the join prunable)."""
    return hits.join(chunks, ["cik", "chunk_id"])


def evaluate_retrieval(labels: DataFrame, hits: DataFrame, k: int = 3) -> DataFrame:
    """Recall at ``k`` and mean reciprocal rank over labelled queries.

    ``labels`` has query_id and the expected value; ``hits`` has query_id, rank and the same
    value column ``label``.
    """
    found = hits.where(F.col("rank") <= k).groupBy("query_id", "label").agg(F.min("rank").alias("rank"))
    joined = labels.join(found, ["query_id", "label"], "left")
    return joined.agg(
        F.count(F.lit(1)).alias("query_count"),
        F.count("rank").alias("recalled"),
        (F.count("rank") / F.count(F.lit(1))).alias("recall_at_k"),
        F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mean_reciprocal_rank"),
    )
