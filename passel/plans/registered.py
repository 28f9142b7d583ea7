"""The queries of the driver contract, each over whole tables.

The given tables stand in for the collections: ``documents``, ``pages`` and ``conversations`` as raw
documents, ``embeddings`` as a vector corpus whose label is the source, ``benchmark`` as the text
query set, ``events`` as a timing log.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passel.functions import ids, text, vectors
from passel.functions.encode import DEFAULT_MODEL, hashing_encoder, model_encoder
from passel.operators import ann, corpus, evaluate, hits, latency, metadata, validate
from passel.operators.chunk import chunk_documents
from passel.operators.documents import clean_documents
from passel.operators.search import encode_queries, search, search_many, search_one
from passel.operators.cells import probes_for
from passel.operators.hashing import HashTables
from passel.plans.corpus import (
    calibrate,
    embed_passages,
    exact_by_cell,
    passages,
    search_by_cell,
    search_in_tables,
    store_by_cell,
    store_in_tables,
)
from passel.plans.retrieval import run_summary
from passel.session import checkpoint, materialise, scratch_path, spread
from passel.sources import documents as raw
from passel.sources import runs
from passel.sources.corpus import discover_shards, write_shards
from passel.sources.queries import key_gold, query_lines, read_gold_lines

Query = Callable[[SparkSession, str], DataFrame]

K = 10
N_SHARDS = 8
WANTED_SOURCE = "\tSource3\u00a0"
DIGITS = 6
TRAINING_ROUNDS = 2
VECTOR_DIM = 64
RECALLS = (0.5, 0.8, 0.9, 0.95, 1.0)
BACKENDS = ("click", "error", "purchase", "signup", "view")
SINGLE_QUERY = "The of and that"
SINGLE, MULTI = "wiki", "multidomain"

QUERIES: dict[str, Query] = {}


def registered(query: Query) -> Query:
    """Register under the function's name; a last ``_`` keeps it apart from an operator of that name."""
    QUERIES[query.__name__.removesuffix("_")] = query
    return query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- inputs


def raw_documents(spark: SparkSession, folder: str, body: Column | None = None) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text"))
    key = F.col("doc_id").cast("string")
    return docs.select(
        key.alias("id"),
        F.col("source").alias("domain"),
        key.alias("source_id"),
        F.concat(F.lit("Document "), key).alias("title"),
        F.lit(None).cast("string").alias("url"),
        (F.col("text") if body is None else body).alias("text"),
    )


def marked_text() -> Column:
    """The document text with marks, lists and entities for the cleaners to find."""
    return F.concat(F.lit("[edit] "), F.col("text"), F.lit(" [12] [1, 2; 3] &amp; &lt;b&gt; [edit]"))


def vector_corpus(spark: SparkSession, folder: str) -> DataFrame:
    vectors_table = table(spark, folder, "embeddings")
    key = F.col("vec_id").cast("string")
    return vectors_table.select(
        key.alias("id"),
        ids.build_uid(key, F.lit(None)).alias("uid"),
        F.concat(F.lit("Source"), F.col("label").cast("string"), F.lit("\t")).alias("source"),
        "label",
        "embedding",
    )


def doubled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector twice under the same uid."""
    once = vector_corpus(spark, folder)
    return corpus.merge_corpora(once, once)


def label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query per label: the mean vector of its rows."""
    means = ann.mean_vectors(table(spark, folder, "embeddings"), "label")
    return means.select(F.col("label").cast("bigint").alias("qid"), "embedding")


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    return items.select(F.col("item_id").alias("qid"), text.collapse_blanks(F.col("text")).alias("query"))


def text_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages(raw_documents(spark, folder))


def sharded_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.hash_shards(vector_corpus(spark, folder), N_SHARDS)


def rounded_hits(found: DataFrame, *more: str) -> DataFrame:
    return found.select("qid", "rank", "uid", F.round("score", DIGITS).alias("score"), *more)


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """The timing log with a run file name made of its fields."""
    events = table(spark, folder, "events")
    number = F.get_json_object("props", "$.k").cast("int")
    size = F.when(number < 34, "10k").when(number < 67, "30k").otherwise("50k")
    domain = F.when(F.pmod("user_id", F.lit(2)) == 0, SINGLE).otherwise(MULTI)
    name = F.concat_ws("_", domain, F.col("event_type"), F.lit("llm"), size)
    return events.select(
        "event_id", "user_id", "event_type", "value", F.concat(name, F.lit(ids.RUN_SUFFIX)).alias("file_name")
    )


def parsed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The log with its run fields, parsed where the rows lie."""
    log = run_log(spark, folder)
    return log.select("event_id", "value", ids.parse_run_name(F.col("file_name")).alias("_run")).select("event_id", "value", "_run.*")


def latency_figures(log: DataFrame, keys: list[str], metric: Column | None = None) -> DataFrame:
    return latency.latency_summary(log, keys, "value", metric, decimals=DIGITS, total_decimals=DIGITS)


def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Figures per run."""
    return latency_figures(parsed_runs(spark, folder), ["domain", "backend", "size"])


# ---------------------------------------------------------------- sources


@registered
def query_set_load(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with every kind of line end and of blank around them."""
    odd = F.concat("text", F.lit("\r\n\t\n\u00a0last line \u00a0\r\x0b\r\n \x1f"))
    return query_lines(table(spark, folder, "benchmark").select("item_id", odd.alias("text")), F.col("text"), "item_id")


@registered
def normalize_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    articles = docs.select(F.concat_ws("/", "source", "doc_id").alias("title"), "text")
    return raw.encyclopedia_documents(articles).drop("published_at")


@registered
def normalize_abstracts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    key = F.col("doc_id").cast("string")
    month = F.pmod("doc_id", F.lit(12)) + 1
    names = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    spelled = F.when(F.pmod("doc_id", F.lit(2)) == 0, month.cast("string")).otherwise(
        F.element_at(names, month.cast("int"))
    )
    date = F.struct(
        F.lit("2020").alias("Year"), spelled.alias("Month"), F.lit(None).cast("string").alias("Day")
    )
    article = F.struct(
        F.concat(F.lit("Title "), key).alias("ArticleTitle"),
        F.struct(F.split("text", "\n").alias("AbstractText")).alias("Abstract"),
        F.struct(F.struct(date.alias("PubDate")).alias("JournalIssue")).alias("Journal"),
    )
    records = docs.select(F.struct(key.alias("PMID"), article.alias("Article")).alias("MedlineCitation"))
    published = F.date_format("published_at", "yyyy-MM-dd")
    return raw.abstract_documents(records).withColumn("published_at", published)


@registered
def qa_pair_join(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    questions = turns.where("role = 'user'").select(
        number.alias("question_id"), F.col("text").alias("body"), (number + 1).alias("accepted_answer_id")
    )
    answers = turns.where("role = 'assistant'").select(number.alias("answer_id"), F.col("text").alias("body"))
    return raw.qa_documents(questions, answers).select("id", "domain", "source_id", "text")


@registered
def unify_published_at(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    moment = F.col("o_orderdate").cast("timestamp")
    kind = F.pmod("o_orderkey", F.lit(3))
    value = F.when(kind == 0, F.unix_seconds(moment).cast("string")).when(kind == 1, F.date_format(moment, "yyyy-MM-dd"))
    stated = orders.select("o_orderkey", value.alias("stated"))
    return stated.select(
        "o_orderkey", F.date_format(raw.published_at(F.col("stated")), "yyyy-MM-dd").alias("published_on")
    )


@registered
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    return runs.latest_run(table(spark, folder, "events"), "event_type", "ts").select("event_id", "event_type", "value")


# ---------------------------------------------------------------- cleaning and passages


@registered
def clean_documents_(spark: SparkSession, folder: str) -> DataFrame:
    docs = raw_documents(spark, folder, marked_text())
    return clean_documents(docs, "encyclopedia").select("id", "domain", "clean_text")


@registered
def clean_citations(spark: SparkSession, folder: str) -> DataFrame:
    docs = raw_documents(spark, folder, marked_text())
    return clean_documents(docs, "abstract").select("id", "domain", "clean_text")


@registered
def clean_html_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(table(spark, folder, "pages").select("page_id", F.col("html").alias("text")))
    return clean_documents(pages, "html")


@registered
def chunk_documents_(spark: SparkSession, folder: str) -> DataFrame:
    return text_passages(spark, folder)


@registered
def chunk_documents_short_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows whose step is longer than the window, and tails below the minimum."""
    cleaned = clean_documents(raw_documents(spark, folder))
    return chunk_documents(cleaned, keep=["id"], max_len=40, stride=55, min_len=15, max_tokens=800)


@registered
def vector_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return metadata.vector_metadata(text_passages(spark, folder))


@registered
def encode_hashing(spark: SparkSession, folder: str) -> DataFrame:
    embedded = embed_passages(text_passages(spark, folder))
    cells = embedded.select("uid", F.posexplode("embedding").alias("bucket", "_x"))
    return cells.where("_x <> 0").select("uid", "bucket", F.round(F.col("_x").cast("double"), DIGITS).alias("weight"))


# ---------------------------------------------------------------- fields and identifiers


@registered
def pick_text(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.pmod("doc_id", F.lit(4))
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.when(kind == 0, F.col("text")).when(kind == 1, "").alias("chunk_text"),
        F.when(kind == 1, F.concat(F.lit(" "), "lang")).alias("text"),
        F.when(kind == 2, F.col("source")).otherwise("").alias("preview"),
        F.when(kind < 2, F.concat(F.lit("\t"), F.upper("source"), F.lit("\u00a0"))).when(kind == 2, "").alias("domain"),
        F.concat(F.lit("\r\n"), "lang", F.lit(" \t")).alias("source"),
    )
    have = docs.columns
    return docs.select("doc_id", text.pick_text(have).alias("picked"), text.resolve_source(have).alias("resolved"))


@registered
def normalize_metadata(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.pmod("doc_id", F.lit(4))
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(kind != 3, F.concat(F.lit(" \t"), F.upper("source"), F.lit("\u00a0\n"))).alias("domain"),
        F.col("n_chars").alias("source_id"),
        F.when(kind == 0, F.col("n_chars").cast("string"))
        .when(kind == 1, "NaN")
        .when(kind == 2, F.concat(F.lit("\t"), F.col("n_chars").cast("string"), F.lit("\n")))
        .otherwise("1.7")
        .alias("chunk_id"),
    )
    return metadata.normalize_metadata(docs)


@registered
def build_uid(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    chunk = F.when(F.col("toxic") == 0, F.col("quality").cast("double"))
    return metadata.add_uid(labels.select(F.col("doc_id").alias("id"), chunk.alias("chunk_id"))).select("id", "uid")


@registered
def build_uid_by_row(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("source").alias("id"), "doc_id")
    return metadata.add_uid(docs, ["doc_id"]).select("doc_id", "uid")


@registered
def build_uid_suffixed(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    rows = events.select(F.col("user_id").alias("id"), F.lit(None).cast("int").alias("chunk_id"), "event_id")
    return metadata.add_uid(rows, ["event_id"], "suffix_all").select("event_id", "uid")


@registered
def split_uid(spark: SparkSession, folder: str) -> DataFrame:
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    kind = F.pmod("event_id", F.lit(5))
    uid = (
        F.when(kind == 0, F.concat(user, F.lit("::c"), event))
        .when(kind == 1, F.concat(user, F.lit("::row"), event))
        .when(kind == 2, F.concat(user, F.lit("::c1::c"), event))
        .when(kind == 3, F.concat(user, F.lit("::cx")))
        .otherwise(user)
    )
    events = table(spark, folder, "events").select("event_id", uid.alias("uid"))
    return events.select("event_id", "uid", ids.split_uid(F.col("uid")).alias("_parts")).select(
        "event_id", "uid", "_parts.*"
    )


@registered
def record_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = {"source": F.col("source"), "lang": F.col("lang"), "n_chars": F.col("n_chars"), "url": F.lit(None).cast("string")}
    return docs.select("doc_id", ids.fingerprint(fields).alias("fingerprint"))


@registered
def parse_run_name(spark: SparkSession, folder: str) -> DataFrame:
    log = run_log(spark, folder)
    parsed = log.select("event_id", "file_name", ids.parse_run_name(F.col("file_name")).alias("_run"))
    return parsed.select("event_id", "file_name", "_run.*")


# ---------------------------------------------------------------- corpus


@registered
def merge_corpora(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("wikipedia").alias("domain"), "text"
    )
    pages = table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.lit("web").alias("domain"), F.col("html").alias("text"), "url"
    )
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("stackexchange").alias("domain"), "text"
    )
    merged = corpus.merge_corpora(docs, pages, turns)
    return merged.select("id", "domain", "url", F.length("text").cast("bigint").alias("n_chars"))


@registered
def corpus_slice(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return corpus.first_rows(docs, 150, ["doc_id"])


@registered
def corpus_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    rows = vector_corpus(spark, folder).select("uid", "source")
    return corpus.shuffle_positions(rows, "uid", 42)


@registered
def hash_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return corpus.hash_shards(docs, N_SHARDS, "doc_id")


@registered
def contiguous_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return corpus.contiguous_shards(docs, N_SHARDS, ["doc_id"])


@registered
def domain_counts_by_shard(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    nameless = F.when(F.pmod("doc_id", F.lit(9)) != 0, F.col("source"))
    rows = corpus.hash_shards(docs.select("doc_id", nameless.alias("domain")), N_SHARDS, "doc_id")
    return corpus.domain_counts(rows)


@registered
def shard_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Shards by label; the upper ones are empty and still listed, rows without a valid one too."""
    label = F.col("label")
    shard = F.when(label == 2, F.lit(99)).when(label != 4, label)
    rows = vector_corpus(spark, folder).select(shard.alias("shard"))
    return corpus.shard_counts(rows, 16)


@registered
def shard_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharded_corpus(spark, folder).withColumnRenamed("source", "domain")
    manifest = corpus.shard_manifest(rows, N_SHARDS)
    entries = F.transform(F.map_entries("domain_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return manifest.withColumn("domain_counts", F.array_join(F.sort_array(entries), ",")).drop("created_at")


@registered
def normalize_vectors(spark: SparkSession, folder: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    rows = table(spark, folder, "embeddings").select("vec_id", vectors.normalize_vector(scaled).alias("_unit"))
    cells = rows.select("vec_id", F.posexplode("_unit").alias("pos", "_x"))
    return cells.select("vec_id", "pos", F.round("_x", DIGITS).alias("value"))


# ---------------------------------------------------------------- search


def vector_search(spark: SparkSession, folder: str, asked: DataFrame | None = None, **options) -> DataFrame:
    asked = label_queries(spark, folder) if asked is None else asked
    return search(asked, vector_corpus(spark, folder), K, **options)


def shard_search(spark: SparkSession, folder: str, asked: DataFrame | None = None, **options) -> DataFrame:
    asked = label_queries(spark, folder) if asked is None else asked
    return search(asked, sharded_corpus(spark, folder), K, **options)


def stored_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The label queries, stored for jobs that read them more than once."""
    return materialise(label_queries(spark, folder))


def cell_search(spark: SparkSession, folder: str, asked: DataFrame, nprobe: int, **options) -> DataFrame:
    """The approximate search with cells around the label means."""
    centres = ann.collect_centroids(asked, "qid")
    return vector_search(spark, folder, asked, strategy="ivf", centroids=centres, nprobe=nprobe, **options)


@registered
def topk_exact_ip(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_hits(vector_search(spark, folder, metric="ip"))


@registered
def topk_exact_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_hits(vector_search(spark, folder, metric="cos_sim"))


@registered
def topk_exact_l2(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_hits(vector_search(spark, folder, metric="euclidean"))


@registered
def topk_filter_pre(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_hits(vector_search(spark, folder, source=WANTED_SOURCE))


@registered
def topk_filter_post(spark: SparkSession, folder: str) -> DataFrame:
    found = vector_search(spark, folder, source=WANTED_SOURCE, filter_stage="post")
    return rounded_hits(found, "source")


@registered
def topk_sharded_merge(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_hits(shard_search(spark, folder, strategy="sharded", dedup=False), "shard")


@registered
def topk_sharded_filter_merge(spark: SparkSession, folder: str) -> DataFrame:
    found = shard_search(spark, folder, strategy="sharded", source=WANTED_SOURCE, filter_stage="merge")
    return rounded_hits(found, "shard", "source")


@registered
def topk_sharded_filter_local(spark: SparkSession, folder: str) -> DataFrame:
    found = shard_search(spark, folder, strategy="sharded", source=WANTED_SOURCE, filter_stage="local")
    return rounded_hits(found, "shard", "source")


@registered
def topk_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_hits(shard_search(spark, folder, strategy="fanout"), "shard")


def copied_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector in two shards under the same uid."""
    once = sharded_corpus(spark, folder)
    return once.unionByName(once.withColumn("shard", F.pmod(F.col("shard") + 3, F.lit(N_SHARDS))))


@registered
def topk_sharded_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Copies in two shards are two hits of the sharded search."""
    found = search(label_queries(spark, folder), copied_shards(spark, folder), K, strategy="sharded", dedup=False)
    return rounded_hits(found)


@registered
def topk_fanout_copies(spark: SparkSession, folder: str) -> DataFrame:
    """The fan-out keeps the best occurrence of a uid only; a filter inside the shards leaves fewer candidates."""
    found = search(
        label_queries(spark, folder), copied_shards(spark, folder), K, strategy="fanout", source=WANTED_SOURCE, filter_stage="local"
    )
    return rounded_hits(found)


@registered
def topk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_hits(search(label_queries(spark, folder), doubled_corpus(spark, folder), K))


@registered
def dedup_best_hit(spark: SparkSession, folder: str) -> DataFrame:
    found = search(label_queries(spark, folder), doubled_corpus(spark, folder), 2 * K, dedup=False, carry=["id"])
    return rounded_hits(hits.dedup_best_hit(found.withColumn("chunk_id", F.lit(None).cast("int")), k=K), "id")


@registered
def topk_ivf(spark: SparkSession, folder: str) -> DataFrame:
    """Cells around the label means, three of them probed."""
    return rounded_hits(cell_search(spark, folder, stored_queries(spark, folder), 3))


@registered
def topk_ivf_all_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Trained cells, all probed: the same result as the exact search."""
    return rounded_hits(vector_search(spark, folder, strategy="ivf", n_cells=16, nprobe=16))


@registered
def topk_ivf_trained(spark: SparkSession, folder: str) -> DataFrame:
    """Cells trained from a seeded start, four of them probed."""
    return rounded_hits(vector_search(spark, folder, strategy="ivf", n_cells=16, nprobe=4, rounds=TRAINING_ROUNDS))


@registered
def topk_nonfinite(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus with null, infinite and undefined vectors between the others; the rest is found."""
    spoilt = F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 7 == 1, F.lit(float("inf")))
    bad = F.array_prepend(F.slice("embedding", 2, 1 << 30), spoilt.cast("float"))
    rows = table(spark, folder, "embeddings")
    vector = F.when(F.col("vec_id") % 7 < 2, bad).when(F.col("vec_id") % 7 > 2, F.col("embedding"))
    key = F.col("vec_id").cast("string")
    searched = rows.select(ids.build_uid(key, F.lit(None)).alias("uid"), key.alias("id"), vector.alias("embedding"))
    asked = label_queries(spark, folder)
    found = [
        search(asked, searched, K, metric="cosine").withColumn("how", F.lit("exact")),
        search(asked, corpus.hash_shards(searched, N_SHARDS), K, strategy="sharded").drop("shard").withColumn("how", F.lit("sharded")),
        search(asked, corpus.hash_shards(searched, N_SHARDS), K, strategy="fanout").drop("shard").withColumn("how", F.lit("fanout")),
    ]
    return rounded_hits(found[0].unionByName(found[1]).unionByName(found[2]), "how")


@registered
def topk_ivf_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Cells trained, the corpus stored by them, and the folders of the probed cells searched."""
    with scratch_path(spark) as path:
        store_by_cell(vector_corpus(spark, folder), path, n_cells=16, rounds=TRAINING_ROUNDS)
        return checkpoint(rounded_hits(search_by_cell(label_queries(spark, folder), path, K, nprobe=4)))


@registered
def topk_exact_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The exact search by distance, over stored cells whose extents say which can hold a hit."""
    with scratch_path(spark) as path:
        store_by_cell(vector_corpus(spark, folder), path, n_cells=16, rounds=TRAINING_ROUNDS)
        return checkpoint(rounded_hits(exact_by_cell(label_queries(spark, folder), path, K, metric="l2").hits))


@registered
def probe_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the stored cells a recall needs, measured on a sample of the corpus, and the share that is read then."""
    with scratch_path(spark) as path:
        store_by_cell(vector_corpus(spark, folder), path, n_cells=16, rounds=TRAINING_ROUNDS)
        chosen = probes_for(calibrate(vector_corpus(spark, folder), path, K), RECALLS)
        return checkpoint(chosen.withColumns({c: F.round(c, DIGITS) for c in ("recall", "share_read")}))


@registered
def topk_ivf_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """Stored cells, as many of them probed as a recall of 0.95 took in the calibration."""
    with scratch_path(spark) as path:
        store_by_cell(vector_corpus(spark, folder), path, n_cells=16, rounds=TRAINING_ROUNDS)
        calibrate(vector_corpus(spark, folder), path, K)
        return checkpoint(rounded_hits(search_by_cell(label_queries(spark, folder), path, K, recall=0.95)))


@registered
def topk_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_hits(vector_search(spark, folder, strategy="lsh"))


@registered
def topk_lsh_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Eight stored hash tables; the 240 likeliest of their 2048 buckets are probed."""
    with scratch_path(spark) as path:
        tables = HashTables(VECTOR_DIM)
        store_in_tables(vector_corpus(spark, folder), path, tables)
        return checkpoint(rounded_hits(search_in_tables(label_queries(spark, folder), path, tables, K)))


@registered
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    """The whole way from raw documents and text queries to ranked passages."""
    searchable = embed_passages(text_passages(spark, folder))
    return rounded_hits(search_many(text_queries(spark, folder), hashing_encoder(), searchable, k=K))


# ---------------------------------------------------------------- hits


@registered
def attach_metadata(spark: SparkSession, folder: str) -> DataFrame:
    found = hits.attach_metadata(vector_search(spark, folder), vector_corpus(spark, folder), ["id", "source", "label"])
    return rounded_hits(found, "id", "source", "label")


def text_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Text hits with their passages; the passages are stored first, as both steps read them."""
    chunks = materialise(text_passages(spark, folder))
    found = search_many(text_queries(spark, folder), hashing_encoder(), embed_passages(chunks), k=K)
    return hits.attach_text(found, chunks)


@registered
def hits_with_text(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_hits(text_hits(spark, folder), "text")


@registered
def rag_context(spark: SparkSession, folder: str) -> DataFrame:
    return hits.rag_context(text_hits(spark, folder))


@registered
def first_hit_per_query(spark: SparkSession, folder: str) -> DataFrame:
    first = hits.first_hit_per_query(vector_search(spark, folder, carry=["source"]))
    return rounded_hits(first, "source")


@registered
def search_single(spark: SparkSession, folder: str) -> DataFrame:
    """One text against all passages."""
    searchable = embed_passages(text_passages(spark, folder))
    return rounded_hits(search_one(SINGLE_QUERY, hashing_encoder(), searchable, k=K))


@registered
def search_full(spark: SparkSession, folder: str) -> DataFrame:
    """The full result record: fields and text of the passages beside their scores."""
    chunks = materialise(text_passages(spark, folder))
    found = search_many(text_queries(spark, folder), hashing_encoder(), embed_passages(chunks), k=K)
    keyed = chunks.withColumn("uid", ids.build_uid(F.col("id"), F.col("chunk_id")))
    # Passages without a text stand for a store that lost them.
    lost = F.when(F.col("chunk_id") != 1, F.col("chunk_text"))
    fields = ["id", "domain", "title", "url", "chunk_text", "chunk_id"]
    completed = hits.complete_hits(hits.attach_metadata(found, keyed.withColumn("chunk_text", lost), fields))
    return rounded_hits(completed, "id", "source", "title", "url", "text", "chunk_id")


@registered
def guarded_search(spark: SparkSession, folder: str) -> DataFrame:
    """A search behind the checks on row count, encoder, vector lengths and queries."""
    model = F.lit(DEFAULT_MODEL).alias("model_name")
    rows = vector_corpus(spark, folder).select("uid", "embedding", model)
    recorded = table(spark, folder, "embeddings").count()
    checked = validate.require_unit_vectors(validate.require_encoder(validate.require_count(rows, recorded), DEFAULT_MODEL))
    asked = label_queries(spark, folder).withColumn("query", F.concat(F.lit("label "), "qid"))
    return rounded_hits(search(validate.require_valid_queries(asked, 64), checked, K))


@registered
def store_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Squared distances as a store reports them, turned into similarities."""
    found = vector_search(spark, folder, metric="l2").withColumn("distance", -F.col("score"))
    similarity = F.round(vectors.distance_to_similarity(F.col("distance")), DIGITS)
    return found.select("qid", "rank", "uid", similarity.alias("similarity"))


def _letter_counts():
    """A model that counts: characters and blanks of a text."""

    def predict(texts):
        return np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)

    return predict


@registered
def model_encode(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", model_encoder(_letter_counts)(F.col("text")).alias("_v"))
    return docs.select("doc_id", *[F.get("_v", F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(("chars", "blanks"))])


# ---------------------------------------------------------------- files


@registered
def sharded_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A corpus written by shard, its shards discovered in the folder."""
    with scratch_path(spark) as path:
        write_shards(sharded_corpus(spark, folder), path)
        return checkpoint(discover_shards(spark, path))


def logged_hits(spark: SparkSession, folder: str) -> DataFrame:
    asked = label_queries(spark, folder).withColumn("query", F.concat(F.lit("label, \""), F.col("qid").cast("string"), F.lit("\"")))
    found = hits.complete_hits(vector_search(spark, folder, carry=["id", "source"]))
    return hits.hit_log(found, asked, 1)


@registered
def hit_log_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Hits logged as JSON lines and as CSV, and merged in order, then read again."""
    log = materialise(logged_hits(spark, folder))
    columns = ["query", "rank", "uid", "source"]
    read = []
    with scratch_path(spark) as path:
        for form in ("jsonl", "csv"):
            runs.write_hits(log, f"{path}/{form}", form)
            read.append(runs.read_hits(spark, f"{path}/{form}", form).withColumn("form", F.lit(form)))
        runs.write_merged_hits(log, f"{path}/merged")
        merged = runs.read_hits(spark, f"{path}/merged", "csv")
        read.append(merged.withColumn("form", F.lit("merged")))
        score = F.round(F.col("score").cast("double"), DIGITS).alias("score")
        stacked = [r.select("form", *columns, score) for r in read]
        both = stacked[0].unionByName(stacked[1]).unionByName(stacked[2])
        return checkpoint(both.withColumn("rank", F.col("rank").cast("int")))


@registered
def run_summary_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs appended under their start times; the later one is read back."""
    figures = latency_figures(table(spark, folder, "events"), ["event_type"]).withColumnRenamed("event_type", "backend")
    with scratch_path(spark) as path:
        for started, keep in (("2024-01-02 03:04:05", F.lit(True)), ("2024-01-10 00:00:00", F.col("backend") != "view")):
            run = figures.where(keep).withColumn("index_key", F.lit("vectors"))
            run = run.withColumn("run_id", runs.run_id(F.lit(started).cast("timestamp"), F.lit("abc")))
            runs.append_summary(run, path)
        latest = runs.read_latest_run(spark, path, "vectors", figures.schema)
        return checkpoint(latest.select("backend", "n_queries", "avg_ms", "p50_ms", F.col("run_id").cast("string").alias("run_id")))


@registered
def gold_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Gold lists written as JSON lines, read, keyed by query and compared with the hits."""
    rows = vector_corpus(spark, folder)
    query = F.concat(F.lit("label "), F.col("label").cast("string"))
    some = rows.where("cast(id as bigint) % 3 = 0")
    gold = some.select(F.to_json(F.create_map(query, F.array("uid"))).alias("value"))
    asked = label_queries(spark, folder).withColumn("query", F.concat(F.lit("label "), F.col("qid").cast("string")))
    with scratch_path(spark) as path:
        gold.write.text(path)
        keyed = key_gold(read_gold_lines(spark, path), asked)
        return checkpoint(evaluate.recall_mrr(vector_search(spark, folder), keyed, asked))


# ---------------------------------------------------------------- evaluation


def exact_gold(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    return vector_search(spark, folder, asked).select("qid", "uid")


@registered
def recall_mrr(spark: SparkSession, folder: str) -> DataFrame:
    """The two-cell search measured against the exact one."""
    asked = stored_queries(spark, folder)
    return evaluate.recall_mrr(cell_search(spark, folder, asked, 2), exact_gold(spark, folder, asked), asked)


@registered
def recall_per_query(spark: SparkSession, folder: str) -> DataFrame:
    asked = stored_queries(spark, folder)
    found = cell_search(spark, folder, asked, 1)
    per_query = evaluate.recall_per_query(found, exact_gold(spark, folder, asked), asked)
    return per_query.select(
        "qid", "n_gold", "n_found", *[F.round(c, DIGITS).alias(c) for c in ("recall", "reciprocal_rank")]
    )


@registered
def topk_agreement(spark: SparkSession, folder: str) -> DataFrame:
    asked = stored_queries(spark, folder)
    report = evaluate.agreement(vector_search(spark, folder, asked), cell_search(spark, folder, asked, 1), K)
    return report.withColumns({c: F.array_join(c, ",") for c in ("only_a", "only_b")})


@registered
def agreement_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Shard fan-out against the local search: every query agrees."""
    asked = stored_queries(spark, folder)
    merged = shard_search(spark, folder, asked, strategy="fanout")
    return evaluate.agreement_ratio(evaluate.agreement(merged, vector_search(spark, folder, asked), K))


@registered
def hits_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.hits_by_source(vector_search(spark, folder, carry=["source"]))


@registered
def hit_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.coverage(vector_search(spark, folder, carry=["source"]))


@registered
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    found = vector_search(spark, folder, carry=["source"])
    nameless = F.when(F.col("source") != "Source7\t", F.col("source"))
    return evaluate.source_mix(found.withColumn("source", nameless))


# ---------------------------------------------------------------- latency


@registered
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    figures = latency.exact_percentiles(table(spark, folder, "events"), ["event_type"], "value")
    return figures.withColumns({c: F.round(c, DIGITS) for c in latency.PERCENTILES})


@registered
def latency_percentiles_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return latency.exact_percentiles(table(spark, folder, "events"), ["event_type"], "value", method="nearest")


@registered
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    return latency_figures(table(spark, folder, "events"), ["event_type"], F.lit("ip"))


@registered
def summary_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return latency.summary_pivot(run_summaries(spark, folder), "p50_ms", BACKENDS)


@registered
def domain_gap(spark: SparkSession, folder: str) -> DataFrame:
    gap = latency.domain_gap(run_summaries(spark, folder), SINGLE, MULTI)
    return gap.withColumns({c: F.round(c, DIGITS) for c in ("gap", "ratio")})


@registered
def run_folder_report(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries written as a file for each run in nested folders, found there by name, and put side by side."""
    named = parsed_runs(spark, folder)
    figures = latency_figures(named, ["domain", "backend", "size"])
    size = F.concat((F.col("size") / 1000).cast("int").cast("string"), F.lit("k"))
    name = F.concat(F.concat_ws("_", "domain", "backend", F.lit("llm"), size), F.lit(ids.RUN_SUFFIX))
    with scratch_path(spark) as path:
        runs.write_run_summaries(figures.select(name.alias("file_name"), "n_queries", "avg_ms", "p50_ms", "p90_ms", "qps"), path)
        found = runs.require_run_sizes(runs.read_run_summaries(spark, path))
        pivoted = latency.summary_pivot(found, "retrieval_p50_ms", BACKENDS)
        gaps = latency.domain_gap(found, SINGLE, MULTI, "retrieval_p50_ms").groupBy("size").agg(F.round(F.max("gap"), DIGITS).alias("largest_gap"))
        return checkpoint(pivoted.join(gaps, "size"))


@registered
def latency_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches stored for each day, merged to one for each backend, and how their percentiles rank in the raw log."""
    events = table(spark, folder, "events")
    with scratch_path(spark) as path:
        daily = events.withColumn("day", F.to_date("ts"))
        latency.run_sketches(daily, ["event_type", "day"], "value").write.parquet(path)
        merged = latency.merge_sketches(spark.read.parquet(path), ["event_type"])
        found = materialise(latency.sketch_percentiles(merged, ["event_type"]))
    below = {c: F.count_if(F.col("value") < F.col(c)).alias(f"_b_{c}") for c in latency.PERCENTILES}
    upto = {c: F.count_if(F.col("value") <= F.col(c)).alias(f"_u_{c}") for c in latency.PERCENTILES}
    ranked = events.join(F.broadcast(found), "event_type").groupBy("event_type", "n").agg(*below.values(), *upto.values())
    slack = F.greatest(F.lit(1.0), 0.02 * F.col("n"))
    near = [
        ((F.col(f"_b_{c}") <= p / 100.0 * F.col("n") + slack) & (F.col(f"_u_{c}") >= p / 100.0 * F.col("n") - slack)).alias(f"{c}_near")
        for c, p in latency.PERCENTILES.items()
    ]
    return ranked.select("event_type", "n", *near)


@registered
def system_comparison(spark: SparkSession, folder: str) -> DataFrame:
    summaries = materialise(run_summaries(spark, folder)).where((F.col("domain") == MULTI) & (F.col("size") == 50000))
    small = summaries.where("backend = 'click'").withColumn("llm_p50_ms", F.col("p50_ms") + F.col("p90_ms"))
    return latency.system_comparison(small, summaries.where("backend = 'view'"), "small with retrieval", "big alone")


@registered
def run_record(spark: SparkSession, folder: str) -> DataFrame:
    """One run's record from the timing log and the two-cell search."""
    asked = stored_queries(spark, folder)
    found = materialise(cell_search(spark, folder, asked, 2, carry=["source"]))
    record = run_summary(
        table(spark, folder, "events"), found, exact_gold(spark, folder, asked), asked, backend="ivf",
        index_key="vectors", metric="ip", iters=1, top_k=K, value="value", decimals=DIGITS, total_decimals=DIGITS,
    )
    mix = F.transform(F.map_entries("source_mix"), lambda e: F.concat_ws("=", e["key"], F.format_number(e["value"], 4)))
    return record.select(
        "backend", "index_key", "metric", "score_type", "iters", "top_k", "n_queries", "avg_ms", "p50_ms", "p90_ms",
        "qps", F.array_join(F.sort_array(mix), ",").alias("source_mix"), "quality.recall_at_k", "quality.mrr",
    )


# ---------------------------------------------------------------- checks


@registered
def check_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as metadata, labels as the other side: some documents have none."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("uid"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("uid"))
    return validate.check_alignment(docs, labels)


@registered
def check_alignment_sums(spark: SparkSession, folder: str) -> DataFrame:
    """The same by checksums of buckets; only those that differ are compared key by key."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("uid"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("uid"))
    return validate.check_alignment_by_sums(docs, labels)


@registered
def check_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    counts = corpus.shard_counts(corpus.hash_shards(docs.select("doc_id"), N_SHARDS, "doc_id"), N_SHARDS)
    return validate.check_shards(counts, docs.count())


@registered
def check_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("label") == 3, 2.0).otherwise(1.0))
    some = F.when(F.col("label") != 5, scaled)
    return validate.check_vectors(rows.select(some.alias("embedding")))


@registered
def check_queries(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    lines = items.select(F.col("item_id").alias("qid"), F.posexplode(F.split("text", "\n")).alias("line_no", "query"))
    blanked = F.when(F.col("line_no") == 1, F.lit(" \t\u00a0")).otherwise(F.col("query"))
    encoded = encode_queries(lines.select("qid", blanked.alias("query")), hashing_encoder(32))
    short = F.when(F.pmod("qid", F.lit(3)) == 0, F.slice("embedding", 1, 16)).otherwise(F.col("embedding"))
    return validate.check_queries(encoded.withColumn("embedding", short), 32)


@registered
def uid_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    """The text hash as uid, so that copied documents repeat within and across shards."""
    docs = corpus.hash_shards(table(spark, folder, "documents").select("doc_id", F.sha1("text").alias("uid")), N_SHARDS, "doc_id")
    return validate.uid_uniqueness(docs)


@registered
def uid_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct uids from stored sketches of the shards: within 8 % of the exact number, for each shard and for all."""
    docs = corpus.hash_shards(table(spark, folder, "documents").select("doc_id", F.sha1("text").alias("uid")), N_SHARDS, "doc_id")
    exact = validate.uid_uniqueness(docs).select("shard", F.col("distinct_uids").alias("exact"))
    with scratch_path(spark) as path:
        validate.uid_sketches(docs).write.parquet(path)
        found = validate.uid_estimates(spark.read.parquet(path)).withColumnRenamed("shard", "of")
        both = found.join(exact, F.col("of").eqNullSafe(F.col("shard")))
        near = F.abs(F.col("distinct_uids") - F.col("exact")) <= 0.08 * F.col("exact")
        return checkpoint(both.select("shard", "n_rows", F.col("exact").alias("distinct_uids"), near.alias("near")))
