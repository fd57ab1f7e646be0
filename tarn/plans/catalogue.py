"""Named queries over the test tables, each with its SQL counterpart where SQL has one.

Search queries take every benchmark text as a query, vector queries every row
whose id is divisible by 50; both run against whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as fn
from tarn.operators import blockmax, bm25, dense, encoder, evaluate, feedback, fuse, index, search, stores
from tarn.operators.chunk import chunk_documents, hard_split
from tarn.plans.oracles import ORACLES  # noqa: F401
from tarn.runtime import materialise, shared_dir, spread, table, text_batches, written
from tarn.sources import files
from tarn.streaming import expiry, ingest, observed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K = 10


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Inputs ---------------------------------------------------------------------


def documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def vector_queries(spark, d):
    return vectors(spark, d).filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), "vector")


def user_turns(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", fn.normalize_query("text").alias("normalized"))


def same_label(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "label")
    return q.join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").filter("doc_id <> query_id").select("query_id", "doc_id")


def events(spark, d):
    """The event table as feedback: a user's day is a query."""
    ranked = feedback.with_rank(feedback.from_events(table(spark, d, "events")))
    return ranked.select("query_id", "query_text", "doc_id", "rank", "event_type", "dwell_ms", "timestamp")


def scratch(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Text -----------------------------------------------------------------------


@query
def tokenize(spark, d):
    t = documents(spark, d).select("doc_id", fn.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def approx_tokens(spark, d):
    return documents(spark, d).select("doc_id", fn.approx_tokens(F.col("text")).cast("long").alias("n_tokens"))


@query
def sentence_split(spark, d):
    s = documents(spark, d).select("doc_id", fn.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


@query
def chunk_documents_512(spark, d):
    return chunk_documents(documents(spark, d)).select("chunk_id", "doc_id", "pos", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


QUERIES["chunk_documents"] = QUERIES.pop("chunk_documents_512")


@query
def chunk_small_budget(spark, d):
    return chunk_documents(documents(spark, d), 24, 6).select("chunk_id", "doc_id", "pos", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def hard_split_words(spark, d):
    plain = F.regexp_replace("text", r"[.!?]", "")
    return documents(spark, d).select("doc_id", F.posexplode(hard_split(plain, 32)).alias("pos", "piece")).select("doc_id", "pos", F.length("piece").alias("n_chars"), F.md5("piece").alias("digest"))


QUERIES["hard_split"] = QUERIES.pop("hard_split_words")


@query
def normalize_query(spark, d):
    return user_turns(spark, d)


@query
def classify_intent(spark, d):
    return user_turns(spark, d).select("conv_id", "turn", fn.classify_intent(F.col("normalized")).alias("intent"))


@query
def expand_query(spark, d):
    v = asked(spark, d).select("query_id", fn.expand_query(F.col("text")).alias("v"))
    return v.select("query_id", F.size("v").cast("long").alias("n_variants"), F.element_at("v", 1).alias("variant"))


@query
def html_doc_id(spark, d):
    return table(spark, d, "pages").select("page_id", fn.html_id(F.col("html")).alias("doc_id"))


@query
def html_extract(spark, d):
    from tarn.functions.html import extract_html

    return text_batches(table(spark, d, "pages")).select("page_id", extract_html(F.col("html")).alias("text"))


@query
def jsonl_parse(spark, d):
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "text": "'), F.col("event_type"), F.lit('", "props": '), F.col("props"), F.lit("}"))
    parsed = files.parse_json_lines(table(spark, d, "events").select(line.alias("value")))
    return parsed.select("doc_id", "text", F.get_json_object(F.col("metadata")["props"], "$.k").alias("k"))


@query
def cache_key(spark, d):
    key = fn.cache_key("search", fn.json_string(fn.normalize_query("text")), K, "hybrid", True)
    return asked(spark, d).select("query_id", key.alias("cache_key"))


# Vectors --------------------------------------------------------------------


@query
def l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(fn.l2_normalize(scaled)).alias("pos", "x"))
    return rounded(e, "x")


@query
def embed_hashing(spark, d):
    e = search.encode(documents(spark, d), "doc_id").select("doc_id", F.posexplode("vector").alias("bucket", "weight"))
    return rounded(e.filter("weight <> 0"), "weight")


@query
def flat_topk(spark, d):
    return rounded(dense.flat_search(vector_queries(spark, d), vectors(spark, d), K), "score")


@query
def flat_search(spark, d):
    return rounded(dense.flat_search(vector_queries(spark, d), vectors(spark, d), K, exclude_self=True), "score")


@query
def ivf_full_probe(spark, d):
    v = vectors(spark, d)
    centers = dense.ivf_train(v, 16)
    return rounded(dense.ivf_search(vector_queries(spark, d), dense.ivf_cells(v, centers), centers, K, n_probe=len(centers)), "score")


@query
def ivf_saved(spark, d):
    """A saved index of 16 cells, all of them probed."""
    v, path = vectors(spark, d), scratch(spark, "ivf")
    centers = dense.ivf_train(v, 16)
    dense.ivf_save(dense.ivf_cells(v, centers), centers, path)
    cells, centers = dense.ivf_load(spark, path)
    return rounded(dense.ivf_search(vector_queries(spark, d), cells, centers, K, n_probe=len(centers)), "score")


@query
def hnsw_recall(spark, d):
    v, q = vectors(spark, d), vector_queries(spark, d)
    found = materialise(index.build_index("hnsw", v).search(q, K), "hits")
    exact = dense.flat_search(q, v, K).select("query_id", "doc_id")
    return evaluate.recall_at_k(found, exact, K)


@query
def hnsw_levels(spark, d):
    """The levels that an index draws for its nodes: at each, the share of nodes there, against one in 16 a layer up."""
    v = vectors(spark, d)
    return dense.hnsw_layers(materialise(dense.hnsw_build(v), "graph", max_records=1))


@query
def hnsw_dedupe(spark, d):
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    new = old.select((F.col("doc_id") * 2).alias("doc_id"), (F.col("label") + 100).alias("label"))
    return stores.keep_first(old, new.unionByName(new.withColumn("label", F.col("label") + 100)), ["doc_id"], F.col("label"))


@query
def ingest_union(spark, d):
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return old.unionByName(old.withColumn("label", F.col("label") + 100))


@query
def index_size(spark, d):
    v = ingest_union(spark, d)
    sizes = [
        v.agg(F.lit("flat").alias("backend"), F.count("*").alias("n")),
        v.agg(F.lit("hnsw").alias("backend"), F.count_distinct("doc_id").alias("n")),
        documents(spark, d).agg(F.lit("bm25").alias("backend"), F.count("*").alias("n")),
    ]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


# BM25 and search ------------------------------------------------------------


@query
def bm25_doc_lengths(spark, d):
    return bm25.build(documents(spark, d)).lengths.select("doc_id", F.col("dl").cast("long").alias("dl"))


@query
def bm25_corpus_stats(spark, d):
    return rounded(bm25.corpus_statistics(bm25.build(documents(spark, d))), "avgdl", "mean_idf")


def term_digests(terms):
    """All terms with their statistics, by 256 buckets of their hash: numbers, and a digest over every row in the order of terms."""
    line = F.concat_ws(":", "term", F.col("df").cast("string"), F.round(F.col("idf") * 1_000_000).cast("long").cast("string"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("term", line.alias("line")))), lambda x: x["line"]), ",")
    return terms.groupBy(F.substring(F.md5("term"), 1, 2).alias("bucket")).agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.md5(told).alias("digest"))


@query
def bm25_term_stats(spark, d):
    return rounded(bm25.build(documents(spark, d)).terms.select("term", "df", "idf"), "idf")


def sparse_list(spark, d, k):
    return bm25.search(bm25.build(documents(spark, d)), asked(spark, d), k)


def dense_list(spark, d, k):
    return search.search_dense(search.encode(documents(spark, d), "doc_id"), asked(spark, d), k)


@query
def bm25_topk(spark, d):
    return rounded(sparse_list(spark, d, K), "score")


@query
def bm25_blockmax(spark, d):
    """The hits of ``bm25_topk`` over postings in blocks."""
    return rounded(blockmax.search(blockmax.build(bm25.build(documents(spark, d))), asked(spark, d), K), "score")


@query
def rrf_fuse(spark, d):
    return rounded(fuse.rrf_fuse([dense_list(spark, d, K), sparse_list(spark, d, K)]), "score", digits=9)


@query
def rrf_top_k(spark, d):
    return rounded(fuse.rrf_fuse([dense_list(spark, d, K), sparse_list(spark, d, K)], top=5), "score", digits=9)


def searched(spark, d, **how):
    docs = documents(spark, d)
    return search.search(search.encode(docs, "doc_id"), bm25.build(docs), asked(spark, d), k=K, **how)


@query
def search_dense(spark, d):
    return rounded(searched(spark, d, strategy="dense", rerank=False), "score")


@query
def search_sparse(spark, d):
    return rounded(searched(spark, d, strategy="sparse", rerank=False), "score")


@query
def search_hybrid(spark, d):
    return rounded(searched(spark, d, strategy="hybrid", rerank=False), "score", digits=9)


@query
def search_hnsw(spark, d):
    """Recall of the dense strategy over an HNSW index of all documents, by query, against the flat one."""
    docs = documents(spark, d)
    made = index.build_index("hnsw", search.encode(docs, "doc_id"))
    return evaluate.recall_at_k(materialise(search.search_dense(made, asked(spark, d), K), "hits"), search.search_dense(search.encode(docs, "doc_id"), asked(spark, d), K), K)


@query
def search_hybrid_overfetch(spark, d):
    return rounded(searched(spark, d, strategy="hybrid", rerank=True), "score", digits=9)


@query
def search_fallback(spark, d):
    hits = dense_list(spark, d, K)
    return rounded(fuse.hybrid(hits, hits.filter(F.lit(False)), K), "score")


@query
def rerank_topk(spark, d):
    docs = documents(spark, d)
    return rounded(fuse.rerank(searched(spark, d, strategy="hybrid", rerank=False), asked(spark, d), docs, top=K), "score")


# Stores ---------------------------------------------------------------------


@query
def doc_store_lookup(spark, d):
    store = documents(spark, d).withColumnRenamed("doc_id", "chunk_id")
    known = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"))
    found = stores.text_lookup(known.unionByName(known.select((-F.col("chunk_id") - 1).alias("chunk_id"))), store)
    return found.select("chunk_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query
def doc_store_upsert(spark, d):
    store = documents(spark, d).withColumnRenamed("doc_id", "chunk_id")
    new = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"))
    return stores.upsert(store, new, ["chunk_id"]).select("chunk_id", F.md5("text").alias("digest"))


def keyed(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.text_key(F.col("text")).alias("key"), F.lit(64).alias("dim"))


@query
def embed_cache_lookup(spark, d):
    k = keyed(spark, d)
    cache = k.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("key", "dim").distinct()
    return stores.embedding_lookup(k, cache, 64)


@query
def embed_cached(spark, d):
    """Vectors of all texts, those that ``labels`` covers from a cache that holds the vector of another text for them."""
    texts = keyed(spark, d).join(documents(spark, d), "doc_id").select("doc_id", "key", "text")
    known = texts.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("key", F.lit("the text of the cache").alias("text")).distinct()
    encode = lambda rows: search.encode(rows, "key")
    cache = encode(known).withColumn("dim", F.lit(64))
    found, _ = stores.embed_cached(texts, cache, encode, 64)
    return rounded(found.select("key", "hit", F.posexplode("vector").alias("bucket", "weight")).filter("weight <> 0"), "weight")


@query
def embed_cache_upsert(spark, d):
    k = keyed(spark, d).select("key", F.col("doc_id").alias("version"))
    again = k.join(table(spark, d, "labels").select(F.col("doc_id").alias("version")), "version", "left_semi").select("key", (F.col("version") + 1_000_000).alias("version"))
    stored = stores.keep_last(k, ["key"], F.col("version"))
    return stores.upsert(stored, stores.keep_last(again, ["key"], F.col("version")), ["key"])


@query
def query_cache_ttl(spark, d):
    cache = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return stores.live(cache, F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).select("event_id")


@query
def limit_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(100)


# Evaluation -----------------------------------------------------------------


def ranked(spark, d):
    return dense.flat_search(vector_queries(spark, d), vectors(spark, d), K)


@query
def recall_at_k(spark, d):
    return rounded(evaluate.recall_at_k(ranked(spark, d), same_label(spark, d), K), "recall")


@query
def mrr_at_k(spark, d):
    return rounded(evaluate.mrr_at_k(ranked(spark, d), same_label(spark, d), K), "rr")


@query
def ndcg_at_k(spark, d):
    return rounded(evaluate.ndcg_at_k(ranked(spark, d), same_label(spark, d), K), "ndcg")


@query
def benchmark_report(spark, d):
    return rounded(evaluate.benchmark_report(ranked(spark, d), same_label(spark, d), K), "recall", "mrr", "ndcg")


@query
def benchmark_pseudo(spark, d):
    """The report where only queries of even labels have judgements: the exact hits stand in for the others."""
    even = table(spark, d, "embeddings").filter("label % 2 = 0").select(F.col("vec_id").alias("query_id"))
    report = evaluate.benchmark_report(ranked(spark, d), same_label(spark, d).join(even, "query_id", "left_semi"), K, baseline=ranked(spark, d))
    return rounded(report, "recall", "mrr", "ndcg")


@query
def latency_percentiles(spark, d):
    return rounded(evaluate.latency_percentiles(table(spark, d, "events"), "value"), "p50", "p90", "p95", "p99", "mean")


@query
def latency_by_type(spark, d):
    """Percentiles by event type, in buffers of a hundred values at most."""
    return rounded(evaluate.percentiles(table(spark, d, "events"), "value", labels=("event_type",), hold=100), "value")


@query
def metrics_histogram(spark, d):
    seconds = table(spark, d, "events").select("event_type", (F.col("value") / 1000).alias("s"))
    return rounded(evaluate.histogram(seconds, "s", labels=("event_type",)), "sum")


def timed(spark, d, buckets):
    return evaluate.histogram(table(spark, d, "events").select("event_type", (F.col("value") / 1000).alias("s")), "s", buckets, labels=("event_type",))


@query
def metrics_retrieval(spark, d):
    return rounded(timed(spark, d, evaluate.RETRIEVAL_BUCKETS), "sum")


@query
def metrics_rerank(spark, d):
    return rounded(timed(spark, d, evaluate.RERANK_BUCKETS), "sum")


@query
def metrics_counters(spark, d):
    """Hits and misses of the embedding cache as lines of the exposition format."""
    k = keyed(spark, d)
    cache = k.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("key", "dim").distinct()
    looked = stores.embedding_lookup(k, cache, 64).select(F.lit("embedding").alias("layer"), F.when(F.col("hit"), "hit").otherwise("miss").alias("outcome"))
    return evaluate.samples(evaluate.counter(looked, ("layer", "outcome")), "tarn_cache_lookups_total", "counter", ("layer", "outcome"))


@query
def metrics_exposition(spark, d):
    """The request histogram's lines but for its sums, whose last digits depend on the order of adding."""
    lines = evaluate.exposition(timed(spark, d, evaluate.REQUEST_BUCKETS), "tarn_request_duration_seconds", ("event_type",), "Request latency")
    return lines.filter(~F.col("line").startswith("tarn_request_duration_seconds_sum"))


# Feedback -------------------------------------------------------------------


@query
def feedback_scan(spark, d):
    return events(spark, d).orderBy("query_id", "rank")


@query
def feedback_groups(spark, d):
    g = feedback.groups(events(spark, d))
    item = lambda e: F.concat_ws(":", e["rank"].cast("string"), e["doc_id"], e["event_type"])
    return g.select("query_id", F.size("events").cast("long").alias("n"), F.array_join(F.transform("events", item), ",").alias("events"))


@query
def feedback_event_counts(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


@query
def feedback_min_clicks(spark, d):
    return feedback.min_clicks(events(spark, d), 2)


@query
def feedback_triples(spark, d):
    return feedback.triples(events(spark, d))


@query
def training_pairs(spark, d):
    return feedback.training_pairs(feedback.triples(events(spark, d)))


@query
def pairwise_mrr(spark, d):
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("double")
    t = feedback.triples(events(spark, d)).select(number("pos_doc_id").alias("pos_score"), number("neg_doc_id").alias("neg_score"))
    return rounded(feedback.pairwise_mrr(t), "mrr")


@query
def train_eval_split(spark, d):
    return feedback.split(feedback.triples(events(spark, d))).select("query_id", "pos_doc_id", "neg_doc_id", "part")


@query
def synth_clicks(spark, d):
    return feedback.synthetic_clicks(spark, 500)


# Streams --------------------------------------------------------------------


def stream_of(spark, d, name):
    """The table's files as a stream; the table is a file or a folder of files."""
    path = f"{d}/{name}.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema)
    if any(f"/{name}.parquet/" in f for f in batch.inputFiles()[:1]):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query
def stream_ingest(spark, d):
    out = scratch(spark, "stream-chunks")
    docs = stream_of(spark, d, "documents").select("doc_id", "text")
    ingest.chunk_stream(docs, out, scratch(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out).select("chunk_id", "doc_id", "pos", F.md5("text").alias("digest"))


@query
def stream_index(spark, d):
    """Term statistics of a live index fed by a stream of documents."""
    path = scratch(spark, "live")
    ingest.index_stream(stream_of(spark, d, "documents").select("doc_id", "text"), path, scratch(spark, "stream-state")).awaitTermination()
    _, _, made = ingest.live_index(spark, path)
    return term_digests(made.terms)


@query
def stream_feedback(spark, d):
    out = scratch(spark, "stream-feedback")
    rows = stream_of(spark, d, "events").select("event_id", F.concat(F.lit("doc_"), F.get_json_object("props", "$.k")).alias("doc_id"), "event_type", "value")
    ingest.feedback_stream(rows, out, scratch(spark, "stream-state")).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_triples(spark, d):
    """Triples of complete queries out of a stream of events. A last event, a month on, tells that all before it are complete."""
    state, beat = scratch(spark, "stream-state"), scratch(spark, "heartbeat")
    raw = table(spark, d, "events")
    far = raw.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(None).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props"))
    far.write.parquet(beat)
    arriving = stream_of(spark, d, "events").select(*far.columns).unionByName(spark.readStream.schema(far.schema).parquet(beat))
    out = scratch(spark, "stream-triples")
    ingest.triple_stream(feedback.from_events(arriving).withColumn("ts", F.timestamp_micros("at")), out, state).awaitTermination()
    return spark.read.schema("query_id string, query_text string, pos_doc_id string, neg_doc_id string").parquet(out)


@query
def stream_cache_ttl(spark, d):
    """A cache with a time to live as the state of a stream: what has run out by noon of 15 January, and what is alive then.

    An entry is a user's answer of a kind, put by each event up to then; a last put, at noon, tells the time.
    """
    keys, noon, beat = ["user_id", "event_type"], F.lit("2024-01-15 12:00:00").cast("timestamp"), scratch(spark, "clock")
    table(spark, d, "events").agg(F.count("*")).select(F.lit(None).cast("long").alias("user_id"), F.lit("clock").alias("event_type"), noon.alias("ts"), F.lit(-1).cast("long").alias("value")).write.parquet(beat)
    clock = spark.read.parquet(beat)
    puts = stream_of(spark, d, "events").select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("value")).filter(F.col("ts") <= noon)
    out, state = scratch(spark, "expired"), scratch(spark, "stream-state")
    expiry.entry_stream(puts.unionByName(spark.readStream.schema(clock.schema).parquet(beat)), keys, out, state).awaitTermination()
    alive = expiry.live_entries(spark, state, keys)
    gone = spark.read.schema(alive.schema).parquet(out)
    entries = gone.withColumn("alive", F.lit(False)).unionByName(alive.withColumn("alive", F.lit(True))).filter("NOT event_type <=> 'clock'")
    micros = lambda c: F.unix_micros(c).alias(c)
    return entries.select(*keys, "value", micros("first_put"), micros("last_put"), micros("runs_out"), "n_puts", "alive")


@query
def stream_metrics(spark, d):
    """Sizes of the chunks that a stream of documents gives, as the stream itself has observed them."""
    told = scratch(spark, "observed")
    docs = stream_of(spark, d, "documents").select("doc_id", "text")
    start = lambda: ingest.chunk_stream(docs, scratch(spark, "stream-chunks"), scratch(spark, "stream-state"), observe="tarn_chunks")
    observed.reported(start, spark, "tarn_chunks", told, ingest.CHUNK_BUCKETS)
    return observed.totals(spark, told, ingest.CHUNK_BUCKETS, "chunks")


@query
def encoder_known_item(spark, d):
    """Known-item search with the learnt and the hashing encoder: of each document whose id is divisible by 50
    the sentence in the middle is asked; found is a document of the same text among the first ten of all."""
    docs = materialise(documents(spark, d).filter("text IS NOT NULL"), "texts")
    s = docs.filter("doc_id % 50 = 0").withColumn("s", fn.sentences(F.col("text"))).filter("size(s) > 0")
    asked_ = s.select(F.col("doc_id").alias("query_id"), F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("q"), F.md5("text").alias("item"))
    asked_, keys = materialise(asked_, "asked"), docs.select("doc_id", F.md5("text").alias("found"))
    learnt = encoder.fit(docs)
    ways = {"hashing": search.encode, "learnt": learnt.encode}
    rows = []
    for name, encode in ways.items():
        hits = dense.flat_search(encode(asked_, "query_id", "q"), encode(docs, "doc_id"), K)
        seen = hits.join(keys, "doc_id").join(asked_.select("query_id", F.col("item").alias("found")), ["query_id", "found"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
        rows.append(asked_.select("query_id").join(seen, "query_id", "left").select(F.lit(name).alias("encoder"), "query_id", "rank"))
    return rows[0].unionByName(rows[1])
