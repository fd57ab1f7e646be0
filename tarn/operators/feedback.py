"""Feedback events: groups, skip-above triples and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.runtime import materialise

EVENT_TYPES = ("click", "dwell", "skip", "exit")
SCHEMA = "query_id string, query_text string, doc_id string, rank int, event_type string, dwell_ms int, timestamp double"


def validated(events: DataFrame) -> DataFrame:
    """Fails on unknown types, negative ranks and negative dwell times."""
    ok = F.col("event_type").isin(*EVENT_TYPES) & (F.col("rank") >= 0) & (F.coalesce("dwell_ms", F.lit(0)) >= 0)
    return events.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("invalid feedback event")).cast("boolean")))


def from_events(events: DataFrame) -> DataFrame:
    """The raw event table (event_id, ts, user_id, event_type, value, props) as feedback
    without ranks: a user's day is a query. ``at`` is the time in microseconds, ``day``
    the date; an event of another type has a null type."""
    kinds = {"click": "click", "view": "skip", "purchase": "dwell", "error": "exit", "signup": "skip"}
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    user, day = F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")
    return events.select(
        "event_id",
        F.concat(user, F.lit("-"), day).alias("query_id"),
        F.concat(F.lit("user "), user).alias("query_text"),
        F.concat(F.lit("doc_"), F.get_json_object("props", "$.k")).alias("doc_id"),
        kind[F.col("event_type")].alias("event_type"),
        F.when(F.col("event_type") == "purchase", F.floor(F.col("value") * 100).cast("int")).alias("dwell_ms"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        day.alias("day"),
    )


def with_rank(events: DataFrame) -> DataFrame:
    """Adds the ``rank`` of each event in its query by time, and its ``timestamp`` in seconds."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "event_id")) - 1
    return events.withColumn("rank", rank).withColumn("timestamp", F.col("at") / 1e6)


def groups(events: DataFrame) -> DataFrame:
    """``query_id, events``: events of a query by rank."""
    item = F.struct("rank", "doc_id", "event_type")
    return events.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("events"))


def min_clicks(events: DataFrame, n: int = 1) -> DataFrame:
    """Queries with at least ``n`` click rows, and their number."""
    return events.groupBy("query_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks")).filter(F.col("clicks") >= n)


def triples(events: DataFrame, n: int = 1) -> DataFrame:
    """``query_id, query_text, pos_doc_id, neg_doc_id``: a click against every row
    of the same query that was ranked above it and not clicked. Each click row
    counts, as does each skipped row."""
    asked = min_clicks(events, n).select("query_id")
    clicks = events.filter(F.col("event_type") == "click").join(asked, "query_id", "left_semi").alias("c")
    others = events.filter(F.col("event_type") != "click").alias("o")
    on = (F.col("c.query_id") == F.col("o.query_id")) & (F.col("o.rank") < F.col("c.rank"))
    return clicks.join(others, on).select("c.query_id", "c.query_text", F.col("c.doc_id").alias("pos_doc_id"), F.col("o.doc_id").alias("neg_doc_id"))


def triples_of(queries: DataFrame, n: int = 1) -> DataFrame:
    """``triples`` of whole queries as arrays: ``query_id``, and ``e``, its events in their
    order with ``doc_id, event_type, query_text``. No join, as nothing lies elsewhere."""
    clicked = lambda x: x["event_type"] == "click"
    places = F.filter(F.sequence(F.lit(0), F.size("e") - 1), lambda i: clicked(F.get("e", i)))
    above = lambda i: F.filter(F.slice("e", F.lit(1), i), lambda x: ~clicked(x))
    pairs = F.transform(places, lambda i: F.transform(above(i), lambda x: F.struct(F.get("e", i)["query_text"].alias("query_text"), F.get("e", i)["doc_id"].alias("pos_doc_id"), x["doc_id"].alias("neg_doc_id"))))
    enough = queries.filter((F.size("e") > 0) & (F.size(F.filter("e", clicked)) >= n))
    return enough.select("query_id", F.explode(F.flatten(pairs)).alias("p")).select("query_id", "p.*")


def training_pairs(mined: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """``query_text, doc_id, label``: a positive and a negative row per triple,
    with the document's text where ``documents`` (doc_id, text) are given."""
    pair = F.explode(F.array(F.struct(F.col("pos_doc_id").alias("doc_id"), F.lit(1.0).alias("label")), F.struct(F.col("neg_doc_id").alias("doc_id"), F.lit(0.0).alias("label"))))
    pairs = mined.select("query_text", pair.alias("p")).select("query_text", "p.doc_id", "p.label")
    if documents is None:
        return pairs
    return pairs.join(documents.select("doc_id", "text"), "doc_id", "left").select("query_text", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def pairwise_mrr(scored: DataFrame) -> DataFrame:
    """One row: the mean of 1 where ``pos_score > neg_score`` and 1/2 elsewhere."""
    return scored.agg(F.coalesce(F.avg(F.when(F.col("pos_score") > F.col("neg_score"), 1.0).otherwise(0.5)), F.lit(0.0)).alias("mrr"), F.count("*").alias("n"))


def split(mined: DataFrame, *, seed: int = 42, eval_share: float = 0.1, max_rows: int | None = None) -> DataFrame:
    """Adds ``part``: a seeded order by hash, cut at ``max_rows``; the first tenth
    (one row at least) is for evaluation.

    The place in the order comes from hash buckets and their offsets, so rows
    are ranked inside a bucket and never all in one task.
    """
    text = F.concat_ws("|", F.lit(str(seed)), "query_id", "pos_doc_id", "neg_doc_id")
    keyed = mined.withColumn("_key", F.md5(text)).withColumn("_bucket", F.substring("_key", 1, 2))
    sizes = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_bucket", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key")) + F.col("_before")
    placed = keyed.join(F.broadcast(offsets), "_bucket").withColumn("_rank", rank)  # 256 buckets at most
    total = F.least(F.col("_all"), F.lit(max_rows)) if max_rows is not None else F.col("_all")
    evaluated = F.greatest(F.lit(1), F.floor(total * eval_share))
    return placed.filter(F.col("_rank") <= total).withColumn("part", F.when(F.col("_rank") <= evaluated, "eval").otherwise("train")).drop("_key", "_bucket", "_before", "_all", "_rank")


def synthetic_clicks(spark, n_queries: int, results: int = 10, seed: int = 42) -> DataFrame:
    """Clicks with position bias, and skips for the rest of each result list."""
    shown = spark.range(n_queries).select(F.concat(F.lit("q"), F.col("id")).alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(results - 1))).alias("rank"))
    quality = (F.lit(results) - F.col("rank")) / results
    clicked = F.rand(seed) < quality / (F.col("rank") + 1)
    return shown.select(
        "query_id", F.concat(F.lit("query "), F.substring("query_id", 2, 20)).alias("query_text"), F.concat(F.lit("doc_"), F.col("rank")).alias("doc_id"), "rank",
        F.when(clicked, "click").otherwise("skip").alias("event_type"), F.lit(None).cast("int").alias("dwell_ms"), F.col("rank").cast("double").alias("timestamp"),
    )


def train_reranker(pairs: DataFrame):
    """Logistic regression on lexical features of (query_text, text, label)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    model = Pipeline(stages=[VectorAssembler(inputCols=["overlap", "length"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol="label")])
    return model.fit(with_lexical_features(pairs))


def reranker_report(mined: DataFrame, documents: DataFrame, *, seed: int = 42, eval_share: float = 0.1, max_rows: int | None = None) -> tuple[object, dict]:
    """A reranker trained on mined triples, and how it orders those held out.

    The report has ``mrr_before`` (the lexical overlap alone) and ``mrr_after`` on the
    evaluation part, ``uplift``, ``n_train`` and ``n_eval``. No triples are an error.
    ``documents`` (doc_id, text) gives the texts; a document without one has an empty text.
    """
    from pyspark.ml.functions import vector_to_array

    parted = materialise(split(mined, seed=seed, eval_share=eval_share, max_rows=max_rows), "triples")
    sizes = {r.part: r["count"] for r in parted.groupBy("part").count().collect()}
    if not sizes:
        raise ValueError("no training triples: collect feedback, or make synthetic clicks, first")
    model = train_reranker(training_pairs(parted.filter("part = 'train'"), documents))
    texts = documents.select("doc_id", "text")
    held = parted.filter("part = 'eval'").withColumn("row", F.monotonically_increasing_id())
    held = materialise(held.select("row", "query_text", F.explode(F.array(F.struct(F.col("pos_doc_id").alias("doc_id"), F.lit(True).alias("pos")), F.struct(F.col("neg_doc_id").alias("doc_id"), F.lit(False).alias("pos")))).alias("p")), "held-out")
    pairs = held.select("row", "query_text", "p.doc_id", "p.pos").join(texts, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    scored = model.transform(with_lexical_features(pairs)).select("row", "pos", "overlap", vector_to_array("probability")[1].alias("probability"))
    mrr = {}
    for name, score in (("mrr_before", "overlap"), ("mrr_after", "probability")):
        both = scored.groupBy("row").agg(F.max(F.when(F.col("pos"), F.col(score))).alias("pos_score"), F.max(F.when(~F.col("pos"), F.col(score))).alias("neg_score"))
        mrr[name] = pairwise_mrr(both).first()["mrr"]
    return model, mrr | {"uplift": mrr["mrr_after"] - mrr["mrr_before"], "n_train": sizes.get("train", 0), "n_eval": sizes.get("eval", 0)}


def with_lexical_features(pairs: DataFrame) -> DataFrame:
    from tarn.operators.fuse import lexical_score

    return pairs.withColumn("overlap", lexical_score(F.col("query_text"), F.col("text"))).withColumn("length", F.log1p(F.length("text").cast("double")))
