"""Retrieval metrics, latency summaries and histograms as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.runtime import materialise

# Upper bounds of the histogram buckets in seconds.
REQUEST_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
RETRIEVAL_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5)
RERANK_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)


def _judged(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Hits up to ``k`` with a flag; ``relevant`` is (query_id, doc_id), distinct."""
    flags = relevant.select("query_id", "doc_id", F.lit(True).alias("hit"))
    return ranked.filter(F.col("rank") < k).join(flags, ["query_id", "doc_id"], "left")


def _per_query(ranked: DataFrame, relevant: DataFrame, aggregated: DataFrame, name: str) -> DataFrame:
    """Every query of the result or the judgements, zero where nothing was found."""
    asked = ranked.select("query_id").unionByName(relevant.select("query_id")).distinct()
    return asked.join(aggregated, "query_id", "left").select("query_id", F.coalesce(name, F.lit(0.0)).alias(name))


def recall_at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, recall``: found relevant documents by all; zero if there are none."""
    found = _judged(ranked, relevant, k).filter("hit").groupBy("query_id").agg(F.count_distinct("doc_id").alias("found"))
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    out = found.join(totals, "query_id").select("query_id", (F.col("found") / F.col("n")).alias("recall"))
    return _per_query(ranked, relevant, out, "recall")


def mrr_at_k(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rr``: one by the place of the first relevant hit, else zero."""
    out = _judged(ranked, relevant, k).filter("hit").groupBy("query_id").agg((1.0 / (F.min("rank") + 1)).alias("rr"))
    return _per_query(ranked, relevant, out, "rr")


def ndcg_at_k(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, ndcg``: binary gains; a repeated hit gains each time."""
    gained = _judged(ranked, relevant, k).filter("hit").groupBy("query_id").agg(F.sum(1.0 / F.log2(F.col("rank") + 2.0)).alias("dcg"))
    totals = relevant.groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = gained.join(totals, "query_id").select("query_id", (F.col("dcg") / ideal).alias("ndcg"))
    return _per_query(ranked, relevant, out, "ndcg")


def latency_percentiles(samples: DataFrame, value_col: str) -> DataFrame:
    """One row ``p50, p90, p95, p99, mean, n`` by linear interpolation; zeros when empty."""
    v = F.col(value_col)
    p = F.percentile(v, F.array(*(F.lit(x) for x in (0.5, 0.9, 0.95, 0.99))))
    row = samples.agg(p.alias("p"), F.avg(v).alias("mean"), F.count(v).alias("n"))
    zero = F.lit(0.0)
    return row.select(*(F.coalesce(F.col("p")[i], zero).alias(name) for i, name in enumerate(("p50", "p90", "p95", "p99"))), F.coalesce("mean", zero).alias("mean"), "n")


def percentiles(samples: DataFrame, value_col: str, *, labels: tuple[str, ...] = (), points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), hold: int = 65_536) -> DataFrame:
    """``labels, p, value, n``: exact percentiles by linear interpolation, in bounded buffers.

    The two places in the order of values that a percentile lies between are looked for
    in a bracket, all values at first. A pass over the samples counts what lies below
    each bracket and in it, and sketches the values in it (KLL, which merges); the sketch
    tells where to narrow the bracket, the counts keep it exact. A bracket of at most
    ``hold`` values is sorted; no buffer holds more than that, or a sketch. Each pass
    leaves about a twentieth of a bracket, or takes a value off that fills most of it. Null and NaN values are left out, and so are
    labels without values; null labels are a label.
    """
    v = F.col(value_col).cast("double")
    rows = samples.select(*labels, v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    name = F.struct(*(F.col(c) for c in labels)) if labels else F.lit(0)
    rows = rows.withColumn("label", F.xxhash64(F.to_json(F.struct(name.alias("l")))) if labels else F.lit(0).cast("long"))
    sizes = rows.groupBy("label", *labels).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.explode(F.array(*map(F.lit, points))).alias("p")
    wanted = sizes.select("label", *labels, "n", "low", "high", at).withColumn("place", F.col("p") * (F.col("n") - 1))
    ends = F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")
    # A row for each label, point and end: as many as the answer has, twice over.
    open_ = materialise(wanted.select("label", ends, "low", "high").distinct(), "brackets")
    done = []
    while open_.head(1):
        met = rows.join(F.broadcast(open_), "label").filter(F.col("v") <= F.col("high"))
        inside = F.col("v") >= F.col("low")
        held = met.groupBy("label", "rank", "low", "high").agg(
            F.count_if(~inside).alias("below"), F.count_if(inside).alias("inside"), F.kll_sketch_agg_double(F.when(inside, F.col("v")), F.lit(800)).alias("sketch")
        )
        held = materialise(held, "brackets")
        known = held.filter("low = high").select("label", "rank", F.col("low").alias("value"))
        small = held.filter(f"low < high AND inside <= {hold}")
        within = rows.join(F.broadcast(small.select("label", "rank", "low", "high", "below")), "label").filter("v BETWEEN low AND high")
        found = within.groupBy("label", "rank", "below").agg(F.sort_array(F.collect_list("v")).alias("all")).select("label", "rank", F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("value"))
        done.append(materialise(known.unionByName(found), "places"))
        share = (F.col("rank") - F.col("below") + 0.5) / F.col("inside")
        steps = F.array(*(F.lit(i / 50) for i in range(51)))
        narrow = held.filter(f"low < high AND inside > {hold}").withColumn("q", F.kll_sketch_get_quantile_double("sketch", steps)).withColumn("at", share * 50)
        narrow = narrow.withColumn("a", F.get("q", F.greatest(F.floor("at") - 1, F.lit(0)).cast("int"))).withColumn("b", F.get("q", F.least(F.ceil("at") + 1, F.lit(50)).cast("int")))
        # Where the steps don't part the bracket, its least value is told from the others.
        whole = (F.col("a") <= F.col("low")) & (F.col("b") >= F.col("high"))
        narrow = narrow.withColumn("b", F.when(whole, F.col("low")).otherwise(F.col("b")))
        open_ = materialise(_checked_brackets(rows, narrow), "brackets")
    values = reduce(DataFrame.unionByName, done) if done else rows.sparkSession.createDataFrame([], "label long, rank long, value double")
    value = lambda c: values.select("label", F.col("rank").alias(c), F.col("value").alias(f"v_{c}"))
    both = wanted.withColumn("lo", F.floor("place")).withColumn("hi", F.ceil("place")).join(value("lo"), ["label", "lo"]).join(value("hi"), ["label", "hi"])
    mixed = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("place") - F.col("lo"))
    return both.select(*labels, "p", mixed.alias("value"), "n")


def _checked_brackets(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Brackets cut to ``a`` to ``b`` if the place is there by count; to the side of them where it is, if not."""
    counted = rows.join(F.broadcast(narrow.select("label", "rank", "low", "high", "a", "b")), "label").groupBy("label", "rank", "low", "high", "a", "b")
    counted = counted.agg(F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if(F.col("v") <= F.col("b")).alias("upto"), F.max(F.when(F.col("v") < F.col("a"), F.col("v"))).alias("before"), F.min(F.when(F.col("v") > F.col("b"), F.col("v"))).alias("after"))
    low = F.when(F.col("rank") < F.col("under"), F.col("low")).when(F.col("rank") < F.col("upto"), F.col("a")).otherwise(F.col("after"))
    high = F.when(F.col("rank") < F.col("under"), F.col("before")).when(F.col("rank") < F.col("upto"), F.col("b")).otherwise(F.col("high"))
    return counted.select("label", "rank", low.alias("low"), high.alias("high"))


def histogram(samples: DataFrame, value_col: str, buckets=REQUEST_BUCKETS, labels: tuple[str, ...] = ()) -> DataFrame:
    """``labels, le, cumulative, total, sum``: counts up to each bound, ``+Inf`` last."""
    v = F.col(value_col)
    counts = [F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    row = samples.groupBy(*labels).agg(*counts, F.count(v).alias("total"), F.sum(v).alias("sum"))
    bounds = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(buckets)), F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("cumulative")))
    return row.select(*labels, F.explode(bounds).alias("b"), "total", "sum").select(*labels, "b.le", "b.cumulative", "total", "sum")


def counter(events: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``labels, value``: events by label, as of cache hits and misses by layer."""
    return events.groupBy(*labels).agg(F.count("*").cast("double").alias("value"))


def _sample(name: str, labels: tuple[str, ...], value, **more):
    """A line ``name{label="value",...} number``; quotes, backslashes and line ends in values are escaped."""

    def quoted(c):
        text = F.coalesce(c.cast("string"), F.lit(""))
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.concat(F.lit('"'), text, F.lit('"'))

    parts = [F.concat(F.lit(f"{n}="), quoted(c)) for n, c in [*((x, F.col(x)) for x in labels), *more.items()]]
    inside = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("")
    return F.concat(F.lit(name), inside, F.lit(" "), value.cast("string"))


def exposition(histograms: DataFrame, name: str, labels: tuple[str, ...] = (), help: str = "") -> DataFrame:
    """Histogram rows as lines of the text exposition format: type, buckets, sum and count of each label set."""
    head = histograms.sparkSession.createDataFrame([(line,) for line in ([f"# HELP {name} {help}"] if help else []) + [f"# TYPE {name} histogram"]], "line string")
    buckets = histograms.select(_sample(f"{name}_bucket", labels, F.col("cumulative"), le=F.col("le")).alias("line"))
    once = histograms.filter("le = '+Inf'")
    sums = once.select(_sample(f"{name}_sum", labels, F.coalesce("sum", F.lit(0.0))).alias("line"))
    return head.unionByName(buckets).unionByName(sums).unionByName(once.select(_sample(f"{name}_count", labels, F.col("total")).alias("line")))


def samples(values: DataFrame, name: str, kind: str, labels: tuple[str, ...] = ()) -> DataFrame:
    """Counters (``kind`` counter) or gauges (gauge) with ``labels, value`` as lines of the text exposition format."""
    head = values.sparkSession.createDataFrame([(f"# TYPE {name} {kind}",)], "line string")
    return head.unionByName(values.select(_sample(name, labels, F.col("value").cast("double")).alias("line")))


def benchmark_report(ranked: DataFrame, relevant: DataFrame, k: int = 10, baseline: DataFrame | None = None) -> DataFrame:
    """One row ``recall, mrr, ndcg, n_queries``: means over all queries, zeros included.

    With a ``baseline`` (hits of the exact search) its hits stand in for the queries
    without judgements.
    """
    if baseline is not None:
        relevant = with_pseudo_judgements(relevant, baseline)
    joined = recall_at_k(ranked, relevant, k).join(mrr_at_k(ranked, relevant, k), "query_id").join(ndcg_at_k(ranked, relevant, k), "query_id")
    return joined.agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.count("*").alias("n_queries"))


def with_pseudo_judgements(relevant: DataFrame, baseline: DataFrame) -> DataFrame:
    """The baseline's hits stand in for queries without judgements."""
    rest = baseline.join(relevant.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id").distinct()
    return relevant.select("query_id", "doc_id").unionByName(rest)
