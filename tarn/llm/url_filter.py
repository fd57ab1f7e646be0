"""URL filtering with rules and gradient-boosted trees, in DataFrame functions.

Host and path are cut out of the URL, rules match a host with its subdomains and
the start of the path, and the longest rule decides. URLs that a rule decides are
labelled examples: boosted trees learn their verdicts from lexical features
(length, depth, digit ratio, entropy, parameter counts, shapes of the path's
segments, suffix statistics) and decide the rest. Features, training and scoring
are DataFrame and SQL expressions; the trained trees run as one expression per row.

Suffix statistics are the share of blocked URLs among the labelled ones of a host's
last label, of a first path segment, and of both together. They are counted over
all labelled URLs, in two halves by hash: a URL that is learnt from sees the shares
of the other half, so that its own verdict is no part of them. A share is smoothed by
one URL of each verdict, so a key without labelled URLs has one half.

The trees are fitted on at most ``sample_rows`` labelled URLs, those with the
smallest hash. Only these are joined with the statistics; the URL alone chooses them.

The labels are verdicts of rules on host and path, so some features hand the rules
over: ``f_suffix`` the host's part of a rule, ``f_segment``, ``f_both``, ``f_first``
and ``f_lead`` the path's. ``quality`` can leave features out to tell what others know.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.runtime import materialise

#: (host, path, verdict): the rule's text is host followed by path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = {"f_suffix": ["suffix"], "f_segment": ["segment"], "f_both": ["suffix", "segment"]}
FEATURES = ["f_length", "f_host", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_query", "f_fragment", "f_extension", "f_first", "f_lead", "f_run", *KEYS]


def with_parts(df: DataFrame, url: Column) -> DataFrame:
    """Adds ``host`` (after the first ``://``, A-Z lower-cased) and ``path``."""
    parts = r"(?s)://([^/?#]*)([^?#]*)"
    return df.withColumn("host", F.coalesce(F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.lit(""))).withColumn(
        "path", F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))
    )


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest fitting rule; null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))

    def fits(host: str, path: str) -> Column:
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)

    def first(values) -> Column:
        return F.coalesce(*(F.when(fits(h, p), F.lit(v)) for (h, p, _), v in zip(ordered, values)), F.lit(None).cast("string"))

    return df.withColumn("rule", first([h + p for h, p, _ in ordered])).withColumn("rule_verdict", first([v for *_, v in ordered]))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits: runs of the sorted characters, in one pass."""
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    log = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(acc, c):
        same = acc["last"] == c
        return F.struct(
            c.alias("last"),
            F.when(same, acc["run"] + 1).otherwise(1.0).alias("run"),
            F.when(same, acc["sum"]).otherwise(acc["sum"] + log(acc["run"])).alias("sum"),
        )

    n = F.length(text).cast("double")
    total = F.aggregate(F.sort_array(F.split(text, "")), start, step, lambda acc: acc["sum"] + log(acc["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def with_features(df: DataFrame, url: Column) -> DataFrame:
    """Adds the lexical features, but for the statistics, and their keys ``suffix`` and ``segment``."""
    text = F.coalesce(url, F.lit(""))
    n = F.length(text).cast("double")
    count = lambda part: (n - F.length(F.replace(text, F.lit(part)))).cast("double")
    last = F.element_at(F.split("path", "/"), -1)
    first = F.regexp_extract("path", "^/([^/]*)", 1)
    return df.select(
        "*",
        n.alias("f_length"),
        F.length("host").cast("double").alias("f_host"),
        F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double").alias("f_depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("f_labels"),
        ((n - F.length(F.translate(text, "0123456789", ""))) / F.greatest(n, F.lit(1.0))).alias("f_digits"),
        _entropy(text).alias("f_entropy"),
        (count("=") + count("&")).alias("f_params"),
        count("?").alias("f_query"),
        count("#").alias("f_fragment"),
        F.length(F.regexp_extract(last, r"\.([^.]*)$", 1)).cast("double").alias("f_extension"),
        F.length(first).cast("double").alias("f_first"),
        F.coalesce(F.regexp_extract("path", r"([0-9])", 1).try_cast("double"), F.lit(-1.0)).alias("f_lead"),
        F.coalesce(F.array_max(F.transform(F.split("path", "[^0-9]+"), F.length)), F.lit(0)).cast("double").alias("f_run"),
        F.substring_index("host", ".", -1).alias("suffix"),
        first.alias("segment"),
    )


@dataclass(frozen=True)
class Learned:
    """Statistics by key, and the trees with the features they take; without trees, one probability for all."""

    statistics: dict[str, DataFrame]
    model: object
    constant: float
    features: tuple[str, ...] = tuple(FEATURES)


def _half() -> Column:
    return F.pmod(F.xxhash64("url", F.lit(3)), F.lit(2))


def _label() -> Column:
    return (F.col("rule_verdict") == "block").cast("double")


def with_statistics(featured: DataFrame, statistics: dict[str, DataFrame], own_half: bool) -> DataFrame:
    """Adds the smoothed share of blocked URLs of each key, of the other half only where a row has part in them."""
    for name, keys in KEYS.items():
        featured = featured.join(statistics[name], keys, "left")
        n, blocked = ((F.coalesce(c + "0", F.lit(0)), F.coalesce(c + "1", F.lit(0))) for c in ("n", "b"))
        seen, bad = ((F.when(_half() == 0, x[1]).otherwise(x[0]) if own_half else x[0] + x[1]) for x in (n, blocked))
        featured = featured.withColumn(name, (bad + 1.0) / (seen + 2.0)).drop("n0", "n1", "b0", "b1")
    return featured


def learn(labelled: DataFrame, *, sample_rows: int, trees: int, depth: int, seed: int, features: tuple[str, ...] = tuple(FEATURES)) -> Learned:
    """Statistics and trees of URLs with ``host``, ``path`` and ``rule_verdict``."""
    keyed = with_features(labelled, F.col("url"))
    statistics = {}
    for name, keys in KEYS.items():
        counts = [F.count_if(_half() == h).alias(f"n{h}") for h in (0, 1)] + [F.sum(F.when(_half() == h, _label()).otherwise(0.0)).alias(f"b{h}") for h in (0, 1)]
        statistics[name] = materialise(keyed.groupBy(*keys).agg(*counts), "url-" + name)
    total = statistics["f_suffix"].agg(F.coalesce(F.sum(F.col("n0") + F.col("n1")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("b0") + F.col("b1")), F.lit(0.0)).alias("b")).first()
    if total.b in (0, total.n):
        return Learned(statistics, None, float(total.b > 0), features)

    def first(rows: DataFrame, n: int) -> DataFrame:
        return rows.select("url", "host", "path", "rule_verdict").orderBy(F.xxhash64("url"), "url").limit(n)

    chosen = materialise(first(labelled, sample_rows), "url-chosen")
    if chosen.select("rule_verdict").distinct().count() < 2:
        # A bounded sample without one of the verdicts: take as many of each.
        halves = [first(labelled.filter(_label() == v), sample_rows // 2) for v in (0.0, 1.0)]
        chosen = materialise(reduce(DataFrame.unionByName, halves), "url-chosen")
    examples = with_statistics(with_features(chosen, F.col("url")), statistics, own_half=True)
    sample = materialise(examples.select(*features, _label().alias("label")).coalesce(1), "url-sample")
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    fitted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", maxBins=32).fit(assembler.transform(sample).select("features", "label"))
    return Learned(statistics, fitted, 0.0, features)


def scored(ruled: DataFrame, learned: Learned) -> DataFrame:
    """Adds ``p_block`` to URLs with ``host`` and ``path`` that were not learnt from."""
    if learned.model is None:
        return ruled.withColumn("p_block", F.lit(learned.constant))
    assembler = VectorAssembler(inputCols=list(learned.features), outputCol="features")
    complete = assembler.transform(with_statistics(with_features(ruled, F.col("url")), learned.statistics, own_half=False))
    return learned.model.transform(complete).withColumn("p_block", vector_to_array("probability")[1])


def judge(pages: DataFrame, *, rules=RULES, sample_rows: int = 4096, trees: int = 8, depth: int = 4, seed: int = 11, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page row: ``page_id, host, path, rule, verdict, p_block``.

    ``p_block`` is the trees' probability of a block, null where a rule decides.
    The verdict is ``block`` from one half on. With labelled URLs of one verdict
    only, that verdict holds for the rest; with none, ``allow``.

    A null URL, or one without ``://``, has an empty host and path, fits no rule
    and is judged by its features. Ties between rules of equal length go to the
    one that sorts first. Repeated rows keep a row each; other columns are not
    read; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    ruled = with_rule(with_parts(rows, F.col("url")), rules)
    learned = learn(ruled.filter("rule is not null"), sample_rows=sample_rows, trees=trees, depth=depth, seed=seed)
    out = ["page_id", "host", "path", "rule"]
    judged = scored(ruled.filter("rule is null"), learned).select(*out, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow").alias("verdict"), "p_block")
    decided = ruled.filter("rule is not null").select(*out, F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    return decided.unionByName(judged)


def quality(pages: DataFrame, *, rules=RULES, sample_rows: int = 4096, trees: int = 8, depth: int = 4, seed: int = 11, without: tuple[str, ...] = (), id_col: str = "page_id", url_col: str = "url") -> dict[str, float]:
    """How well the trees tell the rules' verdicts of URLs that they haven't seen.

    Half of the distinct labelled URLs, by hash, are learnt from; the other half is
    judged as if no rule fitted, by all features but those named in ``without``. ``accuracy``, that of the more frequent verdict
    alone (``constant``), the share of blocked URLs that are found
    (``block_recall``), and the number of URLs judged (``n``).
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).dropDuplicates(["url"])
    labelled = with_rule(with_parts(rows, F.col("url")), rules).filter("rule is not null")
    part = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(2))
    learned = learn(labelled.filter(part == 0), sample_rows=sample_rows, trees=trees, depth=depth, seed=seed, features=tuple(f for f in FEATURES if f not in without))
    told = scored(labelled.filter(part == 1), learned).select((F.col("p_block") >= 0.5).alias("told"), (_label() == 1).alias("is"))
    row = told.agg(F.count("*").alias("n"), F.count_if(F.col("told") == F.col("is")).alias("right"), F.count_if("is").alias("blocks"), F.count_if(F.col("told") & F.col("is")).alias("found")).first()
    return {"n": row.n, "accuracy": row.right / max(row.n, 1), "constant": max(row.blocks, row.n - row.blocks) / max(row.n, 1), "block_recall": row.found / max(row.blocks, 1)}
