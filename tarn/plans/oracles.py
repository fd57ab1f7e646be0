"""DuckDB SQL for the named queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Common table expressions ----------------------------------------------------

DOC_TOKENS = r"""tok AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS t FROM documents
)"""
QUERY_TOKENS = r"""qtok AS (
  SELECT item_id AS query_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS t FROM benchmark
)"""
BM25 = (
    DOC_TOKENS
    + """, dl AS (SELECT doc_id, len(t) AS dl FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM dl) - df + 0.5) - ln(df + 0.5) AS raw_idf FROM df),
idf AS (SELECT term, df, raw_idf, CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw)"""
)
SPARSE = (
    BM25
    + ", "
    + QUERY_TOKENS
    + """, qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(t) AS term FROM qtok) GROUP BY ALL),
hit AS (
  SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id) GROUP BY ALL
),
sparse_all AS (
  SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM qt) CROSS JOIN dl LEFT JOIN hit USING (query_id, doc_id)
),
sparse AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM sparse_all
)"""
)
HASHED = """dw AS (
  SELECT doc_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS w FROM (
    SELECT doc_id, ('0x' || substr(md5(term), 1, 7))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL)
)"""
DENSE = (
    HASHED
    + """, qw AS (
  SELECT query_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS w FROM (
    SELECT query_id, ('0x' || substr(md5(term), 1, 7))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM (SELECT query_id, unnest(t) AS term FROM qtok) GROUP BY ALL)
),
dense_all AS (
  SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT query_id FROM qtok) CROSS JOIN (SELECT doc_id FROM tok)
  LEFT JOIN (SELECT query_id, doc_id, sum(qw.w * dw.w) AS score FROM qw JOIN dw USING (b) GROUP BY ALL) USING (query_id, doc_id)
),
dense AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM dense_all
)"""
)


def fused(n: int) -> str:
    return f"""rrf AS (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, list, first) - 1 AS rank FROM (
    SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank + 1)) AS score, min(list) AS list, arg_min(rank, list) AS first FROM (
      SELECT query_id, doc_id, rank, 0 AS list FROM dense WHERE rank < {n} UNION ALL SELECT query_id, doc_id, rank, 1 FROM sparse WHERE rank < {n}) GROUP BY ALL)
)"""


# Text ------------------------------------------------------------------------

WHITE = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+"
ORACLES["tokenize"] = f"""WITH {DOC_TOKENS}
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM tok"""
ORACLES["approx_tokens"] = "SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS n_tokens FROM documents"
_SENTENCES = rf"""sent AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '{WHITE}', ' ', 'g')), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS s
  FROM documents
)"""
ORACLES["sentence_split"] = f"""WITH {_SENTENCES}
SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, chr(10))) AS digest FROM sent"""

def _tokens(text: str) -> str:
    return f"greatest(1, len({text}) // 4)::BIGINT"


def _pieces(words: str, size: int) -> str:
    """A fold over words: ``out`` the full pieces, ``held`` the words of the last one."""
    first = f"list_transform({words}, lambda w: struct_pack(out := []::VARCHAR[], held := [w], n := len(w) + 1))"
    return f"""list_reduce({first}, lambda a, e: CASE
      WHEN a.n + e.n > {4 * size} THEN struct_pack(out := list_append(a.out, array_to_string(a.held, ' ')), held := e.held, n := e.n)
      ELSE struct_pack(out := a.out, held := list_concat(a.held, e.held), n := a.n + e.n) END)"""


def chunked(size: int, overlap: int, columns: str) -> str:
    """The chunker as a fold over sentences. ``p`` holds the pieces of a sentence over the budget."""
    none = "[]::VARCHAR[]"
    suffix = f"list_sum(list_transform(a.held[len(a.held) - m + 1 :], lambda h: {_tokens('h')}))"
    carry = f"a.held[len(a.held) - greatest(1, len(list_filter(range(1, len(a.held) + 1), lambda m: {suffix} <= {overlap}))) + 1 :]"
    carry_n = f"coalesce(list_sum(list_transform({carry}, lambda h: {_tokens('h')}))::BIGINT, 0)"
    flushed = "list_append(a.out, array_to_string(a.held, ' '))"
    words = "list_filter(string_split(x, ' '), lambda w: w <> '')"
    return f"""
WITH {_SENTENCES},
big AS (SELECT DISTINCT x FROM (SELECT unnest(s) AS x FROM sent) WHERE {_tokens('x')} > {size}),
cut AS (SELECT x, list_append(r.out, array_to_string(r.held, ' ')) AS p FROM (SELECT x, {_pieces(words, size)} AS r FROM big)),
el AS (
  SELECT doc_id, list(struct_pack(out := {none}, held := [u.x], n := {_tokens('u.x')}, p := coalesce(cut.p, {none})) ORDER BY u.i) AS l
  FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM sent) u LEFT JOIN cut ON cut.x = u.x GROUP BY doc_id
),
st AS (
  SELECT doc_id, list_reduce(l, lambda a, e: CASE
    WHEN e.n > {size} AND len(a.held) > 0 THEN struct_pack(out := list_concat({flushed}, e.p), held := {carry}, n := {carry_n}, p := {none})
    WHEN e.n > {size} THEN struct_pack(out := list_concat(a.out, e.p), held := a.held, n := a.n, p := {none})
    WHEN a.n + e.n > {size} THEN struct_pack(out := {flushed}, held := list_concat({carry}, e.held), n := {carry_n} + e.n, p := {none})
    ELSE struct_pack(out := a.out, held := list_concat(a.held, e.held), n := a.n + e.n, p := {none}) END,
    struct_pack(out := {none}, held := {none}, n := 0::BIGINT, p := {none})) AS r FROM el
),
done AS (SELECT doc_id, CASE WHEN len(r.held) > 0 THEN list_append(r.out, array_to_string(r.held, ' ')) ELSE r.out END AS c FROM st)
SELECT {columns} FROM (SELECT doc_id, unnest(c) AS text, generate_subscripts(c, 1) AS i FROM done)"""


_CHUNK = "doc_id || '::' || (i - 1) AS chunk_id, doc_id, (i - 1)::INTEGER AS pos, md5(text) AS digest"
ORACLES["chunk_documents"] = chunked(512, 32, _CHUNK + ", length(text)::INTEGER AS n_chars")
ORACLES["chunk_small_budget"] = chunked(24, 6, _CHUNK + ", length(text)::INTEGER AS n_chars")
ORACLES["stream_ingest"] = chunked(512, 32, _CHUNK)
_PLAIN = rf"list_filter(string_split(regexp_replace(regexp_replace(text, '[.!?]', '', 'g'), '{WHITE}', ' ', 'g'), ' '), lambda w: w <> '')"
ORACLES["hard_split"] = f"""
WITH w AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
c AS (SELECT doc_id, list_append(r.out, array_to_string(r.held, ' ')) AS c FROM (SELECT doc_id, {_pieces('w', 32)} AS r FROM w WHERE len(w) > 0))
SELECT doc_id, (i - 1)::INTEGER AS pos, length(piece)::INTEGER AS n_chars, md5(piece) AS digest
FROM (SELECT doc_id, unnest(c) AS piece, generate_subscripts(c, 1) AS i FROM c)"""
_NORMAL = rf"replace(lower(trim(regexp_replace(nfc_normalize(text), '{WHITE}', ' ', 'g'))), 'ß', 'ss')"
ORACLES["normalize_query"] = f"SELECT conv_id, turn, {_NORMAL} AS normalized FROM conversations WHERE role = 'user'"
# The queries of the test tables need escapes for letters beyond ASCII only.
_ESCAPED = "list_aggregate(list_transform(string_split(q, ''), lambda c: CASE WHEN c IN ('\"', '\\') THEN '\\' || c WHEN unicode(c) > 126 THEN '\\u' || lower(lpad(to_hex(unicode(c)), 4, '0')) ELSE c END), 'string_agg', '')"
ORACLES["cache_key"] = f"""
SELECT item_id AS query_id, 'tarn:' || substr(sha256('["search", "' || coalesce({_ESCAPED}, '') || '", 10, "hybrid", true]'), 1, 32) AS cache_key
FROM (SELECT item_id, {_NORMAL} AS q FROM benchmark)"""
ORACLES["classify_intent"] = f"""
SELECT conv_id, turn, CASE
  WHEN contains(q, 'site:') OR contains(q, 'page') OR contains(q, 'homepage') OR contains(q, 'official') OR contains(q, 'url') THEN 'navigational'
  WHEN regexp_matches(q, '^(what|why|how|when|who|where|explain|define|compare)') THEN 'informational'
  WHEN list_has_any(string_split(q, ' '), ['download', 'buy', 'install', 'get', 'purchase', 'subscribe']) THEN 'transactional'
  ELSE 'informational' END AS intent
FROM (SELECT conv_id, turn, {_NORMAL} AS q FROM conversations WHERE role = 'user')"""
ORACLES["expand_query"] = "SELECT item_id AS query_id, 1::BIGINT AS n_variants, text AS variant FROM benchmark"
ORACLES["html_doc_id"] = "SELECT page_id, 'html-' || substr(sha1(html), 1, 12) AS doc_id FROM pages"
_html = "html"
for _tag in ("script", "style", "nav", "footer", "header", "aside", "noscript"):
    _html = f"regexp_replace({_html}, '(?s)<{_tag}[ >].*?</{_tag}>', chr(1), 'g')"
_html = f"regexp_replace(regexp_replace({_html}, '(?s)<!--.*?-->', chr(1), 'g'), '<[^>]*>', chr(1), 'g')"
_decode = "x"
for _from, _to in (("&quot;", "'\"'"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'"), ("&amp", "'&'")):
    _decode = f"replace({_decode}, '{_from}', {_to})"
ORACLES["html_extract"] = f"""
SELECT page_id, array_to_string(list_filter(list_transform(string_split({_html}, chr(1)), lambda x: trim({_decode}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''), chr(10)) AS text FROM pages"""
ORACLES["jsonl_parse"] = "SELECT event_id::VARCHAR AS doc_id, event_type AS text, json_extract_string(props, '$.k') AS k FROM events"

# Vectors ---------------------------------------------------------------------

ORACLES["l2_normalize"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (label + 1)) AS v FROM embeddings)
SELECT vec_id, (i - 1)::INTEGER AS pos, round(v[i] / sqrt(list_inner_product(v, v)), 6) AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM v)"""
ORACLES["embed_hashing"] = f"WITH {DOC_TOKENS}, {HASHED} SELECT doc_id, b::INTEGER AS bucket, round(w, 6) AS weight FROM dw"
_FLAT = """flat AS (
  SELECT q.vec_id AS query_id, c.vec_id AS doc_id, s AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(s, 9) DESC, c.vec_id) - 1 AS rank FROM (
    SELECT q, c, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)
)"""
ORACLES["flat_topk"] = f"WITH {_FLAT} SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM flat WHERE rank < 10"
ORACLES["flat_search"] = f"""WITH {_FLAT} SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS rank FROM flat WHERE doc_id <> query_id) WHERE rank < 10"""
ORACLES["ivf_full_probe"] = ORACLES["ivf_saved"] = ORACLES["flat_topk"]
ORACLES["hnsw_dedupe"] = """
SELECT vec_id AS doc_id, label FROM embeddings UNION ALL
SELECT vec_id * 2, label + 100 FROM embeddings WHERE vec_id * 2 NOT IN (SELECT vec_id FROM embeddings)"""
ORACLES["ingest_union"] = "SELECT vec_id AS doc_id, label FROM embeddings UNION ALL SELECT vec_id, label + 100 FROM embeddings"
ORACLES["index_size"] = """
SELECT 'flat' AS backend, 2 * count(*) AS n FROM embeddings UNION ALL SELECT 'hnsw', count(DISTINCT vec_id) FROM embeddings
UNION ALL SELECT 'bm25', count(*) FROM documents"""

# BM25 and search ---------------------------------------------------------------

ORACLES["bm25_doc_lengths"] = f"WITH {DOC_TOKENS} SELECT doc_id, len(t)::BIGINT AS dl FROM tok"
ORACLES["bm25_corpus_stats"] = f"""WITH {BM25}
SELECT (SELECT count(*) FROM dl) AS n_docs, (SELECT sum(dl)::BIGINT FROM dl) AS n_tokens, (SELECT count(*) FROM idf) AS n_terms,
       (SELECT round(avg(dl), 6) FROM dl) AS avgdl, (SELECT round(avg(raw_idf), 6) FROM idf) AS mean_idf"""
_TERMS = """SELECT substr(md5(term), 1, 2) AS bucket, count(*) AS n_terms, sum(df)::BIGINT AS n_postings,
       md5(string_agg(term || ':' || df || ':' || round(idf * 1000000)::BIGINT, ',' ORDER BY term)) AS digest FROM idf GROUP BY 1"""
ORACLES["bm25_term_stats"] = f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf"
_TOP = "SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, {}) AS score FROM {} WHERE rank < {}"
ORACLES["bm25_topk"] = ORACLES["bm25_blockmax"] = ORACLES["search_sparse"] = f"WITH {SPARSE} " + _TOP.format(6, "sparse", 10)
ORACLES["search_dense"] = ORACLES["search_fallback"] = f"WITH {DOC_TOKENS}, {QUERY_TOKENS}, {DENSE} " + _TOP.format(6, "dense", 10)
ORACLES["rrf_fuse"] = f"WITH {SPARSE}, {DENSE}, {fused(10)} " + _TOP.format(9, "rrf", 1000)
ORACLES["rrf_top_k"] = f"WITH {SPARSE}, {DENSE}, {fused(10)} " + _TOP.format(9, "rrf", 5)
ORACLES["search_hybrid"] = f"WITH {SPARSE}, {DENSE}, {fused(10)} " + _TOP.format(9, "rrf", 10)
ORACLES["search_hybrid_overfetch"] = f"WITH {SPARSE}, {DENSE}, {fused(50)} " + _TOP.format(9, "rrf", 10)
ORACLES["rerank_topk"] = f"""WITH {SPARSE}, {DENSE}, {fused(10)},
lex AS (
  SELECT query_id, doc_id, rank, len(list_intersect(list_distinct(qtok.t), list_distinct(tok.t)))::DOUBLE / len(list_distinct(qtok.t)) AS score
  FROM rrf JOIN qtok USING (query_id) JOIN tok USING (doc_id) WHERE rank < 10
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1)::INTEGER AS rank, doc_id, round(score, 6) AS score FROM lex"""

# Stores --------------------------------------------------------------------------

ORACLES["doc_store_lookup"] = """
SELECT chunk_id, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(text, '')) AS digest
FROM (SELECT doc_id AS chunk_id FROM labels UNION ALL SELECT -doc_id - 1 FROM labels) k LEFT JOIN documents d ON d.doc_id = k.chunk_id"""
ORACLES["doc_store_upsert"] = """
SELECT d.doc_id AS chunk_id, md5(CASE WHEN l.doc_id IS NULL THEN d.text ELSE 'quality ' || l.quality END) AS digest
FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id"""
ORACLES["embed_cache_lookup"] = "SELECT sha256(text) AS key, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS hit FROM documents GROUP BY 1"
ORACLES["embed_cached"] = f"""
WITH {DOC_TOKENS}, {HASHED},
k AS (SELECT sha256(text) AS key, min(doc_id) AS doc_id, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS hit FROM documents GROUP BY 1),
c AS (SELECT ('0x' || substr(md5(term), 1, 7))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT unnest(['the', 'text', 'of', 'the', 'cache']) AS term) GROUP BY 1)
SELECT key, hit, b::INTEGER AS bucket, round(w, 6) AS weight FROM k JOIN dw USING (doc_id) WHERE NOT hit
UNION ALL SELECT key, hit, b::INTEGER, round(n / sqrt((SELECT sum(n * n) FROM c)), 6) FROM k CROSS JOIN c WHERE hit"""
ORACLES["embed_cache_upsert"] = """
SELECT sha256(text) AS key, coalesce(max(d.doc_id) FILTER (WHERE l.doc_id IS NOT NULL) + 1000000, max(d.doc_id)) AS version
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1"""
ORACLES["query_cache_ttl"] = "SELECT event_id FROM events WHERE ts + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-15 12:00:00'"
ORACLES["limit_docs"] = "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100"

# Evaluation ------------------------------------------------------------------------

_JUDGED = f"""{_FLAT}, rel AS (
  SELECT q.vec_id AS query_id, c.vec_id AS doc_id FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
per AS (
  SELECT f.query_id, count(DISTINCT rel.doc_id) / coalesce(max(n.n), 1)::DOUBLE AS recall, coalesce(max(1.0::DOUBLE / (rank + 1)) FILTER (WHERE rel.doc_id IS NOT NULL), 0) AS rr,
         coalesce(sum(1 / log2(rank + 2)) FILTER (WHERE rel.doc_id IS NOT NULL), 0) / coalesce((SELECT sum(1 / log2(i + 1)) FROM range(1, 11) r(i) WHERE i <= max(n.n)), 1) AS ndcg
  FROM flat f LEFT JOIN rel USING (query_id, doc_id) LEFT JOIN n ON n.query_id = f.query_id WHERE rank < 10 GROUP BY 1
)"""
ORACLES["recall_at_k"] = f"WITH {_JUDGED} SELECT query_id, round(recall, 6) AS recall FROM per"
ORACLES["mrr_at_k"] = f"WITH {_JUDGED} SELECT query_id, round(rr, 6) AS rr FROM per"
ORACLES["ndcg_at_k"] = f"WITH {_JUDGED} SELECT query_id, round(ndcg, 6) AS ndcg FROM per"
ORACLES["benchmark_report"] = f"WITH {_JUDGED} SELECT round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM per"
_PSEUDO = _JUDGED.replace("WHERE q.vec_id % 50 = 0\n), n AS", """WHERE q.vec_id % 50 = 0 AND q.label % 2 = 0
  UNION ALL SELECT DISTINCT query_id, doc_id FROM flat JOIN embeddings e ON e.vec_id = query_id WHERE rank < 10 AND NOT (e.label % 2 = 0 AND EXISTS (
    SELECT 1 FROM embeddings o WHERE o.label = e.label AND o.vec_id <> e.vec_id))
), n AS""")
ORACLES["benchmark_pseudo"] = f"WITH {_PSEUDO} SELECT round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM per"
ORACLES["latency_percentiles"] = """
SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95,
       round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, count(value) AS n FROM events"""
ORACLES["latency_by_type"] = """
WITH q AS (SELECT event_type, quantile_cont(value, [0.5, 0.9, 0.95, 0.99]) AS q, count(value) AS n FROM events GROUP BY 1)
SELECT event_type, [0.5, 0.9, 0.95, 0.99][i]::DOUBLE AS p, round(q[i], 6) AS value, n FROM (SELECT *, unnest([1, 2, 3, 4]) AS i FROM q)"""
ORACLES["metrics_histogram"] = """
WITH b AS (SELECT * FROM (VALUES ('0.005', 0.005), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('+Inf', NULL)) t(le, bound))
SELECT event_type, le, count(*) FILTER (WHERE bound IS NULL OR value / 1000 <= bound::DOUBLE) AS cumulative, count(*) AS total, round(sum(value / 1000), 6) AS sum
FROM events CROSS JOIN b GROUP BY ALL"""

_HISTOGRAM = """
WITH b AS (SELECT le, CASE WHEN le <> '+Inf' THEN le::DOUBLE END AS bound FROM (SELECT unnest([{}, '+Inf']) AS le))
SELECT event_type, le, count(*) FILTER (WHERE bound IS NULL OR value / 1000 <= bound) AS cumulative, count(*) AS total, round(sum(value / 1000), 6) AS sum
FROM events CROSS JOIN b GROUP BY ALL"""
ORACLES["metrics_retrieval"] = _HISTOGRAM.format("'0.001', '0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5'")
ORACLES["metrics_rerank"] = _HISTOGRAM.format("'0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1.0'")
ORACLES["metrics_counters"] = """
SELECT '# TYPE tarn_cache_lookups_total counter' AS line UNION ALL
SELECT 'tarn_cache_lookups_total{layer="embedding",outcome="' || CASE WHEN hit THEN 'hit' ELSE 'miss' END || '"} ' || count(*) || '.0'
FROM (SELECT sha256(text) AS key, bool_or(doc_id IN (SELECT doc_id FROM labels)) AS hit FROM documents GROUP BY 1) GROUP BY hit"""
_REQUESTS = _HISTOGRAM.format("'0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1.0', '2.5', '5.0'")
ORACLES["metrics_exposition"] = f"""
WITH h AS ({_REQUESTS})
SELECT unnest(['# HELP tarn_request_duration_seconds Request latency', '# TYPE tarn_request_duration_seconds histogram']) AS line
UNION ALL SELECT 'tarn_request_duration_seconds_bucket{{event_type="' || event_type || '",le="' || le || '"}} ' || cumulative FROM h
UNION ALL SELECT 'tarn_request_duration_seconds_count{{event_type="' || event_type || '"}} ' || total FROM h WHERE le = '+Inf'"""

# Feedback ----------------------------------------------------------------------------

_EVENTS = """fb AS (
  SELECT query_id, query_text, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY ts, event_id) - 1)::INTEGER AS rank, event_type,
         CASE WHEN event_type = 'dwell' THEN floor(value * 100)::INTEGER END AS dwell_ms, epoch_us(ts) / 1e6 AS timestamp
  FROM (
    SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS query_id, 'user ' || user_id AS query_text, 'doc_' || json_extract_string(props, '$.k') AS doc_id, ts, event_id, value,
           CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'skip' WHEN 'purchase' THEN 'dwell' WHEN 'error' THEN 'exit' WHEN 'signup' THEN 'skip' END AS event_type
    FROM events)
)"""
_TRIPLES = f"""{_EVENTS}, triples AS (
  SELECT c.query_id, c.query_text, c.doc_id AS pos_doc_id, o.doc_id AS neg_doc_id
  FROM fb c JOIN fb o ON c.query_id = o.query_id AND o.rank < c.rank WHERE c.event_type = 'click' AND o.event_type <> 'click'
)"""
ORACLES["feedback_scan"] = f"WITH {_EVENTS} SELECT * FROM fb ORDER BY query_id, rank"
ORACLES["feedback_groups"] = f"""WITH {_EVENTS}
SELECT query_id, count(*) AS n, string_agg(rank || ':' || doc_id || ':' || event_type, ',' ORDER BY rank) AS events FROM fb GROUP BY 1"""
ORACLES["feedback_event_counts"] = f"WITH {_EVENTS} SELECT event_type, count(*) AS n FROM fb GROUP BY 1"
ORACLES["feedback_min_clicks"] = f"WITH {_EVENTS} SELECT query_id, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM fb GROUP BY 1 HAVING clicks >= 2"
ORACLES["feedback_triples"] = ORACLES["stream_triples"] = f"WITH {_TRIPLES} SELECT * FROM triples"
ORACLES["training_pairs"] = f"""WITH {_TRIPLES}
SELECT query_text, pos_doc_id AS doc_id, 1.0::DOUBLE AS label FROM triples UNION ALL SELECT query_text, neg_doc_id, 0.0::DOUBLE FROM triples"""
ORACLES["pairwise_mrr"] = f"""WITH {_TRIPLES}
SELECT round(avg(CASE WHEN substr(pos_doc_id, 5)::DOUBLE > substr(neg_doc_id, 5)::DOUBLE THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 6) AS mrr, count(*) AS n FROM triples"""
ORACLES["train_eval_split"] = f"""WITH {_TRIPLES}
SELECT query_id, pos_doc_id, neg_doc_id, CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'eval' ELSE 'train' END AS part FROM (
  SELECT *, row_number() OVER (ORDER BY md5('42|' || query_id || '|' || pos_doc_id || '|' || neg_doc_id)) AS r, count(*) OVER () AS n FROM triples)"""
ORACLES["stream_feedback"] = "SELECT event_id, 'doc_' || json_extract_string(props, '$.k') AS doc_id, event_type, value FROM events"
_CHUNKED = chunked(512, 32, "doc_id || '::' || (i - 1) AS doc_id, text").strip().removeprefix("WITH")
ORACLES["stream_index"] = f"""WITH chunk AS (WITH {_CHUNKED}), {BM25.replace("FROM documents", "FROM chunk")} {_TERMS}"""
ORACLES["stream_cache_ttl"] = """
WITH put AS (SELECT user_id, event_type, event_id, ts FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'),
begun AS (SELECT *, coalesce(ts > lag(ts) OVER w + INTERVAL 3600 SECOND, true) AS fresh FROM put WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
numbered AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS entry FROM begun)
SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS value, epoch_us(min(ts)) AS first_put, epoch_us(max(ts)) AS last_put, epoch_us(max(ts)) + 3600000000 AS runs_out,
       count(*) AS n_puts, max(ts) + INTERVAL 3600 SECOND > TIMESTAMP '2024-01-15 12:00:00' AS alive
FROM numbered GROUP BY user_id, event_type, entry"""
ORACLES["stream_metrics"] = f"""
WITH chunk AS (WITH {chunked(512, 32, "greatest(1, floor(length(text) / 4))::BIGINT AS n").strip().removeprefix("WITH")}),
b AS (SELECT le, CASE WHEN le <> '+Inf' THEN le::BIGINT END AS bound FROM (SELECT unnest(['32', '64', '128', '256', '512', '+Inf']) AS le))
SELECT 'chunks' AS stream, le, count(n) FILTER (WHERE bound IS NULL OR n <= bound) AS cumulative, count(n) AS total, coalesce(sum(n), 0)::DOUBLE AS sum
FROM b LEFT JOIN chunk ON true GROUP BY le"""
