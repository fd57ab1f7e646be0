"""The ten queries against plain Python models of their contracts, on the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import tarn.llm.catalogue as catalogue
from tarn.runtime import table


def rows_of(spark, sf_dir, name, *columns):
    return [tuple(r) for r in table(spark, sf_dir, name).select(*columns).collect()]


def result(spark, sf_dir, name):
    return catalogue.QUERIES[name](spark, sf_dir).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_decontamination(spark, sf_dir):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = defaultdict(set)
    for i, t in rows_of(spark, sf_dir, "benchmark", "item_id", "text"):
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(str(i))
    sizes = {len(w) for w in windows}
    want = {}
    for d, t in rows_of(spark, sf_dir, "documents", "doc_id", "text"):
        w, hit, items = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    items |= found
        want[d] = (len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit))
    got = {r[0]: tuple(r)[1:] for r in result(spark, sf_dir, "op1_decontamination")}
    assert got == want
    assert any(v[-1] for v in want.values())


def test_topk(spark, sf_dir):
    vectors = {i: [math.floor(64 * float(x)) for x in v] for i, v in rows_of(spark, sf_dir, "embeddings", "vec_id", "embedding")}
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids], dtype=np.int64)
    want = set()
    for q in ids[ids % 20 == 0]:
        s = m @ np.array(vectors[q])
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        want |= {(int(q), rank + 1, int(ids[k]), int(s[k])) for rank, k in enumerate(order)}
    assert {tuple(r) for r in result(spark, sf_dir, "op2_exact_topk")} == want


def test_chat(spark, sf_dir):
    turns = defaultdict(list)
    for c, k, role, text in rows_of(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"):
        turns[c].append((k, role, text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: r for r in result(spark, sf_dir, "op3_chat_format")}
    assert got.keys() == turns.keys()
    for c, t in turns.items():
        t = sorted(t)
        loss = "".join(x[2] for x in t if x[1] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(t), sha("".join(f"{x[1]}\n{x[2]}\n" for x in t)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars > sum(len(x[2]) for x in t)


def test_url_filter(spark, sf_dir):
    rules = [("org", "/"), ("example.org", "/es/"), ("example.org", "/en/1"), ("com", "/fr/"), ("com", "/de/")]
    verdicts = dict(zip(rules, ("allow", "block", "block", "allow", "block")))
    urls = dict(rows_of(spark, sf_dir, "pages", "page_id", "url"))
    got = {r.page_id: r for r in result(spark, sf_dir, "op4_url_filter")}
    assert got.keys() == urls.keys()
    for p, url in urls.items():
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = fold(re.match(r"[^/?#]*", rest).group())
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        rule = max(fits, key=lambda r: len("".join(r)), default=None)
        assert (got[p].host, got[p].path, got[p].rule) == (host, path, "".join(rule) if rule else None)
        assert got[p].verdict == verdicts[rule] if rule else got[p].verdict in ("allow", "block")


def test_line_dedup(spark, sf_dir):
    docs = rows_of(spark, sf_dir, "documents", "doc_id", "text")
    key = lambda s: fold(s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    hot = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    want = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), d) == d]
        want[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    assert {r[0]: tuple(r)[1:] for r in result(spark, sf_dir, "op5_line_dedup")} == want


def test_shard(spark, sf_dir):
    texts = dict(rows_of(spark, sf_dir, "documents", "doc_id", "text"))
    got = result(spark, sf_dir, "op6_shard")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in sizes:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    for r in got:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "rows", None)
    again = result(spark, sf_dir, "op6_shard")
    assert sorted(got) == sorted(again)


def test_html(spark, sf_dir):
    import html

    pages = rows_of(spark, sf_dir, "pages", "page_id", "html")
    got = {r.page_id: r for r in result(spark, sf_dir, "op7_html_extract")}
    for p, source in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", source).group(1)
        article = re.sub(r"</?(?:p|br|h1)>", "\n", article)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", article)).split())
        assert got[p].text == want and got[p].n_chars == len(want)


def test_packing(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = dict(rows_of(spark, sf_dir, "documents", "doc_id", "text"))
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [2] for d, x in docs.items()}
    got = sorted(result(spark, sf_dir, "op8_packing"), key=lambda r: (r.doc_id, r.start))
    at = defaultdict(int)
    for r in got:
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(piece) and r.ids_crc32 == zlib.crc32(np.array(piece, dtype="<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {d: len(x) for d, x in ids.items()}
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert all(n == 4096 for s, n in fill.items() if s != max(fill)) and set(fill) == set(range(len(fill)))


def test_simhash(spark, sf_dir):
    prints = {}
    for d, t in rows_of(spark, sf_dir, "documents", "doc_id", "text"):
        w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in result(spark, sf_dir, "op9_simhash")}
    assert got == {d: (f"{prints[d]:016x}", find(d)) for d in ids}
    assert len({c for _, c in got.values()}) < len(ids)


def test_language(spark, sf_dir):
    docs = {r[0]: r[1:] for r in rows_of(spark, sf_dir, "documents", "doc_id", "text", "lang")}
    got = result(spark, sf_dir, "op10_language")
    assert {r.doc_id for r in got} == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    judged = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id][1] for r in judged]) >= 0.95
    letterless = [r for r in got if not any(map(str.isalpha, docs[r.doc_id][0] or ""))]
    assert all(r.lang_pred == "und" for r in letterless)


@pytest.mark.parametrize("name", ["op1_decontamination", "op5_line_dedup", "op9_simhash"])
def test_results_do_not_depend_on_partitions(spark, sf_dir, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(result(spark, sf_dir, name))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(result(spark, sf_dir, name)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
