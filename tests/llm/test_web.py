import base64
import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np

from stemma.llm.importance import ngrams, resampled
from stemma.llm.language_id import declared, identified, visible
from stemma.llm.url_filter import BINS, FEATURES, RULES, boosted, filtered
from stemma.llm.warc import read_index, read_records, write_archive

URLS = [
    "https://a.NET/x?y#z", "http://net/", "http://xnet/", "https://m.example.net/en/1", "https://example.net/de/1", "http://example.com/de", "http://www.example.com/de/9?q=1",
    "http://s.org/fr/", "ftp://ORG/fr/x", "no scheme", "", None, "http://example.net?/en/", "http://É.example.org/fr/#", "x://y://z.net/", "http://example.net#/en/",
]


def host_path_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, None))
    return host, path, best[2], best[1]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x")], "page_id long, url string, URL2 string")
    got = filtered(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = host_path_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_trees_learn_and_stay_native(spark):
    bad = [(i, f"http://{'x' * (i % 5)}-9{i}.spam-pills{i}.net/{i}{i}/a/b/c?a={i}&b=2") for i in range(200)]
    good = [(1000 + i, f"https://news.site.org/fr/story{i % 7}") for i in range(200)]
    odd = [(5000 + i, f"http://{'x' * (i % 5)}-7{i}.spam-pills{i}.biz/{i}{i}/a/b/c?a={i}&b=2") for i in range(50)] + [(6000 + i, f"https://news.site.biz/fr/story{i % 7}") for i in range(50)]
    out = filtered(spark.createDataFrame(bad + good + odd, "page_id long, url string"))
    got = {r.page_id: r.verdict for r in out.collect()}
    right = sum(got[5000 + i] == "block" for i in range(50)) + sum(got[6000 + i] == "allow" for i in range(50))
    assert right >= 90
    assert not re.search("Python|Pandas|MapInArrow", out._jdf.queryExecution().toString())


def brute_trees(rows, n_trees=12, depth=2, rate=0.4, smooth=1.0):
    """Boosted trees in plain Python over rows of features and y -> margins."""
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows])
    n, pos = len(y), y.sum()
    cuts = [sorted({np.sort(x[:, f])[max(0, math.ceil(k / BINS * n) - 1)] for k in range(1, BINS)}) for f in range(x.shape[1])]
    margin = np.full(n, math.log((pos + 1) / (n - pos + 1)))
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        leaves = [np.ones(n, bool)]
        for _ in range(depth):
            after = []
            for at in leaves:
                best = (0.0, None)
                for f in sorted(range(x.shape[1]), key=FEATURES.__getitem__):
                    for c in cuts[f]:
                        left = at & (x[:, f] <= c)
                        right = at & ~left
                        gain = sum(g[m].sum() ** 2 / (h[m].sum() + smooth) for m in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + smooth)
                        if gain > 1e-6 and gain > best[0] + 1e-12:
                            best = (gain, (left, right))
                after += list(best[1]) if best[1] else [at]
            leaves = after
        for at in leaves:
            if at.any():
                margin[at] += rate * g[at].sum() / (h[at].sum() + smooth)
    return margin


def test_trees_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(120):
        f = [rng.choice([1.0, 2.0, 3.0, 5.0, 8.0]) + 0.01 * rng.randrange(40) for _ in FEATURES]
        rows.append((*f, float(f[0] + f[3] > 7 or rng.random() < 0.1)))
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", y double").coalesce(1)
    got = [r.m for r in df.withColumn("m", boosted(df).margin()).collect()]
    assert np.abs(np.array(got) - brute_trees(rows)).max() < 1e-6


def test_common_url_counts_once(spark):
    hot = [(i, "http://hot.net/x") for i in range(3000)]
    rest = [(5000 + i, f"http://good{i}.org/fr/{'a' * (i % 9)}") for i in range(60)] + [(6000 + i, f"http://b{i}b{i}.net/{i}/{i}?q={i}") for i in range(60)]
    few = filtered(spark.createDataFrame([*hot, *rest, (9000, "http://good9.org/en/aa"), (9001, "http://b7b7.info/7/7?q=7")], "page_id long, url string"), sample=100).collect()
    got = {r.page_id: r.verdict for r in few}
    assert got[9000] == "allow" and got[9001] == "block" and len(few) == len(hot) + len(rest) + 2


def test_url_filter_without_labels(spark):
    assert filtered(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert filtered(spark.createDataFrame([(1, "http://q.biz/")], "page_id long, url string")).first().verdict == "allow"


def test_warc_round_trip(spark):
    pages = [(1, "http://a/\r\nX:\ty", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "z" * 70000), (5, "http://e", "z" * 70000), (None, "http://f", "q")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, HTML2 string")
    path = write_archive(df)
    got = sorted((tuple(r) for r in read_index(spark, path).collect()), key=str)
    want = []
    for page_id, _, html in pages:
        b = (html or "").encode()
        top = max((p for p, _, h in pages if (h or "").encode() == b and p is not None), default=None)
        is_response = page_id is None or page_id == top
        want.append((page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if is_response else "revisit", None if is_response else top))
    assert got == sorted(want, key=str)
    records = {}
    for r in read_records(spark, path).collect():
        records.setdefault(r.page_id, []).append(bytes(r.record))
        original, at = bytes(r.original), r.payload_at
        assert original[at:-4] == ({p: h for p, _, h in pages}[r.page_id] or "").encode() and b"\r\nWARC-Type: response\r\n" in original[:at]
        assert b"WARC-Type: revisit" in bytes(r.record) or bytes(r.record) == original
    for page_id, _, html in pages:
        for raw in records[page_id]:
            header, _, block = raw.partition(b"\r\n\r\n")
            length = int(re.search(rb"\r\nContent-Length: (\d+)", header)[1])
            assert block[length:] == b"\r\n\r\n" and header.startswith(b"WARC/1.1\r\n")
            if b"WARC-Type: response" in header:
                assert block[:length].partition(b"\r\n\r\n")[2] == (html or "").encode()
    assert b"\r\nX: y" not in records[1][0] and b"WARC-Target-URI: http://a/%0D%0AX:%09y\r\n" in records[1][0]
    assert spark.read.parquet(f"{path}/payloads").count() == len({(h or "").encode() for _, _, h in pages})


def test_warc_small_payloads_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in read_index(spark, write_archive(df, least_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert read_index(spark, write_archive(df.limit(0))).count() == 0


def test_language_id(spark):
    words = {"en": "the and of with that this ing", "de": "der die und nicht ein sch zung", "fr": "le la et les que eau dans"}
    docs = spark.createDataFrame([(lang, " ".join([w] * 3 + [x])) for lang, w in words.items() for x in "abcdefgh"] + [(None, "x"), ("en", None)], "lang string, text string")
    pages = [(i, f"http://h{i % 3}.site{i % 3}.{lang}/", f"<html lang='{lang}'><script>le la et</script><p>{words[lang]} {words[lang]}</p>", lang) for i, lang in enumerate(list(words) * 6)]
    pages += [(100, "http://h0.site0.en/x", None, None), (101, None, "", None), (101, None, "", None)]
    out = identified(spark.createDataFrame(pages, "page_id long, url string, html string, truth string"), docs).collect()
    assert len(out) == len(pages)
    got = {r.page_id: r for r in out}
    assert all(got[i].lang == t and got[i].text_lang == t for i, _, _, t in pages if t)
    assert got[100].lang == "en" and got[101].probability <= 1
    assert identified(spark.createDataFrame([], "page_id long, url string, html string"), docs).count() == 0
    assert identified(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), docs.limit(0)).first().lang is None


def brute_languages(pages, docs, temper=0.05, strength=5.0):
    """The same fusion, page by page in plain Python: page_id -> (lang, probability)."""
    names = sorted({lang for lang, t in docs if lang and t is not None})

    def grams(b):
        x = [c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in b]
        return [(u << 16 | v << 8 | w) * 0x9E3779B1 % (1 << 32) >> 16 for u, v, w in zip(x, x[1:], x[2:], strict=False) if (u, v) != (32, 32)]

    logs = {}
    for n in names:
        c = Counter(g for lang, t in docs if lang == n and t is not None for g in grams(t.encode()))
        total = sum(c.values()) + 0.5 * 65536
        logs[n] = lambda g, c=c, total=total: math.log((c[g] + 0.5) / total)
    rows = []
    for page_id, url, html in pages:
        h = html or ""
        m = re.search("<html\\b([^>]*)>", h, re.I)
        told = re.search("[\\s\"'/]lang\\s*=\\s*[\"']?([A-Za-z]{1,8})", m[1], re.I) if m else None
        seen = re.sub("<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>|&[#\\w]+;", " ", h, flags=re.I | re.S)
        s = [temper * sum(logs[n](g) for g in grams(seen.encode())) for n in names]
        p = [math.exp(x - max(s)) for x in s]
        host = m[1].lower() if url and (m := re.match("[^:/?#]*://([^/?#:]*)", url)) else ""
        parts = host.split(".")
        rows.append((page_id, [x / sum(p) for x in p], told[1].lower() if told else "", parts[-1], ".".join(parts[-2:]), host))
    flat, out = [1 / len(names)] * len(names), {}
    every = [sum(r[1][i] for r in rows) for i in range(len(names))]
    kinds = len({r[2] for r in rows})
    for page_id, p, told, *address in rows:
        above = [(t + 1) / (len(rows) + len(names)) for t in every]
        for level, here in enumerate(address):
            group = [r[1] for r in rows if r[3 + level] == here]
            above = [(max(0, sum(g[i] for g in group) - p[i]) + strength * above[i]) / (len(group) - 1 + strength) for i in range(len(names))]
        group = [r[1] for r in rows if r[2] == told]
        markup = [(max(0, sum(g[i] for g in group) - p[i]) + 0.5) / (every[i] + 0.5 * kinds) for i in range(len(names))] if told else flat
        joint = [math.log(p[i] + 1e-300) + math.log(above[i]) + math.log(markup[i]) for i in range(len(names))]
        best = max(range(len(names)), key=lambda i: joint[i])
        out.setdefault(page_id, []).append((names[best], 1 / sum(math.exp(x - joint[best]) for x in joint)))
    return out


def test_language_id_against_brute_force(spark):
    rng = random.Random(3)
    words = {"en": "the and of with that ing".split(), "de": "der die und nicht ein sch".split(), "fr": "le la et les que eau".split()}
    docs = [(lang, " ".join(rng.choices(w, k=6))) for lang, w in words.items() for _ in range(6)] + [(None, "x"), ("en", None)]
    pages = []
    for i in range(40):
        lang, other = rng.choice(list(words)), rng.choice(["en", "de", "xx"])
        pages.append((i, rng.choice([f"http://h{i % 4}.s{i % 2}.{lang}/p", f"http://s.{lang}?q", "no host", None]), rng.choice(["<html data-lang='zz' lang='%s'>" % other, "<p>", "<html>"]) + f"<style>der</style><!-- le --> &amp; {' '.join(rng.choices(words[lang], k=rng.randrange(8)))}<br>"))
    pages += [(0, *pages[0][1:]), (90, None, None), (91, "http://h.s.en", "")]
    got = {}
    for r in identified(spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, HTML2 string"), spark.createDataFrame(docs, "lang string, text string")).collect():
        got.setdefault(r.page_id, []).append((r.lang, r.probability))
    want = brute_languages(pages, docs)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert len(got[k]) == len(v)
        for (_, p), (_, q) in zip(sorted(got[k]), sorted(v), strict=True):
            assert abs(p - q) < 1e-3
        assert q < 0.5001 or sorted(x for x, _ in got[k]) == sorted(x for x, _ in v)


def test_markup_of_any_kind_is_read_once():
    start = time.time()
    for odd in (b"<" * 400_000, b"<!--" * 100_000, b"<script>" * 50_000, b"<html " * 60_000, b"&" * 300_000, b"<html lang" + b" " * 300_000):
        visible(odd)
        declared(odd)
    assert time.time() - start < 10
    assert visible(b"a<!-- x > y -->b<SCRIPT z>q</script >c<p title='1'>d&amp;e<") == b"a b c d e<"
    assert declared(b"<body><HTML data-lang='xx' Lang = \"De-at\">") == "de" and declared(b"<html data-lang='xx'>") is None and declared(b"<html lang=en") is None


def brute_importance(docs, good):
    """log weights by the published formula over dictionaries of slots."""

    def slots(text):
        raw = (text or "").encode()
        slot, _ = ngrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return slot.tolist()

    raw, target = Counter(), Counter()
    for doc_id, t in docs:
        raw.update(slots(t))
        if doc_id in good:
            target.update(slots(t))
    n_raw, n_target = sum(raw.values()) + 65536, sum(target.values())
    ratio = {s: math.log((target[s] + 1000 * (raw[s] + 1) / n_raw) / (n_target + 1000)) - math.log((raw[s] + 1) / n_raw) for s in raw}
    return sorted((d if d is not None else -1, len(slots(t)), round(sum(ratio[s] for s in slots(t)), 2)) for d, t in docs)


def test_importance_against_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices("the a of Plain prose spam buy now".split(), k=rng.randrange(40)))) for i in range(60)] + [(None, "the a"), (3, "again"), (70, "word " * 30_000), (71, None)]
    labels = [(i, i % 2) for i in range(30)] + [(1, 0), (None, 1)]
    rows = resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), share=0.25).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_ngrams, r.log_weight) for r in rows)
    want = brute_importance(docs, {i for i, q in labels if q == 1 and i is not None})
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(g[2] - w[2]) <= 0.02 + 1e-4 * abs(w[2]) for g, w in zip(got, want, strict=True))
    order = sorted(rows, key=lambda r: (-r.key, r.doc_id is not None, r.doc_id or 0))
    assert [r.kept for r in order] == [i < round(0.25 * len(rows)) for i in range(len(rows))]


def test_gumbel_draw_is_in_proportion_to_weights(spark):
    docs = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, quality int")
    rows = resampled(docs, labels, share=0.05, smooth=4000.0).collect()
    odds = {r.doc_id % 2: math.exp(r.log_weight) for r in rows}
    share = sum(r.doc_id % 2 for r in rows if r.kept) / 200
    assert abs(share - odds[1] / (odds[0] + odds[1])) < 0.1


def test_importance_resampling(spark):
    docs = [(i, "good words of plain prose here " * 4) for i in range(80)] + [(100 + i, "buy%%% now*** cheap### junk&&& " * 4) for i in range(20)] + [(300, None), (301, ""), (None, "good words"), (302, "x"), (302, "x")]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(10)] + [(None, 1), (5, None), (5, 1)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, Doc_id string")
    rows = resampled(d, spark.createDataFrame(labels, "doc_id long, quality int"), share=0.8).collect()
    assert len(rows) == len(docs) and sum(r.kept for r in rows) == round(0.8 * len(docs))
    assert sum(r.kept for r in rows if r.doc_id is not None and r.doc_id < 80) >= 78
    assert not any(r.kept for r in rows if r.doc_id is not None and 100 <= r.doc_id < 200)
    keys = sorted((r.key for r in rows), reverse=True)
    assert min(r.key for r in rows if r.kept) >= keys[round(0.8 * len(docs)) - 1] - 1e-9
    assert resampled(d.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_suffixes_and_long_urls(spark):
    """The suffix is what follows the last dot or colon before a port; a host of a million characters takes no longer than others."""
    hosts = {"a.b.com": "com", "a.com:80": "com", "a.com:": "com", "a.com:x": "x", "u:p@h.org:8": "org", "": "", ":1": "", "x": "x", "a.": ""}
    from stemma.llm.url_filter import features, parts

    df = spark.createDataFrame([(f"http://{h}/p",) for h in hosts], "url string")
    assert [r.suffix for r in features(parts(df)).select("suffix").collect()] == list(hosts.values())
    began = time.time()
    long = spark.createDataFrame([(1, "http://" + "a" * 1_000_000 + ":x/"), (2, "http://" + "1:" * 300_000 + "/"), (3, "http://a.com/")], "page_id long, url string")
    assert filtered(long).count() == 3 and time.time() - began < 120
