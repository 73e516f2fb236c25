"""URL verdicts, divergence of sources and periodic runs against brute force, on odd rows and on whole small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import periodic_runs, source_audit, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})


def same_as_sql(spark, query, sql, folder="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(sql)
    names = sorted(c[0] for c in want.description)
    order = sorted(range(len(names)), key=lambda i: want.description[i][0])
    got = [tuple(r) for r in query(spark, folder).select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


# URL verdicts


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :]).group()


def slow_verdict(url, rules, default="allow"):
    host, path = slow_parts(url)
    fits = [(len(h + p), len(h), v == "block", h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3] + best[4], best[5] if best else default


def random_urls(rng, n):
    labels = ["a", "b", "net", "org", "example", "B", "x-y", ""]
    out = [None, "", "no scheme", "http://", "http:///p/", "://net/", "http://net", "http://net/", "HTTP://A.NET?x=/", "http://a.net:80/", "x://y://z/", "http://a.net#/", "http://u@net/"]
    out += ["http://" + "a." * 5000 + "net/" + "d/" * 5000]
    while len(out) < n:
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5)))
        path = "".join("/" + rng.choice(["", "a", "b", "en", "En", "é"]) for _ in range(rng.randint(0, 4)))
        out.append(f"http://{host}{path}{rng.choice(['', '?a=/b', '#/c', '?'])}")
    return out


@pytest.mark.parametrize("prefix_bytes", [0, 1, 4])
def test_url_verdicts(spark, prefix_bytes):
    rng = random.Random(prefix_bytes)
    urls = random_urls(rng, 400)
    rules = {("net", "/"): "block", ("", ""): "allow", ("a.net", "/a"): "allow", ("net", "/a/"): "block", ("b.net", "/en/a/"): "allow", ("org", ""): "block", ("example", "/e"): "allow"}
    rules |= {(".".join(rng.choice(["a", "b", "net"]) for _ in range(rng.randint(1, 3))), "".join(rng.choice(["/", "/a", "/b/", "en"]) for _ in range(rng.randint(0, 3)))): rng.choice(["allow", "block"]) for _ in range(40)}
    listed = [(h, p, v) for (h, p), v in rules.items()]
    pages = spark.createDataFrame([(i, u, 1, "c") for i, u in enumerate(urls)], "page_id long, url string, host long, won string")
    table = spark.createDataFrame([(h.upper() if i % 3 == 0 else h, p, v) for i, (h, p, v) in enumerate(listed)], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_verdicts(pages, table, prefix_bytes=prefix_bytes).collect()}
    assert got == {i: slow_verdict(u, listed) for i, u in enumerate(urls)}


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://b.net/x"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block"), (None, None, "allow"), ("a.net", "/", None)], "host string, path string, verdict string")
    found = url_filters.url_verdicts(pages, rules)
    assert sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in found.collect()) == [(0, "", "", "allow"), (0, "b.net", "net/", "block"), (1, "a.net", "net/", "block"), (1, "a.net", "net/", "block")]
    assert {(r.rule, r.verdict) for r in url_filters.url_verdicts(pages, rules.filter("false"), default="block").collect()} == {(None, "block")}
    assert url_filters.url_verdicts(pages.filter("false"), rules).count() == 0


def test_url_query_equals_sql(spark):
    same_as_sql(spark, url_filters.op12_url_filters, url_filters.OP12_SQL)


# divergence of sources


def slow_audit(rows, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, uses, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        text, lang, source = text or "", lang or "", source or ""
        groups[lang].add(source)
        for t in term.findall(text):
            t = t.translate(UPPER)
            docs[lang, t].add(i)
            uses[lang, source][t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (g, t), d in docs.items() if g == lang and len(d) >= least)
        counts = {s: {t: uses[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(counts[s][t] for s in sources) for t in kept}

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources - {s}]
            out |= {(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)}
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


@pytest.mark.parametrize("first", [1, 2, 8])
def test_source_divergence(spark, monkeypatch, first):
    monkeypatch.setattr(source_audit, "HELD", 50)
    rng = random.Random(first)
    vocabulary = ["a", "b", "ab", "abc", "abcd", "abcde", "Abcdefghi", "abcdefghij", "é", "éa", "日本", "x" * 17, "x" * 33, "x" * 3000] + [f"{rng.choice('abx')}{'yz'[i % 2] * (i % 7)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30))) + rng.choice(["", "1", ".", "_"]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None])) for _ in range(120)]
    rows += [(None, "en", "empty"), ("", "fr", "s1"), ("one", "fr", "s2"), (None, None, None), ("x" * 3000 + " " + "word " * 20000, "de", "s1"), ("lonely", "it", "s1")]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, *r, 1, "z", 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, level long, term string, n long").repartition(5)
    got = source_audit.source_divergence(docs, first=first, top_terms=10)
    assert {tuple(r) for r in got.collect()} == slow_audit(rows, top=10)
    assert got.count() == len(slow_audit(rows, top=10))


def test_refinement_drops_rare_prefixes(spark):
    """A level holds no prefix below the threshold, and its counts are of distinct documents."""
    rows = [("abcdef abcdeg", "en", "s"), ("abcdef zzzzzz", "en", "s"), ("abcdef zzzzzz zzzzzy", "en", "s"), ("abxxxx", "en", "s")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    counted = source_audit.counted_prefixes(docs.withColumn("gid", F.lit(1).cast("long")), 2)
    level = {r.term.decode(): r.n for r in counted.filter("level = 1").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    assert level == {"ab": 4, "zz": 2}
    assert [(r.term.decode(), r.docs) for r in source_audit.iceberg_terms(counted, 3, 2).collect()] == [("abcdef", 3)]


def test_source_edges(spark, odd, none):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert {tuple(r) for r in source_audit.source_divergence(odd).collect()} == slow_audit(rows)
    assert source_audit.source_divergence(none).count() == 0


def test_source_query_equals_sql(spark):
    same_as_sql(spark, source_audit.op13_source_audit, source_audit.OP13_SQL)


# periodic runs


def slow_runs(words, least=24):
    best = {}
    n = len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 3 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def slow_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic(rng, n):
    out = []
    while len(out) < n:
        if rng.random() < 0.5:
            out += [rng.randrange(rng.choice([1, 2, 3, 50, 1000])) for _ in range(rng.randrange(1, 30))]
            continue
        p = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40, 64, 100])
        base = [rng.randrange(rng.choice([1, 2, 2, 3, 100])) for _ in range(p)]
        if rng.random() < 0.3 and p > 4:
            base = [base[i % (p // 5 + 1)] for i in range(p - 1)] + [9999]
        out += (base * 10)[: int(p * rng.uniform(1, 6))]
    return out


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100, 1000):
        values = rng.permutation(n)
        tree = periodic_runs.WaveletTree(values)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(n, lo + rng.integers(1, n + 1, 200))
        x = rng.integers(0, 2 * n + 1, 200)
        below = tree.below(lo, hi, x)
        assert below.tolist() == [int((values[a:b] < y).sum()) for a, b, y in zip(lo, hi, x, strict=True)]
        k = rng.integers(0, hi - lo)
        assert tree.ranked(lo, hi, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(lo, hi, k, strict=True)]


def test_runs_of_sequences():
    rng = random.Random(7)
    for _ in range(400):
        words = periodic(rng, rng.choice([5, 30, 60, 200, 500]))
        start, end, period = periodic_runs.runs_of(np.array(words))
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == slow_runs(words)


def test_runs_of_documents(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "TOGETHER", 3000)
    rng = random.Random(11)
    texts = ["\t ".join(f"w{w}" for w in periodic(rng, rng.choice([10, 40, 200, 700]))) for _ in range(150)]
    docs = spark.createDataFrame([(str(i), t, 1, 2) for i, t in enumerate(texts)], "name string, body string, runs long, period long").repartition(3)
    got = {int(r.name): r for r in periodic_runs.periodic_runs(docs, "name", "body").collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        runs = slow_runs(words)
        assert ([tuple(r) for r in got[i].runs], got[i].n_words, got[i].collapsed) == (runs, len(words), slow_collapsed(words, runs))


def test_runs_edges(spark, odd, none):
    for r in periodic_runs.periodic_runs(odd.select("text", "doc_id", "n", "key").withColumn("copy", F.col("text"))).collect():
        assert r.n_words == 0 or r.collapsed
    text = {r.doc_id: r for r in periodic_runs.periodic_runs(odd).collect()}
    assert [tuple(r) for r in text[6].runs] == [(0, 120000, 4)] and text[6].collapsed == "alpha beta gamma delta"
    assert text[0].collapsed == "" and text[0].runs == [] and text[2].n_words == 0
    assert periodic_runs.periodic_runs(odd).count() == odd.count()
    assert periodic_runs.periodic_runs(none).count() == 0


def test_run_query_equals_brute_force(spark, docs):
    import zlib

    want = {}
    for r in docs.collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = slow_runs(words)
        best = max(runs, key=lambda x: (x[1] * 10**9 // x[2], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, slow_collapsed(words, runs))]
        want[r.doc_id] = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests)
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(x[0] for x in want.values())


def test_run_query_equals_sql(spark):
    same_as_sql(spark, periodic_runs.op11_periodic_runs, periodic_runs.OP11_SQL)
