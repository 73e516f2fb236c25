"""Exact and near duplicates, repeated passages, benchmark leaks and the pipeline against brute force."""

import hashlib
import random
import re

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontamination, exact_dedup, jaccard_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def slow_components(rows, width=4, percent=85):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def mutated(rng, base, k):
    out = list(base)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def near(spark):
    """Groups of near copies of many sizes, chains, shared lines, small sets and unrelated texts."""
    rng = random.Random(5)
    line = "a very common line that many of the texts here begin with and share"
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "two words"), (5, "a b c d e f g h i"), (6, "a b c d e f g h i j")]
    for g in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 7, 9, 12, 20, 33, 60, 70, 120, 300, 700]))]
        for k in range(rng.randint(1, 6)):
            text = " ".join(mutated(rng, base, rng.randrange(1 + len(base) // 40) if k else 0))
            rows.append((len(rows), (line + " " if g % 3 == 0 else "") + text))
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        rows.append((len(rows), " ".join(chain)))
        chain = [f"n{k}"] * 4 + chain[4:] if k % 2 else chain[3:] + [f"m{k}"]
    return rows


def test_components_equal_brute_force(spark, near):
    want = slow_components(near)
    found = jaccard_join.near_duplicates(spark.createDataFrame(near, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_many_near_copies_need_few_comparisons(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(mutated(rng, base, 2))) for i in range(400)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: c for i, (_, c) in slow_components(rows).items()}


def test_near_duplicates_odd_rows(odd, none):
    found = jaccard_join.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == odd.count() and by[0].n_shingles == 0 and by[0].component_id == 0 and by[8].component_id == 7 and by[5].component_id == 4
    assert by[None].component_id is None
    assert jaccard_join.near_duplicates(none).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 3, 63, 64, 65, 90, 128, 129, 700, 5000):
        for loss in (0, 0.02, 0.07, 0.15, 0.3, 0.9):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate((a[rng.random(n) >= loss], rng.integers(0, 1 << 63, int(loss * n / 2), dtype=np.uint64))))
            shared = len(np.intersect1d(a, b))
            apart = jaccard_join.differing(jaccard_join.parities(a), jaccard_join.parities(b))
            assert apart <= len(a) + len(b) - 2 * shared and apart == jaccard_join.differing(jaccard_join.parities(b), jaccard_join.parities(a))
            if 100 * shared >= 85 * (len(a) + len(b) - shared):
                assert apart <= jaccard_join.most_differing(len(a), len(b))
            if n >= 700 and loss == 0.9:
                assert apart > jaccard_join.most_differing(len(a), len(b))


def test_a_leader_of_thousands_travels_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LED", 7)
    rng = random.Random(19)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(mutated(rng, base, 1 + i % 3))) for i in range(150)] + [(i, " ".join(f"z{i}w{j}" for j in range(60))) for i in range(150, 170)]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == slow_components(rows)


def test_boundary_follows_the_cost():
    assert 1 <= jaccard_join.boundary({}) <= jaccard_join.WHOLE
    assert jaccard_join.boundary({10: 1000}) > 10 and jaccard_join.boundary({50: 1000}) <= 50


def test_exact_chains_of_one_key_stay_apart(docs):
    plain = sorted(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, key_bits=3, capacity=1).collect())) == plain
    assert sorted(map(tuple, exact_dedup.exact_dedup(docs, capacity=5).collect())) == plain


def test_exact_equals_slow_version(docs, odd, none):
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in odd.collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    for r in exact_dedup.exact_dedup(odd).collect():
        mine = [t for i, t in rows if i == r.doc_id][0]
        ids = [i for i in groups[mine] if i is not None]
        assert (r.keep_id, r.group_size) == (min(ids, default=None), len(groups[mine]))
        assert r.text_sha256 == hashlib.sha256(mine.encode()).hexdigest()
    assert exact_dedup.exact_dedup(odd).filter("kept").count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    entries = spark.range(1000).select(F.xxhash64("id").alias("key"))
    index, depth = exact_dedup.directory(entries, 20)
    joined = entries.withColumn("prefix", F.shiftrightunsigned("key", 64 - depth)).join(index, "prefix").groupBy("bucket").count()
    assert joined.agg(F.max("count")).first()[0] <= 20 and joined.agg(F.sum("count")).first()[0] == 1000


def test_repeated_passages(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, edited = fresh(56), fresh(80)
    line = fresh(12)
    rows = []
    for i in range(40):
        text = fresh(rng.randint(60, 400))
        if i < 6:
            at = rng.randrange(len(text))
            text[at:at] = passage
        if 6 <= i < 10:
            at = rng.randrange(len(text))
            # one word differs, near the front, so paragraphs behind it are equal
            text[at:at] = [*edited[: 2 * i - 10], f"new{i}", *edited[2 * i - 9 :]]
        if i % 2:
            text[5:5] = line
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), (102, " ".join(fresh(49)))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(10))
    text = {i: (t or "").split() for i, t in rows}
    for r in found:
        if r.doc_id < 6:
            assert text[r.doc_id][r.start_word : r.end_word] == passage and r.cluster_id == 0 and r.kept == (r.doc_id == 0)


def test_repeated_passages_equal_windows(spark, docs):
    """Every run of fifty words that two documents share lies in a reported passage."""
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    seen, must = {}, set()
    for i, w in rows:
        for j in range(len(w) - 49):
            first = seen.setdefault(tuple(w[j : j + 50]), i)
            if first != i:
                must |= {i, first}
    found = {r.doc_id for r in substring_dedup.repeated_passages(docs).collect()}
    assert must and must <= found


def test_long_segments_are_compared_as_a_whole(spark):
    rng = random.Random(8)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    # every twelfth word differs for 360 words, then 150 words are equal, then 360 edited ones, then 150 equal ones
    edited = lambda w: [x if i % 12 else f"new{rng.randrange(10**9)}" for i, x in enumerate(w)]
    rough, equal, gap, late = fresh(360), fresh(150), fresh(360), fresh(150)
    rows = [(0, [*fresh(70), *rough, *equal, *gap, *late, *fresh(70)]), (1, [*fresh(90), *edited(rough), *equal, *edited(gap), *late, *fresh(80)])]
    found = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"), recall=0.99999).collect()
    for i, w in rows:
        covered = {p for r in found if r.doc_id == i for p in range(r.start_word, r.end_word)}
        for part in (equal, late):
            at = w.index(part[0])
            assert set(range(at, at + 150)) <= covered
        # text that differs is not part of a passage
        assert not set(range(w.index(gap[1]) + 100, w.index(gap[1]) + 250)) & covered


def test_holders_unlike_the_first_are_compared_with_each_other(spark):
    rng = random.Random(21)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    rows, passages = [], []
    for i in range(20):
        passages.append(fresh(50))
        # the first document shares most keys of the passage, but two edited words hold it below the similarity
        near = passages[i][:23] + fresh(2) + passages[i][25:]
        rows += [(3 * i + j, [*fresh(40), *(passages[i] if j else near), *fresh(40)]) for j in range(3)]
    found = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").coalesce(1)).collect()
    places = {(r.doc_id, r.start_word, r.end_word, r.cluster_id) for r in found}
    assert places == {(3 * i + j, 40, 90, 3 * i + 1) for i in range(20) for j in (1, 2)}


def test_repeated_passages_odd_rows(odd, none):
    assert {r.doc_id for r in substring_dedup.repeated_passages(odd).collect()} <= {6, 7, 8}
    assert substring_dedup.repeated_passages(none).count() == 0
    assert substring_dedup.bands_for(0.95, 0.8) == 4


def test_leaks_and_paraphrases(spark):
    rng = random.Random(8)
    common = [f"the{i}" for i in range(40)]
    fresh = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"u{rng.randrange(10**7)}" for _ in range(n)]
    items = [(i, fresh(rng.randint(15, 60))) for i in range(30)]
    rows, want = [], set()
    for d in range(120):
        text = fresh(rng.randint(5, 300))
        if d % 4 == 0:
            i, item = items[d // 4]
            copy = list(item)
            if d % 8 == 0:
                copy[len(copy) // 2 : len(copy) // 2] = ["inserted"]
                del copy[1]
            at = rng.randrange(len(text))
            text[at:at] = copy
            want.add((d, i))
        rows.append((d, " ".join(text)))
    rows += [(500, None), (501, "")]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(77, None), (78, " ")], "item_id long, text string")
    found = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want


def test_leaks_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "same words here again and again for all of us")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(odd, bench).collect()} <= {7, 8}
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, bench.filter("false")).count() == 0


def test_common_words_is_the_longest_subsequence():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        assert decontamination.common_words(np.array(a), np.array(b)) == row[-1]


def test_pipeline_stages(spark, odd):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "bpe"]
    kept = stage["exact_dedup"](spark, docs, folder)
    assert kept.columns == corpus_pipeline.COLUMNS
    first = {}
    for i, t in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    near = stage["jaccard_join"](spark, docs, folder)
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in slow_components(rows).values()})
    clean = stage["decontamination"](spark, docs, folder)
    items = [words(t) for (t,) in duckdb.sql(f"select text from '{folder}/benchmark.parquet'").fetchall()]
    leaks = {i for i, t in rows for w in items if " ".join(w) in " ".join(words(t))}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - leaks
    strange = odd.select(*corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in stage["language_id"](spark, strange, folder).collect()}.isdisjoint({0, 1, 2, 9})
    # repeated rows leave one, rows without an id stay
    left = [r.doc_id for r in stage["exact_dedup"](spark, strange, folder).collect()]
    assert sorted(left, key=str) == sorted([0, 2, 3, 4, 6, 7, 9, 10, 11, None], key=str)


def test_pipeline_near_copies_of_five_words(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [base, [*base, *(f"x{i}" for i in range(20))], [f"y{i}" for i in range(100)]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    # 96 of 116 shingles of five words, 97 of 117 of four
    assert sorted(r.doc_id for r in corpus_pipeline.stage_near(spark, docs, "").collect()) == [0, 2]


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and {"doc_id", "n_tokens", "ids", "decoded_sha256"} <= set(out.columns)
