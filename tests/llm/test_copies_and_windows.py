import collections
import random
import uuid

import pytest
from pyspark.sql import functions as F

from panelspark.llm.decontam import contaminated, decontaminate
from panelspark.llm.ngram_jaccard import choose_level, jaccard_components
from panelspark.operators.components import connected_components
from panelspark.scratch import Scratch

ODD = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "one two"), (-5, "ONE Two"), (-6, "one two three four five"), (-7, "x" * 5000), (-8, "a b c d e f g h")]


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(6))


def near_texts(seed, groups=6, copies=14):
    rng = random.Random(seed)
    rows, i = [], 0
    passage = [word(rng) for _ in range(30)]
    for _ in range(groups):
        base = [word(rng) for _ in range(rng.randint(12, 120))] + passage * rng.randint(0, 1)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word(rng)
            rows.append((i, " ".join(w)))
            i += 1
    return rows


def brute_components(rows, k=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        n = min(k, len(w))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for x in range(len(rows)):
        least[find(x)].append(rows[x][0])
    return {(rows[x][0], len(sets[x]), min(least[find(x)])) for x in range(len(rows))}


@pytest.mark.parametrize("rounds", [0, 12])
def test_components_equal_all_pairs(spark, rounds):
    rows = near_texts(rounds + 1) + ODD + [(3, near_texts(rounds + 1)[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1)).repartition(7)
    got = jaccard_components(spark, docs, rounds=rounds)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)
    assert got.count() == len(rows)


def test_components_with_very_frequent_shingles_of_repeated_classes(spark, monkeypatch):
    from panelspark.llm import ngram_jaccard

    for name, low in (("SATURATED", 8), ("HELD", 60), ("CHUNK", 400)):
        monkeypatch.setattr(ngram_jaccard, name, low)
    rng = random.Random(5)
    passage, rows = [word(rng) for _ in range(34)], []
    for _ in range(24):
        base = [word(rng) for _ in range(70)]
        at = rng.randrange(len(base))
        for end in (0, 7):
            w = [*base[: len(base) - end], *(word(rng) for _ in range(end))]
            rows += [(0, " ".join(w[:at] + passage + w[at:]))] * 6
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = jaccard_components(spark, docs)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(spark, none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(spark, none, bench).count() == 0
    some = spark.createDataFrame(ODD, "doc_id long, text string")
    assert contaminated(spark, some, bench).count() == 0


def test_level_costs():
    import numpy as np

    assert choose_level(np.array([2, 2, 500, 500]), 8, 6) == 1
    assert choose_level(np.array([50, 50, 50, 50, 50, 50, 50, 50]), 8, 6) > 1


def test_components_of_a_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 5000), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(40)} | {5000: 5000}


def brute_windows(docs, items):
    found = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        for i, it in items:
            x = (it or "").encode().lower().split()
            k = min(5, len(x))
            if not x:
                continue
            a = [tuple(x[j : j + k]) for j in range(len(x) - k + 1)]
            b = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            n, best = len(a), 0
            for s in range(max(1, len(b) - n + 1)):
                part = b[s : s + n]
                o = sum((collections.Counter(a) & collections.Counter(part)).values())
                best = max(best, o / (n + len(part) - o))
            if best >= 0.75:
                found[(d, i)] = best
    return found


def test_contamination_equals_all_windows(spark):
    rng = random.Random(4)
    items = [(i, " ".join(word(rng) for _ in range(rng.randint(15, 60)))) for i in range(12)] + [(20, "two words"), (21, ""), (22, None), (23, "one")]
    docs = list(ODD)
    for i in range(60):
        w = [word(rng) for _ in range(rng.randint(0, 80))]
        if i % 2:
            x = items[rng.randrange(12)][1].upper().split()
            for _ in range(rng.randint(0, 2)):
                x[rng.randrange(len(x))] = word(rng)
            at = rng.randint(0, len(w))
            w = w[:at] + x[rng.randint(0, 3) :] + w[at:]
        docs.append((i, "\n ".join(w)))
    docs.append((100, "has two words inside"))
    docs.append(docs[9])
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("words", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contaminated(spark, df, bench).collect()}
    want = brute_windows(docs, items)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    kept = {r["doc_id"] for r in decontaminate(spark, df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_windows_at_the_threshold_are_found(spark):
    rng, items, docs, want = random.Random(6), [], [], {}
    for i in range(240):
        n = (18, 39, 102, 200)[i % 4]
        x, c = [f"{word(rng)}{i}q{j}" for j in range(n + 4)], n // 7
        w = [*x[: n + 4 - c], *(word(rng) for _ in range(c))]
        items.append((i, " ".join(x)))
        docs.append((i, " ".join(["start", *w, "end"])))
        want[(i, i)] = (n - c) / (n + c)
    out = contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(r["start_word"] == 1 for r in out)


def test_scratch_is_shared(spark):
    s = Scratch(spark, f"x{uuid.uuid4().hex}")
    t = s.table(spark.range(3).toDF("a"), "t")
    assert t.count() == 3 and t.scratch_path.startswith(spark.conf.get("spark.checkpoint.dir"))
    s.drop(t)


def test_a_crowded_bucket_is_sorted_a_logarithmic_number_of_times():
    import numpy as np

    from panelspark.llm.ngram_jaccard import _Counter

    counter, sorts = _Counter(65_536, 1000), []
    out = counter.out
    counter.out = lambda last: (sorts.append(last), *out(last))[1:]
    rng = np.random.default_rng(1)
    got = []
    for i in range(400):
        h = rng.integers(0, 1 << 62, 500).astype(np.uint64)
        got += list(counter.add(np.r_[h, np.uint64(7)], np.full(501, i), np.full(501, 501)))
    got += list(counter.out(last=True))
    assert len(sorts) <= 10 and sum(len(b) for b in got) == 400
