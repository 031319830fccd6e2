import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_copies_and_windows import ODD, near_texts, word

from panelspark.llm.common import mix
from panelspark.llm.setsketch import BANDS, REGISTERS, bands, likely, registers, sketch_components


def brute(rows, k=4):
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
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = {}
    for x in range(len(rows)):
        ids.setdefault(find(x), []).append(rows[x][0])
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((rows[x][0], len(sets[x]), least[find(x)], rows[x][0] == least[find(x)]) for x in range(len(rows))), key=repr)


def pair(n, similarity, seed):
    """Two sets of about n hashes with the similarity."""
    rng = np.random.default_rng(seed)
    both = int(-(-2 * n * similarity // (1 + similarity)))
    h = mix(rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64))
    return np.sort(h[:n]), np.sort(np.r_[h[:both], h[n:]])


@pytest.mark.parametrize("rounds", [0, 8])
def test_components_equal_all_pairs(spark, rounds):
    near = near_texts(rounds + 3)
    rows = near + ODD + [(3, near[3][1]), (None, near[0][1]), (None, "alone in the world today"), (900, " ".join(["long"] * 30000)), (901, " ".join(["long"] * 29000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("kept", F.lit("clash")).repartition(5)
    assert sorted(map(tuple, sketch_components(spark, docs, rounds=rounds).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    out = sketch_components(spark, spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and not out.count()


def test_registers_of_a_union_are_the_greater_ones():
    a, b = pair(300, 0.3, 1)
    assert (registers([np.union1d(a, b)]) == np.maximum(registers([a]), registers([b]))).all()
    many = [pair(n, 0.5, n)[0] for n in (1, 2, 40000, 7, 90)]
    assert (registers(many) == np.vstack([registers([s]) for s in many])).all()


@pytest.mark.parametrize("n", [5, 9, 40, 400, 5000])
def test_linked_pairs_meet_and_stay_likely(n):
    pairs = [pair(n, 0.8, s) for s in range(400)]
    a, b = registers([x for x, _ in pairs]), registers([y for _, y in pairs])
    size = np.array([len(x) for x, _ in pairs])
    assert likely(a, b, size, size, 0.8).all()
    assert (bands(a) == bands(b)).any(1).mean() > 0.995


@pytest.mark.parametrize("n", [100, 1000])
def test_unlike_pairs_rarely_meet_and_are_unlikely(n):
    pairs = [pair(n, 0.2, s) for s in range(400)]
    a, b = registers([x for x, _ in pairs]), registers([y for _, y in pairs])
    size = np.array([len(x) for x, _ in pairs])
    assert not likely(a, b, size, size, 0.8).any()
    assert (bands(a) == bands(b)).any(1).mean() < 0.06
    assert a.shape == (400, REGISTERS) and bands(a).shape == (400, BANDS)


def test_passages_that_texts_share_do_not_link(spark):
    rng = random.Random(3)
    passage = [word(rng) for _ in range(40)]
    rows = [(i, " ".join(passage + [word(rng) for _ in range(rng.randint(60, 90))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sketch_components(spark, docs).filter("kept").count() == 60
