import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import collocations as co
from panelspark.llm.common import WordHash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, top=2000, num=50, den=100):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, p[i : i + k]) for (lang, p), a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if den * a >= num * f[lang, p[i : i + k]]}
    out = []
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, _, l, r = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    rank, rows = collections.Counter(), []
    for lang, score, a, p, l, r in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], p.decode(), -a, l, r, n[lang], -score))
    return rows


def texts(seed, n=120):
    rng = random.Random(seed)
    passage = " ".join(rng.choice(["new", "york", "city", "hall", "of", "the", "Ünder"]) for _ in range(60))
    rows = []
    for _ in range(n):
        words = [rng.choice(["new york city", "of the", "a", "b", "the", "x-y", "É", "salt and pepper", "and"]) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", "\x0b", "! "]) if rng.random() < 0.4 else w + " " for w in words)
        rows.append((text + rng.choice(["", passage]), rng.choice(["en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t\n.", "fr"), ("THE " * 20000, "en"), ("one", "xx")]


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("n", F.lit("clash")).withColumn("chunk", F.lit(1)).repartition(4)
    return sorted(map(tuple, co.collocations(spark, docs, **how).collect()))


@pytest.mark.parametrize("longest,every", [(3, 24), (3, 2), (2, 5), (4, 3)])
def test_ranks_equal_brute_force(spark, monkeypatch, longest, every):
    monkeypatch.setattr(co, "EVERY", every)
    rows = texts(longest * every)
    assert found(spark, rows, longest=longest) == sorted(brute(rows, longest))


def test_small_limits_and_top(spark, monkeypatch):
    for name, low in (("HELD", 500), ("HELD_BYTES", 4000), ("BUCKET", 40), ("HEAVY", 5)):
        monkeypatch.setattr(co, name, low)
    rows = texts(9) * 3
    assert found(spark, rows, least=4, top=7) == sorted(brute(rows, least=4, top=7))


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(None, None)]) == []


def test_scores_beyond_64_bits(spark):
    big = spark.range(1).select(F.lit(4_000_000_000).alias("f"), F.lit(5_000_000_000).alias("l"), F.lit(6_000_000_000).alias("r"))
    assert big.select(co.score()).first()[0] == 10**6 * 4_000_000_000**2 // (5_000_000_000 * 6_000_000_000)


def test_chunks_are_the_same_in_another_place():
    rng = random.Random(1)
    known = WordHash()
    passage = " ".join(str(rng.random()) for _ in range(400)).replace(".", "x").encode()
    inside = lambda before: {c for c, _ in co.chunks_of(before + b" " + passage, 2, known)}
    both = inside(b"a b c") & inside(b"some other words come first")
    assert len(both) >= len(inside(b"")) - 3 > 5
    whole = co.chunks_of(passage, 2, known)
    assert sum(n for _, n in whole) == 400 and np.mean([n for _, n in whole]) < 60
