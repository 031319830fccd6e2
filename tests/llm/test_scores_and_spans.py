import collections
import hashlib
import math
import random
import re
import struct
import zlib

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from panelspark.llm.kn_lm import discounts, perplexity_scores
from panelspark.llm.mixing import FAN, LAST, SPAN, mix, source_targets
from panelspark.llm.pii import estimate, find_personal_data, running_sum
from panelspark.llm.quality import CUT, consistency, quality_verdicts
from panelspark.scratch import Scratch

WORDS = "the of and to in a is that for it as was with be by on not he his but".split()


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))) for i in range(n)]


def test_kneser_ney_equals_the_formula(spark):
    rows = texts(150) + [(1000, None), (1001, ""), (1002, "unseen Words HERE"), (None, "the of"), (3, "the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted(((r["doc_id"], r["n_tokens"], round(r["score"], 9), round(r["base_score"], 9), r["held_out"], r["n_known"]) for r in perplexity_scores(spark, docs).collect()), key=str)
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    uni, pairs = collections.Counter(), collections.Counter()
    for x, h in zip(tokens, held):
        if not h:
            uni.update(x)
            pairs.update(zip([None, *x], x))
    n, v = sum(uni.values()), len(uni)
    left = collections.Counter(b for _, b in pairs)
    d = [0, *discounts(*[sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)])]
    e = [0, *discounts(*[sum(c == i for c in left.values()) for i in (1, 2, 3, 4)])]
    gamma0 = sum(e[min(c, 3)] for c in left.values()) / len(pairs)
    ctx = collections.defaultdict(lambda: [0, 0.0])
    for (a, _), c in pairs.items():
        ctx[a][0] += c
        ctx[a][1] += d[min(c, 3)]

    def p(a, b):
        low = max(left[b] - e[min(left[b], 3)], 0) / len(pairs) + gamma0 / (v + 1)
        if a not in ctx:
            return low
        c = pairs[(a, b)]
        return max(c - d[min(c, 3)], 0) / ctx[a][0] + ctx[a][1] / ctx[a][0] * low

    want = sorted(((i, len(x), round(sum(math.log10(p(a, b)) for a, b in zip([None, *x], x)), 9), round(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 9), h, sum(uni[w] > 0 for w in x)) for (i, _), x, h in zip(rows, tokens, held)), key=str)
    assert got == want
    for a in ("the", None):
        a = a and a.encode()
        assert sum(p(a, b) for b in uni) + p(a, b"never seen") == pytest.approx(1, abs=1e-6)


def test_no_training_texts(spark):
    rows = [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = perplexity_scores(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["held_out"] and r["n_known"] == 0 for r in got)
    assert perplexity_scores(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def targets(sizes, weights, most):
    """Plain form of the targets, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, left = float(sum(sizes.values())), {}, list(order)
    while left:
        rest, w = total - sum(full.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > most * sizes[s]]
        if not over:
            return full | {s: rest * weight[s] / w for s in left}
        full |= {s: most * sizes[s] for s in over}
        left = [s for s in left if s not in full]
    return full


def test_targets(spark):
    def of(sizes, weights=(5.0, 2.0, 1.0)):
        rows = spark.createDataFrame(list(sizes.items()), "source string, n long")
        return {r["source"]: r["target"] for r in source_targets(rows, weights, 3.0, Scratch(spark, "t")).collect()}

    assert of({"a": 100, "b": 100, None: 100}) == {"a": pytest.approx(187.5), "b": pytest.approx(75), None: pytest.approx(37.5)}
    got = of({"a": 1, "b": 500, "c": 499})
    assert got["a"] == 3 and got["b"] == pytest.approx(997 * 2 / 3) and sum(got.values()) == pytest.approx(1000)
    assert of({}) == {} and of({"a": 0}) == {"a": 0}
    rng = random.Random(4)
    sizes = {f"s{i}\u00e9" if i % 7 else None if not i else f"\U0001f642{i}": int(rng.paretovariate(0.5)) for i in range(60)}
    want = targets(sizes, (5, 2, 1), 3.0)
    got = of(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)


def spark_hash(*values):
    """Spark's 64-bit hash of longs (nulls leave it as it is) and a last int."""
    h = 42
    for v in values[:-1]:
        h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return xxhash.xxh64_intdigest(struct.pack("<i", values[-1]), h)


def twin_mix(rows, weights=(5, 2, 1), most=3.0, seed=7):
    """Copies of every row by plain loops."""
    sizes = [len((t or "").encode().split()) for _, t, _ in rows]
    words = collections.Counter()
    for n, (_, _, s) in zip(sizes, rows):
        words[s] += n
    aim, copies, seen, units = targets(words, weights, most), [], collections.Counter(), collections.defaultdict(list)
    bounds = [0]
    while bounds[-1] < max(sizes, default=0):
        bounds.append(max(LAST, bounds[-1] * SPAN))
    for r, (n, (i, _, s)) in enumerate(zip(sizes, rows)):
        seen[(s, i, n)] += 1
        copies.append(int(aim[s] / words[s]) if n else 0)
        if n:
            units[s].append((n, i, seen[(s, i, n)], r))
    draw = lambda *v: (spark_hash(*v) >> 11) / 2**53
    most_units = [max(sum(lo < u[0] <= hi for u in us) for us in units.values()) for lo, hi in zip(bounds, bounds[1:])][::-1] if units else []
    for s, us in units.items():
        left = (aim[s] / words[s] - int(aim[s] / words[s])) * words[s]
        for k, (hi, lo) in enumerate(zip(bounds[:0:-1], bounds[-2::-1])):
            here = [u for u in us if lo < u[0] <= hi]
            rest = sum(u[0] for u in us if u[0] <= hi)
            live = [[*u, min(max(left / rest, 0.0), 1.0)] for u in here] if rest else []
            step, blocks = 0, -(-most_units[k] // FAN)
            while live:
                by = collections.defaultdict(list)
                for u in live:
                    h = spark_hash(u[1], u[2], step)
                    by[(h - (1 << 64) if h >> 63 else h) % blocks].append(u)
                live = []
                for b in by.values():
                    b.sort(key=lambda u: (u[0], -1 if u[1] is None else u[1], u[2], u[4]), reverse=True)
                    o = b[0]
                    for u in b[1:]:
                        has, room, gives, takes = o[4] * o[0], (1 - o[4]) * o[0], u[4] * u[0], (1 - u[4]) * u[0]
                        up, down = min(room, gives), min(has, takes)
                        rises = draw(o[1], o[2], u[1], u[2], seed + 100 * k + step) * (up + down) < down
                        if (room <= gives) if rises else (has <= takes):
                            o, done, one, p = u, o, rises, ((gives - room) if rises else (gives + has)) / u[0]
                        else:
                            done, one, p = u, not rises, ((has + gives) if rises else (has - takes)) / o[0]
                        o = [*o[:4], p]
                        copies[done[3]] += one
                        left -= done[0] * one
                    live.append(o)
                if blocks == 1:
                    below = sum(u[0] for u in us if u[0] <= lo)
                    beyond = lambda x: max(x - below, -x, 0)
                    gain = beyond(left) - beyond(left - live[0][0])
                    one = gain > 0 if abs(gain) > 1e-6 else draw(live[0][1], live[0][2], seed) < live[0][4]
                    copies[live[0][3]] += one
                    left -= live[0][0] * one
                    break
                step, blocks = step + 1, -(-blocks // FAN)
    return [(i, s, n, c) for (i, _, s), n, c in zip(rows, sizes, copies)]


def test_mix_equals_a_plain_twin(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 20, 80, 300])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    rows += [(5000, None, "a"), (5001, "", "b"), (1, "w w", "a"), (1, "w w", "a"), (None, "w", "b"), (6000, "w " * 9000, "c"), (6001, "w " * 700, "alone"), (6002, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "g": F.lit(1), "p": F.lit(0)})
    got = mix(spark, docs.repartition(3)).toPandas()
    key = lambda r: tuple((x is None, x) for x in r)
    plain = [tuple(None if x != x else x for x in r) for r in got[["doc_id", "source", "size", "copies"]].astype(object).itertuples(index=False)]
    assert sorted(((None if i is None else int(i), s, n, c) for i, s, n, c in plain), key=key) == sorted(twin_mix(rows), key=key)
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    for source, g in got.groupby("source", dropna=False):
        assert g["size"].sum() == g.source_size.iloc[0]
        if source not in ("alone", "none"):
            assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.01 * g.target.iloc[0], g["size"].median())
    assert mix(spark, docs.limit(0)).count() == 0


def test_sources_come_near_their_targets(spark):
    got = mix(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert len(got) == 1000
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(0.01 * g.target.iloc[0], g["size"].median())


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    digits = [int(c) for c in s if c.isdigit()]
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")), "phone": 10 <= len(digits) <= 15}[kind]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(9)
    parts = ["a@b.co", "x.y%z@m-1.de.fr", "@", ".", "1.2.3.4", "256.1.1.1", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "+1", "12345678901234567890", " ", " ", "é", "🙂", "-", "+", "%", "call"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "a@b.c.%d@e.f 1.2.3.4.5.6.7.8"), (1003, "x@y.zz " * 700), (1004, "1" * 30000), (1005, "a" * 30000), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit(0)).withColumn("row", F.lit(0))
    got = sorted(tuple(r)[:6] for r in find_personal_data(spark, docs).collect())
    want = []
    for i, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, t or "") if valid(list(PATTERNS)[k], m.group()))
        text = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i, *[sum(k == j for _, k, _ in spans) for j in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_added_spans(spark):
    chain = "pay 4465758382889437 4465758382889437 now"
    docs = spark.createDataFrame([(i, f"{chain} mail a{i}@b.com or call +1 (234) 567-8901 x") for i in range(30)] + [(99, "clean text 12 34 about 1999 and 3.14")], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in find_personal_data(spark, docs).collect()}
    assert out[99] == "" and "card:4:20,card:21:37" in out[0] and "phone:" in out[0]
    assert find_personal_data(spark, docs.limit(0)).count() == 0


def test_phones_in_chains_without_dashes(spark):
    texts = ["phone +1 555 123 4567 8901 2345 end", "phone +1 5551234567 8901 2345 end", "phone +1.555.123 4567 8901 2345 end"]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(30)], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in find_personal_data(spark, docs).collect()}
    assert [out[i] for i in range(3)] == ["phone:6:21", "phone:6:19", "phone:6:21"]


def test_running_sum(spark):
    values = list(range(1, 9000))
    got = spark.createDataFrame([(values,)], "a array<int>").select(running_sum(F.col("a"))).first()[0]
    assert got == [sum(values[:i]) for i in (0,)] + [x * (x + 1) // 2 for x in values[:-1]]


def test_estimate_trusts_the_reliable():
    rng = random.Random(1)
    counts = collections.Counter()
    truth = {}
    for i in range(2000):
        t = rng.random() < 0.4
        v = tuple((1 if t == (rng.random() < q) else -1) for q in (0.95, 0.9, 0.85, 0.55, 0.6, 0.5))
        counts[v] += 1
        truth.setdefault(v, []).append(t)
    _, rates, post = estimate(list(counts.items()))
    assert rates[0][1][0] > 0.85 and abs(rates[3][1][0] - rates[3][1][1]) < 0.25
    right = sum((p > 0.5) == t for (v, _), p in zip(counts.items(), post) for t in truth[v])
    assert right / 2000 > 0.93


def test_estimate_equals_expectation_maximisation_over_single_candidates():
    import numpy as np

    rng = np.random.default_rng(5)
    true = rng.random(600) < 0.3
    votes = np.array([[rng.choice([-1, 0, 1], p=[0.7 - 0.5 * t, 0.2, 0.1 + 0.5 * t]) for _ in range(6)] for t in true])
    p = np.clip(0.5 + 0.45 * votes.mean(1), 0.05, 0.95)
    for _ in range(50):
        prior = (p.sum() + 1) / (len(p) + 2)
        odds = np.full(len(p), np.log(prior / (1 - prior)))
        for i in range(6):
            yes = {1: 3.0, 0: 1.5, -1: 1.0}
            table = {x: (yes[x] + p[votes[:, i] == x].sum(), yes[-x] + (1 - p)[votes[:, i] == x].sum()) for x in yes}
            sums = [sum(t[k] for t in table.values()) for k in (0, 1)]
            odds += np.array([np.log(table[x][0] / sums[0] / (table[x][1] / sums[1])) for x in votes[:, i]])
        p = 1 / (1 + np.exp(-odds))
    counts = collections.Counter(map(tuple, votes.tolist()))
    post = dict(zip(counts, estimate(list(counts.items()))[2]))
    assert np.allclose([post[tuple(v)] for v in votes.tolist()], p, atol=1e-3)
    assert ((p > 0.5) == true).mean() > 0.9


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def twin_spans(texts):
    """All spans of every text by plain code; only the driver's two small fits are shared."""
    from panelspark.llm import pii

    found = []
    for r, t in enumerate(texts):
        base = [(m.start(), m.end(), k) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, t) if valid(list(PATTERNS)[k], m.group())]
        here = [(k, True, i, j) for i, j, k in base]
        for k, kind in enumerate(pii.KINDS):
            here += [(k, False, m.start(), m.end()) for m in re.finditer(pii.LOOSE[kind], t) if not any(i < m.end() and m.start() < j for i, j, _ in base)]
        found += [(r, len(here) - 1, *x) for x in here]
    rows = []
    for r, others, k, is_base, i, j in found:
        t, kind = texts[r], pii.KINDS[k]
        x, left, right = t[i:j], t[max(0, i - 40) : i], t[j : j + 2]
        n, has = sum(c in "0123456789" for c in x), lambda p, y=x: regex.search(p, y) is not None
        yes = lambda c: 1 if c else -1
        three = lambda c, d: 1 if c else -1 if d else 0
        letters, turns = sum("a" <= c.lower() <= "z" for c in x), len(re.findall("[0-9][A-Za-z]|[A-Za-z][0-9]", x))
        shape = {"email": lambda: "@" in x or has(r"(?i)[\[(] ?(at|dot)| dot [a-z0-9-]*[a-z]{2}$"), "ip": lambda: ":" in x or all(int(q) <= 255 for q in x.split(".")), "card": lambda: valid("card", x), "phone": lambda: 10 <= n <= 15, "secret": lambda: turns >= 4 and 4 * n >= len(x) and 8 * letters >= len(x), "iban": lambda: mod97(x), "ssn": lambda: not has("^(000|666|9)|-00-|-0000$")}[kind]()
        gaz = {"email": lambda: yes(has("[A-Za-z0-9-]+$") and re.search("[A-Za-z0-9-]+$", x).group().lower() in pii.DOMAINS), "ip": lambda: three(not has(r"^(0|127|255)\."), has("^0")), "card": lambda: three(has("^(4|5[1-5]|2[2-7]|3[47]|6)"), has("^[0189]")), "phone": lambda: three(has(r"^\+[1-9]|^\(?[2-9]"), has(r"^\(?[01]")), "secret": lambda: three(has(pii.TOKENS) or (has("^([0-9a-f]+|[0-9A-F]+)$") and len(x) in (32, 40, 64)), len(x) < 24), "iban": lambda: yes(x[:2] in pii.COUNTRIES), "ssn": lambda: 0}[kind]()
        layout = {"email": lambda: three(has(r"^[a-z0-9._%+-]+@| ?[\[(]"), has("[A-Z].*[a-z].*[A-Z]")), "ip": lambda: yes(not has("(^|[.])0[0-9]")), "card": lambda: yes(has("^([0-9]+|[0-9]{4}([ -][0-9]{4}){3})$")), "phone": lambda: three(has("[ ().-]"), has("^[0-9]+$")), "secret": lambda: yes(has("^([a-z0-9_-]+|[A-Z0-9_-]+)$")), "iban": lambda: yes(not has("[a-z]")), "ssn": lambda: 1}[kind]()
        context = three(has(pii.CONTEXT[kind][0], left), has(pii.CONTEXT[kind][1], left))
        glued = has(r"[\p{L}\p{N}_./-]$", left) or has(r"^[\p{L}\p{N}_/=]", right)
        v = {"shape": yes(shape), "gazetteer": gaz, "context": context, "surroundings": yes(not glued), "layout": layout, "company": int(others > 0)}
        lo, hi = pii.LENGTHS[kind]
        v |= {"size": -1 if len(x) < lo else int(len(x) > hi), "digits": 1 if 10 * n >= 8 * len(x) else 0 if 10 * n >= 2 * len(x) else -1, "varied": yes(len(set(x[:64])) >= 5)}
        v |= {"opened": 1 if has(r"[\"'(<\[:=] ?$", left) else 0 if has(r"(^|\s)$", left) else -1, "closed": 1 if has(r"^[\"')>\],;.!?]", right) else 0 if has(r"^($|\s)", right) else -1}
        rows.append((r, k, is_base, i, j, v))
    kept = collections.defaultdict(list)
    for k in range(len(pii.KINDS)):
        mine = [x for x in rows if x[1] == k]
        votes = collections.Counter(tuple(x[5][c] for c in pii.LABELERS) for x in mine)
        post = dict(zip(votes, estimate(list(votes.items()))[2]))
        seen = collections.defaultdict(lambda: [0.0, 0.0])
        for x in mine:
            f = seen[tuple(x[5][c] for c in pii.FEATURES)]
            f[0] += 1
            f[1] += post[tuple(x[5][c] for c in pii.LABELERS)]
        w = pii.fit_classifier(sorted((f, n, y) for f, (n, y) in seen.items()))
        for r, _, is_base, i, j, v in mine:
            z = w[0] + sum(a * v[c] for a, c in zip(w[1:], pii.FEATURES))
            if is_base or 1 / (1 + math.exp(-z)) >= 0.6:
                kept[r].append((i, k, j, is_base))
    out = []
    for r in range(len(texts)):
        spans = sorted(s for s in kept[r] if s[3] or not any(o[0] <= s[0] and s[2] <= o[2] and o[2] - o[0] > s[2] - s[0] for o in kept[r]))
        out.append(",".join(f"{pii.KINDS[k]}:{i}:{j}" for i, k, j, _ in spans))
    return out


def test_spans_equal_a_plain_twin(spark):
    rng = random.Random(11)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    parts = [
        lambda: f'token = "{hexes(40)}"', lambda: f"commit {hexes(40)}", lambda: "a_long_name_of_some_variable_2", lambda: f"mail {hexes(3)} at site{number(1)} dot com", lambda: f"{hexes(4)} [at] b [dot] org",
        lambda: f"call {number(3)}-{number(3)}-{number(4)}", lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(16)} {number(16)}", lambda: "4465758382889437 4465758382889437", lambda: "DE89 3704 0044 0532 0130 00,", lambda: f"DE{number(20)}", lambda: f"ssn {number(3)}-{number(2)}-{number(4)}",
        lambda: f"{number(3)}.{number(2)}.{number(2)}.{number(1)}", lambda: "2001:db8:1:2:3:4:5:6", lambda: "a@b.co", lambda: "look at 12 dot 3", lambda: "wörter é 🙂 ohne", lambda: "order " + number(15), lambda: "clean words only", lambda: "\n",
    ]
    texts = [" ".join(rng.choice(parts)() for _ in range(rng.randint(0, 6))) for _ in range(300)] + ["", "x" * 40000, "1a" * 20000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("clash")).repartition(3)
    got = {r["doc_id"]: r for r in find_personal_data(spark, docs).collect()}
    want = twin_spans(texts)
    assert [got[i]["spans"] for i in range(len(texts))] == want
    assert [got[i]["n_spans"] for i in range(len(texts))] == [len(x.split(",")) if x else 0 for x in want]
    by_kind = collections.Counter(x.split(":")[0] for w in want for x in w.split(",") if x)
    assert all(by_kind[k] for k in ("email", "ip", "card", "phone", "secret", "iban", "ssn"))
    assert not any(w for t, w in zip(texts, want) if set(t.split()) <= {"clean", "words", "only", "wörter", "é", "🙂", "ohne"})


def plain_statistics(t):
    w = (t or "").encode().split()
    runs = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    covered = {j + k for j in range(len(w) - 4) if runs[tuple(w[j : j + 5])] > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    clean = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 200))), rng.choice(["en", "de"]), rng.choice(["a", None])) for i in range(600)]
    junk = [(1000 + i, " ".join(rng.choice(vocabulary) + "###$$$" for _ in range(60)), "en", "a") for i in range(20)]
    odd = [(2000, None, None, None), (2001, "", "en", "a"), (2002, "a b c d e " * 50, "xx", "rare"), (2003, "line one two three four five\n" * 3 + "x\n \n", "en", "a"), (2004, "a b a b a b a b a b c a b a b a", "en", "a"), (0, clean[0][1], "en", "a")]
    rows = clean + junk + odd
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("g", F.lit(1)).withColumn("used", F.lit(1))
    got = quality_verdicts(spark, docs).collect()
    stats = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got)
    assert stats == sorted((i, *plain_statistics(t)) for i, t, _, _ in rows)
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert all(verdict[i] for i, *_ in clean) and not any(verdict[i] for i, *_ in junk)
    assert not any(verdict[i] for i in (2000, 2001, 2002, 2004))
    assert quality_verdicts(spark, docs.limit(0)).count() == 0


def twin_distances(groups, x, v, floors, keep=0.75, shrink=50, steps=15):
    """Plain numpy form of the estimates: ``groups`` lists the three group keys of each row."""
    import numpy as np

    d, factor = x.shape[1], consistency(keep)
    members = {}
    for r, gs in enumerate(groups):
        for level, g in enumerate(gs):
            members.setdefault((level, g), []).append(r)
    up = {(lv, gs[lv]): (lv - 1, gs[lv - 1]) for gs in groups for lv in (1, 2)}
    low = lambda a: np.sort(a)[math.ceil(0.5 * len(a)) - 1]

    def shrunk(raw):
        out = {}
        for k in sorted(raw):
            n, (m, c) = len(members[k]), raw[k]
            if k[0]:
                r = shrink / (n + shrink)
                m, c = (1 - r) * m + r * out[up[k]][0], (1 - r) * c + r * out[up[k]][1]
            out[k] = (m, c)
        return out, {k: np.linalg.slogdet(c + np.diag(floors**2))[1] for k, (m, c) in out.items()}

    def d2(rows, m, c):
        whole = c + np.diag(floors**2)
        t = (x[rows] - m) / np.sqrt(1 + v[rows] / np.diag(whole))
        return np.einsum("ij,ij->i", t, np.linalg.solve(whole, t.T).T)

    best = {}
    for start in range(3):
        raw = {}
        for k, rows in members.items():
            med = np.array([low(x[rows, i]) for i in range(d)])
            mad = np.array([low(abs(x[rows, i] - med[i])) for i in range(d)])
            raw[k] = (med, np.diag((1.4826 * mad) ** 2)) if start == 0 else (med, np.zeros((d, d))) if start == 1 else (x[rows].mean(0), np.cov(x[rows].T, bias=True).reshape(d, d))
        now, det = shrunk(raw)
        for step in range(steps):
            raw = {}
            for k, rows in members.items():
                far = np.floor(np.log2(np.maximum(d2(rows, *now[k]), 1e-9)) * 32)
                core = np.array(rows)[far <= np.sort(far)[math.ceil(keep * len(far)) - 1]]
                raw[k] = (x[core].mean(0), factor * np.cov(x[core].T, bias=True).reshape(d, d))
            new, fresh = shrunk(raw)
            moved = [k for k in det if not step or fresh[k] < det[k] - 1e-3]
            now, det = now | {k: new[k] for k in moved}, det | {k: fresh[k] for k in moved}
            if not moved:
                break
        for k in det:
            if k not in best or det[k] < best[k][0] - 1e-9:
                best[k] = (det[k], now[k])
    return np.array([d2([r], *best[(2, gs[2])][1])[0] for r, gs in enumerate(groups)])


def test_outliers_equal_a_plain_twin(spark):
    import numpy as np

    from panelspark.llm.quality import FEATURES, KEEP

    rng = random.Random(8)
    rows = []
    for i in range(420):
        lang, source = rng.choice(["en", "en", "de"]), rng.choice(["a", "b", "b", None])
        w = ["x" * max(1, int(rng.gauss(5 + (lang == "de"), 2))) for _ in range(rng.randint(12, 90))]
        w = [f"{x}{j}" for j, x in enumerate(w)]
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            w[rng.randrange(len(w))] += "#"
        text = " ".join(w[:20]) + "\n" + " ".join(w[20:]) + "\nsame line\n" * rng.choice([0, 0, 2])
        rows.append((i, text, lang, source))
    rows += [(900, "one two three four five six seven eight nine ten", "xx", "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = [r for r in quality_verdicts(spark, docs).collect() if not r["base_failed"]]
    names = list(FEATURES)
    x = np.array([[r[n] for n in names] for r in got])
    v = np.array([[r[n.replace("x_", "v_", 1)] for n in names] for r in got])
    groups = [("", str(r["lang"]), f"{r['lang']}|{r['source']}") for r in got]
    want = twin_distances(groups, x, v, np.array(list(FEATURES.values())), keep=KEEP)
    assert np.allclose([r["d2"] for r in got], want, rtol=1e-6, atol=1e-9)
    assert [r["kept"] for r in got] == [bool(w <= CUT) for w in want]
    assert any(w > CUT for w in want) and sum(w > CUT for w in want) < 0.3 * len(want)


def test_many_groups_are_salted(spark, monkeypatch):
    from panelspark.llm import common

    rows = [(i, " ".join(f"w{i}x{j}" for j in range(12 + i % 50)), "en", f"s{i % 9}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {r["doc_id"]: r["d2"] for r in quality_verdicts(spark, docs).collect()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = {r["doc_id"]: r["d2"] for r in quality_verdicts(spark, docs).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_constants():
    assert consistency(0.75) == pytest.approx(1.4866, abs=1e-3)
    assert 1 - (1 - math.exp(-CUT / 2) * (1 + CUT / 2)) == pytest.approx(0.001, rel=0.01)
