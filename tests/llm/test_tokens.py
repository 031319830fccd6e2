import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from panelspark.llm.token_counts import WordBpe, count_merged, token_counts  # noqa: E402
from panelspark.llm.token_files import Encoder, read_token_files, tokens_through_files, write_token_files  # noqa: E402

ODD = ["", " ", "  a  b ", "a\n b", "a \n b\n", " x　y", "it's  we'll 12,5", "<|endoftext|> a<|endoftext|>", "x\x1c y \x1c", "é ß🙂 🙂🙂", "İSTANBUL ΣΊΣΥΦΟΣ", "a" * 3000, "<|startoftext|>hi <|endoftext|x", " tail\n "]


def random_texts(n):
    rng = random.Random(7)
    parts = [" ", " ", "\n", "\t", "a", "b", "é", "'s", "1", "🙂", ".", "  ", "\x1c", "<|endoftext|>", "Zü", "ſ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_merging_by_hand():
    assert count_merged(list("abab"), {("a", "b"): 0, ("ab", "ab"): 1}) == 1
    assert count_merged(list("aaa"), {("a", "a"): 0}) == 2
    assert count_merged([], {}) == 0


def test_counts_equal_the_library():
    path = P.path("word_bpe_49k.json")
    bpe, library = WordBpe(path), Tokenizer.from_file(path)
    for t in ODD + random_texts(800):
        assert bpe.count(t.encode()) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_counts_of_rows(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (None, ""), (1, "hello world")], "doc_id long, text string").withColumn("n_tokens", F.lit(5))
    rows = token_counts(docs, P.path("word_bpe_49k.json"), limit=1).collect()
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == [(0, 0, False), (0, 0, False), (11, 2, True), (11, 2, True)]


def test_ids_equal_the_library():
    path = P.path("byte_bpe_50k.json")
    texts, library = ODD + random_texts(800), Tokenizer.from_file(path)
    got = Encoder(path, limit=50).encode(texts, b"\0\0\0\0")
    assert got == [np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]


def column(encoder, texts, rows=512):
    return [x for block in encoder.encode_column(pa.array(texts, pa.string()), 0, rows) for x in block.to_pylist()]


def test_columns_equal_the_library():
    path = P.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(5)
    parts = [" ", " ", "  ", "\n", "\n\n", "\t", "ab", "é", "ß", "12", "²", "'s", "don't", "!?", "…", "“", "日本", "привет", "\u0301", "\u00a0", "\u3000", "<|endoftext|>", "<|", "_", "-", "\x85", "\x1f", "🙂", "\0"]
    texts = ODD + random_texts(500) + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    wanted = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    for limit in (50, 700_000):
        encoder = Encoder(path, limit)
        for _ in range(2):
            assert column(encoder, texts, 300) == wanted
        assert [column(encoder, [t])[0] for t in texts[:300]] == wanted[:300]
        assert column(encoder, []) == []
    encoder.between = None
    assert column(encoder, texts[:300]) == wanted[:300]


def test_parts_go_to_the_library_once(monkeypatch):
    encoder = Encoder(P.path("byte_bpe_50k.json"))
    words = [a + b + c for a in ("ka", "mé", "to") for b in ("lin", "ra", "zü") for c in ("", "s", "tion")]
    marks = ["", ",", ".", "!?", "###", ".\n", "\n\n"]
    texts = ["  ".join(w + m + v for w in words for m in marks) + " " for v in words]
    wanted = [[*encoder.library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    given = []
    monkeypatch.setattr(Encoder, "_merged", lambda self, parts, f=Encoder._merged: given.extend(parts.to_pylist()) or f(self, parts))
    monkeypatch.setattr(Encoder, "_learn", None)
    assert column(encoder, texts) == wanted and column(encoder, texts[::-1]) == wanted[::-1]
    parts = {p for t in texts for p, _ in encoder.library.pre_tokenizer.pre_tokenize_str(t)}
    assert len(given) == len(set(given)) <= len(parts) + len(texts)  # first pieces are tried with a space, too


def test_files_round_trip(spark, tmp_path):
    path, library = P.path("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD + random_texts(80))] + [(None, "null id"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seq", F.lit("clash")).repartition(5)
    got = tokens_through_files(spark, docs, path).orderBy("start").collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((-1 if d is None else d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x in zip(rows, ids))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert got[0]["doc_id"] is None and known == sorted(known)
    out = str(tmp_path / "orc")
    write_token_files(docs, path, out)
    plan = read_token_files(spark, out).filter("doc_id = 7")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in plan
    assert tokens_through_files(spark, docs.limit(0), path).count() == 0


def test_stripes_are_skipped_and_bloom_filters_written(spark, tmp_path):
    docs = spark.range(11000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 4), i -> sha2(concat(id, i), 256))) AS text")
    out = str(tmp_path / "orc")
    write_token_files(docs, P.path("byte_bpe_50k.json"), out, parts=1, stripe_mb=1)
    rows = read_token_files(spark, out)
    assert rows.filter("doc_id = 4321").count() == 1 and rows.filter("doc_id = 70000").count() == 0
    jvm, name = spark.sparkContext._jvm, next(x for x in (tmp_path / "orc").iterdir() if x.suffix == ".orc")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(name)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getStripes().size() > 1
    low = [s.getColumnStatistics()[1].getMinimum() for s in reader.getStripeStatistics()]
    high = [s.getColumnStatistics()[1].getMaximum() for s in reader.getStripeStatistics()]
    assert low == sorted(low) and all(h < x for h, x in zip(high, low[1:]))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0)) if hasattr(reader.rows(), "readStripeFooter") else None
    kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()} if footer is not None else set()
    assert {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8")} <= kinds
