import hashlib

import pytest
from pyspark.sql import functions as F

from panelspark.llm.url_filters import judge_urls, links_of
from panelspark.llm.warc import archive_pages, read_record, read_seek_table, write_bundles

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def test_bundles(spark):
    big, small = "<p>" + "é" * 800, "tiny"
    rows = [(i, f"http://a/{i}", big if i % 2 else small) for i in range(40)] + [(100, None, None), (101, "http://x/\r\ny", big + "z"), (1, "http://a/1", big), (None, "http://n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("salt", F.lit("clash")).repartition(4)
    records, index = archive_pages(spark, pages)
    got = sorted(((-1 if r["page_id"] is None else r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records.collect())
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = h == big and i != 39
        want.append((-1 if i is None else i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 39 if again else None))
    assert got == sorted(want, key=lambda r: r[:4])
    fields, block = read_record(index.filter("page_id = 101").first().asDict())
    assert fields["WARC-Record-ID"] == "<urn:page:101>" and block.decode() == big + "z"
    import zstandard

    bundle = index.first()["bundle"]
    assert sum(raw for _, _, raw in read_seek_table(bundle)) == len(zstandard.ZstdDecompressor().stream_reader(open(bundle.removeprefix("file://"), "rb"), read_across_frames=True).read())
    assert archive_pages(spark, pages.limit(0))[0].count() == 0
    assert write_bundles.__doc__


def test_many_frames_and_bundles(spark, monkeypatch):
    from panelspark.llm import warc

    for name, low in (("FRAME", 4000), ("BUNDLE", 2000), ("FRAMES", 2)):
        monkeypatch.setattr(warc, name, low)
    rows = [(i, f"http://a/{i}", hashlib.sha1(str(i % 90).encode()).hexdigest() * 30) for i in range(120)]
    records, index = archive_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    places = index.collect()
    assert len({r["bundle"] for r in places}) > 4 and max(r["frame"] for r in places) > 0 and any(r["offset"] for r in places)
    got = {r["page_id"]: r for r in records.collect()}
    assert records.rdd.getNumPartitions() > 4 and len(got) == 120
    for r in places:
        fields, block = read_record(r.asDict())
        assert fields["WARC-Record-ID"] == f"<urn:page:{r['page_id']}>"
        assert block.decode() == (rows[r["page_id"]][2] if r["page_id"] >= 30 else "")
    assert all(got[i]["refers_to"] == (i + 90 if i < 30 else None) and got[i]["payload_digest"] == hashlib.sha1(rows[i][2].encode()).hexdigest() for i in got)


def test_verdicts_spread_over_aliases(spark):
    rows = [
        (1, "http://plain.info/a", "<html>"), (2, "http://bad.net/x", None), (3, "https://alias.info/p?q=1#f", "<link rel='canonical' href='http://bad.net/x'>"),
        (4, "http://hop.info/", "<META HTTP-EQUIV=\"refresh\" content=\"0; url=https://alias.info/p?q=1\">"), (5, "http://mixed.info/", "<link href=/ok rel=canonical>"),
        (6, None, None), (7, "no scheme", ""), (8, "HTTP://WWW.Example.NET/en/1", ""), (9, "http://x.example.com/de/", ""), (10, "http://good.org/fr/1", ""), (11, "http://notexample.net", ""), (3, "https://alias.info/p?q=1#f", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("host", F.lit(1))
    redirects = spark.createDataFrame([("http://mixed.info/ok", "http://good.org/fr/1"), ("http://mixed.info/", "http://bad.net/x"), (None, "http://z"), ("http://self.info/", "http://self.info/")], "src string, dst string")
    out = judge_urls(spark, pages, RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(rows)
    assert got[1][3] == "allow" and got[2] == ("bad.net", "/x", "net/", "block")
    assert got[3][2:] == (None, "block") and got[4][2:] == (None, "block")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[9][2:] == ("example.com/de/", "block") and got[10][2:] == ("org/fr/", "allow") and got[11] == ("notexample.net", "", None, "allow")
    with_log = {r["page_id"]: r["verdict"] for r in judge_urls(spark, pages, RULES, redirects).collect()}
    assert with_log[5] == "allow" and with_log[3] == "allow" and with_log[2] == "block"
    assert judge_urls(spark, pages.limit(0), RULES).count() == 0


@pytest.mark.parametrize("html,want", [
    ("<meta http-equiv=\"refresh\" content=\"0; url='http://a.com/x'\">", "http://a.com/x"), ("<meta http-equiv=refresh content=0;url=http://a.com/x>", "http://a.com/x"),
    ("<META content='5 ,  URL = http://a.com/x?a=1&amp;b=2 ' HTTP-EQUIV='Refresh'/>", "http://a.com/x?a=1&b=2"), ("<meta http-equiv=refresh content='0;http://a.com/x'>", "http://a.com/x"),
    ("<link rel='shortlink canonical' href=http://a.com/x>", "http://a.com/x"), ("<link data-href='http://bad.net/' rel=canonical href='/x'>", "http://s.org/x"),
    ("<link rel=icon data-rel=canonical href=/x>", None), ("<link rel=canonical data-href=/x>", None), ("<link title='a > b' rel='canonical' href='x'>", "http://s.org/d/x"),
    ("<link title=\"rel='canonical'\" href=/x>", None), ("<base target=_top><base href='http://b.org/e/'><link rel=canonical href=x>", "http://b.org/e/x"),
    ("<base href='/f/'><link rel=canonical href=x>", "http://s.org/f/x"), ("<meta http-equiv=refresh content=30>", None), ("<links rel=canonical href=/x>", None),
    ("<!-- <link rel=canonical href=/x> -->", None), ("<link rel=canonical href=''>", None), ("<meta name=refresh content='0;url=/x'>", None),
])
def test_tags_are_read_by_attribute(spark, html, want):
    pages = spark.createDataFrame([(1, "http://s.org/d/p", html)], "page_id long, url string, html string")
    assert [r["dst"] for r in links_of(pages).collect()] == ([want] if want else [])


def test_references_are_resolved(spark):
    from panelspark.llm.url_filters import resolved

    cases = {"http://a.com/d/e?x=1": {"../x": "http://a.com/x", "?q=1": "http://a.com/d/e?q=1", "f": "http://a.com/d/f", "./f/../g/.": "http://a.com/d/g/", "/z/./y?k=..": "http://a.com/z/y?k=..", "//b.org/x": "http://b.org/x", "https://c.net": "https://c.net", "#top": "http://a.com/d/e?x=1", "mailto:me@a.com": None, "../../../k": "http://a.com/k"}, "https://h.com": {"p": "https://h.com/p", "?a": "https://h.com/?a"}}
    rows = [(src, to, want) for src, x in cases.items() for to, want in x.items()]
    got = spark.createDataFrame(rows, "src string, to string, want string").select("to", "want", resolved(F.col("src"), F.col("to")).alias("got")).collect()
    assert [(r["to"], r["got"]) for r in got] == [(r["to"], r["want"]) for r in got]


def test_thousands_of_links_equal_plain_components(spark):
    import random

    rng = random.Random(3)
    hosts = [f"h{i}.{'net' if i % 40 == 0 else 'info'}" for i in range(3000)]
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1300)] + [(0, i) for i in range(1, 3000, 17)]
    shapes = ["<link rel=\"CaNONICAL\" href='{}'>", "<META http-equiv=Refresh content=\"3; URL={}\">", "<p><link href={} rel=canonical>"]
    rows = [(i, f"http://{h}/", "<!-- <link rel=canonical href=http://h0.net/> -->") for i, h in enumerate(hosts)]
    rows += [(10000 + n, f"http://{hosts[a]}/", shapes[n % 3].format(f"http://{hosts[b]}/")) for n, (a, b) in enumerate(edges)]
    rows += [(50000, "http://" + "x." * 3000 + "net/a", ""), (50001, "http://long.info/" + "y" * 200000, ""), (50002, "http://a.b.info/p/q", "")]
    root = list(range(3000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    bad = {find(i) for i in range(3000) if hosts[i].endswith(".net")}
    rules = [*RULES, ("block", "b.info", "/p/"), ("allow", "a.b.info", "/p")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge_urls(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert len(got) == len(rows)
    assert all(got[i][1] == ("block" if find(i) in bad else "allow") for i in range(3000))
    assert got[50000] == ("net/", "block") and got[50001] == (None, "allow") and got[50002] == ("a.b.info/p", "allow")


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    texts = {i: " ".join(f"w{i}x{j % 97}y{j}" for j in range(40 + i % 7)) for i in range(120)}
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in texts.items()] + [(500 + i, texts[i] + " tail", "en", "a") for i in range(10)] + [(600, "short", "en", "a"), (601, None, None, None), (700, "pre " * 3 + "alpha beta gamma delta epsilon zeta eta theta iota kappa " + texts[3][:200], "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "token_files"]
    table, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, str(tmp_path))
        kept[name] = [r["doc_id"] for r in table.select("doc_id").collect()]
        if name != "token_files":
            assert table.columns == docs.columns
    clean = set(range(120))
    assert clean <= set(kept["quality_rules"]) and not {600, 601} & set(kept["quality_rules"])
    assert clean <= set(kept["near_duplicates"]) and not set(range(500, 510)) & set(kept["near_duplicates"])
    assert set(kept["decontamination"]) == clean
    assert sorted(kept["token_files"]) == sorted(kept["source_mix"]) and max(map(kept["source_mix"].count, clean)) <= 3
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["token_files"])


def test_stages_decide_by_row(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import collections

    import corpus_pipeline
    def table(rows):
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))

    def kept(stage, docs):
        return collections.Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect())

    t = [" ".join(f"w{i}x{j % 97}y{j}" for j in range(40 + i % 7)) for i in range(300)]
    good = [(i, t[i]) for i in range(100)] + [(None, t[100]), (None, t[101]), (1, t[102])]
    docs = table([(i, x, "en", "a") for i, x in [*good, (None, "short"), (None, None), (1, "short"), (2, "short")]])
    assert kept(corpus_pipeline.quality_rules, docs) == collections.Counter(good)

    same = [(None, t[0]), (None, t[0]), (None, t[1]), (1, t[2]), (1, t[3]), (1, t[3]), (2, t[3] + " tail"), (None, t[3]), (None, None), (None, None)]
    got = kept(corpus_pipeline.near_duplicates, table([(i, x, "en", "ab"[n % 2]) for n, (i, x) in enumerate(same)]))
    assert got == collections.Counter({(None, t[0]): 1, (None, t[1]): 1, (1, t[2]): 1, (1, t[3]): 1, (None, None): 2})

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    mixed = [(None, t[0]), (None, item + " " + t[1]), (1, t[2]), (1, t[3] + " " + item), (None, None)]
    got = kept(corpus_pipeline.decontamination, table([(i, x, "en", "a") for i, x in mixed]))
    assert got == collections.Counter([mixed[0], mixed[2], mixed[4]])

    docs = table([(None if n % 3 else 7, " ".join(x.split()[:40]), "en", "abc"[n % 3 and n % 2 + 1]) for n, x in enumerate(t)] + [(None, t[0], "en", "b")] * 9)
    words = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    total, w = sum(words.values()), dict(zip("abc", (5, 2, 1)))
    aim = {s: total * w[s] / 8 for s in words}
    assert all(aim[s] < 3 * words[s] for s in words)
    out = corpus_pipeline.source_mix(spark, docs, str(tmp_path))
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    assert out.columns == docs.columns and taken.keys() == aim.keys()
    assert all(abs(taken[s] - aim[s]) <= 80 for s in aim)
