import json

from pyspark.sql import functions as F

from panelspark.functions import scalars as sc
from panelspark.functions import text as tx
from panelspark.operators import requests as rq


def one(spark, fn, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(fn(F.col("x"))).collect()]


def test_cleaning(spark):
    cfg = tx.CleanConfig(filter_words=("реклама",), obscene=("плохо",), rm_substrings=("Подпишись",))
    got = one(spark, lambda c: tx.clean_text(c, cfg), "Рост #акции  🚀 на\xa05% @канал тут", "Это РЕКЛАМА", None, "Подпишись\nab\nдлинная строка . . конец", "пло@х хо", "сайт: www.site.ru и http://a.b/c t.me/x", "« слово » : да")
    assert got == ["Рост на 5% тут", "", "", "длинная строка . конец", "пло@х хо", "сайт: и", "«слово»: да"]


def test_obscene_after_cleaning_rejects(spark):
    cfg = tx.CleanConfig(obscene=("ab",))
    assert one(spark, lambda c: tx.clean_text(c, cfg), "a#x b", "a\U0001f680b") == ["a b", ""]


def test_names_and_numbers(spark):
    assert one(spark, tx.normalize_name, "Сбер-Банк", "Щука Ёж", "Ы") == ["cberbank", "schukaezh", "ы"]
    assert one(spark, sc.clean_numeric, "12,5", '"1 234"', ";", "15%", "", None, "abc", "-3.5") == [12.5, 1234.0, None, 0.15, None, None, None, -3.5]
    ends = one(spark, sc.period_end, "2023Q4", "2023", "2023Q5", "LTM", None, "2020Q1")
    assert [str(e) if e else None for e in ends] == ["2023-12-31", "2023-12-31", None, None, None, "2020-03-31"]
    assert [str(e) if e else None for e in one(spark, sc.parse_pub_date, "31.01.2024", "31.02.2024", "x", None)] == ["2024-01-31", None, None, None]
    assert one(spark, sc.unit_scale, "Долг, млрд руб", "Долг, Млн", "Долг") == [1e9, 1e6, 1.0]


def test_message_report(spark):
    rows = spark.createDataFrame([("2020-01-01 00:00:00", "a", "l", 1, "текст новости"), ("2018-01-01 00:00:00", "a", "l", 1, "x y z"), (None, "a", "l", 1, "abc"), ("2020-01-02 00:00:00", "a", "l", 1, " ")], "t string, channel_name string, message_link string, views long, news string")
    kept, report = tx.process_messages(rows.withColumn("datetime", F.col("t").cast("timestamp")).drop("t"))
    assert kept.count() == 1
    assert report.first().asDict() == {"total": 4, "bad_datetime": 1, "too_early": 1, "empty": 1}


def test_safe_json(spark):
    good = {"summary": "a\nb", "impact": {"X": "1"}, "confidence": 3}
    cases = ['{"summary": "a\nb", "impact": {"X": +1}, "confidence": 3}', 'text before {"summary": "s", "impact": {}} and after', '{"summary": "cut', None, "[1, 2]", "null", json.dumps(good)]
    got = one(spark, lambda c: rq.safe_json(c), *cases)
    assert got[0]["summary"] == "a\nb" and got[0]["impact"] == {"X": "1"}
    assert got[1]["summary"] == "s"
    assert all(got[i]["summary"].startswith("ERROR") for i in (2, 3, 4, 5))
    assert got[6]["impact"] == {"X": "1"}


def test_prompt_and_merge(spark):
    system, user = rq.split_prompt("#### SYSTEM ####\nSay {{x}} to {A}\n####\n## USER ##\n{B}\n##")
    assert (system, user) == ("Say {{x}} to {A}", "{B}")
    assert one(spark, lambda c: rq.render_prompt(system, {"A": c}), "me") == ["Say {x} to me"]
    schema = "date string, chunk int, answer struct<summary:string,impact:map<string,string>,confidence:int>"
    rows = [("2024-01-01", 1, ("one", {"A": "2", "B": "x"}, 1)), ("2024-01-01", 2, ("two", {"A": "-2"}, 1)), ("2024-01-01", 3, ("ERROR: no", {}, None)), ("2024-01-02", 1, ("ERROR: first", {}, None))]
    answers = spark.createDataFrame(rows, schema)
    s, x = rq.merge_day(answers)
    assert {r["date"]: (r["summary"], r["n_failed"]) for r in s.collect()} == {"2024-01-01": ("one two", 1), "2024-01-02": ("", 1)}
    assert [(r["secid"], r["score"]) for r in x.collect()] == [("A", -2.0)]
    s, x = rq.merge_day(answers, "mean")
    assert {r["date"]: r["summary"] for r in s.collect()} == {"2024-01-01": "WARNING: 1 part(s) failed. one two", "2024-01-02": "ERROR: first"}
    assert [(r["secid"], r["score"]) for r in x.collect()] == [("A", 0.0)]


def test_fuzzy_names_equal_all_pairs(spark):
    import random

    from panelspark.operators.entities import resolve_entities

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(6)
    codes = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 3, 6, 9, 14, 30]))) for _ in range(40)]
    names = []
    for c in codes * 4:
        x = list(c)
        for _ in range(rng.randint(0, 5)):
            at, what = rng.randrange(len(x) + 1), rng.random()
            x[at : at + (what < 0.6)] = [rng.choice("abcd")] if what > 0.3 else []
        names.append("".join(x))
    names = sorted(set(names) - {""})
    scores = spark.createDataFrame([("d", n, 1.0, i) for i, n in enumerate(names)], "date string, name string, score double, seq long")
    canon = spark.createDataFrame([(c.upper(),) for c in codes], "secid string")
    none = spark.createDataFrame([], "alias string, secid string")
    for cutoff in (85.0, 70.0):
        want = {}
        for n in names:
            best = [(100 * (1 - distance(n, c) / max(len(n), len(c))), -len(c), c.upper()) for c in codes]
            best = [b for b in best if b[0] >= (96 if b[1] == -1 and len(n) > 2 else cutoff)]
            if best:
                want[n] = max(best)[2]
        got = {r["name"]: r["secid"] for r in resolve_entities(scores, none, canon, cutoff).collect()}
        assert got == want and len(want) > 40


def test_cleaning_gates_change_nothing(spark):
    from panelspark.functions.text import clean_text

    texts = ["a #tag b", "see http://x.y/z now", "go site.com/path and x.ru/ y.me/1", "hi @user there", "@start stays", "  \u00a0 padded \t", "www.a.b rest", "wordhttps://glued tail here", "a" * 3000 + ".com/x end of it", " " * 3000 + "end"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["c"] for r in rows.orderBy("i").select(clean_text(F.col("t")).alias("c")).collect()]
    assert got == ["a b", "see now", "go and x.ru/", "hi there", "@start stays", "padded", "rest", "word tail here", "end of it", "end"]


def test_sentences_and_abbreviations(spark):
    from panelspark.operators.digest import format_summary

    got = one(spark, format_summary, "Рост 5 млн. Рублей. Да!  Нет? «Так» е.g. X", "a <DOT> b. C", " И т.д. Потом. 3 раза", "", None, "Млрд. Конец.\nДом. Далее")
    assert got == ["🔹 Рост 5 млн. Рублей.\n\n🔹 Да!\n\n🔹 Нет?\n\n🔹 «Так» е.g.\n\n🔹 X", "🔹 a <DOT> b.\n\n🔹 C", "🔹 И т.д. Потом. 3 раза", "", None, "🔹 Млрд. Конец.\n\n🔹 Дом.\n\n🔹 Далее"]


def test_entities_of_null_and_repeated_keys(spark):
    from panelspark.operators.entities import find_entities

    aliases = spark.createDataFrame([("сбер", "SBER"), ("банк россии", "CBR"), ("a+b", "AB")], "alias string, secid string")
    docs = spark.createDataFrame([(None, "Сбер растёт"), (1, "банк россии"), (1, "Сбер и a+b."), (2, "банк, россии"), (3, "сберкасса a b"), (4, None)], "id int, text string")
    got = {r["id"]: r["secids"] for r in find_entities(docs, aliases).collect()}
    assert got == {None: ["SBER"], 1: ["AB", "CBR", "SBER"]}


def test_messages_are_cleaned_once_a_row(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), "  a b  c  \r\n x \n☀ ok  yes\t"), (dt.datetime(2024, 1, 1), "ab"), (None, "long line")], "datetime timestamp, news string")
    rows, report = tx.process_messages(df)
    assert [r["news"] for r in rows.collect()] == ["a b c\nok yes"] and report.first()["empty"] == 1
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("1F1E0") == 1


def test_columns_of_payloads_are_looked_up_once(spark):
    from panelspark.sources import landing as la

    cols = ["SECID", "BOARDID", "TRADEDATE", "CLOSE", "OPEN"]
    value = json.dumps({"history": {"columns": cols, "data": [["A", "TQBR", "2024-01-02", "1.5", "NaN"], ["B", "X", "2024-01-02", "1", "2"], ["C", "TQBR"], [None, "TQBR", "bad", None, "3"], ["D", None, "2024-01-02", "1", "2"]]}})
    got = la.parse_history_json(spark.createDataFrame([(value,), ("{}",), (None,), ("nonsense",), ('{"history": {"columns": ["X"], "data": [["TQBR"]]}}',)], "value string"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["(None, None, 3.0, None, None, None, None, None)", "(datetime.date(2024, 1, 2), 'A', None, None, None, 1.5, None, None)"]
    assert "map_from_arrays" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_plain_aliases_of_several_words_need_no_text(spark):
    from panelspark.operators.entities import find_entities

    aliases = spark.createDataFrame([("банк россии", "CBR"), ("on the", "ON"), ("the", "THE")], "alias string, secid string")
    docs = spark.createDataFrame([(1, "Банк  России"), (2, "у банк россии, on"), (3, "on\nthe"), (4, "On the."), (5, "банк россииx on the_")], "id int, text string")
    out = find_entities(docs, aliases)
    assert {r["id"]: r["secids"] for r in out.collect()} == {2: ["CBR"], 3: ["THE"], 4: ["ON", "THE"]}
    assert "regexp_like" not in (plan := out._jdf.queryExecution().optimizedPlan().toString().lower()) and "rlike" not in plan
