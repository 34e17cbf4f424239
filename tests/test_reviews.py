"""Rules over short texts against plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from feedloom.functions import reviews


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string").repartition(2)


def score(text, lexicon=reviews.LEXICON, negators=reviews.NEGATORS, intensifiers=reviews.INTENSIFIERS, guarded=reviews.GUARDED):
    raw = 0.0
    for term, weight in lexicon.items():
        at = (text or "")[:1000].find(term)
        while at >= 0:
            if not (term in guarded and at and "가" <= text[at - 1] <= "힣"):
                w = weight * (1.5 if any(x in text[max(0, at - 8) : at] for x in intensifiers) else 1)
                raw += w * (-0.8 if any(x in text[max(0, at - 6) : at] for x in negators) else 1)
            at = text[:1000].find(term, at + len(term))
    return round(math.tanh(raw / 4), 4) + 0.0


KOREAN = [
    None, "", "좋아", "안 좋아요", "정말 안 좋아요", "색상별로 다르다", "색상 별로", "별로", "진짜 최고! 너무 추천", "최고" * 50, "안돼 안 돼 안된다", "못 좋아 없 좋다 않 만족", "렉 걸림. 초렉", "😀😀😀 안 😀 좋아", "x" * 995 + "좋아좋아", "비추비추 최악최악최악",
    "줄\n바꿈 안\n좋아", "개 좋다", "1234567 너무1234 좋다", "너무12345678좋다",
]


def test_korean_scores_equal_a_plain_scan(spark):
    got = {r["id"]: r["s"] for r in texts(spark, KOREAN).select("id", reviews.korean_score(F.col("text")).alias("s")).collect()}
    assert got == {i: pytest.approx(score(t), abs=1e-4) for i, t in enumerate(KOREAN)}
    assert got[2] > 0 > got[3] and got[5] == 0 and got[6] < 0


def test_a_lexicon_of_ones_own_with_overlapping_hits(spark):
    own = {"aba": 1.0, "ba": -0.5, "a.b": 2.0, "aa": 1.5}
    values = ["ababa", "a.b axb", "aaaa", "no aba", "very aba", "no very ba", "\\E aba", "(a.b)aa"]
    tables = {"lexicon": own, "negators": ("no ",), "intensifiers": ("very",), "guarded": ()}
    got = {r["id"]: r["s"] for r in texts(spark, values).select("id", reviews.korean_score(F.col("text"), **tables).alias("s")).collect()}
    assert got == {i: pytest.approx(score(t, own, ("no ",), ("very",), ()), abs=1e-4) for i, t in enumerate(values)}


@pytest.mark.parametrize(
    "text,want",
    [
        (None, []), ("", []), ("   ", []), ("짧다", []), ("ㅋㅋㅋ", ["emotion_only"]), (" LOL ", ["emotion_only"]), ("ㅋㅋ ㅎㅎ!! ㅠㅠ ❤ ~~~ ...", ["emotion_only"]),
        ("서비스센터에서 수리 받고 왔습니다", ["service_repair"]), ("어제 할인받아서 구매했어요", ["price_purchase"]), ("이거 어디서 사나요 궁금합니다", ["question"]),
        ("i love it so much", ["positive_general"]), ("would be nice, love it", []), ("gloves love items", []), ("not satisfied, but love it all", ["negative_general"]),
        ("gear 3 better than ring 12", ["comparison"]), ("better than 어디서 궁금", ["question", "comparison"]), ("gear 3 better than ring 12 어디서 궁금", ["comparison", "question"]),
        ("3달 사용 했습니다 정말로", ["experience"]), ("한달 쓰고 있는데 for 3 months", ["experience"]), ("1,200,000원 주고 샀어요 어디서", ["price_purchase", "question"]),
        ("수리 가격 문의 드립니다만", ["service_repair", "price_purchase"]), ("nothing of any interest here", []),
        ("그리고 " * 100 + "서비스센터 수리", []), ("서비스센터 " + "그리고 " * 100, ["service_repair"]),
    ],
)
def test_topics(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(reviews.topics(F.col("text")).alias("t")).first()["t"] == want


def test_other_only_where_allowed_and_long_enough(spark):
    df = spark.createDataFrame([("nothing of any interest here",), ("short",), ("ㅋㅋ",)], "text string")
    assert [r["t"] for r in df.select(reviews.topics(F.col("text"), other=True).alias("t")).collect()] == [["other"], [], ["emotion_only"]]


def test_masks_keep_every_position(spark):
    values = ["a (b c) d", "(x)(y)", "none", "", None, "((in) out)", "(open"]
    got = {r["id"]: r["m"] for r in texts(spark, values).select("id", reviews.masked(F.col("text"), r"\([^()]*\)", "none").alias("m")).collect()}
    blank = lambda p, t: re.sub(p, lambda m: " " * len(m[0]), t)
    assert got == {i: None if t is None else blank("none", blank(r"\([^()]*\)", t)) for i, t in enumerate(values)}


def test_longest_of_keys_that_contain_each_other(spark):
    keys = [("s9", "S9"), ("s9 pro", "S9P"), ("s9 pro max", "S9PM"), ("x", "X"), ("pro max", "PM"), ("note pro", "NP"), ("갤 탭", "T"), ("갤 탭 a", "TA"), ("", "E")]
    df = spark.createDataFrame([(k, c, i) for i, (k, c) in enumerate(keys)], "key string, code string, place long")
    values = ["my s9 pro max!", "s9", "ss9x", "the note pro", "갤 탭 a7", "갤 탭", "nothing", "", None, "pro max s9 pro", "note pros9 pro", "s9 pro s9 pro max pro max"]
    got = {r["id"]: r["code"] for r in reviews.longest_keys(texts(spark, values), df).collect()}
    want = {}
    for i, t in enumerate(values):
        held = sorted(((-len(k), p, c) for p, (k, c) in enumerate(keys) if k and t and k in t))
        if held:
            want[i] = held[0][2]
    assert got == want


def test_ten_thousand_keys_do_not_grow_the_plan(spark):
    small = reviews.longest_keys(texts(spark, ["a"]), spark.createDataFrame([("abc", "C", 0)], "key string, code string, place long"))
    keys = spark.range(10_000).selectExpr("concat('key ', id) as key", "concat('K', id) as code", "id as place")
    values = ["a key 77 here", "key 7777", "key 99999", "no"]
    large = reviews.longest_keys(texts(spark, values), keys)
    assert {r["id"]: r["code"] for r in large.collect()} == {0: "K77", 1: "K7777", 2: "K9999"}
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(large) < 2 * size(small)


def test_gate_for_noise_patterns_before_the_dictionary(spark):
    keys = spark.createDataFrame([("blue bolt", "BB", 0)], "key string, code string, place long")
    values = ["Blue   Bolt", "counterfeit blue bolt", "genuine, not counterfeit: blue bolt", "(blue bolt) no", "sku-1234 blue bolt", None, ""]
    got = {r["id"]: r["code"] for r in reviews.product_codes(texts(spark, values), keys).collect()}
    assert got == {0: "BB", 1: None, 2: "BB", 3: None, 4: "SKU", 5: None, 6: None}


def test_phrases_that_share_a_separator_count_as_in_the_sql(spark):
    from feedloom.functions.text import categories
    from feedloom.plans.registry import oracles

    values = ["and the and the was was was", "and the  and the was was was", "of the of the of the with with", "de la de la\nund und und", "and the", "", None]
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(values)))
    sql = oracles()["txt_categories"]
    want = dict(con.execute(sql[sql.index("select d.doc_id") :]).fetchall())
    got = {r["id"]: r["c"] for r in texts(spark, values).select("id", F.array_join(categories(F.col("text")), "|").alias("c")).collect()}
    assert got == want


def test_a_text_is_prepared_once_for_all_topics(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("text")).select(reviews.topics(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("substring(") == 1


def test_keys_are_sent_to_the_texts_and_never_texts_to_the_keys(spark, tmp_path):
    spark.range(300).selectExpr("id", "concat('a text on key ', id) as text").write.parquet(f"{tmp_path}/texts")
    spark.range(3000).selectExpr("concat('key ', id) as key", "concat('K', id) as code", "id as place").write.parquet(f"{tmp_path}/keys")
    got = reviews.longest_keys(spark.read.parquet(f"{tmp_path}/texts"), spark.read.parquet(f"{tmp_path}/keys"))
    assert {r["id"]: r["code"] for r in got.collect()} == {i: f"K{i}" for i in range(300)}
    assert "BuildLeft" not in got._jdf.queryExecution().executedPlan().toString()


def test_more_keys_than_are_sent_meet_the_texts_by_gram(spark, monkeypatch):
    monkeypatch.setattr(reviews, "SENT_KEYS", 1)
    keys = spark.createDataFrame([("s9", "S9", 0), ("s9 pro", "S9P", 1)], "key string, code string, place long")
    got = reviews.longest_keys(texts(spark, ["my s9 pro", "s9", None]), keys)
    assert {r["id"]: r["code"] for r in got.collect()} == {0: "S9P", 1: "S9"}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
