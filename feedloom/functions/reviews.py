"""Rules over short texts in Korean and English: lexicon sentiment with guards, topics with negation, product names from a dictionary,
and the order in which a post passes them.

The word tables are parameters. The given tables hold no such texts, so `reviews` derives one for every post from the post's numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import categories, engagement_score, first_match, lexicon_score, tokens, whole
from feedloom.plans.registry import query
from feedloom.plans.storage import cut
from feedloom.sources.posts import Tables

# The Korean lexicon with its weights.
POSITIVE = {
    "좋다": 1.5, "좋아": 1.5, "좋은": 1.4, "좋네": 1.4, "좋고": 1.2, "좋음": 1.4, "만족": 1.8, "훌륭": 2.0, "최고": 2.0, "추천": 1.6, "괜찮": 1.0, "굿": 1.2,
    "빠르": 1.2, "선명": 1.2, "예쁘": 1.4, "이쁘": 1.4, "대박": 1.8, "갓": 1.5, "혜자": 1.8, "꿀": 1.3, "편하": 1.3, "쾌적": 1.4, "깔끔": 1.2, "탄탄": 1.2,
    "안정적": 1.5, "잘된다": 1.5, "잘 된다": 1.5, "잘나와": 1.4, "잘 나와": 1.4, "맘에 든다": 1.8, "마음에 든다": 1.8, "감동": 1.6, "강추": 2.0, "튼튼": 1.3,
    "가성비": 1.2, "쓸만": 1.0, "신세계": 1.6, "환상": 1.7, "역대급": 1.8,
}
NEGATIVE = {
    "별로": -1.6, "실망": -2.0, "불편": -1.6, "느리": -1.5, "버벅": -1.8, "렉": -1.5, "발열": -1.6, "뜨겁": -1.4, "방전": -1.8, "광탈": -2.0, "안돼": -1.6, "안 돼": -1.6,
    "안된다": -1.6, "안 된다": -1.6, "문제": -1.2, "오류": -1.6, "버그": -1.6, "고장": -2.0, "먹통": -2.0, "구리": -1.6, "최악": -2.5, "거지같": -2.5, "쓰레기": -2.5,
    "짜증": -1.8, "불량": -2.2, "하자": -1.8, "깨짐": -1.8, "깨졌": -1.8, "비싸": -1.3, "창렬": -1.8, "후회": -2.0, "반품": -1.6, "교환": -1.2, "안좋": -1.8, "안 좋": -1.8,
    "떨어진다": -1.2, "튕김": -1.6, "튕긴": -1.6, "끊김": -1.5, "끊긴": -1.5, "심각": -1.6, "노답": -2.0, "갑갑": -1.3, "답답": -1.4, "아쉽": -1.2, "거슬": -1.3, "별루": -1.6,
    "에바": -1.4, "혹사": -1.4, "막장": -2.0,
}
LEXICON = POSITIVE | NEGATIVE
# What turns a hit round within 6 characters before it, what strengthens it within 8, and terms that don't count right after a syllable.
NEGATORS = ("안", "못", "없", "않", "비추")
INTENSIFIERS = ("너무", "진짜", "완전", "개", "존나", "졸라", "짱", "매우", "정말", "겁나")
GUARDED = ("별로", "별루", "갓", "굿", "꿀", "렉")
NEAR_NEGATOR, NEAR_INTENSIFIER, TURNED, STRONGER, SATURATION, THRESHOLD = 6, 8, -0.8, 1.5, 4.0, 0.2


def before(text: Column, term: Column, pattern: Column, size: int) -> Column:
    """For each occurrence of a term (pattern: its quoted form), from the left and without overlap, the size characters before it, or as many as there are.
    What stands between occurrences is joined up, since a lookbehind would count surrogates."""
    last = lambda x: F.when(F.length(x) > size, F.substring(x, -size, size)).otherwise(x)
    parts = F.split(text, pattern, -1)
    start = F.struct(F.lit("").alias("tail"), F.array().cast("array<string>").alias("found"))

    def more(s: Column, part: Column) -> Column:
        w = last(F.concat(s["tail"], part))
        return F.struct(last(F.concat(w, term)).alias("tail"), F.array_append(s["found"], w).alias("found"))

    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, more)["found"]


def guarded_score(text: Column, lexicon=LEXICON, negators=NEGATORS, intensifiers=INTENSIFIERS, guarded=GUARDED) -> Column:
    """The sum of the weights of all hits of a lexicon in a text. Terms are looked for one by one, so hits of different terms may overlap. The
    lexicon is one constant, so the plan doesn't grow with it."""
    size = max(NEAR_NEGATOR, NEAR_INTENSIFIER)
    any_of = lambda ws: "|".join(re.escape(w) for w in ws)
    terms = F.array(*[F.struct(F.lit(w).alias("term"), F.lit(float(x)).alias("weight"), F.lit(w in guarded).alias("guarded"), F.lit(re.escape(w)).alias("pattern")) for w, x in lexicon.items()])
    ends = lambda x, n: F.when(F.length(x) > n, F.substring(x, -n, n)).otherwise(x)

    def one(e: Column, x: Column) -> Column:
        w = e["weight"] * F.when(ends(x, NEAR_INTENSIFIER).rlike(any_of(intensifiers)), STRONGER).otherwise(1.0) if intensifiers else e["weight"]
        w = w * F.when(ends(x, NEAR_NEGATOR).rlike(any_of(negators)), TURNED).otherwise(1.0) if negators else w
        return F.when(e["guarded"] & x.rlike("[가-힣]$"), 0.0).otherwise(w)

    found = F.filter(terms, lambda e: F.contains(text, e["term"]))
    return F.aggregate(found, F.lit(0.0), lambda s, e: s + F.aggregate(before(text, e["term"], e["pattern"], size), F.lit(0.0), lambda r, x: r + one(e, x)))


def korean_score(text: Column, head: int = 1000, **tables) -> Column:
    """-1 to 1; 0 for no text. The first `head` characters are looked at."""
    return F.coalesce(F.round(F.tanh(guarded_score(F.substring(text, 1, head), **tables) / SATURATION), 4) + 0.0, F.lit(0.0))


def score_label(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= threshold, "positive").when(score <= -threshold, "negative").otherwise("neutral")


# Pieces of the derived texts; names are those of the given parts.
_SUBJECTS = ("배터리가", "화면이", "색상", "가격은", "카메라는 3달 사용", "small ring 7", "genuine blue bolt", "red widget 12")
_GAPS = (" ", "", " ")
_MODS = ("", "너무 ", "진짜 ", "안 ", "정말 안 ", "못 ", "완전 ")
_ENDS = ("", " 추천합니다", " 좋겠다", " ㅋㅋ", " 1,200,000원 주고 샀", " better than gear 3", " 어디서 사나요?", " love it", " (hot gear 40) counterfeit", " not satisfied", " for 3 months")
_TERMS = tuple(LEXICON)


def reviews(t: Tables) -> DataFrame:
    """id, language, likes, comments, shares, product_id and a derived text for every post."""
    k, n = F.col("comments"), F.col("likes")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    text = F.concat(pick(_SUBJECTS, k), pick(_GAPS, n), pick(_MODS, k + n), pick(_TERMS, k * 7 + n), F.lit(". "), pick(_SUBJECTS, n), F.lit(" "), pick(_MODS, n), pick(_TERMS, n * 3 + k), pick(_ENDS, k + n))
    text = F.when(k % 23 == 0, None).when(k % 19 == 0, "ㅋㅋㅋ").when(k % 29 == 0, "짧다").when(k % 31 == 0, F.concat(text, F.repeat(F.lit(" 그리고"), 80), text)).otherwise(text)
    return t.posts.select("id", "language", "likes", "comments", "shares", "product_id", text.alias("text"))


def _pick_sql(xs, i: str) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + f"][({i}) % {len(xs)} + 1]"


_TEXT = f"""{_pick_sql(_SUBJECTS, 'comments')} || {_pick_sql(_GAPS, 'likes')} || {_pick_sql(_MODS, 'comments + likes')} || {_pick_sql(_TERMS, 'comments * 7 + likes')} || '. ' || {_pick_sql(_SUBJECTS, 'likes')} || ' '
  || {_pick_sql(_MODS, 'likes')} || {_pick_sql(_TERMS, 'likes * 3 + comments')} || {_pick_sql(_ENDS, 'comments + likes')}"""
_REVIEWS = f"""(select id, language, likes, comments, shares, product_id, case when comments % 23 = 0 then null when comments % 19 = 0 then 'ㅋㅋㅋ' when comments % 29 = 0 then '짧다'
  when comments % 31 = 0 then x || repeat(' 그리고', 80) || x else x end as text from (select *, {_TEXT} as x from posts))"""
_LEX = ", ".join(f"('{w}', {x}::double, {w in GUARDED})" for w, x in LEXICON.items())
_KO = f"""(select r.id, coalesce(round(tanh(s / 4), 4) + 0.0, 0.0) as score from {_REVIEWS} r left join (
  select id, sum(weight * case when regexp_matches(b8, '{"|".join(INTENSIFIERS)}') then 1.5::double else 1.0 end * case when regexp_matches(b6, '{"|".join(NEGATORS)}') then -0.8::double else 1.0 end) as s
  from (select id, weight, guarded, substr(head, greatest(p - 8, 1), least(p - 1, 8)) as b8, substr(head, greatest(p - 6, 1), least(p - 1, 6)) as b6
    from (select id, left(text, 1000) as head, weight, guarded, unnest(list_filter(range(1, length(left(text, 1000)) + 1), lambda p: substr(left(text, 1000), p, length(term)) = term)) as p
      from {_REVIEWS} join (values {_LEX}) l(term, weight, guarded) on contains(left(text, 1000), term)))
  where not (guarded and regexp_matches(b6, '[가-힣]$')) group by id) using (id))"""
_LABEL = "case when score >= 0.2 then 'positive' when score <= -0.2 then 'negative' else 'neutral' end"


@query(f"select id, score, {_LABEL} as label from {_KO}")
def txt_korean_sentiment(t: Tables) -> DataFrame:
    """The score of a Korean text and its label; every post is scored, whatever its language."""
    return reviews(t).select("id", korean_score(F.col("text")).alias("score")).withColumn("label", score_label(F.col("score")))


#: Topics by keywords; a small table that shows every branch. A keyword of letters counts as a whole word, another one anywhere.
TOPIC_WORDS = (
    ("positive_general", ("추천합니다", "최고입니다", "만족합니다", "love it", "highly recommend")),
    ("negative_general", ("실망", "별로", "최악", "really bad", "not satisfied")),
    ("question", ("어디서", "궁금", "인가요", "?")),
    ("comparison", ("better than", "에 비해", "versus")),
    ("price_purchase", ("샀", "가격", "할인", "구매", "price")),
    ("service_repair", ("서비스센터", "수리", "교환", "repair")),
    ("experience", ("쓰고 있", "사용기", "한달")),
    ("expectation", ("출시", "기대", "좋겠")),
)
# Which of equal topics comes first, and the lengths that count.
PRIORITY = ("service_repair", "price_purchase", "question", "comparison", "expectation", "experience", "negative_general", "positive_general", "emotion_only")
SHORTEST, LONG, HEAD, BONUS = 10, 300, 250, 2
#: What cancels a positive topic: negations and wishes.
CANCELS = ("좋지 않", "안 좋", "좋겠", "not satisfied", "not great", "would be nice", "if only")
EMOTION = r"[\s!?.~^ㅋㅎㅠㅜㅇㄴㄷㄱ❤♥♡()/\\\x{1F300}-\x{1FAFF}]+"
EMOTION_WORDS = ("lol", "wow", "omg", "ㄹㅇ", "ㅇㅈ")
MODEL = r"(?:model|ring|widget|gear)\s*[a-z]?\d{1,3}"
PRICE = r"\d{1,3}(?:,?\d{3})+\s*원|\d+\s*만\s*원|\$\d+|\d+\s*달러"
PERIOD = r"\d+\s*(?:달|개월|년)\s*(?:사용|쓴|써|동안|째)|for\s+\d+\s+(?:months?|years?)|\d+\s+(?:months?|years?)\s+of\s+use"


def _is_word(k: str) -> bool:
    return k.isascii() and k.replace(" ", "").replace("-", "").replace("'", "").isalpha()


def once(x: Column, f) -> Column:
    """f of x, which is computed once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def topics(text: Column, table=TOPIC_WORDS, priority=PRIORITY, cancels=CANCELS, model: str = MODEL, price: str = PRICE, period: str = PERIOD, other: bool = False) -> Column:
    """The topics of a short text, the strongest first: how many of a topic's keywords are there, with a bonus for a comparison of two models, a purchase with a
    price and an experience of a stated time, which is a topic by itself. Negations and wishes cancel the positive topic. A text that is nothing but
    emotion has that topic alone; texts under SHORTEST characters have no other, and of long ones the beginning decides."""
    none = F.array().cast("array<string>")

    def found(scan: Column) -> Column:
        there = lambda k: scan.rlike(whole(re.escape(k))) if _is_word(k) else scan.contains(k)
        count = lambda ks: sum((F.when(there(k), 1).otherwise(0) for k in ks[1:]), F.when(there(ks[0]), 1).otherwise(0))
        cancelled = F.exists(F.array(*map(F.lit, cancels)), lambda c: F.contains(scan, c))
        timed = scan.rlike(period)
        bonus = {"comparison": F.regexp_count(scan, F.lit(whole(model))) >= 2, "price_purchase": scan.rlike(price), "experience": timed}
        rated = []
        for name, words in table:
            n = count(words)
            if name == "positive_general":
                n = once(n, lambda n: F.when((n > 0) & cancelled, 0).otherwise(n))
            if name == "experience":
                n = once(n, lambda n: F.when((n == 0) & timed, BONUS).otherwise(n))
            if name in bonus:
                extra = bonus[name]
                n = once(n, lambda n: F.when((n > 0) & extra, n + BONUS).otherwise(n))  # noqa: B023
            rated.append(F.struct((-n).alias("score"), F.lit(priority.index(name) if name in priority else len(priority)).alias("place"), F.lit(name).alias("name")))
        names = F.transform(F.array_sort(F.filter(F.array(*rated), lambda x: x["score"] < 0)), lambda x: x["name"])
        return once(names, lambda x: F.when(F.size(x) == 0, F.array(F.lit("other"))).otherwise(x)) if other else names

    def of(own: Column) -> Column:
        scan = F.lower(F.when(F.length(own) > LONG, F.substring(own, 1, HEAD)).otherwise(own))
        emotion = F.lower(own).isin(*EMOTION_WORDS) | own.rlike(f"^{EMOTION}$")
        return F.when(F.coalesce(own, F.lit("")) == "", none).when(emotion, F.array(F.lit("emotion_only"))).when(F.length(own) < SHORTEST, none).otherwise(once(scan, found))

    return once(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), of)


def _there_sql(k: str) -> str:
    quoted = k.replace("'", "''")
    return f"regexp_matches(scan, '(^|[^\\p{{L}}\\p{{N}}_]){quoted}($|[^\\p{{L}}\\p{{N}}_])')" if _is_word(k) else f"contains(scan, '{quoted}')"


def _topic_sql() -> str:
    parts = []
    for name, words in TOPIC_WORDS:
        n = "(" + " + ".join(f"{_there_sql(k)}::int" for k in words) + ")"
        if name == "positive_general":
            n = f"(case when {' or '.join(_there_sql(c) if not _is_word(c) else f'contains(scan, {chr(39)}{c}{chr(39)})' for c in CANCELS)} then 0 else {n} end)"
        if name == "experience":
            n = f"(case when {n} = 0 and regexp_matches(scan, '{PERIOD}') then 2 else {n} end)"
        extra = {"comparison": f"len(regexp_extract_all(scan, '\\b{MODEL}(?:[^\\p{{L}}\\p{{N}}_]|$)')) >= 2", "price_purchase": f"regexp_matches(scan, '{PRICE}')", "experience": f"regexp_matches(scan, '{PERIOD}')"}.get(name)
        score = f"case when {n} > 0 and {extra} then {n} + 2 else {n} end" if extra else n
        parts.append(f"select id, '{name}' as name, {PRIORITY.index(name)} as place, {score} as score from s")
    emotion = EMOTION.replace("'", "''")
    return f"""with r as (select id, trim(text) as own from {_REVIEWS}), s as (select id, own, lower(case when length(own) > 300 then left(own, 250) else own end) as scan from r),
      e as (select id, coalesce(own, '') <> '' and (lower(own) in {EMOTION_WORDS} or regexp_full_match(own, '{emotion}')) as emo, length(own) >= 10 as long_ from r),
      f as (select id, string_agg(name, '|' order by score desc, place) as found from ({" union all ".join(parts)}) where score > 0 group by id)
      select e.id, case when emo then 'emotion_only' when long_ then coalesce(found, '') else '' end as topics from e left join f using (id)"""


@query(f"select id, topics from ({_topic_sql()})")
def txt_topics(t: Tables) -> DataFrame:
    return reviews(t).select("id", F.array_join(topics(F.col("text")), "|").alias("topics"))


def masked(text: Column, *patterns: str) -> Column:
    """The text with every match of the patterns, one after the other, blanked out; its length and all other positions stay."""
    for p in patterns:
        blanks = F.transform(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), lambda m: F.repeat(F.lit(" "), F.length(m)))
        text = F.array_join(F.zip_with(F.split(text, p, -1), blanks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return text


GRAM = 3


#: Filed keys up to which they are sent to every task; of more, texts and keys meet by gram.
SENT_KEYS = 200_000


def longest_keys(texts: DataFrame, keys: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, key, code: of the keys (key, code, place) that a text holds, the longest, of equal ones the one of least place; texts without one have no row.

    A key is filed under its GRAM characters that fewest keys share, so a text meets only keys of which it holds a rare part, whether there are ten
    keys or a million. Texts aren't shuffled while the filed keys are at most SENT_KEYS; else both sides meet by gram. Which side is sent is settled by the counted keys and not by Spark's estimate, which takes the rows of exploded texts for
    no larger than the texts. id_col names a row."""
    size = F.length("key")
    filed = keys.filter("key <> ''").dropDuplicates(["key", "place"]).withColumn("gram", F.explode(F.when(size < GRAM, F.array("key")).otherwise(F.transform(F.sequence(F.lit(1), size - GRAM + 1), lambda i: F.substring(F.col("key"), i, F.lit(GRAM))))))
    common = filed.groupBy("gram").agg(F.count("*").alias("n"))
    filed = filed.join(common, "gram").groupBy("key", "code", "place").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    filed = cut(filed)
    filed = filed.hint("broadcast" if filed.count() <= SENT_KEYS else "merge")
    short = [r[0] for r in keys.filter((size > 0) & (size < GRAM)).select(size).distinct().collect()]  # at most GRAM - 1 values
    base, text = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text")
    # a piece at the end may be shorter; what it finds is held against the text as well
    rows = base.filter("text <> ''").select("id", "text", F.explode(F.sequence(F.lit(1), F.length(text))).alias("at"))
    rows = rows.withColumn("n", F.explode(F.array(*map(F.lit, (GRAM, *short))))) if short else rows.withColumn("n", F.lit(GRAM))
    rows = rows.select("id", "text", F.substring(F.col("text"), F.col("at"), F.col("n")).alias("gram"))
    hits = rows.join(filed, "gram").filter(F.contains("text", "key")).select("id", "key", "code", (-F.length("key")).alias("size"), "place")
    return hits.groupBy("id").agg(F.min(F.struct("size", "place", "key", "code")).alias("x")).select("id", "x.key", "x.code")


#: What names no product, unless a text says that it is about one; what is blanked out; codes by pattern before the dictionary.
NOISE, CONTEXT, MASKS = r"counterfeit", r"genuine", (r"\([^()]*\)",)
CODES = (("SKU", r"sku-\d{4}"),)


def product_codes(texts: DataFrame, keys: DataFrame, id_col: str = "id", text_col: str = "text", noise: str = NOISE, context: str = CONTEXT, masks=MASKS, codes=CODES) -> DataFrame:
    """id and the code of the product that a text is about, null if there is none: a gate for noise, blanked parts, patterns in order, then the longest key."""
    norm = F.trim(F.regexp_replace(F.lower(F.col(text_col)), r"\s+", " "))
    rows = texts.select(F.col(id_col).alias("id"), norm.alias("text"))
    rows = rows.select("id", F.when(~(F.col("text").rlike(noise) & ~F.col("text").rlike(context)), masked(F.col("text"), *masks)).alias("text"))
    # written, since filters would be computed down in the texts' own expressions and the rows are read twice
    named = cut(rows.withColumn("named", F.nullif(first_match(F.col("text"), codes), F.lit("other"))))
    found = longest_keys(named.filter("named is null and text is not null"), keys).select("id", F.col("code").alias("found"))
    return named.join(found, "id", "left").select("id", F.coalesce("named", "found").alias("code"))


def part_names(t: Tables) -> DataFrame:
    """Keys from the given parts: a name, and a name with a size, which contains the other."""
    p = t.table("part").select(F.lower("p_name").alias("name"), F.col("p_size").cast("string").alias("size"))
    keys = p.select(F.col("name").alias("key")).union(p.select(F.concat_ws(" ", "name", "size"))).distinct()
    return keys.select("key", F.upper(F.replace("key", F.lit(" "), F.lit("_"))).alias("code"), F.col("key").alias("place"))


_KEYS = "(select distinct key from (select lower(p_name) as key from part union all select lower(p_name) || ' ' || p_size::varchar from part))"
_CODES = f"""(select id, upper(replace(key, ' ', '_')) as code from (select id, key, row_number() over (partition by id order by length(key) desc, key) as r
  from (select id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '\\([^()]*\\)', '   ', 'g') as text from {_REVIEWS} where not (contains(text, 'counterfeit') and not contains(text, 'genuine'))) join {_KEYS} on contains(text, key)) where r = 1)"""


@query(f"select r.id, code from {_REVIEWS} r left join {_CODES} using (id)")
def txt_product_codes(t: Tables) -> DataFrame:
    return product_codes(reviews(t), part_names(t))


def enriched(texts: DataFrame) -> DataFrame:
    """A post's way through the rules, in order: score and label from the Korean lexicon for Korean texts and from the word lexicon for others, categories, engagement."""
    other = F.coalesce(F.round(lexicon_score(tokens(F.col("text"), 1, ())), 4) + 0.0, F.lit(0.0))
    rows = texts.withColumn("new_score", F.when(F.col("language") == "ko", korean_score(F.col("text"))).otherwise(other))
    return rows.select("id", "new_score", score_label(F.col("new_score")).alias("new_label"), F.coalesce(F.array_join(categories(F.col("text")), "|"), F.lit("")).alias("categories"), engagement_score(F.col("likes"), F.col("comments"), F.col("shares")).alias("engagement"))


_WORD_SCORE = "tanh((len(list_filter(ws, lambda w: w in ('the', 'then', 'here', 'their'))) - len(list_filter(ws, lambda w: w in ('her', 'erre', 'ther', 'hore'))))::double / 4)"
_ENRICHED = f"""(select r.id, case when language = 'ko' then k.score else coalesce(round({_WORD_SCORE}, 4) + 0.0, 0.0) end as score, likes, comments, shares from (select *, regexp_extract_all(lower(text), '[a-z]+') as ws from {_REVIEWS}) r join {_KO} k using (id))"""


@query(f"""select id, score as new_score, {_LABEL} as new_label, '' as categories, round(least(ln(1 + (likes + 2 * comments + 3 * shares)::double) / ln(10001.0) * 100, 100), 2) as engagement from {_ENRICHED}""")
def txt_enriched(t: Tables) -> DataFrame:
    """The derived texts name no category of the small table, so theirs are empty; documents show those (txt_categories)."""
    return enriched(reviews(t))


def reprocess(t: Tables, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that a run over stored posts changes: Korean posts get score and label anew, posts without product the one that their text names. Unchanged rows
    aren't in it; update_by_id writes them."""
    old = t.posts.select("id", F.col("score").alias("old_score"), F.col("label").alias("old_label"))
    ko = texts.filter("language = 'ko'").select("id", korean_score(F.col("text")).alias("score")).withColumn("label", score_label(F.col("score")))
    ko = ko.join(old, "id").filter(~(F.col("score").eqNullSafe(F.col("old_score")) & F.col("label").eqNullSafe(F.col("old_label")))).select("id", "score", "label")
    codes = product_codes(texts.filter("product_id is null and text is not null"), keys).filter("code is not null")
    return ko.join(codes, "id", "full")


@query(f"""select * from (with ko as (select id, k.score, {_LABEL.replace('score', 'k.score')} as label from {_KO} k join posts p using (id) where language = 'ko' and (k.score is distinct from p.score or {_LABEL.replace('score', 'k.score')} is distinct from p.label)),
  c as (select id, code from {_CODES} join posts using (id) where product_id is null)
  select coalesce(ko.id, c.id) as id, score, label, code from ko full join c on ko.id = c.id)""")
def ops_reprocess(t: Tables) -> DataFrame:
    return reprocess(t, reviews(t), part_names(t))
