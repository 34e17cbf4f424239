"""Quality rules by weak supervision.

Each rule looks at the statistics of one text and votes good (1), bad (-1) or abstains
(0). A generative model with two accuracies a rule (how often it is right on good texts, and
on bad ones, when it votes) is fitted by expectation-maximisation on the counts of the vote
patterns (at most 3^rules rows whatever the input's size), and the posterior probability
that a text is good decides, where an all-must-pass filter would reject on a single vote. All text work is built-in expressions; nothing but the pattern
counts leaves the executors.

Defined cases: a null, empty or blank text has no words and fails the base rules; very
long texts are used whole; repeated rows are judged alike; an empty table gives no rows
(and the prior accuracies are never used); extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, cut, documents, free, words

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
ROUNDS = 30


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_symbol_runs, n_upper,
    n_letters to docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    df = docs.withColumn("__w", words(text)).withColumn("__l", lines)
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate(text, SPACE_CHARS, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    df = df.withColumn("n_lines", F.size("__l").cast("long")).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    df = df.withColumn("n_repeat_words", repeat_words(F.col("__w"), F.col("n_words")))
    df = df.withColumn("n_symbol_runs", F.regexp_count(text, F.lit(f"[{SYMBOLS}]+")).cast("long"))
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    return df.withColumn("n_upper", upper.cast("long")).withColumn("n_letters", letters.cast("long")).drop("__w", "__l")


def repeat_words(w: Column, n: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first
    included. Windows are sorted, so equal ones are neighbours; the starts of the repeated
    ones, in order, then cover min(5, distance to the next start) words each."""
    starts = F.sequence(F.lit(0), (n - WINDOW).cast("int"))
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    window = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)])
    pairs = F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("s"), i.alias("i"))))
    last = F.size(pairs) - 1
    same = lambda a, x: F.coalesce(a["s"] == x["s"], F.lit(False))
    twice = lambda p: F.sort_array(F.transform(F.filter(p, lambda x, k: same(F.get(p, k - 1), x) | same(F.get(p, k + 1), x)), lambda x: x["i"]))
    covered = lambda q: F.aggregate(F.transform(q, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    # a one-element array holds an intermediate result, so that it is computed once
    exact = F.element_at(F.transform(F.transform(F.array(pairs), twice), covered), 1)
    any_twice = F.size(F.array_distinct(hashed)) < F.size(hashed)
    return F.when(n > WINDOW, F.when(any_twice, exact).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _ratio(a: str, b: str) -> str:
    return f"(cast({a} as double) / greatest({b}, 1))"


#: (name, votes bad if, votes good if), in SQL that Spark and other engines read alike.
RULES = (
    ("symbols", f"{_ratio('n_symbols', 'word_chars')} > 0.05", f"{_ratio('n_symbols', 'word_chars')} < 0.01"),
    ("symbol_runs", f"{_ratio('n_symbol_runs', 'n_words')} > 0.3", f"{_ratio('n_symbol_runs', 'n_words')} < 0.05"),
    ("repeats", f"{_ratio('n_repeat_words', 'n_words')} > 0.2", f"{_ratio('n_repeat_words', 'n_words')} < 0.05"),
    ("lines", f"{_ratio('n_dup_lines', 'n_lines')} > 0.3", "n_lines > 2 and n_dup_lines = 0"),
    ("capitals", f"{_ratio('n_upper', 'n_letters')} > 0.3", f"{_ratio('n_upper', 'n_letters')} < 0.1"),
    ("word_length", f"{_ratio('word_chars', 'n_words')} > 14.0 or {_ratio('word_chars', 'n_words')} < 2.0", f"{_ratio('word_chars', 'n_words')} between 3.0 and 9.0"),
    ("letters", f"{_ratio('n_letters', 'word_chars')} < 0.6", f"{_ratio('n_letters', 'word_chars')} > 0.85"),
    ("size", "n_words < 10", "n_words >= 50"),
)
#: Where expectation-maximisation starts, and the ranges that it keeps to: a rule that says
#: bad of more than 1 % of the good texts, or of under 10 % of the bad ones, isn't a rule.
START_PRIOR, START_GOOD, START_BAD = 0.8, 0.99, 0.2
PRIOR_RANGE, GOOD_RANGE, BAD_RANGE = (0.05, 0.95), (0.99, 0.999), (0.1, 0.95)


def vote_sql(bad: str, good: str) -> str:
    return f"case when {bad} then -1 when {good} then 1 else 0 end"


def _within(x: float, bounds: tuple[float, float]) -> float:
    return min(bounds[1], max(bounds[0], x))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """(prior, right on good texts, right on bad texts) from (votes, count) rows by
    expectation-maximisation."""
    k = len(patterns[0][0]) if patterns else len(RULES)
    prior, on_good, on_bad = START_PRIOR, [START_GOOD] * k, [START_BAD] * k
    for _ in range(rounds if patterns else 0):
        total = good = 0.0
        votes_good = [[1.0, 1.0] for _ in range(k)]  # votes bad, good; smoothed by one of each
        votes_bad = [[1.0, 1.0] for _ in range(k)]
        for votes, n in patterns:
            p = posterior(votes, prior, on_good, on_bad)
            total, good = total + n, good + n * p
            for j, v in enumerate(votes):
                if v:
                    votes_good[j][v > 0] += n * p
                    votes_bad[j][v > 0] += n * (1 - p)
        prior = _within(good / total, PRIOR_RANGE)
        on_good = [_within(x[1] / sum(x), GOOD_RANGE) for x in votes_good]
        on_bad = [_within(x[0] / sum(x), BAD_RANGE) for x in votes_bad]
    return prior, on_good, on_bad


def evidence(on_good: float, on_bad: float) -> tuple[float, float]:
    """What a vote for good, and one for bad, adds to the log odds."""
    return math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)


def posterior(votes, prior: float, on_good: list[float], on_bad: list[float]) -> float:
    s = math.log(prior / (1 - prior))
    for v, g, b in zip(votes, on_good, on_bad, strict=True):
        if v:
            s += evidence(g, b)[v < 0]
    return 1 / (1 + math.exp(-s))


def judge(docs: DataFrame, text_col: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """docs as it is, with the statistics and the columns of judge_statistics behind; one whose name docs has gets a free one (n_words_0)."""
    own = docs.select(F.struct(*docs.columns).alias("own"), F.col(text_col).alias("text"))
    found = judge_statistics(cut(text_statistics(own), "rules"), rules, threshold)
    results = [c for c in found.columns if c not in ("own", "text")]
    return found.select("own.*", *[F.col(r).alias(n) for r, n in zip(results, free(docs, *results), strict=True)])


def judge_statistics(stats: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Adds one vote_<rule> column a rule, quality (the posterior), base_failed, kept."""
    df = stats
    for name, bad, good in rules:
        df = df.withColumn(f"vote_{name}", F.expr(vote_sql(bad, good)))
    names = [f"vote_{name}" for name, *_ in rules]
    counts = df.groupBy(*names).count().collect()  # at most 3^rules rows
    prior, on_good, on_bad = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counts))
    score = F.lit(math.log(prior / (1 - prior)))
    for n, g, b in zip(names, on_good, on_bad, strict=True):
        for_good, for_bad = evidence(g, b)
        score = score + F.when(F.col(n) > 0, for_good).when(F.col(n) < 0, for_bad).otherwise(0.0)
    df = df.withColumn("quality", 1 / (1 + F.exp(-score))).withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = judge_statistics(cut(text_statistics(docs).drop("text"), "rules"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def _oracle() -> str:
    votes = ", ".join(f"{vote_sql(bad, good)} as v{j}" for j, (_, bad, good) in enumerate(RULES))
    k = range(len(RULES))
    odds = " + ".join(f"case v{j} when 1 then ln(g{j} / (1 - b{j})) when -1 then ln((1 - g{j}) / b{j}) else 0 end" for j in k)
    q = f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds})))"
    within = lambda x, r: f"least({r[1]}, greatest({r[0]}, {x}))"
    share = lambda j, v, w: f"(sum(case when v{j} = {v} then n * {w} else 0 end) + 1) / (sum(case when v{j} <> 0 then n * {w} else 0 end) + 2)"
    rates = ", ".join([within(share(j, 1, "q"), GOOD_RANGE) for j in k] + [within(share(j, -1, "(1 - q)"), BAD_RANGE) for j in k])
    return rf"""
with recursive d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id),
g as (select doc_id, i, count(*) over (partition by doc_id, s) as c
  from (select doc_id, i, array_to_string(w[i + 1:i + 5], ' ') as s from (select doc_id, w, unnest(range(len(w) - 4)) as i from d where len(w) >= 5))),
r as (select doc_id, count(distinct i + k) as n_repeat_words from g, unnest(range(5)) u(k) where c > 1 group by doc_id),
st as (
  select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_lines, 0)::bigint as n_lines,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(regexp_extract_all(t, '[#*$%&|<>]+'))::bigint as n_symbol_runs,
    (length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')))::bigint as n_upper, (length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')))::bigint as n_letters
  from d left join l using (doc_id) left join r using (doc_id)),
v as materialized (select *, {votes} from st),
p as materialized (select {", ".join(f"v{j}" for j in k)}, count(*)::double as n from v group by all),
em(i, prior, {", ".join([f"g{j}" for j in k] + [f"b{j}" for j in k])}) as (
  select 0, {START_PRIOR}::double, {", ".join([f"{START_GOOD}::double"] * len(RULES) + [f"{START_BAD}::double"] * len(RULES))}
  union all
  select i + 1, {within("sum(n * q) / sum(n)", PRIOR_RANGE)}, {rates}
  from (select *, {q} as q from p, em where i < {ROUNDS}) group by i)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b as base_failed, not b and quality >= 0.5 as kept, round(quality, 6) as quality
from (select v.*, n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} as b, {q} as quality from v, em where em.i = {ROUNDS})
"""


ORACLE = _oracle()
