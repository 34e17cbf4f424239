"""Checks against baselines, the metrics of alert rules, rules with their cooldown, and changes of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.columns import ratio
from feedloom.operators.monitoring import evaluate_rules
from feedloom.plans.registry import query
from feedloom.sources.posts import Tables

#: (least value, value of the baseline) of each check; a user gives their own.
LIMITS = {
    "product_P1": (50, 90), "product_P2": (50, 90), "product_P3": (50, 90), "product_P4": (50, 90), "product_P5": (50, 90),
    "linked_pct": (50, 85.7), "labelled": (400, 800), "products": (10, 10), "site_total": (20, 45), "total": (500, 900),
    "small_site_total": (15, 45), "match_pct": (20, 30), "rich_pct": (10, 20), "archive_pct": (5, 10),
}


def _checks_sql() -> str:
    live, site = "archived_at is null", "archived_at is null and platform = 'site3'"
    pct = lambda a, b, digits: f"coalesce(round(100.0::double * count(*) filter ({a}) / nullif(count(*) filter ({b}), 0), {digits}), 0)"
    match = f"{live} and regexp_matches(body, 'kw[1-3][0-9]', 'i')"
    what = {f"product_P{i}": f"count(*) filter (product = 'P{i}')" for i in range(1, 6)} | {
        "linked_pct": pct(f"{site} and product_id is not null", site, 2), "labelled": f"count(*) filter ({live} and len(categories) > 0)", "products": "max((select count(*) from products))",
        "site_total": f"count(*) filter ({site})", "total": f"count(*) filter ({live})", "small_site_total": f"count(*) filter ({live} and platform = 'site7')",
        "match_pct": pct(match, live, 1), "rich_pct": pct(f"{match} and length(body) >= 16", live, 1), "archive_pct": pct("archived_at is not null", "true", 1),
    }
    each = " union all ".join(f"select '{name}' as name, (select {x} from vv)::double as current, {LIMITS[name][0]}::double as threshold, {LIMITS[name][1]}::double as baseline" for name, x in what.items())
    return f"""select name, current, threshold, baseline, round(current - baseline, 2) as delta, current >= threshold as ok from (
  with vv as (select v.*, p.code as product, f.code as platform from posts v left join products p on p.id = v.product_id left join platforms f on f.id = v.platform_id) {each})"""


@query(_checks_sql())
def ops_regression_checks(t: Tables, products: tuple[str, ...] = ("P1", "P2", "P3", "P4", "P5"), site: str = "site3", small: str = "site7", pattern: str = "kw[1-3][0-9]", rich: int = 16, limits: dict[str, tuple[float, float]] = LIMITS) -> DataFrame:
    """Fourteen figures of one pass over the posts, each with its least value and its distance from a baseline: posts of key
    products, the linked share and size of a large site, categorised posts, products, all posts, a small site's posts, and the
    shares of posts on the subject, of long ones among these, and of archived ones. A share of nothing is 0."""
    p = t.products.select(F.col("id").alias("product_id"), F.col("code").alias("product"))
    f = t.platforms.select(F.col("id").alias("platform_id"), F.col("code").alias("platform"))
    v = t.posts.join(p, "product_id", "left").join(f, "platform_id", "left")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("double")

    def pct(a: Column, b: Column, digits: int) -> Column:
        return F.coalesce(F.round(ratio(n(a) * 100, n(b)), digits), F.lit(0.0))

    live = F.col("archived_at").isNull()
    at = lambda code: live & (F.col("platform") == code)
    match = live & F.col("body").rlike(f"(?i){pattern}")
    what = {f"product_{code}": n(F.col("product") == code) for code in products} | {
        "linked_pct": pct(at(site) & F.col("product_id").isNotNull(), at(site), 2), "labelled": n(live & (F.size("categories") > 0)),
        "site_total": n(at(site)), "total": n(live), "small_site_total": n(at(small)),
        "match_pct": pct(match, live, 1), "rich_pct": pct(match & (F.length("body") >= rich), live, 1), "archive_pct": pct(~live, F.lit(True), 1),
    }
    one = v.agg(*[c.alias(name) for name, c in what.items()]).crossJoin(t.products.agg(F.count("*").cast("double").alias("products")))
    rows = [F.struct(F.lit(name).alias("name"), F.col(name).alias("current"), F.lit(float(least)).alias("threshold"), F.lit(float(base)).alias("baseline"), F.round(F.col(name) - float(base), 2).alias("delta"), (F.col(name) >= float(least)).alias("ok")) for name, (least, base) in limits.items()]
    return one.select(F.inline(F.array(*rows)))


@query("""select metric, value from (with h as (select platform_id, avg(score) as s from posts where published_at >= timestamp '2024-01-31' - interval 7 day and published_at < timestamp '2024-01-31' group by 1
    having avg(score) is not null and max(published_at) >= timestamp '2024-01-31' - interval 72 hour),
  k as (select keyword, language from mentions where published_at >= timestamp '2024-01-31' - interval 14 day and published_at < timestamp '2024-01-31' group by 1, 2
    having count(*) filter (published_at >= timestamp '2024-01-31' - interval 7 day) >= 2 and count(*) filter (published_at < timestamp '2024-01-31' - interval 7 day) = 0)
  select 'community.extreme_negative_count' as metric, (count(*) filter (s <= 0.05))::double as value from h
  union all select 'community.negative_rate_max', coalesce(round(max(greatest(0.0::double, least(1.0::double, 0.3::double - s))) filter (s <= 0.05), 4), 0) from h
  union all select 'community.platforms_negative_pct', coalesce(round((count(*) filter (s < 0))::double / nullif(count(*), 0), 4), 0) from h
  union all select 'insights.new_term_spike_count', count(*)::double from k)""", extreme=0.05, floor=2, back=7)
def ops_alert_metrics(t: Tables, days: int = 7, extreme: float = -0.3, floor: int = 20, back: int = 30, dead_hours: int = 72) -> DataFrame:
    """metric, value of what alert rules read: platforms of very low mean score, the largest estimate of their negative share, the
    share of platforms below zero (dead ones don't count), and keywords of a language that are frequent now and were absent in the
    days before. The last is one aggregation with two conditional counts in place of an anti join."""
    ago = lambda d: t.as_of - F.expr(f"interval {d} days")
    at, s = F.col("published_at"), F.col("s")
    v = t.posts.filter((at >= ago(days + back)) & (at < t.as_of))
    h = v.filter(at >= ago(days)).groupBy("platform_id").agg(F.avg("score").alias("s"), F.max("published_at").alias("last"))
    h = h.filter(s.isNotNull() & (F.col("last") >= t.as_of - F.expr(f"interval {dead_hours} hours")))
    low = s <= extreme
    one = h.agg(
        F.count_if(low).cast("double").alias("n"),
        F.coalesce(F.round(F.max(F.when(low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.3) - s)))), 4), F.lit(0.0)).alias("worst"),
        F.coalesce(F.round(ratio(F.count_if(s < 0), F.count("*")), 4), F.lit(0.0)).alias("below"),
    )
    now = at >= ago(days)
    k = t.mentions(v).groupBy("keyword", "language").agg(F.count_if(now).alias("new"), F.count_if(~now).alias("old")).filter((F.col("new") >= floor) & (F.col("old") == 0))
    both = one.crossJoin(k.agg(F.count("*").cast("double").alias("terms")))
    names = {"community.extreme_negative_count": "n", "community.negative_rate_max": "worst", "community.platforms_negative_pct": "below", "insights.new_term_spike_count": "terms"}
    return both.select(F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(c).alias("value")) for name, c in names.items()])))


def fire_rules(metrics: DataFrame, rules: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """The rules that hold on the metrics, with whether they fire: a rule does if the log (id, fired_at) has no event of it
    in its own cooldown_sec before now. quiet_seconds is null for a rule that never fired."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    last = log.filter(F.col("fired_at") <= now).groupBy("id").agg(F.max("fired_at").alias("last"))
    hit = evaluate_rules(metrics, rules).join(rules.select("id", "cooldown_sec"), "id").join(last, "id", "left")
    quiet = seconds(now) - seconds(F.col("last"))
    return hit.select("id", "metric", "value", F.floor(quiet).cast("long").alias("quiet_seconds"), (F.col("last").isNull() | (quiet >= F.col("cooldown_sec"))).alias("fires"))


@query("""select r.id, 'negative:' || r.id as metric, m.n::double as value, floor(epoch(timestamp '2024-01-31') - epoch(l.last))::bigint as quiet_seconds, l.last is null or epoch(timestamp '2024-01-31') - epoch(l.last) >= r.id * 3600 as fires from platforms r
  join (select platform_id, count(*) as n from posts where label = 'negative' and published_at::date > date '2024-01-30' - 7 and published_at::date <= date '2024-01-30' group by 1) m on m.platform_id = r.id
  left join (select platform_id, max(published_at) as last from posts where label = 'negative' and likes > 60 and published_at <= timestamp '2024-01-31' group by 1) l on l.platform_id = r.id
  where r.is_active and case when r.id % 2 = 0 then m.n > 1 + r.id % 3 else m.n >= 1 + r.id % 3 end""")
def ops_alert_firing(t: Tables, days: int = 7, loud: int = 60) -> DataFrame:
    """A rule a platform on its negative posts of the week, held back for hours after a loud negative post."""
    bad = t.posts.filter("label = 'negative'")
    named = lambda c: F.concat(F.lit("negative:"), c.cast("string")).alias("metric")
    metrics = t.window(bad, days).groupBy("platform_id").agg(F.count("*").cast("double").alias("value")).select(named(F.col("platform_id")), "value")
    i = F.col("id")
    rules = t.platforms.select("id", named(i), F.when(i % 2 == 0, ">").otherwise(">=").alias("op"), (i % 3 + 1).cast("double").alias("threshold"), (i * 3600).alias("cooldown_sec"), "is_active")
    return fire_rules(metrics, rules, bad.filter(F.col("likes") > loud).select(F.col("platform_id").alias("id"), F.col("published_at").alias("fired_at")), t.as_of)


#: Fields of a rule that a patch may set; another name, metric or operator makes another rule.
CHANGEABLE = ("is_active", "threshold", "severity", "cooldown_sec", "description")


def patch_rules(rules: DataFrame, patches: DataFrame) -> DataFrame:
    """Rules after patches by id, at most one an id: a null field leaves the rule's own; a patch of no rule does nothing."""
    fields = [c for c in patches.columns if c != "id"]
    if not fields or set(fields) - set(CHANGEABLE):
        raise ValueError(f"a patch sets some of {CHANGEABLE}")
    p = patches.select("id", *[F.col(c).alias(f"__{c}") for c in fields])
    return rules.join(p, "id", "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in rules.columns])


def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules and those of the new ones (such as a preset) whose name none has; of new ones of one name, that of least id."""
    firsts = new.groupBy("name").agg(F.min("id").alias("id"))
    return rules.unionByName(new.join(firsts, ["name", "id"], "left_semi").join(rules.select("name"), "name", "left_anti"))


@query("""select id, 'negative ' || code as name, case when id % 4 = 0 then 9.0::double else (1 + id % 3)::double end as threshold, is_active and id % 5 <> 0 as is_active from platforms
  union all select 1000 + id, code, 5.0::double, true from products""")
def ops_rule_changes(t: Tables) -> DataFrame:
    """Rules after a patch of some thresholds and switches, and a preset of which the names in use are refused."""
    i = F.col("id")
    rules = t.platforms.select("id", F.concat(F.lit("negative "), "code").alias("name"), (i % 3 + 1).cast("double").alias("threshold"), "is_active")
    patches = t.platforms.select("id", F.when(i % 4 == 0, 9.0).alias("threshold"), F.when(i % 5 == 0, False).alias("is_active"))
    preset = t.products.select((i + 1000).alias("id"), F.col("code").alias("name")).union(t.platforms.select((i + 2000).alias("id"), F.concat(F.lit("negative "), "code")))
    return add_rules(patch_rules(rules, patches), preset.select("id", "name", F.lit(5.0).alias("threshold"), F.lit(True).alias("is_active")))
