"""Figures that texts claim, held against measured ones: claims by line, their drift, and how far the texts of a source can be trusted.

Claims come from patterns by metric, each line by itself, in one pass over the texts; they meet the measured figures in an equi-join. Statistics
of drift are mergeable aggregates; percentiles are taken of counts by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.plans.registry import query
from feedloom.sources.posts import Tables

#: Metric, pattern with one group for the number, and whether the metric is a whole number.
PATTERNS = (("chars", r"(?i)\bchars:\s*([\d,_]+)", True), ("lines", r"(?i)\blines:\s*([\d,_]+)", True), ("share", r"(\d+(?:\.\d+)?)\s*%", False))
THRESHOLD = 0.05
# Bins of drift in percent, and where trust is a warning and critical.
BINS = (("0-5", 0, 5), ("5-10", 5, 10), ("10-20", 10, 20), ("20-50", 20, 50), ("50+", 50, 1e9))
WARNING_BELOW, CRITICAL_BELOW = 80.0, 60.0


def claims_of(reports: DataFrame, patterns=PATTERNS) -> DataFrame:
    """A row a claim of reports (report, text, and what else they have): metric, reported, line. A metric that a text states twice has two claims."""
    found = lambda name, p, whole, line: F.transform(F.regexp_extract_all(line, F.lit(p), F.lit(1)), lambda x: F.struct(F.lit(name).alias("metric"), _number(x, whole).alias("reported")))
    lines = reports.select(*[c for c in reports.columns if c != "text"], F.posexplode(F.split("text", "\n")).alias("at", "of_line"))
    rows = lines.withColumn("x", F.explode(F.flatten(F.array(*[found(*p, F.col("of_line")) for p in patterns])))).filter("x.reported is not null")
    return rows.select("*", "x.*", (F.col("at") + 1).alias("line")).drop("x", "at", "of_line")


def _number(raw: Column, whole: bool) -> Column:
    v = F.regexp_replace(raw, "[,_%]", "").try_cast("double")
    return F.bround(v, 0) if whole else v


def relative(reported: Column, actual: Column) -> Column:
    """(actual - reported) / max(|reported|, |actual|): signed, symmetric, 0 for two zeros."""
    return (actual - reported) / F.greatest(F.abs(reported), F.abs(actual), F.lit(1e-9))


def checked(claims: DataFrame, live: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Claims with the measured figure of live (report, metric, actual, approximate), drift, whether it is an alert, and a note. A metric that nothing
    measures stays, without drift; an approximate one gives no alert."""
    rows = claims.join(live, ["report", "metric"], "left")
    share = F.round(relative(F.col("reported"), F.col("actual")), 4)
    rows = rows.withColumn("drift", F.col("actual") - F.col("reported")).withColumn("drift_pct", share)
    note = F.when(F.col("actual").isNull(), "no live measurement").when(F.col("approximate"), "approximate source").otherwise("")
    return rows.withColumn("alert", F.coalesce((F.abs("drift_pct") > threshold) & ~F.col("approximate"), F.lit(False))).withColumn("note", note)


def document_reports(t: Tables) -> DataFrame:
    """Documents with two lines of figures at their end, some of them wrong."""
    said = F.concat(F.col("text"), F.lit("\nChars: "), F.format_number(F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 41 * 7).otherwise(0), 0), F.lit("\nlines: "), (F.col("doc_id") % 7).cast("string"))
    return t.table("documents").select(F.col("doc_id").alias("report"), F.col("source").alias("track"), F.col("lang").alias("round"), said.alias("text"))


def document_figures(t: Tables) -> DataFrame:
    d = t.table("documents").select(F.col("doc_id").alias("report"), F.length("text").alias("chars"), F.size(F.split("text", "\n")).alias("n"))
    one = lambda name, c, approximate: F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("actual"), F.lit(approximate).alias("approximate"))
    return d.select("report", F.explode(F.array(one("chars", "chars", False), one("lines", "n", True))).alias("x")).select("report", "x.*")


_CLAIMS = r"""(select report, track, round, line, metric, reported, actual, approximate, actual - reported as drift, (actual - reported) / greatest(abs(reported), abs(actual), 1e-9) as rel from (
  select doc_id as report, source as track, lang as round, idx as line, m.metric, replace(replace(raw, ',', ''), '_', '')::double as reported, chars, n
  from (select doc_id, source, lang, chars, n, unnest(ls) as l, unnest(range(1, len(ls) + 1)) as idx from (select *, length(text) as chars, len(string_split(text, chr(10))) as n,
    string_split(text || chr(10) || 'Chars: ' || format('{:,}', n_chars + case when doc_id % 3 = 0 then doc_id % 41 * 7 else 0 end) || chr(10) || 'lines: ' || (doc_id % 7)::varchar, chr(10)) as ls from documents)),
  lateral (select 'chars' as metric, unnest(regexp_extract_all(l, '(?i)\bchars:\s*([\d,_]+)', 1)) as raw union all select 'lines', unnest(regexp_extract_all(l, '(?i)\blines:\s*([\d,_]+)', 1)) union all select 'share', unnest(regexp_extract_all(l, '(\d+(?:\.\d+)?)\s*%', 1))) m) c
  left join lateral (select case c.metric when 'chars' then c.chars::double when 'lines' then c.n::double end as actual, c.metric = 'lines' as approximate) on true)"""


@query(f"""select report, metric, reported, line::int as line, actual, drift, round(rel, 4) as drift_pct, coalesce(abs(round(rel, 4)) > 0.05 and not approximate, false) as alert,
  case when actual is null then 'no live measurement' when approximate then 'approximate source' else '' end as note from {_CLAIMS}""")
def ops_claim_check(t: Tables) -> DataFrame:
    rows = checked(claims_of(document_reports(t)), document_figures(t))
    return rows.select("report", "metric", "reported", F.col("line").cast("int").alias("line"), "actual", "drift", "drift_pct", "alert", "note")


def trust(mean_abs: Column, std_abs: Column) -> Column:
    """100 for no drift at all, less with its mean and half its spread."""
    m = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean_abs))
    s = F.greatest(F.lit(0.0), F.least(F.lit(0.5), std_abs / 2))
    return F.round(100 * (1 - m) * (1 - s), 1)


def trust_level(x: Column, warning: float = WARNING_BELOW, critical: float = CRITICAL_BELOW) -> Column:
    return F.when(x < critical, "critical").when(x < warning, "warning").otherwise("normal")


def drift_statistics(samples: DataFrame, *keys: str) -> DataFrame:
    """n, mean, spread, signed mean and greatest of the drift (column drift, as a share) by keys, its bins, trust, level and systematic bias: claims below
    what is measured are under_report."""
    d, size = F.col("drift"), F.abs("drift")
    bins = [F.count_if((size * 100 >= lo) & (size * 100 < hi)).alias(f"bin_{name}") for name, lo, hi in BINS]
    g = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(size).alias("m"), F.stddev_pop(size).alias("s"), F.avg(d).alias("b"), F.max(size).alias("x"), *bins)
    score = trust(F.col("m"), F.col("s"))
    bias = F.when((F.col("m") >= 1e-6) & (F.abs("b") >= 0.5 * F.col("m")), F.when(F.col("b") > 0, "under_report").otherwise("over_report"))
    pct = lambda c: F.round(100 * F.col(c), 2)
    return g.select(*keys, "n", pct("m").alias("mean_abs_pct"), pct("s").alias("std_abs_pct"), pct("b").alias("signed_mean_pct"), pct("x").alias("max_abs_pct"), *[f"bin_{n}" for n, *_ in BINS], score.alias("trust"), trust_level(score).alias("level"), bias.alias("bias"))


_BIN_SQL = ", ".join(f"count(*) filter (abs(rel) * 100 >= {lo} and abs(rel) * 100 < {hi:.0f})::bigint as \"bin_{name}\"" for name, lo, hi in BINS)
_STATS = f"""(select *, case when trust < 60 then 'critical' when trust < 80 then 'warning' else 'normal' end as level from (select round, track, n, round(100 * m, 2) as mean_abs_pct, round(100 * s, 2) as std_abs_pct, round(100 * b, 2) as signed_mean_pct, round(100 * x, 2) as max_abs_pct, {", ".join(f'"bin_{n}"' for n, *_ in BINS)},
  round(100 * (1 - greatest(0, least(1, m))) * (1 - greatest(0, least(0.5, s / 2))), 1) as trust, case when m >= 1e-6 and abs(b) >= 0.5 * m then case when b > 0 then 'under_report' else 'over_report' end end as bias
  from (select round, track, count(*)::bigint as n, avg(abs(rel)) as m, stddev_pop(abs(rel)) as s, avg(rel) as b, max(abs(rel)) as x, {_BIN_SQL} from {_CLAIMS} where actual is not null group by 1, 2)))"""


def _samples(t: Tables) -> DataFrame:
    rows = claims_of(document_reports(t)).join(document_figures(t), ["report", "metric"])
    return rows.withColumn("drift", relative(F.col("reported"), F.col("actual")))


@query(f"select * from {_STATS}")
def ops_drift_statistics(t: Tables) -> DataFrame:
    return drift_statistics(_samples(t), "round", "track")


def advised_thresholds(trusts: DataFrame, warning: float = WARNING_BELOW, critical: float = CRITICAL_BELOW, least: int = 3) -> DataFrame:
    """From many trust scores (column trust): their quartiles, and thresholds that would suit them better than the present ones. Scores have one decimal, so counts by
    value are few rows."""
    counts = trusts.groupBy("trust").agg(F.count("*").alias("n"))
    q = lambda p: F.expr(f"percentile(trust, {p}, n)")
    g = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("samples"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"))
    crit = F.greatest(F.lit(0.0), F.least(F.lit(95.0), F.round(F.col("p25") - 5, 1)))
    g = g.withColumn("critical_below", crit).withColumn("warning_below", F.greatest(F.col("critical_below") + 5, F.least(F.lit(100.0), F.round(F.col("p50") + 5, 1))))
    a, b = F.col("critical_below") - critical, F.col("warning_below") - warning
    action = F.when(F.col("samples") < least, "insufficient_samples").when((F.abs(a) <= 5) & (F.abs(b) <= 5), "keep_current").when((a < -5) | (b < -5), "loosen").otherwise("tighten")
    few = lambda c: F.when(F.col("samples") >= least, F.col(c)).alias(c)
    return g.select("samples", *[F.round(c, 1).alias(c) for c in ("p25", "p50", "p75")], few("critical_below"), few("warning_below"), action.alias("action"))


@query(f"""select samples, round(p25, 1) as p25, round(p50, 1) as p50, round(p75, 1) as p75, critical_below, warning_below, case when abs(critical_below - 60) <= 5 and abs(warning_below - 80) <= 5 then 'keep_current' when critical_below - 60 < -5 or warning_below - 80 < -5 then 'loosen' else 'tighten' end as action
  from (select *, greatest(critical_below + 5, least(100.0::double, round(p50 + 5, 1))) as warning_below from (select *, greatest(0.0::double, least(95.0::double, round(p25 - 5, 1))) as critical_below from (
    select count(*)::bigint as samples, quantile_cont(trust, 0.25) as p25, quantile_cont(trust, 0.5) as p50, quantile_cont(trust, 0.75) as p75 from {_STATS})))""")
def ops_trust_thresholds(t: Tables) -> DataFrame:
    return advised_thresholds(drift_statistics(_samples(t), "round", "track"))
