"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / weight, where u comes from a keyed hash of doc_id and
weight is a quality weight of its text. Within a source, documents are taken in key
order until the source's word budget is used up. A budget above the source's size
takes complete epochs first; only the rest is selected by key.

The prefix sums never gather a source in one task: keys are cut into buckets, the
bucket totals are summed first (sources x buckets rows), and the running sum inside
a bucket starts at its bucket's offset. The number of buckets changes only how the work
is dealt out, never the result.

Defined cases: a null or blank text has size 0 and takes 0 words; a null source is a
source of its own, last in the order; documents with equal keys (repeated doc_id) are
ordered by size; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents, partitions

#: Fixed values of the contract: weights repeat over the sorted sources; the mix holds
#: 150 % of all words; no source is read more than twice.
CYCLE = (3, 1, 2)
MIX_SHARE = 1.5
MAX_EPOCHS = 2
#: Characters that speak against a text's quality.
NOISE = "#*$%&|<>{}[]\\^~="
SEED = "feedloom-mix-1"


def quality_weight(text: Column) -> Column:
    """Between 0.25 and 1: falls with the share of noise characters, 1 for clean text."""
    text = F.coalesce(text, F.lit(""))
    noise = (F.length(text) - F.length(F.translate(text, NOISE, ""))) / F.greatest(F.length(text), F.lit(1))
    return F.lit(0.25) + F.lit(0.75) * (F.lit(1.0) - F.least(F.lit(1.0), noise * 10))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on doc_id and the seed alone."""
    hexed = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}"))), 1, 12)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, share: float = MIX_SHARE, cycle=CYCLE, limit: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size (one row a source). Adds target.

    Words go to sources by weight; a source stops at limit x its size, and what it
    leaves is shared by weight among the others. With the sources ordered by
    cap / weight, the stopped ones come first, so one pass of running sums finds
    the level at which the others share the rest."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    i = (F.row_number().over(by_name) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (i + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(limit))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(everything) * share)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # the first source whose cap isn't below the level ends the stopped ones
    t = t.withColumn("open", F.col("cap") / F.col("w") >= F.col("level"))
    t = t.withColumn("first_level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything))
    target = F.when(F.col("first_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("first_level.level")))
    return t.select("source", "source_size", target.alias("target"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int | None = None) -> DataFrame:
    """doc_id, source, size, key, bucket. Buckets follow the key's order."""
    n = buckets or max(64, 4 * partitions(docs.sparkSession))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), (-F.log(uniform(F.col(id_col))) / quality_weight(F.col(text_col))).alias("key"))
    return out.withColumn("bucket", F.least(F.lit(n - 1), F.floor((1 - F.exp(-F.col("key"))) * n)).cast("int"))


def mix(docs: DataFrame, share: float = MIX_SHARE, cycle=CYCLE, limit: int = MAX_EPOCHS, **cols) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, epochs, taken."""
    rows = cut(keyed(docs, **cols), "mix")
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = totals.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(per_source, share, cycle, limit).select(F.col("source").alias("s2"), "source_size", "target")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    offsets = offsets.join(targets, F.col("source").eqNullSafe(F.col("s2"))).select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("inner")))
    rows = rows.withColumn("epochs", epochs).withColumn("rest", rest).withColumn("part", part.cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as rows of the input's columns: a document once for each epoch, and once
    more, cut to its first words if it straddles the end of the budget. Rows with a
    repeated doc_id are told apart by a row number that is written beside them."""
    names = docs.columns
    # the input's columns travel in a struct, so none can clash with those of the mix
    marked = cut(docs.select(F.struct(*names).alias("d"), F.monotonically_increasing_id().alias("r")), "mix-rows")
    plain = marked.select(F.col("r").alias("doc_id"), F.col("d").getField("text").alias("text"), F.col("d").getField("source").alias("source"))
    taken = mix(plain, **params).filter("epochs > 0 or part > 0").select(F.col("doc_id").alias("r"), "size", F.col("epochs").cast("int").alias("epochs"), "part")
    copies = F.concat(F.array_repeat("size", F.col("epochs")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")))
    rows = marked.join(taken, "r").withColumn("take", F.explode(copies))
    text = F.col("d").getField("text")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.when(F.col("take") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("take").cast("int")), "")).otherwise(text)
    return rows.select(*[(head if n == "text" else F.col("d").getField(n)).alias(n) for n in names])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|feedloom-mix-1'), 1, 12))::bigint::double + 0.5) / 281474976710656.0)
    / (0.25 + 0.75 * (1.0 - least(1.0, 10 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>{}[]\^~=', '')))::double / greatest(length(coalesce(text, '')), 1)))) as key
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w
  from d group by source),
l as (
  select *, 2.0::double * source_size as cap,
    (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by 2.0::double * source_size / w, source nulls last rows between current row and unbounded following) as level
  from s),
f as (select arg_min(level, cap / w) as level from l where cap / w >= level),
t as (select source, source_size, coalesce(least(cap, w * f.level), cap) as target from l, f),
p as (
  select d.*, t.source_size, t.target, case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as epochs,
    coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::bigint - before)))::bigint as taken
from p
"""
