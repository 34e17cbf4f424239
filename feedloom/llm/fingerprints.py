"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band (neither so common
that every text has them, nor so rare that one edit removes them). Each subset of the
lexicon is drawn by a hash of the term; a document's signature for a subset is a hash of
its sorted distinct terms in it. Subsets of two rates serve short and long texts. Likeness is
the share of subsets, among those where either text has a term, with the same signature.

The lexicon is bounded: its frequencies add up to at most the number of documents times the
mean number of distinct terms, so at most (mean distinct terms / LOW) terms pass, whatever
the input's size. It is put into the expression as a set; no join follows, and all work is
built-in expressions.

Defined cases: a null text counts as empty; a text without lexicon terms is fingerprinted by
its whole text; equal texts have equal fingerprints; the next document of the last is the
first, so a table of one row is its own neighbour; equal doc_ids are ordered by text; null
doc_ids come last; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents

LOW, HIGH = 0.02, 0.3
#: Subsets and their rates: (how many, one term in).
SUBSETS = ((16, 64), (16, 512))
#: Characters that end a term, besides white space.
MARKS = ".,;:!?()\"|#*$%&'\\"
#: Documents whose neighbours are found together.
WIDTH = 64
SUPER = 256


def terms(text: Column) -> Column:
    """Distinct terms of a text, sorted."""
    plain = F.translate(F.lower(text), MARKS, " " * len(MARKS))
    return F.array_sort(F.array_distinct(F.filter(F.split(plain, SPACE), lambda w: w != "")))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> list[str]:
    """The terms of the band; see above for the bound."""
    n = docs.count()
    found = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("t")).groupBy("t").count()
    return sorted(r["t"] for r in found.filter((F.col("count") >= low * n) & (F.col("count") <= high * n)).select("t").collect())


def signatures(text: Column, band: list[str]) -> Column:
    """An array with one signature a subset, '' where the text has no term of it."""
    (n1, r1), (n2, r2) = SUBSETS
    h = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long")
    own = F.filter(terms(text), lambda t: t.isin(band) if band else F.lit(False))
    hashed = F.filter(
        F.transform(own, lambda t: F.struct(t.alias("t"), (h(t) % r1).alias("a"), (F.floor(h(t) / r1) % r2).alias("b"))),
        lambda x: (x["a"] < n1) | (x["b"] < n2),
    )
    sign = lambda xs, part, j: F.array_join(F.transform(F.filter(xs, lambda x: x[part] == j), lambda x: x["t"]), " ")
    every = lambda xs: F.array(*[sign(xs, "a", j) for j in range(n1)], *[sign(xs, "b", j) for j in range(n2)])
    out = F.element_at(F.transform(F.array(hashed), every), 1)
    return F.transform(out, lambda s: F.when(s == "", "").otherwise(F.substring(F.md5(s), 1, 8)))


def with_next(docs: DataFrame, cols: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) with next_<col> of the next document by descending doc_id."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    bucket = F.coalesce(F.floor(F.col("doc_id") / WIDTH), F.lit(-(1 << 62)))
    docs = docs.withColumn("__b", bucket)
    # the bucket after each bucket, found in two steps so that no task gets all buckets of a large table
    heads = docs.select("__b").distinct().withColumn("__s", F.floor(F.col("__b") / SUPER))
    supers = heads.groupBy("__s").agg(F.max("__b").alias("first"))
    following = supers.withColumn("after", F.lead("first").over(Window.orderBy(F.col("__s").desc())))
    following = following.withColumn("after", F.coalesce("after", F.max("first").over(Window.partitionBy(F.lit(1)))))
    heads = heads.withColumn("__to", F.lead("__b").over(Window.partitionBy("__s").orderBy(F.col("__b").desc())))
    heads = heads.join(following.select("__s", "after"), "__s").select("__b", F.coalesce("__to", "after").alias("__to"))
    # the first document of each bucket
    top = docs.groupBy("__b").agg(F.max("doc_id").alias("__top"))
    firsts = docs.join(top.withColumnRenamed("__b", "__b2"), (F.col("__b") == F.col("__b2")) & F.col("doc_id").eqNullSafe(F.col("__top")))
    firsts = firsts.groupBy("__b").agg(F.max(F.struct("text", *[c for c in cols if c != "text"])).alias("__edge"))
    edges = heads.join(firsts.withColumnRenamed("__b", "__to"), "__to").select(F.col("__b").alias("__b3"), "__edge")
    w = Window.partitionBy("__b").orderBy(*order)
    rows = docs.join(edges, F.col("__b") == F.col("__b3"))
    for c in cols:
        rows = rows.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(w), F.col(f"__edge.{c}")))
    return rows.drop("__b", "__b3", "__edge")


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Of two signature arrays; same: whether the texts are equal, for texts without terms."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.when((x != "") | (y != ""), 1)), lambda x: x.isNotNull()))
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.when((x != "") & (x == y), 1)), lambda x: x.isNotNull()))
    return F.when(either > 0, both / either).otherwise(F.when(same, 1.0).otherwise(0.0))


def fingerprint(sig: Column, text: Column) -> Column:
    return F.when(F.array_join(sig, "") == "", F.concat(F.lit("whole:"), F.md5(text))).otherwise(F.array_join(sig, "."))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    band = lexicon(docs)
    docs = docs.withColumn("sig", signatures(F.col("text"), band))
    rows = with_next(docs, ["text", "sig"])
    n = F.length("text")
    cut_at = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut_at), F.substring(F.col("next_text"), F.lit(1), cut_at)))
    rows = rows.withColumn("edited_sig", signatures(F.col("edited"), band))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sig"), F.col("text")).alias("fingerprint"), fingerprint(F.col("edited_sig"), F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig"), F.col("text") == F.col("edited")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig"), F.col("text") == F.col("next_text")).alias("near_next"),
    )


def _oracle() -> str:
    (n1, r1), (n2, r2) = SUBSETS
    marks = MARKS.replace("'", "''")
    terms_sql = lambda t: f"list_sort(list_distinct(regexp_extract_all(translate(lower({t}), '{marks}', '{' ' * len(MARKS)}'), '[^\\x20\\x09-\\x0D]+')))"
    sig = lambda x: f"list_transform([{', '.join([f'list_filter({x}, lambda y: y.a = {j})' for j in range(n1)] + [f'list_filter({x}, lambda y: y.b = {j})' for j in range(n2)])}], lambda l: case when len(l) = 0 then '' else substr(md5(array_to_string(list_transform(l, lambda y: y.t), ' ')), 1, 8) end)"
    fp = lambda s, t: f"case when array_to_string({s}, '') = '' then 'whole:' || md5({t}) else array_to_string({s}, '.') end"
    like = lambda a, b, x, y: f"case when len(list_filter(list_zip({a}, {b}), lambda z: z[1] <> '' or z[2] <> '')) > 0 then len(list_filter(list_zip({a}, {b}), lambda z: z[1] <> '' and z[1] = z[2]))::double / len(list_filter(list_zip({a}, {b}), lambda z: z[1] <> '' or z[2] <> '')) when {x} = {y} then 1.0 else 0.0 end"
    return f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc nulls last, text desc) as i from documents),
e as (select d.*, coalesce(x.text, f.text) as next_text, coalesce(x.i, 1) as ni from d left join d x on x.i = d.i + 1 join d f on f.i = 1),
g as (select *, text[:length(text) - length(text) // 3] || next_text[:length(text) // 3] as edited from e),
t as (select i, 0 as v, unnest({terms_sql('text')}) as t from g union all select i, 1, unnest({terms_sql('edited')}) from g),
lx as (select t, ('0x' || substr(md5(t), 1, 8))::bigint as h from t where v = 0 group by t
  having count(*) >= {LOW} * (select count(*) from d) and count(*) <= {HIGH} * (select count(*) from d)),
b as (select i, v, list({{'t': t, 'a': h % {r1}, 'b': (h // {r1}) % {r2}}} order by t) as x from t join lx using (t) group by i, v),
s as (select g.*, coalesce(b0.x, []) as x0, coalesce(b1.x, []) as x1 from g left join b b0 on b0.i = g.i and b0.v = 0 left join b b1 on b1.i = g.i and b1.v = 1),
k as (select *, {sig('x0')} as s0, {sig('x1')} as s1 from s)
select k.doc_id, length(k.text)::bigint as n_chars, sha256(k.edited) as edited_sha256, {fp('k.s0', 'k.text')} as fingerprint, {fp('k.s1', 'k.edited')} as edited_fingerprint,
  {like('k.s0', 'k.s1', 'k.text', 'k.edited')} as near_edited, {like('k.s0', 'n.s0', 'k.text', 'k.next_text')} as near_next
from k join k n on n.i = k.ni
"""


ORACLE = _oracle()
