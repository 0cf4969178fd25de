"""Mixing sources to target weights by Poisson replication.

A document of a source is repeated on average ``rate`` times, the source's target
share over its present share. Its count is the inverse of the Poisson distribution
at a number drawn from a hash of seed and id; a rate above 16 is the sum of equal
parts of at most 16, each drawn by itself. Copies are then dealt to partitions and
ordered there by a hash: a global shuffle. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import partitions
from strophe.session import stage

PART = 16.0  # largest mean of one draw
STEPS = 96  # counts up to which a draw of mean 16 is inverted; beyond lies less than 2**-53
MAX_BROADCAST = 50_000  # sources in a broadcast table of rates (under 50 MB); more are joined by a shuffle

_CDF = f"""aggregate(sequence(1, {STEPS}),
  struct(array(exp(-mean)) as c, exp(-mean) as p, exp(-mean) as s),
  (a, k) -> struct(concat(a.c, array(a.s + a.p * mean / k)) as c, a.p * mean / k as p, a.s + a.p * mean / k as s)).c"""


def uniform(*parts: Column | str) -> Column:
    """Number in [0, 1) from the MD5 of the parts joined by '|'."""
    hexed = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str, power: float, weights: dict[str, float] | None, size: float) -> DataFrame:
    """Per source (null is one too): rate, parts, mean of a part, and the part's cumulative probabilities.

    Target weights are ``weights``, or else the present row shares to ``power``;
    sources that ``weights`` leaves out get rate 0. The mixture has ``size`` times
    the rows in expectation.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    share = F.pow(F.col("n").cast("double"), F.lit(power))
    if weights is not None:
        share = F.lit(0.0)
        for name, weight in sorted(weights.items()):
            share = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(share)
    counts = stage(counts.withColumn("share", share))
    total = counts.agg(F.sum("n").alias("n"), F.sum("share").alias("share")).first()
    rate = F.lit(float(total.n or 0) * size) * F.col("share") / F.lit(float(total.share or 1)) / F.col("n")
    out = counts.select("source", rate.alias("rate"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    return out.withColumn("mean", F.col("rate") / F.col("parts")).withColumn("cdf", F.expr(_CDF))


def mix(
    docs: DataFrame,
    source: str = "source",
    doc_id: str = "doc_id",
    power: float = 0.5,
    weights: dict[str, float] | None = None,
    size: float = 1.0,
    seed: int = 11,
) -> DataFrame:
    """The rows of ``docs`` repeated to the target weights and shuffled, with copy (from 1), copies and order_key.

    Rows with equal ids and texts get equal counts; a null id draws by its other
    values. A null source is a source. Input columns named copy, copies or
    order_key are replaced. An empty table gives no rows.
    """
    rate = stage(rates(docs, source, power, weights, size))
    small = rate.count() <= MAX_BROADCAST
    own = ["copy", "copies", "order_key"]
    kept = [c for c in docs.columns if c not in own]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    base = docs.select(row.alias("row"), F.col(source).alias("from"), F.col(doc_id).cast("string").alias("id"))
    spare = F.concat(F.lit("row "), F.xxhash64("row").cast("string"))
    base = base.withColumn("id", F.coalesce("id", spare))
    base = base.join(F.broadcast(rate) if small else rate, F.col("from").eqNullSafe(F.col("source")))

    def draw(i: Column) -> Column:
        u = uniform(F.lit(str(seed)), F.col("id"), i.cast("string"))
        return F.size(F.filter("cdf", lambda c: c <= u))

    copies = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), draw), F.lit(0), lambda a, k: a + k)
    base = base.select("row", "id", copies.alias("copies")).where("copies > 0")
    base = base.select("row", "id", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    base = base.withColumn("order_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), "id", F.col("copy").cast("string"))))
    tasks = partitions(docs.sparkSession)
    place = F.floor(F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long") * tasks / F.lit(1 << 32)).cast("int")
    shuffled = base.repartitionById(tasks, place).sortWithinPartitions("order_key", "id")
    return shuffled.select("row.*", "copy", "copies", "order_key")


MIX_SQL = """
with recursive counts as (
  select source, count(*) as n, pow(count(*)::double, 0.5) as share from documents group by source),
total as (select sum(n)::double as n, sum(share) as share from counts),
rate as (
  select source, t.n * 1.0 * c.share / t.share / c.n as rate,
    greatest(1, ceil(t.n * 1.0 * c.share / t.share / c.n / 16.0))::int as parts
  from counts c, total t),
cdf as (
  select source, rate / parts as mean, 0 as k, exp(-(rate / parts)) as p, exp(-(rate / parts)) as s from rate
  union all
  select source, mean, k + 1, p * mean / (k + 1), s + p * mean / (k + 1) from cdf where k < 96),
draws as (
  select d.doc_id, d.source,
    ('0x' || substr(md5('11|' || d.doc_id::varchar || '|' || i::varchar), 1, 13))::bigint / 4503599627370496.0 as u
  from documents d join rate r on d.source is not distinct from r.source, unnest(range(1, r.parts + 1)) as x(i)),
counted as (
  select w.doc_id, count(*) as copies from draws w join cdf c
    on w.source is not distinct from c.source and c.s <= w.u group by w.doc_id)
select d.*, i::int as copy, c.copies::int as copies,
  md5('order 11|' || d.doc_id::varchar || '|' || i::varchar) as order_key
from documents d join counted c on d.doc_id = c.doc_id, unnest(range(1, c.copies + 1)) as x(i)
"""
