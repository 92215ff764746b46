"""Mixing sources to target weights by Pareto order sampling.

The mixture has ``total`` documents (as many as the table, unless given).  A source's share of it grows with the
square root of its characters, so large sources are thinned and small ones repeated; shares are rounded by largest
remainders, so that they add up to ``total``.  Within its source a document is expected in proportion to an integer
size measure, BASE + min(characters, CLIP).  The whole part of the expected copies is allocated for certain; the
fraction p competes: documents of a source are ranked by the odds of a random number over the odds of p, and the
lowest are taken, so many that the source has exactly its target.

The random number comes from an MD5 of seed and doc_id, so any engine and any rerun draw alike.  No source is ever
gathered in one task: the rank's cut is found by counting ranks in BUCKETS buckets for each source and sorting the
one bucket in which the cut falls; the remainders' cut is found likewise among all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, sized

BASE, CLIP, BUCKETS, SEED = 512, 8192, 1 << 16, "mix-5"


def measure(n_chars: Column) -> Column:
    return F.lit(BASE) + F.least(F.greatest(F.coalesce(n_chars.cast("bigint"), F.lit(0)), F.lit(0)), F.lit(CLIP))


def rank(doc_id: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null where p is 0."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint")
    u = (h.cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))


def targets(sums: DataFrame, total: int | None = None) -> DataFrame:
    """(source, zs, target) of ``sums`` (source, n, zs, share), a stored table: the floors of the shares of ``total``, one more for the largest remainders."""
    # One row over all sources; the number of sources is not bounded, so sources join by their size.
    whole = sums.agg(F.sum("n").alias("all_rows"), F.sum("share").alias("shares"))
    rows = "all_rows" if total is None else str(int(total))
    floors = Shared(sums.crossJoin(F.broadcast(whole)).select("source", "zs", F.expr(f"{rows} * share div shares").alias("floor"), F.expr(f"({rows} * share) % shares").alias("rest"), F.expr(f"shares - 1 - ({rows} * share) % shares").alias("gap"), F.expr(rows).alias("total"), "shares"))
    bucket = F.floor(F.col("gap") / F.col("shares") * BUCKETS)
    counts = floors.df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # BUCKETS rows at most
    below = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = floors.df.agg((F.max("total") - F.sum("floor")).alias("left"))
    at = counts.withColumn("below", below).crossJoin(F.broadcast(left)).filter("below < left and left <= below + n").select(F.col("bucket").alias("at"), (F.col("left") - F.col("below")).alias("take"))
    at = Shared(at)  # one row, or none where nothing is left
    edge = floors.df.withColumn("bucket", bucket).join(F.broadcast(at.df), F.col("bucket") == F.col("at"))
    edge = edge.withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy("gap", "source"))).filter("place <= take").select("source", F.lit(1).alias("more"))
    all_below = floors.df.withColumn("bucket", bucket).join(F.broadcast(at.df), F.col("bucket") < F.col("at")).select("source", F.lit(1).alias("more"))
    out = floors.df.join(edge.unionByName(all_below), "source", "left").select("source", "zs", (F.col("floor") + F.coalesce("more", F.lit(0))).cast("bigint").alias("target"))
    made = Shared(out)
    floors.drop()
    at.drop()
    return made.df


def copies(docs: DataFrame, total: int | None = None) -> DataFrame:
    """(row, copies): each row of ``docs`` as a struct of all its columns, and how often it is in the mixture, 0 if it is not.

    A null source is a source of its own; a null or negative n_chars counts as 0.  Rows that repeat a doc_id in a source (null ids
    too) draw alike; where the cut falls among them, those with the least hash of all columns are taken, so many as are needed, and of
    rows that are equal throughout any.  Texts of any length are only carried.  An empty table gives an empty result.  Further columns
    of any name ride in the struct and can't clash."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    source = F.coalesce(F.col("row.source").cast("string"), F.lit("\0"))
    chars = F.greatest(F.coalesce(F.col("row.n_chars").cast("bigint"), F.lit(0)), F.lit(0))
    wide = row.select("row", source.alias("source"), F.col("row.doc_id").alias("doc_id"), measure(F.col("row.n_chars")).alias("z"), chars.alias("chars"))
    narrow = wide.drop("row")
    sums = Shared(narrow.groupBy("source").agg(F.count("*").alias("n"), F.sum("z").alias("zs"), F.floor(F.sqrt(F.sum("chars") + 1)).alias("share")))
    goals = targets(sums.df, total)
    sums.drop()

    def expected(df: DataFrame, add: DataFrame) -> DataFrame:
        df = df.join(sized(add), "source")
        p = F.expr("(target * z) % zs").cast("double") / F.col("zs").cast("double")
        return df.withColumn("sure", F.expr("target * z div zs")).withColumn("rank", rank(F.col("doc_id"), p))

    drawn = expected(narrow, goals)
    bucket = F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS)
    counts = Shared(drawn.groupBy("source", bucket.alias("bucket")).agg(F.count("rank").alias("n"), F.sum("sure").alias("sure"), F.first("target").alias("target")))
    w = Window.partitionBy("source")
    below = F.coalesce(F.sum("n").over(w.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = counts.df.withColumn("need", F.col("target") - F.sum("sure").over(w)).withColumn("below", below)
    cuts = Shared(cuts.filter("bucket is not null and below < need and need <= below + n").select("source", F.col("bucket").alias("at"), (F.col("need") - F.col("below")).alias("take")))
    inside = drawn.withColumn("bucket", bucket).join(sized(cuts.df), "source").filter("bucket = at")
    # equal ranks are counted first, as a doc_id may repeat without bound
    held = inside.groupBy("source", "rank", "take").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(w.orderBy("rank"))
    last = held.withColumn("before", upto - F.col("n")).filter("before < take and take <= before + n")
    final = Shared(goals.join(last.select("source", F.col("rank").alias("cut"), (F.col("take") - F.col("before")).alias("some"), F.col("n").alias("tied")), "source", "left"))
    counts.drop()
    cuts.drop()
    out = expected(wide, final.df).withColumn("whole", F.coalesce(F.col("some") == F.col("tied"), F.lit(True)))
    more = F.when((F.col("rank") < F.col("cut")) | (F.col("rank") == F.col("cut")) & F.col("whole"), 1).otherwise(0)
    if final.df.filter("some <> tied").isEmpty():
        return out.select("row", (F.col("sure") + more).alias("copies"))
    torn = (F.col("rank") == F.col("cut")) & ~F.col("whole")
    plain = out.filter(~F.coalesce(torn, F.lit(False))).select("row", (F.col("sure") + more).alias("copies"))
    equal = out.filter(torn).groupBy("source", "row", "sure", "some").agg(F.count("*").alias("n"))
    given = F.least(F.greatest(F.col("some") - F.coalesce(F.sum("n").over(w.orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0)), F.col("n"))
    each = equal.withColumn("given", given).select("row", "sure", "given", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i"))
    return plain.unionByName(each.select("row", (F.col("sure") + (F.col("i") <= F.col("given")).cast("bigint")).alias("copies")))


def sample(docs: DataFrame, total: int | None = None) -> DataFrame:
    """(doc_id, source, copies) of every document that is in the mixture."""
    return copies(docs.select("doc_id", "source", "n_chars"), total).filter("copies > 0").select("row.doc_id", "row.source", F.col("copies").cast("bigint").alias("copies"))


def mixed(docs: DataFrame, total: int | None = None) -> DataFrame:
    """The rows of the mixture with the columns of ``docs``, each as often as it has copies."""
    out = copies(docs, total).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, chr(0)) AS s, greatest(coalesce(n_chars, 0), 0) AS chars,
         {BASE} + least(greatest(coalesce(n_chars, 0), 0), {CLIP}) AS z
  FROM documents),
sums AS (SELECT s, count(*)::BIGINT AS n, sum(z)::BIGINT AS zs, floor(sqrt(sum(chars) + 1))::BIGINT AS share FROM d GROUP BY s),
parts AS (SELECT s, zs, ((SELECT sum(n)::BIGINT FROM sums) * share) // (SELECT sum(share)::BIGINT FROM sums) AS least, ((SELECT sum(n)::BIGINT FROM sums) * share) % (SELECT sum(share)::BIGINT FROM sums) AS rest FROM sums),
goals AS (SELECT s, zs, least + (row_number() OVER (ORDER BY rest DESC, s) <= (SELECT sum(n) FROM sums) - (SELECT sum(least) FROM parts))::BIGINT AS target FROM parts),
e AS (
  SELECT doc_id, source, d.s, (target * z) // zs AS sure, ((target * z) % zs)::DOUBLE / zs::DOUBLE AS p, target,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN goals USING (s)),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, target - sum(sure) OVER (PARTITION BY s) AS need FROM e),
k AS (SELECT *, CASE WHEN q IS NULL THEN 0 WHEN row_number() OVER (PARTITION BY s ORDER BY q NULLS LAST, doc_id) <= need THEN 1 ELSE 0 END AS drawn FROM r)
SELECT doc_id, source, (sure + drawn)::BIGINT AS copies FROM k WHERE sure + drawn > 0
"""
