"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

A source's target is its weight's share of the total, but at most ``max_epochs``
times its size; what the caps cut off goes to the others by weight until no
target is above its cap. With sources in order of cap per unit of weight, the
capped ones come first, so running sums give the level at once. A document is
then taken a whole number of times, and once more if it comes early enough in a
seeded order; the last such document of a source is taken in part, so that a
source's words meet its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, materialize

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MAX_EPOCHS = 2
SEED = 42
#: Hex digits of the order's hash that deal a source's documents into buckets.
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def order_key(id_: Column, seed: int = SEED) -> Column:
    """A seeded pseudo-random order of documents: 32 hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn. The
    table holds one row a source, so ordering it as a whole is cheap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    goal = F.lit(float(total)) * F.sum("source_size").over(everything)
    rest = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    left = goal - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / rest).withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
    # The first source that is not capped has the level of all that are not.
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def take(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """(doc_id, tie, size, source_size, target, taken), one row for each row.

    A null text has size 0; a null source is a source of its own. A source of
    size 0 has target 0. Rows that repeat an id are told apart by their size,
    then by a hash of their text (``tie``); rows equal in all of these share the
    order among themselves at will. Extra columns are ignored; an empty table
    gives an empty result.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        words(F.col(text_col)).alias("size"),
        order_key(F.col(id_col), seed).alias("key"),
        F.coalesce(F.md5(text_col), F.lit("")).alias("tie"),
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    slim = materialize(slim, "mix-sizes")
    # Buckets are consecutive in the seeded order, so that a source's running
    # sum needs no task that holds the source.
    buckets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    goals = targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), **kw)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    b, g = buckets.alias("b"), goals.alias("g")
    placed = b.join(g, F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "b.bucket", "b.base", "g.source_size", "g.target")
    placed = materialize(placed, "mix-buckets")
    d, p = slim.alias("d"), placed.alias("p")
    joined = d.join(p, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bucket") == F.col("p.bucket"))).select(
        "doc_id", "tie", "size", "source_size", "target", "d.source", "d.bucket", "key", "base"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    goal = F.round("target").cast("long")
    whole = F.coalesce(F.floor(goal / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    part = goal - whole * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), part - start))
    return joined.select("doc_id", "tie", "size", "source_size", "target", (whole * F.col("size") + extra).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str = "n_chars", **kw) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each whole copy is a row, and
    a part of a document is a row whose text is its leading words.

    All columns are returned; ``count_col``, if there, is the text's new length.
    Documents without a word are taken once, as they cost nothing.
    """
    cols = docs.columns
    taken = take(docs, id_col=id_col, text_col=text_col, source_col=source_col, **kw)
    # Rows alike in id and text may stand in different places: number them on both sides.
    alike = Window.partitionBy("own", "tie")
    t = taken.select(F.col("doc_id").alias("own"), "tie", "size", "taken").withColumn("nth", F.row_number().over(alike.orderBy("taken")))
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"), F.col(id_col).alias("own"), F.coalesce(F.md5(text_col), F.lit("")).alias("tie")
    ).withColumn("nth", F.row_number().over(alike.orderBy(F.xxhash64("row"))))
    t, d = t.alias("t"), packed.alias("d")
    j = d.join(t, F.col("d.own").eqNullSafe(F.col("t.own")) & (F.col("d.tie") == F.col("t.tie")) & (F.col("d.nth") == F.col("t.nth")))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    j = j.select("row", "size", "taken", copies.alias("copies")).where("copies > 0")
    j = j.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    text = F.col("row").getField(text_col)
    cut = F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, left.cast("int")), " ")
    text = F.when((F.col("size") > 0) & (left < F.col("size")), cut).otherwise(text)
    j = j.select("row", text.alias("new"))
    out = []
    for c in cols:
        value = F.col("row").getField(c)
        out.append(F.col("new").alias(c) if c == text_col else F.length("new").cast("long").alias(c) if c == count_col else value.alias(c))
    return j.select(*out)


#: The same result in SQL (DuckDB), at the default parameters.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('42:' || coalesce(doc_id::VARCHAR, '')) AS k, coalesce(md5(text), '') AS tie
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT source, source_size, w, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN cap <= w * level THEN cap ELSE w * (arg_min(level, cap / w) FILTER (WHERE cap > w * level) OVER ()) END AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (coalesce(goal // nullif(source_size, 0), 0) * size
        + greatest(0, least(size, goal - coalesce(goal // nullif(source_size, 0), 0) * source_size - start)))::BIGINT AS taken
FROM p
"""
