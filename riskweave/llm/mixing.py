"""Mixing sources to target weights by systematic sampling (native expressions only).

Every document has an expected number of copies. Documents of a source are
laid end to end, each as long as its expectation, on a line that starts at one
random offset; a document is emitted once per integer boundary inside its
piece. Expectations are held as integers in units of 2**-32, so the running
sums are exact, independent of summation order, and a rerun repeats them.

The order within a source is by size class, then by salt, then by size: equal
sizes lie together, so what a source takes stays near its target, and no task
needs a whole source. Running sums are taken inside (source, size class, salt)
and shifted by the sums of the earlier ones, a table of at most ``250 * salts``
rows per source. Only the place within a unit matters, so all sums are kept
modulo 2**32 and none grows with the corpus; salts hash the ids, whatever
pattern those have, and their number is a parameter (a cell should stay below
2**31 rows). Sources are ranked in one task: tens or thousands of them, a row each.

Nulls: a null source is a source of its own (last in order), a null text has
size 0, a null id sorts first. Repeated rows are sampled one by one. An empty
table gives an empty result; a source without words gets target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.scratch import materialize

UNIT = 32  # expectations are integers in units of 2**-UNIT
SALTS = 64
WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2.0


def word_count(text: Column) -> Column:
    """Number of maximal runs outside ``[\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "source_size",
                   weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE,
                   most_repeats: float = MOST_REPEATS) -> DataFrame:
    """Adds ``target`` to a table with one row per source.

    Sources in code point order (null last) weigh ``weights`` in turn and share
    ``total_share`` of all sizes; a target stops at ``most_repeats`` times its
    source's size and the excess is shared again by weight. That fixed point
    is found in one pass: with sources sorted by cap over weight, a source is
    capped if the level left by the earlier ones exceeds its own.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    given = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn(
        "_cap", F.col(size) * F.lit(float(most_repeats)))
    level = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col(source).asc_nulls_last())
    before, whole = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left_cap = F.sum(size).over(whole) * F.lit(float(total_share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    left_w = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    ranked = given.withColumn("_level", left_cap / left_w).withColumn("_full", F.col("_level") * F.col("_w") > F.col("_cap"))
    # the first source that is not full sees the final level
    final = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col(source).isNull(), source, "_level"))
                  ).over(whole)
    return ranked.withColumn("_final", final).withColumn(
        "target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_final._level") * F.col("_w"))
    ).drop("_w", "_cap", "_level", "_full", "_final")


def size_class(size: Column) -> Column:
    """Monotone class of a size: its bit length and its three leading bits."""
    length = F.length(F.bin(size))
    return (length * 8 + F.call_function("shiftright", size, F.greatest(length - 3, F.lit(0)))).cast("int")


def random_offset(source: Column, seed: int) -> Column:
    """One offset in [0, 2**UNIT) per source, fixed by the seed."""
    key = F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, UNIT // 4), 16, 10).cast("long")


def id_salt(doc_id: Column, salts: int) -> Column:
    """A salt in [0, salts) from the id's digest; 0 for null."""
    drawn = F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("long")
    return F.coalesce(F.pmod(drawn, F.lit(salts)), F.lit(0)).cast("int")


def systematic_copies(df: DataFrame, source: str, size: str, rate: str, doc_id: str, seed: int = 0,
                      salts: int = SALTS) -> DataFrame:
    """Adds ``mx_copies``: how often systematic sampling emits the row.

    ``rate`` is the row's expected number of copies (null or negative: 0); a row
    gets the integer below or above it.
    """
    # not the caller's names: these must not clash with its columns
    step = F.round(F.greatest(F.coalesce(F.col(rate), F.lit(0.0)), F.lit(0.0)) * F.lit(float(1 << UNIT))).cast("long")
    keyed = df.withColumns({
        "_mx_none": F.col(source).isNull(), "_mx_src": F.coalesce(F.col(source), F.lit("")),
        "_mx_class": size_class(F.col(size)), "_mx_salt": id_salt(F.col(doc_id), salts), "_mx_step": step,
        "_mx_part": step.bitwiseAND(F.lit((1 << UNIT) - 1))})
    group = ["_mx_none", "_mx_src"]
    cell = [*group, "_mx_class", "_mx_salt"]
    earlier = Window.partitionBy(*group).orderBy("_mx_class", "_mx_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*cell).agg(F.pmod(F.sum("_mx_part"), F.lit(1 << UNIT)).alias("_mx_sum")).select(
        *cell, F.coalesce(F.sum("_mx_sum").over(earlier), F.lit(0)).alias("_mx_start"))
    inside = Window.partitionBy(*cell).orderBy(size, doc_id).rowsBetween(Window.unboundedPreceding, 0)
    before = F.pmod(F.col("_mx_start") + F.sum("_mx_part").over(inside) - F.col("_mx_part")
                    + random_offset(F.when(~F.col("_mx_none"), F.col("_mx_src")), seed), F.lit(1 << UNIT))
    out = keyed.join(starts, cell).withColumn("_mx_before", before)
    return out.select(*df.columns, F.shiftright(F.col("_mx_before") + F.col("_mx_step"), UNIT).alias("mx_copies"))


def sized_documents(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, source, mx_size), written once: later steps read it again. ``whole`` adds ``mx_row``, all columns."""
    row = [F.struct("*").alias("mx_row")] if whole else []
    return materialize(docs.select("doc_id", "source", *row, word_count(F.col("text")).alias("mx_size")), "sized")


def mix(docs: DataFrame, seed: int = 0, whole: bool = False, salts: int = SALTS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): ``mx_size``, ``mx_source_size``, ``mx_target``
    (words its source should give) and ``mx_copies`` (how often the mix takes it)."""
    sized = sized_documents(docs, whole)
    sources = materialize(source_targets(sized.groupBy("source").agg(F.sum("mx_size").alias("source_size"))), "targets")
    rated = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.*", F.col("s.source_size").alias("mx_source_size"), F.col("s.target").alias("mx_target"),
        F.when(F.col("s.source_size") > 0, F.col("s.target") / F.col("s.source_size")).otherwise(0.0).alias("mx_rate"))
    return systematic_copies(rated, "source", "mx_size", "mx_rate", "doc_id", seed, salts).drop("mx_rate")


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed corpus: every row ``mx_copies`` times, with the columns it came with (``mix(..., whole=True)``)."""
    return mixed.where(F.col("mx_copies") > 0).select(
        "mx_row", F.explode(F.array_repeat(F.lit(0), F.col("mx_copies").cast("int")))).select("mx_row.*")


def mix_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed corpus, each row as often as the mix takes it."""
    return emit(mix(docs, whole=True))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Systematic mix of all documents: doc_id, size, source_size, target, taken (words), and source, copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(
        "doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"),
        F.col("mx_target").alias("target"), (F.col("mx_copies") * F.col("mx_size")).alias("taken"), "source",
        F.col("mx_copies").alias("copies"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
         source_size * 2.0::DOUBLE AS cap FROM per_source),
ranked AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER ()
             - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM weighed),
final AS (
  SELECT source, source_size, CASE WHEN lvl * w > cap THEN cap ELSE w *
    (SELECT lvl FROM ranked WHERE NOT (lvl * w > cap) ORDER BY cap / w, source ASC NULLS LAST LIMIT 1) END AS target FROM ranked),
rated AS (
  SELECT d.doc_id, d.source, d.size, f.source_size, f.target,
         round(CASE WHEN f.source_size > 0 THEN f.target / f.source_size ELSE 0 END * 4294967296.0)::BIGINT AS step,
         length(bin(d.size)) * 8 + (d.size >> greatest(length(bin(d.size)) - 3, 0)) AS cls,
         coalesce(('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT % 64, 0) AS salt
  FROM sized d JOIN final f ON d.source IS NOT DISTINCT FROM f.source),
laid AS (
  SELECT *, sum(step) OVER (PARTITION BY source ORDER BY cls, salt, size, doc_id ASC NULLS FIRST ROWS UNBOUNDED PRECEDING)
            + ('0x' || substr(md5('0/' || coalesce('=' || source, 'null')), 1, 8))::BIGINT AS fin
  FROM rated)
SELECT doc_id, size, source_size, target,
       ((fin::BIGINT >> 32) - ((fin::BIGINT - step) >> 32)) * size AS taken, source,
       ((fin::BIGINT >> 32) - ((fin::BIGINT - step) >> 32)) AS copies
FROM laid
"""
