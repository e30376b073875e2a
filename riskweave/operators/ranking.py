"""Distributed ordered prefix sums and exact quantiles, one lazy plan at every size.

A plain ``Window.orderBy(x)`` without ``partitionBy`` moves every row into a
single task, and one partitioned by a hot group moves that group into one. The
running sums behind ROC/PR curves, the two-sample KS statistic and exact
quantiles instead use two levels:

1. rows collapse to one per distinct ordering key (map-side partial
   aggregation), so a hot key is a single row;
2. the rows are dealt to ordered buckets: numbers by edges from a sample of
   their group's distinct keys (``sampled_edges``), other keys by an expression
   that the caller gives (leading digits of a hash, a stretch of time);
3. bucket sums, a table of (group, bucket) rows, give each bucket's offset;
4. a window partitioned by (group, bucket) adds the running sum within it.

The sample is part of the same lazy plan, so no job runs while a plan is built.
It is chosen by hash and by no order of rows or merges: a recomputed task finds
the same edges, as it must, since a row's bucket is worked out more than once.
Any edges give the exact result; they only balance the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BKT = "_rw_bucket"
CELLS = 64  # buckets of a group, at least
PER_CELL = 16  # sampled keys per bucket
MOST_GROUPS = 4096  # groups that get edges: what is broadcast stays below this many short arrays


def value_bucket(value: Column) -> Column:
    """Bucket of a number: its sign, decimal exponent and three leading digits.

    Monotone in the value, and independent of the data: about 900 buckets per
    decade. NaN sorts after all numbers, as it does in Spark.
    """
    x = value.cast("double")
    size = F.abs(x)
    exponent = F.greatest(F.floor(F.log10(size)), F.lit(-300))  # the power below must not vanish
    digits = F.floor(size / F.pow(F.lit(10.0), exponent - 2))
    magnitude = (exponent + 400) * 1000 + digits
    return (F.when(F.isnan(x), F.lit(2_000_000)).when(size == 0, F.lit(0)).when(size == float("inf"), F.signum(x) * 1_000_000)
            .otherwise(F.signum(x) * magnitude)).cast("int")


def sampled_edges(rows: DataFrame, key: str, by: Sequence[str] = (), cells: int = CELLS) -> DataFrame:
    """Per group, ``cells - 1`` ascending keys (``_edges``) that part its distinct keys about evenly.

    The keys' hashes fall into ``PER_CELL * cells`` strata and the least hash
    of each names a sampled key: a uniform sample of the distinct keys of fixed
    size, from one aggregate that merges in any order. A bucket holds
    ``PER_CELL`` sampled keys, so its share of the keys is off by about one part
    in ``sqrt(PER_CELL)``. Groups with fewer distinct keys than half the strata
    get none, nor do more than the ``MOST_GROUPS`` groups of most sampled keys.
    """
    strata = PER_CELL * cells
    mark = F.xxhash64(key)
    least = rows.where(F.col(key).isNotNull()).groupBy(*by, F.pmod(mark, F.lit(strata)).alias("_stratum")).agg(
        F.min(F.struct(mark.alias("mark"), F.col(key).alias("value")))["value"].alias("_value"))
    sample = least.groupBy(*by).agg(F.sort_array(F.collect_list("_value")).alias("_sample")).where(F.size("_sample") >= strata // 2)
    if by:
        sample = sample.orderBy(F.size("_sample").desc(), *by).limit(MOST_GROUPS)
    return sample.select(*by, F.transform(F.sequence(F.lit(1), F.lit(cells - 1)), lambda i: F.get(
        "_sample", F.floor(i * F.size("_sample") / cells).cast("int"))).alias("_edges"))


def edge_bucket(key: Column, edges: Column, cells: int) -> Column:
    """Number of edges not above the key, by bisection."""
    halves = [1 << i for i in reversed(range((cells - 1).bit_length()))]
    return F.aggregate(F.array(*[F.lit(h) for h in halves]), F.lit(0), lambda at, half: at + F.when(
        F.get(edges, at + half - 1) <= key, half).otherwise(0))


def _never_null(name: str, kind: str) -> tuple[Column, Column]:
    """(is null, value or a default) of a column: grouping keys that joins and windows share."""
    c = F.col(name)
    plain = {"string": "", "boolean": False}.get(kind, 0 if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else None)
    if plain is None:
        return c.isNull(), F.coalesce(c.cast("string"), F.lit(""))
    return c.isNull(), F.coalesce(c, F.lit(plain).cast(kind))


def prefix_sums(df: DataFrame, key: str, sums: dict[str, Column | str], by: Sequence[str] = (), descending: bool = False,
                bucket: Column | None = None, unique_keys: bool = False, carry: Sequence[str] = (), cells: int | None = None) -> DataFrame:
    """Per (by, key): the summed columns, inclusive running sums and group totals.

    Output columns: ``*by, key, <name>, cum_<name>, total_<name>`` for each
    entry of ``sums`` (name -> column expression over the input rows).
    Running sums follow ``key`` ascending, or descending if asked.
    ``bucket`` is a non-decreasing expression of the key; without one the key
    is a number and gets ``cells`` buckets by ``sampled_edges`` (default: two
    per shuffle partition, 64 to 256), or ``value_bucket`` in groups without edges.
    With ``unique_keys`` the input already has one row per (by, key): the
    grouping shuffle is skipped and ``carry`` columns pass through.
    """
    by, names = list(by), list(sums)
    exprs = {n: c if isinstance(c, Column) else F.col(c) for n, c in sums.items()}
    if unique_keys:
        rows = df.select(*by, key, *carry, *[c.alias(n) for n, c in exprs.items()])
    else:
        rows, carry = df.groupBy(*by, key).agg(*[F.sum(c).alias(n) for n, c in exprs.items()]), ()
    # keys that are never null, so that join and window share one exchange and null groups stay
    kinds = dict(rows.dtypes)
    typed = {f"_k{i}{part}": e for i, c in enumerate(by) for part, e in zip("nv", _never_null(c, kinds[c]))}
    rows, group = rows.withColumns(typed) if typed else rows, list(typed)
    if bucket is None:
        cells = cells or max(CELLS, min(256, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        edges = F.broadcast(sampled_edges(rows, key, group, cells))  # at most MOST_GROUPS rows
        rows = rows.join(edges, group or F.lit(True), "left")
        by_edge = edge_bucket(F.col(key), F.col("_edges"), cells)
        bucket = F.when(F.col(key).isNotNull(), F.when(F.col("_edges").isNotNull(), by_edge).otherwise(value_bucket(F.col(key))))
    rows = rows.withColumn(_BKT, bucket).drop("_edges")
    cell = {f"_b{part}": e for part, e in zip("nv", _never_null(_BKT, dict(rows.dtypes)[_BKT]))}
    rows, cell = rows.withColumns(cell), [*group, *cell]
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    # (group, bucket) rows: sums of the earlier buckets and of the whole group
    before = Window.partitionBy(*group).orderBy(order(_BKT)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    starts = rows.groupBy(*cell, _BKT).agg(*[F.sum(n).alias(f"_bt_{n}") for n in names]).select(
        *cell, *[F.coalesce(F.sum(f"_bt_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_bt_{n}").over(whole).alias(f"total_{n}") for n in names])
    within = Window.partitionBy(*cell).orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, cell).select(
        *by, key, *carry, *names, *[(F.col(f"_off_{n}") + F.sum(n).over(within)).alias(f"cum_{n}") for n in names],
        *[F.col(f"total_{n}") for n in names])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy/``quantile_cont`` semantics).

    Returns one row per (by, prob): ``*by, prob, quantile``. Nulls are ignored.
    Every distinct value knows the ranks it covers from ``prefix_sums``; one
    aggregate picks the values at the two ranks around each quantile.
    """
    return _interpolated(_covering(prefix_sums(df.where(F.col(value).isNotNull()), value, {"cnt": F.lit(1)}, by=by)), value, probs, list(by))


def _covering(cum: DataFrame, count: str = "cnt") -> DataFrame:
    """Adds ``_from`` and ``_to``: the 0-based ranks that a distinct value covers, and ``_last`` of the group."""
    return cum.withColumns({"_to": F.col(f"cum_{count}") - 1, "_from": F.col(f"cum_{count}") - F.col(count),
                            "_last": F.col(f"total_{count}") - 1})


def _interpolated(ranked: DataFrame, value: str, probs: Sequence[float], by: list[str]) -> DataFrame:
    picks, last = [], F.col("_last")
    for i, p in enumerate(probs):
        for name, rank in (("lo", F.floor(F.lit(float(p)) * last)), ("hi", F.ceil(F.lit(float(p)) * last))):
            picks.append(F.max(F.when(rank.between(F.col("_from"), F.col("_to")), F.col(value))).alias(f"_{name}{i}"))
    wide = ranked.groupBy(*by).agg(F.max("_last").alias("_last"), *picks)
    rows = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * last
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        rows.append(F.struct(F.lit(float(p)).alias("prob"), F.when(F.floor(at) == F.ceil(at), lo).otherwise(
            lo + (hi - lo) * (at - F.floor(at))).cast("double").alias("quantile")))
    return wide.where(last.isNotNull()).select(*by, F.explode(F.array(*rows)).alias("_q")).select(*by, "_q.prob", "_q.quantile")


def quantile_row(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One-row frame with a column per requested quantile (exact)."""
    q = exact_quantiles(df, value, probs)
    aggs = [F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n) for p, n in zip(probs, names)]
    return q.agg(*aggs)


KLL_K = 4096


def approx_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles from one mergeable sketch per group: ``*by, prob, quantile``, one aggregate and no sort.

    A KLL sketch of ``KLL_K`` items: the rank of a returned value is within 0.1 %
    of the rows of the asked rank (99 % of the time), whatever their number. Its
    compactions are random, so reruns may differ within that error: a mode for
    reports, not for edges or for results that must repeat. Nulls are ignored.
    """
    sketch = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("_s"))
    asked = F.array(*[F.lit(float(p)) for p in probs])
    at = F.arrays_zip(asked.alias("prob"), F.kll_sketch_get_quantile_double("_s", asked).alias("quantile"))
    return sketch.where(F.col("_s").isNotNull()).select(*by, F.explode(at).alias("_q")).select(*by, "_q.prob", "_q.quantile")
