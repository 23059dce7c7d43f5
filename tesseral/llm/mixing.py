"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Sizes are words. Every source gets a target (``targets``); inside a source a document of size s has the integer
weight w = number of binary digits of s, so that long documents are somewhat likelier than short ones, and the
expected number of copies m = min(max_copies, c * w), where c makes the expected words meet the target. floor(m)
copies are certain; the rest, l = m - floor(m), is the inclusion probability in a sample of fixed size (in words):
documents are ranked by their random odds u / (1 - u) divided by their inclusion odds l / (1 - l), and are taken in
that order up to the document at which the source's words come nearest to its target. u is a hash of the id, so reruns
agree.

No source is ever gathered in one task: each is cut into about sqrt(n) rank intervals, whose sums give the interval
that holds the cut, and only that interval's documents, about sqrt(n) of them, are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesseral.llm.work import Scratch, broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _uniform(key: Column, seed: str) -> Column:
    """In (0, 1), from the first 52 bits of a digest of the key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_copies: int) -> DataFrame:
    """One row per source (columns _src, _total) with _target: the sources, by code point and null last, have the weights in
    turn and share ``share`` times all words; a target stops at max_copies times its source, and the excess is shared anew.
    The windows here run over the sources alone."""
    everything = Window.orderBy(F.col("_src").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("_weight", weight).withColumn("_cap", F.lit(float(max_copies)) * F.col("_total"))
    rising = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_src").asc_nulls_last())
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    budget = F.lit(float(share)) * F.sum("_total").over(whole)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    ranked = ranked.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    ranked = ranked.withColumn("_share", F.first(fits, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_share").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_share") * F.col("_weight")))
    return ranked.select("_src", "_total", target.alias("_target"))


def _levels(histogram: DataFrame, shares: DataFrame, max_copies: int) -> DataFrame:
    """For each source and weight: certain copies, inclusion probability, and what the sample of the source must hold."""
    most = F.lit(float(max_copies))
    joined = histogram.join(shares.withColumnRenamed("_src", "_s"), _same("_src", "_s"), "left").drop("_s")
    falling = Window.partitionBy("_src").orderBy(F.col("_w").desc())
    above = F.coalesce(F.sum("_words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("_w") * F.col("_words")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    rate = F.try_divide(F.col("_target") - most * above, below)
    joined = joined.withColumn("_rate", rate)
    source = Window.partitionBy("_src")
    meets = F.when(F.col("_rate") * F.col("_w") <= most, F.col("_rate"))
    joined = joined.withColumn("_c", F.first(meets, ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    full = F.col("_c").isNull() | (F.col("_target") >= most * F.col("_total"))
    copies = F.when(full, most).otherwise(F.least(most, F.col("_c") * F.col("_w")))
    joined = joined.withColumn("_certain", F.floor(copies)).withColumn("_p", copies - F.floor(copies))
    open_words = F.sum(F.when(F.col("_p") > 0, F.col("_words")).otherwise(0)).over(source)
    sampled = F.col("_target") - F.sum(F.col("_certain") * F.col("_words")).over(source)
    n = F.sum(F.when(F.col("_p") > 0, F.col("_n")).otherwise(0)).over(source)
    joined = joined.withColumn("_sampled", sampled).withColumn("_mean", F.try_divide(sampled, open_words))
    return joined.select("_src", "_w", "_total", "_target", "_certain", "_p", "_sampled", "_mean", F.ceil(F.sqrt(n)).alias("_slots"))


def _ranked(units: DataFrame, levels: DataFrame, seed: str, key: str) -> DataFrame:
    """Adds each document's allotment, its rank _q in the order sample of its source, and the interval _slot of that rank."""
    levels = levels.withColumnRenamed("_src", "_s").withColumnRenamed("_w", "_v")
    out = units.withColumn("_w", F.length(F.bin(F.col("_size"))))
    out = out.join(levels, _same("_src", "_s") & (F.col("_w") == F.col("_v")), "left").drop("_s", "_v")
    u = _uniform(F.col(key), seed)
    q = (u / (1 - u)) * F.try_divide(1 - F.col("_p"), F.col("_p")) * F.try_divide(F.col("_mean"), 1 - F.col("_mean"))
    in_sample = (F.col("_p") > 0) & (F.col("_mean") > 0) & (F.col("_mean") < 1) & (F.col("_size") > 0)
    out = out.withColumn("_q", F.when(in_sample, q))
    return out.withColumn("_slot", F.floor(F.col("_q") / (1 + F.col("_q")) * F.col("_slots")))


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_copies: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """All rows of docs with size, source_size, target, copies and taken (= copies * size).

    Those five names replace columns of the same name; other columns, also clashing ones, stay. Null texts and texts
    without words have size 0, no rank and 0 copies taken; a null source is a source of its own, the last; null ids share one
    random number. Rows that tie in rank, id and size are told apart by a hash of their text; of equal rows at the cut as many are taken
    as bring the source nearest to its target. An empty table gives an empty table; long texts are only counted.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own = [F.col(key).alias("_key"), F.col(source).alias("_src"), word_count(F.col(text)).alias("_size"), F.xxhash64(text).alias("_text")]
    units = docs.select(*own)
    units = scratch.write(units, "units")
    by_weight = units.groupBy("_src", F.length(F.bin("_size")).alias("_w")).agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_n"))
    by_weight = scratch.write(by_weight, "histogram")
    sizes = by_weight.groupBy("_src").agg(F.sum("_words").alias("_total"))
    shares = scratch.write(targets(sizes, weights, share, max_copies), "targets")
    levels = scratch.write(_levels(by_weight.filter("_words > 0"), shares, max_copies), "levels")
    levels = broadcast_if_small(levels)
    ranked = _ranked(units, levels, seed, "_key").filter("_q is not null").select("_src", "_slot", "_q", "_key", "_size", "_text", "_sampled")
    slots = ranked.groupBy("_src", "_slot").agg(F.sum("_size").alias("_in"), F.max("_sampled").alias("_need"))
    upto = Window.partitionBy("_src").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_before", F.coalesce(F.sum("_in").over(upto), F.lit(0)))
    edge = slots.filter("_before < _need and _need <= _before + _in").select(F.col("_src").alias("_s"), F.col("_slot").alias("_edge"), "_before")
    edge = broadcast_if_small(scratch.write(edge, "edges"))
    inside = ranked.join(edge, _same("_src", "_s") & (F.col("_slot") == F.col("_edge"))).drop("_s")
    rank = F.struct("_q", "_key", "_size", "_text")
    # equal rows are one row here, with their number
    inside = inside.groupBy("_src", "_q", "_key", "_size", "_text", "_edge", "_before", "_sampled").agg(F.count(F.lit(1)).alias("_equal"))
    order = Window.partitionBy("_src").orderBy("_q", "_key", "_size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum(F.col("_size") * F.col("_equal")).over(order), F.lit(0))
    fit = F.floor((F.col("_sampled") - start) / F.col("_size") + 0.5)  # the n-th of them is taken if start + (n - 1/2) * size is not beyond
    inside = inside.withColumn("_fit", F.greatest(F.lit(0), F.least("_equal", fit)))
    last = F.max(F.when(F.col("_fit") > 0, F.struct(rank.alias("rank"), "_fit", "_equal")))
    cut = inside.groupBy("_src").agg(F.max("_edge").alias("_edge"), last.alias("_last"))
    cut = cut.select(F.col("_src").alias("_s"), "_edge", F.col("_last.rank").alias("_last"), F.col("_last._fit").alias("_fit"), (F.col("_last._fit") < F.col("_last._equal")).alias("_split"))
    cut = broadcast_if_small(scratch.write(cut, "cuts"))
    shares = broadcast_if_small(shares.select(F.col("_src").alias("_s2"), F.col("_total").alias("_all"), F.col("_target").alias("_goal")))

    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    out = docs.select(F.struct(*docs.columns).alias("_row"), *own)
    out = _ranked(out, levels, seed, "_key").join(cut, _same("_src", "_s"), "left").drop("_s")
    out = out.join(shares, _same("_src", "_s2"), "left")
    at_edge = (F.col("_slot") == F.col("_edge")) & F.coalesce(rank <= F.col("_last"), F.lit(False))
    if not cut.filter("_split").isEmpty():  # of equal rows at the cut some are taken: they are numbered
        tied = F.coalesce(F.col("_split") & (F.col("_slot") == F.col("_edge")) & (rank == F.col("_last")), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("_src").orderBy(F.lit(0)))
        some = out.filter(tied).withColumn("_late", nth > F.col("_fit"))
        out = out.filter(~tied).withColumn("_late", F.lit(False)).unionByName(some)
        at_edge = at_edge & ~F.col("_late")
    sampled = F.col("_q").isNotNull() & (F.col("_edge").isNull() | (F.col("_slot") < F.col("_edge")) | at_edge)
    copies = F.when(F.col("_size") > 0, F.coalesce(F.col("_certain"), F.lit(0)) + F.coalesce(sampled, F.lit(False)).cast("long")).otherwise(0)
    out = out.withColumn("_copies", copies.cast("long"))
    return out.select(
        *[F.col("_row")[c].alias(c) for c in names],
        F.col("_size").alias("size"),
        F.coalesce("_all", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("_goal", F.lit(0.0)).alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def repeat_copies(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.filter("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
