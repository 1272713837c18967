"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source has a repetition rate: its target share of the corpus over its actual
share. A document's number of copies is the Poisson quantile (mean: the rate of its
source) of a uniform number hashed from its id and the seed, so that it depends on
nothing else and any executor computes it again alike. Copies are dealt over all
partitions by a hash and sorted by it inside: a shuffle of the whole corpus.

Sources are counted by partial aggregation. The rates, a row for each source, are broadcast
if there are ``BROADCAST_SOURCES`` at most, so that only the copies are shuffled; with more
sources they are joined by a shuffle on the source, in which the skew handling of adaptive joins divides a
source that holds a third of all rows.

Defined results: a null source is a source of its own; null ids are hashed as the
text ``null``; repeated rows get equal numbers of copies; a very long text is a value like any other; a source without target
weight gets none; an empty table gives an empty result; columns of the input are kept
as they are, so ``copy_no`` is the one name added (an input column of that name is replaced).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

SEED = 42
BROADCAST_SOURCES = 100_000


def uniform(doc_id: Column, seed: int = SEED) -> Column:
    """In [0, 1): the first 52 bits of the MD5 of ``id:seed``."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series, for k of 100 or more to the last digits of a double."""
    return k * F.log(k) - k + F.log(2 * math.pi * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k)


def poisson_quantile(u: Column, rate: Column, most: Column) -> Column:
    """Smallest k with u < P(X <= k); a mass is the one before times rate / k.

    A large rate starts 12 deviations + 30 below it, with a mass taken in logs: exp(-rate) loses its digits beyond a rate of
    about 708 and is 0 beyond 745, and less than 1e-30 of the distribution lies below.
    """
    far = rate - 12 * F.sqrt(rate) - 30
    least = F.when(far >= 100, F.floor(far)).otherwise(F.lit(0)).cast("int")
    mass = F.when(far >= 100, F.exp(least * F.log(rate) - rate - log_factorial(least.cast("double")))).otherwise(F.exp(-rate))
    start = F.struct(mass.alias("mass"), mass.alias("below"), least.alias("k"))

    def step(s: Column, k: Column) -> Column:
        mass = s["mass"] * rate / k
        return F.struct(mass.alias("mass"), (s["below"] + mass).alias("below"), (s["k"] + (u >= s["below"]).cast("int")).alias("k"))

    return F.aggregate(F.sequence(least + 1, most), start, step, lambda s: s["k"])


def source_rates(docs: DataFrame, key: Column, weights: dict[str | None, float] | None, epochs: float) -> DataFrame:
    """``mix_key, rate, most``: rate is weight / (sum of weights) * epochs * rows / rows of the source."""
    counts = docs.groupBy(key.alias("mix_key")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        named = F.create_map(*[F.lit(x) for k, w in weights.items() for x in ("" if k is None else f"s{k}", float(w))])
        weighed = counts.withColumn("weight", F.coalesce(named[F.col("mix_key")], F.lit(0.0)))
    whole = weighed.agg(F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.count("*").alias("sources")).first()
    rate = F.col("weight") / F.lit(whole.weight or 1.0) * F.lit(float((whole.rows or 0) * epochs)) / F.col("rows")
    # Beyond rate + 12 deviations + 30 less than 1e-15 of the distribution is left.
    rates = weighed.select("mix_key", rate.alias("rate")).withColumn("most", F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))
    return F.broadcast(rates) if whole.sources <= BROADCAST_SOURCES else rates


def hashable(docs: DataFrame, names: list[str]) -> list[Column]:
    """The columns that can be hashed: maps can't."""
    return [F.col(c) for c in names if "map<" not in docs.schema[c].dataType.simpleString()]


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with ``copy_no`` from 1, in shuffled order.

    ``weights`` maps a source to its target weight; None gives all sources the same.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit(""))
    names = [c for c in docs.columns if c != "copy_no"]
    own, rate, most, n, place = free_names(docs, "mix_key", "rate", "most", "copies", "place")
    rates = source_rates(docs, key, weights, epochs)
    rates = rates.withColumnsRenamed({"mix_key": own, "rate": rate, "most": most})
    drawn = docs.withColumn(own, key).join(rates, own)
    copies = poisson_quantile(uniform(F.col(id_col), seed), F.col(rate), F.col(most))
    counted = drawn.withColumn(n, copies).where(F.col(n) > 0)
    dealt = counted.select(*names, F.explode(F.sequence(F.lit(1), F.col(n))).alias("copy_no"))
    # All that a row holds takes part, so that rows without an id, or of one id, are spread as well.
    spread = dealt.withColumn(place, F.xxhash64(*hashable(docs, names), F.col("copy_no"), F.lit(seed)))
    return spread.repartition(place).sortWithinPartitions(place).drop(place)
