"""Deterministic samples, splits and resampling weights."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged
from .ranking import ordinal_positions


def unit_hash(*parts: Column, digits: int = 7) -> Column:
    """A number in [0, 1) from the SHA-256 of the parts, which any engine can repeat."""
    text = F.concat_ws("|", *parts)
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("long") / F.lit(float(16**digits))


def quotas(strata: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """strata: keys and n. Adds quota: whole shares, and the rest by largest remainder, ties by key.

    One row a stratum passes through the window. A budget over the total gives every stratum its size.
    """
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    rows = strata.withColumn("_t", total).withColumn("_b", F.least(F.lit(budget).cast("long"), F.col("_t")))
    rows = rows.withColumn("_whole", F.floor(F.col("n") * F.col("_b") / F.col("_t"))).withColumn("_rest", F.col("n") * F.col("_b") % F.col("_t"))
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), *keys))
    left = F.col("_b") - F.sum("_whole").over(every)
    return rows.withColumn("quota", F.col("_whole") + F.when(place <= left, 1).otherwise(0)).drop("_t", "_b", "_whole", "_rest")


def systematic(rows: DataFrame, keys: list[str], order: list[str], quota: DataFrame) -> DataFrame:
    """Evenly spread rows of each stratum: the places floor((2 j + 1) n / (2 q)) for j = 0..q-1."""
    placed = ordinal_positions(rows, keys, [F.col(c) for c in order], "_k", "_total").drop("_total")
    j = F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("j")
    picks = quota.where(F.col("quota") > 0).select(*keys, "n", "quota", j)
    picks = picks.select(*keys, F.floor((2 * F.col("j") + 1) * F.col("n") / (2 * F.col("quota"))).alias("_p"))
    on = [placed[k].eqNullSafe(picks[k]) for k in keys] + [placed["_k"] == picks["_p"]]
    return placed.join(picks, on, "left_semi").drop("_k")


#: Up to which number a Poisson(1) count is 0, 1, ... 5; beyond, it is 6.
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(6)]


def poisson_weight(u: Column) -> Column:
    """A Poisson(1) count by inversion of a uniform number, up to 6."""
    out = F.lit(len(_POISSON))
    for k in reversed(range(len(_POISSON))):
        out = F.when(u < _POISSON[k], F.lit(k)).otherwise(out)
    return out


#: Replicates whose weights come from one digest: two numbers of seven hexadecimal digits each.
LANES = 4
#: Rows from which a cell's count is drawn at once, by a normal inversion with its first correction, instead of row by row.
LARGE = 30


def resampled(cells: DataFrame, by: list[str], key: Column, n: str, sums: dict[str, Column], first: int, last: int, namespace: str = "boot") -> DataFrame:
    """by, b from first to last - 1, size (rows that replicate b draws) and each sum over the rows drawn.

    A cell stands for ``n`` rows that are alike in all of ``sums``, which give the value of one row; ``key`` is its name, unique within ``by``. How often
    its rows are drawn is a Poisson count of mean n. A digest serves LANES replicates, and replicates are only ever multiplied with cells, inside an aggregate by
    replicate that combines before it shuffles: rows never multiply.
    """
    unit = F.explode(F.when(F.col(n) < LARGE, F.sequence(F.lit(1), F.col(n).cast("int"))).otherwise(F.array(F.lit(0)))).alias("_unit")
    block = F.explode(F.sequence(F.lit(first // LANES), F.lit((last - 1) // LANES))).alias("_block")
    # cells may be few and come in one partition, while their replicates are many
    units = cells.select(*by, F.col(n).alias("_n"), key.alias("_key"), *[c.alias(f"_v_{k}") for k, c in sums.items()], unit)
    units = units.repartition(cells.sparkSession.sparkContext.defaultParallelism, *by, "_key", "_unit").select("*", block)
    digest = F.sha2(F.concat_ws("|", F.lit(namespace), F.col("_block").cast("string"), "_key", F.col("_unit").cast("string")), 256)
    units = units.withColumn("_h", digest)

    def number(digits: Column) -> Column:
        return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(16**7)

    # columns of their own, as each is used more than once; single rows need no number, as digits compare as they are
    digits = lambda k: F.substring("_h", 7 * k + 1, 7)
    units = units.select("*", *[digits(2 * j).alias(f"_d{j}") for j in range(LANES)])
    normal = lambda j: F.sqrt(-2 * F.log(number(F.col(f"_d{j}")))) * F.cos(2 * F.pi() * number(digits(2 * j + 1)))
    units = units.select("*", *[F.when(F.col("_unit") == 0, normal(j)).alias(f"_z{j}") for j in range(LANES)])

    def drawn(j: int) -> Column:
        z = F.col(f"_z{j}")
        many = F.floor(F.col("_n") + F.sqrt(F.col("_n").cast("double")) * z + (z * z - 1) / 6 + 0.5)
        one = F.lit(len(_POISSON)).cast("long")
        for k in reversed(range(len(_POISSON))):
            one = F.when(F.col(f"_d{j}") < f"{math.ceil(_POISSON[k] * 16**7 - 0.5):07x}", F.lit(k).cast("long")).otherwise(one)
        return F.when(F.col("_unit") > 0, one).otherwise(F.greatest(many, F.lit(0).cast("long")))

    weighed = units.select(*by, "_block", *[f"_v_{k}" for k in sums], *[drawn(j).alias(f"_w{j}") for j in range(LANES)])
    added = [a for j in range(LANES) for a in (F.sum(f"_w{j}").alias(f"size{j}"), *[F.sum(F.col(f"_w{j}") * F.col(f"_v_{k}")).alias(f"{k}{j}") for k in sums])]
    blocks = weighed.groupBy(*by, "_block").agg(*added)
    lanes = F.inline(F.array(*[F.struct((F.col("_block") * LANES + j).alias("b"), F.col(f"size{j}").alias("size"), *[F.col(f"{k}{j}").alias(k) for k in sums]) for j in range(LANES)]))
    return blocks.select(*by, lanes).where((F.col("b") >= first) & (F.col("b") < last))


def redrawn(draw: Callable[[int, int], DataFrame], valid: Column, replicates: int, rounds: int = 20) -> DataFrame:
    """The first ``replicates`` valid draws in order of b; draw(first, last) makes those of a range.

    Draws that aren't valid are thrown away and others taken, up to ``rounds`` times the replicates; with still too few, those found are all there is.
    """
    kept = staged(draw(0, replicates).where(valid), "draws")
    missing = replicates - kept.count()
    for k in range(1, rounds):
        if missing <= 0:
            break
        more = staged(draw(k * replicates, (k + 1) * replicates).where(valid).orderBy("b").limit(missing), "draws")
        missing -= more.count()
        kept = kept.unionByName(more)
    return kept
