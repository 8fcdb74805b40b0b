"""Mixing sources to target weights by Poisson replication, with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, join_keyed, unit_hash

SEED, ALPHA = 13, 0.5
#: exp(-rate) is far from the smallest double up to this rate.
MOST_RATE = 500.0


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float | None = None) -> DataFrame:
    """Mean repetition rate of each source: total * target share / rows.

    ``weights`` gives target weights by source name (sources not named get none); without it the target of a source is
    its row count to the power ``alpha``. ``total`` is the expected size of the mix, by default that of the input.
    Null sources are one source of their own, named by null.
    """
    n = docs.groupBy(F.col(source_col).alias(P + "source")).agg(F.count(F.lit(1)).alias(P + "n"))
    if weights is None:
        want = F.pow(F.col(P + "n").cast("double"), F.lit(float(alpha)))
    else:
        want = F.lit(0.0)
        for name, w in weights.items():
            if w < 0:
                raise ValueError("weights must not be negative")
            want = F.when(F.col(P + "source") == F.lit(name), F.lit(float(w))).otherwise(want)
    n = n.withColumn(P + "want", want)
    sums = n.agg(F.sum(P + "want").alias(P + "all"), F.sum(P + "n").alias(P + "rows"))
    expected = F.col(P + "rows").cast("double") if total is None else F.lit(float(total))
    share = F.when(F.col(P + "all") > 0, F.col(P + "want") / F.col(P + "all")).otherwise(F.lit(0.0))
    return n.join(F.broadcast(sums)).select(P + "source", (expected * share / F.col(P + "n")).alias(P + "rate"))  # sums is one row


def _walk(u: Column, rate: Column) -> Column:
    """The inverse of the Poisson distribution at u: how many of the cumulative probabilities lie at or below it.

    The number of steps is the rate plus ten deviations and 20, beyond which less than 1e-15 of the mass lies.
    """
    steps = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), steps),
        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cum"), F.when(u >= F.exp(-rate), 1).otherwise(0).cast("bigint").alias("n")),
        lambda s, k: F.struct(
            (s["p"] * rate / k).alias("p"),
            (s["cum"] + s["p"] * rate / k).alias("cum"),
            (s["n"] + F.when(u >= s["cum"] + s["p"] * rate / k, 1).otherwise(0)).cast("bigint").alias("n"),
        ),
        lambda s: s["n"],
    )


def poisson_count(seed: Column, ident: Column, rate: Column) -> Column:
    """A Poisson number with mean ``rate``, from numbers hashed from seed and ident.

    A sum of independent Poisson numbers is one with the sum of their means: the rate is cut into equal parts of at most
    MOST_RATE, each inverted at a number of its own, so that exp() never vanishes and the distribution holds at any rate.
    The work is proportional to the rate, as is the number of copies.
    """
    parts = F.greatest(F.ceil(rate / MOST_RATE), F.lit(1)).cast("int")
    first = _walk(unit_hash(seed, ident), rate / parts)
    more = F.aggregate(F.sequence(F.lit(1), parts - 1), F.lit(0).cast("bigint"), lambda n, k: n + _walk(unit_hash(seed, F.lit("part"), ident, k), rate / parts))
    return F.when(rate > 0, F.when(parts > 1, first + more).otherwise(first)).otherwise(F.lit(0)).cast("bigint")


def poisson_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str, float] | None = None,
    alpha: float = ALPHA,
    total: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Repeat each row by a Poisson count with its source's mean rate, and shuffle all copies globally.

    The count of a row inverts the Poisson distribution at a number hashed from seed and id (several for a rate above
    MOST_RATE), so a run repeats exactly and needs no state. Returns the input's columns, ``copy`` (0, 1, ...) and ``shuffle_key``: rows are dealt
    to partitions by the key and sorted by it within each. Rows whose count is 0 go. Rows that repeat an id get the same
    count; a null id hashes as the empty text. Empty input gives an empty result. Input columns named copy or
    shuffle_key are replaced.
    """
    rates = source_rates(docs, source_col, weights, alpha, total)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    drawn = join_keyed(docs.withColumn(P + "source", F.col(source_col)), rates, P + "source", "inner")
    n = poisson_count(F.lit(seed), ident, F.col(P + "rate"))
    drawn = drawn.withColumn(P + "n", n).where(F.col(P + "n") > 0)
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    copies = drawn.select(*kept, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(P + "n") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), ident, F.col("copy")).cast("binary")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
