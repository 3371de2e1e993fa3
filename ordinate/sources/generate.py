"""Generators of rows of long columns c0, c1, ... and ``tid``.

Values are hashes of the row number and a seed: the same for any layout, and
made without a shuffle. A seed of None is drawn once, when a generator is
called, so that the DataFrame returned gives the same rows each time it runs.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns' domains in the increasing-range table.
INCREASING_DOMAINS = (1, 2, 4, 8, 16, 32, 64, 100)


def _seeded(seed: int | None) -> int:
    return random.SystemRandom().getrandbits(31) if seed is None or seed < 0 else seed


def draw(row: Column, column: int, seed: int) -> Column:
    """64 bits for a row and a column."""
    return F.xxhash64(row, F.lit(column), F.lit(seed))


def _uniform(row: Column, column: int, domain: int, seed: int) -> Column:
    return F.pmod(draw(row, column, seed), F.lit(domain)) if domain > 1 else F.lit(0).cast("long")


def _rows(spark: SparkSession, n: int, columns: Sequence[Column], first_tid: int = 0) -> DataFrame:
    base = spark.range(n)
    return base.select(*(c.cast("long").alias(f"c{i}") for i, c in enumerate(columns)), (F.col("id") + first_tid).alias("tid"))


def with_domains(spark: SparkSession, n: int, domains: Sequence[int], seed: int | None = None) -> DataFrame:
    """Each column uniform in [0, domain); domains of 0 or 1 give 0. tid from 1."""
    seed = _seeded(seed)
    return _rows(spark, n, [_uniform(F.col("id"), i, d, seed) for i, d in enumerate(domains)], 1)


def with_upper(spark: SparkSession, n: int, upper: int, arity: int, prefix: int = 0, seed: int | None = None) -> DataFrame:
    """``prefix`` columns of 0, the others uniform in [0, upper)."""
    return with_domains(spark, n, [0] * prefix + [upper] * (arity - prefix), seed)


def increasing_ranges(spark: SparkSession, n: int, seed: int | None = None) -> DataFrame:
    """Columns with domains of 1, 2, 4, ... 64, 100. tid from 0."""
    seed = _seeded(seed)
    return _rows(spark, n, [_uniform(F.col("id"), i, d, seed) for i, d in enumerate(INCREASING_DOMAINS)])


def with_bits(spark: SparkSession, n: int, bits: Sequence[int], seed: int | None = None) -> DataFrame:
    """One 64-bit draw a row, sliced into columns of so many bits from the low
    end; columns beyond the 64th bit are 0."""
    seed, at, columns = _seeded(seed), 0, []
    word = draw(F.col("id"), 0, seed)
    for b in bits:
        if at >= 64 or b == 0:
            columns.append(F.lit(0))
        else:
            width = min(b, 64 - at, 63)
            columns.append(F.shiftrightunsigned(word, at).bitwiseAND(F.lit((1 << width) - 1)))
        at += b
    return _rows(spark, n, columns)


def with_bits_below(spark: SparkSession, n: int, upper: int, arity: int, prefix: int = 0, seed: int | None = None) -> DataFrame:
    """``prefix`` columns of 0, then columns of log2(upper) bits."""
    return with_bits(spark, n, [0] * prefix + [upper.bit_length() - 1] * (arity - prefix), seed)


def _scattered(number: Column, size: int, seed: int) -> Column:
    """A bijection of [0, size): multiplication by a unit, and a shift."""
    from math import gcd

    rng = random.Random(seed)
    factor = rng.randrange(1, max(2, size)) | 1
    while gcd(factor, size) != 1:
        factor += 2
    # decimals: the product may need more than 64 bits
    wide = number.cast("decimal(38,0)") * F.lit(factor).cast("decimal(19,0)") + F.lit(rng.randrange(size)).cast("decimal(19,0)")
    return F.pmod(wide, F.lit(size).cast("decimal(19,0)")).cast("long")


def unique_rows(spark: SparkSession, n: int, domains: Sequence[int], arity: int | None = None, seed: int | None = None) -> DataFrame:
    """Rows that differ on the first ``arity`` columns: a permuted row number
    read in mixed radix. Raises if the domains hold fewer than ``n`` rows."""
    seed = _seeded(seed)
    arity = len(domains) if arity is None else arity
    space = 1
    for d in domains[:arity]:
        space *= max(1, d)
    if space < n:
        raise ValueError(f"{space} different rows at most, {n} asked for")
    return _rows(spark, n, [*_digits(F.col("id"), domains[:arity], min(space, 1 << 62), seed), *(_uniform(F.col("id"), i, d, seed) for i, d in enumerate(domains[arity:], arity))])


def _digits(number: Column, domains: Sequence[int], space: int, seed: int) -> list[Column]:
    rest, out = _scattered(number, space, seed), []
    for d in domains:
        d = max(1, d)
        out.append(F.pmod(rest, F.lit(d)))
        rest = F.call_function("div", rest, F.lit(d))
    return out


def duplicates(spark: SparkSession, n: int, bits: int, times: int, arity: int, prefix: int = 0, seed: int | None = None) -> DataFrame:
    """n rows, exactly ceil(n / times) different on ``arity`` columns of ``bits``
    bits after ``prefix`` columns of 0: every ``times``-th row is the next new
    one, the others repeat one met before."""
    seed = _seeded(seed)
    different = -(-n // times)
    domains = [1] * prefix + [1 << bits] * (arity - prefix)
    space = (1 << bits) ** (arity - prefix)
    if space < different:
        raise ValueError(f"{space} different rows at most, {different} asked for")
    turn = F.call_function("div", F.col("id"), F.lit(times))
    source = F.when(F.col("id") % times == 0, turn).otherwise(F.pmod(draw(F.col("id"), 0, seed), turn + 1))
    return _rows(spark, n, _digits(source, domains, min(space, 1 << 62), seed))


def domain_for(n: int, distinct: int) -> int:
    """The domain U for which n uniform draws give about ``distinct`` values:
    U (1 - (1 - 1 / U) ** n) grows with U, so it is found by halving."""
    if not 0 < distinct <= n:
        raise ValueError("between 1 and n distinct values can be had")
    low, high = distinct, max(distinct + 1, 2 * n * n)
    while low < high:
        middle = (low + high) // 2
        if middle * (1 - (1 - 1 / middle) ** n) < distinct - 0.5:
            low = middle + 1
        else:
            high = middle
    return low


def about_distinct(spark: SparkSession, n: int, distinct: int, columns: int, seed: int | None = None) -> DataFrame:
    """n rows of which about ``distinct`` differ, over ``columns`` columns."""
    seed = _seeded(seed)
    domain = domain_for(n, distinct)
    side = max(1, round(domain ** (1 / columns)))
    while side**columns < domain:
        side += 1
    return _rows(spark, n, _digits(_uniform(F.col("id"), 0, domain, seed), [side] * columns, side**columns, seed))


def segments(spark: SparkSession, n: int, domains: tuple[int, int, int], widths: tuple[int, int, int], seed: int | None = None) -> DataFrame:
    """A counts up over ``domains[0]`` equal segments in the last of its columns,
    B and C are uniform in the last of theirs; the others are 0."""
    seed, columns = _seeded(seed), []
    a = F.call_function("div", F.col("id") * domains[0], F.lit(max(1, n)))
    for which, (domain, width) in enumerate(zip(domains, widths)):
        last = a if which == 0 else _uniform(F.col("id"), which, domain, seed)
        columns += [F.lit(0)] * (width - 1) + [last]
    return _rows(spark, n, columns)
