"""Exact whole numbers beyond 64 bits out of built-in long arithmetic: residues modulo several primes, put together again.

A number is known by its residues modulo primes below 2**31, whose product exceeds it. Sums and products of residues
stay below 2**62. Mixed radix digits (Garner's method) turn residues into decimal text, eight digits at a time.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimal digits that one long of a large number holds: times a digit below 2**31, and summed over 40 primes, it stays below 2**63.
LIMB = 8
_BASE = 10**LIMB


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in itertools.chain((2,), range(3, math.isqrt(n) + 1, 2)))


@functools.lru_cache
def primes(bits: float) -> tuple[int, ...]:
    """The largest primes below 2**31, as many as numbers of that many bits need; at most 40 (1,239 bits)."""
    found: list[int] = []
    n, have = 2**31 - 1, 0.0
    while have <= bits:
        if len(found) == 40:
            raise ValueError(f"numbers of {bits:.0f} bits need more than 40 primes")
        if _is_prime(n):
            found.append(n)
            have += math.log2(n)
        n -= 2
    return tuple(found)


def modulus(moduli: tuple[int, ...]) -> Column:
    """An array of the moduli with their places, (i, p), to be exploded."""
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).cast("long").alias("p")) for i, p in enumerate(moduli)))


def inverse(k: int, p: Column, moduli: tuple[int, ...]) -> Column:
    """The inverse of the small number k modulo p, which is one of the moduli."""
    out = F.lit(None).cast("long")
    for q in moduli:
        out = F.when(p == q, F.lit(pow(k, -1, q)).cast("long")).otherwise(out)
    return out


def times(a: Column, b: Column, p: Column) -> Column:
    return a * b % p


def choose(n: Column, b: int, p: Column, moduli: tuple[int, ...]) -> Column:
    """n over b modulo p, for a residue n of a number that is not negative; b is less than every modulus."""
    if b == 0:
        return F.lit(1).cast("long")
    out = functools.reduce(lambda x, i: times(x, F.pmod(n - i, p), p), range(1, b), n)
    return out if b == 1 else times(out, inverse(math.factorial(b), p, moduli), p)


def polynomial_product(a: list[Column], b: list[Column], p: Column) -> list[Column]:
    """The first coefficients of a product, modulo p."""
    return [functools.reduce(lambda x, y: x + y, (times(a[i], b[n - i], p) for i in range(n + 1))) % p for n in range(len(a))]


def elementary(sums: dict[int, list[str]], p: Column, moduli: tuple[int, ...], rows: DataFrame, prefix: str = "e") -> DataFrame:
    """``rows`` with the coefficients of the elementary symmetric polynomials, in columns ``e{k}_{b}``.

    ``sums[j]`` names the columns with the coefficients of the j-th power sum. By Newton's identities k e_k is the
    alternating sum of e_(k-i) times the i-th power sum; each k is a projection of its own, so that expressions stay small.
    """
    width = len(sums[1])
    e = {0: [F.lit(int(b == 0)).cast("long") for b in range(width)]}
    for k in sorted(sums):
        parts = [[x if i % 2 else F.pmod(-x, p) for x in polynomial_product(e[k - i], [F.col(c) for c in sums[i]], p)] for i in range(1, k + 1)]
        whole = [functools.reduce(lambda x, y: x + y, (q[b] for q in parts)) % p for b in range(width)]
        rows = rows.withColumns({f"{prefix}{k}_{b}": times(x, inverse(k, p, moduli), p) for b, x in enumerate(whole)})
        e[k] = [F.col(f"{prefix}{k}_{b}") for b in range(width)]
    return rows


def _carried(limbs: Column) -> Column:
    """Decimal text of limbs, lowest first, each any long below 2**62."""
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text"))

    def step(s: Column, x: Column) -> Column:
        whole = x + s["carry"]
        digits = F.lpad((whole % _BASE).cast("string"), LIMB, "0")
        return F.struct(F.call_function("div", whole, F.lit(_BASE)).alias("carry"), F.concat(digits, s["text"]).alias("text"))

    done = F.aggregate(limbs, start, step, lambda s: F.concat(s["carry"].cast("string"), s["text"]))
    return F.regexp_replace(done, "^0+(?=.)", "")


def text_of(residues: Column, moduli: tuple[int, ...], rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: the number, as decimal text, whose residues modulo the primes are given as an array in their order."""
    keep = rows.columns
    digits: list[Column] = []
    for i, q in enumerate(moduli):
        # What the digits before make, and the weight of this one, modulo q.
        rest, weight = F.lit(0).cast("long"), 1
        for v, before in zip(digits, moduli):
            rest = (rest + v * F.lit(weight)) % q
            weight = weight * before % q
        value = times(F.pmod(residues[i] - rest, F.lit(q)), F.lit(pow(weight, -1, q)), F.lit(q))
        rows = rows.withColumn(f"__digit{i}", value)
        digits.append(F.col(f"__digit{i}"))
    weights = list(itertools.accumulate(moduli[:-1], lambda x, y: x * y, initial=1))
    count = len(str(math.prod(moduli))) // LIMB + 1
    limb = lambda w, n: w // _BASE**n % _BASE
    limbs = F.array(*(functools.reduce(lambda x, y: x + y, (v * F.lit(limb(w, n)).cast("long") for v, w in zip(digits, weights))) for n in range(count)))
    return rows.withColumn(name, _carried(limbs)).select(*dict.fromkeys([*keep, name]))


def sum_texts(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """(keys, name): exact sums of whole numbers that are given as decimal text, null ones left out; as text.

    Eight digits at a time are summed by group and place, combined before the shuffle; a group has as many rows as its longest number has places.
    """
    size = F.ceil(F.length(column) / LIMB).cast("int")
    padded = F.lpad(column, size * LIMB, "0")
    places = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(padded, (size - 1 - i) * LIMB + 1, F.lit(LIMB)).cast("long"))
    each = rows.where(F.col(column).isNotNull()).select(*keys, F.posexplode(places).alias("__place", "__limb"))
    sums = each.groupBy(*keys, "__place").agg(F.sum("__limb").alias("__limb"))
    # The place above the highest of a shorter number is absent, never one in between.
    lists = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__place", "__limb"))).alias("__limbs"))
    return lists.select(*keys, _carried(F.transform("__limbs", lambda x: x["__limb"])).alias(name))
