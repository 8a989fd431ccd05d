"""Scalar building blocks: alphabets, thresholds, k-mer codes, probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# State letters in code order, and the order of amino acids in probability files.
DNA = "ACGT"
AMINO = "RHKDESTNQCGPAILMFWYV"
AMINO_FILE_ORDER = "ARNDCQEGHILKMFPSTWYV"
ALPHABETS = {"nucl": DNA, "amino": AMINO}
#: The longest k-mer whose code fits a signed 64-bit integer.
LONGEST = {"nucl": 31, "amino": 14}
GAP = "-"
#: Of the arithmetic hash; products stay within 64 bits.
_PRIME, _FACTOR = 2_147_483_629, 1_640_531_527


def score_threshold(omega: float, k: int, sigma: int) -> float:
    """The least probability of a kept k-mer, on the linear scale."""
    return (omega / sigma) ** k


def log_threshold(omega: float, k: int, sigma: int) -> float:
    return k * math.log10(omega / sigma)


def log_probability(p: Column) -> Column:
    """log10, minus infinity (not null) at zero."""
    return F.when(p > 0, F.log10(p)).otherwise(F.lit(float("-inf")))


def linear(score: Column) -> Column:
    return F.pow(F.lit(10.0), score)


def clamped(score: Column) -> Column:
    """The probability of a log score, at most 1."""
    return F.least(linear(score), F.lit(1.0))


def entropy_term(x: Column) -> Column:
    """-x log2 x, zero at zero."""
    return F.when(x > 0, -x * F.log2(x)).otherwise(F.lit(0.0))


def append_state(code: Column, state: Column, sigma: int) -> Column:
    return code * F.lit(sigma).cast("long") + state.cast("long")


def append_code(prefix: Column, suffix: Column, suffix_length: int, sigma: int) -> Column:
    return prefix * F.lit(sigma**suffix_length).cast("long") + suffix


def decode(code: Column, k: int, alphabet: str) -> Column:
    """The letters of a code, the most significant first."""
    sigma = len(alphabet)
    place = lambda i: (F.call_function("div", code, F.lit(sigma ** (k - 1 - i)).cast("long")) % sigma).cast("int")
    letters = [F.substring(F.lit(alphabet), place(i) + 1, F.lit(1)) for i in range(k)]
    return F.concat(*letters)


def batch_of(code: Column, batches: int = 32) -> Column:
    return F.pmod(code, F.lit(batches)).cast("int")


def uniform(code: Column, seed: int = 42) -> Column:
    """A repeatable number in [0, 1) for each code: two rounds of squares modulo a prime, in arithmetic that any engine has."""
    mixed = lambda x, add: (x * x + x * F.lit(_FACTOR) + F.lit(add)) % F.lit(_PRIME)
    x = (F.pmod(code, F.lit(_PRIME)) * F.lit(_FACTOR) + F.lit(seed)) % F.lit(_PRIME)
    return mixed(mixed(x, seed), 7).cast("double") / F.lit(float(_PRIME))


def hazen_quantile(values: Column, p: float) -> Column:
    """Quantile at place n*p - 1/2 of a sorted array, kept within it, linear between neighbours."""
    at = F.greatest(F.lit(0.0), F.least(F.size(values) * F.lit(p) - F.lit(0.5), (F.size(values) - 1).cast("double")))
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    a, b = F.get(values, low), F.get(values, high)
    return a + (b - a) * (at - low)
