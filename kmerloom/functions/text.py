"""Column functions on masked superstrings and run metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(base: Column, on: Column) -> Column:
    return F.when(on, F.upper(base)).otherwise(F.lower(base))


def mask_bits(ms: Column) -> Column:
    return F.translate(ms, "acgtACGT", "00001111")


def letters(ms: Column) -> Column:
    return F.upper(ms)


def infer_k(ms: Column) -> Column:
    """Trailing lower-case letters + 1, which is the whole length + 1 where no letter is upper case."""
    return F.length(ms) - F.length(F.rtrim(ms, F.lit("acgt"))) + 1


def objective(length: Column, runs: Column) -> Column:
    """Entropy-like size of superstring plus mask, in bits. A superstring without runs has its length only, the limit of few runs."""
    bits = length + F.when(runs == 0, F.lit(0.0)).otherwise(runs * (F.lit(1.0) + F.log2(length / F.nullif(runs, F.lit(0)))))
    return F.lit(2) * F.floor(bits).cast("long")


def objective_simple(length: Column, runs: Column) -> Column:
    return length + runs * F.log2(length)


def implied_penalty(length: Column, runs: Column) -> Column:
    return F.lit(3.0) + F.log2(length / runs)


def kmer_masked(kmer: Column, n: Column) -> Column:
    """First base upper case, the next n-1 lower case."""
    return F.concat(F.left(kmer, F.lit(1)), F.lower(F.substring(kmer, F.lit(2), n - 1)))


def text_to_dna(text: Column, separators: bool = False) -> Column:
    """Project any text to nucleotides, one base per hex digit of its UTF-8 bytes."""
    target = "NCGTACGTACGTACGT" if separators else "ACGTACGTACGTACGT"
    return F.translate(F.hex(text), "0123456789ABCDEF", target)
