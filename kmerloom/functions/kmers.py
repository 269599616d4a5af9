"""Column functions on k-mers.

A k-mer column is either packed (``LONG``, two bits per base, k <= 31) or text
(``STRING``, any k).  Both orders are lexicographic, so ``min``/``least``/sorting
mean the same thing in either form.  ``codec(k)`` picks the form; operators only
talk to the codec.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKED_MAX_K = 31


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def checked_complement(base: Column) -> Column:
    """Complement of one upper-case base; anything else fails the job."""
    return F.when(base.isin(*"ACGT"), F.translate(base, "ACGT", "TGCA")).otherwise(
        F.raise_error(F.concat(F.lit("not a nucleotide: "), base))
    )


def canonical(s: Column) -> Column:
    return F.least(s, reverse_complement(s))


def base_code(base: Column) -> Column:
    """A, C, G, T in either case give 0..3, everything else -1."""
    return F.when(F.length(base) == 1, F.instr(F.lit("ACGT"), F.upper(base)) - 1).otherwise(F.lit(-1))


def base_at(s: Column, i) -> Column:
    """0-based i-th base."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.substring(s, i + 1, F.lit(1))


def encode(s: Column) -> Column:
    """Two bits per base, most significant base first (k <= 31)."""
    return F.conv(F.translate(F.upper(s), "ACGT", "0123"), 4, 10).cast("long")


_BYTES = 0x0101010101010101
# factors and masks that spread eight letters of two bits over the bytes of a LONG
_SPREAD = (1 + (1 << 24), 0x000000FF000000FF), (1 + (1 << 12), 0x000F000F000F000F), (1 + (1 << 6), 0x0303030303030303)


def decode(x: Column, n: int) -> Column:
    """Eight letters at a time: A, C, G, T are 0, 2, 6 and 19 above A, which is 2, 6 and 11 for the low, the high and both bits."""
    if n == 0:
        return F.lit("")
    words = []
    for at in range(-(-n // 8) - 1, -1, -1):
        v = (F.shiftrightunsigned(x, 16 * at) if at else x).bitwiseAND(F.lit(0xFFFF))
        for times, mask in _SPREAD:
            v = (v * F.lit(times)).bitwiseAND(F.lit(mask))
        low, high = v.bitwiseAND(F.lit(_BYTES)), F.shiftrightunsigned(v, 1).bitwiseAND(F.lit(_BYTES))
        words.append(F.unhex(F.hex(F.lit(ord("A") * _BYTES) + low * 2 + high * 6 + low.bitwiseAND(high) * 11)))
    return F.right(F.concat(*words).cast("string"), F.lit(n))


_PLACES = 2**33


def place(rec: Column, pos: Column, rev: Column | None = None) -> Column:
    """(rec, pos, strand) as one DECIMAL that sorts in this order, for any LONG rec and pos below 2^32.

    A decimal, because its minimum stays a hash aggregate with map-side combine, which that of a struct is not.
    """
    low = pos.cast("long") * 2 if rev is None else pos.cast("long") * 2 + rev.cast("long")
    return (rec.cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(11,0)") + low.cast("decimal(11,0)")).cast("decimal(38,0)")


def unplace(x: Column) -> tuple[Column, Column, Column]:
    """(rec, pos, rev) of a ``place``."""
    low = F.pmod(x, F.lit(_PLACES).cast("decimal(11,0)")).cast("long")
    rec = ((x - low.cast("decimal(11,0)")) / F.lit(_PLACES).cast("decimal(11,0)")).cast("decimal(20,0)").cast("long")
    return rec, F.shiftright(low, 1), low.bitwiseAND(F.lit(1)) == 1


def drop_overlap(s: Column, overlap: int) -> Column:
    return F.substring(s, overlap + 1, 2**31 - 1)


def max_overlap(a: Column, b: Column, k: int) -> Column:
    """Longest d < k with the last d bases of a equal to the first d of b."""
    hits = F.filter(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda d: F.when(d == 0, F.lit(True)).otherwise(F.right(a, d) == F.left(b, d)),
    )
    return F.array_max(hits)


class Packed:
    """k-mers and shorter words as LONG."""

    sql_type = "long"

    def __init__(self, k: int):
        self.k = k

    def suffix(self, x: Column, d: int) -> Column:
        return x.bitwiseAND(F.lit(4**d - 1))

    def prefix(self, x: Column, n: int, d: int) -> Column:
        return F.shiftrightunsigned(x, 2 * (n - d))

    def suffix_at(self, x: Column, d: Column) -> Column:
        """``suffix`` with a column for d."""
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), 2 * d) - 1)

    def prefix_at(self, x: Column, n: int, d: Column) -> Column:
        """``prefix`` with a column for d."""
        return F.call_function("shiftrightunsigned", x, 2 * (F.lit(n) - d))

    def rc(self, x: Column, n: int) -> Column:
        if n == 0:
            return x
        # through base-4 digits: a shift-and-mask reversal doubles the expression per step,
        # which stalls the optimizer once it is nested
        digits = F.lpad(F.conv(x.cast("string"), 10, 4), n, "0")
        return F.conv(F.reverse(F.translate(digits, "0123", "3210")), 4, 10).cast("long")

    def append(self, x: Column, code: Column) -> Column:
        return F.shiftleft(x, 2).bitwiseOR(code.cast("long"))

    def to_text(self, x: Column, n: int) -> Column:
        return decode(x, n)

    def from_text(self, s: Column) -> Column:
        return encode(s)


class Text:
    """k-mers and shorter words as STRING."""

    sql_type = "string"

    def __init__(self, k: int):
        self.k = k

    def suffix(self, x: Column, d: int) -> Column:
        return F.right(x, F.lit(d)) if d else F.lit("")

    def prefix(self, x: Column, n: int, d: int) -> Column:
        return F.substring(x, 1, d)

    def suffix_at(self, x: Column, d: Column) -> Column:
        return F.right(x, d)

    def prefix_at(self, x: Column, n: int, d: Column) -> Column:
        return F.left(x, d)

    def rc(self, x: Column, n: int) -> Column:
        return reverse_complement(x)

    def append(self, x: Column, code: Column) -> Column:
        return F.concat(x, F.substring(F.lit("ACGT"), code + 1, F.lit(1)))

    def to_text(self, x: Column, n: int) -> Column:
        return x

    def from_text(self, s: Column) -> Column:
        return F.upper(s)


def codec(k: int) -> Packed | Text:
    if k < 1:
        raise ValueError("k must be positive")
    return Packed(k) if k <= PACKED_MAX_K else Text(k)
