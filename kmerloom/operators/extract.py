"""k-mer extraction: sequences (rec LONG, seq STRING) to windows and k-mer sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.kmers import PACKED_MAX_K, codec, decode

CHUNK = 1024  # windows per chunk of a long sequence
_SLICE = 256  # chunks handled by one vectorised step
MINIMIZER = 15  # letters of the word that names the bin of a k-mer
STRETCH_LETTERS = 2 * PACKED_MAX_K  # letters of a stretch of windows at most
BIN_WINDOWS = 4_000_000  # windows that a task of the second step is meant to take
FIRST_WINDOWS = 2_000_000  # windows that a task takes, which holds them in arrays
_ROWS = 1 << 16  # rows of a batch that a task hands on

_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def chunks(seqs: DataFrame, k: int) -> DataFrame:
    """(rec, off, piece): each window of seq lies in exactly one piece.

    The slices are taken from BINARY, where they cost their own length and not
    the distance from the start of the sequence.
    """
    raw = seqs.select("rec", F.col("seq").cast("binary").alias("raw")).where(F.length("raw") >= k)
    offs = raw.withColumn("off", F.explode(F.sequence(F.lit(0), F.length("raw") - k, F.lit(CHUNK))))
    return offs.select(
        "rec", F.col("off").cast("long"), F.substring("raw", F.col("off") + 1, F.lit(CHUNK + k - 1)).alias("piece")
    )


def _pack(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed forward and reverse-complement word starting at each index (doubling)."""
    base = codes.astype(np.int64) & 3
    comp = 3 - base
    fwd, rev, n = base, comp, 1
    for bit in bin(k)[3:]:
        m = len(fwd) - n
        fwd = (fwd[:m] << (2 * n)) | fwd[n : n + m]
        rev = rev[:m] | (rev[n : n + m] << (2 * n))
        n *= 2
        if bit == "1":
            m = len(fwd) - 1
            fwd = (fwd[:m] << 2) | base[n : n + m]
            rev = rev[:m] | (comp[n : n + m] << (2 * n))
            n += 1
    return fwd, rev


def word_sizes(k: int) -> list[int]:
    """Letters of the LONG words that hold a k-mer, first letters first: all words are full but the last."""
    return [PACKED_MAX_K] * (k // PACKED_MAX_K) + ([k % PACKED_MAX_K] if k % PACKED_MAX_K else [])


def _words(codes: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The words of the forward and of the reverse-complement k-mer starting at each index."""
    n, sizes = len(codes) - k + 1, word_sizes(k)
    packs, at = {size: _pack(codes, size) for size in set(sizes)}, 0
    fwd, rev = [], []
    for size in sizes:
        fwd.append(packs[size][0][at : at + n])
        rev.append(packs[size][1][k - at - size : k - at - size + n])
        at += size
    return fwd, rev


def _before(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether k-mer a sorts before k-mer b, index by index."""
    if len(a) == 1:
        return a[0] < b[0]
    out, tie = np.zeros(len(a[0]), bool), np.ones(len(a[0]), bool)
    for x, y in zip(a, b, strict=True):
        out |= tie & (x < y)
        tie &= x == y
    return out


def _counted(words: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct k-mers of a slice and how often each occurs, as columns."""
    if len(words) == 1:
        return list(np.unique(words[0], return_counts=True))
    order = np.lexsort(words[::-1])
    words = [w[order] for w in words]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([w[1:] != w[:-1] for w in words])
    first = np.flatnonzero(new)
    return [*[w[first] for w in words], np.diff(np.append(first, len(order)))]


def _scan(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """Per slice of chunks: rec, 1-based position, forward, reverse words, starts-upper flag."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _SLICE):
            part = batch.slice(lo, _SLICE)
            rec, off = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            pieces = part.column(2).to_pylist()
            lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
            data = np.frombuffer(b"".join(pieces), np.uint8)
            if len(data) < k:
                continue
            codes = _CODE[data]
            ends = np.cumsum(lens)
            bad = np.concatenate([[0], np.cumsum(codes == 4)])
            m = len(data) - k + 1
            at = np.arange(m)
            ok = np.flatnonzero((bad[k:] == bad[:m]) & (np.repeat(ends, lens)[:m] - at >= k))
            if not len(ok):
                continue
            fwd, rev = _words(codes, k)
            row = np.repeat(np.arange(len(pieces)), lens)[ok]
            pos = off[row] + ok - (ends - lens)[row] + 1
            yield rec[row], pos, [w[ok] for w in fwd], [w[ok] for w in rev], data[ok] < 97


def word_names(k: int) -> list[str]:
    return [f"w{i}" for i in range(len(word_sizes(k)))]


def from_words(k: int) -> Column:
    """The k-mer in codec form from its words: packed k-mers are their only word."""
    names = word_names(k)
    return F.col(names[0]) if len(names) == 1 else F.concat(*[decode(F.col(n), size) for n, size in zip(names, word_sizes(k), strict=True)])


def word_windows(seqs: DataFrame, k: int, canonical_form: bool = False) -> DataFrame:
    """``windows`` with the k-mer as LONG words w0, w1, ..., whose order is that of the k-mers, for any k."""
    pieces = seqs if "piece" in seqs.columns else chunks(seqs, k)
    names = word_names(k)

    def run(batches):
        for rec, pos, fwd, rev, up in _scan(batches, k):
            flip = _before(rev, fwd) if canonical_form else np.zeros(len(pos), bool)
            words = [np.where(flip, r, f) for f, r in zip(fwd, rev, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rec, pos, *words, flip, up)], ["rec", "pos", *names, "rev", "up"])

    pieces = pieces.select("rec", "off", F.col("piece").cast("binary"))
    return pieces.mapInArrow(run, f"rec long, pos long, {', '.join(f'{n} long' for n in names)}, rev boolean, up boolean")


def windows(seqs: DataFrame, k: int, canonical_form: bool = False) -> DataFrame:
    """All valid windows (rec, pos, kmer, rev, up): pos is 1-based, ``rev`` tells that the
    canonical form is the reverse strand, ``up`` that the first letter is upper case.

    Accepts sequences (rec, seq) or their chunks (rec, off, piece)."""
    return word_windows(seqs, k, canonical_form).select("rec", "pos", from_words(k).alias("kmer"), "rev", "up")


def in_bins(k: int) -> bool:
    """Whether k-mers of this length go by stretches: shorter ones repeat so often that each is sent once anyway."""
    return MINIMIZER + 8 <= k <= STRETCH_LETTERS - 15


def _hashed(words: np.ndarray) -> np.ndarray:
    x = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _minimizers(codes: np.ndarray, k: int, both: bool) -> np.ndarray:
    """Least hash of the short words in the window at each index, of either strand with ``both``."""
    fwd, rev = _pack(codes, MINIMIZER)
    low = _hashed(np.minimum(fwd, rev) if both else fwd)
    span, n = k - MINIMIZER + 1, 1
    while n < span:
        step = min(n, span - n)
        low = np.minimum(low[: len(low) - step], low[step:])
        n += step
    return low


def _kept(words: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Words of 31 letters with all but the first ``letters`` of them cleared."""
    gone = 2 * (PACKED_MAX_K - np.clip(letters, 0, PACKED_MAX_K))
    return (words >> gone) << gone


def _stretches(batches: Iterator[pa.RecordBatch], k: int, both: bool, case_sensitive: bool, placed: bool, once: bool = False) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring windows with one minimizer: their letters, which windows count, and how often or where they occur."""
    most = min(STRETCH_LETTERS - k, PACKED_MAX_K) + 1
    for batch in batches:
        for lo in range(0, batch.num_rows, _SLICE):
            part = batch.slice(lo, _SLICE)
            rec, off = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            pieces = part.column(2).to_pylist()
            lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
            data = np.frombuffer(b"".join(pieces), np.uint8)
            if len(data) < k:
                continue
            codes, ends = _CODE[data], np.cumsum(lens)
            bad = np.concatenate([[0], np.cumsum(codes == 4)])
            m = len(data) - k + 1
            at = np.arange(m)
            ok = (bad[k:] == bad[:m]) & (np.repeat(ends, lens)[:m] - at >= k)
            if not ok.any():
                continue
            low = _minimizers(codes, k, both)
            new = ok.copy()
            new[1:] &= ~ok[:-1] | (low[1:] != low[:-1])
            start = at[new]
            length = np.diff(np.append(np.flatnonzero(new[ok]), ok.sum()))
            # runs are cut where their letters would not fit
            parts = -(-length // most)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start = np.repeat(start, parts) + inner * most
            length = np.minimum(np.repeat(length, parts) - inner * most, most)
            used = (np.int64(1) << length) - 1
            if case_sensitive:
                up = np.concatenate([data < 97, np.zeros(most, bool)])
                used[:] = 0
                for i in range(int(length.max())):
                    used |= ((i < length) & up[start + i]).astype(np.int64) << i
                if not placed:
                    some = used != 0
                    start, length, used = start[some], length[some], used[some]
            letters = length + (k - 1)
            fwd, _ = _pack(np.concatenate([codes, np.zeros(STRETCH_LETTERS, np.uint8)]), PACKED_MAX_K)
            f0, f1 = _kept(fwd[start], letters), _kept(fwd[start + PACKED_MAX_K], letters - PACKED_MAX_K)
            bins = (low[start] >> np.uint64(33)).astype(np.int32)
            if placed:
                row = np.repeat(np.arange(len(pieces)), lens)[start]
                told = [rec[row], off[row] + start - (ends - lens)[row] + 1]
                if once:
                    order = np.lexsort([told[1], told[0], length, f1, f0])
                    first = np.ones(len(order), bool)
                    first[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (f0, f1, length)])
                    bins, f0, f1, length, used, *told = (x[order[first]] for x in (bins, f0, f1, length, used, *told))
            else:
                order = np.lexsort([used, length, f1, f0])
                first = np.ones(len(order), bool)
                first[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (f0, f1, length, used)])
                first = np.flatnonzero(first)
                told = [np.diff(np.append(first, len(order)))]
                bins, f0, f1, length, used = (x[order[first]] for x in (bins, f0, f1, length, used))
            columns = [bins, f0, f1, length.astype(np.int32), used, *told]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bin", "f0", "f1", "windows", "used", *(["rec", "pos"] if placed else ["n"])])


def stretches(seqs: DataFrame, k: int, canonical_form: bool = False, case_sensitive: bool = False, placed: bool = False, once: bool = False) -> DataFrame:
    """(bin, f0, f1, windows, used, n): neighbouring windows with one minimizer, their letters in two words, a bit for each
    window that counts (with ``case_sensitive`` those that start upper case), and how often. With ``placed`` every occurrence has
    a row, and rec and pos instead of n; with ``once`` only the first of equal stretches of a slice. Equal k-mers have equal
    bins. Neighbours mostly share their minimizer, so some bytes are sent for a k-mer instead of a row.
    """
    pieces = seqs if "piece" in seqs.columns else chunks(seqs, k)
    told = "rec long, pos long" if placed else "n long"
    pieces = pieces.select("rec", "off", F.col("piece").cast("binary").alias("piece"))
    return pieces.mapInArrow(lambda b: _stretches(b, k, canonical_form, case_sensitive, placed, once), f"bin int, f0 long, f1 long, windows int, used long, {told}")


def _reversed(words: np.ndarray, size: int) -> np.ndarray:
    """Reverse complements of packed words of ``size`` letters."""
    x = ~words
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        x = ((x >> np.uint64(bits)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(bits))
    return x >> np.uint64(64 - 2 * size)


def _shifted(high: np.ndarray, low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of two words from letter ``at`` on, again in two words."""
    up, full = (2 * at).astype(np.uint64), np.uint64(4**PACKED_MAX_K - 1)
    return ((high << up) & full) | (low >> (np.uint64(2 * PACKED_MAX_K) - up)), (low << up) & full


def _first_runs(batches: Iterator[pa.RecordBatch], k: int, both: bool) -> Iterator[pa.RecordBatch]:
    """Placed stretches of whole bins -> runs of windows that show a k-mer for the first time."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    f0, f1, length, rec, pos = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("f0", "f1", "windows", "rec", "pos"))
    del held
    order = np.lexsort([pos, rec])
    f0, f1, length, rec, pos = f0[order].view(np.uint64), f1[order].view(np.uint64), length[order].astype(np.int64), rec[order], pos[order]
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    more = k - PACKED_MAX_K
    high, low = _shifted(f0[row], f1[row], at)
    words = [high >> np.uint64(max(0, -2 * more))] + ([low >> np.uint64(2 * (PACKED_MAX_K - more))] if more > 0 else [])
    del high, low
    if both:
        back = [_reversed(w, size) for w, size in zip(words, word_sizes(k), strict=True)]
        if more > 0:
            rest = np.uint64(2 * more)
            back = [(back[1] << np.uint64(2 * (PACKED_MAX_K - more))) | (back[0] >> rest), back[0] & np.uint64(4**more - 1)]
        flip = _before(back, words)
        words = [np.where(flip, b, w) for b, w in zip(back, words, strict=True)]
        del back, flip
    # windows are in the order of their places, which a stable sort by k-mer keeps among equal ones
    order = np.argsort(words[0], kind="stable") if len(words) == 1 else np.lexsort(words[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([w[order][1:] != w[order][:-1] for w in words])
    on = np.zeros(len(order), bool)
    on[order[new]] = True
    del words, order, new
    start = on.copy()
    start[1:] &= ~on[:-1] | (at[1:] == 0)
    size = np.diff(np.append(np.flatnonzero(start[on]), on.sum()))
    row, at = row[start], at[start]
    high, low = _shifted(f0[row], f1[row], at)
    letters = size + (k - 1)
    columns = [rec[row], pos[row] + at, size, _kept(high.view(np.int64), letters), _kept(low.view(np.int64), letters - PACKED_MAX_K)]
    for lo in range(0, len(row), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + _ROWS]) for c in columns], ["rec", "pos", "windows", "f0", "f1"])


def first_runs(seqs: DataFrame, k: int, canonical_form: bool = False) -> DataFrame:
    """(rec, pos, windows, f0, f1): runs of neighbouring windows that show a k-mer for the first time in the order of (rec, pos),
    and their letters in two words, for k that go by bins. Stretches are sent to their bins, where the first place of each k-mer is found; a run lies in one chunk."""
    sent = stretches(seqs, k, canonical_form, placed=True, once=True).select("bin", "f0", "f1", "windows", "rec", "pos")
    sent = sent.repartition(bin_tasks(seqs, FIRST_WINDOWS), "bin")
    return sent.mapInArrow(lambda b: _first_runs(b, k, canonical_form), "rec long, pos long, windows long, f0 long, f1 long")


def run_text(k: int) -> Column:
    """The letters of a run of ``first_runs``."""
    return F.left(F.concat(decode(F.col("f0"), PACKED_MAX_K), decode(F.col("f1"), PACKED_MAX_K)), (F.col("windows") + (k - 1)).cast("int"))


def runs_of_ones(seqs: DataFrame, k: int) -> DataFrame:
    """(rec, pos, windows, text, edge): runs of windows that start upper case, per chunk, with their letters in upper
    case; ``edge`` tells that a run may go on in another chunk."""
    pieces = seqs if "piece" in seqs.columns else chunks(seqs, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _SLICE):
                part = batch.slice(lo, _SLICE)
                rec, off = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                pieces = part.column(2).to_pylist()
                lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
                joined = b"".join(pieces)
                data = np.frombuffer(joined, np.uint8)
                if len(data) < k:
                    continue
                ends, m = np.cumsum(lens), len(data) - k + 1
                bad = np.concatenate([[0], np.cumsum(_CODE[data] == 4)])
                left = (np.repeat(ends, lens)[:m] - np.arange(m)) - k  # windows of the piece that follow
                on = (bad[k:] == bad[:m]) & (left >= 0) & (data[:m] < 97)
                row = np.repeat(np.arange(len(pieces)), lens)[:m]
                new = on.copy()
                new[1:] &= ~on[:-1] | (row[1:] != row[:-1])
                start = np.flatnonzero(new)
                if not len(start):
                    continue
                length = np.diff(np.append(np.flatnonzero(new[on]), on.sum()))
                of, at = row[start], off[row[start]] + start - (ends - lens)[row[start]]
                edge = (start == (ends - lens)[of]) & (off[of] > 0) | (left[start + length - 1] == 0)
                upper = joined.upper()
                text = [upper[a:b].decode() for a, b in zip(start.tolist(), (start + length + k - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rec[of], at + 1, length, text, edge)], ["rec", "pos", "windows", "text", "edge"])

    pieces = pieces.select("rec", "off", F.col("piece").cast("binary").alias("piece"))
    return pieces.mapInArrow(run, "rec long, pos long, windows long, text string, edge boolean")


def _word_at(high: Column, low: Column, at: Column, skip: int, size: int) -> Column:
    """``size`` letters from letter ``skip + at`` on of a stretch held in two words; ``at`` is at most 31."""
    word = F.call_function("shiftleft", low if skip else high, 2 * at).bitwiseAND(F.lit(4**PACKED_MAX_K - 1))
    if not skip:
        word = word.bitwiseOR(F.call_function("shiftrightunsigned", low, 2 * PACKED_MAX_K - 2 * at))
    return F.shiftrightunsigned(word, 2 * (PACKED_MAX_K - size))


def _word_before(high: Column, low: Column, after: Column, size: int) -> Column:
    """The ``size`` letters that ``after`` letters of two words follow; ``after`` is at most 31."""
    word = F.call_function("shiftrightunsigned", low, 2 * after).bitwiseOR(F.call_function("shiftleft", high, 2 * PACKED_MAX_K - 2 * after))
    return word.bitwiseAND(F.lit(4**size - 1))


def bin_tasks(seqs: DataFrame, windows: int = BIN_WINDOWS) -> int:
    """Tasks for the bins of some sequences: as many as Spark is set to, more for more than ``windows`` windows in a task."""
    size = F.length("seq") if "seq" in seqs.columns else F.least(F.length("piece"), F.lit(CHUNK))
    total = int(seqs.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0)
    return max(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // windows))


def unrolled(rows: DataFrame, k: int, canonical_form: bool = False, used_only: bool = True) -> DataFrame:
    """``stretches`` to one row per window that counts, in place: the k-mer's words and ``at``, its place in the stretch.

    Without ``used_only`` all windows have a row.
    """
    names, sizes = word_names(k), word_sizes(k)
    skips, at = [sum(sizes[:i]) for i in range(len(sizes))], F.col("at")
    kept = [c for c in rows.columns if c not in ("r0", "r1")]
    if canonical_form:
        # the letters of both words complemented and reversed, in steps that are projections of their own
        rows = rows.withColumns({"r0": F.bitwise_not("f1"), "r1": F.bitwise_not("f0")})
        for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
            swapped = lambda c: F.shiftrightunsigned(c, bits).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(F.col(c).bitwiseAND(F.lit(mask)), bits))  # noqa: B023, E731
            rows = rows.withColumns({c: swapped(c) for c in ("r0", "r1")})
        rows = rows.withColumns({c: F.shiftrightunsigned(c, 2) for c in ("r0", "r1")})
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("at"))
    if used_only:
        rows = rows.where(F.call_function("shiftright", F.col("used"), at).bitwiseAND(F.lit(1)) == 1)
    fwd = [_word_at(F.col("f0"), F.col("f1"), at, skip, size) for skip, size in zip(skips, sizes, strict=True)]
    if not canonical_form:
        return rows.select(*kept, "at", *[w.alias(n) for w, n in zip(fwd, names, strict=True)])
    rev = [_word_before(F.col("r0"), F.col("r1"), at + F.lit(k - skip - size), size) for skip, size in zip(skips, sizes, strict=True)]
    if len(sizes) == 1:
        return rows.select(*kept, "at", F.least(fwd[0], rev[0]).alias(names[0]))
    rows = rows.select(*kept, "at", *[w.alias(f"a{i}") for i, w in enumerate(fwd)], *[w.alias(f"b{i}") for i, w in enumerate(rev)])
    flip = (F.col("b0") < F.col("a0")) | ((F.col("b0") == F.col("a0")) & (F.col("b1") < F.col("a1")))
    return rows.select(*kept, "at", *[F.when(flip, F.col(f"b{i}")).otherwise(F.col(f"a{i}")).alias(n) for i, n in enumerate(names)])


def binned_counts(seqs: DataFrame, k: int, canonical_form: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(bin, words, n): how often each k-mer occurs. Bins lie in one partition each, where k-mers are counted without a further exchange."""
    sent = stretches(seqs, k, canonical_form, case_sensitive).repartition(bin_tasks(seqs), "bin")
    return unrolled(sent, k, canonical_form).groupBy("bin", *word_names(k)).agg(F.sum("n").alias("n"))


def binned_sides(a: DataFrame, b: DataFrame, k: int, canonical_form: bool = False, case_sensitive: tuple[bool, bool] = (False, False)) -> DataFrame:
    """(kmer, l, r): how often each k-mer occurs in either of two tables of sequences; 0 where it does not."""
    none, n = F.lit(0).cast("long"), F.col("n")
    sides = [stretches(x, k, canonical_form, cased) for x, cased in zip((a, b), case_sensitive, strict=True)]
    told = [side.withColumns({"l": left, "r": right}).drop("n") for side, left, right in zip(sides, (n, none), (none, n), strict=True)]
    sent = told[0].unionByName(told[1]).repartition(bin_tasks(a) + bin_tasks(b), "bin")
    met = unrolled(sent, k, canonical_form).groupBy("bin", *word_names(k)).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return met.select(from_words(k).alias("kmer"), "l", "r")


def kmer_counts(seqs: DataFrame, k: int, canonical_form: bool = False, case_sensitive: bool = False) -> DataFrame:
    """(kmer, n): how often each k-mer occurs; ``case_sensitive`` counts only windows
    that start with an upper-case letter, which decodes a masked superstring. Long k-mers are
    counted as LONG words and become text once each."""
    if in_bins(k):
        return binned_counts(seqs, k, canonical_form, case_sensitive).select(from_words(k).alias("kmer"), "n")
    pieces = seqs if "piece" in seqs.columns else chunks(seqs, k)
    names = word_names(k)

    def run(batches):
        for _, _, fwd, rev, up in _scan(batches, k):
            if canonical_form and len(fwd) == 1:
                words = [np.minimum(fwd[0], rev[0])]
            elif canonical_form:
                flip = _before(rev, fwd)
                words = [np.where(flip, r, f) for f, r in zip(fwd, rev, strict=True)]
            else:
                words = fwd
            columns = _counted([w[up] for w in words] if case_sensitive else words)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], [*names, "n"])

    partial = pieces.select("rec", "off", F.col("piece").cast("binary")).mapInArrow(run, f"{', '.join(f'{n} long' for n in names)}, n long")
    return partial.groupBy(*names).agg(F.sum("n").alias("n")).select(from_words(k).alias("kmer"), "n")


def kmers(seqs: DataFrame, k: int, canonical_form: bool = False, case_sensitive: bool = False) -> DataFrame:
    """The distinct k-mers as one column ``kmer`` (packed for k <= 31)."""
    return kmer_counts(seqs, k, canonical_form, case_sensitive).select("kmer")


def binned_kmers(seqs: DataFrame, k: int, canonical_form: bool = False, case_sensitive: bool = False) -> DataFrame:
    """``kmers`` with the column ``bin`` where they go by bins, in whose partitions they lie."""
    if not in_bins(k):
        return kmers(seqs, k, canonical_form, case_sensitive)
    return binned_counts(seqs, k, canonical_form, case_sensitive).select("bin", from_words(k).alias("kmer"))


def decoded(df: DataFrame, k: int) -> DataFrame:
    """Same rows with ``kmer`` as text."""
    return df.withColumn("kmer", codec(k).to_text(F.col("kmer"), k))


def canonical_set(df: DataFrame, k: int) -> DataFrame:
    """Any k-mer set reduced to one representative per complement pair."""
    x = F.col("kmer")
    return df.select(F.least(x, codec(k).rc(x, k)).alias("kmer")).distinct()


def both_strands(df: DataFrame, k: int) -> DataFrame:
    x = F.col("kmer")
    return df.select(F.explode(F.array(x, codec(k).rc(x, k))).alias("kmer")).distinct()


def distinct_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_distinct"))


def count_stats(counts: DataFrame) -> DataFrame:
    """Unique (seen once), distinct, total and largest count of a (kmer, n) table."""
    return counts.agg(
        F.count_if(F.col("n") == 1).alias("n_unique"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("n").alias("n_total"),
        F.max("n").alias("max_count"),
    )


def histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("n_kmers"))


def canonical_key(df: DataFrame, k: int) -> DataFrame:
    x = F.col("kmer")
    return df.withColumn("canon", F.least(x, codec(k).rc(x, k)))


def contained(probe: DataFrame, kmer_set: DataFrame, k: int) -> DataFrame:
    """Rows of probe whose k-mer is in the set in either strand."""
    keys = canonical_key(kmer_set, k).select("canon").distinct()
    return canonical_key(probe, k).join(keys, "canon", "left_semi").drop("canon")


def erased(kmer_set: DataFrame, gone: DataFrame, k: int) -> DataFrame:
    """The set without the k-mers (either strand) of ``gone``."""
    keys = canonical_key(gone, k).select("canon").distinct()
    return canonical_key(kmer_set, k).join(keys, "canon", "left_anti").drop("canon")


def set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of both sets, their union, and whether they are equal."""
    one = a.select("kmer", F.lit(1).alias("a"), F.lit(0).alias("b"))
    two = b.select("kmer", F.lit(0).alias("a"), F.lit(1).alias("b"))
    return _sizes(one.unionByName(two).groupBy("kmer").agg(F.max("a").alias("a"), F.max("b").alias("b")))


def same_kmers(seqs: DataFrame, ms: DataFrame, k: int, complements: bool) -> DataFrame:
    """``set_equality`` of the k-mers of some sequences and those that a masked superstring stands for."""
    if not in_bins(k):
        return set_equality(kmers(seqs, k, complements), kmers(ms, k, complements, case_sensitive=True))
    both = binned_sides(seqs, ms, k, complements, (False, True))
    return _sizes(both.select(F.least("l", F.lit(1)).alias("a"), F.least("r", F.lit(1)).alias("b")))


def _sizes(both: DataFrame) -> DataFrame:
    return both.agg(
        F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), F.count(F.lit(1)).alias("n_union"),
        F.sum(F.col("a") * F.col("b")).alias("n_both"),
    ).withColumn("equal", (F.col("n_left") == F.col("n_union")) & (F.col("n_right") == F.col("n_union")))
