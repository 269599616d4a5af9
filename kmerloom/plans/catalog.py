"""Registered queries over the given tables, each with the same question in plain SQL.

Text columns become nucleotides, one base per hex digit of the UTF-8 bytes.  ``SEP`` maps
digit 0 to N, so that every blank separates segments; ``CASED`` gives some digits lower
case, which makes every text a masked superstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions import kmers as K
from kmerloom.functions import text as T
from kmerloom.operators import bound, bounded, convert, extract, fragments, masks, overlaps, prefixes, results, superstrings, unitigs
from kmerloom.plans.runtime import cut
from kmerloom.streaming.superstring import streaming_superstring, superstring_lines

SEP = "NCGTACGTACGTACGT"
PLAIN = "ACGTACGTACGTACGT"
CASED = "ACgTacGTAcGTaCgt"
K0 = 11  # k of the set queries
KG = 31  # k of the constructors
KM = 31  # k of the mask queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TABLES = {
    "documents": ("doc_id", "text"),
    "benchmark": ("item_id", "text"),
    "pages": ("page_id", "html"),
    "conversations": ("conv_id * 2147483648 + turn", "text"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table spread over all cores; a scan that already has enough splits stays as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dna(spark: SparkSession, sf_dir: str, name: str, digits: str = SEP) -> DataFrame:
    rec, text = _TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.expr(rec).cast("long").alias("rec"), text)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df.select("rec", _letters(text, digits).alias("seq"))


def _letters(text: str, digits: str = SEP):
    return F.translate(F.hex(text), "0123456789ABCDEF", digits)


def seq_sql(name: str, digits: str = SEP) -> str:
    rec, text = _TABLES[name]
    return f"SELECT CAST({rec} AS BIGINT) AS rec, translate(hex({text}), '0123456789ABCDEF', '{digits}') AS seq FROM {name}"


def windows_sql(name: str, k: int, digits: str = SEP, tag: str = "w") -> str:
    """CTEs ending in ``<tag>(rec, pos, km, up, canon)``: all valid windows, sliced chunk by chunk."""
    return f"""{tag}_s AS ({seq_sql(name, digits)}),
{tag}_c AS (SELECT rec, o AS off, substr(seq, CAST(o + 1 AS BIGINT), {256 + k - 1}) AS piece
  FROM (SELECT rec, seq, unnest(range(0, length(seq) - {k} + 1, 256)) AS o FROM {tag}_s)),
{tag}_r AS (SELECT rec, off + i AS pos, substr(piece, CAST(i AS BIGINT), {k}) AS raw
  FROM (SELECT rec, off, piece, unnest(range(1, length(piece) - {k} + 2)) AS i FROM {tag}_c)),
{tag} AS (SELECT rec, pos, upper(raw) AS km, left(raw, 1) = upper(left(raw, 1)) AS up,
    least(upper(raw), reverse(translate(upper(raw), 'ACGT', 'TGCA'))) AS canon
  FROM {tag}_r WHERE NOT contains(raw, 'N'))"""


def rc_sql(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def kmer_set(spark, sf_dir, name="documents", k=K0, canonical=True, digits=SEP) -> DataFrame:
    return extract.kmers(dna(spark, sf_dir, name, digits), k, canonical)


# the set and what it is joined on are computed once, so that the plan of a join cannot go wrong
_FIXED = f"WITH {windows_sql('documents', K0)}, s AS MATERIALIZED (SELECT DISTINCT canon AS kmer FROM w)"
_SET = f"WITH {windows_sql('documents', K0)}, s AS (SELECT DISTINCT canon AS kmer FROM w)"
_FWD = f"WITH {windows_sql('documents', K0)}, s AS (SELECT DISTINCT km AS kmer FROM w)"


# ---- scans -----------------------------------------------------------------

_FASTA = "'>doc' || doc_id || ' ' || source || chr(10) || translate(hex(text), '0123456789ABCDEF', '" + SEP + "')"


@register("fasta_scan", f"""WITH t AS (SELECT doc_id, source, translate(hex(text), '0123456789ABCDEF', '{SEP}') AS seq FROM documents)
SELECT 'doc' || doc_id AS name, source AS comment, length(seq) AS n_bases,
  length(seq) - length(replace(seq, 'N', '')) AS n_separators, md5(seq) AS digest FROM t""")
def fasta_scan(spark, sf_dir):
    """The documents written as FASTA files to the shared folder and read again."""
    from kmerloom.plans.runtime import scratch_path
    from kmerloom.sources.fasta import read_fasta, write_fasta

    t = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
        F.col("source").alias("comment"),
        F.translate(F.hex("text"), "0123456789ABCDEF", SEP).alias("seq"),
    )
    path = scratch_path(spark)
    write_fasta(t, path, width=70)
    r = read_fasta(spark, path)
    return r.select(
        "name", "comment", F.length("seq").cast("long").alias("n_bases"),
        (F.length("seq") - F.length(F.replace("seq", F.lit("N")))).cast("long").alias("n_separators"), F.md5("seq").alias("digest"),
    )


@register("fastq_scan", f"""WITH t AS (SELECT doc_id, source, translate(hex(text), '0123456789ABCDEF', '{SEP}') AS seq FROM documents)
SELECT 'doc' || doc_id AS name, source AS comment, doc_id % 3 <> 0 AS fastq, length(seq) AS n_bases, md5(seq) AS digest FROM t""")
def fastq_scan(spark, sf_dir):
    """The documents written as FASTQ and FASTA records of wrapped lines, whose qualities look like headers, and read again."""
    from kmerloom.plans.runtime import delete, scratch_path
    from kmerloom.sources.records import read_records

    hexed, wrap = F.hex("text"), lambda x: F.regexp_replace(x, "(.{50})(?=.)", "$1\n")
    seq, quality = F.translate(hexed, "0123456789ABCDEF", SEP), F.translate(hexed, "0123456789ABCDEF", "@>+@>+@>+@>+IIII")
    head = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" "), F.col("source"), F.lit("\n"), wrap(seq))
    record = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(">"), head)).otherwise(F.concat(F.lit("@"), head, F.lit("\n+\n"), wrap(quality)))
    path = scratch_path(spark)
    table(spark, sf_dir, "documents").select(record.alias("value")).write.text(path)
    heads, body = read_records(spark, path)
    delete(spark, path)  # the records are in tables now
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "")
    r = heads.join(body.groupBy(F.col("part").alias("rec")).agg(joined.alias("seq")), "rec", "left").withColumn("seq", F.coalesce("seq", F.lit("")))
    return r.select("name", "comment", "fastq", F.length("seq").cast("long").alias("n_bases"), F.md5("seq").alias("digest"))


@register("seq_prefix", f"SELECT rec, left(seq, 1000) AS prefix FROM ({seq_sql('documents')})")
def seq_prefix(spark, sf_dir):
    return dna(spark, sf_dir, "documents").select("rec", F.left("seq", F.lit(1000)).alias("prefix"))


# ---- k-mer sets ------------------------------------------------------------


@register("kmer_distinct", f"{_FWD} SELECT kmer FROM s")
def kmer_distinct(spark, sf_dir):
    return extract.decoded(kmer_set(spark, sf_dir, canonical=False), K0)


@register("kmer_distinct_canonical", f"{_SET} SELECT kmer FROM s")
def kmer_distinct_canonical(spark, sf_dir):
    return extract.decoded(kmer_set(spark, sf_dir), K0)


@register("kmer_distinct_long", f"WITH {windows_sql('conversations', 41, PLAIN)} SELECT DISTINCT canon AS kmer FROM w")
def kmer_distinct_long(spark, sf_dir):
    """k > 31: text k-mers."""
    return kmer_set(spark, sf_dir, "conversations", 41, True, PLAIN)


@register("kmer_both_strands", f"{_SET} SELECT kmer FROM s UNION SELECT {rc_sql('kmer')} FROM s")
def kmer_both_strands(spark, sf_dir):
    return extract.decoded(extract.both_strands(kmer_set(spark, sf_dir), K0), K0)


@register("kmer_count_distinct", f"WITH {windows_sql('documents', 31, PLAIN)} SELECT count(DISTINCT canon) AS n_distinct FROM w")
def kmer_count_distinct(spark, sf_dir):
    return extract.distinct_count(kmer_set(spark, sf_dir, k=31, digits=PLAIN))


@register("kmer_approx_distinct", f"{_SET} SELECT count(*) AS n_distinct, TRUE AS close FROM s")
def kmer_approx_distinct(spark, sf_dir):
    """The exact number, and whether the sketch is within 5 % of it."""
    n = F.col("n_distinct")
    t = kmer_set(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_distinct"), F.approx_count_distinct("kmer", 0.02).alias("about"))
    return t.select("n_distinct", (F.abs(F.col("about") - n) <= 0.05 * n).alias("close"))


@register("kmer_stats", f"""WITH {windows_sql('documents', K0)}, c AS (SELECT canon, count(*) AS n FROM w GROUP BY 1)
SELECT count(*) FILTER (n = 1) AS n_unique, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS n_total, max(n) AS max_count FROM c""")
def kmer_stats(spark, sf_dir):
    return extract.count_stats(extract.kmer_counts(dna(spark, sf_dir, "documents"), K0, True))


@register("kmer_histogram", f"""WITH {windows_sql('documents', K0)}, c AS (SELECT canon, count(*) AS n FROM w GROUP BY 1)
SELECT n, count(*) AS n_kmers FROM c GROUP BY n""")
def kmer_histogram(spark, sf_dir):
    return extract.histogram(extract.kmer_counts(dna(spark, sf_dir, "documents"), K0, True))


@register("kmer_complement_filter", f"{_FWD} SELECT DISTINCT least(kmer, {rc_sql('kmer')}) AS kmer FROM s")
def kmer_complement_filter(spark, sf_dir):
    return extract.decoded(extract.canonical_set(kmer_set(spark, sf_dir, canonical=False), K0), K0)


@register("complement_pairs", f"""WITH {windows_sql('documents', K0)}, s AS MATERIALIZED (SELECT DISTINCT km AS kmer FROM w),
r AS MATERIALIZED (SELECT kmer, {rc_sql('kmer')} AS rc FROM s), j AS (SELECT r.kmer, s.kmer AS rc FROM r JOIN s ON s.kmer = r.rc)
SELECT kmer, rc FROM j WHERE kmer <= rc""")
def complement_pairs(spark, sf_dir):
    p = overlaps.complement_pairs(cut(kmer_set(spark, sf_dir, canonical=False)), K0)
    return p.select(K.decode(F.col("kmer"), K0).alias("kmer"), K.decode(F.col("rc"), K0).alias("rc"))


@register("palindromes", f"WITH {windows_sql('documents', 8)} SELECT km AS kmer, count(*) AS n FROM w WHERE km = {rc_sql('km')} GROUP BY 1")
def palindromes(spark, sf_dir):
    c = extract.kmer_counts(dna(spark, sf_dir, "documents"), 8)
    return extract.decoded(c.where(F.col("kmer") == K.codec(8).rc(F.col("kmer"), 8)), 8)


# ---- scalar functions over every k-mer -------------------------------------


@register("kmer_encode", f"""{_SET} SELECT kmer, list_sum(list_transform(range(1, {K0 + 1}),
  lambda i: (instr('ACGT', substr(kmer, i, 1)) - 1) * CAST(pow(4, {K0} - i) AS BIGINT)))::BIGINT AS code FROM s""")
def kmer_encode(spark, sf_dir):
    t = extract.decoded(kmer_set(spark, sf_dir), K0)
    return t.withColumn("code", K.encode(F.col("kmer")))


@register("kmer_decode", f"{_SET} SELECT kmer, {rc_sql('kmer')} AS rc FROM s")
def kmer_decode(spark, sf_dir):
    t = kmer_set(spark, sf_dir)
    return t.select(K.decode(F.col("kmer"), K0).alias("kmer"), K.decode(K.codec(K0).rc(F.col("kmer"), K0), K0).alias("rc"))


@register("nucleotide_at", f"""{_SET} SELECT i, substr(kmer, i + 1, 1) AS base, instr('ACGT', substr(kmer, i + 1, 1)) - 1 AS code, count(*) AS n
FROM (SELECT kmer, unnest(range(0, {K0})) AS i FROM s) GROUP BY ALL""")
def nucleotide_at(spark, sf_dir):
    t = extract.decoded(kmer_set(spark, sf_dir), K0).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(K0 - 1))))
    t = t.withColumn("base", K.base_at(F.col("kmer"), F.col("i")))
    return t.groupBy(F.col("i").cast("long").alias("i"), "base", K.base_code(F.col("base")).cast("long").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@register("prefix_suffix", f"{_SET} SELECT kmer, left(kmer, 4) AS head, right(kmer, 3) AS tail, substr(kmer, 5) AS rest FROM s")
def prefix_suffix(spark, sf_dir):
    c, x = K.codec(K0), F.col("kmer")
    t = kmer_set(spark, sf_dir).select(
        c.to_text(x, K0).alias("kmer"), K.decode(c.prefix(x, K0, 4), 4).alias("head"), K.decode(c.suffix(x, 3), 3).alias("tail")
    )
    return t.withColumn("rest", K.drop_overlap(F.col("kmer"), 4))


@register("max_overlap", f"""{_SET} SELECT kmer, {rc_sql('kmer')} AS rc, list_max(list_filter(range(0, {K0}),
  lambda d: right(kmer, d) = left({rc_sql('kmer')}, d))) AS overlap FROM s""")
def max_overlap(spark, sf_dir):
    t = extract.decoded(kmer_set(spark, sf_dir), K0).withColumn("rc", K.reverse_complement(F.col("kmer")))
    return t.withColumn("overlap", K.max_overlap(F.col("kmer"), F.col("rc"), K0).cast("long"))


# ---- membership and set operations -----------------------------------------

_TWO = f"WITH {windows_sql('documents', K0)}, {windows_sql('benchmark', K0, SEP, 'v')}, a AS (SELECT DISTINCT canon AS kmer FROM w), b AS (SELECT DISTINCT canon AS kmer FROM v)"


def _two(spark, sf_dir):
    return kmer_set(spark, sf_dir), kmer_set(spark, sf_dir, "benchmark")


@register("kmer_contains_semi", f"{_TWO} SELECT kmer FROM a WHERE kmer IN (SELECT kmer FROM b)")
def kmer_contains_semi(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return extract.decoded(extract.contained(a, b, K0), K0)


@register("kmer_erase_anti", f"{_TWO} SELECT kmer FROM a WHERE kmer NOT IN (SELECT kmer FROM b)")
def kmer_erase_anti(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return extract.decoded(extract.erased(a, b, K0), K0)


@register("set_union", f"{_TWO} SELECT kmer FROM a UNION SELECT kmer FROM b")
def set_union(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return extract.decoded(a.union(b).distinct(), K0)


@register("set_intersect", f"{_TWO} SELECT kmer FROM a INTERSECT SELECT kmer FROM b")
def set_intersect(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return extract.decoded(a.intersect(b), K0)


@register("set_except", f"{_TWO} SELECT kmer FROM b EXCEPT SELECT kmer FROM a")
def set_except(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return extract.decoded(b.exceptAll(a), K0)


# ---- overlap joins ---------------------------------------------------------


def _overlap_sql(d):
    return f"""{_FIXED}, a AS MATERIALIZED (SELECT kmer AS src, right(kmer, {d}) AS w FROM s), b AS MATERIALIZED (SELECT kmer AS dst, left(kmer, {d}) AS w FROM s),
j AS (SELECT src, dst FROM a JOIN b USING (w)) SELECT src, dst, {d} AS overlap FROM j WHERE src <> dst"""


def _pairs_text(p):
    return p.select(K.decode(F.col("src"), K0).alias("src"), K.decode(F.col("dst"), K0).alias("dst"), F.col("overlap"))


@register("overlap_join_k1", _overlap_sql(K0 - 1))
def overlap_join_k1(spark, sf_dir):
    return _pairs_text(overlaps.overlap_pairs(cut(kmer_set(spark, sf_dir)), K0, K0 - 1))


@register("overlap_join_d", _overlap_sql(K0 - 3))
def overlap_join_d(spark, sf_dir):
    return _pairs_text(overlaps.overlap_pairs(cut(kmer_set(spark, sf_dir)), K0, K0 - 3))


_DEPTHS = f"unnest(range(1, {K0})) AS d"


@register("best_overlap_per_kmer", f"""{_SET}, h0 AS (SELECT kmer, {_DEPTHS} FROM s),
h AS (SELECT d, left(kmer, d) AS w, min(kmer, 2) AS few FROM h0 GROUP BY 1, 2),
j AS (SELECT h0.kmer AS src, h0.d, CASE WHEN few[1] <> h0.kmer THEN few[1] ELSE few[2] END AS dst
  FROM h0 JOIN h ON h.d = h0.d AND h.w = right(h0.kmer, h0.d))
SELECT src, arg_max(dst, d) AS dst, max(d) AS overlap FROM j WHERE dst IS NOT NULL GROUP BY src""")
def best_overlap_per_kmer(spark, sf_dir):
    b = overlaps.best_overlaps(cut(kmer_set(spark, sf_dir)), K0)
    return _pairs_text(b.withColumn("overlap", F.col("overlap").cast("long")))


def _failure_sql(k: int, name: str, digits: str) -> str:
    """One join of the set with its own prefixes per depth."""
    joins = " ".join(f"LEFT JOIN (SELECT DISTINCT left(kmer, {d}) AS w FROM s) p{d} ON p{d}.w = right(s.kmer, {d})" for d in range(1, k))
    depth = " ".join(f"WHEN p{d}.w IS NOT NULL THEN {d}" for d in range(k - 1, 0, -1))
    return f"WITH {windows_sql(name, k, digits)}, s AS MATERIALIZED (SELECT DISTINCT canon AS kmer FROM w) SELECT s.kmer, CAST(CASE {depth} ELSE 0 END AS BIGINT) AS depth FROM s {joins}"


@register("failure_links", _failure_sql(K0, "documents", SEP))
def failure_links(spark, sf_dir):
    return extract.decoded(overlaps.failure_links(cut(kmer_set(spark, sf_dir)), K0), K0).withColumn("depth", F.col("depth").cast("long"))


@register("failure_links_31", _failure_sql(KG, "benchmark", PLAIN))
def failure_links_31(spark, sf_dir):
    kmers = kmer_set(spark, sf_dir, "benchmark", KG, digits=PLAIN)
    return extract.decoded(overlaps.failure_links(cut(kmers), KG), KG).withColumn("depth", F.col("depth").cast("long"))


@register("prefix_probe", f"""{_TWO}, p AS (SELECT DISTINCT kmer, 4 + 2 * (instr('ACGT', left(kmer, 1)) - 1) AS d FROM b), """
          + ", ".join(f"q{d} AS (SELECT DISTINCT right(kmer, {d}) AS word FROM p WHERE d = {d})" for d in (4, 6, 8, 10)) + " "
          + " UNION ALL ".join(f"SELECT left(kmer, {d}) AS word, CAST({d} AS BIGINT) AS d, count(*) AS n, min(kmer) AS first, max(kmer) AS last FROM a JOIN q{d} ON q{d}.word = left(kmer, {d}) GROUP BY 1"
                               for d in (4, 6, 8, 10)))
def prefix_probe(spark, sf_dir):
    """Suffixes of four lengths of the benchmark's k-mers looked up together among those of the documents."""
    a, b = _two(spark, sf_dir)
    c, x = K.codec(K0), F.col("kmer")
    d = (4 + 2 * c.prefix(x, K0, 1)).cast("int")
    words = b.select(c.suffix_at(x, d).alias("word"), d.alias("d"))
    r = prefixes.probe(words, cut(a), K0)
    word = F.when(F.col("d") == 4, K.decode(F.col("word"), 4)).when(F.col("d") == 6, K.decode(F.col("word"), 6)).when(F.col("d") == 8, K.decode(F.col("word"), 8)).otherwise(K.decode(F.col("word"), 10))
    return r.select(word.alias("word"), F.col("d").cast("long").alias("d"), "n", K.decode(F.col("first"), K0).alias("first"), K.decode(F.col("last"), K0).alias("last"))


@register("prefix_lookup", f"""{_TWO} SELECT left(kmer, 6) AS word, count(*) AS n, min(kmer) AS first, max(kmer) AS last FROM a
WHERE left(kmer, 6) IN (SELECT right(kmer, 6) FROM b) GROUP BY 1""")
def prefix_lookup(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    r = overlaps.prefix_ranges(b.select(K.codec(K0).suffix(F.col("kmer"), 6).alias("word")), a, K0, 6)
    return r.select(
        K.decode(F.col("word"), 6).alias("word"), "n", K.decode(F.col("first"), K0).alias("first"), K.decode(F.col("last"), K0).alias("last")
    )


def _extension_sql(want, have):
    return f"{_SET}, t AS (SELECT {have}(kmer, {K0 - 2}) AS w, min(kmer) AS target FROM s GROUP BY 1) SELECT s.kmer, t.target FROM s JOIN t ON t.w = {want}(s.kmer, {K0 - 2})"


def _extension(spark, sf_dir, side):
    e = overlaps.extensions(cut(kmer_set(spark, sf_dir)), K0, 2, side)
    return e.select(K.decode(F.col("kmer"), K0).alias("kmer"), K.decode(F.col("target"), K0).alias("target"))


@register("right_extension", _extension_sql("right", "left"))
def right_extension(spark, sf_dir):
    return _extension(spark, sf_dir, "right")


@register("left_extension", _extension_sql("left", "right"))
def left_extension(spark, sf_dir):
    return _extension(spark, sf_dir, "left")


@register("partial_presort", f"""WITH {windows_sql('documents', K0)}, f AS (SELECT canon AS kmer, min(rec * 4294967296 + pos) AS idx FROM w GROUP BY 1)
SELECT kmer, left(kmer, 4) AS bucket, row_number() OVER (PARTITION BY left(kmer, 4) ORDER BY idx) AS place FROM f""")
def partial_presort(spark, sf_dir):
    """Place of each k-mer inside its four-letter bucket, in input order."""
    w = extract.windows(dna(spark, sf_dir, "documents"), K0, True)
    f = w.groupBy("kmer").agg(F.min(K.place(F.col("rec"), F.col("pos"))).alias("idx"))
    s = overlaps.presorted(f, K0, "idx")
    return s.select(K.decode(F.col("kmer"), K0).alias("kmer"), K.decode(F.col("bucket"), 4).alias("bucket"), F.col("place").cast("long").alias("place"))


@register("kmer_sorted", f"{_SET} SELECT kmer, lag(kmer) OVER (ORDER BY kmer) AS previous FROM s")
def kmer_sorted(spark, sf_dir):
    """The sorted set, each k-mer with its predecessor."""
    t = overlaps.with_previous(kmer_set(spark, sf_dir))
    return t.select(K.decode(F.col("kmer"), K0).alias("kmer"), F.when(F.col("previous").isNotNull(), K.decode(F.col("previous"), K0)).alias("previous"))


# ---- superstrings ----------------------------------------------------------


_STREAMED = f"""WITH {windows_sql('documents', K0)},
f AS (SELECT rec, pos, km, row_number() OVER (PARTITION BY canon ORDER BY rec, pos) AS nth FROM w),
n AS (SELECT rec, pos, km, lead(pos) OVER (PARTITION BY rec ORDER BY pos) - pos AS gap FROM f WHERE nth = 1)
SELECT rec, pos, left(km, 1) || lower(substr(km, 2, CAST(least(coalesce(gap, {K0}), {K0}) AS BIGINT) - 1)) AS piece FROM n"""


@register("streaming_superstring", _STREAMED)
def streaming(spark, sf_dir):
    return streaming_superstring(dna(spark, sf_dir, "documents"), K0)


@register("streaming_superstring_files", _STREAMED)
def streaming_files(spark, sf_dir):
    """The same superstring by a streaming query over files that arrive in three batches, in the order of doc_id."""
    from kmerloom.plans.runtime import scratch_path
    from kmerloom.streaming.superstring import read_stream_pieces, write_stream

    source, folder = scratch_path(spark), scratch_path(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("rec"), "text")
    low, high = docs.agg(F.min("rec"), F.max("rec")).first()
    third = (high - low) // 3 + 1 if high is not None else 1
    for i in range(3):
        # texts are written, half as long as their letters, and bounds rather than a quotient let the reader leave out row groups
        first = (low or 0) + i * third
        arrived = docs.where(F.col("rec").between(first, first + third - 1))
        arrived.repartition(2 * spark.sparkContext.defaultParallelism).write.mode("append").parquet(source)
        stream = spark.readStream.schema("rec long, text string").parquet(source)
        write_stream(stream.select("rec", _letters("text").alias("seq")), K0, folder).awaitTermination()
    return read_stream_pieces(spark, folder).select("rec", "pos", "piece")


_TRUTH = f"WITH {windows_sql('documents', KG, PLAIN)} SELECT DISTINCT canon AS kmer FROM w"
_TRUTH_C = f"WITH {windows_sql('conversations', KG, PLAIN)} SELECT DISTINCT km AS kmer FROM w"
_SIZE_C = f"WITH {windows_sql('conversations', KG, PLAIN)} SELECT count(DISTINCT canon) AS n_kmers"


def _unitig_sql(name: str, k: int, rounds: int) -> str:
    """Pointers doubled ``rounds`` times, first to tell paths from circles, then with circles opened."""
    link = f"""o AS MATERIALIZED (SELECT canon AS x FROM w UNION SELECT {rc_sql('canon')} FROM w),
e AS (SELECT right(x, {k - 1}) AS word, 1 AS leaves, x FROM o UNION ALL SELECT left(x, {k - 1}), 0, x FROM o),
g AS (SELECT word, sum(leaves) AS a, count(*) - sum(leaves) AS b, max(CASE WHEN leaves = 1 THEN x END) AS x, max(CASE WHEN leaves = 0 THEN x END) AS y FROM e GROUP BY 1),
p0 AS MATERIALIZED (SELECT x, y, 1 AS hops, x AS low FROM g WHERE a = 1 AND b = 1 AND x <> y AND y <> {rc_sql('x')})"""

    def twice(p: str, i: int) -> str:
        return (f"{p}{i + 1} AS MATERIALIZED (SELECT a.x, coalesce(b.y, a.y) AS y, a.hops + coalesce(b.hops, 0) AS hops, least(a.low, coalesce(b.low, a.low)) AS low"
                f" FROM {p}{i} a LEFT JOIN {p}{i} b ON b.x = a.y)")

    first = ", ".join(twice("p", i) for i in range(rounds))
    second = ", ".join(twice("q", i) for i in range(rounds))
    return f"""WITH {windows_sql(name, k, PLAIN)}, {link}, {first},
c AS MATERIALIZED (SELECT x, low FROM p{rounds} WHERE y IN (SELECT x FROM p0)),
q0 AS MATERIALIZED (SELECT p0.* FROM p0 LEFT JOIN c ON c.x = p0.x WHERE c.x IS NULL OR p0.y <> c.low), {second},
r AS (SELECT o.x, coalesce(q.y, o.x) AS root, coalesce(q.hops, 0) AS hops, c.x IS NOT NULL AS circular FROM o LEFT JOIN q{rounds} q ON q.x = o.x LEFT JOIN c ON c.x = o.x),
u AS (SELECT root, arg_max(x, hops) AS part, max(hops) AS n, min(x) AS least_x, min({rc_sql('x')}) AS other, bool_or(circular) AS circle FROM r GROUP BY 1)
SELECT part, n - hops AS at, x AS kmer, circular FROM r JOIN u USING (root) WHERE CASE WHEN circle THEN least_x <= other ELSE part <= {rc_sql('root')} END"""


def _bases(spark, sf_dir, name="documents"):
    return dna(spark, sf_dir, name, PLAIN)


def _decoded_pieces(pieces, k, complements):
    return extract.decoded(extract.kmers(superstrings.to_chunks(pieces, k), k, complements, case_sensitive=True), k)


@register("global_greedy_decode", _TRUTH)
def global_greedy_decode(spark, sf_dir):
    return _decoded_pieces(superstrings.global_greedy(_bases(spark, sf_dir), KG), KG, True)


@register("global_greedy_single_strand_decode", _TRUTH_C)
def global_greedy_single_strand_decode(spark, sf_dir):
    return _decoded_pieces(superstrings.global_greedy(_bases(spark, sf_dir, "conversations"), KG, False), KG, False)


@register("global_greedy_stats", f"{_SIZE_C}, TRUE AS each_once, TRUE AS above_bound, TRUE AS saves FROM w")
def global_greedy_stats(spark, sf_dir):
    """Facts about the superstring: as many ones as k-mers, not shorter than the bound, shorter than the k-mers in a row."""
    seqs = cut(_bases(spark, sf_dir, "conversations"))
    s = superstrings.stats(superstrings.to_chunks(superstrings.global_greedy(seqs, KG), KG), KG)
    whole = cut(extract.kmers(seqs, KG, True))
    b = bound.lower_bound(whole, KG).select(F.col("lower_bound").alias("b"))
    t = s.join(whole.agg(F.count(F.lit(1)).alias("n_kmers"))).join(b)  # one row each
    return t.select(
        "n_kmers", (F.col("ones") == F.col("n_kmers")).alias("each_once"), (F.col("length") >= F.col("b")).alias("above_bound"),
        (F.col("length") < F.col("n_kmers") * KG).alias("saves"),
    )


@register("ggmo_decode", _TRUTH)
def ggmo_decode(spark, sf_dir):
    """Constructor, then the mask with few runs, then the set again."""
    ms = superstrings.to_chunks(superstrings.global_greedy(_bases(spark, sf_dir), KG), KG)
    return _decoded_mask(ms, "runs", KG)


@register("ggmo_min_ones_decode", _TRUTH)
def ggmo_min_ones_decode(spark, sf_dir):
    ms = superstrings.to_chunks(superstrings.global_greedy(_bases(spark, sf_dir), KG), KG)
    return _decoded_mask(ms, "zeros", KG)


@register("unitigs", _unitig_sql("benchmark", KG, 14))
def unitig_places(spark, sf_dir):
    t = unitigs.unitigs(kmer_set(spark, sf_dir, "benchmark", KG, digits=PLAIN), KG)
    return t.select(K.decode(F.col("part"), KG).alias("part"), "at", K.decode(F.col("kmer"), KG).alias("kmer"), "circular")


@register("unitig_decode", f"WITH {windows_sql('conversations', KG, PLAIN)} SELECT DISTINCT canon AS kmer FROM w")
def unitig_decode(spark, sf_dir):
    """All unitigs of the conversations as a masked superstring, and its set again."""
    placed = unitigs.unitigs(kmer_set(spark, sf_dir, "conversations", KG, digits=PLAIN), KG)
    return _decoded_pieces(unitigs.to_superstring(cut(unitigs.spelled(placed, KG)), KG), KG, True)


def _decoded_mask(ms, goal, k):
    ms = cut(ms)
    again = masks.apply_mask(ms, masks.optimize(ms, k, True, goal), k)
    return _decoded_pieces(again.select(F.col("rec").alias("part"), F.col("off").alias("rank"), "piece"), k, True)


@register("ggmo_strings_decode", _TRUTH)
def ggmo_strings_decode(spark, sf_dir):
    """Constructor, then the strings of its runs, then the set again."""
    pieces = superstrings.global_greedy(_bases(spark, sf_dir), KG)
    spelled = convert.to_strings(superstrings.to_chunks(pieces, KG), KG)
    return extract.decoded(extract.kmers(spelled.select("rec", F.col("spell").alias("seq")), KG, True), KG)


@register("global_greedy_long_decode", f"WITH {windows_sql('benchmark', 41, PLAIN)} SELECT DISTINCT canon AS kmer FROM w")
def global_greedy_long_decode(spark, sf_dir):
    """k > 31: text k-mers."""
    return _decoded_pieces(superstrings.global_greedy(_bases(spark, sf_dir, "benchmark"), 41), 41, True)


@register("local_greedy_decode", _TRUTH)
def local_greedy_decode(spark, sf_dir):
    return _decoded_pieces(superstrings.local_greedy(_bases(spark, sf_dir), KG, 5), KG, True)


@register("lower_bound")
def lower_bound(spark, sf_dir):
    """The bound for all documents; SQL cannot repeat it at this k in reasonable time, tests compare it with a plain count."""
    return bound.lower_bound(extract.binned_kmers(_bases(spark, sf_dir), KG, True), KG).select(F.col("lower_bound").cast("long"))


@register("verify_set_equality", f"""WITH {windows_sql('conversations', KG, PLAIN)} SELECT count(DISTINCT canon) AS n_left, count(DISTINCT canon) AS n_right,
count(DISTINCT canon) AS n_union, count(DISTINCT canon) AS n_both, TRUE AS equal FROM w""")
def verify_set_equality(spark, sf_dir):
    seqs = _bases(spark, sf_dir, "conversations")
    p = superstrings.local_greedy(seqs, KG, 2)
    return extract.same_kmers(seqs, superstrings.to_chunks(p, KG), KG, True)


# ---- masked superstrings ---------------------------------------------------


def _ms(spark, sf_dir, name="conversations"):
    return dna(spark, sf_dir, name, CASED)


_W = f"WITH {windows_sql('conversations', KM, CASED)}"
_ON = f"{_W}, kk AS (SELECT DISTINCT canon FROM w WHERE up), o AS (SELECT rec, pos, w.canon FROM w JOIN kk ON kk.canon = w.canon)"
_IV = f"""{_ON}, b AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY rec ORDER BY pos) = pos - 1 THEN NULL ELSE pos END AS st FROM o),
iv AS (SELECT rec, pos, canon, struct_pack(rec := rec, start := max(st) OVER (PARTITION BY rec ORDER BY pos)) AS interval FROM b)"""
_PRE = f"""{_IV}, inc AS (SELECT DISTINCT canon AS kmer, interval FROM iv), one AS (SELECT kmer, min(interval) AS interval FROM inc GROUP BY 1 HAVING count(*) = 1),
forced AS (SELECT DISTINCT interval FROM one), und AS (SELECT DISTINCT kmer FROM inc EXCEPT SELECT kmer FROM inc JOIN forced USING (interval))"""


@register("ms_scan", f"""WITH {windows_sql('conversations', KM, PLAIN)} SELECT DISTINCT km AS kmer FROM w""")
def ms_scan(spark, sf_dir):
    """The streaming superstring of all conversations written as one record, read again in lines, and decoded."""
    from kmerloom.plans.runtime import scratch_path
    from kmerloom.sources.fasta import read_superstring, write_superstring

    path = scratch_path(spark)
    write_superstring(cut(superstring_lines(dna(spark, sf_dir, "conversations", PLAIN), KM, False)), KM, path)
    return _decoded_pieces(read_superstring(spark, path), KM, False)


@register("ms_decode", f"{_W} SELECT DISTINCT canon AS kmer FROM w WHERE up")
def ms_decode(spark, sf_dir):
    return extract.decoded(masks.represented(_ms(spark, sf_dir), KM, True), KM)


@register("ms_stats", f"""SELECT rec, length(seq) AS length, length(regexp_replace(seq, '[acgt]', '', 'g')) AS ones,
length(regexp_replace(regexp_replace(seq, '[ACGT]+', '1', 'g'), '[acgt]', '', 'g')) AS runs FROM ({seq_sql('documents', CASED)})""")
def ms_stats(spark, sf_dir):
    t = convert.string_stats(_ms(spark, sf_dir, "documents"))
    return t.select("rec", *[F.col(c).cast("long") for c in ("length", "ones", "runs")])


@register("ms_objective", f"""SELECT rec, 2 * CAST(floor(length + runs * (1 + log2(length / runs))) AS BIGINT) AS objective FROM
(SELECT rec, length(seq) AS length, length(regexp_replace(regexp_replace(seq, '[ACGT]+', '1', 'g'), '[acgt]', '', 'g')) AS runs FROM ({seq_sql('documents', CASED)}))""")
def ms_objective(spark, sf_dir):
    t = convert.string_stats(_ms(spark, sf_dir, "documents"))
    return t.select("rec", T.objective(F.col("length"), F.col("runs")).alias("objective"))


@register("mask_extract", f"SELECT rec, translate(seq, 'acgtACGT', '00001111') AS mask, upper(seq) AS letters FROM ({seq_sql('conversations', CASED)})")
def mask_extract(spark, sf_dir):
    return _ms(spark, sf_dir).select("rec", T.mask_bits(F.col("seq")).alias("mask"), T.letters(F.col("seq")).alias("letters"))


@register("get_k", f"SELECT rec, length(seq) - length(rtrim(seq, 'acgt')) + 1 AS k FROM ({seq_sql('documents', CASED)})")
def get_k(spark, sf_dir):
    return _ms(spark, sf_dir, "documents").select("rec", T.infer_k(F.col("seq")).cast("long").alias("k"))


@register("mask_convention", f"""SELECT rec, length(seq) >= 3 AND right(seq, 2) = lower(right(seq, 2)) AND left(right(seq, 3), 1) <> lower(left(right(seq, 3), 1)) AS convention_ok
FROM ({seq_sql('documents', CASED)})""")
def mask_convention(spark, sf_dir):
    return masks.convention(_ms(spark, sf_dir, "documents"), 3)


@register("mask_max_ones", f"{_ON} SELECT rec, pos FROM o")
def mask_max_ones(spark, sf_dir):
    return masks.optimize(_ms(spark, sf_dir), KM, True, "ones")


@register("mask_min_ones", f"{_ON} SELECT rec, pos FROM (SELECT rec, pos, row_number() OVER (PARTITION BY canon ORDER BY rec, pos) AS nth FROM o) WHERE nth = 1")
def mask_min_ones(spark, sf_dir):
    return masks.optimize(_ms(spark, sf_dir), KM, True, "zeros")


@register("mask_intervals", f"{_IV} SELECT interval.rec AS rec, interval.start AS start, count(*) AS n FROM iv GROUP BY 1, 2")
def mask_intervals(spark, sf_dir):
    return masks.intervals(_ms(spark, sf_dir), KM, True).select("interval.rec", "interval.start", "n")


@register("kmer_interval_incidence", f"{_IV} SELECT DISTINCT canon AS kmer, interval.rec AS rec, interval.start AS start FROM iv")
def kmer_interval_incidence(spark, sf_dir):
    return extract.decoded(masks.incidence_of(_ms(spark, sf_dir), KM, True).select("kmer", "interval.rec", "interval.start"), KM)


@register("mask_presolve", f"{_PRE} SELECT 'forced' AS kind, count(*) AS n FROM forced UNION ALL SELECT 'undecided', count(*) FROM und")
def mask_presolve(spark, sf_dir):
    forced, rest = masks.presolve(masks.incidence_of(_ms(spark, sf_dir), KM, True))
    a = forced.agg(F.lit("forced").alias("kind"), F.count(F.lit(1)).alias("n"))
    return a.unionByName(rest.select("kmer").distinct().agg(F.lit("undecided").alias("kind"), F.count(F.lit(1)).alias("n")))


@register("mask_runs_approx", f"""{_PRE}, keep AS (SELECT interval FROM forced UNION SELECT interval FROM inc WHERE EXISTS (SELECT 1 FROM und))
SELECT rec, pos FROM iv WHERE interval IN (SELECT interval FROM keep)""")
def mask_runs_approx(spark, sf_dir):
    return masks.optimize(_ms(spark, sf_dir), KM, True, "runsapprox")


@register("mask_min_runs_decode", f"{_W} SELECT DISTINCT canon AS kmer FROM w WHERE up")
def mask_min_runs_decode(spark, sf_dir):
    """The superstring re-masked with few runs still stands for the same k-mers."""
    ms = cut(_ms(spark, sf_dir))
    again = masks.apply_mask(ms, masks.optimize(ms, KM, True, "runs"), KM)
    pieces = again.select(F.col("rec").alias("part"), F.col("off").alias("rank"), "piece")
    return _decoded_pieces(pieces, KM, True)


@register("mask_min_runs_facts", f"""{_PRE} SELECT count(DISTINCT kmer) AS n_kmers, (SELECT count(*) FROM forced) AS n_forced, TRUE AS covered, TRUE AS none_spare, TRUE AS forced_kept FROM inc""")
def mask_min_runs_facts(spark, sf_dir):
    """The chosen intervals cover every k-mer, hold all forced ones, and none of them can be left out."""
    t = masks.runs_facts(masks.incidence_of(_ms(spark, sf_dir), KM, True))
    return t.select(
        "n_kmers", "n_forced", (F.col("n_held") == F.col("n_kmers")).alias("covered"), (F.col("spare") == 0).alias("none_spare"), (F.col("lost") == 0).alias("forced_kept"),
    )


@register("ms_to_rspss", f"""{_W}, b AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY rec ORDER BY pos) = pos - 1 THEN NULL ELSE pos END AS st FROM w WHERE up),
r AS (SELECT rec, km, pos, max(st) OVER (PARTITION BY rec ORDER BY pos) AS start FROM b)
SELECT rec, start, substr(arg_min(km, pos), 1, {KM - 1}) || string_agg(right(km, 1), '' ORDER BY pos) AS spell FROM r GROUP BY 1, 2""")
def ms_to_rspss(spark, sf_dir):
    return convert.to_strings(_ms(spark, sf_dir), KM)


@register("spss_to_ms", f"SELECT rec, left(seq, length(seq) - {KM - 1}) || lower(right(seq, {KM - 1})) AS piece FROM ({seq_sql('documents', PLAIN)}) WHERE length(seq) >= {KM}")
def spss_to_ms(spark, sf_dir):
    t = dna(spark, sf_dir, "documents", PLAIN).where(F.length("seq") >= KM)
    return t.select("rec", convert.string_to_masked(F.col("seq"), KM).alias("piece"))


@register("ms_compare", f"""WITH {windows_sql('conversations', KM, CASED)}, {windows_sql('pages', KM, CASED, 'v')},
a AS (SELECT canon, count(*) AS n FROM w WHERE up GROUP BY 1), b AS (SELECT canon, count(*) AS n FROM v WHERE up GROUP BY 1)
SELECT count(*) FILTER (b.canon IS NULL) AS only_left, count(*) FILTER (a.canon IS NULL) AS only_right, count(*) FILTER (a.canon = b.canon) AS in_both,
CAST(sum(coalesce(a.n, 1) - 1) AS BIGINT) AS repeated_left, CAST(sum(coalesce(b.n, 1) - 1) AS BIGINT) AS repeated_right FROM a FULL JOIN b ON a.canon = b.canon""")
def ms_compare(spark, sf_dir):
    return convert.compare_superstrings(_ms(spark, sf_dir), _ms(spark, sf_dir, "pages"), KM, True)


# ---- run logs: one log line per line item ----------------------------------

_ALGS = ["global", "loac", "local", "streaming"]
_LOG = """SELECT l_orderkey, l_linenumber, 'data/set' || (l_suppkey % 7) || '.fa' AS path, CAST(23 + 8 * (l_partkey % 3) AS INTEGER) AS k,
  ['global','loac','local','streaming'][(l_linenumber % 4) + 1] AS algorithm, l_returnflag = 'R' AS complements,
  CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_quantity AS INTEGER) % 16 END AS run_penalty,
  1000 + l_partkey * 7 AS length, 1 + l_suppkey AS runs, CAST(floor(l_extendedprice) AS BIGINT) AS xz FROM lineitem"""


def _log_lines(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    alg = F.element_at(F.array(*[F.lit(a) for a in _ALGS]), F.col("l_linenumber") % 4 + 1)
    s = lambda c: c.cast("string")
    value = F.concat(
        F.concat_ws("-", F.lit("run"), "l_orderkey", "l_linenumber"), F.lit("\t-p data/set"), s(F.col("l_suppkey") % 7), F.lit(".fa -k "),
        s(23 + 8 * (F.col("l_partkey") % 3)), F.lit(" -a "), alg, F.when(F.col("l_returnflag") == "R", F.lit(" -c")).otherwise(F.lit("")),
        F.when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit(" --run-penalty "), s(F.col("l_quantity").cast("int") % 16))).otherwise(F.lit("")),
        F.lit("\t:= "), s(1000 + F.col("l_partkey") * 7), F.lit(" "), s(1 + F.col("l_suppkey")), F.lit(" 0.25 100 10 20 "),
        s(F.col("l_extendedprice").cast("decimal(18,2)")),
    )
    return t.select(value.alias("value"))


def _log(spark, sf_dir):
    return results.parse_log(_log_lines(spark, sf_dir))


_OBJ = "2 * CAST(floor(length + runs * (1 + log2(length / runs))) AS BIGINT)"


@register("results_parse", f"""WITH g AS ({_LOG}) SELECT 'run-' || l_orderkey || '-' || l_linenumber AS ts, path, k, algorithm, complements, coalesce(run_penalty, -1) AS run_penalty, length, runs,
0.25::DOUBLE AS time_s, 100::BIGINT AS mem_kib, 10::BIGINT AS gzip, 20::BIGINT AS bzip2, xz, 1::BIGINT AS zpaq, 1::BIGINT AS zstd FROM g""")
def results_parse(spark, sf_dir):
    """-1 stands for no run penalty."""
    return _log(spark, sf_dir).withColumn("run_penalty", F.coalesce("run_penalty", F.lit(-1)))


@register("results_relative", f"""WITH g AS (SELECT *, {_OBJ} AS objective FROM ({_LOG})),
b AS (SELECT path, k, complements, min(objective) AS base_objective, min(xz) AS base_xz FROM g WHERE algorithm = 'global' GROUP BY 1, 2, 3)
SELECT 'run-' || l_orderkey || '-' || l_linenumber AS ts, objective, base_objective, objective / base_objective AS relative_objective,
xz / base_xz AS relative_xz FROM g LEFT JOIN b USING (path, k, complements)""")
def results_relative(spark, sf_dir):
    r = results.relative(_log(spark, sf_dir))
    return r.select("ts", "objective", "base_objective", "relative_objective", "relative_xz")


@register("results_best_penalty", f"""WITH g AS (SELECT *, {_OBJ} AS objective FROM ({_LOG}) WHERE run_penalty IS NOT NULL)
SELECT path, k, complements, arg_min(run_penalty, objective * 1000 + run_penalty) AS best_penalty, min(objective) AS best_objective FROM g GROUP BY 1, 2, 3""")
def results_best_penalty(spark, sf_dir):
    return results.best_penalty(_log(spark, sf_dir))


@register("results_implied_penalty", f"SELECT 'run-' || l_orderkey || '-' || l_linenumber AS ts, round(3 + log2(length / runs), 6) AS implied_penalty FROM ({_LOG})")
def results_implied_penalty(spark, sf_dir):
    return results.implied_penalties(_log(spark, sf_dir)).select("ts", F.round("implied_penalty", 6).alias("implied_penalty"))


@register("results_missing_anti", f"""WITH g AS ({_LOG}), c AS (SELECT DISTINCT 'data/set' || (o_custkey % 9) || '.fa' AS path,
  CAST(23 + 8 * (o_orderkey % 4) AS INTEGER) AS k, 'loac' AS algorithm, o_custkey % 2 = 0 AS complements, CAST(o_orderkey % 20 AS INTEGER) AS run_penalty FROM orders)
SELECT path, k, algorithm, complements, run_penalty FROM c WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.path = c.path AND g.k = c.k AND g.algorithm = c.algorithm
  AND g.complements = c.complements AND g.run_penalty IS NOT DISTINCT FROM c.run_penalty)""")
def results_missing_anti(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("data/set"), (F.col("o_custkey") % 9).cast("string"), F.lit(".fa")).alias("path"),
        (23 + 8 * (F.col("o_orderkey") % 4)).cast("int").alias("k"), F.lit("loac").alias("algorithm"),
        (F.col("o_custkey") % 2 == 0).alias("complements"), (F.col("o_orderkey") % 20).cast("int").alias("run_penalty"),
    ).distinct()
    return results.missing(wanted, _log(spark, sf_dir))


_INPUTS = """SELECT 'data/set' || n || '.fa' AS file, CAST(24 + 8 * (n % 3) AS INTEGER) AS k_limit, CAST(n AS INTEGER) AS run_penalty, 'Set ' || n AS label, '0' AS flag
  FROM (SELECT DISTINCT s_suppkey % 9 AS n FROM supplier)"""


def _inputs(spark, sf_dir):
    """Input lines made of the suppliers, one comment line for each, too."""
    n = (F.col("s_suppkey") % 9).cast("string")
    limit = (24 + 8 * (F.col("s_suppkey") % 9 % 3)).cast("string")
    t = table(spark, sf_dir, "supplier").select(n.alias("n"), limit.alias("limit")).distinct()
    line = F.concat(F.lit("  data/set"), F.col("n"), F.lit(".fa  "), F.col("limit"), F.lit(" "), F.col("n"), F.lit("\tSet_"), F.col("n"), F.lit("  0"))
    return results.read_inputs(t.select(F.explode(F.array(F.concat(F.lit("# set "), F.col("n")), F.lit(" "), line)).alias("value")))


@register("results_inputs", _INPUTS)
def results_inputs(spark, sf_dir):
    return _inputs(spark, sf_dir)


@register("results_configurations", f"""WITH i AS ({_INPUTS}) SELECT file AS path, CAST(k AS INTEGER) AS k, algorithm, TRUE AS complements,
  CAST(CASE WHEN algorithm <> 'global' THEN run_penalty ELSE -1 END AS INTEGER) AS run_penalty
FROM i, (VALUES (23), (31), (39)) AS a(k), (VALUES ('global'), ('loac')) AS b(algorithm) WHERE k < k_limit""")
def results_configurations(spark, sf_dir):
    """-1 stands for no run penalty."""
    c = results.configurations(_inputs(spark, sf_dir), ["global", "loac"], [23, 31, 39])
    return c.withColumn("run_penalty", F.coalesce("run_penalty", F.lit(-1)))


@register("results_append", f"""WITH g AS ({_LOG}) SELECT 'run-' || l_orderkey || '-' || l_linenumber AS ts, path, k, algorithm, complements, coalesce(run_penalty, -1) AS run_penalty, length, runs, xz FROM g""")
def results_append(spark, sf_dir):
    """The log appended to a file in the shared folder and parsed from there."""
    from kmerloom.plans.runtime import scratch_path

    path = scratch_path(spark)
    results.append_log(_log(spark, sf_dir), path)
    again = results.parse_log(spark.read.text(path))
    return again.select("ts", "path", "k", "algorithm", "complements", F.coalesce("run_penalty", F.lit(-1)).alias("run_penalty"), "length", "runs", "xz")


@register("results_table", f"""WITH g AS (SELECT *, {_OBJ} AS objective, 'run-' || l_orderkey || '-' || l_linenumber AS ts FROM ({_LOG}) WHERE k = 31 AND complements),
i AS ({_INPUTS}), l AS (SELECT path, algorithm, run_penalty, arg_max(struct_pack(length := length, runs := runs, objective := objective, xz := xz), ts) AS r FROM g GROUP BY 1, 2, 3),
b AS (SELECT file, label, i.run_penalty AS penalty, r AS b FROM i JOIN l ON l.path = i.file AND l.algorithm = 'global' AND l.run_penalty IS NULL),
o AS (SELECT b.*, l.r AS r FROM b JOIN l ON l.path = b.file AND l.algorithm = 'loac' AND l.run_penalty = b.penalty)
SELECT label AS dataset, 'GGMO' AS method, b.length AS length, b.runs AS runs, b.objective AS objective, 1.0::DOUBLE AS relative, b.xz AS compressed FROM b
UNION ALL SELECT label, 'LOAC (' || penalty || ')', r.length, r.runs, r.objective, round(r.objective / b.objective, 6), r.xz FROM o""")
def results_table(spark, sf_dir):
    """Relative is 1 for the baseline here; the written table leaves it empty."""
    t = results.table_rows(results.parse_log(_log_lines(spark, sf_dir), 31, True), _inputs(spark, sf_dir), 31)
    return t.select("dataset", "method", "length", "runs", "objective", F.coalesce(F.round("relative", 6), F.lit(1.0)).alias("relative"), "compressed")


# ---- penalty-bounded superstrings ------------------------------------------


@register("loac_decode", _TRUTH)
def loac_decode(spark, sf_dir):
    return _decoded_pieces(bounded.bounded(_bases(spark, sf_dir), KG), KG, True)


@register("csac_single_strand_decode", _TRUTH_C)
def csac_single_strand_decode(spark, sf_dir):
    return _decoded_pieces(bounded.bounded(_bases(spark, sf_dir, "conversations"), KG, False, variant="csac"), KG, False)


@register("loac_stats", f"{_SIZE_C}, TRUE AS keeps_ones, TRUE AS not_more_runs, TRUE AS not_dearer FROM w")
def loac_stats(spark, sf_dir):
    """Facts against the plain greedy string of the same set: at least one one per k-mer, no more runs, and not dearer at the given penalty."""
    seqs, penalty = cut(_bases(spark, sf_dir, "conversations")), 8
    frags = fragments.from_sequences(seqs, KG, True)
    measures = lambda p: superstrings.stats(superstrings.to_chunks(p, KG), KG)
    a = measures(superstrings.global_greedy(frags, KG)).toDF("g_length", "g_ones", "g_runs")
    b = measures(bounded.bounded(frags, KG, run_penalty=penalty))
    n = extract.kmers(seqs, KG, True).agg(F.count(F.lit(1)).alias("n_kmers"))
    cost = lambda length, runs: F.col(length) + penalty * F.col(runs)
    return n.join(a).join(b).select(
        "n_kmers", (F.col("ones") >= F.col("n_kmers")).alias("keeps_ones"), (F.col("runs") <= F.col("g_runs")).alias("not_more_runs"),
        (cost("length", "runs") <= cost("g_length", "g_runs")).alias("not_dearer"),
    )


@register("loac_search_stats", f"WITH {windows_sql('benchmark', KG, PLAIN)} SELECT count(DISTINCT canon) AS n_kmers, count(DISTINCT canon) AS n_decoded, TRUE AS not_dearer FROM w")
def loac_search_stats(spark, sf_dir):
    """The whole search by cost over the benchmark: it decodes to its set and is not dearer than walks followed by jumps."""
    seqs, penalty = cut(_bases(spark, sf_dir, "benchmark")), 8
    frags = fragments.from_sequences(seqs, KG, True)
    pieces = [superstrings.to_chunks(bounded.bounded(frags, KG, run_penalty=penalty, combined=x), KG) for x in (True, False)]
    a, b = (superstrings.stats(p, KG).select((F.col("length") + penalty * F.col("runs")).alias(n)) for p, n in zip(pieces, ("new", "old"), strict=True))
    whole, again = extract.kmers(seqs, KG, True), extract.kmers(pieces[0], KG, True, case_sensitive=True)
    n = whole.agg(F.count(F.lit(1)).alias("n_kmers")).join(again.join(whole, "kmer").agg(F.count(F.lit(1)).alias("n_decoded")))
    return n.join(a).join(b).select("n_kmers", "n_decoded", (F.col("new") <= F.col("old")).alias("not_dearer"))
