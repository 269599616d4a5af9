"""Information-theoretic sanitisation of personal data, on DataFrame functions only.

Identifiers of fixed form (email, ip, card, phone) are the protected entities. A term of a text that
holds one, at any place, is judged by what the corpus says about it: the pointwise mutual information between
term and entity against the information of the entity itself. If a term gives away at least
``alpha`` of that information, it is a disclosure and becomes a span, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.tables import bound_to, running, text_key, whole
from kmerloom.plans.runtime import cut

#: Fixed forms, in the order in which spans are listed. A match must not start inside a run of its own
#: first class unless the last match ended there: those starts can't match, and trying them all is quadratic.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What the text must contain for the pattern to be tried at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = [*PATTERNS, "general", "removed"]
WORD = r"[\p{L}\p{M}\p{N}]+"


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn test."""

    def term(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), term) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
        return value.rlike(rf"\A(?:{part})(?:\.(?:{part})){{3}}\z")
    if kind == "card":
        n = F.length(digits)
        return F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, use) -> Column:
    """``use(hits, gaps, starts)`` of the leftmost non-overlapping matches of a text that has some; starts count from 0."""

    def placed(hits: Column) -> Column:
        def measured(gaps: Column) -> Column:
            sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
            ahead = F.zip_with(running(sizes), F.slice(gaps, F.lit(1), F.size(hits)), lambda before, g: before + F.length(g))
            return bound_to(ahead, lambda starts: use(hits, gaps, starts))

        return F.when(F.size(hits) > 0, bound_to(F.split(text, pattern, -1), measured))

    return bound_to(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _entities(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, value)."""

    def build(hits: Column, gaps: Column, starts: Column) -> Column:
        def one(hit: Column, start: Column) -> Column:
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"))

        return F.filter(F.zip_with(hits, starts, one), lambda e: _valid(kind, e["value"]))

    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,value:string>>")
    return F.coalesce(F.when(text.rlike(HINTS[kind]), _matches(text, PATTERNS[kind], build)), none)


def entities(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, k1, k2, found, held)``, one row per input row; null texts read as empty.

    held is the text where an entity was found, else null.
    """
    found = F.concat(*[_entities(F.col("text"), kind) for kind in PATTERNS])
    rows = docs.select("doc_id", whole("text").alias("text")).select("doc_id", *text_key(), found.alias("found"), "text")
    return rows.select("doc_id", "k1", "k2", "found", F.when(F.size("found") > 0, F.col("text")).alias("held"))


def _is_term(term: Column) -> Column:
    return (F.length(term) >= 3) & ~term.rlike("[0-9]")


def _terms(texts: DataFrame) -> DataFrame:
    """``(k1, k2, held)`` -> ``(k1, k2, term, start, end)``: every term at all its places in the text."""

    def build(hits: Column, gaps: Column, starts: Column) -> Column:
        return F.zip_with(hits, starts, lambda w, at: F.struct(F.lower(w).alias("term"), at.alias("start"), (at + F.length(w)).alias("end")))

    placed = texts.select("k1", "k2", F.explode(_matches(F.col("held"), WORD, build)).alias("t"))
    return placed.select("k1", "k2", "t.*").where(_is_term(F.col("term")))


def _stem(term: Column) -> Column:
    """What a term is generalised to: its first three letters."""
    return F.left(term, F.lit(3))


def disclosures(docs: DataFrame, found: DataFrame, alpha: float, support: int) -> DataFrame:
    """``(k1, k2, kind, start, end)`` of terms that give away an entity of their text, wherever they stand in it.

    Entities and pairs are counted over distinct texts, terms over all documents, so copies never make
    a term look more telling. A pair needs ``support`` distinct texts. A term whose stem stays below
    the threshold is generalised to the stem, else removed.
    """
    total = docs.count()
    held = found.where("held is not null")
    every = held.select("k1", "k2", F.explode("found").alias("m")).select("k1", "k2", F.concat_ws(":", "m.kind", "m.value").alias("entity")).distinct()
    # a pair has at most as many texts as its entity
    entity = cut(every.groupBy("entity").agg(F.count(F.lit(1)).alias("entity_texts")).where(F.col("entity_texts") >= support))
    mention = cut(every.join(entity, "entity"))
    # the share can reach alpha only for terms of few enough documents: a pair has no more texts than its entity
    most = F.pow(F.lit(float(max(total, 1))), F.lit(1 - alpha)) * F.pow(F.max("entity_texts").cast("double"), F.lit(alpha)) * (1 + 1e-9)
    texts = mention.groupBy("k1", "k2").agg(most.alias("most"))
    placed = cut(_terms(held.join(texts, ["k1", "k2"], "left_semi").select("k1", "k2", "held").dropDuplicates(["k1", "k2"])))
    spoken = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(whole()), F.lit(WORD), F.lit(0)))).alias("term"))
    vocabulary = cut(spoken.where(_is_term(F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("in_docs")))
    stems = vocabulary.groupBy(_stem(F.col("term")).alias("stem")).agg(F.sum("in_docs").alias("stem_docs"))
    rare = placed.select("k1", "k2", "term").distinct().join(vocabulary.where(F.col("in_docs") >= support), "term").join(texts, ["k1", "k2"]).where("in_docs <= most")
    pair = mention.join(rare.select("k1", "k2", "term", "in_docs"), ["k1", "k2"])
    pair = pair.groupBy("entity", "entity_texts", "term", "in_docs").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)

    def told(both: str, alone: str) -> Column:
        """Share of the entity's information that the term carries."""
        information = F.log2(F.lit(total) / F.col("entity_texts"))
        mutual = F.log2(F.lit(total) * F.col(both) / (F.col("entity_texts") * F.col(alone)))
        return F.when(information > 0, mutual / information).otherwise(0.0)

    judged = cut(pair.where(told("both", "in_docs") >= alpha).withColumn("stem", _stem(F.col("term"))))
    asked = judged.select("entity", "stem").distinct()
    spoken_stems = placed.select("k1", "k2", _stem(F.col("term")).alias("stem")).distinct()
    stem_pair = mention.join(asked, "entity").join(spoken_stems, ["k1", "k2", "stem"]).groupBy("entity", "stem").agg(F.count(F.lit(1)).alias("stem_both"))
    judged = judged.join(stem_pair, ["entity", "stem"]).join(stems, "stem")
    kind = F.when(told("stem_both", "stem_docs") < alpha, KINDS.index("general")).otherwise(KINDS.index("removed"))
    ruled = mention.join(judged.select("entity", "term", kind.alias("kind")), "entity").groupBy("k1", "k2", "term").agg(F.max("kind").alias("kind"))
    return placed.join(ruled, ["k1", "k2", "term"]).select("k1", "k2", "kind", "start", "end")


def spans(docs: DataFrame, alpha: float = 0.9, support: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, k1, k2, base, terms)``, arrays of (kind, start, end) in order of kind and start.

    Offsets are code points, end exclusive. Null and empty texts have empty arrays, repeated rows give
    repeated rows, null doc_ids stay null, other columns are not looked at. Term spans never overlap
    base spans. Terms are looked for in the whole text, however far from the entity.
    """
    found = cut(entities(docs))
    told = disclosures(docs.select("text"), found, alpha, support)
    listed = told.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("told"))
    base = F.array_sort(F.transform("found", lambda e: F.struct(e["kind"], e["start"], e["end"])))
    joined = found.select("doc_id", "k1", "k2", base.alias("base")).join(listed, ["k1", "k2"], "left")
    free = F.filter("told", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return joined.select("doc_id", "k1", "k2", "base", F.coalesce(free, none).alias("terms"))


def listing(items: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, text)`` with every span replaced by its kind in brackets; a generalised term keeps its stem.

    Of overlapping spans the one that starts first, then the longest, is replaced; the rest of a later one goes with it.
    """
    ruled = spans(docs, **options).select("k1", "k2", F.concat("base", "terms").alias("all")).dropDuplicates(["k1", "k2"])
    names = F.array(*map(F.lit, KINDS))
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        start, end = F.greatest(s["start"], state["at"]).cast("int"), s["end"].cast("int")
        mark = F.when(s["kind"] == KINDS.index("general"), F.concat(F.substring(text, start + 1, F.lit(3)), F.lit("*"))).otherwise(F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]")))
        kept = F.substring(text, state["at"].cast("int") + 1, start - state["at"].cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(state["out"], F.array(kept, F.when(s["start"] >= state["at"], mark).otherwise(""))).alias("out"))
        return F.when(end <= state["at"], state).otherwise(fresh)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    ordered = F.array_sort(F.transform("all", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(ordered, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"].cast("int") + 1, F.length(text))))
    keyed = docs.select("doc_id", whole("text").alias("text")).select("doc_id", "text", *text_key())
    return keyed.join(ruled, ["k1", "k2"]).select("doc_id", done.alias("text"))


def query(docs: DataFrame) -> DataFrame:
    out = spans(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)]
    every = F.concat("base", F.array_sort("terms"))
    return out.select("doc_id", *counts, F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(every).alias("spans"))
