"""Toxicity: a learned lexicon matched by Levenshtein automata on its trie, scored in context.

The lexicon holds whole words and word stems that labelled documents show to be toxic. A word is
matched by running a Levenshtein automaton for it along the trie of the lexicon: stems match as
exact beginnings, whole words of five letters or more also with one letter wrong, missing, added or
swapped. Each match is seen in a window of neighbouring words: inside quotation marks or next to words of
reporting it counts as quoted, near a second person as addressed. A logistic model of these counts
gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from kmerloom.llm.tables import bound_to, whole
from kmerloom.plans.runtime import cut

TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»‹›]")
QUOTES = frozenset("\"“”„«»‹›")
# Fixed word lists.
REPORTING = frozenset("said says say called call calls wrote writes word term quote quoted reported sagte sagt nannte wort dit disait appelé mot dijo dice llamó palabra".split())
ADDRESSING = frozenset("you your you're du dich dir ihr euch sie tu te toi vous votre tú ti usted ustedes".split())
#: Labelled rows the model is fitted on at most, lexicon entries at most, words seen on each side of a match.
SAMPLE_ROWS, ENTRIES, REACH = 40_000, 2_000, 8
#: Letters of stems, least letters of a word that may be misspelled, distinct words a task remembers.
STEMS, FUZZY_FROM, REMEMBERED = range(4, 9), 5, 400_000
FEATURES = 7


class Lexicon:
    """Trie of entries ``text -> weight``; a text that ends in ``*`` is a stem."""

    def __init__(self, entries: dict[str, float]):
        self.entries = dict(entries)
        self.trie: dict = {}
        for text, weight in self.entries.items():
            node = self.trie
            for letter in text.rstrip("*"):
                node = node.setdefault(letter, {})
            node["stem" if text.endswith("*") else "word"] = weight
        words = [t for t in self.entries if not t.endswith("*") and len(t) >= FUZZY_FROM]
        # one wrong letter leaves the first or the second half of a word in place
        self.heads = {w[: len(w) // 2] for w in words}
        self.tails = {w[len(w) // 2 :] for w in words}
        self.sizes = sorted({len(h) for h in self.heads}), sorted({len(t) for t in self.tails})
        self.stems = {t[:-1]: w for t, w in self.entries.items() if t.endswith("*")}
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.plain: set[str] = set()
        self.told: dict[str, tuple[float, int]] = {}

    def __getstate__(self) -> dict:
        return {"entries": self.entries}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["entries"])

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, errors) of the best entry for a word, fewest errors first, or None."""
        best = max((self.stems[word[:n]] for n in self.stem_sizes if word[:n] in self.stems), default=None)
        exact = self.entries.get(word)
        if exact is not None or best is not None:
            return max(x for x in (exact, best) if x is not None), 0
        heads, tails = self.sizes
        if len(word) >= FUZZY_FROM - 1 and (any(word[:n] in self.heads for n in heads) or any(word[-n:] in self.tails for n in tails)):
            found = self._walk(self.trie, word, range(len(word) + 1), None, None, "", 0)
            return (found, 1) if found is not None else None
        return None

    def _walk(self, node: dict, word: str, row, before, previous, letter: str, depth: int) -> float | None:
        """Largest weight of whole-word entries below ``node`` within one error; ``row`` is the automaton's state."""
        best = node.get("word") if depth >= FUZZY_FROM and row[-1] <= 1 else None
        for step, child in node.items():
            if len(step) > 1:
                continue
            fresh = [row[0] + 1]
            for i, have in enumerate(word, 1):
                cost = min(row[i] + 1, fresh[-1] + 1, row[i - 1] + (have != step))
                if before is not None and i > 1 and have == letter and word[i - 2] == step:
                    cost = min(cost, before[i - 2] + 1)
                fresh.append(cost)
            if min(fresh) <= 1:
                found = self._walk(child, word, fresh, row, node, step, depth + 1)
                best = found if best is None else best if found is None else max(best, found)
        return best

    def hits(self, tokens: list[str]) -> list[tuple[int, float, int]]:
        """(place, weight, errors) of all matches; words met before are remembered up to a bound."""
        for word in set(tokens).difference(self.plain, self.told):
            got = self.match(word)
            if got is None:
                self.plain.add(word)
            else:
                self.told[word] = got
        out = [(i, *self.told[t]) for i, t in enumerate(tokens) if t in self.told] if self.told else []
        if len(self.plain) + len(self.told) > REMEMBERED:
            self.plain.clear()
            self.told.clear()
        return out


def features(text: str, lexicon: Lexicon) -> list[float]:
    """What the model sees of a whole text."""
    tokens = TOKEN.findall(text.lower())
    exact = quoted = fuzzy = addressed = most = 0.0
    hits = lexicon.hits(tokens)
    for place, weight, errors in hits:
        before, after = tokens[max(0, place - REACH) : place], tokens[place + 1 : place + 1 + REACH]
        inside = sum(t in QUOTES for t in before) % 2 == 1 and any(t in QUOTES for t in after)
        if inside or not REPORTING.isdisjoint(before[-3:]):
            quoted += weight
        elif errors:
            fuzzy += weight
        else:
            exact += weight
            most = max(most, weight)
        addressed += not ADDRESSING.isdisjoint(before) or not ADDRESSING.isdisjoint(after)
    return [1.0, math.log1p(exact), most, math.log1p(quoted), math.log1p(fuzzy), math.log1p(addressed), len(hits) / math.sqrt(len(tokens) + 1)]


def _features(texts: pd.Series, lexicon: Lexicon) -> pd.Series:
    return pd.Series([features(t, lexicon) for t in texts])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id's text leaves 0 when divided by 5; rows without id are kept, too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, text, toxic)`` of at most ``rows`` labelled documents outside the held-out fold, the smallest by a hash of the id.

    Labels of one doc_id are joined by their largest; rows without id or label do not count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most `rows` rows of two numbers: a bound that does not depend on the data
    return docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(chosen), "doc_id")


def learn_lexicon(labelled: DataFrame, entries: int = ENTRIES) -> Lexicon:
    """Words and stems whose share of toxic documents stands out beyond chance among all candidates.

    Documents whose smallest word-triple hash is equal count once, so copies do not vote twice. A word that
    a stem covers is kept beside it where it may be misspelled, as stems match exact beginnings only.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))

    def smallest(w: Column) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    read = labelled.select("doc_id", "toxic", words.alias("words"))
    read = cut(read.select("doc_id", "toxic", F.array_distinct("words").alias("words"), bound_to(F.col("words"), smallest).alias("sign")))
    single = read.groupBy("sign").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    texts = read.join(single, "doc_id", "left_semi")
    total = texts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n, t = int(total["n"]), int(total["t"])
    if not 0 < t < n:
        return Lexicon({})
    words = texts.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    stems = [F.when(F.length("word") > k, F.concat(F.left("word", F.lit(k)), F.lit("*"))) for k in STEMS]
    units = words.select("t", "n", F.explode(F.array(F.col("word"), *stems)).alias("unit")).where(F.col("unit").isNotNull() & (F.length("unit") >= 4))
    counted = cut(units.groupBy("unit").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where("t >= 3"))
    base, many = t / n, max(2, counted.count())
    clean = F.col("n") - F.col("t")
    gain = 2 * (F.col("t") * F.log(F.col("t") / (F.col("n") * base)) + F.when(clean > 0, clean * F.log(clean / (F.col("n") * (1 - base)))).otherwise(0.0))
    told = counted.where("2 * t >= n").withColumn("gain", gain).where(F.col("gain") >= 2 * math.log(many) + 6)
    rows = told.orderBy(F.desc("gain"), F.desc(F.length("unit")), "unit").limit(entries).collect()
    held: dict[str, tuple[float, int]] = {}
    covered: dict[str, float] = {}
    for r in rows:
        text, stem = r["unit"].rstrip("*"), r["unit"].endswith("*")
        above = any(text[:k] + "*" in held for k in STEMS if k <= len(text))
        below = stem and any(h.startswith(text) and 20 * c >= 19 * r["t"] for h, (_, c) in held.items())
        weight = math.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5)) - math.log(base / (1 - base))
        if not above and not below:
            held[r["unit"]] = (weight, r["t"])
        elif above and not stem and len(text) >= FUZZY_FROM:
            covered[text] = weight
    return Lexicon(covered | {k: w for k, (w, _) in held.items()})


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is the constant and is not shrunk."""
    beta = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Lexicon, np.ndarray]:
    labelled = cut(sample(docs, labels, rows))
    lexicon = learn_lexicon(labelled)
    seen = F.pandas_udf(lambda texts: _features(texts, lexicon), ArrayType(DoubleType()))
    got = labelled.select("toxic", seen("text").alias("x")).toPandas()  # at most `rows` short rows
    if got.empty:
        return lexicon, np.array([-3.0] + [0.0] * (FEATURES - 1))
    return lexicon, fit(np.array(got["x"].tolist(), dtype=float), got["toxic"].clip(0, 1).to_numpy(dtype=float))


def _scores(lexicon: Lexicon, beta: np.ndarray):
    weights = beta.tolist()

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            sums = [sum(w * f for w, f in zip(weights, features(t, lexicon), strict=True)) for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, dtype=float), -30, 30))))

    return F.pandas_udf(_typed(score), DoubleType())


def _typed(fn):
    fn.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return fn


def scored(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1) of the whole text; null and empty texts get the score of no match.

    Without labels the score is one small constant. Labels, language, source and id are no inputs of a score.
    """
    lexicon, beta = train(docs, labels, rows)
    return docs.withColumn("score", _scores(lexicon, beta)(whole("text")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays below the threshold, columns as they were."""
    held = docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc"))
    return scored(held, labels).where(F.col("score") < threshold).select("doc.*")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
