"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, compatibility forms and look-alike letters of other
scripts and digits that stand for letters turned into the letters, anything else into
spaces, whatever the character; and once more, where they have any, letters without
their marks. The lexicon holds words and beginnings of words; all are found in one pass
over each folded text, and one that stands in both at the same place counts once. Terms
inside an exception phrase don't count. The sum of the found terms' weights, alone and
normalised by the text's length, is turned into a score between 0 and 1 by a logistic
function.

The lexicon, its weights, further exception phrases and the logistic function are
learned from labelled texts: at most ``FIT_ROWS`` of each label, those with the least
hashes of their ids, of which copies and near copies (texts of one label that agree in
two least shingles) count once. A term is taken if it stands in toxic texts more often
than chance allows, over all terms there are, in the toxic texts that no better term
explains: long texts share many rare words, and without this the words that go along
with toxic ones would be taken too. Terms that stand in a fair part of the toxic texts
and hardly anywhere else are taken in any case. Two words of which one holds a term
become an exception if they stand in other texts though the term tells toxic ones.
Scores depend on texts alone.

Defined results: null and empty texts hold no terms and get the score of such texts; a
very long text is matched whole, and its length normalised; repeated rows and texts that
tie are scored alike; terms that tell as much as one another are taken the longest
first, then the alphabetically last; without labelled texts of both kinds nothing can be
learned, and every score is 0; a text with both labels counts as toxic; an empty table
gives an empty result; ``keep_clean`` carries all columns, whatever they are called.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwise.llm import shingles
from chunkwise.llm._common import ship, staged

#: Labelled texts of each kind that are learned from, at most.
FIT_ROWS = 10_000
#: Lengths of word beginnings that are looked at, besides whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Least weight (log odds) of a term, and least likelihood-ratio statistic.
LEAST_WEIGHT, LEAST_G = 1.5, 30.0
#: Least number of texts that a term, or an exception, stands in.
LEAST_TEXTS = 4
#: Share of toxic texts of a term that is taken in any case, and its other texts for each toxic one.
FAIR_SHARE, HARDLY = 0.03, 0.01

#: Odd factors of the two hash functions that near copies are told by.
SKETCH = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгеёзікмнорстухуѕјԁԛԝαβεικνορτυχωıɡɑօսհ", "abbreezikmhopctyxysjdqwabeikvoptuxwigaouh", strict=True))
#: Digits and signs that stand for letters.
SUBSTITUTES = dict(zip("013457@$€", "oieastase", strict=True))
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown fish", "clown fish", "clownfish", "idiot proof", "loser bracket", "pathetic fallacy")


class _Plain(dict):
    """What each character is folded to, found out when it is first met."""

    def __missing__(self, c: int) -> str | None:
        out = ""
        for x in unicodedata.normalize("NFKC", chr(c)).lower():
            kind = unicodedata.category(x)
            out += KNOWN.get(x) or ("" if kind in ("Mn", "Me", "Cf") else x if kind[0] in "LN" else " ")
        self[c] = out
        return out


class _Marks(dict):
    """Latin letters with marks, and what they are without."""

    def __missing__(self, c: int) -> str | int:
        base = unicodedata.normalize("NFKD", chr(c))[0]
        self[c] = base if c > 127 and "a" <= base <= "z" else c
        return self[c]


KNOWN = HOMOGLYPHS | SUBSTITUTES
PLAIN, MARKS = _Plain(), _Marks()


def fold(text: str | None) -> str:
    """The text with its words between single or more spaces, one at either end."""
    return f" {text.lower().translate(PLAIN)} " if text else "  "


def without_marks(folded: str) -> str:
    """A folded text without marks, character by character."""
    return folded if folded.isascii() else folded.translate(MARKS)


@dataclass(frozen=True)
class Model:
    """``terms``: folded text that begins with a space (and ends with one if it is a whole
    word) and its weight. ``factors``: of 1, the logarithm of the weights' sum, and that of the sum per 100 words."""

    terms: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    factors: tuple[float, float, float] | None = None


class Matcher:
    def __init__(self, model: Model) -> None:
        self.model = model
        self.found = ahocorasick.Automaton()
        for term, weight in model.terms:
            self.found.add_word(term, (len(term), weight))
        for phrase in model.exceptions:
            self.found.add_word(fold(phrase), (len(fold(phrase)), None))
        self.found.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        hits = self._hits(folded)
        if (bare := without_marks(folded)) != folded:
            hits |= self._hits(bare)
        safe = [(a, b) for a, b, w in hits if w is None]
        total = sum(w for a, b, w in sorted(hits, key=lambda h: h[:2]) if w is not None and not any(x <= a and b <= y for x, y in safe))
        if not total:
            return 0.0, 0.0
        words = max(1, folded.count(" ") - 1)
        return float(np.log1p(total)), float(np.log1p(100 * total / words))

    def _hits(self, folded: str) -> set[tuple[int, int, float | None]]:
        return {(end - n + 1, end, w) for end, (n, w) in self.found.iter(folded)} if len(self.found) else set()

    def in_word(self, word: str) -> set[str]:
        """The lexicon's terms that a folded word holds."""
        padded = f" {word} "
        return {padded[end - n + 1 : end + 1] for end, (n, w) in self.found.iter(padded) if w is not None} if len(self.found) else set()

    def score(self, text: str | None) -> float:
        if not self.model.factors:
            return 0.0
        a, b, c = self.model.factors
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def candidates(text: str | None) -> set[str]:
    """The words of a text and their beginnings, as terms."""
    folded = fold(text)
    bare = without_marks(folded)
    words = {*folded.split(), *(bare.split() if bare != folded else ())}
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


@dataclass(frozen=True)
class Evidence:
    """How much a term tells: log odds, and the likelihood ratio against chance."""

    weight: float
    g: float

    @classmethod
    def of(cls, toxic: int, other: int, texts: tuple[int, int], share: float) -> Evidence:
        """``texts``: toxic and other texts; ``share``: of all terms' texts, the toxic ones."""
        n = toxic + other
        weight = float(np.log((toxic + 0.5) / (texts[0] + 1)) - np.log((other + 0.5) / (texts[1] + 1)))
        parts = [(x, e) for x, e in ((toxic, n * share), (other, n * (1 - share))) if x]
        return cls(weight, float(2 * sum(x * np.log(x / e) for x, e in parts)))

    @property
    def enough(self) -> bool:
        return self.weight >= LEAST_WEIGHT and self.g >= LEAST_G


def chosen(counts: list[tuple[str, int, int]], holders: dict[str, set[int]], texts: tuple[int, int], share: float) -> list[tuple[str, float]]:
    """Terms and weights from (term, toxic texts, other texts) rows and the toxic texts that hold each term."""
    whole = {term: Evidence.of(toxic, other, texts, share) for term, toxic, other in counts}
    others = {term: other for term, _, other in counts}
    taken: list[str] = []
    stems: set[str] = set()  # of the terms that were taken, and how they begin

    def related(term: str) -> bool:
        stem = term.strip()
        return stem in stems or any(stem[:n] in whole_stems for n in range(1, len(stem) + 1))

    whole_stems: set[str] = set()

    def take(term: str) -> None:
        stem = term.strip()
        taken.append(term)
        whole_stems.add(stem)
        stems.update(stem[:n] for n in range(1, len(stem) + 1))

    # of words and their beginnings the one that tells most; of equals the longest. What a term tells only
    # falls as others explain texts, so one that still tells as much as when it was filed is the best there is.
    order = lambda t, g: (-g, -len(t), [-ord(x) for x in t], t)
    filed = [order(t, e.g) for t, e in whole.items() if e.enough]
    heapify(filed)
    explained: set[int] = set()
    while filed:
        g, _, _, term = heappop(filed)
        left = holders.get(term, set()) - explained
        if len(left) < LEAST_TEXTS:
            continue
        now = Evidence.of(len(left), others[term], texts, share)
        if not now.enough:
            continue
        if now.g < -g:
            heappush(filed, order(term, now.g))
        elif not related(term):
            take(term)
            explained |= left
    fair = max(LEAST_TEXTS, FAIR_SHARE * texts[0])
    for term, toxic, other in sorted(counts, key=lambda c: order(c[0], whole[c[0]].g)):
        if toxic >= fair and other <= HARDLY * toxic and whole[term].enough and not related(term):
            take(term)
    return sorted((t, whole[t].weight) for t in taken)


def phrases(text: str | None, matcher: Matcher) -> set[tuple[str, str]]:
    """(term, two words) where one of the words holds a term."""
    words = fold(text).split()
    found = [{m for m in matcher.in_word(w)} for w in words]
    return {(term, f"{a} {b}") for (a, x), (b, y) in pairwise(zip(words, found, strict=True)) for term in x | y}


def harmless(counts: list[tuple[str, str, int, int]], texts: tuple[int, int]) -> tuple[str, ...]:
    """Phrases that become exceptions, from (term, phrase, toxic texts, other texts) rows."""
    by_term: dict[str, tuple[int, int]] = {}
    for term, _, toxic, other in counts:
        t, o = by_term.get(term, (0, 0))
        by_term[term] = t + toxic, o + other
    out = set()
    for term, phrase, toxic, other in counts:
        t, o = by_term[term]
        share = min(max(o / (t + o), 1e-6), 1 - 1e-6)  # of the term's phrases, those in other texts
        told = Evidence.of(other, toxic, (texts[1], texts[0]), share)
        if other >= LEAST_TEXTS and told.weight >= LEAST_WEIGHT and 2 * told.g >= LEAST_G and other / (toxic + other) > share:
            out.add(phrase)
    return tuple(sorted(out))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Factors of a weighted logistic regression, by Newton's steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * b * [0, *[1] * (len(b) - 1)]
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(bend, slope)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """Of the texts (text, label) of one label that are copies or near copies the least one."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [np.zeros(batch.num_rows, np.uint64) for _ in SKETCH]
            for block in shingles.blocks(batch.column(0), 5):
                full = np.flatnonzero(np.diff(block.at))
                for out, factor in zip(least, SKETCH, strict=True):
                    if len(full):
                        out[block.first + full] = np.minimum.reduceat(shingles.mix(block.hashes * np.uint64(factor)), block.at[full])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.view(np.int64)) for x in least)], names=["text", "label", "s0", "s1"])

    sketched = labelled.mapInArrow(sketch, "text string, label int, s0 long, s1 long")
    return sketched.groupBy("label", "s0", "s1").agg(F.min("text").alias("text")).select("text", "label")


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "label", exceptions: tuple[str, ...] = EXCEPTIONS, shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A model from labelled texts (label 1: toxic), as many as a sample holds.

    ``shares``: the part of all labelled texts, other and toxic, that the sample has.
    """
    ship(labelled.sparkSession)
    own = staged(distinct_texts(labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))), "texts")
    n = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model(exceptions=exceptions)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                by = Counter(), Counter()
                for text, label in zip(part.column(0), part.column(1), strict=True):
                    by[label.as_py()].update(candidates(text.as_py()))
                terms = [*(by[0] | by[1])]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([by[1][t] for t in terms], pa.int64()), pa.array([by[0][t] for t in terms], pa.int64())], names=["term", "toxic", "other"])

    counts = own.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = staged(counts, "terms")  # as many as the sample has
    mass = counts.agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).first()
    share = min(max(mass["toxic"] / max(1, mass["toxic"] + mass["other"]), 1e-6), 1 - 1e-6)
    # those that can be enough by their numbers alone; of a sample of bounded size, and told exactly below
    toxic, other = F.col("toxic"), F.col("other")
    odds = F.log((toxic + 0.5) / (n[1] + 1)) - F.log((other + 0.5) / (n[0] + 1))
    close = counts.where((toxic >= LEAST_TEXTS) & (odds >= LEAST_WEIGHT - 1e-6))
    terms = [(r["term"], r["toxic"], r["other"]) for r in close.toLocalIterator() if Evidence.of(r["toxic"], r["other"], (n[1], n[0]), share).enough]
    wanted = {t for t, *_ in terms}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(candidates(t.as_py()) & wanted) for t in batch.column(0)], pa.list_(pa.string()))], names=["terms"])

    holders: dict[str, set[int]] = {}
    toxic_texts = own.where("label = 1").mapInArrow(held, "terms array<string>") if wanted else own.limit(0).select(F.array().cast("array<string>").alias("terms"))
    for i, row in enumerate(toxic_texts.toLocalIterator()):  # at most FIT_ROWS
        for term in row["terms"]:
            holders.setdefault(term, set()).add(i)
    lexicon = tuple(chosen(terms, holders, (n[1], n[0]), share))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Model(lexicon, ()))
        for batch in batches:
            found = [(*p, label.as_py()) for text, label in zip(batch.column(0), batch.column(1), strict=True) for p in phrases(text.as_py(), matcher)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["term", "phrase", "label"])

    told = own.mapInArrow(around, "term string, phrase string, label int").groupBy("term", "phrase").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("other"))
    known = [tuple(r) for r in told.collect()] if lexicon else []  # a sample's phrases with terms
    model = Model(lexicon, tuple(dict.fromkeys([*exceptions, *harmless(known, (n[1], n[0]))])))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            x = [matcher.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column(1)], names=["x", "y", "label"])

    rows = own.mapInArrow(features, "x double, y double, label int").collect()  # at most 2 * FIT_ROWS
    x, label = np.array([[r["x"], r["y"]] for r in rows]), np.array([r["label"] for r in rows])
    weight = np.where(label == 1, 1 / shares[1], 1 / shares[0])
    return Model(model.terms, model.exceptions, logistic(x, label, weight))


def training_part(doc_id: Column) -> Column:
    """Whether a label may be learned from: crc32 of the id as text isn't divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model learned from the training part of the labels: of each kind the ``FIT_ROWS`` with the least hashes."""
    own = labels.where(F.col(label_col).isin(0, 1) & training_part(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label"))
    total = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if not total.get(0) or not total.get(1):
        return Model()
    order = [F.xxhash64(F.col("_id")), F.col("_id")]
    sample = own.where("label = 0").orderBy(*order).limit(FIT_ROWS).unionAll(own.where("label = 1").orderBy(*order).limit(FIT_ROWS))
    # at most 2 * FIT_ROWS ids are sent to every executor
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id").select("text", "label")
    return learn(staged(labelled, "labelled"), shares=tuple(min(1.0, FIT_ROWS / total[i]) for i in (0, 1)))


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score), one for each row of ``df``."""
    ship(df.sparkSession)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["id", "score"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text scores below ``limit``, with all their columns."""
    ship(df.sparkSession)
    held = [f"_c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text_col)
    plain = df.toDF(*held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            yield batch.filter(pa.array([matcher.score(t.as_py()) < limit for t in batch.column(at)], pa.bool_()))

    return plain.mapInArrow(work, plain.schema).toDF(*df.columns)
