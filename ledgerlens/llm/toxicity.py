"""Toxicity scores by weak supervision.

1. Terms: whole words and word beginnings of several lengths, hashed. In a bounded sample of labelled texts, those that
   go with the label beyond chance become lexicons, one voter per kind of term and strength; a list of insults and a few fixed patterns
   vote as well.
2. Votes: every text of the corpus is voted on; only the counts of vote patterns are kept, at most ``2 ** voters`` rows.
3. Label model: a latent class with one firing rate per voter and class, fitted to the pattern counts of the whole corpus by
   expectation maximisation; the patterns of the labelled sample start it and keep a half of the say, so that the classes stay those of
   the labels. Voters whose votes go together within a class beyond chance are correlated; each
   voter's evidence is divided by the sum of its correlations, so that ten copies of one voter count about once.
4. Classifier: a logistic regression on term presence, trained by MLlib on the posterior labels of the sample and
   of as many texts without labels, rows weighted back to the corpus. Its score is what is returned; texts are scored whole, by their text alone.

The sample holds at most about ``fit_rows`` labelled rows (expected number, drawn by hash, both classes half if there are enough). The
broadcast model has at most ``terms`` terms. Null and empty texts have no terms and get the score of a text without any; unlabelled
tables, and labels of one class only, give score 0 for all rows. Label rows with null fields are left out, repeated label rows
count as toxic if one says so. Repeated documents get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.bytewords import LOWER, Lookup, hashes, words
from ledgerlens.llm.common import add_columns, bounded_batches, held_out, pieces, texts, utf8
from ledgerlens.session import materialize

#: Lengths in bytes of word beginnings that count as terms; 0 is the whole word.
KINDS = (0, 4, 5, 6)
#: Fixed patterns that vote besides the lexicons.
PATTERNS = (re.compile(r"(?i)\b(?:you|u)(?:'re| are| r)? (?:a |an |such a |so )?(?:idiot|moron|loser|trash|scum|clown|stupid|worthless|pathetic)"),
            re.compile(r"(?i)\b(?:shut up|go to hell|drop dead|kill yourself|screw you)\b"),
            re.compile(r"(?i)\b\w{1,3}[*#@$!]{2,}\w{0,4}\b"))
#: Insults that count whatever the labels say; fixed values.
INSULTS = ("asshole", "bastard", "bitch", "clown", "creep", "cretin", "disgusting", "dumb", "dumbass", "filth", "freak", "garbage",
           "idiot", "idiotic", "imbecile", "jerk", "loser", "moron", "moronic", "pathetic", "pig", "retard", "scum", "scumbag", "slut",
           "stupid", "trash", "twat", "vermin", "whore", "worthless")
#: One lexicon per kind of term and strength, and that of the insults.
LEXICONS = 3 * len(KINDS) + 1
VOTERS = LEXICONS + len(PATTERNS)
THRESHOLD = 0.3


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of all terms of a block of texts, repeats included; the two lowest bits of a term are its kind."""
    w = words(data, offsets)
    lower = LOWER[data]
    owner, found = [], []
    for k, size in enumerate(KINDS):
        if size:
            long = np.flatnonzero(w.end - w.start >= size)
            h, t = hashes(lower, w.start[long], w.start[long] + size), w.text[long]
        else:
            h, t = w.hash, w.text
        owner.append(t)
        found.append(h & ~np.uint64(3) | np.uint64(k))
    return np.concatenate(owner), np.concatenate(found)


def _sample(labelled: DataFrame, fit_rows: int) -> DataFrame:
    """Labelled ids, about half of each class, with the weight that makes up for the draw."""
    counts = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    if len(counts) < 2:
        return labelled.limit(0).withColumn("weight", F.lit(1.0))
    ones = min(counts[1], fit_rows // 2)
    rate = {1: ones / counts[1], 0: min(1.0, (fit_rows - ones) / counts[0])}
    mine = F.when(F.col("y") == 1, F.lit(rate[1])).otherwise(F.lit(rate[0]))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "i"), 11) / float(1 << 53)
    return labelled.where(draw < mine).withColumn("weight", 1 / mine)


def _mine(sample: DataFrame, least: int) -> DataFrame:
    """Terms of the sample with the number of positive and negative texts that have them, ``least`` texts at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, term = term_hashes(*utf8(batch.column("t")))
            positive = batch.column("y").to_numpy() == 1
            order = np.lexsort([owner, term])
            owner, term = owner[order], term[order]
            first = np.ones(len(term), bool)
            first[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
            owner, term = owner[first], term[first]
            unique, at = np.unique(term, return_inverse=True)
            ones = np.bincount(at, weights=positive[owner], minlength=len(unique)).astype(np.int64)
            both = np.bincount(at, minlength=len(unique))
            yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(ones), pa.array(both - ones)], ["term", "n1", "n0"])

    counted = sample.select("t", "y").mapInArrow(run, "term long, n1 long, n0 long")
    return counted.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") + F.col("n0") >= least)


class Lexicons:
    """Terms, and the voters whose lists they are on."""

    def __init__(self, terms: np.ndarray, n1: np.ndarray, n0: np.ndarray, base: float, most: int):
        insults = np.unique(term_hashes(*utf8(pa.array(INSULTS)))[1])
        insults = insults[(insults & np.uint64(3)) == 0]
        self.lookup = Lookup(np.concatenate([terms, insults]))
        counts = np.zeros((2, len(self.lookup.keys)))
        counts[:, self.lookup(terms)] = n1, n0
        n1, n0 = counts
        self.voter = np.full(len(n1), -1, np.int64)
        # likelihood ratio of a term's counts, against what the best of so many terms reaches by chance
        gain = 2 * (n1 * np.log(np.maximum(n1, 1) / np.maximum((n1 + n0) * base, 1e-9))
                    + n0 * np.log(np.maximum(n0, 1) / np.maximum((n1 + n0) * (1 - base), 1e-9)))
        listed = np.flatnonzero((n1 > 4 * n0) & (gain > 2 * np.log(len(n1) + 1) + 4))
        listed = listed[np.argsort(-gain[listed], kind="stable")][:most]
        kind = (self.lookup.keys[listed] & np.uint64(3)).astype(np.int64)
        strong = (np.arange(len(listed)) * 3 // max(len(listed), 1)).astype(np.int64)
        self.voter[listed] = kind * 3 + strong
        self.voter[self.lookup(insults)] = LEXICONS - 1

    def bits(self, many: list[str]) -> np.ndarray:
        """Votes of each text as a bit mask, and its (text, place of term) pairs."""
        owner, term = term_hashes(*utf8(pa.array(many, pa.large_string())))
        at = self.lookup(term)
        hit = np.flatnonzero(at >= 0)
        owner, at = owner[hit], at[hit]
        votes = np.zeros((len(many), VOTERS), bool)
        votes[owner[self.voter[at] >= 0], self.voter[at][self.voter[at] >= 0]] = True
        for k, pattern in enumerate(PATTERNS):
            votes[:, LEXICONS + k] = [bool(pattern.search(t)) for t in many]
        return votes @ (1 << np.arange(VOTERS)), owner, at


class LabelModel:
    """Firing rates of voters in two classes and the correlation of their votes, from counts of vote patterns.

    ``counts`` are those of all texts, ``known[c]`` those of the labelled texts of class c, for the same patterns.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 50):
        votes = (patterns[:, None] >> np.arange(VOTERS)) & 1
        known = known * (counts.sum() / max(known.sum(), 1e-9))
        self.prior = float(np.clip(known[1].sum() / max(known.sum(), 1e-9), 1e-6, 0.5))
        post = np.zeros(len(counts))
        self.weight = np.ones(VOTERS)
        for turn in range(rounds):
            mass = [known[0], known[1]] if turn == 0 else [known[0] + counts * (1 - post), known[1] + counts * post]
            self.rate = np.clip([(mine @ votes + 0.01) / (mine.sum() + 1) for mine in mass], 1e-6, 1 - 1e-6)
            share = np.zeros((VOTERS, VOTERS))
            for c, mine in enumerate(mass):
                residual = votes - self.rate[c]
                cover = (residual * mine[:, None]).T @ residual / max(mine.sum(), 1e-9)
                scale = np.sqrt(np.maximum(np.diag(cover), 1e-12))
                share += np.abs(cover / np.outer(scale, scale)) / 2
            self.correlation = share
            self.weight = 1 / np.maximum(np.where(share > 0.05, share, 0).sum(1), 1)
            new = self.posterior(patterns)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = (patterns[:, None] >> np.arange(VOTERS)) & 1
        one = np.log(self.rate[1] / self.rate[0]) * self.weight
        none = np.log((1 - self.rate[1]) / (1 - self.rate[0])) * self.weight
        odds = np.log(self.prior / (1 - self.prior)) + votes @ one + (1 - votes) @ none
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


class Classifier:
    """Weights of terms."""

    def __init__(self, lexicons: Lexicons | None, weights: np.ndarray, intercept: float):
        self.lexicons, self.weights, self.intercept = lexicons, weights, intercept

    def score(self, many: list[str]) -> np.ndarray:
        if self.lexicons is None:
            return np.zeros(len(many))
        out = np.full(len(many), self.intercept)
        owner, term = term_hashes(*utf8(pa.array(many, pa.large_string())))
        at = self.lexicons.lookup(term)
        hit = np.flatnonzero(at >= 0)
        pair = np.unique(owner[hit] * len(self.weights) + at[hit])
        np.add.at(out, pair // len(self.weights), self.weights[pair % len(self.weights)])
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        fit_rows: int = 20_000, terms: int = 4096, listed: int = 600) -> Classifier:
    """Classifier of ``label``; only rows whose id is not held out teach it."""
    spark = documents.sparkSession
    bounded_batches(spark)
    nothing = Classifier(None, np.zeros(0), 0.0)
    seen = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where(
        F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    seen = materialize(seen, "labels")
    drawn = _sample(seen, fit_rows)
    if drawn.isEmpty():
        return nothing
    mine = documents.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    # the sample's ids are at most about fit_rows numbers, so this side may be broadcast
    sample = materialize(mine.join(F.broadcast(drawn), "i"), "sample")
    # how far a term's share of positive texts is from the sample's, in standard errors
    base = sample.agg(F.avg("y")).head()[0]
    if base is None or base in (0.0, 1.0):
        return nothing
    n = F.col("n1") + F.col("n0")
    strength = F.abs(F.col("n1") - n * base) / F.sqrt(n * base * (1 - base))
    top = _mine(sample, 5).orderBy(strength.desc(), "term").limit(terms).toPandas()
    lexicons = Lexicons(top["term"].to_numpy().view(np.uint64), top["n1"].to_numpy(), top["n0"].to_numpy(), float(base), listed)
    shared = spark.sparkContext.broadcast(lexicons)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern = shared.value.bits(texts(batch.column("t")))[0]
            y = batch.column("y").to_numpy(zero_copy_only=False)
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            unique, at = np.unique(pattern * 4 + y + 1, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array((unique >> 2).astype(np.int64)), pa.array((unique & 3).astype(np.int64) - 1),
                                              pa.array(np.bincount(at, weights=weight))], ["pattern", "y", "n"])

    everything = mine.select("t", F.lit(-1).alias("y"), F.lit(1.0).alias("weight")).unionByName(sample.select("t", "y", "weight"))
    counted = everything.mapInArrow(vote, "pattern long, y long, n double").groupBy("pattern", "y").agg(F.sum("n").alias("n"))
    by_class = counted.toPandas().pivot_table("n", "pattern", "y", fill_value=0).reindex(columns=[-1, 0, 1], fill_value=0)
    model = LabelModel(by_class.index.to_numpy(), by_class[-1].to_numpy(), by_class[[0, 1]].to_numpy().T)
    size = len(lexicons.voter)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = texts(batch.column("t"))
            pattern, owner, at = shared.value.bits(many)
            pair = np.unique(owner * size + at)
            bounds = np.searchsorted(pair, np.arange(len(many) + 1) * size).astype(np.int32)
            post = model.posterior(pattern)
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array(bounds), pa.array((pair % size).astype(np.int32))),
                pa.array(post), pa.array(batch.column("weight").to_numpy(zero_copy_only=False))], ["at", "p", "w"])

    rate = min(1.0, fit_rows / max(mine.count(), 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("unlabelled"), "i"), 11) / float(1 << 53)
    others = mine.where(~held_out(F.col("i")) & (draw < rate)).select("t", F.lit(1 / rate).alias("weight"))
    rows = materialize(sample.select("t", "weight").unionByName(others).mapInArrow(examples, "at array<int>, p double, w double"), "examples")
    # each text counts as toxic with its posterior and as clean with the rest
    both = rows.select("at", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("w") * F.col("p")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("w") * (1 - F.col("p"))).alias("weight")))).alias("y"))
    both = both.select("at", "y.*").where("weight > 1e-6")
    place = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], inputCol="at", outputCol="features")
    vectors = place.setBinary(True).transform(both.withColumn("at", F.col("at").cast("array<string>"))).select("label", "weight", "features")
    if vectors.select("label").distinct().count() < 2:
        return nothing
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1e-5, maxIter=60,
                                standardization=False).fit(vectors)
    return Classifier(lexicons, fitted.coefficients.toArray(), float(fitted.intercept))


def predict(documents: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score of the text."""
    spark = documents.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = documents.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = texts(batch.column(text))
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in many])])
            scores = [shared.value.score(many[a:b]) for a, b in pieces(sizes, 4 << 20)]
            yield add_columns(batch, {out: pa.array(np.concatenate([np.zeros(0), *scores]))})

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())]))


def assess(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    model = fit(documents, labels, doc_id, text, **options)
    own = documents.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return predict(own, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
