"""Toxicity by a counterfactually regularised classifier.

A logistic regression over the presence of words.  Beside the loss on the labels it pays for every change of a
sentence's score when an identity term in it is swapped for another term of the same set, so a neutral mention of a
group neither raises nor lowers a score.  Weights are pulled to zero (L1) by as much as one document can pull them away, so
what a word does in a single document is no evidence and long clean texts don't add up to a toxic one.

It is fitted on at most about ``max_docs`` labelled documents, chosen by a hash of their id, with every word of theirs and
every identity term, on the driver; every text is scored whole on the executors.
"""

from __future__ import annotations

import logging
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, documents, held_out, saved
from .words import rows, words_of

log = logging.getLogger(__name__)

#: Terms of one set can stand for each other in a sentence.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
)
THRESHOLD = 0.3


def term_sets(table: DataFrame) -> tuple[tuple[str, ...], ...]:
    """Identity terms from a table of (set, term), lowered; rows with a null don't count.  It is collected: a list of terms."""
    found = defaultdict(set)
    for name, term in table.select(*[F.col(c).cast("string") for c in table.columns[:2]]).collect():
        if name is not None and term is not None:
            found[name].add(term.lower())
    return tuple(tuple(sorted(found[name])) for name in sorted(found))


class ToxicityModel:
    """Weights of words, a bias, and how many counterfactual pairs the fit has paid for."""

    def __init__(self, weights: dict[str, float], bias: float, pairs: int = 0):
        self.weights, self.bias, self.pairs = weights, bias, pairs

    def score(self, text: str | None) -> float:
        if np.isneginf(self.bias):
            return 0.0
        own = self.weights
        z = self.bias + sum(own[w] for w in own.keys() & set(words_of(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def counterfactuals(docs: list[np.ndarray], index: dict[str, int], terms: tuple[tuple[str, ...], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word in a sentence, word that it is swapped for), once for each sentence and other term of its set."""
    sets = [sorted({index[t] for t in own if t in index}) for own in terms]
    of: dict[int, set[int]] = defaultdict(set)
    for own in sets:
        for i in own:
            of[i].update(own)
    known = np.array(sorted(of), int)
    pairs = [(i, j) for d in docs for i in np.intersect1d(d, known).tolist() for j in sorted(of[i] - set(d.tolist()))]
    found = np.array(pairs, int).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def train(docs: list[np.ndarray], labels: np.ndarray, n_words: int, swaps: tuple[np.ndarray, np.ndarray], *, fairness: float = 1.0, l1: float = 1.0, l2: float = 1e-5, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise mean log loss + fairness * mean squared change of score + l1 + l2.

    A document is the sorted array of its words; ``l1`` counts documents.  Accelerated proximal gradients; each weight has a
    step of its own.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
    n, m = len(docs), max(len(swaps[0]), 1)
    filled = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]
    size = sizes + 1.0
    curve = np.bincount(flat, np.repeat(size / 4, sizes), n_words) / n + l2  # majorises the Hessian
    curve += 4 * fairness * (np.bincount(swaps[0], minlength=n_words) + np.bincount(swaps[1], minlength=n_words)) / m
    step, bias_step = 1 / np.maximum(curve, 1e-9), 4 / size.mean()
    w, b = np.zeros(n_words), 0.0
    v, c, t = w, b, 1.0
    z, held = np.zeros(n), np.empty(len(flat))
    for _ in range(steps):
        z[filled] = np.add.reduceat(np.take(v, flat, out=held, mode="clip"), starts) if len(flat) else 0
        off = (1 / (1 + np.exp(-np.clip(z + c, -60, 60))) - labels) / n
        gap = (v[swaps[0]] - v[swaps[1]]) * 2 * fairness / m
        slope = np.bincount(flat, np.repeat(off, sizes), n_words) + l2 * v + np.bincount(swaps[0], gap, n_words) - np.bincount(swaps[1], gap, n_words)
        new = v - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1 / n, 0)
        new_b = c - bias_step * off.sum()
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, c = new + (was - 1) / t * (new - w), new_b + (was - 1) / t * (new_b - b)
        w, b = new, new_b
    return w, b


def _distinct_words(batches):
    for batch in batches:
        found = [(i, y, sorted(set(words_of(t)))) for i, y, t in rows(batch)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.list_(pa.string()))], ["id", "y", "words"])


def _word_numbers(sent):
    """The places of a document's words in the sorted names, without those that aren't there."""

    def run(batches):
        for batch in batches:
            words = batch.column("words")
            at = pc.index_in(words.flatten(), value_set=sent.value).to_numpy(zero_copy_only=False)
            parts = [np.sort(x[~np.isnan(x)]).astype(np.int32) for x in np.split(at, np.cumsum(pc.list_value_length(words).to_numpy())[:-1])] if len(words) else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(parts, pa.list_(pa.int32()))], ["id", "y", "words"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, max_docs: int = 16_000, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = 1.0, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Learn from about ``max_docs`` rows of ``labels`` that have a label and a document.  The caller leaves out what is held out.

    Rows with a null id teach nothing.  Of rows that repeat an id the largest label and the smallest text count.  Without a
    labelled document, or without a toxic one, the model gives every text 0.  Sentences without a term of ``terms`` have no
    counterfactual; the model's ``pairs`` tells how many there were.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), (F.col(label) > 0).cast("int").alias("y"))
    chosen = bounded_sample(marked, F.col("id"), max_docs).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))  # about max_docs rows
    found = saved(joined.mapInArrow(_distinct_words, "id long, y int, words array<string>"))
    held = found.select(F.explode("words").alias("word")).groupBy("word").count().filter("count > 1")  # a word of one document alone has the weight 0, see train
    names = pa.array(sorted({*held.select("word").toArrow().column(0).to_pylist(), *(t for own in terms for t in own)}), pa.string())
    kept = found.mapInArrow(_word_numbers(docs.sparkSession.sparkContext.broadcast(names)), "id long, y int, words array<int>").toArrow().sort_by("id")
    labelled = kept.column("y").to_numpy().astype(float)
    if not labelled.any():
        return ToxicityModel({}, -np.inf)
    own = [x for part in kept.column("words").chunks for x in np.split(part.flatten().to_numpy(), np.cumsum(pc.list_value_length(part).to_numpy())[:-1])]
    names = names.to_pylist()
    swaps = counterfactuals(own, {w: i for i, w in enumerate(names)}, terms)
    log.log(logging.INFO if len(swaps[0]) else logging.WARNING, "%d counterfactual pairs in %d labelled documents", len(swaps[0]), len(own))
    del kept, held, found
    pa.default_memory_pool().release_unused()
    weights, bias = train(own, labelled, len(names), swaps, fairness=fairness)
    return ToxicityModel({w: float(weights[i]) for i, w in enumerate(names) if weights[i]}, float(bias), len(swaps[0]))


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """``docs`` as _doc with a last column _score from 0 to 1; null and empty texts have the score of no words.

    Each row has its score, repeated rows and those with a null doc_id too.  No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    slim = docs.select(F.struct(*[docs[f"`{c}`"].cast("string").alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns]).alias("_doc"))

    def run(batches):
        own = sent.value
        for batch in batches:
            texts = batch.column(0).field(at)
            found = [own.score(t) for i in range(0, len(texts), 64) for t in texts.slice(i, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["_doc", "_score"])

    return slim.mapInArrow(run, f"_doc {slim.schema['_doc'].dataType.simpleString()}, _score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learnt from labels of documents that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    found = score(docs, fit(docs, labels))
    return found.select("_doc.doc_id", held_out(F.col("_doc.doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
