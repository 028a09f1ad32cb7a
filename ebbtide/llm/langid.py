"""Language identification by words first, backing off to ever shorter character n-grams.

A word that the model knows adds its log frequency in each language.  An unseen word is cut into its longest n-grams,
and the mean log frequencies of those that are known count; if none is, the next shorter n-grams are tried, down to
single letters.  A word of which nothing is known adds nothing.  The text's language is that of the largest sum.

The model is fitted on at most about ``max_docs`` labelled rows, chosen by a hash and shared out evenly among the languages,
so that a rare one isn't starved by a frequent one.  It keeps every word and n-gram that these rows hold, so its size is
bounded by theirs whatever the corpus; it is sent to the executors once.  Every text is scored whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, held_out, saved
from .words import rows, words_of

LONGEST = 5
UNKNOWN = "und"
MEMORY = 200_000  # unseen words whose scores a worker remembers


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of a word between its edges; for n = 1 its letters."""
    padded = word if n == 1 else f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches):
    """(lang, n, gram, count); words have n = 0."""
    found: dict[tuple[str, int], Counter] = defaultdict(Counter)

    def out():
        flat = [(lang, n, g, c) for (lang, n), own in found.items() for g, c in own.items()]
        found.clear()
        for i in range(0, len(flat), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat[i : i + 50_000]), (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "n", "gram", "count"])

    for batch in batches:
        for lang, text in rows(batch):
            for word, c in Counter(words_of(text)).items():
                found[lang, 0][word] += c
                for n in range(1, LONGEST + 1):
                    own = found[lang, n]
                    for g in grams_of(word, n):
                        own[g] += c
            if sum(map(len, found.values())) > 500_000:
                yield from out()
    yield from out()


class LanguageModel:
    """Log frequencies by word and by n-gram."""

    def __init__(self, langs: list[str], tables: list[dict[str, int]], logs: list[np.ndarray]):
        self.langs, self.tables, self.logs = langs, tables, logs
        self.memory: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    @classmethod
    def of(cls, counts: Iterable[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]) -> LanguageModel:
        """Of (lang, n, gram, count), and the total of each language and n."""
        langs = sorted({lang for lang, n in totals if n == 0})
        column = {lang: i for i, lang in enumerate(langs)}
        tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        cells = [([], [], []) for _ in tables]
        for lang, n, gram, c in counts:
            for own, x in zip(cells[n], (tables[n].setdefault(gram, len(tables[n])), column[lang], c), strict=True):
                own.append(x)
        logs = []
        for n, (row, lang, c) in enumerate(cells):
            total = np.array([max(totals.get((name, n), 1), 1) for name in langs], float)
            seen = np.full((len(tables[n]), len(langs)), 0.1)  # what a gram that a language lacks counts as
            seen[row, lang] = c
            logs.append(np.log(seen / total) if langs else seen)
        return cls(langs, tables, logs)

    def _backed_off(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            known = [self.tables[n][g] for g in grams_of(word, n) if g in self.tables[n]]
            if known:
                return self.logs[n][known].mean(axis=0)
        return np.zeros(len(self.langs))

    def score(self, words: list[str]) -> np.ndarray:
        """The sum over the words, a number a language."""
        if not len(self.scores) or len(self.memory) > len(self.tables[0]) + MEMORY:
            self.memory = dict(self.tables[0])
            self.scores = np.concatenate([self.logs[0], np.zeros((MEMORY, len(self.langs)))])
        at = list(map(self.memory.get, words))
        if None in at:
            for word in {w for w, i in zip(words, at, strict=True) if i is None}:
                i = self.memory[word] = len(self.memory)
                if i >= len(self.scores):
                    self.scores = np.concatenate([self.scores, np.zeros((len(self.scores) // 2 + 1, len(self.langs)))])
                self.scores[i] = self._backed_off(word)
            at = list(map(self.memory.get, words))
        return self.scores[at].sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not any(map(str.isalpha, words)) or not self.langs:
            return UNKNOWN, 0.0
        total = self.score(words)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def shares(counts: dict[str, int], bound: int) -> dict[str, float]:
    """The part of each language's rows to take: those of the rare ones whole, an equal number of the others', ``bound`` in all."""
    found, left = {}, bound
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        own = min(n, left // (len(counts) - i))
        found[lang] = own / n
        left -= own
    return found


def fit(docs: DataFrame, *, max_docs: int = 8_000, lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> LanguageModel:
    """Learn from about ``max_docs`` rows of ``docs`` with a language.  The caller leaves out what is held out.

    A row whose text and language another has too counts once, whatever their ids.  Null doc_ids are ids like others.  No row
    with a language gives a model that answers ``und``.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(doc_id).cast("string").alias("id"))
    part = shares({r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}, max_docs)  # a row a language
    if not part:
        return LanguageModel.of((), {})
    width = 1 << 30
    upto = F.element_at(F.create_map(*[F.lit(x) for name, share in part.items() for x in (name, int(width * share))]), F.col("lang"))
    chosen = labelled.filter(F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(width)) < upto).select("lang", "text").distinct()
    counts = saved(chosen.mapInArrow(_count, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")))
    totals = {(r[0], r[1]): r[2] for r in counts.groupBy("lang", "n").agg(F.sum("count")).collect()}
    table = counts.toArrow()
    return LanguageModel.of((row for batch in table.to_batches() for row in rows(batch, 10_000)), totals)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """The columns of ``docs`` as _doc (a struct, without the text), lang_pred and score.

    ``und`` with score 0 for null texts and texts without a letter; a tie goes to the first language by name.  Each row has
    its result, repeated rows and those with a null doc_id too.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text] or [F.lit(1)]).alias("_doc"), F.col(text).cast("string").alias("_text"))

    def run(batches):
        own = sent.value
        for batch in batches:
            found = [own.predict(t) for (t,) in rows(batch.select(["_text"]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["_doc", "lang_pred", "score"])

    return slim.mapInArrow(run, f"_doc {slim.schema['_doc'].dataType.simpleString()}, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that aren't held out."""
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("_doc.doc_id", held_out(F.col("_doc.doc_id")).alias("held_out"), "lang_pred", "score")
