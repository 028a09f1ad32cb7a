"""Operators that SQL can't express, against plain restatements of what they are to compute."""

import itertools
import logging
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import langid, packing, sharding, toxicity
from ebbtide.llm.registry import QUERIES
from ebbtide.llm.words import words_of

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").collect()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_id_is_the_backoff_of_all_counts(spark, table):
    """All words and n-grams of all learnt texts; every text scored word by word."""
    count, total = defaultdict(Counter), Counter()
    for lang, text in {(r.lang, r.text) for r in table if r.lang is not None and r.text is not None and not held_out(r.doc_id)}:
        for w in words_of(text):
            pieces = [(0, w)] + [(n, g) for n in range(1, 6) for p in [w if n == 1 else f" {w} "] for g in (p[i : i + n] for i in range(len(p) - n + 1))]
            for n, g in pieces:
                count[n, g][lang] += 1
                total[n, lang] += 1
    langs = sorted({lang for _, lang in total})

    def logs(n, g):
        return [math.log((count[n, g][x] or 0.1) / total[n, x]) for x in langs]

    def scores(w):
        if (0, w) in count:
            return logs(0, w)
        for n in range(5, 0, -1):
            p = w if n == 1 else f" {w} "
            known = [logs(n, p[i : i + n]) for i in range(len(p) - n + 1) if (n, p[i : i + n]) in count]
            if known:
                return [sum(x) / len(known) for x in zip(*known)]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, DATA).collect()}
    assert len(got) == len(table)
    for r in table:
        words = words_of(r.text)
        own = got[r.doc_id]
        assert own.held_out == held_out(r.doc_id) and 0 <= own.score <= 1
        if not words:
            assert (own.lang_pred, own.score) == ("und", 0)
            continue
        sums = [math.fsum(x) for x in zip(*map(scores, words))]
        best = max(sums)
        assert sums[langs.index(own.lang_pred)] == pytest.approx(best, rel=1e-9)
        assert own.score == pytest.approx(1 / math.fsum(math.exp(s - best) for s in sums), rel=1e-6)


def test_rare_languages_are_learnt_from_as_many_rows(spark):
    assert langid.shares({"a": 1_000_000, "b": 30, "c": 2_000}, 3_000) == {"b": 1.0, "c": 1485 / 2_000, "a": 1485 / 1_000_000}
    rows = [(i, "the house and the tree" if i % 50 else "das haus und der baum", "en" if i % 50 else "de") for i in range(3_000)]
    rows = [(i, f"{t} {i}x" + "abcdefghij"[i % 10] * 3, x) for i, t, x in rows]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=120)
    assert model.predict("das haus")[0] == "de" and model.predict("the house")[0] == "en"


def test_toxicity_is_the_least_of_its_objective():
    """Against plain proximal gradients with one small step, run for long, on the whole matrix."""
    rng = np.random.default_rng(12)
    n, m = 80, 12
    x = (rng.random((n, m)) < 0.4).astype(float)
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.standard_normal(n) > 1).astype(float)
    docs = [np.flatnonzero(row) for row in x]
    swaps = toxicity.counterfactuals(docs, {f"t{i}": i for i in range(m)}, (("t0", "t2", "t3"),))
    assert len(swaps[0]) == sum(1 for d in docs for i in (0, 2, 3) for j in (0, 2, 3) if i in d and j not in d)

    def objective(w, b):
        z = x @ w + b
        loss = np.mean(np.logaddexp(0, z) - y * z) + np.abs(w).sum() / n + 5e-6 * w @ w
        return loss + np.mean((w[swaps[0]] - w[swaps[1]]) ** 2)

    w, b = np.zeros(m), 0.0
    for _ in range(20_000):
        off = (1 / (1 + np.exp(-(x @ w + b))) - y) / n
        gap = 2 * (w[swaps[0]] - w[swaps[1]]) / len(swaps[0])
        slope = x.T @ off + 1e-5 * w + np.bincount(swaps[0], gap, m) - np.bincount(swaps[1], gap, m)
        w = w - 0.1 * slope
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 / n, 0)
        b -= 0.1 * off.sum()
    got = toxicity.train(docs, y, m, swaps, steps=3_000)
    assert objective(*got) == pytest.approx(objective(w, b), abs=1e-6)


def test_the_query_pays_for_counterfactual_pairs(spark, tmp_path, caplog):
    """Labelled sentences with identity terms, through op7 itself: pairs are counted and neutral mentions stay below 0.3."""
    rng = np.random.default_rng(13)
    plain, terms = "tree house river stone cloud bread winter garden".split(), ("muslim", "christian", "jewish")
    rows, labels = [], []
    for i in range(900):
        toxic = int(rng.random() < 0.25)
        words = list(rng.choice(plain, 10))
        if toxic:
            words[2] = str(rng.choice(["vile", "awful"]))
        if rng.random() < (0.7 if toxic else 0.1):
            words[4] = "muslim"
        elif rng.random() < 0.2:
            words[4] = "christian"
        rows.append((i, " ".join(words)))
        labels.append((i, 0, toxic))
    neutral = [(1_000 + i, f"the {t} family by the river") for i, t in enumerate(terms)]
    spark.createDataFrame(rows + neutral, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with caplog.at_level(logging.INFO, logger=toxicity.__name__):
        got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, str(tmp_path)).collect()}
    said = next(r for r in caplog.records if "pairs" in r.getMessage())
    learnt = [(t.split(), y) for (i, t), (_, _, y) in zip(rows, labels) if not held_out(i)]
    assert said.args[0] == sum(len(s) - 1 for t, _ in learnt for s in toxicity.IDENTITY_TERMS for w in set(t) if w in s) > 500
    assert all(got[i].predicted == 0 for i, _ in neutral)
    scores = [got[i].score for i, _ in neutral]
    assert max(scores) - min(scores) < 0.05
    unfair = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), fairness=0.0)
    spread = [unfair.score(t) for _, t in neutral]
    assert max(spread) - min(spread) > 3 * (max(scores) - min(scores))


def test_term_sets_from_a_table(spark):
    rows = [("g", "Ab"), ("g", "cd"), ("h", "x"), (None, "y"), ("h", None), ("g", "ab")]
    assert toxicity.term_sets(spark.createDataFrame(rows, "set string, term string")) == (("ab", "cd"), ("x",))


def test_packing_holds_every_piece_of_the_tokenizer(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in table:
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], "<u4")
            want[r.doc_id, k] = (at, len(own), zlib.crc32(own.tobytes()))
    found = QUERIES["op8_packing"](spark, DATA).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert len(held) <= math.ceil(sum(n for _, n, _ in want.values()) / 4096) + 1


def test_plans_of_few_pieces_are_near_the_best_there_is():
    rng = np.random.default_rng(14)

    def best(lengths, room):
        n = len(lengths)
        least = [(n + 1, 0)] * (1 << n)
        least[0] = (0, room)  # bins, what is used of the last
        for have in range(1 << n):
            for i in range(n):
                if not have >> i & 1:
                    bins, used = least[have]
                    new = (bins, used + lengths[i]) if used + lengths[i] <= room else (bins + 1, lengths[i])
                    least[have | 1 << i] = min(least[have | 1 << i], new)
        return least[-1][0]

    over = 0
    for _ in range(60):
        lengths = rng.integers(1, 60, int(rng.integers(1, 10))).tolist()
        got = packing.plan(dict(Counter(lengths)), 64)[1]
        least = best(lengths, 64)
        assert least <= got <= least + 1
        over += got - least
    assert over <= 3


def test_patterns_are_all_that_fill_a_sequence():
    lengths = np.array([3, 5, 8, 11, 16, 20])
    got = {tuple(int(lengths[i]) for i in row if i >= 0) for row in packing.patterns(lengths, 24, 0)}
    want = {tuple(sorted(c, reverse=True)) for k in (1, 2, 3) for c in itertools.combinations_with_replacement(lengths.tolist(), k) if sum(c) == 24}
    assert got == want and {(16, 8), (8, 8, 8), (11, 8, 5)} < got


def test_shards_are_the_ring_dealt_row_by_row(spark, table):
    """One process, all rows sorted by place and hash: the same shards and slots."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text")).collect()
    places = defaultdict(list)
    for r in rows:
        places[(r.h & (2**64 - 1)) >> 52].append(r)
    nodes = sharding.ring(16)
    room = sharding.capacities(len(rows), 16, 1.0)
    taken = [0] * 16
    want, later = {}, []

    def walk(slot):
        at = next((i for i, (p, _) in enumerate(nodes) if p >= slot), 0)
        return [nodes[(at + s) % len(nodes)][1] for s in range(len(nodes))]

    def seat(own, shard):
        for r in own:
            want[r.doc_id] = (shard, taken[shard])
            taken[shard] += 1
            room[shard] -= 1

    order = lambda slot: sorted(places[slot], key=lambda r: ((r.h & (2**64 - 1)) << 12 >> 60 & 15, r.h, r.doc_id))
    for slot in sorted(places):
        own, home = order(slot), walk(slot)[0]
        if len(own) <= room[home]:
            seat(own, home)
        else:
            later.append(slot)
    parted = []
    for slot in later:
        own = order(slot)
        shard = next((s for s in walk(slot)[1:] if len(own) <= room[s]), None)
        if shard is None:
            parted.append(slot)
        else:
            seat(own, shard)
    for slot in parted:
        own = order(slot)
        for shard in walk(slot):
            n = min(len(own), room[shard])
            seat(own[:n], shard)
            own = own[n:]
    got = QUERIES["op4_sharding"](spark, DATA).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want
    text = {r.doc_id: r.text.encode() for r in rows}
    assert all(r["size"] == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_the_pipeline_on_empty_and_odd_tables(spark, tmp_path, case):
    """Every stage and the whole run: extra columns with clashing names, nulls, repeated rows, a long text, no rows."""
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars int, _doc string, row int, copy int, deal int, doc long, th long, _text string, _score double"
    long = " ".join(f"w{i % 701}q{i % 89}" for i in range(40_000))
    texts = [(1, None), (2, ""), (3, long), (4, long + " more"), (5, "one line\na line that many hold"), (6, "two lines\na line that many hold"), (6, "two lines\na line that many hold"), (None, "nobody"), (7, "\n \n")]
    rows = [(i, t, "en", "s" if i else None, 1, "d", 2, 3, 4, 5, 6, "t", 0.5) for i, t in texts] if case == "odd" else []
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 1, 1), (6, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    packed = pipeline.run(spark, str(tmp_path))
    if case == "empty":
        assert kept.count() == 0 and packed.count() == 0
        return
    left = {r.doc_id for r in pipeline.drop_near_duplicates(spark, pipeline.dedup_lines(spark, docs, ""), "").collect()}
    assert left == {1, 2, 3, 5, 6, 7, None}  # 4 is nearly 3, the repeated row went; the shared line stays in 5
    assert packed.filter("piece = 0").count() == kept.count()
    for name in ("op1_language_id", "op3_jaccard_join", "op4_sharding", "op5_mixing", "op7_toxicity", "op8_packing", "op9_line_dedup", "op10_suffix_dedup"):
        assert QUERIES[name](spark, str(tmp_path)).count() >= (len(rows) if name not in ("op5_mixing", "op8_packing") else 1), name
