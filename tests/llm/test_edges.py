"""Every operator on nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import ann, covertree, jaccard, langid, line_dedup, mixing, packing, repeats, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, row string, th long, doc long, _text int, salt int, rank int"
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
LINE = "a line that several texts hold"


def docs_of(spark, texts):
    rows = [(i, t, lang, source, None, "x", "y", 1, 2, 3, 4, 5) for i, t, lang, source in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, LONG, "en", "a"),
        (4, LONG, "en", "a"),
        (5, f"one\n{LINE}\ntwo", "fr", "b"),
        (6, f"three\n  {LINE.upper()}\t\nfour", "fr", "b"),
        (6, f"three\n  {LINE.upper()}\t\nfour", "fr", "b"),
        (None, f"nobody\n{LINE}", "en", "a"),
        (7, "...", "en", None),
        (8, "solo", None, "c"),
        (9, " \n\t ", "en", "c"),
    ]
    return docs_of(spark, texts).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (6, 1, 0), (None, 0, 1), (8, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_language_id(docs, none):
    model = langid.fit(docs.filter("doc_id is not null"))
    found = {r["_doc"].doc_id: r for r in langid.identify(docs, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 7, 9)] == ["und"] * 4 and found[1].score == 0
    assert langid.identify(docs, model).count() == docs.count()
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"} and langid.identify(none, model).count() == 0


def test_toxicity(docs, none, labels):
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).select("_doc.doc_id", "_score").collect()
    assert len(found) == docs.count() and all(0 <= r["_score"] <= 1 for r in found)
    blank = {r["_score"] for r in found if r.doc_id in (1, 2, 7, 9)}
    assert len(blank) == 1
    assert {r["_score"] for r in toxicity.score(docs, toxicity.fit(none, labels)).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_jaccard(docs, none):
    found = jaccard.jaccard_components(docs, n=4, percent=85).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found}
    assert by[4].component_id == 3 and by[1].n_shingles == by[2].n_shingles == by[9].n_shingles == 0
    assert by[2].component_id == 2 and by[9].component_id == 9 and by[8].n_shingles == 1
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.near_duplicates_gone(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]


def test_near_duplicates_of_rows_that_repeat_a_doc_id(spark):
    """Different texts of one doc_id are documents of their own; a copy of a smaller doc_id goes, not its namesake."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    table = docs_of(spark, [(5, t, "en", "a") for t in (a, b, c, c)] + [(2, a, "en", "a"), (9, d, "en", "a"), (9, "...", "en", "a"), (9, d + " more", "en", "a"), (None, c, "en", "a")])
    kept = jaccard.near_duplicates_gone(table)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == table.columns and len(got) == 6
    assert {(2, a), (5, b), (5, c), (9, "..."), (None, c)} < set(got) and {t for i, t in got if i == 9} - {"..."} < {d, d + " more"}


def test_sharding(docs, none):
    found = sharding.shard_rows(docs, 3).collect()
    sizes = sorted(sum(r.shard == s for r in found) for s in range(3))
    assert len(found) == docs.count() and sizes[-1] - sizes[0] <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found))) for s in range(3))
    assert {r.size for r in found if r.doc_id in (1, 2)} == {1}
    assert sharding.shard_rows(none, 3).count() == 0


def test_mixing(docs, none):
    counts = mixing.copy_counts(docs).collect()
    assert len(counts) == docs.count()
    mixed = mixing.replicate(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.n_copies for r in counts)
    assert mixing.replicate(none).count() == 0
    only = mixing.copy_counts(docs, weights={"b": 1.0}).collect()
    assert all(r.n_copies == 0 for r in only if r.source != "b")
    with pytest.raises(ValueError):
        mixing.replicate(docs, weights={})


def test_packing(docs, none):
    found = packing.pack(docs).collect()
    assert sum(r.doc_id == 3 for r in found) > 1 and sum(r.doc_id == 6 for r in found) == 2
    assert all(len(r.ids) == r.length for r in found) and [r.ids for r in found if r.doc_id in (1, 2)] == [[1], [1]]
    assert packing.pack(none).count() == 0


def test_line_dedup(docs, none):
    found = {r["_doc"].doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert found[5]["_n_dropped"] == 0 and found[6]["_text"] == "three\nfour" and found[4]["_n_dropped"] == 1
    assert found[1]["_n_lines"] == found[2]["_n_lines"] == 1 and found[1]["_text"] is None
    assert found[None]["_n_dropped"] == 0
    cut = line_dedup.deduped(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count() and line_dedup.deduped(none).count() == 0


def test_line_dedup_filters_at_any_size(spark, monkeypatch):
    """Filters of more bytes than are sent at once go in turns, and the drops are the same."""
    table = docs_of(spark, [(i, "\n".join(f"line number {j}" for j in range(i, 200, i)), "en", "a") for i in range(1, 60)])
    index = line_dedup.LineIndex.of(table)
    want = sorted(map(tuple, index.drops().collect()))
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 400)
    index = line_dedup.LineIndex.of(table)
    drops = index.drops()
    assert drops._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") > 1
    assert want and sorted(map(tuple, drops.collect())) == want


def test_repeats(docs, none):
    found = [(r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs).collect()]
    n = len(LONG)
    assert len(found) == docs.count() and (3, n, n, 1) in found and (4, n, n, 1) in found and (1, 0, 0, 0) in found
    short = [(r.row.doc_id, r.n_removed) for r in repeats.remove_repeats(docs, length=40, anchor=16).collect()]
    assert short.count((6, len(f"three\n  {LINE}\t\nfour"))) == 2  # a row that is repeated starts its strings twice
    assert repeats.remove_repeats(none).count() == 0


VECTORS = [
    (0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [0.0, 0.0]),
    (101, [3.0]), (102, []), (None, [1.0, 1.0]), (103, [1.0, 2.0]), (104, [-5.0, 0.5]), (200, [float("inf"), 0.0]), (300, [1e18, -1e18]),
]


def test_vector_searches(spark):
    table = spark.createDataFrame([(i, x, i, 1, b"z") for i, x in VECTORS], "vec_id long, embedding array<double>, label long, rank int, blob binary")
    best = covertree.top_inner_products(table, lambda i: i % 20 == 0, 2).collect()
    asked = {q: [(r.rank, r.vec_id, r.score) for r in sorted(best, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in best}}
    assert set(asked) == {0, 20, 100, 300}
    one = 64 * 64 + 128 * 128
    assert asked[0] == [(1, 20, one), (2, 103, one)] and asked[20] == [(1, 0, one), (2, 103, one)]
    near = ann.nearest_found(table.filter("vec_id != 300"), lambda i: i % 20 == 0, 3).collect()
    got = {q: [r.vec_id for r in sorted(near, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in near}}
    assert got == {0: [20, 103, 104], 20: [0, 103, 104]}
    empty = table.filter("false")
    assert covertree.top_inner_products(empty, lambda i: i % 20 == 0, 2).count() == 0 and ann.nearest_found(empty, lambda i: i % 20 == 0, 2).count() == 0
    alone = table.filter("vec_id = 104")
    assert covertree.top_inner_products(alone, lambda i: i % 2 == 0, 2).count() == 0 and ann.nearest_found(alone, lambda i: i % 2 == 0, 2).count() == 0


def test_the_registry_names_all_ten(spark):
    from ebbtide.llm.registry import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_held_out_rows_are_those_of_the_contract(spark):
    import zlib

    from ebbtide.llm.common import held_out

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
