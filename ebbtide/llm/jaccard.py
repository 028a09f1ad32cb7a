"""Exact n-gram Jaccard join of whole texts by signature trees.

A text's set is its distinct word n-grams, as 64-bit hashes.  Texts of one set share a set id, so copies cost one
set.

*Blocks.*  Two sets that reach the threshold differ in few tokens: at most k, which their sizes bound.  Cut the hash range
into k + 1 + s classes: at least s + 1 classes are equal in both.  Each set emits a key for every class of more than w
tokens, w being the largest of 2, 1, 0 and -1 that leaves out s of its classes at most.  Of the s + 1 equal classes one has
more tokens than the larger w of two linked sets, so a linked pair always shares a key; sets of about the same size use
the same classes.  This holds for any choice of tokens that count in classes: those that different texts of a bounded
sample share (common passages, license lines) don't, so that they tie no blocks together.  Sets that share keys,
directly or through others, form a block: no link leaves a block.  Only one set for each key leaves a chunk of the input (its others are tied to it there), so that a key that a
third of all sets share is no group of that size anywhere.

*Trees.*  A block's sets are gathered once and joined by signature trees (see sigtree); large blocks are first cut into
cells by size and hash.  After each cell has linked its own sets, one set of each group meets those of the other cells,
and then the sets outside the block's largest group visit the other cells.  Sets known to be linked are never compared,
and only links that join groups are kept: no pairs of copies are listed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, documents, saved, settled
from .graph import components
from .sigtree import TokenSets, Tree, candidate_pairs, link
from .words import rows

CELL_SETS = 1_024
CELL_TOKENS = 1_000_000
CHUNK_KEYS = 400_000
SAMPLE = 4_000  # texts that common tokens are looked for in
SAMPLE_TOKENS = 512  # tokens of each, the lowest hashes
REDUCE_KEYS = 2_000_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the words, which ASCII space parts and whose A-Z are lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(own))
    total = np.full(len(own) - n + 1, n, np.uint64)
    for j in range(n):
        total = mixed((total ^ own[j : len(own) - n + 1 + j]) * _M1 + np.uint64(j))
    return np.unique(total)


@lru_cache(maxsize=None)
def levels(percent: int, top: int = 1 << 34) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By size level: its first size, the most tokens that a linked pair differs in, the classes to spare."""
    first = [1]
    while first[-1] < top:
        first.append(100 * first[-1] // percent + 1)
    last = np.array(first[1:], np.int64) - 1
    differ = (100 - percent) * last // percent
    return np.array(first[:-1], np.int64), differ, differ * 22 // 100 + 2


@lru_cache(maxsize=512)
def _bounds(m: int) -> np.ndarray:
    return np.array([-(-(c << 64) // m) for c in range(1, m)], np.uint64)


def level_of(size: int, percent: int) -> int:
    return int(np.searchsorted(levels(percent)[0], size, side="right")) - 1


def keys_of(tokens: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """The class keys of a set, at its own level and as the larger set at the level below.

    ``common``: sorted tokens that don't count in classes.
    """
    _, differ, spare = levels(percent)
    own = level_of(len(tokens), percent)
    if common is not None and len(common):
        tokens = tokens[common[np.searchsorted(common, tokens).clip(max=len(common) - 1)] != tokens]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ _M1))])
    found = []
    for level in (own, own - 1):
        if level >= 0 and differ[level]:
            m = int(differ[level] + 1 + spare[level])
            edge = np.concatenate([[0], np.searchsorted(tokens, _bounds(m)), [len(tokens)]])
            count = np.diff(edge)
            key = mixed((total[edge[1:]] - total[edge[:-1]]) * _M3 + (np.arange(m, dtype=np.uint64) << np.uint64(20)) * _M1 + np.array([level], np.uint64) * _M2 + count.astype(np.uint64))
            at_most = np.cumsum(np.bincount(np.minimum(count, 3), minlength=4))
            w = next((w for w in (2, 1, 0) if at_most[w] <= spare[level]), -1)
            found.append(key[count > w])
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def common_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Tokens that unlike texts of a bounded sample share, sorted.  A text of which half is known counts for nothing."""

    def lowest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shingles(t, n)[:SAMPLE_TOKENS].tobytes() for (t,) in rows(batch, 16)], pa.binary())], ["tokens"])

    chosen = bounded_sample(docs.select("doc", "text"), F.col("doc"), SAMPLE).select("text").limit(2 * SAMPLE)
    found = sorted(bytes(r["tokens"]) for r in chosen.mapInArrow(lowest, "tokens binary").collect())
    sets = [np.frombuffer(b, np.uint64) for b in found if b]
    names, at = np.unique(np.concatenate(sets), return_inverse=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, int))
    seen = np.zeros(len(names), np.int64)
    for own in np.split(at, np.cumsum([len(x) for x in sets])[:-1]) if sets else ():
        if 2 * np.count_nonzero(seen[own]) < len(own):
            seen[own] += 1
    return names[seen > 1]


def set_id(tokens: np.ndarray) -> int | None:
    return int.from_bytes(xxhash.xxh3_64_digest(tokens.tobytes()), "little", signed=True) if len(tokens) else None


def _summaries(n: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, at, text in rows(batch, 16):
                tokens = shingles(text, n)
                for own, x in zip(out, (doc, at, len(tokens), set_id(tokens)), strict=True):
                    own.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc", "th", "n", "sid"])

    return run


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each key, and links of its other sets to that one's set."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    hub = ids[head][np.cumsum(head) - 1]
    tied = ids != hub
    links = np.unique(np.stack([ids[tied], hub[tied]], axis=1), axis=0) if tied.any() else np.zeros((0, 2), np.int64)
    return keys[head], ids[head], links[:, 0], links[:, 1]


def _deal(parts: int, n: int, percent: int, common):
    """(part, keys, ids, a, b) of texts: entries by key, and links, in packed columns."""

    def pack(keys: list, ids: list):
        k, i, a, b = _stars(np.concatenate(keys), np.concatenate(ids))
        part = (k % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        side = np.linspace(0, len(a), parts + 1).astype(int)
        cut = lambda x, e: [x[e[p] : e[p + 1]].tobytes() for p in range(parts)]
        columns = [pa.array(range(parts), pa.int64()), *[pa.array(cut(x, e), pa.binary()) for x, e in ((k[order], edge), (i[order], edge), (a, side), (b, side))]]
        return pa.RecordBatch.from_arrays(columns, ["part", "keys", "ids", "a", "b"])

    def run(batches):
        known = common.value
        keys: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        seen: set[int | None] = {None}
        size = 0
        for batch in batches:
            for (text,) in rows(batch, 16):
                tokens = shingles(text, n)
                sid = set_id(tokens)
                if sid not in seen:
                    seen.add(sid)
                    keys.append(keys_of(tokens, percent, known))
                    ids.append(np.full(len(keys[-1]), sid, np.int64))
                    size += len(keys[-1])
                if size > CHUNK_KEYS:
                    yield pack(keys, ids)
                    keys, ids, seen, size = [], [], {None}, 0
        if size:
            yield pack(keys, ids)

    return run


def _meet(table: pa.Table) -> pa.Table:
    get = lambda c, t: np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x), t)
    _, _, a, b = _stars(get("keys", np.uint64), get("ids", np.int64))
    links = np.unique(np.stack([np.concatenate([a, get("a", np.int64)]), np.concatenate([b, get("b", np.int64)])], axis=1), axis=0)
    return pa.table({"a": links[:, 0], "b": links[:, 1]})


def _level(percent: int) -> Column:
    """One more than the size level of ``n`` tokens."""
    return F.size(F.filter(F.array(*[F.lit(int(x)) for x in levels(percent)[0] if x < 1 << 24]), lambda x: x <= F.col("n")))


def blocks_of(texts: DataFrame, sets: DataFrame, n: int, percent: int, common) -> DataFrame:
    """(v, root) of the sets that share keys.  Keys are made where they are dealt out: a table of them is as large as the input."""
    _, differ, spare = levels(percent)
    classes = np.where(differ > 0, differ + 1 + spare, 0)
    most = F.array(*[F.lit(int(x)) for x in classes + np.append(0, classes[:-1])])
    total = sets.agg(F.coalesce(F.sum(F.element_at(most, _level(percent))), F.lit(0))).first()[0]
    parts = max(1, -(-total // REDUCE_KEYS))
    dealt = texts.select("text").mapInArrow(_deal(parts, n, percent, common), "part long, keys binary, ids binary, a binary, b binary")
    return components(dealt.groupBy("part").applyInArrow(_meet, "a long, b long"))


def _tokens(n: int):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            keep = [i for i, c in enumerate(names) if c != "text"]
            found = [shingles(t, n).tobytes() for (t,) in rows(batch.select(["text"]), 16)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(found, pa.binary())], [*[names[i] for i in keep], "tokens"])

    return run


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, TokenSets]:
    """The sets of a cell, each once: ids, blocks, groups, tokens."""
    ids, first = np.unique(table.column("sid").to_numpy(), return_index=True)
    take = table.take(pa.array(first))
    group = take.column("group").to_numpy() if "group" in table.column_names else ids
    return ids, take.column("block").to_numpy(), group, TokenSets([np.frombuffer(x, np.uint64) for x in take.column("tokens").to_pylist()])


def _join_cell(percent: int):
    """Link the sets of each block in a cell: (sid, block, group), the group being the smallest id that is linked."""

    def run(table: pa.Table) -> pa.Table:
        ids, block, group, sets = _sets(table)
        labels = np.unique(group, return_inverse=True)[1]
        order = np.argsort(block, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            if len(members) > 1:
                tree = Tree(sets, members)
                link(sets, candidate_pairs(sets, tree, tree, percent, labels), labels, percent)
        least = np.full(labels.max() + 1 if len(labels) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, labels, ids)
        return pa.table({"sid": ids, "block": block, "group": least[labels]})

    return run


def _visit(percent: int):
    """Link visiting sets with the sets at home in a cell: links between groups (a, b)."""

    def run(table: pa.Table) -> pa.Table:
        ids, _, group, sets = _sets(table)
        first = np.unique(table.column("sid").to_numpy(), return_index=True)[1]
        home = table.column("home").to_numpy(zero_copy_only=False)[first].astype(bool)
        a, b = np.flatnonzero(~home), np.flatnonzero(home)
        names, labels = np.unique(group, return_inverse=True)
        links: list[tuple[int, int]] = []
        if len(a) and len(b):
            was = labels.copy()
            links, _ = link(sets, candidate_pairs(sets, Tree(sets, a), Tree(sets, b), percent, labels), labels, percent)
            links = [(names[was[x]], names[was[y]]) for x, y in links]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def jaccard_components(docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two texts link when ``100 * intersection >= percent * union`` of their sets of word ``n``-grams; a text of fewer words
    is one n-gram, and a text without words (or null) links with nothing.  component_id is the smallest doc_id that links
    reach, its own included; a null doc_id counts as none.  Repeated rows are in one component.
    """
    found = _linked(docs, n, percent, doc_id, text)
    return found.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def _linked(docs: DataFrame, n: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(doc, th, n, component, first) for every row: ``first`` is the smallest (nameless, doc, th) that links reach.

    th is a hash of the text; component and first are null for a text without words.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(value).alias("th"), value.alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_tokens(slim, n))
    summary = saved(slim.mapInArrow(_summaries(n), "doc long, th long, n long, sid long"))
    sets = saved(summary.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc").alias("least"), F.min(F.struct(F.col("doc").isNull().alias("nameless"), "doc", "th")).alias("of"), F.max("n").alias("n")))
    joined = settled(lambda: _joined(slim, sets, n, percent, common))
    whole = joined.unionByName(joined.select(F.col("root").alias("v"), "root").distinct()).withColumnRenamed("v", "sid")
    least = whole.join(sets.select("sid", "least", "of"), "sid")
    by_root = least.groupBy("root").agg(F.min("least").alias("component"), F.min("of").alias("first"))
    named = sets.select("sid", "least", "of").join(whole.join(by_root, "root").select("sid", "component", "first"), "sid", "left")
    named = named.select("sid", F.coalesce("component", "least").alias("component"), F.coalesce("first", "of").alias("first"))
    return summary.select("doc", "th", "n", "sid").join(named, "sid", "left").drop("sid")


def _joined(slim: DataFrame, sets: DataFrame, n: int, percent: int, common) -> DataFrame:
    """(v, root) of the sets that are linked, directly or through others."""
    roots = settled(lambda: blocks_of(slim, sets, n, percent, common))
    members = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct()).withColumnsRenamed({"v": "sid", "root": "block"})
    placed = members.join(sets, "sid").select("sid", "block", "n", F.col("of.doc").alias("doc"), F.col("of.th").alias("th"), _level(percent).alias("level"))
    placed = saved(placed)
    sizes = placed.groupBy("block").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    large = saved(sizes.filter((F.col("c") > CELL_SETS) | (F.col("t") > CELL_TOKENS)).select("block", F.lit(True).alias("large")))
    split = saved(placed.join(large.select("block"), "block", "left_semi").groupBy("block", "level").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CELL_SETS), F.ceil(F.sum("n") / CELL_TOKENS)).alias("k")))
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bundles = max(1, -(-total // CELL_TOKENS))
    celled = placed.join(split, ["block", "level"], "left").withColumn("cell", F.when(F.col("k").isNull(), F.pmod(F.xxhash64("block"), F.lit(bundles))).otherwise(F.xxhash64("block", "level", F.pmod(F.xxhash64("sid"), F.col("k")))))
    celled = celled.select("doc", "th", "sid", "block", "level", "cell", F.col("k").isNotNull().alias("large"))
    texts = slim.join(celled, (slim["doc"].eqNullSafe(celled["doc"])) & (slim["th"] == celled["th"])).select("sid", "block", "level", "cell", "large", "text")
    tokens = settled(lambda: texts.mapInArrow(_tokens(n), "sid long, block long, level int, cell long, large boolean, tokens binary"))
    local = settled(lambda: tokens.select("sid", "block", "cell", "tokens").groupBy("cell").applyInArrow(_join_cell(percent), "sid long, block long, group long"))
    links = local.select(F.col("sid").alias("a"), F.col("group").alias("b"))
    if not large.isEmpty():
        links = links.unionByName(_between_cells(tokens.filter("large").drop("large"), local, links, percent))
    return components(links)


def _between_cells(tokens: DataFrame, local: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between groups of different cells of large blocks."""
    grouped = tokens.join(local.select("sid", "group"), "sid")
    heads = grouped.filter("sid = group").select("sid", "block", F.pmod(F.xxhash64("block", F.pmod("sid", F.lit(4))), F.lit(1 << 40)).alias("cell"), "tokens")
    among = saved(_capped(heads).groupBy("cell").applyInArrow(_join_cell(percent), "sid long, block long, group long"))
    met = links.unionByName(among.select(F.col("sid").alias("a"), F.col("group").alias("b")))
    roots = components(met).withColumnsRenamed({"v": "sid", "root": "top"})
    known = saved(tokens.join(roots, "sid", "left").withColumn("group", F.coalesce("top", "sid")).drop("top"))
    counts = known.groupBy("block", "group").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("block").agg(F.max(F.struct("c", "group"))["group"].alias("most"))
    cells = known.select("block", "level", "cell").distinct()
    guests = known.join(largest, "block").filter("group <> most").withColumn("seat", F.pmod(F.xxhash64("sid"), F.lit(1 << 40)))
    width = guests.groupBy("block", "level").agg(F.ceil(F.count(F.lit(1)) / CELL_SETS).alias("chunks"))
    seated = guests.join(width, ["block", "level"]).withColumn("chunk", F.xxhash64("level", F.pmod(F.col("seat"), F.col("chunks"))))
    to = cells.select("block", F.col("level").alias("to_level"), F.col("cell").alias("to_cell"))
    visits = seated.join(to, "block").filter((F.col("cell") != F.col("to_cell")) & (F.abs(F.col("level") - F.col("to_level")) <= 1))
    visits = visits.select("sid", "block", "group", F.col("to_cell").alias("cell"), "chunk", F.lit(False).alias("home"), "tokens")
    expected = visits.select("cell", "chunk").distinct()
    hosts = known.select("sid", "block", "group", "cell", F.lit(True).alias("home"), "tokens").join(expected, "cell").select("sid", "block", "group", "cell", "chunk", "home", "tokens")
    found = visits.unionByName(hosts).groupBy("cell", "chunk").applyInArrow(_visit(percent), "a long, b long")
    return met.unionByName(settled(lambda: found))


def _capped(heads: DataFrame) -> DataFrame:
    """Heads dealt so that no cell has more than CELL_SETS of them on average; cells that stay apart meet as guests."""
    sizes = heads.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_SETS).alias("k"))
    return heads.join(sizes, "cell").withColumn("cell", F.xxhash64("cell", F.pmod(F.xxhash64("sid"), F.col("k")))).drop("k")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of all documents at 85 % of their 4-word shingles."""
    return jaccard_components(documents(spark, sf_dir), n=4, percent=85)


def near_duplicates_gone(docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component stays, that of the smallest doc_id, with all its columns.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id one stays in each component whose smallest doc_id that is;
    a text without words is a component of its own.
    """
    found = _linked(docs, n, percent, doc_id, text)
    is_first = F.col("first").isNull() | ((F.col("first.doc") == F.col("doc")) & (F.col("first.th") == F.col("th")))
    keep = found.filter(F.col("doc").isNotNull() & is_first).select("doc", "th").distinct()
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("doc"), F.xxhash64(value).alias("th"))
    staying = slim.join(keep, ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]).select("row.*")
    return staying.unionByName(docs.filter(F.col(doc_id).isNull())).select(docs.columns)


OP3_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END)), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM words
), hashes AS (
  SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS h FROM sets
), firsts AS (
  SELECT min(doc_id) AS doc_id, h, any_value(n) AS n FROM hashes WHERE n > 0 GROUP BY h
), tokens AS (
  SELECT doc_id, n, hash(unnest(s)) AS token FROM sets JOIN firsts USING (doc_id)
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT DISTINCT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT hashes.doc_id, hashes.n AS n_shingles, coalesce(least.component_id, firsts.doc_id, hashes.doc_id) AS component_id
FROM hashes LEFT JOIN firsts ON firsts.h = hashes.h AND hashes.n > 0 LEFT JOIN least ON least.doc_id = firsts.doc_id
"""
