"""Line dedup: exact reference-count tables behind sharded cuckoo filters.

The reference table has a row for each pair of a line's key and a document that holds it.  Inserting documents adds
their rows, deleting documents takes them away, and a key's reference count and its keeper (the smallest doc_id) follow
from the rows, so every decision can be undone.  Cuckoo filters, one for each shard of the keys, hold the keys with two
references or more: a key that an insertion brings to its second reference goes in, one that a deletion leaves with a
single one is taken out.  Filters are small, so they go to where the rows are and spare the lines that only one document
holds the shuffle to the counts.  What passes a filter is looked up in the exact counts: a false positive costs time, never
a line.

A shard is a range of keys, and the files of references are sorted by key.  Filters are sent in turns of up to
``FILTER_BYTES``, and a turn reads only the pages of its range: all turns together read the table about once.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved
from .cuckoo import CuckooFilter

SPACE = b" \t\n\x0b\x0c\r"
FILTER_BYTES = 64_000_000
SHARD_KEYS = 250_000


def line_keys(text: str | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the 16-byte digest of each key of at least ``least`` code points."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    found: list[bytes | None] = []
    for line in lines:
        key = line.strip(SPACE).lower()  # of bytes: only A-Z
        n = len(key)
        if n >= least and (n >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
            found.append(xxhash.xxh3_128_digest(key))
        else:
            found.append(None)
    return lines, found


def _references(least: int):
    def run(batches):
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is not None:
                    own = {k for k in line_keys(text, least)[1] if k}
                    ids.extend([doc] * len(own))
                    digests.extend(own)
            keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], ["doc", "k1", "k2"])

    return run


REFERENCE = ["k1", "k2", "doc"]
FILTER = "shard long, blob binary"


class LineIndex:
    """The reference table of a corpus (k1, k2, doc, each once), the exact counts of the keys that are shared, their filters.

    An index is not changed: insertions and deletions give a new one, with the counts and filters that they touch replaced.
    """

    def __init__(self, references: DataFrame, shared: DataFrame, filters: DataFrame, bits: int, least: int = 10):
        self.references, self.shared, self.filters, self.bits, self.least = references, shared, filters, bits, least

    @classmethod
    def of(cls, docs: DataFrame, least: int = 10, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        references = saved(_pairs(docs, least, doc_id, text).distinct().sortWithinPartitions("k2"))
        shared = saved(_counts(references).filter("refs >= 2"))
        bits = shard_bits(shared.count())
        return cls(references, shared, _built(shared, bits), bits, least)

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
        """With more documents.  Documents that are in already change nothing."""
        fresh = saved(_pairs(docs, self.least, doc_id, text).distinct().join(self.references, REFERENCE, "left_anti"))
        return self._with(self.references.unionByName(fresh), fresh)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the documents in the first column of ``doc_ids``."""
        ids = doc_ids.select(F.col(doc_ids.columns[0]).cast("long").alias("doc")).distinct()
        gone = saved(self.references.join(ids, "doc", "left_semi").select(*REFERENCE))
        return self._with(self.references.join(ids, "doc", "left_anti").select(*REFERENCE), gone)

    def _with(self, references: DataFrame, moved: DataFrame) -> LineIndex:
        """Counts and filters follow the keys of the references that have come or gone: ``moved``."""
        references, key = saved(references.sortWithinPartitions("k2")), ["k1", "k2"]
        touched = saved(moved.select(*key).distinct())
        now = saved(_counts(references.join(touched, key, "left_semi")).filter("refs >= 2"))
        was = self.shared.join(touched, key, "left_semi")
        shared = saved(self.shared.join(touched, key, "left_anti").unionByName(now))
        if shard_bits(shared.count()) > self.bits + 1:
            bits = shard_bits(shared.count())
            return LineIndex(references, shared, _built(shared, bits), bits, self.least)
        filters = _changed(self.filters, now.join(was, key, "left_anti"), was.join(now, key, "left_anti"), self.bits)
        full = filters.filter("blob IS NULL").select("shard")
        if not full.isEmpty():
            keys = shared.withColumn("shard", shard_of(F.col("k2"), self.bits)).join(full, "shard", "left_semi")
            filters = saved(filters.filter("blob IS NOT NULL").unionByName(_built(keys, self.bits)))
        return LineIndex(references, shared, filters, self.bits, self.least)

    def counts(self) -> DataFrame:
        """The exact reference counts: k1, k2, refs, keeper."""
        return _counts(self.references)

    def drops(self) -> DataFrame:
        """The lines to drop: doc, k1, k2 with another, smaller document as keeper."""
        spark = self.references.sparkSession
        turns = max(1, -(-self.filters.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0] // FILTER_BYTES))
        turn_bits = min(self.bits, (turns - 1).bit_length())
        passed = []
        for turn in range(1 << turn_bits):
            rows, own = self.references.select("doc", "k1", "k2"), self.filters
            if turn_bits:
                low = (turn << (64 - turn_bits)) - (1 << 63 if turn >= 1 << (turn_bits - 1) else 0) * 2
                rows = rows.filter(F.col("k2").between(low, low + (1 << (64 - turn_bits)) - 1))
                own = own.filter(F.shiftright("shard", self.bits - turn_bits) == turn)
            blobs = {r["shard"]: bytes(r["blob"]) for r in own.collect()}
            passed.append(rows.mapInArrow(_maybe(spark.sparkContext.broadcast(blobs), self.bits), "doc long, k1 long, k2 long"))
        rows = reduce(DataFrame.unionByName, passed)
        return rows.join(self.shared, ["k1", "k2"]).filter("doc > keeper").select("doc", "k1", "k2")


def _pairs(docs: DataFrame, least: int, doc_id: str, text: str) -> DataFrame:
    slim = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_references(least), "doc long, k1 long, k2 long").select(*REFERENCE)


def _counts(references: DataFrame) -> DataFrame:
    return references.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("refs"), F.min("doc").alias("keeper"))


def shard_bits(n_keys: int) -> int:
    """The bits of a key that name its shard."""
    return max(0, (max(n_keys, 1) - 1) // SHARD_KEYS).bit_length()


def shard_of(k2, bits: int):
    """The first bits of a key, of a column or an array."""
    if isinstance(k2, np.ndarray):
        return (k2.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k2), np.int64)
    return F.shiftrightunsigned(k2, 64 - bits) if bits else F.lit(0).cast("long")


def _blob(shard: int, held: CuckooFilter | None) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "blob": pa.array([held and held.dump()], pa.binary())})


def _built(shared: DataFrame, bits: int) -> DataFrame:
    """The filters of all keys of ``shared``."""

    def run(keys: pa.Table) -> pa.Table:
        return _blob(keys.column("shard")[0].as_py(), CuckooFilter.holding(keys.column("k1").to_numpy()))

    return saved(shared.select(shard_of(F.col("k2"), bits).alias("shard"), "k1").groupBy("shard").applyInArrow(run, FILTER))


def _changed(filters: DataFrame, came: DataFrame, left: DataFrame, bits: int) -> DataFrame:
    """The filters after deletions and insertions; one that has no room for all has a null blob."""

    def run(own: pa.Table, moved: pa.Table) -> pa.Table:
        shard = (own if own.num_rows else moved).column("shard")[0].as_py()
        k1, is_new = moved.column("k1").to_numpy(), moved.column("is_new").to_numpy(zero_copy_only=False).astype(bool)
        if not own.num_rows:
            return _blob(shard, CuckooFilter.holding(k1[is_new]))
        held = CuckooFilter.load(own.column("blob")[0].as_py())
        held.delete(k1[~is_new])
        try:
            held.insert(k1[is_new])
        except OverflowError:
            held = None
        return _blob(shard, held)

    moved = came.select("k1", "k2", F.lit(True).alias("is_new")).unionByName(left.select("k1", "k2", F.lit(False).alias("is_new")))
    placed = moved.select(shard_of(F.col("k2"), bits).alias("shard"), "k1", "is_new")
    return saved(filters.groupBy("shard").cogroup(placed.groupBy("shard")).applyInArrow(run, FILTER))


def _maybe(sent, bits: int):
    """The references whose key passes its shard's filter."""

    def run(batches):
        known = {s: CuckooFilter.load(b) for s, b in sent.value.items()}
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (1, 2))
            passes = np.zeros(len(k1), bool)
            shard = shard_of(k2, bits)
            for s in np.unique(shard).tolist():
                if s in known:
                    at = np.flatnonzero(shard == s)
                    passes[at] = known[s].contains(k1[at])
            yield batch.filter(pa.array(passes))

    return run


def _cut(least: int):
    def run(batches):
        for batch in batches:
            text_at, keys_at = (batch.schema.get_field_index(n) for n in ("_text", "_keys"))
            texts, n_lines, n_dropped = [], [], []
            for text, packed in zip(batch.column(text_at).to_pylist(), batch.column(keys_at).to_pylist(), strict=True):
                lines, keys = line_keys(text, least)
                drop = {k1.to_bytes(8, "little", signed=True) + k2.to_bytes(8, "little", signed=True) for k1, k2 in ((p["k1"], p["k2"]) for p in packed or ())}
                kept = [x for x, k in zip(lines, keys, strict=True) if k not in drop] if drop else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                texts.append(text if len(kept) == len(lines) else b"\n".join(kept).decode("utf-8", "surrogatepass"))
            arrays = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("_text", "_keys")}
            arrays |= {"_text": pa.array(texts, pa.string()), "_n_lines": pa.array(n_lines, pa.int64()), "_n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(arrays)

    return run


def dedup_lines(docs: DataFrame, *, least: int = 10, doc_id: str = "doc_id", text: str = "text", index: LineIndex | None = None) -> DataFrame:
    """The columns of ``docs`` with repeated lines gone from the text, as _doc, _text, _n_lines, _n_dropped.

    A line's key is the line without ASCII space at its ends, with A-Z lowered.  Keys of at least ``least`` code points
    that two documents hold lose all their lines except in the smallest doc_id.  A null or empty text is one empty line
    and stays as it is.  Rows with a null doc_id neither lose lines nor count.  Rows that repeat a doc_id are one document
    here, and each is cut alike.  ``index`` may hold a larger corpus than ``docs``.
    """
    index = index or LineIndex.of(docs, least, doc_id, text)
    drop = index.drops().groupBy("doc").agg(F.collect_list(F.struct("k1", "k2")).alias("_keys"))  # at most a document's own lines
    slim = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text] or [F.lit(1)]).alias("_doc"), F.col(text).cast("string").alias("_text"), F.col(doc_id).cast("long").alias("doc"))
    joined = slim.join(drop, "doc", "left").drop("doc")
    schema = f"_doc {slim.schema['_doc'].dataType.simpleString()}, _text string, _n_lines long, _n_dropped long"
    return joined.mapInArrow(_cut(index.least), schema)


def deduped(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with the same columns and the cut texts."""
    found = dedup_lines(docs, text=text, **options)
    return found.select(*[F.col("_text").alias(c) if c == text else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup keeps of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("_text", F.lit("")), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), told AS (
  SELECT keyed.doc_id, i, line, coalesce(keyed.doc_id > keeper, false) AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
