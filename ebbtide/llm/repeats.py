"""Exact removal of repeated byte strings with suffix arrays.

Every window of ``length`` bytes has an anchor: the place in it whose next bytes hash lowest.  Equal windows have equal
anchors at equal offsets, so only windows around equal anchors can repeat.  The windows of a text that share an anchor
lie side by side; the bytes that they cover are a *context*, on average one and a half windows long.

1. Contexts are counted by their hash.  Where two occurrences have one context, all its windows repeat: copies and long
   shared passages are settled here, whatever their number, by sums that are combined before the shuffle.
2. Contexts that are alone but share their anchor with others differ from them somewhere: one occurrence of each goes, with
   its bytes, to the bucket of its anchor.  There a suffix array is built by two-stage sorting (see suffixes), and windows
   that share ``length`` bytes with a neighbour in it repeat.
3. An anchor with more than ``GROUP`` contexts (a common passage amid different texts) would make a bucket of any size.  Its
   contexts are cut, by the offset of the anchor, into finer ones of 48, 12, 3 and at last single windows, and each
   goes through 1 and 2 again under the hash of the bytes that all its windows share.  What is left of such a group
   after each step is only the pieces at the passage's edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved
from .suffixes import alike, eights, stir, suffix_array
from .words import rows

LENGTH = 400
ANCHOR = 32  # bytes that make an anchor's hash
GROUP = 1_024  # contexts of one anchor that go to a suffix array together
BUCKET = 1_000_000  # bytes of a suffix array
GRAINS = (48, 12, 3, 1)
BATCH = 1 << 20  # bytes looked at together
_BITS = np.uint64((1 << 23) - 1)  # places that an anchor can have in what is looked at together
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchored_runs(texts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of texts end to end: which text, and the anchor, the first and the last window start of each run, with its hash.

    Together they have at most 2^23 bytes: an anchor's place is the low 23 bits of what is compared.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    if len(flat) > int(_BITS) + 1:
        raise ValueError(f"{len(flat)} bytes together")
    if len(flat) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    x8 = eights(flat, anchor)
    n = len(flat) - anchor + 1
    h = np.zeros(n, np.uint64)
    for k in range(0, anchor, 8):
        h += x8[k : k + n] * _C[k // 8 % 4] + np.uint64(k)
    h = stir(stir(h) * _C[0])
    least = sliding_least((h & ~_BITS) | np.arange(n, dtype=np.uint64), length - anchor + 1)
    end = np.cumsum(sizes)
    inside = np.ones(len(least) + 1, bool)  # windows that don't cross the end of a text; at least one that does parts two texts
    for e in end.tolist():
        inside[max(e - length + 1, 0) : e] = False
    inside[-1] = False
    new = np.ones(len(least) + 1, bool)
    new[1:-1] = least[1:] != least[:-1]
    lo = np.flatnonzero(inside[:-1] & (new[:-1] | ~np.append(False, inside[:-2])))
    hi = np.flatnonzero(inside[:-1] & (new[1:] | ~inside[1:]))
    at = (least[lo] & _BITS).astype(np.int64)
    return np.searchsorted(end, lo, side="right"), at, lo, hi, h[at]


def chunks_of(batch: pa.RecordBatch, size: int = BATCH):
    """Rows of a batch with up to about ``size`` bytes of text (the last column) together."""
    own: list[tuple] = []
    total = 0
    for row in rows(batch, 16):
        data = (row[-1] or "").encode("utf-8", "surrogatepass")
        if own and total + len(data) > size:
            yield own
            own, total = [], 0
        own.append((*row[:-1], data))
        total += len(data)
    if own:
        yield own


def pieces_of_long(data: bytes, length: int, size: int = 4 * BATCH) -> list[tuple[int, bytes]]:
    """A very long text in pieces that share length - 1 bytes: every window is in exactly one."""
    size = min(size, int(_BITS) + 2 - length)
    return [(at, data[at : at + size + length - 1]) for at in range(0, max(len(data) - length + 1, 1), size)]


def looked_at_together(parts: list[tuple], limit: int = int(_BITS) + 1):
    """Parts (the last column: their bytes) in order, in lists of up to ``limit`` bytes; no part alone has more."""
    own: list[tuple] = []
    total = 0
    for part in parts:
        if own and total + len(part[-1]) > limit:
            yield own
            own, total = [], 0
        own.append(part)
        total += len(part[-1])
    if own:
        yield own


def _contexts(length: int, anchor: int):
    """(doc, th, a, lo, hi, akey, c1, c2) for each run of windows."""

    def run(batches):
        for batch in batches:
            for group in chunks_of(batch):
                every = [(doc, th, at, part) for doc, th, data in group for at, part in pieces_of_long(data, length)]
                for parts in looked_at_together(every):
                    text, a, lo, hi, h = anchored_runs([p[3] for p in parts], length, anchor)
                    flat = b"".join([p[3] for p in parts])
                    begin = np.concatenate([[0], np.cumsum([len(p[3]) for p in parts])])[:-1]
                    shift = (begin - np.array([p[2] for p in parts], np.int64))[text] if len(text) else lo
                    names = [xxhash.xxh3_128_digest(flat[x : y + length], seed=z) for x, y, z in zip(lo.tolist(), hi.tolist(), (a - lo).tolist(), strict=True)]
                    name = np.frombuffer(b"".join(names), "<i8").reshape(-1, 2)
                    docs = pa.array([p[0] for p in parts], pa.int64()).take(pa.array(text))
                    ths = pa.array([p[1] for p in parts], pa.int64()).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([docs, ths, pa.array(a - shift), pa.array(lo - shift), pa.array(hi - shift), pa.array(h.view(np.int64)), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy())], ["doc", "th", "a", "lo", "hi", "akey", "c1", "c2"])

    return run


PIECE = "key long, c1 long, c2 long, n long, doc long, th long, lo long, a int, m long, data binary"


def _cut_out(length: int):
    """The bytes of the contexts listed for each document; ``a`` counts from the context's start from here on."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for doc, th, wanted, text in rows(batch, 4):
                data = (text or "").encode("utf-8", "surrogatepass")
                for w in wanted:
                    row = (w["akey"], w["c1"], w["c2"], w["n"], doc, th, w["lo"], w["a"] - w["lo"], w["m"], data[w["lo"] : w["hi"] + length])
                    for own, x in zip(out, row, strict=True):
                        own.append(x)
                if sum(map(len, out[9])) > BATCH:
                    yield _piece_batch(out)
                    out = [[] for _ in range(10)]
            yield _piece_batch(out)

    return run


def _piece_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["key", "c1", "c2", "n", "doc", "th", "lo", "a", "m", "data"])


def _finer(length: int, grain: int):
    """Cut contexts into those of at most ``grain`` windows, by the offset of their anchor."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for row in batch.to_pylist():
                data, a = row["data"], row["a"]
                start, windows = 0, len(data) - length + 1
                while start < windows:
                    j = (a - start) // grain  # the anchor is a - start bytes into the window
                    last = min(a - grain * j, windows - 1)
                    core = data[a - grain * j : a - grain * j - grain + 1 + length]
                    key = xxhash.xxh3_64_intdigest(core, seed=(row["key"] ^ (grain * 1_000 + j)) & (2**64 - 1))
                    own = data[start : last + length]
                    c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(own, seed=a - start), "<i8").tolist()
                    for x, y in zip(out, (key - (1 << 64) if key >> 63 else key, c1, c2, 1, row["doc"], row["th"], row["lo"] + start, a - start, 0, own), strict=True):
                        x.append(y)
                    start = last + 1
            yield _piece_batch(out)

    return run


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context the starts of those windows that are also in another place of any of them."""
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts], np.int64)
    end = np.cumsum(sizes)
    order = suffix_array(flat, length, np.arange(len(flat)) + length <= np.repeat(end, sizes))
    far = alike(order, flat, length)
    found = np.unique(np.concatenate([order[far], order[far - 1]]))
    return [x - e + s for x, e, s in zip(np.split(found, np.searchsorted(found, end[:-1])), end, sizes, strict=True)] if len(sizes) else []


def _by_suffixes(length: int):
    """Repeated bytes (doc, th, s, e) of the contexts of a bucket that no other occurrence settles."""

    def run(table: pa.Table) -> pa.Table:
        names = np.stack([table.column(c).to_numpy() for c in ("key", "c1", "c2")], axis=1)
        first = np.sort(np.unique(names, axis=0, return_index=True)[1])
        own = table.take(pa.array(first)).to_pylist()
        out: list[tuple] = []
        for row, starts in zip(own, repeated_starts([r["data"] for r in own], length), strict=True):
            if row["n"] == 1 and len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                for s, e in zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True):
                    out.append((row["doc"], row["th"], row["lo"] + s, row["lo"] + e + length))
        return pa.table({n: pa.array([x[i] for x in out], pa.int64()) for i, n in enumerate(("doc", "th", "s", "e"))})

    return run


SPAN = "doc long, th long, s long, e long"


def _sorted_out(pieces: DataFrame, length: int) -> DataFrame:
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // BUCKET)))).alias("bucket")
    return pieces.select(bucket, "*").groupBy("bucket").applyInArrow(_by_suffixes(length), SPAN)


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc, th, s, e): bytes s to e of a text are in strings of ``length`` bytes that start elsewhere too.

    ``docs`` has doc, th (a hash of the text) and text.  Spans of one text may touch, overlap or come twice.
    """
    found = saved(docs.select("doc", "th", "text").mapInArrow(_contexts(length, anchor), "doc long, th long, a long, lo long, hi long, akey long, c1 long, c2 long"))
    place = F.struct("doc", "th", "lo", "hi", "a")
    counted = saved(found.groupBy("akey", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")))
    twice = counted.filter("n > 1").select("akey", "c1", "c2")
    spans = found.join(twice, ["akey", "c1", "c2"], "left_semi").select("doc", "th", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    shared = counted.groupBy("akey").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    wanted = counted.join(shared, "akey").select("at.doc", "at.th", F.struct("akey", "c1", "c2", "n", "m", "at.lo", "at.hi", "at.a").alias("w"))
    by_doc = wanted.groupBy("doc", "th").agg(F.collect_list("w").alias("wanted"))  # at most a text's own runs
    texts = docs.join(by_doc, docs["doc"].eqNullSafe(by_doc["doc"]) & (docs["th"] == by_doc["th"])).select(docs["doc"], docs["th"], "wanted", "text")
    pieces = saved(texts.mapInArrow(_cut_out(length), PIECE))
    spans = spans.unionByName(_sorted_out(pieces.filter(F.col("m") <= GROUP), length))
    crowd = pieces.filter(F.col("m") > GROUP)
    for grain in GRAINS:
        if crowd.isEmpty():
            break
        cut = saved(crowd.dropDuplicates(["key", "c1", "c2"]).mapInArrow(_finer(length, grain), PIECE))
        names = ["key", "c1", "c2"]
        counts = saved(cut.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "lo")).alias("at")))
        whole = cut.join(counts.filter("n > 1").select(*names), names, "left_semi")
        spans = spans.unionByName(whole.select("doc", "th", F.col("lo").alias("s"), (F.col("lo") + F.octet_length("data")).alias("e")))
        many = counts.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        first = counts.join(many, "key").select(*names, "n", "m", F.col("at.doc").alias("doc1"), F.col("at.th").alias("th1"), F.col("at.lo").alias("lo1"))
        same = (F.col("doc").eqNullSafe(F.col("doc1"))) & (F.col("th") == F.col("th1")) & (F.col("lo") == F.col("lo1"))
        left = saved(cut.drop("n", "m").join(first, names).filter(same).select("key", "c1", "c2", "n", "doc", "th", "lo", "a", "m", "data"))
        spans = spans.unionByName(_sorted_out(left.filter(F.col("m") <= GROUP), length))
        crowd = left.filter(F.col("m") > GROUP)
    return spans


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _removed(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        for i in range(0, batch.num_rows, 16):
            part = batch.slice(i, 16)
            for spans, text in zip(part.column("spans").to_pylist(), part.column("text").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                runs = merged(spans)
                edges = [0, *[x for run in runs for x in run], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for own, x in zip(out, (len(data), len(data) - len(kept), len(runs), kept), strict=True):
                    own.append(x)
        arrays = [batch.column("row"), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, as a struct ``row``, with n_bytes, n_removed, n_spans and kept (bytes).

    Every byte goes that is in a string of ``length`` bytes which also starts anywhere else in the corpus, in the same text
    or another; matches never cross texts.  A null text is empty.  Rows that are repeated are texts of their own, so both
    lose what is long enough.  Null doc_ids are ids like others.  A cut may part a character: ``kept`` is bytes.
    """
    if not 8 <= anchor <= length <= int(_BITS) + 1:
        raise ValueError("anchor must be from 8 bytes to length, length at most 8 MiB")
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rest = [docs[f"`{c}`"] for c in docs.columns if c != text] or [F.lit(1)]
    slim = docs.select(F.struct(*rest).alias("row"), F.col(doc_id).cast("long").alias("doc"), F.xxhash64(value).alias("th"), value.alias("text"))
    spans = repeated_spans(slim, length=length, anchor=anchor)
    by_doc = spans.groupBy(F.col("doc").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct("s", "e")).alias("spans"))  # a text's own
    joined = slim.join(by_doc, slim["doc"].eqNullSafe(by_doc["d"]) & (slim["th"] == by_doc["t"]), "left").select("row", "text", "spans")
    return joined.mapInArrow(_removed, f"row {slim.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that start elsewhere too."""
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as two hexadecimal digits each; texts are cut into parts of 4,000 bytes, with those that their last windows need.
OP10_SQL = f"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents
), parts AS (
  SELECT doc_id, r, length(x) // 2 AS n, p, substr(x, 8000 * p + 1, {8000 + 2 * LENGTH - 2}) AS x FROM (SELECT *, unnest(range(0, greatest(length(x) // 2 - {LENGTH - 1}, 0) // 4000 + 1)) AS p FROM texts)
), windows AS (
  SELECT r, 4000 * p + i AS place, hash(substr(x, 2 * i + 1, {2 * LENGTH})) AS h FROM (SELECT r, p, x, unnest(range(0, least(4000, length(x) // 2 - {LENGTH - 1}))) AS i FROM parts)
), twice AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), starts AS (
  SELECT r, place, coalesce(place - lag(place) OVER (PARTITION BY r ORDER BY place) > {LENGTH}, TRUE) AS new FROM windows SEMI JOIN twice USING (h)
), runs AS (
  SELECT r, min(place) AS lo, max(place) + {LENGTH} AS hi FROM (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY r ORDER BY place) AS run FROM starts) GROUP BY r, run
), cuts AS (
  SELECT r, sum(hi - lo) AS gone, count(*) AS spans, list({{'lo': lo, 'hi': hi}} ORDER BY lo) AS cut FROM runs GROUP BY r
)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN cut IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(cut) + 1),
    lambda i: substr(x, CASE WHEN i = 0 THEN 1 ELSE 2 * cut[i].hi + 1 END, CASE WHEN i = len(cut) THEN length(x) ELSE 2 * cut[i + 1].lo - CASE WHEN i = 0 THEN 0 ELSE 2 * cut[i].hi END END)), '') END)) AS kept_sha256
FROM texts LEFT JOIN cuts USING (r)
"""
