"""Benchmark decontamination by winnowing.

Of every ``GUARANTEE - K + 1`` consecutive windows of ``K`` words the one with the least hash is kept as a
fingerprint. Two texts that share ``GUARANTEE`` words share these windows, hence a fingerprint. Fingerprints
of documents and benchmark are joined, and around each hit the full windows of ``GUARANTEE`` words are
compared. Items with fewer words are one window of their own length, of which every place is kept.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from headwise.llm import grams
from headwise.llm.common import fields, write_and_read

GUARANTEE = 10
K = 5
_KIND = 0x9FB21C651E98DF25


def winnow(values, whole, span):
    """Places of the least value among each ``span`` consecutive ones from where ``whole`` holds; leftmost on ties."""
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place = values[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        here = values[j: n + j]
        less = here < best
        best[less] = here[less]
        place[less] = j
    return np.unique((np.arange(n) + place)[whole[:n]])


def _tagged(values, kind):
    """Hashes of windows of different lengths never meet by chance of equal sums."""
    return (values ^ np.uint64(kind * _KIND & (1 << 64) - 1)).view(np.int64)


def _fingerprints(hashes, first, lengths):
    """(kind, places, hashes): winnowed for the full length, all places for the shorter ``lengths``."""
    for kind in sorted({GUARANTEE, *lengths}):
        if kind == GUARANTEE:
            values, _ = grams.windows(hashes, first, K)
            _, whole = grams.windows(hashes, first, GUARANTEE)
            places = winnow(values, whole, GUARANTEE - K + 1)
        else:
            values, whole = grams.windows(hashes, first, kind)
            places = np.flatnonzero(whole)
        yield kind, places, _tagged(values[places], kind)


def _texts(batch):
    return [grams.encode(t) for t in batch.column("text").to_pylist()]


def document_fingerprints(keyed, lengths):
    """One row per fingerprint: doc_id, digest, kind, place, hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("kind", pa.int32()), ("place", pa.int64()), ("hash", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = _texts(batch)
            for a, b in grams.slabs([len(t) for t in texts]):
                hashes, first = grams.word_hashes(texts[a:b], grams.LETTERS)
                for kind, places, values in _fingerprints(hashes, first, lengths):
                    owner = np.searchsorted(first, places, side="right") - 1
                    ids = pa.array(owner + a)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(ids), batch.column("digest").take(ids),
                        pa.array(np.full(len(places), kind, np.int32)), pa.array(places - first[owner]), pa.array(values),
                    ], schema=schema)

    return keyed.mapInArrow(run, "doc_id long, digest long, kind int, place long, hash long")


def item_windows(items):
    """Of every item, its fingerprints and its full windows: item_id, kind, fingerprint or key and check."""
    def run(batches):
        for batch in batches:
            texts = _texts(batch)
            ids = batch.column("item_id").to_pylist()
            rows = []
            for item, text in zip(ids, texts):
                hashes, first = grams.word_hashes([text], grams.LETTERS)
                n = len(hashes)
                if not n:
                    continue
                kind = min(n, GUARANTEE)
                for found, _, values in _fingerprints(hashes, first, {kind}):
                    if found == kind:
                        rows += [(item, kind, int(v), None, None) for v in values]
                keys, whole = grams.windows(hashes, first, kind)
                checks = grams.check_windows(hashes, kind)
                rows += [(item, kind, None, int(k), int(c)) for k, c in zip(_tagged(keys[whole], kind), checks[whole].view(np.int64))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))
            ], names=["item_id", "kind", "fingerprint", "key", "check"])

    return items.mapInArrow(run, "item_id long, kind int, fingerprint long, key long, check long")


_WINDOWS = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()),
    T.StructField("key", T.LongType()), T.StructField("check", T.LongType()),
]))


def _candidates(text, hits):
    """The full windows around the hits of one document, and its number of words."""
    if not hits:
        return len(grams.words(text, grams.LETTERS)), []
    hashes, first = grams.word_hashes([text], grams.LETTERS)
    found = []
    for kind in sorted({h["kind"] for h in hits}):
        places = np.unique(np.array([h["place"] for h in hits if h["kind"] == kind], np.int64))
        if kind == GUARANTEE:
            places = np.unique((places[:, None] - np.arange(GUARANTEE - K + 1)).ravel())
        keys, whole = grams.windows(hashes, first, kind)
        places = places[(places >= 0) & (places < len(whole))]
        places = places[whole[places]]
        checks = grams.check_windows(hashes, kind)[places].view(np.int64)
        found += [
            {"start": s, "kind": kind, "key": k, "check": c}
            for s, k, c in zip(places.tolist(), _tagged(keys[places], kind).tolist(), checks.tolist())
        ]
    return len(hashes), found


def document_windows(joined):
    """doc_id, digest, n_words and candidate windows of every document with its hits."""
    def run(batches):
        for batch in batches:
            done = [_candidates(t, h) for t, h in zip(_texts(batch), batch.column("hits").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("digest"), pa.array([d[0] for d in done], pa.int64()),
                pa.array([d[1] for d in done], pa.list_(pa.struct([
                    ("start", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("check", pa.int64())]))),
            ], names=["doc_id", "digest", "n_words", "windows"])

    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("digest", T.LongType()),
        T.StructField("n_words", T.LongType()), T.StructField("windows", _WINDOWS),
    ])
    return joined.mapInArrow(run, schema)


def _same_document(left, right):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["digest"] == right["digest"])


def contamination(docs, items):
    """Words of documents inside any occurrence of a benchmark window.

    Returns doc_id, digest (of the text), n_words, n_hit, spans (merged [start, stop) word ranges), item_ids
    (sorted as strings) and contaminated. Documents are told apart by doc_id and text, so repeated rows
    each get the same result. Null or empty texts have no words; items without words have no windows; an item
    without item_id marks words but is not listed. Empty tables: no documents give no rows, no items no hits.
    """
    keyed = fields(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    windows = write_and_read(item_windows(fields(items, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), "text")), "item-windows")
    lengths = {r[0] for r in windows.select("kind").distinct().collect()}
    prints = windows.filter("fingerprint is not null").select(F.col("fingerprint").alias("hash")).distinct()
    prints = write_and_read(prints, "item-prints")
    hits = write_and_read(
        document_fingerprints(keyed, lengths).join(prints, "hash")
        .groupBy("doc_id", "digest").agg(F.collect_set(F.struct("kind", "place")).alias("hits")), "hits")
    joined = keyed.join(hits, _same_document(keyed, hits), "left").select(keyed["doc_id"], keyed["digest"], "text", "hits")
    judged = write_and_read(document_windows(joined), "candidates")

    whole = windows.filter("key is not null").select("item_id", "key", "check").distinct()
    matched = (
        judged.filter(F.size("windows") > 0).select("doc_id", "digest", F.inline("windows")).join(whole, ["key", "check"])
        .groupBy("doc_id", "digest").agg(
            F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("kind")).alias("stop")))).alias("found"),
            F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    empty = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    merged = F.aggregate("found", empty, lambda done, x: F.when(
        (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).stop >= x.start),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(done, F.lit(-1)).start.alias("start"),
            F.greatest(F.try_element_at(done, F.lit(-1)).stop, x.stop).alias("stop")))),
    ).otherwise(F.concat(done, F.array(x))))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x.stop - x.start)
    matched = matched.withColumn("spans", merged).withColumn("n_hit", covered).drop("found")
    base = judged.select("doc_id", "digest", "n_words")
    return base.join(matched, _same_document(base, matched), "left").select(
        base["doc_id"], base["digest"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", empty).alias("spans"),
        F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"))
