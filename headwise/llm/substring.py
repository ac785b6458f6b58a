"""Exact substring deduplication by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``BLOCK`` words, and every rolling window of
``BLOCK`` words probes them. Two equal passages of ``WINDOW = 2 * BLOCK`` words always contain a whole block
of either text, so a passage that no probe hits cannot repeat. Around the hits the comparison is extended to
whole windows, and windows that start earlier elsewhere are merged to maximal repeats.

The corpus is packed into chunks of documents. Hashes are sorted within a chunk, each kept once, and sent as
differences; answers come back as bits in the same order. So a passage that every document holds costs one
entry per chunk, and no task ever sees all places of a passage.
"""
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from headwise.llm import grams, packed
from headwise.llm.common import power_of_two, write_and_read

WINDOW = 20
BLOCK = WINDOW // 2
CHUNK_BYTES = 2 << 20
#: Entries that one task compares, on average.
BUCKET_ENTRIES = 1_000_000
#: Bits of a probe beyond those that number all words: chance hits stay below one in 2**SPARE_BITS.
SPARE_BITS = 8
NULL_ID = np.iinfo(np.int64).min
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("removed_spans", T.ArrayType(T.LongType())), T.StructField("kept_text", T.StringType()),
])


def pack_chunks(docs, chunk_bytes=CHUNK_BYTES):
    """Documents in chunks: chunk, n_docs, n_words, body. Within a chunk they stand by doc_id and text, nulls first.

    Chunks are named by their partition and place in it, so a repeated task or run over the same files names them alike.
    """
    def run(batches):
        from pyspark import TaskContext

        names = (f"{TaskContext.get().partitionId():010d}-{n:08d}" for n in itertools.count())

        def chunk(rows):
            table = pa.Table.from_batches(rows).combine_chunks()
            table = table.take(pc.sort_indices(
                table, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start"))
            texts = [grams.encode(t) for t in table.column("text").to_pylist()]
            n_words = sum(int(grams.word_hashes(texts[a:b], grams.SPACED)[1][-1]) for a, b in grams.slabs(list(map(len, texts))))
            return pa.RecordBatch.from_pylist([{
                "chunk": next(names), "n_docs": table.num_rows, "n_words": n_words, "body": packed.pack_table(table),
            }], schema=CHUNKS)

        held, size = [], 0
        for batch in batches:
            lengths = [len(t or "") + 64 for t in batch.column("text").to_pylist()]
            for start, stop in grams.slabs(lengths, max(1, chunk_bytes)):
                part = batch.slice(start, stop - start)
                held.append(part)
                size += sum(lengths[start:stop])
                if size >= chunk_bytes:
                    yield chunk(held)
                    held, size = [], 0
        if held:
            yield chunk(held)

    return docs.mapInArrow(run, "chunk string, n_docs long, n_words long, body binary")


CHUNKS = pa.schema([("chunk", pa.string()), ("n_docs", pa.int64()), ("n_words", pa.int64()), ("body", pa.binary())])
ENTRIES = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("n", pa.int64()), ("body", pa.binary())])
ANSWERS = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])


class _Chunk:
    """The words of a chunk and, in order of hash, its distinct probes and candidate windows."""

    def __init__(self, body, bits):
        self.table = packed.unpack_table(body)
        self.texts = [grams.encode(t) for t in self.table.column("text").to_pylist()]
        parts, counts = [], []
        for a, b in grams.slabs([len(t) for t in self.texts]):
            hashes, first = grams.word_hashes(self.texts[a:b], grams.SPACED)
            parts.append(hashes)
            counts.append(np.diff(first))
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        values, self.whole = grams.windows(self.hashes, self.first, BLOCK)
        self.places = np.flatnonzero(self.whole)
        self.probes, self.inverse, times = np.unique(
            values[self.places] >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        in_text = self.places - np.repeat(self.first[:-1], self.counts)[self.places]
        self.flags = (times > 1).astype(np.uint8)
        self.flags[self.inverse[in_text % BLOCK == 0]] |= 2

    def candidates(self, hit):
        """Distinct windows with a hit inside: starts, index of each start's window, keys, checks, first starts."""
        marks = np.zeros(len(self.hashes) + 1, np.int64)
        marks[self.places + 1] = hit[self.inverse]
        marks = np.cumsum(marks)
        values, whole = grams.windows(self.hashes, self.first, WINDOW)
        starts = np.flatnonzero(whole)
        starts = starts[marks[starts + BLOCK + 1] > marks[starts]]
        keys = values[starts]
        checks = (grams.check_windows(self.hashes, WINDOW)[starts] >> np.uint64(48)).astype(np.uint16)
        order = np.lexsort((starts, checks, keys))
        k, c = keys[order], checks[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        return starts, index, k[new], c[new], starts[order][new]


def _rows(batches):
    """The rows of all batches, one at a time: a chunk is given back before the next one is read."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            pa.default_memory_pool().release_unused()


def _cut(values, bits, buckets):
    """Ranges of ascending ``values`` by their topmost bits."""
    edges = np.arange(1, buckets, dtype=np.uint64) << np.uint64(bits - int(math.log2(buckets)))
    cuts = np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))
    return [(b, int(cuts[b]), int(cuts[b + 1])) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def _joined_bits(answers):
    """The answers of all buckets in order: one bit per entry of the chunk."""
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]) for a in sorted(answers or [], key=lambda a: a["bucket"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _probe_entries(bits, buckets):
    def run(batches):
        for row in _rows(batches):
            chunk = _Chunk(row["body"], bits)
            yield pa.RecordBatch.from_pylist([{
                "bucket": b, "chunk": row["chunk"], "n": stop - start,
                "body": packed.pack_sorted(chunk.probes[start:stop]) + chunk.flags[start:stop].tobytes(),
            } for b, start, stop in _cut(chunk.probes, bits, buckets)], schema=ENTRIES)
    return run


def _answer(rows, sizes, order, keep):
    """Split per-entry answers, given in ``order``, by the rows they came from."""
    bits = np.empty(len(order), bool)
    bits[order] = keep
    cuts = np.cumsum(sizes)[:-1]
    return pa.Table.from_pylist([
        {"chunk": r["chunk"], "bucket": r["bucket"], "n": r["n"], "bits": np.packbits(part).tobytes()}
        for r, part in zip(rows, np.split(bits, cuts))
    ], schema=ANSWERS)


def _match_probes(table):
    """Of one bucket: the probes that hit a reference block elsewhere, or are one that others hit."""
    rows = table.to_pylist()
    sizes = [r["n"] for r in rows]
    values = np.concatenate([packed.unpack_sorted(r["body"][: -r["n"]]) for r in rows])
    flags = np.concatenate([np.frombuffer(r["body"][-r["n"]:], np.uint8) for r in rows])
    order = np.argsort(values, kind="stable")
    sorted_values, sorted_flags = values[order], flags[order]
    new = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    times = np.add.reduceat(1 + (sorted_flags & 1).astype(np.int64), new)
    blocks = np.maximum.reduceat(sorted_flags & 2, new)
    hit = (times > 1) & (blocks > 0)
    return _answer(rows, sizes, order, np.repeat(hit, np.diff(np.append(new, len(order)))))


def _window_entries(bits, buckets):
    def run(batches):
        for row in _rows(batches):
            chunk = _Chunk(row["body"], bits)
            _, _, keys, checks, firsts = chunk.candidates(_joined_bits(row["hits"]))
            ids = chunk.table.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy()
            docs = ids[np.searchsorted(chunk.first, firsts, side="right") - 1] if len(firsts) else ids[:0]
            yield pa.RecordBatch.from_pylist([{
                "bucket": b, "chunk": row["chunk"], "n": stop - start,
                "body": b"".join(len(x).to_bytes(4, "little") + x for x in (
                    packed.pack_sorted(keys[start:stop]), packed.pack(checks[start:stop]), packed.pack(docs[start:stop]))),
            } for b, start, stop in _cut(keys, 64, buckets)], schema=ENTRIES)
    return run


def _three(body):
    for _ in range(3):
        n = int.from_bytes(body[:4], "little")
        yield body[4: 4 + n]
        body = body[4 + n:]


def _match_windows(table):
    """Of one bucket: the windows that start earlier in another chunk."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    sizes = [r["n"] for r in rows]
    parts = [list(_three(r["body"])) for r in rows]
    keys = np.concatenate([packed.unpack_sorted(p[0]) for p in parts])
    checks = np.concatenate([packed.unpack(p[1]) for p in parts])
    docs = np.concatenate([packed.unpack(p[2]) for p in parts])
    chunk = np.repeat(np.arange(len(rows)), sizes)
    order = np.lexsort((chunk, docs, checks, keys))
    k, c = keys[order], checks[order]
    later = np.zeros(len(order), bool)
    later[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    return _answer(rows, sizes, order, later)


def _remove(schema, bits):
    names = [f.name for f in schema]

    def run(batches):
        for row in _rows(batches):
            chunk = _Chunk(row["body"], bits)
            starts, index, keys, _, firsts = chunk.candidates(_joined_bits(row["hits"]))
            later = np.zeros(len(keys), bool)
            answers = _joined_bits(row["later"])
            later[: len(answers)] = answers
            repeated = starts[later[index] | (starts != firsts[index])] if len(starts) else starts
            edges = np.zeros(len(chunk.hashes) + 1, np.int64)
            np.add.at(edges, repeated, 1)
            np.add.at(edges, repeated + WINDOW, -1)
            gone = np.cumsum(edges)[:-1] > 0
            kept, spans, removed = [], [], []
            for i, text in enumerate(chunk.texts):
                a, b = chunk.first[i], chunk.first[i + 1]
                tokens, mask = text.split(), gone[a:b]
                n = int(mask.sum())
                if n:
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                    spans.append(turns.astype(np.int64).tolist())
                    tokens = [t for t, m in zip(tokens, mask.tolist()) if not m]
                else:
                    spans.append([])
                removed.append(n)
                kept.append(b" ".join(tokens).decode("utf-8", "surrogatepass"))
            table = chunk.table
            columns = [table.column(f) for f in names[: -len(ADDED)]]
            arrays = [*columns, pa.array(chunk.counts, pa.int64()), pa.array(removed, pa.int64()),
                      pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string())]
            yield from pa.table(arrays, names=names).to_batches()
    return run


def remove_repeats(docs, chunk_bytes=CHUNK_BYTES, bucket_entries=BUCKET_ENTRIES):
    """Mark every word that a repeated window of 20 words covers, unless the window starts there first.

    Returns the columns of ``docs`` (doc_id and text among them) and n_words, n_removed, removed_spans (starts
    and ends of the maximal repeats by turns, in words) and kept_text (the other words, joined by one space).
    Columns of these names in ``docs`` are replaced. Null and empty texts have no words and keep "". Documents
    that share a doc_id count in the order of the input's partitions and chunks, within one by text, which is the
    same in every run over the same files; a null doc_id comes before all others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED.names)
    chunks = write_and_read(pack_chunks(docs, chunk_bytes), "chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = power_of_two(max(tasks, total // bucket_entries))
    bits = min(64, max(1, total).bit_length() + SPARE_BITS + int(math.log2(buckets)) // 8)
    bits = max(bits, int(math.log2(buckets)) + 1)
    entries = "bucket int, chunk string, n long, body binary"
    answers = "chunk string, bucket int, n long, bits binary"

    def gathered(found, name):
        return found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name))

    hits = write_and_read(gathered(
        chunks.select("chunk", "body").mapInArrow(_probe_entries(bits, buckets), entries)
        .groupBy("bucket").applyInArrow(_match_probes, answers), "hits"), "probe-hits")
    probed = chunks.select("chunk", "body").join(hits, "chunk", "left")
    later = write_and_read(gathered(
        probed.mapInArrow(_window_entries(bits, buckets), entries)
        .groupBy("bucket").applyInArrow(_match_windows, answers), "later"), "window-hits")
    schema = T.StructType([*docs.schema.fields, *ADDED.fields])
    return probed.join(later, "chunk", "left").mapInArrow(_remove(schema, bits), schema)
