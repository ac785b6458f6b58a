"""Packing of token pieces into sequences by the linear grouping scheme.

Lengths are small integers, so all that the optimiser needs is how many pieces have each length: a table of
at most ``capacity`` rows whatever the corpus. Large lengths are put in order and cut into groups of equally
many pieces; within a group all count as long as its longest. For these few sizes, column generation finds
the mix of full configurations that needs the fewest sequences. Actual pieces then take the places of their
group, and the pieces left over, the small ones among them, go by best fit, longest first, into the room that
remains. The plan maps (length, rank) ranges to sequences and offsets; Spark ranks the pieces and joins them.
"""
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from headwise.llm import grams
from headwise.llm.common import fields, rank_in_parts, write_and_read
from headwise.llm.merging import ChunkIds, Merger

CAPACITY = 2048
END_ID = 0
#: Lengths above this share of the capacity are large.
LARGE = 0.1
GROUPS = 32
PART_ROWS = 1024
#: Rows of the plan up to which it is broadcast; beyond, Spark chooses the join.
BROADCAST_ROWS = 200_000

_TOKENIZERS = {}


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs, tokenizer=None, capacity=CAPACITY, end_id=END_ID, keep_ids=True):
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids (little-endian bytes) of all documents.

    A document is its ids and one end id; only longer ones than ``capacity`` are cut, into full pieces and a
    last one. Null and empty texts are the end id alone.
    """
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = ChunkIds(Merger(path))
        step = 4 * capacity
        for batch in batches:
            bodies = [b"" if t is None else t for t in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in grams.slabs([len(t) for t in bodies]):
                rows = []
                for doc_id, body in zip(doc_ids[a:b], _TOKENIZERS[path].ids_of(bodies[a:b])):
                    body += end
                    for piece, at in enumerate(range(0, len(body), step)):
                        part = body[at: at + step]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    binary = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return binary.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def _best_pattern(sizes, worth, capacity):
    """The configuration of greatest worth that fits: an unbounded knapsack."""
    order = np.argsort(sizes)
    ascending, value = sizes[order], worth[order]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fitting = np.searchsorted(ascending, room, side="right")
        if fitting:
            gains = best[room - ascending[:fitting]] + value[:fitting]
            top = int(np.argmax(gains))
            if gains[top] > best[room] + 1e-12:
                best[room], choice[room] = gains[top], top
    pattern, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[order[choice[room]]] += 1
            room -= ascending[choice[room]]
    return pattern


def configurations(sizes, counts, capacity, rounds=2000):
    """(pattern, how many sequences) of a fractional optimum, rounded down; by column generation."""
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, float)
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amounts, prices = inverse @ counts, inverse.sum(axis=0)
        pattern = _best_pattern(sizes, np.maximum(prices, 0), capacity)
        if prices @ pattern <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.full(k, np.inf)
        np.divide(np.maximum(amounts, 0), step, out=ratio, where=step > 1e-9)
        basis[:, int(np.argmin(ratio))] = pattern
    amounts = np.linalg.solve(basis, counts)
    return [(basis[:, j].astype(np.int64), int(np.floor(amounts[j] + 1e-9))) for j in range(k) if amounts[j] >= 1]


class _Plan:
    """Places ranges of equally long pieces into ranges of sequences."""

    def __init__(self, counts, capacity):
        self.capacity = capacity
        self.left, self.next_rank = dict(counts), dict.fromkeys(counts, 0)
        self.rows, self.rooms, self.sequences = [], {}, 0
        self.lengths = sorted(counts)

    def place(self, length, count, sequence, offset):
        rank = self.next_rank[length]
        self.rows.append((length, rank, rank + count, sequence, offset))
        self.next_rank[length] += count
        self.left[length] -= count

    def open(self, count):
        first = self.sequences
        self.sequences += count
        return first

    def leave(self, sequence, count, used):
        if count and used < self.capacity:
            self.rooms.setdefault(self.capacity - used, []).append((sequence, count))

    def full_pieces(self):
        n = self.left.get(self.capacity, 0)
        if n:
            self.place(self.capacity, n, self.open(n), 0)

    def longest(self, least, most):
        """The longest length in [least, most] of which pieces are left, or None."""
        at = bisect_right(self.lengths, most)
        while at and not self.left[self.lengths[at - 1]]:
            del self.lengths[at - 1]
            at -= 1
        return self.lengths[at - 1] if at and self.lengths[at - 1] >= least else None

    def substitute(self, pattern, groups, times):
        """Fill ``times`` sequences of one configuration with actual pieces.

        Each place takes the longest piece left of its group, and the last place the longest piece of any
        group that still fits, so what rounding up has wasted is used. Where a group runs short, the rest
        of the sequences is left to the best fit.
        """
        places = [group for group, copies in enumerate(pattern) for _ in range(copies)]
        while times:
            taken, used = {}, 0
            chosen = []
            for i, group in enumerate(places):
                least, most = groups[group]
                last = i == len(places) - 1
                length = self.longest(least, self.capacity - used if last else min(most, self.capacity - used))
                if length is None or taken.get(length, 0) >= self.left[length]:
                    break
                chosen.append((length, used))
                taken[length] = taken.get(length, 0) + 1
                used += length
            if len(chosen) < len(places):
                return
            step = min(times, *(self.left[n] // k for n, k in taken.items()))
            first = self.open(step)
            for length, offset in chosen:
                self.place(length, step, first, offset)
            self.leave(first, step, used)
            times -= step

    def best_fit(self):
        """All pieces left, longest first, each into the least room that holds it."""
        for length in sorted((k for k, n in self.left.items() if n), reverse=True):
            while self.left[length]:
                room = min((r for r in self.rooms if r >= length), default=None)
                if room is None:
                    each = self.capacity // length
                    count = -(-self.left[length] // each)
                    sequence, used = self.open(count), 0
                else:
                    sequence, count = self.rooms[room].pop()
                    if not self.rooms[room]:
                        del self.rooms[room]
                    used = self.capacity - room
                    if count > self.left[length]:
                        self.leave(sequence + self.left[length], count - self.left[length], used)
                        count = self.left[length]
                self.place(length, count, sequence, used)
                self.leave(sequence, count, used + length)


def plan_sequences(counts, capacity=CAPACITY, large=LARGE, groups=GROUPS):
    """Rows (length, first rank, end rank, first sequence, offset) that place all pieces, and the sequences used.

    ``counts`` maps lengths to numbers of pieces. The piece of rank r in a row goes to the sequence
    first + r - first rank.
    """
    plan = _Plan(counts, capacity)
    plan.full_pieces()
    lengths = sorted((n for n in counts if large * capacity < n < capacity and counts[n]), reverse=True)
    size = -(-sum(counts[n] for n in lengths) // groups)
    ranges, held = [], size
    for length in lengths:
        if held >= size:
            ranges.append([length, length])
            held = 0
        ranges[-1][0] = length
        held += counts[length]
    if ranges:
        members = [sum(counts[n] for n in lengths if least <= n <= most) for least, most in ranges]
        for pattern, times in configurations([most for _, most in ranges], members, capacity):
            plan.substitute(pattern, ranges, times)
    plan.best_fit()
    return plan.rows, plan.sequences


def pack_documents(docs, tokenizer=None, capacity=CAPACITY, end_id=END_ID, keep_ids=False):
    """Every piece of every document with its sequence and its offset there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian bytes) if asked
    for. Repeated rows are packed one by one; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    slim = fields(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = token_pieces(slim, tokenizer, capacity, end_id, keep_ids)
    written = write_and_read(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in written.groupBy("length").count().collect()}  # capacity rows at most
    rows, _ = plan_sequences(counts, capacity)
    parts = spark.createDataFrame(
        [(n, -(-c // PART_ROWS)) for n, c in counts.items()], "length long, _parts long")
    plan = spark.createDataFrame(rows, "length long, _from long, _to long, _sequence long, offset long")
    parted = written.join(F.broadcast(parts), "length").withColumn(
        "_part", F.pmod(F.xxhash64("_row"), F.col("_parts"))).drop("_parts")
    ranked = rank_in_parts(parted, ["length"], ["_part"], ["_row"], "_rank").drop("_part", "_row")
    small = F.broadcast(plan) if len(rows) <= BROADCAST_ROWS else plan
    inside = (ranked["length"] == small["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(small, inside).drop(small["length"]).withColumn(
        "sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_from")
    ).drop("_rank", "_from", "_to", "_sequence")
