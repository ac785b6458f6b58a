"""Importance resampling of documents towards a target collection, by hashed word runs.

Each run of words is a feature in one of ``buckets`` buckets by CRC-32. The vocabulary has a head and a tail: the
CRC states of frequent words and the buckets of frequent pairs are computed once and sent to all tasks, and any
other feature takes its CRC directly, from the state of its first word on where that one is known. Head and tail
give the same numbers, so the head only saves work, and the bucket totals of both collections are exact. A
document's weight is the mean gain of its features; the draw adds Gumbel noise that depends on its id alone.
"""
import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from headwise.llm import grams
from headwise.llm.common import fields, write_and_read

BUCKETS = 10_000
#: Words, and pairs, of the head at most; a word must have at least this part of some task's words.
HEAD = 8192
#: Longer words stay in the tail, so that the head has a bounded size.
HEAD_BYTES = 64
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20


def _bodies(batch):
    return [b"" if t is None else t for t in batch.column("text").to_pylist()]


def _binary(texts, *names):
    return fields(texts, *names, "text").select(*names, F.col("text").cast("string").cast("binary").alias("text"))


def _frequent(texts, longest, size):
    """(words, pairs): the most frequent ones of all texts, each at most ``size``; a task drops what is rare in it."""
    def run(batches):
        counts, total = Counter(), 0
        for batch in batches:
            for body in _bodies(batch):
                words = grams.words(body, grams.LETTERS)
                total += len(words)
                counts.update(words)
                if longest > 1:
                    counts.update(map(b" ".join, zip(words, words[1:])))
                if len(counts) > 16 * size:
                    counts = Counter({w: n for w, n in counts.items() if n * size >= total})
        kept = [(w, n) for w, n in counts.items() if n * size >= total and len(w) <= HEAD_BYTES]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["feature", "n"])

    counted = _binary(texts).mapInArrow(run, "feature binary, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("pair", F.instr(F.col("feature").cast("string"), " ") > 0)
    best = Window.partitionBy("pair").orderBy(F.desc("n"), "feature")
    rows = counted.withColumn("_at", F.row_number().over(best)).filter(F.col("_at") <= size).collect()  # 2 * size at most
    return [bytes(r.feature) for r in rows if not r.pair], [bytes(r.feature) for r in rows if r.pair]


class Features:
    """Buckets of all runs of 1 to ``longest`` words of a text."""

    def __init__(self, words, pairs, longest, buckets):
        self.longest, self.buckets = longest, buckets
        self.states = {w: zlib.crc32(w) for w in words}
        self.pairs = {p: zlib.crc32(p) % buckets for p in pairs}

    def of(self, body):
        """(number of words, buckets of all features)."""
        words = grams.words(body, grams.LETTERS)
        states = list(map(self.states.get, words, repeat(-1)))
        states = [zlib.crc32(w) if s < 0 else s for w, s in zip(words, states)]
        found = [np.array(states, np.int64) % self.buckets]
        for k in range(2, self.longest + 1):
            if len(words) < k:
                break
            tails = [b" " + w for w in words[k - 1:]]
            known = list(map(self.pairs.get, map(b"".join, zip(words, tails)), repeat(-1))) if k == 2 else repeat(-1)
            states = [zlib.crc32(w, s) for w, s in zip(tails, states)] if k < self.longest else [
                b if b >= 0 else zlib.crc32(w, s) for w, s, b in zip(tails, states, known)]
            found.append(np.array(states, np.int64) % self.buckets)
        return len(words), np.concatenate(found)


def _totals(texts, features):
    """How many features of all texts are in each bucket."""
    def run(batches):
        totals = np.zeros(features.buckets, np.int64)
        for batch in batches:
            for body in _bodies(batch):
                totals += np.bincount(features.of(body)[1], minlength=features.buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[used])], ["bucket", "n"])

    counted = _binary(texts).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = [0] * features.buckets
    for row in counted.collect():  # one row a bucket at most
        totals[row.bucket] = row.n
    return totals


def gains(corpus, target):
    """Per bucket, the floored thousandfold log ratio of its smoothed shares in ``target`` and ``corpus``."""
    size, all_corpus, all_target = len(corpus), sum(corpus), sum(target)
    return [
        math.floor(1000 * math.log(float(t + 1) * float(all_corpus + size) / (float(s + 1) * float(all_target + size))))
        for s, t in zip(corpus, target)]


def _weights(docs, features, gain):
    gain = np.array(gain, np.int64)

    def run(batches):
        for batch in batches:
            rows = []
            for body in _bodies(batch):
                words, found = features.of(body)
                rows.append((words, len(found), int(gain[found].sum()) // len(found) if len(found) else 0))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    slim = _binary(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    return slim.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id, seed=SEED):
    """Thousandfold Gumbel noise of an id, floored; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _ranked(rows, drawn):
    """``rows`` with their places from 1 on by falling score, then doc_id; those beyond ``drawn`` have none.

    Rows are dealt by ranges of the whole order, repeated ids included, so no task holds more than its share
    however many rows have one score.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = write_and_read(dealt.select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))  # a row a partition
    place = F.col("_offset") + F.col("_at") - F.col("_first") + 1
    return placed.join(offsets.drop("_n"), "_part").withColumn("rank", F.when(place <= drawn, place))


def resample(docs, target, longest=1, buckets=BUCKETS, percent=PERCENT, least_words=LEAST_WORDS, seed=SEED, head=HEAD):
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; drawn rows are those with a rank.

    Words are runs of a-z, 0-9 and anything beyond ASCII after lower-casing A-Z. Null and empty texts have no
    features and weight 0. Of the rows with at least ``least_words`` words, ``percent`` in a hundred (rounded down)
    are drawn by highest score; ties go to the smaller doc_id, null ids last, and repeated rows take places one
    after another. An empty table gives none; an empty target leaves the gains of smoothed counts. Other columns
    are left out, whatever their names. A text of any length is read whole.
    """
    features = Features(*_frequent(docs, longest, head), longest, buckets)
    gain = gains(_totals(docs, features), _totals(target, features))
    scored = _weights(docs, features, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = write_and_read(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    # Scores are thousandfold logarithms, so there are some ten thousand different ones whatever the corpus.
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    by_score = scored.filter(able).groupBy("score").count().withColumn("_above", F.coalesce(F.sum("count").over(higher), F.lit(0)))
    least = by_score.filter(F.col("_above") < drawn).agg(F.min("score").alias("least")).first().least
    chosen = able & (F.col("score") >= (2**63 - 1 if least is None else least))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return _ranked(scored.filter(chosen), drawn).select(*names).union(rest.select(*names))
