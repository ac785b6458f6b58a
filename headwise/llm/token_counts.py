"""Token counts of whole texts by rank-synchronous array merging.

A task holds the pre-tokens of many texts as ragged arrays and merges, round by round, the pair of lowest rank of
every sequence at once (:mod:`headwise.llm.merging`); a text's count is the number of its surviving symbols.
"""
import pyarrow as pa
from pyspark.sql import functions as F

from headwise.llm import grams
from headwise.llm.common import fields
from headwise.llm.merging import ChunkIds, Merger
from headwise.llm.packing import default_tokenizer

LIMIT = 2048

_COUNTERS = {}


def counter(path):
    """The counter of this process for a vocabulary; its memory of chunks lasts from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = ChunkIds(Merger(path), counts_only=True)
    return _COUNTERS[path]


def count_tokens(docs, tokenizer=None, limit=LIMIT):
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs``.

    Counts are those of the vocabulary's own library without begin, end or added special tokens; the strings of
    special tokens inside a text count as one each, as the library does by default. Null and empty texts have no
    bytes and no tokens. Rows are counted one by one, so repeated rows and ids and null ids come back as often as
    they are; a text of any length is counted whole; an empty table gives none. Other columns are left out, whatever
    their names.
    """
    path = tokenizer or default_tokenizer()
    slim = fields(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))

    def run(batches):
        count = counter(path)
        for batch in batches:
            bodies = [b"" if t is None else t for t in batch.column("text").to_pylist()]
            sizes = [len(b) for b in bodies]
            for a, b in grams.slabs(sizes):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(sizes[a:b], pa.int64()), pa.array(count.counts_of(bodies[a:b]), pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    if kind == "void":
        slim, kind = slim.withColumn("doc_id", F.col("doc_id").cast("long")), "bigint"
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
