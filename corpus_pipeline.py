"""Documents to training sequences: language, near duplicates, repeated passages, benchmark leaks, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns it was given, the last one the packed pieces. :func:`run` writes the result of each stage to
the shared folder and reads it again for the next, so a lost executor repeats part of one stage only.

Rows are told apart by doc_id and text; nulls, empty texts and tables are treated as the operators say.
"""
from pyspark.sql import functions as F

from headwise.llm import decontamination, language, near_dedup, packing, substring
from headwise.llm.common import table, without, write_and_read


def known_language(spark, docs, sf_dir):
    """Documents whose language the network recognises; null texts, texts without letters and unlike any training document go."""
    return language.keep_known(docs)


def one_of_each_group(spark, docs, sf_dir):
    """One document of each group of near duplicates (five-word shingles); a repeated row stays once."""
    found = write_and_read(near_dedup.near_duplicates(docs), "near-duplicates")
    kept = without(docs, found.filter("not kept"))
    repeated = found.filter("kept").groupBy("doc_id", "digest").count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def first_passages(spark, docs, sf_dir):
    """Texts without the passages that stand earlier elsewhere; a document that loses all its words goes."""
    # The other columns go along as one, so that none clashes; the text only once.
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", *([F.struct(*others).alias("_row")] if others else []))
    found = substring.remove_repeats(packed).filter("n_removed = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    columns = {c: F.col(c) if c == "doc_id" else F.col(f"_row.`{c}`") for c in docs.columns if c != "text"}
    columns["text"] = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.char_length("kept_text").cast(
            docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*[columns[c].alias(c) for c in docs.columns])


def without_leaks(spark, docs, sf_dir):
    """Documents that share no window of words with the benchmark."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.filter("contaminated"))


def packed_sequences(spark, docs, sf_dir):
    """All documents as pieces in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", first_passages),
    ("decontamination", without_leaks),
    ("packing", packed_sequences),
]

#: A recurrent network and a packing have no form in SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
