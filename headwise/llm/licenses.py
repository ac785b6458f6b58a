"""License scan by diagonal voting.

All rolling two-word windows of the documents are joined to the places of the same windows in short license
templates. A hit votes for the diagonal (place in the document minus place in the template) of its template;
neighbouring diagonals, which small insertions and deletions separate, are merged, and the spans with enough
votes are verified word by word on the text.
"""
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F, types as T

from headwise.llm import grams
from headwise.llm.common import fields, write_and_read

# The phrases whose every place counts, and their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

# Customary license notices.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance "
     "with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("creative commons attribution", "cc-by"),
    ("all rights reserved", "all-rights-reserved"),
]
K = 2
#: Share of a notice's windows that a span must hold, in the template's order.
MIN_COVER = 0.7
#: Diagonals up to this far apart are merged.
NEIGHBOURS = 3


def _words(text):
    return text.encode().translate(grams.LETTERS).split()


def templates(phrases=None, notices=None):
    """(number, words, label, whole): whole templates must match word for word."""
    rows = [(w, label, True) for w, label in (PHRASES if phrases is None else phrases)]
    rows += [(w, label, False) for w, label in (NOTICES if notices is None else notices)]
    return [(i, _words(text), label, whole) for i, (text, label, whole) in enumerate(rows)]


def _windows(texts):
    hashes, first = grams.word_hashes(texts, grams.LETTERS)
    values, whole = grams.windows(hashes, first, K)
    places = np.flatnonzero(whole)
    return values[places].view(np.int64), places, first


def template_places(spark, known):
    """number, tpl_place and hash of every window of every template: a few hundred rows."""
    rows = []
    for number, words, _, _ in known:
        values, places, _ = _windows([b" ".join(words)])
        rows += [(number, int(p), int(v)) for p, v in zip(places, values)]
    return spark.createDataFrame(rows, "number int, tpl_place long, hash long")


def document_windows(keyed):
    """doc_id, digest, place and hash of all rolling windows."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("place", pa.int64()), ("hash", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [grams.encode(t) for t in batch.column("text").to_pylist()]
            for a, b in grams.slabs([len(t) for t in texts]):
                values, places, first = _windows(texts[a:b])
                owner = np.searchsorted(first, places, side="right") - 1
                ids = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(ids), batch.column("digest").take(ids),
                    pa.array(places - first[owner]), pa.array(values)], schema=schema)

    return keyed.mapInArrow(run, "doc_id long, digest long, place long, hash long")


def voted_spans(hits, needed):
    """Spans with enough votes: doc_id, digest and an array of (number, start, stop)."""
    diagonals = hits.groupBy("doc_id", "digest", "number", (F.col("place") - F.col("tpl_place")).alias("diagonal")).agg(
        F.count(F.lit(1)).alias("votes"), F.min("place").alias("start"), (F.max("place") + K).alias("stop"))
    order = Window.partitionBy("doc_id", "digest", "number").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS, F.lit(True))
    grouped = diagonals.withColumn("_new", apart.cast("int")).withColumn(
        "_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = grouped.groupBy("doc_id", "digest", "number", "_group").agg(
        F.sum("votes").alias("votes"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    enough = F.element_at(F.create_map(*[F.lit(x) for pair in needed.items() for x in pair]), F.col("number"))
    return spans.filter(F.col("votes") >= enough).groupBy("doc_id", "digest").agg(
        F.sort_array(F.collect_list(F.struct("number", "start", "stop"))).alias("spans"))


def _places(words, phrase):
    """Where the words of ``phrase`` stand consecutively."""
    k = len(phrase)
    return [i for i in range(len(words) - k + 1) if words[i] == phrase[0] and words[i: i + k] == phrase]


def _cover(words, notice):
    """Share of the notice's windows found in ``words`` in the notice's order, greedily."""
    at, found = 0, 0
    places = {}
    for i in range(len(words) - 1):
        places.setdefault((words[i], words[i + 1]), []).append(i)
    for pair in zip(notice, notice[1:]):
        known = places.get(pair, ())
        following = bisect_left(known, at)
        if following < len(known):
            at, found = known[following] + 1, found + 1
    return found / (len(notice) - 1)


def _merged(spans):
    done = []
    for start, stop in sorted(spans):
        if done and start <= done[-1][1]:
            done[-1][1] = max(done[-1][1], stop)
        else:
            done.append([start, stop])
    return done


def verify(text, spans, known):
    """n_words and the verified spans of one document as (number, start, stop, cover)."""
    words = grams.words(text, grams.LETTERS)
    found = []
    for number, template, _, whole in known:
        for start, stop in _merged([(s["start"], s["stop"]) for s in spans or () if s["number"] == number]):
            here = words[start:stop]
            if whole:
                found += [(number, start + p, start + p + len(template), 1.0) for p in _places(here, template)]
            else:
                cover = _cover(here, template)
                if cover >= MIN_COVER:
                    found.append((number, start, stop, cover))
    return len(words), found


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
        T.StructField("cover", T.DoubleType())]))),
])


def scan_licenses(docs, phrases=None, notices=None):
    """License phrases and notices of every document: the columns of ``RESULT``.

    Null and empty texts have no words and no labels; repeated rows each get the same result; documents are
    told apart by doc_id and text. The score is the best cover of a verified span, 1 for a whole phrase, 0
    without a label.
    """
    known = templates(phrases, notices)
    spark = docs.sparkSession
    keyed = fields(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    # The templates are constants of this module, so their size is bounded.
    hits = document_windows(keyed).join(F.broadcast(template_places(spark, known)), "hash")
    needed = {n: (len(w) - 1) if whole else max(1, int(MIN_COVER * (len(w) - 1))) for n, w, _, whole in known}
    spans = write_and_read(voted_spans(hits, needed), "license-spans")
    joined = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["doc_id"]) & (keyed["digest"] == spans["digest"]), "left").select(
        keyed["doc_id"], "text", "spans")
    arrow = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())])))])

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, voted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                n_words, found = verify(grams.encode(text), voted, known)
                base = [f for f in found if known[f[0]][3]]
                starts = [f[1] for f in base]
                rows.append({
                    "doc_id": doc_id, "n_words": n_words, "n_base": len(base),
                    "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted({known[f[0]][2] for f in base})),
                    "labels": ",".join(sorted({known[f[0]][2] for f in found})),
                    "score": float(max((f[3] for f in found), default=0.0)),
                    "spans": [{"label": known[f[0]][2], "start": f[1], "stop": f[2], "cover": float(f[3])} for f in found],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return joined.mapInArrow(run, RESULT)
