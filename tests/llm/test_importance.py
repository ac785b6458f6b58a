import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from headwise.llm import importance
from tests.llm import brute


def features(text, longest):
    words = brute.words(text, brute.LETTERS, lower=True)
    return [b" ".join(words[i: i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)


def plain(docs, items, longest=1, buckets=10_000, percent=10, least=20, seed=2024):
    """(doc_id, n_features, weight, score) of every document and the drawn ones' places, one after another."""
    corpus, target, per_doc = Counter(), Counter(), []
    for doc_id, text in docs:
        found, n_words = features(text, longest)
        found = [zlib.crc32(f) % buckets for f in found]
        corpus.update(found)
        per_doc.append((doc_id, n_words, found))
    for text in items:
        target.update(zlib.crc32(f) % buckets for f in features(text, longest)[0])
    size, wanted = sum(corpus.values()), sum(target.values())
    rows, able = [], []
    for at, (doc_id, n_words, found) in enumerate(per_doc):
        gains = [math.floor(1000 * math.log((target[b] + 1) * (size + buckets) / ((corpus[b] + 1) * (wanted + buckets)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(found), weight, score))
        if n_words >= least:
            able.append((-score, doc_id is None, doc_id or 0, at))
    drawn = {at: place + 1 for place, (*_, at) in enumerate(sorted(able)[: len(able) * percent // 100])}
    return sorted(((*row, drawn.get(at)) for at, row in enumerate(rows)), key=str)


def collected(frame):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect()), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["The", "the", "of", "ÜBER", f"w{rng.randrange(60)}", f"rare{rng.randrange(9999)}"]) for _ in range(rng.randrange(5, 60)))
            for _ in range(n)]


@pytest.mark.parametrize("longest, head", [(1, 8192), (1, 3), (2, 40), (3, 40)])
def test_matches_a_plain_version(spark, longest, head):
    docs, items = list(enumerate(texts(1, 150))), texts(2, 10)
    docs += [(200 + i, docs[3][1]) for i in range(60)]
    found = importance.resample(brute.documents(spark, docs).repartition(5), brute.documents(spark, items), longest, 500, 30, head=head)
    assert collected(found) == plain(docs, items, longest, 500, 30)


def test_awkward_rows(spark):
    docs = [*brute.awkward(), (60, "long word text " * 400_000), (61, "ab" * 600_000)]
    items = [None, "", "a b c", "same line"]
    found = importance.resample(brute.documents(spark, docs), brute.documents(spark, items), percent=60, least_words=2)
    assert collected(found) == plain(docs, items, percent=60, least=2)


def test_equal_scores_and_repeated_ids(spark):
    docs = [(7, "one and the same text")] * 300 + [(None, "one and the same text")] * 50 + [(8, "other words of a text")] * 50
    found = importance.resample(brute.documents(spark, docs), brute.documents(spark, ["text"]), percent=50, least_words=1)
    rows = collected(found)
    assert rows == plain(docs, ["text"], percent=50, least=1)
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, 201))


def test_empty_tables(spark):
    none, some = brute.documents(spark, []), brute.documents(spark, ["a few words", None])
    assert importance.resample(none, some).count() == 0
    assert collected(importance.resample(some, none, percent=100, least_words=1)) == plain([(0, "a few words"), (1, None)], [], percent=100, least=1)
    # Too few documents for a draw.
    assert all(r[4] is None for r in collected(importance.resample(some, some)))
