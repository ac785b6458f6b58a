"""Plain versions of the operators' definitions, and awkward documents to run both on."""
import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    *[T.StructField(n, T.StringType()) for n in ("digest", "key", "n_words", "size", "score", "kept", "chunk", "slot")],
])
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def documents(spark, texts, lang="en", source="s"):
    """Rows of (doc_id, text) or texts with running ids, with extra columns that clash."""
    rows = []
    for i, item in enumerate(texts):
        doc_id, text = item if isinstance(item, tuple) else (i, item)
        rows.append((doc_id, text, lang, source, None if text is None else len(text), *["extra"] * 8))
    return spark.createDataFrame(rows, SCHEMA)


def awkward():
    """Null, empty, blank, one-word, repeated, long and odd texts; the last ids repeat and one is null."""
    rng = random.Random(3)
    long_text = " ".join(rng.choice(["a", "b", "c"]) + str(rng.randrange(50)) for _ in range(6000))
    texts = [None, "", " \t\r\n\x0b\x0c ", "one", "Ünï cödé ß \U0001f600 x\x00y", "#*$%&|<> <>", long_text, "x" * 20000,
             "same line\nsame line\n\nsame line", "a b c a b c a b c"]
    return [*enumerate(texts), (9, "a b c a b c a b c"), (9, "another text of the same id"), (None, "no id at all"), (None, None)]


def words(text, pattern=SPACED, lower=False):
    data = (text or "").encode()
    if lower:
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return pattern.findall(data)


def shingles(text, k):
    ws = words(text, SPACED, lower=True)
    return {tuple(ws[i: i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def groups(pairs, nodes):
    """Least node reachable from each node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near_groups(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(sets)
    pairs = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return groups(pairs, ids)


def kept_words(docs, window):
    """Per document in order: all words, and those that no repeated window covers."""
    seen, result = set(), []
    for _, text in docs:
        ws = words(text)
        gone = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s: s + window])
            if w in seen:
                gone[s: s + window] = [True] * window
            seen.add(w)
        result.append((ws, [w for w, g in zip(ws, gone) if not g]))
    return result
