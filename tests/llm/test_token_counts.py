import os
import random

import numpy as np
import pytest

import public_tokenizers
from headwise.llm import catalog, token_counts
from headwise.llm.merging import LONG, ChunkIds, Merger
from tests.llm import brute

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def odd_texts():
    rng = random.Random(4)
    texts = ["", " \n\t", "x" * (3 * LONG), "".join(rng.choice("abcdefgh") for _ in range(5 * LONG)), "don't it'll I'VE ''s",
             "a<|endoftext|>b<|startoftext|> <|ENDOFTEXT|>", "İstanbul ΑΣ ſ ß é é ½ ２ \x85x\xa0y z", "a\x1cb\x00c", "😀👍🏽 hé"]
    texts += ["".join(rng.choice("aA'sbtlre<|>019 éß\n") for _ in range(150)) for _ in range(100)]
    texts += ["a" + chr(a) + "b" + chr(a) + "1" for a in range(0x260)]
    texts += ["".join(chr(rng.randrange(0, 0x3000)) for _ in range(100)) for _ in range(100)]
    return texts


@pytest.mark.parametrize("path", [WORDS, BYTES])
@pytest.mark.parametrize("remembered", [50, 10**6])
def test_ids_are_those_of_the_library(path, remembered):
    texts, tokenizer = odd_texts(), library(path)
    want = [np.array(c.ids, "<u4").tobytes() for c in tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, counts = (ChunkIds(Merger(path), only, remembered) for only in (False, True))
    bodies = [t.encode() for t in texts]
    for start in range(0, len(texts), 70):
        part = slice(start, start + 70)
        assert ids.ids_of(bodies[part]) == want[part]
        assert counts.counts_of(bodies[part]).tolist() == [len(w) // 4 for w in want[part]]


def test_invalid_bytes_count_as_replaced():
    bodies = [b"ab\xc3 \xc3", b"plain \xff\xfe words", "a\u00d7b \u023a\u023e \u00f7".encode(), b" lead <b <|> trail \n\n"]
    want = [np.array(library(WORDS).encode(b.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for b in bodies]
    assert ChunkIds(Merger(WORDS)).ids_of(bodies) == want
    assert [ChunkIds(Merger(WORDS)).ids_of([b])[0] for b in bodies] == want


def test_words_are_looked_up_once_and_plain_ones_split_without_the_pattern(monkeypatch):
    from headwise.llm import merging

    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    class Pattern:
        given = ""

        def findall(self, lines):
            Pattern.given += lines
            return split.findall(lines)

    split = merging._SPLIT_LINES
    monkeypatch.setattr(merging, "_SPLIT_LINES", Pattern())
    ids, text = ChunkIds(Merger(WORDS)), "Same words, 12 (or 13) größer; don't! " * 500 + "end"
    ids.recent = Counted()
    assert ids.ids_of([text.encode()] * 3) == 3 * [np.array(library(WORDS).encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert Counted.asked == len(set(text.split()))
    assert Pattern.given.split() == ["don't!"]


def test_pairs_that_share_a_slot_keep_their_ranks():
    merger = Merger(WORDS)
    assert np.array_equal(merger.pairs.ranks(merger.left, merger.right), np.arange(len(merger.left)))
    known = set(zip(merger.left.tolist(), merger.right.tolist()))
    others = np.random.default_rng(3).integers(0, 49_000, (2, 50_000)).astype(np.int32)
    found = merger.pairs.ranks(*others) != 2**31 - 1
    assert found.tolist() == [pair in known for pair in zip(*others.tolist())]


def test_long_sequences_merge_as_short_ones(monkeypatch):
    from headwise.llm import merging
    merger, rng = Merger(WORDS), random.Random(2)
    pieces = ["".join(rng.choice("abct") for _ in range(rng.randrange(1, 300))).encode() for _ in range(50)] + [b"a" * n for n in range(1, 20)]
    data, lengths = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces])
    short = merger.merge(data, lengths)
    monkeypatch.setattr(merging, "LONG", 2)
    monkeypatch.setattr(merging, "BATCH_SYMBOLS", 500)
    long = merger.merge(data, lengths)
    assert all(np.array_equal(a, b) for a, b in zip(short, long))


def test_other_models_are_refused(tmp_path):
    import json
    with open(WORDS, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "reversed.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        Merger(str(path))


def test_query_counts_as_the_library(spark):
    folder = "/root/testdata/sf0.01"
    tokenizer = library(WORDS)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = catalog.op13_token_counts(spark, folder).collect()
    assert len(rows) == len(docs)
    names = list(docs)
    want = dict(zip(names, tokenizer.encode_batch([docs[n] for n in names], add_special_tokens=False)))
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len(docs[r.doc_id].encode()), len(want[r.doc_id].ids))
        assert r.over_limit == (r.n_tokens > 2048)


def test_awkward_rows(spark):
    tokenizer = library(WORDS)
    texts = [*brute.awkward(), (50, "word next " * 500_000), (51, "ab" * 600_000)]
    rows = token_counts.count_tokens(brute.documents(spark, texts), limit=3).collect()
    found = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows), key=str)
    want = []
    for doc_id, text in texts:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 3))
    assert found == sorted(want, key=str)
    empty = token_counts.count_tokens(brute.documents(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
