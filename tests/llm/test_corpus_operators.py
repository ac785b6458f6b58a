import gzip
import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwise.llm import language, packing, sharding, url_filter, warc
from tests.llm import brute


def check_shards(rows, n_docs, shards):
    assert len(rows) == n_docs
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    return [sizes[k] for k in range(shards)]


def test_shards_have_equal_bytes_and_gapless_slots(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé ") for _ in range(rng.randrange(200))) for _ in range(3000)]
    texts += ["a copy that a third of all rows hold " * 3] * 1500
    rows = sharding.sharded_documents(brute.documents(spark, texts).repartition(6)).collect()
    sizes = check_shards(rows, len(texts), 16)
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows) + 0.01 * sum(sizes) / 16
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    # Small groups of copies are not cut.
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 15


def test_slots_follow_the_keys_in_small_bins(spark, monkeypatch):
    texts = [f"text {i}" for i in range(400)] + ["copy"] * 300
    slim = brute.documents(spark, texts).select(
        "doc_id", F.lit(1).cast("long").alias("size"), sharding.digest("text").alias("_h"), sharding.digest("doc_id").alias("_d"))
    rows = sharding.shard_rows(slim.cache(), shards=4, bin_rows=16).collect()
    check_shards(rows, len(texts), 4)
    ordered = [(r._h, r._d) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)


def test_shards_of_awkward_rows(spark):
    rows = sharding.sharded_documents(brute.documents(spark, brute.awkward())).collect()
    check_shards(rows, len(brute.awkward()), 16)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (0, 1)} == {(1, 0)}
    assert sharding.sharded_documents(brute.documents(spark, [])).count() == 0
    same = sharding.sharded_documents(brute.documents(spark, [(1, "same row")] * 200)).collect()
    assert max(sizes := check_shards(same, 200, 16)) <= 14 * 9 and min(sizes) >= 11 * 9


def pages(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, host string")


def test_url_parts_and_longest_rule(spark):
    cases = [
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://x.www.example.com/en/1", "x.www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("ftp://com", "com", "", None, "allow"), ("http://net/es/", "net", "/es/", "net/es/", "block"),
        ("http://internet/es/", "internet", "/es/", None, "allow"), ("no scheme/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("a://b://c/d\ne?x", "b:", "//c/d\ne", None, "allow"),
        ("http://h?x/y", "h", "", None, "allow"), ("http://É.net/fr/", "É.net", "/fr/", "net/fr/", "block"),
    ]
    rows = url_filter.filter_urls(pages(spark, [(i, c[0], "") for i, c in enumerate(cases)])).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert found == {i: c[1:] for i, c in enumerate(cases)}
    assert url_filter.filter_urls(pages(spark, [])).count() == 0


def test_templates_learn_from_the_labels_of_their_host(spark):
    rules = [("block", "h.org", "/spam/a"), ("allow", "h.org", "/news/a")]
    rng = random.Random(1)
    slug = lambda first: first + "".join(rng.choice("cdefgh") for _ in range(8))
    rows = [f"http://h.org/{kind}/{slug(first)}/x{i}" for kind in ("spam", "news") for first in "ab" for i in range(40)]
    rows += ["http://h.org/other/b/x"] * 2 + ["http://other.org/spam/b1/x1"] * 9
    found = url_filter.filter_urls(pages(spark, list(zip(range(999), rows, rows))), rules).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.verdict == ("block" if r.host == "h.org" and r.path.startswith("/spam/") else "allow"), r
    assert len({r.template for r in found if r.path.startswith("/spam/") and r.host == "h.org"}) <= 2


def test_clean_urls_stay_beside_blocked_sections(spark):
    """Hosts whose labels are all bad: small sections of a large node, a small host, and nothing but .net pages."""
    big = [f"http://big.net/s{chr(97 + k // 26)}{chr(97 + k % 26)}/x{i}" for k in range(60) for i in range(60)]
    big += [f"http://big.net/es/x{i}" for i in range(55)] + [f"http://big.net/fr/x{i}" for i in range(30)]
    big += [f"http://big.net/t{chr(97 + k)}/x{i}" for k in range(20) for i in range(4)]
    small = [f"http://small.net/{s}/x{i}" for s in ("es", "fr") for i in range(4)] + ["http://small.net/en/x1"]
    rows = big + small + ["http://one.net/en/x1"]
    found = url_filter.filter_urls(pages(spark, list(zip(range(len(rows)), rows, rows)))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.verdict == ("block" if r.path.startswith(("/es/", "/fr/")) else "allow"), r
    named = {r.template for r in found if r.host == "big.net"}
    assert {"/es/x#", "/saa/x#"} <= named and "/ta/x#" not in named


def test_deep_paths_keep_their_tail(spark):
    deep = "http://h.org/" + "/".join("abcdefghij")
    row = url_filter.filter_urls(pages(spark, [(i, deep, "") for i in range(9)])).first()
    assert row.template == "/" + "/".join("abcdefghij")


def test_warc_round_trip(spark):
    html = ["<p>one</p>", None, "", "é" * 5000, "<p>one</p>", "a\r\n\r\nWARC/1.1\r\n\r\nb", "<p>one</p>", "x\ny"]
    urls = ["http://A.b/c", None, "", "https://b.a:80/x?y#z", "no scheme", "http://h/\r\nX-Header: 1", "http://A.b/c", "http://h/\t\\n%0A"]
    rows = [(10 - i, u, h) for i, (u, h) in enumerate(zip(urls, html))] + [(50, "u", "twice"), (50, "u", "twice"), (None, "v", "null id")]
    source = pages(spark, rows).repartition(3)
    captures, directory, folder = warc.archive_pages(source)
    assert captures.count() == len(rows)
    first = {}
    for page_id, _, text in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        first.setdefault(text or "", page_id)
    found = warc.round_trip(source).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[2] or "" for r in rows}
    for r in found:
        data = texts[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), warc.payload_digest(data))
        leader = first[texts[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if leader == r.page_id else ("revisit", leader))
        assert r.record_type == "revisit" or bytes(r.payload) == data
    wanted = spark.createDataFrame([(10, "http://A.b/c"), (10, "http://A.b/other"), (77, "http://A.b/c")], "page_id long, url string")
    assert [r.page_id for r in warc.read_captures(wanted, directory, folder).collect()] == [10]
    # The archives are plain WARC: every record ends with two line breaks.
    row = captures.filter("page_id = 10").first()
    with open(f"{folder.removeprefix('file:')}/{row.file}", "rb") as f:
        assert gzip.decompress(f.read()).endswith(b"\r\n\r\n")
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_index_blocks_are_sorted_and_searched(spark):
    rows = [(i, f"http://h{i % 7}.org/{i % 5}", f"t{i % 11}") for i in range(300)]
    captures, _, folder = warc.archive_pages(pages(spark, rows))
    directory = warc.write_index(captures, folder, block_lines=10).cache()
    assert directory.count() >= 30
    found = warc.read_captures(pages(spark, rows), directory, folder)
    assert sorted(r.page_id for r in found.collect()) == list(range(300))


def test_network_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    network = language.Network(3, hidden=4)
    network.parameters = [p.astype(np.float64) for p in network.parameters]
    steps, mask, labels = rng.integers(0, 256, (6, 5)), np.ones((6, 5), bool), np.array([0, 1, 2, 1, 0])
    mask[4:, 1] = False
    _, gradients = network.gradients(steps, mask, labels)
    for p, g in zip(network.parameters, gradients):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if p.shape[0] == 256:
                at = (int(steps[rng.integers(6), 0]), at[1])
            kept = p[at]
            p[at] = kept + 1e-4
            above, _ = network.gradients(steps, mask, labels)
            p[at] = kept - 1e-4
            below, _ = network.gradients(steps, mask, labels)
            p[at] = kept
            assert abs((above - below) / 2e-4 - g[at]) < 1e-4


def test_network_sums_do_not_depend_on_earlier_batches():
    """Arrays are used again: a smaller batch after a larger one gives what it gives alone."""
    rng = np.random.default_rng(1)
    network = language.Network(2, hidden=4)
    steps, labels = rng.integers(0, 256, (8, 6)).astype(np.uint8), rng.integers(0, 2, 6)
    parts = [network.gradients(steps[:, a:b], np.ones((8, b - a), bool), labels[a:b], np.ones(b - a))[1] for a, b in ((0, 6), (0, 2), (2, 6))]
    for whole, *two in zip(*parts):
        np.testing.assert_allclose(whole, sum(two), atol=1e-4)


def test_gradients_of_inputs_take_the_places_of_gates_and_are_summed_by_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    network = language.Network(3, hidden=4)
    steps, labels = rng.integers(97, 123, (12, 400)).astype(np.uint8), rng.integers(0, 3, 400)
    found = []
    for block in (1, 4, 5, 12):
        monkeypatch.setattr(language, "BLOCK", block, raising=False)
        monkeypatch.setattr(language, "_ROOMS", {})
        found.append(network.gradients(steps, np.ones((12, 400)), labels, np.ones(400))[1])
        # Gates and candidates of two directions, their states, and what is put out.
        assert sum(map(len, language._ROOMS.values())) <= 4 * 12 * 400 * (2 * 3 * 4 + 2 * 4 + 3)
    for one, *others in zip(*found):
        for other in others:
            np.testing.assert_allclose(one, other, rtol=1e-4, atol=1e-3)


def test_both_forms_of_the_gates_give_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    network = language.Network(3, hidden=4)
    steps, labels = rng.integers(0, 256, (8, 50)).astype(np.uint8), rng.integers(0, 3, 50)
    for scale in (1, 300):
        network.parameters[0] = network.parameters[0] * np.float32(scale)
        found = []
        for wide in (False, True):
            monkeypatch.setattr(language, "WIDE", wide)
            with np.errstate(over="raise", invalid="raise"):
                odds = network.forward(steps)[0].copy()
                found.append([odds, *network.gradients(steps, np.ones((8, 50)), labels, np.ones(50))[1]])
        for one, other in zip(*found):
            np.testing.assert_allclose(one, other, rtol=1e-3, atol=1e-3)


def test_odds_of_large_weights_are_finite():
    rng = np.random.default_rng(5)
    network = language.Network(3, hidden=4)
    steps = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    for scale in (1, 20, 1000):
        network.parameters[6] = network.parameters[6] * np.float32(scale)
        with np.errstate(over="raise", invalid="raise"):
            odds, both, *_ = network.forward(steps)
        x = network.parameters[6].T.astype(np.float64) @ both
        want = np.exp(x - x.max(axis=1, keepdims=True))
        np.testing.assert_allclose(odds, want / want.sum(axis=1, keepdims=True), atol=1e-4)


def test_gates_are_logistic_and_candidates_tanh_also_far_from_zero():
    rng = np.random.default_rng(2)
    network = language.Network(3, hidden=4)
    steps = rng.integers(0, 256, (5, 7)).astype(np.uint8)
    for scale in (1, 300):
        network.parameters[0] = network.parameters[0] * np.float32(scale)
        table, gates, candidate = (p.astype(np.float64) for p in network.parameters[:3])
        state, want = np.zeros((7, 4)), []
        for row in steps:
            z, r = np.split((1 + np.tanh((table[row][:, :8] + state @ gates) / 2)) / 2, 2, axis=1)
            state = state + z * (np.tanh(table[row][:, 8:] + (r * state) @ candidate) - state)
            want.append(state.T)
        with np.errstate(over="raise", invalid="raise"):
            _, both, *_ = network.forward(steps)
        np.testing.assert_allclose(both[:, :4], want, atol=1e-5)


def test_a_small_rest_of_windows_is_no_batch_of_its_own(monkeypatch):
    network, seen, forward = language.Network(2, hidden=4), [], language.Network.forward
    monkeypatch.setattr(language.Network, "forward", lambda self, steps, keep=False: seen.append(steps.shape[1]) or forward(self, steps, keep))
    texts = [b"some words " * 20_000, b"", b"x"]
    odds = language.document_odds(network, texts, 2)
    assert sum(seen) == -(-220_000 // language.SPAN) + 1 and len(seen) == 2
    parts = language._parts(10_001, 100)
    assert parts[0].start == 0 and parts[-1].stop >= 10_001 and all(a.stop == b.start for a, b in zip(parts, parts[1:]))
    assert max(p.stop - p.start for p in parts) <= 125 and language._parts(0, 100) == []
    np.testing.assert_allclose(odds[2], language.document_odds(network, [b"x"], 2)[0], atol=1e-6)


def test_rejected_languages_are_looked_up_without_their_texts(spark, monkeypatch):
    written = []
    write = language.write_and_read
    monkeypatch.setattr(language, "write_and_read", lambda df, label, *a, **k: written.append((label, df.columns)) or write(df, label, *a, **k))
    docs, rows = labelled_texts(spark)
    odd = [(5, None, "de"), (5, "12 34", "de"), (None, "12 34", None), (None, rows[7][1], None), (7, rows[7][1], "en")]
    kept = language.keep_known(docs.union(spark.createDataFrame(odd, docs.schema))).collect()
    assert [c for label, c in written if label == "judged" and "text" in c] == [] and "judged" in dict(written)
    assert all(any(map(str.isalpha, r.text or "")) for r in kept)
    assert sum(r.text == rows[7][1] for r in kept) in (0, 3)
    assert len(kept) >= len(rows) // 2


@pytest.fixture(scope="module")
def learned(spark):
    return language.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), per_label=150)


def test_languages_of_held_out_documents(spark, learned):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = language.identify(docs, *learned).filter(language.held_out(F.col("doc_id")))
    right = judged.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1


def test_language_depends_on_the_text_alone(spark, learned):
    rows = language.identify(brute.documents(spark, brute.awkward(), lang=None), *learned).collect()
    assert len(rows) == len(brute.awkward())
    for r in rows:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letters) and (r.score > 0) == letters
    again = language.identify(brute.documents(spark, brute.awkward(), lang="fr", source="z").repartition(7), *learned).collect()
    key = lambda r: (str(r.doc_id), r.text or "", r.lang_pred, round(r.score, 5))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_no_labels_no_languages(spark):
    docs = brute.documents(spark, ["some text"], lang=None)
    assert [r.lang_pred for r in language.identify(docs, *language.learn(docs)).collect()] == ["und"]
    assert language.keep_known(brute.documents(spark, [])).count() == 0


def test_unknown_languages_are_rejected_and_clean_texts_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(1)
    junk = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(400)) for _ in range(20)]
    junk += ["".join(chr(rng.randrange(0x4e00, 0x9fff)) for _ in range(200)) for _ in range(20)]
    rows = spark.createDataFrame([(10 ** 6 + i, t, None) for i, t in enumerate(junk)], docs.schema)
    kept = {r.doc_id for r in language.keep_known(docs.union(rows)).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert clean - kept == set()
    stayed = len([i for i in kept if i >= 10 ** 6])
    assert stayed <= len(junk) // 2


def test_without_labels_texts_with_letters_stay(spark):
    docs = brute.documents(spark, ["some text", "été", "123 !!", "", None], lang=None)
    assert {r.text for r in language.keep_known(docs).collect()} == {"some text", "été"}


def test_sample_is_bounded_and_leaves_out_the_held_out(spark):
    texts = [f"text number {i}" for i in range(800)]
    sample = language.training_sample(brute.documents(spark, texts), per_label=20)
    assert list(sample) == ["en"] and len(sample["en"]) == 20
    assert all(zlib.crc32(t.split()[-1].encode()) % 4 != 2 for t in sample["en"])
    again = language.training_sample(brute.documents(spark, texts).repartition(9), per_label=20)
    assert sample == again


def labelled_texts(spark, n=60):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdefgh" if i % 3 else "mnopqrst") for _ in range(40 + 7 * i)), "de" if i % 3 else "en") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_every_labelled_text_is_learned_from(spark):
    docs, rows = labelled_texts(spark)
    start = language.Network(2, hidden=4)
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    steps, mask, owner = language._windows([r[1].encode() for r in seen])
    size = {lang: sum(len(r[1]) for r in seen if r[2] == lang) for lang in ("de", "en")}
    n = {lang: sum(r[2] == lang for r in seen) for lang in size}
    weights = {lang: n[lang] / len(seen) / size[lang] for lang in size}
    _, want = start.gradients(
        steps, mask, np.array([r[2] == "en" for r in seen], int)[owner], np.array([weights[r[2]] for r in seen])[owner])
    labelled = language._labelled(docs)
    got = language._all_gradients(labelled, start, ["de", "en"], weights)
    for g, w in zip(got, want):
        np.testing.assert_allclose(g, w, atol=1e-5)
    networks = [language.refine(d, start, ["de", "en"], steps=4) for d in (docs, docs.repartition(5))]
    for p, q in zip(*(m.parameters for m in networks)):
        np.testing.assert_allclose(p, q, atol=1e-3)


def test_a_text_outside_the_sample_changes_the_network(spark):
    docs, _ = labelled_texts(spark)
    sample = language.training_sample(docs, per_label=3)
    taken = {t for texts in sample.values() for t in texts}
    other = docs.filter("length(text) between 200 and 250").filter(~F.col("text").isin(list(taken))).filter(
        ~language.held_out(F.col("doc_id"))).first()
    changed = docs.withColumn("text", F.when(F.col("doc_id") == other.doc_id, F.concat("text", F.lit("zzzz" * 40))).otherwise(F.col("text")))
    assert language.training_sample(changed, per_label=3) == sample
    networks = [language.learn(d, per_label=3)[0] for d in (docs, changed)]
    assert any(not np.array_equal(p, q) for p, q in zip(*(n.parameters for n in networks)))


def test_thresholds_come_from_all_labelled_texts(spark):
    docs, rows = labelled_texts(spark)
    network, languages = language.learn(docs, per_label=2)
    judged = language.identify(docs.withColumn("_labelled", F.lit(True)), network, languages, ("_lang_pred", "_score"), "_marks")
    least, want = 1.0, []
    for n in reversed(language.LENGTHS):
        cut = [r[1].encode()[:most] for r in rows if len(r[1]) >= n for most in (n, 2 * n)]
        if cut:
            least = min(least, language.MARGIN * float(np.quantile(language.document_odds(network, cut, 2).max(axis=1), language.QUANTILE)))
            want.append(least)
    got = language.least_scores(judged)
    np.testing.assert_allclose(got[: len(want)], want[::-1], atol=1e-6)
    assert set(got[len(want):]) == {got[len(want) - 1]}


def check_plan(counts, capacity):
    rows, used = packing.plan_sequences(counts, capacity)
    sequences, ranks = {}, {}
    for length, start, stop, sequence, offset in rows:
        ranks.setdefault(length, []).extend(range(start, stop))
        for r in range(start, stop):
            sequences.setdefault(sequence + r - start, []).append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items() if c}
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(sequences) == set(range(used))
    return used


def best_fit_decreasing(counts, capacity):
    import bisect
    rooms, used = [], 0
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(rooms, length)
        used += at == len(rooms)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - length)
    return used


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_valid_and_close_to_the_bound(seed):
    rng = random.Random(seed)
    capacity = rng.choice([50, 400])
    counts = dict(Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(4000)))
    used = check_plan(counts, capacity)
    assert used <= 1.01 * best_fit_decreasing(counts, capacity) + 1
    for few in ({}, {1: 1}, {capacity: 3}, {capacity // 2 + 1: 5}, {1: capacity + 1}):
        assert check_plan(few, capacity) <= best_fit_decreasing(few, capacity)


def test_configurations_solve_a_known_case():
    # Two thirds and one third of the room: one of each per sequence.
    found = packing.configurations([20, 10], [100, 100], 30)
    assert sum(times for _, times in found) == 100


def test_pieces_hold_the_ids_of_the_whole_text(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = [*brute.awkward(), (40, "It's <|endoftext|>x 'll\u00a0don't\u2003É\u0301 12345 ΣΑΣ \x1c\x85 a\u0301"), (41, "the end " * 3000)]
    rows = packing.pack_documents(brute.documents(spark, texts), capacity=64, keep_ids=True).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r)
        assert r.length * 4 == len(r.ids) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
    for doc_id, text in texts:
        if doc_id in (None, 9):
            continue
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(found[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces))) and [r.start for r in pieces] == list(range(0, len(ids), 64))
        assert np.frombuffer(b"".join(bytes(r.ids) for r in pieces), "<u4").tolist() == ids
        assert all(r.length == 64 for r in pieces[:-1])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(brute.documents(spark, [])).count() == 0


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 10)
    rows = packing.pack_documents(brute.documents(spark, ["same"] * 500), capacity=8).collect()
    assert len(rows) == 500 and len({(r.sequence_id, r.offset) for r in rows}) == 500
    assert len({r.sequence_id for r in rows}) == 125


def test_record_targets_are_the_urls():
    for url in ("https://x.org/a%20b?c=%25", "http://h/\tü", ""):
        headers, _, payload = warc.parse_record(warc.record_bytes(url, 1, b"body", warc.payload_digest(b"body")))
        assert headers["WARC-Target-URI"] == url and payload == b"body"
    headers, *_ = warc.parse_record(warc.record_bytes("http://h/\r\nX: 1", 1, b"", warc.payload_digest(b"")))
    assert headers["WARC-Target-URI"] == "http://h/%0D%0AX: 1"
