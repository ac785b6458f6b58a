import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwise.llm import decontamination, grams, licenses, near_dedup, quality, substring
from tests.llm import brute


def passages(seed, n, vocabulary=30):
    """Texts that share passages, some beginning with another one's end."""
    rng = random.Random(seed)
    shared = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(15, 45))] for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(shared)[rng.randrange(4):] if rng.random() < 0.6 else [f"u{rng.randrange(9999)}" for _ in range(20)]
        texts.append(" \n".join(parts))
    return texts


def test_word_hashes_follow_the_words():
    texts = [b"One  two\ttwo", b"", b"two one\x00 one", b"one"]
    hashes, first = grams.word_hashes(texts, grams.SPACED)
    assert first.tolist() == [0, 3, 3, 6, 7]
    flat = [w for t in texts for w in brute.SPACED.findall(t)]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    values, whole = grams.windows(hashes, first, 2)
    assert whole.tolist() == [True, True, False, True, True, False, False]


def test_substring_matches_brute_force(spark):
    texts = passages(1, 60)
    docs = list(enumerate(texts))
    found = substring.remove_repeats(brute.documents(spark, texts).repartition(5), chunk_bytes=3000).collect()
    want = {i: r for (i, _), r in zip(docs, brute.kept_words(docs, 20))}
    assert len(found) == len(texts)
    for row in found:
        ws, kept = want[row.doc_id]
        assert (row.n_words, row.n_removed) == (len(ws), len(ws) - len(kept))
        assert row.kept_text == b" ".join(kept).decode()
        assert sum(b - a for a, b in zip(row.removed_spans[::2], row.removed_spans[1::2])) == row.n_removed
        assert row.source == "s" and row.digest == "extra"


def test_substring_awkward_rows(spark):
    rows = substring.remove_repeats(brute.documents(spark, brute.awkward())).collect()
    assert len(rows) == len(brute.awkward())
    for row in rows:
        assert row.n_words == len(brute.words(row.text)) and row.kept_text is not None
        if row.text is None or row.text == "":
            assert row.kept_text == "" and row.n_removed == 0
    assert substring.remove_repeats(brute.documents(spark, [])).count() == 0


def test_substring_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = substring.remove_repeats(brute.documents(spark, [(None, text), (1, text), (1, text)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in rows) == [(False, 30), (False, 30), (True, 0)]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for group in range(12):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 3, 40])):
            copy = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0.02, 0.04, 0.08]))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99999)}"
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    rng.shuffle(texts)
    texts = [t.upper() if i % 7 == 0 else t for i, t in enumerate(texts)]
    docs = list(enumerate(texts))
    for k in (2, 5):
        want = brute.near_groups(docs, k, 80)
        found = near_dedup.near_duplicates(brute.documents(spark, texts), shingle=k).collect()
        assert {r.doc_id: r.component_id for r in found} == want
        assert {r.doc_id for r in found if r.kept} == set(want.values())
        assert all(r.n_shingles == len(brute.shingles(texts[r.doc_id], k)) for r in found)


def test_near_duplicates_compare_the_open_rest_of_long_lists(spark, monkeypatch):
    """Chains whose members match their pivot too little are still joined through each other."""
    monkeypatch.setattr(near_dedup, "SHORT_LIST", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    rng = random.Random(6)
    texts = []
    for chain in range(4):
        words = [f"c{chain}w{i}" for i in range(100)]
        for step in range(14):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(3):
                words[rng.randrange(len(words))] = f"n{rng.randrange(99999)}"
    docs = list(enumerate(texts))
    found = near_dedup.near_duplicates(brute.documents(spark, texts), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in found} == brute.near_groups(docs, 2, 80)


def test_open_pairs_leave_no_match_without_a_common_centre(spark):
    """A list of members that match each other at 0.64 to 0.81, in shuffled numbers and with several centres."""
    rng, n = np.random.default_rng(12), 120
    base = rng.integers(0, 256, 4 * near_dedup.COORDINATES + near_dedup.COUNTED).astype(np.uint8)
    bodies = {}
    for node in rng.permutation(n).tolist():
        low, counted = base[: 4 * near_dedup.COORDINATES].view(np.uint32).copy(), base[4 * near_dedup.COORDINATES:].copy()
        share = rng.uniform(0.1, 0.2)
        for part, most in ((low, 2 ** 32), (counted, 256)):
            changed = rng.random(len(part)) < share
            part[changed] = rng.integers(0, most, changed.sum(), dtype=np.uint64).astype(part.dtype)
        bodies[node] = (low, counted)
    needed = near_dedup.needed_matches(80, near_dedup.COORDINATES + near_dedup.COUNTED)
    matching = {(a, b) for a in bodies for b in bodies if a < b and near_dedup._matches(bodies[a], bodies[b]) >= needed}
    sets = spark.createDataFrame(
        [(node, 100, bytearray(low.tobytes() + counted.tobytes())) for node, (low, counted) in bodies.items()],
        "node long, n_shingles long, signature binary")
    lists = spark.createDataFrame([(1, node, n, 0) for node in bodies], "token long, node long, n long, pivot long")
    joined = spark.createDataFrame([], "node long, component long")
    stars = [(a, b, True) for a, b in sorted(matching) if a == 0]
    pairs = spark.createDataFrame(stars, "a long, b long, star boolean")
    found = stars + [tuple(r) for r in near_dedup.open_pairs(lists, joined, pairs, sets, needed, 80).collect()]
    clusters = {}
    for a, b, star in found:
        if star:
            clusters.setdefault(a, {a}).add(b)
    assert len(clusters) > 3
    met = {(min(a, b), max(a, b)) for a, b, _ in found}
    for cluster in clusters.values():
        met |= {(a, b) for a in cluster for b in cluster if a < b}
    assert not matching - met


def test_open_pairs_of_a_long_list_are_a_row_per_member(spark):
    """Many members apart from each other and from a component of many: one cluster in which every match meets."""
    rng, n = np.random.default_rng(13), 600
    base = rng.integers(0, 256, 4 * near_dedup.COORDINATES + near_dedup.COUNTED).astype(np.uint8)
    bodies = []
    for _ in range(n):
        low, counted = base[: 4 * near_dedup.COORDINATES].view(np.uint32).copy(), base[4 * near_dedup.COORDINATES:].copy()
        share = rng.uniform(0.1, 0.2)
        for part, most in ((low, 2 ** 32), (counted, 256)):
            changed = rng.random(len(part)) < share
            part[changed] = rng.integers(0, most, changed.sum(), dtype=np.uint64).astype(part.dtype)
        bodies.append((low, counted))
    needed = near_dedup.needed_matches(80, near_dedup.COORDINATES + near_dedup.COUNTED)
    part = {node: 1 if node % 2 and node > 1 else node for node in range(n)}
    stacked = [np.array(side) for side in zip(*bodies)]
    open_ = {(a, int(b)) for a in range(n) for b in np.flatnonzero(near_dedup._matches(stacked, bodies[a]) >= needed)
             if a < b and part[a] != part[int(b)]}
    sets = spark.createDataFrame(
        [(node, 100, bytearray(low.tobytes() + counted.tobytes())) for node, (low, counted) in enumerate(bodies)],
        "node long, n_shingles long, signature binary")
    # Three lists of the same group.
    lists = spark.createDataFrame([(t, node, n, 0) for t in range(3) for node in range(n)], "token long, node long, n long, pivot long")
    joined = spark.createDataFrame([(a, b) for a, b in part.items() if a != b], "node long, component long")
    pairs = spark.createDataFrame([], "a long, b long, star boolean")
    found = [tuple(r) for r in near_dedup.open_pairs(lists, joined, pairs, sets, needed, 80).collect()]
    clusters = {}
    for a, b, star in found:
        if star:
            clusters.setdefault(a, {a}).add(b)
    met = {(min(a, b), max(a, b)) for a, b, _ in found}
    for cluster in clusters.values():
        met |= {(a, b) for a in cluster for b in cluster if a < b}
    assert len(open_) > 10 * n and not open_ - met
    assert len(found) < n


def test_near_duplicates_awkward_rows(spark):
    rows = near_dedup.near_duplicates(brute.documents(spark, brute.awkward())).collect()
    assert len(rows) == len(brute.awkward())
    empty = [r for r in rows if r.n_shingles == 0]
    assert len(empty) == 4 and all(r.kept for r in empty)
    assert near_dedup.near_duplicates(brute.documents(spark, [])).count() == 0


def test_needed_matches_is_strict():
    assert 30 <= near_dedup.needed_matches(80) <= 37
    assert near_dedup.needed_matches(100) == near_dedup.COORDINATES


def test_components_join_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)], "a long, b long")
    found = {r.node: r.component for r in near_dedup.components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert near_dedup.components(links.limit(0)).count() == 0


def test_components_go_on_from_earlier_ones(spark):
    """Links in portions give the components that all of them give at once."""
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(7, 7)]
    want = brute.groups(pairs, range(300))
    frame = lambda part: spark.createDataFrame(part, "a long, b long")
    joined = near_dedup.components(frame(pairs[:80]))
    for part in (pairs[80:160], [], pairs[:40], pairs[160:]):
        joined = near_dedup.merge_components(joined, frame(part))
    found = {r.node: r.component for r in joined.collect()}
    assert joined.count() == len(found)
    assert found == {n: c for n, c in want.items() if n != c}


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "item_id long, text string, digest string")


def leaks(docs, benchmark):
    wins = {}
    for item, text in benchmark:
        ws = brute.words(text, brute.LETTERS, True)
        k = min(10, len(ws))
        for s in range(len(ws) - k + 1 if ws else 0):
            wins.setdefault(tuple(ws[s: s + k]), set()).add(item)
    result = {}
    for doc_id, text in docs:
        ws = brute.words(text, brute.LETTERS, True)
        hit, found = set(), set()
        for k in {len(w) for w in wins}:
            for s in range(len(ws) - k + 1):
                if (w := tuple(ws[s: s + k])) in wins:
                    hit |= set(range(s, s + k))
                    found |= wins[w]
        result[doc_id] = (len(ws), len(hit), sorted(map(str, found)))
    return result


def test_contamination_matches_brute_force(spark):
    rng = random.Random(8)
    benchmark = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(n))) for i, n in enumerate([9, 10, 11, 30, 45, 1, 3, 0, 30])]
    benchmark += [(20, None), (21, benchmark[3][1])]
    texts = []
    for _ in range(50):
        parts = [f"u{rng.randrange(999)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            ws = (rng.choice(benchmark)[1] or "").split()
            a = rng.randrange(len(ws) + 1)
            parts += ws[a: a + rng.randrange(8, 20)] + ["Gap!"] * rng.randrange(2)
        texts.append(", ".join(parts).upper())
    docs = list(enumerate(texts))
    found = decontamination.contamination(brute.documents(spark, texts), items(spark, benchmark)).collect()
    want = leaks(docs, benchmark)
    for r in found:
        assert (r.n_words, r.n_hit, list(r.item_ids)) == want[r.doc_id]
        assert r.contaminated == (r.n_hit > 0) and sum(s.stop - s.start for s in r.spans) == r.n_hit
    assert len(found) == len(docs) and any(r.contaminated for r in found)


def test_contamination_awkward_rows(spark):
    docs = brute.documents(spark, brute.awkward())
    found = decontamination.contamination(docs, items(spark, [(1, "another text of the same id"), (None, "no id at all")])).collect()
    assert len(found) == len(brute.awkward())
    assert sorted((r.n_hit, len(r.item_ids)) for r in found if r.contaminated) == [(4, 0), (6, 1)]
    assert decontamination.contamination(docs, items(spark, [])).filter("contaminated").count() == 0
    assert decontamination.contamination(brute.documents(spark, []), items(spark, [(1, "a")])).count() == 0


def test_licenses_match_brute_force(spark):
    notice = licenses.NOTICES[0][0].split()
    edited = " ".join(notice[:10] + ["really"] + notice[10:]) + "."
    texts = ["The MIT License, mit-license! MIT license", "gnu General Public\nLicense", "mit and license", edited,
             "general public general public license apache license", "mit licensé", " ".join(notice[:6])] + [t for _, t in brute.awkward()]
    found = {r.doc_id: r for r in licenses.scan_licenses(brute.documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        ws = brute.words(text, brute.LETTERS, True)
        places = sorted((s, label) for phrase, label in licenses.PHRASES for p in [phrase.encode().split()]
                        for s in range(len(ws) - len(p) + 1) if ws[s: s + len(p)] == p)
        r = found[i]
        assert (r.n_words, r.n_base) == (len(ws), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert found[3].labels == "mit" and found[3].n_base == 0 and found[3].score > 0.9
    assert found[6].labels == ""
    assert licenses.scan_licenses(brute.documents(spark, [])).count() == 0


def counts(text):
    ws = [w.decode() for w in brute.words(text)]
    tri = [tuple(ws[i: i + 3]) for i in range(len(ws) - 2)]
    covered = {i + j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_match_brute_force(spark):
    rng = random.Random(2)
    rows = [r for r in brute.awkward() if len(r[1] or "") < 30000] + [
        (100 + n, " ".join(rng.choice("abc") for _ in range(n)) + "\n" + "a b\n" * (n % 4)) for n in range(12)]
    found = quality.host_quality(brute.documents(spark, rows)).collect()
    assert len(found) == len(rows)
    want = sorted((str(i), *counts(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == want
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in found)


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    docs = brute.documents(spark, [good] * 30, source="fine").union(brute.documents(spark, ["short"] * 40 + [good], source="bad"))
    docs = docs.union(brute.documents(spark, [good, "short"], source=None))
    kept = {(r.host, r.base_failed): r.kept for r in quality.host_quality(docs).collect()}
    assert kept == {("fine", False): True, ("bad", True): False, ("bad", False): False, (None, False): True, (None, True): False}
    assert quality.host_quality(brute.documents(spark, [])).count() == 0


def test_rules_weigh_where_a_host_stands_out(spark):
    """Symbol junk goes on a host full of it and stays on ordinary ones; clean documents stay on both."""
    good = " ".join(f"word{i}" for i in range(60))
    junk, doubled = good + " ##########", good + "\nsame\nsame\nsame"
    hosts = {f"h{i}": [good] * 57 + [junk] * 2 + [doubled] for i in range(20)}
    hosts["symbols"], hosts["lines"] = [good] * 40 + [junk] * 20, [good] * 30 + [doubled] * 30
    hosts["tiny"], hosts["lost"] = [junk], [doubled] * 60 + [good] * 3
    docs = None
    for name, texts in hosts.items():
        part = brute.documents(spark, texts, source=name)
        docs = part if docs is None else docs.union(part)
    found = quality.host_quality(docs).groupBy("host", "symbols_failed", "dup_lines_failed", "base_failed").agg(
        F.collect_set("kept").alias("kept")).collect()
    kept = {(r.host, r.symbols_failed, r.dup_lines_failed): r.kept for r in found}
    assert not any(r.base_failed for r in found)
    gone = {("symbols", True, False), ("lines", False, True), ("lost", False, True), ("lost", False, False)}
    assert {k for k, v in kept.items() if v == [False]} == gone
    assert all(v in ([True], [False]) for v in kept.values()) and len(kept) == 20 * 3 + 2 + 2 + 1 + 2


def test_rows_of_one_id_keep_their_order_between_runs(spark):
    """Which of several rows of one doc_id is the first does not change from run to run."""
    docs = brute.documents(spark, [(i // 8, t) for i, t in enumerate(passages(9, 40))]).repartition(4, "text")
    runs = [sorted((r.doc_id, r.text, r.n_removed) for r in substring.remove_repeats(docs, chunk_bytes=2000).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and any(n for _, _, n in runs[0])


@pytest.mark.parametrize("text", ["", None])
def test_sha_of_nothing(spark, text):
    row = substring.remove_repeats(brute.documents(spark, [text])).select(F.sha2("kept_text", 256).alias("sha")).first()
    assert row.sha == hashlib.sha256(b"").hexdigest()


def test_open_pairs_grow_with_the_members(spark, monkeypatch):
    """A group of near copies just below the limit gives pairs in proportion to its members, and the right groups."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    sizes, counts = (100, 300), []
    write = near_dedup.write_and_read

    def counted(df, label, *rest):
        result = write(df, label, *rest)
        if label == "open":
            counts.append(result.count())
        return result

    monkeypatch.setattr(near_dedup, "write_and_read", counted)
    for size in sizes:
        texts = []
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(120), 8):
                copy[at] = f"x{rng.randrange(10 ** 6)}"
            texts.append(" ".join(copy))
        docs = list(enumerate(texts))
        want = brute.near_groups(docs, 2, 80)
        found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(brute.documents(spark, docs), shingle=2).collect()}
        assert found == want
    assert counts[1] <= 6 * max(counts[0], 100)
