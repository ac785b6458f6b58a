"""Near-duplicate detection by an inverted join of MinHash signature coordinates.

A document's set of word shingles gets a signature of least hashes. Two sets of similarity s agree in about that
share of coordinates; all but about one in a million pairs at the threshold agree in at least
:func:`needed_matches` of them. Every coordinate-value pair of the first ``COORDINATES`` is a token under which
documents are posted. With tokens in order of frequency, rarest first, two documents with m equal tokens share one
of the first ``COORDINATES - m + 1`` of either: only this prefix is posted, and merging skips the tokens that many
documents have. Pairs that meet are counted on whole signatures, and what has enough matches is confirmed on the
full sets.

Sets that are equal are one node from the start. In a long posting list each member is compared with the
least member, its pivot; the members that match a pivot are its cluster. What the confirmed links do not join is
compared again: clusters within themselves, block by block and on full sets, then members away from their pivot
with the whole list. Two members that have any cluster in common, from whichever list, are left to it: of a
group of near copies nearly all stand in the cluster of its least member, so its other lists add no pairs. So a
group of copies costs a pair per member, and no link is lost.
"""
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from headwise.llm import grams
from headwise.llm.common import fields, write_and_read

#: Coordinates that are posted, and more that are only counted, by one byte each.
COORDINATES = 64
COUNTED = 448
SHINGLE = 5
SIMILARITY = 80  # per cent
#: How often postings without a possible partner are taken out.
PRUNINGS = 2
#: Posting lists up to this long are compared in full; longer ones with their pivot first.
SHORT_LIST = 8
BLOCK_ROWS = 2048
#: Clusters of a member, least pivots first, by which pairs in a common cluster are recognised.
CORES = 4
CLUSTER_ROWS = 512
#: Members of a list with something open, beyond which they are one cluster.
STAR_ROWS = 256
NULL_ID = -(1 << 63)
_COORDINATE_BASE = 0x2545F4914F6CDD1D


def _shingles(texts, size):
    """Distinct shingles of each text as sorted hashes; fewer words than ``size`` are one shingle."""
    found = [None] * len(texts)
    for a, b in grams.slabs([len(t) for t in texts]):
        hashes, first = grams.word_hashes(texts[a:b], grams.SPACED_LOWER)
        values, whole = grams.windows(hashes, first, size)
        for i in range(b - a):
            start, stop = first[i], first[i + 1]
            n = stop - start
            if n >= size:
                found[a + i] = np.unique(values[start: stop - size + 1])
            elif n:
                found[a + i] = grams.windows(hashes[start:stop], np.array([0, n]), int(n))[0][:1]
            else:
                found[a + i] = np.zeros(0, np.uint64)
    return found


def _coordinates():
    """One odd multiplier and one offset per coordinate."""
    n = COORDINATES + COUNTED
    seeds = grams.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(_COORDINATE_BASE)) >> np.uint64(32)
    return seeds[:n].astype(np.uint32) | np.uint32(1), seeds[n:].astype(np.uint32)


def signatures(sets):
    """Signature of every set as bytes: least hashes of 32 bits, then the last bytes of more; no set may be empty."""
    multipliers, offsets = _coordinates()
    values = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.empty((len(sets), COORDINATES + COUNTED), np.uint32)
    for c in range(COORDINATES + COUNTED):
        h = (x ^ offsets[c]) * multipliers[c]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out[:, c] = np.minimum.reduceat(h, starts)
    return [row[:COORDINATES].tobytes() + row[COORDINATES:].astype(np.uint8).tobytes() for row in out]


def needed_matches(similarity, coordinates=COORDINATES, missed=1e-6):
    """The most matches that all but ``missed`` of the pairs at ``similarity`` per cent have."""
    p, below = similarity / 100, 0.0
    for m in range(coordinates + 1):
        below += math.comb(coordinates, m) * p ** m * (1 - p) ** (coordinates - m)
        if below > missed:
            return max(1, m)
    return coordinates


def sign(docs, size):
    """doc_id, digest of the text, key of the shingle set (null if empty), its size and its signature."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("digest", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("signature", pa.binary())])

    def run(batches):
        for batch in batches:
            texts = [grams.encode(t) for t in batch.column("text").to_pylist()]
            for a, b in grams.slabs([len(t) for t in texts]):
                sets = _shingles(texts[a:b], size)
                full = [i for i, values in enumerate(sets) if len(values)]
                keys, bodies = [None] * len(sets), [None] * len(sets)
                for i, row in zip(full, signatures([sets[i] for i in full]) if full else ()):
                    keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bodies[i] = row
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("digest"), pa.array(keys, pa.binary()),
                    pa.array([len(v) for v in sets], pa.int64()), pa.array(bodies, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, digest long, key binary, n_shingles long, signature binary")


def _signatures(column):
    """An Arrow column of signatures as two matrices: posted coordinates, and bytes that are only counted."""
    bodies = column.to_pylist()
    data = np.frombuffer(b"".join(bodies), np.uint8).reshape(len(bodies), 4 * COORDINATES + COUNTED)
    return np.ascontiguousarray(data[:, : 4 * COORDINATES]).view(np.uint32), data[:, 4 * COORDINATES:]


def _matches(left, right):
    """Equal coordinates of signatures row by row, or of one with all."""
    return (left[0] == right[0]).sum(-1) + (left[1] == right[1]).sum(-1)


def all_tokens(sets):
    """(token, node): every coordinate-value pair of every set."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                matrix = _signatures(batch.column("signature"))[0].astype(np.uint64)
                tokens = grams.mix(matrix + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))
                nodes = batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), COORDINATES)))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.ravel().view(np.int64)), nodes], names=["token", "node"])

    return sets.select("node", "signature").mapInArrow(run, "token long, node long")


def _shared(posted):
    """The postings of tokens that at least two nodes have."""
    lists = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return posted.join(lists, "token")


def postings(sets, matches):
    """(token, node, n, pivot): the prefix posting lists of at least two nodes, their lengths and least nodes.

    A token that no other node has cannot match. A node with fewer than ``matches`` shared tokens has no
    partner, so its postings go, and with them others may become unshared. Of the s tokens that a node has
    left, the s - matches + 1 rarest are its prefix.
    """
    shared = write_and_read(_shared(all_tokens(sets)).drop("n"), "shared")
    for _ in range(PRUNINGS):
        able = shared.groupBy("node").agg(F.count(F.lit(1)).alias("_s")).filter(F.col("_s") >= matches)
        shared = write_and_read(_shared(shared.join(able.drop("_s"), "node")).drop("n"), "shared")
    own = Window.partitionBy("node")
    ranked = _shared(shared).withColumns({
        "_s": F.count(F.lit(1)).over(own), "_rank": F.row_number().over(own.orderBy("n", "token"))})
    prefix = write_and_read(ranked.filter(F.col("_rank") <= F.col("_s") - matches + 1).select("token", "node"), "prefix")
    lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).filter("n > 1")
    return write_and_read(prefix.join(lists, "token"), "lists")


def first_pairs(lists):
    """Pairs (a < b, star) to look at first: all of a short list, each member with the pivot of a long one."""
    short = lists.filter(F.col("n") <= SHORT_LIST).groupBy("token").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    every = F.flatten(F.transform("nodes", lambda a, i: F.transform(
        F.slice("nodes", i + 2, F.lit(SHORT_LIST)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    long = lists.filter((F.col("n") > SHORT_LIST) & (F.col("node") != F.col("pivot")))
    pairs = short.select(F.inline(every), F.lit(False).alias("star")).union(
        long.select(F.col("pivot").alias("a"), F.col("node").alias("b"), F.lit(True).alias("star")))
    return pairs.groupBy("a", "b").agg(F.max("star").alias("star"))


def _alike(sizes_a, sizes_b, similarity):
    return 100 * np.minimum(sizes_a, sizes_b) >= similarity * np.maximum(sizes_a, sizes_b)


def count_matches(pairs, sets, matches, similarity):
    """The pairs whose signatures agree in enough coordinates and whose sizes allow the similarity."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                equal = _matches(_signatures(batch.column("signature_a")), _signatures(batch.column("signature_b")))
                sizes = [batch.column(c).to_numpy() for c in ("size_a", "size_b")]
                yield batch.filter(pa.array((equal >= matches) & _alike(*sizes, similarity))).select(["a", "b", "star"])

    for side in "ab":
        own = sets.select(F.col("node").alias(side), F.col("n_shingles").alias(f"size_{side}"), F.col("signature").alias(f"signature_{side}"))
        pairs = pairs.join(own, side)
    return pairs.mapInArrow(run, "a long, b long, star boolean")


def confirm(pairs, texts, size, similarity):
    """The pairs whose full sets have the similarity. A pivot's text is at most a little longer than each member's."""
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
            keep = []
            for a, b in zip(*columns):
                x, y = _shingles([grams.encode(a), grams.encode(b)], size)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= similarity * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _blocks(members, key, columns, rows):
    """Deal the members of each key into blocks: those outside its core against all, as (key, i, j, outside).

    ``members`` has key, node, core (of the key) and component. A block pair is a task of its own; keys whose
    members all belong to one component are done and go.
    """
    mixed = members.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("component") != F.col("core")).alias("n_outside")
    ).filter("n_outside > 0")
    held = members.join(mixed, key)
    blocks, outer = F.ceil(F.col("n") / rows), F.ceil(F.col("n_outside") / rows)
    place, zero = F.xxhash64("node"), F.lit(0).cast("long")
    targets = held.select("*", F.lit(False).alias("outside"), F.pmod(place, blocks).alias("j"),
                          F.explode(F.sequence(zero, outer - 1)).alias("i"))
    queries = held.filter("component != core").select(
        "*", F.lit(True).alias("outside"), F.explode(F.sequence(zero, blocks - 1)).alias("j"), F.pmod(place, outer).alias("i"))
    columns = [key, "i", "j", "outside", "node", "component", *columns]
    return queries.select(*columns).union(targets.select(*columns)).groupBy(key, "i", "j")


def _sides(table):
    asks = table.column("outside").to_numpy()
    return table.filter(pa.array(asks)), table.filter(pa.array(~asks))


def open_pairs(lists, joined, pairs, sets, matches, similarity):
    """Pairs of long lists, (a, b, star), that are not joined yet and whose signatures match.

    In the pairs of a star, ``a`` is its centre, whichever number is less: members that match the same centre are
    left to the centre's cluster, which close_clusters builds from these. So a pair may come in both orders.

    Two members that match the same pivot, of this list or another one, stand in the pivot's cluster (see
    :func:`close_clusters`) and are left to it; what is not recognised by the ``CORES`` least pivots of both is
    compared. Of the others, each is in turn a pivot with a cluster of its own, unless it is in an earlier
    cluster; then only its matches outside that cluster are pairs. A cluster takes only members between which
    something is open: what is joined already gives no rows. Members take their turns by number, so that the same
    ones become pivots in all lists. Where more than ``STAR_ROWS`` members of a list have something open, pivots
    would take most of these members each: they are one cluster instead, around the least of them that is of the
    commonest component. Lists of one group mostly have the same centre and share its cluster. So even where nearly
    all members match each other without being joined, there is no more than a pair per member of a long list.
    """
    component = F.coalesce("component", "node")
    stars = pairs.filter("star").select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.lit(True).alias("near"))
    long = lists.filter(F.col("n") > SHORT_LIST).select("token", "node", "pivot")
    own = stars.select("pivot", "node").union(stars.select("pivot", F.col("pivot").alias("node"))).distinct()
    cores = own.withColumn("_at", F.row_number().over(Window.partitionBy("node").orderBy("pivot"))).filter(
        F.col("_at") <= CORES).groupBy("node").agg(F.sort_array(F.collect_list("pivot")).alias("cores"))
    near = (F.col("node") == F.col("pivot")) | F.coalesce("near", F.lit(False))
    held = long.join(stars, ["pivot", "node"], "left").join(joined, "node", "left").select(
        "token", "node", "pivot", component.alias("component"), near.alias("near"))
    # Lists all of whose members match the pivot are left to its cluster.
    loose = held.filter("not near").select("token").distinct()
    held = write_and_read(held.join(loose, "token"), "open-lists")
    # Outside the core here means not near the pivot: each of these is compared with all members.
    members = held.withColumn("core", F.lit(True)).select(
        "token", "node", "core", F.col("near").alias("component"), F.col("component").alias("part")
    ).join(sets.select("node", "n_shingles", "signature"), "node").join(cores, "node", "left")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("star", pa.bool_())])

    def core_matrix(column):
        """The cores of each member; the empty places of two members never agree."""
        matrix = np.empty((len(column), CORES), np.int64)
        matrix[:] = -1 - np.arange(matrix.size).reshape(matrix.shape)
        for i, values in enumerate(column.to_pylist()):
            if values:
                matrix[i, : len(values)] = values
        return matrix

    def compare(table):
        query, target = _sides(table.sort_by("node"))
        found = {}
        if query.num_rows and target.num_rows:
            q_cores, t_cores = core_matrix(query.column("cores")), core_matrix(target.column("cores"))
            q_signs, t_signs = _signatures(query.column("signature")), _signatures(target.column("signature"))
            q_nodes, q_parts, q_sizes = (query.column(c).to_numpy() for c in ("node", "part", "n_shingles"))
            t_nodes, t_parts, t_sizes = (target.column(c).to_numpy() for c in ("node", "part", "n_shingles"))

            def add(node, others, star):
                for other in others.tolist():
                    if other != node:
                        pair = (node, other)
                        found[pair] = found.get(pair, False) or star

            def alike(k, signs, sizes):
                own = q_signs[0][k], q_signs[1][k]
                return (_matches(signs, own) >= matches) & _alike(sizes, q_sizes[k], similarity)

            def apart(k):
                """Targets that are neither joined with k nor in a cluster with it."""
                together = np.zeros(len(t_nodes), bool)
                for core in q_cores[k][q_cores[k] >= 0]:
                    together |= (t_cores == core).any(axis=1)
                return ~together & (t_parts != q_parts[k])

            # Of each query: the targets that match it, and those of them that are open.
            hits, wanted = (np.zeros((len(q_nodes), len(t_nodes)), bool) for _ in range(2))
            for k in range(len(q_nodes)):
                opens = apart(k)
                if opens.any():
                    hits[k] = alike(k, t_signs, t_sizes)
                    wanted[k] = hits[k] & opens
            asks, asked = wanted.any(axis=1), wanted.any(axis=0)
            nodes, first = np.unique(np.concatenate((q_nodes[asks], t_nodes[asked])), return_index=True)
            if len(nodes) > STAR_ROWS:
                parts = np.concatenate((q_parts[asks], t_parts[asked]))[first]
                names, times = np.unique(parts, return_counts=True)
                add(int(nodes[parts == names[times.argmax()]][0]), nodes, True)
                asks[:] = False
            covered = np.full(len(q_nodes), -1)
            for k in np.flatnonzero(asks):
                if covered[k] < 0:
                    mine = np.flatnonzero(asks & (covered < 0) & alike(k, q_signs, q_sizes))
                    covered[mine] = k
                    # The cluster settles what is open between its own and what it reaches; others need no place in it.
                    settled = wanted[mine] & hits[k]
                    add(int(q_nodes[k]), q_nodes[mine[settled.any(axis=1)]], True)
                    add(int(q_nodes[k]), t_nodes[settled.any(axis=0)], True)
                else:
                    add(int(q_nodes[k]), t_nodes[wanted[k] & ~hits[covered[k]]], False)
        columns = list(zip(*[(a, b, star) for (a, b), star in found.items()])) or [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return _blocks(members, "token", ["part", "cores", "n_shingles", "signature"], BLOCK_ROWS).applyInArrow(
        compare, "a long, b long, star boolean").groupBy("a", "b").agg(F.max("star").alias("star"))


def _common(left, right):
    """Sizes of the intersections of all sets of ``left`` with all of ``right``, by sparse columns in slices."""
    flat = np.concatenate([*left, *right])
    values, times = np.unique(flat, return_counts=True)
    values = values[times > 1]
    total = np.zeros((len(left), len(right)), np.float32)
    if not len(values):
        return total

    def places(sets):
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        data = np.concatenate(sets)
        columns = np.minimum(np.searchsorted(values, data), len(values) - 1)
        real = values[columns] == data
        order = np.argsort(columns[real], kind="stable")
        return rows[real][order], columns[real][order]

    sides = [places(left), places(right)]
    for start in range(0, len(values), 2048):
        dense = []
        for (rows, columns), n in zip(sides, total.shape):
            a, b = np.searchsorted(columns, (start, start + 2048))
            part = np.zeros((n, min(2048, len(values) - start)), np.float32)
            part[rows[a:b], columns[a:b] - start] = 1
            dense.append(part)
        total += dense[0] @ dense[1].T
    return total


def close_clusters(stars, joined, texts, size, similarity):
    """Links (a, b) between members of a pivot's cluster that are not joined yet, confirmed on full sets.

    ``stars`` has pivots as ``a`` and the nodes that match them as ``b``; either may be the lesser number.
    Only as many links as join the components of a block are returned.
    """
    # One row per node, with all its pivots: its component is looked up once, and of the members only those of
    # clusters that are not one component are joined.
    held = write_and_read(
        stars.select(F.col("a").alias("pivot"), F.col("b").alias("node")).union(
            stars.select(F.col("a").alias("pivot"), F.col("a").alias("node")))
        .groupBy("node").agg(F.collect_set("pivot").alias("pivots")).join(joined, "node", "left")
        .select("node", "pivots", F.coalesce("component", "node").alias("component")), "clusters")
    members = held.select(F.explode("pivots").alias("pivot"), "node", "component")
    mixed = members.groupBy("pivot").agg(
        F.min("component").alias("_least"), F.max("component").alias("_most"),
        F.max(F.when(F.col("pivot") == F.col("node"), F.col("component"))).alias("core")
    ).filter("_least != _most").select("pivot", "core")
    members = write_and_read(members.join(mixed, "pivot"), "open-clusters")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table):
        query, target = _sides(table)
        found, parent = [], {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        if query.num_rows and target.num_rows:
            left, right = (_shingles([grams.encode(t) for t in side.column("text").to_pylist()], size) for side in (query, target))
            both = _common(left, right)
            sizes = [np.array([len(x) for x in side]) for side in (left, right)]
            similar = 100 * both >= similarity * (sizes[0][:, None] + sizes[1][None, :] - both)
            nodes, parts = zip(*((side.column("node").to_pylist(), side.column("component").to_pylist()) for side in (query, target)))
            for i, k in zip(*np.nonzero(similar)):
                a, b = root(parts[0][i]), root(parts[1][k])
                if a != b:
                    parent[a] = b
                    found.append((nodes[0][i], nodes[1][k]))
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], schema=schema)

    return _blocks(members.join(texts, "node"), "pivot", ["text"], CLUSTER_ROWS).applyInArrow(compare, "a long, b long")


def near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY):
    """The group of every document: doc_id, digest (of its text), n_shingles, component_id and kept.

    Documents are linked when their sets of word shingles have at least ``similarity`` per cent in common;
    component_id is the least doc_id reachable, and the document that has it is kept. A document of fewer words
    than a shingle is one shingle; without words it is linked with nothing and kept. Rows that repeat a
    document share its result. A null doc_id counts as the least of all. An empty table gives no rows.
    """
    keyed = fields(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    signed = write_and_read(sign(keyed, shingle), "signed")
    enough = needed_matches(similarity, COORDINATES + COUNTED)
    first = F.struct("doc_id", "digest")
    sets = write_and_read(
        signed.filter("key is not null").groupBy("key").agg(
            F.min(first).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()), "sets")

    lists = postings(sets, needed_matches(similarity))
    pairs = write_and_read(count_matches(write_and_read(first_pairs(lists), "pairs"), sets, enough, similarity), "matched")

    def nodes_of(pairs):
        return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def fetch(nodes):
        """Texts of these nodes. The list grows with the corpus, so it is never broadcast: both sides are shuffled at every size."""
        wanted = write_and_read(nodes.join(sets.select("node", "least.*"), "node"), "wanted")
        return write_and_read(
            keyed.join(wanted.hint("merge"), ["doc_id", "digest"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    # Only of what has a partner by its signature: nodes that are merely posted are many more than in proportion.
    texts = fetch(nodes_of(pairs))

    def apart(pairs, joined):
        for side in "ab":
            pairs = pairs.join(joined.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
        return pairs.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")

    # One pair per member first; then only what these links have not joined.
    nearest = write_and_read(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "nearest")
    joined = components(confirm(nearest, texts, shingle, similarity))
    others = apart(pairs.join(nearest, ["a", "b"], "left_anti"), joined)
    joined = merge_components(joined, write_and_read(confirm(others, texts, shingle, similarity), "links"))
    # Then what pivots cannot tell: first the clusters of pivots, so that the members of a group are mostly one component
    # before those of long lists that are away from their pivot are compared; last the clusters that these add to.
    stars = pairs.filter("star").select("a", "b")
    joined = merge_components(joined, write_and_read(close_clusters(stars, joined, texts, shingle, similarity), "links"))
    more = write_and_read(open_pairs(lists, joined, pairs, sets, enough, similarity), "open")
    if not more.isEmpty():
        texts = texts.union(fetch(nodes_of(more).join(nodes_of(pairs), "node", "left_anti")))
        undirected = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = apart(undirected.join(pairs, ["a", "b"], "left_anti"), joined)
        joined = merge_components(joined, write_and_read(confirm(fresh, texts, shingle, similarity), "links"))
        added = more.filter("star").select("a", "b")
        stars = stars.join(added.select("a").distinct(), "a", "left_semi").union(added).distinct()
        joined = merge_components(joined, write_and_read(close_clusters(stars, joined, texts, shingle, similarity), "links"))

    named = sets.select("key", "node", F.col("least.doc_id").alias("own"))
    linked = joined.join(named, "node")
    heads = joined.select("component").distinct().join(named.select(F.col("node").alias("component"), "own"), "component")
    least = linked.select("component", "own").union(heads).groupBy("component").agg(F.min("own").alias("least_id"))
    member_of = joined.union(heads.select("component", "component"))
    group = write_and_read(
        member_of.join(least, "component").select("node", "least_id").join(named, "node", "right")
        .select("key", F.coalesce("least_id", "own").alias("least_id")), "groups")
    found = signed.join(group, "key", "left").select(
        "doc_id", "digest", "n_shingles", F.coalesce("least_id", "doc_id").alias("component_id"))
    doc_id, component_id = (F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) for c in ("doc_id", "component_id"))
    return found.select(doc_id, "digest", "n_shingles", component_id, (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _are_stars(links):
    """Whether no node (b) hangs on two others (a), or on one that hangs itself."""
    ends = links.select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.lit(0).alias("hangs")), F.struct(F.col("b").alias("node"), F.lit(1).alias("hangs")))))
    open_nodes = ends.groupBy("node").agg(F.sum("hangs").alias("up"), F.count(F.lit(1)).alias("n")).filter("up > 0 and n > 1")
    return open_nodes.count() == 0


def components(nodes_links):
    """(node, component): the least node reachable over undirected links (a, b), for all but the least ones.

    Alternates large-star and small-star steps, which link neighbours to their least neighbour, until only stars
    are left; the number of rounds grows with the logarithm of the longest path. Every round is written, so none
    repeats another.
    """
    links = write_and_read(nodes_links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    while not _are_stars(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(
            F.inline(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))))
        links = write_and_read(small.filter("a < b").distinct(), "links")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component"))


def merge_components(joined, links):
    """``joined``, the (node, component) of earlier links, after more of them.

    Only links between different components take part, as links of these; without one nothing is done.
    """
    for side in "ab":
        own = joined.select(F.col("node").alias(side), F.col("component").alias("_to"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
    merged = components(links)
    if merged.isEmpty():
        return joined
    further = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    moved = joined.join(further, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return write_and_read(moved.union(merged), "components")
