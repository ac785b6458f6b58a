"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text as windows of ``SPAN`` bytes, once from each side, labels every byte, and pools the
label probabilities of all bytes of the document. It is trained here, in numpy, by backpropagation through
time: on a bounded sample first, then by gradients that the tasks sum over all labelled documents. Inference runs
in the tasks over whole texts, many windows at a time.
"""
import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from headwise.llm import grams
from headwise.llm.common import fields, without, write_and_read
from headwise.operators.quantiles import exact_quantiles

SPAN = 64
HIDDEN = 8
#: Bounds of what training begins with: documents per language, and windows of each.
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 4
EPOCHS = 8
BATCH = 256
RATE = 0.02
#: Steps over all labelled documents, the rate of the first, windows worked on at once, and the unit of sums.
REFINE_STEPS = 64
REFINE_RATE = 0.02
REFINE_BATCH = 2048
GRADIENT_UNIT = 2.0 ** 44
#: Windows that are read at once.
SLAB = 2048
#: :func:`keep_known` rejects scores below this share of a low quantile of what labelled documents have at a length (bytes).
MARGIN = 0.8
QUANTILE = 0.0025
LENGTHS = (1, 8, 16, 32, 64, 128, 256, 512, 1024, 2048)
CUTS = sorted({*LENGTHS, *(2 * n for n in LENGTHS)})
UNKNOWN = "und"
#: Positions, at most, whose gradients are summed at once.
BLOCK = 4
#: Exponentials of up to this are far from the end of the range of single precision.
MOST_EXPONENT = 60


#: Arrays that a process uses again from batch to batch: new ones of that size cost more than what is computed in them.
_ROOMS = {}


def _room(name, shape, dtype):
    size = math.prod(shape) * np.dtype(dtype).itemsize
    if name not in _ROOMS or len(_ROOMS[name]) < size:
        _ROOMS[name] = np.empty(size, np.uint8)
    return _ROOMS[name][:size].view(dtype).reshape(shape)


#: Whether numpy takes 16 numbers at once here: only then a tanh costs less than an exponential and a division.
_UMATH = getattr(getattr(np, "_core", None), "_multiarray_umath", None)
WIDE = bool(getattr(_UMATH, "__cpu_features__", {}).get("AVX512_SKX"))


def _scales():
    """Factors of the sums that :func:`_gate` and :func:`_candidate` take."""
    return (0.5, 1) if WIDE else (-1, -2)


def _gate(x):
    """Logistic function, in place: (1 + tanh(x / 2)) / 2 or 1 / (1 + exp(-x))."""
    if WIDE:
        np.tanh(x, out=x)
        x *= 0.5
        x += 0.5
    else:
        np.exp(x, out=x)
        x += 1
        np.divide(1, x, out=x)


def _candidate(x):
    """Tanh, in place, or as 2 / (1 + exp(-2 x)) - 1."""
    if WIDE:
        np.tanh(x, out=x)
    else:
        np.exp(x, out=x)
        x += 1
        np.divide(2, x, out=x)
        x -= 1


class Network:
    """Weights of the two directions and of the labels; ``parameters`` are arrays that training updates."""

    def __init__(self, n_labels, hidden=HIDDEN, seed=7):
        rng = np.random.default_rng(seed)

        def normal(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        self.hidden = hidden
        # Per direction: input table of every byte to gates (update, reset, candidate), recurrent weights of the
        # gates, recurrent weights of the candidate.
        self.parameters = []
        for _ in range(2):
            self.parameters += [normal(16, 256, 3 * hidden)[0] * 2, normal(hidden, 2 * hidden), normal(hidden, hidden)]
        self.parameters += [normal(2 * hidden, n_labels), np.zeros(n_labels, np.float32)]

    def _direction(self, side, steps, states, keep):
        """Fill ``states``, (positions, states, windows), with those after each step; with ``keep`` return the gates and candidates."""
        table, gates, candidate = (p.T.copy() for p in self.parameters[3 * side: 3 * side + 3])
        n, h = steps.shape[1], self.hidden
        of_gates, of_candidates = _scales()
        table[: 2 * h] *= of_gates
        table[2 * h:] *= of_candidates
        gates *= of_gates
        candidate *= of_candidates
        # Worked on in place, step by step, so that they stay in the cache.
        x, sums, reset, moved = (np.empty((rows * h, n), table.dtype) for rows in (3, 2, 1, 1))
        kept = _room(f"kept {side}", (len(steps), 3 * h, n), table.dtype)[::-1 if side else 1] if keep else None
        state, index = np.zeros((h, n), table.dtype), np.empty(n, np.intp)
        for t in range(len(steps)):
            index[:] = steps[t]
            x = kept[t] if keep else x
            table.take(index, axis=1, out=x, mode="clip")
            zr, c = x[: 2 * h], x[2 * h:]
            zr += np.matmul(gates, state, out=sums)
            _gate(zr)
            np.multiply(zr[h:], state, out=reset)
            c += np.matmul(candidate, reset, out=moved)
            _candidate(c)
            np.subtract(c, state, out=moved)
            moved *= zr[:h]
            state = np.add(state, moved, out=states[t])
        return kept

    def forward(self, steps, keep=False):
        """Label probabilities of every position as (positions, labels, windows): ``steps`` is (positions, windows) of bytes."""
        h = self.hidden
        both = _room("both", (len(steps), 2 * h, steps.shape[1]), self.parameters[0].dtype)
        # An exponential beyond the range is infinite, and its gate 0.
        with np.errstate(over="ignore"):
            kept_ahead = self._direction(0, steps, both[:, :h], keep)
            kept_back = self._direction(1, steps[::-1], both[::-1, h:], keep)
        weights, shift = self.parameters[6:]
        odds = np.matmul(weights.T, both, out=_room("odds", (len(steps), len(shift), steps.shape[1]), both.dtype))
        odds += shift[:, None]
        # States lie between -1 and 1: only large weights need care that no exponential overflows.
        if not np.abs(weights).sum(axis=0).max() + np.abs(shift).max() < MOST_EXPONENT:
            odds -= odds.max(axis=1, keepdims=True)
        np.exp(odds, out=odds)
        odds /= odds.sum(axis=1, keepdims=True)
        return odds, both, kept_ahead, kept_back

    def gradients(self, steps, mask, labels, weights=None, loss=True):
        """Cross entropy of the positions (None without ``loss``) and its gradient, backwards through all steps.

        The mean of the positions, or with ``weights``, one of each window, their weighted sum.
        """
        odds, both, kept_ahead, kept_back = self.forward(steps, keep=True)
        weight = mask.astype(np.float32)
        weight *= 1 / mask.sum() if weights is None else weights.astype(np.float32)
        loss = -(np.log(np.maximum(odds[:, labels, np.arange(len(labels))], 1e-9)) * weight).sum() if loss else None
        error = odds
        error -= (labels == np.arange(odds.shape[1])[:, None]).astype(error.dtype)
        error *= weight[:, None, :]
        out = [None] * 6 + [(both @ error.transpose(0, 2, 1)).sum(axis=0), error.sum(axis=(0, 2))]
        h = self.hidden
        runs = self._runs(steps)
        out[0:3] = self._backward(0, runs, error, both[:, :h], kept_ahead)
        out[3:6] = self._backward(1, runs, error[::-1], both[::-1, h:], kept_back)
        return loss, out

    def _runs(self, steps):
        """For each block of positions: places of equal bytes side by side, these bytes, and where each byte's begin.

        Blocks are equal and so small that the gradients of their inputs are still in the cache when they are summed.
        """
        length, n = steps.shape
        size = max(k for k in range(1, BLOCK + 1) if length % k == 0)
        runs = []
        for block in steps.reshape(-1, size * n):
            order, times = np.argsort(block, kind="stable"), np.bincount(block, minlength=256)
            # In arrays of 3 * hidden rows of a position.
            order += order // n * ((3 * self.hidden - 1) * n)
            seen = np.flatnonzero(times)
            runs.append((order, seen, (np.cumsum(times) - times)[seen]))
        return runs

    def _backward(self, side, runs, error, states, kept):
        """Gradients of a direction's weights; those of the inputs take the places of ``kept``, which are in the cache."""
        table, gates, candidate = self.parameters[3 * side: 3 * side + 3]
        h, n = self.hidden, error.shape[2]
        labels = self.parameters[6][h * side: h * side + h]
        d_table, d_gates, d_candidate = np.zeros_like(table.T), np.zeros_like(gates), np.zeros_like(candidate)
        # By position.
        d_inputs, size = kept[::-1] if side else kept, len(error) // len(runs)
        in_order, sums = np.empty(size * n, gates.dtype), np.empty(table.T.shape, gates.dtype)
        d, spare, d_rs, reset = (np.empty((h, n), gates.dtype) for _ in range(4))
        carried, first = np.zeros((h, n), gates.dtype), np.zeros((h, n), gates.dtype)
        for t in range(len(error) - 1, -1, -1):
            state = states[t - 1] if t else first
            np.matmul(labels, error[t], out=d)
            d += carried
            z, r, c = kept[t][:h], kept[t][h: 2 * h], kept[t][2 * h:]
            # The slope of a candidate is 1 - c * c, that of a gate g * (1 - g).
            np.multiply(d, z, out=spare)
            np.subtract(d, spare, out=carried)
            # z * (c - state) is what the step added to the state.
            np.subtract(states[t], state, out=z)
            z *= carried
            c *= c
            np.subtract(1, c, out=c)
            c *= spare
            np.matmul(candidate, c, out=d_rs)
            d_rs *= r
            np.multiply(r, state, out=reset)
            d_candidate += reset @ c.T
            np.subtract(state, reset, out=r)
            r *= d_rs
            carried += d_rs
            d_gate = kept[t][: 2 * h]
            carried += np.matmul(gates, d_gate, out=spare)
            d_gates += state @ d_gate.T
            if t % size == 0:
                block = len(runs) - 1 - t // size if side else t // size
                order, seen, starts = runs[block]
                inputs = d_inputs[block * size: (block + 1) * size].reshape(-1)
                for k, row in enumerate(sums):
                    np.add.reduceat(inputs[k * n:].take(order, out=in_order, mode="clip"), starts, out=row[: len(seen)])
                d_table[:, seen] += sums[:, : len(seen)]
        return d_table.T, d_gates, d_candidate


def _windows(texts, span=SPAN):
    """All texts cut into windows: bytes (span, windows), mask of real bytes, and the text of each window."""
    counts = np.array([-(-len(t) // span) for t in texts], np.int64)
    data = np.frombuffer(b"".join(t.ljust(c * span, b"\0") for t, c in zip(texts, counts.tolist())), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    lengths = np.array([len(t) for t in texts], np.int64)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.minimum(lengths[owner] - place * span, span)
    return data.reshape(-1, span).T.copy(), np.arange(span)[:, None] < left[None, :], owner


def _parts(n, most):
    """Slices of ``n`` windows, equal but for one and of about ``most``, a quarter more at most: a small rest would cost nearly as much as a full part."""
    count = max(1, -(-4 * n // (5 * most)))
    size = -(-n // count)
    return [slice(start, start + size) for start in range(0, n, size)] if n else []


def _adam(parameters):
    """A function that moves ``parameters`` along gradients, at most of length 1, by a rate."""
    means = [np.zeros_like(p) for p in parameters]
    squares = [np.zeros_like(p) for p in parameters]
    step = 0

    def move(gradients, rate):
        nonlocal step
        step += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in gradients))
        scale = min(1.0, 1.0 / (size + 1e-9))
        for p, g, m, s in zip(parameters, gradients, means, squares):
            g = g * np.float32(scale)
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    return move


def train(texts, labels, n_labels, epochs=EPOCHS, seed=7, hidden=HIDDEN):
    """Fit a network to labelled texts with Adam; the result depends on its arguments alone."""
    steps, mask, owner = _windows(texts)
    answers = np.asarray(labels)[owner]
    network, rng = Network(n_labels, hidden, seed), np.random.default_rng(seed)
    move = _adam(network.parameters)
    for epoch in range(epochs):
        order = rng.permutation(len(owner))
        for start in range(0, len(order), BATCH):
            part = order[start: start + BATCH]
            move(network.gradients(steps[:, part], mask[:, part], answers[part], loss=False)[1], RATE * (1 - epoch / epochs))
    return network


def _pooled(network, texts):
    """Sums of the label probabilities over the bytes of each window, and the text of each window."""
    steps, mask, owner = _windows(texts)
    pooled = np.zeros((len(owner), len(network.parameters[7])))
    for part in _parts(len(owner), SLAB):
        odds, *_ = network.forward(steps[:, part])
        pooled[part] = np.einsum("tln,tn->nl", odds, mask[:, part].astype(np.float32))
    return pooled, owner


def document_odds(network, texts, n_labels):
    """Mean label probabilities over all bytes of each text; zeros for an empty one."""
    pooled, owner = _pooled(network, texts)
    total = np.zeros((len(texts), n_labels))
    np.add.at(total, owner, pooled)
    return total / np.maximum([[len(t)] for t in texts], 1)


def _odds_and_marks(network, texts, n_labels):
    """:func:`document_odds`, and the scores of every text cut to each of ``CUTS`` bytes; null where it is shorter."""
    pooled, owner = _pooled(network, texts)
    total, lengths = np.zeros((len(texts), n_labels)), np.array([len(t) for t in texts], np.int64)
    np.add.at(total, owner, pooled)
    ends = np.concatenate((np.zeros((1, n_labels)), np.cumsum(pooled, axis=0)))
    first = np.searchsorted(owner, np.arange(len(texts)))
    marks = np.full((len(texts), len(CUTS)), np.nan)
    for k, cut in enumerate(CUTS):
        longer = np.flatnonzero(lengths >= cut)
        if not len(longer):
            continue
        if cut % SPAN:
            odds = document_odds(network, [texts[i][:cut] for i in longer], n_labels)
        else:
            # Whole windows: a cut text has the same ones.
            odds = (ends[first[longer] + cut // SPAN] - ends[first[longer]]) / cut
        marks[longer, k] = odds.max(axis=1)
    return total / np.maximum(lengths, 1)[:, None], marks


def held_out(doc_id):
    """Documents that training never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _excerpts(pieces, chars):
    """``pieces`` runs of ``chars`` characters from places of the whole text that its digest chooses; a shorter text whole."""
    last = F.greatest(F.char_length("text") - chars, F.lit(0)) + 1
    runs = [F.substring("text", (F.pmod(F.xxhash64("doc_id", "text", F.lit(i)), last) + 1).cast("int"), F.lit(chars)) for i in range(pieces)]
    return F.when(F.char_length("text") <= pieces * chars, F.col("text")).otherwise(F.concat(*runs))


def _labelled(docs):
    """Labelled documents that are learned from: lang, doc_id and text."""
    return fields(docs, "doc_id", "text", "lang").filter("lang is not null and text is not null").filter(~held_out(F.col("doc_id")))


def training_sample(docs, per_label=SAMPLE_DOCS, pieces=SAMPLE_WINDOWS, chars=SPAN):
    """At most ``per_label`` labelled documents of every language, the ones with the least digest of doc_id and text.

    Of each text ``pieces`` runs of ``chars`` characters come along, from anywhere in it. Languages are few, so the
    sample is bounded, and all documents and places have the same chance to be in it. Training begins with it.
    """
    # A language may hold most rows: each part of it yields its least first, with partial aggregation.
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    taken = _labelled(docs).select("lang", chance.alias("chance"), _excerpts(pieces, chars).alias("text"))
    rates = taken.groupBy("lang").count().collect()
    limits = {r["lang"]: int(2 ** 63 * min(1.0, 2.0 * per_label / r["count"])) - 1 for r in rates}
    limit = F.lit(-1)
    for lang, most in limits.items():
        limit = F.when(F.col("lang") == lang, F.lit(most)).otherwise(limit)
    rows = taken.filter(F.col("chance") <= limit).toArrow().to_pylist() if rates else []
    sample = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["chance"], r["text"])):
        sample.setdefault(row["lang"], []).append(row["text"])
    return {lang: texts[:per_label] for lang, texts in sorted(sample.items())}


def learn(docs, per_label=SAMPLE_DOCS):
    """(network, languages) learned from all labelled documents, or (None, []) without any.

    A bounded sample gives the weights to begin with; then every byte of every labelled text goes into them
    (:func:`refine`).
    """
    sample = training_sample(docs, per_label)
    languages = list(sample)
    texts = [grams.encode(t) for lang in languages for t in sample[lang]]
    labels = [i for i, lang in enumerate(languages) for _ in sample[lang]]
    if not texts:
        return None, []
    return refine(docs, train(texts, labels, len(languages)), languages, per_label), languages


def _all_gradients(rows, network, languages, weights):
    """Gradients of the weighted cross entropy over all bytes of ``rows`` (lang, text), summed over the tasks.

    Sums are integers, so they do not depend on how the rows are cut.
    """
    shared = rows.sparkSession.sparkContext.broadcast((network, {lang: i for i, lang in enumerate(languages)}, weights))

    def run(batches):
        network, index, weights = shared.value
        total = [np.zeros(p.shape) for p in network.parameters]
        for batch in batches:
            langs, column = (batch.column(c).to_pylist() for c in ("lang", "text"))
            for a, b in grams.slabs([len(t) for t in column]):
                steps, mask, owner = _windows([grams.encode(t) for t in column[a:b]])
                labels = np.array([index[lang] for lang in langs[a:b]], np.int64)[owner]
                share = np.array([weights[lang] for lang in langs[a:b]])[owner]
                # Weights of single bytes are tiny: what is summed in a slab is relative to its largest one.
                unit = share.max() if len(share) else 1.0
                for part in _parts(len(owner), REFINE_BATCH):
                    _, found = network.gradients(steps[:, part], mask[:, part], labels[part], share[part] / unit, loss=False)
                    for whole, g in zip(total, found):
                        whole += g * unit
        flat = np.concatenate([g.ravel() for g in total])
        amounts = np.rint(flat * GRADIENT_UNIT).astype(np.int64)
        places = np.flatnonzero(amounts)
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(amounts[places])], names=["place", "amount"])

    sums = rows.select("lang", "text").mapInArrow(run, "place int, amount long").groupBy("place").agg(F.sum("amount").alias("amount")).toArrow()
    shared.unpersist()
    flat = np.zeros(sum(p.size for p in network.parameters))
    flat[sums.column("place").to_numpy()] = sums.column("amount").to_numpy() / GRADIENT_UNIT
    cuts = np.cumsum([p.size for p in network.parameters])[:-1]
    return [part.reshape(p.shape).astype(np.float32) for part, p in zip(np.split(flat, cuts), network.parameters)]


def refine(docs, network, languages, per_label=SAMPLE_DOCS, steps=REFINE_STEPS, rate=REFINE_RATE):
    """The network after batch-synchronous steps that together take every byte of all labelled texts once.

    Each step has a share of the documents, chosen by digest: tasks sum the gradients of its texts, the sums are added
    and the weights move once, by Adam. Languages weigh as in the sample, by ``per_label`` documents at most. Only sums,
    as many as there are weights, come to the driver.
    """
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit("share")), F.lit(steps)).cast("int")
    # Written by share, so that a step reads no other.
    rows = write_and_read(_labelled(docs).filter("text != ''").select(
        "lang", "text", F.octet_length("text").cast("long").alias("bytes"), share.alias("share")), "labelled", ["share"],
        compression="zstd", **{"parquet.enable.dictionary": "false"})
    counted = rows.groupBy("share", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()
    network = copy.deepcopy(network)
    move = _adam(network.parameters)
    for k in sorted({r["share"] for r in counted}):
        found = {r["lang"]: (min(r["n"], per_label), r["bytes"]) for r in counted if r["share"] == k}
        whole = sum(n for n, _ in found.values())
        weights = {lang: n / whole / size for lang, (n, size) in found.items()}
        move(_all_gradients(rows.filter(F.col("share") == k), network, languages, weights), rate * (1 - k / steps))
    return network


def least_scores(judged, margin=MARGIN):
    """Scores below which a text of at least each of ``LENGTHS`` bytes is unlike all labelled documents.

    These are ``margin`` times a low quantile of the scores of all labelled texts with a letter, cut to that length and to
    twice of it: few bytes tell little. The quantile is exact; it leaves out the few texts whose labels contradict each
    other. ``judged`` has ``_labelled``, ``_score`` and ``_marks``. A length that no labelled text has goes by the next
    shorter one; without any everything passes.
    """
    def mark(cut):
        return F.col("_marks")[CUTS.index(cut)]

    cut = F.array(*[F.struct(F.lit(n).alias("length"), score.alias("score")) for n in LENGTHS
                    for score in (mark(n), F.when(mark(n).isNotNull(), F.coalesce(mark(2 * n), F.col("_score"))))])
    rows = judged.filter("_labelled and _marks is not null").select(F.inline(cut)).filter("score is not null")
    found = {r["length"]: r["quantiles"][0] for r in exact_quantiles(rows, ["length"], "score", [QUANTILE]).collect()}
    # From the longest: a shorter text never needs a higher score.
    least, scores = 1.0, []
    for n in reversed(LENGTHS):
        if n in found:
            least = min(least, margin * found[n])
        scores.append(least if n in found else None)
    known = 0.0
    for i, score in enumerate(scores := scores[::-1]):
        scores[i] = known = known if score is None else score
    return scores


def identify(docs, network, languages, columns=("lang_pred", "score"), marks=None):
    """The columns of ``docs`` (text among them) with predicted language and score.

    Null texts and texts without a letter are ``und`` with score 0, as all are if no language was learned.
    The prediction depends on the text alone; input columns of the two names are replaced. ``marks`` names a further
    column: the scores of the text cut to each of ``CUTS`` bytes, null without a language.
    """
    docs = docs.drop(*columns, *([marks] if marks else []))
    shared = docs.sparkSession.sparkContext.broadcast((network, languages))

    def run(batches):
        network, languages = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text")).to_pylist()
            predicted, scores, cut = [UNKNOWN] * len(column), [0.0] * len(column), [None] * len(column)
            known = [i for i, t in enumerate(column) if t and languages and any(map(str.isalpha, t))]
            texts = [grams.encode(column[i]) for i in known]
            for a, b in grams.slabs([len(t) for t in texts]):
                if marks:
                    odds, found = _odds_and_marks(network, texts[a:b], len(languages))
                    for i, row in zip(known[a:b], found.tolist()):
                        cut[i] = [None if x != x else x for x in row]
                else:
                    odds = document_odds(network, texts[a:b], len(languages))
                for i, row in zip(known[a:b], odds):
                    best = int(row.argmax())
                    predicted[i], scores[i] = languages[best], min(1.0, float(row[best]))
            added = [pa.array(predicted, pa.string()), pa.array(scores, pa.float64())]
            names = [*columns]
            if marks:
                added.append(pa.array(cut, pa.list_(pa.float64())))
                names.append(marks)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    added = [T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.DoubleType())]
    if marks:
        added.append(T.StructField(marks, T.ArrayType(T.DoubleType())))
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(run, schema)


def keep_known(docs, per_label=SAMPLE_DOCS, margin=MARGIN):
    """Only documents whose language is recognised, with their own columns.

    Null texts, texts without a letter and those below :func:`least_scores` go. The network and these scores come from
    all labelled documents. Without any labelled document there is nothing to recognise, and all texts with a letter stay.
    """
    network, languages = learn(docs, per_label)
    if network is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    labelled = F.col("lang").isNotNull() if "lang" in docs.columns else F.lit(False)
    # The texts are not written again: what goes is looked up by doc_id and digest, as the verdict depends on the text alone.
    judged = write_and_read(identify(
        docs.select("doc_id", "text", labelled.alias("_labelled")), network, languages, ("_lang_pred", "_score"), "_marks"
    ).withColumns({"digest": F.xxhash64("text"), "_bytes": F.octet_length("text")}).drop("text"), "judged")
    needed = F.lit(0.0)
    for n, score in zip(LENGTHS, least_scores(judged, margin)):
        needed = F.when(F.col("_bytes") >= n, F.lit(score)).otherwise(needed)
    return without(docs, judged.filter((F.col("_lang_pred") == UNKNOWN) | (F.col("_score") < needed)))
