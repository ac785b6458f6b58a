"""Step functions of the learners: regression, drift detection, half-space trees.

Spark partitions rows by route and chunk, orders them and moves the state; the
classes here are the small step functions that run inside a task. ``advance``
accepts any slice of a route, so batches and micro-batches share it.
"""
import hashlib
import json
import math

import numpy as np

# Passive-aggressive regression.
PA_LIMIT, PA_TOLERANCE = 1.0, 0.1
# Adaptive window.
DRIFT_DELTA, DRIFT_CHECK_EVERY, DRIFT_RUN, DRIFT_SIDE_MIN = 0.002, 32, 5, 5
# Half-space trees.
TREES, TREE_HEIGHT, TREE_BLOCK, TREE_SEED = 10, 8, 250, 42
RESIDUAL_SPAN = 3600.0


class PassiveAggressive:
    """PA-I regression on features standardised by their running statistics."""

    def __init__(self, width=3):
        self.n = 0
        self.mean, self.m2, self.weight = [0.0] * width, [0.0] * width, [0.0] * width
        self.bias = 0.0

    def _standard(self, x):
        if self.n == 0:
            return [0.0] * len(x)
        return [
            (v - m) / math.sqrt(s / self.n) if s > 0 else 0.0
            for v, m, s in zip(x, self.mean, self.m2)
        ]

    def _output(self, z):
        return self.bias + sum(w * v for w, v in zip(self.weight, z))

    def predict(self, x):
        return self._output(self._standard(x))

    def learn(self, x, y):
        self.n += 1
        for i, v in enumerate(x):
            delta = v - self.mean[i]
            self.mean[i] += delta / self.n
            self.m2[i] += delta * (v - self.mean[i])
        z = self._standard(x)
        error = y - self._output(z)
        loss = max(0.0, abs(error) - PA_TOLERANCE)
        norm = sum(v * v for v in z)
        step = math.copysign(min(PA_LIMIT, loss / norm) if norm > 0 else min(PA_LIMIT, loss), error)
        self.weight = [w + step * v for w, v in zip(self.weight, z)]
        self.bias += step


class AdaptiveWindow:
    """Window of summed buckets that shrinks when its two ends differ."""

    def __init__(self, buckets=(), ticks=0):
        # Oldest first; each bucket is [count, sum, squared deviation].
        self.buckets = [list(b) for b in buckets]
        self.ticks = ticks

    def add(self, value):
        buckets = self.buckets
        buckets.append([1, value, 0.0])
        if len(buckets) > DRIFT_RUN and buckets[-1 - DRIFT_RUN][0] == 1:
            self._merge_runs()
        self.ticks += 1
        return self.ticks % DRIFT_CHECK_EVERY == 0 and self._shrink()

    def _merge_runs(self):
        """Keep at most DRIFT_RUN buckets of each size by merging the two oldest. Sizes never grow towards the newest."""
        buckets = self.buckets
        end = len(buckets)
        while end > DRIFT_RUN and buckets[end - 1 - DRIFT_RUN][0] == buckets[end - 1][0]:
            size, start = buckets[end - 1][0], end - 1 - DRIFT_RUN
            while start > 0 and buckets[start - 1][0] == size:
                start -= 1
            (n, s, d), (m, t, e) = buckets[start], buckets[start + 1]
            gap = s / n - t / m
            buckets[start:start + 2] = [[n + m, s + t, d + e + gap * gap * n * m / (n + m)]]
            end = start + 1

    def _shrink(self):
        dropped = False
        while self._has_cut():
            self.buckets.pop(0)
            dropped = True
        return dropped

    def _has_cut(self):
        n = sum([b[0] for b in self.buckets])
        if n < 2 * DRIFT_SIDE_MIN:
            return False
        total = sum([b[1] for b in self.buckets])
        mean = total / n
        variance = sum([d + c * (a / c - mean) ** 2 for c, a, d in self.buckets]) / n
        log_term = math.log(2.0 * n / DRIFT_DELTA)
        share, sqrt = 2.0 / 3.0, math.sqrt
        n0 = s0 = 0.0
        for count, amount, _ in self.buckets[:-1]:
            n0 += count
            s0 += amount
            n1 = n - n0
            if n0 < DRIFT_SIDE_MIN or n1 < DRIFT_SIDE_MIN:
                continue
            inverse = 1.0 / n0 + 1.0 / n1
            if abs(s0 / n0 - (total - s0) / n1) > sqrt(2.0 * inverse * variance * log_term) + share * inverse * log_term:
                return True
        return False


def _seeded(*parts):
    """32 bits of the digest of the seed and ``parts``; the same on every machine."""
    text = ":".join(str(p) for p in (TREE_SEED, *parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def _tree_table():
    """Split attribute and threshold of every inner node; independent of the data.

    The root box of an attribute reaches past [0, 1] around a seeded centre;
    every node halves its box along a seeded attribute.
    """
    inner = 2 ** TREE_HEIGHT - 1
    attribute = np.zeros((TREES, inner), dtype=np.int64)
    threshold = np.zeros((TREES, inner))
    for t in range(TREES):
        centre = np.array([_seeded("centre", t, a) / 2.0 ** 32 for a in range(2)])
        reach = 2.0 * np.maximum(centre, 1.0 - centre)
        boxes = {0: np.stack([centre - reach, centre + reach])}
        for node in range(inner):
            box = boxes.pop(node)
            a = _seeded("split", t, node) % 2
            cut = (box[0, a] + box[1, a]) / 2.0
            attribute[t, node], threshold[t, node] = a, cut
            boxes[2 * node + 1], boxes[2 * node + 2] = box.copy(), box.copy()
            boxes[2 * node + 1][1, a] = cut
            boxes[2 * node + 2][0, a] = cut
    return attribute, threshold


class HalfSpaceTrees:
    """Mass-based anomaly score against the masses of the previous block."""

    attribute, threshold = _tree_table()

    def __init__(self, filled=0, first=True, latest=None, reference=None):
        nodes = 2 ** (TREE_HEIGHT + 1) - 1
        self.filled, self.first = filled, first
        self.latest = np.zeros((TREES, nodes)) if latest is None else latest
        self.reference = np.zeros((TREES, nodes)) if reference is None else reference

    def _paths(self, points):
        node = np.zeros((len(points), TREES), dtype=np.int64)
        paths = [node]
        trees = np.arange(TREES)
        for _ in range(TREE_HEIGHT):
            a = self.attribute[trees, node]
            right = np.take_along_axis(points, a, axis=1) >= self.threshold[trees, node]
            node = 2 * node + 1 + right
            paths.append(node)
        return np.stack(paths, axis=2)

    def _score(self, paths):
        mass = self.reference[np.arange(TREES)[None, :, None], paths]
        small = mass < 0.1 * TREE_BLOCK
        # A walk ends after its first sparsely populated node.
        walked = np.cumsum(small, axis=2) - small == 0
        total = (mass * walked * 2.0 ** np.arange(TREE_HEIGHT + 1)).sum(axis=(1, 2))
        return 1.0 - total / (TREES * TREE_BLOCK * (2.0 ** (TREE_HEIGHT + 1) - 1))

    def advance(self, residual, hour):
        """Score, then learn, each row in order."""
        scaled = np.clip(residual / (2.0 * RESIDUAL_SPAN) + 0.5, 0.0, 1.0)
        points = np.column_stack([scaled, hour / 24.0])
        scores = np.zeros(len(points))
        at = 0
        while at < len(points):
            stop = min(len(points), at + TREE_BLOCK - self.filled)
            paths = self._paths(points[at:stop])
            if not self.first:
                scores[at:stop] = self._score(paths)
            for t in range(TREES):
                self.latest[t] += np.bincount(paths[:, t].ravel(), minlength=self.latest.shape[1])
            self.filled += stop - at
            if self.filled == TREE_BLOCK:
                self.reference, self.latest = self.latest, np.zeros_like(self.latest)
                self.filled, self.first = 0, False
            at = stop
        return scores


class RouteSequence:
    """What of a route is sequential by nature: regression weights and drift window.

    ``epoch`` counts the drifts before a row and ``epoch_seq`` the rows since the last one; a drift resets the
    regression. All else that scoring needs follows from these columns by windowed operators.
    """

    def __init__(self):
        self.regression, self.window = PassiveAggressive(), AdaptiveWindow()
        self.seen = self.epoch = self.epoch_seq = 0

    def advance(self, x, y):
        """Features (rows x 3, hour first) and headways in order; returns columns.

        Order within a row: predict, residual, drift test and reset, regression learning.
        """
        add, sqrt, copysign = self.window.add, math.sqrt, math.copysign
        guesses, misses, drifts = [], [], []
        model = self.regression
        n, bias = model.n, model.bias
        (a0, a1, a2), (q0, q1, q2), (w0, w1, w2) = model.mean, model.m2, model.weight
        # The steps of PassiveAggressive on plain numbers: a route's rows pass here one by one.
        z0 = z1 = z2 = 0.0
        for (x0, x1, x2), target in zip(x.tolist(), y.tolist()):
            if n:
                z0 = (x0 - a0) / sqrt(q0 / n) if q0 > 0 else 0.0
                z1 = (x1 - a1) / sqrt(q1 / n) if q1 > 0 else 0.0
                z2 = (x2 - a2) / sqrt(q2 / n) if q2 > 0 else 0.0
            else:
                z0 = z1 = z2 = 0.0
            guess = (bias + sum((w0 * z0, w1 * z1, w2 * z2))) or target
            miss = target - guess
            drifted = add(min(abs(miss) / RESIDUAL_SPAN, 1.0))
            guesses.append(guess)
            misses.append(miss)
            drifts.append(drifted)
            if drifted:
                n, bias = 0, 0.0
                a0 = a1 = a2 = q0 = q1 = q2 = w0 = w1 = w2 = 0.0
            n += 1
            delta = x0 - a0
            a0 += delta / n
            q0 += delta * (x0 - a0)
            delta = x1 - a1
            a1 += delta / n
            q1 += delta * (x1 - a1)
            delta = x2 - a2
            a2 += delta / n
            q2 += delta * (x2 - a2)
            z0 = (x0 - a0) / sqrt(q0 / n) if q0 > 0 else 0.0
            z1 = (x1 - a1) / sqrt(q1 / n) if q1 > 0 else 0.0
            z2 = (x2 - a2) / sqrt(q2 / n) if q2 > 0 else 0.0
            error = target - (bias + sum((w0 * z0, w1 * z1, w2 * z2)))
            loss = max(0.0, abs(error) - PA_TOLERANCE)
            norm = sum((z0 * z0, z1 * z1, z2 * z2))
            step = copysign(min(PA_LIMIT, loss / norm) if norm > 0 else min(PA_LIMIT, loss), error)
            w0 += step * z0
            w1 += step * z1
            w2 += step * z2
            bias += step
        model.n, model.bias = n, bias
        model.mean, model.m2, model.weight = [a0, a1, a2], [q0, q1, q2], [w0, w1, w2]
        drifted = np.array(drifts, dtype=bool)
        place = np.arange(len(drifts))
        before = np.cumsum(drifted) - drifted
        # Rows since the last drift: a row with a drift still counts to the epoch that it ends.
        since = np.maximum.accumulate(np.concatenate(([-1], np.where(drifted, place, -1))))[:-1]
        epoch_seq = np.where(since >= 0, place - since - 1, self.epoch_seq + place)
        out = {
            "seq": self.seen + place, "epoch": self.epoch + before, "epoch_seq": epoch_seq,
            "predicted_headway_sec": guesses, "residual": misses, "drifted": drifted}
        if len(drifts):
            self.epoch_seq = 0 if drifts[-1] else int(epoch_seq[-1]) + 1
        self.seen += len(drifts)
        self.epoch += int(drifted.sum())
        return out

    def to_json(self):
        r = self.regression
        return json.dumps({
            "seen": self.seen, "epoch": self.epoch, "epoch_seq": self.epoch_seq, "ticks": self.window.ticks,
            "buckets": self.window.buckets, "n": r.n, "mean": r.mean, "m2": r.m2, "weight": r.weight, "bias": r.bias,
        })

    @classmethod
    def from_json(cls, text):
        saved, route = json.loads(text), cls()
        route.seen, route.epoch, route.epoch_seq = (saved[k] for k in ("seen", "epoch", "epoch_seq"))
        route.window = AdaptiveWindow(saved["buckets"], saved["ticks"])
        for name in ("n", "mean", "m2", "weight", "bias"):
            setattr(route.regression, name, saved[name])
        return route
