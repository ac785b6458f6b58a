"""Denoising autoencoder step functions (numpy), used inside Spark tasks."""
import numpy as np

# Layer widths for ten features, and training parameters.
LAYERS = [10, 40, 20, 40, 10]
NOISE_STD, MASK_RATIO, LEARNING_RATE, EPOCHS = 0.08, 0.2, 0.0012, 4
_DECAY1, _DECAY2, _TINY = 0.9, 0.999, 1e-8


def _shapes():
    for fan_in, fan_out in zip(LAYERS, LAYERS[1:]):
        yield (fan_in, fan_out), fan_in
        yield (fan_out,), fan_in


def initial_weights(seed=7):
    """Flat weight vector, uniform in +-1/sqrt(fan in)."""
    rng = np.random.default_rng(seed)
    return np.concatenate([
        rng.uniform(-1.0, 1.0, int(np.prod(shape))) / np.sqrt(fan_in) for shape, fan_in in _shapes()
    ])


def _split(flat):
    parts, at = [], 0
    for shape, _ in _shapes():
        size = int(np.prod(shape))
        parts.append(flat[at:at + size].reshape(shape))
        at += size
    return list(zip(parts[::2], parts[1::2]))


def _forward(layers, x):
    outputs = [x]
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        # ReLU between layers, none on the reconstruction.
        x = np.maximum(x, 0.0) if i < len(layers) - 1 else x
        outputs.append(x)
    return outputs


def row_errors(flat, x):
    """Mean squared reconstruction error of each row."""
    return np.mean((_forward(_split(flat), x)[-1] - x) ** 2, axis=1)


def gradient(flat, corrupted, clean):
    """Loss and gradient of the mean squared reconstruction error."""
    layers = _split(flat)
    outputs = _forward(layers, corrupted)
    gap = outputs[-1] - clean
    delta = 2.0 * gap / gap.size
    grads = []
    for i in range(len(layers) - 1, -1, -1):
        grads.append(np.concatenate([(outputs[i].T @ delta).ravel(), delta.sum(axis=0)]))
        if i:
            delta = (delta @ layers[i][0].T) * (outputs[i] > 0)
    return float(np.mean(gap ** 2)), np.concatenate(grads[::-1])


# Increment and multipliers of the SplitMix64 generator.
_GAMMA, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _uniform(keys, shape, seed):
    """Numbers in (0, 1) that depend on the row's key, the place in the row and the seed only."""
    # The seed is spread first, so neighbouring seeds draw unrelated numbers.
    start = (int(seed) * _MIX1 + _GAMMA) % (1 << 64)
    places = np.arange(1, shape[1] + 1, dtype=np.uint64) * np.uint64(_GAMMA)
    z = (keys.astype(np.int64).view(np.uint64) ^ np.uint64(start))[:, None] + places[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX2)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def corrupt(x, keys, seed):
    """``x`` with Gaussian noise and masked entries; a row's draw depends on its key, so on no order or partition."""
    first, second, mask = (_uniform(keys, x.shape, 3 * seed + i) for i in range(3))
    noise = np.sqrt(-2.0 * np.log(first)) * np.cos(2.0 * np.pi * second)
    return (x + NOISE_STD * noise) * (mask > MASK_RATIO)


class Adam:
    """Weights and moments; one step per gradient."""

    def __init__(self, flat):
        self.flat = np.array(flat, dtype=float)
        self.m, self.v, self.t = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def step(self, g):
        self.t += 1
        self.m = _DECAY1 * self.m + (1 - _DECAY1) * g
        self.v = _DECAY2 * self.v + (1 - _DECAY2) * g * g
        m, v = self.m / (1 - _DECAY1 ** self.t), self.v / (1 - _DECAY2 ** self.t)
        self.flat = self.flat - LEARNING_RATE * m / (np.sqrt(v) + _TINY)
