"""Words and rolling word windows of many texts at once, as numpy arrays of hashes.

Hashes are polynomials modulo 2**64 with fixed odd bases, mixed at the end. Prefix sums give every word and
every window in a few array operations; texts are worked on in slabs, so memory does not depend on how many
there are.
"""
import numpy as np

SLAB_BYTES = 256 << 10

_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_CHECK_BASE = 0xA0761D6478BD642F
_SPACE = 32


def _fold(space):
    """A byte table that maps every separator to a space."""
    return bytes(_SPACE if space(b) else b for b in range(256))


def _lower(folded):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in folded)


# Words of the contracts: between ASCII white space, unchanged or lower-cased; or runs of a-z, 0-9 and
# anything beyond ASCII, lower-cased. All separators are ASCII, so UTF-8 bytes can be classified one by one.
SPACED = _fold(lambda b: b == 32 or 9 <= b <= 13)
SPACED_LOWER = _lower(SPACED)
LETTERS = _lower(_fold(lambda b: not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)))


def encode(text):
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(data, table):
    """The words of one text as a list of bytes."""
    return data.translate(table).split()


def mix(x):
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse, extended on demand."""

    def __init__(self, base):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n):
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))))
                for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


_TABLES = {base: _Powers(base) for base in (_BYTE_BASE, _WORD_BASE, _CHECK_BASE)}


def _prefix(values, base):
    up, down = _TABLES[base].get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return sums, down


def word_hashes(texts, table):
    """Hashes of all words of ``texts`` (bytes) and ``first``: text i has words first[i] to first[i + 1]."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join([*texts, b""]).translate(table), np.uint8)
    ends_of_texts = np.cumsum(lengths)
    inside = np.zeros(len(data) + 2, np.int8)
    np.not_equal(data, _SPACE, out=inside[1:-1], casting="unsafe")
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    # One more than the byte, so that no byte counts as nothing.
    sums, down = _prefix(data.astype(np.uint64) + np.uint64(1), _BYTE_BASE)
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    first = np.concatenate(([0], np.searchsorted(starts, ends_of_texts)))
    return hashes, first


def windows(hashes, first, k, base=_WORD_BASE):
    """Hash of the ``k`` words from each word on, and whether they all belong to its text."""
    n = len(hashes)
    values, whole = np.zeros(n, np.uint64), np.zeros(n, bool)
    if n >= k:
        sums, down = _prefix(hashes, base)
        values[: n - k + 1] = mix((sums[k:] - sums[: n - k + 1]) * down[: n - k + 1])
        last = np.repeat(first[1:], np.diff(first))
        whole = np.arange(n) + k <= last
    return values, whole


def check_windows(hashes, k):
    """A second, independent hash of the ``k`` words from each word on."""
    return windows(hashes, np.array([0, len(hashes)]), k, _CHECK_BASE)[0]


def slabs(sizes, limit=SLAB_BYTES):
    """Cut a sequence of sizes into consecutive ranges of about ``limit``; a larger item stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
