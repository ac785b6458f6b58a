"""Byte-pair merging of many pre-tokens at once, as ragged numpy arrays.

The symbols of all sequences lie one after another in one array. A round finds the lowest rank among each
sequence's neighbouring pairs and merges every place of that pair, in all sequences at the same time; sequences
without a known pair leave the array. As a merged symbol only takes part in merges of higher rank (checked when
a vocabulary is read), this gives the same symbols as merging one pair after another, lowest rank and leftmost
first. Sequences of very many symbols would need as many rounds as they have different pairs; these keep their
places by rank instead, so a round touches only the places that it merges.
"""
import heapq
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_NONE = np.int32(2**31 - 1)
#: Sequences of more symbols than this keep places by rank.
LONG = 1024
#: Chunks of text whose ids a task remembers, in each of two generations.
REMEMBERED = 250_000
#: Symbols merged in one array at most, so that memory does not depend on the number of sequences.
BATCH_SYMBOLS = 1 << 20
# Fixed value: the published split pattern of the lower-case vocabulary.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT_LINES = regex.compile(r"\n|" + _SPLIT)
# What a byte (UTF-8) makes of a chunk: 0 where letters (U+00C0 to U+024F among them), digits and ASCII signs but "'" stand,
# 1 where the pattern is needed, 2 where the library is. Of "<" and the bytes C3, C4 and C9 the next byte tells more.
_KINDS = bytes(
    0 if b == 10 or 0x21 <= b < 0x7F and b not in (39, 60) or 0x80 <= b < 0xC0 or 0xC5 <= b < 0xC9 else 2 if b == 0 or b > 0xC9 else 1
    for b in range(256))
# Classes of lower-cased bytes: letters 0, digits 1, signs 2, ends of chunks 3.
_CLASSES = bytes(3 if b == 10 else 1 if 48 <= b < 58 else 0 if 97 <= b < 123 or b >= 128 else 2 for b in range(256))


def byte_letters():
    """The published letter of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class _PairTable:
    """(left id, right id) -> rank, through three hash tables of which each takes the keys that collide before it."""

    BITS = 18

    def __init__(self, keys):
        self.tables, left = [], np.arange(len(keys))
        for factor in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1):
            if not len(left):
                break
            slots = self._slots(keys[left], factor)
            owner = np.full(1 << self.BITS, _NONE, np.int32)
            owner[slots] = left
            held = np.where(owner != _NONE, keys[np.minimum(owner, len(keys) - 1)], np.uint32(0))
            self.tables.append((factor, held, owner))
            left = left[owner[slots] != left]
        if len(left):
            raise ValueError("the pairs of this vocabulary do not fit the hash tables")

    def _slots(self, keys, factor):
        return (keys * np.uint32(factor)) >> np.uint32(32 - self.BITS)

    def ranks(self, left, right):
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        found = places = None
        for factor, held, owner in self.tables:
            slots = self._slots(keys, factor)
            owners, same = owner.take(slots), held.take(slots) == keys
            ranks = np.where(same, owners, _NONE)
            if found is None:
                found, places = ranks, np.arange(len(keys))
            else:
                found[places] = ranks
            # A key goes to the next table only if another has its slot.
            on = np.flatnonzero(~same & (owners != _NONE))
            if not len(on):
                break
            places, keys = places[on], keys[on]
        return found


class Merger:
    """A byte-level vocabulary read from a ``tokenizers`` file; gives the ids of pre-tokens by array merging."""

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.tokenizer = spec["model"], Tokenizer.from_file(path)
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE vocabularies are merged here")
        vocabulary, suffix, letters = model["vocab"], model.get("end_of_word_suffix") or "", byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.final = np.array([vocabulary[c + suffix] for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int32) for x in zip(
            *((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges)))
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids beyond 16 bits")
        self.pairs = _PairTable((self.left.astype(np.uint32) << np.uint32(16)) | self.right.astype(np.uint32))
        # Ranks of what merging begins with: letters, by a byte and the next one, 256 more for the last of a sequence.
        self.begin = self.pairs.ranks(np.repeat(self.inner, 512), np.tile(np.concatenate((self.inner, self.final)), 256))
        born = np.full(1 << 16, -1, np.int64)
        born[self.made] = np.arange(len(merges))
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge of this vocabulary comes before its parts")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.byte_of = {ord(c): b for b, c in enumerate(letters)}
        #: Whether texts of simple characters may be split here instead of by the library.
        self.simple = (json.dumps(_SPLIT) in json.dumps(spec.get("pre_tokenizer"))
                       and [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"])
        #: Whether white space only separates, so that texts may be taken word by word.
        self.by_words = self._pieces_of("a b\tc ") == [b"a", b"b", b"c"]

    def _pieces_of(self, text):
        """Pre-tokens of a text without special tokens, as bytes, by the library's own normaliser and splitter."""
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        if self.tokenizer.pre_tokenizer is None:
            return [text.encode()] if text else []
        byte_of = self.byte_of
        return [bytes(byte_of[ord(c)] for c in piece) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, chunk):
        """Pre-tokens (bytes) and special ids (int) of a chunk of text, in order."""
        text = chunk.decode("utf-8", "replace")
        if self.special_pattern is None:
            return self._pieces_of(text)
        result = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                result.append(self.special[part])
            elif part:
                result += self._pieces_of(part)
        return result

    @staticmethod
    def _apart_by_kind(chunks):
        """Chunks of letters, digits and ASCII signs; others without line feeds of simple characters; and all others."""
        body = b"\n".join([*chunks, b""])
        kind, data = np.frombuffer(body.translate(_KINDS), np.uint8), np.frombuffer(body, np.uint8)
        ends = np.flatnonzero(data == 10)
        if len(ends) != len(chunks):
            ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1) - 1
        which = np.zeros(len(chunks), np.uint8)
        places = np.flatnonzero(kind)
        kind, here, after = kind[places], data[places], np.append(data, np.uint8(0))[places + 1]
        # Signs between letters of two bytes, "<|", I with dot above, and U+0250 on.
        kind[(here == 0xC3) & (after != 0x97) & (after != 0xB7)] = 0
        kind[(here == 60) & (after == 124) | (here == 0xC4) & (after == 0xB0) | (here == 0xC9) & (after >= 0x90)] = 2
        kind[(here == 60) & (after != 124) | (here == 0xC4) & (after != 0xB0) | (here == 0xC9) & (after < 0x90)] = 0
        owner = np.searchsorted(ends, places)
        which[owner[kind == 1]] = 1
        which[owner[kind == 2]] = 2
        apart = [], [], []
        for c, w in zip(chunks, which.tolist()):
            apart[w].append(c)
        return apart

    @staticmethod
    def _split_plain(chunks):
        """Data, lengths of the pre-tokens and pre-tokens of each chunk for the first kind: what they are made of tells where to cut."""
        lines = b"\n".join([*chunks, b""]).decode().lower().encode()
        data, kind = np.frombuffer(lines, np.uint8), np.frombuffer(lines.translate(_CLASSES), np.uint8)
        cuts = np.ones(len(data) + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=cuts[1:-1])
        cuts[:-1] |= kind & 1 == 1
        cuts = np.flatnonzero(cuts)
        inside = kind[cuts[:-1]] != 3
        lengths = np.diff(cuts)[inside]
        lines_before = np.cumsum(~inside)[inside]
        return data[kind != 3], lengths, np.bincount(lines_before, minlength=len(chunks))

    def split(self, chunks):
        """The chunks in the order in which they are split: data, ends of the pre-tokens in it, pre-tokens of each chunk.

        Special strings stand as pre-tokens of one byte whose ids come in ``fixed`` (place among the pre-tokens -> id).
        """
        plain, simple, other = self._apart_by_kind(chunks) if self.simple else ([], [], chunks)
        try:
            plain_data, plain_lengths, plain_counts = self._split_plain(plain)
        except UnicodeDecodeError:
            plain, simple = [], plain + simple
            plain_data, plain_lengths, plain_counts = self._split_plain(plain)
        lines = b"\n".join(simple).decode("utf-8", "replace").lower()
        body = "\0".join(_SPLIT_LINES.findall(lines)).encode() + b"\0" if simple else b""
        data = np.frombuffer(body, np.uint8)
        stops = np.flatnonzero(data == 0)
        begins = np.concatenate(([0], stops[:-1] + 1)) if len(stops) else stops
        breaks = data[begins] == 10 if len(stops) else np.zeros(0, bool)
        filled = (stops > begins) & ~breaks
        chunk_of = np.cumsum(breaks)[filled]
        lengths = (stops - begins)[filled]
        data = data[(data != 0) & (data != 10)]
        counts = np.bincount(chunk_of, minlength=len(simple)) if simple else np.zeros(0, np.int64)
        data, lengths, counts = (np.concatenate(x) for x in ((plain_data, data), (plain_lengths, lengths), (plain_counts, counts)))
        fixed, more, sizes, extra = {}, [], [], []
        for chunk in other:
            pieces = self.pieces(chunk)
            for piece in pieces:
                if type(piece) is int:
                    fixed[len(lengths) + len(more)] = piece
                    piece = b"?"
                more.append(piece)
            extra.append(len(pieces))
        sizes = np.fromiter(map(len, more), np.int64, len(more))
        data = np.concatenate((data, np.frombuffer(b"".join(more), np.uint8)))
        return plain + simple + other, data, np.concatenate((lengths, sizes)), np.concatenate((counts, np.array(extra, np.int64))), fixed

    def merge(self, data, lengths, fixed=()):
        """Ids of all pre-tokens, one after another, and how many each has; ``fixed`` ones (place -> id) keep their id."""
        ends = np.cumsum(lengths)
        ids, counts, start = [], np.zeros(len(lengths), np.int64), 0
        while start < len(lengths):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + BATCH_SYMBOLS, side="right")))
            part, counts[start:end] = self._merge_batch(data[done: ends[end - 1]], lengths[start:end])
            ids.append(part)
            start = end
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        if fixed:
            first = np.cumsum(counts) - counts
            for place, special in fixed.items():
                ids[first[place]] = special
        return ids, counts

    def _merge_batch(self, data, lengths):
        symbols, letters = self.inner[data], data.astype(np.int32)
        ends = np.cumsum(lengths)
        last = ends[lengths > 0] - 1
        symbols[last] = self.final[data[last]]
        letters[last] += 256
        ranks = np.full(len(data), _NONE, np.int32)
        ranks[:-1] = self.begin[(letters[:-1] % 256 << 9) + letters[1:]]
        ranks[last] = _NONE
        owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        finished = []
        for i in np.flatnonzero(lengths > LONG):
            merged = self._merge_long(symbols[ends[i] - lengths[i]: ends[i]])
            finished.append((np.full(len(merged), i, np.int32), merged))
        short = lengths[owner] <= LONG
        symbols, owner, ranks = symbols[short], owner[short], ranks[short]
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(owner)])))
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            over = lowest == _NONE
            if over.any():
                finished.append((owner[over], symbols[over]))
                going = ~over
                symbols, owner, ranks, lowest = symbols[going], owner[going], ranks[going], lowest[going]
                if not len(symbols):
                    break
            places = self._apart(np.flatnonzero(ranks == lowest))
            symbols[places] = self.made[ranks[places]]
            stays = np.ones(len(symbols), bool)
            stays[places + 1] = False
            places = places - np.arange(len(places))
            symbols, owner, ranks = symbols[stays], owner[stays], ranks[stays]
            touched = np.zeros(len(symbols) + 1, bool)
            touched[places] = touched[places - 1] = True
            changed = np.flatnonzero(touched[:-1])
            ranks[changed] = self._ranks_at(symbols, owner, changed)
        owners, merged = (np.concatenate(x) for x in zip(*finished)) if finished else (owner, symbols)
        order = np.argsort(owners, kind="stable")
        return merged[order], np.bincount(owners, minlength=len(lengths))

    @staticmethod
    def _apart(places):
        """Of places in a row, every second one from the first on: a place that is merged takes the next symbol with it."""
        first = np.concatenate(([True], np.diff(places) != 1))
        begin = np.maximum.accumulate(np.where(first, places, 0))
        return places[(places - begin) % 2 == 0]

    def _ranks_at(self, symbols, owner, places):
        after = np.minimum(places + 1, len(symbols) - 1)
        ranks = self.pairs.ranks(symbols[places], symbols[after])
        ranks[(after == places) | (owner[places] != owner[after])] = _NONE
        return ranks

    def _merge_long(self, symbols):
        """The same for one long sequence: places are held by rank, and neighbours as links."""
        n = len(symbols)
        symbols = np.append(symbols, np.int32(-1))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        waiting, queue = {}, []

        def note(places):
            places = places[(places >= 0) & (after[places] < n)]
            ranks = self.pairs.ranks(symbols[places], symbols[after[places]])
            known = ranks != _NONE
            places, ranks = places[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part, rank in zip(np.split(places, cuts), ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else ()):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(queue, rank)
                waiting[rank].append(part)

        note(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[(symbols[places] == self.left[rank]) & (symbols[after[places]] == self.right[rank])]
            if not len(places):
                continue
            if self.left[rank] == self.right[rank]:
                row = np.concatenate(([True], after[places[:-1]] != places[1:]))
                begin = np.maximum.accumulate(np.where(row, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - begin) % 2 == 0]
            gone = after[places]
            symbols[places], symbols[gone] = self.made[rank], -1
            after[places] = after[gone]
            before[after[gone]] = places
            note(np.unique(np.concatenate((places, before[places]))))
        symbols = symbols[:n]
        return symbols[symbols >= 0]


class ChunkIds:
    """Ids of chunks of text, remembered in two generations: chunks that recur outlive those seen once.

    A value is the ids as little-endian bytes, or with ``counts_only`` their number.
    """

    def __init__(self, merger, counts_only=False, remembered=REMEMBERED):
        self.merger, self.counts_only, self.remembered = merger, counts_only, remembered
        self.recent, self.older = {}, {}

    def _chunks(self, bodies):
        """What the texts (UTF-8) are cut into, words where white space only separates, and the place of each text's first."""
        texts = pa.array(bodies, pa.large_binary())
        if not self.merger.by_words:
            return texts, np.arange(len(bodies) + 1)
        words = pc.ascii_split_whitespace(texts.view(pa.large_string()))
        return words.flatten().view(pa.large_binary()), words.offsets.to_numpy()

    def _values(self, chunks):
        """The values of all chunks, in order; each different one is looked up once."""
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.recent.get, distinct))
        missing = [c for c, v in zip(distinct, found) if v is None]
        if missing:
            new = dict(zip(missing, map(self.older.get, missing)))
            new.update(self._encode([c for c, v in new.items() if v is None]))
            late = iter(new.values())
            found = [next(late) if v is None else v for v in found]
            if len(self.recent) + len(new) > self.remembered:
                self.older, self.recent = self.recent, new
            else:
                self.recent.update(new)
        return pa.array(found, pa.int64() if self.counts_only else pa.large_binary()).take(coded.indices)

    def _encode(self, chunks):
        order, data, lengths, pieces, fixed = self.merger.split(chunks)
        ids, counts = self.merger.merge(data, lengths, fixed)
        ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(pieces)))]
        if self.counts_only:
            return zip(order, np.diff(ends).tolist())
        body, cuts = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return zip(order, (body[a:b] for a, b in zip(cuts, cuts[1:])))

    def counts_of(self, bodies):
        """The number of ids of each text."""
        chunks, first = self._chunks(bodies)
        return np.diff(np.concatenate(([0], np.cumsum(self._values(chunks).to_numpy())))[first])

    def ids_of(self, bodies):
        """The ids of each text as little-endian bytes."""
        chunks, first = self._chunks(bodies)
        values = self._values(chunks)
        _, places, data = values.buffers()
        ends = np.frombuffer(places, np.int64)[values.offset:][first].tolist() if len(values) else [0] * len(first)
        data = memoryview(data or b"")
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
