"""Encoders of the public tokenizer files, with bounded memos per worker."""

from __future__ import annotations

import array
import json
import os
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import safe_chunks, worker_memo


#: Characters beside which a space is no safe cut (see safe_chunks): white space and U+2581.
_EDGES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) | {"\u2581"}
#: The same for Arrow's regular expressions, on whole texts.
_UNSAFE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}\x{2581}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}\x{2581}]|^ | $"


class ChunkMemo:
    """Values of chunks, which many() computes for those not at hand.

    A chunk met for the first time waits among the new ones; met again in a later batch it moves to
    the frequent ones. Either kind is two generations of a fixed number of entries: a full young one
    becomes the old one, and what is met again moves back to the young one. So memory is bounded,
    frequent chunks stay, and rare ones don't drive them out. Chunks of over longest characters are
    not remembered.
    """

    def __init__(self, many: Callable[[list[str]], Iterable], frequent: int = 120_000, new: int = 100_000, longest: int = 48):
        self.many, self.frequent, self.new, self.longest = many, frequent, new, longest
        self.young, self.old, self.fresh, self.stale = {}, {}, {}, {}

    def values(self, chunks: list[str]) -> list:
        """The value of each of some distinct chunks."""
        found = list(map(self.young.get, chunks))
        open_ = [k for k, v in enumerate(found) if v is None]
        for place in (self.old, self.fresh, self.stale):
            if place and open_:
                left = []
                for k in open_:
                    c = chunks[k]
                    value = place.get(c)
                    if value is None:
                        left.append(k)
                    else:
                        found[k] = self.young[c] = value
                open_ = left
        for k, value in zip(open_, self.many([chunks[k] for k in open_])):
            found[k] = value
            if len(chunks[k]) <= self.longest:
                self.fresh[chunks[k]] = value
        if len(self.fresh) > self.new:
            self.stale, self.fresh = self.fresh, {}
        if len(self.young) > self.frequent:
            self.old, self.young = self.young, {}
        return found


def unspaced(strings: pa.Array) -> list[str]:
    """A list of an array of strings without spaces, by one join and one split (to_pylist() makes a scalar of each)."""
    if not len(strings):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")


class HashMemo:
    """Values of distinct strings without spaces, held in Arrow, which many() computes for those not at hand.

    Entries are found by binary search over the sorted 64-bit hashes of their strings, and the strings
    themselves are compared; nothing is hashed anew for a later batch. When over entries strings are
    known as a batch begins, those met again since the last such time stay, and the newer half of the
    others. Strings of over longest characters are not remembered.
    """

    def __init__(self, many: Callable[[list[str]], pa.Array], entries: int = 500_000, longest: int = 48):
        self.many, self.entries, self.longest = many, entries, longest
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.again = np.zeros(0, bool)
        self._index(np.zeros(0, np.uint64))

    def _index(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        order = np.argsort(hashes, kind="stable")
        self.keys, self.slots = hashes[order], order.astype(np.int32)

    def lookup(self, strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Values, and for each string the place of its own among them."""
        import xxhash

        if len(self.known) > self.entries:  # now, when no caller holds the values any more
            self._thin()
        raw = unspaced(strings)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        place = np.full(len(raw), -1, np.int64)
        if len(self.keys):
            near = np.searchsorted(self.keys, hashes).clip(max=len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[near] == hashes)
            at = self.slots[near[hit]]
            same = pc.equal(self.known.take(pa.array(at)), strings.take(pa.array(hit))).to_numpy(zero_copy_only=False)
            place[hit[same]] = at[same]
            self.again[at[same]] = True
        lost = np.flatnonzero(place < 0)
        if not len(lost):
            return self.ids, place
        missing = strings.take(pa.array(lost))
        made = self.many([raw[k] for k in lost.tolist()])
        place[lost] = len(self.known) + np.arange(len(lost))
        values = pa.concat_arrays([self.ids, made])
        short = np.fromiter((len(raw[k]) <= self.longest for k in lost.tolist()), bool, len(lost))
        if short.all():
            self.ids = values
        else:
            missing, made, lost = missing.filter(pa.array(short)), made.filter(pa.array(short)), lost[short]
            self.ids = pa.concat_arrays([self.ids, made])
        self.known = pa.concat_arrays([self.known, missing])
        self.again = np.concatenate([self.again, np.zeros(len(lost), bool)])
        new = hashes[lost]
        order = np.argsort(new, kind="stable")
        at = np.searchsorted(self.keys, new[order])
        self.slots = np.insert(self.slots, at, (len(self.hashes) + order).astype(np.int32))
        self.keys = np.insert(self.keys, at, new[order])
        self.hashes = np.concatenate([self.hashes, new])
        return values, place

    def _thin(self) -> None:
        """Leaves what was met again and the newer half of the rest; array after array, so that little is there twice."""
        kept = self.again
        rest = np.flatnonzero(~kept)
        kept[rest[len(rest) // 2 :]] = True
        if kept.sum() > self.entries * 3 // 4:
            kept[: len(kept) // 2] = False
        take = pa.array(np.flatnonzero(kept))
        self.known = self.known.take(take)
        self.ids = self.ids.take(take)
        self.again = np.zeros(len(take), bool)
        self._index(self.hashes[kept])


def binaries(values: Iterable[bytes]) -> pa.Array:
    return pa.array(values if isinstance(values, list) else list(values), pa.large_binary())


class JsonEncoder:
    """ids of texts by a .json file of the tokenizers library, little-endian, width bytes each.

    No special tokens are added; special strings inside texts are as the library's default has them.
    A byte-level file encodes chunks, cut where no token can span, and remembers them; another file
    whole texts. Chunks not at hand are encoded by the library many to a line: each begins with a
    space and has no other, so the tokens that begin with a space tell where each one's ids begin.
    """

    LINE, LINES = 512, 16

    def __init__(self, path: str):
        # Spark's tasks are the threads; the library's own would each keep memory, and take more CPU together.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        model = tokenizers.Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.width, self.code = (2, "H") if model.get_vocab_size() <= 1 << 16 else (4, "I")
        self.model = model
        with open(path) as f:
            kind = json.load(f)
        own = kind.get("pre_tokenizer") or {}
        special = [t.content for t in model.get_added_tokens_decoder().values()]
        self.cut = (
            own.get("type") == "ByteLevel"
            and own.get("use_regex", True)
            and not own.get("add_prefix_space")
            and not kind.get("normalizer")
            and not any(c.isspace() for s in special for c in s)
        )
        vocabulary = model.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[k for t, k in vocabulary.items() if t.startswith("Ġ")]] = True
        self.later = HashMemo(lambda chunks: binaries(self._chunks(chunks)))

    def _bytes(self, ids: list[int]) -> bytes:
        return array.array(self.code, ids).tobytes()

    def _each(self, texts: list[str]) -> Iterable[bytes]:
        for at in range(0, len(texts), 1024):
            for e in self.model.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False):
                yield self._bytes(e.ids)

    def _chunks(self, chunks: list[str]) -> Iterable[bytes]:
        """ids of chunks, each with the space before it that it is given without."""
        if not chunks:
            return []
        odd = {k for k, c in enumerate(chunks) if " " in c or c[0] in _EDGES or c[-1] in _EDGES}
        alone = self._each([" " + chunks[k] for k in sorted(odd)])
        plain = self._joined([c for k, c in enumerate(chunks) if k not in odd] if odd else chunks)
        return (next(alone if k in odd else plain) for k in range(len(chunks))) if odd else plain

    def _joined(self, chunks: list[str]) -> Iterable[bytes]:
        for at in range(0, len(chunks), self.LINE * self.LINES):
            some = chunks[at : at + self.LINE * self.LINES]
            lines = [some[k : k + self.LINE] for k in range(0, len(some), self.LINE)]
            for line, e in zip(lines, self.model.encode_batch_fast([" " + " ".join(x) for x in lines], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                starts = np.flatnonzero(self.spaced[ids])
                if len(starts) != len(line):
                    yield from self._each([" " + c for c in line])
                    continue
                raw = ids.astype(f"<u{self.width}").tobytes()
                edges = (starts * self.width).tolist() + [len(raw)]
                for a, b in zip(edges, edges[1:]):
                    yield raw[a:b]

    def encode(self, column: pa.Array) -> tuple[memoryview, np.ndarray]:
        """All ids of a column of texts as bytes, and where each text's begin (and the last's end).

        A null or empty text has none. Where all spaces are safe cuts, Arrow splits the texts, finds
        the distinct chunks of the batch and puts their ids in a row; other texts are cut one by one.
        """
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, _UNSAFE) if self.cut else pa.array(np.ones(len(texts), bool))
        parts = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        edges = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        odd = whole.to_numpy(zero_copy_only=False)
        first = index[edges[:-1]]
        # A text's first chunk has no space before it; a text that can't be cut at every space comes as its first chunk.
        heads = list(self._each(coded.dictionary.take(pa.array(first)).to_pylist()))
        for k, ids in zip(np.flatnonzero(odd).tolist(), self._whole(texts.filter(whole).to_pylist())):
            heads[k] = ids
        inner = np.ones(len(index), bool)
        inner[edges[:-1]] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[index[inner]] = True
        values, place = self.later.lookup(coded.dictionary.filter(pa.array(used)))
        target = np.zeros(len(used), np.int64)
        target[used] = place
        index = target[index]
        index[edges[:-1]] = len(values) + np.arange(len(heads))
        row = pa.concat_arrays([values, binaries(heads)]).take(pa.array(index))
        ends = np.frombuffer(row.buffers()[1], np.int64, len(row) + 1)
        return memoryview(row.buffers()[2] or b""), ends[edges]

    def _whole(self, texts: list[str]) -> Iterable[bytes]:
        """ids of texts with spaces that are no safe cuts."""
        if not self.cut:
            yield from self._each(texts)
            return
        for text in texts:
            first, *rest = safe_chunks(text)
            yield b"".join([*self._each([first]), *self._chunks([c[1:] for c in rest])])


def json_encoder(path: str) -> JsonEncoder:
    return worker_memo(("json", path), lambda: JsonEncoder(path))
