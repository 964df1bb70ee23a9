"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

The leaves of the tree are the ranks of adjacent pairs; the root yields the leftmost pair
of the lowest rank. A merge rewrites three leaves and their paths to the root, so a run of
n bytes takes O(n log n), whatever its content. A node has ``FAN_OUT`` children: a run of
up to ``FAN_OUT`` bytes, which most words are, is a tree of one node, and the new runs of
many texts are merged side by side as the rows of one array of such trees.

Texts are cut at white space first, and a cut's ids and what they decode to are kept, so a
text costs one look-up for each of its words and two joins.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import SLICE_ROWS, text_of

#: Fixed value: the pattern that byte-level vocabularies split text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Strings whose ids one generation of the cache holds, some 250 bytes each; the cache has two. Longer ones are not kept.
CACHE_RUNS, KEPT_CHARS = 500_000, 64
#: Cuts of a text that are looked up at a time.
WINDOW = 1 << 18
#: Children of a node of the tree.
FAN_OUT = 16
#: ASCII marks that ``PATTERN`` parts, as one run, from letters before them; no apostrophe, which may go with letters after it.
_MARKS = string.punctuation.replace("'", "")
#: Up to this character, letters are the same in every version of Unicode in use.
_LAST_PLAIN = "\u024f"
#: Bits of a place in a run, and of an id.
_SHIFT = 32
_PLACE = (1 << _SHIFT) - 1
#: Above every rank with a place.
_NONE = 1 << 61


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def white_space_cuts() -> re.Pattern:
    """Cuts a text where no run of ``PATTERN`` reaches over: words with a space before, and white space.

    ``PATTERN`` looks behind nothing and passes from white space to other characters only
    by one leading space, so a cut's runs depend on the cut alone.
    """
    space = "".join(re.escape(chr(n)) for n in range(0x3001) if regex.fullmatch(r"\s", chr(n)))
    return re.compile(rf" ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]+")


class Codec:
    """Encodes and decodes texts; keeps (ids joined by commas, decoded text) of runs and cuts.

    A full generation of the cache becomes the older one, and the one before it goes;
    strings met again move into the new one, so frequent ones stay.
    """

    def __init__(self, path: str):
        self.cache: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.of_byte = [vocab[s] for s in symbols]
        #: The rank of a pair of ids, shifted to leave room for a place, and the id that each rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << _SHIFT | vocab[b]] = rank << _SHIFT
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        # The same as arrays, pairs in rising order; a last pair stands for all that have no rank.
        pairs = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(self.ranks.values(), np.int64, len(self.ranks))[order], _NONE)
        self.ids_made, self.byte_ids = np.array([*self.made, 0], np.int64), np.array(self.of_byte, np.int64)
        each = np.repeat(self.byte_ids[:, None], 256, 1)
        self.byte_ranks = np.full((257, 257), _NONE, np.int64)
        self.byte_ranks[:256, :256] = self._ranked(each, each.T)
        self.split, self.cuts = regex.compile(PATTERN).findall, white_space_cuts()
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]

    def merge(self, data: bytes) -> list[int]:
        """Ids of one run: merges the leftmost pair of the lowest rank until no pair can be merged.

        A leaf is its pair's rank above its place, so the root's value tells where to merge.
        """
        ids = [self.of_byte[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank = self.ranks.get
        leaves = [rank(ids[i] << _SHIFT | ids[i + 1], _NONE) + i for i in range(n - 1)]
        leaves.append(_NONE)
        levels = [leaves]
        while len(levels[-1]) > FAN_OUT:
            low = levels[-1]
            levels.append([min(low[k : k + FAN_OUT]) for k in range(0, len(low), FAN_OUT)])
        below_root, inner = levels[-1], list(zip(levels, levels[1:]))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := min(below_root)) < _NONE:
            i = root & _PLACE
            j, p = after[i], before[i]
            ids[i] = made = self.made[root >> _SHIFT]
            ids[j] = -1
            leaves[j] = _NONE
            after[i] = last = after[j]
            if last < n:
                before[last] = i
                leaves[i] = rank(made << _SHIFT | ids[last], _NONE) + i
            else:
                leaves[i] = _NONE
            if p >= 0:
                leaves[p] = rank(ids[p] << _SHIFT | made, _NONE) + p
            if inner:
                for k in (i, j, p) if p >= 0 else (i, j):
                    for low, high in inner:
                        k //= FAN_OUT
                        high[k] = min(low[k * FAN_OUT : k * FAN_OUT + FAN_OUT])
        return [x for x in ids if x >= 0]

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Shifted ranks of pairs of ids; -1 on either side makes a pair without rank."""
        pair = np.where((left < 0) | (right < 0), -1, left << _SHIFT | right)
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], _NONE)

    def merge_rows(self, runs: list[bytes]) -> tuple[list[int], np.ndarray]:
        """``merge`` of runs of at most ``FAN_OUT`` bytes, a row of leaves under one root for each: all ids, and how many each run has.

        Two columns beyond the leaves stand for what lies after the last and before the first byte.
        """
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        place, last_row = np.arange(FAN_OUT + 2)[:, None], FAN_OUT + 1
        ids = np.full((len(runs), FAN_OUT + 2), 256, np.int64)  # bytes, and 256 for none
        ids[place.T < sizes[:, None]] = np.frombuffer(b"".join(runs), np.uint8)
        # A column for each run, so that the least of all leaves is taken row by row.
        ids = np.ascontiguousarray(ids.T)
        after = np.where(place + 1 < sizes, place + 1, FAN_OUT)
        before = np.where(place > 0, place - 1, last_row) + np.zeros_like(ids)
        leaves = np.full(ids.shape, _NONE, np.int64)
        leaves[:-1] = self.byte_ranks[ids[:-1], ids[1:]] + place[:-1]
        ids = np.where(ids < 256, self.byte_ids[ids % 256], -1)
        at = np.arange(len(runs))
        while len(at):
            root = leaves.min(0)[at] if 2 * len(at) > len(runs) else leaves[:, at].min(0)
            at, root = at[root < _NONE], root[root < _NONE]
            i, made = root & _PLACE, self.ids_made[root >> _SHIFT]
            j, p = after[i, at], before[i, at]
            last = after[j, at]
            ids[i, at], ids[j, at], leaves[j, at] = made, -1, _NONE
            after[i, at], before[last, at] = last, i
            leaves[i, at] = self._ranked(made, ids[last, at]) + i
            leaves[p, at] = self._ranked(ids[p, at], made) + p
        ids = ids.T
        return ids[ids >= 0].tolist(), (ids >= 0).sum(1)

    def _runs(self, cut: str) -> list[str]:
        """The runs of a cut; most cuts are a word of letters and marks after it, which needs no pattern."""
        word = cut.rstrip(_MARKS)
        letters = word[1:] if word[:1] == " " else word
        if letters.isalpha() and (letters.isascii() or max(letters) <= _LAST_PLAIN):
            return [cut] if len(word) == len(cut) else [word, cut[len(word) :]]
        return self.split(cut)

    def _encode_rows(self, runs: list[str]) -> None:
        """Puts short runs into the cache; they are merged, written and decoded together."""
        data = [r.encode("utf-8") for r in runs]
        ids, counts = self.merge_rows(data)
        named, tokens = [*map(self.digits.__getitem__, ids)], [*map(self.bytes_of.__getitem__, ids)]
        ends = np.cumsum(counts)
        decoded = np.add.reduceat(np.fromiter(map(len, tokens), np.int64, len(tokens)), ends - counts) if runs else np.empty(0)
        # If all bytes decoded are all bytes encoded, and as many for each run, then each run decodes to itself.
        same = b"".join(tokens) == b"".join(data) and np.array_equal(decoded, np.fromiter(map(len, data), np.int64, len(data)))
        ends = ends.tolist()
        for run, a, b in zip(runs, [0, *ends], ends):
            self.cache[run] = ",".join(named[a:b]), run if same else b"".join(tokens[a:b]).decode("utf-8", "replace")

    def _learn(self, strings: set[str]) -> None:
        """Puts ids and decoded text of ``strings``, and of the runs they consist of, into the cache."""
        cache, older = self.cache, self.older
        split, runs = {}, set()
        for s in strings:
            if s in older:
                cache[s] = older[s]
            else:
                parts = self._runs(s)
                runs.update(parts)
                if len(parts) > 1:
                    split[s] = parts
        short = []
        for run in runs:
            if run in cache:
                continue
            if run in older:
                cache[run] = older[run]
            elif len(run) <= FAN_OUT and len(run.encode("utf-8")) <= FAN_OUT:
                short.append(run)
            else:
                ids = self.merge(run.encode("utf-8"))
                cache[run] = ",".join([self.digits[x] for x in ids]), self.decode(ids)
        self._encode_rows(short)
        for s, parts in split.items():
            known = [cache[r] for r in parts]
            cache[s] = ",".join([x for x, _ in known]), "".join([d for _, d in known])

    def _found(self, cuts: list[list[str]]) -> list[list[tuple[str, str]]]:
        """(ids joined, decoded) of every cut."""
        if len(self.cache) > CACHE_RUNS:
            self.older, self.cache = self.cache, {}
        out = [[*map(self.cache.get, some)] for some in cuts]
        new, holes = set(), []
        for some, known in zip(cuts, out):
            at = -1
            try:
                while True:
                    at = known.index(None, at + 1)
                    new.add(some[at])
                    holes.append((known, at, some[at]))
            except ValueError:  # no hole is left
                pass
        self._learn(new)
        for known, at, s in holes:
            known[at] = self.cache[s]
        for s in [s for s in new if len(s) >= KEPT_CHARS]:
            for r in (s, *self._runs(s)):
                if len(r) >= KEPT_CHARS:
                    self.cache.pop(r, None)
        return out

    def _cut(self, text: str) -> Iterator[list[str]]:
        """Special tokens and white-space cuts of a text, at most ``WINDOW`` at a time."""
        for k, part in enumerate(self.cut_special(text)):
            if k % 2:
                yield [part]
            elif len(part) <= WINDOW:
                if part:
                    yield self.cuts.findall(part)
            else:
                matches = self.cuts.finditer(part)
                while some := [m[0] for m in islice(matches, WINDOW)]:
                    yield some

    def parts(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of the text, ids joined by commas, decoded text) of successive parts of the texts, none for an empty text."""
        pending: list[tuple[int, list[str]]] = []

        def flush() -> Iterator[tuple[int, str, str]]:
            plain = [(n, cuts) for n, cuts in pending if not (len(cuts) == 1 and cuts[0] in self.special)]
            found = iter(self._found([cuts for _, cuts in plain]))
            for n, cuts in pending:
                if len(cuts) == 1 and cuts[0] in self.special:
                    yield n, self.digits[self.special[cuts[0]]], self.decode([self.special[cuts[0]]])
                else:
                    known = next(found)
                    yield n, ",".join([x for x, _ in known]), "".join([d for _, d in known])

        size = 0
        for n, text in enumerate(texts):
            for cuts in self._cut(text):
                pending.append((n, cuts))
                size += len(cuts)
                if size >= WINDOW:
                    yield from flush()
                    pending, size = [], 0
        yield from flush()

    def encode(self, text: str) -> list[int]:
        return [int(x) for _, ids, _ in self.parts([text]) for x in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec, kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _map_texts(docs: DataFrame, function, schema: pa.Schema, ddl: str) -> DataFrame:
    """``function`` over the texts of some rows gives the columns after doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = function(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t.type) for c, t in zip(found, list(schema)[1:])]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("body")).mapInArrow(run, ddl)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row; a null text is empty and has no ids.

    Repeated rows each give a row; an empty table gives none; further columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def columns(texts: list[str]) -> tuple[list, ...]:
        ids, decoded = [[] for _ in texts], [[] for _ in texts]
        for n, joined, text in codec(path).parts(texts):
            ids[n] += map(int, joined.split(","))
            decoded[n].append(text)
        return ids, ["".join(d) for d in decoded]

    return _map_texts(docs, columns, schema, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The same encoding as ``encode_documents``, digested where it is made so that ids and
    texts need not leave the worker. A null text is empty and has no tokens. Repeated rows
    each give a row; an empty table gives none; further columns of ``docs`` are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def columns(texts: list[str]) -> tuple[list, ...]:
        n_tokens, ids, decoded = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for n, joined, text in codec(path).parts(texts):
            ids[n].update(("," + joined if n_tokens[n] else joined).encode())
            decoded[n].update(text.encode())
            n_tokens[n] += joined.count(",") + 1
        return n_tokens, [h.hexdigest() for h in ids], [h.hexdigest() for h in decoded]

    return _map_texts(docs, columns, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
