"""Best-fit packing of tokenised documents into sequences, hierarchical by residuals.

Each partition packs its pieces best-fit, longest first, ``MAX_ITEMS`` at a time, and emits
the bins that are nearly full. Underfull bins are the items of the next round, where
``FAN_IN`` times fewer tasks pack them again, until one task holds the rest. A bin carries
its pieces along, at most one for each token of its size; a task packs at most about
``MAX_ITEMS`` bins, so more items mean more tasks, not larger ones. Bins that not even the
least full one would fit into are done as they are; when no two fit, or a round of many
tasks joined none, all are.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import text_of, written

SIZE = 2048
END_ID = 0
#: A bin with at most this many free tokens is emitted.
NEARLY_FULL = 8
FAN_IN = 8
MAX_ITEMS = 16_384
#: Runs whose ids one generation of a worker's cache keeps, about 200 bytes each; it has two. Runs of ``LONG_RUN`` characters or more are not kept.
CACHE_RUNS = 400_000
LONG_RUN = 64
#: Marks that the tokenizer parts, as one piece, from the letters before them; no apostrophe, which may go with letters.
_MARKS = string.punctuation.replace("'", "")
#: Letters that the tokenizer's normaliser leaves as they are but for their case; İ gets a mark of its own.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ž]+")

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = pa.schema([("used", pa.int32()), ("full", pa.bool_()), ("bin", pa.int64()), ("pieces", pa.list_(_PIECE))])
_BINS_DDL = "used int, full boolean, bin long, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"

#: Lower case changes such texts as the tokenizer's own normaliser does.
_PLAIN = re.compile(r"[\t\n\v\f\r\x20-~¡-žŒœ‐-‧€]*")
#: A special token's text, or characters that split() takes for white space and the tokenizer does not.
_WHOLE = re.compile(r"<\||[\x1c-\x1f]")


class WordEncoder(dict):
    """Ids of texts as the tokenizers library gives them, little-endian uint32; keeps those of runs without white space.

    A full generation becomes the older one, and the one before it goes; runs met again move into the new one.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: By id: the token ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, run: str) -> bytes:
        ids = self.whole(run)
        if len(run) < LONG_RUN:
            self[run] = ids
        return ids

    def learn(self, runs: set[str]) -> None:
        """Keeps the ids of new runs: a word of letters once, whatever marks follow it; all such words in one call."""
        if len(self) > CACHE_RUNS:
            self.older = dict(self)
            self.clear()
        marked, words, older = [], [], self.older
        for run in runs:
            if run in older:
                self[run] = older[run]
                continue
            word = run.rstrip(_MARKS)
            if len(run) < LONG_RUN and _LETTERS.fullmatch(word):
                if word in older:
                    self[word] = older[word]
                elif word not in self:
                    words.append(word)
                if len(word) < len(run):
                    marked.append((run, word))
        words = list(dict.fromkeys(words))
        ids = np.frombuffer(self.whole(" ".join(words)), np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words):  # else they are encoded one by one when asked for
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.update((w, data[i:j]) for w, i, j in zip(words, at, at[1:]))
        for run, word in marked:
            self[run] = self[word] + self[run[len(word) :]]

    def encode(self, text: str) -> bytes:
        """No token reaches over white space, so runs between it are encoded one by one."""
        if _WHOLE.search(text):
            return self.whole(text)
        plain = _PLAIN.fullmatch(text) and "İ" not in text
        runs = (text.lower() if plain else text).split()
        found = [*map(self.get, runs)]
        if None in found:
            self.learn({r for r, ids in zip(runs, found) if ids is None})
            at = -1
            try:
                while True:
                    at = found.index(None, at + 1)
                    found[at] = self[runs[at]]
            except ValueError:  # none is left
                pass
        return b"".join(found)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """This worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def best_fit(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the fullest bin that still takes it."""
    open_by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with room r is open
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        if room > n:
            open_by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
    return bins


_NAMES = ("doc_id", "piece", "start", "length", "ids_crc32")


class _Packer:
    """Packs (length, pieces as tuples) items of one task, so many at a time, and gives the bins."""

    def __init__(self, level: int, size: int, most: int):
        from pyspark import TaskContext

        self.size, self.most, self.items = size, most, []
        self.next_bin = (level << 56) | (TaskContext.get().partitionId() << 32)

    def add(self, length: int, pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        self.items.append((length, pieces))
        if len(self.items) >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows, items = [], self.items
        self.items = []
        for members in best_fit([n for n, _ in items], self.size):
            used = sum(items[i][0] for i in members)
            pieces = [dict(zip(_NAMES, p)) for i in members for p in items[i][1]]
            rows.append({"used": used, "full": self.size - used <= NEARLY_FULL, "bin": self.next_bin, "pieces": pieces})
            self.next_bin += 1
            if len(rows) == 1024:
                yield pa.RecordBatch.from_pylist(rows, schema=_BINS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_BINS)


def _local(docs: DataFrame, path: str, size: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(path), _Packer(0, size, most)
        end = array("I", [END_ID]).tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = memoryview(encoder.encode(text.as_py()) + end)
                doc = doc_id.as_py()
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    yield from packer.add(len(part) // 4, [(doc, k, at // 4, len(part) // 4, zlib.crc32(part))])
        yield from packer.flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("body")).mapInArrow(run, _BINS_DDL)


def _again(rest: DataFrame, level: int, size: int, most: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(level, size, most)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    yield from packer.add(r["used"], [tuple(p[c] for c in _NAMES) for p in r["pieces"]])
        yield from packer.flush()

    return rest.mapInArrow(run, _BINS_DDL)


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are the tokenizer's without special tokens, then ``END_ID``; a null
    text is empty and gives that one id. Only documents over ``size`` ids are cut, into
    pieces of ``size`` and a rest. Sequences hold at most ``size`` ids, their pieces follow
    each other without a gap from offset 0. Equal lengths keep their order of arrival.
    Repeated rows are packed each; a null id stays null. An empty table gives no rows;
    further columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    done, level, before, tasks = [], 0, None, max(FAN_IN, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bins = written(_local(docs, tokenizer, size, MAX_ITEMS), "bins")
    while True:
        # How many underfull bins there are of each size: at most ``size`` numbers.
        sizes = dict(bins.filter("NOT full").groupBy("used").agg(F.count(F.lit(1))).collect())
        least = min(sizes, default=0)
        fits = size - (least if sizes.get(least, 0) > 1 else min((u for u in sizes if u > least), default=size))
        joinable = {u: n for u, n in sizes.items() if u <= size - least} if least <= fits else {}
        n = sum(joinable.values())
        if level and (tasks == 1 or n == before):  # one task has seen all, or a round joined none
            joinable = {}
        if not joinable:
            done.append(bins)
            break
        rest = (~F.col("full")) & (F.col("used") <= size - least)
        done.append(bins.filter(~rest))
        level, before = level + 1, n
        tasks = max(-(-n // MAX_ITEMS), -(-tasks // FAN_IN))
        dealt = bins.filter(rest).repartition(tasks, F.xxhash64("bin", F.lit(level)))
        bins = written(_again(dealt, level, size, MAX_ITEMS if tasks > 1 else n + 1), "bins")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    # Offsets are the running sum of lengths inside the bin, which holds at most ``size`` pieces.
    sums = F.aggregate(
        F.transform("pieces", lambda p: p["length"]),
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<long>)").alias("offsets")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["offsets"], F.array(s["at"])).alias("offsets")),
        lambda s: s["offsets"],
    )
    rows = every.select("bin", F.explode(F.arrays_zip("pieces", sums.alias("offsets"))).alias("x"))
    return rows.select(*[F.col(f"x.pieces.{c}").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], F.col("bin").alias("sequence_id"), F.col("x.offsets").alias("offset"))
