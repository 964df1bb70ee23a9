"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within 3 bits.

Pigeonhole blocks: a fingerprint is cut into 6 blocks, so two that differ in at most 3
bits agree on some 3 whole blocks, 32 bits; each of the 20 choices of 3 is one block key.
Equal fingerprints meet first and go on as one. A block with more than ``hot_block``
different fingerprints is cut again by the same argument (4 parts of the bits that are
left), so no task holds an unbounded block and no link is lost. Inside a block a search
from fingerprint to fingerprint verifies the distance and emits the links of a spanning
tree, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlake.llm.common import text_of, unused, written
from flightlake.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: A block with more different fingerprints than this is cut again.
HOT_BLOCK = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Of a UTF-8 text: the bits set in over half the XXH64 (seed 42) of its shingles; no words: 0."""
    found = text.lower().split()  # bytes: A-Z only, and the separators are space and \t\n\v\f\r
    if not found:
        return 0
    joined = b" ".join(found)
    starts = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1, out=starts[1:])
    n = max(1, len(found) - words + 1)
    ends = (starts[words : words + n] - 1 if len(found) >= words else starts[-1:] - 1).tolist()
    digest, begin = xxhash.xxh64_intdigest, starts[:n].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + CHUNK], ends[at : at + CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash) of every row; fp holds the 64 bits as a signed long. A null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("text_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"), F.xxhash64(text_of()).alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(bits: list[int], n: int) -> list[int]:
    """``bits`` as ``n`` masks of nearly equal size."""
    return [sum(1 << b for b in bits[i * len(bits) // n : (i + 1) * len(bits) // n]) for i in range(n)]


def first_masks() -> list[int]:
    blocks = _cut(list(range(64)), 2 * MAX_BITS)
    return [sum(some) for some in combinations(blocks, MAX_BITS)]


def finer_masks(mask: int) -> list[int]:
    """Two fingerprints that agree on ``mask`` and differ in at most 3 bits agree on one of these."""
    left = [b for b in range(64) if not mask >> b & 1]
    return [mask | part for part in _cut(left, MAX_BITS + 1)]


def _tree(fp: np.ndarray, node: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning tree of every set of fingerprints joined by links, each to its least node."""
    out, rest = [], np.arange(len(fp))
    while len(rest):
        frontier, rest, members = [rest[0]], rest[1:], [rest[0]]
        while frontier and len(rest):
            near = np.bitwise_count(fp[rest] ^ fp[frontier.pop()]) <= MAX_BITS
            if near.any():
                frontier += (new := rest[near].tolist())
                members += new
                rest = rest[~near]
        if len(members) > 1:
            least = int(node[members].min())
            out += [(int(x), least) for x in node[members] if x != least]
    return out


def _links_of_runs(mask: np.ndarray, fp: np.ndarray, node: np.ndarray) -> set[tuple[int, int]]:
    """Links inside the runs of one block key; the arrays are sorted by (mask, key)."""
    key = fp & mask
    new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
    starts, ends = np.r_[0, new], np.r_[new, len(fp)]
    size = ends - starts
    out: set[tuple[int, int]] = set()
    first = starts[size == 2]  # most runs
    near = first[np.bitwise_count(fp[first] ^ fp[first + 1]) <= MAX_BITS]
    a, b = node[near], node[near + 1]
    out.update(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist()))
    for i in np.flatnonzero(size > 2):
        out.update(_tree(fp[starts[i] : ends[i]], node[starts[i] : ends[i]]))
    return {(x, y) for x, y in out if x != y}


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition, sorted by block key; a run that goes on into the next batch is kept for it."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
    kept: list[np.ndarray] | None = None
    seen: set[tuple[int, int]] = set()

    def out(arrays: list[np.ndarray]) -> list[pa.RecordBatch]:
        links = _links_of_runs(*arrays) - seen if len(arrays[0]) else set()
        seen.update(links)
        if len(seen) > 1_000_000:  # only saves repeats; the reader takes each link once
            seen.clear()
        return [pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], schema=schema)] if links else []

    for batch in batches:
        arrays = [batch.column("mask").to_numpy().view(np.uint64), batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy()]
        if kept is not None:
            arrays = [np.concatenate(x) for x in zip(kept, arrays)]
        mask, key = arrays[0], arrays[0] & arrays[1]
        last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
        at = int(last[-1]) + 1 if len(last) else 0
        yield from out([x[:at] for x in arrays])
        kept = [x[at:] for x in arrays]
    if kept is not None:
        yield from out(kept)


def links(unique: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(src, dst) with src > dst that join all fingerprints within 3 bits; ``unique`` is (fp, node)."""
    masks = first_masks()
    blocks = unique.select("fp", "node", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    found = None
    while True:
        blocks = written(blocks.withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))), "blocks")
        # A block that leaves r bits open has at most 2^r different fingerprints: small enough blocks are never cut.
        cut = [_signed(m) for m in masks if 1 << (64 - m.bit_count()) > hot_block]
        many = blocks.filter(F.col("mask").isin(cut)).groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_block)
        hot = written(many.select("mask", "key"), "hot")
        # Only the masks come here, at most as many as there are choices of bits.
        finer = {m: finer_masks(m) for m in (r["mask"] % (1 << 64) for r in hot.select("mask").distinct().collect())}
        last = not finer
        cold = blocks if last else blocks.join(hot, ["mask", "key"], "left_anti")
        sets = cold.select("mask", "key", "fp", "node").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        part = sets.mapInArrow(_links, "src long, dst long")
        found = part if found is None else found.unionByName(part)
        if last:
            return found
        # At most as many rows as there are choices of bits, so they may be broadcast.
        parts = F.broadcast(unique.sparkSession.createDataFrame([(_signed(m), _signed(y)) for m, f in finer.items() for y in f], "mask long, finer long"))
        blocks = blocks.join(hot, ["mask", "key"], "left_semi").join(parts, "mask").select("fp", "node", F.col("finer").alias("mask"))
        masks = sorted({y for f in finer.values() for y in f})


def _classes(found: DataFrame, hot_block: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``found``: root is the component's least fingerprint, as a signed long."""
    unique = written(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "unique")
    part = written(components(links(unique.select("fp", F.col("fp").alias("node")), hot_block)), "components")
    rooted = written(unique.join(part, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"), "least_id"), "roots")
    # Both sides are tables, so the rows of a large component can be split at runtime.
    least = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least_ids")
    return written(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_components(docs: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    A-Z are lower-cased, words are runs without space and ``\\t\\n\\v\\f\\r``, shingles are 3
    words (fewer words: all of them), repeats count. Texts without words, null ones too,
    have fingerprint zero and link like any other, and so do rows without an id.
    ``component_id`` is the least doc_id reached by links of at most 3 bits, the document's
    own included; null only if no row of the component has an id. Repeated rows each give a
    row. An empty table gives no rows; further columns of ``docs`` are ignored.
    """
    found = written(fingerprints(docs), "fingerprints")
    return found.join(_classes(found, hot_block), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every near-duplicate component, columns unchanged: that with the least (doc_id, fingerprint, text hash), null ids last.

    Rows that share an id but not a component are judged apart, and rows without an id like
    any other. Rows with one id and one text count as one. Null texts are empty. An empty
    table gives no rows. Who goes for whom stays beside, in the written table
    ``near_classes-*`` of the shared folder: doc_id, text_hash, keep_id, keep_hash.
    """
    found = written(fingerprints(docs), "fingerprints")
    member = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "fp", F.col("text_hash").alias("hash"))
    rooted = written(found.join(_classes(found, HOT_BLOCK), "fp").select("doc_id", "text_hash", "fp", "root"), "near_roots")
    stay = written(rooted.groupBy("root").agg(F.min(member).alias("m")).select("root", "m.none", "m.id", "m.hash"), "near_kept")
    keep_id = F.when(~F.col("none"), F.col("id")).alias("keep_id")
    written(rooted.join(stay, "root").select("doc_id", "text_hash", keep_id, F.col("hash").alias("keep_hash")), "near_classes")
    key = unused("key", docs.columns)
    named = lambda none, i, h: F.struct(none.alias("none"), i.alias("id"), h.alias("hash"))
    own = docs.withColumn(key, named(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.xxhash64(text_of())))
    kept = stay.select(named(F.col("none"), F.col("id"), F.col("hash")).alias(key))
    return own.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
