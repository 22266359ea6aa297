"""Candidate search over 64-bit signatures in packed blobs (16 bytes a record through the shuffle instead of a row each), and verification of candidates in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RECORD = np.dtype([("sig", "<u8"), ("id", "<i8")])
BUCKET_BYTES, FLUSH = 24 << 20, 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that sums and sequence numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def n_buckets(records: int, least: int) -> int:
    return max(least, -(-records * RECORD.itemsize // BUCKET_BYTES))


class Packer:
    """Collects (signature, id) arrays of a task and yields blobs by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.sigs, self.ids, self.n = buckets, [], [], 0

    def add(self, sigs: np.ndarray, ids: np.ndarray) -> None:
        self.sigs.append(sigs)
        self.ids.append(ids)
        self.n += len(sigs)

    def blobs(self, least: int = FLUSH) -> Iterator[dict[str, list]]:
        if self.n < max(1, least):
            return
        out = np.empty(self.n, RECORD)
        out["sig"], out["id"] = np.concatenate(self.sigs), np.concatenate(self.ids)
        self.sigs, self.ids, self.n = [], [], 0
        bucket = (mix(out["sig"]) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out, ends = out[order], np.cumsum(np.bincount(bucket, minlength=self.buckets))
        starts = ends - np.bincount(bucket, minlength=self.buckets)
        used = np.flatnonzero(ends > starts)
        yield {"bucket": used.astype(np.int32), "records": [out[starts[b] : ends[b]].tobytes() for b in used]}


#: With ``sized`` ids their first bits, but for the sign, are a logarithm of a size: base 1.01, so that sizes may differ by so many steps.
SIZE_BITS, SIZE_BASE = 11, 1.01
#: Pairs are handed on, each once with its sum of weights, when so many are held.
HOLD = 1_000_000


def size_code(n: int) -> int:
    return int(math.log(max(n, 1)) / math.log(SIZE_BASE)) + 1


def sized_id(key: int, n: int) -> int:
    """A positive 64-bit id of the size and 52 bits of ``key``: ids in order are in order of size."""
    return min(size_code(n), (1 << SIZE_BITS) - 1) << 52 | key & ((1 << 52) - 1)


def _equal_pairs(roles: bool, steps: int | None):
    """Reduce side: pairs of ids under one signature with their weights, combined within a bucket. With ``roles`` the lowest bit of an id is its role and pairs have one of
    each. With ``steps`` ids are sized ones, and pairs whose sizes are further apart are never made. A signature's lowest bit adds one to its weight of 1.

    Groups are walked by distance in sorted order, so memory stays at a few copies of the bucket's records however many pairs a group has.
    """

    def run(batches):
        parts = [np.frombuffer(x, RECORD) for b in batches for x in b.column(1).to_pylist()]
        if not parts:
            return
        a = np.concatenate(parts)
        del parts
        a = a[np.lexsort((a["id"], a["sig"]))]
        sig, ids = a["sig"].copy(), a["id"].copy()
        del a
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        sig, ids = sig[new], ids[new]
        alone = np.ones(len(sig), bool)
        alone[1:] &= sig[1:] != sig[:-1]
        alone[:-1] &= sig[1:] != sig[:-1]
        sig, ids = sig[~alone], ids[~alone]
        held, n, step = [], 0, 1
        at = np.arange(len(sig))
        while len(at := at[at + step < len(sig)]):
            at = at[sig[at] == sig[at + step]]
            if steps is not None:  # in order of size, so what is too far apart stays so
                at = at[(ids[at + step] >> 52) - (ids[at] >> 52) <= steps]
            x, y, w = ids[at], ids[at + step], (sig[at] & np.uint64(1)).astype(np.int64) + 1
            if roles:
                ok = (x ^ y) & 1 == 1
                x, y, w = x[ok] >> 1, y[ok] >> 1, w[ok]
            ok = x != y
            x, y, w = x[ok], y[ok], w[ok]
            if len(x):
                held.append(np.stack([np.minimum(x, y), np.maximum(x, y), w], 1))
                n += len(x)
            if n > HOLD:
                yield _pairs(held)
                held, n = [], 0
            step += 1
        if held:
            yield _pairs(held)

    return run


def _pairs(held: list[np.ndarray]) -> dict[str, np.ndarray]:
    p = np.concatenate(held)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    first = np.flatnonzero(np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(1)]))
    return {"a": p[first, 0], "b": p[first, 1], "weight": np.add.reduceat(p[:, 2], first)}


def candidate_pairs(blobs: DataFrame, buckets: int, roles: bool = False, steps: int | None = None, least: int = 1) -> DataFrame:
    """Distinct pairs (a < b) of ids whose common signatures weigh at least ``least``, as a work table. ``blobs`` has (bucket, records)."""
    found = C.map_batches(blobs.repartitionById(buckets, "bucket"), _equal_pairs(roles, steps), "a bigint, b bigint, weight bigint")
    return C.work_table(found.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= least).select("a", "b"), "pairs")


# --- verification in blocks --------------------------------------------------------------------------------------------------------------

#: About so many pairs are verified together.
BLOCK_PAIRS = 200_000
LINKED = "k1 bigint, k2 bigint, root1 bigint, root2 bigint, linked bigint, n_links bigint"


def _blocks(near: Callable[[object, object], bool], read: Callable[[bytes], object]):
    """Rows come sorted by block, its items before its pairs; one block is held at a time. Puts out one row an item: its links and the root of its tree."""

    def flush(items, found):
        names = list(items)
        at = {x: i for i, x in enumerate(names)}
        root, linked, count = list(range(len(names))), [0] * len(names), [0] * len(names)

        def top(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for a, b in found:
            i, j = at[a], at[b]
            linked[i] += items[b][0]
            linked[j] += items[a][0]
            count[i] += 1
            count[j] += 1
            root[top(i)] = top(j)
        used = [i for i in range(len(names)) if count[i]]
        tops = [names[top(i)] for i in used]
        return {"k1": [names[i][0] for i in used], "k2": [names[i][1] for i in used], "root1": [t[0] for t in tops], "root2": [t[1] for t in tops], "linked": [linked[i] for i in used], "n_links": [count[i] for i in used]}

    def run(batches):
        block, items, by_id, found = None, {}, {}, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("block", "a", "b", "k1", "members", "payload"))):
                if row[0] != block:
                    if found:
                        yield flush(items, found)
                    block, items, by_id, found = row[0], {}, {}, []
                _, a, b, k1, members, payload = row
                if payload is not None:
                    items[k1, a] = members, read(payload)
                    by_id.setdefault(a, []).append((k1, a))
                else:  # an id may stand for several keys
                    found += [(x, y) for x in by_id[a] for y in by_id[b] if near(items[x][1], items[y][1])]
        if found:
            yield flush(items, found)

    return run


def linked_in_blocks(pairs: DataFrame, items: Callable[[DataFrame], DataFrame], near: Callable[[object, object], bool], read: Callable[[bytes], object]) -> DataFrame:
    """Work table of the verified links of ``pairs``, see ``LINKED``: for each item and block, how many ``members`` its partners have, how many these are, and the root of its tree of links.

    Pairs of one neighbourhood (by the least id around the smaller end) are one block, or a square of blocks where they are many, and an item goes once to each block that
    has a pair of it, not once a pair. ``items`` makes rows (id, blocks, k1, members, payload) for a work table (id, blocks). No pair leaves a block.
    """
    ends = pairs.select(F.col("a").alias("node"), F.col("a").alias("low")).union(pairs.select("b", "a")).groupBy("node").agg(F.min("low").alias("label"))
    owned = pairs.join(ends.select(F.col("node").alias("a"), "label"), "a")
    sizes = owned.groupBy("label").agg(F.count("*").alias("n"))
    side = F.ceil(F.sqrt(F.col("n") / BLOCK_PAIRS)).cast("bigint")
    large = C.work_table(sizes.where(F.col("n") > BLOCK_PAIRS).select("label", side.alias("side")), "large")
    owned = owned.join(C.checked_broadcast(large), "label", "left").withColumn("side", F.coalesce("side", F.lit(1)))
    cell = F.pmod(F.xxhash64("a"), "side") * F.col("side") + F.pmod(F.xxhash64("b"), "side")
    owned = C.work_table(owned.select(F.xxhash64("label", cell).alias("block"), "a", "b"), "owned")
    needed = owned.select("block", F.col("a").alias("id")).union(owned.select("block", "b")).groupBy("id").agg(F.collect_set("block").alias("blocks"))
    no = lambda kind: F.lit(None).cast(kind)
    sent = items(C.work_table(needed, "needed")).select(F.explode("blocks").alias("block"), F.col("id").alias("a"), no("bigint").alias("b"), "k1", "members", "payload")
    rows = sent.union(owned.select("block", "a", "b", no("bigint"), no("bigint"), no("binary")))
    placed = rows.repartition(C.parallelism(pairs.sparkSession), "block").sortWithinPartitions("block", F.col("payload").isNull())
    return C.work_table(C.map_batches(placed, _blocks(near, read), LINKED), "verified")
