"""Operator 6: self-join of documents by the Jaccard similarity of their word n-gram sets.

All n-grams stand in one global order: rare ones first, of equally rare ones by hash. The order of hashes is cut
into fragments (vertical partitioning), and the n-grams of each fragment are counted apart. Two similar sets
share an n-gram among the first few of each in the global order, so those, if they occur elsewhere, are the keys that
find candidate pairs. A pair's overlap is then counted fragment by fragment, a row each, and summed per pair.

Equal sets count as one node. Of a group of sets that share a key each is first compared with the
least one only; across components that this leaves apart every pair of a group is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import bitmap, free_name, in_bitmap, slices, stored, strings
from .components import components

SLICE_CHARS = 800_000
#: Sets that share a key: up to so many are compared as pairs of rows; more are compared as blocks of so
#: many sets or n-grams against each other inside a task, which emits only links that span them.
PAIRED, BLOCK, BLOCK_GRAMS = 48, 512, 250_000
#: Fragments in which a pair's overlap is counted.
COUNTED = 8
#: n-grams of a fragment of the order when they are counted; how often those of each level occur at least; bits of
#: the levels' filters for an n-gram, and in all: the levels of rarer n-grams are left out where they need more.
COUNTED_GRAMS, LEVELS, LEVEL_BITS, MOST_BITS = 1 << 21, tuple(2**i for i in (1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32)), 8, 1 << 27
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(256, dtype=np.uint64))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RADIX, _INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` end to end, A-Z read as a-z, and how many each text has."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    flat = np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    word, edge = ~_BLANK[flat], np.zeros(size + 1, bool)
    edge[offsets] = True  # where a text begins or ends
    starts = np.flatnonzero(word & (edge[:-1] | ~np.append(True, word[:-1])[:size]))
    ends = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], True)[:size])) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * _powers(_RADIX, size)[:size])])
    hashes = mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, size)[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of every text's word n-grams, end to end, and their numbers; of all its words, if it has fewer."""
    words, counts = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        rolled = mixed(rolled) + words[i : len(words) - n + 1 + i]
    rolled = mixed(rolled)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    ends, to = np.cumsum(counts), np.cumsum(grams)
    flat = np.empty(int(to[-1]) if len(to) else 0, np.uint64)
    for end, count, b, g in zip(ends.tolist(), counts.tolist(), to.tolist(), grams.tolist(), strict=True):
        if count >= n:
            flat[b - g : b] = np.sort(rolled[end - count : end - n + 1])
        elif count:
            short = np.full(1, count, np.uint64)
            for h in words[end - count : end]:
                short = mixed(short) + h
            flat[b - 1] = mixed(short + _C)[0]
    new = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
    new[(to - grams)[grams > 0]] = True
    before = np.concatenate([[0], np.cumsum(new)])
    return flat[new], before[to] - before[to - grams]


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32, their first bytes together and so on, which a shuffle packs well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


@dataclass(frozen=True)
class Order:
    """How rare an n-gram is, by its hash: Bloom filters of the n-grams of each level, a segment per fragment.

    Any function of the hash makes an order that finds all pairs; counts of fewer bits than the hash has and filters that
    err only change which keys a set has.
    """

    bits: int  # of a hash that tell n-grams apart here
    fragment_bits: int
    levels: tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]  # filter words; each fragment's first bit and number of bits
    all_shared: bool  # the lowest level holds all n-grams that occur twice

    @staticmethod
    def places(value: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        h = mixed(value.astype(np.uint64))
        return [(((part & np.uint64(0xFFFFFFFF)) * size.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) for part in (h, h >> np.uint64(32))]

    def rank(self, hashes: np.ndarray) -> np.ndarray:
        """0 for n-grams of no level, else the number of the highest."""
        value = hashes >> np.uint64(64 - self.bits)
        fragment = (value >> np.uint64(self.bits - self.fragment_bits)).astype(np.int64)
        out, at = np.zeros(len(hashes), np.uint8), np.arange(len(hashes))
        for number, (words, first, size) in enumerate(self.levels, 1):
            f = fragment[at]
            hit = size[f] > 0
            for place in self.places(value[at], size[f]):
                bit = np.minimum(first[f] + place, len(words) * 64 - 1)
                hit &= (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            at = at[hit]
            out[at] = number
        return out


def global_order(docs: DataFrame, n: int) -> Order:
    """Counts the n-grams of all texts, each fragment of the hashes' order by itself.

    A task sends a fragment's n-grams as sorted gaps, about two bytes each, with counts summed over its texts.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    expected = max(1024, size // 4)
    fragment_bits = max(0, math.ceil(math.log2(expected / COUNTED_GRAMS)))
    bits = min(fragment_bits + 31, math.ceil(math.log2(expected)) + 6)
    within = np.uint64(bits - fragment_bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(0))
            for low, high in slices(texts, SLICE_CHARS):
                value = np.sort(shingle_sets(texts.slice(low, high - low), n)[0] >> np.uint64(64 - bits))
                if not len(value):
                    continue
                first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
                counts, value = np.diff(np.append(first, len(value))), value[first]
                fragment = value >> within
                begin = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1]))
                gaps = np.append(value[:1], value[1:] - value[:-1])
                gaps[begin] = value[begin] & ((np.uint64(1) << within) - np.uint64(1))
                spans = list(zip(begin.tolist(), np.append(begin[1:], len(value)).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(fragment[begin].astype(np.int64)), pa.array([_planes(gaps[a:b]) for a, b in spans], pa.binary()), pa.array([_planes(counts[a:b]) for a, b in spans], pa.binary())], ["fragment", "gaps", "counts"])

    def levels(group: pd.DataFrame) -> pd.DataFrame:
        value = np.concatenate([np.cumsum(_unplanes(raw)) for raw in group["gaps"]])
        counts = np.concatenate([_unplanes(raw) for raw in group["counts"]])
        order = np.argsort(value, kind="stable")
        value, counts = value[order], counts[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        value, counts = value[first] + (int(group["fragment"].iloc[0]) << int(within)), np.add.reduceat(counts, first)
        out = []
        for level in LEVELS:
            found = value[counts >= level]
            if not len(found):
                break
            words = np.zeros(-(-len(found) * LEVEL_BITS // 64), np.uint64)
            for place in Order.places(found, np.array([len(words) * 64])):
                np.bitwise_or.at(words, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
            out.append((int(group["fragment"].iloc[0]), level, words.tobytes()))
        return pd.DataFrame(out, columns=["fragment", "level", "words"])

    cut_up = docs.select(F.col("text").cast("string")).mapInArrow(cut, "fragment long, gaps binary, counts binary")
    found = stored(cut_up.groupBy("fragment").applyInPandas(levels, "fragment long, level long, words binary"))
    sizes = {r["level"]: r["bits"] for r in found.groupBy("level").agg((F.sum(F.octet_length("words")) * 8).alias("bits")).collect()}
    chosen = [level for level in sorted(sizes) if sizes[level] <= MOST_BITS]
    made = []
    for level in chosen:
        rows = found.where(F.col("level") == level).select("fragment", "words").toArrow()
        first, size = np.zeros(1 << fragment_bits, np.int64), np.zeros(1 << fragment_bits, np.int64)
        at = np.asarray(rows["fragment"])
        size[at] = np.asarray(pc.binary_length(rows["words"])).astype(np.int64) * 8
        first[at] = np.cumsum(size[at]) - size[at]
        made.append((np.frombuffer(b"".join(rows["words"].to_pylist()), np.uint64), first, size))
    return Order(bits, fragment_bits, tuple(made), not sizes or LEVELS[0] in chosen)


def prefix_size(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """So many n-grams of a set, in any global order, hold one of every similar set's as many."""
    return size - -(-size * percent // 100) + 1


def prefix_keys(flat: np.ndarray, sizes: np.ndarray, order: Order, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each set's prefix that may occur elsewhere, rarest first, and their numbers."""
    rank = order.rank(flat)
    wanted = prefix_size(sizes, percent)
    row = np.repeat(np.arange(len(sizes)), sizes)
    lonely = np.bincount(row[rank == 0], minlength=len(sizes)) if order.all_shared else np.zeros(len(sizes), np.int64)
    some = (sizes > 0) & (lonely < wanted)
    at = np.flatnonzero(some[row])
    at = at[np.lexsort((rank[at], row[at]))]  # a stable sort: hashes rise within a rank
    kept = np.where(some, sizes, 0)
    place = np.arange(len(at)) - (np.cumsum(kept) - kept)[row[at]]
    keep = place < wanted[row[at]]
    if order.all_shared:
        keep &= rank[at] > 0
    at = at[keep]
    return flat[at], np.bincount(row[at], minlength=len(sizes))


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), _as_long(flat))


def _described(rows_of: DataFrame, n: int, percent: int, shared: Broadcast) -> DataFrame:
    """uid, doc_id, n_shingles, x, y (128 bits that tell sets apart; null if empty), keys, and of sets with keys parts: the set's hashes by fragment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(2))
            for low, high in slices(texts, SLICE_CHARS):
                flat, sizes = shingle_sets(texts.slice(low, high - low), n)
                keys, counts = prefix_keys(flat, sizes, shared.value, percent)
                before, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
                ids = []
                for salt in (_A, _C):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(flat ^ salt))])
                    ids.append(pa.array(mixed(sums[ends] - sums[before] + sizes.astype(np.uint64)).view(np.int64), mask=sizes == 0))
                has = counts > 0
                row = np.repeat(np.arange(len(sizes)), sizes)
                of = row[has[row]]
                held = flat[has[row]]
                fragment = (held >> np.uint64(64 - COUNTED.bit_length() + 1)).astype(np.int64)
                inner = np.bincount((np.cumsum(has) - 1)[of] * COUNTED + fragment, minlength=int(has.sum()) * COUNTED)
                outer = pa.array(np.concatenate([[0], np.cumsum(has)]).astype(np.int32) * COUNTED)
                parts = pa.ListArray.from_arrays(outer, _lists(held, inner))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low) for i in (0, 1)), pa.array(sizes.astype(np.int64)), *ids, _lists(keys, counts), parts], ["uid", "doc_id", "n_shingles", "x", "y", "keys", "parts"])

    return rows_of.select("uid", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "uid long, doc_id long, n_shingles long, x long, y long, keys array<long>, parts array<array<long>>")


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` that a join with ``nodes(node)`` may need; most others don't reach its shuffle."""
    nodes = nodes.distinct()
    wanted = sets.sparkSession.sparkContext.broadcast(bitmap(nodes, nodes.count()))

    def likely(node: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(wanted.value, node.to_numpy(np.int64)))

    return sets.where(F.pandas_udf(likely, BooleanType())("node"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` of ``sets(node, n, keys, parts)`` that are similar.

    Sizes and the overlap of the two prefixes bound a pair's overlap from above: what lies behind the prefix that ends first can
    add no more than its set has left. For pairs within the bound each fragment gives a row with its overlap, summed per pair.
    """
    enough = lambda shared: shared * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    head = sets.select("node", "n", "keys")
    of = lambda side: head.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("keys").alias(f"keys_{side}"))
    left = lambda side: F.expr(f"(n_{side} * {percent} + 99) div 100 - 1")
    rows = pairs.join(of("a"), "a").join(of("b"), "b").where(enough(F.least("n_a", "n_b")))
    likely = stored(rows.where(enough(F.size(F.array_intersect("keys_a", "keys_b")) + F.greatest(left("a"), left("b")))).select("a", "b", "n_a", "n_b"))
    needed = _only(sets, likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))))
    of = lambda side: needed.select(F.col("node").alias(side), F.posexplode("parts").alias("fragment", f"part_{side}")).where(f"size(part_{side}) > 0")
    counted = likely.join(of("a"), "a").join(of("b"), ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).cast("long").alias("shared"))
    return counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared")).where(enough(F.col("shared"))).select("a", "b")


def _overlaps(lists: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two lists share."""
    shared = np.zeros((len(lists), len(lists)), np.float32)
    owners = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, code, df = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    column, keep = np.cumsum(df > 1) - 1, (df > 1)[code]
    for low in range(0, int((df > 1).sum()), 2048):  # numbers that two lists have at least, so many at a time
        now = keep & (column[code] >= low) & (column[code] < low + 2048)
        has = np.zeros((len(lists), 2048), np.float32)
        has[owners[now], column[code[now]] - low] = 1
        shared += has @ has.T
    return shared.astype(np.int64)


def _promising(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of a tile that some row of another component may be similar to, by sizes and prefixes."""
    n, label = group["n"].to_numpy(np.int64), group["label"].to_numpy(np.int64)
    behind = -(-n * percent // 100) - 1
    most = np.minimum(_overlaps(group["keys"].tolist()) + np.maximum(behind[:, None], behind), np.minimum(n[:, None], n))
    may = (most * (100 + percent) >= (n[:, None] + n) * percent) & (label[:, None] != label)
    return group.loc[may.any(1), ["key", "i", "j", "node"]]


def _spanning(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that connect all similar sets of a tile (node, n, parts) as all its links do: overlaps by fragment, summed."""
    ids, sizes = group["node"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    shared = sum(_overlaps([parts[fragment] for parts in group["parts"]]) for fragment in range(COUNTED))
    like = shared * (100 + percent) >= (sizes[:, None] + sizes) * percent
    np.fill_diagonal(like, False)
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label, np.where(like, label, len(ids)).min(1, initial=len(ids)))
        least = least[least]
        if (least == label).all():
            break
        label = least
    far = label != np.arange(len(ids))
    return pd.DataFrame({"a": ids[label[far]], "b": ids[far]})


def _blocked_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Spanning links of ``large(key, node, label, blocks)``: each pair of blocks of a group is a task of bounded size.

    Tiles see sizes and prefixes first; only sets that these leave in doubt come with all their n-grams.
    """
    dealt = large.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    tiles = dealt.select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("key", "node", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    heads = tiles.join(sets.select("node", "n", "keys"), "node")
    doubt = stored(heads.groupBy("key", "i", "j").applyInPandas(lambda g: _promising(g, percent), "key long, i long, j long, node long"))
    full = doubt.join(_only(sets, doubt.select("node")).select("node", "n", "parts"), "node")
    return full.groupBy("key", "i", "j").applyInPandas(lambda g: _spanning(g, percent), "a long, b long").distinct()


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.9) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included).

    Links join documents whose n-gram sets have a Jaccard similarity of ``threshold`` (whole per
    cent) or more. A null or blank text has an empty set, links with nothing and is its own component.
    Repeated rows each get a row; a null doc_id never names a component that has another id. An empty table gives no rows.
    n-grams are told apart by 64-bit hashes, equal sets by 128 bits. Other columns are left out, whatever their names.
    """
    rows = docs.select("doc_id", "text").withColumn("uid", F.monotonically_increasing_id())
    return _grouped(rows, n, round(threshold * 100)).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group that links join, the row of the least doc_id stays.

    Of repeated rows one stays, of rows that differ under one doc_id one of each group. Rows with null or blank texts are
    groups of their own and stay; a row with a null doc_id stays where its group has no other. All columns, whatever their names, come back.
    """
    uid = free_name(docs.columns, "uid")
    rows = stored(docs.withColumn(uid, F.monotonically_increasing_id()))
    grouped = stored(_grouped(rows.select("doc_id", "text", F.col(uid).alias("uid")), n, round(threshold * 100)).where("label is not null"))
    first = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")).select(F.col("first.uid").alias(uid))
    gone = grouped.select(F.col("uid").alias(uid)).join(first, uid, "left_anti")
    return rows.join(gone, uid, "left_anti").select(*docs.columns)


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels(node, label)`` of components after ``more`` links(a, b): components of the labels that these join, which are few."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    named = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = named.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    joined = stored(components(ends))
    all_labels = labels.unionByName(joined.select("node", F.col("node").alias("label"))).distinct()
    return all_labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def _grouped(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``rows(uid, doc_id, text)`` to uid, doc_id, n_shingles, label (of the group, null without n-grams), component_id (its least doc_id)."""
    order = rows.sparkSession.sparkContext.broadcast(global_order(rows, n))
    described = stored(_described(rows, n, percent, order))
    # one set, one node, whatever the number of its copies; a row's uid names it
    nodes = stored(described.where("x is not null").groupBy("x", "y").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least_id")))
    keyed = described.where("size(keys) > 0")
    listed = keyed.select(F.col("uid").alias("node"), F.col("n_shingles").alias("n"), "keys").join(nodes.select("node"), "node", "left_semi").select("node", "n", F.explode("keys").alias("key"))
    sets = keyed.select(F.col("uid").alias("node"), F.col("n_shingles").alias("n"), "keys", "parts")
    hubs = listed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    members = stored(listed.join(hubs.select("key", "hub"), "key"))
    links = stored(_linked(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, percent))
    labels = stored(components(links))

    # keys whose sets are not all connected yet: every pair across components, save those with the hub
    named = members.join(labels, "node", "left").select("key", "hub", "node", "n", F.coalesce("label", "node").alias("label"))
    split = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"), F.sum("n").alias("grams")).where("low < high").select("key", "m", "grams")
    open_ = stored(named.join(split, "key"))
    large = open_.where(F.col("m") > PAIRED).select("key", "node", "label", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long").alias("blocks"))
    few = open_.where(F.col("m") <= PAIRED)
    other = few.select("key", F.col("node").alias("q"), F.col("n").alias("q_n"), F.col("label").alias("q_label"))
    across = few.select("key", "hub", F.col("node").alias("p"), F.col("n").alias("p_n"), F.col("label").alias("p_label")).join(other, "key").where("p < q and p_label <> q_label and p <> hub and q <> hub")
    across = across.where(F.least("p_n", "q_n") * 100 >= F.greatest("p_n", "q_n") * percent)
    more = stored(_blocked_links(large, sets, percent).unionByName(_linked(across.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), sets, percent)))
    final = labels if not more.take(1) else stored(_merged(labels, more))
    per_node = nodes.join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = per_node.groupBy("label").agg(F.min("least_id").alias("component"))
    per_set = per_node.join(least, "label").select("x", "y", "label", F.col("component").alias("component_id"))
    return described.select("uid", "doc_id", "n_shingles", "x", "y").join(per_set, ["x", "y"], "left").select("uid", "doc_id", "n_shingles", "label", "component_id")


def sql(n: int = 3, percent: int = 90) -> str:
    """The same rows as ``ngram_jaccard_join`` in DuckDB's SQL, from all pairs of documents that share an n-gram."""
    return f"""WITH RECURSIVE worded AS MATERIALIZED (
  SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT u, doc_id, CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS grams FROM worded),
sized AS MATERIALIZED (SELECT u, doc_id, CAST(len(grams) AS BIGINT) AS n_shingles FROM sets),
gram AS MATERIALIZED (SELECT u, unnest(grams) AS g FROM sets),
shared AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.u < b.u GROUP BY 1, 2),
half AS (SELECT a, b FROM shared JOIN sized x ON x.u = a JOIN sized y ON y.u = b WHERE 100 * c >= {percent} * (x.n_shingles + y.n_shingles - c)),
link AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reached AS (SELECT u, doc_id AS c FROM sized UNION SELECT link.b, reached.c FROM reached JOIN link ON reached.u = link.a)
SELECT doc_id, n_shingles, component_id FROM sized JOIN (SELECT u, min(c) AS component_id FROM reached GROUP BY u) USING (u)"""
