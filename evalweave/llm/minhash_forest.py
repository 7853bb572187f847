"""Near-duplicate groups by MinHash and an LSH forest of sorted signature orders.

A document's set holds its distinct w-word shingles as 64-bit hashes; its signature is the minimum of each of :data:`HASHES` hash functions over the set, so that two sets agree in a
place with the probability of their Jaccard similarity t. An order lists the places of the signature in a shuffled sequence; sorted by it, documents lie in a tree of prefixes. A region is what
shares a prefix of the level's depth d in one order; two sets share a region of one order with probability t**d, so that a level has as many orders as make it miss a pair at the threshold with a probability of at most :data:`MISS`.

1. Equal sets are one node from the start, so large groups of copies cost one node.
2. Neighbours: the members of shared regions are sorted by the whole order, over range partitions that may cut a region anywhere; adjacent nodes are those with the longest common prefix. A row a node and order.
   Those that can link are compared on their exact sets; components of the links follow. A group of near copies, whatever its size, is mostly one component after that.
3. Regions that still hold several components are searched whole, depth by region: a link that is missing has an end outside of the region's largest component. So residents (all members, dealt to blocks) meet visitors (members outside of the largest component):
   size + visitors x blocks rows. Where that is a small multiple of the size, the region is searched at this depth. Its nodes go on to the next level else: prefixes twice as long in more orders, where alike sets part from
   others; at the last level every region is searched. First a forest of the likeliest links between components leaves a block and components grow, :data:`FORESTS` times, then every pair that can link. The exact sets always decide.

Pairs within a region are sifted before their sets are fetched: a set's elements flip the bits of a string of two to four bits an element, and two sets differ in at least as many elements as their strings in bits (the longer string folded to the shorter). So the sieve loses nothing.

Nothing is capped: a pair at the threshold can be missed only if its signatures agree in no region of a level, with a probability of at most :data:`MISS` and far smaller ones above the threshold; groups mostly hold further links that lead to the same component.

Cases: null, empty and blank texts have an empty set, which links with nothing; a null doc_id takes no part, keeps a null component and is kept; rows that repeat a doc_id are linked, each with its own n_shingles, whatever their texts;
a component is named by its smallest doc_id, so ties don't arise; columns besides doc_id and text are not read, whatever their names. Texts longer than a step are hashed piece by piece; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import columns, discard, list_column, small_batches, written
from evalweave.llm.components import connected_components
from evalweave.llm.jaccard_join import confirmed, likely_forest, named_groups, node_texts, text_hashes
from evalweave.llm.shingles import MULTIPLIER, mix, shingle_sets

#: Places of a signature.
HASHES = 128
#: Probability that a pair at the threshold shares no region of a level.
MISS = 1e-6
#: Prefix lengths of the levels.
DEPTHS = (3, 6, 12)
#: Places after the prefix that neighbours are sorted by.
TAIL = 9
#: Residents of a block, and visitors that they meet at a time.
BLOCK, VISITORS = 1024, 1024
#: A region is searched where it lies if that makes this many rows a member at most.
ROWS_A_MEMBER = 3
#: Rounds that offer only a forest of likely links.
FORESTS = 1
#: Pairs that a task remembers having offered, as a pair meets in many regions.
SEEN_PAIRS = 1 << 20
#: Elements of a set that are hashed at a time.
CHUNK = 4096

FACTORS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signature(own: np.ndarray) -> np.ndarray:
    """The least of each hash function over a set of 64-bit hashes."""
    high = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(high), CHUNK):
        np.minimum(least, (FACTORS[:, None] * high[at : at + CHUNK]).min(axis=1), out=least)
    return least


def bit_string(own: np.ndarray) -> np.ndarray:
    """The parity of a set's elements by place, in a power of two of bits between two and four an element, 64 at least, as 64-bit words."""
    bits = max(64, 1 << (2 * len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class Strings:
    """Bit strings of several sets, by their number of words."""

    def __init__(self, column: pa.Array):
        self.flat = column.flatten().to_numpy().view(np.uint64)
        ends = column.offsets.to_numpy().astype(np.int64)
        self.start, self.words = ends[:-1] - ends[0], np.diff(ends)

    def of(self, at: np.ndarray, words: int) -> np.ndarray:
        """The strings of sets of ``words`` or twice as many words, folded to ``words``."""
        out = np.empty((len(at), words), dtype=np.uint64)
        for k in (1, 2):
            some = np.flatnonzero(self.words[at] == k * words)
            own = self.flat[self.start[at[some], None] + np.arange(k * words)]
            out[some] = own if k == 1 else own[:, :words] ^ own[:, words:]
        return out


def can_link(distance: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least ``distance`` elements can link."""
    return (distance * (100 + percent) <= (n_a + n_b) * (100 - percent)) & (np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * percent)


def levels(percent: int) -> list[tuple[int, int]]:
    """(depth, orders) of each level."""
    t = percent / 100
    return [(d, 1 if t == 1 else ceil(log(MISS) / log(1 - t**d))) for d in DEPTHS]


@cache
def sorted_orders(depth: int, count: int) -> list[list[int]]:
    """The places that each order begins with: ``depth`` of its prefix, then TAIL more. Prefixes share no place as long as there are enough."""
    rng = np.random.default_rng([depth, count])
    out, pool = [], []
    while len(out) < count:
        if len(pool) < depth:
            pool = rng.permutation(HASHES).tolist()
        head, pool = pool[:depth], pool[depth:]
        out.append(head + [c for c in rng.permutation(HASHES).tolist() if c not in head][:TAIL])
    return out


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint32).reshape(len(column), HASHES)


FEATURES = "doc_id long, h1 long, h2 long, n long, d1 long, d2 long, sig array<int>, bits array<long>"


def signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row per document: its text (h1, h2), its set's size n and digest (d1, d2), its signature and its bit string, empty for an empty set."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), width):
                n = np.array([len(own) for own in sets], dtype=np.int64)
                with np.errstate(over="ignore"):
                    one = np.array([mix(own + np.uint64(0x1F)).sum(dtype=np.uint64) for own in sets], dtype=np.uint64)
                    two = np.array([mix(own ^ np.uint64(0xC3C3C3C3C3C3C3C3)).sum(dtype=np.uint64) for own in sets], dtype=np.uint64)
                    least = [signature(own) for own in sets if len(own)]
                    strings = [bit_string(own) if len(own) else np.zeros(0, np.uint64) for own in sets]
                part = batch.slice(first, len(sets))
                flat = np.concatenate(least).view(np.int32) if least else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), list_column(flat, np.where(n > 0, HASHES, 0), pa.int32()),
                     list_column(np.concatenate(strings).view(np.int64), np.array([len(x) for x in strings], dtype=np.int64), pa.int64())],
                    names=["doc_id", "h1", "h2", "n", "d1", "d2", "sig", "bits"],
                )

    text = columns([text_col])[0]
    rows = docs.select(columns([id_col])[0].cast("long").alias("doc_id"), *text_hashes(text), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(made, FEATURES)


def order_keys(nodes: DataFrame, depth: int, count: int) -> DataFrame:
    """(key, place, node): the region of each node in each order; ``place`` is the order's number."""
    heads = np.array([o[:depth] for o in sorted_orders(depth, count)])
    seeds = mix(np.arange(count, dtype=np.uint64) + np.uint64(1000 * depth + 1))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = _flat(part.column("sig")).astype(np.uint64)
                key = np.tile(seeds, (len(sig), 1))
                for k in range(depth):
                    key = mix(key * np.uint64(MULTIPLIER) + sig[:, heads[:, k]])
                yield pa.RecordBatch.from_pydict({"key": key.ravel().view(np.int64), "place": np.tile(np.arange(count, dtype=np.int32), len(sig)), "node": np.repeat(part.column("node").to_numpy(), count)})

    return nodes.select("node", "sig").mapInArrow(keyed, "key long, place int, node long")


PAIRS = "a long, b long, n_a long, n_b long"


def _pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.RecordBatch:
    swap = a > b
    ends = {"a": np.where(swap, b, a), "b": np.where(swap, a, b), "n_a": np.where(swap, n_b, n_a), "n_b": np.where(swap, n_a, n_b)}
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in ends.items()})


def neighbours(members: DataFrame, nodes: DataFrame, depth: int, count: int, percent: int) -> DataFrame:
    """Pairs that lie side by side in an order, within a region, and can link. Neighbours on two range partitions are left to the search of regions."""
    places = F.array(*[F.array(*[F.lit(c) for c in o[depth:]]) for o in sorted_orders(depth, count)])
    tail: Column = F.transform(F.get(places, "place"), lambda c: F.get("sig", c))
    rows = members.join(nodes.select("node", "n", "sig", "bits"), "node").select("key", "node", "n", "bits", tail.alias("tail"))

    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if last is None else pa.concat_tables([last, table])).combine_chunks()
            if not table.num_rows:
                continue
            key, node, n = (table[c].to_numpy() for c in ("key", "node", "n"))
            strings = Strings(table["bits"].chunk(0))
            at = np.flatnonzero((key[1:] == key[:-1]) & can_link(np.zeros(len(key) - 1, np.int64), n[1:], n[:-1], percent))
            words = np.minimum(strings.words[at], strings.words[at + 1])
            for w in np.unique(words).tolist():
                own = at[words == w]
                distance = np.bitwise_count(strings.of(own, w) ^ strings.of(own + 1, w)).sum(axis=1, dtype=np.int64)
                own = own[can_link(distance, n[own], n[own + 1], percent)]
                yield _pairs(node[own], node[own + 1], n[own], n[own + 1])
            last = table.slice(table.num_rows - 1)

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, "key", "tail", "node").sortWithinPartitions("key", "tail", "node").select("key", "node", "n", "bits")
    return placed.mapInArrow(adjacent, PAIRS).distinct()


def unsettled(members: DataFrame, groups: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the members (key, node, component) and the regions that hold several components (key, largest, blocks, rooms, here); regions of the same nodes count once.

    ``here`` says whether the region is searched at this level.
    """
    found = written(members.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "found")
    who = [F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(20,0)")).alias(f"who{k}") for k in (1, 2)]
    shares = found.groupBy("key", "component").agg(F.count(F.lit(1)).alias("share"), *who)
    each = shares.groupBy("key").agg(F.sum("share").alias("size"), F.max("share").alias("most"), F.max_by("component", "share").alias("largest"), *[F.sum(f"who{k}").alias(f"who{k}") for k in (1, 2)]).where("most < size")
    each = each.groupBy("who1", "who2", "size", "most").agg(F.min(F.struct("key", "largest")).alias("k")).select("k.*", "size", "most")
    blocks, rooms = (F.ceil(c / F.lit(m)).cast("int") for c, m in ((F.col("size"), BLOCK), (F.col("size") - F.col("most"), VISITORS)))
    rows = F.col("size") * F.col("rooms") + (F.col("size") - F.col("most")) * F.col("blocks")
    each = each.withColumns({"blocks": blocks, "rooms": rooms}).select("key", "largest", "blocks", "rooms", (F.lit(last) | (F.col("blocks") == 1) | (rows <= ROWS_A_MEMBER * F.col("size"))).alias("here"))
    return found, written(each, "regions")


def dealt_out(found: DataFrame, regions: DataFrame, nodes: DataFrame) -> DataFrame:
    """The comparisons of regions that are searched: residents of a block and visitors of a room, side by side."""
    rows = found.join(regions.where("here").drop("here"), "key")
    block = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("long")
    room = F.pmod(F.xxhash64("key", "node"), F.col("rooms")).cast("long")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    residents = rows.select("key", "node", "component", block.alias("block"), every("rooms").alias("room"), F.lit(1).alias("side"))
    visitors = rows.where("component <> largest").select("key", "node", "component", every("blocks").alias("block"), room.alias("room"), F.lit(0).alias("side"))
    return written(residents.unionByName(visitors).join(nodes.select("node", "n", "bits"), "node"), "dealt")


def search(dealt: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of different components that can link; of each comparison only a forest of the likeliest, if ``forest``."""

    def compare(side: np.ndarray, node: np.ndarray, n: np.ndarray, comp: np.ndarray, strings: Strings, base: int) -> tuple[np.ndarray, ...]:
        found_a, found_b, found_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        words = strings.words[base : base + len(node)]
        for w in np.unique(words).tolist():
            # sets of w words with such sets, and with sets of twice as many
            for u, v in ((w, w), (w, 2 * w), (2 * w, w)):
                left, right = np.flatnonzero((side == 0) & (words == u)), np.flatnonzero((side == 1) & (words == v))
                if not len(left) or not len(right):
                    continue
                other = strings.of(base + right, w)
                rows = max(1, (1 << 21) // (len(right) * w))
                for at in range(0, len(left), rows):
                    part = left[at : at + rows]
                    distance = np.bitwise_count(strings.of(base + part, w)[:, None, :] ^ other[None, :, :]).sum(axis=2, dtype=np.int64)
                    i, j = np.nonzero((comp[part, None] != comp[None, right]) & can_link(distance, n[part, None], n[None, right], percent))
                    found_a.append(part[i])
                    found_b.append(right[j])
                    found_d.append(distance[i, j] / (n[part[i]] + n[right[j]]))
        a, b, distance = (np.concatenate(x) for x in (found_a, found_b, found_d))
        if forest and len(a):
            kept = likely_forest(comp, a, b, distance)
            a, b = a[kept], b[kept]
        return node[a], node[b], n[a], n[b]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        seen: set[tuple[int, int]] = set()

        def groups(table: pa.Table, final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            key, block, room, side, node, n, comp = (table[c].to_numpy() for c in ("key", "block", "room", "side", "node", "n", "component"))
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (room[1:] != room[:-1])])) if len(key) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(key))
            whole = len(cuts) if final else len(cuts) - 1
            strings = Strings(table["bits"].chunk(0)) if len(key) else None
            for first, last in zip(cuts[:whole].tolist(), ends[:whole].tolist(), strict=True):
                a, b, n_a, n_b = compare(*(x[first:last] for x in (side, node, n, comp)), strings, first)
                if len(seen) > SEEN_PAIRS:
                    seen.clear()
                fresh = [k for k, pair in enumerate(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) if pair not in seen and not seen.add(pair)]
                if fresh:
                    yield _pairs(a[fresh], b[fresh], n_a[fresh], n_b[fresh])
            waiting = table.slice(int(cuts[whole]) if whole < len(cuts) else table.num_rows)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from groups((table if waiting is None else pa.concat_tables([waiting, table])).combine_chunks(), False)
        if waiting is not None:
            yield from groups(waiting.combine_chunks(), True)

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = dealt.repartition(n, "key", "block", "room").sortWithinPartitions("key", "block", "room", "side")
    return placed.mapInArrow(compared, PAIRS).distinct()


def forest_links(docs: DataFrame, nodes: DataFrame, text_col: str, percent: int, width: int) -> DataFrame:
    """(node, component) of the nodes with links."""
    grown: DataFrame | None = None
    texts: DataFrame | None = None
    live = nodes
    todo = levels(percent)

    def joined(candidates: DataFrame) -> bool:
        """Whether a candidate was a link; components grow by what was."""
        nonlocal grown
        pairs = written(candidates, "candidates")
        some = pairs.limit(1).count() > 0
        links = confirmed(pairs, texts, percent, width) if some else pairs.select("a", "b")
        some = some and links.limit(1).count() > 0
        if some or grown is None:
            edges = links.select("a", "b")
            grown = connected_components(edges if grown is None else edges.unionByName(grown.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        discard(pairs)
        return some

    for at, (depth, count) in enumerate(todo):
        keys = order_keys(live, depth, count)
        # partial sums a task: a region that a third of all nodes share is one row of each
        shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
        members = written(keys.join(shared, "key"), "members")
        if texts is None:  # no later level meets a node that shares no region here
            texts = node_texts(nodes, members, docs, text_col)
        joined(neighbours(members, nodes, depth, count, percent))
        forests = FORESTS
        while True:
            found, regions = unsettled(members, grown, at == len(todo) - 1)
            if regions.where("here").limit(1).count():
                dealt = dealt_out(found, regions, nodes)
                some = joined(search(dealt, percent, forests > 0))
                discard(dealt)
            else:
                some = forests = 0
            if not forests:
                break
            discard(found, regions)
            forests = forests - 1 if some else 0  # without a new link the next round offers everything
        deeper = written(found.join(regions.where("not here").select("key"), "key").select("node").distinct(), "deeper")
        discard(found, regions, members)
        if not deeper.limit(1).count():
            break
        live = nodes.join(deeper, "node", "left_semi")
    discard(texts)
    return grown


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; see the module. The threshold is between 50 and 100 percent."""
    if not 50 <= percent <= 100:
        raise ValueError("a threshold between 50 and 100 percent")
    small_batches(docs.sparkSession)
    made = written(signed(docs, id_col, text_col, width), "signed")
    digest = ["n", "d1", "d2"]
    # copies are summed up before they move: a group of them is one row of each task
    equal = made.where("n > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("low"), F.min(F.struct("h1", "h2")).alias("h"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    nodes = written(equal.select(F.monotonically_increasing_id().alias("node"), *digest, "low", "h.h1", "h.h2", "sig", "bits"), "nodes")
    main = made.select("doc_id", *digest).join(nodes.select("node", *digest), digest, "left")
    main = written(main.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "main")
    discard(made)
    linked = forest_links(docs, nodes, text_col, percent, width)
    names = written(nodes.select("node", "low"), "names")
    discard(nodes)
    return named_groups(main, names, linked).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
