"""N-gram Jaccard self-join by parity sketches, and the groups that its links make.

A document's set holds its distinct w-word shingles as 64-bit hashes. Two sets of a and b elements link when their
Jaccard similarity is at least t, that is when they differ in at most (a + b)(1 - t)/(1 + t) elements.

Sketch: an element's hash names one of P places and one of the 16 bits there, which it flips, and flips further bits of a hash of the place. Elements of both
sets do the same to both, so the Hamming distance of two sketches is at most the size of the symmetric difference, and a place that no element of the
difference falls into is equal. Size bands grow by :data:`RATIO`; a band has one P, above what its pairs can differ in. A document is sketched for its own band and, where
partners of smaller size lie in the band below, for that band too.

Pigeonhole: sets that differ in at most D elements agree in P - D places at least. So, with a band's places in any order that depends on their content alone, the first
D + 1 places of either set hold one that they share. The order is by the number of elements in a place, the most first: such places are the
rarest, and places without an element, which everybody shares, come last. Documents join on the hashes of their first D + 1 places.

1. Equal sets are one node from the start, so large groups of copies cost one node.
2. The nodes that share a hash give a star around the smallest: no bucket emits all of its pairs.
   Stars pass the Hamming bound, then the exact sets are compared; components of the links follow.
3. Buckets that still hold several components are dealt in blocks of at most ``BLOCK`` nodes, block against block, where sketches are compared in arrays. First only a forest of the likeliest links between
   components leaves a block, the exact sets decide, and components grow, until that adds no link or :data:`FORESTS` times.
   Then all pairs of different components within the Hamming bound leave, and the exact sets decide again. A pair within one component can't change it.

So every link between components is found, whatever the size of a bucket, and links within a component need not be listed.

Cases: null, empty and blank texts have an empty set, which links with nothing; in :func:`jaccard_groups` a null doc_id takes no part and keeps a null
component, and rows that repeat a doc_id are linked, each with its own n_shingles, whatever their texts; a component is named by its
smallest doc_id, so ties don't arise; columns besides doc_id and text are not read. More than 60 rounds of joining stars to components, enough for paths of 2**60 links, raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import columns, discard, free_name, list_column, small_batches, written
from evalweave.llm.components import _forest, connected_components
from evalweave.llm.shingles import mix, shingle_sets

#: Nodes of a bucket that one comparison holds at a time, on either side.
BLOCK = 1024
#: Rounds that offer only a forest of likely links; what they leave is left to the last round, which offers everything.
FORESTS = 4
#: Pairs that a task remembers having offered, as a pair meets in many buckets.
SEEN_PAIRS = 1 << 20
#: Sizes of a band lie within this factor.
RATIO = 3
#: Shingles of leaves that one task compares with a star's centre at most, about.
SALT_SHINGLES = 2_000_000
#: Elements that a step of sketching holds at a time, or one document.
STEP_ELEMENTS = 1 << 18


class Bands:
    """Size bands for a threshold of ``percent`` in a hundred: band k holds sizes from RATIO**k to RATIO**(k + 1) - 1."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("a threshold between 50 and 100 percent")
        self.percent = percent

    def of(self, size: int) -> int:
        k = 0
        while RATIO ** (k + 1) <= size:
            k += 1
        return k

    def top(self, band: int) -> int:
        return RATIO ** (band + 1) - 1

    def most(self, smaller: int) -> int:
        """Elements in which a set of this size and one that links to it, no smaller, can differ."""
        return smaller * (100 - self.percent) // self.percent

    def least(self, size: int) -> int:
        """The smallest size of a set that links to one of this size."""
        return -(-size * self.percent // 100)

    def places(self, band: int) -> int:
        """More than pairs of this band can differ in, by enough that few sets have too many empty places; a multiple of 8."""
        return ((self.most(self.top(band)) + 1) * 5 // 4 // 8 + 1) * 8

    def wanted(self, size: int) -> list[tuple[int, int]]:
        """(band, D + 1) where a set of this size meets sets that differ from it; none where only equal sets link."""
        own = self.of(size)
        out = [(own, self.most(size) + 1)] if self.most(size) else []
        if own and self.least(size) <= self.top(own - 1):
            differ = (min(self.top(own - 1), size) + size) * (100 - self.percent) // (100 + self.percent)
            if differ:
                out.append((own - 1, differ + 1))
        return out


def sketches(sets: list[np.ndarray], asked: list[tuple[int, int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each asked (set, band, places, first): the sketch as bytes, and the hashes of that many places, most elements first."""
    at = 0
    while at < len(asked):
        end, elements = at, 0
        while end < len(asked) and (end == at or elements + len(sets[asked[end][0]]) <= STEP_ELEMENTS):
            elements += len(sets[asked[end][0]])
            end += 1
        part = asked[at:end]
        at = end
        places = np.array([p for _, _, p, _ in part], dtype=np.int64)
        base = np.cumsum(places) - places
        size = np.array([len(sets[i]) for i, _, _, _ in part])
        spread = mix(np.concatenate([sets[i] for i, _, _, _ in part]) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        wide = np.repeat(places.astype(np.uint64), size)
        slot = ((spread >> np.uint64(32)) * wide >> np.uint64(32)).astype(np.int64) + np.repeat(base, size)
        flips = (mix(spread) & np.uint64(0xFFFFFFFFFFFF0000)) | (np.uint64(1) << (spread & np.uint64(15)))
        total = int(places.sum())
        word = np.zeros(total, dtype=np.uint64)
        np.bitwise_xor.at(word, slot, flips)
        count = np.bincount(slot, minlength=total)
        within = (np.arange(total) - np.repeat(base, places)).astype(np.uint64)
        level = np.repeat(np.array([b for _, b, _, _ in part], dtype=np.uint64), places)
        hashed = mix(mix(word + within * np.uint64(0x9E3779B97F4A7C15)) + level * np.uint64(0xD6E8FEB86659FD93))
        # the first byte orders places by their elements, the most first
        key = (np.uint64(255) - np.minimum(count, 255).astype(np.uint64)) << np.uint64(56) | hashed >> np.uint64(8)
        bits = (word & np.uint64(0xFFFF)).astype(np.uint16)
        for (_, _, p, first), b in zip(part, base.tolist(), strict=True):
            own = key[b : b + p]
            yield bits[b : b + p], np.sort(own)[:first]


def _joined(parts: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """A list column; None is an empty list."""
    flat = [np.zeros(0, np.int64) if p is None else p for p in parts]
    return list_column(np.concatenate(flat) if flat else np.zeros(0, np.int64), np.array([len(p) for p in flat], dtype=np.int64), kind)


FEATURES = "doc_id long, h1 long, h2 long, n long, d1 long, d2 long, band int, sketch array<long>, keys array<long>, sketch_below array<long>, keys_below array<long>"


def text_hashes(text: Column) -> list[Column]:
    """h1, h2: tell texts apart; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]


def features(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> DataFrame:
    """A row per document: its text (h1, h2), its set's size n and digest (d1, d2), and sketches and place hashes for its band and the one below; empty lists where it has no use for them."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for first, sets in shingle_sets(batch.column("text"), width):
                n = np.array([len(own) for own in sets], dtype=np.int64)
                with np.errstate(over="ignore"):
                    one = np.array([mix(own + np.uint64(0x1F)).sum(dtype=np.uint64) for own in sets], dtype=np.uint64)
                    two = np.array([mix(own ^ np.uint64(0xC3C3C3C3C3C3C3C3)).sum(dtype=np.uint64) for own in sets], dtype=np.uint64)
                band = [bands.of(int(k)) if k else 0 for k in n]
                asked = [(i, b, bands.places(b), most) for i, k in enumerate(n.tolist()) if k for b, most in bands.wanted(k)]
                lists: list[list[np.ndarray | None]] = [[None] * len(sets) for _ in range(4)]
                for (i, b, _, _), (bits, keys) in zip(asked, sketches(sets, asked), strict=True):
                    at = 0 if b == band[i] else 2
                    lists[at][i], lists[at + 1][i] = bits.view(np.int64), keys.view(np.int64)
                part = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(band, pa.int32()), *(_joined(x, pa.int64()) for x in lists)],
                    names=["doc_id", "h1", "h2", "n", "d1", "d2", "band", "sketch", "keys", "sketch_below", "keys_below"],
                )

    text = columns([text_col])[0]
    rows = docs.select(columns([id_col])[0].cast("long").alias("doc_id"), *text_hashes(text), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(sketched, FEATURES)


def within_bound(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches in the pair's band allow a link, with both sizes."""
    own = nodes.where("size(sketch) > 0").select("node", "band", "n", "sketch")
    below = nodes.where("size(sketch_below) > 0").select("node", (F.col("band") - 1).alias("band"), "n", F.col("sketch_below").alias("sketch"))
    every = own.unionByName(below)
    side = lambda x: every.select(F.col("node").alias(x), "band", F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    distance = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return both.where(fits).where(distance * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b", "n_a", "n_b")


def node_texts(nodes: DataFrame, ends: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, text) of the nodes of ``ends``, one text each, written."""
    wanted = nodes.select("node", "h1", "h2").join(ends.select("node").distinct(), "node", "left_semi")
    text = columns([text_col])[0]
    rows = docs.select(*text_hashes(text), F.coalesce(text, F.lit("")).alias("text"))
    # a text that many documents repeat: one of them for each partial sum
    return written(rows.join(wanted, ["h1", "h2"]).groupBy("node").agg(F.min("text").alias("text")), "texts")


def exact_links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose exact sets link; one text of each node in a pair is fetched."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    texts = node_texts(nodes, ends, docs, text_col)
    links = confirmed(pairs, texts, percent, width)
    discard(texts)
    return links


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) whose exact sets link, written.

    A leaf's text goes to each star that it is a leaf of; a centre's text goes once to each of the tasks that its leaves are dealt to.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.sum("n_b") / F.lit(SALT_SHINGLES)).cast("int").alias("salts"))
    leaves = pairs.select("a", "b").join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    right = leaves.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "salt", F.lit(1).alias("leaf"), "b", "text")
    left = salts.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("leaf"), F.col("a").alias("b"), "text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, leaf = (batch.column(c).to_pylist() for c in ("a", "b", "leaf"))
            found_a, found_b = [], []
            for first, sets in shingle_sets(batch.column("text"), width):
                for k, own in enumerate(sets, first):
                    if not leaf[k]:
                        centre = own
                    elif len(centre) and len(own):
                        at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                        shared = int((centre[at] == own).sum())
                        if 100 * shared >= percent * (len(centre) + len(own) - shared):
                            found_a.append(a[k])
                            found_b.append(b[k])
            yield pa.RecordBatch.from_pydict({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = left.unionByName(right).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "leaf")
    return written(placed.mapInArrow(compared, "a long, b long"), "links")


def likely_forest(comp: np.ndarray, a: np.ndarray, b: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Which of the pairs make a forest over the components: each component's best pair, again and again (Boruvka's method)."""
    order = np.argsort(worth, kind="stable")
    left, right = (np.unique(comp, return_inverse=True)[1][x][order] for x in (a, b))
    label, kept = np.arange(int(max(left.max(initial=0), right.max(initial=0))) + 1), []
    live = np.arange(len(order))
    while len(live):
        u, v = label[left[live]], label[right[live]]
        cross = u != v
        live, u, v = live[cross], u[cross], v[cross]
        if not len(live):
            break
        ends = np.empty(2 * len(live), dtype=np.int64)
        ends[0::2], ends[1::2] = u, v
        best = np.unique(np.unique(ends, return_index=True)[1] // 2)
        kept.append(live[best])
        node, root = _forest(u[best], v[best])
        move = np.arange(len(label))
        move[node] = root
        label = move[label]
    return order[np.concatenate(kept)] if kept else np.zeros(0, np.int64)


def compare_blocks(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of different components within the Hamming bound, or in each comparison a ``forest`` of those whose difference, as their sketches let expect it, allows a link.

    ``members`` has key, block (of comparison), side, node, n, component, sketch; rows of one comparison are together and hold at most :data:`BLOCK` nodes a side.
    """

    def compare(side: np.ndarray, node: np.ndarray, n: np.ndarray, comp: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, ...]:
        left = np.flatnonzero(side != 2)
        right = np.flatnonzero(side != 1)
        found_a, found_b, worth = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        rows, bits = max(1, (1 << 21) // max(1, len(right) * sketch.shape[1])), 64.0 * sketch.shape[1]
        for at in range(0, len(left), rows):
            part = left[at : at + rows]
            distance = np.bitwise_count(sketch[part, None, :] ^ sketch[None, right, :]).sum(axis=2, dtype=np.int64)
            both = n[part, None] + n[None, right]
            fits = (distance * (100 + percent) <= both * (100 - percent)) & (comp[part, None] != comp[None, right])
            fits &= np.minimum(n[part, None], n[None, right]) * 100 >= np.maximum(n[part, None], n[None, right]) * percent
            i, j = np.nonzero(fits)
            if forest:
                likely = -bits / 2 * np.log(np.maximum(1e-9, 1 - 2 * distance[i, j] / bits)) / both[i, j]
                i, j, likely = (x[likely * (100 + percent) <= 100 - percent] for x in (i, j, likely))
                worth.append(likely)
            found_a.append(part[i])
            found_b.append(right[j])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if forest:
            kept = likely_forest(comp, a, b, np.concatenate(worth))
            a, b = a[kept], b[kept]
        a, b = np.where(node[a] < node[b], a, b), np.where(node[a] < node[b], b, a)
        return node[a], node[b], n[a], n[b]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()

        def groups(table: pa.Table, final: bool) -> tuple[list[tuple[np.ndarray, ...]], pa.Table]:
            table = table.combine_chunks()
            key, block = table["key"].to_numpy(), table["block"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])) if len(key) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(key))
            whole = len(cuts) if final else len(cuts) - 1
            out = []
            named = {c: table[c].to_numpy() for c in ("side", "node", "n", "component")}
            lists = table["sketch"].chunk(0) if table.num_rows else None
            for first, last in zip(cuts[:whole].tolist(), ends[:whole].tolist(), strict=True):
                if last - first > 1 and len(np.unique(named["component"][first:last])) > 1:
                    own = lists.slice(first, last - first).flatten().to_numpy().view(np.uint64).reshape(last - first, -1)
                    out.append(compare(*[named[c][first:last] for c in ("side", "node", "n", "component")], own))
            return out, table.slice(int(cuts[whole]) if whole < len(cuts) else table.num_rows)

        def fresh(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            for columns_ in found:
                if len(seen) > SEEN_PAIRS:
                    seen.clear()
                before = len(seen)
                rows = [r for r in zip(*(c.tolist() for c in columns_), strict=True) if r[:2] not in seen and not seen.add(r[:2])]
                if len(seen) > before:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["a", "b", "n_a", "n_b"])

        for batch in batches:
            waiting.append(batch)
            found, rest = groups(pa.Table.from_batches(waiting), False)
            waiting = rest.to_batches()
            yield from fresh(found)
        if waiting:
            yield from fresh(groups(pa.Table.from_batches(waiting), True)[0])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = members.repartition(n, "key", "block").sortWithinPartitions("key", "block")
    return placed.mapInArrow(compared, "a long, b long, n_a long, n_b long").distinct()


def mixed_blocks(members: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, dealt to comparisons of blocks."""
    found = written(members.join(groups, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component")), "found")
    who = [F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(20,0)")).alias(f"who{k}") for k in (1, 2)]
    mixed = found.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("node").alias("first"), F.max("node").alias("last"), F.min("band").alias("band"), *who, F.count(F.lit(1)).alias("size")).where("c1 <> c2")
    # buckets of the same nodes are compared once
    mixed = mixed.groupBy("who1", "who2", "first", "last", "band", "size").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    dealt = found.join(mixed, "key").select("key", "band", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("key", "band", "node", "component", (low.cast("long") * (1 << 31) + high).alias("block"), side.cast("int").alias("side"))
    sketch = F.when(F.col("own_band") == F.col("band"), F.col("sketch")).otherwise(F.col("sketch_below"))
    dealt = written(dealt.join(nodes.select("node", "n", F.col("band").alias("own_band"), "sketch", "sketch_below"), "node").select("key", "block", "side", "node", "n", "component", sketch.alias("sketch")), "dealt")
    discard(found)
    return dealt


def linked_sets(docs: DataFrame, percent: int, width: int, id_col: str, text_col: str, also: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: the documents (doc_id, h1, h2, n, node; node is null for an empty set), the nodes (node, low: the smallest doc_id), and (node, component) for nodes with links.

    Documents without doc_id take part if ``also``.
    """
    small_batches(docs.sparkSession)
    made = written(features(docs, id_col, text_col, percent, width), "features")
    digest = ["n", "d1", "d2"]
    each = made.where("n > 0" if also else "n > 0 and doc_id is not null")
    # copies are summed up before they move: a group of them is one row of each task
    lists = [F.first(c).alias(c) for c in ("band", "sketch", "keys", "sketch_below", "keys_below")]
    equal = each.groupBy(*digest).agg(F.min("doc_id").alias("low"), F.min(F.struct("h1", "h2")).alias("h"), *lists)
    nodes = written(equal.select(F.monotonically_increasing_id().alias("node"), *digest, "low", "h.h1", "h.h2", "band", "sketch", "keys", "sketch_below", "keys_below"), "nodes")
    main = made.select("doc_id", "h1", "h2", *digest).join(nodes.select("node", *digest), digest, "left")
    main = written(main.select("doc_id", "h1", "h2", "n", F.when(F.lit(also) | F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "main")
    discard(made)

    words = nodes.select("node", "band", F.explode("keys").alias("key")).unionByName(nodes.select("node", (F.col("band") - 1).alias("band"), F.explode("keys_below").alias("key")))
    shared = words.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high"), F.min("band").alias("band")).where("low <> high")
    shared = written(shared, "shared")
    crowded = shared.where("size > 2").select("key", "low", "size")
    members = written(words.join(crowded, "key"), "members")
    pairs = shared.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b"), "band")
    stars = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"), "band")
    candidates = written(within_bound(pairs.unionByName(stars).distinct(), nodes, percent).distinct(), "candidates")
    discard(shared)
    links = exact_links(candidates, nodes, docs, text_col, percent, width)
    groups = connected_components(links)
    discard(candidates, links)
    forests = FORESTS
    while True:
        dealt = mixed_blocks(members, nodes, groups)
        more = written(compare_blocks(dealt, percent, forests > 0), "more")
        some = more.limit(1).count() > 0
        if some:
            links = exact_links(more, nodes, docs, text_col, percent, width)
            some = links.limit(1).count() > 0
            if some:
                groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        discard(dealt, more)
        if not forests:
            break
        forests = forests - 1 if some else 0  # without a new link the next round offers everything
    discard(members)
    names = written(nodes.select("node", "low"), "names")
    discard(nodes)
    return main, names, groups


def named_groups(main: DataFrame, names: DataFrame, linked: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``main``, named by the smallest doc_id; texts of one doc_id are one group."""
    several = main.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b <> high").select("doc_id", "b")
    several = main.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")
    if several.limit(1).count():
        linked = connected_components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(several))
    lowest = names.join(linked, "node").groupBy("component").agg(F.min("low").alias("component_id"))
    # nodes without a link have no component, and would meet in the task of null
    called = linked.join(lowest, "component").select("node", "component_id")
    named = names.join(called, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
    out = main.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, width: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see the module."""
    return named_groups(*linked_sets(docs, percent, width, id_col, text_col))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """One document of each group of links stays: the one with the smallest doc_id (null comes last), among texts of one id by the text's hash; all of its columns are kept.

    Documents without words stay. Rows that repeat both id and text are one document; the one whose row has the smallest digest stays. Rows that share an id but not a group all stay.
    """
    main, names, linked = linked_sets(docs, percent, width, id_col, text_col, also=True)
    discard(names)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    rows = main.where("node is not null").join(linked, "node", "left").select(F.coalesce("component", "node").alias("component"), row.alias("row"))
    first = rows.groupBy("component").agg(F.min("row").alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    others = written(rows.join(first, "component").select("row", (F.col("row") == F.col("best")).alias("stays")), "copies")
    taken = docs.columns
    h1, h2, none, own = (free_name(c, taken) for c in ("h1", "h2", "none", "own_id"))
    keys = [c.alias(n) for c, n in zip(text_hashes(columns([text_col])[0]), (h1, h2), strict=True)]
    doc_id = columns([id_col])[0].cast("long")
    marked = docs.select(*columns(taken), *keys, doc_id.isNull().alias(none), F.coalesce(doc_id, F.lit(0)).alias(own))
    key = [F.col("row.none").alias(none), F.coalesce("row.doc_id", F.lit(0)).alias(own), F.col("row.h1").alias(h1), F.col("row.h2").alias(h2)]
    kept = marked.join(others.where("not stays").select(*key).distinct(), [none, own, h1, h2], "left_anti")
    again = others.where("stays").select(*key).groupBy(none, own, h1, h2).count().where("count > 1").drop("count")
    if again.limit(1).count():  # rows that repeat id and text
        # by a digest of the row, as columns of some types don't sort
        order = Window.partitionBy(none, own, h1, h2).orderBy(F.md5(F.to_json(F.struct(*columns(taken))).cast("binary")))
        place = free_name("place", kept.columns)
        one = kept.join(again, [none, own, h1, h2], "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
        kept = kept.join(again, [none, own, h1, h2], "left_anti").unionByName(one)
    return kept.select(*columns(taken))
