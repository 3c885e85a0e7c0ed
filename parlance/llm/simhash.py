"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of distinct value are dealt by a pigeonhole key (of 4 blocks of bits, two fingerprints at 3 or fewer differing bits share one
block exactly), and in each key's group an index over the Gray-rank order factors shared masked bit patterns into upper nodes. A search goes
down from the top with the differences accumulated so far: a node's residual mask only holds bits that its parents haven't compared, a whole
group is pruned once its accumulated differences pass the radius, and taken whole once even all its open bits can't pass it. Each task
returns a spanning forest, not the pairs; star contraction then joins forests into components. A group above GROUP_LIMIT is dealt again by
blocks of its remaining bits, so no task holds an unbounded group and no link is lost.

Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows have equal fingerprints. A null doc_id never names
a component unless the component has no other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import arrow_map, bound_arrow, exchange, materialise, release, signed, utf8, whole_groups

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints of one pigeonhole group that one task may index; larger groups are dealt again by their remaining bits.
GROUP_LIMIT = 50_000
FANOUT = 8
#: Frontier entries held at once in a search.
FRONTIER = 1 << 20
_BITS_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a whole text: A-Z lowered, ASCII white space splits words, XXH64 of each shingle, strict majority of each bit."""
    words = text.lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    n, k = len(words), min(words_per_shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(norm[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, n - k + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS_AT_ONCE):
        part = hashes[at : at + _BITS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp bigint) of every row; narrow, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, words_per_shingle) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(signed(fps))], ["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp bigint")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index of fingerprints, sorted by (group, Gray rank); nodes never span groups.

    Level 0 holds the fingerprints; a node of a higher level covers up to FANOUT nodes below, with the mask of the bits that all its
    fingerprints share and their pattern.
    """

    def __init__(self, groups: np.ndarray, fps: np.ndarray):
        order = np.lexsort((gray_rank(fps), groups))
        self.fps, self.groups = fps[order], groups[order]
        full = np.full(len(fps), ~np.uint64(0))
        self.levels = [(self.fps, full, np.arange(len(fps)), self.groups)]  # pattern, mask, first child, group
        while len(self.levels) < 40:
            pattern, mask, _, group = self.levels[-1]
            first_of_group = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
            within = np.arange(len(group)) - np.repeat(first_of_group, np.diff(np.r_[first_of_group, len(group)]))
            if not len(group) or within.max() == 0:
                break
            starts = np.flatnonzero(within % FANOUT == 0)
            ones = np.bitwise_and.reduceat(pattern & mask, starts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
            self.levels.append((ones, ones | zeros, starts, group[starts]))

    def _children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children in level-1 of each node, as (index into nodes, child)."""
        starts = self.levels[level][2]
        ends = np.r_[starts[1:], len(self.levels[level - 1][0])]
        count = ends[nodes] - starts[nodes]
        owner = np.repeat(np.arange(len(nodes)), count)
        child = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[nodes], count)
        return owner, child

    def _leaf_first(self, level: int, nodes: np.ndarray) -> np.ndarray:
        for k in range(level, 0, -1):
            nodes = self.levels[k][2][nodes]
        return nodes

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs whose union spans every link of at most radius bits inside a group."""
        yield from self._whole_nodes(radius)
        yield from self._search(radius)

    def _whole_nodes(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for level in range(1, len(self.levels)):  # a node whose open bits can't pass the radius is one component
            _, mask, starts, _ = self.levels[level]
            whole = np.flatnonzero(np.bitwise_count(~mask) <= radius)
            owner, child = self._children(level, whole)
            yield self._leaf_first(level, whole)[owner], self._leaf_first(level - 1, child)

    def _search(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs within the radius, each from its later end; one pair stands for a node that lies within as a whole."""
        top = len(self.levels) - 1
        roots = self.levels[top][3]
        root_of = np.searchsorted(roots, self.groups)
        size = max(1, FRONTIER // 64)
        for at in range(0, len(self.fps), size):
            query = np.arange(at, min(at + size, len(self.fps)))
            yield from self._down(query, root_of[query], np.zeros(len(query), np.int64), np.zeros(len(query), np.uint64), top, radius)

    def _down(self, query, node, acc, seen, level, radius):
        """seen: bits already compared on the way to the node; acc: differences among them."""
        if len(query) > FRONTIER and level < len(self.levels) - 1:
            for at in range(0, len(query), FRONTIER):
                part = slice(at, at + FRONTIER)
                yield from self._down(query[part], node[part], acc[part], seen[part], level, radius)
            return
        pattern, mask, _, _ = self.levels[level]
        acc = acc + np.bitwise_count((self.fps[query] ^ pattern[node]) & mask[node] & ~seen)
        whole = acc + np.bitwise_count(~mask[node]) <= radius
        if level == 0:
            whole &= node < query
        if whole.any():
            yield query[whole], self._leaf_first(level, node[whole])
        keep = (acc <= radius) & ~whole
        if level and keep.any():
            query, node, acc = query[keep], node[keep], acc[keep]
            owner, child = self._children(level, node)
            first = self._leaf_first(level - 1, child) < query[owner]  # a link is found from its later end
            owner, child = owner[first], child[first]
            yield from self._down(query[owner], child, acc[owner], mask[node][owner], level - 1, radius)


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component label (smallest index) of n items under the given links."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            if (open_ := la != lb).any():
                a, b = a[open_], b[open_]
                low, high = np.minimum(la, lb)[open_], np.maximum(la, lb)[open_]
                np.minimum.at(label, high, low)
            else:
                break
            while not np.array_equal(up := label[label], label):
                label = up
    return label


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in whole_groups(batches, GROUP_LIMIT):
        index = GrayIndex(part.column("key").to_numpy(), part.column("fp").to_numpy().view(np.uint64))
        label = spanning(len(index.fps), index.links(RADIUS))
        child = np.flatnonzero(label != np.arange(len(label)))
        if len(child):
            yield pa.record_batch([pa.array(signed(index.fps[child])), pa.array(signed(index.fps[label[child]]))], ["u", "v"])


def _bits(column, bits: list[int]):
    """Integer of the given bits of a bigint column; runs of adjacent bits are moved at once."""
    out, at, k = None, 0, 0
    while k < len(bits):
        n = 1
        while k + n < len(bits) and bits[k + n] == bits[k] + n:
            n += 1
        piece = F.shiftleft(F.shiftrightunsigned(column, bits[k]).bitwiseAND(F.lit((1 << n) - 1)), at)
        out, at, k = piece if out is None else out.bitwiseOR(piece), at + n, k + n
    return out


def forests(fps: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(u, v) spanning forests over distinct fingerprints fps(fp): u and v are linked, every link's ends are connected."""
    bound_arrow(fps.sparkSession)
    whole, rows = list(range(64)), 4 * fps.count()
    keyed = [(whole, fps.select(F.lit(0).cast("bigint").alias("path"), "fp"))]
    found = None
    while keyed:
        free, df = keyed.pop()
        cut = [len(free) * k // 4 for k in range(5)]
        blocks = [free[a:b] for a, b in zip(cut, cut[1:]) if b > a]
        pieces = F.array(*[F.struct(F.lit(j).alias("j"), F.xxhash64("path", F.lit(j), _bits(F.col("fp"), bits)).alias("key")) for j, bits in enumerate(blocks)])
        dealt = df.select("fp", F.explode(pieces).alias("x")).select("x.key", "fp", "x.j")
        large = materialise(dealt.groupBy("j", "key").count().where(F.col("count") > group_limit).select("j", "key"), "simhash-large")
        hot = {r[0] for r in large.select("j").distinct().collect()}  # at most 4 numbers
        rest = dealt.join(large, ["j", "key"], "left_anti") if hot else dealt
        forest = exchange(rest.select("key", "fp"), rows, "key").sortWithinPartitions("key").mapInArrow(_forest, "u bigint, v bigint")
        found = forest if found is None else found.unionByName(forest)
        for j in hot if len(free) > 4 else ():
            again = dealt.where(F.col("j") == j).join(large, ["j", "key"], "left_semi")
            keyed.append(([b for b in free if b not in blocks[j]], again.select(F.col("key").alias("path"), "fp")))
    return found


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, root) for every node with an edge, root being the smallest of its component: alternating large-star and small-star contraction.

    Each round is materialised in the shared folder. Hubs are reduced by partial minima and skew-split joins, never gathered.
    """
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "components")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, edges = edges.stored_at, materialise(small.where("u <> v").distinct(), "components")
        release(edges.sparkSession, before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components didn't settle")
    return edges.select("u", F.col("v").alias("root"))


def groups(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Of prints(id, fp, ...): (fp, component) with the smallest id reachable from each distinct fingerprint."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = components(forests(distinct.select("fp"), group_limit))
    rooted = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    return rooted.join(lows, "root").select("fp", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs."""
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash")
    return prints.join(groups(prints, group_limit), "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: The pipeline's near-duplicates: five-word shingles at a Jaccard similarity of 0.8 or more.
SIMILAR_WORDS, SIMILARITY = 5, 0.8
#: Documents whose shingles tell which are common, and the number of common ones that are told to all tasks. They only set the order.
ORDER_DOCS, COMMON = 20_000, 1 << 18
#: Holders of one shingle in a part; those of a more common one are compared by pairs of parts, each in a task's group of its own.
PART = 500
#: Pairs of sketches compared at once.
_PAIRS_AT_ONCE = 1 << 14
#: Entries of whole groups that a task compares at a time.
_ENTRIES_AT_ONCE = 20_000
#: Documents of the sample that hold a shingle from which on it may be hot: its holders are counted apart and never meet in one task.
HOT = 20


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    x = h + np.uint64(0x9E3779B97F4A7C15 * lane % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], k: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (fewer words: one of all)."""
    k = min(k, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1)) if words else np.zeros(0, np.uint64)


def prefix(shingles: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """So many of a set's shingles, rarest first, that two sets of SIMILARITY share one of them. common is sorted; others count as rare."""
    if not len(shingles):
        return shingles
    weight = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weight = np.where(common[at] == shingles, times[at], 0)
    least = int(np.ceil(SIMILARITY * len(shingles) - 1e-9))
    return shingles[np.lexsort((shingles, weight))[: len(shingles) - least + 1]]


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each of 256 classes, 255 at most."""
    return np.minimum(np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def alike(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b shingles that share so many reach SIMILARITY."""
    return both >= SIMILARITY * (a + b - both)


def _shared(tokens: DataFrame, hot: np.ndarray) -> DataFrame:
    """(token, uid, parts): the holders of each shingle that several have, and the number of parts they make. hot: shingles whose holders aren't gathered."""
    spark = tokens.sparkSession
    parts = F.ceil(F.col("count") / PART).cast("bigint").alias("parts")
    known = spark.createDataFrame([(int(x),) for x in signed(hot)], "token bigint")  # no more than the sample's common ones
    often = tokens.join(F.broadcast(known), "token", "left_semi")
    counts = often.groupBy("token").count().where("count > 1").select("token", parts)
    rest = tokens.join(F.broadcast(known), "token", "left_anti").withColumn("count", F.count("*").over(Window.partitionBy("token"))).where("count > 1").select("token", "uid", parts)
    return rest.unionByName(often.join(F.broadcast(counts), "token").select("token", "uid", "parts"))


def _dealt(b: pa.RecordBatch) -> pa.RecordBatch:
    """Holders to the group of their shingle, or to those of each pair of parts that has their own."""
    token, uid, parts = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
    own = _mixed(uid, 1) % parts
    each = np.maximum(parts.astype(np.int64) - 1, 1)
    row = np.repeat(np.arange(len(uid)), each)
    other = (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)).astype(np.uint64)
    mine = own[row]
    other += (other >= mine) & (parts[row] > 1)
    key = _mixed(_mixed(token[row], 1) ^ (np.minimum(mine, other) << np.uint64(32) | np.maximum(mine, other)), 2)
    rest = b.select(["uid", "n", "sketch", "root"]).take(pa.array(row))
    return pa.record_batch([pa.array(signed(key)), *rest.columns], ["key", "uid", "n", "sketch", "root"])


def _proposed(nearest: bool):
    """Pairs of a group that may reach SIMILARITY and aren't joined yet: all, or of each entry the one with the likest earlier entry.

    The classes of two sketches bound what the sets can share, so no pair that reaches it is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for part in whole_groups(batches, _ENTRIES_AT_ONCE):
            key, uid, n, root = (part.column(i).to_numpy() for i in (0, 1, 2, 4))
            classes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(-1, 256)
            order = np.lexsort((uid, key))
            key, uid, n, root, classes = key[order], uid[order], n[order], root[order], classes[order]
            lost = n - classes.sum(axis=1, dtype=np.int64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for first, end in zip(starts.tolist(), np.r_[starts[1:], len(key)].tolist()):
                size = max(1, _PAIRS_AT_ONCE // (end - first))
                for at in range(first, end, size):
                    a = np.arange(at, min(at + size, end))[:, None]
                    b = np.arange(first, a[-1, 0] + 1)[None, :]
                    a, b = (x[(b < a) & (root[a] != root[b]) & alike(np.minimum(n[a], n[b]), n[a], n[b])] for x in np.broadcast_arrays(a, b))
                    both = np.minimum(np.minimum(classes[a], classes[b]).sum(axis=1, dtype=np.int64) + lost[a], np.minimum(n[a], n[b]))
                    some = alike(both, n[a], n[b])
                    a, b, both = a[some], b[some], both[some]
                    if nearest and len(a):
                        by = np.lexsort((-both / (n[a] + n[b]), a))
                        by = by[np.r_[True, a[by][1:] != a[by][:-1]]]
                        a, b = a[by], b[by]
                    found.append((uid[a], uid[b]))
                    held += len(a)
                    if held > _PAIRS_AT_ONCE:
                        yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], ["u", "v"])
                        found, held = [], 0
        if held:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], ["u", "v"])

    return run


def _proposals(entries: DataFrame, rows: int, nearest: bool) -> DataFrame:
    """(u, v) that may reach SIMILARITY, of the holders of each shingle. rows: how many the holders make once dealt."""
    groups = arrow_map(entries.select("token", "uid", "parts", "n", "sketch", "root"), _dealt, "key bigint, uid bigint, n bigint, sketch binary, root bigint")
    return exchange(groups, 8 * rows, "key").sortWithinPartitions("key").mapInArrow(_proposed(nearest), "u bigint, v bigint")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose exact similarity reaches SIMILARITY. Pairs with an end that shares no rare shingle with any other don't."""
    pairs = materialise(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "similar-pairs")

    def check(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(b.column(2), b.column(3)):
            a, z = x.values.to_numpy(), y.values.to_numpy()
            keep.append(alike(len(np.intersect1d(a, z, assume_unique=True)), len(a), len(z)))
        return b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("uid").alias("u"), F.col("x").alias("a")), sets.select(F.col("uid").alias("v"), F.col("x").alias("b"))
    return arrow_map(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b"), check, "u bigint, v bigint")


def _near_prints(reps: DataFrame) -> DataFrame:
    """(u, v): documents of equal fingerprint with the first of them, and the first ones of fingerprints that the Gray-order index links."""
    first = materialise(reps.groupBy("fp").agg(F.min("uid").alias("low")), "similar-prints")
    equal = reps.join(first, "fp").select(F.col("uid").alias("u"), F.col("low").alias("v"))
    forest = forests(first.select("fp"))
    ends = [first.select(F.col("fp").alias(x), F.col("low").alias(f"{x}_low")) for x in "uv"]
    near = forest.join(ends[0], "u").join(ends[1], "v").select(F.col("u_low").alias("u"), F.col("v_low").alias("v"))
    return equal.unionByName(near)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """A list column of int64 arrays, without going through Python numbers."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that several of a bounded sample of texts hold, and how many do."""
    part = -(-texts.count() // ORDER_DOCS) or 1

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t.lower().split()) for t in utf8(b.column(0))]
        return pa.record_batch([pa.array(signed(np.concatenate(found)))], ["x"])

    sample = arrow_map(texts.where(F.pmod(F.xxhash64("uid"), F.lit(part)) == 0).select("text"), each, "x bigint")
    found = sample.groupBy("x").count().where("count > 1").orderBy(F.desc("count"), "x").limit(COMMON).toArrow()
    x, times = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(x)
    return x[order], times[order]


def similar_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Of docs with a unique number uid: (uid) of one document of each group of like texts, and of every document that has none.

    Exact copies (of the lower-cased words) fall together first. SimHash fingerprints of the others go through the Gray-order index, and what it
    links is checked exactly. As fingerprints at so few differing bits can't tell every pair of SIMILARITY, a search that misses none follows:
    two sets of SIMILARITY share a shingle among the rarest of each (prefix filter), so each shingle's holders are compared, by sketches that
    bound what the sets share, and then exactly. Each holder first proposes the likest earlier one; when these and the index's links have
    joined most, all pairs that are still apart are proposed, so none is left out.
    """
    bound_arrow(docs.sparkSession)
    texts = docs.select("uid", F.col(text_col).alias("text"))
    common, times = common_shingles(texts)

    def sign(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(b.column(1))
        whole, fps, heads = np.zeros((len(texts), 2), np.int64), np.zeros(len(texts), np.uint64), []
        for i, t in enumerate(texts):
            w = t.lower().split()
            whole[i] = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(w)), np.int64)
            shingles = shingle_set(w)
            fps[i] = majority(shingles)
            heads.append(signed(prefix(shingles, common, times)))
        return pa.record_batch([b.column(0), *(pa.array(np.ascontiguousarray(whole[:, i])) for i in (0, 1)), pa.array(signed(fps)), _lists(heads)], ["uid", "c0", "c1", "fp", "head"])

    prints = arrow_map(texts, sign, "uid bigint, c0 bigint, c1 bigint, fp bigint, head array<bigint>")
    reps = materialise(prints.groupBy("c0", "c1").agg(F.min("uid").alias("uid"), F.first("fp").alias("fp"), F.first("head").alias("head")).drop("c0", "c1"), "similar-prefixes")
    shared = materialise(_shared(reps.select(F.explode("head").alias("token"), "uid"), common[times >= HOT]), "similar-shared")
    rows = int(shared.agg(F.sum(F.greatest(F.col("parts") - 1, F.lit(1)))).first()[0] or 0)

    def sets_of(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t.lower().split()) for t in utf8(b.column(1))]
        return pa.record_batch([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([sketch(x) for x in found], pa.binary()), _lists([signed(x) for x in found])], ["uid", "n", "sketch", "x"])

    sets = materialise(arrow_map(texts.join(shared.select("uid").distinct(), "uid", "left_semi"), sets_of, "uid bigint, n bigint, sketch binary, x array<bigint>"), "similar-sets")
    entries = shared.join(sets.select("uid", "n", "sketch"), "uid")
    first = _near_prints(reps.select("uid", "fp")).unionByName(_proposals(entries.withColumn("root", F.col("uid")), rows, True))
    roots = components(_links(first, sets))
    open_ = entries.join(roots.withColumnRenamed("u", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    roots = components(roots.select("u", F.col("root").alias("v")).unionByName(_links(_proposals(open_, rows, False), sets)))
    return reps.select("uid").join(roots.select(F.col("u").alias("uid")), "uid", "left_anti")


def drop_similar(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with one document of each group of like texts, all columns.

    docs is read three times and must give the same partitions each time, as a table's scan does: rows are numbered by partition and place.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("uid", F.monotonically_increasing_id())
    kept = similar_documents(inner, f"c{names.index(text_col)}")
    return inner.join(kept, "uid", "left_semi").drop("uid").toDF(*names)
