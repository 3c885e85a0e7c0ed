"""Katz backoff model: Good-Turing discounted n-gram counts with exactly normalised backoff weights, evaluated recursively per token.

A text's tokens are its words and one end; each token is scored given the ORDER - 1 tokens before it (start marks before the first). With h' for
the history h less its oldest token:

    P(w | h) = d(c(h,w)) c(h,w) / c(h)            if c(h,w) > 0
             = alpha(h) P(w | h')                  else;  alpha(h) = (1 - sum of seen P(w | h)) / (1 - sum of seen P(w | h')),  1 if c(h) = 0
    P(w)     = d(c(w)) c(w) / N                    if c(w) > 0, and what is left is the probability of the unknown word

The discounts d of each order are Katz's for counts up to K and subtract a constant beyond, so every seen history keeps mass for backoff. Counts
and sums are of all training documents; nothing is pruned.

Documents are read in blocks of BLOCK_BYTES of text. A block's distinct n-grams of each order, as sorted 64-bit digests with training counts, are
dealt to key ranges as packed arrays; each range merges the arrays of all blocks into its part of the count tables and answers
each block with the counts of its keys, in key order (and whether the block owns a key, so that each seen n-gram is summed once, and whether
no other block has it). The answers are
a partitioned table in the shared folder. Blocks then score what is seen, and back off by themselves behind histories that no other block has; of the rest they deal the seen sums of each history and the backoffs of each
(document, history) to partitions by history, which normalise alpha and return to each block the rest of its documents' scores. Keys are spread by hash and
a key comes once from each block, so no key is hot; there is a range for each PART_BYTES of input, and a task takes its ranges one by one, so its
memory doesn't grow with the input. The two reads of docs are held against each other: blocks are named by what is in them, and one
that the second read gives otherwise raises.

Null and empty texts are one end token. Repeated rows are counted and scored each. A null doc_id counts as empty text (training). Very long texts
are blocks of their own. An empty table gives an empty result; with no training tokens every word is unknown, of probability 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bound_arrow, materialise

BLOCK_BYTES, PART_BYTES = 6 << 20, 6 << 20
K = 5
FOLDS, HELD = 5, 1
#: Digests of the two marks; no word holds a space.
END_KEY, START_KEY = xxhash.xxh64_intdigest(b" end"), xxhash.xxh64_intdigest(b" start")
#: Length of the longest n-grams.
ORDER = 3
#: Partitions of an exchange at most; beyond them a partition has several key ranges or blocks.
MOST_PARTS = 20_000
#: Bits of an answer below the count.
OWNED, ALONE = 1, 2
#: Kind of the rows that hold a block's dump; kinds below are the n-grams' orders.
DUMP = 99
_ROW_BYTES = 1 << 20


def pack(values: np.ndarray) -> bytes:
    """Byte planes of an array under zstd."""
    a = np.ascontiguousarray(values)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a.view(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.zeros(1, keys.dtype)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a key: equal ranges of the key space, so sorted keys have sorted partitions."""
    return ((keys >> np.uint64(33)) * np.uint64(parts) >> np.uint64(31)).astype(np.int64)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (w + np.uint64(0x7F4A7C159E3779B9))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def is_held(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


@dataclass
class Grams:
    """A block's distinct n-grams of one order."""

    keys: np.ndarray  # digests
    train: np.ndarray  # training counts within the block
    at: np.ndarray  # of each token, the n-gram that it ends
    history: np.ndarray  # the n-gram of the order below that stands before the last word
    word: np.ndarray  # the last word
    shorter: np.ndarray  # the n-gram of the order below that ends alike

    def __post_init__(self) -> None:
        self.order = np.argsort(self.keys).astype(np.int32)


def start_key(order: int) -> int:
    """Digest of so many start marks."""
    key = np.array([START_KEY], np.uint64)
    for _ in range(1, order):
        key = pair_keys(key, np.array([START_KEY], np.uint64))
    return int(key[0])


@dataclass
class Block:
    """Some documents as numbers of the block's own words; the last two words are the end and the start mark."""

    src: int
    ids: pa.Array
    held: np.ndarray
    ends: np.ndarray  # position behind each document's end token
    tokens: np.ndarray
    words: np.ndarray  # digests

    @classmethod
    def read(cls, place: tuple[int, int], ids: pa.Array, texts: pa.Array) -> Block:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
        flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
        some = pc.binary_length(flat).to_numpy() > 0
        owner = np.repeat(np.arange(len(lists)), sizes)[some]
        coded = flat.filter(pa.array(some)).dictionary_encode()
        local = coded.indices.to_numpy().astype(np.int32)
        words = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        ends = np.cumsum(np.bincount(owner, minlength=len(lists)) + 1)
        tokens = np.full(int(ends[-1]) if len(ends) else 0, len(words), np.int32)
        tokens[np.arange(len(local)) + owner] = local
        held = np.fromiter(map(is_held, ids.to_pylist()), bool, len(ids))
        digest = xxhash.xxh3_64(repr((place, ids.to_pylist())).encode())
        for x in (ends, tokens, words):
            digest.update(np.ascontiguousarray(x).tobytes())
        return cls(digest.intdigest() >> 1, ids, held, ends, tokens, np.r_[words, np.array([END_KEY, START_KEY], np.uint64)])

    def derive(self, order: int) -> None:
        """N-grams of each order with their training counts. The last of an order is that of start marks only, which is but a history."""
        n = len(self.words)
        sizes = np.diff(self.ends, prepend=0)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        first = np.r_[0, self.ends[:-1]] if len(self.ends) else np.zeros(0, np.int64)
        training, documents = ~self.held[self.owner], int((~self.held).sum())
        counts = np.bincount(self.tokens[training], minlength=n)
        counts[n - 1] = documents
        none = np.zeros(n, np.int32)
        self.grams = [Grams(self.words, counts, self.tokens, none, np.arange(n), none)]
        for _ in range(1, order):
            low = self.grams[-1]
            history = np.empty(len(self.tokens), np.int64)
            history[1:] = low.at[:-1]
            history[first] = len(low.keys) - 1
            codes, where, at = np.unique(history * n + self.tokens, return_index=True, return_inverse=True)
            del history
            codes = np.r_[codes, (len(low.keys) - 1) * n + n - 1]
            h, w = (codes // n).astype(np.int32), (codes % n).astype(np.int32)
            at, codes = at.astype(np.int32), codes[:1]
            counts = np.bincount(at[training], minlength=len(h))
            counts[-1] = documents
            self.grams.append(Grams(pair_keys(low.keys[h], self.words[w]), counts, at, h, w, np.r_[low.at[where], np.int32(len(low.keys) - 1)]))

    def requests(self, parts: int) -> Iterator[tuple]:
        for kind, grams in enumerate(self.grams):
            keys, counts = grams.keys[grams.order], grams.train[grams.order]
            part = part_of(keys, parts)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(keys)]):
                yield self.src, kind, int(part[a]), pack_sorted(keys[a:z]), pack(counts[a:z].astype(np.uint32))

    def dump(self) -> bytes:
        numbers = [self.held.astype(np.uint8), self.ends.astype(np.int64), self.tokens.astype(np.int32), self.words]
        return _to_bytes(pa.record_batch([pa.array([self.ids], pa.list_(self.ids.type)), *(pa.array([pack(x)], pa.binary()) for x in numbers)], list("abcde")))

    @classmethod
    def load(cls, src: int, data: bytes) -> Block:
        batch = _from_bytes(data)
        held, ends, tokens, words = (unpack(batch.column(i)[0].as_py(), t) for i, t in ((1, np.uint8), (2, np.int64), (3, np.int32), (4, np.uint64)))
        return cls(src, batch.column(0)[0].values, held.astype(bool), ends, tokens, words)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of a task's documents; named alike whenever the same input partition is read."""
    place, n, held, size = 0, 0, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        place = b.column(2)[0].as_py()
        ends = np.cumsum(np.nan_to_num(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.float64))).astype(np.int64)
        at = 0
        while at < b.num_rows:  # an Arrow batch may hold several blocks
            done = int(ends[at - 1]) if at else 0
            upto = max(int(np.searchsorted(ends, done + BLOCK_BYTES - size, side="right")), at + 1)
            held.append(b.slice(at, upto - at))
            size += int(ends[upto - 1]) - done
            at = upto
            if size >= BLOCK_BYTES or at < b.num_rows:
                yield Block.read((place, n), *_columns(held))
                n, held, size = n + 1, [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield Block.read((place, n), *_columns(held))


def _columns(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    whole = pa.Table.from_batches(batches)
    return whole.column(0).combine_chunks(), whole.column(1).combine_chunks()


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= most or size >= _ROW_BYTES * 8:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _fields(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_REQUEST = _fields(src=pa.int64(), kind=pa.int32(), part=pa.int32(), keys=pa.binary(), vals=pa.binary())
_ANSWER = _fields(src=pa.int64(), kind=pa.int32(), part=pa.int32(), vals=pa.binary(), stats=pa.list_(pa.int64()))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key range and order: of each range of each order's count table, answers to the blocks, and its counts of counts."""

    def answers() -> Iterator[tuple]:
        now, rows = None, []
        for b in batches:
            for src, kind, part, keys, vals in zip(*(c.to_pylist() for c in b.columns)):
                if rows and (kind, part) != now:
                    yield from _merged(*now, rows)
                    rows = []
                now = kind, part
                rows.append((src, keys, vals))
        if rows:
            yield from _merged(*now, rows)

    yield from _batches(answers(), _ANSWER)


def _merged(kind: int, part: int, rows: list[tuple]) -> Iterator[tuple]:
    rows.sort()
    keys = [unpack_sorted(r[1]) for r in rows]
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    train = np.concatenate([unpack(r[2], np.uint32) for r in rows]).astype(np.int64)
    distinct, place = np.unique(keys, return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, place, train)
    seen = np.flatnonzero(train)
    _, first = np.unique(place[seen], return_index=True)
    value = counts[place] << 2
    value[seen[first]] |= OWNED
    value |= np.where(np.bincount(place)[place] == 1, ALONE, 0)
    at = 0
    for (src, _, _), n in zip(rows, sizes):
        yield src, kind, part, pack(value[at : at + n].astype(np.uint64)), None
        at += n
    counts = counts[distinct != np.uint64(start_key(kind + 1))]
    yield -1, kind, part, None, [int(counts.sum()), int((counts > 0).sum()), *(int((counts == r).sum()) for r in range(1, K + 2))]


def discounts(n: list[int]) -> np.ndarray:
    """Ratios d(r) for r = 0..K from the counts of counts n[0] = n1, ..., n[K] = n(K+1); absolute where Good-Turing gives none in (0, 1)."""
    absolute = min(max(n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5, 0.1), 0.9)
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    out = [1.0]
    for r in range(1, K + 1):
        ratio = ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        out.append(ratio if 0 < ratio < 1 else (r - absolute) / r)
    return np.array(out)


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts: by ratio up to K, less a constant beyond."""
    c = counts.astype(np.float64)
    return np.where(counts <= K, d[np.minimum(counts, K)] * c, c - K * (1 - d[K]))


@dataclass
class Totals:
    """What every task knows of the model."""

    n: int
    v: int
    ratios: list[np.ndarray]  # of each order
    unknown: float

    @classmethod
    def of(cls, stats: list[list[int]]) -> Totals:
        n, v, *of_words = stats[0]
        ratios = [discounts(x[2:]) for x in stats]
        low = sum(r * (1 - ratios[0][r]) * of_words[r - 1] for r in range(1, K + 1))
        more = v - sum(of_words[:K])
        return cls(n, v, ratios, (low + more * K * (1 - ratios[0][K])) / n if n else 1.0)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.ratios[0]) / max(self.n, 1), self.unknown)


#: Kinds of rows behind scoring: a history's seen sums, backoffs asked for, a block's documents, a block's backoffs.
SEEN, ASKED, DOCS, REPLY = 0, 1, 2, 3
_MESSAGE = _fields(src=pa.int64(), kind=pa.int32(), part=pa.int32(), keys=pa.binary(), v0=pa.binary(), v1=pa.binary(), v2=pa.binary())
_REPLY = _fields(src=pa.int64(), kind=pa.int32(), part=pa.int32(), keys=pa.binary(), v0=pa.binary())


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _score(batches: Iterator[pa.RecordBatch], totals: Totals, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of one block after another, its answers first, then its dump: documents with what is seen scored, and messages by history."""

    def blocks() -> Iterator[tuple[Block, list[np.ndarray]]]:
        now, answers, dump = None, {}, []

        def finish():
            if not dump or not answers:
                raise RuntimeError("documents were read otherwise the second time: store them first")
            block = Block.load(now, b"".join(x for _, x in sorted(dump)))
            block.derive(len(totals.ratios))
            values = []
            for kind, grams in enumerate(block.grams):
                value = np.empty(len(grams.keys), np.int64)
                value[grams.order] = np.concatenate([unpack(x, np.uint64) for _, x in sorted(answers[kind].items())]).astype(np.int64)
                values.append(value)
            return block, values

        for b in batches:
            for src, kind, part, vals in zip(*(b.column(i).to_pylist() for i in range(4))):
                if now is not None and src != now:
                    yield finish()
                    answers, dump = {}, []
                now = src
                if kind == DUMP:
                    dump.append((part, vals))
                else:
                    answers.setdefault(kind, {})[part] = vals
        if now is not None:
            yield finish()

    for block, values in blocks():
        counts, owned, alone = [v >> 2 for v in values], [(v & OWNED).astype(bool) for v in values], [(v & ALONE).astype(bool) for v in values]
        known = totals.unigram(counts[0])  # by n-gram, its probability where it is seen
        with np.errstate(divide="ignore", invalid="ignore"):
            log_p = np.log10(known)[block.tokens]
        add = lambda x: np.bincount(block.owner, weights=x, minlength=len(block.ends))
        c_t = counts[0][block.tokens]
        base = add(np.log10((c_t + 0.5) / (totals.n + 0.5 * (totals.v + 1))))
        histories, sums, ask = [], [[], [], []], []
        at_history = 0  # histories of all orders are numbered on
        for k in range(1, len(counts)):
            grams, c, c_h = block.grams[k], counts[k], counts[k - 1][block.grams[k].history]
            mass = discounted(c, totals.ratios[k])
            # Seen sums of each history, from the n-grams that this block owns; what is seen is seen in every lower order.
            some = np.flatnonzero(owned[k][:-1])
            hist, place = np.unique(grams.history[some], return_inverse=True)
            seen_sums = [np.bincount(place, weights=x[some], minlength=len(hist)) for x in (known[grams.shorter], c - mass, c)]
            own = alone[k - 1][hist]
            alpha = np.zeros(len(block.grams[k - 1].keys))
            alpha[hist[own]] = backoff(*(x[own] for x in seen_sums))
            histories.append(block.grams[k - 1].keys[hist[~own]])
            for out, x in zip(sums, seen_sums):
                out.append(x[~own])
            # The longest seen n-gram tells a token's probability; each longer one whose history is seen asks for a backoff.
            seen = c[grams.at] > 0
            known = mass / np.maximum(c_h, 1)
            before = grams.history[grams.at]
            with np.errstate(divide="ignore"):
                log_p = np.where(seen, np.log10(known)[grams.at], log_p + alpha[before] * alone[k - 1][before])
            back = np.flatnonzero(~seen & (c_h[grams.at] > 0) & ~alone[k - 1][before])
            ask.append((block.owner[back], at_history + before[back]))
            at_history += len(block.grams[k - 1].keys)
        docs = pa.record_batch(
            [block.ids, pa.array(block.held), pa.array(np.diff(block.ends, prepend=0)), pa.array(np.rint(add(c_t > 0)).astype(np.int64)), pa.array(base), pa.array(add(log_p))],
            ["id", "held_out", "n_tokens", "n_known", "base", "score"],
        )
        rows = [(block.src, DOCS, block.src % parts, _to_bytes(docs), None, None, None)]
        messages = []
        if histories:
            sums = [np.concatenate(x) for x in sums]
            messages.append((SEEN, np.concatenate(histories), [sums[0], sums[1], np.rint(sums[2]).astype(np.uint64)]))
            history_keys = np.concatenate([g.keys for g in block.grams[:-1]])
            code, times = np.unique(np.concatenate([o for o, _ in ask]) * at_history + np.concatenate([h for _, h in ask]), return_counts=True)
            messages.append((ASKED, history_keys[code % at_history], [(code // at_history).astype(np.uint32), times.astype(np.uint32)]))
        for kind, keys, values in messages:
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], [v[order] for v in values]
            part = part_of(keys, parts)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(keys)]):
                rows.append((block.src, kind, int(part[a]), pack_sorted(keys[a:z]), *(pack(v[a:z]) for v in values), *[None] * (3 - len(values))))
        yield from _batches(iter(rows), _MESSAGE)


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by history range: documents pass; alpha is normalised and each block's backoffs are returned, summed by document."""

    def replies() -> Iterator[tuple]:
        now, seen, asked = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[2] != now:
                    yield from _backoffs(seen, asked)
                    now, seen, asked = row[2], [], []
                if row[1] == DOCS:
                    yield (*row[:4], None)
                else:
                    (asked if row[1] == ASKED else seen).append((row[0], *row[3:], row[2]))
        yield from _backoffs(seen, asked)

    yield from _batches(replies(), _REPLY)


def backoff(low: np.ndarray, left: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Logarithm of a history's backoff weight: sum of the lower order's probabilities of what is seen, discounted-off counts, counts."""
    return np.log10((left / count) / np.maximum(1 - low, 1e-300))


def _backoffs(seen: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
    if not asked:
        return
    seen.sort(key=lambda r: r[0])
    keys = np.concatenate([unpack_sorted(r[1]) for r in seen])
    hist, place = np.unique(keys, return_inverse=True)
    low, left, count = (np.bincount(place, weights=np.concatenate([unpack(r[i], t) for r in seen]).astype(np.float64), minlength=len(hist)) for i, t in ((2, np.float64), (3, np.float64), (4, np.uint64)))
    alpha = backoff(low, left, count)
    for src, keys, v0, v1, _, part in sorted(asked, key=lambda r: r[0]):
        at = np.searchsorted(hist, unpack_sorted(keys))
        d, place = np.unique(unpack(v0, np.uint32), return_inverse=True)
        yield src, REPLY, part, pack(d), pack(np.bincount(place, weights=unpack(v1, np.uint32) * alpha[at], minlength=len(d)))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block after another, its documents first, then the replies: documents with their whole score."""
    docs, score = None, None
    for b in batches:
        for kind, first, second in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("kind", "keys", "v0"))):
            if kind == DOCS:
                if docs is not None:
                    yield docs.set_column(5, "score", pa.array(score))
                docs = _from_bytes(first)
                score = docs.column(5).to_numpy(zero_copy_only=False).copy()
            else:
                score[unpack(first, np.uint32)] += unpack(second, np.float64)
    if docs is not None:
        yield docs.set_column(5, "score", pa.array(score))


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    """df by key range: neighbouring ranges share a partition where there are more than MOST_PARTS."""
    n = min(parts, MOST_PARTS)
    return df.repartitionById(n, (F.col("part").cast("bigint") * n / parts).cast("int")).sortWithinPartitions("part", "kind")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; order: the longest n-grams, 2 or more.

    docs is read twice and must give the same partitions each time, as a table's scan does; other reads raise.
    """
    spark = docs.sparkSession
    bound_arrow(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("partition"))
    size = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts, by_block = max(least, -(-size // PART_BYTES)), min(max(least, -(-size // (4 * BLOCK_BYTES))), MOST_PARTS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            block.derive(order)
            yield from _batches(block.requests(parts), _REQUEST)

    def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            data = block.dump()
            yield from _batches(((block.src, DUMP, i, data[at : at + _ROW_BYTES], None) for i, at in enumerate(range(0, len(data), _ROW_BYTES))), _ANSWER)

    asked = texts.mapInArrow(ask, "src bigint, kind int, part int, keys binary, vals binary")
    answer = "src bigint, kind int, part int, vals binary, stats array<bigint>"
    answers = materialise(_dealt(asked, parts).mapInArrow(_merge, answer), "katz-counts")
    stats = [[0] * (K + 3) for _ in range(order)]
    for kind, i, n in answers.where("src = -1").select("kind", F.posexplode("stats")).groupBy("kind", "pos").agg(F.sum("col")).collect():
        stats[kind][i] = int(n)
    totals = Totals.of(stats)

    kind = dict(texts.dtypes)["id"]
    together = answers.where("src >= 0").select("src", "kind", "part", "vals").unionByName(texts.mapInArrow(dump, answer).select("src", "kind", "part", "vals"))
    scored = together.repartition(by_block, "src").sortWithinPartitions("src", "kind", "part").mapInArrow(lambda it: _score(it, totals, parts), "src bigint, kind int, part int, keys binary, v0 binary, v1 binary, v2 binary")
    replies = _dealt(scored, parts).mapInArrow(_normalise, "src bigint, kind int, part int, keys binary, v0 binary")
    whole = replies.repartition(by_block, "src").sortWithinPartitions("src", "kind", "part").mapInArrow(_assemble, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double")
    return whole.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(totals.n).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")
