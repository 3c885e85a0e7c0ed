"""Exact token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers annotate their transitions with emitted counts.

* The splitter runs over character classes and emits word boundaries (before the current or the previous character, for the look-ahead of
  white space and the rollback of contractions). It has few states, so a text is cut into chunks of equal length, each chunk's map from every
  start state to (end state, words emitted) is computed for all chunks at once, and the maps compose through a parallel prefix scan; with the
  start state of each chunk known, boundaries are emitted.
* The merger runs over the bytes of a word. After each byte the last token of the best merge so far is known: it is the one suffix token that is
  stable behind the last token of what precedes it. A state is the suffix-automaton node with the last tokens and relative counts at the
  positions where a coming token may start; each transition carries the change of the token count. States are determinised on demand and kept in a bounded table;
  whole words that recur are kept as single transitions.

Counts are those of the tokenizer library, without added tokens; strings of special tokens inside a text count as one token each, as its
default has it. Null and empty texts have no tokens. Very long texts and words take time and memory in proportion. Repeated rows are counted
each. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import sys
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers

from parlance.llm.common import arrow_map, utf8

OVER_LIMIT = 1024
CHUNK = 512
#: Bounds of a worker's tables; a full table is emptied and filled anew.
MAX_STATES, MAX_WORDS, MAX_PAIRS, WORD_BYTES = 300_000, 500_000, 400_000, 48

# Character classes and states of the splitter.
LETTER, DIGIT, BLANK, SPACE, APOSTROPHE, OTHER, TAIL, R_OR_V, E, L, END = range(11)
START, WORD, NUMBER, SIGNS, BLANK1, SPACE1, BLANKS, SPACES, QUOTE, QUOTE_RV, QUOTE_L = range(11)
STATES, HERE, BACK = 11, 16, 32  # emission bits above the 4 bits of a state
_LETTERS = (LETTER, TAIL, R_OR_V, E, L)


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and emissions of one splitter transition."""
    if kind == END:
        return START, HERE | (BACK if state in (QUOTE_RV, QUOTE_L) else 0)
    opens = {BLANK: BLANK1, SPACE: SPACE1, APOSTROPHE: QUOTE, OTHER: SIGNS, DIGIT: NUMBER}.get(kind, WORD)
    joins = SIGNS if opens == QUOTE else opens  # behind one blank an apostrophe is a sign like others
    white = kind in (BLANK, SPACE)
    if state == WORD and kind in _LETTERS or state == NUMBER and kind == DIGIT or state == SIGNS and kind in (APOSTROPHE, OTHER):
        return state, 0
    if state in (BLANK1, SPACE1, BLANKS, SPACES) and white:
        return (BLANKS if kind == BLANK else SPACES), 0
    if state == BLANK1:
        return joins, 0
    if state == BLANKS:
        return joins, BACK
    if state == SPACES:
        return opens, BACK | HERE
    if state == QUOTE:
        if kind == TAIL:
            return START, 0
        if kind == R_OR_V:
            return QUOTE_RV, 0
        if kind == L:
            return QUOTE_L, 0
        if kind in (APOSTROPHE, OTHER):
            return SIGNS, 0
    if (state, kind) in ((QUOTE_RV, E), (QUOTE_L, L)):
        return START, 0
    if state in (QUOTE_RV, QUOTE_L):
        then, out = _step(WORD, kind)
        return then, out | BACK
    return opens, HERE


def splitter_table() -> np.ndarray:
    """Flat transition table, indexed by class * 16 + state."""
    out = np.zeros(16 * 16, np.uint8)
    for kind in range(11):
        for state in range(STATES):
            then, emit = _step(state, kind)
            out[kind * 16 + state] = then | emit
    return out


def class_table() -> np.ndarray:
    """Class of every code point. Letters, digits and white space are those of the library's own patterns, so its Unicode version counts, not Python's."""
    points = np.r_[0:0xD800, 0xE000:0x110000]
    every = points.astype(np.uint32).tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", DIGIT), (r"\s", SPACE)):
        marked = normalizers.Replace(Regex(pattern), "\0").normalize_str(every)
        found = np.frombuffer(marked.encode("utf-32-le"), np.uint32) != points
        out[points[found]] = kind
    out[0x20], out[ord("'")] = BLANK, APOSTROPHE
    for letters, kind in (("stmd", TAIL), ("rv", R_OR_V), ("e", E), ("l", L)):
        for x in letters:
            out[ord(x)] = kind
    return out


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Chunk maps first, then `then`: (end states, words emitted), both of shape (chunks, states)."""
    return np.take_along_axis(then[0], first[0], 1), first[1] + np.take_along_axis(then[1], first[0], 1)


def prefix_scan(states: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive scan of chunk maps under composition, in log2(chunks) parallel steps."""
    states, counts, gap = states.copy(), counts.copy(), 1
    while gap < len(states):
        s, c = compose((states[:-gap], counts[:-gap]), (states[gap:], counts[gap:]))
        states[gap:], counts[gap:] = s, c
        gap *= 2
    return states, counts


def _refuse_others(spec: dict) -> None:
    """Raise for a file that asks for what isn't compiled here."""
    first, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and not spec.get("normalizer")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [t["content"] for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if not plain or model.get("type", "BPE") != "BPE" or odd:
        raise ValueError(f"only plain byte-level BPE files can be compiled: {odd or first}")


class Counter:
    """The compiled transducers of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        _refuse_others(spec)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.classes, self.table = class_table(), splitter_table()
        self._compile(spec["model"])
        self.words: dict[bytes, int] = {}

    # The merger.

    def _compile(self, model: dict) -> None:
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
        raw = lambda s: bytes(byte_of[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.token = sorted(tokens, key=lambda t: (len(t), t))
        number = {t: i for i, t in enumerate(self.token)}
        # Trie of the tokens, then failure links: node = longest suffix of the input that begins a token.
        self.goto, self.depth, ends = {}, [0], [-1]
        for t in self.token:
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in self.goto:
                    self.goto[key] = len(self.depth)
                    self.depth.append(self.depth[node] + 1)
                    ends.append(-1)
                node = self.goto[key]
            ends[node] = number[t]
        below: list[list[tuple[int, int]]] = [[] for _ in self.depth]
        for key, child in self.goto.items():
            below[key >> 8].append((key & 255, child))
        self.fail = [0] * len(self.depth)
        self.out, queue = [()] * len(self.depth), deque([0])  # suffix tokens of a node, longest first
        while queue:
            node = queue.popleft()
            for b, child in below[node]:
                if node:
                    at = self.fail[node]
                    while at and (at << 8 | b) not in self.goto:
                        at = self.fail[at]
                    self.fail[child] = self.goto.get(at << 8 | b, 0)
                own = (ends[child],) if ends[child] >= 0 else ()
                self.out[child] = own + self.out[self.fail[child]]
                queue.append(child)
        self.stable: dict[tuple[int, int], bool] = {}
        self.chains: dict[int, tuple[int, ...]] = {}
        self._reset()

    def _reset(self) -> None:
        self.step: dict[int, int] = {}
        self.states: list[tuple] = [(0, (-1,), (0,))]
        self.state_of = {self.states[0]: 0}

    def merge(self, word: bytes) -> list[bytes]:
        """Plain BPE of a word, by rank; the definition that the transducer's stability test rests on."""
        parts, rank = [word[i : i + 1] for i in range(len(word))], self.rank.get
        while len(parts) > 1:
            ranks = [rank(pair, sys.maxsize) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == sys.maxsize:
                break
            i = ranks.index(best)
            pair, out = (parts[i], parts[i + 1]), parts[:i]
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b is stable behind token a."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) >= MAX_PAIRS:
                self.stable.clear()
            x, y = self.token[a], self.token[b]
            found = self.stable[a, b] = self.merge(x + y) == [x, y]
        return found

    def chain(self, node: int) -> tuple[int, ...]:
        """Depths of a node and its suffixes that begin a token: how far back a coming token may start."""
        found = self.chains.get(node)
        if found is None:
            depths, at = [], node
            while at:
                depths.append(self.depth[at])
                at = self.fail[at]
            found = self.chains[node] = (*depths, 0)
        return found

    def _transition(self, state: int, byte: int) -> int:
        """Determinise one transition: next state and count change, packed as state << 8 | change + 128."""
        node, last, counts = self.states[state]
        at = dict(zip(self.chain(node), zip(last, counts)))  # by how far back a position lies
        while node and (node << 8 | byte) not in self.goto:
            node = self.fail[node]
        node = self.goto[node << 8 | byte]
        for t in self.out[node]:
            before, count = at[len(self.token[t]) - 1]
            if before < 0 or self._follows(before, t):
                break
        count += 1
        rest = [at[d - 1] for d in self.chain(node)[:-1]]
        then = node, (*(x for x, _ in rest), t), (*(c - count for _, c in rest), 0)
        number = self.state_of.get(then)
        if number is None:
            number = self.state_of[then] = len(self.states)
            self.states.append(then)
        packed = self.step[state << 8 | byte] = number << 8 | (count + 128)
        return packed

    def word(self, word: bytes) -> int:
        """Tokens of one word: the sum of the counts on the transducer's path."""
        if len(self.states) > MAX_STATES:
            self._reset()
        state, total, get = 0, 0, self.step.get
        for b in word:
            packed = get(state << 8 | b)
            if packed is None:
                packed = self._transition(state, b)
            state = packed >> 8
            total += (packed & 255) - 128
        return total

    def _known(self, word: bytes) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.word(word)
            if len(word) <= WORD_BYTES:
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[word] = n
        return n

    # The splitter.

    def boundaries(self, kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Word starts in a sequence of classes that ends in END."""
        n = len(kinds)
        chunks = -(-n // chunk)
        padded = np.full(chunks * chunk, END, np.uint8)
        padded[:n] = kinds
        lanes = np.ascontiguousarray(padded.reshape(chunks, chunk).T) << 4
        states = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, axis=1)
        counts = np.zeros((STATES, chunks), np.int32)
        for row in lanes:
            got = self.table[row[None, :] | states]
            states = got & 15
            counts += ((got >> 4) & 1) + (got >> 5)
        scanned, _ = prefix_scan(states.T.astype(np.int64), counts.T.astype(np.int64))
        state = np.r_[np.uint8(START), scanned[:-1, START].astype(np.uint8)]
        emitted = np.empty((chunk, chunks), np.uint8)
        for i, row in enumerate(lanes):
            got = self.table[row | state]
            state = got & 15
            emitted[i] = got >> 4
        flat = np.ascontiguousarray(emitted.T).ravel()[:n]
        starts = (flat & 1).astype(bool)
        starts[:-1] |= flat[1:] > 1
        return np.flatnonzero(starts)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without special tokens."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.classes[points]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds[ends] = END
        starts = self.boundaries(kinds)
        wide = np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64))
        offsets = np.r_[np.r_[0, wide][starts], wide[-1]]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())]).dictionary_encode()
        counts = np.fromiter(map(self._known, words.dictionary.to_pylist()), np.int64, len(words.dictionary))[words.indices.to_numpy()]
        counts[np.isin(starts, ends)] = 0  # the end marks themselves
        before = np.r_[0, np.cumsum(counts)]
        place = np.searchsorted(starts, np.r_[0, ends + 1])
        return (before[place[1:]] - before[place[:-1]]).tolist()

    def count_all(self, texts: list[str]) -> list[int]:
        """Tokens of each text; strings of special tokens count as one each."""
        parts, owner, extra = [], [], [0] * len(texts)
        for i, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                if s in text:
                    pieces = [x for p in pieces for x in p.split(s)]
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        for i, n in zip(owner, self.count(parts) if parts else ()):
            extra[i] += n
        return extra


_compiled: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The transducers of a file, compiled once in each worker."""
    if path not in _compiled:
        _compiled[path] = Counter(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, path: str, over: int = OVER_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. path: the tokenizer file, the same on all machines."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(b.column(1))
        n = counter(path).count_all([t.decode("utf-8", "replace") for t in texts])
        return pa.record_batch([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > over for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
