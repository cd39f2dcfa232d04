"""Language-model scores by online logistic context mixing.

A lower-cased text is a sequence of bytes and one end symbol. A prefix code over the corpus's bytes makes each a path of binary choices. Every
choice is predicted by hashed contexts of several orders: the log-odds of the training documents' counts. Predictions are summed under
weights that a gate selects (how far into the code, and how often the word so far was seen) and squashed. The weights start from those that
code all training documents best, where no place counts for itself; while a text is read they move, block by block, down the gradient of its
coding cost; the last order's moves as a multiple of its gated weight. The sum of the choices' costs is the text's bits, a proper code length: all bytes that may follow share a chance of one.

Documents are dealt to buckets by a hash of id and text, as many buckets as the corpus has pieces of BUCKET_BYTES, so a score is a function
of the table and does not follow its partitions. Counting covers all training documents and follows the corpus: buckets send the distinct
(context, byte) pairs that they hold, with their counts, up a tree of ranges (exchange.py), which answers each pair with the counts along its
path over the whole corpus. Context hashes grow by a bit whenever the corpus doubles, so no table fills up; a bucket keeps only its own pairs.
Token counts for the base score go the same way. For the starting weights, buckets count the choices by gate and quantised predictions, and
Spark sums those cells, whose number is fixed by the model; a logistic regression over them is solved in one task.

Defined results: null text counts as empty (its end symbol is scored); null ids are trained on and not held out; ids may be of any type that
Spark hashes; equal texts get equal scores in any company; a very long text is read block by block like any other, and words of over 32 bytes
in pieces; of rows that are equal in id and text, all but the first of a piece of a partition are dealt by their place, so that no bucket
gets them all (with such rows the starting weights may move with the partitions); without training documents every choice is even; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import exchange as X
from skein.llm.knn_quality import remainder
from skein.llm.substring import BYTE_BASE, SPACE, mix

U = np.uint64
END = 255  # never in UTF-8
GAP = SPACE | (np.arange(256) == END)
WORD = 32  # bytes of a word that are read at once
BUCKET_BYTES = 4_000_000
DEALT_BYTES = 32_000_000  # of a partition that are dealt to buckets at once
CELL_BUCKETS = 64  # whose cells meet in one task
AT_ONCE, CELLS_AT_ONCE, PIECES_AT_ONCE = 8_000, 1_000_000, 50_000  # bytes, choices, words or pieces of them
DEPTHS = 5  # choices of a byte with gates of their own
SEEN = np.array([1, 2, 4, 16, 256])  # a gate for each range of counts
GATES = (DEPTHS + 1) * (len(SEEN) + 1)
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # the lowest bytes
POWERS = np.cumprod(np.full(WORD, BYTE_BASE, U))
_UP = [0.25, 0.5, 1, 1.5, 2, 2.5, 3, 4, 5, 6.5, 8]
PREDICTIONS = np.array([*(-x for x in reversed(_UP)), 0, *_UP])  # as which they count for the starting weights
LEVELS = len(PREDICTIONS)


@dataclass(frozen=True)
class Model:
    orders: tuple[int, ...] = (2, 4, 0)  # bytes in front; 0: all bytes of the word so far. The last selects the gate
    prior: float = 0.4
    first_block: int = 64  # bytes
    last_block: int = 1024
    rate: float = 0.015
    together: int = 256  # texts read side by side


@dataclass(frozen=True)
class Code:
    """A prefix code: by byte its length and its place among the leaves; by two places, how many choices their paths share."""

    length: np.ndarray
    place: np.ndarray
    shared: np.ndarray


def prefix_code(counts: np.ndarray) -> Code:
    """Huffman's code of the 256 bytes."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children, n = {}, 256
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        children[n] = (x, y)
        heapq.heappush(heap, (a + b, n, n))
        n += 1
    paths, todo = [], [(heap[0][2], [])]
    while todo:  # depth first, so that the leaves under a node are neighbours
        node, path = todo.pop()
        if node < 256:
            paths.append((node, [*path, node]))
        else:
            todo += [(c, [*path, node]) for c in children[node]]
    length, place = np.zeros(256, np.int64), np.zeros(256, np.int64)
    steps = np.full((256, max(len(p) for _, p in paths)), -1, np.int64)
    for k, (byte, path) in enumerate(paths):
        length[byte], place[byte] = len(path) - 1, k
        steps[k, : len(path)] = path
    shared = np.zeros((256, 256), np.int8)
    for depth in range(steps.shape[1]):
        shared += (steps[:, None, depth] == steps[None, :, depth]) & (steps[:, None, depth] >= 0)
    return Code(length, place, shared - 1)


def _code(n: np.ndarray) -> np.ndarray:
    return np.where(n < 16, n, np.minimum(255, 16 + np.floor(4 * np.log2(np.maximum(n, 1) / 16) + 1e-9))).astype(np.uint8)


CODE_OF = _code(np.arange(1 << 14))


def to_code(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 16, then four a doubling."""
    out = CODE_OF.take(n, mode="clip")
    large = np.flatnonzero(n >= len(CODE_OF))
    out[large] = _code(n[large])
    return out


COUNT_OF = np.concatenate([np.arange(16.0), 16 * 2 ** ((np.arange(240) + 0.5) / 4)]).astype(np.float32)


def find(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys as they come, the place of each key among them): hashes of the keys are sorted with their places as the lowest bits."""
    n = len(key)
    low = U((1 << n.bit_length()) - 1)
    order = mix(key) & ~low | np.arange(n, dtype=U)
    order.sort()
    at = (order & low).astype(np.int64)
    own = key.take(at)
    new = np.ones(n, bool)
    new[1:] = own[1:] != own[:-1]
    heads = np.flatnonzero(new)
    if np.count_nonzero((order[1:] ^ order[:-1]) > low) + 1 != len(heads):  # none at all, or two hashes that differ in the lowest bits alone
        d = pa.array(key).dictionary_encode()
        return d.dictionary.to_numpy(), d.indices.to_numpy()
    lead = at[heads]
    first = np.zeros(n, bool)
    first[lead] = True
    rank = np.cumsum(first, dtype=np.int32) - np.int32(1)
    which = np.empty(n, np.int32)
    which[at] = np.repeat(rank[lead], np.diff(heads, append=n))
    return key[first], which


def leads(which: np.ndarray, n: int) -> np.ndarray:
    """The first place of each of n."""
    out = np.zeros(n, np.int64)
    out[which[::-1]] = np.arange(len(which))[::-1]
    return out


class Stream:
    """Texts (lower-cased bytes), each with its end, as one run of bytes. Bytes that agree in the contexts of all orders are one kind; per
    order, `keys` has the distinct keys (context, byte) and `entry` each kind's."""

    def __init__(self, texts: list[bytes], code: Code, model: Model, context_bits: int):
        padded = bytes(8) + bytes([END]).join([*texts, b""]) + bytes(WORD)
        self.padded, self.gap = np.frombuffer(padded, np.uint8), np.frombuffer(padded.translate(GAP.tobytes()), bool)[8:-WORD]
        self.buf = self.padded[8:-WORD]
        # the eight bytes from each place less 8 on, the first as the lowest
        self.eight = np.ndarray((len(self.buf) + WORD,), "<u8", self.padded.data, 0, (1,))
        self.size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.cumsum(self.size) - self.size
        self.code, self.model, self.shift = code, model, U(64 - context_bits)
        self._words()
        self._kinds()

    def _key(self, context: np.ndarray, order: int, byte: np.ndarray) -> np.ndarray:
        return mix(context, order) >> self.shift << U(8) | self.code.place[byte].astype(U)

    def _words(self) -> None:
        """Words with the byte behind them, long ones in pieces: where they start, their sizes, and which are later pieces. Equal pieces are
        one spelling; for each byte of those, which of the distinct (all bytes of the word so far) it is."""
        n = len(self.buf)
        self.word = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(self.gap[:-1]) + 1])
        size = np.diff(self.word, append=n)
        pieces = -(-size // WORD)
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.piece = np.repeat(self.word, pieces) + place * WORD
        self.piece_size, self.later = np.diff(self.piece, append=n), place > 0
        h = mix(self.eight[self.piece + 8] & LOW.take(self.piece_size, mode="clip"), 9)
        for k in range(8, WORD, 8):
            some = np.flatnonzero(self.piece_size > k)
            h[some] = mix(h[some] ^ (self.eight[self.piece[some] + (k + 8)] & LOW.take(self.piece_size[some] - k, mode="clip")), k)
        self.hash = h & ~U(127) | (self.piece_size << 1 | self.later).astype(U)
        spellings, self.spelling = find(self.hash)
        lead = leads(self.spelling, len(spellings))
        length, later, start = self.piece_size[lead], self.later[lead], self.piece[lead]
        self.begin = np.cumsum(length) - length
        away = np.arange(length.sum()) - np.repeat(self.begin, length)
        byte = self.buf[away + np.repeat(start, length)]
        total = np.concatenate([np.zeros(1, U), np.cumsum((byte + U(1)) * POWERS.take(away))])
        context = total[:-1] - np.repeat(total[self.begin], length) + np.repeat(later, length)
        last = self.begin + length - 1
        # of words that are whole in a piece, without the byte behind
        self.whole = ~later & GAP[byte[last]] & (length > 1)
        self.token = mix(context[last] + (length - 1).astype(U))
        so_far, self.so_far = find(mix(context, 0) & ~U(255) | self.code.place[byte].astype(U))
        lead = leads(self.so_far, len(so_far))
        self.so_far_away, self.so_far_at = away[lead], (away + np.repeat(start, length))[lead]
        # the fewer bits of a key hardly ever bring two of them together
        self.word_keys, self.word_key = so_far >> self.shift << U(8) | so_far & U(255), np.arange(len(so_far))
        if not np.diff(np.sort(self.word_keys)).all():
            self.word_keys, self.word_key = find(self.word_keys)

    def _kinds(self) -> None:
        """Beyond the first bytes of a piece, all bytes of the word so far tell the bytes in front; before, the piece's beginning and the bytes
        in front of it do."""
        k, n = max(1, *self.model.orders), len(self.buf)
        size, start = np.minimum(self.piece_size, k), self.piece
        ends = np.searchsorted(start, np.append(self.first, n))
        front = start - np.repeat(self.first, np.diff(ends))
        self.text = np.add.reduceat(mix(self.hash ^ front.astype(U)), ends[:-1])
        front = np.minimum(front, k)  # bytes in front of a piece, none across the text's start
        before = self.eight[start] >> U(8 * (8 - k)) & ~LOW[k - front]
        h = mix(mix(before, 10) ^ (self.eight[start + 8] & LOW[size]), 11)
        heads, head = find(h & ~U(31) | (size << 1 | self.later).astype(U))
        lead = leads(head, len(heads))
        length = size[lead]
        begin = np.cumsum(length) - length
        away = np.arange(length.sum()) - np.repeat(begin, length)
        at = away + np.repeat(start[lead], length)
        known = np.minimum(away + np.repeat(front[lead], length), k)
        so_far = self.so_far[away + np.repeat(self.begin[self.spelling[lead]], length)]
        self.tail = np.flatnonzero(self.so_far_away >= k)
        # the k bytes in front, and the byte as the highest; with how many are known they tell the word so far, but for later pieces
        seen = self.eight[at + 1] >> U(8 * (7 - k)) & ~LOW[k - known]
        own, self.pair = find(seen ^ mix(np.where(np.repeat(self.later[lead], length), so_far + (k + 1), known).astype(U), 12))
        lead = leads(self.pair, len(own))
        seen = np.concatenate([seen[lead], self.eight[self.so_far_at[self.tail] + 1] >> U(8 * (7 - k))])
        so_far = np.concatenate([so_far[lead], self.tail])
        seen, which = find(seen)
        self.head, self.head_size, self.head_begin, self.beyond = head, length, begin, k
        self.keys, self.entry = [], []
        for order in self.model.orders:
            if order:
                own, entry = find(seen >> U(8 * (k - order))) if order < k else (seen, np.arange(len(seen)))
                self.keys.append(self._key(own & LOW[order], order, (own >> U(8 * order)).astype(np.int64)))
                self.entry.append(entry.take(which))
            else:
                self.keys.append(self.word_keys)
                self.entry.append(self.word_key.take(so_far))
        self.many = self.code.length[(seen >> U(8 * k)).astype(np.int64)].take(which)  # choices of each kind

    def kinds(self) -> np.ndarray:
        """Each byte's kind. A piece is a run of its head's bytes and a run of its spelling's."""
        of_tail = np.zeros(len(self.so_far_at), np.int32)
        of_tail[self.tail] = np.arange(len(self.many) - len(self.tail), len(self.many))
        kind = np.concatenate([self.pair, of_tail.take(self.so_far)])
        out, to = np.empty(len(self.buf), np.int32), 0
        for p in range(0, len(self.piece), PIECES_AT_ONCE):
            own = slice(p, p + PIECES_AT_ONCE)
            size = np.minimum(self.piece_size[own], self.beyond)
            run = np.stack([self.head_begin.take(self.head[own]), len(self.pair) + self.begin.take(self.spelling[own]) + self.beyond], 1).ravel()
            size = np.stack([size, self.piece_size[own] - size], 1).ravel()
            ends = np.cumsum(size)
            at = np.repeat(run - (ends - size), size)
            at += np.arange(len(at))
            kind.take(at, out=out[to : to + len(at)], mode="clip")
            to += len(at)
        return out

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the distinct tokens, the token of each place, its text); every text's last is its end, with hash 0."""
        size = np.diff(self.word, append=len(self.buf)) - 1
        spelling = self.spelling[~self.later]
        doc = np.repeat(np.arange(len(self.first)), np.diff(np.searchsorted(self.word, np.append(self.first, len(self.buf)))))
        h = [self.token[self.whole], np.zeros(1, U)]
        at = (np.cumsum(self.whole) - 1)[spelling]
        long = np.flatnonzero(size >= WORD)
        if len(long):
            import xxhash

            at[long] = self.whole.sum() + 1 + np.arange(len(long))
            h.append(np.array([xxhash.xxh64_intdigest(self.buf[self.word[k] : self.word[k] + size[k]].tobytes(), 1) for k in long], U))
        some = size > 0
        own, which = find(np.concatenate(h))
        at = which[np.concatenate([at[some], np.full(len(self.first), self.whole.sum())])]
        return own, at, np.concatenate([doc[some], np.arange(len(self.first))])

    def together(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the keys of all orders in order, how many bytes in use have each, by order and key its place)."""
        keys = np.concatenate(self.keys)
        use = use[self.piece]
        heads = np.bincount(self.head[use], minlength=len(self.head_size))
        n = np.bincount(self.pair, np.repeat(heads, self.head_size), len(self.many))
        spellings = np.bincount(self.spelling[use], minlength=len(self.begin))
        spellings = np.repeat(spellings, np.diff(self.begin, append=len(self.so_far)))
        n[len(n) - len(self.tail) :] = np.bincount(self.so_far, spellings, len(self.so_far_at))[self.tail]
        self.often = n  # how many bytes in use are of each kind
        count = np.concatenate([np.bincount(e, n, len(k)) for k, e in zip(self.keys, self.entry)]).astype(np.int64)
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], count[order], place


class Tokens(X.Scheme):
    """Hashes of tokens with their training counts; the sums are the distinct ones and all."""

    answers = (np.int64,)

    def sums(self, keys, values):
        return np.array([(values[0] > 0).sum(), values[0].sum(dtype=np.int64)])


class Contexts(X.Scheme):
    """Pairs (context, byte) with their training counts; an answer has, for each choice, the counts of the side that was taken and the other."""

    answers = (np.uint16,)

    def __init__(self, code: Code, context_bits: int):
        self.code, self.bits = code, context_bits + 8
        self.by_place = np.empty(256, np.int64)
        self.by_place[code.place] = code.length

    def lengths(self, keys):
        return self.by_place[(keys[0] & U(255)).astype(np.int64)]

    def top(self, keys, values):
        place, context = (keys[0] & U(255)).astype(np.int64), keys[0] >> U(8)
        length, n = self.by_place[place], values[0]
        new = np.ones(len(place), bool)
        new[1:] = context[1:] != context[:-1]
        out = np.repeat(to_code(n).astype(np.uint16) << 8, length)  # right for the only byte of a context
        some = np.flatnonzero(~(new & np.append(new[1:], True)))
        first = (np.cumsum(length) - length).take(some)
        # the bytes under a node of the code are neighbours within a context; with the one in front, a byte shares so many choices
        shared = np.where(new[some], -1, self.code.shared.ravel().take(place[some] << 8 | place[some - 1]))
        total, length = np.concatenate([np.zeros(1, np.int64), np.cumsum(n[some])]), length[some]
        left, before = np.arange(len(some)), None
        for depth in range(int(length.max(initial=0)) + 1):
            heads = np.flatnonzero(shared < depth)
            group = np.searchsorted(heads, left, "right") - 1
            seen = (np.append(total.take(heads[1:]), total[-1]) - total.take(heads)).take(group) if len(left) else left
            if before is not None:
                out[first.take(left) + (depth - 1)] = to_code(seen).astype(np.uint16) << 8 | to_code(before - seen)
            on = np.flatnonzero(length.take(left) > depth)
            left, before = left.take(on), seen.take(on)
        return [out]


class Odds:
    """The log-odds of the choices of all kinds of bytes, one kind after the other, by order; their gates under the last order."""

    def __init__(self, stream: Stream, place: np.ndarray, many: np.ndarray, answers: np.ndarray, model: Model, own: int = 0):
        """answers: to the keys of all orders together, in order; many: choices of each. own: what each byte counts for itself; if it does,
        the odds come as places in PREDICTIONS."""
        taken, other = COUNT_OF[np.arange(1 << 16) >> 8], COUNT_OF[np.arange(1 << 16) & 255]
        taken, prior = np.maximum(taken - own, 0), np.float32(model.prior)
        odds = np.log((taken + prior) / (other + prior))
        if own:
            odds = np.searchsorted((PREDICTIONS[1:] + PREDICTIONS[:-1]) / 2, odds).astype(np.int32)
        gate = np.searchsorted(SEEN, taken + other, "right").astype(np.int32)
        begin, ends = np.cumsum(many) - many, np.cumsum([0, *map(len, stream.keys)])
        self.begin = np.cumsum(stream.many) - stream.many
        depth = np.arange(stream.many.sum())
        depth -= np.repeat(self.begin, stream.many)
        self.odds = []
        for a, b, entry in zip(ends[:-1], ends[1:], stream.entry):
            said = answers.take(np.repeat(begin[place[a:b]].take(entry), stream.many) + depth)
            self.odds.append(odds.take(said))
        self.gate = gate.take(said) + np.minimum(depth, DEPTHS).astype(np.int32) * (len(SEEN) + 1)


def edges(longest: int, model: Model) -> np.ndarray:
    """Where blocks begin, and the end: a block is a quarter of what has been read, within bounds."""
    out = [0]
    while out[-1] < longest:
        out.append(out[-1] + min(max(model.first_block, out[-1] // 4), model.last_block))
    return np.minimum(out, longest)


def cells(stream: Stream, odds: Odds) -> np.ndarray:
    """Choices of the bytes in use by gate and quantised predictions."""
    out = np.zeros(GATES * LEVELS ** len(odds.odds))
    n = np.repeat(stream.often, stream.many)
    for k in range(0, len(n), CELLS_AT_ONCE):
        own = slice(k, k + CELLS_AT_ONCE)
        one = odds.gate[own] * LEVELS + odds.odds[-1][own]  # the last order's comes with its gate
        for x in odds.odds[:-1]:
            one *= LEVELS
            one += x[own]
        out += np.bincount(one, n[own], len(out))
    return out.astype(np.int64)


def fit(cell: np.ndarray, n: np.ndarray, orders: int, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """(gates, orders): weights that code the counted choices best, by Newton's steps; gates without choices weigh all orders alike."""
    out = np.full((GATES, orders), 1.0 / orders)
    size = LEVELS**orders
    for g in range(GATES):
        own = cell // size == g
        rest, many = cell[own] % size, n[own].astype(float)
        digit = [PREDICTIONS[rest // LEVELS ** (orders - 1 - i) % LEVELS] for i in range(orders)]
        x = np.stack([*digit[1:], digit[0]], 1)  # the last order is the first digit
        w = out[g].copy()
        for _ in range(rounds if own.any() else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (many * (1 - p)) - ridge * (w - 1.0 / orders)
            bend = (x * (many * p * (1 - p))[:, None]).T @ x + ridge * np.eye(orders)
            step = np.linalg.solve(bend, slope)
            w += step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        out[g] = w
    return out


def costs(stream: Stream, odds: Odds, weights: np.ndarray, model: Model) -> np.ndarray:
    """Bits of each text."""
    w, total = weights.T.astype(np.float32), len(odds.gate)
    # a choice's odds by order, the last's weighted, and their sum under the starting weights, all with their signs turned; then choices that
    # cost nothing and move nothing, with which the shorter of the texts that are read side by side are filled up
    table = np.zeros((total + model.last_block * int(stream.code.length.max()), len(w) + 1), np.float32)
    table[:total, -2] = table[:total, -1] = -w[-1].take(odds.gate) * odds.odds[-1]
    for i, x in enumerate(odds.odds[:-1]):
        table[:total, i] = -x
        table[:total, -1] -= w[i].take(odds.gate) * x
    table[total:, -1] = -60
    kinds = stream.kinds()
    runs = odds.begin << 8 | stream.many  # where a kind's choices begin, and how many they are
    out = np.zeros(len(stream.size))
    by_length = np.lexsort((stream.text, -stream.size))  # the texts of a bucket in one order
    for k in range(0, len(by_length), model.together):
        texts = by_length[k : k + model.together]
        size, first = stream.size[texts], stream.first[texts]
        drift = np.zeros((len(texts), len(w) + 1, 1), np.float32)
        drift[:, -1] = 1
        nats = np.zeros(len(texts))
        block = edges(int(size[0]), model)
        for low, high in zip(block[:-1], block[1:]):
            m = int(np.searchsorted(-size, -low))  # those that go on: longest first
            more = int(np.searchsorted(-size, -high))
            for a in range(0, m, max(1, AT_ONCE // (high - low))):
                b = min(m, a + max(1, AT_ONCE // (high - low)))
                n = np.minimum(high, size[a:b]) - low
                fill = np.cumsum(n + 1) - 1  # behind each text's bytes
                heads = fill - n
                kind = kinds.take(np.repeat(first[a:b] + low - heads, n + 1) + np.arange(fill[-1] + 1), mode="clip")
                at = runs.take(kind)
                at, many = at >> 8, at & 255
                many[fill] = 0
                own = np.add.reduceat(many, heads)
                most = int(own.max())
                many[fill], at[fill] = most - own, total
                at -= np.cumsum(many) - many
                x = table.take(np.repeat(at, many) + np.arange(most * (b - a)), 0).reshape(b - a, most, -1)
                z = np.matmul(x, drift[a:b])[:, :, 0]
                chance = np.exp(np.minimum(z, 60, out=z), out=z)
                whole = 1 + chance
                on = max(a, min(b, more))
                if on > a:
                    miss = chance[: on - a] / whole[: on - a]  # what the chance of the choice lacks
                    drift[a:on, :-1] -= np.float32(model.rate / np.sqrt(high)) * np.matmul(miss[:, None], x[: on - a])[:, 0, :-1, None]
                nats[a:b] += np.log(whole, out=whole).sum(1, dtype=float)
        out[texts] = nats / log(2)
    return out


def _lower(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return [t.lower() for t in column.cast(pa.binary()).to_pylist()]


def score(docs: DataFrame, train, model: Model = Model(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, bits, n_bytes, score). train: a function of the id's column."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("train", F.coalesce(train(F.col("doc_id")), F.lit(True))).withColumn("hash", F.xxhash64("doc_id", "t"))
    kind = dict(rows.dtypes)["doc_id"]

    def census(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, octets, of_train = np.zeros(256, np.int64), 0, 0
        for b in batches:
            for t, use in zip(_lower(b.column(0)), b.column(1).to_pylist()):
                octets += len(t) + 1
                if use:
                    of_train += 1
                    seen += np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        seen[END] += of_train
        yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array([*seen.tolist(), octets], pa.int64())], names=["byte", "n"])

    counts = np.zeros(257, np.int64)
    for r in rows.select("t", "train").mapInArrow(census, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 257 rows
        counts[r["byte"]] = r["n"]
    code = prefix_code(counts[:256])
    context_bits = min(56, max(40, int(counts[256]).bit_length() + 10))
    contexts = Contexts(code, context_bits)
    buckets = ceil(counts[256] / BUCKET_BYTES) or 1
    tree, groups = X.Tree(buckets, [Tokens(), contexts]), ceil(buckets / CELL_BUCKETS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows as packed pieces, one for each bucket that some of them go to."""
        for piece, t in X.bucketed(batches, "t", DEALT_BYTES):
            h = t.column("hash").to_numpy().view(U)
            _, first = np.unique(h, return_index=True)
            again = np.ones(len(h), bool)
            again[first] = False
            place = np.flatnonzero(again).astype(U) + (U(piece * 0x9E3779B97F4A7C15 % 2**64) if piece else U(0))
            h = h.copy()
            h[again] = mix(h[again] ^ mix(place, 1), 2)
            bucket = (h % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            t, bucket = t.drop_columns(["hash"]).take(order), bucket[order]
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for a, b in zip(edges[:-1], edges[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]]), pa.array([X.freeze(t.slice(a, b - a))], pa.binary())], names=["child", "rows"])

    def thawed(pieces: pa.Table) -> pa.Table:
        return pa.concat_tables([X.thaw(p.as_py()) for p in pieces.column("rows")])

    def gather(pieces: pa.Table) -> pa.Table:
        """A bucket's distinct tokens and pairs with their training counts; its choices for the starting weights."""
        bucket, left = pieces.column("child")[0].as_py(), thawed(pieces)
        use = left.column("train").to_numpy()
        stream = Stream(_lower(left.column("t")), code, model, context_bits)
        word, at, doc = stream.tokens()
        n = np.bincount(at[use[doc]], minlength=len(word))
        order = np.argsort(word)
        out = tree.send(bucket, 0, [word[order]], [n[order]])
        trained = np.repeat(use, stream.size)
        keys, n, place = stream.together(trained)
        out += tree.send(bucket, 1, [keys], [n])
        cell = cells(stream, Odds(stream, place, contexts.lengths([keys]), contexts.top([keys], [n])[0], model, 1))
        some = np.flatnonzero(cell)
        out.append(tree.keep(tree.number(bucket) % groups, [X.pack_sorted(some.astype(U)), X.pack(cell[some])], 1))
        return X.table(out, X.UP)

    def add(t: pa.Table) -> pa.Table:
        """The cells of some buckets."""
        out = np.zeros(GATES * LEVELS ** len(model.orders), np.int64)
        for at, n in X.kept(t, 1):
            out[X.unpack_sorted(at).astype(np.int64)] += X.unpack(n, np.int64)
        some = np.flatnonzero(out)
        return pa.table({"cell": some, "n": out[some]})

    def solve(t: pa.Table) -> pa.Table:
        return pa.table({"w": pa.array([fit(np.asarray(t.column("cell")), np.asarray(t.column("n")), len(model.orders)).tobytes()], pa.binary())})

    # one shuffle of the texts serves both readings, one of what buckets send the answers and the cells; there are at most as many sums as
    # the model has cells, and one row of weights
    dealt = rows.mapInArrow(deal, "child long, rows binary")
    sent = dealt.groupBy("child").applyInArrow(gather, X.UP)
    weights = sent.groupBy("to").applyInArrow(add, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(solve, "w binary")
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, bits double, n_bytes long"

    def apply(pieces: pa.Table, said: pa.Table) -> pa.Table:
        left = thawed(pieces)
        weights = np.frombuffer(next(w for w in said.column("w").to_pylist() if w)).reshape(GATES, -1)
        texts = _lower(left.column("t"))
        stream = Stream(texts, code, model, context_bits)
        word, at, doc = stream.tokens()
        (count,), (v, total) = tree.read(said, 0)
        c = np.empty(len(word), np.int64)
        c[np.argsort(word)] = count
        c = c[at]
        n = np.bincount(doc, minlength=len(texts))
        keys, _, place = stream.together(np.zeros(len(stream.buf), bool))
        (answers,), _ = tree.read(said, 1)
        odds = Odds(stream, place, contexts.lengths([keys]), answers, model)
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "n_tokens": pa.array(n, pa.int64()),
                "n_known": pa.array(np.bincount(doc, c > 0, len(texts)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(texts), total), pa.int64()),
                "base_score": pa.array((np.bincount(doc, np.log(c + 1.0), len(texts)) - n * log(total + v + 1)) / log(10)),
                "bits": pa.array(costs(stream, odds, weights, model)),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            }
        )

    said = tree.totals(sent).join(F.broadcast(weights), F.lit(True))
    said = said.withColumn("w", F.when(F.col("at") == 0, F.col("w")))
    out = dealt.groupBy("child").cogroup(said.groupBy("child")).applyInArrow(apply, schema)
    return out.withColumn("score", F.col("bits") * (-log(2) / log(10)))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and bits per byte (with the end symbol)."""
    out = score(docs, lambda key: remainder(key, 7) != 2)
    held = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
