"""Adaptive context-mixing range coder for token ids, many blocks in lock step with numpy.

A frame holds blocks of BLOCK ids. All blocks are coded step by step side by side and share one model, which at some steps
(STEPS) learns all ids before them; between these it stands still, so that whole arrays of ids are looked up at once.
Each block ends in its own words and has its own CRC-32. Ids must be below 65,536.

An id is one step of the range coder. Its probability mixes three predictions: order 0 (counts of ids, beginning with the
code lengths in the header), order 1 (counts of ids after the last one), order 2 (the id seen most often after the last
two). Mixing is linear, so that cumulative ranges mix likewise: those of order 0 are a table, those of order 1 a sorted row
of the ids seen after another, that of order 2 is one step. Weights go by an order's experience with its context (how
often seen, how evenly) and are learned, too: what part of the coded ids' probability the order had.

Ranges are integers; learned weights are of floating-point sums, products and quotients in a fixed order, which IEEE 754
rounds alike everywhere. The range coder is carry-less, with 64-bit state and 32-bit output words.

Frame: magic, version, ids, block size, bytes of the code lengths; these (zlib of ids and lengths); for each block its
bytes and CRC (little-endian 32-bit); then the words.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

BLOCK, LANES = 2048, 4096
MAGIC, VERSION, HEAD = b"TWCM", 4, struct.Struct("<4sBxxxQII")
#: Bits of the ranges of order 0, of orders 0 and 1, of all three.
EVEN, FIRST, TOTAL = 17, 22, 26
#: Steps at which the model learns.
STEPS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
#: Ids of which weights are learned at such a step; ids whose ranges are looked up at once; longest code.
SAMPLE, AT_ONCE, DEEPEST = 1 << 15, 1 << 16, 30
_WORD, _LOW32 = np.uint64(1 << 32), np.uint64((1 << 32) - 1)
_32, _ZERO, _TOTAL = np.uint64(32), np.uint64(0), np.uint64(TOTAL)


# ---- code lengths ----


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of counts (none of them zero), of DEEPEST bits at most."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.uint8)
    counts = counts.astype(np.int64)
    while True:
        heap, parent = [(c, i) for i, c in enumerate(counts.tolist())], [0] * (2 * n - 1)
        heapq.heapify(heap)
        for k in range(n, 2 * n - 1):
            a, x = heapq.heappop(heap)
            b, y = heap[0]
            parent[x] = parent[y] = k
            heapq.heapreplace(heap, (a + b, k))
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= DEEPEST:
            return np.array(depth[:n], np.uint8)
        counts = counts // 2 + 1


# ---- the range coder ----


def _renew(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Lanes whose first word is settled, or given up where the range is short."""
    same = (low ^ (low + rng)) < _WORD
    go = np.flatnonzero(same | (rng < _WORD))
    if len(go):
        short = go[~same[go]]
        rng[short] = (_ZERO - low[short]) & _LOW32
    return go


class _Encoder:
    def __init__(self, n: int):
        self.low, self.rng = np.zeros(n, np.uint64), np.full(n, ~_ZERO)
        self.out, self.pos = np.zeros((n, BLOCK // 2), np.uint32), np.zeros(n, np.int64)

    def put(self, lows: np.ndarray, sizes: np.ndarray) -> None:
        n = len(lows)
        low, rng = self.low[:n], self.rng[:n]
        rng >>= _TOTAL
        low += rng * lows
        rng *= sizes
        go = _renew(low, rng)
        if len(go):
            at = self.pos[go]
            if int(at.max()) + 4 > self.out.shape[1]:
                self.out = np.concatenate((self.out, np.zeros_like(self.out)), axis=1)
            self.out[go, at] = low[go] >> _32
            self.pos[go] = at + 1
            low[go] <<= _32
            rng[go] <<= _32

    def end(self) -> list[bytes]:
        at = np.arange(len(self.low))
        for shift in (_32, _ZERO):
            self.out[at, self.pos] = self.low >> shift & _LOW32
            self.pos += 1
        return [o[:n].astype("<u4").tobytes() for o, n in zip(self.out, self.pos.tolist(), strict=True)]


class _Decoder:
    def __init__(self, parts: list[bytes]):
        n = len(parts)
        self.buf = np.zeros((n, max(map(len, parts)) // 4 + 2), np.uint32)
        for row, p in zip(self.buf, parts, strict=True):
            row[: len(p) // 4] = np.frombuffer(p, "<u4", len(p) // 4)
        self.low, self.rng, self.pos = np.zeros(n, np.uint64), np.full(n, ~_ZERO), np.full(n, 2, np.int64)
        self.code = self.buf[:, 0].astype(np.uint64) << _32 | self.buf[:, 1]
        self.last = self.buf.shape[1] - 1

    def place(self, n: int) -> np.ndarray:
        """Where the next id's range is looked for."""
        rng = self.rng[:n]
        rng >>= _TOTAL
        return np.minimum((self.code[:n] - self.low[:n]) // rng, (1 << TOTAL) - 1).astype(np.int64)

    def take(self, lows: np.ndarray, sizes: np.ndarray) -> None:
        n = len(lows)
        low, rng, code = self.low[:n], self.rng[:n], self.code[:n]
        low += rng * lows.astype(np.uint64)
        rng *= sizes.astype(np.uint64)
        go = _renew(low, rng)
        if len(go):
            at = self.pos[go]
            code[go] = code[go] << _32 | self.buf[go, np.minimum(at, self.last)]
            self.pos[go] = at + 1
            low[go] <<= _32
            rng[go] <<= _32


# ---- the model ----


def _count(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and their counts, added to those known."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys, counts = keys[at], np.diff(np.append(at, len(keys)))
    if known is None:
        return keys, counts
    keys, counts = np.concatenate((known[0], keys)), np.concatenate((known[1], counts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def _level(n: np.ndarray) -> np.ndarray:
    """Binary digits of counts, at most 15."""
    return np.searchsorted(1 << np.arange(15), n, "right")


class _Model:
    """Predictions of orders 0 to 2 from the ids of all blocks up to a step, and their weights.

    Ids are numbers 0 to k - 1 here, k being the start's context. Order 1's ids of a context are a row of entries, closed by
    one for the place above all ids. below: what order 1 gives the row's ids before an entry; own: what it gives the entry.
    """

    def __init__(self, lens: np.ndarray):
        self.k = len(lens)
        self.n0 = (1 << 12) >> np.minimum(lens.astype(np.int64), 12)
        self.pairs = self.triples = None
        # weights (shares of orders 1 and 2 of what is left to them), by experience with contexts of a kind
        n, d = np.divmod(np.arange(64), 4)
        self.one = (n + 1.0) / (n + 3.0 + d)
        m, rest = np.divmod(np.arange(64), 4)
        self.two = m / (m + 4.0 + 4.0 * rest)
        self.build()

    def build(self) -> None:
        k, c = self.k, self.n0
        f = 1 + ((1 << EVEN) - k) * c // max(1, int(c.sum()))
        f[int(np.argmax(f))] += (1 << EVEN) - int(f.sum())
        self.f0 = np.concatenate(([0], np.cumsum(f)))
        self.id_at = np.repeat(np.arange(k), f)
        # order 1
        keys, n = self.pairs or (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ends = np.arange(k + 1) << 17 | 1 << 16
        spot = np.searchsorted(keys, ends)
        self.keys, weight = np.insert(keys, spot, ends), np.insert(2 * n - 1, spot, 0)
        row = self.keys >> 17
        last = spot + np.arange(k + 1)
        self.first = np.concatenate(([0], last + 1))
        sums = np.concatenate(([0], np.cumsum(weight)))
        total, seen = sums[last] - sums[self.first[:-1]], np.bincount(keys >> 17, weights=n, minlength=k + 1).astype(np.int64)
        self.kind1 = np.where(seen > 0, 4 * _level(seen) + np.minimum(3, 4 * (last - self.first[:-1]) // np.maximum(1, seen)), 0)
        share = np.where(seen > 0, (self.one[self.kind1] * (1 << FIRST)).astype(np.int64), 0)
        share = np.minimum(share, (1 << FIRST) - (1 << EVEN))
        self.rest = (1 << FIRST) - share
        self.below = (sums[:-1] - sums[self.first][row]) * share[row] // np.maximum(1, total)[row]
        self.own = np.append(np.diff(self.below), 0)
        self.own[last] = 0
        x = np.minimum(self.keys & 0x1FFFF, k)
        rest = self.rest[row]
        low = rest * self.f0[x] >> EVEN
        self.low = (low + self.below).astype(np.int32)
        self.high = ((rest * self.f0[np.minimum(x + 1, k)] >> EVEN) + self.below + self.own).astype(np.int32)
        self.id_of, self.below, self.own = x.astype(np.int32), self.below.astype(np.int32), self.own.astype(np.int32)
        self.hash = np.zeros(1 << max(4, int(len(self.keys)).bit_length() + 1), np.int32)
        self.hash[self.place(self.keys)] = np.arange(len(self.keys))
        self.ruler = None
        # order 2: the id seen most often after two others
        self.slots = 0
        if self.triples:
            keys, n = self.triples
            context = keys >> 17
            at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            context, sums, most = context[at], np.add.reduceat(n, at), np.maximum.reduceat(n, at)
            best = np.flatnonzero(n == np.repeat(most, np.diff(np.append(at, len(n)))))
            best = best[np.searchsorted(best, at)]
            kind = 4 * _level(most) + np.minimum(3, 4 * (sums - most) // sums)
            self.slots = (1 << min(20, max(4, int(2 * len(at)).bit_length()))) - 1
            slot = self.slot(context >> 17, context & 0x1FFFF)
            self.guess = np.full(self.slots + 1, -1, np.int32)
            self.kind2 = np.zeros(self.slots + 1, np.int8)
            order = np.argsort(most, kind="stable")
            self.guess[slot[order]] = np.searchsorted(self.keys, keys[best] & (1 << 34) - 1)[order]
            self.kind2[slot[order]] = kind[order]
        self.share2 = np.minimum((self.two * (1 << TOTAL)).astype(np.int64), (1 << TOTAL) - (1 << FIRST))
        self.share2[0] = 0

    def slot(self, b: np.ndarray, a: np.ndarray) -> np.ndarray:
        return b * 2654435761 + a * 11400714819 >> 16 & self.slots

    def place(self, key: np.ndarray) -> np.ndarray:
        return (key * 11400714819 >> 19) & len(self.hash) - 1

    def second(self, b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order 2 after ids b, a: the entry that it expects, its kind, its share of the whole."""
        if not self.slots:
            zero = np.zeros(len(a), np.int64)
            return zero, zero, zero
        at = self.slot(b, a)
        g = self.guess.take(at)
        kind = self.kind2.take(at)
        # another context may have the slot
        kind *= (g >= self.first.take(a)) & (g < self.first.take(a + 1))
        return g, kind, self.share2.take(kind)

    def find(self, a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The entry of ids x after ids a or the one above, whether it is theirs, and their ranges in orders 0 and 1."""
        key = a << 17 | x
        j = self.hash.take(self.place(key))
        hit = self.keys.take(j) == key
        no = np.flatnonzero(~hit)
        if len(no):
            j[no] = y = np.searchsorted(self.keys, key[no])
            hit[no] = self.keys[y] == key[no]
        low, high = self.low.take(j).astype(np.int64), self.high.take(j).astype(np.int64)
        no = np.flatnonzero(~hit)
        if len(no):
            rest, below, y = self.rest[a[no]], self.below[j[no]], x[no]
            low[no] = (rest * self.f0[y] >> EVEN) + below
            high[no] = (rest * self.f0[y + 1] >> EVEN) + below
        return j, hit, low, high

    def seek(self, a: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The last entry after ids a that begins at v or below; the one before the row if there is none."""
        if self.ruler is None:
            # each row's places at even distances
            bits = np.minimum(FIRST, self.level(np.diff(self.first)) + 1)
            self.shift, sizes = FIRST - bits, 1 << bits
            ends = np.cumsum(sizes)
            self.start, row = ends - sizes, np.repeat(np.arange(self.k + 1), sizes)
            places = (row << FIRST + 1) + (np.arange(len(row)) - self.start[row] << self.shift[row])
            self.marks = ((self.keys >> 17) << FIRST + 1) + self.low
            self.ruler = (np.searchsorted(self.marks, places, "right") - 1).astype(np.int32)
        j = self.ruler.take(self.start.take(a) + (v >> self.shift.take(a)))
        j += self.low.take(j + 1) <= v
        j += self.low.take(j + 1) <= v
        no = np.flatnonzero(self.low.take(j + 1) <= v)
        if len(no):
            j[no] = np.searchsorted(self.marks, (a[no] << FIRST + 1) + v[no], "right") - 1
        return j

    @staticmethod
    def level(n: np.ndarray) -> np.ndarray:
        return np.searchsorted(1 << np.arange(24), n, "right")

    def range(self, b: np.ndarray, a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of ids x, of 1 << TOTAL, after ids b, a."""
        j, hit, low, high = self.find(a, x)
        if not self.slots:
            return low << TOTAL - FIRST, high - low << TOTAL - FIRST
        g, _, share = self.second(b, a)
        left = (1 << TOTAL) - share
        low *= left
        low >>= FIRST
        high *= left
        high >>= FIRST
        high -= low
        high += share * (hit & (j == g))
        low += share * (g < j)
        return low, high

    def id(self, b: np.ndarray, a: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids whose ranges hold t, and the ranges."""
        if self.slots:
            g, _, share = self.second(b, a)
            left = (1 << TOTAL) - share
            low2 = left * self.low.take(g, mode="wrap") >> FIRST
            high2 = (left * self.high.take(g, mode="wrap") >> FIRST) + share
            above = t >= high2
            beyond = share * above
            # the highest place of orders 0 and 1 that the range maps to t or below; exact, as no quotient has over 50 bits
            v = ((t - beyond + 1 << FIRST) - 1) / left
            is2 = np.flatnonzero((share > 0) & (t >= low2) & ~above)
            v[is2] = 0
            v = v.astype(np.int32)
        else:
            v = (t >> TOTAL - FIRST).astype(np.int32)
        j = self.seek(a, v)
        low, high = self.low.take(j, mode="wrap").astype(np.int64), self.high.take(j, mode="wrap").astype(np.int64)
        x = self.id_of.take(j, mode="wrap").astype(np.int64)
        no = np.flatnonzero((j < self.first.take(a)) | (v >= high))
        if len(no):
            rest, below = self.rest[a[no]], self.below[j[no] + 1]
            x[no] = y = self.id_at.take((((v[no] - below + 1).astype(np.int64) << EVEN) - 1) // rest, mode="clip")
            low[no] = (rest * self.f0[y] >> EVEN) + below
            high[no] = (rest * self.f0[y + 1] >> EVEN) + below
        if not self.slots:
            return x, low << TOTAL - FIRST, high - low << TOTAL - FIRST
        low *= left
        low >>= FIRST
        high *= left
        high >>= FIRST
        low += beyond
        high += beyond
        if len(is2):
            x[is2], low[is2], high[is2] = self.id_of.take(g[is2]), low2[is2], high2[is2]
        high -= low
        return x, low, high

    def learn(self, b: np.ndarray, a: np.ndarray, x: np.ndarray) -> None:
        """Take new ids x after b, a: weights from how well the orders did on the first of them, then counts of all."""
        s = slice(0, SAMPLE)
        j, hit, low, high = self.find(a[s], x[s])
        size = high - low
        one = self.own.take(j) * hit
        kind = self.kind1.take(a[s])
        self.one = self.better(self.one, kind, one / size)
        if self.slots:
            g, kind, share = self.second(b[s], a[s])
            two = share * (hit & (j == g))
            left = (1 << TOTAL) - share
            self.two = self.better(self.two, kind, two / (two + left * size / (1 << FIRST)))
        self.n0 = self.n0 + np.bincount(x, minlength=self.k)
        self.pairs = _count(a << 17 | x, self.pairs)
        self.triples = _count(b << 34 | a << 17 | x, self.triples)
        self.build()

    @staticmethod
    def better(weights: np.ndarray, kind: np.ndarray, due: np.ndarray) -> np.ndarray:
        """Weights that an order has earned: the mean of its part in what was coded."""
        n = np.bincount(kind, minlength=64)
        return (np.bincount(kind, weights=due, minlength=64) + 16 * weights) / (n + 16.0)


# ---- frames ----


def _lens(n: int) -> np.ndarray:
    return np.array([BLOCK] * (n // BLOCK) + [n % BLOCK] * (n % BLOCK > 0), np.int64)


def _phases(lens: np.ndarray) -> list[tuple[int, int, int]]:
    """Steps from, to, and the number of blocks that have them all; only the last block may be shorter than others."""
    cuts = sorted({0, *(s for s in STEPS if s < lens[0]), int(lens[-1]), int(lens[0])})
    return [(a, b, len(lens) - (len(lens) > 1 and a >= int(lens[-1]))) for a, b in zip(cuts, cuts[1:], strict=False)]


def encode(ids: np.ndarray) -> bytes:
    """A frame of the ids (integers below 65,536)."""
    if len(ids) and (int(ids.max()) > 65535 or int(ids.min()) < 0):
        raise ValueError("ids must be in 0..65535")
    ids, lens = ids.astype(np.uint16), _lens(len(ids))
    counts = sum((np.bincount(ids[k : k + AT_ONCE], minlength=65536) for k in range(0, len(ids), AT_ONCE)), np.zeros(65536, np.int64))
    known = np.flatnonzero(counts)
    code = code_lengths(counts[known]) if len(known) else np.zeros(0, np.uint8)
    head = zlib.compress(known.astype("<u2").tobytes() + code.tobytes(), 9)
    parts: list[bytes] = []
    if len(ids):
        number = np.zeros(65536, np.int32)
        number[known] = np.arange(len(known))
        # two rows of the start's context, then a row for each step
        grid = np.full((BLOCK + 2, len(lens)), len(known), np.int32)
        flat = np.zeros(len(lens) * BLOCK, np.int32)
        flat[: len(ids)] = number.take(ids)
        grid[2:] = flat.reshape(len(lens), BLOCK).T
        del flat
        model, coder = _Model(code), _Encoder(len(lens))
        for first, end, n in _phases(lens):
            rows = max(1, AT_ONCE // n)
            for k in range(first, end, rows):
                b, a, x = _contexts(grid, k, min(k + rows, end), n)
                low, size = model.range(b, a, x)
                for one, two in zip(low.astype(np.uint64).reshape(-1, n), size.astype(np.uint64).reshape(-1, n), strict=True):
                    coder.put(one, two)
            if end < lens[0]:
                model.learn(*_contexts(grid, first, end, n))
        parts = coder.end()
    crcs = [zlib.crc32(ids[k : k + BLOCK].astype("<u2").tobytes()) for k in range(0, len(ids), BLOCK)]
    table = np.array([[len(p), c] for p, c in zip(parts, crcs, strict=True)], "<u4").tobytes()
    return HEAD.pack(MAGIC, VERSION, len(ids), BLOCK, len(head)) + head + table + b"".join(parts)


def _contexts(grid: np.ndarray, first: int, end: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of steps of the first n blocks, step by step: those two and one before, and themselves."""
    return tuple(grid[first + d : end + d, :n].reshape(-1).astype(np.int64) for d in range(3))


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame (uint16); ValueError if it isn't whole."""
    if len(frame) < HEAD.size:
        raise ValueError("not a frame of this format")
    magic, version, n, block, size = HEAD.unpack_from(frame)
    start = HEAD.size + size
    if (magic, version, block) != (MAGIC, VERSION, BLOCK) or len(frame) < start + 8 * -(-n // BLOCK):
        raise ValueError("not a frame of this format")
    try:
        head = zlib.decompress(frame[HEAD.size : start])
    except zlib.error as e:
        raise ValueError("the frame's code lengths are broken") from e
    lens = _lens(n)
    known = np.frombuffer(head, "<u2", len(head) // 3)
    table = np.frombuffer(frame, "<u4", 2 * len(lens), start).reshape(-1, 2).astype(np.int64)
    at = start + 8 * len(lens) + np.concatenate(([0], np.cumsum(table[:, 0])))
    if at[-1] != len(frame) or (n > 0) != (len(known) > 0):
        raise ValueError("the frame's length is wrong")
    if not n:
        return np.zeros(0, np.uint16)
    grid = np.full((BLOCK + 2, len(lens)), len(known), np.int32)
    model = _Model(np.frombuffer(head, np.uint8, len(known), 2 * len(known)))
    coder = _Decoder([frame[a:b] for a, b in zip(at, at[1:], strict=False)])
    for first, end, m in _phases(lens):
        b, a = grid[first, :m].astype(np.int64), grid[first + 1, :m].astype(np.int64)
        for k in range(first, end):
            x, low, size = model.id(b, a, coder.place(m))
            coder.take(low, size)
            grid[k + 2, :m] = x
            b, a = a, x
        if end < lens[0]:
            model.learn(*_contexts(grid, first, end, m))
    ids = known.take(grid[2:].T.reshape(-1)[:n], mode="clip").astype(np.uint16)
    for k, crc in zip(range(0, n, BLOCK), table[:, 1].tolist(), strict=True):
        if zlib.crc32(ids[k : k + BLOCK].astype("<u2").tobytes()) != crc:
            raise ValueError(f"block {k // BLOCK} fails its checksum")
    return ids
