"""Context-mixing range coder for token ids, many independent blocks in step.

An id is coded as the one that followed the last two ids before (order 2), as the one that last followed the last id
(order 1), or by a count. Which of the three it is has three adaptive predictions, from how the last three ids
came, from the last id and from the last two, mixed by how well each has done. The counts are static: how often
each id follows each of the most frequent ids (order 1) and any other (order 0) among all ids coded together; their
table goes with the blocks, so a block does not have to learn tens of thousands of ids anew. All else of a
block starts from nothing, so blocks are coded and decoded side by side, one NumPy lane each; only +, *, / of IEEE
numbers decide, so a reader repeats the writer's sums.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK_IDS = 4096
SYMBOLS = 3  # the order-2 guess, the order-1 guess, any id by its count

# Powers of two: contexts of order 1 and 2, and remembered ids of order 1 and 2.
_ONE, _TWO = 256, 512
_LAST_ONE, _LAST_TWO = 2048, 4096
_PAST = SYMBOLS**3
_RATE = np.float32(1 / 24)
_SCALE = np.float32(4000)
_SUMS = np.triu(np.ones((SYMBOLS, SYMBOLS), np.float32))
# Of the static table: so many ids at most have successors of their own, one for so many ids that are coded.
MOST_STATES, IDS_PER_STATE = 1023, 1500
_U = np.uint64
_TOP, _LOW, _WORD = _U(1 << 48), _U(1 << 42), _U(16)


class _Lanes:
    """The models of all blocks at one place."""

    def __init__(self, n: int):
        self.n, self.lane = n, np.arange(n)
        start = np.array([0.1, 0.1, 0.8], np.float32)
        self.zero = np.tile(start, (n * _PAST, 1))
        self.one = np.tile(start, (n * _ONE, 1))
        self.two = np.tile(start, (n * _TWO, 1))
        self.weights = np.full((3, n), np.float32(1 / 3))
        self.last_one = np.full(n * _LAST_ONE, -1, np.int32)
        self.last_two = np.full(n * _LAST_TWO, -1, np.int32)
        self.before = np.zeros(n, np.int64)
        self.hash = np.zeros(n, np.int64)
        self.past = np.full(n, _PAST - 1)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies of the symbols and their sums; also sets the two predicted ids."""
        h = self.hash
        mixed_one = self.before * 40503 >> 4
        self.at_zero = self.lane * _PAST + self.past
        self.at_one = self.lane * _ONE + (mixed_one & (_ONE - 1))
        self.at_two = self.lane * _TWO + (h >> 12 & (_TWO - 1))
        self.place_one = self.lane * _LAST_ONE + (mixed_one & (_LAST_ONE - 1))
        self.place_two = self.lane * _LAST_TWO + (h & (_LAST_TWO - 1))
        self.guess_one, self.guess_two = self.last_one[self.place_one], self.last_two[self.place_two]
        self.rows = self.zero[self.at_zero], self.one[self.at_one], self.two[self.at_two]
        w = self.weights[:, :, None]
        mixed = self.rows[0] * w[0]
        mixed += self.rows[1] * w[1]
        mixed += self.rows[2] * w[2]
        mixed *= _SCALE
        self.frequency = np.floor(mixed) + np.float32(1)
        return self.frequency, self.frequency @ _SUMS  # whole numbers below 2 ** 13: exact

    def learn(self, symbol: np.ndarray, ids: np.ndarray) -> None:
        lane = self.lane
        done = np.stack([rows[lane, symbol] for rows in self.rows])
        weights = self.weights * (done + np.float32(0.02)) + np.float32(0.002)
        self.weights = weights / (weights[0] + weights[1] + weights[2])
        # Contexts are rare, so they learn faster.
        for rows, table, at, rate in zip(
            self.rows, (self.zero, self.one, self.two), (self.at_zero, self.at_one, self.at_two), (1, 2, 5), strict=True
        ):
            rows *= np.float32(1) - rate * _RATE
            rows[lane, symbol] += rate * _RATE
            table[at] = rows
        self.past = (self.past * SYMBOLS + symbol) % _PAST
        self.last_one[self.place_one] = ids
        self.last_two[self.place_two] = ids
        self.hash = (self.before * 40503 + ids * 30011 + 17) * 2654435761 >> 11 & 0x3FFFFFFF
        self.before = ids


class Table:
    """How often each id follows each of the most frequent ids, and any other.

    ``values``: the ids that occur; they go by their number in it. ``state``: of each id as the one before: its rank
    where it is among the most frequent, else the last state, in which blocks begin as well. ``keys``: the pairs of state
    and id that occur, as one number, with their ``counts``; those of one state lie together.
    """

    def __init__(self, values: np.ndarray, state: np.ndarray, states: int, keys: np.ndarray, counts: np.ndarray):
        self.values, self.state, self.states = values, state, states
        self.keys, self.counts = keys, counts.astype(_U)
        self.ends = np.cumsum(self.counts, dtype=_U)
        bounds = np.searchsorted(keys, np.arange(self.states + 1) * len(values))
        sums = np.concatenate((np.zeros(1, _U), self.ends))
        self.base = sums[bounds[:-1]]
        self.total = np.maximum(sums[bounds[1:]] - self.base, _U(1))

    @classmethod
    def of(cls, ids: np.ndarray, block: int) -> tuple[Table, np.ndarray, np.ndarray]:
        """The table of ids, and of each id its number and the place of its pair."""
        values, numbers, counts = np.unique(ids, return_inverse=True, return_counts=True)
        most = min(MOST_STATES, len(ids) // IDS_PER_STATE, len(values))
        state = np.full(len(values), most, np.int64)
        state[np.lexsort((values, -counts))[:most]] = np.arange(most)
        before = np.full(len(ids), most, np.int64)
        before[1:] = state[numbers[:-1]]
        before[::block] = most
        keys, place, times = np.unique(before * len(values) + numbers, return_inverse=True, return_counts=True)
        return cls(values.astype(np.uint32), state, most + 1, keys, times), numbers.astype(np.int32), place.astype(np.int32)

    def pack(self) -> bytes:
        steps = np.diff(self.values, prepend=np.uint32(0)).astype("<u4")
        frequent = np.argsort(self.state, kind="stable")[: self.states - 1].astype("<u4")
        keys = np.diff(self.keys, prepend=0).astype("<u8")
        head = np.array([len(steps), len(frequent), len(keys)], "<u4")
        counts = self.counts.astype("<u4")
        # First bytes together, then second ones and so on: most of the later ones are zero.
        planes = [x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in (steps, frequent, keys, counts)]
        return zlib.compress(head.tobytes() + b"".join(planes), 9)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        data = zlib.decompress(data)
        n, most, pairs = np.frombuffer(data, "<u4", 3).tolist()
        at = 12

        def column(length: int, kind: str) -> np.ndarray:
            nonlocal at
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(data, np.uint8, length * width, at).reshape(width, length)
            at += length * width
            return np.ascontiguousarray(planes.T).view(kind).ravel()

        values = np.cumsum(column(n, "<u4"), dtype=np.uint32)
        state = np.full(n, most, np.int64)
        state[column(most, "<u4")] = np.arange(most)
        keys = np.cumsum(column(pairs, "<u8").astype(np.int64))
        return cls(values, state, most + 1, keys, column(pairs, "<u4"))


def _shift(low: np.ndarray, span: np.ndarray):
    """Lanes whose leading word is settled, until none is; the callers move their words."""
    while True:
        same = (low ^ (low + span)) < _TOP
        need = np.flatnonzero(same | (span < _LOW))
        if not len(need):
            return
        cut = need[~same[need]]
        span[cut] = (_U(0) - low[cut]) & (_LOW - _U(1))
        yield need
        low[need] <<= _WORD
        span[need] <<= _WORD


def encode(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[bytes, list[bytes]]:
    """The table of ids (below 2 ** 32) and their coded blocks, each of ``block`` ids but the last."""
    if not len(ids):
        return b"", []
    table, numbers, places = Table.of(ids, block)
    n = -(-len(ids) // block)
    steps = min(block, len(ids))
    lanes = _Lanes(n)

    def in_step(each: np.ndarray) -> np.ndarray:
        whole = np.zeros(n * block, np.int32)
        whole[: len(ids)] = each
        return whole.reshape(n, block)[:, :steps].T.copy()

    rows, places = in_step(numbers), in_step(places)
    state = np.full(n, table.states - 1)
    nothing = _U(0)
    low, span = np.zeros(n, _U), np.full(n, np.iinfo(np.uint64).max, _U)
    out = np.zeros((n, 2 * steps + 8), "<u2")
    size = np.zeros(n, np.int64)

    def put(start: np.ndarray, part: np.ndarray, whole) -> None:
        nonlocal low, span
        unit = span // whole
        low += start * unit
        span = part * unit

    short = len(ids) - (n - 1) * block  # the last block may be through before the others
    for t, (row, place) in enumerate(zip(rows, places, strict=True)):
        own = row.astype(np.int64)
        frequency, ends = lanes.predict()
        symbol = np.where(own == lanes.guess_two, 0, np.where(own == lanes.guess_one, 1, 2))
        part = frequency[lanes.lane, symbol]
        start, part, whole = (ends[lanes.lane, symbol] - part).astype(_U), part.astype(_U), ends[:, -1].astype(_U)
        free = symbol == 2
        if t >= short:  # it stays as it is
            start[-1], part[-1], free[-1] = 0, whole[-1], False
        put(start, part, whole)
        total, count = table.total[state], table.counts[place]
        put(np.where(free, table.ends[place] - count - table.base[state], nothing), np.where(free, count, total), total)
        state = table.state[own]
        for need in _shift(low, span):
            out[need, size[need]] = (low[need] >> _U(48)).astype(np.uint16)
            size[need] += 1
        lanes.learn(symbol, own)
    for shift in (48, 32, 16, 0):
        out[lanes.lane, size] = (low >> _U(shift)).astype(np.uint16)
        size += 1
    return table.pack(), [out[i, :k].tobytes() for i, k in enumerate(size.tolist())]


def decode(table: bytes, blocks: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """The ids of coded blocks."""
    if not blocks:
        return []
    known = Table.unpack(table)
    n, steps = len(blocks), max(counts)
    state = np.full(n, known.states - 1)
    nothing, one = _U(0), _U(1)
    sizes = np.array([len(b) // 2 for b in blocks])
    data = np.zeros((n, int(sizes.max()) + 8), "<u2")
    for i, b in enumerate(blocks):
        data[i, : sizes[i]] = np.frombuffer(b, "<u2")
    lanes = _Lanes(n)
    low, span = np.zeros(n, _U), np.full(n, np.iinfo(np.uint64).max, _U)
    code, at = np.zeros(n, _U), np.full(n, 4)
    for i in range(4):
        code = code << _WORD | data[:, i].astype(_U)
    out = np.zeros((steps, n), np.int32)
    last = data.shape[1] - 1
    sizes, first_through = np.array(counts), min(counts)
    for t in range(steps):
        if t >= first_through:  # lanes that are through read nothing more
            through = sizes <= t
            low[through], code[through], span[through] = 0, 0, np.iinfo(np.uint64).max
        frequency, ends = lanes.predict()
        unit = span // ends[:, -1].astype(_U)
        value = ((code - low) // unit).astype(np.float64)
        symbol = np.minimum((ends <= value[:, None]).sum(axis=1), SYMBOLS - 1)
        part = frequency[lanes.lane, symbol]
        low += (ends[lanes.lane, symbol] - part).astype(_U) * unit
        span = part.astype(_U) * unit
        free = symbol == 2
        base, total = known.base[state], known.total[state]
        unit = span // total
        place = np.searchsorted(known.ends, base + np.minimum((code - low) // unit, total - one), side="right")
        place = np.minimum(place, len(known.keys) - 1)
        count = known.counts[place]
        low += np.where(free, known.ends[place] - count - base, nothing) * unit
        span = np.where(free, count, total) * unit
        found = known.keys[place] % len(known.values)
        own = np.where(symbol == 0, lanes.guess_two, np.where(symbol == 1, lanes.guess_one, found)).astype(np.int64)
        own = np.maximum(own, 0)
        state = known.state[own]
        for need in _shift(low, span):
            code[need] = code[need] << _WORD | data[need, np.minimum(at[need], last)].astype(_U)
            at[need] += 1
        out[t] = own
        lanes.learn(symbol, own)
    return [known.values[out[:k, i]] for i, k in enumerate(counts)]


def checksum(data: bytes) -> int:
    return zlib.crc32(data)
