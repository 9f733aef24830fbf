"""The two adaptive binary coders, advancing a batch of blocks in lockstep.

Blocks are lanes of numpy arrays, longest first, so that those still at work are always a prefix. The
run coder's contexts depend on symbols only, so all its decisions are laid out beforehand; the mixing
coder's state is kept as one table a lane. Shifts, rates and table shapes are the format's.
"""

from __future__ import annotations

import numpy as np

from blockloom.codec import FormatError

_U8, _TOP = 8, 1 << 24
#: Lanes worked on together: bounds the memory of the mixing coder's tables.
LANES = 512


class Output:
    """Bytes written lane by lane."""

    def __init__(self, lanes: int) -> None:
        self.data, self.size = np.zeros((lanes, 256), np.uint8), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray, values: np.ndarray) -> None:
        if not len(lanes):
            return
        if self.size[lanes].max() + 1 >= self.data.shape[1]:
            self.data = np.concatenate([self.data, np.zeros_like(self.data)], axis=1)
        self.data[lanes, self.size[lanes]] = values
        self.size[lanes] += 1

    def get(self, lane: int) -> bytes:
        return self.data[lane, : self.size[lane]].tobytes()


def by_length(blocks: list[bytes]) -> list[list[int]]:
    """Places of the blocks that are not empty, longest first, in groups of LANES."""
    order = sorted((i for i, b in enumerate(blocks) if b), key=lambda i: -len(blocks[i]))
    return [order[i : i + LANES] for i in range(0, len(order), LANES)]


def _matrix(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in blocks], np.int64)
    out = np.zeros((len(blocks), int(sizes.max()) if len(blocks) else 0), np.int64)
    for row, block in zip(out, blocks, strict=True):
        row[: len(block)] = np.frombuffer(block, np.uint8)
    return out, sizes


# --- mixing coder ---


class _Mixer:
    """Counters of order 0 and 1 and the map that refines their blend, one set a lane."""

    def __init__(self, lanes: int) -> None:
        self.zero = np.full(lanes * 256, 1 << 15, np.uint16)
        self.one = np.full(lanes << 16, 1 << 15, np.uint16)
        row = (np.arange(17, dtype=np.int64) << 12) - (np.arange(17) == 16)
        self.map = np.tile(row.astype(np.uint16), lanes * 512)
        self.last, self.older, self.run = (np.zeros(lanes, np.int64) for _ in range(3))
        self.lane = np.arange(lanes, dtype=np.int64)

    def begin(self, m: int) -> np.ndarray:
        """The run flags of the first m lanes; called once a byte."""
        self.run[:m] = np.where(self.last[:m] == self.older[:m], self.run[:m] + 1, 0)
        return (self.run[:m] > 2).astype(np.int64)

    def predict(self, m: int, node: np.ndarray, flag: np.ndarray) -> tuple:
        lane = self.lane[:m]
        z, o = lane * 256 + node, (lane << 16) + self.last[:m] * 256 + node
        a, b = self.zero[z].astype(np.int64), self.one[o].astype(np.int64)
        mixed = ((a + b) * 7 + 2 * self.one[(lane << 16) + self.older[:m] * 256 + node].astype(np.int64)) >> 4
        low = (lane * 512 + node * 2 + flag) * 17 + (mixed >> 12)
        c, d = self.map[low].astype(np.int64), self.map[low + 1].astype(np.int64)
        scaled = (c + (((d - c) * (mixed & 4095)) >> 12)) * 3 + mixed
        return scaled, (z, o, low, a, b, c, d)

    def update(self, slots: tuple, bit: np.ndarray) -> None:
        z, o, low, a, b, c, d = slots
        up = bit.astype(bool)
        for table, place, value, rate in ((self.zero, z, a, 2), (self.one, o, b, 4), (self.map, low, c, 6), (self.map, low + 1, d, 6)):
            table[place] = np.where(up, value + ((value ^ 0xFFFF) >> rate), value - (value >> rate)).astype(np.uint16)

    def end(self, m: int, byte: np.ndarray) -> None:
        self.older[:m] = self.last[:m]
        self.last[:m] = byte


def cm_encode(blocks: list[bytes]) -> list[bytes]:
    """Each block's mixing-coded payload; an empty block has the four closing bytes alone."""
    out = [b"\0\0\0\0"] * len(blocks)
    for group in by_length(blocks):
        data, sizes = _matrix([blocks[i] for i in group])
        model, written = _Mixer(len(group)), Output(len(group))
        low, high = np.zeros(len(group), np.int64), np.full(len(group), 0xFFFFFFFF, np.int64)
        for at in range(data.shape[1]):
            m = int(np.searchsorted(-sizes, -at, side="left"))
            byte, flag, node = data[:m, at], model.begin(m), np.ones(m, np.int64)
            for shift in range(7, -1, -1):
                bit = (byte >> shift) & 1
                scaled, slots = model.predict(m, node, flag)
                _narrow(low, high, m, scaled, bit)
                _shift_out(low, high, m, written)
                model.update(slots, bit)
                node = node * 2 + bit
            model.end(m, byte)
        for _ in range(4):
            written.put(np.arange(len(group)), low >> 24)
            low = (low << 8) & 0xFFFFFFFF
        for lane, i in enumerate(group):
            out[i] = written.get(lane)
    return out


def _narrow(low: np.ndarray, high: np.ndarray, m: int, scaled: np.ndarray, bit: np.ndarray) -> None:
    l, h = low[:m], high[:m]
    middle = l + (((h - l) * scaled) >> 18)
    low[:m] = np.where(bit != 0, l, middle + 1)
    high[:m] = np.where(bit != 0, middle, h)


def _shift_out(low: np.ndarray, high: np.ndarray, m: int, written: Output) -> None:
    lanes = np.flatnonzero(((low[:m] ^ high[:m]) >> 24) == 0)
    while len(lanes):
        written.put(lanes, low[lanes] >> 24)
        low[lanes] = (low[lanes] << 8) & 0xFFFFFFFF
        high[lanes] = ((high[lanes] << 8) & 0xFFFFFFFF) | 0xFF
        lanes = lanes[((low[lanes] ^ high[lanes]) >> 24) == 0]


def cm_decode(payloads: list[bytes], sizes: list[int]) -> list[bytes | FormatError]:
    """The blocks of payloads, given their sizes; an error stands in the place of a block that has one."""
    out: list[bytes | FormatError] = [b""] * len(payloads)
    for i, (payload, size) in enumerate(zip(payloads, sizes, strict=True)):
        if len(payload) < 4:
            out[i] = FormatError("truncated mixed payload")
        elif not size:
            out[i] = b"" if len(payload) == 4 else FormatError("mixed payload contains trailing bytes")
    todo = sorted((i for i in range(len(payloads)) if sizes[i] and len(payloads[i]) >= 4), key=lambda i: -sizes[i])
    for group in (todo[i : i + LANES] for i in range(0, len(todo), LANES)):
        data, filled = _matrix([payloads[i] for i in group])
        data = np.concatenate([data, np.zeros((len(group), 1), np.int64)], axis=1)
        want = np.array([sizes[i] for i in group], np.int64)
        model = _Mixer(len(group))
        low, high = np.zeros(len(group), np.int64), np.full(len(group), 0xFFFFFFFF, np.int64)
        code = data[:, 0] << 24 | data[:, 1] << 16 | data[:, 2] << 8 | data[:, 3]
        place = np.full(len(group), 4, np.int64)
        result = np.zeros((len(group), int(want.max())), np.uint8)
        for at in range(int(want.max())):
            m = int(np.searchsorted(-want, -at, side="left"))
            flag, node = model.begin(m), np.ones(m, np.int64)
            for _ in range(8):
                scaled, slots = model.predict(m, node, flag)
                middle = low[:m] + (((high[:m] - low[:m]) * scaled) >> 18)
                bit = (code[:m] <= middle).astype(np.int64)
                _narrow(low, high, m, scaled, bit)
                lanes = np.flatnonzero(((low[:m] ^ high[:m]) >> 24) == 0)
                while len(lanes):
                    low[lanes] = (low[lanes] << 8) & 0xFFFFFFFF
                    high[lanes] = ((high[lanes] << 8) & 0xFFFFFFFF) | 0xFF
                    code[lanes] = ((code[lanes] << 8) & 0xFFFFFFFF) | data[lanes, np.minimum(place[lanes], data.shape[1] - 1)]
                    place[lanes] += 1
                    lanes = lanes[((low[lanes] ^ high[lanes]) >> 24) == 0]
                model.update(slots, bit)
                node = node * 2 + bit
            byte = node & 255
            model.end(m, byte)
            result[:m, at] = byte
        for lane, i in enumerate(group):
            if place[lane] > filled[lane]:
                out[i] = FormatError("truncated mixed payload")
            elif place[lane] < filled[lane]:
                out[i] = FormatError("mixed payload contains trailing bytes")
            else:
                out[i] = result[lane, : want[lane]].tobytes()
    return out


# --- run coder ---

#: Symbols of run digits; a literal byte v is v + OFFSET.
RUN_A, RUN_B, RUN_C, RUN_D, OFFSET = 0, 1, 2, 3, 3
#: Where each kind of decision has its probabilities, and how many there are.
_IS_ZERO, _ZERO_VALUE, _IS_REPEAT, _REPEAT_VALUE, _TREE, _SLOTS = 0, 4, 8, 12, 16, 16 + 10 * 256
_START, _ZERO, _REPEAT, _LITERAL = 0, 1, 2, 3


def run_digits(length: int) -> list[int]:
    """Digits 0 and 1 of bijective base 2, the lowest first."""
    return [int(c) for c in reversed(bin(length + 1)[3:])]


def run_symbols(ranks: bytes, least_extension: int) -> list[int]:
    """The run symbols of recency ranks: repeats of least_extension or more become a literal and digits."""
    data = np.frombuffer(ranks, np.uint8)
    starts = np.flatnonzero(np.r_[True, data[1:] != data[:-1]]) if len(data) else np.zeros(0, np.int64)
    out: list[int] = []
    for value, length in zip(data[starts].tolist(), np.diff(np.r_[starts, len(data)]).tolist(), strict=True):
        if not value:
            out.extend(run_digits(length))
        elif length < least_extension:
            out.extend([value + OFFSET] * length)
        else:
            out.append(value + OFFSET)
            out.extend(RUN_C + d for d in run_digits(length - 1))
    return out


class _Grammar:
    """What the run coder knows from the symbols so far."""

    __slots__ = ("bucket", "digit", "extend", "last")

    def __init__(self) -> None:
        self.last, self.digit, self.bucket, self.extend = _START, 0, 0, False

    def place(self, kind: int) -> int:
        return min(self.digit + 1, 3) if self.last == kind else 0

    def tree(self) -> int:
        return _TREE + (self.bucket + 5 * (self.last == _ZERO)) * 256

    def take(self, symbol: int) -> None:
        kind = _ZERO if symbol <= RUN_B else _REPEAT if symbol <= RUN_D else _LITERAL
        if kind == _LITERAL:
            value = symbol - OFFSET
            self.bucket = value if value <= 3 else 4 if value <= 15 else 0
            self.extend = True
        else:
            self.digit = self.digit + 1 if self.last == kind else 0
            self.extend = self.extend and kind == _REPEAT
        self.last = kind


def decisions(symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The coder's decisions for a run of symbols: which probability each one uses, and its bit."""
    state, slots, bits = _Grammar(), [], []
    for symbol in symbols:
        digit = symbol <= RUN_B
        slots.append(_IS_ZERO + state.last)
        bits.append(not digit)
        if digit:
            slots.append(_ZERO_VALUE + state.place(_ZERO))
            bits.append(symbol == RUN_B)
        else:
            literal = symbol > RUN_D
            if state.extend:
                at = state.place(_REPEAT)
                slots.append(_IS_REPEAT + at)
                bits.append(literal)
                if not literal:
                    slots.append(_REPEAT_VALUE + at)
                    bits.append(symbol == RUN_D)
            if literal:
                tree, value, node = state.tree(), symbol - OFFSET, 1
                for shift in range(7, -1, -1):
                    bit = value >> shift & 1
                    slots.append(tree + node)
                    bits.append(bit)
                    node = node * 2 + bit
        state.take(symbol)
    return np.array(slots, np.int64), np.array(bits, np.int64)


def rc_encode(streams: list[list[int]]) -> list[bytes]:
    """Each symbol stream's range-coded payload; an empty stream has none."""
    out = [b""] * len(streams)
    plans = [decisions(s) for s in streams]
    order = sorted((i for i, p in enumerate(plans) if len(p[0])), key=lambda i: -len(plans[i][0]))
    for group in (order[i : i + LANES] for i in range(0, len(order), LANES)):
        sizes = np.array([len(plans[i][0]) for i in group], np.int64)
        slot, bit = (np.zeros((len(group), int(sizes[0])), np.int64) for _ in range(2))
        for row, i in enumerate(group):
            slot[row, : sizes[row]], bit[row, : sizes[row]] = plans[i]
        table = np.full((len(group), _SLOTS), 1 << 11, np.int64)
        low, width = np.zeros(len(group), np.int64), np.full(len(group), 0xFFFFFFFF, np.int64)
        held, waiting, written = np.zeros(len(group), np.int64), np.ones(len(group), np.int64), Output(len(group))
        lane = np.arange(len(group))

        def carry_out(lanes: np.ndarray) -> None:
            ready = lanes[((low[lanes] & 0xFFFFFFFF) < 0xFF000000) | (low[lanes] >> 32 != 0)]  # noqa: B023
            byte, left = held[ready], ready  # noqa: B023
            while len(left):
                written.put(left, (byte + (low[left] >> 32)) & 255)  # noqa: B023
                waiting[left] -= 1  # noqa: B023
                left = left[waiting[left] > 0]  # noqa: B023
                byte = np.full(len(left), 255)
            held[ready] = low[ready] >> 24 & 255  # noqa: B023
            waiting[lanes] += 1  # noqa: B023
            low[lanes] = (low[lanes] & 0x00FFFFFF) << 8  # noqa: B023

        for at in range(int(sizes[0])):
            m = int(np.searchsorted(-sizes, -at, side="left"))
            one, s = bit[:m, at] != 0, slot[:m, at]
            p = table[lane[:m], s]
            bound = (width[:m] >> 12) * p
            low[:m] += np.where(one, bound, 0)
            width[:m] = np.where(one, width[:m] - bound, bound)
            table[lane[:m], s] = np.where(one, p - (p >> 5), p + ((4096 - p) >> 5))
            lanes = np.flatnonzero(width[:m] < _TOP)
            while len(lanes):
                width[lanes] = (width[lanes] << 8) & 0xFFFFFFFF
                carry_out(lanes)
                lanes = lanes[width[lanes] < _TOP]
        for _ in range(5):
            carry_out(lane)
        for row, i in enumerate(group):
            out[i] = written.get(row)
    return out


def rc_decode(payload: bytes, symbol_count: int, size: int) -> bytes:
    """The recency ranks of a payload of so many symbols that stand for `size` bytes."""
    if not symbol_count:
        if payload or size:
            raise FormatError("empty run stream with content")
        return b""
    if len(payload) < 5:
        raise FormatError("truncated range-coded stream")
    code, width, place, table = int.from_bytes(payload[1:5], "big"), 0xFFFFFFFF, 5, [1 << 11] * _SLOTS
    n, state = len(payload), _Grammar()

    def next_bit(slot: int) -> int:
        nonlocal code, width, place
        p = table[slot]
        bound = (width >> 12) * p
        if code < bound:
            width, bit = bound, 0
            table[slot] = p + ((4096 - p) >> 5)
        else:
            code, width, bit = code - bound, width - bound, 1
            table[slot] = p - (p >> 5)
        while width < _TOP:
            if place >= n:
                raise FormatError("truncated range-coded stream")
            width, code = width << 8 & 0xFFFFFFFF, (code << 8 | payload[place]) & 0xFFFFFFFF
            place += 1
        return bit

    out, value, run, unit = bytearray(), 0, 0, 1
    for _ in range(symbol_count):
        if not next_bit(_IS_ZERO + state.last):
            symbol = RUN_B if next_bit(_ZERO_VALUE + state.place(_ZERO)) else RUN_A
        elif state.extend and not next_bit(_IS_REPEAT + state.place(_REPEAT)):
            symbol = RUN_D if next_bit(_REPEAT_VALUE + state.place(_REPEAT)) else RUN_C
        else:
            node, tree = 1, state.tree()
            while node < 256:
                node = node * 2 + next_bit(tree + node)
            if node == 256:
                raise FormatError("invalid literal in range-coded stream")
            symbol = node - 256 + OFFSET
        state.take(symbol)
        if symbol > RUN_D:
            out += bytes([value]) * run
            if len(out) >= size:
                raise FormatError("run coding output exceeds the block size")
            value, run, unit = symbol - OFFSET, 0, 1
            out.append(value)
            continue
        if symbol <= RUN_B and value:
            out += bytes([value]) * run
            value, run, unit = 0, 0, 1
        run += unit << (symbol & 1)
        unit *= 2
        if run > size - len(out):
            raise FormatError("run length exceeds the block size")
    out += bytes([value]) * run
    if len(out) != size:
        raise FormatError("run coding output has an unexpected size")
    if place != n:
        raise FormatError("range-coded stream contains trailing bytes")
    return bytes(out)
