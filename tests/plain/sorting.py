"""Block sorting, recency ranks and long-repeat collapsing: the stages before entropy coding."""

from __future__ import annotations

import numpy as np

from blockloom.codec import FormatError

#: Fixed values of the format: least repeat that collapses, bytes of context, and the slot hash's multiplier.
LEAST_MATCH, CONTEXT, SLOT_FACTOR = 128, 8, 0x9E3779B97F4A7C15


def suffix_arrays(blocks: list[bytes]) -> list[np.ndarray]:
    """Each block's suffixes in order, a suffix before all that it begins; all blocks are doubled together."""
    sizes = np.array([len(b) for b in blocks], np.int64)
    n = int(sizes.sum())
    if not n:
        return [np.zeros(0, np.int64) for _ in blocks]
    data = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(blocks)), sizes)
    ends = np.cumsum(sizes)[owner]
    rank, reach = owner * 256 + data, 1
    order = np.argsort(rank, kind="stable")
    rank, sizes_of = _renumber(rank, order)
    active = np.flatnonzero(sizes_of > 1)
    while len(active):
        after = active + reach
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[active]
        inner = np.lexsort((second, first))
        first, second = first[inner], second[inner]
        starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        counts = np.diff(np.r_[starts, len(inner)])
        base = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        offset = np.arange(len(inner)) - np.repeat(base, np.diff(np.r_[base, len(inner)]))
        rank = rank.copy()
        rank[active[inner]] = first + np.repeat(offset[starts], counts)
        active = active[inner][np.repeat(counts > 1, counts)]
        reach *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    bounds = np.r_[0, np.cumsum(sizes)]
    return [order[a:b] - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _renumber(rank: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each rank's first place in the order, and how many share it."""
    ordered, n = rank[order], len(rank)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    counts = np.diff(np.r_[starts, n])
    out, size = np.empty(n, np.int64), np.empty(n, np.int64)
    out[order], size[order] = np.repeat(starts, counts), np.repeat(counts, counts)
    return out, size


def bwt_encode(blocks: list[bytes]) -> list[tuple[bytes, int]]:
    """For each block the last column without the sentinel, and the sentinel's row: 1 to n, 0 for an empty block."""
    out = []
    for block, order in zip(blocks, suffix_arrays(blocks), strict=True):
        if not block:
            out.append((b"", 0))
            continue
        data = np.frombuffer(block, np.uint8)
        whole = int(np.flatnonzero(order == 0)[0])
        before = np.delete(order, whole) - 1
        out.append((bytes([block[-1]]) + data[before].tobytes(), whole + 1))
    return out


def bwt_decode(column: bytes, primary: int) -> bytes:
    """The block of a last column and the sentinel's row."""
    n = len(column)
    if primary > n or (primary < 1 and n) or primary < 0:
        raise FormatError("primary index out of range")
    data = np.frombuffer(column, np.uint8)
    rank = np.empty(n, np.int64)
    rank[np.argsort(data, kind="stable")] = np.arange(1, n + 1)
    # rows count the sentinel's row, the column doesn't
    follow = (rank - (rank > primary)).tolist()
    out, place = bytearray(n), 0
    row = rank.tolist()
    for i in range(n - 1, -1, -1):
        out[i] = column[place]
        at = row[place]
        if at == primary:
            if i:
                raise FormatError("primary index does not fit the block")
            break
        place = follow[place]
    return bytes(out)


def mtf_encode(data: bytes) -> bytes:
    """Recency ranks of the bytes; at first a byte's rank is its value."""
    recent, out = list(range(256)), bytearray(len(data))
    for i, byte in enumerate(data):
        if recent[0] != byte:
            rank = recent.index(byte)
            out[i] = rank
            del recent[rank]
            recent.insert(0, byte)
    return bytes(out)


def mtf_decode(ranks: bytes) -> bytes:
    """The bytes of recency ranks."""
    recent, out = list(range(256)), bytearray(len(ranks))
    for i, rank in enumerate(ranks):
        byte = recent[rank]
        out[i] = byte
        if rank:
            del recent[rank]
            recent.insert(0, byte)
    return bytes(out)


def rarest_byte(data: bytes) -> int:
    """The byte met least, absent ones included; the least of equals."""
    return int(np.argmin(np.bincount(np.frombuffer(data, np.uint8), minlength=256)))


def slots(data: bytes, bits: int) -> np.ndarray:
    """The hash slot of the 8 bytes before each position from 8 on."""
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), CONTEXT)[:-1] if len(data) > CONTEXT else np.zeros((0, CONTEXT), np.uint8)
    contexts = np.ascontiguousarray(windows).view(">u8").ravel().astype(np.uint64)
    return (contexts * np.uint64(SLOT_FACTOR) >> np.uint64(64 - bits)).astype(np.int64)


def predictors(data: bytes, bits: int) -> np.ndarray:
    """For each position the last earlier one in its slot, -1 for none."""
    out = np.full(len(data), -1, np.int64)
    slot = slots(data, bits)
    order = np.argsort(slot, kind="stable")
    same = slot[order][1:] == slot[order][:-1]
    out[order[1:][same] + CONTEXT] = order[:-1][same] + CONTEXT
    return out


def match_length(data: bytes, source: int, at: int) -> int:
    """How far the bytes at two places agree, to the end of the data at most."""
    n, length, step = len(data), 0, LEAST_MATCH
    while at + length < n:
        size = min(step, n - at - length)
        if data[source + length : source + length + size] == data[at + length : at + length + size]:
            length += size
            step *= 2
        elif size == 1:
            break
        else:
            step = size // 2
    return length


def put_varint(value: int) -> bytes:
    """Seven bits a byte, the low ones first."""
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def lzp_encode(data: bytes, bits: int = 20) -> bytes | None:
    """The data with repeats of LEAST_MATCH bytes or more collapsed, or None where that gains nothing."""
    n = len(data)
    if n <= LEAST_MATCH + CONTEXT:
        return None
    marker = rarest_byte(data)
    guess = predictors(data, bits)
    likely = np.flatnonzero((guess >= 0) & (np.arange(n) + LEAST_MATCH <= n)).tolist()
    out, at = bytearray([marker]), 0

    def literals(stop: int) -> None:
        part = data[at:stop]
        out.extend(part.replace(bytes([marker]), bytes([marker, 0])))

    for place in likely:
        if place < at:
            continue
        source = int(guess[place])
        if data[source : source + LEAST_MATCH] != data[place : place + LEAST_MATCH]:
            continue
        literals(place)
        length = match_length(data, source, place)
        out.append(marker)
        out += put_varint(length - LEAST_MATCH + 1)
        at = place + length
    literals(n)
    return bytes(out) if len(out) < n else None


def lzp_decode(data: bytes, size: int, bits: int = 20) -> bytes:
    """The `size` bytes that a collapsed stream stands for."""
    if not data:
        raise FormatError("empty collapsed stream")
    marker, place, n = data[0], 1, len(data)
    out, table, shift, mask, known = bytearray(), {}, 64 - bits, (1 << 64) - 1, CONTEXT

    def enter(stop: int) -> None:
        """Notes positions up to and without `stop` in their slots."""
        nonlocal known
        while known < stop:
            context = int.from_bytes(out[known - CONTEXT : known], "big")
            table[(context * SLOT_FACTOR & mask) >> shift] = known
            known += 1

    while len(out) < size:
        if place >= n:
            raise FormatError("truncated collapsed stream")
        byte = data[place]
        place += 1
        if byte != marker:
            stop = data.find(marker, place)
            stop = min(n if stop < 0 else stop, place + size - len(out) - 1)
            out += data[place - 1 : stop]
            place = stop
            continue
        value = digits = 0
        while True:
            if place >= n or digits == 6:
                raise FormatError("bad length in a collapsed stream")
            byte = data[place]
            value |= (byte & 127) << 7 * digits
            digits, place = digits + 1, place + 1
            if byte < 128:
                break
        if not value:
            out.append(marker)
            continue
        at, length = len(out), value + LEAST_MATCH - 1
        enter(at)
        source = None
        if at >= CONTEXT:
            context = int.from_bytes(out[at - CONTEXT : at], "big")
            source = table.get((context * SLOT_FACTOR & mask) >> shift)
        if source is None or length > size - at:
            raise FormatError("match out of range in a collapsed stream")
        while length > 0:
            part = out[source : source + length]
            out += part
            source, length = source + len(part), length - len(part)
    if place != n:
        raise FormatError("bytes after the end of a collapsed stream")
    return bytes(out)
