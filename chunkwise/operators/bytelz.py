"""The default codec: a byte-wise Lempel-Ziv format with short and long matches.

``parse`` finds matches, ``emit`` writes them; the estimate that decides whether a
buffer is worth it costs the same parse without writing. Hashes of all positions are
taken at once, so the loop handles integers only.

Fixed values of the format stand at the top; the finder's choices (hash sizes, probed
part, least ratios) are part of it too, so that sizes agree with other writers'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Fixed values.
LITERALS = 32  # most bytes of a literal run
NEAR, FAR = 8191, 73725  # first distance of long matches, first that is too far
HASH_FACTOR = 2654435761
HASH_BITS = {0: 0, 1: 12, 2: 13}  # of each level; 14 for the others
PROBED = (8, 8, 4, 4, 2, 2, 2, 1, 1, 1)  # one part in so many is probed, at the end of the buffer
LEAST_RATIO = (0.0, 2.0, 1.5, 1.2, 1.2, 1.2, 1.2, 1.15, 1.1, 1.0)
LEAST_INPUT, LEAST_ROOM, LEAST_PROBE, TAIL = 16, 66, 13, 12
MARK = 0x20  # in the first byte

Match = tuple[int, int, int]  # where it begins, length beyond two, distance - 1


def _hashes(words: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(words), np.int64)
    return ((words.astype(np.uint64) * np.uint64(HASH_FACTOR)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - bits)


def _first_difference(data: bytes, a: int, b: int, stop: int) -> int:
    """The first place from b on, up to ``stop``, that differs from its partner from a on."""
    step = 16
    while b + step <= stop and data[a : a + step] == data[b : b + step]:
        a, b, step = a + step, b + step, min(4096, step * 2)
    while b < stop:
        n = min(step, stop - b)
        if n <= 8:
            for i in range(n):
                if data[a + i] != data[b + i]:
                    return b + i
            a, b = a + n, b + n
        elif data[a : a + n] == data[b : b + n]:
            a, b = a + n, b + n
        else:
            step = n // 2
    return stop


class Finder:
    """Finds matches in one buffer at one level."""

    def __init__(self, data: bytes, level: int) -> None:
        self.data, self.level = data, level
        self.bits = HASH_BITS.get(level, 14)
        raw = np.frombuffer(data, np.uint8).astype(np.uint32)
        words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        self.words, self.slots = words.tolist(), _hashes(words, self.bits).tolist()
        self.second = _hashes(words >> 8, self.bits).tolist() if level == 9 else None

    def parse(self, base: int, end: int, skip: int, probing: bool) -> Iterator[Match]:
        """Matches among ``base`` to ``end``; the first ``skip`` bytes are literals.

        Yields a last (place, -1, -1) that tells how far it came.
        """
        data, words, slots, second = self.data, self.words, self.slots, self.second
        last, at = end - 1, base + skip
        seen = [base] * (1 << self.bits)
        while at < end - TAIL:
            slot = slots[at]
            ref = seen[slot]
            seen[slot] = at
            if ref != at and at - ref < FAR and words[ref] == words[at]:
                stop = min(_first_difference(data, ref + 4, at + 4, last) + 1, last)
                length, distance = stop - 4 - at, at - ref - 1
                if length >= 4 and (probing or length > 5 or distance < NEAR):
                    yield at, length, distance
                    at += length
                    if at + 4 <= len(data):
                        seen[slots[at]] = at
                        if second and not probing:
                            seen[second[at]] = at + 1
                    at += 2
                    continue
            at += 1
        yield at, -1, -1

    def ratio(self) -> float:
        """Bytes read for a byte written, estimated over a part of the buffer."""
        part = len(self.data) // PROBED[self.level]
        base = len(self.data) - part
        size = min(part, 1 << self.bits)
        if size < LEAST_PROBE:
            return float("inf")
        cost, free, place = 5, 4, base  # free: literals in the open run
        for at, length, distance in self.parse(base, base + size, 0, True):
            literals = at - place
            cost += literals + (free + literals) // LITERALS
            free = (free + literals) % LITERALS
            if length < 0:
                return (at - base) / cost if cost > 0 else float("inf")
            cost += (2 if distance < NEAR else 4) + ((length - 7) // 255 + 1 if length >= 7 else 0) + 1 - (free == 0)
            free, place = 0, at + length + 2
        raise AssertionError


def _literals(out: bytearray, run: bytes) -> None:
    for i in range(0, len(run), LITERALS):
        part = run[i : i + LITERALS]
        out.append(len(part) - 1)
        out += part


def _match(out: bytearray, length: int, distance: int) -> None:
    far = distance >= NEAR
    high = 31 if far else distance >> 8
    out.append((min(length, 7) << 5) + high)
    if length >= 7:
        more, rest = divmod(length - 7, 255)
        out += b"\xff" * more
        out.append(rest)
    if far:
        out.append(255)
        out += (distance - NEAR).to_bytes(2, "big")
    else:
        out.append(distance & 255)


def compress(data: bytes, level: int, room: int) -> bytes | None:
    """The compressed bytes, or None where it isn't worth it or takes over ``room`` bytes."""
    if len(data) < LEAST_INPUT or room < LEAST_ROOM:
        return None
    finder = Finder(data, level)
    if finder.ratio() < LEAST_RATIO[level]:
        return None
    out, place = bytearray(), 0
    for at, length, distance in finder.parse(0, len(data), 4, False):
        if length < 0:
            _literals(out, data[place:])
        else:
            _literals(out, data[place:at])
            _match(out, length, distance)
            place = at + length + 2
        if len(out) > room:
            return None
    out[0] |= MARK
    return bytes(out)


def decompress(data: bytes, size: int) -> bytes | None:
    """``size`` bytes, or None where the data is broken."""
    out, i, n = bytearray(), 1, len(data)
    if not n:
        return None if size else b""
    control = data[0] & (MARK - 1)
    try:
        while True:
            if control < LITERALS:
                run = data[i : i + control + 1]
                if len(run) <= control:
                    return None
                out += run
                i += control + 1
            else:
                length, distance = control >> 5, (control & 31) << 8
                if length == 7:
                    while True:
                        length += data[i]
                        i += 1
                        if data[i - 1] != 255:
                            break
                length += 2
                low = data[i]
                i += 1
                if low == 255 and distance == 31 << 8:
                    distance = NEAR + (data[i] << 8 | data[i + 1])
                    i += 2
                else:
                    distance += low
                start = len(out) - distance - 1
                if start < 0 or len(out) + length > size:
                    return None
                if distance + 1 >= length:
                    out += out[start : start + length]
                else:
                    unit = bytes(out[start:])
                    out += (unit * (length // len(unit) + 1))[:length]
            if i >= n:
                break
            control = data[i]
            i += 1
    except IndexError:
        return None
    return bytes(out) if len(out) == size else None
