"""Keccak-256, the sponge with the padding from before its standardisation as SHA-3."""

from __future__ import annotations

_RATE, _MASK = 136, (1 << 64) - 1


def _constants() -> tuple[list[int], list[tuple[int, int, int]]]:
    """Round constants from the degree-8 shift register, and (from lane, to lane, rotation) of the combined rho and pi steps."""
    rounds, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if r & 1:
                c |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        rounds.append(c)
    moves, x, y = [(0, 0, 0)], 1, 0
    for t in range(24):
        moves.append((x + 5 * y, y + 5 * ((2 * x + 3 * y) % 5), (t + 1) * (t + 2) // 2 % 64))
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, moves


_ROUNDS, _MOVES = _constants()


def _permute(a: list[int]) -> list[int]:
    for constant in _ROUNDS:
        column = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        mixed = [column[x - 1] ^ ((column[(x + 1) % 5] << 1 | column[(x + 1) % 5] >> 63) & _MASK) for x in range(5)]
        b = [0] * 25
        for source, target, n in _MOVES:
            v = a[source] ^ mixed[source % 5]
            b[target] = (v << n | v >> (64 - n)) & _MASK
        a = [b[k] ^ (~b[k - k % 5 + (k + 1) % 5] & b[k - k % 5 + (k + 2) % 5] & _MASK) for k in range(25)]
        a[0] ^= constant
    return a


def keccak256(data: bytes, domain: int = 0x01) -> bytes:
    """The 32-byte digest; ``domain`` 0x06 gives SHA3-256."""
    padded = bytearray(data) + bytes([domain]) + bytes(-(len(data) + 1) % _RATE)
    padded[-1] |= 0x80
    state = [0] * 25
    for at in range(0, len(padded), _RATE):
        for k in range(_RATE // 8):
            state[k] ^= int.from_bytes(padded[at + 8 * k : at + 8 * k + 8], "little")
        state = _permute(state)
    return b"".join(lane.to_bytes(8, "little") for lane in state[:4])
