"""Checksums and hashes of the byte formats, over Python bytes."""

from __future__ import annotations


def castagnoli_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_TABLE = castagnoli_table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _TABLE[(crc ^ b) & 255]
    return crc ^ 0xFFFFFFFF


def fnv1a(data: bytes) -> int:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_uvarint(data: bytes, at: int) -> tuple[int, int]:
    """(number, next place); ValueError if it is cut off or over 64 bits."""
    n = shift = 0
    while at < len(data):
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            if n >> 64:
                break
            return n, at
        shift += 7
    raise ValueError("a length is cut off")
