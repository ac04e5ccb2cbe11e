"""A sorted-string-table file: keys in order, blocks, sparse index, Bloom filter, footer.

    block*   entries (shared, rest, value length as varints; rest of the key; value),
             key prefixes shared with the entry before, every RESTART-th whole;
             zstd-compressed, followed by the crc32 of the compressed bytes
    index    per block: last key, first ordinal and token, offset, length
    bloom    bits of all keys
    footer   fixed size: offsets, counts, id width, magic

Keys are 9 bytes (a null flag and the big-endian identifier with its sign bit
flipped), so that byte order is identifier order with nulls first. Equal keys may
repeat. Values are token ids of 2 or 4 bytes each. A reader fetches byte ranges:
the footer, the index, then single blocks or runs of blocks.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
import zstandard

MAGIC = b"TSSTv002"
_FOOTER = struct.Struct("<QQQQQQII8s")
_ENTRY = struct.Struct("<QQQI")
_WORD = (1 << 64) - 1
RESTART = 16
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & _WORD).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & _WORD | 1


def _probes(a, b, bits):
    """Bit places of a key's hashes, in 64-bit arithmetic; for numbers or arrays of them."""
    return [(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)]


class Writer:
    """Appends entries in key order to a binary stream; holds one block, the sparse index and 16 bytes a key."""

    def __init__(self, out, width: int, block_bytes: int = 1 << 17, level: int = 1):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.codec = zstandard.ZstdCompressor(level=level)
        self.at = self.rows = self.tokens = self.in_block = 0
        self.block, self.index, self.hashes = bytearray(), [], array("Q")
        self.last = b""
        self.first = (0, 0)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: uint32 little-endian."""
        key = key_of(doc_id)
        if key < self.last:
            raise ValueError("keys out of order")
        shared = 0
        if self.in_block % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        value = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.rows, self.tokens, self.in_block = key, self.rows + 1, self.tokens + len(ids) // 4, self.in_block + 1
        self.hashes.extend(_hash(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.in_block:
            return
        data = self.codec.compress(bytes(self.block))
        data += struct.pack("<I", zlib.crc32(data))
        self.out.write(data)
        self.index.append((self.last, *self.first, self.at, len(data)))
        self.at += len(data)
        self.block, self.in_block, self.first = bytearray(), 0, (self.rows, self.tokens)

    def close(self) -> None:
        self._flush()
        index = b"".join(k + _ENTRY.pack(*rest) for k, *rest in self.index)
        bits = -(-max(64, BITS_PER_KEY * self.rows) // 8) * 8
        bloom = np.zeros(bits // 8, dtype=np.uint8)
        pairs = np.frombuffer(self.hashes, dtype=np.uint64).reshape(-1, 2)
        for p in _probes(pairs[:, 0], pairs[:, 1], bits):
            np.bitwise_or.at(bloom, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        self.out.write(index)
        self.out.write(bloom.tobytes())
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.rows, self.tokens, self.width, zlib.crc32(index), MAGIC))


class Reader:
    """Reads a file by ranges; ``read(offset, length)`` fetches bytes. Only footer and index are held."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        footer = read(size - _FOOTER.size, _FOOTER.size) if size >= _FOOTER.size else b""
        if footer[-8:] != MAGIC:
            raise ValueError("not a whole table file")
        start, length, self.bloom, self.bits, self.rows, self.tokens, self.width, crc, _ = _FOOTER.unpack(footer)
        index = read(start, length)
        if zlib.crc32(index) != crc:
            raise ValueError("not a whole table file")
        step = 9 + _ENTRY.size
        self.index = [(index[i : i + 9], *_ENTRY.unpack_from(index, i + 9)) for i in range(0, length, step)]
        self.codec = zstandard.ZstdDecompressor()

    @classmethod
    def of(cls, data: bytes) -> Reader:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _entries(self, stored: bytes) -> Iterator[tuple[bytes, bytes]]:
        """Keys and values of a block."""
        data = stored[:-4]
        if zlib.crc32(data) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError("a block is damaged")
        raw, at, key = self.codec.decompress(data), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def _ids(self, value: bytes) -> bytes:
        return value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def blocks(self, first: int, last: int) -> Iterator[list[tuple[int | None, int, bytes]]]:
        """Per block from ``first`` to ``last``: (doc_id, ids before it in this file, its ids as uint32 bytes) in key order."""
        for n in range(first, last + 1):
            _, _, before, offset, length = self.index[n]
            out = []
            for key, value in self._entries(self.read(offset, length)):
                ids = self._ids(value)
                out.append((id_of(key), before, ids))
                before += len(ids) // 4
            yield out

    def scan(self) -> Iterator[tuple[int | None, int, bytes]]:
        for block in self.blocks(0, len(self.index) - 1):
            yield from block

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every entry with this identifier: Bloom filter, binary search, one or more blocks."""
        key = key_of(doc_id)
        a, b = np.array(_hash(key), dtype=np.uint64)
        places = [int(p) for p in _probes(a, b, self.bits)] if self.rows else []
        if not places or any(not self.read(self.bloom + (p >> 3), 1)[0] >> (p & 7) & 1 for p in places):
            return []
        found = []
        for n in range(bisect.bisect_left(self.index, key, key=lambda e: e[0]), len(self.index)):
            entries = [(k, v) for k, v in self._entries(self.read(*self.index[n][3:])) if k >= key]
            found += [self._ids(v) for k, v in entries if k == key]
            if any(k > key for k, _ in entries):
                break
        return found
