"""Arrays of integers as small binary values, for exchanges by sorted key."""

from __future__ import annotations

import functools


@functools.lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values) -> bytes:
    """Non-negative integers, as the byte planes they need, compressed."""
    import numpy as np

    a = np.ascontiguousarray(values, "<u8")
    top = int(a.max(initial=0))
    width = max(1, (top.bit_length() + 7) // 8)
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(a).to_bytes(8, "little") + bytes([width]) + _zstd()[0].compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes):
    import numpy as np

    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_zstd()[1].decompress(data[9:]), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1).astype(np.int64)


def pack_sorted(values) -> bytes:
    """Ascending non-negative integers, by their differences."""
    import numpy as np

    return pack(np.diff(values, prepend=0))


def unpack_sorted(data: bytes):
    import numpy as np

    return np.cumsum(unpack(data))


def pack_floats(values) -> bytes:
    """Doubles, exactly: the distinct ones and each value's place among them."""
    import numpy as np

    some, place = np.unique(np.asarray(values, np.float64), return_inverse=True)
    table = some.view("<u8").tobytes()
    return len(some).to_bytes(8, "little") + table + pack(place)


def unpack_floats(data: bytes):
    import numpy as np

    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data[8 : 8 + 8 * n], "<f8")[unpack(data[8 + 8 * n :])]


def raw(values, dtype: str = "<i8") -> bytes:
    import numpy as np

    return np.ascontiguousarray(values, dtype).tobytes()


def parts_of(keys: int, per_part: int, least: int) -> int:
    """Parts for an exchange of so many keys: bounded in size, and enough of them for the machines."""
    return max(1, min(least, keys // 1000), -(-keys // per_part))


@functools.lru_cache(maxsize=2)
def _begins(parts: int):
    import numpy as np

    return np.array([(k << 64) // parts for k in range(parts)], np.uint64)


def ranges_of(hashes, parts: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of ascending 64-bit hashes in equal ranges of them, for the parts that have some: work and messages never exceed the hashes, however many parts there are."""
    import numpy as np

    part = np.searchsorted(_begins(parts), hashes, "right") - 1
    at = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)], strict=True)) if len(at) else []
