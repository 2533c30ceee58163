"""Files of any size as if they were bytes: only the parts that are asked for are read. No Spark here."""

from __future__ import annotations

import io
import struct

#: Bytes that a read takes at least, for what is asked for next.
AHEAD = 256 << 10
#: Bytes that a search looks at in one go.
STRETCH = 4 << 20


class Ranged:
    """One file, or several as one, that can seek: slices, ``find`` and ``rfind`` as of bytes, through one small buffer."""

    def __init__(self, *files):
        self.files, self.ends, self.at, self.held = files, [], 0, b""
        for f in files:
            f.seek(0, 2)
            self.ends.append((self.ends[-1] if self.ends else 0) + f.tell())

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, key):
        if not isinstance(key, slice):
            at = key + len(self) if key < 0 else key
            if not 0 <= at < len(self):
                raise IndexError(key)
            return self._bytes(at, at + 1)[0]
        low, high, step = key.indices(len(self))
        return self._bytes(low, high)[::step]

    def _bytes(self, low: int, high: int) -> bytes:
        if high <= low:
            return b""
        if not (self.at <= low and high <= self.at + len(self.held)):
            data = self._read(low, max(high, min(low + AHEAD, len(self))))
            if len(data) > STRETCH:
                return data[: high - low]
            self.at, self.held = low, data
        return self.held[low - self.at : high - self.at]

    def _read(self, low: int, high: int) -> bytes:
        parts, start = [], 0
        for f, end in zip(self.files, self.ends, strict=True):
            if low < end and high > start:
                f.seek(max(low, start) - start)
                want = min(high, end) - max(low, start)
                while want > 0 and (piece := f.read(want)):
                    parts.append(piece)
                    want -= len(piece)
            start = end
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def startswith(self, mark: bytes) -> bool:
        return self[: len(mark)] == mark

    def find(self, mark: bytes, low: int = 0, high: int | None = None) -> int:
        low, high, _ = slice(low, high).indices(len(self))
        while low < high:
            stop = min(low + STRETCH, high)
            at = self._bytes(low, stop).find(mark)
            if at >= 0:
                return low + at
            if stop == high:
                break
            low = stop - len(mark) + 1
        return -1

    def rfind(self, mark: bytes, low: int = 0, high: int | None = None) -> int:
        low, high, _ = slice(low, high).indices(len(self))
        while low < high:
            begin = max(low, high - AHEAD)
            at = self._bytes(begin, high).rfind(mark)
            if at >= 0:
                return begin + at
            if begin == low:
                break
            high = begin + len(mark) - 1
        return -1


class _View(io.RawIOBase):
    """A ``Ranged`` as a file."""

    def __init__(self, data: Ranged):
        self.data, self.place = data, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, to: int, whence: int = 0) -> int:
        self.place = max(0, to + (0, self.place, len(self.data))[whence])
        return self.place

    def read(self, n: int | None = -1) -> bytes:
        out = self.data[self.place : None if n is None or n < 0 else self.place + n]
        self.place += len(out)
        return out

    def readinto(self, buffer) -> int:
        out = self.read(len(buffer))
        buffer[: len(out)] = out
        return len(out)


def as_file(data: bytes | Ranged):
    return _View(data) if isinstance(data, Ranged) else io.BytesIO(data)


def unpack_at(shape: str, data: bytes | Ranged, at: int) -> tuple:
    return struct.unpack(shape, data[at : at + struct.calcsize(shape)])
