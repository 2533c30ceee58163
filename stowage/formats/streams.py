"""Compressed streams: decoders of all members that give pieces of bounded size, and the single-stream archives made of one."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import zlib
from collections.abc import Iterator

from stowage.errors import ArchiveError
from stowage.formats.model import READ_LIMIT, Archive, Entry, need

PIECE = 2048
#: Bytes that a decoder takes and gives at a time, and that a block of LZ4 may decode to.
IN, OUT, LZ4_BLOCK = 1 << 18, 1 << 20, 64 << 20
# Suffix and method of each single stream.
STREAMS = {"Gzip": ("gz", "Deflate"), "Bzip2": ("bz2", "Bzip2"), "Xz": ("xz", "Lzma2"), "Lzma": ("lzma", "Lzma"), "Zstd": ("zst", "Zstd"), "Lz4": ("lz4", "Store")}


def _over(size: int, limit: int) -> None:
    if size > limit:
        raise ArchiveError("ZipBombSuspected", f"more than {limit} bytes")


def _whole(pieces: Iterator[bytes], limit: int) -> bytes:
    out = bytearray()
    for piece in pieces:
        out += piece
        _over(len(out), limit)
    return bytes(out)


def _members(data, make, spare: str, pad: bool) -> Iterator[bytes]:
    """Member after member of decoders of the ``decompress(data, max_length)`` shape; stops at trailing bytes that start none."""
    at, first = 0, True
    while at < len(data):
        if pad and not first:
            while at < len(data) and data[at] == 0:
                at += 1
            if at == len(data):
                break
        d, fed = make(), at
        try:
            while not d.eof:
                rest = getattr(d, "unconsumed_tail", b"")
                if not rest and getattr(d, "needs_input", True):
                    rest = data[fed : fed + IN]
                    fed += len(rest)
                    over = not rest
                else:
                    over = False
                piece = d.decompress(rest, OUT)
                if over and not piece and not d.eof:
                    raise ArchiveError("Corrupted", "compressed data ends early")
                if piece:
                    yield piece
        except (OSError, lzma.LZMAError, zlib.error, EOFError, ValueError) as e:
            if not first:  # bytes after the last member that are none
                return
            raise ArchiveError("Corrupted", f"{type(e).__name__}: {e}") from e
        at, first = fed - len(getattr(d, spare)), False
    need(not first, "empty stream")


def gz_pieces(data) -> Iterator[bytes]:
    return _members(data, lambda: zlib.decompressobj(31), "unused_data", True)


def bz2_pieces(data) -> Iterator[bytes]:
    return _members(data, bz2.BZ2Decompressor, "unused_data", False)


def xz_pieces(data) -> Iterator[bytes]:
    return _members(data, lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), "unused_data", True)


def lzma_pieces(data) -> Iterator[bytes]:
    """One stream of the old format; without an end mark its stated size is the end."""
    d, at, size = lzma.LZMADecompressor(lzma.FORMAT_ALONE), 0, 0
    stated = int.from_bytes(data[5:13], "little")
    try:
        while not d.eof:
            rest = data[at : at + IN] if d.needs_input else b""
            at += len(rest)
            over = d.needs_input and not rest
            piece = b"" if over else d.decompress(rest, OUT)
            size += len(piece)
            if piece:
                yield piece
            if over:
                break
    except (lzma.LZMAError, EOFError) as e:
        raise ArchiveError("Corrupted", f"LZMAError: {e}") from e
    need(d.eof or size == stated, "compressed data ends early")


def zstd_pieces(data) -> Iterator[bytes]:
    """All frames; skippable ones are skipped. Fed in small pieces, as one block may be a thousand times its bytes."""
    import zstandard

    at, any_ = 0, False
    need(len(data) >= 4, "no frame")
    while at < len(data):
        head = data[at : at + 8]
        if head[1:4] == b"\x2a\x4d\x18" and head[0] & 0xF0 == 0x50:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        d = zstandard.ZstdDecompressor(max_window_size=2**31).decompressobj()
        try:
            while not d.eof:
                need(at < len(data), "compressed data ends early")
                piece = d.decompress(data[at : at + PIECE])
                at = min(at + PIECE, len(data))
                if piece:
                    any_ = True
                    yield piece
        except zstandard.ZstdError as e:
            if any_ and data[at : at + 4] != b"\x28\xb5\x2f\xfd":  # bytes behind the last frame
                return
            raise ArchiveError("Corrupted", f"ZstdError: {e}") from e
        at -= len(d.unused_data)


def xxh32(data: bytes) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(data)


def lz4_block(data: bytes, before: bytes, limit: int) -> bytes:
    """One block of sequences: literals, then a match in what came before."""
    out, at, n = bytearray(before), 0, len(data)
    base = len(out)

    def more(length: int) -> int:
        nonlocal at
        if length == 15:
            while True:
                need(at < n, "lz4 length cut off")
                b = data[at]
                at += 1
                length += b
                if b < 255:
                    break
        return length

    while at < n:
        token = data[at]
        at += 1
        length = more(token >> 4)
        need(at + length <= n, "lz4 literals cut off")
        out += data[at : at + length]
        at += length
        _over(len(out) - base, limit)
        if at == n:
            break
        need(at + 2 <= n, "lz4 offset cut off")
        offset = data[at] | data[at + 1] << 8
        at += 2
        length = more(token & 15) + 4
        need(0 < offset <= len(out), "lz4 offset outside the window")
        _over(len(out) - base + length, limit)
        start = len(out) - offset
        while length > 0:
            piece = out[start : start + min(length, len(out) - start)]
            out += piece
            length -= len(piece)
            start += len(piece)
    return bytes(out[base:])


def lz4_pieces(data) -> Iterator[bytes]:
    """All frames, linked or independent blocks, with their checksums; skippable frames are skipped."""
    import xxhash

    at, any_ = 0, False
    need(len(data) >= 7, "no lz4 frame")
    while at + 4 <= len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            continue
        if magic != 0x184D2204:
            need(any_ or at > 0, "no lz4 frame")
            break
        need(at + 5 <= len(data), "lz4 frame cut off")
        flags, start = data[at + 4], at + 4
        need(flags >> 6 == 1, "lz4 frame version")
        at += 6 + 8 * bool(flags & 8) + 4 * bool(flags & 1)
        need(at < len(data) and data[at] == xxh32(data[start:at]) >> 8 & 255, "lz4 header checksum")
        need(not flags & 1, "lz4 dictionary", "FeatureDisabled")
        at += 1
        total, window = xxhash.xxh32(), b""
        while True:
            need(at + 4 <= len(data), "lz4 block cut off")
            size = int.from_bytes(data[at : at + 4], "little")
            at += 4
            if size == 0:
                break
            stored, size = size >> 31, size & 0x7FFFFFFF
            block = data[at : at + size]
            need(len(block) == size, "lz4 block cut off")
            at += size
            if flags & 16:
                need(int.from_bytes(data[at : at + 4], "little") == xxh32(block), "lz4 block checksum")
                at += 4
            piece = block if stored else lz4_block(block, b"" if flags & 32 else window, LZ4_BLOCK)
            window = (window + piece)[-65536:]
            total.update(piece)
            any_ = any_ or bool(piece)
            yield piece
        if flags & 4:
            need(int.from_bytes(data[at : at + 4], "little") == total.intdigest(), "lz4 content checksum")
            at += 4


PIECES = {"Gzip": gz_pieces, "Bzip2": bz2_pieces, "Xz": xz_pieces, "Lzma": lzma_pieces, "Zstd": zstd_pieces, "Lz4": lz4_pieces}


def decoded(data, kind: str, limit: int = READ_LIMIT) -> bytes:
    """The whole stream; more than ``limit`` bytes is an error of the bomb kind."""
    return _whole(PIECES[kind](data), limit)


class Decoded(io.RawIOBase):
    """A stream's content as a file that reads forward in pieces; a step back starts the stream anew.

    Nothing is held but a piece. Content that is more than ``ratio`` times its stream, from ``floor`` bytes on, is an
    error of the bomb kind.
    """

    def __init__(self, make, packed: int, ratio: int = 1000, floor: int = 1 << 30):
        self.make, self.packed, self.ratio, self.floor = make, packed, ratio, floor
        self._start()

    def _start(self) -> None:
        self.pieces, self.held, self.place = self.make(), b"", 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def _take(self, n: int) -> bytes:
        """Up to ``n`` bytes of what is held, or of the next piece; none at the end."""
        while not self.held:
            self.held = next(self.pieces, None)
            if self.held is None:
                self.held = b""
                return b""
        out, self.held = self.held[:n], self.held[n:]
        self.place += len(out)
        if self.place >= self.floor and self.place > self.ratio * max(1, self.packed):
            raise ArchiveError("ZipBombSuspected", f"more than {self.ratio} times its stream")
        return out

    def read(self, n: int | None = -1) -> bytes:
        parts, left = [], n if n is not None and n >= 0 else 1 << 62
        while left and (part := self._take(left)):
            parts.append(part)
            left -= len(part)
        return b"".join(parts)

    def seek(self, to: int, whence: int = 0) -> int:
        to += self.place if whence == 1 else 0
        if whence == 2:
            raise io.UnsupportedOperation("the end of a stream is not known")
        if to < self.place:
            self._start()
        while self.place < to and self._take(to - self.place):
            pass
        return self.place


def entry_name(path: str, suffix: str) -> str:
    """The suffix stripped; where there is none ``.out`` is added, so that the output never is the source."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    dot = len(name) - len(suffix) - 1
    return name[:dot] if dot > 0 and name.lower().endswith("." + suffix) else name + ".out"


def open_stream(data: bytes, path: str, kind: str) -> Archive:
    """One entry of unknown size (0); the payload is the decoded stream."""
    suffix, method = STREAMS[kind]
    entry = Entry(entry_name(path, suffix), compressed_size=len(data), compression=method)
    return Archive(kind, "stream", [entry], lambda _, limit: decoded(data, kind, limit))


def lz4_frame(data: bytes) -> bytes:
    """A frame of stored blocks: for tests and for writers without an encoder."""
    head = bytes([0x60 | 4, 0x40])
    out = b"\x04\x22\x4d\x18" + head + bytes([xxh32(head) >> 8 & 255])
    for at in range(0, len(data), 1 << 16):
        block = data[at : at + (1 << 16)]
        out += struct.pack("<I", len(block) | 1 << 31) + block
    return out + struct.pack("<II", 0, xxh32(data))
