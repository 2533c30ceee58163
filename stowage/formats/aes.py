"""AES over many blocks at once, for the encrypted forms of ZIP and 7z; tables are derived, not written out."""

from __future__ import annotations

import hashlib
import hmac
from functools import lru_cache

import numpy as np


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The S-box, its inverse, and products in the field by every byte: powers of the generator 3."""
    exp, log, x = [0] * 510, [0] * 256, 1
    for k in range(255):
        exp[k] = exp[k + 255] = x
        log[x] = k
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    box = []
    for b in range(256):
        v = exp[255 - log[b]] if b else 0
        turned = v
        for k in range(1, 5):
            turned ^= (v << k | v >> (8 - k)) & 0xFF
        box.append(turned ^ 0x63)
    back = [0] * 256
    for k, v in enumerate(box):
        back[v] = k
    times = np.zeros((16, 256), np.uint8)
    for a in range(1, 16):
        for b in range(1, 256):
            times[a, b] = exp[log[a] + log[b]]
    return np.array(box, np.uint8), np.array(back, np.uint8), times


BOX, BACK, TIMES = _tables()
SHIFT = np.array([(4 * c + r + 4 * r) % 16 for c in range(4) for r in range(4)])
UNSHIFT = np.argsort(SHIFT)
MIX = np.array([[2, 3, 1, 1], [1, 2, 3, 1], [1, 1, 2, 3], [3, 1, 1, 2]])
UNMIX = np.array([[14, 11, 13, 9], [9, 14, 11, 13], [13, 9, 14, 11], [11, 13, 9, 14]])


def expand(key: bytes) -> np.ndarray:
    """Round keys, 16 bytes each."""
    n, rounds = len(key) // 4, len(key) // 4 + 6
    words = [np.frombuffer(key[4 * k : 4 * k + 4], np.uint8) for k in range(n)]
    rcon = 1
    for k in range(n, 4 * (rounds + 1)):
        w = words[-1]
        if k % n == 0:
            w = BOX[np.roll(w, -1)].copy()
            w[0] ^= rcon
            rcon = (rcon << 1) ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and k % n == 4:
            w = BOX[w]
        words.append(words[k - n] ^ w)
    return np.concatenate(words).reshape(-1, 16)


def _columns(matrix: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """For each row of a column its part of the mixed column, four bytes in one number, by the byte that stands there."""
    return [np.ascontiguousarray(np.stack([TIMES[matrix[i, j]][of] for i in range(4)], 1)).view("<u4").ravel() for j in range(4)]


SEAL, OPEN = _columns(MIX, BOX), _columns(UNMIX, np.arange(256))


def _mixed(s: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    c = s.reshape(-1, 4, 4)
    words = tables[0][c[:, :, 0]] ^ tables[1][c[:, :, 1]] ^ tables[2][c[:, :, 2]] ^ tables[3][c[:, :, 3]]
    return np.ascontiguousarray(words).view(np.uint8).reshape(-1, 16)


def encrypt(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = blocks ^ keys[0]
    for k in keys[1:-1]:
        s = _mixed(s[:, SHIFT], SEAL) ^ k
    return BOX[s][:, SHIFT] ^ keys[-1]


def decrypt(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = blocks ^ keys[-1]
    for k in keys[-2:0:-1]:
        s = _mixed(BACK[s[:, UNSHIFT]] ^ k, OPEN)
    return BACK[s[:, UNSHIFT]] ^ keys[0]


def ctr_little(data: bytes, key: bytes) -> bytes:
    """Counter mode with a little-endian counter from 1, as encrypted ZIP entries use it."""
    n = -(-len(data) // 16)
    counter = np.zeros((n, 2), "<u8")
    counter[:, 0] = np.arange(1, n + 1)
    stream = encrypt(counter.view(np.uint8).reshape(n, 16), expand(key)).ravel()[: len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


def cbc_decrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    blocks = np.frombuffer(data[: len(data) // 16 * 16], np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), blocks[:-1]]) if len(blocks) else blocks
    return (decrypt(blocks, expand(key)) ^ before).tobytes()


def cbc_encrypt(data: bytes, key: bytes, iv: bytes) -> bytes:
    return cbc_encrypt_many([data], key, [iv])[0]


def cbc_encrypt_many(data: list[bytes], key: bytes, ivs: list[bytes]) -> list[bytes]:
    """Each of ``data``, filled up with zeros, as a chain of its own: chains go on in step, as a block waits for the one before."""
    padded = [d + bytes(-len(d) % 16) for d in data]
    sizes = np.array([len(p) // 16 for p in padded], np.int64)
    starts, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    out = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, 16).copy()
    last, keys = np.frombuffer(b"".join(ivs[k] for k in order), np.uint8).reshape(-1, 16), expand(key)
    longest = -sizes[order]
    for step in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(longest, -step))
        at = starts[order[:live]] + step
        last = encrypt(out[at] ^ last[:live], keys)
        out[at] = last
    return [out[s : s + n].tobytes() for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def zip_keys(password: str, salt: bytes, bits: int) -> tuple[bytes, bytes, bytes]:
    """Encryption key, authentication key and the two check bytes of an encrypted ZIP entry."""
    n = bits // 8
    made = hashlib.pbkdf2_hmac("sha1", password.encode(), salt, 1000, 2 * n + 2)
    return made[:n], made[n : 2 * n], made[2 * n :]


def zip_tag(key: bytes, data: bytes) -> bytes:
    return hmac.new(key, data, hashlib.sha1).digest()[:10]


@lru_cache(maxsize=16)
def sevenz_key(password: str, salt: bytes, power: int) -> bytes:
    """SHA-256 over 2^power rounds of salt, password and counter; the blocks of an archive share it."""
    word = password.encode("utf-16-le")
    if power == 0x3F:
        return (salt + word + bytes(32))[:32]
    h, piece = hashlib.sha256(), salt + word
    for at in range(0, 1 << power, 4096):
        h.update(b"".join(piece + k.to_bytes(8, "little") for k in range(at, min(at + 4096, 1 << power))))
    return h.digest()
