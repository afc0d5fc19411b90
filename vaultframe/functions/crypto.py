"""Keys from passwords, and encryption of content.

Cells are encrypted by Spark's own AES-GCM, which is authenticated. The counter
mode with random access, which Spark lacks, is here for reading slices of a long
encrypted stream; its block cipher works on whole arrays of blocks.
"""

from __future__ import annotations

import functools
import hashlib
import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def new_salt() -> bytes:
    """32 random bytes, of which the first can't be taken for the beginning of plain data (``z`` or ``7``)."""
    while (salt := os.urandom(32))[0] in b"z7":
        pass
    return salt


def index_salt(salt: bytes) -> bytes:
    """The salt of an index that belongs to data with this salt."""
    return bytes([salt[0] ^ ord("7") ^ ord("z")]) + salt[1:]


def stretch_key(password: str | bytes, salt: bytes, n: int = 16384, r: int = 8, p: int = 1) -> bytes:
    """32-byte key: scrypt over the SHA-256 of the password."""
    secret = hashlib.sha256(password.encode() if isinstance(password, str) else password).digest()
    return hashlib.scrypt(secret, salt=salt, n=n, r=r, p=p, maxmem=1 << 28, dklen=32)


def pbkdf2(password: bytes, salt: bytes, rounds: int = 1, length: int = 32) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password, salt, rounds, length)


def _held(key: bytes) -> Column:
    """The key as a scalar subquery over a row of its own: no plan, event log or page of the UI shows its bytes, as it would with a literal."""
    return SparkSession.active().createDataFrame([(bytearray(key),)], "k binary").scalar()


def encrypt(column: Column, key: bytes) -> Column:
    return F.aes_encrypt(column, _held(key), F.lit("GCM"))


def decrypt(column: Column, key: bytes) -> Column:
    """The content; null where the key is another or the cell was changed."""
    return F.try_aes_decrypt(column, _held(key), F.lit("GCM"))


@functools.cache
def _tables():
    """S-box and doubling in the field of 256 elements, from their definition."""
    import numpy as np

    double = np.array([x << 1 ^ (0x11B if x & 128 else 0) for x in range(256)], np.uint8)
    power, x = [], 1
    for _ in range(255):
        power.append(x)
        x ^= int(double[x])
    log = {v: k for k, v in enumerate(power)}
    box = np.zeros(256, np.uint8)
    for v in range(256):
        inverse = power[-log[v] % 255] if v else 0
        turned = inverse
        for k in range(1, 5):
            turned ^= (inverse << k | inverse >> (8 - k)) & 255
        box[v] = turned ^ 0x63
    return box, double


def round_keys(key: bytes):
    import numpy as np

    if len(key) not in (16, 24, 32):
        raise ValueError("a key has 16, 24 or 32 bytes")
    box, double = _tables()
    n = len(key) // 4
    words = [np.frombuffer(key[4 * i : 4 * i + 4], np.uint8) for i in range(n)]
    constant = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = box[np.roll(w, -1)]
            w[0] ^= constant
            constant = int(double[constant])
        elif n == 8 and i % n == 4:
            w = box[w]
        words.append(words[i - n] ^ w)
    return np.concatenate(words).reshape(-1, 16)


def aes_blocks(blocks, key: bytes):
    """AES of an (n x 16) array of blocks."""
    import numpy as np

    box, double = _tables()
    keys = round_keys(key)
    shift = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
    state = blocks ^ keys[0]
    for k in keys[1:-1]:
        s = box[state][:, shift].reshape(-1, 4, 4)
        nxt = np.roll(s, -1, 2)
        every = np.bitwise_xor.reduce(s, 2, keepdims=True)
        state = (s ^ every ^ double[s ^ nxt]).reshape(-1, 16) ^ k
    return box[state][:, shift] ^ keys[-1]


def ctr_slice(data: bytes, key: bytes, salt: bytes, offset: int = 0) -> bytes:
    """Encrypts or decrypts a slice that begins at byte ``offset``: the salt's first 8 bytes and the number of the 16-byte block, high byte first, give the stream."""
    import numpy as np

    if not data:
        return b""
    first, last = offset // 16, (offset + len(data) - 1) // 16
    blocks = np.zeros((last - first + 1, 16), np.uint8)
    blocks[:, :8] = np.frombuffer(salt[:8], np.uint8)
    blocks[:, 8:] = np.arange(first, last + 1, dtype=">u8").view(np.uint8).reshape(-1, 8)
    stream = aes_blocks(blocks, key).reshape(-1)[offset % 16 :][: len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()
