"""Standard security handler: RC4 and AES keys, password checks, and decryption of objects. Encryption is here for round trips."""

from __future__ import annotations

import hashlib
import hmac
import struct
from functools import lru_cache

import numpy as np

from folioflow.pdf.syntax import HexText, PdfError, Ref, Stream, Text

# Fixed values
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
DEPTH = 64


def rc4(key: bytes, data: bytes) -> bytes:
    """data under an RC4 key; an empty key leaves it."""
    if not key:
        return data
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        a = s[i]
        j = (j + a + k) & 255
        s[i] = s[j]
        s[j] = a
    stream, i, j = bytearray(len(data)), 0, 0
    for k in range(len(data)):
        i = (i + 1) & 255
        a = s[i]
        j = (j + a) & 255
        s[i] = b = s[j]
        s[j] = a
        stream[k] = s[(a + b) & 255]
    return _xor(data, stream)


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).to_bytes(len(a), "little")


def _times2(x: int) -> int:
    return (x << 1 ^ 0x11B if x & 128 else x << 1) & 255


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _times2(a), b >> 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution box from inverses in GF(2^8) and the affine map, and its inverse."""
    logs, powers, x = {}, [], 1
    for k in range(255):
        powers.append(x)
        logs[x] = k
        x ^= _times2(x)
    box = []
    for v in range(256):
        i = powers[(255 - logs[v]) % 255] if v else 0
        r = 0x63
        for k in range(5):
            r ^= (i << k | i >> (8 - k)) & 255
        box.append(r)
    inverse = [0] * 256
    for k, v in enumerate(box):
        inverse[v] = k
    return box, inverse


_BOX, _INVERSE = _boxes()
_M = {n: bytes(_times(v, n) for v in range(256)) for n in (2, 3, 9, 11, 13, 14)}


def _columns(box: list[int], m: tuple[int, int, int, int]) -> list[list[int]]:
    """For each place in a column, the column that a byte's substitute adds to the product, as a number."""
    one = [bytes(_M[n][v] if n > 1 else v for n in m) for v in box]
    return [[int.from_bytes(c[4 - k :] + c[: 4 - k], "big") for c in one] for k in range(4)]


#: Substitution and column products in one look-up, to encrypt and to decrypt, and the products alone for the keys of decryption.
_SEAL, _OPEN, _MIX = _columns(_BOX, (2, 1, 1, 3)), _columns(_INVERSE, (14, 9, 13, 11)), _columns(list(range(256)), (14, 9, 13, 11))
_OPEN_TABLES, _INVERSE_TABLE = np.array(_OPEN, np.uint32), np.array(_INVERSE, np.uint32)
#: From so many blocks on CBC is opened for all blocks at once.
MANY_BLOCKS = 12


class Aes:
    """Blocks as four columns of 32 bits each."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        self.rounds = n + 6
        words = [int.from_bytes(key[4 * k : 4 * k + 4], "big") for k in range(n)]
        rcon = 1
        for k in range(n, 4 * (self.rounds + 1)):
            w = words[-1]
            if k % n == 0:
                w = _BOX[w >> 16 & 255] << 24 | _BOX[w >> 8 & 255] << 16 | _BOX[w & 255] << 8 | _BOX[w >> 24]
                w ^= rcon << 24
                rcon = _times2(rcon)
            elif n > 6 and k % n == 4:
                w = _BOX[w >> 24] << 24 | _BOX[w >> 16 & 255] << 16 | _BOX[w >> 8 & 255] << 8 | _BOX[w & 255]
            words.append(w ^ words[k - n])
        self.words, self._inverse = words, None

    @property
    def inverse(self) -> list[int]:
        """The keys of the rounds of decryption, in their order: the last first, those between mixed."""
        if self._inverse is None:
            m0, m1, m2, m3 = _MIX
            rounds = [self.words[4 * r : 4 * r + 4] for r in range(self.rounds, -1, -1)]
            mixed = [[m0[w >> 24] ^ m1[w >> 16 & 255] ^ m2[w >> 8 & 255] ^ m3[w & 255] for w in r] for r in rounds[1:-1]]
            self._inverse = sum([rounds[0], *mixed, rounds[-1]], [])
        return self._inverse

    def encrypt_words(self, a: int, b: int, c: int, d: int) -> tuple[int, int, int, int]:
        t0, t1, t2, t3 = _SEAL
        w, box = self.words, _BOX
        a, b, c, d = a ^ w[0], b ^ w[1], c ^ w[2], d ^ w[3]
        for k in range(4, 4 * self.rounds, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ w[k], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ w[k + 1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ w[k + 2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ w[k + 3],
            )
        last = lambda p, q, r, s, key: (box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ key
        return last(a, b, c, d, w[-4]), last(b, c, d, a, w[-3]), last(c, d, a, b, w[-2]), last(d, a, b, c, w[-1])

    def decrypt_words(self, a: int, b: int, c: int, d: int) -> tuple[int, int, int, int]:
        t0, t1, t2, t3 = _OPEN
        w, box = self.inverse, _INVERSE
        a, b, c, d = a ^ w[0], b ^ w[1], c ^ w[2], d ^ w[3]
        for k in range(4, 4 * self.rounds, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[d >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[b & 255] ^ w[k], t0[b >> 24] ^ t1[a >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[c & 255] ^ w[k + 1],
                t0[c >> 24] ^ t1[b >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[d & 255] ^ w[k + 2], t0[d >> 24] ^ t1[c >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[a & 255] ^ w[k + 3],
            )
        last = lambda p, q, r, s, key: (box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ key
        return last(a, d, c, b, w[-4]), last(b, a, d, c, w[-3]), last(c, b, a, d, w[-2]), last(d, c, b, a, w[-1])

    def decrypt_all(self, blocks: bytes) -> bytes:
        """All blocks at once."""
        x = np.frombuffer(blocks, ">u4").reshape(-1, 4).astype(np.uint32).T
        t, w, box = _OPEN_TABLES, np.array(self.inverse, np.uint32).reshape(-1, 4, 1), _INVERSE_TABLE
        x = x ^ w[0]
        for k in range(1, self.rounds + 1):
            # rows turned by one, two and three columns
            p, q, r, s = x >> 24, (x >> 16 & 255)[[3, 0, 1, 2]], (x >> 8 & 255)[[2, 3, 0, 1]], (x & 255)[[1, 2, 3, 0]]
            x = (t[0][p] ^ t[1][q] ^ t[2][r] ^ t[3][s] if k < self.rounds else box[p] << 24 | box[q] << 16 | box[r] << 8 | box[s]) ^ w[k]
        return x.T.astype(">u4").tobytes()

    def encrypt_block(self, block: bytes) -> bytes:
        return _BLOCK.pack(*self.encrypt_words(*_BLOCK.unpack(block)))

    def decrypt_block(self, block: bytes) -> bytes:
        return _BLOCK.pack(*self.decrypt_words(*_BLOCK.unpack(block)))


_BLOCK = struct.Struct(">4I")


def cbc_encrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, out = Aes(key), []
    a, b, c, d = _BLOCK.unpack(iv)
    for e, f, g, h in _BLOCK.iter_unpack(data):
        a, b, c, d = aes.encrypt_words(a ^ e, b ^ f, c ^ g, d ^ h)
        out.append(_BLOCK.pack(a, b, c, d))
    return b"".join(out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes) -> bytes:
    aes, data = Aes(key), data[: len(data) // 16 * 16]
    if len(data) < 16 * MANY_BLOCKS:
        plain = b"".join([_BLOCK.pack(*aes.decrypt_words(*block)) for block in _BLOCK.iter_unpack(data)])
    else:
        plain = aes.decrypt_all(data)
    return _xor(plain, iv + data[:-16]) if data else b""


def aes_seal(key: bytes, iv: bytes, data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return iv + cbc_encrypt(key, iv, data + bytes([n]) * n)


def aes_open(key: bytes, data: bytes) -> bytes:
    """Without its vector and padding; data that isn't sound stays as it is."""
    if len(data) < 32 or len(data) % 16:
        return data
    out = cbc_decrypt(key, data[:16], data[16:])
    n = out[-1]
    return out[:-n] if 1 <= n <= 16 and out.endswith(bytes([n]) * n) else data


def key_r2_r4(password: bytes, o: bytes, p: int, doc_id: bytes, revision: int, length: int, encrypt_metadata: bool = True) -> bytes:
    seed = (password + PADDING)[:32] + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + doc_id
    if revision >= 4 and not encrypt_metadata:
        seed += b"\xff\xff\xff\xff"
    n = length if revision >= 3 else 5
    key = hashlib.md5(seed).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:n]).digest()
    return key[:n]


@lru_cache(maxsize=1024)
def user_value(key: bytes, doc_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PADDING)
    out = rc4(key, hashlib.md5(PADDING + doc_id).digest())
    for k in range(1, 20):
        out = rc4(bytes(b ^ k for b in key), out)
    return out


@lru_cache(maxsize=1024)
def owner_value(owner: bytes, user: bytes, revision: int, length: int) -> bytes:
    key = hashlib.md5((owner + PADDING)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    key = key[: length if revision >= 3 else 5]
    out = (user + PADDING)[:32]
    for k in range(20 if revision >= 3 else 1):
        out = rc4(bytes(b ^ k for b in key), out)
    return out


def check_user(key: bytes, u: bytes, doc_id: bytes, revision: int) -> bool:
    n = 32 if revision == 2 else 16
    return hmac.compare_digest(user_value(key, doc_id, revision)[:n], u[:n])


def object_key(key: bytes, ref: Ref, aes: bool) -> bytes:
    seed = key + ref.num.to_bytes(4, "little")[:3] + ref.gen.to_bytes(4, "little")[:2] + b"sAlT" * aes
    return hashlib.md5(seed).digest()[: min(len(key) + 5, 16)]


def hash_r5(password: bytes, salt: bytes, u: bytes = b"") -> bytes:
    return hashlib.sha256(password[:127] + salt + u).digest()


def hash_r6(password: bytes, salt: bytes, u: bytes = b"") -> bytes:
    """Rounds of AES-128 over 64 copies of the input, then a hash chosen by the first 16 bytes modulo 3; 64 at least."""
    password = password[:127]
    k, i = hashlib.sha256(password + salt + u).digest(), 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + u) * 64)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Handler:
    """Decrypts the objects of a document, once a password fits."""

    def __init__(self, head: dict, doc_id: bytes, password: bytes):
        v, self.revision = head.get("V", 0), head.get("R", 0)
        self.encrypt_metadata = head.get("EncryptMetadata", True) is not False
        self.permissions = head.get("P", 0)
        o, u = bytes(head.get("O", b"")), bytes(head.get("U", b""))
        if v in (1, 2, 4):
            length = head.get("Length", 40) // 8 if v != 1 else 5
            cfm = (head.get("CF") or {}).get("StdCF", {}).get("CFM") if v == 4 else None
            if v == 4:
                length = 16
            self.algorithm = "AESV2" if cfm == "AESV2" else "RC4"
            self.key = key_r2_r4(password, o, self.permissions, doc_id, self.revision, length, self.encrypt_metadata)
            if not check_user(self.key, u, doc_id, self.revision):
                raise PdfError("InvalidPassword", "the password doesn't fit")
        elif v == 5:
            self.algorithm = "AESV3"
            h = hash_r6 if self.revision >= 6 else hash_r5
            if len(u) < 48 or len(o) < 48:
                raise PdfError("Encryption", "password values are too short")
            zero = bytes(16)
            if hmac.compare_digest(h(password, u[32:40]), u[:32]):
                self.key = cbc_decrypt(h(password, u[40:48]), zero, bytes(head.get("UE", b""))[:32])
            elif hmac.compare_digest(h(password, o[32:40], u[:48]), o[:32]):
                self.key = cbc_decrypt(h(password, o[40:48], u[:48]), zero, bytes(head.get("OE", b""))[:32])
            else:
                raise PdfError("InvalidPassword", "the password doesn't fit")
            perms = bytes(head.get("Perms", b""))
            if len(perms) >= 16:
                plain = Aes(self.key).decrypt_block(perms[:16])
                if plain[9:12] != b"adb" or int.from_bytes(plain[:4], "little") != self.permissions & 0xFFFFFFFF:
                    raise PdfError("Encryption", "permissions don't match")
        else:
            raise PdfError("UnsupportedFeature", f"encryption version {v}")

    def bytes_(self, data: bytes, ref: Ref) -> bytes:
        if self.algorithm == "AESV3":
            return aes_open(self.key, data)
        key = object_key(self.key, ref, self.algorithm == "AESV2")
        return aes_open(key, data) if self.algorithm == "AESV2" else rc4(key, data)

    def object(self, value, ref: Ref, depth: int = 0):
        """value with its strings and stream data decrypted; strings in a stream's dictionary stay."""
        if depth > DEPTH:
            return value
        if isinstance(value, Text):
            return (HexText if value.hexadecimal else Text)(self.bytes_(bytes(value), ref))
        if isinstance(value, list):
            return [self.object(x, ref, depth + 1) for x in value]
        if isinstance(value, dict):
            return {k: self.object(x, ref, depth + 1) for k, x in value.items()}
        if isinstance(value, Stream):
            return Stream(value.dict, self.bytes_(value.data, ref))
        return value
