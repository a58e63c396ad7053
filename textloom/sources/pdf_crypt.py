"""Files that are encrypted for an empty user password: RC4 and AES with keys of 40 to 256 bits.

A file that needs another password, or another handler, raises.
"""

from __future__ import annotations

import hashlib

#: Fixed value: what short passwords are filled up with.
_PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = j + s[i] + key[i % len(key)] & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = i + 1 & 255
        j = j + s[i] & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[s[i] + s[j] & 255])
    return bytes(out)


def _tables():
    """The substitution of AES and its inverse, from the field they are defined in."""
    box = [0] * 256
    p = q = 1
    while True:
        p = p ^ (p << 1 & 255) ^ (0x1B if p & 128 else 0)
        q ^= q << 1
        q ^= q << 2
        q ^= q << 4
        q = q & 255 ^ (0x09 if q & 128 else 0)
        turn = lambda n, q=q: (q << n | q >> 8 - n) & 255
        box[p] = q ^ turn(1) ^ turn(2) ^ turn(3) ^ turn(4) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for a, b in enumerate(box):
        back[b] = a
    return box, back


_BOX, _BACK = _tables()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 128 else 0)
        b >>= 1
    return out


_MUL = {k: [_times(a, k) for a in range(256)] for k in (2, 3, 9, 11, 13, 14)}


class Aes:
    """AES by the block, and chained."""

    def __init__(self, key: bytes):
        n = len(key) // 4
        words = [list(key[4 * k : 4 * k + 4]) for k in range(n)]
        rcon = 1
        for k in range(n, 4 * (n + 7)):
            t = list(words[-1])
            if k % n == 0:
                t = [_BOX[x] for x in t[1:] + t[:1]]
                t[0] ^= rcon
                rcon = _times(rcon, 2)
            elif n > 6 and k % n == 4:
                t = [_BOX[x] for x in t]
            words.append([a ^ b for a, b in zip(words[k - n], t)])
        self.keys = [sum(words[4 * r : 4 * r + 4], []) for r in range(n + 7)]

    def encrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[0])]
        m2, m3 = _MUL[2], _MUL[3]
        for r, key in enumerate(self.keys[1:], 1):
            s = [_BOX[s[(k + 4 * (k % 4)) % 16]] for k in range(16)]
            if r < len(self.keys) - 1:
                s = [m2[s[k]] ^ m3[s[k - k % 4 + (k + 1) % 4]] ^ s[k - k % 4 + (k + 2) % 4] ^ s[k - k % 4 + (k + 3) % 4] for k in range(16)]
            s = [a ^ b for a, b in zip(s, key)]
        return bytes(s)

    def decrypt(self, block: bytes) -> bytes:
        s = [a ^ b for a, b in zip(block, self.keys[-1])]
        m9, m11, m13, m14 = _MUL[9], _MUL[11], _MUL[13], _MUL[14]
        for r in range(len(self.keys) - 2, -1, -1):
            s = [_BACK[s[(k - 4 * (k % 4)) % 16]] for k in range(16)]
            s = [a ^ b for a, b in zip(s, self.keys[r])]
            if r:
                s = [m14[s[k]] ^ m11[s[k - k % 4 + (k + 1) % 4]] ^ m13[s[k - k % 4 + (k + 2) % 4]] ^ m9[s[k - k % 4 + (k + 3) % 4]] for k in range(16)]
        return bytes(s)

    def unchain(self, data: bytes, iv: bytes) -> bytes:
        out = bytearray()
        for k in range(0, len(data) - 15, 16):
            block = data[k : k + 16]
            out += bytes(a ^ b for a, b in zip(self.decrypt(block), iv))
            iv = block
        return bytes(out)

    def chain(self, data: bytes, iv: bytes) -> bytes:
        out = bytearray()
        for k in range(0, len(data), 16):
            iv = self.encrypt(bytes(a ^ b for a, b in zip(data[k : k + 16], iv)))
            out += iv
        return bytes(out)


def _hash6(password: bytes, salt: bytes) -> bytes:
    """The hash of revision 6: rounds of AES over digests until the last byte lets them end."""
    k = hashlib.sha256(password + salt).digest()
    n, e = 0, b""
    while n < 64 or e[-1] > n - 32:
        e = Aes(k[:16]).chain((password + k) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
    return k[:32]


class Lock:
    """How the strings and streams of a file are decrypted."""

    def __init__(self, d: dict, file_id: bytes, get, generation: dict[int, int]):
        if d.get("Filter") != "Standard":
            raise ValueError("encrypted by another handler")
        self.generation = generation
        v, r = int(d.get("V") or 0), int(d.get("R") or 0)
        self.plain_metadata = d.get("EncryptMetadata") is False
        filters = {k: get(x) for k, x in (d.get("CF") or {}).items()}
        method = lambda name: "Identity" if name in (None, "Identity") else str(get(filters[name].get("CFM")) or "None")
        self.of_streams, self.of_strings = (method(d.get("StmF")), method(d.get("StrF"))) if v >= 4 else ("V2", "V2")
        if v >= 5:
            u, ue = d["U"], d["UE"]
            digest = (lambda salt: _hash6(b"", salt)) if r >= 6 else (lambda salt: hashlib.sha256(salt).digest())
            if digest(u[32:40]) != u[:32]:
                raise ValueError("encrypted with a password")
            self.key = Aes(digest(u[40:48])).unchain(ue[:32], bytes(16))
            return
        n = int(d.get("Length") or 40) // 8 if v > 1 else 5
        n = 16 if v == 4 else n
        p = int(d["P"]) & 0xFFFFFFFF
        k = hashlib.md5(_PAD + d["O"][:32] + p.to_bytes(4, "little") + file_id + (b"\xff" * 4 if r >= 4 and self.plain_metadata else b""))
        key = k.digest()
        if r >= 3:
            for _ in range(50):
                key = hashlib.md5(key[:n]).digest()
        self.key = key[:n]
        if r >= 3:
            u = hashlib.md5(_PAD + file_id).digest()
            for k in range(20):
                u = rc4(bytes(x ^ k for x in self.key), u)
            good = u[:16] == d["U"][:16]
        else:
            good = rc4(self.key, _PAD) == d["U"][:32]
        if not good:
            raise ValueError("encrypted with a password")

    def _open(self, data: bytes, n: int, method: str) -> bytes:
        if method in ("Identity", "None"):
            return data
        key = self.key
        if method != "AESV3":
            salt = b"sAlT" if method == "AESV2" else b""
            key = hashlib.md5(key + n.to_bytes(3, "little") + self.generation.get(n, 0).to_bytes(2, "little") + salt).digest()[: min(16, len(key) + 5)]
        if method == "V2":
            return rc4(key, data)
        if len(data) < 32:
            return b""
        out = Aes(key).unchain(data[16:], data[:16])
        return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out

    def strings(self, v, n: int):
        """A value with its strings decrypted."""
        if isinstance(v, bytes):
            return self._open(v, n, self.of_strings)
        if isinstance(v, dict):
            return {k: self.strings(x, n) for k, x in v.items()}
        if isinstance(v, list):
            return [self.strings(x, n) for x in v]
        return v

    def stream(self, data: bytes, d: dict, n: int) -> bytes:
        if d.get("Type") == "XRef" or d.get("Type") == "Metadata" and self.plain_metadata:
            return data
        return self._open(data, n, self.of_streams)
