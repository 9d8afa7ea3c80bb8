"""The standard security of PDF files, opened with the empty user password: RC4 and AES with keys of up to 128 bits (revisions 2 to 4)."""

from __future__ import annotations

import hashlib

# What fills passwords up to 32 bytes.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + state[i]) & 255
        state[i], state[j] = state[j], state[i]
        out.append(c ^ state[(state[i] + state[j]) & 255])
    return bytes(out)


def _field() -> tuple[list[int], list[int]]:
    """Powers of 3 in the field of 256 elements, and their logarithms."""
    powers, logs, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        powers[i], logs[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    return powers, logs


_POWERS, _LOGS = _field()


def _times(a: int, b: int) -> int:
    return _POWERS[(_LOGS[a] + _LOGS[b]) % 255] if a and b else 0


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution of AES, made from inverses in the field and a turn of bits, and its inverse."""
    box = []
    for x in range(256):
        v = _POWERS[-_LOGS[x] % 255] if x else 0
        turned = v
        for _ in range(4):
            v = (v << 1 | v >> 7) & 255
            turned ^= v
        box.append(turned ^ 0x63)
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


_BOX, _BACK = _boxes()
_MIX = [[_times(x, k) for x in range(256)] for k in (14, 11, 13, 9)]


def _round_keys(key: bytes) -> list[bytes]:
    words, n = [key[i : i + 4] for i in range(0, len(key), 4)], len(key) // 4
    factor = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(_BOX[c] for c in w[1:] + w[:1])
            w = bytes([w[0] ^ factor]) + w[1:]
            factor = _times(factor, 2)
        elif n > 6 and i % n == 4:
            w = bytes(_BOX[c] for c in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def aes_cbc(key: bytes, data: bytes) -> bytes:
    """Decrypted data: the first block is the start vector, the last byte says how many to drop."""
    keys, out, before = _round_keys(key), bytearray(), data[:16]
    # Where each byte comes from when rows turn to the right.
    turn = [(4 * ((c - r) % 4) + r) for c in range(4) for r in range(4)]
    for at in range(16, len(data) - 15, 16):
        block = data[at : at + 16]
        s = [a ^ b for a, b in zip(block, keys[-1], strict=True)]
        for k in reversed(keys[:-1]):
            s = [_BACK[s[i]] ^ x for i, x in zip(turn, k, strict=True)]
            if k is not keys[0]:
                m = []
                for c in range(0, 16, 4):
                    col = s[c : c + 4]
                    m += [_MIX[0][col[r]] ^ _MIX[1][col[(r + 1) % 4]] ^ _MIX[2][col[(r + 2) % 4]] ^ _MIX[3][col[(r + 3) % 4]] for r in range(4)]
                s = m
        out += bytes(a ^ b for a, b in zip(s, before, strict=True))
        before = block
    return bytes(out[: -out[-1]]) if out and 1 <= out[-1] <= 16 else bytes(out)


class Security:
    """Keys of a file whose Encrypt dictionary names the standard handler; raises ValueError if the empty password doesn't open it."""

    def __init__(self, how: dict, first_id: bytes, get):
        value = lambda k, d=None: v if (v := get(how.get(k))) is not None else d
        version, revision = value("V", 0), value("R", 2)
        if value("Filter") != "Standard" or version not in (1, 2, 4) or revision not in (2, 3, 4):
            raise ValueError(f"the file is encrypted, by version {version}, revision {revision}")
        size = 5 if version == 1 else (value("Length", 128 if version == 4 else 40)) // 8
        filters = get(value("CF", {}).get(value("StmF", "Identity"))) if version == 4 else None
        self.method = (get((filters or {}).get("CFM")) or "None") if version == 4 else "V2"
        data = PAD + bytes(value("O", b""))[:32] + (int(value("P", 0)) & 0xFFFFFFFF).to_bytes(4, "little") + first_id
        if revision >= 4 and value("EncryptMetadata") is False:
            data += b"\xff" * 4
        key = hashlib.md5(data).digest()
        for _ in range(50 if revision >= 3 else 0):
            key = hashlib.md5(key[:size]).digest()
        self.key = key[:size]
        if revision == 2:
            good = rc4(self.key, PAD) == bytes(value("U", b""))
        else:
            told = rc4(self.key, hashlib.md5(PAD + first_id).digest())
            for i in range(1, 20):
                told = rc4(bytes(c ^ i for c in self.key), told)
            good = told == bytes(value("U", b""))[:16]
        if not good:
            raise ValueError("the file is encrypted with a password")

    def decrypted(self, data: bytes, number: int, generation: int) -> bytes:
        if self.method == "None":
            return data
        salt = number.to_bytes(4, "little")[:3] + generation.to_bytes(4, "little")[:2] + (b"sAlT" if self.method == "AESV2" else b"")
        key = hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)]
        return aes_cbc(key, data) if self.method == "AESV2" else rc4(key, data)
