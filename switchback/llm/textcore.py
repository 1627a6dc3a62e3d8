"""Vectorised text primitives shared by the text operators.

Everything here works on whole Arrow string columns: UTF-8 bytes are decoded to
code points with numpy, words are found with a table lookup, and every word gets
a 62-bit hash from prefix sums, so no Python string is made per word. The hash is a
pair of polynomials modulo the prime 2**31 - 1: a power-of-two modulus would give some
long strings over two letters, such as a Thue-Morse word and its complement, one hash.

Memory is linear in a chunk: `slices` cuts a batch into runs of whole texts of
about CHUNK_BYTES; a single longer text is a chunk of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
BITE = 1 << 14
MAX_DOCS = 4000  # texts in a chunk: their index fits the top 12 bits of a sort key

_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_103_515_245, 1_732_050_807)  # of the two polynomials; any residues of large order do
_pows: dict[str, np.ndarray] = {}
_tables: dict[str, np.ndarray] = {}


_caches: list[dict] = []


def claim(own: dict) -> None:
    """Make `own` the only operator cache that this worker keeps: workers serve one operator after another."""
    if not any(c is own for c in _caches):
        _caches[:] = [c for c in _caches if c] + [own]
    for c in _caches:
        if c is not own and c:
            c.clear()
            pa.default_memory_pool().release_unused()


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with about `limit` bytes and at most MAX_DOCS texts each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n, i + MAX_DOCS)
        yield i, j
        i = j


def chunks(col, limit: int = CHUNK_BYTES):
    """(i, j, bytes, offsets from 0) for each run of texts of a column."""
    data, off = column_bytes(col)
    for i, j in slices(off, limit):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


def mod_prime(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x < 2**63; x is changed."""
    for _ in range(2):
        y = x >> np.uint64(31)
        x &= _PRIME
        x += y
    np.subtract(x, _PRIME, out=x, where=x >= _PRIME)
    return x


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both bases: its powers and the inverses of those, modulo the prime, for exponents below n."""
    if len(_pows.get("0", ())) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for k, base in enumerate(_BASES):
            for name, b in ((f"{k}", base), (f"-{k}", pow(base, -1, int(_PRIME)))):
                a = np.ones(1, np.uint64)
                while len(a) < size:  # doubling: the next half is this half times a power
                    a = np.concatenate([a, mod_prime(a * np.uint64(pow(b, len(a), int(_PRIME))))])
                _pows[name] = a[:size]
    return [(_pows[f"{k}"][:n], _pows[f"-{k}"][:n]) for k in range(2)]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    out = np.array(x, np.uint64)
    flat = out.reshape(-1)
    y = np.empty(min(BITE, flat.size), np.uint64)
    for a in range(0, flat.size, BITE):
        z = flat[a : a + BITE]
        t = y[: len(z)]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            np.right_shift(z, np.uint64(shift), out=t)
            z ^= t
            if factor > 1:
                z *= np.uint64(factor)
    return out


def decode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 and the offsets of the texts among them."""
    if len(data) == 0 or data.max() < 0x80:
        return data.astype(np.uint32), off
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.uint32)
    cps = first
    more = np.flatnonzero(first >= 0xC0)
    f = first[more]
    p = at[more]
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    b1, b2, b3 = ((pad[p + k] & 0x3F).astype(np.uint32) for k in (1, 2, 3))
    two = ((f & 0x1F) << 6) | b1
    three = ((f & 0x0F) << 12) | (b1 << 6) | b2
    four = ((f & 0x07) << 18) | (b1 << 12) | (b2 << 6) | b3
    cps[more] = np.where(f < 0xE0, two, np.where(f < 0xF0, three, four))
    return cps, np.searchsorted(at, off)


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        chars = [chr(i) for i in range(0x10000)]
        low = [c.lower() for c in chars]
        _tables["lower"] = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)
        _tables["word"] = np.array([c.isalnum() or c == "_" for c in chars], bool)
        _tables["alpha"] = np.array([c.isalpha() for c in chars], bool)
    return _tables[name]


def _look(name: str, cps: np.ndarray) -> np.ndarray:
    table = _table(name)
    if len(cps) == 0 or cps.max() < 0x10000:
        return table[cps]
    out = table[np.minimum(cps, 0xFFFF)]
    for c in np.unique(cps[cps >= 0x10000]):
        ch = chr(int(c))
        low = ch.lower()
        out[cps == c] = {"lower": ord(low) if len(low) == 1 else int(c), "word": ch.isalnum(), "alpha": ch.isalpha()}[name]
    return out


def lower(cps: np.ndarray) -> np.ndarray:
    """Simple lower case: characters whose lower case is one character."""
    return _look("lower", cps)


def is_word(cps: np.ndarray) -> np.ndarray:
    """Letters, digits and the underscore."""
    return _look("word", cps)


def is_alpha(cps: np.ndarray) -> np.ndarray:
    return _look("alpha", cps)


def prefix_hash(cps: np.ndarray) -> np.ndarray:
    """Two rows of prefix sums with len(cps) + 1 entries, from which `span_hash` takes any span."""
    n = len(cps)
    h = np.empty((2, n + 1), np.uint64)
    h[:, 0] = 0
    x, y = np.empty(BITE, np.uint64), np.empty(BITE, np.uint64)
    both = powers(n + 1)
    for a in range(0, n, BITE):  # bites stay in the processor's cache
        b = min(a + BITE, n)
        c = cps[a:b].astype(np.uint64)
        c += np.uint64(1)
        u, v = x[: b - a], y[: b - a]
        for k, (p, _) in enumerate(both):
            np.multiply(c, p[a:b], out=u)
            np.right_shift(u, np.uint64(31), out=v)
            u &= _PRIME
            u += v
            u[0] += h[k, a]
            np.cumsum(u, out=h[k, a + 1 : b + 1])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes of the spans [start, end) of the code points behind h."""
    out = np.zeros(len(start), np.uint64)
    for x, (_, q) in zip(h, powers(h.shape[1]), strict=True):
        d = x[end]
        d -= x[start]
        d = mod_prime(d)
        d *= q[start]
        out <<= np.uint64(31)
        out |= mod_prime(d)
    d = (end - start).astype(np.uint64)
    d *= np.uint64(0xD6E8FEB86659FD93)
    out += d
    return mix(out)


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True; a run ends at the end of its text."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    start = mask.copy()
    start[1:] &= ~mask[:-1] | cut[1:n]
    end = mask.copy()
    end[:-1] &= ~mask[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Words:
    """Words of a chunk of texts: lower-cased runs of letters, digits and underscores.

    start, end: code point spans; doc: index of the text; hash: 64-bit;
    first: for each text, the index of its first word (one entry more than texts).
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.cps, self.off = decode(data, off)
        self.low = lower(self.cps)
        self.start, self.end = runs(is_word(self.cps), self.off)
        self.prefix = prefix_hash(self.low)
        self.hash = span_hash(self.prefix, self.start, self.end)
        self.first = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def text(self, i: int) -> str:
        return self.low[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le", "replace")


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, 52-bit hash, count) of the distinct n-word shingles, sorted by text and hash.

    A text with 1 to n - 1 words has one shingle of all its words; one without words has none.
    """
    h, first = w.hash, w.first
    count = np.diff(first)
    m = np.uint64(0xFF51AFD7ED558CCD)
    keys = []
    if len(h) >= n:
        x = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            x *= m
            x += h[k : len(h) - n + 1 + k]
        doc = w.doc[: len(x)]
        ok = np.arange(len(x)) + n <= first[1:][doc]
        keys.append((doc[ok].astype(np.uint64) << np.uint64(52)) | (mix(x[ok]) >> np.uint64(12)))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        x = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            x[has] = x[has] * m + h[first[short[has]] + k]
        x += count[short].astype(np.uint64)
        keys.append((short.astype(np.uint64) << np.uint64(52)) | (mix(x) >> np.uint64(12)))
    if not keys:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    key = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), tf


def text_key(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit keys of whole texts: two independent CRCs would be weak, so md5's first half."""
    import hashlib

    raw = data.tobytes()
    return np.array([int.from_bytes(hashlib.md5(raw[a:b]).digest()[:8], "little", signed=True) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)


def crc32_mod4(doc_id) -> np.ndarray:
    """crc32 of the decimal text of each id, modulo 4 (the fold of a row)."""
    return np.array([zlib.crc32(str(x).encode()) % 4 for x in doc_id], np.int64)


class Memo:
    """Bounded cache from 64-bit hashes to int64 values: two slots a hash, newest wins.

    A value is a pure function of the hashed text, so eviction costs time and changes no result.
    """

    def __init__(self, bits: int = 21):
        self.shift = np.uint64(64 - bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.vals = np.full(1 << self.bits, -1, np.int64)

    def get(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and a mask of the hashes that are missing."""
        a = (h >> self.shift).astype(np.int64)
        val = self.vals[a]
        miss = (self.keys[a] != h) | (val < 0)
        if miss.any():
            at = np.flatnonzero(miss)
            b = (h[at] & self.mask).astype(np.int64)
            v2 = self.vals[b]
            hit = (self.keys[b] == h[at]) & (v2 >= 0)
            val[at[hit]] = v2[hit]
            miss[at[hit]] = False
        return val, miss

    def put(self, h: np.ndarray, v: np.ndarray) -> None:
        a = (h >> self.shift).astype(np.int64)
        taken = self.vals[a] >= 0
        b = np.where(taken, (h & self.mask).astype(np.int64), a)
        self.keys[b] = h
        self.vals[b] = v
