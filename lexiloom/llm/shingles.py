"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

WORD_BASE = 0x9E3779B97F4A7C15
SHINGLE_BASE = 0xD6E8FEB86659FD93
SHORT_TAG = 0xA0761D6478BD642F
#: Bytes that are hashed at once; a longer text is one part by itself.
PART_BYTES = 1 << 20
MASK = (1 << 64) - 1


def mixed(x):
    """A one-to-one scattering of 64-bit numbers (array of unsigned integers)."""
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xE7037ED1A0B428DB)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x8EBC6AF09C88C6E3)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingles of `size` words: words are runs of anything but the six ASCII white-space characters, A-Z lowered.

    A text of fewer words has its whole sequence as one shingle, and a null
    text or one without words has none.
    """

    def __init__(self, size: int):
        import numpy as np

        self.size = size
        byte = np.arange(256)
        self.lowered = np.where((byte >= 65) & (byte <= 90), byte + 32, byte).astype(np.uint8)
        self.blank = np.isin(byte, [9, 10, 11, 12, 13, 32])
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(WORD_BASE))
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        """Powers of the base and of its inverse modulo 2^64 for `n` places."""
        import numpy as np

        if len(self.powers) < n:
            for name, base in (("powers", WORD_BASE), ("inverse", pow(WORD_BASE, -1, 1 << 64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, texts: list[str | None]):
        """(hash of each word, number of its text) over all texts."""
        import numpy as np

        encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        data = self.lowered[np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)]
        blank = self.blank[data]
        edges = np.diff(np.concatenate(([True], blank)).astype(np.int8))
        starts = np.flatnonzero(edges == -1)
        ends = np.flatnonzero(edges == 1)
        self._reach(len(data) + 1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(self.letters[data] * self.powers[: len(data)], dtype=np.uint64)))
        hashes = mixed((sums[ends] - sums[starts]) * self.inverse[starts])
        bounds = np.cumsum([len(e) + 1 for e in encoded])
        return hashes, np.searchsorted(bounds, starts, side="right")

    def sets(self, texts: list[str | None]) -> list:
        """A sorted array of distinct shingle hashes for each text."""
        import numpy as np

        hashes, owner = self.words(texts)
        counts = np.bincount(owner, minlength=len(texts))
        n = max(0, len(hashes) - self.size + 1)
        shingles = np.zeros(n, dtype=np.uint64)
        for k in range(self.size):
            shingles = shingles * np.uint64(SHINGLE_BASE) + hashes[k : k + n]
        shingles = mixed(shingles)
        firsts = np.concatenate(([0], np.cumsum(counts)))
        out = []
        for number, count in enumerate(counts.tolist()):
            first = firsts[number]
            if count >= self.size:
                own = np.sort(shingles[first : first + count - self.size + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif count:
                whole = SHORT_TAG + count
                for h in hashes[first : first + count].tolist():
                    whole = (whole * SHINGLE_BASE + h) & MASK
                out.append(mixed(np.array([whole], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def parts(texts: list[str | None]):
    """(first, end) of runs of texts of about PART_BYTES together."""
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= PART_BYTES:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
