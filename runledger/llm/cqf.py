"""A counting quotient filter over 64-bit fingerprints, as sorted runs of remainders.

A fingerprint is split into its leading bits, the quotient, and the rest, the
remainder. For each quotient the filter keeps the sorted remainders with their
counts. All bits are kept, so building filters apart and merging them loses nothing.
"""

from __future__ import annotations

import io

import numpy as np


class CountingQuotientFilter:
    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray, head: int, skip: int):
        self.runs, self.remainders, self.counts, self.head, self.skip = runs, remainders, counts, head, skip

    @classmethod
    def build(cls, prints: np.ndarray, skip: int = 0, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """From uint64 fingerprints that agree in their first ``skip`` bits."""
        if counts is None:
            prints, counts = np.unique(prints, return_counts=True)
        q = max(1, int(len(prints)).bit_length())
        q = min(q, 63 - skip)
        shift = np.uint64(64 - skip - q)
        inner = prints & np.uint64((1 << (64 - skip)) - 1) if skip else prints
        head = int(prints[0]) >> (64 - skip) if skip and len(prints) else 0
        runs = np.bincount((inner >> shift).astype(np.int64), minlength=1 << q).astype(np.uint32)
        return cls(runs, inner & np.uint64((1 << int(shift)) - 1), counts.astype(np.int64), head, skip)

    def fingerprints(self) -> np.ndarray:
        """All fingerprints, ascending."""
        q = int(len(self.runs)).bit_length() - 1
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        inner = (quotients << np.uint64(64 - self.skip - q)) | self.remainders
        return inner | np.uint64(self.head << (64 - self.skip)) if self.skip else inner

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the summed counts: the sorted runs are merged, equal fingerprints add up."""
        prints = np.concatenate([f.fingerprints() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.empty(0, np.int64)
        return cls.build(prints[first], filters[0].skip, np.add.reduceat(counts, first) if len(first) else counts)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, runs=self.runs, remainders=self.remainders, counts=self.counts, at=np.array([self.head, self.skip], dtype=np.uint64))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        z = np.load(io.BytesIO(data))
        return cls(z["runs"], z["remainders"], z["counts"], int(z["at"][0]), int(z["at"][1]))
