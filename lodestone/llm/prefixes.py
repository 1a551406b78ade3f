"""What the exact set-similarity joins share: the order of set members by rarity, and members that very many sets send.

Members are 32-bit hashes; their top COUNTER_BITS choose a counter. Any one order
and any choice of hot members gives right results, so counters may be shared.
"""

from __future__ import annotations

import numpy as np

COUNTER_BITS = 20
#: Sets in one list of a member.
LIST_ROWS = 4000


def short(h: np.ndarray) -> np.ndarray:
    """32 bits of mixed 64-bit hashes."""
    return (h >> np.uint64(32)).astype(np.uint32)


def counter(member: np.ndarray) -> np.ndarray:
    """The counter of each 32-bit member."""
    return (member >> np.uint32(32 - COUNTER_BITS)).astype(np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Place of each counter, rarest first."""
    rank = np.empty(len(counts), np.uint32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.uint32)
    return rank


class Hot:
    """Counters of members that more than LIST_ROWS sets send, and into how many lists each is dealt."""

    def __init__(self, counts: np.ndarray) -> None:
        self.at = np.flatnonzero(counts > LIST_ROWS)
        self.lists = -(-counts[self.at] // LIST_ROWS)

    def of(self, member: np.ndarray) -> np.ndarray:
        """Lists of each member; 1: not hot."""
        if not len(self.at):
            return np.ones(len(member), np.int64)
        own = counter(member)
        place = np.minimum(np.searchsorted(self.at, own), len(self.at) - 1)
        return np.where(self.at[place] == own, self.lists[place], 1)
