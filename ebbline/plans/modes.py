"""Table modes and where each write goes."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Kind(Enum):
    TIERED = "tiered"  # old rows in the lake, corrected by an overlay
    DIRECT = "direct"  # old rows in the lake, written there
    MIRRORED = "mirrored"  # all rows hot, copied to the lake by a change feed


class Cold(Enum):
    """What the part of a read below the cut-line is made of."""

    NONE = "none"
    OVERLAY = "overlay"
    LIVE = "live"


@dataclass(frozen=True)
class Placement:
    """Where a row is written, and which checks come before."""

    hot: bool = False
    delta: bool = False
    lake: bool = False
    check_retention: bool = False
    hot_floor: bool = False  # a hot delete only touches keys at or above the cut-line

    def __or__(self, other: Placement) -> Placement:
        return Placement(*(a or b for a, b in zip(self._flags(), other._flags(), strict=True)))

    def _flags(self) -> tuple[bool, ...]:
        return self.hot, self.delta, self.lake, self.check_retention, self.hot_floor


@dataclass(frozen=True)
class Mode:
    kind: Kind
    keep_heap: bool = False  # tiered, direct: rows stay hot after tiering too
    heap_retention: bool = False  # mirrored: old rows leave the hot set

    def __post_init__(self):
        if self.kind is Kind.MIRRORED and self.keep_heap:
            raise ValueError("a mirrored table has no keep_heap")
        if self.kind is not Kind.MIRRORED and self.heap_retention:
            raise ValueError("heap_retention is for mirrored tables")

    @classmethod
    def parse(cls, text: str) -> Mode:
        name, _, option = text.partition("+")
        return cls(Kind(name), option == "keep_heap", option == "heap_retention")

    def __str__(self) -> str:
        return self.kind.value + ("+keep_heap" if self.keep_heap else "") + ("+heap_retention" if self.heap_retention else "")

    @property
    def routes_by_cut(self) -> bool:
        """Whether a row is only on its own side of the cut-line."""
        return not self.keep_heap and not self.hot_complete

    @property
    def hot_complete(self) -> bool:
        """Whether the hot set alone answers every read."""
        return self.kind is Kind.MIRRORED and not self.heap_retention

    @property
    def cold(self) -> Cold:
        if self.hot_complete:
            return Cold.NONE
        return Cold.LIVE if self.kind is Kind.DIRECT else Cold.OVERLAY

    def insert(self, hot: bool) -> Placement:
        if hot or self.hot_complete:
            return Placement(hot=True)
        if self.kind is Kind.DIRECT:
            return Placement(hot=self.keep_heap, lake=True, check_retention=True)
        return Placement(hot=self.keep_heap, delta=True, check_retention=self.kind is Kind.TIERED)

    def delete(self, hot: bool) -> Placement:
        at = self.insert(hot)
        return Placement(at.hot, at.delta, at.lake, self.routes_by_cut and not hot, self.routes_by_cut and hot)

    def update(self, old_hot: bool, new_hot: bool) -> Placement:
        """A delete where the row was and an insert where it goes."""
        return self.delete(old_hot) | self.insert(new_hot)
