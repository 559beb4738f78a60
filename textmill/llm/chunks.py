"""Cutting texts into chunks that byte-level BPE encodes independently."""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import islice

import numpy as np

#: A space before a non-space always begins a new piece of the pattern that
#: byte-level BPE splits by, so a text may be cut there.
_CUT = re.compile(r" (?=\S)")
_OTHER = re.compile(r" (?:\s|\Z)")


class ChunkTable:
    """Numbers the distinct chunks of a slice of the corpus."""

    def __init__(self):
        self.index: dict[str | tuple[str], int] = defaultdict()
        self.index.default_factory = self.index.__len__

    def add(self, text: str) -> np.ndarray:
        """Chunk numbers of ``text`` in order.  All but the first chunk are
        keyed without the space that precedes them."""
        if not text:
            return np.empty(0, np.int32)
        parts = _CUT.split(text) if _OTHER.search(text) else text.split(" ")
        head = parts[0]
        if not head:  # the text begins with a space that belongs to the next chunk
            parts = parts[1:]
            first = []
        else:
            first = [self.index[(head,)]]
            parts = parts[1:]
        out = np.fromiter(map(self.index.__getitem__, parts), np.int32, len(parts))
        return np.concatenate([np.array(first, np.int32), out]) if first else out

    def chunks(self, since: int = 0) -> list[str]:
        """The chunks by number from ``since`` on, as they stand in the texts."""
        return [c[0] if isinstance(c, tuple) else " " + c for c in islice(self.index, since, None)]
