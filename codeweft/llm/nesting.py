"""Room for deep recursion of the parsers.

Calls between plain Python functions take heap, not machine stack, so the limit on them is only a
number. It is raised while a file is parsed; what nests even deeper (about 200,000 brackets, more
than any compiler of these languages takes) is reported as an error and never accepted unparsed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

#: Frames of a parser at most; a frame takes some 200 bytes.
FRAMES = 1_000_000
TOO_DEEP = "nested too deeply"


@contextmanager
def deep() -> Iterator[None]:
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, FRAMES))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)
