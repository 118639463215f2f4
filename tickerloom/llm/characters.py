"""Characters of many texts at once, as numpy arrays of code points."""

from __future__ import annotations

import numpy as np


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each after one zero and with one zero at the end; the n + 1 places of
    those zeros. Null is as the empty text."""
    lowered = [(t or "").lower() for t in texts]
    data = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.zeros(len(lowered) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in lowered], out=places[1:])
    return data, places


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([any(c.isalpha() for c in t) if t else False for t in texts], bool)
