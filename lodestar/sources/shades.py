"""Encoders without a model: an image is a text file with a whole number from 0 to 255, its shade.

They try out an index or a search where no model is at hand:
``python -m lodestar index --encoder lodestar.sources.shades:make ...``.  Of the two
models one sees the shade as it is, the other more of the dark; the queries
"bright" and "dark" are the ends of the scale, and any other text lies between.
"""

from __future__ import annotations

import numpy as np

BRIGHTEST = 255


def decode(data: bytes) -> int:
    """A file's shade; anything but a whole number in range is a broken image."""
    shade = int(data)
    if not 0 <= shade <= BRIGHTEST:
        raise ValueError(f"no shade: {shade}")
    return shade


class Shades:
    """An encoder of shades: the vector (shade, depth x darkness)."""

    revision, dtype, weights, preprocessing, tokenizer = "1", "float32", None, "whole numbers", "two words"

    def __init__(self, model_id: str, name: str | None = None, revision: str | None = None):
        self.model_id, self.name, self.revision = model_id, name or "shades", revision or self.revision
        self.depth = 1.0 if model_id == "siglip2" else 2.0

    def encode_images(self, images: list[int]) -> np.ndarray:
        return np.array([[v, self.depth * (BRIGHTEST - v)] for v in images], float)

    def encode_queries(self, texts: list[str]) -> np.ndarray:
        ends = {"bright": [1.0, 0.0], "dark": [0.0, 1.0]}
        return np.array([ends.get(t, [1.0, 1.0]) for t in texts])

    def identity(self) -> dict:
        return {"depth": self.depth, "brightest": BRIGHTEST}


def available(device: str) -> bool:
    """They run anywhere."""
    return True


def make(model_id: str, device: str = "cpu", name: str | None = None, revision: str | None = None) -> Shades:
    return Shades(model_id, name, revision)


def siglip2() -> Shades:
    return Shades("siglip2")


def clip() -> Shades:
    return Shades("clip")


#: The two encoders in the order that indexes take them.
FACTORIES = {"siglip2": siglip2, "clip": clip}
