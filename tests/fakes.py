"""Encoders without models: an image is a text file with a brightness, its vector (b, 255 - b) scaled to one."""

import numpy as np


def brightness(data: bytes) -> int:
    return int(data)


class Fake:
    name, revision = "fake", "r1"

    def __init__(self, model_id: str):
        self.model_id = model_id

    def encode_images(self, images):
        return np.array([[v, 255 - v] for v in images], float)

    def encode_queries(self, texts):
        return np.array([[1.0, 0.0] if t == "bright" else [0.0, 1.0] for t in texts])


class Blind(Fake):
    """Fails if it is asked for an image."""

    def encode_images(self, images):
        raise AssertionError("a search of an index encodes no image")


def siglip2():
    return Fake("siglip2")


def clip():
    return Fake("clip")


FACTORIES = {"siglip2": siglip2, "clip": clip}
BLIND = {"siglip2": lambda: Blind("siglip2"), "clip": lambda: Blind("clip")}


def make(model_id, device, name=None, revision=None):
    made = Fake(model_id)
    made.name, made.revision = name or made.name, revision or made.revision
    return made


def evidence(folder, values=(10, 100, 240, "broken")):
    folder.mkdir(parents=True, exist_ok=True)
    for i, v in enumerate(values):
        (folder / f"{i}.png").write_text(str(v))
    return folder
