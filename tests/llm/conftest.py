import public_tokenizers
import pytest

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards brew strange potions under a pale moon and nobody asks why".split()


def prose(seed: int, n: int) -> str:
    """n words, different for each seed."""
    import random

    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(40)) for _ in range(n))


#: Texts that every operator on documents must take.
ODD = [None, "", " \n\t ", "!!! 123", "a", "Äé ñ 日本 🙂", "<|endoftext|> <s> ▁▁ [MASK]", "x" * 5000, prose(1, 20_000), "tie tie", "tie tie", "a  b c\x1cd"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, ids null and repeated, an extra column of each kind that operators might add."""
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, float(i), "x", i) for i, t in enumerate(ODD)] + [(9, "tie tie", "de", 0.0, "y", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, fingerprint string, rank int")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def pieces():
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")
