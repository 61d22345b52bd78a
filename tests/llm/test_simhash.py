import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import registry, simhash
from lodestar.llm.components import components


def plain(text, width=3):
    """The fingerprint, bit by bit."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \n\t\x0bé ", max_size=60))
def test_fingerprints(text):
    assert simhash.fingerprint(text) == plain(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint(text) == plain(text)


def test_golay_words_within_two_share_an_index():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 5000)
    for flips in ((), (3,), (0, 22), (7, 8)):
        other = words ^ sum(1 << f for f in flips)
        a, b = simhash.golay_indices(words), simhash.golay_indices(other)
        assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


def brute(prints):
    """Smallest member of each fingerprint's component, by comparing all pairs."""
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for p in prints:
            least = min(label[q] for q in prints if bin(p ^ q).count("1") <= 2)
            changed |= least < label[p]
            label[p] = least
    return label


def test_links_connect_what_all_pairs_connect(spark):
    pick, prints = random.Random(5), set()
    for center in (0, 1 << 40 | 12345, (1 << 63) - 7):
        for _ in range(90):  # more than PAIRS_UP_TO share keys: one-bit neighbours must do it
            p = center
            for _ in range(pick.choice((0, 1, 2, 3, 5))):
                p ^= 1 << pick.randrange(63)
            prints.add(p)
    prints |= {pick.getrandbits(63) for _ in range(100)}
    distinct = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r.u: r.root for r in components(simhash.links(distinct)).collect()}
    label, expected = {p: roots.get(p, p) for p in prints}, brute(sorted(prints))
    groups = lambda m: sorted(sorted(p for p in prints if m[p] == r) for r in set(m.values()))
    assert groups(label) == groups(expected)


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.u: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)} | {2: 2, 3: 2}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_documents(spark, odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [of[i].fingerprint for i in (0, 1, 2)] == ["0" * 16] * 3 and of[2].component_id == 0
    assert of[9].component_id == of[10].component_id == 9
    lonely = next(r for r in rows if r.doc_id is None)
    assert lonely.component_id is None and lonely.fingerprint == f"{plain('a'):016x}"
    assert simhash.near_duplicates(empty).collect() == []


def test_query_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {d.doc_id: plain(d.text) for d in docs}
    label = brute(sorted(set(prints.values())))
    least = {}
    for i in sorted(prints):
        least.setdefault(label[prints[i]], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.op5_simhash(spark, sf).collect()}
    assert got == {i: (f"{p:016x}", least[label[p]]) for i, p in prints.items()}
