import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lodestar.llm import lexical, registry

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k):
    """Every item against every document, in one process."""
    held = [(i, Counter(t), len(t)) for i, x in docs if (t := words(x))]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for i, x in items:
        wanted.setdefault(i, set()).update(words(x))
    out = []
    for item, own in wanted.items():
        scores = []
        for doc, tf, size in held:
            m = 50 + 50 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in own if t in tf)
            if s > 0:
                scores.append((-s, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


ITEMS = [(1, "The fox jumps, the FOX"), (2, None), (3, ""), (4, "été Été x5"), (5, "nothing_here zzz"), (None, "tie"), (5, "a1b2 tie"), (6, "!!!")]


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id long, text string, rank int")


def test_odd_documents_and_items(spark, odd, empty, monkeypatch):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(lexical.ranked(odd, items(spark, ITEMS), 4)) == brute(docs, ITEMS, 4)
    monkeypatch.setattr(lexical, "ENTRIES", 4)  # several blocks of items
    assert found(lexical.ranked(odd.repartition(5), items(spark, ITEMS), 2)) == brute(docs, ITEMS, 2)
    assert found(lexical.ranked(empty, items(spark, ITEMS))) == [] == found(lexical.ranked(odd, items(spark, [])))


def test_pieces_of_long_texts_and_blocks_of_documents(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "Ab,cd  ÉF" * 40 + "\x1c\x85 end\x7fA"
    assert [t for part in lexical.terms(text.encode()) for t in part] == [w.encode() for w in words(text)]
    assert list(lexical.terms(None)) == [] == [t for p in lexical.terms(b" .,; ") for t in p]


def test_lengths_beyond_64_bits():
    import numpy as np

    p = lexical.Product(np.array([0, 1]), np.array([0], np.int32), np.array([3000]), 10**13, 10**18, 5)
    big = 10**7
    p.add(np.array([4]), np.array([big]), np.array([0]), np.array([0]), np.array([7]))
    m = 50 + 50 * big * 10**13 // 10**18
    assert p.held[0][1].tolist() == [3000 * (7 * 10**9 // (7000 + 20 * m))]


def test_query_agrees_with_sql_and_brute_force(spark, sf):
    got = found(registry.op11_ranked(spark, sf))
    with duckdb.connect() as c:
        for f in Path(sf).glob("*.parquet"):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        theirs = c.execute(lexical.ranked_sql()).fetchall()
        docs = c.execute("SELECT doc_id, text FROM documents").fetchall()
        asked = c.execute("SELECT item_id, text FROM benchmark").fetchall()
    assert got == sorted(theirs, key=str) == brute(docs, asked, 50)
    assert got and max(Counter(g[0] for g in got).values()) == 50


@pytest.mark.parametrize("text", ["", "A", "AZ09az", "a\x00b", "ﬀ ½ ٣"])
def test_terms(text):
    assert [t.decode() for part in lexical.terms(text.encode()) for t in part] == words(text)
