"""The SimHash step of the near-duplicate stage."""

import numpy as np

from skuforge.llm import near, simhash


def bits(text):
    return simhash.majority(near.shingles(text.encode()).view("<u8")) & (2**64 - 1)


def test_simhash_links_first_and_leaves_no_linked_pair_to_the_prefix_filter(spark, monkeypatch):
    seen = {}
    kept = near.written
    monkeypatch.setattr(near, "written", lambda df, name: seen.setdefault(name, kept(df, name)))
    base = " ".join(f"w{i * 7919 % 1009}" for i in range(400))
    texts = [base + f" end{k}" for k in range(12)] + [f"other words {k} " + " ".join(f"x{k}y{i}" for i in range(60)) for k in range(5)] + [None, " "]
    close = [k for k in range(1, 12) if (bits(texts[0]) ^ bits(texts[k])).bit_count() <= simhash.LINK_BITS]
    assert len(close) > 5
    rows = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "doc_id long, text_key string, text string")
    found = {r["doc_id"]: r["first"]["doc_id"] for r in near.near_duplicates(rows).collect()}
    assert found == {i: 0 if i < 12 else 17 if i > 16 else i for i in range(19)}
    assert seen["near-simhash-links"].count() >= len(close)
    root = {r["node"]: r["root"] for r in near.components(seen["near-simhash-links"]).collect()}
    stars = [(r["a"], r["b"]) for r in seen["near-stars"].collect()]
    assert all(root.get(a, a) != root.get(b, b) for a, b in stars)


def test_majority_of_no_hashes():
    assert simhash.majority(np.zeros(0, np.uint64)) == 0
