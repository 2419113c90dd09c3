import random

import numpy as np
import xxhash

from kmerlake.llm.components import components
from kmerlake.llm.simhash import covering_masks, fingerprint, links_by_middle, links_in_buckets, near_duplicates


def slow_fingerprint(text, width):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return bits - (1 << 64) if bits >> 63 else bits


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(values, radius):
    return [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius]


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(200):
        text = " ".join(rng.choices(["The", "a", "É", "x\ty", "\n"], k=rng.randrange(12)))
        assert fingerprint(text, 4) == slow_fingerprint(text, 4)
    assert fingerprint(None, 4) == fingerprint(" ", 4) == 0
    assert fingerprint("A b", 4) == slow_fingerprint("a  B", 4)


def test_masks_cover_every_pair():
    masks, rng = covering_masks(4), random.Random(2)
    assert len(masks) == 31
    for _ in range(3000):
        flipped = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(not flipped & m for m in masks)


def family(rng, n):
    centre = rng.getrandbits(64)
    found = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(n)}
    found |= {rng.getrandbits(64) for _ in range(n)}
    return sorted(x - (1 << 64) if x >> 63 else x for x in found)


def test_links_in_small_and_crowded_buckets(spark):
    values = family(random.Random(3), 150)
    nodes = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    want = groups(near(values, 4), values)
    assert len(set(want.values())) < len(values) - 20
    for most in (2000, 3):
        direct, crowded = links_in_buckets(nodes, 4, most)
        assert (crowded.count() > 0) == (most == 3)
        links = [tuple(r) for r in direct.unionByName(links_by_middle(crowded, 4)).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
        assert groups(links, values) == want


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(500, 500)]
    links += [(1000, 1000 + k) for k in range(1, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {n: r for n, r in groups([p for p in links if p[0] != p[1]], {n for p in links if p[0] != p[1] for n in p}).items()}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_near_duplicates(spark, odd_docs):
    rows = near_duplicates(odd_docs, width=4, keep=["doc_id", "text"]).collect()
    assert len(rows) == 10
    component = {(r["doc_id"], r["text"]): r["component_id"] for r in rows}
    assert {component[k] for k in component if k[0] in (1, 2)} == {1}
    assert {component[k] for k in component if k[0] in (3, 4, 8)} == {3}
    assert [v for k, v in component.items() if k[0] is None] == [None]
    assert all(r["fingerprint"] == slow_fingerprint(r["text"], 4) for r in rows if r["doc_id"] != 7)
    assert near_duplicates(odd_docs.limit(0)).count() == 0


def test_unsigned_bits():
    assert np.bitwise_count(np.array([-1]).view(np.uint64))[0] == 64
