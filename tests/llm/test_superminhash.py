import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkweave.llm import superminhash as sm
from tests.oracle import assert_same


def plain_set(text, shingle=5):
    """The distinct shingles as the contract words them."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({" ".join(w)} if w else set())


def plain_groups(docs, per_cent=85):
    sets = [(i, plain_set(t)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, n=260):
    """Families of edited copies, one of them large, with shared passages and unlike texts between."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(300 if not k else r.choice((30, 80, 200)))] for k in range(12)]
    docs = []
    for k in range(n):
        base = bases[0] if k % 3 == 0 else r.choice(bases)
        kind = r.random()
        if kind < 0.2:
            text = [word() for _ in range(r.randrange(1, 90))] + passage
        else:
            text = list(base)
            for _ in range(r.randrange(0, 4)):
                text[r.randrange(len(text))] = word()
            if kind > 0.9:
                text += [word() for _ in range(r.randrange(1, 40))]
        docs.append((k, " ".join(text)))
    return docs


@pytest.mark.parametrize("how", [{}, {"few": 2, "tile": 4}, {"few": 3, "tile": 50}])
def test_same_as_all_pairs(spark, how):
    docs = corpus(5)
    got = sm.near_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), **how)
    want = plain_groups(docs)
    assert sorted(map(tuple, got.collect())) == want
    sizes = sorted(np.unique([c for _, _, c in want], return_counts=True)[1])
    assert sizes[-1] > 50 and len(sizes) > 60


def test_chains_across_a_crowded_bucket(spark):
    # each text is like the next alone, so no leader and no single tile sees all of the chain
    words = [f"v{k}" for k in range(1200)]
    docs = [(100 - k, " ".join(words[9 * k : 9 * k + 150])) for k in range(100)]
    got = sm.near_groups(spark.createDataFrame(docs, "doc_id long, text string"), few=2, tile=8)
    assert sorted(map(tuple, got.collect())) == plain_groups(docs)
    assert {c for _, _, c in plain_groups(docs)} == {1}


def test_planted_pairs_share_a_band():
    # 2000 pairs of similarity 0.85 to 0.9: what no band brings together is lost
    r = np.random.default_rng(7)
    lost = 0
    for _ in range(2000):
        n = int(r.integers(40, 400))
        x = np.unique(r.integers(0, 2**63, n + n // 6, dtype=np.int64).astype(np.uint64))
        r.shuffle(x)
        own = int(0.15 * n / 1.85)
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[: n - own], x[n : n + own]]))
        assert 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
        s = sm.signatures([a, b])
        lost += not set(sm.band_keys(s[0])) & set(sm.band_keys(s[1]))
    assert lost == 0


def test_signature_is_unbiased_and_less_scattered_than_independent_minima():
    r = np.random.default_rng(3)
    for n in (20, 120):
        own = round(0.15 * n / 2)
        errors = []
        for _ in range(400):
            x = r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
            a, b = x[: n - own], x[own:]
            s = sm.signatures([a, b])
            errors.append((s[0] == s[1]).mean() - (n - 2 * own) / n)
        likeness = (n - 2 * own) / n
        assert abs(np.mean(errors)) < 0.005
        assert np.std(errors) < 0.9 * np.sqrt(likeness * (1 - likeness) / sm.PLACES)


def test_early_stop_changes_nothing():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)) for n in (1, 2, 7, 300, 5000, 70_000)] + [np.zeros(0, np.uint64)]

    def whole(elements, places=sm.PLACES):
        """Every rank of every element, one after the other."""
        held = [2**64 - 1] * places
        for e in elements.tolist():
            order = list(range(places))
            for rank in range(places):
                if rank > max(held) >> 32:
                    break
                draw = int(sm._mixed(np.array([(e + sm._STEP * (rank + 1)) % 2**64], np.uint64))[0])
                k = rank + ((draw >> 32) * (places - rank) >> 32)
                order[rank], order[k] = order[k], order[rank]
                held[order[rank]] = min(held[order[rank]], rank << 32 | draw & 0xFFFFFFFF)
        return held

    together = sm.signatures(sets)
    for k in (0, 1, 2, 3, 6):
        assert together[k].tolist() == whole(sets[k])
    for k, s in enumerate(sets):
        assert (sm.signatures([s])[0] == together[k]).all()


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a  b\tc d"), (8, "a b c d e"), (8, "a b c d e"), (9, "A B C D E"), (10, "Ä b c d e"), (11, "ä b c d e"), (12, "x " * 9000), (13, "x " * 9001)]
    df = spark.createDataFrame([*docs, (None, "one"), (None, None)], "doc_id long, text string").select("*", F.lit(1).alias("key"), F.lit("x").alias("row"), F.lit(2).alias("id"))
    got = sorted(map(tuple, sm.near_groups(df).collect()), key=repr)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 1, 8), (8, 1, 8), (9, 1, 8), (10, 1, 10), (11, 1, 11), (12, 1, 12), (13, 1, 12), (None, 0, None), (None, 1, None)]
    assert got == sorted(want, key=repr)
    kept = sm.first_of_groups(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 0, 1, 2, 3, 4, 6, 8, 8, 10, 11, 12]
    assert sm.near_groups(df.limit(0)).count() == 0


def test_whole_tables(spark, sf):
    assert assert_same(sm.op12_superminhash(spark, sf), sf, sm.SQL) == 200
