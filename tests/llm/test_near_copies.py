import random

import numpy as np
import pytest

import corpus_pipeline as cp
from inkweave.llm import near_copies as nc
from inkweave.llm.components import connected_components


def plain_groups(texts):
    """{id: least id} over all pairs of word-shingle sets at least 0.8 alike."""
    words = {i: t.lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: top(i) for i in texts}


def edited():
    r = random.Random(3)
    bases = [[r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randint(0, 400)) for _ in range(n)] for n in (3, 12, 60, 150, 400, 900)]
    out = []
    for base in bases:
        for k in range(12):
            w = list(base)
            for _ in range(round(len(w) * k * 0.004)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            out.append(" ".join(w))
    return {i: t for i, t in enumerate([*out, "", "  "])}


@pytest.mark.parametrize(("few", "tile"), [(16, 1024), (1, 4)])
def test_same_groups_as_all_pairs(spark, few, tile):
    texts = edited()
    want = plain_groups(texts)
    df = spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in nc.jaccard_components(df, few=few, tile=tile).collect()}
    assert got == want and 10 < len(set(want.values())) < len(want) - 10


def test_stage_drops_edited_copies(spark):
    texts = edited()
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in cp.near_duplicates(spark, df, "").collect()} == set(plain_groups(texts).values())


def test_empty_table(spark):
    assert nc.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_pairs_meet():
    # 2000 pairs of sets 0.8 to 0.9 alike: what shares no key, or lies further apart in bits than is looked, is lost
    r = np.random.default_rng(11)
    lost = 0
    for _ in range(2000):
        n = int(r.integers(30, 300))
        x = r.integers(0, 2**63, n + n // 4, dtype=np.int64).astype(np.uint64)
        own = int(n * r.uniform(0.05, 0.11))
        a, b = np.sort(x[:n]), np.sort(np.concatenate([x[: n - own], x[n : n + own]]))
        assert 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
        near = (nc.print_of(a) ^ nc.print_of(b)) & (2**64 - 1)
        lost += not set(nc.band_keys(a)) & set(nc.band_keys(b)) or near.bit_count() > nc.REACH
    assert lost == 0


def test_tiles_are_formed_by_blocks_of_the_fingerprint():
    x = np.random.default_rng(5).integers(0, 2**64, 700, np.uint64)
    bits = nc.bits_of(x, 8)
    first = [2 * sum(int(h) >> k & 1 for h in x) > len(x) for k in range(64)]
    assert bits[:64].tolist() == first and nc.print_of(x) % 2**64 == sum(b << k for k, b in enumerate(first))
    for wide in (8, 9):
        blocks = [bits[w + k : w + k + wide] for w in range(0, 512, 64) for k in range(0, 65 - wide, wide)][: nc.bands_of(wide)]
        assert nc.band_keys(x, wide) == [(n << wide) + sum(int(b) << k for k, b in enumerate(block)) for n, block in enumerate(blocks)]
    assert not set(nc.band_keys(x)[:8]) & set(nc.band_keys(~x)[:8])


def test_blocks_grow_with_the_table_and_miss_no_more():
    assert [nc.wide_of(n) for n in (0, 1, 1 << 22, (1 << 22) + 1, 15_000_000)] == [8, 8, 8, 9, 10]
    for wide in range(8, 17):
        assert (1 - (1 - nc.APART) ** wide) ** nc.bands_of(wide) <= nc.MISS and nc.words_for(wide) <= len(nc._SEEDS)


def test_planted_pairs_agree_on_blocks_of_any_width():
    r, lost, far = np.random.default_rng(12), 0, 0
    for wide in (8, 10):
        for _ in range(1000):
            n = int(r.integers(6, 300))
            own = n // 9  # (n - own) of n + own: at least 0.8, near it where n is large
            x = r.integers(0, 2**64, n + own + 1, np.uint64)
            a, b = np.sort(x[:n]), np.sort(np.concatenate([x[: n - own], x[n : n + own]])) if own else np.sort(x[: n + 1])
            assert 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
            lost += not set(nc.band_keys(a, wide)) & set(nc.band_keys(b, wide))
            far += np.count_nonzero(nc.bits_of(a, nc.PRINTS) != nc.bits_of(b, nc.PRINTS)) > nc.FAR
    assert lost == far == 0


@pytest.mark.parametrize("n", [3, 300, 2300])
def test_stars_of_a_tile_span_its_components(n):
    r = np.random.default_rng(n)
    prints = r.integers(0, 2**64, (n, nc.PRINTS), np.uint64)
    for k in range(1, n, 2):  # every second lies some bits from one before it, every tenth is a copy of one
        prints[k] = prints[r.integers(0, k)] ^ (np.uint64(0 if k % 5 == 0 else (1 << int(r.integers(1, 40))) - 1))
    sizes = r.choice([20, 22, 40], n)
    near = lambda i, j: np.bitwise_count(prints[i] ^ prints[j]).sum() <= nc.FAR and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        apart = np.bitwise_count(prints[:i] ^ prints[i]).sum(axis=1)
        for j in np.flatnonzero(apart <= nc.FAR):
            if near(i, j):
                root[top(i)] = top(j)
    words = prints[:, 0].view(np.int64).tolist()
    stars = nc.print_stars(prints, sizes, 0.8)
    got = {w: {w} for w in words}
    for u, v in stars:
        both = got[u] | got[v]
        for w in both:
            got[w] = both
    same = {}
    for i, w in enumerate(words):
        same.setdefault(top(i), set()).add(w)
    want = {w: {w} for w in words}
    for s in same.values():
        both = set().union(*(want[w] for w in s))
        for w in both:
            want[w] = both
    assert got == want and len(stars) < n


@pytest.mark.parametrize("tile", [1 << 14, 3])
def test_crowded_blocks_in_small_tiles(spark, tile):
    r = np.random.default_rng(8)
    base, rows = r.integers(0, 2**64, 200, np.uint64), []
    for k in range(40):  # a group of near copies and as many others
        for x in (np.concatenate([base[k // 4 :], r.integers(0, 2**64, 6, np.uint64)]), r.integers(0, 2**64, 60, np.uint64)):
            bits = nc.bits_of(x, 6)
            rows.append((nc.words_of(bits).tolist(), len(x), nc.short_keys(x)))
    nodes = spark.createDataFrame(rows, "words array<long>, n long, shorts array<long>")
    found = connected_components(nc.print_edges(nodes, 8, 0.8, tile)).collect()
    assert {f["node"] for f in found} == {x[0][0] for x in rows[::2]} and len({f["root"] for f in found}) == 1
    assert nc.print_edges(nodes.limit(0), 8, 0.8).count() == 0


@pytest.mark.parametrize("wide", [8, 10])
def test_blocks_of_a_column_are_those_of_the_bits(spark, wide):
    bits = [nc.bits_of(np.random.default_rng(k).integers(0, 2**64, 50, np.uint64), nc.words_for(wide)) for k in range(5)]
    df = spark.createDataFrame([(nc.words_of(b).tolist(),) for b in bits], "words array<long>").coalesce(1)
    got = [r["b"] for r in df.select(nc.block_column(df["words"], wide).alias("b")).collect()]
    assert sorted(got) == sorted(nc.block_keys(b, wide).tolist() for b in bits)


def test_texts_of_few_shingles(spark):
    # five of nine words and four of eight: four shared of five
    texts = {10 * k + j: " ".join(f"w{k}x{i}" for i in range(8 + j)) for k in range(150) for j in (0, 1)}
    got = {r["id"]: r["component_id"] for r in nc.jaccard_components(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert got == {i: i // 10 * 10 for i in texts}
