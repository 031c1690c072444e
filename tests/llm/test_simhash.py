import random
import re

import pytest
import xxhash

from inkweave.llm import simhash as sh
from inkweave.llm.components import connected_components


def plain_print(text):
    """The fingerprint as the contract words it."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(edges, nodes):
    root = {i: i for i in nodes}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in nodes}


def texts_of(r):
    out = ["", None, " \t\x0b ", "One", "one", "ONE two", "one two three", "\u00c9t\u00e9 A\x1cb c d", "a b " * 70_000]
    for n in (1, 2, 3, 5, 40, 200):
        base = [r.choice("abcdefghij") + str(r.randint(0, 50)) for _ in range(n)]
        for k in range(8):
            w = list(base)
            if k and n > 4:
                w[r.randrange(n)] = f"x{k}"
            out.append(r.choice(" \n\t").join(w))
    return out


@pytest.mark.parametrize("tile", [1024, 2])
def test_against_all_pairs(spark, tile):
    texts = texts_of(random.Random(2))
    prints = [plain_print(t) for t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = groups(edges, range(len(texts)))
    df = spark.createDataFrame([*enumerate(texts), (None, texts[-1]), (3, texts[3])], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as id", "3 as component_id")
    got = sh.simhash_components(df, tile=tile).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        i = len(texts) - 1 if r["id"] is None else r["id"]
        assert (r["fp"] % 2**64, r["component_id"]) == (prints[i], want[i])
    assert sh.simhash_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [4, 64])
def test_crafted_fingerprints_in_small_tiles(spark, tile):
    r = random.Random(5)
    top = (1 << 64) - 1
    fps = {0, top, 1, 3, 7, 15, *[1 << k for k in range(64)]}  # a hub at zero
    chain = [r.getrandbits(64)]
    for k in range(150):
        chain.append(chain[-1] ^ (3 << (k % 63)))
    for _ in range(20):
        f = r.getrandbits(64)
        fps |= {f, f ^ (1 << r.randrange(64)), f ^ (7 << r.randrange(60))}
    fps |= set(chain)
    nodes = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    edges = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if ((a ^ b) % 2**64).bit_count() <= 2]
    want = {a: b for a, b in groups(edges, nodes).items() if any(a in e for e in edges)}
    df = spark.createDataFrame([(f,) for f in nodes], "fp long")
    got = {x["node"]: x["root"] for x in connected_components(sh.near_edges(df, tile=tile)).collect()}
    assert got == want and len(set(want.values())) > 5


def test_components_of_long_chains_hubs_and_odd_rows(spark):
    edges = [(i, i + 1) for i in range(700)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000), (1001, 1002), (1001, 1002)]
    df = spark.createDataFrame([*edges, (None, 4), (4, None)], "u long, v long")
    got = {x["node"]: x["root"] for x in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(701)}, **{i: 1000 for i in range(1000, 1400)}}
    assert connected_components(df.limit(0)).count() == 0


def test_kept_rows_of_any_columns(spark):
    rows = [(2, "a b c d", {"x": 1}), (1, "a b c d", {"y": 2}), (1, "a b c d", {"z": 3}), (None, "a b c d", {"x": 1}), (None, "a b c d", None), (None, None, None), (None, None, {}), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row map<string,int>")
    first = sorted(map(str, sh.keep_first_of_group(df).collect()))
    assert [(r["doc_id"] or 0, r["text"]) for r in sorted(sh.keep_first_of_group(df).collect(), key=lambda r: (r["doc_id"] or 0, r["text"] or ""))] == [(0, None), (0, "a b c d"), (1, "a b c d"), (9, None)]
    assert first == sorted(map(str, sh.keep_first_of_group(df.orderBy("row.x").repartition(3)).collect()))
    named = spark.createDataFrame([("k1", "a"), ("k2", "a"), ("7", "b"), ("7", "b")], "doc_id string, text string")
    assert sorted(r["text"] for r in sh.keep_first_of_group(named).collect()) == ["a", "b"]


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{k * k % 1013}" for k in range(5000)).encode()
    whole = sh.fingerprint_of(text)
    monkeypatch.setattr(sh, "CHUNK", 1)
    assert sh.fingerprint_of(text) == whole
