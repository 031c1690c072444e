import base64

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as cp
from inkweave.llm import bpe, mixing
from tests.llm.test_near_copies import plain_groups
from tests.llm.test_quality_rules import brute
from tests.llm.test_secrets import base


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(stage name, its input, its output) over real documents."""
    sf = "/root/testdata/sf0.001"
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, fn) in enumerate(cp.STAGES):
        fn(spark, docs, sf).write.parquet(f"{top}/{k}")
        after = spark.read.parquet(f"{top}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == [s[0] for s in stages]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_drops_what_fails(stages):
    _, before, after = stages[0]
    want = {i for i, r in rows(before).items() if not brute(r["text"])[-1]}
    assert set(rows(after)) == want and 0 < len(want) < before.count()


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    assert set(rows(after)) == set(plain_groups({i: r["text"] for i, r in rows(before).items()}).values())


def test_secrets_are_masked_and_nothing_else(stages):
    _, before, after = stages[2]
    old, new = rows(before), rows(after)
    assert set(old) == set(new)
    for i, r in new.items():
        spans = [x for v in base(old[i]["text"]).values() for x in v]
        assert (r["text"] != old[i]["text"]) == bool(spans)
        assert not any(base(r["text"]).values()) and r["n_chars"] == len(r["text"])


def test_mixture_is_that_of_the_operator(spark, stages):
    _, before, after = stages[3]
    want = {r["id"] for r in mixing.mixed(before).where("kept").select("id").collect()}
    assert set(rows(after)) == want and 0 < len(want) < before.count()


def test_tokens(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.VOCABULARY), "rb"))}
    true = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, before, after = stages[4]
    texts = rows(before)
    got = rows(after)
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["ids"] == true.encode_ordinary(texts[i]["text"]) and r["n_tokens"] == len(r["ids"])


def test_odd_rows_pass_through(spark):
    good = " ".join(f"word{i}" for i in range(40))
    data = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, good.upper(), "en", "b", 1), (None, good + " x", None, None, None), (None, good + " x", None, None, None), (3, None, "en", "a", None), (4, "", "en", "a", 0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "9 as row", "8 as id", "7 as words", "'t' as topic")
    for given in (docs, docs.limit(0)):
        now = given
        for _, fn in cp.STAGES[:-1]:
            now = fn(spark, now, "")
            assert now.columns == docs.columns
        assert cp.STAGES[-1][1](spark, now, "").columns == ["doc_id", "n_tokens", "ids"]
    left = cp.near_duplicates(spark, cp.quality(spark, docs, ""), "").collect()
    assert sorted((r["doc_id"] or 0) for r in left) == [0, 1]
