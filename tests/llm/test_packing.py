import os
import random

import pytest

from loomgraph.llm import packing as P

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")


def test_bins_never_overflow_and_waste_little():
    r = random.Random(10)
    bins, used = P.Bins(2048, 64), {}
    for _ in range(20_000):
        n = r.choice([r.randint(0, 300), r.randint(1, 2048)])
        b = bins.put(n)
        used[b] = used.get(b, 0) + n
        assert used[b] <= 2048 and bins.open <= 64
    assert sum(used.values()) / (len(used) * 2048) > 0.97
    assert sum(map(len, bins.by_free.values())) == bins.open


def test_best_fit_takes_the_fullest_that_fits():
    bins = P.Bins(10, 4)
    assert [bins.put(n) for n in (6, 5, 4, 5, 9)] == [0, 1, 0, 1, 2]


@needs_vocabulary
def test_texts_stay_whole(spark):
    texts = [(1, "hello world"), (2, ""), (3, None), (4, "a b c d " * 3000), (5, "x"), (5, "x"), (6, "<|endoftext|> ordinary")]
    df = spark.createDataFrame([(i, t, 7, 8, 9) for i, t in texts], "doc_id long, text string, n_tokens long, k int, g int")
    out = P.packed(df, VOCABULARY).collect()
    e = P.encoding(VOCABULARY)
    size = {i: len(e.encode_ordinary(t)) for i, t in texts if t is not None}
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    assert set(got) == {1, 2, 4, 5, 6} and len(got[5]) == 2
    assert all(sum(v) == size[i] * (2 if i == 5 else 1) for i, v in got.items())
    assert all(len(v) == 1 for i, v in got.items() if size[i] <= 2048 and i != 5) and len(got[4]) == -(-size[4] // 2048)
    per = {}
    for r in out:
        per[r.container_id] = per.get(r.container_id, 0) + r.n_tokens
    assert max(per.values()) <= 2048
    f = P.fill(P.packed(df, VOCABULARY)).first()
    assert f.containers == len(per) and f.tokens == sum(per.values())
    assert P.packed(df.limit(0), VOCABULARY).count() == 0 and P.fill(P.packed(df.limit(0), VOCABULARY)).first().filled is None
