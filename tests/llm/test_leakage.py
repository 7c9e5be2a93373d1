import random

import numpy as np

from loomgraph.llm import leakage as L
from loomgraph.llm.markup import plain, words

D = "doc_id long, text string, item_id long, passage string, id long"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 5, "p", 6) for i, t in docs], D)
    i = spark.createDataFrame([(k, p, 1) for k, p in items], "item_id long, passage string, doc_id long")
    return {(r.doc_id, r.item_id) for r in L.leaks(d, i).collect()}, d, i


def text(r, n, pool="w"):
    return [f"{pool}{r.randrange(3000)}" for _ in range(n)]


def test_markup_is_left_out():
    assert words("<ref>Smith 1900</ref>The '''[[Big house|house]]'''<!-- no --> of{{citation needed|date=May 2014}} [http://x.example Joe's]&nbsp;Bar<br />") == ["the", "house", "of", "joe", "s", "bar"]
    assert "quoted words that go on for rather longer than eight" in plain("{{quote|quoted words that go on for rather longer than eight}}")
    assert words(None) == [] and words("") == []


def test_edited_passages_are_found_and_short_or_distant_ones_are_not(spark):
    r = random.Random(11)
    items = [(k, " ".join(text(r, 80))) for k in range(12)]
    docs, want = [], set()
    for k, p in items:
        w = p.split()
        edited = list(w[10:60])
        for i in range(2, 50, 6):
            edited[i] = "changed"
        dropped = [x for i, x in enumerate(w[:60]) if i % 7 != 3]
        added = [y for i, x in enumerate(w[20:60]) for y in ([x, "more"] if i % 6 == 2 else [x])]
        cases = [(w[30:50], True), (w[30:49], False), (edited, True), (dropped, True), (added, True), ([x if i % 3 else "no" for i, x in enumerate(w)], False), (w[5:12] + text(r, 9, "z") + w[40:48], False)]
        for c, leaks in cases:
            i = len(docs)
            t = text(r, 40, "q") + c + text(r, 40, "q")
            docs.append((i, (", ".join(t)).upper() if i % 2 else "\n".join(t)))
            if leaks:
                want.add((i, k))
    got, d, i = run(spark, docs, items)
    assert got == want
    clean = {x.doc_id for x in L.without_leaks(d, i).collect()}
    assert clean == {x for x, _ in docs} - {x for x, _ in want}


def test_nulls_ties_and_nothing(spark):
    p = " ".join(f"w{i}" for i in range(30))
    got, d, i = run(spark, [(1, p), (1, p), (2, None), (3, ""), (None, p)], [(7, p), (8, p), (9, None), (10, "too short"), (None, p)])
    assert got == {(1, 7), (1, 8)}
    assert run(spark, [], [(7, p)])[0] == set() and run(spark, [(1, p)], [])[0] == set()
    m = L.verbatim_matches(d, i).filter("doc_id = 1 AND item_id = 7").first()
    assert (m.longest, m.at_word) == (30, 0)


def test_long_text_in_shards(spark, monkeypatch):
    r = random.Random(12)
    p = " ".join(text(r, 40))
    monkeypatch.setattr(L, "SHARD_WORDS", 500)
    docs = [(i, " ".join([*text(r, 300, "q"), *(p.split() if i % 3 == 0 else [])])) for i in range(12)] + [(99, " ".join([*text(r, 100_000, "q"), p]))]
    assert run(spark, docs, [(1, p)])[0] == {(i, 1) for i in (0, 3, 6, 9, 99)}


def test_suffix_array_finds_all_longest_matches():
    r = np.random.default_rng(13)
    tests = L.Tests([[f"a{x}" for x in r.integers(0, 6, 60)]])
    codes = np.concatenate([np.zeros(40, int), r.integers(0, 7, 400), np.zeros(40, int)]).astype(np.int32)
    p, t, n = L.SuffixArray(codes).matches(tests)
    want = set()
    for i in range(len(codes)):
        for j in range(len(tests.codes)):
            k = 0
            while i + k < len(codes) and j + k < len(tests.codes) and codes[i + k] == tests.codes[j + k] > 0:
                k += 1
            if k >= L.SEED and not (codes[i - 1] == tests.codes[j - 1] > 0):
                want.add((i, j, k))
    assert set(zip(p.tolist(), t.tolist(), n.tolist())) == want
