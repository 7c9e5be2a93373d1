import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from loomgraph.llm import neardup

SCHEMA = "id string, content string, class string, keys int, print string, text string"


def found(spark, texts, words=3, least=0.7, least_words=4):
    df = spark.createDataFrame([(i, t, "c", 1, "p", "t") for i, t in texts], SCHEMA)
    return {tuple(r) for r in neardup.NearDuplicates(df, "id", "content", words, least, least_words).id_pairs().collect()}


def similarity(a, b, words):
    x, y = ({tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))} for t in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_against_brute_force(spark):
    r = random.Random(4)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randint(30, 90))] for _ in range(40)]
    texts = []
    for i, b in enumerate(base):
        for j in range(3):
            t = list(b)
            for _ in range(j * r.randint(0, 4)):
                k = r.randrange(len(t))
                t[k : k + r.choice([0, 1])] = [f"x{r.randrange(99)}"]
            texts.append((f"{i:02}-{j}", " ".join(t)))
    want = {(a, b) for a, x in texts for b, y in texts if a < b and similarity(x, y, 3) >= 0.7}
    got = found(spark, texts)
    assert got <= want and len(got) >= 0.97 * len(want) > 40


def test_case_and_punctuation_dont_count_and_short_ones_are_left_out(spark):
    texts = [("a", "One two, three four five!"), ("b", "one TWO three. Four (five)"), ("c", "one two three"), ("d", None), ("e", ""), ("f", "one two three")]
    assert found(spark, texts) == {("a", "b")}


def test_repeated_rows_and_empty_table(spark):
    assert found(spark, [("a", "one two three four five")] * 3) == set()
    assert found(spark, []) == set()


def test_large_class_of_copies_keeps_every_link(spark):
    texts = [(f"{i:03}", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu") for i in range(30)] + [("zzz", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu xi")]
    got = found(spark, texts)
    assert got == {("000", f"{i:03}") for i in range(1, 30)} | {("000", "zzz")}


def test_every_class_in_full_on_demand(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu "
    texts = [(f"{i:03}", text + "nu") for i in range(30)] + [("yyy", text + "xi"), ("zzz", text + "xi")]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in texts], "id string, content string, class string, text string, n int")
    near = neardup.NearDuplicates(df, "id", "content", words=3, least=0.7)
    every = {tuple(sorted((a, b))) for a, _ in texts for b, _ in texts if a != b}
    assert {tuple(r) for r in near.id_pairs(expanded=None).collect()} == every
    assert {tuple(r) for r in near.id_pairs().collect()} == {("000", f"{i:03}") for i in range(1, 30)} | {("000", "yyy"), ("000", "zzz"), ("yyy", "zzz")}


def test_very_long_text(spark):
    long = " ".join(f"w{i % 9001}" for i in range(60_000))
    assert found(spark, [("a", long), ("b", long + " more"), ("c", "other words entirely here")]) == {("a", "b")}


@pytest.mark.parametrize("n,groups", [(1, 1), (9, 2), (300, 5), (700, 1)])
def test_index_equals_brute_force(n, groups):
    r = np.random.default_rng(n)
    prints = r.integers(0, 2**63, (n, 2), dtype=np.uint64)
    prints[n // 2 :] = prints[: n - n // 2] ^ (np.uint64(1) << r.integers(0, 63, (n - n // 2, 2), dtype=np.uint64))
    group = r.integers(0, groups, n)
    asks, answers = r.random(n) < 0.8, r.random(n) < 0.8
    q, a = neardup.hamming_join(group, prints, asks, answers, 33)
    far = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero((far <= 33) & (group[:, None] == group[None, :]))) if i != j and asks[i] and answers[j]}
    assert {(int(i), int(j)) for i, j in zip(q, a)} == {(int(i), int(j)) for i, j in want} and len(q) == len(want)


def test_gray_rank_is_the_inverse_of_the_gray_code():
    ranks = np.arange(300, dtype=np.uint64) + (np.uint64(1) << np.uint64(63))
    hi, lo = neardup.gray_rank(np.full(300, 3, np.uint64) ^ (np.full(300, 3, np.uint64) >> np.uint64(1)), ranks ^ (ranks >> np.uint64(1)) ^ (np.uint64(1) << np.uint64(63)))
    assert (hi == 3).all() and (lo == ranks).all()


def peak_mb(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def apart(prints, radius):
    """Pairs of positions within the radius, by brute force, row by row."""
    return {(i, int(j)) for i, p in enumerate(prints) for j in np.flatnonzero(np.bitwise_count(prints ^ p).sum(axis=1) <= radius) if i != j}


@pytest.mark.parametrize("near", [0, 40])
def test_memory_of_a_join_does_not_grow_with_the_square_of_a_group(near):
    """4,000 texts that share a key: unrelated but for each second one (no node prunes), or in clusters of 40 (nodes do)."""
    r = np.random.default_rng(1)
    base = r.integers(0, 2**64, (4_000 // (near or 2), 2), dtype=np.uint64)
    prints = np.repeat(base, near or 2, axis=0) ^ (np.uint64(1) << r.integers(0, 64, (4_000, 2), dtype=np.uint64))
    all_ = np.ones(4_000, bool)
    (q, a), mb = peak_mb(lambda: neardup.hamming_join(np.zeros(4_000, int), prints, all_, all_, 36))
    assert set(zip(q.tolist(), a.tolist())) == apart(prints, 36) and len(q) >= 4_000
    assert mb < 120


def test_memory_of_signing_does_not_grow_with_the_length_of_texts():
    texts = pd.DataFrame({"id": [f"{i}" for i in range(40)], "class": [b"c"] * 40, "text": [" ".join(f"w{i}x{j}" for j in range(4_000)) for i in range(40)]})
    out, mb = peak_mb(lambda: pd.concat(neardup._signer(3, 20, 3)([texts])))
    keys, prints = neardup.signatures([neardup.shingle_hashes(texts["text"][7], 3)], 20, 3)
    assert out["keys"].iloc[7] == keys[0].tolist() and out["print"].iloc[7] == prints[0].tobytes() and len(out) == 40
    assert mb < 120


@pytest.mark.parametrize("split", [False, True])
def test_rows_of_a_key_that_come_in_many_batches_meet_once(split, monkeypatch):
    monkeypatch.setattr(neardup, "ROWS", 300)
    monkeypatch.setattr(neardup, "PAIRS", 50)
    held = []
    pairs = neardup.hamming_pairs
    monkeypatch.setattr(neardup, "hamming_pairs", lambda group, *x: held.append(len(group)) or pairs(group, *x))
    r = np.random.default_rng(2)
    base = r.integers(0, 2**64, (1_000, 2), dtype=np.uint64)
    prints = np.concatenate([base, base ^ np.uint64(5)])
    rows = pd.DataFrame({"_h": 7, "_shard": 0, "asks": True, "answers": True, "c": np.arange(2_000), "print": [x.astype(">u8").tobytes() for x in prints]})
    small = rows.iloc[[0, 1_000]].assign(_h=9)
    if split:  # 200 ask, all answer
        rows = pd.concat([rows.iloc[:200].assign(answers=False), rows.assign(asks=False)])
    rows = pd.concat([rows, small], ignore_index=True)
    got = [tuple(x) for out in neardup._joiner(iter([rows.iloc[i : i + 100] for i in range(0, len(rows), 100)])) for x in out.to_numpy().tolist()]
    assert set(got) == {(i, i + 1_000) for i in range(200 if split else 1_000)}
    assert not split or max(held) < 700


def test_shuffled_files_go_while_the_query_runs(spark):
    """What was shuffled up to the counts of the keys is deleted before the pairs' texts are compared."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    texts = [(f"{i}", " ".join(f"w{i // 2}x{j}" for j in range(30 + i % 2))) for i in range(200)]
    df = spark.createDataFrame(texts, "id string, content string")
    first = spark.sparkContext._jsc.sc().newShuffleId()
    near = neardup.NearDuplicates(df, "id", "content", words=3, least=0.7)
    for _ in range(50):  # the cleaner works beside
        left = [i for i in range(first, first + 6) if tracker.containsShuffle(i)]
        if not left:
            break
        time.sleep(0.1)
    assert not left and near.pairs.count() == 100
