import random
from datetime import datetime

from loomgraph.llm import splitting as S

SCHEMA = "id long, rid string, content string, created_at timestamp, updated_at timestamp, path string, chunk_index int"


def check(text, most=400, least=150, overlap=40):
    p = S.pieces(text, most, least, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    for (a, z), (b, y) in zip(p, p[1:]):
        assert a < b <= z < y and len(text[b:z].encode()) <= overlap
    assert all(len(text[a:z].encode()) <= most for a, z in p)
    return p


def prose(r, n):
    out = []
    for _ in range(n):
        out.append(" ".join("w" * r.randint(1, 9) for _ in range(r.randint(3, 14))).capitalize() + r.choice([". ", "! ", ".\n\n", "? "]))
    return "".join(out)


def test_pieces_cover_and_end_at_boundaries():
    r = random.Random(8)
    for _ in range(30):
        t = prose(r, 60)
        for a, z in check(t)[:-1]:
            assert t[z - 1].isspace() and t[: z].rstrip()[-1] in ".!?"


def test_texts_without_breaks_and_in_other_scripts():
    check("x" * 5000)
    check("é" * 3000)
    check("😀" * 900)
    check("е́" * 900)
    p = check("漢字が続く文章です。" * 200)
    assert all(("漢字が続く文章です。" * 200)[z - 1] == "。" for _, z in p[:-1])
    check(" " * 3000)
    check("\r\n".join(["word " * 9] * 50))
    assert S.pieces("", 400, 150, 40) == [(0, 0)] and S.pieces("a" * 400, 400, 150, 40) == [(0, 400)]


def test_an_edit_changes_only_near_pieces():
    r = random.Random(9)
    t = prose(r, 3000)
    before = {t[a:z] for a, z in S.pieces(t)}
    u = t[:5000] + "An inserted sentence. " + t[5000:]
    after = {u[a:z] for a, z in S.pieces(u)}
    assert len(after - before) <= 4 < len(after) // 3


def test_newest_row_counts(spark):
    d = datetime
    long, longer = "word " * 1000, "other " * 1500
    rows = [
        (1, "r", longer, d(2024, 1, 1), d(2024, 1, 2)), (1, "r", "short now", d(2024, 1, 1), d(2024, 1, 3)), (2, "r2", "short", d(2024, 1, 1), d(2024, 1, 1)), (2, "r2", long, d(2024, 1, 1), d(2024, 1, 5)),
        (3, None, long, None, None), (4, "r4", None, None, None), (5, "r5", "", None, None), (None, "r6", long, None, None), (6, "r7", "x" * 4000, None, None), (7, "r8", "é" * 2001, None, None), (2, "r2", long, d(2024, 1, 1), d(2024, 1, 5)),
    ]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)
    out = S.split_oversized(df).collect()
    assert {r.id for r in out} == {2, 3, 7}
    two = sorted((r for r in out if r.id == 2), key=lambda r: r.chunk_index)
    assert two[0].path == "doc_r2.chunk0" and "".join(long[r.start_pos : r.end_pos] == r.content and "y" or "n" for r in two).count("n") == 0
    assert S.split_oversized(df.limit(0)).count() == 0
