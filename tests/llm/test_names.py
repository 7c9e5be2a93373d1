import itertools
import random

from loomgraph.llm import names

SCHEMA = "id string, name string, entity_type string, metadata string, key string, n int"


def groups(spark, rows):
    df = spark.createDataFrame([(str(i), n, t, "{", "k", 1) for i, (n, t) in enumerate(rows)], SCHEMA)
    out = {}
    for r in names.same_entities(df).collect():
        out.setdefault((r.kind, r.group), set()).add(int(r.id))
    return sorted(map(sorted, out.values()))


def test_trie_equals_brute_force():
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(150)}
    t = names.Trie()
    for w in words:
        t.add(w, w)

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    for w in list(words)[:40]:
        assert set(t.within(w, 2)) == {x for x in words if levenshtein(w, x) <= 2}


def test_keys_bring_all_neighbours_together():
    r = random.Random(2)
    for _ in range(400):
        a = "".join(r.choice("abcd") for _ in range(r.randint(4, 12)))
        b = list(a)
        for _ in range(2):
            i, what = r.randrange(len(b)), r.randrange(3)
            if what == 0:
                b[i] = r.choice("abcd")
            elif what == 1:
                b.insert(i, r.choice("abcd"))
            elif len(b) > 4:
                del b[i]
        b = "".join(b)
        assert set(names.probe_keys(a)) & set(names.index_keys(b)), (a, b)


def test_keys_in_use_bring_all_allowed_neighbours_together():
    r = random.Random(4)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(4, 11))) for _ in range(1500)})
    met = 0
    for w in words[::10]:
        for x in words:
            if names.edits(w, x) <= min(names._bound(w), names._bound(x)):
                met += 1
                assert set(names.probed(w)) & set(names.indexed(x)), (w, x)
    assert met > 500


def test_edits_count_a_swap_once():
    assert names.edits("kahterine", "katherine") == 1 and names.edits("abc", "abc") == 0 and names.edits("", "ab") == 2


def test_two_edits_with_swaps_are_candidates():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(4, 9))) for _ in range(1200)})
    trie = names.Trie()
    for w in words:
        trie.add(w, w)
    for w in words[::12]:
        near = {x for x in words if names.edits(w, x) <= 2}
        assert set(trie.within_swaps(w, 2)) == near
        assert all(set(names.probe_keys(w)) & set(names.index_keys(x)) for x in near)
    a, b = "pruldungirje", "pruldingrije"
    assert names.edits(a, b) == 2 and set(names.probe_keys(a)) & set(names.index_keys(b))


def test_parts_two_swaps_apart_are_one_name(spark):
    assert groups(spark, [("Pruldungirje", "LOC"), ("Pruldingrije", "LOC"), ("Abcdefghijkl", "LOC"), ("Abcedfghjikl", "LOC")]) == [[0, 1], [2, 3]]


def test_variants_are_one_and_others_are_not(spark):
    people = ["Katherine Benulave", "Benulave, Katherine", "Kahterine Benulave", "K. Benulave", "Dr. Katherine B. Benulavé", "KATHERINE BENULAVE", "Kate Benulave", "Katherine Benu1ave"]
    rows = [(n, t) for n, t in zip(people, itertools.cycle(["PER", "B-PER", "person", "I-per"]))] + [("Ursula Benulave", "PER"), ("Katherine Benulave", "ORG")]
    assert groups(spark, rows) == [list(range(8)), [8], [9]]
    orgs = ["Wuklordoldol Insurance and Trust Corporation", "Wuklordoldol ITC", "The Wuklordoldol Insurance & Trust Corp.", "Insurance and Trust Corporation of Wuklordoldol", "Wuklordoldol Savings Bank", "Wuklordoldol Svgs Bank"]
    assert groups(spark, [(n, "ORG") for n in orgs]) == [[0, 1, 2, 3], [4, 5]]
    places = ["Upper Husiklandol", "Upr Husiklandol", "Lower Husiklandol", "Husiklandol", "Husiklandol, Upper"]
    assert groups(spark, [(n, "LOC") for n in places]) == [[0, 1, 4], [2], [3]]


def test_a_short_form_that_fits_several_stays_alone(spark):
    rows = [("Maria Skorregindi", "PER"), ("Matthew Skorregindi", "PER"), ("M. Skorregindi", "PER"), ("E. Skorregindi", "PER"), ("Edward Skorregindi", "PER")]
    assert groups(spark, rows) == [[0], [1], [2], [3, 4]]


def test_a_chain_of_spellings_is_one_name(spark):
    names_ = ["Hiwinbunfur", "Huwinbumfur", "Huwinbunfur", "Hwinbunfur"]
    assert groups(spark, [(n, "LOC") for n in names_]) == [[0, 1, 2, 3]]
    chain = ["".join("b" if j < i else "a" for j in range(7)) for i in range(7)]
    assert groups(spark, [(c, "LOC") for c in chain]) == [list(range(7))]


def test_nulls_blanks_repeats_and_nothing(spark):
    assert groups(spark, [(None, "PER"), ("", "PER"), ("...", None), ("A B", None), ("A B", None), ("x" * 3000, "LOC")]) == [[3, 4], [5]]
    assert groups(spark, []) == []


def test_large_group_of_copies_is_a_star(spark):
    df = spark.createDataFrame([(f"{i:03}", "Nora Lanarare", "PER", None, "k", 1) for i in range(80)], SCHEMA)
    p = {tuple(r) for r in names.same_pairs(names.same_entities(df)).collect()}
    assert p == {("000", f"{i:03}") for i in range(1, 80)}
    few = names.same_pairs(names.same_entities(df.limit(5)))
    assert few.count() == 10


def test_only_exact_copies_of_a_large_group_are_a_star(spark, monkeypatch):
    def pairs(rows):
        df = spark.createDataFrame([(f"{i:03}", n, t, None, "k", 1) for i, (n, t) in enumerate(rows)], SCHEMA)
        return [tuple(r) for r in names.same_pairs(names.same_entities(df)).collect()]

    # the same name with one to seventy dots: all of them differ in spelling only
    dots = [("Nora Lanarare" + "." * i, "PER") for i in range(1, 71)]
    every = {(f"{i:03}", f"{j:03}") for i, j in itertools.combinations(range(70), 2)}
    monkeypatch.setattr(names, "PAIRED", 16)
    got = pairs(dots)
    assert len(got) == len(every) and set(got) == every
    # two kinds of 40 copies are all given; of 70 copies, the first has all pairs with other spellings
    assert len(pairs([("Nora Lanarare", "PER")] * 40 + [("Lanarare, Nora", "PER")] * 40)) == 80 * 79 // 2
    got = set(pairs([("Nora Lanarare", "PER")] * 70 + [("Lanarare, Nora", None if i else "PER") for i in range(2)] + [("Nora Lanarare", "person")]))
    assert got == {("000", f"{i:03}") for i in [*range(1, 71), 72]} | {("070", "072")}


def test_further_initials_tell_apart(spark):
    rows = [("John R. Smithson", "PER"), ("John K. Smithson", "PER"), ("J. R. Smithson", "PER"), ("J. K. Smithson", "PER"), ("John Smithson", "PER"), ("Smithson, J. R.", "PER"), ("J. Smithson", "PER")]
    assert groups(spark, rows) == [[0, 2, 5], [1, 3], [4], [6]]
    assert groups(spark, [("J. R. Smithson", "PER"), ("J. K. Smithson", "PER"), ("A. B.", "PER"), ("A. C.", "PER")]) == [[0], [1], [2], [3]]
    assert groups(spark, [("John Smithson", "PER"), ("John R. Smithson", "PER"), ("J. R. Smithson", "PER")]) == [[0, 1, 2]]


def test_john_and_johannes_differ(spark):
    assert groups(spark, [("John Smithson", "PER"), ("Johannes Smithson", "PER")]) == [[0], [1]]


def test_small_words_with_slips():
    assert all(map(names.is_small, ["the", "teh", "thee", "andd", "fo", "adn", "off"]))
    assert not any(map(names.is_small, ["fort", "hand", "form", "tree", "e", "o"]))


def test_all_pairs_of_copies_on_demand(spark):
    df = spark.createDataFrame([(f"{i:03}", "Nora Lanarare", "PER", None, "k", 1) for i in range(70)] + [("900", "Lanarare, Nora", "PER", None, "k", 1)], SCHEMA)
    got = [tuple(r) for r in names.same_pairs(names.same_entities(df), expanded=None).collect()]
    ids = [f"{i:03}" for i in range(70)] + ["900"]
    assert len(got) == len(set(got)) and set(got) == set(itertools.combinations(ids, 2))


def _spellings(entities, rows, seed):
    """``rows`` spellings of each of ``entities``: a third with a slip in one part, some in another order or with an initial."""
    r = random.Random(seed)
    out = []
    for e, (given, family) in enumerate(entities):
        for _ in range(rows):
            g, f = given, family
            if r.random() < 0.33:
                w = list(f)
                i, what = r.randrange(1, len(w) - 1), r.randrange(4)
                if what == 0:
                    w[i] = r.choice("aeiounrst")
                elif what == 1:
                    w.insert(i, r.choice("aeiounrst"))
                elif what == 2:
                    del w[i]
                else:
                    w[i], w[i + 1] = w[i + 1], w[i]
                f = "".join(w)
            out.append((e, r.choice([f"{g} {f}", f"{g} {f}", f"{f}, {g}", f"Dr. {g} {f}", f"{g.upper()} {f.upper()}", f"{g} {f}."])))
    return out


def test_recall_does_not_depend_on_size(spark):
    """Pairs found of those true, and true of those found, for 12 and for 240 spellings of each of 40 persons."""
    r = random.Random(5)
    syllables = "bra dul fen gor hul jo klar lis mon nur pel ris skar tov vun wel".split()
    people = [(g, "".join(r.sample(syllables, 4)).capitalize()) for g in ("Edith", "Oliver", "Agnes", "Hugo") for _ in range(10)]
    for rows in (12, 240):
        data = _spellings(people, rows, rows)
        df = spark.createDataFrame([(str(i), n, "PER", None, "k", 1) for i, (_, n) in enumerate(data)], SCHEMA)
        size, inside = {}, {}
        for x in names.same_entities(df).select("id", "group").collect():
            e = data[int(x.id)][0]
            size[x.group] = size.get(x.group, 0) + 1
            inside[x.group, e] = inside.get((x.group, e), 0) + 1
        true = len(people) * rows * (rows - 1) // 2
        both = sum(n * (n - 1) // 2 for n in inside.values())
        found = sum(n * (n - 1) // 2 for n in size.values())
        print(rows, both / true, both / found)
        assert both >= 0.95 * true and both >= 0.99 * found, (rows, both / true, both / found)
