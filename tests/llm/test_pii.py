import pytest

from loomgraph.llm import pii

CASES = [
    ("write to Walter Birskeova, Lindengasse 151b, 94363 Morbrarness, or call +49 30 23125 350.", {("NAME", "Walter Birskeova"), ("ADDRESS", "Lindengasse 151b, 94363 Morbrarness"), ("PHONE", "+49 30 23125 350")}),
    ("I am Matt Ranerard, Passport: Z00897750, and my mail is ranerard.m AT harbour-office DOT example. ~~~~", {("NAME", "Matt Ranerard"), ("ID_NUMBER", "Z00897750"), ("EMAIL", "ranerard.m AT harbour-office DOT example")}),
    ("* [mailto:info-ginnuer(at)letters.invalid Write to the society]", {("EMAIL", "info-ginnuer(at)letters.invalid")}),
    ("--Pihaova, Zoë", {("NAME", "Pihaova, Zoë")}),
    ("| L. Thurdasen || +44 7700 900995", {("NAME", "L. Thurdasen"), ("PHONE", "+44 7700 900995")}),
    ("paolo rolwasen lives at 57 Quarry Avenue, Klestemere and owes me money, ssn 905-40-5509", {("NAME", "paolo rolwasen"), ("ADDRESS", "57 Quarry Avenue, Klestemere"), ("ID_NUMBER", "905-40-5509")}),
    ("Dr. Lucas Grurbesen-Manthenell (NI number QQ 08 96 65 A), P.O. Box 678, Grennersund, (020) 7946 0772", {("NAME", "Lucas Grurbesen-Manthenell"), ("ID_NUMBER", "QQ 08 96 65 A"), ("ADDRESS", "P.O. Box 678, Grennersund"), ("PHONE", "(020) 7946 0772")}),
    ("The William Panfaey Prize and the Walter Kentelmann Bridge; the MV ''Charles Jantelova'' sailed.", set()),
    ("<ref>Traloell 1482, p. 62.</ref> ISBN 978-0-071-00773-6, HD 735402, users @ the fair, 17,495 hectares, 1998-2004", set()),
    ("The Brepier Institute stands where Orchard Street meets the district.", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert {(k, text[a:z]) for a, z, k in pii.find(text)} == want


CUES = """passport passeport reisepass Reisepass ssn,social security,ni number,national insurance,numéro de sécu,numero de secu,numéro de sécurité sociale
license licence permis ausweis,identity card,id card,personnummer,personal no,personal number,id,dni,tax id""".replace("\n", ",")


@pytest.mark.parametrize("cue", [c for x in CUES.split(",") for c in (x.split() if x.startswith(("passport", "license")) else [x])])
def test_every_cue_of_a_number_passes_the_quick_test(cue):
    for sep in (" ", ": ", " no. ", ".", "-", "#"):
        line = f"{cue}{sep}Z12345678"
        if pii.CUED_ID.search(line):
            assert ("ID_NUMBER", "Z12345678") in {(k, line[a:z]) for a, z, k in pii.find(line)}, line


def test_every_street_and_call_passes_the_quick_test():
    kinds = "Street St Road Rd Avenue Ave Lane Ln Drive Close Court Terrace Way Place Row Crescent Gardens Hill".split()
    lines = [f"57 Mill {k}, Town" for k in kinds] + [f"Linden{k} 15" for k in "straße strasse str. gasse weg platz allee ufer damm".split()]
    lines += [f"12 {k} Victor" for k in "rue avenue boulevard place chemin impasse allée quai".split()] + [f"{k} Mayor 5" for k in "Calle Avenida Plaza Paseo Camino".split()]
    lines += ["P.O. Box 678", "Post Office Box 678", "Postfach 12", "Boîte postale 12", "Apartado 12"]
    for line in lines:
        assert pii.ADDRESS.search(line) and "ADDRESS" in {k for _, _, k in pii.find(line)}, line
    for cue in "tel,phone,call,fax,mobile,telephone,téléphoner au,teléfono,telefon,handy".split(","):
        assert pii.CUED_PHONE.search(f"{cue} 555-1234567") and pii._CALL_SIGN.search(f"{cue} 555-1234567"), cue


# Held-out forms: written once the rules stood, with the names that a reader would mark, and not used to change them since.
HELD_OUT = [
    ("Wanda Kowalczyk met Ngozi Okafor and Priya Natarajan in Rome.", ["Wanda Kowalczyk", "Ngozi Okafor", "Priya Natarajan"]),
    ("The lighthouse was drawn by Tomasz Wolniewicz (born 3 May 1901), who also drew the pier.", ["Tomasz Wolniewicz"]),
    ("For the keys ask Mrs Odile Ferrand, flat four.", ["Odile Ferrand"]),
    ("After the war Dr. Imre Halasz moved to Porto.", ["Imre Halasz"]),
    ("| director = Saoirse Kinsella", ["Saoirse Kinsella"]),
    ("Bergström, Elsa: Letters from the north, 1922.", ["Bergström, Elsa"]),
    ("It was signed by Q. Rasmussen and two clerks.", ["Q. Rasmussen"]),
    ("Reach Benedikt Aumann on +49 30 1234567 after six.", ["Benedikt Aumann"]),
    ("Haruka Shimizu studied physics in Kyoto.", ["Haruka Shimizu"]),
    ("Her sister, Lucinda Thorne, kept the shop.", ["Lucinda Thorne"]),
    ("The mayor, Pietro Galvani, opened the fair.", ["Pietro Galvani"]),
    ("DANIEL OKONKWO wrote the minutes.", ["DANIEL OKONKWO"]),
    ("peter hallworth lives near the mill.", ["peter hallworth"]),
    ("-- Ottilie Brandauer", ["Ottilie Brandauer"]),
    ("Contact: Fatoumata Diallo, 12 Harbour Road, Kleston.", ["Fatoumata Diallo"]),
    ("Maria Clara Sousa married Rui Tavares in 1931.", ["Maria Clara Sousa", "Rui Tavares"]),
    ("Professor Chukwudi Eze resigned in May.", ["Chukwudi Eze"]),
    ("A street was named after Michael Donnelly.", ["Michael Donnelly"]),
    ("Photographs by J. T. Marlowe hang in the hall.", ["J. T. Marlowe"]),
    ("Herr Leopold Zwick, Postfach 1234, sells maps.", ["Leopold Zwick"]),
    ("The goalkeeper Stefan Ilić saved twice.", ["Stefan Ilić"]),
    ("Nkechi Obi said that the road was closed.", ["Nkechi Obi"]),
    ("Her cousin Robert Blaine died young.", ["Robert Blaine"]),
    ("Its composer was Aino Lehtinen.", ["Aino Lehtinen"]),
    ("The painter Zofia Maj is buried there.", ["Zofia Maj"]),
    ("Ask Gwendolyn Pryce (g.pryce@example.org) for a copy.", ["Gwendolyn Pryce"]),
    # names of things and places, and pairs of capitals that are nobody
    ("Victoria Falls lies on the Zambezi.", []), ("Santa Barbara County has two harbours.", []), ("The Thomas Edison Bridge was closed.", []),
    ("New York, 555-1234 on the old sign.", []), ("Savings Bank, +44 20 7946 0958, opens at nine.", []), ("The ship MV Edith Larsen sank.", []),
    ("Mill Road met the High Street here.", []), ("Deutsche Bahn said that trains run.", []), ("The Royal Society (founded 1660) met on Tuesdays.", []),
    ("In Saint John Harbour the ice broke.", []), ("Old Town Hall, 4 Market Street, Kleston.", []), ("The Nobel Prize went to nobody.", []),
    ("Lake Victoria and Mount Alice are far apart.", []), ("See Category Towns and File Map.", []),
]


def test_held_out_forms():
    """Recall and precision of whole names off the forms of the test tables; measured 24 of 29, and 24 of 26."""
    hit = marked = given = 0
    for text, want in HELD_OUT:
        got = {text[a:z] for a, z, k in pii.find(text) if k == "NAME"}
        hit, marked, given = hit + len(got & set(want)), marked + len(want), given + len(got)
    assert hit / marked >= 0.8 and hit / given >= 0.9


def test_nothing_in_nothing():
    assert pii.find(None) == [] and pii.find("") == [] and pii.replaced(None, str) is None


def test_placeholders_keep_the_rest():
    t = CASES[0][0]
    assert pii.replaced(t, lambda k, v: f"[{k}]") == "write to [NAME], [ADDRESS], or call [PHONE]."


def test_surrogates_are_typed_distinct_and_consistent():
    s = pii.Surrogates(b"key")
    a, b, c = s("NAME", "Katherine Benulave"), s("NAME", "Benulave, Katherine"), s("NAME", "K. Benulave")
    assert a != "Katherine Benulave" and b == f"{a.split()[1]}, {a.split()[0]}" and c.split()[1] == a.split()[1]
    assert a.split()[0].casefold() in pii.FEMALE and s("NAME", "Walter Foo").split()[0].casefold() in pii.MALE
    assert s("NAME", "KATHERINE BENULAVE") == a.upper()
    phones = [f"+44 7700 9{i:05}" for i in range(2000)]
    new = [s("PHONE", p) for p in phones]
    assert len(set(new)) == 2000 and all(n.startswith("+44 ") and n != p and len(n) == len(p) for n, p in zip(new, phones))
    names = [f"Nora {x}{y}{z}ova" for x in "BDG" for y in "aei" for z in "lmn"]
    assert len({s("NAME", n) for n in names}) == len(names)
    assert s("EMAIL", "nora.bal@mail.example").endswith(".example") and s("EMAIL", "nora.bal@mail.example") != "nora.bal@mail.example"
    assert pii.Surrogates(b"other")("PHONE", phones[0]) != new[0] or pii.Surrogates(b"other")("NAME", "Nora Balova") != s("NAME", "Nora Balova")
    assert pii.Surrogates(b"key")("ID_NUMBER", "QQ 08 96 65 A") == s("ID_NUMBER", "QQ 08 96 65 A") != "QQ 08 96 65 A"


def test_surrogates_of_different_values_differ():
    for key in (b"a", b"b", b"c"):
        s = pii.Surrogates(key)
        # words that letter by letter would become a name of the list, or a word that addresses keep
        back = {v: k for k, v in s.letters.items()}
        listed = sorted(n for n in pii.FEMALE + pii.MALE if n.isascii())
        words = sorted({"".join(back.get(c, c) for c in n) for n in [*listed, "hill", "close", "place"]} | set(listed))
        assert len({s("NAME", f"Nora {w.capitalize()}") for w in words}) == len(words)
        streets = sorted({w.capitalize() for w in words} | {"Hill", "Close", "Place"})
        assert len({s("ADDRESS", f"5 {w} Road") for w in streets}) == len(streets)
        phones = [f"{x:03}-{y:04}" for x in range(0, 1000, 5) for y in range(0, 10000, 97)]
        assert len({s("PHONE", p) for p in phones}) == len(phones)
        assert all((s("PHONE", p)[0] == "0") == (p[0] == "0") for p in phones[::50])


def test_no_given_name_shares_its_surrogate_with_any_word():
    """All given names, and all words that the letters of any of them lead to or come from."""
    s = pii.Surrogates(b"key")
    back = {v: k for k, v in s.letters.items()}
    plain = [n for n in pii.FEMALE + pii.MALE]
    step = lambda w, to: "".join(to.get(c, c) for c in w)
    words = set(plain) | {step(n, s.letters) for n in plain} | {step(n, back) for n in plain} | {step(step(n, back), back) for n in plain}
    images = {w: s.word(w) for w in words}
    assert len(set(images.values())) == len(words) and all(w != i for w, i in images.items())
    assert {images[w] for w in plain} == set(plain)


@pytest.mark.parametrize("name", ["Иван Петров", "Ли Ван", "王小明", "محمد علي", "Γιώργος Σεφέρης", "김철수", "Yy Y", "Åse Øyen", "Łuc Żak"])
def test_no_original_survives_in_any_script(name):
    import unicodedata

    for key in (b"a", b"b"):
        new = pii.Surrogates(key)("NAME", name)
        assert not set(name.split()) & set(new.split())
        assert [unicodedata.name(c).split()[0] for c in unicodedata.normalize("NFC", name) if c.isalpha()] == [unicodedata.name(c).split()[0] for c in new if c.isalpha()]
        assert [c.isupper() for c in name if c.isalpha()] == [c.isupper() for c in new if c.isalpha()]


def test_faults_are_found_over_a_table(spark):
    rows = [("NAME", "A B", "X"), ("NAME", "C D", "X"), ("NAME", "C D", "X"), ("PHONE", "1", "1"), ("EMAIL", "a", "b"), ("ID_NUMBER", "c", "b")]
    got = {tuple(r) for r in pii.surrogate_faults(spark.createDataFrame(rows, "pii_type string, value string, surrogate string")).collect()}
    assert got == {("NAME", "X", 2, False), ("PHONE", "1", 1, True)}


def test_tables(spark):
    rows = [(1, CASES[0][0]), (1, CASES[0][0]), (2, None), (3, ""), (4, "plain words " * 50_000), (None, "Nora Balova")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, value string, pii_type string")
    got = {tuple(r) for r in pii.detected(df, b"k").select("doc_id", "pii_type", "value").collect()}
    assert got == {(1, k, v) for k, v in CASES[0][1]} | {(None, "NAME", "Nora Balova")}
    red = pii.redacted(df).collect()
    assert len(red) == 6 and [r.text for r in red if r.doc_id == 2] == [None] and "[NAME]" in [r.text for r in red if r.doc_id == 1][0]
    sur = pii.surrogated(df, b"k").collect()
    assert len(sur) == 6 and all("Birskeova" not in (r.text or "") for r in sur)
    assert pii.detected(df.limit(0), b"k").count() == 0 and pii.redacted(df.limit(0)).count() == 0
