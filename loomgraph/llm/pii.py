"""Personal information in free text: found by rules, replaced by typed placeholders or by keyed surrogates.

Detection is a set of patterns for each type, most specific first, so that no place in a text has two types. A name is
found by what it is (a known given name or an initial beside a family name) or by where it stands: after a title, before
a date of birth, as the value of a role, as a signature, beside a contact that was found, with a verb of which only persons
are subject, or coordinated with a name that was found.

Surrogates are made by keyed permutations: ASCII letters among vowels and among consonants, keeping case and accents;
letters of other scripts within their script and case; digits at each position; given names among those of the same
gender. Words that aren't on the list of given names never become one that is, so that the images of both don't overlap.
Each mapping is one-to-one, so different originals of a type never get the same replacement, no table of assignments has
to be shared between tasks, and an original gets the same replacement wherever it stands: "Smith, Jane" and "JANE SMITH"
stay recognisable as one person. ``surrogate_faults`` checks that over all values of a table. An initial is permuted as a
letter, as it may stand for many names: "J. Smith" keeps the family name of "Jane Smith", but its initial needn't be
that of the new given name. Permutations have no fixed points. Spellings that Unicode holds equal count as one value.
"""

from __future__ import annotations

import hashlib
import hmac
import random
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

# Common given names and short forms, by the gender of most who bear them.
FEMALE = """abigail abby agnes aicha aïcha alice anna anne barbara beth betty carol charlotte clara clare daniela diana dolly doris
dorothy dot dottie edie edith elena elisabeth elizabeth ella ellen emily emma erika eva fatima frances greta hannah heidi helen helena ida
inge ingrid irene isabel jane jennifer jessica joan josephine josie julia karen kate katherine kathy katie laura lena linda lisa liz lizzie
lucy łucja maggie margaret maria marie martha mary meg monica nancy nora olivia pat patricia patty peggy rachel rita ronnie rosa ruth sara
sarah sofia sophie sue susan susannah susie teresa tricia ursula uschi vera veronica vicky victoria yola yolanda zoë zoé renée chloé léa noémie hélène
amélie céline aurélie josée andrée inés belén lucía sofía maría mónica åsa märta ayşe gül fatma leyla yuki mei olga tatiana zofia małgorzata šárka růžena
ioana ilona jana petra eszter aoife siobhán""".split()
MALE = """adam alan alex alexander andrew anton arthur ben benjamin benny bernard bill bob brian carl carlos charles charlie chuck
daniel david dennis dick donald ed eddie edward eric felix frank francis fred freddie frederick fritz george greg gregory hank hans harry
henry hugo iggy ignatius ivan jack jacob jakob james jim jimmy joe johann johannes john jose josé joseph juan jürgen karl kevin lars len
lenny leo leon leonard louis lucas luis luke marco mark martin matt matthew max michael miguel nat nate nathan nathaniel nicolas noël noel
oliver ollie oscar otto pablo paolo paul pedro peter philip pierre quentin rafael ralph ray richard rick rob robert roger ron samuel sasha
simon søren stefan steven ted theo theodore thomas tim tom tony viktor victor walter wally werner will william willy zach zachary zack rené andré françois
jérôme rémi aurélien gaël joël raphaël loïc andrés adrián ramón joaquín martín nicolás jesús ángel björn jörg günther jürg götz håkan åke pål ömer
mohammed ahmed ali omar yusuf hiroshi kenji wei dmitri igor nikolai łukasz paweł stanisław tomáš jiří václav ștefan mihai seán ciarán""".split()
# Given names that are common in further languages.
FEMALE_WIDER = """adaeze agnieszka aisha akiko amara ananya anastasia astrid beatriz bianca brigitte bronwyn camila carmen caterina chiara chioma
deepa dolores ekaterina farah fatou francesca freya gabriela giulia gisela gudrun heike ingeborg irina isabella joanna katarzyna lakshmi layla
magdalena marguerite mariam mathilde meera nadia nasrin natalia natalie nathalie ngozi niamh noor parisa pilar priya sabine sakura shirin sigrid silvia
sunita svetlana sylvie ute valentina wanda xiomara yasmin yoko zainab""".split()
MALE_WIDER = """abdul alejandro alessandro alexei andrei anil arjun bogdan chinedu cormac declan didier diego dieter dragan emeka emre eoin erik fernando gareth
giovanni giuseppe goran guillaume gustaf haruto hassan helmut ibrahim javier joão khalid klaus knut kofi krzysztof kwame laurent leif lorenzo magnus
marek matteo mehmet mikhail mustafa nils olaf owen paulo piotr radu rahul rainer ravi rhys rodrigo sanjay santiago satoshi sergei sven takeshi
thierry tiago tunde uwe vijay vladimir wolfgang yves zoran""".split()
# Words after a name that make it the name of a thing, and before it that of a ship.
THINGS = """prize bridge institute award medal cup trophy hall school college university library museum stadium park street road avenue
lane square tower house foundation fund society memorial hospital airport station theatre theater church chapel scholarship lecture
building centre center trust ship lighthouse canal dam tunnel garden gardens gallery award falls county island islands river valley mountains
beach bay peninsula desert province district township village bank company corporation office department ministry club union association
press railway brewery hotel restaurant orchestra band festival league championship university academy agency council committee party""".split()
# First words of capitalised pairs that aren't given names, in texts that present a person.
NOT_GIVEN = frozenset(
    """New North South East West Old Upper Lower Great San Santa Saint Port Fort Mount Lake Cape The This That These Those United Main Head General Public
National Royal Grand Central Our Your His Her My Its A An In On At By For From To Of And Or But If When While After Before Since Then Later Yesterday
Today Tomorrow However Although Because Both All Some Many Most Each Every King Queen Prince Princess President Pope Emperor Captain Colonel Major
Lieutenant Sergeant Bishop Cardinal Judge Senator Governor Minister Chancellor Lord Lady Baron Count Duke Earl Chief Deputy Vice Please Contact Write
Call See Ask Letter Dear Phone Tel Fax Email Mail Address Street Road No Not Der Die Das Ein Eine Le La Les Un Une El Los Las Una Il""".split()
)
# Verbs of which a person is the subject, and those of which it is also the object.
PERSON_VERBS = "met married wrote said told asked studied taught lives lived died retired resigned emigrated graduated owes argued remembered joked works worked"
MET = "met married told asked thanked interviewed hired succeeded"
# Titles before a name, and roles of which a name is the value.
BEFORE_NAME = "Dr Mr Mrs Ms Miss Mx Prof Professor Herr Hr Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Srta Signor Signora Sir Dame Rev Reverend Pr"
ROLES = "head author director editor contact owner manager secretary chair chairman president spouse parents mayor founder architect coach"
SHIPS = "MV MS SS HMS USS RMS RV SY USNS HMAS HMCS MT MY".split()

_UP = "A-ZÀ-ÖØ-ÞŁŚŻŹĆŃŠŽČĐ"
_LOW = "a-zß-öø-ÿłśżźćńšžčđ"
_CAP = rf"[{_UP}][{_LOW}'’]*[{_LOW}](?:[{_UP}][{_LOW}]+)?"
_FAMILY = rf"{_CAP}(?:-{_CAP})*"
_SHOUT = rf"[{_UP}]{{3,}}(?:-[{_UP}]{{3,}})*"


def _plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))


FEMALE, MALE = (sorted({*names, *map(_plain, names)}) for names in ([*FEMALE, *FEMALE_WIDER], [*MALE, *MALE_WIDER]))
MALE = [n for n in MALE if n not in set(FEMALE)]
_GIVEN_SET = frozenset(FEMALE + MALE)
_GIVEN = "(?:" + "|".join(sorted({n.capitalize() for n in _GIVEN_SET}, key=lambda n: (-len(n), n))) + ")"
_GIVEN_LOW = "(?:" + "|".join(sorted(_GIVEN_SET, key=lambda n: (-len(n), n))) + ")"
_GIVEN_UP = "(?:" + "|".join(sorted({n.upper() for n in _GIVEN_SET}, key=lambda n: (-len(n), n))) + ")"
_S = r"[ \u00a0]{1,3}"
_INITIAL = rf"[{_UP}]\."
_MIDDLE = rf"(?:{_S}{_INITIAL})*"

_DOT = r"(?:\.|\s?[\[({]dot[\])}]\s?|\s(?:DOT|dot)\s)"
_AT = r"(?:[@＠]|\s?[\[({]at[\])}]\s?|\sAT\s|\sat\s(?=[\w-]+\s(?:dot|DOT)\s))"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.+-])[\w](?:[\w.+%-]*\w)?{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w-])")

_CUE = r"(?:passport|passeport|reisepass|ssn|social security|ni number|national insurance|num[ée]ro de s[ée]cu(?:rit[ée] sociale)?|licen[cs]e|permis|ausweis|identity card|id card|personnummer|personal n(?:o|umber)|\bid\b|\bdni\b|tax id)"
_AFTER_CUE = r"[\s.:#-]{0,3}(?:n[o°r]\.?|nr\.?|number)?[\s.:#-]{0,3}"
_B, _D, _P = r"[    ]", r"[\-‐‑–]", r"[    .\-/‐‑–]"
ID_NUMBER = re.compile(
    rf"(?<![\w-])(?:\d{{3}}{_D}\d{{2}}{_D}\d{{4}}|[A-Z]{{2}}{_B}?\d{{2}}{_B}?\d{{2}}{_B}?\d{{2}}{_B}?[A-D]|[12]{_B}\d{{2}}{_B}\d{{2}}{_B}\d{{2}}{_B}\d{{3}}{_B}\d{{3}}{_B}\d{{2}}"
    r"|[A-Z]{5}\d{6}[A-Z0-9]{3}|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2})(?![\w-])"
)
CUED_ID = re.compile(rf"(?i:{_CUE}){_AFTER_CUE}([A-Z0-9](?:[ \u00a0\u202f\u2011\u2013-]?[A-Z0-9]){{5,20}})(?![\w-])")

PHONE = re.compile(
    rf"(?<![\w+/.-])(?:\+\d{{1,3}}(?:{_P}?\(\d{{1,5}}\))?(?:{_P}?\d{{1,5}}){{2,7}}"
    rf"|\(0?\d{{2,5}}\){_P}?\d{{3,4}}{_P}?\d{{3,4}}|0\d{{1,4}}/\d{{3,8}}(?:{_D}\d{{1,5}})?|0\d(?:{_P}\d{{2}}){{4}}|0\d{{3,4}}{_P}\d{{3}}{_P}?\d{{3,4}}|0\d{{2}}{_P}\d{{4}}{_P}\d{{4}})(?![\w/]|-\d|\.\d)"
    rf"|(?<![\w/.-])555{_D}\d{{4}}(?![\w-])"
)
CUED_PHONE = re.compile(r"(?i:\b(?:tel|phone|call|fax|mobile|telephone|téléphoner au|teléfono|telefon|handy))\b[\s.:=]{0,4}((?:\+|\(|0|\d{3}-)[\d().\-/   ‑–]{5,20}\d)(?![\w/]|-\d)")

_PLACE = rf"(?!(?:Tel|Phone|Fax|Mobil|Handy|Email|Mail)\b){_CAP}(?:[ -]{_CAP}){{0,2}}"
_KIND = r"(?:Street|St\.(?=,)|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Close|Court|Terrace|Way|Place|Row|Crescent|Gardens|Hill)"
_FIXED = re.compile(rf"{_KIND}|Flat|Box|Calle|Avenida|Plaza|Postfach|Apt|Unit")
_IN = r"(?:(?:upon|on|le|la|in|am)\s)?"
ADDRESS = re.compile(
    rf"(?:(?:P\.\s?O\.|P\.?O\.?|Post Office)\sBox\s\d+|Postfach\s\d+(?:\s\d+)*|Boîte postale\s\d+|Apartado\s\d+)(?:,\s(?:\d{{4,6}}\s)?{_PLACE})?"
    rf"|(?<![\w-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\w{{1,5}},\s)?\d{{1,5}}[A-Za-z]?\s(?:{_CAP}\s){{1,4}}{_KIND}(?![\w])(?:,\s{_PLACE}(?:\s\d{{4,6}})?)?"
    rf"|(?<!\w)(?:{_CAP}[ -])?[{_UP}][{_LOW}]+(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm)\s\d{{1,4}}\s?[a-z]?(?![\w])(?:,\s\d{{5}}\s{_PLACE})?"
    rf"|(?<![\w-])\d{{1,4}}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai)\s(?:(?:du|de\sla|des|de|d['’])\s?)?(?:l['’])?[\w'’-]+(?:\s{_CAP})*(?:,\s\d{{5}}\s{_PLACE})?"
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino)\s(?:(?:del|de\sla|de\slos|de\slas|de)\s)?{_CAP}(?:\s{_CAP})*\s\d{{1,4}}(?:,\s\d{{5}}\s{_PLACE})?"
)

NAMES = [
    # family name first, given name or initials behind a comma
    re.compile(rf"(?<![\w'’])(?<!\w-){_FAMILY},{_S}(?:{_GIVEN}(?![\w'’-]){_MIDDLE}|{_INITIAL}{_MIDDLE}(?!{_S}{_FAMILY}))(?![\w])"),
    re.compile(rf"(?<![\w'’])(?<!\w-){_GIVEN}(?:-{_GIVEN})?{_MIDDLE}{_S}{_FAMILY}(?![\w])"),
    re.compile(rf"(?<![\w'’.])(?<!\w-){_INITIAL}{_MIDDLE}{_S}{_FAMILY}(?![\w])"),
    re.compile(rf"(?<![\w'’])(?<!\w-){_GIVEN_UP}{_MIDDLE}{_S}{_SHOUT}(?![\w])|(?<![\w'’])(?<!\w-){_SHOUT},{_S}{_GIVEN_UP}(?![\w])"),
    # as people type it, where the text says that it is a person
    re.compile(rf"(?<![\w'’])(?<!\w-)(?:{_GIVEN_LOW}(?:{_S}[a-z]\.?)?{_S}[{_LOW}]{{3,}}(?:-[{_LOW}]{{3,}})*|[{_LOW}]{{3,}}(?:-[{_LOW}]{{3,}})*,{_S}{_GIVEN_LOW})(?={_S}(?:{'|'.join(PERSON_VERBS.split())}|was born)\b)"),
]
# a person in a place where texts present one, also with a given name that isn't known: a sign that must be there, and the pattern
_SHAPE = rf"{_CAP}(?:-{_CAP})?{_MIDDLE}{_S}{_FAMILY}|{_FAMILY},{_S}{_CAP}{_MIDDLE}"
_PERSON = rf"(?<![\w'’])(?<!\w-)({_SHAPE})(?![\w])"
_VERBS = "|".join(PERSON_VERBS.split())
PRESENTED = [
    (re.compile(rf"\b(?:{'|'.join(BEFORE_NAME.split())})\.?{_S}(?=[{_UP}])"), re.compile(rf"\b(?:{'|'.join(BEFORE_NAME.split())})\.?{_S}({_SHAPE})(?![\w])")),
    (re.compile(r"\((?:born|b\.|née?|nacid|geb|died|d\.|\*|†)"), re.compile(rf"{_PERSON}['’]{{0,3}}\s\((?=born|b\.|née?\b|nacid[oa]|geb|died|d\.|\*|†)")),
    (re.compile(r"[=:]"), re.compile(rf"\b(?i:{'|'.join(ROLES.split())})\s?[=:]\s?({_SHAPE})\s*(?=$|[|,;<])")),
    (re.compile(r"--|—"), re.compile(rf"(?:--|—)\s?({_SHAPE})\s*$")),
    (re.compile(rf"\s(?:{_VERBS}|was\sborn)\b"), re.compile(rf"{_PERSON}(?=\s(?:{_VERBS}|was\sborn)\b)")),
    (re.compile(rf"\b(?:{'|'.join(MET.split())})\s"), re.compile(rf"\b(?:{'|'.join(MET.split())})\s({_SHAPE})(?![\w])")),
]
#: Between a name and the contact that belongs to it: punctuation and up to four words in lower case.
_BEFORE_CONTACT = re.compile(rf"{_PERSON}['’]{{0,3}}(?:\s?[,(|:;]{{1,2}})?(?:\s[{_LOW}]{{1,12}}){{0,4}}\s?[,(|:]{{0,2}}\s?$")
_JOINED_AFTER = re.compile(rf"\s(?:and|und|et|y|e|och|&)\s({_SHAPE})(?![\w])")
_JOINED_BEFORE = re.compile(rf"{_PERSON}\s(?:and|und|et|y|e|och|&)\s$")
_IN_PLACE = re.compile(r"(?i:\b(?:in|at|near|from|to|of|à|en|bei|aus|nach))\s$")
_BEFORE_PLACE = re.compile(r"\b(?:San|Santa|Santo|Saint|Sainte|St\.?|Lake|Mount|Mt\.?|Port|Fort|Cape|Isle of)\s$")
_AFTER_THING = re.compile(rf"['’]{{0,5}}(?:{_S}{_CAP})?{_S}(?i:{'|'.join(THINGS)})(?!\w)")
_BEFORE_SHIP = re.compile(rf"(?:\b(?:{'|'.join(SHIPS)})|\b(?i:ship|vessel|ferry|yacht|steamer))[ \u00a0]['\"]{{0,5}}$")
_TITLES = frozenset("Dr Mr Mrs Ms Prof Rev Hon Sir St Herr Frau Monsieur Madame Box See No Vol Category File Image".split())


_AT_SIGN = re.compile(r"[@＠]|[\[({]at[\])}]|\sAT\s|\sat\s[\w-]+\s(?:dot|DOT)\s")
_CUE_SIGN = re.compile(r"(?i)pass|ssn|social|ni num|national i|s[ée]cu|licen|permis|ausweis|identity|card|nummer|personal n|tax|\b(?:id|dni)\b[\s.:#-]")
_CALL_SIGN = re.compile(r"(?i)tel|phone|call|fax|mobil|téléph|handy")
_STREETS = tuple("Box Postfach postale Apartado Street St Road Rd Avenue Ave Lane Ln Drive Close Court Terrace Way Place Row Crescent Gardens Hill straße strasse str. gasse weg platz allee ufer damm rue avenue boulevard place chemin impasse allée quai Calle Avenida Plaza Paseo Camino".split())
_WORDS = re.compile(r"[^\W\d_]+")
_INITIAL_SIGN = re.compile(rf"(?<![\w'’.]){_INITIAL}")


@lru_cache(maxsize=100_000)
def _in_line(line: str) -> tuple[tuple[int, int, str], ...]:
    """What is found in one line. Revisions of a text share most lines, so that results are kept for a while."""
    spans: list[tuple[int, int, str]] = []

    def add(a: int, z: int, kind: str) -> None:
        if not any(a < e and b < z for b, e, _ in spans):
            spans.append((a, z, kind))

    # each pattern is tried only where something that it needs is there
    if _AT_SIGN.search(line):
        for m in EMAIL.finditer(line):
            add(*m.span(), "EMAIL")
    if any(c in line for c in "0123456789"):
        for m in ID_NUMBER.finditer(line):
            add(*m.span(), "ID_NUMBER")
        if _CUE_SIGN.search(line):
            for m in CUED_ID.finditer(line):
                if sum(c.isdigit() for c in m[1]) >= 4:
                    add(*m.span(1), "ID_NUMBER")
        if any(k in line for k in _STREETS):
            for m in ADDRESS.finditer(line):
                add(*m.span(), "ADDRESS")
        for m in PHONE.finditer(line):
            if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                add(*m.span(), "PHONE")
        if _CALL_SIGN.search(line):
            for m in CUED_PHONE.finditer(line):
                if 7 <= sum(c.isdigit() for c in m[1]) <= 15:
                    add(*m.span(1), "PHONE")
    near = [m.span() for m in _WORDS.finditer(line) if m[0].casefold() in _GIVEN_SET]
    near += [m.span() for m in _INITIAL_SIGN.finditer(line)]
    for pattern in NAMES if near else ():
        for a, z in _windows(sorted(near), len(line), 120):
            for m in pattern.finditer(line, a, z):
                if _a_person(line, *m.span()):
                    add(*m.span(), "NAME")
    for sign, pattern in PRESENTED:
        if sign.search(line):
            for m in pattern.finditer(line):
                if _presented(line, *m.span(1)):
                    add(*m.span(1), "NAME")
    for a, _, kind in tuple(spans):
        if kind != "NAME":
            m = _BEFORE_CONTACT.search(line, max(0, a - 90), a)
            if m and _presented(line, *m.span(1)) and not _IN_PLACE.search(line, max(0, m.start(1) - 6), m.start(1)):
                add(*m.span(1), "NAME")
    for a, z, kind in tuple(spans):
        if kind == "NAME":
            for m in (_JOINED_AFTER.match(line, z), _JOINED_BEFORE.search(line, max(0, a - 60), a)):
                if m and _presented(line, *m.span(1)):
                    add(*m.span(1), "NAME")
    return tuple(sorted(spans))


def _windows(at: list[tuple[int, int]], n: int, reach: int) -> list[tuple[int, int]]:
    """Ranges around the given ones, those that meet merged."""
    out: list[tuple[int, int]] = []
    for a, z in at:
        a, z = max(0, a - reach), min(n, z + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(begin, end, type) of what is found, in order and without overlaps; nothing in a null or empty text. Nothing spans lines."""
    out: list[tuple[int, int, str]] = []
    at = 0
    for line in (text or "").split("\n"):
        out += [(at + a, at + z, kind) for a, z, kind in _in_line(line)]
        at += len(line) + 1
    return out


def _a_person(text: str, a: int, z: int) -> bool:
    words = re.findall(r"[^\W\d_]+", text[a:z])
    if any(w in _TITLES for w in words) or any(w.casefold() in THINGS for w in words[1:]):
        return False
    return not _AFTER_THING.match(text, z) and not _BEFORE_SHIP.search(text, max(0, a - 16), a) and not _BEFORE_PLACE.search(text, max(0, a - 9), a)


def _presented(text: str, a: int, z: int) -> bool:
    """Whether a capitalised pair in a place for persons may be one: it isn't a thing, and no word of it can't be part of a name."""
    return _a_person(text, a, z) and not any(w in NOT_GIVEN for w in re.findall(r"[^\W\d_]+", text[a:z]))


def replaced(text: str | None, with_: callable) -> str | None:
    """``text`` with what is found replaced by ``with_(type, value)``."""
    if text is None:
        return None
    out, at = [], 0
    for a, z, kind in find(text):
        out += [text[at:a], with_(kind, text[a:z])]
        at = z
    return "".join([*out, text[at:]])


@lru_cache(maxsize=1)
def _alphabets() -> tuple[dict[str, tuple[str, ...]], dict[tuple[str, ...], list[str]]]:
    """The alphabet of each letter beyond ASCII, and the letters of each: of one script and part of it (128 places, 4,096 of
    the large scripts), in lower case (where the letter has a single one of either case) or of one category. Letters that
    are an ASCII letter with marks belong to none."""
    of: dict[str, tuple[str, ...]] = {}
    letters: dict[tuple[str, ...], list[str]] = {}
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if not c.isalpha() or unicodedata.normalize("NFC", c) != c or unicodedata.normalize("NFD", c)[0].isascii():
            continue
        low, up = c.lower(), c.upper()
        cased = low != up and len(low) == len(up) == 1 and low.upper() == up and up.lower() == low
        if cased and c == up:
            continue
        name = (unicodedata.name(c, "").split() or [f"plane {code >> 12}"])[0]
        part = f"{code >> (12 if name in ('CJK', 'HANGUL') else 7):x}"
        alphabet = (name, part, "cased" if cased else unicodedata.category(c))
        of[c] = alphabet
        letters.setdefault(alphabet, []).append(c)
    return of, letters


class Surrogates:
    """Keyed replacements; the same key gives the same replacements on every executor."""

    VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"

    def __init__(self, key: bytes):
        self.key = key
        self.letters = self._shift(self.VOWELS, "vowels") | self._shift(self.CONSONANTS, "consonants")
        self.given = {**self._shift(FEMALE, "female"), **self._shift(MALE, "male")}
        self._shifted: dict[tuple[str, ...], dict[str, str]] = {}
        self._digits: dict[str, dict[int, int]] = {}

    def _random(self, what: str) -> random.Random:
        return random.Random(hmac.new(self.key, what.encode(), hashlib.sha256).digest())

    def _shift(self, values, what: str) -> dict:
        """A permutation in one cycle, so without fixed points where there are two values or more."""
        order = sorted(values)
        self._random(what).shuffle(order)
        return dict(zip(order, order[1:] + order[:1]))

    def letter(self, c: str) -> str:
        """A letter of the same script and case, with the same marks."""
        low = c.lower()
        if low in self.letters:
            new = self.letters[low]
            return new.upper() if c != low else new
        first, *marks = unicodedata.normalize("NFD", c)
        if first.isascii() and marks:
            return unicodedata.normalize("NFC", self.letter(first) + "".join(marks))
        of, letters = _alphabets()
        at = c if c in of else low if len(low) == 1 and low in of and low.upper() == c else None
        if at is None:
            return c
        alphabet = of[at]
        if alphabet not in self._shifted:
            self._shifted[alphabet] = self._shift(letters[alphabet], " ".join(alphabet))
        new = self._shifted[alphabet][at]
        return new if at == c else new.upper()

    def word(self, w: str, kept: re.Pattern | None = None) -> str:
        """A word letter by letter, so that script, case and accents are kept.

        Words of the list become words of the list. Others are permuted until they are neither on it nor ``kept`` (words
        that the caller leaves as they are), so that all words together are still permuted one-to-one.
        """
        if w.casefold() in self.given:
            new = self.given[w.casefold()]
            return new.upper() if w.isupper() and len(w) > 1 else new.capitalize() if w[:1].isupper() else new
        while True:
            w = "".join(map(self.letter, w))
            if w.casefold() not in self.given and not (kept and kept.fullmatch(w)):
                return w

    def digits(self, value: str, kind: str) -> str:
        """A number with each digit permuted by its place from the left; signs, prefixes and letters of the format stay.

        A leading 0 of a phone number stays, and another leading digit doesn't become 0. Digits of other scripts stay in theirs.
        """
        order = [i for i, c in enumerate(value) if c.isdecimal()]
        keep = 0
        if kind == "PHONE" and value.startswith("+"):
            keep = len(re.match(r"\+(\d{0,2})", value)[1])
        elif kind == "PHONE" and order and unicodedata.decimal(value[order[0]]) == 0:
            keep = 1
        out = list(value)
        for k, i in enumerate(order):
            if k >= keep:
                what = f"{kind} {len(order)} {k}"
                if what not in self._digits:
                    self._digits[what] = self._shift(range(1 if kind == "PHONE" and k == 0 else 0, 10), what)
                d = unicodedata.decimal(value[i])
                out[i] = chr(ord(value[i]) - d + self._digits[what][d])
        return "".join(out)

    def __call__(self, kind: str, value: str) -> str:
        value = unicodedata.normalize("NFC", value)
        if kind == "NAME":
            new = _LETTERS.sub(lambda m: self.word(m[0]), value)
        elif kind == "EMAIL":
            sep = re.search(_AT, value)
            local = _LETTERS.sub(lambda m: self.word(m[0]), self.digits(value[: sep.start()], kind))
            host = re.split(_DOT, value[sep.end() :])[0]
            new = local + sep[0] + _LETTERS.sub(lambda m: self.word(m[0]), host) + value[sep.end() + len(host) :]
        elif kind == "ADDRESS":
            some = re.sub(rf"(?<!\w){_CAP}(?!\w)", lambda m: m[0] if _FIXED.fullmatch(m[0]) else self.word(m[0], _FIXED), value)
            new = self.digits(some, kind)
        else:
            new = re.sub(r"[A-Z]{3,}", lambda m: self.word(m[0]), self.digits(value, kind))
        return unicodedata.normalize("NFC", new)


_LETTERS = re.compile(r"[^\W\d_]+")


def _detector(key: bytes):
    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lru_cache(maxsize=100_000)(Surrogates(key))
        for pdf in batches:
            rows = [(i, kind, text[a:z], made(kind, text[a:z])) for i, text in zip(pdf["doc_id"], pdf["text"]) for a, z, kind in find(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "pii_type", "value", "surrogate"]).drop_duplicates()

    return detect


def detected(documents: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, pii_type, value, surrogate): each value of each document once, with its replacement under ``key``.

    Null and empty texts give no rows, nor does an empty table; further columns are ignored.
    """
    texts = documents.select("doc_id", "text").filter("length(text) > 0")
    return texts.mapInPandas(_detector(key), "doc_id long, pii_type string, value string, surrogate string").distinct()


def surrogate_faults(detections: DataFrame) -> DataFrame:
    """(pii_type, surrogate, n_values, kept): surrogates that stand for more than one value of a type, or equal their value.

    The check of ``detected`` over a whole table; no rows mean that distinct values stayed distinct and none was kept.
    """
    values = detections.select("pii_type", "value", "surrogate").distinct()
    kept = F.max((F.col("value") == F.col("surrogate")) & F.col("value").rlike(r"[\p{L}\p{N}]"))
    found = values.groupBy("pii_type", "surrogate").agg(F.count("*").alias("n_values"), kept.alias("kept"))
    return found.filter((F.col("n_values") > 1) | F.col("kept"))


def _rewriter(make):
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with_ = make()
        for pdf in batches:
            yield pdf.assign(text=[replaced(t, with_) for t in pdf["text"]])

    return rewrite


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): every document with what is found replaced by ``[TYPE]``. Null texts stay null, rows stay as many."""
    return documents.select("doc_id", "text").mapInPandas(_rewriter(lambda: lambda kind, value: f"[{kind}]"), "doc_id long, text string")


def surrogated(documents: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text): every document with what is found replaced by keyed surrogates of the same type and format."""
    return documents.select("doc_id", "text").mapInPandas(_rewriter(lambda: Surrogates(key)), "doc_id long, text string")
