"""Variant spellings of names: a trie join of name parts within a bounded edit distance, then parts in any order.

1. A name is folded (case, accents, look-alike characters) and taken apart; titles and small words are dropped and
   common abbreviations written out. What is left are its parts, and its initials.
2. The distinct parts of each kind of entity are sharded by pieces that survive the edits that are allowed (a part cut in
   two keeps one of its pieces whole after one edit, cut in three after two, but for a swap across a cut), each shard is
   a trie, and a Levenshtein automaton that counts a swap once walks it to list all neighbours within the bound. A part
   that is rare beside a neighbour takes the spelling of its most frequent one.
3. Names whose parts are then the same in any order are one name, unless their further initials differ. Short forms
   (initials, pet names that stand for several given names, acronyms) join the one full name that they fit; where they
   fit several, they are left apart.

Only distinct parts and names are compared; no pairs of rows are made before the groups are known.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.skew import join_shards
from loomgraph.runtime import cut

#: Edits (insertions, deletions, substitutions, swaps of neighbours) between spellings of a part: one, or two from
#: ``LONG`` characters on. Parts shorter than ``SHORT`` are not respelled.
LONG, SHORT = 8, 4
#: A part is taken for a spelling of its neighbour only if that is ``TIMES`` as frequent, in ids or in different names (copies of a
#: slip raise the one, spellings of one name are soon all there in the other); the first ``RARE`` that have the part aren't
#: counted, as a share of so few says nothing. The rule is one of shares and is the same for tables of any size.
RARE, TIMES = 2, 12
#: Copies are ids of exactly the same name and type. By default, up to so many are in all pairs of their group; of more, their
#: first id is, and it in a pair with each of the others.
EXPANDED = 64
#: In the join that pairs the ids of a group, a key has so many of them on one side.
PAIRED = 1024

# Titles, small words, and what common abbreviations stand for.
TITLES = frozenset("mr mrs ms miss dr prof professor rev reverend hon honourable sir dame lady lord st fr sr jr ii iii phd md esq".split())
SMALL = frozenset("the of and for in at on de la le du des del der die das und et y a an off".split())
WRITTEN_OUT = dict(
    x.split(":")
    for x in """co:company corp:corporation inc:incorporated ltd:limited bros:brothers mfg:manufacturing mfr:manufacturing intl:international
int'l:international natl:national fdn:foundation found:foundation univ:university uni:university mus:museum hist:historical assoc:association assn:association
inst:institute acad:academy dept:department svgs:savings rly:railway ry:railway rlwy:railway mt:mount mtn:mountain pt:port ft:fort lwr:lower upr:upper
is:island isl:island lk:lake gt:great ctr:center cntr:center soc:society sci:sciences res:research ins:insurance tr:trust bk:bank brg:brewing
brew:brewing shpg:shipping pub:public wks:works lib:library govt:government hosp:hospital comm:committee""".split()
)
# Pet forms of given names and the names that they stand for.
PET_FORMS = {
    k: tuple(v.split("/"))
    for k, v in (
        x.split(":")
        for x in """abby:abigail abi:abigail gail:abigail aggie:agnes nessa:agnes alex:alexander/alexandra al:alexander/albert/alan sasha:alexander/alexandra
sandy:alexander/alexandra alec:alexander xander:alexander lex:alexander ben:benjamin benny:benjamin benji:benjamin bennie:benjamin charlie:charles chuck:charles chas:charles
claire:clara clare:clara dot:dorothy dottie:dorothy dolly:dorothy dory:dorothy dora:dorothy/theodora edie:edith ed:edward/edgar/edwin eddie:edward/edgar/edwin
ned:edward ted:edward/theodore teddy:edward/theodore liz:elizabeth lizzie:elizabeth lizzy:elizabeth beth:elizabeth betty:elizabeth betsy:elizabeth eliza:elizabeth libby:elizabeth
elsie:elizabeth frank:francis frankie:francis fran:francis/frances fred:frederick freddie:frederick freddy:frederick fritz:frederick/friedrich greg:gregory gregor:gregory
nell:helena/eleanor lena:helena/magdalena nellie:helena/eleanor helen:helena hank:henry harry:henry/harold hal:henry/harold hughie:hugo hugh:hugo huey:hugo iggy:ignatius nacho:ignatius
inga:ingrid inge:ingrid rena:irene rene:irene reni:irene jim:james jimmy:james jamie:james jem:james hans:johannes jan:johannes johann:johannes hannes:johannes
jo:josephine/joanna josie:josephine josey:josephine fina:josephine kate:katherine kathy:katherine katie:katherine kat:katherine kitty:katherine kit:katherine/christopher kay:katherine len:leonard lenny:leonard
leo:leonard leon:leonard luke:lucas luc:lucas luca:lucas maggie:margaret meg:margaret peggy:margaret greta:margaret madge:margaret margie:margaret rita:margaret daisy:margaret mary:maria marie:maria
mia:maria mimi:maria matt:matthew mat:matthew matty:matthew nat:nathaniel nate:nathaniel nathan:nathaniel nonie:nora norah:nora ollie:oliver noll:oliver olly:oliver paul:paolo paulie:paolo pat:patricia/patrick
patty:patricia tricia:patricia trish:patricia pattie:patricia quin:quentin quinn:quentin quint:quentin dick:richard rick:richard rich:richard richie:richard ricky:richard rob:robert bob:robert bobby:robert
robbie:robert bert:robert/albert sue:susannah susie:susannah suzy:susannah susan:susannah sukie:susannah theo:theodore uschi:ursula ulla:ursula ursel:ursula ronnie:veronica/ronald vera:veronica
vicky:victoria vickie:victoria tori:victoria vic:victor/victoria/viktor vik:viktor victor:viktor wally:walter walt:walter wat:walter bill:william billy:william will:william willie:william liam:william yola:yolanda
yoli:yolanda lanie:yolanda zach:zachary zack:zachary zac:zachary zak:zachary""".split()
    )
}
KNOWN = frozenset(PET_FORMS) | {x for v in PET_FORMS.values() for x in v}
# How kinds of entity are written.
KINDS = {"PER": "PER", "PERSON": "PER", "ORG": "ORG", "LOC": "LOC", "MISC": "MISC"}
_OTHER_LETTERS = str.maketrans("łøđßæœı", "lodsaoi")
_LOOK = str.maketrans("015|", "olsl")


def kind_of(entity_type: str | None) -> str:
    """The kind behind a type as taggers write it: without ``B-`` or ``I-`` and letter case. Null and blank are kind ''."""
    t = re.sub(r"^[BI]-", "", (entity_type or "").strip().upper())
    return KINDS.get(t, t)


@lru_cache(maxsize=10_000)
def is_small(part: str) -> bool:
    """Whether a folded word is a small one, or one with neighbours swapped or a letter doubled."""
    if part in SMALL:
        return True
    swapped = (part[:i] + part[i + 1] + part[i] + part[i + 2 :] for i in range(len(part) - 1))
    single = (part[:i] + part[i + 1 :] for i in range(len(part) - 1) if part[i] == part[i + 1])
    return len(part) <= 4 and any(len(x) > 1 and x in SMALL for x in (*swapped, *single))


def fold(part: str) -> str:
    """Lower case without accents and with look-alikes (``rn`` for m, digits for letters) written one way."""
    t = unicodedata.normalize("NFKD", part.casefold().translate(_OTHER_LETTERS))
    t = "".join(c for c in t if not unicodedata.combining(c))
    if any(c.isalpha() for c in t):
        t = t.translate(_LOOK)
    return t.replace("rn", "m").replace("vv", "w")


def parts_of(name: str | None, kind: str) -> tuple[list[str], list[str]]:
    """The folded parts of a name and its initials, both in the order of the name (a part before a comma goes last)."""
    if not name:
        return [], []
    halves = [h for h in name.split(",") if h.strip()]
    ordered = " ".join([*halves[1:], *halves[:1]])
    parts, initials = [], []
    for raw in re.findall(r"[^\W_]+(?:['’][^\W_]+)*\.?", re.sub(r"[|]", "l", ordered)):
        t = fold(raw.rstrip("."))
        t = t.replace("'", "").replace("’", "")
        if kind == "PER" and t in TITLES:
            continue
        if (t in SMALL and len(t) > 1) if kind == "PER" else is_small(t):
            continue
        if kind != "PER":
            t = fold(WRITTEN_OUT.get(t, t))
        if len(t) == 1 and t.isalpha() and kind == "PER":
            initials.append(t)
        else:
            parts.append(t)
    return parts, initials


def edits(a: str, b: str) -> int:
    """Optimal string alignment distance."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last[j - 2] + 1)
    return row[-1]


class Trie:
    """Parts as a tree of characters, walked with a Levenshtein automaton."""

    def __init__(self):
        self.root: dict = {}

    def add(self, part: str, value: object) -> None:
        node = self.root
        for c in part:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)

    def within(self, part: str, most: int) -> Iterator[object]:
        """The values of all parts at a Levenshtein distance of ``most`` at most.

        A state of the automaton is the row of distances of ``part``'s prefixes to the path so far; a branch whose
        state has no distance within the bound leads nowhere and is left.
        """
        stack = [(self.root, tuple(range(len(part) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= most:
                        yield from child
                    continue
                new = [row[0] + 1]
                for j, x in enumerate(part):
                    new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != c)))
                if min(new) <= most:
                    stack.append((child, tuple(new)))

    def within_swaps(self, part: str, most: int) -> Iterator[object]:
        """The values of all parts within ``most`` ``edits``: as ``within``, but a swap of neighbours counts once.

        A state also holds the row before and the character that led from it; a swap goes on from that row.
        """
        start = tuple(range(len(part) + 1))
        stack = [(self.root, start, None, "")]
        while stack:
            node, row, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[-1] <= most:
                        yield from child
                    continue
                new = [row[0] + 1]
                for j, x in enumerate(part):
                    d = min(new[j] + 1, row[j + 1] + 1, row[j] + (x != c))
                    if before and j and x == last and part[j - 1] == c:
                        d = min(d, before[j - 1] + 1)
                    new.append(d)
                if min(new) <= most or min(row) < most:
                    stack.append((child, tuple(new), row, c))


def _bound(part: str) -> int:
    return 0 if len(part) < SHORT else 1 if len(part) < LONG else 2


def _cuts(n: int) -> list[tuple[int, int]]:
    """Begin and end of the three pieces of a part of ``n`` characters."""
    a, b = n // 3, n - n // 3
    return [(0, a), (a, b), (b, n)]


def index_keys(part: str) -> list[str]:
    """Keys of the three pieces, and of the outer two as they are after a swap with the piece beside them."""
    n = len(part)
    (_, a), _, (d, _) = _cuts(n)
    keys = [f"{i}.{n}.{part[x:z]}" for i, (x, z) in enumerate(_cuts(n))]
    return list(dict.fromkeys([*keys, *([f"0.{n}.{part[: a - 1]}{part[a]}", f"2.{n}.{part[d - 1]}{part[d + 1 :]}"] if n >= SHORT else [])]))


def probe_keys(part: str) -> list[str]:
    """Keys under which parts within two edits are indexed, a swap counting once.

    Of three pieces, two edits leave one whole; a swap across a cut changes two pieces, but the outer one only as
    ``index_keys`` foresees.
    """
    n, keys = len(part), set()
    for m in range(max(SHORT, n - 2), n + 3):
        (_, a), (b, c), (d, _) = _cuts(m)
        keys.add(f"0.{m}.{part[:a]}")
        keys.add(f"2.{m}.{part[n - (m - d) :]}")
        for shift in (-1, 0, 1):  # the middle one is needed only if one edit lies before it and one behind
            if b + shift >= 0 and c + shift <= n:
                keys.add(f"1.{m}.{part[b + shift : c + shift]}")
    return sorted(keys)


def index_halves(part: str) -> list[str]:
    """Keys of the two halves, and of the first as it is after a swap with the second."""
    n, h = len(part), len(part) // 2
    return list(dict.fromkeys([f"a.{n}.{part[:h]}", f"b.{n}.{part[h:]}", *([f"a.{n}.{part[: h - 1]}{part[h]}"] if h else [])]))


def probe_halves(part: str) -> list[str]:
    """Keys under which parts within one edit are indexed, a swap counting once: one half is whole, or a swap across the cut
    leaves the first as ``index_halves`` foresees."""
    n = len(part)
    lengths = range(max(SHORT, n - 1), n + 2)
    return sorted({f"a.{m}.{part[: m // 2]}" for m in lengths} | {f"b.{m}.{part[max(0, n - (m - m // 2)) :]}" for m in lengths})


def _length(key: str) -> int:
    return int(key.split(".")[1])


def indexed(part: str) -> list[str]:
    """Keys of a part: halves, under which parts meet that are allowed one edit, and thirds for two. A part of ``LONG``
    characters meets shorter ones under halves."""
    n = len(part)
    return (index_halves(part) if n <= LONG else []) + (index_keys(part) if n >= LONG else [])


def probed(part: str) -> list[str]:
    """Keys to look up for a part: those of ``indexed`` of every part within the edits that the shorter of both allows."""
    n = len(part)
    halves = [k for k in probe_halves(part) if min(n, _length(k)) < LONG]
    return halves + ([k for k in probe_keys(part) if _length(k) >= LONG] if n >= LONG else [])


def _part_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for name, entity_type in zip(pdf["name"], pdf["entity_type"]):
            kind = kind_of(entity_type)
            out.append((kind, *parts_of(name, kind)))
        yield pdf.assign(kind=[x[0] for x in out], parts=[x[1] for x in out], initials=[x[2] for x in out])[["name", "entity_type", "ids", "kind", "parts", "initials"]]


def _keyed(keys):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(key=[[f"{k}.{x}" for x in keys(p)] for k, p in zip(pdf["kind"], pdf["part"])]).explode("key")[["kind", "part", "n", "names", "key"]]

    return run


@lru_cache(maxsize=100_000)
def _letters(part: str) -> int:
    """The set of the letters of a part, as bits; letters that share a bit can only make two parts look more alike."""
    bits = 0
    for c in part:
        bits |= 1 << (ord(c) & 31)
    return bits


def _rare(n: int, beside: int) -> bool:
    return (n - RARE) * TIMES <= beside


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard, those that answer first: they build the trie that those that ask walk."""
    at, trie, held = None, Trie(), {}
    for pdf in batches:
        out = []
        for h, shard, asks, key, part, n in zip(pdf["_h"], pdf["_shard"], pdf["asks"], pdf["key"], pdf["part"], zip(pdf["n"], pdf["names"])):
            if (h, shard) != at:
                at, trie, held = (h, shard), Trie(), {}
            if not asks:
                trie.add(part, (key, part, n))
                held[part] = _letters(part)
                continue
            kind, of = key.split(".", 2)[:2]
            most, mine, size = 1 if of in "ab" else 2, _letters(part), len(part)
            # each edit changes the letters that a part has by two at most: a small trie without such parts isn't walked
            if len(held) <= 64 and not any((mine ^ x).bit_count() <= 2 * most and -most <= len(o) - size <= most and o != part for o, x in held.items()):
                continue
            for other_key, other, m in trie.within_swaps(part, most):
                # the spelling of the more frequent one is taken, or of the smaller of two as frequent; a known name isn't a
                # misspelling of another
                if other_key != key or other == part or (m[0], part) <= (n[0], other) or (part in KNOWN and other in KNOWN):
                    continue
                if (_rare(n[0], m[0]) or _rare(n[1], m[1]) or _rare(m[1], n[1])) and edits(part, other) <= min(_bound(part), _bound(other)):
                    out.append((kind, part, other, m[0]))
        yield pd.DataFrame(out, columns=["kind", "part", "other", "m"])


def respellings(parts: DataFrame) -> DataFrame:
    """(kind, part, spelling): the parts that take another spelling. ``parts`` has kind, part, n and names (ids and different
    names that have it)."""
    long = parts.filter(F.length("part") >= SHORT)
    schema = "kind string, part string, n long, names long, key string"
    asking = long.mapInPandas(_keyed(probed), schema)
    answering = long.mapInPandas(_keyed(indexed), schema)
    found = join_shards(asking, answering, ["key"], ["part"]).select("_h", "_shard", "asks", "key", "part", "n", "names").mapInPandas(_neighbours, "kind string, part string, other string, m long")
    best = found.groupBy("kind", "part").agg(F.max_by("other", F.struct("m", "other")).alias("to"))
    best = cut(best)
    # a spelling may itself take another: pointers (always to a more frequent or smaller part, so without circles) are
    # followed to their end, each round twice as far
    to_end = best
    while True:
        onward = to_end.select("kind", F.col("part").alias("to"), F.col("to").alias("then"))
        after = cut(to_end.join(onward, ["kind", "to"], "left").select("kind", "part", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")))
        if not after.filter("moved").take(1):
            return after.select("kind", "part", F.col("to").alias("spelling"))
        to_end = after.drop("moved")


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The key of each form, whether it is full, the short forms that it has or is, and its further initials."""
    for pdf in batches:
        rows = []
        for form, kind, parts, initials in zip(pdf["form"], pdf["kind"], pdf["parts"], pdf["initials"]):
            parts, initials = list(parts), list(initials)
            given = [PET_FORMS.get(p, (p,)) if kind == "PER" else (p,) for p in parts]
            if not parts and not initials:
                continue
            short: list[str] = []
            full, more = True, "".join(initials)
            if kind == "PER":
                formal = [g[0] for g in given]
                if len(parts) == 1 and initials:
                    full, short, more = False, [f"{parts[0]}/i{initials[0]}"], more[1:]
                elif len(parts) >= 2 and any(len(g) > 1 for g in given):
                    i = next(i for i, g in enumerate(given) if len(g) > 1)
                    full, short = False, [f"{' '.join(sorted(formal[:i] + formal[i + 1 :]))}/p{parts[i]}"]
                else:
                    for i, g in enumerate(formal):
                        rest = " ".join(sorted(formal[:i] + formal[i + 1 :]))
                        if len(formal) == 2:
                            short.append(f"{rest}/i{g[0]}")
                        short += [f"{rest}/p{pet}" for pet, of in PET_FORMS.items() if len(of) > 1 and g in of] if rest else []
                key = " ".join(sorted(formal)) if full and parts else short[0] if short else f"/i{more}"
            else:
                key = " ".join(sorted(parts))
                if len(parts) == 2 and kind == "ORG" and min(map(len, parts)) <= 5:
                    # perhaps a name and an acronym: it stands for a full name that has this part and these initials
                    acronym = min(parts, key=lambda p: (len(p), p))
                    rest = parts[1] if acronym == parts[0] else parts[0]
                    short, full = [f"{rest}/a{acronym}"], False
                elif len(parts) >= 3:
                    short = [f"{p}/a{''.join(q[0] for j, q in enumerate(parts) if j != i)}" for i, p in enumerate(parts)]
            rows.append((form, kind, key, full, short, more))
        yield pd.DataFrame(rows, columns=["form", "kind", "key", "full", "short", "more"])


def _told_apart(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (kind, ``by``, more) with ``group``: ``by``, and the further initials behind it where those of ``by`` differ.

    ``only`` are the further initials of the group: those of all of it, if there are any and they agree.
    """
    some = F.nullif("more", F.lit(""))
    seen = rows.groupBy("kind", by).agg(F.min(some).alias("_low"), F.max(some).alias("_high"))
    agree = F.coalesce(F.col("_low") == F.col("_high"), F.lit(True))
    at = rows.join(seen, ["kind", by])
    group = F.when(agree | (F.col("more") == ""), F.col(by)).otherwise(F.concat(by, F.lit("+"), "more"))
    return at.withColumn("group", group).withColumn("only", F.when(agree, F.coalesce("_low", F.lit(""))).otherwise(F.col("more"))).drop("_low", "_high")


def same_entities(entities: DataFrame) -> DataFrame:
    """(id, kind, group, spelling): the key of the name that each id has, and name and type as they are written. Ids whose
    name has no letters or digits are left out.

    Kinds are compared without regard to how taggers write them; names of different kinds are never the same. An id
    delivered with several names belongs to the group of each. Null names and ids are left out, an empty table gives
    no rows, repeated rows count once and further columns are ignored.
    """
    rows = entities.select("id", "name", "entity_type").filter("id IS NOT NULL AND name IS NOT NULL").distinct()
    names = rows.groupBy("name", "entity_type").agg(F.count("*").alias("ids"))
    taken = names.mapInPandas(_part_rows, "name string, entity_type string, ids long, kind string, parts array<string>, initials array<string>")
    taken = cut(taken.withColumn("form", F.sha2(F.to_json(F.struct("kind", "parts", "initials")), 256)))
    forms = taken.dropDuplicates(["form"]).select("form", "kind", "parts", "initials")
    at = forms.select("form", "kind", "initials", F.posexplode_outer("parts").alias("i", "part"))
    counts = cut(taken.select("kind", "ids", F.explode("parts").alias("part")).groupBy("kind", "part").agg(F.sum("ids").alias("n"), F.count("*").alias("names")))
    respelled = at.join(respellings(counts), ["kind", "part"], "left").withColumn("part", F.coalesce("spelling", "part"))
    whole = respelled.groupBy("form", "kind").agg(
        F.first("initials").alias("initials"), F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("i", "part")))).alias("p")
    )
    whole = whole.select("form", "kind", "initials", F.transform("p", lambda x: x["part"]).alias("parts"))
    keyed = cut(whole.mapInPandas(_forms, "form string, kind string, key string, full boolean, short array<string>, more string"))
    whole = _told_apart(keyed.filter("full"), "key")
    # a short form joins the full name that it fits, if there is just one: of those with its further initials, else of those without any
    offers = whole.select("kind", "group", "only", F.explode("short").alias("s")).groupBy("kind", "s", "only").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    offers = offers.groupBy("kind", "s").agg(F.collect_list(F.struct("only", "low", "high")).alias("offers"))
    wants = keyed.filter("NOT full").select("form", "kind", "key", "more", F.element_at("short", 1).alias("s")).join(offers, ["kind", "s"], "left")
    same = F.filter("offers", lambda o: (F.col("more") == "") | (o["only"] == F.col("more")))
    fitting = F.when(F.size(same) > 0, same).otherwise(F.filter("offers", lambda o: o["only"] == ""))
    one = F.array_min(F.transform(fitting, lambda o: o["low"])) == F.array_max(F.transform(fitting, lambda o: o["high"]))
    wants = cut(wants.select("form", "kind", "key", "more", F.when(one, F.array_min(F.transform(fitting, lambda o: o["low"]))).alias("to")))
    alone = _told_apart(wants.filter("to IS NULL"), "key")
    groups = whole.select("form", "kind", "group").unionByName(wants.filter("to IS NOT NULL").select("form", "kind", F.col("to").alias("group"))).unionByName(alone.select("form", "kind", "group"))
    by_name = taken.select("name", "entity_type", "form").join(groups, "form").select("name", "entity_type", "kind", "group")
    found = rows.join(by_name, [rows["name"] == by_name["name"], rows["entity_type"].eqNullSafe(by_name["entity_type"])])
    return found.select("id", "kind", "group", F.to_json(F.struct(rows["name"], rows["entity_type"])).alias("spelling")).distinct()


def same_pairs(groups: DataFrame, expanded: int | None = EXPANDED) -> DataFrame:
    """(id_a, id_b): pairs of ids of one group, the smaller first.

    All pairs of ids of different spellings, and of up to ``expanded`` copies (ids of one spelling). More copies than
    that appear as their smallest id, and that in a pair with each of the others, so that no link is lost. With None,
    all pairs are given, however many copies there are.
    """
    copies = groups.groupBy("kind", "group", "spelling").agg(F.countDistinct("id").alias("n"), F.min("id").alias("low")).filter(F.lit(False) if expanded is None else F.col("n") > expanded).drop("n")
    marked = cut(groups.join(copies, ["kind", "group", "spelling"], "left").select("kind", "group", "id", "low"))
    members = marked.filter("low IS NULL OR id = low").select("kind", "group", "id").distinct()
    sizes = members.groupBy("kind", "group").agg(F.ceil(F.count("*") / PAIRED).alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = members.join(sizes, ["kind", "group"])
    # the ids of a group are dealt over blocks on one side and repeated for each block on the other
    ours = members.select("kind", "group", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.col("id").alias("id_a"))
    theirs = members.select("kind", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("id").alias("id_b"))
    pairs = ours.join(theirs, ["kind", "group", "block"]).filter("id_a < id_b").select("id_a", "id_b")
    star = marked.filter("id <> low").select(F.col("low").alias("id_a"), F.col("id").alias("id_b"))
    return pairs.unionByName(star).distinct()
