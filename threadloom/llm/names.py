"""Linking the spellings of persons and organisations.

1. Every distinct string of a scope (mailbox) is parsed: display name and address,
   title, department and legal form set apart, comma order undone, case and
   diacritics folded. Strings that spell a whole name alike are one *spelling*: given
   and family name of a person, the words of an organisation.
2. Pigeonhole segment join: each whole spelling (also with the given names its short
   form stands for, and for organisations with the head word and the initials of the
   rest, in each rotation, and run together) is cut into even segments; substrings of
   the others, shifted by the slips allowed, are looked up in the inverted index of
   (scope, length, segment number, segment); a banded edit distance, and then the rules
   of names, confirm each pair. No other pairs are formed.
3. Confirmed pairs are connected to entities. Two spellings stay apart if their middle
   initials differ, or if addresses confirm both; of neighbours that must stay apart a
   spelling keeps the nearest.
4. What isn't a whole name (initials, abbreviated or missing given names, short
   addresses, acronyms, single words) joins the one entity it fits, and none if it fits
   several. Each entity is registered under every handle it may be called by, with the
   least and the greatest entity of a handle: one where both are equal.

Everything is a join or an aggregation over rows of one spelling; no group is resolved in
one task, so a name with thousands of spellings is as cheap as thousands of names.

Defined results
  * null scope is a scope of its own, which is dropped; null and blank names are no names
  * repeated rows count as votes for the kind of a name, nothing else
  * an empty table gives no entities and no pairs; extra columns are ignored
  * a string with several parts (a display name and an address) ties their entities
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from threadloom.llm.language import fold
from threadloom.runtime import materialize

# Short forms of given names and the given names they stand for.
SHORT_FORMS: dict[str, tuple[str, ...]] = {
    "al": ("albert", "alan", "alexander"), "alex": ("alexander", "alexandra"), "andy": ("andrew", "andreas"),
    "becky": ("rebecca",), "ben": ("benjamin",), "bert": ("albert", "robert"), "beth": ("elizabeth",), "betty": ("elizabeth",),
    "bill": ("william",), "billy": ("william",), "bob": ("robert",), "bobby": ("robert",), "cathy": ("catherine", "katharina"),
    "charlie": ("charlotte", "charles"), "chris": ("christopher", "christine", "christian"), "dan": ("daniel",), "dave": ("david",),
    "deb": ("deborah",), "debbie": ("deborah",), "dima": ("dmitri",), "mitya": ("dmitri",), "dora": ("theodora",), "thea": ("theodora", "dorothea"),
    "ed": ("edward",), "eliza": ("elizabeth",), "fran": ("francisco", "frances"), "frank": ("francisco", "franklin"), "fred": ("friedrich", "frederick"),
    "fritz": ("friedrich",), "gabi": ("gabriela",), "gaby": ("gabriela",), "gosia": ("malgorzata",), "greg": ("gregory",), "jen": ("jennifer",),
    "jenny": ("jennifer",), "jim": ("james",), "joe": ("joseph",), "jon": ("jonathan",), "kasia": ("katharina", "katarzyna"), "kate": ("katharina", "katherine"),
    "kathi": ("katharina",), "kathy": ("katharina", "katherine"), "ken": ("kenneth", "kenji"), "leo": ("leonard",), "len": ("leonard",), "lisa": ("elizabeth",),
    "liz": ("elizabeth",), "lizzy": ("elizabeth",), "lottie": ("charlotte",), "lucy": ("lucia",), "maggie": ("margaret",), "meg": ("margaret",),
    "peggy": ("margaret",), "matt": ("matthias", "matthew"), "matze": ("matthias",), "mick": ("michael",), "mike": ("michael",), "neil": ("cornelius",),
    "nick": ("nicholas",), "nico": ("nicholas",), "pablo": ("pavel",), "paco": ("francisco",), "pancho": ("francisco",), "pasha": ("pavel",),
    "pat": ("patricia", "patrick"), "patty": ("patricia",), "rafi": ("raphael",), "rafa": ("raphael",), "rob": ("robert",), "ron": ("ronald",),
    "sam": ("samuel", "samantha"), "sandy": ("alexander",), "sasha": ("alexander",), "steve": ("stephen",), "sue": ("susanne",), "susi": ("susanne",),
    "susie": ("susanne",), "ted": ("theodore", "edward"), "tom": ("thomas", "tomas"), "tommy": ("thomas",), "toni": ("anthony", "antonia"), "tony": ("anthony",),
    "tricia": ("patricia",), "vicky": ("victoria",), "vic": ("victoria", "victor"), "wendy": ("wendeline", "gwendolyn"), "will": ("william",), "willy": ("william",),
}
# Titles, and legal forms of organisations.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "herr", "frau", "ing", "dipl", "mme", "sr", "sra"}
LEGAL = {"ltd", "limited", "inc", "incorporated", "plc", "llc", "llp", "gmbh", "ag", "kg", "ab", "as", "sa", "sas", "srl", "spa", "bv", "nv", "oy", "co", "corp", "corporation", "company", "group", "holding"}
ROLES = {"desk", "office", "billing", "info", "contact", "sales", "support", "mail", "hello", "admin", "accounts", "service"}

_ADDRESS = re.compile(r"<?([\w.+'-]+)@([\w-]+(?:\.[\w-]+)*)>?")
_VIA = re.compile(r"\s+via\s+[^<]*", re.I)


def damerau(a: str, b: str, most: int) -> int:
    """Edit distance with neighbour swaps, in a band of ``most``; most + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        now = [most + 1] * (len(b) + 1)
        if lo == 1:
            now[0] = i
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now[j] = v
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def near(a: str, b: str) -> bool:
    """Equal, or one slip apart in words long enough to tell."""
    return a == b or (min(len(a), len(b)) >= 4 and damerau(a, b, 1) <= 1)


def given_fits(a: str, b: str) -> bool:
    """Two given names can be of one person: equal, or a short form of the other."""
    return a == b or b in SHORT_FORMS.get(a, ()) or a in SHORT_FORMS.get(b, ()) or bool(set(SHORT_FORMS.get(a, ())) & set(SHORT_FORMS.get(b, ())))


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:['’][^\W_]+)*\.?", fold(text))


class Name:
    """A parsed string. ``readings``: (given, middle initial, family) it may stand for."""

    __slots__ = ("org", "org_domain", "org_raw", "readings", "role", "short", "text", "user")

    def __init__(self, text: str, org_votes: int = 0, person_votes: int = 0):
        self.text = text
        self.readings: list[tuple[str, str, str]] = []
        self.org: tuple[str, ...] = ()
        self.org_raw: tuple[str, ...] = ()
        self.short = ""
        self.org_domain: tuple[str, str] | None = None
        self.user: tuple[str, str, bool] | None = None  # given or initial, family, full
        self.role = False
        clean = re.sub(r"[\s\xa0]+", " ", text).strip()
        m = _ADDRESS.search(clean)
        display = clean
        if m:
            display = clean[: m.start()] + clean[m.end() :]
            local, domain = fold(m[1]), fold(m[2])
            if local in ROLES:
                self.role = True
                head, _, tail = domain.split(".")[0].partition("-")
                self.org_domain = (head, tail)
            else:
                parts = [p for p in re.split(r"[._]", local) if p]
                if len(parts) >= 2:
                    self.user = (parts[0], re.sub(r"[^a-z0-9]", "", "".join(parts[1:])), True)
                elif len(local) >= 4:
                    self.user = (local[0], re.sub(r"[^a-z0-9]", "", local[1:]), False)
        display = _VIA.sub("", display)
        display = re.sub(r"\([^()]*\)", " ", display)
        display = re.sub(r"[\"“”<>]|^\s*'|'\s*$", " ", display).strip(" ,;")
        if not display:
            return
        if self.role or org_votes > person_votes:
            self._organisation(display)
        if not self.role and not self.org_only(display):
            self._person(display)

    def org_only(self, display: str) -> bool:
        return bool(re.search(r"&|\d", display)) or any(w.strip(".") in LEGAL for w in words_of(display)[1:])

    def _organisation(self, display: str) -> None:
        plain = fold(display).strip()
        letters = re.sub(r"[^a-z0-9]", "", plain)
        if re.fullmatch(r"(?:[a-z0-9]\.\s?){2,}[a-z0-9]?\.?", plain) or (
            2 <= len(letters) <= 6 and display.isupper() and " " not in display.strip()
        ):
            self.short = letters
            return
        words = [w for w in words_of(re.sub(r"\b((?:[a-z]\.){2,})", lambda x: x[1].replace(".", "") + " ", plain)) if w != "the"]
        self.org_raw = tuple(w.strip(".") for w in words)
        while len(words) > 1 and words[-1].strip(".") in LEGAL:
            words.pop()
        self.org = tuple(words)

    def _person(self, display: str) -> None:
        def given_and_middle(text: str) -> tuple[str, str]:
            w = [x for x in words_of(re.sub(r"\.(?=\S)", ". ", text)) if x.strip(".") not in TITLES]
            if not w:
                return "", ""
            middle = w[1].strip(".")[0] if len(w) > 1 and len(w[1].strip(".")) == 1 else ""
            return (w[0] if w[0].endswith(".") and len(w[0]) > 2 else w[0].strip(".")), middle

        if "," in display:
            family, _, rest = display.partition(",")
            self.readings.append((*given_and_middle(rest), _joined(family)))
            return
        parts = [w for w in re.sub(r"\.(?=\S)", ". ", display).split(" ") if w and fold(w).strip(".,") not in TITLES]
        if not parts:
            return
        if len(parts) == 1:
            self.readings.append(("", "", _joined(parts[0])))
            return
        self.readings.append((*given_and_middle(" ".join(parts[:-1])), _joined(parts[-1])))
        if len(parts) == 2 or all(len(p.strip(".")) == 1 for p in parts[1:]):
            self.readings.append((*given_and_middle(" ".join(parts[1:])), _joined(parts[0])))

    def facts(self) -> list[tuple[str, str, str, str, int]]:
        """(kind, a, b, c, n) of everything the string says.

        F: given, family, middle of a whole name; R: the same of its other order (n: 0 if it has
        none); Y: a family name whose place is certain; V, W: given name or initial, and family
        of an address; S, I, P, U: family alone, initial (a) and middle (c), abbreviated given
        name, short address, each with family b and the place n of the reading; O: words of an
        organisation, raw words; A: acronym; D: head and tail of a domain.
        """
        out: list[tuple[str, str, str, str, int]] = []
        full = False
        for k, (given, middle, family) in enumerate(self.readings):
            whole = len(given) > 1 and not given.endswith(".") and len(family) > 1
            if k == 0 and whole:
                out.append(("F", given, family, middle, 0))
                full = True
            if k == 1 and full:
                out.append(("R", given, family, "", 1))
        if len(self.readings) == 1:
            out.append(("Y", "", self.readings[0][2], "", 0))
        if self.user:
            given, family, whole = self.user
            out += [("Y", "", family, "", 0), ("V" if whole else "W", given, family, "", 0)]
            if whole:
                out.append(("F", given, family, "", 1))
            else:
                out.append(("U", given, family, "", 0))
        if not full and not (self.user and not self.user[2]):
            for k, (given, middle, family) in enumerate(self.readings):
                if len(family) < 2 or (given and len(given) > 1 and not given.endswith(".")):
                    continue
                kind = "S" if not given else "P" if given.endswith(".") else "I"
                out.append((kind, given.strip("."), family, middle, k if not (self.org and kind == "I") else k + 10))
        if self.org:
            out.append(("O", " ".join(self.org), " ".join(self.org_raw), "", len(self.org)))
        if self.short:
            out.append(("A", self.short, "", "", 0))
        if self.org_domain and not self.org:
            out.append(("D", *self.org_domain, "", 0))
        return out


def _joined(family: str) -> str:
    return re.sub(r"[^a-z0-9]", "", fold(family))


def _word_fits(a: str, b: str) -> int:
    """Slips between two words of organisation names: 0, 1, or 9 for different words."""
    x, y = a.strip("."), b.strip(".")
    if x == y:
        return 0
    if len(x) > len(y):
        x, y, a, b = y, x, b, a
    if x[0] == y[0] and len(x) >= 3 and len(x) < len(y):
        if a.endswith(".") or len(x) <= 5:
            rest = iter(y)
            if all(c in rest for c in x) and (y.startswith(x) or a.endswith(".") or x[-1] == y[-1] or len(x) <= 4):
                return 0
    return 1 if min(len(x), len(y)) >= 5 and damerau(x, y, 1) <= 1 else 9


def org_fits(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """One organisation: the same words in order, or rotated, with abbreviations and few slips."""
    if len(a) == len(b):
        turns = [b] if len(b) == 1 else [b, (b[-1], *b[:-1]), (*b[1:], b[0])]
        return any(sum(_word_fits(x, y) for x, y in zip(a, t)) <= 2 for t in turns)
    if 1 in (len(a), len(b)):
        one, many = (a[0], b) if len(a) == 1 else (b[0], a)
        whole = "".join(w.strip(".") for w in many)
        return len(one) > len(many[0]) + 2 and damerau(one.strip("."), whole, 1) <= 1
    return False


def pair_cost(ga: str, fa: str, gb: str, fb: str) -> int | None:
    """Slips between two whole names of one person; None if they can't be one."""
    if not near(fa, fb):
        return None
    fits = given_fits(ga, gb)
    if not fits and (not near(ga, gb) or (ga in SHORT_FORMS and gb in SHORT_FORMS)):
        return None
    return (fa != fb) + (not fits)


def longer_forms(given: str) -> list[str]:
    """A given name and those it is a short form of."""
    return [given, *SHORT_FORMS.get(given, ())]


def handles(given: str, family: str, middles: list[str]) -> list[str]:
    """What an incomplete name of this person may be: see ``wanted``."""
    out = {f"S {family}", f"I {given[0]} {family}", *(f"I {given[0]} {m} {family}" for m in middles or ["-"])}
    for full in longer_forms(given):
        out |= {f"P {full[:n]} {family}" for n in range(1, len(full) + 1)}
    return sorted(out)


def wanted(kind: str, given: str, middle: str, family: str) -> list[str]:
    """Handles of the entities an incomplete name fits."""
    if kind == "S":
        return [f"S {family}"]
    if kind == "P":
        return [f"P {given} {family}"]
    return [f"I {given} {middle} {family}", f"I {given} - {family}"] if middle else [f"I {given[0]} {family}"]


def org_forms(org: str) -> list[str]:
    """Whole forms of an organisation that abbreviation leaves alone: head and initials in each rotation, and run together."""
    w = [x.strip(".") for x in org.split(" ")]
    if len(w) == 1:
        return ["=" + w[0]]
    turns = [w, [w[-1], *w[:-1]], [*w[1:], w[0]]]
    return list(dict.fromkeys([*(t[0] + " " + "".join(x[:1] for x in t[1:]) for t in turns), "=" + "".join(w)]))


def org_handles(org: str, raw: str) -> list[str]:
    """What an organisation of several words may be called by: head word, acronyms, domain."""
    words = org.split(" ")
    head = words[0].strip(".")
    out = {f"H {head}", f"D {head} ", *("A " + "".join(w[0] for w in x.split(" ")) for x in (org, raw) if x)}
    for w in words[1:]:
        out |= {f"D {head} {w[:n]}" for n in range(1, len(w) + 1)} | {f"E {head} {w[:3]}"}
    return sorted(out)


# --- Spark side -------------------------------------------------------------


def distinct_names(mentions: DataFrame, messages: DataFrame, scope: str = "mailbox_id") -> DataFrame:
    """(scope, name, org_votes, person_votes) of every string that names a person or organisation."""
    org, person = F.col("entity_type") == "ORG", F.col("entity_type") == "PERSON"
    typed = mentions.where(org | person).select(
        scope, F.explode(F.array("mention_text", "canonical_name")).alias("name"), org.cast("int").alias("o"), person.cast("int").alias("p")
    )
    senders = messages.select(scope, F.col("sender").alias("name"), F.lit(0).alias("o"), F.lit(0).alias("p"))
    return (
        typed.unionByName(senders)
        .where(F.col(scope).isNotNull() & (F.trim("name") != ""))
        .groupBy(scope, "name")
        .agg(F.sum("o").cast("int").alias("org_votes"), F.sum("p").cast("int").alias("person_votes"))
    )


_FACT = StructType().add("kind", StringType()).add("a", StringType()).add("b", StringType()).add("c", StringType()).add("n", IntegerType())
_WORDS = ArrayType(StringType())


@F.pandas_udf(ArrayType(_FACT))
def _facts(name: pd.Series, org_votes: pd.Series, person_votes: pd.Series) -> pd.Series:
    keys = ("kind", "a", "b", "c", "n")
    return pd.Series([[dict(zip(keys, f)) for f in Name(n, o, p).facts()] for n, o, p in zip(name, org_votes, person_votes)])


@F.pandas_udf(_WORDS)
def _whole_forms(given: pd.Series, family: pd.Series) -> pd.Series:
    return pd.Series([[f"{x} {f}" for x in longer_forms(g)] for g, f in zip(given, family)])


@F.pandas_udf(_WORDS)
def _longer(given: pd.Series) -> pd.Series:
    return given.map(longer_forms)


@F.pandas_udf(IntegerType())
def _cost(ga: pd.Series, fa: pd.Series, gb: pd.Series, fb: pd.Series) -> pd.Series:
    return pd.Series([pair_cost(*x) for x in zip(ga, fa, gb, fb)], dtype="Int32")


@F.pandas_udf(BooleanType())
def _orgs_fit(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([org_fits(tuple(x.split(" ")), tuple(y.split(" "))) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(_WORDS)
def _handles(given: pd.Series, family: pd.Series, middles: pd.Series) -> pd.Series:
    return pd.Series([handles(g, f, list(m)) for g, f, m in zip(given, family, middles)])


@F.pandas_udf(_WORDS)
def _wanted(kind: pd.Series, given: pd.Series, middle: pd.Series, family: pd.Series) -> pd.Series:
    return pd.Series([wanted(*x) for x in zip(kind, given, middle, family)])


@F.pandas_udf(_WORDS)
def _org_forms(org: pd.Series) -> pd.Series:
    return org.map(org_forms)


@F.pandas_udf(_WORDS)
def _org_handles(org: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([org_handles(o, r) for o, r in zip(org, raw)])


def segment_join(left: DataFrame, right: DataFrame, scope: str, slips: int = 1) -> DataFrame:
    """(scope, left, right, l, r): strings of a scope at most ``slips`` slips apart, by the pigeonhole principle.

    left and right: scope, id, s. A slip is at most two plain edits (a swap), so ``slips``
    of them leave one of 2 slips + 1 even segments of the right string intact, at most
    ``slips`` places away in the left one. The distance is verified in a band; strings
    shorter than their number of segments meet only their equals.
    """
    parts = 2 * slips + 1
    begin = lambda n, k: F.floor(n * k / parts).cast("int")
    cut = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    at, length = begin(F.col("m"), F.col("k")), begin(F.col("m"), F.col("k") + 1)
    index = (
        right.select(scope, F.col("id").alias("right"), F.col("s").alias("r"), F.length("s").alias("m"), cut.alias("k"))
        .select(scope, "right", "r", F.hash("m", "k", F.substring(F.col("r"), at + 1, length - at)).alias("seg"), (length - at).alias("size"))
        .where("size > 0")
        .drop("size")
    )
    near_length = F.explode(F.sequence(F.greatest(F.col("n") - slips, F.lit(1)), F.col("n") + slips))
    shift = F.explode(F.sequence(F.lit(-slips), F.lit(slips)))
    probe = (
        left.select(scope, F.col("id").alias("left"), F.col("s").alias("l"), F.length("s").alias("n"))
        .select("*", near_length.alias("m"))
        .select("*", cut.alias("k"))
        .select("*", shift.alias("shift"))
        .where((at + F.col("shift") >= 0) & (length + F.col("shift") <= F.col("n")) & (length > at))
        .select(scope, "left", "l", F.hash("m", "k", F.substring(F.col("l"), at + F.col("shift") + 1, length - at)).alias("seg"))
        .distinct()
    )
    return (
        probe.join(index, [scope, "seg"])
        .where(F.levenshtein("l", "r", 2 * slips) >= 0)
        .select(scope, "left", "right", "l", "r")
        .distinct()
    )


def connected(edges: DataFrame, scope: str) -> DataFrame:
    """(scope, id, label): the least id of each id's component, for ids that have an edge (a, b).

    Each round takes the least label around and that label's own label, so a chain of n ids
    takes about log n rounds; the loop ends when no label moves, and not before.
    """
    both = materialize(edges.select(scope, "a", "b").unionByName(edges.select(scope, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "name-edges")
    labels = both.groupBy(scope, F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    labels = materialize(labels, "name-labels")
    while True:
        around = both.join(labels.select(scope, F.col("id").alias("b"), F.col("label").alias("other")), [scope, "b"]).groupBy(scope, F.col("a").alias("id")).agg(F.min("other").alias("other"))
        stepped = labels.join(around, [scope, "id"]).select(scope, "id", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jump = labels.select(scope, F.col("id").alias("label"), F.col("label").alias("next"))
        moved = materialize(stepped.join(jump, [scope, "label"], "left").select(scope, "id", F.least("label", F.coalesce("next", "label")).alias("label"), "was"), "name-labels")
        labels = moved.select(scope, "id", "label")
        if moved.where("was <> label").isEmpty():
            return labels


def _labelled(nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """(nodes..., entity): the component of each node; a node without an edge is its own."""
    found = connected(edges, scope).withColumnRenamed("label", "entity")
    return nodes.join(found, [scope, "id"], "left").withColumn("entity", F.coalesce("entity", "id"))


def _only(rows: DataFrame, by: list[str], least: str = "lo", most: str = "hi") -> DataFrame:
    """(by..., lo, hi): the least and the greatest entity of each group."""
    return rows.groupBy(*by).agg(F.min(least).alias("lo"), F.max(most).alias("hi"))


def person_spellings(facts: DataFrame, scope: str) -> DataFrame:
    """(scope, name, g, f, m): the whole name of each string that has one.

    A name in two words whose family name nobody confirms is read in its other order, where
    that is near a name whose order is certain: from a comma, a middle initial, or an address.
    """
    full = facts.where("kind = 'F'").select(scope, "name", F.col("a").alias("g"), F.col("b").alias("f"), F.col("c").alias("m"), "n")
    sure = facts.where("kind = 'Y' and length(b) > 1").select(scope, F.col("b").alias("f")).distinct()
    alone = full.groupBy(scope, "g", "f").agg(F.count_distinct("name").alias("texts")).where("texts = 1").select(scope, "g", "f")
    unsure = full.where("n = 0").join(alone, [scope, "g", "f"], "left_semi").join(sure, [scope, "f"], "left_anti").select(scope, "name", F.concat_ws(" ", "g", "f").alias("own"))
    turned = facts.where("kind = 'R'").select(scope, "name", F.col("a").alias("g1"), F.col("b").alias("f1")).join(unsure, [scope, "name"])
    certain = full.join(sure, [scope, "f"], "left_semi").select(scope, "g", "f").distinct()
    forms = certain.select(scope, F.concat_ws(" ", "g", "f").alias("id"), F.explode(_whole_forms("g", "f")).alias("s"))
    asked = turned.select(scope, F.concat_ws(" ", "g1", "f1").alias("id"), F.explode(_whole_forms("g1", "f1")).alias("s")).distinct()
    met = materialize(segment_join(asked, forms, scope, 2), "turned-names").select(scope, F.split("left", " ").alias("x"), F.split("right", " ").alias("y"), "left", "right").distinct()
    cost = _cost(F.get("x", F.lit(0)), F.get("x", F.lit(1)), F.get("y", F.lit(0)), F.get("y", F.lit(1)))
    fits = met.withColumn("cost", cost).where("cost is not null").select(scope, "left", F.struct((F.get("x", F.lit(1)) != F.get("y", F.lit(1))).alias("slip"), "cost", F.col("right").alias("to")).alias("best"))
    moved = (
        turned.withColumn("left", F.concat_ws(" ", "g1", "f1")).join(fits, [scope, "left"]).where("best.to <> own").groupBy(scope, "name").agg(F.min("best").alias("best"))
        .select(scope, "name", F.split("best.to", " ").alias("to"))
    )
    kept = full.join(moved.select(scope, "name", F.lit(0).alias("n")), [scope, "name", "n"], "left_anti").select(scope, "name", "g", "f", "m")
    return kept.unionByName(moved.select(scope, "name", F.get("to", F.lit(0)).alias("g"), F.get("to", F.lit(1)).alias("f"), F.lit("").alias("m")))


def person_entities(spelled: DataFrame, facts: DataFrame, scope: str) -> DataFrame:
    """(scope, id, g, f, entity, middles): the entity of every whole name, and the middle initials of it."""
    middles = F.sort_array(F.collect_set(F.when(F.col("m") != "", F.col("m"))))
    nodes = spelled.groupBy(scope, "g", "f").agg(middles.alias("ms")).withColumn("id", F.concat_ws(" ", "g", "f"))
    # an address confirms the spelling of a family name
    users = facts.where("kind = 'V'").select(scope, F.col("b").alias("f"), F.explode(_longer("a")).alias("x")).distinct()
    initials = facts.where("kind = 'W'").select(scope, F.col("b").alias("f"), F.col("a").alias("i")).distinct()
    long = nodes.select(scope, "id", "f", F.explode(_longer("g")).alias("x"))
    backed = long.join(users, [scope, "f", "x"]).select(scope, "id").unionByName(nodes.withColumn("i", F.substring("g", 1, 1)).join(initials, [scope, "f", "i"]).select(scope, "id")).distinct()
    nodes = materialize(nodes.join(backed.withColumn("backed", F.lit(True)), [scope, "id"], "left").withColumn("backed", F.coalesce("backed", F.lit(False))), "name-spellings")
    forms = nodes.select(scope, "id", F.explode(_whole_forms("g", "f")).alias("s"))
    pairs = materialize(segment_join(forms, forms, scope, 2).where("left < right").select(scope, "left", "right").distinct(), "spelling-pairs")
    side = lambda c: nodes.select(scope, F.col("id").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("g", "f", "ms", "backed")])
    apart = lambda a, b: (
        ((F.size(f"{a}_ms") > 0) & (F.size(f"{b}_ms") > 0) & ~F.arrays_overlap(f"{a}_ms", f"{b}_ms")) | ((F.col(f"{a}_f") != F.col(f"{b}_f")) & F.col(f"{a}_backed") & F.col(f"{b}_backed"))
    )
    near_pairs = (
        pairs.join(side("left"), [scope, "left"]).join(side("right"), [scope, "right"]).withColumn("cost", _cost("left_g", "left_f", "right_g", "right_f")).where("cost is not null").where(~apart("left", "right"))
    )
    links = materialize(near_pairs.select(scope, F.col("left").alias("a"), F.col("right").alias("b"), "cost"), "name-links")
    # of neighbours that must stay apart a spelling keeps the nearest
    both = links.unionByName(links.select(scope, F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    nearest = both.groupBy(scope, "a").agg(F.min(F.struct("cost", "b")).alias("best"), F.count("*").alias("n")).where("n > 1").select(scope, "a", F.col("best.b").alias("first"))
    rivals = both.join(nearest, [scope, "a"]).where("b <> first").join(side("b"), [scope, "b"]).join(side("first"), [scope, "first"]).where(apart("b", "first"))
    gone = rivals.select(scope, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    placed = _labelled(nodes.select(scope, "id", "g", "f", "ms"), links.join(gone, [scope, "a", "b"], "left_anti"), scope)
    known = placed.groupBy(scope, "entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ms")))).alias("middles"))
    return placed.drop("ms").join(known, [scope, "entity"])


def _by_handle(asked: DataFrame, held: DataFrame, scope: str, by: list[str]) -> DataFrame:
    """(by..., lo, hi): entities registered under any of the handles asked for."""
    return _only(asked.join(held, [scope, "handle"]), by)


def incomplete_persons(facts: DataFrame, entities: DataFrame, own: DataFrame, scope: str) -> DataFrame:
    """(scope, name, label): the entity of each incomplete name that fits just one, or a label that it
    shares with the same initial and family name where it fits none.

    Family names are met as they are, and only where that gives nothing within one slip.
    """
    each = materialize(entities.select(scope, "entity", "g", "f", F.explode(_handles("g", "f", "middles")).alias("handle")).select(scope, "handle", "entity", "f").distinct(), "name-handles")
    held = _only(each.withColumn("lo", F.col("entity")).withColumn("hi", F.col("entity")), [scope, "handle"])
    part = materialize(facts.where("kind in ('S', 'I', 'P', 'U') and length(b) > 1").select(scope, "name", "kind", F.col("a").alias("i"), F.col("b").alias("f"), F.col("c").alias("m"), "n"), "part-names")
    by = [scope, "name", "kind", "n"]
    held = materialize(held, "handle-entities")
    exact = materialize(_by_handle(part.select(*by, F.explode(_wanted("kind", "i", "m", "f")).alias("handle")), held, scope, by), "part-hits")
    rest = part.join(exact.select(*by), by, "left_anti")
    families = entities.select(scope, F.col("f").alias("id"), F.col("f").alias("s")).distinct()
    asked = rest.select(scope, F.col("f").alias("id"), F.col("f").alias("s")).distinct()
    close = segment_join(asked, families, scope, 1).where("left <> right").where(_near("left", "right")).select(scope, F.col("left").alias("f"), F.col("right").alias("near_f"))
    slipped = _by_handle(rest.join(close, [scope, "f"]).select(*by, F.explode(_wanted("kind", "i", "m", "near_f")).alias("handle")), held, scope, by)
    hits = materialize(exact.unionByName(slipped), "part-hits")
    first = hits.groupBy(scope, "name").agg(F.min_by(F.struct("kind", "lo", "hi"), "n").alias("h")).select(scope, "name", "h.*")
    one = first.where("lo = hi").select(scope, "name", F.concat(F.lit("p "), "lo").alias("label"))
    # a short address that fits several is of the one its own display name is of
    several = first.where("lo <> hi and kind = 'U'").join(part.where("kind = 'U'").select(scope, "name", F.concat(F.lit("I "), "i", F.lit(" "), "f").alias("handle")), [scope, "name"])
    mine = several.join(own, [scope, "name"]).join(each.select(scope, "handle", "entity"), [scope, "handle", "entity"])
    settled = _only(mine.withColumn("lo", F.col("entity")).withColumn("hi", F.col("entity")), [scope, "name"]).where("lo = hi").select(scope, "name", F.concat(F.lit("p "), "lo").alias("label"))
    settled = materialize(settled, "settled-names")
    loose = part.where("kind = 'U' or (kind = 'I' and n = 0 and length(i) = 1)").join(first.select(scope, "name"), [scope, "name"], "left_anti")
    return one.unionByName(settled).unionByName(loose.select(scope, "name", F.concat(F.lit("l "), "i", F.lit(" "), "f").alias("label")))


def organisations(facts: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """((scope, name, label), (scope, a, b)): the label of every organisation's string, and labels that are one."""
    o = facts.where("kind = 'O'").select(scope, "name", F.col("a").alias("org"), F.col("b").alias("raw"), "n")
    nodes = materialize(o.groupBy(scope, "org", "n").agg(F.collect_set("raw").alias("raws")), "organisations")
    forms = nodes.select(scope, F.col("org").alias("id"), "n", F.explode(_org_forms("org")).alias("s"))
    many = forms.where("n > 1").drop("n")
    pairs = segment_join(many, many, scope, 1).where("left < right").select(scope, "left", "right").distinct().where(_orgs_fit("left", "right"))
    placed = materialize(_labelled(nodes.where("n > 1").select(scope, F.col("org").alias("id"), "raws"), pairs.select(scope, F.col("left").alias("a"), F.col("right").alias("b")), scope), "organisation-entities")
    held = placed.select(scope, "entity", F.explode("raws").alias("raw"), "id").select(scope, "entity", F.explode(_org_handles("id", "raw")).alias("handle")).distinct()
    held = materialize(_only(held.withColumn("lo", F.col("entity")).withColumn("hi", F.col("entity")), [scope, "handle"]), "organisation-handles")
    heads = held.where("handle like 'H %'").select(scope, F.substring("handle", 3, 1 << 20).alias("id")).withColumn("s", F.col("id"))

    def tiers(*levels: DataFrame) -> DataFrame:
        """(scope, key, lo, hi) of the first level that has a key."""
        ranked = None
        for n, level in enumerate(levels):
            part = level.select(scope, "key", F.lit(n).alias("level"), "lo", "hi")
            ranked = part if ranked is None else ranked.unionByName(part)
        best = ranked.groupBy(scope, "key").agg(F.min(F.struct("level", "lo")).alias("least"), F.max(F.struct(F.negative("level").alias("first"), "hi")).alias("most"))
        return best.select(scope, "key", "least.lo", "most.hi")

    # one word: run together from several, else their head, else near their head
    single = nodes.where("n = 1").select(scope, F.col("org").alias("id"), F.regexp_replace("org", r"\.$", "").alias("word")).distinct()
    runs = segment_join(forms.where("n = 1").drop("n"), many.where("s like '=%'"), scope, 1).where(_orgs_fit("left", "right")).select(scope, F.col("left").alias("key"), F.col("right").alias("id"))
    runs = materialize(runs.join(placed.select(scope, "id", F.col("entity").alias("lo"), F.col("entity").alias("hi")), [scope, "id"]).select(scope, "key", "lo", "hi"), "run-together")
    named = single.select(scope, F.col("id").alias("key"), F.concat(F.lit("H "), "word").alias("handle")).join(held, [scope, "handle"])
    words = single.select(scope, F.col("word").alias("id"), F.col("word").alias("s")).distinct()
    close = segment_join(words, heads, scope, 1).where("left <> right").where(_near("left", "right")).select(scope, F.col("left").alias("word"), F.concat(F.lit("H "), "right").alias("handle"))
    slipped = single.join(materialize(close, "near-words"), [scope, "word"]).select(scope, F.col("id").alias("key"), "handle").join(held, [scope, "handle"])
    joined = tiers(runs, named, slipped).where("lo = hi")
    one_word = joined.select(scope, F.concat(F.lit("o "), "key").alias("a"), F.concat(F.lit("o "), "lo").alias("b"))
    # acronyms
    short = facts.where("kind = 'A'").select(scope, "name", F.col("a").alias("short"))
    acronyms = short.select(scope, F.concat(F.lit("A "), "short").alias("handle")).distinct().join(held, [scope, "handle"]).where("lo = hi")
    # domains: head word and the beginning of another word, else a near head and three letters of it
    domain = facts.where("kind = 'D'").select(scope, "name", F.col("a").alias("head"), F.col("b").alias("tail"))
    wanted_domains = domain.select(scope, "head", "tail").distinct().withColumn("key", F.concat(F.lit("D "), "head", F.lit(" "), "tail"))
    by_name = wanted_domains.select(scope, "key", F.col("key").alias("handle")).join(held, [scope, "handle"])
    near_heads = segment_join(wanted_domains.select(scope, F.col("head").alias("id"), F.col("head").alias("s")).distinct(), heads, scope, 1).where(_near("left", "right")).select(scope, F.col("left").alias("head"), "right")
    by_near = wanted_domains.join(materialize(near_heads, "near-heads"), [scope, "head"]).select(scope, "key", F.concat(F.lit("E "), "right", F.lit(" "), F.substring("tail", 1, 3)).alias("handle")).join(held, [scope, "handle"])
    domains = materialize(tiers(by_name, by_near).where("lo = hi"), "domains")
    labels = (
        o.join(placed.select(scope, F.col("id").alias("org"), "entity"), [scope, "org"], "left").select(scope, "name", F.concat(F.lit("o "), F.coalesce("entity", "org")).alias("label"))
        .unionByName(short.select(scope, "name", F.concat(F.lit("A "), "short").alias("label")))
        .unionByName(domain.select(scope, "name", F.concat(F.lit("D "), "head", F.lit(" "), "tail").alias("label")))
    )
    ties = one_word.unionByName(acronyms.select(scope, F.col("handle").alias("a"), F.concat(F.lit("o "), "lo").alias("b"))).unionByName(domains.select(scope, F.col("key").alias("a"), F.concat(F.lit("o "), "lo").alias("b")))
    return materialize(labels, "organisation-labels"), materialize(ties, "organisation-ties")


def link_names(names: DataFrame, scope: str = "mailbox_id") -> DataFrame:
    """(scope, entity, name): the entity of each spelling; one that fits no other is its own."""
    # as many partitions as the session shuffles into: parsing costs far more than its bytes tell
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = materialize(
        names.select(scope, "name", "org_votes", "person_votes").repartition(parts, scope, "name").select(scope, "name", F.explode_outer(_facts("name", "org_votes", "person_votes")).alias("x")).select(scope, "name", "x.*"), "name-facts"
    )
    spelled = materialize(person_spellings(facts, scope), "whole-names")
    people = materialize(person_entities(spelled, facts, scope), "name-entities")
    own = spelled.join(people.select(scope, "g", "f", "entity"), [scope, "g", "f"]).select(scope, "name", "entity").distinct()
    orgs, ties = organisations(facts, scope)
    labels = materialize(own.select(scope, "name", F.concat(F.lit("p "), "entity").alias("label")).unionByName(incomplete_persons(facts, people, own, scope)).unionByName(orgs).distinct(), "name-to-label")
    # a string with several labels ties them
    least = labels.groupBy(scope, "name").agg(F.min("label").alias("a"))
    tied = labels.join(least, [scope, "name"]).where("label <> a").select(scope, "a", F.col("label").alias("b")).unionByName(ties)
    whole = connected(tied, scope).select(scope, F.col("id").alias("a"), "label")
    return (
        names.select(scope, "name").distinct()
        .join(least, [scope, "name"], "left")
        .join(whole, [scope, "a"], "left")
        .select(scope, F.coalesce("label", "a", F.concat(F.lit("n "), "name")).alias("entity"), "name")
    )


def linked_pairs(linked: DataFrame, scope: str = "mailbox_id") -> DataFrame:
    """(scope, name_a, name_b): every two spellings of one entity, name_a < name_b by code point."""
    many = linked.groupBy(scope, "entity").agg(F.sort_array(F.collect_set("name")).alias("ns")).where("size(ns) > 1")
    return (
        many.select(scope, F.posexplode("ns").alias("i", "name_a"), "ns")
        .select(scope, "name_a", F.explode(F.slice("ns", F.col("i") + 2, F.size("ns"))).alias("name_b"))
        .distinct()
    )


def canonical_names(linked: DataFrame, names: DataFrame, scope: str = "mailbox_id") -> DataFrame:
    """(scope, name, canonical_name): the most mentioned full spelling of the name's entity."""
    votes = F.col("org_votes") + F.col("person_votes")
    scored = linked.join(names, [scope, "name"]).withColumn(
        "rank", F.struct((~F.col("name").contains("@")).cast("int"), votes, F.length("name"), "name")
    )
    best = scored.groupBy(scope, "entity").agg(F.max_by("name", "rank").alias("canonical_name"))
    return linked.join(best, [scope, "entity"]).select(scope, "name", "canonical_name")
