"""Repair of text from scanned pages, by a noisy channel.

1. Furniture: the first and last lines of each page are reduced to a skeleton in which
   characters that scanners confuse are one, and digits are one. A skeleton that stands
   at the edge of several pages of a document, a page number, a stamp, or the document's
   title above a later page is furniture. The title as heading of the first page is text.
2. Broken words: a text line that ends in a letter and a hyphen is joined with the next
   text line of the document, over furniture and page ends. The corpus decides whether
   the word keeps the hyphen, and a misread half is corrected in the whole.
3. Misread words: word and word-pair counts over the whole corpus (clean and scanned
   pages) are the language model; the channel is a table of character confusions, whose
   probabilities are estimated from the words that have one reading only. Every word has
   a stroke key that no confusion of the table changes, so the candidates of a doubtful
   word, with any number of confusions and of any length, are the known words of its key,
   verified by an alignment. Viterbi decodes each line over the candidates of its words.
   Numbers with letter shapes need no counts.

Counts, candidates and decoding are joins and aggregations; nothing is collected.

Defined results
  * pages with ocr_used false are corpus, never repaired; null ocr_used is scanned
  * null and blank pages have no lines to repair, but stand in the page order
  * a broken word without a next text line, or before a line that doesn't start with a
    lower-case letter, is left as it is
  * the next text line is looked for on the page, on the page of the next number and,
    where that has no text, on the one after; pages of one number are ordered by key
  * repeated words of a line give one row
  * a null attachment_id is a document of its own for each page
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.window import Window

from threadloom.runtime import materialize, spread

# What is read -> what may be printed. Hard: no word has the left side inside.
HARD = {"0": ("o", "O"), "1": ("l", "i", "I"), "5": ("s", "S"), "6": ("b", "G"), "8": ("B", "g"), "9": ("g", "q"), "@": ("a",), "+": ("t",), "$": ("s",), "|": ("l", "I"), "€": ("e",), "!": ("l", "i"),
        "í": ("i", "í"), "ì": ("i",), "ﬁ": ("fi",), "ﬂ": ("fl",), "ﬀ": ("ff",)}
SOFT = {"c": ("e",), "e": ("c",), "b": ("h",), "h": ("b", "li"), "I": ("l",), "l": ("I", "i", "t"), "i": ("l",), "rn": ("m",), "m": ("rn",), "cl": ("d",), "d": ("cl",), "ri": ("n",), "n": ("ri",), "ii": ("u", "n"), "u": ("ii",),
        "vv": ("w",), "w": ("vv",), "li": ("h",), "f": ("t",), "t": ("f",), "O": ("Q",), "o": ("c",), "S": ("5",), "B": ("8",), "iii": ("ui", "iu", "ni", "in"), "in": ("m",), "ni": ("m",)}
# Letters that stand for digits in numbers.
DIGITS = str.maketrans({"O": "0", "o": "0", "Q": "0", "D": "0", "I": "1", "l": "1", "i": "1", "|": "1", "!": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "$": "5", "b": "6", "G": "6", "T": "7", "B": "8", "g": "9", "q": "9", "í": "1"})

HYPHENS = "-‐‑¬­"
_STRIP = " \t\r.,;:!?()[]{}\"'“”‘’„«»…"
_ONE = str.maketrans({"0": "o", "1": "l", "i": "l", "í": "l", "ì": "l", "|": "l", "!": "l", "5": "s", "$": "s", "8": "b", "6": "b", "h": "b", "9": "g", "q": "g", "@": "a", "+": "t", "f": "t", "c": "e", "u": "n"})
_MERGE = (("ﬁ", "tl"), ("ﬂ", "tl"), ("rn", "m"), ("rl", "n"), ("el", "d"), ("ll", "n"), ("vv", "w"))


def skeleton(text: str) -> str:
    """A line with confusable shapes made one: readings of one print have one skeleton."""
    s = re.sub(r"\s+", " ", text.strip().lower()).translate(_ONE)
    before = None
    while s != before:
        before = s
        for a, b in _MERGE:
            s = s.replace(a, b)
    return s


def _number(text: str) -> int | None:
    """Value of a number whose digits may be read as letters; None for other text."""
    t = text.translate(DIGITS)
    return int(t) if re.fullmatch(r"[0-9]{1,9}", t) else None


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out += sign
            n -= value
    return out


_PAGE_WORDS = {skeleton(w) for w in ("page", "seite", "p", "pag", "página", "pagina", "blz", "pg")}
_OF_WORDS = {skeleton(w) for w in ("of", "von", "de", "van", "di", "sur")}


def page_number(line: str, page_no: int | None) -> bool:
    """A line that is nothing but a page number: "Page 3 of 5", "p. 3/5", "- 3 -", "iii"."""
    if len(line) > 26:
        return False
    parts = [p for p in re.split(r"[\s/.,\[\]()–—_-]+", line) if p]
    shape, first = "", None
    for p in parts:
        if page_no is not None and 0 < page_no < 4000 and skeleton(p) == skeleton(roman(page_no)):
            n = page_no
        else:
            n = _number(p)
        bare = skeleton(p)
        if bare in _PAGE_WORDS and not shape and len(parts) > 1:
            shape += "P"
        elif bare in _OF_WORDS and shape and len(parts) > 2:
            shape += "O"
        elif n is not None:
            first = n if first is None else first
            shape += "N"
        else:
            return False
    return bool(re.fullmatch(r"P?N(?:O?N)?", shape)) and ("P" in shape or "O" in shape or (page_no is not None and first == page_no))


_STAMP = re.compile(r"^\s*(?:scan\w*|received|eingang|eingegangen|re[çc]u|recibido|ontvangen)\b.{0,12}\d[\dOolISB]{1,3}[-./]\S+", re.I)
_REFERENCE = re.compile(r"^\s*(?:ref|rcf|rel)\W{1,3}[\w/.-]*\d[\w/.-]*\s*$", re.I)


def edge_lines(text: str | None, page_no: int | None, filename: str | None) -> list[dict]:
    """Lines at the top and bottom of a page that may be furniture."""
    if not text or not text.strip():
        return []
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    top, bottom = filled[:4], filled[-3:]
    stem, ending = re.sub(r"[_\-\s]+", " ", re.sub(r"\.(\w{2,4})$", "", filename or "")), re.search(r"\.\w{2,4}$", filename or "")
    title = skeleton(stem)
    number = skeleton(str(page_no)) if page_no is not None else None
    out = []
    for i in sorted(set(top) | set(bottom)):
        line = lines[i].strip()
        bare = skeleton(line)
        numbered = bool(re.match(r"^\w{1,3}\.\s", line))  # "2. Invoice" heads a section
        file = bool(ending) and bool(title) and re.search(r"\.\w{2,4}$", line) and skeleton(re.sub(r"[_\-\s]+", " ", re.sub(r"\.\w{2,4}$", "", line))) == title
        sure = page_number(line, page_no) or bool(_STAMP.match(line)) or bool(_REFERENCE.match(line)) or bool(file)
        rest = bare[len(title) :].strip() if title and bare.startswith(title) else None
        if rest is None and title and re.sub(r"[^\w\s].*$", "", line).strip() and bare.split(" l ")[0].strip() == title:
            rest = "l"
        titled = rest is not None and (rest == "" or rest == number or (len(rest) < 40 and rest[:2] in ("l ", "- ", "– ")))
        if number and not numbered:  # the page's own number inside a running line
            bare = " ".join("\x01" if w == number else w for w in bare.split(" "))
        out.append(
            {
                "line_no": i,
                "skeleton": bare,
                "sure": sure,
                "titled": bool(titled),
                "heading": rest == "",
                "sentence": bool(re.search(r"[.?!;,:]\s*$", line) or numbered or re.match(r"^(?:section|chapter|part|abschnitt|kapitel|section|sección|hoofdstuk)\b", line, re.I)) and not sure,
                "letters": sum(c.isalnum() for c in line),
            }
        )
    return out


_EDGE = ArrayType(
    StructType().add("line_no", IntegerType()).add("skeleton", StringType()).add("sure", BooleanType()).add("titled", BooleanType()).add("heading", BooleanType()).add("sentence", BooleanType()).add("letters", IntegerType())
)


@F.pandas_udf(_EDGE)
def _edges(text: pd.Series, page_no: pd.Series, filename: pd.Series) -> pd.Series:
    return pd.Series([edge_lines(t, None if pd.isna(p) else int(p), f) for t, p, f in zip(text, page_no, filename)])


def numbered_pages(pages: DataFrame) -> DataFrame:
    """Pages with a document key that is never null."""
    return pages.select(
        "page_key",
        F.coalesce("attachment_id", F.concat(F.lit("page-"), F.col("page_key").cast("string"))).alias("document"),
        "page_no",
        "filename",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("ocr_used", F.lit(True)).alias("scanned"),
    )


def furniture(pages: DataFrame) -> DataFrame:
    """(page_key, line_no) of running headers and footers, page numbers and stamps."""
    edge = materialize(
        pages.where("scanned").select("page_key", "document", "page_no", F.explode(_edges("text", "page_no", "filename")).alias("e")).select(
            "page_key", "document", "page_no", "e.*"
        ),
        "page-edges",
    )
    recurring = (
        edge.where("not sentence and letters >= 3").groupBy("document", "skeleton").agg(F.count_distinct("page_key").alias("n")).where("n >= 2").select("document", "skeleton", F.lit(True).alias("recurs"))
    )
    # a line around the page's own number that many documents have is running text of the scanner
    common = (
        edge.where("not sentence and letters >= 3 and skeleton like '%\x01%'").groupBy("skeleton").agg(F.count_distinct("document").alias("n")).where("n >= 3").select("skeleton", F.lit(True).alias("common"))
    )
    on_page = Window.partitionBy("page_key", "heading").orderBy("line_no")
    return (
        edge.join(recurring, ["document", "skeleton"], "left")
        .join(common, "skeleton", "left")
        .withColumn("copies", F.count("*").over(Window.partitionBy("page_key", "heading")))
        .withColumn("place", F.row_number().over(on_page))
        .where(
            F.when(F.col("heading") & (F.col("page_no") == 1), (F.col("copies") > 1) & (F.col("place") < F.col("copies")))
            .otherwise(F.col("sure") | F.col("titled") | (F.coalesce("recurs", "common", F.lit(False)) & ~F.col("sentence")))
        )
        .select("page_key", "line_no")
    )


def text_lines(pages: DataFrame, furnished: DataFrame) -> DataFrame:
    """(page_key, document, page_no, scanned, line_no, line, broken, head, tail, whole_next) of text lines.

    head: the broken beginning at the line's end; tail: its rest, the first word of the
    next text line; continued: the line starts with the rest of the line before.
    The next line may stand any number of pages without text, or missing pages, further on;
    pages without a number have no order, so nothing is joined over their ends.
    """
    lines = pages.select("page_key", "document", "page_no", "scanned", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.join(furnished.withColumn("is_furniture", F.lit(True)), ["page_key", "line_no"], "left").where("is_furniture is null").drop("is_furniture")
    lines = (
        lines.withColumn("line", F.rtrim(F.regexp_replace("line", "\r", "")))
        .where("trim(line) <> ''")
        .where(F.col("line").rlike(r"\p{L}|\p{N}") | ~F.col("scanned"))
    )
    # neighbours within the page by a window; over the page end by a window over the document's
    # pages that have text, a row each: no group is larger than a page's lines or a document's pages
    on_page = Window.partitionBy("page_key").orderBy("line_no")
    lines = lines.withColumn("next", F.lead("line").over(on_page)).withColumn("before", F.lag("line").over(on_page))
    ends = (
        lines.where("page_no is not null")
        .groupBy("document", "page_no")
        .agg(F.min_by("line", F.struct("page_key", "line_no")).alias("first"), F.max_by("line", F.struct("page_key", "line_no")).alias("last"))
    )
    by_number = Window.partitionBy("document").orderBy("page_no")
    around = ends.select("document", "page_no", F.lead("first").over(by_number).alias("next_page"), F.lag("last").over(by_number).alias("page_before"))

    def head(c: str):
        return F.regexp_extract(c, rf"([\p{{L}}@+0-9|\p{{M}}'’-]*[\p{{L}}@+0159])[{HYPHENS}]$", 1)

    def tail(c: str):
        return F.regexp_extract(c, r"^\s*([\p{Ll}@+0-9íIﬁﬂ][^\s]*)", 1)

    return (
        lines.join(around, ["document", "page_no"], "left")
        .withColumn("next", F.coalesce("next", "next_page"))
        .withColumn("before", F.coalesce("before", "page_before"))
        .withColumn("starts", F.coalesce(F.col("before").rlike(r"[.?!:][\"'”’)]*\s*$"), F.lit(True)))
        .withColumn("head", F.when(F.col("scanned"), head("line")).otherwise(""))
        .withColumn("hyphen", F.substring("line", -1, 1))
        .withColumn("tail", F.when(F.col("head") != "", F.coalesce(tail("next"), F.lit(""))).otherwise(""))
        .withColumn("broken", (F.col("head") != "") & (F.col("tail") != ""))
        .withColumn("continued", F.col("scanned") & F.coalesce((head("before") != "") & (tail("line") != ""), F.lit(False)))
        .drop("next", "before", "next_page", "page_before")
    )


#: a hard sign costs this much, a first and a further soft confusion of mean frequency that much
HARD_COST, FIRST_COST, NEXT_COST = 0.1, 0.7, 1.7
#: letters above which each confusion counts for less
SHARED_LENGTH = 10
#: weight of the estimated log probabilities against the word counts
TEMPER = 0.25

# Strokes each character consists of, as far as scanners tell; closed under HARD and SOFT.
_STROKES = {"e": "e0oc€q", "l": "l1i|!íìtf+r", "s": "s5$", "a": "a@", "2": "nuhb6g89ﬁﬂﬀ", "3": "m", "4": "d", "5": "w"}
_WIDE = (("2", "ll"), ("3", "lll"), ("4", "el"), ("5", "vv"))


def stroke_keys(word: Column) -> Column:
    """Keys that no confusion of the table changes: one, or two where q may be read as 9 or as O."""
    low = F.lower(word)
    one = "".join(chars for chars in _STROKES.values())
    to = "".join(k * len(chars) for k, chars in _STROKES.items())

    def key(text: Column) -> Column:
        out = F.translate(text, one, to)
        for short, long in _WIDE:
            out = F.replace(out, F.lit(short), F.lit(long))
        return out

    return F.array_distinct(F.array(key(low), key(F.translate(low, "q", "g"))))


def alignment(token: str, word: str, cost: dict[tuple[str, str], float] | None = None) -> tuple[float, list[tuple[str, str]]] | None:
    """(channel log probability, soft confusions) of reading ``word`` as ``token``; None if it can't be."""
    n, m, far = len(token), len(word), 1e9
    best = [[far] * (m + 1) for _ in range(n + 1)]
    back: list[list] = [[None] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for i in range(n):
        row = best[i]
        soft = [(o, ts) for o, ts in SOFT.items() if token.startswith(o, i)]
        hard = HARD.get(token[i], ())
        for j in range(m + 1):
            at = row[j]
            if at >= far:
                continue
            moves = [(1, 1, at, None)] if j < m and token[i] == word[j] else []
            moves += [(1, len(t), at + HARD_COST, None) for t in hard if word.startswith(t, j)]
            moves += [(len(o), len(t), at + (NEXT_COST - FIRST_COST) + (cost.get((o, t), FIRST_COST) if cost else FIRST_COST), (o, t)) for o, ts in soft for t in ts if word.startswith(t, j)]
            for di, dj, c, slip in moves:
                if c < best[i + di][j + dj]:
                    best[i + di][j + dj] = c
                    back[i + di][j + dj] = (i, j, slip)
    if best[n][m] >= far:
        return None
    slips, i, j = [], n, m
    while i or j:
        i, j, slip = back[i][j]
        if slip:
            slips.append(slip)
    return (NEXT_COST - FIRST_COST if slips else 0.0) - best[n][m], slips


def cased(low: str) -> list[str]:
    """A lower-case word in lower, Title and UPPER case, each part of a compound by itself."""
    out = [""]
    for p in re.split(r"([-'’&/])", low):
        out = [x + y for x in out for y in dict.fromkeys((p, p[:1].upper() + p[1:]))]
    return list(dict.fromkeys([*out, low.upper()]))


def reading(token: str, low: str, cost: dict[tuple[str, str], float] | None = None) -> tuple[str, float, list] | None:
    """(word, channel, confusions): the case of a known word in which it most likely was read as ``token``."""
    best = None
    for w in cased(low):
        found = alignment(token, w, cost) if w != token else None
        if found:
            # the longer the word, the less another one shares its strokes by chance
            found = (found[0] * min(1.0, SHARED_LENGTH / len(w)), found[1])
            if best is None or found[0] > best[1]:
                best = (w, *found)
    return best


def repaired_number(token: str) -> str | None:
    """The number a token was printed as, if it has a digit and else only digit shapes."""
    if not re.search(r"\d", token) or re.fullmatch(r"[\d.,:/%-]+", token) or not re.fullmatch(r"[\dOoQDIli|!ZzSs$bGTBgqí.,:/-]+", token):
        return None
    if re.search(r"[A-Za-z]{3}", token):
        return None
    letters = sum(c.isalpha() or c in "|!$" for c in token)
    digits = sum(c.isdigit() for c in token)
    fixed = token.translate(DIGITS)
    return fixed if digits >= letters or (digits and re.search(r"[.,:/]", token)) else None


def regular(token: str) -> bool:
    """Lower, Title or UPPER case, also in the parts of a compound."""
    return all(p.islower() or p.isupper() or (p[:1].isupper() and (p[1:].islower() or len(p) == 1)) for p in re.split(r"[-'’&/]", token) if p)


_SLIPS = ArrayType(StructType().add("o", StringType()).add("t", StringType()))


@F.pandas_udf(_SLIPS)
def _slips(token: pd.Series, low: pd.Series) -> pd.Series:
    found = (reading(t, w) for t, w in zip(token, low))
    return pd.Series([[{"o": o, "t": p} for o, p in f[2]] if f else [] for f in found], dtype=object)


def _reader(costs: dict[tuple[str, str], float]):
    @F.pandas_udf(StructType().add("word", StringType()).add("channel", DoubleType()))
    def read(token: pd.Series, low: pd.Series) -> pd.DataFrame:
        found = [reading(t, w, costs) for t, w in zip(token, low)]
        return pd.DataFrame({"word": [f[0] if f else None for f in found], "channel": [f[1] if f else None for f in found]})

    return read


@F.pandas_udf(StringType())
def _number_of(token: pd.Series) -> pd.Series:
    return token.map(repaired_number)


@F.pandas_udf(BooleanType())
def _regular(token: pd.Series) -> pd.Series:
    return token.map(regular).astype(bool)


def _token(column):
    return F.btrim(column, F.lit(_STRIP))


def tokens(lines: DataFrame) -> DataFrame:
    """(page_key, line_no, pos, token, scanned, half, starts) of every word.

    half: part of a broken word; starts: a sentence may start with it.
    """
    return (
        lines.select("page_key", "line_no", "scanned", "broken", "continued", "starts", F.split(F.trim("line"), r"\s+").alias("ws"))
        .select("page_key", "line_no", "scanned", "broken", "continued", "starts", "ws", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "w"))
        .withColumn("starts", F.when(F.col("pos") == 0, F.col("starts")).otherwise(F.right(F.rtrim(F.get("ws", F.col("pos") - 1), F.lit("\"'”’)")), F.lit(1)).isin(".", "?", "!")))
        .withColumn("token", _token("w"))
        .withColumn("half", (F.col("broken") & (F.col("pos") == F.col("n") - 1)) | (F.col("continued") & (F.col("pos") == 0)))
        .where("token <> ''")
        .select("page_key", "line_no", "scanned", "pos", "token", "half", "starts")
    )


class Repair:
    """All steps over one table of pages; each property is written once and read by the next."""

    def __init__(self, pages: DataFrame):
        self.pages = materialize(numbered_pages(spread(pages)), "pages")
        self.furniture = materialize(furniture(self.pages), "furniture")
        self.lines = materialize(text_lines(self.pages, self.furniture), "text-lines")
        self.tokens = materialize(tokens(self.lines), "page-words")
        whole = self.tokens.where("not half")
        # unigram counts; a word that only scans have may be a misreading
        self.words = materialize(
            whole.select("token", "scanned", (F.col("token") == F.lower("token")).alias("lower"))
            .unionByName(self._file_words())
            .groupBy(F.lower("token").alias("word"))
            .agg(F.count_if(~F.col("scanned")).alias("clean"), F.count_if(F.col("scanned")).alias("scans"), F.max("lower").alias("lower")),
            "words",
        )
        after = Window.partitionBy("page_key", "line_no").orderBy("pos")
        linked = whole.withColumn("second", F.lead("token").over(after)).where("second is not null")
        self.pairs = materialize(
            linked.groupBy(F.lower("token").alias("first"), F.lower("second").alias("second")).agg(F.count("*").alias("n")), "word-pairs"
        )
        self.candidates = materialize(self._candidates(), "word-candidates")

    def _file_words(self) -> DataFrame:
        """Words of file names, once a document: they are typed, not scanned."""
        name = F.regexp_replace(F.regexp_replace("filename", r"\.\w{2,4}$", ""), r"[_\-.]+", " ")
        return (
            self.pages.select("document", name.alias("name")).distinct().select(F.explode(F.split("name", r"\s+")).alias("token"))
            .where(F.col("token").rlike(r"^\p{L}{3,}$"))
            .select("token", F.lit(False).alias("scanned"), F.lit(False).alias("lower"))
        )

    def _keyed_words(self) -> DataFrame:
        """(key, low, clean, scans, n, lower): the known words by stroke key."""
        return self.words.select(
            F.explode(stroke_keys(F.col("word"))).alias("key"), F.col("word").alias("low"), "clean", "scans", (F.col("clean") + F.col("scans")).alias("n"), F.coalesce("lower", F.lit(False)).alias("lower")
        )

    def _costs(self, matched: DataFrame) -> dict[tuple[str, str], float]:
        """Cost of each soft confusion, from how often the words with one reading show it.

        A row a confusion of the fixed table comes to the driver, no more.
        """
        clear = matched.where("clean > 0 and n >= 4 * own").groupBy("token").agg(F.min("low").alias("low"), F.max("low").alias("other"), F.max("own").alias("own")).where("low = other")
        seen = clear.select("own", F.explode(_slips("token", "low")).alias("s")).groupBy("s.o", "s.t").agg(F.sum("own").alias("n")).collect()
        pairs = [(o, t) for o, ts in SOFT.items() for t in ts]
        times = dict.fromkeys(pairs, 1.0)
        for r in seen:
            times[r["o"], r["t"]] += r["n"]
        mean = sum(math.log(n) for n in times.values()) / len(pairs)
        return {p: max(0.2, FIRST_COST - TEMPER * (math.log(n) - mean)) for p, n in times.items()}

    def _candidates(self) -> DataFrame:
        """(token, cands array<word, score>): readings of each distinct doubtful word."""
        known = self.words.where("clean > 0").select(F.col("word").alias("low"), F.lit(True).alias("known"))
        doubtful = materialize(
            self.tokens.where("scanned and not half")
            .groupBy("token")
            .agg(F.count("*").alias("own"))
            .withColumn("low", F.lower("token"))
            .join(known, "low", "left")
            .where(F.col("known").isNull() | ~_regular("token"))
            .where(F.col("token").rlike(r"\p{L}|[@+]"))
            .select("token", "own"),
            "doubtful-words",
        )
        matched = materialize(
            doubtful.withColumn("key", F.explode(stroke_keys(F.col("token"))))
            .join(self._keyed_words(), "key")
            .select("token", "own", "low", "clean", "n", "lower")
            .distinct()
            # a reading must be far more frequent than the doubtful form, unless the form is no word at all
            .where((F.col("n") >= 4 * F.col("own")) | ((F.col("clean") > 0) & (F.col("n") >= F.col("own"))) | F.col("token").rlike(r"[@+0-9|€$íìﬁﬂ!]|\p{Ll}[I]")),
            "matched-words",
        )
        self.costs = self._costs(matched)
        read = matched.withColumn("r", _reader(self.costs)("token", "low")).where("r.word is not null").select("token", "own", "r.word", "r.channel", "n", "lower")
        numbers = doubtful.select("token", "own", _number_of("token").alias("word")).where("word is not null and word <> token")
        counts = self.words.select(F.col("word").alias("low"), (F.col("clean") + F.col("scans")).alias("n"))
        numbered = numbers.join(counts, F.lower("word") == F.col("low"), "left").select(
            "token", "own", "word", F.lit(5.0).alias("channel"), F.coalesce("n", F.lit(0)).alias("n"), F.lit(False).alias("lower")
        )
        return (
            read.unionByName(numbered)
            .groupBy("token")
            .agg(F.sort_array(F.collect_list(F.struct((-F.log1p("n") - F.col("channel")).alias("cost"), "word", "channel", "n", "lower"))).alias("cands"), F.max("own").alias("own"))
        )

    def misread(self) -> DataFrame:
        """(page_key, line_no, pos, token, word): words that Viterbi reads otherwise."""
        scanned = self.tokens.where("scanned and not half")
        chosen = scanned.join(self.candidates, "token")
        lines = chosen.select("page_key", "line_no").distinct()
        cands = self.candidates.schema["cands"].dataType
        sentence = (
            scanned.join(lines, ["page_key", "line_no"], "left_semi")
            .join(self.candidates, "token", "left")
            .groupBy("page_key", "line_no")
            .agg(F.sort_array(F.collect_list(F.struct("pos", "token", "starts", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("cands", F.array().cast(cands)).alias("cands")))).alias("ws"))
        )
        sentence = materialize(sentence, "doubtful-lines")
        readings = lambda w: F.concat(F.array(F.lower(w["token"])), F.transform(w["cands"], lambda c: F.lower(c["word"])))
        spot = F.explode(F.sequence(F.lit(1), F.size("ws") - 1))
        wanted = (
            sentence.where("size(ws) > 1")
            .select("page_key", "line_no", "ws", spot.alias("i"))
            .select("page_key", "line_no", F.element_at("ws", F.col("i")).alias("a"), F.element_at("ws", F.col("i") + 1).alias("b"))
            .where((F.size("a.cands") > 0) | (F.size("b.cands") > 0))
            .select("page_key", "line_no", F.explode(readings(F.col("a"))).alias("first"), "b")
            .select("page_key", "line_no", "first", F.explode(readings(F.col("b"))).alias("second"))
            .join(self.pairs, ["first", "second"])
            .groupBy("page_key", "line_no")
            .agg(F.collect_set(F.struct("first", "second", "n")).alias("ps"))
        )
        decoded = sentence.join(wanted, ["page_key", "line_no"], "left").select("page_key", "line_no", "ws", _viterbi("ws", "ps").alias("out"))
        return (
            decoded.select("page_key", "line_no", F.explode(F.arrays_zip("ws", "out")).alias("z"))
            .select("page_key", "line_no", "z.ws.pos", "z.ws.token", F.col("z.out").alias("word"))
            .where("word <> token")
        )

    def broken(self) -> DataFrame:
        """(page_key, line_no, head, hyphen, tail, word): whole words of broken lines."""
        parts = self.lines.where("broken").select("page_key", "line_no", "head", "hyphen", _token("tail").alias("tail")).where("tail <> ''")
        joined = parts.select("head", "hyphen", "tail").distinct()
        plain = F.struct(F.concat("head", "tail").alias("whole"), F.lit(0.0).alias("base"))
        dashed = F.struct(F.concat("head", F.lit("-"), "tail").alias("whole"), F.lit(-0.5).alias("base"))
        forms = joined.select("head", "hyphen", "tail", F.explode(F.when(F.col("hyphen").isin(*"-‐‑"), F.array(plain, dashed)).otherwise(F.array(plain))).alias("f")).select("head", "hyphen", "tail", "f.*")
        counts = self.words.select(F.col("word").alias("low"), (F.col("clean") * 20 + F.col("scans")).alias("n"))
        as_read = forms.join(counts, F.lower("whole") == F.col("low"), "left").select(
            "head", "hyphen", "tail", F.col("whole").alias("word"), F.when(F.col("n").isNotNull(), F.log1p("n") + F.col("base")).otherwise(F.col("base") - 6).alias("score")
        )
        keyed = self._keyed_words().select("key", "low", (F.col("clean") * 20 + F.col("scans")).alias("n"))
        repaired = (
            forms.withColumn("key", F.explode(stroke_keys(F.col("whole"))))
            .join(keyed, "key")
            .withColumn("r", _reader(self.costs)("whole", "low"))
            .where("r.word is not null")
            .select("head", "hyphen", "tail", "r.word", (F.log1p("n") + F.col("base") + F.col("r.channel") - 3).alias("score"))
        )
        best = (
            as_read.unionByName(repaired)
            .groupBy("head", "hyphen", "tail")
            .agg(F.max_by("word", F.struct("score", "word")).alias("word"))
        )
        return parts.join(best, ["head", "hyphen", "tail"])

    def found(self) -> DataFrame:
        """(page_key, line_no, kind, repaired) of everything that is repaired."""
        kind = lambda df, k, word: df.select("page_key", F.col("line_no").cast("int").alias("line_no"), F.lit(k).alias("kind"), word.alias("repaired"))
        return (
            kind(self.furniture, "furniture", F.lit(""))
            .unionByName(kind(self.broken(), "hyphen", F.col("word")))
            .unionByName(kind(self.misread(), "misread", F.col("word")).distinct())
        )

    def text(self) -> DataFrame:
        """(page_key, paragraph, text): repaired paragraphs of the scanned pages."""
        fixes = self.misread().groupBy("page_key", "line_no").agg(F.map_from_entries(F.collect_set(F.struct("pos", F.struct("token", "word")))).alias("fixes"))
        whole = self.broken().select("page_key", "line_no", F.col("word").alias("whole"))
        raw = self.pages.where("scanned").select("page_key", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
        return (
            raw.join(self.furniture.withColumn("gone", F.lit(True)), ["page_key", "line_no"], "left")
            .where("gone is null")
            .join(self.lines.select("page_key", "line_no", "continued", "broken"), ["page_key", "line_no"], "left")
            .join(fixes, ["page_key", "line_no"], "left")
            .join(whole, ["page_key", "line_no"], "left")
            .withColumn("text", _repaired("raw", "fixes", "whole", "continued"))
            .withColumn("blank", (F.trim("raw") == "").cast("int"))
            .withColumn("paragraph", F.sum("blank").over(Window.partitionBy("page_key").orderBy("line_no")).cast("int"))
            .where("blank = 0 and text <> ''")
            .groupBy("page_key", "paragraph")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text"))
        )


@F.pandas_udf(ArrayType(StringType()))
def _viterbi(ws: pd.Series, ps: pd.Series) -> pd.Series:
    return pd.Series([decode_line(list(w), list(p) if p is not None else []) for w, p in zip(ws, ps)])


def decode_line(ws: list[dict], pairs: list[dict]) -> list[str]:
    """Most probable printed words of one line."""
    n = {(p["first"], p["second"]): p["n"] for p in pairs}
    states: list[list[tuple[str, float]]] = []
    for w in ws:
        cands = w["cands"] if w["cands"] is not None else []
        own = [(w["token"], math.log1p(0.1 * w["own"]) if len(cands) else 0.0)]
        states.append(own + [(c["word"], math.log1p(c["n"]) + c["channel"]) for c in cands])
    best = [(s, None) for _, s in states[0]]
    back: list[list[tuple[float, int | None]]] = [best]
    for a, b in zip(states, states[1:]):
        row = []
        for word, s in b:
            options = [
                back[-1][i][0] + (1.5 * math.log1p(n.get((u.lower(), word.lower()), 0)) if len(a) > 1 or len(b) > 1 else 0.0) for i, (u, _) in enumerate(a)
            ]
            i = max(range(len(options)), key=lambda x: (options[x], -x))
            row.append((options[i] + s, i))
        back.append(row)
    j = max(range(len(back[-1])), key=lambda x: (back[-1][x][0], -x))
    out = []
    for t in range(len(states) - 1, -1, -1):
        word = states[t][j][0]
        if j and ws[t]["token"][:1] in HARD:  # the sign tells nothing about the case
            word = _cased(word, ws[t]["starts"], any(c["word"].lower() == word.lower() and c["lower"] for c in ws[t]["cands"]))
        out.append(word)
        j = back[t][j][1]
    return out[::-1]


def _cased(word: str, starts: bool, seen_lower: bool) -> str:
    """Capital at a sentence start and in words that are never written small."""
    if not word[:1].isalpha() or (len(word) > 1 and word.isupper()):
        return word
    return word[0].lower() + word[1:] if seen_lower and not starts else word[0].upper() + word[1:]


@F.pandas_udf(StringType())
def _repaired(raw: pd.Series, fixes: pd.Series, whole: pd.Series, continued: pd.Series) -> pd.Series:
    out = []
    for line, fix, word, rest in zip(raw, fixes, whole, continued):
        parts = line.strip().split()
        for pos, f in (dict(fix) if fix is not None else {}).items():
            if pos < len(parts):
                parts[pos] = parts[pos].replace(f["token"], f["word"], 1)
        if word is not None and parts:
            head = parts[-1].rstrip(HYPHENS).lstrip(_STRIP)
            parts[-1] = parts[-1][: parts[-1].find(head)] + word if head else word
        if rest is True and parts:
            left = parts[0].rstrip(_STRIP)
            parts[0] = parts[0][len(left) :]
            if not parts[0]:
                parts.pop(0)
        out.append(" ".join(parts))
    return pd.Series(out)
