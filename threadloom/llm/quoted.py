"""Reducing e-mails to what their sender newly wrote.

1. Bodies are exploded into normalised units: sentences, with quote marks, mark-up, wraps
   and case undone, and the closing lines of each run of text.
2. Counts and first places by date over the units decide first. The messages of a thread are ranked
   by date; a sentence belongs to the first one that has it, and in every later one it is
   quoted. A closing line that recurs in several messages of a sender is
   signature. A sentence that several senders use, and that stands below their closings or
   above their text, is a notice.
3. What no window has seen before (the message quoted isn't in the thread, the sender
   wrote once) falls back on the forms of its lines: quote prefixes, quoting elements of
   HTML, introducing lines (also wrapped), header blocks and separators, closing formulas.
   An open quotation (introduced, without prefix) reaches to its last sentence of an
   earlier message.

Defined results
  * null or empty body: no lines, and empty segments
  * a null sender or date: form alone decides on closings, the date sorts last; a null
    mailbox is one of its own; a null thread looks its sentences up in the whole mailbox
  * repeated deliveries of one message (same message_id) are one message in the windows
  * CRLF counts as line end; offsets are line numbers of the split at "\n"
  * a run of text that consists of recurring lines only is left to the forms
  * extra columns are ignored
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.language import fold
from threadloom.runtime import materialize, spread

NEW, QUOTED, SIGNATURE, NOTICE = "new", "quoted", "signature", "notice"

_TAG = re.compile(r"</?(?:html|body|head|meta|title|style|p|div|br|hr|span|blockquote|small|b|i|u|em|strong|a|font|table|tbody|tr|td|th|ul|ol|li|pre|center|img|h[1-6])\b(?:\s[^<>]*|/?)>", re.I)
_OPENING = re.compile(r"<(/?)(div|blockquote|small|span|font|table|td)\b([^<>]*)>", re.I)
_HTML_QUOTE = re.compile(r"quot|history|cite|reply|forward|border-left", re.I)
_HTML_SIGN = re.compile(r"sig\b|sign|footer", re.I)
_PREFIX = re.compile(r"^\s{0,4}(?:[A-Z]{1,3})?>")
_MARKS = re.compile(r"^\s{0,4}[A-Z]{1,3}>[\s>|:\]]*|^[\s>|:\]*]+")
_SOFT_PREFIX = re.compile(r"^\s{0,3}([|:\]])(?:\s|$)")
_VERBS = r"(?:wrote|writes|schrieb|a [ée]crit|escribi[óo]|schreef|ha scritto|escreveu)"
_INTRO = re.compile(
    rf"^(?:(?:On|Am|Le|El|Op|Em|Il|Den)\b.{{4,240}}\b{_VERBS}\b.{{0,160}}:|.{{2,200}}\b{_VERBS} (?:on|am|le|el|op) .{{4,60}}:|.{{0,200}}<?[\w.+-]+@[\w.-]+>? {_VERBS}:"
    rf"|(?:Quoting|Zitat von|Citando a|Citation de) .{{2,160}}:|\d{{4}}-\d\d-\d\d \d\d:\d\d (?:[A-Z]{{2,5}}|[+-]\d{{4}}) .{{2,160}}:"
    r"|.{2,160} \[[^\[\]]*\d{1,2}:\d\d[^\[\]]*\]:|(?:Begin forwarded message|Anfang der weitergeleiteten Nachricht|D[ée]but du message (?:transf[ée]r[ée]|r[ée]exp[ée]di[ée])|Inicio del mensaje reenviado|Begin doorgestuurd bericht)\s?:)\s*$",
    re.I,
)
_BARE = ("begin", "anfan", "debut", "début", "inici", "quoti", "zitat", "citan", "citat")
_INTRO_START = re.compile(rf"^(?:(?:On|Am|Le|El|Op|Em|Il|Den)\b.*\d|\d{{4}}-\d\d-\d\d|Quoting\b|.*\b{_VERBS}\b.*\d|.*<[\w.+-]+@|[\"'\w]{{2,}}.{{0,60}}$)")
_SEPARATOR = re.compile(
    r"^\s*-{2,}\s*(?:original message|forwarded message|forwarded by\b.*|urspr[üu]ngliche nachricht|weitergeleitete nachricht|message d['’]origine|message transf[ée]r[ée]|mensaje original|mensaje reenviado|oorspronkelijk bericht|doorgestuurd bericht|messaggio originale|mensagem original)\s*-{2,}\s*$",
    re.I,
)
_FROM = re.compile(r"^\s*\*?(?:From|Von|De|Van|Da)\s?:\*?\s*\S", re.I)
_HEADER = re.compile(r"^\s*\*?(?:From|To|Cc|Bcc|Sent|Date|Subject|Reply-To|Von|An|Gesendet|Datum|Betreff|De|À|A|Envoy[ée]|Objet|Para|Enviado|Fecha|Asunto|Van|Aan|Verzonden|Onderwerp|Da|Inviato|Oggetto|Assunto)\s?:\*?(?:\s|$)", re.I)
_CUT = re.compile(r"^\s*(?:--|—|–|__{4,}|={4,}|~{4,}|\*\s\*\s\*|\*{3,}|-{3,})\s*$")
_CLOSING = re.compile(
    r"^\s*(?:(?:with )?(?:kind(?:est)?|best|warm(?:est)?|many)?\s*(?:regards|rgds|wishes|thanks|greetings)|best|cheers|thanks|thank you|thx|yours(?: \w+)?|sincerely|warmly|talk soon|all the best|take care|br|kr"
    r"|mit freundlichen gr[üu](?:ß|ss)en|mfg|(?:viele|beste|liebe|sch[öo]ne|herzliche)?\s*gr[üu](?:ß|ss)e|vg|lg|danke"
    r"|cordialement|bien [àa] (?:vous|toi)|salutations|bonne journ[ée]e|merci(?: d'avance)?|[àa] bient[ôo]t|bien cordialement"
    r"|(?:un )?saludos?|gracias(?: y saludos)?|atentamente|cordialmente|un abrazo|muchas gracias"
    r"|(?:met )?(?:vriendelijke|hartelijke)?\s*groet(?:en|jes)?|mvg|bedankt|alvast bedankt|tot snel"
    r"|cordiali saluti|grazie|saluti|atenciosamente|obrigad[oa]|abra[çc]os|cumprimentos)"
    r"(?:(?: (?:and|und|et|y|en)| for| to| from)? (?:have a \w+ \w+|regards|thanks|again|everyone|all|you|good week|schöne Woche|bonne semaine|best|greetings))*\s*[,.!–—-]*\s*$",
    re.I,
)
_HANDSET = re.compile(
    r"^\s*(?:sent (?:from|via|on) (?:my|the|a)\b|get the \w+ .*\bapp\b|typed on\b|von meine[mr]\b.*(?:gesendet|geschickt)|gesendet (?:von|mit)\b|von unterwegs gesendet|envoy[ée] (?:depuis|de) mon\b|enviado desde (?:mi|el)\b|verzonden (?:vanaf|met) mijn\b|inviato da(?:l mio)?\b|enviado do meu\b)",
    re.I,
)
# The words for "confidential" and "privileged" in the languages served, for notices no other sender has used.
_NOTICE = re.compile(r"\b(?:confidential(?:ity)?|privileged|vertraulich|confidentiel(?:le)?|confidencial|vertrouwelijk|riservat[oa]|disclaimer|unsubscribe)\b", re.I)


def _notice(text: str) -> bool:
    """Form of a notice: it speaks of the mail itself and of secrecy."""
    return bool(_NOTICE.search(text)) and bool(re.search(r"\b(?:e-?mail|mail|message|transmission|nachricht|bericht|mensaje|messaggio|mensagem|courriel|privileged)\b", text, re.I))


_GREETING = re.compile(r"^\s*(?:(?:hi|hello|dear|hey|good (?:morning|afternoon|day|evening)|hallo|guten (?:tag|morgen)|liebe[r]?|sehr geehrte[rs]?|bonjour|ch[èe]re?|salut|hola|buenos d[íi]as|estimad[oa]s?|querid[oa]s?|hoi|beste|dag|goedemorgen|ciao|buongiorno|ol[áa]|bom dia)\b[^.?!:]{0,40},?|[A-ZÀ-Þ][\w'’-]+(?: [A-ZÀ-Þ][\w'’-]+)?,)\s*$", re.I)
_CONTACT = re.compile(r"^\s*(?:(?:phone|mobile|tel|t|m|fax|mob)\b[.:]?\s*[+(\d][\d\s()/.-]{4,}|[\w.+-]+@[\w.-]+|(?:https?://|www\.)\S+)\s*$", re.I)
_ALNUM = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.?!…][\"'”’»)\]]*(?=\s|$)")


def visible(line: str) -> str:
    """A line without mark-up, line end and entities."""
    line = line.rstrip("\r")
    if "<" in line:
        line = _TAG.sub("", line)
    return html.unescape(line) if "&" in line else line


def _tokens(sender: str | None) -> set[str]:
    return {w for w in _WORD.findall(fold(sender or "")) if len(w) > 2 and w not in ("example", "test", "invalid", "com", "org", "net")}


#: words below which a sentence proves nothing by itself
LEAST_WORDS = 6
#: words of a finished sentence that is prose, no part of a closing
PROSE_WORDS = 12


def _code(unit: str) -> int:
    raw = unit.encode()
    return (zlib.crc32(raw) << 31) ^ zlib.adler32(raw) ^ len(raw)


class Unit(NamedTuple):
    """A sentence (or what stands between two breaks): its hash, its lines, its words."""

    code: int
    first: int
    last: int
    words: int
    ended: bool


def sentences(text: list[str]) -> list[Unit]:
    """Units of visible lines, without quote marks; wraps and case don't matter.

    A unit ends with a sentence, an empty line, a line that ends with a colon, or a greeting.
    """
    out: list[Unit] = []
    held: list[str] = []
    start = last = 0

    def close(ended: bool) -> None:
        if held:
            out.append(Unit(_code(" ".join(held)), start, last, len(held), ended))
            held.clear()

    for i, line in enumerate(text):
        words = _MARKS.sub("", line).lower().split()
        if not words:
            close(False)
        for w in words:
            if not held:
                start = i
            last = i
            held.append(w)
            if w[-1] in ".?!":
                close(True)
        if words and (words[-1][-1] == ":" or (words[-1][-1] == "," and len(words) <= 4)):
            close(False)
    close(False)
    return out


def _line_code(line: str) -> int:
    return _code(" ".join(_MARKS.sub("", line).lower().split()))


def tails(text: list[str], units: list[Unit]) -> list[int]:
    """Lines that end a run of text: up from the end, and from each quotation, to the last prose."""
    prose = [len(t) > 75 for t in text]
    for u in units:
        if u.ended and u.words >= PROSE_WORDS:
            prose[u.first : u.last + 1] = [True] * (u.last + 1 - u.first)
    ends = [len(text)]
    for i, t in enumerate(text):
        lead = t.lstrip()[:1]
        if (lead and lead in ">|:]-" and (_PREFIX.match(t) or _SOFT_PREFIX.match(t) or _SEPARATOR.match(t))) or (t.rstrip().endswith(":") and _INTRO.match(t.strip())) or (":" in t[:12] and _FROM.match(t)):
            ends.append(i)
    out: set[int] = set()
    for e in ends:
        i = e - 1
        while i >= 0 and i not in out and not prose[i] and not (i + 1 < e and i in ends):
            out.add(i)
            i -= 1
    return sorted(i for i in out if _ALNUM.search(text[i]))


class Seen(NamedTuple):
    """What the windows found out about the units of one message."""

    quoted: frozenset = frozenset()
    notices: frozenset = frozenset()
    closings: frozenset = frozenset()


def _covered(units: list[Unit], codes: frozenset, n: int, together: bool = False) -> list[bool]:
    """Lines of which every unit is in ``codes``, and proven: by a unit that is long enough,
    or beside such a line. ``together``: by several units that are long enough taken together."""
    inside, words = [False] * n, [0] * n
    for u in units:
        inside[u.first : u.last + 1] = [True] * (u.last + 1 - u.first)
        words[u.first] += u.words
    longest = [0] * n
    for u in units:
        hit = u.code in codes
        for i in range(u.first, u.last + 1):
            inside[i] &= hit
            longest[i] = max(longest[i], u.words)
    i = 0
    while i < n:
        e = i
        while e < n and inside[e]:
            e += 1
        if e > i and (sum(words[i:e]) if together else max(longest[i:e])) < LEAST_WORDS:
            inside[i:e] = [False] * (e - i)
        i = max(e, i + 1)
    return inside


def classify(body: str | None, sender: str | None, seen: Seen = Seen()) -> tuple[list[str], list[bool], list[str]]:  # noqa: B008
    """(class of each line, whether a window decided it, visible lines)."""
    if not body:
        return [], [], []
    raw = body.split("\n")
    text = [visible(x) for x in raw]
    n = len(raw)
    kind: list[str | None] = [None] * n
    filled = [bool(_ALNUM.search(t)) for t in text]
    units = sentences(text) if any(seen) else []
    earlier = _covered(units, seen.quoted, n)
    told = [x and not _HANDSET.match(t) and not _CLOSING.match(t) for x, t in zip(_covered(units, seen.notices, n, together=True), text)]
    earlier = [a and not b for a, b in zip(earlier, told)]  # a notice of one's own may stand in the thread before
    proof = [False] * n
    # HTML elements that quote, sign or carry a notice
    if "<" in body:
        stack: list[tuple[str, str | None]] = []
        for i, line in enumerate(raw):
            inside = next((k for _, k in reversed(stack) if k == QUOTED), None) or next((k for _, k in reversed(stack) if k), None)
            for m in _OPENING.finditer(line):
                name, attributes = m[2].lower(), m[3]
                if m[1]:
                    for d in range(len(stack) - 1, -1, -1):
                        if stack[d][0] == name:
                            del stack[d:]
                            break
                    continue
                k = None
                if name == "blockquote" or _HTML_QUOTE.search(attributes):
                    k = QUOTED
                elif _HTML_SIGN.search(attributes):
                    k = SIGNATURE
                elif name == "small":
                    k = NOTICE
                stack.append((name, k))
                inside = inside or k
            if inside:
                kind[i] = inside
    # prefixes: a lone "> 40 units ..." is a comparison, not a quotation
    marked = [">" in t[:8] and bool(_PREFIX.match(t)) for t in text]
    for i in range(n):
        soft = _SOFT_PREFIX.match(text[i]) if text[i].lstrip()[:1] in ("|", ":", "]") else None
        if soft and any(0 <= j < n and text[j].lstrip().startswith(soft[1]) for j in (i - 1, i + 1)):
            marked[i] = True
    intro_end = [False] * n
    colon = [t.endswith(":") for t in (x.rstrip() for x in text)]
    i = 0
    open_from = -1
    while i < n:
        if kind[i] or not filled[i] or marked[i]:
            i += 1
            continue
        t = text[i].strip()
        reach = 0
        if t[0] == "-" and _SEPARATOR.match(t):
            reach = 1
        elif ":" in t[:12] and _FROM.match(t) and _headers_follow(text, i):
            reach = 1
        else:
            for span in (1, 2, 3):
                if i + span > n or (span > 1 and (marked[i + span - 1] or not (filled[i + span - 1] or text[i + span - 1].strip() == ":"))):
                    break
                if not colon[i + span - 1]:
                    continue
                joined = " ".join(x.strip() for x in text[i : i + span])
                if (span == 1 or _INTRO_START.match(t)) and len(joined) < 320 and _INTRO.match(joined) and (re.search(r"\d|@", joined) or joined[:5].lower() in _BARE):
                    reach = span
                break
        if not reach:
            i += 1
            continue
        for j in range(i, i + reach):
            kind[j] = QUOTED
        k = i + reach
        while k < n and (not filled[k] or _HEADER.match(text[k].strip()) or _FROM.match(text[k].strip()) or _SEPARATOR.match(text[k].strip())):
            if filled[k]:
                if marked[k]:
                    break
                kind[k] = QUOTED
                # a header may run on over the next line
                if k + 1 < n and filled[k + 1] and re.search(r",\s*$", text[k]) and "@" in text[k + 1] and not _HEADER.match(text[k + 1].strip()):
                    kind[k + 1] = QUOTED
                    k += 1
            k += 1
        if k < n and (marked[k] or kind[k] == QUOTED):
            intro_end[k] = True
            i = k
            continue
        open_from = i
        break
    top = False
    if open_from >= 0:
        top = not any(filled[j] and not marked[j] and kind[j] is None and not told[j] and not _notice(text[j]) for j in range(open_from))
        headed = any(kind[j] == QUOTED and (_FROM.match(text[j].strip()) or _SEPARATOR.match(text[j].strip())) for j in range(open_from, n))
        top = top and not headed
        border = n
        known = [u.last for u in units if u.first >= open_from and u.words >= LEAST_WORDS and u.code in seen.quoted and not told[u.first]] if top else []
        if known:
            border = _reach(text, max(known)) + 1
        for j in range(open_from, border):
            if kind[j] is None:
                kind[j] = QUOTED
    for i in range(n):
        if kind[i] is None and marked[i]:
            alone = not (i > 0 and (marked[i - 1] or intro_end[i])) and not (i + 1 < n and marked[i + 1])
            if alone and re.match(r"^\s*>\s?\d", text[i]) and not intro_end[i]:
                marked[i] = False
            else:
                kind[i] = QUOTED
    # the rest of a quoted line that was wrapped without its prefix
    for i in range(1, n - 1):
        if kind[i] is None and filled[i] and marked[i - 1] and marked[i + 1] and kind[i - 1] == QUOTED and filled[i - 1]:
            kind[i] = QUOTED
    # one sentence by itself, without a mark around it, may be said twice
    i = 0
    while i < n:
        e = i
        while e < n and (earlier[e] or (e > i and not filled[e])):
            e += 1
        if e > i and all(k is None for k in kind[i:e]) and sum(u.words >= LEAST_WORDS and i <= u.first < e for u in units) < 2:
            earlier[i:e] = [False] * (e - i)
        i = max(e, i + 1)
    for i in range(n):
        if earlier[i]:
            kind[i], proof[i] = QUOTED, True
        elif told[i] and kind[i] in (None, NOTICE):
            kind[i], proof[i] = NOTICE, True
    names = _tokens(sender)
    recurs = [bool(t) and _line_code(t) in seen.closings for t in text] if seen.closings else [False] * n
    # runs of lines that are still undecided: closing and notices at their edges
    i = 0
    while i < n:
        if kind[i] is not None:
            i += 1
            continue
        e = i
        while e < n and kind[e] is None:
            e += 1
        lines = [j for j in range(i, e) if filled[j]]
        own = len(lines)
        while own and recurs[lines[own - 1]]:
            own -= 1
        if own or len(lines) < sum(filled[j] and kind[j] in (None, NEW) for j in range(n)):
            for j in lines[own:]:
                kind[j], proof[j] = SIGNATURE, True
        _edges(text, filled, kind, i, lines[own] if own < len(lines) and kind[lines[own]] else e, names)
        i = e
    return [k or NEW for k in kind], proof, text


def _headers_follow(text: list[str], i: int) -> bool:
    """At least two more header lines below a From line, before any empty line."""
    n = 0
    for x in text[i + 1 : i + 6]:
        if not x.strip():
            break
        n += bool(_HEADER.match(x.strip()))
    return n >= 2


def _paragraphs(text: list[str], filled: list[bool], a: int, e: int) -> list[tuple[int, int]]:
    out, i = [], a
    while i < e:
        if not filled[i]:
            i += 1
            continue
        j = i
        while j < e and text[j].strip():
            j += 1
        out.append((i, max(j, i + 1)))
        i = max(j, i + 1)
    return out


def _edges(text, filled, kind, a: int, e: int, names: set[str]) -> None:
    """Marks notices and the closing of one run of lines in place."""
    parts = _paragraphs(text, filled, a, e)
    joined = [" ".join(text[p:q]) for p, q in parts]
    k = 0
    while k < len(parts) and _notice(joined[k]):  # above the text
        for j in range(*parts[k]):
            kind[j] = NOTICE
        k += 1
    first = k
    k = len(parts) - 1
    last = e
    while k >= first and _notice(joined[k]):  # below it: whole paragraph, or from the line that starts it
        p, q = parts[k]
        start = p
        while start < q and not _notice(" ".join(text[start : min(q, start + 2)])):
            start += 1
        if start > p and not _signature_start(text, filled, p, start, names):
            start = next((s for s in range(p, q) if _notice(text[s])), p)
            if not any(_END.search(text[s]) or len(text[s]) < 60 for s in range(max(p, start - 1), start)):
                start = p
        for j in range(start, q):
            kind[j] = NOTICE
        last = start
        if start > p:
            break
        k -= 1
    begin = parts[first][0] if first < len(parts) else e
    s = _signature_start(text, filled, begin, last, names)
    if s is None:
        return
    for j in range(s, last):
        if kind[j] is None:
            inner = text[j].strip()
            kind[j] = NOTICE if _notice(inner) else SIGNATURE


def _short_name(t: str, names: set[str]) -> bool:
    words = _WORD.findall(fold(t))
    if not words or len(t) > 60 or len(words) > 6 or re.search(r"[.?!]\s*$", t) and len(words) > 3:
        return False
    return bool(set(words) & names) or any(len(w) > 2 and any(x.startswith(w[:3]) for x in names) for w in words[:2])


def _closed_by_name(t: str, names: set[str]) -> bool:
    """A closing formula and a name on one line: "Best, Ann", "Rgds Ann"."""
    words = t.split()
    for cut in range(1, min(len(words), 9)):
        head, name = " ".join(words[:cut]), " ".join(words[cut:])
        if len(words) - cut <= 4 and _CLOSING.match(head) and (_short_name(name, names) or (head[-1] in ",!." and _looks_named(name)) or (len(words) - cut == 1 and _looks_named(name))):
            return True
    return False


def _title(t: str) -> bool:
    """A line of a signature block: capitalised, without sentence end or figures."""
    t = t.strip()
    return t[:1].isupper() and not re.search(r"[.?!;:)]$(?<!\b[A-Za-z]\.)(?<!\b(?:inc|ltd)\.)|\d", t, re.I) and len(_WORD.findall(t)) <= 6


def _looks_named(t: str) -> bool:
    t = t.strip()
    return bool(re.fullmatch(r"(?:[A-ZÀ-Þ][\w'’.-]*\s?){1,5}", t)) and len(t) <= 48


def _signature_start(text, filled, a: int, e: int, names: set[str]) -> int | None:
    """First line of the closing in [a, e): formula, separator, marked or bare name, device line."""
    lines = [i for i in range(a, e) if filled[i]]
    if not lines:
        return None
    tail = lines[-14:]
    best = None
    for i in tail:
        t = text[i].strip()
        after = [j for j in lines if j > i]
        size = sum(len(text[j]) for j in after)
        prose = any(len(text[j].strip()) > 75 or len(_WORD.findall(text[j])) > 9 and not _HANDSET.match(text[j]) for j in after)
        if len(after) > 9 or size > 420 or prose:
            continue
        if _CLOSING.match(t):
            best = i
            break
        if len(t) <= 70 and _closed_by_name(t, names):
            best = i
            break
        if _HANDSET.match(t):
            best = i
            break
        m = re.match(r"^\s*(?:[-–—/~*]|--)\s?(\S.{1,40})$", t)
        if m and len(after) <= 6 and (_short_name(m[1], names) or (_looks_named(m[1]) and not after)):
            best = i
            break
        if _CONTACT.match(t):
            best = i
            break
        if len(t) <= 48 and _short_name(t, names) and _looks_named(t) and not t.endswith((",", ":")):
            best = i
            break
    # a last paragraph of nothing but a name and titles
    if best is None:
        j = lines[-1]
        while j - 1 >= a and filled[j - 1]:
            j -= 1
        block = [text[x].strip() for x in range(j, lines[-1] + 1)]
        if len(block) <= 4 and all(len(x) <= 42 and _title(x) for x in block) and _looks_named(block[0]) and (len(block) > 1 or " " in block[0]):
            best = j if j > a else None
    # name and title lines above a contact line, and a separator above them
    if best is not None:
        j = best - 1
        while j >= a and text[j].strip() and len(text[j]) <= 48 and (not filled[j] or _title(text[j])) and not _GREETING.match(text[j]):
            j -= 1
        best = j + 1
    # a separator above the closing belongs to it, and by itself opens one
    for i in range(a, e):
        if _CUT.match(text[i]) and not filled[i]:
            after = [j for j in lines if j > i]
            if after and len(after) <= 9 and sum(len(text[j]) for j in after) <= 420 and (best is None or i < best):
                near = text[after[0]].strip()
                if re.match(r"^\s*(?:--|—|–)\s*$", text[i]) or _short_name(near, names) or _CLOSING.match(near) or (_looks_named(near) and len(after) <= 4):
                    if not any(len(_WORD.findall(text[j])) > 11 for j in after):
                        return i
    return best


def _reach(text: list[str], line: int) -> int:
    """How far an open quotation reaches that holds this line: the end of its paragraph,
    and on over a closing that follows."""
    n, i = len(text), line
    while i + 1 < n and text[i + 1].strip():
        i += 1
    while True:
        a = i + 1
        while a < n and not text[a].strip():
            a += 1
        e = a
        while e < n and text[e].strip():
            e += 1
        block = [t.strip() for t in text[a:e]]
        if not block or not all(_CLOSING.match(t) or _CUT.match(t) or _CONTACT.match(t) or _closed_by_name(t, set()) or (len(t) <= 42 and _title(t)) for t in block) or any(_GREETING.match(t) and not _CLOSING.match(t) for t in block):
            return i
        i = e - 1


def _identity(sender: str | None) -> str | None:
    """Address of a sender, else the words of the name in any order."""
    if not sender:
        return None
    m = re.search(r"[\w.+'-]+@[\w.-]+", sender)
    return m[0].lower() if m else " ".join(sorted(_WORD.findall(fold(sender)))) or None


#: one letter a class; small for lines without letters or digits
_LETTER = {NEW: "N", QUOTED: "Q", SIGNATURE: "S", NOTICE: "D"}
_UNIT = "array<struct<unit: bigint, top: boolean, below: boolean>>"


def message_units(messages: DataFrame, key: str = "msg_key") -> DataFrame:
    """(key, box, thread, message, who, sent_at, units, tail) of every message.

    box, thread, message and who (the sender's address or name) are 64-bit hashes, so that
    the exploded units stay narrow; thread and who may be null. units: its sentences, whether
    they stand in the first paragraph, or below a closing; tail: the lines that may belong
    to a closing.
    """
    kind = messages.schema[key].dataType.simpleString()
    shape = pa.list_(pa.struct([("unit", pa.int64()), ("top", pa.bool_()), ("below", pa.bool_())]))
    kept = (key, "box", "thread", "message", "sent_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, ends, who = [], [], []
            for body, sender in zip(batch.column("body_text").to_pylist(), batch.column("sender").to_pylist()):
                text = [visible(x) for x in body.split("\n")] if body else []
                found = sentences(text)
                closing = [i for i, t in enumerate(text) if len(t) < 80 and (_CLOSING.match(t) or _CUT.match(t) or _CONTACT.match(t) or _HANDSET.match(t))]
                begin = next((i for i, t in enumerate(text) if t.strip()), 0)
                first = next((i for i in range(begin, len(text)) if not text[i].strip()), len(text))
                units.append([{"unit": u.code, "top": u.first < first, "below": any(u.first - 15 <= i < u.first for i in closing)} for u in {u.code: u for u in found}.values()])
                ends.append(list({_line_code(text[i]) for i in tails(text, found)}))
                name = _identity(sender)
                who.append(_code(name) if name else None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(who, pa.int64()), pa.array(units, shape), pa.array(ends, pa.list_(pa.int64()))],
                [*kept, "who", "units", "tail"],
            )

    return spread(
        messages.select(
            key,
            F.xxhash64("mailbox_id").alias("box"),
            F.when(F.col("thread_id").isNotNull(), F.xxhash64("mailbox_id", "thread_id")).alias("thread"),
            F.xxhash64(F.coalesce("message_id", F.col(key).cast("string"))).alias("message"),
            "sent_at",
            "sender",
            "body_text",
        )
    ).mapInArrow(run, f"{key} {kind}, box bigint, thread bigint, message bigint, sent_at timestamp, who bigint, units {_UNIT}, tail array<bigint>")


def _gathered(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.collect_set("unit").alias(name))


def earlier_units(units: DataFrame, key: str = "msg_key") -> DataFrame:
    """(key, quoted): the units of each message that another message of its thread had before.

    A unit belongs to the thread's first message by date that has it: a minimum that combines
    before the shuffle, so a thread or a line of a third of all messages is one row a task.
    """
    place = F.struct(F.col("sent_at").isNull().alias("late"), F.unix_micros("sent_at").alias("at"), "message").alias("place")
    held = units.select(key, "box", "thread", "message", place, F.explode("units.unit").alias("unit"))

    def after_the_first(rows: DataFrame, all_rows: DataFrame, scope: str) -> DataFrame:
        where = F.xxhash64(scope, "unit")
        owners = (
            all_rows.groupBy(where.alias("place_of"))
            .agg(F.min("place").alias("first"), F.min("message").alias("least"), F.max("message").alias("most"))
            .where("least <> most")
            .select("place_of", F.col("first.message").alias("author"))
        )
        return rows.select(key, "message", "unit", where.alias("mine")).join(owners, F.expr("mine = place_of")).where("message <> author").select(key, "unit")

    threaded, stray = held.where("thread is not null"), held.where("thread is null")
    # a message without a thread is held against its whole mailbox
    wanted = stray.select(F.xxhash64("box", "unit").alias("wanted")).distinct()
    around = held.join(wanted, F.xxhash64("box", "unit") == F.col("wanted"), "left_semi")
    return _gathered(after_the_first(threaded, threaded, "thread").unionByName(after_the_first(stray, around, "box")), key, "quoted")


def notice_units(units: DataFrame, key: str = "msg_key", senders: int = 3, top: float = 0.8, below: float = 0.3) -> DataFrame:
    """(key, notices): sentences of at least ``senders`` senders that stand in the first
    paragraph in ``top`` of their messages, or below a closing in ``below`` of them.

    units: as ``message_units`` with ``quoted``, whose units are no evidence.
    """
    said = F.when(F.col("thread").isNotNull(), F.col("quoted"))
    fresh = F.filter("units", lambda u: ~F.coalesce(F.array_contains(said, u["unit"]), F.lit(False)))
    shared = (
        units.where("who is not null")
        .select("who", F.explode(fresh).alias("u"))
        .groupBy(F.col("u.unit").alias("unit"), "who")
        .agg(F.count("*").alias("n"), F.count_if("u.top").alias("top"), F.count_if("u.below").alias("below"))
        .groupBy("unit")
        .agg(F.count("*").alias("senders"), F.sum("n").alias("n"), F.sum("top").alias("top"), F.sum("below").alias("below"))
        .where((F.col("senders") >= senders) & ((F.col("top") >= top * F.col("n")) | (F.col("below") >= below * F.col("n"))))
        .select("unit")
    )
    return _gathered(units.select(key, F.explode("units.unit").alias("unit")).join(shared, "unit", "left_semi"), key, "notices")


def closing_units(units: DataFrame, key: str = "msg_key", messages: int = 3) -> DataFrame:
    """(key, closings): closing lines that recur in at least ``messages`` messages of the sender."""
    tail = units.where("who is not null").select(key, "box", "who", "message", F.explode("tail").alias("unit"))
    tail = tail.select(key, "message", "unit", F.xxhash64("box", "who", "unit").alias("mine"))
    recurring = (
        tail.select(F.col("mine").alias("line"), "message").distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= messages).select("line")
    )
    return _gathered(tail.join(recurring, F.expr("mine = line"), "left_semi").select(key, "unit"), key, "closings")


def line_classes(messages: DataFrame, key: str = "msg_key") -> DataFrame:
    """(key, line_no, class, filled, by_window): new, quoted, signature or notice, for every line of every body."""
    units = materialize(message_units(messages, key), "message-units")
    earlier = materialize(earlier_units(units, key), "earlier-units")
    placed = units.select(key, "thread", "who", "units").join(earlier, key, "left")
    seen = earlier.join(notice_units(placed, key), key, "full").join(closing_units(units, key), key, "full")
    kind = messages.schema[key].dataType.simpleString()
    names = ("quoted", "notices", "closings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, windows = [], []
            for body, sender, *found in zip(*[batch.column(c).to_pylist() for c in ("body_text", "sender", *names)]):
                kinds, proof, text = classify(body, sender, Seen(*[frozenset(x or ()) for x in found]))
                letters.append("".join(_LETTER[k] if _ALNUM.search(t) else _LETTER[k].lower() for k, t in zip(kinds, text)))
                windows.append("".join("W" if x else "-" for x in proof))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(letters, pa.string()), pa.array(windows, pa.string())], [key, "kinds", "windows"])

    # as many partitions as the session shuffles into: reading lines costs far more than their bytes tell
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lettered = (
        messages.select(key, "sender", "body_text")
        .repartition(parts, key)
        .join(seen, key, "left")
        .mapInArrow(run, f"{key} {kind}, kinds string, windows string")
        .select(key, "windows", F.posexplode(F.split("kinds", "")).alias("line_no", "letter"))
        .where("letter <> ''")
    )
    letter = F.upper("letter")
    named = F.when(letter == "N", NEW).when(letter == "Q", QUOTED).when(letter == "S", SIGNATURE).otherwise(NOTICE)
    return lettered.select(
        key,
        F.col("line_no").cast("int").alias("line_no"),
        named.alias("class"),
        (F.col("letter") == letter).alias("filled"),
        (F.expr("substring(windows, line_no + 1, 1)") == "W").alias("by_window"),
    )


def segments(messages: DataFrame, key: str = "msg_key") -> DataFrame:
    """(key, authored_text, quoted_text, signature_text, disclaimer_text) of every message."""
    line = F.get(F.split("body_text", "\n"), F.col("line_no"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("class") == c, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    parts = (
        line_classes(messages, key)
        .join(messages.select(key, "body_text"), key)
        .withColumn("line", line)
        .groupBy(key)
        .agg(*[F.regexp_replace(joined(c), r"^\s+|\s+$", "").alias(name) for c, name in ((NEW, "authored_text"), (QUOTED, "quoted_text"), (SIGNATURE, "signature_text"), (NOTICE, "disclaimer_text"))])
    )
    names = ("authored_text", "quoted_text", "signature_text", "disclaimer_text")
    return messages.select(key).join(parts, key, "left").select(key, *[F.coalesce(n, F.lit("")).alias(n) for n in names])
