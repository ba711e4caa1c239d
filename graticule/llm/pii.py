"""Personal information in free text (problem 5).

Addresses of mail, phone numbers, identity numbers and street addresses have forms and are found by them. Names have
none: how strongly a word reveals a person is estimated from the whole corpus, by what it stands beside.

1. The protected entities that are known from the start are the persons of the senders' and recipients' fields.
2. Every capitalised word of the texts is counted with the two tokens before and the two behind it (its contexts). How
   often a context holds a known person's word, smoothed towards the share that known words have of all capitalised ones,
   is the chance that what stands in it is a person: "badge goes to ...", "... has confirmed" are learned in this way. What
   stands behind a title, in a header line or beside a mail address is a context of its own.
3. A word's disclosure is the information that it gives about a person being named,

       log2( odds(person | word) / odds(person) ),

   in bits; both odds come from means of the contexts' chances, over the places of the word and over all capitalised places.

Words above the threshold reveal persons wherever they stand with a capital; with their particles, initials and revealing
neighbours they make up the names. All items are replaced by placeholders of their types, the type being what remains of
a term that discloses too much.

What remains is terms that are no names but reveal one person all the same, as a firm of one sender does. Of each
capitalised term the messages are counted by sender; it discloses the sender whose messages hold most of them by
log2( P(sender | term) / P(sender) ). ``sanitise`` generalises terms above ``TERM_BITS`` to [TERM].

The counts are combinable aggregates. No list of names is broadcast: the words of each message are joined with the
words' disclosures, and each message gets those of its own words. Texts are read once; both passes share what was found.

Defined cases: null and empty fields have no items; an item of several places is reported once per field; redelivered
messages (same id) give equal items; text in HTML is read without tags, with entities decoded, and reported as it stands
in the field; texts of any length are read whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.session import checkpointed

#: Bits from which a word reveals a person.
BITS = 1.2
#: Weight of the prior chance of a context, in places, the prior chance of the places that a cue marks, and the weight of
#: a name in a sender's or recipient's field.
SMOOTH, CUED, HEADED = 4.0, 0.9, 4
#: Messages that a term needs, the share of them that must be one sender's, and the bits from which it is generalised.
TERM_PLACES, TERM_SHARE, TERM_BITS = 4, 0.7, 3.0
FIELDS = ("body", "snippet")
#: The context of places that a title, a header line or a mail address marks; and the start of a line.
CUE, START = "\x02", "^"
#: A line is taken for wrapped if it would have this length with the next line's first word.
WRAP = 64

# Forms of identity numbers, phone numbers, mail and street addresses, and cues before names.
CAP = r"[A-ZÀ-ÖØ-Þ]"
LOW = r"[a-zß-öø-ÿ]"
WORD = rf"(?:{CAP}{LOW}+|[DdLl]['’]{CAP}{LOW}+)"
AT = re.compile(r"@|\(at\)|\[at\]|\(chiocciola\)")
DOMAIN = re.compile(r"[A-Za-z][\w-]*(?:\.[A-Za-z][\w-]*)*\.[A-Za-z]{2,}\b")
ID_NUMBER = re.compile(r"(?i)(?<![\w-])(?:[A-Z]{3}\s?[A-Z]{3}\s?\d\d[A-EHLMPRST]\d\d\s?[A-Z]\d{3}[A-Z]|C[A-Z]\d{5}[A-Z]{2}|U1\d{7}[A-Z]|Y[A-Z]\d{7})(?![\w-])")
PHONE = re.compile(
    r"(?<![\w.,/+:#-])(?:(?:\+|00)\d{2,3}(?:[ .-]?\(0\)\s?\d{2,4}|[ .-]?\(\d{2,4}\)|[ .-]\d{2,4})(?:[ .-]?\d{2,4}){1,4}|\(0\d{1,4}\)\s?\d{3,4}\s?\d{3,4}|0\d{1,4}[-/]\d{5,8}|0\d{2,3}\s\d{3,4}\s\d{3,4}|3\d{2}[. -]\d{3}[. -]\d{4}|3\d{9})(?![\w/]|[.,-]\d|\s?(?:mm|cm|kg|m)\b)"
)
NUMBER = r"\d{1,4}(?:\s?/\s?[A-Z]|\s?bis\b|\s?ter\b|[a-z]\b)?"
TOWN = rf"{WORD}(?:(?:\s(?:di|del|della|dei|sul|am|an der|sur|la|le))?\s{WORD}){{0,2}}"
PLACE = rf"(?:\s?[,–-]\s?\d{{5}}\s{TOWN}(?:\s\([A-Z]{{2}}\))?)?"
ADDRESS = re.compile(
    rf"(?<![\w.])(?:(?:[Vv]ia|[Vv]iale|[Vv]\.le|[Pp]iazza|[Pp]iazzale|[Pp]\.z?za|[Cc]orso|[Cc]\.so|[Ll]argo|[Vv]icolo|[Ss]trada)\s(?:(?:del|dei|della|delle|degli|dello|di)\s|dell['’])?{WORD}(?:\s(?:del\s|dei\s|di\s)?{WORD}){{0,2}}(?:,?\s(?:n\.\s?|nr\.\s?|N\.\s?)?){NUMBER}{PLACE}"
    rf"|{CAP}{LOW}+(?:straße|strasse|weg|gasse|platz|allee)\s{NUMBER}{PLACE}"
    rf"|\d{{1,4}}(?:\s?bis|[A-Za-z])?,?\s(?:rue|avenue|allée|place|boulevard|chemin|impasse|quai)\s(?:(?:de la|de l['’]|du|des|de)\s?)?{WORD}(?:\s{WORD}){{0,2}}{PLACE}"
    rf"|\d{{1,4}}(?:[A-Za-z])?\s{WORD}(?:\s{WORD})?\s(?:Street|Road|Avenue|Lane|Square|Drive)(?:,\s{WORD})?(?:,?\s\d{{5}})?)"
)
TITLE = r"(?:[Ii]ng|[Dd]ott|[Dd]r|[Gg]eom|[Aa]rch|[Ss]ig|[Ss]ig\.ra|[Dd]ott\.ssa|[Rr]ag|[Aa]vv|[Pp]rof|Mr|Mrs|Ms|Herr|Frau|Mme|M)\."
CUES = rf"(?:{TITLE}|intestato a|fattura va a|invoice to|facture à|Rechnung (?:geht )?an|documento di|referente:|Visitor:|Besucher(?:in)?:|Visiteur\s?:|Ansprechpartner(?:in)?:|chiamare|[Pp]lease ring|Appelez|Rufen Sie)"
NAME = r"[^\W\d_]+(?:['’][^\W\d_]+)?"
AFTER_CUE = re.compile(rf"(?<!\w){CUES}\s+((?:[A-Z]\.\s?)?{NAME}(?:,?\s(?:[A-Z]\.\s?)?{NAME}){{0,3}})")
WROTE = re.compile(r"\s(?:ha scritto|wrote|a écrit)\b")
MAIL = re.compile(r"\s+<[\w.+-]+@")
ONE = re.compile(NAME)
HEADER = re.compile(rf"(?:^|[\n>|*\s])(?:Da|From|Von|De|A|To|An|À)\s?:\**\s+((?:{CAP}\.\s?)?{NAME}(?:\s{NAME}){{1,3}})(?=\s*(?:<|&lt;|\n|$))")
PARTICLES = {"de", "di", "von", "van", "da", "del", "della", "le", "la", "d"}
TOKEN = re.compile(rf"{CAP}\.(?=\s?{CAP}{LOW})|(?<![\d_]){NAME}(?![\d_])|[\n\v]|[^\w\s]|\w+")
#: Words that stand after cues and aren't names.
STOP = set("cie cf c ci cod codice carta patente passport passaporto driving licence license al il la lo le i gli un una in on at to the a au am an ist e è and und et est hat has tel cell nr no residente c.f cf ing dott geom arch mr residing before about prima about per sono del dei".split())


TAGGED = re.compile(r"(?i)</?(?:html|body|p|div|br|span|blockquote)\b")
IN_TAGS = re.compile(r"<[^<>]*>|&#?\w+;|\r?\n[ \t]*(?:(?:>|&gt;|\|)[ \t]?)*|[\s\x0b]")
IN_TEXT = re.compile(r"\r?\n[ \t]*(?:[>|][ \t]?)*|[^\S ]")


class Flat:
    """A field's text without tags, quote prefixes and wrapping, and the places in the field of its runs of characters."""

    def __init__(self, raw: str):
        out: list[str] = []
        #: begin in the text, begin in the field and, of what stands for one character, its length there (else 0)
        self.begins: list[int] = []
        self.raws: list[int] = []
        self.sizes: list[int] = []
        tagged = bool(TAGGED.search(raw))
        pos = length = 0
        last = ""

        def put(text: str, at: int, size: int) -> None:
            nonlocal length, last
            out.append(text)
            self.begins.append(length)
            self.raws.append(at)
            self.sizes.append(size)
            length += len(text)
            last = text[-1]

        for m in (IN_TAGS if tagged else IN_TEXT).finditer(raw):
            a, z = m.span()
            if a > pos:
                put(raw[pos:a], pos, 0)
            pos = z
            t = m.group()
            if tagged and t[0] == "<":
                continue
            c = html.unescape(t) if t[0] == "&" else "\n" if "\n" in t else " "
            c = c[:1] if c and not c[0].isspace() or c == "\n" else " "
            if c in " \n" and last and last in " \n\v":
                if c == "\n":
                    last = "\v" if last == "\n" else "\n"
                    out[-1] = out[-1][:-1] + last
                continue
            put(c, a, z - a)
        if pos < len(raw):
            put(raw[pos:], pos, 0)
        self.text = "".join(out)

    def slice(self, a: int, b: int) -> tuple[int, int]:
        return place(self.begins, self.raws, self.sizes, a, b)


def place(begins: list[int], raws: list[int], sizes: list[int], a: int, b: int) -> tuple[int, int]:
    """Begin and end in the field of the characters from a to b."""
    i, j = bisect_right(begins, a) - 1, bisect_right(begins, b - 1) - 1
    return raws[i] + (0 if sizes[i] else a - begins[i]), raws[j] + (sizes[j] or b - begins[j])


def joined(text: str) -> str:
    """The text with wrapped lines joined; other ends of lines and blank lines stay as a mark that joins nothing."""
    out, begin = list(text), 0
    for m in re.finditer("[\n\v]", text):
        out[m.start()] = " " if m.group() == "\n" and _wraps(text, begin, m.start()) else "\0"
        begin = m.end()
    return "".join(out)


def _wraps(text: str, begin: int, end: int) -> bool:
    """Whether the next line's first word had no room on the line that ends here."""
    word = re.match(r"\S*", text[end + 1 : end + 80]).group()
    return end - begin + 1 + len(word) >= WRAP


def addresses(line: str) -> Iterator[tuple[int, int]]:
    """Places of mail addresses."""
    for m in AT.finditer(line):
        a, z = m.span()
        if m.group() != "@":
            a -= a > 0 and line[a - 1].isspace()
            z += z < len(line) and line[z].isspace()
        b = a
        while b and (line[b - 1].isalnum() or line[b - 1] in "_.+-"):
            b -= 1
        if b < a and (d := DOMAIN.match(line, z)):
            yield b, d.end()


def formed(text: str) -> tuple[list[tuple[int, int, str]], bytearray]:
    """Items that have a form, and the characters that they take."""
    taken, out = bytearray(len(text)), []
    line = joined(text)
    found = [(a, b, "EMAIL") for a, b in addresses(line)]
    for kind, pattern in (("ID_NUMBER", ID_NUMBER), ("ADDRESS", ADDRESS), ("PHONE", PHONE)):
        for m in pattern.finditer(line):
            if kind != "PHONE" or 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((*m.span(), kind))
    for a, b, kind in found:
        if taken.find(1, a, b) < 0:
            out.append((a, b, kind))
            taken[a:b] = b"\x01" * (b - a)
    web(line, taken)
    return out, taken


def web(line: str, taken: bytearray) -> None:
    """Marks web addresses as taken; names in them are none."""
    if "://" in line or "www." in line:
        for m in re.finditer(r"\bwww\.\S+|https?://\S+", line):
            taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())


def before(line: str, end: int, least: int) -> int:
    """Where the run of up to four words that ends here begins; ``end`` if it has fewer than ``least``."""
    at, n = end, 0
    while n < 4:
        begin = at - 1 if n and line[at - 1 : at].isspace() else at if not n else -1
        if begin < 0:
            break
        b = begin
        while b and (line[b - 1].isalpha() or line[b - 1] in "'’"):
            b -= 1
        if not ONE.fullmatch(line, b, begin):
            break
        at, n = b, n + 1
    return at if n >= least else end


def protected(text: str) -> Iterator[tuple[int, int]]:
    """Places of words that a title, a header line or a mail address shows to be persons."""
    line = joined(text)
    for m in AFTER_CUE.finditer(line):
        a, b = m.span(1)
        if (b := _name_end(line, a, b)) > a:
            yield a, b
    for pattern, least in ((WROTE, 1), (MAIL, 2)):
        for m in pattern.finditer(line):
            b = m.start()
            if (a := _name_start(line, before(line, b, least), b)) < b:
                yield a, b
    for m in HEADER.finditer(text):
        yield m.span(1)


def _name_end(line: str, a: int, b: int) -> int:
    """Where the name that begins at a ends: at a stop word, or where capitals end after they began."""
    words = list(re.finditer(rf"[A-Z]\.|{NAME}", line[a:b]))
    end, lower = a, bool(words) and words[0].group()[0].islower()
    count = 0
    for w in words:
        t = w.group()
        if t.lower() in STOP or re.match(r"^[LlDd]['’][a-z]", t) or (not lower and t[0].islower() and t.lower() not in PARTICLES) or lower and not t[0].islower():
            break
        if lower and count >= 2 and words[0].group() not in PARTICLES and not any(x.group() in PARTICLES for x in words[:count]):
            break
        if end > a and "," in line[end : a + w.start()]:
            # "Family, First": one family name, with or without a particle, before the comma, and no abbreviation after it
            family = [x.group() for x in words[:count] if x.group().lower() not in PARTICLES]
            if len(family) != 1 or family[0].endswith(".") or line[a + w.end() : a + w.end() + 1] == "." or t.lower() in PARTICLES or t.isupper() != family[0].isupper():
                break
            end = a + w.end()
            break
        end = a + w.end()
        count += 1
    return end


def _name_start(line: str, a: int, b: int) -> int:
    """Where the run of capitalised words that ends at b begins."""
    start = b
    for w in reversed(list(re.finditer(NAME, line[a:b]))):
        t = w.group()
        if t[0].islower() and t.lower() not in PARTICLES or t.lower() in STOP or re.match(r"^[LlDd]['’][a-z]", t):
            break
        start = a + w.start()
    while start < b and (m := re.match(NAME, line[start:b])) and m.group()[0].islower() and m.group().lower() not in PARTICLES:
        start += m.end() + 1
    return start


NAMES = re.compile(rf"{CAP}\.(?=\s?{CAP}{LOW})|{NAME}|\n|[^\w\s]|\d\S*")


def names(text: str, taken: bytearray, cued: list[tuple[int, int]], revealing: set[str]) -> list[tuple[int, int]]:
    """Places of persons' names: runs of revealing words with their particles, initials and revealing neighbours."""
    out = sorted(set(cued))
    mask = bytearray(taken)
    for a, b in out:
        mask[a:b] = b"\x01" * (b - a)
    tokens = [(m.start(), m.end(), m.group()) for m in NAMES.finditer(text)]
    i = 0
    while i < len(tokens):
        a, b, t = tokens[i]
        if not t[0].isupper() or mask[a] or t.lower() not in revealing or len(t) < 2 or t.lower() in PARTICLES:
            i += 1
            continue
        first = last = i
        # to the left: particles, initials and unknown capitalised words beside the first name
        while first and not mask[tokens[first - 1][0]]:
            p, q = tokens[first - 1], tokens[first]
            gap = text[p[1] : q[0]]
            if gap.strip(" ") or "\n" in gap or not gap:
                break
            w = p[2]
            if re.fullmatch(rf"{CAP}\.", w) or w in ("De", "DE", "Di", "DI", "Von", "Van") or w[0].isupper() and w.lower() in revealing and len(w) > 1:
                first -= 1
            else:
                break
        while last + 1 < len(tokens) and not mask[tokens[last + 1][0]]:
            p, q = tokens[last], tokens[last + 1]
            step = 1
            if q[2] in (",", "\n") and last + 2 < len(tokens):
                # "Family, First" and names that wrap
                q = tokens[last + 2]
                step = 2
                if not q[2][0].isupper() or q[2].lower() not in revealing or mask[q[0]] or "\v" in text[p[1] : q[0]]:
                    break
                if tokens[last + 1][2] == "," and (last > first or "\n" in text[p[1] : q[0]] or last + 3 < len(tokens) and tokens[last + 3][2] == ","):
                    break
                if tokens[last + 1][2] == "\n" and not _wraps(text, text.rfind("\n", 0, p[1]) + 1, tokens[last + 1][0]):
                    break
            elif text[p[1] : q[0]].strip(" ") or "\n" in text[p[1] : q[0]]:
                break
            w = q[2]
            if not w[0].isupper() or len(w) < 2 or not w[0].isalpha():
                break
            if w in ("De", "DE", "Di", "DI", "Von", "Van") and last + step + 1 < len(tokens) and tokens[last + step + 1][2][0].isupper() or w.lower() in revealing:
                last += step
            else:
                break
        out.append((tokens[first][0], tokens[last][1]))
        i = last + 1
    return out


class Read:
    """A field as the first pass leaves it: its flat text, where that stands in the field, the formed items and the cued places."""

    __slots__ = ("text", "begins", "raws", "sizes", "forms", "cued", "taken")

    def __init__(self, raw: str | None = None):
        if raw is None:
            return
        flat = Flat(raw)
        self.text, self.begins, self.raws, self.sizes = flat.text, flat.begins, flat.raws, flat.sizes
        self.forms, self.taken = formed(flat.text)
        self.cued = [(a, b) for a, b in protected(flat.text) if self.taken.find(1, a, b) < 0]

    def contexts(self) -> Iterator[tuple[str, str, str]]:
        """(word, tokens before, tokens behind) of each capitalised word outside the formed items."""
        cued = bytearray(len(self.text))
        for a, b in self.cued:
            cued[a:b] = b"\x01" * (b - a)
        found = [(m.start(), m.group()) for m in TOKEN.finditer(self.text)]
        low = [START if t in "\n\v" else "#" if any(c.isdigit() or c == "_" for c in t) else t.lower() for _, t in found]
        low = [START, START, *low, START, START]
        for k, (at, t) in enumerate(found):
            if not self.taken[at] and (t[0].isupper() or cued[at]) and t[0].isalpha() and len(t) > 1 and t[-1] != "." and low[k + 2] != "#":
                yield (t.lower(), CUE, CUE) if cued[at] else (t.lower(), f"{low[k]} {low[k + 1]}", f"{low[k + 3]} {low[k + 4]}")


    def words(self) -> set[str]:
        """The capitalised words outside the formed items, in lower case."""
        return {t.lower() for m in NAMES.finditer(self.text) if (t := m.group())[0].isupper() and not self.taken[m.start()]}


def located(read: Read, revealing: set[str], terms: set[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(begin, end, type) in the field of each item, and of each telling term that is in none."""
    found = [*read.forms, *((a, b, "NAME") for a, b in names(read.text, read.taken, read.cued, revealing))]
    if terms:
        mask = bytearray(read.taken)
        for a, b, _ in found:
            mask[a:b] = b"\x01" * (b - a)
        found += [(m.start(), m.end(), "TERM") for m in TOKEN.finditer(read.text) if (t := m.group())[0].isupper() and not mask[m.start()] and t.lower() in terms]
    return [(*place(read.begins, read.raws, read.sizes, a, b), kind) for a, b, kind in sorted(found)]


def items(raw: str | None, revealing: set[str]) -> list[tuple[str, str, int, int]]:
    """(type, text as in the field, begin, end) of each item."""
    return [(kind, raw[x:y], x, y) for x, y, kind in located(Read(raw), revealing)] if raw else []


def sanitised(raw: str, found: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders."""
    out, at = [], 0
    for x, y, kind in found:
        if x >= at:
            out += [raw[at:x], f"[{kind}]"]
            at = y
    return "".join([*out, raw[at:]])


PLACED = "struct<text: string, begins: array<int>, raws: array<int>, sizes: array<int>, forms: array<struct<a: int, b: int, kind: string>>, cued: array<struct<a: int, b: int>>>"
_INTS = pa.list_(pa.int32())
_PLACED = pa.struct([("text", pa.string()), ("begins", _INTS), ("raws", _INTS), ("sizes", _INTS), ("forms", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string())]))), ("cued", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
_CONTEXTS = pa.list_(pa.struct([("word", pa.string()), ("l", pa.string()), ("r", pa.string())]))


def first_pass(df: DataFrame) -> DataFrame:
    """Every message once, with what is found in its fields by form and cue, its contexts and its capitalised words."""
    who = F.nullif(F.lower(F.regexp_extract("sender", r"([^\s<>\"]+@[^\s<>\"]+)", 1)), F.lit(""))
    once = df.select("msg_id", "body", "snippet", who.alias("who")).groupBy("msg_id", "body", "snippet").agg(F.min("who").alias("who")).select(F.xxhash64("msg_id", "body", "snippet").alias("rid"), "msg_id", "body", "snippet", "who")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields: list[list] = [[], []]
            contexts, words = [], []
            for texts in zip(*(batch.column(i).to_pylist() for i in (2, 3))):
                seen: set[str] = set()
                for i, raw in enumerate(texts):
                    if not raw:
                        fields[i].append(None)
                        continue
                    r = Read(raw)
                    fields[i].append({"text": r.text, "begins": r.begins, "raws": r.raws, "sizes": r.sizes, "forms": [{"a": a, "b": b, "kind": k} for a, b, k in r.forms], "cued": [{"a": a, "b": b} for a, b in r.cued]})
                    seen |= r.words()
                    if not i:
                        contexts.append([{"word": w, "l": x, "r": y} for w, x, y in r.contexts()])
                if not texts[0]:
                    contexts.append([])
                words.append(list(seen))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(f, _PLACED) for f in fields), pa.array(contexts, _CONTEXTS), pa.array(words, pa.list_(pa.string()))], names=["rid", "msg_id", "body", "snippet", "who", "in_body", "in_snippet", "contexts", "words"])

    return once.mapInArrow(rows, f"rid bigint, msg_id string, body string, snippet string, who string, in_body {PLACED}, in_snippet {PLACED}, contexts array<struct<word: string, l: string, r: string>>, words array<string>")


def headed(df: DataFrame) -> DataFrame:
    """(word, h): how often each word stands in a name of a sender or recipient."""
    shown = F.explode(F.array("sender", "recipient"))
    names_ = df.select(shown.alias("x")).filter(F.contains("x", F.lit("<"))).select(F.explode(F.regexp_extract_all(F.substring_index("x", "<", 1), F.lit(r"(\p{L}+(?:['’]\p{L}+)?)"), 1)).alias("word"))
    return names_.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("h"))


def disclosure(contexts: DataFrame, head: DataFrame) -> DataFrame:
    """(word, bits): the information that a word gives about a person being named.

    contexts: word, l, r, one row a place. Two numbers are collected, the share of known words and the mean chance.
    """
    places = checkpointed(contexts.groupBy("word", "l", "r").agg(F.count("*").alias("n")).join(head, "word", "left"))  # read for the contexts and for the words
    known = F.when(F.col("h").isNotNull(), F.col("n")).otherwise(0)
    share = places.agg((F.sum(known) / F.greatest(F.sum("n"), F.lit(1))).alias("s")).first()[0] or 0.0
    prior = lambda c: F.when(F.col(c) == CUE, CUED).otherwise(F.lit(float(share)))
    chance = lambda c: places.groupBy(c).agg(((F.sum(known) + SMOOTH * F.first(prior(c))) / (F.sum("n") + SMOOTH)).alias(f"p_{c}"))
    likely = places.join(chance("l"), "l").join(chance("r"), "r").groupBy("word").agg(F.sum(F.col("n") * F.greatest("p_l", "p_r")).alias("p"), F.sum("n").alias("n"))
    likely = checkpointed(likely)  # a row per word, read for the mean and for the words
    mean = likely.agg(F.sum("p") / F.sum("n")).first()[0] or 0.0
    mean = min(max(float(mean), 1e-6), 1 - 1e-6)
    both = likely.unionByName(head.select("word", (HEADED * F.col("h")).cast("double").alias("p"), (HEADED * F.col("h")).alias("n"))).groupBy("word").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return both.select("word", F.log2(F.col("p") / (F.col("n") - F.col("p") + 1e-9) / F.lit(mean / (1 - mean))).alias("bits"))


def telling_terms(mails: DataFrame, revealing: DataFrame) -> DataFrame:
    """(word): capitalised terms, names left out, that disclose one sender. A number is collected, that of the messages."""
    sent = mails.filter("who is not null")
    total = sent.count()
    persons = sent.groupBy("who").agg(F.count("*").alias("m"))
    terms = sent.select("who", F.explode(F.array_distinct(F.transform("contexts", lambda c: c["word"]))).alias("word"))
    by = terms.groupBy("word", "who").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("all"), F.max(F.struct("n", "who")).alias("top"))
    share = F.col("top.n") / F.col("all")
    some = by.filter((F.col("all") >= TERM_PLACES) & (share >= TERM_SHARE)).select("word", share.alias("share"), "top.who")
    bits = F.log2(F.col("share") / (F.col("m") / F.lit(float(max(total, 1)))))
    return some.join(persons, "who").filter(bits >= TERM_BITS).select("word").join(revealing, "word", "left_anti")


def with_revealing(df: DataFrame, terms: bool = False) -> DataFrame:
    """Messages of the first pass, each with those of its words that reveal persons and, if asked for, its telling terms."""
    mails = checkpointed(first_pass(df))  # read for the contexts, the words and the items
    bits = disclosure(mails.select(F.explode("contexts").alias("c")).select("c.*"), headed(df)).filter(F.col("bits") >= BITS)
    words = mails.select("rid", F.explode("words").alias("word"))
    mine = words.join(bits.select("word"), "word").groupBy("rid").agg(F.collect_set("word").alias("revealing"))
    out = mails.select("rid", "msg_id", "body", "snippet", "in_body", "in_snippet").join(mine, "rid", "left")
    if terms:
        out = out.join(words.join(telling_terms(mails, bits.select("word")), "word").groupBy("rid").agg(F.collect_set("word").alias("terms")), "rid", "left")
    return out.drop("rid")


def _found(batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, list[tuple[int, int, str]]]]:
    """(row, number of the field, raw text, items in it) of a batch of ``with_revealing``, null and empty fields left out."""
    known = [set(w or ()) for w in batch.column(5).to_pylist()]
    terms = [set(w or ()) for w in batch.column(6).to_pylist()] if batch.num_columns > 6 else None
    ids = batch.column(0).to_pylist()
    raws = [batch.column(i).to_pylist() for i in (1, 2)]
    read = [batch.column(i).to_pylist() for i in (3, 4)]
    for k, msg in enumerate(ids):
        for f in (0, 1):
            if raws[f][k]:
                r, x = Read(), read[f][k]
                r.text, r.begins, r.raws, r.sizes = x["text"], x["begins"], x["raws"], x["sizes"]
                r.forms = [(y["a"], y["b"], y["kind"]) for y in x["forms"]]
                r.cued = [(y["a"], y["b"]) for y in x["cued"]]
                r.taken = bytearray(len(r.text))
                for a, b, _ in r.forms:
                    r.taken[a:b] = b"\x01" * (b - a)
                web(r.text, r.taken)
                yield k, f, raws[f][k], located(r, known[k], terms[k] if terms else set())


def find(df: DataFrame) -> DataFrame:
    """(msg_id, field_name, pii_type, pii_text) of each distinct item."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [(ids[k], FIELDS[f], kind, text) for k, f, raw, items_ in _found(b) for kind, text in dict.fromkeys((kind, raw[x:y]) for x, y, kind in items_)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], names=["msg_id", "field_name", "pii_type", "pii_text"])

    return with_revealing(df).mapInArrow(rows, "msg_id string, field_name string, pii_type string, pii_text string").distinct()


def sanitise(df: DataFrame) -> DataFrame:
    """(msg_id, body, snippet) with typed placeholders for items, and [TERM] for other terms that disclose a sender."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [b.column(i).to_pylist() for i in (1, 2)]
            for k, f, raw, found in _found(b):
                made[f][k] = sanitised(raw, found)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m, pa.string()) for m in made)], names=["msg_id", "body", "snippet"])

    return with_revealing(df, terms=True).mapInArrow(rows, "msg_id string, body string, snippet string")
