"""Newly written text of emails (problem 1).

What a message repeats is found by compression with dictionaries of the text that it could repeat:

* the text of its thread's earlier messages. Every message gives the phrases of all its words (hashed, one of a few
  neighbours); the first owner of each phrase of a thread is a combinable aggregate, and a message receives the whole own
  text of those ancestors with which it shares a phrase that isn't common to many threads;
* the closings of its sender. Every line is counted by sender and over all senders, in all and below closing words or a
  signature's rule; lines that mostly stand there are the dictionary of closings (names, roles, contacts, disclaimers).

Each paragraph is compressed with and without the ancestors. The histogram of all gains (at most ``BINS`` rows) is parted
where its two classes differ most, the usual speech of a thread and copies; a paragraph above is abnormal. Its lines are
then compared word by word with the dictionary, and those that exact overlaps cover are dropped; others stay. A line at
the end of a message that gains by the closings and equals them, or is made of runs of them, is signature or notice.

Besides, the marks of quoting are read line by line: prefixes, indents and HTML containers, introductions
("... wrote:"), header blocks and forward rules. The compression decides where marks don't: copied text without marks,
and where an unmarked quotation ends and the writer goes on.

No thread and no sender is ever collected: a message's dictionaries hold at most an ancestor per phrase of its own, and
lines that are its own.

Defined cases: null and empty bodies have no lines; null subjects join no thread; null senders have only the closings of
all senders; redelivered messages (same id) are one message and give equal lines; a text of any length is read whole, block
by block where it exceeds the compressor's window; ties of time go to the smaller message id; further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.session import checkpointed

#: Words of a phrase and neighbouring phrases of which one is kept: what has K + W - 1 equal words shares a phrase.
K, W = 4, 4
#: A phrase that stands in this share of all threads is common speech and shows no copying; one of two threads always may.
COMMON = 0.005
#: The least gain of a closing line, and bins of the histogram of gains.
GAIN, BINS = 0.3, 50
#: Prior belief about the gains, as (gain, paragraphs): usual speech, and copies.
PRIOR = ((0.2, 20), (0.95, 20))
#: Share of a line's words that must lie in exact overlaps of RUN words or more with the dictionary.
OVERLAP, RUN = 0.5, 4
STRIP = " .,;:()!?\"'<>*"
#: Messages of a sender, or senders, below whose closing words a line must stand to be in the dictionary of closings.
CLOSINGS = 3

# Words of introductions, header fields, greetings and closings in the languages of the mails.
REPLY = r"(?i)^\s*(?:(?:re|r|aw|i|fw|fwd|wg|tr|rif|inoltro)(?:\[\d+\])?\s*:\s*)+"
WROTE = re.compile(r"(?:\bha scritto|\bwrote|\ba écrit|\bha escrito)\s*:\s*$|\bwrote on [\d./ -]+:\s*$|^(?:Am|On|Il|Le)\b.*\bschrieb\b.*:\s*$", re.I)
DATED = re.compile(r"^(?:Il|On|Le|Am|El)\b(?:\s+giorno)?.*\d", re.I)
FROM = re.compile(r"^\W*(?:Da|From|Von|De)\s*:\**\s*(.+)$")
SENT = re.compile(r"^\W*(?:Inviato|Sent|Gesendet|Envoyé|Date|Data|Datum)(?: il)?\s*:", re.I)
FORWARD = re.compile(r"^\W*(?:-+\s*)?(?:-{2,}.*(?:original|originale|inoltrato|forwarded|ursprüngliche|weitergeleitet|transféré|d'origine|nachricht|message|messaggio).*-*|--\s*original\s*--|Begin forwarded message:|Inizio messaggio inoltrato:|Début du message transféré\s*:|Anfang der weitergeleiteten Nachricht:)\s*$", re.I)
RULE = re.compile(r"^\s*(?:[-_*=~#]\s?){2,}\s*$|^\s*--\s*$")
SPLIT = re.compile(r"^(?:\*{3,}|_{5,}|={3,}|~{3,}|#{3,})$")
GREETING = re.compile(r"^(?:ciao|salve|buongiorno|buonasera|gentile|gent\.|egregi|spett|caro|cara|hi|hello|dear|good (?:morning|evening|afternoon)|bonjour|bonsoir|cher|chère|hallo|guten (?:tag|morgen|abend)|sehr geehrt|liebe|lieber)\b", re.I)
CLOSING = re.compile(r"^(?:cordiali saluti|distinti saluti|un saluto|saluti|grazie|a presto|buona giornata|buon lavoro|kind regards|best regards|best wishes|regards|thanks|thank you|many thanks|yours|cheers|cordialement|merci|bien à vous|salutations|bonne journée|viele grüße|mit freundlichen grüßen|beste grüße|freundliche grüße|danke|mfg|vielen dank|schöne grüße)\b[^a-zà-ÿ]*(?:mille|ancora|you|beaucoup|in anticipo|in advance)?[^a-zà-ÿ]*$", re.I)
DEVICE = re.compile(r"^(?:inviato (?:dal|da)|sent from|envoyé de|von meinem|gesendet von)\b", re.I)
CONTACT = re.compile(r"(?i)^(?:tel|telefono|phone|telefon|cell|mob|fon|fax)\b[.:]*\s*[+(\d]|(?:^|[\s|])(?:tel|mob|mobile|cell|phone|fon|t|m|fax|e|e-mail|email|mail|cellulare|telefono)\s*[.:]\s*\S|[\w.+-]+@[\w-]+\.\w+|\bwww\.[\w.-]+|https?://|^\s*[+(]?\d[\d\s().+/-]{6,}$")
PLACE = re.compile(r"(?i)^(?:via|viale|v\.le|v\.|piazza|p\.za|p\.zza|corso|c\.so|largo|vicolo|strada|rue|avenue|place|boulevard|allée|impasse|chemin|quai|\d+(?:\s?bis|\s?[a-z])?,?\s+(?:rue|avenue|place|boulevard|allée|impasse|chemin|quai)\b|\d+[a-z/ ]*,?\s+[A-Z]\w+ (?:street|road|lane|avenue))\b|(?i:\b(?:street|road|lane)\b.*\d*$|(?:weg|straße|strasse|gasse|platz|allee)\b\s*\d+)|\b\d{5}\s+[A-Z]")
TITLE = r"(?:Ing|Dott|Dr|Geom|Arch|Sig|Sig\.ra|Dott\.ssa|Rag|Avv|Prof|Mr|Mrs|Ms|Herr|Frau|M|Mme)\."


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Z}]+", " "))


def thread(subject: Column) -> Column:
    return normal(F.regexp_replace(subject, REPLY, ""))


def sent_at(date: Column, arrived: Column) -> Column:
    """The earlier of the written date, in its notations, and the arrival, which may be late."""
    tries = [F.try_to_timestamp(date, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssX", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss")]
    rfc = F.try_to_timestamp(F.regexp_replace(date, r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.least(F.coalesce(*tries, rfc, arrived), arrived)


def split_lines(body: str) -> list[str]:
    return [x.rstrip("\r") for x in body.split("\n")]


def plain(line: str) -> str:
    return html.unescape(re.sub(r"<[^<>]*>", "", line)).replace("\u00a0", " ")


def words_of(lines: list[str], use: Iterable[int]) -> list[tuple[int, str]]:
    """(line, word) in order; wrapping, quote prefixes, case and punctuation make no difference."""
    return [(i, w) for i in use for x in lines[i].lstrip(" \t>|").split() if (w := x.strip(STRIP).lower())]


def phrases(words: list[tuple[int, str]], upto: int) -> list[tuple[int, bool]]:
    """(hash, own) of the phrases of K words that are least among W neighbours; own: begun before line ``upto``."""
    if not words:
        return []
    plain = [w for _, w in words]
    hashes = [xxhash.xxh3_64_intdigest(" ".join(plain[j : j + K])) >> 1 for j in range(max(1, len(words) - K + 1))]
    kept = {min(hashes[j : j + W]) for j in range(max(1, len(hashes) - W + 1))}
    found: dict[int, bool] = {}
    for h, (i, _) in zip(hashes, words):
        if h in kept and not found.get(h):
            found[h] = i < upto
    return list(found.items())


def is_html(body: str) -> bool:
    return bool(re.search(r"(?i)<(?:html|body|div|p|br|blockquote|span)\b", body))


def texts(body: str) -> tuple[list[str], list[bool]]:
    """The lines as text, and which of them stand in a container for quotations."""
    lines, inside, depth, stack = split_lines(body), [], 0, []
    if not is_html(body):
        return lines, [False] * len(lines)
    out = []
    for line in lines:
        quoted = depth > 0
        for m in re.finditer(r"(?i)<(/?)(blockquote|div)\b([^>]*)>", line):
            if not m[1]:
                holds = m[2].lower() == "blockquote" or "quote" in m[3].lower()
                stack.append((m[2].lower(), holds))
                depth += holds
                quoted |= holds
            elif any(t == m[2].lower() for t, _ in stack):
                while stack:
                    t, holds = stack.pop()
                    depth -= holds
                    if t == m[2].lower():
                        break
        inside.append(quoted)
        out.append(plain(line))
    return out, inside


def name_words(sender: str | None) -> set[str]:
    if not sender:
        return set()
    shown, _, mail = sender.partition("<")
    if "@" in shown:
        mail, shown = shown, ""
    own, _, domain = mail.strip("<> ").partition("@")
    return {w for w in re.findall(r"[^\W\d_]{2,}(?:['’][^\W\d_]+)?", (shown + " " + own).lower())} | {domain.partition(".")[0].lower()} - {""}


def is_name(line: str, known: set[str]) -> bool:
    text = re.sub(TITLE, "", line).strip(" ,.-")
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", text)
    if not 1 <= len(words) <= 4 or re.search(r"[\d@:;!?()/]", text):
        return False
    low = [w.lower() for w in words]
    if all(w in known for w in low):
        return True
    joined = "".join(low)
    return len(words) <= 3 and all(w[0].isupper() for w in words) and not GREETING.match(text) and not CLOSING.match(text) and (any(w in known for w in low) or any(len(k) > 5 and k in joined for k in known) or joined[:1] + low[-1] in known)


def header_at(lines: list[str], i: int) -> bool:
    m = FROM.match(lines[i])
    if not m or not ("@" in m[1] or re.search(r"[A-ZÀ-Ý][^\W\d_]+", m[1]) and not re.search(r"\d{4}", m[1])):
        return False
    return any(SENT.match(x) for x in [y for y in lines[i + 1 : i + 5] if y.strip()][:3])


def intro_lines(lines: list[str], i: int) -> int:
    """Number of lines, wrapped or not, of an introduction that begins at i; 0 if none does."""
    first = lines[i].strip()
    dated = DATED.match(first)
    text = ""
    for n in range(1, len(lines) - i + 1):
        line = lines[i + n - 1].strip()
        if not line:
            break
        text = f"{text} {line}" if text else line
        if line.endswith(":") and WROTE.search(text) and (dated or re.match(r"^[A-ZÀ-Ý\"'<]", text) and len((text.split(":")[0] if n == 1 else text).split()) <= 9):
            return n
        if not dated or text[-1] in ".!?":
            break
    return 0


def marked(lines: list[str], inside: list[bool]) -> tuple[list[str], int]:
    """A mark for each line, 'n' new, 'q' quoted, 'i' introducing, 'b' blank; where an unmarked quotation begins (or the end)."""
    marks, i, indent = [], 0, False
    while i < len(lines):
        text = lines[i]
        bare = text.strip()
        if not bare:
            marks.append("b")
        elif inside[i]:
            marks.append("q")
        elif bare[0] in ">|" or bare.startswith("> "):
            marks.append("q")
            indent = False
        elif indent and text[:1] in " \t":
            marks.append("q")
        else:
            indent = False
            n = intro_lines(lines, i)
            forward = FORWARD.match(bare) and not n
            if n:
                marks += ["i"] * n
                i += n
                after = next((j for j in range(i, len(lines)) if lines[j].strip()), len(lines))
                if after == len(lines):
                    continue
                first = lines[after]
                if inside[after] or first.lstrip()[0] in ">|":
                    continue
                if first[:1] == "\t" or first.startswith("  "):
                    indent = True
                    continue
                return marks + ["q" if x.strip() else "b" for x in lines[i:]], i
            if forward or header_at(lines, i) or RULE.match(bare) and i + 1 < len(lines) and any(header_at(lines, j) for j in (i + 1, i + 2) if j < len(lines) and not any(x.strip() for x in lines[i + 1 : j])):
                return marks + ["i"] + ["q" if x.strip() else "b" for x in lines[i + 1 :]], i + 1
            marks.append("n")
        i += 1
    return marks, len(lines)


def is_firm(line: str, known: set[str]) -> bool:
    """The sender's company: the domain's name with at most a legal form behind it."""
    joined = re.sub(r"[^\w]", "", line.lower())
    return len(line.split()) <= 5 and any(len(k) > 5 and joined.startswith(k) and len(joined) - len(k) <= 6 for k in known)


def is_place(line: str) -> bool:
    """An address on a line of its own."""
    return bool(PLACE.search(line)) and len(line.split()) <= 12 and line[-1:] != "." and not re.search(r"[.;!?:]\s+[A-ZÀ-Ý][^\W\d_]*\s+[a-zà-ÿ]", line) and not re.match(r"[A-ZÀ-Ýa-z]['’]?\w+\s+(?:[a-zà-ÿ'’]+\s+)*(?:è|is|est|ist|va|goes|geht)\s", line)


def signature_at(lines: list[str], new: list[int], known: set[str], closings: "Dictionary") -> int:
    """Position in ``new`` from which the lines of a region are signature and notice."""
    end = len(new)
    sign = lambda i: is_name(lines[i], known) or is_firm(lines[i].strip(), known) or CONTACT.search(lines[i]) and not re.search(r"[.;!?]\s+[A-Z]", lines[i]) or is_place(lines[i].strip())
    while end:
        i = new[end - 1]
        text = lines[i].strip()
        if CLOSING.match(text) or GREETING.match(text) and not closings.explains(text):
            break
        if DEVICE.match(text) or RULE.match(text) or " | " in text or sign(i) or closings.explains(text):
            end -= 1
            continue
        # a line of a signature may be wrapped: look above
        back = [j for j in new[max(0, end - 3) : end - 1] if i - j <= 2 and all(lines[x].strip() for x in range(j, i))]
        if back and (" | " in lines[back[-1]] or lines[back[-1]].rstrip().endswith("|")):
            end -= 1
            continue
        if end > 1 and re.match(r"^[^\W\d_]+(?:-[^\W\d_]+)?[.,]?$", text) and text[0].isupper() and CLOSING.match(lines[new[end - 2]].strip()):
            end -= 1  # a first name below the closing words
            continue
        break
    # a rule begins the signature even if a line below it isn't known, unless that is text with telling numbers
    for p in range(end):
        if re.match(r"^(?:_{5,}|--)\s*$", lines[new[p]]) and not any(re.search(r"[a-z]{2,3}[-_/: ]?\d{6}", lines[j].lower()) for j in new[p:end]):
            return p
    return end


def packed(data: bytes, dictionary: bytes = b"") -> int:
    """Bytes of a text, compressed with a dictionary."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15, 6, zlib.Z_DEFAULT_STRATEGY, dictionary) if dictionary else zlib.compressobj(6, zlib.DEFLATED, -15, 6)
    return len(press.compress(data)) + len(press.flush())


#: What the compressor sees at once, and how much of a text is compressed with one window of its dictionary.
WINDOW, BLOCK = 32_000, 16_000


def gain(text: str, parts: list[str]) -> float:
    """The share of a text's compressed size that a dictionary, in parts, saves; long texts and dictionaries go block by block."""
    data = text.encode()
    if not parts or not data:
        return 0.0
    windows = [b""]
    for p in parts:
        raw = p.encode()
        for at in range(0, len(raw), WINDOW):
            piece = raw[at : at + WINDOW]
            if len(windows[-1]) + len(piece) >= WINDOW:
                windows.append(b"")
            windows[-1] += b" " + piece
    alone = helped = 0
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        alone += (own := packed(block))
        helped += min(own, *(packed(block, w) for w in windows if w)) if any(windows) else own
    return 1 - helped / alone


class Dictionary:
    """Texts that a message may repeat, in parts."""

    def __init__(self, parts: Iterable[str]):
        self.parts = [" ".join(w for x in p.split() if (w := x.strip(STRIP).lower())) for p in parts]
        self.short = set(self.parts)
        self.known: dict[str, bool] = {}

    @cached_property
    def runs(self) -> set[tuple[str, ...]]:
        out: set[tuple[str, ...]] = set()
        for p in self.parts:
            ws = p.split()
            out.update(zip(*(ws[k:] for k in range(RUN))))
        return out

    def covered(self, words: list[str]) -> list[bool]:
        """Which words lie in runs of RUN words that the dictionary has too."""
        out = [False] * len(words)
        for j in range(len(words) - RUN + 1):
            if tuple(words[j : j + RUN]) in self.runs:
                out[j : j + RUN] = [True] * RUN
        return out

    def explains(self, line: str) -> bool:
        """Whether a single line repeats a part: it gains by the dictionary and is one of its parts, or made up of runs of them."""
        if not self.parts:
            return False
        if line not in self.known:
            words = [w for x in line.split() if (w := x.strip(STRIP).lower())]
            text = " ".join(words)
            whole = text in self.short or len(words) > RUN and sum(self.covered(words)) > 0.8 * len(words)
            self.known[line] = bool(words) and whole and gain(text, self.parts) >= GAIN
        return self.known[line]


def blocks_of(lines: list[str], use: list[int]) -> list[list[int]]:
    """Paragraphs: lines that follow each other without a blank one."""
    out: list[list[int]] = []
    for i in use:
        if out and i == out[-1][-1] + 1 and lines[i].strip():
            out[-1].append(i)
        elif lines[i].strip():
            out.append([i])
    return out


def gains(lines: list[str], use: list[int], earlier: Dictionary) -> list[float]:
    """The gain of each paragraph."""
    return [gain(" ".join(w for _, w in words_of(lines, block)), earlier.parts) for block in blocks_of(lines, use)]


def copied_lines(lines: list[str], use: list[int], earlier: Dictionary, gained: list[float], limit: float) -> set[int]:
    """Lines that stand in earlier messages of the thread: those of paragraphs with abnormal gain that exact overlaps cover."""
    if not earlier.parts or not any(g >= limit for g in gained):
        return set()
    words = words_of(lines, use)
    cover = earlier.covered([w for _, w in words])
    hits: dict[int, list[bool]] = {}
    for (i, _), c in zip(words, cover):
        hits.setdefault(i, []).append(c)
    # greetings and closing words are anybody's, and other lines of few words are too short to tell unless they are copied
    hits = {i: h for i, h in hits.items() if (len(h) > RUN or sum(h) >= OVERLAP * len(h)) and not GREETING.match(lines[i].strip()) and not CLOSING.match(lines[i].strip())}
    out: set[int] = set()
    for block, g in zip(blocks_of(lines, use), gained):
        if g >= limit:
            out |= {i for i in block if i in hits and sum(hits[i]) >= OVERLAP * len(hits[i])}
    if not out:
        return out
    # short lines belong to the copied lines that they stand between, after or, as a greeting or rule, before
    solid = [i for i in use if lines[i].strip()]
    for k, i in enumerate(solid):
        if i in hits or i in out:
            continue
        up = next((j for j in reversed(solid[:k]) if j in hits or j in out and not RULE.match(lines[j].strip())), None)
        down = next((j for j in solid[k + 1 :] if j in hits), None)
        text = lines[i].strip()
        if up in out and down in out:
            out.add(i)
        elif up in out and not GREETING.match(text) and not SPLIT.match(text):
            # what follows copied lines, up to a greeting, a dividing rule or a line of its own
            if not any(GREETING.match(lines[j].strip()) or SPLIT.match(lines[j].strip()) for j in solid[solid.index(up) + 1 : k]) and not (down is not None and down not in out and CLOSING.match(text) is None and _flows(lines, i, down)):
                out.add(i)
        elif down in out:
            # from a greeting or dividing rule on, what stands before copied lines
            above = list(reversed([j for j in solid[: solid.index(down)] if up is None or j > up]))
            begin = next((j for j in above if GREETING.match(lines[j].strip()) or SPLIT.match(lines[j].strip())), None)
            tight = all(RULE.match(lines[j].strip()) for j in solid[k : solid.index(down)])
            if tight or begin is not None and i >= begin:
                out.add(i)
    return out


def _flows(lines: list[str], i: int, down: int) -> bool:
    """Whether the line belongs to the paragraph of the line below."""
    return all(lines[j].strip() for j in range(i, down))


def parsed(body: str | None) -> tuple[list[str], str, int]:
    """Lines as text, a mark for each, and where an unmarked quotation begins."""
    lines, inside = texts(body or "")
    marks, unmarked = marked(lines, inside)
    return lines, "".join(marks), unmarked


def asking(lines: list[str], marks: str, unmarked: int) -> list[int]:
    """Lines that no mark shows to be quoted."""
    return [i for i, m in enumerate(marks) if m == "n" or i >= unmarked]


def new_lines(lines: list[str], marked_: str, unmarked: int, sender: str | None, earlier: Dictionary, closings: Dictionary, gained: list[float], limit: float) -> list[int]:
    """Numbers, from 1, of the lines that the sender newly wrote."""
    marks = list(marked_)
    known = name_words(sender)
    new = asking(lines, marked_, unmarked)
    copied = copied_lines(lines, new, earlier, gained, limit)
    for i in copied:
        marks[i] = "q"
    if unmarked < len(lines) and any(i >= unmarked for i in copied) and not any(m == "n" for m in marks[:unmarked]):
        # nothing new stands above the unmarked quotation: below its last copied line the writer may go on
        last = max(copied)
        rest = [i for i in new if i > last and lines[i].strip()]
        begin = next((k for k, i in enumerate(rest) if GREETING.match(lines[i].strip()) or len(words_of(lines, [i])) > RUN), None)
        for i in rest[begin:] if begin is not None else []:
            marks[i] = "n"
    marks = resigned(lines, marks, known, closings)
    # regions of new lines; each that ends the message or stands before a quotation may end in a signature
    out: list[int] = []
    for region in regions(lines, marks):
        out += region[: signature_at(lines, region, known, closings)]
    return [i + 1 for i in out if lines[i].strip()]


def regions(lines: list[str], marks: Iterable[str]) -> Iterator[list[int]]:
    region: list[int] = []
    for i, m in enumerate([*marks, "q"]):
        if m == "n":
            region.append(i)
        elif region and m in "qi":
            yield region
            region = []


def tail_lines(lines: list[str], marks: str) -> list[tuple[str, bool]]:
    """The lines of a message's own text, once each, and whether they stand below closing words, a signature's rule or all else."""
    out: dict[str, bool] = {}
    for region in regions(lines, marks):
        last = next((p for p in range(len(region) - 1, -1, -1) if CLOSING.match(lines[region[p]].strip()) or re.match(r"^(?:_{5,}|--)\s*$", lines[region[p]])), len(region))
        ends = next((p for p in range(len(region) - 1, -1, -1) if lines[region[p]].strip()), 0)
        for p, i in enumerate(region):
            text = " ".join(w for x in lines[i].split() if (w := x.strip(STRIP).lower()))
            if text and not CLOSING.match(lines[i].strip()) and not GREETING.match(lines[i].strip()):
                out[text] = out.get(text, False) or p > last or p == ends
    return list(out.items())


def resigned(lines: list[str], marks: list[str], known: set[str], closings: Dictionary) -> list[str]:
    """Text of two writers without any mark between, and without the earlier one's own message at hand.

    A signature in the middle ends the writer's text if it bears the sender's name, else it ends a quotation.
    """
    new = [i for i, m in enumerate(marks) if m == "n"]
    for p in range(1, len(new) - 2):
        i = new[p]
        text = lines[i].strip()
        if not re.match(r"^(?:--|_{5,})\s*$", text) or any(marks[j] in "qi" for j in range(i, new[-1])):
            continue
        name = lines[new[p + 1]].split(" | ")[0].strip()
        words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", re.sub(TITLE, "", name))
        if not words or len(words) > 5 or re.search(r"\d", name):
            continue
        end = p + 2
        while end < len(new) and (CONTACT.search(lines[new[end]]) or closings.explains(lines[new[end]].strip()) or is_firm(lines[new[end]].strip(), known) or PLACE.search(lines[new[end]].strip()) or RULE.match(lines[new[end]].strip()) or len(lines[new[end]].split()) <= 2 and not GREETING.match(lines[new[end]].strip()) and not re.search(r"\d", lines[new[end]])):
            end += 1
        if end < len(new) and not all(closings.explains(lines[j].strip()) for j in new[end:]):
            mine = is_name(name, known)
            for j in new[p:] if mine else new[:end]:
                marks[j] = "q"
            break
    new = [i for i, m in enumerate(marks) if m == "n"]
    for p in range(2, len(new) - 1):
        # a dividing rule without a notice below it
        if SPLIT.match(lines[new[p]].strip()) and not any(closings.explains(lines[j].strip()) or RULE.match(lines[j].strip()) for j in new[p + 1 : p + 3]) and not any(marks[j] in "qi" for j in range(new[p], new[-1])):
            tail = [j for j in new[max(0, p - 8) : p] if is_name(lines[j].split(" | ")[0], known) or CONTACT.search(lines[j])]
            if any(is_name(lines[j].split(" | ")[0], known) for j in tail):
                for j in new[p:]:
                    marks[j] = "q"
            break
    return marks


def threshold(histogram: dict[int, int]) -> float:
    """The gain that parts the histogram, with the prior belief, into the two classes that differ most."""
    weight = np.zeros(BINS)
    for b, n in histogram.items():
        weight[b] += n
    for g, n in PRIOR:
        weight[int(g * BINS)] += n
    at = (np.arange(BINS) + 0.5) / BINS
    low, total = np.cumsum(weight), np.cumsum(weight * at)
    high = low[-1] - low
    ok = (low > 0) & (high > 0)
    between = np.where(ok, low * high * (total / np.maximum(low, 1) - (total[-1] - total) / np.maximum(high, 1)) ** 2, 0)
    best = np.flatnonzero(between >= between.max() * (1 - 1e-9))
    return float((best.mean() + 1) / BINS)


SAID = "rid bigint, msg_id string, sender string, who string, thread bigint, at timestamp, lines array<string>, marks string, unmarked int, own string, phrases array<struct<h: bigint, own: boolean>>, tails array<struct<line: string, below: boolean>>"


def said(df: DataFrame) -> DataFrame:
    """Every message once, with its lines, their marks, its own text, its phrases and its lines at the end; see ``SAID``."""
    address = F.nullif(F.lower(F.regexp_extract("sender", r"([^\s<>\"]+@[^\s<>\"]+)", 1)), F.lit(""))
    mails = df.select("msg_id", "sender", "body", thread(F.col("subject")).alias("thread"), address.alias("who"), sent_at(F.col("sent_date"), F.col("internal_ts")).alias("at")).filter("body <> ''")
    once = mails.groupBy("msg_id", "body").agg(*[F.min(c).alias(c) for c in ("sender", "who", "thread", "at")])
    rows = once.select(F.xxhash64("msg_id", "body").alias("rid"), "msg_id", "sender", "who", F.when(F.col("thread") != "", F.xxhash64("thread")).alias("thread"), "at", "body")
    kinds = [pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.list_(pa.struct([("h", pa.int64()), ("own", pa.bool_())])), pa.list_(pa.struct([("line", pa.string()), ("below", pa.bool_())]))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body in b.column(6).to_pylist():
                lines, marks, unmarked = parsed(body)
                use = asking(lines, marks, unmarked)
                found = phrases(words_of(lines, use), unmarked)
                out.append((lines, marks, unmarked, "\n".join(lines[i] for i in use if i < unmarked), [{"h": h, "own": o} for h, o in found], [{"line": x, "below": y} for x, y in tail_lines(lines, marks)]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=[x.strip().split(" ")[0] for x in ("rid", "msg_id", "sender", "who", "thread", "at", "lines", "marks", "unmarked", "own", "phrases", "tails")])

    return rows.mapInArrow(read, SAID)


def ancestors(mails: DataFrame) -> DataFrame:
    """(rid, earlier): the own texts of the earlier messages of its thread with which a message shares a telling phrase."""
    told = mails.filter("thread is not null")
    threads = told.agg(F.approx_count_distinct("thread")).first()[0]
    p = told.select("rid", "msg_id", "at", "thread", F.explode("phrases").alias("p")).select("rid", "msg_id", "at", "thread", "p.h", "p.own")
    first = p.filter("own").groupBy("thread", "h").agg(F.min(F.struct("at", "msg_id")).alias("f"))
    # at most phrases per thread / COMMON of them
    common = first.groupBy("h").count().filter(F.col("count") > max(2, COMMON * threads)).select("h")
    pairs = p.select("rid", "msg_id", "thread", "h").join(first, ["thread", "h"]).filter(F.col("f.msg_id") != F.col("msg_id")).join(common, "h", "left_anti").select("rid", F.col("f.msg_id").alias("msg_id")).distinct()
    return pairs.join(told.select("msg_id", "own"), "msg_id").groupBy("rid").agg(F.collect_set("own").alias("earlier"))


def gained(mails: DataFrame, earlier: DataFrame) -> DataFrame:
    """(rid, earlier, gains): the gain of each paragraph of the messages that have ancestors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [gains(lines, asking(lines, marks, unmarked), Dictionary(sorted(e))) for lines, marks, unmarked, e in zip(*(b.column(i).to_pylist() for i in range(2, 5)), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], names=["rid", "earlier", "gains"])

    return earlier.join(mails.select("rid", "lines", "marks", "unmarked"), "rid").select("rid", "earlier", "lines", "marks", "unmarked").mapInArrow(rows, "rid bigint, earlier array<string>, gains array<double>")


def closing_lines(mails: DataFrame) -> DataFrame:
    """(rid, closings): hashes of those of a message's lines that are closings of its sender or of many senders."""
    lines = mails.select("rid", F.coalesce("who", F.lit("")).alias("who"), F.explode("tails").alias("t")).select("rid", "who", F.xxhash64("t.line").alias("line"), F.col("t.below").cast("int").alias("below"))
    by = lines.groupBy("who", "line").agg(F.count("*").alias("n"), F.sum("below").alias("b"))
    mostly = F.col("b") * 2 >= F.col("n")
    many = by.groupBy("line").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count_if((F.col("b") > 0) & (F.col("who") != "")).alias("senders")).filter((F.col("senders") >= CLOSINGS) & mostly).select("line", F.lit(True).alias("many"))
    own = (F.col("who") != "") & (F.col("b") >= CLOSINGS) & mostly
    known = by.join(many, "line", "left").filter(own | F.col("many")).select("who", "line")
    return lines.select("rid", "who", "line").join(known, ["who", "line"], "left_semi").groupBy("rid").agg(F.collect_set("line").alias("closings"))


def new_text(df: DataFrame) -> DataFrame:
    """(msg_id, line_no) of each line of a body that its sender newly wrote."""
    mails = checkpointed(said(df))  # read for both dictionaries and for the decision
    known = checkpointed(gained(mails, ancestors(mails)))  # read for the histogram and for the decision
    bins = F.least(F.floor(F.greatest(F.col("g"), F.lit(0.0)) * BINS), F.lit(BINS - 1)).cast("int")
    limit = threshold({r[0]: r[1] for r in known.select(F.explode("gains").alias("g")).groupBy(bins.alias("bin")).count().collect()})  # at most BINS rows
    tails = F.transform("tails", lambda t: F.when(F.array_contains(F.col("closings"), F.xxhash64(t["line"])), t["line"]))
    whole = mails.join(known, "rid", "left").join(closing_lines(mails), "rid", "left").select("msg_id", "sender", "lines", "marks", "unmarked", "earlier", "gains", F.array_compact(tails).alias("closings"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(m, n) for m, sender, lines, marks, unmarked, e, g, c in zip(*(c.to_pylist() for c in b.columns)) for n in new_lines(lines, marks, unmarked, sender, Dictionary(sorted(e or [])), Dictionary(sorted(c or [])), g or [], limit)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32())], names=["msg_id", "line_no"])

    return whole.mapInArrow(rows, "msg_id string, line_no int").distinct()
