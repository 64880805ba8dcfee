"""Citation occurrences in documents, and the links of short forms.

A block is read by readers, one for each kind of citation, in a fixed order of precedence. Each looks for what gives its kind away
(a number and a reporter, "id.", "v.", a section sign, a rule's number) and reads on from there, forwards and backwards, by a cursor
over characters. What a reader of a lower rank finds is dropped where something was accepted before it; full citations stand even
where they meet.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexloom.functions import text as T
from lexloom.functions.citations import REPORTER

# How far names, tails and quotations may lie from a citation, in characters.
NAME_REACH, TAIL_REACH, FOLLOWED_BY, QUOTE_REACH, QUOTE_GAP, QUOTE_LEAST, QUOTE_MOST = 230, 180, 80, 1500, 450, 5, 1200

#: Longest names on either side of a head's "v." behind their first letter.
TITLE_MOST = 90
#: Longest names on either side of "v.", words of a party that stands alone, digits of a page in a pinpoint and of a first page.
SIDE_MOST, PARTY_WORDS, PIN_DIGITS, PAGE_DIGITS, NOTE_MOST = 101, 9, 7, 9, 120
#: A reporter of the table before a page, and before "at" and a page.
REPORTED = {short: re.compile(rf"({REPORTER})\s+(?={ahead})", re.A) for short, ahead in ((False, "[0-9]"), (True, r"at\s"))}
#: Where what may begin a citation stands, found without a step a character: numbers that no letter or digit is glued to in front, those
#: of a volume, those before a "U"; those behind what the words before a rule's number end in; ends of sentences; marks that open a quotation or end its search.
NUMBER, VOLUME, CODE = (re.compile(rf"(?<![A-Za-z0-9_])[0-9]{x}") for x in ("+", r"{1,4}(?=\s)", r"+(?=\s+U)"))
RULED, SENTENCE_END, OPENING, CLOSING = map(re.compile, (r"[eRP]\.?\s*([0-9]+)", "[.?!](?= )", '[“"]', '[“”"\n]'))
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
CAPITALS, DIGITS, DASHES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset("0123456789"), frozenset("-–")
WORDY = LETTERS | DIGITS | {"_"}
#: What words of a party, whole names, titles of codes and rules, and numbers of sections are made of.
PARTY, TITLE = LETTERS | DIGITS | frozenset("&'’.()-"), LETTERS | frozenset(". ")
NAME, SECTION = PARTY | frozenset(", "), WORDY | frozenset("().–-")
#: Marks of emphasis, which no name has.
MARKS = str.maketrans("", "", "*_")
#: Texts without any of these hold no citation.
HINT = r"\d|(?i:id\.|ibid\.)|\sv\.\s"

OCCURRENCE = (
    "kind string, authority_type string, raw_citation string, case_name string, reporter_citation string, norm_citation string, root string, volume string, reporter string, "
    "first_page string, pincite string, parenthetical string, cited_year string, proposition string, quotation string, start_at int, end_at int"
)
FIELDS = [c.split()[0] for c in OCCURRENCE.split(", ")]
fields_of = attrgetter(*FIELDS)


@dataclass(slots=True)
class Found:
    """One occurrence; fields that a kind doesn't have stay None."""

    kind: str
    authority_type: str
    start_at: int
    end_at: int
    raw_citation: str
    case_name: str | None = None
    reporter_citation: str | None = None
    norm_citation: str | None = None
    root: str | None = None
    volume: str | None = None
    reporter: str | None = None
    first_page: str | None = None
    pincite: str | None = None
    parenthetical: str | None = None
    cited_year: str | None = None
    proposition: str | None = None
    quotation: str | None = None


def single(value: str) -> str:
    return " ".join(value.split())


def reporter_key(value: str) -> str:
    return "".join(x for x in value.lower() if x.isascii() and x.isalnum())


class Cursor:
    """Reads a text by characters: each method takes a place and tells where what it reads there ends, None if it isn't there."""

    def __init__(self, text: str, end: int | None = None) -> None:
        self.text, self.end = text, len(text) if end is None else min(end, len(text))

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.end else ""

    def blank(self, i: int) -> int:
        text, end = self.text, self.end
        while i < end and text[i].isspace():
            i += 1
        return i

    def stripped(self, i: int, least: int = 0) -> int:
        """Where the blanks begin that end at a place."""
        while i > least and self.text[i - 1].isspace():
            i -= 1
        return i

    def gap(self, i: int) -> int | None:
        j = self.blank(i)
        return j if j > i else None

    def run(self, i: int, of: frozenset[str], most: int = 1 << 40) -> int:
        text, stop = self.text, min(self.end, i + most)
        while i < stop and text[i] in of:
            i += 1
        return i

    def back(self, i: int, of: frozenset[str], least: int = 0) -> int:
        """Where the run of characters begins that ends at a place."""
        text = self.text
        while i > least and text[i - 1] in of:
            i -= 1
        return i

    def word(self, i: int, *words: str) -> int | None:
        return next((i + len(w) for w in words if self.text.startswith(w, i, self.end)), None)

    def edge(self, i: int) -> bool:
        """Whether a word may begin or end at a place."""
        return (self.at(i - 1) in WORDY and i > 0) != (self.at(i) in WORDY and i < self.end)

    def pages(self, i: int, note: bool = True) -> int | None:
        """A page or a range of them, starred or not, and with a note's number."""
        first = i + (self.at(i) == "*")
        j = self.run(first, DIGITS, PIN_DIGITS)
        if j == first:
            return None
        if self.at(j) in DASHES and self.at(j):
            k = self.run(j + 1, DIGITS, PIN_DIGITS)
            j = k if k > j + 1 else j
        if note and (k := self.gap(j)) and self.at(k) == "n":
            number = self.blank(k + 1 + (self.at(k + 1) == "."))
            k = self.run(number, DIGITS)
            j = k if k > number else j
        return j

    def bracket(self, i: int, least: int, most: int) -> int | None:
        """A note in round brackets on one line, with so many characters inside."""
        if self.at(i) != "(":
            return None
        j = i + 1
        while j < self.end and self.text[j] not in ")\n":
            j += 1
        return j + 1 if self.at(j) == ")" and least <= j - i - 1 <= most else None


@dataclass
class Block:
    """A block with what was accepted in it, by place."""

    text: str
    taken: list[Found] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.read = Cursor(self.text)
        self._ends: list[int] | None = None
        self._held: list[tuple[int, int]] = []

    def free(self, start: int, end: int) -> bool:
        """Whether nothing accepted meets a span. What is accepted is held by its start, with the farthest end up to there."""
        i = bisect_left(self._held, (end,))
        return i == 0 or self._held[i - 1][1] <= start

    def sentence(self, start: int, end: int) -> str:
        """The sentence around a span: from behind the last end before it to the first end behind it."""
        if self._ends is None:
            self._ends = [m.start() for m in SENTENCE_END.finditer(self.text)]
        before, behind = bisect_left(self._ends, start) - 1, bisect_left(self._ends, end)
        begin = self._ends[before] + 2 if before >= 0 else 0
        stop = self._ends[behind] + 1 if behind < len(self._ends) else len(self.text)
        return single(self.text[begin:stop]) or single(self.text)

    def quotation(self, at: int) -> str | None:
        """The last quoted passage that ends shortly before a place."""
        i, last = max(0, at - QUOTE_REACH), None
        while opening := OPENING.search(self.text, i, at):
            i = opening.start()
            closing = CLOSING.search(self.text, i + 1, at)
            j = closing.start() if closing else at
            if j < at and self.text[j] in "”\"" and QUOTE_LEAST <= j - i - 1 <= QUOTE_MOST:
                last, i = (i + 1, j), j + 1
            else:
                i += 1
        return single(self.text[slice(*last)]) if last and at - last[1] - 1 <= QUOTE_GAP else None

    def name_before(self, at: int) -> tuple[str | None, int]:
        """The case name that ends right before a place, and where it begins; emphasis marks don't count."""
        plain = self.text[max(0, at - NAME_REACH) : at].translate(MARKS)
        stop = len(plain.rstrip())
        if plain[:stop].endswith(","):
            stop = len(plain[: stop - 1].rstrip())
        read = Cursor(plain, stop)
        begin = read.back(stop, NAME, max(plain.rfind(";"), plain.rfind("\n")) + 1)
        i = begin
        while (i := plain.find("v", i + 1, stop)) >= 0:
            # the first "v." with names of a fair length on both sides
            if not plain[i - 1].isspace():
                continue
            other = read.gap(i + 1 + (read.at(i + 1) == "."))
            if other is None or read.at(other) not in CAPITALS or not 2 <= stop - other <= SIDE_MOST:
                continue
            left = len(plain[:i].rstrip())
            start = next((k for k in range(max(begin, left - SIDE_MOST), left) if plain[k] in CAPITALS), None)
            if start is not None:
                # places count in the text without marks, from the citation backwards
                return single(plain[start:stop]), at - len(plain) + start
        return None, at

    def tail(self, at: int) -> tuple[str | None, str | None, int]:
        """Pages and note in brackets behind a citation, and where they end. Pages count only if a sentence or note may follow."""
        read, pages, note, end = Cursor(self.text, at + TAIL_REACH), None, None, at
        i = read.blank(at)
        if read.at(i) == ",":
            i = read.blank(i + 1)
            named = self.text[i : i + 2].lower() == "at" and read.gap(i + 2)
            first = named or i
            if (j := read.pages(first)) and ((k := read.blank(j)) == read.end or read.at(k) in ".;:" or read.bracket(k, 0, TAIL_REACH)):
                pages, end = self.text[first:j], j
        i = read.blank(end)
        if j := read.bracket(i, 2, NOTE_MOST):
            note, end = self.text[i:j], j
        return pages, note, end

    def put(self, f: Found, quoted: bool = True) -> None:
        f.proposition = self.sentence(f.start_at, f.end_at)
        f.quotation = self.quotation(f.start_at) if quoted else None
        self.taken.append(f)
        i = bisect_left(self._held, (f.start_at, f.end_at))
        self._held.insert(i, (f.start_at, max(f.end_at, self._held[i - 1][1] if i else 0)))
        for k in range(i + 1, len(self._held)):
            if self._held[k][1] >= f.end_at:
                break
            self._held[k] = (self._held[k][0], f.end_at)


def _numbers(read: Cursor, of: re.Pattern = NUMBER) -> Iterator[tuple[int, int]]:
    """Where numbers stand that no letter or digit is glued to in front."""
    return (m.span() for m in of.finditer(read.text, 0, read.end))


def _cited(read: Cursor, start: int, end: int, short: bool = False) -> tuple[str, int] | None:
    """The reporter behind a volume's number, and where the page (or "at") that follows begins."""
    if end - start > 4 or (i := read.gap(end)) is None:
        return None
    m = REPORTED[short].match(read.text, i, read.end)
    return (m[1], m.end()) if m else None


def _reporters(block: Block, short: bool) -> Iterator[Found]:
    read, used = block.read, 0
    for start, end in _numbers(read, VOLUME):
        if start < used or not (cited := _cited(read, start, end, short)):  # a page is no volume
            continue
        volume, reporter, i = read.text[start:end], single(cited[0]), cited[1]
        root = f"{int(volume)}:{reporter_key(reporter)}"
        if short:
            first = read.word(i, "at") and read.gap(i + 2)
            if first and (stop := read.pages(first)):
                used = stop
                yield Found("short_form", "case", start, stop, read.text[start:stop], root=root, volume=volume, reporter=reporter, pincite=read.text[first:stop])
        elif (used_to := read.run(i, DIGITS, PAGE_DIGITS)) > i:
            used, page = used_to, read.text[i:used_to]
            pages, note, stop = block.tail(used)
            name, begin = block.name_before(start)
            raw = read.text[begin:stop].strip().lstrip(",*_ \t\n").rstrip("*_ \t\n")
            yield Found("full", "case", begin, stop, raw, name, f"{volume} {reporter} {page}", f"{root}:{int(page)}", root, volume, reporter, page, pages, note, _year(note))


def _year(note: str | None) -> str | None:
    """The last year of three centuries in a note."""
    read = Cursor(note or "")
    years = [note[i:j] for i, j in _numbers(read) if j - i == 4 and note[i : i + 2] in ("18", "19", "20") and read.edge(j)]
    return years[-1] if years else None


def _backward(block: Block) -> Iterator[Found]:
    read, low = block.read, block.text.lower()
    i = low.find("id.")
    while i >= 0:
        start = i - 2 if low.startswith("ib", max(0, i - 2)) and i >= 2 else i
        end = read.blank(i + 3)
        if read.edge(start) and len(low) == len(block.text):
            at = low.startswith("at", end) and read.gap(end + 2)
            stop = at and read.pages(at, note=False)
            yield Found("id", "case", start, stop or end, read.text[start : stop or end], pincite=read.text[at:stop] if stop else None)
        i = low.find("id.", end)


def _names(block: Block) -> Iterator[Found]:
    read, used = block.read, 0
    at = block.text.find("v.")
    while at >= 0:
        found = _parties(read, at, used)
        if found:
            used = found[1]
            near = Cursor(block.text, used + FOLLOWED_BY)
            i = near.blank(used)
            i = near.blank(i + 1) if near.at(i) == "," else i
            number = near.run(i, DIGITS)
            if not (number > i and _cited(near, i, number)):
                text = block.text[slice(*found)]
                yield Found("name_only", "case", *found, text, text)
        at = block.text.find("v.", max(at + 2, used))


def _parties(read: Cursor, at: int, least: int) -> tuple[int, int] | None:
    """The words with capitals on both sides of a "v.": where they begin and end."""
    if at == 0 or not read.text[at - 1].isspace() or (i := read.gap(at + 2)) is None:
        return None
    end = words = 0
    while words < PARTY_WORDS and read.at(i) in CAPITALS and read.at(i):
        j = read.run(i, PARTY)
        last = j
        while last > i and not read.edge(last):
            last -= 1
        end, words = (last if last > i else end), words + 1
        if (nxt := read.gap(j)) is None:
            break
        i = nxt
    start, words, j = None, 0, at
    while words < PARTY_WORDS:
        right = read.stripped(j, least)
        left = read.back(right, PARTY, least)
        if right == j or left == right:
            break
        # a word begins at a capital; in front of the first one other characters may be glued to it
        here = next((k for k in range(left, right) if read.text[k] in CAPITALS and read.edge(k)), None)
        if here is None:
            break
        start, words = here, words + 1
        if here > left or (left > 0 and not read.text[left - 1].isspace()):
            break
        j = left
    return (start, end) if start is not None and end else None


def _titled(read: Cursor, at: int, least: int) -> int | None:
    """Where the title begins whose last word begins at a place: at the first capital of its letters, points and blanks."""
    left = read.stripped(at)
    begin = read.back(left, TITLE, least)
    # a title of one letter needs a blank of its own beside the one before the last word
    last = left if at - left > 1 and read.text[left] == " " else left - 1
    return next((k for k in range(begin, last) if read.text[k] in CAPITALS and read.edge(k)), None) if left < at else None


def _statutes(block: Block) -> Iterator[Found]:
    """Sections of the United States Code by its title's number, of the Michigan Compiled Laws, and of codes and laws that are named."""
    read, found = block.read, []
    for start, end in _numbers(read, CODE):
        i = code = read.gap(end)
        for letter in "USC" if i else ():
            code = i and read.word(i, letter)
            i = code and read.blank(code + (read.at(code) == "."))
        if i:
            i = read.blank(read.run(i, frozenset("§")))
            # without a section the code alone counts, if it ends in a point
            i = i if read.run(i, SECTION) > i else code
            found.append((start, read.run(i, SECTION), i, []))
    at = block.text.find("MCL")
    while at >= 0:
        i = read.gap(at + 3)
        if read.edge(at) and i and read.at(i) in DIGITS and read.at(i):
            found.append((at, read.run(i, SECTION), i, []))
        at = block.text.find("MCL", at + 3)
    at = block.text.find("§")
    while at >= 0:
        left = read.stripped(at)
        word = next((w for w in ("Code", "Laws", "Law") if block.text.endswith(w, 0, left)), None)
        start = _titled(read, left - len(word), 0) if word else None
        i = read.blank(read.run(at, frozenset("§")))
        if start is not None:
            found.append((start, read.run(i, SECTION), i, [left - len(word)]))
        at = block.text.find("§", i)
    yield from _apart(block, found, "statute")


def _rules(block: Block) -> Iterator[Found]:
    """Federal rules of procedure, and rules that a title names."""
    read, found = block.read, []
    for i, j in (m.span(1) for m in RULED.finditer(read.text)):
        left = read.stripped(i)
        mark = left - (block.text[left - 1 : left] == ".")
        start, places = None, []
        word = next((w for w in ("Rule", "R") if block.text.endswith(w, 0, mark)), None)
        if word:
            court = read.stripped(mark - len(word))
            places = [mark - len(word), *([court - 5] if court < mark - len(word) and block.text.endswith("Court", 0, court) else [])]
            start = _first_title(read, places, 0)
        elif block.text.endswith("P", 0, mark):
            at = mark - 1
            for part in (("Civ", "Crim", "App"), ("R",), ("Fed",)):
                before = read.stripped(at)
                before -= block.text[before - 1 : before] == "."
                w = next((w for w in part if block.text.endswith(w, 0, before)), None) if before < at else None
                at = before - len(w) if w else -1
                if at < 0:
                    break
            start = at if at >= 0 and read.edge(at) else None
        if start is not None:
            found.append((start, read.run(j, SECTION), i, places))
    yield from _apart(block, found, "rule")


def _first_title(read: Cursor, places: list[int], least: int) -> int | None:
    return min((x for x in (_titled(read, at, least) for at in places) if x is not None), default=None)


def _apart(block: Block, found: list[tuple[int, int, int, list[int]]], authority: str) -> Iterator[Found]:
    """From left to right, each behind the one before: (start, end, where its number begins, where the last words of its title may begin)."""
    used = 0
    for start, end, number, places in sorted(found):
        begin = start if start >= used else _first_title(block.read, places, used)
        if begin is not None and end > number >= begin:
            used = end
            yield Found("unsupported", authority, begin, end, block.text[begin:end])


def header_of(text: str) -> tuple[str | None, list[str]]:
    """What the head of an opinion tells of it: the first name of two parties, as far as capitals, digits and points go on both sides of a
    "v.", and the reporter citations."""
    block, read, part = Block(text), Cursor(text), PARTY | {" "}
    cites = [f.reporter_citation for f in _reporters(block, short=False)]
    versus = [i for i in range(1, len(text) - 2) if text.startswith("v.", i) and text[i - 1].isspace() and read.at(read.gap(i + 2) or -1) in CAPITALS]
    for start in range(len(text)):
        if not versus or text[start] not in CAPITALS or not read.edge(start):
            continue
        stop = read.run(start, part, TITLE_MOST + 1)
        # the last "v." within reach whose other side is a name of two characters at least
        for i in reversed(versus):
            cut = min(stop, i - 1)
            if cut < start + 2 or not text[cut:i].isspace():
                continue
            other = read.gap(i + 2)
            end = read.run(other, part, TITLE_MOST + 1)
            while end > other + 1 and not read.edge(end):
                end -= 1
            if end >= other + 2:
                return text[start:end], cites
    return None, cites


def occurrences_in(text: str) -> list[Found]:
    """The occurrences of one block by place."""
    block = Block(text)
    for f in _reporters(block, short=False):
        block.put(f)
    for found, quoted in ((_reporters(block, short=True), True), (_backward(block), True), (_names(block), True), (_statutes(block), False), (_rules(block), False)):
        for f in found:
            if block.free(f.start_at, f.end_at):
                block.put(f, quoted)
    return sorted(block.taken, key=lambda f: (f.start_at, f.end_at))


class Links:
    """The links of one document's occurrences, one after the other; the same as link_short_forms()."""

    def __init__(self) -> None:
        self.last: int | None = None
        self.kind = "case"
        self.roots: dict[str, int] = {}

    def of(self, f: Found, seq: int) -> int | None:
        linked = self.last if f.kind == "id" else self.roots.get(f.root) if f.kind == "short_form" and f.root else None
        if f.kind == "id":
            f.authority_type = self.kind
        self.kind, self.last = f.authority_type, seq
        if f.root:
            self.roots[f.root] = seq
        return linked


def occurrences(docs: DataFrame, key: str = "doc_id", blocks: Column | None = None, link: bool = False) -> DataFrame:
    """One row per citation of every document, numbered in the order of blocks and places: key, block_no, seq, occ_id, and the fields.

    blocks: an array of a document's block texts; by default the paragraphs of text. A map over documents: the numbers come
    from the document's own array, and blocks without a digit, 'Id.' or ' v. ' never reach Python. Reading takes far longer than
    sending, so documents are dealt out evenly, however few files and row groups they come from.
    link: with linked_seq and the types of id's, as link_short_forms() gives them.
    """
    given = blocks if blocks is not None else T.paragraphs(F.col("text"))
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, block_no int, seq int, occ_id string, {OCCURRENCE}" + (", linked_seq int" if link else "")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in target]
            for doc, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seq, links = 0, Links()
                for block in held or ():
                    for f in occurrences_in(block["text"]):
                        seq += 1
                        linked = (links.of(f, seq),) if link else ()
                        for col, v in zip(cols, (doc, block["no"], seq, f"C{seq:04d}", *fields_of(f), *linked), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(cols, target, strict=True)], schema=target)

    numbered = F.transform(given, lambda x, i: F.struct((i + 1).cast("int").alias("no"), x.alias("text")))
    likely = F.filter(numbered, lambda x: x["text"].rlike(HINT))
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    return docs.select(F.col(key), likely.alias("held")).where(F.size("held") > 0).repartition(tasks).mapInArrow(run, schema)


def link_short_forms(occ: DataFrame, key: str = "doc_id") -> DataFrame:
    """linked_seq: for id the occurrence just before, of whatever kind; for a short form the latest earlier one of its root.

    An id is of the type of what stands before it, so along a chain of them of the last other occurrence's: case if none is.
    """
    before = Window.partitionBy(key).orderBy("seq")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(key, "root").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    short = (F.col("kind") == "short_form") & F.col("root").isNotNull()
    linked = F.when(F.col("kind") == "id", F.lag("seq").over(before)).when(short, F.max("seq").over(same))
    chained = F.last(F.when(F.col("kind") != "id", F.col("authority_type")), ignorenulls=True).over(past)
    kind = F.when(F.col("kind") == "id", F.coalesce(chained, F.lit("case"))).otherwise(F.col("authority_type"))
    return occ.withColumn("linked_seq", linked).withColumn("authority_type", kind)


def anchors(occ: DataFrame, key: str = "doc_id") -> DataFrame:
    """anchor: the occurrence that an occurrence stands for.

    Full ones stand for themselves, short forms for the latest earlier full one of their root (or for none), id for what the
    last other occurrence stands for, even if that is none.
    """
    past = lambda *by: Window.partitionBy(key, *by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("kind") == "full", F.col("seq"))).over(past("root"))
    own = F.when(F.col("kind") == "short_form", latest).when(F.col("kind") != "id", F.col("seq"))
    wrapped = F.when(F.col("kind") != "id", F.struct(own.alias("a")))
    out = occ.withColumn("_own", wrapped)
    return out.withColumn("anchor", F.when(F.col("kind") == "id", F.last("_own", ignorenulls=True).over(past())["a"]).otherwise(F.col("_own.a"))).drop("_own")
