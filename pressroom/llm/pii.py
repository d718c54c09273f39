"""Personal data: offset-preserving deobfuscation.

Two passes look for e-mail addresses, IP addresses, card numbers and phone
numbers. The first reads the source text. The second reads what a chain of
transducers makes of it (homoglyphs, spelled digits, at/dot disguises); each
transducer rewrites the text and keeps, for every character it emits, the source
characters that it stands for, so that a span found in the rewritten text maps
back to the characters of the source.

An address spoken with `at` needs more than that word, as prose has it too: a spelled or bracketed dot, `arroba`,
a word like mail or contact before it, or a usual ending of a domain, where the word before is none that goes with `at` anyway
(look at example.com). Endings are letters, so a price or a time is none.

Defined results: a null or empty text has no spans. Repeated rows are searched one
by one. Offsets are code points, ends exclusive. A span of the second pass is kept
unless one of the same kind of the first covers it; where it reaches further, both are given and redact takes their union. Spans are ordered by
kind, start and end, so ties have one order. An empty table gives no rows. Very long texts are searched whole, in time in proportion to their length whatever
they hold, and few at a time. Columns other than doc_id and text are not read by find_personal_data and are passed on by redact.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.llm.common import pieces, texts

KINDS = ("email", "ip", "card", "phone")

#: An address is looked for from its @ on, to both sides: a pattern for the whole would try every place of a long word.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match never begins within a run of digits: one that begins with the run comes before it.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts that look like ASCII ones, and the ASCII ones.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХаеѕіјорсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν",
        "ABESIJKMHOPCTXaesijopcyxdqwABEZHIKMNOPTYXoav",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"

#: Names of the digits in the languages of the corpus.
SPELLED = {
    word: str(digit)
    for digit, words in enumerate(
        (
            "zero null zéro cero", "one un une uno eins ein", "two deux dos zwei", "three trois tres drei", "four quatre cuatro vier",
            "five cinq cinco fünf", "six seis sechs", "seven sept siete sieben", "eight huit ocho acht", "nine neuf nueve neun",
        )
    )
    for word in words.split()
}
#: As many named digits in a row are read as a number; fewer are ordinary prose.
LEAST_SPELLED = 4

_named = "|".join(sorted(SPELLED, key=len, reverse=True))
_dot = r"(?:dot|point|punto|punkt)"
_unit = rf"(?:{_named}|[0-9]+|plus|{_dot})"
SPELLED_RUN = re.compile(rf"(?<!\w){_unit}(?:[\s,-]+{_unit})*(?!\w)", re.IGNORECASE)
UNIT = re.compile(_unit, re.IGNORECASE)

_open, _close = r"[\[({<]\s*", r"\s*[\])}>]"
BRACKETED_AT = re.compile(rf"{_open}(?:at|arroba|@){_close}", re.IGNORECASE)
BRACKETED_DOT = re.compile(rf"{_open}(?:{_dot}|\.){_close}", re.IGNORECASE)
AT_WORDS = ("at", "arroba")
DOT_WORDS = ("dot", "point", "punto", "punkt")
SPELLED_NEXT = {*SPELLED, *DOT_WORDS}
#: Where an address may be spoken: the sign or word, and the first label of a domain with a dot behind it.
SPOKEN_HINT = re.compile(rf"(?:\s(at|arroba)\s+|@)(?=[A-Za-z0-9-]+(?:\s+{_dot}\s+|\.)[A-Za-z0-9-])", re.IGNORECASE)
#: The name before it: words and dots, spelled or not, of so many characters at most.
REACH = 200
SPOKEN_NAME = re.compile(rf"(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:(?:\.|\s+{_dot}\s+)[A-Za-z0-9_%+-]+)*$", re.IGNORECASE)
#: The labels after it, so many at most.
LABELS = 8
SPOKEN_LABEL = re.compile(rf"(\s+{_dot}\s+|\.)(?!{_dot}\b)([A-Za-z0-9-]+)", re.IGNORECASE)
FIRST_LABEL = re.compile("[A-Za-z0-9-]+")
SPOKEN_DOT = re.compile(rf"\s+{_dot}\s+", re.IGNORECASE)
ENDING = re.compile(r"[A-Za-z]{2,24}")
#: Usual endings of domains, words that announce an address, and words that go with `at` in prose.
ENDINGS = frozenset("com org net edu gov info biz io eu de fr es it uk us ca mx ar cl co ch at be nl pl pt se dk no fi ie".split())
CUE = re.compile(r"\b(?:e-?mails?|mails?|contact|reach|write|address|courriel|adresse|correo|escrib\w*|kontakt|schreib\w*)\b", re.IGNORECASE)
PROSE = frozenset("look looks looked looking see seen find found available hosted online live visit more read here sold is are was were be start starts started".split())
FOREIGN = re.compile(rf"[{''.join(LOOKALIKES)}{INVISIBLE}！-～]|(?![0-9])\d")
SEPARATORS = str.maketrans("-,", "  ")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _accept(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))
    digits = "".join(DIGIT.findall(found))
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Spans of LOCAL characters, @ and a domain with a dot, leftmost and not overlapping."""
    last, sign = 0, text.find("@")
    while sign >= 0:
        start = last + len(text[last:sign].rstrip(LOCAL))
        found = DOMAIN.match(text, sign + 1) if start < sign else None
        if found:
            yield start, found.end()
        # What stands before a sign is in no address of a later one but for the rest of this domain.
        last = found.end() if found else sign + 1
        sign = text.find("@", last)


def detect(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plainly written identifiers, leftmost and not overlapping within a kind."""
    spans = []
    digits = DIGIT.search(text) is not None
    spans += [("email", *span) for span in _addresses(text)]
    for kind, pattern, possible in (
        ("ip", IP, digits and "." in text),
        ("card", CARD, digits),
        ("phone", PHONE, digits and "+" in text),
    ):
        if possible:
            spans += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _accept(kind, m.group())]
    return spans


class Tape:
    """A text under rewriting; starts[i], ends[i]: the source characters that character i stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Put a string in place of each [start, end); the edits are in order and do not overlap."""
        if not edits:
            return
        pieces, starts, ends, at = [], [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            pieces += (self.text[at:start], new)
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            if new:
                starts += [self.starts[start]] * len(new)
                ends += [self.ends[end - 1]] * len(new)
            at = end
        self.text, self.starts, self.ends = "".join(pieces), starts, ends


def _plain_character(char: str) -> str:
    if char in INVISIBLE:
        return ""
    if "！" <= char <= "～":
        return chr(ord(char) - 0xFEE0)
    return LOOKALIKES.get(char) or str(unicodedata.decimal(char, char))


def homoglyphs(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), _plain_character(m.group())) for m in FOREIGN.finditer(tape.text)])


def spelled_digits(tape: Tape) -> None:
    edits = []
    for run in SPELLED_RUN.finditer(tape.text):
        units = list(UNIT.finditer(tape.text, run.start(), run.end()))
        if sum(u.group().lower() in SPELLED for u in units) < LEAST_SPELLED:
            continue
        for place, unit in enumerate(units):
            if place:
                edits.append((units[place - 1].end(), unit.start(), ""))
            word = unit.group().lower()
            new = SPELLED.get(word) or ("+" if word == "plus" else word if word.isdigit() else ".")
            edits.append((unit.start(), unit.end(), new))
    tape.rewrite(edits)


def _bracketed(tape: Tape, pattern: re.Pattern, new: str) -> bool:
    """Put `new` in place of what the pattern finds and the white space around it."""
    text, edits, last = tape.text, [], 0
    for m in pattern.finditer(text):
        start, end = m.span()
        while start > last and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        edits.append((start, end, new))
        last = end
    tape.rewrite(edits)
    return bool(edits)


def _spoken(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Edits that make plain addresses of spoken ones, for each of them."""
    last = 0
    for hint in SPOKEN_HINT.finditer(text):
        if hint.start() < last:
            continue
        name = SPOKEN_NAME.search(text, max(last, hint.start() - REACH), hint.start())
        first = FIRST_LABEL.match(text, hint.end())
        if not name or not first:
            continue
        labels = []
        at = first.end()
        while len(labels) < LABELS and (label := SPOKEN_LABEL.match(text, at)):
            labels.append(label)
            at = label.end()
        word = (hint.group(1) or "@").lower()
        sure = word != "at" or SPOKEN_DOT.search(name.group()) is not None
        cued = CUE.search(text, max(0, name.start() - 60), name.start()) is not None
        while labels:
            ending, after = labels[-1].group(2), labels[-1].end()
            spelled = sure or any(x.group(1) != "." for x in labels)
            usual = ending.lower() in ENDINGS and name.group().lower() not in PROSE
            if ENDING.fullmatch(ending) and (spelled or cued or usual) and not (after < len(text) and (text[after].isalnum() or text[after] == "_")):
                break
            labels.pop()
        if labels:
            dots = [m.span() for m in SPOKEN_DOT.finditer(name.group())]
            last = labels[-1].end()
            yield [
                *((name.start() + a, name.start() + b, ".") for a, b in dots),
                (hint.start(), hint.end(), "@"),
                *((*x.span(1), ".") for x in labels if x.group(1) != "."),
            ]


def at_and_dot(tape: Tape, spoken: bool) -> None:
    signs = _bracketed(tape, BRACKETED_AT, "@")
    dots = _bracketed(tape, BRACKETED_DOT, ".")
    if spoken or signs or dots:
        tape.rewrite([edit for address in _spoken(tape.text) for edit in address])


def _beyond_latin(text: str) -> bool:
    """Cheap test: homoglyphs, fullwidth forms and foreign digits all lie outside Latin-1, bar the soft hyphen."""
    if "\u00ad" in text:
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


def disguised(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Source spans of the identifiers that only the rewritten text shows.

    Each transducer runs on texts that hold what it rewrites; the tests before it only look for that.
    """
    tape = Tape(text)
    if _beyond_latin(text):
        homoglyphs(tape)
    lower = tape.text.lower()
    words = lower.translate(SEPARATORS).split()
    if not SPELLED.keys().isdisjoint(words) and any(
        a in SPELLED and b in SPELLED_NEXT for a, b in zip(words, words[1:], strict=False)
    ):
        spelled_digits(tape)
    spoken = not {*AT_WORDS, *DOT_WORDS}.isdisjoint(words)
    if spoken or any(c in lower for c in "[({<") and (BRACKETED_AT.search(lower) or BRACKETED_DOT.search(lower)):
        at_and_dot(tape, spoken)
    if tape.text == text:
        return []
    found = [(kind, tape.starts[start], tape.ends[end - 1]) for kind, start, end in detect(tape.text)]
    return _uncovered(found, plain)


def _uncovered(found: list[tuple[str, int, int]], plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The found spans, in order of starts within a kind, that no plain one of the kind covers."""
    ends = {kind: [(a, b) for k, a, b in plain if k == kind] for kind in KINDS}
    starts = {kind: [a for a, _ in spans] for kind, spans in ends.items()}
    out = []
    for kind, a, b in found:
        # Plain spans of a kind do not overlap, so only the last that begins at or before a can cover it.
        at = bisect_right(starts[kind], a) - 1
        if at < 0 or ends[kind][at][1] < b:
            out.append((kind, a, b))
    return out


def spans_of(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it was plainly written), by kind as in KINDS, then by start."""
    plain = detect(text)
    found = [(*s, True) for s in plain] + [(*s, False) for s in disguised(text, plain)]
    return sorted(found, key=lambda s: (KINDS.index(s[0]), *s[1:3]))


def redacted(text: str) -> str:
    """Every found span becomes its kind in brackets; overlapping spans become one, of the first one's kind."""
    pieces, at = [], 0
    merged: list[list] = []
    for kind, start, end, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        pieces += (text[at:start], f"[{kind.upper()}]")
        at = end
    return "".join(pieces) + text[at:] if merged else text


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("plain", T.BooleanType()),
        ]
    )
)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end, plain>> of every document; no shuffle."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())])
        for batch in pieces(batches):
            spans = [
                [dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in spans_of(text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["doc_id", "spans"])

    return texts(docs).mapInArrow(find, T.StructType([docs.schema["doc_id"], T.StructField("spans", SPANS)]))


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """The same table with personal data in `column` replaced; a null text stays null."""

    place = docs.columns.index(column)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, place):
            said = [None if text is None else redacted(text) for text in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(said, batch.schema.field(place).type))

    return docs.mapInArrow(clean, docs.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's digests, derived from find_personal_data over the whole documents table."""
    from pressroom.llm.common import read

    found = find_personal_data(read(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2(joined(plain).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(plain)).cast("long").alias("n_disguised"),
    )
