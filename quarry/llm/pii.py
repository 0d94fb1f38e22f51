"""Personal data by anchor expansion: Aho-Corasick finds anchors, local parsers expand and validate the spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import map_batches

#: Kinds in the order in which spans with equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "url", "ssn", "secret")
RANK = {kind: i for i, kind in enumerate(KINDS)}

Span = tuple[int, int, str]

#: Local parsers, applied at an anchor only.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
SSN = re.compile(r"(?![0-9])|([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
VALUE = re.compile(r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/.=-]{8,})")
KEY_ID = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
#: What an identifier cue announces.
CUES = {
    "iban": IBAN,
    "ssn": SSN,
    "social security": SSN,
    "password": VALUE,
    "passwd": VALUE,
    "token": VALUE,
    "secret": VALUE,
    "api_key": VALUE,
    "apikey": VALUE,
    "akia": KEY_ID,
    "asia": KEY_ID,
}
SCHEMES = ("http://", "https://", "ftp://")
#: Code points between a cue and the identifier it announces.
REACH = 12


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Whether the check digits of an account number hold (ISO 7064, mod 97)."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def build_automaton() -> ahocorasick.Automaton:
    """Anchors over case-folded ASCII: at-signs, digits, plus signs, schemes and identifier cues."""
    anchors = ahocorasick.Automaton()
    for word in ("@", "+", *"0123456789", *SCHEMES, *CUES):
        anchors.add_word(word, word)
    anchors.make_automaton()
    return anchors


class Scanner:
    """Finds spans in texts. The automaton is built where it is used, once for each task."""

    def __init__(self) -> None:
        self.anchors = build_automaton()

    def spans(self, text: str) -> list[Span]:
        """(start, end, kind), ends exclusive in code points, by start and then kind."""
        found: list[Span] = []
        ends = dict.fromkeys(KINDS, 0)  # anchors before these are used up
        address_from = 0
        for last, word in self.anchors.iter(fold(text)):
            first = last - len(word) + 1
            if word == "@":
                self._email(text, first, ends, found)
            elif word == "+":
                self._phone(text, first, ends, found)
            elif len(word) == 1:
                if first >= ends["card"]:
                    self._card(text, first, ends, found)
                if first >= address_from:
                    address_from = self._address(text, first, found)
            elif word in CUES:
                self._identifier(text, first, last + 1, CUES[word], ends, found)
            else:
                self._url(text, first, last + 1, ends, found)
        return sorted(set(found), key=lambda s: (s[0], RANK[s[2]], s[1]))

    @staticmethod
    def _email(text: str, at: int, ends: dict[str, int], found: list[Span]) -> None:
        """Expands left over the local part, not into the email before, and right over dotted labels."""
        start = at
        while start > ends["email"] and LOCAL.match(text, start - 1, start):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end(), "email"))
            ends["email"] = domain.end()

    @staticmethod
    def _phone(text: str, at: int, ends: dict[str, int], found: list[Span]) -> None:
        run = DIALLED.match(text, at)
        if run and 10 <= sum(c.isdigit() for c in run[0]) <= 15:
            found.append((at, run.end(), "phone"))

    @staticmethod
    def _card(text: str, at: int, ends: dict[str, int], found: list[Span]) -> None:
        run = ACCOUNT.match(text, at)
        ends["card"] = run.end() if run else at + 1
        digits = run[0].replace(" ", "").replace("-", "") if run else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((at, run.end(), "card"))

    @staticmethod
    def _address(text: str, at: int, found: list[Span]) -> int:
        """Position from which the next address may start."""
        run = ADDRESS.match(text, at)
        if not run:
            return DIGITS.match(text, at).end()  # a later start in these digits meets what follows them just the same
        if all(part_at_most_255(x) for x in run.groups()):
            found.append((at, run.end(), "ip"))
        return run.end()

    @staticmethod
    def _identifier(text: str, first: int, after: int, parser: re.Pattern[str], ends: dict[str, int], found: list[Span]) -> None:
        """What a cue announces: a value right after it, or the identifier that starts within REACH."""
        if parser is VALUE:
            run = VALUE.match(text, after)
            if run and run.start(1) >= ends["secret"] and any(c.isdigit() for c in run[1]):
                found.append((run.start(1), run.end(), "secret"))
                ends["secret"] = run.end()
        elif parser is KEY_ID:
            run = KEY_ID.match(text, first)
            if run and not text[first - 1 : first].isalnum():
                found.append((first, run.end(), "secret"))
        else:
            for start in range(after, min(len(text), after + REACH)):
                run = parser.match(text, start)
                if not run or not run[0]:
                    continue
                if parser is IBAN and iban_valid(run[0]):
                    found.append((start, run.end(), "iban"))
                    return
                if parser is SSN and run[1] not in ("000", "666") and run[1] < "900" and run[2] != "00" and run[3] != "0000":
                    found.append((start, run.end(), "ssn"))
                    return

    @staticmethod
    def _url(text: str, first: int, after: int, ends: dict[str, int], found: list[Span]) -> None:
        """A URL that names a user: with userinfo, or with an at-sign or an address-like host."""
        rest = REST.match(text, after) if first >= ends["url"] else None
        if not rest:
            return
        ends["url"] = rest.end()
        host = rest[0].partition("/")[0]
        if "@" in rest[0] or ADDRESS.match(host):
            found.append((first, rest.end(), "url"))


def part_at_most_255(digits: str) -> bool:
    """Whether a decimal number, leading zeros allowed, is at most 255; numbers of any length."""
    plain = digits.lstrip("0")
    return len(plain) < 3 or len(plain) == 3 and plain <= "255"


def fold(text: str) -> str:
    """A-Z in lower case, one code point for one."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans (start, end, kind): one row for each row of docs, in one pass over the whole texts.

    Positions are code points, ends exclusive; spans of one kind do not overlap, and of those that would the first one
    stands. Null, empty and blank texts have no spans; a text of any length is read whole, in time linear in it; repeated
    rows and ids keep a row each; an empty table gives no rows; other columns of docs, whatever their names, are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [[{"start": a, "end": b, "kind": k} for a, b, k in scanner.spans(x.as_py() or "")] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "id long, spans array<struct<start:long,end:long,kind:string>>")


def redact(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first one counts."""
    parts, end = [], 0
    for start, stop, kind in spans:
        if start >= end:
            parts += [text[end:start], f"[{kind}]"]
            end = stop
    return "".join(parts) + text[end:]
