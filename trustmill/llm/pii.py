"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits, URL schemes and identifier cues. A small parser
for each kind expands an anchor to its left and right and validates what it has found. Scans run left to right, and a
kind's matches don't overlap.

Defined results: null and empty texts have no spans; positions are code points of the whole text, ends exclusive; repeated
rows are judged separately; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
#: Words that announce an identifier, in the cases people write them.
CUES = ("account", "acct", "iban", "ssn", "passport", "customer id", "member id")
#: Kinds in the order of a document's spans; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "account", "address")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in ("@", "+", *sorted(DIGITS), "://"):
        found.add_word(x, (x if x in "@+" else "d" if x in DIGITS else "s", len(x)))
    for cue in CUES:
        for x in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(x, ("c", len(x)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _run(text: str, at: int, chars: frozenset[str]) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the at-sign at `at`; the name can't reach below floor."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end, labels = _run(text, end + 1, LABEL), labels + 1
    return (start, end) if labels else None


def ip_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """Four numbers with dots from the first digit at `at`; whether each is at most 255."""
    fits, end = True, at
    for k in range(4):
        if k:
            if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in DIGITS:
                return None
            end += 1
        begin, end = end, _run(text, end, DIGITS)
        part = text[begin:end].lstrip("0")
        fits = fits and len(part) <= 3 and int(part or 0) <= 255
    return at, end, fits


def card_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """Digits with single blanks or hyphens between them."""
    n, end = len(text), at + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    if end == at + 1:
        return None
    digits = "".join(c for c in text[at:end] if c in DIGITS)
    return at, end, 16 <= len(digits) <= 19 and luhn(digits)


def phone_at(text: str, at: int) -> tuple[int, int, bool] | None:
    """A plus sign, a digit, and more of them up to the last digit of the run."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 2 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return at, end, 8 <= sum(c in DIGITS for c in text[at:end]) <= 15


def account_at(text: str, cue_end: int) -> tuple[int, int] | None:
    """The identifier that a cue announces: 6 to 34 letters and digits with at least four digits."""
    n, at = len(text), cue_end
    if at < n and text[at] in ALNUM:
        return None
    for word in (" number", " no", " nr"):
        if text[at : at + len(word)].lower() == word:
            at += len(word)
            break
    while at < n and at < cue_end + 16 and text[at] in " .:=#":
        at += 1
    end, own = at, 0
    while own <= 34 and end < n and (text[end] in ALNUM or text[end] in "-" and end + 1 < n and text[end + 1] in ALNUM):
        own += text[end] in ALNUM
        end += 1
    return (at, end) if at > cue_end and 6 <= own <= 34 and sum(c in DIGITS for c in text[at:end]) >= 4 else None


def address_at(text: str, at: int) -> tuple[int, int] | None:
    """A URL whose authority names a user: scheme://user[:...]@host."""
    start = at
    while start and text[start - 1] in ALNUM:
        start -= 1
    end, n = at + 3, len(text)
    while end < n and not text[end].isspace() and text[end] not in "/?#\"'<>":
        end += 1
    user, sign, host = text[at + 3 : end].rpartition("@")
    while host and host[-1] in ".,;:)":
        host = host[:-1]
    return (start, at + 3 + len(user) + 1 + len(host)) if start < at and sign and user and host else None


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind, then start."""
    found: list[tuple[int, int, int]] = []
    after = [0] * len(KINDS)  # where the next match of a kind can start
    ip_to = 0
    for last, (sort, size) in anchors.iter(text):
        at = last - size + 1
        if sort == "d":
            if at >= after[2]:
                got = card_at(text, at)
                if got:
                    after[2] = got[1]
                    if got[2]:
                        found.append((2, at, got[1]))
            if at >= after[1] and at >= ip_to:
                got = ip_at(text, at)
                if got:
                    after[1] = got[1]
                    if got[2]:
                        found.append((1, at, got[1]))
                else:
                    ip_to = _run(text, at, DIGITS)  # later digits of this run fail alike
        elif sort == "@":
            if at >= after[0] and (span := email_at(text, at, after[0])):
                after[0] = span[1]
                found.append((0, *span))
        elif sort == "+":
            if at >= after[3] and (got := phone_at(text, at)):
                after[3] = got[1]
                if got[2]:
                    found.append((3, at, got[1]))
        elif sort == "c":
            if at >= after[4] and not (at and text[at - 1] in ALNUM) and (span := account_at(text, last + 1)):
                after[4] = span[1]
                found.append((4, *span))
        elif at >= after[5] and (span := address_at(text, at)):
            after[5] = span[1]
            found.append((5, *span))
    found.sort()
    return found


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end), by kind as in KINDS, then start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans(x.as_py() or "", anchors)] for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")
