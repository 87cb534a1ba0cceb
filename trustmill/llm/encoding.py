"""Whole texts to token ids, by the tokenizers library, inside Spark's Python workers.

A byte-level BPE never merges across the blank that starts a word. So each text is cut before every blank that a
non-blank follows, and each distinct part is encoded once for a worker. New parts are encoded many at a time, joined by
blanks to one text, whose ids part where an id starts with a blank.

Arrow splits a whole column and numbers its parts together with the remembered ones, so only new parts become Python strings;
ids are gathered by those numbers. Punctuation behind a letter or digit is never merged with it and is encoded apart. Texts with
other white space than single blanks and line feeds are encoded one by one.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import give_back

#: Parts that a worker remembers in each of two generations: a full one becomes the old one, parts used again move on.
CACHE_ENTRIES = 350_000
CACHE_CHARS = 6_000_000
#: Parts of columns, and bytes of them, that a worker remembers; beyond, those used since the last time stay.
REMEMBERED = 1_000_000
REMEMBERED_BYTES = 32_000_000
#: Bytes of text that are encoded as one column.
COLUMN_BYTES = 16_000_000
#: Bytes of text that become Python strings at once, but for a longer text.
SLICE_BYTES = 6_000_000
ENCODED_AT_ONCE = 1024
#: After a column of more bytes, freed memory goes back at once: a task's next columns would add to what is held.
GIVEN_BACK_BYTES = 1_000_000
#: Runs of ids that are gathered at once.
GATHERED_AT_ONCE = 1 << 16
#: Parts of one text that the library encodes.
JOINED = 128

#: How a byte-level vocabulary writes a blank and a line feed.
LEADS = {" ": "\u0120", "\n": "\u010a"}
_CUT = re.compile(r" (?=\S)")
#: A part without anything, or with white space but a line feed.
_ODD_PART = r"^$|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: A byte-level BPE never merges these with a letter before them.
MARKS = tuple(".,;:!?")
#: Nor a run of these with a letter or digit before it; without what the special token consists of.
TAIL = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
_ALNUM = np.array([chr(k).isascii() and chr(k).isalnum() for k in range(256)])


def gather(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray, index: np.ndarray | None = None) -> np.ndarray:
    """The runs of the pool that begin there, one behind the other; with an index, those that it names, in its order.

    Block by block, so that only the result is as long as all runs.
    """
    total = int((sizes if index is None else sizes[index]).sum(dtype=np.int64))
    out, filled = np.empty(total, pool.dtype), 0
    for k in range(0, len(sizes if index is None else index), GATHERED_AT_ONCE):
        some = slice(k, k + GATHERED_AT_ONCE) if index is None else index[k : k + GATHERED_AT_ONCE]
        own = sizes[some]
        ends = np.cumsum(own, dtype=np.int64)
        n = int(ends[-1])
        # places in the pool; half as wide where they fit
        kind = np.int32 if max(len(pool), n) < 1 << 31 else np.int64
        source = np.repeat((begins[some] - (ends - own)).astype(kind), own)
        source += np.arange(n, dtype=kind)
        pool.take(source, out=out[filled : filled + n], mode="clip")  # all places are in the pool; else numpy makes another copy
        filled += n
    return out


def without_tails(parts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, pa.StringArray]:
    """Parts without the punctuation behind a last letter (Latin) or digit; where some was cut, and those cut ends."""
    if not len(parts):
        return parts, np.zeros(0, bool), parts
    bases = pc.ascii_rtrim(parts, characters=TAIL)
    offsets, data = (np.frombuffer(b, kind) for b, kind in zip(parts.buffers()[1:], (np.int32, np.uint8)))
    offsets = offsets[parts.offset : parts.offset + len(parts) + 1]
    left, sizes = pc.binary_length(bases).to_numpy(), np.diff(offsets)
    at = np.flatnonzero((left > 0) & (left < sizes))
    ends = offsets[at] + left[at]
    last, before = data[ends - 1], np.where(left[at] > 1, data[ends - 2], 0)
    # two bytes: letters from U+00C0 to U+023F
    at = at[_ALNUM[last] | (last >= 0x80) & (before >= 0xC3) & (before <= 0xC8) & ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7)))]
    cut = np.zeros(len(parts), bool)
    cut[at] = True
    own = (sizes - left)[at]
    tails = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, np.cumsum(own)].astype(np.int32)), pa.py_buffer(gather(data, (offsets[:-1] + left)[at], own)))
    return pc.if_else(pa.array(cut), bases, parts), cut, tails


class Encoder:
    """Ids of texts for one tokenizer file, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = {lead: np.zeros(max(vocabulary.values(), default=0) + 1, bool) for lead in LEADS}
        for lead, written in LEADS.items():
            self.leads[lead][[k for x, k in vocabulary.items() if x.startswith(written)]] = True
        self.known: tuple[dict[str, bytes], ...] = ({}, {})  # parts that start a text, and parts that a blank precedes
        self.old: tuple[dict[str, bytes], ...] = ({}, {})
        self.marks = dict(zip(MARKS, self._alone(list(MARKS))))
        self.chars = 0
        # of columns: parts that a blank precedes or that start with a line feed, where their ids lie in the pool, which were used of late
        self.names = pa.array([], pa.string())
        self.pool = np.zeros(0, "<u4")
        self.begins, self.sizes, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat(self, parts: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, each behind its lead, a character that isn't in them, and how many each has: encoded as longer texts, cut where ids start with the lead."""
        texts = [lead + lead.join(parts[k : k + JOINED]) for k in range(0, len(parts), JOINED)]
        ids = np.fromiter(chain.from_iterable(self._ids(texts)), "<u4")
        starts = np.flatnonzero(self.leads[lead][ids])
        if len(starts) == len(parts):
            return ids, np.diff(starts, append=len(ids))
        return self._flat_alone([lead + x for x in parts])

    def _flat_alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(texts)
        return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))

    def _together(self, parts: list[str], lead: str) -> list[bytes]:
        return _cut_up(*self._flat(parts, lead))

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self._ids(texts)]

    def _local(self, parts: list[str], rest: int) -> list[bytes]:
        """The ids of these distinct parts, of which new ones are encoded and remembered.

        rest 0: they start a text; 1: a blank precedes them, unless they start with a line feed.
        """
        known, old = self.known[rest], self.old[rest]
        found = list(map(known.get, parts))
        at = [k for k, ids in enumerate(found) if ids is None]
        if not at:
            return found
        new = list(map(parts.__getitem__, at))
        words, lines, marked, odd = [], [], [], []
        for k, x, ids in zip(at, new, map(old.get, new)):
            if ids is not None:
                known[x] = found[k] = ids
            elif not rest:
                odd.append(x)
            elif x.isalpha():
                words.append(x)
            elif x[-1:] in MARKS and ((base := x[:-1]).isalpha() or x[0] == "\n" and base[1:].isalpha()) and (x.isascii() or max(x) < "\u0250"):
                marked.append((k, base))
            elif not x or " " in x or "<" in x:
                odd.append(x)
            elif x[0] == "\n":
                (lines if len(x) > 1 and not x[1].isspace() and "\n" not in x[1:] else odd).append(x)
            else:
                (odd if x[0].isspace() else words).append(x)
        bases = {base for _, base in marked if base not in known}
        if bases:
            bases.difference_update(words, lines)
            words += [x for x in bases if x[0] != "\n"]
            lines += [x for x in bases if x[0] == "\n"]
        for some, encode in ((words, lambda x: self._together(x, " ")), (lines, lambda x: self._together([y[1:] for y in x], "\n")), (odd, lambda x: self._alone([y if not rest or y[:1] == "\n" else " " + y for y in x]))):
            for begin in range(0, len(some), ENCODED_AT_ONCE):  # what the library returns is many times larger than the ids
                own = some[begin : begin + ENCODED_AT_ONCE]
                known.update(zip(own, encode(own)))
        for k, base in marked:
            known[parts[k]] = found[k] = known[base] + self.marks[parts[k][-1]]
        self.chars += sum(map(len, new))
        for k, x in zip(at, new):
            if found[k] is None:
                found[k] = known[x]
        return found

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """The ids of each text, followed by end."""
        return _cut_up(*self.encode_column(pa.array(texts, pa.string()), end))

    def encode_column(self, texts: pa.StringArray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each followed by end, in a row, and how many each text has, with its end."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        gc.disable()  # nothing here is cyclic, and the collector would walk all remembered parts
        try:
            out = self._column(pc.fill_null(texts, ""), end)
            if sum(map(len, self.known)) > CACHE_ENTRIES or self.chars > CACHE_CHARS:
                self.old, self.known = self.known, ({}, {})
                self.chars = 0
            if texts.nbytes > GIVEN_BACK_BYTES:
                give_back()
            return out
        finally:
            gc.enable()

    def _with_runs(self, text: str) -> bytes:
        head, *row = _CUT.split(text)
        distinct = list(set(row))
        ids = dict(zip(distinct, self._local(distinct, 1)))
        return b"".join((*self._local([head], 0), *map(ids.__getitem__, row)))

    def _column(self, texts: pa.StringArray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        # a line feed between words starts a part as well
        rows = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        offsets = rows.offsets.to_numpy()
        first = offsets[:-1]
        numbered = rows.values.dictionary_encode()
        parts, index = numbered.dictionary, numbered.indices.to_numpy()
        flag = lambda x: x.to_numpy(zero_copy_only=False)
        odd, empty = flag(pc.match_substring_regex(parts, _ODD_PART)), flag(pc.equal(parts, ""))
        line, lines = flag(pc.equal(parts, "\n")), flag(pc.starts_with(parts, "\n"))
        # white space that can't be cut so: all of such a text is encoded apart
        runs = odd[index]
        runs[first] = (odd & ~empty)[index[first]]
        runs[1:] |= line[index[:-1]] & lines[index[1:]]
        apart = np.unique(np.searchsorted(offsets, np.flatnonzero(runs), "right") - 1).tolist()

        inner = np.ones(len(index), bool)
        inner[first] = False
        for k in apart:
            inner[offsets[k] : offsets[k + 1]] = False
        wanted = np.zeros(len(parts), bool)
        wanted[index[inner]] = True
        index = (np.cumsum(wanted, dtype=np.int32) - 1)[index]
        heads, parts = rows.values.take(pa.array(first)).to_pylist(), parts.filter(pa.array(wanted))
        del rows, numbered, runs, inner  # as large as the column; what follows needs as much again
        pool, sizes = self._parts(parts)

        # the first part of a text is encoded without a blank; then come texts that are apart, and the end
        n = len(sizes)
        for k in apart:
            heads[k] = ""
        distinct = list(dict.fromkeys(["", *heads]))
        at = dict(zip(distinct, range(n, n + len(distinct))))
        index[first] = list(map(at.__getitem__, heads))
        own = self._local(distinct, 0)
        for k in apart:
            index[offsets[k] : offsets[k + 1]] = n
            index[offsets[k]] = n + len(own)
            own.append(self._with_runs(texts[k].as_py()))
        if end:
            index = np.insert(index, offsets[1:], n + len(own))
            offsets = offsets + np.arange(len(offsets), dtype=offsets.dtype)
            own.append(end)
        pool = np.concatenate([pool, np.frombuffer(b"".join(own), "<u4")])
        sizes = np.concatenate([sizes, np.fromiter(map(len, own), np.int64, len(own)) // 4])
        return gather(pool, np.cumsum(sizes) - sizes, sizes, index), np.add.reduceat(sizes[index], offsets[:-1])

    def _parts(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these distinct parts in a row, and how many each has."""
        if not len(parts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        bases, cut, tails = without_tails(parts)
        known = len(self.names)
        numbered = pa.chunked_array([self.names, bases]).dictionary_encode().chunks[-1]
        number, new = numbered.indices.to_numpy(), numbered.dictionary
        new = new.take(pa.array(np.arange(known, len(new))))  # a copy, for the dictionary holds all that is remembered
        del numbered, bases
        if len(new):
            place = np.r_[np.arange(known), known + self._remember(new)]
            number = place[number]
        self.used[number] = True
        tails = tails.dictionary_encode()
        ids, sizes = self._flat_alone(tails.dictionary.to_pylist())
        # each part is its base and its tail, which may be empty
        tail = np.zeros(len(parts), np.int64)
        tail[cut] = 1 + tails.indices.to_numpy()
        begins, sizes = np.r_[0, np.cumsum(sizes) - sizes] + len(self.pool), np.r_[0, sizes]
        begins = np.stack([self.begins[number], begins[tail]], 1)
        sizes = np.stack([self.sizes[number], sizes[tail]], 1)
        out = gather(np.concatenate([self.pool, ids]), begins.ravel(), sizes.ravel()), sizes.sum(1)
        self._forget(number)
        return out

    def _remember(self, parts: pa.StringArray) -> np.ndarray:
        """Encodes parts that aren't remembered; their numbers among them, from 0."""
        words, lines, odd = [], [], []
        new = parts.to_pylist()
        for k, x in enumerate(new):
            (words if x.isalpha() else odd if "<" in x or x == "\n" else lines if x[0] == "\n" else words).append(k)
        made = []
        for some, encode in ((words, lambda x: self._flat(x, " ")), (lines, lambda x: self._flat([y[1:] for y in x], "\n")), (odd, lambda x: self._flat_alone([y if y[0] == "\n" else " " + y for y in x]))):
            for begin in range(0, len(some), ENCODED_AT_ONCE):  # what the library returns is many times larger than the ids
                made.append(encode(list(map(new.__getitem__, some[begin : begin + ENCODED_AT_ONCE]))))
        order = np.array(words + lines + odd)
        sizes = np.concatenate([x for _, x in made]).astype(np.int32)
        self.names = pa.concat_arrays([self.names, parts.take(pa.array(order))])
        self.begins = np.concatenate([self.begins, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(sizes), bool)])
        self.pool = np.concatenate([self.pool, *(x for x, _ in made)])
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        return number

    def _forget(self, number: np.ndarray) -> None:
        """When too much is remembered, what was used since the last time stays, or, if that is much, what was used just now."""
        full = lambda n, size: n > REMEMBERED or size > REMEMBERED_BYTES
        if not full(len(self.names), self.names.nbytes):
            return
        keep = self.used
        for _ in range(2):
            names = self.names.filter(pa.array(keep))
            if not full(2 * len(names), 2 * names.nbytes):
                break
            keep = np.zeros(len(self.names), bool)
            keep[number] = True
        else:
            keep = np.zeros(len(self.names), bool)
            names = self.names.slice(0, 0)
        self.pool = gather(self.pool, self.begins[keep], self.sizes[keep])
        self.names, self.sizes = names, self.sizes[keep]
        self.begins = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.used = np.zeros(len(names), bool)


def _cut_up(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    data, at = ids.tobytes(), [0, *(4 * np.cumsum(sizes)).tolist()]
    return [data[a:b] for a, b in zip(at, at[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for a worker and file; workers are used again by later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_batch(batch: pa.RecordBatch, column: int, size: int = COLUMN_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about `size` bytes of text, or one longer text."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    begin = held = 0
    for k, n in enumerate([*lengths, size]):
        if k == len(lengths) or held and held + n > size:
            own = batch.slice(begin, k - begin)
            if own.num_rows:
                yield own
            begin, held = k, 0
        held += n + 1
    give_back()


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch that hold about `size` bytes of text, or one longer text, with their texts (null: empty)."""
    for own in cut_batch(batch, column, size):
        yield own, [x or "" for x in own.column(column).to_pylist()]


def default_tokenizer() -> str:
    """The public byte-level BPE with 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
