"""Personal data in texts: fixed patterns, and spans added by a linear-chain conditional random field over word shapes.

The patterns are the base: leftmost matches that do not overlap within a kind, dropped where their check fails. A failing match takes what lies
within it along, so a phone number followed by an address, or two card numbers in a row, are missed; so are forms that the patterns don't
know (``name (at) host (dot) org``, numbers without a plus sign, longer addresses). The field finds these: words are its places, their shapes and those of their
neighbours its features, begin and inside of each kind its labels. Words of letters and sentence marks, two or more away from any other
word, are outside by definition; the stretches between them are decoded by Viterbi, many at a time. What it finds is added after
an exact check of its kind, unless it overlaps a base span.

- Null, empty or blank text: no spans. Empty table: no rows. Every row is judged by itself, repeated rows alike; a null doc_id is carried on, other columns are kept out.
- Very long texts, words and numbers: whole; patterns take time in proportion to the text.
- Ties: equal starts are ordered by kind as in ``KINDS``; equal scores of labels go to the smaller label.
- An empty labelled table adds no spans.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarloom.llm.common import NOT_SPACE, small_batches, split_words, texts, utf8
from scholarloom.llm.crf import Chain

KINDS = ("email", "ip", "card", "phone")
#: The field is fitted on at most so many labelled rows, those of the smallest hash of the text.
LABELLED = 2_000
LABELS = 1 + 2 * len(KINDS)
DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = bytes(c for c in range(256) if not 0x30 <= c <= 0x39)
DIGITS = b"0123456789"


def digits_of(text: bytes) -> bytes:
    return text.translate(None, NO_DIGIT)


def luhn(digits: bytes) -> bool:
    values = [c - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 if v > 4 else 2 * v for v in values[1::2])) % 10 == 0


def is_ip(text: bytes) -> bool:
    return all(len(own := part.lstrip(b"0")) <= 3 and int(own or b"0") <= 255 for part in text.split(b"."))


def is_card(text: bytes) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: bytes) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Matches of local part, @ and domain; the local part is the whole run of its characters before the @, from the last match on."""
    at, end = text.find(b"@"), 0
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(LOCAL))
        if start < at and (found := DOMAIN.match(text, at)):
            end = found.end()
            yield start, end
            at = text.find(b"@", end)
        else:
            end = at + 1
            at = text.find(b"@", end)


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    for kind, (pattern, check) in enumerate([(IP, is_ip), (CARD, is_card), (PHONE, is_phone)], 1):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if check(m.group())]
    return sorted(found)


# --- features of words ---

_CLASS = bytes(0x39 if 0x30 <= c <= 0x39 else 0x58 if 0x41 <= c <= 0x5A else 0x78 if 0x61 <= c <= 0x7A or c >= 0x80 else c for c in range(256))
_REPEATED = re.compile(rb"([9Xx])\1+")
EDGES = b".,;:!?\"'<>|#$%&*"
#: Words without any other character are plain.
_MARKED = np.ones(256, bool)
_MARKED[0x80:] = _MARKED[0x41:0x5B] = _MARKED[0x61:0x7B] = False
_MARKED[list(b".,;:!?\"'" + b" \t\n\x0b\x0c\r")] = False
_FIRST = {c: k for k, c in enumerate(b"9Xx+([{", 1)}
_AT_WORD, _DOT_WORD = re.compile(rb"[(\[{]at[)\]}]", re.I), re.compile(rb"[(\[{]dot[)\]}]", re.I)
HEX = b"0123456789abcdefABCDEF:"
PLAIN = b"x"
#: Sizes of the features of one word besides its shape: digits, card check, dotted numbers, first and last class, marks of an address, colons.
SIZES = (21, 3, 3, 8, 8, 4, 3)


def shape(core: bytes) -> bytes:
    return _REPEATED.sub(rb"\1", core.translate(_CLASS))


def facts(word: bytes) -> tuple[bytes, tuple[int, ...]]:
    """(shape, other features) of a word without the marks at its edges."""
    core = word.strip(EDGES)
    digits = digits_of(core)
    bare = not core.translate(None, DIGITS + b"-")
    card = (1 if luhn(digits) else 2) if bare and 12 <= len(digits) <= 19 else 0
    dotted = (1 if core.count(b".") == 3 and is_ip(core) else 2) if b"." in core and digits and not core.translate(None, DIGITS + b".") else 0
    mark = 3 if b"@" in core else 1 if _AT_WORD.search(core) else 2 if _DOT_WORD.search(core) else 0
    colons = (1 if is_long_ip(core) else 2) if core.count(b":") >= 2 and not core.translate(None, HEX) else 0
    kinds = core[:1].translate(_CLASS), core[-1:].translate(_CLASS)
    return shape(core), (min(len(digits), 20), card, dotted, *(_FIRST.get(k[0], 0) if k else 0 for k in kinds), mark, colons)


def is_long_ip(text: bytes) -> bool:
    if len(text) > 45 or text.count(b":") < 3:
        return False
    try:
        return bool(ipaddress.IPv6Address(text.decode()))
    except ValueError:
        return False


@dataclass
class Stretches:
    """The stretches of a batch that are to be decoded. ``words``: number of each place's word in the batch; ``first``: places before each stretch; ``starts`` and ``ends``: bytes of all words; ``text_first``: words before each text."""

    words: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_first: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Stretches:
        starts, ends, text_first = split_words(data, offsets, NOT_SPACE)
        marked = np.searchsorted(starts, np.flatnonzero(_MARKED[data]), "right") - 1
        chosen = np.zeros(len(starts), bool)
        if len(marked):
            marked = np.unique(marked)
            text = np.searchsorted(text_first, marked, "right") - 1
            for k in (-1, 0, 1):
                near = marked + k
                chosen[near[(near >= text_first[text]) & (near < text_first[text + 1])]] = True
        words = np.flatnonzero(chosen)
        new = np.ones(len(words), bool)
        if len(words):
            text = np.searchsorted(text_first, words, "right") - 1
            new[1:] = (words[1:] != words[:-1] + 1) | (text[1:] != text[:-1])
        return cls(words, np.append(np.flatnonzero(new), len(words)), starts, ends, text_first)


class Field:
    """Shapes known from the labelled rows, and the fitted chain."""

    def __init__(self, shapes: dict[bytes, int], chain: Chain | None) -> None:
        self.shapes, self.chain = shapes, chain

    def features(self, data: bytes, some: Stretches) -> np.ndarray:
        """Feature numbers of every place: the word's own, and shape and digits of the words before and after it in its stretch."""
        known: dict[bytes, tuple[int, ...]] = {}
        rows = []
        for a, b in zip(some.starts[some.words].tolist(), some.ends[some.words].tolist(), strict=True):
            word = data[a:b]
            if (row := known.get(word)) is None:
                own, rest = facts(word)
                row = known[word] = (self.shapes.get(own, 1), *rest)
            rows.append(row)
        own = np.array(rows, np.int64).reshape(len(rows), 1 + len(SIZES))
        inside = np.ones(len(own), bool)
        inside[some.first[:-1]] = False
        before, after = np.zeros((len(own), 2), np.int64), np.zeros((len(own), 2), np.int64)
        if len(own):
            before[1:] = np.where(inside[1:, None], own[:-1, :2] + [0, 1], 0)
            after[:-1] = np.where(inside[1:, None], own[1:, :2] + [0, 1], 0)
        return np.hstack([own, before, after]) + self._offsets()

    def _sizes(self) -> list[int]:
        shapes = len(self.shapes) + 2
        return [shapes, *SIZES, shapes, SIZES[0] + 1, shapes, SIZES[0] + 1]

    def _offsets(self) -> np.ndarray:
        return np.cumsum([0, *self._sizes()[:-1]])

    def fit(self, data: bytes, some: Stretches, labels: np.ndarray) -> None:
        begins = np.arange(1, LABELS, 2)
        allowed = np.ones((LABELS, LABELS), bool)
        allowed[:, begins + 1] = False
        allowed[begins, begins + 1] = allowed[begins + 1, begins + 1] = True
        self.chain = Chain.fitted(self.features(data, some), some.first, labels, sum(self._sizes()), allowed)


def fitted_field(labelled: DataFrame) -> Field:
    """Field fitted on ``labelled`` (text, spans array<struct<kind, start, end>> in code points)."""
    rows = labelled.where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(LABELLED).select("text", "spans").collect()
    column = pa.array([r.text for r in rows], pa.string())
    data, offsets = utf8(column)
    some, raw = Stretches.of(data, offsets), data.tobytes()
    shapes = sorted({facts(raw[a:b])[0] for a, b in zip(some.starts[some.words].tolist(), some.ends[some.words].tolist(), strict=True)})
    field = Field({s: k for k, s in enumerate(shapes, 2)}, None)
    labels = np.zeros(len(some.starts), np.int64)
    for k, row in enumerate(rows):
        for span in row.spans or []:
            a, b = (int(offsets[k]) + len(row.text[:x].encode()) for x in (span.start, span.end))
            lo, hi = int(np.searchsorted(some.ends, a, "right")), int(np.searchsorted(some.starts, b, "left"))
            labels[lo:hi] = 2 * KINDS.index(span.kind) + 2
            labels[lo] -= 1
    if len(some.words):
        field.fit(raw, some, labels[some.words])
    return field


# --- spans of texts ---

_TRIM = {"email": EDGES + b"()[]{}", "ip": bytes(c for c in range(256) if c not in HEX), "card": NO_DIGIT}
_BRACKETED = re.compile(rb" ?[(\[{](at|dot)[)\]}] ?", re.I)
_PHONE_TAIL = bytes(c for c in range(256) if c not in DIGITS)
_PHONE_HEAD = bytes(c for c in range(256) if c not in b"0123456789+(")


def checked(text: bytes, start: int, end: int, kind: int) -> tuple[int, int] | None:
    """The span without the marks around it, if it passes the check of its kind."""
    name = KINDS[kind]
    if name == "phone":
        own = text[start:end].rstrip(_PHONE_TAIL)
        end = start + len(own)
        start = end - len(own.lstrip(_PHONE_HEAD))
    else:
        own = text[start:end].rstrip(_TRIM[name])
        end = start + len(own)
        start = end - len(own.lstrip(_TRIM[name]))
    own = text[start:end]
    if name == "email":
        plain = _BRACKETED.sub(lambda m: b"@" if m.group(1).lower() == b"at" else b".", own)
        good = next(emails(plain), None) == (0, len(plain))
    elif name == "ip":
        good = is_long_ip(own) or bool(IP.fullmatch(own)) and is_ip(own)
    elif name == "card":
        good = not own.translate(None, DIGITS + b" -") and is_card(own)
    else:
        good = not own.translate(None, DIGITS + b"+ ().-") and is_phone(own) and own.count(b"(") == own.count(b")")
    return (start, end) if good else None


def added_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) in bytes within each text, as decoded and checked."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    some = Stretches.of(data, offsets)
    if field.chain is None or not len(some.words):
        return out
    raw = data.tobytes()
    labels = field.chain.decoded(field.features(raw, some), some.first)
    begins = np.flatnonzero(labels % 2 == 1)
    ends = np.flatnonzero((labels > 0) & (np.append(labels[1:], 0) != labels + labels % 2))
    for lo, hi in zip(begins.tolist(), ends.tolist(), strict=True):
        text = int(np.searchsorted(some.text_first, some.words[lo], "right")) - 1
        kind = int(labels[lo] - 1) // 2
        if found := checked(raw, int(some.starts[some.words[lo]]), int(some.ends[some.words[hi]]), kind):
            out[text].append((found[0] - int(offsets[text]), kind, found[1] - int(offsets[text])))
    return out


def spans_of(field: Field, column: pa.Array) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, added) in bytes of every text: base spans, and added ones that overlap none of them."""
    data, offsets = utf8(column)
    out = []
    for text, extra in zip(texts(column), added_spans(field, data, offsets), strict=True):
        base = base_spans(text)
        if extra:
            covered = np.zeros(len(text) + 1, np.int64)
            for a, _, b in base:
                covered[a] += 1
                covered[b] -= 1
            taken = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
            extra = [s for s in extra if taken[s[2]] == taken[s[0]]]
        out.append(sorted([(*s, False) for s in base] + [(*s, True) for s in extra]))
    return out


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("added", T.BooleanType())])


def personal_data(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, spans) per row: spans (kind, start, end, added) in code points, by start, then kind."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted_field(labelled))

    @F.arrow_udf(T.ArrayType(SPAN))
    def found(column: pa.Array) -> pa.Array:
        lists, first = [], [0]
        for text, spans in zip(texts(column), spans_of(shared.value, column), strict=True):
            if spans and not text.isascii():
                points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]).tolist()
                spans = [(points[a], kind, points[b], more) for a, kind, b, more in spans]
            lists += spans
            first.append(len(lists))
        starts, kinds, ends, more = zip(*lists, strict=True) if lists else ((), (), (), ())
        each = pa.StructArray.from_arrays([pa.array([KINDS[k] for k in kinds], pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(more, pa.bool_())], names=SPAN.names)
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), each)

    return docs.select("doc_id", found(F.col("text").cast("string")).alias("spans"))


def redacted_texts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``docs`` with every stretch covered by spans replaced by the kind of its first span in angle brackets; other columns, and null texts, stay as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fitted_field(labelled))

    @F.arrow_udf(T.StringType())
    def replaced(column: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts(column), spans_of(shared.value, column), strict=True):
            parts, at = [], 0
            for start, kind, end, _ in spans:
                if start >= at:
                    parts += [text[at:start], b"<%s>" % KINDS[kind].encode()]
                at = max(at, end)
            out.append(b"".join([*parts, text[at:]]).decode())
        return pa.array(out, pa.string())

    text = F.col("text").cast("string")
    return docs.withColumn("text", F.when(text.isNotNull(), replaced(text)))
