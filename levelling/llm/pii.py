"""Personal data: base patterns plus spans of a conditional random field (operator 8).

Base patterns (e-mail address, IP address, card number, phone number) are
leftmost and non-overlapping per kind; a match that fails its check is dropped
without a retry.  They are searched so that the time is linear in the text:
an address is found from its ``@``, numbers only where a run of digits begins.
A linear-chain CRF over word shapes, trained on a small labelled table
(``EXAMPLES``, or any table of the same form), then labels every word of every
line by Viterbi in numpy; runs of one kind that pass the kind's check and touch
no base span are added (telephone numbers without a country code, for one).

Defined results: null and empty texts have no spans; offsets count code
points, the end is exclusive; repeated rows are searched each; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .crf import Crf, observe
from .tokens import blocks, text_bytes

KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits begins: later starts in the run fail or match alike
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# A small labelled table: <kind>...</kind> marks the words of a span, the rest is outside.
EXAMPLES = [
    "Please call <phone>(555) 014-2233</phone> before noon .",
    "call <phone>(212) 555-0187</phone> today",
    "My number is <phone>555-014-9921</phone> if needed .",
    "Phone: <phone>555-867-5309</phone>",
    "tel <phone>(030) 555-7713</phone> or mail",
    "ring <phone>+1 (415) 555-2671</phone> now",
    "the line <phone>+44 20 7946 0958</phone> is open",
    "reach me on <phone>+49 30 901820</phone> please",
    "fax <phone>(089) 555-4410</phone>.",
    "office <phone>212-555-0143</phone>, ask for her",
    "write to <email>jane.doe@example.com</email> soon",
    "mail <email>info@mail3.example.org</email>, thanks",
    "contact <email>a.34@mail7.example.com</email> for more",
    "from <email>bob_smith+x@sub.example.co.uk</email> today",
    "host <ip>192.168.10.24</ip> answered",
    "the server at <ip>10.0.0.7</ip> is down",
    "login from <ip>203.0.113.77</ip>.",
    "blocked <ip>129.38.82.176</ip> again",
    "card <card>4111 1111 1111 1111</card> expires soon",
    "paid with <card>5500-0000-0000-0004</card> yesterday",
    "number <card>4012888888881881</card> was used",
    "use <card>6011 0009 9013 9424</card> for it",
    "Licensed under the Apache License, Version 2.0.",
    "GNU General Public License, version 3.",
    "released in 2024 under CC BY-NC 4.0.",
    "on 2024-05-17 at 10:30 we met",
    "see page 12 of volume 3 , chapter 14",
    "it cost 12,500 or 13.75 each",
    "the years 1998-2004 and 2010-2015 were dry",
    "about 45 % of 300 people",
    "section 4.2.1 and figure 7-3",
    "between 10-12 and 14-16 o'clock",
    "order no. 4471 of 28 items",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" was set",
    "token = \"bc0d31ba76f17e56642e8751295a3fd50cd8e61f\" here",
    "id a81bc81b-dead-4e5d-abff-90865d1e13b1 was logged",
    "The weather was fine and they walked home .",
    "one | two | three | four",
    "La casa es grande , dijo (sin dudar) el hombre .",
    "Der Hund und die Katze , ein Tag - eine Nacht",
    "OK!! THIS!! IS!! LOUD!!",
    "and*** the%%% of&&& was###",
    "f(x) = 3 x + 2",
    "isbn 978-3-16-148410-0 is a book",
    "version 10.4.2 fixes bug 5512",
    "zip 90210 and room 404",
    "a 16-bit number up to 65535",
    "score 3-2 after 90 minutes",
]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def fits(kind: str, found: str) -> bool:
    """The check of a kind on a matched string."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in found.split("."))
    digits = "".join(_DIGITS.findall(found))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def emails(text: str):
    """Spans of e-mail addresses, found from each ``@`` to both sides."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = [("email", s, e) for s, e in emails(text)]
    if _DIGITS.search(text):
        for kind, rx in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            out += [(kind, m.start(), m.end()) for m in rx.finditer(text) if fits(kind, m.group())]
    return out


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table: one marked-up line per row."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(EXAMPLES)], "line_id long, line string")


def train(examples: DataFrame) -> Crf:
    """Fit the field on a small labelled table (``line_id``, ``line`` with marks); it is read by the driver."""
    lines, names = [], []
    for r in examples.orderBy("line_id").collect():
        kind, words = "O", []
        for tok in re.split(r"(</?\w+>)", r["line"]):
            if re.fullmatch(r"<\w+>", tok):
                kind = tok[1:-1]
            elif re.fullmatch(r"</\w+>", tok):
                kind = "O"
            else:
                words.append((tok, kind))
        text = "".join(t for t, _ in words)
        at, spans = 0, []
        for t, k in words:
            spans.append((at, at + len(t), k))
            at += len(t)
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            names.append(next((k for s, e, k in spans if k != "O" and s < m.end() and m.start() < e), "O"))
        lines.append(text)
    labels = ["O", *KINDS]
    data, off = text_bytes(pa.array(["\n".join(lines)]))
    _, feats, first = observe(data, off)
    return Crf(labels).fit(feats, first, np.array([labels.index(x) for x in names]))


_EDGE = ".,;:!?\"'*%&$#|<>[]{}"


class _Spans:
    """The base spans of a text, for overlap tests."""

    def __init__(self, found):
        order = sorted((s, e) for _, s, e in found)
        self.start = [s for s, _ in order]
        self.reach = list(accumulate((e for _, e in order), max))

    def touches(self, s: int, e: int) -> bool:
        k = bisect_left(self.start, e)
        return k > 0 and self.reach[k - 1] > s


def _added(model: Crf, data, off, taken) -> dict[int, list[tuple[str, int, int]]]:
    """Spans of the field per row of a block, those that pass their check and touch no base span."""
    w, feats, first = observe(data, off)
    lab = model.decode(feats, first)
    hit = np.flatnonzero(lab)
    out: dict[int, list[tuple[str, int, int]]] = {}
    if not len(hit):
        return out
    starts = np.zeros(len(lab) + 1, bool)
    starts[first] = True
    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    taken = [_Spans(x) for x in taken]
    cut = np.flatnonzero((np.diff(hit, prepend=-2) != 1) | starts[hit]
                         | (lab[hit] != lab[np.maximum(hit - 1, 0)]))
    for lo, hi in zip(cut, np.append(cut[1:], len(hit))):
        kind = KINDS[lab[hit[lo]] - 1]
        row = int(np.searchsorted(off, w.start[hit[lo]], side="right")) - 1
        for i, j in _pieces(kind, [data[w.start[k]:w.end[k]].tobytes().decode("utf-8", "replace")
                                   for k in hit[lo:hi]]):
            first, last = w.start[hit[lo + i]], w.end[hit[lo + j]]
            raw = data[first:last].tobytes().decode("utf-8", "replace")
            body = raw.strip(_EDGE)
            if not _good(kind, body):
                continue
            s = int(char[first] - char[off[row]]) + raw.index(body)
            if not taken[row].touches(s, s + len(body)):
                out.setdefault(row, []).append((kind, s, s + len(body)))
    return out


def _good(kind: str, body: str) -> bool:
    """Whether a string found by the field can be of its kind."""
    if kind == "email":
        return any(True for _ in emails(body))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", body)) and fits("ip", body)
    if kind == "card":
        return fits("card", body)
    return bool(re.fullmatch(r"\+?[\x20().0-9/-]+", body)) and fits("phone", body)


def _pieces(kind: str, words: list[str]):
    """Cut a run of words of one kind, which may hold several spans side by side, at the likely borders."""
    i, body = 0, words[0].strip(_EDGE)
    for j in range(1, len(words)):
        word = words[j].strip(_EDGE)
        longer = f"{body} {word}"
        if word[:1] in ("(", "+") or _good(kind, body) and (_good(kind, word) or not _good(kind, longer)):
            yield i, j - 1
            i, body = j, word
        else:
            body = longer
    yield i, len(words) - 1


def spans_of(col: pa.Array, model: Crf):
    """Per row the spans (kind, start, end, base), by kind as listed, then start."""
    for lo, hi, data, off in blocks(col):
        part = col.slice(lo, hi - lo).to_pylist()
        texts = [x.decode("utf-8", "replace") if isinstance(x, bytes) else x or "" for x in part]
        base = [base_spans(t) for t in texts]
        more = _added(model, data, off, base)
        for i, found in enumerate(base):
            yield sorted([(k, s, e, True) for k, s, e in found] +
                         [(k, s, e, False) for k, s, e in more.get(i, [])],
                         key=lambda x: (KINDS.index(x[0]), x[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                             ("base", pa.bool_())]))


def find(docs: DataFrame, model: Crf, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Add an array of ``kind, start, end, base``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<struct<kind:string,start:long,end:long,base:boolean>>")
    def search(col: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in found]
                         for found in spans_of(col, shared.value)], _SPANS)

    return docs.withColumn(out, search(F.col(text_col).cast("binary")))


def redact(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def clean(col: pa.Array) -> pa.Array:
        out = []
        for raw, found in zip(col.to_pylist(), spans_of(col, shared.value)):
            text = None if raw is None else raw.decode("utf-8", "replace")
            if found:
                parts, at = [], 0
                for s, e, k in sorted((s, e, k) for k, s, e, _ in found):
                    if s >= at:  # spans of two kinds may overlap: the first names it, all is removed
                        parts += [text[at:s], f"[{k.upper()}]"]
                    at = max(at, e)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(text_col).cast("binary")))


def number_of(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def listing(spans: Column, base_only: bool) -> Column:
    """``kind:start:end``, comma-joined."""
    kept = F.filter(spans, lambda x: x["base"]) if base_only else spans
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
