"""Operator 5: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus-signs, digits, URL schemes, and cue words for
accounts, addresses and secrets. A deterministic parser at each anchor expands to the boundaries of the span and
validates it. The four base kinds give what leftmost non-overlapping matching of their patterns gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnlog.llm import common
from cairnlog.llm.bpe import slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address", "iban", "secret", "ssn", "url_login")
KINDS = (*BASE, *ADDED)
SPANS = "array<struct<kind: string, start: int, end: int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@[A-Za-z0-9])")
_IBAN = re.compile(r"[ :=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?i:[ .]{0,2}(?:number|nummer|no|nr|num|número|numéro))?[ .:=#]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])")
_SSN = re.compile(r"[ :=#]{1,3}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])")
_SECRET = re.compile(r"[ ]{0,2}[:=][ ]{0,2}[\"']?([A-Za-z0-9_\-+/]{16,}(?:\.[A-Za-z0-9_\-+/]{8,})*)(?![A-Za-z0-9_\-+/])")
_NAME = r"[A-ZÀ-ÖØ-Þ][\w'’-]{1,24}"
#: What stands before and after a street cue, by order of parts: the span goes from the first to the last of them.
_ORDERS = {
    "number_name_cue": (re.compile(r"[0-9]{1,5} (?:[A-Z][a-zà-ÿ]{1,20} ){1,3}\Z"), re.compile(r"(?![^\W_])")),
    "number_cue_name": (re.compile(r"(?<![\w.,])[0-9]{1,4}(?: ?(?:bis|ter))?,? \Z"), re.compile(rf"(?: (?:de|du|des|la|le|les|aux?))*(?: [dl]['’]| ){_NAME}(?:[ -]{_NAME}){{0,3}}")),
    "cue_name_number": (re.compile(r"(?<!\w)\Z"), re.compile(rf"(?: (?:de|del|la|las|los|el))* {_NAME}(?:(?: (?:de|del|la|y))* {_NAME}){{0,3}},? (?:n\.? ?º ?|núm\. ?)?[0-9]{{1,4}}(?![\w]|[.,][0-9])")),
    "name_cue_number": (re.compile(rf"(?<!\w){_NAME}[ -]?\Z"), re.compile(r" [0-9]{1,4}[a-h]?(?!\w|[.,][0-9])")),
}
_STREETS = {
    "number_name_cue": ("Street", "Avenue", "Road", "Lane", "Boulevard", "Drive", "St", "Ave", "Rd", "Blvd", "STREET", "AVENUE", "ROAD", "LANE", "BOULEVARD"),
    "number_cue_name": ("rue", "avenue", "boulevard", "chemin", "impasse", "quai", "Rue", "Avenue", "Boulevard", "Chemin", "Impasse", "Quai"),
    "cue_name_number": ("calle", "avenida", "plaza", "paseo", "Calle", "Avenida", "Plaza", "Paseo"),
    "name_cue_number": ("straße", "strasse", "str.", "weg", "platz", "gasse", "allee", "Straße", "Strasse", "Str.", "Weg", "Platz", "Gasse", "Allee"),
}
_NEARBY = 72  # characters: the longest that can stand before a cue
_CUES = {
    "account": ("account", "acct", "konto", "cuenta", "compte"),
    "iban": ("iban",),
    "ssn": ("ssn", "social security number"),
    "secret": ("token", "api_key", "apikey", "secret", "password"),
}
_PARSE = {"account": _ACCOUNT, "iban": _IBAN, "ssn": _SSN, "secret": _SECRET}


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for kind, cues in _CUES.items():
        for cue in cues:
            for form in (cue, cue.title(), cue.upper()):
                found.add_word(form, (kind, len(form)))
    for cue in {c for cues in _STREETS.values() for c in cues}:
        found.add_word(cue, ("address", len(cue)))
    found.make_automaton()
    return found


_ANCHORS = anchors()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def address(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """The address around the street cue at begin..end, in the first order of its parts that fits."""
    cue, nearby = text[begin:end], text[max(0, begin - _NEARBY) : begin]
    for order, (before, after) in _ORDERS.items():
        if cue in _STREETS[order] and (b := after.match(text, end)) and (a := before.search(nearby)):
            if order != "name_cue_number" or cue[0].islower() != a[0].endswith((" ", "-")):  # "Mühlweg", "Lange Straße", not "Lange straße"
                return begin - len(nearby) + a.start(), b.end()
    return None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, sorted by kind as listed in KINDS, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {}
    email_from = ip_from = card_from = phone_from = 0
    for at, (what, size) in _ANCHORS.iter(text):
        if what == "digit":
            if at >= ip_from:
                if m := _IP.match(text, at):
                    ip_from = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        found.setdefault("ip", []).append(m.span())
                else:
                    ip_from = _DIGITS.match(text, at).end()
            if at >= card_from and (m := _CARD.match(text, at)):
                card_from = m.end()
                if m.end() - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found.setdefault("card", []).append(m.span())
        elif what == "at":
            start = at
            while start > email_from and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_from = m.end()
                found.setdefault("email", []).append((start, m.end()))
        elif what == "plus":
            if at >= phone_from and (m := _PHONE.match(text, at)):
                phone_from = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.setdefault("phone", []).append(m.span())
        elif what == "scheme":
            if m := _LOGIN.match(text, at + 1):
                found.setdefault("url_login", []).append(m.span())
        elif what == "address":
            if span := address(text, at + 1 - size, at + 1):
                found.setdefault("address", []).append(span)
        else:
            before = text[at - size : at - size + 1] if at >= size else ""
            if not before.isalnum() and (m := _PARSE[what].match(text, at + 1)):
                if what == "iban" and not iban_holds(m[1]):
                    continue
                if what == "secret" and not (any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1])):
                    continue
                found.setdefault(what, []).append(m.span(1))
    if not found:
        return []
    return [(k, *s) for k in KINDS if k in found for s in sorted(set(found[k]))]


def arrow_spans(values: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in v] for v in values], kind)


def redact_text(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """Replaces the union of overlapping spans by the kind of the first one, as <EMAIL>."""
    if not found:
        return text
    out, at, end = [], 0, -1
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[at:a], f"<{kind.upper()}>"]
        end = at = max(end, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) of every whole text. Null or empty text: no spans. Null ids and repeated rows stay rows of
    their own; an empty table gives an empty result; other columns are not read; a long text is parsed whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in slices(batch, 1):
                found = arrow_spans([spans(t) for t in chunk.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([chunk.column(0), found], [id_col, "spans"])

    own = StructType([docs.schema[id_col]])
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, common.with_columns(own, f"spans {SPANS}"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, with the spans of text_col replaced by their kinds. Null text stays null."""
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in slices(batch, at):
                texts = pa.array([redact_text(t, spans(t)) for t in chunk.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(chunk.columns)], names)

    return common.map_arrow(docs, run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts of the base kinds, digest of their spans, and all spans."""
    shown = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    found = find(common.table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
