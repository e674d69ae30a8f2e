"""Personal data in texts: anchors found by Aho-Corasick, grown and checked by local parsers.

One automaton pass over a text reports at-signs, plus signs before a digit, digit pairs, dotted
digits, schemes and identifier cues. A parser per kind grows each anchor to its boundaries by
looking at neighbouring characters only, then validates (octets, Luhn, digit counts, mod 97).

Base kinds are email, ip, card and phone. The method adds:

* ``userinfo``: the ``user:password`` part of ``scheme://user:password@host``
* ``iban``: an account number after the cue IBAN, valid by mod 97
* ``ssn``: ``ddd-dd-dddd`` after a cue (SSN, social security)
* ``key``: an access key of 20 capitals and digits after ``AKIA``

Null or empty texts have no spans. Spans count code points, the end is exclusive. Rows keep
their other columns; repeated rows are treated alike; a clash of an extra column with a result
column is resolved for the result column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from workloom.llm.arrays import per_process

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "userinfo", "iban", "ssn", "key")
MASKS = {kind: f"[{kind.upper()}]" for kind in KINDS}

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _DIGITS | _LETTERS | frozenset("._%+-")
_WORD = _DIGITS | _LETTERS

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_OCTETS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_GAP = re.compile(r"[\s:#=]{0,8}(?:(?:no|number|nr)\.?[\s:#=]{0,8})?", re.I)
#: Cues of identifiers; the parser looks right after them.
CUES = {
    "IBAN": "iban", "iban": "iban", "Iban": "iban",
    "SSN": "ssn", "ssn": "ssn", "ocial security": "ssn", "ocial Security": "ssn",
    "AKIA": "key",
}


def automaton():
    """Anchors of all kinds in one Aho-Corasick automaton."""
    import ahocorasick

    found = ahocorasick.Automaton()
    words: dict[str, list[str]] = {"@": ["email"], "://": ["userinfo"]}
    for cue, kind in CUES.items():
        words.setdefault(cue, []).append(kind)
    for a in "0123456789":
        words.setdefault(f"+{a}", []).append("phone")
        for b in "0123456789":
            words.setdefault(f"{a}.{b}", []).append("ip")
            for gap in ("", " ", "-"):
                words.setdefault(f"{a}{gap}{b}", []).append("card")
    for word, kinds in words.items():
        for kind in kinds:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _octets_fit(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in text.split("."))


def _iban_fits(text: str) -> str:
    """The longest valid account number at the start of a match, or nothing."""
    for end in range(len(text), 14, -1):
        plain = text[:end].replace(" ", "")
        if text[end - 1] != " " and 15 <= len(plain) <= 34:
            turned = plain[4:] + plain[:4]
            if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1:
                return text[:end]
    return ""


def spans(text: str | None, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text: (kind, start, end), by start, then kind in the order of KINDS."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    # Per kind: where the last match ended, whether it was kept or failed its check.
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, width) in anchors.iter(text):
        at = last - width + 1
        floor = done[kind]
        if kind == "email":
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                done[kind] = m.end()
                found.append((kind, start, m.end()))
        elif at < floor:
            continue
        elif kind == "ip":
            start = at
            while start > floor and text[start - 1] in _DIGITS:
                start -= 1
            if m := _OCTETS.match(text, start):
                done[kind] = m.end()
                if _octets_fit(m[0]):
                    found.append((kind, start, m.end()))
        elif kind == "card":
            m = _CARD.match(text, at)
            done[kind] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((kind, at, m.end()))
        elif kind == "phone":
            if m := _PHONE.match(text, at):
                done[kind] = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found.append((kind, at, m.end()))
        elif kind == "userinfo":
            if m := _USERINFO.match(text, last + 1):
                done[kind] = m.end()
                found.append((kind, *m.span()))
        elif kind == "key":
            if (not at or text[at - 1] not in _WORD) and (m := _KEY.match(text, at)):
                done[kind] = m.end()
                found.append((kind, *m.span()))
        else:
            start = _GAP.match(text, last + 1).end()
            if kind == "iban" and (m := _IBAN.match(text, start)):
                if account := _iban_fits(m[0]):
                    done[kind] = start + len(account)
                    found.append((kind, start, done[kind]))
            elif kind == "ssn" and (m := _SSN.match(text, start)):
                done[kind] = m.end()
                found.append((kind, *m.span()))
    rank = {kind: k for k, kind in enumerate(KINDS)}
    found.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
    return found


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one mask."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], MASKS[kind]]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def private_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and its spans as array<struct<kind,start,end>>."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = per_process("private anchors", automaton)
        row = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = [
                [{"kind": k, "start": s, "end": e} for k, s, e in spans(text.as_py(), anchors)]
                for text in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, row)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def private_digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as one string."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = per_process("private anchors", automaton)
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in BASE_KINDS}
            digests, texts = [], []
            for text in batch.column("text"):
                found = spans(text.as_py(), anchors)
                base = [s for s in found if s[0] in BASE_KINDS]
                for kind in BASE_KINDS:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS),
                 pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
              "base_sha256 string, spans string")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span masked in ``text``; all columns are kept, n_chars follows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = per_process("private anchors", automaton)
        for batch in batches:
            at, size = (batch.schema.get_field_index(c) for c in ("text", "n_chars"))
            texts = batch.column(at).to_pylist()
            sizes = batch.column(size).to_pylist() if size >= 0 else None
            for k, text in enumerate(texts):
                if found := spans(text, anchors):
                    texts[k] = mask(text, found)
                    if sizes and sizes[k] is not None:
                        sizes[k] = len(texts[k])
            batch = batch.set_column(at, "text", pa.array(texts, batch.column(at).type))
            if sizes is not None:
                batch = batch.set_column(size, "n_chars", pa.array(sizes, batch.column(size).type))
            yield batch

    return docs.mapInArrow(work, docs.schema)
