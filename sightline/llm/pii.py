"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, digits, plus signs, schemes and identifier
cues. From each, a local parser expands to the left and right, validates, and reports a span; it never looks
further than the expression it parses, and a character that one expression of a kind has used is not used by
the next of that kind, so the time is linear in the text.

Base kinds: email, ip, card (13 to 19 digits that pass Luhn), phone (9 to 15 digits). Added kinds: address
(mailto:, tel:, sip: and xmpp: targets, and urls that hold a user name) and account (an IBAN whose check
digits hold, or a number of 6 to 20 digits, after a cue such as "IBAN" or "account no.").

Defined cases: null text is empty and has no spans, and base_sha256 is then that of the empty string; a null id
is passed on; repeated rows, and rows that tie in id or text, are each scanned and give a row each; a very long
text, or a very long run of digits, letters or dots in it, costs its own length; an empty table gives an empty
result; other columns are ignored, whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "account")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TARGET = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+?[0-9][0-9().-]{5,}[0-9]")
_AUTHORITY = re.compile(r"[A-Za-z0-9._%+!$&*;=~-]+(?::[^\s@/?#\"'<>]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s\"'<>]*)?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_AFTER_CUE = re.compile(r"(?:\x20?(?:no|nr|number|num|id)\b\.?)?\x20?[:#=]?\x20?#?", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,}")

#: Words that announce an account number, and schemes whose target is a person's address.
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "customer", "passport", "member")
SCHEMES = ("mailto:", "tel:", "sip:", "xmpp:")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("url", 3))
    for words, kind in ((CUES, "cue"), (SCHEMES, "scheme")):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    packed = text.replace(" ", "")
    if not 15 <= len(packed) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


class Finder:
    """Anchors and parsers; find(text) gives the spans by kind."""

    def __init__(self) -> None:
        self.automaton = _automaton()

    def find(self, text: str) -> dict[str, list[tuple[int, int]]]:
        out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
        email_at = ip_at = card_at = phone_at = address_at = account_at = 0
        for last, (kind, length) in self.automaton.iter(text):
            at = last + 1 - length
            if kind == "digit":
                if at >= ip_at:
                    m = _DOTTED.match(text, at)
                    ip_at = m.end()
                    if text.find(".", at, ip_at) >= 0:
                        self._ips(text, m, out["ip"])
                if at >= card_at:
                    m = _CARD.match(text, at)
                    card_at = m.end() if m else at + 1
                    if m and 13 <= card_at - at and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                        out["card"].append(m.span())
            elif kind == "at":
                start = at
                while start > email_at and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_at = m.end()
                    out["email"].append((start, email_at))
            elif kind == "plus":
                if at >= phone_at and (m := _PHONE.match(text, at)):
                    phone_at = m.end()
                    if 9 <= len(_digits(m[0])) <= 15:
                        out["phone"].append(m.span())
            elif kind == "scheme":
                if at >= address_at and not text[at - 1 : at].isalnum() and (m := _TARGET.match(text, last + 1)):
                    address_at = m.end()
                    out["address"].append((at, address_at))
            elif kind == "url":
                start = at
                while start > address_at and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at and (m := _AUTHORITY.match(text, last + 1)):
                    address_at = m.end()
                    out["address"].append((start, address_at))
            elif at >= account_at and not text[at - 1 : at].isalpha():
                account_at = self._account(text, last + 1, out["account"]) or account_at
        return out

    @staticmethod
    def _ips(text: str, m: re.Match, out: list[tuple[int, int]]) -> None:
        """Each four consecutive parts of a dotted run are one candidate."""
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in four)):
                out.append((at, end))
            at = end + 1

    @staticmethod
    def _account(text: str, at: int, out: list[tuple[int, int]]) -> int | None:
        at = _AFTER_CUE.match(text, at).end()
        if (m := _IBAN.match(text, at)) is not None:
            for end in range(m.end(), m.start() + 14, -1):  # at most 34 characters: the longest that holds
                if text[end - 1] != " " and iban_holds(text[m.start() : end]):
                    out.append((m.start(), end))
                    return end
        if (m := _NUMBER.match(text, at)) is not None and len(_digits(m[0])) <= 20:
            out.append(m.span())
            return m.end()
        return None


_SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
    "n_address bigint, n_account bigint"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Finder()
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in BASE + ADDED}
        shas, spans = [], []
        for text in batch.column("text"):
            found = finder.find(text.as_py() or "")
            told = [f"{k}:{a}:{b}" for k in BASE for a, b in found[k]]
            shas.append(hashlib.sha256(",".join(told).encode()).hexdigest())
            spans.append(",".join(told + [f"{k}:{a}:{b}" for k in ADDED for a, b in found[k]]))
            for k, v in found.items():
                counts[k].append(len(v))
        longs = {k: pa.array(v, pa.int64()) for k, v in counts.items()}
        yield pa.record_batch(
            [batch.column("doc_id"), *(longs[k] for k in BASE), pa.array(shas, pa.string()), pa.array(spans, pa.string()), *(longs[k] for k in ADDED)],
            names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in ADDED)],
        )


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the counts by kind, the digest of the base spans, and all spans as kind:start:end."""
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_scan, _SCHEMA)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
