"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes, identifier and street cues) in the
whole text; at each anchor a deterministic local parser expands to the boundaries of what it stands for and validates it.

Base kinds: email, ip, card (Luhn), phone. Added kinds: masked (addresses written with [at] or (at)), login (a scheme
with user information), account (IBAN by its check number, or a cue and an identifier), street (a house number, name and
street word), secret (a cue, an equals sign or colon and a value of mixed letters and digits, or a key's known prefix).

Defined cases: null and empty texts have no spans; repeated rows get equal results each; offsets count code points, ends
are exclusive; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("masked", "login", "account", "street", "secret")
#: Cues in lower case; each is searched for in lower, upper and title case.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn")
STREET_CUES = ("street", "avenue", "road", "boulevard", "straße", "strasse", "rue", "calle")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key")
KEY_PREFIXES = ("AKIA", "ghp_", "gho_", "xoxb-", "xoxp-", "AIza", "sk_live_", "glpat-")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_MASKED = re.compile(r"\x20?[A-Za-z0-9-]+(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
_LOGIN = re.compile(r"[^\s/@:]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+")
_IDENT = re.compile(r"(?:\x20?(?:no|nr|number|n°)\.?)?\x20?[:#=]?\x20?([A-Z]{0,2}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: What follows a secret's cue, and a key after its prefix.
_SECRET = re.compile(r"""["']?\x20?(?:=>|[=:])\x20?["']?([A-Za-z0-9_/+=.~-]{16,256})(?![A-Za-z0-9_/+=.~-])""")
_KEY = re.compile(r"[A-Za-z0-9_-]{12,120}(?![A-Za-z0-9_-])")
_AFTER = re.compile(r"\x20(?:[^\W\d_]+\x20){0,3}?([0-9]{1,5}[a-z]?)(?![0-9A-Za-z])")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), ("[at]", "mask"), ("(at)", "mask"), *((str(d), "digit") for d in range(10))]:
        a.add_word(word, (kind, len(word)))
    for word in KEY_PREFIXES:
        a.add_word(word, ("key", len(word)))
    for cues, kind in ((ACCOUNT_CUES, "account"), (STREET_CUES, "street"), (SECRET_CUES, "secret")):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_found: list = []


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _left(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in LOCAL:
        at -= 1
    return at


def _account(text: str, cue: int, end: int) -> tuple[int, int] | None:
    m = _IDENT.match(text, end)
    if m is None or (cue and text[cue - 1].isalnum()):
        return None
    value = m[1]
    if _IBAN.fullmatch(value):
        return m.span(1) if iban_ok(value) else None
    return m.span(1) if 6 <= sum(c.isdigit() for c in value) <= 18 and sum(c.isalpha() for c in value) <= 3 else None


def _street(text: str, cue: int, end: int) -> tuple[int, int] | None:
    """A number, at most three capitalised words and the cue; or the cue, at most three words and a number."""
    if cue and text[cue - 1] == " ":
        at, words = cue - 1, 0
        while words <= 3 and at > 0:
            start = text.rfind(" ", max(0, at - 40), at) + 1
            word = text[start:at]
            if re.fullmatch(r"[0-9]{1,5}[a-z]?,?", word) and words:
                return start, end
            if not (word.isalpha() and word[0].isupper()) or not start:
                break
            at, words = start - 1, words + 1
    if text[cue : cue + 1].isupper() or text[cue:end].lower() in ("rue", "calle"):
        m = _AFTER.match(text, end)
        if m is not None and (cue == 0 or not text[cue - 1].isalnum()) and text[end + 1 : end + 2].isupper():
            return cue, m.end(1)
    return None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text, by kind as listed, then start."""
    if not _found:
        _found.append(_automaton())
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    email = ip = card = phone = run = 0  # where the search for each goes on
    for last, (kind, n) in _found[0].iter(text):
        at = last - n + 1
        if kind == "digit":
            if at >= ip and at >= run:
                if m := _IP.match(text, at):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        out["ip"].append(m.span())
                else:
                    run = _RUN.match(text, at).end()
            if at >= card and (m := _CARD.match(text, at)):
                card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
        elif kind == "at":
            start = _left(text, at, email)
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                out["email"].append((start, email))
        elif kind == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "mask":
            stop = at - (at > 0 and text[at - 1] == " ")
            start = _left(text, stop, 0)
            if start < stop and (m := _MASKED.match(text, last + 1)):
                out["masked"].append((start, m.end()))
        elif kind == "scheme":
            if m := _LOGIN.match(text, last + 1):
                start = at
                while start > 0 and text[start - 1].isascii() and text[start - 1].isalpha():
                    start -= 1
                if start < at:
                    out["login"].append((start, m.end()))
        elif kind == "account":
            if (s := _account(text, at, last + 1)) and s not in out["account"][-1:]:
                out["account"].append(s)
        elif kind == "secret":
            m = _SECRET.match(text, last + 1)
            if m and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
                out["secret"].append(m.span(1))
        elif kind == "key":
            m = _KEY.match(text, last + 1)
            if m and any(c.isdigit() for c in m[0]) and (at == 0 or not text[at - 1].isalnum()):
                out["secret"].append((at, m.end()))
        elif s := _street(text, at, last + 1):
            out["street"].append(s)
    return [(k, *s) for k, v in out.items() for s in (v if k in BASE else sorted(set(v)))]


@lean
def _batches(batches):
    for pdf in batches:
        spans = [[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in find(t)] if t else [] for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "spans": spans})


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, value)."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_batches, "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("end"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s.getField("kind") == kind)).cast("long")
    base = F.filter("spans", lambda s: s.getField("kind").isin(*BASE))
    return d.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
