"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds its anchors: at-signs, schemes, plus signs, digits and identifier cues. A local
parser then expands each anchor to both sides and validates what it finds. Nothing else of the text is looked at, so
the cost is the automaton's, whatever the length; a parser reads a character at most a constant number of times.

Kinds, in this order: email, ip, card, phone (the base), then obfuscated (``name [at] host [dot] tld``), userinfo (``user:password@`` after a
scheme), iban (country, check digits modulo 97), account (8 to 17 digits after a cue), secret (the value after a cue).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestar.llm.common import batch, each, table

KINDS = ("email", "ip", "card", "phone", "obfuscated", "userinfo", "iban", "account", "secret")
BASE = 4
_RANK = {k: i for i, k in enumerate(KINDS)}
#: Cues, in lower case; each also counts in upper case and with a first capital.
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey")
AT_CUES = ("[at]", "(at)", "{at}", " at ")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"\s?([A-Za-z0-9-]+)(?:\s?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.)\s?([A-Za-z0-9-]+))+", re.I)
_USER = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"\s*(?:no\.?|number|nr\.?|#)?\s*[:=]?\s*([0-9](?:[\x20-]?[0-9]){7,16})(?![0-9])", re.I)
_SECRET = re.compile(r"\s{0,16}[:=]\s{0,16}([\"']?)([A-Za-z0-9_\-+/=.]{12,})\1")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("userinfo", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("obfuscated", AT_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


_AC = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _back(text: str, at: int, least: int, allowed: frozenset) -> int:
    """First position of the run of allowed characters that ends before at, not below least."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def find(text: str | None) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, by start, then kind. Null and empty texts have none.

    The base spans are the leftmost non-overlapping matches of each base pattern; a match that fails its check is
    dropped and search goes on behind it. Added spans may overlap the base ones.
    """
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    email = ip = card = phone = secret = -1  # where search goes on
    for last, (kind, size) in _AC.iter(text):
        if kind == "digit":
            if last >= card:
                m = _DIGITS.match(text, last)
                if m:
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append(("card", last, card))
                else:
                    card = last + 1
            # the first digit of a run: only there can an address begin
            if last >= ip and (last == 0 or last == ip or text[last - 1] not in _DIGIT):
                m = _IP.match(text, last)
                if m:
                    ip = m.end()
                    if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split(".")):
                        spans.append(("ip", last, ip))
            if last >= 3 and (last == 3 or not text[last - 4].isalnum()) and text[last - 1] in _DIGIT and text[last - 2].isupper() and text[last - 3].isupper():
                m = _IBAN.match(text, last - 3)
                if m and _iban_ok(m[0]):
                    spans.append(("iban", last - 3, m.end()))
        elif kind == "email":
            if last >= email:
                start = _back(text, last, max(email, 0), _LOCAL)
                m = _DOMAIN.match(text, last + 1) if start < last else None
                if m:
                    email = m.end()
                    spans.append(("email", start, email))
        elif kind == "phone":
            m = _PHONE.match(text, last) if last >= phone else None
            if m:
                phone = m.end()
                if 9 <= sum(c in _DIGIT for c in m[0]) <= 15:
                    spans.append(("phone", last, phone))
        elif kind == "userinfo":
            m = _USER.match(text, last + 1)
            if m:
                spans.append(("userinfo", last + 1, m.end()))
        elif kind == "obfuscated":
            cue = last - size + 1
            end = cue - 1 if cue > 0 and text[cue - 1] == " " else cue
            start = _back(text, end, max(0, end - 64), _LOCAL)
            m = _DOTTED.match(text, last + 1, last + 256) if start < end else None
            if m and (text[cue] != " " or re.search(r" dot |[\[({]dot[\])}]", m[0], re.I)):
                spans.append(("obfuscated", start, m.end()))
        elif kind == "account":
            m = _ACCOUNT.match(text, last + 1, last + 96)
            if m:
                spans.append(("account", *m.span(1)))
        else:
            m = _SECRET.match(text, last + 1) if last >= secret else None  # cues within a value are part of it
            if m:
                secret = m.end()
                spans.append(("secret", *m.span(2)))
    spans.sort(key=lambda s: (s[1], _RANK[s[0]], s[2]))
    return spans


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    spans = find(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _find(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows: list[list] = [[] for _ in range(7)]
    for text in b.column("text"):
        spans = find(text.as_py())
        base = [s for s in spans if _RANK[s[0]] < BASE]
        kinds = [s[0] for s in base]
        row = (*(kinds.count(k) for k in KINDS[:BASE]), hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans) - len(base))
        for column, value in zip(rows, row, strict=True):
            column.append(value)
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
    yield batch(doc_id=b["doc_id"], **{n: pa.array(v, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, v in zip(names, rows, strict=True)})


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text; other columns are ignored), whole texts; a null or empty text has no spans."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each(_find), _FOUND)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def _redact(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at = b.schema.get_field_index("text")
    yield b.set_column(at, b.schema.field(at), pa.array([redact(t.as_py()) for t in b.column(at)], b.schema.field(at).type))


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same documents, their spans redacted; n_chars, where there is one, is that of the new text."""
    out = docs.mapInArrow(each(_redact), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


queries = {"op1_pii": op1_pii}
oracle_sql: dict[str, str] = {}
