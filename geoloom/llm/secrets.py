"""Secret scans by assignment-aware lexing.

Besides the base patterns (assign, access, hex) the scanner lexes source and configuration syntax in one pass: strings with
prefixes, escapes and triple quotes, comments, names, separators, braces and indentation. From these it reads name-literal
pairs: `name = "x"`, `name: "x"`, `"name": "x"`, `name := "x"`, `name => "x"`, `--name=x`, `a=x&b=y`, `name: type = "x"`,
`type name = "x"`, `var name type = "x"`, `<name>x</name>`, `key="name" value="x"`, and literals joined by `+` or standing
side by side. What stands inside strings and comments is no assignment. A bare right-hand side that names an earlier constant
of an open scope (braces, or the body of a def or class) stands for that constant, chains included. Every literal is scored
by its target's name and its own look; literals at or over THRESHOLD are added as spans of kind `literal`.

Constants are kept as places in the text, and no place is looked at more than a fixed number of times, so that time and memory
grow with the text's length alone.

Defined results: a null text is empty; an empty text has no spans; a text of any length is scanned whole; of equal findings at
one place the best scored name stays, of equal scores the first; repeated rows give repeated results; an empty table gives an
empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import id_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "literal")
#: Needed in a text before ASSIGN can match; a plain search is much faster than the pattern.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

QUOTED = r""""[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`]*+`"""
PREFIX = r"(?:(?<![\w$])[rRbBuUfFlL@$]{1,2})?"
TOKEN = re.compile(
    rf"""
    (?P<line>\n[ \t]*)
  | (?P<escape>\\.)
  | (?P<block>/\*|<!--)
  | (?P<comment>(?<!:)//[^\n]*|(?<!\S)\#[^\n]*)
  | {PREFIX}(?P<triple>\"\"\"|\'\'\')
  | (?P<string>{PREFIX}(?:{QUOTED}))
  | <(?P<tag>[A-Za-z_][\w.:-]*)(?:[ \t][^<>\n]*)?>(?P<inner>[^<>]*)</(?P=tag)>
  | (?P<skip>===?|!==?|<=|>=|->|::|[+*/%|^-]=(?!=))
  | (?P<sep>:=|=>|[=:])
  | (?P<word>[\w$]++(?:[.-][\w$]++)*+(?:'[a-z]{{1,2}}\b(?!'))?)
  | (?P<mark>[{{}};,()&|])
    """,
    re.X | re.S,
)
#: A type between a name's colon and the equals sign of its value.
TYPE = re.compile(r"""[ \t]*(?:&(?:'\w+[ \t]+)?(?:mut[ \t]+)?)?[A-Za-z_][\w.]*+(?:[\[<][\w \t.,|]*+(?:[\[<][\w \t.,|]*+[\]>][\w \t.,|]*+)*+[\]>])?(?:\[\])*(?:[ \t]*\|[ \t]*[\w.]++)*+[?!]?[ \t]*=(?![=>~])""")
TYPES_AFTER = frozenset({"string", "str", "byte", "bytes", "rune", "any", "text"})
GAP = re.compile(r"(?:[ \t(]|\\\r?\n)*+")
OPENING = re.compile(PREFIX + r"(\"\"\"|'''|[\"'`])")
STRING = re.compile(PREFIX + f"(?:{QUOTED})", re.S)
JOIN = re.compile(r"""[ \t]*(?:\+[ \t]*(?:\r?\n[ \t]*)?|\\\r?\n[ \t]*)?(?=[rRbBuUfFlL@$]{0,2}["'`])""")
#: An unquoted literal ends at a blank, quote, bracket, comma, ampersand or the next separator; it may end in padding.
BARE = re.compile(r"(?:(?:Bearer|Basic|Token)[ \t]++(?=\S))?((?:[^\s\"'`,;(){}\[\]<>&=:]|:(?!\s|\Z))++(?:={1,2}(?=[\s\"'`,;)}\]<>&]|\Z))?)")
#: What a string or its prefix begins with.
OPENERS = frozenset("\"'`rRbBuUfFlL@$")
#: Attributes that name the next attribute's value.
NAMING, NAMED = frozenset({"name", "key"}), frozenset({"value", "val", "default", "content"})
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How much a part of a target's name speaks for a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "secrets": 1.0, "token": 0.8, "tokens": 0.6, "apikey": 1.0, "api": 0.3, "key": 0.5, "private": 0.5, "access": 0.3,
    "credential": 0.9, "credentials": 0.9, "cred": 0.7, "creds": 0.7, "auth": 0.5, "authorization": 0.7, "bearer": 0.8, "signing": 0.4, "encryption": 0.4, "salt": 0.4, "session": 0.3, "cookie": 0.3, "client": 0.2,
}
#: Parts of names whose values only describe a secret.
HARMLESS = {"name", "id", "url", "uri", "path", "file", "type", "length", "len", "count", "size", "field", "label", "hint", "ttl", "expiry", "expires", "public", "max", "min"}
PLACEHOLDER = re.compile(r"(?i)\A(?:none|null|nil|true|false|undefined|changeme|change_me|example.*|your.*|test|todo|x+|\*+|\.+|<.*>|\$\{.*\}|%.*%|\{\{.*\}\})\Z")
THRESHOLD = 0.5


#: Characters of a name up to which its score is kept for the next time; longer ones are scored each time.
REMEMBERED = 256


def name_score(name: str) -> float:
    return remembered_score(name) if len(name) <= REMEMBERED else score_of(name)


def score_of(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    score = sum(SENSITIVE.get(p, 0.0) for p in dict.fromkeys(parts))
    return 0.25 * score if parts and parts[-1] in HARMLESS else min(score, 1.0)


remembered_score = lru_cache(4096)(score_of)


def literal_score(value: str) -> float:
    """0 to 1: length, entropy a character and mixed kinds of characters."""
    if len(value) < 8 or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(map(bool, (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value), re.search("[^A-Za-z0-9]", value))))
    if " " in value and kinds < 3:
        return 0.0
    return min(1.0, 0.25 * min(n, 20) / 20 + 0.45 * min(entropy, 4) / 4 + 0.1 * (kinds - 1) + 0.1 * bool(re.search("[0-9]", value)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


class Lexer:
    """One pass over a text; pairs() gives (name, pieces, quoted, whether a call or path goes on) of each assignment."""

    def __init__(self, text: str):
        self.text = text
        self.unclosed: set[str] = set()

    def closing(self, mark: str, at: int) -> int:
        """The place of the next mark that no backslash escapes, or -1; a mark that was missed once isn't looked for again."""
        if mark in self.unclosed:
            return -1
        while (at := self.text.find(mark, at)) > 0 and len(mark) == 3 and mark != "-->" and self.text[at - 1] == "\\":
            at += 1
        if at < 0:
            self.unclosed.add(mark)
        return at

    def string(self, at: int) -> tuple[int, int, int] | None:
        """Start and end of the content and end of the string that opens at this place."""
        m = OPENING.match(self.text, at)
        if not m:
            return None
        if len(m[1]) == 3 and (end := self.closing(m[1], m.end())) >= 0:
            return m.end(), end, end + 3
        m2 = STRING.match(self.text, at)
        return (m.start(1) + 1, m2.end() - 1, m2.end()) if m2 else None

    def value(self, at: int) -> tuple[list[tuple[int, int]], bool, int] | None:
        """(pieces, quoted, end) of the literal that stands at this place: strings, joined ones too, or a bare word."""
        text = self.text
        at = GAP.match(text, at).end()
        pieces = []
        while text[at : at + 1] in OPENERS and (found := self.string(at)):
            pieces.append(found[:2])
            end = found[2]
            joint = JOIN.match(text, end)
            if not joint:
                return pieces, True, end
            at = joint.end()
        if pieces:
            return pieces, True, end
        m = BARE.match(text, at)
        if not m or text.startswith("//", at) or text.startswith("/*", at):
            return None
        return [m.span(1)], False, m.end()

    def pairs(self) -> Iterator[tuple[str, list[tuple[int, int]], bool, int]]:
        """(name, pieces, quoted, depth): depth +1 and -1 with an empty name tell where a scope opens and closes."""
        text, at, n = self.text, 0, len(self.text)
        last = before = None  # the two names that stand before this place in its statement
        naming = None
        bodies: list[int] = []  # indents of open def and class statements
        fresh, heads = True, False
        while at < n:
            m = TOKEN.search(text, at)
            if not m:
                break
            kind, at = m.lastgroup, m.end()
            if kind == "line":
                last = before = None
                indent = len(m[0]) - 1
                if at < n and text[at] not in "\r\n#":
                    while bodies and bodies[-1] >= indent:
                        bodies.pop()
                        yield "", [], False, -1
                    if heads:
                        bodies.append(heads - 1)
                        yield "", [], False, 1
                    heads = 0
                fresh = True
                continue
            if kind == "block":
                mark = "*/" if m[0] == "/*" else "-->"
                end = self.closing(mark, at)
                at = end + len(mark) if end >= 0 else at
            elif kind == "comment" or kind == "escape":
                pass
            elif kind in ("triple", "string"):
                found = self.string(m.start())
                if found:
                    last, before, at = text[found[0] : found[1]], last, found[2]
            elif kind == "inner":
                yield m["tag"], [m.span("inner")], True, 0
            elif kind == "word":
                if fresh and m[0] in ("def", "class"):
                    line = text.rfind("\n", 0, m.start()) + 1
                    heads = m.start() - line + 1
                last, before = m[0], last
            elif kind == "mark":
                if m[0] in "{}":
                    yield "", [], False, 2 if m[0] == "{" else -2
                    naming = None if m[0] == "}" else naming
                last = before = None
            elif kind == "sep" and last is not None:
                if m[0] == ":" and (typed := TYPE.match(text, at)):
                    at = typed.end()
                elif m[0] == "=" and before is not None and last in TYPES_AFTER:
                    last = before
                found = self.value(at)
                name, last, before = last, None, None
                if found:
                    pieces, quoted, end = found
                    if quoted and name in NAMING:
                        naming = text[pieces[0][0] : pieces[-1][1]]
                    elif naming is not None and name in NAMED:
                        name, naming = naming, None
                    if quoted or not text.startswith("(", end):
                        yield name, pieces, quoted, 0
                    if not quoted and end < n and text[end] in "=:":
                        last = text[pieces[0][0] : pieces[0][1]]
                    at = end
            fresh = False


def scoped(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(name, places of its literal) of each assignment; names of constants in open scopes are resolved."""
    known: dict[str, list] = {}  # name -> what it stands for, innermost scope last
    scopes: list[tuple[int, list[str]]] = [(0, [])]  # kind (1 body, 2 braces), names defined there
    opened = Counter()
    for name, pieces, quoted, depth in Lexer(text).pairs():
        if depth > 0:
            scopes.append((depth, []))
            opened[depth] += 1
        elif depth < 0:
            while opened[-depth]:
                kind, names = scopes.pop()
                opened[kind] -= 1
                for own in names:
                    known[own].pop()
                if kind == -depth:
                    break
        else:
            if not quoted and (old := known.get(text[pieces[0][0] : pieces[0][1]])):
                pieces = old[-1]
            known.setdefault(name, []).append(pieces)
            scopes[-1][1].append(name)
            yield name, pieces


def literal_spans(text: str) -> list[tuple[int, int, int, str, float]]:
    """(start, 3, end, name, score) of the literals that the scorer takes for secrets."""
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    looks: dict[tuple[int, int], float] = {}
    found: dict[tuple[int, int], tuple[str, float]] = {}
    for name, pieces in scoped(text):
        by_name = name_score(name)
        if by_name < THRESHOLD:
            continue
        at = pieces[0][0], pieces[-1][1]
        if at not in looks:
            looks[at] = literal_score("".join(text[a:b] for a, b in pieces))
        score = by_name * looks[at]
        if score >= THRESHOLD and score > found.get(at, ("", 0.0))[1]:
            found[at] = (name, score)
    return [(start, 3, end, *how) for (start, end), how in sorted(found.items())]


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, float]]]:
    """Base spans, and the method's spans that no base span holds."""
    base, more, reach, k = base_spans(text), [], 0, 0
    for start, kind, end, name, score in literal_spans(text):
        while k < len(base) and base[k][0] <= start:
            reach, k = max(reach, base[k][2]), k + 1
        if end > reach:
            more.append((start, kind, end, name, score))
    return base, more


def joined(spans) -> str:
    return ",".join(f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans)


FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("findings", pa.list_(FINDING))])
OUT_DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, findings array<struct<kind:string,start:long,end:long,name:string,score:double>>"


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = {k: [] for k in OUT.names[1:]}
            for text in part.column("text").to_pylist():
                base, more = scan_text(text or "")
                kinds = Counter(s[1] for s in base)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    rows[name].append(kinds[k])
                rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                both = sorted([*((*s, None, 1.0) for s in base), *more], key=lambda s: s[:3])
                rows["spans"].append(joined(both))
                rows["findings"].append([{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "name": s[3], "score": s[4]} for s in both])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v, OUT.field(k).type) for k, v in rows.items())], schema=OUT)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """A row for each document: counts and digest of the base spans, all spans, and findings with names and scores."""
    return id_text(docs).mapInArrow(scan_batches, OUT_DDL)


def redacted(text: str, mark: str) -> str:
    """The text with the secret part of every span replaced by mark."""
    base, more = scan_text(text)
    cuts = sorted([(s[0], s[2], s[1]) for s in (*base, *more)])
    out, at = [], 0
    for start, end, kind in cuts:
        if kind == 0 and (m := ASSIGN.match(text, start)):
            start = m.start(2)
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with the secrets in text_col replaced by mark; all columns stay, and n_chars, if there, follows the new text."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [x if x is None else redacted(x, mark) for x in part.column(at).to_pylist()]
                yield part.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length(text_col).cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
