"""Secret scans by assignment-aware lexing.

Source and configuration syntax is lexed into pairs of a name and a literal
(``name = "literal"``, ``"name": "literal"``, ``name: literal``,
``<name>literal</name>``). Constants are propagated: a name that was given a
literal, and a sum of literals and such names, stand for the literals they are
made of. Each pair is scored by how sensitive its name is and by how much its
literal looks like a secret; literals of pairs above the threshold are spans of
kind ``pair``, and so are blocks of private keys wherever they stand. A type
between a name and its literal (``name: str = "literal"``) is passed over. A quoted
phrase counts where the name's last word says that it is the secret itself and
the phrase doesn't speak of such a thing. Three base patterns are always reported as well.

A pair whose literal stands inside a base span of an assignment adds no span of
its own; ``n_pair`` and ``pairs`` of the digest tell it all the same.

Sums: a value takes operands until it has SUM_CHARS characters or SUM_PIECES
literals; every operand after that is a pair of its own with the same name, so no
literal is lost and a text that adds names to themselves stays in bounds. A
literal of any length is one literal. A text is scanned once, in linear time.

Nulls and empty texts have no spans, an empty table gives an empty result. Rows
are independent, so ties and repeated rows need no rule. Positions are code
points, ends exclusive. Other columns are kept; a column named like the result is
replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from hashlib import sha256
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column, map_batches, ship, texts_of

KINDS = ("assign", "access", "hex", "pair")
THRESHOLD = 0.6
SUM_CHARS, SUM_PIECES = 4096, 64

Span = tuple[int, int, int]

# -- base patterns -----------------------------------------------------------

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 24 or more is the whole run of [0-9a-f]+ that passes the length rule.
_HEX = re.compile(r"[0-9a-f]{24,}")
_BLOCK_START = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_BLOCK = re.compile(_BLOCK_START + r"(?:(?!-----)(?s:.))*+(?:-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)?")


def base_spans(text: str) -> list[Span]:
    """(start, kind index, end) of the base matches that pass their length rules, sorted."""
    out: list[Span] = []
    lower = text.lower()
    if ("=" in text or ":" in text) and any(k in lower for k in _KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# -- lexer -------------------------------------------------------------------

_LEX = re.compile(
    r"""(?P<triple>\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3})"""
    r"""|(?P<string>"(?:\\.|[^"\\\n])*"|(?<!\w)'(?:\\.|[^'\\\n])*'|`[^`\n]*`)"""
    r"""|(?P<tag><(?P<tagname>[A-Za-z_][\w.:-]*)>(?P<tagtext>[^<>\n]+)</(?P=tagname)>)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)"""
    r"""|(?P<compare>[=!<>]=+|=~|://|::)"""
    r"""|(?P<assign>:=|=>|=|:)"""
    r"""|(?P<join>\+|\.\.)"""
    r"""|(?P<line>\n)"""
    r"""|(?P<other>[^\s\w])"""
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>#]+""")
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*")
_SPACE = re.compile(r"[ \t]*")
_TYPE = r"[&*]{0,2}(?:'\w+ )?(?:mut )?[A-Za-z_][\w.]*(?:::\w+)*(?:\[[^\]\n=]{0,80}\]+|<[^>\n=]{0,80}>+)?[?!]?(?:\[\])?"
#: After a ':', a type and the '=' that gives the literal.
_TYPED = re.compile(rf"""[ \t]*{_TYPE}(?:[ \t]*\|[ \t]*{_TYPE}){{0,8}}(?:[ \t]*=(?=[ \t]*[rbfuRBFU]{{0,2}}["'`])|[ \t]+=(?=[ \t]+[^\s=]))""")


@dataclass(frozen=True)
class Piece:
    """A literal in the text: where its content stands."""

    start: int
    end: int
    quoted: bool


@dataclass(frozen=True)
class Pair:
    name: str
    pieces: tuple[Piece, ...]
    value: str
    score: float


def _string(text: str, m: re.Match) -> Piece:
    edge = 3 if m["triple"] else 1
    return Piece(m.start() + edge, max(m.start() + edge, m.end() - edge), True)


def pairs(text: str) -> list[Pair]:
    """The name-literal pairs in order, constants propagated, with their scores."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    out: list[Pair] = []
    known: dict[str, tuple[Piece, ...]] = {}
    at, name, lexed = 0, "", _LEX.match
    end = len(text)

    def give(name: str, pieces: tuple[Piece, ...]) -> None:
        known[name] = pieces
        value = "".join(text[p.start : p.end] for p in pieces)
        out.append(Pair(name, pieces, value, score(name, value, any(p.quoted for p in pieces))))

    def operand(at: int) -> tuple[tuple[Piece, ...], int] | None:
        at = _SPACE.match(text, at).end()
        if at >= end:
            return None
        m = lexed(text, at)
        if m and (m["triple"] or m["string"]):
            return (_string(text, m),), m.end()
        bare = _BARE.match(text, at)
        if not bare:
            return None
        ref = _NAME.match(text, at)
        if ref and ref[0] in known:
            after = text[ref.end() : ref.end() + 1]
            if not after or not (after.isalnum() or after in "/=_.-("):
                return known[ref[0]], ref.end()
        if bare[0][:2] == "${" or text[bare.end() : bare.end() + 1] in ("(", "["):
            return None
        stop = bare.end()
        while stop > at and text[stop - 1] in ".:!?":
            stop -= 1
        return ((Piece(at, stop, False),), bare.end()) if stop > at else None

    while at < end:
        m = _LEX.search(text, at)
        if not m:
            break
        kind, at = m.lastgroup, m.end()
        if m["name"]:
            name = m["name"]
        elif m["string"] or m["triple"]:
            p = _string(text, m)
            name = text[p.start : p.end] if p.end - p.start <= 100 else ""
        elif m["tag"]:
            give(m["tagname"], (Piece(m.start("tagtext"), m.end("tagtext"), True),))
            name = ""
        elif m["assign"] and name:
            target, name = name, ""
            if m["assign"] == ":" and (typed := _TYPED.match(text, at)):
                at = typed.end()
            found = operand(at)
            if not found:
                continue
            pieces, at = found
            size = sum(p.end - p.start for p in pieces)
            rest = []
            while (j := _SPACE.match(text, at).end()) < end and (p := lexed(text, j)) and p["join"]:
                more = operand(p.end())
                if not more:
                    break
                at = more[1]
                if size < SUM_CHARS and len(pieces) + len(more[0]) <= SUM_PIECES:
                    pieces += more[0]
                    size += sum(p.end - p.start for p in more[0])
                else:
                    rest.append(more[0])
            for one in dict.fromkeys(rest):
                give(target, one)
            give(target, pieces)
        elif kind == "other" and m["other"] in "])":
            pass
        else:
            name = ""
    return out


# -- scores ------------------------------------------------------------------

_SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.6, "secret": 1.0,
    "secrets": 0.9, "token": 0.9, "tokens": 0.6, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6,
    "authorization": 0.8, "bearer": 0.8, "signature": 0.5, "salt": 0.6, "cookie": 0.5, "dsn": 0.5,
}
_KEY_KINDS = {"api", "access", "private", "secret", "encryption", "signing", "master", "client", "auth", "service", "account", "storage", "session"}
_HARMLESS = {"name", "url", "uri", "path", "file", "type", "count", "length", "len", "size", "limit", "id", "field", "label", "hint", "regex", "policy", "expiry", "expires", "ttl"}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SPEAKS = re.compile(r"(?i)pass ?(?:word|wd|phrase|code)|secret|token|credential|\bkeys?\b|\bmust\b|\bplease\b|\binvalid\b")
_HOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|<.*>|\$\{.*|\{\{.*|%\w+%|(?:your|my|insert|enter|change|replace|example|sample|dummy|fake|test|todo|none|null|nil|true|false|undefined|redacted|placeholder)\b.*|changeme|os\.environ.*|process\.env.*)$")


def name_score(name: str) -> float:
    """0 to 1: how strongly the name says that its value is secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    best = max((_SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if any(a in _KEY_KINDS and b in ("key", "keys") for a, b in zip(words, words[1:])):
        best = 1.0
    return best * 0.3 if words and words[-1] in _HARMLESS else best


def names_phrase(name: str) -> bool:
    """Whether the name's last word says that the value itself is secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return bool(words) and (_SENSITIVE.get(words[-1], 0.0) >= 0.9 or words[-1] in ("pass", "key", "keys", "phrase"))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) if n else 0.0


def literal_score(value: str, quoted: bool, phrase: bool = False) -> float:
    """0 to 1: how much the literal looks like a key or a password, or a pass phrase where the name allows one."""
    if re.search(_BLOCK_START, value):
        return 1.0
    if len(value) < 6 or _HOLDERS.match(value):
        return 0.0
    if any(c.isspace() for c in value) and not (phrase and quoted and not _SPEAKS.search(value)):
        return 0.0
    sorts = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
    if sorts == 1 and not quoted:
        return 0.0
    return min(1.0, 0.25 * min(1.0, len(value) / 20) + 0.45 * min(1.0, entropy(value) / 3.5) + 0.1 * sorts)


def score(name: str, value: str, quoted: bool) -> float:
    of_name = name_score(name)
    if of_name < 0.5:
        return 0.0
    of_literal = literal_score(value, quoted, names_phrase(name))
    return 0.5 * of_name + 0.5 * of_literal if of_literal else 0.0


def sensitive(text: str, threshold: float = THRESHOLD) -> list[Pair]:
    return [p for p in pairs(text) if p.score >= threshold]


def spans(text: str, threshold: float = THRESHOLD, found: list[Pair] | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): literals inside a base span of an assignment aren't told twice. found: the sensitive pairs, if they are known."""
    base = base_spans(text)
    more = {(p.start, 3, p.end) for pair in (sensitive(text, threshold) if found is None else found) for p in pair.pieces if p.end > p.start}
    if "-----BEGIN " in text:
        more |= {(m.start(), 3, m.end()) for m in _BLOCK.finditer(text)}
    covered = [(a, b) for a, k, b in base if k == 0]
    extra, at = [], 0
    for a, k, b in sorted(more):
        while at < len(covered) and covered[at][1] < b:
            at += 1
        if not (at < len(covered) and covered[at][0] <= a):
            extra.append((a, k, b))
    return base, sorted(base + extra)


def redacted(text: str, found: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for a, _, b in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


# -- operators ---------------------------------------------------------------

_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(df: DataFrame, text: str = "text", into: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """Adds all spans as an array of kind, start and end."""
    ship(df.sparkSession)

    @F.arrow_udf("array<struct<kind:string,start:int,end:int>>")
    def found(a: pa.Array) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": x, "end": y} for x, k, y in spans(t or "", threshold)[1]] for t in a.to_pylist()], _FOUND)

    return df.withColumn(into, found(df[text]))


def redact(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The text with its secrets replaced; a null text stays null."""
    ship(df.sparkSession)

    @F.arrow_udf("string")
    def clean(a: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted(t, spans(t, threshold)[1]) for t in a.to_pylist()], pa.string())

    return df.withColumn(text, clean(df[text]))


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_pair long, pairs string"


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def secret_digest(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and digest of the base spans, all spans, and the sensitive pairs (name, score and the places of the literals) of each text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, told, n_pair, named = [], [], [], [], []
        for text in texts_of(batch, "text"):
            of_names = sensitive(text, threshold)
            base, found = spans(text, threshold, of_names)
            n_pair.append(len(of_names))
            named.append(",".join(f"{p.name}:{p.score:.2f}:{'+'.join(f'{x.start}-{x.end}' for x in p.pieces)}" for p in of_names))
            counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
            digests.append(sha256(joined(base).encode()).hexdigest())
            told.append(joined(found))
        cols = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        cols = [column(batch, "doc_id"), *cols, pa.array(digests, pa.string()), pa.array(told, pa.string()), pa.array(n_pair, pa.int64()), pa.array(named, pa.string())]
        return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in DIGEST.split(", ")])

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, DIGEST)
