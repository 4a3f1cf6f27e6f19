"""Secret scan: assignment-aware lexing on top of three fixed patterns.

A text is lexed into comments, strings, brackets, lines and pairs of a target name and a value, in source and
configuration syntax (``name = "x"``, ``name: x``, ``"name": "x"``, ``name := x``, ``name => x``, ``name += x``,
``name: type = x``, ``--name x``, ``<name>x</name>``, ``scheme://user:x@host``). A value is a concatenation of literals
and names. A name stands for the literals that it was given before, so constants reach the targets that use
them, through concatenations too; what comments and other strings say is looked at but defines no constant.
Literals in the brackets of a value (arguments, lists), and pairs with a neutral name such as ``value`` there or in a
block that is indented under it, count for the name that the brackets or the block belong to. A literal is reported if its target's
name is sensitive and the value as a whole looks like a secret; one with white space only if the name alone says
all (weight 1). Private keys in PEM armour are reported wherever they stand. Every pattern is tried from one place once, so time is linear.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofsieve.llm.shared import fresh, per_text

#: Kinds in the order of the report: base patterns, literals by the target's name, literals that reach one through a constant, private keys.
BASE, KINDS = ("assign", "access", "hex"), ("assign", "access", "hex", "named", "constant", "armour")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 32 or more is the whole run, since it starts where the run does.
HEX = re.compile(r"[0-9a-f]{32,}")

QUOTED = r""""(?:\\.|[^"\\\n])*+"|'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\\n])*+`"""
#: The head of a private key, and all after it up to the next dashes; its foot; lines of a key that has none.
ARMOUR = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
ARMOURED = re.compile(r"(?:[^-]|-(?!----))*+")
FOOT = re.compile(r"-----END [A-Z0-9 ]+-----")
KEY_LINES = re.compile(r"(?:\s|\\[nr])*+(?:[A-Za-z0-9+/=]{16,}+(?:\s|\\[nr])*+)++")
KEY_LINE = re.compile(r"[A-Za-z0-9+/=]{16}")
#: One token. A pair ends behind its operator, where its value begins.
TOKEN = re.compile(
    r"""(?P<line>\n[ \t]*+(?:-[ \t]++)?)"""
    r"""|(?<!\S)(?P<comment>(?:\#|//|--(?=\s))[^\n]*+)"""
    r"""|(?P<block>/\*)"""
    r"""|(?P<pair>(?<![A-Za-z0-9_.$])(?<![A-Za-z0-9_]-)(["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)\5"""  # name, quoted or not
    r"""(?:[ \t]*+:[ \t]*+[A-Za-z_][A-Za-z0-9_.\[\]]*+(?=[ \t]*+=))?"""  # its type
    r"""[ \t]*+(?P<op>=>|:=|\+=|[:=](?![=/]))[ \t]*+)"""
    r"""|(?<!\S)--(?P<flag>[A-Za-z][A-Za-z0-9_-]*+)[ \t]++(?=[^\s-])"""
    r"""|<(?P<element>[A-Za-z_][A-Za-z0-9_.-]*+)>(?P<content>[^<>\n]++)</(?P=element)>"""
    r"""|(?P<open>[(\[{])|(?P<close>[)\]}])"""
    rf"""|(?<!\w)(?P<string>{QUOTED})"""
)
#: One term of a value: a literal in quotes (three of them first), or bare.
TERM = re.compile(rf"""(?P<head>[bBrRfFuU]{{0,2}}+)(?:(?P<long>\"{{3}}|'{{3}})|(?P<string>{QUOTED}))|(?P<bare>[^\s"'`,;(){{}}\[\]<>]++)""")
#: Between two terms of a concatenation: an operator, or nothing before another string.
JOIN = re.compile(r"""[ \t]*+(?:(?:\\?\n[ \t]*+)?(?:\+|\.\.?|&)\s*+(?=["'`A-Za-z_])|(?:\\\n[ \t]*+)?(?=["'`]))""")
USER = re.compile(r"""[^\s/:@"']*+:([^\s/@"']++)@""")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
WORDS = re.compile(r"[A-Za-z]+(?:[_.\-][A-Za-z]+)*")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Parts of names that make them sensitive, with their weight; of two adjacent parts, joined by a space.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.8, "auth": 0.6, "authorization": 0.7, "signature": 0.6, "salt": 0.6, "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0,
    "signing key": 1.0, "encryption key": 1.0, "account key": 0.9, "shared key": 0.9, "master key": 0.9, "session key": 0.9, "license key": 0.7,
}
#: Values that stand for a secret and are none.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|changeme|change_me|redacted|example.*|your[_-].*|my[_-].*|dummy.*|placeholder.*|<.*>|\$\{?.*|%\(?.*|\{\{.*|os\.environ.*|process\.env.*|env\..*)$")
LEAST_CHARS, THRESHOLD = 8, 0.7
#: Constants of a text stand for at most so many characters for each that it has, so that chains of them can't take more than linear time.
EXPANDED = 32
#: Last parts of names that say nothing themselves; the name around them counts.
NEUTRAL = {"value", "default", "data", "content", "text", "raw", "val", "string", "plain", "current"}


def name_weight(name: str) -> float:
    """0 to 1: how sensitive a target's name is."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if parts and parts[-1] in ("id", "name", "type", "count", "length", "path", "file", "url", "field", "hint", "policy", "expiry", "limit", "limits"):
        return 0.0
    return max([0.0, *(SENSITIVE.get(p, 0.0) for p in parts), *(SENSITIVE.get(f"{a} {b}", 0.0) for a, b in zip(parts, parts[1:], strict=False))])


def literal_weight(value: str, spaced: bool = False) -> float:
    """0 to 1: how much a literal looks like a secret, by entropy and kinds of characters. One with white space has none, unless ``spaced``; then it needs three kinds."""
    if len(value) < LEAST_CHARS or PLACEHOLDER.match(value):
        return 0.0
    counts = Counter(value)
    space = any(map(str.isspace, counts))
    if space and not spaced:
        return 0.0
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum() and not c.isspace()))
    return 0.0 if kinds < (3 if space else 2) else min(1.0, bits / 4) * (0.8 if kinds == 2 else 1.0)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


Part = tuple[int, int]


class Lexer:
    """The pairs of one text. ``found`` has, for each literal that is reported, its kind and score."""

    def __init__(self, text: str):
        self.text, self.found = text, {}
        #: Literals of the names so far; the names around, by bracket and by indentation; weights of names.
        self.known: dict[str, tuple[Part, ...]] = {}
        self.weights: dict[str, float] = {}
        #: Places of three quotes; scores of values; what constants may still stand for.
        self.triples: dict[str, list[int]] = {}
        self.scored: dict[tuple[bool, tuple[Part, ...]], float] = {}
        self.left = EXPANDED * (len(text) + 1024)

    def spend(self, n: int) -> bool:
        """Whether ``n`` more characters or parts of constants may be looked at."""
        if n > self.left:
            return False
        self.left -= n
        return True

    def closing(self, quotes: str, at: int, end: int) -> int:
        """Where three quotes stand next, or -1. Their places are listed once, so openings that nothing closes take no time."""
        if quotes not in self.triples:
            self.triples[quotes] = [m.start() for m in re.finditer(f"(?={quotes})", self.text)]
        places = self.triples[quotes]
        k = bisect_left(places, at)
        return places[k] if k < len(places) and places[k] + 3 <= end else -1

    def weight(self, name: str, around: str | None) -> float:
        """Of a target, or of the name around it where its own is neutral."""
        if name not in self.weights:
            self.weights[name] = name_weight(name)
        if around and not self.weights[name] and name.rpartition(".")[2].lower() in NEUTRAL:
            return 0.9 * self.weight(around, None)
        return self.weights[name]

    def report(self, weight: float, literals: tuple[Part, ...], through: tuple[Part, ...] = ()) -> None:
        """Literals of a target in their order; those in ``through`` reach it through a constant. Past the text's allowance for constants a target is judged by its own literals."""
        if not weight or not literals:
            return
        spaced = weight >= 1.0
        key = spaced, literals
        if key not in self.scored:
            if through and not self.spend(sum([b - a for a, b in through])):
                return self.report(weight, tuple([x for x in literals if x not in {*through}]))
            self.scored[key] = literal_weight("".join([self.text[a:b] for a, b in literals]), spaced)
        value, through = self.scored[key], {*through}
        if value and (score := 0.6 * weight + 0.4 * value) >= THRESHOLD:
            for part in literals:
                if part[0] < part[1] and (part not in self.found or self.found[part][1] < score):
                    self.found[part] = "constant" if part in through else "named", score

    def value(self, at: int, end: int) -> tuple[tuple[Part, ...], tuple[Part, ...], int]:
        """(literals of the value that begins at ``at``, those that come from constants, where it ends). No literals: not a constant."""
        text, literals, through, whole = self.text, [], [], True
        while m := TERM.match(text, at, end):
            at, own = m.end(), []
            if m["long"]:
                close = self.closing(m["long"], at, end)
                if close >= 0:
                    own, at = [(at, close)], close + 3
                else:
                    whole = False
            elif m["string"]:
                own = [(m.start("string") + 1, m.end("string") - 1)]
            elif m["bare"] in self.known or (name := m["bare"].rstrip("+.&")) in self.known:
                own = [*self.known[m["bare"] if m["bare"] in self.known else name]]
                at = m.start() + len(m["bare"] if m["bare"] in self.known else name)
                through += own
                whole = self.spend(len(own))
            elif IDENTIFIER.fullmatch(name) and not any(c.isdigit() for c in name):
                whole = False  # a name that is no constant, or a call
                at = m.start() + len(name)
            else:
                own = [m.span()]
            literals += own
            joint = JOIN.match(text, at, end)
            if not whole or not joint:
                break
            at = joint.end()
        return (tuple(literals), tuple(through), at) if whole else ((), (), at)

    def lex(self, at: int, end: int, define: bool = True) -> None:
        """All tokens of a part of the text; ``define``: whether its pairs make constants."""
        text, blocks = self.text, True
        around: list[tuple[str | None, bool]] = []  # for each open bracket the name that it belongs to, and whether its first literal is a key
        indented: list[tuple[int, str]] = []  # names that stand at an indentation without a value
        begins, indent, pending, key_first, fresh_line = at, 1, None, False, True
        while m := TOKEN.search(text, at, end):
            kind, at = m.lastgroup, m.end()
            if kind == "line":
                indent, fresh_line, pending = at - m.start(), True, None
                while indented and indented[-1][0] >= indent:
                    indented.pop()
                continue
            outer = next((n for n in (around[-1][0] if around else None, indented[-1][1] if indented else None) if n), None)
            if kind == "comment":
                if define:
                    self.lex(m.start() + 1, at, False)
            elif kind == "block":
                close = text.find("*/", at, end) if blocks else -1
                blocks = close >= 0
                if define and blocks:
                    self.lex(at, close, False)
                at = close if blocks else at
            elif kind == "open":
                around.append((pending or outer, key_first))
                pending, key_first = None, False
            elif kind == "close":
                if around:
                    around.pop()
            elif kind == "content":
                self.report(self.weight(m["element"], outer), ((m.start("content"), m.end("content")),))
            elif kind == "string":
                a, b = m.start("string") + 1, at - 1
                if around and around[-1][0]:
                    if around[-1][1]:
                        around[-1] = (around[-1][0], False)
                    elif not WORDS.fullmatch(text, a, b):
                        self.report(self.weight(around[-1][0], None), ((a, b),))
                if define:
                    self.lex(a, b, False)
            else:
                name, op = m["name"] or m["flag"], m["op"]
                begins_at = at
                literals, through, at = self.value(at, end)
                if define and op != "+=":
                    self.known.pop(name, None)
                if literals:
                    if op == "+=":
                        before = self.known.get(name, ())
                        before = before if self.spend(len(before)) else ()
                        literals, through = before + literals, before + through
                    if define and op:
                        self.known[name] = literals
                    self.report(self.weight(name, outer), literals, through)
                    for a, b in literals if define else ():
                        if a >= begins_at:  # its own, not those of constants
                            self.lex(a, b, False)
                elif op == "+=" and define:
                    self.known.pop(name, None)
                pending = name if text[at : at + 1] in ("(", "[", "{") else None
                key_first = pending is not None and text.endswith(("get", "env", "environ"), begins, at)
                if fresh_line and op == ":" and text[at : at + 1] in ("", "\n", "\r"):
                    indented.append((indent, name))
            fresh_line = False


def logins(text: str) -> list[Part]:
    """Places of the passwords in ``scheme://user:x@host``."""
    out, at = [], text.find("://")
    while at >= 0:
        if at and text[at - 1].isalnum() and (m := USER.match(text, at + 3)):
            out.append(m.span(1))
        at = text.find("://", at + 3)
    return out


def named_literals(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the literals of sensitive targets."""
    lexer = Lexer(text)
    if ":" in text or "=" in text or "</" in text or "--" in text:
        lexer.lex(0, len(text))
    for part in logins(text):
        lexer.report(1.0, (part,))
    return [(start, end, kind, score) for (start, end), (kind, score) in lexer.found.items()]


def armour(text: str) -> list[tuple[int, int, str, float]]:
    """Private keys in PEM armour, from head to foot; without a foot to the last line of the key."""
    out, at = [], 0
    while m := ARMOUR.search(text, at):
        at = ARMOURED.match(text, m.end()).end()
        foot = FOOT.match(text, at)
        if foot and KEY_LINE.search(text, m.end(), at):
            out.append((m.start(), foot.end(), "armour", 1.0))
        elif not foot and (key := KEY_LINES.match(text, m.end())):
            out.append((m.start(), m.end() + len(key[0].rstrip()), "armour", 1.0))
    return out


def uncovered(added: list[tuple[int, int, str, float]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """What no base span covers whole."""
    starts, most = [], []
    for a, b, _ in sorted(base):
        starts.append(a)
        most.append(max(b, most[-1] if most else 0))
    return [x for x in added if not (k := bisect_right(starts, x[0])) or most[k - 1] < x[1]]


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) by start, then kind. What a base span covers isn't reported again."""
    base = base_spans(text)
    added = uncovered(named_literals(text), base)
    if "-----BEGIN " in text:
        added += uncovered(armour(text), [*base, *((a, b, k) for a, b, k, _ in added)])
    found = sorted([*((a, KINDS.index(k), b, 1.0) for a, b, k in base), *((a, KINDS.index(k), b, s) for a, b, k, s in added)])
    return [(KINDS[k], a, b, s) for a, k, b, s in found]


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: its id (or the columns ``keep``) and ``found``, an array of
    (kind, start, end, score) in code points, ends exclusive.

    Null and empty texts have none; repeated rows and null ids stay; an empty table gives an empty
    table; other columns are ignored. Each text is lexed whole, in one pass of each pattern.
    """
    def work(texts: list[str]) -> list[pa.Array]:
        return [pa.array([[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans(t)] for t in texts], SPAN_TYPE)]

    return per_text(docs, text_column, [("found", SPANS)], lambda: work, keep or [id_column])


def listed(found: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark`` (spans that overlap count as one) and n_chars, if
    there is one, made to fit. Rows without spans stay as they are, null texts included."""
    columns, name = docs.columns, fresh("redacted", docs.columns)

    def work(texts: list[str]) -> list[pa.Array]:
        out = []
        for text in texts:
            parts, done = [], 0
            for _, start, end, _ in (found := spans(text)):
                if start >= done:
                    parts += [text[done:start], mark]
                done = max(done, end)
            out.append("".join([*parts, text[done:]]) if found else None)
        return [pa.array(out, pa.string())]

    done = per_text(docs, "text", [(name, "string")], lambda: work, columns)
    changed = done.withColumn("text", F.coalesce(name, "text"))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.when(F.col(name).isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return changed.select(*columns)
