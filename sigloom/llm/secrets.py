"""Secret scans by assignment-aware lexing.

A small lexer reads source and configuration syntax into pairs of a target name and a literal (or another name),
follows constants from name to name within the text, and scores each literal by how sensitive the names are that it
reaches, and by its shape. Plain patterns give base spans beside these.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigloom.llm.util import in_parts, small_batches

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # runs are maximal, so the shorter ones that fail overlap none of these
KINDS = ("assign", "access", "hex", "named")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Parts of names that hold secrets (score), and values that only stand for one.
SENSITIVE = {"password": 4, "passwd": 4, "passphrase": 4, "pwd": 4, "pass": 3, "secret": 4, "token": 3, "apikey": 4, "credential": 3, "credentials": 3, "auth": 2, "authorization": 3, "bearer": 3, "private": 2, "access": 1, "signing": 2, "encryption": 2, "client": 1, "api": 2, "key": 1, "salt": 2, "dsn": 2}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|changeme|change_me|example|sample|dummy|test|todo|none|null|true|false|password|secret|token|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s?)$")
#: A literal counts from this score on: names 0 to 7, shape 0 to 3.
THRESHOLD = 5

NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]{0,127}"
#: A target name and a sign. What follows is read by literal_at().
TARGET = re.compile(rf"""(?P<q>["']?)(?P<name>{NAME})(?P=q)(?:\[["'](?P<item>[^"'\n]{{1,128}})["']\])?[ \t]*+(?::=|=>|[:=])(?![:=])[ \t]*+""", re.ASCII)
#: Literals end with their own quote, whatever other quotes they hold, and have no greatest length; those in three quotes or in backticks may have many lines.
QUOTED = re.compile(
    r"""(?:[rbufRBUF]{1,2})?(?:\"{3}(?P<three>(?:[^"\\]++|\\(?s:.)|"(?!""))++)\"{3}|'{3}(?P<trio>(?:[^'\\]++|\\(?s:.)|'(?!''))++)'{3}"""
    r"""|"(?P<double>(?:[^"\\\n]++|\\(?s:.))++)"|'(?P<single>(?:[^'\\\n]++|\\(?s:.))++)'|`(?P<back>(?:[^`\\]++|\\(?s:.))++)`)"""
)
BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>&|]++""")
#: A block of lines follows that are indented more than the name's line.
BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*+(?:#[^\n]*+)?\r?\n")
#: What joins quoted literals into one value.
JOINT = re.compile(r"""["'`]{1,3}(?:\s*+(?:\+|\.\.|\.|&|\\)\s*+|[ \t]++)(?=["'`])""")
#: A declared type between the colon and the value's own sign.
TYPED = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\[\]\n]*+\])?[ \t]*+=(?![=>])[ \t]*+")
#: A name that is added to what stands before it.
ADDED = re.compile(rf"""["'`]{{0,3}}[ \t]*+\+[ \t]*+(?P<name>{NAME})(?![A-Za-z0-9_$.(\[-])""", re.ASCII)
SPACE = re.compile(r"\s*+")
ARMOUR = re.compile(r"""["'`]{0,3}(-----BEGIN [A-Z0-9 ]{1,64}-----)""")
ARMOUR_END = "-----END "
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
IDENT = re.compile(rf"\$?\{{?({NAME})\}}?", re.ASCII)


def name_score(name: str) -> int:
    """How sensitive a target name is: the sum over its words, in snake, kebab, dotted or camel case, one or many."""
    words = (w.lower() for w in dict.fromkeys(WORDS.findall(name)))
    return sum(SENSITIVE.get(w, SENSITIVE.get(w.removesuffix("s"), 0)) for w in words)


def shape_score(value: str) -> int:
    """0 to 3 by length and by how many kinds of characters mix; placeholders score below any threshold."""
    if len(value) < 8 or PLACEHOLDER.match(value) or len(set(value)) < 4:
        return -99
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(3, (kinds >= 2) + (kinds >= 3) + (len(value) >= 16) + (len(value) >= 32))


def block_at(text: str, start: int, sign: int) -> int:
    """The end of the lines from start on that are blank or indented more than the sign's line, the last blank ones left out."""
    indent = lambda line: len(line) - len(line.lstrip(" \t"))
    least, end, at = indent(text[text.rfind("\n", 0, sign) + 1 : sign]), start, start
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        if line.strip():
            if indent(line) <= least:
                break
            end = at + len(line.rstrip())
        at = stop + 1
    return end


def literal_at(text: str, at: int, sign: int, last_armour: int) -> tuple[int, int, bool, int] | None:
    """(start, end, quoted, where to read on) of the literal or name there, without its quotes; last_armour: where the last ARMOUR_END is."""
    armour = ARMOUR.match(text, at)
    if armour and armour.end() <= last_armour:
        end = text.find("-----", text.find(ARMOUR_END, armour.end()) + len(ARMOUR_END))
        if end >= 0:
            return armour.start(1), end + 5, True, end + 5
    m = QUOTED.match(text, at)
    if m:
        return m.start(m.lastgroup), m.end(m.lastgroup), True, m.start(m.lastgroup)
    m = BLOCK.match(text, at)
    if m:
        end = block_at(text, m.end(), sign)
        start = m.end() + len(text[m.end() : end]) - len(text[m.end() : end].lstrip())
        return (start, end, True, start) if end > m.end() else None
    m = BARE.match(text, at)
    return (m.start(), m.end(), False, m.end()) if m else None


def listed(text: str, at: int) -> list[tuple[int, int]]:
    """The quoted literals among the plain arguments or elements from there on, up to the bracket that closes them or anything else."""
    found = []
    while True:
        at = SPACE.match(text, at).end()
        m = QUOTED.match(text, at)
        if m:
            found.append((m.start(m.lastgroup), m.end(m.lastgroup)))
        else:
            m = BARE.match(text, at)
        if not m:
            return found
        at = SPACE.match(text, m.end()).end()
        if text[at : at + 1] != ",":
            return found
        at += 1


def pairs_of(text: str) -> Iterator[tuple[str, str, list[tuple[int, int]], bool]]:
    """(target name, value, its parts as (start, end), quoted) of each assignment, whatever its syntax. Long texts without = and : cost nothing.

    The scan starts at each sign and looks back over its line for the name, so its cost follows the number of signs. Assignments
    within a quoted literal are read as well.
    """
    done, last_armour = 0, text.rfind(ARMOUR_END)
    for sign in re.finditer("[:=]", text):
        if sign.start() < done:
            continue
        end = sign.start()
        while end > done and text[end - 1] in " \t":  # of blanks there may be any number: they are before one sign only
            end -= 1
        low = max(done, text.rfind("\n", max(0, end - 300), end) + 1, end - 300)
        back = re.search(rf"""["']?{NAME}["']?(?:\[["'][^"'\n]{{1,128}}["']\])?$""", text[low:end], re.ASCII)
        # A quote before the name that isn't the name's own opens what surrounds the assignment.
        m = (TARGET.match(text, low + back.start()) or TARGET.match(text, low + back.start() + 1)) if back else None
        if not m:
            continue
        at = m.end()
        typed = TYPED.match(text, at) if sign[0] == ":" else None
        if typed and QUOTED.match(text, typed.end()):
            at = typed.end()
        found = literal_at(text, at, sign.start(), last_armour)
        several = None
        if found and not found[2] and text[found[1] : found[1] + 1] == "(":  # a call: its name is no value, its last literal is
            several = listed(text, found[1] + 1)[-1:]
        elif not found and text[at : at + 1] in ("[", "(", "{"):
            several = listed(text, at + 1)
        if several is not None:
            if several:
                done = several[0][0]
                yield m["item"] or m["name"], "".join(text[a:b] for a, b in several), several, True
        elif found:
            start, end, quoted, done = found
            parts = [(start, end)]
            # Literals that a sign or mere space joins are one value: each has its span, and they are scored together.
            while quoted and (joint := JOINT.match(text, parts[-1][1])) and (more := QUOTED.match(text, joint.end())):
                parts.append((more.start(more.lastgroup), more.end(more.lastgroup)))
            yield m["item"] or m["name"], "".join(text[a:b] for a, b in parts), parts, quoted
            tail = parts[-1][1]
            while more := ADDED.match(text, tail):
                yield m["item"] or m["name"], more["name"], [more.span("name")], False
                tail = more.end()


def named_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through other names of the same text."""
    if ":" not in text and "=" not in text:
        return []
    literals: dict[str, list[tuple[str, list[tuple[int, int]]]]] = {}
    flows: dict[str, set[str]] = {}
    pairs = list(pairs_of(text))
    targets = {name for name, *_ in pairs}
    for name, value, parts, quoted in pairs:
        ident = IDENT.fullmatch(value)
        if not quoted and ident and ident[1] in targets:
            flows.setdefault(ident[1], set()).add(name)
        else:
            literals.setdefault(name, []).append((value, parts))
            flows.setdefault(name, set())
    best: dict[str, int] = {}

    def reaches(origin: str) -> int:
        """The highest score among the names that this one's value is passed on to."""
        if origin not in best:
            seen, todo = {origin}, [origin]
            while todo:
                for x in flows.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            best[origin] = max(map(name_score, seen))
        return best[origin]

    spans = []
    for name, found in literals.items():
        score = reaches(name)
        if score >= 3:
            spans += [span for value, parts in found if min(score, 7) + shape_score(value) >= THRESHOLD for span in parts]
    return sorted(set(spans))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns' matches, by start, then kind."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    lower = text.lower()
    if any(h in lower for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return sorted(spans)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    return base, sorted({*base, *((start, 3, end) for start, end in named_spans(text))})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if end > at:
            if start >= at:
                out += [text[at:start], mask]
            at = end
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text: str = "text", mask: str | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex, n_named (longs), base_sha256 and spans; with a mask, the text's spans are replaced by it.

    Spans are kind:start:end in code points, by start, then kind; end is exclusive. A null text has no spans and stays
    null; so do empty ones. Whole texts are read, whatever their length; a task holds about a megabyte of them at once. Repeated rows
    each get their result; columns of the result's names are replaced, others pass through.
    """
    small_batches(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    kept = docs.drop(*counts, "base_sha256", "spans")
    schema = T.StructType([*kept.schema, *(T.StructField(c, T.LongType()) for c in counts), *(T.StructField(c, T.StringType()) for c in ("base_sha256", "spans"))])

    at = kept.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, at):
            rows, texts = [], batch.column(at).to_pylist()
            for k, x in enumerate(texts):
                base, every = spans_of(x or "")
                rows.append([*(sum(kind == i for _, kind, _ in every) for i in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)])
                if mask is not None and every:
                    texts[k] = redacted(x, every, mask)
            columns, names = list(batch.columns), list(batch.schema.names)
            if mask is not None:
                columns[at] = pa.array(texts, batch.schema.field(at).type)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns + new, names=[*names, *counts, "base_sha256", "spans"])

    return kept.mapInArrow(scan, schema)
