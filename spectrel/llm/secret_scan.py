"""Secret scans by assignment-aware lexing.

The base patterns (``assign``, ``access``, ``hex``) are matched leftmost and without overlap, each kind
by itself. Beside them the text is lexed as source or configuration: names bound to literals (quoted
strings and triple-quoted ones, joined by ``+`` or adjacency, over lines in brackets; the bare value of a ``NAME=value``
or ``name: value`` line; indented blocks, here-documents, subscripts, arguments after a quoted name, elements of text)
and names bound to other names, ``$NAME`` included. A name inside a join stands for the first value bound to it. Values travel along name-to-name bindings, and a literal that reaches a
name which sounds sensitive is scored by that name and by its own look (length, variety of characters,
no placeholder; more than two blanks make a sentence only under names of weight under 0.8, and never of a
PEM block or a ``key=value;`` list). It is reported as ``literal``, or as ``constant`` if it came through another name.
A literal inside a base span is not reported twice.

Positions are code points, ends exclusive. Rows: a null text is empty and has no spans; whole texts are
scanned whatever their length; repeated rows are scanned alike; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: Kinds in the order in which spans of one start are listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal", "constant")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: A binding: name (perhaps quoted or a subscript), optional type note, operator; what follows is read by hand.
_BINDING = re.compile(r"""(?<![\w.-])([A-Za-z_][\w.-]*)["']?[ \t]*+\]?(?:[ \t]*+:[ \t]*+[&*]*+(?:'?\w++[ \t]++)?[A-Za-z_][\w.:\[\]<>?]*+(?=[ \t]*+=))?[ \t]*+(?::=|=>|=(?!=)|:(?![:/]))[ \t]*+""", re.A)
#: A call whose first argument is a quoted name; the next argument is its value.
_CALL = re.compile(r"""\(\s*+(["'])([A-Za-z_][\w.-]*+)\1\s*+,\s*+(?=[bBrRuUfF]{0,2}["'`])""", re.A)
#: An element of text alone.
_TAG = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*+([^<>]*+)</([A-Za-z_][\w.:-]*+)\s*+>", re.A)
_QUOTED = re.compile(r"""[bBrRuUfF]{0,2}(?:"{3}((?:[^"\\]|\\[\s\S]|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\[\s\S]|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)""")
_JOIN = re.compile(r"[ \t]*+(?:\\\n[ \t]*+)?(?:\+[ \t]*+(?:\\?\n[ \t]*+)?)?(?=[bBrRuUfF]{0,2}[\"'`])|[ \t]*+\+[ \t]*+(?:\\?\n[ \t]*+)?(?=[A-Za-z_$])")
#: The same inside brackets, where line ends do not matter.
_JOIN_OPEN = re.compile(r"\s*+(?:\+\s*+)?(?=[bBrRuUfF]{0,2}[\"'`])|\s*+\+\s*+(?=[A-Za-z_$])")
_OPEN = re.compile(r"\(\s*+")
_BARE = re.compile(r"[^\s\"'`,;#(){}\[\]<>]++")
_NAME = re.compile(r"(?:self\.|this\.|\$\{?)?([A-Za-z_][\w.]*+)\}?(?=[ \t]*+(?:[,;+)\]}#\n]|$))", re.A | re.M)
#: What may stand before a name that begins its line.
_LEAD = re.compile(r"""([ \t-]*+)(?:(?:export|set)(?=[ \t-])|["'])?[ \t-]*+""")
_SCALAR = re.compile(r"[|>][+-]?[1-9]?[+-]?[ \t]*+\r?\n")
_HERE = re.compile(r"<<<?[-~]?[ \t]*+([\"']?)([A-Za-z_]\w*+)\1[^\n]*+\n", re.A)
_INDENT = re.compile(r"[ \t]*+")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: How much a word, or two words in a row, of a name point to a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "creds": 0.8, "auth": 0.7, "bearer": 0.8, "signature": 0.6, "pin": 0.5,
    ("api", "key"): 1.0, ("access", "key"): 0.9, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9,
    ("encryption", "key"): 0.9, ("auth", "key"): 0.9, ("account", "key"): 0.8, ("connection", "string"): 0.8,
}
#: Words that say a name holds something about a secret and not the secret.
HARMLESS = {"length", "len", "count", "max", "min", "limit", "size", "name", "field", "label", "url", "uri", "path", "file", "type", "id", "hint",
            "regex", "pattern", "expires", "expiry", "ttl", "enabled", "required", "prompt", "policy", "placeholder", "example", "header"}
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|-+|_+|0+|none|null|nil|true|false|undefined|changeme|change_me|example|placeholder|redacted|password|secret|token|your[_-].*|my[_-].*|<.*>|\$\{.*\}|\$\w+|%\w+%|\{\{.*\}\}|todo.*)$", re.I | re.A)
THRESHOLD = 0.5
#: Fixed value: names of this weight hold secrets of any number of words.
STRONG = 0.8
_KEY_VALUES = re.compile(r"[ \t]*[A-Za-z][\w .-]*=[^;]*;[ \t]*[A-Za-z][\w .-]*=", re.A)


def name_score(name: str) -> float:
    """How much a name points to a secret, from its words (camel case, underscores, dots, dashes)."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    return max([SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE.get(p, 0.0) for p in zip(words, words[1:])])


def _sentence(value: str) -> bool:
    """Whether blanks make a literal prose; PEM blocks and ``key=value;`` lists have blanks of their own."""
    return value.count(" ") > 2 and "-----BEGIN" not in value and not _KEY_VALUES.match(value)


def literal_score(value: str, weight: float = 0.0) -> float:
    """How much a literal looks like a secret: length, variety of characters, not a placeholder; under a name
    whose ``weight`` is less than ``STRONG``, not a sentence either."""
    if len(value) < 8 or len(set(value)) < 5 or _PLACEHOLDER.match(value) or weight < STRONG and _sentence(value):
        return 0.0
    classes = sum(any(t(c) for c in value) for t in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.35 + 0.15 * classes + 0.01 * len(set(value)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


Part = tuple[int, int] | str  # a literal's span without its quotes, or a name


def _expression(text: str, at: int) -> list[Part]:
    """Quoted strings and names joined at ``at``, by ``+`` or by standing side by side, over lines inside brackets."""
    out: list[Part] = []
    bracket = _OPEN.match(text, at)
    join = _JOIN_OPEN if bracket else _JOIN
    at = bracket.end() if bracket else at
    while True:
        if m := _QUOTED.match(text, at):
            out.append(next(m.span(g) for g in range(1, 6) if m.group(g) is not None))
        elif m := _NAME.match(text, at):
            out.append(m.group(1))
        else:
            return out
        follow = join.match(text, m.end())
        if not follow or isinstance(out[-1], str) and "+" not in follow.group():
            return out
        at = follow.end()


class _Lines:
    """The lines of a text by their content, made when a here-document asks."""

    def __init__(self, text: str):
        self.text, self.places = text, None

    def after(self, at: int, word: str) -> int | None:
        """Where the first line from ``at`` on that is ``word``, blanks and brackets aside, begins."""
        if self.places is None:
            self.places, lo = {}, 0
            for line in self.text.split("\n"):
                self.places.setdefault(line.strip(" \t\r;)"), []).append(lo)
                lo += len(line) + 1
        places = self.places.get(word, [])
        k = bisect_left(places, at)
        return places[k] if k < len(places) else None


def _scalar(text: str, at: int, indent: int) -> tuple[int, int]:
    """Span of the lines from ``at`` that are blank or indented by more than ``indent``."""
    begin = end = at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        lead = _INDENT.match(text, at, stop).end()
        if lead < stop:
            if lead - at <= indent:
                break
            begin, end = (lead if begin == end else begin), stop
        at = stop + 1
    return begin, end


def bindings(text: str) -> list[tuple[str, list[Part]]]:
    """(name, parts joined to its value) in the order of the text."""
    found = []
    lines, line, lead, last = _Lines(text), 0, None, 0
    if "=" in text or ":" in text:
        for m in _BINDING.finditer(text):
            name, at = m.group(1).strip(".-"), m.end()
            newest = text.rfind("\n", last, m.start()) + 1
            if newest or lead is None:
                line = newest or line
                lead = _LEAD.match(text, line)
            last = m.start()
            if here := _HERE.match(text, at):
                if (stop := lines.after(here.end(), here.group(2))) is not None:
                    found.append((m.start(), name, [(here.end(), max(here.end(), stop - 1))]))
                continue
            # Bare values and blocks count where the binding begins its line, as in settings files.
            starts = m.start() in (lead.end(1), lead.end())
            if starts and (block := _SCALAR.match(text, at)):
                found.append((m.start(), name, [_scalar(text, block.end(), lead.end(1) - line)]))
                continue
            parts = _expression(text, at)
            if parts:
                found.append((m.start(), name, parts))
            if starts and not any(isinstance(p, tuple) for p in parts) and (bare := _BARE.match(text, at)):
                if text[bare.end():bare.end() + 1] in ("", "\n", "\r", ",", ";", " ", "\t", "#"):
                    found.append((m.start(), name, [bare.span()]))
    if "(" in text:
        found += [(m.start(), m.group(2).strip(".-"), parts) for m in _CALL.finditer(text) if (parts := _expression(text, m.end()))]
    if "</" in text:
        found += [(m.start(), m.group(1), [(m.start(2), m.start(2) + len(m.group(2).rstrip()))]) for m in _TAG.finditer(text) if m.group(1) == m.group(3)]
    return [(name, parts) for _, name, parts in sorted(found, key=lambda f: f[0])]


#: Fixed value: joined values of more characters are not carried through further joins.
LONGEST_JOIN = 65_536


def _value(text: str, parts: list[Part], values: dict[str, list[list[Part]]], seen: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The string of joined parts, and the spans it is made of; a name stands for the first value it was bound to."""
    string, spans_ = "", []
    for part in parts:
        if isinstance(part, tuple):
            string += text[part[0]:part[1]]
            spans_.append(part)
        elif part in values and part not in seen and len(seen) < 16:
            more, own = _value(text, values[part][0], values, (*seen, part))
            string, spans_ = string + more, spans_ + own
        if len(string) > LONGEST_JOIN:
            break
    return string, spans_


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals bound, directly or through other names, to names that sound sensitive."""
    bound = bindings(text)
    if not any(name_score(n) for n in {n for n, _ in bound}):
        return []
    values: dict[str, list[list[Part]]] = {}
    copies: dict[str, set[str]] = {}
    for name, parts in bound:
        if len(parts) == 1 and isinstance(parts[0], str):
            if parts[0] != name:
                copies.setdefault(name, set()).add(parts[0])
        else:
            values.setdefault(name, []).append(parts)
    found = {}
    for name in dict.fromkeys(n for n, _ in bound):
        weight = name_score(name)
        if not weight:
            continue
        # Everything the name can hold: its own literals, then those of the names it copies.
        seen, queue = {name}, [name]
        while queue:
            at = queue.pop()
            for parts in values.get(at, ()):
                string, made_of = _value(text, parts, values, (at,))
                if weight * literal_score(string, weight) >= THRESHOLD:
                    own = {p for p in parts if isinstance(p, tuple)} if at == name else set()
                    for span in made_of:
                        if span[0] < span[1] and found.get(span) != "literal":
                            found[span] = "literal" if span in own else "constant"
            for further in copies.get(at, ()):
                if further not in seen:
                    seen.add(further)
                    queue.append(further)
    return [(kind, a, b) for (a, b), kind in found.items()]


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind."""
    base = base_spans(text)
    covered: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    extra = []
    for s in lexed_spans(text):
        at = bisect_right(covered, s[1], key=lambda c: c[0]) - 1
        if at < 0 or s[2] > covered[at][1]:
            extra.append(s)
    return sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "spans array<struct<kind:string,start:bigint,end:bigint>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans), a row per document."""

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, _TYPE)], ["doc_id", "spans"])

    return tb.text_rows(docs, "doc_id").mapInArrow(run, "doc_id long, " + SPANS)


def span_text(column, kinds=KINDS):
    """``kind:start:end`` of the spans of ``kinds``, comma-joined."""
    kept = F.filter(column, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: str, mark: str) -> str:
    out, at = [], 0
    for _, a, b in sorted(spans(text), key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span, overlapping ones together, replaced by ``mark``; a null text stays null.

    ``n_chars`` follows the new text if the table has it.
    """

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else redacted(t, mark) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    tb.text_rows(docs)  # sets the batch size
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
