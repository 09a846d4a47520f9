"""Secret scans: base patterns and assignment-aware lexing.

The lexer cuts a text into strings, names, operators and brackets, and reads
source and configuration syntax into pairs of a name and a value: assignments,
keyed literals (JSON, YAML, INI, shell), a ``name`` and its ``value``, XML
elements and attributes, options of commands.  A value is a literal, several
that are joined, or other names.  Names mean what they were last given, in
their scope, so the pairs make a graph without cycles in the order of the
text; one pass over it from the end gives each literal the most sensitive name
that it reaches.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, small_batches, tidy

#: Order of the kinds where spans start together.
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Words of a name and how sensitive they make it.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.7, "authorization": 0.7, "signature": 0.6, "private": 0.6}
#: Before "key" these make a name sensitive.
KEYS = {"api", "access", "private", "secret", "signing", "encryption", "master", "account"}
#: Keys whose literal names the value that follows, and keys of such values.
NAMING, VALUES = {"name", "key", "id", "variable"}, {"value", "val", "default", "content"}
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|change_?me.*|example.*|your[_-].*|placeholder.*|none|null|true|false|todo.*)$|^\$\{|^\{\{|^<|^%")
#: Strings are possessive, and an escaped character outside of one is a token: so an unclosed quote is read to the end of its line once for each kind of quote.
TOKEN = re.compile(
    r"""(?P<triple>\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})|(?P<string>"(?:\\.|[^"\\\n])*+"|(?<!\w)'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\\n])*+`)|(?P<tag><[A-Za-z_][\w:.-]*)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)|(?P<op>:=|=>|==|!=|<=|>=|\+=|\|\||\?\?|[:=+,;(){}\[\]>])|(?P<comment>\#|//)|(?P<line>\n[ \t]*)|(?P<space>\s+)|(?P<other>\\.|[^\s\w"'`<\\#/|?]+|.)""",
    re.ASCII,
)
#: The sign of a block scalar after a key's colon, and the line that follows.
BLOCK, DEEPER = re.compile(r"[ \t]*[|>][+-]?[ \t]*(?=\n)"), re.compile(r"\n([ \t]+)(\S[^\n]*?)[ \t]*(?=\n|$)")
UNQUOTED = re.compile(r"""[^\s"'`,;(){}\[\]<>|]+""")
_WORD = r"(?i:pwd|pass|secret|token|key|credential|bearer|auth|signature|private)[A-Za-z0-9_$.-]*"
#: RE2; a text that it doesn't match can hold no span of any kind.
SCREEN = "|".join((
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}""",
    _WORD + r"""(?:["'`]?\]?\s*\+?(?::=|=>|[:=>])|["'`]\s*[,}/>\n]|(?:\s*,\s*[A-Za-z0-9_$.]+)+\s*=)""",
    r"""[:=]\x20*["'`]?[A-Za-z0-9_$.-]*""" + _WORD + r"""["'`]?\s*\n|--[A-Za-z0-9_-]*""" + _WORD + r"\x20",
))


def sensitivity(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    best = max((SENSITIVE.get(w, SENSITIVE.get(w.removesuffix("s"), 0.0)) for w in words), default=0.0)
    joined = any(b == "key" and a in KEYS for a, b in zip(words, words[1:], strict=False))
    return max(best, 1.0 if joined else 0.0)


def literal_score(value: str) -> float:
    """0 for what is no secret, up to 1 for long literals of many different characters."""
    if len(value) < 8 or PLACEHOLDER.search(value) or re.search(r"\s", value):
        return 0.0
    bits = -sum((n := value.count(c) / len(value)) * math.log2(n) for c in set(value))
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 3.5) * (1.0 if mixed >= 2 else 0.5)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Given:
    """What a name was given: literals (start, end, value) and what other names held then."""

    score: float
    literals: list[tuple[int, int, str]] = field(default_factory=list)
    came_from: list[Given] = field(default_factory=list)


@dataclass
class Frame:
    """An open bracket, tag or function."""

    kind: str
    serial: int
    indent: int = 0
    owner: str = ""
    given: Given | None = None
    naming: str = ""
    declared: list[str] = field(default_factory=list)


class Lexer:
    """Reads one text, once from start to end."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup != "space"]
        self.tokens.append(("end", len(text), len(text)))
        self.frames = [Frame("", 0)]
        self.open = dict.fromkeys(("{", "[", "(", "tag", "def"), 0)
        self.serial = 0
        self.defs: list[int] = []
        self.bound: dict[str, list[tuple[Given, int]]] = {}
        self.all: list[Given] = []
        self.last_tag = text.rfind("<")
        self.comment = -1  # where the comment ends that was met last
        self.indent = 0  # of the line

    # scopes
    def push(self, kind: str, indent: int = 0, owner: str = "", given: Given | None = None) -> None:
        self.serial += 1
        self.frames.append(Frame(kind, self.serial, indent, owner, given))
        if kind == "def":
            self.defs.append(self.serial)
        self.open[kind] += 1

    def pop(self, kind: str) -> Frame | None:
        """Close the innermost frame of a kind and all in it."""
        while self.open[kind]:
            frame = self.frames.pop()
            self.open[frame.kind] -= 1
            if frame.kind == "def":
                self.defs.pop()
            for name in frame.declared:
                self.bound[name].pop()
            if frame.kind == kind:
                return frame
        return None

    def bind(self, name: str, given: Given, local: bool) -> None:
        held = self.bound.setdefault(name, [])
        inner = self.defs[-1] if self.defs else 0
        if held and not local and held[-1][1] >= inner:
            held[-1] = (given, held[-1][1])
        else:
            held.append((given, self.frames[-1].serial))
            self.frames[-1].declared.append(name)

    # tokens
    def is_op(self, i: int, *ops: str) -> bool:
        kind, a, b = self.tokens[min(i, len(self.tokens) - 1)]
        return kind == "op" and self.text[a:b] in ops

    def content(self, i: int) -> tuple[int, int, str]:
        kind, a, b = self.tokens[i]
        n = 3 if kind == "triple" else 1
        return a + n, b - n, self.text[a + n : b - n]

    def is_string(self, i: int) -> bool:
        return self.tokens[min(i, len(self.tokens) - 1)][0] in ("string", "triple")

    def over_lines(self, i: int) -> int:
        while self.tokens[i][0] == "line":
            i += 1
        return i

    def give(self, name: str, literals, came_from) -> Given:
        given = Given(sensitivity(name), list(literals), list(came_from))
        self.all.append(given)
        return given

    def value(self, i: int, name: str, op: str, local: bool) -> int:
        """Read what ``name`` is given from token ``i`` on; returns the token after it."""
        text, tokens = self.text, self.tokens
        after = self.over_lines(i)
        if after > i and (self.is_string(after) or self.frames[-1].kind in ("{", "[", "(")):
            i = after
        literals, came_from, pieces, chain = [], [], [], [name]
        keyword = self.open["("] > 0  # of a call; nothing is bound
        if self.is_op(i, "(") and tokens[i][1] >= self.comment:
            self.push("(", self.indent)
            i = self.over_lines(i + 1)
        if op == "+=" and self.bound.get(name):
            came_from.append(self.bound[name][-1][0])
        if op == ":" and (block := BLOCK.match(text, tokens[i - 1][2])) and (scalar := self.block(block.end())):
            literals.append(scalar)
            while tokens[i][0] != "end" and tokens[i][1] < scalar[1]:
                i += 1
        while True:
            kind, a, b = tokens[i]
            if self.is_op(i, "[", "{") and not (pieces or came_from or literals):  # members belong to the name
                i += 1
                break
            if kind in ("string", "triple"):
                pieces.append(self.content(i))
                i += 1
            elif kind == "name" and self.is_op(i + 1, "(") and tokens[i + 1][1] == b:
                # a call: of its first arguments those that look like no name
                for k in range(i + 2, min(i + 10, len(tokens))):
                    if self.is_op(k, ")", ";", "{"):
                        break
                    if self.is_string(k) and re.search(r"[0-9]", self.content(k)[2]) and not self.is_op(k + 1, ":", "="):
                        literals.append(self.content(k))
                i += 1
                break
            elif kind == "name" and not pieces and not came_from and self.is_op(i + 1, "="):
                if op == ":":  # the name of a type stood between
                    op = "="
                else:
                    chain.append(text[a:b])
                i += 2
                continue
            elif kind in ("name", "other", "tag"):
                run = UNQUOTED.match(text, a)
                whole = run[0].rstrip(".") if run else ""
                if kind == "name" and self.bound.get(text[a:b]):
                    came_from.append(self.bound[text[a:b]][-1][0])
                    i += 1
                elif whole:
                    literals.append((a, a + len(whole), whole))
                    while tokens[i][1] < run.end() and tokens[i][0] != "end":
                        i += 1
                else:
                    i += 1
                    break
                if self.is_op(i, "||", "??") and whole:
                    # what stands before is asked first, and what follows is given without it
                    literals = [x for x in literals if x[0] != a]
            else:
                break
            if self.is_op(i, "||", "??"):
                i = self.over_lines(i + 1)
                if self.is_string(i):
                    continue
                break
            # joined by an operator, or by standing together
            if self.is_op(i, "+"):
                i = self.over_lines(i + 1)
            elif self.is_string(i) or self.is_string(j := self.over_lines(i)) and self.open["("] + self.open["["] and not self.is_op(j + 1, ":", "=", "=>"):
                if not pieces:
                    break
                i = self.over_lines(i)
            else:
                break
        if pieces:
            literals.append((pieces[0][0], pieces[-1][1], "".join(p[2] for p in pieces)))
        for own in reversed(chain):
            given = self.give(own, literals, came_from)
            literals, came_from = [] if own != name else literals, [given]
            if not keyword:
                self.bind(own, given, local)
        if self.is_op(i - 1, "[", "{") and tokens[i - 1][0] == "op":
            self.push(text[tokens[i - 1][1]], owner=name, given=given if self.is_op(i - 1, "[") else None)
            return i
        frame = self.frames[-1]
        short = name.rsplit(".", 1)[-1].lower()
        if short in NAMING and literals:
            frame.naming = literals[0][2]
        elif short in VALUES:
            given.score = max(given.score, sensitivity(frame.naming), sensitivity(frame.owner))
            frame.naming = ""
        return i

    def block(self, at: int) -> tuple[int, int, str] | None:
        """The first line of a block scalar that starts on the line at ``at``, if it is deeper than the line of its key."""
        found = DEEPER.match(self.text, at)
        if not found or len(found[1]) <= self.indent:
            return None
        return found.start(2), found.end(2), found[2]

    def element(self, frame: Frame, at: int) -> None:
        """The text of an XML element that starts at ``at``."""
        stop = self.text.find("<", at) if at <= self.last_tag else -1
        if stop >= 0 and self.text[stop + 1 : stop + 2] == "/":
            inner = self.text[at:stop]
            if value := inner.strip():
                start = at + len(inner) - len(inner.lstrip())
                given = self.give(frame.owner, [(start, start + len(value), value)], [])
                given.score = max(given.score, sensitivity(frame.naming))

    def read(self) -> list[Given]:
        text, tokens, i = self.text, self.tokens, 0
        fresh = True  # at the start of a line
        while tokens[i][0] != "end":
            kind, a, b = tokens[i]
            if kind == "line":
                after = self.tokens[i + 1]
                if self.open["def"] and after[0] not in ("line", "end"):
                    while self.frames[-1].kind == "def" and b - a - 1 <= self.frames[-1].indent:
                        self.pop("def")
                if after[0] not in ("line", "end"):
                    self.indent = b - a - 1
                    # a call that is still open ends where a statement begins that isn't deeper than it
                    while self.frames[-1].kind == "(" and self.indent <= self.frames[-1].indent and not self.is_op(i + 1, ")", "]", "}"):
                        self.pop("(")
                fresh, i = True, i + 1
                continue
            begins, fresh = fresh, False
            if kind == "comment" and a < self.comment:
                i += 1
            elif kind == "comment":
                self.comment = (text.find("\n", a) + 1 or len(text) + 1) - 1
                i += 1
            elif kind == "op" and a < self.comment:
                i += 1
            elif kind == "op":
                c = text[a:b]
                if c in ("{", "[", "("):
                    self.push(c, self.indent)
                elif c in ("}", "]", ")"):
                    self.pop({"}": "{", "]": "[", ")": "("}[c])
                elif c == ">" and self.frames[-1].kind == "tag":
                    frame = self.pop("tag")
                    if text[a - 1] != "/":
                        self.element(frame, b)
                i += 1
            elif kind == "tag":
                self.push("tag", owner=text[a + 1 : b].rsplit(":", 1)[-1])
                i += 1
            elif kind in ("string", "triple", "name"):
                name = text[a:b] if kind == "name" else self.content(i)[2]
                j = i + 1
                if kind == "name" and begins and name in ("def", "class"):
                    self.push("def", indent=a - text.rfind("\n", 0, a) - 1)
                    i += 1
                    continue
                if self.is_op(j, "[") and tokens[j][1] == b and self.is_string(j + 1) and self.is_op(j + 2, "]"):
                    name, j = self.content(j + 1)[2], j + 3
                if self.is_op(j, "=", ":", ":=", "=>", "+=") and len(name) <= 200:
                    op = text[tokens[j][1] : tokens[j][2]]
                    local = i > 0 and tokens[i - 1][0] == "name" and text[tokens[i - 1][2] : a].strip(" ") == "" and kind == "name"
                    i = self.value(j + 1, name, op, local)
                elif kind == "name" and text[a - 2 : a] == "--" and text[b : b + 1] == " " and (run := UNQUOTED.match(text, b + 1)) and run[0][0] != "-":
                    self.give(name, [(run.start(), run.end(), run[0])], [])
                    i += 1
                elif kind == "name" and self.is_op(j, ",") and begins:
                    i = self.several(i)
                else:
                    if kind != "name" and (given := self.frames[-1].given) is not None:
                        given.literals.append(self.content(i))
                    i += 1
            else:
                i += 1
        return self.all

    def several(self, i: int) -> int:
        """``a, b = x, y`` on one line, of as many values as names."""
        names, j = [], i
        while self.tokens[j][0] == "name":
            names.append(self.text[self.tokens[j][1] : self.tokens[j][2]])
            if not self.is_op(j + 1, ","):
                break
            j += 2
        if not self.is_op(j + 1, "=") or self.tokens[j][0] != "name":
            return max(i + 1, j)
        j += 2
        for name in names:
            j = self.value(j, name, "=", False)
            if not self.is_op(j, ","):
                break
            j += 1
        return j


def named_spans(text: str, threshold: float = 0.5) -> list[tuple[int, int, int]]:
    """Literals that reach a sensitive name, by itself or through other names."""
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for given in reversed(Lexer(text).read()):
        if given.score:
            for source in given.came_from:
                source.score = max(source.score, given.score)
            for a, b, value in given.literals:
                if given.score > best.get((a, b), (0.0, ""))[0]:
                    best[a, b] = given.score, value
    return sorted((a, 3, b) for (a, b), (s, value) in best.items() if s * literal_score(value) >= threshold)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


EMPTY = hashlib.sha256(b"").hexdigest()
COLUMNS = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "n_named": pa.int64()}


def _scan(batches):
    for batch in slices(batches, "text"):
        texts = batch.column("text")
        rows = {c: [0 if t == pa.int64() else "" for _ in range(len(texts))] for c, t in COLUMNS.items()}
        rows["base_sha256"] = [EMPTY] * len(texts)
        for k in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, SCREEN), False)).to_pylist():
            text = texts[k].as_py()
            base, named = base_spans(text), named_spans(text)
            for c, kind in (("n_assign", 0), ("n_access", 1), ("n_hex", 2)):
                rows[c][k] = sum(x[1] == kind for x in base)
            rows["n_named"][k] = len(named)
            rows["base_sha256"][k] = hashlib.sha256(joined(base).encode()).hexdigest()
            rows["spans"][k] = joined(sorted(base + named))
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(rows[c], t) for c, t in COLUMNS.items()]], ["id", *COLUMNS])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_named: one row for each row of ``docs``.

    Null and empty texts have no spans.  Other columns of ``docs`` are not
    read; repeated rows and null ids give rows of their own, and an empty
    table none.  Whole texts are read, in time that grows with their length.
    No row meets another: nothing is shuffled, and a task holds one slice of
    texts.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return named.mapInArrow(tidy(_scan), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long").withColumnRenamed("id", id_col)
