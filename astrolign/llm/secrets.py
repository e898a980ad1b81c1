"""Secret scans by assignment-aware lexing.

A lexer reads source and configuration syntax into pairs of a name and a value, in one pass:

- `name = "x"`, `name := x`, `"name": "x"`, `'name' => 'x'`, `name: str = "x"`, `name += "x"`, `settings["name"] = "x"`, `f(name="x")`, `export NAME=x`, `--name=x`, `?name=x&`, `<name>x</name>`,
- quoted, prefixed (`f"x"`, `b'x'`) and triple-quoted strings, bare values, YAML block scalars (`name: |`), here-documents (`name = <<END`), a string that a call wraps (`decode("x")`),
- strings that stand side by side or are joined by `+` or `.`, and constants joined to them, formatted into them (`f"{A}"`, `"${A}"`, `"%s" % A`, `"{}".format(A)`),
- pairs inside a string (`"Server=s;Password=x"`), and in comments, which set no constants.

Constants are carried on to names that are assigned from them; braces and indentation bound their scopes. A value scores by how sensitive the words of its target's name are and by its own form.
Every part of the text is lexed a bounded number of times, so time grows with its length, whatever it holds.

Beside these spans (kind literal) stand three fixed kinds (assign, access, hex). Spans count code points, the end is exclusive. Null texts count as empty: no spans; a null doc_id stays null.
Repeated rows give repeated rows; only the id and the text are read, so other columns can have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolign.llm.common import id_and_text

# Fixed values of the base kinds.
ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run: as [0-9a-f]+ with shorter ones dropped
KINDS = ("assign", "access", "hex", "literal")

#: How telling a word of a name is.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3, "private": 2, "auth": 2, "access": 1, "api": 1, "key": 2, "signing": 1, "encryption": 1, "bearer": 2, "pass": 2}
_TELLING = re.compile("|".join(SENSITIVE), re.IGNORECASE)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# What the lexer stops at. Comments begin after white space or at the start, so that #, // and -- within words and addresses stay.
_EVENT = re.compile(r"""\n[ \t]*|[{}]|/\*|(?:(?<=\s)|\A)(?:\#|//|--[ ])|:=|=>|=(?![=>~])|:(?![:/=])|<[A-Za-z_][\w.-]*>""")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")
_BLANK = re.compile(r"[ \t]*")
_STRING = re.compile(r'''(?:[fFrRbBuU]{1,2}(?=["']))?(?:"(?P<d>(?:[^"\\\n]|\\.)*+)"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>[^`\n]*+)`)''')
_TRIPLE = re.compile(r'''[fFrRbBuU]{0,2}("""|\'\'\')''')
_RUN = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_STOPPED = re.compile(r"""[^\s"'`,;(){}\[\]<>=&?]+(?:={1,2}(?![^\s"'`,;(){}\[\]<>&]))?""")
_REFERENCE = re.compile(r"""\$\{(\w+)\}|(?:self\.|this\.)?\$?([A-Za-z_]\w*)""")
_BRACED = re.compile(r"\$\{\w+\}")
_JOIN = re.compile(r"""[ \t]*(?:[+.](?=[ \t]*["'`\w$]))?[ \t]*""")
_TYPE = re.compile(r"""[ \t]*+[A-Za-z_][\w.]*+(?:[ \t]*[\[<|&*?][^\n=:"'(){}]*+)?[ \t]*+=(?![=>~])""")
_HEREDOC = re.compile(r"""<<[<~-]?[ \t]*["']?([A-Za-z_]\w*)["']?""")
_FIRST_WORD = re.compile(r"^[ \t]*+([A-Za-z_]\w*)", re.MULTILINE)
_SCALAR = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*(?:#[^\n]*)?\n")
_CALL = re.compile(r"""([A-Za-z_$][\w.$]*)\([ \t]*(?=["'`])""")
_READS = re.compile(r"env|get|read|load|input|prompt|fetch|vault|find|open", re.IGNORECASE)
_HOLES = re.compile(r"\{(\w+)\}")
_FORMAT = re.compile(r"[ \t]*(?:\.format\(|%[ \t]*\(?)[ \t]*([A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)")
_ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(.))", re.DOTALL)


def name_score(name: str) -> int:
    return sum(SENSITIVE.get(p.lower(), 0) for p in _PART.findall(name))


class Value:
    """What is assigned: the text of a literal, or several values side by side. Counts of characters are made when they are asked for, and once."""

    __slots__ = ("text", "start", "end", "parts", "found", "_counts")

    def __init__(self, text: str = "", start: int = 0, end: int = 0, parts: tuple[Value, ...] = ()):
        self.text, self.start, self.end, self.parts, self.found, self._counts = text, start, end, parts, False, None

    def counts(self) -> Counter:
        """Of characters by class: ASCII ones each, others by their low seven bits, so that there are at most 256 whatever is joined."""
        todo = [self]
        while todo:
            value = todo[-1]
            if value._counts is None and (missing := [p for p in value.parts if p._counts is None]):
                todo += missing
                continue
            todo.pop()
            if value._counts is None:
                value._counts = own = Counter(value.text if value.text.isascii() else [c if c.isascii() else 128 + ord(c) % 128 for c in value.text])
                for p in value.parts:
                    own.update(p._counts)
        return self._counts

    def literals(self) -> Iterator[Value]:
        """Those that no earlier call has given."""
        todo = [self]
        while todo:
            value = todo.pop()
            if not value.found:
                value.found = True
                todo += value.parts
                if value.end > value.start:
                    yield value


def form_score(counts: Counter) -> float:
    """0 to 3: no blanks, eight characters or more, mixed kinds of characters, varied characters."""
    n = sum(counts.values())
    if n < 8 or any(isinstance(c, str) and c.isspace() for c in counts):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in counts.values())
    kinds = sum(any(isinstance(c, str) and test(c) for c in counts) for test in (str.isdigit, str.islower, str.isupper))
    return (bits >= 3.0) + (kinds >= 2) + (n >= 16 and bits >= 3.5)


def literal_score(value: str) -> float:
    return form_score(Value(value).counts())


class Lexer:
    """Pairs (name, Value) of a text."""

    def __init__(self, text: str, first: int = 0, last: int | None = None):
        self.text, self.first, self.last = text, first, len(text) if last is None else last
        self.constants: dict[str, list[tuple[int, Value]]] = {}
        self.scopes: list[tuple[int, list[str]]] = []  # indent, or -1 for a brace; names that were set in the scope
        self.no_more: set[str] = set()  # closing marks that don't come any more
        self.nested: list[tuple[int, int]] = []
        self.line_end = -1
        self.marks: dict[str, list[int]] | None = None  # where lines begin with a word

    # --- scopes

    def enter(self, indent: int) -> None:
        self.scopes.append((indent, []))

    def leave(self) -> None:
        for name in self.scopes.pop()[1]:
            self.constants[name].pop()

    def bind(self, name: str, value: Value) -> None:
        depth, held = len(self.scopes), self.constants.setdefault(name, [])
        if held and held[-1][0] == depth:
            held[-1] = depth, value
        else:
            held.append((depth, value))
            if self.scopes:
                self.scopes[-1][1].append(name)

    def look_up(self, name: str) -> Value | None:
        held = self.constants.get(name)
        return held[-1][1] if held else None

    # --- values: each returns (Value, end) or None

    def string(self, at: int) -> tuple[Value, int] | None:
        text = self.text
        if (m := _TRIPLE.match(text, at, self.last)) and m[1] not in self.no_more:
            end = text.find(m[1], m.end(), self.last)
            if end >= 0:
                return self.content(at, m.end(), end), end + 3
            self.no_more.add(m[1])
        if m := _STRING.match(text, at, self.last):
            kind = m.lastgroup
            return self.content(at, m.start(kind), m.end(kind)), m.end()
        return None

    def content(self, at: int, first: int, last: int) -> Value:
        raw = self.text[first:last]
        if "=" in raw or ":" in raw:
            self.nested.append((first, last))
        parts = ()
        if "{" in raw:
            parts = tuple(v for m in _HOLES.finditer(raw) if (v := self.look_up(m[1])))
        if "\\" in raw and self.text[at] not in "rR":
            raw = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " " if m[3] in "nrt" else m[3], raw)
        return Value(raw, first, last, parts)

    def block(self, at: int) -> tuple[Value, int]:
        """The lines from `at` on that are indented more than the line before."""
        text, begin = self.text, self.text.rfind("\n", self.first, at - 1) + 1
        base = _BLANK.match(text, begin).end() - begin
        k = first = last = at
        while k < self.last:
            end = text.find("\n", k, self.last)
            end = self.last if end < 0 else end
            body = _BLANK.match(text, k, end).end()
            if body < end:
                if body - k <= base:
                    break
                first, last = (body if last == at else first), end
            k = end + 1
        return Value(text[first:last], first, last), last

    def here_document(self, at: int, mark: str) -> tuple[Value, int] | None:
        """The lines behind the one of `at`, up to the first that begins with the mark."""
        if self.line_end < at:
            self.line_end = self.text.find("\n", at, self.last)
            self.line_end = self.last if self.line_end < 0 else self.line_end
        if self.marks is None:
            self.marks = {}
            for m in _FIRST_WORD.finditer(self.text, self.first, self.last):
                self.marks.setdefault(m[1], []).append(m.start(1))
        begin, places = self.line_end + 1, self.marks.get(mark, [])
        k = bisect_left(places, begin)
        if k == len(places):
            return None
        end = max(begin, self.text.rfind("\n", begin, places[k]))
        return Value(self.text[begin:end], begin, end), places[k] + len(mark)

    def joined(self, found: tuple[Value, int]) -> tuple[Value, int]:
        """With the strings and constants that stand side by side with a string or are joined to it."""
        own, known, end = [found[0]], [], found[1]
        while m := _JOIN.match(self.text, end, self.last):
            sign = m[0].strip()
            more = self.string(m.end())
            if more:
                own.append(more[0])
                end = more[1]
                continue
            name = _REFERENCE.match(self.text, m.end(), self.last) if sign else None
            value = name and self.look_up(name[1] or name[2])
            if not value:
                break
            known.append(value)
            end = name.end()
        if m := _FORMAT.match(self.text, end, self.last):
            known += [v for name in m[1].split(",") if (v := self.look_up(name.strip()))]
        if len(own) == 1 and not known:
            return own[0], end
        text = "".join(v.text for v in own)
        return Value(text, own[0].start, own[-1].end, (*(p for v in own for p in v.parts), *known)), end

    def value(self, at: int, op: str, sensitive: bool) -> tuple[Value, int] | None:
        text = self.text
        sign = text[at : at + 1]
        word = sign.isalpha() or sign in "_$"
        if op == ":" and sign in "|>" and (m := _SCALAR.match(text, at, self.last)):
            return self.block(m.end())
        if sign == "<" and (m := _HEREDOC.match(text, at, self.last)):
            return self.here_document(m.end(), m[1])
        if (word or sign in "\"'`") and (found := self.string(at)):
            return self.joined(found)
        if word and (m := _CALL.match(text, at, self.last)):
            if _READS.search(m[1]):
                return None
            found = self.string(m.end())
            return found if found and text[found[1] : found[1] + 1] == ")" else None
        m = sign == "$" and _BRACED.match(text, at, self.last) or (_RUN if sensitive else _STOPPED).match(text, at, self.last)
        if not m or text[m.end() : m.end() + 1] == "(" and m.end() < self.last:
            return None
        if word and (name := _REFERENCE.fullmatch(text, at, m.end())) and (known := self.look_up(name[1] or name[2])):
            join = _JOIN.match(text, m.end(), self.last)
            if join[0].strip() and (more := self.string(join.end())):
                more = self.joined(more)
                return Value(parts=(known, more[0])), more[1]
            return Value(parts=(known,)), m.end()
        run = m[0]
        return Value(run, at, m.end()), m.end()

    # --- pairs

    def name(self, end: int, floor: int) -> tuple[str, bool]:
        """The name before `end`, and whether what is assigned is added to it."""
        text = self.text
        added = end > floor and text[end - 1] in "+?.|"
        end -= added
        while end > floor and text[end - 1] in " \t":
            end -= 1
        if end > floor and text[end - 1] == "]":
            end -= 1
        if end > floor and text[end - 1] in "\"'`":
            end -= 1
        start = end
        while start > floor and text[start - 1] in _NAME_CHARS:
            start -= 1
        return text[start:end].lstrip("0123456789.-"), added

    def pairs(self) -> Iterator[tuple[str, Value]]:
        text, at, floor, comment, block = self.text, self.first, self.first, False, self.first  # block: where the last block comment ends
        while m := _EVENT.search(text, at, self.last):
            at, sign = m.end(), m[0]
            if sign[0] == "\n":
                comment, floor = False, at
                indent = len(sign) - 1
                if at < self.last and text[at] not in "\n\r":
                    while self.scopes and self.scopes[-1][0] > indent:
                        self.leave()
                    if indent and (not self.scopes or 0 <= self.scopes[-1][0] < indent or self.scopes[-1][0] < 0):
                        self.enter(indent)
            elif sign == "{":
                self.enter(-1)
            elif sign == "}":
                while self.scopes and self.scopes[-1][0] >= 0:
                    self.leave()
                if self.scopes:
                    self.leave()
            elif sign == "/*":
                if at > block and "*/" not in self.no_more:
                    block = text.find("*/", at, self.last)
                    if block < 0:
                        self.no_more.add("*/")
            elif sign[0] in "#/-":
                comment = True
            elif sign[0] == "<":
                end = text.find("<", at, self.last)
                if end >= 0 and text.startswith(f"</{sign[1:]}", end):
                    body = text[at:end]
                    first = at + len(body) - len(body.lstrip())
                    yield sign[1:-1], Value(body.strip(), first, first + len(body.strip()))
                    at = end
            else:
                name, added = self.name(m.start(), floor)
                floor = at
                if not name:
                    continue
                if sign == ":" and (kind := _TYPE.match(text, at, self.last)):
                    at = floor = kind.end()
                first = at
                while first < self.last and text[first] in " \t":
                    first += 1
                if first == self.last:
                    break
                found = self.value(first, sign, len(name) > 2 and name_score(name) >= 2)
                if not found:
                    continue
                own, at = found
                floor = at
                if added and (before := self.look_up(name)):
                    own = Value(parts=(before, own))
                if not comment and at > block:
                    self.bind(name.removeprefix("self.").removeprefix("this."), own)
                yield name, own


def literals(text: str, least: float = 5) -> list[tuple[int, int]]:
    """Spans of literals whose name and form together score `least` or more. A constant counts for each name that it is carried on to."""
    if ("=" not in text and ":" not in text and "</" not in text) or not _TELLING.search(text):
        return []
    found: set[tuple[int, int]] = set()
    outer = Lexer(text)

    def scored(lexer: Lexer) -> None:
        for name, value in lexer.pairs():
            if not value.found and (own := name_score(name)) >= 2 and (form := form_score(value.counts())) and own + form >= least:
                found.update((v.start, v.end) for v in value.literals())

    scored(outer)
    for first, last in outer.nested:  # pairs inside strings, not in strings inside those
        scored(Lexer(text, first, last))
    return sorted(found)


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start, then kind in the order of KINDS."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out += [(s, 3, e) for s, e in literals(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (array of struct kind, start, end) of each row."""
    out = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in spans(x or "")] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, out.field(1).type)], schema=out)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with overlapping and touching secret spans replaced by `mark`; a null text stays null; all other columns and rows stay."""

    @F.pandas_udf("string")
    def replaced(texts):
        return texts.map(lambda x: None if x is None else redacted(x, mark))

    return docs.withColumn(text_col, replaced(F.col(text_col)))


def redacted(text: str, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, _, end in spans(text):
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
