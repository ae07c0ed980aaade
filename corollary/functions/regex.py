"""The pattern dialect, translated to Java's.

Literals, . (any character, line feeds too), [...] with ranges and a leading ^ (a ] first is literal),
one of * + ? after an atom, |, ( ), the escapes \\\\ \\n \\r \\t \\0 \\0NN \\xHH; any other escaped
character is itself (\\d is the letter d). No anchors, counts or classes. A match is of the whole string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "0123456789abcdefABCDEF"


class PatternError(ValueError):
    pass


def _quoted(c: str) -> str:
    return f"\\x{{{ord(c):x}}}"


class _Translator:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def more(self) -> bool:
        return self.at < len(self.text)

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def escape(self) -> str:
        if not self.more():
            raise PatternError("the pattern ends in a backslash")
        c = self.take()
        if c in "nrt":
            return {"n": "\n", "r": "\r", "t": "\t"}[c]
        if c == "0":
            digits = ""
            while self.more() and len(digits) < 2 and self.text[self.at] in "01234567":
                digits += self.take()
            return chr(int(digits or "0", 8))
        if c == "x":
            digits = self.text[self.at : self.at + 2]
            if len(digits) < 2 or any(d not in _HEX for d in digits):
                raise PatternError("\\x needs two hexadecimal digits")
            self.at += 2
            return chr(int(digits, 16))
        return c

    def alternatives(self) -> str:
        parts = [self.sequence()]
        while self.more() and self.text[self.at] == "|":
            self.at += 1
            parts.append(self.sequence())
        return "|".join(parts)

    def sequence(self) -> str:
        out = ""
        while self.more() and self.text[self.at] not in "|)":
            atom = self.atom()
            if self.more() and self.text[self.at] in "*+?":
                atom += self.take()
            out += atom
        return out

    def atom(self) -> str:
        c = self.take()
        if c == "(":
            inner = self.alternatives()
            if not self.more() or self.take() != ")":
                raise PatternError("a ( isn't closed")
            return f"(?:{inner})"
        if c == "[":
            return self.bracket()
        if c == ".":
            return "."
        if c == "\\":
            return _quoted(self.escape())
        if c in "*+?":
            raise PatternError(f"{c} has nothing before it")
        return _quoted(c)

    def bracket(self) -> str:
        negated = self.more() and self.text[self.at] == "^"
        self.at += negated
        items: list[str] = []
        first = True
        while True:
            if not self.more():
                raise PatternError("a [ isn't closed")
            c = self.take()
            if c == "]" and not first:
                break
            first = False
            low = self.escape() if c == "\\" else c
            if self.at + 1 < len(self.text) and self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                c = self.take()
                high = self.escape() if c == "\\" else c
                if high < low:
                    raise PatternError("a range is upside down")
                items.append(f"{_quoted(low)}-{_quoted(high)}")
            else:
                items.append(_quoted(low))
        return "[" + "^" * negated + "".join(items) + "]"


def to_java(pattern: str) -> str:
    if not pattern:
        raise PatternError("an empty pattern")
    # Bytes, not characters, are matched: both sides are read as Latin-1.
    t = _Translator(pattern.encode().decode("latin-1"))
    body = t.alternatives()
    if t.more():
        raise PatternError("a ) has no (")
    return rf"(?s)\A(?:{body})\z"


def matches(column: Column, pattern: str) -> Column:
    """Whether the whole string matches, byte by byte."""
    java = to_java(pattern)
    if pattern.isascii() and not any(x in pattern for x in (".", "[", "\\")):
        return column.rlike(java)  # only ASCII letters can match: bytes and characters are the same
    return F.decode(F.encode(column, "UTF-8"), "ISO-8859-1").rlike(java)
