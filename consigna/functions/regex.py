"""Patterns of the rule language as Spark (Java) patterns.

Rules carry ECMAScript patterns. They differ from Java in white space, line ends, the dot, word
boundaries and brackets inside character classes, so each pattern is rewritten once on the driver
and then used as a literal in native expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from consigna.functions.text import WS

_WS_CLASS = "".join(f"\\x{{{ord(c):X}}}" for c in WS)
_DOT = r"[^\n\r\x{2028}\x{2029}]"
_ANY = r"[\x{0}-\x{10FFFF}]"
_NONE = r"[^\x{0}-\x{10FFFF}]"
_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_INSIDE = r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"
_SAME = set("dDwWfnrtv0123456789cxuk")


@dataclass(frozen=True)
class Regex:
    java: str
    groups: int
    optional: frozenset[int]
    matches_empty: bool


class _Rewriter:
    """One left-to-right pass that also counts groups and notes those that may take no part."""

    def __init__(self, src: str):
        self.src, self.i, self.out = src, 0, []
        self.groups, self.optional = 0, set()
        self.open: list[dict] = [{"group": None, "inner": [], "alt": False}]

    def run(self) -> None:
        src = self.src
        while self.i < len(src):
            ch = src[self.i]
            if ch == "\\":
                self.out.append(self._escape())
            elif ch == "[":
                self.out.append(self._char_class())
            elif ch == "(":
                self._open_group()
            elif ch == ")":
                self._close_group()
            elif ch == "{" and not re.match(r"\{\d+(,\d*)?\}", src[self.i:]):
                self.out.append(r"\{")
                self.i += 1
            elif ch == "{":
                end = src.index("}", self.i) + 1
                self.out.append(src[self.i:end])
                self.i = end
                self._lazy_only()
            elif ch in "*+?":
                self.out.append(ch)
                self.i += 1
                self._lazy_only()
            else:
                if ch == "|":
                    self.open[-1]["alt"] = True
                self.out.append({".": _DOT, "$": r"\z", "}": r"\}", "]": r"\]"}.get(ch, ch))
                self.i += 1
        if len(self.open) != 1:
            raise ValueError("unterminated group")
        self._settle(self.open[0], False)

    def _lazy_only(self) -> None:
        if self.src[self.i:self.i + 1] == "?":
            self.out.append("?")
            self.i += 1
        if self.src[self.i:self.i + 1] in ("*", "+", "?"):
            raise ValueError("nothing to repeat")

    def _escape(self) -> str:
        if self.i + 1 >= len(self.src):
            raise ValueError("trailing backslash")
        ch = self.src[self.i + 1]
        self.i += 2
        special = {"s": f"[{_WS_CLASS}]", "S": f"[^{_WS_CLASS}]", "b": _BOUNDARY, "B": _INSIDE, "v": r"\x0B",
                   "0": r"\x00"}
        if ch in special:
            return special[ch]
        if ch in _SAME or not ch.isalpha():
            return "\\" + ch
        return ch

    def _open_group(self) -> None:
        head = re.match(r"\((\?(:|=|!|<=|<!|<[A-Za-z_$][\w$]*>))?", self.src[self.i:])
        if head.group(0) == "(" and self.src[self.i + 1:self.i + 2] == "?":
            raise ValueError("invalid group")
        name = head.group(2)
        capturing = name is None or (name.startswith("<") and name not in ("<=", "<!"))
        if capturing:
            self.groups += 1
        self.open.append({"group": self.groups if capturing else None, "inner": [], "alt": False})
        self.out.append("(" if capturing else head.group(0))
        self.i += len(head.group(0))

    def _close_group(self) -> None:
        if len(self.open) == 1:
            raise ValueError("unmatched parenthesis")
        self.out.append(")")
        self.i += 1
        frame = self.open.pop()
        maybe = re.match(r"[?*]|\{0[,}]", self.src[self.i:]) is not None
        self._settle(frame, maybe)
        if frame["group"] is not None:
            frame["inner"].append(frame["group"])
            if maybe:
                self.optional.add(frame["group"])
        self.open[-1]["inner"] += frame["inner"]

    def _settle(self, frame: dict, maybe: bool) -> None:
        if frame["alt"] or maybe:
            self.optional.update(frame["inner"])

    def _char_class(self) -> str:
        i = self.i + 1
        negated = self.src[i:i + 1] == "^"
        i += negated
        body, spaces, non_spaces = [], False, False
        while True:
            if i >= len(self.src):
                raise ValueError("unterminated character class")
            ch = self.src[i]
            if ch == "]":
                break
            if ch == "\\":
                nxt = self.src[i + 1:i + 2]
                if nxt == "s":
                    spaces = True
                elif nxt == "S":
                    non_spaces = True
                elif nxt == "b":
                    body.append(r"\x08")
                elif nxt == "v":
                    body.append(r"\x0B")
                elif nxt in _SAME or not nxt.isalpha():
                    body.append("\\" + nxt)
                else:
                    body.append(nxt)
                i += 2
                continue
            body.append("\\" + ch if ch in "[&^" else ch)
            i += 1
        self.i = i + 1
        inner = "".join(body) + (_WS_CLASS if spaces else "")
        if not non_spaces:
            if not inner:
                return _ANY if negated else _NONE
            return f"[{'^' if negated else ''}{inner}]"
        # A class with \S covers everything but the white space it does not name itself.
        named = re.compile(f"[{''.join(body)}]", re.ASCII) if body else None
        left = "" if spaces else "".join(
            f"\\x{{{ord(c):X}}}" for c in WS if named is None or not named.match(c)
        )
        if negated:
            return f"[{left}]" if left else _NONE
        return f"[^{left}]" if left else _ANY


@lru_cache(maxsize=4096)
def translate(pattern: str) -> Regex | None:
    """Java form of a pattern, or None when the pattern is not valid."""
    rw = _Rewriter(pattern)
    try:
        rw.run()
        java = "".join(rw.out)
        compiled = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(java)
        empty = compiled.matcher("").find()
    except Exception:
        return None
    return Regex(java, rw.groups, frozenset(rw.optional), empty)


def found(text: Column, rx: Regex | None) -> Column:
    return F.lit(False) if rx is None else F.coalesce(text.rlike(rx.java), F.lit(False))


def extract(text: Column, rx: Regex | None, group: int = 1) -> Column:
    """Group of the first match, '' when nothing matches.

    A group the pattern does not have stands for the whole match, and so does an optional group
    that took no part. Spark shows such a group as '', so an optional group that did match the
    empty string also gives the whole match.
    """
    if rx is None:
        return F.lit("")
    if group < 1 or group > rx.groups:
        return F.regexp_extract(text, rx.java, 0)
    got = F.regexp_extract(text, rx.java, group)
    if group in rx.optional:
        return F.when(got == "", F.regexp_extract(text, rx.java, 0)).otherwise(got)
    return got


def group_text(text: Column, rx: Regex, group: int) -> Column:
    """Group of the first match, '' when the group is missing or took no part."""
    return F.regexp_extract(text, rx.java, group) if group <= rx.groups else F.lit("")


def split(text: Column, rx: Regex) -> Column:
    """Pieces around all matches, empty ones kept; captured groups come between the pieces."""
    pieces = F.split(text, rx.java, -1)
    if rx.groups == 0:
        return pieces
    caught = [F.regexp_extract_all(text, F.lit(rx.java), F.lit(g)) for g in range(1, rx.groups + 1)]
    mixed = F.flatten(F.transform(
        F.arrays_zip(pieces, *caught), lambda z: F.array(*[z[str(i)] for i in range(rx.groups + 1)])))
    return F.slice(mixed, F.lit(1), F.size(mixed) - rx.groups)
