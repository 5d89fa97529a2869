"""Users' patterns are RE2's; Spark's are Java's. `re2_to_java` says the same in Java's dialect and refuses what RE2 doesn't have.

Dialects differ where both accept a text: `$` (RE2: the very end), `^` and `$` over lines, `.`, `\\s`, `\\v`, `\\b` (RE2: ASCII), POSIX classes,
`&&` and `[` within classes, possessive quantifiers (RE2: an error), script names, octal escapes, ungreedy flags and group names. Each is written
out so that it means in Java what it means in RE2; flags of Java are used for letter case only.
"""
from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

# Names of POSIX classes, and Java's for them.
POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower",
         "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}
# Fixed value: how often a part may be repeated by number.
MOST_REPEATS = 1000
_WORD = "[0-9A-Za-z_]"
_CONTROLS = {"a": 7, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}


class _Translator:
    def __init__(self, pattern: str):
        self.p, self.i, self.names = pattern, 0, set()

    def bad(self, why: str) -> ValueError:
        return ValueError(f"invalid pattern {self.p!r}: {why}")

    def at(self, text: str) -> bool:
        return self.p.startswith(text, self.i)

    def run(self) -> str:
        out = self.alternatives("")
        if self.i < len(self.p):
            raise self.bad("unexpected )")
        return out

    def alternatives(self, flags: str) -> str:
        """Up to the group's end. A flag set within holds to that end, for later alternatives too, in both dialects."""
        out, last = [], None  # last: where the part that a quantifier would repeat is
        while self.i < len(self.p):
            c = self.p[self.i]
            if c == ")":
                break
            if c == "|":
                self.i += 1
                out.append("|")
                last = None
            elif c in "*+?" or (c == "{" and self.counts()):
                if last is None:
                    raise self.bad("nothing to repeat")
                out.append(self.quantifier(flags))
                last = None
            elif self.at("(?") and (inline := self.flag_group(flags)) is not None:
                flags, group = inline
                if group:
                    last = len(out)
                    before = self.outer
                    out.append(f"(?:{self.case(flags) if ('i' in flags) != ('i' in before) else ''}{self.alternatives(flags)})")
                    self.close()
                    flags = before
                else:
                    out.append(self.case(flags) if ("i" in flags) != ("i" in self.outer) else "")
                    last = None
            else:
                last = len(out)
                out.append(self.atom(flags))
        return "".join(out)

    @staticmethod
    def case(flags: str) -> str:
        return "(?iu)" if "i" in flags else "(?-iu)"

    def close(self) -> None:
        if not self.at(")"):
            raise self.bad("missing )")
        self.i += 1

    def flag_group(self, flags: str) -> tuple[str, bool] | None:
        """Flags after `(?`, and whether a group follows; None at a named group. self.outer: the flags after that group."""
        if self.at("(?P<") or self.at("(?<"):
            if self.at("(?<=") or self.at("(?<!"):
                raise self.bad("look-arounds are not supported")
            return None
        now, on, seen, j = set(flags), True, 0, self.i + 2
        while j < len(self.p):
            c = self.p[j]
            j += 1
            if c in ":)":
                if not on and not seen:
                    break
                self.i, self.outer = j, flags
                return "".join(sorted(now)), c == ":"
            if c == "-" and on:
                on, seen = False, 0
            elif c in "imsU":
                seen += 1
                (now.add if on else now.discard)(c)
            else:
                break
        raise self.bad("unknown group or flag")

    def counts(self) -> tuple[int, int | None, int] | None:
        """least, most and end of `{n}`, `{n,}` or `{n,m}` here."""
        end = self.p.find("}", self.i)
        parts = self.p[self.i + 1 : end].split(",") if end > 0 else []
        digits = lambda s: s.isascii() and s.isdigit()
        if not 1 <= len(parts) <= 2 or not digits(parts[0]) or (len(parts) == 2 and parts[1] and not digits(parts[1])):
            return None
        return int(parts[0]), (int(parts[-1]) if parts[-1] else None), end + 1

    def quantifier(self, flags: str) -> str:
        c = self.p[self.i]
        if c == "{":
            least, most, end = self.counts()
            if max(least, most or 0) > MOST_REPEATS or (most is not None and most < least):
                raise self.bad("invalid repeat count")
            out = self.p[self.i : end]
            self.i = end
        else:
            out = c
            self.i += 1
        lazy = self.at("?")
        self.i += lazy
        if self.i < len(self.p) and (self.p[self.i] in "*+?" or (self.p[self.i] == "{" and self.counts())):
            raise self.bad("invalid nested repetition")
        return out + ("?" if lazy != ("U" in flags) else "")

    def atom(self, flags: str) -> str:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            if self.at("?"):
                self.name()
            out = f"({self.alternatives(flags)})"
            self.close()
            return out
        if c == "[":
            return self.bracket()
        if c == "\\":
            return self.escape()
        self.i += 1
        if c == ".":
            return r"[\s\S]" if "s" in flags else r"[^\n]"
        if c == "^":
            return r"(?<![^\n])" if "m" in flags else "^"
        if c == "$":
            return r"(?![^\n])" if "m" in flags else r"\z"
        return self.literal(c)

    def name(self) -> None:
        start = self.p.index("<", self.i) + 1
        end = self.p.find(">", start)
        name = self.p[start:end] if end > 0 else ""
        if not name or not name.isascii() or not name.replace("_", "a").isalnum() or name in self.names:
            raise self.bad("invalid or repeated group name")
        self.names.add(name)
        self.i = end + 1

    @staticmethod
    def literal(c: str) -> str:
        return c if c.isalnum() or ord(c) > 127 else f"\\x{{{ord(c):x}}}"

    def escape(self) -> str:
        if self.at(r"\Q"):
            end = self.p.find(r"\E", self.i)
            text = self.p[self.i + 2 : end if end >= 0 else len(self.p)]
            self.i = end + 2 if end >= 0 else len(self.p)
            return "".join(map(self.literal, text))
        if self.i + 1 >= len(self.p):
            raise self.bad(r"trailing \ ")
        c = self.p[self.i + 1]
        if c in "bBAz":
            self.i += 2
            edge = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
            return {"b": edge, "B": f"(?!{edge})", "A": r"\A", "z": r"\z"}[c]
        kind = self.kind()
        return f"[{kind}]" if kind is not None else self.literal(self.character())

    def kind(self) -> str | None:
        """What stands for an escaped class within brackets; None if this is a single character."""
        c = self.p[self.i + 1]
        if c in "dDwWsS":
            self.i += 2
            return {"s": r"\t\n\f\r ", "S": r"\S\x0b"}.get(c, f"\\{c}")
        if c not in "pP":
            return None
        negated, j = c == "P", self.i + 2
        if self.p[j : j + 1] == "{":
            end = self.p.find("}", j)
            name, j = (self.p[j + 1 : end], end + 1) if end > 0 else ("", j)
            if name.startswith("^"):
                name, negated = name[1:], not negated
        else:
            name, j = self.p[j : j + 1], j + 1
        if not name or not name.isascii() or not name.replace("_", "a").isalpha():
            raise self.bad("invalid character class")
        self.i = j
        if name == "Any":
            if negated:
                raise self.bad("a class of no characters")
            return r"\s\S"
        return f"\\{'P' if negated else 'p'}{{{name if len(name) <= 2 else 'Is' + name}}}"

    def character(self) -> str:
        """An escaped character."""
        c = self.p[self.i + 1]
        self.i += 2
        if c in _CONTROLS:
            return chr(_CONTROLS[c])
        if c in "01234567":
            digits = c
            while len(digits) < 3 and self.p[self.i : self.i + 1] in tuple("01234567"):
                digits += self.p[self.i]
                self.i += 1
            if c != "0" and len(digits) == 1:
                raise self.bad("back references are not supported")
            return chr(int(digits, 8))
        if c == "x":
            end = self.p.find("}", self.i) if self.at("{") else self.i + 2
            digits = self.p[self.i + self.at("{") : end] if end > 0 else ""
            try:
                code = int(digits, 16) if digits.isalnum() and (self.at("{") or len(digits) == 2) else -1
            except ValueError:
                code = -1
            if not 0 <= code <= 0x10FFFF:
                raise self.bad("invalid escape")
            self.i = end + self.at("{")
            return chr(code)
        if ord(c) < 128 and not c.isalnum():
            return c
        raise self.bad(f"unknown escape \\{c}")

    def bracket(self) -> str:
        self.i += 1
        negated = self.at("^")
        self.i += negated
        out, first = [], True
        while first or not self.at("]"):
            if self.i >= len(self.p):
                raise self.bad("missing ]")
            first = False
            if self.at("[:") and (end := self.p.find(":]", self.i + 2)) > 0:
                name = self.p[self.i + 2 : end]
                but = name.startswith("^")
                name = name.removeprefix("^")
                if name not in POSIX and name != "word":
                    raise self.bad("invalid character class")
                out.append(("\\W" if but else "\\w") if name == "word" else f"\\{'P' if but else 'p'}{{{POSIX[name]}}}")
                self.i = end + 2
                continue
            if self.at("\\") and self.i + 1 < len(self.p) and (kind := self.kind()) is not None:
                out.append(kind)
                continue
            lo = self.one()
            if self.at("-") and self.p[self.i + 1 : self.i + 2] not in ("]", ""):
                self.i += 1
                if self.at("\\") and self.i + 1 < len(self.p) and self.p[self.i + 1] in "dDwWsSpP":
                    raise self.bad("invalid range")
                hi = self.one()
                if hi < lo:
                    raise self.bad("invalid range")
                out.append(f"{self.literal(lo)}-{self.literal(hi)}")
            else:
                out.append(self.literal(lo))
        self.i += 1
        return f"[{'^' if negated else ''}{''.join(out)}]"

    def one(self) -> str:
        if self.at("\\"):
            if self.i + 1 >= len(self.p):
                raise self.bad("missing ]")
            return self.character()
        c = self.p[self.i]
        self.i += 1
        return c


def re2_to_java(pattern: str) -> str:
    """A user's RE2 pattern in Java's dialect; a ValueError if it is none. Names of classes are checked by the session's JVM, if there is one."""
    out, context = _Translator(pattern).run(), SparkContext._active_spark_context
    if context is not None and context._jvm is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(out)
        except (Py4JJavaError, IllegalArgumentException) as e:
            raise ValueError(f"invalid pattern {pattern!r}: {e}") from None
    return out


def ignoring_case(pattern: str) -> str:
    """The same, letters of either case alike."""
    return re2_to_java(f"(?i){pattern}")
