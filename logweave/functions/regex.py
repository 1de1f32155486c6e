"""Pattern helpers: globs, LIKE escaping and RE2-to-Java translation.

Patterns are written in RE2 syntax; Spark evaluates them with ``java.util.regex``. The two
dialects differ in a handful of places that :func:`to_java` evens out. Extraction is
positional, so group names are dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F

MAX_USER_PATTERN = 2000

# An unbounded repeat applied to a group that itself ends in an unbounded repeat.
_NESTED_QUANTIFIER = re.compile(r"[*+}]\)[*+{]")
_GROUP_NAME = re.compile(r"\?P?<([A-Za-z_][A-Za-z0-9_]*)>")
_FLAGS = re.compile(r"\?([a-zA-Z]*)(?:-[a-zA-Z]+)?[:)]")
_SPACE = r"\t\n\f\r "


def quote(text: str) -> str:
    """Quote a literal for either dialect."""
    return re.sub(r"([^\w\s/:@,;'\"!%&=<>~`#-])", r"\\\1", text, flags=re.ASCII)


def glob_to_regex(pattern: str) -> str:
    """Anchored, case-sensitive glob: ``*`` any run, ``?`` any one character."""
    body = "".join({"*": ".*", "?": "."}.get(ch) or quote(ch) for ch in pattern)
    return f"^{body}\\z"


def glob_match(value: Column, pattern: str) -> Column:
    """Glob test, as plain string comparison whenever the shape of the glob allows it."""
    stars = pattern.count("*")
    if "?" not in pattern:
        if stars == 0:
            return value == F.lit(pattern)
        if stars == 1 and pattern.endswith("*"):
            return value.startswith(pattern[:-1])
        if stars == 1 and pattern.startswith("*"):
            return value.endswith(pattern[1:])
    return value.rlike(glob_to_regex(pattern))


def alert_glob_to_regex(pattern: str) -> str:
    """The alert dialect: only ``*`` is special, any case, any line break."""
    return "(?isu)^" + ".*".join(quote(part) for part in pattern.split("*")) + "\\z"


def like_text(text: str) -> str:
    """User text inside an ILIKE pattern: wildcards stay active, stray escapes are doubled."""
    return re.sub(r"\\(.?)", lambda m: m[0] if m[1] and m[1] in "%_\\" else "\\\\" + m[1], text, flags=re.DOTALL)


def group_count(pattern: str) -> int:
    """Number of capturing groups."""
    return _walk(pattern)[1]


def to_java(pattern: str) -> str:
    """Translate an RE2 pattern so that Java gives the same matches."""
    return "(?d)" + _walk(pattern)[0]


def _walk(pattern: str) -> tuple[str, int]:
    out: list[str] = []
    groups = 0
    in_class = False
    multiline = bool(re.search(r"\(\?[a-zA-Z]*m", pattern))
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            elif nxt == "S":
                out.append(f"[^{_SPACE}]")
            elif nxt == "Q":
                end = pattern.find("\\E", i)
                end = n if end < 0 else end
                out.append(quote(pattern[i + 2 : end]))
                i = end
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            if ch == "[" and pattern.startswith("[:", i) and ":]" in pattern[i:]:
                end = pattern.index(":]", i)
                name = pattern[i + 2 : end]
                negate = name.startswith("^")
                posix = {"word": "w"}.get(name.lstrip("^"))
                out.append(("\\W" if negate else "\\w") if posix else f"\\{'P' if negate else 'p'}{{{_posix(name)}}}")
                i = end + 2
                continue
            if ch == "]":
                in_class = False
            elif ch in "[&":
                out.append("\\")
            out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            if pattern.startswith("^", i):
                out.append("^")
                i += 1
            if pattern.startswith("]", i):
                out.append("\\]")
                i += 1
            continue
        if ch == "(":
            named = _GROUP_NAME.match(pattern, i + 1)
            flags = _FLAGS.match(pattern, i + 1)
            if named:
                groups += 1
                out.append("(")
                i = named.end()
                continue
            if flags:
                if "U" in flags.group(1):
                    raise ValueError("the ungreedy flag is not supported")
                text = flags.group(0)
                out.append("(" + (text.replace("i", "iu", 1) if "i" in flags.group(1) else text))
                i = flags.end()
                continue
            if not pattern.startswith("(?", i):
                groups += 1
        if ch == "$" and not multiline:
            out.append("\\z")
        else:
            out.append(ch)
        i += 1
    return "".join(out), groups


def _posix(name: str) -> str:
    names = {"ascii": "ASCII", "xdigit": "XDigit"}
    bare = name.lstrip("^")
    return names.get(bare, bare.capitalize())


_REPEAT = re.compile(r"[?*+][?+]?|\{\d+(?:,\d*)?\}[?+]?")
# Escapes longer than two characters: code points, properties, octal numbers and back references.
_LONG_ESCAPE = re.compile(r"\\(?:x\{[^}]*\}|x[0-9A-Fa-f]{2}|[pP]\{[^}]*\}|[pP].|k<[^>]*>|c.|\d{1,3})", re.DOTALL)


def _class_end(pattern: str, start: int) -> int:
    """Place behind the character class that opens at ``start``."""
    i = start + 1
    if pattern.startswith("^", i):
        i += 1
    if pattern.startswith("]", i):
        i += 1
    while i < len(pattern) and pattern[i] != "]":
        if pattern[i] == "\\":
            long = _LONG_ESCAPE.match(pattern, i)
            i = long.end() if long else i + 2
        elif pattern.startswith("[:", i) and ":]" in pattern[i:]:
            i = pattern.index(":]", i) + 2
        else:
            i += 1
    return i + 1


def required_literal(pattern: str) -> str:
    """The longest text every match must contain, empty when none is certain.

    Only characters that stand for themselves once at the top level count: groups, classes,
    long escapes and anything repeated end a run, and any top-level alternation, flag or quoted
    run gives up. Testing for it first spares most rows a pattern that backtracks.
    """
    if re.search(r"\(\?[a-zA-Z-]+[:)]", pattern) or "\\Q" in pattern:
        return ""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        end, literal = i + 1, ""
        if ch == "\\":
            long = _LONG_ESCAPE.match(pattern, i)
            end = long.end() if long else i + 2
            literal = "" if pattern[i + 1 : i + 2].isalnum() else pattern[i + 1 : i + 2]
        elif ch == "[":
            end = _class_end(pattern, i)
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            return ""
        elif ch not in ".^$|{}?*+":
            literal = ch
        repeat = _REPEAT.match(pattern, end)
        if depth or not literal or repeat:
            if not depth and literal and repeat and repeat.group().startswith("+"):
                run += literal
            runs.append(run)
            run = ""
        else:
            run += literal
        i = repeat.end() if repeat else end
    return max([*runs, run], key=len)


_COMPILED: dict[str, bool] = {}


def compiles(spark: SparkSession, patterns: list[str]) -> list[bool]:
    """Which Java patterns compile. Folded on the driver, no job is run; answers are remembered."""

    def probe(batch: list[str]) -> bool:
        try:
            spark.sql("SELECT * FROM VALUES (0) AS one(x)").select(*[F.lit("").rlike(p) for p in batch]).collect()
            return True
        except Exception:
            return False

    new = [p for p in dict.fromkeys(patterns) if p not in _COMPILED]
    if new:
        together = probe(new)
        _COMPILED.update({p: together or probe([p]) for p in new})
    return [_COMPILED[p] for p in patterns]


def check_user_pattern(pattern: str) -> str:
    """Refuse patterns likely to backtrack without bound; returns the Java form."""
    if len(pattern) > MAX_USER_PATTERN:
        raise ValueError(f"pattern longer than {MAX_USER_PATTERN} characters")
    if _NESTED_QUANTIFIER.search(pattern):
        raise ValueError("nested unbounded repeat")
    return to_java(pattern)
