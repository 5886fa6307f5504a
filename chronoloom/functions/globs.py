"""Series name patterns as predicates on catalog columns.

``*`` is any run of characters within a segment, ``**`` as a whole segment any
number of segments, ``[a-f]`` one character, ``{x,y}`` one of several parts; dots part
segments. A pattern becomes conditions that reach the Parquet scan: equality or a
literal prefix, the number of segments, and a regular expression for the rest.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_LITERAL = r"A-Za-z0-9!\"#$%&'+\-:;<=>?@\\^_`~"


def _class(body: str) -> str:
    """Characters of a bracket: ranges ascend, a descending one names its ends."""
    chars: set[str] = set()
    i = 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-" and body[i] != "-":
            a, b = body[i], body[i + 2]
            chars |= {chr(c) for c in range(ord(a), ord(b) + 1)} or {a, b}
            i += 3
        else:
            chars.add(body[i])
            i += 1
    return "[" + "".join(map(re.escape, sorted(chars))) + "]"


def _segment(text: str) -> str:
    """Regular expression of one segment (or of one part of a choice)."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            i += len(text[i:]) - len(text[i:].lstrip("*"))
            out += "[^.]*"
            continue
        if c == "[":
            end = text.index("]", i)
            if not text[i + 1 : end]:
                raise ValueError("empty set")
            out += _class(text[i + 1 : end])
            i = end + 1
        elif c == "{":
            depth, parts, start, j = 0, [], i + 1, i
            while True:
                if j >= len(text):
                    raise ValueError("open choice")
                if text[j] == "{":
                    depth += 1
                elif text[j] == "}":
                    depth -= 1
                    if not depth:
                        break
                elif text[j] == "," and depth == 1:
                    parts.append(text[start:j])
                    start = j + 1
                j += 1
            parts.append(text[start:j])
            if len(parts) < 2:
                raise ValueError("one choice only")
            out += "(?:" + "|".join(_segment(p.strip()) for p in parts) + ")"
            i = j + 1
        elif re.match(f"[{_LITERAL}]", c):
            out += re.escape(c)
            i += 1
        else:
            raise ValueError(f"character {c!r}")
    return out


def split_segments(pattern: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(pattern):
        depth += (c in "{[") - (c in "}]")
        if c == "." and not depth:
            out.append(pattern[start:i])
            start = i + 1
        elif c == "." and depth:
            raise ValueError("dot within brackets")
    return [*out, pattern[start:]]


def regex(pattern: str) -> str:
    """The whole-name regular expression; ValueError if the pattern is malformed."""
    segs = split_segments(pattern)
    out = ""
    for i, seg in enumerate(segs):
        last = i == len(segs) - 1
        if seg == "**":
            # The last one takes the segments that are left; before, each with its dot.
            out += r"[^.]+(?:\.[^.]+)*" if last and i == 0 else (r"(?:[^.]+(?:\.[^.]+)*)?" if last else r"(?:[^.]+\.)*")
        elif not seg:
            raise ValueError("empty segment")
        else:
            out += _segment(seg) + ("" if last else r"\.")
    if len(segs) > 1 and segs[-1] == "**":  # "a.**" takes "a" itself only with a segment behind it
        out = "".join(((r"(?:[^.]+\.)*" if s == "**" else _segment(s) + r"\.") for s in segs[:-1])) + r"[^.]+(?:\.[^.]+)*"
    return f"^{out}$"


def matches(pattern: str, name: Column, n_segs: Column | None = None) -> Column:
    """Whether ``name`` fits; a malformed pattern fits nothing, an empty one all."""
    if pattern in ("", "**"):
        return F.lit(True)
    try:
        expression = regex(pattern)
        segs = split_segments(pattern)
    except ValueError:
        return F.lit(False)
    if re.fullmatch(f"[{_LITERAL}.]+", pattern):
        return name == pattern
    found = name.rlike(expression)
    prefix = re.match(f"[{_LITERAL}.]*", pattern)[0]
    if prefix:
        found = name.startswith(prefix) & found
    if n_segs is not None and "**" not in segs:
        found = (n_segs == len(segs)) & found
    return found
