"""Regular expressions: Python syntax in, JVM syntax out, at plan time."""

from __future__ import annotations

import re

# Fixed values. Whitespace and digit classes equal to str.split / str.isdigit.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DIGIT = r"[\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468]"
FLAGS = "(?Ud)"
ASCII_FLAGS = "(?d)"
# "After a non-alphanumeric or at the start" is the same as "not after an
# alphanumeric", and the JVM tests the second form several times faster.
BOUNDARIES = (("((?<=[^A-Za-z0-9])|^)", "(?<![A-Za-z0-9])"),
              ("((?=[^A-Za-z0-9])|$)", "(?![A-Za-z0-9])"))


def jvm_pattern(pattern: str, flags: str = FLAGS) -> str:
    """Rewrite Python-only group syntax and switch on Unicode classes."""
    out = pattern
    if not re.search(r"\\[1-9]", pattern):
        for slow, fast in BOUNDARIES:
            out = out.replace(slow, fast)
    out = out.replace("(?P<", "(?<")
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    return flags + out


def quote(text: str) -> str:
    """A JVM regex that matches ``text`` literally."""
    return re.sub(r"([\\.\[\]{}()*+\-?^$|&~#<>=!:,'\"/%@`;])", r"\\\1", text)


def quote_replacement(text: str) -> str:
    """Escape the two characters a JVM replacement string treats specially."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def mask_token(prefix: str = "<", suffix: str = ">") -> str:
    """Regex of a mask such as ``<NUM>`` for the configured prefix and suffix."""
    return f"{quote(prefix)}[^:]+{quote(suffix)}"


def header_pattern(log_format: str) -> tuple[list[str], str]:
    """Compile ``<Date> <Time>: <Content>`` to (field names, regex).

    Field ``i`` is the named group ``f<i>``, so literal parts may hold groups of
    their own.
    """
    names: list[str] = []
    regex = ""
    for part in re.split(r"(<[^<>]+>)", log_format):
        if re.fullmatch(r"<[^<>]+>", part):
            regex += f"(?<f{len(names)}>.*?)"
            names.append(part[1:-1])
        else:
            regex += re.sub(r" +", r"\\s+", part)
    return names, f"{FLAGS}^{regex}$"
