"""Globs of parameter names."""

from __future__ import annotations

import re


def scope_param(param: str, ost: bool = False, mdt: bool = False) -> str:
    """The glob of a scope: all object targets, all metadata targets, or the one that is given."""
    if ost:
        return "obdfilter.*.job_stats"
    return "mdt.*.job_stats" if mdt else param


def glob_pattern(glob: str) -> str:
    """A glob of ``*``, ``?`` and classes such as ``[0-3]`` or ``[!ab]`` as an anchored regular expression."""
    out, at = [], 0
    while at < len(glob):
        char = glob[at]
        if char == "[":
            end = glob.find("]", at + 2)
            if end < 0:
                raise ValueError(f"class without an end in {glob!r}")
            body = glob[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[^{body[1:]}]" if body[0] in "!^" else f"[{body}]")
            at = end
        elif char in "{}":
            raise ValueError(f"{char!r} is not supported in {glob!r}")
        else:
            out.append({"*": ".*", "?": "."}.get(char) or re.escape(char))
        at += 1
    return f"(?s)^{''.join(out)}\\z"
