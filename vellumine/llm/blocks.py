"""Blocks of a Markdown text: the non-blank pieces between blank lines, counted from 0, with their kind."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_GAP = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:(?:\r\n|\r|\n)[^\S\r\n]*)+")
_LIST = re.compile(r"\s{0,3}(?:[-*+]\s|\d{1,9}[.)]\s)")
_HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
_RULE = re.compile(r"\s*(?:[-*_]\s*){3,}$")
_UNDERLINED = re.compile(r"[^\n]*\n\s*(?:=+|-+)\s*$")
RUNNING = "text"


class Block(NamedTuple):
    no: int
    start: int
    end: int
    kind: str


def blocks(text: str) -> list[Block]:
    """Kinds: text, heading, list, table, code, quote, comment, front."""
    out: list[Block] = []
    at, n, fence, front = 0, len(text), "", False
    edges = [m.span() for m in _GAP.finditer(text)] + [(n, n)]
    for stop, after in edges:
        piece = text[at:stop]
        if body := piece.strip():
            lead = len(piece) - len(piece.lstrip())
            kind = RUNNING
            if fence:
                kind = "code"
                if re.search(r"(?m)^\s{0,3}" + re.escape(fence) + r"[`~]*\s*$", piece):
                    fence = ""
            elif front:
                kind = "front"
                front = not re.search(r"(?m)^---\s*$", piece)
            elif (first := body[0]).isalpha():  # most blocks: no sign begins them
                if body[-1] in "=-" and _UNDERLINED.match(body):
                    kind = "heading"
            elif first in "`~" and (m := _FENCE.match(body)):
                kind = "code"
                if not re.search(r"(?m)^\s{0,3}" + re.escape(m.group(1)) + r"[`~]*\s*$", body[m.end() :]):
                    fence = m.group(1)
            elif not out and body.startswith("---") and body.split("\n", 1)[0].strip() == "---":
                kind = "front"
                front = not re.search(r"(?m)^---\s*$", body[3:])
            elif body.startswith("<!--") or (first == "<" and body[-1] == ">"):
                kind = "comment"
            elif first == "#" and _HEADING.match(body):
                kind = "heading"
            elif first == "|":
                kind = "table"
            elif first == ">":
                kind = "quote"
            elif first in "-*_" and _RULE.match(body):
                kind = "comment"
            elif _LIST.match(body):
                kind = "list"
            elif first == "`" and body[-1] == "`" and body.count("`") == 2:
                kind = "code"
            elif body[-1] in "=-" and _UNDERLINED.match(body):
                kind = "heading"
            start = at + lead
            out.append(Block(len(out), start, start + len(body), kind))
        at = after
    return out


def wording(text: Column) -> Column:
    """A text without regard to case and to the numbers and codes in it, so that copies that differ in these are one."""
    return F.regexp_replace(F.lower(text), r"(?<![a-z0-9])[a-z]{0,16}+[0-9][a-z0-9]*+", "0")
