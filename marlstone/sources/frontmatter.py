"""The YAML subset of notes' frontmatter: scalars, inline and block lists, nested maps, block scalars. Never raises."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd


def scalar(raw: str):
    raw = raw.strip()
    if raw[:1] in "\"'" and raw[-1:] == raw[:1] and len(raw) > 1:
        return raw[1:-1]
    raw = re.sub(r"\s+#.*$", "", raw)
    if raw in ("", "~", "null", "Null", "NULL"):
        return None
    if raw in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return raw.lower() == "true"
    if re.fullmatch(r"-?\d{1,15}", raw):
        return int(raw)
    if re.fullmatch(r"-?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", raw) and len(raw) < 25:
        return float(raw)
    if raw[0] == "[" and raw[-1] == "]":
        return [scalar(x) for x in _split(raw[1:-1])]
    if raw[0] == "{" and raw[-1] == "}":
        pairs = (x.partition(":") for x in _split(raw[1:-1]))
        return {k.strip().strip("\"'"): scalar(v) for k, _, v in pairs}
    return raw


def _split(s: str) -> list[str]:
    out, depth, quote, part = [], 0, "", ""
    for c in s:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(part)
            part = ""
        else:
            part += c
    return [x for x in [*out, part] if x.strip()]


def _block(lines: list[tuple[int, str]], at: int, indent: int):
    out: dict | list | None = None
    while at < len(lines):
        depth, line = lines[at]
        if depth < indent:
            break
        if depth > indent:  # a stray line
            at += 1
            continue
        if line.startswith("- ") or line == "-":
            out = out if isinstance(out, list) else []
            item = line[2:].strip()
            at += 1
            if re.match(r"[A-Za-z_][\w -]*:(\s|$)", item):
                lines.insert(at, (indent + 2, item))
                value, at = _block(lines, at, indent + 2)
                out.append(value)
            else:
                out.append(scalar(item))
            continue
        m = re.match(r"([^:]+?)\s*:(?:\s+(.*)|$)", line)
        at += 1
        if not m:
            continue
        out = out if isinstance(out, dict) else {}
        key, value = m[1].strip("\"'"), (m[2] or "").strip()
        if value in ("|", ">", "|-", ">-"):
            text = []
            while at < len(lines) and lines[at][0] > indent:
                text.append(lines[at][1])
                at += 1
            out[key] = ("\n" if value[0] == "|" else " ").join(text)
        elif not value and at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("-")):
            out[key], at = _block(lines, at, lines[at][0])
        else:
            out[key] = scalar(value) if value else None
    return out, at


def parse(text: str | None) -> dict:
    """The data of a note's frontmatter; {} without one or if it isn't closed."""
    m = re.match(r"---[ \t]*\r?\n(.*?)\r?\n(?:-{3,}|\.{3})[ \t]*(?:\r?\n|$)", text or "", re.S)
    if not m:
        return {}
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in m[1].splitlines() if x.strip() and not x.lstrip().startswith("#")]
    data, _ = _block(lines, 0, lines[0][0] if lines else 0)
    return data if isinstance(data, dict) else {}


def as_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For a pandas_udf: the data as JSON, to be read by parse_json into a variant."""
    for s in texts:
        yield s.map(lambda t: json.dumps(parse(t), ensure_ascii=False, default=str))
