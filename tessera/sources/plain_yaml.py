"""The part of YAML that manifests and frontmatter use: block mappings and lists, flow lists of scalars, plain and quoted scalars."""

from __future__ import annotations

import re

FRONTMATTER = re.compile(r"\A---\s*\n(.*?)\n---\s*(?:\n|\Z)", re.DOTALL)
_NUMBER = re.compile(r"[-+]?(\d+|\d*\.\d+|\d+\.\d*)([eE][-+]?\d+)?$")
_KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s#:\-\[{][^:#]*?|-[^\s:][^:#]*?)\s*:(\s+|$)""")


def scalar(text: str) -> object:
    """A scalar's value: text, number, boolean, null, or a flow list of these."""
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1].replace("''", "'") if text[0] == "'" else text[1:-1].replace('\\"', '"').replace("\\\\", "\\")
    text = re.sub(r"\s+#.*$", "", text)
    if text.startswith("[") and text.endswith("]"):
        return [scalar(part) for part in text[1:-1].split(",") if part.strip()]
    if text in ("", "~") or text.lower() == "null":
        return None
    if text == "{}":
        return {}
    if text.lower() in ("true", "false", "yes", "no", "on", "off"):
        return text.lower() in ("true", "yes", "on")
    return float(text) if _NUMBER.match(text) else text


def load(text: str) -> object:
    """The value that the lines of ``text`` describe; lines that fit no form are skipped."""
    lines = [(len(raw) - len(raw.lstrip(" ")), raw.strip()) for raw in text.split("\n") if raw.strip() and not raw.strip().startswith("#")]
    return _block(lines, 0, lines[0][0])[0] if lines else None


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[object, int]:
    """The value of the block that starts at line ``at``, and the line after it."""
    listed = lines[at][1] == "-" or lines[at][1].startswith("- ")
    if not listed and not _KEY.match(lines[at][1]):
        return scalar(lines[at][1]), at + 1
    out: dict | list = [] if listed else {}
    while at < len(lines) and lines[at][0] == indent:
        line = lines[at][1]
        if listed != (line == "-" or line.startswith("- ")):
            break
        if listed:
            inner = line[1:].lstrip()
            if inner:  # what follows the dash is the first line of a block of its own
                depth = indent + len(line) - len(inner)
                lines = [*lines[:at], (depth, inner), *lines[at + 1 :]]
                value, at = _block(lines, at, depth)
            else:
                value, at = _below(lines, at + 1, indent + 1)
            out.append(value)
            continue
        found = _KEY.match(line)
        if not found:
            at += 1
            continue
        rest = line[found.end() :].strip()
        if rest and not rest.startswith("#"):
            value, at = scalar(rest), at + 1
        else:  # a list may stand at the key's own depth
            dashed = at + 1 < len(lines) and lines[at + 1][0] == indent and (lines[at + 1][1] == "-" or lines[at + 1][1].startswith("- "))
            value, at = _below(lines, at + 1, indent if dashed else indent + 1)
        out[str(scalar(found[1]))] = value
    while at < len(lines) and lines[at][0] > indent:  # deeper than anything that was opened
        at += 1
    return out, at


def _below(lines: list[tuple[int, str]], at: int, least: int) -> tuple[object, int]:
    """The block at ``at`` if it is at least as deep, else null."""
    if at < len(lines) and lines[at][0] >= least:
        return _block(lines, at, lines[at][0])
    return None, at


def frontmatter(markdown: str | None) -> dict:
    """The mapping in front of a Markdown text, empty if there is none."""
    found = FRONTMATTER.match(markdown or "")
    value = load(found[1]) if found else None
    return value if isinstance(value, dict) else {}
