"""Free-text descriptions of tables and manifests of scenarios, read on the driver."""

from __future__ import annotations

import re


def parse_columns(text: str) -> dict[str, dict[str, str]]:
    """file: {column: description}; columns count after a line that says which information is available."""
    out: dict[str, dict[str, str]] = {}
    files: list[str] = []
    listing = False
    for line in (x.strip() for x in text.splitlines()):
        head = re.match(r"files?(?:\(s\))?\s*:\s*(.*)", line, re.I)
        if head:
            files, listing = [f.strip() for f in head[1].split(",") if f.strip()], False
            out.update({f: {} for f in files})
        elif "information available" in line.lower():
            listing = True
        elif listing and (found := re.match(r"[-*\s]*([A-Za-z_][\w ]*?)\s*:\s*(.+)", line)):
            for f in files:
                out[f][found[1].strip()] = found[2].strip()
    return out


def parse_groups(text: str) -> dict[str, dict]:
    """file: group heading, columns and notes."""
    out: dict[str, dict] = {}
    group, files = "", []
    for line in (x.strip() for x in text.splitlines()):
        head = re.match(r"files?(?:\(s\))?\s*:\s*(.*)", line, re.I)
        if head:
            files = [f.strip() for f in head[1].split(",") if f.strip()]
            for f in files:
                out[f] = {"group": group, "columns": {}, "notes": []}
        elif line and not files and ":" not in line or line.endswith(":") and " " not in line[:-1]:
            group, files = line.rstrip(":"), []
        elif found := re.match(r"[-*\s]*([A-Za-z_]\w*)\s*:\s*(.+)", line):
            for f in files:
                out[f]["columns"][found[1]] = found[2].strip()
        elif line:
            for f in files:
                out[f]["notes"].append(line)
        else:
            files = [] if not line and files and not out[files[0]]["columns"] else files
    return out


def parse_manifest(text: str) -> list[dict[str, str]]:
    """Entries of a simple list of `key: value` lines; the yaml library reads it if it's there."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml is not None:
        data = yaml.safe_load(text) or []
        return data if isinstance(data, list) else next(iter(data.values()))
    out: list[dict[str, str]] = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        if body.lstrip().startswith("- ") and ":" in body:
            out.append({})
        if out and ":" in body:
            k, v = body.lstrip(" -").split(":", 1)
            out[-1][k.strip()] = v.strip().strip("'\"")
    return out
