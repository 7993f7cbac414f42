"""Workflow graphs as one relation of nodes, links and notes (S-26 to S-30, S-32, J-03 to J-06, P-12 to P-14, P-22).

One reader at most claims a document: the shapes exclude each other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

ITEMS = "format string, item string, id string, src string, dst string, pin string, label string"


def first_document(text: str):
    """The first JSON value of a text; what follows it is ignored."""
    return json.JSONDecoder().raw_decode(text.lstrip("\ufeff \t\r\n"))[0]


def _wire(v) -> bool:
    return isinstance(v, list) and len(v) == 2 and isinstance(v[0], (str, int)) and isinstance(v[1], int) and not isinstance(v[1], bool)


def claim(doc) -> str | None:
    """The format of a JSON document; None for an ordinary one."""
    if isinstance(doc, dict):
        nodes = doc.get("nodes")
        if isinstance(nodes, list) and isinstance(doc.get("links"), list) and all(isinstance(n, dict) and "type" in n and "id" in n for n in nodes):
            return "litegraph"
        if isinstance(nodes, list) and isinstance(doc.get("connections"), dict):
            return "n8n"
        if doc and all(isinstance(n, dict) and "class_type" in n and isinstance(n.get("inputs"), dict) for n in doc.values()):
            return "api"
    if isinstance(doc, list) and doc and all(isinstance(n, dict) and "id" in n and "type" in n for n in doc) and any("wires" in n for n in doc):
        return "node-red"
    return None


def _litegraph(doc) -> Iterator[tuple]:
    pins = {(n["id"], side, k): p.get("name", str(k)) for n in doc["nodes"] for side in ("inputs", "outputs") for k, p in enumerate(n.get(side) or [])}
    for n in doc["nodes"]:
        yield ("note" if n["type"] in ("Note", "MarkdownNote") else "node"), n["id"], None, None, None, n.get("title") or n["type"]
    for link in doc["links"]:
        if isinstance(link, list) and len(link) >= 5:
            # A link to a node that is not there stays: this format does not drop them.
            yield "link", link[0], link[1], link[3], f"{pins.get((link[1], 'outputs', link[2]), link[2])}>{pins.get((link[3], 'inputs', link[4]), link[4])}", str(link[5]) if len(link) > 5 else None
    for g in doc.get("groups") or []:
        yield "group", None, None, None, None, g.get("title")


def _api(doc) -> Iterator[tuple]:
    for i, n in doc.items():
        yield "node", i, None, None, None, (n.get("_meta") or {}).get("title") or n["class_type"]
        for name, v in n["inputs"].items():
            if _wire(v):
                yield ("link" if str(v[0]) in doc else "lost"), None, str(v[0]), i, f"{v[1]}>{name}", None


def _n8n(doc) -> Iterator[tuple]:
    by_name = {n.get("name"): n for n in doc["nodes"]}
    by_id = {str(n.get("id")): n for n in doc["nodes"]}
    for n in doc["nodes"]:
        yield ("note" if str(n.get("type", "")).endswith("stickyNote") else "node"), n.get("name"), None, None, None, n.get("type")
    for src, kinds in doc["connections"].items():
        for kind, outs in kinds.items():
            for k, ends in enumerate(outs or []):
                for end in ends or []:
                    target = by_name.get(end.get("node")) or by_id.get(str(end.get("node")))
                    origin = by_name.get(src) or by_id.get(src)
                    yield ("link" if target and origin else "lost"), None, (origin or {}).get("name", src), (target or {}).get("name", end.get("node")), f"{k}>{end.get('index', 0)}", kind


def _node_red(doc) -> Iterator[tuple]:
    tabs = {n["id"] for n in doc if n["type"] in ("tab", "subflow")}
    placed = {n["id"]: n for n in doc if n.get("z") in tabs and n["type"] not in ("group", "comment") and "wires" in n}
    for n in doc:
        if n["id"] in placed:
            yield "node", n["id"], None, None, None, n.get("name") or n["type"]
        else:
            yield {"comment": "note", "group": "group", "tab": "tab", "subflow": "tab"}.get(n["type"], "config"), n["id"], None, None, None, n.get("name") or n.get("label") or n["type"]
    for i, n in placed.items():
        for k, ends in enumerate(n["wires"]):
            for end in ends:
                if end in placed:
                    yield ("link" if placed[end].get("z") == n.get("z") else "jump"), None, i, end, str(k + 1), None
                else:
                    yield "lost", None, i, end, str(k + 1), None


def _godot(text: str) -> Iterator[tuple]:
    """Tree links from parent attributes and signal links from connection sections."""
    for m in re.finditer(r"^\[(node|connection)\s+([^\]]*)\]", text, re.M):
        a = dict(re.findall(r'(\w+)="([^"]*)"', m[2]))
        if m[1] == "connection":
            yield "signal", None, a.get("from"), a.get("to"), a.get("signal"), a.get("method")
            continue
        parent = a.get("parent")
        path = "." if parent is None else a["name"] if parent == "." else f"{parent}/{a['name']}"
        yield "node", path, None, None, None, a.get("type") or a["name"]
        if parent is not None:
            yield "link", None, parent, path, None, "child"


def items(data: bytes, cap: int = 4000) -> Iterator[tuple]:
    """Items of a workflow: nodes up to ``cap``, links among those kept, and a row ``dropped`` with the number left out."""
    text = data.decode("utf-8", "replace")
    if text.startswith("[gd_scene"):
        kind, found = "godot", list(_godot(text))
    else:
        doc = first_document(text)
        kind = claim(doc)
        if kind is None:
            return
        found = list({"litegraph": _litegraph, "api": _api, "n8n": _n8n, "node-red": _node_red}[kind](doc))
    nodes = [f for f in found if f[0] == "node"]
    gone = {str(n[1]) for n in nodes[cap:]}
    for f in found:
        if (f[0] == "node" and str(f[1]) in gone) or (f[2] is not None and ({str(f[2]), str(f[3])} & gone)):
            continue
        yield (kind, f[0], *[None if v is None else str(v) for v in f[1:]])
    if gone:
        yield kind, "dropped", None, None, None, None, str(len(gone))


def role(name: str, ordered: tuple[tuple[str, str], ...]) -> str:
    """The role of the first substring of a priority list that a name holds."""
    low = name.lower()
    return next((r for part, r in ordered if part in low), "other")
