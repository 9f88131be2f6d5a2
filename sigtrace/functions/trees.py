"""JSON text as trees, in Python workers: strict parsing at any depth, and interval labels."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring


class Number(str):
    """A JSON number as it is written; never turned into a float or a long int."""

    __slots__ = ()

    @property
    def kind(self) -> str:
        return "number" if any(c in ".eE" for c in self) else "integer"


def _no_constant(name: str):
    raise ValueError(name)


class _Strict:
    """A JSON decoder that can be sent to workers."""

    def __init__(self):
        self.decode = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_no_constant).decode

    def __reduce__(self):
        return _Strict, ()


_strict = _Strict()
_TOKEN = re.compile(r"[ \t\n\r]*(?:([\[\]{},:])|(\")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))")
_END = re.compile(r"[ \t\n\r]*\Z")
_HEADS = "{[ \t\n\r"  # how a text that holds a tree begins
_WORDS = {"true": True, "false": False, "null": None}


def _deep(text: str):
    """The same as ``_strict`` without recursion, for trees nested beyond Python's stack."""
    stack: list = []  # [container, key]
    at, want = 0, "value"
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, quote, num, word = m.groups()
        if mark in ("]", "}"):
            fits = stack and (mark == "]") == isinstance(stack[-1][0], list) and (want == "next" or want == "first")
            if not fits:
                raise ValueError(f"misplaced {mark} at {at}")
            done = stack.pop()[0]
        elif mark == ",":
            if want != "next":
                raise ValueError(f"misplaced comma at {at}")
            want = "value" if isinstance(stack[-1][0], list) else "key"
            continue
        elif mark == ":":
            if want != "colon":
                raise ValueError(f"misplaced colon at {at}")
            want = "value"
            continue
        elif want == "key" or (want == "first" and isinstance(stack[-1][0], dict)):
            if not quote:
                raise ValueError(f"no key at {at}")
            stack[-1][1], at = scanstring(text, at, True)
            want = "colon"
            continue
        elif want not in ("value", "first"):
            raise ValueError(f"misplaced value at {at}")
        elif mark:
            stack.append([[] if mark == "[" else {}, None])
            want = "first"
            continue
        elif quote:
            done, at = scanstring(text, at, True)
        else:
            done = Number(num) if num else _WORDS[word]
        if not stack:
            if not _END.match(text, at):
                raise ValueError(f"more text at {at}")
            return done
        box, key = stack[-1]
        if isinstance(box, list):
            box.append(done)
        else:
            box[key] = done
        want = "next"


def parse(text: str):
    """The value of strict JSON text; ValueError for anything else. Of repeated keys the last counts."""
    try:
        return _strict.decode(text)
    except RecursionError:
        return _deep(text)


def embedded(text: str):
    """The object or array whose text a string is, else None."""
    head = text.lstrip(" \t\n\r")[:1]
    if head != "{" and head != "[":
        return None
    try:
        return parse(text)
    except ValueError:
        return None


def root_of(text: str | None):
    """The object or array of a tree's text, also if it is written as a JSON string; None if there is none."""
    if text is None:
        return None
    try:
        root = parse(text)
    except ValueError:
        return None
    if type(root) is str:
        root = embedded(root)
    return root if type(root) in (dict, list) else None


OBJECT, ARRAY, SCALAR = "object", "array", "scalar"


def label(root, kinds: frozenset[str] = frozenset((OBJECT,)), members: bool = False) -> list[list]:
    """The nodes of ``kinds`` in pre-order: [kind, pre, post, level, pointer, value].

    ``pre`` and ``post`` number all nodes, of whatever kind, as a depth-first
    traversal enters and leaves them, so node a lies around node b exactly if
    ``a.pre < b.pre`` and ``a.post > b.post``. ``pointer`` is the JSON pointer.
    The value is given for scalars only; with ``members`` an object's value is
    the dictionary of its scalar members, nulls too.
    """
    out: list[list] = []
    pre = post = 0
    stack: list[tuple] = []
    steps: list[str] = []  # the pointer's parts down to the node at the top of the stack
    objects, arrays, scalars = OBJECT in kinds, ARRAY in kinds, SCALAR in kinds

    def enter(v) -> None:
        nonlocal pre
        isdict = type(v) is dict
        node = None
        if objects if isdict else arrays:
            node = [OBJECT if isdict else ARRAY, pre, 0, len(stack), "/" + "/".join(steps) if steps else "", {} if members and isdict else None]
            out.append(node)
        stack.append((iter(v.items()) if isdict else enumerate(v), isdict, node))
        pre += 1

    enter(root)
    while stack:
        children, isdict, node = stack[-1]
        depth, base = len(stack), None
        own = node[5] if node else None
        for k, v in children:
            t = type(v)
            if t is str and v[:1] in _HEADS:
                inner = embedded(v)
                if inner is not None:
                    v, t = inner, type(inner)
            nested = t is dict or t is list
            if not nested and own is not None:
                own[k] = v
            if nested or scalars:
                if not isdict:
                    k = str(k)
                elif "~" in k or "/" in k:
                    k = k.replace("~", "~0").replace("/", "~1")
                if nested:
                    steps.append(k)
                    enter(v)
                    break
                if base is None:
                    base = "/".join(("", *steps, ""))
                out.append([SCALAR, pre, post, depth, base + k, v])
            pre += 1
            post += 1
        else:
            stack.pop()
            if steps:
                steps.pop()
            if node:
                node[2] = post
            post += 1
    return out


def parents(nodes: list[list], kind: str = OBJECT) -> list[int]:
    """For each node in pre-order the place of the nearest ``kind`` node whose interval contains it, or -1."""
    found, around = [], []
    for i, n in enumerate(nodes):
        while around and nodes[around[-1]][2] < n[2]:
            around.pop()
        found.append(around[-1] if around else -1)
        if n[0] == kind:
            around.append(i)
    return found
