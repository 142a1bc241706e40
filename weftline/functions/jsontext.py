"""Strict reading of JSON text, numbers kept as written.

The JVM parsers of Spark are lenient where a data-quality check must not be (single quotes,
trailing text, numbers rewritten), so this reader runs in Arrow batches in Python.
"""

from __future__ import annotations

import json
import re


class Num(str):
    """A JSON number as it is written."""

    __slots__ = ()


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(parse_float=Num, parse_int=Num, parse_constant=_constant)
_WS = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
_LITERALS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str):
    """Parse without recursion: texts nested beyond the interpreter's stack."""
    stack: list = []  # open containers
    keys: list = []  # key under which the next value of each open object goes
    i = _WS.match(text, 0).end()
    root: list = []

    def put(value):
        if not stack:
            root.append(value)
        elif isinstance(stack[-1], list):
            stack[-1].append(value)
        else:
            stack[-1][keys[-1]] = value

    def read_key(at: int) -> int:
        if text[at : at + 1] != '"':
            raise ValueError("key expected")
        keys[-1], at = json.decoder.scanstring(text, at + 1, True)
        at = _WS.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("colon expected")
        return _WS.match(text, at + 1).end()

    expect_value = True
    while expect_value or stack:
        c = text[i : i + 1]
        if expect_value:
            if c in ("{", "["):
                new = {} if c == "{" else []
                put(new)
                stack.append(new)
                keys.append(None)
                i = _WS.match(text, i + 1).end()
                if text[i : i + 1] == ("}" if c == "{" else "]"):
                    stack.pop()
                    keys.pop()
                    i += 1
                    expect_value = False
                elif c == "{":
                    i = read_key(i)
                continue
            if c == '"':
                value, i = json.decoder.scanstring(text, i + 1, True)
            else:
                for word, value in _LITERALS.items():
                    if text.startswith(word, i):
                        i += len(word)
                        break
                else:
                    m = _NUMBER.match(text, i)
                    if not m:
                        raise ValueError("value expected")
                    value, i = Num(m.group()), m.end()
            put(value)
            expect_value = False
        else:
            i = _WS.match(text, i).end()
            c = text[i : i + 1]
            is_object = isinstance(stack[-1], dict)
            if c == ",":
                i = _WS.match(text, i + 1).end()
                if is_object:
                    i = read_key(i)
                expect_value = True
            elif c == ("}" if is_object else "]"):
                stack.pop()
                keys.pop()
                i += 1
            else:
                raise ValueError("comma or end expected")
    if _WS.match(text, i).end() != len(text):
        raise ValueError("text after the end")
    return root[0]


def parse(text: str):
    """The value of a JSON text; ValueError where it is not well formed."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _parse_deep(text)


def parse_unwrapped(text: str):
    """As parse; a JSON string that holds JSON text counts as that JSON, at any depth of wrapping."""
    value = parse(text)
    while isinstance(value, str) and not isinstance(value, Num):
        try:
            value = parse(value)
        except ValueError:
            return value
    return value


def clean(text: str) -> str:
    """Text that UTF-8 can hold: lone surrogates, which JSON escapes can spell, become '?'."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def as_text(value) -> str | None:
    """A field's value as text: strings and numbers as written, other values as compact JSON."""
    if value is None:
        return None
    return clean(str(value) if isinstance(value, str) else dump(value))


def dump(value) -> str:
    """Compact JSON of a parsed value, numbers as written."""
    if isinstance(value, Num):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)
