"""Reading declared schemas: Spark JSON structs and Parquet message texts.

A schema becomes a list of fields ``(outer, name, type, id, former)``: ``outer`` is
the chain of enclosing struct fields (each as ``name#id``), ``type`` a Spark type
name (``struct`` for a struct, whose own fields follow as entries of their own).
These functions see one schema at a time and never a table.
"""

from __future__ import annotations

import hashlib
import json
import re

#: Parquet physical types without annotation, and annotations, as Spark reads them.
PHYSICAL = {
    "boolean": "boolean", "int32": "integer", "int64": "long", "int96": "timestamp",
    "float": "float", "double": "double", "binary": "binary", "fixed_len_byte_array": "binary",
}
ANNOTATED = {
    "UTF8": "string", "STRING": "string", "ENUM": "string", "JSON": "string", "BSON": "binary", "DATE": "date",
    "TIMESTAMP_MILLIS": "timestamp", "TIMESTAMP_MICROS": "timestamp", "TIMESTAMP": "timestamp",
    "INT_8": "byte", "INT_16": "short", "INT_32": "integer", "INT_64": "long",
    "UINT_8": "short", "UINT_16": "integer", "UINT_32": "long", "UINT_64": "decimal(20,0)",
}
SPELLINGS = {"timestamp_ntz": "timestamp", "timestamp_ltz": "timestamp", "int": "integer", "bigint": "long", "smallint": "short", "tinyint": "byte"}

_TOKEN = re.compile(r"[{};=]|\([^()]*(?:\([^()]*\)[^()]*)*\)|[^\s{};=()]+(?:\([^()]*\))?")


class Field:
    __slots__ = ("former", "id", "inner", "name", "type")

    def __init__(self, name: str, kind: str, ident: int | None, former: str | None, inner: list[Field] | None):
        self.name, self.type, self.id, self.former, self.inner = name, kind, ident, former, inner


def _flat(fields: list[Field]) -> str:
    return "struct<" + ",".join(sorted(f"{f.name}:{f.type if f.inner is None else _flat(f.inner)}" for f in fields)) + ">"


def _json_type(kind) -> tuple[str, list[Field] | None]:
    if isinstance(kind, str):
        kind = kind.replace(" ", "")
        if kind == "decimal":
            kind = "decimal(10,0)"
        return SPELLINGS.get(kind, kind), None
    what = kind["type"]
    if what == "struct":
        return "struct", _json_fields(kind["fields"])
    if what == "array":
        t, inner = _json_type(kind["elementType"])
        return f"array<{t if inner is None else _flat(inner)}>", None
    if what == "map":
        parts = [_json_type(kind[k]) for k in ("keyType", "valueType")]
        return "map<" + ",".join(t if inner is None else _flat(inner) for t, inner in parts) + ">", None
    if what == "udt":
        return _json_type(kind["sqlType"])
    raise ValueError(what)


def _json_fields(items) -> list[Field]:
    out = []
    for x in items:
        kind, inner = _json_type(x["type"])
        meta = x.get("metadata") or {}
        ident, former = meta.get("parquet.field.id"), meta.get("former_name")
        out.append(Field(str(x["name"]), kind, None if ident is None else int(ident), former if isinstance(former, str) else None, inner))
    return out


def read_json_schema(text: str | None) -> list[Field] | None:
    """Fields of a Spark JSON struct; None where it is no struct with fields."""
    if not text:
        return None
    try:
        top = json.loads(text)
        if not isinstance(top, dict) or top.get("type") != "struct":
            return None
        return _json_fields(top["fields"]) or None
    except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
        return None


def _annotation(physical: str, note: str | None) -> str:
    if note is None:
        return PHYSICAL.get(physical, physical)
    word, _, args = note.partition("(")
    args = args.rstrip(")").replace(" ", "")
    if word == "DECIMAL":
        return f"decimal({args if ',' in args else args + ',0'})"
    if word in ("INT", "INTEGER"):
        width, signed = args.split(",")
        return ANNOTATED[("" if signed == "true" else "U") + "INT_" + width]
    if word == "TIME" or word.startswith("TIME_"):
        return PHYSICAL.get(physical, physical)
    return ANNOTATED.get(word, PHYSICAL.get(physical, physical))


class _Message:
    """Recursive descent over the tokens of a Parquet message text."""

    def __init__(self, text: str):
        self.tokens, self.at = _TOKEN.findall(text), 0

    def take(self, want: str | None = None) -> str:
        token = self.tokens[self.at]
        if want is not None and token != want:
            raise ValueError(f"{want} expected, {token} found")
        self.at += 1
        return token

    def peek(self) -> str:
        return self.tokens[self.at]

    def block(self) -> list[tuple]:
        self.take("{")
        out = []
        while self.peek() != "}":
            out.append(self.entry())
        self.take("}")
        return out

    def entry(self) -> tuple:
        """(repetition, physical, name, annotation, id, entries)"""
        repetition = self.take()
        if repetition not in ("optional", "required", "repeated"):
            raise ValueError(repetition)
        physical, name = self.take().partition("(")[0], self.take()
        note = ident = None
        if self.peek().startswith("("):
            note = self.take()[1:-1].strip()
        if self.peek() == "=":
            self.take()
            ident = int(self.take())
        if physical == "group":
            return repetition, physical, name, note, ident, self.block()
        self.take(";")
        return repetition, physical, name, note, ident, None


def _message_type(entry: tuple, whole: bool = True) -> tuple[str, list[Field] | None]:
    repetition, physical, name, note, _, inner = entry
    if whole and repetition == "repeated":
        t, fields = _message_type(entry, False)
        return f"array<{t if fields is None else _flat(fields)}>", None
    if inner is None:
        return _annotation(physical, note), None
    if note in ("LIST",) and len(inner) == 1 and inner[0][0] == "repeated":
        item = inner[0]
        element = item
        if item[5] is not None and len(item[5]) == 1 and item[2] not in ("array", f"{name}_tuple"):
            element = item[5][0]
        t, fields = _message_type(element, element is not item)
        return f"array<{t if fields is None else _flat(fields)}>", None
    if note in ("MAP", "MAP_KEY_VALUE") and len(inner) == 1 and inner[0][5] and len(inner[0][5]) == 2:
        parts = [_message_type(x) for x in inner[0][5]]
        return "map<" + ",".join(t if fields is None else _flat(fields) for t, fields in parts) + ">", None
    return "struct", _message_fields(inner)


def _message_fields(entries: list[tuple]) -> list[Field]:
    out = []
    for x in entries:
        kind, inner = _message_type(x)
        out.append(Field(x[2], kind, x[4], None, inner))
    return out


def read_message_schema(text: str | None) -> list[Field] | None:
    """Fields of a Parquet message text; None where it can't be read."""
    if not text or not text.strip():
        return None
    try:
        m = _Message(text)
        m.take("message")
        while m.peek() != "{":
            m.take()
        return _message_fields(m.block())
    except (ValueError, IndexError, KeyError, RecursionError):
        return None


def _lend_ids(fields: list[Field], other: list[Field]) -> None:
    by_name = {f.name: f for f in other}
    for f in fields:
        o = by_name.get(f.name)
        if o is not None:
            if f.id is None:
                f.id = o.id
            if f.inner is not None and o.inner is not None:
                _lend_ids(f.inner, o.inner)


def declared_fields(file_schema: str | None, sql_schema: str | None) -> list[Field]:
    """Fields of a file: of ``sql_schema``, with missing ids from ``file_schema``; of
    ``file_schema`` where the former is no struct with fields; none if neither is."""
    message = read_message_schema(file_schema)
    fields = read_json_schema(sql_schema)
    if fields is None:
        return message or []
    _lend_ids(fields, message or [])
    return fields


def flatten(fields: list[Field], outer: tuple[str, ...] = ()) -> list[dict]:
    """Fields as flat entries; ``outer`` and ``key`` hold the ids beside the names,
    so that equal keys mean the same field in an unchanged place."""
    out = []
    for f in fields:
        step = f.name + "\x1f" + ("" if f.id is None else str(f.id))
        out.append({"outer": list(outer), "step": step, "name": f.name, "type": f.type, "id": f.id, "former": f.former})
        if f.inner is not None:
            out += flatten(f.inner, (*outer, step))
    return out


def signature(entries: list[dict]) -> str:
    """A 128-bit digest of the fields, whatever their order."""
    whole = sorted(json.dumps([e["outer"], e["step"], e["type"], e["former"]]) for e in entries)
    return hashlib.blake2b("\n".join(whole).encode(), digest_size=16).hexdigest()


def match_fields(gone: list[dict], come: list[dict]) -> tuple[list[tuple], list[dict], list[dict]]:
    """Pair the fields that one file had (``gone``) with those the next has
    (``come``) at one level: by id; then by name, where at least one has no id;
    then by former name, where at least one has no id. Ties go by name."""
    gone, come = (sorted(x, key=lambda f: (f["name"], f["step"])) for x in (gone, come))
    pairs = []

    def pair(same) -> None:
        nonlocal gone, come
        left = []
        for c in come:
            g = next((g for g in gone if same(g, c)), None)
            if g is None:
                left.append(c)
            else:
                gone = [x for x in gone if x is not g]
                pairs.append((g, c))
        come = left

    one_free = lambda g, c: g["id"] is None or c["id"] is None
    pair(lambda g, c: g["id"] is not None and g["id"] == c["id"])
    pair(lambda g, c: g["name"] == c["name"] and one_free(g, c))
    pair(lambda g, c: c["former"] is not None and c["former"] == g["name"] and one_free(g, c))
    return pairs, gone, come


def classify(ended: list[dict], started: list[dict]) -> list[tuple[str, str]]:
    """Turn the fields that ended before a file and those that started with it into
    ``(field_name, change_kind)``. Fields that run on unchanged appear in neither
    list and stand for themselves, as outer fields too."""
    found: list[tuple[str, str]] = []
    levels: dict[tuple, tuple[list, list]] = {}
    for side, fields in ((0, ended), (1, started)):
        for f in fields:
            levels.setdefault(tuple(f["outer"]), ([], []))[side].append(f)
    #: earlier place of a struct -> its later place, for structs that stay structs
    moved: dict[tuple, tuple] = {}
    dead_gone, dead_come = set(), set()
    merged: dict[tuple, tuple[list, list]] = {}

    def later(place: tuple) -> tuple | None:
        """Where the fields of an earlier struct are to be looked for."""
        for n in range(len(place), 0, -1):
            if place[:n] in dead_gone:
                return None
        at: tuple = ()
        for n in range(1, len(place) + 1):
            at = moved.get(place[:n], (*at, place[n - 1]))
        return at

    for depth in range(1 + max((len(p) for p in levels), default=0)):
        merged.clear()
        for place, (gone, come) in levels.items():
            if len(place) != depth:
                continue
            if gone and (to := later(place)) is not None:
                merged.setdefault(to, ([], []))[0].extend(gone)
            if come and not any(place[:n] in dead_come for n in range(1, depth + 1)):
                merged.setdefault(place, ([], []))[1].extend(come)
        for place, (gone, come) in merged.items():
            pairs, removed, added = match_fields(gone, come)
            prefix = "".join(x.split("\x1f")[0] + "." for x in place)
            for g, c in pairs:
                was, now = (*g["outer"], g["step"]), (*c["outer"], c["step"])
                if g["name"] != c["name"]:
                    found.append((prefix + c["name"], "renamed"))
                if g["type"] != c["type"]:
                    found.append((prefix + c["name"], "type_changed"))
                if g["type"] == c["type"] == "struct":
                    moved[was] = now
                else:
                    dead_gone.add(was)
                    dead_come.add(now)
            for g in removed:
                found.append((prefix + g["name"], "removed"))
                dead_gone.add((*g["outer"], g["step"]))
            for c in added:
                found.append((prefix + c["name"], "added"))
                dead_come.add((*c["outer"], c["step"]))
    return found
