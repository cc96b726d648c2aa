"""Flat, linked tables from nested records.

Each record is read as a stream of tokens into triples: the path of a value, with the positions of all lists above it,
and the value. Paths are grouped by their nearest repeated ancestor, and triples of (record, group, ordinal) are pivoted into
one row per element; the ordinal names the element and all its parents ("2.0" is child 0 of element 2), so a child's parent
is its ordinal without the last part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLES = "rec_id long, doc int, grp string, ordinal string, leaf string, value string"
#: Levels of nesting that are read; a deeper record counts as unreadable.
LEVELS = 4_000
#: How often a text in a text is read again, where records are wrapped as texts.
WRAPS = 4
#: SQL: the value holds more than white space.
SOLID = r"{0} rlike '[^\\s\\x1c-\\x1f\\x85\\p{{Z}}]'"

TOKEN = re.compile(r'[ \t\r\n]*+(?:(?P<mark>[{}\[\],:])|"(?P<text>[^"\\]*+(?:\\.[^"\\]*+)*+)"|(?P<word>-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null|NaN|-?Infinity))', re.S)


@dataclass(frozen=True)
class Layout:
    """What is repeated in a record. All names are compared in lower case without underscores.

    arrays: path of a repeated ancestor -> name of its group; a single value in its place counts as its element 0.
    nested: name of a key below a repeated ancestor that holds further elements of the same group.
    maps: path of a map -> name of its group; its keys are the ordinals. A list of objects with a name key stands for
    a map too.
    """

    arrays: dict[str, str] = field(default_factory=dict)
    nested: dict[str, str] = field(default_factory=dict)
    maps: dict[str, str] = field(default_factory=dict)

    def tops(self) -> set[str]:
        return {p.partition(".")[0] for p in (*self.arrays, *self.maps)}


def plain(name: str) -> str:
    return name.replace("_", "").lower()


def unquoted(text: str) -> str:
    return json.loads(f'"{text}"', strict=False) if "\\" in text else text


def start_of(text: str) -> int:
    """Where the outermost value of a text with other words around it begins; -1 without one. It may be a quoted text of a value."""
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return -1
    at = min(starts)
    lead = text[:at].rstrip()
    if lead.endswith('"'):
        return lead.rfind('"')
    if text[at + 1 : at + 200].lstrip(" \\nrt\n\r\t").startswith('\\"'):
        return text.rfind('"', 0, at)
    return at


def events(text: str, at: int = 0) -> list[tuple[tuple[str | int, ...], str | None, bool]] | None:
    """(path, value, whether it is a text) of every scalar of the value that begins at a place of text, in order.

    A path holds the keys and positions that lead to the scalar; null has the value None. The result is None if the value is
    not well formed, cut off or nested too deeply. What follows the value is not looked at. Nothing recurses.
    """
    out: list[tuple[tuple[str | int, ...], str | None, bool]] = []
    path: list[str | int] = []
    key, want = None, "value"
    while True:
        m = TOKEN.match(text, at)
        if m is None:
            return None
        at = m.end()
        kind, token = m.lastgroup, m[m.lastgroup]
        if kind == "mark" and token in "]}":
            if not path or want not in ("more", "first") or (token == "]") != isinstance(path[-1], int):
                return None
            path.pop()
            if not path:
                return out
            want = "more"
        elif kind == "mark" and token == ",":
            if want != "more":
                return None
            if isinstance(path[-1], int):
                path[-1] += 1
                want = "value"
            else:
                want = "key"
        elif kind == "mark" and token == ":":
            if want != "colon":
                return None
            path[-1], want = key, "value"
        elif kind == "text" and (want == "key" or want == "first" and not isinstance(path[-1], int)):
            try:
                key, want = unquoted(token), "colon"
            except ValueError:
                return None
        elif want == "value" or want == "first" and isinstance(path[-1], int):
            if kind == "mark":
                if len(path) >= LEVELS:
                    return None
                path.append(0 if token == "[" else "")
                want = "first"
                continue
            try:
                out.append((tuple(path), unquoted(token) if kind == "text" else None if token == "null" else token, kind == "text"))
            except ValueError:
                return None
            want = "more"
            if not path:
                return out
        else:
            return None


def records(text: str | None, tops: set[str]) -> Iterator[list[tuple[tuple[str | int, ...], str | None]]]:
    """The scalars of every record in a text, paths from the record on. A record is the outermost object that has one of the keys.

    Objects and lists around records are looked through, and so are texts that hold such a value themselves.
    """
    todo = [(text, 0)]
    while todo:
        body, depth = todo.pop(0)
        at = start_of(body) if isinstance(body, str) and depth <= WRAPS else -1
        found = events(body, at) if at >= 0 else None
        if not found:
            continue
        if found[0][0] == ():
            todo.append((found[0][1], depth + 1))
            continue
        known: dict[tuple[str | int, ...], bool] = {}
        for path, _, _ in found:
            for k, part in enumerate(path):
                if isinstance(part, str) and plain(part) in tops:
                    known[path[:k]] = True
                    break
        roots: dict[tuple[str | int, ...], list] = {}
        for path, value, is_text in found:
            root = next((path[:k] for k in range(len(path)) if path[:k] in known), None) if known else None
            if root is not None:
                roots.setdefault(root, []).append((path[len(root) :], value))
            elif is_text and "{" in value:
                todo.append((value, depth + 1))
        yield from roots.values()


def shown(parts: tuple[str | int, ...], first: str = "") -> str:
    out = first
    for p in parts:
        out += f"[{p}]" if isinstance(p, int) else f".{plain(p)}" if out else plain(p)
    return out or "value"


def element(rest: tuple[str | int, ...], group: str, nested: dict[str, str]) -> tuple[list[str], list[str], str]:
    """Of a value below a repeated ancestor: positions of the elements that it is nested in, outermost first, the keys between them, its leaf."""
    places, through, k = [], [], 0
    while True:
        if k < len(rest) and isinstance(rest[k], int):
            places.append(str(rest[k]))
            k += 1
        else:
            places.append("0")
        if k == len(rest) or isinstance(rest[k], int) or nested.get(plain(rest[k])) != group:
            return places, through, shown(rest[k:])
        through.append(plain(rest[k]))
        k += 1


def entry(rest: tuple[str | int, ...]) -> tuple[str, str] | None:
    """(ordinal, leaf) of a value of a map: its key, with the inner key where the value is an object."""
    if not rest or not isinstance(rest[0], str):
        return None
    inner = len(rest) > 1 and isinstance(rest[1], str)
    return (f"{rest[0]}.{rest[1]}", shown(rest[2:], "value")) if inner else (rest[0], shown(rest[1:], "value"))


def listed_entries(found: list[tuple[tuple[str | int, ...], str | None]]) -> Iterator[tuple[tuple[str | int, ...], str | None]]:
    """Values of a list of objects that stands for a map, with paths as in a map: an object's name leads to its value."""
    objects: dict[int, list] = {}
    for rest, value in found:
        if len(rest) > 1 and isinstance(rest[1], str):
            objects.setdefault(rest[0], []).append((rest[1:], value))
    for parts in objects.values():
        names = {plain(r[0]): v for r, v in parts if len(r) == 1 and plain(r[0]) in ("name", "key")}
        name = names.get("name", names.get("key"))
        if name is None:
            yield from parts
            continue
        keys = [plain(r[0]) for r, _ in parts if plain(r[0]) not in ("name", "key")]
        chosen = "value" if "value" in keys else keys[0] if keys else None
        yield from (((name, *r[1:]), v) for r, v in parts if plain(r[0]) == chosen)


def triples(text: str | None, layout: Layout) -> Iterator[tuple[int, str, str, str, str]]:
    """(number of the record, group, ordinal, leaf, value) of all values below repeated ancestors that are neither null nor blank."""
    for doc, found in enumerate(records(text, layout.tops())):
        lists: dict[tuple[str, tuple[str | int, ...]], list] = {}
        marked = set()
        for path, value in found:
            keys: list[str] = []
            for k, part in enumerate(path):
                if isinstance(part, int) or k > 8:
                    break
                keys.append(plain(part))
                name = ".".join(keys)
                rest = path[k + 1 :]
                if name in layout.arrays and value is not None and value.strip():
                    group = layout.arrays[name]
                    places, through, leaf = element(rest, group, layout.nested)
                    for n in range(len(through), 0, -1):
                        parent = ".".join(places[:n])
                        if (group, parent) in marked:
                            break
                        marked.add((group, parent))
                        yield doc, group, parent, through[n - 1], "nested"
                    yield doc, group, ".".join(places), leaf, value
                elif name in layout.maps:
                    group = layout.maps[name]
                    if rest and isinstance(rest[0], int):
                        lists.setdefault((group, path[: k + 1]), []).append((rest, value))
                    elif value is not None and value.strip() and (got := entry(rest)):
                        yield doc, group, *got, value
        for (group, _), parts in lists.items():
            for rest, value in listed_entries(parts):
                if value is not None and value.strip() and (got := entry(rest)):
                    yield doc, group, *got, value


def parse_triples(bodies: DataFrame, layout: Layout) -> DataFrame:
    """bodies (rec_id, body) with body a text that holds JSON -> triples; unreadable and null bodies give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *t) for i, body in zip(batch["rec_id"], batch["body"]) for t in triples(body, layout)]
            out = pd.DataFrame(rows, columns=["rec_id", "doc", "grp", "ordinal", "leaf", "value"])
            out["rec_id"] = out["rec_id"].astype("Int64")
            yield out

    return bodies.select("rec_id", "body").mapInPandas(run, TRIPLES)


def pivoted(found: DataFrame, columns: list[str], keys: tuple[str, ...] = ("src", "rec_id")) -> DataFrame:
    """One row per element of every group: keys, doc, grp, ordinal, and the named leaves.

    Elements without any value give no row. A leaf that holds several values (a list in place of one) gets them joined
    by line feeds in their order. Repeated records give each element once. Without columns it is the list of elements.
    """
    top = F.regexp_replace("leaf", r"[\[.].*$", "")
    order = F.regexp_replace("leaf", r"(\d+)", "0000000$1")
    values = found.select(*keys, "doc", "grp", "ordinal", top.alias("col"), F.struct(order.alias("leaf"), "value").alias("v"))
    joined = [F.array_join(F.transform(F.sort_array(F.collect_set(F.when(F.col("col") == c, F.col("v")))), lambda x: x["value"]), "\n").alias(c) for c in columns]
    rows = values.groupBy(*keys, "doc", "grp", "ordinal")
    return rows.agg(*joined) if joined else values.select(*keys, "doc", "grp", "ordinal").distinct()


def pivot_group(found: DataFrame, group: str, columns: list[str], keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """The table of one group: keys, doc (number of the record in its text), ordinal, parent ordinal (null at the top), position, and the named leaves."""
    flat = pivoted(found.where(F.col("grp") == group), columns, keys)
    last = F.substring_index("ordinal", ".", -1)
    return flat.select(
        *keys,
        "doc",
        "ordinal",
        F.when(F.col("ordinal").contains("."), F.regexp_replace("ordinal", r"\.[^.]*$", "")).alias("parent"),
        F.when(last.rlike(r"^\d+$"), F.expr("try_cast(substring_index(ordinal, '.', -1) as int)")).alias("position"),
        *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in columns],
    )


#: Repeated parts of extracted documents.
DOCUMENT = Layout(
    arrays={"solution.troubleshootingsteps": "step", "problem.symptoms": "symptom"},
    nested={"substeps": "step"},
    maps={"metadata.environment": "env"},
)


def document_triples(cleaned: DataFrame, groups: tuple[str, ...] = ("step", "symptom", "env")) -> DataFrame:
    """Triples of typed documents, which need no parsing: their lists and maps are exploded with their positions."""

    def leaf(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("leaf"), value.alias("value"))

    step = F.col("x")
    parts = {
        "step": (F.posexplode("solution.troubleshooting_steps").alias("ordinal", "x"), [leaf(c, step[c]) for c in ("description", "command", "result")]),
        "symptom": (F.posexplode("problem.symptoms").alias("ordinal", "x"), [leaf("value", F.col("x"))]),
        "env": (F.explode("metadata.environment").alias("ordinal", "x"), [leaf("value", F.col("x"))]),
    }
    out = None
    for group in groups:
        rows, leaves = parts[group]
        each = cleaned.select(F.col("record_id").alias("rec_id"), rows).select("rec_id", F.lit(0).alias("doc"), F.lit(group).alias("grp"), F.col("ordinal").cast("string").alias("ordinal"), F.inline(F.array(*leaves)))
        each = each.where(SOLID.format("value"))
        out = each if out is None else out.unionByName(each)
    return out


def all_triples(cleaned: DataFrame, replies: DataFrame, groups: tuple[str, ...] = ("step", "symptom", "env"), layout: Layout = DOCUMENT) -> DataFrame:
    """Triples of typed documents and of those in replies, with src."""
    wanted = Layout({k: v for k, v in layout.arrays.items() if v in groups}, {k: v for k, v in layout.nested.items() if v in groups}, {k: v for k, v in layout.maps.items() if v in groups})
    a = document_triples(cleaned, groups).withColumn("src", F.lit("cleaned_docs"))
    b = parse_triples(replies.select(F.col("reply_id").alias("rec_id"), F.col("reply").alias("body")), wanted).withColumn("src", F.lit("llm_replies"))
    return a.unionByName(b)


def child_paths(found: DataFrame) -> DataFrame:
    """src, rec_id, child, child_path of every row of the pivoted tables; distinct."""
    return pivoted(found, []).select("src", "rec_id", F.col("grp").alias("child"), F.col("ordinal").alias("child_path")).distinct()
