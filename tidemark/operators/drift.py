"""Problem 2: JSON schemas that drift between the files of a writer.

1. Every file gets a schema tree (paths with the JSON types of their values, items of
   arrays as a node ``[]``) by one pass with map-side aggregation.
2. Consecutive trees are compared. Paths gone and paths new are the candidates of renames
   and moves; the evidence is gathered only for them, from the records sent in both files
   (equal values everywhere, at least one of them present), by counting equal digests.
3. A minimum-cost edit script maps one tree onto the other: the tree edit distance in which
   a node is mapped only together with its parent and the children of two mapped nodes are
   assigned at least cost. Keeping a name is free, a rename costs 1, a deletion or addition 1
   per node. A rename needs evidence: equal values of the node, or of a node kept below it.
   Of what is left, subtrees with equal values under other parents are moved for 1.5, the
   largest first. Among equally cheap scripts one is chosen by the names.
4. The scripts of a writer follow each other: a name in a file is carried through the later
   renames to the name its field has at last. These carries, by writer and range of files,
   are compiled to one typed projection of all rows.

Defined results: rows without readable JSON object are ignored; a file without any
readable row has no schema and is compared with nothing; a key whose values are all
null counts as present with no type; nulls and absent values are equal; repeated rows
of a record count once; the first file of a writer (or one after a gap) has no changes.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

_TYPE = {str: "string", int: "number", float: "number", bool: "boolean", dict: "object", list: "array"}
#: A path joins the keys on the way with this character, which JSON text cannot hold unescaped.
SEP = "\u001f"
ITEM = "[]"
RENAME, MOVE = 1.0, 1.5
#: Rows of a table by file that are broadcast at most.
MAX_FILES = 20_000


def _reject(constant: str) -> None:
    raise ValueError(f"{constant} is not JSON")


def _parse(text: str | None) -> dict | None:
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _below(path: str, item: object) -> list[tuple[str, object]]:
    head = path + SEP if path else ""
    if isinstance(item, dict):
        return [(head + key, value) for key, value in item.items()]
    return [(head + ITEM, value) for value in item] if isinstance(item, list) else []


def _paths(value: dict, depth: int | None) -> Iterator[tuple[str, str | None]]:
    """Every node below the root with its type, down to ``depth`` (None: all)."""
    todo = _below("", value)
    while todo:
        path, item = todo.pop()
        yield path, None if item is None else _TYPE[type(item)]
        if depth is None or path.count(SEP) + 1 < depth:
            todo += _below(path, item)


def _values_at(value: dict, wanted: set[str], ways: set[str]) -> dict[str, list]:
    """The values at the wanted paths in their order; ``ways`` holds the paths above them."""
    out: dict[str, list] = {}
    todo = _below("", value)[::-1]
    while todo:
        path, item = todo.pop()
        if item is not None and path in wanted:
            out.setdefault(path, []).append(item)
        if path in ways:
            todo += _below(path, item)[::-1]
    return out


def _digest(value: object) -> int:
    text = json.dumps(value, sort_keys=True, ensure_ascii=False)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def file_schemas(df: DataFrame, file_keys: list[str], payload: str, depth: int | None = None) -> DataFrame:
    """One row per file and path: ``path``, ``types`` (sorted, of non-null values)."""
    source = df.select(*file_keys, F.col(payload).alias("payload"))
    fields = [f for f in source.schema.fields if f.name in file_keys]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", path string, type string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, None] = {}
            columns = [batch.column(i).to_pylist() for i in range(len(file_keys) + 1)]
            for *keys, text in zip(*columns, strict=True):
                value = _parse(text)
                if value is not None:
                    seen[(*keys, "", None)] = None
                    for path, kind in _paths(value, depth):
                        seen[(*keys, path, kind)] = None
            rows = list(zip(*seen, strict=True)) if seen else [[] for _ in range(len(file_keys) + 2)]
            kinds = [batch.schema.field(i).type for i in range(len(file_keys))] + [pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(r), type=k) for r, k in zip(rows, kinds, strict=True)], names=[*file_keys, "path", "type"])

    pairs = source.mapInArrow(run, ddl)
    return pairs.groupBy(*file_keys, "path").agg(F.array_sort(F.collect_set("type")).alias("types"))


def _assign(worth: dict[tuple[str, str], float]) -> dict[str, str]:
    """The pairs of the largest sum (shortest augmenting paths over potentials)."""
    rows, cols = sorted({a for a, _ in worth}), sorted({b for _, b in worth})
    if not worth:
        return {}
    turned = len(rows) > len(cols)
    if turned:
        rows, cols = cols, rows
    top = max(worth.values())
    cost = [[top - worth.get((c, r) if turned else (r, c), 0.0) for c in cols] for r in rows]
    n, m = len(rows), len(cols)
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, used, way = [float("inf")] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while match[at]:
            used[at] = True
            row, step, after = match[at], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[row - 1][j - 1] - u[row] - v[j]
                    if now < least[j]:
                        least[j], way[j] = now, at
                    if least[j] < step:
                        step, after = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = after
        while at:
            match[at] = match[way[at]]
            at = way[at]
    pairs = {(rows[match[j] - 1], cols[j - 1]) for j in range(1, m + 1) if match[j]}
    return dict(sorted(p for p in ({(b, a) for a, b in pairs} if turned else pairs) if worth.get(p, 0.0) > 0))


class _Tree:
    def __init__(self, nodes: dict[str, list[str]]) -> None:
        self.types = nodes
        self.children: dict[str, dict[str, str]] = defaultdict(dict)
        for path in nodes:
            head, _, name = path.rpartition(SEP)
            self.children[head][name] = path

    def below(self, path: str) -> list[str]:
        """The subtree of a node, itself first."""
        out, todo = [], [path]
        while todo:
            out.append(todo.pop())
            todo += self.children[out[-1]].values() if out[-1] in self.children else ()
        return out


def edit_script(old: dict[str, list[str]], new: dict[str, list[str]], same: set[tuple[str, str]]) -> list[tuple[str, str, str]]:
    """The minimum-cost script that turns the tree ``old`` into ``new`` (path -> types),
    where ``same`` holds the pairs of gone and new paths with equal values."""
    x, y = _Tree(old), _Tree(new)
    known: dict[tuple[str, str], tuple[float, bool, list[tuple[str, str, str]]]] = {}

    def mapped(a: str, b: str) -> tuple[float, bool, list[tuple[str, str, str]]]:
        """Cost and script below two mapped nodes, and whether a node below keeps its values."""
        if (a, b) in known:
            return known[a, b]
        left, right = x.children.get(a, {}), y.children.get(b, {})
        cost, kept, script = 0.0, False, []
        for name in sorted(left.keys() & right.keys()):
            p, q = left[name], right[name]
            if old[p] and new[q] and sorted(old[p]) != sorted(new[q]):
                script.append(("retyped", p, "" if p == q else q))
            more, held, below = mapped(p, q)
            cost, kept, script = cost + more, kept or held or (p, q) in same, script + below
        gone, fresh = sorted(left.keys() - right.keys()), sorted(right.keys() - left.keys())
        size = {n: len(x.below(left[n])) for n in gone} | {n: len(y.below(right[n])) for n in fresh}
        worth = {}
        for i in gone:
            for j in fresh:
                more, held, _ = mapped(left[i], right[j])
                if held or (left[i], right[j]) in same:
                    worth[i, j] = size[i] + size[j] - RENAME - more
        pairs = _assign({k: w for k, w in worth.items() if w > 0})
        for i, j in pairs.items():
            more, held, below = mapped(left[i], right[j])
            cost, kept, script = cost + RENAME + more, True, [*script, ("renamed", left[i], right[j]), *below]
        for i in (n for n in gone if n not in pairs):
            cost, script = cost + size[i], [*script, ("removed", left[i], "")]
        for j in (n for n in fresh if n not in pairs.values()):
            cost, script = cost + size[j], [*script, ("added", right[j], "")]
        known[a, b] = cost, kept, script
        return known[a, b]

    script = mapped("", "")[2]
    out = [p for c, r, _ in script if c == "removed" for p in x.below(r)]
    into = [p for c, r, _ in script if c == "added" for p in y.below(r)]
    worth = sorted((-(len(x.below(p)) + len(y.below(q)) - MOVE - mapped(p, q)[0]), p, q) for p in out for q in into if (p, q) in same)
    taken: set[tuple[int, str]] = set()
    for gain, p, q in worth:
        if gain < 0 and not taken & {*((0, n) for n in x.below(p)), *((1, n) for n in y.below(q))}:
            taken |= {*((0, n) for n in x.below(p)), *((1, n) for n in y.below(q))}
            script = [s for s in script if s not in (("removed", p, ""), ("added", q, ""))] + [("moved", p, q), *mapped(p, q)[2]]
    return sorted(script)


def _by_file(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a (written) table that has few rows per file: broadcast if it is small."""
    few = small.limit(MAX_FILES + 1).count() <= MAX_FILES
    return big.join(F.broadcast(small) if few else small, keys)


def changes(df: DataFrame, group: str, seq: str, record: str, payload: str, depth: int | None = None) -> DataFrame:
    """One row per change of a file against the same writer's file before:
    ``group``, ``seq``, ``change``, ``field``, ``new_field`` (paths joined with a dot)."""
    base = df.select(F.col(group).alias("g"), F.col(seq).cast("int").alias("f"), F.col(record).cast("string").alias("r"), F.col(payload).alias("payload"))
    base = base.where(F.col("g").isNotNull() & F.col("f").isNotNull())
    return _changes(base, _trees(base, depth)).select(F.col("g").alias(group), F.col("f").alias(seq), "change", "field", "new_field", "depth")


def _trees(base: DataFrame, depth: int | None) -> DataFrame:
    return written(file_schemas(base, ["g", "f"], "payload", depth).groupBy("g", "f").agg(F.collect_list(F.struct("path", "types")).alias("tree")), "trees")


def _changes(base: DataFrame, trees: DataFrame) -> DataFrame:
    old = trees.select("g", (F.col("f") + 1).alias("f"), F.col("tree").alias("old"))
    pairs = trees.join(old, ["g", "f"]).withColumnRenamed("tree", "new")
    path = lambda c: F.transform(c, lambda x: x["path"])
    pairs = pairs.withColumns({"gone": F.array_except(path("old"), path("new")), "fresh": F.array_except(path("new"), path("old"))})
    pairs = written(pairs.where(F.array_sort("old") != F.array_sort("new")), "tree-pairs")
    candidates = pairs.where((F.size("gone") > 0) & (F.size("fresh") > 0)).select("g", "f", "gone", "fresh")
    wanted = candidates.select("g", "f", F.col("fresh").alias("names"), F.lit(1).alias("side")).unionAll(
        candidates.select("g", F.col("f") - 1, F.col("gone"), F.lit(0))
    )
    rows = _by_file(base.where("r is not null"), wanted, ["g", "f"]).select("g", (F.col("f") + 1 - F.col("side")).alias("f"), "side", "r", "payload", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[set, set]] = {}
        for batch in batches:
            at, paths, digests = [], [], []
            for i, (text, names) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                value = _parse(text)
                if value is None:
                    continue
                names = tuple(names)
                if names not in known:
                    parts = [n.split(SEP) for n in names]
                    known[names] = set(names), {SEP.join(p[:k]) for p in parts for k in range(1, len(p))}
                at.append(i)
                paths.append("")  # the record is there, whatever it holds
                digests.append(0)
                for p, v in _values_at(value, *known[names]).items():
                    at.append(i)
                    paths.append(p)
                    digests.append(_digest(v))
            small = batch.select(["g", "f", "side", "r"]).take(pa.array(at, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([*small.columns, pa.array(paths, type=pa.string()), pa.array(digests, type=pa.int64())], names=["g", "f", "side", "r", "path", "digest"])

    values = rows.mapInArrow(run, "g string, f int, side int, r string, path string, digest bigint")
    # A record that was sent more than once in a file holds the set of its values.
    held = values.groupBy("g", "f", "r").agg(F.collect_set(F.struct("side", "path", "digest")).alias("cells"))
    side = lambda k: F.filter("cells", lambda c: (c["side"] == k) & (c["path"] != ""))
    there = lambda k: F.exists("cells", lambda c: c["side"] == k)
    sent = held.where(there(0) & there(1)).select("g", "f", side(0).alias("a"), side(1).alias("b"))
    of = lambda arr, p: F.array_sort(F.transform(F.filter(arr, lambda c: c["path"] == p), lambda c: c["digest"]))
    none = F.lit(None).cast("string")
    names = lambda arr: F.array_distinct(F.transform(arr, lambda c: c["path"]))
    equal = F.flatten(
        F.transform(
            "a",
            lambda x: F.transform(
                F.filter("b", lambda y: (y["digest"] == x["digest"]) & (of(F.col("a"), x["path"]) == of(F.col("b"), y["path"]))), lambda y: F.struct(x["path"].alias("o"), y["path"].alias("n"))
            ),
        )
    )
    told = F.concat(F.transform(names("a"), lambda p: F.struct(p.alias("o"), none.alias("n"))), F.transform(names("b"), lambda p: F.struct(none.alias("o"), p.alias("n"))), F.array_distinct(equal))
    counts = sent.select("g", "f", F.explode(told).alias("t")).groupBy("g", "f", "t.o", "t.n").agg(F.count("*").alias("k"))
    evidence = counts.groupBy("g", "f").agg(F.collect_list(F.struct("o", "n", "k")).alias("counts"))
    compared = pairs.select("g", "f", "old", "new").join(evidence, ["g", "f"], "left")

    def script(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                tree = [{x["path"]: x["types"] for x in row[k] if x["path"]} for k in ("old", "new")]
                seen = {(x["o"], x["n"]): x["k"] for x in row["counts"] or ()}
                same = {(o, n) for (o, n), k in seen.items() if o is not None and n is not None and k == seen[o, None] == seen[None, n]}
                out += [(row["g"], row["f"], c, a.replace(SEP, "."), b.replace(SEP, "."), a.count(SEP) + 1) for c, a, b in edit_script(*tree, same)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds, strict=True)], names=["g", "f", "change", "field", "new_field", "depth"])

    return compared.mapInArrow(script, "g string, f int, change string, field string, new_field string, depth int")


#: Most columns a unified table may have.
MAX_COLUMNS = 20_000


def _carried(found: DataFrame) -> DataFrame:
    """``g`` and its ``carries``: in the files ``lo`` to ``hi`` the field ``name`` is the one called ``final`` at last."""

    def follow(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["f"], r["change"] != "renamed", r["field"]))
        final: dict[str, list] = {}  # name now -> the carries that end there
        begun: dict[str, int] = {}
        done: list[dict] = []
        for f in sorted({r["f"] for r in rows}):
            now = [r for r in rows if r["f"] == f]
            moved: dict[str, list] = {}
            for r in now:
                carries = final.pop(r["field"], [])
                if r["change"] == "renamed":
                    moved[r["new_field"]] = [*carries, {"name": r["field"], "lo": begun.pop(r["field"], None), "hi": f - 1}]
                else:
                    done += [c | {"final": r["field"]} for c in carries]
                    begun[r["field"]] = f  # should the name come again, it is another field
            final |= moved
            begun |= {n: f for n in moved}
        done += [c | {"final": n} for n, carries in final.items() for c in carries]
        g = table.column("g")[0].as_py()
        return pa.Table.from_pylist([{"g": g, "carries": [{"name": c["name"], "lo": c["lo"], "hi": c["hi"], "final": c["final"]} for c in done if c["name"] != c["final"]]}], schema=schema)

    cell = pa.struct([("name", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("final", pa.string())])
    schema = pa.schema([("g", pa.string()), ("carries", pa.list_(cell))])
    steps = found.where("depth = 1 and change in ('renamed', 'removed')").select("g", "f", "change", "field", "new_field")
    return steps.groupBy("g").applyInArrow(follow, "g string, carries array<struct<name:string,lo:int,hi:int,final:string>>")


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() and i and name[i - 1].islower() else c.lower() for i, c in enumerate(name))


def _typed(text: Column, kind: str) -> Column:
    if kind == "boolean":
        return text.try_cast("boolean")
    # More digits than a double holds stay text.
    return F.when(F.length(F.regexp_replace(text, r"[^0-9]", "")) <= 15, text.try_cast("double")) if kind == "number" else text


def unify(df: DataFrame, group: str, seq: str, record: str, payload: str, prefix: str = "") -> DataFrame:
    """Every row of ``df`` under one set of columns: a typed column per top-level field, called
    like its last name in lower snake case (text where types differ, JSON text for objects and
    arrays), and ``<prefix>rest``, a map of the values that found no place: the second of two
    that are one field, or a number of more digits than a double holds. No value is lost.
    A field that would clash with an existing column gets a trailing underscore."""
    base = df.select(F.col(group).cast("string").alias("g"), F.col(seq).cast("int").alias("f"), F.col(record).cast("string").alias("r"), F.col(payload).alias("payload"))
    base = base.where(F.col("g").isNotNull() & F.col("f").isNotNull())
    trees = _trees(base, 1)
    carried = written(_carried(_changes(base, trees)), "carries")
    names = trees.select("g", "f", F.inline("tree")).where("path <> ''").join(carried, "g", "left")
    final = lambda name, f: F.coalesce(
        F.get(F.transform(F.filter("carries", lambda c: (c["name"] == name) & (f <= c["hi"]) & (c["lo"].isNull() | (f >= c["lo"]))), lambda c: c["final"]), F.lit(0)), name
    )
    spread = names.select(final(F.col("path"), F.col("f")).alias("name"), F.explode_outer("types").alias("type")).groupBy("name").agg(F.count("*").alias("n"), F.collect_set("type").alias("types"))
    fields = spread.orderBy("name").limit(MAX_COLUMNS + 1).collect()
    if len(fields) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} fields; no table has so many columns")
    columns: dict[str, dict] = {}
    for r in sorted(fields, key=lambda r: (-r["n"], r["name"])):
        column = columns.setdefault(_snake(r["name"]), {"names": [], "types": set()})
        column["names"].append(r["name"])
        column["types"] |= set(r["types"])
    taken = {c.lower() for c in [*df.columns, f"{prefix}rest"]}
    final_name = {}
    for name in sorted(columns):
        final_name[name] = prefix + name
        while final_name[name].lower() in taken:
            final_name[name] += "_"
        taken.add(final_name[name].lower())

    keyed = df.withColumns({"__g": F.col(group).cast("string"), "__f": F.col(seq).cast("int")})
    few = carried.limit(MAX_FILES + 1).count() <= MAX_FILES
    table = carried.select(F.col("g").alias("__g"), "carries")
    keyed = keyed.join(F.broadcast(table) if few else table, "__g", "left")
    entries = F.transform(
        F.map_entries(F.from_json(F.col(payload), "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), final(e["key"], F.col("__f")).alias("final"), e["value"].alias("value"))
    )
    # A generator over one row ends the inlining: the text is read once, every field is looked
    # up once, and what found a place is not worked out again for every value.
    kept = [F.col(f"`{c}`") for c in df.columns]
    stop = lambda d, more, **made: d.select(*kept, *more, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
    out = stop(keyed, [], __cells=F.filter(entries, lambda e: e["value"].isNotNull()))
    called = lambda name: F.filter("__cells", lambda e: e["final"] == name)
    order = sorted(columns)
    firsts = {f"__c{i}": F.get(F.concat(*[called(n) for n in columns[name]["names"]]), F.lit(0)) for i, name in enumerate(order)}
    if firsts:
        out = stop(out, [F.col("__cells")], **firsts)
    values = {}
    for i, name in enumerate(order):
        kinds = columns[name]["types"]
        values[f"__v{i}"] = _typed(F.col(f"__c{i}")["value"], next(iter(kinds)) if len(kinds) == 1 else "string")
    placed = F.array_compact(F.array(*[F.when(v.isNotNull(), F.col(f"__c{i}")["key"]) for i, v in enumerate(values.values())])) if values else F.array().cast("array<string>")
    out = stop(out, [F.col("__cells")], **values, __placed=placed)
    rest = F.map_from_entries(F.transform(F.filter("__cells", lambda e: ~F.array_contains("__placed", e["key"])), lambda e: F.struct(e["key"], e["value"])))
    cells = [F.col(f"__v{i}").alias(final_name[name]) for i, name in enumerate(order)]
    return out.select(*kept, *cells, F.when(F.size("__cells") > 0, rest).alias(f"{prefix}rest"))
