"""Rules as a table, evaluated over records that are rows, maps or VARIANT objects, so that the plan doesn't grow with the rules.

``compiled`` reads the rules once into trees, which json can write. ``fired_by`` evaluates all trees over each Arrow batch of records with one interpreter over numpy arrays: each field is looked up once a batch, each condition that
several rules share is evaluated once. The values and the meaning of rules are those of rule_language; conversions to numbers and texts are Spark's own, made before the batch leaves it.

Records that are maps have the fields that they have: a field is looked up by its exact name in each record. In a map of texts (and a VARIANT object, which is read as one) a text that is a number is a number as well, for
IN too, and true and false count 1 and 0. Rules go to the tasks in blocks of at most about BLOCK; a null record has no fields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import rule_language as L

BLOCK = 20_000
UNKNOWN = -1
#: A value of each record: its text (None: missing or none), number, whether it has a number, whether it is there, and whether texts and numbers of a list are compared with it.
Value = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool, bool]


def compiled(rules: DataFrame, rule: str = "rule_id", text: str = "expression") -> DataFrame:
    """rules with tree (json; null where the rule can't be read), fields (that it names) and unread (the reason)."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            out = []
            for value in array.to_pylist():
                try:
                    tree = L.parse(value or "")
                    out.append({"tree": json.dumps(tree), "fields": sorted(L._named(tree)), "unread": None})
                except L.RuleError as e:
                    out.append({"tree": None, "fields": [], "unread": str(e)})
            yield pa.array(out, pa.struct([("tree", pa.string()), ("fields", pa.list_(pa.string())), ("unread", pa.string())]))

    made = F.arrow_udf(each, "struct<tree:string,fields:array<string>,unread:string>").asNondeterministic()(F.col(text))
    return rules.withColumn("_c", made).select(*rules.columns, "_c.*")


def _tuples(node):
    return tuple(map(_tuples, node)) if isinstance(node, list) else node


class _Batch:
    """Evaluates trees over the values of a batch of records."""

    def __init__(self, n: int, values: dict[str, Value], lower: bool, compat: bool) -> None:
        self.n, self.values, self.lower, self.compat, self.known = n, values, lower, compat, {}

    def field(self, name: str) -> Value | None:
        return self.values.get(name.lower() if self.lower else name)

    def number(self, node) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and where there are any."""
        if node not in self.known:
            with np.errstate(all="ignore"):
                self.known[node] = self._number(node)
        return self.known[node]

    def _number(self, node) -> tuple[np.ndarray, np.ndarray]:
        kind = node[0]
        if kind == "number":
            return np.full(self.n, node[1]), np.ones(self.n, bool)
        if kind == "text":
            met = re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", node[1])
            return np.full(self.n, float(node[1]) if met else 0.0), np.full(self.n, bool(met))
        if kind == "field":
            v = self.field(node[1])
            return (np.zeros(self.n), np.zeros(self.n, bool)) if v is None else v[1:3]
        if kind == "call":
            args = [self.number(x) for x in node[2:]]
            if node[1] == "SUM":
                return sum(np.where(ok, v, 0.0) for v, ok in args), np.ones(self.n, bool)
            if node[1] in ("MAX", "MIN"):
                fill, pick = (-np.inf, np.fmax) if node[1] == "MAX" else (np.inf, np.fmin)
                out = args[0][0]
                if len(args) > 1:
                    out = np.where(args[0][1], args[0][0], fill)
                    for v, ok in args[1:]:
                        out = pick(out, np.where(ok, v, fill))
                return out, np.any([ok for _, ok in args], axis=0)
            one = {"CEIL": np.ceil, "ABS": np.abs, "SQRT": np.sqrt, "ROUND": lambda x: np.sign(x) * np.floor(np.abs(x) + 0.5)}.get(node[1])
            return (one(args[0][0]), args[0][1]) if one else (np.zeros(self.n), np.zeros(self.n, bool))
        (a, ok), (b, also) = self.number(node[1]), self.number(node[2])
        if kind == "/":
            return np.where(b != 0, a / np.where(b != 0, b, 1.0), 0.0), ok & also & (b != 0)
        return {"+": a + b, "-": a - b, "*": a * b}[kind], ok & also

    def text(self, node) -> tuple[np.ndarray, np.ndarray]:
        """Texts of values and which are there; a number that was worked out equals no text."""
        if node[0] == "text":
            return np.full(self.n, node[1], object), np.ones(self.n, bool)
        if node[0] == "field":
            v = self.field(node[1])
            return (np.full(self.n, None, object), np.zeros(self.n, bool)) if v is None else (v[0], v[3])
        return np.full(self.n, None, object), self.number(node)[1]

    def truth(self, node) -> np.ndarray:
        """1, 0 or UNKNOWN."""
        if node not in self.known:
            self.known[node] = self._truth(node)
        return self.known[node]

    def _truth(self, node) -> np.ndarray:
        kind, *rest = node
        if kind in ("and", "or"):
            parts, decides = np.stack([self.truth(x) for x in rest]), int(kind == "or")
            out = np.where((parts == UNKNOWN).any(0), UNKNOWN, 1 - decides)
            return np.where((parts == decides).any(0), decides, out)
        if kind == "not":
            inner = self.truth(rest[0])
            return np.where(inner == UNKNOWN, UNKNOWN, 1 - inner)
        if kind == "present":
            return self.text(rest[0])[1].astype(int)
        if kind == "attached":
            names = [rest[0], ("field", f"{rest[0][1]}_attached")] if rest[0][0] == "field" else [rest[0]]
            return np.any([self.attached(x) for x in names], axis=0).astype(int)
        if kind == "matches":
            (texts, there), find = self.text(rest[0]), re.compile(str(rest[1][1])).search
            return np.array([bool(find(t)) if ok and t is not None else UNKNOWN for t, ok in zip(texts, there, strict=True)], int)
        if kind == "in":
            return self.within(rest[0], rest[1:]).astype(int)
        return self.compare(*rest)

    def attached(self, node) -> np.ndarray:
        texts, there = self.text(node)
        value, ok = self.number(node)
        full = np.array([t is not None and t != "" for t in texts], bool)
        v = self.field(node[1]) if node[0] == "field" else None
        if v is not None and v[4] and not v[5]:  # a text, whatever it says
            return there & full
        return there & np.where(ok, value != 0, full)

    def within(self, node, listed) -> np.ndarray:
        value, ok = self.number(node)
        texts, there = self.text(node)
        v = self.field(node[1]) if node[0] == "field" else None
        as_text, as_number = (v[4], v[5]) if v is not None else (node[0] == "text", node[0] != "text")
        out = np.zeros(self.n, bool)
        for item in listed:
            if item[0] == "-" and item[1][0] == item[2][0] == "number":
                item = ("number", item[1][1] - item[2][1])
            if item[0] == "number" and as_number:
                out |= ok & (value == item[1])
            elif item[0] == "text" and as_text:
                out |= there & (texts == item[1])
        return out

    def compare(self, op: str, left, right) -> np.ndarray:
        (a, ok), (b, also) = self.number(left), self.number(right)
        both = ok & also
        same = (a == b) | (np.isnan(a) & np.isnan(b))
        less = (a < b) | (np.isnan(b) & ~np.isnan(a))
        ordered = {"=": same, "!=": ~same, "<": less, ">": ~less & ~same, "<=": less | same, ">=": ~less}[op]
        (x, there), (y, too) = self.text(left), self.text(right)
        other = np.zeros(self.n, bool)
        if op in ("=", "!=") and not both.all():
            equal = np.array([p is not None and p == q for p, q in zip(x, y, strict=True)], bool)
            other = equal if op == "=" else ~equal
        return np.where(both, ordered, np.where(there & too, other, UNKNOWN)).astype(int)

    def violated(self, node) -> np.ndarray:
        if node is None or self.compat and not L._plain(node):
            return np.zeros(self.n, bool)
        return np.ones(self.n, bool) if node[0] == "flag" else self.truth(node) == 0

    def rule(self, tree) -> np.ndarray:
        _, when, then, otherwise = tree
        if when is None:
            return self.violated(then)
        if self.compat and L._mentions(when, ("matches", "attached")):
            return self.violated(otherwise)
        holds = self.truth(when) == 1
        out = np.zeros(self.n, bool)
        if holds.any():
            out |= holds & self.violated(then)
        if otherwise is not None:
            out |= ~holds & self.violated(otherwise)
        return out


def _values(pairs: pa.StructArray, as_text: bool, as_number: bool) -> Value:
    """pairs: struct(t, n) of each record, null where the field is missing."""
    there = pairs.field("t").is_valid().to_numpy(zero_copy_only=False)
    number = pairs.field("n")
    ok = number.is_valid().to_numpy(zero_copy_only=False)
    return np.array(pairs.field("t").to_pylist(), object), number.fill_null(0.0).to_numpy(zero_copy_only=False), ok, there, as_text, as_number


def _of_maps(array: pa.MapArray, names: set[str], as_text: bool, as_number: bool) -> dict[str, Value]:
    """The named fields of each map; of a field that a record lacks nothing is there."""
    n = len(array)
    offsets = array.offsets.to_numpy()
    keys, items = array.keys.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode(), array.items.slice(offsets[0], offsets[-1] - offsets[0])
    rows = np.repeat(np.arange(n), np.diff(offsets))
    codes = keys.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[order], np.arange(len(keys.dictionary) + 1))
    texts, numbers = np.array(items.field("t").to_pylist(), object), items.field("n")
    values, ok = numbers.fill_null(0.0).to_numpy(zero_copy_only=False), numbers.is_valid().to_numpy(zero_copy_only=False)
    out = {}
    for i, name in enumerate(keys.dictionary.to_pylist()):
        if name in names:
            at = order[bounds[i] : bounds[i + 1]]
            t, v, has, there = np.full(n, None, object), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
            t[rows[at]], v[rows[at]], has[rows[at]] = texts[at], values[at], ok[at]
            there[rows[at]] = [x is not None for x in texts[at]]
            out[name] = (t, v, has, there, as_text, as_number)
    return out


def _evaluate(rules: list[tuple[str, tuple]], wide: list[tuple[str, str]] | None, text_maps: bool, compat: bool):
    names = set().union(*(L._named(tree) for _, tree in rules)) if rules else set()

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            if wide is None:
                batch = _Batch(len(array), _of_maps(array, names, text_maps, True), False, compat)
            else:
                batch = _Batch(len(array), {name: _values(array.field(i), kind == "text", kind != "text") for i, (name, kind) in enumerate(wide)}, True, compat)
            found = [(i, np.flatnonzero(batch.rule(tree))) for i, (_, tree) in enumerate(rules)]
            row = np.concatenate([r for _, r in found]) if found else np.zeros(0, int)
            which = np.repeat([i for i, _ in found], [len(r) for _, r in found]).astype(int) if found else row
            order = np.argsort(row, kind="stable")
            ids = pa.array([r for r, _ in rules], pa.string())
            yield pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(array) + 1)), pa.int32()), ids.take(pa.array(which[order])))

    return each


def _pair(value: Column, number: Column) -> Column:
    return F.struct(value.cast("string").alias("t"), number.alias("n"))


def _input(records: DataFrame, record: str | None, names: set[str]) -> tuple[Column, list[tuple[str, str]] | None, bool]:
    """The column that goes to the interpreter, the fields of wide rows with their kinds (None: maps), and whether maps hold texts."""
    if record is None:
        kinds = L._Compiler({k.lower(): v for k, v in records.dtypes})
        named = {n.lower() for n in names}
        own = [(c.lower(), kinds.kind(("field", c)), c) for c in records.columns if c.lower() in named]
        if names and not own:
            raise ValueError(f"no rule names a column of the records ({', '.join(records.columns)}); records in a map or VARIANT column are named by record=")
        if not own:
            return F.struct(F.lit(0).alias("none")), [], False
        pairs = []
        for i, (_, kind, c) in enumerate(own):
            value = F.col(f"`{c}`")
            simple = dict(records.dtypes)[c].split("(")[0].split("<")[0]
            number = value.try_cast("double") if kind == "text" else F.when(value.isNotNull(), F.lit(1.0)) if simple in ("array", "map", "struct", "binary", "variant") else value.cast("double")
            shown = value if simple not in ("array", "map", "struct", "binary", "variant") else F.when(value.isNotNull(), F.lit("there"))
            pairs.append(_pair(shown, number).alias(f"f{i}"))
        return F.struct(*pairs), [(c, k) for c, k, _ in own], False
    value, kind = F.col(record), records.schema[record].dataType
    if kind.typeName() == "variant":
        value, inner = value.try_cast("map<string,string>"), "string"
    elif isinstance(kind, MapType):
        inner = kind.valueType.simpleString()
    else:
        raise ValueError(f"{record} is {kind.simpleString()}, not a map or VARIANT")
    text = inner == "string"

    def number(v: Column) -> Column:
        return F.when(F.lower(v) == "true", 1.0).when(F.lower(v) == "false", 0.0).otherwise(v.try_cast("double")) if text else v.cast("double")

    some = F.transform_values(value, lambda _, v: _pair(v, number(v)))
    return F.coalesce(some, F.create_map().cast("map<string,struct<t:string,n:double>>")), None, text


def fired_by(records: DataFrame, rules: DataFrame, record: str | None = None, out: str = "fired", compat: bool = False, order: str = "rule_id", rule: str = "rule_id", block: int = BLOCK) -> DataFrame:
    """records with one more column: the ids of the rules of a compiled table that each breaks, by order. record: the map or VARIANT column that holds a record; else its columns do.

    The rules are gathered by the driver a block at a time, each block in one array; the records are read once."""
    ranked = rules.filter("tree IS NOT NULL").select(F.col(rule).cast("string").alias("r"), "tree", F.col(order).alias("o"))
    n = ranked.count()
    blocks = 1 if n <= block else -(-2 * n // block)
    found = []
    for i in range(blocks):
        own = ranked if blocks == 1 else ranked.filter(F.pmod(F.xxhash64("r"), F.lit(blocks)) == i)
        trees = [(r["r"], _tuples(json.loads(r["tree"])), r["o"]) for r in own.orderBy("o", "r").collect()]
        names = set().union(*(L._named(t) for _, t, _ in trees)) if trees else set()
        column, wide, text = _input(records, record, names)
        each = _evaluate([(r, t) for r, t, _ in trees], wide, text, compat)
        found.append(F.arrow_udf(each, "array<string>").asNondeterministic()(column))
    if blocks == 1:
        return records.withColumn(out, found[0])
    # Several blocks: by order again. The ids of all rules, a few bytes each, go to the tasks.
    at = {r["r"]: i for i, r in enumerate(ranked.orderBy("o", "r").select("r").collect())}
    return records.withColumn(out, F.arrow_udf(_in_order(at), "array<string>")(F.concat(*found)))


def _in_order(at: dict[str, int]):
    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array([sorted(x, key=at.__getitem__) for x in array.to_pylist()], pa.list_(pa.string()))

    return each
