"""Business rules as Spark conditions.

A rule such as ``If [A] IN (1, 2) Then [B] <= 10000`` becomes a tree, and the tree a Column that Spark compiles with the rest of the query; a record
violates the rule where its condition holds and its consequence doesn't. Fields are names in brackets.

Values: a missing value makes a comparison unknown, and an unknown rule doesn't fire. Numbers and texts that are numbers compare as numbers. Other texts
compare as texts for = and !=; any order between them is false, so a constraint on it fires. Booleans count 1 and 0. IN compares numbers with numbers and texts with texts, and a
missing value is in no list. AND binds looser than OR, as rule writers use them: ``a OR b AND c`` is ``(a OR b) AND c``. A/0 is unknown, and so is a
function that isn't known. SUM of missing fields is 0; MAX and MIN leave missing values out. A form is attached where its field, or the one that adds
``_attached`` to its name, is true, not zero or not empty. ``FLAG ...`` as a consequence fires wherever the condition holds.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Node = tuple
_TOKEN = re.compile(r"\s*(?:(?P<field>\[[^\]]+\])|(?P<text>'(?:[^']|'')*')|(?P<number>\d+(?:\.\d+)?)|(?P<op><=|>=|!=|<>|==|[=<>+\-*/(),])|(?P<word>[A-Za-z_]\w*)|(?P<other>\S))")
_PHRASES = {"must not exceed": "<=", "must be at least": ">=", "must equal": "="}
FUNCTIONS = ("SUM", "MAX", "MIN", "CEIL", "ABS", "ROUND", "SQRT")


class RuleError(ValueError):
    """A rule that can't be read."""


class _Reader:
    """Reads one rule from left to right."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.tokens = [(m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)) for m in _TOKEN.finditer(text)]

    def peek(self, n: int = 0) -> tuple[str, str]:
        i = self.at + n
        return self.tokens[i][:2] if i < len(self.tokens) else ("end", "")

    def take(self, *words: str) -> bool:
        """Whether these words or signs come next, which are then passed."""
        met = all(self.peek(n)[0] in ("word", "op") and self.peek(n)[1].upper() == w.upper() for n, w in enumerate(words))
        self.at += len(words) * met
        return met

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise RuleError(f"{' '.join(words)} expected at {self.peek()[1] or 'the end'!r} of {self.text!r}")

    def rule(self) -> Node:
        if self.take("IF"):
            when = self.ands()
            self.need("THEN")
            then = self.consequence()
            out = ("rule", when, then, self.consequence() if self.take("ELSE") else None)
        else:
            out = ("rule", None, self.consequence(), None)
        if self.peek()[0] != "end":
            raise RuleError(f"{self.peek()[1]!r} is left of {self.text!r}")
        return out

    def consequence(self) -> Node:
        if self.take("FLAG"):
            while self.peek()[0] != "end" and not (self.peek()[0] == "word" and self.peek()[1].upper() == "ELSE"):
                self.at += 1
            return ("flag",)
        return self.ands()

    def ands(self) -> Node:
        parts = [self.ors()]
        while self.take("AND"):
            parts.append(self.ors())
        return ("and", *parts) if len(parts) > 1 else parts[0]

    def ors(self) -> Node:
        parts = [self.condition()]
        while self.take("OR"):
            parts.append(self.condition())
        return ("or", *parts) if len(parts) > 1 else parts[0]

    def condition(self) -> Node:
        if self.peek() == ("op", "("):
            start = self.at
            try:
                self.at += 1
                inner = self.ands()
                self.need(")")
                if self.peek()[0] == "end" or self.peek()[1].upper() in ("AND", "OR", "THEN", "ELSE", ")"):
                    return inner
            except RuleError:
                pass
            self.at = start
        if self.peek()[0] == "word" and (self.peek(1)[1].upper(), self.peek(2)[1].upper()) in (("MUST", "BE"), ("IS", "ATTACHED")) and self.peek(1)[0] == "word":
            left = ("field", self.tokens[self.at][1])
            self.at += 1
        else:
            left = self.sum()
        for phrase in (("MUST", "BE", "ATTACHED"), ("IS", "ATTACHED")):
            if self.take(*phrase):
                return ("attached", left)
        if self.take("IS", "NOT", "ATTACHED"):
            return ("not", ("attached", left))
        if self.take("IS", "NOT", "PRESENT"):
            return ("not", ("present", left))
        if self.take("IS", "PRESENT"):
            return ("present", left)
        if self.take("MATCHES", "PATTERN"):
            return ("matches", left, self.sum())
        if self.take("NOT", "IN"):
            return ("not", ("in", left, *self.listed()))
        if self.take("IN"):
            return ("in", left, *self.listed())
        for phrase, op in _PHRASES.items():
            if self.take(*phrase.split()):
                return ("compare", op, left, self.sum())
        kind, op = self.peek()
        if kind == "op" and op in ("=", "==", "!=", "<>", "<", ">", "<=", ">="):
            self.at += 1
            return ("compare", {"==": "=", "<>": "!="}.get(op, op), left, self.sum())
        raise RuleError(f"no comparison at {op or 'the end'!r} of {self.text!r}")

    def listed(self) -> list[Node]:
        self.need("(")
        out = [self.sum()]
        while self.take(","):
            out.append(self.sum())
        self.need(")")
        return out

    def sum(self) -> Node:
        out = self.product()
        while self.peek() in (("op", "+"), ("op", "-")):
            op = self.peek()[1]
            self.at += 1
            out = (op, out, self.product())
        return out

    def product(self) -> Node:
        out = self.single()
        while self.peek() in (("op", "*"), ("op", "/")):
            op = self.peek()[1]
            self.at += 1
            out = (op, out, self.single())
        return out

    def single(self) -> Node:
        kind, value = self.peek()
        self.at += 1
        if kind == "field":
            name = value[1:-1]
            while self.peek() == ("other", ".") and self.peek(1)[0] == "word":  # a field of another form
                name, self.at = f"{name}.{self.peek(1)[1]}", self.at + 2
            return ("field", name)
        if kind == "number":
            return ("number", float(value))
        if kind == "text":
            return ("text", value[1:-1].replace("''", "'"))
        if kind == "op" and value == "-":
            return ("-", ("number", 0.0), self.single())
        if kind == "op" and value == "(":
            inner = self.sum()
            self.need(")")
            return inner
        if kind == "word" and value.lower() in ("true", "false"):
            return ("number", float(value.lower() == "true"))
        if kind == "word" and self.peek() == ("op", "("):
            return ("call", value.upper(), *self.listed())
        raise RuleError(f"a value expected at {value or 'the end'!r} of {self.text!r}")


def parse(rule: str) -> Node:
    """The tree of a rule: nested tuples of names, texts and numbers, which json can write. RuleError where it can't be read."""
    return _Reader(rule).rule()


def unread(rules: dict[str, str]) -> dict[str, str]:
    """The rules that can't be read, with the reason. Such rules never fire."""
    out = {}
    for name, rule in rules.items():
        try:
            parse(rule)
        except RuleError as e:
            out[name] = str(e)
    return out


def _named(node: Node | None) -> set[str]:
    if not isinstance(node, tuple):
        return set()
    if node[0] == "field":
        return {node[1]}
    own = {f"{node[1][1]}_attached"} if node[0] == "attached" and node[1][0] == "field" else set()
    return reduce(set.union, map(_named, node[1:]), own)


def fields(rule: str) -> set[str]:
    """Fields that a rule names, and those that would say that a form is attached."""
    return _named(parse(rule))


class _Compiler:
    """Trees to Columns over records with columns of these types (by lower-case name)."""

    def __init__(self, types: dict[str, str]) -> None:
        self.types = types

    def kind(self, node: Node) -> str:
        """text, truth or number, or none for a field that records don't have."""
        if node[0] == "field":
            t = self.types.get(node[1].lower())
            return "none" if t is None else "truth" if t == "boolean" else "text" if t in ("string", "date") or t.startswith(("timestamp", "char", "varchar")) else "number"
        return "text" if node[0] == "text" else "number"

    def value(self, node: Node) -> Column:
        if node[0] == "field":
            return F.col("`" + node[1].replace("`", "``") + "`") if self.kind(node) != "none" else F.lit(None).cast("double")
        return F.lit(node[1]) if node[0] == "text" else self.number(node)

    def number(self, node: Node) -> Column:
        """A double; null for what isn't a number."""
        if node[0] == "number":
            return F.lit(node[1])
        if node[0] in ("field", "text"):
            kind = self.kind(node)
            return self.value(node).try_cast("double") if kind == "text" else self.value(node).cast("double")
        if node[0] == "call":
            return self.call(node[1], [self.number(x) for x in node[2:]])
        a, b = self.number(node[1]), self.number(node[2])
        return {"+": a + b, "-": a - b, "*": a * b}[node[0]] if node[0] != "/" else F.try_divide(a, b)

    def call(self, name: str, args: list[Column]) -> Column:
        if name == "SUM":
            return reduce(lambda x, y: x + y, (F.coalesce(a, F.lit(0.0)) for a in args))
        if name in ("MAX", "MIN"):
            return args[0] if len(args) == 1 else (F.greatest if name == "MAX" else F.least)(*args)
        one = {"CEIL": lambda x: F.ceil(x).cast("double"), "ABS": F.abs, "SQRT": F.sqrt, "ROUND": F.round}.get(name)
        return one(args[0]) if one else F.lit(None).cast("double")

    def compare(self, op: str, left: Node, right: Node) -> Column:
        a, b = self.number(left), self.number(right)
        ordered = {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
        if "text" not in (self.kind(left), self.kind(right)):
            return ordered
        x, y = self.value(left).cast("string"), self.value(right).cast("string")
        other = {"=": x == y, "!=": x != y}.get(op, F.lit(False))
        return F.when(x.isNull() | y.isNull(), F.lit(None)).when(a.isNotNull() & b.isNotNull(), ordered).otherwise(other)

    def truth(self, node: Node) -> Column:
        """Where a condition holds; null: unknown."""
        kind, *rest = node
        if kind in ("and", "or"):
            return reduce(lambda x, y: x & y if kind == "and" else x | y, map(self.truth, rest))
        if kind == "not":
            return ~self.truth(rest[0])
        if kind == "present":
            return self.value(rest[0]).isNotNull()
        if kind == "attached":
            names = [rest[0], ("field", f"{rest[0][1]}_attached")] if rest[0][0] == "field" else [rest[0]]
            return reduce(lambda x, y: x | y, map(self.attached, names))
        if kind == "matches":
            return self.value(rest[0]).cast("string").rlike(str(rest[1][1]))
        if kind == "in":
            text = self.kind(rest[0]) == "text"
            listed = [x[1] for x in map(self.folded, rest[1:]) if (x[0] == "text") == text]
            met = (self.value(rest[0]) if text else self.number(rest[0])).isin(*listed) if listed else F.lit(False)
            return F.coalesce(met, F.lit(False))
        return self.compare(*rest)

    def folded(self, node: Node) -> Node:
        """A negative number in a list."""
        return ("number", node[1][1] - node[2][1]) if node[0] == "-" and node[1][0] == node[2][0] == "number" else node

    def attached(self, node: Node) -> Column:
        kind, value = self.kind(node), self.value(node)
        holds = {"truth": value, "text": value.cast("string") != "", "none": F.lit(False)}.get(kind)
        if holds is None:
            simple = self.types[node[1].lower()].split("(")[0].split("<")[0]
            holds = value.isNotNull() if simple in ("array", "map", "struct", "binary", "variant") else value.cast("double") != 0
        return F.coalesce(holds, F.lit(False))

    def violated(self, node: Node | None, compat: bool) -> Column:
        if node is None or compat and not _plain(node):
            return F.lit(False)
        return F.lit(True) if node[0] == "flag" else F.coalesce(~self.truth(node), F.lit(False))


def _plain(node: Node) -> bool:
    """Whether a consequence is of the forms that compat knows: attachment, presence, and a single field compared by other than !=."""
    inner = node[1] if node[0] == "not" else node
    return inner[0] in ("attached", "present") or node[0] == "compare" and node[2][0] == "field" and node[1] != "!="


def violated(rule: str, types: dict[str, str], compat: bool = False) -> Column:
    """True where a record breaks the rule, and never null. A rule without If is a constraint on every record. types: those of the record's fields.

    compat: consequences other than attachment, presence and the comparison of a single field never fire, nor do conditions of pattern or attachment hold."""
    _, when, then, otherwise = parse(rule)
    made = _Compiler({k.lower(): v for k, v in types.items()})
    if when is None:
        return made.violated(then, compat)
    holds = F.lit(False) if compat and _mentions(when, ("matches", "attached")) else F.coalesce(made.truth(when), F.lit(False))
    return F.when(holds, made.violated(then, compat)).otherwise(made.violated(otherwise, compat))


def _mentions(node: Node, kinds: tuple[str, ...]) -> bool:
    return isinstance(node, tuple) and (node[0] in kinds or any(_mentions(x, kinds) for x in node[1:]))


#: Rules that become one column each; more of them are evaluated by the interpreter of rule_tables, with the same results.
COLUMNS = 100


def violations(records: DataFrame, rules: dict[str, str], out: str = "fired", compat: bool = False, record: str | None = None) -> DataFrame:
    """records with one more column: the ids of the rules that each breaks, in the order of the rules. Fields that records don't have are missing; rules that can't be read don't fire.

    record: a map or VARIANT column that holds the fields of a record. Records none of whose columns a rule names are an error."""
    types, bad = dict(records.dtypes), unread(rules)
    read = {i: r for i, r in rules.items() if i not in bad}
    named = set().union(*map(fields, read.values())) if read else set()
    if record is not None or len(read) > COLUMNS:
        from . import rule_tables

        listed = records.sparkSession.createDataFrame([(i, r, n) for n, (i, r) in enumerate(read.items())], "rule_id string, expression string, n int")
        return rule_tables.fired_by(records, rule_tables.compiled(listed), record, out, compat, "n")
    if named and not {n.lower() for n in named} & {c.lower() for c in records.columns}:
        raise ValueError(f"no rule names a column of the records ({', '.join(records.columns)}); records in a map or VARIANT column are named by record=")
    fired: list[Column] = [F.when(violated(r, types, compat), F.lit(i)) for i, r in read.items()]
    return records.withColumn(out, F.array_compact(F.array(*fired)) if fired else F.array().cast("array<string>"))


def outcome(fired: Column, errors: list[str]) -> Column:
    """REJECTED where a rule of severity ERROR is among those fired."""
    return F.when(F.arrays_overlap(fired, F.array(*(F.lit(e) for e in errors))), "REJECTED").otherwise("ACCEPTED") if errors else F.lit("ACCEPTED")


def replay(cases: DataFrame, rules: dict[str, str], errors: list[str], expected: str, codes: str, outcome_col: str = "outcome") -> DataFrame:
    """cases with fired, outcome and matches: whether the outcome is that of column expected and all of the rules in array column codes fired."""
    fired = violations(cases, rules)
    done = fired.withColumn(outcome_col, outcome(F.col("fired"), errors))
    every = F.size(F.array_except(F.coalesce(F.col(codes), F.array().cast("array<string>")), F.col("fired"))) == 0
    return done.withColumn("matches", F.coalesce((F.col(outcome_col) == F.col(expected)) & every, F.lit(False)))


def regression(cases: DataFrame, old: dict[str, str], new: dict[str, str]) -> DataFrame:
    """cases with fired_old, fired_new and change: same, expected (a changed or added rule is among those fired) or unexpected. An outcome here is whether any rule fires."""
    changed = [k for k in new if new[k] != old.get(k)]
    both = violations(violations(cases, old, "fired_old"), new, "fired_new")
    met = F.arrays_overlap(F.concat("fired_old", "fired_new"), F.array(*(F.lit(c) for c in changed)).cast("array<string>")) if changed else F.lit(False)
    turned = (F.size("fired_old") > 0) != (F.size("fired_new") > 0)
    return both.withColumn("change", F.when(~turned, "same").when(F.coalesce(met, F.lit(False)), "expected").otherwise("unexpected"))


def uncovered(judged: DataFrame, old: dict[str, str], new: dict[str, str]) -> DataFrame:
    """Of regression's rows: (rule) of modified rules that no case with a turned outcome exercises."""
    spark = judged.sparkSession
    modified = spark.createDataFrame([(k,) for k in new if k in old and new[k] != old[k]], "rule string")
    seen = judged.filter("change = 'expected'").select(F.explode(F.concat("fired_old", "fired_new")).alias("rule")).distinct()
    return modified.join(seen, "rule", "left_anti")
