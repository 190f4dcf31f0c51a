"""The rule language where texts, zeros, quotes and attachments meet; gates that tables hardly reach; streams with state."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import rule_language as L
from lodestrata.operators import gates as G
from lodestrata.sources import readers
from lodestrata.streaming import events as E


def fired(spark, rule, compat=False, **record):
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string", type(None): "double"}
    rows = spark.createDataFrame([tuple(record.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in record.items()))
    return L.violations(rows, {"r": rule}, compat=compat).first()["fired"] == ["r"]


@pytest.mark.parametrize(
    ("rule", "record", "want"),
    [
        ("ABS([A] - [B]) / [C] <= 1", {"A": 1.0, "B": 9.0, "C": 2.0}, True),
        ("ABS([A] - [B]) / [C] <= 1", {"A": 1.0, "B": 9.0, "C": 0.0}, False),
        ("SUM([A], [B]) / [C] <= 1", {"A": 1.0, "B": None, "C": 0.0}, False),
        ("[A] / [B] / [C] <= 1", {"A": 8.0, "B": 2.0, "C": 2.0}, True),
        ("[A] / [B] / [C] <= 1", {"A": 8.0, "B": 0.0, "C": 2.0}, False),
        ("[S] = 5", {"S": "abc"}, True),
        ("[S] = 5", {"S": "5.0"}, False),
        ("[S] < 5", {"S": "abc"}, True),
        ("If [S] < 5 Then [A] = 1", {"S": "abc", "A": 2.0}, False),
        ("If [S] != 5 Then [A] = 1", {"S": "abc", "A": 2.0}, True),
        ("If [S] = 'if x Then y' Then [A] = 1", {"S": "if x Then y", "A": 2.0}, True),
        ("[A] must be attached", {"A": False}, True),
        ("[A] must be attached", {"A": 0}, True),
        ("[A] must be attached", {"A": None, "A_attached": True}, False),
        ("IRS8960 must be attached", {"IRS8960": "x"}, False),
        ("If [T] IN (2, 3) Then [A] = 1", {"T": 2.0, "A": 0.0}, True),
        ("If [T] IN ('2') Then [A] = 1", {"T": 2.0, "A": 0.0}, False),
        ("If [T] IN (1) Then [A] = 1", {"T": True, "A": 0.0}, True),
        ("If [T] IN (-1, 2) Then [A] = 1", {"T": -1.0, "A": 0.0}, True),
        ("If [T] NOT IN (1) Then [A] = 1", {"T": None, "A": 0.0}, True),
        ("If ([A] > 0 AND [B] > 0) OR [C] > 0 Then [D] = 1", {"A": 1.0, "B": 0.0, "C": 1.0, "D": 0.0}, True),
        ("If ([A] + [B]) > 3 Then [D] = 1", {"A": 2.0, "B": 2.0, "D": 0.0}, True),
        ("[A] = MAX(0, CEIL(([B] - 1000) / 500) * 10)", {"A": 20.0, "B": 1600.0}, False),
        ("[A] = MIN([B], 10000) * 0.5 - -1", {"A": 6.0, "B": 10.0}, False),
        ("If [A] > 0 Then FLAG for review", {"A": 1.0}, True),
        ("[A] <= EIC_MAX_TABLE([B])", {"A": 1.0, "B": 1.0}, False),
        ("[A] >= SUM([IRS W2].WagesAmt)", {"A": -1.0}, True),
        ("not a rule at all", {"A": 1.0}, False),
    ],
)
def test_values_of_every_kind(spark, rule, record, want):
    assert fired(spark, rule, **record) == want


def test_rules_that_can_not_be_read_and_trees_as_json():
    assert set(L.unread({"a": "[A] = 1", "b": "If [A] Then", "c": "[A] = 1 2", "d": ""})) == {"b", "c", "d"}
    assert json.loads(json.dumps(L.parse("If [A] > 1 Then [B] is present")))[0] == "rule" and L.fields("[A] = SUM([B], 'c [D]')") == {"A", "B"}


def test_compat_leaves_forms_out(spark):
    for rule, record in (("[A] / [B] <= 1", {"A": 5.0, "B": 1.0}), ("[A] IN (1, 2)", {"A": 5.0}), ("If [A] > 0 Then FLAG x", {"A": 5.0}), ("If [S] matches pattern 'x' Then [A] = 1", {"S": "x", "A": 5.0})):
        assert fired(spark, rule, **record) and not fired(spark, rule, compat=True, **record)
    assert fired(spark, "[A] <= 1", compat=True, A=5.0)


def test_uncovered_rules(spark):
    cases = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0)], "A double, B double")
    old, new = {"x": "[A] <= 6", "y": "[B] <= 9"}, {"x": "[A] <= 4", "y": "[B] <= 8"}
    judged = L.regression(cases, old, new)
    assert sorted(r["change"] for r in judged.collect()) == ["expected", "same"] and [r["rule"] for r in L.uncovered(judged, old, new).collect()] == ["y"]
    assert all(r["passed"] for r in G.regression_gate(judged).collect())


def test_the_gate_of_rule_tables(spark, tmp_path):
    head = "RuleId,RULETYPE,Form Name,XPATH,DESCRIPTION,EXPRESSION,Err-Code,SEVERITY,TAX_YR,VERSION\n"
    lines = ['R1,MATH,1040,/a,t,"[A] = 1, or so",E1,ERROR,2024,5', "R2,REJECT,1040,/b,t,[A] = 1,E2,WARNING,2024,5", "R2,REJECT,1040,/b,t,[A] = 1,E2,WARNING,2024,5", "R3,REJECT,1040,,t,[A] = 1,E3,ERROR,2024,5", "R4,ODD,1040,/d,t,[A] = 1,E4,ERROR,2024,5"]
    (tmp_path / "r.csv").write_text(head + "\n".join(lines))
    rules = readers.read_rules(spark, f"file://{tmp_path}/r.csv")
    got = {r["check"]: (r["value"], r["passed"]) for r in G.rules_gate(rules, 5).collect()}
    assert got["ROW_COUNT"] == (5.0, True) and got["NULL_FIELDS"] == (1.0, False) and got["ENUM_VALUES"] == (1.0, False) and got["DUPLICATE_RULE_IDS"] == (1.0, False) and got["AST_PARSE_RATE"][1] is False


def test_gates_of_reviews_and_rates(spark):
    reviews = spark.createDataFrame([("a", True)] * 8 + [("b", False)] * 2 + [("b", True), ("c", None)], "category string, is_correct boolean")
    got = {r["check"]: r["passed"] for r in G.review_gate(reviews, "category", "is_correct").collect()}
    assert got == {"ACCURACY": False, "SYSTEMATIC": False}
    assert [r["passed"] for r in G.rate_gate(spark.createDataFrame([(0.5,)], "hit_rate double"), "hit_rate", G.HIT_RATE).collect()] == [True]
    parts = spark.createDataFrame([(["A", "B"],)], "field_names array<string>")
    assert [r["field"] for r in G.uncovered_fields(spark.createDataFrame([("A",), ("C",)], "field string"), parts).collect()] == ["C"]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "golden.json").write_text('[{"id": "1", "question": "q", "expected_pubs": ["17"], "key_facts": ["f"], "other": 1}]')
    (tmp_path / "review.csv").write_text("rule_id,is_correct\nR1,true\nR2,maybe\n")
    (tmp_path / "review.json").write_text('[{"rule_id": "R1", "is_correct": false}]')
    assert readers.read_golden(spark, f"{tmp_path}/golden.json").first()["expected_pubs"] == ["17"]
    assert [r["is_correct"] for r in readers.read_reviews(spark, f"{tmp_path}/review.csv").orderBy("rule_id").collect()] == [True, None]
    assert [r["is_correct"] for r in readers.read_reviews(spark, f"{tmp_path}/review.json").collect()] == [False]
    rows = spark.createDataFrame([("a", ["x"])], "id string, tags array<string>")
    readers.write_sample(rows, f"{tmp_path}/sample")
    readers.write_report(rows, f"{tmp_path}/report")
    assert spark.read.option("header", True).option("escape", "\"").csv(f"{tmp_path}/sample/csv").first()["tags"] == '["x"]' and spark.read.json(f"{tmp_path}/report").count() == 1


def run_stream(spark, tmp_path, make, mode, batches):
    """What a stream over files gives, one file a batch."""
    kind = "user_id long, ts timestamp, value double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = make(source).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table("out").collect()


DAY = [[(1, "2024-01-01 10:00:00", 1.0), (1, "2024-01-01 10:05:00", 2.0), (2, "2024-01-01 10:00:00", 5.0)], [(1, "2024-01-01 10:06:00", 4.0), (2, "2024-01-02 10:00:00", 1.0)], [(3, "2024-01-03 10:00:00", 1.0)]]


def test_first_event_of_each_key_in_a_stream(spark, tmp_path):
    rows = run_stream(spark, tmp_path, lambda s: E.first_seen(s, ["user_id"], "1 hour"), "append", DAY)
    assert sorted((r["user_id"], str(r["ts"])[:10]) for r in rows if r["user_id"] != 2) == [(1, "2024-01-01"), (3, "2024-01-03")] and sum(r["user_id"] == 2 for r in rows) in (1, 2)


def test_sessions_of_a_stream(spark, tmp_path):
    rows = run_stream(spark, tmp_path, lambda s: E.sessions(s, "30 minutes", ("user_id",), late="1 hour"), "append", DAY)
    assert {(r["user_id"], r["n"], r["total"]) for r in rows} >= {(1, 3, 7.0), (2, 1, 5.0)}


def test_state_of_a_stream(spark, tmp_path):
    rows = run_stream(spark, tmp_path, lambda s: E.running(s, "user_id"), "update", DAY)
    last = {}
    for r in rows:
        last[r["user_id"]] = max(last.get(r["user_id"], (0,)), (r["n"], r["total"], r["highest"]))
    assert last == {1: (3, 7.0, 4.0), 2: (2, 6.0, 5.0), 3: (1, 1.0, 1.0)}


_FORMS = ["[A] <= 3", "If [B] = 'x' Then [A] >= 2", "If [A] > 1 OR [C] > 1 AND [B] != 'y' Then [C] <= 4 Else [A] = 0", "[A] / [C] <= 1.5", "SUM([A], [C], [Z]) <= 5", "MAX([A], [C]) < 4", "MIN(0, [A] - [C]) >= -2", "ABS([A] - [C]) <= 2", "[B] IN ('x', 'y')", "[A] IN (1, 2, -1)", "[A] NOT IN (0, 5)",
          "If [C] > 0 Then [F] must be attached", "If [F] is not present Then [B] matches pattern '^[a-x]'", "CEIL([A] / 2) = 1", "[B] > 3", "[B] = [A]", "If [A] = 1 Then FLAG it", "[Z] is present", "NOTHING([A]) > 1", "[A] = 'x'", "ROUND([C]) = 2", "[F] is not attached", "If [A] is present AND [B] = 'q' Then [C] is not present"]


def _records():
    rng = random.Random(4)
    pick = lambda *v: rng.choice(v)
    return [(i, pick(None, -1.0, 0.0, 1.0, 2.0, 5.0), pick(None, "x", "y", "q", "3", "", "1.0"), pick(None, 0, 1, 2, 6), pick(None, True, False)) for i in range(300)]


@pytest.mark.parametrize("compat", [False, True])
def test_the_interpreter_equals_compiled_columns(spark, compat):
    """Typed rows: the rules as columns and as a table fire alike, whatever the values and in however many blocks."""
    from lodestrata.functions import rule_tables as T

    frame = spark.createDataFrame(_records(), "i int, a double, B string, C int, F boolean")
    rules = {f"r{n:02d}": r for n, r in enumerate(_FORMS)}
    want = {r["i"]: r["fired"] for r in L.violations(frame, rules, compat=compat).collect()}
    assert sum(map(len, want.values())) > 500
    table = T.compiled(spark.createDataFrame([*rules.items(), ("bad", "If If")], "rule_id string, expression string"))
    for block in (20_000, 5):
        assert {r["i"]: r["fired"] for r in T.fired_by(frame, table, compat=compat, block=block).collect()} == want
    assert [r["rule_id"] for r in table.filter("unread IS NOT NULL").collect()] == ["bad"]


def test_records_that_are_maps_or_variants(spark):
    from lodestrata.functions import rule_tables as T

    rows = [(1, {"A": "5"}), (2, {"A": "3", "S": "1"}), (3, {"S": "2", "F": "true"}), (4, {}), (5, None), (6, {"A": None, "S": "x"})]
    frame = spark.createDataFrame(rows, "i int, m map<string,string>")
    rules = {"max": "[A] <= 3", "in": "[S] IN (1, 'x')", "has": "[A] is present", "form": "[F] must be attached", "sum": "SUM([A], [S]) < 8"}
    want = {1: {"max", "in", "form"}, 2: {"form"}, 3: {"in", "has"}, 4: {"in", "has", "form"}, 5: {"in", "has", "form"}, 6: {"has", "form"}}
    assert {r["i"]: set(r["fired"]) for r in L.violations(frame, rules, record="m").collect()} == want
    variant = frame.select("i", F.expr("parse_json(to_json(m))").alias("v"))
    assert {r["i"]: set(r["fired"]) for r in L.violations(variant, rules, record="v").collect()} == want
    numbers = spark.createDataFrame([(1, {"A": 5.0}), (2, {"A": 1.0, "F": 0.0}), (3, {"F": 2.0})], "i int, m map<string,double>")
    assert {r["i"]: r["fired"] for r in L.violations(numbers, {"max": "[A] <= 3", "form": "[F] is attached"}, record="m").collect()} == {1: ["max", "form"], 2: ["form"], 3: []}
    for given in (frame, frame.limit(0)):
        with pytest.raises(ValueError, match="no rule names a column"):
            L.violations(given, rules)
    assert T.fired_by(frame.limit(0), T.compiled(spark.createDataFrame([("a", "[A] > 1")], "rule_id string, expression string")), "m").collect() == []
    assert {tuple(r["fired"]) for r in T.fired_by(frame, T.compiled(spark.createDataFrame([], "rule_id string, expression string")), "m").collect()} == {()}


def test_five_thousand_rules(spark):
    """The plan doesn't grow with the rules, and 5,000 of them over 6,000 records take seconds."""
    import time

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rules = {f"r{i}": f"If [l_quantity] > {i % 50} AND [l_returnflag] = '{'RAN'[i % 3]}' Then [l_extendedprice] / [l_quantity] <= {900 + i % 1200} OR [l_tax] < 0.0{i % 9}" for i in range(5000)}
    fired = L.violations(lines, rules)
    began = time.perf_counter()
    n = fired.select(F.size("fired").alias("n")).agg(F.sum("n")).first()[0]
    assert time.perf_counter() - began < 60 and n > 0
    some = dict(list(rules.items())[:60])
    few = L.violations(lines, some).select(F.sum(F.size("fired"))).first()[0]
    assert fired.select(F.sum(F.size(F.array_intersect("fired", F.array(*(F.lit(r) for r in some)))))).first()[0] == few
    assert len(fired._jdf.queryExecution().toString()) < 20_000
