"""Operators on small cases: golden vectors, brute force, nulls, ties, repeated and empty input."""

import csv
import itertools
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notebrook.functions import arrays as A
from notebrook.functions import code as C
from notebrook.functions import prompts as P
from notebrook.operators import codegraph as G
from notebrook.operators import models, ordered, relational, retrieval
from notebrook.plans import vectors
from notebrook.sources import notebooks, records
from notebrook.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def ints(*x):
    return F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<int>")


# ---- arrays


def test_golden_vectors(spark):
    assert value(spark, A.ends_to_binary(ints(0, 1, 3, 6))) == [1, 1, 0, 1, 0, 0, 1]
    assert value(spark, A.to_ends(ints(1, 1, 0, 1, 0, 0, 1))) == [0, 1, 3, 6]
    assert value(spark, A.clean_ends(ints(3, -1, 1, 3))) == [1, 3]
    assert value(spark, A.ordered_ends(ints(3, -1, 1, 3))) == [3, 1]
    assert value(spark, A.valid_ends(ints(), 4)) is False and value(spark, A.valid_ends(ints(1, 4), 4)) is False
    assert value(spark, A.padded(ints(1, 2, 3), 2)) == [1, 2] and value(spark, A.padded(ints(1), 3)) == [1, 0, 0]
    assert value(spark, A.uniform_labels(ints(1, 4), F.lit(5))) == pytest.approx([1 / 2, 1 / 2, 1 / 3, 1 / 3, 1 / 3])
    assert value(spark, A.exponential_labels(ints(1, 4), F.lit(5))) == pytest.approx([0.135335, 0.864665, 0.018316, 0.117020, 0.864665], abs=1e-6)
    truth, guess = ints(1, 0, 1, 0, 0), ints(0, 0, 1, 1, 0)
    assert value(spark, A.jaccard_similarity(truth, guess)) == pytest.approx(1 / 3)
    assert value(spark, A.hamming(truth, guess)) == 2 and value(spark, A.wasserstein_count(truth, guess)) == 0
    assert value(spark, A.jaccard_similarity(ints(0, 0), ints(0, 0))) == 1.0
    assert [value(spark, A.segment_of(ints(1, 3), F.lit(i))) for i in range(5)] == [0, 0, 1, 1, -1]
    assert value(spark, A.sizes_to_ends(ints(2, 0, 3))) == [1, 4] and value(spark, A.sizes_to_ends(ints())) == []
    assert value(spark, A.ngrams(ints(1, 2, 3), 2)) == [[1, 2], [2, 3]] and value(spark, A.ngrams(ints(1), 2)) == []
    ranges = F.array(F.struct(F.lit(1).alias("begin"), F.lit(2).alias("end")), F.struct(F.lit(3).alias("begin"), F.lit(5).alias("end")))
    assert value(spark, A.without_ranges(F.lit("123456"), ranges)) == "136"


def test_responses(spark):
    text = F.lit("a\n```python\nx = 1\n```\nb ```python\ny\n```")
    assert value(spark, A.fenced_blocks(text)) == ["x = 1\n", "y\n"]
    assert value(spark, P.response_segments(text)) == ["x = 1\n", "y\n"]
    assert value(spark, P.response_segments(F.lit('```json\n{"1": ["a", "b"], "2": ["c"]}\n```'))) == ["a\nb", "c"]
    assert value(spark, P.response_segments(F.lit('```json\n{"1": ["a", "b'))) == ["a\nb"]
    assert value(spark, P.response_segments(F.lit("Stage 1:\na\n\nStage 2:\nb"))) == ["a", "b"]
    assert value(spark, A.split_at_comments(F.array(*[F.lit(x) for x in ("# a", "x", "# b", "y")]))) == ["# a\nx", "# b\ny"]
    assert value(spark, P.prompt(F.lit("x = 1"), think=True)).count("```") == 2
    assert value(spark, A.preview(F.array(F.lit("x" * 100)))) == "x" * 80 + "..."


# ---- order


def cells(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "notebook_id string, cell_id int, type string, content array<string>, pos string")


@pytest.mark.parametrize("block", [ordered.BLOCK, 3])
def test_gap_segments_and_prompted(spark, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    df = cells(spark, [("n", i, "code", ["x"]) for i in (1, 2, 4, 5, 8)] + [("n", 3, "markdown", ["#"]), ("n", 1, "code", ["x"]), ("m", 7, "code", None)])
    assert sorted(r["end"] for r in ordered.gap_ends(df).collect()) == [1, 3]
    assert {r["notebook_id"]: r["prompted"] for r in ordered.prompted(df).collect()} == {"n": True, "m": False}
    assert ordered.gap_ends(df.limit(0)).count() == 0
    rng = random.Random(block)
    numbers = sorted(rng.sample(range(200), 90))
    got = sorted(tuple(r) for r in ordered.gap_segments(cells(spark, [("g", i, "code", [str(i)]) for i in numbers] + [(None, 1, "code", []), ("g", None, "code", [])]), "content").collect())
    want, segment = [], 0
    for pos, i in enumerate(numbers):
        opens = pos > 0 and i - numbers[pos - 1] > 1
        segment += opens
        want.append(("g", i, [str(i)], pos, opens, segment))
    assert got == want


def heading_by_hand(rows):
    """State machine: a heading closes the segment if code was seen in it."""
    segment, seen, out = 0, False, []
    for _, i, kind, content in rows:
        if kind == "markdown" and any(x and x.startswith("#") for x in content or []) and seen:
            segment, seen = segment + 1, False
        seen |= kind == "code"
        out.append((i, segment))
    return out


@pytest.mark.parametrize("block", [ordered.BLOCK, 4])
def test_heading_segments_equal_the_state_machine(spark, monkeypatch, block):
    monkeypatch.setattr(ordered, "BLOCK", block)
    rng = random.Random(1)
    rows = [("n", i, *rng.choice([("code", ["x"]), ("markdown", ["# h"]), ("markdown", ["t"]), ("markdown", None)])) for i in range(300)]
    got = sorted((r["cell_id"], r["segment_id"]) for r in ordered.heading_segments(cells(spark, rows)).collect())
    assert got == heading_by_hand(rows)


@pytest.mark.parametrize("block", [10, None])
def test_running_over_block_borders(spark, block):
    df = spark.range(1000).selectExpr("id % 3 as k", "cast(id as int) as o", "cast(id * 7 % 11 as int) as v")
    out = ordered.running(df, "k", "o", block=block, s=("sum", F.col("v"), True), m=("max", F.col("v"), False)).collect()
    for k in range(3):
        mine, total, most = sorted((r["o"], r["v"], r["s"], r["m"]) for r in out if r["k"] == k), 0, None
        for _, v, s, m in mine:
            total += v
            assert s == total and m == most
            most = v if most is None else max(most, v)


# ---- relational


def test_upsert_delete_update(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (None, 1, "n")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, None), (3, 1, "c"), (3, 1, "c")], "k int, v int, x string")
    assert {(r.k, r.x) for r in relational.upsert(old, new, ["k"], "v").collect()} == {(1, None), (2, "b"), (3, "c"), (None, "n")}
    assert {r.k for r in relational.without(old, new, ["k"]).collect()} == {2, None}
    assert {(r.k, r.x) for r in relational.updated(old, new.limit(2), ["k"], "x").collect()} == {(1, "a"), (2, "b"), (None, "n")}
    assert [(r.k, r.n) for r in relational.repeated_keys(new, ["k"]).collect()] == [(3, 2)]


def test_paged_keeps_empty_parents(spark):
    parents, children = spark.sql("select * from values ('a'), ('b') t(p)"), spark.range(5).selectExpr("'a' as p", "cast(id as int) as o", "id * 2 as v")
    got = {(r.p, r.page): [(c.o, c.v) for c in r.kids] for r in relational.paged(parents, children, "p", "o", "kids", 2).collect()}
    assert got == {("a", 0): [(0, 0), (1, 2)], ("a", 1): [(2, 4), (3, 6)], ("a", 2): [(4, 8)], ("b", 0): []}


def test_spread_join_equals_join(spark):
    many, few = spark.range(1000).selectExpr("if(id < 900, 0, id) as k", "id as s"), spark.range(0, 1000, 2).selectExpr("id as k", "id + 1 as w")
    assert sorted(relational.spread_join(many, few, "k", "s").collect()) == sorted(many.join(few, "k").select("k", "s", "w").collect())


# ---- records


def test_short_bins_borrow(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice((0, 0, 1, 2, 2, 3)), rng.randint(0, 1), str(rng.randint(0, 30))) for i in range(400)]
    rows += [(900 + i, 3, 2, str(i)) for i in range(40)]
    got = sorted(tuple(r) for r in relational.borrowed(spark.createDataFrame(rows, "notebook_id bigint, x int, y int, ends string"), 12, 4).collect())
    want, taken = [], set()
    for y in range(3):
        for x in range(4):
            ends = []
            for z in range(x, 4):
                for i, a, b, e in rows:
                    first = min(j for j, *k, f in rows if (*k, f) == (a, b, e))
                    if (a, b) == (z, y) and i == first and i not in taken and e not in ends and len(ends) < 12:
                        ends.append(e)
                        taken.add(i)
                        want.append((x, y, z, i))
    assert got == sorted(want)
    assert [r for r in got if r[1] == 2] == [(x, 2, 3, 900 + 12 * x + i) for x in range(3) for i in range(12)] + [(3, 2, 3, 936 + i) for i in range(4)]


def reason(record):
    try:
        records.code_row(record)
    except records.Invalid as e:
        return str(e)
    return None


@pytest.mark.parametrize(
    "record,want",
    [
        ("1,2,x", None), ('1,2,"a,""b""\nc"', None), (" 7.00 ,0,x\r\n", None), ('"1","2","x"', None), ("1,2,a\rb", None), ("1,2,a\nb\n", None),
        ('1,2,"x', "quoting"), ('1,2,"x"y', "quoting"), ('1,2,x"y', "quoting"), (' "1",2,x', "quoting"), ('1,"2,x', "quoting"), ('x"', "quoting"),
        ("1,2", "column_count"), ("1,2,x,y", "column_count"), ("", "column_count"), (None, "column_count"), ("\n", "column_count"),
        ("0,2,x", "invalid_value"), ("1,-2,x", "invalid_value"), ("1,2147483648,x", "invalid_value"), ("9223372036854775808,1,x", "invalid_value"), ("9223372036854775807,2147483647,x", None),
        ("1.5,2,x", "invalid_value"), ("1,2,  ", "invalid_value"), ("1,2,", "invalid_value"), ("١,2,x", "invalid_value"), ("1,2,\t\n", "invalid_value"), ("1e3,2,x", "invalid_value"),
        ("1,2," + "x" * 300_000, None), ('1,2,"a\0b\n"', None), ("0" * 40 + "1,2,x", None),
    ],
)
def test_reasons(record, want):
    assert reason(record) == want


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 2**63 - 1), st.integers(0, 2**31 - 1), st.text(min_size=1).filter(lambda t: t.strip() and t.isprintable()))
def test_written_rows_come_back(k, i, source):
    quoted = ",".join('"' + str(v).replace('"', '""') + '"' for v in (k, i, source))
    assert records.code_row(quoted + "\r\n") == (k, i, source)


def test_parse_splits_good_and_bad(spark):
    raw = spark.createDataFrame([(1, "f", 1, "1,2,x", None), (2, "f", None, None, None), (2, "f", None, None, None), (None, None, 3, 'a"', None)], "record_id bigint, file_name string, line_no int, record string, received_at timestamp").withColumn("source", F.lit("clash"))
    assert [tuple(r)[:3] for r in records.loaded(raw).collect()] == [(1, 2, "x")]
    assert {tuple(r) for r in records.rejected(raw).collect()} == {(2, "column_count"), (None, "quoting")}
    assert records.rejected(raw.limit(0)).count() == 0


def test_files_are_assembled_by_quotes(spark, tmp_path):
    rows = [(i + 1, i, 'a "q"\nline\n' * (i % 4) + f"x{i}") for i in range(500)]
    with open(tmp_path / "code.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
        f.write("7,8\n")
    out = records.load_files(spark, str(tmp_path)).collect()
    assert sorted((r.kernel_id, r.cell_id, r.source) for r in out if r.reason is None) == rows
    assert [r.reason for r in out if r.reason] == ["column_count"]


def brute_records(lines, most):
    out, i = [], 0
    while i < len(lines):
        n = records.record_lines(lines, i, most)
        out.append("\n".join(lines[i : i + n]))
        i += n
    return out


@pytest.mark.parametrize("block, most", [(32_768, 4_096), (7, 5), (3, 3)])
def test_assembly_over_block_borders(spark, monkeypatch, block, most):
    monkeypatch.setattr(records, "BLOCK_LINES", block)
    monkeypatch.setattr(records, "RECORD_LINES", most)
    rng = random.Random(block)
    pieces = ['1,1,"a', "b", 'c"', "2,2,x", '3,3,"', '"', '4,4,"x""y"', '5,5,"open', "6,6,plain", 'stray " quote', '7,7,"q" z', "", "8,8,a\r", '9,9,"k\r', 'm"\r']
    files = {f"f{j}": [rng.choice(pieces) for _ in range(rng.randint(1, 90))] for j in range(6)}
    df = spark.createDataFrame([(f, i, x) for f, lines in files.items() for i, x in enumerate(lines)] + [("f0", None, "x"), (None, None, None)], "file_name string, line_no bigint, line string")
    got = {}
    for r in sorted(records.assemble(df.repartition(3)).collect(), key=lambda r: r.line_no):
        got.setdefault(r.file_name, []).append(r.record)
    assert got == {f: brute_records(lines, most) for f, lines in files.items()}
    assert records.assemble(df.limit(0)).count() == 0


def test_an_open_quote_spoils_its_own_record_only(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'1,1,x\n2,2,"open\n3,3,y\n4,4,z\n5,5,w\n6,6,"legal\r\nfield"\r\n')
    out = records.load_files(spark, str(tmp_path)).collect()
    assert sorted((r.kernel_id, r.source) for r in out if not r.reason) == [(1, "x"), (3, "y"), (4, "z"), (5, "w"), (6, "legal\r\nfield")]
    assert [r.reason for r in out if r.reason] == ["quoting"]


# ---- notebook files


def test_both_notebook_formats(spark, tmp_path):
    new = {"cells": [{"cell_type": "code", "source": ["a\n", "b"], "execution_count": 3}, {"cell_type": "markdown", "source": "# t"}, {"cell_type": "code", "source": []}]}
    old = {"worksheets": [{"cells": [{"cell_type": "code", "input": ["z = 1"]}]}]}
    for name, body in (("new", json.dumps(new)), ("old", json.dumps(old)), ("bad", "{not json"), ("none", "{}")):
        (tmp_path / f"{name}.ipynb").write_text(body)
    got = sorted((r.name, r.cell_id, r.type, r.content) for r in notebooks.read_notebooks(spark, str(tmp_path)).collect())
    assert got == [("new", 0, "code", ["a", "b"]), ("new", 1, "markdown", ["# t"]), ("old", 0, "code", ["z = 1"])]
    assert {r.name for r in notebooks.broken(spark, str(tmp_path)).collect()} == {"bad", "none"}


def test_selected_notebooks_are_written_whole(spark, tmp_path):
    books = [("a", 1, True, None), ("b", 2, True, 9999), ("c", 3, True, 5), ("d", 4, False, 5)]
    spark.createDataFrame(books, "_id string, notebook_id bigint, selected boolean, n_code_lines int").withColumn("loaded_at", F.lit(0)).write.parquet(str(tmp_path / "notebook.parquet"))
    kids = [(f"{b}{i}", b, i, "code", [f"x = {i}", "y"]) for b, n in (("a", 2), ("b", 2500), ("c", 1), ("d", 1)) for i in range(n)]
    spark.createDataFrame(kids, "_id string, notebook_id string, cell_id int, type string, content array<string>").withColumn("loaded_at", F.lit(0)).write.parquet(str(tmp_path / "cell.parquet"))
    assert sorted(tuple(r) for r in vectors.s31_notebook_files(spark, str(tmp_path)).collect()) == [(1, 2, 4), (2, 2500, 5000), (3, 1, 2)]


def test_notebook_files_are_pages(spark, tmp_path):
    df = spark.createDataFrame([(7, i * 2, "code", [f"x = {i}", ""]) for i in range(25)], "name bigint, cell_id int, type string, content array<string>")
    pages = notebooks.to_files(df, "name", page=20)
    assert sorted((r.page, len(json.loads(r.text)["cells"])) for r in pages.collect()) == [(0, 10), (1, 10), (2, 5)]
    pages.write.partitionBy("name", "page").text(str(tmp_path / "files"))
    got = sorted((r.page, r.pos, r.text) for r in notebooks.read_pages(spark, str(tmp_path / "files")).collect())
    assert [t for _, _, t in got] == [f"x = {i}\n" for i in range(25)]


# ---- code


def test_statements_and_stripping():
    assert [s[3] for s in C.statements("a = 1; b = 2\n%magic\nfor i in x:\n  pass")] == ["Assign", "Assign", "For"]
    assert C.statements("x = (") == [] and C.statements(None) == []
    assert C.strip_comments('"""doc"""\nx = 1  # c\n\n# d\ns = "a # b"\n') == 'x = 1\ns = "a # b"'
    assert C.strip_comments("x = (") is None
    assert C.functions("def f(a: int, b=2):\n  pass\n@d\ndef g(): pass") == [("f", ["a", "b"], 1, 2)]
    assert C.imports("import a.b as c, d\nfrom e import f as g") == [("c", "a.b"), ("d", "d"), ("g", "e.f")]
    assert C.calls("a.b.c(x)\nd()") == ["a.b.c", "d"]
    assert C.tree_nodes("if a:\n  b = 1\nelse:\n  c = 2") == [(0, -1, 1, 0, "If"), (1, 0, 2, 0, "Assign"), (2, 0, 2, 1, "Assign")]
    flow = C.dataflow("a = 1\nif a:\n  b = a\nelse:\n  b = 2\nc = b")
    assert ("b", 6, "comesFrom", "b", 3) in flow and ("b", 6, "comesFrom", "b", 5) in flow


@pytest.mark.parametrize("code, want", [
    ("a = 1\ndef f(b, c=a):\n    d = b + c\n    return d\nd", {("a", 2, "comesFrom", "a", 1), ("c", 2, "comesFrom", "a", 2), ("b", 3, "comesFrom", "b", 2), ("c", 3, "comesFrom", "c", 2), ("d", 3, "computedFrom", "b", 3), ("d", 3, "computedFrom", "c", 3), ("d", 4, "comesFrom", "d", 3)}),
    ("class K:\n    x = 1\n    def g(self):\n        return self", {("self", 4, "comesFrom", "self", 3)}),
    ("try:\n    a = 1\nexcept E as e:\n    print(e)\nelse:\n    b = a\nfinally:\n    a", {("e", 4, "comesFrom", "e", 3), ("a", 6, "comesFrom", "a", 2), ("b", 6, "computedFrom", "a", 6), ("a", 8, "comesFrom", "a", 2)}),
    ("y = 1\n[x for x in y if x]", {("y", 2, "comesFrom", "y", 1), ("x", 2, "computedFrom", "y", 2), ("x", 2, "comesFrom", "x", 2)}),
    ("async def f(s):\n    async for x in s:\n        x\n    async with s as t:\n        t", {("s", 2, "comesFrom", "s", 1), ("x", 2, "computedFrom", "s", 2), ("x", 3, "comesFrom", "x", 2), ("s", 4, "comesFrom", "s", 1), ("t", 4, "computedFrom", "s", 4), ("t", 5, "comesFrom", "t", 4)}),
    ("v = 1\nmatch v:\n    case [p, *q]:\n        p", {("v", 2, "comesFrom", "v", 1), ("p", 3, "computedFrom", "v", 2), ("q", 3, "computedFrom", "v", 2), ("p", 4, "comesFrom", "p", 3)}),
])
def test_data_flow_inside_definitions(code, want):
    assert set(C.dataflow(code)) == want


def code_cells(spark, *codes):
    return spark.createDataFrame([("n", i, c) for i, c in enumerate(codes)], "notebook_id string, cell_id int, code string")


def links(spark, *codes):
    df = code_cells(spark, *codes)
    groups = df.select("notebook_id", "cell_id", F.col("cell_id").alias("segment_id"))
    return {(r.source, r.target): r.names for r in G.edges(G.references(df), groups).collect()}


def test_data_flow_rules(spark):
    assert links(spark, "df = load()", "df = df.dropna()", "print(df)") == {(1, 2): ["df"]}
    assert links(spark, "df = load()", "df.drop(inplace=True)", "df") == {(0, 1): ["df"], (1, 2): ["df"]}
    assert links(spark, "x = 1\ndef f(a):\n  pass", "f(x)", "x") == {(0, 1): ["f", "x"], (1, 2): ["x"]}
    assert links(spark, "x = 1", "len(x)", "x") == {(0, 1): ["x"], (0, 2): ["x"]}
    assert links(spark, "a, b = 1, 2", "x = (", "c = a + b") == {(0, 2): ["a", "b"]}
    assert links(spark, "y", "y = 1") == {}


def test_density_and_json(spark):
    df = code_cells(spark, "x = 1", "y = x", "z = 2")
    groups = df.select("notebook_id", "cell_id", F.col("cell_id").alias("segment_id"))
    found = G.edges(G.references(df), groups)
    assert G.density(found, groups).first().density == pytest.approx(1 / 6, abs=1e-6)
    assert json.loads(G.graph_json(found, groups).first().graph)["links"] == [{"source": 0, "target": 1, "label": "x"}]


def test_execution_orders_equal_brute_force(spark):
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 5)
        makes = [set(rng.sample("abc", rng.randint(0, 2))) for _ in range(n)]
        needs = [set(rng.sample("abc", rng.randint(0, 2))) for _ in range(n)]
        ok = lambda p: all(needs[i] <= set().union(*[makes[j] for j in p[: k + 1]]) for k, i in enumerate(p))
        whole = [list(p) for p in itertools.permutations(range(n)) if ok(p)]
        got = G.execution_orders(makes, needs, 10_000)
        assert [o for o in got if len(o) == n] == whole
        assert G.execution_orders(makes, needs, 1) == got[:1]
    df = code_cells(spark, "print(x)", "y = 1\nx = y", "")
    rows = G.order_rows(G.symbols(df), df).collect()
    assert [list(r.cells) for r in rows] == [[1, 0, 2]]
    assert {(r.cell_id, tuple(r.missing)) for r in G.runnable_top_down(G.symbols(df)).collect()} == {(0, ("x",))}


def test_order_counts_and_delayed_cells_equal_enumeration():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 6)
        makes = [set(rng.sample("abcd", rng.randint(0, 2))) for _ in range(n)]
        needs = [set(rng.sample("abcde"[: rng.choice((3, 4, 5))], rng.randint(0, 2))) for _ in range(n)]
        whole = G.execution_orders(makes, needs, 10_000)
        assert G.order_count(makes, needs, 10_000) == (len(whole), max(map(len, whole)))
        assert G.order_count(makes, needs, 3)[0] == min(3, len(whole))
        moved = G.delayed_order([(i, makes[i], dict.fromkeys(needs[i])) for i in range(n)])
        assert [c for c, *_ in sorted(moved, key=lambda x: x[1:])] == whole[0]
    assert G.order_count([{i + 1} for i in range(3000)], [{i} if i else set() for i in range(3000)], 200) == (1, 3000)


@pytest.mark.parametrize("large, rounds", [(2_000, 12), (2, 12), (2, 1)])
def test_single_orders_of_all_notebooks(spark, monkeypatch, large, rounds):
    monkeypatch.setattr(G, "LARGE", large)
    monkeypatch.setattr(G, "ROUNDS", rounds)
    rng = random.Random(5)
    symbols, cells, want = [], [], {}
    for b in map(str, range(40)):
        n = rng.randint(1, 9)
        makes = [set(rng.sample("abcdef", rng.randint(0, 2))) for _ in range(n)]
        needs = [set(rng.sample("abcdefg", rng.randint(0, 2))) for _ in range(n)]
        cells += [(b, i) for i in range(n)]
        symbols += [(b, i, role, x, "var") for role, sets in (("makes", makes), ("needs", needs)) for i in range(n) for x in sets[i]]
        want[b] = G.execution_orders(makes, needs, 1)[0]
    rows = spark.createDataFrame(symbols, "notebook_id string, cell_id int, role string, name string, space string")
    got = {b: [] for b in want}
    for r in sorted(G.single_order(rows, spark.createDataFrame(cells, "notebook_id string, cell_id int")).collect(), key=lambda r: (r.trigger, r.step)):
        got[r.notebook_id].append(r.cell_id)
    assert got == want


def test_augmented_names_are_not_made():
    made, needed = C.produced_consumed("x += 1")
    assert made == [] and needed == ["x:var"]
    assert C.produced_consumed("import a.b\nclass K: pass")[0] == ["K:fun", "K:var", "a:fun", "a:var"]


def test_random_risk(spark):
    rows = lambda *c: {(r.needed, r.seeded) for r in G.random_risk(code_cells(spark, *c)).collect()}
    assert rows("import numpy as np", "np.random.rand(3)") == {("numpy.random.seed", False)}
    assert rows("import numpy as np\nnp.random.seed(1)", "np.random.rand(3)") == {("numpy.random.seed", True)}
    assert rows("from random import choice", "choice(x)") == {("random.seed", False)}
    assert rows("import pandas as pd", "pd.read_csv(x)") == set()


def brute_distance(a, n, b, m):
    best = 10**9
    for image in itertools.permutations([*range(m), *[-1] * n], n):
        used = [j for j in image if j >= 0]
        cost = sum(j < 0 for j in image) + (m - len(used))
        back = {j: i for i, j in enumerate(image) if j >= 0}
        for (x, y), label in a.items():
            cost += image[x] < 0 or image[y] < 0 or b.get((image[x], image[y])) != label
        for (x, y) in b:
            cost += not (x in back and y in back and (back[x], back[y]) in a)
        best = min(best, cost)
    return best


def test_edit_distance_equals_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        n, m = rng.randint(0, 3), rng.randint(0, 3)
        graph = lambda k: {(x, y): rng.choice("ab") for x in range(k) for y in range(k) if x != y and rng.random() < 0.4}
        a, b = graph(n), graph(m)
        assert G.edit_distance(a, n, b, m, 10**6) == (brute_distance(a, n, b, m), True)
        assert G.edit_distance(a, n, b, m, 3)[0] >= brute_distance(a, n, b, m)


# ---- retrieval, models, streams


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(100)] + [(200, None), (201, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query, r["rank"], r.neighbour) for r in retrieval.nearest(df.where("vec_id % 20 = 0 and vec_id < 200"), df, "vec_id", "embedding", 3).collect())
    want = []
    for q, v in rows[:100:20]:
        near = sorted((sum((x - y) ** 2 for x, y in zip(v, w)) ** 0.5, i) for i, w in rows[:100] if i != q)[:3]
        want += [(q, k + 1, i) for k, (_, i) in enumerate(near)]
    assert got == sorted(want)


def test_nearest_takes_the_lowest_ids_of_many_copies(spark):
    rng = random.Random(7)
    rows = [(i, [0.1, 0.7]) for i in range(300)] + [(300 + i, [1.0, float(i)]) for i in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query, r["rank"], r.neighbour) for r in retrieval.nearest(df.where("vec_id in (0, 299, 300)"), df, "vec_id", "embedding", 3).collect())
    assert [(q, i) for q, _, i in got if q < 300] == [(0, 1), (0, 2), (0, 3), (299, 0), (299, 1), (299, 2)]


def test_boundary_vector_and_hook(spark):
    assert value(spark, models.boundary_vector(F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1)))) == [0, 1, 1]
    df = models.predict(spark.range(5), lambda b: b["id"] * 0.5, "score")
    assert [r.score for r in df.orderBy("id").collect()] == [0.0, 0.5, 1.0, 1.5, 2.0]


def test_stream_of_several_files(spark, tmp_path):
    rows = [(1, 1, "a"), (2, 1, "b"), (1, 3, "c"), (1, 2, "d")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k int, v int, x string").write.parquet(str(tmp_path / f"part{i}"))
    schema = spark.read.parquet(str(tmp_path / "part0")).schema
    got = ingest.latest_rows(spark, str(tmp_path / "part*"), schema, ["k"], "v").collect()
    assert {(r.k, r.x) for r in got} == {(1, "c"), (2, "b")}
