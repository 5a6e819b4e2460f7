"""Tokens, flattened trees, model features, recorded outputs and orders against known cases and brute force."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from notebrook import session
from notebrook.functions import arrays as A
from notebrook.functions import code as C
from notebrook.functions import spans as S
from notebrook.operators import codegraph as G
from notebrook.operators import models, ordered, relational
from notebrook.sources import notebooks, records

CODE = 'import os\n# note\nx = f"a{1}b"  # tail\ndef g(a, b=2):\n    """doc"""\n    return a + b\ny = g(x, \'two\\\nlines\')\n'


def test_leaves_cover_the_text():
    lines = CODE.split("\n")
    found = S.leaves(CODE)
    assert all(S.text_between(lines, x.line, x.column, x.end_line, x.end_column) == x.text for x in found)
    assert [x.text for x in found if x.kind == "string"] == ['f"a{1}b"', '"""doc"""', "'two\\\nlines'"]
    assert [x.text for x in found if x.kind == "comment"] == ["# note", "# tail"]
    assert {x.kind for x in S.variables(CODE)} == {"name", "number", "string", "comment"}
    assert len(S.leaves(CODE, comments=False)) == len(found) - 2
    assert S.leaves(None) == S.leaves("") == S.leaves("x = (") == []


def test_travelled_trees():
    assert S.travelled("x = y") == ["AST#Assign#Left", "x", "y", "AST#Assign#Right"]
    out = S.travelled(CODE)
    assert sum(x.endswith("#Left") for x in out) == sum(x.endswith("#Right") for x in out) > 0
    assert "doc" not in " ".join(out) and S.travelled("x = (") == []
    assert S.travelled("x = y", pieces=list)[1:3] == ["x", "y"]


def test_connected_flow_and_features():
    tokens, flow = S.connected_flow("a = 1\nb = a\nunused = 2\nprint(b)")
    assert tokens[:6] == ["a", "=", "1", "b", "=", "a"]
    assert ("a", 5, "comesFrom", [0]) in flow and ("b", 3, "computedFrom", [5]) in flow and all(f[0] != "unused" for f in flow)
    x = S.features("a = 1\nb = a\nprint(b)", most_code=16, most_flow=8)
    nodes = sum(p == 0 for p in x.positions)
    assert len(x.ids) == len(x.positions) == 24 and nodes == len(x.flow_to_code) == len(x.flow_to_flow)
    assert x.ids[0] == S.BEGIN and x.ids.count(S.END) == 1 and x.ids.count(S.UNKNOWN) == nodes
    assert all(x.ids[a:b] == [S.hashed_id(t)] for (a, b), t in zip(x.flow_to_code, [f[0] for f in S.connected_flow("a = 1\nb = a\nprint(b)")[1]]))
    long = S.features("\n".join(f"v{i} = v{i - 1}" for i in range(500)), most_code=16, most_flow=8)
    assert len(long.ids) == len(long.positions) == 24
    assert S.features(None).ids[:2] == [S.BEGIN, S.END]


def test_attention_covers_what_a_dense_mask_does():
    x = S.features("a = 1\nb = a\nprint(b)", most_code=16, most_flow=8)
    rectangles = S.attention(x)
    mask = {(i, j) for a, b, c, d in rectangles for i in range(a, b) for j in range(c, d)}
    tokens, used = sum(p > 1 for p in x.positions), sum(p != 1 for p in x.positions)
    assert all((i, j) in mask for i in range(tokens) for j in range(tokens)) and all((0, j) in mask for j in range(used))
    assert all((tokens + k, i) in mask and (i, tokens + k) in mask for k, (a, b) in enumerate(x.flow_to_code) for i in range(a, b))
    assert all(max(i, j) < used for i, j in mask)


def test_parts_names_and_renaming():
    parts = S.split_up("import os, re\n@d\ndef f():\n    pass\nx = 1\n%time y\nz = x")
    assert [(p, n, k) for p, n, _, k in parts] == [("import", None, 1), ("function", "f", 1), ("rest", None, 2)]
    assert parts[1][2].startswith("@d\ndef f") and parts[2][2] == "x = 1\nz = x"
    assert S.split_up("x = (") == [] and S.split_up("") == []
    assert S.identifiers("b = len(a)\nfor a in b: pass") == ["b", "a"]
    assert S.renamed("ab = a + 'a'  # a\na, a", "a", "xyz") == "ab = xyz + 'a'  # a\nxyz, xyz"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_span_columns(spark):
    lines = F.array(*[F.lit(x) for x in ("abc", "def", "ghi")])
    at = lambda *x, **k: value(spark, A.span_text(lines, *[F.lit(v) for v in x], **k))
    assert at(0, 1, 2, 2) == "bc\ndef\ngh" and at(0, 1, 2, 2, joint="") == "bcdefgh" and at(1, 0, 1, 2) == "de"
    assert value(spark, A.character_span(F.lit("héllo"), F.lit(1), F.lit(3))) == "él"
    bare = value(spark, A.without_c_comments(F.lit("a /* x\ny */ b // t\n\nchar *s = \"/* no */ // no\"; c = '\\'';\n// all")))
    assert bare == "a   b  \nchar *s = \"/* no */ // no\"; c = '\\'';"
    null = F.lit(None).cast("int")
    masks = [A.valid_rows([c > 1], [c, d]) for c, d in ((F.lit(2), null), (F.lit(1), F.lit(1)), (null, F.lit(1)), (F.lit(1), null))]
    assert list(spark.range(1).select(*masks).first()) == [True, True, False, False]


def test_outputs_and_versions(spark, tmp_path):
    outputs = [{"text": ["a\n", "b"]}, {"data": {"image/png": "P", "text/plain": "no"}}, {"data": {"text/plain": ["c", "d"]}}, {"data": {}}]
    body = {"cells": [{"cell_type": "code", "source": "x", "execution_count": 2, "outputs": outputs}], "metadata": {"language_info": {"name": "python", "version": "3.10.2"}}}
    (tmp_path / "one.ipynb").write_text(json.dumps(body))
    (tmp_path / "two.ipynb").write_text("{}")
    assert {tuple(r) for r in notebooks.read_versions(spark, str(tmp_path)).collect()} == {("one", "python", "3.10"), ("two", None, None)}
    texts = spark.createDataFrame([(json.dumps(body), "n", 0), ("{}", "m", 0), (None, "k", 0)], "text string, name string, page bigint")
    rows = notebooks.pages(texts).select("name", "execution_count", notebooks.output_text(F.col("outputs")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [("n", 2, "a\nbPcd")]
    assert value(spark, notebooks.output_text(F.lit(None).cast("string"))) == ""


def code_cells(spark, *codes):
    return spark.createDataFrame([("n", i, c) for i, c in enumerate(codes)], "notebook_id string, cell_id int, code string")


def test_api_names_and_fixes(spark):
    df = code_cells(spark, "import numpy as np\nfrom random import choice", "np.random.rand(3)\nchoice([1])\nnp.zeros(2)", None)
    assert {r.api for r in G.api_calls(df).collect()} == {"numpy.random.rand", "random.choice", "numpy.zeros"}
    assert {(r.cell_id, r.call, tuple(r.fix)) for r in G.random_fixes(df).collect()} == {
        (1, "np.random.rand", ("import numpy", "numpy.random.seed(100)")), (1, "choice", ("import random", "random.seed(100)")),
    }


def test_recorded_orders_equal_brute_force(spark):
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 4)
        counts = rng.sample(range(1, rng.randint(n, 6) + 1), n)
        if rng.random() < 0.2:
            counts[0] = None
        makes, needs = ([set(rng.sample("abc", rng.randint(0, 2))) for _ in range(n)] for _ in range(2))
        want = set()
        for p in itertools.product(range(n), repeat=max((c for c in counts if c), default=0)):
            last = {i: k + 1 for k, i in enumerate(p)}
            made, ok = set(), all(last.get(i) == counts[i] for i in range(n))
            for i in p:
                made |= makes[i]
                ok = ok and needs[i] <= made
            if ok:
                want.add(p)
        got = G.recorded_orders(makes, needs, counts, 10**6, 10**7)
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert G.recorded_orders([set()] * 2, [set()] * 2, [1, 40], 10**6, 5) is None
    df = code_cells(spark, "x = 1", "print(x)")
    counts = df.select("notebook_id", "cell_id", (F.col("cell_id") + 2).alias("count"))
    assert [tuple(r) for r in G.recorded_order_counts(G.symbols(df), counts, 200).collect()] == [("n", 1, 3)]
    assert {tuple(r) for r in G.executable(G.symbols(code_cells(spark, "print(x)", "x = 1")), df).collect()} == {("n", "normal", False), ("n", "dependency", True)}


def test_layers_of_a_graph_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), (None, "x"), ("d", None)], "parent string, child string")
    roots = spark.createDataFrame([("a", "r"), ("d", "s")], "node string, root string")
    assert {tuple(r) for r in G.layers(edges, roots).collect()} == {("a", "r", 0), ("b", "r", 1), ("c", "r", 1), ("d", "r", 2), ("d", "s", 0)}
    assert G.layers(edges.limit(0), roots).count() == 2 and G.layers(edges, roots.limit(0)).count() == 0


@pytest.mark.parametrize("few, lots", [(10, 5), (0, 5), (0, 10**6)])
def test_spread_join_keeps_every_row(spark, monkeypatch, few, lots):
    monkeypatch.setattr(relational, "FEW", few)
    monkeypatch.setattr(relational, "SALT_ROWS", lots)
    many = spark.range(90).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 7) end as k", "id")
    rows = spark.createDataFrame([("hot", 1), ("k1", 2), ("gone", 3)], "k string, v int")
    want = sorted((r.k, r.id, 1 if r.k == "hot" else 2) for r in many.collect() if r.k in ("hot", "k1"))
    assert sorted((r.k, r.id, r.v) for r in relational.spread_join(many, rows, "k", "id").collect()) == want
    assert relational.spread_join(many.limit(0), rows, "k", "id").count() == 0


def test_a_hot_key_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(relational, "FEW", 0)
    monkeypatch.setattr(relational, "SALT_ROWS", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id) end as k", "id")
        joined = relational.spread_join(many, many.select("k").distinct().withColumn("v", F.lit(1)), "k", "id")
        parts = [r["count"] for r in joined.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(parts) == 1000 and len(parts) > 2 and max(parts) < 600
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lowest_rows_of_groups(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.randint(0, 10**6), i) for i in range(600)]
    got = sorted((r.g, r.v, r.i) for r in relational.lowest(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], ["v", "i"], 5).collect())
    assert got == sorted(x for g in {r[0] for r in rows} for x in sorted(r for r in rows if r[0] == g)[:5])


def test_folders_that_are_there_are_not_written_again(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 3 as part")
    for some in (df.where("part = 1"), df, df):
        relational.write_missing(some, str(tmp_path / "w"), "part")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "w")).collect()) == list(range(10))


def test_moving_average_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 6)
    rng = random.Random(4)
    rows = [(k, rng.random(), i, float(rng.randint(0, 9))) for k in ("a", "b") for i in range(40)]
    got = {(r.k, r.i): r.m for r in ordered.moving_average(spark.createDataFrame(rows, "k string, o double, i int, v double"), "k", ["o", "i"], "v", 4, "m").collect()}
    for k in ("a", "b"):
        mine = sorted((o, i, v) for x, o, i, v in rows if x == k)
        for p, (_, i, _) in enumerate(mine):
            near = [v for *_, v in mine[max(0, p - 3) : p + 1]]
            assert got[k, i] == pytest.approx(sum(near) / len(near))
    assert len(got) == 80


def test_written_tables_are_released(spark):
    df = session.written(spark.range(5), "five")
    assert df.count() == 5 and session.release(spark) > 0 and session.release(spark) == 0


def test_flow_by_places():
    tree = C.parsed("a = 1\nb = a")
    assert ("a", (2, 4), "comesFrom", "a", (1, 0)) in G.C.flow_between(tree, lambda n: (n.lineno, n.col_offset))


def test_models_guess_every_held_out_row(spark):
    df = spark.range(400).selectExpr("id as vec_id", "array(cast(id % 2 as double), cast(id % 5 as double)) as embedding", "cast(id % 2 as int) as label")
    guesses = models.vector_guesses(df, "tree")
    assert models.accuracy(guesses) == 1.0 and guesses.count() == models.held_out(df, "vec_id")[1].count()
    line = df.selectExpr("vec_id", "cast(label as double) n", "cast(label * 2 + 1 as double) y")
    assert all(abs(r.guess - r.y) < 1e-6 for r in models.regression_guesses(line, "vec_id", ["n"], "y").collect())


def test_files_of_records_come_back(spark, tmp_path):
    raw = spark.createDataFrame([("f", 3, "2,1,b\r\n"), ("f", 1, '1,0,"a\nx"'), ("g", 9, "bad"), ("g", 1, None)], "file_name string, line_no int, record string")
    records.to_files(raw, str(tmp_path / "out"))
    out = records.load_files(spark, str(tmp_path / "out/*/*")).collect()
    assert sorted((r.kernel_id, r.source, r.reason) for r in out if not r.reason) == [(1, "a\nx", None), (2, "b", None)]
    assert [r.reason for r in out if r.reason] == ["column_count"]
