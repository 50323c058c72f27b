"""Semantic fixtures: each small input with the rows that must come out."""

import gzip
import math
import zlib

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.frame import Frame, desc, op
from tessera.functions import Agg, Do, na
from tessera.operators.bind import cbind, rbind
from tessera.operators.join import join
from tessera.sources import read_bytes, read_parquet, read_text
from tessera.streaming import append_files


@pytest.fixture
def worked(spark):
    rows = list(zip(range(10, 20), [99, 99, 0, 99, 99, 99, 0, 99, 99, 99], [0.0, 1.1, None, 3.3, 1.1, 2.2, None, 3.3, 4.4, 3.3], strict=True))
    return Frame.from_rows(spark, rows, "record_i int, int_col int, num_col double")


def frame(spark, schema, *rows):
    return Frame.from_rows(spark, list(rows), schema)


def test_worked_example(worked):
    kept = worked.filter(na.eq("int_col", 99))
    assert kept.get("record_i") == [10, 11, 13, 14, 15, 17, 18, 19]
    assert kept.sort("num_col").get("record_i") == [10, 11, 14, 15, 13, 17, 19, 18]
    first = dict(record_i=Agg.first("record_i"), int_col=Agg.first("int_col"))
    assert kept.group("num_col", sort=True).aggregate(**first).collect() == [(0.0, 10, 99), (1.1, 11, 99), (2.2, 15, 99), (3.3, 13, 99), (4.4, 18, 99)]
    assert kept.group("num_col").aggregate(**first).collect() == [(0.0, 10, 99), (1.1, 11, 99), (3.3, 13, 99), (2.2, 15, 99), (4.4, 18, 99)]


def test_sort_puts_na_first_both_ways(spark):
    nan = float("nan")
    f = frame(spark, "x double", (None,), (1.0,), (nan,), (-math.inf,), (math.inf,), (None,))
    assert str(f.sort("x").get("x")) == str([None, None, -math.inf, 1.0, math.inf, nan])
    assert str(f.sort(desc("x")).get("x")) == str([None, None, nan, math.inf, 1.0, -math.inf])
    assert f.sort("_x").get("x")[:2] == [None, None]


def test_filters_see_na_as_least(spark):
    f = frame(spark, "a int", (5,), (None,), (25,), (20,))
    for p, want in ((na.lt("a", 20), [5, None]), (na.gt("a", 20), [25]), (na.eq("a", 20), [20]), (na.ne("a", 20), [5, None, 25]), (na.le("a", 20), [5, None, 20]), (na.ge("a", 20), [25, 20])):
        assert f.filter(p).get("a") == want
    assert f.filter(na.is_none("a") | na.gt("a", 20)).get("a") == [None, 25]
    assert f.filter(~na.is_some("a")).get("a") == [None]
    assert f.filter(na.closure(lambda a: a is None or a > 20, "a")).get("a") == [None, 25]


def test_filter_two_columns(spark):
    f = frame(spark, "a int, b int", (1, 1), (None, None), (None, 2), (3, None))
    assert f.filter(na.ge("a", "b")).collect() == [(1, 1), (None, None), (3, None)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from([None, -1.0, 0.0, 2.0, math.nan, math.inf]), st.sampled_from([None, 0.0, 2.0, math.nan])), min_size=1, max_size=6))
def test_comparisons_against_a_model(spark, rows):
    def less(a, b):
        return b is not None if a is None else b is not None and a < b

    def same(a, b):
        return a is None and b is None or a is not None and b is not None and a == b

    model = {"lt": less, "gt": lambda a, b: less(b, a), "le": lambda a, b: a is None or b is not None and a <= b, "ge": lambda a, b: b is None or a is not None and a >= b, "eq": same, "ne": lambda a, b: not same(a, b)}
    f = frame(spark, "a double, b double", *rows)
    got = f.df.select(*(getattr(na, k)("a", "b").build(f.types).alias(k) for k in model), *(getattr(na, k)("a", 0.0).build(f.types).alias(f"{k}0") for k in model)).collect()
    for (a, b), r in zip(rows, got, strict=True):
        for k, fn in model.items():
            assert r[k] == fn(a, b), (k, a, b)
            assert r[f"{k}0"] == fn(a, 0.0), (k, a)


def test_aggregates_and_na(spark):
    f = frame(spark, "k int, v int", (1, 1), (1, None), (2, None))
    got = f.group("k", sort=True).aggregate(n=Agg.count("v"), n0=Agg.count("v", na=0), s=Agg.sum("v"), s0=Agg.sum("v", na=0), m=Agg.mean("v"), f=Agg.first("v"), h=Agg.has_data("v"), p=Agg.python(len, "v", "int"))
    assert got.collect() == [(1, 1, 1, 1, 1, 1.0, 1, True, 1), (2, None, 0, None, 0, None, None, None, None)]
    assert got.types["s"] == "int"
    g = frame(spark, "k int, v int", (1, None), (1, 5), (1, 7)).group("k").aggregate(a=Agg.first("v"), b=Agg.last("v"))
    assert g.collect() == [(1, 5, 7)]
    h = frame(spark, "k int, v double", (1, math.nan), (1, 2.0), (2, math.nan)).group("k", sort=True).aggregate(a=Agg.min_f64("v"), b=Agg.max_f64("v"))
    assert h.collect() == [(1, 2.0, 2.0), (2, math.inf, -math.inf)]
    with pytest.raises(Exception, match="(?i)overflow|out of range|cannot be represented"):
        frame(spark, "k int, v int", (1, 2**31 - 1), (1, 1)).group("k").aggregate(s=Agg.sum("v")).collect()
    assert f.filter(na.gt("k", 9)).group("k").aggregate(s=Agg.sum("v")).collect() == []
    assert f.group("k").aggregate().collect() == [(1,), (2,)]


def test_first_follows_descending_order(spark):
    f = frame(spark, "k int, s string, v int", (1, "a", 1), (1, "c", 2), (1, None, 3), (2, "b", 4))
    by = lambda *s: f.group("k", sort=["k", *s]).aggregate(a=Agg.first("v"), b=Agg.last("v")).collect()
    assert by(desc("s")) == [(1, 3, 1), (2, 4, 4)]
    assert by("s") == [(1, 3, 2), (2, 4, 4)]
    assert by(desc("v")) == [(1, 3, 1), (2, 4, 4)]


def test_group_by_many_keys_first_met(spark):
    f = frame(spark, "a string, b int, v int", ("y", 1, 1), ("x", 1, 2), ("y", 1, 3), ("x", None, 4))
    assert f.group("a", "b").aggregate(s=Agg.sum("v")).collect() == [("y", 1, 4), ("x", 1, 2), ("x", None, 4)]
    nine = frame(spark, ", ".join(f"c{i} int" for i in range(9)), tuple(range(9)))
    assert nine.sort(*nine.columns).group(*nine.columns).aggregate().count() == 1
    down = f.group(desc("a"), sort=True).aggregate(s=Agg.sum("v"))
    assert down.collect() == [("y", 4), ("x", 6)] and down.is_aggregated_by("a") and down.is_grouped_by("a")


def test_pivot(spark):
    f = frame(spark, "k int, p string, f int", (1, "x", 1), (1, "y", 2), (2, "x", None), (2, None, 4))
    got = f.pivot(["k"], "p")
    assert got.columns == ("k", "x", "y", "NA") and got.collect() == [(1, 1, 1, 0), (2, 1, 0, 1)]
    assert f.pivot(["k"], "p", fill=Agg.sum("f")).collect() == [(1, 1, 2, None), (2, None, None, 4)]
    assert f.pivot(["k"], "p", fill=Agg.sum("f", na=0)).collect() == [(1, 1, 2, 0), (2, 0, 0, 4)]
    assert f.pivot([desc("k")], "p", sort=True).get("k") == [2, 1]
    assert frame(spark, "k int, p boolean", (1, True)).pivot(["k"], "p", kind="bool").collect() == [(1, False, True)]
    with pytest.raises(ValueError, match="name of a key"):
        frame(spark, "x int, p string", (1, "x")).pivot(["x"], "p")


def test_factors(spark):
    f = Frame.from_rows(spark, [("A",), ("B",), (None,)], "c string", {"c": ["B", "A", "C"]})
    assert f.sort("c").get("c") == [None, "B", "A"]
    assert f.sort(desc("c")).get("c") == [None, "A", "B"]
    g = f.set(k=1).pivot(["k"], "c")
    assert g.columns == ("k", "B", "A", "C") and g.collect() == [(1, 1, 1, 0)]
    assert f.level_codes("c") == {"B": 0, "A": 1, "C": 2} and f.like().labels("c") == ["B", "A", "C"]
    assert f.to_spark().schema["c"].metadata == {"labels": ["B", "A", "C"]}
    assert rbind(f, f).labels("c") == ["B", "A", "C"]
    assert frame(spark, "c string", ("q",), ("p",), ("q",)).factorize("c").labels("c") == ["q", "p"]
    with pytest.raises(ValueError, match="without a label"):
        Frame.from_rows(spark, [("Z",)], "c string", {"c": ["A"]})
    assert "c" not in f.set(c=F.lit(1)).levels


def test_joins(spark):
    left = frame(spark, "k int, l string", (1, "a"), (None, "b"), (3, "c"))
    right = frame(spark, "k int, r string", (1, "x"), (None, "y"), (4, "z"))
    assert join([left, right], ["k"]).collect() == [(1, "a", "x"), (None, "b", "y")]
    assert join([left, right], ["k"], how="left").collect() == [(1, "a", "x"), (None, "b", "y"), (3, "c", None)]
    assert join([left, right], ["k"], how="outer", sort=True).collect() == [(None, "b", "y"), (1, "a", "x"), (3, "c", None), (4, None, "z")]
    two, three = frame(spark, "k int, a int", (1, 1), (1, 2)), frame(spark, "k int, b int", (1, 1), (1, 2), (1, 3))
    assert join([two, three], ["k"]).collect() == [(1, a, b) for a in (1, 2) for b in (1, 2, 3)]
    for bad, said in ((dict(how="outer"), "sorted"), (dict(how="right"), "no join"), (dict(cols=["q"]), "no column")):
        with pytest.raises(ValueError, match=said):
            join([left, right], ["k"], **bad)
    with pytest.raises(ValueError, match="must differ"):
        join([left, left], ["k"])
    with pytest.raises(ValueError, match="different types"):
        join([left, frame(spark, "k long, r string", (1, "x"))], ["k"])
    assert join([left, right, frame(spark, "k int, t int", (1, 7))], [desc("k")], sort=True).collect() == [(1, "a", "x", 7)]
    assert join([left, left.select("k")], ["k"]).count() == 3


def test_vector_functions(spark):
    f = frame(spark, "k int, v int", (1, 1), (1, None), (1, 3))
    got = f.group("k").transform(c=Do.cumsum("v"), q=Do.freq("v"), a=Do.add("v", "v"), n=Do.count("v"), s=Do.sum("v"), r=Do.na_replace("v", 0), h=Do.has_data("v"), m=Do.mean("v"), w=Do.sum_into("v", "long"))
    assert got.get("c") == [1, None, 4] and got.get("q") == [0.25, None, 0.75] and got.get("a") == [2, None, 6]
    assert got.get("n") == [2] * 3 and got.get("s") == [4] * 3 and got.get("r") == [1, 0, 3] and got.get("h") == [True] * 3 and got.get("m") == [2.0] * 3
    assert f.apply(Do.sum("v")) == [4] and f.apply(Do.cumsum("v")) == [1, None, 4] and f.apply(Do.count("v")) == [2]
    zero = frame(spark, "v int", (0,), (0,)).apply(Do.freq("v"))
    assert all(math.isnan(x) for x in zero)
    assert frame(spark, "v int", (None,)).apply(Do.sum("v")) == [None]
    b = frame(spark, "v boolean", (True,), (None,), (False,))
    assert b.apply(Do.true_freq("v")) == [0.5] and b.apply(Do.true_count("v")) == [1]


def test_do(spark):
    f = frame(spark, "k string, v int", ("b", 1), ("a", 2), ("b", 3), (None, 5))
    seen = f.group("k").do(lambda i, keys, rows: pd.DataFrame({"i": i, "k": keys["k"], "v": [list(rows["v"])[0]], "n": len(rows)}), "i long, k string, v int, n long")
    assert seen.collect() == [(0, "b", 1, 2), (1, "a", 2, 1), (2, None, 5, 1)]
    assert f.group("k", sort=True).do_values(lambda i, k, r: [v * 10 for v in r["v"]], "int") == [50, 20, 10, 30]


def test_set(spark):
    f = frame(spark, "a int", (10,), (20,), (None,))
    assert f.set(where=na.gt("a", 15), a=15, b=1).collect() == [(10, None), (15, 1), (None, None)]
    g = frame(spark, "a int, b double", (1, 2.0), (None, 3.0))
    assert g.set(c=op(lambda a, b: a + b, ("a", "b"), na=0.0)).get("c") == [3.0, 0.0]
    assert g.set(c=op(lambda a, b: a + b, ("a", "b"))).get("c") == [3.0, None]
    assert f.set(v=[7, None, 9], w=[1]).collect() == [(10, 7, 1), (20, None, 1), (None, 9, 1)]
    assert g.set(a=None).get("a") == [None, None] and g.set(a=None).types["a"] == "int"
    with pytest.raises(ValueError, match="2 values for 3 rows"):
        f.set(v=[1, 2])
    with pytest.raises(ValueError, match="exists"):
        f.add("a", 1)
    assert f.set_cell("a", 1, 5).get("a") == [10, 5, None] and f.cell("a", 0) == 10
    assert f.inject(f, n=Do.count("a"), c=Do.cumsum("a"), x="q").collect() == [(10, 2, 10, "q"), (20, 2, 30, "q"), (None, 2, None, "q")]


def test_columns(spark):
    f = frame(spark, "a int, b int, c int", (1, 2, 3))
    assert f.select("c", "a").collect() == [(3, 1)] and f.drop("b").columns == ("a", "c") and f.select().columns == f.columns
    assert f.drop().columns == f.columns and f.rename(a="z").columns == ("z", "b", "c")
    for bad in (lambda: f.select("q"), lambda: f.drop("q"), lambda: f.sort("q")):
        with pytest.raises(ValueError, match="no column"):
            bad()


def test_binds(spark):
    three, one = frame(spark, "a int", (1,), (2,), (3,)), frame(spark, "b string", ("x",))
    assert cbind(three, one).collect() == [(1, "x"), (2, "x"), (3, "x")]
    assert cbind(three, three.rename(a="b").sort(desc("b"))).collect() == [(1, 3), (2, 2), (3, 1)]
    assert cbind(three, Frame.empty(spark, "z int")).collect() == [(1, None), (2, None), (3, None)]
    with pytest.raises(ValueError, match="both have"):
        cbind(three, three)
    with pytest.raises(ValueError, match="3 and 2 rows"):
        cbind(three, frame(spark, "b int", (1,), (2,)))
    assert rbind(three, three.sort(desc("a"))).get("a") == [1, 2, 3, 3, 2, 1]
    for other in ("a long", "b int"):
        with pytest.raises(ValueError, match="same columns"):
            rbind(three, Frame.empty(spark, other))


def test_rows_and_index(spark):
    f = frame(spark, "k int, v int", (2, 1), (1, 2), (2, 3), (None, 4))
    x = f.index("k")
    assert [x.lookup(k=k).count() for k in (2, None, 9)] == [2, 1, 0] and x.lookup(k=2).get("v") == [1, 3]
    with pytest.raises(ValueError, match="indexed by"):
        x.lookup(v=1)
    with pytest.raises(ValueError, match="indexed by"):
        x.set(k=1).lookup(k=1)
    assert f.slice(1, 2).get("v") == [2, 3] and f.take_rows([3, 0, 3]).get("v") == [4, 1, 4]


def test_constructors(spark):
    f = Frame.from_columns(spark, "a int, b double, c string", a=[1, 2, 3], b=[0.5, None, 2.0], c="x")
    assert f.collect() == [(1, 0.5, "x"), (2, None, "x"), (3, 2.0, "x")]
    with pytest.raises(ValueError, match="2 values, not 3"):
        Frame.from_columns(spark, "a int, b int", a=[1, 2, 3], b=[1, 2])
    assert Frame.empty(spark, "a int", capacity=10).count() == 0 and Frame.empty(spark).columns == ()
    assert f.clone() == f and f.select() != f and f.like().is_empty() and f.reserve(5) is f


def test_text(spark, tmp_path, capsys):
    raw = b"col1,col2,col3\n1,1.0,true\n2,2.0,false\n3,3.0,true\n"
    f = read_bytes(spark, raw, "a int, b double, c boolean", sep=",", header=True)
    assert f.collect() == [(1, 1.0, True), (2, 2.0, False), (3, 3.0, True)]
    g = read_bytes(spark, b"NA\tT\tfalse\t\textra\n", "a int, b boolean, c boolean, d string")
    assert g.collect() == [(None, True, False, "")]
    for bad in (b"x\tT\n", b"1\tmaybe\n", b"1\n"):
        with pytest.raises(Exception, match="(?i)cast|no boolean|too few"):
            read_bytes(spark, bad, "a int, b boolean").collect()
    for name in ("t.csv", "t.csv.gz"):
        f.set(d=F.when(F.col("a") > 1, "q")).write_text(str(tmp_path / name), sep=",", header=True)
        again = read_text(spark, str(tmp_path / name), "a int, b double, c boolean, d string", sep=",", header=True)
        assert again.collect() == [(1, 1.0, True, None), (2, 2.0, False, "q"), (3, 3.0, True, "q")]
    for name in ("z.gz", "z.bgz"):
        (tmp_path / name).write_bytes(gzip.compress(raw))
        assert read_text(spark, str(tmp_path / name), "a int, b double, c boolean", sep=",", header=True).get("a") == [1, 2, 3]
    with pytest.raises(Exception, match="no label"):
        read_bytes(spark, b"Z\n", "c string", labels={"c": ["A"]}).collect()
    assert read_bytes(spark, b"Z\nA\n", "c string", labels={"c": ["A"]}, auto_label=True).labels("c") == ["A", "Z"]
    from tessera.sources import write_text

    write_text(f, header=True)
    assert capsys.readouterr().out.splitlines()[:2] == ["a\tb\tc", "1\t1.0\ttrue"]


def test_parquet_stream_and_print(spark, tmp_path):
    f = Frame.from_rows(spark, [("A", 1), ("B", None)], "c string, v int", {"c": ["B", "A"]})
    f.write_parquet(str(tmp_path / "p"))
    again = read_parquet(spark, str(tmp_path / "p"))
    assert sorted(again.collect(), key=str) == [("A", 1), ("B", None)] and again.labels("c") == ["B", "A"]
    text = f.show_text(rows=1)
    assert text.splitlines()[0] == "Frame: 2 rows x 2 columns" and "c <factor>" in text and text.endswith("...")
    append_files(spark, str(tmp_path / "p"), f.schema, lambda x: x.filter(na.gt("v", 0)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("A", 1)]


def test_filters_reach_the_scan(spark):
    f = read_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet").filter(na.lt("l_quantity", 5)).select("l_orderkey")
    plan = f.to_spark()._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity,5" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double" in plan


def test_edge_shapes(spark):
    f = frame(spark, "k int, v int", (1, None), (1, None))
    none = f.filter(na.gt("k", 5))
    assert none.sort("k").collect() == none.pivot(["k"], "v").collect() == []
    assert none.group("k").transform(s=Do.cumsum("v")).collect() == []
    assert join([none, f.rename(v="w")], ["k"], how="left").collect() == []
    assert f.group("k").aggregate(a=Agg.max("v"), b=Agg.max("v", na=0)).collect() == [(1, None, 0)]
    assert f.slice(5, 2).collect() == [] and none.show_text().startswith("Frame: 0 rows")


def test_status(spark):
    f = frame(spark, "a int, b int", (2, 1), (1, 2)).sort("a", desc("b"))
    assert f.is_sorted_by("a") and f.is_sorted_by("a", desc("b")) and not f.is_sorted_by("b")
    assert f.sort("a") is f and not f.set(b=1).is_sorted_by("a", desc("b")) and f.set(b=1).is_sorted_by("a")
    assert not f.sort(desc("a")).is_sorted_by("a")


def plan_of(f):
    return f.to_spark()._jdf.queryExecution().executedPlan().toString()


def test_whole_frame_vectors_take_no_single_task(spark):
    rows = [(i, None if i % 7 == 0 else i % 5, i / 8) for i in range(500)]
    f = frame(spark, "i int, v int, x double", *rows).sort(desc("i"))
    made = f.transform(c=Do.cumsum("v"), w=Do.cumsum_into("x", "double"))
    assert "SinglePartition" not in plan_of(made)
    total, want = 0, []
    for _, v, _ in reversed(rows):
        total += v or 0
        want.append(None if v is None else total)
    assert made.get("c") == want and made.get("w")[-1] == sum(x for *_, x in rows)
    share = f.transform(q=Do.freq("v")).get("q")
    assert sum(x for x in share if x is not None) == pytest.approx(1.0)
    assert "Window" not in plan_of(f.transform(q=Do.freq("v"), n=Do.count("v")))
    down = frame(spark, "s string, p int", *((f"s{i % 40:02}", i % 3) for i in range(300))).sort(desc("s"))
    assert down.pivot(["s"], "p").columns == ("s", "0", "1", "2")


def test_lookup_reads_the_index_by_range(spark):
    x = read_parquet(spark, "/root/testdata/sf0.001/orders.parquet").index("o_custkey")
    plan = plan_of(x.lookup(o_custkey=42).select("o_orderkey"))
    assert "FileScan parquet" in plan and "EqualTo(o_custkey,42)" in plan and "ExistingRDD" not in plan


def test_na_rm_vectors_and_sorted_groups(spark):
    f = frame(spark, "k int, v int", (2, 1), (1, None), (2, 3), (None, 4))
    assert f.apply(Do.na_rm("v")) == [1, 3, 4] and f.transform(w=Do.na_rm("v")).get("k") == [2, 2, None]
    assert f.group("k", sort=True).do_vector(lambda i, k, r: [v for v in r["v"] if v == v], "double", "v").get("v") == [4.0, 1.0, 3.0]
    assert f.sort(desc("k")).group().aggregate(n=Agg.count("v", na=0)).collect() == [(None, 1), (2, 2), (1, 0)]
    assert f.group(sort=["k"]).aggregate(n=Agg.count("v", na=0)).collect() == [(None, 1), (1, 0), (2, 2)]
    with pytest.raises(ValueError, match="sorted frame"):
        f.group()
    with pytest.raises(ValueError, match="before sort"):
        f.query().sort("k").filter(na.gt("v", 1))
    for twice in (lambda q: q.select("k").drop("v"), lambda q: q.group("k").group("v"), lambda q: q.sort("k").sort("v")):
        with pytest.raises(ValueError, match="once"):
            twice(f.query())
    assert f.query().filter(na.is_some("v")).sort("k").drop("k").frame().collect() == [(4,), (1,), (3,)]
    with pytest.raises(ValueError, match="takes an aggregate"):
        f.query().group("k").frame()


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    from tessera import session

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(RuntimeError, match="share"):
        session.shared_folder(Session)


def blocked(data, size):
    """BGZF: gzip members of ``size`` bytes of data with their size in the header."""
    out = b""
    for a in [*range(0, len(data), size), len(data)]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = data[a : a + size]
        body = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little")
        out += head + body + zlib.crc32(part).to_bytes(4, "little") + len(part).to_bytes(4, "little")
    return out


def test_blocked_files_are_read_in_parts(spark, tmp_path):
    rows = [(i, "é" * (i % 50) + f"x{i * 7919 % 1000}") for i in range(5000)]
    data = ("i\ts\n" + "".join(f"{i}\t{s}\n" for i, s in rows)).encode()
    path = str(tmp_path / "t.bgz")
    packed = blocked(data, 700)
    assert gzip.decompress(packed) == data
    (tmp_path / "t.bgz").write_bytes(packed)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        f = read_text(spark, path, "i int, s string", header=True)
        assert f.df.rdd.getNumPartitions() > 5 and f.collect() == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert read_text(spark, path, "i int, s string", header=True).collect() == rows
    # the mark by chance inside a block, one line over many parts, no line end
    stored = zlib.compressobj(0, zlib.DEFLATED, -15)
    inner = b"a\tBC\x02\x00" + b"z" * 90
    body = stored.compress(inner) + stored.flush()
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + (len(body) + 25).to_bytes(2, "little")
    (tmp_path / "u.bgz").write_bytes(head + body + zlib.crc32(inner).to_bytes(4, "little") + len(inner).to_bytes(4, "little"))
    assert read_text(spark, str(tmp_path / "u.bgz"), "a string, b string").collect() == [("a", "BC\x02\x00" + "z" * 90)]


@pytest.mark.parametrize("how", ["inner", "left", "outer"])
def test_join_cuts_keys_with_many_pairs(spark, how, monkeypatch):
    from tessera.operators import join as module

    nan = float("nan")
    left = frame(spark, "k double, j int, a int", *((k, j, i) for i, (k, j) in enumerate([(None, 1)] * 23 + [(0.0, 1), (-0.0, 1)] * 4 + [(nan, None)] * 7 + [(2.0, 1), (3.0, 1)])))
    right = frame(spark, "k double, j int, b int", *((k, j, i) for i, (k, j) in enumerate([(None, 1)] * 17 + [(None, 2)] * 30 + [(0.0, 1)] * 5 + [(nan, None)] * 6 + [(3.0, 1), (4.0, 1)])))
    third = frame(spark, "k double, j int, c int", *((k, j, i) for i, (k, j) in enumerate([(None, 1)] * 5 + [(-0.0, 1)] * 9 + [(5.0, 1)] * 3)))

    def rows(f):
        return sorted(map(repr, f.collect()))

    joins = [lambda: join([left, right], ["k", desc("j")], how=how, sort=True), lambda: join([left, right, third], ["k", "j"], how=how, sort=True)]
    want = [rows(j()) for j in joins]
    for block, heavy in ((5, 30), (1, 0)):
        monkeypatch.setattr(module, "BLOCK", block, raising=False)
        monkeypatch.setattr(module, "HEAVY", heavy, raising=False)
        assert [rows(j()) for j in joins] == want
    of = joins[1]().to_spark().groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in of) < sum(r["count"] for r in of) / 5
