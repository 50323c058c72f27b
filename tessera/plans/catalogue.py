"""Queries over the test tables, each with the SQL that gives the same rows.

The tables hold no NULL, so NA rules run on columns derived alike on both
sides.  Sums are taken over decimals, as float sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, desc, op
from ..functions import Agg, Do, na
from ..operators.bind import cbind, rbind
from ..operators.join import join
from ..session import shared_folder
from ..sources import read_bytes, read_parquet, read_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: read_parquet(spark, f"{sf_dir}/{name}.parquet")).to_spark()
        QUERIES[fn.__name__].__doc__ = fn.__doc__
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def with_na(f: Frame, name: str, column, when) -> Frame:
    """A column that is NA where ``when`` holds."""
    return f.set(**{name: F.when(~when, column)})


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
  avg(l_quantity) AS mean_qty, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price
FROM lineitem WHERE l_quantity < 25 GROUP BY l_returnflag, l_linestatus""")
def flagship(t):
    """Filter, group by two string keys, five aggregates."""
    f = t("lineitem").filter(na.lt("l_quantity", 25)).set(q=money("l_quantity"))
    out = f.group("l_returnflag", "l_linestatus", sort=True).aggregate(
        n=Agg.count("l_quantity"), sum_qty=Agg.sum("q"), mean_qty=Agg.mean("l_quantity"), min_price=Agg.min("l_extendedprice"), max_price=Agg.max("l_extendedprice")
    )
    return out.set(sum_qty=F.col("sum_qty").cast("double"))


_Q = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"


@query(f"SELECT l_orderkey, l_linenumber, q FROM (SELECT *, {_Q} AS q FROM lineitem) WHERE q IS NULL OR q < 25")
def filter_na_lt(t):
    f = with_na(t("lineitem"), "q", F.col("l_quantity"), F.col("l_linenumber") == 3)
    return f.filter(na.lt("q", 25)).select("l_orderkey", "l_linenumber", "q")


@query(f"SELECT l_orderkey, l_linenumber, q FROM (SELECT *, {_Q} AS q FROM lineitem) WHERE q > 25 AND (q IS DISTINCT FROM 30)")
def filter_na_gt_ne(t):
    f = with_na(t("lineitem"), "q", F.col("l_quantity"), F.col("l_linenumber") == 3)
    return f.filter(na.gt("q", 25), na.ne("q", 30)).select("l_orderkey", "l_linenumber", "q")


@query("""SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_partkey END AS a,
  CASE WHEN l_linenumber IN (2, 3) THEN NULL ELSE 10 * l_suppkey END AS b FROM lineitem) WHERE b IS NULL OR coalesce(a >= b, false)""")
def filter_two_col(t):
    """NA is the least value when two columns are compared."""
    f = with_na(t("lineitem"), "a", F.col("l_partkey"), F.col("l_linenumber") == 3)
    f = with_na(f, "b", 10 * F.col("l_suppkey"), F.col("l_linenumber").isin(2, 3))
    return f.filter(na.ge("a", "b")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 OR o_orderpriority = '1-URGENT'")
def filter_or(t):
    return t("orders").filter(na.gt("o_totalprice", 300000) | na.eq("o_orderpriority", na.value("1-URGENT"))).select("o_orderkey")


@query("SELECT c_mktsegment, c_custkey, c_name FROM customer")
def select_columns(t):
    return t("customer").select("c_mktsegment", "c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_columns(t):
    return t("customer").drop("c_acctbal", "c_mktsegment")


@query("""SELECT p_partkey, (row_number() OVER (ORDER BY s DESC NULLS FIRST, p_partkey) - 1)::BIGINT AS place
FROM (SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE p_size END AS s FROM part)""")
def sort_desc_multi(t):
    """Descending with NA first; the place proves the order."""
    f = with_na(t("part"), "s", F.col("p_size"), F.col("p_size") == 7).sort(desc("s"), "p_partkey")
    return Frame(f.numbered("place").select("p_partkey", "place"), ("p_partkey", "place"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS r FROM orders) WHERE r BETWEEN 101 AND 150")
def slice_rows(t):
    return t("orders").sort(desc("o_custkey"), "o_orderkey").slice(100, 50).select("o_orderkey", "o_custkey")


@query(f"""SELECT l_orderkey, l_linenumber, q + 1 AS u, q * l_discount AS b, q + l_tax + l_discount AS t3, coalesce(q, 0) AS r, coalesce(q + l_tax, -1) AS s
FROM (SELECT *, {_Q} AS q FROM lineitem)""")
def set_rowwise(t):
    """One, two and three inputs; NA in an input gives NA or its replacement."""
    f = with_na(t("lineitem"), "q", F.col("l_quantity"), F.col("l_linenumber") == 3)
    f = f.set(
        u=op(lambda a: a + 1, ("q",)), b=op(lambda a, b: a * b, ("q", "l_discount")), t3=op(lambda a, b, c: a + b + c, ("q", "l_tax", "l_discount")),
        r=op(lambda a: a, ("q",), na=0.0), s=op(lambda a, b: a + b, ("q", "l_tax"), na=-1.0),
    )
    return f.select("l_orderkey", "l_linenumber", "u", "b", "t3", "r", "s")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 0 ELSE o_custkey END AS o_custkey,
  CASE WHEN o_totalprice > 100000 THEN 1 END AS flag, CASE WHEN o_totalprice > 100000 THEN 1 END + 1 AS next FROM orders""")
def set_filtered(t):
    """Rows that the filter leaves out keep the old value, or have NA."""
    f = t("orders").set(where=na.gt("o_totalprice", 100000), o_custkey=0, flag=1).set(next=op(lambda a: a + 1, ("flag",)))
    return f.select("o_orderkey", "o_custkey", "flag", "next")


@query("""SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(2 * o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders
WHERE 2 * o_totalprice > 50000 GROUP BY o_orderstatus HAVING count(*) > 100""")
def chained(t):
    """Filter, set, filter, group, filter in one chain."""
    return t("orders").query(
        lambda f: f.set(twice=op(lambda a: 2 * a, ("o_totalprice",))),
        lambda f: f.filter(na.gt("twice", 50000)).set(twice=money("twice")),
        lambda f: f.group("o_orderstatus", sort=True).aggregate(n=Agg.count("o_orderkey"), total=Agg.sum("twice")),
        lambda f: f.filter(na.gt("n", 100)).set(total=F.col("total").cast("double")),
    )


_B = "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity > 25 END"


@query(f"""SELECT l_returnflag, CASE WHEN count(q) > 0 THEN true END AS has_data, nullif(count(q), 0) AS n, nullif(count(b), 0) AS nb,
  CASE WHEN count(b) > 0 THEN count(*) FILTER (WHERE b) END AS true_count, avg(b::INT) AS true_freq,
  CAST(sum(CAST(q AS BIGINT)) AS BIGINT) AS total, CAST(sum(l_linenumber) AS BIGINT) AS wide, avg(q) AS mean, min(q) AS low, max(q) AS high, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
FROM (SELECT *, {_Q} AS q, {_B} AS b FROM lineitem) GROUP BY l_returnflag""")
def agg_all_builtins(t):
    f = with_na(t("lineitem"), "q", F.col("l_quantity"), F.col("l_linenumber") == 3)
    f = with_na(f, "b", F.col("l_quantity") > 25, F.col("l_linenumber") % 2 != 0).set(qi=F.col("q").cast("long"))
    return f.group("l_returnflag", sort=True).aggregate(
        has_data=Agg.has_data("q"), n=Agg.count("q"), nb=Agg.count("b"), true_count=Agg.true_count("b"), true_freq=Agg.true_freq("b"),
        total=Agg.sum("qi"), wide=Agg.sum_into("l_linenumber", "long"), mean=Agg.mean("q"), low=Agg.min_f64("q"), high=Agg.max_f64("q"),
        first_ship=Agg.min("l_shipdate"), last_ship=Agg.max("l_shipdate"),
    )


@query("""SELECT o_custkey, arg_min(p, (o_orderdate, o_orderkey)) FILTER (WHERE p IS NOT NULL) AS first_price, arg_max(p, (o_orderdate, o_orderkey)) FILTER (WHERE p IS NOT NULL) AS last_price
FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) GROUP BY o_custkey""")
def agg_first_last(t):
    """First and last value that isn't NA, in the order of dates."""
    f = with_na(t("orders"), "p", F.col("o_totalprice"), F.col("o_orderkey") % 5 == 0)
    return f.group("o_custkey", sort=["o_custkey", "o_orderdate", "o_orderkey"]).aggregate(first_price=Agg.first("p"), last_price=Agg.last("p"))


@query("""SELECT user_id, coalesce(sum(v), 0)::BIGINT AS total, count(v) AS n, nullif(count(v), 0) AS n_or_na
FROM (SELECT user_id, CASE WHEN event_type = 'click' THEN event_id END AS v FROM events) GROUP BY user_id""")
def agg_na_replace(t):
    f = with_na(t("events"), "v", F.col("event_id"), F.col("event_type") != "click")
    return f.group("user_id").aggregate(total=Agg.sum("v", na=0), n=Agg.count("v", na=0), n_or_na=Agg.count("v"))


@query("""SELECT event_type, (dense_rank() OVER (ORDER BY first) - 1)::BIGINT AS group_i FROM (SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type)""")
def group_first_encounter(t):
    """Groups are numbered as they are first met."""
    return t("events").sort("event_id").group("event_type").numbers()


@query("""SELECT user_id, event_type, count(*) AS n, arg_min(event_id, event_id) AS first FROM events GROUP BY user_id, event_type""")
def group_multi_key_unsorted(t):
    return t("events").sort("event_id")._new(sorted_by=()).group("user_id", "event_type").aggregate(n=Agg.count("event_id"), first=Agg.first("event_id"))


@query("SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS spread, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey")
def agg_custom(t):
    return t("orders").group("o_custkey").aggregate(spread=Agg.expr(lambda c: F.max(c) - F.min(c), "o_totalprice"), kinds=Agg.expr(F.countDistinct, "o_orderpriority"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_keys(t):
    return t("orders").group("o_orderstatus", "o_orderpriority", sort=True).aggregate()


@query("""SELECT o_orderkey, CASE WHEN v IS NOT NULL THEN sum(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) END::BIGINT AS running,
  v / sum(v) OVER (PARTITION BY o_custkey) AS share, coalesce(v, 0) AS filled, v + o_custkey AS added, count(v) OVER (PARTITION BY o_custkey) AS n
FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1 + o_orderkey % 100 END AS v FROM orders)""")
def do_vectors(t):
    """Running sums, shares, replacement, sums of two columns, by group."""
    f = with_na(t("orders"), "v", 1 + F.col("o_orderkey") % 100, F.col("o_orderkey") % 5 == 0).sort("o_orderkey")
    out = f.group("o_custkey").transform(running=Do.cumsum_into("v", "long"), share=Do.freq("v"), filled=Do.na_replace("v", 0), added=Do.add("v", "o_custkey"), n=Do.count("v"))
    return out.select("o_orderkey", "running", "share", "filled", "added", "n")


@query("""SELECT c_nationkey, (dense_rank() OVER (ORDER BY c_nationkey) - 1)::BIGINT AS group_i, count(*) AS n, max(c_acctbal) AS best FROM customer GROUP BY c_nationkey""")
def do_custom(t):
    """An arbitrary Python function for each group."""
    import pandas as pd

    def each(i, keys, rows):
        return pd.DataFrame({"c_nationkey": keys["c_nationkey"], "group_i": i, "n": len(rows), "best": rows["c_acctbal"].max()})

    return t("customer").group("c_nationkey", sort=True).do(each, "c_nationkey int, group_i long, n long, best double")


@query("""SELECT o_orderstatus, count(*) FILTER (WHERE p = '1-URGENT') AS "1-URGENT", count(*) FILTER (WHERE p = '2-HIGH') AS "2-HIGH", count(*) FILTER (WHERE p IS NULL) AS "NA"
FROM (SELECT o_orderstatus, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS p FROM orders) GROUP BY o_orderstatus""")
def pivot_count(t):
    f = with_na(t("orders"), "p", F.col("o_orderpriority"), ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return f.pivot(["o_orderstatus"], "p")


@query("""SELECT l_suppkey, bool_or(NOT big) AS "false", bool_or(big) AS "true" FROM (SELECT l_suppkey, l_quantity > 49 AS big FROM lineitem) GROUP BY l_suppkey""")
def pivot_bool(t):
    return t("lineitem").set(big=F.col("l_quantity") > 49).pivot(["l_suppkey"], "big", kind="bool")


@query("""SELECT l_returnflag, l_linenumber, CAST(sum(q) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS "O", CAST(sum(q) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS "F",
  CAST(sum(q) FILTER (WHERE l_linestatus = 'X') AS BIGINT) AS "X" FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_returnflag, l_linenumber""")
def pivot_fill(t):
    """A factor gives all its labels, also those that no row has."""
    f = t("lineitem").set(q=F.col("l_quantity").cast("long")).set_labels("l_linestatus", ["O", "F", "X"])
    return f.pivot(["l_returnflag", "l_linenumber"], "l_linestatus", fill=Agg.sum("q"), sort=True)


@query("""SELECT l_returnflag, CAST(coalesce(sum(q) FILTER (WHERE l_linenumber = 1), 0) AS BIGINT) AS "1", CAST(coalesce(sum(q) FILTER (WHERE l_linenumber = 9), 0) AS BIGINT) AS "9"
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_returnflag""")
def pivot_fill_na(t):
    f = t("lineitem").set(q=F.col("l_quantity").cast("long"))
    return f.pivot(["l_returnflag"], "l_linenumber", fill=Agg.sum("q", na=0), labels=[1, 9], sort=[desc("l_returnflag")])


_CUST = "SELECT CASE WHEN c_custkey % 70 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey, c_name FROM customer"
_ORD = "SELECT CASE WHEN o_custkey % 110 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey FROM orders"


def _whole(t):
    """All customers and all orders; fewer NA keys, as each meets each."""
    a = with_na(t("customer"), "k", F.col("c_custkey"), F.col("c_custkey") % 70 == 0).select("k", "c_custkey", "c_name")
    b = with_na(t("orders"), "k", F.col("o_custkey"), F.col("o_custkey") % 110 == 0).select("k", "o_orderkey")
    return a, b


@query(f"SELECT a.k, c_custkey, c_name, o_orderkey FROM ({_CUST}) a JOIN ({_ORD}) b ON a.k IS NOT DISTINCT FROM b.k")
def join_inner(t):
    """NA keys match NA keys; duplicates multiply."""
    return join(_whole(t), ["k"])


@query(f"SELECT a.k, c_custkey, c_name, o_orderkey FROM ({_CUST}) a LEFT JOIN ({_ORD}) b ON a.k IS NOT DISTINCT FROM b.k")
def join_left(t):
    return join(_whole(t), ["k"], how="left", sort=True)


@query(f"SELECT coalesce(a.k, b.k) AS k, c_custkey, c_name, o_orderkey FROM ({_CUST}) a FULL JOIN ({_ORD}) b ON a.k IS NOT DISTINCT FROM b.k")
def join_outer(t):
    return join(_whole(t), ["k"], how="outer", sort=True)


@query("SELECT n_nationkey AS k, n_name, s_suppkey, c_custkey FROM nation JOIN supplier ON n_nationkey = s_nationkey JOIN customer ON n_nationkey = c_nationkey")
def join_nway(t):
    """Three whole frames on one key."""
    frames = [t("nation").rename(n_nationkey="k"), t("supplier").rename(s_nationkey="k"), t("customer").rename(c_nationkey="k")]
    return join(frames, ["k"], cols=["n_name", "s_suppkey", "c_custkey"], sort=True)


@query("SELECT o_orderkey AS k, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_match_only(t):
    return join([t("orders").rename(o_orderkey="k"), t("lineitem").rename(l_orderkey="k").select("k")], ["k"], cols=["o_orderdate"])


@query("SELECT o_orderkey AS k, o_orderdate, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 30000 AND l_extendedprice > 30000")
def join_filtered(t):
    """The join's filter is put to each frame, here to its own price."""
    a = t("orders").rename(o_orderkey="k", o_totalprice="price").select("k", "price", "o_orderdate")
    b = t("lineitem").rename(l_orderkey="k", l_extendedprice="price").select("k", "price", "l_linenumber")
    return join([a, b], ["k"], cols=["o_orderdate", "l_linenumber"], where=na.gt("price", 30000))


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem a JOIN (SELECT o_orderkey, o_custkey, 1 AS one FROM orders) b ON l_orderkey = o_orderkey AND l_linenumber = one")
def join_multi_key(t):
    b = t("orders").rename(o_orderkey="l_orderkey").set(l_linenumber=1)
    return join([t("lineitem").select("l_orderkey", "l_linenumber"), b], ["l_orderkey", desc("l_linenumber")], cols=["o_custkey"], sort=True)


@query("SELECT s_suppkey AS k, s_acctbal AS balance FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def rbind_two(t):
    return rbind(t("supplier").rename(s_suppkey="k", s_acctbal="balance").select("k", "balance"), t("customer").rename(c_custkey="k", c_acctbal="balance").select("k", "balance"))


@query("""SELECT r_name, n_name, 'x' AS mark FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region)
JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation WHERE n_nationkey < 5) USING (i)""")
def cbind_two(t):
    """Row by row; a frame of one row is recycled."""
    a = t("region").sort("r_regionkey").select("r_name")
    b = t("nation").filter(na.lt("n_nationkey", 5)).sort("n_nationkey").select("n_name")
    one = Frame.from_rows(a.df.sparkSession, [("x",)], "mark string")
    return cbind(a, b, one)


@query("""SELECT i AS place, n_name FROM (VALUES (0, 3), (1, 3), (2, 0)) v(i, p) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) USING (p)""")
def take_rows(t):
    f = t("nation").sort("n_nationkey").take_rows([3, 3, 0]).select("n_name")
    return Frame(f.numbered("place").selectExpr("cast(place as int) as place", "n_name"), ("place", "n_name"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 42")
def index_lookup(t):
    return t("orders").index("o_custkey").lookup(o_custkey=42).select("o_orderkey", "o_custkey")


_F = "list_position(['PROMO', 'ECONOMY', 'STANDARD'], split_part(p_type, ' ', 1)) - 1"


@query(f"""SELECT p_partkey, kind, code::INT AS code, (row_number() OVER (ORDER BY code NULLS FIRST, p_partkey) - 1)::BIGINT AS place
FROM (SELECT p_partkey, CASE WHEN {_F} >= 0 THEN split_part(p_type, ' ', 1) END AS kind, CASE WHEN {_F} >= 0 THEN {_F} END AS code FROM part)""")
def factor_sort(t):
    """A factor sorts by the codes of its labels."""
    names = ["PROMO", "ECONOMY", "STANDARD"]
    first = F.split("p_type", " ")[0]
    f = t("part").set(kind=F.when(first.isin(*names), first)).set_labels("kind", names)
    f = f.set(code=f.code("kind")).sort("kind", "p_partkey")
    return Frame(f.numbered("place").select("p_partkey", "kind", "code", "place"), ("p_partkey", "kind", "code", "place"))


@query("""SELECT p_brand AS label, (row_number() OVER (ORDER BY min(p_partkey)) - 1)::INT AS code FROM part GROUP BY p_brand""")
def factor_levels(t):
    """Labels in the order of first encounter."""
    f = t("part").sort("p_partkey").factorize("p_brand")
    return Frame.from_rows(f.df.sparkSession, list(f.level_codes("p_brand").items()), "label string, code int")


@query("SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS maybe FROM nation")
def csv_round_trip(t):
    """Written as text and read again, NA and all."""
    f = t("nation").sort("n_nationkey").set(maybe=F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    spark = f.df.sparkSession
    path = f"{shared_folder(spark)}/round-trip-{f.token}"
    f.write_text(path, sep=",", header=True)
    return read_text(spark, path, f.schema, sep=",", header=True)


@query("""SELECT r_name, total, CAST(2 AS INT) AS two FROM region, (SELECT CAST(sum(n_nationkey) AS INT) AS total FROM nation)""")
def inject_aggregate(t):
    """A value over another frame, recycled; and a constant."""
    return t("region").inject(t("nation"), total=Do.sum("n_nationkey"), two=2).select("r_name", "total", "two")


def _made(t, rows: list[tuple], schema: str) -> Frame:
    return Frame.from_rows(t("region").df.sparkSession, rows, schema)


def _raises(fn: Callable[[], object]) -> bool:
    """Whether ``fn`` refuses its arguments."""
    try:
        fn()
    except (ValueError, IndexError):
        return True
    return False


@query("SELECT * FROM (VALUES (1, 0.5, 'x'), (2, NULL, 'x'), (3, 2.0, 'x')) v(a, b, c)")
def make_from_columns(t):
    """A vector for each column, one value recycled."""
    return Frame.from_columns(t("region").df.sparkSession, "a int, b decimal(2,1), c string", a=[1, 2, 3], b=[Decimal("0.5"), None, Decimal("2.0")], c="x")


@query("SELECT * FROM (VALUES ('none', 0, 0, NULL), ('typed', 0, 2, NULL), ('labelled', 0, 1, 'b,a'), ('schema', 0, 3, NULL), ('like', 0, 3, 'b,a')) v(made, n_rows, n_columns, labels)")
def make_empty(t):
    """Frames without rows: of nothing, types, labels, a schema, another frame."""
    spark = t("region").df.sparkSession
    schema = t("nation").schema
    labelled = Frame.empty(spark, "c string", {"c": ["b", "a"]})
    made = {"none": Frame.empty(spark), "typed": Frame.empty(spark, "a int, b double", capacity=1000), "labelled": labelled, "schema": Frame.empty(spark, schema), "like": t("nation").set_labels("n_name", ["b", "a"]).like()}
    return _made(t, [(k, f.count(), len(f.columns), ",".join(f.labels(c[0])) if (c := list(f.levels)) else None) for k, f in made.items()], "made string, n_rows int, n_columns int, labels string")


@query("SELECT n_nationkey, n_name, true AS same, false AS touched FROM nation")
def clone_and_reserve(t):
    """A clone has the same rows and is equal; a changed frame isn't."""
    f = t("nation").select("n_nationkey", "n_name")
    copy = f.clone().reserve(1000)
    return copy.set(same=copy == f, touched=copy.set(n_nationkey=0) == f)


@query("""SELECT * FROM (VALUES (0, true, 'b', '', 1.5), (1, false, 'a', 'x', NULL), (2, NULL, NULL, NULL, -2.0), (3, true, 'c', 'y z', 0.0)) v(i, b, f, s, x)""")
def text_cells(t):
    """Booleans, labels (one that is new), empty strings, NA, cells too many."""
    raw = b"0,T,b,,1.5,more\n1,false,a,x,NA\n2,NA,NA,NA,-2\n3,TRUE,c,y z,0,a,b\n"
    f = read_bytes(t("region").df.sparkSession, raw, "i int, b boolean, f string, s string, x decimal(3,1)", sep=",", labels={"f": ["a", "b"]}, auto_label=True)
    if f.labels("f") != ["a", "b", "c"]:
        raise AssertionError(f.labels("f"))
    return f


@query("SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) IN ('PROMO', 'ECONOMY') THEN split_part(p_type, ' ', 1) END AS kind, p_size > 25 AS big FROM part")
def text_factor_round_trip(t):
    """A factor is written by its labels and read with them, gzipped."""
    names = ["PROMO", "ECONOMY"]
    first = F.split("p_type", " ")[0]
    f = t("part").set(kind=F.when(first.isin(*names), first), big=F.col("p_size") > 25).set_labels("kind", names).select("p_partkey", "kind", "big")
    path = f"{shared_folder(f.df.sparkSession)}/factors-{f.token}.gz"
    f.write_text(path)
    return read_text(f.df.sparkSession, path, f.schema, labels={"kind": names})


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def parquet_round_trip(t):
    """Saved and loaded."""
    f = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    path = f"{shared_folder(f.df.sparkSession)}/saved-{f.token}"
    f.write_parquet(path)
    return read_parquet(f.df.sparkSession, path)


@query("""SELECT * FROM (VALUES (0, 'Frame: 5 rows x 2 columns'), (1, 'r_regionkey <int> r_name <string>'), (3, '0 AFRICA'), (4, '1 AMERICA'), (5, '...')) v(i, line)""")
def print_rows(t):
    """Size, names with types, the first rows."""
    f = t("region").set(r_regionkey=F.col("r_regionkey").cast("int")).sort("r_regionkey").select("r_regionkey", "r_name")
    lines = [" ".join(x.split()) for x in f.show_text(rows=2).splitlines()]
    return _made(t, [(i, x) for i, x in enumerate(lines) if not x.startswith("--")], "i int, line string")


@query("SELECT s_name, s_suppkey FROM supplier")
def retain_columns(t):
    return t("supplier").retain("s_name", "s_suppkey")


@query("SELECT n_nationkey, n_regionkey, 7 AS seven, n_nationkey + 1 AS more, true AS refused FROM nation")
def add_columns(t):
    """A column can be added once."""
    f = t("nation").select("n_nationkey", "n_regionkey").add("seven", 7).add("more", op(lambda a: a + 1, ("n_nationkey",)))
    return f.set(refused=_raises(lambda: f.add("seven", 8)))


@query("SELECT r_regionkey, v, 9 AS w FROM region JOIN (VALUES (0, 'a'), (1, NULL), (2, 'c'), (3, 'd'), (4, 'e')) x(k, v) ON r_regionkey = k")
def set_vector(t):
    """A value for each row, in order; a list of one is recycled."""
    return t("region").sort("r_regionkey").set(v=["a", None, "c", "d", "e"], w=[9]).select("r_regionkey", "v", "w")


@query(f"""SELECT l_orderkey, l_linenumber, q * l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, coalesce(q + l_extendedprice + l_discount + l_tax, -1) AS total
FROM (SELECT *, {_Q} AS q FROM lineitem)""")
def set_four(t):
    """Four inputs."""
    f = with_na(t("lineitem"), "q", F.col("l_quantity"), F.col("l_linenumber") == 3)
    four = ("q", "l_extendedprice", "l_discount", "l_tax")
    f = f.set(charge=op(lambda q, p, d, x: q * p * (1 - d) * (1 + x), four), total=op(lambda q, p, d, x: q + p + d + x, four, na=-1.0))
    return f.select("l_orderkey", "l_linenumber", "charge", "total")


@query("SELECT o_orderkey, 3 * o_custkey AS a, 3 * o_custkey + 1 AS b, 6 * o_custkey + 1 AS c FROM orders")
def set_sequential(t):
    """In one call each statement sees what the ones before made."""
    f = t("orders").set(a=op(lambda k: 3 * k, ("o_custkey",)), b=op(lambda a: a + 1, ("a",)), c=op(lambda a, b: a + b, ("a", "b")))
    return f.select("o_orderkey", "a", "b", "c")


@query("""SELECT i, n_nationkey AS value, total, running FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, CAST(sum(n_nationkey) OVER () AS INT) AS total,
  CAST(sum(n_nationkey) OVER (ORDER BY n_nationkey) AS INT) AS running FROM nation)""")
def get_vectors(t):
    """A column's values and vector functions of it, as lists."""
    f = t("nation").sort("n_nationkey")
    values, total, running = f.get("n_nationkey"), f.apply(Do.sum("n_nationkey")), f.apply(Do.cumsum("n_nationkey"))
    return _made(t, [(i, v, total[0], r) for i, (v, r) in enumerate(zip(values, running, strict=True))], "i long, value int, total int, running int")


@query("SELECT r_regionkey, CASE r_regionkey WHEN 2 THEN 'changed' ELSE r_name END AS r_name, 'AMERICA' AS cell FROM region")
def cells(t):
    """One cell read, another set, by row number."""
    f = t("region").sort("r_regionkey")
    return f.set_cell("r_name", 2, "changed").set(cell=f.cell("r_name", 1)).select("r_regionkey", "r_name", "cell")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + 100 * l_discount > 500 * l_tax")
def filter_three_columns(t):
    """A predicate of three columns."""
    return t("lineitem").filter(na.expr(lambda q, d, x: q + 100 * d > 500 * x, "l_quantity", "l_discount", "l_tax")).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey, (row_number() OVER (ORDER BY b DESC NULLS FIRST, p_name, p_partkey) - 1)::BIGINT AS place
FROM (SELECT p_partkey, p_name, CASE WHEN p_brand <> 'Brand#11' THEN p_brand END AS b FROM part)""")
def sort_strings(t):
    """Strings, descending with NA first, then ascending."""
    f = with_na(t("part"), "b", F.col("p_brand"), F.col("p_brand") == "Brand#11").sort(desc("b"), "p_name", "p_partkey")
    return Frame(f.numbered("place").select("p_partkey", "place"), ("p_partkey", "place"))


@query("SELECT c_custkey, true AS kept, false AS other, true AS sorted FROM customer")
def sort_again(t):
    """A frame that is sorted by the keys stays as it is."""
    f = t("customer").sort("c_nationkey", desc("c_acctbal"))
    return f.set(kept=f.sort("c_nationkey") is f, other=f.sort("c_acctbal") is f, sorted=f.is_sorted_by("c_nationkey", desc("c_acctbal"))).select("c_custkey", "kept", "other", "sorted")


@query("""SELECT o_orderkey, count(v) OVER w > 0 AS has_data, CASE WHEN count(v) OVER w > 0 THEN CAST(sum(v) OVER w AS BIGINT) END AS total, avg(v) OVER w AS mean,
  CASE WHEN count(b) OVER w > 0 THEN count(*) FILTER (WHERE b) OVER w END AS true_count, avg(b::INT) OVER w AS true_freq
FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN 1 + o_orderkey % 100 END AS v, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice > 100000 END AS b FROM orders) WINDOW w AS (PARTITION BY o_custkey)""")
def do_scalars(t):
    """Vector functions of one value for each group."""
    f = with_na(t("orders"), "v", 1 + F.col("o_orderkey") % 100, F.col("o_orderkey") % 5 == 0)
    f = with_na(f, "b", F.col("o_totalprice") > 100000, F.col("o_orderkey") % 3 == 0)
    out = f.group("o_custkey").transform(has_data=Do.has_data("v"), total=Do.sum_into("v", "long"), mean=Do.mean("v"), true_count=Do.true_count("b"), true_freq=Do.true_freq("b"))
    return out.select("o_orderkey", "has_data", "total", "mean", "true_count", "true_freq")


@query("""SELECT o_orderkey, CASE WHEN v IS NOT NULL THEN CAST(sum(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) END AS running
FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(1 + o_orderkey % 100 AS INT) END AS v FROM orders)""")
def do_cumsum(t):
    f = with_na(t("orders"), "v", (1 + F.col("o_orderkey") % 100).cast("int"), F.col("o_orderkey") % 5 == 0).sort("o_orderkey")
    return f.group("o_custkey").transform(running=Do.cumsum("v")).select("o_orderkey", "running")


@query("""SELECT o_orderkey, CASE WHEN v IS NOT NULL THEN CAST(sum(v) OVER (ORDER BY o_orderkey) AS BIGINT) END AS running, v / sum(v) OVER () AS share
FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN 1 + o_orderkey % 100 END AS v FROM orders)""")
def do_whole_frame(t):
    """Running sums and shares over all rows."""
    f = with_na(t("orders"), "v", 1 + F.col("o_orderkey") % 100, F.col("o_orderkey") % 5 == 0).sort("o_orderkey")
    return f.transform(running=Do.cumsum_into("v", "long"), share=Do.freq("v")).select("o_orderkey", "running", "share")


@query("""SELECT o_orderkey, v, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS place
FROM (SELECT *, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS v FROM orders) WHERE v IS NOT NULL""")
def do_na_rm(t):
    """Rows without a value are dropped, the others keep their order."""
    f = with_na(t("orders"), "p", F.col("o_custkey"), F.col("o_orderkey") % 5 == 0).sort("o_orderkey").transform(v=Do.na_rm("p"))
    return Frame(f.numbered("place").select("o_orderkey", "v", "place"), ("o_orderkey", "v", "place"))


@query("""SELECT best AS value, (row_number() OVER (ORDER BY c_nationkey, best DESC) - 1)::BIGINT AS place
FROM (SELECT c_nationkey, unnest([max(c_acctbal), min(c_acctbal)]) AS best FROM customer GROUP BY c_nationkey)""")
def do_vector_frame(t):
    """A list for each group, all in a row as one column."""
    f = t("customer").group("c_nationkey", sort=True).do_vector(lambda i, k, r: [r["c_acctbal"].max(), r["c_acctbal"].min()], "double")
    return Frame(f.numbered("place").select("value", "place"), ("value", "place"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY ALL")
def group_by_sort_alone(t):
    """A group without keys takes those of the sort."""
    f = t("orders").set(price=money("o_totalprice")).sort("o_orderpriority", desc("o_orderstatus"))
    return f.group().aggregate(n=Agg.count("o_orderkey"), total=Agg.sum("price")).set(total=F.col("total").cast("double"))


@query("""SELECT o_orderpriority, n, true AS late_filter, true AS two_filters, true AS no_group FROM
(SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority)""")
def query_placement(t):
    """One query's statements, and those that come in a wrong place."""
    f = t("orders")
    big = na.gt("o_totalprice", 100000)
    out = f.query().filter(big).sort("o_orderpriority").select("o_orderpriority", "n").aggregate(n=Agg.count("o_orderkey"), top=Agg.max("o_totalprice"))
    wrong = {
        "late_filter": lambda: f.query().sort("o_custkey").filter(big),
        "two_filters": lambda: f.query().filter(big).filter(big),
        "no_group": lambda: f.query().filter(big).aggregate(n=Agg.count("o_orderkey")),
    }
    return out.set(**{k: _raises(fn) for k, fn in wrong.items()})


@query("SELECT * FROM (VALUES ('outer unsorted', true), ('kind', true), ('no column', true), ('same column', true), ('type', true), ('one frame', true), ('no key', true)) v(what, refused)")
def join_checks(t):
    a, b = t("nation").rename(n_nationkey="k"), t("region").rename(r_regionkey="k")
    wrong = {
        "outer unsorted": lambda: join([a, b], ["k"], how="outer"),
        "kind": lambda: join([a, b], ["k"], how="right"),
        "no column": lambda: join([a, b], ["k"], cols=["q"]),
        "same column": lambda: join([a, a], ["k"]),
        "type": lambda: join([a, b.set(k=F.col("k").cast("string"))], ["k"]),
        "one frame": lambda: join([a], ["k"]),
        "no key": lambda: join([a, b], []),
    }
    return _made(t, [(k, _raises(fn)) for k, fn in wrong.items()], "what string, refused boolean")


@query("""SELECT p_partkey, kind, CASE kind WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'ECONOMY' THEN 2 END AS code FROM (
  SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) IN ('PROMO', 'SMALL') THEN split_part(p_type, ' ', 1) END AS kind FROM part
  UNION ALL SELECT p_partkey, CASE WHEN split_part(p_type, ' ', 1) IN ('ECONOMY', 'PROMO') THEN split_part(p_type, ' ', 1) END FROM part)""")
def rbind_factors(t):
    """The labels are those of the first frame, then new ones of the others."""
    first = F.split("p_type", " ")[0]
    parts = [t("part").set(kind=F.when(first.isin(*x), first)).set_labels("kind", x).select("p_partkey", "kind") for x in (["PROMO", "SMALL"], ["ECONOMY", "PROMO"])]
    f = rbind(*parts)
    return f.set(code=f.code("kind"))


@query("""SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS i FROM customer)
JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 20 AS i FROM orders) USING (i) WHERE i <= 40""")
def cbind_slice(t):
    """A slice of one frame beside a slice of another."""
    return cbind(t("customer").sort("c_custkey").select("c_custkey").slice(0, 40), t("orders").sort("o_orderkey").select("o_orderkey").slice(20, 40))


@query("SELECT o_orderkey, true AS indexed, true AS refused FROM orders WHERE o_custkey = 42 AND o_orderstatus = 'O'")
def index_invalidated(t):
    """An index of two keys; a changed frame has none."""
    f = t("orders").index("o_custkey", "o_orderstatus")
    changed = f.set(o_totalprice=0.0)
    out = f.lookup(o_custkey=42, o_orderstatus="O").select("o_orderkey")
    return out.set(indexed=f.index_keys == ("o_custkey", "o_orderstatus"), refused=_raises(lambda: changed.lookup(o_custkey=42, o_orderstatus="O")))


@query("SELECT s_suppkey, kind, CASE kind WHEN 'odd' THEN 0 ELSE 1 END AS code FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN 'odd' ELSE 'even' END AS kind FROM supplier)")
def copy_labels(t):
    """A factor with the labels of another frame's."""
    other = t("region").set(x=F.lit("odd")).set_labels("x", ["odd", "even"])
    f = t("supplier").set(kind=F.when(F.col("s_suppkey") % 2 == 1, "odd").otherwise("even")).copy_labels("kind", other, "x")
    return f.set(code=f.code("kind")).select("s_suppkey", "kind", "code")


@query("""SELECT * FROM (VALUES ('sorted', true), ('by a prefix', true), ('by another', false), ('grouped', true), ('aggregated', true), ('after a change', false),
  ('after dropping another', true), ('after sorting anew', false), ('after filtering', true)) v(what, answer)""")
def status(t):
    """Sorted, grouped and aggregated, as operators keep or lose it."""
    f = t("orders").sort("o_orderpriority", "o_orderstatus")
    g = f.group("o_orderpriority", "o_orderstatus").aggregate(n=Agg.count("o_orderkey"))
    answers = {
        "sorted": f.is_sorted_by("o_orderpriority", "o_orderstatus"),
        "by a prefix": f.is_sorted_by("o_orderpriority"),
        "by another": f.is_sorted_by("o_orderstatus"),
        "grouped": g.is_grouped_by("o_orderpriority", "o_orderstatus"),
        "aggregated": g.is_aggregated_by("o_orderstatus", "o_orderpriority"),
        "after a change": g.set(o_orderstatus="x").is_aggregated_by("o_orderpriority", "o_orderstatus"),
        "after dropping another": g.drop("n").is_grouped_by("o_orderpriority", "o_orderstatus"),
        "after sorting anew": g.sort("n").is_grouped_by("o_orderpriority", "o_orderstatus"),
        "after filtering": f.filter(na.gt("o_totalprice", 0)).is_sorted_by("o_orderpriority"),
    }
    return _made(t, list(answers.items()), "what string, answer boolean")


@query("""SELECT i, s, d, b, ts, count(*) AS n FROM (SELECT CASE WHEN l_linenumber < 4 THEN l_linenumber END AS i, CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS s,
  CASE WHEN l_tax < 0.05 THEN l_tax END AS d, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity > 25 END AS b, CAST(date_trunc('year', l_shipdate) AS DATE) AS ts FROM lineitem) GROUP BY ALL""")
def group_by_keys_of_all_types(t):
    """Keys of five types, each with NA."""
    f = t("lineitem")
    f = with_na(f, "i", F.col("l_linenumber"), F.col("l_linenumber") >= 4)
    f = with_na(f, "s", F.col("l_returnflag"), F.col("l_returnflag") == "A")
    f = with_na(f, "d", F.col("l_tax"), F.col("l_tax") >= 0.05)
    f = with_na(f, "b", F.col("l_quantity") > 25, F.col("l_linenumber") % 2 != 0).set(ts=F.trunc("l_shipdate", "year"))
    return f.group("i", "s", "d", "b", "ts").aggregate(n=Agg.count("l_orderkey"))
