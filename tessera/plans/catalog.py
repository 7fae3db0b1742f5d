"""Queries over the driver tables and their DuckDB counterparts.

Every query runs over its whole tables. Causal queries take each user's events
as a causal set of its own, so their size follows the number of users.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.frames import spread
from tessera.operators import blocks, causal, elementwise, indexing, linalg, products, reductions
from tessera.operators.array import Matrix, Vector
from tessera.sources import constructors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(x, digits: int | None = None) -> DataFrame:
    """Coordinates as they are compared: rounded, without negative zeros."""
    if digits is None:
        return x.df
    return x.df.withColumn("v", F.round(F.col("v").cast("double"), digits) + F.lit(0.0))


def one_row(spark: SparkSession, value: float) -> DataFrame:
    return spark.createDataFrame([(float(value),)], "v double")


# Matrices of the tables, with their SQL as common tables

SQL_Q = "q as (select l_partkey as i, l_suppkey as j, sum(l_quantity) as v from lineitem group by 1, 2)"
SQL_R = "r as (select l_partkey as i, l_suppkey as j, cast(sum(l_linenumber) as double) as v from lineitem group by 1, 2)"
SQL_L = "l as (select l_suppkey as i, cast(l_linenumber as bigint) as j, sum(l_quantity) as v from lineitem group by 1, 2)"
SQL_K = "k as (select l_suppkey as i, cast(l_linenumber as bigint) as j, cast(count(*) as double) as v from lineitem where l_returnflag = 'R' group by 1, 2)"
SQL_GRID = "g as (select s.range as i, c.range as j from range((select max(l_suppkey) + 1 from lineitem)) s, range((select max(l_linenumber) + 1 from lineitem)) c)"
SQL_X = "x as (select l_partkey as i, l_suppkey as j from lineitem where l_returnflag = 'R' group by 1, 2)"
SQL_Y = "y as (select l_partkey as i, l_suppkey as j from lineitem where l_linestatus = 'O' group by 1, 2)"
SQL_P = "p as (select p_partkey as i, cast(p_size as double) as v from part)"
SQL_S = "s as (select s_suppkey as i, cast(s_nationkey as double) as v from supplier)"
SQL_E = "e as (select vec_id as i, cast(unnest(range(len(embedding))) as bigint) as j, cast(unnest(embedding) as double) as v from embeddings)"
SQL_O = "o as (select o_orderkey as i, cast(o_custkey as double) as x, o_totalprice as y from orders)"
SQL_N = "c as (select cast(a.n_nationkey as bigint) as i, cast(b.n_nationkey as bigint) as j from nation a, nation b where a.n_nationkey < b.n_nationkey and a.n_regionkey < b.n_regionkey)"


def _size(spark, d, name, column) -> int:
    return int(table(spark, d, name).agg(F.max(column)).first()[0]) + 1


def _pairs(spark, d, value, where=None, cols=("l_partkey", "l_suppkey")) -> DataFrame:
    rows = table(spark, d, "lineitem")
    rows = rows.filter(where) if where is not None else rows
    rows = rows.withColumn("i", F.col(cols[0]).cast("bigint")).withColumn("j", F.col(cols[1]).cast("bigint"))
    if "l_linenumber" not in cols:  # pairs of part and supplier hardly repeat: nothing is gained by sums before the shuffle
        rows = spread(rows, ["i", "j"])
    return rows.groupBy("i", "j").agg(value.alias("v"))


def _shape(spark, d):
    return _size(spark, d, "part", "p_partkey"), _size(spark, d, "supplier", "s_suppkey")


def quantities(spark, d) -> Matrix:
    return Matrix(_pairs(spark, d, F.sum("l_quantity")), *_shape(spark, d), "float64")


def lines(spark, d) -> Matrix:
    return Matrix(_pairs(spark, d, F.sum("l_linenumber").cast("double")), *_shape(spark, d), "float64")


def _dense_shape(spark, d):
    row = table(spark, d, "lineitem").agg(F.max("l_suppkey").alias("a"), F.max("l_linenumber").alias("b")).first()
    return row["a"] + 1, row["b"] + 1


def by_line(spark, d) -> Matrix:
    return Matrix(_pairs(spark, d, F.sum("l_quantity"), cols=("l_suppkey", "l_linenumber")), *_dense_shape(spark, d), "float64")


def returned_by_line(spark, d) -> Matrix:
    return Matrix(_pairs(spark, d, F.count("*").cast("double"), F.col("l_returnflag") == "R", ("l_suppkey", "l_linenumber")), *_dense_shape(spark, d), "float64")


def returned(spark, d) -> Matrix:
    return Matrix(_pairs(spark, d, F.lit(True), F.col("l_returnflag") == "R"), *_shape(spark, d), "bit")


def open_(spark, d) -> Matrix:
    return Matrix(_pairs(spark, d, F.lit(True), F.col("l_linestatus") == "O"), *_shape(spark, d), "bit")


def sizes(spark, d) -> Vector:
    return Vector(table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("v")), _size(spark, d, "part", "p_partkey"), "float64")


def nations(spark, d) -> Vector:
    return Vector(table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("double").alias("v")), _size(spark, d, "supplier", "s_suppkey"), "float64")


def embedding_matrix(spark, d) -> Matrix:
    e = table(spark, d, "embeddings")
    df = e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    row = e.agg(F.max("vec_id").alias("n"), F.max(F.size("embedding")).alias("m")).first()
    return Matrix(df, row["n"] + 1, row["m"], "float64")


# Products


@query(f"with {SQL_Q} select a.j as i, b.j as j, sum(a.v * b.v) as v from q a join q b using (i) group by 1, 2")
def spmm_part_supplier_gram(spark, d):
    q = quantities(spark, d)
    return (q.T @ q).df


@query(f"with {SQL_Q}, {SQL_P} select q.j as i, sum(q.v * p.v) as v from q join p using (i) group by 1")
def spmv_supplier_load(spark, d):
    return (quantities(spark, d).T @ sizes(spark, d)).df


@query(f"with {SQL_Q}, {SQL_S} select q.i, sum(q.v * s.v) as v from q join s on q.j = s.i group by 1")
def vecmat_part_total(spark, d):
    return (nations(spark, d).T @ quantities(spark, d).T).df


@query(f"with {SQL_Q}, {SQL_P} select q.i, q.j, q.v * p.v as v from q join p using (i)")
def diag_scale(spark, d):
    return (constructors.diagonal_matrix(sizes(spark, d)) @ quantities(spark, d)).df


@query(f"with {SQL_X}, {SQL_Y} select x.j as i, y.j as j, cast(count(*) as integer) as v from x join y using (i) group by 1, 2")
def bitbit_count(spark, d):
    return (returned(spark, d).T @ open_(spark, d)).df


@query(f"with {SQL_X}, {SQL_Q} select x.j as i, q.j as j, sum(q.v) as v from x join q using (i) group by 1, 2")
def bit_float_matmul(spark, d):
    return (returned(spark, d).T @ quantities(spark, d)).df


@query(f"with {SQL_R} select a.j as i, b.j as j, cast(sum(cast(a.v as bigint) * cast(b.v as bigint)) as integer) as v from r a join r b using (i) group by 1, 2")
def int_matmul(spark, d):
    m = lines(spark, d).as_type("int32")
    return (m.T @ m).df


@query(f"with {SQL_E} select a.j as i, b.j as j, round(sum(a.v * b.v), 4) + 0.0 as v from e a join e b using (i) group by 1, 2")
def block_matmul_embeddings(spark, d):
    e = embedding_matrix(spark, d)
    return cells(products.matmul(e.T, e, layout="block"), 4)


@query("select cast(n_nationkey as bigint) as i, cast(r_regionkey as bigint) as j, cast(n_regionkey as double) * (r_regionkey + 1) as v from nation, region")
def outer_small(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    u = Vector(n.select(F.col("n_nationkey").cast("bigint").alias("i"), F.col("n_regionkey").cast("double").alias("v")), n.count(), "float64")
    v = Vector(r.select(F.col("r_regionkey").cast("bigint").alias("i"), (F.col("r_regionkey") + 1).cast("double").alias("v")), r.count(), "float64", True)
    return (u @ v).df


@query("with c as (select cast(a.n_nationkey as bigint) as i, cast(b.n_nationkey as bigint) as j, cast(a.n_regionkey + b.n_regionkey as double) as v from nation a, nation b where a.n_nationkey < b.n_nationkey) select a.i, b.j, sum(a.v * b.v) as v from c a join c b on a.j = b.i group by 1, 2")
def triangular_matmul(spark, d):
    n = table(spark, d, "nation")
    a, b = (n.select(F.col("n_nationkey").cast("bigint").alias(k), F.col("n_regionkey").alias(f"r{k}")) for k in "ij")
    m = Matrix(a.join(b, F.col("i") < F.col("j")).select("i", "j", (F.col("ri") + F.col("rj")).cast("double").alias("v")), n.count(), n.count(), "float64", "triangular")
    return (m @ m).df


# Elementwise


@query(f"with {SQL_Q}, {SQL_R} select i, j, q.v * r.v as v from q join r using (i, j)")
def hadamard(spark, d):
    return (quantities(spark, d) * lines(spark, d)).df


@query(f"with {SQL_Q}, {SQL_R} select i, j, coalesce(q.v, 0) + coalesce(r.v, 0) as v from q full join r using (i, j)")
def add(spark, d):
    return (quantities(spark, d) + lines(spark, d)).df


@query(f"with {SQL_Q}, {SQL_R} select i, j, coalesce(q.v, 0) - coalesce(r.v, 0) as v from q full join r using (i, j)")
def sub(spark, d):
    return (quantities(spark, d) - lines(spark, d)).df


@query(f"with {SQL_Q}, {SQL_R} select i, j, 2 * q.v + r.v as v from q join r using (i, j)")
def add_many(spark, d):
    q = quantities(spark, d)
    return elementwise.add_all(q, lines(spark, d), q).df


@query(f"with {SQL_L}, {SQL_K}, {SQL_GRID} select g.i, g.j, coalesce(k.v, 0) / coalesce(l.v, 0) as v from g left join k using (i, j) left join l using (i, j)")
def divide(spark, d):
    return elementwise.divide(returned_by_line(spark, d), by_line(spark, d)).df


@query(f"with {SQL_Q} select i, j, v * 2.5 as v from q")
def scale(spark, d):
    return (quantities(spark, d) * 2.5).df


@query(f"with {SQL_Q} select i, j, v / 4 as v from q")
def divide_scalar(spark, d):
    return (quantities(spark, d) / 4.0).df


@query(f"with {SQL_L}, {SQL_GRID} select g.i, g.j, coalesce(l.v, 0) + 1.5 as v from g left join l using (i, j)")
def add_scalar(spark, d):
    return (by_line(spark, d) + 1.5).df


@query(f"with {SQL_L}, {SQL_GRID} select g.i, g.j, 10 - coalesce(l.v, 0) as v from g left join l using (i, j)")
def scalar_minus(spark, d):
    return (10.0 - by_line(spark, d)).df


@query(f"with {SQL_Q} select i, j, -v as v from q")
def negate(spark, d):
    return (-quantities(spark, d)).df


@query(f"with {SQL_Q} select i, j, round(sin(v), 6) + 0.0 as v from q")
def sine(spark, d):
    return cells(elementwise.sin(quantities(spark, d)), 6)


@query(f"with {SQL_L}, {SQL_GRID} select g.i, g.j, round(cos(coalesce(l.v, 0)), 6) + 0.0 as v from g left join l using (i, j)")
def cosine(spark, d):
    return cells(elementwise.cos(by_line(spark, d)), 6)


@query(f"with {SQL_K}, {SQL_GRID} select g.i, g.j, round(exp(coalesce(k.v, 0) / -8), 6) + 0.0 as v from g left join k using (i, j)")
def exponential(spark, d):
    return cells(elementwise.exp(returned_by_line(spark, d) / -8.0), 6)


@query(f"with {SQL_Q} select i, j, round(sqrt(v), 6) as v from q")
def square_root(spark, d):
    return cells(elementwise.sqrt(quantities(spark, d)), 6)


@query(f"with {SQL_Q}, {SQL_R} select i, j, abs(q.v - r.v * 9) as v from q join r using (i, j)")
def absolute(spark, d):
    return elementwise.absolute(quantities(spark, d) - lines(spark, d) * 9.0).df


@query(f"with {SQL_Q}, {SQL_S} select q.i, q.j, q.v * s.v as v from q join s on q.j = s.i")
def row_broadcast(spark, d):
    return (quantities(spark, d) * nations(spark, d).T).df


@query(f"with {SQL_X}, {SQL_Y} select i, j, true as v from (select * from x intersect select * from y)")
def bit_and(spark, d):
    return (returned(spark, d) & open_(spark, d)).df


@query(f"with {SQL_X}, {SQL_Y} select i, j, true as v from (select * from x union select * from y)")
def bit_or(spark, d):
    return (returned(spark, d) | open_(spark, d)).df


@query(f"with {SQL_X}, {SQL_Y} select i, j, true as v from ((select * from x except select * from y) union all (select * from y except select * from x))")
def bit_xor(spark, d):
    return (returned(spark, d) ^ open_(spark, d)).df


@query(f"with {SQL_K}, {SQL_GRID} select g.i, g.j, true as v from g where not exists (select 1 from k where k.i = g.i and k.j = g.j)")
def bit_not(spark, d):
    m = returned_by_line(spark, d)
    return (~Matrix(m.df.withColumn("v", F.lit(True)), *m.shape, "bit")).df


@query(f"with {SQL_P} select i, v * 3 + 1 as v from p")
def vector_affine(spark, d):
    return (sizes(spark, d) * 3.0 + 1.0).df


# Views and indexing


@query(f"with {SQL_Q} select j as i, i as j, v from q")
def transpose(spark, d):
    return quantities(spark, d).T.df


@query(f"with {SQL_Q} select (i - 10) // 5 as i, j - 3 as j, v from q where i >= 10 and i < 1500 and (i - 10) % 5 = 0 and j >= 3 and j < 90")
def slice_(spark, d):
    return quantities(spark, d)[10:1500:5, 3:90].df


@query(f"with {SQL_Q}, g as (select * from (values (0, 7), (1, 3), (2, 7), (3, 0)) t(place, source)) select cast(g.place as bigint) as i, j, v from q join g on q.i = g.source")
def gather(spark, d):
    return quantities(spark, d)[[7, 3, 7, 0], :].df


@query(f"with {SQL_Q} select i // 2 as i, j, v from q where i % 2 = 0")
def mask(spark, d):
    q = quantities(spark, d)
    return q[np.arange(q.shape[0]) % 2 == 0, :].df


@query(f"with {SQL_Q} select i, j, v from q where not (i < 20 and j < 10) union all select a.range, b.range, 5.0 from range(20) a, range(10) b")
def assign(spark, d):
    return indexing.assigned(quantities(spark, d), (slice(0, 20), slice(0, 10)), 5.0).df


@query(f"with {SQL_Q} select i, v from q where i = j")
def diagonal(spark, d):
    q = quantities(spark, d)
    return Vector(q.df.filter("i = j").select("i", "v"), min(q.shape), "float64").df


@query(f"with {SQL_Q}, {SQL_R} select i, j, v from q union all select i, j + (select max(s_suppkey) + 1 from supplier), v from r")
def block_grid(spark, d):
    return blocks.block_matrix([[quantities(spark, d), lines(spark, d)]]).df


@query(f"with {SQL_Q} select cast(i >= 100 as integer) + cast(i >= 1000 as integer) as bi, cast(j >= 50 as integer) as bj, cast(count(*) as bigint) as n from q group by 1, 2")
def block_partitions(spark, d):
    q = quantities(spark, d)
    m = blocks.refine(q, [0, 100, 1000, q.shape[0]], [0, 50, q.shape[1]])
    return blocks.with_blocks(m).groupBy("bi", "bj").agg(F.count("*").alias("n"))


# Reductions


@query(f"with {SQL_Q} select sum(v) as v from q")
def sum_all(spark, d):
    return one_row(spark, reductions.sum(quantities(spark, d)).real)


@query(f"with {SQL_Q} select round(sqrt(sum(v * v)), 4) as v from q")
def norm(spark, d):
    return one_row(spark, round(reductions.norm(quantities(spark, d)), 4))


@query(f"with {SQL_Q} select coalesce(sum(v), 0) as v from q where i = j")
def trace(spark, d):
    return one_row(spark, reductions.trace(quantities(spark, d)))


@query(f"with {SQL_S}, t as (select s_suppkey as i, cast(s_suppkey % 7 as double) as v from supplier) select sum(s.v * t.v) as v from s join t using (i)")
def dot(spark, d):
    n = nations(spark, d)
    other = Vector(n.df.select("i", (F.col("i") % 7).cast("double").alias("v")), len(n), "float64")
    return one_row(spark, reductions.dot(n, other))


@query("select cast(sum(p_size * p_size) as double) as v from part")
def inner_int(spark, d):
    v = sizes(spark, d).as_type("int32")
    return one_row(spark, v.T @ v)


@query("select cast(product(r_regionkey + 1) as double) as v from region")
def det_diagonal(spark, d):
    r = table(spark, d, "region")
    return one_row(spark, constructors.diagonal_matrix(Vector(r.select(F.col("r_regionkey").cast("bigint").alias("i"), (F.col("r_regionkey") + 1).cast("double").alias("v")), r.count(), "float64")).determinant())


# Linear algebra

SQL_G = f"{SQL_O}, m as (select count(*) as a, sum(x) as b, sum(x * x) as c from o), z as (select *, a * c - b * b as det from m)"


def _design(spark, d) -> tuple[Matrix, Vector]:
    """A column of ones and the customer key of each order, and its price."""
    o = table(spark, d, "orders")
    n = _size(spark, d, "orders", "o_orderkey")
    cols = o.select(F.col("o_orderkey").alias("i"), F.posexplode(F.array(F.lit(1.0), F.col("o_custkey").cast("double"))).alias("j", "v")).select("i", F.col("j").cast("bigint").alias("j"), "v")
    return Matrix(cols, n, 2, "float64"), Vector(o.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("v")), n, "float64")


def _gram(spark, d) -> Matrix:
    a, _ = _design(spark, d)
    return a.T @ a


@query(f"with {SQL_O} select cast(0 as bigint) as i, round(regr_intercept(y, x), 3) + 0.0 as v from o union all select 1, round(regr_slope(y, x), 3) + 0.0 from o")
def lstsq_normal_eq(spark, d):
    return cells(linalg.lstsq(*_design(spark, d)), 3)


@query(f"with {SQL_G} select cast(i as bigint) as i, cast(j as bigint) as j, round(v, 10) + 0.0 as v from (select 0 as i, 0 as j, c / det as v from z union all select 0, 1, -b / det from z union all select 1, 0, -b / det from z union all select 1, 1, a / det from z)")
def inverse(spark, d):
    return cells(linalg.invert(_gram(spark, d)), 10)


@query(f"with {SQL_G}, w as (select (a + c) / 2 as h, sqrt((a - c) * (a - c) / 4 + b * b) as r from m) select cast(1 as bigint) as i, round((h + r) / 1e6, 4) as v from w")
def eigvalsh_largest(spark, d):
    return linalg.eigvalsh(_gram(spark, d)).df.filter("i = 1").select("i", F.round(F.col("v") / 1e6, 4).alias("v"))


@query("select cast(row_number() over (order by r_regionkey desc) - 1 as bigint) as i, cast(r_regionkey + 1 as double) as v from region qualify i < 2")
def arnoldi_top2(spark, d):
    r = table(spark, d, "region")
    m = Matrix(r.select(F.col("r_regionkey").cast("bigint").alias("i"), F.col("r_regionkey").cast("bigint").alias("j"), (F.col("r_regionkey") + 1).cast("double").alias("v")), r.count(), r.count(), "float64")
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in enumerate(linalg.eigvals_arnoldi(m, 2))], "i bigint, v double")


@query()
def svd_embeddings(spark, d):
    e = embedding_matrix(spark, d)
    return linalg.svd(e.T @ e)[1].df


# Causal sets

SQL_EVENTS = "p as (select event_id as id, user_id as u, epoch_us(ts) / 1e11 as t, value as x from events)"
SQL_BOX = f"{SQL_EVENTS}, e as (select a.u as user_id, a.id as i, b.id as j from p a join p b on a.u = b.u and a.id < b.id and b.t - a.t > 0 and (b.t - a.t) * (b.t - a.t) > (b.x - a.x) * (b.x - a.x))"


def event_points(spark, d) -> DataFrame:
    """Events of a user as points: time in units of 1e11 microseconds, and value."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", (micros / 1e11).alias("c0"), F.col("value").alias("c1"))


def event_edges(spark, d) -> DataFrame:
    return causal.relation(event_points(spark, d), causal.MinkowskiBox(2, 1.0, 1.0).precedes, within="user_id")


@query(f"with {SQL_BOX} select * from e")
def causal_edges_box(spark, d):
    return event_edges(spark, d)


@query(f"with {SQL_EVENTS} select a.u as user_id, a.id as i, b.id as j from p a join p b on a.u = b.u and a.id < b.id and a.t < b.t and a.x < b.x")
def causal_edges_diamond(spark, d):
    return causal.relation(event_points(spark, d), causal.MinkowskiDiamond(2).precedes, within="user_id")


@query(f"with {SQL_EVENTS} select a.u as user_id, a.id as i, b.id as j from p a join p b on a.u = b.u and a.id < b.id and a.t < b.t and b.t - a.t > least(abs(b.x - a.x), 600 - abs(b.x - a.x))")
def causal_edges_cylinder(spark, d):
    return causal.relation(event_points(spark, d), causal.MinkowskiCylinder(2, 1.0, 600.0).precedes, within="user_id")


@query(f"with {SQL_EVENTS}, r as (select (id * 7919) % 1000003 as id, u, t, x from p) select a.u as user_id, a.id as i, b.id as j from r a join r b on a.u = b.u and a.id < b.id and a.t < b.t and (b.t - a.t) * (b.t - a.t) > (b.x - a.x) * (b.x - a.x)")
def causal_edges_relabelled(spark, d):
    points = event_points(spark, d).withColumn("id", F.col("id") * 7919 % 1000003)
    return causal.relation(points, causal.MinkowskiBox(2, 1.0, 1.0).precedes, within="user_id")


@query(f"with {SQL_BOX} select a.i, b.j, cast(count(*) as bigint) as v from e a join e b on a.j = b.i group by 1, 2")
def path_counts(spark, d):
    return causal.path_counts(event_edges(spark, d).select("i", "j"))


@query(f"with {SQL_BOX} select i, j from e where not exists (select 1 from e a join e b on a.j = b.i where a.i = e.i and b.j = e.j)")
def hasse_links(spark, d):
    return causal.links(event_edges(spark, d).select("i", "j"))


@query(f"with {SQL_BOX} select user_id, cast(count(*) as bigint) as relations, cast(count(distinct i) as bigint) as sources from e group by 1")
def relation_counts(spark, d):
    return event_edges(spark, d).groupBy("user_id").agg(F.count("*").alias("relations"), F.countDistinct("i").alias("sources"))


def nation_set(spark, d) -> causal.CausalSet:
    """Nations as points (key, region), ordered as in a diamond."""
    n = table(spark, d, "nation")
    points = n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_nationkey").cast("double").alias("c0"), F.col("n_regionkey").cast("double").alias("c1"))
    size = n.count()
    return causal.CausalSet(size, matrix=Matrix(causal.relation(points, causal.MinkowskiDiamond(2).precedes).withColumn("v", F.lit(True)), size, size, "bit", "causal"), spark=spark)


SQL_CHAINS = f"with recursive {SQL_N}, ch(i, j, p) as (select i, j, 0 from c union all select ch.i, c.j, p + 1 from ch join c on c.i = ch.j)"


@query(f"{SQL_CHAINS} select i, j, v from (select i, j, round(sum(pow(-1, p) / pow(2.0, p + 1)), 8) + 0.0 as v from ch group by 1, 2) where v <> 0")
def k_matrix(spark, d):
    return cells(nation_set(spark, d).compute_k(2.0), 8).filter("v <> 0")


@query(f"{SQL_CHAINS} select i, j, v from (select i, j, round(sum(pow(-1, p) / pow(2.0, p + 1)), 8) + 0.0 as v from ch group by 1, 2) where v <> 0")
def k_matrix_series(spark, d):
    return cells(causal.compute_k(nation_set(spark, d).C, 2.0, "series"), 8).filter("v <> 0")


@query(f"with {SQL_N} select i, j, 0.5::double as v from c")
def propagator_massless(spark, d):
    return causal.ScalarField(nation_set(spark, d)).propagator().df


@query(f"{SQL_CHAINS} select i, j, v from (select i, j, round(2.0 * sum(pow(-1, p) / pow(4.0, p + 1)), 8) + 0.0 as v from ch group by 1, 2) where v <> 0")
def propagator_massive(spark, d):
    return cells(causal.ScalarField(nation_set(spark, d)).propagator(0.5, -0.5), 8).filter("v <> 0")


@query(f"with {SQL_N} select i, j, 0.0::double as re, 0.5::double as im from c union all select j, i, 0.0, -0.5 from c")
def pauli_jordan(spark, d):
    return causal.ScalarField(nation_set(spark, d)).pauli_jordan().df.select("i", "j", F.col("v.re").alias("re"), F.col("v.im").alias("im"))


from tessera.plans import contracts  # noqa: E402,F401  registers its queries
