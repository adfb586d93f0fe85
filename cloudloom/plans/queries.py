"""Registered queries: each applies an operator to whole tables; most have SQL that says the same.

No table is a point cloud, so clouds are views: ``cloud`` (the first three components of
the embeddings), ``lattice`` (whole numbers out of lineitem) and ``track`` (events).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import context, dataset, features, fits, graph, ordered, raster, review, rules, spatial, voxel
from .model import CODE, CONTEXT, class_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CLOUD_SQL = "cloud as (select vec_id as pid, embedding[1]::double * 4 as x, embedding[2]::double * 4 as y, embedding[3]::double * 4 as z, label from embeddings)"
LATTICE_SQL = (
    "lattice as (select l_suppkey as pid, l_quantity as x, floor(l_extendedprice / 1000) as y, floor(l_discount * 100 + 0.5) as z, "
    "(l_partkey % 256)::smallint as r, (l_suppkey % 256)::smallint as g, (l_linenumber * 30)::smallint as b, "
    "l_suppkey as grp, l_linenumber as line, l_returnflag as flag from lineitem)"
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("pid"), *((F.get("embedding", F.lit(i)).cast("double") * 4).alias(c) for i, c in enumerate("xyz")), "label")


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.select(
        F.col("l_suppkey").alias("pid"), F.col("l_quantity").alias("x"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("y"),
        F.floor(F.col("l_discount") * 100 + 0.5).cast("double").alias("z"), (F.col("l_partkey") % 256).cast("smallint").alias("r"),
        (F.col("l_suppkey") % 256).cast("smallint").alias("g"), (F.col("l_linenumber") * 30).cast("smallint").alias("b"),
        F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"),
    )


# --- voxels and cells -------------------------------------------------------------

_VOXEL = """with {lat},
s as (select floor(x / 5)::bigint as i, floor(y / 5)::bigint as j, floor(z / 5)::bigint as k, count(*) as n,
  sum(x) / count(*) as x, sum(y) / count(*) as y, sum(z) / count(*) as z, sum(r) / count(*) as r, sum(g) / count(*) as g, sum(b) / count(*) as b from lattice group by all)
select ((i + 1048576) << 42) | ((j + 1048576) << 21) | (k + 1048576) as rid, n, x, y, z,
  round_even(r, 0)::smallint as r, round_even(g, 0)::smallint as g, round_even(b, 0)::smallint as b from s""".replace("{lat}", LATTICE_SQL)


@query(_VOXEL)
def voxel_downsample(spark, sf):
    """A1-A3: a centroid and a mean colour a voxel."""
    return voxel.voxel_downsample(lattice(spark, sf), 5.0).select("rid", F.col("n").cast("long"), "x", "y", "z", "r", "g", "b")


@query(_VOXEL)
def voxel_merge(spark, sf):
    """The states of three blocks, merged."""
    points = lattice(spark, sf)
    blocks = [voxel.voxel_sums(points.where(F.col("grp") % 3 == k), 5.0) for k in range(3)]
    merged = voxel.merge_sums(blocks[0].unionByName(blocks[1]).unionByName(blocks[2]))
    return voxel.voxel_centroids(merged).select("rid", F.col("n").cast("long"), "x", "y", "z", "r", "g", "b")


@query(f"""with {CLOUD_SQL} select pid, x, y, z, label from cloud
qualify row_number() over (partition by floor(x / 0.2), floor(y / 0.2), floor(z / 0.2) order by pid) = 1""")
def voxel_first(spark, sf):
    """A4: the first point of each voxel."""
    return voxel.voxel_first(cloud(spark, sf), 0.2)


@query(f"""with {LATTICE_SQL} select floor(x / 4)::bigint as i, floor(y / 4)::bigint as j, count(*) as n, sum(z) / count(*) as mean_z, min(z) as min_z, max(z) as max_z from lattice group by all""")
def cell_stats(spark, sf):
    """Count, mean and bounds of each cell."""
    return voxel.cells(lattice(spark, sf), 4.0)


@query(f"""with {LATTICE_SQL} select line, count(distinct (floor(x / 2), floor(y / 2))) as n_cells, count(distinct (floor(x / 2), floor(y / 2))) * 4.0::double as area from lattice group by line""")
def covered_area(spark, sf):
    """A5: area of different cells."""
    return voxel.covered_area(lattice(spark, sf), 2.0, ["line"])


@query(f"""with {LATTICE_SQL}, c as (select floor(x / 2)::bigint as i, floor(y / 2)::bigint as j, count(*) as n, max(z) - min(z) as height, count(distinct floor(z / 0.25)) as slices from lattice group by all)
select i, j, n, height, least(slices / greatest(ceil(height / 0.25), 1), 1.0)::double as coverage from c where n >= 10 and height >= 1.5""")
def slice_coverage(spark, sf):
    """How much of a cell's height holds points."""
    return voxel.slice_coverage(lattice(spark, sf), 2.0)


@query(f"""with {LATTICE_SQL} select count(*) as n, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z,
quantile_cont(z, 0.005) as p0, quantile_cont(z, 0.02) as p1, quantile_cont(z, 0.98) as p2, quantile_cont(z, 0.995) as p3 from lattice""")
def scene_extent(spark, sf):
    """Bounds and percentiles of the scene."""
    return voxel.extent(lattice(spark, sf), (0.005, 0.02, 0.98, 0.995))


@query(f"""with {CLOUD_SQL}, m as (select src, avg(sqrt(d2)) as d from (select a.pid as src, {(D2 := "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)")} as d2,
row_number() over (partition by a.pid order by {D2}, b.pid) as rn from cloud a join cloud b on a.pid <> b.pid and {D2} <= 0.25) where rn <= 8 group by src)
select pid, label from cloud where pid in (select src from m where d < (select avg(d) + 1.5 * stddev_samp(d) from m))""")
def outlier_filter(spark, sf):
    """Points with a usual distance to their neighbours."""
    return voxel.drop_outliers(cloud(spark, sf), 0.5, 8, 1.5).select("pid", "label")


# --- crops and joins in space -----------------------------------------------------


@query(f"with {CLOUD_SQL} select pid, x, y, z, label, x between -0.5 and 0.5 and y between -0.5 and 0.5 and z between -0.5 and 0.5 as exported from cloud where x between -0.7 and 0.7 and y between -0.7 and 0.7 and z between -0.7 and 0.7")
def bbox_crop(spark, sf):
    """Analysis in a margin around the exported box."""
    out = spatial.crop(cloud(spark, sf), (-0.5, -0.5, -0.5, 0.5, 0.5, 0.5), 0.2)
    return out.withColumn("exported", F.col("x").between(-0.5, 0.5) & F.col("y").between(-0.5, 0.5) & F.col("z").between(-0.5, 0.5))


@query(f"""with {CLOUD_SQL}, p as (select a.pid as src, b.pid as dst, {D2} as d2 from cloud a join cloud b on a.pid <> b.pid and {D2} <= 0.09)
select src, dst, d2, row_number() over (partition by src order by d2, dst)::int as rank from p qualify rank <= 8""")
def knn_graph(spark, sf):
    """The eight nearest within a radius."""
    return spatial.knn(cloud(spark, sf), 8, 0.3)


@query(f"""with {CLOUD_SQL} select a.pid, count(b.pid) as n from cloud a left join cloud b on a.pid <> b.pid and {D2} <= 0.0625 group by a.pid""")
def radius_count(spark, sf):
    """Other points in reach."""
    return spatial.radius_count(cloud(spark, sf), 0.25)


@query(f"""with {CLOUD_SQL} select a.pid, any_value(a.label) as label from cloud a join cloud b on a.pid <> b.pid and {D2} <= 0.0625 group by a.pid having count(*) >= 4""")
def evidence_gate(spark, sf):
    """Points with enough others in reach."""
    return spatial.evidence_gate(cloud(spark, sf), 0.1).select("pid", "label")


@query(f"""with {CLOUD_SQL}, r as (select * from cloud where pid % 5 = 0)
select a.pid, arg_min(b.label, ({D2}, b.pid)) as label, min({D2}) as d2 from cloud a, r b where a.pid % 5 <> 0 group by a.pid""")
def label_propagation(spark, sf):
    """The label of the nearest reduced point, without a cap."""
    points = cloud(spark, sf)
    return spatial.propagate_labels(points.where("pid % 5 <> 0"), points.where("pid % 5 = 0"), 0.25)


@query(f"""with {CLOUD_SQL} select a.pid, a.label from cloud a where exists (select 1 from cloud b where b.label <> a.label and b.label < 3 and {D2} <= 0.04)""")
def radius_semi(spark, sf):
    """Points with a point of another, allowed label in reach."""
    points = cloud(spark, sf)
    hit = spatial.near(points, points.where("label < 3"), 0.2, where=F.col("a_label") != F.col("b_label"))
    return points.join(hit, "pid", "left_semi").select("pid", "label")


@query(f"""with {CLOUD_SQL} select a.pid, a.label from cloud a where not exists (select 1 from cloud b where b.label <> a.label and b.label < 3 and {D2} <= 0.04)""")
def radius_anti(spark, sf):
    """The others."""
    points = cloud(spark, sf)
    hit = spatial.near(points, points.where("label < 3"), 0.2, where=F.col("a_label") != F.col("b_label"))
    return points.join(hit, "pid", "left_anti").select("pid", "label")


@query(f"with {CLOUD_SQL} select a.pid as src, b.pid as dst, {D2} as d2 from cloud a join cloud b on a.pid < b.pid and {D2} <= 0.04")
def pairs_within(spark, sf):
    """All pairs in reach."""
    return spatial.pairs_within(cloud(spark, sf), 0.2)


@query(f"""with {CLOUD_SQL}, p as (select pid, x, y, z + 0.06 as z, 1 as side from cloud union all select pid, x, y, z - 0.06, -1 from cloud),
n as (select a.pid, a.side, min({D2}) as d2 from p a, cloud b group by all)
select pid, max(d2) filter (side = 1) as above, max(d2) filter (side = -1) as below from n group by pid""")
def free_space_probe(spark, sf):
    """How far the cloud is from a probe on each side of a point."""
    points = cloud(spark, sf)
    up = spatial.nearest(points.withColumn("z", F.col("z") + 0.06), points, 0.1).select("pid", F.col("d2").alias("above"))
    down = spatial.nearest(points.withColumn("z", F.col("z") - 0.06), points, 0.1).select("pid", F.col("d2").alias("below"))
    return up.join(down, "pid")


@query(f"""with {CLOUD_SQL} select a.pid, 2::smallint as confidence from cloud a where exists (select 1 from cloud b where b.pid % 7 = 0 and {D2} <= 0.0625)
union all select a.pid, case when a.label in (0, 9, 10, 16) then 0 else 1 end from cloud a where not exists (select 1 from cloud b where b.pid % 7 = 0 and {D2} <= 0.0625)""")
def confirmed_confidence(spark, sf):
    """Confidence 2 near confirmed points, else 0 for labels that say little."""
    points = cloud(spark, sf).withColumn("confidence", rules.confidence(F.col("label")))
    return dataset.confirmed(points, points.where("pid % 7 = 0"), 0.25).select("pid", "confidence")


_BOX_SQL = """a as (select o_orderkey as id, (o_custkey % 1000)::double as x0, (o_custkey % 1000)::double + 1.5 as x1, (o_orderkey % 997)::double as y0, (o_orderkey % 997)::double + 1.0 as y1, o_totalprice as top from orders),
p as (select c_custkey as id, (c_custkey % 1000)::double as x0, (c_custkey % 1000)::double + 2.0 as x1, (c_custkey * 7 % 997)::double as y0, (c_custkey * 7 % 997)::double + 3.0 as y1, c_acctbal * 20 as z, c_nationkey % 2 as kind from customer)"""
_OVER = "a.x0 <= p.x1 + 0.5 and a.x1 >= p.x0 - 0.5 and a.y0 <= p.y1 + 0.5 and a.y1 >= p.y0 - 0.5"


def _boxes(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    d = lambda x: x.cast("double")
    a = o.select(F.col("o_orderkey").alias("id"), d(F.col("o_custkey") % 1000).alias("x0"), (d(F.col("o_custkey") % 1000) + 1.5).alias("x1"), d(F.col("o_orderkey") % 997).alias("y0"), (d(F.col("o_orderkey") % 997) + 1.0).alias("y1"), F.col("o_totalprice").alias("top"))
    p = c.select(F.col("c_custkey").alias("id"), d(F.col("c_custkey") % 1000).alias("x0"), (d(F.col("c_custkey") % 1000) + 2.0).alias("x1"), d(F.col("c_custkey") * 7 % 997).alias("y0"), (d(F.col("c_custkey") * 7 % 997) + 3.0).alias("y1"), (F.col("c_acctbal") * 20).alias("z"), (F.col("c_nationkey") % 2).alias("kind"))
    return a, p


@query(f"with {_BOX_SQL} select a.id as a_id, p.id as b_id from a join p on {_OVER}")
def boxes_overlap(spark, sf):
    """Boxes that meet in plan."""
    a, p = _boxes(spark, sf)
    return spatial.boxes_overlap(a, p, 8.0, 0.5).select("a_id", "b_id")


@query(f"""with {_BOX_SQL}, m as (select a.id, a.top, p.z, p.kind from a left join p on {_OVER})
select id, coalesce(min(z) filter (kind = 0 and z >= top - 0.3), min(z) filter (kind = 1 and z > top), 200000.0) as ceiling,
coalesce(max(z) filter (kind = 1 and z <= top + 0.3), 0.0) as floor from m group by id""")
def local_levels(spark, sf):
    """The ceiling and the floor over and under a box, with fall-backs."""
    a, p = _boxes(spark, sf)
    met = spatial.boxes_overlap(a, p, 8.0, 0.5)
    ceiling = F.min(F.when((F.col("b_kind") == 0) & (F.col("b_z") >= F.col("a_top") - 0.3), F.col("b_z")))
    above = F.min(F.when((F.col("b_kind") == 1) & (F.col("b_z") > F.col("a_top")), F.col("b_z")))
    floor = F.max(F.when((F.col("b_kind") == 1) & (F.col("b_z") <= F.col("a_top") + 0.3), F.col("b_z")))
    got = met.groupBy(F.col("a_id").alias("id")).agg(F.coalesce(ceiling, above).alias("c"), floor.alias("f"))
    return a.select("id").join(got, "id", "left").select("id", F.coalesce("c", F.lit(200000.0)).alias("ceiling"), F.coalesce("f", F.lit(0.0)).alias("floor"))


# --- graphs -----------------------------------------------------------------------

_REACH = """edges as (select a.pid as s, b.pid as d from {0} a join {0} b on a.pid <> b.pid and {1}),
walk as (select distinct s as node, s as seen from edges union select w.node, e.d from walk w join edges e on w.seen = e.s)"""


@query(f"with recursive {CLOUD_SQL}, {_REACH.format('cloud', D2 + ' <= 0.04')} select node, min(seen) as component from walk group by node")
def components(spark, sf):
    """Components of the graph of points in reach."""
    return graph.connected_components(spatial.pairs_within(cloud(spark, sf), 0.2))


@query(f"""with recursive {CLOUD_SQL}, core as (select a.pid, any_value(a.x) as x, any_value(a.y) as y, any_value(a.z) as z from cloud a join cloud b on {D2} <= 0.0625 group by a.pid having count(*) >= 4),
edges as (select a.pid as s, b.pid as d from core a join core b on {D2} <= 0.0625),
walk as (select distinct s as node, s as seen from edges union select w.node, e.d from walk w join edges e on w.seen = e.s),
comp as (select node, min(seen) as c from walk group by node),
border as (select a.pid, min(c.c) as c from cloud a join core b on {D2} <= 0.0625 join comp c on c.node = b.pid where a.pid not in (select pid from core) group by a.pid)
select cloud.pid, coalesce(comp.c, border.c) as cluster_id from cloud left join comp on comp.node = cloud.pid left join border on border.pid = cloud.pid""")
def density_clusters(spark, sf):
    """Density clusters, null for noise."""
    return graph.dbscan(cloud(spark, sf), 0.25, 4)


# --- rasters ----------------------------------------------------------------------

_CELLS_SQL = "cells as (select distinct l_partkey as i, l_suppkey as j from lineitem)"


def _cells(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j")).distinct()


@query(f"with {_CELLS_SQL} select distinct i + a as i, j + b as j from cells, (values (-1), (0), (1)) x(a), (values (-1), (0), (1)) y(b)")
def raster_dilate(spark, sf):
    """M3."""
    return raster.dilate(_cells(spark, sf))


@query(f"""with {_CELLS_SQL} select i, j from cells c where exists (select 1 from cells d where d.i = c.i + 1 and d.j = c.j) and exists (select 1 from cells d where d.i = c.i - 1 and d.j = c.j)
and exists (select 1 from cells d where d.i = c.i and d.j = c.j + 1) and exists (select 1 from cells d where d.i = c.i and d.j = c.j - 1)""")
def raster_erode(spark, sf):
    """M5."""
    return raster.erode(_cells(spark, sf))


@query(f"""with {LATTICE_SQL}, c as (select floor(x / 2)::bigint as i, floor(y / 2)::bigint as j, max(z) as max_z from lattice group by all)
select a.i, a.j, max(b.max_z) as max_z from c a join c b on abs(a.i - b.i) <= 2 and abs(a.j - b.j) <= 2 group by a.i, a.j""")
def raster_max_filter(spark, sf):
    """M4."""
    return raster.max_filter(voxel.cells(lattice(spark, sf), 2.0), "max_z", 2)


_ISLES_WALK = f"""with recursive {_CELLS_SQL}, n as (select i, j, (i + 1073741824) * 2147483648 + j + 1073741824 as pid from cells),
edges as (select a.pid as s, b.pid as d from (select pid, i + x as i, j + y as j from n, (values (-1), (0), (1)) p(x), (values (-1), (0), (1)) q(y)) a join n b using (i, j)),
walk as (select s as node, s as seen from edges union select w.node, e.d from walk w join edges e on w.seen = e.s),
comp as (select node, min(seen) as component from walk group by node),
lab as (select n.i, n.j, c.component from n join comp c on c.node = n.pid)"""


@query(f"{_ISLES_WALK} select i, j, component from lab")
def raster_components(spark, sf):
    """G6."""
    return raster.grid_components(_cells(spark, sf))


@query(f"""{_ISLES_WALK}, b as (select component, count(*) as n, min(i) as i0, max(i) as i1, min(j) as j0, max(j) as j1 from lab group by component),
s as (select *, greatest((i1 - i0 + 1) * 0.15::double, (j1 - j0 + 1) * 0.15::double) as long, least((i1 - i0 + 1) * 0.15::double, (j1 - j0 + 1) * 0.15::double) as short from b)
select * from s where short between 0.1 and 9.0 and long >= 0.15 and long >= 1.01 * short""")
def raster_strips(spark, sf):
    """M2: components of a beam's shape."""
    return raster.strips(raster.component_boxes(raster.grid_components(_cells(spark, sf)), 0.15), 0.1, 9.0, 0.15, 1.01)


@query(f"""with {_CELLS_SQL}, k as (select i, j, (i * 3 + j * 5) % 17 as v from cells), w as (select distinct i + 1 as i, j + 1 as j from cells),
m as (select w.i, w.j, arg_min(k.v, (x * x + y * y, (k.i + 1073741824) * 2147483648 + k.j + 1073741824)) as v from w, range(-3, 4) p(x), range(-3, 4) q(y), k where x * x + y * y <= 9 and k.i = w.i + x and k.j = w.j + y group by w.i, w.j)
select i, j, v from m""")
def raster_fill(spark, sf):
    """M6: the nearest cell's value, within a radius."""
    cells = _cells(spark, sf)
    known = cells.withColumn("v", (F.col("i") * 3 + F.col("j") * 5) % 17)
    return raster.fill_from_nearest(known, cells.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j")), "v", 1.0, 3.0)


@query(f"""with recursive {_CELLS_SQL}, c as (select i, j, (i + 100000) // 40 as level from cells), box as (select level, min(i) - 2 as i0, max(i) + 2 as i1, min(j) - 2 as j0, max(j) + 2 as j1 from c group by level),
grid as (select level, i, unnest(range(j0, j1 + 1)) as j, i0, i1, j0, j1 from (select *, unnest(range(i0, i1 + 1)) as i from box)),
wide as (select distinct level, i + x as i, j + y as j from c, (values (-1), (0), (1)) p(x), (values (-1), (0), (1)) q(y)),
closed as (select level, i, j from (select level, i + x as i, j + y as j from wide, (values (-1), (0), (1)) p(x), (values (-1), (0), (1)) q(y)) group by all having count(*) = 9),
open_ as (select * from grid anti join closed using (level, i, j)),
outside as (select level, i, j from open_ where i in (i0, i1) or j in (j0, j1) union select o.level, o.i, o.j from outside join (values (0, 1), (0, -1), (1, 0), (-1, 0)) s(x, y) on true join open_ o on o.level = outside.level and o.i = outside.i + x and o.j = outside.j + y)
select level, i, j from grid anti join outside using (level, i, j) anti join c using (level, i, j)""")
def raster_holes(spark, sf):
    """M1: enclosed empty cells of each level's raster (levels are stretches of the rows)."""
    return raster.holes(_cells(spark, sf).withColumn("level", F.floor((F.col("i") + 100_000) / 40)), "level")


@query(f"""with {_CELLS_SQL}, k as (select l_partkey as i, l_suppkey as j, min(l_linenumber) as v from lineitem where l_quantity >= 49 group by all),
m as (select w.i, w.j, arg_min(k.v, ((k.i - w.i) ** 2 + (k.j - w.j) ** 2, k.i, k.j)) as v, min((k.i - w.i) ** 2 + (k.j - w.j) ** 2)::bigint as d2 from cells w, k group by w.i, w.j)
select i, j, v, d2 from m""")
def raster_distance(spark, sf):
    """M6: the value and distance of the nearest of the cells that hold a large quantity, however far."""
    large = table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_linenumber").alias("v"))
    return raster.nearest_cell(large, _cells(spark, sf), "v")


# --- features ---------------------------------------------------------------------


@query(f"""with {CLOUD_SQL} select label, count(*) as n, round(covar_pop(x, x), 8) as m_xx, round(covar_pop(x, y), 8) as m_xy, round(covar_pop(x, z), 8) as m_xz,
round(covar_pop(y, y), 8) as m_yy, round(covar_pop(y, z), 8) as m_yz, round(covar_pop(z, z), 8) as m_zz from cloud group by label""")
def scatter_matrix(spark, sf):
    """Covariances of each group."""
    got = features.scatter_sums(cloud(spark, sf), ["label"])
    return got.select("label", "n", *(F.round(f"m_{a}{b}", 8).alias(f"m_{a}{b}") for a, b in features.SIX))


@query(f"""with {CLOUD_SQL} select label, count(*) as n, round(avg(x * x), 8) as m_xx, round(avg(x * y), 8) as m_xy, round(avg(x * z), 8) as m_xz, round(avg(y * y), 8) as m_yy, round(avg(y * z), 8) as m_yz, round(avg(z * z), 8) as m_zz from cloud group by label""")
def normal_scatter(spark, sf):
    """Mean products."""
    got = features.scatter_sums(cloud(spark, sf), ["label"], centred=False)
    return got.select("label", "n", *(F.round(f"m_{a}{b}", 8).alias(f"m_{a}{b}") for a, b in features.SIX))


@query()
def shape_descriptors(spark, sf):
    """Eigenvalues, box sides, linearity, planarity, dispersion, verticality."""
    points = cloud(spark, sf)
    eigen = features.shape_descriptors(features.with_eigen(features.scatter_sums(points, ["label"])))
    return eigen.join(features.box_sides(points, eigen, ["label"]), "label").select("label", "n", "eigen.l1", "eigen.l2", "eigen.l3", "linearity", "planarity", "dispersion", "verticality", "dims")


@query(f"""with {LATTICE_SQL}, e as (select grp, max(z) as top, min(z) as bottom, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) as robust_z from lattice group by grp)
select grp, any_value(top) as top, any_value(bottom) as bottom, round(any_value(robust_z), 6) as robust_z,
greatest(count(*) filter (z >= top - 0.15) / count(*), count(*) filter (z <= bottom + 0.15) / count(*)) as band_share from lattice join e using (grp) group by grp""")
def height_features(spark, sf):
    """Robust height and the share at the ends."""
    return features.heights(lattice(spark, sf), ["grp"]).withColumn("robust_z", F.round("robust_z", 6))


@query(f"""with {LATTICE_SQL}, m as (select grp, median(r) as mr, median(g) as mg, median(b) as mb from lattice group by grp)
select grp, round_even(any_value(mr), 0)::int as r, round_even(any_value(mg), 0)::int as g, round_even(any_value(mb), 0)::int as b,
count(*) filter ((r - mr) * (r - mr) + (g - mg) * (g - mg) + (b - mb) * (b - mb) <= 1600) / count(*) as uniformity from lattice join m using (grp) group by grp""")
def dominant_colour(spark, sf):
    """The median colour and how many points are near it."""
    got = features.dominant_colour(lattice(spark, sf), ["grp"])
    return got.select("grp", *(F.element_at("colour", i + 1).cast("int").alias(c) for i, c in enumerate("rgb")), "uniformity")


@query("""select p_partkey, 500 / greatest(2 * (a * b + b * c + a * c) / (0.03::double * 0.03::double), 1.0::double) as density
from (select p_partkey, greatest(p_size / 10.0::double, 0.03) as a, greatest(p_size / 20.0::double, 0.03) as b, greatest(p_retailprice / 100000, 0.03) as c from part)""")
def shell_density(spark, sf):
    """A17."""
    p = table(spark, sf, "part").withColumn("dims", F.array(F.col("p_size") / 10.0, F.col("p_size") / 20.0, F.col("p_retailprice") / 100000))
    return p.select("p_partkey", features.shell_density(F.lit(500), F.col("dims"), 0.03).alias("density"))


@query(f"with {LATTICE_SQL} select grp, least(floor(((atan2(y - 50, x - 25) % 6.283185307179586) + case when atan2(y - 50, x - 25) < 0 then 6.283185307179586 else 0 end) / (6.283185307179586 / 18)), 17)::int as bin, count(*) as n from lattice group by all")
def angular_bins(spark, sf):
    """Points by direction."""
    return lattice(spark, sf).groupBy("grp", expr.angular_bin(F.col("x") - 25, F.col("y") - 50, 18).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {CLOUD_SQL} select label, count(*) filter (abs(0.6 * x + 0.8 * z) > 0.1) / count(*) as coherence from cloud group by label")
def normal_coherence(spark, sf):
    """A20."""
    points = cloud(spark, sf).select("label", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"))
    return features.normal_coherence(points, ["label"], [0.6, 0.0, 0.8], 0.1)


@query()
def local_normals(spark, sf):
    """Normals from neighbours."""
    return features.local_normals(cloud(spark, sf), 0.4)


@query()
def patch_family(spark, sf):
    """Family and axis of each group of normals."""
    points = cloud(spark, sf).join(features.local_normals(cloud(spark, sf), 0.4), "pid").where("nx is not null")
    return features.patch_family(points, ["label"]).join(features.cylinder_axis(points, ["label"]), "label")


@query(f"""with {LATTICE_SQL}, m as (select grp, avg(x) as mx, avg(y) as my from lattice group by grp),
s as (select grp, any_value(mx) as mx, any_value(my) as my, count(*) as n, sum((x - mx) ** 2) as uu, sum((x - mx) * (y - my)) as uv, sum((y - my) ** 2) as vv,
sum((x - mx) * ((x - mx) ** 2 + (y - my) ** 2)) as uq, sum((y - my) * ((x - mx) ** 2 + (y - my) ** 2)) as vq from lattice join m using (grp) group by grp),
c as (select *, (uq * vv - vq * uv) / (2 * (uu * vv - uv * uv)) as a, (vq * uu - uq * uv) / (2 * (uu * vv - uv * uv)) as b from s)
select grp, n, round(a + mx, 4) as cx, round(b + my, 4) as cy, round(sqrt(a * a + b * b + (uu + vv) / n), 4) as radius from c""")
def circle_fit(spark, sf):
    """Least-squares circles from sums."""
    got = fits.circle_fits(lattice(spark, sf), ["grp"])
    return got.select("grp", "n", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "radius")))


@query()
def cylinder_fit(spark, sf):
    """A cylinder of each group of points with normals."""
    points = cloud(spark, sf).join(features.local_normals(cloud(spark, sf), 0.4), "pid").where("nx is not null")
    return fits.fit_cylinders(points, "label").select("label", "cylinder.*")


# --- orders -----------------------------------------------------------------------

_TRACK_SQL = "track as (select event_id as pid, user_id % 50 as grp, value as z, epoch_us(ts) / 1000000.0::double as t from events)"


def track(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("pid"), (F.col("user_id") % 50).alias("grp"), F.col("value").alias("z"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"))


@query(f"""with {_TRACK_SQL}, j as (select *, coalesce((z - lag(z) over (partition by grp order by z) > 0.5)::int, 0) as jump from track),
l as (select *, sum(jump) over (partition by grp order by z range between unbounded preceding and current row) as level from j),
g as (select grp, level::bigint as level, min(z) as low, max(z) as high, count(*) as n from l group by all)
select *, (high + lead(low) over (partition by grp order by level)) / 2 as cut from g""")
def level_split(spark, sf):
    """Levels at gaps, with the middle of each gap."""
    return ordered.levels(track(spark, sf), ["grp"]).withColumn("level", F.col("level").cast("long"))


@query(f"""with {_TRACK_SQL} select grp, list_reduce(list_prepend([]::double[], list_transform(list_sort(list_distinct(list(z))), lambda v: [v])),
lambda k, v: case when len(k) = 0 or v[1] - k[-1] > 1.5 then list_concat(k, v) else k end)::varchar as kept from track group by grp""".replace("::varchar as kept", " as kept_")
       .replace("select grp, list_reduce", "select grp, len(kept_) as n, list_sum(list_transform(kept_, lambda v: round(v * 100)))::bigint as total from (select grp, list_reduce") + ")")
def kept_levels(spark, sf):
    """Each level more than a gap above the one kept before it."""
    got = ordered.kept_levels(track(spark, sf), ["grp"], "z", 1.5)
    return got.select("grp", F.size("kept").cast("long").alias("n"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, v: a + F.round(v * 100).cast("long")).alias("total"))


@query(f"with {LATTICE_SQL} select z, count(*) as n, len(list_filter([1.15, 4.15, 7.15]::double[], lambda f: f < z))::int as level from lattice group by all")
def level_cut(spark, sf):
    """The level of a height."""
    return lattice(spark, sf).groupBy("z").agg(F.count(F.lit(1)).alias("n")).withColumn("level", ordered.level_of(F.col("z"), [1.0, 4.0, 7.0]))


@query(f"""with {_TRACK_SQL}, e as (select grp, min(z) as lo, max(z) as hi from track group by grp)
select pid, grp, z, z <= lo + 2.0 as at_start, z >= hi - 2.0 as at_end from track join e using (grp) where z <= lo + 2.0 or z >= hi - 2.0""")
def end_slices(spark, sf):
    """W7."""
    return ordered.end_slices(track(spark, sf).select("pid", "grp", "z"), ["grp"], "z", 2.0)


@query(f"""with {_TRACK_SQL}, r as (select pid, grp, row_number() over (partition by grp order by pid) - 1 as r, greatest(count(*) over (partition by grp) // 25, 1) as s from track) select pid, grp from r where r % s = 0""")
def strided_sample(spark, sf):
    """W8."""
    return ordered.strided(track(spark, sf), ["grp"], "pid").select("pid", "grp")


@query(f"""with {_TRACK_SQL}, b as (select pid, grp, floor(z / 0.5)::bigint as bin from track), p as (select grp, bin, count(*) as n from b group by all),
j as (select *, coalesce((bin - lag(bin) over (partition by grp order by bin) > 3)::int, 0) as new from p),
r as (select *, sum(new) over (partition by grp order by bin) as run from j), s as (select grp, run, sum(n) as points from r group by all),
g as (select grp, count(*) filter (points >= 3) as good from s group by grp)
select pid, b.grp, case when points >= 3 and good >= 2 then r.run end::bigint as segment from b join r on b.grp = r.grp and b.bin = r.bin join s on s.grp = r.grp and s.run = r.run join g on g.grp = b.grp""")
def gap_segments(spark, sf):
    """Runs along an axis between empty bins."""
    return ordered.segments_by_gaps(track(spark, sf), ["grp"], "z", 0.5, 3, 2, 3).select("pid", "grp", F.col("segment").cast("long"))


@query(f"with {CLOUD_SQL} select pid, case when y > (select quantile_cont(y, 0.7) from cloud) then 'val' else 'train' end as split from cloud")
def split_quantile(spark, sf):
    """W6."""
    return ordered.split_by_quantile(cloud(spark, sf)).select("pid", "split")


@query()
def hash_sample(spark, sf):
    """O1: a seeded sample; the limit is the feature."""
    return ordered.hash_sample(cloud(spark, sf), 100)


@query(f"with {CLOUD_SQL} select pid, (x - 0.1) * (x - 0.1) + (y - 0.2) * (y - 0.2) + (z - 0.3) * (z - 0.3) as d2 from cloud order by d2, pid limit 64")
def block_around(spark, sf):
    """O3: the nearest points to a seed; the limit is the feature."""
    return ordered.block_around(cloud(spark, sf), (0.1, 0.2, 0.3), 64).select("pid", "d2")


@query(f"""with {CLOUD_SQL} select coalesce((select label + 1 from (select label, (x - 0.1) * (x - 0.1) + y * y + z * z as d2 from cloud) where d2 <= 0.0625 order by d2, label limit 1), 0)::bigint as instance_id""")
def click_instance(spark, sf):
    """What lies under a click."""
    return review.instance_at(cloud(spark, sf).withColumn("instance_id", (F.col("label") + 1).cast("long")), (0.1, 0.0, 0.0)).withColumn("instance_id", F.col("instance_id").cast("long"))


# --- rules ------------------------------------------------------------------------

_FEATURE_SQL = """f as (select p_partkey as id, (p_partkey * 7 % 400)::bigint as n, (p_size * 13 % 50) / 10.0::double + 0.2 as a, (p_size * 7 % 30) / 20.0::double + 0.05 as b, (p_size * 3 % 20) / 20.0::double + 0.02 as h,
  (p_partkey % 37) / 100.0::double as density, (p_partkey % 11) / 10.0::double as linearity, (p_partkey % 7) / 10.0::double as planarity, (p_partkey % 21) / 20.0::double as verticality,
  (p_partkey % 31) / 10.0::double as robust_z, (p_partkey % 5) / 4.0::double as band_share, (p_partkey % 23) / 10.0::double as top, 0.0::double as bottom,
  (p_partkey % 17) / 10.0::double as to_ceiling, (p_partkey % 29) / 10.0::double - 0.3 as to_floor, p_partkey % 9 = 0 as under_pipe,
  p_partkey % 3 > 0 as valid, (p_partkey % 41) / 60.0::double as radius, (p_partkey % 13) / 12.0::double as inliers, (p_partkey % 6) / 5.0::double as radial, (p_partkey % 8) / 4.0::double as section, (p_partkey % 10) / 10.0::double as normals, (p_partkey % 19) / 10.0::double as length from part)"""


def feature_rows(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    d = lambda c, n: c.cast("double") / float(n)
    return table(spark, sf, "part").select(
        k.alias("id"), (k * 7 % 400).alias("n"), F.array(d(s * 13 % 50, 10) + 0.2, d(s * 7 % 30, 20) + 0.05, d(s * 3 % 20, 20) + 0.02).alias("dims"),
        d(k % 37, 100).alias("density"), d(k % 11, 10).alias("linearity"), d(k % 7, 10).alias("planarity"), d(k % 21, 20).alias("verticality"),
        d(k % 31, 10).alias("robust_z"), d(k % 5, 4).alias("band_share"), d(k % 23, 10).alias("top"), F.lit(0.0).alias("bottom"),
        d(k % 17, 10).alias("to_ceiling"), (d(k % 29, 10) - 0.3).alias("to_floor"), (k % 9 == 0).alias("under_pipe"),
        F.struct((k % 3 > 0).alias("valid"), d(k % 41, 60).alias("radius"), d(k % 13, 12).alias("inliers"), d(k % 6, 5).alias("radial"), d(k % 8, 4).alias("section"), d(k % 10, 10).alias("normals"), d(k % 19, 10).alias("length")).alias("cylinder"),
    )


@query(f"""with {_FEATURE_SQL}, g as (select *, a * b * h as volume, greatest(b, 1e-6) as wide, verticality <= 0.35 as level, to_ceiling <= 1.5 as hung,
 valid and inliers >= 0.5 and radial >= 0.5 and section >= 0.75 and normals <= 0.65 and linearity >= 0.5 and length >= 0.4 as round_,
 h <= 0.25 and h <= 0.5 * b and (robust_z <= 0.30 or band_share >= 0.5) and to_ceiling <= 0.6 and a between 0.15 and 3.0 and density >= 0.08 as flat from f)
select id, (case when density < 0.05 and volume >= 0.20 then 16 when density < 0.05 then 9 when to_floor + (top - bottom) < -0.05 then 16
 when n >= 20 and a <= 0.35 and (under_pipe or to_ceiling <= 1.0) then 6
 when verticality >= 0.7 and to_ceiling <= 0.4 and to_floor <= 0.4 and robust_z >= 2.0 and b between 0.2 and 1.2 and not (valid and radius <= 0.10) then 14
 when n >= 30 and round_ and radius <= 0.10 then 3
 when n >= 80 and round_ and radius <= 0.60 and not (radius >= 0.35 and to_floor <= 0.2) then 1
 when n >= 80 and level and hung and b between 0.10 and 0.70 and a >= 2.0 * wide and a >= 2.0 and h <= 0.15 then 4
 when n >= 80 and level and hung and b between 0.10 and 0.70 and a >= 3.0 * wide and a >= 2.5 and h <= 0.30 and b >= 0.20 then 4
 when n >= 80 and a >= 2.0 * wide and level and hung and b between 0.20 and 1.50 and h between 0.12 and 1.20 then 2
 when n >= 25 and flat and a / wide <= 1.6 and a <= 0.9 then 7 when n >= 30 and flat then 5
 when (level or verticality >= 0.7) and h <= 0.15 and a >= 1.5 and b >= 0.5 and robust_z >= 0.8 and planarity + linearity >= 0.7 and density >= 0.10 and a * b >= 2.0 then 13
 when n >= 200 and density >= 0.10 and to_floor <= 1.0 and ((h >= 0.35 and a >= 0.60) or volume >= 0.40) then 8 else 9 end)::smallint as label from g""")
def rule_cascade(spark, sf):
    """The first rule that holds."""
    return rules.classify(feature_rows(spark, sf)).select("id", "label")


# the first arms of the cascade stay, those of lights and sprinklers go, and small clusters are generic
_EXCLUDED_SQL = re.sub(r"when n >= \d+ and (?:(?!when ).)*?then [56](?= |\n)", "", SQL["rule_cascade"]).replace("(case when density < 0.05 and volume", "(case when n < 100 then 9 when density < 0.05 and volume")


@query(_EXCLUDED_SQL)
def rule_cascade_excluded(spark, sf):
    """The cascade without some classes."""
    return rules.classify(feature_rows(spark, sf), excluded=["luce", "Sprinkler"], least_points=100).select("id", "label")


@query(f"""with {LATTICE_SQL}, m as (select grp, median(r) as r, median(g) as g, median(b) as b from lattice group by grp)
select grp, (case when (round_even(r, 0) - 120) ** 2 + (round_even(g, 0) - 40) ** 2 + (round_even(b, 0) - 90) ** 2 <= 2025 then 4 when (round_even(r, 0) - 128) ** 2 + (round_even(g, 0) - 80) ** 2 + (round_even(b, 0) - 120) ** 2 <= 900 then 5 else 9 end)::smallint as label from m""")
def colour_guide(spark, sf):
    """R2: generic instances of one colour take the guide's class."""
    got = features.dominant_colour(lattice(spark, sf), ["grp"]).withColumns({"label": F.lit(9).cast("smallint"), "uniformity": F.lit(1.0)})
    return rules.colour_guide(got, [("PASSERELLA_CAVI", (120, 40, 90), None), ("luce", (128, 80, 120), 30.0)]).select("grp", "label")


@query("select o_orderkey as pid, (case when o_custkey % 17 = 9 and o_orderkey % 3 > 0 then o_orderkey % 8 else o_custkey % 17 end)::smallint as label, case when o_custkey % 17 in (0, 9, 10, 16) then 0 else 1 end::smallint as confidence from orders")
def label_fusion(spark, sf):
    """Generic labels take another source's; confidence of the first ones."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pid"), (F.col("o_custkey") % 17).cast("smallint").alias("label"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 8).alias("dl_label"))
    return rules.fuse(o.withColumn("confidence", rules.confidence(F.col("label")))).select("pid", "label", "confidence")


@query(f"""with {CLOUD_SQL}, f as (select floor(x / 0.5)::bigint as i, floor(y / 0.5)::bigint as j, min(z) + 0.4 as low from cloud where label < 5 group by all)
select pid, (case when z < low - 0.2 and label not in (11, 12) then 16 else label end)::smallint as label from cloud left join f on i = floor(x / 0.5) and j = floor(y / 0.5)""")
def reflections(spark, sf):
    """Points below the lowest floor of their cell."""
    points = cloud(spark, sf)
    floors = voxel.cells(points.where("label < 5"), 0.5).select("i", "j", (F.col("min_z") + 0.4).alias("z"))
    return rules.reflections(points, floors, 0.5, 0.2).select("pid", F.col("label").cast("smallint").alias("label"))


# --- review -----------------------------------------------------------------------

_SIGN_SQL = """sign as (select s_suppkey as instance_id, (s_suppkey % 17)::smallint as label, round(s_acctbal / 5000 + 3.0, 4) as d1, round((s_suppkey % 9) / 10.0 + 0.3, 4)::double as d2, round((s_suppkey % 4) / 10.0 + 0.1, 4)::double as d3,
  ((s_suppkey % 6) / 5.0)::double as z_extent, ((s_suppkey % 8) / 4.0)::double as to_ceiling, ((s_suppkey % 10) / 10.0)::double as to_floor, ((s_suppkey % 11) / 10.0)::double as verticality,
  ((s_suppkey * 3 % 40) / 20.0)::double as cx, ((s_suppkey * 7 % 30) / 20.0)::double as cy, ((s_suppkey % 3) / 10.0)::double as cz from supplier)"""


def signs(spark, sf):
    k = F.col("s_suppkey")
    d = lambda c, n: c.cast("double") / float(n)
    r4 = lambda c: F.round(c * 10_000.0) / 10_000.0  # noqa: E731 - the SQL's round is of the product, F.round(c, 4) of c's decimal digits
    return table(spark, sf, "supplier").select(
        k.alias("instance_id"), (k % 17).cast("smallint").alias("label"), r4(F.col("s_acctbal") / 5000 + 3.0).alias("d1"), r4(d(k % 9, 10) + 0.3).alias("d2"), r4(d(k % 4, 10) + 0.1).alias("d3"),
        d(k % 6, 5).alias("z_extent"), d(k % 8, 4).alias("to_ceiling"), d(k % 10, 10).alias("to_floor"), d(k % 11, 10).alias("verticality"),
        d(k * 3 % 40, 20).alias("cx"), d(k * 7 % 30, 20).alias("cy"), d(k % 3, 10).alias("cz"),
    )


_W = lambda a, b, r, m: f"abs({a} - {b}) <= greatest({b} * {r}::double, {m}::double)"
_O = lambda c: f"case when {c} > 0.7 then 2 when {c} < 0.35 then 0 else 1 end"
_MATCH = " and ".join((*(_W(f"a.d{k}", f"m.d{k}", 0.4, 0.08) for k in (1, 2, 3)), "a.z_extent <= m.z_extent + greatest(m.z_extent * 0.4::double, 0.08::double)", f"{_O('a.verticality')} = {_O('m.verticality')}",
    "(case when m.to_ceiling <= 1.5 then abs(a.to_ceiling - m.to_ceiling) <= 0.6::double when m.to_floor <= 0.3 then abs(a.to_floor - m.to_floor) <= 0.6::double else true end)"))
_SAME = "(a.cx - m.cx) * (a.cx - m.cx) + (a.cy - m.cy) * (a.cy - m.cy) + (a.cz - m.cz) * (a.cz - m.cz)"
_PLACE = f"{_SAME} <= 0.3::double * 0.3::double and " + " and ".join(_W(f"a.d{k}", f"m.d{k}", 0.2, 0.05) for k in (1, 2, 3))


def _models(s):
    return s.where("instance_id % 5 = 0").select((F.col("instance_id") / 5).cast("long").alias("ord"), F.concat(F.lit("m"), F.col("instance_id")).alias("name"), (F.col("label") % 9).cast("int").alias("target"), *[c for c in s.columns if c not in ("instance_id", "label")])


@query(f"with {_SIGN_SQL} select a.instance_id, m.instance_id // 5 as ord, 'm' || m.instance_id as name, (m.label % 9)::int as target from sign a join sign m on m.instance_id % 5 = 0 and {_MATCH}")
def model_match(spark, sf):
    """Models that an instance fits."""
    s = signs(spark, sf)
    return review.model_matches(s, _models(s))


@query(f"with {_SIGN_SQL} select a.instance_id, a.label from sign a where not exists (select 1 from sign m where m.instance_id % 13 = 0 and {_MATCH})")
def reject_veto(spark, sf):
    """Instances that fit no rejection."""
    s = signs(spark, sf)
    return s.join(review.rejected(s, s.where("instance_id % 13 = 0")), "instance_id", "left_anti").select("instance_id", "label")


@query(f"""with {_SIGN_SQL}, p as (select a.instance_id, m.instance_id // 5 as ord, (m.label % 9)::int as target from sign a join sign m on m.instance_id % 5 = 0 and {_MATCH}),
l as (select instance_id, list(target order by ord) as ts from p group by instance_id), r as (select a.instance_id from sign a where exists (select 1 from sign m where m.instance_id % 13 = 0 and {_MATCH}))
select a.instance_id, (case when r.instance_id is not null or ts is null then label else list_reduce(list_prepend(label::int, ts), lambda now, t: case when now in (9, 8, 7) and now <> t then t else now end) end)::smallint as label
from sign a left join l on l.instance_id = a.instance_id left join r on r.instance_id = a.instance_id""")
def model_application(spark, sf):
    """Models in their order, unless a rejection fits."""
    s = signs(spark, sf)
    return review.apply_models(s, _models(s), s.where("instance_id % 13 = 0"), ("MEP_GENERICO", "APPARECCHIATURA", "TERMINALE_ARIA")).select("instance_id", "label")


@query(f"with {_SIGN_SQL} select a.instance_id as a, m.instance_id as b, {_SAME} as d2 from sign a join sign m on {_PLACE}")
def same_instance(spark, sf):
    """Signatures in the same place, with the tolerance of the second."""
    s = signs(spark, sf)
    return review.place_join(s, s).select(F.col("a_instance_id").alias("a"), F.col("b_instance_id").alias("b"), "d2")


_PINS = f"""c as (select instance_id as decision, (instance_id % 7)::smallint as yes, * exclude (instance_id, label) from sign where instance_id % 3 = 0), n as (select instance_id as decision, * exclude (instance_id, label) from sign where instance_id % 4 = 1),
py as (select m.decision, m.yes, arg_min(a.instance_id, ({_SAME}, a.instance_id)) as instance_id from c m join sign a on {_PLACE} group by all), pn as (select m.decision, arg_min(a.instance_id, ({_SAME}, a.instance_id)) as instance_id from n m join sign a on {_PLACE} group by all),
y as (select instance_id, arg_max(yes, decision) as yes from py group by instance_id)"""


@query(f"with {_SIGN_SQL}, {_PINS} select s.instance_id, coalesce(y.yes, case when s.instance_id in (select instance_id from pn) then 16 end, s.label)::smallint as label from sign s left join y on y.instance_id = s.instance_id")
def user_pins(spark, sf):
    """Rejections, then confirmations."""
    s = signs(spark, sf)
    yes = s.where("instance_id % 3 = 0").withColumns({"decision": F.col("instance_id"), "label": (F.col("instance_id") % 7).cast("smallint")})
    no = s.where("instance_id % 4 = 1").withColumn("decision", F.col("instance_id"))
    return review.apply_pins(s, yes, no).select("instance_id", "label")


def _runs(spark, sf):
    s = signs(spark, sf)
    return s.where("instance_id % 6 > 0"), s.where("instance_id % 7 > 0").withColumn("label", ((F.col("instance_id") + F.col("instance_id") % 3) % 17).cast("smallint"))


_RUNS_SQL = f"{_SIGN_SQL}, x as (select * from sign where instance_id % 6 > 0), y as (select * replace (((instance_id + instance_id % 3) % 17)::smallint as label) from sign where instance_id % 7 > 0)"


@query(f"""with {_RUNS_SQL}, p as (select a.instance_id, a.label as label_after, m.label as label_before, row_number() over (partition by a.instance_id order by {_SAME}, m.instance_id) as rn from y a join x m on {_PLACE})
select instance_id, label_before, label_after from p where rn = 1 and label_before <> label_after""")
def diff_nearest(spark, sf):
    """Classes that changed since the run before."""
    return review.diff_nearest(*_runs(spark, sf))


@query(f"""with recursive {_RUNS_SQL}, p as (select m.instance_id as b, list(a.instance_id order by a.instance_id) as cand from y a join x m on {_PLACE} group by m.instance_id),
o as (select b, cand, row_number() over (order by b) as k from p),
walk as (select 0::bigint as k, []::bigint[] as used, null::bigint as b, null::bigint as a union all
  select o.k, case when len(list_filter(o.cand, lambda c: not list_contains(w.used, c))) > 0 then list_append(w.used, list_filter(o.cand, lambda c: not list_contains(w.used, c))[1]) else w.used end, o.b, list_filter(o.cand, lambda c: not list_contains(w.used, c))[1] from walk w join o on o.k = w.k + 1),
t as (select b, a from walk where a is not null)
select x.instance_id as id_before, y.instance_id as id_after, x.label as label_before, y.label as label_after, case when x.instance_id is null then 'new' when y.instance_id is null then 'lost' when x.label = y.label then 'stable' else 'changed' end as outcome
from x left join t on t.b = x.instance_id full join y on y.instance_id = t.a""")
def diff_greedy(spark, sf):
    """Stable, changed, lost and new instances, one to one in order."""
    return review.diff_greedy(*_runs(spark, sf))


@query("select o_orderpriority as label, count(*) filter (o_orderkey % 4 = 0) as stable, count(*) filter (o_orderkey % 4 = 1) as changed, count(*) filter (o_orderkey % 4 = 2) as lost, count(*) filter (o_orderkey % 4 = 3) as new from orders group by 1")
def run_stability(spark, sf):
    """Outcomes a class."""
    o = table(spark, sf, "orders")
    return review.stability(o.select(F.col("o_orderpriority").alias("label_before"), F.col("o_orderpriority").alias("label_after"), F.element_at(F.array(*map(F.lit, ("stable", "changed", "lost", "new"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("outcome")))


@query("select * from (select o_orderpriority as label_before, o_custkey % 5 as label_after, count(*) as n, row_number() over (partition by o_orderpriority order by count(*) desc, o_custkey % 5)::int as rank from orders where o_orderkey % 2 = 0 group by 1, 2) where rank <= 3")
def top_transitions(spark, sf):
    """The three most frequent changes of each class."""
    o, outcome = table(spark, sf, "orders"), F.when(F.col("o_orderkey") % 2 == 0, "changed").otherwise("stable")
    return review.top_transitions(o.select(F.col("o_orderpriority").alias("label_before"), (F.col("o_custkey") % 5).alias("label_after"), outcome.alias("outcome")))


@query("select c_name as name, c_acctbal as value from customer where c_custkey % 3 > 0 and c_name not in (select c_name from customer where c_custkey % 4 = 0) union all select c_name, -1.0 from customer where c_custkey % 4 = 0")
def upsert_by_name(spark, sf):
    """U4, K9: models replaced by name."""
    c = table(spark, sf, "customer")
    return review.upsert(c.where("c_custkey % 3 > 0").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("value")), c.where("c_custkey % 4 = 0").select(F.col("c_name").alias("name"), F.lit(-1.0).alias("value")), "name")


@query(f"""with {_SIGN_SQL}, o as (select * from sign where instance_id % 2 = 0), n as (select * from sign where instance_id % 9 = 4)
select instance_id as decision, label from o a where not exists (select 1 from n m where {_PLACE}) union all select instance_id, label from n""")
def upsert_by_place(spark, sf):
    """Decisions replaced by place."""
    s = signs(spark, sf).withColumn("decision", F.col("instance_id"))
    return review.upsert_places(s.where("instance_id % 2 = 0"), s.where("instance_id % 9 = 4")).select("decision", "label")


@query("select kind, count(*) as n from (select 'conferma' as kind from customer where c_custkey % 3 = 0 union all select 'rifiuto' from customer where c_custkey % 5 = 0) group by kind")
def decision_counts(spark, sf):
    """Decisions of both kinds, counted."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("decision"))
    return review.decisions(c.where("decision % 3 = 0"), c.where("decision % 5 = 0")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- context ----------------------------------------------------------------------

_ROD_SQL = """rod as (select c_custkey as instance_id, (case c_custkey % 6 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 when 4 then 9 else 5 end)::smallint as label, (c_custkey * 7 % 300 + 50)::bigint as n,
  (c_custkey * 13 % 70)::double / 4 as x, (c_custkey * 29 % 50)::double / 4 as y, (c_custkey % 4)::double / 5 as z, (c_custkey % 2)::double as ux, (1 - c_custkey % 2)::double as uy,
  (c_custkey % 12)::double / 5 + 0.6 as length, (c_custkey % 5)::double / 20 + 0.05 as section from customer)"""


def rods(spark, sf):
    k = F.col("c_custkey")
    d = lambda c: c.cast("double")
    label = F.element_at(F.array(*map(F.lit, (1, 2, 3, 4, 9, 5))), (k % 6 + 1).cast("int")).cast("smallint")
    return table(spark, sf, "customer").select(
        k.alias("instance_id"), label.alias("label"), (k * 7 % 300 + 50).alias("n"), F.array(d(k * 13 % 70) / 4, d(k * 29 % 50) / 4, d(k % 4) / 5).alias("centre"),
        F.array(d(k % 2), d(1 - k % 2), F.lit(0.0)).alias("axis"), F.array(d(k % 12) / 5 + 0.6, d(k % 5) / 20 + 0.05, F.lit(0.05)).alias("dims"),
        F.struct((k < 0).alias("valid"), F.lit(0.0).alias("radius"), F.lit(0.0).alias("length"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("axis")).alias("cylinder"),
        (d(k % 9) / 5).alias("to_ceiling"), F.lit(0.1).alias("robust_z"), F.lit(1.0).alias("band_share"), F.lit(0.5).alias("density"),
    )


_LIGHTS = """m as (select * from rod where label in (3, 9, 5) and section <= 0.35 and length between 0.12 and 2.5 and (instance_id % 9)::double / 5 <= 1.2),
e as (select a.instance_id as s, b.instance_id as d from m a join m b on a.instance_id <> b.instance_id and abs(a.ux * b.ux + a.uy * b.uy) > 0.9 and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 36 and abs(a.z - b.z) < 0.5
  and (case when a.instance_id < b.instance_id then a.length / b.length else b.length / a.length end) > 0.7 and (case when a.instance_id < b.instance_id then a.length / b.length else b.length / a.length end) < 1.43)"""


@query(f"with {_ROD_SQL}, {_LIGHTS} select s as src, d as dst from e where s < d")
def parallel_pairs(spark, sf):
    """Light-like instances that belong together."""
    return context.parallel_pairs(context.light_like(rods(spark, sf)))


@query(f"""with recursive {_ROD_SQL}, {_LIGHTS}, walk as (select distinct s as node, s as seen from e union select w.node, e.d from walk w join e on w.seen = e.s),
c as (select node, min(seen) as comp from walk group by node), lit as (select node from c where comp in (select comp from c group by comp having count(*) >= {CONTEXT["repeats"]}))
select instance_id, (case when instance_id in (select node from lit) then 5 else label end)::smallint as label from rod""")
def serial_lights(spark, sf):
    """Lights in series."""
    return context.serial_lights(rods(spark, sf)).select("instance_id", "label")


_CHAIN = """m as (select *, greatest(section, 0.02) as sec from rod where label in (1, 2, 3, 4, 8, 9, 10) and section <= 0.8 and length >= 2 * section and length >= 0.3),
e as (select a.instance_id as s, b.instance_id as d from m a join m b on a.instance_id < b.instance_id and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 16 and abs(a.ux * b.ux + a.uy * b.uy) >= 0.9
  and greatest(a.sec, b.sec) / least(a.sec, b.sec) <= 2.5 and abs((b.x - a.x) * a.ux + (b.y - a.y) * a.uy) - 0.5 * (a.length + b.length) <= 0.6
  and sqrt((b.x - a.x - ((b.x - a.x) * a.ux + (b.y - a.y) * a.uy) * a.ux) ** 2 + (b.y - a.y - ((b.x - a.x) * a.ux + (b.y - a.y) * a.uy) * a.uy) ** 2 + (b.z - a.z) ** 2) <= 0.35)"""


@query(f"with {_ROD_SQL}, {_CHAIN} select s as src, d as dst from e")
def chain_pairs(spark, sf):
    """Instances that continue each other."""
    return context.chain_pairs(context.chain_members(rods(spark, sf)))


@query(f"""with recursive {_ROD_SQL}, {_CHAIN}, b as (select s, d from e union all select d, s from e), walk as (select distinct s as node, s as seen from b union select w.node, b.d from walk w join b on w.seen = b.s),
c as (select node, min(seen) as comp from walk group by node), v as (select comp, label, sum(n) as w, min(instance_id) as o from c join m on m.instance_id = c.node where label in (1, 2, 3, 4) group by all),
won as (select comp, label from v qualify row_number() over (partition by comp order by w desc, o) = 1)
select r.instance_id, coalesce(won.label, r.label)::smallint as label from rod r left join c on c.node = r.instance_id left join won on won.comp = c.comp""")
def chain_unification(spark, sf):
    """Chains take the class with the most points."""
    return context.unify_chains(rods(spark, sf)).select("instance_id", "label")


@query("select l_suppkey as grp, arg_max(l_returnflag, (w, -o)) as winner from (select l_suppkey, l_returnflag, sum(l_partkey) as w, min(l_orderkey) as o from lineitem group by all) group by l_suppkey")
def class_vote(spark, sf):
    """A weighted vote, ties to the first seen."""
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_returnflag").alias("label"), F.col("l_partkey").alias("w"), F.col("l_orderkey").alias("o"))
    return context.vote(t, "grp", "label", "w", "o")


@query()
def anchoring(spark, sf):
    """Pipes and ducts without an anchored end become furniture."""
    r = rods(spark, sf)
    points = r.select("instance_id", "label", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"), "centre", "axis", "dims").select(
        (F.col("instance_id") * 11 + F.col("k")).alias("pid"), "instance_id", "label",
        *((F.element_at("centre", i) + F.element_at("axis", i) * (F.col("k") / 10.0 - 0.5) * F.element_at("dims", 1)).alias(c) for i, c in enumerate("xyz", 1)),
    )
    return context.anchoring(r, points).select("instance_id", "label")


# --- datasets and classes ---------------------------------------------------------


@query("select code, key, name, r, g, b, macro_group, excludable from (values " + ", ".join(f"({c}, '{k}', '{n}', {r}, {g}, {b}, '{m}', {str(x).lower()})" for c, k, n, r, g, b, m, x in __import__("cloudloom.plans.model", fromlist=["CLASSES"]).CLASSES) + ") t(code, key, name, r, g, b, macro_group, excludable)")
def class_listing(spark, sf):
    """The classes."""
    return class_table(spark)


_KEYS_SQL = "k as (select code, key, macro_group from (values " + ", ".join(f"({c}, '{k}', '{m}')" for c, k, n, r, g, b, m, x in __import__("cloudloom.plans.model", fromlist=["CLASSES"]).CLASSES) + ") t(code, key, macro_group))"


@query(f"with {_KEYS_SQL} select code, key, count(l_orderkey) as n from k left join lineitem on l_partkey % 13 = code group by all")
def class_counts(spark, sf):
    """Counts of all classes, zeros too."""
    points = table(spark, sf, "lineitem").select((F.col("l_partkey") % 13).alias("label"))
    return dataset.class_counts(points, class_table(spark))


@query(f"with {_KEYS_SQL} select macro_group, count(*) as n, sum(l_quantity) as total from lineitem join k on l_partkey % 17 = code group by macro_group")
def routed_groups(spark, sf):
    """Points by macro group."""
    t = table(spark, sf, "lineitem").withColumn("code", (F.col("l_partkey") % 17).cast("int"))
    return t.join(F.broadcast(class_table(spark).select("code", "macro_group")), "code").groupBy("macro_group").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@query("select l_partkey % 17 as label, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 4)::double as percent from lineitem group by 1")
def summary_percent(spark, sf):
    """Counts and shares of the classes that occur."""
    got = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 17).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


@query("with c as (select quality * 2 + toxic as t, (doc_id % 3 + quality) % 4 as p, count(*) as n from labels group by all), t as (select t as code, sum(n) as n_truth, sum(case when t = p then n else 0 end) as hit from c group by t), q as (select p as code, sum(n) as n_predicted from c group by p) select t.code::bigint as code, hit::bigint as hit, n_truth::bigint as n_truth, coalesce(n_predicted, 0)::bigint as n_predicted, hit / (n_truth + coalesce(n_predicted, 0) - hit) as iou from t left join q on q.code = t.code")
def confusion_iou(spark, sf):
    """Confusion and intersection over union."""
    rows = table(spark, sf, "labels").select((F.col("quality") * 2 + F.col("toxic")).cast("long").alias("truth"), ((F.col("doc_id") % 3 + F.col("quality")) % 4).alias("predicted"))
    return dataset.intersection_over_union(dataset.confusion(rows))


@query(f"with {_KEYS_SQL}, c as (select code, count(l_orderkey) as n from k left join (select * from lineitem where l_suppkey % 3 > 0) on l_partkey % 13 = code group by code) select code, n, coalesce((1.0::double / nullif(n, 0)) / avg(1.0::double / nullif(n, 0)) over (), 0.0) as weight from c".replace("coalesce((1.0", "round(coalesce((1.0").replace("over (), 0.0) as weight", "over (), 0.0), 8) as weight"))
def class_weights(spark, sf):
    """Inverse frequency of confident rows."""
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 13).cast("int").alias("label"), (F.col("l_suppkey") % 3).alias("confidence"))
    return dataset.class_weights(rows, class_table(spark)).withColumn("weight", F.round("weight", 8))


@query("select case when l_suppkey % 4 = 0 then 'val' else 'train' end as split, count(*) as n, count(*) filter (l_partkey % 3 = 2) as n_confirmed from lineitem group by 1")
def split_stats(spark, sf):
    """A27."""
    t = table(spark, sf, "lineitem").select(F.when(F.col("l_suppkey") % 4 == 0, "val").otherwise("train").alias("split"), (F.col("l_partkey") % 3).alias("confidence"))
    return dataset.split_stats(t)


@query()
def augmented_blocks(spark, sf):
    """Turned, mirrored, scaled and jittered blocks."""
    return dataset.augment(cloud(spark, sf).withColumn("block", F.col("label")))


@query(f"""with {CLOUD_SQL}, b as (select label, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from cloud where z > 0 group by label)
select b.label as instance_id, c.pid from b join cloud c on c.x between x0 - 0.1 and x1 + 0.1 and c.y between y0 - 0.1 and y1 + 0.1 and c.z between z0 - 0.1 and z1 + 0.1""")
def local_context(spark, sf):
    """The points around each instance's box."""
    from ..operators import inference

    points = cloud(spark, sf)
    boxes = points.where("z > 0").groupBy(F.col("label").alias("instance_id")).agg(*(f(c).alias(f"{c}{e}") for c in "xyz" for e, f in ((0, F.min), (1, F.max))))
    return inference.local_context(points, boxes, margin=0.1).select("instance_id", "pid")


# --- text -------------------------------------------------------------------------

_WORDS = [("the", "article"), ("der", "german"), ("que", "spanish"), ("et", "french")]
_CASE = lambda t: " ".join(f"when contains({t}, '{w}') then '{v}'" for w, v in _WORDS)


@query(f"select doc_id, case {_CASE('split_part(lower(text), chr(10), 1)')} {_CASE('lower(text)')} else 'none' end as found from documents")
def keyword_class(spark, sf):
    """the first keyword, of the first line before the rest."""
    return table(spark, sf, "documents").select("doc_id", expr.first_keyword(F.col("text"), _WORDS, "none").alias("found"))


@query("select p_partkey, case when starts_with(lower(p_type), 'standard') then 'standard' when starts_with(lower(p_type), 'small') then 'small' when starts_with(lower(p_type), 's') then 's' end as mapped, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') as slug, try_cast(nullif(regexp_extract(p_brand || '_v' || p_size, '_v([0-9]{1,9})$', 1), '') as int) as version from part")
def names(spark, sf):
    """Longest prefix, slug, version."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", expr.longest_prefix(F.col("p_type"), ["s", "small", "standard"]).alias("mapped"), expr.slug(F.col("p_name")).alias("slug"), expr.version_of(F.concat("p_brand", F.lit("_v"), F.col("p_size"))).alias("version"))


@query(f"with {LATTICE_SQL} select distinct ((floor(x / 5)::bigint + 1048576) << 42) | ((floor(y / 5)::bigint + 1048576) << 21) | (floor(z / 5)::bigint + 1048576) as key, floor(x / 5)::bigint as i, floor(y / 5)::bigint as j, floor(z / 5)::bigint as k from lattice")
def voxel_keys(spark, sf):
    """keys of 3 times 21 bits, there and back."""
    keys = lattice(spark, sf).select(expr.voxel_key(F.col("x"), F.col("y"), F.col("z"), 5.0).alias("key")).distinct()
    return keys.select("key", *(c.alias(n) for n, c in zip("ijk", expr.voxel_of(F.col("key")), strict=True)))


# --- structure and clusters -------------------------------------------------------


@query(f"""with {LATTICE_SQL}, p as (select z, count(*) as n from lattice group by z having count(*) >= 1000)
select (row_number() over (order by n desc, z) - 1)::int as plane_id, n, z from p""")
def plane_peel(spark, sf):
    """Planes peeled off, largest first, with the points that each takes: here the levels of a lattice."""
    from ..operators import structure

    points = lattice(spark, sf).select("x", "y", "z")
    planes, _ = structure.peel_planes(points, 0.25, 1000, cell=8.0)
    held = points.withColumn("plane_id", structure.plane_of(planes, 0.25)).where("plane_id is not null")
    return held.groupBy("plane_id").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("z"))



@query(f"""with {_TRACK_SQL}, j as (select *, coalesce((z - lag(z) over (order by z) > 0.2)::int, 0) as jump from track), l as (select *, sum(jump) over (order by z range between unbounded preceding and current row) as level from j),
big as (select level from l group by level having count(*) >= 30) select level::bigint as level, floor(t / 86400)::bigint as i, floor(grp / 10)::bigint as j, min(z) as z from l where level in (select level from big) group by all""")
def floor_map(spark, sf):
    """The lowest point of each cell and level."""
    from ..operators import structure

    t = track(spark, sf).select((F.col("t") / 86400).alias("x"), (F.col("grp").cast("double") / 10).alias("y"), "z")
    return structure.floor_map(t, 1.0, 0.2, 30).withColumn("level", F.col("level").cast("long"))


@query(f"""with {CLOUD_SQL}, f as (select floor(x / 0.5)::bigint as i, floor(y / 0.5)::bigint as j, list(z) as zs from cloud where label < 3 group by all)
select pid, list_min(zs) as lowest_floor, list_max(list_filter(zs, lambda v: v <= z)) as own_floor from cloud left join f on i = floor(x / 0.5) and j = floor(y / 0.5)""")
def floor_lookup(spark, sf):
    """The floors of a point's cell."""
    from ..operators import structure

    points = cloud(spark, sf)
    floors = points.where("label < 3").select(F.floor(F.col("x") / 0.5).alias("i"), F.floor(F.col("y") / 0.5).alias("j"), "z")
    return structure.floor_at(points, floors, 0.5).select("pid", "lowest_floor", "own_floor")


@query()
def column_detection(spark, sf):
    """Column components."""
    from ..operators import structure

    t = structure.STRUCTURE | {"column_cell": 1.0, "column_coverage": 0.2, "column_min": 1.0, "column_max": 60.0, "column_elongation": 9.0}
    return structure.columns(lattice(spark, sf), t=t)


@query(f"""with roof as (select l_orderkey * 8 + l_linenumber as pid, floor(l_quantity)::bigint as i, floor(l_extendedprice / 1000)::bigint as j, case when floor(l_extendedprice / 1000) = 2 * l_quantity then 2.5::double else 3.0::double end as z from lineitem),
c as (select i, j, avg(z) as m from roof group by i, j), low as (select c.i, c.j from c join c d on abs(c.i - d.i) <= 1 and abs(c.j - d.j) <= 1 group by c.i, c.j, c.m having max(d.m) - c.m >= 0.03)
select pid from roof join low using (i, j)""")
def ceiling_protrusions(spark, sf):
    """M9, M4: what hangs below the local height: single cells along a diagonal, no two of which touch."""
    from ..operators import structure

    at = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pid"), F.col("l_quantity").alias("x"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("y"))
    return structure.protrusions(at.withColumn("z", F.when(F.col("y") == 2 * F.col("x"), 2.5).otherwise(3.0)), cell=1.0)


@query()
def surface_growth(spark, sf):
    """Clusters by surface continuity."""
    from ..operators import cluster

    t = cluster.CLUSTER | {"eps": 0.4, "jump": 0.3, "patch": 5, "least": 5, "smooth_degrees": 40.0}
    return cluster.grow(cloud(spark, sf).select("pid", "x", "y", "z"), 0.1, t)


@query()
def direction_split(spark, sf):
    """Clusters cut by direction."""
    from ..operators import cluster

    points = cloud(spark, sf).join(features.local_normals(cloud(spark, sf), 0.6), "pid").where("nx is not null").withColumn("cluster_id", F.col("label").cast("long"))
    return cluster.split_directions(points, cluster.CLUSTER | {"direction_points": 10, "sphericity": None})


@query()
def giant_split(spark, sf):
    """Long clusters cut by level and erosion."""
    from ..operators import cluster

    points = lattice(spark, sf).select(F.xxhash64("x", "y", "z", "line", "grp").alias("pid"), (F.col("x") / 2).alias("x"), (F.col("y") / 4).alias("y"), "z", F.col("line").cast("long").alias("cluster_id")).dropDuplicates(["pid"])
    return cluster.split_giants(points, 9.0, [0.0, 4.0])


# --- patches, planes and reports --------------------------------------------------

_EDGE_SQL = """edge as (select distinct l_partkey as src, l_partkey + l_suppkey as dst, l_suppkey % 3 = 0 as concave from lineitem), vote as (
select src // 50 as p, dst // 50 as q, count(*) as contacts, count(*) filter (concave) as concave from edge where src // 50 <> dst // 50 group by all)"""


def _votes(spark, sf):
    from ..operators import cluster

    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") + F.col("l_suppkey")).alias("dst"), (F.col("l_suppkey") % 3 == 0).alias("concave")).distinct()
    nodes = e.select(F.col("src").alias("pid")).union(e.select("dst")).distinct().withColumn("patch", F.floor(F.col("pid") / 50))
    return cluster.contact_votes(e, nodes, 0.6)


@query(f"with {_EDGE_SQL} select p, q, contacts, concave, 1 - concave / contacts >= 0.6 as merge from vote")
def contact_votes(spark, sf):
    """Contacts of patches and their votes."""
    return _votes(spark, sf)


@query(f"""with {_EDGE_SQL}, sides as (select p as patch, q as into_, contacts from vote union all select q, p, contacts from vote)
select patch, arg_max(into_, (contacts, into_)) as into from sides where patch % 5 = 0 and into_ % 5 > 0 group by patch""")
def strongest_contact(spark, sf):
    """A small patch's strongest neighbour."""
    from ..operators import cluster

    votes = _votes(spark, sf)
    patches = votes.select(F.col("p").alias("patch")).union(votes.select("q")).distinct()
    return cluster.strongest_contact(votes, patches.where("patch % 5 = 0"))


@query(f"""with {_EDGE_SQL}, patch as (select id as patch, case id % 4 when 0 then 'cylindrical' when 1 then 'irregular' when 2 then 'horizontal' else 'vertical' end as family, (id % 9) / 3.0::double as area from (select p as id from vote union select q from vote)),
m as (select v.*, a.family as pf, a.area as pa, b.family as qf, b.area as qa from vote v join patch a on a.patch = p join patch b on b.patch = q)
select p, q from m where not ((pf = 'cylindrical' and ((qf in ('horizontal', 'vertical') and qa >= 1.5) or (qf = 'irregular' and qa >= 0.375))) or (pf = 'irregular' and qf in ('horizontal', 'vertical') and qa >= 1.5)
or (qf = 'cylindrical' and ((pf in ('horizontal', 'vertical') and pa >= 1.5) or (pf = 'irregular' and pa >= 0.375))) or (qf = 'irregular' and pf in ('horizontal', 'vertical') and pa >= 1.5))""")
def semantic_veto(spark, sf):
    """Pairs of patches that may be one thing."""
    from ..operators import cluster

    n, votes = F.col("id"), _votes(spark, sf)
    family = F.element_at(F.array(*map(F.lit, ("cylindrical", "irregular", "horizontal", "vertical"))), (n % 4 + 1).cast("int"))
    patches = votes.select(F.col("p").alias("id")).union(votes.select("q")).distinct().select(n.alias("patch"), family.alias("family"), ((n % 9).cast("double") / 3.0).alias("area"))
    return cluster.semantic_veto(votes, patches).select("p", "q")


_PLANES_SQL = "plane as (select s_suppkey as plane_id, (s_suppkey % 7) / 10.0::double - 0.3 as z, (s_suppkey % 5) / 4.0::double - 0.8 as x0, (s_suppkey % 5) / 4.0::double + 0.2 as x1, (s_suppkey % 4) / 4.0::double - 0.8 as y0, (s_suppkey % 4) / 4.0::double + 0.2 as y1 from supplier)"


def _flats(spark, sf):
    k = F.col("s_suppkey")
    d = lambda n, m: (k % n).cast("double") / float(m)
    return table(spark, sf, "supplier").select(k.alias("plane_id"), (d(7, 10) - 0.3).alias("z"), (d(5, 4) - 0.8).alias("x0"), (d(5, 4) + 0.2).alias("x1"), (d(4, 4) - 0.8).alias("y0"), (d(4, 4) + 0.2).alias("y1"))


@query(f"""with {CLOUD_SQL}, {_PLANES_SQL}, n as (select plane_id, any_value(p.z) as z, count(*) filter (c.z - p.z between 0.08 and 0.20) as above, count(*) filter (p.z - c.z between 0.08 and 0.20) as below
 from plane p left join cloud c on c.x between p.x0 and p.x1 and c.y between p.y0 and p.y1 group by plane_id)
select plane_id, above, below, case when above > 2 and above >= 2 * below then 'floor' when below > 2 and below >= 2 * above then 'ceiling' when z < 0.0 then 'floor' else 'ceiling' end as kind from n""")
def plane_typing(spark, sf):
    """Floor or ceiling by what stands above and below."""
    from ..operators import structure

    return structure.horizontal_kind(cloud(spark, sf), _flats(spark, sf), least=2)


_WALLS_SQL = "wall as (select s_suppkey as plane_id, 0.6::double as a, 0.8::double as b, 0.0::double as c, (s_suppkey % 11) / 10.0::double - 0.5 as d, -1.0::double as x0, 0.5::double as x1, -1.0::double as y0, 0.5::double as y1, -0.5::double as z0, 0.5::double as z1 from supplier)"


@query(f"""with {CLOUD_SQL}, {_WALLS_SQL} select pid from cloud where exists (select 1 from wall w where x between w.x0 - 0.1 and w.x1 + 0.1 and y between w.y0 - 0.1 and w.y1 + 0.1 and z between w.z0 - 0.1 and w.z1 + 0.1
and abs(w.a * x + w.b * y + w.c * z + w.d) <= 0.05 and abs(w.a * y + w.b * z + w.c * x) >= 0.2)""")
def wall_completion(spark, sf):
    """P5: points that complete a wall."""
    from ..operators import structure

    k = F.col("s_suppkey")
    walls = table(spark, sf, "supplier").select(k.alias("plane_id"), F.lit(0.6).alias("a"), F.lit(0.8).alias("b"), F.lit(0.0).alias("c"), ((k % 11).cast("double") / 10.0 - 0.5).alias("d"), *(F.lit(v).alias(f"{c}{e}") for c, lo, hi in (("x", -1.0, 0.5), ("y", -1.0, 0.5), ("z", -0.5, 0.5)) for e, v in ((0, lo), (1, hi))))
    points = cloud(spark, sf).withColumns({"nx": F.col("y"), "ny": F.col("z"), "nz": F.col("x")})
    return structure.wall_completion(points, walls, structure.STRUCTURE | {"wall_align": 0.2}, 0.1)


@query(f"""with {CLOUD_SQL}, {_WALLS_SQL}, s as (select label, plane_id, avg((x between x0 - 0.3 and x1 + 0.3 and y between y0 - 0.3 and y1 + 0.3 and z between z0 - 0.3 and z1 + 0.3 and abs(a * x + b * y + c * z + d) <= 0.05)::int) as share
 from cloud, wall where label > 1 group by all) select label as cluster_id, arg_min((plane_id % 3)::int, plane_id) as code from s where share >= 0.05 group by label""")
def structural_residual(spark, sf):
    """Clusters that are the rest of a plane."""
    from ..operators import structure

    k = F.col("s_suppkey")
    planes = table(spark, sf, "supplier").select(k.alias("ord"), (k % 3).cast("int").alias("code"), F.lit(0.6).alias("a"), F.lit(0.8).alias("b"), F.lit(0.0).alias("c"), ((k % 11).cast("double") / 10.0 - 0.5).alias("d"), F.lit(0.3).alias("margin"), *(F.lit(v).alias(f"{c}{e}") for c, lo, hi in (("x", -1.0, 0.5), ("y", -1.0, 0.5), ("z", -0.5, 0.5)) for e, v in ((0, lo), (1, hi))))
    points = cloud(spark, sf).withColumnRenamed("label", "cluster_id")
    thick = points.select("cluster_id").distinct().withColumn("thickness", F.when(F.col("cluster_id") > 1, 0.1).otherwise(0.5))
    return structure.structural_residual(points, planes, thick, t=structure.STRUCTURE | {"residual_share": 0.05})



@query(f"""with {_FEATURE_SQL} select id as instance_id, round_even(a, 4) as d1, round_even(b, 4) as d2, round_even(h, 4) as d3, round_even(robust_z, 4) as z_extent, round_even(to_ceiling, 4) as to_ceiling, round_even(verticality, 4) as verticality,
case when verticality > 0.7 then 'vertical' when verticality < 0.35 then 'horizontal' else 'oblique' end as way from f""")
def signatures(spark, sf):
    """Signatures of instances and their orientation."""
    f = feature_rows(spark, sf).withColumns({"instance_id": F.col("id"), "label": F.lit(9), "centre": F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))})
    return review.signature(f).select("instance_id", "d1", "d2", "d3", "z_extent", "to_ceiling", "verticality", expr.orientation(F.col("verticality")).alias("way"))


@query(f"""with {_FEATURE_SQL} select id, case when id % 4 = 0 then 'Tubazione' when id % 4 = 1 then 'Condotta circolare' when id % 4 = 2 then 'Condotta rettangolare' else 'Struttura / non-MEP' end as classe, n as n_punti,
case when id % 4 in (0, 1) and valid then round_even(radius, 4) end as raggio_stimato, case when id % 4 in (0, 1) and valid then round_even(2 * radius, 4) end as diametro_stimato, case when id % 4 in (0, 1) and valid then round_even(length, 3) end as lunghezza_stimata from f""")
def report_rows(spark, sf):
    """Rows of the report; cylinder columns only for pipes and round ducts."""
    from ..sources.writers import instance_rows

    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    label = F.element_at(F.array(*map(F.lit, (3, 1, 2, 0))), (F.col("id") % 4 + 1).cast("int")).cast("smallint")
    f = feature_rows(spark, sf).withColumns({"instance_id": F.col("id"), "label": label, "centre": zero, "cylinder": F.struct("cylinder.valid", "cylinder.radius", "cylinder.length", zero.alias("axis"))})
    return instance_rows(f).select("id", "classe", "n_punti", "raggio_stimato", "diametro_stimato", "lunghezza_stimata")


@query("select kind, n from (select 'points' as kind, count(*) as n from events union all select 'users', count(distinct user_id) from events)")
def union_scans(spark, sf):
    """Scans together, then totals."""
    e = table(spark, sf, "events")
    scans = [e.where(F.col("event_id") % 3 == k).select("event_id", "user_id") for k in range(3)]
    every = scans[0].unionByName(scans[1]).unionByName(scans[2])
    return every.agg(F.count(F.lit(1)).alias("points"), F.count_distinct("user_id").alias("users")).selectExpr("stack(2, 'points', points, 'users', users) as (kind, n)")


@query("select window_start, event_type, count(*) as n from (select time_bucket(interval '1 hour', ts) as window_start, event_type from events) group by all")
def event_windows(spark, sf):
    """An extra: event-time windows with a watermark, as a batch."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "10 minutes")
    return e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(f"with {LATTICE_SQL} select (case when z < 5 then 11 else 12 end)::smallint as label, count(*) as n from (select distinct x, y, z from lattice) group by 1")
def room_structure(spark, sf):
    """Floors and ceilings of a lattice of levels, typed by the middle height where evidence is even."""
    from ..operators import structure

    t = structure.STRUCTURE | {"plane_distance": 0.25, "plane_points": 300, "component_cell": 10.0, "plane_cell": 8.0, "bump_min": 9.0}
    points = lattice(spark, sf).select("x", "y", "z").distinct().withColumn("pid", ((F.col("x") * 10_000 + F.col("y")) * 100 + F.col("z")).cast("long"))
    out, _, _, _ = structure.extract_structure(points.withColumn("label", F.lit(CODE["MEP_GENERICO"]).cast("smallint")), t, 1.0)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
