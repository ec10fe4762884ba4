"""The engine's own queries over the star schema, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestq.sources.star import star_engine
from nestq.streaming.events import topic_matches, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _gql(name: str, text: str, sql: str, after: Callable[[DataFrame], DataFrame] | None = None, variables: dict | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = star_engine(spark, folder).frame(text, variables)
        return after(df) if after else df

    QUERIES[name], ORACLE[name] = run, sql


def _where(name: str, where: str, sql: str, entity: str = "orders", columns: str = "orderkey totalprice", select: str = "o_orderkey AS orderkey, o_totalprice AS totalprice", table: str = "orders", variables: dict | None = None, head: str = "") -> None:
    _gql(f"where_{name}", f"{head}{{ {entity}(where: {where}) {{ items {{ {columns} }} }} }}", f"SELECT {select} FROM {table} WHERE {sql}", variables=variables)


_PART = {"entity": "parts", "columns": "partkey name", "select": "p_partkey AS partkey, p_name AS name", "table": "part"}
_EVENT = {"entity": "events", "columns": "eventId props", "select": 'event_id AS "eventId", props', "table": "events"}


# -- scans and projections
_gql("scan_project", "{ orders { items { orderkey orderstatus totalprice orderdate } } }", "SELECT o_orderkey AS orderkey, o_orderstatus AS orderstatus, o_totalprice AS totalprice, o_orderdate AS orderdate FROM orders")
_gql("alias_project", "{ orders { items { key: orderkey price: totalprice } } }", "SELECT o_orderkey AS key, o_totalprice AS price FROM orders")
_gql("virtual_field", "{ parts { items { partkey label } } }", "SELECT p_partkey AS partkey, p_brand || ' / ' || p_type AS label FROM part")
_gql("virtual_entity", "{ nationStatistics { items { nationkey customers } } }", "SELECT c_nationkey AS nationkey, count(*) AS customers FROM customer GROUP BY 1")
_gql("view_alias_entity", "{ miniCustomers(where: {custkey: {lt: 100}}) { items { custkey name shown } } }", "SELECT c_custkey AS custkey, c_name AS name, upper(c_name) AS shown FROM customer WHERE c_custkey < 100")
_gql("view_excluded_field", "{ publicCustomers { items { custkey name mktsegment } } }", "SELECT c_custkey AS custkey, c_name AS name, c_mktsegment AS mktsegment FROM customer")
_gql("fragments_directives", "query($yes: Boolean = true, $no: Boolean = false) { orders { items { ...a totalprice @skip(if: $yes) orderstatus @include(if: $no) ... on Order { orderdate } } } } fragment a on Order { orderkey custkey }", "SELECT o_orderkey AS orderkey, o_custkey AS custkey, o_orderdate AS orderdate FROM orders")
_gql("typename", "{ regions { items { __typename name } } }", "SELECT 'Region' AS __typename, r_name AS name FROM region")

# -- predicates
_where("eq", '{orderstatus: {eq: "O"}}', "o_orderstatus = 'O'")
_where("ne", '{orderstatus: {ne: "O"}}', "o_orderstatus <> 'O'")
_where("gt", "{totalprice: {gt: 200000}}", "o_totalprice > 200000")
_where("ge", "{custkey: {ge: 700}}", "o_custkey >= 700")
_where("lt", "{totalprice: {lt: 5000.5}}", "o_totalprice < 5000.5")
_where("le", "{orderkey: {le: 1000}}", "o_orderkey <= 1000")
_where("in", '{orderpriority: {in: ["1-URGENT", "2-HIGH"]}}', "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_where("in_scalar", "{custkey: {in: 7}}", "o_custkey IN (7)")
_where("ni", '{orderpriority: {ni: ["1-URGENT", "2-HIGH"]}}', "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_where("is_null", "{pid: {is: NULL}}", "p_partkey = 0", entity="partNodes", columns="id", select="p_partkey AS id", table="part")
_where("is_not_null", "{pid: {is: NOT_NULL}}", "p_partkey > 0", entity="partNodes", columns="id pid", select="p_partkey AS id, CAST(floor((p_partkey - 1) / 10) AS BIGINT) AS pid", table="part")
_where("like", '{name: {like: "%a%e%"}}', "p_name LIKE '%a%e%'", **_PART)
_where("ilike", '{name: {iLike: "%A%E%"}}', "p_name ILIKE '%A%E%'", **_PART)
_where("regex", '{name: {regex: "[aeiou]{2}"}}', "regexp_matches(p_name, '[aeiou]{2}')", **_PART)
_where("iregex", '{name: {iRegex: "^[A-M]"}}', "regexp_matches(p_name, '(?i)^[A-M]')", **_PART)
_where("haskey", '{props: {hasKey: "k"}}', "list_contains(json_keys(props), 'k')", **_EVENT)
_where("haskey_any", '{props: {hasKeyAny: ["zz", "k"]}}', "list_has_any(json_keys(props), ['zz', 'k'])", **_EVENT)
_where("haskey_all", '{props: {hasKeyAll: ["k"]}}', "list_has_all(json_keys(props), ['k'])", **_EVENT)
_where("and", "{and: [{totalprice: {gt: 100000}}, {custkey: {lt: 500}}]}", "o_totalprice > 100000 AND o_custkey < 500")
_where("or", '{or: [{totalprice: {gt: 300000}}, {orderstatus: {eq: "F"}}]}', "o_totalprice > 300000 OR o_orderstatus = 'F'")
_where("not", '{not: {orderstatus: {eq: "O"}}}', "NOT o_orderstatus = 'O'")
_where("not_null_logic", "{not: {pid: {lt: 5}}}", "NOT (nullif(CASE WHEN p_partkey > 0 THEN CAST(floor((p_partkey - 1) / 10) AS BIGINT) END, -1) < 5)", entity="partNodes", columns="id", select="p_partkey AS id", table="part")
_where("nested_bool", '{or: [{and: [{totalprice: {gt: 250000}}, {not: {orderstatus: {eq: "P"}}}]}, {custkey: {in: [1, 2, 3]}, totalprice: {lt: 100000}}]}', "(o_totalprice > 250000 AND NOT o_orderstatus = 'P') OR (o_custkey IN (1, 2, 3) AND o_totalprice < 100000)")
_where("multi_op", "{totalprice: {gt: 50000, le: 60000}}", "o_totalprice > 50000 AND o_totalprice <= 60000")
_where("date", '{orderdate: {ge: "1995-01-01", lt: "1996-01-01T00:00:00"}}', "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_gql("where_id_arg", "{ orders(id: 42, where: {totalprice: {gt: 0}}) { items { orderkey totalprice } } }", "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders WHERE o_orderkey = 42 AND o_totalprice > 0")
_where("variables", "{totalprice: {gt: $p}, orderstatus: {in: $s}}", "o_totalprice > 150000 AND o_orderstatus IN ('O', 'P')", head='query($p: Float!, $s: [String!] = ["O", "P"]) ', variables={"p": 150000})

# -- sort and paging
_gql("sort_multi", "{ orders(sort: [{orderpriority: DESC}, {totalprice: ASC}], limit: 100) { items { orderkey orderpriority totalprice } } }", "SELECT o_orderkey AS orderkey, o_orderpriority AS orderpriority, o_totalprice AS totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 100")
_NODES = "(SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN CAST(floor((p_partkey - 1) / 10) AS BIGINT) END AS pid, p_size AS size FROM part)"
for _name, _dir, _sql in (("nulls_first", "ASC_NULLS_FIRST", "ASC NULLS FIRST"), ("nulls_last", "DESC_NULLS_LAST", "DESC NULLS LAST"), ("default_nulls_asc", "ASC", "ASC NULLS LAST"), ("default_nulls_desc", "DESC", "DESC NULLS FIRST"), ("desc_nulls_first", "DESC_NULLS_FIRST", "DESC NULLS FIRST"), ("asc_nulls_last", "ASC_NULLS_LAST", "ASC NULLS LAST")):
    _gql(f"sort_{_name}", f"{{ partNodes(sort: {{pid: {_dir}}}, limit: 25) {{ items {{ id pid }} }} }}", f"SELECT id, pid FROM {_NODES} ORDER BY pid {_sql}, id LIMIT 25")
_gql("order_by_legacy", "{ orders(orderBy: {totalprice: DESC}, limit: 20) { items { orderkey totalprice } } }", "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_gql("limit_offset", "{ orders(sort: {totalprice: DESC}, limit: 20, offset: 30) { items { orderkey totalprice } } }", "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
_gql("top_k", "{ customers(sort: {acctbal: DESC}, limit: 10) { items { custkey acctbal } } }", "SELECT c_custkey AS custkey, c_acctbal AS acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
_gql("cursor_after", "{ orders(after: 100, limit: 15) { items { orderkey } } }", "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 15")
_gql("cursor_after_encoded", '{ orders(first: 15, after: "eyJvcmRlcmtleSI6MTAwfQ==") { items { orderkey } } }', "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey > 100 ORDER BY 1 LIMIT 15")
_gql("cursor_before", "{ orders(before: 20, limit: 50) { items { orderkey } } }", "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey < 20 ORDER BY 1 LIMIT 50")
_gql("first_page", "{ orders(first: 7) { items { orderkey totalprice } } }", "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders ORDER BY 1 LIMIT 7")
_gql("last_page", "{ orders(last: 7) { items { orderkey totalprice } } }", "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders ORDER BY 1 DESC LIMIT 7")
_gql("cursor_composite_key", "{ conversations(after: {convId: 20, turn: 1}, first: 30) { items { convId turn role } } }", 'SELECT conv_id AS "convId", turn, role FROM conversations WHERE conv_id > 20 OR (conv_id = 20 AND turn > 1) ORDER BY 1, 2 LIMIT 30')
_gql("page_total", "{ orders(where: {totalprice: {gt: 100000}}, limit: 2) { total } }", "SELECT count(*) AS total FROM orders WHERE o_totalprice > 100000")
_gql("distinct_on", '{ orderList(sort: [{orderstatus: ASC}, {totalprice: DESC}], limit: 500, distinct: ["orderstatus", "orderpriority"]) { orderkey orderstatus orderpriority } }', "SELECT DISTINCT ON (o_orderstatus, o_orderpriority) o_orderkey AS orderkey, o_orderstatus AS orderstatus, o_orderpriority AS orderpriority FROM (SELECT * FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 500) ORDER BY o_orderstatus, o_orderpriority, o_totalprice DESC, o_orderkey")


def _page_info(spark: SparkSession, folder: str) -> DataFrame:
    r = star_engine(spark, folder).execute("{ orders(first: 10, after: 50) { pageInfo { hasNext hasPrev } } }")
    return spark.createDataFrame([(r["data"]["orders"]["pageInfo"]["hasNext"], r["data"]["orders"]["pageInfo"]["hasPrev"])], "has_next boolean, has_prev boolean")


QUERIES["page_info"] = _page_info
ORACLE["page_info"] = "SELECT (SELECT count(*) FROM orders WHERE o_orderkey > 50) > 10 AS has_next, true AS has_prev"


# -- relations
def _unnested(name: str, *outs: str, keep_empty: bool = True) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        explode = F.explode_outer if keep_empty else F.explode
        return df.withColumn("x", explode(name)).select(*[c for c in df.columns if c != name], *[F.col(f"x.{o}").alias(f"{name}_{o}") for o in outs])

    return run


_gql("rel_many_to_one", "{ orders { items { orderkey customer { custkey name } } } }", "SELECT o_orderkey AS orderkey, c_custkey AS custkey, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey", lambda df: df.select("orderkey", "customer.custkey", "customer.name"))
_gql("rel_one_to_many", "{ orders { items { orderkey lineitems { linenumber quantity } } } }", "SELECT o_orderkey AS orderkey, l_linenumber AS lineitems_linenumber, l_quantity AS lineitems_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey", _unnested("lineitems", "linenumber", "quantity"))
_gql("rel_empty_list", "{ orders { items { orderkey lineitems { linenumber } } } }", "SELECT o_orderkey AS orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INT AS n FROM orders", lambda df: df.select("orderkey", F.size("lineitems").alias("n")))
_gql("rel_many_to_many", "{ parts(where: {partkey: {lt: 200}}) { items { partkey suppliers { suppkey } } } }", "SELECT p_partkey AS partkey, s_suppkey AS suppliers_suppkey FROM part LEFT JOIN (lineitem JOIN supplier ON s_suppkey = l_suppkey) ON l_partkey = p_partkey WHERE p_partkey < 200", _unnested("suppliers", "suppkey"))
_gql("rel_self_parent", "{ partNodes { items { id parent { id size } } } }", f"SELECT a.id, b.id AS parent_id, b.size AS parent_size FROM {_NODES} a LEFT JOIN {_NODES} b ON b.id = a.pid", lambda df: df.select("id", F.col("parent.id").alias("parent_id"), F.col("parent.size").alias("parent_size")))
_gql("rel_self_children", "{ partNodes(where: {id: {lt: 50}}) { items { id children { id } } } }", f"SELECT a.id, b.id AS children_id FROM {_NODES} a LEFT JOIN {_NODES} b ON b.pid = a.id WHERE a.id < 50", _unnested("children", "id"))
_DOWN = f"WITH RECURSIVE n AS {_NODES}, r AS (SELECT id AS root, id, 0 AS lvl FROM n WHERE id IN (0, 1, 2) UNION ALL SELECT r.root, n.id, lvl + 1 FROM r JOIN n ON n.pid = r.id"
_gql("rel_recursive_children", "{ partNodes(where: {id: {in: [0, 1, 2]}}) { items { id children(level: 0) { id } } } }", f"{_DOWN}) SELECT root AS id, id AS children_id FROM r WHERE lvl > 0", _unnested("children", "id", keep_empty=False))
_gql("rel_recursive_levels", "{ partNodes(where: {id: {in: [0, 1, 2]}}) { items { id children(level: 2) { id } } } }", f"{_DOWN} WHERE lvl < 2) SELECT root AS id, id AS children_id FROM r WHERE lvl > 0", _unnested("children", "id", keep_empty=False))
_gql("rel_recursive_where", "{ partNodes(where: {id: {in: [0, 1, 2]}}) { items { id children(level: 0, where: {size: {gt: 10}}) { id } } } }", f"{_DOWN} WHERE n.size > 10) SELECT root AS id, id AS children_id FROM r WHERE lvl > 0", _unnested("children", "id", keep_empty=False))
_gql("rel_recursive_parents", "{ partNodes(where: {id: {gt: 1500}}) { items { id ancestors(level: 0) { id } } } }", f"WITH RECURSIVE n AS {_NODES}, r AS (SELECT id AS root, pid AS id FROM n WHERE id > 1500 UNION ALL SELECT r.root, n.pid FROM r JOIN n ON n.id = r.id WHERE n.pid IS NOT NULL AND n.pid <> n.id) SELECT root AS id, id AS ancestors_id FROM r", _unnested("ancestors", "id", keep_empty=False))
_gql("rel_child_where", "{ customers { items { custkey orders(where: {totalprice: {gt: 200000}}) { orderkey } } } }", "SELECT c_custkey AS custkey, o_orderkey AS orders_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000", _unnested("orders", "orderkey"))
_gql("rel_child_topk", "{ customers { items { custkey orders(sort: {totalprice: DESC}, limit: 2, offset: 1) { orderkey totalprice } } } }", "SELECT c_custkey AS custkey, o_orderkey AS orders_orderkey, o_totalprice AS orders_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) ON o_custkey = c_custkey AND rn BETWEEN 2 AND 3", _unnested("orders", "orderkey", "totalprice"))
_gql(
    "rel_three_level",
    "{ nations { items { nationkey customers(where: {acctbal: {gt: 5000}}) { custkey orders(where: {orderstatus: {eq: \"F\"}}) { orderkey } } } } }",
    "SELECT n_nationkey AS nationkey, c_custkey AS custkey, o_orderkey AS orderkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'",
    lambda df: df.withColumn("c", F.explode_outer("customers")).withColumn("o", F.explode_outer("c.orders")).select("nationkey", "c.custkey", "o.orderkey"),
)
_gql("rel_filter_semi", "{ customers(where: {orders: {totalprice: {gt: 300000}}}) { items { custkey } } }", "SELECT c_custkey AS custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_gql("rel_filter_anti", "{ orders(where: {not: {lineitems: {linenumber: {ge: 0}}}}) { items { orderkey } } }", "SELECT o_orderkey AS orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_gql("rel_filter_many_to_many", "{ parts(where: {suppliers: {acctbal: {lt: 0}}}) { items { partkey } } }", "SELECT p_partkey AS partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal < 0)")
_gql("rel_optional_one", "{ documents { items { docId labels { quality } } } }", 'SELECT d.doc_id AS "docId", quality AS labels_quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id', _unnested("labels", "quality"))
_gql("through_entity", "{ suppliers(where: {suppkey: {lt: 10}}) { items { suppkey lineitems { orderkey partkey } } } }", "SELECT s_suppkey AS suppkey, l_orderkey AS lineitems_orderkey, l_partkey AS lineitems_partkey FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey < 10", _unnested("lineitems", "orderkey", "partkey"))

# the same relations, recursions and views over all rows, without a filter on ids
_gql("view_alias_entity_all", "{ miniCustomers { items { custkey name shown } } }", "SELECT c_custkey AS custkey, c_name AS name, upper(c_name) AS shown FROM customer")
_gql("rel_many_to_many_all", "{ parts { items { partkey suppliers { suppkey } } } }", "SELECT p_partkey AS partkey, s_suppkey AS suppliers_suppkey FROM part LEFT JOIN (lineitem JOIN supplier ON s_suppkey = l_suppkey) ON l_partkey = p_partkey", _unnested("suppliers", "suppkey"))
_gql("rel_self_children_all", "{ partNodes { items { id children { id } } } }", f"SELECT a.id, b.id AS children_id FROM {_NODES} a LEFT JOIN {_NODES} b ON b.pid = a.id", _unnested("children", "id"))
_DOWN_ALL = f"WITH RECURSIVE n AS {_NODES}, r AS (SELECT id AS root, id, 0 AS lvl FROM n UNION ALL SELECT r.root, n.id, lvl + 1 FROM r JOIN n ON n.pid = r.id AND n.pid <> n.id"
_gql("rel_recursive_children_all", "{ partNodes { items { id children(level: 0) { id } } } }", f"{_DOWN_ALL}) SELECT root AS id, id AS children_id FROM r WHERE lvl > 0", _unnested("children", "id", keep_empty=False))
_gql("rel_recursive_levels_all", "{ partNodes { items { id children(level: 2) { id } } } }", f"{_DOWN_ALL} WHERE lvl < 2) SELECT root AS id, id AS children_id FROM r WHERE lvl > 0", _unnested("children", "id", keep_empty=False))
_gql("rel_recursive_where_all", "{ partNodes { items { id children(level: 0, where: {size: {gt: 10}}) { id } } } }", f"{_DOWN_ALL} WHERE n.size > 10) SELECT root AS id, id AS children_id FROM r WHERE lvl > 0", _unnested("children", "id", keep_empty=False))
_gql("rel_recursive_parents_all", "{ partNodes { items { id ancestors(level: 0) { id } } } }", f"WITH RECURSIVE n AS {_NODES}, r AS (SELECT id AS root, pid AS id FROM n WHERE pid IS NOT NULL AND pid <> id UNION ALL SELECT r.root, n.pid FROM r JOIN n ON n.id = r.id WHERE n.pid IS NOT NULL AND n.pid <> n.id) SELECT root AS id, id AS ancestors_id FROM r", _unnested("ancestors", "id", keep_empty=False))
_gql("through_entity_all", "{ suppliers { items { suppkey lineitems { orderkey partkey } } } }", "SELECT s_suppkey AS suppkey, l_orderkey AS lineitems_orderkey, l_partkey AS lineitems_partkey FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey", _unnested("lineitems", "orderkey", "partkey"))


def _multi_root(spark: SparkSession, folder: str) -> DataFrame:
    frames = star_engine(spark, folder).frames("{ a: regions { items { name } } b: nations { items { name } } }")
    return frames["a"].select(F.lit("a").alias("root"), "name").union(frames["b"].select(F.lit("b"), "name"))


QUERIES["multi_root"] = _multi_root
ORACLE["multi_root"] = "SELECT 'a' AS root, r_name AS name FROM region UNION ALL SELECT 'b', n_name FROM nation"


# -- statistics
def _flat(*paths: str) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        outs = []
        for p in paths:
            c = F.col(p)
            outs.append((F.round(c, 2) if p.endswith((".sum", ".avg")) else c).alias(p.replace(".", "_")))
        return df.select(*outs)

    return run


_gql("stats_number", "{ orderStats { count totalprice { sum avg min max count countDistinct } } }", "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS totalprice_sum, round(avg(o_totalprice), 2) AS totalprice_avg, min(o_totalprice) AS totalprice_min, max(o_totalprice) AS totalprice_max, count(o_totalprice) AS totalprice_count, count(DISTINCT o_totalprice) AS \"totalprice_countDistinct\" FROM orders", _flat("count", *[f"totalprice.{a}" for a in ("sum", "avg", "min", "max", "count", "countDistinct")]))
_gql("stats_string", "{ partStats { brand { min max count countDistinct } } }", 'SELECT min(p_brand) AS brand_min, max(p_brand) AS brand_max, count(p_brand) AS brand_count, count(DISTINCT p_brand) AS "brand_countDistinct" FROM part', _flat("brand.min", "brand.max", "brand.count", "brand.countDistinct"))
_gql("stats_datetime", "{ orderStats { orderdate { min max count countDistinct } } }", 'SELECT min(o_orderdate) AS orderdate_min, max(o_orderdate) AS orderdate_max, count(o_orderdate) AS orderdate_count, count(DISTINCT o_orderdate) AS "orderdate_countDistinct" FROM orders', _flat("orderdate.min", "orderdate.max", "orderdate.count", "orderdate.countDistinct"))
_gql("stats_count_distinct", "{ lineitemStats { partkey { countDistinct } suppkey { countDistinct } } }", 'SELECT count(DISTINCT l_partkey) AS "partkey_countDistinct", count(DISTINCT l_suppkey) AS "suppkey_countDistinct" FROM lineitem', _flat("partkey.countDistinct", "suppkey.countDistinct"))
_gql("stats_where", '{ lineitemStats(where: {shipdate: {lt: "1995-01-01"}}) { count extendedprice { sum } } }', "SELECT count(*) AS count, round(sum(l_extendedprice), 2) AS extendedprice_sum FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01'", _flat("count", "extendedprice.sum"))
_gql("stats_empty", "{ orderStats(where: {orderkey: {lt: 0}}) { count totalprice { sum min } } }", "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS totalprice_sum, min(o_totalprice) AS totalprice_min FROM orders WHERE o_orderkey < 0", _flat("count", "totalprice.sum", "totalprice.min"))
_gql("group_by", '{ lineitemStats(groupBy: {fields: ["returnflag", "linestatus"]}) { groupBy { key count quantity { sum avg } } } }', "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, count(*) AS count, round(sum(l_quantity), 2) AS quantity_sum, round(avg(l_quantity), 2) AS quantity_avg FROM lineitem GROUP BY 1, 2", _flat("returnflag", "linestatus", "count", "quantity.sum", "quantity.avg"))
_gql("group_having", '{ orderStats(groupBy: {fields: ["custkey"], having: {count: {gt: 12}, totalprice: {sum: {gt: 1000000}}}}) { groupBy { key count } } }', "SELECT o_custkey AS custkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 12 AND sum(o_totalprice) > 1000000")
_gql("group_sort_limit", '{ orderStats(groupBy: {fields: ["custkey"], sort: {count: DESC}, limit: 10}) { groupBy { key count } } }', "SELECT o_custkey AS custkey, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_gql("group_time_bucket", '{ orderStats(groupBy: {fields: ["orderdate:month"]}) { groupBy { key count totalprice { sum } } } }', "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS orderdate, count(*) AS count, round(sum(o_totalprice), 2) AS totalprice_sum FROM orders GROUP BY 1", lambda df: _flat("orderdate", "count", "totalprice.sum")(df.withColumn("orderdate", F.col("orderdate").cast("timestamp_ntz"))))
_gql("cond_agg", '{ orderStats { big: count(where: {totalprice: {gt: 200000}}) totalprice(where: {orderstatus: {eq: "F"}}) { sum } } }', "SELECT count(*) FILTER (WHERE o_totalprice > 200000) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS totalprice_sum FROM orders", _flat("big", "totalprice.sum"))


# -- mutations: the image, or the rows touched
def _mut(name: str, entity: str, texts: list[str], sql: str, columns: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = star_engine(spark, folder)
        for t in texts:
            e.frame(t)
        df = e.image(entity)
        return df.select(*[F.col(c).alias(a) for c, a in (columns or dict(zip(df.columns, df.columns, strict=True))).items()])

    QUERIES[f"mut_{name}"], ORACLE[f"mut_{name}"] = run, sql


_ATLANTIS = 'createRegion(input: {regionkey: 9, name: "ATLANTIS"}) { regionkey name }'
_mut("create", "Region", [f"mutation {{ {_ATLANTIS} }}"], "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'ATLANTIS'")
_mut("insert_nested", "Nation", ['mutation { regionList(insert: {regionkey: 9, name: "ATLANTIS", nations: [{nationkey: 90, name: "A"}, {nationkey: 91, name: "B"}]}) { name } }'], "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM (VALUES (90, 'A', 9), (91, 'B', 9))")
_mut("update", "Customer", ['mutation { updateCustomer(input: {mktsegment: "NONE", acctbal: 0}, where: {acctbal: {lt: 0}}) { custkey } }'], "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END::DOUBLE AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer")
_mut("delete_image", "Order", ['mutation { deleteOrder(where: {orderstatus: {eq: "F"}}) }'], "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", {"o_orderkey": "o_orderkey"})
_gql("mut_delete_count", "mutation { n: deleteOrder(where: {totalprice: {lt: 50000}}) }", "SELECT count(*) AS n FROM orders WHERE o_totalprice < 50000")
_gql("mut_batch_delete_count", "mutation { n: batchDeleteOrder(filter: {totalprice: {lt: 50000}}) }", "SELECT count(*) AS n FROM orders WHERE o_totalprice < 50000")
_gql("mut_delete_returning", "mutation { orderList(delete: true, where: {totalprice: {lt: 20000}}) { orderkey totalprice } }", "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders WHERE o_totalprice < 20000")
_gql("mut_update_returning", 'mutation { orderList(update: {orderstatus: "X"}, where: {custkey: {eq: 7}}) { orderkey orderstatus } }', "SELECT o_orderkey AS orderkey, 'X' AS orderstatus FROM orders WHERE o_custkey = 7")
_mut("upsert", "Nation", ['mutation { nationList(upsert: [{nationkey: 1, name: "ONE"}, {nationkey: 2, name: "TWO"}, {nationkey: 77, name: "NEW", regionkey: 1}], where: {nationkey: {lt: 2}}) { nationkey } }'], "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'ONE' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 77, 'NEW', 1")
_mut("connect", "Nation", ["mutation { updateRegion(id: 0, input: {nations: {connect: [3, 4]}}) { regionkey } }"], "SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (3, 4) THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")
_mut("disconnect", "Nation", ["mutation { updateRegion(id: 0, input: {nations: {disconnect: [0, 5, 10]}}) { regionkey } }"], "SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (0, 5, 10) AND n_regionkey = 0 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation")
_mut("several", "Region", [f"mutation {{ {_ATLANTIS} }}", 'mutation { updateRegion(id: 9, input: {name: "MU"}) { name } }', "mutation { deleteRegion(id: 0) }"], "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 9, 'MU'")

# -- policies and streams
_gql("soft_delete_scope", "{ scopedCustomers { items { custkey name } } }", "SELECT c_custkey AS custkey, c_name AS name FROM customer WHERE NOT c_acctbal < 0")
_gql("soft_delete_unscoped", "{ scopedCustomers(unscoped: true) { items { custkey } } }", "SELECT c_custkey AS custkey FROM customer")


def _topics(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.concat_ws(":", F.lit("user"), F.col("user_id").cast("string"), "event_type").alias("topic"))
    kind = spark.read.parquet(f"{folder}/events.parquet").agg(F.min("event_type")).first()[0]
    return events.where(topic_matches(F.col("topic"), f"user:*:{kind}"))


QUERIES["event_topics"] = _topics
ORACLE["event_topics"] = "SELECT event_id, 'user:' || user_id || ':' || event_type AS topic FROM events WHERE event_type = (SELECT min(event_type) FROM events)"
QUERIES["event_windows"] = lambda spark, folder: windowed_counts(spark.read.parquet(f"{folder}/events.parquet"), "ts", "1 day", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
ORACLE["event_windows"] = "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
_gql("subscription_once", "subscription { regions { items { regionkey name } } }", "SELECT r_regionkey AS regionkey, r_name AS name FROM region")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of a segment with their three dearest open orders."""
    text = '{ customers(where: {mktsegment: {eq: "BUILDING"}}, sort: {acctbal: DESC}, limit: 50) { items { custkey name nation { name } orders(where: {orderstatus: {ne: "F"}}, sort: {totalprice: DESC}, limit: 3) { orderkey totalprice } } } }'
    return star_engine(spark, folder).frame(text)
