"""The catalog of the star-schema tables that the queries of ``__spark_entry__`` run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nestq.engine import Engine
from nestq.functions.resolvers import Resolvers
from nestq.sources.catalog import Catalog, Options
from nestq.sources.loaders import ConfigSource, TableSource

KEYS: dict[str, dict] = {
    "region": {"primary": ["r_regionkey"]},
    "nation": {"primary": ["n_nationkey"], "foreign": {"n_regionkey": "region.r_regionkey"}},
    "customer": {"primary": ["c_custkey"], "foreign": {"c_nationkey": "nation.n_nationkey"}},
    "supplier": {"primary": ["s_suppkey"], "foreign": {"s_nationkey": "nation.n_nationkey"}},
    "part": {"primary": ["p_partkey"]},
    "orders": {"primary": ["o_orderkey"], "foreign": {"o_custkey": "customer.c_custkey"}},
    "lineitem": {"foreign": {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"}},
    "events": {"primary": ["event_id"], "foreign": {"user_id": "customer.c_custkey"}, "json": ["props"]},
    "documents": {"primary": ["doc_id"]},
    "labels": {"primary": ["doc_id"], "foreign": {"doc_id": "documents.doc_id"}},
    "pages": {"primary": ["page_id"]},
    "benchmark": {"primary": ["item_id"]},
    "conversations": {"primary": ["conv_id", "turn"]},
}
PREFIXES = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_"}


def _many_to_many(near: str, near_key: str, far: str, far_key: str, bridge_near: str, bridge_far: str) -> dict:
    through = {"table": "lineitem", "source_key": bridge_near, "target_key": bridge_far}
    return {"relation": {"type": "many_to_many", "target_class": far, "source_column": near_key, "target_column": far_key, "through": through}}


CONFIG = {
    "classes": {
        "Part": {
            "fields": {
                "suppliers": _many_to_many("Part", "p_partkey", "Supplier", "s_suppkey", "l_partkey", "l_suppkey"),
                "label": {"virtual": True, "type": "String", "resolver": "part_label"},
            }
        },
        "Supplier": {"fields": {"parts": _many_to_many("Supplier", "s_suppkey", "Part", "p_partkey", "l_suppkey", "l_partkey")}},
        "Order": {"fields": {"parts": _many_to_many("Order", "o_orderkey", "Part", "p_partkey", "l_orderkey", "l_partkey")}},
        "PublicCustomer": {"table": "customer", "exclude_fields": ["acctbal"]},
        "MiniCustomer": {"table": "customer", "include_fields": ["custkey", "name"], "fields": {"shown": {"virtual": True, "resolver": "shown_name"}}},
        "NationStatistic": {
            "resolver": "nation_statistics",
            "primary_keys": ["nationkey"],
            "fields": {"nationkey": {"column": "nationkey", "type": "int"}, "customers": {"column": "customers", "type": "int"}},
        },
        "ScopedCustomer": {"resolver": "scoped_customers", "primary_keys": ["custkey"], "deleted_at": "deleted_at", "fields": {"custkey": {"column": "custkey", "type": "bigint"}, "name": {"column": "name", "type": "text"}, "deletedAt": {"column": "deleted_at", "type": "timestamp"}}},
        "PartNode": {
            "resolver": "part_nodes",
            "primary_keys": ["id"],
            "fields": {
                "id": {"column": "id", "type": "bigint"},
                "pid": {"column": "pid", "type": "bigint"},
                "size": {"column": "size", "type": "int"},
                "parent": {"relation": {"type": "recursive", "target_class": "PartNode", "source_column": "pid", "target_column": "id", "up": True}},
                "children": {"relation": {"type": "recursive", "target_class": "PartNode", "source_column": "id", "target_column": "pid"}},
                "ancestors": {"relation": {"type": "recursive", "target_class": "PartNode", "source_column": "pid", "target_column": "id", "up": True}},
            },
        },
    }
}


def star_catalog(spark: SparkSession, folder: str, default_limit: int | None = 10) -> Catalog:
    """Parquet tables of ``folder``: keys and relations declared, columns without their table's prefix."""
    read = {t: _reader(f"{folder}/{t}.parquet") for t in KEYS}
    catalog = Catalog(Options(default_limit=default_limit, column_prefixes=PREFIXES))
    catalog.with_source(TableSource(spark, read, KEYS)).with_source(ConfigSource(CONFIG))
    customer, part = read["customer"], read["part"]
    key = F.col("p_partkey")
    catalog.bind("nation_statistics", lambda s: customer(s).groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("customers")))
    catalog.bind("scoped_customers", lambda s: customer(s).select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")).alias("deleted_at")))
    catalog.bind("part_nodes", lambda s: part(s).select(key.alias("id"), F.when(key > 0, F.floor((key - 1) / 10).cast("bigint")).alias("pid"), F.col("p_size").alias("size")))
    catalog.build()
    catalog.entity("PartNode").fields["ancestors"].list = True
    return catalog


#: Schemas by path: a footer is read once, not once a query.
_SCHEMAS: dict[str, StructType] = {}


def _reader(path: str):
    def read(spark: SparkSession) -> DataFrame:
        if path not in _SCHEMAS:
            _SCHEMAS[path] = spark.read.parquet(path).schema
        return spark.read.schema(_SCHEMAS[path]).parquet(path)

    return read


def star_engine(spark: SparkSession, folder: str, **options) -> Engine:
    resolvers = Resolvers()
    resolvers.register("part_label", lambda df: F.concat_ws(" / ", F.col("p_brand"), F.col("p_type")))
    resolvers.register("shown_name", lambda df: F.upper(F.col("c_name")))
    return Engine(spark, star_catalog(spark, folder, options.pop("default_limit", 10)), resolvers, **options)
