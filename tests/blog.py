"""Small tables: a blog with a bridge and a recursive relation, and an organisation."""

import datetime as dt

from nestq.engine import Engine
from nestq.sources.catalog import Catalog, Options
from nestq.sources.loaders import ConfigSource, TableSource

T0 = dt.datetime(2024, 1, 1)
KEYS = {
    "users": {"primary": ["id"], "unique": ["email"]},
    "posts": {"primary": ["id"], "foreign": {"user_id": "users.id"}},
    "tags": {"primary": ["id"]},
    "comments": {"primary": ["id"], "foreign": {"user_id": "users.id", "post_id": "posts.id", "parent_id": "comments.id"}},
    "post_tags": {"primary": ["post_id", "tag_id"], "foreign": {"post_id": "posts.id", "tag_id": "tags.id"}},
}


def frames(spark):
    make = spark.createDataFrame
    return {
        "users": make([(1, "Ann", "ann@x", T0, None), (2, "Bob", "bob@x", T0, None), (3, "Cid", "cid@x", T0, None)], "id int not null, name string not null, email string not null, created_at timestamp_ntz, updated_at timestamp_ntz"),
        "posts": make([(1, "A", "x", 1, T0), (2, "B", None, 1, T0), (3, "C", "z", 2, T0)], "id int not null, title string not null, content string, user_id int not null, created_at timestamp_ntz"),
        "tags": make([(1, "red", T0), (2, "blue", T0)], "id int, name string, created_at timestamp_ntz"),
        "comments": make([(1, "c1", 1, 1, None, T0), (2, "c2", 2, 1, 1, T0), (3, "c3", 1, 1, 2, T0), (4, "c4", 3, 2, None, T0), (5, "self", 3, 2, 5, T0)], "id int, content string, user_id int, post_id int, parent_id int, created_at timestamp_ntz"),
        "post_tags": make([(1, 1, T0), (1, 2, T0), (2, 2, T0)], "post_id int, tag_id int, created_at timestamp_ntz"),
    }


def catalog(spark, config=None, **options):
    c = Catalog(Options(**options)).with_source(TableSource(spark, frames(spark), KEYS))
    if config:
        c.with_source(ConfigSource(config))
    return c.build()


def engine(spark, config=None, cache=False, **options):
    return Engine(spark, catalog(spark, config, **options), cache=cache)
