import json

import pytest

from nestq.errors import QueryError
from nestq.plans.introspect import schema
from nestq.plans.sdl import render
from nestq.sources.catalog import Catalog, Options, relation_kind, scalar_of
from nestq.sources.loaders import ConfigSource, JdbcSource, SnapshotSource, save_snapshot
from nestq.sources.naming import class_name, field_name, plural, singular
from tests import blog


@pytest.mark.parametrize("one,many", [("user", "users"), ("category", "categories"), ("box", "boxes"), ("child", "children"), ("class", "classes"), ("children", "children"), ("day", "days")])
def test_plurals(one, many):
    assert plural(one) == many
    if many != "children":  # is its own singular
        assert singular(many) == one


def test_names():
    assert class_name("sys_user_logs", ["sys_"]) == "UserLog"
    assert field_name("user_id") == "userId" and field_name("ID") == "id" and field_name("o_custkey", ["o_"]) == "custkey"


def test_types():
    for db, scalar in {"varchar(20)": "String", "bigint": "Int", "tinyint(1)": "Boolean", "numeric(10,2)": "Float", "uuid": "ID", "jsonb": "Json", "timestamptz": "DateTime", "nope": "String"}.items():
        assert scalar_of(db) == scalar
    assert relation_kind("many_to_many") == relation_kind("ManyToMany") == "ManyToMany" and relation_kind("?") == "ManyToOne"


def test_relations(spark):
    c = blog.catalog(spark)
    fields = {e.name: sorted(f.name for f in e.relations) for e in c.entities.values()}
    assert fields == {"Comment": ["children", "parent", "post", "user"], "Post": ["comments", "postTags", "tags", "user"], "PostTag": ["post", "tag"], "Tag": ["postTags", "posts"], "User": ["comments", "posts"]}
    assert c.entity("PostTag").is_through and c.entity("post_tags") is c.entity("PostTag")
    hidden = blog.catalog(spark, show_through=False)
    assert "postTags" not in hidden.entity("Post").fields and "type PostTag " not in render(hidden)


def test_config_views(spark):
    config = {"classes": {"PublicUser": {"table": "users", "exclude_fields": ["email", "created_at"]}, "AdminUser": {"table": "posts", "override": True, "fields": {"role": {"virtual": True}}}, "Statistics": {"resolver": "s", "fields": {"total": {"type": "int"}}}, "MiniUser": {"table": "users", "include_fields": ["id", "name"]}}}
    c = blog.catalog(spark, config)
    assert sorted(f.name for f in c.entity("PublicUser").columns) == ["id", "name", "updatedAt"]
    assert sorted(c.entity("MiniUser").fields) == ["id", "name"]
    assert c.entity("posts").name == "AdminUser" and "Post" not in c.entities and c.entity("AdminUser").fields["role"].virtual
    assert c.entity("Statistics").virtual and "email" in c.entity("User").fields


def test_exclusion_and_sources(spark):
    c = blog.catalog(spark, exclude_tables=["tags"], exclude_fields=["created_at"])
    assert "Tag" not in c.entities and "createdAt" not in c.entity("User").fields
    with pytest.raises(QueryError):
        c.entity("Tag")
    seen = []
    c = Catalog().with_source(ConfigSource({"classes": {"A": {"fields": {}}}})).with_hook(lambda c: seen.append(sorted(c.entities))).without_source("nothing")
    c.build()
    assert seen == [["A"]]


def test_snapshot(spark, tmp_path):
    c = blog.catalog(spark)
    path = str(tmp_path / "catalog.json")
    save_snapshot(c, path, "7")
    again = Catalog().with_source(SnapshotSource(path)).build()
    assert again.version == "7" and again.entities == c.entities
    assert json.loads((tmp_path / "catalog.json").read_text())["version"] == "7"
    assert not SnapshotSource(str(tmp_path / "none")).supported()


def test_jdbc_catalog(spark):
    """The database answers through a reader; no server is needed."""

    def reader(query):
        if "information_schema.columns" in query:
            return spark.createDataFrame([("users", "id", "integer", "NO", 1), ("users", "name", "text", "YES", 2), ("posts", "id", "integer", "NO", 1), ("posts", "user_id", "integer", "YES", 2)], "table_name string, column_name string, data_type string, is_nullable string, ordinal_position int")
        if "constraint_type" in query:
            return spark.createDataFrame([("users", "id", "PRIMARY KEY", "p", 1), ("posts", "id", "PRIMARY KEY", "q", 1)], "table_name string, column_name string, constraint_type string, constraint_name string, ordinal_position int")
        if "referential" in query or "referenced" in query:
            return spark.createDataFrame([("posts", "user_id", "users", "id")], "table_name string, column_name string, other string, other_column string")
        return spark.createDataFrame([(1, "Ann")], "id int, name string")

    for url in ("postgres://h/db", "mysql://h/db"):
        c = Catalog().with_source(JdbcSource(spark, url, reader=reader)).build()
        assert c.entity("User").fields["posts"].list and c.entity("Post").fields["user"].relation.target == "User"
        assert c.frame(spark, c.entity("User")).count() == 1
    with pytest.raises(QueryError):
        JdbcSource(spark, "oracle://h")


def test_sdl(spark):
    text = render(blog.catalog(spark))
    for part in (
        "enum SortDirection {\n  ASC\n  DESC\n  ASC_NULLS_FIRST",
        "type PageInfo {\n  hasNext: Boolean!\n  hasPrev: Boolean!\n  start: Cursor\n  end: Cursor\n}",
        "  parent: Comment\n  parentId: Int\n",
        "  children: [Comment]!",
        "  user: User!",
        "type UserResult {\n  items: [User!]!\n  total: Int!\n  pageInfo: PageInfo!\n}",
        "input IDWhereInput {",
        "  and: [UserWhereInput!]\n  or: [UserWhereInput!]\n  not: UserWhereInput",
        "  userStats(where: UserWhereInput, groupBy: GroupBy): UserStats!",
        "  createUser(input: UserCreateInput!): User!",
        "  deleteUser(id: ID, where: UserWhereInput): Int!",
        "input RelationInput {\n  id: ID!\n  connect: [ID!]\n  disconnect: [ID!]\n}",
    ):
        assert part in text.replace("  # related Comment objects\n", "").replace("  # related Comment object\n", "").replace("  # related User object\n", ""), part
    update = text.split("input UserUpdateInput {")[1].split("}")[0]
    assert "id" not in update.split() and "createdAt" not in update and "name: String\n" in update
    where = text.split("input UserWhereInput {")[1].split("}")[0]
    assert "posts" not in where
    number = text.split("input IntWhereInput {")[1].split("}")[0]
    assert all(f"  {op}: " in number for op in ("is", "eq", "in", "gt", "ge", "lt", "le", "ne")) and "hasKey" not in number


def test_introspection(spark):
    e = blog.engine(spark)
    whole = schema(e.catalog)
    assert {"Query", "Mutation", "User", "UserResult", "ID"} <= {t["name"] for t in whole["types"]}
    r = e.execute('{ __type(name: "User") { kind name fields { name type { kind name ofType { name } } } } }')
    fields = {f["name"]: f["type"] for f in r["data"]["__type"]["fields"]}
    assert fields["id"] == {"kind": "NON_NULL", "name": None, "ofType": {"name": "ID"}} and fields["posts"]["kind"] == "NON_NULL"
    r = e.execute("query($name: String) { __type { name } }", {"name": "Post"})
    assert r["data"]["__type"] == {"name": "Post"}
    r = e.execute("{ __schema { queryType { name } directives { name args { name } } } }")
    assert r["data"]["__schema"]["queryType"] == {"name": "Query"} and [d["name"] for d in r["data"]["__schema"]["directives"]] == ["include", "skip"]
    assert e.execute('{ __type(name: "Nope") { name } }')["data"]["__type"] is None
    assert e.execute("{ __typename }")["data"] == {"__typename": "Query"}


def test_default_options():
    o = Options()
    assert (o.schema, o.default_limit, o.use_camel, o.use_singular, o.show_through) == ("public", 10, True, True, True)
