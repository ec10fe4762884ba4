import pytest

from tests import blog


def data(r):
    assert r["errors"] == [], r["errors"]
    return r["data"]


@pytest.fixture(scope="module")
def engine(spark):
    return blog.engine(spark)


def test_page(engine):
    r = data(engine.execute("{ users(sort: {name: DESC}, limit: 2) { total items { key: id name } pageInfo { hasNext hasPrev start end } } }"))
    assert r["users"]["items"] == [{"key": 3, "name": "Cid"}, {"key": 2, "name": "Bob"}] and r["users"]["total"] == 3
    assert r["users"]["pageInfo"] == {"hasNext": True, "hasPrev": False, "start": "eyJpZCI6M30=", "end": "eyJpZCI6Mn0="}


def test_cursors(engine):
    r = data(engine.execute('{ a: users(first: 2, after: "eyJpZCI6MX0=") { items { id } pageInfo { hasNext hasPrev } } b: users(last: 2) { items { id } pageInfo { hasNext hasPrev } } c: users(before: 3, limit: 5) { items { id } } }'))
    assert [x["id"] for x in r["a"]["items"]] == [2, 3] and r["a"]["pageInfo"] == {"hasNext": False, "hasPrev": True}
    assert [x["id"] for x in r["b"]["items"]] == [2, 3] and r["b"]["pageInfo"] == {"hasNext": False, "hasPrev": True}
    assert [x["id"] for x in r["c"]["items"]] == [1, 2]


def test_nested(engine):
    text = "{ userList(sort: {id: ASC}) { name posts(sort: {title: DESC}) { title tags { name } user { name } comments { id } } } }"
    r = data(engine.execute(text))["userList"]
    assert r[0]["posts"] == [
        {"title": "B", "tags": [{"name": "blue"}], "user": {"name": "Ann"}, "comments": [{"id": 4}, {"id": 5}]},
        {"title": "A", "tags": [{"name": "red"}, {"name": "blue"}], "user": {"name": "Ann"}, "comments": [{"id": 1}, {"id": 2}, {"id": 3}]},
    ]
    assert r[2]["posts"] == []


def test_recursion(engine):
    r = data(engine.execute("{ commentList { id parent { id } children { id } all: children(level: 0) { id } } }"))["commentList"]
    assert [(c["id"], c["parent"] and c["parent"]["id"], [x["id"] for x in c["children"]], [x["id"] for x in c["all"]]) for c in r] == [(1, None, [2], [2, 3]), (2, 1, [3], [3]), (3, 2, [], []), (4, None, [], []), (5, 5, [5], [])]


@pytest.mark.parametrize("where,ids", [("{posts: {title: {eq: \"C\"}}}", [2]), ("{not: {posts: {id: {gt: 0}}}}", [3]), ("{posts: {tags: {name: {eq: \"red\"}}}}", [1]), ("{updatedAt: {is: NULL}, name: {iRegex: \"^[ab]\"}}", [1, 2]), ("{id: {ni: [1]}}", [2, 3]), ("{id: {in: []}}", []), ("{createdAt: {ge: 1704067200}}", [1, 2, 3])])
def test_where(engine, where, ids):
    assert [x["id"] for x in data(engine.execute(f"{{ userList(where: {where}, sort: {{id: ASC}}) {{ id }} }}"))["userList"]] == ids


@pytest.mark.parametrize(
    "text",
    [
        "{ nope { items { id } } }", "{ users { items { nope } } }", "{ users(where: {and: []}) { items { id } } }", "{ users(where: {not: null}) { items { id } } }",
        "{ users(where: {id: {like: \"a\"}}) { items { id } } }", "{ users(where: {name: {eq: null}}) { items { id } } }", "{ users(limit: -1) { items { id } } }", "{ users(limit: 1.5) { items { id } } }",
        "{ users(offset: 2, after: 1) { items { id } } }", "{ users(sort: {posts: ASC}) { items { id } } }", "{ users(sort: {name: UP}) { items { id } } }", "{ users(orderBy: {name: ASC_NULLS_LAST}) { items { id } } }",
        "{ users(where: {id: {eq: \"x\"}}) { items { id } } }", "{ users(where: {createdAt: {eq: \"soon\"}}) { items { id } } }", "{ users(frist: 1) { items { id } } }", "{ users { items { posts } } }", "{ users { items { id { x } } } }",
        "{ userStats { name { sum } } }", "{ userStats(groupBy: {fields: []}) { groupBy { count } } }", "mutation { deleteUser }", "mutation { createUser(input: {name: \"x\"}) { id } }", "mutation { createUser(input: {id: 1, name: \"a\", email: \"b\"}) { id } }",
        "query ($x: Int!) { users(id: $x) { items { id } } }", "query A { users { total } } query B { users { total } }", "{ users(where: {createdAt: {is: MAYBE}}) { items { id } } }",
    ],
)
def test_errors(engine, text):
    r = engine.execute(text)
    assert r["data"] is None and r["errors"][0]["message"]


def test_operation_name_and_variables(engine):
    r = engine.execute("query A($n: [Int!] = [2]) { users(where: {id: {in: $n}}) { total } } query B { tags { total } }", {"n": [1, 2]}, "A")
    assert data(r) == {"A": {"users": {"total": 2}}}


def test_default_limit_and_distinct(spark):
    e = blog.engine(spark, default_limit=2)
    assert len(data(e.execute("{ commentList { id } }"))["commentList"]) == 2
    assert len(data(e.execute("{ commentList(limit: 0) { id } }"))["commentList"]) == 5
    r = data(e.execute('{ commentList(distinct: ["postId"], sort: [{postId: ASC}, {id: DESC}], limit: 0) { id postId } }'))["commentList"]
    assert r == [{"id": 3, "postId": 1}, {"id": 5, "postId": 2}]
    assert e.frame("{ commentList { id } }").count() == 5


def test_null_order(spark):
    e = blog.engine(spark)
    ids = lambda d: [x["id"] for x in data(e.execute(f"{{ commentList(sort: [{{parentId: {d}}}, {{id: ASC}}]) {{ id }} }}"))["commentList"]]
    assert ids("ASC") == ids("ASC_NULLS_LAST") == [2, 3, 5, 1, 4]
    assert ids("DESC") == ids("DESC_NULLS_FIRST") == [1, 4, 5, 3, 2]
    assert ids("ASC_NULLS_FIRST") == [1, 4, 2, 3, 5] and ids("DESC_NULLS_LAST") == [5, 3, 2, 1, 4]


def test_stats(engine):
    r = data(engine.execute('{ commentStats(groupBy: {fields: ["postId"], sort: {count: DESC}, having: {count: {gt: 1}}}) { count parentId { min max avg count countDistinct } content { min } createdAt { max } mine: count(where: {userId: {eq: 1}}) groupBy { key count id { sum } } } }'))["commentStats"]
    assert r["count"] == 5 and r["mine"] == 2 and r["parentId"] == {"min": 1.0, "max": 5.0, "avg": 8 / 3, "count": 3, "countDistinct": 3}
    assert r["groupBy"] == [{"key": {"postId": 1}, "count": 3, "id": {"sum": 6.0}}, {"key": {"postId": 2}, "count": 2, "id": {"sum": 9.0}}]


def test_mutations(spark):
    e = blog.engine(spark)
    r = data(e.execute('mutation { createUser(input: {name: "Dan", email: "d@x", posts: [{title: "New"}]}) { id name posts { title userId } } }'))
    assert r == {"createUser": {"id": 4, "name": "Dan", "posts": [{"title": "New", "userId": 4}]}}
    r = data(e.execute('mutation { updateUser(id: 4, input: {name: "Don"}) { name updatedAt } }'))["updateUser"]
    assert r["name"] == "Don" and r["updatedAt"]
    assert data(e.execute("mutation { deleteUser(where: {id: {ge: 3}}) }")) == {"deleteUser": 2}
    assert data(e.execute("{ users { total } }")) == {"users": {"total": 2}}
    r = data(e.execute('mutation { tagList(upsert: [{id: 1, name: "RED"}, {id: 9, name: "new"}]) { id name createdAt } }'))["tagList"]
    assert [(t["id"], t["name"]) for t in r] == [(1, "RED"), (9, "new")] and r[0]["createdAt"] == "2024-01-01T00:00:00"
    data(e.execute("mutation { updatePost(id: 3, input: {tags: {connect: [1, 9]}}) { id } }"))
    data(e.execute("mutation { updatePost(id: 1, input: {tags: {disconnect: [1]}}) { id } }"))
    assert {tuple(x)[:2] for x in e.image("PostTag").collect()} == {(1, 2), (2, 2), (3, 1), (3, 9)}
    before = e.image("Tag").count()
    assert e.execute('mutation { a: createTag(input: {id: 50, name: "x"}) { id } b: deleteNothing }')["data"] is None and e.image("Tag").count() == before


def test_soft_delete_and_commit(spark, tmp_path):
    e = blog.engine(spark, {"classes": {"User": {"deleted_at": "updated_at"}}})
    assert data(e.execute("mutation { deleteUser(id: 1) }")) == {"deleteUser": 1}
    assert data(e.execute("{ users { total } all: users(unscoped: true) { total } }")) == {"users": {"total": 2}, "all": {"total": 3}}
    assert data(e.execute("mutation { deleteUser(id: 1) }")) == {"deleteUser": 0}
    assert e.commit("User", str(tmp_path / "users")).count() == 3


def test_cache(spark):
    e = blog.engine(spark, cache=True)
    q = "{ users { total } }"
    assert data(e.execute(q)) == data(e.execute(q)) and e.hits == 1
    data(e.execute('mutation { createTag(input: {id: 5, name: "x"}) { id } }'))
    e.execute(q)
    assert e.hits == 2
    data(e.execute("mutation { deleteUser(id: 1) }"))
    assert data(e.execute(q))["users"]["total"] == 2 and e.hits == 2
    assert e.lineage("{ userList { id posts { tags { id } } } }") == {"users", "posts", "tags", "post_tags"}


def test_frame_plan(spark, data):
    from nestq.sources.star import star_engine

    df = star_engine(spark, data).frame("{ orders(where: {totalprice: {gt: 1000}}) { items { orderkey } } }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan and "Python" not in plan


def test_failures_are_errors_and_undone(spark):
    """Whatever fails on the cluster is an error of the operation, and leaves nothing behind."""
    e = blog.engine(spark)
    r = e.execute('{ users(where: {name: {regex: "("}}) { items { id } } }')
    assert r["data"] is None and len(r["errors"]) == 1 and "\n" not in r["errors"][0]["message"]
    r = e.execute('mutation { createTag(input: {name: "green"}) { id } deleteTag(where: {name: {regex: "("}}) }')
    assert r["data"] is None and r["errors"]
    assert [t["name"] for t in data(e.execute("{ tagList(sort: {id: ASC}) { name } }"))["tagList"]] == ["red", "blue"]
    r = e.execute('mutation { updateUser(where: {name: {regex: "["}}, input: {name: "x"}) { id } }')
    assert r["errors"] and data(e.execute("{ users { total } }"))["users"]["total"] == 3


def test_stamps_are_frozen(spark):
    e = blog.engine(spark, {"classes": {"User": {"deleted_at": "updated_at"}}})
    assert data(e.execute("mutation { deleteUser(id: 1) }"))["deleteUser"] == 1
    read = lambda: e.image("User").where("id = 1").first()["updated_at"]
    first = read()
    assert first is not None and read() == first
    e = blog.engine(spark)
    told = data(e.execute('mutation { updateUser(id: 1, input: {name: "Al"}) { updatedAt } }'))["updateUser"]["updatedAt"]
    assert e.image("User").where("id = 1").first()["updated_at"].isoformat() == told
    assert e.execute('mutation { updateUser(id: 1, input: {createdAt: "2020-01-01"}) { id } }')["errors"]
    assert e.execute('mutation { updateUser(id: 1, input: {id: 9}) { id } }')["errors"]


def test_users_are_stamped(spark):
    from nestq.engine import Engine
    from nestq.sources.catalog import Catalog, Options
    from nestq.sources.loaders import TableSource

    notes = spark.createDataFrame([(1, "a", None, None, None, None)], "id int not null, text string, created_by int, updated_by int, deleted_at timestamp_ntz, deleted_by int")
    e = Engine(spark, Catalog(Options()).with_source(TableSource(spark, {"notes": notes}, {"notes": {"primary": ["id"]}})).build())
    data(e.execute('mutation { createNote(input: {id: 2, text: "b"}) { id } updateNote(id: 1, input: {text: "c"}) { id } }', user=7))
    assert [(r["created_by"], r["updated_by"]) for r in e.image("Note").orderBy("id").collect()] == [(None, 7), (7, 7)]
    data(e.execute("mutation { deleteNote(id: 2) }", user=8))
    assert [r["deleted_by"] for r in e.image("Note").orderBy("id").collect()] in ([None, 8], [None])


def test_images_are_written_out_now_and_then(spark):
    e = blog.engine(spark)
    for k in range(9):
        data(e.execute(f'mutation {{ updateTag(id: 1, input: {{name: "n{k}"}}) {{ id }} upsertTag(input: {{id: {100 + k}, name: "t"}}) {{ id }} }}'))
    assert data(e.execute("{ tags { total } }"))["tags"]["total"] == 11
    assert "nestq-image" in e.image("Tag")._jdf.queryExecution().toString() and e.image("Tag").where("id = 1").first()["name"] == "n8"
