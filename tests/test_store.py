"""Writes, schema changes, the change stream and readers, on folders of their own."""

import json
from dataclasses import replace
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from brindle.engine import Engine
from brindle.operators import stats
from brindle.operators.validate import BodyError, split_valid
from brindle.operators.writes import ConstraintError, Writer
from brindle.plans import ir
from brindle.plans.ir import Conflict
from brindle.schema.diff import DATA, DESTRUCTIVE, FORBIDDEN, SAFE, diff
from brindle.schema.migrate import Refused, migrate
from brindle.sources import readers
from brindle.sources.catalog import Catalog, Field, Module, Relation
from brindle.sources.store import Store
from brindle.streaming.changes import follow

NOW = datetime(2026, 1, 1, 12, 0, 0, 123456, tzinfo=UTC)
SEO = Module("seo", (Field("title", nullable=False), Field("image", "media")), (Relation("pick", "author"),), bare=True)
AUTHOR = Module("author", (Field("name", unique=True, length=20),))
ARTICLE = Module(
    "article",
    (Field("title", nullable=False), Field("slug", "uid", unique=True), Field("views", "integer", min=0, default=0), Field("price", "decimal", precision=8, scale=2), Field("kind", "enumeration", values=("a", "b")), Field("seo", "component", components=("seo",)), Field("cover", "media", allowed_types=("images",)), Field("shared", localized=False)),
    (Relation("author", "author", "manyToOne", inverse="articles"), Relation("twin", "article", "oneToOne"), Relation("tags", "author", "manyToMany")),
    draft_and_publish=True,
    i18n=True,
)


@pytest.fixture()
def writer(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    engine = Engine(store.load(), "k")
    migrate(store, engine.catalog, [AUTHOR, ARTICLE])
    engine.catalog.files = spark.createDataFrame([(1, "a.png", "image/png"), (2, "b.mp4", "video/mp4")], "id int, name string, mime string")
    engine.components["seo"] = SEO
    return Writer(store, engine, lambda: NOW)


def data(text):
    return json.loads(text)["data"]


def test_life_of_a_row(writer):
    ann, bob = (data(writer.create("author", {"name": n}))["id"] for n in ("Ann", "Bob"))
    made = data(writer.create("article", {"title": "One", "price": "1.5", "author": ann, "tags": [bob, ann], "seo": {"title": "s", "image": 1, "pick": bob}}))
    assert (made["id"], made["document_id"], made["locale"], made["published_at"], made["views"], made["price"]) == (1, 1, "en", None, 0, "1.50")
    assert made["created_at"] == made["updated_at"] == "2026-01-01T12:00:00.123Z"
    e = writer.engine
    assert e.find_one_or_none("article", 1) is None and data(e.find_one("article", 1, "status=draft"))["title"] == "One"
    writer.publish("article", 1)
    shown = data(e.find_one("article", 1, "populate[author]=true&populate[tags]=true&populate[seo]=true"))
    assert shown["author"]["name"] == "Ann" and [t["name"] for t in shown["tags"]] == ["Bob", "Ann"]
    assert shown["seo"]["image"]["name"] == "a.png" and shown["seo"]["pick"]["name"] == "Bob"
    writer.update("article", 1, {"views": 5, "tags": {"disconnect": [bob]}, "author": {"connect": [bob]}})
    shown = data(e.find_one("article", 1, "populate=author,tags"))
    assert (shown["views"], shown["author"]["name"], [t["name"] for t in shown["tags"]]) == (5, "Bob", ["Ann"])
    again = Engine(Store(writer.store.spark, writer.store.files.root).load(), "k")  # another process reads the same
    assert data(again.find_one("article", 1))["views"] == 5
    writer.unpublish("article", 1)
    assert e.count("article") == 0
    writer.delete("author", bob)
    assert data(e.find_one("article", 1, "status=draft&populate=author"))["author"] is None
    assert data(writer.create("author", {"name": "Cy"}))["id"] == 3  # numbers aren't given twice
    assert writer.store.vacuum() and data(e.find_one("article", 1, "status=draft"))["views"] == 5


def test_relations_keep_their_kind(writer):
    for n in ("A", "B"):
        writer.create("author", {"name": n})
    for n in range(3):
        writer.create("article", {"title": f"{n}", "author": 1})
    writer.update("article", 1, {"twin": 2})
    writer.update("article", 3, {"twin": 2})  # one to one: the other end moves too
    twins = lambda: {(r["owner_id"], r["related_id"]) for r in writer.catalog.links["article.twin"].collect()}
    assert twins() == {(3, 2)}
    writer.update("author", 2, {"articles": {"connect": [1, 2]}})  # from the other side
    assert {(r["owner_id"], r["related_id"]) for r in writer.catalog.links["article.author"].collect()} == {(1, 2), (2, 2), (3, 1)}
    writer.update("author", 2, {"articles": [3]})
    assert {(r["owner_id"], r["related_id"]) for r in writer.catalog.links["article.author"].collect()} == {(3, 2)}
    writer.delete("article", 3)
    assert twins() == set()


def test_locales(writer):
    writer.create("article", {"title": "Home", "shared": "x"})
    variant = data(writer.create_variant("article", 1, "fr", {"title": "Accueil", "shared": "ignored"}))
    assert (variant["document_id"], variant["locale"], variant["shared"]) == (1, "fr", "x")
    writer.update("article", 1, {"shared": "y", "title": "House"})
    seen = {r["locale"]: r for r in json.loads(writer.engine.list("article", "locale=*&status=draft"))["data"]}
    assert {k: (v["title"], v["shared"]) for k, v in seen.items()} == {"en": ("House", "y"), "fr": ("Accueil", "y")}
    with pytest.raises(ir.Conflict):
        writer.create_variant("article", 1, "fr", {"title": "x"})


@pytest.mark.parametrize(
    "body",
    [{}, [], {"nope": 1, "title": "x"}, {"id": 1, "title": "x"}, {"title": None}, {"title": "x", "views": 1.5}, {"title": "x", "views": -1}, {"title": "x", "views": True}, {"title": "x", "price": "1.555"}, {"title": "x", "kind": "c"}, {"title": "x", "seo": {}}, {"title": "x", "seo": {"title": "t", "no": 1}}, {"title": "x", "author": [1, 2]}, {"title": "x", "author": {"set": 1, "connect": 2}}, {"title": "x", "cover": "a"}],
)
def test_bodies_that_are_refused(writer, body):
    with pytest.raises(BodyError):
        writer.create("article", body)
    assert writer.catalog.rows["article"].isEmpty() and not writer.store.files.exists("lock")


def test_constraints_and_hooks(writer):
    writer.create("author", {"name": "Ann"})
    for bad in ({"title": "x", "author": 9}, {"title": "x", "cover": 9}, {"title": "x", "cover": 2}):
        with pytest.raises(ConstraintError):
            writer.create("article", bad)
    with pytest.raises(ConstraintError):
        writer.create("author", {"name": "Ann"})
    with pytest.raises(BodyError):
        writer.update("author", 1, {})
    with pytest.raises(ir.NotFound):
        writer.update("author", 9, {"name": "x"})
    seen = []
    writer.hooks[("author", "before create")] = lambda d: {**d, "name": d["name"].title()}
    writer.hooks[("author", "after create")] = lambda d: seen.append(d) or 1 / 0
    assert data(writer.create("author", {"name": "bob"}))["name"] == "Bob" and len(seen) == 1
    writer.hooks[("author", "before delete")] = lambda d: (_ for _ in ()).throw(PermissionError())
    with pytest.raises(PermissionError):
        writer.delete("author", 1)
    writer.store.files.create("lock")
    with pytest.raises(ir.Conflict):
        writer.update("author", 1, {"name": "x"})
    writer.store.files.delete("lock")


def test_diff():
    old = Module("m", (Field("a", id="1"), Field("b", "integer", id="2"), Field("c", "text", id="3")), (Relation("r", "m"),), id="m1")
    new = Module("n", (Field("b", "string", id="1"), Field("a", "biginteger", nullable=False, id="2"), Field("d", "json", id="3"), Field("e", id="5")), (Relation("r", "m", "manyToMany"),), single=True, i18n=True, id="m1")
    found = {(c.kind, c.name): c.risk for c in diff([old], [new])}
    assert found == {("renameType", None): SAFE, ("renameField", "b"): SAFE, ("renameField", "a"): SAFE, ("renameField", "d"): SAFE, ("retypeField", "a"): SAFE, ("retypeField", "d"): FORBIDDEN, ("setFieldNullable", "a"): DATA, ("addField", "e"): SAFE, ("dropRelation", "r"): DESTRUCTIVE, ("addRelation", "r"): SAFE, ("setTypeOption", "i18n"): FORBIDDEN, ("setTypeOption", "single"): SAFE}
    assert diff([old], [old]) == [] and {c.kind for c in diff([old], [])} == {"dropType"}


def test_migrations(writer):
    store, catalog = writer.store, writer.catalog
    for n in range(3):
        writer.create("article", {"title": f"{n}", "price": "1.25", "slug": f"s{n}" * 5})
    old_version = catalog.versions["article"]
    f = {x.name: x for x in ARTICLE.fields}
    from dataclasses import replace as r

    swapped = r(ARTICLE, fields=(r(f["slug"], id="title", name="slug", unique=False, type="string"), r(f["title"], id="slug", name="title", nullable=True), r(f["views"], type="biginteger"), f["kind"], f["price"], f["seo"], f["cover"], f["shared"], Field("more", "integer", default=7, nullable=False)))
    swapped = r(swapped, fields=(r(swapped.fields[0], nullable=False), r(swapped.fields[1], type="uid", unique=True), *swapped.fields[2:]))
    assert {c.kind for c in migrate(store, catalog, [AUTHOR, swapped])} == {"renameField", "retypeField", "reorderFields", "addField"}
    row = catalog.rows["article"].orderBy("id").first().asDict()
    assert row["slug"] == "0" and row["title"] == "s0" * 5 and row["more"] == 7 and list(row)[-1] == "more"
    assert catalog.versions["article"] == old_version + 1 and migrate(store, catalog, [AUTHOR, swapped]) == []
    short = r(swapped, fields=tuple(r(x, length=4) if x.name == "title" else x for x in swapped.fields))
    with pytest.raises(Refused, match="3 rows"):
        migrate(store, catalog, [AUTHOR, short])
    coarse = r(swapped, fields=tuple(r(x, scale=1) if x.name == "price" else x for x in swapped.fields))
    with pytest.raises(Refused):
        migrate(store, catalog, [AUTHOR, coarse])
    fewer = r(swapped, fields=swapped.fields[:-1])
    with pytest.raises(Refused):
        migrate(store, catalog, [AUTHOR, fewer])
    with pytest.raises(Refused):
        migrate(store, catalog, [AUTHOR, fewer], True, expected_version=0)
    migrate(store, catalog, [r(AUTHOR, name="person", id="author"), r(fewer, relations=tuple(r(x, target="person" if x.target == "author" else x.target) for x in fewer.relations))], True)
    loaded = Store(store.spark, store.files.root).load()
    assert set(loaded.modules) == {"person", "article"} and "more" not in loaded.rows["article"].columns and loaded.rows["article"].count() == 3
    assert loaded.sides("person")["articles"].target == "article"
    assert stats.too_long(loaded.rows["article"], "title", 4).first()["n"] == 3


def test_change_stream(writer, spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "id int, created_at timestamp_ntz, updated_at timestamp_ntz, name string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    t = lambda n: datetime(2024, 1, n)
    put([(1, t(1), t(1), "a"), (2, t(1), t(1), "b"), (1, t(1), t(2), "a2"), (3, t(1), t(1), "x" * 30)])
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    run = lambda: follow(stream(), writer.store, writer.engine, "author", str(tmp_path / "cp"), rejected=str(tmp_path / "bad")).awaitTermination()
    run()
    put([(2, t(1), t(3), "b2"), (4, t(1), t(3), "d")])
    run()
    assert {r["id"]: r["name"] for r in writer.catalog.rows["author"].collect()} == {1: "a2", 2: "b2", 4: "d"}
    assert [r["errors"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [["name: too long"]]


def test_readers(spark, tmp_path):
    for name, content in (("a.png", b"x"), ("b.png", b"x"), ("c.TXT", b"yy"), ("d", b"z")):
        (tmp_path / name).write_bytes(content)
    files = readers.assets(spark, str(tmp_path)).collect()
    assert sorted((f["name"], f["ext"], f["mime"], f["size"]) for f in files) == [("a.png", ".png", "image/png", 1), ("c.TXT", ".txt", "text/plain", 2), ("d", "", "application/octet-stream", 1)]
    a, b = (readers.generated(spark, 500).repartition(n).orderBy("id").collect() for n in (1, 5))
    assert a == b and 20 < sum(r["views"] is None for r in a) < 80
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00.123456", 5.0)], "id int, at string, price double")
    module = Module("m", (Field("at", "datetime"), Field("price", "decimal", precision=5, scale=1)), bare=True)
    assert tuple(readers.coerced(rows, module).first()) == (1, datetime(2024, 1, 1, 0, 0, 0, 123000), Decimal("5.0"))
    ends = spark.createDataFrame([(1,), (2,)], "id int")
    good, bad = readers.links(spark.createDataFrame([(1, 1, 2), (2, 1, 9)], "id long, owner_id long, related_id long"), ends, "id", ends, "id")
    assert [r["id"] for r in good.collect()] == [1] and [r["id"] for r in bad.collect()] == [2]
    valid, wrong = split_valid(spark.createDataFrame([("a", 1.0), (None, -1.0)], "s string, x double"), Module("v", (Field("s", nullable=False), Field("x", "float", min=0)), bare=True))
    assert valid.count() == 1 and wrong.first()["errors"] == ["s: null", "x: out of bounds"]


def test_inspection(spark):
    catalog = Catalog()
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, s string")
    module = catalog.register(Module("m", (Field("s"),), bare=True), rows)
    found = {r["column"]: r for r in stats.inspect(rows, module).collect()}
    assert (found["s"]["nulls"], found["s"]["distinct"], found["id"]["greatest"]) == (1, 1, "3")
    assert [r["id"] for r in stats.window(rows, module, 1, 1).collect()] == [2]
    assert {r["module"]: r["rows"] for r in stats.counts(catalog).collect()} == {"m": 3}


def another(writer):
    store = Store(writer.store.spark, writer.store.files.root)
    return Writer(store, Engine(store.load(), "k"), lambda: NOW)


def test_two_writers_lose_no_rows(writer):
    second, third = another(writer), another(writer)
    assert data(writer.create("author", {"name": "one"}))["id"] == 1
    assert data(second.create("author", {"name": "two"}))["id"] == 2
    assert data(third.create("author", {"name": "three"}))["id"] == 3
    second.update("author", 3, {"name": "drei"})
    assert sorted((r["id"], r["name"]) for r in another(writer).catalog.rows["author"].collect()) == [(1, "one"), (2, "two"), (3, "drei")]
    with pytest.raises(ConstraintError):
        writer.create("author", {"name": "drei"})  # another's row counts


def test_a_changed_definition_stops_a_writer_that_has_not_seen_it(writer):
    second = another(writer)
    migrate(writer.store, writer.catalog, [replace(AUTHOR, fields=(*AUTHOR.fields, Field("age", "integer"))), ARTICLE])
    with pytest.raises(Conflict):
        second.create("author", {"name": "x"})
    assert data(second.create("author", {"name": "x", "age": 3}))["age"] == 3  # it has seen it now


def test_answers_follow_a_migration(writer):
    writer.create("author", {"name": "one"})
    before = json.loads(writer.engine.list("author"))["data"]
    migrate(writer.store, writer.catalog, [replace(AUTHOR, fields=(*AUTHOR.fields, Field("age", "integer", default=4))), ARTICLE])
    after = json.loads(writer.engine.list("author"))["data"]
    assert "age" not in before[0] and after[0]["age"] == 4


def test_locks_end(writer):
    assert writer.store.files.create("lock", "dead")
    with pytest.raises(Conflict):
        writer.create("author", {"name": "one"})
    writer.store.lease = -1
    assert data(writer.create("author", {"name": "one"}))["id"] == 1 and not writer.store.files.exists("lock")
    version = writer.store.manifest["version"]
    with pytest.raises(Conflict), writer.store.writing(writer.catalog) as draft:
        draft["ids"]["author"] = 99
        writer.store.files.delete("lock")
        writer.store.files.create("lock", "another")
    assert writer.store.current()["version"] == version and writer.store.files.read("lock") == "another"
    writer.store.files.delete("lock")
    with writer.store.writing(writer.catalog):
        pass
    assert writer.store.current()["version"] == version  # nothing changed, nothing written
