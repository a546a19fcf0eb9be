"""Parsing, coercion, rendering, cursors: no Spark job runs here."""

from datetime import UTC, datetime
from decimal import Decimal

import pytest
from brindle.functions import values as V
from brindle.plans import ir
from brindle.plans.build import f, from_list_state, query
from brindle.plans.cursor import CursorCodec
from brindle.plans.parse import Parser, canonical, key_path, tree_of
from brindle.sources.catalog import Catalog, Field, Module, Relation, SchemaError


@pytest.fixture(scope="module")
def catalog():
    c = Catalog()
    fields = (Field("title"), Field("body", "text"), Field("views", "integer"), Field("rating", "float"), Field("active", "boolean"), Field("price", "decimal", precision=10, scale=2), Field("big", "biginteger"), Field("at", "datetime"), Field("meta", "json"), Field("secret", private=True))
    c.register(Module("article", fields, (Relation("author", "author", inverse="articles"),)), None)
    c.register(Module("author", (Field("name"),), (Relation("friend", "author"),)), None)
    return c


@pytest.fixture(scope="module")
def parse(catalog):
    return lambda q, m="article": Parser(catalog, m).parse(q)


def test_keys():
    assert key_path("filters[$and][0][a][$eq]") == ["filters", "$and", "0", "a", "$eq"]
    assert tree_of("?a[b]=1&a[c]=%C3%A9+x&d&a[b]=2") == {"a": {"b": "2", "c": "é x"}, "d": ""}
    for bad in ("[a]=1", "a]=1", "a[b=1", "a[]=1", "a[b]c=1", "a[[b]]=1", "a=1&a[b]=2", "a[b]=1&a=2", "a=%FF"):
        with pytest.raises(ir.QueryError):
            tree_of(bad)


def test_every_operator(parse):
    values = {"$between": "1,2", "$in": "1,2", "$notIn": "", "$null": "true", "$notNull": "true"}
    for token, op in ir.OPERATORS.items():
        name = "title" if op in ir.TEXT_ONLY else "views"
        leaf = parse({"filters": {name: {token: values.get(token, "5")}}}).where
        assert leaf.op == op and leaf.field == name
    assert parse("filters[views][$in]=1,2").where.value == (1, 2)
    assert parse("filters[views][$in][0]=1&filters[views][$in][1]=2").where == parse({"filters": {"views": {"$in": [1, 2]}}}).where
    assert parse("filters[views]=5").where == ir.Leaf("views", "eq", 5)
    assert parse("filters[title][$in]=").where.value == ()


def test_trees(parse):
    where = parse("filters[$or][0][views][$gt]=1&filters[$or][1][$not][title]=x&filters[active]=true").where
    assert where == ir.And((ir.Or((ir.Leaf("views", "gt", 1), ir.Not(ir.Leaf("title", "eq", "x")))), ir.Leaf("active", "eq", True)))
    assert parse("filters[author][friend][name]=x").where == ir.Has("author", ir.Has("friend", ir.Leaf("name", "eq", "x")))
    assert parse("filters[articles][views]=1", "author").where.relation == "articles"
    built = query(f("views").gt(1).and_(f("title").eqi("a")).and_(f("author", "name").eq("Ann")))
    assert len(parse(built).where.parts) == 3


@pytest.mark.parametrize(
    "bad",
    [
        "nonsense=1", "filters=1", "filters[nope]=1", "filters[views][$nope]=1", "filters[views]=x", "filters[views]=1.5", "filters[views]=", "filters[active]=1",
        "filters[at]=yesterday", "filters[big]=1.0", "filters[big]=9223372036854775808", "filters[price]=1.234", "filters[price]=123456789.00", "filters[meta][$eq]=1", "filters[meta][$null]=true",
        "filters[views][$contains]=1", "filters[views][$null]=false", "filters[views][$between]=1", "filters[views][$between]=1,2,3", "filters[secret]=x", "filters[$and]=", "filters[$xor][0][views]=1",
        "filters[author]=1", "filters[author][$eq]=1", "filters[author][$null]=true", "filters[author][friend][friend][friend][name]=x", "filters[author][nope]=1",
        "sort=nope", "sort=views:up", "sort=secret", "fields=nope", "fields=secret", "pagination=1", "pagination[page]=0", "pagination[page]=x", "pagination[size]=1", "pagination[page]=1&pagination[start]=1",
        "pagination[cursor]=&pagination[before]=x", "pagination[before]=", "pagination[withCount]=true", "pagination[cursor]=&pagination[pageSize]=0", "pagination[cursor]=&pagination[withCount]=1", "pagination[page]=1&pagination[cursor]=", "pagination[start]=-1",
        "status=live", "locale=", "locale=a b", "populate" + "".join("[a][populate]" for _ in range(10)) + "=x",
    ],
)
def test_what_is_rejected(parse, bad):
    with pytest.raises(ir.QueryError) as e:
        parse(bad)
    assert e.value.status == 400


def test_pages_and_the_rest(parse):
    assert parse("pagination[page]=3&pagination[pageSize]=10").page == ir.Page(20, 10)
    assert parse("pagination[pageSize]=7").page == ir.Page(0, 7) and parse("pagination[page]=2").page == ir.Page(25, 25)
    assert parse("pagination[start]=5").page == ir.Page(5, None) and parse("").page == ir.Page()
    assert parse("pagination[cursor]=&pagination[withCount]=true").page == ir.Keyset(25, "", None, True)
    assert parse("sort=views:desc,title").sort == (ir.SortKey("views", True), ir.SortKey("title"))
    assert parse("sort[0]=views:desc&sort[1]=title").sort == parse("sort=views:desc,title").sort
    assert parse("fields[0]=title&fields[1]=views").fields == ("title", "views")
    assert parse("populate[author][populate]=friend").populate == (ir.Populate("author", (ir.Populate("friend"),)),)
    assert parse("populate=author,x").populate == parse("populate[0]=author&populate[1]=x").populate
    assert parse(from_list_state(" a ", "title", [{"field": "views", "op": "$gt", "value": 3}], [("views", True)], 2, 10)).page == ir.Page(10, 10)


def test_coercion():
    assert [V.number(x) for x in ("0x10", "1e3", " 5 ", "-Infinity", ".5", "5.")] == [16, 1000, 5, float("-inf"), 0.5, 5]
    assert V.epoch_ms("1969-12-31T23:59:59.999Z") == -1 and V.epoch_ms("2021-01-01T01:00+01:00") == V.epoch_ms("2021-01-01") == V.epoch_ms(str(1609459200000))
    assert V.decimal("1.5", 2, 5) == Decimal("1.50") and V.int64(str(2**63 - 1)) == 2**63 - 1
    for call in (lambda: V.decimal("1.555", 2, 9), lambda: V.decimal("1e2", 2, 9), lambda: V.int64("1e3"), lambda: V.epoch_ms("2021-02-30"), lambda: V.number("--1"), lambda: V.number("1_000"), lambda: V.locale_slug("x" * 36)):
        with pytest.raises(V.BadValue):
            call()
    assert V.now_shifted("$now(+1 month)", datetime(2024, 1, 31, tzinfo=UTC)) == datetime(2024, 3, 2, tzinfo=UTC)
    assert V.fold("ﬁＡß") == "fiaß"


def test_rendering():
    doubles = {1.0: "1", -0.0: "0", 1e21: "1e+21", 1e20: "100000000000000000000", 1.5e-7: "1.5e-7", 0.000001: "0.000001", 123.456: "123.456", -2.5e300: "-2.5e+300"}
    assert [V.render_double(x) for x in doubles] == list(doubles.values())
    assert V.render_instant(-1) == "1969-12-31T23:59:59.999Z" and V.render_instant(datetime(2024, 1, 2, 3, 4, 5, 678900)) == "2024-01-02T03:04:05.678Z"
    assert V.render_decimal(Decimal("-0.001"), 2) == "0.00" and V.render_decimal(Decimal("1.5"), 2) == "1.50"


def test_equal_queries_have_one_canonical_form(parse):
    a, b = parse("filters[views][$in]=1,2&filters[title]=x"), parse("filters[title]=x&filters[views][$in]=2,1")
    assert canonical(a) == canonical(b) != canonical(parse("filters[title]=x&filters[views][$notIn]=2,1"))
    assert canonical(parse("filters[views][$between]=1,2")) != canonical(parse("filters[views][$between]=2,1"))


def test_cursors_are_bound_to_their_query():
    codec, sort, where = CursorCodec("k"), (ir.SortKey("a", True), ir.SortKey("id")), ir.Leaf("a", "gt", 1)
    token = codec.encode([Decimal("1.50"), None, datetime(2024, 1, 1)], 7, "article", 1, sort, where)
    assert codec.decode(token, "article", 1, sort, where) == (["1.50", None, 1704067200000], 7)
    flipped = token[:50] + ("A" if token[50] != "A" else "B") + token[51:]
    for bad, context in ((flipped, ("article", 1, sort, where)), (token, ("other", 1, sort, where)), (token, ("article", 2, sort, where)), (token, ("article", 1, sort[::-1], where)), (token, ("article", 1, sort, None)), ("", ("article", 1, sort, where)), ("é", ("article", 1, sort, where)), ("A" * 9000, ("article", 1, sort, where))):
        with pytest.raises(ir.QueryError, match="invalid cursor"):
            codec.decode(bad, *context)
    with pytest.raises(ir.QueryError):
        CursorCodec("other").decode(token, "article", 1, sort, where)


def test_modules_are_checked():
    for bad in (Module("1a"), Module("a", (Field("x"), Field("x"))), Module("a", (Field("id"),)), Module("a", (Field("t", "time"),)), Module("a", (Field("b", "text", unique=True),)), Module("a", (Field("e", "enumeration"),)), Module("a", (), (Relation("r", "a", "some"),))):
        with pytest.raises(SchemaError):
            bad.checked()
