"""Filters, order, pages and relations against a plain Python model of their meaning, on rows full of nulls and ties."""

import json
import random
import unicodedata
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from brindle.engine import Engine
from brindle.functions import values as V
from brindle.functions.columns import folded
from brindle.operators.filters import Filters
from brindle.plans import ir
from brindle.sources.catalog import Catalog, Field, Module, Relation
from pyspark.sql import functions as F

FIELDS = (Field("n", "integer"), Field("x", "float"), Field("ok", "boolean"), Field("s", "string"), Field("t", "text"), Field("big", "biginteger"), Field("price", "decimal", precision=12, scale=2), Field("at", "datetime"), Field("meta", "json"))
TEXTS = ["", "a", "A", "ß", "ss", "é", "é", "ﬁsh", "FISH", "Ａb", "😀", "zebra", "%_", "a\\b"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    some = lambda v: None if rng.random() < 0.15 else v
    out = []
    for i in range(1, 121):
        at = datetime(1969, 12, 31) + timedelta(milliseconds=rng.choice((0, 1, 86_400_000, 86_400_001, 10**12)))
        out.append((i, some(rng.randrange(-2, 3)), some(rng.choice((0.0, -1.5, 2.5, 1e18))), some(rng.random() < 0.5), some(rng.choice(TEXTS)), some(rng.choice(TEXTS)), some(rng.choice((0, 1, -1, 2**53 + 1, 2**63 - 1, -(2**63)))), some(Decimal(rng.choice(("0.00", "1.50", "-3.25", "9999999999.99")))), some(at), some('{"b":1,"a":9007199254740993}')))
    return out


@pytest.fixture(scope="module")
def engine(spark, rows):
    catalog = Catalog()
    article = Module("article", FIELDS, (Relation("author", "author", "manyToOne", inverse="articles"), Relation("tags", "tag", "manyToMany", inverse="articles")), bare=True)
    rng = random.Random(12)
    author_of = [(i, i, rng.randrange(1, 9)) for i in range(1, 121) if i % 4]
    author_of += [(500 + i, i, 8) for i in range(1, 20, 4)]  # a second edge: the first counts
    tags = [(n, rng.randrange(1, 121), rng.randrange(1, 12)) for n in range(1, 200)] + [(900, 3, 999)]
    link = lambda edges: spark.createDataFrame(edges, "id long, owner_id long, related_id long")
    catalog.register(article, spark.createDataFrame(rows, article.schema()).repartition(3).cache(), {"author": link(author_of), "tags": link(tags)})
    author = Module("author", (Field("name"), Field("score", "integer"), Field("mail", private=True)), (Relation("friend", "author", column="friend_id"),), bare=True)
    author_rows = [(i, f"Ann {i}", None if i == 3 else i % 3, f"{i}@x", None if i == 1 else i - 1) for i in range(1, 9)]
    catalog.register(author, spark.createDataFrame(author_rows, "id int, name string, score int, mail string, friend_id int").cache())
    tag = Module("tag", (Field("label"),), bare=True)
    catalog.register(tag, spark.createDataFrame([(i, f"t{i}") for i in range(1, 12)], tag.schema()).cache())
    e = Engine(catalog, "k")
    e.author_of, e.tags, e.authors = author_of, tags, {r[0]: r for r in author_rows}
    return e


def fold(x):
    return unicodedata.normalize("NFKC", x).lower()


def holds(leaf, row):
    """The meaning of a leaf, written apart from the engine."""
    names = ["id", *(f.name for f in FIELDS)]
    kind = {"id": "i32", **{f.name: f.kind for f in FIELDS}}[leaf.field]
    v, w, op = row[names.index(leaf.field)], leaf.value, leaf.op
    if op in ("null", "notNull"):
        return (v is None) == (op == "null")
    if v is None or kind == "bool" and op in ("gt", "gte", "lt", "lte", "between") or kind == "string" and op == "between" or kind == "text" and op in ("gt", "gte", "lt", "lte", "between", "in", "notIn"):
        return False
    if kind == "date":
        v = V.epoch_ms(v)
    if kind in ("string", "text") and op in ("gt", "gte", "lt", "lte"):
        v, w = v.encode(), w.encode()
    table = {
        "eq": lambda: v == w, "ne": lambda: v != w, "gt": lambda: v > w, "gte": lambda: v >= w, "lt": lambda: v < w, "lte": lambda: v <= w, "between": lambda: w[0] <= v <= w[1],
        "in": lambda: v in w, "notIn": lambda: v not in w, "eqi": lambda: fold(v) == fold(w), "nei": lambda: fold(v) != fold(w), "contains": lambda: w in v, "notContains": lambda: w not in v,
        "containsi": lambda: fold(w) in fold(v), "notContainsi": lambda: fold(w) not in fold(v), "startsWith": lambda: v.startswith(w), "startsWithi": lambda: fold(v).startswith(fold(w)), "endsWith": lambda: v.endswith(w), "endsWithi": lambda: fold(v).endswith(fold(w)),
    }
    return table[op]()


def meaning(node, row):
    if isinstance(node, ir.Leaf):
        return holds(node, row)
    if isinstance(node, ir.Not):
        return not meaning(node.part, row)
    return (all if isinstance(node, ir.And) else any)(meaning(p, row) for p in node.parts)


def a_value(rng, field):
    pool = {"i32": [-2, 0, 1, 2, 10**10, 0.5], "f64": [0, -1.5, 2.5, 1e18, float("inf")], "bool": [True, False], "string": TEXTS, "text": TEXTS, "i64": [0, 1, 2**53 + 1, 2**53, 2**63 - 1, -(2**63)], "decimal": [Decimal("0.00"), Decimal("1.50"), Decimal("9999999999.98")], "date": [-86_400_000, -86_399_999, 0, 1, 10**12 - 86_400_000, 2**53]}
    return rng.choice(pool[field.kind])


def a_leaf(rng):
    field = rng.choice([f for f in FIELDS if f.kind != "json"])
    ops = [o for o in ir.OPERATORS.values() if o not in ir.TEXT_ONLY or field.kind in ("string", "text")]
    op = rng.choice(ops)
    if op in ir.NULL_OPS:
        return ir.Leaf(field.name, op)
    n = 2 if op == "between" else rng.randrange(0, 4) if op in ir.SET_OPS else None
    return ir.Leaf(field.name, op, a_value(rng, field) if n is None else tuple(a_value(rng, field) for _ in range(n)))


def a_tree(rng, depth):
    kind = rng.choice(("leaf", "leaf", "and", "or", "not")) if depth else "leaf"
    if kind == "leaf":
        return a_leaf(rng)
    if kind == "not":
        return ir.Not(a_tree(rng, depth - 1))
    return (ir.And if kind == "and" else ir.Or)(tuple(a_tree(rng, depth - 1) for _ in range(rng.randrange(1, 4))))


def test_filters_against_their_meaning(engine, rows):
    """Many trees in one job: each is a column of the same projection."""
    rng = random.Random(13)
    trees = [a_leaf(rng) for _ in range(160)] + [a_tree(rng, 3) for _ in range(80)]
    compiler = Filters(engine.catalog)
    table = engine.catalog.rows["article"]
    for at in range(0, len(trees), 60):
        part = trees[at : at + 60]
        found = table.select("id", *(compiler.predicate("article", t).alias(f"p{i}") for i, t in enumerate(part))).collect()
        by_id = {r["id"]: r for r in found}
        for i, tree in enumerate(part):
            assert [by_id[r[0]][f"p{i}"] for r in rows] == [meaning(tree, r) for r in rows], tree


def test_empty_and_and_or(engine):
    assert engine.matching("article", ir.Query(where=ir.And(()))).count() == 120
    assert engine.matching("article", ir.Query(where=ir.Or(()))).count() == 0


def ids(engine, query, module="article"):
    return sorted(r["id"] for r in engine.matching(module, query).select("id").collect())


def test_relations_against_their_meaning(engine):
    tagged = {}
    for _, o, t in engine.tags:
        tagged.setdefault(o, set()).add(t)
    authors = {}
    for _, o, a in engine.author_of:
        authors.setdefault(o, set()).add(a)
    every = range(1, 121)
    assert ids(engine, "filters[tags][label]=t3") == [i for i in every if 3 in tagged.get(i, ())]
    assert ids(engine, "filters[$not][tags][label]=t3") == [i for i in every if 3 not in tagged.get(i, ())]
    assert ids(engine, {"filters": {"tags": {"$not": {"label": "t3"}}}}) == [i for i in every if tagged.get(i, set()) - {3, 999}]
    assert ids(engine, "filters[$or][0][tags][label]=t3&filters[$or][1][author][score]=1&filters[n][$notNull]=true") == [i for i in every if (3 in tagged.get(i, ()) or any(engine.authors[a][2] == 1 for a in authors.get(i, ()))) and i in ids(engine, "filters[n][$notNull]=true")]
    assert ids(engine, "filters[author][friend][friend][score]=2") == [i for i in every if any((x := engine.authors[a][4]) and (y := engine.authors[x][4]) and engine.authors[y][2] == 2 for a in authors.get(i, ()))]
    assert ids(engine, "filters[articles][id][$lt]=10", "author") == sorted({a for i in range(1, 10) for a in authors.get(i, ())})
    nested = {"filters": {"$not": {"$or": [{"tags": {"label": "t1"}}, {"$not": {"author": {"score": {"$null": True}}}}]}}}
    assert ids(engine, nested) == [i for i in every if 1 not in tagged.get(i, ()) and 3 in authors.get(i, ())]


def test_pages_and_their_order(engine, rows):
    answer = lambda q: json.loads(engine.list("article", q))
    got = answer("sort=n:asc,x:desc&pagination[page]=2&pagination[pageSize]=30&fields=n")
    expected = sorted(rows, key=lambda r: ((r[1] or 0), -(r[2] or 0.0), r[0]))
    assert [d["id"] for d in got["data"]] == [r[0] for r in expected[30:60]] and list(got["data"][0]) == ["id", "n"]
    assert got["meta"]["pagination"] == {"page": 2, "pageSize": 30, "pageCount": 4, "total": 120}
    assert [d["id"] for d in answer("sort=n:desc")["data"]] == [r[0] for r in sorted(rows, key=lambda r: (-(r[1] or 0), -r[0]))]
    by_text = sorted(sorted(rows, key=lambda r: r[0]), key=lambda r: (r[4] or "").encode(), reverse=True)  # ties stay in order of id
    assert [d["id"] for d in answer("sort=s:desc")["data"]] == [r[0] for r in by_text]
    assert answer("pagination[limit]=0")["data"] == [] and answer("pagination[page]=99")["data"] == []
    assert answer("")["meta"]["pagination"] == {"page": 1, "pageSize": 120, "pageCount": 1, "total": 120}


@pytest.mark.parametrize("sort", ["", "n:asc", "n:desc,s:asc", "at:desc", "price:asc,ok:desc,x:asc", "s:desc", "id:desc"])
def test_keyset_pages_are_the_whole_order_both_ways(engine, rows, sort):
    names = ["id", *(f.name for f in FIELDS)]
    keys = [k.split(":") for k in sort.split(",") if k]
    order = list(rows)
    order.sort(key=lambda r: r[0])
    for name, way in reversed(keys):
        i = names.index(name)
        value = lambda r, i=i: r[i].encode() if isinstance(r[i], str) else r[i]
        filled, empty = [r for r in order if r[i] is not None], [r for r in order if r[i] is None]
        filled.sort(key=value, reverse=way == "desc")
        if way == "desc":  # reverse keeps the order of ties
            order = empty + filled
        else:
            order = filled + empty
    page = lambda **p: json.loads(engine.list("article", {"sort": sort, "fields": "n", "pagination": {"pageSize": 45, **p}}))
    seen, cursor, answers = [], "", []
    while True:
        answers.append(page(cursor=cursor, withCount=True))
        seen += [d["id"] for d in answers[-1]["data"]]
        meta = answers[-1]["meta"]["pagination"]
        assert meta["total"] == 120 and meta["pageCount"] == 3
        if not meta["hasNextPage"]:
            break
        cursor = meta["nextCursor"]
    assert seen == [r[0] for r in order]
    back = page(before=answers[-1]["meta"]["pagination"]["prevCursor"])
    assert [d["id"] for d in back["data"]] == [d["id"] for d in answers[-2]["data"]] and back["meta"]["pagination"]["hasPreviousPage"]
    with pytest.raises(ir.QueryError):
        json.loads(engine.list("article", {"sort": "x:asc", "pagination": {"cursor": cursor}}))


def test_populate(engine):
    answer = json.loads(engine.list("article", "sort=id:desc&populate[author][populate]=friend&populate[tags]=true&pagination[limit]=40&fields=n"))
    authors, tags = {}, {}
    for _, o, a in sorted(engine.author_of):
        authors.setdefault(o, a)
    for _, o, t in sorted(engine.tags):
        tags.setdefault(o, []).append(t)
    assert [d["id"] for d in answer["data"]] == list(range(120, 80, -1))
    for d in answer["data"]:
        a = engine.authors.get(authors.get(d["id"]))
        assert list(d) == ["id", "n", "author", "tags"] and "mail" not in (d["author"] or {})
        assert d["author"] == (a and {"id": a[0], "name": a[1], "score": a[2], "friend": (b := engine.authors.get(a[4])) and {"id": b[0], "name": b[1], "score": b[2]}})
        assert [t["id"] for t in d["tags"]] == [t for t in tags.get(d["id"], []) if t != 999]
    star = json.loads(engine.list("author", "populate=*&filters[id]=2"))["data"][0]
    assert set(star) == {"id", "name", "score", "friend", "articles"} and star["friend"]["name"] == "Ann 1"
    deep = json.loads(engine.list("author", "populate[friend][populate][friend][populate][friend]=x&filters[id]=8"))["data"][0]
    assert "friend" not in deep["friend"]["friend"]
    with pytest.raises(ir.QueryError):
        engine.list("article", "populate=nope")


def test_single_rows_and_wire_forms(engine, rows):
    row = next(r for r in rows if None not in r)
    data = json.loads(engine.find_one("article", row[0], "filters[n]=99&sort=n"))["data"]
    assert data["big"] == str(row[6]) and data["price"] == f"{row[7]:.2f}" and data["at"] == V.render_instant(row[8])
    assert '"meta":{"b":1,"a":9007199254740993}' in engine.find_one("article", row[0])
    assert engine.decoded("article", data)["price"] == row[7]
    for missing in (0, 999, "01", "x", "1.0"):
        assert engine.find_one_or_none("article", missing) is None
    with pytest.raises(ir.QueryError):
        engine.find_one("article", 1, "filters[nope]=1")
    assert engine.count("article", "filters[n]=1") == sum(r[1] == 1 for r in rows)
    assert len(list(engine.list_all("article", {"filters": {"id": {"$lte": 25}}}, 10))) == len(list(engine.list_all_keyset("article", {"filters": {"id": {"$lte": 25}}}, 10))) == 25


def test_answers_are_kept_until_a_change(engine):
    engine.list("tag", "filters[label][$in]=t1,t2")
    assert len([k for k in engine.cache if k[0] == "tag"]) == 1
    engine.list("tag", "filters[label][$in]=t2,t1")
    assert len([k for k in engine.cache if k[0] == "tag"]) == 1
    engine.changed("tag")
    assert not [k for k in engine.cache if k[0] == "tag"]


def test_plans_push_down_and_prune(engine, spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    engine.catalog.rows["article"].write.parquet(path)
    catalog = Catalog()
    catalog.register(Module("article", FIELDS, bare=True), spark.read.parquet(path))
    plan = Engine(catalog).frame("article", "filters[n]=1&filters[s][$contains]=a&fields=n&sort=x:desc&pagination[limit]=5")._jdf.queryExecution().toString()
    assert "EqualTo(n,1)" in plan and "StringContains(s,a)" in plan and "TakeOrderedAndProject" in plan
    assert "price" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_folding_is_nfkc_then_lower_case_for_every_character(spark):
    texts = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + ["\U0001d400x", "e\u0301", "\ufb01sh", "\uff21\uff22", "stra\u00dfe", "\u03a3\u03a3", "\u0130x", "\u1112\u1161\u11ab", "\u00c9t\u00c9", "\u4e2d\u6587", "", "Plain"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", folded(F.col("t")).alias("f")).collect()
    wrong = [(texts[r["i"]], r["f"]) for r in rows if r["f"] != V.fold(texts[r["i"]])]
    assert wrong == []
