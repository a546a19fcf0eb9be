"""The engine's operators as named queries over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.engine import Engine
from brindle.operators import stats, validate, writes
from brindle.operators.filters import column
from brindle.plans import ir
from brindle.plans.build import f
from brindle.schema import diff, migrate
from brindle.sources import readers
from brindle.sources.catalog import Catalog, Field, Module, Relation

BIG = lambda name: Field(name, "biginteger", nullable=False)


_CATALOGS: dict[tuple[str, str], Catalog] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine of its own over the tables of a folder, which are looked up once per session."""
    key = f"{spark.sparkContext.applicationId} {id(spark)}", sf_dir
    if key not in _CATALOGS:
        _CATALOGS[key] = _catalog(spark, sf_dir)
    base = _CATALOGS[key]
    return Engine(Catalog(dict(base.modules), dict(base.rows), dict(base.links), dict(base.versions)), "a secret for synthetic data")


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The driver's tables as modules. They have no nulls, booleans or decimals: some columns are derived."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    catalog = Catalog()

    def put(name: str, own: Field, fields: list[Field], rows: DataFrame, relations: tuple = (), links: dict | None = None, **options) -> None:
        system = [n for n, on in (("document_id", options.get("i18n")), ("published_at", options.get("draft_and_publish")), ("locale", options.get("i18n"))) if on]
        catalog.register(Module(name, tuple(fields), relations, id_field=own, bare=True, **options), rows.select(own.name, *system, *(x.name for x in fields)), links)

    put("region", Field("r_regionkey", "integer"), [Field("r_name")], read("region"))
    put("nation", Field("n_nationkey", "integer"), [Field("n_name"), Field("n_regionkey", "integer")], read("nation"), (Relation("region", "region", inverse="nations", column="n_regionkey"), Relation("twin", "nation", column="n_regionkey")))
    customer = read("customer").withColumns({"bal": F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"), "tier": F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 0 ELSE CAST(c_custkey % 5 AS INT) END"), "nick": F.expr("CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END")})
    put("customer", BIG("c_custkey"), [Field("c_name"), Field("c_nationkey", "integer"), Field("c_acctbal", "float"), Field("c_mktsegment", "enumeration", values=("AUTOMOBILE",)), Field("bal", "float"), Field("tier", "integer"), Field("nick")], customer, (Relation("nation", "nation", inverse="customers", column="c_nationkey"),))
    put("secretive", BIG("c_custkey"), [Field("c_name"), Field("c_acctbal", "float", private=True), Field("c_mktsegment")], customer)
    put("supplier", BIG("s_suppkey"), [Field("s_name"), Field("s_nationkey", "integer"), Field("s_acctbal", "float")], read("supplier"), (Relation("nation", "nation", inverse="suppliers", column="s_nationkey"),))
    lineitem = read("lineitem")
    supplies = lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("owner_id"), F.col("l_suppkey").alias("related_id")).distinct()
    part = read("part").withColumn("even", F.expr("p_size % 2 = 0"))
    put("part", BIG("p_partkey"), [Field("p_name"), Field("p_brand"), Field("p_type"), Field("p_size", "integer"), Field("p_retailprice", "float"), Field("even", "boolean")], part, (Relation("suppliers", "supplier", "manyToMany", inverse="parts"),), {"suppliers": supplies})
    holds = lineitem.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("owner_id"), F.col("l_partkey").alias("related_id")).distinct()
    orders = read("orders").withColumns({"price": F.col("o_totalprice").cast("decimal(12,2)"), "published_at": F.expr("CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END")})
    order_fields = [BIG("o_custkey"), Field("o_orderstatus"), Field("o_totalprice", "float"), Field("o_orderdate", "datetime"), Field("o_orderpriority"), Field("price", "decimal", precision=12, scale=2)]
    relations = (Relation("customer", "customer", inverse="orders", column="o_custkey"), Relation("parts", "part", "manyToMany", inverse="orders"))
    put("orders", BIG("o_orderkey"), order_fields, orders, relations, {"parts": holds})
    put("posts", BIG("o_orderkey"), order_fields, orders, draft_and_publish=True)
    put("events", BIG("event_id"), [Field("ts", "datetime"), BIG("user_id"), Field("event_type"), Field("value", "float"), Field("props", "json")], read("events"))
    documents = read("documents")
    put("documents", BIG("doc_id"), [Field("text", "text"), Field("lang"), Field("source"), BIG("n_chars")], documents)
    variants = documents.withColumns({"document_id": F.expr("CAST(doc_id DIV 4 AS INT)"), "locale": F.col("lang")})
    put("pages_i18n", BIG("doc_id"), [Field("source"), BIG("n_chars")], variants, i18n=True)
    put("labels", BIG("doc_id"), [Field("quality", "integer"), Field("toxic", "integer")], read("labels"), (Relation("document", "documents", "oneToOne", inverse="label", column="doc_id"),))
    return catalog


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _page(name: str, module: str, query, sql: str, columns: str | None = None) -> None:
    """A query whose page is the result; columns, if given, are the ones compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = engine(spark, sf_dir).frame(module, query)
        return page.selectExpr(*columns.split("; ")) if columns else page

    QUERIES[name], ORACLES[name] = run, sql


def _where(name: str, module: str, condition, sql: str, columns: str) -> None:
    """All rows that a filter matches."""
    query = {"filters": condition.tree if hasattr(condition, "tree") else condition, "fields": columns}
    tables = {"customer": CUSTOMER, "orders": ORDERS, "part": PART}
    _page(name, module, query, f"SELECT {columns} FROM {tables.get(module, module)} WHERE {sql}")


CUSTOMER = "(SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 0 ELSE CAST(c_custkey % 5 AS INTEGER) END AS tier, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS nick FROM customer)"
ORDERS = "(SELECT *, CAST(o_totalprice AS DECIMAL(12,2)) AS price, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS published_at FROM orders)"
PART = "(SELECT *, p_size % 2 = 0 AS even FROM part)"

# -- leaves ------------------------------------------------------------------------

_C, _O, _P = "c_custkey,c_name,bal,tier", "o_orderkey,o_totalprice", "p_partkey,p_name,p_size"
_where("eq", "part", f("p_size").eq(7), "p_size = 7", _P)
_where("ne", "customer", f("tier").ne(3), "tier <> 3", _C)
_where("gt", "customer", f("bal").gt(5000), "bal > 5000", _C)
_where("gte", "customer", f("tier").gte(3), "tier >= 3", _C)
_where("lt", "customer", f("bal").lt("1e3"), "bal < 1000", _C)
_where("lte", "customer", f("tier").lte(1), "tier <= 1", _C)
_where("between", "customer", f("tier").between(1, 2), "tier BETWEEN 1 AND 2", _C)
_where("between_reversed", "customer", f("tier").between(2, 1), "FALSE", _C)
_where("in", "customer", f("tier").in_(0, 4), "tier IN (0, 4)", _C)
_where("in_empty", "customer", f("tier").in_([]), "FALSE", _C)
_where("not_in", "customer", f("tier").not_in(0, 4), "tier NOT IN (0, 4)", _C)
_where("not_in_empty", "customer", f("tier").not_in([]), "tier IS NOT NULL", _C)
_where("is_null", "customer", f("bal").null(), "bal IS NULL", _C)
_where("not_null", "customer", f("bal").not_null(), "bal IS NOT NULL", _C)
_where("eqi", "customer", f("nick").eqi("CUSTOMER#000000007"), "lower(nick) = 'customer#000000007'", "c_custkey,nick")
_where("nei", "customer", f("nick").nei("CUSTOMER#000000007"), "lower(nick) <> 'customer#000000007'", "c_custkey,nick")
_where("contains", "customer", f("nick").contains("00012"), "contains(nick, '00012')", "c_custkey,nick")
_where("not_contains", "customer", f("nick").not_contains("00012"), "NOT contains(nick, '00012')", "c_custkey,nick")
_where("containsi", "documents", f("text").containsi("LICENSE"), "contains(lower(text), 'license')", "doc_id,lang")
_where("not_containsi", "documents", f("text").not_containsi("LICENSE"), "NOT contains(lower(text), 'license')", "doc_id,lang")
_where("starts_with", "part", f("p_name").starts_with("small "), "starts_with(p_name, 'small ')", _P)
_where("starts_withi", "customer", f("nick").starts_withi("cUSTOMER#0000001"), "starts_with(lower(nick), 'customer#0000001')", "c_custkey,nick")
_where("ends_with", "customer", f("nick").ends_with("7"), "ends_with(nick, '7')", "c_custkey,nick")
_where("ends_withi", "documents", f("source").ends_withi("C7"), "ends_with(lower(source), 'c7')", "doc_id,source")
_where("i64_range", "orders", f("o_orderkey").gte("100").and_(f("o_orderkey").lt("200")), "o_orderkey >= 100 AND o_orderkey < 200", _O)
_where("decimal_eq", "orders", f("price").gt("100000.50"), "price > 100000.50", "o_orderkey,price")
_where("decimal_between", "orders", f("price").between("1000.00", "2000.50"), "price BETWEEN 1000.00 AND 2000.50", "o_orderkey,price")
_where("date_between", "orders", f("o_orderdate").between("1995-01-01", "1995-12-31T23:59:59Z"), "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-12-31 23:59:59.001'", "o_orderkey,o_orderdate")
_where("date_after", "events", f("ts").gt("2024-01-10T12:00:00Z"), "ts >= TIMESTAMP '2024-01-10 12:00:00.001'", "event_id,ts")
_where("bool_eq", "part", f("even").eq(True), "even", "p_partkey,even")
_where("bool_range_noop", "part", f("even").gt(False), "FALSE", "p_partkey,even")
_where("text_in_noop", "documents", f("text").in_("a", "b"), "FALSE", "doc_id,lang")
_where("not_text_in_noop", "documents", f("text").in_("a", "b").not_(), "TRUE", "doc_id,lang")

# -- combinators -------------------------------------------------------------------

_where("and_implicit", "customer", {"tier": {"$gte": 1, "$lt": 4}, "bal": {"$gt": 0}}, "tier >= 1 AND tier < 4 AND bal > 0", _C)
_where("or", "customer", f("tier").eq(0) | f("bal").gt(9000), "coalesce(tier = 0, FALSE) OR coalesce(bal > 9000, FALSE)", _C)
_where("not_includes_null", "customer", f("tier").eq(3).not_(), "NOT coalesce(tier = 3, FALSE)", _C)
_where("not_of_or", "customer", (f("tier").eq(0) | f("bal").lt(0)).not_(), "NOT (coalesce(tier = 0, FALSE) OR coalesce(bal < 0, FALSE))", _C)
_where("nested_tree", "customer", f("c_custkey").lt(1000) & (f("tier").in_(1, 2) | ~(f("bal").gte(0) & f("nick").ends_with("3"))), "c_custkey < 1000 AND (coalesce(tier IN (1, 2), FALSE) OR NOT (coalesce(bal >= 0, FALSE) AND coalesce(ends_with(nick, '3'), FALSE)))", _C)

# -- relations ---------------------------------------------------------------------

_where("exists_1hop", "orders", f("customer", "c_mktsegment").eq("BUILDING"), "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')", _O)
_where("exists_2hop", "orders", f("customer", "nation", "n_name").ends_with("1"), "EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = o_custkey AND ends_with(n_name, '1'))", _O)
_where("exists_3hop", "orders", f("customer", "nation", "region", "r_name").eq("ASIA"), "EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey = o_custkey AND r_name = 'ASIA')", _O)
_where("exists_m2m", "part", f("suppliers", "s_acctbal").gt(9000), "EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 9000)", _P)
_where("exists_inverse", "customer", f("orders", "o_totalprice").gt(300000), "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", _C)
_where("exists_inverse_m2m", "supplier", f("parts", "p_size").eq(50), "EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_size = 50)", "s_suppkey,s_name")
_where("exists_or_scalar", "customer", f("orders", "o_totalprice").gt(300000) | f("tier").eq(0), "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) OR coalesce(tier = 0, FALSE)", _C)
_where("not_exists", "orders", f("parts", "p_partkey").gte(0).not_(), "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", _O)
_where("exists_not_inside", "customer", f("orders", "o_orderstatus").eq("F").not_() & {"orders": {"$not": {"o_orderstatus": {"$eq": "F"}}}}, "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')", _C)
_where("self_relation", "nation", f("twin", "n_name").contains("2"), "EXISTS (SELECT 1 FROM nation t WHERE t.n_nationkey = nation.n_regionkey AND contains(t.n_name, '2'))", "n_nationkey,n_name")

# -- order and pages ---------------------------------------------------------------

_page("sort_single", "orders", "sort=o_totalprice:desc&pagination[limit]=50&fields=o_orderkey,o_totalprice", f"SELECT {_O} FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 50")
_page("sort_multi", "orders", "sort=o_orderstatus:asc,o_totalprice:desc&pagination[limit]=50&fields=o_orderkey,o_totalprice", f"SELECT {_O} FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50")
_page("sort_null_sentinel", "customer", "sort=tier:asc,bal:desc&pagination[limit]=300&fields=c_custkey,tier", f"SELECT c_custkey, tier FROM {CUSTOMER} ORDER BY coalesce(tier, 0), coalesce(bal, 0) DESC, c_custkey LIMIT 300")
_page("sort_tie_desc", "customer", "sort=tier:desc&pagination[limit]=100&fields=c_custkey,tier", f"SELECT c_custkey, tier FROM {CUSTOMER} ORDER BY coalesce(tier, 0) DESC, c_custkey DESC LIMIT 100")
_page("page_offset", "orders", "sort=o_orderdate:desc,o_orderkey:asc&pagination[page]=4&pagination[pageSize]=25&fields=o_orderkey,o_orderdate", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 75")
_page("page_default_order", "orders", "pagination[start]=1000&pagination[limit]=20&fields=o_totalprice", f"SELECT {_O} FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 1000")
_page("keyset_first", "customer", "sort=bal:desc&pagination[cursor]=&pagination[pageSize]=300&fields=c_custkey,bal", f"SELECT c_custkey, bal FROM {CUSTOMER} ORDER BY bal DESC NULLS FIRST, c_custkey LIMIT 300")
_page("fields_projection", "orders", "fields=o_totalprice,o_custkey&filters[o_orderstatus]=P", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
_page("private_strip", "secretive", "", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
_page("flagship", "orders", "filters[o_orderstatus][$eq]=F&filters[o_totalprice][$gte]=100000&filters[customer][nation][region][r_name][$eq]=EUROPE&sort=o_totalprice:desc,o_orderkey:asc&pagination[limit]=25&fields=o_orderkey,o_totalprice", f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 AND EXISTS (SELECT 1 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey = o_custkey AND r_name = 'EUROPE') ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")


def _registered(oracle: str):
    def put(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__], ORACLES[run.__name__] = run, oracle
        return run

    return put


def _keyset(spark: SparkSession, sf_dir: str, sort: str, size: int, backward: bool) -> DataFrame:
    """The second page after a first one; or the first one again, before where the second began."""
    import json

    e = engine(spark, sf_dir)
    query = lambda **page: {"sort": sort, "fields": "c_custkey,bal,tier", "pagination": {"pageSize": size, **page}}
    first = json.loads(e.list("customer", query(cursor="")))["meta"]["pagination"]
    if not backward:
        return e.frame("customer", query(cursor=first["nextCursor"]))
    second = json.loads(e.list("customer", query(cursor=first["nextCursor"])))["meta"]["pagination"]
    return e.frame("customer", query(before=second["prevCursor"]))


_MIXED = f"SELECT c_custkey, bal, tier FROM {CUSTOMER} ORDER BY tier ASC NULLS LAST, bal DESC NULLS FIRST, c_custkey"


@_registered(f"SELECT c_custkey, bal, tier FROM {CUSTOMER} ORDER BY bal DESC NULLS FIRST, c_custkey LIMIT 60 OFFSET 60")
def keyset_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyset(spark, sf_dir, "bal:desc", 60, False)


@_registered(f"{_MIXED} LIMIT 60 OFFSET 60")
def keyset_mixed_dir_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyset(spark, sf_dir, "tier:asc,bal:desc", 60, False)


@_registered(f"{_MIXED} LIMIT 60")
def keyset_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyset(spark, sf_dir, "tier:asc,bal:desc", 60, True)


@_registered("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).matching("orders", "filters[o_orderstatus]=F").agg(F.count(F.lit(1)).alias("total"))


@_registered("SELECT 3 AS page, 100 AS \"pageSize\", CAST(ceil(count(*) / 100.0) AS INTEGER) AS \"pageCount\", CAST(count(*) AS INTEGER) AS total FROM orders WHERE o_orderstatus = 'F'")
def page_meta_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    meta = json.loads(engine(spark, sf_dir).list("orders", "filters[o_orderstatus]=F&pagination[page]=3&pagination[pageSize]=100"))["meta"]["pagination"]
    return spark.createDataFrame([tuple(meta[k] for k in ("page", "pageSize", "pageCount", "total"))], "page int, pageSize int, pageCount int, total int")


# -- populate ------------------------------------------------------------------------

_page("populate_to_one", "orders", "populate=customer", "SELECT o_orderkey, c_custkey AS customer_id, c_name AS customer_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey", "o_orderkey; customer.c_custkey AS customer_id; customer.c_name AS customer_name")
_page("populate_to_many", "part", "populate=suppliers", "SELECT p_partkey, coalesce(string_agg(CAST(s AS VARCHAR), ',' ORDER BY s), '') AS suppliers FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem) ON l_partkey = p_partkey GROUP BY p_partkey", "p_partkey; array_join(transform(suppliers, s -> cast(s.s_suppkey AS string)), ',') AS suppliers")
_page("populate_inverse", "customer", "populate=orders", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "c_custkey; cast(size(orders) AS bigint) AS n; aggregate(orders, 0L, (a, o) -> a + o.o_orderkey) AS keys")
_page("populate_nested2", "orders", "populate[customer][populate]=nation", "SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey", "o_orderkey; customer.nation.n_name AS n_name")
_page("populate_star", "nation", "populate=*", "SELECT n_nationkey, r_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey", "n_nationkey; region.r_name AS r_name; cast(size(customers) AS bigint) AS customers; cast(size(suppliers) AS bigint) AS suppliers")
_page("populate_missing_side", "documents", "populate=label&fields=lang", "SELECT documents.doc_id AS doc_id, quality FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id", "doc_id; label.quality AS quality")


@_registered("SELECT p_partkey, s_name AS cover, (SELECT string_agg(s.s_name, ',' ORDER BY s.s_suppkey DESC) FROM supplier s WHERE s.s_suppkey IN (1 + p_partkey % 7, 3)) AS photos FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 130")
def media_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers stand for assets: one, some of which aren't there, and a list in its own order."""
    e = engine(spark, sf_dir)
    rows = e.catalog.rows["part"].select("p_partkey", F.expr("CAST(p_partkey % 130 AS INT)").alias("cover"), F.expr("to_json(filter(array_sort(array_distinct(array(1 + p_partkey % 7, 3L, 100000L)), (a, b) -> CAST(b - a AS INT)), x -> x > 0))").alias("photos"))
    e.catalog.register(Module("gallery", (Field("cover", "media"), Field("photos", "media", multiple=True)), id_field=BIG("p_partkey"), bare=True), rows)
    e.catalog.files = e.catalog.rows["supplier"].select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"))
    return e.frame("gallery", "populate=cover,photos").selectExpr("p_partkey", "cover.name AS cover", "array_join(photos.name, ',') AS photos")


# -- visibility ------------------------------------------------------------------------

_PUBLISHED = f"SELECT o_orderkey, published_at FROM {ORDERS} WHERE published_at IS"
_page("status_published", "posts", "fields=published_at", f"{_PUBLISHED} NOT NULL")
_page("status_draft", "posts", "fields=published_at&status=draft", f"{_PUBLISHED} NULL")
_VARIANTS = "SELECT doc_id, CAST(doc_id // 4 AS INTEGER) AS document_id, lang AS locale FROM documents"
_page("locale_eq", "pages_i18n", "fields=document_id,locale&locale=fr", f"{_VARIANTS} WHERE lang = 'fr'")
_page("locale_default", "pages_i18n", "fields=document_id,locale", f"{_VARIANTS} WHERE lang = 'en'")
_page("locale_all", "pages_i18n", "fields=document_id,locale&locale=*", _VARIANTS)

# -- writes ------------------------------------------------------------------------------


def _rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_registered("SELECT * FROM nation UNION ALL SELECT 100 + r_regionkey, upper(r_name), r_regionkey FROM region")
def write_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _rows(spark, sf_dir, "region").selectExpr("100 + r_regionkey AS n_nationkey", "upper(r_name) AS n_name", "r_regionkey AS n_regionkey")
    return writes.inserted(_rows(spark, sf_dir, "nation"), new)


@_registered("SELECT c_custkey, CASE WHEN c_custkey IN (3, 5, 8) THEN 'renamed' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey IN (3, 5, 8) THEN 1.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def write_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.updated(_rows(spark, sf_dir, "customer"), "c_custkey", [3, 5, 8], {"c_name": "renamed", "c_acctbal": 1.5})


@_registered("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'new', 0")
def write_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "nation")
    changes = rows.filter("n_nationkey % 2 = 0").selectExpr("n_nationkey", "lower(n_name) AS n_name", "n_regionkey").union(spark.sql("SELECT 100, 'new', 0"))
    return writes.merged(rows, changes, "n_nationkey")


@_registered("SELECT DISTINCT l_partkey AS owner_id, l_suppkey AS related_id FROM lineitem WHERE l_partkey >= 100 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def write_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    parts = e.catalog.rows["part"].filter("p_partkey < 100").select(F.col("p_partkey").alias("id"))
    suppliers = e.catalog.rows["supplier"].filter("s_acctbal < 0").select(F.col("s_suppkey").alias("id"))
    return writes.unlinked(writes.unlinked(e.catalog.links["part.suppliers"], "owner_id", parts), "related_id", suppliers).select("owner_id", "related_id")


@_registered("SELECT doc_id, CAST(doc_id // 4 AS INTEGER) AS document_id, CASE WHEN doc_id // 4 = 12 THEN 'shared' ELSE source END AS source FROM documents")
def shared_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir).catalog.rows["pages_i18n"]
    return writes.fanned_out(rows, 12, {"source": "shared"}).select("doc_id", "document_id", "source")


_LINKS = "SELECT DISTINCT l_partkey AS owner_id, l_suppkey AS related_id FROM lineitem"


def _side(e: Engine) -> object:
    return e.catalog.sides("part")["suppliers"]


@_registered(f"SELECT * FROM ({_LINKS}) WHERE owner_id <> 7 UNION ALL SELECT * FROM (VALUES (7, 2), (7, 1)) t(owner_id, related_id)")
def relation_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return writes.relinked(e.catalog.links["part.suppliers"], _side(e), 7, {"set": [2, 1]}).select("owner_id", "related_id")


@_registered(f"SELECT * FROM ({_LINKS}) WHERE NOT (owner_id = 7 AND related_id IN (SELECT related_id FROM ({_LINKS}) WHERE owner_id = 7 AND related_id % 2 = 0))")
def relation_disconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    links = e.catalog.links["part.suppliers"]
    return writes.disconnected(links, links.filter("owner_id = 7 AND related_id % 2 = 0")).select("owner_id", "related_id")


@_registered("SELECT o_orderkey AS owner_id, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE o_custkey END AS related_id FROM orders")
def relation_connect_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many-to-one: connecting an order to another customer takes it from the one it had."""
    orders = _rows(spark, sf_dir, "orders")
    links = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("owner_id"), F.col("o_custkey").alias("related_id"))
    new = orders.filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("owner_id"), F.lit(1).cast("long").alias("related_id"))
    return writes.connected(links, new, "manyToOne").select("owner_id", "related_id")


@_registered("SELECT l_suppkey AS id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey > 10) GROUP BY 1")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _rows(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id")).distinct()
    return writes.dangling(ids, _rows(spark, sf_dir, "supplier").filter("s_suppkey > 10"), "s_suppkey")


# -- counts and checks --------------------------------------------------------------------


@_registered(" UNION ALL ".join(f"SELECT '{m}' AS module, count(*) AS rows FROM {t}" for m, t in (("customer", "customer"), ("documents", "documents"), ("events", "events"), ("labels", "labels"), ("nation", "nation"), ("orders", "orders"), ("pages_i18n", "documents"), ("part", "part"), ("posts", "orders"), ("region", "region"), ("secretive", "customer"), ("supplier", "supplier"))))
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(engine(spark, sf_dir).catalog)


@_registered("SELECT * FROM (SELECT 'events' AS module, event_id AS id, ts AS updated_at FROM events UNION ALL SELECT 'orders', o_orderkey, o_orderdate FROM orders) ORDER BY updated_at DESC, module, id LIMIT 3")
def dashboard_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, catalog = engine(spark, sf_dir), Catalog()
    for name, key, at in (("events", "event_id", "ts"), ("orders", "o_orderkey", "o_orderdate")):
        rows = e.catalog.rows[name].select(key, F.col(at).alias("updated_at"))
        catalog.register(Module(name, (Field("updated_at", "datetime"),), id_field=BIG(key), bare=True), rows)
    return stats.recent(catalog)


@_registered("SELECT count(*) AS n FROM documents WHERE length(text) > 1000")
def migrate_too_long_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.too_long(_rows(spark, sf_dir, "documents"), "text", 1000)


@_registered("SELECT count(*) AS n FROM (SELECT CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders) WHERE price <> round(price, 1)")
def migrate_scale_loss_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.loses_scale(engine(spark, sf_dir).catalog.rows["orders"], "price", 1)


@_registered(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls FROM {CUSTOMER}" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "bal", "tier", "nick")))
def inspect_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return stats.inspect(e.catalog.rows["customer"], e.catalog.module("customer")).select("column", "rows", "nulls")


@_registered(f"SELECT c_custkey, concat_ws(';', CASE WHEN length(c_name) > 17 THEN 'c_name: too long' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'c_mktsegment: not a member' END, CASE WHEN bal IS NULL THEN 'bal: null' END, CASE WHEN bal < 0 THEN 'bal: out of bounds' END) AS errors FROM {CUSTOMER} WHERE length(c_name) > 17 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY') OR bal IS NULL OR bal < 0")
def bulk_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = Module("customer", (Field("c_name", length=17), Field("c_mktsegment", "enumeration", values=("BUILDING", "MACHINERY")), Field("bal", "float", nullable=False, min=0)), id_field=BIG("c_custkey"), bare=True)
    _, bad = validate.split_valid(engine(spark, sf_dir).catalog.rows["customer"].select("c_custkey", "c_name", "c_mktsegment", "bal"), strict)
    return bad.select("c_custkey", F.array_join("errors", ";").alias("errors"))


@_registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 33")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).matching("orders", ir.Query(where=ir.Leaf("o_orderkey", "eq", 33))).limit(1).select(column("o_orderkey"), column("o_totalprice"))


# -- answers on the wire ---------------------------------------------------------------------


def _answered(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of an answer, which is a page, as a DataFrame."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


@_registered(f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS o_orderdate, CAST(price AS VARCHAR) AS price FROM {ORDERS} ORDER BY o_totalprice DESC LIMIT 40")
def list_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit numbers and decimals as text, instants in ISO form."""
    import json

    data = json.loads(engine(spark, sf_dir).list("orders", "sort=o_totalprice:desc&pagination[limit]=40"))["data"]
    return _answered(spark, data, "o_orderkey string, o_orderstatus string, o_orderdate string, price string")


_GATED = f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM {ORDERS} WHERE o_orderkey IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 99999999) AND published_at IS"


def _singles(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    import json

    e = engine(spark, sf_dir)
    found = [e.find_one_or_none("posts", i, query) for i in (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 99999999)]
    return _answered(spark, [json.loads(x)["data"] for x in found if x], "o_orderkey string, o_orderstatus string")


@_registered(f"{_GATED} NOT NULL")
def single_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _singles(spark, sf_dir, "")


@_registered(f"{_GATED} NULL")
def single_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _singles(spark, sf_dir, "status=draft")


@_registered(f"SELECT 70 AS \"pageSize\", count(*) > 70 AS \"hasNextPage\", FALSE AS \"hasPreviousPage\", CAST(count(*) AS INTEGER) AS total, CAST(ceil(count(*) / 70.0) AS INTEGER) AS \"pageCount\" FROM {CUSTOMER} WHERE tier > 1")
def keyset_meta_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    meta = json.loads(engine(spark, sf_dir).list("customer", "filters[tier][$gt]=1&sort=bal:desc&pagination[cursor]=&pagination[pageSize]=70&pagination[withCount]=true"))["meta"]["pagination"]
    return _answered(spark, [meta], "pageSize int, hasNextPage boolean, hasPreviousPage boolean, total int, pageCount int")


@_registered("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey > 0")
def iterate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, list(engine(spark, sf_dir).list_all("nation", {"filters": {"n_regionkey": {"$gt": 0}}}, 7)), "n_nationkey int, n_name string")


@_registered("SELECT n_nationkey, n_name FROM nation")
def iterate_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, list(engine(spark, sf_dir).list_all_keyset("nation", {"sort": "n_name:desc"}, 6)), "n_nationkey int, n_name string")


@_registered("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN s_name END AS pick, p_name AS title FROM part LEFT JOIN supplier ON s_suppkey = p_partkey ORDER BY p_partkey LIMIT 60")
def component_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component that names a supplier, one in two that aren't there."""
    import json

    e = engine(spark, sf_dir)
    seo = F.expr("to_json(struct(p_name AS title, IF(p_partkey % 2 = 0, p_partkey, 10000000 + p_partkey) AS pick))")
    rows = e.catalog.rows["part"].select("p_partkey", seo.alias("seo"))
    e.components["seo"] = Module("seo", (Field("title"),), (Relation("pick", "supplier", column=None),), bare=True)
    e.catalog.register(Module("catalogue", (Field("seo", "component", components=("seo",)),), id_field=BIG("p_partkey"), bare=True), rows)
    data = json.loads(e.list("catalogue", "populate=seo&pagination[limit]=60"))["data"]
    return spark.createDataFrame([(int(d["p_partkey"]), (d["seo"]["pick"] or {}).get("s_name"), d["seo"]["title"]) for d in data], "p_partkey long, pick string, title string")


# -- folding beyond ASCII ----------------------------------------------------------------------

_WIDE = "CASE c_custkey % 4 WHEN 0 THEN '\ufb01sh' WHEN 1 THEN '\uff26\uff29\uff33\uff28' WHEN 2 THEN 'E\u0301t\u00e9' ELSE c_name END"
_NARROW = "CASE c_custkey % 4 WHEN 0 THEN 'fish' WHEN 1 THEN 'fish' WHEN 2 THEN '\u00e9t\u00e9' ELSE lower(c_name) END"


def _folding(name: str, condition, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        e.catalog.register(Module("wide", (Field("word"),), id_field=BIG("c_custkey"), bare=True), e.catalog.rows["customer"].selectExpr("c_custkey", f"{_WIDE} AS word"))
        return e.frame("wide", {"filters": condition.tree})

    QUERIES[name], ORACLES[name] = run, f"SELECT c_custkey, {_WIDE} AS word FROM customer WHERE {sql}"


_folding("fold_eqi", f("word").eqi("FISH"), f"{_NARROW} = 'fish'")
_folding("fold_nei", f("word").nei("\u00c9T\u00c9"), f"{_NARROW} <> '\u00e9t\u00e9'")
_folding("fold_containsi", f("word").containsi("\uff29S"), f"contains({_NARROW}, 'is')")
_folding("fold_not_containsi", f("word").not_containsi("T\u00c9"), f"NOT contains({_NARROW}, 't\u00e9')")
_folding("fold_starts_withi", f("word").starts_withi("\ufb01"), f"starts_with({_NARROW}, 'fi')")
_folding("fold_ends_withi", f("word").ends_withi("E\u0301"), f"ends_with({_NARROW}, '\u00e9')")
_where("fold_accents", "documents", f("text").containsi("CI\u00d3N"), "contains(lower(text), 'ci\u00f3n')", "doc_id,lang")

# -- loading and definitions that change -----------------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("owner_id"), F.expr("o_custkey * 2").alias("related_id"))
    return readers.links(rows, _rows(spark, sf_dir, "orders"), "o_orderkey", _rows(spark, sf_dir, "customer"), "c_custkey")


@_registered("SELECT o_orderkey AS id, o_orderkey AS owner_id, o_custkey * 2 AS related_id FROM orders WHERE o_custkey * 2 IN (SELECT c_custkey FROM customer)")
def links_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[0]


@_registered("SELECT o_orderkey AS id, o_orderkey AS owner_id, o_custkey * 2 AS related_id FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def links_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[1]


@_registered("SELECT event_id, date_trunc('millisecond', ts) AS ts, CAST(user_id AS VARCHAR) AS who, CAST(value AS DECIMAL(10,1)) AS value FROM events")
def coerced_on_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = Module("events", (Field("ts", "datetime"), Field("who"), Field("value", "decimal", precision=10, scale=1)), id_field=BIG("event_id"), bare=True)
    return readers.coerced(_rows(spark, sf_dir, "events").withColumnRenamed("user_id", "who"), target)


_OLD = Module("orders", (Field("o_custkey", "biginteger", id="a"), Field("o_orderstatus", id="b"), Field("o_totalprice", "float", id="c"), Field("o_orderdate", "datetime", id="d"), Field("o_orderpriority", id="e")), id_field=BIG("o_orderkey"), bare=True)


@_registered("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_orderstatus, o_orderstatus AS o_custkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS placed, 7 AS rank FROM orders")
def migrate_reshaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields swap their names, one of them and another change type, two go, one comes with its default."""
    new = Module("orders", (Field("o_orderstatus", id="a"), Field("o_custkey", id="b"), Field("placed", id="d"), Field("rank", "integer", default=7, id="f")), id_field=BIG("o_orderkey"), bare=True)
    return migrate.reshaped(_rows(spark, sf_dir, "orders"), _OLD, new)


@_registered("SELECT * FROM (VALUES ('addField', 'orders', 'rank'), ('dropField', 'orders', 'o_orderpriority'), ('dropField', 'orders', 'o_totalprice'), ('renameField', 'orders', 'o_custkey'), ('renameField', 'orders', 'o_orderstatus'), ('renameField', 'orders', 'placed')) t(kind, module, name)")
def migrate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the differ finds, by identity: names may swap. Order and types, which migrate_reshaped covers, aside."""
    new = Module("orders", (Field("o_orderstatus", "biginteger", id="a"), Field("o_custkey", id="b"), Field("placed", "datetime", id="d"), Field("rank", "integer", id="f")), id_field=BIG("o_orderkey"), bare=True)
    found = [(c.kind, c.module, c.name) for c in migrate.plan(Catalog({"orders": _OLD}), [new], allow_destructive=True) if c.kind != "reorderFields"]
    return spark.createDataFrame(found, "kind string, module string, name string")


@_registered(f"SELECT (SELECT count(*) FROM {CUSTOMER} WHERE bal IS NULL) AS required, (SELECT count(*) FROM {CUSTOMER} WHERE length(c_name) > 17) AS shorter, (SELECT count(*) FROM {CUSTOMER} WHERE bal <> round(bal)) AS whole")
def migrate_obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stand against a field that becomes required, one that gets shorter and one that loses its fraction."""
    rows = engine(spark, sf_dir).catalog.rows["customer"]
    change = lambda kind, old, new: diff.Change(kind, "customer", diff.DATA, new.name, old, new)
    bal = Field("bal", "float")
    found = (
        migrate.obstacles(rows, change("setFieldNullable", bal, Field("bal", "float", nullable=False))),
        migrate.obstacles(rows, change("retypeField", Field("c_name"), Field("c_name", length=17))),
        migrate.obstacles(rows, change("retypeField", bal, Field("bal", "biginteger"))),
    )
    return spark.createDataFrame([found], "required long, shorter long, whole long")


@_registered("SELECT o_orderkey, CASE WHEN o_orderkey IN (1, 2, 3) THEN TIMESTAMP '2024-05-01 10:00:00' WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate END AS published_at FROM orders")
def publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    rows = engine(spark, sf_dir).catalog.rows["posts"]
    return writes.updated(rows, "o_orderkey", [1, 2, 3], {"published_at": datetime(2024, 5, 1, 10)}).select("o_orderkey", "published_at")


@_registered(f"SELECT * FROM ({_LINKS}) WHERE related_id <> 3 UNION ALL SELECT * FROM (VALUES (5, 3), (9, 3)) t(owner_id, related_id)")
def relation_set_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links, written from their other end."""
    e = engine(spark, sf_dir)
    return writes.relinked(e.catalog.links["part.suppliers"], e.catalog.sides("supplier")["parts"], 3, {"set": [9, 5]}).select("owner_id", "related_id")


@_registered("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 30 OFFSET 20")
def inspect_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return stats.window(e.catalog.rows["part"], e.catalog.module("part"), 20, 30).select("p_partkey", "p_name")


@_registered(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_size")))
def inspect_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return stats.inspect(e.catalog.rows["part"], e.catalog.module("part")).filter(F.col("column").isin("p_partkey", "p_name", "p_brand", "p_size")).select("column", "least", "greatest")
