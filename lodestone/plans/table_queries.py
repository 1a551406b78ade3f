"""Questions over tables: profiles, routing, guarded SQL from a writer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import tables
from lodestone.session import TABLES, table
from lodestone.sources import files

_STARS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _views(spark, d, *names):
    for name in names:
        table(spark, d, name).createOrReplaceTempView(name)
    return set(names)


def table_profile(spark, d):
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), [tables.profile(table(spark, d, n), n) for n in _STARS]).select("table_name", "column_name", "n_rows", "n_nulls")


def table_router(spark, d):
    """Which table a question names."""
    q = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("How many "), F.element_at(F.array(*[F.lit(t) for t in TABLES]), F.pmod("n_nationkey", F.lit(len(TABLES))).cast("int") + 1), F.lit(" are there?")).alias("question"))
    return q.select("n_nationkey", tables.mentioned(F.col("question"), list(TABLES)).alias("routed_to"))


def nl_total_by(spark, d):
    return tables.ask(spark, "What is the total o_totalprice of orders by o_orderstatus?", tables.templates, _views(spark, d, "orders"))[0]


def nl_average_by(spark, d):
    return tables.ask(spark, "average c_acctbal of customer by c_mktsegment", tables.templates, _views(spark, d, "customer"))[0]


def nl_share(spark, d):
    def writer(question, error):
        return "SELECT round(100.0 * count_if(l_returnflag = 'R') / count(*), 2) AS value FROM lineitem"

    return tables.ask(spark, "Which share of items came back?", writer, _views(spark, d, "lineitem"))[0].select(F.col("value").cast("double").alias("value"))


def nl_fixed(spark, d):
    """The first statement names a column that isn't there; the error is handed back and the second one runs."""

    def writer(question, error):
        column = "c_nation" if error is None else "c_nationkey"
        return f"SELECT {column} AS nation, count(*) AS n, round(max(c_acctbal), 2) AS best FROM customer GROUP BY {column}"

    return tables.ask(spark, "How many customers has each nation?", writer, _views(spark, d, "customer"))[0]


def nl_join(spark, d):
    def writer(question, error):
        return (
            "WITH r AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) "
            "SELECT r_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN r ON s_nationkey = n_nationkey GROUP BY r_name"
        )

    return tables.ask(spark, "Suppliers by region", writer, _views(spark, d, "nation", "region", "supplier"))[0]


def nl_top(spark, d):
    return tables.ask(spark, "top 10 part by p_retailprice", lambda q, e: "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10", _views(spark, d, "part"))[0]


def csv_tables(spark, d):
    """Customers as CSV files of a hundred, in turns of four encodings, read back as tables' rows."""
    c = table(spark, d, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""né""\nhere"')), F.col("c_acctbal").cast("string"), F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.lit("")).otherwise(F.col("c_mktsegment")))
    held = c.groupBy(F.floor(F.col("c_custkey") / 100).alias("g")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", line.alias("l"))))["l"].alias("l"))
    text = F.concat(F.lit("Cust Key,NAME,Acct.Bal,name\n"), F.array_join("l", "\n"), F.lit("\n"))
    n = F.pmod("g", F.lit(4))
    raw = F.when(n == 0, F.encode(text, "UTF-8")).when(n == 1, F.encode(text, "UTF-16")).when(n == 2, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "ISO-8859-1"))
    rows = files.csv_rows(held.select(F.concat(F.lit("Part "), F.col("g").cast("string"), F.lit(".CSV")).alias("name"), F.md5(raw).alias("digest"), raw.alias("content")))
    cell = lambda i: F.get("cells", F.lit(i))
    return rows.select("table_name", "row", F.array_join("names", ",").alias("columns"), cell(0).cast("bigint").alias("key"), cell(1).alias("name"), cell(2).cast("double").alias("balance"), cell(3).alias("segment"))


QUERIES = {
    "csv_tables": (
        csv_tables,
        """SELECT 'part_' || (c_custkey // 100) AS table_name, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1 AS row, 'custkey,name,acctbal,name_2' AS columns, c_custkey AS key,
  c_name || ', "né"' || chr(10) || 'here' AS name, c_acctbal AS balance, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer""",
    ),
    "table_profile": (table_profile, None),
    "table_router": (
        table_router,
        f"""WITH t AS (SELECT n_nationkey, ([{', '.join(f"'{t}'" for t in TABLES)}])[n_nationkey % {len(TABLES)} + 1] AS t FROM nation) SELECT n_nationkey, t AS routed_to FROM t""",
    ),
    "nl_total_by": (nl_total_by, "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY o_orderstatus"),
    "nl_average_by": (nl_average_by, "SELECT c_mktsegment, round(avg(c_acctbal), 2) AS value FROM customer GROUP BY c_mktsegment"),
    "nl_share": (nl_share, "SELECT round(100.0 * count(*) FILTER (l_returnflag = 'R') / count(*), 2)::DOUBLE AS value FROM lineitem"),
    "nl_fixed": (nl_fixed, "SELECT c_nationkey AS nation, count(*) AS n, round(max(c_acctbal), 2) AS best FROM customer GROUP BY c_nationkey"),
    "nl_join": (
        nl_join,
        "SELECT r_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "nl_top": (nl_top, "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10"),
}


def _profile_sql() -> str:
    import_columns = {
        "region": "r_regionkey r_name",
        "nation": "n_nationkey n_name n_regionkey",
        "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
        "supplier": "s_suppkey s_name s_nationkey s_acctbal",
        "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
        "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
        "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    }
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}" for t, cols in import_columns.items() for c in cols.split())


QUERIES["table_profile"] = (table_profile, _profile_sql())
