"""A query for each operator over the tables of a folder, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.functions import values as V
from tabveil.operators import audit, distribution, profile, sampling, spans, strategies, uniqueness
from tabveil.sources import csvfile, documents, quick
from tabveil.sources.splits import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = "0" * 64
_seed = lambda: F.lit(SEED)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cells_sql(tables: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value FROM {t}" for t, cs in tables.items() for c in cs)


def _cells(spark: SparkSession, folder: str, tables: dict[str, list[str]]) -> DataFrame:
    parts = [distribution.long_form(dealt(table(spark, folder, t)), cs) for t, cs in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


STRINGS = {"customer": ["c_name", "c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_name", "p_brand"], "lineitem": ["l_returnflag", "l_linestatus"]}
_KEY = r"lower(regexp_replace(regexp_replace(value, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
_FULL = "value IS NOT NULL AND value <> '' AND lower(value) <> 'null'"
_STATS = f"""SELECT col, count(*) AS distinct_values, CAST(sum(n) AS BIGINT) AS total_values, count(*) FILTER (n = 1) AS singleton_values, count(*) FILTER (n = 2) AS doubleton_values, max(n) AS max_value_occurrences
FROM (SELECT col, {_KEY} AS key, count(*) AS n FROM ({_cells_sql(STRINGS)}) WHERE {_FULL} GROUP BY ALL) GROUP BY col"""
_CHAO = "CAST(distinct_values + CASE WHEN doubleton_values > 0 THEN (singleton_values * singleton_values) // (2 * doubleton_values) ELSE (singleton_values * greatest(singleton_values - 1, 0)) // 2 END AS BIGINT)"


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")))
def q_scan_counts(spark, folder):
    out = None
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        one = table(spark, folder, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n")
        out = one if out is None else out.union(one)
    return out


EDGE = ["", "null", "NULL", "  ", "Null ", "a", "=cmd", "  +SUM(1 1)", "\tx", "＝cmd", "-42.50", "+31", " -7 ", "-2+3", "-1.2.3", "@x", "+", "-.", "ok"]
_EDGE_SQL = "(SELECT unnest(['', 'null', 'NULL', '  ', 'Null ', 'a', '=cmd', '  +SUM(1 1)', chr(9) || 'x', '＝cmd', '-42.50', '+31', ' -7 ', '-2+3', '-1.2.3', '@x', '+', '-.', 'ok']) AS value)"


def _edge(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v,) for v in EDGE], "value string")


@query(f"""WITH c AS ({_cells_sql({"documents": ["lang", "source"], "customer": ["c_name"]})} UNION ALL SELECT 'edge', value FROM {_EDGE_SQL})
SELECT col, count(*) FILTER (value = '' OR lower(value) = 'null') AS empty_cells, CASE WHEN bool_or(value = '') AND bool_or(lower(value) = 'null') THEN 'mixed' WHEN bool_or(lower(value) = 'null') THEN 'null' ELSE 'emptyString' END AS empty_format FROM c GROUP BY col""")
def q_empty_profile(spark, folder):
    cells = _cells(spark, folder, {"documents": ["lang", "source"], "customer": ["c_name"]}).union(_edge(spark).select(F.lit("edge").alias("col"), "value"))
    empty, null = F.bool_or(F.col("value") == ""), F.bool_or(F.lower("value") == "null")
    return cells.groupBy("col").agg(F.count_if(V.is_empty(F.col("value"))).alias("empty_cells"), F.when(empty & null, "mixed").when(null, "null").otherwise("emptyString").alias("empty_format"))


@query(r"SELECT c_custkey, regexp_replace(c_name, '\S', '*', 'g') AS c_name, regexp_replace(c_mktsegment, '\S', '*', 'g') AS c_mktsegment FROM customer")
def q_mask(spark, folder):
    seed = _seed()
    return table(spark, folder, "customer").select("c_custkey", *[strategies.expression(F.col(c), "string", "mask", c, i, seed).alias(c) for i, c in enumerate(("c_name", "c_mktsegment"))])


@query("""SELECT o.o_orderkey, '[O_ORDERPRIORITY_' || n || ']' AS released FROM orders o JOIN (SELECT k, row_number() OVER (ORDER BY f) AS n FROM (SELECT lower(o_orderpriority) AS k, min(o_orderkey) AS f FROM orders GROUP BY 1)) ON lower(o.o_orderpriority) = k""")
def q_label(spark, folder):
    out = strategies.labels(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", strategies.column_label("o_orderpriority", 0), "released")
    return out.select("o_orderkey", "released")


@query("SELECT c_custkey, '[C_NAME]' AS c_name, '[C_MKTSEGMENT]' AS c_mktsegment FROM customer")
def q_redact(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", *[strategies.expression(F.col(c), "string", "redact", c, i, _seed()).alias(c) for i, c in enumerate(("c_name", "c_mktsegment"))])


@query(f"SELECT p_partkey, {_KEY.replace('value', 'p_name')} AS key FROM part")
def q_identity_key(spark, folder):
    return table(spark, folder, "part").select("p_partkey", V.identity_key(F.col("p_name")).alias("key"))


def _stats(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for t, cs in STRINGS.items():
        one = distribution.distribution(dealt(table(spark, folder, t)), cs)
        out = one if out is None else out.union(one)
    return out


@query(_STATS)
def q_value_distribution(spark, folder):
    return _stats(spark, folder)


@query(f"""SELECT col, estimated_distinct, CASE WHEN total_values < 50 THEN 'none' WHEN distinct_values < 10 THEN 'fewDistinctValues' WHEN 3 * max_value_occurrences >= total_values THEN 'dominantValue'
 WHEN 4 * (total_values - singleton_values) < 3 * total_values THEN 'none' WHEN 100 * estimated_distinct < 5 * greatest(total_values, 1) THEN 'largeGroups' ELSE 'none' END AS risk
 FROM (SELECT *, {_CHAO} AS estimated_distinct FROM ({_STATS}))""")
def q_inversion_risk(spark, folder):
    return distribution.with_risk(_stats(spark, folder)).select("col", "estimated_distinct", "risk")


@query(f"""SELECT col, CAST(CASE WHEN total_values = 0 THEN 0 WHEN total_values >= 1000000 THEN distinct_values ELSE least(1000000, {_CHAO} + (1000000 * singleton_values) // greatest(total_values, 1)) END AS BIGINT) AS projected_distinct FROM ({_STATS})""")
def q_projected_distinct(spark, folder):
    return distribution.projected_distinct(_stats(spark, folder), 1_000_000).select("col", "projected_distinct")


@query(f"""SELECT CAST(sum(p * CASE col WHEN 'c_name' THEN 3 WHEN 'p_name' THEN 1 ELSE 0 END) AS BIGINT) AS entries, sum(p * CASE col WHEN 'c_name' THEN 3 WHEN 'p_name' THEN 1 ELSE 0 END) >= 3000000 AS review FROM (
 SELECT col, CASE WHEN total_values = 0 THEN 0 WHEN total_values >= 2000000 THEN distinct_values ELSE least(2000000, {_CHAO} + (2000000 * singleton_values) // greatest(total_values, 1)) END AS p FROM ({_STATS}))""")
def q_mapping_projection(spark, folder):
    return distribution.mapping_projection(_stats(spark, folder), 2_000_000, {"c_name": "pseudonymize", "p_name": "label", "p_brand": "mask"})


_M64 = "18446744073709551616::UHUGEINT"
_SPLIT = f"""a AS (SELECT *, (o_orderkey::UHUGEINT + 11400714819323198485::UHUGEINT) % {_M64} AS x FROM orders),
 b AS (SELECT *, (xor(x, x // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {_M64} AS y FROM a),
 c AS (SELECT *, (xor(y, y // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {_M64} AS z FROM b)"""


@query(None)
def q_spread_sample(spark, folder):
    return sampling.spread(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 500)


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), w AS (SELECT unnest(range(200)) AS k) SELECT DISTINCT o_orderkey FROM p JOIN w ON i = (k * n) // 200""")
def q_even_sample(spark, folder):
    return sampling.even(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 200)


VOTED = {"customer": ["c_name", "c_custkey", "c_acctbal"], "orders": ["o_orderkey", "o_orderstatus"], "nation": ["n_name"], "part": ["p_brand", "p_name"], "pages": ["url"]}
_PRED = {"uuid": V.UUID, "ipAddress": V.IPV4, "macAddress": V.MAC, "numericId": r"\p{Nd}{4,}", "countryCode": "[A-Z]{2}", "percentage": V.PERCENTAGE, "numericValue": V.NUMERIC, "timestamp": V.TIMESTAMP, "currency": V.CURRENCY}
_VOTED_SQL = _cells_sql(VOTED)


@query(f"""SELECT col, count(*) AS non_empty, count(DISTINCT value) AS distinct_values, {", ".join(f"count(*) FILTER (regexp_full_match(value, '{b}')) AS is_{k}" for k, b in _PRED.items())},
 count(*) FILTER (lower(value) IN ('true', 'false', 'yes', 'no')) AS is_boolean, count(*) FILTER (regexp_full_match(value, '(?:(?i)https?://|www\\.)[^\\s/?#<>\\"^`{{|}}\\\\]+(?:[/?#]\\S*)?')) AS is_url FROM ({_VOTED_SQL}) WHERE {_FULL} GROUP BY col""".replace("\\\\.", "\\.").replace("\\\\s", "\\s").replace("\\\\S", "\\S"))
def q_type_votes(spark, folder):
    out = profile.votes(_cells(spark, folder, VOTED))
    return out.select("col", "non_empty", F.col("distinct").alias("distinct_values"), *[f"is_{k}" for k in _PRED], "is_boolean", "is_url")


@query(f"SELECT col, count(*) > 10 AND count(DISTINCT value) <= 20 AS is_enum FROM ({_cells_sql(STRINGS)}) WHERE {_FULL} GROUP BY col")
def q_enum_test(spark, folder):
    cells = _cells(spark, folder, STRINGS).where(~V.is_empty(F.col("value")))
    return cells.groupBy("col").agg(((F.count("*") > profile.ENUM_OVER) & (F.count_distinct("value") <= profile.ENUM_MOST)).alias("is_enum"))


_KEYS_SQL = """SELECT 'code' AS col, 'CUST-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS value FROM customer UNION ALL SELECT 'name', c_name FROM customer UNION ALL SELECT 'brand', p_brand FROM part UNION ALL SELECT 'house', CAST(c_custkey AS VARCHAR) || 'b' FROM customer"""


@query(f"""WITH k AS (SELECT col, length(value) AS l, regexp_matches(value, '[-_/]') AS s, lower(value) AS key FROM ({_KEYS_SQL}) WHERE regexp_full_match(value, '[A-Za-z0-9_/\\-]{{3,64}}') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
 s AS (SELECT col, sum(n) AS n, max(n) AS top FROM (SELECT col, l, s, count(*) AS n FROM k GROUP BY ALL) GROUP BY col), d AS (SELECT col, count(DISTINCT key) AS d FROM k GROUP BY col)
 SELECT col, CAST(n AS BIGINT) AS n, n >= 8 AND 4 * top >= 3 * n AND 4 * d >= 3 * n AS key_like FROM s JOIN d USING (col)""")
def q_key_likeness(spark, folder):
    c, p = table(spark, folder, "customer"), table(spark, folder, "part")
    code = F.concat(F.lit("CUST-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    cells = c.select(F.lit("code").alias("col"), code.alias("value")).union(c.select(F.lit("name"), "c_name")).union(p.select(F.lit("brand"), "p_brand")).union(c.select(F.lit("house"), F.concat(F.col("c_custkey").cast("string"), F.lit("b"))))
    return profile.key_likeness(cells)


_POSTAL_SQL = "SELECT 'plz' AS col, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS value FROM customer UNION ALL SELECT 'nl', lpad(CAST(c_custkey % 9000 + 1000 AS VARCHAR), 4, '0') || ' AB' FROM customer UNION ALL SELECT 'pl', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') FROM customer"


@query(f"SELECT col, country, count(*) AS n FROM (SELECT col, CASE {' '.join(f"WHEN regexp_full_match(value, '{b}') THEN '{c}'" for c, b, needs in V.POSTAL if not needs or c in ('DE', 'FR'))} END AS country FROM ({_POSTAL_SQL})) WHERE country IS NOT NULL GROUP BY ALL")
def q_postal_vote(spark, folder):
    k = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    c = table(spark, folder, "customer")
    cells = c.select(F.lit("plz").alias("col"), pad(k, 5).alias("value")).union(c.select(F.lit("nl"), F.concat(pad(k % 9000 + 1000, 4), F.lit(" AB")))).union(c.select(F.lit("pl"), F.concat(pad(k % 100, 2), F.lit("-"), pad(k % 1000, 3))))
    return profile.postal_votes(cells, ["DE", "FR"])


@query(f"""WITH c AS (SELECT 'lang' AS col, replace(upper(lang), 'EN', 'GB') AS value FROM documents UNION ALL SELECT 'source', source FROM documents)
 SELECT value AS code, count(*) AS n FROM c WHERE value IN ({", ".join(f"'{x}'" for x in V.COUNTRIES)}) AND col IN (SELECT col FROM c GROUP BY col HAVING 10 * count(*) FILTER (value IN ({", ".join(f"'{x}'" for x in V.COUNTRIES)})) >= 8 * count(*)) GROUP BY 1""")
def q_locale_vote(spark, folder):
    d = table(spark, folder, "documents")
    return profile.locale(d.select(F.lit("lang").alias("col"), F.replace(F.upper("lang"), F.lit("EN"), F.lit("GB")).alias("value")).union(d.select(F.lit("source"), "source")))


_SPAN_RE = {"email": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", "ip": rf"\b{V.IPV4}\b", "url": r"\b(?:https?://|www\.)[^\s<>]+"}


@query("SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{b}')) AS BIGINT) AS n_{k}" for k, b in _SPAN_RE.items()) + " FROM documents")
def q_span_counts(spark, folder):
    return dealt(table(spark, folder, "documents")).select("doc_id", *[F.regexp_count("text", F.lit(b)).cast("long").alias(f"n_{k}") for k, b in _SPAN_RE.items()])


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\b\d(?:[ -]?\d){12,18}\b')), '[^0-9]', '', 'g') AS d FROM documents),
 l AS (SELECT doc_id, d, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) ELSE CAST(d[i] AS INT) * 2 - CASE WHEN CAST(d[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS ok FROM r)
 SELECT doc_id, d AS digits, ok FROM l""")
def q_card_luhn(spark, folder):
    found = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b\d(?:[ -]?\d){12,18}\b"), F.lit(0))).alias("m"))
    return found.select("doc_id", V.digits(F.col("m")).alias("digits"), F.call_function("luhn_check", V.digits(F.col("m"))).alias("ok"))


@query(None)
def q_span_select(spark, folder):
    return spans.spans(dealt(table(spark, folder, "documents")), "doc_id", "text")


@query(None)
def q_evidence_summary(spark, folder):
    return spans.evidence(spans.spans(dealt(table(spark, folder, "documents")), "doc_id", "text"), "doc_id")


@query(r"""WITH c AS (SELECT value FROM """ + _EDGE_SQL + r""" UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents),
 f AS (SELECT value, NOT (regexp_matches(trim(value), '^[+-][0-9]*\.?[0-9]*$') AND length(trim(value)) > 1) AND regexp_matches(value, '^(?:[\t\r\n]|\s*[=+\-@＝＋－＠])') AS bad FROM c)
 SELECT CASE WHEN bad THEN '''' || value ELSE value END AS cell, bad, count(*) AS n FROM f GROUP BY ALL""")
def q_neutralize(spark, folder):
    cells = _edge(spark).union(dealt(table(spark, folder, "documents")).select(F.explode(F.split("text", "\n")).alias("value")))
    return cells.select(V.neutralized(F.col("value")).alias("cell"), V.could_be_formula(F.col("value")).alias("bad")).groupBy("cell", "bad").agg(F.count("*").alias("n"))


_MAIL = "'user' || c_custkey || '@' || CASE WHEN c_custkey % 3 = 0 THEN 'Example.com' ELSE 'mail.test' END"


@query(f"""WITH k AS (SELECT DISTINCT lower({_MAIL}) AS key FROM customer), h AS (SELECT key, sha256('{SEED}' || chr(1) || 'email' || chr(1) || key) AS h FROM k)
 SELECT key, 'user' || row_number() OVER (ORDER BY h) || '@' || string_split(key, '@')[-1] AS output FROM h""")
def q_email_pseudonym(spark, folder):
    mail = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@"), F.when(F.col("c_custkey") % 3 == 0, "Example.com").otherwise("mail.test"))
    return strategies.email_mapping(table(spark, folder, "customer").select(mail.alias("value")), _seed())


@query(f"SELECT c_custkey, 'tok_' || substr(sha256('{SEED}' || chr(1) || 'token' || chr(1) || '1' || chr(1) || 'c_name' || chr(1) || lower(c_name)), 1, 24) AS released FROM customer")
def q_token(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", strategies.expression(F.col("c_name"), "string", "tokenize", "c_name", 1, _seed()).alias("released"))


_TS = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"


@query(f"""WITH a AS (SELECT o_orderkey, {_TS} AS v FROM orders), b AS (SELECT *, sha256('{SEED}' || chr(1) || 'timestamp' || chr(1) || lower(v)) AS h FROM a),
 c AS (SELECT *, CAST(('0x' || substr(h, 1, 8))::BIGINT % 365 + 1 AS INT) AS d, ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 AS up FROM b)
 SELECT o_orderkey, strftime(CAST(substr(v, 1, 10) AS DATE) + CASE WHEN up THEN d ELSE -d END, '%Y-%m-%d') || substr(v, 11) AS released FROM c""")
def q_timestamp_shift(spark, folder):
    v = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return dealt(table(spark, folder, "orders")).select("o_orderkey", strategies.timestamp(v, _seed()).alias("released"))


@query(f"""WITH a AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS v FROM orders),
 b AS (SELECT *, regexp_extract(v, '^(0*)', 1) AS z, translate(sha256('{SEED}' || chr(1) || 'numericId' || chr(1) || v || chr(1) || '0') || sha256('{SEED}' || chr(1) || 'numericId' || chr(1) || v || chr(1) || '1'), 'abcdef', '012345') AS d FROM a),
 c AS (SELECT o_orderkey, v, CASE WHEN length(z) = 9 THEN v ELSE z || CAST(CAST(d[1] AS INT) % 9 + 1 AS VARCHAR) || substr(d, 2, 9 - length(z) - 1) END AS r FROM b)
 SELECT o_orderkey, CASE WHEN r = v THEN substr(r, 1, 8) || CASE WHEN r[9] = '9' THEN '1' ELSE CAST(CAST(r[9] AS INT) + 1 AS VARCHAR) END ELSE r END AS released FROM c""")
def q_numeric_shape(spark, folder):
    v = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    return dealt(table(spark, folder, "orders")).select("o_orderkey", strategies.numeric_id(v, _seed()).alias("released"))


@query(f"""WITH b AS (SELECT c_custkey, sha256('{SEED}' || chr(1) || 'uuid' || chr(1) || CAST(c_custkey AS VARCHAR)) AS h FROM customer)
 SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::BIGINT % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS released FROM b""")
def q_uuid_shape(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", strategies.uuid(F.col("c_custkey").cast("string"), _seed()).alias("released"))


@query(None)
def q_phone_shape(spark, folder):
    v = F.concat(F.lit("+31 ("), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(") 555-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"))
    return table(spark, folder, "customer").select("c_custkey", v.alias("source"), strategies.phone(v, _seed()).alias("released"))


@query(None)
def q_generic_shape(spark, folder):
    return table(spark, folder, "part").select("p_partkey", strategies.generic(F.col("p_name"), _seed()).alias("released"))


@query(None)
def q_name_mapping(spark, folder):
    return strategies.name_mapping(table(spark, folder, "part").select(F.col("p_name").alias("value")), _seed())


def _projected(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer's segment, as released: priority and status whole, date shifted, key masked, price redrawn."""
    o = dealt(table(spark, folder, "orders")).join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    price = F.floor("o_totalprice").cast("long").cast("string")
    p = uniqueness.projection
    return uniqueness.projected(o, {
        "segment": p(F.col("c_mktsegment"), "enum", "passThrough")[1], "priority": p(F.col("o_orderpriority"), "enum", "passThrough")[1], "status": p(F.col("o_orderstatus"), "enum", "auto")[1],
        "date": p(date, "timestamp", "pseudonymize")[1], "price": p(price, "numericValue", "pseudonymize")[1], "key": p(V.mask(F.col("o_orderkey").cast("string")), "numericId", "mask")[1],
    })


_PROJ = r"""p AS (SELECT c_mktsegment AS segment, o_orderpriority AS priority, o_orderstatus AS status, substr(strftime(o_orderdate, '%Y'), 1, 3) || '|' || strftime(o_orderdate, 'T%H:%M:%S') AS date,
 CAST(length(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)) AS VARCHAR) || ':' || CASE WHEN CAST(floor(o_totalprice) AS BIGINT) = 0 THEN '1' ELSE '0' END AS price, regexp_replace(CAST(o_orderkey AS VARCHAR), '\S', '*', 'g') AS key FROM orders JOIN customer ON o_custkey = c_custkey)"""
_COLS = ["segment", "priority", "status", "date", "price", "key"]


@query(f"""WITH {_PROJ}, s AS (SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM p GROUP BY {", ".join(_COLS)}) GROUP BY size), c AS (SELECT *, sum(size * n) OVER (ORDER BY size) AS upto, sum(size * n) OVER () AS total FROM s)
 SELECT CAST(sum(size * n) AS BIGINT) AS rows_measured, CAST(sum(n) AS BIGINT) AS distinct_classes, CAST(coalesce(sum(n) FILTER (size = 1), 0) AS BIGINT) AS unique_rows, min(size) AS smallest_class, min(size) FILTER (upto >= greatest(1, ceil(total / 20))) AS fifth_percentile_class_size FROM c""")
def q_row_uniqueness(spark, folder):
    return uniqueness.summary(_projected(spark, folder))


@query(f"""WITH {_PROJ}, g AS (SELECT grouping({", ".join(_COLS)}) AS g, count(*) AS size FROM p GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(c for c in _COLS if c != out) + ")" for out in _COLS)}))
 SELECT CASE g {" ".join(f"WHEN {1 << (len(_COLS) - 1 - k)} THEN '{c}'" for k, c in enumerate(_COLS))} END AS col, count(*) FILTER (size = 1) AS unique_rows_without FROM g GROUP BY 1""")
def q_leave_one_out(spark, folder):
    return uniqueness.leave_one_out(_projected(spark, folder))


@query(f"WITH {_PROJ}, s AS (SELECT count(*) AS size FROM p GROUP BY {', '.join(_COLS)}) SELECT size, count(*) AS n FROM s GROUP BY size")
def q_class_sizes(spark, folder):
    return uniqueness.classes(_projected(spark, folder))


@query(f"WITH {_PROJ} " + " UNION ALL ".join(f"SELECT '{c}' AS col, count(DISTINCT coalesce({c}, '')) > 1 AS matched, count({c}) = count(*) AS matched_every_row FROM p" for c in _COLS))
def q_matched_columns(spark, folder):
    return uniqueness.matched_columns(_projected(spark, folder))


_REL = r"SELECT c_name AS a, c_mktsegment AS b, CASE WHEN c_custkey % 2 = 0 THEN regexp_replace(c_name, '\S', '*', 'g') ELSE c_name END AS ra, c_mktsegment AS rb FROM customer"


def _released(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer")
    return c.select(F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"), F.when(F.col("c_custkey") % 2 == 0, V.mask(F.col("c_name"))).otherwise(F.col("c_name")).alias("ra"), F.col("c_mktsegment").alias("rb"))


@query(f"WITH r AS ({_REL}), s AS (SELECT DISTINCT a AS v FROM r), t AS (SELECT ra AS v FROM r UNION SELECT rb FROM r) SELECT (SELECT count(*) FROM s) AS protected_values, (SELECT count(*) FROM t) AS released_values, (SELECT count(*) FROM (SELECT v FROM s INTERSECT SELECT v FROM t)) AS overlap")
def q_residual_audit(spark, folder):
    return audit.residual(_released(spark, folder), ["a"], ["ra", "rb"])


@query(f"WITH r AS ({_REL}) SELECT 'a' AS col, count(*) FILTER (a = ra) AS unchanged FROM r UNION ALL SELECT 'b', count(*) FILTER (b = rb) FROM r")
def q_unchanged(spark, folder):
    return audit.unchanged(_released(spark, folder), {"a": ("a", "ra"), "b": ("b", "rb")})


@query("SELECT DISTINCT 'c_name' AS col, lower(c_name) AS key FROM customer WHERE lower(c_name) NOT IN (SELECT lower(c_name) FROM customer WHERE c_custkey % 3 = 0)")
def q_missing_values(spark, folder):
    p = table(spark, folder, "customer").select(F.lit("c_name").alias("col"), V.identity_key(F.col("c_name")).alias("key"), "c_custkey")
    return audit.missing(p, p.where("c_custkey % 3 = 0"))


@query("""WITH s AS (SELECT l_orderkey AS "row", l_linenumber AS col, CAST(l_quantity AS INT) AS a, CAST(l_quantity AS INT) + 5 AS b FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT l_orderkey AS "row", l_linenumber AS col, CAST(l_quantity AS INT) + l_linenumber AS a, CAST(l_quantity AS INT) + l_linenumber + 3 AS b FROM lineitem)
 SELECT "row", col, a AS "start", b AS "end" FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s."row" = c."row" AND s.col = c.col AND c.a < s.b AND s.a < c.b)""")
def q_overlap_antijoin(spark, folder):
    l, q = table(spark, folder, "lineitem"), F.col("l_quantity").cast("int")  # noqa: E741
    s = l.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), q.alias("start"), (q + 5).alias("end"))
    c = l.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), (q + F.col("l_linenumber")).alias("start"), (q + F.col("l_linenumber") + 3).alias("end"))
    return audit.without_overlap(c, s)


@query("SELECT event_id, 'json/k:k' AS path, 'k' AS label, json_extract_string(props, '$.k') AS value FROM events")
def q_json_flatten(spark, folder):
    return documents.flattened(dealt(table(spark, folder, "events")), "event_id", "props", "json").select("event_id", "path", "label", "value")


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '{_SPAN_RE['email']}', '[EMAIL]', 'g')) AS released FROM documents")
def q_text_splice(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(spans.spliced(F.col("text"), _SPAN_RE["email"], "[EMAIL]").cast("binary"), 256).alias("released"))


@query(None)
def q_html_spans(spark, folder):
    return spans.evidence(spans.spans(dealt(table(spark, folder, "pages")), "page_id", "html"), "page_id")


@query(None)
def q_xml_flatten(spark, folder):
    xml = F.format_string('<row id="%s"><name>%s</name><note><![CDATA[%s]]></note></row>', F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    return documents.flattened(table(spark, folder, "customer").select("c_custkey", xml.alias("doc")), "c_custkey", "doc", "xml")


@query(None)
def q_yaml_flatten(spark, folder):
    doc = F.format_string("name: %s\nrole: [a, b]\nkey: %s\n", "n_name", F.col("n_nationkey").cast("string"))
    return documents.flattened(table(spark, folder, "nation").select("n_nationkey", doc.alias("doc")), "n_nationkey", "doc", "yaml")


@query("SELECT c_custkey, c_name LIKE '%#%' AS x, regexp_full_match(c_mktsegment, '[A-Za-z][A-Za-z''.\\-]*(?:\\s+[A-Za-z][A-Za-z''.\\-]*)?') AND length(c_mktsegment) BETWEEN 2 AND 80 AS name_like FROM customer".replace("\\\\", "\\"))
def q_name_likeness(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.contains("c_name", F.lit("#")).alias("x"), V.is_name_part(F.col("c_mktsegment"), 2).alias("name_like"))


@query(None)
def q_iban_check(spark, folder):
    c = table(spark, folder, "customer")
    made = F.concat(F.lit("NL"), F.lpad((F.col("c_custkey") % 98).cast("string"), 2, "0"), F.lit("ABNA"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"))
    return c.select("c_custkey", made.alias("iban"), V.is_iban(made).alias("ok"))


@query(None)
def q_column_profiles(spark, folder):
    rows = []
    for t in ("customer", "orders", "nation", "part"):
        df = table(spark, folder, t)
        cells = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
        rows += [(t, p.header, p.kind, p.confidence, p.risk, p.strategy) for p in profile.profiled(cells)]
    return spark.createDataFrame(rows, "tbl string, col string, kind string, confidence string, risk string, strategy string")


@query(None)
def q_quick_generate(spark, folder):
    out = None
    for k in quick.TYPES:
        one = quick.generated(spark, k, 20, SEED).select(F.lit(k).alias("kind"), "i", "value")
        out = one if out is None else out.union(one)
    return out


@query("SELECT count(*) AS blank_rows FROM nation WHERE trim(n_name) = ''")
def q_blank_rows(spark, folder):
    return table(spark, folder, "nation").where(csvfile.is_blank_row(["n_name"])).agg(F.count("*").alias("blank_rows"))


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer as a table of strings of seven columns, in the order of o_orderkey."""
    o = dealt(table(spark, folder, "orders")).join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mail = F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@mail"), (F.col("c_custkey") % 7).cast("string"), F.lit(".test"))
    return o.select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("order_id"), "c_name", mail.alias("email"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), F.floor("o_totalprice").cast("string").alias("total"), "o_orderpriority", "c_mktsegment")


_WIDE_PLAN = {"order_id": ("numericId", "pseudonymize"), "c_name": ("string", "tokenize"), "email": ("email", "pseudonymize"), "ordered": ("timestamp", "pseudonymize"), "total": ("numericValue", "pseudonymize"), "o_orderpriority": ("enum", "passThrough"), "c_mktsegment": ("enum", "mask")}


def _plans() -> list:
    from tabveil.plans.service import ColumnPlan

    return [ColumnPlan(c, i, kind, "medium", how, how != "passThrough") for i, (c, (kind, how)) in enumerate(_WIDE_PLAN.items())]


@query(None)
def q_protected_release(spark, folder):
    """A table protected column by column, as the service does it."""
    from tabveil.plans import service

    return service.protected(_wide(spark, folder), _plans(), _seed(), "o_orderkey")


@query(None)
def q_release_report(spark, folder):
    """The report over a protected table, a row for each item of evidence."""
    from tabveil.plans import service

    source = _wide(spark, folder)
    plans = _plans()
    released = service.protected(source, plans, _seed(), "o_orderkey")
    out = service.report(plans, service.measured(source, released, plans, "o_orderkey"))
    return spark.createDataFrame([(e["id"], e["status"], e["detail"]) for e in out["evidence"]], "id string, status string, detail string")


@query(None)
def q_smart_replacements(spark, folder):
    from tabveil.operators import smart

    cells = table(spark, folder, "part").select(F.lit("p_name").alias("col"), F.col("p_name").alias("value"))
    return smart.generated(smart.wanted(cells), smart.EchoFree())


@query(None)
def q_balanced_cells(spark, folder):
    from tabveil.operators import smart

    c = table(spark, folder, "customer")
    cells = c.select(F.lit("c_name").alias("col"), F.col("c_custkey").alias("row"), F.col("c_name").alias("value")).union(c.select(F.lit("c_mktsegment"), "c_custkey", "c_mktsegment"))
    return smart.balanced(cells).select("col", "row", "value")


_CHECKED = """SELECT 'bsn' AS col, lpad(CAST(c_custkey * 7919 AS VARCHAR), 9, '0') AS value FROM customer UNION ALL SELECT 'lux', 'LU' || lpad(CAST(c_custkey * 7919 AS VARCHAR), 8, '0') FROM customer
 UNION ALL SELECT 'bank', 'NL' || lpad(CAST(c_custkey % 98 AS VARCHAR), 2, '0') || 'ABNA' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') FROM customer"""


@query(f"""WITH v AS ({_CHECKED}), k AS (SELECT *, col = 'bsn' AND CAST(value AS BIGINT) > 0 AND (list_sum(list_transform(range(1, 9), lambda i: (10 - i) * CAST(substr(value, i, 1) AS INT))) - CAST(substr(value, 9, 1) AS INT)) % 11 = 0 AS bsn FROM v WHERE col = 'bsn'),
 l AS (SELECT *, CAST(substr(value, 3, 6) AS INT) % 89 = CAST(substr(value, 9, 2) AS INT) AS lux FROM v WHERE col = 'lux'), m AS (SELECT *, CAST('10112310' || substr(value, 9) || '2321' || substr(value, 3, 2) AS HUGEINT) % 97 = 1 AS iban FROM v WHERE col = 'bank')
 SELECT 'bsn' AS col, CAST(0 AS BIGINT) AS ok_vat, CAST(0 AS BIGINT) AS ok_iban, count(*) FILTER (bsn) AS "ok_nationalId", CASE WHEN bool_or(bsn) THEN 'NL' END AS country FROM k
 UNION ALL SELECT 'lux', count(*) FILTER (lux), 0, 0, NULL FROM l UNION ALL SELECT 'bank', 0, count(*) FILTER (iban), 0, NULL FROM m""")
def q_checksum_votes(spark, folder):
    """Made-up personal numbers, tax numbers and bank accounts by their check digits."""
    c, pad = table(spark, folder, "customer"), lambda x, n: F.lpad(x.cast("string"), n, "0")
    made = {"bsn": pad(F.col("c_custkey") * 7919, 9), "lux": F.concat(F.lit("LU"), pad(F.col("c_custkey") * 7919, 8)), "bank": F.concat(F.lit("NL"), pad(F.col("c_custkey") % 98, 2), F.lit("ABNA"), pad(F.col("c_custkey"), 10))}
    return profile.checksum_votes(distribution.long_form(c.select(*[e.alias(k) for k, e in made.items()]), list(made)))


@query(None)
def q_documents_as_rows(spark, folder):
    fields = documents.flattened(dealt(table(spark, folder, "events")), "event_id", "props", "json")
    return documents.as_rows(fields, "event_id")


@query(None)
def q_text_rewrite(spark, folder):
    """Documents with the spans of their text replaced by markers, by joining released values back to their document."""
    docs = dealt(table(spark, folder, "documents")).where("text is not null")
    fields = documents.flattened(docs, "doc_id", "text", "text")
    released = fields.select("doc_id", "path", "value", F.concat(F.lit("["), F.upper("label"), F.lit("]")).alias("output")).distinct()
    return documents.rewritten(docs, "doc_id", "text", "text", released).select("doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("released"))


@query(None)
def q_stateful_stream(spark, folder):
    """Events through a stream in which a user keeps one pseudonym over all micro-batches."""
    import tempfile
    import uuid

    from tabveil.streaming import pseudonyms

    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    at = f"{base}/stream-{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"))
    events.write.parquet(f"{at}/in")
    source = spark.readStream.schema("event_id long, user_id string").parquet(f"{at}/in")
    pseudonyms.run(source, "user_id", f"{at}/map", f"{at}/out", f"{at}/check", SEED).awaitTermination()
    return spark.read.schema("event_id long, user_id string, batch long").parquet(f"{at}/out").select("event_id", "user_id")


def _digits_sql(domain: str, v: str) -> str:
    h = lambda n: f"sha256('{SEED}' || chr(1) || '{domain}' || chr(1) || {v} || chr(1) || '{n}')"
    return f"translate({h(0)} || {h(1)}, 'abcdef', '012345')"


_NEXT = "CASE WHEN right(r, 1) = '9' THEN '1' ELSE CAST(CAST(right(r, 1) AS INT) + 1 AS VARCHAR) END"
SQL["q_phone_shape"] = f"""WITH a AS (SELECT c_custkey, '+31 (' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || ') 555-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS v FROM customer), b AS (SELECT *, {_digits_sql("phone", "v")} AS d FROM a),
 c AS (SELECT c_custkey, v, array_to_string(list_transform(string_split(v, ''), lambda c, i: CASE WHEN regexp_matches(c, '[0-9]') THEN d[(i - 1) % 128 + 1] ELSE c END), '') AS r FROM b)
 SELECT c_custkey, v AS source, CASE WHEN r = v THEN left(r, length(r) - 1) || {_NEXT} ELSE r END AS released FROM c"""
SQL["q_iban_check"] = """WITH a AS (SELECT c_custkey, lpad(CAST(c_custkey % 98 AS VARCHAR), 2, '0') AS c, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS n FROM customer) SELECT c_custkey, 'NL' || c || 'ABNA' || n AS iban, CAST('10112310' || n || '2321' || c AS HUGEINT) % 97 = 1 AS ok FROM a"""
SQL["q_protected_release"] = f"""WITH w AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_id, c_name, 'user' || c_custkey || '@mail' || (c_custkey % 7) || '.test' AS email, strftime(o_orderdate, '%Y-%m-%d') AS ordered, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS total, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
 m AS (SELECT email, 'user' || row_number() OVER (ORDER BY sha256('{SEED}' || chr(1) || 'email' || chr(1) || email)) || '@' || string_split(email, '@')[2] AS output FROM (SELECT DISTINCT email FROM w)),
 d AS (SELECT *, regexp_extract(order_id, '^(0*)', 1) AS z, {_digits_sql("numericId", "order_id")} AS di, {_digits_sql("numericValue", "total")} AS dv, sha256('{SEED}' || chr(1) || 'timestamp' || chr(1) || ordered) AS h FROM w),
 r AS (SELECT *, CASE WHEN length(z) = 9 THEN order_id ELSE z || CAST(CAST(di[1] AS INT) % 9 + 1 AS VARCHAR) || substr(di, 2, 8 - length(z)) END AS ri, CAST(CAST(dv[1] AS INT) % 9 + 1 AS VARCHAR) || substr(dv, 2, length(total) - 1) AS rv, CAST(('0x' || substr(h, 1, 8))::BIGINT % 365 + 1 AS INT) * CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS days FROM d)
 SELECT o_orderkey, CASE WHEN ri = order_id THEN left(ri, 8) || {_NEXT.replace("right(r,", "right(ri,")} ELSE ri END AS order_id, 'tok_' || substr(sha256('{SEED}' || chr(1) || 'token' || chr(1) || '1' || chr(1) || 'c_name' || chr(1) || lower(c_name)), 1, 24) AS c_name, output AS email,
 strftime(CAST(ordered AS DATE) + days, '%Y-%m-%d') AS ordered, CASE WHEN rv = total THEN left(rv, length(rv) - 1) || {_NEXT.replace("right(r,", "right(rv,")} ELSE rv END AS total, o_orderpriority, regexp_replace(c_mktsegment, '\\S', '*', 'g') AS c_mktsegment FROM r JOIN m USING (email)"""
SQL["q_xml_flatten"] = " UNION ALL ".join(f"SELECT c_custkey, '{path}' AS path, '{label}' AS label, CAST(0 AS BIGINT) AS ord, CAST({v} AS VARCHAR) AS value, 'string' AS kind FROM customer" for path, label, v in (("xml/e:row/@:id", "row.@id", "c_custkey"), ("xml/e:row/e:name/text", "row.name", "c_name"), ("xml/e:row/e:note/text", "row.note", "c_mktsegment")))
SQL["q_yaml_flatten"] = " UNION ALL ".join(f"SELECT n_nationkey, '{path}' AS path, '{label}' AS label, CAST({n} AS BIGINT) AS ord, CAST({v} AS VARCHAR) AS value, '{kind}' AS kind FROM nation" for path, label, n, v, kind in (("yaml/k:name", "name", 0, "n_name", "string"), ("yaml/k:role/a", "role[]", 0, "'a'", "string"), ("yaml/k:role/a", "role[]", 1, "'b'", "string"), ("yaml/k:key", "key", 0, "n_nationkey", "number")))
SQL["q_smart_replacements"] = """SELECT 'p_name' AS col, value, 'stand-in ' || substr(sha256('p_name' || chr(0) || value), 1, 12) AS output, CAST(NULL AS VARCHAR) AS reason FROM (SELECT min(p_name) AS value FROM part GROUP BY lower(p_name) ORDER BY 1 LIMIT 200)"""
SQL["q_name_mapping"] = f"""WITH k AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS key FROM part), r AS (SELECT key, row_number() OVER (ORDER BY sha256('{SEED}' || chr(1) || 'firstName' || chr(1) || key)) AS n FROM k WHERE key <> '')
 SELECT key, {strategies.FIRST!r}[(n - 1) % {len(strategies.FIRST)} + 1] AS output FROM r WHERE n <= {len(strategies.FIRST)}"""
SQL["q_generic_shape"] = f"""WITH a AS (SELECT p_partkey, p_name AS v, sha256('{SEED}' || chr(1) || 'generic' || chr(1) || lower(p_name)) AS h FROM part), b AS (SELECT *, CAST(greatest(1, floor(strlen(v) * (80 + ('0x' || substr(h, 1, 6))::BIGINT % 41) / 100)) AS INT) AS w FROM a),
 c AS (SELECT *, list_transform(range(1, greatest(1, CAST(ceil(w / 32) AS INT)) + 1), lambda k: sha256(h || k)) AS xs FROM b),
 d AS (SELECT p_partkey, v, left(array_to_string(list_transform(xs, lambda x: array_to_string(list_transform(range(1, 33), lambda i: substr('{strategies.ALPHABET}', CAST(('0x' || substr(x, 2 * i - 1, 2))::BIGINT % 64 + 1 AS BIGINT), 1)), '')), ''), w) AS o FROM c)
 SELECT p_partkey, CASE WHEN lower(o) = lower(v) THEN o || 'x' ELSE o END AS released FROM d"""
SQL["q_balanced_cells"] = """WITH c AS (SELECT 'c_name' AS col, c_custkey AS "row", c_name AS value FROM customer UNION ALL SELECT 'c_mktsegment', c_custkey, c_mktsegment FROM customer),
 t AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY sha256(col || '|' || "row")) AS turn FROM c) SELECT col, "row", value FROM t ORDER BY turn, sha256(col) LIMIT 320"""
SQL["q_stateful_stream"] = f"""WITH k AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS u FROM events), n AS (SELECT u, row_number() OVER (ORDER BY sha256('{SEED}' || chr(1) || 'stream' || chr(1) || u)) AS n FROM k)
 SELECT event_id, 'user' || n AS user_id FROM events JOIN n ON CAST(user_id AS VARCHAR) = u"""
SQL["q_documents_as_rows"] = """SELECT event_id, CAST(0 AS BIGINT) AS ord, json_extract_string(props, '$.k') AS "json/k:k" FROM events"""
SQL["q_spread_sample"] = f"WITH {_SPLIT} SELECT o_orderkey, o_orderstatus FROM c ORDER BY xor(z, z // 2147483648::UHUGEINT) LIMIT 500"
