"""Queries by name, each with the DuckDB SQL that gives the same rows (or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridseek.functions import text as T
from gridseek.functions import udf as U
from gridseek.operators import examples as E
from gridseek.operators import gold as G
from gridseek.operators import metrics as M
from gridseek.operators import profile as P
from gridseek.operators import ranking as R
from gridseek.operators import retrieval as V
from gridseek.operators import sqlgen as Q
from gridseek.operators import triples as X
from gridseek.operators import words as W
from gridseek.scratch import new_folder
from gridseek.sources import sinks as K
from gridseek.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- inputs ---------------------------------------------------------------------------------------


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def customer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each nation, all of one title."""
    money = F.col("c_acctbal").cast("decimal(15,2)").cast("string")
    nation = F.col("c_nationkey").cast("string")
    columns = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "balance": money, "nation": F.concat(F.lit("Nation "), nation)}
    return S.from_dataframe(load(spark, sf_dir, "customer"), F.concat(F.lit("customer-"), nation), F.lit("customer accounts"), ["c_custkey"], columns)


def part_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each brand; five share a title."""
    columns = {"name": F.col("p_name"), "type": F.col("p_type"), "size": F.col("p_size").cast("string"), "price": F.col("p_retailprice").cast("decimal(15,2)").cast("string")}
    return S.from_dataframe(load(spark, sf_dir, "part"), F.concat(F.lit("part-"), "p_brand"), F.concat(F.lit("Parts "), F.substring("p_brand", 1, 7)), ["p_partkey"], columns)


def all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_tables(spark, sf_dir).union(part_tables(spark, sf_dir))


CUST = """cust AS (SELECT 'customer-' || c_nationkey AS table_id, 'customer accounts' AS title, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS row,
  ['name', 'segment', 'balance', 'nation'] AS names, [c_name, c_mktsegment, c_acctbal::DECIMAL(15,2)::VARCHAR, 'Nation ' || c_nationkey] AS vals FROM customer)"""
ROWS = f"""{CUST}, prt AS (SELECT 'part-' || p_brand AS table_id, 'Parts ' || substr(p_brand, 1, 7) AS title, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS row,
  ['name', 'type', 'size', 'price'] AS names, [p_name, p_type, p_size::VARCHAR, p_retailprice::DECIMAL(15,2)::VARCHAR] AS vals FROM part),
  trows AS (SELECT * FROM cust UNION ALL SELECT * FROM prt)"""
CELLS = f"{ROWS}, cells AS (SELECT table_id, title, row, (c - 1)::INT AS col, names[c] AS col_name, vals[c] AS value FROM trows, unnest(range(1, 5)) AS t(c))"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def sql_wrap(x: str) -> str:
    return f"CASE WHEN len({sql_words(x)}) > 1 THEN '\" ' || trim({x}) || ' \"' ELSE trim({x}) END"


def sql_size(x: str) -> str:
    return f"len(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'))"


def sql_normal(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return f"array_to_string(list_filter({sql_words(bare)}, lambda w: w NOT IN ('a', 'an', 'the')), ' ')"


WRAPPED = f"{ROWS}, w AS (SELECT table_id, row, {sql_wrap('title')} AS title, list_transform(names, lambda x: {sql_wrap('x')}) AS names, list_transform(vals, lambda x: {sql_wrap('x')}) AS vals FROM trows)"
PAIRS = "pairs AS (SELECT NULL::INT AS s, o::INT AS o FROM range(0, 4) AS a(o) UNION ALL SELECT s::INT, o::INT FROM range(0, 4) AS a(s), range(0, 4) AS b(o) WHERE s < o)"
SUBJECT = "trim(coalesce(names[s + 1], '') || '  ' || coalesce(vals[s + 1], ''))"
ANNOTATED = f"title || ' , ' || {SUBJECT} || ' , ' || trim(names[o + 1] || '  ' || vals[o + 1]) || ' ; '"
TAGGED = "'[_T_] ' || title || ' [_SC_] ' || coalesce(names[s + 1], '') || ' [_S_] ' || coalesce(vals[s + 1], '') || ' [_OC_] ' || names[o + 1] || ' [_O_] ' || vals[o + 1]"
UNTAGGED = "title || ' , ' || CASE WHEN s IS NULL THEN '' ELSE names[s + 1] || ' , ' || vals[s + 1] || ' , ' END || names[o + 1] || ' , ' || vals[o + 1] || ' . '"


def triples_sql(text: str, where: str = "true") -> str:
    return f"WITH {WRAPPED}, {PAIRS} SELECT table_id, row, coalesce(s, -1) AS sub_col, o AS obj_col, {text} AS passage FROM w, pairs WHERE {where}"


def titled(df: DataFrame) -> DataFrame:
    """-1 for the title as subject, where a result is compared."""
    return df.withColumn("sub_col", F.coalesce("sub_col", F.lit(-1)))


# ---- ingest ---------------------------------------------------------------------------------------


@query(f"WITH {CELLS} SELECT * FROM cells")
def cells_long(spark, sf_dir):
    return S.cells(all_tables(spark, sf_dir))


@query(f"WITH {ROWS} SELECT table_id, title, row, array_to_string(names, '|') AS names, array_to_string(vals, '|') AS vals FROM trows")
def cells_roundtrip_pivot(spark, sf_dir):
    back = S.rows_of_cells(S.cells(all_tables(spark, sf_dir)))
    return back.select("table_id", "title", "row", F.array_join("names", "|").alias("names"), F.array_join("vals", "|").alias("vals"))


@query(f"WITH {ROWS} SELECT table_id, any_value(title) AS title, count(*) AS n_rows, max(len(names))::INT AS n_cols FROM trows GROUP BY table_id")
def table_catalog(spark, sf_dir):
    return all_tables(spark, sf_dir).groupBy("table_id").agg(F.first("title").alias("title"), F.count("*").alias("n_rows"), F.max(F.size("names")).alias("n_cols"))


@query(f"WITH {ROWS} SELECT table_id, row, vals[1] AS first FROM trows WHERE table_id IN (SELECT 'customer-' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def table_filter_semi(spark, sf_dir):
    wanted = load(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("customer-"), F.col("n_nationkey").cast("string")).alias("table_id"))
    return all_tables(spark, sf_dir).join(wanted, "table_id", "left_semi").select("table_id", "row", F.col("vals")[0].alias("first"))


@query(f"WITH {ROWS} SELECT table_id, (row // 20)::INT AS chunk, count(*) AS n, min(row) AS offset_row FROM trows GROUP BY ALL")
def row_chunks(spark, sf_dir):
    return S.row_chunks(all_tables(spark, sf_dir), 20).groupBy("table_id", "chunk").agg(F.count("*").alias("n"), F.min("row").alias("offset_row"))


_NAME = "CASE WHEN n_nationkey % 3 = 0 THEN n_name || '_SEP_' || n_nationkey ELSE n_name END"


@query(
    f"""WITH f AS (SELECT {_NAME} AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'M' || n_nationkey END AS m_id, CASE WHEN n_nationkey % 5 = 0 THEN 'title of ' || n_name END AS m_title FROM nation)
    SELECT name, coalesce(m_id, CASE WHEN name LIKE '%\\_SEP\\_%' ESCAPE '\\' THEN split_part(name, '_SEP_', 2) ELSE name || '_' || sha256(name) END) AS table_id,
    coalesce(m_title, CASE WHEN name LIKE '%\\_SEP\\_%' ESCAPE '\\' THEN split_part(name, '_SEP_', 1) ELSE name END) AS title FROM f"""
)
def title_id_resolve(spark, sf_dir):
    files = load(spark, sf_dir, "nation").selectExpr(f"{_NAME} AS name", "CASE WHEN n_nationkey % 5 = 0 THEN concat('M', n_nationkey) END AS m_id", "CASE WHEN n_nationkey % 5 = 0 THEN concat('title of ', n_name) END AS m_title")
    table_id, title = S.resolve_title(F.col("name"), F.col("m_title"), F.col("m_id"))
    return files.select("name", table_id.alias("table_id"), title.alias("title"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def json_props_parse(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


# ---- text -----------------------------------------------------------------------------------------


@query(f"WITH {CELLS} SELECT table_id, row, col, {sql_wrap('value')} AS wrapped FROM cells")
def quote_wrap(spark, sf_dir):
    return S.cells(all_tables(spark, sf_dir)).select("table_id", "row", "col", T.quote_wrap(F.col("value")).alias("wrapped"))


@query(triples_sql(TAGGED))
def tagged_text(spark, sf_dir):
    return titled(X.relation_triples(all_tables(spark, sf_dir), style="tagged"))


@query(triples_sql(UNTAGGED))
def untagged_text(spark, sf_dir):
    return titled(X.relation_triples(all_tables(spark, sf_dir), style="untagged"))


_ROW_TEXT = "title || array_to_string(list_transform(range(1, len(names) + 1), lambda i: ' , ' || names[i] || ' ' || vals[i]), '')"


@query(f"WITH {ROWS} SELECT table_id, row, '[T] ' || title || ' [CH] ' || names[3] || ' [C] ' || vals[3] || ' [CH] ' || names[1] || ' [C] ' || vals[1] AS passage FROM trows")
def slide_tag(spark, sf_dir):
    picked = F.array(F.lit(2), F.lit(0))
    return all_tables(spark, sf_dir).select("table_id", "row", T.slide_tag(F.col("title"), F.col("names"), F.col("vals"), picked).alias("passage"))


@query(f"SELECT item_id, {sql_normal('text')} AS normal FROM benchmark")
def answer_normalize(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", T.answer_normal(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, lower(array_to_string({sql_words("regexp_replace(text, '([^\\p{L}\\p{N}_])', ' \\1 ', 'g')")}, ' ')) AS normal FROM documents")
def eval_normalize(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.eval_normal(F.col("text")).alias("normal"))


@query("SELECT conv_id, turn, CASE WHEN list_has_any(string_split(lower(text), ' '), ['what', 'when', 'how']) THEN text ELSE text || ' is about what ?' END AS question FROM conversations WHERE role = 'user'")
def question_rewrite(spark, sf_dir):
    return load(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.question_rewrite(F.col("text")).alias("question"))


@query(f"SELECT doc_id, {sql_size('text')}::INT AS size FROM documents")
def token_size(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.token_size(F.col("text")).alias("size"))


@query(f"SELECT doc_id, array_to_string(({sql_words('text')})[:20], ' ') AS head FROM documents")
def truncate_tokens(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.truncate_words(F.col("text"), 20).alias("head"))


@query(
    """WITH n AS (SELECT p_partkey, replace(initcap_words, ' ', '') || '_' || upper(p_brand) AS name FROM (SELECT p_partkey, p_brand, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS initcap_words FROM part))
    SELECT p_partkey, name, array_to_string(string_split(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_'), '|') AS parts FROM n"""
)
def camel_split(spark, sf_dir):
    camel = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), "")
    named = load(spark, sf_dir, "part").select("p_partkey", F.concat(camel, F.lit("_"), F.upper("p_brand")).alias("name"))
    return named.select("p_partkey", "name", F.array_join(T.camel_split(F.col("name")), "|").alias("parts"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9]),([0-9])', '\\1\\2', 'g'), ',', ' , ', 'g') AS spaced FROM documents")
def comma_spacing(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.comma_spacing(F.col("text")).alias("spaced"))


@query("WITH t AS (SELECT doc_id, regexp_extract_all(text, '([\\p{L}\\p{N}\\p{M}]+)|([^\\p{Z}\\p{C}])') AS t FROM documents) SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM t")
def unicode_tokens(spark, sf_dir):
    t = T.simple_tokens(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


# ---- generators -----------------------------------------------------------------------------------


@query(triples_sql(ANNOTATED))
def relation_triples(spark, sf_dir):
    return titled(X.relation_triples(all_tables(spark, sf_dir)))


@query(triples_sql(ANNOTATED, "s IS NOT NULL"))
def triples_no_title(spark, sf_dir):
    return X.relation_triples(all_tables(spark, sf_dir), with_title=False)


@query(f"WITH {WRAPPED}, {PAIRS} SELECT table_id, row, coalesce(s, -1) AS sub_col, o AS obj_col, row_number() OVER (ORDER BY table_id, row, s NULLS FIRST, o) AS p_id FROM w, pairs")
def triple_ids(spark, sf_dir):
    return titled(X.with_passage_ids(X.relation_triples(all_tables(spark, sf_dir)).drop("passage")))


def _tuples_sql(title: bool) -> str:
    about = "SELECT table_id, row, 0 AS part, o AS k1, 0 AS k2, '<H> ' || trim(title) || ' <R> ' || trim(names[o + 1]) || ' <T> ' || trim(vals[o + 1]) || ' ' AS t FROM trows, range(0, 4) AS b(o) WHERE trim(names[o + 1]) <> '' AND trim(vals[o + 1]) <> '' UNION ALL " if title else ""
    inner = "SELECT table_id, row, 1, s, o, '<H> ' || trim(names[s + 1]) || ' ' || trim(vals[s + 1]) || ' <R> ' || CASE WHEN trim(names[o + 1]) = '' THEN ',' ELSE trim(names[o + 1]) END || ' <T> ' || trim(vals[o + 1]) || ' ' FROM trows, range(0, 4) AS a(s), range(0, 4) AS b(o) WHERE s < o AND trim(vals[s + 1]) <> '' AND trim(vals[o + 1]) <> ''"
    return f"""WITH {ROWS}, t(table_id, row, part, k1, k2, t) AS ({about}{inner}), u AS (SELECT *, row_number() OVER (PARTITION BY table_id, row, part, lower(t) ORDER BY k1, k2) AS first FROM t)
        SELECT table_id, row, string_agg(t, '|' ORDER BY part, k1, k2) AS tuples FROM u WHERE first = 1 GROUP BY table_id, row"""


@query(_tuples_sql(True))
def complete_graph_tuples(spark, sf_dir):
    return X.complete_graph(all_tables(spark, sf_dir)).select("table_id", "row", F.array_join("tuples", "|").alias("tuples"))


@query(_tuples_sql(False))
def graph_no_caption(spark, sf_dir):
    return X.complete_graph(all_tables(spark, sf_dir), with_title=False).select("table_id", "row", F.array_join("tuples", "|").alias("tuples"))


@query(
    _tuples_sql(True).replace("WITH cust AS", "WITH RECURSIVE cust AS", 1).replace("SELECT table_id, row, string_agg", ", tp AS (SELECT table_id, row, string_agg", 1)
    + """), c AS (SELECT table_id, row, tuples, list_transform(tuples, lambda t: len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> ''))) AS n FROM (SELECT table_id, row, string_split(tuples, '|') AS tuples FROM tp)),
  w AS (SELECT table_id, row, 0 AS nth, 0 AS a, len(list_filter(range(1, len(n) + 1), lambda e: list_sum(n[1:e]) <= 60)) AS b FROM c
  UNION ALL SELECT table_id, row, nth + 1, s, s + len(list_filter(range(s + 1, len(n) + 1), lambda e: list_sum(n[s + 1:e]) <= 60)) FROM (SELECT w.*, n, greatest(a + 1, least(a + 2, b - 1)) AS s FROM w JOIN c USING (table_id, row) WHERE b < len(n)))
  SELECT table_id, row, nth::INT AS nth, coalesce(array_to_string(tuples[a + 1:b], ''), '') AS passage FROM w JOIN c USING (table_id, row)"""
)
def graph_packing(spark, sf_dir):
    return X.graph_passages(X.complete_graph(all_tables(spark, sf_dir)), budget=60)


@query(
    f"""WITH RECURSIVE {ROWS}, t AS (SELECT table_id, row, title, list_transform(range(1, 5), lambda i: names[i] || '  ' || trim(vals[i]) || '  ,  ') AS x FROM trows),
    c AS (SELECT *, list_transform(x, lambda v: {sql_size('v')}) AS n FROM t),
    w AS (SELECT table_id, row, 0 AS i, 0 AS a, NULL::INT AS f, NULL::INT AS e FROM c
    UNION ALL SELECT table_id, row, i + 1, CASE WHEN NOT out THEN a WHEN coalesce(list_sum(n[a + 2:i]), 0) > 12 THEN i ELSE a + 1 END::INT, CASE WHEN out THEN a END, CASE WHEN out THEN i END
      FROM (SELECT w.*, n, a < i AND coalesce(list_sum(n[a + 1:i]), 0) > 0 AND coalesce(list_sum(n[a + 1:i]), 0) + n[i + 1] > 12 AS out FROM w JOIN c USING (table_id, row) WHERE i < len(n))),
    o AS (SELECT table_id, row, f, e FROM w WHERE f IS NOT NULL UNION ALL SELECT table_id, row, a, i FROM w JOIN c USING (table_id, row) WHERE i = len(n))
    SELECT table_id, row, array_to_string(range(f, e), ',') AS cols, title || '  .  ' || array_to_string(x[f + 1:e], ' ') AS passage FROM o JOIN c USING (table_id, row)"""
)
def sliding_passages(spark, sf_dir):
    return X.sliding_passages(all_tables(spark, sf_dir), budget=12).withColumn("cols", F.array_join("cols", ","))


@query(f"WITH {ROWS} SELECT table_id, row, {_ROW_TEXT} AS passage, row_number() OVER (ORDER BY table_id, row) - 1 AS p_id FROM trows")
def row_passages(spark, sf_dir):
    return X.row_passages(all_tables(spark, sf_dir))


@query(
    f"""WITH {ROWS}, p AS (SELECT s::INT AS s, o::INT AS o FROM range(0, 4) AS a(s), range(0, 4) AS b(o) WHERE s < o),
    c AS (SELECT table_id, s AS sub_col, o AS obj_col, row, vals[s + 1] AS sub, vals[o + 1] AS obj, md5('0/' || table_id || '/' || s || '/' || o || '/' || row) AS k FROM trows, p
      WHERE vals[s + 1] <> '' AND vals[o + 1] <> '' AND {sql_size('vals[s + 1]')} <= 20 AND {sql_size('vals[o + 1]')} <= 20 AND {sql_size('names[o + 1]')} <= 10 AND (names[o + 1] <> '' OR vals[s + 1] <> vals[o + 1]))
    SELECT table_id, sub_col, obj_col, row, sub, obj FROM c QUALIFY row_number() OVER (PARTITION BY table_id, sub_col, obj_col ORDER BY k) = 1"""
)
def template_sample(spark, sf_dir):
    return X.template_sample(all_tables(spark, sf_dir))


@query(
    f"""WITH {ROWS} SELECT table_id, row, names[s + 1] || ' ' || vals[s + 1] || ' is ' || names[o + 1] || ' who or what ?' AS question, vals[o + 1] AS answer
    FROM trows, range(0, 3) AS a(s), range(0, 4) AS b(o) WHERE s < o AND vals[s + 1] <> '' AND vals[o + 1] <> ''"""
)
def row_questions(spark, sf_dir):
    return X.row_questions(all_tables(spark, sf_dir))


# ---- profiles and queries over one table ------------------------------------------------------------


def _columns(rows: DataFrame) -> DataFrame:
    head = rows.groupBy("table_id").agg(F.first("names").alias("names"))
    return head.select("table_id", F.posexplode("names").alias("col", "col_name"))


_FLOAT = "regexp_full_match(value, '-?[0-9]+\\.[0-9]+')"


@query(f"WITH {CELLS} SELECT table_id, col, col_name, CASE WHEN bool_and({_FLOAT}) THEN 'float' ELSE 'text' END AS type FROM cells GROUP BY ALL")
def column_type_infer(spark, sf_dir):
    rows = all_tables(spark, sf_dir)
    return P.column_types(_columns(rows), S.cells(rows))


@query(f"WITH {CELLS}, s AS (SELECT {sql_size('value')} AS size FROM cells) SELECT 1.0::DOUBLE AS lo, quantile_cont(size, 0.75) + 1.5 * (quantile_cont(size, 0.75) - quantile_cont(size, 0.25)) AS hi FROM s")
def outlier_bounds(spark, sf_dir):
    return P.fences(S.cells(all_tables(spark, sf_dir)).select(T.token_size(F.col("value")).alias("size")))


@query(f"WITH {CELLS} SELECT DISTINCT table_id, col, col_name FROM cells WHERE col_name <> '' AND {sql_size('col_name')} <= 20")
def good_columns(spark, sf_dir):
    return P.good_columns(_columns(all_tables(spark, sf_dir)))


@query(
    f"WITH s AS (SELECT {sql_size('text')}::INT AS size FROM documents) SELECT min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS mean_size, "
    + ", ".join(f"round(quantile_cont(size, {i / 10}), 6) AS p{10 * i}" for i in range(1, 11))
    + " FROM s"
)
def token_len_percentiles(spark, sf_dir):
    return P.length_distribution(load(spark, sf_dir, "documents").select(T.token_size(F.col("text")).alias("size")))


@query(f"WITH {ROWS}, t AS (SELECT DISTINCT table_id FROM trows), r AS (SELECT table_id, row_number() OVER (ORDER BY md5('split/' || table_id), table_id) AS k, count(*) OVER () AS n FROM t) SELECT table_id, CASE WHEN k <= floor(n * 0.2) THEN 'dev' ELSE 'train' END AS part FROM r")
def train_dev_split(spark, sf_dir):
    return P.train_dev_split(all_tables(spark, sf_dir).select("table_id").distinct())


def typed_columns(rows: DataFrame) -> DataFrame:
    return P.column_types(P.good_columns(_columns(rows)), S.cells(rows))


def _drawn(what: str) -> str:
    """As sqlgen's: a number below 2^40 for a named choice of draw i."""
    return f"('0x' || substr(md5('sql/{what}/' || i), 1, 10))::BIGINT"


_KINDS = f"{CELLS}, kinds AS (SELECT table_id, col, any_value(title) AS title, CASE WHEN bool_and(regexp_full_match(value, '-?[0-9]+\\.[0-9]+')) THEN 'float' ELSE 'text' END AS type, any_value(col_name) AS name FROM cells GROUP BY table_id, col)"


@query(
    f"""WITH {_KINDS}, tabs AS (SELECT table_id, any_value(title) AS title, list(col ORDER BY col) AS cols, list(type ORDER BY col) AS types, list(name ORDER BY col) AS names, row_number() OVER (ORDER BY table_id) - 1 AS t FROM kinds GROUP BY table_id),
    d AS (SELECT i, {_drawn('table')} % (SELECT count(*) FROM tabs) AS t FROM range((SELECT count(*) FROM trows)) AS r(i)),
    p AS (SELECT i, table_id, title, cols, types, names, cols[1 + {_drawn('sel')} % len(cols)] AS sel, CASE WHEN types[1 + {_drawn('sel')} % len(cols)] = 'float' THEN 1 + {_drawn('agg')} % 5 ELSE 0 END AS agg,
      CASE WHEN title <> '' THEN {_drawn('conds')} % 4 ELSE 1 + {_drawn('conds')} % 3 END AS wanted FROM d JOIN tabs USING (t)),
    a AS (SELECT *, (list_transform(list_sort(list_transform(list_filter(cols, lambda c: c <> sel), lambda c: [md5('sql/cols/' || i || '/' || c), c::VARCHAR])), lambda x: x[2]::INT))[:wanted] AS picked FROM p),
    z AS (SELECT table_id, max(row) + 1 AS n FROM trows GROUP BY table_id), j AS (SELECT a.*, k, ('0x' || substr(md5('sql/row/' || i || '/' || k), 1, 10))::BIGINT % n AS row FROM a JOIN z USING (table_id), range(8) AS t(k)),
    r AS (SELECT j.* EXCLUDE (row), trows.row, vals FROM j JOIN trows ON trows.table_id = j.table_id AND trows.row = j.row WHERE len(list_filter(picked, lambda c: vals[c + 1] = '')) = 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY k) = 1),
    c AS (SELECT *, list_transform(picked, lambda c: names[c + 1] || ' ' || (['[E-Q]', '[G-T]', '[L-T]'])[1 + CASE WHEN types[c + 1] = 'float' THEN ('0x' || substr(md5('sql/op/' || i || '/' || c), 1, 10))::BIGINT % 3 ELSE 0 END] || ' ' || vals[c + 1]) AS conds FROM r),
    f AS (SELECT *, CASE WHEN title <> '' AND (len(picked) = 0 OR {_drawn('title')} % (1 + len(picked)) = 0) THEN list_append(conds, 'about [E-Q] ' || title) ELSE conds END AS every FROM c)
    SELECT 'train_' || i AS qid, table_id, CASE WHEN len(picked) > 0 THEN row END AS row, sel, agg::INT AS agg, len(every)::INT AS n_conds,
      '[S-E-L-E-C-T] ' || CASE WHEN agg > 0 THEN (['[M-A-X]', '[M-I-N]', '[C-O-U-N-T]', '[S-U-M]', '[A-V-G]'])[agg] || ' ' ELSE '' END || names[sel + 1] || ' [W-H-E-R-E] ' || array_to_string(every, ' [A-N-D] ') AS sql_text FROM f WHERE len(every) > 0"""
)
def sql_sample(spark, sf_dir):
    rows = all_tables(spark, sf_dir)
    drawn = Q.sample_queries(rows, typed_columns(rows), rows.count())
    return drawn.select("qid", "table_id", "row", "sel", "agg", F.size("conds").alias("n_conds"), "sql_text")


def fixed_queries(rows: DataFrame) -> DataFrame:
    """A query from every row of the customer tables."""
    kind = "struct<col:int,op:int,value:string>"
    entry = lambda c, o, v: F.array(F.struct(F.lit(c).cast("int").alias("col"), F.lit(o).cast("int").alias("op") if isinstance(o, int) else o.cast("int").alias("op"), v.alias("value")))
    none = F.array().cast(f"array<{kind}>")
    conds = F.concat(
        entry(1, 0, F.col("vals")[1]),
        F.when(F.col("row") % 2 == 0, entry(2, 1 + F.floor(F.col("row") / 2) % 2, F.col("vals")[2])).otherwise(none),
        F.when(F.col("row") % 3 == 0, entry(None, 0, F.col("title"))).otherwise(none),
    )
    agg = (F.col("row") % 6).cast("int")
    return rows.select(F.concat_ws("_", "table_id", "row").alias("qid"), "table_id", "row", F.when(agg == 0, 0).otherwise(2).alias("sel"), agg.alias("agg"), conds.alias("conds"))


FIXED = f"""{CUST}, q AS (SELECT table_id || '_' || row AS qid, table_id, row, title, names, vals, CASE WHEN row % 6 = 0 THEN 0 ELSE 2 END AS sel, row % 6 AS agg,
  vals[2] AS seg, CASE WHEN row % 2 = 0 THEN 1 + (row // 2) % 2 END AS op, vals[3] AS bal, row % 3 = 0 AS about FROM cust)"""
_SQL_TEXT = """'[S-E-L-E-C-T] ' || CASE WHEN agg = 0 THEN '' ELSE (['[M-A-X]', '[M-I-N]', '[C-O-U-N-T]', '[S-U-M]', '[A-V-G]'])[agg] || ' ' END || names[sel + 1] || ' [W-H-E-R-E] segment [E-Q] ' || seg
  || CASE WHEN op IS NULL THEN '' ELSE ' [A-N-D] balance ' || (['[G-T]', '[L-T]'])[op] || ' ' || bal END || CASE WHEN about THEN ' [A-N-D] about [E-Q] ' || title ELSE '' END"""


@query(f"WITH {FIXED} SELECT qid, {_SQL_TEXT} AS sql_text FROM q")
def sql_text(spark, sf_dir):
    rows = customer_tables(spark, sf_dir)
    q = fixed_queries(rows).join(rows.select("table_id", "row", "names"), ["table_id", "row"])
    return q.select("qid", T.sql_text(F.col("names"), F.col("sel"), F.col("agg"), F.col("conds")).alias("sql_text"))


def _texts(spark, sf_dir):
    rows = customer_tables(spark, sf_dir)
    q = fixed_queries(rows).join(rows.select("table_id", "row", "names"), ["table_id", "row"])
    return q.select("qid", T.sql_text(F.col("names"), F.col("sel"), F.col("agg"), F.col("conds")).alias("sql_text"))


@query(
    f"""WITH {FIXED}, t AS (SELECT qid, {_SQL_TEXT} AS sql_text FROM q), h AS (SELECT lower(sql_text) AS key FROM t WHERE qid LIKE '%_20')
    SELECT lower(sql_text) AS key, min(qid) AS qid FROM t WHERE lower(sql_text) NOT IN (SELECT key FROM h) GROUP BY 1"""
)
def sql_dedup(spark, sf_dir):
    t = _texts(spark, sf_dir)
    return Q.new_queries(t, t.filter("qid LIKE '%_20'").select(F.lower("sql_text").alias("key"))).select("key", "qid")


def _executed(agg: int) -> str:
    x = "try_cast(r.vals[sel + 1] AS DOUBLE)"
    value = {0: "string_agg(r.vals[sel + 1], '|' ORDER BY r.row)", 1: f"max({x})", 2: f"min({x})", 3: "count(*)::VARCHAR", 4: f"sum({x})", 5: f"avg({x})"}[agg]
    value = value if agg in (0, 3) else f"printf('%.4f', round(round({value}, 9), 4))"
    return f"""WITH {FIXED} SELECT qid, {value} AS result FROM q JOIN cust r USING (table_id) WHERE agg = {agg} AND r.vals[2] = seg AND (op IS NULL OR CASE WHEN op = 1 THEN r.vals[3]::DOUBLE > bal::DOUBLE ELSE r.vals[3]::DOUBLE < bal::DOUBLE END) GROUP BY qid"""


def _execute(agg: int) -> Query:
    def run(spark, sf_dir):
        rows = customer_tables(spark, sf_dir)
        return Q.execute(fixed_queries(rows).filter(F.col("agg") == agg), rows, typed_columns(rows))

    return run


for _i, _name in enumerate(("plain", "max", "min", "count", "sum", "avg")):
    QUERIES[f"sql_execute_{_name}"], SQL[f"sql_execute_{_name}"] = _execute(_i), _executed(_i)


@query(f"WITH {FIXED}, n AS (SELECT qid, 1 + (op IS NOT NULL)::INT + about::INT AS n FROM q) SELECT qid, n AS n_conds, count(*) AS n_rows, max(nth)::INT AS last FROM n, unnest(range(0, (2 * CASE n WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END)::BIGINT)) AS t(i), unnest([i // 2]) AS u(nth) GROUP BY ALL")
def cond_permutations(spark, sf_dir):
    out = X.cond_permutations(fixed_queries(customer_tables(spark, sf_dir)))
    return out.distinct().groupBy("qid", F.size("conds").alias("n_conds")).agg(F.count("*").alias("n_rows"), F.max("nth").alias("last"))


# ---- joins ----------------------------------------------------------------------------------------

_TAGS = "tags AS (SELECT c_custkey AS qid, ((c_custkey * 7) % 5 + 1)::INT AS rank, 'customer-' || c_nationkey AS table_id, (c_custkey % 3)::INT AS row, CASE WHEN c_custkey % 2 = 0 THEN 0 END::INT AS sub_col, (1 + c_custkey % 3)::INT AS obj_col FROM customer)"


def _tags(spark, sf_dir):
    c = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        c.alias("qid"), ((c * 7) % 5 + 1).cast("int").alias("rank"), F.concat(F.lit("customer-"), F.col("c_nationkey").cast("string")).alias("table_id"), (c % 3).cast("int").alias("row"), F.when(c % 2 == 0, F.lit(0)).alias("sub_col"), (1 + c % 3).cast("int").alias("obj_col")
    )


@query(f"WITH {CUST}, {_TAGS} SELECT qid, rank, table_id, row, coalesce(sub_col, -1) AS sub_col, obj_col, {TAGGED.replace('s + 1', 'sub_col + 1').replace('o + 1', 'obj_col + 1')} AS text FROM tags JOIN cust USING (table_id, row)")
def tag_reconstruct(spark, sf_dir):
    return titled(G.reconstruct(_tags(spark, sf_dir), customer_tables(spark, sf_dir)))


@query(
    f"""WITH {FIXED} SELECT qid, table_id FROM q UNION SELECT q.qid, r.table_id FROM q JOIN cust r ON r.table_id <> q.table_id AND lower(r.vals[2]) = lower(q.seg) AND (q.op IS NULL OR lower(r.vals[3]) = lower(q.bal))"""
)
def gold_expansion(spark, sf_dir):
    rows = customer_tables(spark, sf_dir)
    return G.gold_tables(fixed_queries(rows), rows)


@query(
    f"""WITH {CELLS}, a AS (SELECT p_partkey AS qid, 'Parts ' || substr(p_brand, 1, 7) AS title, {sql_normal('p_type')} AS a FROM part ), c AS (SELECT *, {sql_normal('value')} AS v FROM cells),
    h AS (SELECT qid, table_id, row, col, string_split(v, ' ') AS x, string_split(a, ' ') AS y FROM a JOIN c ON lower(trim(a.title)) = lower(trim(c.title)) WHERE contains(v, a) AND a <> ''),
    f AS (SELECT *, list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda z: z = w)), len(list_filter(y, lambda z: z = w))))) AS shared FROM h)
    SELECT qid, table_id, row, col, round(2.0 * shared / (len(x) + len(y)), 6)::DOUBLE AS f1 FROM f WHERE round(2.0 * shared / (len(x) + len(y)), 6) >= 0.9"""
)
def answer_cell_match(spark, sf_dir):
    asked = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.concat(F.lit("Parts "), F.substring("p_brand", 1, 7)).alias("title"), F.col("p_type").alias("answer"))
    return G.answer_cells(asked, S.cells(all_tables(spark, sf_dir)))


@query("SELECT c_custkey AS qid, CASE WHEN c_custkey % 3 = 0 AND 'T' || (c_custkey % 7) <> 'T' || (c_custkey % 4) THEN 'T' || (c_custkey % 4) || ',T' || (c_custkey % 7) ELSE 'T' || (c_custkey % 4) END AS tables FROM customer")
def gold_extend(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    name = lambda m: F.concat(F.lit("T"), (F.col("c_custkey") % m).cast("string"))
    gold = c.select(F.col("c_custkey").alias("qid"), F.array(name(4)).alias("tables"))
    judged = c.select(F.col("c_custkey").alias("qid"), name(7).alias("table_id"), F.when(F.col("c_custkey") % 3 == 0, "Y").otherwise("N").alias("mark"))
    return G.extended_gold(gold, judged).withColumn("tables", F.array_join("tables", ","))


@query(f"WITH {ROWS}, {_TAGS} SELECT table_id, row, {_ROW_TEXT} AS passage FROM trows WHERE (table_id, row) IN (SELECT (table_id, row) FROM tags WHERE rank <= 2)")
def row_key_semi(spark, sf_dir):
    keys = _tags(spark, sf_dir).filter("rank <= 2").select("table_id", "row")
    return all_tables(spark, sf_dir).join(keys, ["table_id", "row"], "left_semi").select("table_id", "row", T.row_text(F.col("title"), F.col("names"), F.col("vals")).alias("passage"))


@query("SELECT doc_id AS qid FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def shared_questions(spark, sf_dir):
    d, lab = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return G.questions_of_all(d.select(F.col("doc_id").alias("qid")), lab.select(F.col("doc_id").alias("qid")), d.filter("lang = 'en'").select(F.col("doc_id").alias("qid")))


@query(f"WITH {WRAPPED}, {PAIRS} SELECT table_id, row, coalesce(s, -1) AS sub_col, o AS obj_col, CASE WHEN row % 2 = 0 AND o = 3 THEN 'generated ' || row ELSE {ANNOTATED} END AS passage FROM w, pairs")
def graph_text_merge(spark, sf_dir):
    base = X.relation_triples(all_tables(spark, sf_dir))
    better = base.filter("row % 2 = 0 AND obj_col = 3").withColumn("passage", F.concat(F.lit("generated "), F.col("row").cast("string")))
    return titled(G.merged_texts(base, better))


@query("SELECT 'part-' || p_brand AS table_id, CASE WHEN min(p_size) % 2 = 0 THEN 'slide' ELSE 'CompleteGraph' END AS strategy FROM part GROUP BY p_brand")
def strategy_composite(spark, sf_dir):
    t = load(spark, sf_dir, "part").groupBy(F.concat(F.lit("part-"), "p_brand").alias("table_id")).agg(F.min("p_size").alias("m"))
    return G.best_strategy(t.select("table_id"), t.filter("m % 2 = 0").select("table_id", F.lit("slide").alias("strategy")))


@query(f"WITH {CUST} SELECT table_id, row, 0 AS sub_col, 2 AS obj_col, vals[1] || ' has ' || vals[3] || ' left' AS passage FROM cust")
def template_fanout(spark, sf_dir):
    rows = customer_tables(spark, sf_dir)
    t = rows.select("table_id").distinct().select("table_id", F.lit(0).alias("sub_col"), F.lit(2).alias("obj_col"), F.lit("[S] has [O] left").alias("template"))
    return X.template_fanout(t, rows)


# ---- retrieval ------------------------------------------------------------------------------------

DEPTH = 100
#: Which vectors ask.
ASKS = "vec_id % 20 = 0"


def vectors(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_id"), F.col("label").alias("table_id"), "embedding")


def vector_questions(spark, sf_dir):
    """Every twentieth vector asks; each has its own label as gold."""
    return load(spark, sf_dir, "embeddings").filter(ASKS).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"), F.col("label").alias("gold"))


def retrieved(spark, sf_dir, depth: int = DEPTH):
    return V.flat_knn(vectors(spark, sf_dir), vector_questions(spark, sf_dir).select("qid", "q"), depth)


def labelled(spark, sf_dir, depth: int = DEPTH):
    """Right are the passages of a question's own label and those of the next."""
    gold = vector_questions(spark, sf_dir).select("qid", "gold")
    right = (F.col("table_id") == F.col("gold")) | (F.col("table_id") == F.col("gold") + 1)
    return retrieved(spark, sf_dir, depth).join(gold, "qid").withColumn("correct", right.cast("int")).drop("gold")


SCORED = f"""scored AS (SELECT q.vec_id AS qid, p.vec_id AS p_id, p.label AS table_id, round(list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) + 0.0 AS score FROM embeddings q, embeddings p WHERE q.{ASKS}),
  allranks AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p_id)::INT AS rank, p_id, table_id, score FROM scored), retr AS (SELECT * FROM allranks WHERE rank <= {DEPTH})"""
LABELLED = f"{SCORED}, lab AS (SELECT r.*, (r.table_id = g.label OR r.table_id = g.label + 1)::INT AS correct FROM retr r JOIN embeddings g ON g.vec_id = r.qid)"


@query(f"WITH {SCORED} SELECT qid, rank, p_id, table_id, score FROM retr")
def knn_flat_ip(spark, sf_dir):
    return retrieved(spark, sf_dir).select("qid", "rank", "p_id", "table_id", "score")


@query(f"WITH {SCORED}, s AS (SELECT qid, count(DISTINCT table_id) AS n FROM retr WHERE rank <= 12 GROUP BY qid) SELECT qid, rank, p_id, table_id, score FROM retr JOIN s USING (qid) WHERE rank <= CASE WHEN n < 5 THEN {DEPTH} ELSE 12 END")
def knn_adaptive(spark, sf_dir):
    return R.deepened(retrieved(spark, sf_dir), 12, DEPTH, 5).select("qid", "rank", "p_id", "table_id", "score")


_CENTROIDS = "cen AS (SELECT (row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1)::INT AS list, embedding::DOUBLE[] AS c FROM embeddings QUALIFY list < 16)"


@query(f"WITH {_CENTROIDS} SELECT vec_id AS p_id, list FROM embeddings, cen QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9), list) = 1")
def ivf_assign(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return V.assign_lists(v, V.hashed_centroids(v, 16)).select("p_id", "list")


@query(f"WITH {SCORED} SELECT qid, rank, p_id, table_id, score FROM retr")
def ivf_probe_all(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = V.hashed_centroids(v, 16)
    return V.ivf_search(V.assign_lists(v, c), c, vector_questions(spark, sf_dir).select("qid", "q"), DEPTH, 16).select("qid", "rank", "p_id", "table_id", "score")


def stored_lists(spark, sf_dir, lists: int, parts: int | None = None):
    """The table as an index in folders by list: (lists, centroids, codebooks)."""
    v, path = vectors(spark, sf_dir), new_folder(spark, "lists")
    c = V.coarse_centroids(v, lists, max(V.index_options(v.count())["train"], 500))
    assigned, books = V.assign_lists(v, c), None
    if parts:
        assigned, books = V.residual_codes(assigned, c, parts)
    V.write_lists(assigned, path)
    return spark.read.parquet(path), c, books


@query()
def ivf_probe_recall(spark, sf_dir):
    """Share of the exact first 10 that a search of three quarters of the stored lists finds; these vectors have no clusters to find."""
    q = vector_questions(spark, sf_dir).select("qid", "q")
    lists, c, _ = stored_lists(spark, sf_dir, 16)
    found = V.ivf_search(lists, c, q, 10, 12)
    exact = V.flat_knn(vectors(spark, sf_dir), q, 10)
    return exact.join(found.select("qid", "p_id", F.lit(1).alias("hit")), ["qid", "p_id"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"), F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT qid, rank, p_id, table_id, score FROM retr WHERE rank <= 10")
def pq_search(spark, sf_dir):
    """By codes over all lists, with 16 times the depth and then all that could still be among them measured again: the exact first 10."""
    lists, c, books = stored_lists(spark, sf_dir, 8, parts=32)
    return V.coded_search(lists, c, books, vector_questions(spark, sf_dir).select("qid", "q"), 10, 8, refine=16, exact=True).select("qid", "rank", "p_id", "table_id", "score")


@query(
    f"""WITH {SCORED}, n AS (SELECT r.*, round(list_inner_product(list_transform(q.embedding::DOUBLE[], lambda x: x * x), list_transform(p.embedding::DOUBLE[], lambda x: x * x)), 6) + 0.0 AS teacher FROM retr r JOIN embeddings q ON q.vec_id = r.qid JOIN embeddings p ON p.vec_id = r.p_id)
    SELECT qid, p_id, score, teacher, rank AS was, row_number() OVER (PARTITION BY qid ORDER BY teacher DESC, p_id)::INT AS rank FROM n"""
)
def teacher_rerank(spark, sf_dir):
    from gridseek.functions.vectors import dot

    square = lambda c: F.transform(c, lambda x: x.cast("double") * x.cast("double"))
    other = vectors(spark, sf_dir).select("p_id", square("embedding").alias("pe"))
    asks = vector_questions(spark, sf_dir).select("qid", square("q").alias("qe"))
    scored = retrieved(spark, sf_dir).join(other, "p_id").join(asks, "qid").withColumn("teacher", F.round(dot(F.col("qe"), F.col("pe")), 6) + 0.0)
    return R.reranked(scored, "teacher").select("qid", "p_id", "score", "teacher", "was", "rank")


_TERMS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', ' ', 'g'), '[ \\n]+'), lambda t: t <> '')"
BM25 = f"""q AS (SELECT item_id AS qid, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
  d AS (SELECT doc_id AS p_id, source AS table_id, {_TERMS} AS ws FROM documents), tot AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
  tf AS (SELECT p_id, table_id, len, term, count(*) AS tf FROM (SELECT p_id, table_id, len(ws) AS len, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), tot),
  s AS (SELECT qid, p_id, table_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN q USING (term) JOIN idf USING (term), tot GROUP BY ALL),
  bm AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, p_id)::INT AS rank, p_id, table_id, score FROM s)"""


def worded(spark, sf_dir, k: int):
    passages = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_id"), F.col("source").alias("table_id"), "text")
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return V.bm25(passages, questions, k)


@query(f"WITH {BM25} SELECT qid, rank, p_id, table_id, score FROM bm WHERE rank <= 20")
def bm25_search(spark, sf_dir):
    return worded(spark, sf_dir, 20).select("qid", "rank", "p_id", "table_id", "score")


@query(f"WITH {BM25} SELECT qid, rank, p_id, table_id, score FROM bm WHERE rank <= 20")
def word_index_search(spark, sf_dir):
    """bm25_search by a stored index."""
    path = new_folder(spark, "words")
    W.write_index(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_id"), F.col("source").alias("table_id"), "text"), path)
    questions = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return W.WordIndex(spark, path).search(questions, 20).select("qid", "rank", "p_id", "table_id", "score")


@query(f"WITH {BM25}, c AS (SELECT qid, count(DISTINCT table_id) AS n FROM bm WHERE rank <= 6 GROUP BY qid) SELECT qid, rank, p_id, table_id, score FROM bm JOIN c USING (qid) WHERE rank <= CASE WHEN n < 5 THEN 30 ELSE 6 END")
def bm25_adaptive(spark, sf_dir):
    return R.deepened(worded(spark, sf_dir, 30), 6, 30, 5).select("qid", "rank", "p_id", "table_id", "score")


_GROUPED = "g1 AS (SELECT *, min(rank) OVER (PARTITION BY qid, table_id) AS first, row_number() OVER (PARTITION BY qid, table_id ORDER BY rank) AS nth, count(*) OVER (PARTITION BY qid, table_id) AS length FROM retr), g AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY first) AS table_rank FROM g1)"


@query(
    f"""WITH {SCORED}, {_GROUPED}, h AS (SELECT *, max(table_rank) OVER (PARTITION BY qid) AS tables, max(table_rank) FILTER (rank <= 25) OVER (PARTITION BY qid) AS t FROM g),
    tab AS (SELECT qid, table_rank, any_value(length) AS len, any_value(t) AS t FROM h GROUP BY qid, table_rank),
    need AS (SELECT qid, sum(len) FILTER (table_rank <= t) + coalesce(sum(least(len, 3)) FILTER (table_rank > t AND table_rank <= 6), 0) - 25 AS need FROM tab GROUP BY qid),
    lost AS (SELECT qid, table_rank, greatest(0, least(greatest(len - 3, 0), need - coalesce(sum(CASE WHEN table_rank <= t THEN greatest(len - 3, 0) ELSE 0 END) OVER (PARTITION BY qid ORDER BY table_rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))) AS lost FROM tab JOIN need USING (qid)),
    k AS (SELECT h.*, t < 6 AND tables >= 6 AS change, lost FROM h JOIN lost USING (qid, table_rank)),
    f AS (SELECT * FROM k WHERE CASE WHEN change THEN CASE WHEN table_rank <= t THEN nth <= length - lost ELSE table_rank <= 6 AND nth <= 3 END ELSE rank <= 25 END),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN change THEN table_rank ELSE 0 END, rank)::INT AS place FROM f)
    SELECT qid, place, rank, p_id, score, table_id FROM o WHERE place <= 25"""
)
def min_table_rebalance(spark, sf_dir):
    return R.rebalanced(retrieved(spark, sf_dir), 25, 6)


@query(f"WITH {SCORED}, {_GROUPED} SELECT qid, rank, p_id, table_id, table_rank::INT AS table_rank, nth::INT AS nth, length FROM g")
def group_tables(spark, sf_dir):
    return R.grouped_by_table(retrieved(spark, sf_dir)).select("qid", "rank", "p_id", "table_id", "table_rank", "nth", "length")


@query(f"WITH {SCORED}, f AS (SELECT qid, table_id, min(rank) AS first, max(score) AS score FROM retr GROUP BY ALL) SELECT qid, table_id, score, row_number() OVER (PARTITION BY qid ORDER BY first)::INT AS place FROM f QUALIFY place <= 5")
def top5_tables(spark, sf_dir):
    return R.top_tables(retrieved(spark, sf_dir))


@query(
    f"""WITH {SCORED}, d AS (SELECT r.qid, r.table_id, r.p_id, unnest(p.embedding) AS x, generate_subscripts(p.embedding, 1)::INT - 1 AS dim FROM retr r JOIN embeddings p ON p.vec_id = r.p_id)
    SELECT qid, table_id, p_id, dim::INT AS dim, round(x::DOUBLE, 6) AS x, round(max(x) OVER (PARTITION BY qid, table_id, dim)::DOUBLE, 6) AS top FROM d"""
)
def table_max_feature(spark, sf_dir):
    feats = vectors(spark, sf_dir).select("p_id", F.col("embedding").alias("features"))
    out = R.table_max(retrieved(spark, sf_dir).select("qid", "table_id", "p_id").join(feats, "p_id"))
    out = out.select("qid", "table_id", "p_id", F.posexplode(F.arrays_zip(F.col("features").alias("x"), F.col("top").alias("top"))).alias("dim", "e"))
    return out.select("qid", "table_id", "p_id", "dim", F.round(F.col("e.x").cast("double"), 6).alias("x"), F.round("e.top", 6).alias("top"))


@query(f"WITH {SCORED}, s AS (SELECT qid, p_id, score * m AS x FROM retr, unnest([0.5, 1.0, 1.5, 2.0]) AS t(m)) SELECT qid, p_id, round(avg(least(x, 0) - ln(1 + exp(-abs(x)))), 6) AS score FROM s GROUP BY ALL")
def ensemble_logsigmoid(spark, sf_dir):
    samples = retrieved(spark, sf_dir).withColumn("m", F.explode(F.array(*map(F.lit, (0.5, 1.0, 1.5, 2.0))))).withColumn("score", F.col("score") * F.col("m"))
    return R.ensemble(samples).withColumn("score", F.round("score", 6))


@query(
    """WITH t AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, (vec_id % 3 <> 0)::INT AS m FROM embeddings)
    SELECT label, dim::INT AS dim, round(sum(v[dim + 1]) / count(*), 5) AS mean FROM t, range(0, 64) AS r(dim) WHERE m = 1 GROUP BY ALL"""
)
def masked_mean_pool(spark, sf_dir):
    pooled = R.mean_pooled(load(spark, sf_dir, "embeddings"), "label", "embedding", (F.col("vec_id") % 3 != 0).cast("int"))
    return pooled.select("label", F.posexplode("mean").alias("dim", "mean")).withColumn("mean", F.round("mean", 5))


# ---- filters --------------------------------------------------------------------------------------


@query(f"WITH {LABELLED} SELECT qid, rank, p_id, correct FROM (SELECT *, min(correct) OVER (PARTITION BY qid) AS lo, max(correct) OVER (PARTITION BY qid) AS hi FROM lab) WHERE lo = 0 AND hi = 1")
def mixed_label_questions(spark, sf_dir):
    return R.mixed_label_questions(labelled(spark, sf_dir), F.col("correct")).select("qid", "rank", "p_id", "correct")


def _split(spark, sf_dir):
    return R.split_by_label(labelled(spark, sf_dir).withColumnRenamed("correct", "label"))


_SPLIT = f"{LABELLED}, sp AS (SELECT qid, list(p_id ORDER BY rank) FILTER (correct = 1) AS pos, list(p_id ORDER BY rank) FILTER (correct = 0) AS neg FROM lab GROUP BY qid HAVING min(correct) = 0 AND max(correct) = 1)"
_JOINED = "array_to_string(pos, ',') AS pos, array_to_string(neg, ',') AS neg"


def _text_lists(df):
    return df.select("qid", F.array_join(F.col("pos").cast("array<string>"), ",").alias("pos"), F.array_join(F.col("neg").cast("array<string>"), ",").alias("neg"))


@query(f"WITH {_SPLIT} SELECT qid, {_JOINED} FROM sp")
def pos_neg_partition(spark, sf_dir):
    return _text_lists(_split(spark, sf_dir))


@query(
    f"""WITH {_SPLIT}, n AS (SELECT *, len(pos) + len(neg) > 30 AS over, least(len(pos), 15) AS a, least(len(neg), 15) AS b FROM sp),
    c AS (SELECT qid, CASE WHEN over THEN pos[:greatest(a, least(len(pos), 30 - b))] ELSE pos END AS pos, CASE WHEN over THEN neg[:greatest(b, least(len(neg), 30 - a))] ELSE neg END AS neg FROM n) SELECT qid, {_JOINED} FROM c"""
)
def balanced_cap(spark, sf_dir):
    return _text_lists(R.balanced_cap(_split(spark, sf_dir), 30))


@query(f"WITH {_SPLIT} SELECT qid, pos[1] AS pos, array_to_string(neg[:3], ',') AS neg FROM sp")
def negatives_first_k(spark, sf_dir):
    return R.one_positive(_split(spark, sf_dir), 3).withColumn("neg", F.array_join(F.col("neg").cast("array<string>"), ","))


_GAPS = "gaps AS (SELECT table_id, row, list_transform(vals, lambda v, i: CASE WHEN (row + i) % 4 = 0 THEN '' ELSE v END) AS vals FROM cust)"


@query(f"WITH {CUST}, {_GAPS} SELECT table_id, row FROM gaps WHERE vals[1] <> '' AND vals[3] <> ''")
def row_no_missing(spark, sf_dir):
    rows = customer_tables(spark, sf_dir)
    gaps = rows.withColumn("vals", F.transform("vals", lambda v, i: F.when((F.col("row") + i + 1) % 4 == 0, "").otherwise(v)))
    return P.complete_rows(gaps, [0, 2]).select("table_id", "row")


@query(f"WITH {CELLS}, s AS (SELECT *, {sql_size('value')} AS size FROM cells), b AS (SELECT quantile_cont(size, 0.75) + 1.5 * (quantile_cont(size, 0.75) - quantile_cont(size, 0.25)) AS hi FROM s) SELECT table_id, row, col, value FROM s, b WHERE size <= hi")
def oversize_cond(spark, sf_dir):
    sized = S.cells(all_tables(spark, sf_dir)).withColumn("size", T.token_size(F.col("value")))
    return sized.join(F.broadcast(P.fences(sized)), F.col("size") <= F.col("hi")).select("table_id", "row", "col", "value")


@query("SELECT doc_id, (row_number() OVER (ORDER BY md5('parts/' || doc_id), doc_id) - 1) // 100 AS part FROM documents")
def shuffle_parts(spark, sf_dir):
    return P.shuffled_parts(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100).select("doc_id", "part")


# ---- measures -------------------------------------------------------------------------------------

_TABLE_HITS = "th AS (SELECT qid, table_id, max(correct) AS correct, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM lab GROUP BY qid, table_id)"


def _precision_sql(ks: str, tables: bool) -> str:
    src = "th" if tables else "lab"
    return f"WITH {LABELLED}{', ' + _TABLE_HITS if tables else ''}, b AS (SELECT qid, min(rank) FILTER (correct = 1) AS spot FROM {src} GROUP BY qid) SELECT k::INT AS k, round(100 * avg(CASE WHEN spot <= k THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS precision FROM b, unnest({ks}) AS t(k) GROUP BY k"


@query(_precision_sql("[1, 5]", True))
def precision_at_k_table(spark, sf_dir):
    return M.precision_at(labelled(spark, sf_dir), (1, 5))


@query(_precision_sql("[1, 3, 5]", False))
def precision_at_k_passage(spark, sf_dir):
    return M.precision_at(labelled(spark, sf_dir), (1, 3, 5), tables=False)


@query(_precision_sql("[1, 10, 100]", True))
def precision_k_1_10_100(spark, sf_dir):
    return M.precision_at(labelled(spark, sf_dir), (1, 10, 100))


@query(f"WITH {LABELLED}, b AS (SELECT qid, min(rank) FILTER (correct = 1) AS spot FROM lab GROUP BY qid) SELECT k, count(*) FILTER (spot <= k)::BIGINT AS questions FROM b, range(1, 21) AS t(k) GROUP BY k")
def answer_hit_curve(spark, sf_dir):
    return M.hit_curve(labelled(spark, sf_dir), 20)


@query(f"SELECT c_custkey, ({sql_normal("'The ' || c_name || '.'")} = {sql_normal('c_name')})::INT AS em FROM customer")
def exact_match(spark, sf_dir):
    said = F.concat(F.lit("The "), "c_name", F.lit("."))
    return load(spark, sf_dir, "customer").select("c_custkey", M.exact_match(said, F.array("c_name", F.lit("nobody"))).alias("em"))


_PAIRS_OF_PARTS = "pp AS (SELECT a.p_partkey AS sid, a.p_name || ' ' || a.p_type AS hyp, b.p_name || ' ' || b.p_type AS ref FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"


def _part_pairs(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return p.select(F.col("p_partkey").alias("sid"), F.col("t").alias("hyp")).join(p.select((F.col("p_partkey") - 1).alias("sid"), F.col("t").alias("ref")), "sid")


@query(
    f"""WITH {_PAIRS_OF_PARTS}, w AS (SELECT sid, string_split(hyp, ' ') AS x, string_split(ref, ' ') AS y FROM pp),
    f AS (SELECT *, list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda z: z = w)), len(list_filter(y, lambda z: z = w))))) AS shared FROM w)
    SELECT sid, round(2.0 * shared / (len(x) + len(y)), 6)::DOUBLE AS f1 FROM f"""
)
def token_f1(spark, sf_dir):
    return _part_pairs(spark, sf_dir).select("sid", F.round(G.token_f1(F.split("hyp", " "), F.split("ref", " ")), 6).alias("f1"))


_PLACED = f"{SCORED}, pl AS (SELECT qid, p_id, rank - 1 AS true_rank, row_number() OVER (PARTITION BY qid ORDER BY (p_id * 7919) % 1009, p_id) - 1 AS place FROM retr)"


def _placed(spark, sf_dir):
    order = Window.partitionBy("qid").orderBy((F.col("p_id") * 7919) % 1009, "p_id")
    return retrieved(spark, sf_dir).select("qid", "p_id", (F.col("rank") - 1).alias("true_rank"), (F.row_number().over(order) - 1).alias("place"))


@query(f"WITH {_PLACED} SELECT a.qid, count(*) AS inversions FROM pl a JOIN pl b ON a.qid = b.qid AND a.place < b.place AND a.true_rank > b.true_rank GROUP BY a.qid")
def rank_inversions(spark, sf_dir):
    return M.rank_agreement(_placed(spark, sf_dir), 5).select("qid", "inversions").filter("inversions > 0")


@query(f"WITH {_PLACED} SELECT qid, round(avg((true_rank < 5)::INT) FILTER (place < 5), 6) AS topk, (max(place) FILTER (true_rank < 5) + 1)::INT AS depth FROM pl GROUP BY qid")
def topk_agreement(spark, sf_dir):
    return M.rank_agreement(_placed(spark, sf_dir), 5).select("qid", "topk", "depth")


def _grams_sql(n: int, unit: str) -> str:
    cut = "string_split({x}, ' ')" if unit == "w" else "string_split(replace({x}, ' ', ''), '')"
    side = lambda x: f"(SELECT sid, g, count(*) AS c FROM (SELECT sid, unnest(list_transform(range(1, greatest(len({cut.format(x=x)}) - {n - 2}, 1)), lambda i: array_to_string(({cut.format(x=x)})[i:i + {n - 1}], chr(1)))) AS g FROM pp) GROUP BY ALL)"
    return f"SELECT sid, coalesce(sum(least(coalesce(h.c, 0), coalesce(r.c, 0))), 0) AS hit, sum(h.c) AS hn, sum(r.c) AS rn FROM {side('hyp')} h FULL JOIN {side('ref')} r USING (sid, g) GROUP BY sid"


@query(
    f"WITH {_PAIRS_OF_PARTS}, u AS ({' UNION ALL '.join([_grams_sql(i, 'c') for i in range(1, 7)] + [_grams_sql(i, 'w') for i in (1, 2)])}), m AS (SELECT sid, avg(hit / hn) FILTER (hn > 0) AS p, avg(hit / rn) FILTER (rn > 0) AS r FROM u GROUP BY sid) SELECT sid, round(CASE WHEN p > 0 AND r > 0 THEN 500 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM m"
)
def chrf(spark, sf_dir):
    return M.chrf(_part_pairs(spark, sf_dir).withColumn("refs", F.array("ref")))


_DOC_PAIRS = "pp AS (SELECT a.conv_id * 100 + a.turn AS sid, a.text AS hyp, b.text AS ref FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def _turn_pairs(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("sid"), F.col("text").alias("hyp")).join(c.select((F.col("conv_id") * 100 + F.col("turn") - 1).alias("sid"), F.col("text").alias("ref")), "sid")


def _bleu_sql() -> str:
    w = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"
    side = lambda x, n: f"(SELECT sid, g, count(*) AS c FROM (SELECT sid, unnest(list_transform(range(1, greatest(len({x}) - {n - 2}, 1)), lambda i: array_to_string({x}[i:i + {n - 1}], ' '))) AS g FROM tk) GROUP BY ALL)"
    parts = " UNION ALL ".join(f"SELECT {n} AS n, sum(least(h.c, coalesce(r.c, 0))) AS hit, sum(h.c) AS alln FROM {side('hw', n)} h LEFT JOIN {side('rw', n)} r USING (sid, g)" for n in range(1, 5))
    return f"""WITH {_DOC_PAIRS}, tk AS (SELECT sid, {w.format(x='hyp')} AS hw, {w.format(x='ref')} AS rw FROM pp), s AS ({parts}), l AS (SELECT sum(len(hw))::BIGINT AS hl, sum(len(rw))::BIGINT AS rl FROM tk), m AS (SELECT CASE WHEN min(hit) > 0 THEN sum(ln(hit / alln)) END AS logs FROM s)
        SELECT round(CASE WHEN logs IS NULL THEN 0 ELSE 100 * exp(logs / 4 + CASE WHEN hl < rl THEN 1 - rl / hl ELSE 0 END) END, 6)::DOUBLE AS bleu, hl AS hyp_words, rl AS ref_words FROM m, l"""


@query(_bleu_sql())
def bleu4(spark, sf_dir):
    return M.bleu4(_turn_pairs(spark, sf_dir).withColumn("refs", F.array("ref")))


_RUNS = "runs AS (SELECT o_custkey % 20 AS run, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey)::INT AS step, (o_totalprice * 100)::BIGINT % 50 AS p1, o_orderkey % 60 AS p5 FROM orders)"


def _runs(spark, sf_dir):
    run = F.col("o_custkey") % 20
    return load(spark, sf_dir, "orders").select(run.alias("run"), F.row_number().over(Window.partitionBy(run).orderBy("o_orderkey")).alias("step"), (F.round(F.col("o_totalprice") * 100).cast("long") % 50).alias("p1"), (F.col("o_orderkey") % 60).alias("p5"))


@query(f"WITH {_RUNS} SELECT run, step, p1, p5 FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY p1 DESC, p5 DESC, step) = 1")
def best_epoch(spark, sf_dir):
    return M.best_step(_runs(spark, sf_dir))


@query(
    f"""WITH {_RUNS}, b AS (SELECT run, step, p1 AS metric, p1 > coalesce(max(p1) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better, max(p1) OVER (PARTITION BY run ORDER BY step) AS best FROM runs)
    SELECT run, step, metric, best, step - max(CASE WHEN better THEN step END) OVER (PARTITION BY run ORDER BY step) AS waited FROM b"""
)
def patience_counter(spark, sf_dir):
    return R.patience(_runs(spark, sf_dir).select("run", "step", F.col("p1").alias("metric")))


@query(f"WITH {LABELLED} SELECT qid, round(-avg(correct * (least(score, 0) - ln(1 + exp(-abs(score)))) + (1 - correct) * (least(-score, 0) - ln(1 + exp(-abs(score))))), 6) AS loss FROM lab GROUP BY qid")
def loss_bce(spark, sf_dir):
    return M.bce_loss(labelled(spark, sf_dir).withColumnRenamed("correct", "label"))


@query(f"WITH {LABELLED}, e AS (SELECT qid, correct, exp(score - max(score) OVER (PARTITION BY qid)) AS e FROM lab) SELECT qid, round(-ln(sum(e) FILTER (correct = 1) / sum(e)), 6) AS loss FROM e GROUP BY qid")
def loss_listwise(spark, sf_dir):
    return M.listwise_loss(labelled(spark, sf_dir).withColumnRenamed("correct", "label"))


# ---- grouping -------------------------------------------------------------------------------------


@query("SELECT o_custkey AS qid, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS table_ids, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS answers FROM orders GROUP BY o_custkey")
def qa_group(spark, sf_dir):
    qa = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderstatus").alias("table_id"), F.array("o_orderpriority").alias("answers"))
    return G.grouped_questions(qa).select("qid", F.array_join("table_ids", ",").alias("table_ids"), F.array_join("answers", ",").alias("answers"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean, sum(l_quantity) AS n FROM lineitem GROUP BY l_returnflag")
def weighted_avg(spark, sf_dir):
    return M.weighted_average(load(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("n")), "l_returnflag")


@query(f"WITH {ROWS} SELECT table_id FROM trows EXCEPT SELECT 'customer-' || c_nationkey FROM customer WHERE c_nationkey < 10")
def set_difference_tables(spark, sf_dir):
    gone = load(spark, sf_dir, "customer").filter("c_nationkey < 10").select(F.concat(F.lit("customer-"), F.col("c_nationkey").cast("string")).alias("table_id"))
    return all_tables(spark, sf_dir).select("table_id").subtract(gone)


@query(
    """WITH o AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY md5('sortish/' || doc_id), doc_id) - 1) // 40 AS block FROM documents),
    b AS (SELECT doc_id, n_chars, block * 5 + (row_number() OVER (PARTITION BY block ORDER BY n_chars DESC, doc_id) - 1) // 8 AS batch FROM o), f AS (SELECT batch AS first FROM b ORDER BY n_chars DESC, batch LIMIT 1)
    SELECT doc_id, n_chars, (CASE WHEN batch = first THEN 0 WHEN batch < first THEN batch + 1 ELSE batch END)::BIGINT AS batch FROM b, f"""
)
def sortish_batches(spark, sf_dir):
    return P.sortish_batches(load(spark, sf_dir, "documents"), "doc_id", "n_chars", 8, blocks=5)


# ---- examples -------------------------------------------------------------------------------------


@query("SELECT 'train_' || doc_id AS qid, quality FROM labels WHERE doc_id % 5 <> 0")
def route_by_mode(spark, sf_dir):
    mode = F.when(F.col("doc_id") % 5 == 0, "dev_").otherwise("train_")
    return E.route(load(spark, sf_dir, "labels").select(F.concat(mode, F.col("doc_id").cast("string")).alias("qid"), "quality"), "train")


@query("SELECT p_partkey AS line, p_name || ' *# ' || p_type || ' *# ' || p_brand AS refs FROM part")
def reference_merge(spark, sf_dir):
    return E.merged_references(load(spark, sf_dir, "part").withColumnRenamed("p_partkey", "line"), ["p_name", "p_type", "p_brand"])


@query("SELECT p_partkey AS line, (k - 1)::INT AS k, ([p_name, p_type, p_brand])[k] AS ref FROM part, unnest([1, 2, 3]) AS t(k)")
def reference_interleave(spark, sf_dir):
    return E.interleaved_references(load(spark, sf_dir, "part").withColumnRenamed("p_partkey", "line"), ["p_name", "p_type", "p_brand"])


@query(f"WITH {LABELLED}, s AS (SELECT step::INT AS step, qid, p_id, correct, (p_id * (step * 7 + 3)) % 101 AS sc FROM lab, range(0, 4) AS t(step)) SELECT step, qid, correct FROM s QUALIFY row_number() OVER (PARTITION BY step, qid ORDER BY sc DESC, p_id) = 1")
def checkpoint_correctness(spark, sf_dir):
    steps = labelled(spark, sf_dir).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return E.step_correctness(steps.withColumn("score", (F.col("p_id") * (F.col("step") * 7 + 3)) % 101))


@query(f"SELECT round(avg(({sql_normal("p_name || '!'")} = {sql_normal('p_name')} AND p_partkey % 3 = 0)::INT), 6) AS em, count(*) AS n FROM part")
def reader_exact_match(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise("nothing at all")
    return E.mean_exact_match(load(spark, sf_dir, "part").select(said.alias("prediction"), F.array("p_name").alias("references")))


@query("WITH c AS (SELECT o_custkey AS qid, o_orderkey AS cand, (o_orderstatus = 'F')::INT AS em, o_orderkey % 13 AS coherence FROM orders) SELECT qid, em FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY coherence DESC, cand) = 1")
def coherence_pick(spark, sf_dir):
    c = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("cand"), F.col("o_orderstatus").alias("prediction"), F.array(F.lit("F")).alias("references"), (F.col("o_orderkey") % 13).alias("coherence"))
    return E.coherent_answers(c)


@query(
    """WITH a AS (SELECT l_orderkey AS qid, l_suppkey AS p_id, l_linenumber AS token, layer, (l_linenumber % 4 <> 0)::INT AS valid, l_discount * (layer + 1) AS w FROM lineitem, range(0, 2) AS t(layer))
    SELECT qid, p_id, round(sum(CASE WHEN valid = 1 THEN w ELSE 0 END) / (count(DISTINCT CASE WHEN valid = 1 THEN token END) * count(DISTINCT layer)), 6) AS score FROM a GROUP BY ALL HAVING count(DISTINCT CASE WHEN valid = 1 THEN token END) > 0"""
)
def attention_score(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    a = lines.select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("p_id"), F.col("l_linenumber").alias("token"), "layer", F.lit(0).alias("head"), (F.col("l_linenumber") % 4 != 0).cast("int").alias("valid"), (F.col("l_discount") * (F.col("layer") + 1)).alias("weight"))
    return E.attention_scores(a)


@query("WITH c AS (SELECT c_custkey AS ord, c_name AS question, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS target FROM customer) SELECT ord, question, CASE WHEN target = upper(target) THEN target[1] || lower(target[2:]) ELSE target END AS target, n_name AS first_title FROM c JOIN nation ON n_nationkey = ord % 25")
def select_examples(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    target = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    ex = c.select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("question"), target.alias("target"))
    picked = c.select(F.col("c_custkey").alias("ord"), F.array(F.col("c_custkey") % 25, (F.col("c_custkey") + 1) % 25).alias("passage_ids"))
    passages = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("p_id"), F.col("n_name").alias("title"), F.col("n_name").alias("text"))
    return E.select_examples(picked, ex, passages).select("ord", "question", "target", F.col("ctxs")[0]["title"].alias("first_title"))


@query("WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM embeddings WHERE label <> 3) SELECT vec_id AS p_id, new_id FROM p")
def renumbered_passages(spark, sf_dir):
    return E.renumbered(vectors(spark, sf_dir).filter("table_id <> 3").select("p_id")).select("p_id", "new_id")


# ---- what stands around the files -------------------------------------------------------------------


@query("SELECT doc_id, 'question: ' || source || ' title: ' || lang || ' context: ' || text AS text FROM documents")
def reader_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", T.reader_text(F.col("source"), F.col("lang"), F.col("text")).alias("text"))


@query("SELECT p_partkey, p_name || '   .   ' || p_type AS head, ltrim(substr(p_name || '. .' || p_brand, len(p_name) + 1), '. ') AS rest FROM part")
def text_parts(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    whole = F.concat_ws("   .   ", "p_name", "p_type", "p_brand")
    return part.select("p_partkey", T.first_two_parts(whole).alias("head"), T.suffix_after(F.concat("p_name", F.lit(". ."), "p_brand"), F.col("p_name")).alias("rest"))


@query(
    """WITH p AS (SELECT p_partkey, p_name || ' (' || p_type || ')' AS x FROM part)
    SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(x, '[()]', '', 'g'), ' '), lambda w: w <> ''), '_') AS relation, replace(replace(trim(regexp_replace(x, '[()"]', '', 'g')), ',', ' '), '_', ' ') AS node FROM p"""
)
def graph_names(spark, sf_dir):
    x = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return load(spark, sf_dir, "part").select("p_partkey", T.relation_name(x).alias("relation"), T.node_name(x).alias("node"))


@query("""SELECT p_partkey, '"' || replace(p_name || ' "x"', '"', '""') || '","' || replace(p_type, '"', '""') || '"' AS line FROM part""")
def quoted_csv(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", K.quoted_csv([F.concat("p_name", F.lit(' "x"')), F.col("p_type")]).alias("line"))


@query(
    """SELECT n_nationkey, '<h2>' || n_nationkey || '. ' || n_name || ' &lt;&amp;&gt;</h2><table><tr><th>name</th><th>region</th></tr><tr><td>' || n_name || '</td><td>' || n_regionkey || '</td></tr></table>' AS page FROM nation"""
)
def html_page(spark, sf_dir):
    cells = F.array(F.array("n_name", F.col("n_regionkey").cast("string")))
    page = K.html_page(F.col("n_nationkey"), F.concat("n_name", F.lit(" <&>")), F.array(F.lit("name"), F.lit("region")), cells)
    return load(spark, sf_dir, "nation").select("n_nationkey", page.alias("page"))


@query(f"WITH {ROWS} SELECT replace(title, '/', ' ') || '-' || split_part(table_id, '-', -1) || '.csv' AS file, '\"' || array_to_string(any_value(names), '\",\"') || '\"\n' || string_agg('\"' || array_to_string(vals, '\",\"') || '\"', '\n' ORDER BY row) AS text FROM trows GROUP BY table_id, title")
def csv_texts(spark, sf_dir):
    return K.csv_texts(all_tables(spark, sf_dir))


@query("SELECT quality AS qid, array_to_string(list_sort(coalesce(list(doc_id::VARCHAR) FILTER (toxic = 1), [])), ',') AS gold FROM labels GROUP BY quality")
def relevance_lists(spark, sf_dir):
    judged = load(spark, sf_dir, "labels").select(F.col("quality").alias("qid"), F.col("doc_id").cast("string").alias("table_id"), F.col("toxic").alias("label"))
    return S.relevance_lists(judged).select("qid", F.array_join("gold", ",").alias("gold"))


@query("SELECT doc_id FROM documents ORDER BY md5('sample/' || doc_id), doc_id LIMIT 50")
def sample_n(spark, sf_dir):
    """A sample of n rows is the feature here."""
    return P.exact_sample(load(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50)


def _rouge_sql(n: int) -> str:
    w = "list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> '')"
    side = lambda x: f"(SELECT sid, g, count(*) AS c FROM (SELECT sid, unnest(list_transform(range(1, greatest(len({w.format(x=x)}) - {n - 2}, 1)), lambda i: array_to_string(({w.format(x=x)})[i:i + {n - 1}], ' '))) AS g FROM pp) GROUP BY ALL)"
    return f"""WITH {_PAIRS_OF_PARTS}, s AS (SELECT sid, sum(least(coalesce(h.c, 0), coalesce(r.c, 0))) AS hit, sum(h.c) AS hn, sum(r.c) AS rn FROM {side('hyp')} h FULL JOIN {side('ref')} r USING (sid, g) GROUP BY sid),
      m AS (SELECT sid, coalesce(hit / hn, 0) AS p, coalesce(hit / rn, 0) AS q FROM s) SELECT sid, round(p, 6)::DOUBLE AS precision, round(q, 6)::DOUBLE AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6)::DOUBLE AS f1 FROM m"""


@query(_rouge_sql(1))
def rouge_1(spark, sf_dir):
    return M.rouge_n(_part_pairs(spark, sf_dir), 1)


@query(_rouge_sql(2))
def rouge_2(spark, sf_dir):
    return M.rouge_n(_part_pairs(spark, sf_dir), 2)


_SUBSEQUENCE = "list_reduce(list_prepend(list_transform(r, lambda y: 0), list_transform(h, lambda x: list_transform(r, lambda y: (x = y)::INT))), lambda row, hit: list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(row[i], coalesce(row[i - 1], 0) + hit[i])))))[-1]"


@query(
    f"WITH {_PAIRS_OF_PARTS}, w AS (SELECT sid, list_filter(regexp_split_to_array(lower(hyp), '\\s+'), lambda t: t <> '') AS h, list_filter(regexp_split_to_array(lower(ref), '\\s+'), lambda t: t <> '') AS r FROM pp) SELECT sid, round(2.0::DOUBLE * {_SUBSEQUENCE} / (len(h) + len(r)), 6) AS f1 FROM w"
)
def rouge_l(spark, sf_dir):
    return _part_pairs(spark, sf_dir).select("sid", F.round(U.rouge_l("hyp", "ref"), 6).alias("f1"))


_TOKENS = "regexp_extract_all(lower({x}), '([\\p{{L}}\\p{{N}}\\p{{M}}]+)|([^\\p{{Z}}\\p{{C}}])')"


@query(
    f"""WITH {BM25}, a AS (SELECT item_id AS qid, chr(31) || array_to_string(({_TOKENS.format(x='text')})[1:4], chr(31)) || chr(31) AS phrase FROM benchmark),
    h AS (SELECT qid, min(rank) FILTER (strpos(chr(31) || array_to_string({_TOKENS.format(x='d.text')}, chr(31)) || chr(31), phrase) > 0) AS spot FROM bm JOIN a USING (qid) JOIN documents d ON d.doc_id = bm.p_id WHERE rank <= 20 GROUP BY qid)
    SELECT k, count(*) FILTER (spot <= k)::BIGINT AS questions FROM h, range(1, 21) AS t(k) GROUP BY k"""
)
def answer_text_curve(spark, sf_dir):
    """How many questions have their first four tokens in a passage among the first k by words."""
    items = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array(F.array_join(F.slice(T.simple_tokens(F.col("text")), 1, 4), " ")).alias("answers"))
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_id"), "text")
    return M.hit_curve(M.answered(worded(spark, sf_dir, 20), texts, items), 20)


@query(f"WITH {SCORED}, b AS (SELECT qid, table_id, max(score) AS score FROM retr GROUP BY ALL) SELECT qid, table_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, table_id)::INT AS place FROM b")
def table_scores(spark, sf_dir):
    return R.table_scores(retrieved(spark, sf_dir)).select("qid", "table_id", "score", "place")


@query(f"WITH {SCORED} SELECT qid, string_agg(p_id || ':' || table_id, ',' ORDER BY rank) AS ctxs FROM retr GROUP BY qid")
def nested_contexts(spark, sf_dir):
    nested = V.nested_contexts(retrieved(spark, sf_dir))
    return nested.select("qid", F.array_join(F.transform("ctxs", lambda c: F.concat_ws(":", c["p_id"].cast("string"), c["table_id"].cast("string"))), ",").alias("ctxs"))


@query("WITH v AS (SELECT vec_id // 5 AS qid, vec_id AS table_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.qid, round(avg(list_inner_product(a.v, b.v)), 6) AS reg FROM v a JOIN v b ON a.qid = b.qid AND a.table_id < b.table_id GROUP BY a.qid")
def graph_regulariser(spark, sf_dir):
    """Five tables a question."""
    v = load(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("qid"), F.col("vec_id").alias("table_id"), F.col("embedding").cast("array<double>").alias("v"))
    return E.graph_regulariser(v)


_SOFT = "list_transform({x}, lambda v: exp(v{t}) / list_sum(list_transform({x}, lambda u: exp(u{t}))))"


@query(
    f"""WITH e AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS t, embedding[33:64]::DOUBLE[] AS s FROM embeddings),
    p AS (SELECT vec_id, {_SOFT.format(x='t', t=' / 2')} AS pt, {_SOFT.format(x='s', t=' / 2')} AS ps, {_SOFT.format(x='s', t='')} AS s1 FROM e)
    SELECT vec_id, round(0.7 * 4 * list_sum(list_transform(range(1, 33), lambda i: pt[i] * ln(pt[i] / ps[i]))) - 0.3 * ln(s1[3]), 6)::DOUBLE AS loss FROM p"""
)
def distillation_loss(spark, sf_dir):
    """A teacher's and a student's scores of 32 passages: the two halves of a vector."""
    of = lambda lo: F.slice(F.col("embedding").cast("array<double>"), lo, 32)
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(E.distillation_loss(of(1), of(33), 2.0, 0.7, F.lit(2)), 6).alias("loss"))


@query("SELECT conv_id * 100 + turn AS sid, round(-(0.9 * ln(p) + 0.1 / 4 * (ln(p) + 3 * ln((1 - p) / 3))), 6) AS loss FROM (SELECT conv_id, turn, 0.5 + 0.4 * (turn % 5) / 5 AS p FROM conversations)")
def smoothed_loss(spark, sf_dir):
    p = 0.5 + 0.4 * (F.col("turn") % 5) / 5
    logs = F.array(F.log(p), *[F.log((1 - p) / 3)] * 3)
    return load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sid"), F.round(E.smoothed_loss(logs, F.lit(0), 0.1), 6).alias("loss"))
