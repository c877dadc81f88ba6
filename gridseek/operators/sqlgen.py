"""Single-table queries: sampling, text, deduplication and execution.

A sampled query is a row: qid, table_id, row, sel, agg, conds (array of (col, op, value); a null col is
the title), sql_text. All random choices are digits of md5 over a seed and the draw's number, so a draw is
the same in every run and needs no state: any number of draws are made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridseek.functions import text as T
from gridseek.sources.tables import dense_ids


#: Rows that a draw names before it goes through its whole table.
ATTEMPTS = 8
#: Parts of a table's rows where queries without an equality on text meet all of them.
PARTS = 16


def _draw(what: str, seed: str) -> Column:
    """A number below 2^40 for a named choice of draw `i`."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.lit(what), F.col("i").cast("string"))), 1, 10), 16, 10).cast("long")


def _ordered(items: Column, what: str, seed: str) -> Column:
    """Items in an order drawn for each draw: without replacement, take the first ones."""
    keyed = F.transform(items, lambda x: F.struct(F.md5(F.concat_ws("/", F.lit(seed), F.lit(what), F.col("i").cast("string"), x.cast("string"))).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def _drawn_rows(d: DataFrame, rows: DataFrame, seed: str) -> DataFrame:
    """(i, row, vals): for each draw a row of its table whose cells at `at` are all filled, each as likely as the others.

    A draw names ATTEMPTS row numbers and takes the first that will do, so it meets single rows, not its whole table.
    Only draws of which none will do (mostly empty columns) go through the table: the least by md5."""
    place = lambda j: F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.lit("row"), F.col("i").cast("string"), j.cast("string"))), 1, 10), 16, 10).cast("long")
    filled = F.forall("at", lambda c: F.coalesce(F.get("vals", c), F.lit("")) != "")
    slim = rows.select("table_id", F.col("row").cast("long").alias("row"), "vals")
    sized = d.join(slim.groupBy("table_id").agg((F.max("row") + 1).alias("n")), "table_id")
    tries = sized.select("i", "table_id", "at", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), lambda j: place(j) % F.col("n"))).alias("nth", "row"))
    first = tries.join(slim, ["table_id", "row"]).filter(filled).groupBy("i").agg(F.min(F.struct("nth", "row", "vals")).alias("m")).select("i", "m.row", "m.vals").persist()
    whole = d.join(first.select("i"), "i", "left_anti").join(slim, "table_id").filter(filled)
    rest = whole.groupBy("i").agg(F.min(F.struct(place(F.concat(F.lit("all/"), F.col("row").cast("string"))).alias("k"), "row", "vals")).alias("m")).select("i", "m.row", "m.vals")
    return first.union(rest).select("i", F.col("row").cast("int").alias("row"), "vals")


def sample_queries(rows: DataFrame, types: DataFrame, draws: int, seed: str = "sql", hi: float | None = None) -> DataFrame:
    """Queries from `draws` draws; draws that give no condition are rejected. types: table_id, col, col_name, type of the fit columns.

    hi: the size above which a condition's value is dropped."""
    spark = rows.sparkSession
    tables = types.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col", "type"))).alias("cols"))
    meta = rows.groupBy("table_id").agg(F.first("title").alias("title"), F.first("names").alias("names"))
    tables = tables.join(meta, "table_id")
    numbered = dense_ids(tables, ["table_id"], "t", 0)
    d = spark.range(draws).withColumnRenamed("id", "i")
    n = tables.count()
    d = d.withColumn("t", _draw("table", seed) % max(n, 1)).join(numbered, "t")
    pick = F.get("cols", (_draw("sel", seed) % F.size("cols")).cast("int"))
    d = d.withColumn("sel", pick["col"]).withColumn("agg", F.when(pick["type"] == "float", _draw("agg", seed) % 5 + 1).otherwise(0).cast("int"))
    wanted = F.when(F.col("title") != "", _draw("conds", seed) % 4).otherwise(_draw("conds", seed) % 3 + 1).cast("int")
    others = F.transform(F.filter("cols", lambda c: c["col"] != F.col("sel")), lambda c: c["col"])
    d = d.withColumn("at", F.slice(_ordered(others, "cols", seed), F.lit(1), wanted))
    d = d.persist()  # a row a draw, read three times
    d = d.join(_drawn_rows(d.select("i", "table_id", "at"), rows, seed), "i").persist()
    kinds = F.map_from_entries("cols")
    cond = F.transform(
        "at",
        lambda c: F.struct(
            c.alias("col"),
            F.when(F.element_at(kinds, c) == "float", F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.lit("op"), F.col("i").cast("string"), c.cast("string"))), 1, 10), 16, 10).cast("long") % 3).otherwise(0).cast("int").alias("op"),
            F.get("vals", c).alias("value"),
        ),
    )
    if hi is not None:
        cond = F.filter(cond, lambda c: T.token_size(c["value"]) <= hi)
    d = d.withColumn("conds", cond)
    about = F.struct(F.lit(None).cast("int").alias("col"), F.lit(0).alias("op"), F.col("title").alias("value"))
    with_title = (F.col("title") != "") & ((F.size("at") == 0) | ((F.size("conds") > 0) & (_draw("title", seed) % (1 + F.size("conds")) == 0)))
    d = d.withColumn("conds", F.when(with_title, F.concat("conds", F.array(about))).otherwise(F.col("conds"))).filter(F.size("conds") > 0)
    text = T.sql_text(F.col("names"), F.col("sel"), F.col("agg"), F.col("conds"))
    return d.select(F.concat(F.lit("train_"), F.col("i").cast("string")).alias("qid"), "table_id", F.when(F.size("at") > 0, F.col("row")).alias("row"), "sel", "agg", "conds", text.alias("sql_text"))


def new_queries(queries: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One query for each text whatever its case (the least qid), none that history (key) has."""
    keyed = queries.withColumn("key", F.lower("sql_text"))
    first = keyed.groupBy("key").agg(F.min_by(F.struct(*queries.columns), "qid").alias("q")).select("key", "q.*")
    return first if history is None else first.join(history.select("key"), "key", "left_anti")


def _rounded(x: Column, digits: int) -> Column:
    """As SQL engines round doubles: the scaled double to the nearest whole, halves away from zero; Spark's own goes by the decimal digits."""
    r = F.round(x * 10.0**digits) / 10.0**digits
    return F.when(F.isnan(r) | (F.abs(r) == float("inf")), x).otherwise(r)


def _ranged(asked: DataFrame, cell: DataFrame, same: list[str]) -> DataFrame:
    """(*same, m1 ... m5): aggregates over the rows that meet an equality (table_id, c, value) and one inequality (rc, op, b) on a number.

    Rows and queries of a group stand in one order of the number, and a query takes what has run up to its place, so the
    cost follows rows and queries, not their pairs."""
    group = ["table_id", "c", "value", "rc", "sel", "op"]
    y = lambda x: F.when(F.col("op") == 2, x).when(F.isnan(x), float("-inf")).otherwise(-x) + 0.0
    first = lambda x, nan, kind: F.when((F.col("op") == 1) & F.isnan(x), nan).otherwise(kind)
    x = F.get("vals", F.col("rc")).try_cast("double")
    rows = cell.join(asked.select(*group).distinct().hint("merge"), ["table_id", "c", "value"]).withColumn("x", x).filter("x IS NOT NULL")
    data = rows.select(*group, y(F.col("x")).alias("y"), first(F.col("x"), -1, 1).alias("kind"), F.lit(1).alias("row"), F.get("vals", F.col("sel")).alias("v"))
    ends = asked.filter("b IS NOT NULL").select(*group, y(F.col("b")).alias("y"), first(F.col("b"), -2, 0).alias("kind"), F.struct("agg", "conds").alias("ask"))
    upto = Window.partitionBy(*group).orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = F.col("v").try_cast("double")
    out = data.unionByName(ends, allowMissingColumns=True).withColumns({"n": F.count("row").over(upto), "m1": F.max(v).over(upto), "m2": F.min(v).over(upto), "m3": F.count("v").over(upto), "m4": F.sum(v).over(upto), "m5": F.avg(v).over(upto)})
    return out.filter("ask IS NOT NULL AND n > 0").select("table_id", "sel", "ask.agg", "ask.conds", *(f"m{i}" for i in range(1, 6))).select(*same, *(f"m{i}" for i in range(1, 6)))


#: Queries that meet one copy of the rows of their equality.
ASKS = 1024


def _listed(asks: DataFrame, cell: DataFrame) -> DataFrame:
    """(qid, result): values in the order of rows that meet an equality (table_id, c, value) and one inequality (rc, op, b) on a number.

    The rows of an equality are put in order once, about ASKS queries meet a copy of them, and a query's values are filtered
    and joined where it lies: neither pairs of query and row nor results are shuffled. What a task holds at a time is such
    a list, the longest result there can be."""
    group = ["table_id", "c", "value", "rc", "sel"]
    sizes = asks.groupBy(*group).agg(F.ceil(F.count("*") / ASKS).alias("copies"))
    rows = cell.join(sizes.hint("merge"), ["table_id", "c", "value"]).select(*group, "copies", F.struct("r", F.get("vals", F.col("rc")).try_cast("double").alias("x"), F.get("vals", F.col("sel")).alias("v")).alias("s"))
    lists = rows.filter("s.x IS NOT NULL").groupBy(*group, "copies").agg(F.array_sort(F.collect_list("s")).alias("s"))
    copies = lists.select(*group, "s", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    dealt = asks.join(sizes.hint("merge"), group).withColumn("copy", 1 + F.pmod(F.xxhash64("qid"), "copies")).drop("copies")
    b = F.col("b")
    hit = F.when(F.col("op") == 1, F.filter("s", lambda y: y["x"] > b)).otherwise(F.filter("s", lambda y: y["x"] < b))
    met = dealt.join(copies.hint("merge"), [*group, "copy"]).select("qid", hit.alias("hit")).filter("size(hit) > 0")
    return met.select("qid", F.array_join(F.transform("hit", lambda y: y["v"]), "|").alias("result"))


#: Distinct equalities that travel to all cells, which are then filtered where they lie.
KEYS = 10_000


def execute(queries: DataFrame, rows: DataFrame, types: DataFrame) -> DataFrame:
    """(qid, result): text columns by equality, float columns by number; without an aggregate the values in the order of rows.

    Queries that ask alike are answered once. Of the equalities on text columns, the one that the fewest rows meet is looked
    up by an equi-join on (table, column, value) and the other conditions are checked within the row; an aggregate with
    one inequality beside it is read off running aggregates in the order of the number; queries without any equality meet
    their table in PARTS parts. Only queries without an aggregate gather their values, which are the result.
    Numbers have four digits, rounded from nine, so that the order in which they are summed doesn't show.
    Neither rows nor queries go through the driver: a file's bytes say little of what its cells hold, so joins with what grows
    are merged whatever is estimated, and only KEYS equalities at most, which are counted, are broadcast."""
    kinds = types.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "type"))).alias("kinds"))
    same = ["table_id", "sel", "agg", "conds"]
    asked = queries.select(*same).distinct().join(kinds.hint("merge"), "table_id")
    text_kind = lambda c: c["col"].isNotNull() & (c["op"] == 0) & F.coalesce(F.element_at("kinds", c["col"]) != "float", F.lit(True))
    asked = asked.withColumn("by", F.filter("conds", text_kind))
    slim = rows.select("table_id", F.col("row").alias("r"), "title", "vals")
    cell = slim.select("*", F.posexplode("vals").alias("c", "value"))
    each = asked.filter("size(by) > 0").select(*same, "kinds", F.explode("by").alias("b")).select(*same, "kinds", F.col("b.col").alias("c"), F.col("b.value").alias("value"))
    key = ["table_id", "c", "value"]
    equal = queries.select("table_id", F.explode(F.filter("conds", lambda c: c["col"].isNotNull() & (c["op"] == 0))).alias("b")).select("table_id", "b.col", "b.value")
    few = equal.distinct().limit(KEYS + 1).count() <= KEYS
    wanted = each.select(*key).distinct()
    cell = cell.join(F.broadcast(wanted) if few else wanted.hint("merge"), key, "left_semi")
    often = cell.groupBy(*key).agg(F.count("*").alias("times"))
    rarest = each.join(often.hint("merge"), key).groupBy(*same).agg(F.min(F.struct("times", "c", "value")).alias("k"), F.first("kinds").alias("kinds"))
    number = F.filter("conds", lambda c: c["col"].isNotNull() & c["op"].isin(1, 2) & F.coalesce(F.element_at("kinds", c["col"]) == "float", F.lit(False)))
    rarest = rarest.select(*same, "kinds", "k.c", "k.value").withColumn("number", number)
    in_order = (F.col("agg") > 0) & (F.size("conds") == 2) & (F.size("number") == 1)  # the other one is the equality
    ordered = rarest.filter(in_order).select(*same, "c", "value", F.get("number", F.lit(0))["col"].alias("rc"), F.get("number", F.lit(0))["op"].alias("op"), F.get("number", F.lit(0))["value"].try_cast("double").alias("b"))
    titled = rows.groupBy("table_id").agg(F.min(F.lower(T.strip(F.col("title")))).alias("t"), F.max(F.lower(T.strip(F.col("title")))).alias("last"), F.count_if(F.col("title").isNull()).alias("none")).filter("t = last AND none = 0").select("table_id", "t")
    about = F.filter("conds", lambda c: c["col"].isNull())
    rarest = rarest.join(titled.hint("merge"), "table_id", "left").withColumn("in_list", F.coalesce((F.col("agg") == 0) & F.col("t").isNotNull() & (F.size("number") == 1) & (F.size("conds") == 2 + F.size(about)), F.lit(False)))
    by_list = rarest.filter("in_list").filter(F.forall(about, lambda c: F.coalesce(F.lower(T.strip(c["value"])) == F.col("t"), F.lit(False))))
    listed_asks = by_list.select(*(F.col(c).alias(f"_{c}") for c in same), "c", "value", F.get("number", F.lit(0))["col"].alias("rc"), F.get("number", F.lit(0))["op"].alias("op"), F.get("number", F.lit(0))["value"].try_cast("double").alias("b"))
    rarest = rarest.filter("NOT in_list").drop("t", "in_list")
    looked = cell.join(rarest.filter(~in_order).drop("number").hint("merge"), key).drop("c", "value")
    part = F.pmod(F.xxhash64("r"), F.lit(PARTS))
    free = asked.filter("size(by) = 0").drop("by").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    met = slim.withColumn("part", part).join(free.hint("merge"), ["table_id", "part"]).drop("part")

    def holds(c: Column) -> Column:
        cell, number = F.get("vals", c["col"]), F.element_at("kinds", c["col"]) == "float"
        a, b = cell.try_cast("double"), c["value"].try_cast("double")
        as_number = F.when(c["op"] == 0, a == b).when(c["op"] == 1, a > b).otherwise(a < b)
        return F.when(c["col"].isNull(), F.lower(T.strip(c["value"])) == F.lower(T.strip(F.col("title")))).when(number, as_number).otherwise(cell == c["value"])

    hit = looked.unionByName(met).filter(F.forall("conds", lambda c: F.coalesce(holds(c), F.lit(False)))).withColumn("v", F.get("vals", F.col("sel")))
    x = F.col("v").try_cast("double")
    listed = F.collect_list(F.when(F.col("agg") == 0, F.struct("r", "v")))
    sums = hit.groupBy(*same).agg(F.max(x).alias("m1"), F.min(x).alias("m2"), F.count("v").alias("m3"), F.sum(x).alias("m4"), F.avg(x).alias("m5"), F.array_sort(listed).alias("vs"))
    sums = sums.unionByName(_ranged(ordered, cell, same), allowMissingColumns=True)
    text = F.when(F.col("agg") == 0, F.array_join(F.transform("vs", lambda s: s["v"]), "|"))
    for i in range(1, 6):
        value = F.col(f"m{i}").cast("string") if i == 3 else F.format_string("%.4f", _rounded(_rounded(F.col(f"m{i}"), 9), 4))
        text = text.when(F.col("agg") == i, value)
    found = sums.select(*(F.col(c).alias(f"_{c}") for c in same), text.alias("result"))
    alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    asks = queries.select("qid", *same).join(listed_asks.hint("merge"), alike).select("qid", "table_id", "sel", "c", "value", "rc", "op", "b")
    return queries.select("qid", *same).join(found.hint("merge"), alike).select("qid", "result").union(_listed(asks, cell))


def verbalised(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(qid, question): a plain English reading of each query, in place of a text generator."""
    names = rows.groupBy("table_id").agg(F.first("names").alias("names"))
    words = F.array(*map(F.lit, ("", "largest", "smallest", "number of", "total", "average")))
    signs = F.array(*map(F.lit, ("is", "is more than", "is less than")))
    cond = F.transform("conds", lambda c: F.when(c["col"].isNull(), F.concat(F.lit("about "), c["value"])).otherwise(F.concat_ws(" ", F.get("names", c["col"]), F.get(signs, c["op"]), c["value"])))
    head = F.concat_ws(" ", F.lit("what is the"), F.nullif(F.get(words, F.col("agg")), F.lit("")), F.get("names", F.col("sel")), F.lit("where"))
    return queries.join(names, "table_id").select("qid", F.concat(head, F.lit(" "), F.array_join(cond, " and "), F.lit(" ?")).alias("question"))
