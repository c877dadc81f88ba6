"""Text expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: markup of the interchange formats
TITLE, SUB_NAME, SUB, OBJ_NAME, OBJ = "[_T_]", "[_SC_]", "[_S_]", "[_OC_]", "[_O_]"
AGGREGATES = ["", "MAX", "MIN", "COUNT", "SUM", "AVG"]
OPERATORS = ["=", ">", "<"]
OPERATOR_WORDS = ["EQ", "GT", "LT"]


def tag(word: str) -> str:
    """MAX -> [M-A-X]"""
    return "[" + "-".join(word.upper()) + "]"


def meta_tags() -> list[str]:
    """The vocabulary of query markup."""
    return [tag(w) for w in ("SELECT", *AGGREGATES[1:], *OPERATOR_WORDS, "WHERE", "AND")]


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def quote_wrap(x: Column) -> Column:
    """A text of several words between quotes and spaces."""
    s = strip(x)
    return F.when(F.size(words(s)) > 1, F.concat(F.lit('" '), s, F.lit(' "'))).otherwise(s)


def none_to_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def annotated(title: Column, sub_name: Column, sub: Column, obj_name: Column, obj: Column) -> Column:
    """A triple as plain text; null subject parts count as empty."""
    left = strip(F.concat(none_to_empty(sub_name), F.lit("  "), none_to_empty(sub)))
    right = strip(F.concat(obj_name, F.lit("  "), obj))
    return F.concat(title, F.lit(" , "), left, F.lit(" , "), right, F.lit(" ; "))


def tagged(title: Column, sub_name: Column, sub: Column, obj_name: Column, obj: Column) -> Column:
    return F.concat_ws(" ", F.lit(TITLE), title, F.lit(SUB_NAME), none_to_empty(sub_name), F.lit(SUB), none_to_empty(sub), F.lit(OBJ_NAME), obj_name, F.lit(OBJ), obj)


def untagged(title: Column, sub_name: Column, sub: Column, obj_name: Column, obj: Column) -> Column:
    subject = F.when(sub_name.isNull(), F.lit("")).otherwise(F.concat(sub_name, F.lit(" , "), sub, F.lit(" , ")))
    return F.concat(title, F.lit(" , "), subject, obj_name, F.lit(" , "), obj, F.lit(" . "))


def occurs_less_than_twice(x: Column, part: str) -> Column:
    escaped = "(?=" + "".join("\\" + c if not c.isalnum() else c for c in part) + ")"
    return F.regexp_count(x, F.lit(escaped)) < 2


def row_text(title: Column, names: Column, values: Column) -> Column:
    parts = F.zip_with(names, values, lambda n, v: F.concat(F.lit(" , "), n, F.lit(" "), v))
    return F.concat(title, F.array_join(parts, ""))


def slide_tag(title: Column, names: Column, values: Column, columns: Column) -> Column:
    parts = F.transform(columns, lambda c: F.concat(F.lit(" [CH] "), F.get(names, c), F.lit(" [C] "), F.get(values, c)))
    return F.concat(F.lit("[T] "), title, F.array_join(parts, ""))


def sql_text(names: Column, sel: Column, agg: Column, conds: Column) -> Column:
    """conds: array of (col, op, value); a null col is the table's title."""
    tags = F.array(*(F.lit(tag(a)) if a else F.lit("") for a in AGGREGATES))
    ops = F.array(*(F.lit(tag(o)) for o in OPERATOR_WORDS))
    cond = F.transform(conds, lambda c: F.concat_ws(" ", F.when(c["col"].isNull(), F.lit("about")).otherwise(F.get(names, c["col"])), F.get(ops, c["op"]), c["value"]))
    head = F.when(agg == 0, F.concat_ws(" ", F.lit(tag("SELECT")), F.get(names, sel))).otherwise(F.concat_ws(" ", F.lit(tag("SELECT")), F.get(tags, agg), F.get(names, sel)))
    return F.concat_ws(" ", head, F.lit(tag("WHERE")), F.array_join(cond, f" {tag('AND')} "))


def token_size(x: Column) -> Column:
    """Words and single other characters."""
    return F.regexp_count(F.lower(x), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def truncate_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(words(x), 1, n), " ")


def answer_normal(x: Column) -> Column:
    """Lower case without punctuation and articles, single spaces."""
    bare = F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(words(F.regexp_replace(bare, r"\b(a|an|the)\b", " ")), " ")


def eval_normal(x: Column) -> Column:
    """Lower case, with spaces about every character that is no letter, digit or underscore of any script."""
    return F.lower(F.array_join(F.filter(F.split(F.regexp_replace(x, r"([^\p{L}\p{N}_])", " $1 "), r"(?U)\s+"), lambda t: t != ""), " "))


def question_rewrite(x: Column) -> Column:
    asks = F.arrays_overlap(F.split(F.lower(x), " "), F.array(F.lit("what"), F.lit("when"), F.lit("how")))
    return F.when(asks, x).otherwise(F.concat(x, F.lit(" is about what ?")))


def reader_text(question: Column, title: Column, passage: Column) -> Column:
    return F.concat(F.lit("question: "), question, F.lit(" title: "), title, F.lit(" context: "), passage)


def camel_split(x: Column) -> Column:
    """Words of a camelCase or snake_case name."""
    apart = F.regexp_replace(F.regexp_replace(x, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_"), r"\(", "")
    return F.split(apart, "_")


def comma_spacing(x: Column) -> Column:
    """A comma between digits goes, others get spaces."""
    return F.regexp_replace(F.regexp_replace(x, r"(?<=[0-9]),(?=[0-9])", ""), ",", " , ")


def is_float(x: Column) -> Column:
    """Digits, a point and digits: the decimals are required."""
    return x.rlike(r"^(?U)-?\d+\.\d+$")


def nbsp_to_space(x: Column) -> Column:
    return F.translate(x, " ", " ")


def nullable_int(x: Column) -> Column:
    return F.nullif(x, F.lit("None")).try_cast("int")


def simple_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}\p{M}]+)|([^\p{Z}\p{C}])"), F.lit(0))


def without_span(x: Column, start: str, end: str) -> Column:
    """Without the part from the first start tag to the last end tag; unchanged if either is missing."""
    lo, hi = F.instr(x, start), F.length(x) - F.instr(F.reverse(x), F.lit(end[::-1])) + 2
    whole = (lo > 0) & (F.instr(x, end) > 0) & (hi > lo)
    return F.when(whole, F.concat(x.substr(F.lit(1), lo - 1), x.substr(hi, F.length(x)))).otherwise(x)


def with_spans_replaced(x: Column, subject: Column, object_: Column, tags: tuple[str, str, str, str]) -> Column:
    """The marked subject and object replaced by others, each from its first start tag to its last end tag. tags: start and end of the subject, then of the object.

    A mark that is not there whole leaves its part as it is; a null replacement removes the span."""
    for new, start, end in ((subject, *tags[:2]), (object_, *tags[2:])):
        lo, hi = F.instr(x, start), F.length(x) - F.instr(F.reverse(x), F.lit(end[::-1])) + 2
        whole = (lo > 0) & (F.instr(x, end) > 0) & (hi - len(end) >= lo + len(start))
        x = F.when(whole, F.concat(x.substr(F.lit(1), lo - 1), F.coalesce(new, F.lit("")), x.substr(hi, F.length(x)))).otherwise(x)
    return x


def title_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.csv$", 1)


def first_two_parts(x: Column) -> Column:
    return F.array_join(F.slice(F.split(x, r"   \.   "), 1, 2), "   .   ")


def suffix_after(x: Column, prefix: Column) -> Column:
    """What follows a prefix, without leading points and spaces."""
    return F.regexp_replace(x.substr(F.length(prefix) + 1, F.length(x)), r"^[. ]+", "")


def natural_question(cls: Column, subject: Column, relation: Column) -> Column:
    return F.concat(cls, F.lit(" "), subject, F.lit(" is "), relation, F.lit(" who or what ?"))


def relation_name(x: Column) -> Column:
    return F.array_join(words(F.regexp_replace(x, r"[()]", "")), "_")


def node_name(x: Column) -> Column:
    return F.translate(F.regexp_replace(strip(x), r'[()"]', ""), ",_", "  ")
