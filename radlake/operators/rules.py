"""Rule engine: predicates on tags, ordered AND/OR folds over rules and rule sets, assignment.

Rules are configuration. Up to MOST of them are compiled: each tag and each
different predicate becomes a column, folds become AND and OR of these, so that
a series is judged inside generated code, without a shuffle. More rules than that
come as one row that meets every series, and the folds run over its arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Rules and groups that are compiled.
MOST = 2000
_NUMBER = r"(?i)^\s*[+-]?(\d+(\.\d*)?|\.\d+|inf|infinity|nan)(e[+-]?\d+)?\s*$"


def number(value: Column) -> Column:
    """The number a text stands for, else null."""
    return F.when(value.rlike(_NUMBER), F.trim(value).try_cast("double"))


def satisfied(operator: Column, tag: Column, value: Column) -> Column:
    """Whether a tag's text meets a rule. A missing tag or an unknown operator never does."""
    x, y = number(tag), number(value)
    real = ~F.isnan(x) & ~F.isnan(y)
    a, b = F.lower(tag), F.lower(value)
    out = (
        F.when(operator == "GREATER_THAN", real & (x > y)).when(operator == "LESS_THAN", real & (x < y))
        .when(operator == "GREATER_THAN_OR_EQUAL_TO", real & (x >= y)).when(operator == "LESS_THAN_OR_EQUAL_TO", real & (x <= y))
        .when(operator.isin("EQUALS", "CASE_SENSITIVE_STRING_EXACT_MATCH"), tag == value).when(operator == "NOT_EQUALS", tag != value)
        .when(operator == "CASE_INSENSITIVE_STRING_EXACT_MATCH", a == b)
        .when(operator == "CASE_SENSITIVE_STRING_CONTAINS", tag.contains(value)).when(operator == "CASE_INSENSITIVE_STRING_CONTAINS", a.contains(b))
        .when(operator == "CASE_SENSITIVE_STRING_DOES_NOT_CONTAIN", ~tag.contains(value)).when(operator == "CASE_INSENSITIVE_STRING_DOES_NOT_CONTAIN", ~a.contains(b))
    )
    return F.coalesce(out, F.lit(False))


def fold(results: Column, ordered: bool = False) -> Column:
    """Left fold of an array of (order, id, result, combine) by its order: the combinator before an element joins it.

    Empty is false; so is a join by an unknown combinator. ordered: the array is
    sorted already.
    """

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["combine"].isNull(), x["result"]).when(acc["combine"] == "AND", acc["value"] & x["result"]).when(acc["combine"] == "OR", acc["value"] | x["result"]).otherwise(False)
        return F.struct(joined.alias("value"), F.coalesce(x["combine"], F.lit("")).alias("combine"))

    start = F.struct(F.lit(False).alias("value"), F.lit(None).cast("string").alias("combine"))
    return F.aggregate(results if ordered else F.array_sort(results), start, step)["value"]


def _rule_sets(rules: DataFrame) -> DataFrame:
    """One row: rule_sets, an array of (set_id, its rules in order). Rules are configuration entered by hand."""
    rule = F.struct("rule_order", "rule_id", "tag_name", "tag_id", "operator", "value", "combine")
    return rules.groupBy("set_id").agg(F.array_sort(F.collect_list(rule)).alias("rules")).agg(F.collect_list(F.struct("set_id", "rules")).alias("rule_sets"))


def _set_results() -> Column:
    """Map of set_id to its fold, from the columns tags and rule_sets."""

    def result(r: Column) -> Column:
        tag = F.coalesce(F.try_element_at("tags", r["tag_name"]), F.try_element_at("tags", r["tag_id"]))
        return F.struct(r["rule_order"].alias("order"), r["rule_id"].alias("id"), satisfied(r["operator"], tag, r["value"]).alias("result"), r["combine"].alias("combine"))

    return F.map_from_entries(F.transform("rule_sets", lambda s: F.struct(s["set_id"], fold(F.transform(s["rules"], result), ordered=True))))


# --- compiled rules ---------------------------------------------------------------------


def _ordered(rows: list[Row], *by: str) -> list[Row]:
    """Sorted as arrays are: nulls last."""
    return sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in by if c is not None])


def _chain(results: list[tuple[Column, str | None]]) -> Column:
    """fold() of results and combinators as an expression."""
    out, how = F.lit(False), None
    for k, (result, combine) in enumerate(results):
        out = result if k == 0 else out & result if how == "AND" else out | result if how == "OR" else F.lit(False)
        how = combine
    return out


def _compared(operator: str | None, tag: Column, real: Column, value: str | None) -> Column:
    """satisfied() for an operator and a value that are known; real: the number that the tag stands for."""
    if operator in ("GREATER_THAN", "LESS_THAN", "GREATER_THAN_OR_EQUAL_TO", "LESS_THAN_OR_EQUAL_TO"):
        y = number(F.lit(value))
        out = {"GREATER_THAN": real > y, "LESS_THAN": real < y, "GREATER_THAN_OR_EQUAL_TO": real >= y, "LESS_THAN_OR_EQUAL_TO": real <= y}[operator] & ~F.isnan(real) & ~F.isnan(y)
        return F.coalesce(out, F.lit(False))
    return satisfied(F.lit(operator), tag, F.lit(value))


class Compiled:
    """Series with a column for each tag and predicate that the rules name, and the rule sets as expressions."""

    def __init__(self, tags: DataFrame, rules: list[Row]):
        pairs = list(dict.fromkeys((r.tag_name, r.tag_id) for r in rules))
        tests = list(dict.fromkeys((r.tag_name, r.tag_id, r.operator, r.value) for r in rules))
        at = {pair: k for k, pair in enumerate(pairs)}
        found = tags.select("series_uid", *[F.coalesce(F.try_element_at("tags", F.lit(n)), F.try_element_at("tags", F.lit(i))).alias(f"_t{k}") for k, (n, i) in enumerate(pairs)])
        # as columns, so that the pattern of a number is looked for once for a tag
        found = found.select("*", *[number(F.col(f"_t{k}")).alias(f"_n{k}") for k in range(len(pairs))])
        self.series = found.select("series_uid", *[_compared(o, F.col(f"_t{at[n, i]}"), F.col(f"_n{at[n, i]}"), v).alias(f"_p{k}") for k, (n, i, o, v) in enumerate(tests)])
        place = {test: k for k, test in enumerate(tests)}
        self.sets: dict[object, Column] = {}
        for set_id in dict.fromkeys(r.set_id for r in rules):
            own = _ordered([r for r in rules if r.set_id == set_id], "rule_order", "rule_id", "tag_name", "tag_id", "operator", "value", "combine")
            self.sets[set_id] = _chain([(F.col(f"_p{place[r.tag_name, r.tag_id, r.operator, r.value]}"), r.combine) for r in own])


def _few(table: DataFrame, *columns: str) -> list[Row] | None:
    """The rows of a table of MOST rows at the most."""
    rows = table.select(*columns).limit(MOST + 1).collect()
    return rows if len(rows) <= MOST else None


_RULE = ("set_id", "rule_order", "rule_id", "tag_name", "tag_id", "operator", "value", "combine")
_SET = ("group_id", "template_id", "set_id", "set_order", "combine")


def match(tags: DataFrame, rules: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(series_uid, groups, matched_groups): per series an array of (group_id, template_id, result, matched_sets), one for each group, and how many are true.

    tags: series_uid, tags (map). rules: set_id, rule_order, rule_id, tag_name,
    tag_id, operator, value, combine. hierarchy: group_id, template_id, set_id,
    set_order, combine. No shuffle of the series. A set without rules is false; a
    set in no group has no effect; a group counts if its fold is true and at least
    one of its sets matched.
    """
    known, places = _few(rules, *_RULE), _few(hierarchy, *_SET)
    if known is None or places is None:
        return _matched_by_rows(tags, rules, hierarchy)
    compiled = Compiled(tags, known)
    types = dict(hierarchy.dtypes)
    typed = lambda c, v: F.lit(v).cast(types[c]).alias(c)
    groups, results = [], []
    for key in dict.fromkeys((r.group_id, r.template_id) for r in places):
        own = _ordered([r for r in places if (r.group_id, r.template_id) == key], "set_order", "set_id", "combine")
        sets = [(compiled.sets.get(r.set_id, F.lit(False)), r.combine) for r in own]
        n = reduce(lambda a, b: a + b, [s.cast("long") for s, _ in sets])
        result = _chain(sets) & (n > 0)
        results.append(result.cast("long"))
        groups.append(F.struct(typed("group_id", key[0]), typed("template_id", key[1]), result.alias("result"), n.alias("matched_sets")))
    none = F.array().cast(f"array<struct<group_id:{types['group_id']},template_id:{types['template_id']},result:boolean,matched_sets:bigint>>")
    count = reduce(lambda a, b: a + b, results, F.lit(0).cast("long"))
    return compiled.series.select("series_uid", (F.array(*groups) if groups else none).alias("groups"), count.alias("matched_groups"))


def evaluate_sets(tags: DataFrame, rules: DataFrame) -> DataFrame:
    """(series_uid, set_id, result) for every series and rule set."""
    known = _few(rules, *_RULE)
    if known is None:
        each = tags.crossJoin(_rule_sets(rules))  # one row on the right
        return each.select("series_uid", F.explode(_set_results()).alias("set_id", "result"))
    kind = dict(rules.dtypes)["set_id"]
    compiled = Compiled(tags, known)
    sets = [F.struct(F.lit(s).cast(kind).alias("set_id"), result.alias("result")) for s, result in compiled.sets.items()]
    none = F.array().cast(f"array<struct<set_id:{kind},result:boolean>>")
    return compiled.series.select("series_uid", F.inline(F.array(*sets) if sets else none))


def _matched_by_rows(tags: DataFrame, rules: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """match() for any number of rules: they come as one row."""
    one = F.struct(F.col("set_order").alias("order"), F.col("set_id").alias("id"), "combine")
    groups = hierarchy.groupBy("group_id", "template_id").agg(F.array_sort(F.collect_list(one)).alias("sets")).agg(F.collect_list(F.struct("group_id", "template_id", "sets")).alias("rule_groups"))
    each = tags.crossJoin(_rule_sets(rules)).crossJoin(groups)  # one row on the right

    def group(sets: Column, g: Column) -> Column:
        results = F.transform(g["sets"], lambda s: F.struct(s["order"], s["id"], F.coalesce(F.try_element_at(sets, s["id"]), F.lit(False)).alias("result"), s["combine"]))
        counted = F.transform(F.array(results), lambda r: F.struct(fold(r, ordered=True).alias("fold"), F.size(F.filter(r, lambda s: s["result"])).cast("long").alias("n")))[0]
        return F.struct(g["group_id"], g["template_id"], counted["fold"].alias("result"), counted["n"].alias("matched_sets"))

    # arrays of one element bind a value to a name, so that it is computed once for a series
    every = F.transform(F.array(_set_results()), lambda sets: F.transform("rule_groups", lambda g: group(sets, g)))[0]
    counts = F.transform(every, lambda g: F.struct(g["group_id"], g["template_id"], (g["result"] & (g["matched_sets"] > 0)).alias("result"), g["matched_sets"]))
    return each.select("series_uid", counts.alias("groups")).withColumn("matched_groups", F.size(F.filter("groups", lambda g: g["result"])).cast("long"))


def evaluate_groups(matched: DataFrame) -> DataFrame:
    """(series_uid, group_id, template_id, result, matched_sets) from match().

    By the outer form: for the inner one Spark tests before that a series has
    groups, and would judge all rules for that, each as often as it is named.
    """
    return matched.select("series_uid", F.inline_outer("groups")).filter("result IS NOT NULL")


def assign(matched: DataFrame) -> DataFrame:
    """(series_uid, matched_groups, status) from match()."""
    status = F.when(F.col("matched_groups") == 0, "RULE_NOT_MATCHED").when(F.col("matched_groups") == 1, "RULE_MATCHED").otherwise("MULTIPLE_RULES_MATCHED")
    return matched.select("series_uid", "matched_groups", status.alias("status"))
