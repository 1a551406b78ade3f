"""Which SQL may run: the parsed tree of a statement is walked, and what isn't known to be harmless is refused."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import ParseException
from pyspark.sql import SparkSession


class NotAQuery(ValueError):
    """The statement is not one plain query over what it may read."""


#: Nodes of a parsed query that read, filter, join, group, sort, and limit.
NODES = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect SubqueryAlias UnresolvedRelation UnresolvedWith "
    "UnresolvedHaving UnresolvedSubqueryColumnAliases UnresolvedInlineTable OneRowRelation WithWindowDefinition Pivot Unpivot LateralJoin Expand".split()
)
#: Functions that compute from their arguments alone.
FUNCTIONS = frozenset(
    "count sum avg mean min max median mode stddev stddev_pop stddev_samp variance var_pop var_samp count_if any_value bool_and bool_or every some first last max_by min_by "
    "percentile percentile_approx approx_count_distinct corr covar_pop covar_samp collect_list collect_set array_agg listagg string_agg "
    "row_number rank dense_rank percent_rank ntile lag lead first_value last_value nth_value cume_dist "
    "abs ceil ceiling floor round bround sqrt cbrt exp ln log log2 log10 pow power sign signum mod pmod greatest least div try_divide try_add "
    "coalesce nvl nvl2 ifnull nullif if isnull isnotnull isnan case when cast try_cast int bigint double float decimal string boolean date timestamp "
    "lower upper lcase ucase trim ltrim rtrim btrim length len char_length substring substr left right concat concat_ws replace translate instr locate position lpad rpad repeat reverse "
    "split split_part initcap ascii like ilike rlike regexp regexp_like regexp_replace regexp_extract regexp_count contains startswith endswith "
    "year quarter month day dayofmonth dayofweek dayofyear weekofyear hour minute second date_add date_sub datediff date_diff months_between add_months date_trunc trunc "
    "to_date to_timestamp date_format last_day extract date_part unix_timestamp from_unixtime make_date "
    "array size element_at array_contains explode struct named_struct map in between not and or".split()
)


def _items(sequence) -> Iterator:
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _check_expression(e, allowed: set[str], scope: frozenset[str]) -> None:
    kind = _kind(e)
    if kind == "UnresolvedFunction":
        parts = [str(x).lower() for x in _items(e.nameParts())]
        if len(parts) != 1 or parts[0] not in FUNCTIONS:
            raise NotAQuery(f"no function {'.'.join(parts)}")
    if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
        _check(e.plan(), allowed, scope)
    for child in _items(e.children()):
        _check_expression(child, allowed, scope)


def _check(plan, allowed: set[str], scope: frozenset[str]) -> None:
    kind = _kind(plan)
    if kind not in NODES:
        raise NotAQuery(f"no {kind} in a query")
    if kind == "UnresolvedWith":
        # a name holds for the queries after it and for the body, nowhere else
        for common in _items(plan.innerChildren()):
            _check(common.child(), allowed, scope)
            scope = scope | {common.alias().lower()}
    if kind == "UnresolvedRelation":
        parts = [str(x) for x in _items(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0].lower() not in allowed | scope:
            raise NotAQuery(f"no access to {'.'.join(parts)}")
    for e in _items(plan.expressions()):
        _check_expression(e, allowed, scope)
    for child in _items(plan.children()):
        _check(child, allowed, scope)


def check(spark: SparkSession, statement: str, allowed: set[str]) -> str:
    """The statement, if it is one query over the allowed temporary views; NotAQuery else."""
    text = statement.strip().rstrip(";").strip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as e:
        raise NotAQuery(str(e)) from e
    _check(plan, {a.lower() for a in allowed}, frozenset())
    return text
