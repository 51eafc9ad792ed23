"""A guard for statements of strangers: what Spark's own parser and analyser make of a text is walked before anything runs.

First the parsed plan, in which nothing has been looked up: its nodes, the functions and the relations that it names must
all be listed here or be views that the caller names, so no file, catalogue or table function is touched. Then the analysed
plan: nodes and expressions must be listed, or belong to listed functions, and every leaf must be one of the views or rows
written out in the statement. So a function that someone has put in a listed one's place is refused too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Functions that read nothing but their arguments, and whose work is bounded by them.
FUNCTIONS = frozenset(
    """abs acos any any_value approx_count_distinct approx_percentile array array_agg array_append array_compact array_contains array_distinct array_except array_intersect
    array_join array_max array_min array_position array_remove array_size array_sort array_union arrays_overlap arrays_zip ascii asin atan avg between bit_and bit_count bit_or bit_xor bool_and bool_or
    bround btrim cast cbrt ceil ceiling char_length character_length coalesce collect_list collect_set concat concat_ws contains corr cos count count_if crc32 cume_dist date_add date_diff date_format
    date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank element_at elt endswith every exists exp explode explode_outer filter first first_value flatten floor forall
    format_number format_string get get_json_object greatest hash hour if ifnull ilike initcap instr isnan isnotnull isnull json_array_length lag last last_day last_value lcase lead least left length levenshtein like
    ln locate log log10 log2 lower lpad ltrim make_date map map_contains_key map_entries map_from_arrays map_keys map_values max max_by md5 mean median min min_by minute mod mode month months_between
    named_struct nanvl not nth_value ntile nullif nvl nvl2 octet_length percent_rank percentile pmod posexplode position pow power quarter rank regexp_count regexp_extract regexp_like
    regexp_replace replace reverse right rint rlike round row_number rpad rtrim second sequence sha1 sha2 sign sin size slice some sort_array soundex split split_part sqrt
    startswith std stddev string_agg struct substr substring sum tan to_date to_timestamp transform translate trim trunc try_divide try_element_at typeof ucase unix_timestamp upper variance when
    xxhash64 year zip_with""".split()
)
#: Operators and other expressions that aren't named functions, before and after analysis.
EXPRESSIONS = frozenset(
    """Add Alias AggregateExpression And Ascending Attribute AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Ceil Contains Count CreateArray CreateMap CreateNamedStruct Cube CurrentRow
    Decimal Descending Distinct Divide EndsWith EqualNullSafe EqualTo Exists Explode ExprId Floor GeneratorOuter GetArrayItem GetArrayStructFields GetMapValue GetStructField GreaterThan GreaterThanOrEqual GroupingSets Hour If In InSubquery IntegralDivide IsNotNull IsNull LambdaFunction LessThan
    LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Minute Mode Multiply NamedExpression NamedLambdaVariable NamedParameter NotLikeAll NotLikeAny Not Or OuterReference ParseToDate PosExplode PosParameter RLike Remainder Rollup ScalarSubquery Second SortOrder SpecifiedWindowFrame Star StartsWith
    StringLPad StringRPad Subtract TempResolvedColumn ToPrettyString UnaryMinus UnaryPositive UnboundedFollowing UnboundedPreceding UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedNamedLambdaVariable
    UnresolvedOrdinal UnresolvedStar UnresolvedSubqueryColumnAliases UnresolvedWindowExpression UnspecifiedFrame WindowExpression WindowSpecDefinition""".split()
)
PARSED = frozenset(
    """Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Project Sort SubqueryAlias Union
    UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedWith Window WithWindowDefinition""".split()
)
ANALYSED = frozenset(
    """Aggregate CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Project ResolvedInlineTable Sort
    SubqueryAlias Union View Window WithCTE""".split()
)
#: Nodes and names that a statement may have at most; the walk stops there.
MOST_NODES = 5000


class Refused(ValueError):
    """A statement that may not run."""


def _items(seq) -> Iterator:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class _Walk:
    def __init__(self, views: Iterable[str], classes: frozenset[str] = frozenset()):
        self.views, self.classes, self.left = {v.lower() for v in views}, classes, MOST_NODES

    def spend(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise Refused("the statement is too long")

    def parsed(self, plan, known: frozenset[str] = frozenset()) -> None:
        """A plan as parsed; known: names of common table expressions around it."""
        self.spend()
        kind = _kind(plan)
        if kind not in PARSED:
            raise Refused(f"a statement may not hold {kind}")
        if kind == "UnresolvedRelation":
            parts = list(_items(plan.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in self.views | known or plan.isStreaming():
                raise Refused(f"there is no view {'.'.join(parts)}")
        if kind == "UnresolvedWith":
            own = known
            for named in _items(plan.cteRelations()):
                if plan.allowRecursion():
                    raise Refused("a statement may not call itself")
                self.parsed(named._2(), own)
                own |= {named._1().lower()}
            known = own
        if kind == "WithWindowDefinition":
            for named in _items(plan.windowDefinitions()):
                self.parsed_expression(named._2(), known)
        for e in _items(plan.expressions()):
            self.parsed_expression(e, known)
        for child in _items(plan.children()):
            self.parsed(child, known)

    def parsed_expression(self, e, known: frozenset[str]) -> None:
        self.spend()
        kind = _kind(e)
        if kind == "UnresolvedFunction":
            parts = list(_items(e.nameParts()))
            if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
                raise Refused(f"a statement may not call {'.'.join(parts)}")
            if e.filter().isDefined():
                self.parsed_expression(e.filter().get(), known)
        elif kind == "UnresolvedGenerator":
            name = e.name().funcName().lower()
            if name not in FUNCTIONS:
                raise Refused(f"a statement may not call {name}")
        elif kind not in EXPRESSIONS and e.getClass().getName() not in self.classes:
            raise Refused(f"a statement may not hold {kind}")
        self.subquery(e, lambda plan: self.parsed(plan, known))
        for child in _items(e.children()):
            self.parsed_expression(child, known)

    def subquery(self, e, walk) -> None:
        if _kind(e) in ("Exists", "ListQuery", "ScalarSubquery"):
            walk(e.plan())

    def analysed(self, plan) -> None:
        self.spend()
        kind = _kind(plan)
        if kind not in ANALYSED:
            raise Refused(f"a statement may not hold {kind}")
        if kind == "View":
            name = plan.desc().identifier()
            if not plan.isTempView() or name.table().lower() not in self.views:
                raise Refused(f"there is no view {name.table()}")
            return  # what the view itself does is its owner's
        for e in _items(plan.expressions()):
            self.analysed_expression(e)
        for child in [*_items(plan.children()), *(_items(plan.cteDefs()) if kind == "WithCTE" else ())]:
            self.analysed(child)

    def analysed_expression(self, e) -> None:
        self.spend()
        name = e.getClass().getName()
        if _kind(e) not in EXPRESSIONS and name not in self.classes:
            raise Refused(f"a statement may not hold {_kind(e)}")
        self.subquery(e, self.analysed)
        own = {m.getName() for m in e.getClass().getMethods()} if name in self.classes else ()
        for child in _items(e.parameters() if "parameters" in own and "replacement" in own else e.children()):
            self.analysed_expression(child)


_CLASSES: dict[int, frozenset[str]] = {}


def _classes(spark: SparkSession) -> frozenset[str]:
    """The classes of the listed functions, as Spark itself has them."""
    jvm = spark._jvm
    if id(jvm) not in _CLASSES:
        registry = getattr(jvm.org.apache.spark.sql.catalyst.analysis, "FunctionRegistry$").__getattr__("MODULE$").builtin()
        found = set()
        for f in FUNCTIONS:
            info = registry.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(f))
            if info.isDefined():
                found.add(info.get().getClassName())
        _CLASSES[id(jvm)] = frozenset(found)
    return _CLASSES[id(jvm)]


def reading(spark: SparkSession, text: str, views: Iterable[str], args: dict | None = None) -> DataFrame:
    """The rows of a statement that only reads the given views; any other raises Refused before it runs."""
    session, views = spark._jsparkSession.sessionState(), list(views)
    try:
        plan = session.sqlParser().parsePlan(text)
    except Exception as e:
        raise Refused("the statement can't be parsed") from e
    _Walk(views, _classes(spark)).parsed(plan)
    try:
        out = spark.sql(text, args=args or {})  # a parsed plan of the listed nodes is no command, so nothing runs yet
        analysed = out._jdf.queryExecution().analyzed()
    except PySparkException as e:
        raise Refused(f"the statement can't be resolved: {e.getCondition()}") from e
    _Walk(views, _classes(spark)).analysed(analysed)
    return out
