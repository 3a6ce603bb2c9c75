"""A guarded SQL dialect over one table: compiling questions, checking statements, and running them as DataFrames.

Statements are parsed by Spark's own parser. The tree may only be a projection or an aggregate over one relation with
filter, order and limit; every expression must be of an allowed class. A second, textual check refuses words and marks
that have no place in the dialect. A statement that passes names one relation only; it runs over a view with a name of its own that
is dropped as soon as the statement is analysed, so no view of the caller is seen, replaced or dropped.
"""

from __future__ import annotations

import operator
import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.numbers import parse_bool, parse_number

#: Words that a statement must not hold, and names no column may have bare.
FORBIDDEN = (
    "alter", "attach", "call", "case", "cast", "coalesce", "copy", "create", "current_date", "current_time", "current_timestamp", "date_part", "date_trunc", "delete", "detach", "distinct", "drop",
    "else", "end", "except", "extract", "having", "ifnull", "insert", "install", "intersect", "join", "load", "nullif", "over", "pragma", "read_csv", "read_json", "read_parquet", "strptime", "then", "union",
    "update", "when", "window", "with",
)
AGGREGATES = ("count", "sum", "avg", "min", "max")
RESERVED = ("select", "from", "where", "group", "by", "order", "limit", "and", "or", "not", "in", "is", "like", "between", "null", "as", "asc", "desc", "table", "values")
MAX_ROWS, MAX_BYTES, MAX_SECONDS = 100, 64 * 1024, 60.0

_PLANS = {"Project", "Aggregate", "Filter", "Sort", "GlobalLimit", "LocalLimit", "UnresolvedRelation"}
_EXPRESSIONS = {
    "UnresolvedAttribute", "Alias", "UnresolvedAlias", "UnresolvedFunction", "Literal", "UnresolvedStar", "SortOrder",
    "And", "Or", "Not", "EqualTo", "EqualNullSafe", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual",
    "Between", "UnresolvedBetween", "In", "IsNull", "IsNotNull", "Like", "ILike", "UnaryMinus",
}


@dataclass(frozen=True)
class TableContext:
    """The one table a question is about: its safe name and columns (safe name -> type)."""

    name: str
    columns: dict[str, str]
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def numeric(self) -> list[str]:
        return [c for c, t in self.columns.items() if t in ("bigint", "int", "double", "number", "integer", "float")]


def safe_identifiers(names: list[str]) -> dict[str, str]:
    """Raw name -> identifier of a-z, 0-9 and underscores: other letters as their code, no leading digit, no reserved word, no clash."""
    import unicodedata

    out: dict[str, str] = {}
    used: set[str] = set()
    for raw in names:
        plain = unicodedata.normalize("NFKC", raw).lower()
        s = "".join(c if c.isascii() and c.isalnum() else f"u{ord(c):x}" if c.isalnum() else "_" for c in plain)
        s = re.sub("_+", "_", s).strip("_") or "column"
        s = f"c_{s}" if s[0].isdigit() else s
        s = f"{s}_col" if s in RESERVED or s in FORBIDDEN else s
        n, base = 2, s
        while s in used:
            s, n = f"{base}_{n}", n + 1
        used.add(s)
        out[raw] = s
    return out


def extract_sql(text: str) -> str | None:
    """The statement in a model's answer: from a fence, after a SQLQuery: mark, or from the first SELECT; up to a semicolon."""
    fence = re.search(r"```(?:sql)?\s*(.*?)```", text, re.S | re.I)
    body = fence.group(1) if fence else text
    body = re.split(r"SQLQuery:", body, flags=re.I)[-1]
    start = re.search(r"\bselect\b", body, re.I)
    return body[start.start() :].split(";")[0].strip() or None if start else None


_WANTS = {"SUM": r"\b(?:sum|total)\b", "AVG": r"\b(?:avg|average|mean)\b", "MAX": r"\b(?:max|maximum|highest|largest)\b", "MIN": r"\b(?:min|minimum|lowest|smallest)\b"}


def _mentioned(text: str, table: TableContext) -> list[str]:
    return [c for c in table.columns if re.search(rf"(?<![a-z0-9]){re.escape(c.replace('_', ' '))}(?![a-z0-9])", text.replace("_", " "))]


def compile_question(question: str, table: TableContext, limit: int = 5) -> str | None:
    """A statement for a question, by the first rule that applies: count, sums by group, one aggregate, top k, columns.

    Counting comes first, so "count per region" counts all rows; groups are always summed; "highest" is an aggregate,
    so rankings need "top" or "rank".
    """
    text = " ".join(question.lower().split())
    if not table.columns:
        return None
    if re.search(r"\b(?:count|how many|number of rows|row count)\b", text):
        return f"SELECT COUNT(*) AS row_count FROM {table.name}"
    said = _mentioned(text, table)
    numeric = next((c for c in said if c in table.numeric), next(iter(table.numeric), None))
    group = next((c for c in said if c not in table.numeric), None)
    if group and numeric and re.search(r"\b(?:by|per|each|grouped? by)\b", text):
        return f"SELECT {group}, SUM({numeric}) AS sum_{numeric} FROM {table.name} GROUP BY {group} ORDER BY sum_{numeric} DESC LIMIT {max(1, limit)}"
    for name, pattern in _WANTS.items():
        if re.search(pattern, text):
            return f"SELECT {name}({numeric}) AS {name.lower()}_{numeric} FROM {table.name}" if numeric else None
    if re.search(r"\b(?:top|rank|ranking|ranked|least)\b", text):
        by = numeric or next(iter(table.columns))
        k = re.search(r"\btop\s+(\d+)", text)
        shown = list(dict.fromkeys([*said, by]))
        way = "ASC" if re.search(r"\bleast\b", text) else "DESC"
        return f"SELECT {', '.join(shown)} FROM {table.name} ORDER BY {by} {way} LIMIT {max(1, int(k.group(1)) if k else limit)}"
    shown = said or ([numeric] if numeric else [])
    return f"SELECT {', '.join(shown)} FROM {table.name} LIMIT 1" if shown else None


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(node):
    """All plan nodes and expressions under a plan, as (class name, node, whether it is a plan)."""
    todo = [(node, True)]
    while todo:
        n, is_plan = todo.pop()
        yield _name(n), n, is_plan
        kids = n.children()
        todo += [(kids.apply(i), is_plan) for i in range(kids.size())]
        if is_plan:
            es = n.expressions()
            todo += [(es.apply(i), False) for i in range(es.size())]


@dataclass
class Verdict:
    ok: bool
    reasons: list[str]
    limit: int | None = None
    #: Each named check and whether it passed.
    checks: dict[str, bool] = field(default_factory=dict)


CHECKS = ("single_statement", "no_comments", "select_only", "one_table", "no_forbidden_words", "allowed_functions", "known_columns", "plain_projection", "limit")


def textual_check(sql: str) -> list[str]:
    """Reasons against a statement that its text alone gives."""
    found = []
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql)
    if ";" in bare:
        found.append("single_statement")
    if "--" in bare or "/*" in bare or "#" in bare:
        found.append("no_comments")
    if not re.match(r"\s*select\b", bare, re.I):
        found.append("select_only")
    if re.search(r"://", sql) or any(re.search(rf"\b{w}\b", bare, re.I) for w in FORBIDDEN):
        found.append("no_forbidden_words")
    return found


def check(spark: SparkSession, sql: str, table: TableContext) -> Verdict:
    """Whether a statement is in the dialect; reasons are names of CHECKS."""
    reasons = textual_check(sql)
    limit = None
    if not reasons:
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception:
            plan = None
            reasons.append("select_only")
        relations = 0
        aliases = {table.name.lower()}
        for name, node, is_plan in _walk(plan) if plan is not None else ():
            if is_plan:
                if name not in _PLANS:
                    reasons.append("one_table" if "Join" in name or "Subquery" in name else "select_only")
                if name == "UnresolvedRelation":
                    relations += 1
                    if node.tableName().lower() != table.name.lower():
                        reasons.append("one_table")
            elif name == "Alias":
                aliases.add(node.name().lower())
        for name, node, is_plan in _walk(plan) if plan is not None else ():
            if is_plan:
                continue
            if name not in _EXPRESSIONS:
                reasons.append("plain_projection")
            elif name == "UnresolvedStar":
                reasons.append("plain_projection")
            elif name == "UnresolvedFunction":
                parts = node.nameParts()
                # Comparisons such as BETWEEN may come as functions of the parser; only aggregates are functions of the dialect.
                if parts.size() != 1 or parts.apply(0).lower() not in (*AGGREGATES, "between") or node.isDistinct() or node.filter().isDefined():
                    reasons.append("allowed_functions")
            elif name == "UnresolvedAttribute":
                parts = node.nameParts()
                last = parts.apply(parts.size() - 1).lower()
                if last not in table.columns and last not in aliases or parts.size() > 2:
                    reasons.append("known_columns")
        if plan is not None and relations != 1:
            reasons.append("one_table")
        if (m := re.search(r"\blimit\s+(\d+)\s*$", sql, re.I)) is not None:
            limit = int(m.group(1))
        elif re.search(r"\blimit\b", re.sub(r"'(?:[^']|'')*'", "''", sql), re.I):
            reasons.append("limit")
    reasons = sorted(set(reasons))
    return Verdict(not reasons, reasons, min(limit or MAX_ROWS, MAX_ROWS), {c: c not in reasons for c in CHECKS})


def run(df: DataFrame, sql: str, table: TableContext) -> DataFrame:
    """The statement's result over ``df``, lazily, at most MAX_ROWS rows; ValueError with the reasons if it is refused.

    A statement that passes runs in a session of its own, which sees the table's columns under a name nobody else knows, and none of the
    caller's views, functions and settings. `fetch` gets its rows under limits of rows, bytes and time.
    """
    spark = df.sparkSession
    verdict = check(spark, _counted(sql), table)
    if not verdict.ok:
        raise ValueError("refused: " + ", ".join(verdict.reasons))
    own = f"guarded_{uuid.uuid4().hex}"
    df.select(*[c for c in df.columns if c.lower() in table.columns]).createGlobalTempView(own)
    try:
        shared = spark.conf.get("spark.sql.globalTempDatabase", "global_temp")
        return spark.newSession().sql(_from(sql, table.name, f"{shared}.{own}")).limit(verdict.limit)
    finally:
        spark.catalog.dropGlobalTempView(own)


def _from(sql: str, name: str, view: str) -> str:
    """The statement with its one relation read from ``view``, under its old name; text in quotes stays as it is."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    parts[::2] = [re.sub(rf"\bfrom\s+`?{re.escape(name)}`?(?!\w)", f"FROM {view} AS {name}", p, flags=re.I) for p in parts[::2]]
    return "".join(parts)


#: Types of a table's columns -> what their cells are read as.
KINDS = {"integer": "bigint", "int": "bigint", "bigint": "bigint", "number": "double", "numeric": "double", "float": "double", "double": "double", "decimal": "double", "boolean": "boolean"}


def typed_table(df: DataFrame, name: str, kinds: dict[str, str]) -> tuple[DataFrame, TableContext]:
    """A table of text cells as a typed one with safe names, and its context: (rows, context).

    ``kinds``: raw column -> integer, number, boolean or anything else for text. Empty cells and cells that don't parse
    are null; numbers may have thousands separators, currency and per cent signs and brackets for negative ones; integers
    lose what is behind the point.
    """
    safe = safe_identifiers(list(kinds))
    cells, columns = [], {}
    for raw, kind in kinds.items():
        kind = KINDS.get(kind.lower(), "string")
        cell = F.nullif(F.col(f"`{raw}`").cast("string"), F.lit(""))
        value = {"bigint": parse_number(cell).try_cast("bigint"), "double": parse_number(cell), "boolean": parse_bool(cell)}.get(kind, cell)
        cells.append(value.alias(safe[raw]))
        columns[safe[raw]] = kind
    return df.select(*cells), TableContext(safe_identifiers([name])[name], columns)


_CONDITION = re.compile(r"([a-z_][a-z0-9_]*)\s*(<=|>=|<>|!=|=|<|>|like\b)\s*('[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|true|false|null)", re.I)


def plain_where(where: str, table: TableContext) -> list[tuple[str, str, str]]:
    """(column, operator, literal) of a condition that is only a conjunction of comparisons with literals; ValueError if it isn't.

    For use where there is no parser at hand; the checks above take more.
    """
    found = []
    for part in re.split(r"\s+and\s+", where.strip(), flags=re.I) if where.strip() else []:
        m = _CONDITION.fullmatch(part.strip())
        if not m:
            raise ValueError(f"no plain condition: {part.strip()}")
        if m.group(1) not in table.columns:
            raise ValueError(f"unknown column: {m.group(1)}")
        found.append((m.group(1), m.group(2).lower(), m.group(3)))
    return found


def filter_plain(df: DataFrame, where: str, table: TableContext) -> DataFrame:
    """The rows that meet a `plain_where` condition; comparisons with null meet nothing."""
    compare = {"=": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
    for column, op, literal in plain_where(where, table):
        low = literal.lower()
        value = None if low == "null" else low == "true" if low in ("true", "false") else literal[1:-1] if literal[0] in "'\"" else float(literal)
        c = F.col(column)
        df = df.filter(c.like(str(value)) if op == "like" else getattr(operator, compare[op])(c, F.lit(value)))
    return df


def _counted(sql: str) -> str:
    """COUNT(*) is the one star of the dialect."""
    return re.sub(r"count\s*\(\s*\*\s*\)", "COUNT(1)", sql, flags=re.I)


def fetch(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, seconds: float | None = MAX_SECONDS):
    """(rows, truncated) of a result, read one row past the cap; a result over the byte cap or the time limit is an error.

    The time limit cancels the job itself, not only the wait for it.
    """
    sc = df.sparkSession.sparkContext
    timer = None
    if seconds is not None:
        group = f"guarded-{id(df)}"
        sc.setJobGroup(group, "guarded statement", interruptOnCancel=True)
        timer = threading.Timer(seconds, sc.cancelJobGroup, [group])
        timer.start()
    try:
        rows = df.limit(max_rows + 1).collect()
    finally:
        if timer:
            timer.cancel()
    if sum(len(str(v)) for r in rows[:max_rows] for v in r) > max_bytes:
        raise ValueError("the result is larger than the byte cap")
    return rows[:max_rows], len(rows) > max_rows


#: Words by which a question is one for a table.
SIGNALS = {"aggregate": ("sum", "total", "average", "mean", "count", "max", "min", "how many"), "ranking": ("top", "rank", "highest", "lowest"), "lookup": ("value", "row", "column", "table")}


def intent(question: str) -> tuple[bool, str]:
    """(whether to ask a table, kind of question)."""
    text = " ".join(question.lower().split())
    for kind, signs in SIGNALS.items():
        if any(re.search(rf"\b{s}\b", text) for s in signs):
            return True, kind
    return False, "none"


#: States in which answering a question by SQL can end.
OUTCOMES = ("executed", "empty", "skipped_intent", "no_table", "ambiguous_table", "compile_failed", "refused", "failed", "too_large")


def answer_among(tables: dict[str, tuple[DataFrame, TableContext]], question: str, compiler=compile_question) -> tuple[str, str | None, str | None, list]:
    """(outcome, table, statement, rows) for a question and several tables: intent, routing to one table by its card, and `answer` there."""
    from tarn.operators.profiling import route_scores

    if not intent(question)[0]:
        return "skipped_intent", None, None, []
    if not tables:
        return "no_table", None, None, []
    spark = next(iter(tables.values()))[0].sparkSession
    cards = [(name, " ".join([name, *context.columns]), list(context.columns), bool(context.numeric)) for name, (_, context) in tables.items()]
    routed = route_scores(spark.createDataFrame(cards, "table_id string, text string, identifiers array<string>, numeric boolean"), spark.createDataFrame([(0, question)], "question_id int, text string")).first()
    if routed is None or routed.status == "no_match":
        return "no_table", None, None, []
    if routed.status == "ambiguous":
        return "ambiguous_table", None, None, []
    df, context = tables[routed.table_id]
    outcome, sql, rows = answer(df, question, context, compiler)
    return outcome, routed.table_id, sql, rows


def answer(df: DataFrame, question: str, table: TableContext, compiler=compile_question) -> tuple[str, str | None, list]:
    """(outcome, statement, rows) for a question: intent, compilation, check, execution. A compiler that fails is not replaced."""
    if not intent(question)[0]:
        return "skipped_intent", None, []
    try:
        sql = compiler(question, table)
    except Exception:
        sql = None
    if not sql:
        return "compile_failed", None, []
    try:
        rows, _ = fetch(run(df, sql, table))
    except ValueError as e:
        return ("too_large" if "byte cap" in str(e) else "refused"), sql, []
    except Exception:
        return "failed", sql, []
    return ("executed" if rows else "empty"), sql, rows


def result_text(rows: list, columns: list[str]) -> str:
    """A result as lines of name: value."""
    return "\n".join("; ".join(f"{c}: {v}" for c, v in zip(columns, r, strict=True)) for r in rows)


def evidence(question_id: str, sql: str, rows: list, columns: list[str]) -> dict:
    """One pinned candidate that rerankers leave alone, with an id that depends on statement and result."""
    import hashlib

    text = result_text(rows, columns)
    ident = hashlib.sha256("\x1f".join([question_id, sql, text]).encode()).hexdigest()[:32]
    return {"query_id": question_id, "chunk_id": f"sql_{ident}", "text": text, "policy": "pinned", "rerankable": False, "local_rank": 1}
