"""Markdown documents with front matter: what breaks their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Allowed front-matter keys and limits.
KEYS = ["allowed-tools", "description", "license", "metadata", "name"]
LONGEST_NAME, LONGEST_DESCRIPTION, LONGEST_FRONT = 64, 1024, 16_384
UMBRELLA = "scientific-learning"
# The header of the table of misconceptions, the line under it, and what the text must say about its least rows.
TABLE_HEADER = r"\A\|\s*常见错误\s*\|\s*为什么错\s*\|\s*正确理解\s*\|\s*\z"
TABLE_RULE = r"\A\s*\|(?:\s*:?-{3,}:?\s*\|){3}\s*\z"
LEAST_ROWS_SAID = r"至少\s*2\s*(?:条|个|行)?|2\s*[-–—至到]\s*3\s*(?:条|个|行)?|2\s*(?:条|个|行)"


def front_matter(text: Column) -> Column:
    """struct(front, body, problem): the part between a first line ``---`` and the next one, and what follows."""
    lines = F.split(F.regexp_replace(text, r"\r\n", "\n"), "\n", -1)
    rest = F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1))
    end = F.array_position(rest, "---")
    front = F.array_join(F.slice(rest, 1, F.greatest(F.lit(0), end.cast("int") - 1)), "\n")
    body = F.array_join(F.slice(rest, end.cast("int") + 1, F.greatest(F.lit(0), F.size(rest) - end.cast("int"))), "\n")
    problem = (
        F.when(text.isNull() | (F.get(lines, F.lit(0)) != "---"), "no front matter")
        .when(end == 0, "front matter has no end")
        .when(F.length(front) > LONGEST_FRONT, "front matter is too long")
        .when(~body.rlike(r"(?U)\S"), "the body is empty")
    )
    ok = problem.isNull()
    return F.struct(F.when(ok, front).alias("front"), F.when(ok, body).alias("body"), problem.alias("problem"))


def table_rows(body: Column) -> Column:
    """Most rows of three filled cells under any header of misconceptions that a line of dashes follows; 0 without such a table.

    One pass over the lines within the row: no explode and no shuffle.
    """
    lines = F.split(body, r"\r\n|\n|\r", -1)
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("rows"), F.lit(0).alias("best"))  # 0 outside, 1 after a header, 2 in a table

    def step(a: Column, line: Column) -> Column:
        s = T.stripped(line)
        inner = F.regexp_replace(s, r"\A\|+|\|+\z", "")
        cells = F.transform(F.split(inner, r"\|", -1), T.stripped)
        full = (F.size(cells) == 3) & F.forall(cells, lambda c: c != "")
        rows = F.when((a["state"] == 2) & F.startswith(s, F.lit("|")), a["rows"] + full.cast("int")).otherwise(0)
        state = (
            F.when((a["state"] == 1) & line.rlike(T.java(TABLE_RULE)), 2).when((a["state"] == 2) & F.startswith(s, F.lit("|")), 2)
            .when(line.rlike(T.java(TABLE_HEADER)), 1).otherwise(0)
        )
        return F.struct(state.alias("state"), rows.alias("rows"), F.greatest(a["best"], rows).alias("best"))

    return F.aggregate(lines, start, step, lambda a: a["best"])


def errors(df: DataFrame, text: str = "text", name: str = "name") -> DataFrame:
    """``df`` with ``errors``: an array of what is wrong, empty if nothing is. ``name`` is the directory's name.

    Front matter is read as ``key: value`` lines with indented continuations; repeated keys, also indented ones of one key, are an
    error, and so is a line of the front matter that is neither a key, a continuation, a list item, a comment nor blank.
    """
    d = df.withColumn("__f", front_matter(F.col(text)))
    top = F.filter(F.split("__f.front", "\n", -1), lambda x: x.rlike(r"\A[^\s#:][^:]*:"))
    keys = F.transform(top, lambda x: F.trim(F.regexp_extract(x, r"\A([^:]*):", 1)))

    def value(key: str) -> Column:
        hit = F.filter(top, lambda x: x.startswith(key + ":"))
        return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.get(hit, F.lit(0)), r"\A[^:]*:", ""), r"\A\s*[\"']|[\"']\s*\z", "")), F.lit(""))

    inner = F.aggregate(  # indented keys under the key before them
        F.split("__f.front", "\n", -1), F.struct(F.lit("").alias("under"), F.array().cast("array<string>").alias("seen")),
        lambda a, x: F.struct(
            F.when(x.rlike(r"\A[^\s#:-][^:]*:"), x).otherwise(a["under"]).alias("under"),
            F.when(x.rlike(r"\A\s+[^\s#:-][^:]*:"), F.concat(a["seen"], F.array(F.concat(a["under"], F.lit("\u0001"), F.regexp_extract(x, r"\A(\s+[^:]*):", 1))))).otherwise(a["seen"]).alias("seen"),
        ),
        lambda a: a["seen"],
    )
    stray = F.exists(F.split("__f.front", "\n", -1), lambda x: ~x.rlike(r"\A\s*(#.*)?\z") & ~x.rlike(r"\A\s") & ~x.rlike(r"\A-(\s|\z)") & ~x.rlike(r"\A[^\s#:][^:]*:(\s|\z)"))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, KEYS))))
    given, said, body = value("name"), value("description"), F.col("__f.body")
    teaching = F.col(name) != UMBRELLA
    found = [
        F.col("__f.problem"),
        F.when(stray, "front matter is no mapping"),
        F.when((F.size(keys) != F.size(F.array_distinct(keys))) | (F.size(inner) != F.size(F.array_distinct(inner))), "repeated key"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unexpected keys: "), F.array_join(unknown, ", "))),
        F.when(given.isNull(), "no name"),
        F.when(F.length(given) > LONGEST_NAME, "name is too long"),
        F.when(~given.rlike(r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"), "name is not in lower case with hyphens"),
        F.when(given != F.col(name), "name and directory differ"),
        F.when(said.isNull(), "no description"),
        F.when(F.length(said) > LONGEST_DESCRIPTION, "description is too long"),
        F.when(said.rlike("[<>]"), "description has angle brackets"),
        F.when(teaching & ~body.contains("常见误区"), "no section on misconceptions"),
        F.when(teaching & body.contains("常见误区") & ~body.rlike(T.java(LEAST_ROWS_SAID)), "the least number of misconceptions is not said"),
        F.when(teaching & (table_rows(body) < 2), "no table of two misconceptions"),
    ]
    broken = F.col("__f.problem").isNotNull()
    rest = F.array_compact(F.array(*found[1:]))
    return d.withColumn("errors", F.when(broken, F.array(found[0])).otherwise(rest)).drop("__f")
