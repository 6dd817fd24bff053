"""Declarations found in source texts, and the tag index made of them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqset.functions.tagline import AFTER_PREFIX, SECTION, format_header, format_tag, parse_tag
from seqset.operators.running import Running, ordered, running
from seqset.session import saved
from seqset.sources.lines import bare_line, pieces_of, section_size, starts_of


@dataclass(frozen=True)
class Declaration:
    """A kind of declaration, found inside a line by `pattern`; group 1 is the name.

    Role `scope` names a namespace, `owner` a class-like declaration, `member`
    counts only inside an owner, `either` inside or outside. `inner` and `outer` are
    written between scope and name inside and outside an owner. Group 1 may list
    several names parted by commas.
    """

    kind: str
    pattern: str
    role: str
    outer: str = "\\"
    inner: str = "\\"


_WORDS = r"(?:(?:abstract|final|public|protected|private|static|var)\s+)*"
PHP = (
    Declaration("namespace", r"\bnamespace\s+([\w\\]+)", "scope"),
    Declaration("class", _WORDS + r"\bclass\s+(\w+)", "owner"),
    Declaration("interface", r"\binterface\s+(\w+)", "owner"),
    Declaration("function", _WORDS + r"\bfunction\s+&?\s*(\w+)\s*\(", "either", inner=":"),
    Declaration(
        "property",
        r"(?:public|protected|private|static|var)\s+(?:(?:static|public|protected|private)\s+)*(\$\w+(?:\s*,\s*\$\w+)*)",
        "member",
        inner="",
    ),
)

# Fixed values of the tag file format: the part of a name that is looked for, and a section's header `path,chars`
NAME = r"\$?([a-z0-9A-Z_]+)"
HEADER = r"^(.+),([0-9]+)$"

# characters of texts whose declarations one task sorts, about
CHARS_PER_TASK = 8_000_000


def _code(line: Column) -> Column:
    """The line without its quoted texts and line comments."""
    quoted = r"""'[^'\\\n]*(?:\\.[^'\\\n]*)*'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|//[^\n]*|/\*.*?\*/"""
    return F.regexp_replace(line, quoted, "")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _sorting_tasks(df: DataFrame, text: str) -> int:
    """Tasks among which declarations are dealt, so that a task's share does not grow with the data."""
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / CHARS_PER_TASK))


def extract_declarations(
    df: DataFrame, key: str, text: str, declarations: Sequence[Declaration],
    block: tuple[str, str] | None = None,
) -> DataFrame:
    """Declarations of each text with scope, owner, line, offset and line prefix.

    The scope is the last `scope` declaration above, the owner the last `owner`
    declaration above; with `block` signs an owner ends where its block closes, else
    at the next one. Patterns are matched line by line and know no grammar: a
    declaration spread over lines is not found, one inside a longer comment is.

    Rows (key, n_chars, kind, scope, owner, name, full_name, prefix, line, offset).
    """
    pieces = F.transform(pieces_of(F.col(text)), lambda p: F.struct(p.alias("p"), F.length(p).alias("n")))
    cut = df.select(key, section_size(F.col(text)).alias("n_chars"), pieces.alias("_pieces"))
    cut = cut.withColumn("_starts", starts_of(F.transform("_pieces", lambda p: p["n"])))
    if block:
        steps = F.transform("_pieces", lambda p: (_count(_code(p["p"]), block[0]) - _count(_code(p["p"]), block[1])))
        # the start of piece i in a text of such lengths is 1 + the depth before line i
        cut = cut.withColumn("_depths", starts_of(steps))
    else:
        cut = cut.withColumn("_depths", F.lit(None).cast("array<bigint>"))
    each = cut.select(key, "n_chars", F.posexplode("_pieces").alias("_at", "_piece"), "_starts", "_depths").select(
        key, "n_chars",
        (F.col("_at") + 1).alias("line"),
        F.get("_starts", F.col("_at")).alias("_start"),
        (F.get("_depths", F.col("_at")) - 1).alias("_depth"),
        bare_line(F.col("_piece.p")).alias("_line"),
    )
    line = F.col("_line")

    def hits(place: int, pattern: str) -> Column:
        whole, inner = (F.regexp_extract_all(line, F.lit(pattern), F.lit(g)) for g in (0, 1))

        def listed(found: Column, given: Column) -> Column:
            return F.transform(
                F.split(given, r"\s*,\s*"),
                lambda one: F.struct(F.lit(place).alias("d"), found.alias("whole"), one.alias("name")),
            )

        return F.flatten(F.zip_with(whole, inner, listed))

    found = F.concat(*[hits(i, d.pattern) for i, d in enumerate(declarations)])
    each = each.withColumn("_found", F.array_distinct(found))
    if block:
        opens, closes = (_count(_code(line), sign) for sign in block)
        each = each.withColumn("_after", F.when(closes > 0, F.col("_depth") + opens - closes))
    else:
        each = each.withColumn("_after", F.lit(None).cast("bigint"))

    def of(field: str, hit: Column) -> Column:
        table = F.array(*[F.lit(getattr(d, field)) for d in declarations])
        return F.get(table, hit["d"])

    # only lines that declare or close something go through the windows
    rows = (
        each.filter((F.size("_found") > 0) | F.col("_after").isNotNull())
        .select("*", F.posexplode_outer("_found").alias("_nth", "_hit"))
        .withColumns({"_nth": F.coalesce("_nth", F.lit(0)), "_role": of("role", F.col("_hit"))})
        .withColumn("_in", F.coalesce(F.call_function("locate", F.col("_hit.whole"), line), F.lit(0)))
        .drop("_found")
        # three sorts by the key follow in the same task; a given number of tasks is not merged by the bytes, which pack well
        .repartition(_sorting_tasks(df, text), key)
    )
    owner = F.struct(
        F.col("_hit.name").alias("name"), F.col("_depth").alias("depth"),
        F.col("line").alias("line"), F.col("_in").alias("at"),
    )
    # a text is one cell, which bounds its lines
    o = running(
        ordered(rows, key, ["line", "_in", "_nth"], rows=None),
        _scope=Running("last", F.when(F.col("_role") == "scope", F.col("_hit.name"))),
        _owner=Running("last", F.when(F.col("_role") == "owner", owner)),
    )
    per_owner = o.done().withColumns({"_owner_line": F.col("_owner.line"), "_owner_at": F.col("_owner.at")})
    closing = F.when(F.col("_after") <= F.col("_owner.depth"), F.col("line"))
    o = running(
        ordered(per_owner, [key, "_owner_line", "_owner_at"], ["line", "_in", "_nth"], rows=None),
        _closed=Running("min", closing),
    )
    inside = (
        F.col("_owner").isNotNull()
        & (F.col("_closed").isNull() | (F.col("_closed") >= F.col("line")))
        & ~F.col("_role").isin("owner", "scope")
    )
    kept = (
        o.done()
        .filter(F.col("_hit").isNotNull() & (F.col("_role") != "scope"))
        .withColumn("_inside", inside)
        .filter(F.col("_inside") | (F.col("_role") != "member"))
    )
    name = F.col("_hit.name")
    bare = F.regexp_extract(name, NAME, 1)
    at = F.call_function("locate", bare, line)
    scope = F.concat_ws("\\", "_scope", F.when(F.col("_inside"), F.col("_owner.name")))
    separator = F.when(F.col("_inside"), of("inner", F.col("_hit"))).otherwise(of("outer", F.col("_hit")))
    return kept.select(
        key, "n_chars", of("kind", F.col("_hit")).alias("kind"), scope.alias("scope"),
        F.when(F.col("_inside"), F.col("_owner.name")).alias("owner"), name.alias("name"),
        F.concat(scope, separator, name).alias("full_name"),
        F.when(at > 0, F.substring(line, F.lit(1), at + F.length(bare) - 1)).alias("prefix"),
        "line",
        (F.col("_start") + F.col("_in") - 1).alias("offset"),
    ).dropDuplicates([key, "kind", "name", "line", "offset"])


def locate_from(
    df: DataFrame, key: str, text: str, name: str, start: str
) -> DataFrame:
    """The first line at or after character `start` that contains `name`.

    One row per row of `df`: (key, name, found), `found` is the line cut after
    the name, null if no line holds it. Of the name only its first word counts.
    """
    word = F.regexp_extract(name, NAME, 1)
    at = F.when(word != "", F.call_function("locate", word, F.col(text), F.col(start).cast("int")))
    upto = F.substring(F.col(text), F.lit(1), at + F.length(word) - 1)
    found = F.when(at > 0, F.substring_index(F.translate(upto, "\r", "\n"), "\n", -1))
    return df.select(key, name, found.alias("found"))


def write_tag_index(tags: DataFrame, path: str, scoped: bool = False) -> None:
    """Write tags(path, n_chars, name, full_name, prefix, line, offset) as index text.

    One section per file, in source order; files without tags write nothing. A
    section is never cut by the end of an output file.
    """
    # read for headers, lines and the samples of their ranges
    tags = saved(tags.select("path", "n_chars", "name", *(["full_name"] if scoped else []), "prefix", "line", "offset"))
    name = F.col("full_name" if scoped else "name")
    lines = tags.select(
        "path", F.lit(1).alias("_part"), "offset", "name",
        format_tag(F.col("prefix"), name, F.col("line"), F.col("offset")).alias("value"),
    )
    headers = (
        tags.select("path", "n_chars")
        .distinct()
        .select(
            "path", F.lit(0).alias("_part"), F.lit(0).cast("bigint").alias("offset"), F.lit("").alias("name"),
            format_header(F.col("path"), F.col("n_chars")).alias("value"),
        )
    )
    (
        headers.unionByName(lines)
        .repartitionByRange("path")
        .sortWithinPartitions("path", "_part", "offset", "name")
        .select("value")
        .write.mode("overwrite")
        .text(path)
    )


def read_tag_index(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of an index: rows (path, n_chars, name, prefix, line).

    A section is read as one record, so the tags of a file stay with its header.
    The header is the line `path,chars` that holds no DEL byte.
    """
    sections = spark.read.option("lineSep", SECTION).text(path)
    each = sections.filter(F.length("value") > 0).select(F.split("value", "\n").alias("_lines"))
    header = F.get(F.col("_lines"), 0)
    tagged = (
        each.filter(F.rlike(header, F.lit(HEADER)) & ~F.contains(header, F.lit(AFTER_PREFIX)))
        .select(
            F.regexp_extract(header, HEADER, 1).alias("path"),
            F.regexp_extract(header, HEADER, 2).cast("bigint").alias("n_chars"),
            F.explode(F.slice("_lines", 2, F.size("_lines"))).alias("_line"),
        )
    )
    parsed = parse_tag(F.col("_line"))
    return tagged.select(
        "path", "n_chars", parsed["name"].alias("name"), parsed["prefix"].alias("prefix"), parsed["line"].alias("line")
    ).filter(F.col("line").isNotNull())
