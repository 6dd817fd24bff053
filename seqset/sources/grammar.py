"""Declarations in the source texts of a language with classes in braces, over any number of lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqset.sources.lines import bare_line, pieces_of, section_size
from seqset.sources.tags import NAME

# Fixed values of the language, in the order in which a text is cut: what stands outside of code, comments, quoted texts,
# variables, words, blanks, signs of several characters, any other character. Possessive, so that long pieces need no deep stack.
_TOKEN = (
    r"\A[\s\S]*?<\?(?:php\b|=)"
    r"|\?>[\s\S]*?(?:<\?(?:php\b|=)|\z)"
    r"|(?://|#(?!\[))[^\n\r?]*+(?:\?(?!>)[^\n\r?]*+)*+"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    r"|<<<[ \t]*(['\"]?)(\w+)\1\r?\n[\s\S]*?\n[ \t]*\2\b"
    r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"
    r"|\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\""
    r"|\$[\w\x{80}-\x{10FFFF}]++|[\w\\\x{80}-\x{10FFFF}]++|\s++|::|\?->|->|#\[|[\s\S]"
)
_UNSEEN = r"(?:^(?:\s|//|#(?!\[)|/\*|\?>))|(?:<\?(?:php|=)\z)"

SPACE, CLASS, INTERFACE, FUNCTION, MODIFIER, NEW, CLOSED, OPEN, CLOSE, ROUND, END_ROUND, END, COMMA, REFERENCE, ACCESS, EQUALS = range(1, 17)
WORD, VARIABLE, VALUE = 17, 18, 19
_MARKS = {
    "namespace": SPACE, "class": CLASS, "interface": INTERFACE, "function": FUNCTION, "new": NEW, "trait": CLOSED, "enum": CLOSED,
    "{": OPEN, "}": CLOSE, "(": ROUND, "[": ROUND, "#[": ROUND, ")": END_ROUND, "]": END_ROUND, ";": END, ",": COMMA, "&": REFERENCE,
    "::": ACCESS, "->": ACCESS, "?->": ACCESS, "=": EQUALS,
} | dict.fromkeys(("abstract", "final", "public", "protected", "private", "static", "var", "readonly"), MODIFIER)

KINDS = ("class", "interface", "function", "method", "property")
_FIELDS = ("kind", "offset", "line", "name", "name_line", "owner", "space")
_HITS = T.ArrayType(T.StructType([T.StructField(n, T.LongType() if n == "offset" else T.IntegerType()) for n in _FIELDS]))


def _declared(marks: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(kind, first place, place of the name, of its owner's name, of its namespace's name), places in `marks`, -1 for none."""
    found = []
    blocks: list[tuple[str, int, int]] = []  # what a block is, its owner's name or the namespace before it, brackets around it
    space, rounds, bodies = -1, 0, 0
    coming: tuple[str, int, int] | None = None  # what the next block is, if it opens within these brackets
    first = -1  # the first modifier of what is being declared
    listing = named = False  # in a list of properties, and where a name of it may come
    at = lambda i: marks[i] if 0 <= i < len(marks) else 0
    for i, mark in enumerate(marks):
        owner = blocks[-1][1] if blocks and blocks[-1][0] == "owner" and rounds == 0 else -1
        start = first if first >= 0 else i
        if mark == ROUND:
            rounds += 1
        elif mark == END_ROUND:
            rounds = max(rounds - 1, 0)
        elif mark == OPEN:
            kind, name = coming[:2] if coming and coming[2] == rounds else ("other", -1)
            blocks.append((kind, name, rounds))
            bodies += kind == "body"
            coming, rounds, first, listing = None, 0, -1, False
        elif mark == CLOSE:
            if blocks:
                kind, name, rounds = blocks.pop()
                bodies -= kind == "body"
                space = name if kind == "space" else space
            first, listing = -1, False
        elif mark == END:
            coming, first, listing = (None, -1, False) if rounds == 0 else (coming, first, listing)
        elif mark == SPACE and at(i - 1) != ACCESS and at(i + 1) in (WORD, OPEN):
            before, space = space, i + 1 if at(i + 1) == WORD else -1
            coming = ("space", before, rounds)
        elif mark in (CLASS, INTERFACE, CLOSED) and at(i - 1) != ACCESS and (at(i + 1) == WORD or mark == CLASS and at(i - 1) == NEW):
            if at(i - 1) == NEW or mark == CLOSED or bodies or rounds:
                coming = ("body", -1, rounds)
            else:
                found.append((0 if mark == CLASS else 1, start, i + 1, -1, space))
                coming = ("owner", i + 1, rounds)
            first = -1
        elif mark == FUNCTION and at(i - 1) != ACCESS:
            name = i + 1 + (at(i + 1) == REFERENCE)
            # a method may have the name of a word that elsewhere has a meaning
            if at(name + 1) == ROUND and (at(name) == WORD or SPACE <= at(name) <= CLOSED):
                if owner >= 0:
                    found.append((3, start, name, owner, space))
                elif not bodies and rounds == 0 and not (blocks and blocks[-1][0] == "owner"):
                    found.append((2, start, name, -1, space))
            coming, first = ("body", -1, rounds), -1
        elif mark == MODIFIER:
            first, listing, named = start, owner >= 0, True
        elif mark == VARIABLE and owner >= 0 and listing and named:
            found.append((4, start, i, owner, space))
            named = False
        elif rounds == 0 and mark in (EQUALS, COMMA):
            named = mark == COMMA
    return found


@F.arrow_udf(_HITS)
def _hits(marks: pa.Array, lengths: pa.Array, lines: pa.Array) -> pa.Array:
    """Declarations by marks and lengths of a text's pieces and the lengths of its lines; names are places of pieces."""
    made = []
    for mark, length, line in zip(*(_arrays(a) for a in (marks, lengths, lines))):
        seen = np.flatnonzero(mark)
        starts = np.cumsum(length) - length + 1
        begins = np.cumsum(line) - line + 1
        of_line = lambda place: int(np.searchsorted(begins, starts[place], "right"))  # noqa: B023, E731
        row = []
        for kind, *places in _declared(mark[seen].tolist()):
            first, name, owner, space = (int(seen[p]) if p >= 0 else -1 for p in places)
            row.append((kind, int(starts[first]), of_line(first), name, of_line(name), owner, space))
        made.append([dict(zip(_FIELDS, r)) for r in row])
    fields = [(n, pa.int64() if n == "offset" else pa.int32()) for n in _FIELDS]
    return pa.array(made, type=pa.list_(pa.struct(fields)))


def _arrays(lists: pa.Array) -> list[np.ndarray]:
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("int64")
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def source_declarations(df: DataFrame, key: str, text: str) -> DataFrame:
    """Declarations of each source text: rows as `extract_declarations` gives them, found by grammar and not by line.

    Classes and interfaces, functions outside of them, methods and properties right inside. Modifiers, names, parameters and values
    may be spread over lines, with comments and attributes between; a declaration begins at its first modifier, and
    its prefix is the first line from there on that has the name, cut behind it. Comments, quoted texts, here-documents
    and what stands outside of the code declare nothing; a text without an opening tag is all code. Nothing inside the body of a function,
    an anonymous class, a trait or an enumeration counts. A namespace holds up to the next, or for its block. Unclosed blocks run to the end, stray
    closing signs are ignored. Null and empty texts give nothing. A text is one cell; nothing is shuffled.

    Rows (key, n_chars, kind, scope, owner, name, full_name, prefix, line, offset); kind is one of KINDS.
    """
    known = F.array(*[F.lit(w) for w in _MARKS])
    numbers = F.array(*[F.lit(n) for n in _MARKS.values()])

    def mark(piece: Column) -> Column:
        place = F.array_position(known, F.lower(piece)).cast("int")
        return (
            F.when(place > 0, F.get(numbers, place - 1))
            .when(F.rlike(piece, F.lit(_UNSEEN)), 0)
            .when(F.rlike(piece, F.lit(r"^\$.")), VARIABLE)
            .when(F.rlike(piece, F.lit(r"^[\w\\\x{80}-\x{10FFFF}]")), WORD)
            .otherwise(VALUE)
        )

    cut = df.filter(F.length(text) > 0).select(
        key, section_size(F.col(text)).alias("n_chars"), F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)).alias("_pieces"),
        pieces_of(F.col(text)).alias("_lines"),
    )
    lengths = lambda pieces: F.transform(pieces, lambda p: F.length(p))
    marked = cut.withColumn("_hits", _hits(F.transform("_pieces", mark), lengths("_pieces"), lengths("_lines")))

    def word(place: Column) -> Column:
        return F.when(place >= 0, F.get("_pieces", place))

    def said(hit: Column) -> Column:
        bare = F.regexp_extract(word(hit["name"]), NAME, 1)
        near = F.slice("_lines", hit["line"], hit["name_line"] - hit["line"] + 1)
        line = F.get(F.filter(near, lambda x: F.contains(x, bare)), F.lit(0))
        upto = F.substring(bare_line(line), F.lit(1), F.call_function("locate", bare, line) + F.length(bare) - 1)
        return F.struct(
            F.get(F.array(*[F.lit(k) for k in KINDS]), hit["kind"]).alias("kind"), word(hit["name"]).alias("name"),
            word(hit["owner"]).alias("owner"), word(hit["space"]).alias("space"), upto.alias("prefix"),
            hit["line"].alias("line"), hit["offset"].alias("offset"),
        )

    each = marked.select(key, "n_chars", F.explode(F.transform("_hits", said)).alias("_d")).select(key, "n_chars", "_d.*")
    scope = F.concat_ws("\\", "space", "owner")
    parting = F.when(F.col("kind") == "method", ":").when(F.col("kind") == "property", "").otherwise("\\")
    return each.select(
        key, "n_chars", "kind", scope.alias("scope"), "owner", "name", F.concat(scope, parting, "name").alias("full_name"),
        "prefix", "line", "offset",
    )
