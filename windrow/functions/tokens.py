"""Normalising source code: tokens of a language to a short alphabet, with a table of what was removed where."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERED = "filtered string, offsets array<struct<pos:int,off:int>>, language string"


@lru_cache(maxsize=64)
def _lexer(language: str | None, name: str, strip: bool):
    from pygments import lexers
    from pygments.util import ClassNotFound

    options = {} if strip else {"stripnl": False, "ensurenl": False}
    try:
        return lexers.get_lexer_by_name(language, **options) if language else lexers.get_lexer_for_filename(name, **options)
    except ClassNotFound:
        return None


def normalise(code: str, name: str, language: str | None = None, compat: bool = False) -> tuple[str, list[tuple[int, int]], str | None]:
    """Filtered text, offset rows (position, characters removed before it) and the language.

    Names become V, functions F, classes O, preprocessor lines P, string bodies S; comments and white space go;
    quotes become one kind; all else stays. Plain text and unknown names pass through without offset rows.
    compat: leading and trailing newlines are stripped, class names record their own length, plain text is filtered
    to nothing.
    """
    from pygments.token import Comment, Literal, Name, Text

    lexer = _lexer(language, name.rsplit("/", 1)[-1].lower() if not language else "", compat)
    if lexer is None:
        return code, [], None
    if lexer.name == "Text only" and not compat:
        return code, [], lexer.name
    out: list[str] = []
    size = removed = 0
    offsets = [(0, 0)]
    for kind, value in lexer.get_tokens(code):
        n = len(value)
        if kind in {Name, Name.Variable, Name.Attribute}:
            symbol = "V"
        elif kind in Name.Function:
            symbol = "F"
        elif kind in Name.Class:
            symbol = "O"
        elif kind in {Comment.Preproc, Comment.Hashbang}:
            symbol = "P"
        elif kind in Text or kind in Comment:
            offsets.append((size - 1, removed))
            removed += n
            continue
        elif kind in Literal.String:
            if value in ("'", '"'):
                out.append('"')
                size += 1
                continue
            symbol = "S"
        else:
            out.append(value)
            size += n
            continue
        out.append(symbol)
        size += 1
        offsets.append((size - 1, n - 1 if compat and symbol == "O" else removed))
        removed += n - 1
    return "".join(out), offsets, lexer.name


def filter_code(docs: DataFrame, text_col: str = "text", name_col: str = "name", language: str | None = None, compat: bool = False) -> DataFrame:
    """docs with filtered text, offsets and language; a null text is filtered as empty."""
    fields = [f for f in docs.schema.fields if f.name not in ("filtered", "offsets", "language")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + FILTERED
    row = pa.list_(pa.struct([("pos", pa.int32()), ("off", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                done = [normalise(t or "", n or "", language, compat) for t, n in zip(part.column(text_col).to_pylist(), part.column(name_col).to_pylist())]
                offsets = pa.array([[{"pos": p, "off": o} for p, o in rows] for _, rows, _ in done], row)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f for f, _, _ in done], pa.string()), offsets, pa.array([g for _, _, g in done], pa.string())], [*part.schema.names, "filtered", "offsets", "language"])

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)
