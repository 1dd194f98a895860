"""Spark stages that lex files and hand them to a function per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, spread
from . import lexing

SPANS = "array<struct<k:string,a:int,b:int>>"
#: Files beyond this many characters are lexed by several tasks, a part of about this size each.
PART = 1 << 18
#: Characters before a part that come along with it, for what looks back.
BEFORE = 32


def run_batches(df: DataFrame, fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Apply ``fn`` to the columns of each row and keep the rows that it gives; by Arrow batch."""
    return run_blocks(df, lambda rows: [r for values in rows for r in fn(*values)], schema)


def run_blocks(df: DataFrame, fn: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each Arrow batch together and keep the rows that it gives."""
    names = df.columns
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            rows = fn(list(zip(*columns, strict=True)))
            found = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(work, schema)


def _parts(lang: str, text: str, size: int) -> list[tuple[int, str, str]]:
    """(number, characters before, characters) of the parts of a huge file."""
    ends = lexing.borders(lang, text, size)
    return [(i, text[max(0, a - BEFORE) : a], text[a:b]) for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]


def _part_map(lang: str, before: str, text: str, states: list[str], last: bool, chunk: int) -> dict[str, str]:
    """The map of a part: the product of those of its chunks."""
    whole, base = before + text, len(before)
    ends = [e + base for e in lexing.borders(lang, text, chunk)]
    maps = [lexing.map_of(lexing.runs_of(lang, whole, a, b, states, last and b == ends[-1])) for a, b in zip([base, *ends[:-1]], ends, strict=True)]
    while len(maps) > 1:
        maps = [lexing.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def _starts(lang: str, maps: list[dict]) -> list[str | None]:
    """True start states of the parts of a file by prefix products; None where no map knows it."""
    start = lexing.start_of(lang)
    products = lexing.prefixes([{e["s"]: e["e"] for e in m["map"]} for m in maps])
    return [start if p is None else p.get(start) for p in products]


def _lex_part(lang: str, before: str, text: str, start: str | None, last: bool, chunk: int, states: list[str], note: lexing.Note | None) -> tuple:
    """(spans, end state, notes) of a part from its start state; the spans' offsets are those in the part."""
    if start is None:
        return None, None, None
    whole, base = before + text, len(before)
    pieces = lexing.pieces_of(lang, whole, chunk, start, base, last, states)
    spans, end = lexing.join_pieces(pieces)
    notes = [note(lang, whole, p, last and p.end == len(whole)) for p in pieces] if note else []
    return [{"k": k, "a": a - base, "b": b - base} for k, a, b in spans], end, notes


def _join_parts(lang: str, parts: list[dict], chunk: int, note: lexing.Note | None) -> lexing.Lexed:
    """A file out of its lexed parts; a part whose start no map knew is lexed here, from the end of the one before."""
    text = "".join(p["text"] for p in parts)
    base, pieces, notes, state = 0, [], [], lexing.start_of(lang)
    states: list[str] | None = None
    for p in parts:
        n, spans, end, said = len(p["text"]), p["spans"], p["end"], p["notes"]
        if p["start"] is None or p["start"] != state:
            states = states if states is not None else lexing.states_of(lang, text)
            own = lexing.pieces_of(lang, text[: base + n], chunk, state, base, base + n == len(text), states)
            pieces += own
            notes += [note(lang, text, x, x.end == len(text)) for x in own] if note else []
            state = own[-1].run.end
        else:
            pieces.append(lexing.Piece(base, base + n, p["start"], lexing.Run([(s["k"], s["a"] + base, s["b"] + base) for s in spans], end)))
            notes += said
            state = end
        base += n
    spans, end = lexing.join_pieces(pieces)
    return lexing.Lexed(lang, text, spans, end, notes)


def _huge(parts: DataFrame, keep: list[tuple[str, str]], note: lexing.Note | None, note_type: str, chunk: int) -> DataFrame:
    """Lex the parts of huge files in parallel: maps of the parts, their prefix products by file, then each part from its true state.

    Only the maps, a few entries a part, meet by file before that. Afterwards a
    file's parts and spans meet for what needs the whole file, which is one row
    of the input.
    """
    at = "key string, lang string, no int, last boolean"
    cols = ["key", "lang", "no", "last"]
    part = parts.repartition("key", "no")
    as_entries = lambda m: [{"s": s, "e": e} for s, e in m.items()]
    maps = run_batches(
        part.select(*cols, "before", "text", "states"),
        lambda key, lang, no, last, before, text, states: [(key, lang, no, last, as_entries(_part_map(lang, before, text, states, last, chunk)))],
        f"{at}, map array<struct<s:string,e:string>>",
    )
    by_file = maps.groupBy("key", "lang").agg(F.sort_array(F.collect_list(F.struct("no", "map"))).alias("maps"))
    starts = run_batches(by_file, lambda key, lang, ms: [(key, m["no"], s) for m, s in zip(ms, _starts(lang, ms), strict=True)], "key string, no int, start string")
    names = [n for n, _ in keep]
    lexed = run_batches(
        part.join(starts, ["key", "no"]).select(*cols, "before", "text", "states", "start", *names),
        lambda key, lang, no, last, before, text, states, start, *more: [(key, lang, no, text, start, *_lex_part(lang, before, text, start, last, chunk, states, note), *more)],
        f"key string, lang string, no int, text string, start string, spans {SPANS}, end string, notes array<{note_type}>" + "".join(f", {n} {t}" for n, t in keep),
    )
    return lexed.groupBy("key", "lang").agg(F.sort_array(F.collect_list(F.struct("no", "text", "start", "spans", "end", "notes"))).alias("parts"), *[F.first(n).alias(n) for n in names])


def lexed_files(
    files: DataFrame, keep: list[str], fn: Callable[..., list[tuple]], schema: str, sniff: bool = True, note: lexing.Note | None = None, note_type: str = "string", chunk: int = lexing.CHUNK, part: int = PART
) -> DataFrame:
    """Run ``fn(*keep values, Lexed)`` over every file, in one pass over ``files``.

    ``files`` needs ``path`` and ``content``. A file is lexed by its chunks in
    the task that reads it, without a shuffle; of a file of more than ``part``
    characters that task gives the parts, which :func:`_huge` lexes in
    parallel. The pass is written to the checkpoint folder, so that neither
    branch reads the table again. ``note`` is said of each chunk. The language
    is that of the extension, with ``sniff`` that which the lines speak for;
    files without one are left out, as are those without content.
    """
    files = files.select(*dict.fromkeys([*keep, "path", "content"])).where(F.col("content").isNotNull())
    types = dict(files.dtypes)
    kept = [(f"k{i}", types[c]) for i, c in enumerate(keep)]
    out = T.StructType.fromDDL(schema).names
    n = len(keep)

    def one(counter: list[int], *values) -> list[tuple]:
        path, text = values[n], values[n + 1]
        own = lexing.language_of(path)
        lang = lexing.sniff(own, text) if sniff else own
        if lang is None:
            return []
        if len(text) <= part:
            return [(dict(zip(out, r, strict=True)), None) for r in fn(*values[:n], lexing.lexed(lang, text, note, chunk))]
        counter[0] += 1
        key = f"{TaskContext.get().partitionId()}-{counter[0]}"
        states, cutup = lexing.states_of(lang, text), _parts(lang, text, part)
        more = {name: v for (name, _), v in zip(kept, values, strict=False)}
        return [(None, {"key": key, "lang": lang, "no": i, "last": i == len(cutup) - 1, "before": b, "text": t, "states": states, **more}) for i, b, t in cutup]

    part_type = "key:string,lang:string,no:int,last:boolean,before:string,text:string,states:array<string>" + "".join(f",{c}:{t}" for c, t in kept)
    out_type = T.StructType.fromDDL(schema).simpleString()
    arrow = to_arrow_schema(T.StructType.fromDDL(f"out {out_type}, part struct<{part_type}>"))
    ordered = files.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("path").alias("p"), F.col("content").alias("c"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = [0]
        for batch in batches:
            rows = [r for values in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in one(counter, *values)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow.field(i).type) for i in (0, 1)], schema=arrow)

    done = cut(spread(ordered).mapInArrow(work, f"out {out_type}, part struct<{part_type}>"))
    small = done.where("out is not null").select("out.*")
    big = _huge(done.where("part is not null").select("part.*"), kept, note, note_type, chunk)
    whole = run_batches(big.select("lang", "parts", *[c for c, _ in kept]), lambda lang, parts, *values: fn(*values, _join_parts(lang, parts, chunk, note)), schema)
    return small.unionByName(whole)
