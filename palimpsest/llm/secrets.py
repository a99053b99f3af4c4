"""Secrets by pattern and by sliding-window Shannon entropy, in SQL expressions only.

All loops are linear in the text's length, and no pattern can recurse on it:
repeated groups are possessive, arrays grow by chunks, and long texts are read
by blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order: (kind, pattern).  Runs below 24 and 20 characters never
#: match, so the least length stands in the patterns of hex and access.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
ASSIGN_LEAST = 6

#: Entropy classes: (kind, characters of a candidate, window, least bits per character, what the candidate must hold).
CLASSES = (
    ("entropy_hex", "0-9A-Fa-f", 32, 3.0, ("[0-9]", "[A-F]")),
    ("entropy_base64", "A-Za-z0-9+/_-", 24, 3.9, ("[0-9].*[0-9]", "[A-Z].*[A-Z]", "[a-z].*[a-z]")),
)
#: Candidates that are no secrets: placeholders, alphabets and keyboards in order, UUIDs, paths and snake_case or dashed words.
SHAPES = r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[a-z]*+(?:[/_-][a-z]*+)++$|^[/_-]?[a-z0-9]{0,11}+(?:[/_-][a-z0-9]{0,11}+)++$"
NAMES = r"example|sample|placeholder|dummy|changeme|xxxx|0123456789|1234567890|abcdefgh|qwerty"
ALLOW = f"(?i){NAMES}|{SHAPES.removeprefix('(?i)')}"
#: Entropy is kept in millionths of a bit times the window, as integers: sums of counts leave no rounding behind.
UNIT = 1_000_000
#: Elements that one array gathers before the next begins; characters read at once; a block of a text.
CHUNK, STRETCH, BLOCK = 256, 2048, 4096
#: Counts of ten characters lie in a long, six bits each; the first character counted is "+".
PACKED, SIX, FIRST, LONGS = 10, 6, 43, 8


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _once(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``value`` computed once as ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _chunked(items: str, start: str, step: str, kind: str, end: str, chunk: int = CHUNK) -> str:
    """SQL: a fold over the array ``items`` that emits elements, linear in its size.

    ``start`` is the first state ``s``; ``step`` (of s and the element x) gives a
    struct of the next state ``s`` and the array ``put`` it emits, of SQL type
    ``kind``; ``end`` (of the last s) gives the array emitted last.  Growing one array
    would copy it at every step, so each chunk has its own.
    """
    own = f"cast(array() as array<{kind}>)"
    many = f"cast(array() as array<array<{kind}>>)"
    inner = (
        f"aggregate(slice(items, g * {chunk} + 1, {chunk}), named_struct('s', c.s, 'put', {own}),"
        f" (b, x) -> transform(array(b.s), s -> transform(array({step}), r -> named_struct('s', r.s, 'put', if(size(r.put) = 0, b.put, concat(b.put, r.put))))[0])[0],"
        f" b -> named_struct('s', b.s, 'out', concat(c.out, array(b.put))))"
    )
    fold = (
        f"if(size(items) = 0, flatten(array({own}, transform(array({start}), s -> {end})[0])), aggregate(sequence(0, (size(items) - 1) div {chunk}), named_struct('s', {start}, 'out', {many}),"
        f" (c, g) -> {inner}, c -> flatten(concat(c.out, array(transform(array(c.s), s -> {end})[0])))))"
    )
    return _once(items, "items", fold)


SPAN = "struct<start:int,rank:int,end:int,kind:string,body:string>"


def _span(start: str, rank: str, end: str, kind: str, body: str = "''") -> str:
    return f"named_struct('start', {start}, 'rank', {rank}, 'end', {end}, 'kind', {kind}, 'body', {body})"


def _spans(text: str, pattern: str, kind: str, rank: int, least: str = "true") -> str:
    """SQL: array of (start, rank, end, kind, body) of the pattern's leftmost matches that pass ``least`` (of x, the match).

    Text outside and inside the matches alternates, so their lengths, in code points, sum to the places.
    """
    p = _quoted(pattern)
    parts = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (o, i) -> named_struct('o', length(o), 'i', i))"
    placed = _chunked(
        f"filter({parts}, y -> y.i is not null)",
        "0",
        f"named_struct('s', s + x.o + length(x.i), 'put', array({_span('s + x.o', str(rank), 's + x.o + length(x.i)', _quoted(kind), 'x.i')}))",
        SPAN,
        f"cast(array() as array<{SPAN}>)",
    )
    return f"case when {text} rlike {p} then filter({placed}, x -> {least}) else cast(array() as array<{SPAN}>) end"


def base_spans(text: str = "text") -> list[tuple[str, str]]:
    """(kind, SQL of its spans)."""
    least = f"length(regexp_extract(x.body, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_LEAST}"
    return [("assign", _spans(text, ASSIGN, "assign", 0, least)), ("access", _spans(text, ACCESS, "access", 1)), ("hex", _spans(text, HEX, "hex", 2))]


def _blocks(text: str) -> str:
    """SQL: a text's blocks, so that a part is cut out without a walk from the start."""
    return f"transform(sequence(0, length({text}) div {BLOCK}), b -> substring({text}, b * {BLOCK} + 1, {BLOCK}))"


def _part(blocks: str, start: str, end: str) -> str:
    """SQL: characters start to end - 1 of a text given as blocks."""
    return f"substring(array_join(slice({blocks}, ({start}) div {BLOCK} + 1, ({end}) div {BLOCK} - ({start}) div {BLOCK} + 1), ''), ({start}) % {BLOCK} + 1, ({end}) - ({start}))"


def _hot(candidate: str, window: int, bits: float) -> str:
    """SQL: array of (first, last), the maximal stretches of ``candidate`` whose windows have at least ``bits`` a character.

    The candidate is cut into codes once.  Each step adds a character's count
    and takes off that of the one that leaves; n * log2(n) summed over the counts
    gives the entropy.  Counts are packed into a few longs.
    """
    logs = "array(" + ", ".join(f"{round(n * math.log2(n) * UNIT) if n else 0}L" for n in range(window + 2)) + ")"
    most = round((math.log2(window) - bits) * window * UNIT)
    place = lambda v: f"{SIX} * ({v} % {PACKED})"
    count = lambda n, v: f"cast(shiftright({n}[{v} div {PACKED}], {place(v)}) & 63 as int)"
    changed = lambda n, v, sign: f"transform({n}, (y, j) -> if(j = {v} div {PACKED}, y {sign} shiftleft(1L, {place(v)}), y))"
    # x: (i, code that enters, code that leaves or -1).  First the new one enters, then the old one leaves.
    entered = f"named_struct('n', {changed('s.n', 'x.c', '+')}, 'sum', s.sum + logs[{count('s.n', 'x.c')} + 1] - logs[{count('s.n', 'x.c')}])"
    left = f"if(x.g < 0, e, named_struct('n', {changed('e.n', 'x.g', '-')}, 'sum', e.sum + logs[{count('e.n', 'x.g')} - 1] - logs[{count('e.n', 'x.g')}]))"
    state = lambda first, last: f"named_struct('n', f.n, 'sum', f.sum, 'first', {first}, 'last', {last})"
    none, kind = "cast(array() as array<struct<first:int,last:int>>)", "struct<first:int,last:int>"
    done = lambda v: f"if({v}.last is null, {none}, array(named_struct('first', {v}.first, 'last', {v}.last)))"
    step = (
        f"transform(transform(array({entered}), e -> {left}), f -> if(x.i >= {window} and f.sum <= {most},"
        f" if(s.last >= x.i - {window}, named_struct('s', {state('s.first', 'x.i')}, 'put', {none}), named_struct('s', {state(f'x.i - {window}', 'x.i')}, 'put', {done('s')})),"
        f" named_struct('s', {state('s.first', 's.last')}, 'put', {none})))[0]"
    )
    start = f"named_struct('n', array_repeat(0L, {LONGS}), 'sum', 0L, 'first', cast(null as int), 'last', cast(null as int))"
    items = f"transform(codes, (v, i) -> named_struct('i', i + 1, 'c', v, 'g', if(i >= {window}, codes[i - {window}], -1)))"
    body = _once(logs, "logs", _chunked(items, start, step, kind, done("s"), STRETCH))
    return f"if(length({candidate}) < {window}, {none}, {_once(f'transform(split({candidate}, {chr(39)}{chr(39)}), v -> ascii(v) - {FIRST})', 'codes', body)})"


def entropy_spans(kind: str, chars: str, window: int, bits: float, holds: tuple[str, ...], rank: int, text: str = "text") -> str:
    """SQL: spans of one character class: in whole runs of its characters, each stretch of windows of high entropy.

    A stretch that the allow list names is searched again by its parts between
    slashes and listed names, so a placeholder does not hide a secret beside it.
    """
    run = f"(?<![{chars}])[{chars}]{{{window},}}+"
    allow, shape = _quoted(ALLOW), _quoted(SHAPES)
    must = " and ".join(f"x.body rlike '{h}'" for h in holds)
    cut = _once(_blocks("x.body"), "bs", f"transform({_hot('x.body', window, bits)}, h -> named_struct('at', {{at}} + h.first, 'body', {_part('bs', 'h.first', 'h.last')}))")
    found = f"flatten(transform({_spans(text, run, kind, rank, must + f' and not x.body rlike {shape}')}, x -> {cut.format(at='x.start')}))"
    part = _spans("y.body", f"(?:(?!(?i:{NAMES}))[^/]){{{window},}}+", kind, rank, f"{must} and not x.body rlike {allow}")
    parts = f"flatten(transform({part}, x -> {cut.format(at='y.at + x.start')}))"
    kept = f"flatten(transform({found}, y -> if(y.body rlike {allow}, {parts}, array(y))))"
    return f"transform({kept}, y -> {_span('y.at', str(rank), 'y.at + length(y.body)', _quoted(kind))})"


def _left(new: str, old: str) -> str:
    """SQL: what the spans ``old`` leave of the spans ``new``, which are apart from each other, in one sweep over both.

    s: ``at`` and ``end`` of the new span at hand, ``rank`` and ``kind`` of it, and how far the old ones ``reach``.
    """
    none = f"cast(array() as array<{SPAN}>)"
    events = f"array_sort(concat(transform({old}, o -> named_struct('start', o.start, 'new', 0, 'end', o.end, 'rank', o.rank, 'kind', o.kind)), transform({new}, o -> named_struct('start', o.start, 'new', 1, 'end', o.end, 'rank', o.rank, 'kind', o.kind))))"
    state = lambda at, end, rank, kind, reach: f"named_struct('at', {at}, 'end', {end}, 'rank', {rank}, 'kind', {kind}, 'reach', {reach})"
    rest = f"if(s.at < s.end, array({_span('s.at', 's.rank', 's.end', 's.kind')}), {none})"
    before = f"if(s.at < least(s.end, x.start), array({_span('s.at', 's.rank', 'least(s.end, x.start)', 's.kind')}), {none})"
    by_old = f"named_struct('s', {state('greatest(s.at, x.end)', 's.end', 's.rank', 's.kind', 'greatest(s.reach, x.end)')}, 'put', {before})"
    by_new = f"named_struct('s', {state('greatest(x.start, s.reach)', 'x.end', 'x.rank', 'x.kind', 's.reach')}, 'put', {rest})"
    start = state("0", "0", "0", "''", "0")
    return f"if(size({new}) = 0, {none}, {_chunked(events, start, f'if(x.new = 1, {by_new}, {by_old})', SPAN, rest)})"


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with columns _assign, _access, _hex (arrays of spans), _more, the spans that entropy adds, and _blocks.

    Of a span that meets base spans, or an earlier class's, what they leave is
    added, unless it holds no letter or digit.
    """
    out = docs.withColumns({f"_{k}": F.expr(sql) for k, sql in base_spans(text)})
    out = out.withColumns({"_more": F.expr("concat(_assign, _access, _hex)"), "_blocks": F.expr(_blocks(text))})
    for rank, c in enumerate(CLASSES, 3):
        out = out.withColumn("_new", F.expr(entropy_spans(*c, rank, text)))
        out = out.withColumn("_more", F.expr(f"concat(_more, filter({_left('_new', '_more')}, x -> {_part('_blocks', 'x.start', 'x.end')} rlike '[0-9A-Za-z]'))"))
    return out.withColumn("_more", F.expr("filter(_more, x -> x.rank >= 3)")).drop("_new")


def _joined(*arrays: str) -> Column:
    return F.expr(f"array_join(transform(array_sort(concat({', '.join(arrays)})), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, in the order of
    start and kind.  Base kinds are whole matches of their patterns; the method
    adds entropy_hex and entropy_base64.  A null text is empty; an empty
    text has no spans; repeated rows are scanned each; an empty table gives no
    rows; very long texts and runs take time in proportion; only doc_id and
    text are read.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = with_spans(rows)
    sizes = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *sizes, F.sha2(_joined("_assign", "_access", "_hex"), 256).alias("base_sha256"), _joined("_assign", "_access", "_hex", "_more").alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; spans that meet become one mark.

    Texts without spans, null texts and all other columns stay; n_chars, if
    there is such a column, follows the text.
    """
    named = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*named)
    text = named[docs.columns.index("text")]
    found = with_spans(plain.withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit(""))), "_text")
    step = (
        "if(x.start < s, named_struct('s', greatest(s, x.end), 'put', cast(array() as array<string>)),"
        f" named_struct('s', x.end, 'put', array({_part('_blocks', 's', 'x.start')}, {_quoted(mark)})))"
    )
    cut = f"array_join({_chunked('array_sort(concat(_assign, _access, _hex, _more))', '0', step, 'string', 'array(' + _part('_blocks', 's', 'length(_text)') + ')')}, '')"
    new = F.expr(f"case when size(_assign) + size(_access) + size(_hex) + size(_more) > 0 then {cut} else {text} end")
    out = found.withColumn("_out", new)
    columns = []
    for c, n, t in zip(docs.columns, named, docs.schema, strict=True):
        if c == "text":
            columns.append(F.col("_out").cast(t.dataType).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("_out").eqNullSafe(F.col(text)), F.col(n)).otherwise(F.length("_out")).cast(t.dataType).alias(c))
        else:
            columns.append(F.col(n).alias(c))
    return out.select(*columns)
