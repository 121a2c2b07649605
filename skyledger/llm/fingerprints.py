"""Document fingerprints that subtract: an invertible Bloom lookup sketch of paragraph digests.

A text is cut into paragraphs (lines; a long line also at the first sentence end after ``LONG`` characters), and every
distinct paragraph gives a 64-bit digest. The sketch has ``TABLES`` tables of ``CELLS`` cells; a digest falls into one
cell of each table, and a cell holds how many digests it got, their exclusive or, and that of their checks. Two
sketches subtract cell by cell, what the texts share cancels, and *peeling* reads the rest: a cell of one digest names
it, taking it out of its other cells frees more. If peeling gets stuck, the difference is larger than the sketch
holds, and the digests are sketched again in parts: twice the cells per attempt, and the plain difference of the
digest lists after the last.

Everything is a column expression over one row: no join, no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare

TABLES, CELLS = 3, 16
LONG = 100
HELD = 20  # digests that a sketch of this size gives back nearly always
ATTEMPTS = 3
BLOCK_CHARS = 32_000_000  # characters of text that are put in order by one task
_BRANCH = 64

PARAGRAPH = rf"[^\n]{{{LONG},}}?[.!?](?=\s|$)|[^\n]+"


def digests(text: Column) -> Column:
    """Distinct paragraph digests of a text."""
    paragraphs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(paragraphs, lambda p: F.xxhash64(p)))


# where each cell looks: a table's bits of a digest, and the number they must be
_PLACES = "array({})".format(", ".join(
    f"named_struct('bits', {(64 // TABLES - 1) * table}, 'at', {at}L)" for table in range(TABLES) for at in range(CELLS)))


def _within(cell: str, digest: str) -> str:
    """Whether a digest falls into a cell."""
    return f"shiftrightunsigned({digest}, {cell}.bits) & {CELLS - 1}L = {cell}.at"


def _sketch(found: str) -> str:
    """SQL of the cells of an array of digests; a cell carries its place."""
    return f"""transform(transform({_PLACES}, c -> named_struct('c', c, 'm', filter({found}, x -> {_within('c', 'x')}))), w ->
        named_struct('n', size(w.m), 'key', aggregate(w.m, 0L, (a, x) -> a ^ x),
                     'check', aggregate(w.m, 0L, (a, x) -> a ^ xxhash64(x)), 'bits', w.c.bits, 'at', w.c.at))"""


def _minus(left: str, right: str) -> str:
    return f"""zip_with({left}, {right}, (a, b) -> named_struct(
        'n', a.n - b.n, 'key', a.key ^ b.key, 'check', a.check ^ b.check, 'bits', a.bits, 'at', a.at))"""


def _peel(cells: str) -> str:
    """SQL of ``struct<cells, found, going>`` after peeling; it succeeded if all cells are empty."""
    pure = "filter(s.cells, c -> abs(c.n) = 1 AND c.check = xxhash64(c.key))"
    fresh = f"array_distinct(transform({pure}, c -> named_struct('key', c.key, 'n', c.n)))"
    # what a cell loses: the fresh digests that fall into it
    lost = f"filter(f, x -> {_within('c', 'x.key')})"
    emptied = f"""transform(transform(s.cells, c -> named_struct('c', c, 'out', {lost})), m -> if(size(m.out) = 0, m.c,
        named_struct('n', m.c.n - aggregate(m.out, 0, (a, x) -> a + x.n),
                     'key', m.c.key ^ aggregate(m.out, 0L, (a, x) -> a ^ x.key),
                     'check', m.c.check ^ aggregate(m.out, 0L, (a, x) -> a ^ xxhash64(x.key)),
                     'bits', m.c.bits, 'at', m.c.at)))"""
    step = f"""element_at(transform(array({fresh}), f -> named_struct('cells', if(size(f) = 0, s.cells, {emptied}),
        'found', concat(s.found, f), 'going', size(f) > 0)), 1)"""
    start = f"""named_struct('cells', {cells}, 'found', cast(array() AS array<struct<key: bigint, n: int>>), 'going', true)"""
    # each round but the last finds a digest, and a sketch yields no more digests than it has cells
    return f"aggregate(sequence(1, {TABLES * CELLS}), {start}, (s, _) -> if(s.going, {step}, s))"


def with_sketch(df: DataFrame, found: str, out: str) -> DataFrame:
    """Add ``out``: the cells of the digests in column ``found``."""
    return df.withColumn(out, F.expr(_sketch(f"`{found}`")))


def printed(cells: str) -> Column:
    """A sketch as text, the fingerprint; sketches are equal exactly when their texts are."""
    return F.array_join(F.transform(F.col(cells), lambda c: F.when(c["n"] == 0, "").otherwise(F.concat_ws(
        ":", c["n"].cast("string"), F.lower(F.hex(c["key"])), F.lower(F.hex(c["check"]))))), ",")


_DONE = "forall({0}, c -> c.n = 0 AND c.key = 0 AND c.check = 0)"


def _in_parts(left: str, right: str, attempt: int) -> str:
    """SQL of ``struct<found, ok>`` from sketches of parts of the digests, more parts with each attempt.

    Parts are split off in two levels, so a text of n paragraphs costs n to the power of 1.5 and not its square.
    """
    parts = f"greatest(2, (size({left}) + size({right})) * {attempt} div {HELD})"
    outer, inner = f"cast(ceil(sqrt({parts})) AS int)", f"cast(ceil({parts} / ceil(sqrt({parts}))) AS int)"

    def within(digests_: str, bit: int, count: str, part: str) -> str:
        return f"filter({digests_}, x -> (shiftrightunsigned(x, {bit}) & 65535) % {count} = {part})"

    peeled = _peel(_minus(_sketch("w.l"), _sketch("w.r")))
    inside = f"""transform(transform(sequence(0, {inner} - 1), i -> named_struct(
        'l', {within('v.l', 47 - attempt, inner, 'i')}, 'r', {within('v.r', 47 - attempt, inner, 'i')})), w -> {peeled})"""
    every = f"""flatten(transform(transform(sequence(0, {outer} - 1), o -> named_struct(
        'l', {within(left, 23 + attempt, outer, 'o')}, 'r', {within(right, 23 + attempt, outer, 'o')})), v -> {inside}))"""
    return f"""element_at(transform(array({every}), e -> named_struct('found', flatten(transform(e, p -> p.found)),
        'ok', forall(e, p -> {_DONE.format('p.cells')}))), 1)"""


def differences(df: DataFrame, left: str, left_cells: str, right: str, right_cells: str, out: str) -> DataFrame:
    """Add ``out``: ``array<struct<key, n>>``, the digests that one of two texts has alone (n = 1 left, -1 right).

    ``left`` and ``right`` name columns of digests, the others their sketches. The sketches are peeled first; the
    digests are read again only where that fails.
    """
    left, right = f"`{left}`", f"`{right}`"
    first = _peel(_minus(f"`{left_cells}`", f"`{right_cells}`"))
    df = df.withColumn("_r0", F.expr(f"""element_at(transform(array({first}), p -> named_struct(
        'found', p.found, 'ok', {_DONE.format('p.cells')})), 1)"""))
    for attempt in range(1, ATTEMPTS + 1):
        df = df.withColumn(f"_r{attempt}", F.expr(
            f"if(_r{attempt - 1}.ok, _r{attempt - 1}, {_in_parts(left, right, attempt)})"))
    plain = f"""concat(transform(array_except({left}, {right}), x -> named_struct('key', x, 'n', 1)),
                       transform(array_except({right}, {left}), x -> named_struct('key', x, 'n', -1)))"""
    last = f"_r{ATTEMPTS}"
    return df.withColumn(out, F.expr(f"if({last}.ok, {last}.found, {plain})")).drop(
        *[f"_r{i}" for i in range(ATTEMPTS + 1)])


def likeness(left: str, right: str, difference: str) -> Column:
    """Shared digests over all digests of two texts, from their counts and the difference; 1 for two empty texts."""
    apart = F.size(difference)
    shared = (F.size(left) + F.size(right) - apart) / 2
    return F.when(shared + apart == 0, F.lit(1.0)).otherwise(shared / (shared + apart)).cast("double")


def with_next(df: DataFrame, doc_id: str, values: list[str], chars: str) -> DataFrame:
    """Add ``next_<name>`` for each of ``values``: that of the next row by descending ``doc_id``, the first's for the last.

    Ids at quantiles, one block for so many characters of text, cut the rows into blocks; every block is ordered by
    its own task, and the first row of a block is sent to the block before as well, so the texts are shuffled once.
    Rows with a null id have no neighbour and get null; rows of one id follow each other in the order of a hash of their values.
    """
    sums = df.agg(F.sum(chars).alias("n"), F.max(doc_id).alias("top")).first()
    count = max(1, (sums["n"] or 0) // BLOCK_CHARS)
    bounds = [sums["top"]] if sums["top"] is not None else []
    if count > 1:
        cuts = df.agg(F.percentile_approx(doc_id, [i / count for i in range(1, count)], 100 * count).alias("c")).first()["c"]
        bounds = sorted({*cuts, *bounds})
    # the block of a row is the smallest bound not below its id; a bound is the first row of its block
    block, levels = F.lit(0), [bounds]
    while len(levels[0]) > _BRANCH:
        levels.insert(0, levels[0][_BRANCH - 1::_BRANCH])
    at = F.col(doc_id)
    for level in levels:
        known = F.array(*[F.lit(b).cast("bigint") for b in level])
        block = block * _BRANCH + F.size(F.filter(
            F.slice(known, block * _BRANCH + 1, F.lit(_BRANCH)) if len(levels) > 1 else known, lambda b: b < at))
    # descending order visits the blocks from the last to the first
    last = len(bounds) - 1
    ahead = F.element_at(F.array(*[F.lit(b).cast("bigint") for b in bounds] or [F.lit(None).cast("bigint")]),
                         F.col("_block") + 1)
    lonely = -1 - F.pmod(F.xxhash64(*values), F.lit(_BRANCH))
    placed = df.withColumn("_block", F.when(at.isNull(), lonely).otherwise(block).cast("int"))
    copies = F.when((F.col("_block") >= 0) & (at == ahead), F.array(
        F.struct(F.col("_block").alias("_block"), F.lit(0).alias("_carried")),
        F.struct(F.when(F.col("_block") == last, 0).otherwise(F.col("_block") + 1).alias("_block"), F.lit(1).alias("_carried")),
    )).otherwise(F.array(F.struct(F.col("_block").alias("_block"), F.lit(0).alias("_carried"))))
    spread = placed.withColumn("_to", F.explode(copies)).drop("_block").select("*", "_to.*").drop("_to")
    order = Window.partitionBy("_block").orderBy("_carried", F.desc(doc_id), F.xxhash64(*values))
    # plain columns: an expression here would travel beside the columns it is made of
    following = {f"next_{v}": F.lead(v).over(order) for v in values}
    found = spread.withColumns(following).filter("_carried = 0").drop("_block", "_carried")
    return found.withColumns({name: F.when(at.isNotNull(), F.col(name)) for name in following})


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``: struct ``digests`` and ``cells``, what subtraction and peeling work on.

    Null texts count as empty; an empty text has no digests and an empty sketch. Paragraphs that repeat within a text
    count once. A column named ``out`` is replaced; the other columns and repeated rows stay; empty gives empty.
    """
    prepare(df.sparkSession)
    found = with_sketch(df.withColumn("_digests", digests(F.col(text))), "_digests", "_cells")
    return found.withColumn(out, F.struct(F.col("_digests").alias("digests"), F.col("_cells").alias("cells"))).drop(
        "_digests", "_cells")
