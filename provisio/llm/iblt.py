r"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions alone (operator 6).

A text's paragraphs are the passages of its lines, at any length: a passage ends with a sentence mark before a space, with a
mark or one of two frequent particles of Chinese and Japanese, and between a word that ends in d or y and one that begins
with a, b or w.  The last is a cut that the words themselves set, about every twenty-fifth in English, so that an edit of
text without marks, too, changes the passages it touches and no others.  Each distinct passage's 64-bit digest stands in one cell of each of three sub-tables; a cell holds the number of its digests and the
exclusive or of the digests and of their checks.  The fingerprint is the sketch with 3 x WIDTH cells in hex, after the
number of digests.

Two fingerprints are subtracted cell by cell: shared digests vanish.  Peeling takes out cells that hold a single digest
until nothing is left; what was taken out are the digests that differ, with their side.  If cells remain, the digests are
sketched again, larger: dealt by their bits over as many small tables as their number asks for, and a table that still
doesn't empty is made twice as wide, DOUBLINGS times.  A table of six digests on average that 3 x 32 x 2 ** 14 cells don't
empty needs digests that agree in 63 bits: then, and only then, the sets themselves are compared, with the same result.
The likeness is the Jaccard index of the two digest sets.

Neighbours by descending id are found without a global sort: ids are cut at their quantiles, each range is one group of a
window, and the first rows of each range stand once more, as guests, at the end of the range above.

Defined cases: null or empty text, and white space alone, has no paragraph; two empty sets are alike (1.0), an empty one
and another are not (0.0); repeated paragraphs count once; rows with equal ids are ordered by a hash of their text; null
ids come last; a single row is its own next document; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH, TABLE_WIDTH, PER_TABLE, ROUNDS, DOUBLINGS, RANGE_ROWS = 12, 32, 6, 10, 14, 500
#: Where a line is cut into passages.
CUTS = "(?<=[.!?;…]) +|(?<=[。！？；、，を的])|(?<=[dy]) +(?=[abw])"
EMPTY = "named_struct('n', 0, 'k', 0L, 'h', 0L)"


def _item(sign: str, digest: str, check: str, width: str) -> str:
    """An item: its sign, digest and check, and its cell in each of the three sub-tables, taken from other bits each."""
    at = [f"CAST({t} * {width} + (shiftrightunsigned({digest}, {21 * t}) & 2097151L) % {width} AS INT)" for t in range(3)]
    return f"named_struct('s', {sign}, 'd', {digest}, 'h', {check}, 'a', {at[0]}, 'b', {at[1]}, 'c', {at[2]})"


def _cells(items: str, width: str) -> str:
    """Sketch of items: an array of 3 * width cells (n: number, k: digests, h: checks)."""
    tables = [f"transform(sequence({t} * {width}, {t + 1} * {width} - 1), i -> aggregate(filter({items}, x -> x.{place} = i), {EMPTY}, "
              "(a, x) -> named_struct('n', a.n + x.s, 'k', a.k ^ x.d, 'h', a.h ^ x.h)))" for t, place in enumerate("abc")]
    return f"concat({', '.join(tables)})"


def _filled(items: str) -> str:
    """The cells of a sketch that items stand in, each with its place (i); the others are empty."""
    places = f"array_distinct(flatten(transform({items}, x -> array(x.a, x.b, x.c))))"
    return _rest(f"transform({places}, i -> aggregate(filter({items}, x -> x.a = i OR x.b = i OR x.c = i), named_struct('i', i, 'n', 0, 'k', 0L, 'h', 0L), "
                 "(a, x) -> named_struct('i', a.i, 'n', a.n + x.s, 'k', a.k ^ x.d, 'h', a.h ^ x.h)))")


def _rest(cells: str) -> str:
    """Cells that aren't empty."""
    return f"filter({cells}, c -> c.n <> 0 OR c.k <> 0L OR c.h <> 0L)"


def _peel(cells: str, width: str) -> str:
    """Peeling of a subtracted sketch's filled cells: struct(cells, live, plus, minus); live: cells may still be peeled."""
    one = lambda n: f"transform(array_distinct(transform(filter(s.cells, c -> c.n = {n} AND xxhash64(c.k) = c.h), c -> c.k)), d -> {_item(n, 'd', 'xxhash64(d)', width)})"
    pure = f"concat({one('1')}, {one('-1')})"
    taken = _rest("transform(s.cells, c -> aggregate(filter(p, x -> x.a = c.i OR x.b = c.i OR x.c = c.i), c, "
                  "(a, x) -> named_struct('i', a.i, 'n', a.n - x.s, 'k', a.k ^ x.d, 'h', a.h ^ x.h)))")
    step = (f"transform(array({pure}), p -> if(size(p) = 0, named_struct('cells', s.cells, 'live', false, 'plus', s.plus, 'minus', s.minus), "
            f"named_struct('cells', {taken}, 'live', true, 'plus', s.plus + size(filter(p, x -> x.s > 0)), 'minus', s.minus + size(filter(p, x -> x.s < 0)))))[0]")
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'live', true, 'plus', 0, 'minus', 0), (s, r) -> if(s.live, {step}, s))"


def _told(peeled: str) -> str:
    """struct(ok, plus, minus) of a peeled sketch."""
    return f"transform(array({peeled}), q -> named_struct('ok', size(q.cells) = 0, 'plus', q.plus, 'minus', q.minus))[0]"


def paragraphs(text: str) -> Column:
    """Distinct digests of a text's passages."""
    return F.expr(f"""array_distinct(transform(filter(flatten(transform(split(coalesce({text}, ''), '\\n'),
        l -> split(l, '{CUTS}'))), u -> char_length(trim(u)) > 0), u -> xxhash64(trim(u))))""")


def sketch(digests: str, width: int = WIDTH) -> Column:
    """The cells of a set of digests."""
    items = f"transform({digests}, d -> {_item('1', 'd', 'xxhash64(d)', str(width))})"
    return F.expr(f"transform(array({items}), it -> {_cells('it', str(width))})[0]")


def fingerprint(digests: str, cells: str) -> Column:
    """A sketch in hex, after the number of digests."""
    return F.expr(f"concat(size({digests}), ':', concat_ws('', transform({cells}, c -> concat(lpad(hex(c.n), 6, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.h & 4294967295L), 8, '0')))))")


def difference(cells_a: str, cells_b: str) -> Column:
    """struct(ok, plus, minus) from two sketches of the base width."""
    cut = f"zip_with({cells_a}, {cells_b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    placed = _rest(f"transform({cut}, (c, i) -> named_struct('i', i, 'n', c.n, 'k', c.k, 'h', c.h))")
    return F.expr(_told(_peel(placed, str(WIDTH))))


def _tables(a: str, b: str) -> str:
    """The signed digests of two sets dealt over small tables, in two steps: an array of arrays of items."""
    items = (f"concat(transform({a}, d -> named_struct('s', 1, 'd', d, 'h', xxhash64(d))), transform({b}, d -> named_struct('s', -1, 'd', d, 'h', xxhash64(d))))")
    side = f"greatest(1, CAST(ceil(sqrt((size({a}) + size({b})) / {PER_TABLE})) AS INT))"
    first = f"transform(sequence(0, {side} - 1), i -> filter(it, x -> (x.h & 2147483647L) % {side} = i))"
    return f"flatten(transform(transform(array({items}), it -> {first})[0], part -> transform(sequence(0, {side} - 1), j -> filter(part, x -> shiftrightunsigned(x.h, 32) % {side} = j))))"


def larger(dealt: str) -> Column:
    """struct(ok, plus, minus) summed over the tables, each sketched wider until it empties."""
    width = f"({TABLE_WIDTH} << k)"
    own = f"transform(it, x -> {_item('x.s', 'x.d', 'x.h', width)})"
    again = _told(_peel(f"transform(array({own}), j -> {_filled('j')})[0]", width))
    one = f"aggregate(sequence(0, {DOUBLINGS}), named_struct('ok', false, 'plus', 0, 'minus', 0), (r, k) -> if(r.ok, r, {again}))"
    lone = "named_struct('ok', t.ok, 'plus', t.plus + if(it[0].s > 0, 1, 0), 'minus', t.minus + if(it[0].s < 0, 1, 0))"  # a single digest is a pure cell
    return F.expr(f"aggregate({dealt}, named_struct('ok', true, 'plus', 0, 'minus', 0), (t, it) -> if(size(it) = 0, t, if(size(it) = 1, {lone}, "
                  f"transform(array({one}), r -> named_struct('ok', t.ok AND r.ok, 'plus', t.plus + r.plus, 'minus', t.minus + r.minus))[0])))")


def with_likeness(df: DataFrame, a: str, b: str, cells_a: str, cells_b: str, name: str) -> DataFrame:
    """Add the Jaccard index of two digest columns, told by their sketches."""
    small, more = f"{name}_small", f"{name}_larger"
    df = df.withColumn(small, difference(cells_a, cells_b))
    df = df.withColumn(more, F.when(F.col(small).ok, F.col(small)).otherwise(larger(_tables(a, b))))
    told = F.col(more)
    plus = F.when(told.ok, told.plus).otherwise(F.size(F.array_except(a, b)))  # a table that no width empties
    minus = F.when(told.ok, told.minus).otherwise(F.size(F.array_except(b, a)))
    whole = F.size(a) + minus
    return df.withColumn(name, F.when(whole == 0, F.lit(1.0)).otherwise((F.size(a) - plus) / whole)).drop(small, more)


def next_by_id(docs: DataFrame, key: str, columns: list[str], tie: str) -> DataFrame:
    """`docs` (key, columns, tie) with `following`: the columns of the next row by descending key, cyclic."""
    n = docs.count()
    ranges = max(1, min(1 << 14, n // RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges + 10_000).alias("cuts")).first()["cuts"] if ranges > 1 else None
    cuts = sorted(set(cuts or []))
    step = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    if rows:  # how many cuts lie below the key, in two steps
        heads = F.array(*(F.lit(r[0]) for r in rows))
        above = F.size(F.filter(heads, lambda c: c < F.col(key)))
        each = F.array(*(F.array(*map(F.lit, r)) for r in rows))
        inner = F.size(F.filter(F.when(above > 0, F.element_at(each, F.greatest(above, F.lit(1)))), lambda c: c < F.col(key)))
        place = F.when(above > 0, (above - 1) * step + inner).otherwise(0)
    else:
        place = F.lit(0)
    dealt = docs.withColumn("range", F.when(F.col(key).isNull(), -1).otherwise(place).cast("int"))
    found = dealt.select("range", key).groupBy("range").agg(F.max(key).alias("top")).orderBy(F.desc("range")).collect()
    guests = dealt.limit(0).withColumn("guest", F.lit(True))
    for chunk in range(0, len(found), 4096):
        part = [(found[i].range, found[(i + 1) % len(found)].top) for i in range(chunk, min(len(found), chunk + 4096))]
        known = {top: r for r, top in part if top is not None}
        if known:
            to = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.col(key))
            guests = guests.unionByName(dealt.where(F.col(key).isin(list(known))).withColumn("range", to).withColumn("guest", F.lit(True)))
        for r in (r for r, top in part if top is None):
            guests = guests.unionByName(dealt.where(F.col(key).isNull()).orderBy(tie).limit(1).withColumn("range", F.lit(r)).withColumn("guest", F.lit(True)))
    order = Window.partitionBy("range").orderBy("guest", F.col(key).desc_nulls_last(), F.col(tie))
    whole = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    return whole.withColumn("following", F.lead(F.struct(*columns)).over(order)).where(~F.col("guest")).drop("range", "guest")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  The edited text
    has its second half replaced by the next document's beginning."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumns({"digests": paragraphs("body"), "tie": F.xxhash64("body")})
    df = next_by_id(rows, "id", ["body", "digests"], "tie")
    df = df.select("id", "body", "digests", F.col("following.body").alias("next_body"), F.col("following.digests").alias("next_digests"), F.char_length("body").cast("long").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("body", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_body", F.lit(1), half))
    df = df.select("id", "n_chars", "digests", "next_digests", edited.alias("edited"))
    df = df.select("id", "n_chars", "digests", "next_digests", F.sha2("edited", 256).alias("edited_sha256"), paragraphs("edited").alias("edited_digests"))
    df = df.withColumns({f"{x}cells": sketch(f"{x}digests") for x in ("", "edited_", "next_")})
    df = with_likeness(df, "digests", "edited_digests", "cells", "edited_cells", "near_edited")
    df = with_likeness(df, "digests", "next_digests", "cells", "next_cells", "near_next")
    return df.select(F.col("id").alias(doc_id), "n_chars", "edited_sha256", fingerprint("digests", "cells").alias("fingerprint"),
                     fingerprint("edited_digests", "edited_cells").alias("edited_fingerprint"), "near_edited", "near_next")
