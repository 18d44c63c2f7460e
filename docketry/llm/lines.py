"""Line dedup (operator 1): near-equal lines by MinHash over character shingles; DataFrame operations only.

Distinct lines get 32 minima of hashed shingles.  The minima stand in a 4 by 8 grid; each of 16 of its lines
(columns and one set of diagonals) is a band, so that two lines of similarity 0.8 share no band in 0.2% of cases
(independent minima; 0.03% at 0.85).  In large buckets a finer level misses another 0.2%.  What shares
a band is compared in full (beyond the hubs' pairs unless bitmaps prove it unlike), and a distributed union-find joins
what is alike.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, materialize, require, unused
from docketry.llm.graph import connected_components

MINIMA = 32
#: Fresh minima, minima in a band, and bands, each time that lines from large buckets are banded again.
FINER = [(96, 8, 56)]
#: Ids of lines that are sent to all executors at most (8 MB); more are met by a shuffle.
BROADCAST_IDS = 1_000_000
#: Parts of the first level's bands, whose buckets are found one part after the other: a part's shuffle goes with its job.
PARTS = 2
#: Lines on each side of a block of comparisons, about.
BLOCK_LINES = 256
#: Shingles in one row while minima are taken.
NEIGHBOURS = 4
#: 64-bit words of a line's bitmap of shingles (a power of two).
BITMAP_WORDS = 64
#: Words of a bitmap that are gathered together.
WORD_GROUP = 8
#: Places of the 4 by 8 grid that make up a band: columns, and broken diagonals.
BANDS = [[8 * r + (c + slope * r) % 8 for r in range(4)] for slope in range(2) for c in range(8)]
_BLANKS = " \t\r\f\v"
#: Stands for a null doc_id, behind all others.
_NO_DOC = (1 << 63) - 1


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, line_no, line``: every line with a word, without blanks at its ends.

    ``text_hash`` tells rows with one doc_id apart.
    """
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.withColumn("line", F.btrim("line", F.lit(_BLANKS))).where("line <> ''")


def _line_count(text: str) -> Column:
    """Lines with a word; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\t\r\f\x0B\n][^\n]*")), F.lit(0)).cast("long")


def _place() -> Column:
    """One number for a line's place, ordered by doc_id (null last), then line."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)).cast("decimal(20,0)")
    return (doc * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(38,0)")


def _characters(line: str) -> str:
    """Two bytes for each character (those beyond the first plane count as two)."""
    return f"encode(lower({line}), 'UTF-16BE')"


def _shingles(line: str, k: int) -> Column:
    """Hashes of a line's ``k``-character shingles, repeats included.

    The characters stand as the variable of an outer lambda: a column of a row would be copied for every shingle."""
    steps = f"sequence(1, octet_length(c) - {2 * k - 1}, 2)"
    return F.expr(f"transform(array({_characters(line)}), c -> transform({steps}, i -> xxhash64(substring(c, i, {2 * k}))))[0]")


def _hashed(kinds: DataFrame, k: int, *also: str) -> DataFrame:
    """``id, h int`` for every shingle of the lines ``(id, line)`` with ``k`` characters or more; ``most`` is their number."""
    rows = kinds.where(F.char_length("line") >= k).select("id", F.expr(_characters("line")).alias("b"))
    last = F.octet_length("b") - (2 * k - 1)
    rows = rows.select("id", "b", ((last + 1) / 2).cast("int").alias("most"), F.explode(F.sequence(F.lit(1), last, F.lit(2))).alias("i"))
    return rows.select("id", *also, F.expr(f"hash(substring(b, i, {2 * k}))").alias("h"))


def minima(kinds: DataFrame, k: int, start: int = 0, count: int = MINIMA) -> DataFrame:
    """``id, m array<int>`` of lines ``(id, line)`` with ``k`` characters or more: ``count`` minima from the ``start``-th.

    The j-th minimum is taken over the shingles' hashes xor a fixed number, which is a random order of its own.
    A row holds a few neighbouring shingles, whose least is found before the line's minimum is looked up; behind
    the last shingle it is repeated, which changes no minimum.
    """
    rows = kinds.where(F.char_length("line") >= k).select("id", F.expr(_characters("line")).alias("b"))
    rows = rows.withColumn("last", F.octet_length("b") - (2 * k - 1))
    rows = rows.select("id", "b", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * NEIGHBOURS))).alias("i"))
    rows = rows.select("id", *[F.expr(f"hash(substring(b, least(i + {2 * n}, last), {2 * k}))").alias(f"h{n}") for n in range(NEIGHBOURS)])
    order = lambda j: [F.col(f"h{n}").bitwiseXOR(F.expr(f"hash({j}, 'order')")) for n in range(NEIGHBOURS)]
    found = rows.groupBy("id").agg(*[F.min(F.least(*order(j))).alias(f"m{j}") for j in range(start, start + count)])
    return found.select("id", F.array(*[f"m{j}" for j in range(start, start + count)]).alias("m"))


def of_ids(table: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """The rows of ``table`` with an ``id`` among ``ids``, as a written table; ids are broadcast only if they are few."""
    few = ids.count() <= BROADCAST_IDS
    return materialize(table.join(F.broadcast(ids) if few else ids, "id", "left_semi"), label)


def bitmaps(kinds: DataFrame, k: int) -> DataFrame:
    """``id, most, bits``: how many shingles a line has at most, and the words of a bitmap of the slots that they
    fall into.  Words are gathered in groups of a few and stand in one array: tables of many columns are slow."""
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(BITMAP_WORDS - 1), F.expr("shiftleft(1L, h & 63)")
    rows = _hashed(kinds, k, "most").select("id", "most", (word % WORD_GROUP).alias("at"), F.floor(word / WORD_GROUP).cast("int").alias("part"), bit.alias("bit"))
    parts = rows.groupBy("id", "part").agg(F.max("most").alias("most"), *[F.bit_or(F.when(F.col("at") == j, F.col("bit")).otherwise(0)).alias(f"p{j}") for j in range(WORD_GROUP)])
    parts = parts.select("id", "part", "most", F.array(*[f"p{j}" for j in range(WORD_GROUP)]).alias("p"))
    each, none = range(BITMAP_WORDS // WORD_GROUP), F.array_repeat(F.lit(0).cast("long"), WORD_GROUP)
    found = parts.groupBy("id").agg(F.max("most").alias("most"), *[F.max(F.when(F.col("part") == j, F.col("p"))).alias(f"g{j}") for j in each])
    return found.select("id", "most", F.flatten(F.array(*[F.coalesce(f"g{j}", none) for j in each])).alias("bits"))


def map_columns(name: str) -> list[Column]:
    """The columns of :func:`bitmaps` under names that begin with ``name``."""
    return [F.col(c).alias(name + c) for c in ("most", "bits")]


def may_be_alike(x: str, y: str, similarity: float) -> Column:
    """False only if two bitmaps prove that the lines aren't alike.

    A slot that one line fills and the other doesn't holds a shingle that they don't share.  Sets of n and m
    elements with d of them not shared have a Jaccard similarity of (n + m - d) / (n + m + d).
    """
    differ = F.zip_with(x + "bits", y + "bits", lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(differ, F.lit(0), lambda all, d: all + d)
    return (1 + similarity) * apart <= (1 - similarity) * (F.col(f"{x}most") + F.col(f"{y}most")) + 1e-6


def _close(x: Column, y: Column, similarity: float) -> Column:
    """Whether two sets have that Jaccard similarity: sets of n and m elements that share s have n + m - s together."""
    return (1 + similarity) * F.size(F.array_intersect(x, y)) >= similarity * (F.size(x) + F.size(y)) - 1e-9


def alike(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The ``pairs (a, b)`` of ids whose lines' shingle sets have that Jaccard similarity or more, as a written table.

    For pairs where a line stands in many: the shingle set of each line is worked out once.
    """
    lines = of_ids(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "line-compared")
    sets = materialize(lines.select("id", F.array_distinct(_shingles("line", k)).alias("s")), "line-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    out = materialize(both.where(_close(F.col("x"), F.col("y"), similarity)).select("a", "b"), "line-edges")
    for old in (lines, sets):
        discard(old)
    return out


def alike_by_text(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """As :func:`alike`, for pairs where most lines stand in one or two: the lines meet, and both shingle sets, which take
    several times their room, are worked out where they are compared."""
    line = lambda of, name: texts.select(F.col("id").alias(of), F.col("line").alias(name))
    both = pairs.join(line("a", "p"), "a").join(line("b", "q"), "b")
    # as a lambda's variable the sets are worked out once, not wherever they are named
    sets = F.array(F.struct(F.array_distinct(_shingles("p", k)).alias("x"), F.array_distinct(_shingles("q", k)).alias("y")))
    return materialize(both.where(F.transform(sets, lambda v: _close(v["x"], v["y"], similarity))[0]).select("a", "b"), "line-edges")


def finer_bands(level: int) -> list[list[int]]:
    """Bands of a finer level over its own minima, each of which stands in about as many; the same each time."""
    count, size, wanted = FINER[level]
    draw, bands, left = random.Random(level), [], []
    while len(bands) < wanted:
        if len(left) < size:
            left = draw.sample(range(count), count)
        bands.append(sorted(left[:size]))
        left = left[size:]
    return bands


def banded(signed: DataFrame, bands: list[tuple[int, list[int]]], *also: str) -> DataFrame:
    """``id, key``: the keys of each line's numbered bands, beside what is ``also`` wanted."""
    keys = [F.xxhash64(F.lit(n), *[F.col("m")[p] for p in places]) for n, places in bands]
    return signed.select("id", *also, F.explode(F.array(*keys)).alias("key"))


def buckets(signed: DataFrame, bands: list[list[int]], parts: int = 1) -> list[DataFrame]:
    """``key, id, label, n``: the lines of every bucket that holds two labels, and how many they are, as written tables,
    one for each part of the bands.  Without a ``label`` each line is its own: then a bucket's size and its lines come from
    one shuffle."""
    label, also = ("label", ["label"]) if "label" in signed.columns else ("id", [])
    found, numbered = [], list(enumerate(bands))
    for part in range(parts):
        rows = banded(signed, numbered[part::parts], *also).repartition("key")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min(label) < F.max(label)).alias("some")).where("some").drop("some")
        members = rows.join(sizes.hint("shuffle_hash"), "key").select("key", "id", F.col(label).alias("label"), "n")
        found.append(materialize(members, "line-buckets"))
    return found


def blocks(members: DataFrame, similarity: float, most: int = BLOCK_LINES) -> DataFrame:
    """``a, b``: in each bucket of ``members (key, id, label, n, unlike)``, with their bitmaps, every unlike line with
    every other of another label, if the bitmaps allow that they are alike.

    A bucket's unlike lines and its lines are dealt to parts of about ``most`` lines, and two parts meet in a block
    of their own.
    """
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = members.where("unlike").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("p"), F.ceil(F.max("n") / most).cast("int").alias("q"))
    rows = members.join(parts, "key")
    one = rows.where("unlike").select("key", "id", "label", *map_columns("x"), part("p").alias("i"), every("q").alias("j"))
    two = rows.select("key", F.col("id").alias("other"), F.col("label").alias("label2"), "unlike", *map_columns("y"), every("p").alias("i"), part("q").alias("j"))
    # two unlike lines meet twice
    both = one.join(two, ["key", "i", "j"]).where("label <> label2 and (id < other or not unlike)").where(may_be_alike("x", "y", similarity))
    return both.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def similar_lines(signed: DataFrame, kinds: DataFrame, k: int, similarity: float, small: int) -> DataFrame:
    """``node, root`` of every line in a class of several, from verified pairs among what shares a band.

    In each bucket every line is compared with the hub, the line that shares most buckets.  Lines that aren't in
    its class then are compared with all lines of other classes in a bucket of up to ``small`` lines.  A larger
    bucket that has such lines is put into buckets again as a whole, by bands of more and fresh minima; what is
    still crowded after the last level is compared in blocks, each such line with all others.  A line's label is
    its class so far; lines with one label needn't be compared.  So no bucket is cut off, and copies of one line
    cost one comparison each.
    """
    found = buckets(signed, BANDS, PARTS)
    discard(signed)
    stars = done = pending = None
    for level in range(len(FINER) + 1):
        members = reduce(DataFrame.unionByName, found)
        ids = materialize(members.groupBy("id").agg(F.sum("n").alias("degree")), "line-ids")
        weight = F.least("degree", F.lit(1 << 42)) * (1 << 20) + F.xxhash64("id").bitwiseAND((1 << 20) - 1)
        hubs = members.join(ids, "id").groupBy("key").agg(F.max_by("id", weight).alias("hub"), F.max_by("label", weight).alias("hub_label"))
        texts = of_ids(kinds.select("id", "line"), ids.select("id"), "line-texts")
        spokes = materialize(members.join(hubs, "key"), "line-spokes")
        for old in found:
            discard(old)
        tried = spokes.where("label <> hub_label").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        tried = materialize(tried if done is None else tried.join(done, ["a", "b"], "left_anti"), "line-pairs")
        done = tried if done is None else done.unionByName(tried)
        stars = joined(stars, pending, alike_by_text(tried, texts, k, similarity))
        label = lambda of, name: stars.select(F.col("node").alias(of), F.col("root").alias(name))
        met = spokes.join(label("id", "root"), "id", "left").join(label("hub", "hub_root"), "hub", "left")
        met = met.select("key", "id", "n", F.coalesce("root", "id").alias("label"), F.coalesce("hub_root", "hub").alias("hub_label"))
        met = materialize(met.withColumn("unlike", F.col("label") != F.col("hub_label")), "line-met")
        last = level == len(FINER)
        # the one pair of a bucket of two holds its hub, so it has been compared
        few = (F.col("n") > 2) & (F.lit(True) if last else F.col("n") <= small)
        some = materialize(met.where(few).join(met.where(few & F.col("unlike")).select("key").distinct(), "key", "left_semi"), "line-some")
        near = of_ids(texts, some.select("id").distinct(), "line-near")
        maps = materialize(bitmaps(near, k), "line-maps")
        pairs = materialize(blocks(some.join(maps, "id"), similarity).join(done, ["a", "b"], "left_anti"), "line-pairs")
        done = done.unionByName(pairs)
        pending = alike(pairs, near, k, similarity)
        crowded = met.where((F.col("n") > small) & F.col("unlike")).select("key").distinct()
        for old in (ids, spokes, texts, some, near, maps):
            discard(old)
        if last or crowded.isEmpty():
            return joined(stars, pending)
        again = met.where(F.col("n") > small).join(crowded, "key", "left_semi").select("id").distinct()
        again = again.join(stars.select(F.col("node").alias("id"), "root"), "id", "left").select("id", F.coalesce("root", "id").alias("label"))
        again = materialize(again, "line-again")
        discard(met)
        start, count = MINIMA + sum(n for n, _, _ in FINER[:level]), FINER[level][0]
        fresh = minima(of_ids(kinds.select("id", "line"), again.select("id"), "line-texts"), k, start, count)
        found = buckets(again.join(materialize(fresh, "line-minima"), "id"), finer_bands(level))


def joined(stars: DataFrame | None, *more: DataFrame | None) -> DataFrame:
    """``node, root`` of the classes after ``more`` edges."""
    edges = [e for e in more if e is not None] + ([stars.select(F.col("node").alias("a"), F.col("root").alias("b"))] if stars is not None else [])
    return connected_components(reduce(DataFrame.unionByName, edges), "a", "b")


def line_classes(docs: DataFrame, k: int = 8, similarity: float = 0.8, small: int = 128) -> DataFrame:
    """``h1, h2, first_doc, first_line``: for each distinct line (by two 64-bit hashes) the place of the first line of
    its class; a null doc_id stands last, as the largest number.  Only lines that stand twice or more or have a
    class are returned."""
    lines = line_table(docs).withColumn("place", _place())
    kinds = lines.groupBy("line").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    kinds = materialize(kinds.withColumn("id", F.monotonically_increasing_id()), "line-kinds")
    signed = materialize(minima(kinds, k), "line-minima")
    roots = similar_lines(signed, kinds, k, similarity, small)
    roots = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "line-roots")
    placed = roots.join(kinds.select(F.col("id").alias("node"), "place"), "node")
    first = materialize(placed.groupBy("root").agg(F.min("place").alias("first")), "line-firsts")
    classes = roots.join(first, "root").select("node", "first")
    hashed = kinds.select("id", "place", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))
    out = hashed.join(classes, F.col("id") == F.col("node"), "left").where("n > 1 or node is not null")
    place, step = F.coalesce("first", "place"), F.lit(1 << 31).cast("decimal(10,0)")
    out = out.select("h1", "h2", F.floor(place / step).cast("long").alias("first_doc"), (place % step).cast("int").alias("first_line"))
    out = materialize(out, "line-classes")
    for old in (kinds, roots, first):
        discard(old)
    return out


def removed_lines(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, text_hash, removed`` of the documents that lose a line, one row for all rows equal in both."""
    classes = line_classes(docs, **how)
    here = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC))
    lines = line_table(docs).select("doc_id", "text_hash", "line_no", here.alias("here"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))
    later = (F.col("first_doc") < F.col("here")) | ((F.col("first_doc") == F.col("here")) & (F.col("first_line") < F.col("line_no")))
    of = F.struct("line_no", F.nullif("first_doc", F.lit(_NO_DOC)).alias("of_doc"), F.col("first_line").alias("of_line"))
    gone = lines.join(classes, ["h1", "h2"]).where(later)
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(of)).alias("removed"))


def repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_hash, n_lines, removed``.

    ``n_lines`` counts lines with a word.  ``removed`` is an array of ``(line_no, of_doc, of_line)`` in line order:
    the lines, counted from 0 over all lines of the text, that go because a near-equal one stays, and where that
    stands.  One line of each class stays: the first by doc_id (null last) and line.  Lines are compared without
    blanks at their ends and without regard to case, by Jaccard similarity of their sets of ``k``-character
    shingles; shorter lines have equals alone, case included.  Lines without a word always stay and aren't counted.

    Null and empty texts have no lines and lose none.  Rows equal in doc_id and text are one document and get a
    row each.  Other columns are ignored.
    """
    require(docs, "doc_id", "text")
    docs = docs.select("doc_id", "text")
    found = removed_lines(docs, **how).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "removed")
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _line_count("text").alias("n_lines"))
    each = each.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")), "left")
    none = F.array().cast(found.schema["removed"].dataType)
    return each.select("doc_id", "text_hash", "n_lines", F.coalesce("removed", none).alias("removed"))


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the lines of :func:`repeated_lines`, all columns as they were but for ``text`` (and
    ``n_chars``, where there is one, which counts the characters again).  A row whose every line with a word
    goes is left out; rows that had none stay as they are.  Other columns may have any names."""
    require(docs, "doc_id", "text")
    of, of_hash, gone = unused(docs, "of", "of_hash", "gone")
    found = removed_lines(docs.select("doc_id", "text"), **how)
    found = found.select(F.col("doc_id").alias(of), F.col("text_hash").alias(of_hash), F.col("removed.line_no").alias(gone))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(of_hash)), "left")
    out = out.where(F.col(gone).isNull() | (F.size(gone) < _line_count("text")))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(left)
    names = [F.char_length(text).cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*names)
