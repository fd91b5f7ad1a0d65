"""Sections and mapping segments straight from chunk rows; no document is put together in one row.

A section is named by the place where it starts: the characters of all
sections before it, each with its joining blank line. Greedy packing then is a
chain of jumps: the segment that starts at place s ends before the section
that covers s + target + 2. All jumps are found at once, and the starts that
the chain from place 0 really meets by pointer doubling, so a document of n
segments takes log2(n) rounds over (document, place) numbers. Texts move once,
at the end, into groups no larger than a segment.

Chunks need (key, position, locator, text): positions count 1, 2, ... inside a
document, and texts have no white space at either end, as chunk_documents
gives them. A chunk whose locator makes no section line (empty, over 180
characters, with a bracket or a line break) goes on with the section before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.values import strip
from cargolens.operators.chunking import MAX_OVERLAP, MAX_SEGMENTS, SECTION_LINE, SECTION_START, SEGMENT_CHARS, carried
from cargolens.operators.ordinals import numbered, running_total_before
from cargolens.session import written

JOINT = "\n\n"
# Characters of one piece when sections are numbered.
PIECE_CHARS = 1 << 24


def block_text(locator: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(locator, F.lit("")), F.lit("]\n"), text)


def _parts(block: Column) -> Column:
    """A chunk's block cut before every section line."""
    return F.filter(F.transform(F.split(block, SECTION_START), strip), lambda p: p != "")


def blocks(chunks: DataFrame, key: str) -> DataFrame:
    """(key, position, block, parts): what a chunk adds to the text of its document, whole and cut into sections.

    The blank line behind a block makes a section line of its last line too,
    if that looks like one; the last block of a document has none behind it.
    """
    ends = chunks.groupBy(key).agg(F.max("position").alias("position")).withColumn("_ends", F.lit(True))
    rows = chunks.select(key, "position", block_text(F.col("locator"), F.col("text")).alias("block")).join(ends, [key, "position"], "left")
    behind = F.when(F.col("_ends").isNull(), JOINT).otherwise("")
    return rows.withColumn("parts", _parts(F.concat("block", behind))).drop("_ends")


def placed_parts(pieces: DataFrame, key: str) -> DataFrame:
    """(key, position, part_no, at, start, chars): every part of blocks(), its place, and the start of its section; written."""
    width = F.transform("parts", lambda p: F.length(p).cast("long") + 2)
    rows = pieces.select(
        key,
        "position",
        width.alias("_widths"),
        F.regexp_like("block", F.lit(f"^{SECTION_LINE}")).alias("_opens"),
    )
    rows = rows.withColumn("_width", F.aggregate("_widths", F.lit(0).cast("long"), lambda a, w: a + w))
    rows = running_total_before(rows, [key], "position", "_width", "_from")
    # the last section a block opens starts behind all parts but the last, or at the block itself
    last = F.col("_from") + F.col("_width") - F.element_at("_widths", -1)
    opened = F.when(F.col("_opens") | (F.size("_widths") > 1) | (F.col("_from") == 0), last)
    rows = carried(rows.withColumn("_last", opened), [key], "position", "_last", "_before", inclusive=False)
    own = F.transform(
        "_widths",
        lambda w, i: F.struct(
            w.alias("width"), F.aggregate(F.slice("_widths", 1, i), F.lit(0).cast("long"), lambda a, x: a + x).alias("ahead")
        ),
    )
    parts = rows.select(key, "position", "_from", "_opens", "_before", F.posexplode(own).alias("part_no", "_own"))
    at = F.col("_from") + F.col("_own.ahead")
    runs_on = (F.col("part_no") == 0) & ~F.col("_opens") & (F.col("_from") > 0)
    start = F.when(runs_on, F.col("_before")).otherwise(at)
    return written(parts.select(key, "position", "part_no", at.alias("at"), start.alias("start"), (F.col("_own.width") - 2).alias("chars")), "parts")


def section_places(parts: DataFrame, key: str) -> DataFrame:
    """(key, start, end): the sections, each ending where the next one starts."""
    return parts.groupBy(key, "start").agg(F.sum(F.col("chars") + 2).alias("_width")).select(
        key, "start", (F.col("start") + F.col("_width")).alias("end")
    )


def next_starts(sections: DataFrame, key: str, target: int) -> DataFrame:
    """(key, start, next): where the next segment starts if one starts here; no row where none follows.

    Places are cut into buckets as wide as a full segment, and a section stands
    in every bucket it covers. So what covers start + width is the last section
    at or before it in one bucket, which holds few rows however long the
    document is.
    """
    wide = F.lit(target + 2).cast("long")
    bucket = lambda place: F.floor(place / wide)
    covers = sections.select(
        key, "start", "end", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))).alias("_bucket")
    ).select(key, "_bucket", F.greatest("start", F.col("_bucket") * wide).alias("_at"), F.lit(0).alias("_asks"), "start", "end")
    asks = sections.select(
        key, (bucket(F.col("start")) + 1).alias("_bucket"), (F.col("start") + wide).alias("_at"), F.lit(1).alias("_asks"), "start", "end"
    )
    order = Window.partitionBy(key, "_bucket").orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.last(F.when(F.col("_asks") == 0, F.struct("start", "end")), ignorenulls=True).over(order)
    rows = covers.unionByName(asks).withColumn("_found", found).filter("_asks = 1")
    # a section longer than the target stays whole and ends its segment itself; nothing follows the last one
    covered = F.col("_found.end") > F.col("_at")
    following = F.when(F.col("_found.start") > F.col("start"), F.col("_found.start")).otherwise(F.col("end"))
    real = sections.select(key, F.col("start").alias("next"))
    return rows.filter(covered).select(key, "start", following.alias("next")).join(real, [key, "next"], "left_semi")


def chain(jumps: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """(key, start, segment_no): the places a chain from place 0 of each head meets, counted from 1; written each round.

    jumps that lead nowhere further drop out, so later rounds are smaller. A
    round knows twice as much of every chain as the one before.
    """
    met = heads.select(key, F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("segment_no"))
    reach = 1
    jumps = written(jumps, "jumps")
    while True:
        further = written(
            met.join(jumps, [key, "start"]).select(key, F.col("next").alias("start"), (F.col("segment_no") + reach).alias("segment_no")),
            "chain",
        )
        if further.isEmpty():
            return met
        met = met.unionByName(further)
        second = jumps.select(key, F.col("start").alias("next"), F.col("next").alias("_next"))
        jumps = written(jumps.join(second, [key, "next"]).select(key, "start", F.col("_next").alias("next")), "jumps")
        reach *= 2


def _joined(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Texts of a segment in order; a group holds one segment."""
    return rows.groupBy(key, "segment_no").agg(F.expr(f"listagg({text}, '') WITHIN GROUP (ORDER BY {order})").alias("text"))


def section_rows(chunks: DataFrame, key: str) -> DataFrame:
    """(key, section_no, text): sections of the documents, counted from 1."""
    pieces = blocks(chunks, key)
    parts = placed_parts(pieces, key)
    named = numbered(section_places(parts, key), [key], {"_piece": F.floor(F.col("start") / PIECE_CHARS)}, ["start"], "section_no")
    named = named.select(key, "start", "section_no")
    texts = pieces.select(key, "position", F.posexplode("parts").alias("part_no", "_part"))
    rows = texts.join(parts.join(named, [key, "start"]), [key, "position", "part_no"])
    joint = F.when(F.col("at") > F.col("start"), JOINT).otherwise("")
    rows = rows.select(key, F.col("section_no").alias("segment_no"), "at", F.concat(joint, "_part").alias("_text"))
    return _joined(rows, key, "_text", "at").select(key, F.col("segment_no").alias("section_no"), "text")


def chunk_segments(
    chunks: DataFrame, key: str, target: int = SEGMENT_CHARS, limit: int | None = MAX_SEGMENTS
) -> tuple[DataFrame, DataFrame]:
    """(segments, rejects) as chunking.segments gives them for the assembled texts: (key, segment_no, text) and documents that need too many.

    A text within the target is one segment as it is. With two sections or
    more, they are joined greedily up to the target; a longer one stays whole.
    With one section, windows of the target's size overlap. Documents without
    chunks have no segments.
    """
    overlap = min(MAX_OVERLAP, max(0, target // 12))
    step = max(1, target - overlap)
    pieces = blocks(chunks, key)
    parts = placed_parts(pieces, key)
    sections = section_places(parts, key)

    # whole length of a document, with the blank lines between blocks
    sizes = pieces.groupBy(key).agg((F.sum(F.length("block").cast("long") + 2) - 2).alias("_chars"))
    kinds = sections.groupBy(key).agg(F.count("*").alias("_sections")).join(sizes, key)
    kind = F.when(F.col("_chars") <= target, "whole").when(F.col("_sections") > 1, "packed").otherwise("sliding")
    kinds = written(kinds.select(key, "_chars", kind.alias("_kind")), "kinds")
    of = lambda name: kinds.filter(F.col("_kind") == name)

    packed = of("packed").select(key)
    starts = written(chain(next_starts(sections.join(packed, key, "left_semi"), key, target), packed, key), "starts")
    slides = F.floor((F.col("_chars") - 1) / step) + 1
    counts = starts.groupBy(key).agg(F.max("segment_no").alias("segments")).unionByName(of("sliding").select(key, slides.alias("segments")))
    counts = counts.select(key, F.col("segments").cast("int").alias("segments"))
    limit = 2**31 - 1 if limit is None else limit
    rejects = counts.filter(F.col("segments") > limit).withColumn("reason", F.lit(f"more than {limit} segments"))
    fine = kinds.join(rejects, key, "left_anti")
    wanted = lambda name: fine.filter(F.col("_kind") == name).select(key)

    # a text within the target, as it is
    joint = F.when(F.col("position") > 1, JOINT).otherwise("")
    whole = pieces.join(wanted("whole"), key, "left_semi")
    whole = whole.select(key, F.lit(1).cast("long").alias("segment_no"), "position", F.concat(joint, "block").alias("_text"))
    out = _joined(whole, key, "_text", "position")

    # sections up to the target: every section belongs to the last start at or before it
    ordered = numbered(sections.join(wanted("packed"), key, "left_semi"), [key], {"_piece": F.floor(F.col("start") / PIECE_CHARS)}, ["start"], "_n")
    ordered = ordered.join(starts.withColumnRenamed("segment_no", "_no").withColumn("_starts", F.lit(True)), [key, "start"], "left")
    owned = carried(ordered, [key], "_n", "_no", "segment_no").select(key, "start", "segment_no", F.coalesce("_starts", F.lit(False)).alias("_starts"))
    texts = pieces.select(key, "position", F.posexplode("parts").alias("part_no", "_part"))
    rows = texts.join(parts.join(owned, [key, "start"]), [key, "position", "part_no"])
    first = F.col("_starts") & (F.col("at") == F.col("start"))
    rows = rows.select(key, "segment_no", "at", F.concat(F.when(first, "").otherwise(JOINT), "_part").alias("_text"))
    out = out.unionByName(_joined(rows, key, "_text", "at"))

    # overlapping windows: each block gives its share to every window it reaches
    long = pieces.join(wanted("sliding"), key, "left_semi").select(key, "position", F.concat(joint, "block").alias("_text"))
    long = running_total_before(long.withColumn("_size", F.length("_text").cast("long")), [key], "position", "_size", "_from")
    least = F.greatest(F.lit(0).cast("long"), F.floor((F.col("_from") - target) / step) + 1)
    shares = long.withColumn("_window", F.explode(F.sequence(least, F.floor((F.col("_from") + F.col("_size") - 1) / step))))
    begin = F.col("_window") * step - F.col("_from")
    cut = F.substring("_text", F.greatest(begin, F.lit(0)).cast("int") + 1, (begin + target - F.greatest(begin, F.lit(0))).cast("int"))
    shares = shares.select(key, (F.col("_window") + 1).alias("segment_no"), "position", cut.alias("_text"))
    out = out.unionByName(_joined(shares, key, "_text", "position"))
    return out.select(key, F.col("segment_no").cast("int").alias("segment_no"), "text"), rejects
