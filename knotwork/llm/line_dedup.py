"""Line de-duplication within one edit, by a deletion-neighbourhood join.

Two lines are alike if they are equal or one edit apart (a character put in, taken out
or changed). Lines one edit apart share a variant: the line itself or the line with
one character deleted. Variants are keyed by a hash and the place of the deletion:

* lines that agree in a variant and its place differ at that place only, so the whole
  group is alike and its earliest line is all that is needed;
* a line that equals another one's variant is one deletion away from it.

So a group never expands into pairs. Most lines have no neighbour; they are left out
before any variant is made: of two lines one edit apart, either the first half or the
second half (of the longer one's length) is equal. The lines left are cut into BLOCKS
blocks, and all but the block with the edit is equal, so a line gives only the variants
of blocks without which it agrees with another line; a block of a long line is cut
again until it has at most FINE characters, so that the work stays near proportional
to a line's length. Variants are joined on 128 bits. Matches are verified with the edit
distance of the texts. A line occurrence goes if an equal or alike line occurs
earlier, in the order (doc_id, line_no), kept or not.

Catalyst operators only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import durable, fresh

#: Edits within which lines are alike.
BOUND = 1
#: Blocks of a line, of which an edit is in one.
BLOCKS = 16
#: Characters of a block whose variants are made.
FINE = 64
#: Shares of all line occurrences; a line that has more than one of them is dealt to several tasks.
SHARES = 1_000


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, h1, h2: lines that are not blank; null ids and texts give none."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = rows.filter(F.trim("line") != "")
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def halves(line: Column) -> Column:
    """Hashes of the first and second halves, for a line that is the longer of a pair and for one that is a character shorter."""
    n = F.length(line)

    def pair(longer: Column) -> list[Column]:
        first = (longer / 2).cast("int")
        head, tail = F.substr(line, F.lit(1), first), F.substr(line, n - (longer - first) + 1, longer - first)
        # The shorter line lacks a character, so its tail starts one earlier than its own half.
        return [F.xxhash64(F.lit(0), longer, head), F.xxhash64(F.lit(1), longer, F.when(n - (longer - first) >= 0, tail))]

    return F.array(*pair(n), *pair(n + 1))


def rests(line: Column, shorter: Column, start: Column, end: Column) -> Column:
    """(start, end, hash of the rest) of the BLOCKS parts of the places from start to before end.

    shorter is 0 where the line counts as the longer of a pair or as one of equal
    lengths, and 1 where it counts as a character shorter; places are those of the longer.
    """
    longer = F.length(line) + shorter

    def rest(b: Column) -> Column:
        lo, hi = ((start + F.floor(x * (end - start) / BLOCKS)).cast("int") for x in (b, b + 1))
        tail = longer - hi
        hashed = F.xxhash64(longer, lo, hi, F.substr(line, F.lit(1), lo), F.substr(line, F.length(line) - tail + 1, tail))
        return F.when(hi > lo, F.struct(lo.alias("start"), hi.alias("end"), hashed.alias("rest")))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), rest), lambda x: x.isNotNull())


def variants(line: Column, start: Column, end: Column) -> Column:
    """(place, hash, second hash) of the line with the character at each place from start to before end deleted."""
    def without(i: Column) -> Column:
        rest = F.concat(F.substr(line, F.lit(1), i), F.substr(line, i + 2, F.length(line)))
        return F.struct(i.cast("int").alias("place"), F.xxhash64(rest).alias("v"), F.xxhash64(F.lit(1), rest).alias("w"))

    return F.transform(F.sequence(start, end - 1), without)


def edited_blocks(texts: DataFrame) -> DataFrame:
    """first, shorter, start, end: blocks of at most FINE places without which a line agrees with another one.

    texts: first, line. Every round cuts the blocks that are still too large, of which
    only very long lines have any.
    """
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("shorter")
    todo = texts.select("first", "line", sides).select("*", F.lit(0).alias("lo"), (F.length("line") + F.col("shorter")).alias("hi"))
    out = None
    while True:
        cut = todo.select("first", "shorter", F.explode(rests(F.col("line"), F.col("shorter"), F.col("lo"), F.col("hi"))).alias("r")).select("first", "shorter", "r.*")
        cut = durable(cut)
        met = cut.groupBy("rest").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter(F.col("a") != F.col("b")).select("rest")
        kept = durable(cut.join(met, "rest", "left_semi").select("first", "shorter", "start", "end"))
        fine = kept.filter(F.col("end") - F.col("start") <= FINE)
        out = fine if out is None else out.unionByName(fine)
        wide = kept.filter(F.col("end") - F.col("start") > FINE)
        if wide.isEmpty():
            return out
        todo = texts.select("first", "line").join(wide, "first").select("first", "line", "shorter", F.col("start").alias("lo"), F.col("end").alias("hi"))


def near_lines(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """h1, h2, near_doc_id, near_line_no: the earliest line one edit away and earlier than a line's own first.

    distinct: h1, h2, first (struct doc_id, line_no), one row per distinct line.
    """
    anchors = lines.select("h1", F.explode(halves(F.col("line"))).alias("a"))
    shared = anchors.groupBy("a").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter(F.col("lo") != F.col("hi")).select("a")
    flagged = anchors.join(shared, "a", "left_semi").select("h1").distinct()
    flagged = distinct.join(flagged, "h1", "left_semi").select("h1", "h2", "first", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"))
    texts = durable(lines.select("doc_id", "line_no", "line").join(flagged, ["doc_id", "line_no"]).select("h1", "h2", "first", "line"))

    blocks = edited_blocks(texts.select("first", "line")).filter(F.col("shorter") == 0).select("first", "start", "end")
    places = F.explode(variants(F.col("line"), F.col("start"), F.col("end"))).alias("e")
    emitted = durable(texts.select("first", "line").join(blocks, "first").select("first", places).select("first", "e.place", "e.v", "e.w"))
    earliest = emitted.groupBy("v", "w", "place").agg(F.min("first").alias("best"), F.max("first").alias("last"))
    earliest = earliest.filter(F.col("best") != F.col("last")).select("v", "w", "place", "best")
    changed = emitted.join(earliest, ["v", "w", "place"]).filter(F.col("best") < F.col("first")).select("first", "best")
    whole = texts.select(F.col("h1").alias("v"), F.col("h2").alias("w"), F.col("first").alias("whole"))
    shorter = emitted.join(whole, ["v", "w"]).filter(F.col("whole") != F.col("first"))
    # Either line of a pair may be the earlier one.
    deleted = shorter.select(F.greatest("first", "whole").alias("first"), F.least("first", "whole").alias("best"))
    pairs = changed.unionByName(deleted).distinct()
    text = texts.select(F.col("first").alias("__f"), F.col("line").alias("__line"))
    a = pairs.join(text, F.col("first") == F.col("__f")).select("first", "best", F.col("__line").alias("line"))
    b = a.join(text, F.col("best") == F.col("__f"))
    alike = b.filter(F.levenshtein("line", "__line", BOUND).between(0, BOUND))
    return alike.groupBy("first").agg(F.min("best").alias("near"))


def parts_of(found: DataFrame) -> Column:
    """How many tasks the n occurrences of a line are dealt to, so that a part has at most one of SHARES of all."""
    total = found.agg(F.sum("n")).first()[0] or 1
    return F.least(F.ceil(F.col("n") * SHARES / total), F.col("n")).cast("int")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, first_doc_id, first_line_no, edits: the line occurrences that go, with the earliest line alike.

    edits is 0 if that line is equal and 1 otherwise. Lines are split at "\\n"; blank
    ones are never repeated. Rows without doc_id or text have no lines. Rows that repeat
    a doc_id and text are one document; of rows that repeat a doc_id with different
    texts, lines with one number are ordered by that number only, and equal ones stay.
    An empty table gives an empty result; other columns are ignored. A line of any
    length is compared whole.
    """
    lines = lines_of(docs)
    found = durable(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.max(F.struct("doc_id", "line_no")).alias("last"), F.count(F.lit(1)).alias("n")))
    near = near_lines(found, lines)
    parts = parts_of(found)
    best = found.join(near, "first", "left").filter(F.col("near").isNotNull() | (F.col("first") != F.col("last")))
    best = durable(best.select("h1", "h2", "n", F.least("first", "near").alias("keep"), F.col("near").isNotNull().alias("is_near")))
    best = best.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    # Fewer than SHARES lines have more than one part, so their number of parts is broadcast.
    often = found.filter(parts > 1).select("h1", "h2", parts.alias("parts"))
    out = lines.select("h1", "h2", "doc_id", "line_no").join(F.broadcast(often), ["h1", "h2"], "left")
    part = F.pmod(F.xxhash64("doc_id", "line_no"), F.coalesce("parts", F.lit(1))).cast("int")
    out = out.withColumn("part", part).drop("parts").join(best, ["h1", "h2", "part"])
    out = out.filter(F.struct("doc_id", "line_no") > F.col("keep")).distinct()
    return out.select(
        "doc_id", "line_no", F.col("keep.doc_id").alias("first_doc_id"), F.col("keep.line_no").alias("first_line_no"),
        F.col("is_near").cast("int").alias("edits"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of the text; other columns as they were, edge cases as in repeated_lines."""
    name = fresh(docs.columns, "gone")
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.collect_set("line_no").alias(name))
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains(name, i))
    joined = docs.join(gone, "doc_id", "left")
    text = F.when(F.col(name).isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select([F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH l AS (
  SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no
    FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
  WHERE trim(line, ' ') <> ''),
d AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS first FROM l GROUP BY line),
v AS (
  SELECT line, first, i, substr(line, 1, i - 1) || substr(line, i + 1) AS v FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM d)
  UNION ALL SELECT line, first, 0, line FROM d),
h AS (SELECT line, first, i, hash(v) AS v FROM v),
m AS (SELECT v FROM h GROUP BY v HAVING min(line) <> max(line)),
s AS (SELECT h.* FROM h JOIN m USING (v)),
p AS (SELECT a.line, b.first AS best FROM s a JOIN s b ON a.v = b.v AND (a.i = b.i OR a.i = 0 OR b.i = 0) AND b.first < a.first),
n AS (SELECT line, min(best) AS near FROM p GROUP BY line),
k AS (SELECT d.line, CASE WHEN n.near IS NULL THEN d.first ELSE n.near END AS keep, n.near IS NOT NULL AS is_near FROM d LEFT JOIN n ON d.line = n.line)
SELECT DISTINCT l.doc_id, l.line_no, k.keep.d AS first_doc_id, k.keep.n AS first_line_no, CAST(k.is_near AS INTEGER) AS edits
FROM l JOIN k ON l.line = k.line WHERE {'d': l.doc_id, 'n': l.line_no} > k.keep
"""
