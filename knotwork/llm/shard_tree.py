"""Sharding by a hierarchical weighted hash tree.

A document descends from the root: at every level each child draws
-ln(u) / weight, u uniform from a hash of (document, child), and the smallest draw
wins, so a child is taken with probability weight / sum of weights. A weight that
grows moves documents only into the subtree below it, one that shrinks only out of
it. A shard that is added comes as a new region of one rack and one shard, so that
documents move into the new shard or stay where they are.

Everything is Catalyst expressions; slots come from two narrow passes and no task
holds a whole shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import durable, fresh

#: Rows of the table that fall into one block of the hash range, about.
BLOCK_ROWS = 20_000


@dataclass(frozen=True)
class Shard:
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Node:
    """A region or a rack; its weight is the sum over its shards."""

    name: str
    children: tuple

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children)


def default_tree(shards: int = 16, regions: int = 2, racks: int = 2) -> Node:
    """A tree of equal weights: shards dealt over regions and racks in order."""
    per = max(1, -(-shards // (regions * racks)))
    cut = [tuple(Shard(s) for s in range(i, min(i + per, shards))) for i in range(0, shards, per)]
    out = []
    for r in range(regions):
        own = [Node(f"region{r}/rack{k}", c) for k, c in enumerate(cut[r * racks : (r + 1) * racks])]
        if own:
            out.append(Node(f"region{r}", tuple(own)))
    return Node("root", tuple(out))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, as a region of its own."""
    name = f"region-of-{shard}"
    new = Node(name, (Node(f"{name}/rack0", (Shard(shard, weight),)),))
    return Node(tree.name, (*tree.children, new))


def _label(child) -> str:
    return f"shard{child.shard}" if isinstance(child, Shard) else child.name


def _draw(key: Column, child, seed: str) -> Column:
    """-ln(u) / weight; 48 bits of an MD5 digest make u, so other engines can check it."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{seed}|{_label(child)}"))), 1, 12), 16, 10)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(u) / F.lit(float(child.weight))


def place(key: Column, node: Node, seed: str = "knotwork") -> Column:
    """The shard that the document with this (string) key descends to."""
    kids = [c for c in node.children if c.weight > 0]
    if not kids:
        raise ValueError("a tree needs a shard of positive weight")
    below = [F.lit(c.shard) if isinstance(c, Shard) else place(key, c, seed) for c in kids]
    if len(kids) == 1:
        return below[0]
    drawn = [F.struct(_draw(key, c, seed).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(kids)]
    won = F.least(*drawn)["i"]
    out = below[-1]
    for i in range(len(kids) - 2, -1, -1):
        out = F.when(won == i, below[i]).otherwise(out)
    return out


_COLUMNS = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_documents(docs: DataFrame, tree: Node | None = None, seed: str = "knotwork", extra: tuple = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard and `extra` columns.

    size is the text's UTF-8 bytes plus 1 (a null text has none, and crc32 0 like an
    empty one). Rows without a doc_id share the key "null". slot numbers a shard's
    rows from 0 in the order of a hash of (doc_id, size, crc32), then doc_id; repeated
    rows get successive slots in any order, and where they are more than a block they
    come last in their block, dealt to several tasks. A text is only measured, so its
    length is no matter. An empty table gives an empty result. Other columns of docs
    are ignored unless named in `extra`; one that is named as a column of the result
    gets an underscore.
    """
    tree = tree or default_tree()
    count = 1 + max(_shards(tree))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        place(key, tree, seed).cast("int").alias("shard"),
        place(key, grown(tree, count), seed).cast("int").alias("grown_shard"),
        *([F.struct(*[F.col(f"`{c}`") for c in extra]).alias("extra")] if extra else []),
    )
    names = list(_COLUMNS)
    for c in extra:
        names.append(fresh(names, c))
    rest = [F.col("extra")[c].alias(n) for c, n in zip(extra, names[len(_COLUMNS) :], strict=True)]
    out = with_slots(rows.withColumn("at", F.xxhash64("doc_id", "size", "text_crc32")))
    return out.withColumn("law", F.lit("key")).select(*_COLUMNS, *rest)


def _shards(node) -> list[int]:
    return [node.shard] if isinstance(node, Shard) else [s for c in node.children for s in _shards(c)]


def with_slots(rows: DataFrame) -> DataFrame:
    """rows (shard, at, doc_id, ...) with slot: gapless numbers within each shard in the order (at, doc_id).

    The leading bits of the hash cut it into blocks, so many that a block has about
    BLOCK_ROWS rows over all shards. Blocks are ranges of the order, so the numbers do
    not depend on how many there are. A first pass counts rows by (shard, block), the
    second adds what lies before a row's block. Only repeated rows can make a block
    large; those are taken out of it and dealt to lanes, which are numbered like blocks.
    """
    bits = max(0, -(-rows.count() // BLOCK_ROWS) - 1).bit_length()
    rows = rows.withColumn("block", F.shiftright("at", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = durable(rows.groupBy("shard", "block").count())
    large = counts.filter(F.col("count") > 2 * BLOCK_ROWS).select("shard", "block")
    if large.isEmpty():
        rows = rows.withColumns({"often": F.lit(None).cast("long"), "lane": F.lit(0)})
        counts = counts.withColumns({"often": F.lit(None).cast("long"), "lane": F.lit(0)})
    else:
        often = rows.join(large, ["shard", "block"], "left_semi").groupBy("shard", "at").count().filter(F.col("count") > BLOCK_ROWS)
        often = durable(often.select("shard", "at", F.ceil(F.col("count") / BLOCK_ROWS).alias("lanes")))
        rows = rows.join(often, ["shard", "at"], "left").withColumn("often", F.when(F.col("lanes").isNotNull(), F.col("at")))
        # Written, as the lanes must be the same for the count and the numbers.
        rows = durable(rows.withColumn("lane", F.coalesce(F.pmod(F.monotonically_increasing_id(), "lanes"), F.lit(0)).cast("int")).drop("lanes"))
        counts = rows.groupBy("shard", "block", "often", "lane").count()
    before = Window.partitionBy("shard").orderBy("block", F.col("often").asc_nulls_first(), "lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s"), F.col("block").alias("b"), F.col("often").alias("o"), F.col("lane").alias("l"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "block", "often", "lane").orderBy("at", "doc_id")
    numbered = rows.withColumn("n", F.row_number().over(inside) - 1)
    same = (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b")) & F.col("often").eqNullSafe(F.col("o")) & (F.col("lane") == F.col("l"))
    joined = numbered.join(starts, same)
    return joined.withColumn("slot", (F.col("before") + F.col("n")).cast("long")).drop("s", "b", "o", "l", "before", "n", "block", "often", "lane")


def _xxhash64_sql(columns: tuple[str, ...], source: str) -> tuple[str, str]:
    """Common table expressions that hash whole-number columns as xxhash64 does, and the name of the last one, which has it as h.

    Unsigned arithmetic modulo 2**64 on numbers of 128 bits; a null leaves the hash as it is.
    """
    p1, p2, p3, p4, p5 = (f"CAST({x} AS UHUGEINT)" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    low = lambda e: f"(({e}) % 18446744073709551616)"
    turned = lambda e, k: f"({low(f'({e}) * {1 << k}')} + ({e}) // {1 << (64 - k)})"
    shifted = lambda e, k: f"xor({e}, {e} // {1 << k})"
    parts, last = [f"h0 AS (SELECT *, CAST(42 AS UHUGEINT) AS h FROM {source})"], "h0"
    for i, c in enumerate(columns):
        value = f"CAST(coalesce({c}, 0) + CASE WHEN {c} < 0 THEN 18446744073709551616 ELSE 0 END AS UHUGEINT)"
        steps = [
            low(f"{value} * {p2}"),
            low(f"{turned('g', 31)} * {p1}"),
            f"xor({low(f'h + {p5} + 8')}, g)",
            low(f"{turned('g', 27)} * {p1} + {p4}"),
            low(f"{shifted('g', 33)} * {p2}"),
            low(f"{shifted('g', 29)} * {p3}"),
            shifted("g", 32),
        ]
        for k, step in enumerate(steps):
            kept = "*" if k == 0 else "* EXCLUDE (g)"
            parts.append(f"h{i}_{k} AS (SELECT {kept}, {step} AS g FROM {last})")
            last = f"h{i}_{k}"
        parts.append(f"h{i + 1} AS (SELECT * EXCLUDE (g, h), CASE WHEN {c} IS NULL THEN h ELSE g END AS h FROM {last})")
        last = f"h{i + 1}"
    return ",\n".join(parts), last


_HASHED, _LAST = _xxhash64_sql(("doc_id", "size", "crc"), "d")

#: The tree of 16 shards as a table, draws and winners by level, CRC-32 bit by bit, and slots in the order of the rows' hashes.
ORACLE = f"""
WITH tree AS (
  SELECT 'root' AS parent, 'region' || i AS name, 8.0 AS weight FROM range(2) t(i) UNION ALL SELECT 'root', 'region-of-16', 1.0
  UNION ALL SELECT 'region' || (i // 2), 'region' || (i // 2) || '/rack' || (i % 2), 4.0 FROM range(4) t(i)
  UNION ALL SELECT 'region' || (i // 8) || '/rack' || (i // 4 % 2), 'shard' || i, 1.0 FROM range(16) t(i)),
keys AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
draws AS (SELECT key, parent, name, -ln((CAST('0x' || substr(md5(key || '|knotwork|' || name), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / weight AS drawn FROM keys, tree),
won AS (SELECT key, parent, arg_min(name, drawn) FILTER (WHERE name <> 'region-of-16') AS name, arg_min(name, drawn) AS grown FROM draws GROUP BY key, parent),
placed AS (
  SELECT a.key, CAST(substr(c.name, 6) AS INTEGER) AS shard, CASE WHEN a.grown = 'region-of-16' THEN 16 ELSE CAST(substr(c.name, 6) AS INTEGER) END AS grown_shard
  FROM won a JOIN won b ON a.key = b.key AND b.parent = a.name JOIN won c ON c.key = b.key AND c.parent = b.name WHERE a.parent = 'root'),
d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST(xor(4294967295, list_reduce(
    flatten(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: list_transform(range(8), lambda i: (CAST('0x' || x AS BIGINT) >> i) & 1))),
    lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384 ELSE 0 END), 4294967295)) AS BIGINT) AS crc FROM documents),
{_HASHED},
s AS (
  SELECT doc_id, size, crc, shard, grown_shard, CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE CAST(h AS HUGEINT) END AS pos
  FROM {_LAST} JOIN placed ON key = coalesce(CAST(doc_id AS VARCHAR), 'null'))
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos, doc_id NULLS FIRST) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM s
"""
