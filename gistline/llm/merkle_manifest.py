"""Merkle manifest of a table: a root for the data set, subroots for its groups, a proof for each row.

Every row is hashed into a leaf where it is read; no text is shuffled. The leaves of a group are
numbered in order and 256 consecutive ones make an aligned block, one row that keeps its level as a
single hex string. Fixed-width substrings of that string are hashed into the level above it, and
again into one node; the nodes of all blocks of a group are the leaves of the next round, so each round
leaves 1/256 of the rows, until a group has one node, its subroot. The subroots are the leaves of one last
tree. Siblings of a node are the substrings on both sides of it in its run, so a proof is cut out of the
level strings, and what the rows of a block share above it is found once for the block.

Every hash is the lowercase hex SHA-256 of a concatenation; digests go in as hex text. A leaf is the
hash of its values in order, each ``-`` if null, else its UTF-8 length, ``:`` and the value.

Edge cases: a null id sorts first, as does a null group, which is a group; rows with one id are ordered by
leaf; equal rows are leaves each; a lone leaf is its own subroot, a lone subroot the root, with no siblings
at that level; an empty table gives an empty result. Columns that are not named are not read. Ids keep
their type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistline.llm import common
from gistline.session import lookup

#: Nodes under one parent, levels in a block, and nodes in a block.
RUN, BLOCK = 16, 256
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(values: list[Column]) -> Column:
    """The hash of some values."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, values)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (g, ...) with ``pos``, their place in their group from 0, and ``n``, the size of the group.

    Rows are cut into even ranges by (g, order), so a group with most rows is spread over tasks, and stored with
    their place in the range. Only one row per range and group is summed up to give the places before it.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    cut = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    cut = common.stored(cut.withColumn("part", F.shiftright("at", 33)))
    ranges = cut.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    group = Window.partitionBy("g")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = common.stored(ranges.select(
        "g", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(group).alias("n")))
    placed = lookup(cut, ranges, ["g", "part"], "inner")
    return placed.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift", "part")


def _piece(text: str, start: Column, nodes: Column) -> Column:
    """``nodes`` digests of a level from node ``start`` on."""
    return F.substring(F.col(text), (start * HEX + 1).cast("int"), (nodes * HEX).cast("int"))


def blocks(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Nodes (g, n, pos, hash, ...) to a stored table of blocks (g, n, block, level, up, top, kept).

    ``level`` holds the digests of the block, ``up`` those of the parents of its runs, ``top`` its one node;
    ``kept`` are the columns ``keep`` of its nodes in order.
    """
    members = F.sort_array(F.collect_list(F.struct("pos", "hash", F.struct(F.lit(0).alias("_"), *keep).alias("kept"))))
    table = nodes.groupBy("g", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(members.alias("members"))
    table = table.select("g", "n", "block", F.array_join("members.hash", "").alias("level"), F.col("members.kept").alias("kept"))
    run = F.sequence(F.lit(0), F.floor((F.size("kept") - 1) / RUN).cast("int"))
    up = F.array_join(F.transform(run, lambda i: F.sha2(_piece("level", i * RUN, F.lit(RUN)), 256)), "")
    table = table.withColumn("up", F.when(F.col("n") > 1, up))
    top = F.when(F.col("n") <= 1, F.col("level")).when(F.col("n") <= RUN, F.col("up")).otherwise(F.sha2("up", 256))
    return common.stored(table.withColumn("top", top))


def _flanks(above: Column) -> Column:
    """Siblings of node ``i`` of a block as (left, right) from its level upwards, then those of ``above``."""
    i = F.col("i")
    run, parent = i - i % RUN, F.floor(i / RUN)

    def flank(text: str, start: Column, at: Column) -> Column:
        return F.struct(_piece(text, start, at - start).alias("left"),
                        _piece(text, at + 1, start + RUN - 1 - at).alias("right"))

    low = flank("level", run, i)
    high = flank("up", F.lit(0), parent)
    none = F.slice(F.array(low), 1, 0)
    own = F.when(F.col("n") <= 1, none).when(F.col("n") <= RUN, F.array(low)).otherwise(F.array(low, high))
    return F.concat(own, F.coalesce(above, none))


def trees(nodes: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, n, pos, hash, ...) to (g, hash, ..., path) with the siblings of each node, and to (g, root).

    ``path`` is an array of (left, right) from the leaf level to the root of the group.
    """
    tiers = [blocks(nodes, keep)]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        higher = tiers[-1].where(F.col("n") > BLOCK).select(
            "g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("pos"), F.col("top").alias("hash"))
        tiers.append(blocks(higher, []))
    roots = tiers[0].where(F.col("n") <= BLOCK)
    for tier in tiers[1:]:
        roots = roots.select("g", "top").unionByName(tier.where(F.col("n") <= BLOCK).select("g", "top"))
    above = None
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        if above is not None:
            tier = tier.join(above, ["g", "block"], "left")
        else:
            tier = tier.withColumn("above", F.lit(None).cast("array<struct<left:string,right:string>>"))
        each = tier.select("g", "n", "block", "level", "up", "above", F.posexplode("kept").alias("i", "kept"))
        each = each.withColumns({"path": _flanks(F.col("above")), "hash": _piece("level", F.col("i"), F.lit(1))})
        if k:
            above = each.select("g", (F.col("block") * BLOCK + F.col("i")).alias("block"), F.col("path").alias("above"))
    return each.select("g", "hash", "kept", "path"), roots.select("g", F.col("top").alias("root"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path in one hex string."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")


def manifest(rows: DataFrame, leaf_hash: Column, *, id_col: str = "doc_id", group_col: str = "source",
             keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: id, leaf, subroot, root, ``path`` (siblings up to the subroot), ``root_path`` (from there
    to the root) and the values ``keep``, which should be short."""
    group = F.col(group_col).cast("string")
    # Bytewise order with null first, and no null key.
    named = F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group))
    kept = {"id": F.col(id_col), **(keep or {})}
    leaves = rows.select(named.alias("g"), leaf_hash.alias("hash"), *[c.alias(f"k_{n}") for n, c in kept.items()])
    each, subroots = trees(numbered(leaves, ["k_id", "hash"]), [f"k_{n}" for n in kept])
    subroots = common.stored(subroots)
    over = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("hash")), ["name"])
    paths, roots = trees(over, ["name"])
    tops = common.stored(paths.join(roots, "g").select(
        F.col("kept.name").alias("g"), F.col("hash").alias("subroot"), "root", F.col("path").alias("root_path")))
    return lookup(each, tops, ["g"], "inner").select(
        F.col("kept.k_id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "path", "root_path",
        *[F.col(f"kept.k_{n}").alias(n) for n in keep or {}])


def query(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and the root recomputed from documents, of which one in five was tampered with."""
    docs = common.table(spark, sf_dir, "documents")
    bent = leaf([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS])
    tampered = F.when(common.crc_mod("doc_id", 5) == 0, bent)
    each = manifest(docs, leaf([F.col(c) for c in COLUMNS]), keep={"bent": tampered})
    path = F.concat("path", "root_path")
    return each.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(path), 256).alias("proof_sha256"),
        fold(F.coalesce("bent", "leaf"), path).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(prefix: str, depth: int) -> str:
    """SQL: levels above ``{prefix}0`` (g, pos, h), then ``{prefix}f0`` (doc, g, pos, acc, proof) folded through them."""
    out = ""
    for k in range(depth):
        out += f"""{prefix}c{k} as (select *, count(*) over (partition by g) as c from {prefix}{k}),
{prefix}{k + 1} as (select g, pos // 16 as pos, sha256(string_agg(h, '' order by pos)) as h from {prefix}c{k} where c > 1 group by 1, 2),
"""
    for k in range(depth):
        out += f"""{prefix}f{k + 1} as (select f.doc, f.g, f.pos // 16 as pos,
  case when count(s.h) = 0 then any_value(f.acc) else sha256(string_agg(case when s.pos = f.pos then f.acc else s.h end, '' order by s.pos)) end as acc,
  any_value(f.proof) || coalesce(string_agg(case when s.pos <> f.pos then s.h end, '' order by s.pos), '') as proof
  from {prefix}f{k} f left join {prefix}c{k} s on s.g = f.g and s.pos // 16 = f.pos // 16 and s.c > 1 group by f.doc, f.g, f.pos),
"""
    return out


def _tops(prefix: str, depth: int) -> str:
    counted = " union all ".join(f"select g, h, {k} as k from {prefix}{k}" for k in range(depth + 1))
    return f"(select g, max_by(h, k) as h from ({counted}) group by g)"


def _leaf_sql(text: str) -> str:
    parts = [f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || {c} end" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


#: DuckDB SQL of the query, for up to 16^5 documents of a source and 16^4 sources. CRC-32 goes bit by bit.
ORACLE = f"""
with x as (select *, row_number() over () as doc, xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(
   string_split(cast(doc_id as varchar), ''), lambda d: [cast(ord(d) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda c, b: case when b >= 0 then xor(c, b) else xor(c >> 1, 3988292384 * (c & 1)) end)) as crc from documents),
y as (select doc, doc_id, case when source is null then '-' else '=' || source end as g, {_leaf_sql('text')} as leaf,
  case when crc % 5 = 0 then {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} end as bent from x),
a0 as (select doc, doc_id, g, row_number() over (partition by g order by doc_id nulls first, leaf, doc) - 1 as pos, leaf as h, bent from y),
af0 as (select doc, g, pos, coalesce(bent, h) as acc, '' as proof from a0),
{_levels('a', 5)}
sub as {_tops('a', 5)},
b0 as (select '' as g, g as name, row_number() over (order by g) - 1 as pos, h from sub),
bf0 as (select af5.doc, '' as g, b0.pos, af5.acc, af5.proof from af5 join b0 on b0.name = af5.g),
{_levels('b', 4)}
top as {_tops('b', 4)}
select a0.doc_id, a0.h as leaf, sub.h as subroot, top.h as root, sha256(f.proof) as proof_sha256, f.acc as folded_root, f.acc = top.h as verified
from a0 join sub on sub.g = a0.g join bf4 f on f.doc = a0.doc cross join top"""
