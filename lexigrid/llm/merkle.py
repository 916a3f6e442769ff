"""Merkle manifest of a table of documents, by incremental witnesses.

Leaves are appended in order.  An append opens a subtree of height 0; two open subtrees of one height become one of the
next.  Every open subtree carries the witnesses of its leaves so far: when its sibling is completed, the sibling's root
extends them.  Aligned blocks of leaves are appended to in tasks of their own, and the roots of the blocks are the
appends of the next level, until each language has one root; those are then appended in turn.

A witness holds the siblings alone.  Which side each stands on, and where a node had no sibling, follows from the place
of the leaf and the number of leaves.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexigrid.llm.common import lookup, ranked, stored

HEIGHT = 10          # a block holds 2 ** HEIGHT appends
TAMPERED = 7         # rows the CRC-32 of whose key this divides are tampered with


def _h(*parts: bytes) -> bytes:
    """Digest of digests, which enter as hex text."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


class Frontier:
    """Open subtrees of a run of aligned appends, with the partial witnesses of their leaves."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, list[list[bytes]]]] = []   # height, root, witness of each leaf

    def append(self, digest: bytes) -> None:
        self.open.append((0, digest, [[]]))
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        height, right, later = self.open.pop()
        _, left, sooner = self.open.pop()
        for witness in sooner:
            witness.append(right)
        for witness in later:
            witness.append(left)
        self.open.append((height + 1, _h(left, right), sooner + later))

    def close(self, height: int | None = None) -> tuple[bytes, list[list[bytes]]]:
        """Root and witnesses once nothing more is appended; subtrees without a sibling are lifted alone.

        With ``height`` the root is lifted so high, as that of a block that others stand beside.
        """
        while True:
            low, root, leaves = self.open[-1]
            if len(self.open) > 1:
                if low == self.open[-2][0]:
                    self._join()
                    continue
            elif height is None or low >= height:
                return root, leaves
            self.open[-1] = (low + 1, _h(root), leaves)


def _append_block(rows: pa.Table, schema: pa.Schema, height: int) -> pa.Table:
    """The rows of a block with their witnesses, and a row with the block's root and its height."""
    rows = rows.sort_by("at")
    frontier = Frontier()
    for digest in rows.column("digest"):
        frontier.append(digest.as_py())
    block, n = (rows.column(c)[0].as_py() for c in ("block", "n"))
    root, paths = frontier.close(height if n > 1 << height else None)
    k = len(paths)
    own = {"at": block, "n": -(-n >> height), "g": rows.column("g")[0].as_py(), "block": block}
    made = {"height": [0] * k + [height], "root": [None] * k + [root], "path": [*map(b"".join, paths), None]}
    return pa.table([pa.array(made[f.name], f.type) if f.name in made
                     else pa.chunked_array([*rows.column(f.name).cast(f.type).chunks, pa.array([own.get(f.name)], f.type)]) for f in schema], schema)


def witnesses(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``nodes`` with subroot and path (siblings from the leaf up).

    Nodes have g, at, n and digest, as ``ranked`` gives them, and may have columns of their own.  A level turns
    2 ** ``height`` nodes into one, so even a group of 10 ** 12 nodes takes four.
    """
    blocks = nodes.withColumn("block", F.shiftright("at", height))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in blocks.schema])\
        .add("height", T.IntegerType()).add("root", T.BinaryType()).add("path", T.BinaryType())
    arrow = to_arrow_schema(schema)
    done = stored(blocks.groupBy("g", "block").applyInArrow(lambda rows: _append_block(rows, arrow, height), schema), "witnesses")
    members = done.where("height = 0").drop("height", "root")
    roots = done.where("height > 0").select("g", "at", "n", F.col("root").alias("digest"))
    if roots.where("n > 1").isEmpty():
        above = roots.select("g", F.col("at").alias("block"), F.col("digest").alias("subroot"), F.lit(b"").alias("_above"))
    else:
        above = witnesses(roots, height).select("g", F.col("at").alias("block"), "subroot", F.col("path").alias("_above"))
    out = lookup(members, above, ["g", "block"], row_bytes=1024, how="inner")
    return out.withColumn("path", F.concat("path", "_above")).drop("block", "_above")


def fold(leaf: bytes, places: list[tuple[int, int]], path: bytes) -> bytes:
    """Root that a leaf and its siblings lead to; ``places`` are (place, size) of each tree on the way up."""
    used = 0
    for at, n in places:
        while n > 1:
            if at ^ 1 < n:
                sibling = path[used : used + 32]
                used += 32
                leaf = _h(sibling, leaf) if at & 1 else _h(leaf, sibling)
            else:
                leaf = _h(leaf)
            at, n = at >> 1, n + 1 >> 1
    return leaf


@F.arrow_udf(T.StringType())
def _folded(leaf: pa.Array, at: pa.Array, n: pa.Array, path: pa.Array, lang_at: pa.Array, langs: pa.Array) -> pa.Array:
    columns = (c.to_pylist() for c in (leaf, at, n, path, lang_at, langs))
    return pa.array([fold(x, [(a, size), (b, all_)], p).hex() for x, a, size, p, b, all_ in zip(*columns)], pa.string())


def _entry(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(key: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a row: each value with its UTF-8 byte count before it, null as a dash."""
    return F.unhex(F.sha2(F.concat(*[_entry(c) for c in (key, source, lang, n_chars, text)]), 256))


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", lang: str = "lang", n_chars: str = "n_chars",
             text: str = "text", height: int = HEIGHT) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of every row, and the places of its witness.

    Null values are leaves like any other and null languages a group of their own, the first.  Null keys come first in
    their language and aren't tampered with.  Rows of one key stand in the order of their leaves, equal rows each in a
    place of its own.  An empty table gives no rows; only the five named columns are read.
    """
    cols = {c: F.col(c) for c in (key, source, lang, n_chars, text)}
    tampered = F.crc32(cols[key].cast("string")) % TAMPERED == 0
    more = (cols[n_chars].cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    other = leaf_of(cols[key], cols[source], cols[lang], more, cols[text])
    # a null language sorts before the empty one
    group = F.coalesce(F.concat(F.lit("="), cols[lang].cast("string")), F.lit(""))
    leaves = stored(docs.select(cols[key].alias("id"), group.alias("g"), leaf_of(*cols.values()).alias("digest"),
                                F.when(tampered, other).alias("other")), "leaves")
    inner = stored(witnesses(ranked(leaves, "g", [F.col("id").asc_nulls_first(), F.col("digest")]), height), "inner")
    subroots = stored(inner.groupBy("g").agg(F.first("subroot").alias("digest")), "subroots")
    outer = witnesses(ranked(subroots.select(F.col("g").alias("own"), F.lit("").alias("g"), "digest"), "g", [F.col("own")]), height)
    outer = outer.select(F.col("own").alias("g"), F.col("at").alias("lang_at"), F.col("n").alias("langs"),
                         F.col("subroot").alias("root"), F.col("path").alias("_above"))
    out = lookup(inner, outer, ["g"], row_bytes=1024, how="inner").withColumn("path", F.concat("path", "_above"))
    folded = _folded(F.coalesce("other", "digest"), "at", "n", "path", "lang_at", "langs")
    text_of = lambda c: F.lower(F.hex(c))
    out = out.select(F.col("id").alias(key), text_of("digest").alias("leaf"), text_of("subroot").alias("subroot"), text_of("root").alias("root"),
                     F.sha2(text_of("path"), 256).alias("proof_sha256"), folded.alias("folded_root"), "at", "n", "lang_at", "langs")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def sql() -> str:
    """DuckDB SQL for the contract's columns of ``manifest`` over documents."""
    entry = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda n: f"sha256({' || '.join(map(entry, ('doc_id', 'source', 'lang', n, 'text')))})"
    tree = lambda name, base: (
        f"{name}(lvl, g, i, h) AS (SELECT 0, g, i, h FROM ({base}) UNION ALL SELECT lvl + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)) "
        f"FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}) WHERE n > 1 GROUP BY lvl, g, i // 2)")
    climb = lambda name, base, nodes: (
        f"{name}(r, lvl, g, i, h) AS (SELECT r, 0, g, i, h FROM ({base}) UNION ALL SELECT r, f.lvl + 1, f.g, f.i // 2, CASE WHEN s.h IS NULL "
        f"THEN sha256(f.h) WHEN f.i % 2 = 1 THEN sha256(s.h || f.h) ELSE sha256(f.h || s.h) END FROM {name} f "
        f"JOIN {nodes}_top t ON t.g = f.g AND f.lvl < t.top LEFT JOIN {nodes} s ON s.g = f.g AND s.lvl = f.lvl AND s.i = xor(f.i, 1))")
    siblings = lambda stage, nodes: (
        f"SELECT r, {stage} AS stage, s.lvl, s.h FROM place p JOIN {nodes} s ON s.g = p.g{stage} AND s.i = xor(p.i{stage} >> s.lvl, 1) "
        f"JOIN {nodes}_top t ON t.g = s.g AND s.lvl < t.top")
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT *, row_number() OVER () AS r, coalesce('=' || lang, '') AS g, {leaf('n_chars')} AS leaf,
xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1)))) AS crc FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  CASE WHEN crc % {TAMPERED} = 0 THEN {leaf('(n_chars + 1)')} ELSE leaf END AS tampered FROM d),
{tree('a', 'SELECT g, i, leaf AS h FROM o')},
a_top AS MATERIALIZED (SELECT g, max(lvl) AS top, arg_max(h, lvl) AS h FROM a GROUP BY g),
{tree('b', "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM a_top")},
b_top AS MATERIALIZED (SELECT g, max(lvl) AS top, arg_max(h, lvl) AS h FROM b GROUP BY g),
place AS MATERIALIZED (SELECT o.r, o.g AS g0, o.i AS i0, '' AS g1, n.i AS i1 FROM o
  JOIN (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM a_top) n USING (g)),
proof AS MATERIALIZED (SELECT r, sha256(string_agg(h, '' ORDER BY stage, lvl)) AS p FROM ({siblings(0, 'a')} UNION ALL {siblings(1, 'b')}) GROUP BY r),
{climb('f', 'SELECT r, g, i, tampered AS h FROM o', 'a')},
{climb('e', "SELECT f.r, '' AS g, place.i1 AS i, f.h FROM f JOIN a_top t ON t.g = f.g AND t.top = f.lvl JOIN place ON place.r = f.r", 'b')}
SELECT o.doc_id, o.leaf, a_top.h AS subroot, b_top.h AS root, coalesce(proof.p, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = b_top.h AS verified
FROM o JOIN a_top USING (g) CROSS JOIN b_top JOIN e ON e.r = o.r AND e.lvl = b_top.top LEFT JOIN proof ON proof.r = o.r"""
