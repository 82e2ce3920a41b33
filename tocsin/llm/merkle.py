"""Merkle manifest of a dataset: a tree of hashes per group, a tree over the groups, and a proof for every row.

Leaves get their place in their group from range partitions. Trees grow in blocks of aligned places (4,096 leaves by
default), so that a group with a third of all rows is many tasks. In a block all levels are one pass over one sort: on
the rows that are the first leaf of a node, lag and lead at the level's fixed offset bring in the siblings, masked by the
node's slot in its run and by the run's length, and the first child of a run hashes the parent. Block roots are the
leaves of the next, 4,096 times smaller table. Siblings go down the same way, block by block.

Nulls in any column are hashed as ``-``; rows without an id come first in their group, rows that share an id are ordered
by their leaf, and repeated rows are leaves of their own. A null group is a group. Long texts are hashed whole. An empty
table has no root and gives no rows. Columns that are not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import written
from tocsin.operators.ranges import positions

#: Columns of a document in the order in which a leaf hashes them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    """UTF-8 byte count, colon, value; a dash if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: dict[str, Column], fields: tuple[str, ...]) -> Column:
    return _hash(*[_field(columns[name]) for name in fields])


class Forest:
    """Trees of all groups. nodes: grp (not null), pos, n, digest and further columns that are carried along.

    arity: children of a node; span: levels that are grown in one pass.
    """

    def __init__(self, nodes: DataFrame, arity: int, span: int):
        self.arity, self.span, self.block = arity, span, arity**span
        self.levels = [nodes]
        while True:
            first = self._grown(self.levels[-1]).where(F.col("pos") % self.block == 0)
            self.levels.append(
                written(
                    first.select(
                        "grp", self._over("pos", self.block).alias("pos"), self._nodes(self.block).alias("n"),
                        F.col("_top").alias("digest"),
                    ),
                    "block_roots",
                )
            )
            longest = self.levels[-1].agg(F.max("n")).first()[0]
            if longest is None or longest <= 1:
                break

    @property
    def roots(self) -> DataFrame:
        """grp, digest of the root of every group."""
        return self.levels[-1].select("grp", "digest")

    @staticmethod
    def _over(name: str, by: int) -> Column:
        return F.expr(f"`{name}` div {by}L")

    @staticmethod
    def _nodes(step: int) -> Column:
        """Nodes of the group's level whose nodes begin every ``step`` leaves."""
        return F.expr(f"(n + {step - 1}L) div {step}L")

    def _grown(self, nodes: DataFrame) -> DataFrame:
        """Adds _block, _steps (siblings left and right of the row's ancestors, upwards) and, on the first row of a
        block, _top (the block's root)."""
        rows = Window.partitionBy("grp", "_block").orderBy("pos")
        df = nodes.withColumn("_block", self._over("pos", self.block)).withColumn("_d", F.col("digest"))
        for level in range(self.span):
            step = self.arity**level
            slot = self._over("pos", step) % self.arity
            run = F.least(F.lit(self.arity), self._nodes(step) - self._over("pos", step) + slot)
            left = [F.when(slot >= j, F.lag("_d", j * step).over(rows)) for j in range(self.arity - 1, 0, -1)]
            right = [F.when(slot + j < run, F.lead("_d", j * step).over(rows)) for j in range(1, self.arity)]
            df = df.withColumns({"_l": F.concat_ws("", *left), "_r": F.concat_ws("", *right)})
            real = self._nodes(step) > 1
            is_node, is_first = F.col("pos") % step == 0, F.col("pos") % (step * self.arity) == 0
            df = df.withColumns(
                {
                    f"_s{level}": F.when(real & is_node, F.struct(F.col("_l").alias("l"), F.col("_r").alias("r"))),
                    "_d": F.when(is_first, F.when(real, _hash(F.col("_d"), F.col("_r"))).otherwise(F.col("_d"))),
                }
            )
        sofar = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = F.array(*[F.last(f"_s{level}", ignorenulls=True).over(sofar) for level in range(self.span)])
        return df.select(
            *nodes.columns, "_block", F.col("_d").alias("_top"), F.filter(own, lambda s: s.isNotNull()).alias("_steps")
        )

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves with ``steps``: siblings of all their ancestors. above: grp, steps (those above the group's root)
        and further columns, which come along too."""
        more = [c for c in above.columns if c not in ("grp", "steps")]
        down = self.levels[-1].select("grp", "pos").join(above, "grp").select("grp", "pos", "steps", *more)
        for nodes in reversed(self.levels[:-1]):
            upper = down.select("grp", F.col("pos").alias("_block"), F.col("steps").alias("_above"), *more)
            last = nodes is self.levels[0]
            down = self._grown(nodes).join(upper, ["grp", "_block"]).select(
                *(nodes.columns if last else ("grp", "pos")), F.concat("_steps", "_above").alias("steps"), *more
            )
            down = down if last else written(down, "paths")
        return down


def folded(start: Column, steps: Column) -> Column:
    """The root recomputed from a leaf and its siblings."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def manifest(
    rows: DataFrame, digest: Column, group: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None,
    arity: int = 2, span: int = 12,
) -> DataFrame:
    """One row per input row: key, leaf, pos, n, the columns of ``keep``, steps (siblings of its ancestors, left and
    right, upwards to the root of all), subroot, root.

    Leaves of a group ascend by key, then by leaf. Roots of groups, ordered by name (null first), are the leaves of the
    tree whose root is ``root``. The last run of a level may be shorter than ``arity``, down to one node.
    """
    if arity < 2 or span < 1:
        raise ValueError("A node has two children at least, and a pass grows one level at least.")
    keep = keep or {}
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null sorts before all texts
    leaves = rows.select(
        name.alias("grp"), F.col(key).alias("_key"), digest.alias("digest"), *[v.alias(f"_k_{k}") for k, v in keep.items()]
    )
    forest = Forest(
        positions(leaves, "grp", [F.col("_key").asc_nulls_first(), F.col("digest").asc()], written), arity, span
    )
    groups = forest.roots.select(F.lit("").alias("grp"), F.col("grp").alias("_name"), "digest")
    crown = Forest(positions(groups, "grp", [F.col("_name").asc()], written), arity, min(span, 4))
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    top = crown.paths(crown.roots.select("grp", nothing.alias("steps"), F.col("digest").alias("root")))
    above = written(top.select(F.col("_name").alias("grp"), "steps", F.col("digest").alias("subroot"), "root"), "groups")
    return forest.paths(above).select(
        F.col("_key").alias(key), F.col("digest").alias("leaf"), "pos", "n",
        *[F.col(f"_k_{k}").alias(k) for k in keep], "steps", "subroot", "root",
    )


def proof(steps: Column) -> Column:
    """All siblings, upwards, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["l"], s["r"])), "")


def verify(docs: DataFrame, arity: int = 2, span: int = 12) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Where 7 divides the crc32 of the id, the folded leaf is that of the row with n_chars + 1; a row without an id or
    without n_chars is left as it is.
    """
    kinds = dict(zip(FIELDS, ("long", "string", "string", "long", "string")))
    columns = {name: F.col(name).cast(kind) for name, kind in kinds.items()}
    changed = columns | {"n_chars": F.try_add(columns["n_chars"], F.lit(1).cast("long"))}
    hit = (F.crc32(columns["doc_id"].cast("string").cast("binary")) % 7 == 0) & columns["n_chars"].isNotNull()
    rows = docs.select(*[columns[name].alias(name) for name in FIELDS])
    tampered = F.when(hit, leaf_hash(changed, FIELDS))
    found = manifest(rows, leaf_hash(columns, FIELDS), keep={"tampered": tampered}, arity=arity, span=span)
    root = folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    out = found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("steps")), 256).alias("proof_sha256"),
        root.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Trees by recursion over levels; crc32 bit by bit, since the other engine has no such function.
SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS front,
    coalesce(strlen(text) || ':' || text, '-') AS back,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
    CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(front || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || back) END AS tampered
  FROM fields
), placed AS (
  SELECT *, coalesce('=' || lang, '') AS grp, row_number() OVER own - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves WINDOW own AS (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf)
), nodes AS (
  SELECT grp, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY grp, level, pos // 2, n
), subroots AS (
  SELECT grp, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), crown AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM crown WHERE n > 1 GROUP BY level, pos // 2, n
), walk AS (
  SELECT row_number() OVER () AS id, p.doc_id, p.leaf, s.subroot, p.grp, s.pos AS place, 0 AS level, p.pos, false AS top,
    p.n, coalesce(p.tampered, p.leaf) AS node, '' AS proof
  FROM placed AS p JOIN subroots AS s USING (grp)
  UNION ALL
  SELECT id, doc_id, leaf, subroot, w.grp, place, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.n = 1 THEN place ELSE w.pos // 2 END, top OR w.n = 1,
    CASE WHEN w.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (w.n + 1) // 2 END,
    CASE WHEN w.n = 1 THEN node WHEN w.pos % 2 = 0 THEN sha256(node || coalesce(a.digest, b.digest, ''))
      ELSE sha256(coalesce(a.digest, b.digest, '') || node) END,
    proof || CASE WHEN w.n = 1 THEN '' ELSE coalesce(a.digest, b.digest, '') END
  FROM walk AS w
  LEFT JOIN nodes AS a ON NOT top AND a.grp = w.grp AND a.level = w.level AND a.pos = xor(w.pos, 1)
  LEFT JOIN crown AS b ON top AND b.level = w.level AND b.pos = xor(w.pos, 1)
  WHERE NOT (top AND w.n = 1)
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM walk, (SELECT digest AS root FROM crown WHERE n = 1) WHERE top AND n = 1
"""
