"""Merkle manifest of a dataset: a content-addressed DAG that is descended for proofs.

Rows are leaves, ordered inside their group; runs of ``arity`` digests become their hash until one
is left, the group's subroot. Subroots, ordered by group, are hashed in the same way to the root.
The store keeps digest-to-children records. The records of ``arity ** digits`` neighbouring leaves
are one row, addressed by the digest of the block's top node, so that a descent takes a join for
every ``digits`` levels. A request goes down from the root by the digits of its rank, collects the
children it does not choose, and the reversed segments are its proof.

All requests start at the root, but only distinct prefixes of ranks descend: a block is looked up
once for all requests below it. No key, however many rows its group holds, meets more than one
block's worth of requests.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.numbering import number_rows
from .shared import cut

ARITY, DIGITS = 2, 10  # blocks of 1 024 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return sha(*[field(v) for v in values])


class Manifest(NamedTuple):
    """``leaves``: (tree, rank, digest, row), one per row of the data, ranks from 0; ``trees``:
    (tree, name, rank, n, digest) of the groups in order; ``store``: (digest, depth, levels) records,
    where a depth of 0 is a digest that stands for itself alone;
    ``root``: the digest of all, null for no rows."""

    leaves: DataFrame
    trees: DataFrame
    store: DataFrame
    root: str | None
    arity: int
    digits: int


def _upwards(digests: Column, depth: Column, arity: int) -> Column:
    """Digests of a block by level, from its leaves up through ``depth`` levels of hashes."""
    def above(held: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / arity).cast("int")), lambda i: F.array_join(F.slice(held, i * arity + 1, F.lit(arity)), ""))
        return F.transform(runs, lambda r: F.sha2(r, 256))

    start = F.array(digests)
    grown = F.aggregate(F.sequence(F.lit(1), depth), start, lambda levels, _: let(levels, lambda v: F.concat(v, F.array(above(F.element_at(v, -1))))))
    return F.when(depth > 0, grown).otherwise(start)


def _depth(n: Column, arity: int, digits: int) -> Column:
    """Levels above ``n`` nodes inside one block; ``digits`` where the tree goes on above it."""
    return F.least(F.size(F.filter(F.array(*[F.lit(arity**i) for i in range(digits + 1)]), lambda p: p < n)), F.lit(digits))


def build(nodes: DataFrame, arity: int = ARITY, digits: int = DIGITS) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (tree, n, digest) of the trees of ``nodes`` (tree, rank, digest), and the tables of the store."""
    width = arity**digits
    layer = nodes.select("tree", "rank", "digest")
    sizes = layer.groupBy("tree").agg(F.count("*").alias("n"))
    size = cut(sizes.withColumn("left", F.col("n")), "sizes")
    store, roots = [], []
    while True:
        block = layer.groupBy("tree", F.floor(F.col("rank") / width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("held"))
        sized = block.join(size.withColumnRenamed("tree", "of"), F.col("tree") == F.col("of"))
        levels = _upwards(F.transform("held", lambda h: h["digest"]), _depth(F.col("left"), arity, digits), arity)
        made = sized.select("tree", "block", "n", "left", levels.alias("levels"))
        made = cut(made.withColumn("digest", F.element_at(F.element_at("levels", -1), 1)), "records")
        store.append(made.select("digest", (F.size("levels") - 1).alias("depth"), "levels"))
        roots.append(made.where(F.col("left") <= width).select("tree", "n", "digest"))
        layer = made.where(F.col("left") > width).select("tree", F.col("block").alias("rank"), "digest")
        if layer.isEmpty():
            break
        size = size.where(F.col("left") > width).withColumn("left", F.ceil(F.col("left") / width).cast("long"))
    done = roots[0]
    for r in roots[1:]:
        done = done.unionByName(r)
    return done, store


def manifest(docs: DataFrame, group: str, order: str, fields: Sequence[str] = FIELDS, row: Column | None = None, arity: int = ARITY, digits: int = DIGITS) -> Manifest:
    """The manifest of ``docs``: a tree for each value of ``group`` with leaves ascending by ``order``.

    A null group is a tree of its own and comes first, nulls of ``order`` come first, ties follow
    the leaf's digest; repeated rows are leaves of their own. ``row`` is carried beside each leaf.
    """
    kept = docs.select(F.col(group).alias("name"), F.col(order).alias("at"), leaf([F.col(f) for f in fields]).alias("digest"), (F.lit(None) if row is None else row).alias("row"))
    kept = cut(kept, "leaves")  # texts are hashed once; ranges are sampled from what is written here
    ranked = number_rows(kept, ["at", "digest"], "rank", within=["name"])
    names = number_rows(kept.select("name").distinct(), ["name"], "tree")
    names = cut(names.select(F.col("name").alias("named"), "tree"), "names")
    leaves = ranked.join(names, F.col("name").eqNullSafe(F.col("named"))).select("tree", (F.col("rank") - 1).alias("rank"), "digest", "row")
    leaves = cut(leaves, "ranked")
    subroots, store = build(leaves, arity, digits)
    trees = subroots.join(names.withColumnRenamed("tree", "of"), F.col("tree") == F.col("of"))
    trees = cut(trees.select("tree", F.col("named").alias("name"), (F.col("tree") - 1).alias("rank"), "n", "digest"), "trees")
    top, above = build(trees.select(F.lit(0).cast("long").alias("tree"), "rank", "digest"), arity, digits)
    root = top.collect()  # one row, none for an empty table
    records = store[0]
    for s in [*store[1:], *above]:
        records = records.unionByName(s)
    # Equal subtrees are one record.
    records = cut(records.groupBy("digest", "depth").agg(F.first("levels").alias("levels")), "store")
    return Manifest(leaves, trees, records, root[0]["digest"] if root else None, arity, digits)


def _segment(levels: Column, at: Column, arity: int) -> Column:
    """What a descent from a block's top to its leaf ``at`` leaves aside, from the top down."""
    def aside(level: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(arity), level)).cast("int")
        first = place - place % arity
        held = F.get(levels, level)
        return F.struct(
            F.array_join(F.slice(held, first + 1, place - first), "").alias("before"),
            F.array_join(F.slice(held, place + 2, F.greatest(first + arity - place - 1, F.lit(0))), "").alias("after"),
        )

    depth = F.size(levels) - 1
    steps = F.transform(F.sequence(depth - 1, F.lit(0), F.lit(-1)), aside)
    return F.when(depth > 0, steps).otherwise(F.array().cast(PATH))


def descend(tops: DataFrame, requests: DataFrame, store: DataFrame, arity: int = ARITY, digits: int = DIGITS) -> DataFrame:
    """(tree, rank, row, digest, path) of the ``requests`` (tree, rank, row), ranks distinct in a tree.

    ``tops`` (tree, n, digest, path) says where each tree starts and what was left aside above it.
    """
    width = arity**digits
    most = tops.agg(F.max("n")).first()[0] or 0
    layers = 1
    while width**layers < most:
        layers += 1
    tops = tops.withColumn("layers", F.size(F.filter(F.array(*[F.lit(width**i) for i in range(1, layers + 1)]), lambda p: p < F.col("n"))))
    found = None
    for k in range(layers - 1, -1, -1):
        left = F.ceil(F.col("n") / width**k)
        here = tops.where(F.col("layers") == k).select(
            "tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("top"), _depth(left, arity, digits).alias("levels_below"), F.col("path").alias("above")
        )
        if found is not None:
            passed = found.select("tree", F.col("rank").alias("block"), F.col("digest").alias("top"), F.lit(digits).alias("levels_below"), F.col("path").alias("above"))
            here = here.unionByName(passed)
        if k:
            wanted = requests.select("tree", F.floor(F.col("rank") / width**k).alias("rank"), F.lit(None).alias("row")).distinct()
        else:
            wanted = requests.select("tree", "rank", "row")
        asked = wanted.groupBy("tree", F.floor(F.col("rank") / width).alias("block")).agg(F.collect_list(F.struct("rank", "row")).alias("asked"))
        met = asked.join(here, ["tree", "block"]).join(store, (F.col("top") == store["digest"]) & (F.col("levels_below") == store["depth"]))

        def answer(r: Column) -> Column:
            at = (r["rank"] % width).cast("int")
            return let(
                at,
                lambda i: F.struct(
                    r["rank"].alias("rank"), r["row"].alias("row"), F.get(F.get(F.col("levels"), F.lit(0)), i).alias("digest"),
                    F.concat(F.col("above"), _segment(F.col("levels"), i, arity)).alias("path"),
                ),
            )

        found = met.select("tree", F.inline(F.transform("asked", answer)))
        if k:
            found = cut(found, "descent")
    return found


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda held, step: sha(step["before"], held, step["after"]))


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(tree, rank, row, digest, subroot, proof) of the leaves asked for (all by default).

    ``proof`` runs from the leaf to the root: at each level what stands before and after the
    node in its run.
    """
    if m.root is None:
        asked = m.leaves.limit(0)
        return asked.select("tree", "rank", "row", "digest", F.col("digest").alias("subroot"), F.array().cast(PATH).alias("proof"))
    root = m.trees.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("tree"), F.lit(m.root).alias("digest"), F.array().cast(PATH).alias("path")
    )
    root = root.join(F.broadcast(m.trees.agg(F.count("*").alias("n"))))  # one row
    groups = m.trees.select(F.lit(0).cast("long").alias("tree"), "rank", F.struct("tree", "n").alias("row"))
    tops = descend(root, groups, m.store, m.arity, m.digits).select("row.tree", "row.n", "digest", "path")
    tops = cut(tops, "tops")
    asked = m.leaves if requests is None else requests
    found = descend(tops, asked, m.store, m.arity, m.digits)
    named = tops.select(F.col("tree").alias("of"), F.col("digest").alias("subroot"))
    return found.join(named, F.col("tree") == F.col("of")).select("tree", "rank", "row", "digest", "subroot", F.reverse("path").alias("proof"))


def op11_manifest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``documents``.

    Rows of equal doc_id are ordered by their digests. A null doc_id comes first in its language
    and is never tampered with.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = leaf([F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    m = manifest(docs, "lang", "doc_id", row=F.struct("doc_id", F.when(tampered & F.col("n_chars").isNotNull(), other).alias("tampered")))
    found = proofs(m)
    folded = fold(F.coalesce("row.tampered", "digest"), F.col("proof"))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    out = found.select(
        F.col("row.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS t
  FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS n)),
parts AS (
  SELECT doc_id, lang, row_number() OVER () AS r,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS crc
  FROM documents, crc_table),
leaves AS (
  SELECT doc_id, lang, r, sha256(head || n || tail) AS leaf, CASE WHEN crc % 7 = 0 THEN sha256(head || n1 || tail) ELSE sha256(head || n || tail) END AS other
  FROM parts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS lvl, i, n, leaf AS d FROM ranked
  UNION ALL
  SELECT lang, lvl + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 2),
subroots AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, i, n, d FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 2),
nodes AS (
  SELECT lang, 0 AS part, lvl, i, n, d FROM tree UNION ALL SELECT NULL, 1, lvl, i, n, d FROM top),
places AS (
  SELECT r, 0 AS part, ranked.lang, ranked.i, s.lvl FROM ranked JOIN (SELECT DISTINCT lang, lvl FROM tree WHERE n > 1) s ON s.lang IS NOT DISTINCT FROM ranked.lang
  UNION ALL
  SELECT r, 1, NULL, subroots.i, s.lvl FROM ranked JOIN subroots ON subroots.lang IS NOT DISTINCT FROM ranked.lang, (SELECT DISTINCT lvl FROM top WHERE n > 1) s),
steps AS (
  SELECT p.r, p.part, p.lvl, coalesce(nodes.d, '') AS d, (p.i // (1 << p.lvl)) % 2 AS is_right
  FROM places p LEFT JOIN nodes ON nodes.part = p.part AND nodes.lang IS NOT DISTINCT FROM p.lang AND nodes.lvl = p.lvl AND nodes.i = xor(p.i // (1 << p.lvl), 1)),
proofs AS (SELECT r, list({'d': d, 'is_right': is_right} ORDER BY part, lvl) AS proof FROM steps GROUP BY r),
answers AS (
  SELECT doc_id, leaf, subroots.d AS subroot, (SELECT d FROM top WHERE n = 1) AS root,
    sha256(coalesce(list_aggregate(list_transform(proof, lambda s: s.d), 'string_agg', ''), '')) AS proof_sha256,
    coalesce(list_reduce(list_prepend({'d': other, 'is_right': 0}, proof),
      lambda a, s: {'d': sha256(CASE WHEN s.is_right = 1 THEN s.d || a.d ELSE a.d || s.d END), 'is_right': 0}).d, other) AS folded_root
  FROM ranked LEFT JOIN proofs USING (r) JOIN subroots ON subroots.lang IS NOT DISTINCT FROM ranked.lang)
SELECT *, folded_root = root AS verified FROM answers
"""
