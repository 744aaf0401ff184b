"""A Merkle manifest of a dataset: a tree of digests for each source, and one over the sources' roots.

1. Leaves are digests of rows. They are numbered within their source in order of doc_id (millrace.llm.ranks); a node's index, floor-divided
   by the fanout, is its parent's. Sorted child digests are gathered by (source, parent's index), never more than the fanout of them, and hashed.
   Each level is one such grouping, written as a table a fanout smaller than the one before, until every source has one node.
2. The sources' roots are leaves of a last tree of the same kind, so any number of sources is handled like any number of rows.
3. Proofs come down again: from the root, each level's runs of children join their parents' proofs, and each child adds its own
   siblings to its left and right. Leaves join the runs they are in, so what is shuffled for them is a run's row for every 16 leaves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.ranks import numbered
from millrace.llm.store import cut

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hex of the SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """'-' for null, else the number of bytes, ':' and the value, so that no two rows have the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to by the siblings of its proof."""
    return F.aggregate(proof, start, lambda d, s: digest(s["left"], d, s["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof, left to right, level by level, as one text."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(leaves: DataFrame, fanout: int, label: str) -> list[DataFrame]:
    """Tables of runs (tree, idx, size, digest, children), the lowest level first, of leaves (tree, idx, size, digest), size being the
    number of nodes of the tree at that level. Trees of one node have no run."""
    levels, nodes = [], leaves
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        runs = nodes.where("size > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx"), F.ceil(F.col("size") / fanout).alias("size"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("children"))
        runs = runs.select("tree", "idx", "size", F.transform("children", lambda c: c["digest"]).alias("children"))
        nodes = cut(runs.withColumn("digest", digest(F.array_join("children", ""))), f"{label}-level-{len(levels)}")
        levels.append(nodes)
        most = -(-most // fanout)
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, height, digest) of the root of each tree."""
    out = None
    for height, nodes in enumerate([leaves, *levels]):
        found = nodes.where("size = 1").select("tree", F.lit(height).alias("height"), "digest")
        out = found if out is None else out.unionByName(found)
    return out


def _children(runs: DataFrame, known: DataFrame) -> DataFrame:
    """Runs with what is known of them as nodes: columns of known by (tree, idx)."""
    return runs.select("tree", "idx", "children").join(known, ["tree", "idx"])


def _step(children: Column, k: Column) -> Column:
    """What stands to the left and right of child k."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), k), "").alias("left"), F.array_join(F.slice(children, k + 2, F.size(children)), "").alias("right"))


def _described(levels: list[DataFrame], tops: DataFrame, known: Sequence[str], fanout: int) -> DataFrame:
    """(tree, idx, children, proof, *known) for the runs of leaves: children are the leaves' digests, proof that of the run. tops has (tree, height,
    proof, *known). A tree of one leaf is a run without children, whose proof is the leaf's."""
    nodes = tops.where(F.col("height") == len(levels)).select("tree", F.lit(0).cast("long").alias("idx"), "proof", *known)
    for height in range(len(levels) - 1, 0, -1):
        runs = _children(levels[height], nodes).select("tree", "idx", "proof", *known, "children", F.posexplode("children").alias("k", "_child"))
        below = runs.select(
            "tree", (F.col("idx") * fanout + F.col("k")).alias("idx"), F.concat(F.array(_step(F.col("children"), F.col("k"))), F.col("proof")).alias("proof"), *known
        )
        nodes = below.unionByName(tops.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("idx"), "proof", *known))
    if not levels:
        return nodes.withColumn("children", F.lit(None).cast("array<string>"))
    alone = tops.where("height = 0").select("tree", F.lit(0).cast("long").alias("idx"), F.lit(None).cast("array<string>").alias("children"), "proof", *known)
    return _children(levels[0], nodes).unionByName(alone)


def _proved(leaves: DataFrame, described: DataFrame, known: Sequence[str], fanout: int) -> DataFrame:
    """leaves with their proof and the columns known."""
    place, run = leaves.withColumn("_k", (F.col("idx") % fanout).cast("int")).withColumn("_run", F.floor(F.col("idx") / fanout)), described.withColumnRenamed("idx", "_run")
    both = place.join(run, ["tree", "_run"])
    own = F.when(F.col("children").isNull(), F.col("proof")).otherwise(F.concat(F.array(_step(F.col("children"), F.col("_k"))), F.col("proof")))
    return both.select(*[f"`{c}`" for c in leaves.columns], *known, own.alias("proof"))


def manifest(
    docs: DataFrame, columns: Sequence[str] = FIELDS, *, group: str = "source", order: str = "doc_id", fanout: int = FANOUT, carried: Mapping[str, Column] | None = None
) -> DataFrame:
    """(order, *carried, leaf, subroot, root, proof) for each row of docs. proof is an array of struct<left, right>, from the leaf up: the digests
    beside the node in its run. See folded() and siblings().

    columns are the fields of a leaf, strings or integers. carried: columns computed from the row that go beside it, for example
    the leaf of the row as it was received; their names must differ from those of the result. Groups ascend by UTF-8 bytes, null first; leaves by
    `order`, null first, rows with equal values by their digests; rows equal in all fields have the same leaf and different places.
    Null, empty and very long texts are hashed whole where they lie; only digests are shuffled. An empty table gives an empty one.
    Other columns of docs are left out, so their names can't clash.
    """
    carried = carried or {}
    base = "array<" + _STEP + ">"
    tree = F.coalesce(F.concat(F.lit("+"), docs[group].cast("string")), F.lit("")).alias("tree")
    rows = docs.select(docs[order].alias("_order"), tree, leaf([docs[c] for c in columns]).alias("digest"), *[v.alias(k) for k, v in carried.items()])
    leaves = numbered(rows, ["tree"], ["_order", "digest"], "merkle-leaves")
    levels = _levels(leaves.select("tree", "idx", "size", "digest"), fanout, "merkle")
    roots = cut(_tops(leaves, levels), "merkle-subroots")
    # The subroots are the leaves of one more tree.
    over = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "height", "digest"), ["tree"], ["name"], "merkle-sources")
    above = _levels(over.select("tree", "idx", "size", "digest"), fanout, "merkle-sources")
    top = _tops(over, above).select("tree", "height", F.col("digest").alias("root"), F.array().cast(base).alias("proof"))
    over = _proved(over, _described(above, top, ["root"], fanout), ["root"], fanout)
    known = over.select(F.col("name").alias("tree"), "height", F.col("digest").alias("subroot"), "root", "proof")
    known = cut(known, "merkle-proofs")
    out = _proved(leaves, _described(levels, known, ["subroot", "root"], fanout), ["subroot", "root"], fanout)
    return out.select(F.col("_order").alias(order), *carried, F.col("digest").alias("leaf"), "subroot", "root", "proof")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 5 == 0
    received = leaf([F.translate("text", UPPER, LOWER) if c == "text" else docs[c] for c in FIELDS])
    out = manifest(docs, carried={"received": F.when(hit, received)})
    back = folded(F.coalesce("received", "leaf"), F.col("proof"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = """
WITH RECURSIVE crc_bits AS (SELECT i, 0 AS k, i AS v FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_bits WHERE k = 8),
f AS (SELECT doc_id, source, text, lang, n_chars, coalesce('+' || source, '') AS tree,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a // 256, t[(xor(a, b) % 256) + 1])), 4294967295) AS crc
  FROM documents, crc_table),
g AS (SELECT doc_id, tree, crc, text, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM f),
h AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS digest,
  CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS received FROM g),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size FROM h),
up AS (SELECT tree, 0 AS height, idx, size, digest FROM leaves
  UNION ALL SELECT tree, height + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE size > 1 GROUP BY tree, height, idx // 16, size),
tops AS (SELECT tree, digest, height, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM up WHERE size = 1),
over_up AS (SELECT 0 AS height, idx, size, digest FROM tops
  UNION ALL SELECT height + 1, idx // 16, (size + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM over_up WHERE size > 1 GROUP BY height, idx // 16, size),
nodes AS (SELECT tree, height, idx, size, digest FROM up UNION ALL SELECT t.tree, t.height + o.height, o.idx, o.size, o.digest FROM over_up o, tops t),
paths AS (SELECT doc_id, tree, idx AS leaf_idx, 0 AS height, idx, size FROM leaves WHERE size > 1
  UNION ALL SELECT doc_id, tree, leaf_idx, height + 1, idx // 16, (size + 15) // 16 FROM paths WHERE size > 16),
over_paths AS (SELECT tree, height, idx, size FROM tops WHERE size > 1 UNION ALL SELECT tree, height + 1, idx // 16, (size + 15) // 16 FROM over_paths WHERE size > 16),
steps AS (SELECT tree, leaf_idx, height, idx, size FROM paths UNION ALL SELECT l.tree, l.idx, o.height, o.idx, o.size FROM leaves l JOIN over_paths o USING (tree)),
sides AS (SELECT s.tree, s.leaf_idx, s.height, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx < s.idx), '') AS lft, coalesce(string_agg(n.digest, '' ORDER BY n.idx) FILTER (n.idx > s.idx), '') AS rgt
  FROM steps s JOIN nodes n ON n.tree = s.tree AND n.height = s.height AND n.size = s.size AND n.idx // 16 = s.idx // 16 GROUP BY s.tree, s.leaf_idx, s.height, s.idx),
proofs AS (SELECT tree, leaf_idx, list({'l': lft, 'r': rgt} ORDER BY height) AS proof FROM sides GROUP BY ALL),
fold AS (SELECT tree, idx, 1 AS k, coalesce(received, digest) AS d FROM leaves
  UNION ALL SELECT f.tree, f.idx, k + 1, sha256(proof[k].l || d || proof[k].r) FROM fold f JOIN proofs p ON p.tree = f.tree AND p.leaf_idx = f.idx WHERE k <= len(proof)),
ends AS (SELECT tree, idx, max_by(d, k) AS folded_root FROM fold GROUP BY ALL)
SELECT l.doc_id, l.digest AS leaf, t.digest AS subroot, r.digest AS root, sha256(coalesce(list_aggregate(list_transform(p.proof, lambda s: s.l || s.r), 'string_agg', ''), '')) AS proof_sha256,
  e.folded_root, e.folded_root = r.digest AS verified
FROM leaves l JOIN tops t USING (tree) JOIN ends e ON e.tree = l.tree AND e.idx = l.idx LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_idx = l.idx, (SELECT digest FROM over_up WHERE size = 1) r
"""
