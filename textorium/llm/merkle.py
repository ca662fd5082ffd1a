"""Operator 13: Merkle dataset manifest, a tree of hashes over every row of a table, with a proof for each.

Leaves are put in order by ranges of (group, key), each range numbered from the counts of those before it. A mountain
range then runs over each numbered range: a stack of peaks to which leaves are pushed; whenever the top `fanout` peaks
are the children of one node, they are carried into it. What has become a child is a finished node record; peaks whose
siblings lie in other ranges are left over. Rounds of merging deal those to tiles of fanout^TILE leaves, fanout^(2 TILE)
and so on, so that a task holds no more than fanout^TILE peaks of a tile, until only roots are left. The last run of a
level may be short; it is hashed as it is, without padding, even if it has one node.

Proofs are the siblings from a leaf to the root. Node records meet in tiles of TILE levels, each of which gives its own
leaves the siblings within it; tiles are joined from the top down, so that no key has more than fanout^TILE rows.

Cases: a null value counts as such in a leaf (it differs from an empty text); null groups and null ids come first; rows of
one id are put in order by their leaves, equal rows have the same leaf and places beside each other; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, written

#: Levels of a tile: of the rounds that merge peaks, and of the joins of proofs.
TILE = 10
NODE = "g string, n long, level int, first long, hash string"


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values: `-` for null, else the UTF-8 bytes' number, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def group_key(group: Column) -> Column:
    """A string that orders like the group bytewise, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def indexed(leaves: DataFrame, key: str) -> DataFrame:
    """The rows of leaves (g, key, u, hash, ...) with their place `first` in g by (key, hash, u), and n, the rows of g."""
    order = ["g", key, "hash", "u"]
    d = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    d = d.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    d = written(d, "ordered-leaves")
    # A row per group and range, so few for a group that a window takes them.
    runs = d.groupBy("g", "part").agg(F.count("*").alias("k"), F.min("seq").alias("low"))
    runs = runs.selectExpr("g", "part", "sum(k) over (partition by g order by part) - k - low as shift", "sum(k) over (partition by g) as n")
    return d.join(runs, ["g", "part"]).withColumn("first", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def levels(n: int, fanout: int) -> list[int]:
    """Nodes of each level over n leaves, down to one."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


def mountains(batches: Iterator[pd.DataFrame], fanout: int) -> Iterator[pd.DataFrame]:
    """Node records (NODE, open) from nodes in order of (g, first), across batches; open: left over, to be merged."""
    stack: list[tuple[int, int, str]] = []  # (level, place on the level, hash)
    of, size, after, out = None, [1], -1, []

    def put(level, i, h, is_open):
        out.append((of, size[0], level, i * fanout**level, h, is_open))

    def close():
        for level, i, h in stack:
            put(level, i, h, level < len(size) - 1)
        stack.clear()

    for b in batches:
        for g, n, level, first, h in zip(b["g"], b["n"], b["level"], b["first"], b["hash"]):
            if g != of or first != after:
                close()
                if g != of:
                    of, size = g, levels(n, fanout)
            span = fanout**level
            after = min(first + span, n)
            stack.append((level, first // span, h))
            while (level := stack[-1][0]) < len(size) - 1:
                i = stack[-1][1]
                up = i // fanout
                if i + 1 != min((up + 1) * fanout, size[level]):
                    break
                k = i + 1 - up * fanout
                if len(stack) < k or stack[-k][:2] != (level, up * fanout):
                    break
                run = stack[-k:]
                del stack[-k:]
                for x in run:
                    put(*x, False)
                stack.append((level + 1, up, sha256("".join(x[2] for x in run).encode()).hexdigest()))
        if out:
            yield pd.DataFrame(out, columns=["g", "n", "level", "first", "hash", "open"])
            out.clear()
    close()
    if out:
        yield pd.DataFrame(out, columns=["g", "n", "level", "first", "hash", "open"])


def node_records(leaves: DataFrame, fanout: int = 2) -> DataFrame:
    """(g, n, level, first, hash): all nodes of each group's tree, from leaves (g, n, first, hash)."""
    run = lambda batches: mountains(batches, fanout)
    nodes = leaves.select("g", "n", F.lit(0).alias("level"), "first", "hash").sortWithinPartitions("g", "first")
    done = []
    for r in range(1, 65):
        at = written(nodes.mapInPandas(run, NODE + ", open boolean"), "nodes")
        done.append(at.filter("not open").drop("open"))
        left = at.filter("open").drop("open")
        if left.isEmpty():
            break
        tile = F.expr(f"`first` div {min(fanout ** (TILE * r), (1 << 63) - 1)}L")
        nodes = left.repartition("g", tile).sortWithinPartitions("g", "first")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def tile_proofs(nodes: DataFrame, fanout: int = 2) -> DataFrame:
    """(g, t, at, up, top, path): for each leaf `at` of a tile of layer t its siblings within the tile, and the tile's place.

    path has for each level the siblings to the left, `|`, those to the right, and `;`. top: the tile holds the root.
    """

    def run(batches):
        for frame in by_key(batches, ("g", "t", "up")):
            out = []
            for (g, t, up), d in frame.groupby(["g", "t", "up"], sort=False):
                size = levels(d["n"].iloc[0], fanout)
                base, top = t * TILE, min((t + 1) * TILE, len(size) - 1)
                known = {(level, first // fanout**level): h for level, first, h in zip(d["level"], d["first"], d["hash"])}
                below: dict[tuple[int, int], str] = {}  # the path from a node to the tile's root
                for level in range(top, base, -1):
                    for i in [i for at, i in known if at == level] if level < (t + 1) * TILE else [up]:
                        rest = below.get((level, i), "")
                        kids = range(i * fanout, min((i + 1) * fanout, size[level - 1]))
                        run = [known[level - 1, k] for k in kids]
                        for x, k in enumerate(kids):
                            below[level - 1, k] = f"{''.join(run[:x])}|{''.join(run[x + 1 :])};{rest}"
                is_top = len(size) - 1 < (t + 1) * TILE
                out += [(g, t, i, up, is_top, below.get((level, i), "")) for level, i in known if level == base]
            yield pd.DataFrame(out, columns=["g", "t", "at", "up", "top", "path"])

    t = F.expr(f"level div {TILE}")
    span = F.element_at(F.array(*(F.lit(min(fanout ** (TILE * (k + 1)), (1 << 63) - 1)) for k in range(64 // TILE + 1))), t.cast("int") + 1)
    d = nodes.select("*", t.cast("int").alias("t"), span.alias("span")).selectExpr("g", "n", "level", "`first`", "hash", "t", "`first` div span as up")
    d = d.repartition("g", "t", "up").sortWithinPartitions("g", "t", "up")
    return d.mapInPandas(run, "g string, t int, at long, up long, top boolean, path string")


def roots(nodes: DataFrame) -> DataFrame:
    """(g, n, hash) of each group's root: its one node of the highest level."""
    return nodes.groupBy("g").agg(F.first("n").alias("n"), F.max_by("hash", "level").alias("hash"))


def paths(nodes: DataFrame, fanout: int = 2, above: DataFrame | None = None) -> DataFrame:
    """(g, first, path, ...) of each leaf, from node records; above: (g, path, ...) follows at the root of each group, its other columns are handed down."""
    p = written(tile_proofs(nodes, fanout), "tile-proofs")
    most = p.agg(F.max("t")).first()[0] or 0
    more = [c for c in above.columns if c not in ("g", "path")] if above is not None else []
    out = None
    for t in range(most, -1, -1):
        d = p.filter(F.col("t") == t)
        if above is not None:
            tops = d.filter("top").join(above.withColumnRenamed("path", "rest"), "g").select("g", "at", "up", F.concat("path", "rest").alias("path"), *more)
        else:
            tops = d.filter("top").select("g", "at", "up", "path")
        if out is None:
            out = tops
        else:
            parent = out.select("g", F.col("at").alias("up"), F.col("path").alias("rest"), *more)
            out = tops.union(d.filter("not top").join(parent, ["g", "up"]).select("g", "at", "up", F.concat("path", "rest").alias("path"), *more))
    return out.select("g", F.col("at").alias("first"), "path", *more)


def proof(path: Column) -> Column:
    """All siblings of a path, level by level and left to right."""
    return F.regexp_replace(path, "[|;]", "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    steps = F.filter(F.split(path, ";"), lambda x: x != "")
    return F.aggregate(steps, leaf, lambda h, x: F.sha2(F.concat(F.split_part(x, F.lit("|"), F.lit(1)), h, F.split_part(x, F.lit("|"), F.lit(2))), 256))


def manifest(leaves: DataFrame, fanout: int = 2) -> DataFrame:
    """Leaves (g, id, hash, ...), g and hash never null: the rows with subroot (of g), root (of all g in order) and path."""
    kept = [c for c in leaves.columns if c not in ("g", "hash")]
    d = written(leaves.withColumn("u", F.monotonically_increasing_id()), "leaves")
    d = written(indexed(d, kept[0]), "indexed-leaves")
    nodes = written(node_records(d, fanout), "node-records")
    subroots = roots(nodes)
    # The groups' roots are leaves of one more tree, by the same steps.
    tops = subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "hash", F.lit(0).alias("u"))
    tops = written(indexed(tops, "of"), "subroots")
    top_nodes = written(node_records(tops, fanout), "top-records")
    top_paths = paths(top_nodes, fanout, roots(top_nodes).select("g", F.lit("").alias("path"), F.col("hash").alias("root")))
    above = tops.join(top_paths, ["g", "first"]).select(F.col("of").alias("g"), "path", F.col("hash").alias("subroot"), "root")
    p = paths(nodes, fanout, written(above, "subroot-paths"))
    return d.join(p, ["g", "first"]).select("g", *kept, "hash", "subroot", "root", "path")


def verified(docs: DataFrame, id_col: str = "doc_id", group: str = "lang", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), count: str = "n_chars", every: int = 7, fanout: int = 2) -> DataFrame:
    """(id, leaf, subroot, root, path, folded_root, verified), a row per row of docs.

    The proofs are tried on a copy of docs in which `count` is one more where `every` divides the CRC-32 of the decimal id.
    """
    broken = F.coalesce(F.crc32(F.col(id_col).cast("string")) % every == 0, F.lit(False))
    more = (F.col(count).cast("decimal(20,0)") + 1).cast("string")
    own = {c: F.col(c) for c in columns}
    both = F.struct(digest(*own.values()).alias("leaf"), F.when(broken & F.col(count).isNotNull(), digest(*(own | {count: more}).values())).alias("other"))
    d = docs.select(group_key(F.col(group)).alias("g"), F.col(id_col).alias("id"), both.alias("x")).select("g", "id", F.col("x.leaf").alias("hash"), F.col("x.other").alias("other"))
    m = manifest(d, fanout).withColumn("folded_root", folded(F.coalesce("other", "hash"), F.col("path")))
    return m.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql() -> str:
    """The query of operator 13 at a fanout of two: levels by recursion, proofs by a join on each level's siblings."""
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    whole = lambda n: " || ".join(part(c) for c in ("doc_id", "source", "lang", n, "text"))
    tree = lambda name, base: f"""{name} AS (
  SELECT g, 0 AS level, idx, hash, n FROM {base}
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, level, n, idx // 2)"""  # noqa: E731
    steps = lambda tree: f"""
  SELECT l.g, l.idx, list(CASE WHEN (l.idx >> k.level) % 2 = 1 THEN s.hash || '|' ELSE '|' || coalesce(s.hash, '') END ORDER BY k.level) AS steps
  FROM (SELECT g, idx FROM {tree} WHERE level = 0) l JOIN (SELECT DISTINCT g, level, n FROM {tree} WHERE n > 1) k ON k.g = l.g
  LEFT JOIN {tree} s ON s.g = k.g AND s.level = k.level AND s.idx = xor(l.idx >> k.level, 1) GROUP BY l.g, l.idx"""  # noqa: E731
    return f"""WITH RECURSIVE
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({whole("n_chars")}) AS leaf, sha256({whole("(n_chars::hugeint + 1)")}) AS other,
    xor(list_reduce(list_prepend(4294967295, flatten([[(ascii((doc_id::varchar)[i]) >> b) & 1 FOR b IN range(8)] FOR i IN range(1, length(doc_id::varchar) + 1)])),
      lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS broken
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n, leaf AS hash FROM hashed),
{tree("nodes", "leaves")},
subroots AS (SELECT '' AS g, g AS of, hash, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
{tree("tops", "subroots")},
low AS ({steps("nodes")}),
high AS ({steps("tops")}),
paths AS (
  SELECT d.doc_id, d.leaf, CASE WHEN d.broken THEN d.other ELSE d.leaf END AS tried, s.hash AS subroot, (SELECT hash FROM tops WHERE n = 1) AS root,
    list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM leaves d JOIN subroots s ON s.of = d.g LEFT JOIN low ON low.g = d.g AND low.idx = d.idx LEFT JOIN high ON high.idx = s.idx),
folded AS (
  SELECT *, list_reduce(list_prepend(tried, steps), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
