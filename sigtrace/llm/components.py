"""Consolidating pairwise matches into groups: connected components by hash-to-min.

Every vertex holds a cluster, at first itself and its neighbours. In each round
it sends its cluster to the cluster's smallest member and that member to all
others of the cluster; what a vertex receives is its new cluster. When nothing
changes any more, the smallest vertex of each component holds all of it and every
other vertex holds just the smallest. Clusters are rows (vertex, member), so even
one with a third of all vertices is spread over tasks.

Vertices are numbered in the order of their texts once, and rounds work on
BIGINT pairs alone. Each round is written to the run's shared folder, so a lost
executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sigtrace.operators.skew import hot_size, join_hot
from sigtrace.sources.shared import RunFolder

ROUNDS = 200
SETTLE = 4  # rounds after which finished components leave the work, again and again


def uuid_key(c: Column) -> Column:
    """A UUID however written as 32 lower-case hexadecimal digits; null for anything else."""
    t = F.translate(F.lower(F.trim(c.cast("string"))), "{}-", "")
    bare = F.when(t.startswith("urn:uuid:"), F.substring(t, 10, 64)).otherwise(t)
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def text_key(c: Column) -> Column:
    """``uuid_key``, or the trimmed text of an id that is no UUID; null for null and blank ones."""
    return F.coalesce(uuid_key(c), F.nullif(F.trim(c.cast("string")), F.lit("")))


def dashed(c: Column) -> Column:
    """A ``text_key`` as it is usually written."""
    return F.regexp_replace(c, "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$", "$1-$2-$3-$4-$5")


def numbered(ids: DataFrame, folder: RunFolder) -> DataFrame:
    """``id, n``: distinct ids with BIGINT numbers in the order of the ids, written once so that the numbers stay."""
    ranked = ids.distinct().repartitionByRange("id").sortWithinPartitions("id")
    return folder.write(ranked.withColumn("n", F.monotonically_increasing_id()), "numbers")


def settled(pairs: DataFrame, folder: RunFolder, k: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Components that can change no more, as ``v, m``, and the pairs of all others.

    Pairs come in both directions. So if the root of n vertices holds n, itself
    among them, and all others hold just the root, nobody else holds any of them.
    """
    vertices = folder.write(pairs.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("size")), f"vertices{k}")
    of_root = vertices.groupBy("m").agg(F.count("*").alias("n"), F.count_if((F.col("v") != F.col("m")) & (F.col("size") == 1)).alias("single"), F.max(F.when(F.col("v") == F.col("m"), F.col("size"))).alias("held"))
    of_root = of_root.select("m", F.col("n").alias("size"), ((F.col("held") == F.col("n")) & (F.col("single") == F.col("n") - 1)).alias("done"))
    known = folder.write(join_hot(vertices.select("v", "m", F.col("size").alias("members")), of_root, "m", "done", "v", hot), f"known{k}")
    still = known.filter("not coalesce(done, false)").select("v", F.col("members").alias("size"), F.lit(True).alias("on"))
    left = folder.write(join_hot(pairs, still, "v", "on", "u", hot).filter("on").select("v", "u"), f"left{k}")
    folder.drop(f"vertices{k}")
    return known.filter("done").select("v", "m"), left


def hash_to_min(edges: DataFrame, folder: RunFolder) -> DataFrame:
    """``v, m``: each vertex of the BIGINT pairs ``a, b`` with the smallest vertex of its component.

    Pairs may repeat, in either direction; pairs of one vertex make it a
    component of its own. No pairs give no rows. Every SETTLE rounds the
    components that are done leave the work, so long chains alone go on. Rounds
    grow with the logarithm of the longest chain; beyond ROUNDS it raises.
    """
    e = edges.select("a", "b").filter("a is not null and b is not null")
    both = e.unionAll(e.select("b", "a")).toDF("v", "u")
    start = Observation()
    pairs, name = folder.write(both.unionAll(both.select("v", F.col("v").alias("u"))).distinct().observe(start, F.count("*").alias("n")), "round0"), "round0"
    before, done, hot = None, [], hot_size(start.get["n"])
    for k in range(1, ROUNDS + 1):
        least = pairs.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("size"))
        known = join_hot(pairs, least, "v", "m", "u", hot)
        sent = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        state = Observation()
        new = known.select(sent.alias("s")).select("s.*").distinct()
        pairs = folder.write(new.observe(state, F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("b")), f"round{k}")
        folder.drop(name)
        name = f"round{k}"
        now = state.get
        if now == before or not now["n"]:
            break
        before, hot = now, hot_size(now["n"])
        if k % SETTLE == 0:
            found, pairs = settled(pairs, folder, k, hot)
            done.append(found)
            folder.drop(name)
            name, before = f"left{k}", None
    else:
        raise RuntimeError(f"not stable after {ROUNDS} rounds")
    out = pairs.groupBy("v").agg(F.min("u").alias("m"))
    for found in done:
        out = out.unionByName(found)
    return out


def connected_groups(links: DataFrame, left: str, right: str, known: DataFrame | None = None, key=None, singles: bool = False) -> DataFrame:
    """``group_id, id``: the vertices linked to at least one other, with the smallest id text of their group.

    ``key`` maps an id column to its canonical text (default: as it stands);
    ``known`` is a table of one column of the ids that exist: links with another
    or a null id are left out. With ``singles`` known ids without a link come
    out too, each a group of its own, so every known id that is not null has one
    row. Links of one id with itself, repeated links and their direction make no
    difference.
    """
    folder = RunFolder(links.sparkSession, "groups")
    key = key or (lambda c: c.cast("string"))
    pairs = links.select(key(F.col(left)).alias("x"), key(F.col(right)).alias("y")).filter("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    count = Observation()
    pairs = folder.write(pairs.observe(count, F.count("*").alias("n")), "pairs")
    hot = hot_size(count.get["n"])
    ids = pairs.select(F.col("x").alias("id")).unionAll(pairs.select("y"))
    there = None
    if known is not None:
        there = known.select(key(known[known.columns[0]]).alias("id")).filter("id is not null").distinct()
        there = folder.write(there, "known") if singles else there
        ids = ids.distinct().join(there, "id", "left_semi")
    numbers = numbered(ids, folder)
    edges = join_hot(pairs, numbers.toDF("x", "a"), "x", "a", "y", hot)
    edges = join_hot(edges, numbers.toDF("y", "b"), "y", "b", "x", hot).filter("a is not null and b is not null")
    groups = folder.write(hash_to_min(folder.write(edges.select("a", "b"), "edges"), folder), "groups")
    sizes = groups.groupBy("m").agg(F.count("*").alias("size"))
    roots = folder.write(sizes.join(numbers.withColumnRenamed("n", "m"), "m").select("m", "size", F.col("id").alias("group_id")), "roots")
    named = join_hot(groups, roots, "m", "group_id", "v", hot)
    out = named.join(numbers.withColumnRenamed("n", "v"), "v").select("group_id", "id")
    if singles and there is not None:
        out = there.join(out, "id", "left").select(F.coalesce("group_id", "id").alias("group_id"), "id")
    return out
