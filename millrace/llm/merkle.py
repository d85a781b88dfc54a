"""A Merkle manifest of a dataset, checked by a climb from every leaf.

Rows are leaves, in one tree a source; the roots of these trees are the leaves of a last one. Levels
are built STEP at a time and stored as node rows, each linked to its ancestor so many levels above and
holding, level by level, the digests that stand before and after the way there. A recursive query
climbs along the links from every run of leaves, which have one way from there, and adds a row of siblings at
each step; every leaf is folded through its siblings into the root that follows from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .simhash_dedup import salted_join

#: Consecutive nodes that become one.
RUN = 3
#: Levels from a stored node to the one that it is linked to: the climb's rows are a leaf in RUN to the power of this.
STEP = 3
#: The number of the tree over the sources' roots; sources are numbered from 0.
TOP = -1
#: So many sources are joined by broadcast.
MOST_SOURCES = 100_000
BESIDE = "array<struct<before:binary,after:binary>>"
_LINK = f"beside {BESIDE}, up_tree long, up_level int, up_place long"
NODES = f"tree long, level int, place long, {_LINK}"
LEAVES = f"serial long, tree long, doc_id {{}}, leaf binary, other binary, {_LINK}"


def digest(*parts: Column) -> Column:
    """H: sha256 of the parts (texts) in a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(value: Column) -> Column:
    """Digests as lower-case hex text; none gives an empty one."""
    return F.lower(F.hex(value))


def field(value: Column) -> Column:
    """A leaf's input for one column: its UTF-8 length, a colon and the value, or - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def in_order(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with place (from 0) within its group by order, nulls first, and serial, a number of the row.

    Rows are range-partitioned by group and order, so a group of any size lies over many tasks; a row's place is its
    distance from the first row of its group in the task, plus the group's rows in earlier tasks,
    which are summed over one row a task and group. Rows equal in all of these are told apart as they come.
    """
    keys = [F.asc_nulls_first(c) for c in (group, *order)] + [F.asc("tie")]
    dealt = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop("tie").withColumns({"serial": F.monotonically_increasing_id(), "task": F.spark_partition_id()}), "ordered")
    own = dealt.groupBy(F.col("task").alias("of_task"), F.col(group).alias("of_group")).agg(F.count("*").alias("n"), F.min("serial").alias("from"))
    before = F.sum("n").over(Window.partitionBy("of_group").orderBy("of_task").rowsBetween(Window.unboundedPreceding, -1))
    own = own.select("of_task", "of_group", "from", F.coalesce(before, F.lit(0)).alias("before"))
    on = (F.col("task") == F.col("of_task")) & F.col(group).eqNullSafe(F.col("of_group"))
    return dealt.join(own, on).withColumn("place", F.col("before") + F.col("serial") - F.col("from")).drop("task", "of_task", "of_group", "from", "before")


def _up(level: Column) -> Column:
    """The digests of the level above some consecutive nodes' digests, which begin with a run."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / RUN).cast("int")), lambda k: digest(F.array_join(F.transform(F.slice(level, k * RUN + 1, RUN), as_text), "")))


def _with_levels(runs: DataFrame) -> DataFrame:
    """runs with level_0 to level_STEP: the digests of the members, of the level above, and so on; above a tree's root there is nothing new."""
    out = runs.withColumn("level_0", F.transform("run", lambda x: x["hash"]))
    for k in range(STEP):
        out = out.withColumn(f"level_{k + 1}", F.when(F.col("n") > RUN**k, _up(F.col(f"level_{k}"))).otherwise(F.col(f"level_{k}")))
    return out


def _levels(leaves: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Every STEP-th level above leaves (tree, place, n, hash, and more) and, of each tree, the root.

    n is how many nodes the tree has at the level. A level is a table of runs, (tree, place, n, run): run has the nodes, RUN to
    the power of STEP at most, below the node at place STEP levels above, in order. Both lists hold one table a
    level; most is the largest n.
    """
    width = RUN**STEP
    runs, roots, level = [], [], leaves
    while True:
        roots.append(level.where("n = 1").select("tree", "hash"))
        if most <= 1:
            return runs, roots
        members = F.struct("place", *[c for c in level.columns if c not in ("tree", "place", "n")])
        up = F.floor(F.col("place") / width).alias("place")
        grouped = level.where("n > 1").groupBy("tree", "n", up).agg(F.array_sort(F.collect_list(members)).alias("run"))
        runs.append(written(grouped, "runs"))
        level = _with_levels(runs[-1]).select("tree", "place", F.ceil(F.col("n") / width).alias("n"), F.get(f"level_{STEP}", F.lit(0)).alias("hash"))
        most = -(-most // width)


def _linked(runs: DataFrame, level: int) -> DataFrame:
    """The nodes of a level's runs: beside has the digests before and after the way up, and up_tree, up_level and up_place name where it ends.

    A source's root is named as a leaf of the last tree.
    """

    def beside(k: int) -> Column:
        """Of the k-th level on the way; null where the tree ends below."""
        at = F.floor(F.col("k") / RUN**k).cast("int")
        row, first = F.col(f"level_{k}"), at - at % RUN
        cut = lambda start, count: F.unhex(F.array_join(F.transform(F.slice(row, start, count), as_text), ""))
        return F.when(F.col("n") > RUN**k, F.struct(cut(first + 1, at % RUN).alias("before"), cut(at + 2, RUN - 1 - at % RUN).alias("after")))

    each = _with_levels(runs).select("*", F.posexplode("run").alias("k", "node"))
    done = (F.col("tree") != TOP) & (F.col("n") <= RUN**STEP)
    return each.select(
        "tree",
        F.lit(level).alias("level"),
        "node",
        F.array_compact(F.array(*[beside(k) for k in range(STEP)])).alias("beside"),
        *_parent(F.when(done, TOP).otherwise(F.col("tree")), F.when(done, 0).otherwise(level + 1), F.when(done, F.col("tree")).otherwise(F.col("place"))),
    )


def _parent(tree: Column, level: Column, place: Column) -> list[Column]:
    return [tree.cast("long").alias("up_tree"), level.cast("int").alias("up_level"), place.cast("long").alias("up_place")]


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bytes | None]:
    """Builds the tree over leaves (doc_id, source, leaf, other: a digest that is to be checked, null if it is the leaf).

    Gives tables of LEAVES, of the NODES above them and of (tree, subroot), and the root (None for no leaves).
    A leaf that is alone in its source has no siblings and stands for the source's root.
    """
    spark = leaves.sparkSession
    placed = in_order(leaves, "source", "doc_id", "leaf")
    sizes = written(placed.groupBy("source").agg(F.count("*").alias("n")), "sources")
    sources = written(in_order(sizes.withColumn("all", F.lit(0)), "all", "source").select("source", F.col("place").alias("tree"), "n"), "trees")
    total = sources.agg(F.count("*"), F.max("n")).first()
    if not total[0]:
        kind = dict(leaves.dtypes)["doc_id"]
        return spark.createDataFrame([], LEAVES.format(kind)), spark.createDataFrame([], NODES), spark.createDataFrame([], "tree long, subroot binary"), None
    named = sources.withColumnRenamed("source", "of_source")
    on = F.col("source").eqNullSafe(F.col("of_source"))
    few = total[0] <= MOST_SOURCES
    first = placed.join(F.broadcast(named), on) if few else _dealt(placed, named)
    first = written(first.select("tree", "place", "n", F.col("leaf").alias("hash"), "serial", "doc_id", "other"), "leaves")
    runs, roots = _levels(first, total[1])
    subroots = roots[0]
    for more in roots[1:]:
        subroots = subroots.unionByName(more)
    subroots = written(subroots.select("tree", F.col("hash").alias("subroot")), "subroots")
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(total[0]).cast("long").alias("n"), F.col("subroot").alias("hash"))
    top_runs, top_roots = _levels(top, total[0])
    root = bytes(top_roots[-1].first()["hash"])

    up = ["beside", "up_tree", "up_level", "up_place"]
    bottom = first.where("n = 1").select("serial", "tree", "doc_id", F.col("hash").alias("leaf"), "other", F.array().cast(BESIDE).alias("beside"), *_parent(F.lit(TOP), F.lit(0), F.col("tree")))
    if runs:
        linked = _linked(runs[0], 0)
        bottom = linked.select("node.serial", "tree", "node.doc_id", F.col("node.hash").alias("leaf"), "node.other", *up).unionByName(bottom)
    above = [_linked(r, k) for k, r in enumerate(runs) if k] + [_linked(r, k) for k, r in enumerate(top_runs)]
    nodes = spark.createDataFrame([], NODES)
    for level in above:
        nodes = nodes.unionByName(level.select("tree", "level", F.col("node.place").alias("place"), *up))
    out = written(bottom, "bottom"), written(nodes, "nodes"), subroots, root
    discard(first, *runs, *top_runs)
    return out


def _dealt(placed: DataFrame, named: DataFrame) -> DataFrame:
    """placed with its source's tree and n, where sources are too many to broadcast; a large source is dealt over several places."""
    key = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"))
    right = named.withColumn("source", F.col("of_source")).withColumn("key", key).drop("source", "of_source")
    return salted_join(placed.withColumn("key", key), right, "key", "serial").drop("key")


CLIMB = f"""
WITH RECURSIVE climb (way_tree, way_level, way_place, step, beside, tree, level, place) AS (
  SELECT up_tree, up_level, up_place, 0, CAST(NULL AS {BESIDE}), up_tree, up_level, up_place FROM {{ways}}
  UNION ALL
  SELECT c.way_tree, c.way_level, c.way_place, c.step + 1, n.beside, n.up_tree, n.up_level, n.up_place
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.place = n.place
)
SELECT way_tree, way_level, way_place, step, beside FROM climb
"""
_FOLD = "aggregate(way, coalesce(other, leaf), (x, b) -> unhex(sha2(concat(lower(hex(b.before)), lower(hex(x)), lower(hex(b.after))), 256)))"


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """serial, tree, doc_id, leaf, proof (sha256 of all digests beside the way to the root) and found (the digest that the leaf, or other, folds into).

    Leaves of one run have one way above it, so the recursive query climbs once a run and gives a row a run and step: the
    siblings of that step. It is run and its result written here, without Spark's limit on the rows of a recursion, which
    is put back. Each leaf is folded through its own siblings and its run's where the two meet.
    """
    spark = leaves.sparkSession
    up = ["up_tree", "up_level", "up_place"]
    ways = written(leaves.select(*up).distinct(), "ways")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        rows = spark.sql(CLIMB, ways=ways, nodes=nodes)
        steps = F.array_sort(F.collect_list(F.struct("step", F.coalesce("beside", F.array().cast(BESIDE)).alias("beside"))))
        above = rows.groupBy(*[F.col(f"way_{c[3:]}").alias(c) for c in up]).agg(steps.alias("steps"))
        above = written(above.select(*up, F.flatten("steps.beside").alias("above")), "climbed")
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)
    whole = leaves.join(above, up).withColumn("way", F.concat("beside", "above"))
    digests = F.flatten(F.transform("way", lambda b: F.array(b["before"], b["after"])))
    proof = F.sha2(F.array_join(F.transform(digests, as_text), ""), 256)
    return whole.select("serial", "tree", "doc_id", "leaf", proof.alias("proof"), F.expr(_FOLD).alias("found"))


def verify(df: DataFrame, identifier: str = "doc_id", source: str = "source", leaf: Column | None = None, other: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of df.

    leaf is the digest of a row (document_leaf()), other one to be folded in its place where it is not null. A source's leaves
    stand in the order of their identifiers (null first, equal ones by digest, equal rows as they come),
    sources in the order of their UTF-8 bytes, null first. Every row is a leaf, repeated ones too;
    other columns are not read but by leaf and other; an empty table gives no rows.
    """
    own = df.select(F.col(identifier).alias("doc_id"), F.col(source).alias("source"), leaf.alias("leaf"), (F.lit(None).cast("binary") if other is None else other).alias("other"))
    leaves, nodes, subroots, root = manifest(own)
    named = climb(leaves, nodes)
    few = subroots.count() <= MOST_SOURCES
    named = named.join(F.broadcast(subroots), "tree") if few else salted_join(named, subroots, "tree", "serial")
    top = F.lit(root.hex() if root else None).cast("string")
    return named.select(
        F.col("doc_id").alias(identifier),
        as_text(F.col("leaf")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"),
        top.alias("root"),
        F.col("proof").alias("proof_sha256"),
        as_text(F.col("found")).alias("folded_root"),
        (as_text(F.col("found")) == top).alias("verified"),
    )


def document_leaf(text: Column | None = None) -> Column:
    """The digest of a document's doc_id, source, lang, n_chars and text."""
    return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(F.col("text") if text is None else text))


def tampered_leaf() -> Column:
    """document_leaf() without the text's newlines, of documents whose identifier's crc32 is even; null for others."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(chosen, document_leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
