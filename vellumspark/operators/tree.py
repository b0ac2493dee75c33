"""Hierarchies as adjacency lists, of any depth: paths to the root are closed by doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumspark.functions import lang
from vellumspark.operators.filters import READABLE
from vellumspark.staging import staged


def rooted(nodes: DataFrame, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with `steps`, their path from the root down; and the nodes that reach no root, with error orphan or cycle.

    A node knows the path up to some ancestor; in a round it takes that ancestor's path before its own, so a tree of depth d
    needs log2(d) rounds of one equi-join each. A path that meets a node twice lies in or under a cycle; one that leads to
    an id that is no node (or to such a path) is an orphan. A step has the id and whichever of title, ord, skip and kind
    nodes have; parents and children meet within the columns of scope.
    """
    scope = scope or []
    step = F.struct(*(c for c in ("node_id", "title", "ord", "skip", "kind") if c in nodes.columns))
    begun = nodes.select(*scope, "node_id", F.col("parent_id").alias("_up"), F.array(step).alias("steps"), F.lit(None).cast("string").alias("error"))
    open_ = staged(begun, "paths")
    ended = [open_.where("_up is null")]
    open_ = open_.where("_up is not null")
    while not open_.isEmpty():
        above = reduce(DataFrame.unionByName, [*ended, open_])
        above = above.select(*scope, F.col("node_id").alias("_up"), F.col("_up").alias("_next"), F.col("steps").alias("_above"), F.col("error").alias("_error"), F.lit(True).alias("_met"))
        steps = F.concat("_above", "steps")
        ids = steps["node_id"]
        error = F.when(F.col("_met").isNull(), "orphan").when(F.col("_error").isNotNull(), F.col("_error")).when(F.size(F.array_distinct(ids)) < F.size(ids), "cycle")
        longer = open_.join(above, [*scope, "_up"], "left").select(*scope, "node_id", F.col("_next").alias("_up"), steps.alias("steps"), error.alias("error"))
        longer = staged(longer, "paths")
        ended.append(longer.where("_up is null or error is not null"))
        open_ = longer.where("_up is not null and error is null")
    every = reduce(DataFrame.unionByName, ended)
    good = nodes.join(every.where("error is null").select(*scope, "node_id", "steps"), [*scope, "node_id"])
    return good, every.where("error is not null").select(*scope, "node_id", "error")


def _described(good: DataFrame) -> DataFrame:
    """Nodes with steps as with_paths gives them."""

    def step(s):
        return F.lpad(s["ord"].cast("string"), 10, "0")

    out = good.withColumn("ids", F.col("steps.node_id"))
    if "title" in good.columns:
        out = out.withColumn("titles", F.col("steps.title"))
    if "ord" in good.columns:
        out = out.withColumn("path", F.array_join(F.transform("steps", step), "/"))
    if "skip" in good.columns:
        out = out.withColumn("hidden", F.exists("steps", lambda s: s["skip"]))
    return out


def with_paths(nodes: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Nodes that reach a root, with steps, ids, titles and sort path from the root down, and whether any node on the path is skipped.

    Nodes that have these columns already are given back as they are. tree_errors lists the nodes left out.
    """
    return nodes if "steps" in nodes.columns else _described(rooted(nodes, scope)[0])


def tree_errors(nodes: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Nodes that reach no root: node_id and error, orphan (an id above is no node) or cycle."""
    return rooted(nodes, scope)[1]


def effective_skip(nodes: DataFrame) -> DataFrame:
    return with_paths(nodes).select("node_id", F.col("hidden").alias("skip"))


def closure(nodes: DataFrame) -> DataFrame:
    """Every ancestor of a node, itself at distance 0, without passing a skipped child: ancestor, node, distance."""
    # The way from a node up to an ancestor is free down to the deepest skipped node of its path, which may be that ancestor.
    last = F.size("steps") - 1
    deepest = F.array_max(F.transform("steps", lambda s, i: F.when(s["skip"], i).otherwise(0)))
    p = with_paths(nodes).select(F.col("node_id").alias("node"), last.alias("last"), deepest.alias("deepest"), "ids")
    each = p.select("node", "last", "deepest", F.posexplode(F.slice("ids", F.col("deepest") + 1, F.col("last") - F.col("deepest") + 1)).alias("at", "ancestor"))
    return each.select("ancestor", "node", (F.col("last") - F.col("deepest") - F.col("at")).alias("distance"))


def chapter_of(nodes: DataFrame) -> DataFrame:
    """Nearest chapter at or above a node, and its root."""
    chapters = F.filter("steps", lambda s: s["kind"] == "chapter")
    return with_paths(nodes).select("node_id", F.try_element_at(chapters, F.lit(-1))["node_id"].alias("chapter"), F.col("ids")[0].alias("root"))


def document_order(nodes: DataFrame, book: str | None = None) -> DataFrame:
    """Pre-order position by sort path, numbered per book; without a book column per root with the root's path ahead."""
    p = with_paths(nodes).withColumn("root", F.col("ids")[0])
    w = Window.partitionBy(book or "root").orderBy("path")
    return p.withColumn("pos", F.row_number().over(w))


def location_path(nodes: DataFrame) -> DataFrame:
    """Titles from the root to a node, chapter introductions left out."""
    p = with_paths(nodes)
    own = F.when(F.col("kind") == "chapter_intro", F.slice("titles", F.lit(1), F.size("titles") - 1)).otherwise(F.col("titles"))
    return p.select("node_id", own.alias("location"))


def _readable(p: DataFrame, nodes: DataFrame) -> DataFrame:
    parents = nodes.where("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct().withColumn("_c", F.lit(True))
    r = p.join(parents, "node_id", "left")
    return r.withColumn("readable", ~F.col("skip") & (F.col("kind").isin(*READABLE) | (F.col("kind").isin("chapter", "part") & F.col("_c").isNull()))).drop("_c")


def first_readable(nodes: DataFrame) -> DataFrame:
    """First readable node at or below each node in document order: node_id, target."""
    r = _readable(with_paths(nodes), nodes).where("readable")
    up = r.select(F.col("node_id").alias("target"), "path", F.explode("ids").alias("node_id"))
    return up.groupBy("node_id").agg(F.min_by("target", "path").alias("target"))


def node_status(nodes: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Status of a subtree: needs_review before final before waiting_agent before not_started before in_progress.

    Segments (segment_id, node_id) are translatable ones; a subtree without any is final.
    """
    s = segments.join(translations.select("segment_id", "status", "engine"), "segment_id", "left")
    c = closure(nodes).join(s.withColumnRenamed("node_id", "node"), "node")
    a = c.groupBy(F.col("ancestor").alias("node_id")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "flagged").alias("flagged"),
        F.count_if(F.col("status").isin(*lang.DONE, "skipped")).alias("done"),
        F.count_if((F.col("status") == "queued") & (F.col("engine") == "agent")).alias("waiting"),
        F.count_if(F.col("status").isNotNull() & (F.col("status") != "pending")).alias("started"),
    )
    status = F.when(F.col("n").isNull(), "final").when(F.col("flagged") > 0, "needs_review").when(F.col("done") == F.col("n"), "final").when(F.col("waiting") > 0, "waiting_agent").when(F.col("started") == 0, "not_started").otherwise("in_progress")
    return nodes.select("node_id").join(a, "node_id", "left").select("node_id", status.alias("status"))


def chapter_progress(nodes: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Finished, all and flagged segments of every top-level node that has any."""
    p = with_paths(nodes).where("not hidden").select("node_id", F.col("ids")[0].alias("root"))
    j = segments.join(p, "node_id").join(translations.select("segment_id", "status"), "segment_id", "left")
    return j.groupBy("root").agg(F.count_if(F.col("status").isin(*lang.DONE)).alias("done"), F.count("*").alias("total"), F.count_if(F.col("status") == "flagged").alias("flagged"))


def toc_rows(nodes: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Entries of the table of contents that are not skipped, in document order by path, with status and target."""
    nodes = with_paths(nodes)
    p = document_order(nodes).where("not hidden").select("node_id", "title", "depth", "root", "path", "pos")
    return p.join(node_status(nodes, segments, translations), "node_id").join(first_readable(nodes), "node_id", "left")


def toc_sample(nodes: DataFrame, n: int = 120) -> DataFrame:
    """The first n titles of each root in document order, indented by depth."""
    return document_order(nodes).where(F.col("pos") <= n).select("root", "pos", F.concat(F.expr("repeat('  ', depth)"), "title").alias("line"))


def section_rows(nodes: DataFrame, segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Bilingual rows of readable nodes in order: paragraph number, visible target, status and neighbours of the node."""
    from vellumspark.operators.windows import paragraph_numbers, prev_next

    r = _readable(document_order(nodes), nodes).where("readable")
    nav = prev_next(r.select("node_id", "root", "path", F.col("ids")[F.least(F.lit(1), F.size("ids") - 1)].alias("chapter")), "root", ["path"], "chapter")
    seen = translations.select("segment_id", "status", F.when(F.col("status").isin(*lang.VISIBLE), F.coalesce("final", "draft")).alias("tgt"))
    return paragraph_numbers(segments, "node_id", "ord").join(seen, "segment_id", "left").join(nav.select("node_id", "prev", "next"), "node_id")


def apply_structure_ops(nodes: DataFrame, segments: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One edit a book and pass: rename, skip, promote, demote, merge_prev, merge_next, split. Nodes, segments, errors.

    nodes have book, node_id, parent_id, ord, depth, kind, title, skip; ops have book, op, node_id, value. A promoted node
    takes its later siblings as children; a demoted one goes under the sibling before; merging moves segments and children;
    a split starts a new node "<id>'" at the segment named by value. Segment ids stay. ord is numbered anew. Errors name the
    edits that cannot be made, and nodes that reach no root (op orphan or cycle), which no tree can hold.
    """
    o = ops.join(nodes.select("book", "node_id", F.col("parent_id").alias("p"), F.col("ord").alias("o"), F.col("depth").alias("dp")), ["book", "node_id"], "left")
    sib = nodes.select("book", F.col("parent_id").alias("p"), F.col("node_id").alias("s"), F.col("ord").alias("so"))
    same = F.col("p").eqNullSafe(F.col("sp"))
    j = o.join(sib.withColumnsRenamed({"p": "sp", "book": "sb"}), (F.col("book") == F.col("sb")) & same, "left")
    near = j.groupBy("book", "op", "node_id", "value", "p", "o", "dp").agg(F.max_by("s", F.when(F.col("so") < F.col("o"), F.col("so"))).alias("before"), F.min_by("s", F.when(F.col("so") > F.col("o"), F.col("so"))).alias("after"))
    parent = nodes.select("book", F.col("node_id").alias("p"), F.col("parent_id").alias("grand"), F.col("ord").alias("po"))
    near = near.join(parent, ["book", "p"], "left")
    first = segments.groupBy("book", "node_id").agg(F.min("ord").alias("first"))
    near = near.join(segments.select("book", "node_id", F.col("segment_id").alias("value"), F.col("ord").alias("at")), ["book", "node_id", "value"], "left").join(first, ["book", "node_id"], "left")
    ok = (
        F.when(F.col("o").isNull(), False).when(F.col("op") == "rename", F.trim("value") != "").when(F.col("op") == "skip", True).when(F.col("op") == "promote", F.col("p").isNotNull())
        .when(F.col("op").isin("demote", "merge_prev"), F.col("before").isNotNull()).when(F.col("op") == "merge_next", F.col("after").isNotNull()).when(F.col("op") == "split", F.col("at").isNotNull() & (F.col("at") > F.col("first")))
    )
    near = near.withColumn("ok", F.coalesce(ok, F.lit(False)))
    errors = near.where("not ok").select("book", "op", "node_id")
    e = near.where("ok").select("book", "op", F.col("node_id").alias("t"), "value", F.col("p").alias("tp"), F.col("o").alias("to"), "before", "after", "grand", "po", "at")
    n = nodes.join(e, "book", "left")
    op, me = F.col("op"), F.col("node_id") == F.col("t")
    gone = F.when(op == "merge_prev", F.col("t")).when(op == "merge_next", F.col("after"))
    into = F.when(op == "merge_prev", F.col("before")).when(op == "merge_next", F.col("t"))
    later = F.col("parent_id").eqNullSafe(F.col("tp")) & (F.col("ord") > F.col("to"))
    new_parent = F.when((op == "promote") & me, F.col("grand")).when((op == "promote") & later, F.col("t")).when((op == "demote") & me, F.col("before")).when(F.col("parent_id") == gone, into).otherwise(F.col("parent_id"))
    half = F.when((op == "promote") & me, F.col("po") + 0.5).when((op == "demote") & me, F.lit(1e9)).when((F.col("parent_id") == gone) & (op == "merge_prev"), F.col("ord") + 1e6).when((F.col("parent_id") == gone) & (op == "merge_next"), F.col("ord") + 1e6).otherwise(F.col("ord").cast("double"))
    kept = n.where(gone.isNull() | (F.col("node_id") != gone))
    moved = kept.select(
        "book", "node_id", new_parent.alias("parent_id"), half.alias("_o"), "kind",
        F.when(me & (op == "rename"), F.trim("value")).otherwise(F.col("title")).alias("title"), F.when(me & (op == "skip"), F.coalesce(F.col("value") != "off", F.lit(True))).otherwise(F.col("skip")).alias("skip"),
    )
    made = n.where(me & (op == "split")).select("book", F.concat("node_id", F.lit("'")).alias("node_id"), "parent_id", (F.col("ord") + 0.5).alias("_o"), "kind", "title", "skip")
    every = moved.unionByName(made)
    ordered = every.withColumn("ord", F.row_number().over(Window.partitionBy("book", "parent_id").orderBy("_o")) - 1).drop("_o")
    # Skipping reaches the whole subtree, depth and kind follow the new places.
    good, lost = rooted(ordered, ["book"])
    out = _described(good).select(*ordered.columns, F.col("hidden"), (F.size("ids") - 1).alias("depth")).withColumn("skip", F.col("hidden")).drop("hidden")
    errors = errors.unionByName(lost.select("book", F.col("error").alias("op"), "node_id"))
    kind = F.when(F.col("kind").isin("front", "back", "part"), F.col("kind")).when(F.col("depth") == 0, "chapter").when(F.col("depth") == 1, "section").otherwise("subsection")
    s = segments.join(e.select("book", "op", "t", "before", "after", "at"), "book", "left")
    back = F.when((op == "merge_prev") & (F.col("node_id") == F.col("t")), F.col("before")).when((op == "merge_next") & (F.col("node_id") == F.col("after")), F.col("t")).when((op == "split") & (F.col("node_id") == F.col("t")) & (F.col("ord") >= F.col("at")), F.concat("t", F.lit("'"))).otherwise(F.col("node_id"))
    shift = F.when(back != F.col("node_id"), 1).otherwise(0)
    s = s.select("book", "segment_id", back.alias("node_id"), shift.alias("_k"), "ord", *[c for c in segments.columns if c not in ("book", "segment_id", "node_id", "ord")])
    s = s.withColumn("ord", F.row_number().over(Window.partitionBy("book", "node_id").orderBy("_k", "ord")) - 1).drop("_k")
    return out.withColumn("kind", kind), s, errors
