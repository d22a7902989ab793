"""Queries over chunk trees: descendants, children, siblings, edits, pages, components and the references between them.

A chunk table has the columns of `sources.containers.CHUNKS` without `error`. Trees are pre-order intervals, so that a
subtree is a range of node ids and no query recurses.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafquarry.functions import binary, jvm

COMPONENT = "ord int, offset long, size int, id string, name string, title string, kind string, bundled boolean, version int"
#: Components of a document are few; a table of them is broadcast below this size, by the statistics that AQE has at run time.
FORMS = ("DJVU", "DJVI", "THUM", "PM44", "BM44")


# trees


def descendants(tree: DataFrame, kinds: list[str] | None, node: int = 0, doc: str = "doc_id", kind: str = "chunk_type") -> DataFrame:
    """Nodes below `node` of each document in file order, of the given kinds (None: all)."""
    top = tree.filter(F.col("node_id") == node).select(F.col(doc).alias("_d"), F.col("node_id").alias("_lo"), F.col("subtree_end").alias("_hi"))
    out = tree.join(top, (F.col(doc) == F.col("_d")) & (F.col("node_id") > F.col("_lo")) & (F.col("node_id") <= F.col("_hi"))).drop("_d", "_lo", "_hi")
    return out if kinds is None else out.filter(F.col(kind).isin(kinds))


def root_children(tree: DataFrame, kinds: list[str]) -> DataFrame:
    """Children of the root form by kind; of a document of one page, the root itself."""
    return tree.filter(F.col("chunk_type").isin(kinds) & ((F.col("parent_id") == 0) | F.col("parent_id").isNull()))


def first_child(tree: DataFrame, kind: str, by: list[str], order: str, kind_column: str = "chunk_type", *values: str) -> DataFrame:
    """For each parent (columns `by`) the first child of a kind in order, with the given values: an aggregate, no sort."""
    return tree.filter(F.col(kind_column) == kind).groupBy(*by).agg(F.min_by(F.struct(order, *values), order).alias("f")).select(*by, "f.*")


def siblings(tree: DataFrame, parent: list[str], node: str, order: str = "ord") -> DataFrame:
    """tree with first, last, previous and next sibling of each node."""
    w = Window.partitionBy(*parent).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return tree.select("*", F.first(node).over(whole).alias("first_sibling"), F.last(node).over(whole).alias("last_sibling"), F.lag(node).over(w).alias("previous_sibling"), F.lead(node).over(w).alias("next_sibling"))


def subtree_counts(tree: DataFrame) -> DataFrame:
    """tree with the number of nodes below each node."""
    return tree.select("*", (F.col("subtree_end") - F.col("node_id")).alias("n_below"))


def preorder(levels: list[DataFrame]) -> DataFrame:
    """Interval numbers for a tree given by levels of (key, parent_key), keys ordered and unique in a level.

    Subtree sizes go up, places go down: two joins and a window for each level, no recursion. Gives (level, key,
    parent_key, node_id, subtree_end, path); node ids count from 0 within each root's tree (`root` is its key), path has the keys of
    a node's ancestors by level and its own.
    """
    sized = [None] * len(levels)
    for k in range(len(levels) - 1, -1, -1):
        one = F.lit(1).cast("long")
        if k == len(levels) - 1:
            sized[k] = levels[k].select("key", "parent_key", one.alias("size"))
        else:
            below = sized[k + 1].groupBy("parent_key").agg(F.sum("size").alias("s")).withColumnRenamed("parent_key", "key")
            sized[k] = levels[k].join(below, "key", "left").select("key", "parent_key", (one + F.coalesce("s", F.lit(0))).alias("size"))
    placed = [sized[0].select(F.col("key").alias("root"), "key", "parent_key", F.lit(0).cast("long").alias("node_id"), "size", F.array("key").alias("path"))]
    for k in range(1, len(levels)):
        before = F.coalesce(F.sum("size").over(Window.partitionBy("parent_key").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        up = placed[k - 1].select("root", F.col("key").alias("parent_key"), F.col("node_id").alias("up"), "path")
        placed.append(sized[k].withColumn("before", before).join(up, "parent_key").select("root", "key", "parent_key", (F.col("up") + 1 + F.col("before")).alias("node_id"), "size", F.concat("path", F.array("key")).alias("path")))
    rows = [p.select(F.lit(k).alias("level"), "root", "key", "parent_key", "node_id", (F.col("node_id") + F.col("size") - 1).alias("subtree_end"), "path") for k, p in enumerate(placed)]
    return reduce(DataFrame.unionByName, rows)


# edits of child lists


def _renumber(rows: DataFrame, parent: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)) - 1)


def add_children(rows: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """New children behind the others of their parents."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return _renumber(both, parent, [F.col("_new"), F.col("ord")]).drop("_new")


def insert_children(rows: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """New children at their `ord`, those from there on behind them."""
    both = rows.withColumn("_new", F.lit(1)).unionByName(new.withColumn("_new", F.lit(0)))
    return _renumber(both, parent, [F.col("ord"), F.col("_new")]).drop("_new")


def remove_children(rows: DataFrame, gone: DataFrame, on: list[str], parent: list[str]) -> DataFrame:
    return _renumber(rows.join(gone.select(*on).distinct(), on, "left_anti"), parent, [F.col("ord")])


def clear_children(rows: DataFrame, parents: DataFrame, parent: list[str]) -> DataFrame:
    return rows.join(parents.select(*parent).distinct(), parent, "left_anti")


def contains_children(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """wanted with `present`: whether a row of equal `on` is there."""
    return wanted.join(rows.select(*on).distinct().withColumn("present", F.lit(True)), on, "left").withColumn("present", F.coalesce("present", F.lit(False)))


# pages and components


def _is_page() -> Column:
    return (F.col("chunk_type") == "DJVU") & ((F.col("parent_id") == 0) | F.col("parent_id").isNull())


def page_forms(chunk_rows: DataFrame) -> DataFrame:
    """Page forms with their number, from 1 in file order."""
    return chunk_rows.filter(_is_page())


def page_chunks(chunk_rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Direct children of pages of the given kinds, with page_no. A filter: the walk has numbered them."""
    return chunk_rows.filter(F.col("chunk_type").isin(kinds) & F.col("page_no").isNotNull() & ~_is_page())


def pages(chunk_rows: DataFrame) -> DataFrame:
    """Pages with the fields of their first INFO chunk, and their place in the file. One pass over the chunks; page forms and INFO chunks alone are shuffled."""
    info = F.col("chunk_type") == "INFO"
    rows = chunk_rows.filter(F.col("page_no").isNotNull() & (_is_page() | info)).select("doc_id", "page_no", "node_id", "node_offset", "ord", "payload", info.alias("is_info"))
    own = lambda c: F.max(F.when(~F.col("is_info"), F.col(c)))
    first = F.min_by(F.when(F.col("is_info"), F.col("payload")), F.when(F.col("is_info"), F.col("ord")))
    forms = rows.groupBy("doc_id", "page_no").agg(own("node_id").alias("form_node_id"), own("node_offset").alias("node_offset"), first.alias("payload"))
    return forms.select("doc_id", "page_no", "form_node_id", "node_offset", *[c.alias(n) for n, c in binary.info_columns(F.col("payload")).items()])


def neighbours(page_rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """page_rows with the pages before and after; at the ends the page itself."""
    w = Window.partitionBy(by).orderBy("page_no")
    return page_rows.select("*", F.coalesce(F.lag("page_no").over(w), "page_no").alias("previous_page"), F.coalesce(F.lead("page_no").over(w), "page_no").alias("next_page"))


def components(chunk_rows: DataFrame) -> DataFrame:
    """Entries of the component directories."""
    entries = jvm.call(chunk_rows, "Directory", f"array<struct<{_fields(COMPONENT)}>>", F.col("payload"))
    return chunk_rows.filter("chunk_type = 'DIRM'").select("doc_id", F.inline(entries))


def _fields(ddl: str) -> str:
    return ", ".join("`{}`: {}".format(*f.strip().split(" ", 1)) for f in ddl.split(","))


def page_components(page_rows: DataFrame, component_rows: DataFrame) -> DataFrame:
    """Pages with id, name and title of their component, by the place of the form."""
    c = component_rows.select("doc_id", F.col("offset").alias("node_offset"), F.col("id").alias("component_id"), "name", "title")
    return page_rows.join(c, ["doc_id", "node_offset"], "left")


def partitions(chunk_rows: DataFrame, component_rows: DataFrame) -> DataFrame:
    """Forms below the root with the kind that the directory gives them: pages, includes, thumbnails, other files."""
    forms = root_children(chunk_rows, list(FORMS)).filter("parent_id = 0")
    return forms.join(component_rows.select("doc_id", F.col("offset").alias("node_offset"), "id", "kind"), ["doc_id", "node_offset"], "left")


def includes(chunk_rows: DataFrame) -> DataFrame:
    """Pages' INCL chunks: doc_id, page_no, ord, include_id."""
    return page_chunks(chunk_rows, ["INCL"]).select("doc_id", "page_no", "ord", F.trim(F.decode("payload", "UTF-8")).alias("include_id"))


def resolve_includes(include_rows: DataFrame, component_rows: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Include id to directory entry (equal ids) to shared form (data begins 12 bytes behind the entry's offset)."""
    ids = component_rows.select("doc_id", F.col("id").alias("include_id"), (F.col("offset") + 12).alias("data_offset"))
    shared = chunk_rows.filter("chunk_type = 'DJVI'").select("doc_id", "data_offset", F.col("node_id").alias("djvi_node_id"))
    return include_rows.join(ids, ["doc_id", "include_id"]).join(shared, ["doc_id", "data_offset"]).select("doc_id", "page_no", "ord", "include_id", "djvi_node_id")


def first_shared(resolved: DataFrame, chunk_rows: DataFrame, kind: str = "DJBZ") -> DataFrame:
    """For each page the first chunk of a kind in the forms that it includes."""
    kids = chunk_rows.filter(F.col("chunk_type") == kind).select("doc_id", F.col("parent_id").alias("djvi_node_id"), "node_id", "payload")
    hits = resolved.join(kids, ["doc_id", "djvi_node_id"])
    return hits.groupBy("doc_id", "page_no").agg(F.min_by(F.struct("node_id", "payload"), F.struct("ord", "node_id")).alias("f")).select("doc_id", "page_no", "f.*")


def zip_by_place(left: DataFrame, right: DataFrame, by: str, left_order: str, right_order: str, value: str) -> DataFrame:
    """left with the right row of the same place; the later rows of a longer left side get null."""
    n = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(o)))
    return n(left, left_order).join(n(right, right_order).select(by, "_n", value), [by, "_n"], "left").drop("_n")


def thumbnails(page_rows: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Pages with the node of their embedded thumbnail: thumbnails are dealt out to pages in file order."""
    small = chunk_rows.filter("chunk_type = 'TH44'").select("doc_id", F.col("node_id").alias("th44_node_id"))
    return zip_by_place(page_rows.select("doc_id", "page_no"), small, "doc_id", "page_no", "th44_node_id", "th44_node_id")
