"""The positioned text layer: decoding, search, and the text around, in and under zones.

A zone table has doc_id, page_no, zone_id, parent_id, ord, zone_type, x, y, width, height, n_children, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafquarry.functions import arrow, geometry, jvm, text

ZONE = "zone_id int, parent_id int, ord int, depth int, subtree_end int, zone_type string, x int, y int, width int, height int, text_offset int, text_length int, n_children int, text string"
#: Side of a cell of the grid that deals out many search rectangles.
CELL = 256


def decode(page_text_chunks: DataFrame) -> DataFrame:
    """Text layers of (doc_id, page_no, chunk_type, payload) rows: text, version, zones, or error."""
    fields = ", ".join("`{}`: {}".format(*f.split(" ")) for f in ZONE.split(", "))
    layer = jvm.call(page_text_chunks, "TextLayer", f"struct<text: string, version: int, error: string, zones: array<struct<{fields}>>>", F.col("payload"), F.col("chunk_type"))
    return page_text_chunks.select("doc_id", "page_no", layer.alias("l")).select("doc_id", "page_no", "l.*")


def zones(layers: DataFrame) -> DataFrame:
    return layers.select("doc_id", "page_no", F.explode("zones").alias("z")).select("doc_id", "page_no", "z.*")


def page_text(page_rows: DataFrame, layers: DataFrame) -> DataFrame:
    """Every page with its text, "" where it has no layer."""
    return page_rows.select("doc_id", "page_no").join(layers.select("doc_id", "page_no", "text"), ["doc_id", "page_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def _leaf_words(zone_rows: DataFrame) -> DataFrame:
    return zone_rows.filter((F.col("zone_type") == "Word") & (F.col("n_children") == 0))


def search(zone_rows: DataFrame, needle: str) -> DataFrame:
    """Words that hold the needle, letter case aside."""
    return _leaf_words(zone_rows).filter(text.holds(F.col("text"), needle))


def _inside(xmin: Column, ymin: Column, xmax: Column, ymax: Column, y: Column) -> Column:
    return (F.col("x") >= xmin) & (y >= ymin) & (F.col("x") + F.col("width") <= xmax) & (y + F.col("height") <= ymax)


def search_rect(zone_rows: DataFrame, xmin: int, ymin: int, xmax: int, ymax: int) -> DataFrame:
    """Words that lie wholly in a rectangle."""
    return _leaf_words(zone_rows).filter(_inside(*map(F.lit, (xmin, ymin, xmax, ymax)), F.col("y")))


def search_rect_from_top(zone_rows: DataFrame, xmin: int, ymin: int, xmax: int, ymax: int, page_height: Column) -> DataFrame:
    """The same for a rectangle whose y runs from the other edge of the page."""
    return _leaf_words(zone_rows).filter(_inside(*map(F.lit, (xmin, ymin, xmax, ymax)), geometry.flip(F.col("y"), F.col("height"), page_height)))


def search_rects(zone_rows: DataFrame, rects: DataFrame, cell: int = CELL) -> DataFrame:
    """Words in each of many rectangles (rect_id, xmin, ymin, xmax, ymax): an equi-join on grid cells.

    A word is in the one cell of its corner; a rectangle is put in the cells that it meets.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    spread = rects.withColumn("_cx", F.explode(F.sequence(at("xmin"), at("xmax")))).withColumn("_cy", F.explode(F.sequence(at("ymin"), at("ymax"))))
    words = _leaf_words(zone_rows).withColumn("_cx", at("x")).withColumn("_cy", at("y"))
    return words.join(spread, ["_cx", "_cy"]).filter(_inside(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("y"))).drop("_cx", "_cy", "xmin", "ymin", "xmax", "ymax")


def joined(hits: DataFrame, by: list[str], parent: str = "parent_id", order: str = "zone_id") -> DataFrame:
    """Texts of hits by group: words of one parent joined by a space, parents by a newline, both in order."""
    lines = hits.groupBy(*by, parent).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s.text), " ").alias("line"))
    return lines.groupBy(*by).agg(text.trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(parent, "line"))), lambda s: s.line), "\n")).alias("text"))


def text_for_location(page_rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Every page with the text of the hits on it, "" for none."""
    return page_rows.select("doc_id", "page_no").join(joined(hits, ["doc_id", "page_no"]), ["doc_id", "page_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def _beside(lo, hi) -> Column:
    w = Window.partitionBy("doc_id", "page_no", "parent_id").orderBy("ord").rowsBetween(lo, hi)
    return F.when(F.col("zone_type") == "Word", text.trimmed(F.array_join(F.collect_list("text").over(w), " "))).otherwise("")


def pre_text(zone_rows: DataFrame) -> DataFrame:
    """Each word with the words before it in its parent."""
    return zone_rows.withColumn("pre_text", _beside(Window.unboundedPreceding, -1))


def post_text(zone_rows: DataFrame) -> DataFrame:
    """Each word with the words behind it in its parent."""
    return zone_rows.withColumn("post_text", _beside(1, Window.unboundedFollowing))


def beside(line_rows: DataFrame) -> DataFrame:
    """The words of (doc_id, page_no, line, words) rows with ord, pre_text and post_text: the texts around come out of the line's own row."""
    each = line_rows.select("*", F.posexplode("words").alias("ord", "text"))
    before, after = F.expr("array_join(slice(words, 1, ord), ' ')"), F.expr("array_join(slice(words, ord + 2, size(words)), ' ')")
    return each.select(*[c for c in each.columns if c != "words"], before.alias("pre_text"), after.alias("post_text"))


def rolled_layers(page_text_chunks: DataFrame) -> DataFrame:
    """As `rollup`, straight from text chunks: a page's zones come and go in one row, so no zone is shuffled."""
    fields = "zone_id: int, parent_id: int, ord: int, zone_type: string, rolled: string"
    return page_text_chunks.select("doc_id", "page_no", F.inline(jvm.call(page_text_chunks, "Rolled", f"array<struct<{fields}>>", F.col("payload"), F.col("chunk_type"))))


def rollup(zone_rows: DataFrame) -> DataFrame:
    """Every zone with its own text: of words their own; of lines the children's and a line end; of others the children's."""

    def build(nodes: list[dict]):
        kids: dict = {}
        for n in sorted(nodes, key=lambda n: n["ord"]):
            kids.setdefault(n["parent_id"], []).append(n)
        rolled: dict = {}
        for n in sorted(nodes, key=lambda n: -n["zone_id"]):  # children come behind their parent in pre-order
            below = kids.get(n["zone_id"])
            if n["zone_type"] == "Word" or not below:
                rolled[n["zone_id"]] = (n["text"] or "").strip()
            else:
                rolled[n["zone_id"]] = " ".join(rolled[c["zone_id"]] for c in below) + "\r\n" * (n["zone_type"] == "Line")
        for n in nodes:
            yield {"doc_id": n["doc_id"], "page_no": n["page_no"], "zone_id": n["zone_id"], "parent_id": n["parent_id"], "ord": n["ord"], "zone_type": n["zone_type"], "rolled": rolled[n["zone_id"]]}

    columns = ("doc_id", "page_no", "zone_id", "parent_id", "ord", "zone_type", "text")
    return arrow.map_groups(zone_rows.select(*columns), ["doc_id", "page_no"], build, "doc_id long, page_no int, zone_id int, parent_id int, ord int, zone_type string, rolled string")
