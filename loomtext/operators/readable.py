"""The main text of pages by scores over a table of their elements.

Every page becomes rows, one for each element, with its parent, its text's length,
the part of that in links, its commas and the weight of its names. The points of a
paragraph, a block without another in it, go to its parent and half of them to its grandparent; an element's points and weight,
damped by its link density, make its score, and the best of a page wins, the first of
equals. Its siblings come with it if they score near it or are paragraphs of their own.
What follows from sums over elements is grouped by page and element, so no page
is held in one row and no tree is walked twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from loomtext.functions import dom
from loomtext.functions.batches import slices

#: Weights of elements and of words in their names, and thresholds of the scores; fixed values.
BASE = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
NAMED, LEAST_CHARS, LEAST_SCORE, NEAR, LONG, DENSE = 25, 25, 10.0, 0.2, 80, 0.25
_GOOD = re.compile(r"\b(?:article|body|content|entry|main|post|story|text)\b")
_BAD = re.compile(r"\b(?:ads?|banner|comments?|footer|menu|nav|promo|related|share|sidebar|social|sponsor|widget)\b")
PARAGRAPHS = ("p", "pre", "td", "blockquote")
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p pre li blockquote td".split())
NODES = "node int, parent int, above int, tag string, weight int, chars int, linked int, commas int, text string, path array<int>"


def nodes_of(tree: dom.Node) -> Iterator[tuple]:
    """Rows of a page's elements, numbered in document order; only a block has its
    text, where no block lies within it."""
    rows: list[list] = []
    todo: list = [(tree, -1, -1, (), False)]
    while todo:
        node, parent, above, path, in_link = todo.pop()
        if node is None:  # all below element ``parent`` is done
            row = rows[parent]
            if row[1] >= 0:
                up = rows[row[1]]
                up[5] += row[5]
                up[6] += row[6]
                up[7] += row[7]
                up[10] |= row[10] or row[3] in BLOCKS
            continue
        number, in_link = len(rows), in_link or node.tag == "a"
        own = "".join(c for c in node.children if isinstance(c, str))
        size = len(dom.squeeze(own))
        names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().replace("_", " ").replace("-", " ")
        weight = BASE.get(node.tag, 0) + NAMED * bool(_GOOD.search(names)) - NAMED * bool(_BAD.search(names))
        rows.append([number, parent, above, node.tag, weight, size, size if in_link else 0, own.count(","), None, [*path, number], False, node])
        todo.append((None, number, 0, (), False))
        todo += [(c, number, parent, (*path, number), in_link) for c in reversed(node.children) if isinstance(c, dom.Node)]
    for row in rows:
        if row[3] in BLOCKS and not row[10]:
            row[8] = re.sub(r"\n+", " ", dom.squeeze(row[11].text())) or None
        yield tuple(row[:10])


def page_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, node, parent, above, tag, weight, chars, linked, commas, text, path) of what pages show."""
    struct = _parse_datatype_string(f"`{key}` {pages.schema[key].dataType.simpleString()}, {NODES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(struct)
        for batch in batches:
            for k, page in (row for part in slices((batch.column(0), batch.column(1))) for row in zip(*(c.to_pylist() for c in part))):
                rows = list(zip(*nodes_of(dom.visible(page or ""))))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows[0]), schema[0].type), *(pa.array(c, f.type) for c, f in zip(rows, list(schema)[1:]))], schema=schema)

    return pages.select(key, html).mapInArrow(run, struct)


def readable_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text, score) of every page's main text; a page without a paragraph of
    LEAST_CHARS characters has none. Keys are unique and not null."""
    nodes = page_nodes(pages, key, html)
    density = F.when(F.col("chars") > 0, F.col("linked") / F.col("chars")).otherwise(0.0)
    nodes = nodes.withColumn("density", density)
    said = nodes.where(F.col("tag").isin(*PARAGRAPHS) & F.col("text").isNotNull() & (F.col("chars") >= LEAST_CHARS))
    points = F.lit(1) + F.col("commas") + F.least(F.floor(F.col("chars") / 100), F.lit(3))
    given = said.select(key, F.explode(F.array(F.struct(F.col("parent").alias("node"), points.cast("double").alias("points")), F.struct(F.col("above").alias("node"), (points / 2).alias("points")))).alias("g")).select(key, "g.*").where("node >= 0")
    sums = given.groupBy(key, "node").agg(F.sum("points").alias("points"))
    scored = nodes.select(key, "node", "parent", "tag", "weight", "chars", "density").join(sums, [key, "node"], "left")
    scored = scored.withColumn("score", F.when(F.col("points").isNotNull(), (F.col("points") + F.col("weight")) * (1 - F.col("density"))))
    own = scored.where("score is not null").groupBy(key).agg(F.max_by(F.struct("node", "parent", "score"), F.struct("score", -F.col("node"))).alias("best")).select(key, "best.node", "best.parent", "best.score")
    best = own.select(key, F.col("node").alias("best_node"), F.col("parent").alias("best_parent"), F.col("score").alias("best_score"))
    near = scored.join(best, key).where((F.col("node") == F.col("best_node")) | (F.col("parent") == F.col("best_parent")))
    alone = (F.col("tag") == "p") & ((F.col("chars") > LONG) & (F.col("density") < DENSE))
    taken = near.where((F.col("node") == F.col("best_node")) | F.coalesce(F.col("score") >= F.greatest(F.lit(LEAST_SCORE), F.col("best_score") * NEAR), F.lit(False)) | alone).select(key, F.col("node").alias("held"))
    blocks = nodes.where("text is not null").select(key, "node", "text", F.explode("path").alias("held"))
    # siblings do not lie within each other, so a block is held once
    parts = blocks.join(taken, [key, "held"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    out = pages.select(key).join(parts.select(key, text.alias("text")), key, "left").join(best.select(key, F.col("best_score").alias("score")), key, "left")
    return out.select(key, F.coalesce("text", F.lit("")).alias("text"), "score")
