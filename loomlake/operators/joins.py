"""Relational cores of label building: lookups, interval and spatial matches, link graphs, greedy assignment.

Overlap joins go by page, and on large pages by the cells of a grid, so a document or page of any size is an equi-join with
a residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.operators.grid import Large, cell_join, overlap_join
from loomlake.operators.windows import numbered
from loomlake.sources.scratch import written


def with_annotations(images: DataFrame, annotations: DataFrame, id_col: str = "image_id", order: str = "annotation_id") -> DataFrame:
    """Each image with the list of its annotations in order, empty if it has none."""
    cols = [c for c in annotations.columns if c != id_col]
    lists = annotations.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order]))).alias("annotations"))
    return images.join(lists, id_col, "left").withColumn("annotations", F.coalesce("annotations", F.array()))


def lookup(df: DataFrame, dimension: DataFrame, key: str, value: str, default: str = "other", max_rows: int = 100_000) -> DataFrame:
    """df with value looked up by key. The dimension is broadcast if it has at most max_rows rows."""
    small = dimension.select(key, value).dropDuplicates([key])
    side = F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small
    return df.join(side, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    whole = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(order))
    return df.groupBy(*keys).agg(whole.alias("_r")).select("_r.*")


def match_labels(files: DataFrame, labels: DataFrame, key: str, label: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(files with their last non-null label, files without one)."""
    last = last_by(labels, [key], order).where(F.col(label).isNotNull()).select(key, label)
    return files.join(last, key), files.join(last, key, "left_anti")


def zip_rows(left: DataFrame, right: DataFrame, by: list[str], left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides paired by position within a group; the shorter side ends it. The position is part of the join
    key, so a large group is spread."""
    return numbered(left, by, left_order, "_pos").join(numbered(right, by, right_order, "_pos"), [*by, "_pos"]).drop("_pos")


def span_boxes(spans: DataFrame, tokens: DataFrame, doc: str = "doc_id") -> DataFrame:
    """spans (doc, span_id, start, end) x tokens (doc, t_start, t_end, x1, y1, x2, y2): the union of the boxes of the
    tokens that overlap a span. Boxes with -1 or inverted are skipped; none left is zeros."""
    good = tokens.where("least(x1, y1, x2, y2) <> -1 and x1 <= x2 and y1 <= y2")
    meet = F.greatest("start", "t_start") < F.least("end", "t_end")
    hit = overlap_join(spans.select(doc, "span_id", "start", "end"), good, [doc], [("start", "end")], [("t_start", "t_end")], meet)
    boxes = hit.groupBy(doc, "span_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return spans.join(boxes, [doc, "span_id"], "left").na.fill(0, ["x1", "y1", "x2", "y2"])


def first_container(words: DataFrame, shapes: DataFrame, least: float = 0.85, page: str = "page", few: int = 64, most: int = 100_000) -> DataFrame:
    """words (page, word_id, x1..y2) x shapes (page, shape_id, s_x1..s_y2): the first shape holding more than `least` of
    a word's area, null if none does.

    Most pages are small: their shapes are a list that meets the words by page, so each side is shuffled once, or not at
    all if it is dealt by page already. Pages of more than `few` shapes or `most` words go by the grid."""
    large = Large([(words, most), (shapes, few)], [page])
    if not large.number:
        return _container_listed(words, shapes, least, page)
    if not large.rest:
        return _container_by_place(words, shapes, least, page, large)
    (own, many_words), (held, many_shapes) = large.split(words), large.split(shapes)
    return _container_listed(own, held, least, page).unionByName(_container_by_place(many_words, many_shapes, least, page, large))


def _held(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The area that a word shares with a shape."""
    return F.greatest(F.lit(0), F.least("x2", x2) - F.greatest("x1", x1)) * F.greatest(F.lit(0), F.least("y2", y2) - F.greatest("y1", y1))


_AREA = "(x2 - x1) * (y2 - y1)"


def _container_listed(words: DataFrame, shapes: DataFrame, least: float, page: str) -> DataFrame:
    """first_container where a page has few shapes, which are one list."""
    good = shapes.where("s_x1 <= s_x2 and s_y1 <= s_y2")
    lists = good.groupBy(page).agg(F.collect_list(F.struct("shape_id", "s_x1", "s_y1", "s_x2", "s_y2")).alias("_shapes"))
    area = F.expr(_AREA)
    holds = lambda s: (area > 0) & (_held(s["s_x1"], s["s_y1"], s["s_x2"], s["s_y2"]) > least * area)
    first = F.array_min(F.transform(F.filter("_shapes", holds), lambda s: s["shape_id"]))
    return words.join(lists.hint("merge"), page, "left").select(*words.columns, first.alias("shape_id"))


def _container_by_place(words: DataFrame, shapes: DataFrame, least: float, page: str, large: Large) -> DataFrame:
    """first_container on large pages. Words of one place have one answer, and of shapes of one place only the first
    can be one, so places are joined, each once; they are written, as both the grid and its rows are made of them."""
    area = F.expr(_AREA)
    inter = _held(*[F.col(c) for c in ("s_x1", "s_y1", "s_x2", "s_y2")])
    box, held = ["x1", "y1", "x2", "y2"], ["s_x1", "s_y1", "s_x2", "s_y2"]
    own = written(words.select(page, *box).where(area > 0).distinct())
    firsts = written(shapes.groupBy(page, *held).agg(F.min("shape_id").alias("shape_id")))
    if least >= 0.5:  # such a shape holds the word's middle, which is in one cell
        own = own.withColumns({"_mx": (F.col("x1") + F.col("x2")) / 2, "_my": (F.col("y1") + F.col("y2")) / 2})
        axes = [("_mx", "_mx"), ("_my", "_my")]
    else:
        axes = [("x1", "x2"), ("y1", "y2")]
    hit = cell_join(own, firsts, [page], axes, [("s_x1", "s_x2"), ("s_y1", "s_y2")], inter > least * area, "inner", large)
    first = hit.groupBy(page, *box).agg(F.min("shape_id").alias("shape_id"))
    return words.join(first, [page, *box], "left").select(*words.columns, "shape_id")


def y_overlaps(a1: Column, a2: Column, b1: Column, b2: Column, least: float = 0.2) -> Column:
    """The overlap is a share of the shorter side of at least `least`."""
    overlap = F.least(a2, b2) - F.greatest(a1, b1)
    return (overlap > 0) & (overlap >= least * F.least(a2 - a1, b2 - b1))


def with_neighbour(boxes: DataFrame, page: str = "page", box: str = "box_id") -> DataFrame:
    """boxes with has_neighbour: another box of the page shares enough of its height."""
    other = boxes.select(page, F.col(box).alias("_b"), F.col("y1").alias("_y1"), F.col("y2").alias("_y2"))
    meet = (F.col(box) != F.col("_b")) & y_overlaps(F.col("y1"), F.col("y2"), F.col("_y1"), F.col("_y2"))
    near = overlap_join(boxes.select(page, box, "y1", "y2"), other, [page], [("y1", "y2")], [("_y1", "_y2")], meet, "left_semi").select(page, box).distinct()
    return boxes.join(near.withColumn("has_neighbour", F.lit(True)), [page, box], "left").na.fill(False, ["has_neighbour"])


def key_values(annotations: DataFrame, doc: str = "doc_id") -> DataFrame:
    """annotations (doc, ann_id, text, link): text of the linked key with the value's text; empty values are left out and
    the last of a key text wins."""
    keys = annotations.select(doc, F.col("ann_id").alias("link"), F.col("text").alias("key"))
    pairs = annotations.where(F.col("link").isNotNull() & (F.trim("text") != "")).join(keys, [doc, "link"])
    return last_by(pairs, [doc, "key"], "ann_id").select(doc, "key", F.col("text").alias("value"))


def remap_parents(boxes: DataFrame, page: str = "page", order: str = "idx") -> DataFrame:
    """boxes (doc, page, idx, parent): indices and parents numbered from 0 within the page, -1 beyond it."""
    new = boxes.withColumn("new_idx", F.row_number().over(Window.partitionBy("doc_id", page).orderBy(order)) - 1)
    parent = new.select("doc_id", page, F.col(order).alias("parent"), F.col("new_idx").alias("new_parent"))
    return new.join(parent, ["doc_id", page, "parent"], "left").withColumn("new_parent", F.coalesce("new_parent", F.lit(-1)))


def link_pairs(links: DataFrame, nodes: DataFrame, key_label: int = 2, value_label: int = 3) -> DataFrame:
    """links (doc, link_id, node) and nodes (doc, node, label, text): the set of value texts of each key."""
    members = links.join(nodes, ["doc_id", "node"])
    keys = members.where(F.col("label") == key_label).select("doc_id", "link_id", F.col("node").alias("key_node"), F.col("text").alias("key"))
    values = members.where(F.col("label") == value_label).select("doc_id", "link_id", F.col("text").alias("value"))
    return keys.join(values, ["doc_id", "link_id"]).groupBy("doc_id", "key_node", "key").agg(F.array_sort(F.collect_set("value")).alias("values"))


def expand_ids(lines: DataFrame, words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """lines (doc, line_id, word_ids) with the texts of their words in order; ids without a word are skipped."""
    each = lines.select(doc, "line_id", F.posexplode("word_ids").alias("pos", "word_id")).join(words, [doc, "word_id"])
    return each.groupBy(doc, "line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def cer(a: Column, b: Column) -> Column:
    """Edit distance over the length of b, infinity if b is empty."""
    return F.when(F.length(b) == 0, F.lit(float("inf"))).otherwise(F.levenshtein(a, b) / F.length(b))


class _Free:
    """The texts of a group that are not taken, found best first: equal ones by name, others by length and shared pairs of
    letters, which bound the edit distance from below, so most are never compared. Copies of a text are one entry with a
    stack of places, and the nearest entries of a reference are kept for its next copy: they stay the nearest until the
    last of them is taken."""

    #: Entries that tie, beyond which they are sought again and not kept.
    KEPT = 64

    def __init__(self, texts: list[str], block: int = 128):
        import numpy as np

        self.np, self.block = np, block
        places: dict[str, list[int]] = {}
        for i, t in enumerate(texts):
            places.setdefault(t, []).append(i)
        self.texts, self.copies = list(places), [x[::-1] for x in places.values()]
        self.equal = {t: i for i, t in enumerate(self.texts)}
        self.taken = np.zeros(len(self.texts), bool)
        self.length: dict[int, list[int]] = {}
        for i in range(len(self.texts) - 1, -1, -1):
            self.length.setdefault(len(self.texts[i]), []).append(i)
        self.left = {n: len(v) for n, v in self.length.items()}
        self.index: dict[int, tuple] = {}
        self.known: dict[str, list[int]] = {}

    @staticmethod
    def pairs(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for i in range(len(text) - 1):
            out[text[i : i + 2]] = out.get(text[i : i + 2], 0) + 1
        return out

    def _bucket(self, n: int) -> tuple:
        """(texts of a length, their letters, where each pair occurs and how often), made anew when half are taken."""
        np = self.np
        if n not in self.index or 2 * self.left[n] < len(self.index[n][0]):
            own = [i for i in reversed(self.length[n]) if not self.taken[i]]
            self.length[n] = own[::-1]
            places: dict[str, tuple[list, list]] = {}
            for k, i in enumerate(own):
                for p, c in self.pairs(self.texts[i]).items():
                    at = places.setdefault(p, ([], []))
                    at[0].append(k)
                    at[1].append(c)
            letters = np.array([[ord(c) for c in self.texts[i]] for i in own], np.int32).reshape(len(own), n)
            self.index[n] = (np.array(own, np.int64), letters, {p: (np.array(a), np.array(b)) for p, (a, b) in places.items()})
        return self.index[n]

    def distances(self, text: list[int], letters) -> object:
        """The edit distances of a text to texts of one length."""
        np = self.np
        row = np.repeat(np.arange(letters.shape[1] + 1, dtype=np.int32)[:, None], len(letters), axis=1)
        for i, c in enumerate(text, 1):
            change = row[:-1] + (letters.T != c)
            new = np.empty_like(row)
            new[0] = i
            np.minimum(change, row[1:] + 1, out=new[1:])
            for k in range(1, len(new)):
                np.minimum(new[k], new[k - 1] + 1, out=new[k])
            row = new
        return row[-1]

    def nearest(self, ref: str) -> list[int]:
        """The entries of least cer that are free."""
        np = self.np
        if ref and ref in self.equal and not self.taken[self.equal[ref]]:
            return [self.equal[ref]]
        best, tied = float("inf"), []
        letters, own = [ord(c) for c in ref], self.pairs(ref)
        for n in sorted((n for n, k in self.left.items() if n and k), key=lambda n: abs(len(ref) - n) / n):
            if abs(len(ref) - n) / n > best:
                break
            ids, rows, places = self._bucket(n)
            shared = np.zeros(len(ids), np.int64)
            for p, c in own.items():
                if p in places:
                    shared[places[p][0]] += np.minimum(places[p][1], c)
            low = np.maximum(abs(len(ref) - n), -(-(max(len(ref), n) - 1 - shared) // 2))
            low[self.taken[ids]] = 1 << 40
            order = np.argsort(low, kind="stable")
            for k in range(0, len(order), self.block):
                some = order[k : k + self.block]
                some = some[low[some] / n <= best]
                some = some[low[some] < 1 << 40]
                if not len(some):
                    break
                score = self.distances(letters, rows[some]) / n
                if score.min() < best:
                    best, tied = float(score.min()), []
                tied += ids[some[score == best]].tolist()
        return tied or [self.equal[""]]  # only empty texts are left

    def take(self, ref: str) -> int:
        """The free text of least cer, the first of those that tie."""
        tied = [i for i in self.known.get(ref, ()) if not self.taken[i]] or self.nearest(ref)
        self.known[ref] = tied if len(tied) <= self.KEPT else []
        best = min(tied, key=lambda i: self.copies[i][-1])
        place = self.copies[best].pop()
        if not self.copies[best]:
            self.taken[best] = True
            self.left[len(self.texts[best])] -= 1
        return place


def assign_by_cer(refs: DataFrame, texts: DataFrame, group: str) -> DataFrame:
    """refs (group, pos, ref) and texts (group, idx, text): in order of refs each takes the free text of least cer, the
    lowest idx on ties. Groups whose sides differ in number get empty text. The choice goes by turns, so a group is one
    task; it holds the texts and an index of their letter pairs, and no table of all pairs is made."""
    import pyarrow as pa

    n = refs.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("n_refs"))
    m = texts.groupBy(F.col(group).alias("_h")).agg(F.count("*").alias("n_texts"))
    sizes = n.join(m, F.col("_g").eqNullSafe(F.col("_h")), "left")
    marked = refs.join(sizes.select("_g", F.coalesce(F.col("n_refs") == F.col("n_texts"), F.lit(False)).alias("_same")), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    kind = dict(refs.dtypes)

    def greedy(left: pa.Table, right: pa.Table) -> pa.Table:
        names = right.sort_by("idx").column("text").to_pylist() if right.num_rows else []
        left, free = left.sort_by("pos"), _Free(names)
        return left.append_column("text", pa.array([names[free.take(r)] for r in left.column("ref").to_pylist()], pa.string()))

    cols = [group, "pos", "ref"]
    chosen = marked.where("_same").select(*cols).groupBy(group).cogroup(texts.select(F.col(group).alias("_t"), "idx", "text").groupBy("_t")).applyInArrow(greedy, f"{group} {kind[group]}, pos {kind['pos']}, ref string, text string")
    return chosen.unionByName(marked.where("not _same").select(*cols, F.lit("").alias("text")))


def composite_lookup(df: DataFrame, other: DataFrame, keys: list[str], order: str | None = None, per_task: int = 250_000) -> DataFrame:
    """Inner join on several keys with the last row of other for each of them, in that order; without an order, other has
    one row for each, which is checked. Rows are sorted by key, so both sides are dealt to a task for each ``per_task`` rows
    of other, where these are more than the session's number of tasks, which does not grow with the table."""
    if order is None:
        once = F.when(F.count("*") == 1, F.first(F.struct(*[F.col(f"`{c}`") for c in other.columns]))).otherwise(F.raise_error(F.lit(f"repeated {keys}: name an order")))
        return df.join(other.groupBy(*keys).agg(once.alias("_r")).select("_r.*"), keys)
    tasks = -(-other.count() // per_task)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df, other = df.repartition(tasks, *keys), other.repartition(tasks, *keys)
    return df.join(last_by(other, keys, order), keys)


def set_union(*frames: DataFrame) -> DataFrame:
    """The rows of all frames, each once, by column name."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.distinct()


def new_assets(incoming: DataFrame, stored: DataFrame, keys=("provider", "dataset", "hash")) -> DataFrame:
    """One row for each content that is not stored yet."""
    return incoming.where("hash is not null").dropDuplicates(list(keys)).join(stored.select(*keys).distinct(), list(keys), "left_anti")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")
