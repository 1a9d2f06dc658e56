"""N-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its word 3-grams (``textarrays``: lower case, letters
and digits; one with fewer words is one gram; one without words takes no part).
Documents whose sets are equal are one *class*, named by its smallest doc_id.
Minhash bands give candidate pairs of classes, all that share a band, however many
have it (``groups.Candidates``); their minima are compared sixteen at a time and a
pair is dropped once the posterior probability of reaching the threshold is below
the tolerance; the Jaccard similarity of the rest is computed exactly from the sets.
Pairs are verified in cells: each class goes to the cell of its smallest likely
partner, in blocks of bounded size, so a set is sent once for each two cells that
have likely pairs, not once for each pair, and the work follows the likely pairs.

The result has one row a document: its class, the copies in it, the number of other
classes that it is linked to (similarity at or above the threshold), and the group,
named by its smallest doc_id: classes that a chain of links joins. Copies are not
expanded into pairs. ``links`` gives the pairs of classes themselves. Every link
given is exact. A pair of similarity 0.5 shares no band in 14 cases of 1,000, one of
0.6 in 4 of 10,000; the pruning drops a pair at the threshold in about 1 of 100.

Defined cases: null or empty texts, and texts without words, are in no class or
group, have no links, and stay. Rows with a null doc_id are in classes and groups
like others, but name them only if no other row does (the name is null then).
Repeated rows are copies: one stays. The document that stays has the group's
smallest doc_id (null last); among rows with that id, the one whose text has the
smallest hash. An empty table gives no rows. Other columns are passed on as they are,
whatever their names. Texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .common import drop, sized, staged, table, unused
from .groups import Candidates, MinHash, bayes_keep, components, fingerprint

N = 3
THRESHOLD = 0.5
TOLERANCE = 0.01
BANDS, ROWS = 32, 3
#: Classes and grams of a cell (a single set may be larger).
CELL, CELL_GRAMS = 512, 400_000
#: Distinct grams for which there is a matrix at once.
_WIDTH = 4096


def _sets(n: int, what: str):
    """A function for mapInArrow: doc_id, fp (16 bytes), size, and either sketches or grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(BANDS, ROWS)
        for batch, texts in ta.iter_texts(batches):
            h, first, _, _ = ta.hashed(texts)
            fps, sizes, extra = [], [], []
            for i in range(len(texts)):
                g = np.unique(ta.grams(h[first[i] : first[i + 1]], n))
                sizes.append(len(g))
                fps.append(fingerprint(g) if len(g) else None)
                if what == "sketch":
                    extra.append(hasher.short(hasher.signature(g)) if len(g) else None)
                else:
                    extra.append(g.view(np.int64))
            cols = [batch.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())]
            cols.append(pa.array(extra, pa.binary() if what == "sketch" else pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{k}" for k in range(len(cols))])

    return run


def _likely(threshold: float, tolerance: float):
    """Pairs whose sizes allow the threshold and that the pruning keeps."""
    def keep(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.minimum(na, nb) >= np.maximum(na, nb) * threshold)
        at = at[bayes_keep(sa[at], sb[at], threshold, tolerance)]
        return at, np.zeros(len(at))

    return keep


def shared_grams(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common, by matrix products."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at[-1]) + 1, _WIDTH):
        i, j = np.searchsorted(at, (low, low + _WIDTH))
        has = np.zeros((len(sets), _WIDTH), np.float32)
        has[owner[i:j], at[i:j] - low] = 1
        both += has @ has.T
    return both.astype(np.int64)


def _forest(pairs: list[tuple[int, int]]) -> list[bool]:
    """Which pairs join what those before them left apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for u, v in pairs:
        a, b = find(u), find(v)
        out.append(a != b)
        root[max(a, b)] = min(a, b)
    return out


def _verify(threshold: float):
    """mapInArrow over rows sorted by cell pair, its sets before its pairs: the pairs at
    or above the threshold, their similarity, and whether a forest needs them."""
    def verified(sets: dict[int, np.ndarray], pairs: list[tuple[int, int]]) -> tuple[list, list, list, list]:
        at = {n: k for k, n in enumerate(sets)}
        held = list(sets.values())
        if len(pairs) > 4 * len(sets):
            both = shared_grams(held)
            common = [int(both[at[u], at[v]]) for u, v in pairs]
        else:
            common = [len(np.intersect1d(sets[u], sets[v], assume_unique=True)) for u, v in pairs]
        value = [c / (len(sets[u]) + len(sets[v]) - c) for (u, v), c in zip(pairs, common)]
        good = [(u, v, j) for (u, v), j in zip(pairs, value) if j >= threshold]
        return [g[0] for g in good], [g[1] for g in good], [g[2] for g in good], _forest([g[:2] for g in good])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, pairs, out = None, {}, [], ([], [], [], [])
        for batch in batches:
            g, kind, a, b = (batch.column(k).to_numpy().tolist() for k in range(4))
            grams = batch.column(4)
            offsets, flat = grams.offsets.to_numpy(), grams.values.to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if g[i] != cell:
                    for x, y in zip(out, verified(sets, pairs)):
                        x += y
                    cell, sets, pairs = g[i], {}, []
                if kind[i]:
                    pairs.append((a[i], b[i]))
                else:
                    sets[a[i]] = flat[offsets[i] : offsets[i + 1]].copy()
            if len(out[0]) > 1 << 16:
                yield _edges(out)
                out = ([], [], [], [])
        for x, y in zip(out, verified(sets, pairs)):
            x += y
        yield _edges(out)

    return run


def _edges(out: tuple[list, list, list, list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["u", "v", "jaccard", "tree"])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("c0"), F.col("text").cast("string").alias("text"))


class Join:
    """The steps of one join. ``sketches`` (doc_id, node), ``nodes`` (node, nid, rep,
    copies, size) and ``edges`` (u, v, jaccard, tree) are staged tables."""

    def __init__(self, docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE):
        plain = _plain(docs)
        sketches = staged(plain.mapInArrow(_sets(n, "sketch"), "doc_id long, node binary, size long, sig binary"))
        nodes = staged(
            sketches.where("node is not null").groupBy("node")
            .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("weight"))
            .withColumn("nid", F.monotonically_increasing_id())
        )
        self.sketches, self.nodes = sketches.select("doc_id", "node"), nodes.select("node", "nid", "rep", "copies", F.col("weight").alias("size"))
        likely = Candidates(nodes, BANDS, ROWS, _likely(threshold, tolerance)).pairs()
        ways = likely.select(F.col("u").alias("nid"), F.col("v").alias("other")).union(likely.select("v", "u"))
        homes = ways.groupBy("nid").agg(F.least("nid", F.min("other")).alias("home"))
        placed = staged(homes.join(self.nodes, "nid").select("nid", "node", "home", "rep", "size"))
        cells = placed.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("size") / CELL_GRAMS)).alias("blocks"))
        of = staged(placed.join(cells, "home").select("nid", F.xxhash64("home", F.pmod(F.xxhash64("nid"), "blocks")).alias("cell")))
        asked = staged(
            likely.select("u", "v").join(of.select(F.col("nid").alias("u"), F.col("cell").alias("cu")), "u").join(of.select(F.col("nid").alias("v"), F.col("cell").alias("cv")), "v")
            .select(F.xxhash64(F.least("cu", "cv"), F.greatest("cu", "cv")).alias("g"), "u", "v")
        )
        # one document for each needed set; those whose documents have no id are looked for among such rows
        named = plain.join(sized(placed.where("rep is not null").select(F.col("rep").alias("c0"))), "c0", "left_semi")
        source = named.union(plain.where("c0 is null")) if not placed.where("rep is null").isEmpty() else named
        grams = staged(
            source.mapInArrow(_sets(n, "grams"), "doc_id long, node binary, size long, grams array<long>").select("node", "grams")
            .join(sized(placed.select("node", "nid")), "node").groupBy("nid").agg(F.first("grams").alias("grams"))
        )
        sets = asked.select("g", F.explode(F.array("u", "v")).alias("nid")).distinct().join(grams, "nid")
        empty = F.array().cast("array<long>")
        rows = sets.select("g", F.lit(0).alias("kind"), F.col("nid").alias("a"), F.lit(0).cast("long").alias("b"), "grams").union(
            asked.select("g", F.lit(1).alias("kind"), "u", "v", empty)
        )
        self.edges = staged(rows.repartition("g").sortWithinPartitions("g", "kind").mapInArrow(_verify(threshold), "u long, v long, jaccard double, tree boolean"))
        drop(likely, placed, of, asked, grams)
        self.roots = staged(components(self.edges.where("tree")))

    def rooted(self) -> DataFrame:
        """(node, nid, rep, copies, root) of every class; one without links is its own root."""
        return self.nodes.join(self.roots.withColumnRenamed("node", "nid"), "nid", "left").select("node", "nid", "rep", "copies", F.coalesce("root", "nid").alias("root"))

    def members(self) -> DataFrame:
        """doc_id, class_id, n_copies, n_links, group_id of every row."""
        ways = self.edges.select(F.col("u").alias("nid")).union(self.edges.select("v")).groupBy("nid").agg(F.count("*").alias("n_links"))
        rooted = self.rooted()
        group = rooted.groupBy("root").agg(F.min("rep").alias("group_id"))
        classes = rooted.join(group, "root").join(ways, "nid", "left").select("node", F.col("rep").alias("class_id"), F.col("copies").alias("n_copies"), "n_links", "group_id")
        return self.sketches.join(classes, "node", "left").select(
            "doc_id", "class_id", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "group_id"
        )

    def links(self) -> DataFrame:
        """class_a < class_b, jaccard: the pairs of classes, but those without a name."""
        a, b = (self.nodes.select(F.col("nid").alias(k), F.col("rep").alias(f"r{k}")).where(f"r{k} is not null") for k in "uv")
        return self.edges.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("class_a"), F.greatest("ru", "rv").alias("class_b"), F.round("jaccard", 6).alias("jaccard"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Every document with its class, its copies, its links and its group: doc_id,
    class_id, n_copies, n_links, group_id."""
    return Join(docs, n, threshold, tolerance).members()


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies."""
    join = Join(docs, n, threshold, tolerance)
    rows = staged(
        join.sketches.where("node is not null").join(join.rooted().select("node", "root"), "node").groupBy("doc_id", "root").agg(F.count("*").alias("rows"))
    )
    first = rows.groupBy("root").agg(F.min("doc_id").alias("first"), F.sum("rows").alias("n")).where("n > 1")
    # ids that more than one row has, and null, don't tell rows apart
    twice = staged(_plain(docs).groupBy(F.col("c0").alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    odd_ids = twice.where("doc_id is not null")
    gone = staged(
        rows.join(first, "root").where("doc_id is not null and (first is null or doc_id <> first)").select("doc_id").union(odd_ids).distinct()
    )
    own, other = F.col("doc_id"), unused(docs, "other")
    kept = docs.join(sized(gone.select(F.col("doc_id").alias(other))), own == F.col(other), "left_anti").where("doc_id is not null")
    if twice.isEmpty():
        return kept
    odd = docs.join(sized(odd_ids.select(F.col("doc_id").alias(other))), own == F.col(other), "left_semi").union(docs.where("doc_id is null"))
    packed = odd.select(F.struct(*docs.columns).alias("row"))
    # the set of each such row, computed again: there are few
    with_fp = packed.select("row", F.col("row.doc_id").cast("long").alias("c0"), F.col("row.text").cast("string").alias("text")).select("row", "c0", "text", F.xxhash64("text").alias("h"))
    fps = with_fp.select("c0", "text").distinct().mapInArrow(_fp_of(n), "text string, node binary").distinct()
    # a document whose id is not repeated stands for the group, if it comes first
    lead = rows.join(first, "root").join(sized(odd_ids).withColumn("odd", F.lit(True)), "doc_id", "left").where("doc_id = first and odd is null").select("root").withColumn("led", F.lit(True))
    marked = (
        with_fp.join(fps, "text", "left").join(join.rooted().select("node", "root"), "node", "left").join(lead, "root", "left")
    )
    order = F.struct(F.col("c0").isNull(), "c0", "h")
    chosen = marked.where("root is null").select("row").union(
        marked.where("root is not null and led is null").groupBy("root").agg(F.min_by("row", order).alias("row")).select("row")
    )
    return kept.union(chosen.select("row.*"))


def _fp_of(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in ta.iter_texts(batches):
            h, first, _, _ = ta.hashed(texts)
            fps = [fingerprint(g) if len(g := np.unique(ta.grams(h[first[i] : first[i + 1]], n))) else None for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([texts, pa.array(fps, pa.binary())], names=["text", "node"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN text IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS grams
  FROM w JOIN documents USING (doc_id)
),
m AS (SELECT doc_id, CASE WHEN len(grams) > 0 THEN md5(array_to_string(grams, '|')) END AS node, grams FROM s),
c AS (SELECT node, min(doc_id) AS class_id, count(*) AS n_copies, any_value(grams) AS grams FROM m WHERE node IS NOT NULL GROUP BY node),
f AS (SELECT class_id, hash(unnest(grams)) AS g FROM c),
e AS (SELECT class_id, f.g FROM f JOIN (SELECT g FROM f GROUP BY g HAVING count(*) > 1) t ON t.g = f.g),
p AS (SELECT x.class_id AS a, y.class_id AS b, count(*) AS same FROM e x JOIN e y ON x.g = y.g AND x.class_id < y.class_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c x ON x.class_id = a JOIN c y ON y.class_id = b WHERE same / (len(x.grams) + len(y.grams) - same) >= 0.5),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT class_id, class_id FROM c UNION SELECT r.a, d.b FROM r JOIN d ON d.a = r.b),
g AS (SELECT a, min(b) AS group_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM d GROUP BY a)
SELECT m.doc_id, c.class_id, CAST(coalesce(c.n_copies, 0) AS BIGINT) AS n_copies, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, g.group_id
FROM m LEFT JOIN c ON c.node = m.node LEFT JOIN g ON g.a = c.class_id LEFT JOIN n ON n.a = c.class_id
"""
