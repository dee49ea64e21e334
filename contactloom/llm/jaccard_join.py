"""Jaccard join of texts as a join in a metric space.

1 - Jaccard is a metric, and two texts without a common shingle lie at its
greatest distance, 1. So the space first falls apart into islands: texts are
connected when they share one of the rare shingles that two linked texts must
share. Every island gets pivots; every text goes to the Voronoi region of its
nearest pivot, and also to every region whose pivot is nearer than that plus
twice the threshold, which the triangle inequality says is enough. Regions are
divided again, by Spark while they are larger than a task should hold and in the task from
there on, until a few texts are left to compare. Texts within the threshold of one pivot are
linked through it and need no comparison among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.session import written

from .batches import arrow_schema, one_column, slices, utf8
from .components import components
from .hot import join_counted
from .vocabulary import Words

# Link when 100 * intersection >= PERCENT * union.
PERCENT = 90
SHINGLE = 3
# Texts joined in one task; pivots of a larger region; divisions before what is left is joined block by block.
REGION, PIVOTS, LEVELS = 256, 16, 4
# Pivots of a division inside a task.
TASK_PIVOTS = 4
# An island of more texts is cut again: in blocks, each of its texts would meet more than 32 blocks.
CUT = 32 * REGION
# Where the regions of a division hold more than so many times its texts, it is not worth it.
SPREAD = 3
# Shingles with hashes below are counted over all documents, so that rare ones can come first: a fifth of all.
ZONE = np.uint64((1 << 64) // 5)
# Different texts a task remembers, to hand on the shingles of copies once.
REMEMBERED = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingles(text: bytes, vocabulary: Words) -> np.ndarray:
    """Sorted distinct hashes of the word triples; of a shorter text the whole sequence is one."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    numbers = vocabulary.numbers(words)
    h = vocabulary.hashes[numbers]
    a, b, c = h[:-2], h[1:-1], h[2:]
    mixed = a * _MIX[0] + (b ^ (b >> np.uint64(29))) * _MIX[1] + (c ^ (c >> np.uint64(31))) * _MIX[2]
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed * _MIX[0])


def signature(found: np.ndarray) -> int:
    """Equal sets have equal signatures."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def prefix_length(n: int) -> int:
    """So many first shingles, in any order all texts share, meet those of every linked text."""
    return n - (PERCENT * n + 99) // 100 + 1


# ---- the scan

SCAN = "kind int, doc_id long, n long, sig long, shingle long, spare int, size_class int"


def _size_class(n: int) -> int:
    """Linked texts are of one class or of neighbouring ones; a little wide, so that rounding parts no pair."""
    return int(np.log(n) / (-1.001 * np.log(PERCENT / 100)) + 1e-6)


def _scan(docs: DataFrame) -> DataFrame:
    """Kind 0: doc_id, size and signature of every document; no signature without words.

    Kind 1: of every text the shingles in the zone, or its first shingles where
    these are more. ``spare`` says how many of the text's shingles in the zone
    are no first shingles. Linked texts are of one size class or of
    neighbouring ones. Copies met in one task come once.
    """
    out = arrow_schema(SCAN)

    def rows(kind, **columns):
        size = len(next(iter(columns.values())))
        given = {"kind": np.full(size, kind, np.int32)} | columns
        arrays = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in out]
        return pa.RecordBatch.from_arrays(arrays, schema=out)

    def run(batches):
        vocabulary, seen = Words(), set()
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, sigs = [], []
                taken, owners, spares, classes = [], [], [], []
                for text in utf8(part.column("text")):
                    found = shingles(text, vocabulary)
                    sizes.append(len(found))
                    sigs.append(sig := signature(found) if len(found) else None)
                    if sig is None or sig in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(sig)
                    needed = prefix_length(len(found))
                    n = max(needed, int(np.searchsorted(found, ZONE)))
                    taken.append(found[:n])
                    owners.append(np.full(n, sig, np.int64))
                    spares.append(np.full(n, n - needed, np.int32))
                    classes.append(np.full(n, _size_class(len(found)), np.int32))
                yield rows(0, doc_id=part.column("doc_id").to_pylist(), n=sizes, sig=sigs)
                if taken:
                    yield rows(
                        1,
                        shingle=np.concatenate(taken).view(np.int64),
                        sig=np.concatenate(owners),
                        spare=np.concatenate(spares),
                        size_class=np.concatenate(classes),
                    )

    return docs.mapInArrow(run, SCAN)


def _islands(rows: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(sig, region) of the texts that share a first shingle with another text of their size.

    All texts share one order of shingles: those of the zone first, the rarer
    the earlier, then all others by hash. Shingles of one text alone come
    before all that are shared and meet nothing, so only shared ones are
    ranked: a text drops its ``spare`` most common ones. Texts that differ in
    the columns ``within`` don't meet; their rows have all shingles, so that
    there is no zone, and rare is what is rare there.
    """
    key = [*within, "shingle"]
    # The zone is told from the others by the sign of the hash, read as a number.
    counts = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "jaccard-counts")
    met = written(join_counted(rows, counts, key, "times").distinct(), "jaccard-shared")
    zone = [] if within else [F.col("shingle").between(0, int(ZONE) - 1)]
    latest = Window.partitionBy("sig").orderBy(*zone, F.desc("times"), F.desc("shingle"))
    # Beyond the zone nothing is spare: there all candidates are first shingles.
    first = met.withColumn("_last", F.row_number().over(latest)).filter(F.col("_last") > F.col("spare")).drop("_last")
    # A text stands in its own class and in the one below, so texts of neighbouring classes meet.
    placed = first.select(*key, "sig", F.explode(F.array(F.col("size_class"), F.col("size_class") - 1)).alias("size_class"))
    shared = placed.groupBy(*key, "size_class").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).filter("low < high")
    edges = placed.join(shared.drop("high"), [*key, "size_class"]).select(F.col("sig").alias("u"), F.col("low").alias("v"))
    return components(edges).select(F.col("node").alias("sig"), F.col("component").alias("region"))


def _sized(islands: DataFrame) -> DataFrame:
    """(sig, region, size); written islands."""
    return join_counted(islands, islands.groupBy("region").agg(F.count(F.lit(1)).alias("size")), ["region"], "size")


def _all_shingles(texts: DataFrame) -> DataFrame:
    """As the scan's rows of kind 1, with all shingles of the texts and their region."""

    def run(batches):
        vocabulary = Words()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shingles(t, vocabulary) for t in utf8(part.column("text"))]
                sizes = np.array([len(f) for f in found])
                each = {
                    "region": np.array(part.column("region"), np.int64),
                    "sig": np.array(part.column("sig"), np.int64),
                    "spare": np.array([len(f) - prefix_length(len(f)) for f in found], np.int32),
                    "size_class": np.array([_size_class(len(f)) for f in found], np.int32),
                }
                spread = {k: pa.array(np.repeat(v, sizes)) for k, v in each.items()}
                yield pa.RecordBatch.from_pydict(spread | {"shingle": pa.array(np.concatenate(found).view(np.int64))})

    return texts.select("region", "sig", "text").mapInArrow(run, "region long, sig long, spare int, size_class int, shingle long")


def _finer(texts: DataFrame) -> DataFrame:
    """Texts with their islands (region, size, sig, text), of which those over CUT are cut again while that parts a tenth of their texts.

    Texts without an island any more go: they are linked with nothing.
    """
    done, before = [], None
    while True:
        texts = written(texts, "jaccard-texts")
        large = texts.filter(F.col("size") > CUT)
        n = large.count()
        if not n or before and 10 * n > 9 * before:
            done.append(texts)
            break
        done.append(texts.filter(F.col("size") <= CUT))
        cut = written(_islands(written(_all_shingles(large), "jaccard-all"), ("region",)), "jaccard-islands")
        texts = large.select("sig", "text").join(_sized(cut), "sig").select("region", "size", "sig", "text")
        before = n
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


# ---- joins inside regions


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices a block of shingles at a time."""
    sets = left + right if right is not left else left
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[counts > 1]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), 4096):
        block = shared[start : start + 4096]

        def matrix(group):
            m = np.zeros((len(group), len(block)), np.float32)
            for i, s in enumerate(group):
                inside = s[np.searchsorted(s, block[0]) : np.searchsorted(s, block[-1], "right")]
                at = np.searchsorted(block, inside)
                hit = block[np.minimum(at, len(block) - 1)] == inside
                m[i, at[hit]] = 1
            return m

        a = matrix(left)
        out += a @ (a if right is left else matrix(right)).T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which pairs link: 100 * intersection >= PERCENT * union, in whole numbers."""
    inter = overlaps(left, right).astype(np.int64)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - inter
    return 100 * inter >= PERCENT * union


def voronoi_links(sets: list[np.ndarray], core: list[bool], names: list[int], joined: Forest) -> list[tuple[int, int]]:
    """Links (places in ``sets``) that connect the texts as all links with a core text would, by pivots, regions and windows.

    A region holds the texts at home in it, its core, and those in its window.
    Any two linked texts meet in the home region of either, so a region only
    looks for pairs with a core text. What is connected already, by earlier
    links or by names that stand for each other, is looked for no more.
    """
    found: list[tuple[int, int]] = []
    open_ = [(list(range(len(sets))), list(core))]
    while open_:
        members, at_home = open_.pop()
        if len(members) < 2 or not any(at_home) or joined.is_one([names[m] for m in members]):
            continue
        pivots = members[:TASK_PIVOTS]
        if len(members) <= 2 * TASK_PIVOTS:
            pivots = members
        near = overlaps([sets[p] for p in pivots], [sets[m] for m in members]).astype(np.int64)
        sizes = np.array([len(sets[m]) for m in members])
        union = np.array([len(sets[p]) for p in pivots])[:, None] + sizes[None, :] - near
        for i, j in np.argwhere(100 * near >= PERCENT * union).tolist():
            a, b = pivots[i], members[j]
            if (at_home[i] or at_home[j]) and joined.join(names[a], names[b]):
                found.append((a, b))
        if pivots is members:
            continue
        far = 1 - near / union
        home = far.argmin(axis=0)
        window = far <= far[home, np.arange(len(members))][None, :] + 2 * (1 - PERCENT / 100) + 1e-9
        if window.sum() > SPREAD * len(members) or window.all(axis=1).any():
            # All texts near all pivots: the next ones have to do, until all have been a pivot.
            open_.append((members[TASK_PIVOTS:], at_home[TASK_PIVOTS:]))
            continue
        for i in range(len(pivots)):
            inside = np.flatnonzero(window[i]).tolist()
            open_.append(([members[j] for j in inside], [at_home[j] and home[j] == i for j in inside]))
    return found


class Forest:
    """Which names are connected; the smallest stands for all."""

    def __init__(self, root: dict[int, int]):
        self.root = root

    def top(self, x: int) -> int:
        root = self.root
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        """False where they were connected."""
        x, y = self.top(x), self.top(y)
        if x != y:
            self.root[max(x, y)] = min(x, y)
        return x != y

    def is_one(self, names: list[int]) -> bool:
        first = self.top(names[0])
        return all(self.top(n) == first for n in names)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal keys."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = tuple(row[k] for k in keys)
            if own != key and rows:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


def _joined(cells: DataFrame) -> DataFrame:
    """(u, v) links, a spanning forest of each cell, from rows (region, a, b, side, sig, text, core, label)."""

    def run(batches):
        vocabulary = Words()
        for _, rows in _groups(batches, ["region", "a", "b"]):
            if len(rows) < 2:
                continue
            for r in rows:
                r["set"] = shingles(r["text"].encode(), vocabulary)
            left = [r for r in rows if r["side"] == 0]
            right = left if rows[0]["a"] == rows[0]["b"] else [r for r in rows if r["side"] == 1]
            if not left or not right:
                continue
            # A label is a text already known to be linked; it stands for its followers.
            joined = Forest({r["sig"]: r["sig"] if r["label"] is None else r["label"] for r in rows})
            found = []
            if right is left:
                links = voronoi_links([r["set"] for r in left], [r["core"] for r in left], [r["sig"] for r in left], joined)
                found = [(left[i]["sig"], left[j]["sig"]) for i, j in links]
            else:
                for i, j in np.argwhere(linked([r["set"] for r in left], [r["set"] for r in right])).tolist():
                    x, y = left[i], right[j]
                    if (x["core"] or y["core"]) and joined.join(x["sig"], y["sig"]):
                        found.append((x["sig"], y["sig"]))
            if found:
                u, v = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    laid = cells.repartition("region", "a", "b").sortWithinPartitions("region", "a", "b")
    return laid.mapInArrow(run, "u long, v long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Cells of a region: one where it fits a task, else one for each pair of its blocks."""
    k = F.greatest(F.lit(1), F.ceil(F.col("size") / REGION)).cast("int")
    own = rows.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("sig"), F.col("k")).cast("int"))
    met = own.withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    return met.select(
        "region",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "sig",
        "text",
        "core",
        "label",
    )


def _divided(rows: DataFrame, level: int) -> DataFrame:
    """Kind 0: members of Voronoi regions. Kind 1: links with a pivot (sig, label).

    The pivots of a region come first in each of its slices, so a task holds
    one region's pivots and one text at a time.
    """
    order = F.struct(F.col("label").isNotNull(), F.xxhash64(F.lit(level), "sig"))
    # Texts without a link come first. min_by over a bounded number of draws keeps the choice one aggregation.
    draw = F.pmod(F.xxhash64(F.lit(level + 100), "sig"), F.lit(PIVOTS))
    pivots = rows.groupBy("region", draw.alias("draw")).agg(
        F.min_by(F.struct("sig", "text"), order).alias("p"), F.first("size").alias("size")
    )
    slices_of = F.ceil(F.col("size") / REGION).cast("int")
    spread = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), slices_of - 1))).select(
        "region", "part", F.lit(0).alias("kind"), F.col("p.sig").alias("sig"), F.col("p.text").alias("text"),
        F.lit(None).cast("boolean").alias("core"), F.lit(None).cast("long").alias("label"), "size",
    )
    members = rows.select(
        "region", F.pmod(F.xxhash64("sig"), slices_of).cast("int").alias("part"), F.lit(1).alias("kind"), "sig", "text",
        "core", "label", "size",
    )
    threshold = 1 - PERCENT / 100

    def run(batches):
        vocabulary = Words()
        key, pivots = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["region"], r["part"]) != key:
                    key, pivots = (r["region"], r["part"]), []
                found = shingles(r["text"].encode(), vocabulary)
                if r["kind"] == 0:
                    pivots.append((r["sig"], found))
                    continue
                inter = np.array([len(np.intersect1d(found, p, assume_unique=True)) for _, p in pivots])
                union = np.array([len(p) for _, p in pivots]) + len(found) - inter
                far = 1 - inter / union
                home = int(far.argmin())
                label = r["label"]
                for i in np.flatnonzero(100 * inter >= PERCENT * union).tolist():
                    if pivots[i][0] != r["sig"]:
                        out.append((1, None, r["sig"], None, None, pivots[i][0], None, r["region"]))
                    if label is None:
                        label = pivots[i][0]
                for i in np.flatnonzero(far <= far[home] + 2 * threshold + 1e-9).tolist():
                    out.append((0, pivots[i][0], r["sig"], r["text"], r["core"], label, i == home, r["region"]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()))],
                    ["kind", "pivot", "sig", "text", "core", "label", "home", "region"],
                )

    laid = spread.unionByName(members).repartition("region", "part").sortWithinPartitions("region", "part", "kind")
    return laid.mapInArrow(run, "kind int, pivot long, sig long, text string, core boolean, label long, home boolean, region long")


def _open(rows: DataFrame) -> DataFrame:
    """Rows with the size of their region, without regions that have nothing to compare: no text at home, or all linked with one pivot."""
    sizes = rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("size"),
        F.max("core").alias("any_core"),
        (F.count("label") == F.count(F.lit(1))).alias("all_labelled"),
        (F.min("label") == F.max("label")).alias("one_label"),
    )
    kept = sizes.filter("size > 1 and any_core and not (all_labelled and one_label)").select("region", "size")
    return join_counted(rows, written(kept, "region-sizes"), ["region"], "size")


def _links(members: DataFrame) -> DataFrame:
    """(u, v) links that connect the texts of every region as all links would; members (region, size, sig, text), written."""
    rows = members.select("region", "size", "sig", "text", F.lit(True).alias("core"), F.lit(None).cast("long").alias("label"))
    found = []
    for level in range(LEVELS + 1):
        sized = written(_open(rows), "regions") if level else rows
        large = F.col("size") > REGION if level < LEVELS else F.lit(False)
        found.append(written(_joined(_blocks(sized.filter(~large))), "region-links"))
        more = sized.filter(large)
        if more.isEmpty():
            break
        cut = written(_divided(more, level), "voronoi")
        found.append(cut.filter("kind = 1").select(F.col("sig").alias("u"), F.col("label").alias("v")))
        texts = cut.filter("kind = 0")
        spread = texts.groupBy("region").agg(
            F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > SPREAD * F.count_if("home")).alias("wide")
        )
        judged = join_counted(texts, written(spread, "region-spread"), ["region"], "n")
        # All texts near all pivots: the division is undone, what it linked is kept.
        whole = judged.filter("wide and home").select("region", "sig", "text", "core", "label")
        found.append(written(_joined(_blocks(_open(whole))), "region-links"))
        rows = judged.filter("not wide").select(
            F.xxhash64("region", "pivot").alias("region"), "sig", "text", F.expr("core and home").alias("core"), "label"
        )
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.distinct()


# ---- the operator


def join_documents(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id.

    Two documents link when their sets of word triples have a Jaccard
    similarity of PERCENT or more; component_id is the smallest doc_id that
    links reach. Documents with equal sets are one node, so copies cost
    nothing after the first scan. Without words the set is empty, linked with
    nothing: component_id is the own doc_id. Null doc_ids never are the
    smallest, unless alone. Repeated rows come out as often. Other columns are
    left out.

    One scan gives signatures and shingles; the texts are read once more, and
    only those that share a first shingle are joined.
    """
    docs = one_column(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = written(_scan(docs), "jaccard-scan")
    nodes = scanned.filter("kind = 0").select("doc_id", "n", "sig")
    candidates = scanned.filter("kind = 1").select("shingle", "sig", "spare", "size_class")
    islands = written(_islands(candidates), "jaccard-islands")
    first = nodes.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first"))
    wanted = _sized(islands).join(first, "sig")
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["first"])).select("region", "size", "sig", "text")
    found = components(_links(_finer(_one_text(texts))))
    named = first.join(found.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn(
        "component", F.coalesce("component", "sig")
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_sig = named.join(least, "component").select("sig", "component_id")
    out = nodes.join(of_sig, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _one_text(texts: DataFrame) -> DataFrame:
    """One row per sig whose text has it: rows that repeat a doc_id may differ in text."""

    def run(batches):
        vocabulary = Words()
        for batch in batches:
            for part in slices(batch, "text"):
                own = [
                    len(found) > 0 and signature(found) == sig
                    for found, sig in zip((shingles(t, vocabulary) for t in utf8(part.column("text"))), part.column("sig").to_pylist())
                ]
                yield part.filter(pa.array(own, pa.bool_()))

    checked = texts.select("region", "size", "sig", "text").mapInArrow(run, "region long, size long, sig long, text string")
    return checked.groupBy("region", "size", "sig").agg(F.min("text").alias("text"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component: that with the smallest doc_id; columns as given.

    Of rows that repeat a doc_id all stay; so do documents without a doc_id that are alone.
    """
    away = join_documents(documents).filter("doc_id != component_id").select(F.col("doc_id").alias("_away")).distinct()
    return documents.join(away, documents["doc_id"].cast("long") == away["_away"], "left_anti")
