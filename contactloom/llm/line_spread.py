"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. Sites per line are counted
with HyperLogLog sketches that merge by aggregation; lines whose estimate comes
near the threshold are counted exactly. One occurrence of each such line stays,
that of the smallest doc_id; elsewhere it is removed.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.session import written

from .batches import arrow_schema, aside, one_column, slices
from .hot import join_counted

SITES = 10
# Words a line needs to be judged: shorter ones meet by chance.
MIN_WORDS = 3
# Sketches of 2^12 registers are off by 1.6 % (one deviation); the band is six of them and one site.
SKETCH_BITS, BAND = 12, 0.1


def _bare(line: Column) -> Column:
    """Without blanks at both ends, which the comparison ignores."""
    return F.regexp_replace(line, "^[ \\t\\x0B\\f\\r]+|[ \\t\\x0B\\f\\r]+$", "")


def line_table(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per judged line: ``line`` (128 bits of its hash), doc_id, source."""
    docs = one_column(documents, "doc_id", "text", "source").filter("text is not null")
    lines = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("raw"))
    bare = lines.select("doc_id", "source", _bare(F.col("raw")).alias("bare"))
    judged = bare.filter(F.size(F.split("bare", "[ \\t\\x0B\\f\\r]+")) >= min_words) if min_words > 1 else bare.filter("bare != ''")
    return judged.select(_digest(F.col("bare")).alias("line"), "doc_id", "source")


def _digest(bare: Column) -> Column:
    return F.unhex(F.substring(F.md5(bare.cast("binary")), 1, 32))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(line, keeper, rows) for every line on ``sites`` distinct sites or more; ``keeper`` is its smallest doc_id.

    A null source is no site. Three steps, each on what the one before left:
    lines met at least ``sites`` times on more than one site; their sketches;
    exact counts of the lines whose estimate lies in the band around the
    threshold. All are aggregations with partial sums, so a line that fills a
    third of the corpus arrives as one row per task.
    """
    seen = lines.groupBy("line").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("source").alias("n"),
        F.min("source").alias("low"),
        F.max("source").alias("high"),
        F.min("doc_id").alias("keeper"),
    )
    often = written(
        seen.filter((F.col("n") >= sites) & (F.col("low") < F.col("high") if sites > 1 else F.lit(True))).select("line", "keeper", "rows"),
        "lines-often",
    )
    # The sites of those lines, each pair once per task before it moves.
    pairs = join_counted(lines.filter("source is not null"), often.select("line", "rows"), ["line"], "rows")
    sketched = pairs.groupBy("line").agg(F.expr(f"hll_sketch_estimate(hll_sketch_agg(source, {SKETCH_BITS}))").alias("about"))
    low, high = sites * (1 - BAND) - 1, sites * (1 + BAND) + 1
    judged = written(sketched.filter(F.col("about") >= low), "lines-sketched")
    near = judged.filter(F.col("about") <= high).select("line")
    exact = (
        pairs.join(near, "line", "left_semi")
        .select("line", "source")
        .distinct()
        .groupBy("line")
        .count()
        .filter(F.col("count") >= sites)
        .select("line")
    )
    return often.join(judged.filter(F.col("about") > high).select("line").unionByName(exact), "line", "left_semi")


def removals(lines: DataFrame, spread: DataFrame) -> DataFrame:
    """doc_id and the hashes of the boilerplate lines to remove from it; documents without any are left out."""
    met = join_counted(lines.select("line", "doc_id"), spread, ["line"], "rows")
    away = met.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return away.select("doc_id", "line").distinct().groupBy("doc_id").agg(F.collect_list("line").alias("_gone"))


def remove_lines(documents: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with boilerplate lines taken out of ``text``, plus n_lines and n_removed.

    The keeper keeps the line's first occurrence and loses repeats of it. Lines
    are compared without blanks at both ends; lines of fewer words stay. A null
    text stays null with zero lines; rows with equal doc_id are one document
    for the counting; a document with a null doc_id never is a keeper unless
    all are. An empty table gives an empty one; a very long text is split where it is, and rewritten as one row. Other
    columns pass through, whatever their names; those with the new names are replaced.
    """
    given = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    docs, back = aside(one_column(documents, *given), "doc_id", "text", "source")
    kept = docs.columns
    lines = written(line_table(docs, min_words), "lines")
    spread = written(boilerplate(lines, sites), "lines-spread")
    gone = removals(lines, spread)
    keeps = spread.groupBy(F.col("keeper").alias("doc_id")).agg(F.collect_list("line").alias("_once"))
    marks = gone.join(keeps, gone["doc_id"].eqNullSafe(keeps["doc_id"]), "full_outer").select(
        F.coalesce(gone["doc_id"], keeps["doc_id"]).alias("_doc"), "_gone", "_once"
    )
    state = docs.join(marks, docs["doc_id"].eqNullSafe(marks["_doc"]), "left").select(*kept, "_gone", "_once")
    return back(_rewritten(state, kept))


def _rewritten(state: DataFrame, kept: list[str]) -> DataFrame:
    fields = state.select(*kept).schema.fields
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    schema += ", n_lines long, n_removed long"
    out = arrow_schema(schema)

    def rewrite(text, gone, once):
        lines, removed, keep = text.split("\n"), 0, []
        gone, once, seen = set(gone or ()), set(once or ()), set()
        if not gone and not once:
            return text, len(lines), 0
        for line in lines:
            key = hashlib.md5(line.strip(" \t\x0b\x0c\r").encode()).digest()
            if key in gone or key in seen:
                removed += 1
                continue
            if key in once:
                seen.add(key)
            keep.append(line)
        return "\n".join(keep), len(lines), removed

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [
                    (None, 0, 0) if t is None else rewrite(t, g, o)
                    for t, g, o in zip(*(part.column(c).to_pylist() for c in ("text", "_gone", "_once")))
                ]
                texts, counts, removed = zip(*rows)
                columns = {c: part.column(c) for c in kept} | {"text": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays(
                    [*[columns[f.name].cast(f.type) for f in list(out)[:-2]], pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                    schema=out,
                )

    return state.mapInArrow(run, schema)


#: The removal rule for the SQL engine: same lines, same keepers.
ORACLE = f"""
WITH raw AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents WHERE text IS NOT NULL),
bare AS (SELECT doc_id, source, raw, no, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM raw),
judged AS (SELECT * FROM bare WHERE len(string_split_regex(line, '[ \\t\\x0B\\f\\r]+')) >= {MIN_WORDS}),
spread AS (SELECT line, min(doc_id) AS keeper FROM judged GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
marked AS (
  SELECT b.*, s.keeper IS NOT NULL AND (b.doc_id <> s.keeper
    OR row_number() OVER (PARTITION BY b.doc_id, b.line ORDER BY b.no) > 1) AS gone
  FROM bare b LEFT JOIN spread s ON b.line = s.line)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS clean_sha256
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
