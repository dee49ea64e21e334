"""A table with one row per key that is added to and changed without being rewritten.

Rows lie in hash buckets of their key. What a write brings goes to folders of
its own, its stages, and counts from the moment its commit is in the log: a
numbered file that only one writer can create. A commit brings new keys, with
an index of key bits beside each bucket, so that a batch opens only buckets
which may hold its keys; or new rows of stored keys, of which a read takes the
latest; or it replaces all stages of single buckets by one. It may carry the
name and batch number of a stream; a batch that was committed is not taken again.

All of it is Parquet folders, and joins and aggregations over them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators.rank import first_wins
from ..session import written
from .files import Folder

# Bits of the index for each key, and bits in one of its rows (fixed by Spark's bitmap functions).
BITS_EACH, PAGE_BITS = 16, 32768
# Commits after which the state is written down, so that the log is not read from its beginning.
STATE_EVERY = 32
# A bucket is due for compaction with more stages than this, or more changed rows than this share of its rows.
MOST_STAGES, MOST_CHANGED = 16, 0.25
BUCKET, STAGE = "_bucket", "_stage"


@dataclass
class State:
    """What the log amounts to after ``version`` commits."""

    version: int = 0
    #: Of each bucket, the stages that count with their numbers of rows, oldest first.
    adds: dict[str, dict[str, int]] = field(default_factory=dict)
    changes: dict[str, dict[str, int]] = field(default_factory=dict)
    #: Index pages of the buckets of each stage.
    pages: dict[str, int] = field(default_factory=dict)
    #: The commit that brought each stage.
    ages: dict[str, int] = field(default_factory=dict)
    #: The latest batch of each stream.
    done: dict[str, int] = field(default_factory=dict)

    def take(self, entry: dict) -> None:
        self.version += 1
        if entry.get("stream") is not None:
            self.done[entry["stream"]] = max(entry["batch"], self.done.get(entry["stream"], entry["batch"]))
        for bucket in entry.get("replaced", ()):
            self.adds.pop(bucket, None)
            self.changes.pop(bucket, None)
        for part, into in (("adds", self.adds), ("changes", self.changes)):
            if found := entry.get(part):
                for bucket, n in found["rows"].items():
                    into.setdefault(bucket, {})[found["stage"]] = n
                self.ages[found["stage"]] = self.version
                self.pages[found["stage"]] = found.get("pages", 0)
        live = self.stages()
        self.pages = {s: n for s, n in self.pages.items() if s in live}
        self.ages = {s: n for s, n in self.ages.items() if s in live}

    def stages(self) -> set[str]:
        return {s for part in (self.adds, self.changes) for stages in part.values() for s in stages}


class KeyedTable:
    """The table in folder ``path``, with rows of ``layout`` and columns ``key``; ``buckets`` holds for its whole life."""

    def __init__(self, spark: SparkSession, path: str, layout: T.StructType, key: list[str], buckets: int = 64):
        self.spark, self.path, self.layout, self.key = spark, path.rstrip("/"), layout, key
        self.log = Folder(spark, f"{self.path}/log")
        form = json.dumps({"buckets": buckets, "key": key})
        if not self.log.create("form.json", form):
            found = json.loads(self.log.read("form.json"))
            if found["key"] != key:
                raise ValueError(f"the table in {path} has the key {found['key']}")
            buckets = found["buckets"]
        self.buckets = buckets

    # ---- the log

    def state(self) -> State:
        names = self.log.names()
        state = State()
        drafts = [n for n in names if n.startswith("state-")]
        if drafts:
            state = State(**json.loads(self.log.read(drafts[-1])))
        for name in names:
            if name.startswith("commit-") and int(name[7:-5]) > state.version:
                state.take(json.loads(self.log.read(name)))
        return state

    def _commit(self, state: State, entry: dict) -> bool:
        """False where another writer was first: nothing counts then."""
        number = state.version + 1
        if not self.log.create(f"commit-{number:012d}.json", json.dumps(entry)):
            return False
        if number % STATE_EVERY == 0:
            state.take(entry)
            self.log.create(f"state-{number:012d}.json", json.dumps(state.__dict__))
        return True

    # ---- places of keys

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("bucket"), *self.key), F.lit(self.buckets)).cast("int")

    def _bits(self, pages: Column) -> tuple[Column, list[Column]]:
        """The index page of a key, and its two bits there."""
        h = F.xxhash64(F.lit("index"), *self.key)
        first, second = F.pmod(F.shiftright(h, 16), F.lit(PAGE_BITS)), F.pmod(F.shiftright(h, 40), F.lit(PAGE_BITS))
        return F.pmod(h, pages).cast("int"), [first, second]

    # ---- reading

    def _read(self, part: dict[str, dict[str, int]], buckets: set[str] | None) -> DataFrame:
        """Rows of the stages of some buckets, or of all, with BUCKET and STAGE."""
        paths = [
            f"{self.path}/data/{STAGE}={s}/{BUCKET}={b}" for b, stages in part.items() if buckets is None or b in buckets for s in stages
        ]
        layout = T.StructType([*self.layout.fields, T.StructField(STAGE, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        if not paths:
            return schema.empty_table(self.spark, layout)
        return self.spark.read.schema(layout).option("basePath", f"{self.path}/data").parquet(*paths)

    def rows(self, state: State | None = None, buckets: set[str] | None = None) -> DataFrame:
        """The latest row of every key. Buckets without changes are read as they lie."""
        state = state or self.state()
        names = self.layout.fieldNames()
        changed = {b: s for b, s in state.changes.items() if buckets is None or b in buckets}
        quiet = {b for b in state.adds if b not in changed and (buckets is None or b in buckets)}
        out = self._read(state.adds, quiet).select(*names)
        if not changed:
            return out
        ages = F.create_map(*[F.lit(x) for s in {s for stages in changed.values() for s in stages} for x in (s, state.ages[s])])
        news = first_wins(self._read(changed, None).withColumn("_age", ages[F.col(STAGE)]), self.key, [F.desc("_age")]).select(*names)
        old = self._read(state.adds, set(changed)).select(*names)
        return out.unionByName(old.join(news.select(*self.key), self.key, "left_anti").select(*names)).unionByName(news)

    # ---- writing

    def _staged(self, rows: DataFrame, indexed: bool) -> dict:
        """Writes rows of ``layout``, by bucket, and their index; what a commit says about them."""
        stage = uuid.uuid4().hex
        at = f"{self.path}/data/{STAGE}={stage}"
        placed = rows.select(*self.layout.fieldNames()).withColumn(BUCKET, self._bucket())
        placed.repartition(BUCKET).sortWithinPartitions(BUCKET, *self.key).write.partitionBy(BUCKET).parquet(at)
        stored = self._read({str(b): {stage: 0} for b in self._present(stage)}, None)
        counts = {str(r[0]): r[1] for r in stored.groupBy(BUCKET).count().collect()}  # one row per bucket
        entry = {"stage": stage, "rows": counts}
        if indexed and counts:
            pages = -(-max(counts.values()) * BITS_EACH // PAGE_BITS)
            page, bits = self._bits(F.lit(pages))
            marks = stored.select(BUCKET, page.alias("page"), F.explode(F.array(*bits)).alias("bit"))
            # Bitmap positions count from 1.
            index = marks.groupBy(BUCKET, "page").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits"))
            index.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/index/{STAGE}={stage}")
            entry["pages"] = pages
        return entry

    def _present(self, stage: str) -> list[int]:
        names = Folder(self.spark, f"{self.path}/data/{STAGE}={stage}").names()
        return [int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")]

    def may_hold(self, keys: DataFrame, state: State) -> dict[str, dict[str, int]]:
        """Of each bucket the added stages that may hold one of ``keys``, by the index alone."""
        if not state.adds:
            return {}
        placed = keys.select(*self.key).withColumn(BUCKET, self._bucket())
        wanted = {str(r[0]) for r in placed.select(BUCKET).distinct().collect()}  # one row per bucket
        live = [(int(b), s, state.pages[s]) for b, stages in state.adds.items() if b in wanted for s in stages]
        if not live:
            return {}
        paths = [f"{self.path}/index/{STAGE}={s}/{BUCKET}={b}" for b, s, _ in live]
        layout = f"page int, bits binary, {STAGE} string, {BUCKET} int"
        index = self.spark.read.schema(layout).option("basePath", f"{self.path}/index").parquet(*paths)
        stages = F.broadcast(self.spark.createDataFrame(live, f"{BUCKET} int, {STAGE} string, pages int"))
        asked = placed.join(stages, BUCKET)
        page, bits = self._bits(F.col("pages"))
        asked = asked.select(BUCKET, STAGE, page.alias("page"), bits[0].alias("first"), bits[1].alias("second"))

        met = asked.join(index, [BUCKET, STAGE, "page"])
        for bit in ("first", "second"):
            byte = F.expr(f"cast(conv(hex(substring(bits, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int)")
            met = met.withColumn(f"_{bit}", byte.bitwiseAND(F.pow(F.lit(2), F.col(bit) % 8).cast("int")))
        found = met.filter("_first > 0 and _second > 0").select(BUCKET, STAGE).distinct().collect()  # buckets x stages at most
        out: dict[str, dict[str, int]] = {}
        for bucket, stage in found:
            out.setdefault(str(bucket), {})[stage] = 0
        return out

    def insert(self, rows: DataFrame, stream: str | None = None, batch: int = 0) -> DataFrame:
        """Adds the rows whose key is not stored; returns them. ``rows`` hold each key once.

        Of writers at the same time the first to commit wins; the others judge
        their rows again, so a key is never stored twice. A batch of a stream that was committed adds nothing.
        """
        return self._put(rows, None, stream, batch)[0]

    def update(
        self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], stream: str | None = None, batch: int = 0
    ) -> DataFrame:
        """Rewrites the stored rows of ``keys`` as ``change`` gives them, and no others; returns the new rows.

        ``change`` keeps keys; it may be called again where another writer came between.
        """
        return self._put(keys, change, stream, batch, add=False)[1]

    def put(
        self, rows: DataFrame, change: Callable[[DataFrame], DataFrame], stream: str | None = None, batch: int = 0
    ) -> tuple[DataFrame, DataFrame]:
        """Both in one commit: adds the rows whose key is new, and rewrites the stored rows of the other keys; (added, changed)."""
        return self._put(rows, change, stream, batch)

    def _put(self, rows, change, stream, batch, add=True) -> tuple[DataFrame, DataFrame]:
        names, nothing = self.layout.fieldNames(), schema.empty_table(self.spark, self.layout)
        given = written(rows.select(*names) if add else rows.select(*self.key).distinct(), "keyed-batch")
        while True:
            state = self.state()
            if stream is not None and state.done.get(stream, -1) >= batch:
                return nothing, nothing
            # Only the stages that may hold a key are opened, and for changes all stages of their buckets.
            near = self.may_hold(given, state)
            known = self._read(near, None).select(*self.key).join(given.select(*self.key), self.key, "left_semi")
            known = written(known, "keyed-known") if change else known
            entry: dict = {"stream": stream, "batch": batch}
            if add:
                fresh = written(given.join(known, self.key, "left_anti").select(*names), "keyed-fresh")
                entry["adds"] = self._staged(fresh, indexed=True)
            if change:
                touched = self.rows(state, set(near)).join(known, self.key, "left_semi").select(*names)
                entry["changes"] = self._staged(change(touched), indexed=False)
            entry = {k: v for k, v in entry.items() if k not in ("adds", "changes") or v["rows"]}
            idle = stream is None and not entry.keys() & {"adds", "changes"}
            if idle or self._commit(state, entry):
                return tuple(self._brought(entry.get(part)) for part in ("adds", "changes"))

    def _brought(self, part: dict | None) -> DataFrame:
        rows = part["rows"] if part else {}
        return self._read({b: {part["stage"]: n} for b, n in rows.items()}, None).select(*self.layout.fieldNames())

    def due(self, state: State | None = None) -> list[str]:
        """Buckets that are read from many stages or for many changes."""
        state = state or self.state()

        def is_due(bucket: str) -> bool:
            adds, changes = state.adds.get(bucket, {}), state.changes.get(bucket, {})
            return len(adds) + len(changes) > MOST_STAGES or sum(changes.values()) > MOST_CHANGED * sum(adds.values())

        return sorted(b for b in state.adds.keys() | state.changes.keys() if is_due(b))

    def compact(self, buckets: list[str] | None = None) -> list[str]:
        """Writes the given buckets, or those that are due, anew; all others stay as they are."""
        while True:
            state = self.state()
            chosen = [b for b in (self.due(state) if buckets is None else buckets) if b in state.adds]
            if not chosen:
                return []
            entry = {"replaced": chosen, "adds": self._staged(self.rows(state, set(chosen)), indexed=True)}
            if self._commit(state, entry):
                return chosen

    def sweep(self, older_than_hours: float = 24) -> list[str]:
        """Deletes what counts no more, or never did (of lost writers), once it is old enough for no one to read or write it."""
        state, now, gone = self.state(), int(time.time() * 1000), []
        live = {(s, b) for part in (state.adds, state.changes) for b, stages in part.items() for s in stages}
        stages = {s for s, _ in live}
        for part in ("data", "index"):
            folder = Folder(self.spark, f"{self.path}/{part}")
            for name in folder.names():
                stage = name.split("=")[-1]
                inside = Folder(self.spark, f"{self.path}/{part}/{name}").names() if stage in stages else []
                dead = [f"{name}/{b}" for b in inside if b.startswith(f"{BUCKET}=") and (stage, b.split("=")[1]) not in live]
                for at in dead if stage in stages else [name]:
                    if at.startswith(f"{STAGE}=") and folder.age_ms(at, now) >= older_than_hours * 3_600_000:
                        folder.delete(at)
                        gone.append(f"{part}/{at}")
        return gone
