"""Deduplicating new batches against all history (problem 2).

A store holds what was accepted so far: one print per winnowed fingerprint, and Bloom filters over these, one per
partition. A new batch is reduced to fingerprints, the filters prescreen them, the positives are looked up in the
partitions of the store that may hold them, and the entries met there are verified (id, or dates and shared words).
What remains is settled within the batch, and the accepted entries extend the store and its filters.

Winnowing: the *set* of a title's words is put in one fixed order (rare before frequent words, then by hash), and the
pairs among the first n - ceil(s * n) + 2 of its n words are its fingerprints. Two titles that share at least the share s
of all their words (s above a half) have the pair of their first two common words as a common fingerprint: each lacks at
most n - ceil(s * n) of its words in the other, so the second common one still lies within both selections. This is the
guarantee of winnowing by window minima, for sets instead of sequences (word order may differ between titles, so windows
along the text would not do). Of the title with fewer words, even 2s / (1 + s) of the words are common, so there that pair
is an early one, whose second word is among the first n - ceil(2s / (1 + s) * n) + 2; the other pairs are late. Two late
pairs need not meet, and don't: they hold the frequent words, whose meetings would grow with the square of the rows. The
place of a fingerprint bounds how many words can still be shared, which rules most other meetings out by numbers alone;
words are fetched for the rest. Each fingerprint belongs to an era of days. An id is one more.

The store is persistent. A state file, written last and whole, names the levels that count, the order of words and the
parameters; a new object on the same path goes on from there, whatever the session's settings. Levels merge like those
of a log-structured tree: a step's prints take in the smaller levels before it where these are two or more, so each print
is rewritten a logarithmic number of times and a step meets few levels. Prints lie in one folder per level, era (32 days; ids have their own), hash
and kind of pair; only the folders of the positives are read (by the days of the batch, and by dynamic partition pruning),
so history of other weeks costs nothing. Words lie apart, once per title.

Batches that wait are taken in by steps: a step looks them up in the store of all steps before, and holds as many rows as
that store or one batch, so however many batches wait, steps are few and each print is looked at a few times. What needs
no store (words, days, classes of equal titles, which entries of one step are alike) is staged first, for all steps. A
step then writes three tables: what the store knows, the rounds that settle the rest, and a level.
"""

from __future__ import annotations

import gc
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import instants
from tidewell.shared import dropped, kept, names, read_small, remove, scratch_path, write_small

_LONGS = T.ArrayType(T.LongType())
_ENTRY = "entry_seq bigint, idh bigint, wc bigint, open boolean"
_CLASS = "wc bigint, day int, words array<bigint>, picked array<bigint>"
_EDGE = "key bigint, nb bigint"
_PRINT = "era int, fp bigint, entry_seq bigint, late int, at bigint, words array<bigint>, step string, kind string, dir bigint"
_FILTER = "part bigint, n bigint, bits binary, step string, kind string, dir bigint"
_REPEAT = "kept_seq bigint, dup_seq bigint"
#: The era of ids, apart from those of days; lengths of the reach of days in an era; prints that a partition should hold
#: (or words of a quarter as many titles); partitions of an era; prints that a row is counted for.
_ID_ERA, _ERA_REACHES, _PART_PRINTS, _MOST_PARTS, _ROW_PRINTS = -(1 << 20), 8, 1 << 18, 1 << 14, 14
#: Entries for the one task of a step; then nothing exchanges its rows. A larger step has a task for every fourth of as many.
_TASK_ROWS = 50_000
#: Probes are broadcast to the store up to so many bytes (counted from the step's titles); larger ones are shuffled.
_BROADCAST_BYTES = 64 << 20
#: Steps after which the driver's collectors are asked to run: Spark drops the broadcasts and shuffle files of finished
#: jobs when they find them, and many small jobs leave much of both before that happens by itself.
_RELEASE_STEPS = 2
#: Prints up to which a job counts as small. Planning and compiling is most of such a job, so it is planned once, run
#: uncompiled and in few partitions; a step has several of them, and the driver keeps what each leaves.
_SMALL_PRINTS = 1_000_000
_SMALL = {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.shuffle.partitions": "6"}


def title_words(title: Column) -> Column:
    """Hashes of the distinct words (runs of letters and digits, in lower case), sorted."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))


def paired(share: int) -> int:
    """Words of a fingerprint: two where titles of several words that share ``share`` tenths must have two in common, else one."""
    return 2 if share > 5 else 1


def winnowed(words: list[int], frequent: dict[int, int], share: int) -> list[int]:
    """The words of a set that fingerprints are made of: the first ones in the fixed order, as many as ``share`` tenths ask for."""
    return sorted(words, key=lambda x: (frequent.get(x, 0), x))[: len(words) - (share * len(words) + 9) // 10 + paired(share)]


class _Folders(AccumulatorParam):
    """Counts by folder, each folder once."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, one: dict, other: dict) -> dict:  # noqa: N802
        one.update(other)
        return one


@contextmanager
def _suited(spark: SparkSession, small: bool) -> Iterator[None]:
    """The session with the settings of small jobs, if so; those from before come back."""
    before = {name: spark.conf.get(name) for name in _SMALL} if small else {}
    try:
        for name in before:
            spark.conf.set(name, _SMALL[name])
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class HistoryStore:
    """The accepted entries and their fingerprints below ``path`` (in a folder that all executors share).

    ``share_tenths``: least part of the words of both titles that must be common. ``days``: most days apart. A path
    that holds a store already must have been written with the same two.
    """

    def __init__(self, spark: SparkSession, path: str, share_tenths: int = 6, days: int = 3):
        self.spark, self.path, self.share, self.days = spark, path.rstrip("/"), share_tenths, days
        self.era_days = _ERA_REACHES * (days + 1)
        self.steps, self.levels, self.order = 0, [], None
        #: Stored prints in the folders that each step of this object looked into.
        self.looked_at: list[int] = []
        states = [n for n in names(spark, self.path) if n.startswith("state-") and n.endswith(".json")]
        if states:
            held = json.loads(read_small(spark, f"{self.path}/{states[-1]}"))
            if (held["share"], held["days"]) != (share_tenths, days):
                raise ValueError(f"{path} was written with share {held['share']} and days {held['days']}")
            if held.get("paired") != paired(share_tenths):
                raise ValueError(f"{path} was written with other fingerprints")
            self.steps, self.levels = held["steps"], held["levels"]
            self.order = {int(k): n for k, n in json.loads(read_small(spark, f"{self.path}/order.json")).items()}

    # -- fingerprints ------------------------------------------------------------------------------------------

    def prepared(self, entries: DataFrame, *more: str) -> DataFrame:
        """entry_seq, idh, day, words (and ``more`` columns) of every entry, each entry_seq once (of each ``more``); nulls where a part is missing."""
        rows = entries.where("entry_seq is not null").select("entry_seq", "id", "title", "event_date", *more).dropDuplicates(["entry_seq", *more])
        rows = instants.with_instant(rows, "event_date", F.lit("UTC"), F.lit(True))
        day, words = F.floor(F.col("utc_us") / 86_400_000_000).cast("int"), title_words(F.col("title"))
        rows = rows.select("entry_seq", F.when(F.col("id").isNotNull(), F.xxhash64(F.lit("id"), "id")).alias("idh"), day.alias("day"), words.alias("words"), *more)
        rows = rows.withColumn("words", F.when(F.size("words") > 0, F.col("words")))  # apart, or the title is read for either use
        return rows.withColumn("wc", F.when(F.col("words").isNotNull() & F.col("day").isNotNull(), F.xxhash64("words", "day")))

    def fix_order(self, prepared: DataFrame) -> None:
        """Fixes the order of words by those in more than a thousandth of the first step's titles, with their counts.

        At most a thousand times a title's words can be so frequent, so the table is bounded. It never changes again.
        """
        if self.order is None:
            titles = prepared.where("words is not null")
            least = max(titles.count() // 1000, 20)
            counts = titles.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") > least)
            self.order = {r["word"]: r["count"] for r in counts.toLocalIterator()}
            write_small(self.spark, f"{self.path}/order.json", json.dumps(self.order))

    def _paired(self, classes: DataFrame, *more: str) -> DataFrame:
        """One row per pair of chosen words w, v: wc, day, late, and ``at``: day, number of words and place (of v, less one) in one number."""
        rows = classes.selectExpr(*more, "wc", "day", "size(words) as wn", "picked", "posexplode(picked) as (i, w)")
        if paired(self.share) == 2:
            rows = rows.selectExpr(*more, "wc", "day", "wn", "i", "w", "posexplode(if(size(picked) = 1, picked, slice(picked, i + 2, size(picked)))) as (j, v)")
        else:
            rows = rows.selectExpr("*", "0 as j", "w as v")
        late = f"cast(i + j > wn - ({2 * self.share} * wn + {9 + self.share}) div {10 + self.share} as int)"
        return rows.selectExpr(*more, "wc", "day", "w", "v", f"{late} as late", "shiftleft(cast(day as bigint), 36) + shiftleft(cast(wn as bigint), 18) + (i + j) as at")

    def _prints(self, classes: DataFrame, *more: str) -> DataFrame:
        """One row per fingerprint: wc, late, at, era, fp."""
        return self._paired(classes, *more).selectExpr(*more, "wc", "late", "at", f"cast(floor(day / {self.era_days}) as int) as era", "xxhash64(w, v, late) as fp")

    def _probes(self, classes: DataFrame, *more: str, early: bool = False) -> DataFrame:
        """The fingerprints, with columns as in ``_prints``, that alike titles may have: in all eras within reach, and late ones only of early pairs.

        Among themselves, titles meet by those of their ``early`` pairs alone: of two that meet, one has an early pair.
        """
        eras = ", ".join(f"cast(floor((day {sign} {self.days}) / {self.era_days}) as int)" for sign in "-+")
        rows = self._paired(classes, *more).where("late = 0" if early else "true")
        rows = rows.selectExpr(*more, "wc", "day", "at", "w", "v", "explode(if(late = 0, array(0, 1), array(0))) as late")
        return rows.selectExpr(*more, "wc", "late", "at", f"explode(array_distinct(array({eras}))) as era", "xxhash64(w, v, late) as fp")

    def _near(self, prefix: str) -> str:
        """Whether two titles that share a fingerprint may be alike, by dates and numbers of words; the other's columns have a prefix.

        If it is made of the earliest words that they share, at most the words from there on can be common; the meeting at
        the earliest shared words always passes this bound, so no pair is lost.
        """
        day, words, place = (lambda of, part=part: part.format(of) for part in ("shiftright({}, 36)", "(shiftright({}, 18) & 262143)", "({} & 262143)"))
        most = ", ".join(f"{words(of)} - {place(of)}" for of in ("at", f"{prefix}at"))
        return f"abs({day('at')} - {day(f'{prefix}at')}) <= {self.days} and least({most}) * {10 + self.share} >= ({words('at')} + {words(f'{prefix}at')}) * {self.share}"

    def _alike(self, prefix: str) -> str:
        """Whether two titles share enough words."""
        return f"size(array_intersect(words, {prefix}words)) * {10 + self.share} >= (size(words) + size({prefix}words)) * {self.share}"

    def staged(self, prepared: DataFrame, at: str, files: int = 8) -> None:
        """Writes the tables ``entries``, ``classes`` and ``edges`` of each step below ``at``, each in a folder ``batch=N``.

        ``prepared`` has a column batch besides, the step. Edges join the classes (key, nb) of a step that are alike, each
        pair in both directions, each such class with itself, and each class or id of several entries with itself.
        ``open`` entries have such an id or class; no other of their step can decide about the rest.
        """
        frequent, share = self.order, self.share

        @F.pandas_udf(_LONGS)
        def picked(words):
            return words.map(lambda w: winnowed(w, frequent, share))

        spread = lambda rows, by: rows.repartition("batch", F.pmod(by, F.lit(files)))  # noqa: E731  # few files a step
        classes = prepared.where("wc is not null").groupBy("batch", "wc").agg(F.first("day").alias("day"), F.first("words").alias("words"), F.count("*").alias("n"))
        classes = classes.withColumn("picked", picked("words"))
        spread(classes, "wc").write.partitionBy("batch").parquet(f"{at}/classes")
        classes = self.spark.read.schema(f"{_CLASS}, n bigint, batch int").parquet(f"{at}/classes")
        narrow = lambda rows, prefix="": rows.selectExpr("xxhash64(fp, era, batch) as meet", f"wc as {prefix}wc", f"at as {prefix}at")
        met = narrow(self._prints(classes, "batch")).join(narrow(self._probes(classes, "batch", early=True), "nb_"), "meet").where(f"wc <> nb_wc and {self._near('nb_')}")
        met = met.selectExpr("least(wc, nb_wc) as wc", "greatest(wc, nb_wc) as nb_wc").distinct()
        words = classes.select("batch", "wc", "words")
        met = words.join(met, "wc").join(words.selectExpr("batch", "wc as nb_wc", "words as nb_words"), ["batch", "nb_wc"]).where(self._alike("nb_"))
        pairs = "struct(wc as key, nb_wc as nb), struct(nb_wc as key, wc as nb), struct(wc as key, wc as nb), struct(nb_wc as key, nb_wc as nb)"
        shared = prepared.where("idh is not null").groupBy("batch", "idh").agg(F.count("*").alias("n")).where("n > 1")
        every = met.selectExpr("batch", f"inline(array({pairs}))").unionByName(classes.where("n > 1").selectExpr("batch", "wc as key", "wc as nb"))
        every = every.distinct().unionByName(shared.selectExpr("batch", "idh as key", "idh as nb"))
        spread(every, "key").write.partitionBy("batch").parquet(f"{at}/edges")
        open_keys = self.spark.read.schema(f"{_EDGE}, batch int").parquet(f"{at}/edges").where("key = nb").select("batch", "key")
        entries = prepared.select("batch", "entry_seq", "idh", "wc")
        for name in ("idh", "wc"):
            entries = entries.join(open_keys.select("batch", F.col("key").alias(name), F.lit(True).alias(f"open_{name}")), ["batch", name], "left")
        entries = entries.selectExpr("batch", "entry_seq", "idh", "wc", "coalesce(open_idh, open_wc, false) as open")
        spread(entries, "entry_seq").write.partitionBy("batch").parquet(f"{at}/entries")

    # -- the stored levels ---------------------------------------------------------------------------------------

    def _levels(self, kind: str, schema: str, levels: list[dict]) -> DataFrame:
        """The tables ``prints``, ``words`` or ``filters`` of some levels, in one scan. A level of ids alone has no words."""
        levels = [level for level in levels if kind != "words" or level["words"]]
        if not levels:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/step={level['step']}/kind={kind}" for level in levels])

    def _positives(self, probes: DataFrame, rows: int, small: bool) -> DataFrame:
        """The probes (era, late, fp, key, at) that the filters of their partition may hold, with step and dir of it.

        The step's fingerprints go to the filters, in packets of about a million (one for each filter, mostly, for a filter
        goes with each of its packets); filters are read where they lie.
        """
        where = ", ".join(f"struct('{level['step']}' as step, {_dir('fp', level['spread'])} as part, pmod(shiftright(fp, 20), {-(-rows * 2 * _ROW_PRINTS // (level['spread'] * 1_000_000))}) as packet)" for level in self.levels)
        probes = probes.selectExpr("struct(fp, key, at) as probe", f"inline(array({where}))").repartition("step", "part", "packet")
        packed = probes.groupBy("step", "part", "packet").agg(F.collect_list("probe").alias("probes"))
        looked_at = self._looked_at = self.spark.sparkContext.accumulator({}, _Folders())

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    held = batch["probes"][row].values
                    found = held.filter(pa.array(_held(np.frombuffer(batch["bits"][row].as_buffer(), np.uint8), held.field("fp").to_numpy())))
                    if len(found):
                        looked_at.add({(batch["step"][row].as_py(), batch["part"][row].as_py()): batch["n"][row].as_py()})
                    same = [pa.repeat(batch[c][row], len(found)) for c in ("step", "part")]
                    yield pa.RecordBatch.from_arrays([*same, *found.flatten()], names=["step", "dir", "fp", "key", "at"])

        joined = self._levels("filters", _FILTER, self.levels).join(F.broadcast(packed) if small else packed, ["step", "part"])
        screened = joined.select("step", "part", "n", "probes", "bits").mapInArrow(screen, "step string, dir bigint, fp bigint, key bigint, at bigint")
        return screened.where("key is not null")

    def _known(self, entries: DataFrame, classes: DataFrame, rows: int, weight: int, eras: tuple[int, int]) -> DataFrame:
        """``entries`` with kept_seq, the first stored entry that each repeats, or null.

        ``weight``: most bytes of the step's probes. A probe may be positive in every level.
        """
        small = weight * len(self.levels) <= _BROADCAST_BYTES
        asking = F.broadcast if small else lambda x: x
        ids = entries.where("idh is not null").select("idh").distinct()
        ids = ids.selectExpr("idh as key", "0 as late", "0L as at", f"{_ID_ERA} as era", "idh as fp")
        positives = self._positives(self._probes(classes).withColumnRenamed("wc", "key").unionByName(ids), rows, small)
        first, last = ((era + shift) * 2 * _MOST_PARTS for era, shift in zip(eras, (0, 1), strict=True))
        within = f"dir >= {first} and dir < {last} or dir < {(_ID_ERA + 1) * 2 * _MOST_PARTS}"
        stored = self._levels("prints", _PRINT, self.levels).where(within).selectExpr("step", "dir", "fp", "era", "entry_seq as old_seq", "at as old_at")
        met = stored.join(asking(positives), ["step", "dir", "fp"]).where(f"era = {_ID_ERA} or {self._near('old_')}")
        met = met.selectExpr(f"era = {_ID_ERA} as sure", "key", "old_seq", "step", f"case step {' '.join(f"when '{x['step']}' then {_dir('old_seq', _words_spread(x['spread']), '0')}" for x in self.levels)} end as dir")
        met = met.groupBy("key", "old_seq", "step", "dir").agg(F.max("sure").alias("sure"))
        words = self._levels("words", _PRINT, self.levels).where(within).selectExpr("step", "dir", "entry_seq as old_seq", "words as old_words")
        pairs = met.where("not sure").join(classes.selectExpr("wc as key", "words").hint("shuffle_hash"), "key")
        alike = words.join(asking(pairs), ["step", "dir", "old_seq"]).where(self._alike("old_"))
        hits = met.where("sure").select("key", "old_seq").unionByName(alike.select("key", "old_seq"))
        known = hits.groupBy("key").agg(F.min("old_seq").alias("old_seq"))
        asked = entries.selectExpr("*", "explode(array(idh, wc)) as key")
        return asked.join(known, "key", "left").groupBy(*entries.columns).agg(F.min("old_seq").alias("kept_seq"))

    # -- a step --------------------------------------------------------------------------------------------------

    def add(self, entries: DataFrame) -> DataFrame:
        """Takes in entries (entry_seq, id, title, event_date) that all come after those taken in before.

        Returns kept_seq, dup_seq of those not accepted; the rows lie in the store's folder.
        """
        prepared = kept(self.prepared(entries).withColumn("batch", F.lit(0)), "prepared")
        self.fix_order(prepared)
        return repeats_in(self.spark, self.take_all(prepared))

    def _steps(self, sizes: list) -> list[list]:
        """The waiting batches (with their numbers of rows) by step: whole batches, until a step has as many rows as were stored before it."""
        stored, steps, taken = sum(level["prints"] for level in self.levels) // _ROW_PRINTS, [], 0
        for size in sizes:
            if not steps or taken >= stored:
                steps.append([])
                stored, taken = stored + taken, 0
            steps[-1].append(size)
            taken += size["rows"]
        return steps

    def take_all(self, prepared: DataFrame) -> list[str]:
        """Takes in the batches of a kept table of prepared entries, step by step; the folders of their repeats."""
        eras = lambda x: F.floor(x / self.era_days)
        words = F.when(F.col("wc").isNotNull(), F.size("words")).otherwise(0)
        chosen = words - F.ceil(words * self.share / 10) + 2
        weight = F.sum(chosen * (chosen - 1) * 2 * 56)
        sizes = prepared.groupBy("batch").agg(F.count("*").alias("rows"), weight.alias("weight"), eras(F.min("day") - self.days).alias("first"), eras(F.max("day") + self.days).alias("last")).orderBy("batch").collect()
        at, out, steps = scratch_path(self.spark, "batches"), [], self._steps(sizes)
        if steps:
            number = sum((F.col("batch") >= step[0]["batch"]).cast("int") for step in steps[1:]) if steps[1:] else F.lit(0)
            self.staged(prepared.withColumn("batch", number), at, max(8, -(-max(sum(size["rows"] for size in step) for step in steps) // (4 * _TASK_ROWS))))
        dropped(prepared)
        there = {kind: set(names(self.spark, f"{at}/{kind}")) for kind in ("classes", "edges")}
        for number, step in enumerate(steps):
            own = lambda kind, schema, of=f"batch={number}": self.spark.read.schema(schema).parquet(f"{at}/{kind}/{of}") if of in there.get(kind, {of}) else self.spark.createDataFrame([], schema)
            rows, weight = (sum(size[c] for size in step) for c in ("rows", "weight"))
            days = [[size[c] for size in step if size[c] is not None] for c in ("first", "last")]
            out.append(self._take(own("entries", _ENTRY), own("classes", _CLASS), own("edges", _EDGE), rows, weight, (min(days[0], default=0), max(days[1], default=0))))
            if len(out) % _RELEASE_STEPS == 0:
                gc.collect()
                self.spark._jvm.System.gc()
        remove(self.spark, at)
        return out

    def _take(self, entries: DataFrame, classes: DataFrame, edges: DataFrame, rows: int, weight: int, eras: tuple[int, int]) -> str:
        """One step over its staged tables; the folder of its repeats."""
        tasks = 1 if rows <= _TASK_ROWS else -(-rows * 4 // _TASK_ROWS)
        entries, classes, edges = (x.coalesce(tasks) for x in (entries, classes, edges))
        seen = None
        if self.levels:
            with _suited(self.spark, rows <= _TASK_ROWS):
                seen = kept(self._known(entries, classes, rows, weight, eras), "seen")
            self.looked_at.append(sum(self._looked_at.value.values()))
            entries = seen.coalesce(tasks)
            known = entries.where("kept_seq is not null").selectExpr("kept_seq", "entry_seq as dup_seq")
            entries = entries.where("kept_seq is null")
        else:
            known = self.spark.createDataFrame([], _REPEAT)
            self.looked_at.append(0)
        crowd = entries.where("open").select("entry_seq", "idh", "wc")
        with _suited(self.spark, rows <= _TASK_ROWS):
            settled, rounds = self._settled(crowd, edges, tasks)
        new = self._nearest(settled, crowd, edges, tasks).where("by < entry_seq").selectExpr("by as kept_seq", "entry_seq as dup_seq")
        path = self._extended(entries.where("not open").select("entry_seq", "idh", "wc").unionByName(settled).coalesce(tasks), classes, known.unionByName(new), rows)
        dropped(seen)
        for at in rounds:
            remove(self.spark, at)
        return path

    @staticmethod
    def _nearest(rows: DataFrame, to: DataFrame, edges: DataFrame, tasks: int) -> DataFrame:
        """``to`` (entry_seq, idh, wc) with ``by``: the least entry of ``rows`` with its id, or in its or a like class.

        All come in ``tasks`` partitions; where that is one, nothing is exchanged and nothing broadcast.
        """
        keyed = lambda x: x.selectExpr("entry_seq", "idh", "wc", "explode(array(idh, wc)) as key")
        least = keyed(rows).where("key is not null").groupBy("key").agg(F.min("entry_seq").alias("least")).withColumnRenamed("key", "nb")
        marks = edges.join(least.hint("shuffle_hash"), "nb").coalesce(tasks).groupBy("key").agg(F.min("least").alias("least"))
        return keyed(to).join(marks.hint("shuffle_hash"), "key", "left").coalesce(tasks).groupBy("entry_seq", "idh", "wc").agg(F.min("least").alias("by"))

    def _settled(self, crowd: DataFrame, edges: DataFrame, tasks: int) -> tuple[DataFrame, list[str]]:
        """The accepted among entries that no stored one matches but others of their step may, and the folders of the rounds.

        In entry_seq order, an entry is accepted unless an accepted earlier one shares its id or is alike. In each
        round, entries with no undecided earlier neighbour are accepted and what they match drops out; a round writes
        one table. A class counts by its least entry, so it may be of any size.
        """
        waiting, rounds, schema = crowd, [], "entry_seq bigint, idh bigint, wc bigint"
        read = lambda *paths: self.spark.read.schema(schema).parquet(*paths).coalesce(tasks)
        while True:
            seen = self._nearest(waiting, waiting, edges, tasks)
            first = seen.where("by is null or by = entry_seq").drop("by")
            after = self._nearest(first, seen.where("by < entry_seq").drop("by"), edges, tasks).where("by is null").drop("by")
            at = scratch_path(self.spark, "round")
            first.withColumn("state", F.lit("accepted")).unionByName(after.withColumn("state", F.lit("waiting"))).write.partitionBy("state").parquet(at)
            rounds.append(at)
            if "state=waiting" not in names(self.spark, at):
                break
            waiting = read(f"{at}/state=waiting")
        accepted = [f"{at}/state=accepted" for at in rounds if "state=accepted" in names(self.spark, at)]
        return read(*accepted) if accepted else self.spark.createDataFrame([], schema), rounds

    def _extended(self, accepted: DataFrame, classes: DataFrame, repeats: DataFrame, rows: int) -> str:
        """Writes a step's repeats and one more level: the prints of the accepted, those of merged levels, and their filters."""
        size, merged, levels = rows * _ROW_PRINTS, [], list(self.levels)
        for level in reversed(levels):
            if level["prints"] >= 2 * (size + sum(x["prints"] for x in merged)):
                break
            merged.append(level)
        if len(merged) > 1:
            levels, size = levels[: -len(merged)], size + sum(x["prints"] for x in merged)
        else:
            merged = []
        spread = min(1 << max(0, (size // _PART_PRINTS).bit_length()), _MOST_PARTS)
        titles = classes.join(accepted.where("wc is not null").select("wc", "entry_seq").hint("shuffle_hash"), "wc")
        columns = ["entry_seq", "late", "at", "era", "fp"]
        prints = self._prints(titles, "entry_seq").select(*columns)
        prints = prints.unionByName(accepted.where("idh is not null").selectExpr("entry_seq", "0 as late", "0L as at", f"{_ID_ERA} as era", "idh as fp"))
        words = titles.selectExpr("entry_seq", f"cast(floor(day / {self.era_days}) as int) as era", "words")
        if merged:
            prints = prints.unionByName(self._levels("prints", _PRINT, merged).select(*columns))
            words = words.unionByName(self._levels("words", _PRINT, merged).select("entry_seq", "era", "words"))
        out = prints.withColumns({"kind": F.lit("prints"), "dir": F.expr(_dir("fp", spread))})
        for kind, more, to in (("words", words, _dir("entry_seq", _words_spread(spread), "0")), ("repeats", repeats, "0L")):
            out = out.unionByName(more.withColumns({"kind": F.lit(kind), "dir": F.expr(to)}), allowMissingColumns=True)
        step = uuid.uuid4().hex
        files = F.expr(f"if(kind = 'repeats', pmod(dup_seq, {-(-rows // (20 * _TASK_ROWS))}), 0)")
        with _suited(self.spark, size <= _SMALL_PRINTS and rows <= _TASK_ROWS):
            out.repartition("kind", "dir", files).sortWithinPartitions("kind", "dir", "fp").write.partitionBy("kind", "dir").parquet(f"{self.path}/step={step}")
            there = names(self.spark, f"{self.path}/step={step}")
            if "kind=prints" in there:
                self._levels("prints", _PRINT, [{"step": step}]).select("dir", "fp").groupBy("dir").applyInArrow(_filter, "part bigint, n bigint, bits binary").write.parquet(f"{self.path}/step={step}/kind=filters/dir=0")
        self.steps, self.levels = self.steps + 1, [*levels, {"step": step, "spread": spread, "prints": size, "words": "kind=words" in there}] if "kind=prints" in there else levels
        state = {"share": self.share, "days": self.days, "paired": paired(self.share), "steps": self.steps, "levels": self.levels}
        write_small(self.spark, f"{self.path}/state-{self.steps:09d}.json", json.dumps(state))
        for level in merged:  # the repeats of its step stay
            for kind in ("prints", "words", "filters"):
                remove(self.spark, f"{self.path}/step={level['step']}/kind={kind}")
        return f"{self.path}/step={step}/kind=repeats/dir=0"


def _dir(of: str, spread: int, late: str = "late") -> str:
    """The folder of a print (or of the words) by its era, the hash ``of`` and kind of pair."""
    return f"((era * {_MOST_PARTS}L + pmod({of}, {spread})) * 2 + {late})"


def _words_spread(spread: int) -> int:
    return max(1, spread // 4)


def repeats_in(spark: SparkSession, paths: list[str]) -> DataFrame:
    """kept_seq, dup_seq of some steps."""
    paths = [p for p in paths if names(spark, p)]
    return spark.read.schema(_REPEAT).parquet(*paths) if paths else spark.createDataFrame([], _REPEAT)


def _places(values: np.ndarray, bits: int, hashes: int = 6) -> Iterator[np.ndarray]:
    """The places of each value in a Bloom filter of ``bits`` bits (a power of two)."""
    values = values.view(np.uint64)
    step = (values * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for k in range(hashes):
        yield ((values ^ (values >> np.uint64(29))) + np.uint64(k) * step >> np.uint64(7)) & np.uint64(bits - 1)


def _filled(values: np.ndarray) -> bytes:
    """A Bloom filter of distinct values, with 8 to 16 bits for each."""
    table = np.zeros(max(8, 1 << (len(values) - 1).bit_length()), np.uint8)
    for at in _places(values, len(table) * 8):
        np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return table.tobytes()


def _filter(rows: pa.Table) -> pa.Table:
    """The filter of one folder of prints."""
    return pa.table({"part": rows["dir"].slice(0, 1), "n": pa.array([rows.num_rows], pa.int64()), "bits": pa.array([_filled(np.unique(rows["fp"].to_numpy()))], pa.binary())})


def _held(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a Bloom filter may hold."""
    return np.logical_and.reduce([table[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in _places(values, len(table) * 8)]).astype(bool)


def repeated_entries(entries: DataFrame, path: str | None = None) -> DataFrame:
    """kept_seq, dup_seq: each entry that repeats an accepted earlier one, with the smallest such accepted entry.

    ``entries``: entry_seq, batch_no, id, title, event_date; batches follow each other in entry_seq order. The first is
    taken in alone, the later ones wait and are taken in by steps, each against the store that the steps before left. Null
    dates and titles match by id only, null ids match nothing; rows without entry_seq are left out and a repeated
    entry_seq counts once. What needs no store (words, days, classes of equal titles) is worked out for all steps at once.
    """
    spark = entries.sparkSession
    store = HistoryStore(spark, path or scratch_path(spark, "history"))
    prepared = kept(store.prepared(entries.withColumn("batch", F.coalesce("batch_no", F.lit(0))), "batch"), "prepared")
    store.fix_order(prepared.where(F.col("batch") == (prepared.agg(F.min("batch")).first()[0] or 0)))
    return repeats_in(spark, store.take_all(prepared))
