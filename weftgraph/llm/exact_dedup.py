"""Exact deduplication over disk-backed streaming state.

A call's documents are written once, numbered and with their digests, to the state's folder of contents; no text is hashed
again. From there (digest, identifier, locator) stream into a keyed aggregation whose state lives in RocksDB under the
checkpoint folder, with no watermark, so that nothing expires: per digest it retains the row that stays, the locator of the
row that came first, and the number of rows. A later call with the same ``state`` folder goes on from there. A locator
(call, row) names a row of the contents, whose bytes can be read again (``located``). Every hit (a row whose digest was seen
before, in this call or an earlier one) is checked against the full bytes at the locator; digests whose bytes differ are
remembered with the state and resolved by text.

Texts are equal when identical after lower-casing A-Z only. Defined results:

- null text counts as empty; empty texts are equal to each other;
- the row with the largest identifier stays, null identifiers below all others; of repeated rows (same identifier and
  text) exactly one stays;
- an empty table gives an empty result; extra columns are ignored by ``decide`` and kept by ``dedup``, whatever their names;
- decisions are those of all rows that the state has seen: a row that stayed in an earlier call may give way to a later one,
  which ``decisions`` tells for all calls. One writer at a time may use a state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import Scratch, ascii_lower, prepare, sha_hex

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Repeated digests are sent to all executors only up to this many (about 150 bytes each); beyond, the join shuffles.
BROADCAST_DIGESTS = 200_000
#: Rows of one digest that are compared with one copy of the text at its locator.
COMPARED = 256

Digest = Callable[[Column], Column]


def _session(spark: SparkSession, values: dict[str, str]) -> dict[str, str | None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    return before


def _restore(spark: SparkSession, before: dict[str, str | None]) -> None:
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class State:
    """The folder of a state: contents and collided digests by call, and the checkpoint of the stream."""

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType):
        prepare(spark)
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType([
            T.StructField("call", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("id", id_type),
            T.StructField("digest", T.StringType()), T.StructField("text", T.StringType()),
        ])

    def calls(self) -> dict[int, str]:
        """Finished writes of contents: their numbers with their folders' names."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        root = hadoop(f"{self.path}/contents")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return {int(n[:8]): n for n in sorted(names) if fs.exists(hadoop(f"{self.path}/contents/{n}/_SUCCESS"))}

    def contents(self, *calls: int, schema: T.StructType | None = None) -> DataFrame:
        """The stored rows of some calls, of all by default."""
        known = self.calls()
        paths = [f"{self.path}/contents/{known[c]}" for c in calls or known]
        schema = schema or self.schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def collided(self) -> DataFrame:
        """Digests that stand for several texts."""
        return self.spark.read.schema("digest string").parquet(f"{self.path}/collided/*").distinct()

    def store(self, docs: DataFrame, id_col: str, text_col: str, digest: Digest, name: str | None, rest: bool) -> int:
        """Writes a call's documents with their digests; the call's number. A name that has been stored isn't stored again."""
        known = self.calls()
        for number, folder in known.items():
            if name is not None and folder[9:] == name:
                return number
        number = max(known, default=0) + 1
        more = [c for c in docs.columns if rest and c not in (id_col, text_col)]
        rows = docs.select(
            F.lit(number).alias("call"), F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
            digest(ascii_lower(F.col(text_col))).alias("digest"), F.col(text_col).alias("text"),
            *([F.struct(*more).alias("rest")] if more else []),
        )
        rows.write.mode("overwrite").parquet(f"{self.path}/contents/{number:08d}" + (f"-{name}" if name else ""))
        return number

    def absorb(self) -> DataFrame:
        """Streams the contents that are new into the state; returns it as (digest, keep, held, group_size).

        ``keep`` is (id, call, row) of the row that stays, ``held`` the locator of the row that came first.
        """
        spark, checkpoint = self.spark, f"{self.path}/checkpoint"
        before = _session(
            spark,
            {
                "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
                "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
                "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
                # no preallocated files, and no store open after its task: small partitions then take little local disk
                "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
                "spark.sql.streaming.stateStore.unloadOnCommit": "true",
            },
        )
        try:
            arrivals = T.StructType([f for f in self.schema if f.name != "text"])
            stream = spark.readStream.schema(arrivals).parquet(f"{self.path}/contents/*")
            query = (
                stream.groupBy("digest")
                .agg(
                    F.max(F.struct("id", "call", "row")).alias("keep"), F.min(F.struct("call", "row")).alias("held"),
                    F.count(F.lit(1)).alias("group_size"),
                )
                .writeStream.format("noop")
                .outputMode("update")
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()
            stored = spark.read.format("statestore").load(checkpoint)
            value = [F.col(f"value.`{c}`") for c in stored.schema["value"].dataType.names]
            names = ("keep", "held", "group_size")
            return stored.select(F.col("key.digest").alias("digest"), *[v.alias(n) for v, n in zip(value, names, strict=True)])
        finally:
            _restore(spark, before)


def _repeated(scratch: Scratch, stored: DataFrame) -> DataFrame:
    """What the state holds of digests seen more than once, to be broadcast only while they are few."""
    repeated = scratch.table(stored.where("group_size > 1"), "repeated")
    return F.broadcast(repeated) if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS else repeated


def _at(locator: str) -> Column:
    return (F.col("call") == F.col(f"{locator}.call")) & (F.col("row") == F.col(f"{locator}.row"))


def _differing(state: State, repeated: DataFrame, call: int) -> DataFrame:
    """Digests of a call's rows whose bytes aren't those at the locator."""
    since = repeated.select("digest", "held", "group_size")
    needed = {call} | {r[0] for r in repeated.select("held.call").distinct().collect()}  # numbers of calls, not rows
    seen = state.contents(*sorted(needed)).select("call", "row", "digest", "text").join(since, "digest")
    # a digest with many rows is compared with several copies of its text, in as many tasks
    copies = F.ceil(F.col("group_size") / COMPARED).cast("int")
    seen = seen.withColumn("copies", copies).withColumn("norm", ascii_lower(F.col("text")))
    held = seen.where(_at("held")).select(
        "digest", F.col("norm").alias("first"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    )
    hits = seen.where((F.col("call") == call) & ~_at("held")).select(
        "digest", "norm", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int").alias("copy")
    )
    return hits.join(held, ["digest", "copy"]).where("norm <> first").select("digest").distinct()


def _decided(state: State, rows: DataFrame, repeated: DataFrame, collided: DataFrame | None) -> DataFrame:
    """Rows (call, row, id, digest, ...) with keep_id, group_size, kept and locator."""
    known = repeated.select("digest", F.col("keep").alias("_keep"), F.col("held").alias("_held"), F.col("group_size").alias("_n"))
    alone = F.col("_n").isNull()

    def added(frame: DataFrame) -> DataFrame:
        return frame.select(
            *rows.columns,
            F.when(alone, F.col("id")).otherwise(F.col("_keep.id")).alias("keep_id"),
            F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
            (alone | _at("_keep")).alias("kept"),
            F.when(alone, F.struct("call", "row")).otherwise(F.col("_held")).alias("locator"),
        )

    if collided is None:
        return added(rows.join(known, "digest", "left"))
    # the same decisions for digests that stand for several texts, by the texts themselves
    texts = state.contents().join(collided, "digest", "left_semi").withColumn("norm", ascii_lower(F.col("text")))
    groups = texts.groupBy("norm").agg(
        F.max(F.struct("id", "call", "row")).alias("_keep"), F.min(F.struct("call", "row")).alias("_held"), F.count(F.lit(1)).alias("_n")
    )
    odd = rows.join(collided, "digest", "left_semi").withColumn("norm", ascii_lower(F.col("text")))
    plain = rows.join(collided, "digest", "left_anti")
    return added(plain.join(known, "digest", "left")).unionByName(added(odd.join(groups, "norm")))


def _taken(
    scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, digest: Digest, state: str | None, name: str | None, rest: bool
) -> tuple[State, int, DataFrame, DataFrame | None]:
    """Stores and absorbs a call: the state, the call's number, repeated digests, and collided ones if there are any."""
    held = State(docs.sparkSession, state or scratch.path("state"), docs.schema[id_col].dataType)
    number = held.store(docs, id_col, text_col, digest, name, rest)
    repeated = _repeated(scratch, held.absorb())
    _differing(held, repeated, number).write.mode("overwrite").parquet(f"{held.path}/collided/{number:08d}")
    collided = held.collided()
    return held, number, repeated, None if collided.isEmpty() else collided


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", "keep_id", "group_size", "kept", "digest", "locator")


def decide(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Digest = sha_hex,
    state: str | None = None,
    name: str | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest, locator (of the first row of its text).

    With a ``state`` folder the rows of earlier calls count too. A call that is repeated under its ``name``, after a failure
    say, is not counted twice.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    held, number, repeated, collided = _taken(scratch, docs, id_col, text_col, digest, state, name, False)
    return _shown(_decided(held, held.contents(number), repeated, collided))


def decisions(spark: SparkSession, state: str, id_type: T.DataType | None = None) -> DataFrame:
    """The decisions on all rows that a state has seen, with the number of their call."""
    scratch = Scratch(spark, "exact")
    held = State(spark, state, id_type or T.LongType())
    repeated, collided = _repeated(scratch, held.absorb()), held.collided()
    rows = _decided(held, held.contents(), repeated, None if collided.isEmpty() else collided)
    return rows.select("call", "id", "keep_id", "group_size", "kept", "digest", "locator")


def located(spark: SparkSession, state: str, locators: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """(locator, id, text) of the stored rows that a frame's column ``locator`` names."""
    held = State(spark, state, id_type or T.LongType())
    wanted = locators.select("locator").distinct()
    calls = [r[0] for r in wanted.select("locator.call").distinct().collect()]  # numbers of calls, not rows
    if not calls:
        return wanted.select("locator", F.lit(None).cast(held.schema["id"].dataType).alias("id"), F.lit("").alias("text")).limit(0)
    rows = held.contents(*sorted(calls)).select(F.struct("call", "row").alias("locator"), "id", "text")
    return rows.join(wanted, "locator", "left_semi")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Digest = sha_hex) -> DataFrame:
    """The rows that stay, with all columns of the input, read from the state's contents."""
    scratch = Scratch(docs.sparkSession, "stays")
    held, number, repeated, collided = _taken(scratch, docs, id_col, text_col, digest, None, None, True)
    rest = [f for f in docs.schema if f.name not in (id_col, text_col)]
    schema = T.StructType([*held.schema, *([T.StructField("rest", T.StructType(rest))] if rest else [])])
    stays = _decided(held, held.contents(number, schema=schema), repeated, collided).where("kept")
    own = {id_col: F.col("id"), text_col: F.col("text")}
    return stays.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
