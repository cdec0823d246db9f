"""The same point-in-time semantics on Structured Streaming.

Every function takes and returns a (streaming) DataFrame, so it can be tested as a batch. ``run_available`` drains what
has arrived into a Parquet table in the shared folder, with its checkpoint beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over one table of a folder; the schema is that of the files already there."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def table_of(rows: DataFrame, name: str) -> DataFrame:
    """A stream over rows that are written first."""
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


def with_heartbeat(stream: DataFrame, clock: DataFrame, ts: str) -> DataFrame:
    """The stream and rows of a clock that hold only a time: they move the watermark where no events do.

    A heartbeat lies in a window that is still open, so no window with it is written.
    """
    return stream.unionByName(clock.select(F.col(ts)), allowMissingColumns=True)


def run_available(stream: DataFrame, name: str, mode: str = "append", rocksdb: bool = False, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available, then return the written table. Update mode keeps the batch number of each row.

    A batch is written under its own number, so a replayed batch overwrites itself instead of appending twice. With the
    caller's ``out`` and ``checkpoint`` a later run goes on where this one stopped: it reads only new files, and windows
    that are still open now are written once it has seen their end. Without them both are new.
    """
    spark = stream.sparkSession
    if (out is None) != (checkpoint is None):
        raise ValueError("out and checkpoint belong together")
    out, checkpoint = out or new_folder(spark, name), checkpoint or new_folder(spark, name + "-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    previous = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    if rocksdb:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            def sink(batch: DataFrame, number: int) -> None:
                batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

            query = writer.foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        if rocksdb and previous is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", previous)
        elif rocksdb:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(stream.schema).parquet(out) if mode == "append" else spark.read.parquet(out)


def latest_version(table: DataFrame, keys: list[str]) -> DataFrame:
    """Current view of an update-mode table: the row of the newest batch per key."""
    from tidemark.operators.ranking import latest_per_key

    return latest_per_key(table, keys, ["batch"]).drop("batch")


def split_records(lines: DataFrame, good_path: str, bad_path: str, checkpoint: str):
    """Validated record stream and rejected stream from text lines: a micro-batch is parsed and tagged once."""
    from tidemark.sources.market import tag_records

    keep = [c for c in lines.columns if c != "value"]

    def sink(batch: DataFrame, number: int) -> None:
        tagged = tag_records(batch).persist()
        tagged.filter(F.size("violations") == 0).drop("violations", "value").write.mode("overwrite").parquet(f"{good_path}/batch={number}")
        tagged.filter(F.size("violations") > 0).select(*keep, "value", "violations").write.mode("overwrite").parquet(f"{bad_path}/batch={number}")
        tagged.unpersist()

    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Drop repeats of a content key that arrive within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def latest_book(stream: DataFrame, key: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Newest book per key (update mode); a book that is older or as old as the stored one changes nothing."""
    return stream.groupBy(*key).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("book"))


def first_prediction(stream: DataFrame, key: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Earliest prediction per key (update mode)."""
    return stream.groupBy(*key).agg(F.min_by(F.struct(*value), F.struct(*order)).alias("prediction"))


KEPT_SCHEMA = "key long, id long, ts_us long"


def kept_processor(newest: bool):
    """The newest (or first) row of each open market: rows key, ts_us, id, close_us (null: open end); rows from the close on do not count.

    State is one row a key, dropped by an event-time timer at the close. A better row is sent as it comes (update mode).
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import LongType, StructField, StructType

    never = 2**63 - 1

    class Kept(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.kept = handle.getValueState("kept", StructType([StructField(n, LongType()) for n in ("ts", "id", "close")]))

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows))
            closes = batch["close_us"].astype("Int64").fillna(never).tolist()
            found = [(int(t), int(i), int(c)) for t, i, c in zip(batch["ts_us"].tolist(), batch["id"].tolist(), closes) if t < c]
            held = tuple(self.kept.get()) if self.kept.exists() else None
            best = (max if newest else min)(found + ([held] if held else []), default=None)
            if best is None:
                return
            if best[:2] != (held or (None, None))[:2]:
                yield pd.DataFrame([(key[0], best[1], best[0])], columns=["key", "id", "ts_us"])
            if best[2] <= timerValues.getCurrentWatermarkInMs() * 1000:
                self.kept.clear()
            elif best != held:
                self.kept.update(best)
                if best[2] < never:
                    self.handle.registerTimer(best[2] // 1000 + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.kept.exists() and self.kept.get()[2] <= timerValues.getCurrentWatermarkInMs() * 1000:
                self.kept.clear()
            yield from ()

        def close(self) -> None:
            pass

    return Kept()


def kept_until_close(stream: DataFrame, newest: bool, watermark: str) -> DataFrame:
    """Newest book (or first prediction) of each market until its close (update mode, RocksDB): stream has key, ts, id, close.

    The bounded form of ``latest_book`` and ``first_prediction``: a closed market leaves no state. Rows with a null key, ts
    or id are dropped; rows older than the watermark too.
    """
    rows = stream.where("key IS NOT NULL AND id IS NOT NULL").withWatermark("ts", watermark)
    rows = rows.select("key", "ts", "id", F.unix_micros("ts").alias("ts_us"), F.unix_micros("close").alias("close_us"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=kept_processor(newest), outputStructType=KEPT_SCHEMA, outputMode="Update", timeMode="EventTime")


SLOTS = 4096
SLOT_ROWS = 8192
CHUNK = 10_000


def slots_for(rows: int) -> int:
    """Slots for a table of so many rows: some thousand rows each, however large the table."""
    return max(64, -(-rows // SLOT_ROWS))


def by_slot(rows: DataFrame, slots: int):
    """Rows grouped by a hash of their key: one call of a processor and one round of state calls serve many keys.

    State lies under the slot, so one checkpoint needs the same number of slots for all its runs.
    """
    return rows.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots))).groupBy("slot")


def slot_rows():
    """Class of a slot's rows in a list state: long columns, as arrays of up to ``CHUNK`` rows an element."""
    import numpy as np
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    class SlotRows:
        def __init__(self, handle, name: str, columns: tuple[str, ...]) -> None:
            self.width = len(columns)
            self.state = handle.getListState(name, StructType([StructField(c, ArrayType(LongType())) for c in columns]))

        def load(self) -> np.ndarray:
            parts = [np.array(r, np.int64).T for r in self.state.get()] if self.state.exists() else []
            return np.concatenate([np.empty((0, self.width), np.int64), *parts])

        def store(self, rows: np.ndarray) -> None:
            if len(rows):
                self.state.put([tuple(rows[i : i + CHUNK].T.tolist()) for i in range(0, len(rows), CHUNK)])
            else:
                self.state.clear()

    return SlotRows


def first_answer_processor(gap_us: int):
    """Stateful search for the earliest answer of each waiting row, for the keys of a slot at once.

    Rows: key, ts_us, id, is_answer, until_us (the largest long: for ever). A waiting row is answered by its key's first
    answer (by ts, id) at least ``gap_us`` later and before ``until_us``. State: waiting rows with their earliest answer so
    far, until the watermark has passed that answer or their end, and answers that a waiting row may still ask for. An
    answer is sent when it is found, and again when an earlier one arrives: the newest row of an id is right.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    never, SlotRows = np.iinfo(np.int64).max, slot_rows()

    class FirstAnswer(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = SlotRows(handle, "waiting", ("key", "id", "ts", "until", "best_ts", "best_id"))
            self.answers = SlotRows(handle, "answers", ("key", "ts", "id"))

        def _store(self, waiting: np.ndarray, answers: np.ndarray, mark_us: int) -> None:
            open_ = (waiting[:, 3] > mark_us) & (waiting[:, 4] >= mark_us)
            waiting, answers = waiting[open_], answers[answers[:, 1] >= mark_us + gap_us]
            self.waiting.store(waiting)
            self.answers.store(answers)
            ends = np.concatenate((np.minimum(waiting[:, 3], waiting[:, 4]), answers[:, 1] - gap_us + 1))
            ends = ends[ends < never]
            if len(ends):  # what is over first; a timer in the past would fire at once and again
                self.handle.registerTimer(int(max(ends.min(), mark_us) // 1000 + 1))

        @staticmethod
        def _next(waiting: np.ndarray, answers: np.ndarray):
            """Answers by (key, ts, id), and for each waiting row the place of the first one that is late enough."""
            column = lambda w, a: np.concatenate((w, a))
            is_answer = np.arange(len(waiting) + len(answers)) >= len(waiting)
            order = np.lexsort((column(waiting[:, 1], answers[:, 2]), is_answer, column(waiting[:, 2] + gap_us, answers[:, 1]), column(waiting[:, 0], answers[:, 0])))
            before = np.empty(len(order), np.int64)
            before[order] = np.cumsum(is_answer[order])
            return answers[order[is_answer[order]] - len(waiting)], before[: len(waiting)]

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows))
            is_answer = batch["is_answer"].to_numpy(bool)
            columns = lambda which, *names: np.stack([batch[n].to_numpy(np.int64)[which] for n in names], axis=1)
            fresh = columns(~is_answer, "key", "id", "ts_us", "until_us")
            waiting = np.concatenate((self.waiting.load(), np.concatenate((fresh, np.full((len(fresh), 2), never)), axis=1)))
            answers = np.concatenate((self.answers.load(), columns(is_answer, "key", "ts_us", "id")))
            if len(waiting) and len(answers):
                answers, at = self._next(waiting, answers)
                found = answers[np.minimum(at, len(answers) - 1)]
                earlier = (found[:, 1] < waiting[:, 4]) | (found[:, 1] == waiting[:, 4]) & (found[:, 2] < waiting[:, 5])
                better = (at < len(answers)) & (found[:, 0] == waiting[:, 0]) & (found[:, 1] < waiting[:, 3]) & earlier
                waiting[better, 4:] = found[better, 1:]
                if better.any():
                    w = waiting[better]
                    yield pd.DataFrame({"key": w[:, 0], "id": w[:, 1], "ts_us": w[:, 2], "answer_id": w[:, 5], "answer_ts_us": w[:, 4]})
            self._store(waiting, answers, timerValues.getCurrentWatermarkInMs() * 1000)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self._store(self.waiting.load(), self.answers.load(), timerValues.getCurrentWatermarkInMs() * 1000)
            yield from ()

        def close(self) -> None:
            pass

    return FirstAnswer()


FIRST_ANSWER_SCHEMA = "key long, id long, ts_us long, answer_id long, answer_ts_us long"


def first_answer(waiting: DataFrame, answers: DataFrame, gap_us: int, watermark: str, slots: int = SLOTS) -> DataFrame:
    """The earliest answer of each waiting row (update mode, RocksDB): waiting has key, ts, id, until; answers key, ts, id.

    Both come as one stream, so one watermark closes both. Rows older than it are dropped; nulls in key, ts or id too.
    Keys share ``slots`` (see ``by_slot``).
    """
    shape = lambda df, until, is_answer: df.select("key", "ts", "id", until.cast("timestamp").alias("until"), F.lit(is_answer).alias("is_answer"))
    both = shape(waiting, F.col("until"), False).unionByName(shape(answers, F.lit(None), True)).where("key IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL")
    until = F.coalesce(F.unix_micros("until"), F.lit(2**63 - 1))
    rows = both.withWatermark("ts", watermark).select("key", "ts", "id", "is_answer", F.unix_micros("ts").alias("ts_us"), until.alias("until_us"))
    return by_slot(rows, slots).transformWithStateInPandas(
        statefulProcessor=first_answer_processor(gap_us), outputStructType=FIRST_ANSWER_SCHEMA, outputMode="Update", timeMode="EventTime")


def match_intents(signals: DataFrame, books: DataFrame, delay: str, latency: str, watermark: str, slots: int = SLOTS) -> DataFrame:
    """First book of each signal: at least ``delay`` later, within ``latency`` and before the signal's ``expires``.

    signals: key, ts, id, expires; books: key, ts, id. See ``first_answer``; only found books are written, no candidates.
    """
    end = F.least(F.col("expires"), F.col("ts") + F.expr(f"INTERVAL {latency}") + F.expr("INTERVAL 1 MICROSECOND"))
    gap = signals.sparkSession.range(1).select(F.expr(f"CAST(unix_micros(timestamp'1970-01-01 00:00:00Z' + INTERVAL {delay}) AS BIGINT)")).first()[0]
    return first_answer(signals.withColumn("until", end), books, gap, watermark, slots)


def settle(predictions: DataFrame, outcomes: DataFrame, watermark: str, slots: int = SLOTS) -> DataFrame:
    """The first outcome strictly after each prediction: predictions have key, ts, id, close (null: open end), outcomes key, ts, id.

    A prediction is held until its outcome or its close, however long that takes.
    """
    return first_answer(predictions.withColumnRenamed("close", "until"), outcomes, 1, watermark, slots)


def tumbling_bars(stream: DataFrame, by: list[str], ts: str, price: str, size: Column, tie: str, length: str, delay: str) -> DataFrame:
    """Bars per window, emitted once when the watermark passes the window's end."""
    order = F.struct(ts, tie)
    return (
        stream.withWatermark(ts, delay)
        .withColumn("_size", size)
        .groupBy(*by, F.window(ts, length).alias("w"))
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
            F.sum("_size").alias("volume"), F.count(F.lit(1)).alias("trades"),
        )
    )


def sliding_imbalance(stream: DataFrame, by: list[str], ts: str, volume: Column, buy: Column, length: str, slide: str, delay: str) -> DataFrame:
    """Signed flow of each sliding window; NULL when nothing was traded."""
    g = stream.withWatermark(ts, delay).withColumn("_v", volume).withColumn("_b", buy).groupBy(*by, F.window(ts, length, slide).alias("w"))
    s = g.agg(F.sum("_v").alias("volume"), F.sum("_b").alias("buy"))
    return s.withColumn("imbalance", F.when(F.col("volume") > 0, F.lit(2.0) * F.col("buy") / F.col("volume") - F.lit(1.0)))


def intent_processor(delay_ms: int = 0):
    """Stateful matching with expiry, cancellation and late events, per key.

    Rows: key, ts, kind ('prediction' | 'book'), id, expires, qualifies. A qualifying prediction becomes the pending
    intent; a newer one that does not qualify cancels it; the first later book that is at least ``delay_ms`` younger fills
    it; an event-time timer expires it. Events older than the watermark go to the output as 'late' and change no state.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import LongType, StructField, StructType

    columns = ["key", "event", "intent_id", "other_id", "ts_ms"]

    class IntentProcessor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.pending = handle.getValueState("pending", StructType([StructField("id", LongType()), StructField("ts", LongType()), StructField("expires", LongType())]))

        def handleInputRows(self, key, rows, timerValues):
            mark = timerValues.getCurrentWatermarkInMs()
            # One key's rows of one micro-batch: bounded by maxFilesPerTrigger of the source, not by the stream.
            batch = pd.concat(list(rows)).sort_values(["ts_ms", "id"])
            start = held = self.pending.get() if self.pending.exists() else None
            out = []
            for ts, kind, ident, expires, qualifies in zip(*(batch[c].tolist() for c in ("ts_ms", "kind", "id", "expires_ms", "qualifies"))):
                if held is not None and ts >= held[2]:
                    out.append((key[0], "expired", held[0], -1, held[2]))
                    held = None
                if mark > 0 and ts < mark:
                    out.append((key[0], "late", ident, -1, ts))
                elif kind == "prediction":
                    if qualifies:
                        held = (int(ident), int(ts), int(expires))
                    elif held is not None:
                        out.append((key[0], "cancelled", held[0], ident, ts))
                        held = None
                elif held is not None and ts > held[1] and ts >= held[1] + delay_ms:
                    out.append((key[0], "matched", held[0], ident, ts))
                    held = None
            if held is None:
                self.pending.clear()
            elif held != start:
                self.pending.update(held)
                self.handle.registerTimer(held[2])
            if out:
                yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = self.pending.get() if self.pending.exists() else None
            if held is not None and held[2] <= expiredTimerInfo.getExpiryTimeInMs():
                yield pd.DataFrame([(key[0], "expired", held[0], -1, held[2])], columns=columns)
                self.pending.clear()

        def close(self) -> None:
            pass

    return IntentProcessor()


INTENT_SCHEMA = "key long, event string, intent_id long, other_id long, ts_ms long"


def intents_with_cancellation(stream: DataFrame, key: str, ts: str, delay: str, fill_delay_ms: int = 0) -> DataFrame:
    """Lifecycle events of intents: matched, cancelled, expired, late (needs the RocksDB state store).

    ``delay`` is the watermark's; ``fill_delay_ms`` is what a book must be younger than the intent to fill it.
    """
    return stream.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(
        statefulProcessor=intent_processor(fill_delay_ms), outputStructType=INTENT_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


SETTLEMENT_SCHEMA = "key long, id long, ts_us long, payout long, verdict string, nth long"


def settlement_processor(delay_us: int):
    """Verdict on each outcome of a key: accepted (the first), repeated, conflicting (another payout), late.

    Late is what lies more than ``delay_us`` behind the key's newest row of earlier micro-batches; a late row changes
    nothing. The rows of one micro-batch are taken by (ts, id). ``nth`` counts the key's rows of that verdict. The keys of
    a slot are judged at once; state is a row a key.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    verdicts, SlotRows = np.array(["accepted", "repeated", "conflicting", "late"], object), slot_rows()

    class Settlements(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = SlotRows(handle, "settlements", ("key", "payout", "newest", *verdicts))

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows)).sort_values(["key", "ts_us", "id"])
            row_key, ident, ts, payout = (batch[c].to_numpy(np.int64) for c in ("key", "id", "ts_us", "payout"))
            held = self.state.load()
            keys, first = np.unique(np.concatenate((held[:, 0], row_key)), return_index=True)
            # A key's first row of all is never late, so a held key has a payout and a new one takes that row's.
            state = np.zeros((len(keys), 7), np.int64)
            state[:, 0] = keys
            state[:, 1] = np.concatenate((held[:, 1], payout))[first]
            state[:, 2] = np.concatenate((held[:, 2], ts))[first]
            known = first < len(held)
            state[known] = held[first[known]]
            at = np.searchsorted(keys, row_key)
            late = known[at] & (ts < state[at, 2] - delay_us)
            accepted = ~known[at] & (first[at] - len(held) == np.arange(len(at)))
            verdict = np.select([late, accepted, payout == state[at, 1]], [3, 0, 1], 2)
            nth = state[at, 3 + verdict] + pd.Series(verdict).groupby([at, verdict]).cumcount().to_numpy() + 1
            np.add.at(state, (at, 3 + verdict), 1)
            np.maximum.at(state[:, 2], at, ts)
            self.state.store(state)
            yield pd.DataFrame({"key": row_key, "id": ident, "ts_us": ts, "payout": payout, "verdict": verdicts[verdict], "nth": nth})

        def close(self) -> None:
            pass

    return Settlements()


def settlements(stream: DataFrame, delay_us: int, slots: int = SLOTS) -> DataFrame:
    """Accepted, repeated, conflicting and late outcomes in one stateful pass (RocksDB): stream has key, ts, id, payout.

    Rows with a null are dropped. The verdict column splits the written table into the stream's main and side outputs.
    Keys share ``slots`` (see ``by_slot``).
    """
    rows = stream.where("key IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL AND payout IS NOT NULL")
    rows = rows.select("key", "id", F.unix_micros("ts").alias("ts_us"), F.col("payout").cast("long").alias("payout"))
    return by_slot(rows, slots).transformWithStateInPandas(statefulProcessor=settlement_processor(delay_us), outputStructType=SETTLEMENT_SCHEMA, outputMode="Append", timeMode="None")


FRESHNESS_SCHEMA = "key long, at_us long, state string"


def freshness_processor(stale_us: int):
    """Changes of a market's state label, also those that no row brings: an event-time timer makes an old book stale.

    Rows: key, ts_us, kind ('error', 'forecast' or anything else: a book), close_us (null: open end). Labels are error, forecast and watching
    by the newest row, collecting ``stale_us`` after it, closed at the market's close, when its state is dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    never = 2**63 - 1

    class Freshness(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("label", StructType([StructField("label", StringType()), StructField("ts", LongType()), StructField("close", LongType())]))

        @staticmethod
        def _until(held, now, out):
            """What time alone has changed before `now`: the label goes stale, then the market closes."""
            label, ts, close = held
            if label not in ("collecting", "closed") and ts + stale_us <= min(now, close - 1):
                label = "collecting"
                out.append((ts + stale_us, label))
            if label != "closed" and close <= now:
                label = "closed"
                out.append((close, label))
            return (label, ts, close)

        def _keep(self, key, held, out):
            label, ts, close = held
            if label == "closed":
                self.state.clear()
            else:
                self.state.update(held)
                due = close if label == "collecting" else min(close, ts + stale_us)
                if due < never:
                    self.handle.registerTimer(due // 1000 + 1)
            if out:
                yield pd.DataFrame([(key[0], at, label) for at, label in out], columns=["key", "at_us", "state"])

        def handleInputRows(self, key, rows, timerValues):
            batch = pd.concat(list(rows)).sort_values(["ts_us", "id"])
            held, out = self.state.get() if self.state.exists() else None, []
            closes = batch["close_us"].astype("Int64").fillna(never).tolist()
            for ts, kind, close in zip(batch["ts_us"].tolist(), batch["kind"].tolist(), closes):
                if held is not None:
                    held = self._until(held, ts, out)
                    if held[0] == "closed":
                        continue
                    if ts < held[1]:  # an older row changes nothing
                        continue
                label = kind if kind in ("error", "forecast") else "watching"
                if held is None or held[0] != label:
                    out.append((ts, label))
                held = (label, int(ts), int(close))
            mark_us = timerValues.getCurrentWatermarkInMs() * 1000
            if held is not None:
                yield from self._keep(key, self._until(held, mark_us, out), out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                out = []
                yield from self._keep(key, self._until(self.state.get(), timerValues.getCurrentWatermarkInMs() * 1000, out), out)

        def close(self) -> None:
            pass

    return Freshness()


def freshness_changes(stream: DataFrame, stale_us: int, watermark: str) -> DataFrame:
    """State labels of each market as they change (append, RocksDB): stream has key, ts, id, kind, close. See ``freshness_processor``.

    Union a clock with ``with_heartbeat`` so that labels change where no market sends anything.
    """
    rows = stream.withWatermark("ts", watermark).select(F.coalesce("key", F.lit(-1).cast("long")).alias("key"), "ts", "id", "kind", F.unix_micros("ts").alias("ts_us"), F.unix_micros("close").alias("close_us"))
    out = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=freshness_processor(stale_us), outputStructType=FRESHNESS_SCHEMA, outputMode="Append", timeMode="EventTime")
    return out.where("key >= 0")


def freshness(latest: DataFrame, now_us: Column, observed: str, stale_us: int, has_forecast: Column, has_error: Column) -> DataFrame:
    """Age of the newest book and the state label error / collecting / watching / forecast."""
    age = now_us - F.col(observed)
    state = F.when(has_error, "error").when(F.col(observed).isNull() | (age > stale_us), "collecting").when(has_forecast, "forecast").otherwise("watching")
    return latest.withColumn("age_us", age).withColumn("state", state)
