"""Queries over the observation operators, and DuckDB SQL for each that SQL expresses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import bits as B
from .functions import satellites as S
from .functions import validation as V
from .operators import chunks, doppler, epochs, wire
from .plans import buckets
from .plans.obs import SQL, event_stream, observations
from .schema import CARRIERS, SYSTEMS
from .sources import framed
from .streaming.encoder import OUTPUT, stream_chunks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False):
    """Register a query on the observations under its name, with its SQL after WITH obs."""

    def wrap(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            _bind_columns()
            return f(observations(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql if raw else f"WITH {SQL} {sql}"
        return f

    return wrap


COLUMNS = {
    "c": "constellation", "s": "sat_id", "seq": "seq", "mm": "pseudorange_mm", "mhz": "doppler_millihz",
    "cn0": "cn0_raw", "phase": "carrier_phase_cycles", "slot": "slot", "ts": "timestamp_ms",
}


def _bind_columns() -> None:
    """Columns need a session, so the short names below are bound when a query runs."""
    globals().update({k: F.col(v) for k, v in COLUMNS.items()})


CODE = "CASE WHEN constellation = 'GLO' THEN sat_id + 7 ELSE sat_id END"
ABS = "abs(CAST(doppler_millihz AS BIGINT))"


@query("SELECT seq, 1602000000 + CAST(slot AS BIGINT) * 562500 AS freq_hz FROM obs")
def q_carrier_freq(o: DataFrame) -> DataFrame:
    return o.select("seq", S.carrier_freq_hz(slot).alias("freq_hz"))


@query(f"SELECT seq, pseudorange_mm / 1000.0::DOUBLE AS pr_m, doppler_millihz / 1000.0::DOUBLE AS dop_hz, {ABS} AS dop_abs, CAST(23 + CASE WHEN carrier_phase_cycles IS NULL THEN 0 ELSE 8 END AS BIGINT) AS raw_bytes FROM obs")
def q_units(o: DataFrame) -> DataFrame:
    return o.select("seq", S.pseudorange_m(mm).alias("pr_m"), S.doppler_hz(mhz).alias("dop_hz"), S.doppler_abs(mhz).alias("dop_abs"), S.raw_size(phase).alias("raw_bytes"))


@query(f"SELECT seq, constellation || lpad(CAST({CODE} AS VARCHAR), 2, '0') AS shown, CASE WHEN constellation = 'GLO' THEN sat_id END AS glo_slot, constellation = 'GLO' AS fdma FROM obs")
def q_sat_display(o: DataFrame) -> DataFrame:
    return o.select("seq", S.display_id(c, s).alias("shown"), S.glonass_slot(c, s).alias("glo_slot"), S.is_fdma(c).alias("fdma"))


@query(f"SELECT seq, constellation, sat_id, CAST({CODE} AS INTEGER) AS code, CAST(CASE WHEN constellation = 'GLO' THEN sat_id + 7 ELSE sat_id - 1 END AS INTEGER) AS state FROM obs")
def q_wire_code(o: DataFrame) -> DataFrame:
    return o.select("seq", "constellation", "sat_id", S.to_wire(c, s).alias("code"), S.registry_index(c, s).alias("state"))


@query("SELECT seq, sat_id AS back, slot AS slot_back, true AS in_range FROM obs")
def q_wire_roundtrip(o: DataFrame) -> DataFrame:
    return o.select("seq", S.from_wire(c, S.to_wire(c, s)).alias("back"), S.index_to_slot(S.slot_to_index(slot)).alias("slot_back"), S.id_in_range(c, s).alias("in_range"))


@query("SELECT constellation, CAST(CASE constellation WHEN 'GLO' THEN 0 WHEN 'GPS' THEN 1 WHEN 'GAL' THEN 2 ELSE 3 END AS INTEGER) AS ord, count(*) AS n, count(DISTINCT sat_id) AS sats FROM obs GROUP BY 1")
def q_const_order(o: DataFrame) -> DataFrame:
    return o.groupBy("constellation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sat_id").alias("sats")).withColumn("ord", S.order_of(c))


# multiples of the 10.23 MHz that all of them are made of
@query("SELECT carrier, (k * 1023000)::BIGINT AS hz FROM (VALUES ('GPS_L1', 1540), ('GPS_L2', 1200), ('GAL_E1', 1540), ('GAL_E5A', 1150), ('GAL_E5B', 1180), ('BDS_B1I', 1526), ('BDS_B1C', 1540), ('BDS_B2A', 1150)) t(carrier, k)", raw=True)
def q_carriers(o: DataFrame) -> DataFrame:
    return o.sparkSession.createDataFrame(list(CARRIERS.items()), "carrier string, hz long")


def _validate_sql(system: str, where: str = "") -> str:
    low, high, a, b, d, code = SYSTEMS[system]
    case = lambda x, y, z: f"CASE WHEN sat_id NOT BETWEEN {low} AND {high} THEN {x} WHEN pseudorange_mm NOT BETWEEN {a} AND {b} THEN {y} WHEN {ABS} > {d} THEN {z} END"
    return f"SELECT seq, {case(repr(code), repr('InvalidPseudorange'), repr('InvalidDoppler'))} AS error_code, {case('CAST(sat_id AS BIGINT)', 'pseudorange_mm', ABS)} AS error_value FROM obs {where}"


def _validator(system: str):
    def run(o: DataFrame) -> DataFrame:
        # every row is tried against the system's limits, so all errors occur
        return V.validate(o, V.system_error(system)).select("seq", "error_code", "error_value")

    run.__name__ = f"q_validate_{system.lower()}"
    return query(_validate_sql(system))(run)


for _system in SYSTEMS:
    _validator(_system)


@query(f"SELECT seq, CASE WHEN pseudorange_mm <= 0 THEN 'InvalidPseudorange' WHEN {ABS} > 10000000 THEN 'InvalidDoppler' END AS error_code, CASE WHEN pseudorange_mm <= 0 THEN pseudorange_mm WHEN {ABS} > 10000000 THEN doppler_millihz::BIGINT END AS error_value FROM (SELECT seq, pseudorange_mm - 21600000000 AS pseudorange_mm, doppler_millihz * 3 AS doppler_millihz FROM obs)")
def q_validate_generic(o: DataFrame) -> DataFrame:
    moved = o.withColumn("pseudorange_mm", mm - 21_600_000_000).withColumn("doppler_millihz", mhz * 3)
    return V.validate(moved, V.generic_error()).select("seq", "error_code", "error_value")


@query("SELECT coalesce(error_code, 'ok') AS error_code, count(*) AS n FROM (SELECT CASE WHEN cn0_raw NOT BETWEEN 0 AND 60 THEN 'InvalidDbHz' END AS error_code FROM obs) GROUP BY 1")
def q_error_counts(o: DataFrame) -> DataFrame:
    e = V.validate(o, V.cn0_error(cn0))
    return e.groupBy(F.coalesce("error_code", F.lit("ok")).alias("error_code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT seq, cn0_raw FROM obs WHERE cn0_raw BETWEEN 20 AND 60")
def q_tracked(o: DataFrame) -> DataFrame:
    return V.validate(o, V.cn0_error(cn0), "DROPMALFORMED").filter(V.is_tracked(cn0)).select("seq", "cn0_raw")


@query("SELECT seq, cn0_raw FROM obs WHERE cn0_raw >= 40")
def q_strong(o: DataFrame) -> DataFrame:
    return o.filter(V.is_strong(cn0)).select("seq", "cn0_raw")


@query("SELECT seq, (doppler_millihz::BIGINT) AS v, CASE WHEN doppler_millihz >= 0 THEN 2 * doppler_millihz::BIGINT ELSE -2 * doppler_millihz::BIGINT - 1 END AS zz, doppler_millihz::BIGINT AS back FROM obs")
def q_zigzag(o: DataFrame) -> DataFrame:
    z = B.zigzag(mhz)
    return o.select("seq", mhz.cast("long").alias("v"), z.alias("zz"), B.unzigzag(z).alias("back"))


W = "WINDOW w AS (PARTITION BY chunk_id ORDER BY seq)"


@query(f"SELECT seq, d, d - coalesce(lag(d) OVER (PARTITION BY chunk_id ORDER BY seq), 0) AS dod FROM (SELECT seq, chunk_id, timestamp_ms - lag(timestamp_ms) OVER w AS d FROM obs {W})")
def q_delta_dod(o: DataFrame) -> DataFrame:
    return buckets.predicted(o).select("seq", F.col("d_ts").alias("d"), F.col("r_ts").alias("dod"))


@query("SELECT seq, timestamp_ms AS from_delta, timestamp_ms AS from_dod FROM obs")
def q_reconstruct(o: DataFrame) -> DataFrame:
    """Each row again from the row before: by its delta, and by its change of delta."""
    w = Window.partitionBy("chunk_id").orderBy("seq")
    p = buckets.predicted(o).withColumn("last", F.lag(ts).over(w)).withColumn("last_d", F.coalesce(F.lag("d_ts").over(w), F.lit(0).cast("long")))
    return p.select(
        "seq",
        F.coalesce(B.reconstruct_from_delta(F.col("last"), F.col("d_ts")), ts).alias("from_delta"),
        F.coalesce(B.reconstruct_from_dod(F.col("last"), F.col("last_d"), F.col("r_ts"))["current"], ts).alias("from_dod"),
    )


#: Unsigned 64-bit numbers that wrap: a step of nearly 2^62 a row.
U64 = "(seq::HUGEINT * 4611686018427387911) % 18446744073709551616"
SIGNED = lambda x: f"CAST(CASE WHEN ({x}) % 18446744073709551616 >= 9223372036854775808 THEN ({x}) % 18446744073709551616 - 18446744073709551616 WHEN ({x}) % 18446744073709551616 < -9223372036854775808 THEN ({x}) % 18446744073709551616 + 18446744073709551616 ELSE ({x}) % 18446744073709551616 END AS BIGINT)"


@query(f", u AS (SELECT seq, chunk_id, {U64} AS u FROM obs), d AS (SELECT seq, chunk_id, u, u - lag(u) OVER (PARTITION BY chunk_id ORDER BY seq) AS d FROM u), dd AS (SELECT *, d - lag(d) OVER (PARTITION BY chunk_id ORDER BY seq) AS dod FROM d) SELECT seq, {SIGNED('u')} AS u, {SIGNED('d')} AS d, {SIGNED('dod')} AS dod, CASE WHEN dod IS NOT NULL THEN {SIGNED('u')} END AS back, CASE WHEN dod IS NOT NULL THEN {SIGNED('d')} END AS back_d FROM dd")
def q_delta_u64(o: DataFrame) -> DataFrame:
    w = Window.partitionBy("chunk_id").orderBy("seq")
    u = B.wrapping_add(F.shiftleft(seq, 62), seq * 7)
    x = o.select("seq", "chunk_id", u.alias("u")).withColumn("last", F.lag("u").over(w)).withColumn("d", B.delta(F.col("u"), F.col("last")))
    x = x.withColumn("last_d", F.lag("d").over(w)).withColumn("dod", B.delta_of_delta(F.col("u"), F.col("last"), F.col("last_d")))
    back = B.reconstruct_from_dod(F.col("last"), F.col("last_d"), F.col("dod"))
    return x.select("seq", "u", "d", "dod", back["current"].alias("back"), back["delta"].alias("back_d"))


ZZ = lambda x: f"(CASE WHEN {x} >= 0 THEN 2 * {x} ELSE -2 * {x} - 1 END)"
PRED = f""", lagged AS (SELECT *, row_number() OVER w AS n, timestamp_ms - lag(timestamp_ms) OVER w AS d_ts, pseudorange_mm - lag(pseudorange_mm) OVER w AS d_pr,
 slot <> lag(slot) OVER w AS r_slot, cn0_dbhz - lag(cn0_dbhz) OVER w AS r_cn0,
 doppler_millihz::BIGINT - lag(doppler_millihz::BIGINT) OVER (PARTITION BY chunk_id, slot ORDER BY seq) AS r_dop,
 lag(carrier_phase_cycles) OVER w AS p_ph, carrier_phase_cycles - lag(carrier_phase_cycles) OVER w AS d_ph FROM obs {W}),
res AS (SELECT *, d_ts - coalesce(lag(d_ts) OVER w, 0) AS r_ts, d_pr - coalesce(lag(d_pr) OVER w, 0) AS r_pr, d_ph - coalesce(lag(d_ph) OVER w, 0) AS r_ph FROM lagged {W}),
sized AS (SELECT *, 
 CASE WHEN n = 1 THEN 0 WHEN r_ts = 0 THEN 1 WHEN {ZZ('r_ts')} < 128 THEN 9 WHEN {ZZ('r_ts')} < 512 THEN 12 ELSE 67 END AS b_ts,
 CASE WHEN n = 1 THEN 0 WHEN r_slot THEN 5 ELSE 1 END AS b_slot,
 CASE WHEN n = 1 THEN 0 WHEN r_cn0 = 0 THEN 1 ELSE 10 END AS b_cn0,
 CASE WHEN n = 1 THEN 0 WHEN r_pr = 0 THEN 1 WHEN {ZZ('r_pr')} < 1024 THEN 12 WHEN {ZZ('r_pr')} < 1048576 THEN 23 ELSE 67 END AS b_pr,
 CASE WHEN n = 1 THEN 0 WHEN r_dop IS NULL THEN 33 WHEN r_dop = 0 THEN 2 WHEN {ZZ('r_dop')} < 16384 THEN 17 ELSE 35 END AS b_doppler,
 CASE WHEN n = 1 THEN 0 WHEN carrier_phase_cycles IS NULL THEN 2 WHEN p_ph IS NULL THEN 66 WHEN r_ph = 0 THEN 3 WHEN {ZZ('r_ph')} < 4294967296 THEN 36 ELSE 68 END AS b_phase FROM res),
bits AS (SELECT *, b_ts + b_slot + b_cn0 + b_pr + b_doppler + b_phase AS bits FROM sized)
"""


@query(PRED + "SELECT seq, b_ts, b_slot, b_cn0, b_pr, b_doppler, b_phase FROM bits")
def q_buckets(o: DataFrame) -> DataFrame:
    return buckets.predicted(o).select("seq", *[f"b_{k}" for k in buckets.FIELDS])


@query(PRED + "SELECT seq, CASE WHEN n = 1 THEN -1 WHEN carrier_phase_cycles IS NULL THEN CASE WHEN p_ph IS NULL THEN 0 ELSE 1 END WHEN b_phase = 66 THEN 2 WHEN b_phase = 3 THEN 3 WHEN b_phase = 36 THEN 4 ELSE 5 END AS kind FROM bits")
def q_phase_fold(o: DataFrame) -> DataFrame:
    return buckets.phase_kinds(o).select("seq", "kind")


#: Phases that leave the near bucket, next to each other and apart, and nulls between them; and the packer's rule row by row.
JUMPS = f"""WITH RECURSIVE {SQL}, ph AS (SELECT chunk_id, seq, row_number() OVER (PARTITION BY chunk_id ORDER BY seq) AS n,
 carrier_phase_cycles + (CASE WHEN seq % 7 = 3 THEN 1099511627776 ELSE 0 END) + (seq % 11 // 9) * 8589934592 + (seq // 16 % 2) * (seq % 16) * 4294967296 AS phase FROM obs),
r AS (SELECT chunk_id, seq, n, phase, NULL::BIGINT AS d, -1 AS kind FROM ph WHERE n = 1 UNION ALL
 SELECT chunk_id, seq, n, phase, CASE WHEN kind IN (3, 4) THEN step END, kind FROM (
  SELECT *, CASE WHEN phase IS NULL THEN CASE WHEN last IS NULL THEN 0 ELSE 1 END WHEN last IS NULL THEN 2 WHEN dod = 0 THEN 3 WHEN dod BETWEEN -2147483648 AND 2147483647 THEN 4 ELSE 5 END AS kind FROM (
   SELECT p.chunk_id, p.seq, p.n, p.phase, r.phase AS last, p.phase - r.phase AS step, p.phase - r.phase - coalesce(r.d, 0) AS dod FROM r JOIN ph p ON p.chunk_id = r.chunk_id AND p.n = r.n + 1)))
"""


def _jumping(o: DataFrame) -> DataFrame:
    far = F.when(seq % 7 == 3, F.lit(1 << 40)).otherwise(F.lit(0))
    steps = F.floor(seq % 11 / 9).cast("long") * (1 << 33) + F.floor(seq / 16).cast("long") % 2 * (seq % 16) * (1 << 32)
    return o.withColumn("carrier_phase_cycles", (phase + far + steps).cast("long"))


@query(JUMPS + "SELECT seq, kind, CAST(CASE kind WHEN -1 THEN 0 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 66 WHEN 3 THEN 3 WHEN 4 THEN 36 ELSE 68 END AS INTEGER) AS b_phase FROM r", raw=True)
def q_phase_absolute(o: DataFrame) -> DataFrame:
    j = _jumping(o)
    return buckets.phase_kinds(j).select("seq", "kind").join(buckets.predicted(j).select("seq", "b_phase"), "seq")


@query("SELECT chunk_id, true AS same FROM obs GROUP BY 1")
def q_absolute_sizes(o: DataFrame) -> DataFrame:
    """With phases that jump, window sizes are the packer's bytes."""
    j = _jumping(o)
    return chunks.encode_chunks(j, mode="FAILFAST").join(buckets.chunk_sizes(j), "chunk_id").select("chunk_id", (F.octet_length("payload") == F.col("chunk_bytes")).alias("same"))


@query(PRED + "SELECT chunk_id, seq, CAST(sum(bits) OVER (PARTITION BY chunk_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bit_end FROM bits")
def q_bit_offsets(o: DataFrame) -> DataFrame:
    w = Window.partitionBy("chunk_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.predicted(o).select("chunk_id", "seq", F.sum("bits").over(w).alias("bit_end"))


SIZES = PRED + """, sizes AS (SELECT chunk_id, count(*) AS n_rows, CAST(sum(23 + CASE WHEN carrier_phase_cycles IS NULL THEN 0 ELSE 8 END) AS BIGINT) AS raw_bytes,
 CAST(sum(bits) AS BIGINT) AS stream_bits, CAST(9 + max(CASE WHEN n = 1 THEN 23 + CASE WHEN carrier_phase_cycles IS NULL THEN 0 ELSE 8 END END) + (sum(bits) + 7) // 8 AS BIGINT) AS chunk_bytes FROM bits GROUP BY 1)
"""


@query(SIZES + "SELECT *, raw_bytes::DOUBLE / chunk_bytes::DOUBLE AS ratio, chunk_bytes * 8.0::DOUBLE / n_rows AS bits_per_row FROM sizes")
def q_chunk_size(o: DataFrame) -> DataFrame:
    return buckets.chunk_sizes(o)


@query(SIZES + "SELECT count(*) AS n_chunks, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(chunk_bytes) AS BIGINT) AS chunk_bytes, min(raw_bytes::DOUBLE / chunk_bytes) AS least, max(raw_bytes::DOUBLE / chunk_bytes) AS most, CAST(sum(n_rows) AS BIGINT) AS n_rows, round(avg(raw_bytes::DOUBLE / chunk_bytes), 9) AS avg_ratio, sum(raw_bytes)::DOUBLE / sum(n_rows)::DOUBLE AS raw_per_row, sum(chunk_bytes)::DOUBLE / sum(n_rows)::DOUBLE AS bytes_per_row FROM sizes")
def q_ratio_summary(o: DataFrame) -> DataFrame:
    return buckets.summary(buckets.chunk_sizes(o)).withColumn("avg_ratio", F.round("avg_ratio", 9))


def q_gzip_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks against gzip of their plain rows; SQL has no gzip."""
    return chunks.compared(observations(spark, sf_dir))


QUERIES["q_gzip_compare"] = q_gzip_compare


@query(PRED + "SELECT field, size, count(*) AS n FROM (UNPIVOT (SELECT b_ts AS ts, b_slot AS slot, b_cn0 AS cn0, b_pr AS pr, b_doppler AS doppler, b_phase AS phase FROM bits WHERE n > 1) ON ts, slot, cn0, pr, doppler, phase INTO NAME field VALUE size) GROUP BY 1, 2")
def q_bucket_histogram(o: DataFrame) -> DataFrame:
    p = buckets.predicted(o).filter("n > 1").select(*[F.col(f"b_{k}").alias(k) for k in buckets.FIELDS])
    return p.unpivot([], list(buckets.FIELDS), "field", "size").groupBy("field", "size").agg(F.count(F.lit(1)).alias("n"))


EPOCH = ", e AS (SELECT timestamp_ms // 3600000 AS timestamp_ms, slot, seq, pseudorange_mm, doppler_millihz, sat_id FROM obs)"
GROUPS = EPOCH + ", g AS (SELECT timestamp_ms, count(*) AS n, count(DISTINCT slot) AS slots, min(slot) AS min_slot, max(slot) AS max_slot FROM e GROUP BY 1)"


def _hourly(o: DataFrame) -> DataFrame:
    return o.withColumn("timestamp_ms", F.floor(ts / 3_600_000).cast("long"))


@query(GROUPS + "SELECT timestamp_ms, n, min_slot, max_slot, string_agg(slot::VARCHAR || ':' || seq::VARCHAR, ',' ORDER BY slot) AS members FROM g JOIN e USING (timestamp_ms) WHERE n = slots AND n <= 14 GROUP BY ALL")
def q_epoch_group(o: DataFrame) -> DataFrame:
    members = F.array_join(F.transform("observations", lambda x: F.concat_ws(":", x["slot"], x["seq"])), ",")
    return epochs.group_epochs(_hourly(o)).select("timestamp_ms", "n", "min_slot", "max_slot", members.alias("members"))


@query(GROUPS + "SELECT timestamp_ms, n, CASE WHEN slots < least(n, 14) THEN 'DuplicateSlot' ELSE 'FrameFull' END AS error_code FROM g WHERE NOT (n = slots AND n <= 14)")
def q_epoch_rejects(o: DataFrame) -> DataFrame:
    return epochs.group_epochs(_hourly(o), rejected=True)


@query(EPOCH + ", bad AS (SELECT *, CASE WHEN sat_id NOT BETWEEN -7 AND 6 THEN 'InvalidSlot' WHEN pseudorange_mm NOT BETWEEN 19100000000 AND 25600000000 THEN 'InvalidPseudorange' ELSE 'InvalidDoppler' END AS error_code FROM e WHERE sat_id NOT BETWEEN -7 AND 6 OR pseudorange_mm NOT BETWEEN 19100000000 AND 25600000000 OR abs(doppler_millihz) > 5000000) SELECT timestamp_ms, arg_min(error_code, slot::BIGINT * 1000000000 + seq) AS error_code FROM bad GROUP BY 1")
def q_epoch_validate(o: DataFrame) -> DataFrame:
    return epochs.epoch_errors(_hourly(o)).select("timestamp_ms", "error_code")


@query(GROUPS + "SELECT timestamp_ms, bool_or(slot = 1) AS has_one, max(CASE WHEN slot = 1 THEN seq END) AS at_one FROM g JOIN e USING (timestamp_ms) WHERE n = slots AND n <= 14 GROUP BY 1")
def q_epoch_lookup(o: DataFrame) -> DataFrame:
    g = epochs.group_epochs(_hourly(o))
    return g.select("timestamp_ms", epochs.contains_slot(F.col("observations"), 1).alias("has_one"), epochs.get_by_slot(F.col("observations"), 1)["seq"].alias("at_one"))


@query("SELECT chunk_id, '4B524F4701' || string_agg(printf('%02X', (n >> (8 * k)) & 255), '' ORDER BY k) AS header FROM (SELECT chunk_id, count(*) AS n FROM obs GROUP BY 1), range(4) r(k) GROUP BY 1")
def q_header_bytes(o: DataFrame) -> DataFrame:
    return o.groupBy("chunk_id").agg(B.header_hex(F.count(F.lit(1))).alias("header"))


@query("SELECT seq, string_agg(printf('%02X', (timestamp_ms >> (8 * k)) & 255), '' ORDER BY k) AS ts_hex, lpad(bin(pseudorange_mm), 64, '0') AS pr_bits FROM obs, range(8) r(k) GROUP BY seq, pseudorange_mm")
def q_bits_string(o: DataFrame) -> DataFrame:
    return o.select("seq", B.le_hex(ts, 8).alias("ts_hex"), B.bit_string(mm, 64).alias("pr_bits"))


ROWS = "chunk_id, seq, timestamp_ms, slot, cn0_dbhz, pseudorange_mm, doppler_millihz, carrier_phase_cycles"


@query(f"SELECT {ROWS} FROM obs")
def q_encode_roundtrip(o: DataFrame) -> DataFrame:
    back = chunks.decode_chunks(chunks.encode_chunks(o, mode="FAILFAST"), mode="FAILFAST")
    return back.withColumn("seq", F.col("chunk_id") * 512 + F.col("seq")).select(*ROWS.split(", "))


@query(SIZES + "SELECT chunk_id, n_rows AS sample_count, chunk_bytes FROM sizes")
def q_encode_size(o: DataFrame) -> DataFrame:
    e = chunks.encode_chunks(o)
    return e.select("chunk_id", chunks.header(F.col("payload"))["sample_count"].alias("sample_count"), F.octet_length("payload").cast("long").alias("chunk_bytes"))


@query("SELECT chunk_id, true AS same FROM obs GROUP BY 1")
def q_two_encoders(o: DataFrame) -> DataFrame:
    b = buckets.bit_strings(o)
    first = B.verbatim_hex(ts, slot, F.col("cn0_dbhz"), mm, mhz, phase)
    rows = F.sort_array(F.collect_list(F.struct("seq", "stream")))
    text = b.groupBy("chunk_id").agg(
        F.concat(
            B.header_hex(F.count(F.lit(1))), F.max(F.when(F.col("n") == 1, first)), B.pack_hex(F.array_join(F.transform(rows, lambda x: x["stream"]), ""))
        ).alias("by_columns")
    )
    return text.join(chunks.encode_chunks(o), "chunk_id").select("chunk_id", (F.col("by_columns") == F.hex("payload")).alias("same"))


@query("SELECT chunk_id, CASE chunk_id % 4 WHEN 0 THEN 'InvalidMagic' WHEN 1 THEN 'InvalidVersion' WHEN 2 THEN 'UnexpectedEof' END AS error_code FROM obs GROUP BY 1")
def q_decode_permissive(o: DataFrame) -> DataFrame:
    e = chunks.encode_chunks(o)
    h = F.hex("payload")
    k = F.col("chunk_id") % 4
    broken = (
        F.when(k == 0, F.concat(F.lit("00"), h.substr(F.lit(3), F.length(h))))
        .when(k == 1, F.concat(h.substr(1, 8), F.lit("63"), h.substr(F.lit(11), F.length(h))))
        .when(k == 2, h.substr(F.lit(1), F.length(h) - 8))
        .otherwise(h)
    )
    d = chunks.decode_chunks(e.withColumn("payload", F.unhex(broken)))
    return d.groupBy("chunk_id").agg(F.max(F.regexp_extract("error_code", "^[A-Za-z]+", 0)).alias("error_code"))


@query("SELECT chunk_id, arg_min(e, seq) AS error_code, count(*) AS sample_count FROM (SELECT *, CASE WHEN seq % 1999 = 1500 THEN 'InvalidSlot(9)' WHEN seq % 701 = 3 THEN 'InvalidDbHz(61)' END AS e FROM obs) GROUP BY 1")
def q_encode_errors(o: DataFrame) -> DataFrame:
    """A chunk with a row that the types do not allow has its first error and no payload."""
    bad = o.withColumn("slot", F.when(seq % 1999 == 1500, 9).otherwise(slot)).withColumn("cn0_dbhz", F.when(seq % 701 == 3, 61).otherwise(F.col("cn0_dbhz")))
    return chunks.encode_chunks(bad).filter("(payload is null) = (error_code is not null)").select("chunk_id", "error_code", "sample_count")


@query("SELECT chunk_id, CASE WHEN chunk_id % 2 = 1 THEN 'NullValue' END AS error_code FROM obs GROUP BY 1")
def q_encode_nulls(o: DataFrame) -> DataFrame:
    bad = o.withColumn("pseudorange_mm", F.when((F.col("chunk_id") % 2 == 1) & (seq % 100 == 7), F.lit(None)).otherwise(mm))
    return chunks.encode_chunks(bad).select("chunk_id", "error_code")


@query("SELECT * FROM (VALUES ('GLO', 'InvalidPseudorange'), ('GPS', 'InvalidPrn'), ('GAL', 'InvalidSvn'), ('BDS', 'InvalidPrn')) t(constellation, error_code)", raw=True)
def q_zeroed(o: DataFrame) -> DataFrame:
    """The all-zero placeholder is valid in no system."""
    systems = o.sparkSession.createDataFrame([(k,) for k in SYSTEMS], "constellation string")
    zero = systems.select("constellation", S.zeroed().alias("z")).select("constellation", "z.*")
    return V.validate(zero, V.observation_error()).select("constellation", "error_code")


@query("SELECT seq, v, lpad(bin(CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END), 9, '0') AS bits, v AS back FROM (SELECT seq, seq % 401 - 200 AS v FROM obs)")
def q_signed_bits(o: DataFrame) -> DataFrame:
    v = seq % 401 - 200
    bits_ = B.bit_string(B.zigzag(v), 9)
    return o.select("seq", v.alias("v"), bits_.alias("bits"), B.unzigzag(F.conv(bits_, 2, 10)).alias("back"))


@query("SELECT * FROM (VALUES ('empty chunk', 'EmptyChunk'), ('empty stream', 'EmptyChunk'), ('65 bits', 'InvalidBitCount(65)'), ('4 in two bits', 'ValueTooLarge(4)'), ('small buffer', 'BufferFull'), ('full stream', 'BufferFull'), ('read past the end', 'UnexpectedEof'), ('65 bits read', 'InvalidBitCount(65)'), ('slot 7', 'InvalidSlot(7)'), ('other magic', 'InvalidMagic(1196180808)'), ('version 9', 'InvalidVersion(9)'), ('phase flag 2', 'InvalidPhaseFlag(2)'), ('slot index 15', 'InvalidSlotIndex(15)'), ('first flag', 'InvalidBitPattern'), ('unknown satellite', 'InvalidSatellite'), ('large frame', 'ValueTooLarge(67108865)')) t(of, error)", raw=True)
def q_errors(o: DataFrame) -> DataFrame:
    """Errors of the plain codec, each from the call that raises it."""
    from . import codec, doppler_codec
    from .schema import MAX_FRAME_PAYLOAD, CodecError

    row = (1, 1, 40, 21_500_000_000, 1_000, None)

    def full_stream() -> None:
        e = codec.StreamEncoder(40)
        for k in range(50):
            e.push((1 + k * 977, *row[1:]))

    def bad_index() -> None:
        w = codec.BitWriter()
        for value, n in ((0, 1), (1, 1), (15, 4), (0, 60)):
            w.write(value, n)
        codec.decode(codec.header(2) + codec.verbatim(row) + w.getvalue())

    def first_flag() -> None:
        doppler_codec.Registry().decode(codec.BitReader(b"\xff" * 8), ("GPS", 1))

    def raised(call) -> str | None:
        try:
            call()
        except CodecError as e:
            return str(e)
        return None

    one = codec.encode([row])
    cases = {
        "empty chunk": lambda: codec.encode([]),
        "empty stream": lambda: codec.StreamEncoder(99).flush(),
        "65 bits": lambda: codec.BitWriter().write(0, 65),
        "4 in two bits": lambda: codec.BitWriter().write(4, 2),
        "small buffer": lambda: codec.StreamEncoder(31).push(row),
        "full stream": full_stream,
        "read past the end": lambda: codec.BitReader(b"a").read(9),
        "65 bits read": lambda: codec.BitReader(bytes(20)).read(65),
        "slot 7": lambda: codec.encode([(1, 7, *row[2:])]),
        "other magic": lambda: codec.decode(b"HELG" + one[4:]),
        "version 9": lambda: codec.decode(one[:4] + b"\x09" + one[5:]),
        "phase flag 2": lambda: codec.decode(one[:31] + b"\x02" + one[32:]),
        "slot index 15": bad_index,
        "first flag": first_flag,
        "large frame": lambda: framed.read_framed((MAX_FRAME_PAYLOAD + 1).to_bytes(4, "little") + bytes(9)),
    }
    rows = [(name, raised(call)) for name, call in cases.items()]
    unknown = o.limit(1).withColumn("sat_id", F.lit(99))
    rows.append(("unknown satellite", doppler.encode_doppler(unknown).first()["error_code"]))
    return o.sparkSession.createDataFrame(rows, "of string, error string")


@query("SELECT chunk_id, CASE WHEN count(*) > 300 THEN 'BufferFull' END AS error_code FROM obs GROUP BY 1")
def q_decode_guard(o: DataFrame) -> DataFrame:
    return chunks.decode_chunks(chunks.encode_chunks(o), max_samples=300).groupBy("chunk_id").agg(F.max("error_code").alias("error_code"))


def _rows_of(decoded: DataFrame) -> DataFrame:
    """Decoded rows with the seq that they had."""
    return decoded.withColumn("seq", F.col("chunk_id") * 512 + F.col("seq"))


V32 = "lpad(bin(doppler_millihz::BIGINT & 4294967295), 32, '0')"


@query("SELECT seq, residual, CAST(CASE WHEN residual IS NULL THEN 33 WHEN residual = 0 THEN 2 WHEN " + ZZ("residual") + f" < 65536 THEN 19 ELSE 35 END AS INTEGER) AS n_bits, CASE WHEN residual IS NULL THEN '0' || {V32} WHEN residual = 0 THEN '10' WHEN " + ZZ("residual") + " < 65536 THEN '110' || lpad(bin(" + ZZ("residual") + f"), 16, '0') ELSE '111' || {V32} END AS bits, doppler_millihz AS decoded FROM (SELECT *, doppler_millihz::BIGINT - lag(doppler_millihz::BIGINT) OVER (PARTITION BY chunk_id, constellation, sat_id ORDER BY seq) AS residual FROM obs WHERE constellation <> 'GLO')")
def q_cdma(o: DataFrame) -> DataFrame:
    """Residuals and bits by columns; the values again from the streams' bits."""
    some = o.filter("constellation != 'GLO'")
    w = Window.partitionBy("chunk_id").orderBy("seq")
    place = some.select("chunk_id", "seq", (F.row_number().over(w) - 1).cast("long").alias("at"))
    back = doppler.decode_doppler(doppler.encode_doppler(some)).select("chunk_id", F.col("seq").alias("at"), F.col("doppler_millihz").alias("decoded"))
    return doppler.cdma_bits(some).select("seq", "residual", "n_bits", "bits").join(place.join(back, ["chunk_id", "at"]).select("seq", "decoded"), "seq")


def _smooth(o: DataFrame) -> DataFrame:
    return o.withColumn("doppler_millihz", (F.lit(1_200_000) + seq % 1000).cast("int"))


@query("""SELECT chunk_id, slot, list_reduce(list(1200000 + seq % 1000 ORDER BY seq), lambda b, x: b + ((x - b) >> 7)) AS base FROM obs GROUP BY ALL""")
def q_fdma_ema(o: DataFrame) -> DataFrame:
    return doppler.fdma_residuals(_smooth(o)).groupBy("chunk_id", "slot").agg(F.max_by("base", "seq").alias("base"))


@query("SELECT seq, slot AS sat_id, doppler_millihz AS v FROM obs")
def q_fdma_roundtrip(o: DataFrame) -> DataFrame:
    """All rows as GLONASS ones by their slot: to bits, and back from the bits."""
    glo = o.withColumn("constellation", F.lit("GLO")).withColumn("sat_id", slot)
    return _rows_of(doppler.decode_doppler(doppler.encode_doppler(glo))).select("seq", "sat_id", F.col("doppler_millihz").alias("v"))


@query("SELECT seq, constellation, sat_id, doppler_millihz AS v, NULL::VARCHAR AS error_code FROM obs")
def q_registry_roundtrip(o: DataFrame) -> DataFrame:
    back = _rows_of(doppler.decode_doppler(doppler.encode_doppler(o)))
    return back.select("seq", "constellation", "sat_id", F.col("doppler_millihz").alias("v"), "error_code")


@query("SELECT chunk_id, count(*) AS n, CAST(sum(CASE WHEN first = seq THEN 33 WHEN constellation = 'GLO' THEN CASE WHEN residual = 0 THEN 2 ELSE 17 END WHEN residual = 0 THEN 2 ELSE 19 END) AS BIGINT) AS n_bits FROM (SELECT *, min(seq) OVER w AS first, 0 AS residual FROM obs WINDOW w AS (PARTITION BY chunk_id, constellation, sat_id)) GROUP BY 1")
def q_registry_constant(o: DataFrame) -> DataFrame:
    """Constant values: each satellite of a chunk is written once, and two bits for each further row."""
    e = doppler.encode_doppler(o.withColumn("doppler_millihz", F.lit(1_200_000)))
    return e.select("chunk_id", F.col("sample_count").alias("n"), "n_bits")


@query("SELECT chunk_id, CASE WHEN arg_min(constellation, seq) <> 'GLO' THEN 'InvalidBitPattern' END AS error_code, CASE WHEN arg_min(constellation, seq) <> 'GLO' THEN 0 ELSE count(*) END AS good FROM obs GROUP BY 1")
def q_doppler_corrupt(o: DataFrame) -> DataFrame:
    """A first bit turned round is an error of a last-value codec; the slow-average codec does not look at it."""
    e = doppler.encode_doppler(o)
    h = F.hex("payload")
    first = F.lpad(F.conv((F.conv(h.substr(1, 2), 16, 10).cast("int") + 128).cast("string"), 10, 16), 2, "0")
    d = doppler.decode_doppler(e.withColumn("payload", F.unhex(F.concat(first, h.substr(F.lit(3), F.length(h))))))
    return d.groupBy("chunk_id").agg(F.max("error_code").alias("error_code"), F.count(F.when(F.col("error_code").isNull(), 1)).alias("good"))


@query("SELECT seq % 4 AS written, count(*) AS n, seq % 4 <= 1 AS readable, seq % 4 <= 1 AS writable, false AS deprecated, CASE WHEN seq % 4 > 1 THEN 'format is newer than the reader; format cannot be read' ELSE '' END AS warned FROM obs GROUP BY ALL")
def q_compatibility(o: DataFrame) -> DataFrame:
    v = wire.compatibility(F.lit(1), F.col("written"))
    g = o.groupBy((seq % 4).alias("written")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("written", "n", v["readable"].alias("readable"), v["writable"].alias("writable"), v["deprecated"].alias("deprecated"), F.array_join(v["warnings"], "; ").alias("warned"))


@query("SELECT DISTINCT CAST(seq % 256 AS INTEGER) AS byte, CASE WHEN seq % 256 = 1 THEN 1 END AS version, CASE WHEN seq % 256 = 1 THEN 'Version 1 (initial encoding)' END AS description, CASE WHEN seq % 256 <> 1 THEN 'InvalidVersion' END AS error_code, CASE WHEN seq % 256 <> 1 THEN seq % 256 END AS error_value FROM obs")
def q_format_version(o: DataFrame) -> DataFrame:
    bytes_ = o.select((seq % 256).cast("int").alias("byte")).distinct()
    return bytes_.select("byte", wire.format_version(F.col("byte")).alias("v")).select("byte", "v.*")


@query("SELECT seq, " + ", ".join(f"sat_id BETWEEN {SYSTEMS[s][0]} AND {SYSTEMS[s][1]} AS {s.lower()}_id, pseudorange_mm BETWEEN {SYSTEMS[s][2]} AND {SYSTEMS[s][3]} AS {s.lower()}_range, {ABS} <= {SYSTEMS[s][4]} AS {s.lower()}_doppler, sat_id BETWEEN {SYSTEMS[s][0]} AND {SYSTEMS[s][1]} AND pseudorange_mm BETWEEN {SYSTEMS[s][2]} AND {SYSTEMS[s][3]} AND {ABS} <= {SYSTEMS[s][4]} AS {s.lower()}_valid" for s in ("GPS", "GAL", "BDS")) + " FROM obs")
def q_is_valid(o: DataFrame) -> DataFrame:
    out = []
    for k in ("GPS", "GAL", "BDS"):
        parts = (V.is_valid_id(k, s), V.is_valid_pseudorange(k, mm), V.is_valid_doppler(k, mhz), V.is_valid(k))
        out += [x.alias(f"{k.lower()}_{n}") for x, n in zip(parts, ("id", "range", "doppler", "valid"))]
    return o.select("seq", *out)


@query("SELECT seq, CASE WHEN sat_id BETWEEN 1 AND 32 THEN 'GPS' || sat_id END AS as_gps, CASE WHEN sat_id BETWEEN 1 AND 36 THEN 'GAL' || sat_id END AS as_galileo, CASE WHEN sat_id BETWEEN 1 AND 63 THEN 'BDS' || sat_id END AS as_beidou, CASE WHEN sat_id BETWEEN -7 AND 6 THEN 'GLO' || sat_id END AS as_glonass FROM obs")
def q_satellites(o: DataFrame) -> DataFrame:
    shown = lambda x: F.when(x.isNotNull(), F.concat(x["constellation"], x["sat_id"]))
    return o.select("seq", shown(S.gps(s)).alias("as_gps"), shown(S.galileo(s)).alias("as_galileo"), shown(S.beidou(s)).alias("as_beidou"), shown(S.glonass(s)).alias("as_glonass"))


#: Frames of 24 rows, whose time is nearly always that of the first row; what an insert after the other does, by earlier rows.
FRAMED = """, f AS (SELECT seq // 24 AS frame_id, seq, CASE WHEN seq % 13 = 12 THEN 8 ELSE slot END AS slot, timestamp_ms // 3600000 + (CASE WHEN seq % 17 = 16 THEN 1 ELSE 0 END) AS timestamp_ms FROM obs),
t AS (SELECT *, first_value(timestamp_ms) OVER (PARTITION BY frame_id ORDER BY seq) AS time FROM f),
ok AS (SELECT frame_id, slot, min(seq) AS seq FROM t WHERE slot <= 6 AND timestamp_ms = time GROUP BY 1, 2),
e AS (SELECT t.*, CASE WHEN slot > 6 THEN 'InvalidSlot' WHEN timestamp_ms <> time THEN 'TimestampMismatch' WHEN (SELECT count(*) FROM ok WHERE ok.frame_id = t.frame_id AND ok.seq < t.seq) >= 14 THEN 'FrameFull'
 WHEN EXISTS (SELECT 1 FROM ok WHERE ok.frame_id = t.frame_id AND ok.slot = t.slot AND ok.seq < t.seq) THEN 'DuplicateSlot' END AS error_code FROM t)
"""


def _framed(o: DataFrame) -> DataFrame:
    odd = o.withColumn("slot", F.when(seq % 13 == 12, 8).otherwise(slot)).withColumn("frame_id", F.floor(seq / 24).cast("long"))
    return odd.withColumn("timestamp_ms", F.floor(ts / 3_600_000).cast("long") + F.when(seq % 17 == 16, 1).otherwise(0))


@query(FRAMED + "SELECT seq, error_code FROM e")
def q_frame_insert(o: DataFrame) -> DataFrame:
    return epochs.insert_errors(_framed(o)).select("seq", "error_code")


@query(FRAMED + "SELECT frame_id, arg_min(error_code, seq) FILTER (error_code IS NOT NULL) AS error_code, CASE WHEN count(error_code) = 0 THEN count(*) ELSE 0 END AS n, CASE WHEN count(error_code) = 0 THEN string_agg(slot::VARCHAR || ':' || seq::VARCHAR, ',' ORDER BY slot) END AS members FROM e GROUP BY 1")
def q_frame_from_samples(o: DataFrame) -> DataFrame:
    return epochs.frames(_framed(o)).select("frame_id", "error_code", F.col("n").cast("long").alias("n"), F.array_join(F.transform("observations", lambda x: F.concat_ws(":", x["slot"], x["seq"])), ",").alias("members"))


@query(FRAMED + "SELECT frame_id, arg_min(timestamp_ms, seq) AS timestamp_ms, count(*) FILTER (error_code IS NULL) AS n, min(slot) FILTER (error_code IS NULL) AS min_slot, max(slot) FILTER (error_code IS NULL) AS max_slot, CASE WHEN count(*) FILTER (error_code IS NULL) = 0 THEN 'EmptyChunk' END AS error_code FROM e GROUP BY 1")
def q_frame_to_epoch(o: DataFrame) -> DataFrame:
    """The rows that could be inserted, as a frame, as an epoch, and as a frame again."""
    f = epochs.frames(_framed(o), partial=True).drop("error_code")
    back = epochs.to_frames(epochs.to_epochs(f)).drop("frame_id")
    ids = f.select("frame_id", F.xxhash64("timestamp_ms", "observations").alias("of"))
    return ids.join(back.withColumn("of", F.xxhash64("timestamp_ms", "observations")), "of").select("frame_id", "timestamp_ms", F.col("n").cast("long").alias("n"), "min_slot", "max_slot", "error_code").dropDuplicates(["frame_id"])


@query("SELECT chunk_id, count(*) AS n FROM obs GROUP BY 1")
def q_epoch_counts_by_chunk(o: DataFrame) -> DataFrame:
    e = chunks.encode_chunks(o)
    return e.select("chunk_id", F.col("sample_count").alias("n"))


@query(GROUPS + "SELECT e.timestamp_ms AS chunk_id, slot, seq AS of FROM g JOIN e USING (timestamp_ms) WHERE n = slots AND n <= 14")
def q_epoch_encode(o: DataFrame) -> DataFrame:
    h = _hourly(o)
    d = chunks.decode_chunks(epochs.encode_epochs(h)).select("chunk_id", "slot")
    return d.join(h.select(F.col("timestamp_ms").alias("chunk_id"), "slot", F.col("seq").alias("of")), ["chunk_id", "slot"])


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors can write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written_log(spark: SparkSession, sf_dir: str) -> str:
    path = _scratch(spark, "log")
    spark.dataSource.register(framed.FramedLog)
    chunks.encode_chunks(observations(spark, sf_dir)).select("payload").write.format("framed").mode("append").option("path", path).save()
    return path


def q_frame_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written_log(spark, sf_dir)
    frames = spark.read.format("framed").option("path", path).load()
    rows = chunks.decode_chunks(frames.select(F.col("frame_no").alias("chunk_id"), "payload"))
    return rows.select("timestamp_ms", "slot", "cn0_dbhz", "pseudorange_mm", "doppler_millihz", "carrier_phase_cycles")


QUERIES["q_frame_log"] = q_frame_log
ORACLES["q_frame_log"] = f"WITH {SQL} SELECT timestamp_ms, slot, cn0_dbhz, pseudorange_mm, doppler_millihz, carrier_phase_cycles FROM obs"


def q_log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writers counted, and what a reader finds."""
    path = _written_log(spark, sf_dir)
    counted = framed.counters(spark, path).agg(F.sum("chunks_written").alias("chunks_written"), F.sum("bytes_written").alias("bytes_written"))
    found = framed.read_frames(spark, path).agg(F.count(F.lit(1)).alias("frames"), F.sum(F.col("payload_len") + 4).alias("bytes_read"))
    return counted.crossJoin(found)  # one row each


QUERIES["q_log_counters"] = q_log_counters
ORACLES["q_log_counters"] = f"WITH {SQL} {SIZES} SELECT count(*) AS chunks_written, CAST(sum(chunk_bytes + 4) AS BIGINT) AS bytes_written, count(*) AS frames, CAST(sum(chunk_bytes + 4) AS BIGINT) AS bytes_read FROM sizes"


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the events as a stream, by track, with what is left at the end of each batch."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one for this kind of state
    try:
        path = _scratch(spark, "stream")
        out = stream_chunks(event_stream(spark, sf_dir), max_rows=100, rest="batch").writeStream.format("parquet")
        out.option("path", f"{path}/chunks").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(OUTPUT).parquet(f"{path}/chunks")


def q_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows again from the stream's chunks."""
    written = _streamed(spark, sf_dir)
    # a chunk of a track is known by both numbers, here as one
    rows = chunks.decode_chunks(written.select((F.col("track_id") * 1_000_000 + F.col("chunk_no")).alias("chunk_id"), "payload"), mode="FAILFAST")
    return rows.select(F.floor(F.col("chunk_id") / 1_000_000).alias("track_id"), "timestamp_ms", "slot", "cn0_dbhz", "pseudorange_mm", "doppler_millihz", "carrier_phase_cycles")


QUERIES["q_stream"] = q_stream
ORACLES["q_stream"] = f"WITH {SQL} SELECT track_id, timestamp_ms, slot, cn0_dbhz, pseudorange_mm, doppler_millihz, carrier_phase_cycles FROM obs"


def q_stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).select("track_id", "chunk_no", "sample_count")


QUERIES["q_stream_chunks"] = q_stream_chunks
ORACLES["q_stream_chunks"] = f"WITH {SQL} SELECT track_id, (n - 1) // 100 AS chunk_no, count(*) AS sample_count FROM (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq) AS n FROM obs) GROUP BY 1, 2"


def entry(spark: SparkSession) -> DataFrame:
    """Chunk sizes and compression ratios of the smallest table."""
    return buckets.chunk_sizes(observations(spark, "/root/testdata/sf0.001"))
