"""Schemas, fixed values of the data model, and error codes."""

from __future__ import annotations

OBS = (
    "seq long, constellation string, sat_id int, timestamp_ms long, cn0_dbhz int, pseudorange_mm long, "
    "doppler_millihz int, carrier_phase_cycles long"
)
CHUNKS = "chunk_id long, sample_count long, payload binary, error_code string"
FRAMES = "path string, frame_no long, byte_offset long, payload_len long, payload binary, error string"

# Satellite systems in order, with id range, pseudorange (mm), largest absolute Doppler (mHz).
SYSTEMS = {
    "GLO": (-7, 6, 19_100_000_000, 25_600_000_000, 5_000_000, "InvalidSlot"),
    "GPS": (1, 32, 20_200_000_000, 25_600_000_000, 6_000_000, "InvalidPrn"),
    "GAL": (1, 36, 23_222_000_000, 29_000_000_000, 4_500_000, "InvalidSvn"),
    "BDS": (1, 63, 21_500_000_000, 42_000_000_000, 5_000_000, "InvalidPrn"),
}
# Carriers in Hz.
CARRIERS = {
    "GPS_L1": 1_575_420_000,
    "GPS_L2": 1_227_600_000,
    "GAL_E1": 1_575_420_000,
    "GAL_E5A": 1_176_450_000,
    "GAL_E5B": 1_207_140_000,
    "BDS_B1I": 1_561_098_000,
    "BDS_B1C": 1_575_420_000,
    "BDS_B2A": 1_176_450_000,
}
GLONASS_BASE_HZ, GLONASS_STEP_HZ = 1_602_000_000, 562_500
GENERIC_MAX_DOPPLER = 10_000_000
CN0_MAX, CN0_TRACKED, CN0_STRONG = 60, 20, 40
SLOT_MIN, SLOT_MAX, SLOTS = -7, 6, 14
MAX_SATELLITES = 14
MAGIC, VERSION, HEADER_LEN = bytes.fromhex("4b524f47"), 1, 9
RAW_ROW, PHASE_BYTES = 23, 8
FRAME_HEADER_LEN, MAX_FRAME_PAYLOAD = 4, 64 << 20
EMA_SHIFT = 7
MIN_BUFFER, MIN_BUFFER_PHASE = 32, 40

# Names of the error variants.
ERRORS = (
    "EmptyChunk UnexpectedEof InvalidSlot InvalidPrn InvalidSvn InvalidDbHz InvalidSlotIndex InvalidCn0 InvalidBitCount "
    "ValueTooLarge BufferFull InvalidPhaseFlag InvalidVersion InvalidMagic InvalidPseudorange InvalidDoppler TimestampMismatch "
    "DuplicateSlot FrameFull OverflowCn0 OverflowPseudorange OverflowDoppler InvalidBitPattern InvalidTimestamp"
).split()


# An extension: a null where the data model has a number.
NULL_VALUE = "NullValue"


class CodecError(ValueError):
    """An error of the data model, known by its variant's name and value."""

    def __init__(self, code: str, value: int | None = None):
        super().__init__(code if value is None else f"{code}({value})")
        self.code, self.value = code, value
