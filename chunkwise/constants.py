"""Numbers and names of the frame format.

Fixed values: frames written elsewhere are only readable with exactly these.
"""

# Header lengths and format versions (byte 0).
HEADER_V1, HEADER_V2 = 16, 32
VERSION_V1, VERSION_V2 = 2, 5
EXTENDED_VERSIONS = (3, 4, 5)
KNOWN_VERSIONS = (1, 2, 3, 4, 5)
CODEC_FORMAT_VERSION = 1

# Flag bits (byte 2); bits 5 to 7 hold the codec's format code.
FLAG_SHUFFLE, FLAG_MEMCPY, FLAG_BITSHUFFLE, FLAG_DELTA, FLAG_DONT_SPLIT = 0x01, 0x02, 0x04, 0x08, 0x10
FORMAT_SHIFT = 5

# Filters, by name and id.
NOFILTER, SHUFFLE, BITSHUFFLE, DELTA, TRUNC_PREC = 0, 1, 2, 3, 4
FILTERS = {"none": NOFILTER, "shuffle": SHUFFLE, "bitshuffle": BITSHUFFLE}
MAX_FILTERS = 6

# Codecs: name, id, format code in v1 flags, format code in v2 flags.
BYTELZ, LZ4, LZ4HC, SNAPPY, ZLIB, ZSTD = 0, 1, 2, 3, 4, 5
CODECS = {
    "bytelz": (BYTELZ, 0, 0),
    "lz4": (LZ4, 1, 1),
    "lz4hc": (LZ4HC, 1, 1),
    "snappy": (SNAPPY, 2, 3),
    "zlib": (ZLIB, 3, 3),
    "zstd": (ZSTD, 4, 4),
}
CODEC_NAMES = {i: name for name, (i, _, _) in CODECS.items()}
#: Names that codecs have elsewhere.
ALIASES = {"blosclz": "bytelz"}
#: What a v1 format code decodes to.
V1_FORMATS = {0: BYTELZ, 1: LZ4, 2: SNAPPY, 3: ZLIB, 4: ZSTD}

# Library names and versions reported for each codec name, and the library's code.
LIBRARIES = {
    "blosclz": ("BloscLZ", "2.5.1", 0),
    "lz4": ("LZ4", "1.9.4", 1),
    "lz4hc": ("LZ4", "1.9.4", 1),
    "snappy": ("Snappy", "1.1.9", 2),
    "zlib": ("Zlib", "1.2.11", 3),
    "zstd": ("Zstd", "1.5.2", 4),
}

# Sizes.
MAX_BUFFER = 2**31 - 1 - HEADER_V2
MIN_BUFFER = 32
MAX_TYPESIZE = 255
MAX_SPLIT_TYPESIZE = 16
MIN_SPLIT_ITEMS = 32
L1 = 32 * 1024
MAX_SPLIT_BLOCK = 4 * 1024 * 1024

# Defaults of the parameters.
DEFAULT_CODEC, DEFAULT_CLEVEL, DEFAULT_TYPESIZE, DEFAULT_FILTER = "bytelz", 5, 8, "none"
DEFAULT_NTHREADS = 1
EASY_FILTER = "shuffle"

# Outcomes, as they stand in status columns.
OK, INVALID_HEADER, FAILED, UNSUPPORTED_CODEC, OUT_OF_RANGE = "ok", "invalid_header", "failed", "unsupported_codec", "out_of_range"
MESSAGES = {INVALID_HEADER: "invalid header", FAILED: "decompression failed"}

# The rest of the format's surface: nothing here decides how frames are read or written
# by this engine, but frames and callers elsewhere use these values.

# Where each field of a header stands.
HEADER_OFFSETS = {
    "version": 0x00, "versionlz": 0x01, "flags": 0x02, "typesize": 0x03, "nbytes": 0x04, "blocksize": 0x08,
    "cbytes": 0x0C, "filters": 0x10, "filters_meta": 0x18, "v2_flags": 0x1F,
}

# Flags of the last header byte, special frames, split modes.
USE_DICT, BIG_ENDIAN, INSTRUMENTED = 0x01, 0x02, 0x80
SPECIAL_VALUES = {"none": 0, "zero": 1, "nan": 2, "value": 3, "uninit": 4}
SPECIAL_MASK = 0x07
SPLIT_MODES = {"always": 1, "never": 2, "auto": 3, "forward_compat": 4}

# Limits.
MAX_OVERHEAD = HEADER_V2
L2 = 256 * 1024
MAX_THREADS = 256
MAX_DICT_SIZE = 128 * 1024
MAX_BLOCKSIZE = 536_866_816
MAX_DIMENSIONS = 8
MAX_USER_FILTERS = 16

# Who may use which ids of filters, codecs and tuners.
ID_RANGES = {"defined": (0, 31), "globally_registered": (32, 159), "user_registered": (160, 255)}
GLOBALLY_REGISTERED = {"filters": 5, "codecs": 5, "tuners": 0}
UDCODEC_LIBRARY, SCHUNK_LIBRARY = 6, 7

# Error codes.
ERROR_CODES = {
    "success": 0,
    "failure": -1,
    "stream": -2,
    "data": -3,
    "memory_alloc": -4,
    "read_buffer": -5,
    "write_buffer": -6,
    "codec_support": -7,
    "codec_param": -8,
    "codec_dict": -9,
    "version_support": -10,
    "invalid_header": -11,
    "invalid_param": -12,
    "file_read": -13,
    "file_write": -14,
    "file_open": -15,
    "not_found": -16,
    "run_length": -17,
    "filter_pipeline": -18,
    "chunk_insert": -19,
    "chunk_append": -20,
    "chunk_update": -21,
    "2gb_limit": -22,
    "schunk_copy": -23,
    "frame_type": -24,
    "file_truncate": -25,
    "thread_create": -26,
    "postfilter": -27,
    "frame_special": -28,
    "schunk_special": -29,
    "plugin_io": -30,
    "file_remove": -31,
    "null_pointer": -32,
    "invalid_index": -33,
    "metalayer_not_found": -34,
    "max_bufsize_exceeded": -35,
    "tuner": -36,
}

#: The code of each outcome in a status column.
STATUS_CODES = {OK: 0, FAILED: ERROR_CODES["failure"], INVALID_HEADER: ERROR_CODES["invalid_header"], UNSUPPORTED_CODEC: ERROR_CODES["codec_support"], OUT_OF_RANGE: ERROR_CODES["invalid_index"]}
