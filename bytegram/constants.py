"""Fixed values that decide results.

These mirror the on-disk conventions of the system whose answers we reproduce; they must
not be changed, or counts, intervals and windows stop matching.
"""

# Corpus byte layout.
# Every document is preceded by one separator byte; every shard ends with one sentinel byte.
DOC_SEP = 0xFF
SENTINEL = 0x00

# Accepted source file name endings (case-sensitive, matched with endswith).
SOURCE_SUFFIXES = (".parquet", ".jsonl", ".json.gz", ".zst", ".zstd")

# Request defaults.
DEFAULT_MAX_RESULTS = 10
DEFAULT_MAX_CTX_LEN = 200
QUERY_TYPES = ("count", "find", "get_doc_by_rank", "search")

# Texts of refused arguments.
SHARD_RANGE = "Shard index s={s} is out of range [0, {n})."
NEGATIVE = "{name} must be non-negative, got {value}."

# Highlight label of a needle fragment.
HIGHLIGHT_LABEL = "0"

# Tuning (not result-bearing).
SUFFIX_KEY_BYTES = 32          # bytes of a suffix kept in the index key
ORDERED_KEY_BYTES = 16         # bytes that the suffix table is sorted by; what goes on equal is put in order on demand
SEED_BYTES = 8                 # seed length for the batch count join
CHUNK_BYTES = 1 << 16          # documents longer than this are cut into chunks before exploding positions
PREFIX_BUCKET_ROWS = 1 << 16   # rows per bucket of the two-level prefix sum
PART_BYTES = 64 << 20          # bytes of texts and metadata that are sorted in one task
KEY_RANGES = 64                # key ranges that a batch of queries pushes down to the index scan
