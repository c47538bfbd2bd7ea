"""Fixed values that results depend on."""

# Sizes and limits.
MEMTABLE_LIMIT = 1024
RECORD_OVERHEAD = 21  # 17 bytes of header and 4 of checksum
WAL_BLOCK = 64 * 1024
REPLAY_BATCH = 256
CDC_PAGE = 100
CDC_PAGE_MAX = 1000
CDC_RETAIN = 4096
OPERATIONS_REMEMBERED = 256
WRITE_REQUESTS = 4096
TRASH_BYTES = 512 * 1024 * 1024
TRASH_FILES = 1024
LEVEL_MULTIPLIER = 10
BLOCK_TARGET = 64 * 1024
BLOCK_MAX = 256 * 1024
RESTART_EVERY = 16
BLOOM_BITS = 10
NODE, CLUSTER, STORAGE, REPLICAS = "node-0", "cluster-local", "local", 3
DEFAULT_SHARD = "default"

# Errors of a write, their HTTP status, and which a client may try again.
WRITE_ERRORS = {
    "not_leader": (409, True),
    "shard_not_found": (404, True),
    "backpressure": (429, True),
    "closed": (503, False),
}
OTHER_ERROR = ("invalid", 400, False)
