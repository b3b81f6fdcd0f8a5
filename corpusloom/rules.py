"""Rules, lexicons, templates and settings as data.

Everything here is a plain Python value. Operators take these values as
parameters (or as small DataFrames built from them with
:func:`rules_frame`), so a user swaps a lexicon without touching code.

Two groups:

* FIXED VALUES — values that must equal the behaviour being reproduced
  (patterns, keyword lists, step templates, queue settings, thresholds).
  They are written out plainly, in their natural order.
* FIXTURE LEXICONS — our own small rule sets for the driver tables, which
  contain no networking vocabulary and no source code.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced behaviour; do not reorder)
# ---------------------------------------------------------------------------

# Scored categorisation: (category, pattern); matched case-insensitively,
# score = number of non-overlapping matches; ties go to the first declared.
CATEGORY_PATTERNS = [
    ("socket_programming", r"\b(socket|bind|listen|accept|connect|send|recv|sendall|recvfrom)\b"),
    ("http_requests", r"\b(requests|urllib|http\.client|httplib|GET|POST|PUT|DELETE)\b"),
    ("async_networking", r"\b(async|await|asyncio|aiohttp|aiofiles|uvloop)\b"),
    ("api_clients", r"\b(api|rest|json|endpoint|client|graphql|oauth)\b"),
    ("websockets", r"\b(websocket|ws:|wss:|socket\.io)\b"),
    ("network_security", r"\b(ssl|tls|cert|crypto|auth|jwt|oauth|https)\b"),
    ("dns_resolution", r"\b(dns|resolver|nslookup|dig|getaddrinfo|gethostbyname)\b"),
    ("tcp_udp", r"\b(tcp|udp|datagram|stream|SOCK_STREAM|SOCK_DGRAM)\b"),
    ("network_monitoring", r"\b(pcap|wireshark|tcpdump|netstat|iperf|ping|traceroute)\b"),
    ("proxy_tunneling", r"\b(proxy|tunnel|socks|http_proxy|vpn|tor)\b"),
    ("quic_http3", r"\b(quic|http3|h3|aioquic)\b"),
    ("grpc", r"\b(grpc|protobuf|proto|rpc)\b"),
]
DEFAULT_CATEGORY = "general_networking"

# Context override (applied before scoring), in order:
# (field, substrings, category); field is "path" or "repo".
CONTEXT_RULES = [
    ("path", ["ssl", "tls", "crypto"], "network_security"),
    ("repo", ["security"], "network_security"),
    ("path", ["dns", "resolver"], "dns_resolution"),
    ("path", ["websocket", "ws"], "websockets"),
]

# First-match categorisation (older builder): (category, substrings).
FIRST_MATCH_RULES = [
    ("socket_programming", ["socket", "bind"]),
    ("http_requests", ["requests", "urllib"]),
    ("async_networking", ["async", "await"]),
    ("api_clients", ["api", "rest"]),
    ("websockets", ["websocket"]),
    ("network_security", ["ssl", "tls"]),
]

# Symbol extraction patterns (case-insensitive).
FUNCTION_PATTERN = r"(?:def|function|func)\s+(\w+)\s*\("
CLASS_PATTERN = r"class\s+(\w+)(?:\([^)]*\))?:"
IMPORT_PATTERN = r"(?:import\s+(\w+(?:\.\w+)*)|from\s+(\w+(?:\.\w+)*)\s+import)"

# Complexity indicators, counted as plain substrings of the lower-cased text.
COMPLEXITY_INDICATORS = ["if", "for", "while", "try", "except", "with", "async", "await"]

# Resource keyword lists (substring match on the lower-cased action).
IO_KEYWORDS = [
    "send", "receive", "read", "write", "download", "upload", "fetch",
    "connect", "listen", "accept", "bind", "lookup", "request", "response",
    "socket", "network", "tcp", "udp", "http", "dns", "ping", "curl",
    "stream", "buffer", "file", "disk", "database", "cache",
]
GPU_KEYWORDS = [
    "render", "visualize", "cryptographic", "hash", "encrypt", "decrypt",
    "complex calculation", "parallel", "matrix", "tensor", "cuda", "opencl",
    "gpu", "acceleration", "compute", "shader",
]
MEMORY_KEYWORDS = [
    "malloc", "alloc", "free", "garbage", "gc", "memory", "heap", "stack",
    "buffer", "cache", "pool", "mmap",
]
NETWORK_KEYWORDS = [
    "bandwidth", "latency", "throughput", "congestion", "routing", "switching",
    "firewall", "load balancer", "cdn", "dns", "dhcp",
]
# Newer classifier order: I/O, NETWORK, GPU, MEMORY, else CPU.
RESOURCE_RULES = [
    ("I/O", IO_KEYWORDS),
    ("NETWORK", NETWORK_KEYWORDS),
    ("GPU", GPU_KEYWORDS),
    ("MEMORY", MEMORY_KEYWORDS),
]
# Older classifier: I/O, GPU, CPU lists, else CPU.
RESOURCE_RULES_BASIC = [
    ("I/O", ["send", "receive", "read", "write", "download", "upload", "fetch", "connect", "listen",
             "lookup", "request", "response"]),
    ("GPU", ["render", "visualize", "cryptographic hash", "complex calculation"]),
    ("CPU", ["parse", "process", "calculate", "analyze", "decompress", "verify", "validate", "prepare",
             "generate", "create", "construct"]),
]
# Older action lists by category (default: one generic action).
BASIC_ACTIONS = {
    "http_requests": ["Prepare request headers", "Establish TCP connection", "Send HTTP request",
                      "Receive HTTP response", "Parse response body"],
    "socket_programming": ["Create socket", "Bind address", "Listen for connection", "Accept connection",
                           "Send/receive data"],
    "api_clients": ["Define API endpoint and parameters", "Construct request payload",
                    "Send request over network", "Process JSON response"],
}
BASIC_DEFAULT_ACTIONS = ["Analyze code execution flow"]
BASIC_SOURCE = "github_scrapling"

# Criticality keyword lists, checked critical, high, low; else medium.
CRITICALITY_RULES = [
    ("critical", ["verify", "validate", "authenticate", "encrypt", "decrypt", "security"]),
    ("high", ["connect", "send", "receive", "establish", "handshake"]),
    ("low", ["initialize", "prepare", "cleanup", "close"]),
]
DEFAULT_CRITICALITY = "medium"

# Timing ranges in microseconds per resource, and criticality multipliers.
BASE_TIMES_US = {
    "CPU": (10, 1000),
    "GPU": (100, 10000),
    "I/O": (1000, 500000),
    "NETWORK": (5000, 2000000),
    "MEMORY": (5, 500),
}
CRITICALITY_MULTIPLIERS = {"low": 0.5, "medium": 1.0, "high": 2.0, "critical": 4.0}

# Step templates per category:
# (action, resource, criticality, min_us, max_us, typical_us, parallelizable, dependencies)
# Dependencies are written as in the source data: 0-based indexes.
STEP_TEMPLATES = {
    "http_requests": [
        ("Parse URL and extract components", "CPU", "medium", 20, 100, 50, False, []),
        ("Prepare request headers and payload", "CPU", "medium", 30, 150, 80, False, []),
        ("Resolve DNS for hostname", "I/O", "high", 5000, 50000, 15000, True, []),
        ("Establish TCP connection", "I/O", "high", 10000, 200000, 50000, False, [2]),
        ("Send HTTP request", "I/O", "high", 1000, 20000, 5000, False, [3]),
        ("Receive HTTP response headers", "I/O", "high", 2000, 100000, 20000, False, [4]),
        ("Receive and buffer response body", "I/O", "medium", 5000, 500000, 100000, False, [5]),
        ("Parse response and handle status codes", "CPU", "medium", 50, 500, 200, False, [6]),
    ],
    "socket_programming": [
        ("Create socket object", "CPU", "medium", 10, 50, 25, False, []),
        ("Configure socket options", "CPU", "low", 20, 100, 60, False, []),
        ("Bind socket to address and port", "I/O", "high", 100, 1000, 300, False, [0, 1]),
        ("Listen for incoming connections", "I/O", "high", 50, 500, 150, False, [2]),
        ("Accept client connection", "I/O", "high", 1000, 50000, 10000, False, [3]),
        ("Send/receive data packets", "I/O", "high", 500, 100000, 20000, False, [4]),
        ("Handle connection cleanup and close", "CPU", "medium", 100, 1000, 400, False, [5]),
    ],
    "async_networking": [
        ("Initialize event loop", "CPU", "high", 100, 1000, 400, False, []),
        ("Create async context manager", "CPU", "medium", 50, 300, 150, False, []),
        ("Schedule multiple coroutines", "CPU", "medium", 200, 2000, 800, True, [0, 1]),
        ("Handle concurrent I/O operations", "I/O", "high", 1000, 200000, 50000, True, [2]),
        ("Aggregate results from coroutines", "CPU", "medium", 100, 1000, 500, False, [3]),
        ("Cleanup async resources and event loop", "CPU", "medium", 200, 2000, 600, False, [4]),
    ],
    "network_security": [
        ("Initialize SSL/TLS context", "CPU", "high", 500, 5000, 2000, False, []),
        ("Load certificates and private keys", "I/O", "critical", 1000, 10000, 4000, False, []),
        ("Perform certificate chain validation", "CPU", "critical", 2000, 20000, 8000, False, [1]),
        ("Execute cryptographic handshake", "CPU", "critical", 5000, 50000, 20000, False, [0, 2]),
        ("Establish secure communication channel", "I/O", "high", 1000, 15000, 6000, False, [3]),
        ("Encrypt/decrypt data packets", "CPU", "high", 100, 5000, 1500, False, [4]),
    ],
    "dns_resolution": [
        ("Parse and validate domain name", "CPU", "medium", 20, 200, 80, False, []),
        ("Check local DNS cache", "MEMORY", "low", 10, 100, 30, False, []),
        ("Query configured DNS resolver", "I/O", "high", 5000, 100000, 25000, True, []),
        ("Handle recursive DNS resolution", "I/O", "high", 10000, 300000, 80000, False, [2]),
        ("Parse DNS response packets", "CPU", "medium", 50, 500, 200, False, [3]),
        ("Cache DNS results", "MEMORY", "low", 30, 300, 100, False, [4]),
    ],
    "websockets": [
        ("Send HTTP upgrade request", "I/O", "high", 1000, 10000, 4000, False, []),
        ("Validate WebSocket upgrade headers", "CPU", "high", 100, 1000, 400, False, [0]),
        ("Complete WebSocket handshake protocol", "I/O", "high", 2000, 20000, 8000, False, [1]),
        ("Establish bidirectional communication", "I/O", "medium", 500, 5000, 2000, False, [2]),
        ("Handle WebSocket frame encoding/decoding", "CPU", "medium", 50, 1000, 300, False, [3]),
        ("Manage connection keepalive and ping/pong", "I/O", "low", 1000, 30000, 10000, True, [3]),
    ],
}

# Generic steps for categories without a template: the action list, timing
# range (100, 5000, 1000), resource I/O when the action mentions "network",
# criticality high when it mentions "error", dependency on the previous step.
GENERIC_ACTIONS = [
    "Initialize components and variables",
    "Process input data and parameters",
    "Execute core networking operations",
    "Handle response and error conditions",
    "Cleanup resources and connections",
]

# Synthetic operations: name -> (category, complexity, templates).
SYNTHETIC_OPERATIONS = [
    ("TCP 3-way handshake", "tcp_connection_management", "medium", [
        ("Client sends SYN packet with ISN", "I/O", "high", 100, 2000, 600, False, []),
        ("Server receives SYN and allocates TCB", "CPU", "high", 50, 500, 200, False, [0]),
        ("Server sends SYN-ACK response", "I/O", "high", 100, 2000, 600, False, [1]),
        ("Client receives SYN-ACK and sends ACK", "I/O", "high", 100, 2000, 600, False, [2]),
        ("Connection established and ready", "CPU", "medium", 20, 200, 80, False, [3]),
    ]),
    ("QUIC Connection Establishment", "quic_http3", "high", [
        ("Generate connection ID and initial keys", "CPU", "high", 500, 5000, 2000, False, []),
        ("Send Initial packet with TLS ClientHello", "I/O", "high", 1000, 10000, 4000, False, [0]),
        ("Receive and process server Initial packet", "I/O", "high", 1000, 15000, 6000, False, [1]),
        ("Complete TLS handshake over QUIC", "CPU", "critical", 5000, 50000, 20000, False, [2]),
        ("Establish 1-RTT protected connection", "I/O", "high", 500, 8000, 3000, False, [3]),
    ]),
    ("gRPC Service Call", "grpc", "medium", [
        ("Serialize protobuf message", "CPU", "medium", 100, 2000, 600, False, []),
        ("Establish HTTP/2 stream", "I/O", "high", 500, 8000, 3000, False, []),
        ("Send gRPC headers and metadata", "I/O", "medium", 200, 3000, 1000, False, [0, 1]),
        ("Stream request message", "I/O", "medium", 1000, 50000, 15000, False, [2]),
        ("Receive and deserialize response", "CPU", "medium", 200, 3000, 1000, False, [3]),
        ("Handle gRPC status and trailers", "CPU", "low", 50, 500, 200, False, [4]),
    ]),
]

# Fixed documentation and tutorial steps: (step, action, us, resource, criticality, deps 1-based).
DOC_STEPS = [
    (1, "Study the documented concept and API usage", 200, "CPU", "medium", []),
    (2, "Understand implementation patterns and best practices", 400, "CPU", "high", [1]),
    (3, "Apply knowledge to practical implementation", 600, "CPU", "high", [2]),
]
TUTORIAL_STEPS = [
    (1, "Understand the problem context and requirements", 150, "CPU", "medium", []),
    (2, "Break down the solution approach and methodology", 300, "CPU", "high", [1]),
    (3, "Implement and test the solution", 800, "I/O", "high", [2]),
    (4, "Validate results and handle edge cases", 400, "CPU", "medium", [3]),
]

# Corpus settings.
MIN_CODE_LENGTH = 100
MAX_CODE_LENGTH = 3000
MIN_BLOCK_STRIPPED = 50
DOC_BLOCKS_PER_ITEM = 3
TUTORIAL_BLOCKS_PER_ITEM = 2
MIN_PER_CATEGORY = 5
MAX_PER_CATEGORY = 100
INSTRUCTION_VARIATIONS = ["Analyze and break down", "Decompose and explain", "Examine and structure",
                          "Study and decompose"]
VARIATION_TARGETS = ["Analyze and decompose", "Break down"]

# Step-to-syscall timing match: keyword -> syscall names, in order.
SYSCALL_MAPPINGS = [
    ("connect", ["connect", "socket"]),
    ("send", ["send", "write", "sendto"]),
    ("receive", ["recv", "read", "recvfrom"]),
    ("dns", ["getaddrinfo", "gethostbyname"]),
    ("ssl", ["ssl_read", "ssl_write"]),
]

# Text preparation rewrites, applied in order: (pattern, tag inserted before the match).
BLANK_LINES_PATTERN = r"\n\s*\n\s*\n"
TAG_RULES = [
    (r"(requests\.|urllib\.|http\.client)", "<HTTP>"),
    (r"(socket\.|asyncio\.)", "<SOCKET>"),
    (r"(try:|except:|raise)", "<ERROR>"),
    (r"(def |class |import )", "<CODE>"),
]

# Multi-label routing of texts and of URLs: (category, substrings).
TEXT_ROUTES = [
    ("socket_programming", ["socket"]),
    ("http_requests", ["http", "requests"]),
    ("async_networking", ["aio"]),
]
URL_ROUTES = [
    ("socket_programming", ["socket"]),
    ("network_protocols", ["http"]),
    ("api_clients", ["api"]),
    ("network_protocols", ["websocket"]),
]

# Task analysis.
TASK_KEYWORDS = {
    "video": ["video", "encode", "h264", "h265", "render", "transcode", "codec", "ffmpeg", "streaming"],
    "ml": ["model", "inference", "neural", "predict", "tensorflow", "pytorch", "train", "deep", "ai"],
    "database": ["query", "database", "sql", "select", "insert", "update", "postgres", "mysql", "index"],
    "financial": ["finance", "calculate", "portfolio", "risk", "pricing", "monte", "carlo", "var", "trading"],
    "image": ["image", "filter", "resize", "crop", "process", "opencv", "pil", "transform", "vision"],
    "data_processing": ["csv", "excel", "json", "xml", "parse", "transform", "etl", "data", "clean"],
}
TASK_INDICATORS = {
    "video": ["resolution", "bitrate", "frame_count", "duration"],
    "ml": ["batch_size", "data_size", "model_size", "layers"],
    "database": ["record_count", "table_size", "join_complexity", "index_count"],
    "financial": ["portfolio_size", "simulation_count", "time_horizon", "instruments"],
    "image": ["image_count", "resolution", "operation_count", "channels"],
    "data_processing": ["file_size", "record_count", "transformation_complexity", "columns"],
}
TASK_HIERARCHIES = {
    "video_rendering": ["video", "rendering"],
    "video_encoding": ["video", "compression"],
    "ml_inference": ["ml", "ai"],
    "ml_training": ["ml", "ai"],
    "image_processing": ["image", "vision"],
    "data_analytics": ["data_processing", "analytics"],
    "financial_modeling": ["financial", "mathematics"],
}
SIMILARITY_THRESHOLD = 0.8
MAX_CONFIDENCE = 0.95
INDICATOR_BONUS = 0.1
HIERARCHY_BONUS = 0.2
GENERIC_WEIGHT = 2.0

# Strategy routing: task type -> strategy.
STRATEGY_ROUTES = {"video": "video", "ml": "ml", "financial": "financial", "image": "video",
                   "database": "financial"}
RESOLUTION_MULTIPLIERS = {"720p": 1.0, "1080p": 1.5, "4k": 3.0, "8k": 8.0}
MODEL_MULTIPLIERS = {"lightweight": 0.5, "standard": 1.0, "heavy": 2.0, "transformer": 3.0}
CALCULATION_MULTIPLIERS = {"simple": 0.8, "risk_assessment": 1.0, "monte_carlo": 2.5, "var_calculation": 3.0}
# Parameter defaults per strategy.
VIDEO_DEFAULTS = {"frame_count": 100, "keyframe_interval": 10, "resolution": "1080p", "available_gpus": 4}
ML_DEFAULTS = {"batch_size": 32, "data_size": 1000, "model_type": "standard", "available_gpus": 2}
FINANCIAL_DEFAULTS = {"portfolio_size": 100, "calculation_type": "risk_assessment", "available_cpus": 8}
MIN_CHUNK_SIZE = 10
MAX_CHUNKS = 16
LOAD_BALANCING_FACTOR = 0.8

# Task categories and queue mapping.
CATEGORY_SPEEDUP = {"gpu_tasks": 8.0, "cpu_tasks": 4.0, "io_tasks": 1.5}
QUEUE_MAPPING = {"gpu_tasks": "gpu_queue", "cpu_tasks": "cpu_queue", "io_tasks": "io_queue"}
DEFAULT_QUEUE = "cpu_queue"
ESTIMATE_FACTOR = 0.1

# Queue settings: queue -> (max_depth, max_batch_size, flow_control_threshold,
# flow_control_rate, priority_levels, batching_window_ms, allocation_strategy).
QUEUE_CONFIG = [
    ("gpu_queue", 2000, 100, 0.8, 20, 5, 100, "priority_aware"),
    ("cpu_queue", 5000, 200, 0.85, 50, 3, 50, "load_balanced"),
    ("io_queue", 1000, 50, 0.7, 10, 3, 200, "batch_optimized"),
]
FLOW_RELEASE_FRACTION = 0.5
BATCH_HALVE_FRACTION = 0.7
SIMILARITY_BATCH_SIZE = 10
FIXED_BATCH_SIZE = 50
HISTORY_LIMIT = 1000

# Task complexity rules.
VIDEO_RESOLUTION_FACTORS = {"720p": 1, "1080p": 2.25, "4k": 16}

# Priority keywords, checked high, low, medium; default medium.
PRIORITY_RULES = [
    ("HIGH", ["urgent", "critical", "emergency", "real-time", "live", "immediate"]),
    ("LOW", ["batch", "background", "offline", "non-urgent", "scheduled", "deferred"]),
    ("MEDIUM", ["standard", "normal", "regular", "default"]),
]
DEFAULT_PRIORITY = "MEDIUM"

# Memoisation.
CACHE_TTL_SECONDS = 3600

# Alerts and health thresholds.
ALERT_UTILIZATION_CRITICAL = 0.95
ALERT_UTILIZATION_WARNING = 0.80
ALERT_THROUGHPUT_MIN = 100

# Typed dispatch: data_type -> model.
DISPATCH_MAP = [
    ("ohlcv", "chart_pattern_model"),
    ("news", "sentiment_model"),
    ("social", "sentiment_model"),
    ("onchain", "onchain_model"),
    ("natural_language", "text_summarization"),
]

# Prompt templates per task.
PROMPT_TEMPLATES = {
    "decomposition": ("Decompose the following operation into a sequence of network steps, providing the "
                      "expected time and resource for each step, and output the result as a JSON array:\n"
                      "Operation: {text}\nJSON:"),
    "summarization": "Summarize the following text:\nText: {text}\nSummary:",
}
PROMPT_PREFIX = "Decompose "
END_TOKEN = "<|endoftext|>"

# Text normalisation and vocabulary.
# special tokens, in the order of their ids
SPECIAL_TOKENS = [
    "<pad>", "<unk>", "<s>", "</s>", "<CODE>", "</CODE>", "<LOG>", "</LOG>", "<PACKET>", "</PACKET>",
    "<ERROR>", "</ERROR>", "<CONNECT>", "<BIND>", "<LISTEN>", "<ACCEPT>", "<HANDSHAKE>", "<NEGOTIATE>",
    "<SYN>", "<ACK>", "<FIN>", "<SEND>", "<RECV>", "<TRANSMIT>", "<RECEIVE>", "<REQUEST>", "<RESPONSE>",
    "<GET>", "<POST>", "<PUT>", "<DELETE>", "<POLL>", "<PING>", "<CLOSE>", "<TIMEOUT>", "<SUCCESS>",
    "<FAILURE>", "<PENDING>", "<RETRY>", "<DEADLINE_EXCEEDED>", "<OK>", "<CONNECTION_REFUSED>",
    "<PROTOCOL_ERROR>", "<UNAUTHORIZED>", "<FORBIDDEN>", "<NOT_FOUND>", "<SERVER_ERROR>", "<HTTP/1.1>",
    "<HTTP/2>", "<TCP>", "<UDP>", "<ICMP>", "<ARP>", "<QUIC>", "<WEBSOCKET>", "<gRPC>", "<MQTT>", "<COAP>",
    "<FTP>", "<SSH>", "<BGP>", "<OSPF>", "<DNS>", "<DHCP>", "<TLS>", "<SSL>", "<IPsec>", "<RTP>", "<SIP>",
    "<JSON>", "<XML>", "<YAML>", "<PROTOBUF>", "<AVRO>", "<CBOR>", "<GZIP>", "<ZLIB>", "<SERVER>", "<CLIENT>",
    "<PORT>", "<ADDRESS>", "<IP>", "<MAC>", "<HOSTNAME>", "<ROUTER>", "<SWITCH>", "<GATEWAY>", "<FIREWALL>",
    "<LOAD_BALANCER>", "<VPN>", "<DNS_SERVER>", "<NAT_DEVICE>", "<PAYLOAD>", "<HEADER>", "<PACKET_HEADER>",
    "<PACKET_BODY>", "<SOURCE_IP>", "<DESTINATION_IP>", "<SOURCE_PORT>", "<DESTINATION_PORT>",
    "<PROTOCOL_TYPE>", "<PACKET_SIZE>", "<PAYLOAD_LENGTH>", "<TIMESTAMP>", "<LEVEL>", "<MESSAGE>",
    "<TRACE_ID>", "<SESSION_ID>", "<EVENT_ID>", "<SYSLOG>", "<JSON_LOG>",
]
MIN_FREQUENCY = 2
ALPHABET_LIMIT = 1000
VOCAB_SIZE = 8192
MAX_SEQ_LEN = 512
PAD_ID = 0

# ---------------------------------------------------------------------------
# FIXTURE LEXICONS (our own rules for the driver tables)
# ---------------------------------------------------------------------------

# Stop-word rules per language for `documents`.
FIXTURE_CATEGORY_PATTERNS = [
    ("english_prose", r"\b(the|of|and)\b"),
    ("german_prose", r"\b(der|die|und)\b"),
    ("french_prose", r"\b(le|les|et)\b"),
    ("spanish_prose", r"\b(el|los|que)\b"),
]
FIXTURE_DEFAULT_CATEGORY = "unclassified"
FIXTURE_FIRST_MATCH_RULES = [
    ("english_prose", [" the ", " and "]),
    ("german_prose", [" der ", " und "]),
    ("french_prose", [" les ", " et "]),
    ("spanish_prose", [" los ", " que "]),
]
FIXTURE_CONTEXT_RULES = [
    ("path", ["src1/"], "source_one"),
    ("repo", ["src2"], "source_two"),
]
# Step templates for two fixture categories; the others take the generic steps.
FIXTURE_STEP_TEMPLATES = {
    "english_prose": [
        ("Receive the source text", "I/O", "medium", 100, 2000, 500, False, []),
        ("Parse sentences and tokens", "CPU", "medium", 50, 500, 200, True, [0]),
        ("Validate extracted fields", "CPU", "high", 20, 200, 80, False, [0, 1]),
    ],
    "german_prose": [
        ("Connect to the document store", "I/O", "high", 500, 5000, 1500, False, []),
        ("Normalise the text", "CPU", "low", 50, 400, 120, True, []),
        ("Compute statistics", "GPU", "medium", 100, 1000, 300, True, [0, 1]),
        ("Send results to disk", "I/O", "medium", 200, 4000, 900, False, [2]),
    ],
}
# Code lines put in front of documents, which hold none, so that symbol rules have something to find.
FIXTURE_CODE = [
    "import os\nfrom collections import abc\ndef load(path):\n    return open(path)",
    "class Reader(Base):\n    def read(self, n):\n        pass\n    def close(self):\n        pass",
    "import socket.tools\nclass Writer:\n    def write(self):\n        pass\nfunction send(x) {}",
    "def load(x):\n    def inner(y):\n        return y\n    return inner",
    "no symbols here",
]
# Task descriptions by key, one for each priority rule and one without a keyword.
FIXTURE_TASK_NOTES = [
    "URGENT render of the trailer", "nightly background export", "standard monthly report", "clean the list",
    "emergency fix, then batch import", "live broadcast", "deferred archive job",
]
FIXTURE_HIERARCHIES = {"video": ["small", "promo"], "ml": ["economy"], "financial": ["standard"], "image": ["large"]}
FIXTURE_TAG_RULES = [
    (r"(the |der |le |el )", "<ART>"),
    (r"(\. )", "<EOS>"),
]
FIXTURE_TEXT_ROUTES = [
    ("has_the", ["the"]),
    ("has_und", ["und", "der"]),
    ("has_que", ["que"]),
]


def rules_frame(spark, rows, schema):
    """A small DataFrame from a rules list (broadcast-size by construction)."""
    return spark.createDataFrame(rows, schema)
