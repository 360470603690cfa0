"""The graph's closed vocabularies and table layouts."""

from __future__ import annotations

SCHEMA_VERSION = 6
#: The vocabularies that nodes and edges may use.
NODE_KINDS = ("Service", "Module", "Class", "Function", "Channel", "BusinessProcess")
CODE_KINDS = ("Module", "Class", "Function")
ROLES = ("RouteHandler", "MessageConsumer", "MessageProducer", "TemporalWorkflow", "TemporalActivity", "TemporalSignalHandler")
ENTRY_ROLES = ("RouteHandler", "MessageConsumer", "TemporalWorkflow", "TemporalSignalHandler")
EDGE_TYPES = (
    "CONTAINS", "IMPORTS", "CALLS", "HANDLES", "DEPENDS_ON", "PRODUCES", "CONSUMES", "INVOKES_ACTIVITY", "CALLS_HTTP", "NEXT_SEGMENT", "PART_OF_PROCESS",
)
RESOLUTIONS = ("static", "dynamic", "heuristic", "trace_validated")
CHANNEL_KINDS = ("kafka_topic", "event_type", "http_route", "temporal_signal")
HTTP_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
#: Steps stay inside a segment; exits leave it through a channel.
STEP_TYPES = ("CALLS", "DEPENDS_ON", "INVOKES_ACTIVITY")
EXIT_TYPES = ("PRODUCES", "CALLS_HTTP")

NODES = (
    "id string, kind string, service string, name string, qualified_name string, relpath string, start_byte bigint, end_byte bigint, "
    "start_line int, end_line int, content_hash string, roles array<string>, props map<string,string>"
)
EDGES = (
    "src string, dst string, type string, via_channel string, origin_service string, resolution string, confidence double, "
    "extractor string, evidence_file string, evidence_line int, props map<string,string>"
)
DEFS = "service string, relpath string, symbol string, start_byte bigint, end_byte bigint, start_line int"
REFS = DEFS + ", roles int"
CHUNKS = (
    "chunk_id string, symbol_id string, service string, relpath string, ord int, text string, start_line int, end_line int, content_hash string, "
    "context_header string, embedding array<float>, embed_model string, embedded_hash string, input_hash string"
)
EDGE_KEY = ("src", "dst", "type", "via_channel", "origin_service")
