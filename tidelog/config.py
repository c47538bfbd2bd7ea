"""A node's settings from a file: YAML where a parser is installed, JSON always."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from tidelog import defaults
from tidelog.operators.control import ControlPlane, Shard
from tidelog.operators.sequencing import memtable_kind

try:
    import yaml
except ImportError:
    yaml = None


@dataclass
class NodeConfig:
    node: str = defaults.NODE
    cluster: str = defaults.CLUSTER
    address: str = "127.0.0.1"
    port: int = 0
    data: str = ""
    memtable: str = ""
    l0_threshold: int = 0
    consistency: str = "accepted"
    write_requests: int = defaults.WRITE_REQUESTS
    table_bytes: int = 0
    control_state: str = ""
    event_socket: str = ""
    event_webhook: str = ""
    log: str = ""
    trash_files: int = defaults.TRASH_FILES
    trash_bytes: int = defaults.TRASH_BYTES
    shards: list[Shard] = field(default_factory=list)

    def control(self, path: str | None = None) -> ControlPlane:
        return ControlPlane(path, self.node, self.shards or None, self.cluster)


def load(path: str) -> NodeConfig:
    """Unknown settings are errors. Shards have id, start, end, leader and replicas."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        if yaml is None:
            raise ValueError("no YAML parser is installed; write the settings as JSON")
        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    shards = [Shard(**s) for s in raw.pop("shards", [])]
    try:
        out = NodeConfig(**raw, shards=shards)
    except TypeError as e:
        raise ValueError(str(e)) from None
    memtable_kind(out.memtable)
    return out
