"""Numbering, peers, throttling and settings."""

import json

import pytest

from tidelog import config
from tidelog.operators import sequencing


def test_indexes_are_shared_and_go_on():
    s = sequencing.sequencer()
    assert [s.commit(k).index for k in ("data", "control", "data")] == [1, 2, 3]
    s.observe(10)
    s.observe(4)
    assert s.commit("data").index == 11 and s.status()["index"] == 11
    with pytest.raises(ValueError):
        s.commit("other")
    with pytest.raises(ValueError):
        sequencing.sequencer("raft")


def test_peers():
    ids = sequencing.peer_ids("a", ["a", " b", "a", ""])
    assert list(ids) == ["a", "b"] and len(set(ids.values())) == 2
    with pytest.raises(ValueError):
        sequencing.peer_ids("c", ["a", "b"])


def test_waiting():
    assert sequencing.must_wait(0, 1, 100, 0, 4, blocked=True)
    assert sequencing.must_wait(90, 10, 100, 4, 4) and not sequencing.must_wait(90, 10, 100, 3, 4) and not sequencing.must_wait(89, 10, 100, 4, 4)
    assert [sequencing.memtable_kind(k) for k in ("", "map", "skiplist")] == ["sharded", "map", "skiplist"]
    with pytest.raises(ValueError):
        sequencing.memtable_kind("tree")


def test_settings(tmp_path):
    p = tmp_path / "node.json"
    p.write_text(json.dumps({"node": "node-a", "port": 8080, "shards": [{"id": "1", "start": "a", "end": "m", "leader": "node-a"}, {"id": "2", "start": "m", "leader": "node-b"}]}))
    c = config.load(str(p)).control()
    assert [c.admit(k) for k in ("b", "x", "0")] == [None, "not_leader", "shard_not_found"]
    p.write_text('{"nodes": 1}')
    with pytest.raises(ValueError):
        config.load(str(p))
    p.write_text('{"memtable": "tree"}')
    with pytest.raises(ValueError):
        config.load(str(p))
