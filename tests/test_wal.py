"""Log bytes: round trips, damage, limits, gaps and replay."""

import random

import pytest

from tidelog.functions import bytesx
from tidelog.sources import wal


def series(n):
    return [(f"k{i:03d}".encode(), None if i % 5 == 0 else f"v{i}".encode(), i % 5 == 0, i + 1) for i in range(n)]


def rows(data, **kw):
    return list(wal.decode_segment(data, **kw))


def test_round_trip():
    want = series(200)
    blocks = [wal.encode_block([wal.encode_record(*r) for r in want[i : i + 7]]) for i in range(0, 200, 7)]
    got = rows(wal.encode_segment(3, blocks))
    assert [(k, v, d, s) for _, _, k, v, d, s, p in got if p is None] == want
    assert all(r[0] == 3 and r[6] is None for r in got)


def test_damaged_block_is_skipped_or_ends_the_file():
    blocks = [wal.encode_block([wal.encode_record(*r)]) for r in series(5)]
    bad = bytearray(blocks[2])
    bad[-1] ^= 1
    data = wal.encode_segment(1, [*blocks[:2], bytes(bad), *blocks[3:]])
    assert [r[5] for r in rows(data) if r[6] is None] == [1, 2, 4, 5]
    assert [r[6] for r in rows(data, resync=False)] == [None, None, "bad_block_checksum"]


def test_torn_tail_and_header():
    data = wal.encode_segment(1, [wal.encode_block([wal.encode_record(*r)]) for r in series(3)])
    got = rows(data[:-3])
    assert [r[5] for r in got if r[6] is None] == [1, 2] and got[-1][6] == "short_block"
    assert rows(b"x" + data)[0][6] == "bad_segment_header" and rows(b"")[0][6] == "short_segment_header"


def test_length_beyond_the_block_is_damage():
    data = wal.encode_segment(1, [wal.encode_block([wal.encode_record(b"k", b"v" * 200, False, 1)])], block=100)
    assert rows(data)[0][6] == "block_too_long"


@pytest.mark.parametrize(("args", "code"), [((b"", b"v", False, 1), "empty_key"), ((b"k", b"", False, 1), "empty_value"), ((b"k", b"v" * 99999, False, 1), "record_too_large")])
def test_limits(args, code):
    with pytest.raises(wal.WalError, match=code):
        wal.encode_record(*args)
    assert wal.encode_record(b"k", None, True, 1)


def test_random_damage_never_invents_rows():
    rng, want = random.Random(1), series(40)
    data = wal.encode_segment(1, [wal.encode_block([wal.encode_record(*r) for r in want[i : i + 4]]) for i in range(0, 40, 4)])
    for _ in range(200):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        assert {r[2:6] for r in rows(bytes(bad)) if r[6] is None} <= set(want)


def test_reading_files(spark, tmp_path):
    for i in (1, 2, 4):
        wal.write_segment(tmp_path, i, [wal.encode_record(f"k{i}".encode(), b"v", False, 10 * i + j) for j in range(3)])
    df = wal.read_wal(spark, str(tmp_path))
    assert df.count() == 9
    assert [(r["seq"], r["batch"]) for r in wal.replay(df, 12, 4).orderBy("seq").collect()] == [(20, 0), (21, 0), (22, 0), (40, 0), (41, 1), (42, 1)]
    assert [r["id"] for r in wal.gaps(df.selectExpr("segment AS id").distinct()).collect()] == [4]


def test_checks_and_hashes():
    assert bytesx.crc32c(b"123456789") == 0xE3069283
    assert int(bytesx.fnv1a(["a"])[0]) == 0xAF63DC4C8601EC8C and int(bytesx.fnv1a([""])[0]) == 0xCBF29CE484222325
    assert [bytesx.next_power_of_two(n) for n in (0, 1, 2, 3, 16, 17)] == [1, 1, 2, 4, 16, 32]
    assert bytesx.common_prefix(b"abc", b"abd") == 2


def test_writer_rotates_repairs_and_its_log_fills_a_store(spark, tmp_path):
    from tidelog.sources.store import Store

    folder = str(tmp_path / "wal")
    w = wal.WalWriter(folder, segment_bytes=300, group=3)
    want = {}
    for i in range(40):
        key, dead = bytes([i % 7, 255]), i % 5 == 4
        w.append(key, None if dead else bytes([i]), dead, i + 1)
        want[key] = None if dead else bytes([i])
    w.close()
    have = wal.numbers(folder)
    assert len(have) > 2 and wal.check_segments(folder) == have
    last = tmp_path / "wal" / f"{have[-1]:06d}.wal"
    whole = last.read_bytes()
    last.write_bytes(whole + b"LSMBtorn")
    again = wal.WalWriter(folder, segment_bytes=300, group=3)
    assert last.read_bytes() == whole
    again.append(b"new", b"v", False, 41)
    again.close()
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.replay(wal.mutations(wal.read_wal(spark, folder)))
    got = {bytes(r["key"]): bytes(r["value"]) for r in store.scan().collect()}
    assert got == {k: v for k, v in want.items() if v is not None} | {b"new": b"v"} and store.manifest["wal_seq"] == 41
    (tmp_path / "wal" / "000002.wal").unlink()
    with pytest.raises(wal.Missing):
        wal.check_segments(folder)
    assert wal.check_segments(folder, "stop") == [1]
