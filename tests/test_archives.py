"""Packed files read as streams, an entry a task."""

import gzip
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from timberline.sources import archives, ingest


def packed(entries, level=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data, level)
    return out.getvalue()


def texts_of(rows):
    found = {}
    for r in rows:
        found.setdefault((r.file.rsplit("/", 1)[1], r.entry), []).append((r.position, r.value, r.error))
    return {k: sorted(v, key=lambda x: x[0] or 0) for k, v in found.items()}


def lines(*values):
    return [(k, v, None) for k, v in enumerate(values, 1)]


def test_entries_of_all_kinds(spark, tmp_path):
    broken = bytearray(packed({"a.log": b"good lines\n" * 9}, zipfile.ZIP_STORED))
    broken[60] ^= 1  # the checksum finds it
    files = {
        "two.zip": packed({"b.log": b"one\r\ntwo\rthree\n\n", "a.txt": "é\n€".encode("utf-16"), "skip.bin": b"\x00", "empty.log": b""}),
        "old.zip": packed({"c.log": "caf\xe9 d\xe9j\xe0 vu, \xe0 la carte, tr\xe8s bien".encode("cp1252")}),
        "g.log.gz": gzip.compress(b"zipped\nlines"), "plain.log": b"\xef\xbb\xbfmarked\n", "bad.gz": b"\x1f\x8bnope", "cut.zip": packed({"a.log": b"x" * 99})[:60],
        "crc.zip": bytes(broken), "nest.zip": packed({"in.log": gzip.compress(b"x")}), "name.zip": packed({"in.gz": b"x"}), "up.zip": packed({"../a.log": b"x"}),
        "bomb.gz": gzip.compress(b"x" * 90000), "big.zip": packed({"a.log": random.Random(1).randbytes(400_000).hex().encode(), "b.log": b"small"}), "none.zip": packed({}),
        "elf.zip": packed({"a.log": b"\x7fELF\x00\x01" * 50}),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = texts_of(archives.archive_lines(spark, str(tmp_path), ingest.IngestOptions(max_unpacked=500_000)).collect())
    assert got == {
        ("two.zip", "b.log"): lines("one", "two", "three", ""), ("two.zip", "a.txt"): lines("é", "€"), ("old.zip", "c.log"): lines("café déjà vu, à la carte, très bien"),
        ("two.zip", "empty.log"): [(None, None, "EMPTY_CONTENT")], ("g.log.gz", None): lines("zipped", "lines"), ("plain.log", None): lines("marked"), ("big.zip", "b.log"): lines("small"),
        **{k: [(None, None, e)] for k, e in {
            ("bad.gz", None): "ARCHIVE_MALFORMED", ("cut.zip", None): "ARCHIVE_MALFORMED", ("crc.zip", "a.log"): "ARCHIVE_MALFORMED", ("nest.zip", "in.log"): "ARCHIVE_NESTED", ("name.zip", "in.gz"): "ARCHIVE_NESTED",
            ("up.zip", None): "ARCHIVE_UNSAFE_NAME", ("bomb.gz", None): "ARCHIVE_RATIO", ("big.zip", "a.log"): "ARCHIVE_TOO_LARGE", ("none.zip", None): "ARCHIVE_EMPTY", ("elf.zip", "a.log"): "BINARY_CONTENT",
        }.items()},
    }
    one = archives.archive_entries(spark, f"{tmp_path}/two.zip", every=False).collect()
    assert [(r.entry, r.auto) for r in one] == [("a.txt", True)]


def test_entries_of_one_archive_are_read_by_tasks_of_their_own(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(packed({f"{k}.log": f"line {k}\n".encode() * 3 for k in range(12)}))
    rows = archives.archive_lines(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    tasks = {(r.entry, r.task) for r in rows.select("entry", "task").distinct().collect()}
    assert len({e for e, _ in tasks}) == len({t for _, t in tasks}) == len(tasks) == 12


def test_long_lines_are_not_held(spark, tmp_path):
    long = random.Random(3).randbytes(3_000_000).hex()
    (tmp_path / "a.zip").write_bytes(packed({"a.log": f"short\n{long}\nend".encode()}))
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(f"{long}\nend".encode()))
    got = {(r.entry, r.position): r for r in archives.archive_lines(spark, str(tmp_path), limit=1000).collect()}
    assert [got[k].value for k in (("a.log", 1), ("a.log", 2), ("a.log", 3), (None, 2))] == ["short", None, "end", "end"]
    assert (got["a.log", 2].characters, got["a.log", 2].oversized, got["a.log", 2].preview) == (6_000_000, True, long[:200])
    assert (got[None, 1].characters, got[None, 1].value) == (6_000_000, None)


def test_streams_equal_whole_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    files = {}
    for k in range(30):
        text = "".join(rng.choice(["a", "é", "中", "\n", "\r\n", "\r", " ", "word"]) for _ in range(rng.choice([0, 1, 40, 400])))
        encoding = rng.choice(["utf-8", "utf-8-sig", "utf-16"])
        files[f"e{k}.log"] = text.encode(encoding)
    for size in (1, 3, 1 << 16):
        monkeypatch.setattr("timberline.sources.lines.CHUNK", size)
        for name, data in files.items():
            path = tmp_path / f"{name}.gz"
            path.write_bytes(gzip.compress(data))
            entry = (str(path), "gzip", None)
            encoding, error = archives.checked(entry, len(data), ingest.IngestOptions(allow_empty=True))
            assert error is None
            text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")
            want = text.removesuffix("\n").split("\n") if text else []
            assert [r[1] for r in archives.entry_lines(entry, encoding, "strict", 1 << 20)] == want


def test_storage_that_fails_is_no_broken_archive(tmp_path):
    with pytest.raises(archives.StorageError):
        archives.checked((str(tmp_path / "gone.gz"), "gzip", None), 1, ingest.IngestOptions())
