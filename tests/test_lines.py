"""Lines of files by their places: splits, ends, and what is read of them."""

from __future__ import annotations

import io
import json
import random

from pyspark.sql import functions as F

from threadmill.sources import lines, logs
from tests.test_store import claude


class File(io.BytesIO):
    """With read_at, counting bytes."""

    read_bytes = 0

    def read_at(self, n, at):
        self.seek(at)
        data = self.read(n)
        self.read_bytes += len(data)
        return data


def whole(data):
    out, at = [], 0
    for line in data.split(b"\n"):
        if line.strip():
            out.append((at, line))
        at += len(line) + 1
    return out


def test_splits_and_ends_of_any_file():
    rng = random.Random(4)
    for _ in range(300):
        data = b"\n".join(rng.choice([b"", b" ", b"a", b"xyz" * rng.randint(1, 30), "é€😀".encode()]) for _ in range(rng.randint(0, 25))) + rng.choice([b"", b"\n"])
        want, step, block = whole(data), rng.randint(1, 40), rng.randint(1, 20)
        got = [x for first in range(0, len(data), step) for x in lines.lines_between(File(data), first, min(len(data), first + step), len(data), block)]
        assert got == want
        for n in (0, 1, 3, 100):
            assert lines.last_lines(File(data), len(data), n, block)[0] == (want[-n:] if n else [])


def test_an_end_is_read_without_the_rest():
    data = b"".join(b"line %d %s\n" % (k, b"x" * 80) for k in range(200_000))
    file = File(data)
    got, n = lines.last_lines(file, len(data), 20)
    assert [x for _, x in got] == data.split(b"\n")[-21:-1] and file.read_bytes == n <= 4 * lines.BLOCK_BYTES


def test_source(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for k in range(3):
        (tmp_path / f"deep/{k}.jsonl").write_text(claude(session=f"s{k}") + "\n\n")
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "other.txt").write_text("no")
    rows = lines.read(spark, str(tmp_path), "*.jsonl", split_bytes=150)
    texts = {str(p): p.read_bytes() for p in tmp_path.rglob("*.jsonl")}
    assert sorted((r["path"], r["seq"], r["line"].encode()) for r in rows.collect()) == sorted((p, at, x) for p, t in texts.items() for at, x in whole(t))
    assert rows.rdd.getNumPartitions() > 3
    ends = lines.read(spark, str(tmp_path), "*.jsonl", last=2)
    assert sorted((r["path"], r["seq"], r["line"].encode()) for r in ends.collect()) == sorted((p, at, x) for p, t in texts.items() for at, x in whole(t)[-2:])
    assert lines.read(spark, str(tmp_path), "*.none").count() == 0
    # The readers of whole files say the same of lines from splits, but for the lines' numbers.
    by_file = logs.claude_code(logs.files(spark, str(tmp_path / "deep"), "*.jsonl"))
    by_split = logs.claude_code(rows)
    plain = lambda x: sorted(str(r.asDict() | {"path": r["path"].removeprefix("file:"), "seq": 0}) for r in x.collect())
    assert plain(by_file.records) == plain(by_split.records) and plain(by_file.sessions) == plain(by_split.sessions)


def test_exchanges_across_splits(spark, tmp_path):
    kinds = [random.Random(7).choice("pra") for _ in range(400)]
    (tmp_path / "a.log").write_text("\n".join(json.dumps({"k": c, "n": n}) for n, c in enumerate(kinds)))
    rows = lines.read(spark, str(tmp_path), "*.log", split_bytes=300)
    got = {r["n"]: r["exchange"] for r in lines.fold_splits(rows, F.get_json_object("line", "$.k") == "p").select(F.get_json_object("line", "$.n").cast("int").alias("n"), "exchange").collect()}
    want, seen = {}, 0
    for n, c in enumerate(kinds):
        seen += c == "p"
        want[n] = seen
    assert got == want and rows.select("split").distinct().count() > 10
