"""Log files that grow between the triggers of a stream."""

import random
import re

import pytest

from sluicework import sources as so
from sluicework.sources import tail

START = "2024-"


def expected(text):
    records, begun = [], False
    for line in text.removesuffix("\n").split("\n"):
        begun = begun or line.startswith(START)
        if line.startswith(START) or not begun:
            records.append([])
        records[-1].append(line)
    return ["\n".join(r) for r in records]


def drawn(seed, n):
    draw = random.Random(seed)
    lines = ["# head", "# ü"] if seed % 2 else []
    for i in range(n):
        lines.append(f"{START}01-01 record {i} é")
        lines += [f"  line {j} " + "x" * draw.choice([0, 3, 40]) for j in range(draw.choice([0, 0, 1, 5]))]
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
@pytest.mark.parametrize("seed", range(4))
def test_any_cuts_give_each_record_once(tmp_path, monkeypatch, block, seed):
    """Whatever was there at each trigger, and however the bytes were dealt out."""
    monkeypatch.setattr(tail, "BLOCK_BYTES", block)
    text = drawn(seed, 30)
    data = text.encode()
    path = tmp_path / "a.log"
    draw = random.Random(seed)
    sizes = sorted(draw.sample(range(len(data)), 5)) + [len(data)]
    reader = tail.TailReader({"path": str(tmp_path / "*.log"), "recordstart": START, "chunkbytes": str(draw.choice([11, 100, 1000])), "idleseconds": "100"})
    offset, found = reader.initialOffset(), []
    for size in [*sizes, None]:
        if size is None:
            reader.idle = 0.0  # closed now
        else:
            path.write_bytes(data[:size])
        after = reader.latestOffset()
        for chunk in reader.partitions(offset, after):
            for batch in reader.read(chunk):
                found += batch.column("RawData").to_pylist()
        offset = after
    assert found == expected(text)
    assert list(reader.partitions(offset, reader.latestOffset())) == []


def test_long_records_end(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "RECORD_BYTES", 50)
    lines = [f"{START} a", *[f"more {i:04d}" for i in range(10)], f"{START} b"]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    reader = tail.TailReader({"path": str(tmp_path), "recordstart": START, "idleseconds": "0", "chunkbytes": "13"})
    found = [r for c in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(c) for r in b.column(0).to_pylist()]
    near = [x for k, x in enumerate(lines[1:11]) if 7 + 10 * k <= 50]
    assert found == ["\n".join([lines[0], *near]), *lines[1 + len(near):11], lines[11]]


def test_shorter_gone_and_reopened_files(tmp_path):
    path = tmp_path / "a.log"
    path.write_text(f"{START} one\n{START} two\n")
    reader = tail.TailReader({"path": str(path), "recordstart": START, "idleseconds": "0"})

    def more(offset):
        after = reader.latestOffset()
        return after, [r for c in reader.partitions(offset, after) for b in reader.read(c) for r in b.column(0).to_pylist()]

    offset, found = more(reader.initialOffset())
    assert found == [f"{START} one", f"{START} two"]
    path.write_text(path.read_text() + "added\n" + f"{START} three\n")
    offset, found = more(offset)
    assert found == ["added", f"{START} three"]
    path.write_text(f"{START} new\n")
    offset, found = more(offset)
    assert found == [f"{START} new"]
    path.unlink()
    assert more(offset) == ({"files": {}}, [])
    with pytest.raises(ValueError):
        tail.TailReader({})


def test_stream_over_growing_files(spark, tmp_path):
    """Two files, a restart from the checkpoint between triggers, and a late third file."""
    texts = {f"{k}.log": drawn(k, 200) for k in range(3)}
    (tmp_path / "in").mkdir()

    def run(part, idle):
        for k, (name, text) in enumerate(texts.items()):
            if k < 2 or part == 1:
                data = text.encode()
                (tmp_path / "in" / name).write_bytes(data[:int(len(data) * part)])
        stream = so.text_log_tail(spark, str(tmp_path / "in"), START, idle)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start(
            str(tmp_path / "out"), format="parquet").awaitTermination()

    for part, idle in ((0.3, 1000), (0.35, 1000), (0.8, 1000), (1, 1000), (1, 0)):
        run(part, idle)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    for name, text in texts.items():
        own = [r.RawData for r in rows if re.search(rf"^file:.*/{name}$", r.FilePath)]
        assert sorted(own) == sorted(expected(text))
