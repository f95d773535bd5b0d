import os

from loomtext.sources.tail import TailReader, TailSource, whole_lines


def test_whole_lines(tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"one\ntwo\nthr")
    assert whole_lines(str(path), 0, 100) == 8 and whole_lines(str(path), 8, 100) == 8 and whole_lines(str(path), 0, 5) == 4
    assert whole_lines(str(path), 0, 3) == 3  # a line longer than a batch is cut
    path.write_bytes(b"x" * 200_000 + b"\n" + b"y" * 100)
    assert whole_lines(str(path), 0, 1 << 20) == 200_001


def read(reader, start):
    end = reader.latestOffset()
    return end, [row for part in reader.partitions(start, end) for row in reader.read(part)]


def test_a_reader_goes_on_from_its_offset_across_restarts(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("one\ntwo\npart")
    reader = TailReader(str(tmp_path / "*.log*"), 1 << 20)
    at, rows = read(reader, {})
    assert [r[2] for r in rows] == ["one", "two"]
    os.rename(path, tmp_path / "a.log.1")
    with open(tmp_path / "a.log.1", "a") as f:
        f.write("ial\n")
    path.write_text("new\r\n")
    at2, rows = read(reader, at)
    assert sorted(r[2] for r in rows) == ["new", "partial"]
    again = TailReader(str(tmp_path / "*.log*"), 1 << 20)  # planned batches are replayed as they were
    assert sorted(r[2] for p in again.partitions(at, at2) for r in again.read(p)) == ["new", "partial"]
    assert read(reader, at2)[1] == []


def test_a_restarted_reader_reads_no_line_again(tmp_path):
    path = tmp_path / "a.log"
    path.write_text("".join(f"line {i}\n" for i in range(500)))
    first = TailReader(str(path), 64)
    at, rows = read(first, {})
    assert [r[2] for r in rows] == [f"line {i}" for i in range(500)] and len(first.partitions({}, at)) > 50
    with open(path, "a") as f:
        f.write("".join(f"line {i}\n" for i in range(500, 520)))
    again = TailReader(str(path), 64)
    at, rows = read(again, at)
    assert [r[2] for r in rows] == [f"line {i}" for i in range(500, 520)]
    path.write_text("anew\n")
    assert [r[2] for r in read(again, at)[1]] == ["anew"]


def test_appended_lines_arrive_once_across_rotation(spark, tmp_path):
    spark.dataSource.register(TailSource)
    log, wanted = tmp_path / "app.log", []

    def write(text):
        with open(log, "a") as f:
            f.write(text)

    write("a1\na2\n")
    stream = spark.readStream.format("tail").option("path", str(tmp_path / "app.log*")).option("bytes", 64).load()

    def run(steps):
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
        try:
            for step in steps:
                step()
                q.processAllAvailable()
        finally:
            q.stop()

    run([lambda: None, lambda: write("a3\nunfin"), lambda: write("ished\n"), lambda: (os.rename(log, tmp_path / "app.log.1"), write("b1\n")), lambda: write("é " + "x" * 30 + "\n")])
    run([lambda: write("b3\n")])
    wanted = ["a1", "a2", "a3", "unfinished", "b1", "é " + "x" * 30, "b3"]
    assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(wanted)
