"""A message log as a stream: offsets, restarts, lines over piece borders."""

import json

from pyspark.sql import functions as F

from tests.conftest import tuples
from trivane.sources import messages
from trivane.streaming import live


def line(topic, at, value):
    return json.dumps({"topic": topic, "at": at, "value": value}) + "\n"


def test_pieces_hold_each_line_once(tmp_path, monkeypatch):
    """Whatever the borders, lines are read by the piece they begin in; an unfinished line waits."""
    rows = [("t", k, "v" * (k % 9)) for k in range(60)]
    (tmp_path / "a.jsonl").write_text("".join(line(*r) for r in rows) + "\r\nno message\n" + line("open", 1, "x").rstrip("\n"))
    for size in (1, 7, 50, 1 << 20):
        monkeypatch.setattr(messages, "PIECE_BYTES", size)
        monkeypatch.setattr(messages, "TAIL_BYTES", 16)
        cut = messages.pieces({}, messages.complete(str(tmp_path)))
        got = [m for piece in cut for m in messages.read_piece(str(tmp_path), piece)]
        assert [m[:3] for m in got] == [*rows, (None, None, None)] and got[-1][3] == "no message"


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, state = tmp_path / "log", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.jsonl").write_text(line("s1", 5, "20") + line("s2", 6, "warm") + '{"topic": "s3", "at"')
    seen = []

    def run():
        stream = messages.readings(messages.stream_messages(spark, str(folder)))
        query = live.start(stream, lambda df, n: seen.extend(tuple(r) for r in df.collect()), checkpoint=state)
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    assert sorted(seen) == [("s1", "reading", "20", 20.0, 5), ("s2", "reading", "warm", None, 6)]
    seen.clear()
    # The unfinished line is finished, and another file appears.
    with open(folder / "a.jsonl", "a") as file:
        file.write(': 7, "value": 1}\n')
    (folder / "b.jsonl").write_text(line("s4", 8, "2"))
    run()
    assert sorted(seen) == [("s3", "reading", "1", 1.0, 7), ("s4", "reading", "2", 2.0, 8)]
    whole = messages.readings(messages.read_messages(spark, str(folder)))
    assert tuples(whole.select("s", "ts")) == [("s1", 5), ("s2", 6), ("s3", 7), ("s4", 8)]


def test_written_messages_are_read_back(spark, tmp_path):
    sent = spark.createDataFrame([("a", 1, 'x "y"'), ("b", 2, "5")], "topic string, at bigint, value string")
    messages.write_messages(sent, str(tmp_path / "log"))
    messages.write_messages(sent.withColumn("at", F.col("at") + 10), str(tmp_path / "log"))
    back = messages.read_messages(spark, str(tmp_path / "log"))
    assert tuples(back.select("topic", "at", "value")) == [("a", 1, 'x "y"'), ("a", 11, 'x "y"'), ("b", 12, "5"), ("b", 2, "5")]
