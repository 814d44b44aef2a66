"""Facts as a stream: restarts, late and repeated facts, against a batch merge of all files."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import types as T

from corbel.streaming import facts as S
from corbel.streaming.facts import current, follow, ingest, kept

ROW = "id string, v int, w string, file string, n long, extra int"


def lines(rng, k):
    out = []
    for _ in range(k):
        i = rng.choice("abcdefghij")
        out.append({"id": i, "calls_in": [], "calls_in_x": [{"name": "n", "at": "x:1"}] if rng.random() < 0.5 else [], "calls_out": [f"y{rng.randint(0, 3)}"], "calls_out_x": [], "tests": {"t.py": ["one"]}})
    return out


def test_files_that_arrive_equal_one_batch_over_all(spark, tmp_path):
    rng, src, want = random.Random(1), tmp_path / "in", {}
    src.mkdir()
    for k in range(3):
        for f in (f"facts_{2 * k}.jsonl", f"facts_{2 * k + 1}.jsonl"):
            rows = lines(rng, 40)
            (src / f).write_text("".join(json.dumps(r) + "\n" for r in rows) + '{"id": "torn')
            want |= {r["id"]: r for r in rows}
        ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
        got = {r["id"]: r.asDict(recursive=True) for r in current(spark, str(tmp_path / "mark")).collect()}
        assert got == want


class Feed:
    def __init__(self, spark, tmp):
        self.spark, self.at = spark, str(tmp)

    def take(self, rows):
        self.spark.createDataFrame([(*r, 1) for r in rows], ROW).repartition(3).write.mode("append").parquet(f"{self.at}/in")
        self.run()

    def run(self):
        stream = self.spark.readStream.schema(ROW).parquet(f"{self.at}/in")
        follow(stream, "id", ["v", "w"], f"{self.at}/out", f"{self.at}/mark").awaitTermination()

    def kept(self):
        fields = T._parse_datatype_string("v int, w string")
        return {r["id"]: (r["v"], r["w"]) for r in kept(self.spark, f"{self.at}/mark", "id", fields).collect()}

    def changes(self):
        rows = self.spark.read.option("basePath", f"{self.at}/out").parquet(f"{self.at}/out/batch=*").collect()
        return sorted((r["batch"], r["id"], r["v"]) for r in rows)


def test_late_facts_are_dropped_and_only_changes_leave(spark, tmp_path):
    feed, before = Feed(spark, tmp_path), spark.conf.get(S.PROVIDER)
    feed.take([("a", 1, "x", "f", 1), ("a", 2, None, "f", 5), ("b", None, "y", "f", 2), (None, 1, "z", "f", 9), ("c", 7, "", None, None)])
    assert feed.kept() == {"a": (2, None), "b": (None, "y"), "c": (7, "")}
    feed.take([("a", 9, "late", "f", 4), ("b", None, "y", "g", 0), ("c", 8, "", None, None)])
    assert feed.kept() == {"a": (2, None), "b": (None, "y"), "c": (8, "")}
    feed.take([("b", 1, "late", "f", 99), ("d", 4, "w", "f", 1), ("d", 5, "w", "f", 1)])
    assert feed.kept() == {"a": (2, None), "b": (None, "y"), "c": (8, ""), "d": (5, "w")}
    assert feed.changes() == [(0, "a", 2), (0, "b", None), (0, "c", 7), (1, "c", 8), (2, "d", 5)]
    feed.run()  # nothing new
    assert feed.changes()[-1] == (2, "d", 5) and spark.conf.get(S.PROVIDER) == before


def test_a_batch_that_breaks_is_taken_again(spark, tmp_path, monkeypatch):
    rng, feed = random.Random(2), Feed(spark, tmp_path)
    rows = [(rng.choice("abcdef"), rng.randint(0, 9), "w", rng.choice("fg"), rng.randint(0, 50)) for _ in range(200)]
    feed.take(rows[:80])

    def broken(*a):
        raise RuntimeError("killed")

    writer = type(spark.range(0).write)
    save = writer.parquet
    spark.createDataFrame([(*r, 1) for r in rows[80:]], ROW).write.mode("append").parquet(f"{tmp_path}/in")
    monkeypatch.setattr(writer, "parquet", broken)
    with pytest.raises(Exception, match="killed"):
        feed.run()
    monkeypatch.setattr(writer, "parquet", save)
    feed.run()
    last = {}
    for r in rows:
        last[r[0]] = max(last.get(r[0], ("", -1, "", None)), (r[3], r[4], json.dumps({"v": r[1], "w": r[2]}, separators=(",", ":")), (r[1], r[2])))
    assert feed.kept() == {i: x[3] for i, x in last.items()}
