from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from stagewise.llm import exact
from stagewise.llm.exact import ExactDedup, exact_duplicates, located

from .conftest import DOCS, ODD_ROWS


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    out = []
    for i, text, *_ in rows:
        ids = groups[text or ""]
        top = max((x for x in ids if x is not None), default=None)
        out.append((i, top, len(ids), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def plain(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in frame.collect()), key=repr)


def one_stays(frame):
    kept = defaultdict(int)
    for r in frame.collect():
        kept[r.text_sha256] += r.kept
    return set(kept.values()) == {1}


def test_odd_rows_ties_and_a_hot_text(documents, tmp_path):
    rows = ODD_ROWS + [(100 + i, "one text of a third of all rows") for i in range(60)]
    rows += [(200, "same id"), (200, "same id"), (None, "no id"), (None, "no id"), (300, "a"), (301, "A"), (302, "a ")]
    documents(rows).repartition(5).write.parquet(f"{tmp_path}/d.parquet")
    got = exact_duplicates(documents([]).sparkSession, f"{tmp_path}/d.parquet")
    assert plain(got) == brute(rows) and one_stays(got)
    assert [c for c, _ in got.dtypes] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_one_file_and_an_empty_table(documents, tmp_path, shipped):
    documents([(1, "x"), (2, "x")]).coalesce(1).write.parquet(f"{tmp_path}/one")
    part = next((tmp_path / "one").glob("part-*.parquet"))
    assert plain(exact_duplicates(shipped, str(part))) == brute([(1, "x"), (2, "x")])
    documents([]).write.parquet(f"{tmp_path}/none")
    assert exact_duplicates(shipped, f"{tmp_path}/none").collect() == []


def _stream(spark, path, files):
    return located(spark.readStream.schema(DOCS).option("maxFilesPerTrigger", files).parquet(path))


def test_state_lives_on_over_triggers_and_runs(documents, tmp_path, shipped):
    """Files of a later run meet the entries of an earlier one; a run without new files adds nothing."""
    path, root = f"{tmp_path}/docs", f"{tmp_path}/kept"
    first = [(i, f"text {i % 7}") for i in range(40)]
    later = [(1000 + i, f"text {i % 11}") for i in range(22)]
    documents(first).repartition(4).write.parquet(path)
    query = ExactDedup(shipped, root).ingest(_stream(shipped, path, 1))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    before = {r.digest: r.group_size for r in ExactDedup(shipped, root).entries().collect()}
    assert sum(before.values()) == 40
    documents(later).coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):  # the second run finds no new file
        ExactDedup(shipped, root).ingest(_stream(shipped, path, 1)).awaitTermination()
    rows = located(shipped.read.schema(DOCS).parquet(path))
    got = ExactDedup(shipped, root).verdicts(rows)
    assert plain(got) == brute(first + later) and one_stays(got)


def test_full_bytes_settle_what_a_weak_digest_mixes_up(documents, tmp_path, shipped, monkeypatch):
    path, root = f"{tmp_path}/docs", f"{tmp_path}/kept"
    rows = [(i, f"text {i % 9}") for i in range(60)] + [(100, "alone"), (101, None), (102, "")]
    documents(rows).repartition(3).write.parquet(path)
    weak = lambda text: F.encode(F.length(text).cast("string"), "utf-8")
    for few in (0, exact.SMALL_DIGESTS):
        monkeypatch.setattr(exact, "SMALL_DIGESTS", few)
        dedup = ExactDedup(shipped, f"{root}{few}", digest=weak)
        dedup.ingest(_stream(shipped, path, 1)).awaitTermination()
        got = dedup.verdicts(located(shipped.read.schema(DOCS).parquet(path)))
        assert plain(got) == brute(rows) and one_stays(got)


def test_entries_hold_no_text_and_counts_meet_pre_added(documents, tmp_path, shipped):
    documents([(1, "x"), (2, "x")]).write.parquet(f"{tmp_path}/d")
    dedup = ExactDedup(shipped, f"{tmp_path}/k")
    dedup.ingest(_stream(shipped, f"{tmp_path}/d", 9)).awaitTermination()
    assert [f for f, _ in dedup.entries().dtypes] == ["digest", "keep", "group_size"]
    stored = shipped.read.format("statestore").load(f"{tmp_path}/k/state")
    assert stored.count() == 1
