"""Incremental ingest of a folder: batches, replays, stops between the data and the ledger, counters."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import StreamingQueryException

from sheaf.sources import corpora
from sheaf.streaming.ingest import FolderIngest


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def state(target):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(target) for f in files}


def chunks(ingest):
    return sorted(tuple(r) for r in ingest.taken("chunks").select("paper_id", "section", "chunk_index", "content").collect())


@pytest.fixture
def folder(tmp_path):
    put(tmp_path / "in", a_dot_txt="one\n\ntwo", b__c_dot_md="three" * 900 + "\n\nfour", d_dot_exe="no text", e_dot_TXT=" ", **{"f g_dot_text": "é\n\nReferences\n\nleft out"})
    put(tmp_path / "in", bad_dot_pdf=b"%PDF-not")
    return tmp_path / "in"


def test_batches_and_counters(spark, folder, tmp_path):
    ingest = FolderIngest(spark, str(folder), str(tmp_path / "out"), 400)
    assert ingest.taken("texts").collect() == [] and ingest.ledger().collect() == []
    ingest.run(str(tmp_path / "cp"), 2)
    ledger = ingest.ledger().collect()
    assert len(ledger) == 3 and [sum(r[c] for r in ledger) for c in ("n_files", "n_skipped", "n_failed", "n_texts")] == [5, 0, 1, 4]
    # the counters are what a recount gives
    texts = ingest.taken("texts").collect()
    assert {r["paper_id"]: r["title"] for r in texts} == {"local:a.txt": "a.txt", "local:b/c.md": "c.md", "local:e.TXT": "e.TXT", "local:f g.text": "f g.text", "local:bad.pdf": "bad.pdf"}
    assert sum(r["failure"] is not None for r in texts) == 1 and sum(r["n_chunks"] for r in ledger) == ingest.taken("chunks").count()
    # the same as of all files at once
    whole = corpora.plain_chunks(corpora.file_texts(corpora.local_corpus(spark, str(folder))).filter("failure IS NULL").select("paper_id", "text"), 400)
    assert chunks(ingest) == sorted(tuple(r) for r in whole.select("paper_id", "section", "chunk_index", "content").collect())
    # nothing new: nothing done
    before = state(tmp_path / "out")
    ingest.run(str(tmp_path / "cp"), 2)
    assert state(tmp_path / "out") == before
    put(folder, new_dot_txt="five")
    ingest.run(str(tmp_path / "cp"), 2)
    assert ingest.ledger().count() == 4 and ("local:new.txt" in {c[0] for c in chunks(ingest)})


def test_a_stop_before_the_ledger(spark, folder, tmp_path):
    """The second batch dies when its data is written but not its row; run again, the result is as if it had not."""
    class Dying(FolderIngest):
        def place(self, kind, batch_id):
            if kind == "chunks" and batch_id == 1 and not os.path.exists(tmp_path / "died"):
                (tmp_path / "died").touch()
                raise RuntimeError("the driver is lost")
            return super().place(kind, batch_id)

    with pytest.raises(StreamingQueryException):
        Dying(spark, str(folder), str(tmp_path / "out"), 400).run(str(tmp_path / "cp"), 2)
    ingest = FolderIngest(spark, str(folder), str(tmp_path / "out"), 400)
    assert ingest.ledger().count() == 1 and os.path.exists(ingest.place("texts", 1)) and ingest.taken("texts").count() <= 2
    ingest.run(str(tmp_path / "cp"), 2)
    other = FolderIngest(spark, str(folder), str(tmp_path / "other"), 400)
    other.run(str(tmp_path / "cp2"), 100)
    assert chunks(ingest) == chunks(other) and ingest.ledger().count() == 3


def test_replayed_batches_change_nothing(spark, folder, tmp_path):
    ingest = FolderIngest(spark, str(folder), str(tmp_path / "out"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder))
    ingest.take(files, 0)
    before = state(tmp_path / "out")
    ingest.take(files, 0)
    assert state(tmp_path / "out") == before
    # the same papers in another batch are skipped
    ingest.take(files, 7)
    row = ingest.ledger().filter("batch_id = 7").first()
    assert (row["n_files"], row["n_skipped"], row["n_texts"], row["n_chunks"]) == (5, 5, 0, 0)
    with pytest.raises(ValueError, match="other files"):
        ingest.take(files.limit(1), 0)
