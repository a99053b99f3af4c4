"""Packing leaves no freed memory with its worker."""

from types import SimpleNamespace

import pyarrow as pa

from palimpsest.llm import packing, queries


def test_each_part_gives_back_what_it_freed(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1), raising=False)
    monkeypatch.setattr(packing, "TEXTS", 2)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    docs = SimpleNamespace(select=lambda *a: docs, mapInArrow=lambda f, schema: f)
    run = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"))
    out = list(run(iter([pa.record_batch([pa.array(range(5)), ["one two", None, "", "three", "four five"]], names=["doc_id", "text"])])))
    assert sorted({x for b in out for x in b.column(0).to_pylist()}) == [0, 1, 2, 3, 4]
    assert len(calls) == 3
