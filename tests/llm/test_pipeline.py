"""Every stage of the pipeline on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from palimpsest.llm import packing, secrets

from . import brute
from .test_shingles import kept

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        seen[name] = before = docs.collect()
        docs = stage(spark, docs, SF)
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            # Five words and a similarity of 0.8, as stages on word shingles take; the two bits are op1's own contract.
            assert sorted(r.doc_id for r in after) == kept([(r.doc_id, r.text) for r in before])
        elif name == "secrets":
            assert len(after) == len(before)
            old = {r.doc_id: r for r in before}
            for r in after:
                *_, spans = brute.base_secrets(old[r.doc_id].text)
                spans += brute.more_secrets(old[r.doc_id].text, secrets.CLASSES, secrets.ALLOW, spans)
                assert (r == old[r.doc_id]) == (not spans)
                assert not brute.base_secrets(r.text)[-1]
        elif name == "mixing":
            sizes, taken = defaultdict(int), defaultdict(int)
            for r in before:
                sizes[r.source] += len(brute.words(r.text))
            for r in after:
                taken[r.source] += len(brute.words(r.text))
            most = max(len(brute.words(r.text)) for r in before)
            assert all(abs(taken[s] - t) <= most for s, t in brute.mix_targets(sizes).items())
            assert max(Counter(r.doc_id for r in after).values()) <= 2
        elif name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
        docs = spark.createDataFrame(after, docs.schema) if after else docs


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == [f.split()[0] for f in packing.PIECES.split(", ")] and out.count() > 0


def test_odd_tables(spark, tmp_path):
    """Empty, null and odd documents through all stages, one after the other."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "token = abcdef0123456789 " + "word " * 5000, "en", None, 5), (3, "one two three", None, "b", 13), (3, "other text", None, "b", 10), (None, "no number", "xx", "b", 9)]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for i, data in enumerate((odd, [])):
        folder = str(tmp_path / str(i))
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        labels.limit(0 if i else 1000).write.parquet(f"{folder}/labels.parquet")
        out = pipeline.run(spark, folder).collect()
        assert out == [] if not data else {r.doc_id for r in out} <= {None, 1, 2, 3}
        if data:
            assert {2, 3} <= {r.doc_id for r in out}
