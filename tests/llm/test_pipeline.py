"""Every stage against what its operator says of the same input."""

import corpus_pipeline as P
import public_tokenizers
from edge import documents, untouched

from quietgrid.llm import langid, line_dedup, mixing, packing, simhash

EXTRA = [(100 + i, f"a shared line of text\nand number {i} of its own\n" + " ".join(f"word{(i * 7 + k) % 50} the of and" for k in range(30)), "en", f"s{i % 12}") for i in range(40)]


def test_stages(spark, tmp_path):
    from edge import DOCS

    docs = documents(spark, [*DOCS, *EXTRA, (300, EXTRA[3][1], "en", "s1")])
    names = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, "unused")
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = sorted(map(str, out.collect()))
        if name == "language_id":
            model = langid.train(docs.where(~langid.held_out(docs["doc_id"])))
            assert len(rows) == sum(p[0] != "und" and p[2] >= 0.3 for p in (model.predict(r["text"]) for r in docs.collect())) > 0
        elif name == "line_dedup":
            want = [r for r in line_dedup.dedup(docs).collect() if r["removed"] < r["lines"] or not r["removed"]]
            assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted((str(r["doc_id"]), r["text"]) for r in want)
        elif name == "simhash_near_dedup":
            groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["component_id"] is not None}
            assert {r["doc_id"] for r in out.collect() if r["doc_id"] is not None} == groups
        elif name == "source_mixing":
            assert sum(mixing_size(r["text"]) for r in out.collect()) == sum(r["taken"] for r in mixing.mix(docs).collect())
        else:
            own = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id", "piece", "length", "ids_crc32").count()
            assert sorted(map(str, own.collect())) == sorted(map(str, out.groupBy("doc_id", "piece", "length", "ids_crc32").count().collect()))
        assert k == 4 or untouched(out.collect())
        assert out.columns == (names if k < 4 else ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
        docs = out


def mixing_size(text):
    return len((text or "").encode().split())


def test_run(spark, tmp_path):
    from edge import DOCS

    documents(spark, [*DOCS, *EXTRA]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = P.run(spark, str(tmp_path)).collect()
    assert len(rows) > 10 and {r["doc_id"] for r in rows} <= {d[0] for d in [*DOCS, *EXTRA]}
