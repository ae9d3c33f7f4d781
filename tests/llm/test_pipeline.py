"""The stages of the pipeline, each against a plain version on its own input."""

import re

import corpus_pipeline
from cadenza.llm import quality

from test_lines import plain as gone_lines
from test_mixing import plain_targets
from test_ngram_join import plain as components


def test_stages(spark, docs, tmp_path):
    rows = docs.select("doc_id", "text").collect()
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in at.collect()]
        out = stage(spark, at, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        after = out.collect()
        if name != "packing":
            assert sorted(out.columns) == sorted(docs.columns)
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        if name == "quality_rules":
            kept = {r["doc_id"]: r["clean_text"] for r in quality.quality_rules(docs).where("kept").collect()}
            assert {r["doc_id"]: r["text"] for r in after} == kept and 0 < len(kept) < len(rows)
        if name == "line_dedup":
            gone = gone_lines(before)
            want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in before}
            assert {r["doc_id"]: r["text"] for r in after} == {d: t for d, t in want.items() if t.split()}
        if name == "ngram_join":
            assert {r["doc_id"] for r in after} == {c for _, c in components(before).values()}
        if name == "mixing":
            assert {r["doc_id"] for r in after} <= {d for d, _ in before} and len(after) > 0
            assert max(sum(r["doc_id"] == d for r in after) for d, _ in before) <= 3
            size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
            sizes, taken, most = {}, {}, {}
            for r in at.collect():
                sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
                most[r["source"]] = max(most.get(r["source"], 0), size(r["text"]))
            for r in after:
                taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
            for source, target in plain_targets(sizes).items():
                assert abs(taken.get(source, 0) - target) <= max(0.05 * target, most[source] / 2)
        if name == "packing":
            assert sorted({r["doc_id"] for r in after}) == sorted({d for d, _ in before})
            fill = {}
            for r in after:
                fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
            assert max(fill.values()) <= 4096 and len(fill) <= sum(fill.values()) / 4096 * 1.03 + 1
        at = out


def test_edges(spark, edge, empty):
    plain = edge.select("doc_id", "text", "lang", "source", "n_chars")
    at = plain
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
        assert stage(spark, plain, "").count() <= 3 * plain.count() + 40
        at = stage(spark, at, "").cache()
    assert re.fullmatch(r"[a-z_]+", name)


def test_extra_columns(edge):
    """Columns whose names the operators use themselves come through the stages as they are."""
    spark, at = edge.sparkSession, edge.where("doc_id <> 8 and doc_id <> 9")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, "").cache()
        assert sorted(at.columns) == sorted(edge.columns)
        assert {(r["size"], r["n"], r["component"]) for r in at.collect()} <= {("x", 1, "y")}
    assert corpus_pipeline.STAGES[-1][1](spark, at, "").count() == at.count()
