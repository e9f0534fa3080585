"""Narrow tables of the similarity join take files by their rows, however many shuffle partitions there are."""

from pathlib import Path

from lodestar.llm import jaccard_join as J


def test_few_files(spark, tmp_path, monkeypatch):
    written, plain = {}, J.durable

    def kept(df, tag, *more):
        out = plain(df, tag, *more)
        written[tag] = max(written.get(tag, 0), len(list(Path(out.durable_path.removeprefix("file://")).glob("part-*"))))
        return out

    monkeypatch.setattr(J, "durable", kept)
    texts = [" ".join(f"w{(i // 3) * 40 + k}" for k in range(40)) + f" x{i % 3}" for i in range(600)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(rows).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: i // 3 * 3 for i in range(600)}
    most = 2 * spark.sparkContext.defaultParallelism
    assert {"jaccard-classes", "jaccard-prefixes", "jaccard-pairs", "jaccard-edges", "jaccard-result"} <= written.keys()
    assert {k: n for k, n in written.items() if n > most and k not in ("jaccard-signatures", "jaccard-links", "jaccard-sets")} == {}
