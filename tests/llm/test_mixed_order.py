"""The pipeline keeps the order that its mixing stage decides."""

from collections import Counter

import corpus_pipeline

from sylvagraph.llm import mixing


def test_position_is_the_mixed_order(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"src{(i % 10) // 3}", 6) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path, key = str(tmp_path / "mixed"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # several files
    try:
        corpus_pipeline.mixing_stage(spark, docs, "").write.parquet(path)
    finally:
        spark.conf.unset(key)
    assert len(list((tmp_path / "mixed").glob("part-*"))) > 1
    got = corpus_pipeline.token_stage(spark, spark.read.parquet(path), "").orderBy("position").collect()
    assert [r.position for r in got] == list(range(3000))
    wanted = mixing.schedule(docs).orderBy("mix_slot", "mix_row").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in wanted]
    weights = {s: mixing.TARGET_WEIGHTS.get(s, 1) for s in {r[3] for r in rows}}
    seen = Counter()
    for t, r in enumerate(got[:600], 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t * w / sum(weights.values())) <= 2 * mixing.BLOCK_ROWS for s, w in weights.items())
